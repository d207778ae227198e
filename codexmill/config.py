"""Settings: environment beats a .env file, which beats the defaults."""

from __future__ import annotations

import contextlib
import os
import tempfile
from collections.abc import Iterator, Mapping
from dataclasses import dataclass, fields
from pathlib import Path


@dataclass(frozen=True)
class Settings:
    chunk_size: int = 1200
    chunk_overlap: int = 200
    embedding_dim: int = 384
    retrieval_mode: str = "hybrid"
    hybrid_semantic_weight: float = 0.60
    hybrid_keyword_weight: float = 0.30
    hybrid_metadata_weight: float = 0.10
    article_boost: float = 0.65
    document_boost: float = 0.35
    docs_dir: str = "data/legal_docs"
    llm_api_key: str = ""


def read_env_file(path: str | os.PathLike) -> dict[str, str]:
    """NAME=value lines; blanks, comments and lines without = are skipped, quotes stripped."""
    file = Path(path)
    if not file.exists():
        return {}
    pairs = (line.strip().partition("=") for line in file.read_text(encoding="utf-8").splitlines() if line.strip() and not line.strip().startswith("#") and "=" in line)
    return {name.strip(): value.strip().strip("\"'") for name, _, value in pairs}


def load_settings(env: Mapping[str, str] | None = None, env_file: str | os.PathLike = ".env") -> Settings:
    """Settings by upper-case field name. A number that can't be read raises ValueError."""
    given = read_env_file(env_file) | dict(os.environ if env is None else env)
    values = {}
    for f in fields(Settings):
        raw = given.get(f.name.upper())
        if raw is None:
            continue
        kind = type(f.default)
        try:
            values[f.name] = kind(raw)
        except ValueError as e:
            raise ValueError(f"{f.name.upper()} must be {'an integer' if kind is int else 'a number'}") from e
    return Settings(**values)


def scratch_dir(spark) -> str:
    """Folder for tables that a query writes and reads back: ``spark.checkpoint.dir`` of the session.

    Only a local master may go without the setting; it gets a private folder.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if found:
        return found
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    return tempfile.mkdtemp(prefix="codexmill-")


@contextlib.contextmanager
def shuffles_dropped(spark) -> Iterator[None]:
    """Shuffle files of what runs within are deleted as each write ends, not when the driver next collects its garbage."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)
