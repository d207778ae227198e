"""A data source that writes one JSONL file per document, with commit and abort.

Rows are (output, record): the file's name and its JSON line. All rows of a file come to one task in
order (``write_files`` sees to that) and are written as they arrive, so a file may be larger than
memory. Tasks write to a folder of the run; files move to their names once every task has ended,
and a run that fails leaves none behind.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import unquote, urlparse

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from ..config import shuffles_dropped

NAME = "codexmill_jsonl"
#: Records of an Arrow batch, which a writer's task has as Python strings at once.
ROWS = 256


def _fs(path: str):
    """pyarrow's file system of a path or URI, and the path in it."""
    from pyarrow import fs

    where = urlparse(path)
    if where.scheme in ("", "file"):
        return fs.LocalFileSystem(), unquote(where.path) if where.scheme else path
    return fs.FileSystem.from_uri(path)


@dataclass
class Written(WriterCommitMessage):
    files: list[tuple[str, str]]


class JsonlFiles(DataSource):
    """``path``: the folder of the files. Save mode overwrite replaces files of the same names only."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return "output string, record string"

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return _Writer(self.options["path"].rstrip("/"), self.options["run"])


class _Writer(DataSourceArrowWriter):
    def __init__(self, path: str, run: str):
        self.path, self.staging = path, f"{path}/_staging-{run}"

    def write(self, iterator: Iterator) -> WriterCommitMessage:
        fs, staging = _fs(self.staging)
        fs.create_dir(staging, recursive=True)
        done, out, open_name = [], None, None
        try:
            for batch in iterator:
                names, records = (batch.column(c).to_pylist() for c in ("output", "record"))
                for name, record in zip(names, records, strict=True):
                    if name != open_name:
                        if out is not None:
                            out.close()
                        open_name, staged = name, f"{staging}/{uuid.uuid4().hex}"
                        out = fs.open_output_stream(staged)
                        done.append((name, staged))
                    out.write(record.encode() + b"\n")
        finally:
            if out is not None:
                out.close()
        return Written(done)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        fs, path = _fs(self.path)
        for m in messages:
            for name, staged in m.files if m else ():
                fs.move(staged, f"{path}/{name}")
        self._clear()

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        self._clear()

    def _clear(self) -> None:
        from pyarrow import fs as kinds

        fs, staging = _fs(self.staging)
        if fs.get_file_info(staging).type != kinds.FileType.NotFound:
            fs.delete_dir(staging)


def write_files(records: DataFrame, path: str, output: str, order: list[str]) -> None:
    """Write each row's JSON (nulls written out) to the file that its column ``output`` names, in order.

    Needs a folder that driver and executors share. Files of other names stay. Rows whose name is
    null are refused by the writer's task.
    """
    spark = records.sparkSession
    spark.dataSource.register(JsonlFiles)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ROWS))
    line = F.to_json(F.struct(*[c for c in records.columns if c != output and c not in order]), {"ignoreNullFields": "false"})
    rows = records.select(F.col(output).alias("output"), *order, line.alias("record"))
    dealt = rows.repartition("output").sortWithinPartitions("output", *order).select("output", "record")
    with shuffles_dropped(spark):
        dealt.write.format(NAME).option("path", path).option("run", uuid.uuid4().hex).mode("append").save()
