"""Language ID with a blended-spectrum string kernel and Nyström landmarks.

A text is the set of its character n-grams of lengths 1 to 4 (letters in lower case, all
else one space), hashed into DIM places. The kernel of two texts is their number of
common n-grams over the geometric mean of their numbers. Landmarks Z give the Nyström map
K(x, Z) W^-1/2, and ridge regression on it has one column a language (one-versus-rest).
A text's kernel row is a product of its presence row with the landmarks' matrix, so the
map, the regression and the landmarks fold into one DIM x languages matrix, and a batch
is scored by one product of its presence matrix with that.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_rows, first_rows
from .textbytes import U, grams

BITS, LENGTHS = 14, (1, 2, 3, 4)
#: Fitted on at most so many rows of a language; so many of them, at most, are landmarks.
SAMPLE, LANDMARKS = 400, 96
#: Fitted rows of all languages together: with many languages each has fewer.
ROWS = 12_800
RIDGE = 1e-2
UNKNOWN = "und"
BLOCK = 1 << 18
_fold: np.ndarray | None = None


def fold() -> np.ndarray:
    """Per code point: the lower-case letter, or a space for all that is no letter."""
    global _fold
    if _fold is None:
        points = [chr(i) for i in range(sys.maxunicode + 1)]
        _fold = np.fromiter((ord(low) if c.isalpha() and len(low := c.lower()) == 1 else i if c.isalpha() else 32 for i, c in enumerate(points)), np.uint32, len(points))
    return _fold


def presence(text: str | None) -> np.ndarray:
    """Places of a text's n-grams; none if it has no letter."""
    out = np.zeros(1 << BITS, bool)
    if not text:
        return out
    any_letter, last = False, np.array([32], np.uint32)
    for a in range(0, len(text), BLOCK):  # blocks bound the memory for long texts
        points = np.frombuffer(text[a : a + BLOCK].encode("utf-32-le", "surrogatepass"), np.uint32)
        x = np.concatenate([last, fold()[points]] + ([np.array([32], np.uint32)] if a + BLOCK >= len(text) else []))
        x = x[np.concatenate([[True], (x[1:] != 32) | (x[:-1] != 32)])]  # one space for many
        any_letter |= bool((x != 32).any())
        for n in LENGTHS:
            out[(grams(x.astype(U), n, seed=n) >> U(64 - BITS)).astype(np.int64)] = True
        last = x[-max(LENGTHS) + 1 :]
    return out if any_letter else np.zeros(1 << BITS, bool)


@dataclass(frozen=True)
class Model:
    languages: list[str]
    weights: np.ndarray  # DIM x languages
    bias: np.ndarray

    def scores(self, rows: np.ndarray) -> np.ndarray:
        """Kernel ridge scores of presence rows by one matrix product."""
        size = np.sqrt(np.maximum(1, rows.sum(axis=1, dtype=np.float32)))[:, None]
        return rows.astype(np.float32) @ self.weights / size + self.bias


def fit_rows(rows: np.ndarray, langs: list[str], landmarks: int = LANDMARKS, ridge: float = RIDGE) -> Model:
    """Fit on presence rows and their languages. The first rows of each language are landmarks."""
    names = sorted(set(langs))
    if not names:
        return Model([], np.zeros((1 << BITS, 0), np.float32), np.zeros(0, np.float32))
    lang = np.array([names.index(x) for x in langs])
    chosen = np.concatenate([np.flatnonzero(lang == k)[: max(1, landmarks // len(names))] for k in range(len(names))])


    def unit(part: np.ndarray) -> np.ndarray:
        x = part.astype(np.float32)
        return x / np.sqrt(np.maximum(1, x.sum(axis=1)))[:, None]

    z = unit(rows[chosen])
    values, vectors = np.linalg.eigh((z @ z.T).astype(float))
    root = vectors[:, values > 1e-6] / np.sqrt(values[values > 1e-6])
    feature = np.concatenate([(unit(rows[a : a + 512]) @ z.T) @ root for a in range(0, len(rows), 512)])
    goal = np.where(lang[:, None] == np.arange(len(names)), 1.0, -1.0)
    weight = 1 / np.bincount(lang)[lang]  # languages weigh the same
    weight /= weight.sum()
    mean, aim = weight @ feature, weight @ goal
    f, g = feature - mean, goal - aim
    coef = np.linalg.solve((f * weight[:, None]).T @ f + ridge / len(f) * np.eye(f.shape[1]), (f * weight[:, None]).T @ g)
    return Model(names, (z.T @ (root @ coef)).astype(np.float32), (aim - mean @ coef).astype(np.float32))


def fit(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample: int = SAMPLE) -> Model:
    """Learn from at most ``sample`` rows of each non-null language, in order of an id hash.

    All languages together have at most ROWS rows, or one row each if they are more than
    that. Rows without a letter say nothing.
    """
    arrow_rows(labelled.sparkSession)
    rows = labelled.filter(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(id_col, lang_col)
    known = rows.select(lang_col).distinct().count()
    sample = max(1, min(sample, ROWS // max(1, known)))
    ids = first_rows(rows, [lang_col], [F.xxhash64(F.lit(6), id_col), id_col], sample, id_col)

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("lang"), pa.array([np.packbits(presence(t)).tobytes() for t in b.column("text").to_pylist()], pa.binary())], ["id", "lang", "row"])

    # at most ROWS ids, or one a language
    few = F.broadcast(ids.select(F.col(id_col).alias("id"), F.col(lang_col).cast("string").alias("lang")))
    kind = dict(labelled.dtypes)[id_col]
    got = labelled.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("own")).join(few, "id").filter("own = lang").select("id", "lang", "text").mapInArrow(packed, f"id {kind}, lang string, row binary").toArrow()
    found = sorted(zip(got.column("id").to_pylist(), got.column("lang").to_pylist(), got.column("row").to_pylist(), strict=True), key=lambda r: (str(hash_of(r[0])), r[2]))
    matrix = np.array([np.unpackbits(np.frombuffer(r[2], np.uint8)) for r in found], np.uint8).reshape(len(found), 1 << BITS)
    some = matrix.any(axis=1)
    return fit_rows(matrix[some], [r[1] for r, s in zip(found, some, strict=True) if s])


def hash_of(x: object) -> int:
    import zlib

    return zlib.crc32(str(x).encode())


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, lang_pred, score) of every row's whole text; no other column is looked at.

    score is the softmax of the winning language. Null text, a text without letters or a
    model without languages: ``und`` with score 0. Null ids stay null, repeated rows get
    equal results, ties go to the language first in order, an empty table stays empty.
    """
    arrow_rows(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            column = b.column(text_col)
            langs, score = [], []
            for a in range(0, len(column), 64):
                rows = np.array([presence(t) for t in column[a : a + 64].to_pylist()]).reshape(-1, 1 << BITS)
                some = rows.any(axis=1)
                if not model.languages:
                    some[:] = False
                s = model.scores(rows) if model.languages else np.zeros((len(rows), 1), np.float32)
                p = np.exp(4.0 * (s - s.max(axis=1, keepdims=True)))
                p /= p.sum(axis=1, keepdims=True)
                best = p.argmax(axis=1)
                langs += [model.languages[k] if ok else UNKNOWN for k, ok in zip(best, some, strict=True)]
                score += [float(p[i, k]) if ok else 0.0 for i, (k, ok) in enumerate(zip(best, some, strict=True))]
            yield pa.RecordBatch.from_arrays([b.column(id_col), pa.array(langs, pa.string()), pa.array(score, pa.float64())], [id_col, "lang_pred", "score"])

    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {dict(docs.dtypes)[id_col]}, lang_pred string, score double")
