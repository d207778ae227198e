"""Best-fit packing: documents' tokens into sequences of bounded length, by supersteps.

Pieces are range-sorted by length, the longest first, and numbered within their length; sequences
are range-sorted by the gap that they have left. Pieces of one length are alike, and so are
sequences of one gap with neighbouring numbers: a run. A superstep matches the runs of the longest
pieces left with their successors, the smallest gaps that hold them; a piece's rank says which
sequence of a run is its own, so no two pieces want one place; the gaps are updated, and the next
length follows. Where no gap is left new sequences open. There are at most ``size`` lengths and
gaps, so the supersteps' state is bounded, whatever the number of pieces; the pieces themselves
are numbered, swept along the runs and placed in parallel, each once.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import subwords
from .common import arrow_rows, cut, small_or_shuffled

#: Tokens of a sequence; the id after each document.
SIZE, END = 2048, 0
#: Parts that the pieces of one length are numbered in, at least, and pieces of a part at most.
PARTS, PART_ROWS = 64, 1 << 20
#: Ranks are below this.
_RANKS = 1 << 45


def pieces(docs: DataFrame, file: str | None = None, id_col: str = "doc_id", text_col: str = "text", size: int = SIZE, end: int = END) -> DataFrame:
    """(id, piece, start, length, ids) of every document's tokens and the end id after them.

    ``ids`` are little-endian unsigned 32-bit numbers. A document over ``size`` tokens is cut into
    pieces of ``size``, of which the first takes what is left over. Null and empty texts: the end id
    alone. Null ids stay, repeated rows each get their pieces; an empty table has none. Other columns
    are not used. Texts are encoded one at a time, of any length.
    """
    arrow_rows(docs.sparkSession)
    file = file or subwords.path(subwords.BYTE_BPE)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = subwords.byte_bpe(file, cached=subwords.CACHED // 3)
        for b in batches:
            rows, columns = [], [[], [], [], []]
            for row, ids in enumerate(coder.encode_each(x.as_py() or "" for x in b.column("text"))):
                ids = np.append(ids, np.int32(end)).astype("<u4")
                at = 0
                for k in range(-(-len(ids) // size)):
                    n = (len(ids) % size or size) if k == 0 else size
                    for column, value in zip(columns, (k, at, n, ids[at : at + n].tobytes()), strict=True):
                        column.append(value)
                    rows.append(row)
                    at += n
            kinds = (pa.int32(), pa.int64(), pa.int64(), pa.binary())
            yield pa.RecordBatch.from_arrays([b.column("id").take(pa.array(rows, pa.int64())), *(pa.array(c, t) for c, t in zip(columns, kinds, strict=True))], ["id", "piece", "start", "length", "ids"])

    kind = dict(docs.dtypes)[id_col]
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"id {kind}, piece int, start long, length long, ids binary").withColumnRenamed("id", id_col)


@dataclass
class Runs:
    """Sequences by what they have left, and the matches so far.

    A match says: of the pieces of ``length`` those from rank ``first`` on go, ``each`` to a sequence,
    into the sequences from ``sequence`` on, behind the ``used`` tokens that these hold already.
    """

    size: int = SIZE
    opened: int = 0
    matches: list[tuple[int, int, int, int, int]] = field(default_factory=list)
    _runs: dict[int, list[tuple[int, int]]] = field(default_factory=dict)

    def _leave(self, gap: int, first: int, count: int) -> None:
        if gap and count:
            self._runs.setdefault(gap, []).append((first, count))

    def _take(self, length: int) -> tuple[int, int, int] | None:
        """A run of sequences with the smallest gap that holds ``length``."""
        gap = min((g for g in self._runs if g >= length), default=None)
        if gap is None:
            return None
        first, held = self._runs[gap].pop()
        if not self._runs[gap]:
            del self._runs[gap]
        return gap, first, held

    def superstep(self, length: int, count: int) -> None:
        """Match the ``count`` pieces of one length, none of them longer than those before."""
        rank = 0
        while rank < count:
            found = self._take(length)
            if found is None:
                found = self.size, self.opened, -(-(count - rank) // (self.size // length))
                self.opened += found[2]
            gap, first, held = found
            each = gap // length
            full = min(held, (count - rank) // each)
            for sequences, n in ((full, each), (int(full < held), count - rank - full * each)):
                if sequences and n:
                    self.matches.append((length, rank, n, first, self.size - gap))
                    self._leave(gap - n * length, first, sequences)
                    rank, first, held = rank + sequences * n, first + sequences, held - sequences
            self._leave(gap, first, held)


def match(counts: dict[int, int], size: int = SIZE) -> Runs:
    """All supersteps over the numbers of pieces of each length."""
    runs = Runs(size)
    for length in sorted(counts, reverse=True):
        runs.superstep(length, counts[length])
    return runs


def _ranked(rows: DataFrame, total: int) -> DataFrame:
    """Add ``_rank``, gapless from 0 within a length; a length that very many pieces have is numbered in parts."""
    parts = max(PARTS, -(-total // PART_ROWS))
    dealt = rows.withColumn("_part", F.pmod(F.xxhash64("_row"), F.lit(parts)))
    counts = dealt.groupBy("length", "_part").agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(Window.partitionBy("length").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    offsets = counts.select("length", "_part", F.coalesce(before, F.lit(0)).alias("_before"))
    within = F.row_number().over(Window.partitionBy("length", "_part").orderBy("_row"))
    numbered = dealt.withColumn("_within", within).join(small_or_shuffled(offsets), ["length", "_part"])
    return numbered.withColumn("_rank", F.col("_before") + F.col("_within") - 1).drop("_part", "_before", "_within")


def pack(rows: DataFrame, size: int = SIZE) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to rows with a ``length`` between 1 and ``size``.

    All other columns pass through; repeated rows each get a place. Lengths that are null or out of
    bounds have null places. ``rows`` are kept as a table in the shared folder, so every pass sees the
    same ones; an empty table gives an empty one.
    """
    columns = rows.columns
    kept = cut(rows.withColumn("_row", F.monotonically_increasing_id()))  # made in the small batches of ``pieces``
    arrow_rows(rows.sparkSession, 10_000)
    good = kept.filter(F.col("length").between(1, size))
    counts = {int(r["length"]): r["n"] for r in good.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most size rows
    found = match(counts, size).matches or [(0, 0, 1, 0, 0)]
    length, first, each, sequence, used = (np.array(c, np.int64) for c in zip(*sorted(found), strict=True))
    starts = length * _RANKS + first

    def sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, rank = (b.column(c).cast(pa.int64()).to_numpy(zero_copy_only=False) for c in ("length", "_rank"))
            run = np.searchsorted(starts, n * _RANKS + rank, "right") - 1
            k = rank - first[run]
            at = [pa.array(sequence[run] + k // each[run]), pa.array(used[run] + k % each[run] * n)]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in columns), *at], [*columns, "sequence_id", "offset"])

    from pyspark.sql.types import LongType, StructField, StructType

    schema = StructType([*rows.schema.fields, StructField("sequence_id", LongType()), StructField("offset", LongType())])
    placed = _ranked(good, sum(counts.values())).select(*columns, "_rank").mapInArrow(sweep, schema)
    none = F.lit(None).cast("long")
    rest = kept.filter(~F.coalesce(F.col("length").between(1, size), F.lit(False))).select(*columns, none.alias("sequence_id"), none.alias("offset"))
    return placed.unionByName(rest)


def sequences(packed: DataFrame, ids: Column | None = None) -> DataFrame:
    """(sequence_id, length, ids) of packed pieces: what a trainer reads, at most ``size`` ids a row."""
    parts = F.array_sort(F.collect_list(F.struct("offset", (F.col("ids") if ids is None else ids).alias("ids"))))
    whole = packed.filter("sequence_id is not null").groupBy("sequence_id").agg(F.sum("length").alias("length"), parts.alias("parts"))
    return whole.select("sequence_id", "length", F.aggregate("parts", F.lit(b""), lambda a, p: F.concat(a, p["ids"])).alias("ids"))
