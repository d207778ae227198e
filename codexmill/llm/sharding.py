"""K-d tree sharding: distributed weighted medians along the widest metadata dimension.

Groups of equal texts are the points and their bytes the weights, so copies are never
parted. A dimension's code is a value's place among the column's different values, whole and in
their own order, followed by a hash of the text, so no outlier or common start takes up the
codes and no two groups tie. A node's widest dimension is the one in which it spans most values. All nodes of a level are split together: every pass sums bytes in equal
slices of each node's open interval, and the slice that holds the median becomes the
next interval. Only the slices' sums, at most SUMS numbers a pass, reach the driver.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DateType, NumericType, StringType, TimestampNTZType, TimestampType
from pyspark.sql.window import Window

from .common import cut, discard

SLICES = 4096
#: Sums of a pass, over all nodes, that the driver may see; nodes split by such passes.
SUMS, NODES = 1 << 20, 1 << 14
#: From so many nodes on, each of at most so many groups, a node is finished in one task.
LOCAL_NODES, LOCAL_ROWS = 64, 2_000_000
#: Bits of the tie-break in a dimension's code; the other 39 count values.
TIE_BITS = 24
#: Different values of a column that may be broadcast, and only if each is within VALUE_CHARS.
VALUES, VALUE_CHARS = 200_000, 256
#: Rows of one numbering task.
SLOT_ROWS = 100_000


def _points(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(
        F.col(id_col).alias("_id"),
        (F.octet_length(text) + 1).cast("long").alias("_size"),
        F.crc32(F.encode(text, "UTF-8")).alias("_crc"),
        F.xxhash64(F.lit(1), text).alias("_h1"),
        F.xxhash64(F.lit(2), text).alias("_h2"),
        *[F.col(c).alias(f"_m{i}") for i, c in enumerate(_metadata(docs, id_col, text_col))],
    )


def _metadata(docs: DataFrame, id_col: str, text_col: str) -> list[str]:
    """Columns beside the id and the text whose values have an order of their own: all of them are dimensions."""
    kinds = (NumericType, StringType, BooleanType, DateType, TimestampType, TimestampNTZType)
    return [f.name for f in docs.schema.fields if f.name not in (id_col, text_col) and isinstance(f.dataType, kinds)]


def _places(groups: DataFrame, column: str) -> DataFrame:
    """(column, _place): each different value's place in their order, null first, from 0.

    Values are range-sorted and kept; a sorted part's number and the rows of the parts before it
    give the places, so no task sees more than its own part.
    """
    ordered = cut(groups.select(column).distinct().orderBy(F.col(column).asc_nulls_first()).select(column, F.monotonically_increasing_id().alias("_at")))
    part, within = F.shiftright("_at", 33), F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    counts = ordered.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"))  # a row a part
    before = F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    offsets = F.broadcast(counts.select("_part", F.coalesce(before, F.lit(0)).alias("_before")))
    placed = ordered.withColumn("_part", part).join(offsets, "_part").select(column, (F.col("_before") + within).alias("_place"))
    placed._cut_path = ordered._cut_path
    return placed


def _codes(groups: DataFrame, n_meta: int) -> tuple[DataFrame, list[DataFrame]]:
    """One bigint code per dimension: a value's place, then a hash of the text. And what to discard once they are kept."""
    names = [f"_m{i}" for i in range(n_meta)]
    groups = groups.withColumn(f"_m{n_meta}", F.col("_bytes"))
    tie = F.pmod(F.xxhash64(F.lit(7), "_h1", "_h2"), F.lit(1 << TIE_BITS))
    used = []
    for i, c in enumerate([*names, f"_m{n_meta}"]):
        places = _places(groups, c)
        used.append(places)
        size = places.agg(F.count(F.lit(1)).alias("n"), F.max(F.char_length(F.col(c).cast("string"))).alias("c")).first()
        few = F.broadcast(places) if size["n"] <= VALUES and (size["c"] or 0) <= VALUE_CHARS else places
        few = few.withColumnRenamed(c, "_value")
        groups = groups.join(few, F.col(c).eqNullSafe(F.col("_value"))).withColumn(f"_d{i}", F.col("_place") * F.lit(1 << TIE_BITS) + tie).drop(c, "_value", "_place")
    return groups.drop("_rows"), used


def _share(total: int, shards: int) -> float:
    """Bytes that the left child of a node of so many shards should get."""
    return total * ((shards + 1) // 2) / shards


def _medians(groups: DataFrame, dims: list[str], nodes: dict[int, tuple[int, int]], stats: dict[int, Row]) -> dict[int, tuple[int, int]]:
    """node: (dimension, code): codes below it go left. All open nodes are refined together."""
    spark, dim, span, below, found = groups.sparkSession, {}, {}, {}, {}
    for k, r in stats.items():
        if nodes[k][1] > 1:
            dim[k] = max(range(len(dims)), key=lambda d: r[f"hi{d}"] - r[f"lo{d}"])
            span[k], below[k] = (r[f"lo{dim[k]}"], r[f"hi{dim[k]}"] + 1), 0
    slices = max(16, min(SLICES, SUMS // max(1, len(span))))
    while span:
        shift = {k: max(0, (-(-(b - a) // slices) - 1).bit_length()) for k, (a, b) in span.items()}
        rows = [(k, dim[k] + 1, span[k][0], span[k][1], shift[k]) for k in span]
        asked = F.broadcast(spark.createDataFrame(rows, "_node long, _dim int, _a long, _b long, _shift int"))  # at most NODES rows
        coded = groups.join(asked, "_node").withColumn("_code", F.element_at(F.array(*dims), F.col("_dim"))).filter("_code >= _a and _code < _b")
        sums: dict[int, dict[int, int]] = {k: {} for k in span}
        for r in coded.groupBy("_node", F.expr("shiftright(_code - _a, _shift)").alias("s")).agg(F.sum("_bytes").alias("b")).collect():
            sums[r["_node"]][r["s"]] = r["b"]
        for k in list(span):
            (a, b), want = span[k], _share(stats[k]["total"], nodes[k][1])
            for s in sorted(sums[k]):
                if below[k] + sums[k][s] >= want:
                    break
                below[k] += sums[k][s]
            if shift[k]:
                span[k] = (a + (s << shift[k]), min(b, a + ((s + 1) << shift[k])))
                continue
            # the code a + s holds the median: it goes to the side that it fits better
            after = below[k] + sums[k][s]
            found[k] = dim[k], a + s + (after - want <= want - below[k])
            del span[k]
    return found


def _finish(groups: DataFrame, dims: list[str], nodes: dict[int, tuple[int, int]]) -> DataFrame:
    """Split nodes that fit a task on their own, each in one task."""
    rows = groups.sparkSession.createDataFrame([(k, *v) for k, v in nodes.items()], "_node long, _first int, _n int")
    kept = [c for c in groups.columns if c != "_node"]
    kinds = dict(groups.dtypes)

    def run(table: pa.Table) -> pa.Table:
        weight = table.column("_bytes").to_numpy()
        codes = np.stack([table.column(d).to_numpy() for d in dims], axis=1)
        shard, todo = np.zeros(len(weight), np.int32), [(np.arange(len(weight)), table.column("_first")[0].as_py(), table.column("_n")[0].as_py())]
        while todo:
            at, first, n = todo.pop()
            if n == 1 or not len(at):
                shard[at] = first
                continue
            d = int((codes[at].max(axis=0) - codes[at].min(axis=0)).argmax())
            at = at[np.argsort(codes[at, d], kind="stable")]
            run_up, want = np.cumsum(weight[at]), _share(int(weight[at].sum()), n)
            cut_at = int(np.searchsorted(run_up, want))
            cut_at += int(run_up[cut_at] - want <= want - (run_up[cut_at] - weight[at[cut_at]]))
            half = (n + 1) // 2
            todo += [(at[:cut_at], first, half), (at[cut_at:], first + half, n - half)]
        return table.select(kept).append_column("shard", pa.array(shard))

    return groups.join(F.broadcast(rows), "_node").groupBy("_node").applyInArrow(lambda t: run(t), ", ".join(f"{c} {kinds[c]}" for c in kept) + ", shard int")


def kd_leaves(groups: DataFrame, dims: list[str], shards: int) -> DataFrame:
    """Add ``shard`` to (.., _bytes, dims): leaves of near equal bytes, numbered from 0.

    A node with s shards sends ceil(s/2)/s of its bytes left, so s need not be a power of
    two. Levels are split by distributed passes; once there are LOCAL_NODES nodes and each
    fits a task, the rest of every subtree is split in a task of its own.
    """
    nodes = {0: (0, shards)}  # node: (first shard, shards)
    groups, held = groups.withColumn("_node", F.lit(0).cast("long")), []
    while any(n > 1 for _, n in nodes.values()):
        aggs = [f(d).alias(f"{k}{i}") for i, d in enumerate(dims) for k, f in (("lo", F.min), ("hi", F.max))]
        stats = {r["_node"]: r for r in groups.groupBy("_node").agg(F.sum("_bytes").alias("total"), F.count(F.lit(1)).alias("rows"), *aggs).collect()}
        if len(nodes) >= LOCAL_NODES and max((r["rows"] for r in stats.values()), default=0) <= LOCAL_ROWS or len(nodes) >= NODES:
            return _finish(groups, dims, nodes)
        medians = _medians(groups, dims, nodes, stats)
        grown = {}
        for k, (first, n) in nodes.items():
            half = (n + 1) // 2
            if k in medians:
                grown[2 * k + 1], grown[2 * k + 2] = (first, half), (first + half, n - half)
            else:
                grown[2 * k + 1] = (first, 1)  # a leaf, or a node without rows
        rows = [(k, *medians.get(k, (0, None))) for k in nodes]
        turns = F.broadcast(groups.sparkSession.createDataFrame(rows, "_node long, _dim int, _cut long"))
        right = F.coalesce(F.element_at(F.array(*dims), F.col("_dim") + 1) >= F.col("_cut"), F.lit(False))
        groups = cut(groups.join(turns, "_node").withColumn("_node", 2 * F.col("_node") + 1 + right.cast("long")).drop("_dim", "_cut"))
        discard(*held)
        held = [groups]
        nodes = grown
    leaves = groups.sparkSession.createDataFrame([(k, first) for k, (first, _) in nodes.items()], "_node long, shard int")
    return groups.join(F.broadcast(leaves), "_node").drop("_node")


def kd_shards(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shards: int | None = None, target_bytes: int | None = None) -> DataFrame:
    """(id, size, text_crc32, law, shard, slot, grown_shard) for every row.

    Law ``bytes``: shards of near equal bytes, where size is the text's UTF-8 bytes plus 1.
    Give ``shards``, or ``target_bytes`` for as many as leaves of that size take. Equal
    texts share a shard; a group over a shard's fair size therefore makes that shard
    larger. Slots run from 0 without gaps in each shard, in hashed parts and then by id.

    Null text: as the empty text, size 1. Null id: as any other id. Empty table: empty result.
    Repeated rows all stay. Other columns are not returned; those of numbers, strings, booleans,
    dates and times are dimensions, in the order that Spark sorts their values: null before all
    others, NaN after them. A group has the least of its values; other kinds of columns are not used.
    """
    n_meta = len(_metadata(docs, id_col, text_col))
    points = cut(_points(docs, id_col, text_col))
    groups = points.groupBy("_h1", "_h2").agg(F.sum("_size").alias("_bytes"), F.count(F.lit(1)).alias("_rows"), *[F.min(f"_m{i}").alias(f"_m{i}") for i in range(n_meta)])
    groups = cut(groups)
    made, used = _codes(groups, n_meta)
    codes = cut(made)
    discard(groups, *used)
    if shards is None:
        total = codes.agg(F.sum("_bytes")).first()[0] or 0
        shards = max(1, -(-total // max(1, target_bytes or 1 << 27)))
    placed = kd_leaves(codes, [c for c in codes.columns if c.startswith("_d")], shards).select("_h1", "_h2", "shard")
    n = points.count()
    parts = max(1, -(-n // SLOT_ROWS))
    rows = cut(points.select("_id", "_size", "_crc", "_h1", "_h2").join(placed, ["_h1", "_h2"]).select("_id", "_size", "_crc", "shard"))
    discard(points, codes)
    # rows are numbered in hashed parts, then shifted by the counts of the parts before
    rows = rows.withColumn("_part", F.pmod(F.xxhash64(F.lit(9), "_id", "_crc"), F.lit(parts)).cast("int"))
    counts = rows.groupBy("shard", "_part").agg(F.count(F.lit(1)).alias("_c"))
    before = counts.withColumn("_before", F.sum("_c").over(Window.partitionBy("shard").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))).select("shard", "_part", F.coalesce("_before", F.lit(0)).alias("_before"))
    numbered = rows.withColumn("_rank", F.row_number().over(Window.partitionBy("shard", "_part").orderBy("_id")))
    return numbered.join(before, ["shard", "_part"]).select(
        F.col("_id").alias(id_col),
        F.col("_size").alias("size"),
        F.col("_crc").alias("text_crc32"),
        F.lit("bytes").alias("law"),
        "shard",
        (F.col("_before") + F.col("_rank") - 1).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
