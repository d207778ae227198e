"""MinHash near-dedup with circulant permutations, exact confirmation and components.

Signatures follow C-MinHash (Li & Li, 2022): one permutation scatters the shingles over D
places, a second one, shifted circularly by k, gives coordinate k. The K coordinates of a
shingle are therefore K neighbouring entries of one table, read in one go.

Equal sets are one class. Classes that share a band meet in a bucket, and a bucket gives
no pairs among all its members: each is compared with the bucket's smallest member, its
centre. Two members that the centre doesn't join can still be similar, but only if they
differ from the centre in some of the same shingles: with d(x) the size of the symmetric
difference of x and the centre and t = (100 - percent) / (100 + percent), a link of x and
y needs at least (d(x) + d(y) - t * (n(x) + n(y))) / 2 common differences. A prefix filter
with positions over these differences finds all such pairs (see ``_labels``). Before that,
what a bucket's centre has not joined meets further centres of its own. Rows of one
difference meet by cells of alike bounds, so that of a family of pages with one template
only pairs that the bounds let through are ever compared. Links are confirmed on full
shingle sets.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SALTS, arrow_rows, cut, discard, salted, small_or_shuffled
from .graph import components
from .textbytes import U, grams, mix, texts, words

BITS, COORDS, BANDS = 20, 128, 32
WORDS = 5
#: Rounds in which pairs meet, as ranges of 32nds of all differences.
ROUNDS = ((0, 1), (1, 6), (6, 32))
#: Centres that a bucket gets after its first, each among what the ones before have not joined.
FURTHER = 2
#: Cells of bounds in the width of a centre's size, and the least and largest cell.
CELLS, LEAST_CELL, MOST_CELL = 32, -64, 255


def shingles(b: np.ndarray | None, n: int = WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's n-word shingles, A-Z lower-cased."""
    if b is None:
        return np.zeros(0, U)
    h, _, _ = words(b, lower=True)
    if not len(h):
        return h
    return np.unique(grams(h, n)) if len(h) >= n else grams(h, len(h), seed=len(h))


class Circulant:
    def __init__(self, bits: int = BITS, coords: int = COORDS, bands: int = BANDS, seed: int = 11):
        rng = np.random.Generator(np.random.PCG64(seed))
        size = 1 << bits
        self.shift, self.bands, self.rows = U(64 - bits), bands, coords // bands
        self.first = rng.permutation(size).astype(np.int32)
        second = rng.permutation(size).astype(np.int32)
        self.second = np.concatenate([second, second[:coords]])
        self.windows = np.lib.stride_tricks.sliding_window_view(self.second, coords)
        self.mult = rng.integers(0, 2**63, (bands, self.rows), dtype=U) * U(2) + U(1)

    def signature(self, s: np.ndarray) -> np.ndarray:
        at = self.first[s >> self.shift]
        out = None
        for i in range(0, len(at), 2048):
            part = self.windows[at[i : i + 2048]].min(axis=0)
            out = part if out is None else np.minimum(out, part)
        return out

    def keys(self, sig: np.ndarray) -> np.ndarray:
        x = sig.astype(U).reshape(self.bands, self.rows)
        return mix((x * self.mult).sum(axis=1, dtype=U) + np.arange(1, self.bands + 1, dtype=U) * U(0x9E3779B97F4A7C15)).view(np.int64)


@functools.cache
def _scheme() -> Circulant:
    """One for all tasks of a worker."""
    return Circulant()


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    scheme = _scheme()
    none = np.zeros(0, np.int64)
    for batch in batches:
        n, hi, lo, keys = [], [], [], []
        for b in texts(batch.column(1)):
            s = shingles(b)
            n.append(len(s))
            hi.append(mix(s).sum(dtype=U) if len(s) else U(0))
            lo.append(mix(s ^ U(0x5851F42D4C957F2D)).sum(dtype=U) if len(s) else U(0))
            keys.append(scheme.keys(scheme.signature(s)) if len(s) else none)
        offsets = np.concatenate([[0], np.cumsum([len(k) for k in keys])]).astype(np.int32)
        flat = np.concatenate(keys) if keys else none
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(n, pa.int64()), pa.array(np.array(hi, U).view(np.int64)), pa.array(np.array(lo, U).view(np.int64)), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))],
            ["id", "n", "hi", "lo", "bands"],
        )


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([shingles(b).tobytes() for b in texts(batch.column(1))], pa.binary())], ["id", "set"])


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        a, b = (list(texts(batch.column(c))) for c in ("set_a", "set_b"))
        both = [len(np.intersect1d(x.view(U), y.view(U), assume_unique=True)) for x, y in zip(a, b, strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(both, pa.int64()), pa.array([len(x) // 8 for x in a], pa.int64()), pa.array([len(x) // 8 for x in b], pa.int64())], ["a", "b", "both", "n_a", "n_b"])


def _differences(percent: int):
    """Of pairs (centre a, member b): whether linked, b's differences from a, and how many of
    them, in whatever order is common to a's members, must hold one that a partner shares.

    A partner y of x has at most n(x) * (100 - percent) / percent shingles that x lacks or
    has alone, so all but so many of x's differences are also those of y. The other bound
    is that of ``_labels`` for the least possible d(y).
    A member that is alone with its centre has no partner and states no differences.
    """
    t, most = (100 - percent) / (100 + percent), (100 - percent) / percent

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, centre, dist, linked, prefix, diffs, none = [], [], [], [], [], [], np.zeros(0, np.int64)
            for x, y, alone in zip(texts(batch.column("set_a")), texts(batch.column("set_b")), batch.column("alone").to_pylist(), strict=True):
                c, m = x.view(U), y.view(U)
                own, lacks = np.setdiff1d(m, c, assume_unique=True), np.setdiff1d(c, m, assume_unique=True)
                both, d = len(m) - len(own), len(own) + len(lacks)
                ok = 100 * both >= percent * (len(c) + len(own))
                least = (d + t * (len(c) - len(m))) / 2 if ok else (d - t * (len(m) + len(c))) / 2
                sizes.append(len(m))
                centre.append(len(c))
                dist.append(d)
                linked.append(ok)
                prefix.append(d - max(1, int(np.ceil(max(least, d - most * len(m)) - 1e-9))) + 1)
                diffs.append(np.concatenate([own, lacks]).view(np.int64) if alone is False else none)
            offsets = np.concatenate([[0], np.cumsum([len(p) for p in diffs])]).astype(np.int32)
            flat = np.concatenate(diffs) if diffs else none
            yield pa.RecordBatch.from_arrays(
                [batch.column("a"), batch.column("b"), pa.array(sizes, pa.int64()), pa.array(centre, pa.int64()), pa.array(dist, pa.int64()), pa.array(linked, pa.bool_()), pa.array(prefix, pa.int64()), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))],
                ["a", "b", "n", "n_a", "d", "linked", "prefix", "diffs"],
            )

    return run


def _with_sets(pairs: DataFrame, docs: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """Add set_a and set_b to (a, b); also the tables to discard when that has been run.

    The sets of a meet the narrow pairs, then travel to b: a centre of very many pairs
    draws no set of its members into one task. Only documents of pairs are read again.
    """
    ids = cut(pairs.select(F.col("a").alias("id")).union(pairs.select(F.col("b").alias("id"))).distinct())
    sets = cut(docs.join(small_or_shuffled(ids), "id", "left_semi").mapInArrow(_sets, "id long, set binary").dropDuplicates(["id"]))
    left = pairs.join(sets.withColumnRenamed("set", "set_a"), pairs["a"] == sets["id"]).drop("id")
    return left.join(sets.withColumnRenamed("set", "set_b"), left["b"] == sets["id"]).select(*pairs.columns, "set_a", "set_b"), [ids, sets]


def confirm(pairs: DataFrame, docs: DataFrame, percent: int) -> DataFrame:
    """The (a, b) of ``pairs`` whose full shingle sets are similar enough."""
    rows, used = _with_sets(pairs, docs)
    found = rows.mapInArrow(_meet, "a long, b long, both long, n_a long, n_b long")
    kept = cut(found.filter(F.col("both") * 100 >= F.lit(percent) * (F.col("n_a") + F.col("n_b") - F.col("both"))).select("a", "b"))
    discard(*used)
    return kept


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 75) -> DataFrame:
    """(id, n_shingles, component_id, kept) for every row.

    Two documents are linked if their sets of 5-word shingles have
    100 * intersection >= percent * union; component_id is the smallest id reachable.
    Bands of 4 of 128 coordinates find a pair at 0.75 with probability 1 - 5e-6.

    Ids are whole numbers. Null or wordless text: no shingles, linked with nothing. Fewer words than 5: the whole
    sequence is the one shingle. Null id: its row is kept only if nothing has its id,
    component null unless an equal text has an id. Repeated rows agree in all columns.
    Empty table: empty result. Other columns are not used.
    """
    arrow_rows(docs.sparkSession)
    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    signed = cut(source.mapInArrow(_sign, "id long, n long, hi long, lo long, bands array<long>"))
    classes = signed.filter("n > 0").groupBy("n", "hi", "lo").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("copies"))
    reps = signed.join(classes.select(F.col("rep").alias("id"), F.col("n").alias("_n"), F.col("hi").alias("_hi")), "id").filter("n = _n and hi = _hi").dropDuplicates(["id"])
    rows = reps.select(F.col("id").alias("rep"), "n", F.explode("bands").alias("key"), F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int").alias("salt")).repartition("key", "salt")
    shared = rows.groupBy("key", "salt").agg(F.count(F.lit(1)).alias("c")).groupBy("key").agg(F.sum("c").alias("c"), F.collect_set("salt").alias("salts")).filter("c > 1").select("key", F.explode("salts").alias("salt"))
    members = cut(rows.join(shared, ["key", "salt"]).select("key", "rep", "n", "salt"))
    labels = _labels(members, source, percent)
    discard(members)
    named = classes.filter("rep is not null").join(labels.select(F.col("id").alias("rep"), "component"), "rep", "left").select("n", "hi", "lo", F.coalesce("component", "rep").alias("component"), "copies").filter("copies > 1 or component != rep")
    named = named.select("n", "hi", "lo", "component")
    out = signed.select("id", "n", "hi", "lo").join(named, ["n", "hi", "lo"], "left")
    component = F.coalesce("component", "id")
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("id").eqNullSafe(component).alias("kept"))


def _labels(members: DataFrame, source: DataFrame, percent: int) -> DataFrame:
    """(id, component) by all links that pairs sharing a bucket need to be joined.

    First the stars: each member with its bucket's smallest member, then those that it did
    not join with further centres (``_further_stars``). Then, around each first centre, pairs in different components of which at least one member is not linked to
    the centre. Differences are put in order of how many of the centre's members have
    them. Those of one member alone come first and meet nothing; where the first one that
    x and y share is the i-th and j-th, min(d(x) - i, d(y) - j) bounds all that they share.

    Pairs meet by their shared differences in ROUNDS, first by few of them. Large groups
    grow together early, so the later rounds meet only what is still apart.
    """
    centres = members.groupBy("key", "salt").agg(F.min("rep").alias("c")).groupBy("key").agg(F.min("c").alias("a"), F.collect_set("salt").alias("salts")).select("key", "a", F.explode("salts").alias("salt"))
    pairs = cut(members.join(centres, ["key", "salt"]).filter("rep != a").select("a", F.col("rep").alias("b")).distinct())
    alone = pairs.groupBy("a").agg((F.count(F.lit(1)) == 1).alias("alone"))
    rows, used = _with_sets(pairs.join(alone, "a"), source)
    star = cut(rows.mapInArrow(_differences(percent), "a long, b long, n long, n_a long, d long, linked boolean, prefix long, diffs array<long>"))
    discard(*used)
    first = components(star.filter("linked"), "a", "b")
    ids = pairs.select(F.col("a").alias("id")).union(pairs.select(F.col("b").alias("id"))).distinct()
    labels = cut(ids.join(first, "id", "left").select("id", F.coalesce("component", "id").alias("component")))
    discard(first)
    labels, checked = _further_stars(members, centres, labels, pairs, source, percent)
    # a centre whose members are all joined needs no more
    told = star.select("a", "b", "linked").join(labels, F.col("b") == F.col("id")).groupBy("a")
    open_ones = told.agg(F.count_if(~F.col("linked")).alias("u"), F.min("component").alias("lo"), F.max("component").alias("hi")).filter("u > 0 and lo < hi").select("a")
    near = star.join(open_ones, "a", "left_semi")
    each = near.select("a", "b", F.explode("diffs").alias("e"))
    often = each.groupBy("a", "e").agg(F.count(F.lit(1)).alias("c")).filter("c > 1")
    common = each.join(often, ["a", "e"]).groupBy("a", "b").agg(F.array_sort(F.collect_list(F.struct("c", "e"))).alias("shared"))
    placed = near.drop("diffs").join(common, ["a", "b"]).withColumn("first", F.col("d") - F.size("shared"))
    placed = placed.withColumn("shared", F.slice("shared", F.lit(1), F.greatest(F.lit(0), F.col("prefix") - F.col("first")).cast("int")))
    probes = placed.select("a", "b", "n", "n_a", "d", "linked", "first", F.posexplode("shared").alias("at", "s"))
    probes = cut(probes.select("a", "b", "n", "n_a", "d", "linked", (F.col("first") + F.col("at")).alias("i"), F.col("s.e").alias("e")))
    discard(star)
    for low, high in ROUNDS:
        found = _meet_apart(probes.filter(F.pmod(F.xxhash64(F.lit(13), "e"), F.lit(ROUNDS[-1][1])).between(low, high - 1)), labels, percent)
        labels = _confirm_new(found, checked, labels, source, percent)
    discard(probes, *checked)
    return labels


def _confirm_new(found: DataFrame, checked: list[DataFrame], labels: DataFrame, source: DataFrame, percent: int) -> DataFrame:
    """The labels after the links among ``found`` that no table of ``checked`` holds; adds these pairs to it."""
    for known in checked:
        found = found.join(known, ["a", "b"], "left_anti")
    found = cut(found)
    checked.append(found)
    if found.isEmpty():
        return labels
    # the new links join components: a graph of components alone
    old = labels.withColumnRenamed("component", "was")
    linked = confirm(found, source, percent)
    links = linked.join(old.select(F.col("id").alias("a"), F.col("was").alias("u")), "a").join(old.select(F.col("id").alias("b"), F.col("was").alias("v")), "b")
    joined = components(links.filter("u != v"), "u", "v")
    grown = joined.select(F.col("id").alias("was"), "component")
    grown_labels = cut(old.join(grown, "was", "left").select("id", F.coalesce("component", "was").alias("component")))
    discard(linked, joined, labels)
    return grown_labels


def _further_stars(members: DataFrame, centres: DataFrame, labels: DataFrame, pairs: DataFrame, source: DataFrame, percent: int) -> tuple[DataFrame, list[DataFrame]]:
    """(labels, tables of pairs compared): FURTHER times, the members of a bucket that its centre
    has not joined get the smallest of them as a new centre, so that a second group of near
    copies in a bucket grows together by as many comparisons as it has members."""
    checked, rest, kept = [pairs], members, []
    for _ in range(FURTHER):
        mine, theirs = (labels.select(F.col("id").alias(i), F.col("component").alias(c)) for i, c in (("rep", "mine"), ("a", "theirs")))
        apart = rest.join(centres, ["key", "salt"]).join(mine, "rep").join(theirs, "a").filter("mine != theirs")
        rest = cut(apart.select("key", "salt", "rep", "n"))
        kept.append(rest)
        least = rest.groupBy("key", "salt").agg(F.min(F.struct("rep", "n")).alias("c"), F.count(F.lit(1)).alias("m"))
        least = least.groupBy("key").agg(F.min("c").alias("c"), F.sum("m").alias("m"), F.collect_set("salt").alias("salts")).filter("m > 1")
        centres = least.select("key", F.col("c.rep").alias("a"), F.col("c.n").alias("n_a"), F.explode("salts").alias("salt"))
        meet = rest.join(centres, ["key", "salt"]).filter(f"rep != a and least(n, n_a) * 100 >= greatest(n, n_a) * {percent}")
        labels = _confirm_new(meet.select("a", F.col("rep").alias("b")).distinct(), checked, labels, source, percent)
    discard(*kept)
    return labels, checked


def _meet_apart(probes: DataFrame, labels: DataFrame, percent: int) -> DataFrame:
    """(a, b), smaller first, of pairs in different components that meet in a difference and may be linked."""
    big, small = 100 + percent, 100 - percent
    rows, goes = _visits(probes, labels, percent)
    x = goes.select("a", "e", F.col("to.cell").alias("to"), F.col("cell").alias("x_cell"), *[F.col(c).alias(f"x_{c}") for c in ("b", "n", "d", "i", "component")])
    y = rows.select("a", "e", F.col("cell").alias("to"), *[F.col(c).alias(f"y_{c}") for c in ("b", "n", "d", "i", "component")])
    bound = F.least(F.col("x_d") - F.col("x_i"), F.col("y_d") - F.col("y_i"))
    ok = (
        (x["a"] == y["a"])
        & (x["e"] == y["e"])
        & (x["to"] == y["to"])
        & (F.col("x_component") != F.col("y_component"))
        & ((x["to"] != F.col("x_cell")) | (F.col("x_b") < F.col("y_b")))
        & (F.least("x_n", "y_n") * 100 >= F.greatest("x_n", "y_n") * percent)
        & (2 * big * bound >= big * (F.col("x_d") + F.col("y_d")) - small * (F.col("x_n") + F.col("y_n")))
    )
    return x.join(y, ok).select(F.least("x_b", "y_b").alias("a"), F.greatest("x_b", "y_b").alias("b")).distinct()


def _visits(probes: DataFrame, labels: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """All rows in their cells, and the rows not linked to their centre once a cell that they go to.

    With w = d - t * n and v = 2 * (d - i) - w, two rows of one difference may be linked only if
    w(x) <= v(y) and w(y) <= v(x). Rows alike in w, v and size are a cell, and each x goes to
    the cells alone that its own bounds allow and that hold another component: rows that can
    link with nothing are never compared. A difference has a bounded number of cells, however
    many members share it, and its rows are in SALTS parts until they go to cells.
    """
    big, small, ratio = 100 + percent, 100 - percent, math.log(100 / percent) + 1e-6
    w = big * F.col("d") - small * F.col("n")
    width = F.col("n_a") * (big / CELLS) + 1
    placed = lambda value: F.greatest(F.lit(LEAST_CELL), F.least(F.lit(MOST_CELL), F.floor(value / width))).cast("int")
    cell = F.struct("linked", placed(w).alias("w"), placed(2 * big * (F.col("d") - F.col("i")) - w).alias("v"), F.floor(F.log("n") / ratio).cast("int").alias("size"))
    rows = probes.join(labels, probes["b"] == labels["id"]).select("a", "e", "b", "n", "d", "i", "component", cell.alias("cell"), salted("b").alias("salt")).repartition("a", "e", "salt")
    cells = rows.groupBy("a", "e", "salt", "cell").agg(F.min("component").alias("lo"), F.max("component").alias("hi"))
    cells = cells.groupBy("a", "e", "cell").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.collect_set("salt").alias("salts"))
    cells = cells.groupBy("a", "e").agg(F.collect_list(F.struct("cell", "lo", "hi")).alias("cells"), F.array_distinct(F.flatten(F.collect_list("salts"))).alias("salts"))
    cells = cells.select("a", "e", "cells", F.explode("salts").alias("salt"))

    def allowed(to: Column) -> Column:
        c = to["cell"]
        once = c["linked"] | (F.struct(c["w"], c["v"], c["size"]) >= F.struct(F.col("cell.w"), F.col("cell.v"), F.col("cell.size")))
        alike = F.abs(c["size"] - F.col("cell.size")) <= 1
        return once & alike & (c["w"] <= F.col("cell.v")) & (F.col("cell.w") <= c["v"]) & ((to["lo"] != F.col("component")) | (to["hi"] != F.col("component")))

    goes = rows.filter("not cell.linked").join(cells, ["a", "e", "salt"]).withColumn("to", F.explode(F.filter("cells", allowed)))
    return rows, goes
