"""Substring dedup with fixed-block anchors.

A window of ``window`` words always holds one whole block of a document's grid of
blocks of (window + 1) // 2 words. The blocks of all documents are the index; the rolling
windows of one block's length of all documents probe it. Blocks that are met elsewhere
are anchors, and windows around an anchor are extended to the full length and counted by
a 96-bit hash of their words. Consecutive repeated windows make maximal repeats.

Documents are dealt into buckets of a few MB by one shuffle, which all three passes
read again. A bucket sends each distinct hash once, sorted and cut into parts, so a
passage that a third of the documents share costs one entry a bucket, not one a row.
Bucket and part sizes grow with the square root of large inputs, so that rows of few hashes
stay rare, but at most to MOST_GROWN times; from there on the memory of a task stays the same
at any size of input and only the number of (bucket, part) rows grows, with the words.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textbytes import U, long_grams, runs, texts, words

WINDOW = 35
BUCKET_BYTES, PART_WORDS, LARGE, MOST_GROWN = 4 << 20, 1 << 20, 24e9, 4
#: Bits of an anchor's hash beside those that name its part; a false anchor costs a probe.
ANCHOR_BITS = 40
SECOND = 0xD6E8FEB86659FD93


def _split(keys: np.ndarray, bits: int, shift: int) -> list[tuple[int, int, int]]:
    """(part, from, to) of sorted keys whose part is keys >> shift; none of no keys."""
    if not len(keys):
        return []
    parts = (keys >> U(shift)).astype(np.int64) if bits else np.zeros(len(keys), np.int64)
    at = np.flatnonzero(np.diff(parts, prepend=-1))
    return [(int(parts[a]), int(a), int(b)) for a, b in zip(at, np.append(at[1:], len(keys)), strict=True)]


def _pack40(k: np.ndarray) -> bytes:
    """Sorted 40-bit keys: the high bytes run in order and compress well."""
    return (k & U(0xFFFFFFFF)).astype("<u4").tobytes() + (k >> U(32)).astype(np.uint8).tobytes()


def _unpack40(b: np.ndarray) -> np.ndarray:
    n = len(b) // 5
    return np.frombuffer(b[: 4 * n].tobytes(), "<u4").astype(U) | (b[4 * n :].astype(U) << U(32))


def _column(table: pa.Table, name: str) -> list[np.ndarray | None]:
    return [x for chunk in table.column(name).chunks for x in texts(chunk)]


class Passes:
    def __init__(self, window: int, bits: int):
        self.window, self.block, self.bits = window, (window + 1) // 2, bits
        self.cut = 64 - bits - ANCHOR_BITS

    def anchors(self, h: np.ndarray) -> np.ndarray:
        """Hashes of the rolling windows of a block's length, cut to part and anchor bits."""
        return long_grams(h, self.block) >> U(self.cut)

    def probe(self, table: pa.Table) -> pa.Table:
        """A bucket's distinct anchor hashes with: is a grid block, occurs twice."""
        all_keys, all_grid = [], []
        for b in _column(table, "text"):
            if b is None:
                continue
            k = self.anchors(words(b)[0])
            grid = np.zeros(len(k), bool)
            grid[:: self.block] = True
            all_keys.append(k)
            all_grid.append(grid)
        bucket = table.column("bucket")[0].as_py()
        if not all_keys:
            return pa.table({"part": pa.array([], pa.int32()), "bucket": pa.array([], pa.int64()), "keys": pa.array([], pa.binary()), "grid": pa.array([], pa.binary()), "twice": pa.array([], pa.binary())})
        keys, grid = np.concatenate(all_keys), np.concatenate(all_grid)
        order = np.argsort(keys, kind="stable")
        keys, grid = keys[order], grid[order]
        at = np.flatnonzero(np.diff(keys, prepend=~keys[:1])) if len(keys) else np.zeros(0, np.int64)
        twice = np.diff(np.append(at, len(keys))) > 1
        grid = np.add.reduceat(grid.astype(np.int32), at) > 0 if len(at) else grid
        keys = keys[at]
        rows = _split(keys, self.bits, ANCHOR_BITS)
        low = keys & U((1 << ANCHOR_BITS) - 1)
        return pa.table(
            {
                "part": pa.array([p for p, _, _ in rows], pa.int32()),
                "bucket": pa.array([bucket] * len(rows), pa.int64()),
                "keys": pa.array([_pack40(low[a:b]) for _, a, b in rows], pa.binary()),
                "grid": pa.array([np.packbits(grid[a:b]).tobytes() for _, a, b in rows], pa.binary()),
                "twice": pa.array([np.packbits(twice[a:b]).tobytes() for _, a, b in rows], pa.binary()),
            }
        )

    def match(self, table: pa.Table) -> pa.Table:
        """A part's anchors: keys of a grid block that occur more than once; told to buckets."""
        part, buckets = table.column("part")[0].as_py(), table.column("bucket").to_pylist()
        keys = [_unpack40(k) for k in _column(table, "keys")]
        sizes = [len(k) for k in keys]
        bit = lambda name: np.concatenate([np.unpackbits(x, count=n) for x, n in zip(_column(table, name), sizes, strict=True)])
        flat, grid, count = np.concatenate(keys), bit("grid"), bit("twice").astype(np.int32) + 1
        order = np.argsort(flat, kind="stable")
        at = np.flatnonzero(np.diff(flat[order], prepend=~flat[order][:1]))
        good = (np.add.reduceat(count[order], at) > 1) & (np.maximum.reduceat(grid[order], at) > 0)
        hit = np.zeros(len(flat), bool)
        hit[order] = np.repeat(good, np.diff(np.append(at, len(flat))))
        ends = np.cumsum(sizes)
        told = [(b, flat[e - n : e][hit[e - n : e]]) for b, n, e in zip(buckets, sizes, ends, strict=True)]
        told = [(b, k) for b, k in told if len(k)]
        return pa.table({"bucket": pa.array([b for b, _ in told], pa.int64()), "part": pa.array([part] * len(told), pa.int32()), "keys": pa.array([_pack40(k) for _, k in told], pa.binary())})

    def extend(self, docs: pa.Table, told: pa.Table) -> pa.Table:
        """Full windows of a bucket that hold an anchor of their own grid: distinct hashes."""
        none = pa.table({"part": pa.array([], pa.int32()), "bucket": pa.array([], pa.int64()), "first": pa.array([], pa.binary()), "second": pa.array([], pa.binary()), "twice": pa.array([], pa.binary())})
        if not (docs.num_rows and told.num_rows):
            return none
        known = np.concatenate([_unpack40(k) | (U(p) << U(ANCHOR_BITS)) for k, p in zip(_column(told, "keys"), told.column("part").to_pylist(), strict=True)])
        known.sort()
        first, second = [], []
        for b in _column(docs, "text"):
            if b is None:
                continue
            h = words(b)[0]
            n = len(h) - self.window + 1
            if n <= 0:
                continue
            blocks = self.anchors(h)[:: self.block]
            spot = np.minimum(np.searchsorted(known, blocks), len(known) - 1)
            good = known[spot] == blocks
            if not good.any():
                continue
            start = np.arange(n)
            live = good[-(-start // self.block)]  # the one grid block that lies in each window
            if live.any():
                first.append(long_grams(h, self.window)[live])
                second.append(long_grams(h, self.window, SECOND, 1)[live].astype(np.uint32))
        if not first:
            return none
        k1, k2 = np.concatenate(first), np.concatenate(second)
        order = np.lexsort((k2, k1))
        k1, k2 = k1[order], k2[order]
        new = np.ones(len(k1), bool)
        new[1:] = (k1[1:] != k1[:-1]) | (k2[1:] != k2[:-1])
        at = np.flatnonzero(new)
        twice = np.diff(np.append(at, len(k1))) > 1
        k1, k2 = k1[at], k2[at]
        rows = _split(k1, self.bits, 64 - self.bits)
        return pa.table(
            {
                "part": pa.array([p for p, _, _ in rows], pa.int32()),
                "bucket": pa.array([docs.column("bucket")[0].as_py()] * len(rows), pa.int64()),
                "first": pa.array([k1[a:b].tobytes() for _, a, b in rows], pa.binary()),
                "second": pa.array([k2[a:b].tobytes() for _, a, b in rows], pa.binary()),
                "twice": pa.array([np.packbits(twice[a:b]).tobytes() for _, a, b in rows], pa.binary()),
            }
        )

    def count(self, table: pa.Table) -> pa.Table:
        """A part's windows that occur more than once; told to the buckets that have them."""
        buckets = table.column("bucket").to_pylist()
        k1 = [x.view(U) for x in _column(table, "first")]
        sizes = [len(k) for k in k1]
        flat, k2 = np.concatenate(k1), np.concatenate([np.frombuffer(x.tobytes(), np.uint32) for x in _column(table, "second")])
        many = np.concatenate([np.unpackbits(x, count=n) for x, n in zip(_column(table, "twice"), sizes, strict=True)]).astype(np.int32) + 1
        order = np.lexsort((k2, flat))
        a, b = flat[order], k2[order]
        new = np.ones(len(a), bool)
        new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
        at = np.flatnonzero(new)
        hit = np.zeros(len(a), bool)
        hit[order] = np.repeat(np.add.reduceat(many[order], at) > 1, np.diff(np.append(at, len(a))))
        ends = np.cumsum(sizes)
        told = [(bucket, flat[e - n : e][hit[e - n : e]], k2[e - n : e][hit[e - n : e]]) for bucket, n, e in zip(buckets, sizes, ends, strict=True)]
        told = [x for x in told if len(x[1])]
        return pa.table({"bucket": pa.array([x[0] for x in told], pa.int64()), "first": pa.array([x[1].tobytes() for x in told], pa.binary()), "second": pa.array([x[2].tobytes() for x in told], pa.binary())})

    def strip(self, docs: pa.Table, told: pa.Table) -> pa.Table:
        """Drop the words of a bucket's documents that lie in a repeated window."""
        repeated = np.zeros(0, U)
        if told.num_rows:
            repeated = np.concatenate([x.view(U) for x in _column(told, "first")])
            check = np.concatenate([np.frombuffer(x.tobytes(), np.uint32) for x in _column(told, "second")])
            order = np.argsort(repeated, kind="stable")
            repeated, check = repeated[order], check[order]
        total, removed, kept, spans = [], [], [], []
        for b in _column(docs, "text"):
            if b is None:
                b = np.zeros(0, np.uint8)
            every = b.tobytes().split()  # splits at the same six characters
            gone = np.zeros(len(every), bool)
            if len(repeated) and len(every) >= self.window:
                h = words(b)[0]
                k1 = long_grams(h, self.window)
                lo, hi = np.searchsorted(repeated, k1, "left"), np.searchsorted(repeated, k1, "right")
                hit = hi > lo
                if hit.any():
                    k2 = long_grams(h, self.window, SECOND, 1).astype(np.uint32)
                    hit &= check[np.minimum(lo, len(check) - 1)] == k2
                    for i in np.flatnonzero(hi - lo > 1):  # equal in the first hash only
                        hit[i] = k2[i] in check[lo[i] : hi[i]]
                    gone = runs(hit, self.window, len(every))
            edge = np.diff(np.concatenate([[0], gone.astype(np.int8), [0]]))
            spans.append([{"from": int(s), "to": int(e)} for s, e in zip(np.flatnonzero(edge == 1), np.flatnonzero(edge == -1), strict=True)])
            total.append(len(every))
            removed.append(int(gone.sum()))
            kept.append(b" ".join(every if not removed[-1] else [w for w, g in zip(every, gone, strict=True) if not g]))
        span = pa.list_(pa.struct([("from", pa.int64()), ("to", pa.int64())]))
        return pa.table({"id": docs.column("id"), "n_words": pa.array(total, pa.int64()), "n_removed": pa.array(removed, pa.int64()), "kept_text": pa.array(kept, pa.binary()).cast(pa.string()), "spans": pa.array(spans, span)})


def scale(total: int) -> tuple[int, int]:
    """(buckets, bits of the part number) for so many bytes of text."""
    grow = min(MOST_GROWN, max(1.0, math.sqrt(total / LARGE)))
    return max(1, math.ceil(total / (BUCKET_BYTES * grow))), max(0, math.ceil(math.log2(max(1.0, total / 6 / (PART_WORDS * grow)))))


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """(id, n_words, n_removed, kept_text, spans) for every row.

    Words are runs of characters other than x20 and x09-x0D. Every word that lies in a
    window of ``window`` words found elsewhere too (any document, the same included) goes;
    windows are judged on the input. ``spans`` are the maximal removed word ranges.

    Null, empty or short text (also where no text of the table or of a bucket has a block's
    length): nothing is removed; null gives an empty kept_text. Rows
    repeated whole repeat each other's windows. Null ids stay null. Empty table: empty
    result. Other columns are not used.
    """
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    total = source.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets, bits = scale(total)
    # rows alike in id and length are parted by where they are read, which a retry repeats
    at = F.xxhash64("id", F.octet_length("text"), F.spark_partition_id())
    dealt = source.withColumn("bucket", F.pmod(at, F.lit(buckets))).repartition("bucket")
    p = Passes(window, bits)
    probes = dealt.groupBy("bucket").applyInArrow(lambda t: p.probe(t), "part int, bucket long, keys binary, grid binary, twice binary")
    told = probes.groupBy("part").applyInArrow(lambda t: p.match(t), "bucket long, part int, keys binary")
    full = dealt.groupBy("bucket").cogroup(told.groupBy("bucket")).applyInArrow(lambda d, t: p.extend(d, t), "part int, bucket long, first binary, second binary, twice binary")
    repeated = full.groupBy("part").applyInArrow(lambda t: p.count(t), "bucket long, first binary, second binary")
    return dealt.groupBy("bucket").cogroup(repeated.groupBy("bucket")).applyInArrow(lambda d, t: p.strip(d, t), f"id {dict(source.dtypes)['id']}, n_words long, n_removed long, kept_text string, spans array<struct<from:long,to:long>>")
