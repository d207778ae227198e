"""Quality rules: hashed n-gram logistic regression, calibrated, scored in Arrow batches.

Two heads learn from the labelled rows: low quality, from the frequency of character 2-
and 3-grams and the presence of words, and toxicity, from the presence of words and
character 5-grams. L1 shrinkage leaves few n-grams, so the sums that a long text gathers
by chance stay small, and n-grams of few rows are left out.
Platt scaling on rows held out of the fit turns sums into probabilities, and a document
passes if both stay below fixed thresholds. The base rules (too short, mostly repeated)
come first and need no model.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_rows, first_rows
from .textbytes import _LOWER, _PUNCT, _TABLE, U, grams, texts, words

#: Places of hashed n-grams: of frequencies, of words in either head, of 5-grams.
FREQ_BITS, WORD_BITS, CHAR_BITS = 15, 16, 17
LOW_SIZE, TOXIC_SIZE = (1 << FREQ_BITS) + (1 << WORD_BITS), (1 << WORD_BITS) + (1 << CHAR_BITS)
#: n-grams of fewer fitted rows say nothing.
LEAST_ROWS = 4
#: Labelled rows that are fitted on: at most so many of each (quality, toxic) pair.
SAMPLE = 800
#: Probabilities above which a document goes; on held-out labels about one clean document
#: in a thousand does, and one toxic one in three hundred stays.
LOW_QUALITY, TOXIC = 0.65, 0.6
MIN_WORDS, REPEAT_PERCENT = 50, 50
_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True


Row = tuple[np.ndarray, np.ndarray]


def _places(lut: np.ndarray, b: np.ndarray, n: int, bits: int) -> Iterator[np.ndarray]:
    for a in range(0, max(0, len(b) - n + 1), 1 << 20):  # blocks bound the memory for long texts
        yield (grams(lut[b[a : a + (1 << 20) + n - 1]], n) >> U(64 - bits)).astype(np.int64)


def features(b: np.ndarray) -> tuple[Row, Row]:
    """(places, values) for the low-quality and the toxicity head.

    Words are split at spaces and ASCII punctuation, A-Z lower-cased; 2- and 3-grams of
    bytes keep their case, which is part of the style.
    """
    w = np.unique(words(b, lower=True, separators=_PUNCT)[0] >> U(64 - WORD_BITS)).astype(np.int64)
    count = np.zeros(1 << FREQ_BITS, np.int64)
    for n in (2, 3):
        for at in _places(_TABLE, b, n, FREQ_BITS):
            count += np.bincount(at, minlength=len(count))
    freq = np.flatnonzero(count)
    seen = np.zeros(1 << CHAR_BITS, bool)
    for at in _places(_LOWER, b, 5, CHAR_BITS):
        seen[at] = True
    five = np.flatnonzero(seen)
    low = np.concatenate([freq, w + (1 << FREQ_BITS)]), np.concatenate([10 * np.sqrt(count[freq] / max(1, len(b))), np.full(len(w), 1 / np.sqrt(max(1, len(w))))])
    return low, (np.concatenate([w, five + (1 << WORD_BITS)]), np.ones(len(w) + len(five)))


def base(b: np.ndarray | None) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of a whole text."""
    if b is None or not len(b):
        return 0, 0, 0, 0, 0
    h, starts, ends = words(b)
    if not len(h):
        return 0, 0, int(_SYMBOL[b].sum()), 0, 0
    inside = np.zeros(len(b) + 1, np.int8)
    inside[starts] += 1
    inside[ends] -= 1
    chars = int((((b & 0xC0) != 0x80) & (np.cumsum(inside[:-1]) > 0)).sum())
    seen, dup = set(), 0
    for line in b.tobytes().split(b"\n"):
        if line in seen:
            dup += 1
        elif line and not line.isspace():
            seen.add(line)
    repeat = 0
    if len(h) >= 3:
        g = grams(h, 3)
        order = np.argsort(g, kind="stable")
        same = g[order][1:] == g[order][:-1]
        again = np.zeros(len(g), bool)
        again[order[1:][same]] = True
        again[order[:-1][same]] = True
        cover = np.zeros(len(h), bool)
        for k in range(3):
            cover[k : k + len(g)] |= again
        repeat = int(cover.sum())
    return len(h), chars, int(_SYMBOL[b].sum()), dup, repeat


@dataclass(frozen=True)
class Head:
    """Sparse weights with the intercept and the two numbers of Platt scaling."""

    weights: np.ndarray
    bias: float
    slope: float = 1.0
    offset: float = 0.0

    def margin(self, row: Row) -> float:
        return float(self.weights[row[0]] @ row[1] + self.bias)

    def probability(self, row: Row) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.slope * self.margin(row) + self.offset, -40, 40))))


#: Heads that have learned nothing: only the base rules decide.
NO_HEADS = (Head(np.zeros(LOW_SIZE), -20.0), Head(np.zeros(TOXIC_SIZE), -20.0))


def fit_head(rows: list[Row], y: np.ndarray, size: int, l1: float = 5e-4, steps: int = 120) -> Head:
    """L1 logistic regression by accelerated proximal gradient; classes weigh the same.

    Without rows of both classes there is nothing to learn and the head passes all.
    """
    y = np.asarray(y, float)
    if not len(y) or y.min() == y.max():
        return Head(np.zeros(size), -20.0)
    held = np.arange(len(y)) % 5 == 4
    if y[held].min(initial=1) == y[held].max(initial=0):
        held[:] = False
    train = np.flatnonzero(~held)
    place, value = (np.concatenate([rows[i][k] for i in train]).astype(kind) for k, kind in ((0, np.int32), (1, np.float32)))
    row = np.repeat(np.arange(len(train), dtype=np.int32), [len(rows[i][0]) for i in train])
    often = np.bincount(place, minlength=size) >= LEAST_ROWS
    used, at = np.flatnonzero(often), np.cumsum(often, dtype=np.int32) - 1
    keep = often[place]
    place, value, row = at[place[keep]], value[keep], row[keep]
    order = np.argsort(place, kind="stable")  # the same entries by n-gram, for the gradient
    row_of, value_of = row[order], value[order]
    grams_at = np.searchsorted(place[order], np.arange(len(used)))
    filled, rows_at = np.unique(row, return_index=True)
    del keep, at, order, row
    t = y[train]
    weight = np.where(t == 1, 0.5 / t.mean(), 0.5 / (1 - t.mean())) / len(t)
    theta, look, bias, look_b, k, step = np.zeros(len(used), np.float32), np.zeros(len(used), np.float32), 0.0, 0.0, 1.0, 0.5
    loss_of = lambda m: float((weight * np.logaddexp(0, np.where(t == 1, -m, m))).sum())

    def margin(th: np.ndarray, b: float) -> np.ndarray:
        out = np.full(len(t), b)
        if len(place):
            out[filled] += np.add.reduceat(value * th[place], rows_at)
        return out

    for _ in range(steps):
        m = margin(look, look_b)
        g = weight * (1 / (1 + np.exp(-np.clip(m, -40, 40))) - t)
        grad, grad_b, at = np.add.reduceat(value_of * g.astype(np.float32)[row_of], grams_at) if len(place) else look, g.sum(), loss_of(m)
        while True:
            new = look - step * grad
            new = np.sign(new) * np.maximum(0, np.abs(new) - step * l1)
            new_b = look_b - step * grad_b
            d, d_b = new - look, new_b - look_b
            if loss_of(margin(new, new_b)) <= at + grad @ d + grad_b * d_b + (d @ d + d_b * d_b) / (2 * step) + 1e-12 or step < 1e-6:
                break
            step /= 2
        k2 = (1 + np.sqrt(1 + 4 * k * k)) / 2
        look, look_b = new + (k - 1) / k2 * (new - theta), new_b + (k - 1) / k2 * (new_b - bias)
        theta, bias, k = new, new_b, k2
        step *= 1.3
    del place, value, row_of, value_of
    full = np.zeros(size)
    full[used] = theta
    head = Head(full, float(bias))
    rest = np.flatnonzero(held) if held.any() else train
    return Head(full, float(bias), *_platt(np.array([head.margin(rows[i]) for i in rest]), y[rest]))


def _platt(m: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset of p = sigmoid(slope * m + offset), by Newton steps."""
    up = (y.sum() + 1) / (y.sum() + 2)
    down = 1 / (len(y) - y.sum() + 2)
    goal, a, b = np.where(y == 1, up, down), 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * m + b, -40, 40)))
        r, v = p - goal, p * (1 - p) + 1e-9
        ga, gb, haa, hab, hbb = (r * m).sum(), r.sum(), (v * m * m).sum() + 1e-6, (v * m).sum(), v.sum() + 1e-6
        det = haa * hbb - hab * hab
        if abs(det) < 1e-12:
            break
        da, db = (hbb * ga - hab * gb) / det, (haa * gb - hab * ga) / det
        a, b = a - np.clip(da, -2, 2), b - np.clip(db, -2, 2)
    return float(max(a, 1e-3)), float(b)


def _featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        got = [features(b if b is not None else np.zeros(0, np.uint8)) for b in texts(batch.column("text"))]
        packed = ([x.astype(np.int32).tobytes() for x in (lo[0] for lo, _ in got)], [lo[1].astype(np.float32).tobytes() for lo, _ in got], [tx[0].astype(np.int32).tobytes() for _, tx in got])
        yield pa.RecordBatch.from_arrays([batch.column("low"), batch.column("toxic"), *(pa.array(x, pa.binary()) for x in packed)], ["low", "toxic", "place", "value", "seen"])


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE) -> tuple[Head, Head]:
    """The low-quality and the toxicity head, from at most ``sample`` rows of each pair of labels.

    Rows are taken in the order of a hash of their id, so the choice is even and stays.
    """
    known = labels.filter(F.col(id_col).isNotNull() & F.col("quality").isNotNull()).select(id_col, "quality", F.coalesce("toxic", F.lit(0)).alias("toxic")).distinct()
    chosen = first_rows(known, ["quality", "toxic"], [F.xxhash64(F.lit(5), id_col), id_col], sample, id_col)
    arrow_rows(docs.sparkSession)
    # at most 4 * sample ids, a fixed bound
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(chosen.select(F.col(id_col).alias("id"), (F.col("quality") == 0).cast("int").alias("low"), (F.col("toxic") != 0).cast("int").alias("toxic"))), "id")
    featured = rows.select("text", "low", "toxic").mapInArrow(_featured, "low int, toxic int, place binary, value binary, seen binary")
    # the bounded sample is fitted in one task, so the driver holds the weights alone
    made = {r["head"]: r for r in featured.repartition(1).mapInArrow(_fit, "head string, at binary, value binary, bias double, slope double, offset double").collect()}
    return _head(made, "low", LOW_SIZE), _head(made, "toxic", TOXIC_SIZE)


def _fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    cols: dict[str, list] = {c: [] for c in ("low", "toxic", "place", "value", "seen")}
    for b in batches:
        for c, v in cols.items():
            v += b.column(c).to_pylist()
    place, value, seen = cols["place"], cols["value"], cols["seen"]
    order = sorted(range(len(place)), key=lambda i: (len(place[i]), place[i], value[i]))
    ints = lambda x: np.frombuffer(x, np.int32)
    for name, size in (("low", LOW_SIZE), ("toxic", TOXIC_SIZE)):
        if name == "low":
            rows = [(ints(place[i]), np.frombuffer(value[i], np.float32)) for i in order]
        else:
            rows = [(x := ints(seen[i]), np.ones(len(x), np.float32)) for i in order]
        h = fit_head(rows, np.array([cols[name][i] for i in order], float), size)
        at = np.flatnonzero(h.weights)
        yield pa.RecordBatch.from_pylist([{"head": name, "at": at.astype(np.int64).tobytes(), "value": h.weights[at].tobytes(), "bias": h.bias, "slope": h.slope, "offset": h.offset}])


def _head(made: dict, name: str, size: int) -> Head:
    weights, r = np.zeros(size), made.get(name)
    if r is None:
        return Head(weights, -20.0)
    weights[np.frombuffer(r["at"], np.int64)] = np.frombuffer(r["value"], np.float64)
    return Head(weights, r["bias"], r["slope"], r["offset"])


COLUMNS = {"n_words": pa.int64(), "word_chars": pa.int64(), "n_symbols": pa.int64(), "n_dup_lines": pa.int64(), "n_repeat_words": pa.int64(), "base_failed": pa.bool_(), "kept": pa.bool_(), "p_low": pa.float64(), "p_toxic": pa.float64()}
SCHEMA = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, p_low double, p_toxic double"


def score(docs: DataFrame, heads: tuple[Head, Head], id_col: str = "doc_id", text_col: str = "text", passing: bool = False) -> DataFrame:
    """The rule's figures and verdict for every row, or with ``passing`` the kept rows as they came.

    Words are runs of characters other than x20 and x09-x0D. base_failed: fewer than 50
    words, or over half of the words in 3-word windows that the text repeats. Null text:
    no words, so base_failed. Null ids stay null, repeated rows get equal figures, an empty
    table gives an empty result. Other columns pass only with ``passing``.
    """
    arrow_rows(docs.sparkSession)
    low, toxic = heads
    sparse = [(len(h.weights), np.flatnonzero(h.weights), h.weights[h.weights != 0], h.bias, h.slope, h.offset) for h in (low, toxic)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heads = []
        for size, at, value, *rest in sparse:
            dense = np.zeros(size)
            dense[at] = value
            heads.append(Head(dense, *rest))
        for batch in batches:
            out: list[list] = [[] for _ in COLUMNS]
            for b in texts(batch.column(text_col)):
                figures = base(b)
                failed = figures[0] < MIN_WORDS or 100 * figures[4] > REPEAT_PERCENT * figures[0]
                if failed and passing:  # its probabilities are not asked for
                    out[6].append(False)
                    continue
                p = [h.probability(row) for h, row in zip(heads, features(b if b is not None else np.zeros(0, np.uint8)), strict=True)]
                for col, v in zip(out, (*figures, failed, not failed and p[0] <= LOW_QUALITY and p[1] <= TOXIC, *p), strict=True):
                    col.append(v)
            if passing:
                yield batch.filter(pa.array(out[6], pa.bool_()))
            else:
                cols = [pa.array(v, t) for v, t in zip(out, COLUMNS.values(), strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(id_col), *cols], [id_col, *COLUMNS])

    if passing:
        return docs.mapInArrow(run, docs.schema)
    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {dict(docs.dtypes)[id_col]}, {SCHEMA}")
