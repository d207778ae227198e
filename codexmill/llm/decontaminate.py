"""Benchmark decontamination: CGK walks, bit-sampling LSH over windows, exact edit distance.

Texts are words (letters and digits, lower case; scripts written without spaces count each
character). A CGK walk (Chakraborty, Goldenberg & Koucky, 2016) reads a window word by word
and moves on or stays by a random bit of (step, word): two windows that differ by few edits
soon walk in step again, so their edit distance becomes a Hamming distance between the
words that they read. Each of REPEATS walks samples GROUPS sets of SAMPLE of its STEPS steps, and the
words read there are a key. Items give their keys, from every offset, to one table; the window
that starts at each word of a text looks its keys up. Steps are taken from the start of the
walk, which windows of all item sizes share, so one pass serves every length of item.

A key places an item in the text. What a span within the edits can reach around that place
is kept if it holds enough of the item's words, and confirmed by the exact edit distance. A
phrase that many items share is met only for items of which the text also holds a rare word. An item
of n words has some n windows, each with REPEATS * GROUPS keys, and one key that agrees is
enough. Items under MIN_WORDS words are looked for as they are.
"""

from __future__ import annotations

import functools
import itertools
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import arrow_rows
from .textbytes import U, grams, mix, words

#: Word edits allowed, as a share of an item's words; shortest item that may have any.
RATE, MIN_WORDS = 0.2, 6
#: Walks, their steps, sets of sampled steps a walk and steps in a set.
REPEATS, STEPS, GROUPS, SAMPLE = 12, 8, 2, 3
#: A key reads so many different words at least, of items under FEW_WORDS words one fewer.
DISTINCT, FEW_WORDS = 3, 12
#: Words of items that a task holds at a time (24 keys a word); larger benchmarks are passed over in blocks.
BLOCK_WORDS = 200_000
#: Words of a text that are walked together.
WALK_WORDS = 1 << 14
_WORD = np.ones(256, bool)
_WORD[[i for i in range(128) if chr(i).isalnum()] + list(range(128, 256))] = False


#: What a character beyond ASCII does: part of a word, parts words, a word alone, goes with the one before, left out.
PART, APART, ALONE, MARK, NOTHING = range(5)
#: Scripts written without spaces: Thai, Lao, Myanmar, Khmer, Tai and Javanese, kana and bopomofo, Han.
UNSPACED = [(0x0E00, 0x0EFF), (0x1000, 0x109F), (0x1780, 0x17FF), (0x1950, 0x19DF), (0x1A20, 0x1AAF), (0x1B00, 0x1B7F), (0x2E80, 0x2FDF), (0x3005, 0x3007), (0x3021, 0x3029), (0x3031, 0x312F), (0x31A0, 0x31FF), (0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xA980, 0xA9FF), (0xAA60, 0xAADF), (0xF900, 0xFAFF), (0xFF66, 0xFF9F), (0x1AFF0, 0x1B16F), (0x20000, 0x323AF)]


@functools.cache
def _kinds() -> np.ndarray:
    kinds = np.zeros(0x110000, np.uint8)
    for lo, hi in UNSPACED:
        kinds[lo : hi + 1] = ALONE
    for c in itertools.chain(range(128, 0x323B0), range(0xE0000, 0xE0200)):
        category = unicodedata.category(chr(c))
        if category[0] in "PSZ" or category == "Cc" or c == 0x200B:
            kinds[c] = APART
        elif category[0] == "M":
            kinds[c] = MARK
        elif category == "Cf":
            kinds[c] = NOTHING
    return kinds


def _spaced(text: str) -> str:
    """The text with spaces for punctuation beyond ASCII and around characters of unspaced scripts."""
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    kind = _kinds()[c]
    if not kind.any():
        return text
    c, kind = np.where(kind == APART, np.uint32(32), c)[kind != NOTHING], kind[kind != NOTHING]
    if (kind == ALONE).any():
        base = kind[np.maximum.accumulate(np.where(kind == MARK, 0, np.arange(len(kind))))]
        after = np.concatenate([[False], base[:-1] == ALONE])
        c = np.insert(c, np.flatnonzero((kind == ALONE) | (kind == PART) & after), 32)
    return c.tobytes().decode("utf-32-le", "surrogatepass")


def word_hashes(text: str | None) -> np.ndarray:
    text = (text or "").lower()
    if not text.isascii():
        text = _spaced(text)
    return words(np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8), separators=_WORD)[0]


def edits(item: np.ndarray, span: np.ndarray) -> tuple[int, int, int]:
    """(distance, from, to): the edit distance of item to its nearest part of span."""
    m = len(span)
    row, start = np.zeros(m + 1, np.int64), np.arange(m + 1)
    for i, w in enumerate(item, 1):
        up, diag = row + 1, row[:-1] + (span != w)
        new, begin = np.empty(m + 1, np.int64), np.empty(m + 1, np.int64)
        new[0], begin[0] = i, 0
        better = diag <= up[1:]
        new[1:] = np.where(better, diag, up[1:])
        begin[1:] = np.where(better, start[:-1], start[1:])
        # insertions along the row: new[j] = min over l <= j of new[l] + j - l
        shifted = new - np.arange(m + 1)
        low = np.minimum.accumulate(shifted)
        source = np.maximum.accumulate(np.where(shifted == low, np.arange(m + 1), 0))
        row, start = low + np.arange(m + 1), begin[source]
    end = int(row.argmin())
    return int(row[end]), int(start[end]), end


def _spans(start: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All places start .. start + count - 1 in a row, and which span each is of."""
    return np.repeat(start - np.cumsum(count) + count, count) + np.arange(count.sum()), np.repeat(np.arange(len(count)), count)


class Walks:
    """The random walks and their sampled steps, the same in every worker."""

    def __init__(self, seed: int = 23):
        rng = np.random.Generator(np.random.PCG64(seed))
        self.seeds = rng.integers(1, 2**63, REPEATS, dtype=U)
        self.steps = [[np.sort(rng.choice(STEPS, SAMPLE, replace=False)) for _ in range(GROUPS)] for _ in range(REPEATS)]
        self.mult = rng.integers(0, 2**63, SAMPLE, dtype=U) * U(2) + U(1)
        self.salt = rng.integers(0, 2**63, (REPEATS, GROUPS), dtype=U)

    def keys(self, h: np.ndarray, count: int) -> Iterator[tuple[np.ndarray, list[np.ndarray]]]:
        """Per walk and set of steps: the keys of the windows at words 0 .. count - 1 of h and
        which words they read. h goes on for STEPS words after the last window's first."""
        scaled = [h * m for m in self.mult]
        for seed, sets, salts in zip(self.seeds, self.steps, self.salt, strict=True):
            bits = mix(h ^ seed)
            at, read = np.arange(count), []
            for step in range(STEPS):
                read.append(at)
                at = at + ((bits[at] >> U(step)) & U(1)).astype(np.int64)
            for steps, salt in zip(sets, salts, strict=True):
                key = np.full(count, salt, U)
                for part, step in zip(scaled, steps, strict=True):
                    key += part[read[step]]
                yield key, [read[step] for step in steps]


class Benchmark:
    """Items as word hashes and the table of their windows' keys."""

    def __init__(self, items: list[tuple[object, str | None]], rate: float = RATE):
        rows = [(i, h) for i, t in items if len(h := word_hashes(t))]
        self.ids, self.words = [i for i, _ in rows], [h for _, h in rows]
        self.sizes = np.array([len(h) for h in self.words], np.int64)
        self.most = np.where(self.sizes < MIN_WORDS, 0, (rate * self.sizes + 1e-9).astype(np.int64))
        self.sets = [np.unique(h) for h in self.words]
        self.walks = Walks()
        keys, item, at = [np.zeros(0, U)], [np.zeros(0, np.int32)], [np.zeros(0, np.int32)]
        for i, h in enumerate(self.words):
            n = len(h)
            if n < MIN_WORDS:
                continue
            padded, least = np.concatenate([h, np.zeros(STEPS, U)]), min(DISTINCT - (n < FEW_WORDS), len(self.sets[i]))
            for key, read in self.walks.keys(padded, n):
                distinct = 1 + sum((padded[y] != padded[x]).astype(np.int64) for x, y in zip(read, read[1:], strict=False))
                good = np.flatnonzero((read[-1] < n) & (distinct >= least))
                keys.append(key[good])
                item.append(np.full(len(good), i, np.int32))
                at.append(good.astype(np.int32))
        self.table = self._table(np.concatenate(keys), np.concatenate(item), np.concatenate(at))
        #: by the key's first entry and the item, in the table's order
        self.codes = np.searchsorted(self.table[0], self.table[0], "left") * max(1, len(self.sizes)) + self.table[1]
        self.rare = self._rare()
        #: the whole word sequences of items that may not be edited, by length
        self.exact = []
        for n in np.unique(self.sizes[self.sizes < MIN_WORDS]).tolist():
            of = np.flatnonzero(self.sizes == n)
            self.exact.append((n, self._table(np.concatenate([grams(self.words[i], n) for i in of]), of.astype(np.int32), np.zeros(len(of), np.int32))))

    def _rare(self) -> tuple:
        """Words of which a span within the edits holds one, and their items.

        At most ``most`` words of an item can be missing, so one of any most + 1 is there; those
        that the fewest items hold are taken. Items with one stem differ in them.
        """
        used, held = np.unique(np.concatenate([np.zeros(0, U), *self.sets]), return_counts=True)
        word, item = [np.zeros(0, U)], [np.zeros(0, np.int32)]
        for i, h in enumerate(self.words):
            if len(h) < MIN_WORDS:
                continue
            least = np.argsort(held[np.searchsorted(used, h)], kind="stable")[: self.most[i] + 1]
            word.append(np.unique(h[least]))
            item.append(np.full(len(word[-1]), i, np.int32))
        item = np.concatenate(item)
        return self._table(np.concatenate(word), item, np.zeros(len(item), np.int32))

    def possible(self, h: np.ndarray, text_of: np.ndarray) -> np.ndarray:
        """Sorted text * items + item of the pairs whose text holds one of the item's rare words."""
        keys, item, _, known, shift = self.rare
        at = np.flatnonzero(known[(h >> shift).astype(np.int64)] & (text_of >= 0))
        lo, hi = np.searchsorted(keys, h[at], "left"), np.searchsorted(keys, h[at], "right")
        # a word counts once a text
        _, once = np.unique(text_of[at] * (len(keys) + 1) + lo, return_index=True)
        k, of = _spans(lo[once], (hi - lo)[once])
        return np.unique(text_of[at][once][of] * len(self.sizes) + item[k])

    def _meet(self, key: np.ndarray, agreed: np.ndarray, text_of: np.ndarray, pairs: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(window, item, offset in the item) of keys that the table holds, for possible pairs alone.

        A key's items meet a text's pairs from whichever side has fewer of them.
        """
        keys, item, at, known, shift = self.table
        window = np.flatnonzero(known[(key >> shift).astype(np.int64)])
        lo, hi = np.searchsorted(keys, key[window], "left"), np.searchsorted(keys, key[window], "right")
        text = text_of[np.minimum(agreed[window], len(text_of) - 1)]
        hit = (hi > lo) & (text >= 0)
        window, lo, count, text = window[hit], lo[hit], (hi - lo)[hit], text[hit]
        start, others = ends[text], ends[text + 1] - ends[text]
        few, size = count <= others, len(self.sizes)
        k, of = _spans(lo[few], count[few])
        wanted = text[few][of] * size + item[k]
        ok = pairs[np.minimum(np.searchsorted(pairs, wanted), max(0, len(pairs) - 1))] == wanted if len(pairs) else np.zeros(len(wanted), bool)
        j, by = _spans(start[~few], others[~few])
        code = lo[~few][by] * size + pairs[j] % size
        first, last = np.searchsorted(self.codes, code, "left"), np.searchsorted(self.codes, code, "right")
        m, back = _spans(first, last - first)
        found = np.concatenate([k[ok], m])
        return np.concatenate([window[few][of][ok], window[~few][by][back]]), item[found], at[found]

    @staticmethod
    def _table(key: np.ndarray, item: np.ndarray, at: np.ndarray) -> tuple:
        order = np.argsort(key, kind="stable")
        bits = min(26, max(12, (16 * len(key)).bit_length()))
        known = np.zeros(1 << bits, bool)
        known[(key >> U(64 - bits)).astype(np.int64)] = True
        return key[order], item[order], at[order], known, U(64 - bits)

    @staticmethod
    def _look(table: tuple, key: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(window, item, offset in the item) of all keys that the table holds."""
        keys, item, at, known, shift = table
        maybe = np.flatnonzero(known[(key >> shift).astype(np.int64)])
        if not len(maybe):
            return maybe, item[:0], at[:0]
        lo, hi = np.searchsorted(keys, key[maybe], "left"), np.searchsorted(keys, key[maybe], "right")
        k, of = _spans(lo, hi - lo)
        return maybe[of], item[k], at[k]

    def places(self, h: np.ndarray, text_of: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(item, word of h where the item would start, a word of h that agreed) of all keys found."""
        none = np.zeros(0, np.int64)
        found = [(none, none, none)]
        pairs = self.possible(h, text_of) if len(self.table[0]) else none
        ends = np.searchsorted(pairs, np.arange(text_of.max(initial=-1) + 2) * len(self.sizes))
        for a in range(0, len(h) if len(pairs) else 0, WALK_WORDS):
            count = min(WALK_WORDS, len(h) - a)
            part = h[a : a + count + STEPS]
            part = np.concatenate([part, np.zeros(count + STEPS - len(part), U)])
            for key, read in self.walks.keys(part, count):
                window, item, at = self._meet(key, a + read[0], text_of, pairs, ends)
                if len(window):
                    found.append((item, a + window - at, a + read[0][window]))
        for n, table in self.exact:
            window, item, _ = self._look(table, grams(h, n))
            found.append((item, window, window))
        return tuple(np.concatenate(x).astype(np.int64) for x in zip(*found, strict=True))

    def regions(self, h: np.ndarray, text_of: np.ndarray, ends: np.ndarray) -> list[tuple[int, int, int, int]]:
        """(text, item, from word, to word) of the parts of h that can hold a span within the
        edits; parts of one item that meet are one. ``text_of`` is the text of each word, ``ends`` where texts end."""
        item, start, agreed = self.places(h, text_of)
        if not len(item):
            return []
        text, n = text_of[agreed], self.sizes[item]
        # a walk that is out of step places the item up to its steps aside
        wide = np.where(n < MIN_WORDS, 0, self.most[item] + STEPS)
        a = np.maximum(np.where(text > 0, ends[text - 1] + STEPS, 0), start - wide)
        e = np.minimum(ends[text], start + n + wide)
        order = np.lexsort((a, item, text))
        text, item, a, e = text[order], item[order], a[order], e[order]
        top = np.maximum.accumulate(e + (text * len(self.sizes) + item) * (len(h) + 1))  # ends so far of this text and item
        new = a[1:] + (text[1:] * len(self.sizes) + item[1:]) * (len(h) + 1) > top[:-1]
        first = np.flatnonzero(np.concatenate([[True], new | (text[1:] != text[:-1]) | (item[1:] != item[:-1])]))
        return list(zip(text[first].tolist(), item[first].tolist(), a[first].tolist(), np.maximum.reduceat(e, first).tolist(), strict=True))

    def find(self, texts: list[str | None]) -> list[tuple[int, int, int, int, int, int]]:
        """(text, item id, distance, from word, to word, item words) of all leaks; the nearest each."""
        hashes, gap = [word_hashes(t) for t in texts], np.zeros(STEPS, U)
        h = np.concatenate([x for one in hashes for x in (one, gap)] or [gap])
        sizes = np.array([len(x) for x in hashes], np.int64)
        text_of = np.repeat(np.tile([0, -1], len(hashes)), np.stack([sizes, np.full(len(sizes), STEPS)], 1).ravel())
        text_of[text_of == 0] = np.repeat(np.arange(len(hashes)), sizes)
        ends = np.cumsum(sizes + STEPS) - STEPS
        best: dict[tuple[int, int], tuple[int, int, int]] = {}
        for t, i, a, e in self.regions(h, text_of, ends):
            key, most = (t, i), int(self.most[i])
            if key in best and best[key][0] == 0:
                continue
            part, known = h[a:e], self.sets[i]
            # a span within the edits holds all but ``most`` of the item's words
            at = np.minimum(np.searchsorted(known, part), len(known) - 1)
            if int((known[at] == part).sum()) < self.sizes[i] - most:
                continue
            d, start, end = edits(self.words[i], part)
            if d <= most and (key not in best or d < best[key][0]):
                base = a - int(ends[t] - sizes[t])
                best[key] = d, base + start, base + end
        return [(t, self.ids[i], *v, int(self.sizes[i])) for (t, i), v in sorted(best.items())]


@functools.lru_cache(maxsize=1)
def _benchmark(block: tuple[tuple[object, str | None], ...], rate: float) -> Benchmark:
    """The block's table, made once in a worker and kept for its next tasks."""
    return Benchmark(list(block), rate)


def _blocks(benchmark: DataFrame, item_col: str, text_col: str) -> Iterator[tuple[tuple[object, str | None], ...]]:
    """The items in bounded blocks; one block for any usual benchmark."""
    block: list[tuple[object, str | None]] = []
    held = 0
    for r in benchmark.select(item_col, text_col).distinct().orderBy(item_col).toLocalIterator():
        block.append((r[0], r[1]))
        held += len(word_hashes(r[1]))
        if held >= BLOCK_WORDS:
            yield tuple(block)
            block, held = [], 0
    if block:
        yield tuple(block)


def find_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", rate: float = RATE) -> DataFrame:
    """One row per document row and item that it contains: id, item_id, distance, first_word, last_word, item_words.

    A document contains an item of n words if some span of its words is within
    floor(rate * n) word edits of it, under 6 words none; the nearest is reported, word
    positions from 0 (last excluded). Words are letters and digits in lower case, so case,
    punctuation, symbols and line ends, of Unicode too, make no edits. In scripts written
    without spaces (Han, kana, Thai, Lao, Khmer, Myanmar) each character is a word.

    Null or wordless text and wordless items match nothing. Null ids stay null,
    repeated rows each get their rows. Items equal in id and text count once; equal texts
    under two ids both match. Item ids
    can be of any type. An empty table on either side gives an empty result. Other columns
    are not used. Confirming an item of n words takes memory in proportion to n.
    """
    arrow_rows(docs.sparkSession)
    kind, item_kind = dict(docs.dtypes)[id_col], dict(benchmark.dtypes)[item_col]
    item_type = to_arrow_type(benchmark.schema[item_col].dataType)
    out = None
    for block in _blocks(benchmark, item_col, item_text):

        def run(batches: Iterator[pa.RecordBatch], block=block) -> Iterator[pa.RecordBatch]:
            bench = _benchmark(block, rate)
            for b in batches:
                got = bench.find(b.column(text_col).to_pylist())
                ids = b.column(id_col).take(pa.array([g[0] for g in got], pa.int64()))
                yield pa.RecordBatch.from_arrays([ids, pa.array([g[1] for g in got], item_type), *(pa.array([g[k] for g in got], pa.int64()) for k in range(2, 6))], [id_col, "item_id", "distance", "first_word", "last_word", "item_words"])

        found = docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, item_id {item_kind}, distance long, first_word long, last_word long, item_words long")
        out = found if out is None else out.union(found)
    if out is None:
        return docs.limit(0).select(id_col, F.lit(None).cast(item_kind).alias("item_id"), *[F.lit(None).cast("long").alias(c) for c in ("distance", "first_word", "last_word", "item_words")])
    return out


def drop_leaks(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text: str = "text", rate: float = RATE) -> DataFrame:
    """The rows of ``docs``, all columns, that contain no item; one narrow pass a block.

    As ``find_leaks`` finds them: rows with null or wordless text stay, rows repeated stay or go
    together, and an empty benchmark drops nothing. Empty table: an empty result.
    """
    arrow_rows(docs.sparkSession)
    for block in _blocks(benchmark, item_col, item_text):

        def run(batches: Iterator[pa.RecordBatch], block=block) -> Iterator[pa.RecordBatch]:
            bench = _benchmark(block, rate)
            for b in batches:
                leaky = {g[0] for g in bench.find(b.column(text_col).to_pylist())}
                yield b.filter(pa.array([i not in leaky for i in range(b.num_rows)], pa.bool_()))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
