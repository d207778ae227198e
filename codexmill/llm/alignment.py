"""Cross-tokenizer alignment as relations of tokens.

Neither tokenizer joins anything across a space between two words (``subwords``), so tokens of both
sides end there, and groups and links lie within a word. The different words of all documents are
therefore aligned once each and count wherever they stand; texts of tokenizers that can't be
parted are one word each.

Both tokenizers' tokens of these words are exploded into one relation (block, word, side, position,
id). A window over (word, side) adds their bytes up to the offset where each starts. Where
tokens of both sides start, tokens of both sides end: sorted by word and offset the two are
neighbours, so the equi-join on word and offset compares a row with the one before or after,
and needs no second shuffle. Every offset where any token starts opens a stretch that lies
in one token of each side, and two tokens that overlap share exactly one such stretch; the last
token of each side up to an offset is therefore a link, and no pairs within a group are tried. A
link that both its tokens begin opens a group, so a word's links, in order and with the sides
that each begins, also tell its tokens and groups.

Batches of documents keep their different words once and documents as places among these. Words are
dealt to parts by their hash: a part's different words are aligned, and the batches that hold them
get their links back, a row for each batch and part. A document is put together from its words'
groups and numbers in its batch. Pairs of ids are counted by document in each batch and then by
Spark; their table comes back to the batches as a broadcast if it is small, else by salted shuffles.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import subwords
from .common import SALTS, arrow_rows, cut, discard

#: Words (characters of texts that are not parted) of the documents that keep their different words together.
WORDS = 1 << 21
#: Different words that are exploded from one row.
BLOCK = 1 << 13
#: UTF-8 bytes of the texts for each part that words are dealt to, and parts at least.
PART_BYTES, PARTS = 4 << 20, 8
#: An id pair is one number: the A id times this, plus the B id.
WIDE = 1 << 24
#: Signs of a link: side A's or side B's token begins there. In bytes sent to a batch a word's first one has NEXT too.
BEGINS_A, BEGINS_B, NEXT = 1, 2, 4
#: Distinct id pairs, of 16 bytes each, that may be broadcast.
BROADCAST_PAIRS = 2_000_000
#: Ids of small vocabularies travel as 16 bits, less this.
SHORT = 1 << 15


def _packed(x: np.ndarray) -> bytes:
    """Numbers by their bytes, all lowest first, compressed: places and ids are most of what is kept and shuffled."""
    planes = np.ascontiguousarray(x.view(np.uint8).reshape(len(x), x.itemsize).T)
    return planes.nbytes.to_bytes(8, "little") + pa.compress(planes.tobytes(), "zstd", asbytes=True)


def _unpacked(data: bytes, kind: type) -> np.ndarray:
    size = int.from_bytes(data[:8], "little")
    planes = np.frombuffer(pa.decompress(data[8:], size, "zstd", asbytes=True), np.uint8)
    width = np.dtype(kind).itemsize
    return np.ascontiguousarray(planes.reshape(width, size // width).T).reshape(-1).view(kind)


def _strings(data: bytes, sizes: bytes) -> pa.Array:
    ends = np.concatenate([[0], np.cumsum(_unpacked(sizes, np.int32))]).astype(np.int32)
    return pa.StringArray.from_buffers(len(ends) - 1, pa.py_buffer(ends), pa.py_buffer(_unpacked(data, np.uint8)))


def _spans(starts: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The places of n values from each start on, in order."""
    return np.arange(n.sum()) + np.repeat(starts - (np.cumsum(n) - n), n)


def _sums(values: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Sums of each next n values."""
    upto = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
    ends = np.cumsum(n)
    return upto[ends] - upto[ends - n]


def _lists_of(words: list[list[str]]) -> pa.Array:
    return pa.array(words, pa.list_(pa.string()))


def _parted(texts: pa.Array) -> pa.Array:
    """The segments of each text, none of null or empty ones; where these part at all spaces they need not be Python's."""
    some = texts.to_pylist()
    odd = [i for i, x in enumerate(some) if not x or subwords.odd(x)]
    if not odd:
        return pc.split_pattern(texts, " ")
    own = _lists_of([subwords.segments(some[i]) if some[i] else [] for i in odd])
    if len(odd) == len(some):
        return own
    usual = np.setdiff1d(np.arange(len(some)), odd)
    back = np.argsort(np.concatenate([usual, odd]), kind="stable")
    return pa.concat_arrays([pc.split_pattern(texts.take(pa.array(usual)), " "), own]).take(pa.array(back))


def tokens(docs: DataFrame, a_file: str, b_file: str, id_col: str = "doc_id", text_col: str = "text", parts: int = 1) -> DataFrame:
    """(row, docs, words, parts, order, at) a batch of documents: its different words by part, how many each part
    has, the documents as (id, n), and their n words each as numbers ``at``, whose places among words are ``order``."""
    arrow_rows(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = subwords.byte_bpe(a_file, " ", True, subwords.CACHED // 4), subwords.piece_bpe(b_file, subwords.CACHED // 4)
        # a model with all bytes gives back what it gets; what a word adds can't make up for what another lacks
        parted = a.parted and b.parted and {bytes([i]) for i in range(256)} <= set(subwords.piece_bpe_tokens(b_file))

        def batch(first: int, keys: list[pa.Array], lists: list[pa.Array]) -> pa.RecordBatch:
            coded = pa.concat_arrays([x.flatten() for x in lists]).dictionary_encode()
            words, flat = coded.dictionary, coded.indices.to_numpy()
            words = words.take(alike := pc.array_sort_indices(words))  # alike words side by side take less room
            part = np.fromiter((zlib.crc32(w.encode()) % parts for w in words.to_pylist()), np.int64, len(words))
            place = np.argsort(part, kind="stable")
            words, had = words.take(pa.array(place)), alike.to_numpy()[place]
            n = np.concatenate([np.diff(x.offsets.to_numpy()) for x in lists]).astype(np.int32)
            often = np.argsort(-np.bincount(flat, minlength=len(words)), kind="stable")  # frequent words get small numbers
            number, order = np.empty(len(words), np.int32), np.empty(len(words), np.int32)
            number[often] = np.arange(len(words))
            order[number[had]] = np.arange(len(words))
            one = lambda x: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x)
            held = pa.StructArray.from_arrays([pa.concat_arrays(keys), pa.array(n)], ["id", "n"])
            sizes = pa.array(np.bincount(part, minlength=parts).astype(np.int32))
            columns = [pa.array([first], pa.int64()), one(held), one(words), one(sizes), pa.array([_packed(order)]), pa.array([_packed(number[flat])])]
            return pa.RecordBatch.from_arrays(columns, ["row", "docs", "words", "parts", "order", "at"])

        ids, lists, size, first = [], [], 0, 0
        for some in batches:
            if not some.num_rows:
                continue
            first = first if ids else some.column("row")[0].as_py()
            ids.append(some.column("id"))
            lists.append(_parted(some.column("text")) if parted else _lists_of([[x] if x else [] for x in some.column("text").to_pylist()]))
            # long words count for more, as a batch is one row
            size += max(len(lists[-1].values), lists[-1].values.nbytes >> (5 if parted else 0))
            if size >= WORDS:
                yield batch(first, ids, lists)
                ids, lists, size = [], [], 0
        if ids:
            yield batch(first, ids, lists)

    kind = dict(docs.dtypes)[id_col]
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"row long, docs array<struct<id:{kind},n:int>>, words array<string>, parts array<int>, order binary, at binary")


def asked(batches: DataFrame) -> DataFrame:
    """(part, row, words, sizes): the words of a batch in a part, as bytes and their lengths."""

    def run(some: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in some:
            for row, words, parts in zip(x.column("row"), x.column("words"), x.column("parts"), strict=True):
                words, n = words.values, parts.values.to_numpy()
                if not len(words):
                    continue
                ends = np.frombuffer(words.buffers()[1], np.int32)[words.offset : words.offset + len(words) + 1]
                data = np.frombuffer(words.buffers()[2], np.uint8)
                at, which = np.concatenate([[0], np.cumsum(n)]), np.flatnonzero(n)
                cols = [
                    [_packed(data[ends[at[p]] : ends[at[p + 1]]]) for p in which],
                    [_packed(np.diff(ends[at[p] : at[p + 1] + 1])) for p in which],
                ]
                yield pa.RecordBatch.from_arrays([pa.array(which, pa.int32()), pa.array([row.as_py()] * len(which), pa.int64()), *map(pa.array, cols)], ["part", "row", "words", "sizes"])

    return batches.select("row", "words", "parts").mapInArrow(run, "part int, row long, words binary, sizes binary")


def _every(asks: pa.Table) -> pa.Array:
    """The different words that are asked, in an order that does not hang on how they come."""
    words = pa.chunked_array([_strings(w.as_py(), n.as_py()) for w, n in zip(asks["words"], asks["sizes"], strict=True)], pa.string()).unique()
    return words.take(pc.array_sort_indices(words))


def coded(asks: DataFrame, a_file: str, b_file: str) -> DataFrame:
    """(part, first, words) for each BLOCK different words of a part, in order from ``first`` on: the two tokenizers'
    ids of each word, empty where their bytes differ from space + word, and the number of its bytes."""
    number = _number(a_file, b_file)

    def run(table: pa.Table) -> pa.Table:
        cached = subwords.CACHED // 4  # of two caches in a worker
        a, b = subwords.byte_bpe(a_file, " ", True, cached), subwords.piece_bpe(b_file, cached)
        bytes_a, bytes_b = _names(a_file, b_file)
        sizes_a, sizes_b = (np.array([len(x) for x in names]) for names in (bytes_a, bytes_b))
        every, out = _every(table), []
        for first in range(0, len(every), BLOCK):
            words, sides = every.slice(first, BLOCK).to_pylist(), []
            said = [(" " + w).encode() for w in words]
            ids = [(x.encode_words(words), names, sizes) for x, names, sizes in ((a, bytes_a, sizes_a), (b, bytes_b, sizes_b))]
            good = _given_back(ids, said)
            for (some, n), _, _ in ids:
                sides.append(_lists(some[np.repeat(good, n)], np.concatenate([[0], np.cumsum(np.where(good, n, 0))]), number))
            held = pa.StructArray.from_arrays([*sides, pa.array(list(map(len, said)), pa.int32())], ["a", "b", "size"])
            out.append(pa.Table.from_arrays([table["part"].slice(0, 1), pa.array([first], pa.int32()), pa.ListArray.from_arrays(pa.array([0, len(held)], pa.int32()), held)], ["part", "first", "words"]))
        return pa.concat_tables(out)

    return asks.groupBy("part").applyInArrow(run, f"part int, first int, words array<struct<a:array<{number}>,b:array<{number}>,size:int>>")


_KEPT: dict[tuple[str, str], tuple[list[bytes], list[bytes]]] = {}


def _names(a_file: str, b_file: str) -> tuple[list[bytes], list[bytes]]:
    """The bytes of both vocabularies' ids, read once a process."""
    if (a_file, b_file) not in _KEPT:
        _KEPT[a_file, b_file] = subwords.byte_bpe_tokens(a_file), subwords.piece_bpe_tokens(b_file)
    return _KEPT[a_file, b_file]


def _number(a_file: str, b_file: str) -> str:
    return "smallint" if max(map(len, _names(a_file, b_file))) <= 2 * SHORT else "int"


def _given_back(coded: list[tuple[tuple[np.ndarray, np.ndarray], list[bytes], np.ndarray]], said: list[bytes]) -> np.ndarray:
    """Of which words do both sides' tokens have the very bytes? Mostly of all, which one comparison tells."""
    good, sizes, every = np.ones(len(said), bool), np.fromiter(map(len, said), np.int64, len(said)), b"".join(said)
    for (ids, n), names, lengths in coded:
        held = np.bincount(np.repeat(np.arange(len(n)), n), lengths[ids], len(n)).astype(np.int64)
        if (held == sizes).all() and b"".join(map(names.__getitem__, ids.tolist())) == every:
            continue
        ends = np.concatenate([[0], np.cumsum(n)])
        good &= np.fromiter((b"".join(map(names.__getitem__, ids[ends[i] : ends[i + 1]].tolist())) == x for i, x in enumerate(said)), bool, len(said))
    return good


def _lists(ids: np.ndarray, ends: np.ndarray, number: str) -> pa.Array:
    """Lists of ids, as 16 bits less SHORT where they fit."""
    flat = (ids - SHORT).astype(np.int16) if number == "smallint" else ids.astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat))


def vocabulary(spark: SparkSession, a_file: str, b_file: str) -> DataFrame:
    """(side, token, bytes) of both vocabularies: as many rows as they have entries, so fit to be broadcast."""
    rows = [(side, i, len(x)) for side, names in enumerate(_names(a_file, b_file)) for i, x in enumerate(names)]
    return spark.createDataFrame(rows, "side int, token int, bytes int")


def marked(blocks: DataFrame, lengths: DataFrame, partitions: int) -> DataFrame:
    """(part, word, start, link): every stretch of every word with its pair of ids and which sides begin a token
    there; link is null where the other side's row tells it, or a word has none."""
    low = SHORT if "smallint" in dict(blocks.dtypes)["words"] else 0
    rows = blocks.repartition(partitions, "part").select("part", "first", F.posexplode("words").alias("at", "w"))
    sides = F.array(*[F.struct(F.lit(s).alias("side"), F.col(f"w.{x}").alias("ids")) for s, x in enumerate("ab")])
    rows = rows.select("part", (F.col("first") + F.col("at")).alias("word"), "w.size", F.explode(sides).alias("s"))
    rows = rows.select("part", "word", "size", "s.side", F.posexplode_outer("s.ids").alias("pos", "id"))
    rows = rows.withColumn("token", F.col("id").cast("int") + low).drop("id").join(F.broadcast(lengths), ["side", "token"], "left")
    # side B's tokens follow side A's, which have all the word's bytes
    before = Window.partitionBy("word", "part").orderBy("side", "pos").rowsBetween(Window.unboundedPreceding, -1)
    order = Window.partitionBy("word", "part").orderBy("start", "side")
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("start", F.coalesce(F.sum("bytes").over(before), F.lit(0)) - F.col("side") * F.col("size"))
    other = F.when(F.col("side") == 0, F.lead("start").over(order)).otherwise(F.lag("start").over(order))
    rows = rows.withColumn("cut", F.coalesce(other == F.col("start"), F.lit(False)) & F.col("token").isNotNull())
    a, b = (F.last(F.when(F.col("side") == s, F.col("token")), ignorenulls=True).over(upto) for s in (0, 1))
    rows = rows.withColumns({"_a": a, "_b": b})
    begins = F.when(F.col("cut"), BEGINS_A + BEGINS_B).when(F.col("side") == 0, BEGINS_A).otherwise(BEGINS_B)
    # of two tokens that start together the second row, side B's, knows both
    pair = (begins.cast("long") * WIDE + F.col("_a")) * WIDE + F.col("_b")
    return rows.select("part", "word", "start", F.when((F.col("side") == 1) | ~F.col("cut"), pair).alias("link"))


def gathered(rows: DataFrame) -> DataFrame:
    """(part, word, links): the links of each word in order."""
    held = F.when(F.col("link").isNotNull(), F.struct("start", "link"))
    links = F.transform(F.sort_array(F.collect_list(held)), lambda x: x["link"])
    return rows.groupBy("word", "part").agg(links.alias("links")).select("part", "word", "links")


def answered(asks: DataFrame, aligned: DataFrame, small: bool) -> DataFrame:
    """(row, part, a, b, begins): to each batch the A and B ids of its words in a part, and the signs of their links,
    the first of a word with NEXT; a word that a tokenizer does not give back has NEXT alone."""
    kind = np.uint16 if small else np.int32

    def run(asks: pa.Table, aligned: pa.Table) -> pa.Table:
        names, place = _every(asks), np.argsort(aligned["word"].to_numpy())
        size = pc.list_value_length(aligned["links"]).to_numpy().astype(np.int64)
        first, links = (np.cumsum(size) - size)[place], pc.list_flatten(aligned["links"]).to_numpy()
        size, out = size[place], []
        for words, sizes in zip(asks["words"], asks["sizes"], strict=True):
            at = pc.index_in(_strings(words.as_py(), sizes.as_py()), value_set=names).to_numpy()
            n = size[at]
            held = links[_spans(first[at], n)]
            begins = np.zeros(np.maximum(n, 1).sum(), np.uint8)
            starts = np.cumsum(np.maximum(n, 1)) - np.maximum(n, 1)
            begins[_spans(starts, n)] = held // (WIDE * WIDE)
            sides = held // WIDE % WIDE, held % WIDE
            out.append([_packed(x[held // (WIDE * WIDE) & s != 0].astype(kind)) for x, s in zip(sides, (BEGINS_A, BEGINS_B), strict=True)])
            begins[starts] |= NEXT
            out[-1].append(_packed(begins))
        return pa.Table.from_arrays([asks["row"], asks["part"], *(pa.array([x[i] for x in out], pa.binary()) for i in range(3))], ["row", "part", "a", "b", "begins"])

    return asks.groupBy("part").cogroup(aligned.groupBy("part")).applyInArrow(run, "row long, part int, a binary, b binary, begins binary")


def _texts(a: np.ndarray, b: np.ndarray, begins: np.ndarray, word: np.ndarray, words: int) -> pa.Array:
    """Each word's groups as text; side A's first token in a group follows ``;``, side B's ``|``, all others a comma."""
    both = begins & (BEGINS_A | BEGINS_B)
    group = np.cumsum(both == BEGINS_A | BEGINS_B) - 1
    on_a, on_b = both & BEGINS_A != 0, both & BEGINS_B != 0
    of_a, of_b = group[on_a], group[on_b]
    n = group[-1] + 1 if len(group) else 0
    upto_a, upto_b = np.cumsum(np.bincount(of_a, minlength=n)), np.cumsum(np.bincount(of_b, minlength=n))
    kinds = [np.full(len(a), 0), np.full(len(b), 0)]
    kinds[0][both[on_a] == BEGINS_A | BEGINS_B], kinds[1][both[on_b] == BEGINS_A | BEGINS_B] = 1, 2
    top = int(max(a.max(initial=0), b.max(initial=0))) + 1
    said = pa.array([f"{sign}{i}" for sign in ",;|" for i in range(top)], pa.large_string())
    each, holder = np.empty(len(a) + len(b), np.int64), np.empty(len(a) + len(b), np.int64)
    for ids, kind, at, held in (
        (a, kinds[0], np.arange(len(a)) + np.concatenate([[0], upto_b])[of_a], word[on_a]),
        (b, kinds[1], np.arange(len(b)) + upto_a[of_b], word[on_b]),
    ):
        each[at], holder[at] = ids + kind * top, held
    taken = said.take(pa.array(each))
    ends = np.concatenate([[0], np.cumsum(np.bincount(holder, minlength=words))]).astype(np.int64)
    offsets = np.frombuffer(taken.buffers()[1], np.int64)[ends] if len(each) else np.zeros(words + 1, np.int64)
    return pa.LargeStringArray.from_buffers(words, pa.py_buffer(offsets), taken.buffers()[2])


_COUNTS = ("n_a", "n_b", "n_groups", "n_links")


def documents(batches: DataFrame, answers: DataFrame, digest: bool, small: bool) -> DataFrame:
    """(row, docs, pairs, counts, at, codes, sizes) a batch: each document (id, n, the numbers of _COUNTS, groups) put together
    from its words; with a word that a tokenizer does not give back it has none. ``pairs`` are the batch's different
    links, ``counts`` in how many of its documents, ``codes`` the links of each word (``sizes`` many) as places of these."""
    kind, ids = np.uint16 if small else np.int32, dict(batches.select(F.col("docs")[0]["id"].alias("id")).dtypes)["id"]

    def run(answers: pa.Table, batch: pa.Table) -> pa.Table:
        parts = answers.sort_by("part")
        joined = lambda name, kind: np.concatenate([np.zeros(0, kind), *(_unpacked(x.as_py(), kind) for x in parts[name])])
        a, b, begins = joined("a", kind).astype(np.int64), joined("b", kind).astype(np.int64), joined("begins", np.uint8)
        order, at = (_unpacked(batch[x][0].as_py(), np.int32) for x in ("order", "at"))
        docs = batch["docs"].combine_chunks()[0].values
        n = docs.field("n").to_numpy().astype(np.int64)
        word = np.cumsum(begins & NEXT != 0) - 1
        on_a, on_b = begins & BEGINS_A != 0, begins & BEGINS_B != 0
        known = dict(zip(_COUNTS, (np.bincount(word[x], minlength=len(order))[order] for x in (on_a, on_b, on_a & on_b, on_a | on_b)), strict=True))
        texts = _texts(a, b, begins, word, len(order)).take(pa.array(order))
        real = on_a | on_b
        pairs, code = np.unique(a[np.cumsum(on_a)[real] - 1] * WIDE + b[np.cumsum(on_b)[real] - 1], return_inverse=True)
        # words of documents that stay, and links of words, in the order of numbers
        size = np.bincount(word[real], minlength=len(order))
        code = code[_spans((np.cumsum(size) - size)[order], size[order])].astype(np.int32)
        size = size[order]
        bad = _sums(known["n_links"][at] == 0, n) > 0
        at, n = at[~np.repeat(bad, n)], np.where(bad, 0, n)
        first, counts, place, groups = np.cumsum(size) - size, np.zeros(len(pairs), np.int32), np.zeros(max(len(pairs), len(order)), np.int64), []
        for end, m in zip(np.cumsum(n).tolist(), n.tolist(), strict=True):
            if not m:
                groups.append("")
                continue
            here = at[end - m : end]
            text = texts.take(pa.array(here))
            ends = np.frombuffer(text.buffers()[1], np.int64)
            text = memoryview(text.buffers()[2])[ends[0] + 1 : ends[m]]
            groups.append(hashlib.sha256(text).hexdigest() if digest else bytes(text).decode())
            here = _different(here, place)
            counts[_different(code[_spans(first[here], size[here])], place)] += 1
        one = lambda x: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x)
        held = pa.StructArray.from_arrays([docs.field("id"), pa.array(n.astype(np.int32)), *(pa.array(_sums(known[c][at], n)) for c in _COUNTS), pa.array(groups, pa.string())], ["id", "n", *_COUNTS, "groups"])
        columns = [pa.array([batch["row"][0].as_py()], pa.int64()), one(held), one(pa.array(pairs, pa.int64())), one(pa.array(counts)), *(pa.array([_packed(x.astype(np.int32))]) for x in (at, code, size))]
        return pa.Table.from_arrays(columns, ["row", "docs", "pairs", "counts", "at", "codes", "sizes"])

    numbers = ",".join(f"{c}:long" for c in _COUNTS)
    both = answers.groupBy("row").cogroup(batches.select("row", "docs", "order", "at").groupBy("row"))
    return both.applyInArrow(run, f"row long, docs array<struct<id:{ids},n:int,{numbers},groups:string>>, pairs array<long>, counts array<int>, at binary, codes binary, sizes binary")


def _different(numbers: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Each number once: of equal ones that whose place was noted last."""
    mine = np.arange(len(numbers))
    place[numbers] = mine
    return numbers[place[numbers] == mine]


def pair_counts(held: DataFrame) -> DataFrame:
    """(link, docs, best): in how many documents each pair is linked, and whether that is its A id's highest."""
    each = held.select(F.explode(F.arrays_zip("pairs", "counts")).alias("x")).filter("x.counts > 0")
    counts = each.groupBy(F.col("x.pairs").alias("link")).agg(F.sum("x.counts").alias("docs"))
    counts = counts.withColumn("_a", F.expr(f"link div {WIDE}"))
    best = counts.groupBy("_a").agg(F.max("docs").alias("_most"))  # a row per A id
    return counts.join(best, "_a").select("link", "docs", (F.col("docs") == F.col("_most")).alias("best"))


def valued(held: DataFrame, worth: Callable[[pa.RecordBatch, int], tuple[np.ndarray, np.ndarray]], id_col: str) -> DataFrame:
    """The documents of each batch, where ``worth`` gives (docs, best) of its pairs."""
    kind = dict(held.select(F.col("docs")[0]["id"].alias("id")).dtypes)["id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            for i in range(x.num_rows):
                docs = x.column("docs")[i].values
                at, code, size = (_unpacked(x.column(c)[i].as_py(), np.int32) for c in ("at", "codes", "sizes"))
                n = docs.field("n").to_numpy().astype(np.int64)
                count, best = (pa.array(_sums(_sums(v[code], size)[at], n)) for v in worth(x, i))
                yield pa.RecordBatch.from_arrays([docs.field("id"), *map(docs.field, _COUNTS), best, count, docs.field("groups")], [id_col, *_COUNTS, "n_best", "count_sum", "groups"])

    return held.mapInArrow(run, f"`{id_col}` {kind}, {', '.join(f'{c} long' for c in _COUNTS)}, n_best long, count_sum long, groups string")


def align(docs: DataFrame, a_file: str | None = None, b_file: str | None = None, id_col: str = "doc_id", text_col: str = "text", limit: int = BROADCAST_PAIRS, digest: bool = False) -> DataFrame:
    """(id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups) of every row.

    ``groups`` is ``a1,a2|b1;a3|b2,b3``: the A and B ids between offsets where tokens of both end;
    with ``digest`` it is that text's SHA-256 (an empty one stays empty), and the text is not kept.
    A link is an A and a B token that overlap; n_best counts the links whose id pair is linked in as
    many documents as any pair of its A id, count_sum adds up those numbers. Rows with null or empty
    text, or one whose bytes a tokenizer does not give back, have zeros and an empty text. Each row
    is a document of its own, so repeated rows and ids all count; null ids stay null, an empty table
    gives an empty result, other columns are not used. Texts may be of any length that one row can
    hold: a batch (a document at least) is one row, and so is a word.
    """
    spark = docs.sparkSession
    a_file, b_file = a_file or subwords.path(subwords.BYTE_BPE), b_file or subwords.path(subwords.PIECE_BPE)
    size = docs.agg(F.sum(F.octet_length(text_col)).alias("n")).first()["n"] or 0
    if max(map(len, _names(a_file, b_file))) > WIDE:
        raise ValueError(f"a vocabulary has more than {WIDE} entries")
    parts = max(PARTS, -(-size // PART_BYTES))
    partitions, small = max(int(spark.conf.get("spark.sql.shuffle.partitions")), parts), _number(a_file, b_file) == "smallint"
    batches = cut(tokens(docs, a_file, b_file, id_col, text_col, parts), "zstd")
    asks = asked(batches).repartition(partitions, "part")
    aligned = gathered(marked(coded(asks, a_file, b_file), vocabulary(spark, a_file, b_file), partitions))
    # tokens are sorted by word already, so links are gathered in that order and none is held in a hash table
    hashed = "spark.sql.execution.useObjectHashAggregateExec"
    usual = spark.conf.get(hashed)
    spark.conf.set(hashed, "false")
    try:
        kept = cut(documents(batches, answered(asks, aligned, small), digest, small), "zstd")
    finally:
        spark.conf.set(hashed, usual)
    discard(batches)
    counts = cut(pair_counts(kept))
    if counts.count() <= limit:
        some = counts.toArrow().sort_by("link")
        every = spark.sparkContext.broadcast(tuple(some[c].to_numpy() for c in ("link", "docs", "best")))

        def found(x: pa.RecordBatch, i: int) -> tuple[np.ndarray, np.ndarray]:
            link, number, best = every.value
            pairs = x.column("pairs")[i].values.to_numpy()
            # a pair of left out documents alone is in none
            at = np.minimum(np.searchsorted(link, pairs), max(len(link) - 1, 0))
            is_there = link[at] == pairs if len(link) else np.zeros(len(pairs), bool)
            return (np.where(is_there, number[at], 0), is_there & best[at]) if len(link) else (np.zeros(len(pairs), np.int64), is_there)

        return valued(kept, found, id_col)
    # a pair that every batch has is joined in SALTS parts
    each = kept.select("row", F.posexplode("pairs").alias("at", "link")).withColumn("_salt", F.pmod(F.xxhash64("row"), F.lit(SALTS)))
    wide = counts.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    each = each.join(wide, ["link", "_salt"], "left").select("row", F.struct("at", F.coalesce("docs", F.lit(0)).alias("docs"), F.coalesce("best", F.lit(False)).alias("best")).alias("x"))
    worth = each.groupBy("row").agg(F.sort_array(F.collect_list("x")).alias("_worth"))
    both = kept.join(worth, "row", "left").withColumn("_worth", F.coalesce("_worth", F.array().cast(dict(worth.dtypes)["_worth"])))

    def joined(x: pa.RecordBatch, i: int) -> tuple[np.ndarray, np.ndarray]:
        held = x.column("_worth")[i].values
        return held.field("docs").to_numpy(), held.field("best").to_numpy(zero_copy_only=False)

    return valued(both, joined, id_col)
