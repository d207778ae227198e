r"""SentencePiece encoding and decoding; giant documents by a max-plus scan of chunks.

Encoding is a best path through a lattice whose nodes are pieces at places of the text.
For the byte-pair models used here the path is the one whose neighbouring pieces the
model would itself choose side by side: edges weigh 0 if it would and -inf if not, and
exactly one path has weight 0 (Berglund & van der Merwe, 2023). The same scan would take
piece scores as weights for a unigram model.

A giant text is cut into chunks. The state at a cut is the piece that covers the last
character before it, given by where that piece starts and ends. A chunk's transfer matrix
holds the best weight from each state at its start to each at its end. Matrices combine
associatively by max-plus products in a tree: first within groups of GROUP neighbouring
chunks, each group a task, then over the groups. On the way down the two states around a
stretch and the products of its halves fix the state in its middle, until every cut has
its one state, and each chunk is then backtraced on its own between its two states. Where no piece
of the vocabulary can cover a cut the state is unique and the matrix is 1 x 1.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_rows

DEFAULT_MODEL = "/opt/tokenizers/piece_bpe_32k.model"
#: Code points of a chunk; longer texts are giant.
CHUNK = 1 << 15
#: Chunks whose matrices meet in a task; two levels of as many serve any text that Spark can hold.
GROUP = 256
NEG = -np.inf
SPACE = "▁"


class Coder:
    """The model with and without its leading space, and what its pieces can cover."""

    def __init__(self, model: bytes):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2 as pb

        spec = pb.ModelProto()
        spec.ParseFromString(model)
        if spec.trainer_spec.model_type != pb.TrainerSpec.BPE:
            raise ValueError("a byte-pair model is needed")
        if spec.normalizer_spec.precompiled_charsmap or spec.normalizer_spec.remove_extra_whitespaces:
            raise ValueError("a model whose normaliser keeps all characters is needed")
        self.prefix = " " if spec.normalizer_spec.add_dummy_prefix else ""
        self.whole = sentencepiece.SentencePieceProcessor(model_proto=model)
        spec.normalizer_spec.add_dummy_prefix = False
        self.bare = sentencepiece.SentencePieceProcessor(model_proto=spec.SerializeToString())
        texts = [p.piece for p in spec.pieces if p.type in (1, 4)]
        self.pieces = {t.replace(SPACE, " ") for t in texts}
        self.longest = max(map(len, self.pieces), default=1)
        self.pairs = {t[i : i + 2] for t in self.pieces for i in range(len(t) - 1)}

    def encode(self, text: str) -> list[int]:
        """Ids of a stretch of text, with no leading space added."""
        return self.bare.encode(text, num_threads=1) if text else []

    def free(self, text: str, at: int) -> bool:
        """No piece can cover both sides of the cut before ``at``."""
        return at <= 0 or at >= len(text) or text[at - 1 : at + 1].replace(SPACE, " ") not in self.pairs

    def states(self, text: str, at: int) -> list[tuple[int, int]]:
        """(start, end) of the pieces that can cover the character before ``at``."""
        if self.free(text, at):
            return [(at, at)]
        found = {(at - 1, at)}
        for s in range(max(0, at - self.longest), at):
            for e in range(max(at, s + 1), min(len(text), s + self.longest) + 1):
                if text[s:e].replace(SPACE, " ") in self.pieces:
                    found.add((s, e))
        return sorted(found)

    def first_is(self, text: str, piece: str) -> bool:
        """Does the encoding of ``text`` start with this piece by itself?"""
        mine, all_ids = self.encode(piece), self.encode(text)
        return all_ids[: len(mine)] == mine

    def last_is(self, text: str, piece: str) -> bool:
        mine, all_ids = self.encode(piece), self.encode(text)
        return all_ids[-len(mine) :] == mine

    def matrix(self, text: str, start: int, end: int) -> tuple[list[tuple[int, int]], list[tuple[int, int]], np.ndarray]:
        """States at both cuts of text[start:end] and the weights between them.

        Where the stretch has a free cut, the matrix is the sum of a column for the part
        before the first and a row for the part after the last; else every pair of states
        is encoded.
        """
        p, q = self.states(text, start), self.states(text, end)
        reach = max(e for _, e in p)
        mid = next((i for i in range(reach, end) if self.free(text, i)), None)
        out = np.full((len(p), len(q)), NEG)
        if mid is not None:
            low = min(s for s, _ in q)
            back = next((i for i in range(min(low, end), mid - 1, -1) if self.free(text, i)), mid)
            left = [s == e or self.first_is(text[s:mid], text[s:e]) for s, e in p]
            right = [s == e or (s >= back and self.last_is(text[back:e], text[s:e])) for s, e in q]
            out[np.ix_(left, right)] = 0.0
            return p, q, out
        for i, (s, e) in enumerate(p):
            for j, (a, b) in enumerate(q):
                if (s, e) == (a, b):
                    out[i, j] = 0.0  # one piece covers the whole chunk
                elif a >= e and (s == e or self.first_is(text[s:b], text[s:e])) and (a == b or self.last_is(text[s:b], text[a:b])):
                    out[i, j] = 0.0
        return p, q, out

    def between(self, text: str, entry: tuple[int, int], leave: tuple[int, int]) -> list[int]:
        """Backtrace: the ids after the entry state's piece up to the leave state's."""
        s, e = entry
        if entry == leave and s != e:
            return []
        skip = len(self.encode(text[s:e])) if s != e else 0
        return self.encode(text[s : leave[1]])[skip:]


@lru_cache(maxsize=2)
def coder(model: bytes) -> Coder:
    return Coder(model)


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Max-plus product of two transfer matrices."""
    return (a[:, :, None] + b[None, :, :]).max(axis=1)


Matrix = tuple[list[tuple[int, int]], list[tuple[int, int]], np.ndarray]


def tree(chunks: list[Matrix]) -> list[list[Matrix]]:
    """Levels of a tree of products: the chunks, then products of neighbours, up to one of all."""
    levels = [chunks]
    while len(levels[-1]) > 1:
        low = levels[-1]
        levels.append([(x[0], y[1], product(x[2], y[2])) for x, y in zip(low[::2], low[1::2], strict=False)] + low[len(low) - len(low) % 2 :])
    return levels


def scan(chunks: list[Matrix], entry: tuple[int, int] | None = None, leave: tuple[int, int] | None = None) -> list[tuple[tuple[int, int], tuple[int, int]]]:
    """Entry and leave state of each chunk on the best path between the states at both ends.

    Without a state given for an end there must be one state only, as at the ends of a text.
    """
    levels = tree(chunks)
    top = levels[-1][0]
    ends = [(top[0][0] if entry is None else entry, top[1][0] if leave is None else leave)]
    if top[2][top[0].index(ends[0][0]), top[1].index(ends[0][1])] == NEG:
        raise ValueError("no path through the chunks")
    for low in reversed(levels[:-1]):
        below = []
        for k, (first, last) in enumerate(ends):
            if 2 * k + 1 == len(low):
                below.append((first, last))
                continue
            (p, mid, x), (_, q, y) = low[2 * k], low[2 * k + 1]
            at = mid[int((x[p.index(first)] + y[:, q.index(last)]).argmax())]
            below += [(first, at), (at, last)]
        ends = below
    return ends


def _int32(ids: list[int]) -> np.ndarray:
    return np.array(ids, np.int32)


def _rows(doc: pa.Array, k: pa.Array, made: list[Matrix]) -> pa.RecordBatch:
    """Matrices as rows; weights are 0 or -inf, so one bit each is enough."""
    flat = lambda states: [x for s in states for x in s]
    return pa.RecordBatch.from_arrays(
        [doc, k, *(pa.array([flat(m[i]) for m in made], pa.list_(pa.int64())) for i in (0, 1)), pa.array([(m[2] == 0).ravel().tolist() for m in made], pa.list_(pa.bool_()))],
        ["doc", "k", "p", "q", "ok"],
    )


def _matrices(table: pa.Table) -> tuple[list[int], list[Matrix]]:
    """Numbers and matrices of a table of neighbouring stretches, in order."""
    got = sorted(zip(*(table.column(x).to_pylist() for x in ("k", "p", "q", "ok")), strict=True))
    pair = lambda x: list(zip(x[::2], x[1::2], strict=True))
    return [g[0] for g in got], [(pair(p), pair(q), np.where(np.array(ok, bool).reshape(len(p) // 2, len(q) // 2), 0.0, NEG)) for _, p, q, ok in got]


def _states(table: pa.Table, numbers: list[int], chunks: list[Matrix], *at: tuple[int, int]) -> pa.Table:
    found = scan(chunks, *at)
    doc = table.column("doc")[0].as_py()
    return pa.table({"doc": [doc] * len(found), "k": pa.array(numbers, pa.int32()), **{n: pa.array([x[i][j] for x in found], pa.int64()) for n, i, j in (("ps", 0, 0), ("pe", 0, 1), ("qs", 1, 0), ("qe", 1, 1))}})


def _text(c: Coder, ids: list[int] | None) -> str | None:
    return None if ids is None else c.whole.decode(ids, num_threads=1) if ids else ""


def _halo(c: Coder) -> int:
    return 2 * c.longest + 2


def encode(docs: DataFrame, model: bytes, id_col: str = "doc_id", text_col: str = "text", chunk: int = CHUNK, decoded: str | None = None) -> DataFrame:
    """(id, n_chunks, n_tokens, tokens) for every row, ids as the model's library gives them.

    With ``decoded``, a column of that name has what the ids decode to, as ``decode`` would
    add it; texts of one chunk are decoded by the worker that encoded them.

    Null text: null tokens, n_tokens 0, no chunks. Empty text: no tokens. Texts over
    ``chunk`` code points are cut and scanned; chunks of one document run as separate rows
    and only its matrices and its ids come together. Null ids stay null; repeated rows
    each get their row. Empty table: empty result. Other columns are not used.
    """
    spark = docs.sparkSession
    arrow_rows(spark)
    kind = dict(docs.dtypes)[id_col]
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    out = f"id {kind}, n_chunks int, n_tokens long, tokens array<int>"

    def small(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = coder(model)
        for b in batches:
            ids = []
            for text in b.column("text"):
                t = text.as_py()
                # a text within one chunk: its only matrix is 1 x 1 and the backtrace is all
                ids.append(None if t is None else _int32(c.between(c.prefix + t, (0, 0), (len(c.prefix + t),) * 2) if t else []))
            cols = [b.column("id"), pa.array([0 if i is None else 1 for i in ids], pa.int32()), pa.array([0 if i is None else len(i) for i in ids], pa.int64()), pa.array(ids, pa.list_(pa.int32()))]
            if decoded:
                cols.append(pa.array([_text(c, None if i is None else i.tolist()) for i in ids], pa.string()))
            yield pa.RecordBatch.from_arrays(cols, ["id", "n_chunks", "n_tokens", "tokens", *(["decoded"] if decoded else [])])

    short = F.col("text").isNull() | (F.char_length("text") <= chunk)
    direct = rows.filter(short).mapInArrow(small, out + (", decoded string" if decoded else ""))
    halo, lead = _halo(coder(model)), coder(model).prefix
    giant = rows.filter(~short).withColumn("doc", F.concat_ws("/", F.sha2("text", 256), F.coalesce(F.col("id").cast("string"), F.lit("null"))))

    def slice_text(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                text = lead + b.column("text")[i].as_py()
                for k in range((len(text) - 1) // chunk + 1):
                    base = max(0, k * chunk - halo)
                    part = text[base : (k + 1) * chunk + halo]
                    yield pa.RecordBatch.from_arrays([b.column("doc").slice(i, 1), b.column("id").slice(i, 1), *(pa.array([x], t) for x, t in ((k, pa.int32()), (len(text), pa.int64()), (base, pa.int64()), (part, pa.string())))], ["doc", "id", "k", "size", "base", "part"])

    # every text is cut once; rows that repeat whole are counted and coded once
    lines = giant.mapInArrow(slice_text, f"doc string, id {kind}, k int, size long, base long, part string")
    lines = lines.groupBy("doc", "k").agg(*[F.first(c).alias(c) for c in ("id", "size", "base", "part")], F.count(F.lit(1)).alias("copies"))

    def transfer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = coder(model)
        for b in batches:
            made = []
            for k, total, base, part in zip(*(b.column(x).to_pylist() for x in ("k", "size", "base", "part")), strict=True):
                a, z = k * chunk, min(total, (k + 1) * chunk)
                p, q, m = c.matrix(part, a - base, z - base)
                made.append(([(x + base, y + base) for x, y in p], [(x + base, y + base) for x, y in q], m))
            yield _rows(b.column("doc"), b.column("k"), made)

    def combine(table: pa.Table) -> pa.Table:
        """The product of a group's matrices, as one row of the level above."""
        numbers, chunks = _matrices(table)
        return pa.Table.from_batches([_rows(table.column("doc")[:1].combine_chunks(), pa.array([numbers[0] // GROUP], pa.int32()), [tree(chunks)[-1][0]])])

    def ends(table: pa.Table) -> pa.Table:
        """The two states of each group of a document."""
        return _states(table, *_matrices(table))

    def within(table: pa.Table, outer: pa.Table) -> pa.Table:
        """The two states of each chunk of a group, from those of the group."""
        entry, leave = (tuple(outer.column(x)[0].as_py() for x in two) for two in (("ps", "pe"), ("qs", "qe")))
        return _states(table, *_matrices(table), entry, leave)

    def backtrace(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = coder(model)
        for b in batches:
            ids = []
            for base, part, *at in zip(*(b.column(x).to_pylist() for x in ("base", "part", "ps", "pe", "qs", "qe")), strict=True):
                ps, pe, qs, qe = (x - base for x in at)
                ids.append(_int32(c.between(part, (ps, pe), (qs, qe))))
            yield pa.RecordBatch.from_arrays([*(b.column(x) for x in ("doc", "id", "copies", "k")), pa.array(ids, pa.list_(pa.int32()))], ["doc", "id", "copies", "k", "ids"])

    level = "doc string, k int, p array<long>, q array<long>, ok array<boolean>"
    state = "doc string, k int, ps long, pe long, qs long, qe long"
    matrices = lines.mapInArrow(transfer, level).withColumn("g", F.expr(f"k div {GROUP}").cast("int"))
    groups = matrices.groupBy("doc", "g").applyInArrow(lambda t: combine(t), level)
    outer = groups.groupBy("doc").applyInArrow(lambda t: ends(t), state).withColumnRenamed("k", "g")
    states = matrices.groupBy("doc", "g").cogroup(outer.groupBy("doc", "g")).applyInArrow(lambda t, o: within(t, o), state)
    traced = lines.join(states, ["doc", "k"]).mapInArrow(backtrace, f"doc string, id {kind}, copies long, k int, ids array<int>")
    whole = traced.groupBy("doc").agg(F.first("id").alias("id"), F.max("copies").alias("copies"), F.array_sort(F.collect_list(F.struct("k", "ids"))).alias("parts"))
    named = whole.withColumn("tokens", F.flatten(F.transform("parts", lambda x: x["ids"])))
    big = named.select("id", F.size("parts").alias("n_chunks"), F.size("tokens").cast("long").alias("n_tokens"), "tokens", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("_c")).drop("_c")
    if not decoded:
        return direct.union(big).withColumnRenamed("id", id_col)
    return direct.union(decode(big, model, text_col="decoded")).withColumnsRenamed({"id": id_col, "decoded": decoded})


def decode(encoded: DataFrame, model: bytes, tokens_col: str = "tokens", text_col: str = "decoded") -> DataFrame:
    """Add the text of a row's ids. Null ids: null text. All other columns pass through."""
    arrow_rows(encoded.sparkSession)
    from pyspark.sql.types import StringType, StructField, StructType

    keep = [f for f in encoded.schema.fields if f.name != text_col]
    schema = StructType([*keep, StructField(text_col, StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = coder(model)
        for b in batches:
            text = []
            for row in b.column(tokens_col):  # one row's ids as Python numbers at a time
                text.append(_text(c, row.as_py()))
            yield pa.RecordBatch.from_arrays([*(b.column(f.name) for f in keep), pa.array(text, pa.string())], [*(f.name for f in keep), text_col])

    return encoded.mapInArrow(run, schema)


def read_model(path: str = DEFAULT_MODEL) -> bytes:
    """The model file's bytes, read once on the driver and sent along (about half a MB)."""
    with open(path, "rb") as f:
        return f.read()
