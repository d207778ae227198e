"""Alignment of tokenizers, whitening, packing: against brute force, on edges, on the tables."""

import math
import os
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from codexmill.llm import alignment, packing, subwords, whitening
from codexmill.llm import queries as llm_queries

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
needs_tables = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")
needs_files = pytest.mark.skipif(not os.path.exists("/opt/tokenizers/byte_bpe_50k.json"), reason="no tokenizer files here")

ODD = ["", " ", "  ", "a", " a", "a  b", "a \n b c", "  x y  z", "it's 'll  we've <|endoftext|> b<|endoftext|>c <s> </s> d", "日本 語 x y z", "a\x1c b \x1d c", "tab\t x y\t z", "x" * 3000 + " y", "a b " * 50 + "  ", "▁ a ▁b", "😀 é́ ﷺ", "\x00 \x01", "no spaces at all" * 3]


def hard_texts(n: int, seed: int = 1) -> list[str]:
    rng = random.Random(seed)
    return ODD + ["".join(rng.choice([" ", " ", "a", "B", "é", "\n", "\t", "'s", "9", ".", "日", " ", "<|endoftext|>", "▁", "😀", "the"]) for _ in range(rng.randrange(40))) for _ in range(n)]


@pytest.fixture(scope="module")
def libraries():
    import sentencepiece
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(subwords.path(subwords.BYTE_BPE))
    plain.encode_special_tokens = True
    usual = Tokenizer.from_file(subwords.path(subwords.BYTE_BPE))
    pieces = sentencepiece.SentencePieceProcessor(model_file=subwords.path(subwords.PIECE_BPE))
    return usual, plain, pieces


# segments


@needs_files
@pytest.mark.parametrize("block", [16, 1 << 20])
def test_segments_give_the_ids_of_whole_texts(libraries, monkeypatch, block):
    usual, plain, pieces = libraries
    monkeypatch.setattr(subwords, "BLOCK", block)
    texts = hard_texts(400)
    a, spaced, b = subwords.byte_bpe(subwords.path(subwords.BYTE_BPE)), subwords.byte_bpe(subwords.path(subwords.BYTE_BPE), " ", True), subwords.piece_bpe(subwords.path(subwords.PIECE_BPE))
    assert a.parted and spaced.parted and b.parted
    assert [x.tolist() for x in a.encode_each(texts)] == [usual.encode(t, add_special_tokens=False).ids for t in texts]
    assert [x.tolist() for x in spaced.encode_each(texts)] == [plain.encode(" " + t, add_special_tokens=False).ids for t in texts]
    assert [x.tolist() for x in b.encode_each(texts)] == [pieces.encode(t) for t in texts]


@needs_files
def test_a_full_cache_starts_anew(libraries, monkeypatch):
    monkeypatch.setattr(subwords, "CACHED", 4)
    a = subwords.Subwords(lambda s: subwords.flat([[len(x)] * len(x) for x in s]), lambda s: [[0] for _ in s])
    for _ in range(3):
        assert a.encode("one two three").tolist() == [0, 3, 3, 3, 5, 5, 5, 5, 5]
    assert len(a.at) == 2


@needs_files
def test_token_bytes_of_both_vocabularies(libraries):
    usual, _, pieces = libraries
    names, more = subwords.byte_bpe_tokens(subwords.path(subwords.BYTE_BPE)), subwords.piece_bpe_tokens(subwords.path(subwords.PIECE_BPE))
    assert len(names) == usual.get_vocab_size() and len(set(names)) == len(names)
    assert len(more) == pieces.get_piece_size() and sum(len(x) == 1 for x in more) >= 256


# alignment


def brute_alignment(docs, libraries):
    _, plain, pieces = libraries
    names = subwords.byte_bpe_tokens(subwords.path(subwords.BYTE_BPE)), subwords.piece_bpe_tokens(subwords.path(subwords.PIECE_BPE))
    per = []
    for i, t in docs:
        sides = [plain.encode(" " + t, add_special_tokens=False).ids, pieces.encode(t)] if t else [[], []]
        if t and any(b"".join(n[x] for x in ids) != (" " + t).encode() for n, ids in zip(names, sides, strict=True)):
            sides = [[], []]
        spans = []
        for n, ids in zip(names, sides, strict=True):
            at = [0, *np.cumsum([len(n[x]) for x in ids]).tolist()]
            spans.append(list(zip(at, at[1:], ids, strict=False)))
        links = [(x, y) for s, e, x in spans[0] for p, q, y in spans[1] if max(s, p) < min(e, q)]
        lo, groups = 0, []
        for end in sorted({e for _, e, _ in spans[0]} & {e for _, e, _ in spans[1]}):
            groups.append("|".join(",".join(str(x) for s, e, x in side if lo <= s and e <= end) for side in spans))
            lo = end
        per.append((i, *map(len, sides), len(groups), links, ";".join(groups)))
    counts, most = Counter(p for x in per for p in set(x[4])), defaultdict(int)
    for (a, _), c in counts.items():
        most[a] = max(most[a], c)
    return [(i, a, b, g, len(k), sum(counts[p] == most[p[0]] for p in k), sum(counts[p] for p in k), text) for i, a, b, g, k, text in per]


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@needs_files
@pytest.mark.parametrize("limit", [alignment.BROADCAST_PAIRS, 0])
def test_alignment_equals_brute_force(spark, libraries, monkeypatch, limit):
    monkeypatch.setattr(alignment, "BLOCK", 3)
    docs = list(enumerate(hard_texts(60))) + [(7, "again and again"), (7, "again and again"), (None, "no id"), (99, None)]
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in docs], "doc_id long, text string, token string, group int").repartition(5)
    assert rows_of(alignment.align(df, limit=limit)) == sorted(brute_alignment(docs, libraries), key=str)


@needs_files
def test_alignment_meets_each_word_of_a_batch_once(spark, libraries, monkeypatch):
    a, b = subwords.path(subwords.BYTE_BPE), subwords.path(subwords.PIECE_BPE)
    docs = [(i, "again and again, as often as it is said " * 5) for i in range(200)]
    df = spark.createDataFrame(docs, "doc_id long, text string").coalesce(1)
    batch = alignment.tokens(df, a, b).collect()
    assert [(len(r["docs"]), len(r["words"])) for r in batch] == [(200, 9)]  # the last word has the space at the end
    monkeypatch.setattr(alignment, "WORDS", 30)
    odd = list(enumerate(hard_texts(30, 5)))
    df = spark.createDataFrame(odd, "doc_id long, text string").repartition(2)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "4")
    monkeypatch.setattr(alignment, "arrow_rows", lambda spark: None)
    assert len(alignment.tokens(df, a, b).collect()) > df.rdd.getNumPartitions()
    assert rows_of(alignment.align(df)) == sorted(brute_alignment(odd, libraries), key=str)


@needs_files
def test_alignment_meets_each_word_once_over_all_batches(spark, libraries, monkeypatch):
    monkeypatch.setattr(alignment, "WORDS", 30)
    a, b = subwords.path(subwords.BYTE_BPE), subwords.path(subwords.PIECE_BPE)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "4")
    monkeypatch.setattr(alignment, "arrow_rows", lambda spark: None)
    docs = [(i, "again and again, as often as it is said") for i in range(60)] + [(60, None), (61, ""), (62, "as  often\nas \n it")]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    batches = alignment.tokens(df, a, b, parts=4).persist()
    assert batches.count() > 10
    words = alignment.gathered(alignment.marked(alignment.coded(alignment.asked(batches), a, b), alignment.vocabulary(spark, a, b), 4)).collect()
    assert len(words) == len({w for _, t in docs if t for w in subwords.segments(t)}) and all(w["links"] for w in words)
    batches.unpersist()
    assert rows_of(alignment.align(df)) == sorted(brute_alignment(docs, libraries), key=str)


@needs_files
def test_alignment_of_nothing(spark):
    assert alignment.align(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    assert rows_of(alignment.align(spark.createDataFrame([(1, None)], "doc_id long, text string"))) == [(1, 0, 0, 0, 0, 0, 0, "")]


@needs_files
@needs_tables
def test_alignment_of_the_table(spark, libraries):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect() if len(r["text"] or "") < 3000]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert rows_of(alignment.align(df)) == sorted(brute_alignment(docs, libraries), key=str)


# whitening


def plain_whitening(vectors, k=8):
    x = [[math.floor(1024 * float(c)) + 100000 for c in v] for v in vectors]
    n, d = len(x), len(x[0])
    s = [sum(r[i] for r in x) for i in range(d)]
    v = np.array([[sum((n * r[i] - s[i]) * (n * r[j] - s[j]) for r in x) / n**3 for j in range(d)] for i in range(d)])
    e, u = np.linalg.eigh(v)
    e, u = e[::-1][:k], u[:, ::-1][:, :k]
    centred = np.array([[(n * c - t) / n for c, t in zip(r, s, strict=True)] for r in x])
    return n, [sum((n * c - t) ** 2 for c, t in zip(r, s, strict=True)) for r in x], centred @ u / np.sqrt(e), e / np.trace(v)


@pytest.mark.parametrize("scale", [1.0, 3e9])
def test_whitening_equals_plain_integers(spark, scale):
    rng = np.random.default_rng(3)
    vectors = (rng.normal(size=(60, 12)) @ np.diag(np.linspace(1, 3, 12)) * scale).tolist()
    bad = [None, [1.0] * 11 + [None], [float("nan")] + [0.0] * 11, [float("inf")] + [0.0] * 11, [1.0], []]
    df = spark.createDataFrame([(i, v, 0) for i, v in enumerate(vectors + bad)], "vec_id long, embedding array<double>, component int").repartition(4)
    n, deviation, w, explained = plain_whitening(vectors)
    got = defaultdict(dict)
    for r in whitening.whiten(df).collect():
        got[r["vec_id"]][r["component"]] = r
    assert sorted(got) == list(range(60)) and all(sorted(x) == list(range(1, 9)) for x in got.values())
    for c in range(8):
        mine = np.array([got[i][c + 1]["whitened"] for i in range(60)])
        assert min(np.abs(mine - w[:, c]).max(), np.abs(mine + w[:, c]).max()) < 1e-8
        assert abs(got[0][c + 1]["explained"] / explained[c] - 1) < 1e-9
    assert [int(got[i][1]["deviation"]) for i in range(60)] == deviation and got[0][1]["n"] == n
    assert got[0][1]["identity_error"] < 1e-9


def test_limb_products_are_exact():
    rng = np.random.default_rng(5)
    for bits in (3, 12, 17, 40, 62):
        x = rng.integers(-(2**bits), 2**bits, (50, 4))
        assert (sum(p.astype(np.int64).astype(object) * 2 ** (whitening.LIMB * i) for i, p in enumerate(whitening.limbs(x))) == x.astype(object)).all()
        total = whitening.Products(4)
        total.add(x[:20])
        total.add(x[20:])
        want = {(-1, -1): 50} | {(i, -1): sum(map(int, x[:, i])) for i in range(4)} | {(i, j): sum(int(a) * int(b) for a, b in zip(x[:, i], x[:, j], strict=True)) for i in range(4) for j in range(i, 4)}
        assert {(i, j): int(v) for i, j, v in total.numbers()} == want
        y = np.minimum(x, 2**61)
        assert whitening._squares(y) == [sum(int(c) ** 2 for c in r) for r in y]


def test_whitening_beyond_64_bits_and_without_variance(spark):
    rows = [(1, [1e300, 0.5, 2.0]), (2, [-1e300, 0.5, 3.0]), (2, [-1e300, 0.5, 3.0]), (None, [0.0, 0.5, 2.0])]
    out = whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert len(out) == 12 and {r["vec_id"] for r in out} == {1, 2, None}
    assert all((r["whitened"] is None) == (r["component"] > 1) for r in out) and out[0]["identity_error"] < 1e-9
    one = whitening.whiten(spark.createDataFrame([(5, [1.0, 2.0])], "vec_id long, embedding array<float>")).collect()
    assert [(r["component"], r["n"], r["deviation"], r["whitened"], r["explained"], r["identity_error"]) for r in one] == [(1, 1, 0, None, None, None), (2, 1, 0, None, None, None)]
    assert whitening.whiten(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


# packing


def test_supersteps_equal_plain_best_fit():
    rng = random.Random(3)
    for _ in range(200):
        size = rng.choice([10, 50, 64])
        items, gaps = [rng.randrange(1, size + 1) for _ in range(rng.randrange(1, 200))], []
        for x in sorted(items, reverse=True):
            best = min((g for g in gaps if g >= x), default=None)
            if best is None:
                gaps.append(size - x)
            else:
                gaps[gaps.index(best)] -= x
        assert packing.match(Counter(items), size).opened == len(gaps)


def test_state_of_the_supersteps_is_bounded_at_any_scale():
    rng = np.random.default_rng(1)
    for n in (10**5, 10**10):
        counts = {k: int(rng.integers(1, n)) for k in range(1, 2049)}
        runs = packing.match(counts)
        assert len(runs.matches) < 20_000
        assert runs.opened <= 1.02 * sum(k * v for k, v in counts.items()) / 2048


def check_packed(rows, size):
    held = defaultdict(list)
    for r in rows:
        held[r["sequence_id"]].append((r["offset"], r["length"]))
    for places in held.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= size
    return len(held)


@pytest.mark.parametrize("parts", [1, 64])
def test_pack_places_every_piece(spark, monkeypatch, parts):
    monkeypatch.setattr(packing, "PARTS", parts)
    rng = random.Random(4)
    lengths = [rng.choice([1, 1, 1, 5, 30, 64, rng.randrange(1, 65)]) for _ in range(700)]
    df = spark.createDataFrame([(i // 2, n, "x") for i, n in enumerate(lengths)] + [(1, None, "null"), (2, 0, "low"), (3, 65, "high")], "doc_id long, length long, offset_of string").repartition(6)
    rows = packing.pack(df, 64).collect()
    assert len(rows) == 703 and {r["offset_of"] for r in rows if r["sequence_id"] is None} == {"null", "low", "high"}
    good = [r for r in rows if r["sequence_id"] is not None]
    assert Counter((r["doc_id"], r["length"]) for r in good) == Counter((i // 2, n) for i, n in enumerate(lengths))
    assert check_packed(good, 64) == packing.match(Counter(lengths), 64).opened
    assert packing.pack(spark.createDataFrame([], "doc_id long, length long")).count() == 0


@needs_files
def test_pieces_and_sequences(spark, libraries):
    texts = [*hard_texts(40), None, "one two three " * 60, "one two three " * 60]
    df = spark.createDataFrame([(i if i % 9 else None, t, 5) for i, t in enumerate(texts)], "doc_id long, text string, piece int").repartition(3)
    rows = packing.pieces(df, size=32)
    whole = defaultdict(list)
    for r in rows.collect():
        ids = np.frombuffer(r["ids"], "<u4")
        assert len(ids) == r["length"] <= 32 and (r["piece"] == 0 or r["length"] == 32)
        whole[r["doc_id"]].append((r["piece"], r["start"], ids.tolist()))
    for i, t in enumerate(texts):
        if i % 9:
            want = [*libraries[0].encode(t or "", add_special_tokens=False).ids, 0]
            assert sum((x for _, _, x in sorted(whole[i])), []) == want
            assert [s for _, s, _ in sorted(whole[i])] == [0, *np.cumsum([len(x) for _, _, x in sorted(whole[i])])[:-1].tolist()]
    packed = packing.pack(rows, 32)
    check_packed(packed.collect(), 32)
    read = packing.sequences(packed).collect()
    assert all(len(r["ids"]) == 4 * r["length"] <= 128 for r in read)
    assert sum(r["length"] for r in read) == sum(len(x) for v in whole.values() for _, _, x in v)


def test_pieces_are_made_in_small_batches(spark):
    def few(batches):
        for b in batches:
            assert b.num_rows <= 256, b.num_rows
            yield b

    packing.arrow_rows(spark)
    rows = spark.range(1000).coalesce(1).selectExpr("id", "id % 9 + 1 AS length").mapInArrow(few, "id long, length long")
    assert packing.pack(rows, 16).count() == 1000



@needs_files
@needs_tables
def test_packing_of_the_table(spark, libraries):
    rows = llm_queries.op13_best_fit_packing(spark, SF).collect()
    docs = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    total = 0
    for r in rows:
        ids = [*libraries[0].encode(docs[r["doc_id"]], add_special_tokens=False).ids, 0]
        part = ids[r["start"] : r["start"] + r["length"]]
        total += len(part)
        assert len(part) == r["length"] and zlib.crc32(np.array(part, "<u4").tobytes()) == r["ids_crc32"]
    assert check_packed(rows, 2048) <= 1.02 * total / 2048 + 1
    assert total == sum(len(libraries[0].encode(t, add_special_tokens=False).ids) + 1 for t in docs.values())


@needs_tables
@pytest.mark.parametrize("name", ["whitening_checks", "packing_checks"])
def test_sql_of_checks(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    got = llm_queries.QUERIES[name](spark, SF)
    cur = con.execute(llm_queries.ORACLES[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == sorted(got.columns)
    assert sorted((tuple(r[c] for c in names) for r in got.collect()), key=str) == sorted(cur.fetchall(), key=str)


@needs_tables
def test_op12_returns_the_contract(spark):
    rows = llm_queries.op12_whitening(spark, SF)
    assert dict(rows.dtypes)["deviation"] == "bigint" and rows.groupBy("vec_id").agg(F.count("whitened").alias("n")).filter("n <> 8").isEmpty()
    assert rows.agg(F.max("identity_error")).first()[0] < 1e-6
