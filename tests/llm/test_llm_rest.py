"""Tokens, WARC, decontamination, chat windows, sharding, queries and the pipeline."""

import gzip
import hashlib
import importlib
import os
import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from codexmill.llm import chat_format, decontaminate, sentencepiece_scan, sharding, warc
from codexmill.llm import queries as llm_queries

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
needs_tables = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")
needs_model = pytest.mark.skipif(not os.path.exists(sentencepiece_scan.DEFAULT_MODEL), reason="no tokenizer files here")


# tokens


@pytest.fixture(scope="module")
def model():
    return sentencepiece_scan.read_model()


@needs_model
def test_scan_of_hard_texts_equals_the_library(model):
    c, rng = sentencepiece_scan.coder(model), random.Random(2)
    kinds = ["abcdefghijklmnopqrstuvwxyz", " ", " a", "日本語中文的", "aA1_.(){}\n ", "ntioalz"]
    for n in range(150):
        text = "".join(rng.choice(kinds[n % len(kinds)]) for _ in range(rng.randrange(1, 300)))
        t, chunk, halo = c.prefix + text, rng.choice([37, 50, 90]), sentencepiece_scan._halo(c)
        parts, chunks = [], []
        for k in range((len(t) - 1) // chunk + 1):
            base = max(0, k * chunk - halo)
            part = t[base : (k + 1) * chunk + halo]
            p, q, m = c.matrix(part, k * chunk - base, min(len(t), (k + 1) * chunk) - base)
            chunks.append(([(a + base, b + base) for a, b in p], [(a + base, b + base) for a, b in q], m))
            parts.append((base, part))
        ids = []
        for (base, part), (e, x) in zip(parts, sentencepiece_scan.scan(chunks), strict=True):
            ids += c.between(part, (e[0] - base, e[1] - base), (x[0] - base, x[1] - base))
        assert ids == c.whole.encode(text)


def test_max_plus_product_is_associative():
    rng = np.random.default_rng(0)
    a, b, c = (rng.normal(size=s) for s in ((2, 3), (3, 4), (4, 2)))
    left, right = sentencepiece_scan.product(sentencepiece_scan.product(a, b), c), sentencepiece_scan.product(a, sentencepiece_scan.product(b, c))
    assert np.allclose(left, right)


@needs_model
def test_groups_of_chunks_agree_with_one_tree(spark, model, monkeypatch):
    """Matrices combined in groups, groups in a tree, and back; a long text is cut once."""
    monkeypatch.setattr(sentencepiece_scan, "GROUP", 3)
    rng = random.Random(5)
    texts = ["".join(rng.choice(kind) for _ in range(n)) for kind, n in (("ab", 700), ("ntioalz ", 1000), ("x", 333), (["日本", "a", " "], 500), ("word ", 100))]
    df = spark.createDataFrame([*enumerate(texts), (2, texts[2])], "doc_id long, text string")
    got = sorted((r["doc_id"], r["n_chunks"], r["tokens"]) for r in sentencepiece_scan.encode(df, model, chunk=50).collect())
    lib, lead = sentencepiece_scan.coder(model).whole, len(sentencepiece_scan.coder(model).prefix)
    want = [(i, (len(t) + lead - 1) // 50 + 1, lib.encode(t)) for i, t in [*enumerate(texts), (2, texts[2])]]
    assert got == sorted(want)


def test_scan_keeps_the_states_given_for_its_ends():
    rng = random.Random(3)
    states = [[(0, 0)], *([(k, j) for j in range(rng.randrange(1, 4))] for k in range(1, 9)), [(9, 9)]]
    path = [rng.choice(s) for s in states]
    chunks = []
    for x, y, p, q in zip(states, states[1:], path, path[1:], strict=False):
        m = np.full((len(x), len(y)), -np.inf)
        m[x.index(p), y.index(q)] = 0.0
        chunks.append((x, y, m))
    assert sentencepiece_scan.scan(chunks) == list(zip(path, path[1:], strict=False))
    assert sentencepiece_scan.scan(chunks[2:7], path[2], path[7]) == list(zip(path[2:7], path[3:8], strict=True))
    whole = sentencepiece_scan.tree(chunks)[-1][0][2]
    left = chunks[0][2]
    for _, _, m in chunks[1:]:
        left = sentencepiece_scan.product(left, m)
    assert (whole == left).all()
    blocked = [(p, q, np.full(m.shape, -np.inf)) for p, q, m in chunks]
    with pytest.raises(ValueError, match="no path"):
        sentencepiece_scan.scan(blocked)


@needs_model
def test_encode_and_decode(spark, model):
    texts = [None, "", " ", "a", "Hello  world\n\tünïcode ☃ \x00 end ", "naïve " * 400, "x" * 900, "日本" * 300, "word " * 200, "word " * 200]
    df = spark.createDataFrame([(i if i else None, t, 1, "c") for i, t in enumerate(texts)] + [(9, texts[9], 1, "c")], "doc_id long, text string, n_tokens int, doc string")
    enc = sentencepiece_scan.encode(df, model, chunk=100)
    rows = sentencepiece_scan.decode(enc, model).collect()
    lib = sentencepiece_scan.coder(model).whole
    assert len(rows) == 11 and sum(r["doc_id"] == 9 for r in rows) == 2
    for r in rows:
        t = texts[r["doc_id"] or 0]
        if t is None:
            assert r["tokens"] is None and r["decoded"] is None and (r["n_chunks"], r["n_tokens"]) == (0, 0)
        else:
            assert r["tokens"] == lib.encode(t) and r["n_tokens"] == len(r["tokens"]) and r["decoded"] == t
            assert (r["n_chunks"] > 1) == (len(t) > 100)
    assert sentencepiece_scan.encode(df.limit(0), model).count() == 0
    fused = sentencepiece_scan.encode(df, model, chunk=100, decoded="back")
    order = lambda d: sorted(map(tuple, d.collect()), key=str)
    assert order(fused) == order(sentencepiece_scan.decode(enc, model)) and fused.columns[-1] == "back"
    same = sentencepiece_scan.decode(enc.withColumn("decoded", F.lit(1)), model)
    assert same.columns.count("decoded") == 1


# WARC


def test_warc_round_trip(spark, tmp_path):
    big = "é" * 600
    rows = [(1, "http://a/\r\nx", big), (5, None, big), (3, "u", big), (7, "u", "small"), (8, "u", "small"), (9, "u", None), (10, "u", ""), (None, "u", big), (5, None, big), (11, "u", "a\r\n\r\nb" * 300)]
    df = spark.createDataFrame([(*r, "extra", 1) for r in rows], "page_id long, url string, html string, digest string, refers int")
    path = str(tmp_path / "w")
    warc.write_archives(df, path)
    got = warc.read_archives(spark, path).collect()
    assert len(got) == len(rows)
    by = defaultdict(list)
    for r in got:
        by[r["page_id"]].append(r)
    html = {r[0]: r[2] or "" for r in rows}
    for k, rs in by.items():
        for r in rs:
            b = html[k].encode()
            assert (r["payload_bytes"], r["payload_digest"]) == (len(b), hashlib.sha1(b).hexdigest())
            assert r["payload"] == (None if r["record_type"] == "revisit" else b)
    kinds = {k: {(r["record_type"], r["refers_to"]) for r in rs} for k, rs in by.items()}
    assert kinds[1] == kinds[3] == kinds[None] == {("revisit", 5)} and all(v == {("response", None)} for k, v in kinds.items() if k not in (1, 3, None))
    warc.export(spark, path, str(tmp_path))
    assert warc.read_files(spark, str(tmp_path)).count() == len(rows)
    name = next(tmp_path.glob("*.warc.gz"))
    assert gzip.decompress(name.read_bytes()).startswith(b"WARC/1.1\r\n")
    warc.write_archives(df.limit(0), path)
    assert warc.read_archives(spark, path).count() == 0


def test_warc_reader_finds_damage():
    one = warc.member(warc.record(1, "u", b"payload", None))
    two = one + warc.member(warc.record(2, "u", b"x" * 2000, None))
    assert [f["warc-record-id"] for f, _ in warc.records(two[i : i + 7] for i in range(0, len(two), 7))] == ["<urn:page:1>", "<urn:page:2>"]
    with pytest.raises(ValueError, match="cut off"):
        list(warc.records([two[:-20]]))
    for old, new, words in ((b"payload", b"pAyload", "digest"), (b"WARC/1.1", b"XARC/1.1", "not a WARC"), (b"\r\nContent-Length: ", b"\r\nContent-Length: 1", "frame")):
        raw = warc.record(1, "u", b"payload", None)
        with pytest.raises(ValueError, match=words):
            list(warc.records([warc.member(raw.replace(old, new))]))


def test_warc_reader_takes_records_of_other_writers(spark, tmp_path):
    def rec(kind, block, *more):
        head = ["WARC/1.0", f"WARC-Type: {kind}", "WARC-Record-ID: <urn:uuid:0-1>", *more, f"Content-Length: {len(block)}"]
        return warc.member("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n")

    page = b"HTTP/1.1 200 OK\r\nX: y\r\n\r\n<p>hi</p>"
    sha = hashlib.sha1(b"<p>hi</p>").hexdigest()
    data = rec("warcinfo", b"software: x\r\n") + rec("response", page, "WARC-Target-URI: http://a") + rec("response", page, f"WARC-Payload-Digest: sha1:{sha}") + rec("response", page, "WARC-Payload-Digest: sha256:ab", "WARC-Block-Digest: md5:00") + rec("revisit", b"", "WARC-Refers-To: <urn:uuid:0-0>") + rec("resource", b"plain")
    (tmp_path / "a.warc.gz").write_bytes(data)
    got = [(r["record_type"], r["page_id"], r["payload_bytes"], r["payload_digest"], bytes(r["payload"]) if r["payload"] is not None else None) for r in warc.read_files(spark, str(tmp_path)).collect()]
    body = (9, sha, b"<p>hi</p>")
    assert got == [("warcinfo", None, 13, hashlib.sha1(b"software: x\r\n").hexdigest(), b"software: x\r\n"), *[("response", None, *body)] * 3, ("revisit", None, None, None, None), ("resource", None, 5, hashlib.sha1(b"plain").hexdigest(), b"plain")]
    with pytest.raises(ValueError, match="payload digest"):
        [warc._row(*r) for r in warc.records([rec("response", page, "WARC-Payload-Digest: sha1:" + "0" * 40)])]


# decontamination


def plain_distance(item, span):
    row = [0] * (len(span) + 1)
    for i, w in enumerate(item, 1):
        new = [i]
        for j, v in enumerate(span, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (w != v)))
        row = new
    return min(row)


def test_edit_distance_agrees_with_plain():
    rng = np.random.default_rng(1)
    for _ in range(200):
        item, span = (rng.integers(1, 5, rng.integers(1, 12)).astype(np.uint64) for _ in range(2))
        d, s, e = decontaminate.edits(item, span)
        assert d == plain_distance(item, span)
        whole = decontaminate.edits(item, span[s:e])
        assert whole[0] == d and 0 <= s <= e <= len(span)


def leaks(seed=7):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(4))
    items = [(i, " ".join(word() for _ in range(rng.randrange(8, 50)))) for i in range(30)]
    docs, want = [], set()
    for d in range(150):
        body = [word() for _ in range(rng.randrange(0, 120))]
        if d % 2:
            i, t = rng.choice(items)
            w = t.split()
            for _ in range(rng.randrange(int(0.2 * len(w)) + 1)):
                p, how = rng.randrange(len(w)), rng.random()
                w[p : p + 1] = [word()] if how < 0.4 else [] if how < 0.7 else [w[p], word()]
            at = rng.randrange(len(body) + 1)
            body[at:at] = [x.upper() if rng.random() < 0.1 else x + rng.choice([",", "", "."]) for x in w]
        docs.append((d, rng.choice([" ", "\n"]).join(body)))
    n = lambda t: [int(x) for x in decontaminate.word_hashes(t)]
    for d, t in docs:
        for i, x in items:
            if plain_distance(n(x), n(t)) <= int(0.2 * len(x.split())):
                want.add((d, i))
    return items, docs, want


def test_find_leaks_agrees_with_brute_force(spark):
    items, docs, want = leaks()
    df = spark.createDataFrame([(*r, "x", 5) for r in docs], "doc_id long, text string, item_id string, distance int")
    bench = spark.createDataFrame([*items, (99, None), (98, "too short")], "item_id long, text string")
    got = decontaminate.find_leaks(df, bench).collect()
    found = {(r["doc_id"], r["item_id"]) for r in got}
    assert found <= want and len(found) >= 0.98 * len(want) > 60
    clean = {r["doc_id"] for r in decontaminate.drop_leaks(df, bench).collect()}
    assert clean == {d for d, _ in docs} - {d for d, _ in found}


def test_find_leaks_edges(spark, monkeypatch):
    bench = spark.createDataFrame([(1, "one two three four five six"), (2, "one two three four five six"), (1, "one two three four five six"), (3, "seven eight nine ten eleven twelve thirteen")], "item_id long, text string")
    docs = spark.createDataFrame([(1, None), (2, ""), (None, "x ONE, two three\nfour five six y"), (4, "ONE two three four five six"), (4, "ONE two three four five six"), (5, "q " * 20000 + "seven eight nine ten eleven twelve thirteen")], "doc_id long, text string")
    want = sorted([(-1, 1), (-1, 2), (4, 1), (4, 1), (4, 2), (4, 2), (5, 3)])
    for block in (200_000, 1):  # any number of blocks gives the same
        monkeypatch.setattr(decontaminate, "BLOCK_WORDS", block)
        got = decontaminate.find_leaks(docs, bench).collect()
        assert sorted((-1 if r["doc_id"] is None else r["doc_id"], r["item_id"]) for r in got) == want
        assert sorted(r["doc_id"] for r in decontaminate.drop_leaks(docs, bench).collect()) == [1, 2]
    assert next(r for r in got if r["doc_id"] is None)["first_word"] == 1
    assert decontaminate.find_leaks(docs, bench.limit(0)).count() == 0 and decontaminate.find_leaks(docs.limit(0), bench).count() == 0
    assert decontaminate.drop_leaks(docs, bench.limit(0)).count() == 6


@pytest.mark.parametrize("rate", [0.2, 0.35])
@pytest.mark.parametrize("how", ["substitute", "delete", "insert", "mix"])
def test_find_leaks_misses_nothing_at_the_full_budget(how, rate):
    """Exactly floor(rate * n) edits of each kind, for short and long items."""
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    for n in (6, 10, 15, 35, 59, 100, 200, 400):
        items, docs = [(i, [word() for _ in range(n)]) for i in range(20)], []
        for _, w in items:
            w = list(w)
            for p in sorted(rng.sample(range(n), int(rate * n + 1e-9)), reverse=True):
                kind = rng.choice(["substitute", "delete", "insert"]) if how == "mix" else how
                w[p : p + 1] = [word()] if kind == "substitute" else [] if kind == "delete" else [w[p], word()]
            docs.append(" ".join([word() for _ in range(30)] + w + [word() for _ in range(30)]))
        bench = decontaminate.Benchmark([(i, " ".join(w)) for i, w in items], rate)
        assert [g[0] for g in bench.find(docs) if g[0] == g[1]] == list(range(20)), n


@pytest.mark.parametrize("rate", [0.05, 0.1, 0.2])
@pytest.mark.parametrize("how", ["substitute", "delete", "insert", "mix"])
def test_keys_place_items_whose_edits_are_spread_evenly(how, rate):
    """The hardest edits for sampled keys: no run of words longer than need be stays whole."""
    rng = random.Random(13)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    met = of = 0
    for n in (6, 8, 10, 15, 25, 35, 59, 100, 200):
        items, docs = [(i, [word() for _ in range(n)]) for i in range(20)], []
        for _, w in items:
            w, k = list(w), int(rate * n + 1e-9)
            for p in sorted({int((j + 0.5) * n / k) for j in range(k)}, reverse=True):
                kind = rng.choice(["substitute", "delete", "insert"]) if how == "mix" else how
                w[p : p + 1] = [word()] if kind == "substitute" else [] if kind == "delete" else [w[p], word()]
            docs.append(" ".join([word() for _ in range(30)] + w + [word() for _ in range(30)]))
        bench = decontaminate.Benchmark([(i, " ".join(w)) for i, w in items], rate)
        met, of = met + len({g[0] for g in bench.find(docs) if g[0] == g[1]}), of + 20
    assert met >= 0.99 * of


def test_walks_of_equal_words_agree_and_stay_in_a_text(monkeypatch):
    walks, rng = decontaminate.Walks(), np.random.default_rng(3)
    h = rng.integers(1, 2**63, 50).astype(np.uint64)
    padded = np.concatenate([h, np.zeros(decontaminate.STEPS, np.uint64)])
    moved = np.concatenate([rng.integers(1, 2**63, 7).astype(np.uint64), padded])
    for (x, at), (y, by) in zip(walks.keys(padded, 40), walks.keys(moved, 47), strict=True):
        assert (x == y[7:]).all() and all((p + 7 == q[7:]).all() for p, q in zip(at, by, strict=True))
    bench = decontaminate.Benchmark([(1, "one two three four five six seven eight nine ten"), (2, "ha ha ha ha ha ha ha")])
    # an item parted over two texts is in neither; texts of one batch don't mix
    assert bench.find(["zero one two three four five", "six seven eight nine ten", None, "x one two three four five six seven eight nine ten", "ha " * 9]) == [(3, 1, 0, 1, 11, 10), (4, 2, 0, 0, 7, 7)]
    for size in (1, 3, 16):  # walked in pieces of any size
        monkeypatch.setattr(decontaminate, "WALK_WORDS", size)
        assert len(bench.find(["x one two three four five six seven eight nine ten", "ha " * 9])) == 2


def test_find_leaks_with_ids_of_any_type(spark):
    docs = spark.createDataFrame([("d", "a b c d e f g h")], "doc_id string, text string")
    bench = spark.createDataFrame([("item", "b c d e f g"), (None, "c d")], "item_id string, text string")
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.find_leaks(docs, bench).collect()}
    assert got == {("d", "item"), ("d", None)}
    assert decontaminate.find_leaks(docs, bench.limit(0)).schema["item_id"].dataType.simpleString() == "string"


def test_items_that_share_a_stem_meet_a_text_only_by_their_own_words():
    """Texts with the stem alone have no possible item; with an item's other words, that one, however edited."""
    stem = "which of the following statements about"
    items = [(i, f"{stem} " + " ".join(f"i{i}w{k}" for k in range(9))) for i in range(300)]
    bench = decontaminate.Benchmark(items)
    pad = " ".join(f"p{k}" for k in range(50))
    texts = [f"{pad} {stem} {pad}"] * 20 + [f"{pad} {items[7][1]}", None, "", items[8][1].replace("i8w3", "x").replace("statements", "y")]
    h = [decontaminate.word_hashes(t) for t in texts]
    assert not len(bench.possible(h[0], np.zeros(len(h[0]), np.int64)))
    assert [(g[0], g[1], g[2]) for g in bench.find(texts)] == [(20, 7, 0), (23, 8, 2)]
    # many items a text and few a key, and the other way round
    assert {(g[0], g[1]) for g in bench.find([" ".join(t for _, t in items), items[5][1]])} == {(0, i) for i in range(300)} | {(1, 5)}


def test_find_leaks_of_short_items_are_exact():
    bench = decontaminate.Benchmark([(1, "yes"), (2, "to be"), (3, "a b c d e"), (4, " , "), (5, None)])
    got = bench.find(["Yes, yes! " * 3, "not to be, to", "be to", "a b c d x e", "x a, b c D e", "a b c d"])
    assert got == [(0, 1, 0, 0, 1, 1), (1, 2, 0, 1, 3, 2), (4, 3, 0, 1, 6, 5)]


def test_words_beyond_ascii():
    n = lambda t: [int(x) for x in decontaminate.word_hashes(t)]
    plain = n("he said no one can don t it was so 5 euros")
    assert n("\u00abHe said\u00bb: \u201cno\u2014one can\u201d\u2026 don\u2019t \u00bfit\u00a0was\u3000so 5\u20aceu\u00adros") == plain
    assert n("\u00c9t\u00e9 na\u00efve") == n("\u00e9t\u00e9, na\u00efve") and len(n("\u00e9t\u00e9 e\u0301te\u0301 \u0939\u093f\u0928\u094d\u0926\u0940 \ud55c\uad6d")) == 4
    assert n("\u4eca\u65e5abc\u3002") == n("\u4eca \u65e5 abc") and len(n("\u0e17\u0e35\u0e48\u0e44\u0e1bx")) == 4
    item = "\u6211\u4eec\u7684\u57ce\u5e02\u975e\u5e38\u7f8e\u4e3d\u548c\u5b89\u9759"
    bench = decontaminate.Benchmark([(1, item), (2, "\u0e2a\u0e27\u0e31\u0e2a\u0e14\u0e35\u0e04\u0e23\u0e31\u0e1a")])
    other = item[:5] + "\u5f88" + item[6:]
    got = bench.find([f"\u524d\u6587{item}\u3002\u540e\u6587", f"\u524d{other}\u540e", f"x{item[:7]}", "\u0e01\u0e2a\u0e27\u0e31\u0e2a\u0e14\u0e35\u0e04\u0e23\u0e31\u0e1a"])
    assert [g[:3] for g in got] == [(0, 1, 0), (1, 1, 1), (3, 2, 0)]


# chat


def chats(seed=8):
    rng = random.Random(seed)
    rows = []
    for c in range(12):
        for t in range(rng.randrange(1, 30)):
            role = "system" if t == 0 and c % 3 == 0 else rng.choice(["user", "assistant"])
            text = rng.choice([None, "", "<|im_end|>", "<\\|im_start|>x", "\\", "a\n<|im_start|>user\nb", " ".join(["w"] * rng.randrange(1, 90))])
            rows.append((c, t, role, text))
    return rows + [(50, 0, None, "x"), (50, None, "we\nird\\n<|", "y"), (50, 0, None, "x"), (None, 0, "assistant", "z"), (51, 0, "assistant", "w " * 5000), (51, 1, "user", "q")]


def test_chat_round_trip(spark):
    rows = chats()
    df = spark.createDataFrame([(*r, 1, "s") for r in rows], "conv_id long, turn long, role string, text string, span int, formatted string")
    windows = chat_format.format_windows(df, budget=200, history=3, history_tokens=60).cache()
    back = {r["conv_id"]: r for r in chat_format.read_windows(windows).collect()}
    talks = defaultdict(list)
    for c, t, role, text in rows:
        talks[c].append((-1 if t is None else t, role or "", text or ""))
    assert set(back) == set(talks)
    for c, turns in talks.items():
        turns.sort()
        assert [(t["role"], t["text"]) for t in back[c]["turns"]] == [x[1:] for x in turns]
        assert back[c]["loss_text"] == "".join(x[2] for x in turns if x[1] == "assistant")
    made = windows.collect()
    assert sum(len(w["formatted"]) for w in made) == sum(r["formatted_chars"] for r in back.values())
    for w in made:
        assert w["tokens"] <= 200 or w["n_new"] == 1
        assert w["formatted"].count(chat_format.START) == w["formatted"].count(chat_format.END)
        if w["conv_id"] is not None and w["conv_id"] % 3 == 0 and w["conv_id"] < 12:
            assert w["formatted"].startswith(chat_format.START + "system\n")
        for s in w["loss_spans"]:
            assert w["new_start"] <= s["start"] <= s["end"] and w["formatted"][s["end"] :].startswith(chat_format.END)
    assert any(w["new_start"] > 0 for w in made)
    assert chat_format.read_windows(chat_format.format_windows(df.limit(0))).count() == 0


def test_escapes(spark):
    texts = ["<|", "<\\|", "<\\\\|", "<|im_start|>", "plain", "<", "|", "<<||", "\\<|\\"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", chat_format.escape(F.col("t")).alias("e")).withColumn("u", chat_format.unescape(F.col("e"))).collect()
    assert all(r["t"] == r["u"] and "<|" not in r["e"] for r in rows)


def test_roles_of_any_characters_come_back(spark):
    roles = ["a\x00b", "\x00b", "\\", "\\n", "\\\n", "\n\\n\\\\", "<|im_end|>\n\\", "", "user\\\\n\x00b\\b"]
    rows = spark.createDataFrame([(i, 0, r, "t") for i, r in enumerate(roles)], "conv_id long, turn long, role string, text string")
    back = {r["conv_id"]: r["turns"][0]["role"] for r in chat_format.read_windows(chat_format.format_windows(rows)).collect()}
    assert [back[i] for i in range(len(roles))] == roles


# sharding


def test_shards_of_odd_numbers_and_one_hot_text(spark):
    odd = [float("inf"), float("-inf"), float("nan"), 1.7e308, -1.7e308, 0.0, None]
    rows = [(i, f"text {i}", odd[i % 7], "s") for i in range(60)] + [(100 + i, None if i % 2 else "", 1.0, None) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string, m double, k string")
    got = sharding.kd_shards(df, shards=4).collect()
    assert len(got) == 120 and len({r["shard"] for r in got if r["doc_id"] >= 100}) == 1  # null and empty are equal texts
    slots = defaultdict(list)
    for r in got:
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())


def test_strings_are_split_by_their_order(spark):
    rows = [(i, f"text {i:04d}", f"host-{chr(97 + i % 26)}{chr(97 + i % 7)}") for i in range(520)]
    got = sharding.kd_shards(spark.createDataFrame(rows, "doc_id long, text string, host string"), shards=2).collect()
    name = {i: h[:6] for i, _, h in rows}
    sides = [{name[r["doc_id"]] for r in got if r["shard"] == s} for s in (0, 1)]
    assert max(sides[0]) <= min(sides[1])


@pytest.mark.parametrize("shards", [8, 5, 1])
def test_shards(spark, shards):
    rng = random.Random(shards)
    rows = [(i, "é" * rng.randrange(1, 400), rng.choice(["a", "b", None]), rng.choice([None, 1.0, float("nan"), rng.random()])) for i in range(900)]
    rows += [(2000 + i, "copy of one text" * 4, "a", 1.0) for i in range(30)] + [(3000, None, None, None), (3001, "", "a", 0.0), (None, "no id", "b", 2.0), (7, rows[7][1], *rows[7][2:])]
    df = spark.createDataFrame(rows, "doc_id long, text string, size string, shard double")
    got = sharding.kd_shards(df, shards=shards).collect()
    assert len(got) == len(rows)
    size, slots, homes = defaultdict(int), defaultdict(list), defaultdict(set)
    text = {r[0]: r[1] or "" for r in rows}
    for r in got:
        assert r["size"] == len(text[r["doc_id"]].encode()) + 1 and r["law"] == "bytes" and 0 <= r["shard"] < shards
        size[r["shard"]] += r["size"]
        slots[r["shard"]].append(r["slot"])
        homes[text[r["doc_id"]]].add(r["shard"])
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    assert all(len(v) == 1 for v in homes.values())
    fair = sum(size.values()) / shards
    assert len(size) == shards and max(abs(v - fair) for v in size.values()) < 0.06 * fair + 2200


def plain_kd(points, shards, first=0):
    """points: (weight, codes); the split of the operator, one node at a time."""
    if shards == 1 or not points:
        return {id(p): first for p in points}
    dims = range(len(points[0][1]))
    dim = max(dims, key=lambda d: max(p[1][d] for p in points) - min(p[1][d] for p in points))
    half, total, run, left = (shards + 1) // 2, sum(p[0] for p in points), 0, []
    points = sorted(points, key=lambda p: p[1][dim])
    want = total * half / shards
    for p in points:
        if run + p[0] >= want:
            if run + p[0] - want <= want - run:
                left.append(p)
            break
        left.append(p)
        run += p[0]
    ids = {id(p) for p in left}
    return plain_kd(left, half, first) | plain_kd([p for p in points if id(p) not in ids], shards - half, first + half)


def test_kd_tree_agrees_with_plain(spark):
    rng = random.Random(4)
    points = [(rng.randrange(1, 500), (rng.randrange(2**48), rng.randrange(2**44), rng.randrange(2**48))) for _ in range(300)]
    df = spark.createDataFrame([(i, w, *c) for i, (w, c) in enumerate(points)], "i int, _bytes long, _d0 long, _d1 long, _d2 long")
    for shards in (8, 3):
        want = plain_kd(points, shards)
        got = sharding.kd_leaves(df, ["_d0", "_d1", "_d2"], shards).collect()
        assert {r["i"]: r["shard"] for r in got} == {i: want[id(p)] for i, p in enumerate(points)}


def places(values):
    """Each value's place among the different ones, null first, as Spark orders them."""
    some = sorted({v for v in values if v is not None and v == v})
    order = ([None] if None in values else []) + some
    at = {v: i for i, v in enumerate(order)}
    return [len(order) if v is not None and v != v else at[v] for v in values]


@pytest.mark.parametrize("kind", ["an outlier", "a broken prefix", "a long common prefix", "nulls and NaN", "many types"])
def test_kd_tree_of_values_equals_plain(spark, kind):
    rng = random.Random(11)
    n = 160
    numbers, names = [float(rng.randrange(40)) for _ in range(n)], [f"https://site/{'x' * 30}/{rng.randrange(10**6):06d}" for _ in range(n)]
    if kind == "an outlier":
        numbers[3] = 1e18
    elif kind == "a broken prefix":
        names[5] = "http"
    elif kind == "nulls and NaN":
        numbers[:6] = [None, float("nan"), float("inf"), float("-inf"), None, 0.0]
        names[7] = None
    import datetime
    import decimal

    days = [datetime.date(2020, 1, 1) + datetime.timedelta(rng.randrange(90)) for _ in range(n)]
    flags, prices = [rng.random() < 0.5 for _ in range(n)], [decimal.Decimal(rng.randrange(9)) / 4 for _ in range(n)]
    texts = [f"t{i}" + "y" * rng.randrange(200) for i in range(n)]
    columns = [numbers, names] + ([days, flags, prices] if kind == "many types" else [])
    schema = "doc_id long, text string, a double, b string" + (", c date, d boolean, e decimal(9,2)" if kind == "many types" else "")
    df = spark.createDataFrame([(i, texts[i], *row) for i, row in enumerate(zip(*columns, strict=True))], schema).repartition(5)
    weights = [len(t) + 1 for t in texts]
    ties = {r["text"]: r["tie"] for r in df.select("text", F.pmod(F.xxhash64(F.lit(7), F.xxhash64(F.lit(1), "text"), F.xxhash64(F.lit(2), "text")), F.lit(1 << sharding.TIE_BITS)).alias("tie")).collect()}
    codes = [[p * (1 << sharding.TIE_BITS) + ties[t] for p, t in zip(places(c), texts, strict=True)] for c in [*columns, weights]]
    points = [(w, c) for w, c in zip(weights, zip(*codes, strict=True), strict=True)]
    want = plain_kd(points, 8)
    assert {r["doc_id"]: r["shard"] for r in sharding.kd_shards(df, shards=8).collect()} == {i: want[id(p)] for i, p in enumerate(points)}


def test_shards_of_target_bytes_and_nothing(spark):
    df = spark.createDataFrame([(i, "x" * 99) for i in range(10)], "doc_id long, text string")
    got = sharding.kd_shards(df.withColumn("text", F.concat("text", "doc_id")), target_bytes=505).collect()
    assert len({r["shard"] for r in got}) == 2
    assert sharding.kd_shards(df.limit(0), shards=8).count() == 0
    assert len({r["shard"] for r in sharding.kd_shards(df, shards=8).collect()}) == 1  # one group


# queries and the pipeline


@needs_tables
@pytest.mark.parametrize("name", sorted(llm_queries.ORACLES))
def test_oracle(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in ("documents", "pages", "conversations", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    got = llm_queries.QUERIES[name](spark, SF)
    cur = con.execute(llm_queries.ORACLES[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == sorted(got.columns)
    assert sorted((tuple(r[names.index(c)] for c in got.columns) for r in cur.fetchall()), key=str) == sorted(map(tuple, got.collect()), key=str)


@needs_tables
@needs_model
def test_pipeline(spark):
    """Stages keep the documents' columns, and each result agrees with its operator's rule."""
    pipeline = importlib.import_module("corpus_pipeline")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    seen = {"before": docs}
    for name, stage in pipeline.STAGES:
        docs = stage(spark, docs, SF).cache()
        seen[name] = docs
    names = [n for n, _ in pipeline.STAGES]
    for n in names[:-1]:
        assert seen[n].columns == seen["before"].columns
    counts = [seen[n].count() for n in ("before", *names)]
    assert counts[0] > counts[1] == counts[2] >= counts[3] >= counts[4] == counts[5] > 0
    assert seen[names[1]].filter("n_chars <> char_length(text)").count() == 0
    text = {r["doc_id"]: r["text"] for r in seen[names[3]].collect()}
    lib = sentencepiece_scan.coder(sentencepiece_scan.read_model()).whole
    for r in docs.collect():
        assert r["text"] == text[r["doc_id"]] and r["tokens"] == lib.encode(text[r["doc_id"]])
    assert decontaminate.find_leaks(seen[names[3]], spark.read.parquet(f"{SF}/benchmark.parquet")).count() == 0
    again = sorted((r["doc_id"], r["n_tokens"]) for r in pipeline.run(spark, SF).collect())
    assert again == sorted((r["doc_id"], r["n_tokens"]) for r in docs.collect())


def test_one_of_near_copies_stays_whatever_the_ids(spark):
    pipeline = importlib.import_module("corpus_pipeline")
    base = [f"w{i}" for i in range(60)]
    text = lambda tag, near="": " ".join([f"{tag}{w}" for w in base] + [near])
    rows = [(1, text("a")), (None, text("a")), (None, text("b")), (None, text("b", "x")), (None, text("c")), (None, text("c")), (5, text("d")), (5, text("d")), (6, text("d", "y")), (7, text("e")), (7, text("f")), (None, None), (3, text("a", "z"))]
    docs = spark.createDataFrame([(i, t, "en") for i, t in rows], "doc_id long, text string, lang string").repartition(3).cache()
    out = pipeline.one_of_near_copies(spark, docs, SF)
    assert out.columns == docs.columns
    got = [(r["doc_id"], r["text"] and r["text"][0]) for r in out.collect()]
    assert sorted(got, key=str) == sorted([(1, "a"), (None, "b"), (None, "c"), (5, "d"), (7, "e"), (7, "f"), (None, None)], key=str)


@needs_tables
@needs_model
def test_op1_returns_the_token_ids(spark):
    lib = sentencepiece_scan.coder(sentencepiece_scan.read_model()).whole
    text = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = llm_queries.op1_sentencepiece(spark, SF).collect()
    assert len(got) == len(text) and all(list(r["tokens"]) == lib.encode(text[r["doc_id"]] or "") for r in got)


def test_every_metadata_column_is_a_dimension(spark):
    """Only the fifth column varies, so it alone can part groups of equal bytes."""
    docs = spark.createDataFrame([(i, f"text {i:04d}", "a", 1, 2.0, "b", i % 40) for i in range(400)], "doc_id long, text string, m1 string, m2 int, m3 double, m4 string, m5 int")
    shards = defaultdict(set)
    for r in sharding.kd_shards(docs, shards=2).collect():
        shards[r["shard"]].add(r["doc_id"] % 40)
    assert len(shards) == 2 and len(set.intersection(*shards.values())) <= 1


def test_subtrees_finished_in_tasks_agree(spark, monkeypatch):
    rng = random.Random(5)
    rows = [(i, rng.randrange(1, 500), rng.randrange(2**48), rng.randrange(2**47)) for i in range(400)]
    df = spark.createDataFrame(rows, "i int, _bytes long, _d0 long, _d1 long")
    far = {r["i"]: r["shard"] for r in sharding.kd_leaves(df, ["_d0", "_d1"], 23).collect()}
    monkeypatch.setattr(sharding, "LOCAL_NODES", 3)
    near = {r["i"]: r["shard"] for r in sharding.kd_leaves(df, ["_d0", "_d1"], 23).collect()}
    assert far == near and len(set(far.values())) == 23
