"""Line dedup, substring dedup, near duplicates, quality, language: brute force and edge cases."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from codexmill.llm import common, graph, langid, line_dedup, minhash, quality, substring_dedup, textbytes

WS = " \t\n\x0b\x0c\r"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def frame(spark, rows, extra=False):
    if extra:
        return spark.createDataFrame([(i, t, "x", 1, 2, 3, "y") for i, t in rows], "doc_id long, text string, id string, n_lines int, n long, component_id int, bucket string")
    return spark.createDataFrame(rows, "doc_id long, text string")


def corpus(seed, n=60):
    rng = random.Random(seed)
    words = [f"w{i}é" for i in range(400)]
    passage = " ".join(rng.choice(words) for _ in range(60))
    line = "the very same long line that many documents hold"
    rows = []
    for i in range(n):
        t = [" ".join(rng.choice(words) for _ in range(rng.randrange(3, 70))) for _ in range(rng.randrange(1, 4))]
        if i % 4 == 0:
            t.insert(rng.randrange(len(t) + 1), passage)
        if i % 3 == 0:
            t.insert(rng.randrange(len(t) + 1), rng.choice([line, line.upper(), f" {line}\t"]))
        rows.append((i, "\n".join(t)))
    near = rows[5][1].split(" ")
    for i in range(n, n + 12):  # near copies at several distances
        w = list(near)
        for _ in range((i - n) // 2):
            w[rng.randrange(len(w))] = f"z{i}"
        rows.append((i, " ".join(w)))
    return [*rows, (n + 12, rows[7][1]), (n + 13, rows[7][1]), (n + 14, None), (n + 15, ""), (n + 16, " \n\t"), (n + 17, "one two"), (n + 18, "One  two"), (n + 19, "x " * 9000), (n + 20, rows[9][1]), (n + 20, rows[9][1])]


def plain_lines(rows, least=40, docs=5):
    key = lambda x: "".join(c.lower() if "A" <= c <= "Z" else c for c in x.strip(WS))
    split = [(i, (t or "").split("\n")) for i, t in rows]
    holders = {}
    for i, ls in split:
        for x in ls:
            if len(key(x)) >= least:
                holders.setdefault(key(x), set()).add(i)
    gone = {k: max(v) for k, v in holders.items() if len(v) >= docs}
    out = []
    for i, ls in split:
        kept = [x for x in ls if key(x) not in gone or gone[key(x)] == i]
        out.append((i, len(ls), len(ls) - len(kept), "\n".join(kept)))
    return sorted(out)


@pytest.mark.parametrize("extra", [False, True])
def test_line_dedup(spark, extra):
    rows = corpus(1)
    df = frame(spark, rows, extra)
    got = line_dedup.line_dedup(df)
    assert sorted((r["doc_id"], r["n_lines"], r["n_dropped"], r["text"] or "") for r in got.collect()) == plain_lines(rows)
    if extra:
        assert set(df.columns) <= set(got.columns)


def test_line_dedup_edges(spark):
    assert line_dedup.line_dedup(frame(spark, [])).count() == 0
    line = "L" * 40
    rows = [(i, f"{line}\n{line.lower()}") for i in range(5)] + [(None, line), (9, line[:39])]
    got = {r["doc_id"]: (r["n_dropped"], r["text"]) for r in line_dedup.line_dedup(frame(spark, rows)).collect()}
    assert got[0] == (2, "") and got[4] == (0, f"{line}\n{line.lower()}") and got[None] == (1, "") and got[9][0] == 0
    four = frame(spark, [(i % 4, line) for i in range(8)])  # repeated rows count once
    assert {r["n_dropped"] for r in line_dedup.line_dedup(four).collect()} == {0}


def plain_repeats(rows, window):
    words = [(i, WORD.findall(t or "")) for i, t in rows]
    seen = Counter(tuple(w[k : k + window]) for _, w in words for k in range(len(w) - window + 1))
    out = []
    for i, w in words:
        gone = set()
        for k in range(len(w) - window + 1):
            if seen[tuple(w[k : k + window])] > 1:
                gone |= set(range(k, k + window))
        out.append((i, len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone)))
    return sorted(out)


@pytest.mark.parametrize("window", [35, 6, 2])
def test_substring_dedup(spark, window):
    rows = corpus(2)
    got = substring_dedup.remove_repeats(frame(spark, rows, window == 6), window=window).collect()
    assert sorted((r["id"], r["n_words"], r["n_removed"], r["kept_text"]) for r in got) == plain_repeats(rows, window)
    for r in got:
        assert sum(s["to"] - s["from"] for s in r["spans"]) == r["n_removed"]


def test_substring_dedup_edges(spark, monkeypatch):
    assert substring_dedup.remove_repeats(frame(spark, [])).count() == 0
    assert substring_dedup.scale(10**9)[0] == 239
    for total in (10**9, 10**11, 10**14, 10**16):  # what a task holds stays bounded at any size
        buckets, bits = substring_dedup.scale(total)
        assert total / buckets <= 16 << 20 and total / 6 / (1 << bits) <= 4 << 20
    monkeypatch.setattr(substring_dedup, "scale", lambda total: (7, 3))  # many buckets and parts
    rows = corpus(3)
    got = substring_dedup.remove_repeats(frame(spark, [*rows, (None, rows[0][1])])).collect()
    assert sorted((r["id"] if r["id"] is not None else -1, r["n_removed"]) for r in got) == [(i, n) for i, _, n, _ in plain_repeats([*rows, (-1, rows[0][1])], 35)]


@pytest.mark.parametrize("short", [["one two three"], [""], [None], ["a b c", " ".join(map(str, range(17)))], ["word", None, "", "word"]])
def test_substring_dedup_of_short_texts_alone(spark, short):
    rows = list(enumerate(short))
    got = substring_dedup.remove_repeats(frame(spark, rows)).collect()
    assert sorted((r["id"], r["n_words"], r["n_removed"], r["kept_text"]) for r in got) == plain_repeats(rows, 35)


def test_substring_dedup_of_a_short_bucket_beside_long_ones(spark, monkeypatch):
    monkeypatch.setattr(substring_dedup, "scale", lambda total: (40, 2))  # buckets of one or two rows
    long = " ".join(f"w{i}" for i in range(40))
    rows = [(1, long), (2, "x " + long), *((i, "short text") for i in range(3, 20)), (20, None), (21, "")]
    got = substring_dedup.remove_repeats(frame(spark, rows)).collect()
    assert sorted((r["id"], r["n_words"], r["n_removed"], r["kept_text"]) for r in got) == plain_repeats(rows, 35)


def test_substring_dedup_parts_rows_that_are_all_alike(spark, monkeypatch):
    monkeypatch.setattr(substring_dedup, "scale", lambda total: (50, 1))
    text = " ".join(f"w{i}" for i in range(36))
    rows = [(None, text)] * 24
    got = substring_dedup.remove_repeats(frame(spark, rows)).collect()
    assert [(r["n_words"], r["n_removed"], r["kept_text"]) for r in got] == [(36, 36, "")] * 24


def plain_components(rows):
    def shingles(t):
        w = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
        return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())

    sets = [(i, shingles(t)) for i, t in rows]
    lead = {i: i for i, _ in rows}

    def root(x):
        while lead[x] != x:
            x = lead[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            (i, x), (j, y) = sets[a], sets[b]
            if x and y and 100 * len(x & y) >= 75 * len(x | y):
                p, q = root(i), root(j)
                lead[max(p, q)] = min(p, q)
    return sorted((i, len(s), root(i), root(i) == i) for i, s in sets)


@pytest.mark.parametrize("seed", [4, 5])
def test_near_duplicates(spark, seed):
    rows = corpus(seed)
    got = minhash.near_duplicates(frame(spark, rows, seed == 5)).collect()
    assert sorted((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in got) == plain_components(rows)


def test_near_duplicates_that_centres_do_not_join(spark):
    """Chains and groups around a far centre: links found by shared differences alone."""
    rng = random.Random(6)
    base = [f"b{i}" for i in range(60)]
    rows = [(0, " ".join(base))]
    for g in range(1, 8):
        far = list(base)
        for k in range(4):
            far[(g * 7 + k * 13) % 60] = f"g{g}{k}"
        rows.append((g * 10, " ".join(far)))
        for j in range(1, 5):
            w = list(far)
            w[rng.randrange(60)] = f"j{g}{j}"
            rows.append((g * 10 + j, " ".join(w)))
    got = minhash.near_duplicates(frame(spark, rows)).collect()
    want = plain_components(rows)
    assert len({r[2] for r in want}) > 3
    assert sorted((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in got) == want


def test_near_duplicates_of_families_with_shared_passages(spark):
    """Many far members of one centre, few of them linked: what is shared is common to most."""
    rng = random.Random(12)
    shared = [f"s{i}" for i in range(60)]
    rows = []
    for g in range(40):
        own = [f"o{g}_{i}" for i in range(20)]
        rows.append((10 * g, " ".join(shared + own)))
        for j in range(1, 1 + g % 3):
            w = shared + own
            for _ in range(1 + 2 * j):
                w[rng.randrange(len(w))] = f"e{g}_{j}_{rng.randrange(99)}"
            rows.append((10 * g + j, " ".join(w)))
    got = minhash.near_duplicates(frame(spark, rows)).collect()
    want = plain_components(rows)
    assert 40 <= len({r[2] for r in want}) < len(rows)
    assert sorted((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in got) == want


def template_pages(m, template=160, own=40):
    """Pages of one template and words of their own: alike enough to share buckets, none linked."""
    same = " ".join(f"t{i}" for i in range(template))
    return [(j, same + " " + " ".join(f"o{j}_{k}" for k in range(own))) for j in range(m)]


def test_pages_of_one_template_are_not_compared_with_each_other(spark, monkeypatch):
    seen, visits = [], minhash._visits

    def counted(probes, labels, percent):
        rows, goes = visits(probes, labels, percent)
        seen.append((rows.count(), goes.count()))
        return rows, goes

    monkeypatch.setattr(minhash, "_visits", counted)
    got = minhash.near_duplicates(frame(spark, template_pages(80))).collect()
    assert all(r["kept"] and r["component_id"] == r["doc_id"] for r in got)
    assert sum(r for r, _ in seen) > 80 and sum(g for _, g in seen) == 0


def test_a_second_group_of_copies_grows_around_a_centre_of_its_own(spark, monkeypatch):
    """Pages linked with each other but not with their bucket's first centre: as many pairs as pages."""
    pages = template_pages(1) + [(i, t + " " + " ".join(f"x{k}" for k in range(30))) for i, t in template_pages(31, 160, 8)[1:]]
    compared, confirm = [], minhash.confirm
    monkeypatch.setattr(minhash, "confirm", lambda pairs, docs, percent: compared.append(pairs.count()) or confirm(pairs, docs, percent))
    got = minhash.near_duplicates(frame(spark, pages)).collect()
    assert sorted((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in got) == plain_components(pages)
    assert {r["component_id"] for r in got} == {0, 1} and sum(compared) <= 4 * len(pages)


def test_near_duplicates_edges(spark):
    assert minhash.near_duplicates(frame(spark, [])).count() == 0
    got = {r["doc_id"]: r for r in minhash.near_duplicates(frame(spark, [(None, "a b c d e f"), (3, "A b c d e f"), (4, None), (5, "")])).collect()}
    assert got[3]["kept"] and got[None]["component_id"] == 3 and not got[None]["kept"] and got[4]["component_id"] == 4 and got[5]["n_shingles"] == 0


def test_circulant_agrees_with_jaccard():
    rng = np.random.default_rng(0)
    scheme = minhash.Circulant()
    both, own = rng.integers(0, 2**64, 300, dtype=np.uint64), rng.integers(0, 2**64, (2, 50), dtype=np.uint64)
    a, b = (scheme.signature(np.unique(np.concatenate([both, x]))) for x in own)
    assert abs((a == b).mean() - 0.75) < 0.12
    assert (scheme.keys(a) == scheme.keys(b)).any()


def test_components_of_a_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (7, 7)], "a long, b long")
    got = {r["id"]: r["component"] for r in graph.components(edges, "a", "b").collect()}
    assert {got[i] for i in range(41)} == {0} and got[101] == 100
    assert graph.components(edges.limit(0), "a", "b").count() == 0


def test_word_hashes_of_long_texts(monkeypatch):
    text = ("alpha beta\tgamma\n" * 500).encode()
    whole = textbytes.words(np.frombuffer(text, np.uint8))[0]
    monkeypatch.setattr(textbytes, "BLOCK", 64)
    assert (textbytes.words(np.frombuffer(text, np.uint8))[0] == whole).all() and len(set(whole.tolist())) == 3
    assert (textbytes.long_grams(whole, 7)[::3] == textbytes.long_grams(whole, 7)[0]).all()
    up = textbytes.words(np.frombuffer(b"ABC", np.uint8), lower=True)[0]
    assert up == textbytes.words(np.frombuffer(b"abc", np.uint8))[0]


def plain_base(t):
    t = t or ""
    w = WORD.findall(t)
    three = Counter(tuple(w[k : k + 3]) for k in range(len(w) - 2))
    again = {j for k in range(len(w) - 2) if three[tuple(w[k : k + 3])] > 1 for j in (k, k + 1, k + 2)}
    seen, dup = set(), 0
    for x in t.split("\n"):
        if WORD.search(x):
            dup += x in seen
            seen.add(x)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(again)


def quality_rows():
    rng = random.Random(9)
    good = lambda: " ".join(rng.choice(["river", "stone", "lamp", "cloud", "paper", "green", "walks", "under"]) + str(rng.randrange(30)) for _ in range(70)) + "."
    rows, labels = [], []
    for i in range(160):
        t, q, x = good(), 1, 0
        if i % 4 == 1:
            t, q = t.upper().replace(" ", "!! "), 0
        if i % 4 == 3:
            w = t.split()
            w[rng.randrange(len(w))] = "nastyword"
            t, x = " ".join(w), 1
        rows.append((i, t))
        labels.append((i, q, x))
    return rows, labels


def test_quality(spark):
    rows, labels = quality_rows()
    extra = [(1000, None), (1001, ""), (1002, "a b\na b\n\n \na b"), (1003, "é# " * 40 + "x|y"), (1003, "é# " * 40 + "x|y"), (None, rows[0][1]), (1004, "word " * 30000)]
    docs = frame(spark, rows + extra)
    lab = spark.createDataFrame([*labels, (None, 1, 0), (5000, 0, 0), (0, 1, 0), (1, None, 1)], "doc_id long, quality int, toxic int")
    heads = quality.train(docs, lab)
    got = quality.score(docs, heads).collect()
    assert len(got) == len(rows) + len(extra)
    text = dict(rows + extra)
    for r in got:
        figures = plain_base(text[r["doc_id"]])
        assert tuple(r[c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")) == figures
        assert r["base_failed"] == (figures[0] < 50 or 100 * figures[4] > 50 * figures[0])
        assert not (r["base_failed"] and r["kept"]) and 0 <= r["p_low"] <= 1 and 0 <= r["p_toxic"] <= 1
    kept = {r["doc_id"] for r in got if r["kept"]}
    assert sum(i in kept for i, q, x in labels if q and not x) >= 78 and sum(i in kept for i, q, x in labels if not q or x) <= 2
    wide = docs.withColumn("kept", F.lit("clash")).withColumn("n_words", F.lit(1))
    passed = quality.score(wide, heads, passing=True)
    assert passed.columns == wide.columns and {r["doc_id"] for r in passed.collect()} == kept
    assert quality.score(docs.limit(0), heads).count() == 0
    # without labels only the base rules decide
    free = quality.train(docs, lab.limit(0))
    assert all(r["kept"] != r["base_failed"] for r in quality.score(docs, free).collect())


def held(i):
    return zlib.crc32(str(i).encode()) % 4 == 2


def test_langid(spark):
    rng = random.Random(3)
    syl = {"aa": ["ka", "ro", "mi", "tu"], "bb": ["sch", "ein", "ung", "ber"], "cc": ["éau", "oi", "eux", "çon"]}
    rows = [(i, " ".join("".join(rng.choice(syl[k]) for _ in range(rng.randrange(1, 4))) for _ in range(rng.randrange(3, 40))), k) for i in range(240) for k in [list(syl)[i % 3]]]
    rows += [(1000, None, "aa"), (1001, "12 34 !?", "aa"), (1002, "", None), (1003, "karo mitu", None), (None, "schein ung", "bb"), (1004, "KAROMI " * 40000, None), (1003, "karo mitu", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    is_held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))
    model = langid.fit(df.filter(~is_held))
    got = langid.predict(df.withColumn("score", F.lit("clash")), model).collect()
    pred = {r["doc_id"]: r for r in got}
    test = [(i, k) for i, _, k in rows if i is not None and i < 240 and held(i)]
    assert len(got) == len(rows) and np.mean([pred[i]["lang_pred"] == k for i, k in test]) > 0.95
    assert all(pred[i]["lang_pred"] == "und" and pred[i]["score"] == 0 for i in (1000, 1001, 1002))
    assert pred[1003]["lang_pred"] == "aa" == pred[1004]["lang_pred"] and pred[None]["lang_pred"] == "bb"
    assert all(0 <= r["score"] <= 1 for r in got)
    hidden = langid.predict(df.withColumn("lang", F.lit("zz")), model).collect()
    assert {r["doc_id"]: r["lang_pred"] for r in hidden} == {k: r["lang_pred"] for k, r in pred.items()}
    none = langid.fit(df.limit(0))
    assert {r["lang_pred"] for r in langid.predict(df, none).collect()} == {"und"} and langid.predict(df.limit(0), model).count() == 0


def test_folded_scores_equal_kernel_scores():
    """Scoring by the folded matrix equals the kernel against every landmark."""
    texts = ["kara miro", "karo mi", "schein ung", "ein ung ber", "ka ro", "sch ung"]
    rows, langs = np.array([langid.presence(t) for t in texts]), ["a", "a", "b", "b", "a", "b"]
    model = langid.fit_rows(rows.astype(np.uint8), langs)
    x = rows.astype(float)
    k = (x @ x.T) / np.sqrt(np.outer(x.sum(1), x.sum(1)))
    assert np.allclose(np.diag(k), 1)
    s = model.scores(rows)
    assert [model.languages[i] for i in s.argmax(1)] == langs
    whole = np.linalg.lstsq(np.c_[k, np.ones(6)], s, rcond=None)[0]
    assert np.allclose(np.c_[k, np.ones(6)] @ whole, s, atol=1e-4)


def test_fit_agrees_with_plain_kernel_ridge():
    """Scores of the folded model against kernels of sets, a Nystrom map and ridge by least squares."""
    rng = random.Random(8)
    syl = {"a": "ka ro mi tu la".split(), "b": "sch ein ung ber ka".split(), "c": "oi eux ro ment la".split()}
    texts = [("".join(rng.choice(syl[k]) for _ in range(3)) + " " + "".join(rng.choice(syl[k]) for _ in range(rng.randrange(1, 5))), k) for k in "aabbbccc" * 5]
    fresh = ["karo schein", "laro oiment", "ein", "zzz"]
    rows, langs = np.array([langid.presence(t) for t, _ in texts]), [k for _, k in texts]
    model = langid.fit_rows(rows.astype(np.uint8), langs, landmarks=9)
    sets = [frozenset(np.flatnonzero(r).tolist()) for r in rows]
    kernel = lambda x, z: len(x & z) / np.sqrt(max(1, len(x)) * max(1, len(z)))
    marks = [sets[i] for k in "abc" for i in [j for j, v in enumerate(langs) if v == k][:3]]
    inside = np.array([[kernel(x, z) for z in marks] for x in marks])
    values, vectors = np.linalg.eigh(inside)
    good = values > 1e-6
    root = (vectors[:, good] / np.sqrt(values[good])) @ vectors[:, good].T  # the symmetric inverse root
    place = lambda xs: np.array([[kernel(x, z) for z in marks] for x in xs]) @ root
    f = place(sets)
    w = np.array([1 / langs.count(k) for k in langs])
    w /= w.sum()
    y = np.where(np.array(langs)[:, None] == np.array(["a", "b", "c"]), 1.0, -1.0)
    # weighted squares with a free intercept, plus ridge on the rest: one least-squares problem
    top = np.c_[f, np.ones(len(f))] * np.sqrt(w)[:, None]
    low = np.c_[np.eye(f.shape[1]) * np.sqrt(langid.RIDGE / len(f)), np.zeros(f.shape[1])]
    coef = np.linalg.lstsq(np.r_[top, low], np.r_[y * np.sqrt(w)[:, None], np.zeros((f.shape[1], 3))], rcond=None)[0]
    new = [langid.presence(t) for t in [t for t, _ in texts] + fresh]
    want = np.c_[place([frozenset(np.flatnonzero(r).tolist()) for r in new]), np.ones(len(new))] @ coef
    assert np.allclose(model.scores(np.array(new)), want, atol=2e-3)


def test_many_languages_share_the_bound_of_rows(spark, monkeypatch):
    monkeypatch.setattr(langid, "ROWS", 60)
    rows = [(i, f"{chr(97 + i % 25)}{chr(98 + i % 25)}" * 6, f"l{i % 25:02d}") for i in range(250)]
    model = langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert len(model.languages) == 25


def test_fit_head_reaches_the_optimum_of_plain_l1_logistic_regression():
    rng = np.random.default_rng(4)
    size, n, l1 = 12, 150, 0.01
    x = (rng.random((n, size)) < 0.4) * rng.random((n, size))
    y = (x[:, 0] - x[:, 1] + 0.3 * rng.normal(size=n) > 0).astype(float)
    rows = [(np.flatnonzero(r), r[np.flatnonzero(r)]) for r in x]
    head = quality.fit_head(rows, y, size, l1=l1, steps=3000)
    train = np.arange(n) % 5 != 4
    a, t = x[train], y[train]
    w = np.where(t == 1, 0.5 / t.mean(), 0.5 / (1 - t.mean())) / len(t)
    theta, bias = np.zeros(size), 0.0
    for _ in range(20000):  # plain proximal gradient
        g = w * (1 / (1 + np.exp(-(a @ theta + bias))) - t)
        theta, bias = theta - 2 * (a.T @ g), bias - 2 * g.sum()
        theta = np.sign(theta) * np.maximum(0, np.abs(theta) - 2 * l1)
    assert np.allclose(head.weights, theta, atol=5e-3) and abs(head.bias - bias) < 5e-3
    assert (head.weights == 0).any() and (head.weights != 0).any()
    # Platt scaling on the rows held out: no slope or offset near it fits their soft labels better
    m, soft = x[~train] @ head.weights + head.bias, y[~train]
    up, down = (soft.sum() + 1) / (soft.sum() + 2), 1 / (len(soft) - soft.sum() + 2)
    goal = np.where(soft == 1, up, down)
    loss = lambda s, o: float((np.logaddexp(0, s * m + o) - goal * (s * m + o)).sum())
    best = loss(head.slope, head.offset)
    assert all(best <= loss(head.slope + p, head.offset + q) + 1e-6 for p in (-0.05, 0, 0.05) for q in (-0.05, 0, 0.05))


def test_features_count_every_gram_and_word():
    text = "Abc abc, abd! zé" * 7
    low, toxic = quality.features(np.frombuffer(text.encode(), np.uint8))
    b = text.encode()
    freq = low[1][low[0] < 1 << quality.FREQ_BITS]
    assert np.isclose(((freq / 10) ** 2).sum() * len(b), 2 * len(b) - 3)  # all 2- and 3-grams, each once
    named = len(set(re.split(rb"[^a-z\x80-\xff]+", b.lower())) - {b""})
    assert (low[0] >= 1 << quality.FREQ_BITS).sum() == named == (toxic[0] < 1 << quality.WORD_BITS).sum()
    fives = {b.lower()[i : i + 5] for i in range(len(b) - 4)}
    assert (toxic[0] >= 1 << quality.WORD_BITS).sum() == len(fives) and set(toxic[1]) == {1.0}


def test_presence_of_blocks(monkeypatch):
    text = "Ünder  the-bridge 42 of Straße " * 50
    whole = langid.presence(text)
    monkeypatch.setattr(langid, "BLOCK", 37)
    assert (langid.presence(text) == whole).all()


def test_shared_dir_and_size_checks(spark):
    assert common.shared_dir(spark)
    ids = spark.range(50)
    assert common.small_or_shuffled(ids, 10).count() == 50
    assert common.spread(ids.limit(1), salts=3).count() == 3


