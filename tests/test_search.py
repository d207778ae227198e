"""Nearest neighbours by blocks, postings and cover density against plain versions, batched answers."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from codexmill.functions import fulltext
from codexmill.operators import knn, postings, retrieval
from codexmill.plans import answer, service


def plain_lexemes(parts, stops=frozenset(), stemmed=True):
    out, pos = [], 0
    for text, weight in parts:
        for w in re.findall(r"[^\W_]+", (text or "").lower()):
            pos += 1
            if w not in stops:
                out.append((fulltext.stem(w) if stemmed else w, pos, weight))
    return out


def plain_cover_density(entries, query):
    """Shortest stretches with all words, by trying every one."""
    hits = sorted((p, a, w) for a, p, w in entries if a in query)
    whole = lambda i, j: {a for _, a, _ in hits[i : j + 1]} == query
    total = 0.0
    for i in range(len(hits)):
        for j in range(i, len(hits)):
            if query and whole(i, j) and not whole(i + 1, j) and not whole(i, j - 1):
                inside = hits[i : j + 1]
                noise = hits[j][0] - hits[i][0] - (len(inside) - 1)
                total += len(inside) / sum(1 / w for _, _, w in inside) / (1 + max(0, noise))
    return total / (total + 1)


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(6)
    words = ["труд", "труда", "работник", "и", "закон", "a1", "b", "zz_top", "Ёж"]
    rows = [(i, " ".join(rng.choice(words) for _ in range(rng.randrange(4))), None if i % 9 == 0 else " - ".join(rng.choice(words) for _ in range(rng.randrange(25)))) for i in range(60)]
    return rows, spark.createDataFrame(rows, "chunk_id long, title string, text string").repartition(5)


STOPS = frozenset({"и"})


@pytest.mark.parametrize("stemmed", [True, False])
def test_lexemes_equal_plain(corpus, stemmed):
    rows, df = corpus
    got = df.select("chunk_id", fulltext.lexeme_column([(F.col("title"), 1.0), (F.col("text"), 0.1)], STOPS, stemmed).alias("e")).collect()
    want = {i: plain_lexemes([(a, 1.0), (b, 0.1)], STOPS, stemmed) for i, a, b in rows}
    assert {r["chunk_id"]: [tuple(e) for e in r["e"]] for r in got} == want


def test_postings_match_and_rank_as_plain(spark, corpus):
    rows, df = corpus
    held = postings.index(df.withColumn("lexemes", fulltext.lexeme_column([(F.col("title"), 1.0), (F.col("text"), 0.1)], STOPS)))
    asked = {0: ["труд"], 1: ["труд", "закон", "труд"], 2: ["a1", "b", "работник"], 3: [], 4: ["nowhere"], 5: None, 6: ["zz", "top"], 7: ["nowhere", "труд"]}
    queries = spark.createDataFrame(list(asked.items()), "query_id long, terms array<string>")
    want = {}
    for i, a, b in rows:
        e = plain_lexemes([(a, 1.0), (b, 0.1)], STOPS)
        for q, terms in asked.items():
            if terms and set(terms) <= {x for x, _, _ in e}:
                want[q, i] = plain_cover_density(e, set(terms))
    got = {(r["query_id"], r["chunk_id"]): r["keyword_score"] for r in postings.ranked(held, queries).collect()}
    assert got == pytest.approx(want, abs=1e-9) and len(want) > 40
    best = retrieval.keyword_candidates(held, queries, 3).collect()
    for q in asked:
        first = sorted(((-round(s, 9), i) for (p, i), s in want.items() if p == q))[:3]
        assert sorted(r["chunk_id"] for r in best if r["query_id"] == q) == sorted(i for _, i in first)
    assert postings.ranked(postings.index(df.withColumn("lexemes", F.array().cast(fulltext.LEXEMES))), queries).count() == 0


def test_keyword_search_reads_no_corpus_and_no_python(spark, corpus, tmp_path):
    _, df = corpus
    lexemes = fulltext.lexeme_column([(F.col("text"), 0.1)], stemmed=False)
    postings.dealt(postings.index(df.select("chunk_id", lexemes.alias("lexemes")))).write.partitionBy("bucket").parquet(str(tmp_path / "p"))
    held = spark.read.parquet(str(tmp_path / "p"))
    plan = postings.ranked(held, spark.createDataFrame([(0, ["a"])], "query_id long, terms array<string>"))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_packed_postings_are_the_plain_ones(spark, corpus):
    _, df = corpus
    lexemes = fulltext.lexeme_column([(F.col("title"), 1.0), (F.col("text"), 0.1)], STOPS)
    rows = df.select(F.when(F.col("chunk_id") != 4, F.col("chunk_id")).alias("chunk_id"), "title", F.when(F.col("chunk_id") != 5, lexemes).alias("lexemes"))
    plain, packed = postings.dealt(postings.index(rows, also=("title",))), postings.folders(rows, also=("title",))
    assert packed.schema == plain.schema and packed.count() > 100
    assert sorted(packed.collect(), key=str) == sorted(plain.collect(), key=str)
    assert postings.folders(rows.filter("false")).count() == 0 == postings.folders(rows.filter("chunk_id = 5")).count()


def test_ranks_that_differ_by_their_sums_order_are_ties(spark):
    rows = spark.createDataFrame([(0, 5, 0.1 + 0.2 + 0.3), (0, 2, 0.3 + 0.2 + 0.1), (0, 1, 0.5)], "query_id long, chunk_id long, keyword_score double")
    assert [r["chunk_id"] for r in postings.best(rows, 1).collect()] == [2]


def test_an_index_of_few_queries_holds_only_their_terms(spark):
    held = spark.createDataFrame([("a", 1, None), ("b", 1, None), ("c", 1, None), (None, 2, None), ("a", 3, None)], "term string, chunk_id long, places string")
    asked = spark.createDataFrame([(7, ["b", "a", "a"]), (8, ["a", "b"]), (9, []), (10, None)], "query_id long, terms array<string>")
    kept = postings.of_terms_asked(held, asked)
    assert sorted((r["term"], r["chunk_id"]) for r in kept.collect()) == [("a", 1), ("a", 3), ("b", 1)]
    assert sorted((r["query_id"], r["chunk_id"]) for r in postings.match(kept, asked).collect()) == [(7, 1), (8, 1)]


def test_rows_are_shuffled_once_however_many_queries_meet_them(spark):
    held = spark.createDataFrame([("a", 1, None)], "term string, chunk_id long, places string")
    asked = spark.createDataFrame([(7, ["a"])], "query_id long, terms array<string>")
    plan = postings.match(held, asked)._jdf.queryExecution().executedPlan().toString()
    assert not re.search(r"hashpartitioning\(query_id#\d+L?, chunk_id", plan)


def test_words_are_split_once_for_the_rows_a_join_keeps(spark):
    few = spark.createDataFrame([(1,)], "chunk_id long")
    docs = spark.createDataFrame([(1, "a b"), (2, "c"), (3, None)], "chunk_id long, text string")
    lexemes = fulltext.lexeme_column([(F.col("text"), 0.1)], stemmed=False)
    held = postings.index(docs.join(few, "chunk_id", "left_semi").select("chunk_id", lexemes.alias("lexemes")))
    assert held._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract_all") == 1
    assert sorted(r["term"] for r in held.collect()) == ["a", "b"]


def test_queries_of_the_same_terms_are_ranked_once(spark):
    asked = spark.createDataFrame([(7, ["b", "a", "a"]), (8, ["a", "b"]), (9, ["a"]), (10, []), (11, None)], "query_id long, terms array<string>")
    assert sorted((r["query_id"], r["same_as"]) for r in postings.same_terms(asked).collect()) == [(7, 7), (8, 7), (9, 9)]


def plain_nearest(rows, queries, k):
    out = []
    for q, v in queries:
        near = []
        for i, x in rows:
            if x is not None and v is not None and len(x) == len(v) and np.linalg.norm(x) > 0 and np.linalg.norm(v) > 0 and np.isfinite(x).all():
                near.append((round(1 - float(np.dot(x, v)) / float(np.linalg.norm(x) * np.linalg.norm(v)), 9), i))
        out += [(q, i, n + 1) for n, (_, i) in enumerate(sorted(near)[:k])]
    return sorted(out)


@pytest.mark.parametrize(("block", "held"), [(4096, 1 << 22), (7, 1 << 22), (7, 10)])
def test_nearest_by_blocks_equals_plain(spark, monkeypatch, block, held):
    monkeypatch.setattr(knn, "BLOCK", block)
    monkeypatch.setattr(knn, "HELD", held)
    rng = np.random.default_rng(3)
    rows = [(int(i), rng.integers(-3, 4, 4).astype(float).tolist()) for i in rng.permutation(150)] + [(900, None), (901, [0.0] * 4), (902, [1.0, 2.0]), (903, [float("nan")] * 4), (904, [])]
    queries = [(i, v) for i, v in rows if i % 5 == 0] + [(1000, None), (1001, [1.0, 1.0])]
    df = spark.createDataFrame([(i, v, 1) for i, v in rows], "chunk_id long, embedding array<double>, rank int").repartition(6)
    q = spark.createDataFrame(queries, "query_id long, embedding array<double>").repartition(3)
    got = retrieval.nearest_batch(df, q, 4)
    assert sorted((r["query_id"], r["chunk_id"], r["rank"]) for r in got.collect()) == plain_nearest(rows, queries, 4)
    assert got._jdf.queryExecution().toString().count("Scan ExistingRDD[chunk_id") <= 2  # once in each plan that is printed


def test_nearest_with_names_as_ids(spark):
    df = spark.createDataFrame([("b", [1.0, 0.0]), ("a", [2.0, 0.0]), ("c", [0.0, 1.0])], "chunk_id string, embedding array<float>")
    got = retrieval.nearest_batch(df, df.withColumnRenamed("chunk_id", "query_id"), 2)
    assert sorted((r["query_id"], r["rank"], r["chunk_id"]) for r in got.collect()) == [("a", 1, "a"), ("a", 2, "b"), ("b", 1, "a"), ("b", 2, "b"), ("c", 1, "c"), ("c", 2, "a")]


class Shaky:
    """Answers by the question's last word; fails once on "later" and always on "never"."""

    def __init__(self):
        self.seen = set()

    def __call__(self, system, prompt):
        if "never" in prompt or ("later" in prompt and not ("later" in self.seen or self.seen.add("later"))):
            raise OSError("down")
        return f"{len(system)}:{'Источник 1' in prompt}"


def test_a_table_of_questions(spark):
    texts = ["труд и закон", "отпуск работника", "later"]
    docs = spark.createDataFrame([(1, "f.txt", "T")], "document_id long, filename string, title string")
    chunks = service.corpus(docs, spark.createDataFrame([(i, 1, i, t, None, None, None, None, None, None, None, None, []) for i, t in enumerate(texts)], "chunk_id long, document_id long, chunk_index int, content string, article_number string, article_title string, section_title string, subsection_title string, chapter_title string, paragraph_title string, source_format string, source_filename string, referenced_articles array<string>").withColumn("embedding", service.embed_column(F.col("content"))), frozenset())
    asked = spark.createDataFrame([(0, "отпуск"), (1, " "), (2, None), (3, "later"), (4, "never")], "query_id long, query string").repartition(2)
    got = {r["query_id"]: r for r in service.answer_batch(spark, chunks.cache(), asked, Shaky, 2, "P", stops=frozenset()).collect()}
    assert sorted(got) == [0, 1, 2, 3, 4]
    assert got[0]["answer"].endswith(":True") and got[0]["error"] is None and got[0]["sources"][0]["filename"] == "f.txt"
    assert got[3]["attempts"] == 2 and got[3]["answer"] and got[3]["error"] is None
    assert got[4]["answer"] is None and got[4]["error"] == "OSError: down" and got[4]["attempts"] == 3
    assert got[1]["error"] == got[2]["error"] == "query must not be empty" and got[1]["attempts"] == 0
    with pytest.raises(answer.LLMConfigurationError):
        answer.no_llm("", "")


def _shuffled(df):
    """Records that the shuffles of a plan that was run wrote."""
    def walk(node):
        kind = node.getClass().getSimpleName()
        if kind == "AdaptiveSparkPlanExec":
            return walk(node.executedPlan())
        below = [node.plan()] if kind.endswith("QueryStageExec") else [node.children().apply(i) for i in range(node.children().size())]
        own = node.metrics().get("shuffleRecordsWritten")
        return (own.get().value() if own.isDefined() else 0) + sum(map(walk, below))

    return walk(df._jdf.queryExecution().executedPlan())


def test_only_rows_with_a_rarest_term_are_gathered(spark):
    """A frequent term's postings of rows without the rare one are not shuffled, whatever their number."""
    common = spark.range(3000).select(F.lit("common").alias("term"), F.col("id").alias("chunk_id"), F.lit(None).cast("string").alias("places"))
    rare = spark.createDataFrame([("rare", 7, None), ("rare", None, None), ("common", None, None), ("rare", 5000, None)], "term string, chunk_id long, places string")
    queries = spark.createDataFrame([(1, ["common", "rare"]), (2, ["absent", "common"])], "query_id long, terms array<string>")
    found = postings.match(common.union(rare), queries).select("query_id", "chunk_id")
    assert sorted(map(tuple, found.collect()), key=str) == [(1, 7), (1, None)]
    assert _shuffled(found) < 300
