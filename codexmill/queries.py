"""The driver's queries of the document-retrieval operators, each with its SQL where SQL can say it."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .config import scratch_dir
from .functions import fulltext, references, text
from .operators import chunking, evaluation, history, inspection, postings, retrieval, structure
from .plans import answer, service
from .sources import files

K = 10
SIZE = 1200


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _values(spark: SparkSession, rows: list[tuple], names: list[str]) -> DataFrame:
    return spark.createDataFrame(rows, ", ".join(f"{n} {'long' if isinstance(rows[0][i], int) else 'string'}" for i, n in enumerate(names)))


# retrieval over embeddings

def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("chunk_id"), "embedding", "label")


def _vector_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "embeddings").filter(F.col("vec_id") % 100 == 0).select(F.col("vec_id").alias("query_id"), "embedding", "label")


def knn_semantic(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _vectors(spark, sf_dir)
    query = rows.filter(F.col("chunk_id") == 0).first()["embedding"]
    near = retrieval.semantic_columns(retrieval.nearest(rows, query, K))
    rounded = [F.round(F.col(c), 6).alias(c) for c in ("distance", "semantic_score", "keyword_score", "article_boost", "document_boost", "similarity", "hybrid_score")]
    return near.select("chunk_id", *rounded)


def knn_batch_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    near = retrieval.nearest_batch(_vectors(spark, sf_dir), _vector_queries(spark, sf_dir), K)
    return near.select("query_id", "chunk_id", F.round("distance", 6).alias("distance"), F.col("rank").cast("long").alias("rank"))


def _tagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors with metadata of the document of the same id: ten documents an article, lang in the names."""
    docs = _table(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), F.floor(F.col("doc_id") / 10).cast("string").alias("article_number"), F.concat_ws(" ", "source", "lang").alias("names"))
    return _vectors(spark, sf_dir).join(docs, "chunk_id")


def hybrid_candidates_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _tagged(spark, sf_dir)
    queries = rows.filter(F.col("chunk_id") % 100 == 0).select(F.col("chunk_id").alias("query_id"), "embedding", "article_number")
    near = retrieval.nearest_batch(rows, queries, retrieval.candidate_limit(5)).select("query_id", "chunk_id")
    return near.union(retrieval.article_candidates(rows, queries)).distinct()


def hybrid_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _tagged(spark, sf_dir).withColumn("lexemes", F.array().cast(fulltext.LEXEMES))
    lang = F.substring_index("names", " ", -1)
    queries = rows.filter(F.col("chunk_id") % 100 == 0).select(F.col("chunk_id").alias("query_id"), "embedding", F.array().cast("array<string>").alias("terms"), "article_number", lang.alias("law_hint"))
    out = retrieval.hybrid(rows, queries, 5, aliases={x: (x,) for x in ("de", "en", "es", "fr")})
    return out.select("query_id", "chunk_id", *[F.round(c, 6).alias(c) for c in ("semantic_score", "keyword_score", "article_boost", "document_boost", "hybrid_score")], F.col("rank").cast("long").alias("rank"))


ALIASES = ["steel_", "%", "nickel", "large p", "_tin"]


def alias_exists_boost(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = _table(spark, sf_dir, "part")
    names = F.concat_ws(" ", "p_name", "p_brand", "p_type")
    some = F.array(*[F.lit(a) for a in ALIASES if a != "%"])
    return part.select("p_partkey", F.when(references.alias_like(names, some), F.lit(0.35)).otherwise(F.lit(0.0)).alias("document_boost"))


# documents and chunks


def _packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    parts = chunking.paragraphs(text.normalize_text(F.coalesce("text", F.lit(""))), "\n")
    return docs.select("doc_id", F.posexplode(chunking.pack(parts, SIZE)).alias("chunk_index", "content"))


def paragraph_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    parts = chunking.paragraphs(text.normalize_text(F.coalesce("text", F.lit(""))), "\n")
    out = docs.select("doc_id", F.posexplode(parts).alias("n", "part"))
    return out.select("doc_id", F.col("n").cast("long").alias("n"), F.char_length("part").cast("long").alias("length"), F.md5(F.col("part").cast("binary")).alias("part_md5"))


def pack_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _packed(spark, sf_dir).select("doc_id", F.col("chunk_index").cast("long").alias("chunk_index"), F.char_length("content").cast("long").alias("length"), F.md5(F.col("content").cast("binary")).alias("content_md5"))


def split_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = _table(spark, sf_dir, "documents").select("doc_id", F.posexplode(chunking.split_long(F.coalesce("text", F.lit("")), SIZE)).alias("n", "part"))
    return out.select("doc_id", F.col("n").cast("long").alias("n"), F.char_length("part").cast("long").alias("length"), F.md5(F.col("part").cast("binary")).alias("part_md5"))


def chunk_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    parts = chunking.paragraphs(text.normalize_text(F.coalesce("text", F.lit(""))), "\n")
    out = docs.select("doc_id", F.posexplode(chunking.overlap(chunking.pack(parts, SIZE), 200)).alias("n", "content"))
    return out.select("doc_id", F.col("n").cast("long").alias("chunk_index"), F.char_length("content").cast("long").alias("length"), F.md5(F.col("content").cast("binary")).alias("content_md5"))


def split_text_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = chunking.chunk_documents(_table(spark, sf_dir, "documents"), "doc_id", "text", SIZE, 200, "\n")
    return out.select("doc_id", F.col("chunk_index").cast("long").alias("chunk_index"), F.char_length("content").cast("long").alias("length"), F.md5(F.col("content").cast("binary")).alias("content_md5"))


def doc_chunk_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select(F.col("doc_id").alias("document_id"), "source", F.col("doc_id").alias("created_at"), F.concat(F.lit("f"), F.col("doc_id").cast("string")).alias("filename"))
    chunks = _packed(spark, sf_dir).select(F.col("doc_id").alias("document_id"))
    return service.list_documents(docs, chunks).select("document_id", "source", "chunks_count")


def chunks_of_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select(F.col("doc_id").alias("document_id"))
    chunks = _packed(spark, sf_dir).select(F.col("doc_id").alias("document_id"), F.col("chunk_index").cast("long").alias("chunk_index"), "content", F.lit(None).cast("string").alias("embedding"))
    return service.document_chunks(docs, chunks, 8).select("document_id", "chunk_index", "content", "document_title")


def chunk_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = _packed(spark, sf_dir).join(_table(spark, sf_dir, "documents").select("doc_id", "lang", "source"), "doc_id").withColumn("article_number", F.when(F.col("doc_id") % 2 == 0, F.col("source")))
    out = inspection.chunk_stats(chunks, ["lang"])
    return out.select("lang", "chunks", "with_article", "without_article", F.col("min_length").cast("long").alias("min_length"), F.round("mean_length", 6).alias("mean_length"), F.col("median_length").cast("double").alias("median_length"), F.col("max_length").cast("long").alias("max_length"), "with_form_feed", "with_references", "suspicious")


def chunk_previews(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _packed(spark, sf_dir)
    return rows.select("doc_id", F.col("chunk_index").cast("long").alias("chunk_index"), text.preview(F.col("content")).alias("start_text"))


# HTML, structure and inline Russian texts


def html_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = _table(spark, sf_dir, "pages").select("page_id", F.posexplode(files.html_lines_native(F.col("html"))).alias("n", "line"))
    return lines.select("page_id", F.col("n").cast("long").alias("n"), "line")


def html_lines_parsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = _table(spark, sf_dir, "pages").select("page_id", F.posexplode(files.html_lines_udf("html")).alias("n", "line"))
    return lines.select("page_id", F.col("n").cast("long").alias("n"), "line")


LAW = [("d", i, x) for i, x in enumerate(("preamble", "Раздел I. A", "Глава 1. B", "Статья 1. T1", "body 1", "body 2 статьи 2", "Раздел II. C", "dropped line", "Статья 2", "b", "Глава 2. D", "Статья 3.1. X", "z"))] + [
    ("e", i, x) for i, x in enumerate(("ГЛАВА 1", "§ 3. P", "СТАТЬЯ 10 Без точки", "по статьям 5.27, 5.3 и 80-82", "Подраздел 2. S", "Статья 11.", "Глава 4. Q", "Статья 12", "см. статью 11 и пункт 3"))
]
_NAMES = ("doc", "n", "line")


def structure_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = structure.extract_records(_values(spark, LAW, list(_NAMES)))
    return out.withColumn("referenced_articles", F.array_join("referenced_articles", ","))


TEXTS = [(i, x, c) for i, (x, c) in enumerate((("см. статью 5 настоящего Кодекса", "1"), ("части 2 статьи 10.1 и статей 7", "1"), ("по статьям 80-82, 5.27 или 5.3", "5.3"), ("СТАТЬЯМИ 3 и/или 4", "9"), ("статья", "1"), ("подстатья 7", "1"), ("в статье 15, статье 2, статье 15", "2")))]


def reference_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _values(spark, TEXTS, ["id", "txt", "own"])
    return rows.select("id", F.array_join(references.referenced_articles(F.col("txt"), F.col("own")), ",").alias("refs"))


QUESTIONS = [(i, x) for i, x in enumerate(("что говорит ст. 81 ТК РФ", "Статья 105 УК", "часть 5, по ст. 10.1", "трудовой договор с работником", "договор купли-продажи", "развод и алименты", "статьёй 7", "налоговая декларация", "мост 5", "Жилое  помещение"))]


def article_number_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _values(spark, QUESTIONS, ["id", "q"]).select("id", references.question_article(F.col("q")).alias("article_number"))


def law_hint_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _values(spark, QUESTIONS, ["id", "q"]).select("id", references.law_hint(F.col("q")).alias("law"))


FILES = [(i, x) for i, x in enumerate(("Трудовой кодекс.html", "uk_rf.htm", "Налоговый кодекс часть вторая.html", "Налоговый кодекс.html", "Гражданский кодекс (часть 3).html", "gk_rf_part_4.html", "Семейный кодекс РФ.docx", "О защите прав потребителей.docx", "Прочий акт № 5 — щука.html"))]


def slugify(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name")).union(_values(spark, FILES, ["id", "name"]).select(-1 - F.col("id"), "name"))
    return rows.select("id", text.slugify(F.col("name")).alias("slug"))


def identity_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.concat_ws("-", "p_name", "p_brand", "p_type").alias("name")).union(_values(spark, FILES, ["id", "name"]).select(-1 - F.col("id"), "name"))
    return rows.select("id", text.identity(F.col("name")).alias("identity"))


def infer_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, docx = _values(spark, FILES, ["id", "name"]), structure.docx_metadata(F.col("name"))
    return rows.select("id", structure.html_document_id(F.col("name")).alias("html_id"), structure.html_title(F.col("name")).alias("html_title"), docx["document_id"].alias("docx_id"), docx["output_filename"].alias("docx_file"), docx["recognised"].alias("recognised"))


JSONL = ['{"text": "a", "article_number": 80}', '{"text": "  "}', "[1, 2]", "5", "null", "", "{bad", '{"article_number": "1"}', '{"text": "b", "document_title": "T", "referenced_articles": ["1", " ", "2"]}', '"s"', '{"text": "c", "referenced_articles": "no"}']


def jsonl_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event payloads, which lack a text, and lines of every class."""
    lines = _table(spark, sf_dir, "events").select(F.lit("events").alias("filename"), F.col("event_id").alias("n"), F.col("props").alias("line")).union(_values(spark, [("v", i, x) for i, x in enumerate(JSONL)], ["filename", "n", "line"]))
    out = files.parse_jsonl(lines)
    return out.select("filename", "n", "class", F.col("item.content").alias("content"), F.col("item.article_number").alias("article_number"))


# full text


def _terms(column: str) -> F.Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(column), F.lit(fulltext.WORD), F.lit(0)))


def _worded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), "text", "source", _terms("text").alias("words"))


def _benchmark_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), _terms("text").alias("terms"))


def _kept(spark: SparkSession, rows: DataFrame) -> DataFrame:
    """Rows written and read back, as an index is made once and read by every step of a search."""
    path = f"{scratch_dir(spark).rstrip('/')}/kept-{uuid.uuid4().hex}"
    rows.write.parquet(path)
    return spark.read.schema(rows.schema).parquet(path)


def _matching(spark: SparkSession, sf_dir: str) -> DataFrame:
    # explode_outer: for explode Spark adds a filter on the size of the words, and splits each text three times
    words = _worded(spark, sf_dir).select("chunk_id", F.explode_outer("words").alias("term"), F.lit(None).cast("string").alias("places"))
    asked = _benchmark_terms(spark, sf_dir)
    return postings.match(_kept(spark, postings.of_terms_asked(words, asked)), asked).select("query_id", "chunk_id")


def keyword_match_all_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold all words of a benchmark item, unstemmed."""
    return _matching(spark, sf_dir).withColumnRenamed("chunk_id", "doc_id")


def keyword_rank_cover_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The matching documents ranked; only they are parsed into postings with places."""
    found = _kept(spark, _matching(spark, sf_dir).select("chunk_id").distinct())
    lexemes = fulltext.lexeme_column([(F.col("source"), fulltext.WEIGHT_A), (F.col("text"), fulltext.WEIGHT_D)], stemmed=False)
    docs = _table(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), "text", "source").join(postings.small(found, postings.MET)(found), "chunk_id", "left_semi")
    held = _kept(spark, postings.index(docs.select("chunk_id", lexemes.alias("lexemes"))))
    # a term counts where the text itself holds it; the source's own words only add to the rank
    hits = postings.match(held, _benchmark_terms(spark, sf_dir)).filter(F.forall("hits", lambda h: F.exists(h["places"], lambda p: p["weight"] == fulltext.WEIGHT_D)))
    ranked = hits.select("query_id", "chunk_id", postings.cover_density(F.col("hits")).alias("keyword_score"))
    return postings.best(ranked, retrieval.candidate_limit(5)).select("query_id", F.col("chunk_id").alias("doc_id"), F.round("keyword_score", 6).alias("keyword_score"))


# evaluation on labelled vectors


def _eval_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = _vector_queries(spark, sf_dir)
    return q.select(F.col("query_id").cast("string").alias("id"), F.concat(F.lit("L"), (F.col("label") % 4).cast("string")).alias("law"), F.when(F.col("label") % 3 > 0, F.concat(F.lit("T"), (F.col("label") % 3).cast("string"))).alias("question_type"), F.when(F.col("query_id") % 1500 == 0, "out_of_scope").alias("case_type"))


def _eval_judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, queries = _vectors(spark, sf_dir), _vector_queries(spark, sf_dir)
    near = retrieval.nearest_batch(rows, queries, 21).filter("query_id <> chunk_id")
    near = near.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("distance", "chunk_id"))).filter("rank <= 20")
    pairs = near.join(rows.select("chunk_id", "label"), "chunk_id").join(queries.select("query_id", F.col("label").alias("own")), "query_id")
    level = F.when(F.col("label") == F.col("own"), "primary").when(F.col("label") == F.col("own") + 1, "acceptable")
    return pairs.select(F.col("query_id").cast("string").alias("case_id"), "rank", level.alias("relevance"), (F.col("label") == F.col("own")).alias("expected_document"), F.round(1 - F.col("distance"), 6).alias("similarity"))


def eval_case_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = evaluation.case_metrics(_eval_judged(spark, sf_dir), _eval_cases(spark, sf_dir))
    return out.withColumn("rank", F.col("rank").cast("long")).withColumn("reciprocal_rank", F.round("reciprocal_rank", 6)).drop("law", "question_type")


def _summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = evaluation.summarize(evaluation.case_metrics(_eval_judged(spark, sf_dir), _eval_cases(spark, sf_dir)))
    return out.select(*[F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in out.dtypes])


def eval_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _summary(spark, sf_dir).filter("level = 'all'").drop("level", "name")


def eval_by_law(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _summary(spark, sf_dir).filter("level = 'law'").drop("level").withColumnRenamed("name", "law")


def eval_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _summary(spark, sf_dir).filter("level = 'question_type'").drop("level").withColumnRenamed("name", "question_type")


def best_worst_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.extremes(_summary(spark, sf_dir).filter("level = 'law'"), "top_1_accuracy")


def label_hit_at_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = _eval_judged(spark, sf_dir)
    return judged.groupBy("case_id").agg(F.count_if("expected_document").alias("hits"), F.bool_or(F.col("expected_document") & (F.col("rank") <= 5)).alias("hit_at_5"))


# answers, history, checks


def _ranked_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five documents of the vectors nearest to each query vector, as search results."""
    near = retrieval.nearest_batch(_vectors(spark, sf_dir), _vector_queries(spark, sf_dir), 5).select("query_id", F.col("rank").cast("long").alias("rank"), F.col("chunk_id").alias("doc_id"))
    docs, null = _table(spark, sf_dir, "documents"), F.lit(None).cast("string")
    even, third = F.col("doc_id") % 2 == 0, F.col("doc_id") % 3 == 0
    refs = F.when(third, F.array(F.lit("1"), F.lit("2")))
    return near.join(docs, "doc_id").select("query_id", "rank", F.col("text").alias("content"), F.col("source").alias("article_number"), null.alias("article_title"), F.col("lang").alias("document_title"), null.alias("section_title"), null.alias("subsection_title"), F.when(even, "C").alias("chapter_title"), null.alias("paragraph_title"), refs.alias("referenced_articles"), F.concat(F.lit("f"), F.col("doc_id").cast("string")).alias("filename"), F.col("doc_id").alias("chunk_index"), F.lit("txt").alias("source_format"), null.alias("source_filename"))


def prompt_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    questions = _vector_queries(spark, sf_dir).select("query_id", F.concat(F.lit("q"), F.col("query_id").cast("string")).alias("query"))
    return answer.prompts(_ranked_documents(spark, sf_dir), questions).select("query_id", F.md5(F.col("prompt").cast("binary")).alias("prompt_md5"), F.char_length("prompt").cast("long").alias("length"))


def sources_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return answer.sources(_ranked_documents(spark, sf_dir)).withColumn("referenced_articles", F.array_join("referenced_articles", ","))


def history_last_100(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = history.normalize_messages(_table(spark, sf_dir, "conversations").withColumnRenamed("text", "content"))
    return history.last_messages(rows, ["conv_id", "turn"]).select("conv_id", "turn", "role", "content", F.col("n").cast("long").alias("n"))


def history_last_per_conversation(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = history.normalize_messages(_table(spark, sf_dir, "conversations").withColumnRenamed("text", "content"))
    return history.last_messages(rows, ["turn"], ["conv_id"], 3).select("conv_id", "turn", "role", F.col("n").cast("long").alias("n"))


def duplicate_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    many = F.count(F.lit(1)).over(Window.partitionBy("conv_id"))
    return _table(spark, sf_dir, "conversations").select("conv_id", "turn", (many > 1).alias("repeated"))


QUERIES = {
    f.__name__: f
    for f in (
        knn_semantic, knn_batch_topk, hybrid_candidates_union, hybrid_score, alias_exists_boost, doc_chunk_counts, chunks_of_document, paragraph_split, pack_chunks, split_long,
        chunk_overlap, split_text_chunks, chunk_stats, chunk_previews, html_lines, html_lines_parsed, slugify, identity_normalize, jsonl_validate, keyword_match_all_terms, keyword_rank_cover_density, eval_case_results, eval_summary, eval_by_law, eval_by_type,
        best_worst_groups, label_hit_at_k, prompt_text, sources_projection, history_last_100, history_last_per_conversation, duplicate_ids,
    )
}

#: Golden texts of a few lines, which tests hold against SQL. They read no table, so the driver does not run
#: them: legal_records, references_of_documents and metadata_of_documents say the same over tables.
GOLDEN = {f.__name__: f for f in (structure_records, reference_extract, article_number_query, law_hint_query, infer_metadata)}
