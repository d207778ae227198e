"""Queries of whole flows, run over the driver's tables: hybrid search with a live keyword
branch, legal splitting, judging, tables written and read back. Their SQL is in flow_oracles."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .config import scratch_dir
from .functions import fulltext, references, text
from .operators import chunking, evaluation, history, postings, retrieval, structure
from .plans import service
from .queries import FILES, SIZE, _kept, _table, _tagged
from .schemas import CHUNK, DOCUMENT, SOURCE
from .sources import files, jsonl_files, sinks
from .streaming.history import save_history, saved_history


def _scratch(spark: SparkSession, name: str) -> str:
    return f"{scratch_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def _str(c: str) -> Column:
    return F.col(c).cast("string")


# hybrid search with keywords


def _keyword_corpus(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Vectors, the postings of their documents (unstemmed), and every hundredth as a query for
    the first and the fifth word of its document."""
    docs = _table(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), "text", "source")
    rows = _tagged(spark, sf_dir).join(docs, "chunk_id")
    lexemes = fulltext.lexeme_column([(F.col("source"), fulltext.WEIGHT_A), (F.col("text"), fulltext.WEIGHT_D)], stemmed=False)
    path = _scratch(spark, "postings")  # kept, as ingest does, and not made anew for every use
    postings.folders(rows.select("chunk_id", lexemes.alias("lexemes"))).write.partitionBy("bucket").parquet(path)
    held = spark.read.parquet(path)
    queries = rows.filter(F.col("chunk_id") % 100 == 0)
    words = F.regexp_extract_all(F.lower("text"), F.lit(fulltext.WORD), F.lit(0))
    terms = F.array_distinct(F.filter(F.array(F.get(words, F.lit(0)), F.get(words, F.lit(4))), lambda w: w.isNotNull()))
    queries = queries.select(F.col("chunk_id").alias("query_id"), "embedding", terms.alias("terms"), "article_number", F.substring_index("names", " ", -1).alias("law_hint"))
    return rows.select("chunk_id", "embedding", "article_number", "names"), held, _kept(spark, queries)


def hybrid_keyword(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best ten of all three sets of candidates, keyword scores included."""
    rows, held, queries = _keyword_corpus(spark, sf_dir)
    out = retrieval.hybrid(rows, queries, 10, aliases={x: (x,) for x in ("de", "en", "es", "fr")}, held=held)
    return out.select("query_id", "chunk_id", *[F.round(c, 6).alias(c) for c in ("semantic_score", "keyword_score", "article_boost", "document_boost", "hybrid_score")], F.col("rank").cast("long").alias("rank"))


def keyword_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The third set by itself: rows with all of a query's words, best 50 by cover density."""
    _, held, queries = _keyword_corpus(spark, sf_dir)
    found = retrieval.keyword_candidates(held, queries, retrieval.candidate_limit(5))
    return found.select("query_id", "chunk_id", F.round("keyword_score", 6).alias("keyword_score"))


def stored_lexemes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lexemes of title, section and content with positions and weights, as ingest stores them."""
    docs = _table(spark, sf_dir, "documents")
    documents = docs.select(F.col("doc_id").alias("document_id"), F.concat(F.lit("f"), _str("doc_id")).alias("filename"), F.col("source").alias("title"))
    null = F.lit(None).cast("string")
    chunks = docs.select(F.col("doc_id").alias("document_id"), F.lit("x").alias("filename"), "text", null.alias("article_title"), F.col("lang").alias("section_title"), null.alias("chapter_title"), null.alias("source_filename"), F.substring("text", 1, 300).alias("content"))
    rows = service.corpus(documents, chunks, frozenset()).select("document_id", "names", F.explode("lexemes").alias("e"))
    return rows.groupBy("document_id", "names").agg(F.count(F.lit(1)).alias("lexemes"), F.max("e.pos").cast("long").alias("last_pos"), F.round(F.sum("e.weight"), 4).alias("weight"), F.min("e.lexeme").alias("first_lexeme"))


# legal splitting


def _legal_text() -> Column:
    """A document's lines as law text: headings with titles inline, wrapped or missing, blank lines."""
    n = lambda i: (i + 1).cast("string")

    def line(x: Column, i: Column) -> Column:
        return (
            F.when(i % 11 == 2, F.concat(F.lit("Статья "), n(i), F.lit(". "), F.substring(x, 1, 65)))
            .when(i % 11 == 3, F.lower(F.substring(x, 2, 20)))
            .when(i % 11 == 5, F.concat(F.lit("\n"), x, F.lit("\n")))
            .when(i % 11 == 6, F.concat(F.lit("ГЛАВА "), n(i)))
            .when(i % 11 == 8, F.concat(F.lit("  статья  "), n(i), F.lit(".1")))
            .when(i % 11 == 9, F.concat(F.lit("Название "), F.regexp_replace(F.substring(x, 1, 30), r"[.:;]", "")))
            .otherwise(x)
        )

    return F.array_join(F.transform(F.split(F.coalesce("text", F.lit("")), "\n"), line), "\n")


def legal_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", _legal_text().alias("text"))
    out = chunking.chunk_documents(docs, "doc_id", "text", SIZE, 0, legal=True)
    return out.select("doc_id", F.col("chunk_index").cast("long").alias("chunk_index"), "article_number", "article_title", F.char_length("content").cast("long").alias("length"), F.md5(F.col("content").cast("binary")).alias("content_md5"))


def legal_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's lines with headings of all levels among them, as article records."""
    lines = _table(spark, sf_dir, "documents").select(F.col("doc_id").alias("doc"), F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("n", "line"))
    i, n, x = F.col("n") % 13, F.col("n").cast("string"), F.col("line")
    head = (
        F.when(i == 1, F.concat(F.lit("Раздел "), n))
        .when(i == 2, F.concat(F.lit("ГЛАВА "), n, F.lit(". C")))
        .when(i.isin(3, 9), F.concat(F.lit("Статья "), n, F.lit(". "), F.substring(x, 1, 20)))
        .when(i == 4, F.concat(x, F.lit(" в статье "), n, F.lit(" и статьях 7, 3.2")))
        .when(i == 6, F.concat(F.lit("Подраздел "), n))
        .when(i == 7, F.concat(F.lit("§ "), n))
        .when(i == 11, F.concat(F.lit("статья "), n, F.lit(".1")))
        .otherwise(F.concat(F.lit("x "), x))
    )
    out = structure.extract_records(lines.select("doc", F.col("n").cast("long").alias("n"), head.alias("line")))
    return out.select("doc", "n", "section_title", "subsection_title", "chapter_title", "paragraph_title", "article_number", "article_title", F.md5(F.col("text").cast("binary")).alias("text_md5"), F.array_join("referenced_articles", ",").alias("refs"))


def references_of_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References, questions and hints made of every row of ``documents``."""
    d = F.col("doc_id")
    said = F.concat(F.lit("См. статьи "), (d % 90 + 1).cast("string"), F.lit(", "), (d % 7 + 1).cast("string"), F.lit(".3 и "), (d % 13 + 1).cast("string"), F.lit("; статьей "), (d % 31).cast("string"), F.lit(" — "), "source")
    asked = F.concat(F.when(d % 3 == 0, "Что говорит ст. ").when(d % 3 == 1, "Какова СТАТЬЯ ").otherwise("О налоге и браке "), (d % 200).cast("string"), F.when(d % 4 == 0, ".1 о договоре?").otherwise("?"))
    out = _table(spark, sf_dir, "documents").select("doc_id", said.alias("said"), asked.alias("asked"))
    own = (F.col("doc_id") % 90 + 1).cast("string")
    return out.select("doc_id", F.array_join(references.referenced_articles(F.col("said"), own), ",").alias("refs"), references.question_article(F.col("asked")).alias("article_number"), references.law_hint(F.col("asked")).alias("law"), references.matches_law_hint(F.concat(F.lit("Налоговый-Кодекс "), F.col("asked")), "nk_rf").alias("tax"), references.matches_law_hint(F.col("asked"), "gk_rf").alias("civil"))


# judging

#: Names by which results know their document: a title, a file and an id of each kind.
TITLES = ("Трудовой кодекс Российской Федерации", "ugolovnyy_kodeks_rf", "Гражданский кодекс Российской Федерации часть первая", "semeynyy kodeks RF", "src", "")
EXPECTED = ("tk_rf", "uk_rf", "gk_rf", "sk_rf", "src7", "")


def _pick(values: tuple[str, ...], at: Column) -> Column:
    return F.get(F.array(*[F.lit(v) for v in values]), at.cast("int"))


def _judge_tables(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """A case for each hundredth document and as its results the 20 documents after it."""
    docs, n = _table(spark, sf_dir, "documents").select("doc_id", "source"), len(TITLES)
    results = docs.withColumn("rank", F.col("doc_id") % 100).filter(F.col("rank").between(1, 20)).select(
        (F.col("doc_id") - F.col("rank")).cast("string").alias("case_id"), "rank", F.concat(F.lit("ст. "), F.col("doc_id") % 5, F.lit(".2")).alias("article_number"), _pick(TITLES, F.col("doc_id") % n).alias("document_title"),
        F.when(F.col("doc_id") % 4 == 0, F.concat("source", F.lit(".txt"))).alias("filename"), F.lit(None).cast("string").alias("source_filename"), F.lit(None).cast("string").alias("document_id"), (1.0 / (F.col("rank") + 1)).alias("similarity"),
    )
    c = (F.col("doc_id") / 100).cast("long")
    source = lambda law, art, level: F.struct(law.alias("document_id"), art.alias("article_number"), F.lit(level).alias("relevance"), F.lit(None).cast("string").alias("reason"))
    number = lambda k: F.concat(((c + k) % 5).cast("string"), F.lit(".2"))
    some = F.array(source(_pick(EXPECTED, c % n), number(0), " Primary "), source(_pick(EXPECTED, (c + 1) % n), number(1), "acceptable"), source(_pick(EXPECTED, (c + 2) % n), F.concat(F.lit("статья "), number(2)), "secondary"), source(F.lit("tk_rf"), F.lit("none"), "primary"), source(F.lit("gk_rf"), number(3), "odd"))
    cases = docs.filter(F.col("doc_id") % 100 == 0).select(
        _str("doc_id").alias("id"), F.concat(F.lit("L"), (c % 3).cast("string")).alias("law"), F.lit("T").alias("question_type"), F.when(c % 9 == 8, "out_of_scope").alias("case_type"),
        F.when(c % 4 == 3, F.lit("")).otherwise(_pick(EXPECTED, c % n)).alias("expected_document_id"), _pick(TITLES, c % n).alias("expected_document_title"), F.array(number(0), F.lit("x"), number(2)).alias("expected_article_numbers"),
        F.when(c % 3 != 1, some).cast(T.ArrayType(SOURCE)).alias("expected_sources"),
    )
    return results, cases


def judge_relevance(spark: SparkSession, sf_dir: str) -> DataFrame:
    results, cases = _judge_tables(spark, sf_dir)
    return evaluation.judge(results, cases).select("case_id", F.col("rank").cast("long").alias("rank"), "relevance", "expected_document")


def judged_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metrics of each case from its own judging, not from labels."""
    results, cases = _judge_tables(spark, sf_dir)
    out = evaluation.case_metrics(evaluation.judge(results, cases), cases)
    return out.select("id", "law", "not_evaluated", F.col("rank").cast("long").alias("rank"), F.round("reciprocal_rank", 6).alias("reciprocal_rank"), "hit_top_1", "hit_top_5", "partial_match", "wrong_document_at_1", "document_hit_top_5")


def expected_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Known names of each part, by aliases that the query gives (the function's are Russian laws)."""
    aliases = {"steel": ("steel", "large steel"), "tin": ("tin", "small tin", "economy tin"), "nickel": ("nickel",)}
    part = _table(spark, sf_dir, "part")
    names = evaluation.expected_names(F.when(F.col("p_partkey") % 3 == 0, F.lit("")).otherwise(F.col("p_type")), F.col("p_name"), aliases)
    return part.select("p_partkey", evaluation.alias_key(F.col("p_type"), aliases).alias("law"), F.array_join(names, ",").alias("names"))


def case_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each first turn as an evaluation case, most of them with one defect."""
    rows = _table(spark, sf_dir, "conversations").filter("turn = 0").dropDuplicates(["conv_id"])
    c = F.col("conv_id")
    source = F.struct(F.when(c % 7 == 3, " ").otherwise("tk_rf").alias("document_id"), F.lit("1").alias("article_number"), F.when(c % 7 == 4, "best").otherwise("primary").alias("relevance"), F.lit(None).cast("string").alias("reason"))
    cases = rows.select(
        F.when(c % 7 == 0, " ").otherwise((c - F.when(c % 11 == 10, 1).otherwise(0)).cast("string")).alias("id"), F.when(c % 7 == 1, "").otherwise("q").alias("question"), F.when(c % 7 == 2, "out_of_scope").alias("case_type"), F.when(c % 2 == 0, "no_answer").alias("expected_behavior"),
        F.when(c % 7 == 5, F.array(F.lit("5"))).alias("expected_article_numbers"), F.when(c % 7 < 5, F.array(source)).alias("expected_sources"), "conv_id",
    )
    found = files.case_problems(cases)
    return found.groupBy("id", "problem").agg(F.count(F.lit(1)).alias("n"))


# sources, sinks, settings


def jsonl_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents written as JSONL, read back by line and validated."""
    path, d = _scratch(spark, "jsonl"), F.col("doc_id")
    rows = _table(spark, sf_dir, "documents").select(
        F.when(d % 5 != 0, F.col("text")).alias("text"), _str("doc_id").alias("document_title"), (d % 90).alias("article_number"), (d % 2 == 0).alias("section_title"), F.concat(F.lit("  "), "lang", F.lit("\t")).alias("chapter_title"),
        F.when(d % 3 == 0, F.col("source")).alias("source_filename"), F.concat("source", F.lit(".html")).alias("filename"), F.array(F.lit(" 1 "), F.lit("  "), (d % 4).cast("string")).alias("referenced_articles"),
    )
    sinks.write_jsonl(rows, path)
    lines = spark.read.text(path).select(F.lit("f").alias("filename"), F.lit(0).cast("long").alias("n"), F.col("value").alias("line"))
    out = files.parse_jsonl(lines)
    return out.select("class", "document_title", F.md5(F.col("item.content").cast("binary")).alias("content_md5"), *[F.col(f"item.{c}").alias(c) for c in ("article_number", "section_title", "chapter_title", "source_filename")], F.array_join("item.referenced_articles", ",").alias("refs"))


def store_replace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of 40 documents each put in a store; then every third file once more, changed."""
    store = sinks.Store(spark, _scratch(spark, "store"), 8)
    store.init()
    d = F.col("doc_id")
    rows = _table(spark, sf_dir, "documents").select("doc_id", (d / 40).cast("long").alias("document_id"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("filename", F.concat(F.lit("f"), _str("document_id")))
    empty = {f.name: F.lit(None).cast(f.dataType) for f in [*DOCUMENT.fields, *CHUNK.fields]}
    for run, some in (("one", rows), ("two", rows.filter("document_id % 3 = 0 and doc_id % 2 = 0"))):
        made = {"title": F.lit(run), "content": F.concat(F.lit(run + ":"), F.substring("text", 1, 40)), "chunk_id": d, "chunk_index": (d % 40).cast("int")}
        chunks = some.select(*[made.get(f.name, F.col(f.name) if f.name in some.columns else empty[f.name]).alias(f.name) for f in CHUNK.fields])
        documents = some.select("document_id", "filename").distinct().select(*[made.get(f.name, F.col(f.name) if f.name in ("document_id", "filename") else empty[f.name]).alias(f.name) for f in DOCUMENT.fields])
        store.replace(documents, chunks)
    held = store.chunks().groupBy("document_id").agg(F.count(F.lit(1)).alias("chunks"), F.md5(F.array_join(F.array_sort(F.collect_list("content")), "|").cast("binary")).alias("content_md5"))
    return store.documents().join(held, "document_id", "left").select("document_id", "filename", "title", "chunks", "content_md5")


def _lines_of_documents() -> list[Column]:
    """A document as a line's columns: every fifth without text, every third with a title."""
    d = F.col("doc_id")
    return [F.when(d % 5 != 0, F.col("text")).alias("text"), F.when(d % 3 == 1, F.concat(F.lit("T"), _str("doc_id"))).alias("document_title"), (d % 90).cast("string").alias("article_number")]


#: Bytes of text that ``ingested_files`` writes as files at a time, at least, and times at most.
FILES_TEXT, FILES_TIMES = 64 << 20, 8


def _ranges(table: DataFrame, by: int) -> list[Column]:
    """Conditions that part the rows by ranges of whole ``doc_id / by``, of about as many rows each; null ids are in the first."""
    size = table.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    times = max(1, min(FILES_TIMES, size // FILES_TEXT))
    cuts = table.agg(F.percentile_approx("doc_id", [i / times for i in range(1, times)])).first()[0] or [] if times > 1 else []
    starts, d = sorted({c // by * by for c in cuts}), F.col("doc_id")
    if not starts:
        return [F.lit(True)]
    return [d.isNull() | (d < starts[0]), *[(d >= a) & (d < b) for a, b in zip(starts[:-1], starts[1:], strict=True)], d >= starts[-1]]


def ingested_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """500 documents a JSONL file, each file written by its name, all ingested: titles, chunks and what was skipped.

    Files are written and ingested some at a time and then deleted, so that at most about an eighth of a large
    table lies beside the store as files, staged rows and shuffles.
    """
    table, store = _table(spark, sf_dir, "documents"), sinks.Store(spark, _scratch(spark, "store"), 8)
    for some in _ranges(table, 500):
        folder = _scratch(spark, "files")
        docs = table.filter(some).withColumn("name", F.concat(F.lit("f"), F.floor(F.col("doc_id") / 500).cast("string"), F.lit(".jsonl")))
        jsonl_files.write_files(docs.select("name", "doc_id", *_lines_of_documents()), folder, "name", ["doc_id"])
        service.ingest(spark, folder, store, stops=frozenset())
        sinks.delete(spark, folder)
    rows = service.list_documents(store.documents(), store.chunks())
    contents = F.array_sort(F.collect_list(F.struct("chunk_index", F.md5(F.col("content").cast("binary")).alias("m"))))
    digests = store.chunks().groupBy("filename").agg(F.md5(F.array_join(F.transform(contents, lambda c: c["m"]), "").cast("binary")).alias("contents_md5"))
    skipped = store.issues().groupBy("filename").agg(F.count(F.lit(1)).alias("skipped"), F.min(F.regexp_extract("said", r"line (\d+) ", 1).cast("long")).alias("first_skipped"))
    return rows.join(digests, "filename").join(skipped, "filename", "left").select("filename", "title", "chunks_count", "contents_md5", "skipped", "first_skipped")


#: Bytes of text in a file of ``jsonl_numbered``, about; there are four files at least, each of several splits.
LINES_FILE = 256 << 20


def jsonl_numbered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as lines of a few large files, some of them broken, read in splits: each line's class, and that its number is its place."""
    path, d = _scratch(spark, "lines"), F.col("doc_id")
    table = _table(spark, sf_dir, "documents")
    size = table.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    docs = table.repartitionByRange(max(4, -(-size // LINES_FILE)), "doc_id").sortWithinPartitions("doc_id")
    value = F.when(d % 7 == 3, F.concat(F.lit("{bad "), _str("doc_id"))).when(d % 7 == 5, F.concat(F.lit("["), _str("doc_id"), F.lit("]"))).otherwise(F.to_json(F.struct(_str("doc_id").alias("article_number"), *_lines_of_documents()[:2])))
    docs.select(value.alias("value")).write.option("compression", "none").text(path)
    lines = files.read_lines(spark, path, ".txt")
    parsed = files.parse_jsonl(lines, also=("part", "line")).withColumn("doc_id", F.coalesce(F.get_json_object("line", "$.article_number"), F.regexp_extract("line", r"^[^0-9]*(\d+)", 1)).cast("long"))
    counts = parsed.groupBy("filename").agg(F.count(F.lit(1)).alias("lines"), F.min("n").alias("low"), F.max("n").alias("high"), F.countDistinct("n").alias("different"))
    whole = (F.col("low") == 1) & (F.col("high") == F.col("lines")) & (F.col("different") == F.col("lines"))
    order = F.coalesce(F.lag("doc_id").over(Window.partitionBy("filename", "part").orderBy("n")) < F.col("doc_id"), F.lit(True))
    return parsed.join(F.broadcast(counts), "filename").select("doc_id", "class", "document_title", F.md5(F.col("item.content").cast("binary")).alias("content_md5"), (whole & order).alias("numbered"))


def metadata_of_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What names of files say, for a file name made of each document's source."""
    stems = F.array(*[F.lit(x.rpartition(".")[0]) for _, x in FILES])
    name = F.concat(F.get(stems, (F.col("doc_id") % len(FILES)).cast("int")), F.lit(" "), "source", F.lit(".html"))
    rows, docx = _table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), name.alias("name")), structure.docx_metadata(F.col("name"))
    return rows.select("id", structure.html_document_id(F.col("name")).alias("html_id"), structure.html_title(F.col("name")).alias("html_title"), docx["document_id"].alias("docx_id"), docx["output_filename"].alias("docx_file"), docx["recognised"].alias("recognised"))


def history_saved_by_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last three messages of each conversation, as a stream over the table keeps them."""
    table, path = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.col("text").alias("content")), _scratch(spark, "messages")
    table.write.parquet(path)  # files as they would arrive
    rows = spark.readStream.schema(table.schema).parquet(path)
    out = _scratch(spark, "history")
    save_history(rows, out, _scratch(spark, "history-checkpoint"), limit=3).awaitTermination()
    return saved_history(spark, out).select("conv_id", "turn", "role", F.col("n").cast("long").alias("n"))


def conversion_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines and records of each page: pages without records, or not readable, have failed."""
    pages = _table(spark, sf_dir, "pages").select(F.concat(F.lit("p"), _str("page_id")).alias("source_filename"), "page_id", F.posexplode_outer(F.when(F.col("page_id") % 10 != 0, files.html_lines_native(F.col("html")))).alias("n", "line"))
    records = pages.filter("page_id % 3 = 0 and n % 4 = 1").select("source_filename")
    out = sinks.convert_report(pages, records)
    return out.select("source_filename", "status", F.col("records").cast("long").alias("records"))


def query_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blank questions are left out, the others stripped; numbers of results kept in bounds."""
    rows = _table(spark, sf_dir, "conversations").select("conv_id", "turn", F.when(F.col("turn") % 3 == 1, "  ").otherwise(F.concat(F.lit(" "), F.substring(F.coalesce("text", F.lit("")), 1, 20), F.lit("\t\n"))).alias("query"), F.when(F.col("conv_id") % 4 == 0, "many").when(F.col("conv_id") % 4 == 1, (F.col("conv_id") % 50).cast("string")).alias("k"))
    return retrieval.valid_queries(rows).select("conv_id", "turn", "query", retrieval.clamp_top_k(F.col("k")).cast("long").alias("top_k"))


def title_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Title rules on each document's first lines, file stems and titles of files."""
    lines = F.split(F.coalesce("text", F.lit("")), "\n")
    first, second = (F.coalesce(text.collapse(F.substring(F.coalesce(F.get(lines, F.lit(i)), F.lit("")), 1, 70)), F.lit("")) for i in (0, 1))
    name = F.concat("source", F.when(F.col("doc_id") % 2 == 0, ".tar.txt").otherwise(".txt"))
    rows = _table(spark, sf_dir, "documents").select("doc_id", first.alias("first"), second.alias("second"), name.alias("name"))
    return rows.select("doc_id", text.stem_of(F.col("name")).alias("title"), F.coalesce(text.first_alpha_is_lower(F.col("second")), F.lit(False)).alias("lower"), chunking.title_continues(F.col("first"), F.lower("second")).alias("continues"), F.coalesce(chunking.article_title(F.lit(""), F.col("first"), F.lower("second")), F.lit("")).alias("article_title"))


def display_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers, labels and names as history shows them."""
    part = _table(spark, sf_dir, "part")
    mode = F.when(F.col("p_size") % 3 == 0, "semantic").when(F.col("p_size") % 3 == 1, "hybrid").otherwise("other")
    file = F.concat(F.when(F.col("p_size") % 5 == 0, "old_TRUD_").when(F.col("p_size") % 5 == 1, "gk_rf_").otherwise("x_"), "p_brand")
    source = F.create_map(F.lit("document_title"), "p_name", F.lit("other"), "p_type", F.lit("article_number"), F.when(F.col("p_size") % 2 == 0, _str("p_size")))
    kept = history.sanitize_source(source)
    return part.select(
        "p_partkey", history.format_number(F.col("p_retailprice") / 8).alias("number"), history.mode_or(mode).alias("mode"), history.mode_label(mode).alias("label"), history.article_label(F.when(F.col("p_size") % 2 == 0, _str("p_size")), F.when(F.col("p_size") % 3 == 0, F.col("p_name")).otherwise("")).alias("article"),
        history.source_title(F.when(F.col("p_size") % 7 == 0, F.col("p_name")), file, F.lit(None).cast("string")).alias("title"), F.array_join(F.array_sort(F.map_keys(kept)), ",").alias("kept"),
    )


FLOWS = {
    f.__name__: f
    for f in (
        hybrid_keyword, keyword_candidates, stored_lexemes, legal_chunks, legal_records, references_of_documents, judge_relevance, judged_metrics, expected_names, case_checks,
        jsonl_round_trip, jsonl_numbered, ingested_files, store_replace, metadata_of_documents, history_saved_by_stream, conversion_report, query_checks, title_parts, display_values,
    )
}
