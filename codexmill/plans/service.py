"""The public functions: store, ingest, catalogue, search, answer, evaluate, reports."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from datetime import datetime, timezone
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..config import Settings
from ..functions.embed import Embed, HashingEmbedder, embed_column
from ..functions.fulltext import WEIGHT_A, WEIGHT_B, WEIGHT_D, lexeme_column, stop_words
from ..functions.references import law_hint, question_article
from ..functions.text import stem_of, strip
from ..operators import evaluation, inspection, retrieval
from ..operators.postings import ROWS
from ..operators.structure import docx_metadata, html_document_id, to_records
from ..schemas import CHUNK, CONTEXT, DOCUMENT, RESULT
from ..sources import files
from ..sources.jsonl_files import write_files
from ..sources.sinks import Store, convert_report, delete, write_csv, write_docx, write_json
from . import answer as answers
from . import report

#: Fixed wording.
NO_FILES = "No .txt or .jsonl files found"
#: Skipped lines that a run's summary shows; all are in the store's table.
ISSUES_SHOWN = 20
EMPTY_NOTE = "No documents are loaded; ingest some first"


def health(spark: SparkSession) -> dict[str, bool]:
    try:
        ok = spark.sql("SELECT 1").first()[0] == 1
        vectors = spark.catalog.functionExists("zip_with")
    except Exception:
        return {"engine": False, "vector_functions": False}
    return {"engine": ok, "vector_functions": vectors}


def now() -> datetime:
    return datetime.now(timezone.utc).replace(tzinfo=None)


def ingest(spark: SparkSession, folder: str, store: Store, settings: Settings = Settings(), model: Callable[[], Embed] = HashingEmbedder, clock: Callable[[], datetime] = now, stops: frozenset[str] | None = None) -> dict:
    """Replace the store's version of every TXT and JSONL file of a folder that gives chunks.

    Files without chunks are skipped and keep their old version, and so do files that
    are gone from the folder. Ids are hashes of names and positions, so they stay the same.
    Lexemes are made here, once, and kept; ``stops`` must be those of later searches. Files are
    parsed once, into a table of the run that everything else is made from; the version that shows
    changes in one step at the end. What was skipped is a table of the store (``Store.issues``);
    ``issues`` has its first ISSUES_SHOWN rows.
    """
    store.init()
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ROWS))  # bounds the memory of Python workers
    run = uuid.uuid4().hex
    staged = f"{store.path}/_staging-{run}"
    at = F.lit(clock()).cast("timestamp_ntz")
    try:
        files.read_folder(spark, folder, settings.chunk_size, min(settings.chunk_overlap, settings.chunk_size - 1)).write.parquet(staged, compression="zstd")
        rows = spark.read.schema(files.PARSED).parquet(staged)
        names = files.list_names(spark, folder, (".txt", ".jsonl"))
        per = rows.groupBy("filename").agg(F.count("item").alias("n"), F.count("said").alias("issues"), F.min_by("title", F.when(F.col("title").isNotNull(), F.struct("part", "n"))).alias("title"))
        listed = names.join(per, "filename", "left").select("filename", "path", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("issues", F.lit(0)).alias("issues"), F.coalesce("title", stem_of(F.col("filename"))).alias("title"))
        found = listed.select("filename", "n", "issues", F.lower("filename").alias("k")).orderBy("k", "filename").collect()  # one short row a file
        if not found:
            return {"files_found": 0, "documents_created": 0, "chunks_created": 0, "processed": [], "skipped": [], "issues": [], "issues_count": 0, "message": NO_FILES}
        said = rows.filter("said is not null")
        shown = [r["said"] for r in said.orderBy(F.lower("filename"), "filename", "part", "n").limit(ISSUES_SHOWN).collect()]
        ident = F.xxhash64("filename")
        documents = listed.filter("n > 0").select(ident.alias("document_id"), "filename", "title", F.col("path").alias("source_path"), at.alias("created_at"), at.alias("updated_at"))
        items = files.indexed(rows, listed.select("filename", F.col("title").alias("_title"))).withColumn("document_id", ident)
        stops = stop_words(spark) if stops is None else stops
        # in the store's order before vectors and lexemes are made, which are far larger than the text in a shuffle
        chunks = items.sortWithinPartitions("document_id", "chunk_index").select(
            F.xxhash64("filename", "chunk_index").alias("chunk_id"),
            "document_id",
            "chunk_index",
            *[F.col(f"item.{c}").alias(c) for c in ("content", "article_number", "article_title", *CONTEXT, "source_format", "source_filename", "referenced_articles")],
            embed_column(F.col("item.content"), model).alias("embedding"),
            at.alias("created_at"),
            "filename",
            _lexemes(F.col("_title"), "item.", stops).alias("lexemes"),
        )
        store.replace(documents.select(*DOCUMENT.fieldNames()), chunks.select(*CHUNK.fieldNames()), said.select("filename", "said"), run=run, dealt=True)
    except Exception as e:
        raise RuntimeError(f"ingest failed: {e}") from e
    finally:
        delete(spark, staged)
    done = [r for r in found if r["n"]]
    return {"files_found": len(found), "documents_created": len(done), "chunks_created": sum(r["n"] for r in done), "processed": [r["filename"] for r in done], "skipped": [r["filename"] for r in found if not r["n"]], "issues": shown, "issues_count": sum(r["issues"] for r in found), "message": "; ".join(shown) or "ok"}


def list_documents(documents: DataFrame, chunks: DataFrame) -> DataFrame:
    """Documents, newest first, with their number of chunks (0 for none)."""
    counts = chunks.groupBy("document_id").agg(F.count(F.lit(1)).alias("chunks_count"))
    return documents.join(counts, "document_id", "left").withColumn("chunks_count", F.coalesce("chunks_count", F.lit(0))).orderBy(F.desc("created_at"), "filename")


def document_chunks(documents: DataFrame, chunks: DataFrame, document_id: int) -> DataFrame:
    """A document's chunks in order, without vectors; raises LookupError if there is no such document."""
    if documents.filter(F.col("document_id") == document_id).isEmpty():
        raise LookupError(f"document {document_id} not found")
    return chunks.filter(F.col("document_id") == document_id).withColumn("document_title", F.lit(None).cast("string")).drop("embedding", "lexemes").orderBy("chunk_index")


def _lexemes(title: Column, item: str, stops: frozenset[str]) -> Column:
    """A chunk's lexemes: titles weigh most, section and chapter less, the content least."""
    within = [(F.col(item + c), w) for c, w in (("article_title", WEIGHT_A), ("section_title", WEIGHT_B), ("chapter_title", WEIGHT_B), ("content", WEIGHT_D))]
    return lexeme_column([(title, WEIGHT_A), *within], stops)


def corpus(documents: DataFrame, chunks: DataFrame, stops: frozenset[str]) -> DataFrame:
    """Chunks with their document's names, and lexemes ready for matching and ranking.

    Lexemes kept by ingest are used as they are; chunks without that column are parsed here.
    """
    rows = chunks.drop("filename").join(documents.select("document_id", "filename", F.col("title").alias("document_title")), "document_id")
    if "lexemes" not in chunks.columns:
        rows = rows.withColumn("lexemes", _lexemes(F.col("document_title"), "", stops))
    return rows.withColumn("names", F.concat_ws(" ", "filename", "document_title", "source_filename"))


def search(spark: SparkSession, table: DataFrame, queries: list[str], k: int = 5, mode: str | None = None, settings: Settings = Settings(), model: Callable[[], Embed] = HashingEmbedder, stops: frozenset[str] | None = None, held: DataFrame | None = None) -> DataFrame:
    """Ranked results (query_id, rank, the 22 result columns) of a list of questions over a corpus."""
    texts = [retrieval.check_query(q) for q in queries]
    return search_table(spark, table, spark.createDataFrame(list(enumerate(texts)), "query_id long, query string"), k, mode, settings, model, stops, held).orderBy("query_id", "rank")


def search_table(spark: SparkSession, table: DataFrame, queries: DataFrame, k: int = 5, mode: str | None = None, settings: Settings = Settings(), model: Callable[[], Embed] = HashingEmbedder, stops: frozenset[str] | None = None, held: DataFrame | None = None) -> DataFrame:
    """``search`` of a table (query_id, query) of any number of questions, in no order; null and blank ones have no results.

    ``held``: postings of the corpus, else made from its lexemes.
    """
    mode = settings.retrieval_mode if mode is None else mode
    if mode not in retrieval.MODES:
        raise ValueError(f"unknown retrieval mode {mode!r}")
    retrieval.check_top_k(k)
    stops = stop_words(spark) if stops is None else stops
    said = retrieval.valid_queries(queries.select("query_id", "query"))
    terms = F.array_distinct(F.transform(lexeme_column([(F.col("query"), 1.0)], stops), lambda e: e["lexeme"]))
    q = said.select("query_id", "query", embed_column(F.col("query"), model).alias("embedding"), terms.alias("terms"), question_article(F.col("query")).alias("article_number"), law_hint(F.col("query")).alias("law_hint"))
    if mode == "semantic":
        ranked = retrieval.semantic_columns(retrieval.nearest_batch(table, q, k))
    else:
        weights = (settings.hybrid_semantic_weight, settings.hybrid_keyword_weight, settings.hybrid_metadata_weight)
        ranked = retrieval.hybrid(table, q, k, weights, (settings.article_boost, settings.document_boost), held=held)
    scores = ("distance", "semantic_score", "keyword_score", "article_boost", "document_boost", "similarity", "hybrid_score")
    wide = table.select(*[c for c in RESULT if c not in scores])
    out = ranked.select("query_id", "rank", "chunk_id", *[F.col(c).cast("double").alias(c) for c in scores]).join(wide, "chunk_id")
    return out.withColumn("referenced_articles", F.coalesce("referenced_articles", F.array().cast("array<string>"))).select("query_id", "rank", *RESULT)


def search_one(spark: SparkSession, table: DataFrame, query: str, k: int = 5, mode: str | None = None, **options) -> dict:
    retrieval.check_query(query)
    if table.isEmpty():
        return {"query": query, "results": [], "note": EMPTY_NOTE}
    return {"query": query, "results": [r.asDict() for r in search(spark, table, [query], k, mode, **options).drop("query_id", "rank").collect()], "note": None}


def answer(spark: SparkSession, table: DataFrame, query: str, k: int = 5, llm: answers.LLM = answers.no_llm, project: str = "", **options) -> dict:
    """{answer, sources} of one question; without a model this fails before any search."""
    if llm is answers.no_llm:
        llm("", "")
    found = search(spark, table, [query], k, **options)
    q = spark.createDataFrame([(0, query.strip())], "query_id long, query string")
    prompt = answers.prompts(found, q).first()["prompt"]
    return {"answer": llm(answers.SYSTEM_PROMPT.replace("{project}", project), prompt), "sources": [r.asDict() for r in answers.sources(found).orderBy("rank").drop("query_id", "rank").collect()]}


def judged_search(spark: SparkSession, table: DataFrame, cases: DataFrame, top_k: int = 20, mode: str = "semantic", **options) -> DataFrame:
    """Judged results of all cases by one batched search."""
    listed = [(r["id"], r["question"]) for r in cases.select("id", "question").orderBy("id").toLocalIterator()]
    names = spark.createDataFrame([(i, c) for i, (c, _) in enumerate(listed)], "query_id long, case_id string")
    results = search(spark, table, [q for _, q in listed], top_k, mode, **options).join(names, "query_id")
    return evaluation.judge(results, cases)


def evaluate(spark: SparkSession, table: DataFrame, cases: DataFrame, top_k: int = 20, mode: str = "semantic", **options) -> tuple[DataFrame, DataFrame]:
    """(metrics per case, summary) of all cases."""
    per = evaluation.case_metrics(judged_search(spark, table, cases, top_k, mode, **options), cases, top_k)
    return per, evaluation.summarize(per)


def write_reports(spark: SparkSession, table: DataFrame, cases: DataFrame, out: str, top_k: int = 20, mode: str = "semantic", settings: Settings = Settings(), at: str = "", **options) -> dict:
    """CSV, JSON, Markdown and DOCX reports of an evaluation in the folder ``out``; returns the summary."""
    meta = {"generated_at": at or now().isoformat(timespec="seconds"), "top_k": top_k, "retrieval_mode": mode, "hybrid_semantic_weight": settings.hybrid_semantic_weight, "hybrid_keyword_weight": settings.hybrid_keyword_weight, "hybrid_metadata_weight": settings.hybrid_metadata_weight}
    judged = judged_search(spark, table, cases, top_k, mode, settings=settings, **options).cache()
    per = evaluation.case_metrics(judged, cases, top_k).cache()
    rows = evaluation.report_rows(judged, cases, per, meta).orderBy("case_id")
    groups: dict[str, dict[str, dict]] = {"all": {}, "law": {}, "question_type": {}}
    for r in evaluation.summarize(per).collect():  # a row a group
        groups[r["level"]][r["name"]] = {k: v for k, v in r.asDict().items() if k not in ("level", "name")}
    summary, listed = groups["all"]["all"], [r.asDict() for r in rows.collect()]
    text = report.markdown(summary, groups["law"], groups["question_type"], [{**r, "id": r["case_id"]} for r in listed], meta)
    write_csv(rows, f"{out}/retrieval_report.csv", bom=True)
    write_json({**meta, "summary": summary, "metrics_by_law": groups["law"], "metrics_by_question_type": groups["question_type"], "cases": listed}, f"{out}/retrieval_report.json")
    Path(f"{out}/retrieval_report.md").write_text(text, encoding="utf-8")
    write_docx(text.splitlines(), f"{out}/retrieval_report.docx")
    return summary


def inspect(spark: SparkSession, folder: str, out: str, size: int = 1200, n_overlap: int = 200) -> DataFrame:
    """A CSV of chunks for each TXT file of a folder; returns the statistics per file."""
    items = files.indexed(files.read_texts(spark, folder, size, n_overlap))
    chunks = items.select("filename", "chunk_index", "item.content", "item.article_number", "item.article_title").cache()
    for r in chunks.select("filename").distinct().orderBy("filename").toLocalIterator():
        write_csv(inspection.chunk_rows(chunks.filter(F.col("filename") == r["filename"])).orderBy("chunk_index"), f"{out}/{Path(r['filename']).stem}_chunks.csv")
    return inspection.chunk_stats(chunks, ["filename"])


def convert(spark: SparkSession, folder: str, out: str, source_format: str = "html") -> DataFrame:
    """Files of a folder to one JSONL file of records each; returns the report.

    HTML files are named by the document that their name says, DOCX files as their known law asks,
    else by their name's slug. Where two files infer one document the last by name is kept, and the
    others are reported as ``overwritten``; files without records, or not readable, have ``failed``
    and don't overwrite. (source_filename, status, records, output_filename, recognised), by name.
    """
    lines = (files.read_html(spark, folder) if source_format == "html" else files.read_docx(spark, folder)).cache()
    records = to_records(lines.filter(F.col("line").isNotNull()), source_format)
    report = convert_report(lines, records).withColumn("_name", F.struct(F.lower("source_filename"), F.col("source_filename")))
    meta = docx_metadata(F.col("source_filename")) if source_format == "docx" else None
    output = F.concat(html_document_id(F.col("source_filename")), F.lit(".jsonl")) if meta is None else meta["output_filename"]
    known = F.lit(None).cast("boolean") if meta is None else meta["recognised"]
    report = report.withColumns({"output_filename": output, "recognised": known})
    last = F.max(F.when(F.col("status") == "ok", F.col("_name"))).over(Window.partitionBy("output_filename"))
    report = report.withColumn("status", F.when((F.col("status") == "ok") & (F.col("_name") < last), "overwritten").otherwise(F.col("status")))
    report = report.orderBy("_name").select("source_filename", "status", "records", "output_filename", "recognised").cache()
    kept = records.join(report.filter("status = 'ok'").select("source_filename", "output_filename"), "source_filename").select(*records.columns, "output_filename")
    write_files(kept, out, "output_filename", ["n"])
    return report


def answer_batch(spark: SparkSession, table: DataFrame, questions: DataFrame, llm: Callable[[], answers.LLM], k: int = 5, project: str = "", tries: int = 3, **options) -> DataFrame:
    """(query_id, answer, error, attempts, sources) of a table (query_id, query) of questions.

    Questions are asked by one batched search; prompts go to the callable that ``llm`` makes once a
    task, so as many run at a time as there are partitions of ``questions``. A call that raises is
    tried again, and after ``tries`` its row has the error in place of an answer. A blank or null
    question is an error of its own row and is not searched for.
    """
    asked = questions.select("query_id", strip(F.col("query")).alias("query"))
    good = asked.filter(F.coalesce(F.col("query"), F.lit("")) != "")
    found = search_table(spark, table, good, k, **options)
    prompts = answers.prompts(found, good).join(answers.source_lists(found), "query_id", "left")
    parts = max(1, questions.rdd.getNumPartitions())
    told = answers.generate(prompts.repartition(parts, "query_id"), llm, project, tries)
    blank = asked.filter(F.coalesce(F.col("query"), F.lit("")) == "")
    refused = blank.select("query_id", F.lit(None).cast("string").alias("answer"), F.lit("query must not be empty").alias("error"), F.lit(0).alias("attempts"), F.lit(None).cast(told.schema["sources"].dataType).alias("sources"))
    return told.unionByName(refused)
