"""Readers: TXT, JSONL with issue classes, HTML, DOCX, evaluation cases, chat history.

Every reader goes through Spark's file sources, so paths may be in any store it reaches.
Row order is never relied on: lines carry their number.
"""

from __future__ import annotations

import functools
import io
import re
import zipfile
from html.parser import HTMLParser
from xml.etree import ElementTree

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..functions.references import referenced_articles
from ..functions.text import normalize_docx_line, normalize_html_line, normalize_text, optional, stem_of, strip
from ..operators.chunking import ARTICLE_LINE, legal_rows
from ..schemas import CASE

ITEM = "struct<content:string,article_number:string,article_title:string,section_title:string,subsection_title:string,chapter_title:string,paragraph_title:string,source_format:string,source_filename:string,referenced_articles:array<string>>"
#: Elements whose text is not shown.
HIDDEN = ("script", "style", "meta", "noscript")


def list_files(spark: SparkSession, folder: str, suffixes: tuple[str, ...]) -> DataFrame:
    """(path, filename, content) of the files with these suffixes, in any letter case; a missing folder has none."""
    try:
        every = spark.read.format("binaryFile").load(folder)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        every = spark.createDataFrame([], "path string, content binary")
    found = every.select("path", F.element_at(F.split("path", "/"), -1).alias("filename"), "content")
    found = found.withColumn("filename", F.url_decode(F.replace("filename", F.lit("+"), F.lit("%2B"))))
    return found.filter(F.lower("filename").rlike("(" + "|".join(re.escape(s) for s in suffixes) + ")$"))


@F.pandas_udf(T.StringType())
def _cp1251(content: pd.Series) -> pd.Series:
    def read(b: bytes | None) -> str | None:
        try:
            return None if b is None else bytes(b).decode("cp1251")
        except UnicodeDecodeError:
            return None

    return content.map(read)


def decode_text(content: Column, fallback: bool = False) -> Column:
    """UTF-8, else cp1251 where asked for, else null."""
    utf8 = F.when(F.is_valid_utf8(content.cast("string")), content.cast("string"))
    return F.coalesce(utf8, _cp1251(content)) if fallback else utf8


#: Splits of text files whose line counts are sent to all tasks; with more they are joined.
SPLITS = 100_000


def _glob(suffix: str) -> str:
    """A file pattern for a suffix in any letter case."""
    return "*" + "".join(f"[{c.lower()}{c.upper()}]" if c.isalpha() else c for c in suffix)


def _loaded(spark: SparkSession, kind: str, folder: str, suffix: str, schema: str) -> DataFrame:
    try:
        return spark.read.format(kind).option("pathGlobFilter", _glob(suffix)).load(folder)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def _named(rows: DataFrame) -> DataFrame:
    name = F.url_decode(F.replace(F.element_at(F.split("path", "/"), -1), F.lit("+"), F.lit("%2B")))
    return rows.withColumn("filename", name)


def list_names(spark: SparkSession, folder: str, suffixes: tuple[str, ...]) -> DataFrame:
    """(path, filename) of the files with these suffixes; no content is read."""
    found = [_loaded(spark, "binaryFile", folder, s, "path string").select("path") for s in suffixes]
    return _named(functools.reduce(DataFrame.unionByName, found)).select("path", "filename")


def read_lines(spark: SparkSession, folder: str, suffix: str) -> DataFrame:
    """(path, filename, part, n, line) of all text files with a suffix, lines numbered from 1 in each file.

    Files are split among tasks as Spark splits any text, whatever their size. A first pass counts
    the lines of each split; the counts of a file's earlier splits and a line's place in its own
    give its number. ``part`` is where the split starts. A file without lines has no rows, and a
    folder that is missing no files. Bytes that are no UTF-8 give null lines.
    """
    try:
        text = spark.read.option("pathGlobFilter", _glob(suffix)).text(folder)
        raw = text.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("part"), F.monotonically_increasing_id().alias("_id"), "value")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        raw = spark.createDataFrame([], "path string, part long, _id long, value string")
    splits = raw.groupBy("path", "part").agg(F.min("_id").alias("_first"), F.count(F.lit(1)).alias("_lines"))
    earlier = F.sum("_lines").over(Window.partitionBy("path").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    splits = splits.withColumn("_before", F.coalesce(earlier, F.lit(0)))
    few = splits.limit(SPLITS + 1).collect()
    splits = F.broadcast(spark.createDataFrame(few, splits.schema)) if len(few) <= SPLITS else splits
    at = F.col("_id") - F.col("_first")
    n = F.when(at.between(0, F.col("_lines") - 1), F.col("_before") + at + 1).otherwise(F.raise_error(F.lit("the splits of a file have changed while it was read")).cast("long"))
    line = F.when(F.is_valid_utf8("value"), F.col("value"))
    return _named(raw.join(splits, ["path", "part"]).select("path", "part", n.alias("n"), line.alias("line"))).select("path", "filename", "part", "n", "line")


def text_blocks(lines: DataFrame) -> DataFrame:
    """(path, filename, part, text) of TXT lines: the text up to a file's first article, then each article.

    Blocks are numbered by headings up to a line: counted within a split, and summed over a
    file's earlier splits. A block is one value; lines of a long file meet only within it.
    """
    inner = F.posexplode(F.split(normalize_text(F.coalesce("line", F.lit(""))), "\n")).alias("_k", "line")
    rows = lines.select("path", "filename", "part", "n", inner).withColumn("_head", F.col("line").rlike(ARTICLE_LINE).cast("long"))
    heads = rows.groupBy("path", "part").agg(F.sum("_head").alias("_heads"))
    before = F.sum("_heads").over(Window.partitionBy("path").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    within = F.sum("_head").over(Window.partitionBy("path", "part").orderBy("n", "_k").rowsBetween(Window.unboundedPreceding, 0))
    base = heads.select("path", "part", F.coalesce(before, F.lit(0)).alias("_base"))
    numbered = rows.withColumn("_within", within).join(base, ["path", "part"]).withColumn("block", F.col("_base") + F.col("_within"))
    told = F.transform(F.array_sort(F.collect_list(F.struct("n", "_k", "line"))), lambda s: s["line"])
    return numbered.groupBy("path", "filename", F.col("block").alias("part")).agg(F.array_join(told, "\n").alias("text"))


PARSED = f"path string, filename string, part long, n long, item {ITEM}, said string, title string"


def read_texts(spark: SparkSession, folder: str, size: int = 1200, n_overlap: int = 200) -> DataFrame:
    """The chunks of *.txt by the legal splitter, a row each (see ``PARSED``); an article is split in one task."""
    null = [F.lit(None).cast("string").alias(n) for n in ("section_title", "subsection_title", "chapter_title", "paragraph_title", "source_format", "source_filename")]
    chunks = legal_rows(text_blocks(read_lines(spark, folder, ".txt")), "text", size, n_overlap)
    item = F.struct("content", "article_number", "article_title", *null, referenced_articles(F.col("content"), F.col("article_number")).alias("referenced_articles"))
    return chunks.select("path", "filename", "part", F.col("chunk_index").cast("long").alias("n"), item.cast(ITEM).alias("item"), F.lit(None).cast("string").alias("said"), stem_of(F.col("filename")).alias("title"))


def parse_jsonl(lines: DataFrame, file: str = "filename", number: str = "n", line: str = "line", also: tuple[str, ...] = ()) -> DataFrame:
    """Classify and project JSONL lines: adds class (ok, blank, invalid, not_object, empty_text) and item.

    A null line is invalid. Columns named in ``also`` pass through.

    Values that are no strings are taken as their text, true as ``True``; null and blank
    count as missing. Objects and lists keep their JSON text.
    """
    doc = F.try_parse_json(F.col("_raw"))

    def text(name: str) -> Column:
        said = F.try_variant_get("_v", f"$.{name}", "string")
        flag = F.schema_of_variant(F.try_variant_get("_v", f"$.{name}", "variant")) == "BOOLEAN"
        return optional(F.when(flag, F.initcap(said)).otherwise(said))

    rows = lines.select(file, *also, F.col(number).alias("n"), strip(F.col(line)).alias("_raw")).withColumn("_v", doc)
    rows = rows.withColumn("_kind", F.schema_of_variant("_v"))
    refs = F.from_json(F.get_json_object("_raw", "$.referenced_articles"), "array<string>")
    given = F.startswith(F.coalesce(F.get_json_object("_raw", "$.referenced_articles"), F.lit("")), F.lit("["))
    cleaned = F.when(given, F.filter(F.transform(refs, strip), lambda r: r.isNotNull() & (r != ""))).otherwise(F.array().cast("array<string>"))
    item = F.struct(
        text("text").alias("content"),
        *[text(n).alias(n) for n in ("article_number", "article_title", "section_title", "subsection_title", "chapter_title", "paragraph_title", "source_format")],
        F.coalesce(text("source_filename"), text("filename")).alias("source_filename"),
        F.coalesce(cleaned, F.array().cast("array<string>")).alias("referenced_articles"),
    )
    kind = (
        F.when(F.col("_raw") == "", "blank")
        .when(F.col("_v").isNull(), "invalid")
        .when(~F.startswith("_kind", F.lit("OBJECT")), "not_object")
        .when(text("text").isNull(), "empty_text")
        .otherwise("ok")
    )
    return rows.select(file, *also, "n", kind.alias("class"), F.when(F.startswith("_kind", F.lit("OBJECT")), text("document_title")).alias("document_title"), F.when(kind == "ok", item).alias("item"))


#: Fixed wording of the issues, by class.
ISSUES = {"invalid": "invalid JSON", "not_object": "JSON value is not an object", "empty_text": "empty text"}


def read_jsonl(spark: SparkSession, folder: str) -> DataFrame:
    """The lines of *.jsonl that are not blank, a row each (see ``PARSED``): an item, or what is said of a bad line.

    ``title`` is a line's own, also of lines without text; ``n`` its number.
    """
    lines = read_lines(spark, folder, ".jsonl")
    parsed = parse_jsonl(lines, also=("path", "part"))
    said = None
    for name, words in ISSUES.items():
        text = F.concat("filename", F.lit(": line "), F.col("n").cast("string"), F.lit(f" skipped, {words}"))
        said = F.when(F.col("class") == name, text) if said is None else said.when(F.col("class") == name, text)
    return parsed.filter("class <> 'blank'").select("path", "filename", "part", "n", F.col("item").cast(ITEM).alias("item"), said.alias("said"), F.col("document_title").alias("title"))


def read_folder(spark: SparkSession, folder: str, size: int = 1200, n_overlap: int = 200) -> DataFrame:
    """The rows of all TXT and JSONL files of a folder (see ``PARSED``)."""
    return read_texts(spark, folder, size, n_overlap).unionByName(read_jsonl(spark, folder))


def indexed(rows: DataFrame, told: DataFrame | None = None) -> DataFrame:
    """The rows with an item, with ``chunk_index`` from 0 in each file by (part, n).

    Only a file's parts are counted along it; chunks are numbered within their part. Columns of ``told``,
    a row a filename, come with the parts, so that the rows themselves are shuffled once; files that it has not are left out.
    """
    items = rows.filter(F.col("item").isNotNull())
    counts = items.groupBy("filename", "part").agg(F.count(F.lit(1)).alias("_n"))
    earlier = F.sum("_n").over(Window.partitionBy("filename").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    base = counts.withColumn("_base", F.coalesce(earlier, F.lit(0))).drop("_n")
    base = base if told is None else base.join(told, "filename")
    within = F.row_number().over(Window.partitionBy("filename", "part").orderBy("n"))
    return items.withColumn("_within", within).join(base, ["filename", "part"]).withColumn("chunk_index", (F.col("_base") + F.col("_within") - 1).cast("int")).drop("_within", "_base")


# HTML


def _drop_hidden(x: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(x, r"(?is)<!--.*?-->|<!DOCTYPE[^>]*>", ""), r"(?is)<(script|style|noscript)\b[^>]*>.*?</\1\s*>|<meta\b[^>]*>", "")


#: Named entities that the native reader knows; the parser's reader knows all.
ENTITIES = {"&nbsp;": "\u00a0", "&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&amp;": "&"}


def html_lines_native(html: Column) -> Column:
    """Text nodes as lines, JVM only: for well-formed pages with common entities."""
    x = F.regexp_replace(_drop_hidden(F.coalesce(html, F.lit(""))), r"(?s)<[^>]*>", "\n")
    for name, value in ENTITIES.items():
        x = F.replace(x, F.lit(name), F.lit(value))
    parts = F.split(x, "\r\n|[\n\r\\x0B\\x0C\\x1C-\\x1E\u0085\u2028\u2029]")
    return F.filter(F.transform(parts, normalize_html_line), lambda p: p != "")


class _Nodes(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.nodes: list[str] = []
        self.hidden = 0

    def handle_starttag(self, tag: str, attrs: object) -> None:
        self.hidden += tag in HIDDEN and tag != "meta"
        self.nodes.append("\n")

    def handle_endtag(self, tag: str) -> None:
        if tag in HIDDEN and tag != "meta" and self.hidden:
            self.hidden -= 1
        self.nodes.append("\n")

    def handle_data(self, data: str) -> None:
        if not self.hidden:
            self.nodes.append(data)


def html_lines(html: str | None) -> list[str]:
    """Each text node on lines of its own, normalised, blank ones dropped."""
    parser = _Nodes()
    parser.feed(html or "")
    parser.close()
    out = (re.sub("[ \t\f\v\u00a0]+", " ", x.replace("\ufeff", "")).strip() for x in "".join(parser.nodes).splitlines())
    return [x for x in out if x]


@F.pandas_udf(T.ArrayType(T.StringType()))
def html_lines_udf(pages: pd.Series) -> pd.Series:
    return pages.map(html_lines)


def read_html(spark: SparkSession, folder: str) -> DataFrame:
    """(source_filename, n, line) of *.htm and *.html, UTF-8 or cp1251.

    A file that neither decodes has the row (name, null, null), so it can be reported.
    """
    files = list_files(spark, folder, (".htm", ".html")).select(F.col("filename").alias("source_filename"), decode_text(F.col("content"), True).alias("html"))
    return files.select("source_filename", F.posexplode_outer(F.when(F.col("html").isNotNull(), html_lines_udf("html"))).alias("n", "line"))


# DOCX

_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def docx_paragraphs(content: bytes | None) -> list[str] | None:
    """Texts of the body's own paragraphs (not of tables); null if unreadable."""
    try:
        root = ElementTree.fromstring(zipfile.ZipFile(io.BytesIO(bytes(content or b""))).read("word/document.xml"))
    except (zipfile.BadZipFile, KeyError, ElementTree.ParseError):
        return None
    texts = {f"{_W}t": None, f"{_W}tab": "\t", f"{_W}br": "\n", f"{_W}cr": "\n"}
    body = root.find(f"{_W}body")
    out = []
    for p in body.findall(f"{_W}p") if body is not None else ():
        out.append("".join((e.text or "") if texts[e.tag] is None else texts[e.tag] for e in p.iter() if e.tag in texts))
    return out


@F.pandas_udf(T.ArrayType(T.StringType()))
def docx_paragraphs_udf(contents: pd.Series) -> pd.Series:
    return contents.map(docx_paragraphs)


def read_docx(spark: SparkSession, folder: str) -> DataFrame:
    """(source_filename, n, line) of *.docx; an unreadable file has the row (name, null, null)."""
    files = list_files(spark, folder, (".docx",)).select(F.col("filename").alias("source_filename"), docx_paragraphs_udf("content").alias("p"))
    lines = F.filter(F.transform("p", normalize_docx_line), lambda x: x != "")
    return files.select("source_filename", F.posexplode_outer(lines).alias("n", "line"))


# evaluation cases and chat history


def read_cases(spark: SparkSession, path: str) -> DataFrame:
    """Evaluation cases of a JSON array; raises ValueError if it is none, or naming the first problem of the first bad case."""
    kind = F.coalesce(F.schema_of_variant(F.try_parse_json("value")), F.lit(""))
    if not spark.read.text(path, wholetext=True).filter(~F.startswith(kind, F.lit("ARRAY"))).isEmpty():
        raise ValueError("cases must be a JSON array")
    cases = spark.read.schema(CASE).option("multiLine", True).json(path)
    bad = case_problems(cases).filter("problem is not null").orderBy("id").first()
    if bad is not None:
        raise ValueError(f"case {bad['id']}: {bad['problem']}")
    if cases.isEmpty():
        raise ValueError("no cases")
    return cases


def case_problems(cases: DataFrame) -> DataFrame:
    """(id, problem): null for a valid case."""
    blank = lambda c: optional(F.coalesce(c, F.lit(""))).isNull()
    many = F.count(F.lit(1)).over(Window.partitionBy("id"))
    good_source = lambda s: ~blank(s["document_id"]) & ~blank(s["article_number"]) & F.coalesce(s["relevance"].isin("primary", "secondary", "acceptable"), F.lit(False))
    sources = F.coalesce(F.size("expected_sources") > 0, F.lit(False))
    legacy = F.coalesce(F.size("expected_article_numbers") > 0, F.lit(False))
    outside = F.coalesce(F.col("case_type") == "out_of_scope", F.lit(False))
    problem = (
        F.when(blank(F.col("id")), "id is blank")
        .when(many > 1, "id is repeated")
        .when(blank(F.col("question")), "question is blank")
        .when(outside & ~F.coalesce(F.col("expected_behavior") == "no_answer", F.lit(False)), "out_of_scope needs no_answer")
        .when(~outside & sources & ~F.forall("expected_sources", good_source), "an expected source is not valid")
        .when(~outside & ~sources & ~legacy, "nothing is expected")
    )
    return cases.select("id", problem.alias("problem"))


HISTORY = T.StructType([T.StructField(n, T.StringType()) for n in ("id", "role", "content", "createdAt", "retrievalMode")] + [T.StructField("sources", T.ArrayType(T.MapType(T.StringType(), T.StringType())))])


def read_history(spark: SparkSession, path: str) -> DataFrame:
    """Saved chat messages; a corrupt file gives none."""
    whole = spark.read.text(path, wholetext=True).select(F.from_json("value", T.ArrayType(HISTORY)).alias("m"))
    return whole.select(F.inline("m"))
