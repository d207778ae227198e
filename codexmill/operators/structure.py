"""Article records from ordered lines: inherited headings, blocks, references."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.references import referenced_articles
from ..functions.text import fold, optional, slugify, stem_of
from ..schemas import CONTEXT, RECORD

#: Fixed patterns of heading lines, tested in this order.
HEADINGS = {
    "section": r"(?iuU)^Раздел\s+.+",
    "subsection": r"(?iuU)^Подраздел\s+.+",
    "chapter": r"(?iuU)^Глава\s+.+",
    "paragraph": r"(?iuU)^(?:Параграф|§)\s+.+",
    "article": r"(?iuU)^Статья\s+(\d+(?:\.\d+)*)(?:[.\s]+(.*))?$",
}
LEVELS = ("section", "subsection", "chapter", "paragraph")
#: Lines of a document that one task sorts.
SEGMENT = 50_000

#: Known documents by file name. (id, any-of keywords, [(part id, any-of)])
HTML_RULES = (
    ("tk_rf", ("трудов", "tk_rf", "trudov"), ()),
    ("uk_rf", ("уголовн", "uk_rf", "ugolovn"), ()),
    ("nk_rf_part_1", ("налогов", "nk_rf", "nalog"), (("nk_rf_part_2", ("часть вторая", "части второй", "часть 2", "part_2")),)),
    (
        "gk_rf_part_1",
        ("гражданск", "gk_rf", "grazhd"),
        (
            ("gk_rf_part_4", ("часть четвертая", "части четвертой", "часть 4", "part_4")),
            ("gk_rf_part_3", ("часть третья", "части третьей", "часть 3", "part_3")),
            ("gk_rf_part_2", ("часть вторая", "части второй", "часть 2", "part_2")),
        ),
    ),
)
TITLES = {
    "tk_rf": "Трудовой кодекс Российской Федерации",
    "uk_rf": "Уголовный кодекс Российской Федерации",
    "nk_rf_part_1": "Налоговый кодекс Российской Федерации. Часть первая",
    "nk_rf_part_2": "Налоговый кодекс Российской Федерации. Часть вторая",
    "gk_rf_part_1": "Гражданский кодекс Российской Федерации. Часть первая",
    "gk_rf_part_2": "Гражданский кодекс Российской Федерации. Часть вторая",
    "gk_rf_part_3": "Гражданский кодекс Российской Федерации. Часть третья",
    "gk_rf_part_4": "Гражданский кодекс Российской Федерации. Часть четвертая",
}
#: (id, title, output file, all-of keywords)
DOCX_RULES = (
    ("zkpp_rf", "Закон Российской Федерации «О защите прав потребителей»", "zakon_o_zashite_prav_potrebiteley.jsonl", ("защит", "прав", "потребител")),
    ("sk_rf", "Семейный кодекс Российской Федерации", "semeynyy_kodeks_rf.jsonl", ("семейн", "кодекс")),
    ("zhk_rf", "Жилищный кодекс Российской Федерации", "zhilishchnyy_kodeks_rf.jsonl", ("жилищн", "кодекс")),
)


def kind(line: Column, headings: dict[str, str] = HEADINGS) -> Column:
    out = None
    for name, pattern in headings.items():
        out = F.when(line.rlike(pattern), name) if out is None else out.when(line.rlike(pattern), name)
    return out


def _marked(rows: DataFrame, headings: dict[str, str]) -> DataFrame:
    """Each line's kind, whether it opens a block, and what it says of each level: its text, nothing, or null if silent."""
    rows = rows.withColumn("kind", kind(F.col("line"), headings))
    for i, level in enumerate(LEVELS):
        # a heading of a higher level writes a null into the ones below
        said = F.when(F.col("kind") == level, F.struct(F.col("line").alias("v"))).when(F.col("kind").isin(*LEVELS[:i]), F.struct(F.lit(None).cast("string").alias("v")))
        rows = rows.withColumn(CONTEXT[i], said)
    return rows.withColumn("_opens", F.col("kind").isNotNull().cast("long"))


def _handed_on(rows: DataFrame, doc: str, headings: dict[str, str]) -> DataFrame:
    """(doc, segment, what the segments before it hand on): a scan over one row a segment.

    A segment hands on its number of blocks and the last it says of each level; those combine by
    adding and by taking the later one, so a segment needs the combination of those before it alone.
    Only documents of several segments are looked at.
    """
    long = rows.filter("_segment > 0").select(doc).distinct()
    each = _marked(rows.join(long, doc, "left_semi"), headings).groupBy(doc, "_segment").agg(
        F.sum("_opens").alias("_blocks"), *[F.max_by(c, F.when(F.col(c).isNotNull(), F.col("n"))).alias(f"_before_{c}") for c in CONTEXT]
    )
    before = Window.partitionBy(doc).orderBy("_segment").rowsBetween(Window.unboundedPreceding, -1)
    return each.select(doc, "_segment", F.sum("_blocks").over(before).alias("_blocks"), *[F.last(f"_before_{c}", ignorenulls=True).over(before).alias(f"_before_{c}") for c in CONTEXT])


def extract_records(lines: DataFrame, doc: str = "doc", order: str = "n", line: str = "line", headings: dict[str, str] = HEADINGS, segment: int = SEGMENT) -> DataFrame:
    """One row per article: doc, n (its line), context titles, number, title, text, references.

    A heading clears the levels below it. Any heading ends the open article; lines after
    a heading that is no article belong to nothing and are dropped. Lines are numbered from 0 or
    later in each document; ``segment`` of them are sorted in one task, so a document of any
    number of lines is spread over many, and only an article's own lines come together.
    """
    rows = lines.select(doc, F.col(order).alias("n"), F.col(line).alias("line"), F.floor(F.col(order) / segment).alias("_segment"))
    marks = _marked(rows, headings)
    upto = Window.partitionBy(doc, "_segment").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    marks = marks.withColumns({f"_{c}": F.last(c, ignorenulls=True).over(upto) for c in CONTEXT} | {"block": F.sum("_opens").over(upto)})
    told = _handed_on(rows, doc, headings)
    found = marks.join(told, [doc, "_segment"], "left")
    rows = found.select(doc, "n", "line", "kind", *[F.coalesce(f"_{c}", f"_before_{c}")["v"].alias(c) for c in CONTEXT], (F.col("block") + F.coalesce("_blocks", F.lit(0))).alias("block"))
    grouped = rows.filter("block > 0").groupBy(doc, "block").agg(
        F.min(F.struct("n", "kind", *CONTEXT, "line")).alias("head"),
        F.array_sort(F.collect_list(F.struct("n", "line"))).alias("all"),
    )
    texts = F.transform("all", lambda s: s["line"])
    body = F.array_join(F.slice(texts, F.lit(2), F.greatest(F.size(texts) - 1, F.lit(0))), "\n")
    out = grouped.filter("head.kind = 'article'").select(
        doc,
        "head.n",
        *[F.col(f"head.{c}").alias(c) for c in CONTEXT],
        F.regexp_extract("head.line", headings["article"], 1).alias("article_number"),
        optional(F.regexp_extract("head.line", headings["article"], 2)).alias("article_title"),
        F.when(F.size("all") == 1, F.col("head.line")).otherwise(F.concat(F.col("head.line"), F.lit("\n\n"), body)).alias("text"),
    )
    return out.withColumn("referenced_articles", referenced_articles(F.col("text"), F.col("article_number")))


def _any(x: Column, words: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | F.contains(x, F.lit(w))
    return out


def html_document_id(filename: Column) -> Column:
    stem = stem_of(filename)
    name, out = fold(stem), None
    for base, words, parts in HTML_RULES:
        value = F.lit(base)
        for part, signs in reversed(parts):
            value = F.when(_any(name, signs), part).otherwise(value)
        out = F.when(_any(name, words), value) if out is None else out.when(_any(name, words), value)
    return F.coalesce(out, slugify(stem))


def html_title(filename: Column) -> Column:
    found = F.create_map(*[F.lit(x) for pair in TITLES.items() for x in pair])
    return F.coalesce(F.try_element_at(found, html_document_id(filename)), stem_of(filename))


def docx_metadata(filename: Column) -> Column:
    """struct(document_id, document_title, output_filename, recognised)."""
    stem = stem_of(filename)
    name, slug = fold(stem), slugify(stem)
    out = None
    for ident, title, output, words in DOCX_RULES:
        hit = F.lit(True)
        for w in words:
            hit = hit & F.contains(name, F.lit(w))
        value = F.struct(F.lit(ident).alias("document_id"), F.lit(title).alias("document_title"), F.lit(output).alias("output_filename"), F.lit(True).alias("recognised"))
        out = F.when(hit, value) if out is None else out.when(hit, value)
    return out.otherwise(F.struct(slug.alias("document_id"), stem.alias("document_title"), F.concat(slug, F.lit(".jsonl")).alias("output_filename"), F.lit(False).alias("recognised")))


def to_records(lines: DataFrame, source_format: str) -> DataFrame:
    """Lines (source_filename, n, line) to records of the JSONL schema, plus n for order."""
    found = extract_records(lines, "source_filename")
    name = F.col("source_filename")
    if source_format == "docx":
        meta = docx_metadata(name)
        ident, title = meta["document_id"], meta["document_title"]
    else:
        ident, title = html_document_id(name), html_title(name)
    full = found.withColumns({"document_id": ident, "document_title": title, "source_format": F.lit(source_format), "source_url": F.lit(None).cast("string")})
    return full.select(*RECORD.fieldNames(), "n")
