"""Chat history: sanitising, the last messages, display values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

LIMIT = 100
#: The fields of a source that history keeps.
SOURCE_FIELDS = ("document_title", "filename", "source_filename", "section_title", "subsection_title", "chapter_title", "paragraph_title", "article_number", "article_title")


def mode_or(mode: Column, fallback: str | None = None) -> Column:
    return F.when(mode.isin("semantic", "hybrid"), mode).otherwise(F.lit(fallback))


def mode_label(mode: Column) -> Column:
    return F.when(mode == "semantic", "семантический").otherwise("гибридный")


def sanitize_source(source: Column) -> Column:
    """A map of only the known fields with a value; null if none is left."""
    kept = F.map_filter(source, lambda k, v: k.isin(*SOURCE_FIELDS) & v.isNotNull())
    return F.when(F.size(kept) > 0, kept)


def normalize_messages(messages: DataFrame) -> DataFrame:
    """Messages of users and assistants with text; sources and mode only of assistants."""
    rows = messages.filter(F.col("role").isin("user", "assistant") & F.col("content").isNotNull())
    assistant = F.col("role") == "assistant"
    if "sources" in rows.columns:
        clean = F.filter(F.transform(F.coalesce("sources", F.array().cast(dict(rows.dtypes)["sources"])), sanitize_source), lambda s: s.isNotNull())
        rows = rows.withColumn("sources", F.when(assistant, clean).otherwise(F.slice(clean, 1, 0)))
    if "retrievalMode" in rows.columns:
        rows = rows.withColumn("retrievalMode", F.when(assistant, mode_or(F.col("retrievalMode"))))
    return rows


def last_messages(messages: DataFrame, order: list[str], by: list[str] | None = None, limit: int = LIMIT) -> DataFrame:
    """The last ``limit`` messages, of all or of each group, with position ``n`` from the end."""
    if not by:
        newest = messages.orderBy(*[F.desc(c) for c in order]).limit(limit)
        return newest.withColumn("n", F.row_number().over(Window.orderBy(*[F.desc(c) for c in order])))  # at most limit rows
    w = Window.partitionBy(*by).orderBy(*[F.desc(c) for c in order])
    return messages.withColumn("n", F.row_number().over(w)).filter(F.col("n") <= limit)


def create_messages(rows: DataFrame, at: Column, ident: Column | None = None) -> DataFrame:
    """History messages (id, role, content, sources, createdAt, retrievalMode) of new ones.

    Any role but assistant is a user's. Null content is the empty text. Sources are sanitised and a
    known mode kept for assistants alone; a user's message has no sources. ``at`` is the time of making
    and ``ident`` the id (a random one unless given). Columns of the rows that are not named stay.
    """
    role = F.when(F.col("role") == "assistant", "assistant").otherwise("user")
    none = F.array().cast("array<map<string,string>>")
    given = F.coalesce("sources", none) if "sources" in rows.columns else none
    clean = F.filter(F.transform(given, sanitize_source), lambda s: s.isNotNull())
    mode = F.col("retrievalMode") if "retrievalMode" in rows.columns else F.lit(None).cast("string")
    return rows.withColumns({
        "id": F.uuid() if ident is None else ident,
        "role": role,
        "content": F.coalesce(F.col("content").cast("string"), F.lit("")),
        "sources": F.when(role == "assistant", clean).otherwise(none),
        "createdAt": F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"),
        "retrievalMode": F.when(role == "assistant", mode_or(mode)),
    })


def format_number(x: Column, places: int = 4) -> Column:
    """Fixed places with trailing zeros dropped."""
    return F.regexp_replace(F.regexp_replace(F.format_string(f"%.{places}f", x.cast("double")), r"(\.\d*?)0+$", "$1"), r"\.$", "")


def article_label(number: Column, title: Column) -> Column:
    number, title = F.nullif(number, F.lit("")), F.nullif(title, F.lit(""))
    return F.nullif(F.concat_ws(". ", F.when(number.isNotNull(), F.concat(F.lit("Статья "), number)), title), F.lit(""))


#: Names shown for known files, by parts of the file's name, in order.
KNOWN_NAMES = (
    (("tk_rf", "trud"), "Трудовой кодекс Российской Федерации"),
    (("uk_rf", "ugol"), "Уголовный кодекс Российской Федерации"),
    (("gk_rf", "grazhd"), "Гражданский кодекс Российской Федерации"),
    (("nk_rf", "nalog"), "Налоговый кодекс Российской Федерации"),
)


def known_name(filename: Column) -> Column:
    low, out = F.lower(filename), F.lit(None).cast("string")
    for parts, name in reversed(KNOWN_NAMES):
        hit = F.contains(low, F.lit(parts[0])) | F.contains(low, F.lit(parts[1]))
        out = F.when(hit, name).otherwise(out)
    return out


def source_title(document_title: Column, filename: Column, source_filename: Column) -> Column:
    return F.coalesce(F.nullif(document_title, F.lit("")), known_name(filename), known_name(source_filename), F.lit("Нормативный документ"))
