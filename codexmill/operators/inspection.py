"""Chunk statistics and report rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.references import referenced_articles
from ..functions.text import preview

#: Fixed pattern, case-sensitive: the first article that a text names.
NAMED = r"Статья\s+([0-9]+(?:\.[0-9]+)*)"


def suspicious(content: Column, number: Column) -> Column:
    """The text names an article first that is not its own."""
    named = F.nullif(F.regexp_extract(content, NAMED, 1), F.lit(""))
    return F.coalesce(named.isNotNull() & ~named.eqNullSafe(number), F.lit(False))


def chunk_rows(chunks: DataFrame) -> DataFrame:
    """The seven report columns of (chunk_index, article_number, article_title, content)."""
    return chunks.select(
        "chunk_index",
        F.coalesce("article_number", F.lit("")).alias("article_number"),
        F.coalesce("article_title", F.lit("")).alias("article_title"),
        F.array_join(referenced_articles(F.col("content"), F.col("article_number")), ";").alias("referenced_articles"),
        F.char_length("content").alias("length"),
        preview(F.col("content")).alias("start_text"),
        "content",
    )


def chunk_stats(chunks: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Counts and lengths of chunks, over all or per group; zeros where there are none."""
    size = F.char_length("content")
    numbered = F.coalesce(F.col("article_number") != "", F.lit(False))
    zero = lambda c: F.coalesce(c, F.lit(0))
    return chunks.groupBy(*(by or [])).agg(
        F.count(F.lit(1)).alias("chunks"),
        F.count_if(numbered).alias("with_article"),
        F.count_if(~numbered).alias("without_article"),
        zero(F.min(size)).alias("min_length"),
        zero(F.avg(size)).alias("mean_length"),
        zero(F.median(size)).alias("median_length"),
        zero(F.max(size)).alias("max_length"),
        F.count_if(F.contains(F.col("content"), F.lit("\f"))).alias("with_form_feed"),
        F.count_if(F.size(referenced_articles(F.col("content"), F.col("article_number"))) > 0).alias("with_references"),
        F.count_if(suspicious(F.col("content"), F.col("article_number"))).alias("suspicious"),
    )
