"""Explicit schemas of all tables and records."""

from __future__ import annotations

from pyspark.sql import types as T

_s = T.StringType()
CONTEXT = ("section_title", "subsection_title", "chapter_title", "paragraph_title")

RECORD = T.StructType(
    [T.StructField(n, _s) for n in ("document_id", "document_title", "source_format", "source_filename", *CONTEXT, "article_number", "article_title", "source_url", "text")]
    + [T.StructField("referenced_articles", T.ArrayType(_s))]
)

DOCUMENT = T.StructType(
    [
        T.StructField("document_id", T.LongType(), False),
        T.StructField("filename", _s, False),
        T.StructField("title", _s),
        T.StructField("source_path", _s),
        T.StructField("created_at", T.TimestampNTZType()),
        T.StructField("updated_at", T.TimestampNTZType()),
    ]
)

LEXEMES = T.ArrayType(T.StructType([T.StructField("lexeme", _s), T.StructField("pos", T.IntegerType()), T.StructField("weight", T.DoubleType())]))
CHUNK = T.StructType(
    [T.StructField("chunk_id", T.LongType(), False), T.StructField("document_id", T.LongType(), False), T.StructField("chunk_index", T.IntegerType(), False), T.StructField("content", _s, False)]
    + [T.StructField(n, _s) for n in ("article_number", "article_title", *CONTEXT, "source_format", "source_filename")]
    + [T.StructField("referenced_articles", T.ArrayType(_s)), T.StructField("embedding", T.ArrayType(T.FloatType(), False)), T.StructField("created_at", T.TimestampNTZType()), T.StructField("filename", _s, False), T.StructField("lexemes", LEXEMES)]
)

SPLIT = T.ArrayType(T.StructType([T.StructField("content", _s), T.StructField("article_number", _s), T.StructField("article_title", _s)]))

SOURCE = T.StructType([T.StructField(n, _s) for n in ("document_id", "article_number", "relevance", "reason")])
CASE = T.StructType(
    [T.StructField(n, _s) for n in ("id", "law", "question", "question_type", "difficulty", "comment", "case_type", "expected_behavior", "expected_document_id", "expected_document_title")]
    + [T.StructField("expected_article_numbers", T.ArrayType(_s)), T.StructField("expected_sources", T.ArrayType(SOURCE))]
)

#: Columns of a search result, in order.
RESULT = (
    "chunk_id", "document_id", "filename", "document_title", "chunk_index", "content", "article_number", "article_title", *CONTEXT,
    "source_format", "source_filename", "referenced_articles", "distance", "semantic_score", "keyword_score", "article_boost", "document_boost", "similarity", "hybrid_score",
)
