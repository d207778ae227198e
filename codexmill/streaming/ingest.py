"""An extension, not parity: JSONL files as a stream, into the store.

Every micro-batch is published with its number, which the store's manifest keeps: a batch that a
restart repeats finds itself published and changes nothing.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.window import Window

from ..functions.embed import Embed, HashingEmbedder, embed_column
from ..functions.text import stem_of
from ..schemas import CHUNK, CONTEXT, DOCUMENT
from ..sources.files import parse_jsonl
from ..sources.store import Store

LINES = "value string"


def stream_jsonl(spark: SparkSession, folder: str, checkpoint: str, sink: Callable[[DataFrame, int], None], trigger: dict | None = None) -> StreamingQuery:
    """Parse JSONL lines of files as they arrive and hand each micro-batch to ``sink``.

    ``part`` is where a line's split starts and ``n`` orders the lines within it; they are no
    line numbers, as a stream does not count a file's other splits.
    """
    text = spark.readStream.schema(LINES).option("pathGlobFilter", "*.jsonl").text(folder)
    lines = text.select(F.col("_metadata.file_name").alias("filename"), F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("part"), F.col("value").alias("line"))

    def parsed(batch: DataFrame, number: int) -> None:
        sink(parse_jsonl(batch.withColumn("n", F.monotonically_increasing_id()), also=("path", "part")), number)

    return lines.writeStream.foreachBatch(parsed).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def publish(store: Store, name: str, model: Callable[[], Embed] = HashingEmbedder) -> Callable[[DataFrame, int], None]:
    """A sink for ``stream_jsonl``: the files of a batch replace their versions in the store.

    A file comes whole in one batch. Rows that don't count leave the file's old version if none is
    left; lexemes are left to the search that needs them.
    """

    def put(batch: DataFrame, number: int) -> None:
        rows = batch.filter("item is not null")
        order = Window.partitionBy("filename").orderBy("part", "n")
        told = batch.groupBy("filename").agg(F.min_by("document_title", F.when(F.col("document_title").isNotNull(), F.struct("part", "n"))).alias("_title"))
        made = {"document_id": F.xxhash64("filename"), "chunk_index": (F.row_number().over(order) - 1).cast("int"), "embedding": embed_column(F.col("item.content"), model)}
        made |= {c: F.col(f"item.{c}") for c in ("content", "article_number", "article_title", *CONTEXT, "source_format", "source_filename", "referenced_articles")}
        chunks = rows.withColumns(made).withColumn("chunk_id", F.xxhash64("filename", "chunk_index"))
        full = chunks.select(*[F.col(f.name) if f.name in chunks.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in CHUNK.fields])
        files = rows.groupBy("filename").agg(F.first("path").alias("source_path")).join(told, "filename")
        known = files.select("filename", "source_path", F.coalesce("_title", stem_of(F.col("filename"))).alias("title"), F.xxhash64("filename").alias("document_id"))
        store.replace(known.select(*[F.col(f.name) if f.name in known.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in DOCUMENT.fields]), full, batch=(name, number))

    return put
