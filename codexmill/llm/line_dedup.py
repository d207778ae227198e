"""Line dedup: DataFrame functions only.

Plan: explode normalised lines of at least ``min_chars`` code points as
(hash, row, position), shuffle them once by (hash, salt), count distinct documents
per hash from that shuffle, join the counts back onto the same shuffle, and carry
only the positions to be dropped back to the documents. The counting side keeps each
part's last row and position too: with fewer columns it would be a shuffle of its own,
and every line would be split, normalised and hashed twice.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SALTS

#: The bytes x20 and x09-x0D, which are stripped at both ends of a line.
BLANKS = " \t\n\x0b\x0c\r"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def line_key(line: Column) -> Column:
    return F.translate(F.btrim(line, F.lit(BLANKS)), UPPER, UPPER.lower())


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def dropped_positions(docs: DataFrame, id_col: str, text_col: str, min_chars: int, min_docs: int) -> DataFrame:
    """(__cm_id, __cm_row, __cm_drop): the 0-based line positions that each row loses."""
    row = docs.select(
        F.col(id_col).alias("__cm_id"),
        F.xxhash64(F.lit(3), F.col(text_col)).alias("__cm_row"),
        F.posexplode(F.transform(_lines(F.col(text_col)), line_key)).alias("__cm_pos", "__cm_key"),
    ).filter(F.char_length("__cm_key") >= min_chars)
    lines = row.select(
        "__cm_id",
        "__cm_row",
        "__cm_pos",
        F.xxhash64(F.lit(1), "__cm_key").alias("__cm_h1"),
        F.xxhash64(F.lit(2), "__cm_key").alias("__cm_h2"),
        F.xxhash64(F.lit(4), "__cm_id").bitwiseAND(SALTS - 1).cast("int").alias("__cm_salt"),  # never null: a null check would part the branches
    ).repartition("__cm_h1", "__cm_h2", "__cm_salt")
    by_salt = (
        lines.groupBy("__cm_h1", "__cm_h2", "__cm_salt", "__cm_id")
        .agg(F.max("__cm_row").alias("__cm_last_row"), F.max("__cm_pos").alias("__cm_last_pos"))
        .groupBy("__cm_h1", "__cm_h2", "__cm_salt")
        .agg(F.count("__cm_id").alias("__cm_n"), F.max("__cm_id").alias("__cm_max"), F.max("__cm_last_row").alias("__cm_last_row"), F.max("__cm_last_pos").alias("__cm_last_pos"))
    )
    frequent = (
        by_salt.groupBy("__cm_h1", "__cm_h2")
        .agg(F.sum("__cm_n").alias("__cm_docs"), F.max("__cm_max").alias("__cm_keeper"), F.collect_list(F.struct("__cm_salt", "__cm_last_row", "__cm_last_pos")).alias("__cm_parts"))
        .filter(F.col("__cm_docs") >= min_docs)
        .select("__cm_h1", "__cm_h2", "__cm_keeper", F.inline("__cm_parts"))
    )
    return (
        lines.join(frequent, ["__cm_h1", "__cm_h2", "__cm_salt"])
        .filter((F.col("__cm_row") <= F.col("__cm_last_row")) & (F.col("__cm_pos") <= F.col("__cm_last_pos")))  # all rows of the part
        .filter(~F.col("__cm_id").eqNullSafe(F.col("__cm_keeper")))
        .groupBy("__cm_id", "__cm_row")
        .agg(F.collect_set("__cm_pos").alias("__cm_drop"))
    )


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 40, min_docs: int = 5) -> DataFrame:
    """Replace the text by the lines that stay; add ``n_lines`` and ``n_dropped``.

    A line's key is the line stripped of x20 and x09-x0D with A-Z in lower case. Keys of
    at least ``min_chars`` code points in at least ``min_docs`` distinct ids lose their
    lines in every document but the one with the largest id.

    Null text: one empty line, and the text stays null. Empty table: empty result.
    Repeated rows count as one document and all lose the same lines. A null id counts as
    no document and loses every frequent line. Other columns pass through; the working
    columns start with ``__cm_``; columns named like the two added ones are replaced.
    """
    drops = dropped_positions(docs, id_col, text_col, min_chars, min_docs)
    on = [docs[id_col].eqNullSafe(drops["__cm_id"]), F.xxhash64(F.lit(3), docs[text_col]) == drops["__cm_row"]]
    text, lines = F.col(text_col), _lines(F.col(text_col))
    kept = F.array_except(F.sequence(F.lit(0), F.size("__cm_split") - 1), F.col("__cm_drop"))
    new = F.when(F.col("__cm_drop").isNull(), text).otherwise(F.array_join(F.transform("__cm_kept", lambda i: F.get(F.col("__cm_split"), i)), "\n"))
    joined = docs.join(drops, on[0] & on[1], "left").drop("__cm_id", "__cm_row")
    return (
        joined.withColumn("n_lines", (F.char_length(F.coalesce(text, F.lit(""))) - F.char_length(F.replace(F.coalesce(text, F.lit("")), F.lit("\n"), F.lit(""))) + 1).cast("long"))
        .withColumn("n_dropped", F.coalesce(F.size("__cm_drop"), F.lit(0)).cast("long"))
        .withColumn("n_dropped", F.greatest("n_dropped", F.lit(0).cast("long")))
        .withColumn("__cm_split", F.when(F.col("__cm_drop").isNotNull(), lines))
        .withColumn("__cm_kept", F.when(F.col("__cm_drop").isNotNull(), kept))
        .withColumn(text_col, new)
        .drop("__cm_drop", "__cm_split", "__cm_kept")
    )
