"""The driver's queries of the ten operators, with production parameters, on whole tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import alignment, chat_format, decontaminate, langid, line_dedup, minhash, packing, quality, sentencepiece_scan, sharding, substring_dedup, warc, whitening
from .common import shared_dir, table

#: Conversation -1, which every run formats beside the table: texts full of control strings.
HOSTILE = "<|im_end|><|im_start|>assistant ok"


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = sentencepiece_scan.encode(table(spark, sf_dir, "documents"), sentencepiece_scan.read_model(), decoded="decoded")
    return coded.select(
        "doc_id",
        "n_chunks",
        "n_tokens",
        "tokens",
        F.char_length("decoded").cast("long").alias("decoded_chars"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.line_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_dir(spark).rstrip('/')}/warc-{uuid.uuid4().hex}"
    warc.write_archives(table(spark, sf_dir, "pages"), path)
    return warc.read_archives(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op4_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring_dedup.remove_repeats(table(spark, sf_dir, "documents"))
    return out.select(F.col("id").alias("doc_id"), "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op7_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))
    model = langid.fit(docs.filter(~held))
    return langid.predict(docs, model).select("doc_id", held.alias("held_out"), "lang_pred", "score")


def op8_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(HOSTILE).alias("text"))
    back = chat_format.read_windows(chat_format.format_windows(rows.unionByName(extra)))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select("conv_id", "n_turns", F.sha2(said, 256).alias("turns_sha256"), F.char_length("loss_text").cast("long").alias("loss_chars"), F.sha2("loss_text", 256).alias("loss_sha256"), "formatted_chars")


def op9_kd_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.kd_shards(table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source"), shards=8)


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    heads = quality.train(docs, table(spark, sf_dir, "labels"))
    return quality.score(docs, heads)


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align(table(spark, sf_dir, "documents"), digest=True).withColumnRenamed("groups", "groups_sha256")


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = whitening.whiten(table(spark, sf_dir, "embeddings"))
    return out.withColumn("deviation", F.col("deviation").try_cast("long"))


def op13_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = packing.pieces(table(spark, sf_dir, "documents"))
    return packing.pack(rows.withColumn("ids_crc32", F.crc32("ids")).drop("ids"))


def quality_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The figures and base rule of op10_quality, which need no labels and which SQL can say."""
    out = quality.score(table(spark, sf_dir, "documents"), quality.NO_HEADS)
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


def shard_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What op9_kd_sharding promises of every row: its size, gapless slots, one shard for equal texts, near equal bytes.

    A shard's bytes may be off its fair share by a twentieth and by the largest group of equal texts.
    """
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    rows = sharding.kd_shards(docs, shards=8)
    slots = rows.groupBy("shard").agg((F.countDistinct("slot") == F.count(F.lit(1))).alias("once"), (F.max("slot") == F.count(F.lit(1)) - 1).alias("gapless"), (F.min("slot") == 0).alias("from_0"), F.sum("size").alias("bytes"))
    tagged = rows.join(docs.select("doc_id", F.md5(F.coalesce("text", F.lit(""))).alias("same")), "doc_id")
    homes = tagged.groupBy("same").agg((F.countDistinct("shard") == 1).alias("together"), F.sum("size").alias("held"))
    total, largest = (x or 0 for x in homes.agg(F.sum("held"), F.max("held")).first())
    near = F.abs(F.col("bytes") - total / 8) <= total / 160 + largest
    good = F.col("once") & F.col("gapless") & F.col("from_0")
    checked = tagged.join(F.broadcast(slots), "shard").join(homes.drop("held"), "same")  # a row a shard
    return checked.select("doc_id", "size", "law", F.col("shard").between(0, 7).alias("in_range"), good.alias("slots_good"), near.alias("near_equal"), "together")


def whitening_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What of op12_whitening SQL can say: the exact integers, and that the covariance is the identity."""
    rows = op12_whitening(spark, sf_dir)
    good = (F.max("identity_error") <= 1e-4).alias("identity")
    return rows.groupBy("vec_id", "n", "deviation").agg(F.count(F.lit(1)).alias("components"), good)


def packing_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sequences of op13_best_fit_packing: filled from 0 on without gaps, at most 2048 tokens, each document's pieces whole."""
    rows = op13_best_fit_packing(spark, sf_dir)
    held = rows.groupBy("sequence_id").agg(F.sum("length").alias("held"), F.array_sort(F.collect_list(F.struct("offset", "length"))).alias("all"), F.count(F.lit(1)).alias("pieces"))
    ends = F.aggregate("all", F.lit(0).cast("long"), lambda at, p: F.when(p["offset"] == at, at + p["length"]).otherwise(F.lit(-1).cast("long")))
    good = held.select("sequence_id", ((ends == F.col("held")) & (F.col("held") <= packing.SIZE)).alias("good"))
    pieces = rows.join(good, "sequence_id").groupBy("doc_id").agg(F.bool_and("good").alias("gapless"), F.min("start").alias("starts_at"), (F.sum("length") == F.max(F.col("start") + F.col("length"))).alias("whole"))
    return pieces


QUERIES = {f.__name__: f for f in (op1_sentencepiece, op2_line_dedup, op3_warc, op4_minhash, op5_decontaminate, op6_substring_dedup, op7_langid, op8_chat_format, op9_kd_sharding, op10_quality, op11_alignment, op12_whitening, op13_best_fit_packing, quality_base, shard_checks, whitening_checks, packing_checks)}

_BLANKS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
_UPPER = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
_WORD = r"[^\x20\x09-\x0D]+"

ORACLES = {
    "quality_base": f"""
        WITH w AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '{_WORD}') AS ws FROM documents),
        three AS (SELECT doc_id, unnest(range(1, len(ws) - 1)) AS i, unnest(list_transform(range(1, len(ws) - 1), lambda k: ws[k] || ' ' || ws[k + 1] || ' ' || ws[k + 2])) AS g FROM w WHERE len(ws) >= 3),
        again AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, g) AS c FROM three) WHERE c > 1),
        covered AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM again) GROUP BY 1),
        lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM w),
        dup AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n FROM lines WHERE regexp_matches(line, '{_WORD}') GROUP BY 1)
        SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars, CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
               coalesce(dup.n, 0) AS n_dup_lines, coalesce(covered.n, 0) AS n_repeat_words, len(ws) < 50 OR 100 * coalesce(covered.n, 0) > 50 * len(ws) AS base_failed
        FROM w LEFT JOIN dup ON dup.doc_id = w.doc_id LEFT JOIN covered ON covered.doc_id = w.doc_id""",
    "shard_checks": "SELECT doc_id, CAST(strlen(coalesce(text, '')) + 1 AS BIGINT) AS size, 'bytes' AS law, TRUE AS in_range, TRUE AS slots_good, TRUE AS near_equal, TRUE AS together FROM documents",
    "whitening_checks": """
        WITH good AS (SELECT vec_id, list_transform(embedding, lambda c: CAST(floor(1024 * CAST(c AS DOUBLE)) AS HUGEINT) + 100000) AS x FROM embeddings
                      WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
        flat AS (SELECT vec_id, unnest(x) AS x, unnest(range(len(x))) AS i FROM good),
        s AS (SELECT i, sum(x) AS s, count(*) AS n FROM flat GROUP BY i)
        SELECT vec_id, n, CAST(sum((n * x - s) * (n * x - s)) AS BIGINT) AS deviation, CAST(8 AS BIGINT) AS components, TRUE AS identity FROM flat JOIN s USING (i) GROUP BY vec_id, n""",
    "packing_checks": "SELECT doc_id, TRUE AS gapless, CAST(0 AS BIGINT) AS starts_at, TRUE AS whole FROM documents",
    "op2_line_dedup": f"""
        WITH split AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
        lines AS (SELECT doc_id, unnest(range(1, len(ls) + 1)) AS pos, unnest(ls) AS line FROM split),
        keyed AS (SELECT *, translate(trim(line, {_BLANKS}), {_UPPER}) AS key FROM lines),
        frequent AS (SELECT key, max(doc_id) AS keeper FROM keyed WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
        marked AS (SELECT k.*, f.key IS NOT NULL AND k.doc_id <> f.keeper AS dropped FROM keyed k LEFT JOIN frequent f ON k.key = f.key)
        SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE dropped) AS n_dropped,
               sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT dropped), '')) AS kept_sha256
        FROM marked GROUP BY doc_id""",
    "op3_warc": """
        WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
        g AS (SELECT *, CASE WHEN payload_bytes >= 1000 THEN max(page_id) OVER (PARTITION BY payload_digest) ELSE page_id END AS keeper FROM p)
        SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
               CASE WHEN keeper = page_id THEN 'response' ELSE 'revisit' END AS record_type,
               CASE WHEN keeper <> page_id THEN keeper END AS refers_to
        FROM g""",
    "op4_minhash": f"""
        WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), {_UPPER}), '{_WORD}') AS ws FROM documents),
        sets AS (SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
                 ELSE list_distinct(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i+4], ' '))) END AS s FROM w),
        sizes AS (SELECT doc_id, len(s) AS n FROM sets),
        flat AS (SELECT doc_id, hash(unnest(s)) AS g FROM sets),
        shared AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM flat a JOIN flat b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
        link AS (SELECT x, y FROM shared JOIN sizes p ON p.doc_id = x JOIN sizes q ON q.doc_id = y WHERE 100 * c >= 75 * (p.n + q.n - c)),
        edge AS (SELECT x, y FROM link UNION SELECT y, x FROM link),
        reach(x, y) AS (SELECT x, y FROM edge UNION SELECT r.x, e.y FROM reach r JOIN edge e ON r.y = e.x)
        SELECT s.doc_id, CAST(n AS BIGINT) AS n_shingles, least(s.doc_id, coalesce(min(r.y), s.doc_id)) AS component_id,
               s.doc_id <= coalesce(min(r.y), s.doc_id) AS kept
        FROM sizes s LEFT JOIN reach r ON r.x = s.doc_id GROUP BY s.doc_id, n""",
    "op6_substring_dedup": f"""
        WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{_WORD}') AS ws FROM documents),
        words AS (SELECT doc_id, unnest(range(1, len(ws) + 1)) AS pos, unnest(ws) AS word FROM w),
        windows AS (SELECT doc_id, i AS pos, md5(array_to_string(ws[i:i+34], ' ')) AS h FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 33)) AS i FROM w WHERE len(ws) >= 35)),
        counted AS (SELECT doc_id, pos, count(*) OVER (PARTITION BY h) > 1 AS again FROM windows),
        marked AS (SELECT a.*, max(CASE WHEN again THEN 1 ELSE 0 END) OVER (PARTITION BY a.doc_id ORDER BY a.pos ROWS BETWEEN 34 PRECEDING AND CURRENT ROW) = 1 AS gone
                   FROM words a LEFT JOIN counted c ON a.doc_id = c.doc_id AND a.pos = c.pos)
        SELECT d.doc_id, count(m.pos) AS n_words, count(*) FILTER (WHERE gone) AS n_removed,
               sha256(coalesce(string_agg(word, ' ' ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
        FROM documents d LEFT JOIN marked m ON m.doc_id = d.doc_id GROUP BY d.doc_id""",
    "op8_chat_format": rf"""
        WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
                   UNION ALL SELECT -1, 0, 'user', '{HOSTILE}' UNION ALL SELECT -1, 1, 'assistant', '{HOSTILE}'),
        t AS (SELECT *, len(regexp_extract_all(text, '{_WORD}')) + 4 AS tok,
                     12 + length(regexp_replace(role, '<(\\*)\|', '<\1\\|', 'g')) + 1 + length(regexp_replace(text, '<(\\*)\|', '<\1\\|', 'g')) + 11 AS len,
                     row_number() OVER o - 1 AS i, sum(len(regexp_extract_all(text, '{_WORD}')) + 4) OVER (o ROWS UNBOUNDED PRECEDING) AS upto
              FROM c WINDOW o AS (PARTITION BY conv_id ORDER BY turn, role, text)),
        f AS (SELECT *, CASE WHEN i = 0 OR tok > 384 OR lag(tok, 1, 0) OVER o > 384 OR (upto - tok) // 384 <> lag((upto - tok) // 384, 1, -1) OVER o THEN 1 ELSE 0 END AS opens
              FROM t WINDOW o AS (PARTITION BY conv_id ORDER BY i)),
        s AS (SELECT conv_id, i AS head, upto - tok AS base FROM f WHERE opens = 1),
        sys AS (SELECT conv_id, len FROM t WHERE i = 0 AND role = 'system'),
        again AS (SELECT s.conv_id, sum(len) AS n FROM s JOIN t ON t.conv_id = s.conv_id AND t.i < s.head AND t.i >= s.head - 4 AND s.base - (t.upto - t.tok) <= 256
                  WHERE NOT (t.i = 0 AND t.role = 'system') GROUP BY 1),
        kept AS (SELECT s.conv_id, sum(sys.len) AS n FROM s JOIN sys ON sys.conv_id = s.conv_id WHERE s.head > 0 GROUP BY 1)
        SELECT t.conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY i)) AS turns_sha256,
               CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
               sha256(coalesce(string_agg(text, '' ORDER BY i) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
               CAST(sum(len) + coalesce(any_value(again.n), 0) + coalesce(any_value(kept.n), 0) AS BIGINT) AS formatted_chars
        FROM t LEFT JOIN again ON again.conv_id = t.conv_id LEFT JOIN kept ON kept.conv_id = t.conv_id GROUP BY t.conv_id""",
}
