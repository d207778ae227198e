"""Retrieval evaluation: relevance of results, metrics per case, overall and per group.

Ranked results meet the expected sources by article number, an equi-join; documents are
then compared by their known names. Metrics of all groupings come from one GROUPING SETS.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import article_number, identity, strip

#: Names under which each law is known to the evaluation, in order.
ALIASES = {
    "tk_rf": ("tk_rf", "trudovoy_kodeks_rf", "trudovoj-kodeks-rossijskoj-federatsii", "трудовой кодекс российской федерации"),
    "uk_rf": ("uk_rf", "ugolovnyy_kodeks_rf", "уголовный кодекс российской федерации"),
    "gk_rf": ("gk_rf", "grazhdanskiy_kodeks_rf", "гражданский кодекс российской федерации", "гражданский кодекс российской федерации часть первая", "гражданский кодекс российской федерации часть вторая"),
    "nk_rf": ("nk_rf", "nalogovyy_kodeks_rf", "налоговый кодекс российской федерации", "налоговый кодекс российской федерации часть первая", "налоговый кодекс российской федерации часть вторая"),
    "zkpp_rf": ("zkpp_rf", "zakon_o_zashite_prav_potrebiteley", "закон российской федерации о защите прав потребителей", "закон о защите прав потребителей", "защите прав потребителей"),
    "sk_rf": ("sk_rf", "semeynyy_kodeks_rf", "семейный кодекс российской федерации"),
    "zhk_rf": ("zhk_rf", "zhilishchnyy_kodeks_rf", "жилищный кодекс российской федерации"),
}
DEPTHS = (1, 3, 5, 10, 20)
RELEVANCE = ("primary", "secondary", "acceptable")
SUCCESS = ("primary", "secondary")
NO_LAW, NO_TYPE = "Без названия", "unspecified"


def _plain(aliases: tuple[str, ...]) -> Column:
    return F.transform(F.array(*[F.lit(a) for a in aliases]), identity)


def alias_key(value: Column, aliases: dict[str, tuple[str, ...]] = ALIASES) -> Column:
    """The first law whose id or names the value equals, starts with, contains or lies in."""
    v, out = identity(value), None
    for law, names in aliases.items():
        hit = (v != "") & (F.startswith(v, identity(F.lit(law))) | F.exists(_plain(names), lambda a: F.contains(v, a) | F.contains(a, v)))
        out = F.when(hit, law) if out is None else out.when(hit, law)
    return out


def expected_names(document_id: Column, title: Column | None = None, aliases: dict[str, tuple[str, ...]] = ALIASES) -> Column:
    """Normalised names of an expected document: a known law's, else the id or title itself."""
    given = F.nullif(document_id, F.lit(""))
    value = given if title is None else F.coalesce(given, title)
    known = F.create_map(*[x for law, names in aliases.items() for x in (F.lit(law), _plain(names))])
    own = identity(value)
    return F.coalesce(F.try_element_at(known, alias_key(value, aliases)), F.when(own != "", F.array(own)).otherwise(F.array().cast("array<string>")))


def document_matches(names: Column, result: list[Column]) -> Column:
    """Any expected name contains or lies in any of a result's names; no names match all."""
    values = F.filter(F.transform(F.array(*[c.cast("string") for c in result]), identity), lambda r: r != "")
    return (F.size(names) == 0) | F.exists(names, lambda a: F.exists(values, lambda r: F.contains(r, a) | F.contains(a, r)))


def expected_sources(cases: DataFrame) -> DataFrame:
    """(id, document_id, article_number, relevance): valid sources, else legacy numbers as primary."""
    modern = F.coalesce(F.size("expected_sources") > 0, F.lit(False))
    made = F.transform("expected_sources", lambda s: F.struct(strip(F.coalesce(s["document_id"], F.lit(""))).alias("document_id"), article_number(s["article_number"]).alias("article_number"), F.lower(strip(F.coalesce(s["relevance"], F.lit("")))).alias("relevance")))
    made = F.filter(made, lambda s: s["article_number"].isNotNull() & (s["document_id"] != "") & s["relevance"].isin(*RELEVANCE))
    legacy = F.transform("expected_article_numbers", lambda v: F.struct(strip(F.coalesce("expected_document_id", F.lit(""))).alias("document_id"), article_number(v).alias("article_number"), F.lit("primary").alias("relevance")))
    legacy = F.filter(legacy, lambda s: s["article_number"].isNotNull())
    return cases.select("id", "expected_document_id", "expected_document_title", F.explode(F.when(modern, made).otherwise(legacy)).alias("s")).select("id", F.col("s.document_id").alias("document_id"), "s.article_number", "s.relevance", F.when(F.col("s.document_id") == "", F.coalesce(F.nullif("expected_document_id", F.lit("")), F.lit(""))).otherwise(F.col("s.document_id")).alias("name_id"), F.when(F.col("s.document_id") == "", F.col("expected_document_title")).alias("name_title"))


def judge(results: DataFrame, cases: DataFrame, aliases: dict[str, tuple[str, ...]] = ALIASES) -> DataFrame:
    """Add ``relevance`` (best match or null) and ``expected_document`` to ranked results.

    ``results``: case_id, rank, article_number, document_title, filename, source_filename, document_id.
    """
    sources = expected_sources(cases).withColumn("names", expected_names(F.col("name_id"), F.col("name_title"), aliases))
    shape = sources.groupBy(F.col("id").alias("case_id")).agg(F.collect_list(F.struct("article_number", "relevance", "names")).alias("sources"))
    own = [F.col(c) for c in ("document_title", "filename", "source_filename", "document_id")]
    number = article_number(F.col("article_number"))
    rows = results.join(shape, "case_id", "left").withColumn("sources", F.coalesce("sources", F.array().cast(dict(shape.dtypes)["sources"])))
    hits = F.filter("sources", lambda s: (s["article_number"] == number) & document_matches(s["names"], own))
    levels = F.transform(hits, lambda s: s["relevance"])
    best = F.get(F.filter(F.array(*[F.lit(r) for r in RELEVANCE]), lambda r: F.array_contains(levels, r)), F.lit(0))
    document = F.exists("sources", lambda s: s["relevance"].isin(*SUCCESS) & document_matches(s["names"], own))
    return rows.withColumn("relevance", best).withColumn("expected_document", document).drop("sources")


def case_metrics(judged: DataFrame, cases: DataFrame, top_k: int = 20) -> DataFrame:
    """One row per case: rank, reciprocal_rank, hit_top_K, partial, wrong and right document flags.

    A hit at a depth beyond ``top_k`` is null, as are all metrics of out-of-scope cases.
    ``cases``: id, law, question_type, case_type. ``judged``: case_id, rank, relevance,
    expected_document, similarity.
    """
    if top_k < 1:
        raise ValueError("top_k must be at least 1")
    inside = judged.filter(F.col("rank") <= top_k)
    success = F.col("relevance").isin(*SUCCESS)
    per = inside.groupBy("case_id").agg(
        F.min(F.when(success, F.col("rank"))).alias("found"),
        F.min(F.when(F.col("relevance") == "acceptable", F.col("rank"))).alias("accepted"),
        F.max(F.when(F.col("rank") == 1, F.col("expected_document").cast("int"))).alias("first_document"),
        F.max(F.when(F.col("rank") <= 5, F.col("expected_document").cast("int"))).alias("any_document"),
        F.max(F.when(F.col("rank") == 1, F.col("similarity"))).alias("first_similarity"),
        F.count_if(F.col("rank") == 1).alias("firsts"),
    )
    outside = F.coalesce(F.col("case_type") == "out_of_scope", F.lit(False))
    rows = cases.join(per, cases["id"] == per["case_id"], "left").drop("case_id")
    live = lambda c: F.when(~outside, c)
    rank = F.col("found")
    hits = {f"hit_top_{d}": live(F.coalesce(rank <= d, F.lit(False))) if d <= top_k else F.lit(None).cast("boolean") for d in DEPTHS}
    return rows.select(
        "id",
        "law",
        "question_type",
        outside.alias("not_evaluated"),
        live(rank).alias("rank"),
        live(F.coalesce(1.0 / rank, F.lit(0.0))).alias("reciprocal_rank"),
        *[v.alias(n) for n, v in hits.items()],
        live(rank.isNull() & F.col("accepted").isNotNull()).alias("partial_match"),
        live(F.coalesce((F.col("firsts") > 0) & (F.coalesce("first_document", F.lit(0)) == 0), F.lit(False))).alias("wrong_document_at_1"),
        (live(F.coalesce(F.col("any_document") == 1, F.lit(False))) if top_k >= 5 else F.lit(None).cast("boolean")).alias("document_hit_top_5"),
        live(F.col("first_similarity")).alias("first_similarity"),
    )


def summarize(metrics: DataFrame) -> DataFrame:
    """Metrics overall (level ``all``), per ``law`` and per ``question_type``: (level, name, ...)."""
    rows = metrics.withColumn("law", F.coalesce(F.nullif("law", F.lit("")), F.lit(NO_LAW))).withColumn("question_type", F.coalesce(F.nullif("question_type", F.lit("")), F.lit(NO_TYPE)))
    live = ~F.col("not_evaluated")
    ratio = lambda c: F.avg(F.when(live, F.col(c).cast("int")))
    aggs = [
        F.count_if(live).alias("questions_count"),
        F.count_if(~live).alias("out_of_scope_count"),
        F.coalesce(F.avg(F.when(live, F.col("reciprocal_rank"))), F.lit(0.0)).alias("mrr"),
        F.coalesce(F.avg(F.when(live, F.col("first_similarity"))), F.lit(0.0)).alias("average_first_similarity"),
        F.avg(F.when(live, F.col("rank"))).alias("mean_rank"),
        ratio("document_hit_top_5").alias("document_recall_at_5"),
        ratio("wrong_document_at_1").alias("wrong_document_at_1"),
        *[F.sum(F.when(live, F.col(f"hit_top_{d}").cast("int"))).alias(f"hit_top_{d}_count") for d in DEPTHS],
        *[ratio(f"hit_top_{d}").alias(f"top_{d}_accuracy") for d in DEPTHS],
    ]
    gid = F.grouping_id("law", "question_type")
    out = rows.groupingSets([["law"], ["question_type"], []], "law", "question_type").agg(gid.alias("_g"), *aggs)
    # bit 1: law is rolled up, bit 0: question_type is
    return out.select(F.when(F.col("_g") == 3, "all").when(F.col("_g") == 1, "law").otherwise("question_type").alias("level"), F.coalesce("law", "question_type", F.lit("all")).alias("name"), *[c for c in out.columns if c not in ("law", "question_type", "_g")])


def _filled(name: str, other: str) -> Column:
    return F.coalesce(F.nullif(F.col(name).cast("string"), F.lit("")), F.lit(other))


def report_rows(judged: DataFrame, cases: DataFrame, metrics: DataFrame, meta: dict) -> DataFrame:
    """The 29 columns of the case report; hybrid weights only for hybrid runs.

    ``judged`` also has article_title and the scores of a search result.
    """
    document = F.coalesce(*[F.nullif(F.col(c).cast("string"), F.lit("")) for c in ("document_title", "filename", "source_filename", "document_id")], F.lit("Документ не указан"))
    shown = F.when(F.col("similarity").isNull(), "—").otherwise(F.format_string("%.4f", F.col("similarity")))
    line = F.concat(F.col("rank").cast("string"), F.lit(") "), document, F.lit(", статья "), F.coalesce(article_number(F.col("article_number")), F.lit("—")), F.lit(", "), _filled("article_title", "без названия"), F.lit(", similarity="), shown)
    first = lambda c: F.max(F.when(F.col("rank") == 1, F.col(c).try_cast("double")))
    tops = judged.groupBy("case_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", line.alias("line")))), lambda s: s["line"]), " | ").alias("top_results"),
        F.min_by("relevance", F.when(F.col("relevance").isin(*SUCCESS), F.col("rank"))).alias("matched"),
        *[first(c).alias(n) for c, n in (("similarity", "best_similarity"), ("distance", "best_distance"), ("semantic_score", "semantic_score"), ("keyword_score", "keyword_score"), ("hybrid_score", "hybrid_score"))],
    )
    said = F.concat("document_id", F.lit(" — ст. "), "article_number", F.lit(" ("), "relevance", F.lit(")"))
    wanted = expected_sources(cases).groupBy("id").agg(F.array_join(F.collect_list(said), "; ").alias("expected_articles"))
    hybrid = meta.get("retrieval_mode") == "hybrid"
    weights = [F.lit(meta.get(c) if hybrid else None).cast("double").alias(c) for c in ("hybrid_semantic_weight", "hybrid_keyword_weight", "hybrid_metadata_weight")]
    rows = cases.drop("law", "question_type").join(metrics.drop("first_similarity"), "id").join(wanted, "id", "left").join(tops, F.col("id") == tops["case_id"], "left")
    return rows.select(
        F.col("id").alias("case_id"),
        F.coalesce("case_type", F.lit("retrieval")).alias("case_type"),
        "question_type",
        "difficulty",
        "expected_behavior",
        F.lit(meta.get("retrieval_mode")).cast("string").alias("retrieval_mode"),
        *weights,
        "law",
        "question",
        F.coalesce("expected_articles", F.lit("—")).alias("expected_articles"),
        *[f"hit_top_{d}" for d in DEPTHS],
        "rank",
        "reciprocal_rank",
        F.coalesce("matched", F.when(F.col("partial_match"), "acceptable")).alias("matched_relevance"),
        "partial_match",
        "document_hit_top_5",
        F.col("wrong_document_at_1").alias("wrong_document_top_1"),
        "best_similarity",
        "best_distance",
        "semantic_score",
        "keyword_score",
        "hybrid_score",
        F.coalesce("top_results", F.lit("Результатов нет")).alias("top_results"),
    )


def extremes(groups: DataFrame, value: str = "top_5_accuracy", name: str = "name") -> DataFrame:
    """(kind best or weakest, name): all groups at the largest and the smallest value."""
    edge = groups.agg(F.max(value).alias("hi"), F.min(value).alias("lo"))
    rows = groups.filter(F.col(value).isNotNull()).crossJoin(F.broadcast(edge))  # one row
    return rows.filter(F.col(value) == F.col("hi")).select(F.lit("best").alias("kind"), name).union(rows.filter(F.col(value) == F.col("lo")).select(F.lit("weakest").alias("kind"), name))
