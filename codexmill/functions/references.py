"""Article references, article numbers and law hints in Russian legal text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import fold, identity

#: Fixed patterns: a number, a reference to articles, an article number in a question.
NUMBER = r"\d+(?:\.\d+)*"
REFERENCE = r"(?iuU)\bстать(?:я|и|е|ей|ёй|ю|ях|ями)\b(\s+\d+(?:\.\d+)*(?:\s*(?:,|и|или|либо|и/или|[-–—])\s*\d+(?:\.\d+)*)*)"
QUESTION_ARTICLE = r"(?iuU)(?<!\w)ст(?:атья|атье|атьи|атью)?\.?\s*(\d+(?:\.\d+)*)"

#: Names under which each law is known to search, in order.
SEARCH_ALIASES = {
    "tk_rf": ("tk_rf", "trudovoy_kodeks_rf", "trudovoy_kodeks_rossiyskoy_federatsii", "трудовой кодекс"),
    "uk_rf": ("uk_rf", "ugolovnyy_kodeks_rf", "ugolovnyy_kodeks_rossiyskoy_federatsii", "уголовный кодекс"),
    "gk_rf": ("gk_rf", "grazhdanskiy_kodeks_rf", "grazhdanskiy_kodeks_rossiyskoy_federatsii", "гражданский кодекс"),
    "nk_rf": ("nk_rf", "nalogovyy_kodeks_rf", "nalogovyy_kodeks_rossiyskoy_federatsii", "налоговый кодекс"),
    "zkpp_rf": ("zkpp_rf", "zakon_o_zashite_prav_potrebiteley", "закон о защите прав потребителей", "защите прав потребителей"),
    "sk_rf": ("sk_rf", "semeynyy_kodeks_rf", "semeynyy_kodeks_rossiyskoy_federatsii", "семейный кодекс"),
    "zhk_rf": ("zhk_rf", "zhilishchnyy_kodeks_rf", "zhilishchnyy_kodeks_rossiyskoy_federatsii", "жилищный кодекс"),
}

#: Words that hint at a law; the first law in this order wins.
HINT_TERMS = {
    "tk_rf": ("трудовой кодекс", "тк рф", "работник", "работодател", "увольнен", "зарплат"),
    "uk_rf": ("уголовный кодекс", "ук рф", "преступлен", "краж", "убийств", "мошенничеств", "грабеж", "грабёж"),
    "gk_rf": ("гражданский кодекс", "гк рф", "договор", "сделк", "собственност", "юридическ"),
    "nk_rf": ("налоговый кодекс", "нк рф", "налог", "налогоплательщик", "декларац"),
    "zkpp_rf": ("закон о защите прав потребителей", "зозпп", "потребител", "покупател", "товар ненадлежащего качества"),
    "sk_rf": ("семейный кодекс", "ск рф", "брак", "супруг", "алимент", "родител"),
    "zhk_rf": ("жилищный кодекс", "жк рф", "жилое помещение", "многоквартирный дом", "собственники помещений"),
}


def sort_articles(numbers: Column) -> Column:
    """By the numbers between the dots: 5.3 < 5.27 < 80."""
    keyed = F.transform(numbers, lambda v: F.struct(F.transform(F.split(v, r"\."), lambda p: p.cast("decimal(38,0)")).alias("k"), v.alias("v")))
    return F.transform(F.array_sort(keyed), lambda s: s["v"])


def referenced_articles(text: Column, current: Column | None = None) -> Column:
    """Sorted distinct numbers that a text refers to, without the current article."""
    tails = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(REFERENCE), F.lit(1))
    found = F.array_distinct(F.flatten(F.transform(tails, lambda t: F.regexp_extract_all(t, F.lit(NUMBER), F.lit(0)))))
    if current is not None:
        found = F.filter(found, lambda v: F.coalesce(v != current, F.lit(True)))
    return sort_articles(found)


def question_article(question: Column) -> Column:
    return F.nullif(F.regexp_extract(F.coalesce(question, F.lit("")), QUESTION_ARTICLE, 1), F.lit(""))


def law_hint(question: Column, terms: dict[str, tuple[str, ...]] = HINT_TERMS) -> Column:
    text = F.regexp_replace(fold(F.coalesce(question, F.lit(""))), r"(?U)\s+", " ")
    out = None
    for law, words in terms.items():
        hit = F.exists(F.array(*[F.lit(w.replace("ё", "е")) for w in words]), lambda w: F.contains(text, w))
        out = F.when(hit, law) if out is None else out.when(hit, law)
    return out


def matches_law_hint(value: Column, hint: str | None, aliases: dict[str, tuple[str, ...]] = SEARCH_ALIASES) -> Column:
    """Does a document's name contain an alias of the law, letters and digits alone compared?"""
    if hint not in aliases:
        return F.lit(False)
    plain = identity(value)
    return F.exists(F.transform(F.array(*[F.lit(a) for a in aliases[hint]]), identity), lambda a: F.contains(plain, a))


def alias_like(names: Column, aliases: Column) -> Column:
    """LIKE '%alias%' for any alias; an underscore in an alias stands for any one character."""
    low = F.lower(names)
    return F.coalesce(F.exists(aliases, lambda a: F.like(low, F.concat(F.lit("%"), F.lower(a), F.lit("%")))), F.lit(False))
