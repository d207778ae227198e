"""Full-text search: weighted lexemes. Matching and ranking are in operators.postings.

Lexemes are lower-case runs of letters and digits, stemmed with the published Snowball
rules for Russian, stop words left out but counted in positions. The rank follows
Clarke, Cormack & Tudhope (2000): every shortest stretch that holds all query lexemes adds
the harmonic mean of its weights over its length, and r / (r + 1) scales the sum.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

LEXEMES = "array<struct<lexeme:string,pos:int,weight:double>>"
WORD = r"[\p{L}\p{N}]+"
#: Weights of the title and article title, of section and chapter, of the content.
WEIGHT_A, WEIGHT_B, WEIGHT_D = 1.0, 0.4, 0.1

_VOWELS = "аеиоуыэюя"
#: Endings of the published Russian Snowball algorithm.
_GERUND_1, _GERUND_2 = ("вшись", "вши", "в"), ("ившись", "ывшись", "ивши", "ывши", "ив", "ыв")
_ADJECTIVE = ("ими", "ыми", "его", "ого", "ему", "ому", "ее", "ие", "ые", "ое", "ей", "ий", "ый", "ой", "ем", "им", "ым", "ом", "их", "ых", "ую", "юю", "ая", "яя", "ою", "ею")
_PARTICIPLE_1, _PARTICIPLE_2 = ("ем", "нн", "вш", "ющ", "щ"), ("ивш", "ывш", "ующ")
_REFLEXIVE = ("ся", "сь")
_VERB_1 = ("ете", "йте", "ешь", "нно", "ла", "на", "ли", "ем", "ло", "но", "ет", "ют", "ны", "ть", "й", "л", "н")
_VERB_2 = ("ейте", "уйте", "ила", "ыла", "ена", "ите", "или", "ыли", "ило", "ыло", "ено", "ует", "уют", "ены", "ить", "ыть", "ишь", "ей", "уй", "ил", "ыл", "им", "ым", "ен", "ят", "ит", "ыт", "ую", "ю")
_NOUN = ("иями", "ями", "ами", "ией", "иям", "ием", "иях", "ев", "ов", "ие", "ье", "еи", "ии", "ей", "ой", "ий", "ям", "ем", "ам", "ом", "ах", "ях", "ию", "ью", "ия", "ья", "а", "е", "и", "й", "о", "у", "ы", "ь", "ю", "я")
_SUPERLATIVE, _DERIVATIONAL = ("ейше", "ейш"), ("ость", "ост")


def _cut(word: str, start: int, endings: tuple[str, ...], after: str = "") -> str | None:
    """``word`` without its longest ending within word[start:], which must follow one of ``after``."""
    for e in sorted(endings, key=len, reverse=True):
        if word.endswith(e) and len(word) - len(e) >= start:
            before = word[: len(word) - len(e)]
            if not after or (len(before) > start and before[-1] in after):
                return before
    return None


def stem(word: str) -> str:
    """Russian Snowball stem of a lower-case word; words of other letters stay."""
    word = word.replace("ё", "е")
    first = next((i for i, c in enumerate(word) if c in _VOWELS), None)
    if first is None:
        return word
    rv = first + 1
    region = lambda s: next((i + 1 for i in range(s + 1, len(word)) if word[i] not in _VOWELS and word[i - 1] in _VOWELS), len(word))
    r2 = region(region(0))
    cut = _cut(word, rv, _GERUND_2) or _cut(word, rv, _GERUND_1, "ая")
    if cut is None:
        base = _cut(word, rv, _REFLEXIVE)
        base = word if base is None else base
        adjective = _cut(base, rv, _ADJECTIVE)
        if adjective is not None:
            cut = _cut(adjective, rv, _PARTICIPLE_2) or _cut(adjective, rv, _PARTICIPLE_1, "ая") or adjective
        else:
            cut = _cut(base, rv, _VERB_2) or _cut(base, rv, _VERB_1, "ая") or _cut(base, rv, _NOUN) or base
    word = cut
    if len(word) > rv and word.endswith("и"):
        word = word[:-1]
    derived = _cut(word, max(rv, r2), _DERIVATIONAL)
    word = word if derived is None else derived
    best = _cut(word, rv, _SUPERLATIVE)
    word = word if best is None else best
    if word.endswith("нн") and len(word) - 2 >= rv:
        return word[:-1]
    return word[:-1] if word.endswith("ь") and len(word) > rv else word


def stop_words(spark: SparkSession, language: str = "russian") -> frozenset[str]:
    from pyspark.ml.feature import StopWordsRemover

    return frozenset(StopWordsRemover.loadDefaultStopWords(language))


@F.arrow_udf(T.ArrayType(T.StringType()))
def stem_words(words: pa.Array) -> pa.Array:
    """Stems of arrays of words; each distinct word of a batch is stemmed once."""
    if isinstance(words, pa.ChunkedArray):
        words = words.combine_chunks()
    coded = words.flatten().dictionary_encode()
    stems = pa.array([None if w is None else stem(w) for w in coded.dictionary.to_pylist()], pa.string())
    ends = np.concatenate([[0], np.cumsum(words.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))])
    lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), stems.take(coded.indices))
    return pc.if_else(words.is_valid(), lists, pa.scalar(None, lists.type)) if words.null_count else lists


def lexeme_column(parts: list[tuple[Column, float]], stops: frozenset[str] = frozenset(), stemmed: bool = True) -> Column:
    """The lexemes of a row's texts with positions and weights, to be kept with the row.

    Texts are split and placed by array functions; a null text has no words, and stop words none but their place.
    """
    words = [F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit(WORD), F.lit(0)) for c, _ in parts]
    said = F.struct(*[w.alias(f"w{i}") for i, w in enumerate(words)], *([stem_words(F.concat(*words)).alias("stems")] if stemmed else []))

    def placed(row: Column) -> Column:
        own = [row[f"w{i}"] for i in range(len(parts))]

        def lexeme(word: Column, i: Column) -> Column:
            name, weight, upto = F.get(row["stems"], i) if stemmed else word, F.lit(float(parts[-1][1])), F.lit(0)
            less = []
            for w, (_, given) in zip(own[:-1], parts, strict=False):
                upto = upto + F.size(w)
                less.append((i < upto, float(given)))
            for before, given in reversed(less):
                weight = F.when(before, F.lit(given)).otherwise(weight)
            return F.struct((F.when(~word.isin(*sorted(stops)), name) if stops else name).alias("lexeme"), (i + 1).alias("pos"), weight.alias("weight"))

        return F.transform(F.concat(*own), lexeme)

    every = F.get(F.transform(F.array(said), placed), F.lit(0))  # a row's words are split once, not for each word
    return (F.filter(every, lambda e: e["lexeme"].isNotNull()) if stops else every).cast(LEXEMES)


_SPLIT = re.compile(r"[^\W_]+")


def query_lexemes(text: str, stops: frozenset[str], stemmed: bool = True) -> list[str]:
    words = set(_SPLIT.findall(text.lower())) - stops
    return sorted({stem(w) for w in words} if stemmed else words)
