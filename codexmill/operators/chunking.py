"""Splitting text into size-bounded chunks.

Every function maps a Column to a Column and runs inside one row, so a split never shuffles.
Cutting, packing and overlapping walk a text by jumps from cut to cut, in Arrow batches: each
character is looked at a bounded number of times. The ``_fold`` forms say the same by native
folds, which copy what is left of a text at each step; tests hold the two against each other.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import collapse, first_alpha_is_lower, normalize_text, strip

#: Fixed patterns and values of headings in plain text.
ARTICLE_LINE = r"(?iu)^[ \t]*Статья[ \t]+(\d+(?:\.\d+)*)(?:\.[ \t]*([^\n]*))?[ \t]*$"
STRUCTURE_LINE = r"(?iuU)^(?:ЧАСТЬ|РАЗДЕЛ|ГЛАВА)\b"
TITLE_WRAP_MIN = 60
TITLE_TOKENS = ("в", "во", "для", "и", "из", "к", "на", "о", "об", "от", "по", "при", "с", "со")


def check_sizes(size: int, overlap: int) -> None:
    if size <= 0:
        raise ValueError(f"chunk_size is {size}; a chunk needs at least one character")
    if overlap < 0:
        raise ValueError(f"chunk_overlap is {overlap}; it can't be negative")
    if overlap >= size:
        raise ValueError(f"chunk_overlap {overlap} leaves nothing of a chunk_size of {size}")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once: a lambda variable, not a copy of the expression."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _strings() -> Column:
    return F.array().cast("array<string>")


def nonblank(parts: Column) -> Column:
    return F.filter(F.transform(parts, strip), lambda p: p != "")


def split_long_fold(paragraph: Column, size: int) -> Column:
    """Parts of at most ``size``: cut after the last sentence end, else at the last space,
    if that lies beyond half a part; else hard. Parts are stripped, blank ones dropped."""
    return let(strip(paragraph), lambda text: _cut_long(text, size))


def _cut_long(text: Column, size: int) -> Column:
    half = size // 2
    steps = F.floor(F.char_length(text) / F.lit(half + 1)).cast("int") + 1

    def step(acc: Column, _: Column) -> Column:
        rest = acc["rest"]
        window = F.substring(rest, 1, size)
        sentence = F.char_length(F.regexp_extract(window, r"(?s)^.*[.!?;]", 0))
        space = F.char_length(F.regexp_extract(window, r"(?s)^.* ", 0)) - 1
        at = F.when(F.char_length(rest) <= size, F.char_length(rest)).when(sentence - 1 > half, sentence).when(space > half, space).otherwise(size)
        return F.struct(F.when(rest == "", acc["parts"]).otherwise(F.concat(acc["parts"], F.array(F.substring(rest, F.lit(1), at)))).alias("parts"), F.substring(rest, at + 1, F.char_length(rest)).alias("rest"))

    return nonblank(F.aggregate(F.sequence(F.lit(1), steps), F.struct(_strings().alias("parts"), text.alias("rest")), step, lambda acc: acc["parts"]))


def pack_fold(parts: Column, size: int, joint: str = "\n\n") -> Column:
    """Greedy packing of parts into chunks of at most ``size``, a longer part alone."""

    def step(acc: Column, part: Column) -> Column:
        full = F.char_length(acc["cur"]) + len(joint) + F.char_length(part) > size
        return F.struct(
            F.when(acc["cur"].isNotNull() & full, F.concat(acc["done"], F.array(acc["cur"]))).otherwise(acc["done"]).alias("done"),
            F.when(acc["cur"].isNull() | full, part).otherwise(F.concat(acc["cur"], F.lit(joint), part)).alias("cur"),
        )

    start = F.struct(_strings().alias("done"), F.lit(None).cast("string").alias("cur"))
    return F.aggregate(parts, start, step, lambda acc: F.concat(acc["done"], F.when(acc["cur"].isNull(), _strings()).otherwise(F.array(acc["cur"]))))


def overlap_fold(chunks: Column, n: int) -> Column:
    """Put the last ``n`` characters of the chunk before in front, unless it starts with them."""
    if n <= 0:
        return chunks

    def one(all_of: Column, x: Column, i: Column) -> Column:
        tail, cur = strip(F.right(F.get(all_of, i - 1), F.lit(n))), strip(x)
        return F.when(i == 0, x).when((tail != "") & ~F.startswith(cur, tail), strip(F.concat(tail, F.lit("\n\n"), cur))).otherwise(cur)

    return let(chunks, lambda c: F.transform(c, lambda x, i: one(c, x, i)))


def paragraphs(text: Column, separator: str = "\n\n") -> Column:
    return nonblank(F.split(text, F.lit(f"\\Q{separator}\\E")))


def split_text_fold(text: Column, size: int = 1200, n_overlap: int = 200, separator: str = "\n\n") -> Column:
    """Normalise, cut into paragraphs, cut long ones, pack, overlap. Null or blank: no chunks."""
    check_sizes(size, n_overlap)
    parts = F.flatten(F.transform(paragraphs(normalize_text(F.coalesce(text, F.lit(""))), separator), lambda p: F.when(F.char_length(p) <= size, F.array(p)).otherwise(split_long_fold(p, size))))
    return overlap_fold(pack_fold(parts, size), n_overlap)


#: White space as Unicode defines it, which is what ``strip`` takes off.
_WHITE = "".join(map(chr, [*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))


def cuts(text: str, size: int) -> list[str]:
    """As ``split_long`` says, of a stripped text: from each cut straight to the next."""
    parts, at, half = [], 0, size // 2
    while at < len(text):
        end = at + size
        if end >= len(text):
            cut = len(text)
        elif (stop := max(text.rfind(c, at + half + 1, end) for c in ".!?;")) >= 0:
            cut = stop + 1
        elif (space := text.rfind(" ", at + half + 1, end)) >= 0:
            cut = space
        else:
            cut = end
        parts.append(text[at:cut].strip(_WHITE))
        at = cut
    return [p for p in parts if p]


def packed(parts: Iterable[str], size: int, joint: str = "\n\n") -> list[str]:
    """As ``pack`` says."""
    done, open_, length = [], [], 0
    for p in parts:
        if open_ and length + len(joint) + len(p) > size:
            done.append(joint.join(open_))
            open_, length = [], 0
        length += len(p) + (len(joint) if open_ else 0)
        open_.append(p)
    return [*done, joint.join(open_)] if open_ else done


def overlapped(chunks: list[str], n: int) -> list[str]:
    """As ``overlap`` says."""
    out = chunks[:1]
    for before, x in zip(chunks, chunks[1:], strict=False):
        tail, cur = before[-n:].strip(_WHITE), x.strip(_WHITE)
        out.append(f"{tail}\n\n{cur}".strip(_WHITE) if tail and not cur.startswith(tail) else cur)
    return out


_BREAKS = re.compile("[\f\x0b\x85\u2028]")


def normalized(text: str) -> str:
    """As ``normalize_text`` says; what a text does not hold is not looked for twice."""
    if "\ufeff" in text:
        text = text.replace("\ufeff", "")
    if "\r" in text:
        text = text.replace("\r\n", "\n").replace("\r", "\n")
    if not text.isascii() or "\f" in text or "\x0b" in text:
        text = _BREAKS.sub("\n", text.replace("\u2029", "\n\n"))
    if "\t" in text or "  " in text:
        text = re.sub("[ \t]+", " ", text)
    if " \n" in text or "\n " in text:
        text = text.replace(" \n", "\n").replace("\n ", "\n")
    while "\n\n\n" in text:
        text = text.replace("\n\n\n", "\n\n")
    return text.strip(_WHITE)


def split(text: str, size: int, n_overlap: int, separator: str) -> list[str]:
    """As ``split_text`` says, of a normalised text."""
    parts = (p for x in text.split(separator) if (p := x.strip(_WHITE)))
    chunks = packed((q for p in parts for q in ((p,) if len(p) <= size else cuts(p, size))), size)
    return overlapped(chunks, n_overlap) if n_overlap > 0 else chunks


def _lists(rows: Iterable[list | None], kind: pa.DataType) -> pa.Array:
    return pa.array(rows, pa.list_(kind))


def _strings_of(run: Callable[..., list[str]], column: Column) -> Column:
    """``run`` of each value that is not null, as an array of strings."""

    @F.arrow_udf("array<string>")
    def rows(values: pa.Array) -> pa.Array:
        return _lists((None if v is None else run(v) for v in (x.as_py() for x in values)), pa.string())

    # so called, it is not run a second time to leave out empty arrays before they are exploded
    return rows.asNondeterministic()(column)


def split_long(paragraph: Column, size: int) -> Column:
    """Parts of at most ``size``: cut after the last sentence end, else at the last space,
    if that lies beyond half a part; else hard. Parts are stripped, blank ones dropped. Null stays null."""
    return _strings_of(lambda x: cuts(x, size), strip(paragraph))


def pack(parts: Column, size: int, joint: str = "\n\n") -> Column:
    """Greedy packing of parts into chunks of at most ``size``, a longer part alone. Null stays null."""
    return _strings_of(lambda x: packed(x, size, joint), parts)


def overlap(chunks: Column, n: int) -> Column:
    """Put the last ``n`` characters of the chunk before in front, unless it starts with them."""
    return _strings_of(lambda x: overlapped(x, n), chunks) if n > 0 else chunks


def split_text(text: Column, size: int = 1200, n_overlap: int = 200, separator: str = "\n\n") -> Column:
    """Normalise, cut into paragraphs, cut long ones, pack, overlap. Null or blank: no chunks."""
    check_sizes(size, n_overlap)
    return _strings_of(lambda x: split(normalized(x), size, n_overlap, separator), F.coalesce(text, F.lit("")))


def title_continues(previous: Column, following: Column) -> Column:
    """May ``following`` be the wrapped rest of the title line ``previous``?"""
    token = F.lower(F.element_at(F.split(F.regexp_replace(previous, "[ -]+$", ""), " "), -1))
    known = token.isin(*TITLE_TOKENS)
    heading = following.rlike(ARTICLE_LINE) | following.rlike(STRUCTURE_LINE)
    wraps = (F.char_length(previous) >= TITLE_WRAP_MIN) | F.endswith(previous, F.lit("-")) | known
    return (following != "") & ~heading & ~following.rlike(r"[.:;]$") & wraps & (first_alpha_is_lower(following) | known)


def article_title(inline: Column, first: Column, second: Column) -> Column:
    """An article's title from its heading line and up to two lines after it (null if none).

    Without an inline title the first line is the title unless it is a heading or ends
    with a stop; further lines must continue the line before them.
    """
    inline, first, second = (F.coalesce(collapse(x), F.lit("")) for x in (inline, first, second))
    starts = (first != "") & ~first.rlike(ARTICLE_LINE) & ~first.rlike(STRUCTURE_LINE) & ~first.rlike(r"[.:;]$")
    take_first = F.when(inline != "", title_continues(inline, first)).otherwise(starts)
    take_second = take_first & title_continues(first, second)
    title = F.concat_ws(" ", F.nullif(inline, F.lit("")), F.when(take_first, first), F.when(take_second, second))
    return F.nullif(title, F.lit(""))


def merge_heading(text: Column) -> Column:
    """Join the heading's paragraph with the one after it by a single line end."""
    parts = paragraphs(text)
    heading = F.split(F.get(parts, F.lit(0)), "\n")[0].rlike(ARTICLE_LINE)
    merged = F.array_join(F.concat(F.array(strip(F.concat(F.get(parts, F.lit(0)), F.lit("\n"), F.get(parts, F.lit(1))))), F.slice(parts, F.lit(3), F.greatest(F.size(parts) - 2, F.lit(0)))), "\n\n")
    return F.when((F.size(parts) >= 2) & heading, merged).otherwise(text)


def _legal_blocks(text: Column) -> Column:
    """array<struct<content, number, title, article>>: what comes before the first article, then each
    article with its heading joined to its body; blank blocks dropped."""

    def block(lines: Column, heads: Column, k: Column) -> Column:
        start, end = F.coalesce(F.get(heads, k), F.lit(0)), F.coalesce(F.get(heads, k + 1), F.size(lines))
        content = strip(F.array_join(F.slice(lines, start + 1, end - start), "\n"))
        head, article = F.get(lines, start), k >= 0
        number = F.when(article, F.regexp_extract(head, ARTICLE_LINE, 1))
        within = lambda j: F.when(start + j < end, F.get(lines, start + j))
        title = F.when(article, article_title(F.regexp_extract(head, ARTICLE_LINE, 2), within(1), within(2)))
        merged = let(content, lambda c: F.when(article, merge_heading(c)).otherwise(c))
        return F.struct(merged.alias("content"), number.alias("number"), title.alias("title"), article.alias("article"))

    def blocks(lines: Column) -> Column:
        numbered = F.transform(lines, lambda x, i: F.struct(i.alias("i"), x.rlike(ARTICLE_LINE).alias("head")))
        heads = F.transform(F.filter(numbered, lambda s: s["head"]), lambda s: s["i"])
        return let(heads, lambda h: F.transform(F.sequence(F.lit(-1), F.size(h) - 1), lambda k: block(lines, h, k)))

    found = let(F.split(normalize_text(F.coalesce(text, F.lit(""))), "\n"), blocks)
    return F.filter(found, lambda b: b["content"] != "")


_BLOCKS = "array<struct<content:string,number:string,title:string,article:boolean>>"


def legal_rows(rows: DataFrame, text_col: str, size: int = 1200, n_overlap: int = 0) -> DataFrame:
    """A row for each chunk of a legal text: the other columns, chunk_index, content, article_number, article_title.

    Text before the first article and text without articles give chunks without a number; parts of
    a long article keep number and title. The overlap is checked but never applied: legal chunks
    start at natural boundaries. Rows without text, or with a blank one, have no chunks.
    """
    check_sizes(size, n_overlap)
    rest = [f for f in rows.schema.fields if f.name != text_col]
    schema = T.StructType([*rest, T.StructField("chunk_index", T.IntegerType()), *(T.StructField(n, T.StringType()) for n in ("content", "article_number", "article_title"))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, out = [], ([], [], [], [])
            for i, blocks in enumerate(batch.column("_blocks")):
                k = 0
                for b in blocks.as_py() or ():
                    whole = b["article"] and len(b["content"]) <= size
                    for c in [b["content"]] if whole else split(b["content"], size, 0, "\n\n"):
                        at.append(i)
                        for column, value in zip(out, (k, c, b["number"], b["title"]), strict=True):
                            column.append(value)
                        k += 1
            made = [pa.array(c, t) for c, t in zip(out, (pa.int32(), pa.string(), pa.string(), pa.string()), strict=True)]
            yield pa.RecordBatch.from_arrays([*(batch.column(f.name).take(pa.array(at, pa.int64())) for f in rest), *made], schema.names)

    blocks = _legal_blocks(F.col(text_col)).cast(_BLOCKS).alias("_blocks")
    return rows.select(*[f.name for f in rest], blocks).mapInArrow(run, schema)


def split_legal(text: Column, size: int = 1200, n_overlap: int = 0) -> Column:
    """The chunks of ``legal_rows`` as an array of structs, by folds."""
    check_sizes(size, n_overlap)

    def chunks(b: Column) -> Column:
        whole = F.when(b["article"] & (F.char_length(b["content"]) <= size), F.array(b["content"])).otherwise(split_text_fold(b["content"], size, 0))
        return F.transform(whole, lambda p: F.struct(p.alias("content"), b["number"].alias("article_number"), b["title"].alias("article_title")))

    return F.flatten(F.transform(_legal_blocks(text), chunks))


def chunk_documents(docs: DataFrame, id_col: str, text_col: str, size: int = 1200, n_overlap: int = 200, separator: str = "\n\n", legal: bool = False) -> DataFrame:
    """(id, chunk_index, content[, article_number, article_title]), one row a chunk."""
    if legal:
        return legal_rows(docs.select(id_col, text_col), text_col, size)
    return docs.select(F.col(id_col), F.posexplode(split_text(F.col(text_col), size, n_overlap, separator)).alias("chunk_index", "content"))
