"""Sub-word ids of many texts: each distinct segment is encoded by the tokenizer's library once.

A text is parted before every single space between two characters that are no white space.
Neither a byte-level BPE behind its word pattern nor a byte-pair model without pieces that hold
a space after another character can join anything across such a place, so the ids of a text are
those of its segments in order. Tokenizers of any other kind get whole texts.
"""

from __future__ import annotations

import itertools
import json
import os
import re
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache

import numpy as np

BYTE_BPE, PIECE_BPE = "byte_bpe_50k.json", "piece_bpe_32k.model"
#: Code points whose segments are looked up together; ids that a worker's cache holds at most.
BLOCK, CACHED = 1 << 20, 3 << 20
# U+2581 is a piece model's own sign for a space
_PLACE = re.compile(r"(?<=[^\s\u2581]) (?=[^\s\u2581])")
_WHITE = [c for c in map(chr, range(0x3100)) if c.isspace() or c == "\u2581"]
_BLANK = frozenset(_WHITE)

Encode = Callable[[list[str]], list[list[int]]]


def flat(lists: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    sizes = np.fromiter(map(len, lists), np.int64, len(lists))
    return np.fromiter(itertools.chain.from_iterable(lists), np.int32, int(sizes.sum())), sizes


def path(name: str) -> str:
    """Place of a public tokenizer's file on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


class Subwords:
    """Ids of texts by ``inner`` (all ids of segments after a space, given without it, and how many each
    has) and ``first`` (the ids of texts' first segments)."""

    def __init__(self, inner: Callable[[list[str]], tuple[np.ndarray, np.ndarray]], first: Encode, parted: bool = True, cached: int | None = None):
        self.inner, self.first, self.parted, self.cached = inner, first, parted, CACHED if cached is None else cached
        self._clear()

    def _clear(self) -> None:
        self.at: dict[str, int] = {}
        self.sizes, self.ends, self.pool = _Growing(np.int32), _Growing(np.int64), _Growing(np.int32)

    def _learn(self, segments: list[str], coder: Callable[[list[str]], tuple[np.ndarray, np.ndarray]] | None = None) -> None:
        if not segments:
            return
        ids, sizes = (coder or self.inner)(segments)
        self.at.update(zip(segments, range(self.sizes.n, self.sizes.n + len(sizes)), strict=True))
        self.ends.add(self.pool.n + np.cumsum(sizes))
        self.sizes.add(sizes)
        self.pool.add(ids)

    def encode_each(self, texts: Iterable[str]) -> Iterator[np.ndarray]:
        """All ids of each text, as int32; texts that are short together are looked up together."""
        if not self.parted:
            yield from (np.asarray(self.first([t])[0], np.int32) for t in texts)
            return
        some, size = [], 0
        for text in texts:
            some.append(text)
            size += len(text)
            if size >= BLOCK:
                yield from self._some(some)
                some, size = [], 0
        yield from self._some(some)

    def _some(self, texts: list[str]) -> Iterator[np.ndarray]:
        if len(texts) == 1 and len(texts[0]) > BLOCK:  # a long text: block by block
            out = [np.asarray(x, np.int32) for i, block in enumerate(_blocks(texts[0])) for x in self._parts([segments(block)], i == 0)]
            yield np.concatenate(out)
            return
        yield from self._parts([segments(t) for t in texts])

    def _parts(self, texts: list[list[str]], lead: bool = True) -> Iterator[np.ndarray]:
        if self.pool.n > self.cached:
            self._clear()
        heads = self.first([t[0] for t in texts]) if lead and texts else []
        flat = list(itertools.chain.from_iterable(t[1:] if lead else t for t in texts))
        rows = list(map(self.at.get, flat))
        missing = [i for i, r in enumerate(rows) if r is None]
        if missing:
            self._learn(list(dict.fromkeys(flat[i] for i in missing)))
            for i in missing:
                rows[i] = self.at[flat[i]]
        at = np.asarray(rows, np.int64)
        n = self.sizes.all()[at].astype(np.int64)
        ends = np.cumsum(n)
        ids = self.pool.all()[np.arange(ends[-1] if len(ends) else 0) + np.repeat(self.ends.all()[at] - ends, n)]
        ends = np.concatenate([[0], ends])
        k = 0
        for i, t in enumerate(texts):
            m = k + len(t) - lead
            part = ids[ends[k] : ends[m]]
            yield np.concatenate([np.asarray(heads[i], np.int32), part]) if lead else part
            k = m

    def encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of different segments, each for itself after a space, and how many each has; ``first`` puts a space before."""
        if self.pool.n > self.cached:
            self._clear()
        missing = [w for w in words if w not in self.at]
        alone = [w for w in missing if not self.parted or w[0] in _BLANK]
        if alone:  # it may join with what stands before it
            self._learn(alone, lambda texts: flat(self.first(texts)))
            missing = [w for w in missing if w not in self.at]
        self._learn(missing)
        at = np.fromiter(map(self.at.__getitem__, words), np.int64, len(words))
        n = self.sizes.all()[at].astype(np.int64)
        ends = np.cumsum(n)
        return self.pool.all()[np.arange(ends[-1] if len(ends) else 0) + np.repeat(self.ends.all()[at] - ends, n)], n

    def encode(self, text: str) -> np.ndarray:
        return next(self.encode_each([text]))


class _Growing:
    """A numpy array that grows at its end."""

    def __init__(self, kind: type):
        self.data, self.n = np.empty(1 << 12, kind), 0

    def add(self, x: np.ndarray) -> None:
        if self.n + len(x) > len(self.data):
            wide = np.empty(max(2 * len(self.data), self.n + len(x)), self.data.dtype)
            wide[: self.n] = self.data[: self.n]
            self.data = wide
        self.data[self.n : self.n + len(x)] = x
        self.n += len(x)

    def all(self) -> np.ndarray:
        return self.data[: self.n]


def odd(text: str) -> bool:
    """Has the text a space at which it is not parted?"""
    return text[:1] == " " or text[-1:] == " " or any(c in text and (c + " " in text or " " + c in text) for c in _WHITE if c != " ") or "  " in text


def segments(text: str) -> list[str]:
    return _PLACE.split(text) if odd(text) else text.split(" ")


def _blocks(text: str) -> Iterator[str]:
    """Parts of a long text, parted where segments part (the space itself left out)."""
    at = 0
    while len(text) - at > BLOCK and (m := _PLACE.search(text, at + BLOCK)):
        yield text[at : m.start()]
        at = m.end()
    yield text[at:] if at else text


@lru_cache(maxsize=4)
def byte_bpe(file: str, lead: str = "", plain: bool = False, cached: int | None = None) -> Subwords:
    """A tokenizer file of the ``tokenizers`` library, without added special tokens, kept per process.

    Texts are encoded with ``lead`` before them. ``plain``: strings of special tokens are plain text.
    """
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # the cores are Spark's
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(file)
    t.encode_special_tokens = plain
    with open(file, encoding="utf-8") as f:
        spec = json.load(f)
    pre = spec["pre_tokenizer"] or {}
    added = [x["content"] for x in spec["added_tokens"]]
    parted = spec["normalizer"] is None and pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space") and not any(" " in x for x in added) and not any(x["lstrip"] or x["rstrip"] or x["single_word"] for x in spec["added_tokens"])
    many = lambda before: lambda texts: [e.ids for e in t.encode_batch_fast([before + x for x in texts], add_special_tokens=False)]
    if not parted or not _merges_by_id(spec):
        return Subwords(lambda texts: flat(many(" ")(texts)), many(lead), parted, cached)
    names, special = byte_bpe_tokens(file), [] if plain else [x["content"] for x in spec["added_tokens"]]
    rank = _rank_coder(names, {x["id"] for x in spec["added_tokens"]})
    lengths = np.array([len(x) for x in names])

    def inner(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Segments side by side as one text, parted again by their bytes; those with special tokens by the library."""
        if any(x in s for x in special for s in texts):
            return flat(many(" ")(texts))
        ids = np.asarray(rank(" " + " ".join(texts)), np.int32)
        ends = np.cumsum(np.fromiter((len(s.encode()) + 1 for s in texts), np.int64, len(texts)))
        upto = np.searchsorted(np.cumsum(lengths[ids]), ends) + 1
        return ids, np.diff(upto, prepend=0)

    return Subwords(inner, many(lead), parted, cached)


def _merges_by_id(spec: dict) -> bool:
    """Do the merges of a byte-level BPE file give their tokens in the order of ids, each once?"""
    model = spec["model"]
    made = [model["vocab"]["".join(m.split(" ") if isinstance(m, str) else m)] for m in model["merges"]]
    return made == sorted(set(made)) and not model.get("ignore_merges") and not model.get("unk_token")


def _rank_coder(names: list[bytes], special: set[int]) -> Callable[[str], list[int]]:
    """The same merges, as ranks of the ``tiktoken`` library, which is several times faster on new words."""
    import public_tokenizers
    import tiktoken

    ranks = {name: i for i, name in enumerate(names) if name and i not in special}
    return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary


@lru_cache(maxsize=4)
def piece_bpe(file: str, cached: int | None = None) -> Subwords:
    """A byte-pair model file of the ``sentencepiece`` library, which puts a space before each text itself."""
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2 as pb

    p = sentencepiece.SentencePieceProcessor(model_file=file)
    spec = pb.ModelProto()
    with open(file, "rb") as f:
        spec.ParseFromString(f.read())
    norm = spec.normalizer_spec
    keeps = norm.add_dummy_prefix and not norm.precompiled_charsmap and not norm.remove_extra_whitespaces
    parted = keeps and spec.trainer_spec.model_type == pb.TrainerSpec.BPE and not any(re.search("[^\u2581]\u2581", x.piece) for x in spec.pieces)
    many = lambda texts: p.encode(texts, num_threads=1)
    return Subwords(lambda texts: flat(many(texts)), many, parted, cached)


def byte_bpe_tokens(file: str) -> list[bytes]:
    """The bytes of each id of a byte-level BPE file (b"" where an id is free)."""
    from tokenizers import Tokenizer

    vocabulary = Tokenizer.from_file(file).get_vocab(with_added_tokens=True)
    # byte-level letters: printable Latin-1 bytes stand for themselves, the rest follow from U+0100 on
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    letter = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}
    out = [b""] * (max(vocabulary.values()) + 1)
    for text, i in vocabulary.items():
        out[i] = bytes(letter[c] for c in text)
    return out


def piece_bpe_tokens(file: str) -> list[bytes]:
    """The bytes of each id of a sentencepiece model: U+2581 is a space, <0xHH> a byte."""
    import sentencepiece

    p = sentencepiece.SentencePieceProcessor(model_file=file)
    return [bytes([int(p.id_to_piece(i)[3:5], 16)]) if p.is_byte(i) else p.id_to_piece(i).replace("\u2581", " ").encode() for i in range(p.get_piece_size())]
