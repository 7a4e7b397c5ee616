"""Encoding of texts with a byte-level BPE vocabulary, exactly and in linear time.

Every pre-token is taken as bytes, mapped one to one to Latin-1 characters so
that an Aho-Corasick automaton over the whole vocabulary finds all tokens in
one pass. From the longest match on, tokens are laid end to end; two may stand
side by side only if merging their joined bytes would give just these two, a
fact kept in a memo. A place from which no way leads on is marked dead and the
last token taken back, so each place is left at most once.
"""

from __future__ import annotations

import functools
import json
import re
import unicodedata
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Pre-tokens of byte-level BPE (fixed value, from the vocabulary's description).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: The same for texts in which \\w is a letter, a decimal digit or _, and \\s is white space in both modules; twice as fast.
_PLAIN = re.compile(r"'(?:[stmd]|re|ve|ll)| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+").findall


def _ranges(test) -> str:
    """A character class of all characters of the basic plane that pass a test."""
    found = [c for c in range(0x10000) if test(chr(c))]
    starts = [c for k, c in enumerate(found) if not k or found[k - 1] != c - 1]
    ends = [c for k, c in enumerate(found) if k + 1 == len(found) or found[k + 1] != c + 1]
    return "[" + "".join(f"\\u{a:04x}-\\u{b:04x}" for a, b in zip(starts, ends)) + "]"


#: Numbers that aren't decimal digits, and the separators only one module takes for white space; unassigned ones too.
_ODD = re.compile(_ranges(lambda c: unicodedata.category(c) in ("Nl", "No", "Cn") or "\x1c" <= c <= "\x1f")).search
_ASTRAL = re.compile("[\U00010000-\U0010ffff]").search
_FULL = regex.compile(PATTERN).findall


def split(text: str) -> list[str]:
    """The pre-tokens of a text."""
    if text.isascii():
        return _FULL(text) if any(c in text for c in "\x1c\x1d\x1e\x1f") else _PLAIN(text)
    return _FULL(text) if _ODD(text) or _ASTRAL(text) else _PLAIN(text)


#: Entries a worker's memos may hold before they start anew; they only save time.
MEMO_WORDS, MEMO_PAIRS, MEMO_CHARS = 400_000, 1_000_000, 48


def byte_of_char() -> dict[str, int]:
    """The printable stand-ins by which vocabulary files write bytes."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(others)}


class Encoder:
    """A vocabulary whose merge k makes token ``first_merge + k``."""

    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]]):
        import ahocorasick

        chars = byte_of_char()
        latin = {word: "".join(chr(chars[c]) for c in word) for word in vocab if all(c in chars for c in word)}
        size = max(vocab.values()) + 1
        self.left, self.right, self.pairs = list(range(size)), list(range(size)), {}
        for a, b in merges:
            token = vocab[a + b]
            self.left[token], self.right[token] = vocab[a], vocab[b]
            self.pairs[vocab[a], vocab[b]] = token
        self.length = [0] * size
        automaton = ahocorasick.Automaton()
        for word, text in latin.items():
            self.length[vocab[word]] = len(text)
            automaton.add_word(text, vocab[word])
        automaton.make_automaton()
        self.automaton = automaton
        self.whole = {text: vocab[word] for word, text in latin.items()}
        self.fits: dict[tuple[int, int], bool] = {}
        self.words = _Memo(self)

    def compatible(self, a: int, b: int) -> bool:
        """Whether BPE leaves the border between a and b standing.

        The merges of both are undone latest first; at each step, the tokens then
        touching at the border must not merge earlier than what was last undone.
        """
        left, right, pairs = self.left, self.right, self.pairs
        limit = len(left)
        while True:
            joined = pairs.get((a, b))
            if joined is not None and joined < limit:
                return False
            # A token of one byte can't be undone; what is undone is the later of the two merges.
            can_a, can_b = right[a] != a, left[b] != b
            if not (can_a or can_b):
                return True
            if can_a and (not can_b or a > b):
                limit, a = a, right[a]
            else:
                # merges to the left come first where both are the same, so equality on this side still merges later
                limit, b = b + 1, left[b]

    def word(self, text: str) -> tuple[int, ...]:
        """Token ids of one pre-token."""
        latin = text.encode("utf-8", "surrogatepass").decode("latin-1")
        n = len(latin)
        if (token := self.whole.get(latin)) is not None and self._is_reached(token):
            return (token,)
        starts: list[list[int]] = [[] for _ in range(n)]
        length = self.length
        for end, token in self.automaton.iter(latin):
            starts[end + 1 - length[token]].append(token)
        fits, dead, out, at, last = self.fits, bytearray(n + 1), [], 0, -1
        while at < n:
            for token in reversed(starts[at]):
                if dead[at + length[token]]:
                    continue
                if last < 0:
                    break
                good = fits.get((last, token))
                if good is None:
                    if len(fits) > MEMO_PAIRS:
                        fits.clear()
                    good = fits[last, token] = self.compatible(last, token)
                if good:
                    break
            else:
                dead[at] = 1
                at -= length[out.pop()]
                last = out[-1] if out else -1
                continue
            out.append(token)
            at += length[token]
            last = token
        return tuple(out)

    def _is_reached(self, token: int) -> bool:
        """Whether merging a token's own bytes gives this very token."""
        a, b = self.left[token], self.right[token]
        return a == token or self.compatible(a, b) is False and self.pairs.get((a, b)) == token

    def encode(self, text: str | None) -> list[int]:
        """Token ids of a text, none for a null or empty one; special tokens' strings are ordinary text."""
        return list(chain.from_iterable(map(self.words.__getitem__, split(text)))) if text else []


class _Memo(dict):
    """Pre-token to ids; long ones and those beyond the limit are worked out again."""

    def __init__(self, encoder: Encoder):
        super().__init__()
        self.encoder = encoder

    def __missing__(self, text: str) -> tuple[int, ...]:
        ids = self.encoder.word(text)
        if len(text) <= MEMO_CHARS:
            if len(self) >= MEMO_WORDS:
                self.clear()
            self[text] = ids
        return ids


@functools.lru_cache(maxsize=2)
def load(path: str) -> Encoder:
    """The encoder of a tokenizers JSON file; once per worker."""
    with open(path, encoding="utf-8") as f:
        model = json.load(f)["model"]
    return Encoder(model["vocab"], [tuple(m) if not isinstance(m, str) else tuple(m.split(" ")) for m in model["merges"]])


def default_path() -> str:
    import sys

    if "/opt" not in sys.path:
        sys.path.append("/opt")
    try:
        from public_tokenizers import path
    except ImportError:
        return "/opt/tokenizers/byte_bpe_50k.json"
    return path("byte_bpe_50k.json")


def token_ids(df: DataFrame, key: str, text: str, path: str | None = None) -> DataFrame:
    """(key, ids array<int>) of every row: whole texts, in a narrow pass without shuffle.

    Null and empty texts give an empty list; repeated rows stay repeated; an
    empty table gives an empty result. ``path``: the vocabulary file, which
    every executor must have.
    """
    path = path or default_path()
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = load(path)
        for batch in batches:
            flat: list[int] = []
            ends = [0]
            words = encoder.words.__getitem__
            for value in batch.column(1).to_pylist():
                if value:
                    flat.extend(chain.from_iterable(map(words, split(value))))
                ends.append(len(flat))
            ids = pa.ListArray.from_arrays(pa.array(np.array(ends, np.int32)), pa.array(np.array(flat, np.int32)))
            yield pa.RecordBatch.from_arrays([batch.column(0), ids], names=["key", "ids"])

    return df.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text")).mapInArrow(run, f"key {kind}, ids array<int>").select(F.col("key").alias(key), "ids")
