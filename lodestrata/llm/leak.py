"""Evaluation passages inside training texts.

Windows of words get a 64-bit SimHash over their word pairs: windows of about each
item's size, for items that leaked as a whole, and of ``window`` words, for parts of
them. Item fingerprints are indexed by ``radius + 1`` blocks of bits: two fingerprints
that differ in at most ``radius`` bits agree in one block at least, so looking up each
block finds all of them. Candidates are verified by the exact weighted similarity
of their word pairs, and of those verified the words in common are counted.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from difflib import SequenceMatcher

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Unbroken runs of letters and digits.
WORD = re.compile(r"[^\W_]+")
#: Item characters indexed (and broadcast) at a time; more items are searched in further passes.
BLOCK_CHARS = 8_000_000
#: Candidates compared at a time.
EXPANDED = 1_000_000
#: Words handled at a time in a worker, and words its memo of hashes may hold.
CHUNK_WORDS, MEMO = 200_000, 500_000


def words_of(text: str | None) -> list[str]:
    return WORD.findall(text.lower()) if text else []


class _Hashes(dict):
    def __missing__(self, word: str) -> int:
        value = xxhash.xxh64_intdigest(word)
        if len(self) < MEMO:
            self[word] = value
        return value


def pair_hashes(h: np.ndarray) -> np.ndarray:
    """Hashes of neighbouring words' pairs."""
    x = (h[:-1] * np.uint64(0x9E3779B97F4A7C15)) ^ (np.left_shift(h[1:], np.uint64(31)) | np.right_shift(h[1:], np.uint64(33)))
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(32)
    return x


def counters(pairs: np.ndarray, n: int) -> list[np.ndarray]:
    """Of every n neighbouring shingles, how many have each of the 64 bits, as counters sliced over words: all bits are counted at once."""
    count = max(0, len(pairs) - n + 1)
    sliced = [np.zeros(count, np.uint64) for _ in range(n.bit_length())]
    for i in range(n):
        carry = pairs[i : i + count]
        for k in range((i + 1).bit_length()):
            sliced[k], carry = sliced[k] ^ carry, sliced[k] & carry
    return sliced


def doubled(sliced: list[np.ndarray], n: int) -> list[np.ndarray]:
    """The counters of windows of 2n shingles, from those of n: two neighbouring windows added."""
    count = max(0, len(sliced[0]) - n)
    carry, out = np.zeros(count, np.uint64), []
    for c in sliced:
        a, b = c[:count], c[n : n + count]
        both = a ^ b
        out.append(both ^ carry)
        carry = a & b | both & carry
    return [*out, carry]


def majority(sliced: list[np.ndarray], n: int) -> np.ndarray:
    """The bits that more than half of n shingles have: those whose count and what it lacks to the majority carry out of the top slice."""
    lack = (1 << len(sliced)) - (n // 2 + 1)
    carry = np.zeros(len(sliced[0]), np.uint64)
    for k, c in enumerate(sliced):
        carry = c | carry if lack >> k & 1 else c & carry
    return carry


def simhash(pairs: np.ndarray, n: int) -> np.ndarray:
    """SimHash of every n neighbouring shingles: each bit as in most of them."""
    return majority(counters(pairs, n), n)


class ItemIndex:
    """Fingerprints of all windows of some items, by blocks of their bits.

    ``weight``: weights of word pairs, by default the rarer among these items the heavier.
    """

    def __init__(self, items: list[tuple[int, str | None]], window: int, radius: int, weight: dict | None = None):
        self.window, self.radius = window, radius
        hashes = _Hashes()
        self.ids = [i for i, _ in items]
        self.words = [words_of(t) for _, t in items]
        prints, owner, offset = [], [], []
        for k, ws in enumerate(self.words):
            if len(ws) >= window:
                prints.append(simhash(pair_hashes(np.array([hashes[w] for w in ws], np.uint64)), window - 1))
                owner.append(np.full(len(ws) - window + 1, k, np.int32))
                offset.append(np.arange(len(ws) - window + 1, dtype=np.int32))
        join = lambda parts, kind: np.concatenate(parts) if parts else np.zeros(0, kind)
        self.prints, self.owner, self.offset = join(prints, np.uint64), join(owner, np.int32), join(offset, np.int32)
        self.weight = pair_weights(self.words) if weight is None else weight
        self.rare = max(self.weight.values(), default=1.0)
        edges = [round(64 * b / (radius + 1)) for b in range(radius + 2)]
        self.blocks = []
        for low, high in zip(edges, edges[1:]):
            keys = self._block(self.prints, low, high)
            order = np.argsort(keys, kind="stable").astype(np.int32)
            values, first, n = np.unique(keys[order], return_index=True, return_counts=True)
            self.blocks.append((low, high, order, values, first, n))

    @staticmethod
    def _block(prints: np.ndarray, low: int, high: int) -> np.ndarray:
        return (prints >> np.uint64(low)) & np.uint64((1 << (high - low)) - 1)

    def near(self, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All (position in ``prints``, item window) within the radius."""
        at, item = [], []
        for low, high, order, values, first, n in self.blocks:
            if not len(values):
                continue
            keys = self._block(prints, low, high)
            slot = np.minimum(np.searchsorted(values, keys), len(values) - 1)
            hit = np.flatnonzero(values[slot] == keys)
            slot = slot[hit]
            # so many lookups at a time that they give EXPANDED candidates, however full their buckets
            so_far = np.cumsum(n[slot])
            part = 0
            while part < len(hit):
                until = max(part + 1, int(np.searchsorted(so_far, (so_far[part - 1] if part else 0) + EXPANDED, "right")))
                rows, s = hit[part:until], slot[part:until]
                many, part = n[s], until
                left = np.repeat(rows, many)
                right = order[np.repeat(first[s], many) + np.arange(len(left)) - np.repeat(np.cumsum(many) - many, many)]
                close = np.bitwise_count(prints[left] ^ self.prints[right]) <= self.radius
                at.append(left[close])
                item.append(right[close])
        if not at:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        both = np.unique(np.stack([np.concatenate(at), np.concatenate(item)]), axis=1)
        return both[0], both[1]

    def similarity(self, a: list[str], b: list[str]) -> float:
        """Weighted Jaccard similarity of two windows' word pairs, counted with repeats; rare pairs weigh more."""
        x, y = Counter(zip(a, a[1:])), Counter(zip(b, b[1:]))
        w = lambda s: self.weight.get(s, self.rare)
        shared = sum(w(s) * n for s, n in (x & y).items())
        return shared / (sum(w(s) * n for s, n in (x | y).items()) or 1.0)


def pair_weights(words: list[list[str]]) -> dict[tuple[str, str], float]:
    """Weights of the items' word pairs, the rarer the heavier."""
    df = Counter(s for ws in words for s in set(zip(ws, ws[1:])))
    return {s: math.log1p(len(words) / n) for s, n in df.items()}


def item_indexes(items: list[tuple[int, str | None]], window: int, radius: int) -> list[ItemIndex]:
    """The index of all windows of ``window`` words, and those of the largest windows that fit into each item: about twice, four times ... as many words."""
    lengths = [len(words_of(t)) for _, t in items]
    first = ItemIndex(items, window, radius)
    out, pairs = [first], window - 1
    while pairs * 2 < max(lengths, default=0):
        pairs *= 2
        own = [x for x, n in zip(items, lengths) if pairs < n <= 2 * pairs]
        out.append(ItemIndex(own, pairs + 1, radius, first.weight))
    return out


def common_run(a: list[str], b: list[str]) -> int:
    """Words of the longest run two windows share."""
    return len(a) if a == b else SequenceMatcher(None, a, b, autojunk=False).find_longest_match().size


def _search(indexes: list[ItemIndex], hashes: _Hashes, keys: list, lists: list[list[str]], least: float) -> Iterator[tuple[object, int, float, int]]:
    """(key, item id, best similarity, most words in a row) of some documents' word lists."""
    flat = [x for ws in lists for x in ws]
    if len(flat) < indexes[0].window:
        return
    lengths = np.array([len(ws) for ws in lists])
    starts = np.cumsum(lengths) - lengths
    doc = np.repeat(np.arange(len(lists)), lengths)
    h = np.fromiter(map(hashes.__getitem__, flat), np.uint64, len(flat))
    best: dict[tuple[int, int], tuple[float, int]] = {}
    sliced = None
    for index in indexes:
        n, w = index.window - 1, index.window
        sliced = counters(pair_hashes(h), n) if sliced is None else doubled(sliced, n // 2)
        if not len(index.prints):
            continue
        at, item = index.near(majority(sliced, n))
        own = doc[at]
        inside = at + w <= starts[own] + lengths[own]  # a window must not reach into the next document
        for p, i, d in zip(at[inside].tolist(), item[inside].tolist(), own[inside].tolist()):
            k = int(index.owner[i])
            key = (d, index.ids[k])
            similar, run = best.get(key, (0.0, 0))
            if similar >= 1.0 and run >= indexes[0].window:
                continue
            a, b = flat[p : p + w], index.words[k][index.offset[i] : index.offset[i] + w]
            s = index.similarity(a, b)
            if s >= least:
                best[key] = max(similar, s), max(run, common_run(a, b))
    for (d, item_id), (s, run) in best.items():
        yield keys[d], item_id, s, run


def leaks(docs: DataFrame, doc_key: str, text: str, items: DataFrame, item_key: str, item_text: str, window: int = 12, radius: int = 3, least: float = 0.8) -> DataFrame:
    """(doc, item, similarity, words): documents with a passage like one of an item.

    A passage is a window of ``window`` words, or one of about the item's size. ``least`` is the weighted similarity
    of word pairs it must have to the item's; ``words`` is the length of the longest run of words seen in common,
    at least ``window`` if they share so many in a row. Words are
    runs of letters and digits in lower case. Null, empty and shorter texts
    match nothing; repeated rows give one row. Items are searched in blocks of
    ``BLOCK_CHARS``, each broadcast; documents are read in place, without shuffle.
    """
    spark = docs.sparkSession
    kind = docs.schema[doc_key].dataType.simpleString()
    schema = f"doc {kind}, item bigint, similarity double, words int"
    rows = docs.select(F.col(doc_key).alias("k"), F.col(text).cast("string").alias("t")).where("t is not null")
    out = None
    for block in _blocks(items.select(F.col(item_key).cast("bigint"), F.col(item_text).cast("string")).distinct()):
        shared = spark.sparkContext.broadcast(item_indexes(block, window, radius))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            hashes = _Hashes()
            for batch in batches:
                keys, lists, n, found = [], [], 0, []
                for k, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    ws = words_of(t)
                    if len(ws) >= window:
                        keys.append(k)
                        lists.append(ws)
                        n += len(ws)
                    if n >= CHUNK_WORDS:
                        found += _search(shared.value, hashes, keys, lists, least)
                        keys, lists, n = [], [], 0
                found += _search(shared.value, hashes, keys, lists, least)
                if found:
                    a, b, c, d = zip(*found)
                    yield pa.RecordBatch.from_arrays([pa.array(a, batch.column(0).type), pa.array(b, pa.int64()), pa.array(c, pa.float64()), pa.array(d, pa.int32())], names=["doc", "item", "similarity", "words"])

        part = rows.mapInArrow(run, schema)
        out = part if out is None else out.unionByName(part)
    if out is None:
        return spark.createDataFrame([], schema)
    return out.groupBy("doc", "item").agg(F.max("similarity").alias("similarity"), F.max("words").alias("words"))


def _blocks(items: DataFrame) -> Iterator[list[tuple[int, str | None]]]:
    """Items in blocks of at most ``BLOCK_CHARS`` (one longer item is a block of its own)."""
    block, n = [], 0
    for key, text in items.toLocalIterator():
        if block and n + len(text or "") > BLOCK_CHARS:
            yield block
            block, n = [], 0
        block.append((key, text))
        n += len(text or "")
    if block:
        yield block


def found(documents: DataFrame, items: DataFrame) -> DataFrame:
    """p8: (doc_id, item_id) with at least 12 consecutive words in common."""
    return leaks(documents, "doc_id", "text", items, "item_id", "text").where("words >= 12").select(F.col("doc").alias("doc_id"), F.col("item").alias("item_id"))
