"""Languages of texts and of their parts, by bit-sliced Bloom filters of n-grams.

Every n-gram's slot holds one bit for each language, so a lookup (the AND of a
few slots) gives all languages that have the n-gram at once. For each stretch
between sentence ends, the bits are counted per language, corrected for the
filters' false positives, and the best language is taken if it leads clearly.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Labelled texts of each declared language the filters are fitted on, taken by a hash of the id; whole texts, those beyond so many characters are not taken.
SAMPLE_TEXTS, SAMPLE_LONGEST = 700, 50_000
#: Slots of the filters, and lengths of n-grams in alphabetic scripts and of CJK characters.
SLOTS, GRAMS, CJK_GRAMS = 1 << 21, (3, 4, 5), (1, 2, 3)
#: An n-gram belongs to a language if it is at least so frequent in it, compared to the language where it is most frequent, and in so many texts.
SHARE, LEAST_TEXTS = 0.3, 3
#: A label whose texts a more frequent one knows nearly as well (this share of the n-grams) in this share of the cases is no language of its own.
CLAIM, CLAIMED = 0.85, 0.6
#: A stretch has a language if the best has this share of its n-grams and leads the second by so much of them; a stretch of fewer n-grams than ENOUGH needs a lead as many times larger. Titles and whole texts need less.
MAJORITY, LEAD, ENOUGH, LEAST_GRAMS = 0.55, 0.15, 60, 24
TITLE_MAJORITY, TITLE_LEAD, TITLE_GRAMS = 0.45, 0.06, 24
#: A CJK character counts like so many n-grams of an alphabetic script when the size of a stretch is judged.
CJK_SIZE = 8
#: Characters handled at a time; a longer stretch is counted in parts of this length.
CHUNK, LONGEST = 300_000, 20_000

#: Bibliographic codes of ISO 639-2, where they differ from the terminological ones, and usual names no locale has (fixed values).
OTHER_NOTATIONS = {
    "alb": "sq", "arm": "hy", "baq": "eu", "bur": "my", "chi": "zh", "cze": "cs", "dut": "nl", "fre": "fr", "geo": "ka", "ger": "de", "gre": "el", "ice": "is", "mac": "mk", "mao": "mi", "may": "ms", "per": "fa", "rum": "ro",
    "slo": "sk", "tib": "bo", "wel": "cy", "cmn": "zh", "mandarin": "zh", "castellano": "es", "espanol": "es", "francais": "fr", "portugues": "pt",
}
#: Languages in whose words names of languages are known, besides their own.
NAMED_IN = ("en", "de", "fr", "es", "pt", "it", "nl")
_notations: dict[str, str] = {}


def notations(spark: SparkSession) -> dict[str, str]:
    """Codes and names of all languages of ISO 639-1, in lower case, to the two-letter code, by the JVM's locales."""
    if not _notations:
        locale = spark.sparkContext._jvm.java.util.Locale
        codes = list(locale.getISOLanguages())
        _notations.update({c: c for c in codes})
        shown = [locale.forLanguageTag(x) for x in NAMED_IN]
        for code in codes:
            own = locale.forLanguageTag(code)
            for name in [own.getISO3Language(), *(own.getDisplayLanguage(x) for x in [*shown, own])]:
                _notations.setdefault(name.lower(), code)
        for name, code in OTHER_NOTATIONS.items():
            _notations.setdefault(name, code)
    return _notations


def with_declared(rows: DataFrame, lang: str = "lang") -> DataFrame:
    """``rows`` and ``declared``: the two-letter code a declared language means, with or without a region; null if it names none.

    The names are joined as a broadcast table of some thousand rows, the same for any input.
    """
    spark = rows.sparkSession
    names = spark.createDataFrame(list(notations(spark).items()), "notation__ string, declared string")
    head = F.lower(F.regexp_extract(F.trim(F.col(lang)), r"^([^\s_\-.,;/]+)", 1))
    return rows.drop("declared").join(F.broadcast(names), head == F.col("notation__"), "left").drop("notation__")


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """By character: its class (0 separator, 1 letter, 2 CJK letter, 3 digit, 4 . ! ?, 5 。！？ and parentheses, 6 newline), and its lower case where that is one character."""
    kinds, lower = np.zeros(0x110000, np.uint8), np.arange(0x110000, dtype=np.uint32)
    for c in range(0x20000):  # beyond are CJK letters only
        ch = chr(c)
        if ch.isalpha():
            kinds[c] = 1
            if len(low := ch.lower()) == 1:
                lower[c] = ord(low)
        elif ch.isdigit():
            kinds[c] = 3
    for a, b in ((0x3400, 0x9FFF), (0xF900, 0xFAFF), (0x20000, 0x3FFFF)):
        kinds[a : b + 1] = 2
    kinds[[ord(x) for x in ".!?"]] = 4
    kinds[[ord(x) for x in "。！？()（）"]] = 5
    kinds[[10, 13]] = 6
    return kinds, lower


CLASS, LOWER = _tables()


#: What else ends a stretch in a title, and a file's ending.
TITLE_ENDS = re.compile(r"\s[-–—|:]\s|[–—|()\[\]]|\s/\s")
_FILE_ENDING = re.compile(r"\.[A-Za-z]{2,5}\s*$")


def title_text(title: str) -> str:
    """A title as lines: one for each part, without the ending of a file name."""
    return TITLE_ENDS.sub("\n", _FILE_ENDING.sub("", title).replace("_", " "))


def _codes(text: str) -> np.ndarray:
    """Code points in lower case, one for each character of the text."""
    return LOWER[np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)]


def grams(codes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places, hashes) of the n-grams of each length: inside a word, with its borders as spaces."""
    kind = CLASS[codes]
    cjk = kind == 2
    word = cjk | (kind == 1)
    letters = np.where(word, codes, 32).astype(np.uint64)
    h = letters
    at = np.flatnonzero(cjk)
    yield at, _finish(letters[at])
    inner = np.ones(len(codes), bool)
    for size in range(2, max(GRAMS) + 1):
        m = len(codes) - size + 1
        if m <= 0:
            return
        h = h[:m] * np.uint64(0x9E3779B97F4A7C15) + letters[size - 1 :]
        if size == 2:
            ok = cjk[:m] & cjk[1:]
        else:
            inner = inner[:m] & word[size - 2 : size - 2 + m]
            ok = inner & ~cjk[1 : 1 + m] if size not in CJK_GRAMS else inner & (~cjk[1 : 1 + m] | cjk[:m] & cjk[2:])
        at = np.flatnonzero(ok)
        yield at, _finish(h[at] ^ np.uint64(size))


def _finish(g: np.ndarray) -> np.ndarray:
    g = (g * np.uint64(0x94D049BB133111EB) ^ (g >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return g ^ (g >> np.uint64(29))


def stretches(codes: np.ndarray) -> np.ndarray:
    """First places of the stretches between sentence and line ends."""
    kind = CLASS[codes]
    ends = (kind == 5) | (kind == 6)
    ends[:-1] |= (kind[:-1] == 4) & ((kind[1:] == 0) | (kind[1:] == 6))
    first = np.flatnonzero(ends[:-1]) + 1
    return np.concatenate([[0], first]).astype(np.int64)


class Filters:
    """Bloom filters of several languages, sliced into the bits of common slots; 16 languages a table."""

    def __init__(self, languages: list[str]):
        self.languages = languages
        self.tables = [np.zeros(SLOTS, np.uint16) for _ in range(0, len(languages), 16)]
        self.false_rate = np.zeros(len(languages))

    def _slots(self, g: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return (g & np.uint64(SLOTS - 1)).astype(np.int64), ((g >> np.uint64(32)) & np.uint64(SLOTS - 1)).astype(np.int64)

    def add(self, language: int, g: np.ndarray) -> None:
        for slots in self._slots(g):
            self.tables[language // 16][slots] |= np.uint16(1 << language % 16)

    def seal(self) -> Filters:
        """Work out the rate of false positives, the square of the share of set bits."""
        for k in range(len(self.languages)):
            self.false_rate[k] = ((self.tables[k // 16] >> np.uint16(k % 16)) & 1).mean() ** 2
        step = np.arange(16, dtype=np.uint64)
        # four counters of 16 bits in one number, by the four bits of a nibble of the mask
        self.lanes = sum(((step >> np.uint64(b)) & np.uint64(1)) << np.uint64(16 * b) for b in range(4))
        return self

    def count(self, codes: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(languages x stretches) n-grams found, corrected for false positives, and n-grams of each stretch."""
        k = len(self.languages)
        hits, total = np.zeros((k, len(first))), np.zeros(len(first))
        for at, g in grams(codes):
            if not len(at):
                continue
            a, b = self._slots(g)
            start = np.searchsorted(at, first)
            n = np.diff(np.append(start, len(at)))
            full = np.flatnonzero(n)
            total += n
            for block, table in enumerate(self.tables):
                mask = table[a] & table[b]
                for q in range(16 * block, min(16 * block + 16, k), 4):
                    packed = np.add.reduceat(self.lanes[(mask >> np.uint16(q % 16)) & np.uint16(15)], start[full])
                    for j in range(q, min(q + 4, k)):
                        hits[j, full] += (packed >> np.uint64(16 * (j - q))) & np.uint64(0xFFFF)
        rate = self.false_rate[:, None]
        return np.maximum(0, (hits - rate * total) / (1 - rate)), total


def fit(texts: list[tuple[str, str]], sizes: dict[str, int] | None = None) -> Filters:
    """Filters of (language, text) rows whose labels may be wrong: fitted, texts relabelled by them, fitted again.

    ``sizes``: rows of each language in the whole table, of which ``texts`` is a sample (its own counts if absent).
    A label whose texts are known nearly as well to a more frequent one is put together with it, however large its
    part of the sample, and a language that hardly any of its own texts turn out to be in is dropped.
    """
    sizes = sizes or Counter(x for x, _ in texts)
    prepared = []
    for language, text in texts:
        codes = _codes(text)
        parts = [g for _, g in grams(codes)]
        prepared.append((codes, np.unique(np.concatenate(parts)) if parts else np.zeros(0, np.uint64)))
    sets = [g for _, g in prepared]
    names = sorted({x for x, _ in texts}, key=lambda x: (-sizes.get(x, 0), x))
    labels: list[str | None] = [x for x, _ in texts]
    filters, relabelled = _fit_once(names, labels, sets), 0
    while names and relabelled < 2:
        filters = _fit_once(names, labels, sets)
        counted = [filters.count(c, np.zeros(1, np.int64)) if len(c) else (np.zeros((len(names), 1)), np.zeros(1)) for c, _ in prepared]
        claimed, best = {x: [] for x in names}, []
        for (h, n), own in zip(counted, labels):
            clear = n[0] >= TITLE_GRAMS
            best.append(names[int(h[:, 0].argmax())] if clear else None)  # of equals the more frequent one
            if clear and own in claimed:
                i = names.index(own)
                claimed[own].append(h[:i, 0].max(initial=0.0) >= CLAIM * h[i, 0])
        decoys = {x for x, c in claimed.items() if not c or sum(c) >= CLAIMED * len(c)}
        if not decoys:
            own = {x: [b == x for b, y in zip(best, labels) if y == x and b] for x in names}
            decoys = {x for x, c in own.items() if sum(c) < 0.4 * len(c)}
            labels = best
            relabelled += 1
        names = [x for x in names if x not in decoys]
        labels = [x if x in names else None for x in labels]
    return _fit_once(sorted(names), labels, sets)


def _fit_once(names: list[str], labels: list[str | None], sets: list[np.ndarray]) -> Filters:
    filters = Filters(names)
    if not names:
        return filters.seal()
    rows = [[g for x, g in zip(labels, sets) if x == name] for name in names]
    counted = [np.unique(np.concatenate(r), return_counts=True) if r else (np.zeros(0, np.uint64), np.zeros(0, np.int64)) for r in rows]
    every = np.unique(np.concatenate([c[0] for c in counted]))
    rate = lambda k: counted[k][1] / max(1, len(rows[k]))
    most = np.zeros(len(every))
    places = [np.searchsorted(every, g) for g, _ in counted]
    for k, at in enumerate(places):
        most[at] = np.maximum(most[at], rate(k))
    for k, (g, n) in enumerate(counted):
        filters.add(k, g[(rate(k) >= SHARE * most[places[k]]) & (n >= min(LEAST_TEXTS, max(1, len(rows[k]) // 4)))])
    return filters.seal()


def _sizes(codes: np.ndarray, first: np.ndarray, total: np.ndarray) -> np.ndarray:
    """How much text a stretch holds, in n-grams of an alphabetic script."""
    return total + CJK_SIZE * np.add.reduceat((CLASS[codes] == 2).astype(np.int64), first)


def _decide(filters: Filters, hits: np.ndarray, total: np.ndarray, size: np.ndarray, short: bool, closed: np.ndarray | bool = True) -> tuple[np.ndarray, np.ndarray]:
    """(language index or -1, confidence) of each stretch; few n-grams are enough in one ``closed`` by a sentence's mark only."""
    if not len(filters.languages):
        return np.full(len(total), -1), np.zeros(len(total))
    order = np.sort(hits, axis=0)
    best, second = order[-1], order[-2] if len(order) > 1 else np.zeros(len(total))
    majority, lead, least, enough = (TITLE_MAJORITY, TITLE_LEAD, TITLE_GRAMS, TITLE_GRAMS) if short else (MAJORITY, LEAD, LEAST_GRAMS, ENOUGH)
    clear = lead * np.maximum(1, enough / np.maximum(size, 1))
    sure = (size >= np.where(closed, least, enough)) & (best >= majority * total) & (best - second >= clear * total)
    confidence = np.where(best > 0, (best - second) / np.maximum(best, 1), 0.0)
    return np.where(sure, hits.argmax(axis=0), -1), confidence


SEGMENTS = "source_table string, row_id string, declared string, segment int, start int, end int, lang string, confidence double, n_grams int"


def label(filters: Filters, texts: list[str], title: bool) -> list[list[tuple[int, int, str | None, float, int]]]:
    """Of each text its segments (start, end, language, confidence, n-grams).

    Neighbouring stretches of one language make a segment; stretches without a
    clear language join the segment before. If no stretch is clear, the whole
    text is one segment, with a language if it is clear as a whole. Places are
    those in the text, or for titles in ``title_text`` of it.
    """
    codes = [_codes(t) for t in texts]
    gap = np.full(6, 10, np.uint32)
    flat = np.concatenate([x for c in codes for x in (c, gap)])
    begin = np.cumsum([0] + [len(c) + 6 for c in codes])
    first = stretches(flat)
    # cut by each text's own places, so that a text's result doesn't depend on its neighbours
    first = np.unique(np.concatenate([first, begin[:-1], *(np.arange(b + LONGEST, b + len(c), LONGEST) for b, c in zip(begin, codes))]))
    hits, total = filters.count(flat, first)
    size = _sizes(flat, first, total)
    closed = np.isin(CLASS[flat[np.append(first[1:], len(flat)) - 1]], (4, 5))
    lang, confidence = _decide(filters, hits, total, size, title, closed)
    edge = np.searchsorted(first, begin)
    out = []
    for k, c in enumerate(codes):
        a, b = edge[k], edge[k + 1]
        segments: list[list] = []
        for i in range(a, b):
            if lang[i] < 0:
                continue
            if segments and segments[-1][2] == lang[i]:
                segments[-1][3] += confidence[i] * total[i]
                segments[-1][4] += total[i]
            else:
                segments.append([int(first[i] - begin[k]), 0, lang[i], confidence[i] * total[i], total[i]])
        if not segments:
            whole, n = hits[:, a:b].sum(axis=1, keepdims=True), total[a:b].sum(keepdims=True)
            x, y = _decide(filters, whole, n, size[a:b].sum(keepdims=True), True)
            segments = [[0, 0, x[0], y[0] * n[0], n[0]]]
        segments[0][0] = 0
        for s, t in zip(segments, segments[1:] + [[len(c)]]):
            s[1] = t[0]
        out.append([(s[0], s[1], filters.languages[s[2]] if s[2] >= 0 else None, float(s[3] / s[4]) if s[4] else 0.0, int(s[4])) for s in segments])
    return out


def segments(rows: DataFrame, filters: Filters) -> DataFrame:
    """``SEGMENTS`` of (source_table, row_id, declared, text, title boolean) rows; whole texts, no shuffle.

    Null ids and texts without any letter give no rows, texts whose words belong
    to no known language one row with a null language; repeated rows stay.
    """
    shared = rows.sparkSession.sparkContext.broadcast(filters)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [c.to_pylist() for c in batch.columns]
            pending, size = [], 0
            for i in range(batch.num_rows):
                pending.append(i)
                size += len(columns[3][i])
                if size < CHUNK and i + 1 < batch.num_rows:
                    continue
                out: list[tuple] = []
                for title in (False, True):
                    own = [j for j in pending if columns[4][j] == title]
                    texts = [title_text(columns[3][j]) if title else columns[3][j] for j in own]
                    if own:
                        for j, found in zip(own, label(shared.value, texts, title)):
                            out += [(columns[0][j], columns[1][j], columns[2][j], k, *s) for k, s in enumerate(found)]
                pending, size = [], 0
                kinds = (pa.string(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.float64(), pa.int32())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names=["source_table", "row_id", "declared", "segment", "start", "end", "lang", "confidence", "n_grams"])

    read = rows.where(F.col("row_id").isNotNull() & F.col("text").rlike(r"(?U)\p{L}"))
    return read.select("source_table", "row_id", "declared", "text", "title").mapInArrow(run, SEGMENTS)


def training_sample(rows: DataFrame, least_chars: int = 80) -> tuple[list[tuple[str, str]], dict[str, int]]:
    """(language, text) of at most ``SAMPLE_TEXTS`` labelled rows of each declared language, by a hash of their id; and rows of each language in all."""
    labelled = rows.where(F.col("declared").isNotNull() & F.length("text").between(least_chars, SAMPLE_LONGEST))
    counts = {r.declared: r.n for r in labelled.groupBy("declared").agg(F.count(F.lit(1)).alias("n")).collect()}  # one row per language
    if not counts:
        return [], {}
    hashed = F.pmod(F.xxhash64("row_id"), F.lit(1_000_000))
    bound = F.create_map(*[F.lit(x) for k, n in counts.items() for x in (k, 1_000_000 if n <= SAMPLE_TEXTS else math.ceil(1_500_000 * SAMPLE_TEXTS / n))])
    sample = labelled.where(hashed < bound[F.col("declared")]).select("declared", hashed.alias("h"), "row_id", "text", "title").distinct()
    taken: dict[str, list] = {}
    for r in sorted(sample.collect(), key=lambda r: (r.h, r.row_id, r.text)):
        if len(taken.setdefault(r.declared, [])) < SAMPLE_TEXTS:
            taken[r.declared].append((r.declared, title_text(r.text) if r.title else r.text))
    return [x for k in sorted(taken) for x in taken[k]], counts


def text_languages(labelled: DataFrame) -> DataFrame:
    """(source_table, row_id, declared, lang, n, confidence): every language of every text, from its segments."""
    return labelled.where("lang is not null").groupBy("source_table", "row_id", "declared", "lang").agg(F.sum("n_grams").alias("n"), (F.sum(F.col("confidence") * F.col("n_grams")) / F.greatest(F.sum("n_grams"), F.lit(1))).alias("confidence"))


def found(chunks: DataFrame, titles: DataFrame) -> DataFrame:
    """p3: (source_table, row_id, lang) of texts whose declared language is missing or wrong, or which hold several."""
    a = chunks.where(F.col("chunk_type").isin("text", "page")).select(F.lit("job_chunks").alias("source_table"), F.col("id").alias("row_id"), "lang", "text", F.lit(False).alias("title"))
    b = titles.select(F.lit("demo_documents").alias("source_table"), F.col("document_id").alias("row_id"), "lang", F.col("title").alias("text"), F.lit(True).alias("title"))
    a, b = with_declared(a), with_declared(b)
    (texts, sizes), (more, other) = training_sample(a), training_sample(b, 20)
    filters = fit(texts + more, dict(Counter(sizes) + Counter(other)))
    labelled = segments(a.unionByName(b), filters).where("lang is not null")
    per_text = labelled.groupBy("source_table", "row_id").agg(F.collect_set("lang").alias("langs"), F.max("declared").alias("declared"))
    cases = per_text.where((F.size("langs") > 1) | F.col("declared").isNull() | ~F.array_contains("langs", F.coalesce("declared", F.lit(""))))
    return cases.select("source_table", "row_id", F.explode("langs").alias("lang"))
