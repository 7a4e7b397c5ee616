"""Repair of text from scanned pages: lines labelled by a hidden Markov model, torn and misread words mended.

Lines are labelled as body, header, page number or break (blank line) from
layout features, by Viterbi decoding of a model fitted here by hard EM on a
bounded sample. Body lines are put together to paragraphs across furniture and
breaks that cut a sentence; words torn over line ends are joined; misread words
are told by a lexicon of the whole table and the usual confusions of characters.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrata.session import materialize

#: Texts the line model is fitted on, taken by a hash of their id, and rounds of fitting.
TRAIN_TEXTS, ROUNDS = 1_500, 4
#: The least count of a word of the lexicon. A lexicon of up to so many characters is broadcast; of a larger one every group of texts gets the words it asks for, by a join.
LEAST_COUNT, LEXICON_CHARS = 5, 20_000_000
#: Characters of the texts of such a group, about.
GROUP_CHARS = 16_000_000
#: A word is misread if a word it may be misread from is so many times as frequent.
RATIO = 15
#: What is read for what in words (fixed values: common confusions of recognised characters).
CONFUSIONS = [("c", "e"), ("o", "a"), ("l", "i"), ("ii", "u"), ("cl", "d"), ("rn", "m"), ("m", "in"), ("b", "h"), ("vv", "w"), ("I", "l")]
SHORT_CONFUSIONS = [("l", "i")]  # in words of two letters, others are too often words themselves
DIGIT_TO_LETTER = {"0": "o", "1": "l", "5": "s", "6": "b", "9": "g"}
LETTER_TO_DIGIT = {"O": "0", "o": "0", "l": "1", "I": "1", "S": "5", "s": "5"}
#: Words that may follow a hyphen left standing, as in "pre- and post-".
SUSPENDED = {"and", "or", "to", "und", "oder", "bis", "et", "ou", "y", "e", "o", "u", "en", "of"}

BODY, HEADER, NUMBER, BREAK = range(4)
HYPHENS = "-­‐‑¬"
_NUMBER_LINE = re.compile(r"^[\[(—–\-·•\s]*(?:[^\W\d_]{1,10}\.?\s+)?[\dlOSI]{1,4}(?:\s*(?:/|of|von|de|sur|van)\s*[\dlOSI]{1,4})?[\])—–\-·•.\s]*$")
_TERMINAL = re.compile(r"[.!?。！？][\"”»')\]]*$")
_SEPARATED = re.compile(r"\s[—–|]\s|^(?:[A-ZÀ-Þ]\S*\s+){1,3}[A-ZÀ-Þ]\S*:\s[^\Wa-zà-ÿ_]")
_TRAILING = re.compile(r"\S\s{2,}\d{1,4}$")
_LEADING = re.compile(r"^\d{1,4}\s+[A-ZÀ-Þ][^.,;!?]*$")
_LISTED = re.compile(r"^\s*(?:#{1,6}\s|[-*•]\s|\d+[.)]\s\S|\||```)")
#: A line that stops within a sentence and one that goes on.
MAYBE_WRAPPED = r"[^\n.!?。！？:;|]\n+(?:[^\n]*\n+){0,3}?[a-zà-ÿ]"
_EVIDENCE = re.compile(r"(?:[\w,]|[-­‐]\s?)\n(?=[a-zà-ÿ])")


def scanned(text: str) -> bool:
    """Whether anything tells of wraps or furniture: a wrap, a hyphen at a line end, a number's line, or a lower-case start after an open line.

    Blank lines and blanks at line ends don't matter.
    """
    if _EVIDENCE.search(text):
        return True
    lines = [x for line in text.splitlines() if (x := line.strip())]
    return any(
        a[-1] in HYPHENS and len(a) > 1 and a[-2].isalnum() or b[0].islower() and not _TERMINAL.search(a) or any(_NUMBER_LINE.match(x) and any(map(str.isdigit, x)) for x in (a, b))
        for a, b in zip(lines, lines[1:])
    )


def observe(lines: list[str]) -> list[tuple | None]:
    """Layout features of each line, None for blank ones: form, end, start, room left, gap before, bridge over, blank neighbours."""
    text = [x.strip() for x in lines]
    full = [i for i, x in enumerate(text) if x]
    runs = [len(text[a]) for a, b in zip(full, full[1:]) if b == a + 1 and text[b][0].islower() and not _TERMINAL.search(text[a])]
    width = max(runs or [len(text[i]) for i in full] or [0])
    out: list[tuple | None] = [None] * len(lines)
    first = {i: len(text[i].split(None, 1)[0]) for i in full}
    number = {i: bool(_NUMBER_LINE.match(text[i])) for i in full}
    for k, i in enumerate(full):
        x = text[i]
        before = next((j for j in reversed(full[:k]) if not number[j]), None)
        after = next((j for j in full[k + 1 :] if not number[j]), None)
        letters = [c for c in x if c.isalpha()]
        form = (
            "number" if number[i] else "list" if _LISTED.match(x) else "caps" if len(letters) > 5 and sum(map(str.isupper, letters)) > 0.85 * len(letters)
            else "separated" if _SEPARATED.search(x) else "trailing" if _TRAILING.search(x) else "leading" if _LEADING.search(x) else "plain"
        )
        end = "stop" if _TERMINAL.search(x) else "hyphen" if x[-1] in HYPHENS else "open"
        start = "lower" if x[0].islower() else "upper" if x[0].isupper() else "other"
        fits = lambda a, b: len(text[a]) + 1 + first[b] <= width
        room = "last" if after is None else "left" if fits(i, after) else "none"
        open_before = before is not None and not _TERMINAL.search(text[before])
        gap = "start" if before is None else "done" if not open_before else "early" if fits(before, i) and text[before][-1] not in HYPHENS else "wrapped"
        bridge = open_before and after is not None and (text[after][0].islower() or text[before][-1] in HYPHENS) and (not fits(before, after) or text[before][-1] in HYPHENS)
        blank = (i > 0 and not text[i - 1]) + 2 * (i + 1 < len(text) and not text[i + 1])
        out[i] = (form, end, start, room, gap, bridge, blank if open_before or not end == "stop" else 4)
    return out


#: First guess of the share of each feature value in body, header and number lines; what isn't named shares the rest.
_GUESS = [
    {"number": (0.001, 0.005, 0.97), "list": (0.02, 0.002, 0.005), "caps": (0.002, 0.25, 0.005), "separated": (0.004, 0.5, 0.005), "trailing": (0.001, 0.1, 0.005), "leading": (0.01, 0.04, 0.005), "plain": (0.962, 0.1, 0.01)},
    {"stop": (0.25, 0.01, 0.2), "hyphen": (0.15, 0.01, 0.15), "open": (0.6, 0.98, 0.65)},
    {"lower": (0.6, 0.01, 0.01), "upper": (0.35, 0.95, 0.3), "other": (0.05, 0.04, 0.69)},
    {"last": (0.1, 0.05, 0.05), "left": (0.12, 0.55, 0.9), "none": (0.78, 0.4, 0.05)},
    {"start": (0.1, 0.03, 0.03), "done": (0.28, 0.25, 0.3), "early": (0.02, 0.4, 0.4), "wrapped": (0.6, 0.32, 0.27)},
    {True: (0.25, 0.65, 0.6), False: (0.75, 0.35, 0.4)},
    {0: (0.6, 0.25, 0.25), 1: (0.1, 0.1, 0.1), 2: (0.1, 0.5, 0.5), 3: (0.02, 0.1, 0.1), 4: (0.18, 0.05, 0.05)},
]
_MOVES = [[0.82, 0.03, 0.03, 0.12], [0.45, 0.01, 0.14, 0.4], [0.45, 0.14, 0.01, 0.4], [0.86, 0.06, 0.06, 0.02]]


class LineModel:
    """A hidden Markov model whose lines emit their features independently."""

    def __init__(self):
        self.emit = [{v: [math.log(p) for p in ps] for v, ps in f.items()} for f in _GUESS]
        self.move = [[math.log(p) for p in row] for row in _MOVES]

    def label(self, seen: list[tuple | None]) -> list[int]:
        """The most likely labels of a text's lines."""
        back: list[list[int]] = []
        score = [0.0, -1.0, -1.0, 0.0]
        for k, obs in enumerate(seen):
            if obs is None:
                own = [-math.inf] * 3 + [0.0]
            else:
                own = [sum(f[v][s] for f, v in zip(self.emit, obs)) for s in range(3)] + [-math.inf]
            if k == 0:
                score, back = [a + b for a, b in zip(score, own)], [[0] * 4]
                continue
            best = [max(range(4), key=lambda r: score[r] + self.move[r][s]) for s in range(4)]
            score = [score[best[s]] + self.move[best[s]][s] + own[s] for s in range(4)]
            back.append(best)
        if not back:
            return []
        at = [max(range(4), key=score.__getitem__)]
        for best in reversed(back[1:]):
            at.append(best[at[-1]])
        return at[::-1]

    def fit(self, texts: list[str], rounds: int = ROUNDS, trust: float = 200.0) -> LineModel:
        """Hard EM: label, count, and mix the counts with the first guess, which weighs ``trust`` lines."""
        seen = [observe(t.splitlines()) for t in texts]
        for _ in range(rounds):
            labels = [self.label(s) for s in seen]
            moves = [[trust * p for p in row] for row in _MOVES]
            emits = [{v: [trust * p for p in ps] for v, ps in f.items()} for f in _GUESS]
            for row, obs in zip(labels, seen):
                for a, b in zip(row, row[1:]):
                    moves[a][b] += 1
                for s, o in zip(row, obs):
                    if o is not None:
                        for f, v in zip(emits, o):
                            f[v][s] += 1
            self.move = [[math.log(p / sum(row)) for p in row] for row in moves]
            totals = [[sum(ps[s] for ps in f.values()) for s in range(3)] for f in emits]
            self.emit = [{v: [math.log(ps[s] / t[s]) for s in range(3)] for v, ps in f.items()} for f, t in zip(emits, totals)]
        return self


def bare(word: str) -> str:
    """A word without what is neither letter nor digit at its ends."""
    a, b = 0, len(word)
    while a < b and not word[a].isalnum():
        a += 1
    while b > a and not word[b - 1].isalnum():
        b -= 1
    return word[a:b]


#: Letters the confusions don't hold for.
_OTHER_SCRIPT = re.compile(r"[^\W\d_a-zà-öø-ÿœšžıﬀ-ﬆ]")
_CODE = re.compile(r"^([A-Z]{1,4})-([\dOlIS]+)$")
_MIXED_NUMBER = re.compile(r"^[\dOlIS]*\d[\dOlIS]*$")


def correction(word: str, lexicon: dict[str, int]) -> str | None:
    """The right form, in lower case, of a bare word with misread characters; None for a sound one."""
    low = word.lower()
    count = lexicon.get(low, 0)
    has_digit, has_letter = any(map(str.isdigit, word)), any(map(str.isalpha, word))
    if not low.isascii() and _OTHER_SCRIPT.search(low):
        return None
    if has_digit and has_letter:
        if m := _CODE.match(word):
            digits = "".join(LETTER_TO_DIGIT.get(c, c) for c in m[2])
            return f"{m[1].lower()}-{digits}" if digits != m[2] and any(map(str.isdigit, m[2])) else None
        if _MIXED_NUMBER.match(word):
            return "".join(LETTER_TO_DIGIT.get(c, c) for c in word)
        letters = "".join(DIGIT_TO_LETTER.get(c, c) for c in low)
        if any(map(str.isdigit, letters)):
            return None
        if lexicon.get(letters, 0) >= max(LEAST_COUNT, RATIO * count):
            return letters
        if (more := correction(letters, lexicon)) is not None:
            return more
        return letters if sum(map(str.isalpha, low)) >= 4 and sum(map(str.isdigit, low)) == 1 and not low[0].isdigit() and count < LEAST_COUNT else None
    if not has_letter or len(low) < 2:
        return None
    best, form = 0, None
    for wrong, right in CONFUSIONS if len(low) > 2 else SHORT_CONFUSIONS:
        at = word.find(wrong) if wrong == "I" else low.find(wrong)
        n = 0
        while at >= 0:
            v = low[:at] + right + low[at + len(wrong) :]
            c = lexicon.get(v, 0)
            if c > best:
                best, form = c, v
            n += 1
            at = word.find(wrong, at + 1) if wrong == "I" else low.find(wrong, at + 1)
        if n > 1 and wrong != "I" and (c := lexicon.get(v := low.replace(wrong, right), 0)) > best:
            best, form = c, v
    return form if form is not None and best >= max(LEAST_COUNT, RATIO * count) else None


class Repair:
    """Labels and mends texts with a line model and a lexicon (word in lower case to its count)."""

    def __init__(self, model: LineModel, lexicon: dict[str, int]):
        self.model, self.lexicon = model, lexicon
        self.memo: dict[str, str | None] = {}

    def right(self, word: str) -> str | None:
        try:
            return self.memo[word]
        except KeyError:
            clean = bare(word)
            value = correction(clean, self.lexicon) if clean else None
            if len(self.memo) > 400_000:
                self.memo.clear()
            self.memo[word] = value
            return value

    def joined(self, left: str, right: str) -> tuple[str, str] | None:
        """(whole word in lower case, the two parts as one) if a line end tears a word; left ends with a hyphen."""
        mark = left.rstrip()[-1]
        head = left.rstrip()[:-1]
        a, b = bare(head).lower(), bare(right).lower()
        if not a or not b or not head[-1].isalnum() or not right[0].isalnum():
            return None
        lex = self.lexicon
        plain, own = a + b, f"{a}-{b}"
        if lex.get(plain, 0) >= lex.get(own, 0) and lex.get(plain, 0) > 0:
            return plain, head + right
        if lex.get(own, 0) > 0:
            return own, f"{head}-{right}"
        if mark == "-" and b in SUSPENDED:
            return None
        for v, text in ((plain, head + right), (own, f"{head}-{right}")):
            if (c := correction(v, lex)) is not None:
                return c, text
        if not right[0].islower():
            return (own, f"{head}-{right}") if mark == "-" and right[0].isupper() else None
        return plain, head + right

    def text(self, text: str) -> tuple[str, list[tuple[str, str]]]:
        """The repaired text and the (kind, item) found in it."""
        items: list[tuple[str, str]] = []
        lines = text.splitlines()
        if len(lines) < 2 or not scanned(text):
            # no wrapped lines, so no furniture to tell from them; words may be misread all the same
            return self._words(text, items), items
        labels = self.model.label(observe(lines))
        paragraphs: list[str] = []
        broken = True
        for line, label in zip(lines, labels):
            x = line.strip()
            if label == HEADER:
                items.append(("running_header", x))
            elif label == NUMBER:
                items.append(("page_number", x))
            elif label == BREAK:
                broken = True
            elif not paragraphs or broken and (_TERMINAL.search(paragraphs[-1]) or _LISTED.match(x)):
                paragraphs.append(x)
                broken = False
            else:
                last, broken = paragraphs[-1], False
                if _LISTED.match(x) or _LISTED.match(last) and _TERMINAL.search(last):
                    paragraphs[-1] = f"{last}\n{x}"
                    continue
                tail = last.rsplit(None, 1)[-1]
                head, _, rest = x.partition(" ")
                if tail[-1] in HYPHENS and len(tail) > 1 and (whole := self.joined(tail, head)):
                    items.append(("hyphenation", whole[0]))
                    paragraphs[-1] = f"{last[: len(last) - len(tail)]}{whole[1]}{' ' + rest if rest else ''}"
                else:
                    paragraphs[-1] = f"{last} {x}"
        return self._words("\n\n".join(paragraphs), items), items

    def _words(self, text: str, items: list[tuple[str, str]]) -> str:
        wrong = {}
        for word in set(text.split()):
            if (form := self.right(word)) is not None:
                wrong[word] = form
                items.append(("misread", form))
        if not wrong:
            return text
        out = []
        for part in re.split(r"(\s+)", text):
            form = wrong.get(part)
            if form is not None:
                core = bare(part)
                shown = form.upper() if core.isupper() and len(core) > 1 else form[0].upper() + form[1:] if core[0].isupper() else form
                part = part.replace(core, shown, 1)
            out.append(part)
        return "".join(out)


class _Asked(dict):
    """An empty lexicon that keeps what is looked up."""

    def get(self, word: str, default: int = 0) -> int:
        self[word] = default
        return default


class _Asking(Repair):
    """Looks up all that mending a text may look up, whatever the lexicon would answer: without answers no way ends early."""

    def __init__(self, model: LineModel):
        super().__init__(model, _Asked())

    def joined(self, left: str, right: str) -> tuple[str, str] | None:
        head, mark = left.rstrip()[:-1], left.rstrip()[-1]
        for whole in (head + right, f"{head}-{right}"):
            self.right(whole)
            correction(bare(whole).lower(), self.lexicon)
        a, b = bare(head).lower(), bare(right).lower()
        for whole in (a + b, f"{a}-{b}"):
            self.lexicon.get(whole)
            correction(whole, self.lexicon)
        self.right(right)
        return super().joined(left, right) if mark in HYPHENS else None


def word_counts(rows: DataFrame) -> DataFrame:
    """(word, n) of all words of all texts (column ``text``) in lower case that come ``LEAST_COUNT`` times at least."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw: Counter = Counter()
        chars = 0

        def send() -> pa.RecordBatch:
            clean: Counter = Counter()
            for w, n in raw.items():
                if b := bare(w):
                    clean[b] += n
            return pa.RecordBatch.from_arrays([pa.array(list(clean)), pa.array(list(clean.values()), pa.int64())], names=["word", "n"])

        for batch in batches:
            for text in batch.column(0).to_pylist():
                raw.update(text.lower().split())
                chars += len(text)
                if len(raw) > 300_000 or chars > 64_000_000:
                    yield send()
                    raw.clear()
                    chars = 0
        if raw:
            yield send()

    return rows.select("text").mapInArrow(count, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST_COUNT)


def line_model(rows: DataFrame) -> LineModel:
    """The model fitted on a bounded sample of texts that may be wrapped (columns ``id``, ``text``), those of the smallest hashes of their ids."""
    # the hash first, so that few texts are tested, and then ids, so that tasks send no texts they aren't asked for
    every, share = rows.count(), 1 << 20
    hashed = rows.withColumn("h", F.pmod(F.xxhash64("id"), F.lit(share)))
    ids: list = []
    for bound in dict.fromkeys((min(share, math.ceil(share * TRAIN_TEXTS * 20 / max(1, every))), share)):
        wrapped = hashed.where((F.col("h") < bound) & F.col("text").rlike(MAYBE_WRAPPED))
        ids = [r.id for r in wrapped.select("id", "h").distinct().orderBy("h", "id").limit(TRAIN_TEXTS).collect()]
        if len(ids) == TRAIN_TEXTS:
            break
    sample = sorted(rows.where(F.col("id").isin(ids)).distinct().collect()) if ids else []
    texts = [r.text for r in sample if _EVIDENCE.search(r.text)]
    return LineModel().fit(texts) if texts else LineModel()


REPAIRED = "id string, text string, items array<struct<kind:string,item:string>>"


def _mended(repair: Repair, ids: pa.Array, texts: list[str]) -> pa.RecordBatch:
    out, items = [], []
    for t in texts:
        mended, found = repair.text(t)
        out.append(mended)
        items.append([{"kind": k, "item": i} for k, i in dict.fromkeys(found)])
    kind = pa.list_(pa.struct([("kind", pa.string()), ("item", pa.string())]))
    return pa.RecordBatch.from_arrays([ids, pa.array(out, pa.string()), pa.array(items, kind)], names=["id", "text", "items"])


def repaired(df: DataFrame, key: str, text: str) -> DataFrame:
    """(id, text, items array<struct<kind, item>>) of every row with an id and a text that isn't blank.

    Kinds: hyphenation, misread, running_header and page_number. Rows delivered
    again stay; an empty table gives an empty result. Whole texts, no shuffle of
    texts while the lexicon fits into ``LEXICON_CHARS`` and is broadcast. Beyond, texts
    go into groups, and each group gets the counts of just the words it may look up; the result is the same.
    """
    rows = df.select(F.col(key).cast("string").alias("id"), F.col(text).cast("string").alias("text")).where(F.col("id").isNotNull() & F.col("text").rlike(r"(?U)\S"))
    model = df.sparkSession.sparkContext.broadcast(line_model(rows))
    counts = materialize(word_counts(rows), "words")
    size = counts.agg(F.sum(F.length("word") + 1).alias("chars")).first().chars or 0
    if size > LEXICON_CHARS:
        return _by_groups(rows, counts, model)
    lexicon = df.sparkSession.sparkContext.broadcast({r.word: r.n for r in counts.collect()})  # LEXICON_CHARS at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        repair = Repair(model.value, lexicon.value)
        for batch in batches:
            yield _mended(repair, batch.column(0), batch.column(1).to_pylist())

    return rows.mapInArrow(run, REPAIRED)


def _by_groups(rows: DataFrame, counts: DataFrame, model) -> DataFrame:
    chars = rows.agg(F.sum(F.length("text")).alias("n")).first().n or 0
    # by id and text, so that neither an id nor a source makes a group large
    grouped = rows.withColumn("g", F.pmod(F.xxhash64("id", "text", F.monotonically_increasing_id()), F.lit(chars // GROUP_CHARS + 1)))
    grouped = materialize(grouped, "texts")

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            asked: dict[int, dict] = {}
            asking = _Asking(model.value)
            for g, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                asking.lexicon = asked.setdefault(g, _Asked())
                asking.memo.clear()
                asking.text(t)
            pairs = [(g, w) for g, ws in asked.items() for w in ws]
            if pairs:
                a, b = zip(*pairs)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.string())], names=["g", "word"])

    own = grouped.select("g", "text").mapInArrow(ask, "g bigint, word string").distinct().join(counts, "word").select("g", "word", "n")

    def run(key: tuple, texts: pa.Table, words: pa.Table) -> pa.Table:
        repair = Repair(model.value, dict(zip(words.column("word").to_pylist(), words.column("n").to_pylist())))
        return pa.Table.from_batches([_mended(repair, texts.column("id").combine_chunks(), texts.column("text").to_pylist())])

    return grouped.groupBy("g").cogroup(own.groupBy("g")).applyInArrow(run, REPAIRED)


def found(chunks: DataFrame) -> DataFrame:
    """p4: (id, kind, item) of the text and page chunks."""
    rows = chunks.where(F.col("chunk_type").isin("text", "page"))
    return repaired(rows, "id", "text").select("id", F.explode("items").alias("x")).select("id", "x.kind", "x.item").distinct()
