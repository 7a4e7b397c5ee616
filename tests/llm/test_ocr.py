import random
import textwrap

import pytest

from lodestrata.llm import ocr

WORDS = "measurement framework contract describes hydraulic pressure register quarterly forecast published revision committee conveyor superseded although whenever documents audit budget station without further notice".split()
LEXICON = {w: 900 for w in WORDS} | {"pre": 40, "post-shift": 30, "write-down": 50, "and": 900, "margin": 500, "the": 4000, "a": 2000, "2019": 50}


def prose(rng, n):
    out = []
    for _ in range(n):
        s = " ".join(rng.choices(WORDS, k=rng.randrange(6, 14)))
        out.append(s[0].upper() + s[1:] + ".")
    return " ".join(out)


def scanned(rng):
    """A wrapped text with furniture, its plain paragraphs and what was put in."""
    paragraphs, lines, items = [prose(rng, rng.randrange(3, 7)) for _ in range(2)], [], []
    for p in paragraphs:
        body = textwrap.wrap(p, 64, break_long_words=False)
        for k, line in enumerate(body):
            if k + 1 < len(body) and rng.random() < 0.3:
                word = body[k + 1].split(" ", 1)[0]
                if len(word) > 7 and word.isalpha() and " " in body[k + 1]:
                    line, body[k + 1] = f"{line} {word[:4]}-", word[4:] + body[k + 1][len(word) :]
                    items.append(("hyphenation", word.lower()))
            lines.append(line)
        lines.append("")
    for _ in range(2):
        at = rng.randrange(1, len(lines) - 1)
        if rng.random() < 0.5:
            kind, line = "page_number", rng.choice(["[12]", "- 7 -", "Page 3 / 40", "19."])
        else:
            kind, line = "running_header", rng.choice(["NORDAM GROUP — REPORT ON THE AUDIT 12", "Velwick Works | Notes on the conveyor", "Halby Labs: Review of the Forecast  31"])
        lines.insert(at, line)
        items.append((kind, line))
    return "\n".join(lines).strip(), paragraphs, items


def test_labels_and_reassembly_on_held_out_texts():
    rng = random.Random(2)
    model = ocr.LineModel().fit([scanned(rng)[0] for _ in range(150)])
    hit = made = due = whole = 0
    for _ in range(150):
        text, paragraphs, items = scanned(rng)
        mended, found = ocr.Repair(model, LEXICON).text(text)
        hit += len(set(found) & set(items))
        made, due = made + len(set(found)), due + len(set(items))
        whole += mended == "\n\n".join(paragraphs)
    assert hit >= 0.95 * due and hit >= 0.95 * made and whole >= 120


@pytest.mark.parametrize(
    ("word", "form"),
    [("cornmittee", "committee"), ("Audlt", "audit"), ("forecost", "forecast"), ("5tation", "station"), ("registcr", "register"), ("2O19", "2019"), ("1l0", "110"), ("TM-2O7", "tm-207"), ("mar9in", "margin"), ("measiirement", "measurement")],
)
def test_misread_words(word, form):
    assert ocr.correction(word, LEXICON) == form


@pytest.mark.parametrize("word", ["committee", "Unknownword", "2019", "TM-2370", "h2o", "24h", "", "a", "中文9字", "x" * 5000])
def test_sound_words(word):
    assert ocr.correction(word, LEXICON) is None


def test_torn_words_and_hyphens_of_their_own():
    r = ocr.Repair(ocr.LineModel(), LEXICON)
    text = "The audit describes the write-\ndown without pre-\nand post-\nshift notice of quarter\xad\nly figures and hydrau- \nlic pressure."
    mended, found = r.text(text)
    assert set(found) == {("hyphenation", "write-down"), ("hyphenation", "post-shift"), ("hyphenation", "quarterly"), ("hyphenation", "hydraulic")}
    assert mended == "The audit describes the write-down without pre- and post-shift notice of quarterly figures and hydraulic pressure."


def test_table(spark):
    rng = random.Random(3)
    text, _, items = scanned(rng)
    rows = [(f"r{k}", "text", scanned(rng)[0], "x") for k in range(60)] + [("a", "page", text, "x"), ("a", "page", text, "x"), ("n", "text", None, "x"), ("e", "text", " ", "x"), (None, "text", text, "x"), ("t", "table", text, "x"), ("l", "text", "audit " * 200_000, "x")]
    df = spark.createDataFrame(rows, "id string, chunk_type string, text string, kind string")
    got = [tuple(r) for r in ocr.found(df).collect()]
    assert len(got) == len(set(got)) and {r[0] for r in got} <= {f"r{k}" for k in range(60)} | {"a"}
    assert {r[1:] for r in got if r[0] == "a"} == set(items)
    assert ocr.found(df.limit(0)).count() == 0
