import random

import pytest

from lodestrata.llm import ocr
from tests.llm.test_ocr import WORDS, scanned


@pytest.mark.parametrize(
    ("text", "items"),
    [
        ("The new rules for the control\n— 28 —\n\ngroup were published in the last week of the year.", {("page_number", "— 28 —")}),
        ("The rules for the whole group were publis-\n— 31 —\n hed in the last week of the year.", {("page_number", "— 31 —"), ("hyphenation", "published")}),
        ("The rules for the whole group were publis-  \n\n  hed in the last week of the year.", {("hyphenation", "published")}),
    ],
)
def test_wraps_that_furniture_or_blanks_interrupt(text, items):
    lexicon = dict.fromkeys("the new rules for control group were published in last week of year whole".split(), 100)
    assert set(ocr.Repair(ocr.LineModel(), lexicon).text(text)[1]) == items


def test_plain_lists_are_left_alone():
    text = "- The first item is short.\n- The second item is longer.\n- The third one ends it."
    assert ocr.Repair(ocr.LineModel(), {}).text(text) == (text, [])


def test_lexicon_by_groups_gives_the_same(spark, monkeypatch):
    rng = random.Random(5)
    rows = []
    for k in range(80):
        text = scanned(rng)[0]
        for _ in range(3):
            w = rng.choice(WORDS)
            text = text.replace(w, w.replace("e", "c", 1).replace("rn", "m"), 1)
        rows.append((f"r{k}", "text", text))
    rows += [("r1", "text", rows[1][2])] * 5 + [("long", "page", "x" * 200 + " " + "y" * 300), ("b", "text", " ")]
    df = spark.createDataFrame(rows, "id string, chunk_type string, text string")
    whole = sorted(map(str, ocr.repaired(df, "id", "text").collect()))
    monkeypatch.setattr(ocr, "LEXICON_CHARS", 0)
    monkeypatch.setattr(ocr, "GROUP_CHARS", 20_000)
    assert sorted(map(str, ocr.repaired(df, "id", "text").collect())) == whole and "misread" in str(whole) and "hyphenation" in str(whole)
    assert ocr.repaired(df.limit(0), "id", "text").count() == 0


def test_training_texts_are_those_of_the_smallest_hashes(spark, monkeypatch):
    monkeypatch.setattr(ocr, "TRAIN_TEXTS", 2)
    rng = random.Random(6)
    df = spark.createDataFrame([(f"r{k}", scanned(rng)[0] if k % 3 else "plain") for k in range(200)], "id string, text string")
    some = ocr.line_model(df)
    monkeypatch.setattr(ocr, "MAYBE_WRAPPED", r"(?s)" + ocr.MAYBE_WRAPPED)
    assert some.move == ocr.line_model(df).move
