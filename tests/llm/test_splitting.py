import random
import re

import pytest

from lodestrata.llm import splitting as S


def check(text, limit, overlap):
    pieces = S.split_text(text, limit, overlap)
    assert all(end - start <= limit and start <= a < end for start, a, end, _ in pieces)
    assert re.sub(r"\s", "", "".join(text[a:b] for _, a, b, _ in pieces)) == re.sub(r"\s", "", text)
    assert all(x[2] <= y[1] for x, y in zip(pieces, pieces[1:]))
    return pieces


@pytest.mark.parametrize("seed", range(30))
def test_pieces_fit_and_cover(seed):
    rng = random.Random(seed)
    text = "".join(rng.choices(["word ", "a, ", "End. ", "行。", "\n", "</tr>", "\n\n", "é", "x" * 40, " "], k=rng.randrange(0, 400)))
    limit, overlap = rng.randrange(5, 200), rng.randrange(0, 60)
    pieces = check(text, limit, overlap)
    longest = max((len(s.strip()) for s in re.split(r"\n|(?<=</tr>)|(?<=[.!?])(?=\s)|(?<=。)", text)), default=0)
    if len(text.strip()) > limit:
        assert any(p[3] for p in pieces) == (longest > limit)


def test_prefers_strong_ends_and_keeps_overlap():
    text = "One two. " * 10 + "\n\n" + "Three four. " * 10
    pieces = check(text, 120, 20)
    assert text[pieces[1][1] :].startswith("Three")
    assert all(a - s == 20 for s, a, b, f in pieces[1:]) and not any(p[3] for p in pieces)


def test_very_long_without_ends():
    pieces = check("x" * 300_000, 1000, 100)
    assert all(p[3] for p in pieces) and 300 <= len(pieces) <= 700


def test_table(spark):
    rows = [("a", "text", "A b c. " * 30, "p"), ("a", "text", "A b c. " * 30, "p"), ("b", "text", "x" * 300, None), ("c", "text", None, "p"), ("d", "text", "", "p"), ("e", None, "y" * 300, "p"), (None, "text", "z" * 300, "p"), ("f", "text", "short", "q"), ("g", "odd", "y" * 300, "p")]
    df = spark.createDataFrame(rows, "id string, chunk_type string, text string, path string")
    limits = spark.createDataFrame([("text", 100, 10)], "chunk_type string, max_chars int, overlap_chars int")
    assert {tuple(r) for r in S.found(df, limits).collect()} == {("a", "natural"), ("b", "forced")}
    got = S.pieces(df, limits).collect()
    assert {r.id for r in got} == {"a", "b", "e", "f", "g"}
    assert all(len(r.piece) <= 100 for r in got if r.id in "ab") and {r.path for r in got if r.id == "f"} == {"q"}
    assert S.found(df.limit(0), limits).count() == 0
