import random

from lodestrata.llm import spam

NOUNS = [f"{a} {b}" for a in "soil feed cash water tender lease spare noise intake audit control flow stock".split() for b in "survey conveyor position permit file duty rotor valve plan cabinet index".split()]
VERBS = "extends limits covers delays replaces explains describes weakens confirms precedes matches supports offsets revealed".split()
TAILS = [f"{a} {b}" for a in ["before", "without", "in line with", "despite", "because of", "until"] for b in ["the final figures", "any prior warning", "two earlier complaints", "a revised rule", "most observers", "the night shift"]]


def sentence(rng):
    return f"In {rng.choice(['May', 'June', 'July'])} {rng.randrange(2000, 2030)}, the {rng.choice(NOUNS)} {rng.choice(VERBS)} the {rng.choice(NOUNS)} {rng.choice(TAILS)}."


def page(rng, bait):
    if bait:
        kind = rng.randrange(4)
        if kind == 0:
            return "\n".join(f"- [{rng.choice(NOUNS)}](https://{rng.randrange(9999)}.test/x-{rng.randrange(99)})" for _ in range(30))
        if kind == 1:
            return " ".join("#" + rng.choice(NOUNS).title().replace(" ", "") for _ in range(60))
        if kind == 2:
            noun = rng.choice(NOUNS)
            return sentence(rng) + "\n\n" + " ".join(f"{rng.choice(['buy', 'cheap', 'best', 'sale'])} {noun}" for _ in range(80))
        return " · ".join(rng.choice(NOUNS) for _ in range(60))
    kind = rng.randrange(4)
    prose = " ".join(sentence(rng) for _ in range(rng.randrange(3, 12)))
    if kind == 0:
        return prose + "\n\n" + "\n".join(f"[{k}] Labs, {rng.choice(NOUNS)}, 2001. https://a{k}.example/b" for k in range(1, 6))
    if kind == 1:
        return "\n".join(f"- **{rng.choice(NOUNS)}**: {sentence(rng)}" for _ in range(8))
    if kind == 2:
        return "\n".join(f"{k}.1 Notes on the {rng.choice(NOUNS)} {'.' * 20} {k * 7}" for k in range(1, 30))
    return prose + "\n\n| code | qty |\n|---|---|\n" + "\n".join(f"| A-{k} | {k * 3} |" for k in range(9)) + "\n\n" + prose


def test_held_out_accuracy(spark):
    rng = random.Random(4)
    rows = [(k, page(rng, k % 5 == 0), "bait.test" if k % 5 == 0 and k % 2 else f"h{k % 7}") for k in range(600)]
    rows += [(1000, None, "h1"), (1001, "", "h1"), (1002, " \n", None), (1003, "word " * 100_000, None), (1004, sentence(rng) * 40, None), rows[1]]
    df = spark.createDataFrame([(a, b, c, 1.0, "x") for a, b, c in rows], "doc_id bigint, text string, source string, p double, host string")
    got = [r.doc_id for r in spam.found(df).collect()]
    truth = {k for k in range(600) if k % 5 == 0} | {1003}
    assert len(got) == len(set(got))
    assert len(set(got) & truth) >= 0.97 * len(truth) and len(set(got) - truth - {1004}) <= 3


def test_one_kind_only_and_empty(spark):
    rng = random.Random(5)
    df = spark.createDataFrame([(k, page(rng, False), "h") for k in range(8)], "doc_id bigint, text string, source string")
    assert spam.found(df).count() == 0 and spam.found(df.limit(0)).count() == 0
