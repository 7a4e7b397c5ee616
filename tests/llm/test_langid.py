import random

import pytest

from lodestrata.llm import langid as L

WORDS = {
    "en": "the report shows that every measurement was checked before which budget would have been approved with further notice through their office should always because another thing",
    "de": "der Bericht zeigt dass jede Messung geprüft wurde bevor das Angebot genehmigt werden konnte ohne weitere Hinweise durch ihre Abteilung sollte immer weil nichts anderes möglich",
    "es": "el informe muestra que cada medición fue revisada antes del presupuesto aprobado sin ningún otro aviso desde nuestra oficina porque siempre también debería quedar mucho más",
    "pt": "o relatório mostra que cada medição foi verificada antes do orçamento aprovado sem nenhum outro aviso pela nossa equipe porque sempre também deveria não ficou muito mais então",
    "zh": "报告显示 每次测量 都经过检查 因此预算 可以获得批准 没有进一步 通知我们 的办公室 应当始终 说明其他 事情尚未 完成审核",
}


def say(rng, lang):
    if lang == "zh":
        return "".join(rng.choice(WORDS["zh"].split()) for _ in range(rng.randrange(5, 8))) + "。"
    ws = WORDS[lang].split()
    return " ".join(rng.choice(ws) for _ in range(rng.randrange(12, 20))).capitalize() + ". "


@pytest.fixture(scope="module")
def filters():
    rng = random.Random(1)
    rows = []
    for lang in WORDS:
        for k in range(120):
            label = rng.choice(list(WORDS)) if k % 8 == 0 else lang  # wrong labels among them
            rows.append((label, "".join(say(rng, lang) for _ in range(4))))
    rows += [("ja", "".join(say(rng, lang) for _ in range(4))) for lang in WORDS for _ in range(4)]
    return L.fit(rows)


def test_wrong_labels_and_unreal_languages_do_not_matter(filters):
    assert filters.languages == sorted(WORDS)


def test_held_out_texts_and_mixtures(filters):
    rng = random.Random(2)
    good = 0
    for _ in range(200):
        langs = rng.sample(list(WORDS), rng.choice([1, 1, 2, 3]))
        text = "".join(say(rng, x) + say(rng, x) for x in langs)
        segments = L.label(filters, [text], False)[0]
        good += [s[2] for s in segments] == langs
        assert segments[0][0] == 0 and segments[-1][1] == len(text) and all(a[1] == b[0] for a, b in zip(segments, segments[1:]))
        assert all(0 <= s[3] <= 1 for s in segments)
    assert good >= 190


def test_counts_correct_false_positives(filters):
    import numpy as np

    noise = np.random.default_rng(3).integers(0x4E00, 0x9000, 5000).astype(np.uint32)
    hits, total = filters.count(noise, np.zeros(1, np.int64))
    assert (hits < 0.1 * total).all()


def test_titles(filters):
    assert L.title_text("Der_Bericht_zeigt – The report shows.PDF").split("\n") == ["Der Bericht zeigt", "The report shows"]
    seg = L.label(filters, [L.title_text("Der Bericht zeigt jede Messung (The report shows every measurement).pdf"), L.title_text("KX-4711_rev3.pdf")], True)
    assert {s[2] for s in seg[0]} == {"de", "en"} and [s[2] for s in seg[1]] == [None]


def test_table(spark, filters):
    rng = random.Random(4)
    text = {x: "".join(say(rng, x) for _ in range(5)) for x in WORDS}
    rows = [(f"{x}{k}", "text", "".join(say(rng, x) for _ in range(5)), {"en": "en_GB", "de": "German", "es": "spa", "pt": "PT", "zh": "zh-Hans"}[x]) for x in WORDS for k in range(40)]
    rows += [("none", "text", text["de"], None), ("odd", "page", text["en"], "n/a"), ("wrong", "text", text["pt"], "de-DE"), ("mixed", "text", text["es"] + text["zh"], "es"), ("mixed", "text", text["es"] + text["zh"], "es")]
    rows += [("null", "text", None, None), ("empty", "text", "", "en"), ("codes", "text", "123 456 / 7", None), ("pic", "image", text["de"], "en"), (None, "text", text["en"], None), ("long", "text", text["de"] * 300, "en")]
    chunks = spark.createDataFrame([(*r, "x", 1) for r in rows], "id string, chunk_type string, text string, lang string, declared string, title int")
    titles = spark.createDataFrame([("d1", "the report shows that every measurement was checked.pdf", "zh"), ("d2", None, "en")], "document_id string, title string, lang string")
    got = {tuple(r) for r in L.found(chunks, titles).collect()}
    assert got == {("job_chunks", "none", "de"), ("job_chunks", "odd", "en"), ("job_chunks", "wrong", "pt"), ("job_chunks", "mixed", "es"), ("job_chunks", "mixed", "zh"), ("job_chunks", "long", "de"), ("demo_documents", "d1", "en")}
    assert L.found(chunks.limit(0), titles.limit(0)).count() == 0


def corpus(rng, size, decoy):
    """Texts of all languages, skewed, and a label that only ever stands on Chinese ones."""
    rows = [(x, "".join(say(rng, x) for _ in range(4))) for x, n in zip(WORDS, (8, 4, 2, 2, 3)) for _ in range(n * size)]
    return rows + [("ja", "".join(say(rng, "zh") for _ in range(4))) for _ in range(decoy)]


def found_share(filters):
    rng = random.Random(9)
    texts = [(x, "".join(say(rng, x) for _ in range(4))) for x in WORDS for _ in range(60)]
    got = [L.label(filters, [t], False)[0] for _, t in texts]
    return sum([s[2] for s in g] == [x] for g, (x, _) in zip(got, texts)) / len(texts)


def test_a_label_as_large_in_the_sample_as_the_language_it_stands_on():
    rng = random.Random(7)
    rows = corpus(rng, 40, 120)  # as many texts as zh has
    filters = L.fit(rows, {"en": 80_000, "de": 40_000, "es": 20_000, "pt": 20_000, "zh": 30_000, "ja": 900})
    assert filters.languages == sorted(WORDS)
    assert found_share(filters) >= 0.98


def test_same_recall_at_two_sizes():
    small, large = L.fit(corpus(random.Random(5), 8, 2)), L.fit(corpus(random.Random(6), 80, 20))
    assert small.languages == large.languages == sorted(WORDS)
    assert min(found_share(small), found_share(large)) >= 0.95


def test_result_does_not_depend_on_neighbours(filters, monkeypatch):
    monkeypatch.setattr(L, "LONGEST", 150)
    rng = random.Random(8)
    texts = ["".join(say(rng, rng.choice(list(WORDS))) for _ in range(rng.randrange(1, 9))).replace(". ", " ") for _ in range(60)]
    assert L.label(filters, texts, False) == [L.label(filters, [t], False)[0] for t in texts]


def test_short_sentences_and_characters_beyond_the_basic_plane(filters):
    text = say(random.Random(3), "de") * 3 + "The report shows their office. " + "\U00020000\U0001f600 " + say(random.Random(4), "de") * 3 + "İ"
    segments = L.label(filters, [text], False)[0]
    assert [s[2] for s in segments] == ["de", "en", "de"] and segments[-1][1] == len(text)
    assert text[segments[1][0] : segments[1][1]].strip().startswith("The report")


def test_more_languages_than_a_table_holds():
    rng = random.Random(11)
    names = [a + b for a in "abcdef" for b in "xyz"] + ["qq", "rr", "ss"]
    words = {x: ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(6)) for _ in range(30)] for x in names}
    make = lambda x: " ".join(rng.choice(words[x]) for _ in range(40)) + "."
    filters = L.fit([(x, make(x)) for x in names for _ in range(12)])
    assert filters.languages == sorted(names)
    assert all(L.label(filters, [make(x)], False)[0][0][2] == x for x in names)


def test_notations(spark):
    told = ["en_GB", "German", "deutsch", "fra", "fre", "中文", "xx", "Elvish", "", None, " NL ", "ita", "Japanisch"]
    got = L.with_declared(spark.createDataFrame([(x,) for x in told], "lang string"))
    assert {r.lang: r.declared for r in got.collect()} == dict(zip(told, ["en", "de", "de", "fr", "fr", "zh", None, None, None, None, "nl", "it", "ja"]))
