import random

from lodestrata.operators import lexical as L


def corpus(spark, n=700):
    rng = random.Random(8)
    words = [f"w{k}" for k in range(40)]
    rows = [(f"c{k}", f"r{k % 7}", f"part {rng.choice(words)} / {rng.choice(words)} {k // 2}", " ".join(rng.choices(words, weights=range(1, 41), k=rng.randrange(1, 9)))) for k in range(n)]
    return spark.createDataFrame(rows, "id string, job_result_id string, path string, text string")


def test_index_gathers_only_what_queries_ask_for(spark, monkeypatch):
    """No postings are written, means by revision are those of all postings, and the k best those of all ranks."""
    written, keep = [], L.materialize
    monkeypatch.setattr(L, "materialize", lambda df, label="step": written.append(label) or keep(df, label))
    monkeypatch.setattr(L, "HOT_UNITS", 60)
    chunks = corpus(spark)
    index = L.build_index(chunks)
    assert "postings" not in written and "tokens" in written
    posted = L.postings(chunks)
    want = {r.channel: round(r.avg_idf, 9) for r in L.average_idf(L.map_units(chunks), posted).collect()}
    assert {r.channel: round(r.avg_idf, 9) for r in index.stats.collect()} == want
    asked = spark.createDataFrame([(k, f"part w{k} w{39 - k} and w7?") for k in range(12)], "query_id bigint, query string")
    tokens = L.query_tokens(asked)
    full = {tuple(r) for r in L.top_units(L.fuse(L.score(tokens, index)), 3).select("query_id", "rank", "unit_id", "lex").collect()}
    assert {tuple(r) for r in L.discover(index, asked, 3).select("query_id", "rank", "unit_id", "lex").collect()} == full
    monkeypatch.setattr(L, "QUERY_ROWS", 20)
    assert {tuple(r) for r in L.discover(index, asked, 3).select("query_id", "rank", "unit_id", "lex").collect()} == full
