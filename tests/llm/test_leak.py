import random

import numpy as np
import pytest

from lodestrata.llm import leak


def brute(docs, items, w):
    runs = {}
    for i, t in items:
        ws = leak.words_of(t)
        for k in range(len(ws) - w + 1):
            runs.setdefault(tuple(ws[k : k + w]), set()).add(i)
    out = set()
    for d, t in docs:
        ws = leak.words_of(t)
        for k in range(len(ws) - w + 1):
            out |= {(d, i) for i in runs.get(tuple(ws[k : k + w]), ())}
    return out


def corpus(seed):
    rng = random.Random(seed)
    vocab = [f"w{k}" for k in range(40)] + ["Été", "中文", "x_y", "ABC"]
    say = lambda n: " ".join(rng.choice(vocab) + rng.choice(["", ",", " -", "\n"]) for _ in range(n))
    items = [(i, say(rng.randrange(5, 60))) for i in range(30)] + [(99, None), (98, "")]
    docs = []
    for d in range(150):
        t = say(rng.randrange(0, 80))
        if d % 2:
            src = items[rng.randrange(30)][1].split()
            k = rng.randrange(4, 25)
            at = rng.randrange(max(1, len(src) - k))
            t += " " + " (".join(src[at : at + k]).upper() + " " + say(10)
        docs.append((d, t))
    return docs + [(1000, None), (1001, ""), docs[1], (1002, items[0][1] * 3000)], items


def test_same_pairs_as_comparing_all_runs(spark, monkeypatch):
    docs, items = corpus(5)
    d = spark.createDataFrame([(a, b, "x") for a, b in docs], "doc_id bigint, text string, item string")
    i = spark.createDataFrame(items, "item_id bigint, text string")
    want = brute(docs, items, 12)
    assert len(want) > 20
    assert {tuple(r) for r in leak.found(d, i).collect()} == want
    monkeypatch.setattr(leak, "BLOCK_CHARS", 900)  # several blocks of items
    assert {tuple(r) for r in leak.found(d, i).collect()} == want
    assert leak.found(d.limit(0), i).count() == 0 and leak.found(d, i.limit(0)).count() == 0


@pytest.mark.parametrize("n", [1, 2, 5, 8, 11, 16])
def test_simhash_is_the_majority_of_each_bit(n):
    h = np.random.default_rng(n).integers(0, 2**63, 60, np.uint64)
    bits = (h[:, None] >> np.arange(64, dtype=np.uint64)) & np.uint64(1)
    want = [sum(int(bits[i : i + n, b].sum() > n // 2) << b for b in range(64)) for i in range(60 - n + 1)]
    assert leak.simhash(h, n).tolist() == want


@pytest.mark.parametrize("radius", [0, 1, 3, 6])
def test_blocks_find_all_within_the_radius(radius):
    rng = random.Random(radius)
    index = leak.ItemIndex([(1, " ".join(f"a{rng.randrange(50)}" for _ in range(300)))], 12, radius)
    flips = [int(p) ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(0, 9))) for p in index.prints]
    prints = np.array(flips, np.uint64)
    at, item = index.near(prints)
    want = {(a, b) for a in range(len(prints)) for b in range(len(index.prints)) if int(prints[a] ^ index.prints[b]).bit_count() <= radius}
    assert set(zip(at.tolist(), item.tolist())) == want


def test_similar_runs_below_full_similarity(spark):
    words = [f"t{k}" for k in range(40)]
    changed = words[:20] + ["other"] + words[21:]
    docs = spark.createDataFrame([(1, " ".join(changed)), (2, "nothing like it at all in these twelve words or some few more here")], "d bigint, t string")
    items = spark.createDataFrame([(7, " ".join(words))], "i bigint, t string")
    got = leak.leaks(docs, "d", "t", items, "i", "t", window=30, radius=16, least=0.8).collect()
    assert [(r.doc, r.item) for r in got] == [(1, 7)] and 0.8 <= got[0].similarity < 1


def test_rows_come_from_verified_similarity(spark, monkeypatch):
    docs, items = corpus(6)
    keys, lists = [d for d, t in docs if t], [leak.words_of(t) for _, t in docs if t]
    indexes = leak.item_indexes(items, 12, 3)
    assert [x.window for x in indexes][:3] == [12, 23, 45] and sum(len(x.ids) for x in indexes[1:]) == sum(len(leak.words_of(t)) > 22 for _, t in items)
    search = lambda: {(d, i) for d, i, _, n in leak._search(indexes, leak._Hashes(), keys, lists, 0.8) if n >= 12}
    assert search() == brute(docs, items, 12)  # all pairs of the exact join
    monkeypatch.setattr(leak.ItemIndex, "similarity", lambda *a: 0.0)
    assert search() == set()


def test_full_buckets_are_expanded_in_parts(monkeypatch):
    phrase = " ".join(f"s{k}" for k in range(12))
    index = leak.ItemIndex([(k, phrase) for k in range(300)], 12, 3)
    want = index.near(np.repeat(index.prints[:1], 50))
    monkeypatch.setattr(leak, "EXPANDED", 100)
    got = index.near(np.repeat(index.prints[:1], 50))
    assert len(want[0]) == 15_000 and all((a == b).all() for a, b in zip(want, got))


def test_items_that_leak_as_a_whole_with_changes(spark):
    words = [f"t{k}" for k in range(60)]
    changed = [w if k % 11 else f"other{k}" for k, w in enumerate(words)]  # never twelve in a row
    docs = spark.createDataFrame([(1, " ".join(changed))], "d bigint, t string")
    items = spark.createDataFrame([(7, " ".join(words))], "i bigint, t string")
    got = leak.leaks(docs, "d", "t", items, "i", "t", radius=16, least=0.6).collect()
    assert [(r.doc, r.item) for r in got] == [(1, 7)] and got[0].words < 12 and 0.6 <= got[0].similarity < 1


@pytest.mark.parametrize("n", [3, 11])
def test_doubled_windows(n):
    h = np.random.default_rng(n).integers(0, 2**63, 100, np.uint64)
    two = leak.doubled(leak.counters(h, n), n)
    assert leak.majority(two, 2 * n).tolist() == leak.simhash(h, 2 * n).tolist()
    assert leak.majority(leak.doubled(two, 2 * n), 4 * n).tolist() == leak.simhash(h, 4 * n).tolist()
