"""Ranked search against scores computed document by document."""

import math
import random
import re

import numpy as np
import pytest

from timberline.llm import lexical
from tests.llm.test_pairs import frame

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def cut(text):
    return TERM.findall(re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))


def plain(rows, queries, k):
    docs = [(i, cut(t)) for i, t in rows]
    n_docs, length = sum(bool(t) for _, t in docs), sum(len(t) for _, t in docs)
    df = {}
    for _, t in docs:
        for w in set(t):
            df[w] = df.get(w, 0) + 1
    asked = {}
    for q, t in queries:
        if q is not None:
            asked.setdefault(q, set()).update(cut(t))
    out = []
    for q, words in asked.items():
        scored = []
        for i, t in docs:
            if i is None:
                continue
            m = 50 + (50 * len(t) * n_docs) // max(length, 1)
            score = 0
            for w in words & set(t):
                tf = t.count(w)
                score += math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[w] + 1))) * ((10**9 * tf) // (1000 * tf + 20 * m))
            if score > 0:
                scored.append((-score, i))
        out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(sorted(scored)[:k])]
    return sorted(out)


def texts(n=160):
    rng = random.Random(4)
    vocabulary = [f"W{k}" for k in range(80)] + ["Émile", "straße", "日本語", "don't", "x-y", "a\x7fb"]
    rows = [(k, " ".join(rng.choices(vocabulary, k=rng.randint(1, 60)))) for k in range(n)]
    rows += [(900, None), (901, ""), (902, " .,-"), (None, rows[0][1]), (3, rows[3][1]), (4, "w1 w1 w1"), (903, " ".join(vocabulary * 400)), (-5, "w2 w3")]
    queries = [(q, " ".join(rng.choices(vocabulary, k=rng.randint(1, 8)))) for q in range(25)] + [(50, None), (51, "nowhere at all"), (None, "w1"), (7, "w5 w6"), (52, "日本語")]
    return rows, queries


def asked(spark, queries):
    return spark.createDataFrame(queries, "item_id long, text string")


@pytest.mark.parametrize("options", [{}, {"window": 7, "shard": 40, "k": 5}, {"sent": 0, "shard": 50, "block": 20, "window": 64}, {"block": 9, "k": 1}])
def test_ranks_by_brute_force(spark, options):
    rows, queries = texts()
    got = lexical.rank(frame(spark, rows).withColumnRenamed("fp", "score").repartition(3), asked(spark, queries), **options).collect()
    assert sorted(map(tuple, got)) == plain(rows, queries, options.get("k", 50))


def test_ties_go_to_the_smaller_id_and_copies_are_all_ranked(spark):
    rows = [(k, "alpha beta") for k in range(300, 0, -1)] + [(k, "gamma") for k in range(1000, 1400)] + [(17, "alpha beta")] * 3
    got = lexical.rank(frame(spark, rows), asked(spark, [(1, "Alpha")]), shard=64, window=16).collect()
    assert sorted(map(tuple, got)) == plain(rows, [(1, "Alpha")], 50)
    assert [r.doc_id for r in sorted(got, key=lambda r: r.rank)][:18] == list(range(1, 18)) + [17]


def test_empty_tables(spark):
    assert lexical.rank(frame(spark, []), asked(spark, [(1, "a")])).count() == 0
    assert lexical.rank(frame(spark, [(1, "a b")]), asked(spark, [])).count() == 0
    # a term of every document has weight 0
    assert lexical.rank(frame(spark, [(k, "a") for k in range(1500)]), asked(spark, [(1, "a")])).collect() == []


def test_windows_mark_and_harvest_what_they_touch():
    rng = np.random.default_rng(3)
    t, p = np.nonzero(rng.random((6, 500)) < 0.2)
    parts = rng.integers(1, 99, len(t))
    ids = np.sort(rng.choice(10**9, 500, replace=False))
    queries = [(1, np.array([0, 3, 5]), np.array([7, 1, 2])), (2, np.array([4]), np.array([1])), (3, np.array([99]), np.array([1]))]
    got = lexical.search(lexical.Postings(t, p, parts), ids, queries, 9, 64)
    for q, names, weights in queries:
        total = np.zeros(500, int)
        for name, w in zip(names, weights):
            np.add.at(total, p[t == name], w * parts[t == name])
        want = sorted(((int(s), -int(i)) for s, i in zip(total, ids) if s), reverse=True)[:9]
        assert sorted(got[q].kept, reverse=True) == want


def test_heap_keeps_the_best_in_any_order():
    rng = random.Random(8)
    pairs = [(k, rng.randint(1, 20)) for k in range(400)]
    want = sorted(((s, -i) for i, s in pairs), reverse=True)[:10]
    for seed in range(5):
        random.Random(seed).shuffle(pairs)
        heap = lexical.Heap(10)
        for at in range(0, 400, 37):
            part = pairs[at : at + 37]
            heap.offer(np.array([i for i, _ in part]), np.array([s for _, s in part]))
        assert sorted(heap.kept, reverse=True) == want
