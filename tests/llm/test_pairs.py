"""Operators that compare documents or vectors with each other."""

import hashlib
import random
import re

import numpy as np
import pytest

from timberline.llm import decontam, phrases, simhash, topk

DOCS = "doc_id long, text string, fp string, component_id int, n_words int"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "x", 0, 0) for i, t in rows], DOCS)


def components(ids, linked):
    parent = list(range(len(ids)))

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for i, j in linked:
        parent[find(i)] = find(j)
    groups = {}
    for k, i in enumerate(ids):
        groups.setdefault(find(k), []).append(i)
    return [min((i for i in groups[find(k)] if i is not None), default=None) for k in range(len(ids))]


def plain_fingerprint(text):
    import xxhash

    words = [w for w in re.split("[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or "")) if w]
    if not words:
        return 0
    k = min(3, len(words))
    h = [xxhash.xxh64_intdigest(" ".join(words[i : i + k]).encode(), 42) for i in range(len(words) - k + 1)]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def near_copies(n=120):
    rng, rows = random.Random(5), []
    vocabulary = [f"w{k}" for k in range(500)]
    base = [rng.choices(vocabulary, k=rng.randint(60, 200)) for _ in range(12)]
    for k in range(n):
        words = list(rng.choice(base))
        for _ in range(rng.randint(0, 3)):
            words[rng.randrange(len(words))] = rng.choice(vocabulary)
        rows.append((k, " ".join(words)))
    return rows + [(900, None), (901, ""), (None, rows[0][1]), (902, "A"), (903, "a"), (3, rows[3][1])]


@pytest.mark.parametrize("crowded", [128, 1])
def test_simhash_components_by_brute_force(spark, crowded):
    rows = near_copies()
    got = simhash.near_duplicates(frame(spark, rows), max_bucket=crowded).collect()
    fp = [plain_fingerprint(t) for _, t in rows]
    links = [(i, j) for i in range(len(rows)) for j in range(i) if (fp[i] ^ fp[j]).bit_count() <= 3]
    want = sorted((str(i), f"{f:016x}", c) for (i, _), f, c in zip(rows, fp, components([i for i, _ in rows], links)))
    assert sorted((str(r.doc_id), r.fingerprint, r.component_id) for r in got) == want


def test_points_link_all_and_only_close_fingerprints(spark):
    rng = random.Random(8)
    fps = sorted({rng.getrandbits(6) << 20 | rng.getrandbits(3) for _ in range(120)} | {rng.getrandbits(64) for _ in range(30)})
    df = spark.createDataFrame([(f - (1 << 64) if f >> 63 else f, k) for k, f in enumerate(fps)], "fp long, rep long")
    for bits in (0, 1, 2, 3):
        edges = [(r.src, r.dst) for r in simhash.links(df, bits, max_bucket=1).collect()]
        assert all((fps[a] ^ fps[b]).bit_count() <= bits for a, b in edges)
        every = [(i, j) for i in range(len(fps)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= bits]
        assert components(list(range(len(fps))), edges) == components(list(range(len(fps))), every)


def test_simhash_keeps_one_and_takes_empty_tables(spark):
    df = frame(spark, near_copies())
    kept = simhash.keep_one(df)
    assert kept.columns == df.columns and {r.doc_id for r in kept.collect()} >= {None, 902}
    assert simhash.near_duplicates(df.limit(0)).count() == 0


def plain_contamination(docs, items, window=10):
    split = lambda t: re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m.group().lower(), t or ""))
    known = {}
    for name, text in items:
        w = split(text)
        n = min(window, len(w))
        for j in range(len(w) - n + 1 if n else 0):
            known.setdefault(tuple(w[j : j + n]), set()).add(name)
    out = []
    for i, text in docs:
        w, hit, found = split(text), set(), set()
        for n in {len(k) for k in known}:
            for j in range(len(w) - n + 1):
                if tuple(w[j : j + n]) in known:
                    hit.update(range(j, j + n))
                    found |= known[tuple(w[j : j + n])]
        out.append((str(i), len(w), len(hit), sorted(x for x in found if x is not None)))
    return sorted(out)


def test_contamination_by_brute_force(spark):
    rng = random.Random(6)
    items = [(str(k), " ".join(rng.choices("abcdefg", k=rng.choice([0, 1, 3, 9, 10, 25, 40])))) for k in range(25)] + [("x", None), (None, "Zeta eta theta"), ("5", "again a b")]
    items += [("y", " ".join(f"q{k}" for k in range(30)))]
    docs = [(k, rng.choice([" ", ", ", "\n"]).join(rng.choices(["a", "B", "c", "d", "e", "f", "g", "ä", "z"], k=rng.randint(0, 60)))) for k in range(60)]
    docs += [(100, None), (101, ""), (100, "zeta ETA theta"), (102, "-".join(f"Q{k}" for k in range(3, 28))), (103, "a " * 20_000), (None, items[4][1])]
    bench = spark.createDataFrame(items, "item_id string, text string")
    want = plain_contamination(docs, items)
    for size in (1 << 20, 400):
        got = decontam.find_contamination(frame(spark, docs), bench, block_bytes=size).select("doc_id", "n_words", decontam.n_hit().alias("h"), "items", "longest", "longest_item").collect()
        assert sorted((str(r.doc_id), r.n_words, r.h, r.items) for r in got) == want
        assert next((r.longest, r.longest_item) for r in got if r.doc_id == 102) == (25, "y")
    clean = decontam.decontaminate(spark.createDataFrame(docs, "doc_id long, text string"), bench)
    assert sorted(str(r.doc_id) for r in clean.collect()) == [w[0] for w in want if not w[2]]
    none = decontam.find_contamination(frame(spark, docs), bench.limit(0))
    assert none.filter("size(hits) > 0").count() == 0 and decontam.find_contamination(frame(spark, docs).limit(0), bench).count() == 0


def plain_phrases(docs, window=13):
    split = lambda t: [w for w in re.split("[\x20\x09-\x0D]+", t or "") if w]
    key = lambda i: (1 << 63) - 1 if i is None else i
    first = {}
    for i, t in docs:
        w = split(t)
        for j in range(len(w) - window + 1):
            k = tuple(w[j : j + window])
            first[k] = min(first.get(k, 1 << 63), key(i))
    out = []
    for i, t in docs:
        w = split(t)
        gone = [False] * len(w)
        for j in range(len(w) - window + 1):
            if first[tuple(w[j : j + window])] < key(i):
                gone[j : j + window] = [True] * window
        out.append((str(i), len(w), sum(gone), " ".join(x for x, g in zip(w, gone) if not g)))
    return sorted(out)


@pytest.mark.parametrize("window, phrase, vocabulary", [(13, 6, 400), (5, 3, 6), (4, 4, 3)])
def test_phrases_by_brute_force(spark, window, phrase, vocabulary):
    rng = random.Random(window)
    pool = [[f"v{rng.randrange(vocabulary)}" for _ in range(rng.randint(window, 60))] for _ in range(6)]
    docs = []
    for k in range(80):
        words = []
        for _ in range(rng.randint(0, 4)):
            if rng.random() < 0.5:
                p = rng.choice(pool)
                a = rng.randrange(len(p))
                words += p[a : a + rng.randint(1, 40)]
            else:
                words += [f"v{rng.randrange(vocabulary)}" for _ in range(rng.randint(1, 30))]
        docs.append((rng.choice([k, k, k, 7, None]), rng.choice([" ", "\n", "  "]).join(words)))
    docs += [(500, docs[3][1]), (501, docs[3][1]), (502, None), (503, ""), (504, "v1 " * 3000), (505, "v1 " * 40)]
    got = phrases.dedup_phrases(frame(spark, docs), window=window, phrase=phrase).collect()
    assert sorted((str(r.doc_id), r.n_words, r.n_removed, r.kept) for r in got) == plain_phrases(docs, window)
    short = phrases.dedup_phrases(frame(spark, docs), window=window, phrase=phrase, digest=True).collect()
    assert sorted(r.kept_sha256 for r in short) == sorted(hashlib.sha256(r.kept.encode()).hexdigest() for r in got)


def test_phrases_in_small_automata_and_empty(spark, monkeypatch):
    rng = random.Random(9)
    passages = [(k % 4, [b"%d" % rng.randrange(3) for _ in range(rng.randint(5, 12))]) for k in range(12)]
    docs = [(k, [b"%d" % rng.randrange(3) for _ in range(80)]) for k in range(6)]
    for limit, crowd, n in [(1, 16, 5), (20, 16, 5), (1_000_000, 16, 5), (1_000_000, 1, 5), (30, 2, 4), (1_000_000, 0, 4), (1_000_000, 1, 1)]:
        held = [(doc, ws, np.zeros(len(ws), bool)) for doc, ws in docs]
        # one owner a window: the smallest document
        owner = {}
        for low, p in passages:
            for k in range(len(p) - n + 1):
                owner[tuple(p[k : k + n])] = min(low, owner.get(tuple(p[k : k + n]), low))
        cut = [(low, list(w)) for w, low in owner.items()]
        phrases.locate(cut, held, n, limit, crowd)
        for doc, ws, gone in held:
            want = np.zeros(len(ws), bool)
            for low, p in passages:
                for k in range(len(p) - n + 1):
                    for j in range(len(ws) - n + 1):
                        if low < doc and ws[j : j + n] == p[k : k + n]:
                            want[j : j + n] = True
            assert gone.tolist() == want.tolist()
    # where passages stand is known from the automata alone
    rows = [(k, " ".join(f"{k}x{j}" for j in range(k + 3)) + " " + " ".join(f"p{j}" for j in range(20))) for k in range(4)]
    total = lambda: sorted((r.doc_id, r.n_removed) for r in phrases.dedup_phrases(frame(spark, rows)).collect())
    assert total() == [(0, 0), (1, 20), (2, 20), (3, 20)]
    assert phrases.dedup_phrases(frame(spark, [(1, "a")]).limit(0)).count() == 0


@pytest.mark.parametrize("seed, block", [(1, 8192), (2, 40)])
def test_topk_by_brute_force(spark, seed, block):
    rng = np.random.default_rng(seed)
    v = np.round(rng.standard_normal((400, 8)), 2).astype(np.float32)
    v[50:200] = v[50]  # one vector very often: ties
    rows = [(k, [float(x) for x in v[k]], 0) for k in range(400)]
    rows += [(1000, None, 0), (1050, [1.0, None] + [0.0] * 6, 0), (1100, [float("nan")] * 8, 0), (1150, [float("inf")] * 8, 0), (None, [1.0] * 8, 0), (1200, [1.0, 2.0], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, score int")
    ids = [*range(400), 1200]
    q = np.floor(256 * np.vstack([v.astype(float), [[1.0, 2.0] + [0.0] * 6]])).astype(int)
    want = set()
    for k, i in enumerate(ids):
        if i % 50 == 0:
            s = q @ q[k]
            best = sorted((-int(s[j]), ids[j]) for j in range(len(ids)) if j != k)[:5]
            want |= {(i, n + 1, j, -x) for n, (x, j) in enumerate(best)}
    got = {tuple(r) for r in topk.top_k(df, block=block, sample=64, pivots=8).select("query_id", "rank", "vec_id", "score").collect()}
    assert got == want
    assert topk.top_k(df.limit(0)).count() == 0
    few = topk.top_k(df.filter("vec_id in (0, 1)")).collect()
    assert [(r.query_id, r.rank, r.vec_id) for r in few] == [(0, 1, 1)]


def test_decontamination_keeps_columns_named_like_its_outputs(spark):
    passage = " ".join(f"q{k}" for k in range(12))
    docs = frame(spark, [(1, "a b c"), (2, f"x {passage} y"), (3, None), (4, ""), (None, passage.upper()), (1, "a b c")])
    items = spark.createDataFrame([("i", passage), ("j", None), (None, "other words here"), ("k", "")], "item_id string, text string")
    for options in ({}, {"block_bytes": 70}):
        kept = decontam.decontaminate(docs, items, **options)
        assert kept.columns == docs.columns and sorted(str(r.doc_id) for r in kept.collect()) == ["1", "1", "3", "4"]
    assert decontam.decontaminate(docs, items.limit(0)).count() == docs.count()


def test_simhash_links_through_rows_without_an_id(spark):
    """Three fingerprints three bits apart in a row; only a row without an id carries the middle one."""
    rng = random.Random(4)
    words = [f"w{k}" for k in range(40)]
    found = {}
    while True:
        t = " ".join(rng.choice(words) for _ in range(30))
        copy = t.split()
        copy[rng.randrange(30)] = "zz"
        a, b = plain_fingerprint(t), plain_fingerprint(" ".join(copy))
        again = list(copy)
        again[rng.randrange(30)] = "yy"
        c = plain_fingerprint(" ".join(again))
        if (a ^ b).bit_count() <= 3 and (b ^ c).bit_count() <= 3 < (a ^ c).bit_count():
            found = {1: t, None: " ".join(copy), 2: " ".join(again)}
            break
    got = {r.doc_id: r.component_id for r in simhash.near_duplicates(frame(spark, list(found.items()))).collect()}
    assert got == {1: 1, None: 1, 2: 1}


def test_stretches_hold_every_chunk():
    rng = np.random.default_rng(2)
    ids = rng.integers(0, 4, 4000).astype(np.uint64)
    ids[500:2500] += np.uint64(10)
    chunk = ids[3000:3007]
    keys = phrases._rolled(chunk, 7, phrases._A)
    open_ = np.zeros(1 << 22, bool)
    open_[(keys >> np.uint64(42)).astype(np.int64)] = True
    parts = phrases._stretches(ids, keys, open_, 7, 6)
    at = [k for k in range(len(ids) - 6) if (ids[k : k + 7] == chunk).all()]
    assert at and all(any(a <= max(0, k - 6) and min(len(ids), k + 13) <= b for a, b in parts) for k in at)
    assert all(b - a >= 13 for a, b in parts[1:-1]) and sum(b - a for a, b in parts) < 500  # most is not streamed
    assert phrases._stretches(ids[:3], keys, open_, 7, 6) == []
