"""The pipeline's near-duplicate stage against the similarity of all pairs."""

import random

import numpy as np
import pytest

import corpus_pipeline
from timberline.llm import similar
from tests.llm.test_pairs import components, frame


def shingles(text):
    w = (text or "").split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def edited(n=90):
    """Copies with up to a tenth of their words changed, so that similarities lie on both sides of 0.8."""
    rng = random.Random(3)
    vocabulary = [f"w{k}" for k in range(900)]
    base = [rng.choices(vocabulary, k=rng.randint(80, 200)) for _ in range(6)]
    rows = []
    for k in range(n):
        words = list(rng.choice(base))
        for at in rng.sample(range(len(words)), rng.randint(0, 4)):
            words[at] = rng.choice(vocabulary)
        rows.append((k, " ".join(words)))
    return rows + [(900, None), (901, ""), (None, rows[0][1]), (902, "a"), (903, "a"), (3, rows[3][1])]


def wanted(rows):
    sets = [shingles(t) for _, t in rows]
    close = lambda a, b: len(a & b) >= 0.8 * len(a | b)
    named = [k for k, (i, _) in enumerate(rows) if i is not None]
    linked = [(x, y) for x in range(len(named)) for y in range(x) if close(sets[named[x]], sets[named[y]])]
    least = components([rows[k][0] for k in named], linked)
    return sorted([str(rows[k][0]) for k, c in zip(named, least) if rows[k][0] == c] + ["None"] * (len(named) < len(rows)))


def test_keeps_one_by_all_pairs(spark):
    rows = edited()
    got = similar.keep_one(frame(spark, rows), max_bucket=64, recall=1 - 1e-6)
    assert sorted(str(r.doc_id) for r in got.collect()) == wanted(rows)


def test_a_large_group_of_near_copies_is_one_group(spark):
    rng = random.Random(2)
    base = [f"w{k}" for k in range(300)]
    rows = []
    for k in range(150):
        words = list(base)
        for at in rng.sample(range(300), 3):
            words[at] = f"x{k}"
        rows.append((k, " ".join(words)))
    got = similar.groups(frame(spark, rows), max_bucket=4).collect()
    assert {r.component_id for r in got} == {0}


def test_recall_of_pairs_at_the_bound_and_no_pair_below(spark):
    """Pairs by themselves, each with a similarity of its own around the bound."""
    rng = random.Random(11)
    rows, linked = [], set()
    for k in range(600):
        size = rng.choice([30, 60, 120, 400])
        words = [f"p{k}w{j}" for j in range(size)]
        copy = list(words)
        for at in rng.sample(range(size), max(1, round(size * rng.uniform(0.005, 0.03)))):
            copy[at] += "x"
        rows += [(2 * k, " ".join(words)), (2 * k + 1, " ".join(copy))]
        a, b = shingles(rows[-2][1]), shingles(rows[-1][1])
        if len(a & b) >= 0.8 * len(a | b):
            linked.add(2 * k + 1)
    gone = {r.doc_id for r in similar.groups(frame(spark, rows)).collect() if r.doc_id != r.component_id}
    assert gone <= linked and len(linked) > 150 and len(gone) >= 0.95 * len(linked)


def test_bits_differ_as_often_as_the_angle_says():
    rng = np.random.default_rng(4)
    shared, own = rng.integers(0, 1 << 63, 800, dtype=np.uint64), rng.integers(0, 1 << 63, 200, dtype=np.uint64)
    a, b = np.concatenate([shared, own[:100]]), np.concatenate([shared, own[100:]])
    far = (similar.fingerprint(a, 64) != similar.fingerprint(b, 64)).mean()
    assert abs(far - similar.differing(0.8)) < 0.03 and similar.similarity(np.sort(a), np.sort(b)) == 0.8
    assert [similar.plan(n)[0] for n in (10, 10**6, 10**10)] == sorted(similar.plan(n)[0] for n in (10, 10**6, 10**10))


def test_stage_drops_a_copy_with_edited_words(spark):
    words = [f"n{k}" for k in range(200)]
    copy = [f"x{k}" if k in (30, 90, 150) else w for k, w in enumerate(words)]
    other = [f"x{k}" if k % 10 == 0 else w for k, w in enumerate(words)]
    docs = frame(spark, [(1, " ".join(words)), (2, " ".join(copy)), (3, " ".join(other))])
    got = corpus_pipeline.near_duplicates(spark, docs, "")
    assert sorted(r.doc_id for r in got.collect()) == [1, 3] and got.columns == docs.columns


def template_crowd(pairs, seed=5):
    """Pairs over one template: members of a pair are alike to some 0.86, texts of different pairs to some 0.53."""
    rng = random.Random(seed)
    template = [f"t{k}" for k in range(140)]
    rows = []
    for k in range(pairs):
        words = template + [f"p{k}w{j}" for j in range(60)]
        cut = rng.randrange(140)
        words = words[cut:] + words[:cut]
        copy = list(words)
        for at in rng.sample(range(len(words)), 3):
            copy[at] += "x"
        rows += [(2 * k, " ".join(words)), (2 * k + 1, " ".join(copy))]
    return rows


def test_pairs_inside_a_crowd_are_found_with_default_parameters(spark):
    rows = template_crowd(1500)
    sets = [shingles(t) for _, t in rows]
    linked = {2 * k + 1 for k in range(1500) if len(sets[2 * k] & sets[2 * k + 1]) >= 0.8 * len(sets[2 * k] | sets[2 * k + 1])}
    rng = random.Random(1)
    for _ in range(300):
        x, y = rng.sample(range(len(rows)), 2)
        if x // 2 != y // 2:
            assert len(sets[x] & sets[y]) < 0.7 * len(sets[x] | sets[y])
    got = {r.doc_id: r.component_id for r in similar.groups(frame(spark, rows).repartition(8)).collect()}
    found = {i for i, c in got.items() if i != c}
    assert all(got[i] in (i, i - 1) for i in got if i % 2) and found <= linked
    assert len(linked) > 1400 and len(found) >= 0.95 * len(linked)


def test_edited_copies_meet_at_their_original(spark):
    """Copies that are close to one text and not to each other, some only close to a copy."""
    rng = random.Random(9)
    base = [f"b{k}" for k in range(200)]
    rows = [(500, " ".join(base))]
    for k in range(160):
        words = list(base)
        for at in rng.sample(range(3, 197), 4):
            words[at] = f"e{k}x{at}"
        rows.append((k, " ".join(words)))
    words = rows[7][1].split()
    rows.append((900, " ".join(words[:-20])))
    rows.append((901, " ".join(words[:-20] + [f"z{k}" for k in range(8)])))
    sets = {i: shingles(t) for i, t in rows}
    ids = sorted(sets)
    links = [(x, y) for x in range(len(ids)) for y in range(x) if len(sets[ids[x]] & sets[ids[y]]) >= 0.8 * len(sets[ids[x]] | sets[ids[y]])]
    want = dict(zip(ids, components(ids, links)))
    got = {r.doc_id: r.component_id for r in similar.groups(frame(spark, rows), max_bucket=4, crowd=6, recall=1 - 1e-6).collect()}
    assert got == want and sum(c == 0 for c in want.values()) > 150


def test_rare_members_find_every_close_pair(spark):
    """The exact way alone: what meets at rare members holds all pairs at the bound, and centres with left-overs connect the rest."""
    rng = random.Random(4)
    parts = [[f"s{k}w{j}" for j in range(12)] for k in range(14)]
    rows = [(k, " ".join(w for p in sorted(rng.sample(range(14), 9)) for w in parts[p])) for k in range(120)]
    sets = {i: shingles(t) for i, t in rows}
    ids = sorted(sets)
    links = [(x, y) for x in range(len(ids)) for y in range(x) if len(sets[ids[x]] & sets[ids[y]]) >= 0.8 * len(sets[ids[x]] | sets[ids[y]])]
    want = dict(zip(ids, components(ids, links)))
    for options in ({"max_bucket": 1}, {"max_bucket": 1, "crowd": 3}):
        got = {r.doc_id: r.component_id for r in similar.groups(frame(spark, rows), recall=1 - 1e-6, **options).collect()}
        assert got == want


def test_points_that_a_part_of_the_sets_shows_to_be_crowded(spark, monkeypatch):
    monkeypatch.setattr(similar, "SHOWN", 2)
    rows = template_crowd(60, seed=3)
    got = {r.doc_id: r.component_id for r in similar.groups(frame(spark, rows), max_bucket=2, recall=1 - 1e-6).collect()}
    monkeypatch.setattr(similar, "SHOWN", 10**6)
    monkeypatch.setattr(similar, "SENT", 0)
    assert got == {r.doc_id: r.component_id for r in similar.groups(frame(spark, rows), max_bucket=2, recall=1 - 1e-6).collect()}


def test_rows_of_one_id_are_one_document(spark):
    a, b = (" ".join(f"{c}{k}" for k in range(60)) for c in "ab")
    rows = [(5, a), (5, b), (2, a), (9, b), (7, "other words")]
    got = {(r.doc_id, r.component_id) for r in similar.groups(frame(spark, rows)).collect()}
    assert got == {(5, 2), (2, 2), (9, 2), (7, 7)}


def test_pairs_of_a_group_of_near_copies_grow_with_its_size(spark, monkeypatch):
    rng = np.random.default_rng(12)
    base = [f"w{k}" for k in range(200)]
    rows = []
    for k in range(500):
        words = list(base)
        for at in rng.choice(200, 2, replace=False):
            words[at] = f"x{k}_{at}"
        rows.append((k, " ".join(words)))
    rows += [(1000 + k, " ".join(f"o{k}_{j}" for j in range(40))) for k in range(100)]
    pairs, write = [], similar.materialize

    def seen(df):
        out = write(df)
        if out.columns == ["a", "b"]:
            pairs.append(out.count())
        return out

    monkeypatch.setattr(similar, "materialize", seen)
    got = {r.doc_id: r.component_id for r in similar.groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(got[k] == 0 for k in range(500)) and all(got[1000 + k] == 1000 + k for k in range(100))
    assert max(pairs) <= 20 * 500, pairs


def by_all_pairs(rows):
    sets = {i: shingles(t) for i, t in rows}
    ids = sorted(sets)
    close = lambda a, b: len(a & b) >= 0.8 * len(a | b)
    links = [(x, y) for x in range(len(ids)) for y in range(x) if close(sets[ids[x]], sets[ids[y]])]
    return dict(zip(ids, components(ids, links)))


def test_pairs_of_texts_left_over_of_a_crowd_grow_with_its_size(spark, monkeypatch):
    """Half of the copies are like the original; the others are not, and share edits by threes, so that members of their own do not rule them out."""
    rng = np.random.default_rng(8)
    base = [f"w{k}" for k in range(150)]
    rows = [(0, " ".join(base))]
    for k in range(1, 301):
        words = list(base)
        for at in rng.choice(150, 2, replace=False):
            words[at] = f"x{k}_{at}"
        rows.append((k, " ".join(words)))
    for k in range(150):
        at = rng.choice(30, 7, replace=False) * 5 + 2
        for half in (0, 1):
            words = list(base)
            for j in (*at[:3], *at[3 + 2 * half : 5 + 2 * half]):
                words[j] = f"y{k}_{j}"
            rows.append((1000 + 2 * k + half, " ".join(words)))
    pairs, compare = [], similar._compared

    def seen(asked, *rest):
        pairs.append(asked.count())
        return compare(asked, *rest)

    monkeypatch.setattr(similar, "_compared", seen)
    got = {r.doc_id: r.component_id for r in similar.groups(spark.createDataFrame(rows, "doc_id long, text string"), max_bucket=4).collect()}
    want = by_all_pairs(rows)
    assert got == want and sum(want[i] != 0 for i in want) > 250
    assert sum(pairs) <= 20 * len(rows), pairs


def test_members_that_nobody_shares_have_no_rows_at_a_hub(spark, monkeypatch):
    """Copies that share three edits with one other and have two of their own, ten shingles (six at both ends of the text), that can meet nothing."""
    rng = np.random.default_rng(8)
    base = [f"w{k}" for k in range(150)]
    rows = [(0, " ".join(base))]
    for k in range(60):
        at = rng.choice(30, 7, replace=False) * 5 + 2
        for half in (0, 1):
            words = list(base)
            for j in (*at[:3], *at[3 + 2 * half : 5 + 2 * half]):
                words[j] = f"y{k}_{j}"
            rows.append((1000 + 2 * k + half, " ".join(words)))
    made, look = [], similar._from_hubs

    def seen(*given):
        got = look(*given)
        made.append(got.groupBy("hub", "rep", "total").count().collect())
        return got

    monkeypatch.setattr(similar, "_from_hubs", seen)
    got = {r.doc_id: r.component_id for r in similar.groups(frame(spark, rows), max_bucket=4, crowd=16).collect()}
    assert got == by_all_pairs(rows)
    assert made[0] and all(r["count"] <= r["total"] - 6 for r in made[0]), made[0][:3]


@pytest.mark.parametrize("seed, crowd, rounds", [(1, 2, 4), (2, 2, 1)])
def test_what_hubs_leave_over_is_found_from_other_hubs(spark, monkeypatch, seed, crowd, rounds):
    """Two templates with much in common, copies with edits from a short list and with ends cut off; crowds are tiny, so that hubs lead to hubs."""
    rng = random.Random(seed)
    one = [f"t{k}" for k in range(120)]
    two = one[:90] + [f"u{k}" for k in range(30)]
    rows = []
    for k in range(220):
        words = list(rng.choice([one, two]))
        for _ in range(rng.choice([1, 2, 3, 4])):
            at = rng.randrange(24) * 5
            words[at : at + 1] = [f"e{at}_{rng.randrange(3)}"] if rng.random() < 0.8 else []
        rows.append((k, " ".join(words[: rng.choice([120, 120, 112, 104])])))
    want = by_all_pairs(rows)
    assert len(set(want.values())) > 3
    monkeypatch.setattr(similar, "ROUNDS", rounds)
    assert want == {r.doc_id: r.component_id for r in similar.groups(frame(spark, rows), max_bucket=1, crowd=crowd, recall=1 - 1e-6).collect()}
