"""Sharding against a plain descent, and what moves when the tree changes."""

import hashlib
import math
import zlib

import pytest

from timberline.llm import shards
from tests.llm.test_pairs import frame


def plain(doc_id, tree):
    """The tree walked in Python, weights summed anew."""
    key = "null" if doc_id is None else str(doc_id)

    def best(options):
        def at(label, w):
            return -math.log((int(hashlib.md5(f"{key}/{label}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52) / w

        return min((at(label, w), i) for i, (label, w) in enumerate(options) if w > 0)[1]

    r = best([(f"{i}", sum(map(sum, region))) for i, region in enumerate(tree.weights)])
    k = best([(f"{r}.{i}", sum(rack)) for i, rack in enumerate(tree.weights[r])])
    s = best([(f"{r}.{k}.{i}", w) for i, w in enumerate(tree.weights[r][k])])
    before = [rack for region in tree.weights[:r] for rack in region] + list(tree.weights[r][:k])
    return r, k, sum(map(len, before)) + s


def where(spark, tree, n=4000):
    got = shards.place(spark.range(n).withColumnRenamed("id", "doc_id"), tree).collect()
    return {r.doc_id: (r.region, r.rack, r.shard) for r in got}


UNEVEN = shards.Tree((((1.0, 3.0), (2.0,)), ((0.5, 0.0, 1.5),)))


@pytest.mark.parametrize("tree", [shards.Tree.even(16), UNEVEN])
def test_descent_and_weights(spark, tree):
    got = where(spark, tree)
    assert all((got[i][0], got[i][2]) == plain(i, tree)[::2] for i in range(400))
    flat = [w for region in tree.weights for rack in region for w in rack]
    for number, w in enumerate(flat):
        want = len(got) * w / sum(flat)
        assert abs(sum(at[2] == number for at in got.values()) - want) <= 5 * math.sqrt(want + 1)


def test_one_more_shard_takes_rows_only_into_itself(spark):
    tree = shards.Tree.even(16)
    for _ in range(3):
        before, after = where(spark, tree), where(spark, tree.grown())
        moved = [i for i in before if before[i][2] != after[i][2]]
        assert {after[i][2] for i in moved} == {tree.shards}
        assert abs(len(moved) - len(before) / (tree.shards + 1)) < 80
        tree = tree.grown()


def test_a_heavier_shard_moves_rows_only_into_its_subtree(spark):
    before = where(spark, UNEVEN)
    heavier = shards.Tree((((1.0, 6.0), (2.0,)), ((0.5, 0.0, 1.5),)))
    after = where(spark, heavier)
    moved = {i for i in before if before[i][2] != after[i][2]}
    assert moved and all(after[i][0] == 0 for i in moved)
    # inside the region rows move into the heavier rack, inside that rack into the heavier shard
    stayed = [i for i in moved if before[i][0] == 0]
    assert all(after[i][1] == 0 for i in stayed)
    assert all(after[i][2] == 1 for i in stayed if before[i][1] == 0)
    # racks and shards of the other region never exchange rows
    assert all(before[i] == after[i] for i in before if after[i][0] == 1)


def test_numbered_rows_of_any_kind(spark, monkeypatch):
    monkeypatch.setattr(shards, "RUN", 7)
    rows = [(k, f"text {k}") for k in range(300)] + [(5, "same")] * 40 + [(None, None)] * 9 + [(7, ""), (8, "é" * 5000), (5, "other"), (-1, "x")]
    tree = shards.Tree.even(16)
    got = shards.numbered(frame(spark, rows).withColumnRenamed("n_words", "shard").withColumnRenamed("fp", "slot"), tree).collect()
    assert len(got) == len(rows)
    want = sorted((str(i), len((t or "").encode()) + 1, zlib.crc32((t or "").encode()), plain(i, tree)[2], plain(i, tree.grown())[2]) for i, t in rows)
    assert sorted((str(r.doc_id), r.size, r.text_crc32, r.shard, r.grown_shard) for r in got) == want
    slots = {}
    for r in got:
        slots.setdefault(r.shard, []).append(r.slot)
        assert r.law == "key" and r.grown_shard in (r.shard, 16)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    again = shards.numbered(frame(spark, rows[::-1]).repartition(5), tree).collect()
    assert sorted(map(str, again)) == sorted(map(str, got))
    assert shards.numbered(frame(spark, []), tree).count() == 0


def test_slots_do_not_depend_on_the_slices(spark, monkeypatch):
    rows = [(k, f"t{k % 50}") for k in range(600)]
    got = sorted(map(str, shards.numbered(frame(spark, rows), shards.Tree.even(3)).collect()))
    monkeypatch.setattr(shards, "SLICE", 4)
    assert sorted(map(str, shards.numbered(frame(spark, rows), shards.Tree.even(3)).collect())) == got


def test_written_shards_hold_whole_rows(spark, tmp_path):
    rows = [(k, f"text {k}") for k in range(200)] + [(3, None)]
    tree = shards.Tree.even(6)
    shards.write_shards(frame(spark, rows), tree, f"{tmp_path}/out")
    back = spark.read.parquet(f"{tmp_path}/out").collect()
    assert sorted((r.doc_id, str(r.text), r.shard) for r in back) == sorted((i, str(t), plain(i, tree)[2]) for i, t in rows)
    assert {"fp", "component_id", "n_words"} <= set(back[0].asDict())


def test_trees_without_weight_are_refused():
    for bad in ((), (((0.0,),),), (((1.0, -1.0),),)):
        with pytest.raises(ValueError):
            shards.Tree(bad)
