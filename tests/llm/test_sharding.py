"""Shards: least-cost transfers against enumeration, balance, groups that stay together, untouched files."""

import itertools
import os
import zlib

import numpy as np
import pytest

from tremorlake.llm import registry, sharding

SF = "/root/testdata/sf0.01"


def least_cost(sizes, capacities, price):
    """The least cost of any way to place the bytes, by enumeration of the first sources' splits."""
    if not sizes:
        return 0
    best = np.inf
    for split in itertools.product(*(range(min(sizes[0], c) + 1) for c in capacities)):
        if sum(split) == sizes[0]:
            best = min(best, sum(n * p for n, p in zip(split, price[0])) + least_cost(sizes[1:], [c - n for c, n in zip(capacities, split)], price[1:]))
    return best


@pytest.mark.parametrize("seed", range(12))
def test_transfers_cost_least(seed):
    rng = np.random.default_rng(seed)
    sizes, price = rng.integers(0, 6, 3).tolist(), rng.integers(0, 5, (3, 4)).astype(float)
    capacities = rng.multinomial(sum(sizes) + seed % 3, [0.25] * 4).tolist()
    flow = sharding.transfers(sizes, capacities, price)
    assert (flow >= 0).all() and flow.sum(axis=1).tolist() == sizes and (flow.sum(axis=0) <= capacities).all()
    assert (flow * price).sum() == least_cost(sizes, capacities, price)


def test_transfers_move_only_what_has_no_room():
    sizes, capacities = [90, 110, 10**15, 0], [100, 100, 10**15 - 50, 40, 60]
    flow = sharding.transfers(sizes, capacities)
    moved = sum(flow[i, j] for i in range(4) for j in range(5) if i != j)
    assert moved == 60 and flow.sum() == sum(sizes)
    with pytest.raises(ValueError):
        sharding.transfers([5], [4])


def layout_of(spark, path, rows, shards=3, schema="doc_id bigint, text string, size string, shard int"):
    return sharding.lay_out(spark.createDataFrame(rows, schema), str(path), shards)


def read(layout):
    return layout.numbered().selectExpr("row.doc_id AS doc_id", "row.text AS text", "row.size AS own_size", "row.shard AS own_shard", "shard", "slot", "size").collect()


def gapless(rows):
    for s in {r["shard"] for r in rows}:
        slots = sorted(r["slot"] for r in rows if r["shard"] == s)
        if slots != list(range(len(slots))):
            return False
    return True


def test_resharding_keeps_rows_groups_and_untouched_files(spark, tmp_path):
    rng = np.random.default_rng(5)
    texts = [f"{i} " + "é" * int(rng.integers(5, 60)) for i in range(3000)]
    rows = [(i, t, f"s{i}", i) for i, t in enumerate(texts)] + [(5000 + i, "copied " * 30, None, None) for i in range(60)]
    rows += [(None, None, "x", 1), (9000, "", None, 2), (9001, None, None, 3), (7, texts[7], "s7", 7), (7, texts[7], "s7", 7), (9002, "long " * 4000, None, 4)]
    before = layout_of(spark, tmp_path, rows)
    sizes = before.sizes()
    total = sum(sizes.values())
    after = sharding.reshard(before, sharding.equal_capacities(total, 5))
    got = read(after)
    key = lambda r: (str(r[0]), str(r[1]), str(r[2]), str(r[3]))
    assert sorted(map(key, got)) == sorted(map(key, rows)) and gapless(got)
    assert all(r["size"] == len((r["text"] or "").encode()) + 1 for r in got)
    held = after.sizes()
    assert sum(held.values()) == total and max(held.values()) - min(held.values()) < 0.03 * total / 5
    where = {}
    for r in got:
        where.setdefault(r["text"] or "", set()).add(r["shard"])
    assert all(len(s) == 1 for s in where.values())
    was = {(r["doc_id"], r["text"], r["own_size"]): r["shard"] for r in read(before)}
    moved = sum(r["size"] for r in got if was[r["doc_id"], r["text"], r["own_size"]] != r["shard"])
    assert moved <= sum(max(0, sizes[i] - total / 5) for i in sizes) * 1.05
    kept = set(before.files()) & set(after.files())
    assert kept and len(set(after.files()) - kept) < len(after.files())
    # a second change, over files of two generations; the first generation can still be read until it is cleared away
    again = sharding.reshard(after, [total // 2 + 1, total // 4 + 1, 0, 0, total // 4 + 1])
    third = read(again)
    assert sorted(map(key, third)) == sorted(map(key, rows)) and gapless(third)
    assert {r["shard"] for r in third} == {0, 1, 4} and abs(again.sizes()[0] - total // 2) < 0.02 * total
    assert len(read(before)) == len(rows)
    dead = sharding.vacuum(again)
    assert dead > 0 and sorted(map(key, read(sharding.open_layout(spark, str(tmp_path), 2, again.schema)))) == sorted(map(key, rows))
    assert not [f for f in before.files() if f not in again.files() and os.path.exists(f.removeprefix("file://"))]


def test_a_group_without_room_is_cut_between_its_rows(spark, tmp_path):
    rows = [(i, "the same text again and again", None, None) for i in range(400)] + [(1000 + i, f"other {i}", None, None) for i in range(200)]
    before = layout_of(spark, tmp_path, rows, shards=1)
    after = sharding.reshard(before, sharding.equal_capacities(sum(before.sizes().values()), 4))
    got = read(after)
    assert sorted(r["doc_id"] for r in got) == sorted(r[0] for r in rows) and gapless(got)
    held = after.sizes().values()
    assert max(held) - min(held) <= 60


def test_nothing_moves_without_need_and_empty_tables(spark, tmp_path):
    before = layout_of(spark, tmp_path / "a", [(i, f"t{i}", None, None) for i in range(50)])
    after = sharding.reshard(before, [10**6] * 3)
    assert sorted(after.files()) == sorted(before.files())
    empty = layout_of(spark, tmp_path / "b", [])
    moved = sharding.reshard(empty, sharding.equal_capacities(0, 4))
    assert moved.numbered().collect() == [] and moved.sizes() == {}


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_registered_query(spark):
    got = registry.QUERIES["op12_sharding"](spark, SF).collect()
    docs = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}
    assert len(got) == len(docs) and {r["doc_id"] for r in got} == docs.keys() and gapless(got)
    assert all(r["size"] == len(docs[r["doc_id"]].encode()) + 1 and r["text_crc32"] == zlib.crc32(docs[r["doc_id"]].encode()) for r in got)
    assert {r["law"] for r in got} == {"bytes"} and {r["grown_shard"] for r in got} == {None}
    held = [sum(r["size"] for r in got if r["shard"] == s) for s in range(16)]
    assert max(held) - min(held) < max(r["size"] for r in got)
    shard_of = {}
    for r in got:
        shard_of.setdefault(docs[r["doc_id"]], set()).add(r["shard"])
    assert all(len(s) == 1 for s in shard_of.values())
