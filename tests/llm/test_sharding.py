from __future__ import annotations

import hashlib
import heapq
import zlib
from collections import Counter, defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from prescriva.llm import sharding

OF = "doc_id long, text string, shard int, _row string"


def brute(rows, shards):
    """The longest-processing-time rule group by group: bytes of each shard."""
    weights = Counter()
    for _, text in rows:
        weights[text or ""] += len((text or "").encode()) + 8
    heap = [(0, i) for i in range(shards)]
    for w in sorted(weights.values(), reverse=True):
        load, i = heap[0]
        heapq.heapreplace(heap, (load + w, i))
    return sorted(load for load, _ in heap)


def check(spark, rows, shards, parts=3):
    docs = spark.createDataFrame([(i, t, 7, "x") for i, t in rows], OF).repartition(parts)
    got = sharding.assign(docs, shards).collect()
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == Counter((i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t in rows)
    slots, loads, crc = defaultdict(list), Counter(dict.fromkeys(range(shards), 0)), {}
    for r in got:
        slots[r.shard].append(r.slot)
        loads[r.shard] += r.size
        assert crc.setdefault(r.text_crc32, r.shard) == r.shard
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert sorted(loads.values()) == brute(rows, shards)
    return sorted((r.doc_id if r.doc_id is not None else -1, r.shard, r.slot) for r in got)


def test_loads_of_the_rule(spark):
    rows = [(i, "w" * (i * 37 % 113)) for i in range(400)] + [(1000 + i, "the same text") for i in range(300)] + [(2000 + i, f"é{i:03}") for i in range(200)]
    once = check(spark, rows, 7)
    assert check(spark, rows[::-1], 7, parts=5) == once  # whatever the layout


def test_nulls_repeats_and_few_rows(spark):
    odd = [(None, None), (None, None), (None, ""), (3, ""), (3, "a"), (3, "a"), (4, "x" * 300_000)]
    check(spark, odd, 24)
    check(spark, odd, 1)
    check(spark, [(1, "one")], 5)
    assert sharding.assign(spark.createDataFrame([], OF), 3).collect() == []
    with pytest.raises(ValueError):
        sharding.assign(spark.createDataFrame([], OF), 0)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 60), st.integers(1, 900)), max_size=12), st.integers(1, 9))
def test_turns_at_once_are_those_one_by_one(pairs, shards):
    loads, heap = [0] * shards, [(0, i) for i in range(shards)]
    for weight, count in sorted(pairs, reverse=True):
        one = [0] * shards
        for _ in range(count):
            load, i = heap[0]
            heapq.heapreplace(heap, (load + weight, i))
            one[i] += 1
        assert sharding.turns(loads, weight, count) == one


def test_written_shards(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"text {i % 40}", "en") for i in range(200)], "doc_id long, text string, lang string")
    sharding.write(docs, f"{tmp_path}/shards", 4)
    back = spark.read.parquet(f"{tmp_path}/shards")
    plan = {r.doc_id: (r.shard, r.slot) for r in sharding.assign(docs, 4).collect()}
    assert {r.doc_id: r.shard for r in back.collect()} == {i: s for i, (s, _) in plan.items()} and set(back.columns) == {"doc_id", "text", "lang", "shard"}
    for shard in range(4):
        rows = [r for r in back.where(f"shard = {shard}").select("doc_id", "_metadata.file_name", "_metadata.row_index").collect()]
        rows.sort(key=lambda r: (r.file_name, r.row_index))
        assert [plan[r.doc_id][1] for r in rows] == list(range(len(rows)))
    digest = lambda i: hashlib.md5(f"text {i % 40}".encode()).hexdigest()
    assert all((digest(a), a) < (digest(b), b) for a in range(200) for b in range(200) if plan[a][0] == plan[b][0] and plan[a][1] < plan[b][1])
    with pytest.raises(ValueError):
        sharding.write(docs.withColumnRenamed("lang", "shard"), f"{tmp_path}/none", 4)
