from __future__ import annotations

import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from prescriva.llm import sharded
from prescriva.llm import weighted_minhash as wm


def brute(rows, threshold=0.8):
    """Components by comparing all pairs: row index -> smallest row index by (doc_id is null, doc_id, index)."""
    vectors = []
    for _, t in rows:
        w = re.findall(r"[a-z0-9\x80-\U0010ffff]+", "".join(c.lower() if c.isascii() else c for c in t or ""))
        vectors.append(Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else None)
    df, n = Counter(), len(rows)
    for v in vectors:
        df.update(set(v or ()))
    weights = [None if v is None else {k: c * (8 + math.log1p(n / df[k]) / math.log1p(n)) / 9 for k, c in v.items()} for v in vectors]
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(n):
        for j in range(i):
            a, b = weights[i], weights[j]
            if a and b:
                least = sum(min(a[k], b[k]) for k in a.keys() & b.keys())
                if least / (sum(a.values()) + sum(b.values()) - least) >= threshold - 1e-9:
                    parent[find(i)] = find(j)
    heads = {}
    for i in range(n):
        key = (rows[i][0] is None, rows[i][0] or 0, i)
        heads[find(i)] = min(heads.get(find(i), (2,)), key)
    return [heads[find(i)] for i in range(n)]


def make(rng, n=120):
    vocabulary = [f"v{i}" for i in range(300)]
    rows = []
    for i in range(n):
        if rows and rng.random() < 0.6:
            words = rng.choice(rows)[1].split()
            for _ in range(rng.randrange(4)):
                words[rng.randrange(len(words))] = rng.choice(vocabulary)
        else:
            words = rng.choices(vocabulary, k=rng.randrange(3, 120))
        rows.append((i, " ".join(words)))
    return rows


def test_sampling_estimates_weighted_jaccard():
    rng = np.random.default_rng(1)
    keys = np.sort(wm.mix(np.arange(1, 400, dtype=np.uint64)))
    a, b = rng.uniform(0.2, 3, 399), rng.uniform(0.2, 3, 399)
    hits = total = 0
    exact = wm.weighted_jaccard((keys, a), (keys, b))
    for s in range(60):
        x, _ = wm.signatures(np.concatenate([keys, keys]), np.concatenate([a, b]), np.array([399, 399]), 1, 27, 27 * s)
        hits += (x[0] == x[1]).sum()
        total += 27
    assert hits / total == pytest.approx(exact, abs=0.05)


def test_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(sharded, "ROWS", 16)
    rows = make(random.Random(5))
    rows += [(500, None), (501, ""), (502, "?!"), (503, "two words"), (504, "TWO, words"), (None, rows[0][1]), (7, rows[3][1]), (506, "long word " * 20000), (507, "long word " * 20000), (2, "short Été"), (2, "short Été")]
    frame = spark.createDataFrame([(*r, 9, "z") for r in rows], "doc_id long, text string, row int, block string").coalesce(1)
    got = wm.near_duplicates(frame).orderBy("row").collect()
    heads = brute(rows)
    assert [r.component_id for r in got] == [None if h[0] else h[1] for h in heads]
    assert [r.kept for r in got] == [h[2] == i for i, h in enumerate(heads)]
    left = wm.deduplicated(frame)
    assert left.columns == frame.columns and left.count() == sum(h[2] == i for i, h in enumerate(heads))
    assert wm.near_duplicates(frame.limit(0)).count() == 0


def test_large_bands_with_several_components(spark, monkeypatch):
    monkeypatch.setattr(wm, "SMALL", 3)
    monkeypatch.setattr(wm, "PART", 5)
    monkeypatch.setattr(wm, "BLOCK", 10)
    rng = random.Random(9)
    rows = make(rng, 60)
    base = rows[-1][1].split() + rng.choices([f"v{i}" for i in range(300)], k=60)
    for i in range(60):
        words = list(base)
        at = rng.randrange(len(words) - 12)
        words[at : at + 6] = [f"n{i}_{k}" for k in range(6)]
        rows.append((200 + i, " ".join(words)))
    frame = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    # Bands of one sample: unlike texts meet as well, so that bands hold several components.
    got = wm.near_duplicates(frame, rows_each=1, bands_all=27).orderBy("row").collect()
    assert [r.component_id for r in got] == [h[1] for h in brute(rows)]


def test_shingles_of_runs():
    texts = ["a b c d e f", None, "", "x y", "a b c d e", "A-b C d.E"]
    (keys, sizes), = wm.shingles(pa.array(texts))
    assert sizes.tolist() == [2, 0, 0, 1, 1, 1] and keys[0] == keys[3] == keys[4] and len(set(keys.tolist())) == 3


def test_overlaps_against_pairs():
    rng = np.random.default_rng(3)
    make = lambda: (np.sort(rng.choice(200, 60, replace=False)).astype(np.uint64), rng.choice([0.5, 1.0, 1.5, 2.5], 60))
    left, right = [make() for _ in range(7)], [make() for _ in range(9)]
    got = wm._overlaps(left, right, columns=50)
    for i, a in enumerate(left):
        for j, b in enumerate(right):
            da, db = dict(zip(a[0].tolist(), a[1].tolist(), strict=True)), dict(zip(b[0].tolist(), b[1].tolist(), strict=True))
            assert got[i, j] == pytest.approx(sum(min(da[k], db[k]) for k in da.keys() & db.keys()))


def test_bands_and_picks_follow_the_threshold():
    assert wm.layout(0.8) == (3, 9, 13)
    for t in (0.3, 0.5, 0.7, 0.9, 0.95):
        rows, bands, agree = wm.layout(t)
        n = rows * bands
        assert (1 - t**rows) ** bands <= 0.002 and sum(math.comb(n, k) * t**k * (1 - t) ** (n - k) for k in range(agree)) <= 1e-4
    for bad in (0, -1, 1.1):
        with pytest.raises(ValueError):
            wm.layout(bad)


@pytest.mark.parametrize("threshold", [0.8, 0.6])
def test_share_of_pairs_that_meet(threshold):
    """Pairs between the threshold and 0.05 above it: in at least 0.99 of them both the bands and the picks agree."""
    rng = np.random.default_rng(3)
    rows, bands, agree = wm.layout(threshold)
    keys = np.unique(wm.mix(rng.integers(1, 2**62, 200_000).astype(np.uint64)))
    rng.shuffle(keys)
    met = n = at = 0
    for _ in range(500):
        size = int(rng.integers(30, 200))
        own = keys[at : at + 2 * size]
        at += 2 * size
        s = rng.uniform(threshold, threshold + 0.05)
        same = math.ceil(s * 2 * size / (1 + s))
        a, b = np.sort(own[:size]), np.sort(np.concatenate([own[:same], own[size : 2 * size - same]]))
        picks, marks = wm.signatures(np.concatenate([a, b]), np.ones(2 * size), np.array([size, size]), rows, bands)
        met += bool((picks[0] == picks[1]).any()) and int((marks[0] == marks[1]).sum()) >= agree
        n += 1
    assert met / n >= 0.99


def test_pairs_that_few_picks_agree_on_are_kept_by_agree_0(spark):
    rows = make(random.Random(11), 60)
    frame = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    got = wm.near_duplicates(frame, threshold=0.5, agree=0).orderBy("row").collect()
    assert [r.component_id for r in got] == [h[1] for h in brute(rows, 0.5)]
