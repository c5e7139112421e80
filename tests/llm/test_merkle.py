from __future__ import annotations

import hashlib
from itertools import groupby

from pyspark.sql import functions as F

from prescriva.llm import merkle

OF = "doc_id long, source string, lang string, n_chars long, text string, tree int, hash string, _row int"


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row, text):
    return H(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (*row[:4], text)))


def climb(hashes):
    """(root, the siblings left and right of each leaf, level by level)."""
    paths, of, level = [[] for _ in hashes], list(range(len(hashes))), list(hashes)
    while len(level) > 1:
        runs = [level[i : i + 3] for i in range(0, len(level), 3)]
        for j, at in enumerate(of):
            run = runs[at // 3]
            paths[j].append(("".join(run[: at % 3]), "".join(run[at % 3 + 1 :])))
        of, level = [at // 3 for at in of], [H(*run) for run in runs]
    return level[0], paths


def brute(rows, change):
    first = lambda v: (v is not None, v if v is not None else 0)
    name = lambda v: (v is not None, (v or "").encode())
    rows = sorted(rows, key=lambda r: (name(r[1]), first(r[0]), leaf(r, r[4])))
    sources = [list(g) for _, g in groupby(rows, key=lambda r: r[1])]
    trees = [climb([leaf(r, r[4]) for r in g]) for g in sources]
    root, above = climb([t[0] for t in trees])
    out = []
    for group, (sub, paths), rest in zip(sources, trees, above, strict=True):
        for r, path in zip(group, paths, strict=True):
            own = now = leaf(r, r[4])
            now = leaf(r, change(r[4])) if r[4] is not None else own
            for left, right in path + rest:
                now = H(left, now, right)
            out.append((r[0], own, sub, root, H(*(x for step in path + rest for x in step)), now, now == root))
    return sorted(out, key=str)


def check(spark, rows, parts=3):
    docs = spark.createDataFrame([(*r, 1, "x", 2) for r in rows], OF).repartition(parts)
    got = merkle.manifest(docs, F.replace("text", F.lit("\n"), F.lit("")))
    assert sorted(map(tuple, got.collect()), key=str) == brute(rows, lambda t: t.replace("\n", ""))
    return got


def test_sources_of_many_sizes(spark):
    """One leaf, runs of one to three, and more than a stage of six levels holds."""
    rows = []
    for s, n in enumerate((1, 2, 3, 4, 9, 10, 28, 82, 244, 729, 730, 2190)):
        rows += [(i * 7 % 5000, f"s{s}", "en", i, f"text {i}\nof {s}" if i % 2 else f"text {i}") for i in range(n)]
    got = check(spark, rows)
    assert got.where("not verified").count() == sum(1 for r in rows if "\n" in r[4])


def test_many_sources(spark):
    check(spark, [(i, f"source {i}", None, None, "é" * (i % 5)) for i in range(800)])


def test_nulls_repeats_and_few_rows(spark):
    odd = [(None, None, None, None, None), (None, None, None, None, None), (None, None, "en", 3, ""), (1, "", None, 1, "a\nb"), (1, "", None, 1, "a\nb"), (1, "Z", "de", 0, "\n"), (-5, "Z", "de", 0, ""), (2, "é", "x", 2, "y" * 200_000)]
    check(spark, odd)
    check(spark, [(9, "s", "en", 4, "text")])
    one = merkle.manifest(spark.createDataFrame([(9, "s", "en", 4, "text", 1, "x", 2)], OF)).first()
    assert one.leaf == one.subroot == one.root == one.folded_root and one.proof_sha256 == H() and one.verified
    empty = merkle.manifest(spark.createDataFrame([], OF))
    assert empty.collect() == [] and empty.columns == merkle.manifest(spark.createDataFrame([(9, "s", "en", 4, "text", 1, "x", 2)], OF)).columns
