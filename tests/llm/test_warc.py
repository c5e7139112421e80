from __future__ import annotations

import base64
import hashlib
import io
import random

import pyarrow.fs as pafs
from pyspark.sql import functions as F

from prescriva.llm import ranges, shared, warc


def rows_of(spark, directory):
    return sorted(map(tuple, warc.read_warc(spark, directory).collect()), key=str)


def expected(rows, least=0):
    out, by = [], {}
    for i, u, h in rows:
        by.setdefault(h or "", []).append(i)
    for i, u, h in rows:
        p = (h or "").encode()
        own = by[h or ""]
        winner = max((x for x in own if x is not None), default=None)
        revisit = len(own) > 1 and len(p) >= least and i != winner
        out.append((i, "revisit" if revisit else "response", winner if revisit else None, len(p), base64.b32encode(hashlib.sha1(p).digest()).decode()))
    return sorted(out, key=str)


def test_round_trip(spark, tmp_path):
    rows = [(i, f"http://h/{i}", "same page" if i % 3 == 0 else f"<p>{i}é\r\n\r\nWARC/1.1</p>" * (i % 7)) for i in range(200)]
    rows += [(500, None, None), (501, "a b\nc", ""), (None, "x", "no id"), (502, "long", "z" * 3_000_000)]
    pages = spark.createDataFrame([(*r, "extra", 1) for r in rows], "page_id long, url string, html string, record_type string, digest int")
    for least in (30, 0):
        directory = shared.shared_dir(spark, "w")
        manifest = warc.write_warc(pages, directory, least, roll_bytes=2000)
        got = warc.read_warc(spark, directory).collect()
        assert all(r.intact for r in got)
        assert sorted(((r.page_id, r.record_type, r.refers_to, r.payload_bytes, r.payload_digest) for r in got), key=str) == expected(rows, least)
        files = manifest.collect()
        assert len({f.shard for f in files}) < len(files) and sum(f.records for f in files) == len(rows)
        fs, path = shared.store(f"{directory}/archive")
        for f in files:
            assert hashlib.sha256(fs.open_input_file(f"{path}/{f.file}").readall()).hexdigest() == f.sha256
    # The same rows in another order and layout give the same files, byte for byte.
    bytes_of = []
    for source, partitions in ((pages, "4"), (pages.repartition(7), "9"), (pages.coalesce(1), "2")):
        again, old = shared.shared_dir(spark, "w"), spark.conf.get("spark.sql.shuffle.partitions")
        spark.conf.set("spark.sql.shuffle.partitions", partitions)
        warc.write_warc(source, again, 0, roll_bytes=2000, shard_bytes=20_000)
        spark.conf.set("spark.sql.shuffle.partitions", old)
        fs, path = shared.store(f"{again}/archive")
        bytes_of.append({x.base_name: fs.open_input_file(x.path).readall() for x in fs.get_file_info(pafs.FileSelector(path))})
        assert rows_of(spark, again) == rows_of(spark, directory)
    assert len(bytes_of[0]) > 3 and bytes_of[0] == bytes_of[1] == bytes_of[2]
    revisits = [warc.parse(m)[0] for body in bytes_of[0].values() for m in warc.members(io.BytesIO(body)) if b"WARC-Type: revisit" in m]
    assert {r["warc-refers-to-target-uri"] for r in revisits} == {"http://h/198", "a%20b%0Ac"} and all(r["warc-refers-to-date"] == r["warc-date"] for r in revisits)


def test_repeated_rows_and_empty_table(spark):
    pages = spark.createDataFrame([(1, "u", "a"), (1, "u", "a"), (1, "v", "b"), (2, "w", "b")], "page_id long, url string, html string")
    directory = shared.shared_dir(spark, "w")
    warc.write_warc(pages, directory)
    assert sorted((r.page_id, r.url, r.record_type, r.refers_to or 0) for r in warc.read_warc(spark, directory).collect()) == [(1, "u", "response", 0), (1, "u", "revisit", 1), (1, "v", "revisit", 2), (2, "w", "response", 0)]
    empty = shared.shared_dir(spark, "w")
    assert warc.write_warc(pages.limit(0), empty).count() == 0
    assert warc.read_warc(spark, empty).count() == 0


def test_split_points_divide_bytes(spark):
    rng = random.Random(1)
    keys = [rng.randrange(1000) for _ in range(3000)] + [10**18 + rng.randrange(50) for _ in range(3000)] + [7] * 2000 + [None] * 10
    rows = spark.createDataFrame([(k,) for k in keys], "k long")
    points = ranges.split_points(rows, "k", F.lit(10), least=4000)
    assert points == sorted(set(points)) and points == ranges.split_points(rows.repartition(5), "k", F.lit(10), least=4000)
    got = rows.select("k", ranges.range_of("k", points).alias("r")).groupBy("r").agg(F.count("*").alias("n"), F.countDistinct("k").alias("kinds")).collect()
    assert len(got) > 10 and all(r.n <= 810 or r.kinds == 1 for r in got)
    assert ranges.split_points(rows.limit(0), "k", F.lit(1)) == []
