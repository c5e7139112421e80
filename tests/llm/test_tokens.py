from __future__ import annotations

import hashlib
import struct
import zlib

import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from prescriva.llm import binary_ids, pieces, sharded, shared

TEXTS = ["", "a", " ", "  two  spaces ", "a ", "Hello, world's <|endoftext|> x", "été ▁ mark　wide\r\n\ttab\x1cfs", "long" * 5000, "word " * 3000, "ﬁ Ǻ é", "naïve Σίσυφος ΣΑΣ 12345"]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "x", i) for i, t in enumerate(TEXTS)] + [(90, None, "y", 1), (7, "tie b", "z", 2), (7, "tie a", "z", 2), (None, "no id", "z", 3)]
    return spark.createDataFrame(rows, "doc_id long, text string, n_tokens string, start int")


def test_ids_equal_the_library_and_come_back(spark, docs):
    from tokenizers import Tokenizer

    path = public_tokenizers.path(binary_ids.TOKENIZER)
    library = Tokenizer.from_file(path)
    directory = shared.shared_dir(spark, "t")
    manifest = binary_ids.write_ids(docs, directory, path)
    got = sorted(binary_ids.read_ids(spark, directory).collect(), key=lambda r: r.start)
    rows = sorted(docs.collect(), key=lambda r: (-1 if r.doc_id is None else r.doc_id, r.text or ""))
    start = 0
    for r, g in zip(rows, got, strict=True):
        ids = [*library.encode(r.text or "", add_special_tokens=False).ids, 2]
        assert (g.doc_id, g.start, g.n_tokens, g.ids_crc32) == (r.doc_id, start, len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids)))
        start += len(ids)
    shard = manifest.orderBy("shard").first()
    reader = binary_ids.ShardReader(f"{directory}/shards", shard.file)
    assert [x for _, x in reader.documents()] == [reader.document(i) for i in range(len(reader.entries))]


def test_only_requested_documents(spark, monkeypatch):
    from tokenizers import Tokenizer

    path = public_tokenizers.path(binary_ids.TOKENIZER)
    library = Tokenizer.from_file(path)
    rows = [(i * 3, f"text number {i} " * (i % 9 + 1)) for i in range(400)] + [(30, "a twin"), (None, "no id"), (None, "none either"), (-(2**63), "least")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    directory = shared.shared_dir(spark, "t")
    manifest = binary_ids.write_ids(docs, directory, path, shard_bytes=5000).orderBy("shard").collect()
    assert len(manifest) > 5 and manifest[1].first_id > manifest[0].last_id
    wanted = spark.createDataFrame([(x,) for x in (30, 30, 31, 0, 1197, 600, None, -(2**63), 10**12)], "doc_id long")
    got = sorted(((r.doc_id, list(r.ids)) for r in binary_ids.read_documents(wanted, directory).collect()), key=str)
    assert got == sorted(((i, [*library.encode(t, add_special_tokens=False).ids, 2]) for i, t in rows if i in (30, 0, 1197, 600, None, -(2**63))), key=str)
    assert binary_ids.read_documents(wanted.limit(0), directory).count() == 0


def test_chunks_of_tokens_against_the_library():
    from hypothesis import given, settings
    from hypothesis import strategies as st
    from tokenizers import Tokenizer

    path = public_tokenizers.path(binary_ids.TOKENIZER)
    library = Tokenizer.from_file(path)

    @settings(max_examples=300, deadline=None)
    @given(st.text(alphabet="abAB \n\té1.'　世\x1c\x85-ΣΑ\u0301\ue000", max_size=40))
    def same(text):
        ids = [*library.encode(text, add_special_tokens=False).ids, 2]
        assert binary_ids.encode(pa.array([None, text, ""]), path, 2)[1:2] == [struct.pack(f"<{len(ids)}I", *ids)]

    same()


def test_a_damaged_frame_is_found(spark, docs):
    directory = shared.shared_dir(spark, "t")
    shard = binary_ids.write_ids(docs, directory, public_tokenizers.path(binary_ids.TOKENIZER)).first()
    path = f"{shared.store(directory)[1]}/shards/{shard.file}"
    data = bytearray(open(path, "rb").read())
    data[binary_ids.ShardReader(f"{directory}/shards", shard.file).entries[0, 0] - 2] ^= 255
    open(path, "wb").write(data)
    with pytest.raises(Exception):  # noqa: B017
        binary_ids.ShardReader(f"{directory}/shards", shard.file).document(0)


def test_empty_table(spark, docs):
    directory = shared.shared_dir(spark, "t")
    binary_ids.write_ids(docs.limit(0), directory, public_tokenizers.path(binary_ids.TOKENIZER))
    assert binary_ids.read_ids(spark, directory).count() == 0
    assert pieces.digests(docs.limit(0), public_tokenizers.path(pieces.MODEL)).count() == 0


def test_pieces_equal_the_library(docs):
    import sentencepiece

    path = public_tokenizers.path(pieces.MODEL)
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    texts = sorted((r.text or "" for r in docs.collect()))
    wanted = sorted((len(ids := sp.encode(t)), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(sp.decode(ids).encode()).hexdigest()) for t in texts)
    assert sorted((r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in pieces.digests(docs, path).collect()) == wanted
    whole = {r.piece_text: r for r in pieces.with_pieces(docs.withColumn("piece_ids", docs.start), path).collect()}
    assert whole["Hello, world's <|endoftext|> x"].piece_ids == sp.encode("Hello, world's <|endoftext|> x")


def test_chunks_against_whole_texts():
    import sentencepiece
    from hypothesis import given, settings
    from hypothesis import strategies as st

    path = public_tokenizers.path(pieces.MODEL)
    sp, coder = sentencepiece.SentencePieceProcessor(model_file=path), pieces.PieceCoder(path)

    @settings(max_examples=300, deadline=None)
    @given(st.text(alphabet="ab ▁\n\té1.　世", max_size=40))
    def same(text):
        assert [int(x) for ids in coder.segment(coder.chunks(text)) if ids for x in ids.split(",")] == sp.encode(text)

    same()


def test_pieces_over_files_row_groups_and_splits(spark, tmp_path, monkeypatch):
    import sentencepiece

    monkeypatch.setattr(sharded, "ROWS", 8)
    path = public_tokenizers.path(pieces.MODEL)
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    rows = [(i, f"{TEXTS[i % len(TEXTS)][:200]} number {i} of these {'x' * (i % 7)}") for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    docs.repartition(3).write.option("parquet.block.size", 1).option("parquet.page.size", 100).option("parquet.block.size.row.check.min", 5).option("parquet.block.size.row.check.max", 5).option("parquet.page.size.row.check.min", 5).parquet(str(tmp_path / "d"))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "300")
    try:
        frame = spark.read.parquet(str(tmp_path / "d"))
        tasks = sharded.with_blocks(frame, []).withColumn("task", F.spark_partition_id()).distinct().groupBy("block").agg(F.countDistinct("task").alias("n"))
        assert tasks.agg(F.max("n")).first()[0] > 1  # a block that several tasks read
        got = pieces.with_pieces(spark.read.parquet(str(tmp_path / "d")), path, decoded=None).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert {r.doc_id: list(r.piece_ids) for r in got} == {i: sp.encode(t) for i, t in rows} and len(got) == 300
