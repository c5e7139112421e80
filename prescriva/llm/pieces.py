"""SentencePiece encoding and decoding by a table of distinct marked chunks (operator 5).

The library writes each space as a marker and puts one before the text. No piece of the
model has a marker after another character (checked when the model is loaded), so that
no merge crosses the place where a marker follows a word: the ids of a text are those of
its chunks "markers + word", one after another. Each block of documents sends its
distinct chunks to shards (``sharded``); a shard has every chunk of the corpus that
hashes to it, segments each distinct one once and answers each block; a second scan
joins the ids back by position beside the documents. Texts are never shuffled, and a
chunk is sent once by a block however often it occurs there. A model with pieces that
cross markers is encoded text by text.

Defined results: a null text is an empty one and has no ids; rows are independent, so
repeated rows and other columns change nothing; an empty table gives an empty one.
"""

from __future__ import annotations

import hashlib
import itertools
import struct
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField, StructType

from prescriva.llm import sharded, shared

MODEL = "piece_bpe_32k.model"
_PACK, _UNPACK = zstandard.ZstdCompressor(level=6), zstandard.ZstdDecompressor()
MARK = "▁"


class PieceCoder:
    """Encodes and decodes with one model; ``by_chunks`` is false where chunks aren't independent."""

    _kept: dict[str, PieceCoder] = {}

    def __init__(self, path: str):
        import sentencepiece

        self.sp = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = (self.sp.id_to_piece(i) for i in range(self.sp.get_piece_size()))
        crossing = any(MARK in p.lstrip(MARK) for p in pieces)
        plain = "".join(self.sp.encode("  a  ", out_type=str)) == MARK * 3 + "a" + MARK * 2
        self.by_chunks = plain and not crossing
        self.lone = ",".join(map(str, self.sp.encode("a ")[len(self.sp.encode("a")) :]))

    @classmethod
    def of(cls, path: str) -> PieceCoder:
        if path not in cls._kept:
            cls._kept[path] = cls(path)
        return cls._kept[path]

    def segment(self, chunks: list[str]) -> Iterator[str]:
        """Ids of each chunk in decimal, joined."""
        for chunk, ids in zip(chunks, self.sp.encode(chunks, num_threads=1), strict=True):
            yield ",".join(map(str, ids)) if chunk else self.lone

    @staticmethod
    def chunks(text: str) -> list[str]:
        """What the library has to encode for each marked chunk: its first marker is left out, as the library adds it; "" is a marker alone."""
        if not text:
            return []
        words = text.replace(MARK, " ").split(" ")
        if "" not in words:
            return words
        out, markers = [], 0
        for word in words:
            markers += 1
            if word:
                out.append(" " * (markers - 1) + word)
                markers = 0
        if markers:
            out.append(" " * (markers - 1))
        return out

    def decode(self, ids: list[int]) -> str:
        return self.sp.decode(ids)


def packed(strings: list[str]) -> bytes:
    body = [x.encode() for x in strings]
    lengths = sharded.pack(np.array([len(x) for x in body], dtype=np.uint64), ascending=0)
    return struct.pack("<I", len(lengths)) + lengths + _PACK.compress(b"".join(body))


def unpacked(body: bytes) -> list[str]:
    size = struct.unpack_from("<I", body)[0]
    ends = np.cumsum(sharded.unpack(body[4 : 4 + size], ascending=0)[0]).tolist()
    whole = _UNPACK.decompress(body[4 + size :])
    return [whole[s:e].decode() for s, e in itertools.pairwise([0, *map(int, ends)])]


def chunk_tables(docs: DataFrame, model_path: str) -> sharded.Folder:
    """A folder that tells each block of the file-based ``docs`` the ids of its distinct chunks."""
    shards = sharded.shards_of(docs)

    def ask(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, parts in itertools.groupby(sharded.by_block(batches), lambda x: x[0]):
            seen: set[str] = set()
            for _, batch in parts:
                seen.update(*map(PieceCoder.chunks, shared.texts(batch)))
            dealt: dict[int, list[str]] = {}
            for chunk in sorted(seen):
                dealt.setdefault(zlib.crc32(chunk.encode()) % shards, []).append(chunk)
            rows = list(dealt.items())
            for at in range(0, len(rows), 64):
                own = rows[at : at + 64]
                yield sharded.asked_rows([s for s, _ in own], block, 0, [packed(c) for _, c in own])
        shared.give_back()

    def reply(shard: int, rows: list[tuple[int, int, bytes]]) -> Iterator[tuple[int, int, int, bytes]]:
        coder, asked = PieceCoder.of(model_path), [(block, unpacked(body)) for block, _, body in rows]
        distinct = list(set().union(*(c for _, c in asked)))
        table: dict[str, str] = {}
        for at in range(0, len(distinct), 20_000):
            part = distinct[at : at + 20_000]
            table.update(zip(part, coder.segment(part), strict=True))
        for block, chunks in asked:
            named = packed(chunks)
            yield shard, block, len(named), named + packed([table[c] for c in chunks])

    asked = sharded.with_blocks(docs, ["text"]).select("text", "block").mapInArrow(ask, sharded.ASKED)
    # A body has the chunks, as many bytes as its kind says, and then their ids; a block that two tasks read has two for a shard.
    return sharded.write_answers(sharded.answer(asked, reply), "chunks", shards)


class _Encoder:
    """Ids of texts in a task, by the table of their block."""

    def __init__(self, model_path: str, folder: sharded.Folder | None):
        self.coder = PieceCoder.of(model_path)
        self.answers, self.block, self.table = sharded.Answers(folder) if folder else None, None, {}

    def encode(self, block: int, texts: list[str]) -> Iterator[tuple[list[int], str]]:
        """For each text its ids, and them in decimal joined by commas."""
        if self.answers is None:
            for ids in self.coder.sp.encode(texts, num_threads=1):
                yield ids, ",".join(map(str, ids))
            return
        if block != self.block:
            self.block, self.table = block, {}
            for size, body in self.answers.rows(block, ["kind", "body"]):
                self.table.update(zip(unpacked(body[:size]), unpacked(body[size:]), strict=True))
        table = self.table
        for text in texts:
            joined = ",".join([v for c in PieceCoder.chunks(text) if (v := table[c])])
            yield (list(map(int, joined.split(","))) if joined else []), joined


def _coded(docs: DataFrame, model_path: str, kept: list[str], code, fields: list[StructField]) -> DataFrame:
    """``kept`` columns of ``docs`` and what ``code(ids, joined, decode)`` makes of each text: one value for each of ``fields``."""
    docs = sharded.from_files(docs)
    folder = chunk_tables(docs, model_path) if PieceCoder.of(model_path).by_chunks else None
    whole = F.struct(*kept) if kept else F.struct(F.lit(0).alias("none"))
    ready = sharded.with_blocks(docs.withColumn("whole_row", whole), ["whole_row", "text"])  # docs may have columns called block or row

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _Encoder(model_path, folder)
        for block, batch in sharded.by_block(batches):
            made = [code(ids, joined, encoder.coder.decode) for ids, joined in encoder.encode(block, shared.texts(batch))]
            columns = list(zip(*made, strict=True))
            rows = batch.column("whole_row")
            arrays = [rows.field(c) for c in kept] + [pa.array(c, to_arrow_type(f.dataType)) for c, f in zip(columns, fields, strict=True)]
            yield pa.RecordBatch.from_arrays(arrays, names=kept + [f.name for f in fields])
        shared.give_back()

    return ready.mapInArrow(run, StructType([docs.schema[c] for c in kept] + fields))


def with_pieces(docs: DataFrame, model_path: str, ids: str = "piece_ids", decoded: str | None = "piece_text", columns: list[str] | None = None) -> DataFrame:
    """``docs`` with the ids of ``text`` and, where asked for, what they decode to.

    An existing column of either new name is replaced.
    """
    kept = [c for c in (columns or docs.columns) if c not in (ids, decoded)]
    fields = [StructField(ids, ArrayType(IntegerType()))] + ([StructField(decoded, StringType())] if decoded else [])
    return _coded(docs, model_path, kept, lambda own, _, decode: (own, decode(own))[: len(fields)], fields)


def digests(docs: DataFrame, model_path: str) -> DataFrame:
    """Per document: doc_id, n_tokens, ids_sha256, decoded_sha256; made where the ids are, so that they need not leave the worker."""

    def code(ids: list[int], joined: str, decode) -> tuple[int, str, str]:
        return len(ids), hashlib.sha256(joined.encode()).hexdigest(), hashlib.sha256(decode(ids).encode()).hexdigest()

    fields = [StructField("n_tokens", LongType()), StructField("ids_sha256", StringType()), StructField("decoded_sha256", StringType())]
    return _coded(docs, model_path, ["doc_id"], code, fields)


def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All of ``documents`` encoded and decoded; digests of both."""
    import public_tokenizers

    return digests(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path(MODEL))
