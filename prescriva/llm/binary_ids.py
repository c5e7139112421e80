"""Token ids in a seekable binary format (operator 4).

A shard file is a row of independent zstandard frames, one per document, each holding
the document's ids as little-endian unsigned 32-bit integers. Two skippable frames end
it: how many documents have no id, and the documents' ids (signed 64-bit), then the public
seek table of the zstd seekable format: compressed size, decompressed size and the low 32 bits of the content's XXH64
for each frame, and a nine-byte footer. A reader takes the footer, the table and then
only the frames that it was asked for; a frame whose checksum differs is an error.

Documents are dealt to shards by ranges of doc_id (``ranges``: the same documents give the
same shards) and sorted in them, so that shard order is document order. The manifest has
each shard's first and last doc_id, by which ``read_documents`` opens only the shards and
frames that it was asked for. A shard is written under a temporary name of its own and
renamed when complete; only shards that the manifest names belong to the data set, and
a task that runs again writes the same bytes.

Defined results: a null text is an empty one (it has the end id only); rows with equal
doc_id are kept, ordered by their texts, in one shard; rows with a null doc_id come first
and are read back as null; an empty table gives no shard.
"""

from __future__ import annotations

import itertools
import json
import os
import re
import struct
import uuid
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prescriva.llm import ranges, shared
from prescriva.llm.chunktable import ChunkTable

SKIPPABLE = 0x184D2A5E  # fixed: skippable frame that holds a seek table
SEEKABLE = 0x8F92EAB1  # fixed: last word of a seek table
IDS_FRAME = 0x184D2A50
#: A private-use character: between two spaces it is a word of its own.
FENCE = "\ue000"
TOKENIZER = "word_bpe_49k.json"
MANIFEST = "shard int, file string, documents long, tokens long, bytes long, first_id long, last_id long"

#: What the short ways below follow; a tokenizer with other rules gets its chunks as they are, and whole.
RULES = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
}
#: Printable ASCII and Latin-1's letters with a case: NFC keeps them, their lower case is among them, and ``PIECE`` cuts that as the tokenizer does.
PLAIN = re.compile(r"[!-~À-ÖØ-öø-ÿ]*")
PIECE = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-zß-öø-ÿ0-9]+")
#: Characters one of which could be a mark that NFC joins to a letter before it, which small and capital letters may do differently.
MARKS = r"[^\x00-\x{2ff}\x{2010}-\x{205e}]"
#: A letter or digit before ASCII punctuation: the tokenizer always cuts there.
BORDER = r"([0-9A-Za-zÀ-ÖØ-öø-ÿ])([!-/:-@\[-`{-~])"

_TABLES: dict[str, tuple[ChunkTable, str | None]] = {}


def _added(path: str) -> str | None:
    """What all added tokens begin with, where the tokenizer follows ``RULES``: a text without it holds none of them."""
    with open(path, encoding="utf-8") as file:
        rules = json.load(file)
    added = os.path.commonprefix([t["content"] for t in rules["added_tokens"]])
    return added if added and all(rules[k] == v for k, v in RULES.items()) else None


def _spread(texts: pa.Array, added: str) -> pa.Array:
    """``texts`` with the same ids and fewer distinct chunks: punctuation behind words stands alone, and ASCII letters are small where no mark can follow one."""
    cut = pc.replace_substring_regex(texts, BORDER, r"\1 \2")
    small = pc.if_else(pc.match_substring_regex(texts, MARKS), cut, pc.ascii_lower(cut))
    return pc.if_else(pc.match_substring(texts, added), texts, small)


def _table(path: str) -> tuple[ChunkTable, str | None]:
    """This worker's table: a chunk between ASCII white space -> its ids as bytes; and what ``_added`` says.

    The tokenizer drops white space before it segments and nothing it does looks across
    it (an empty chunk, before or behind all others, has no ids), so that a text's ids are those of its chunks, one after another.
    """
    if path not in _TABLES:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        tokenizer = Tokenizer.from_file(path)
        fence = tokenizer.encode(FENCE, add_special_tokens=False).ids
        added, merge = _added(path), tokenizer.model.tokenize
        spell = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False).pre_tokenize_str

        def alone(chunks: list[str]) -> Iterator[bytes]:
            for one in tokenizer.encode_batch_fast(chunks, add_special_tokens=False):
                yield struct.pack(f"<{len(one.ids)}I", *one.ids)

        def whole(chunks: list[str]) -> list[bytes]:
            """Many chunks in one text, with a fence between them that none of them has: a call for each costs more than its merges."""
            fenced = [i for i, c in enumerate(chunks) if FENCE in c] if fence else range(len(chunks))
            other = dict(zip(fenced, alone([chunks[i] for i in fenced]), strict=True))
            rest = [i for i in range(len(chunks)) if i not in other] if other else range(len(chunks))
            out: list[bytes] = [other.get(i, b"") for i in range(len(chunks))]
            for at in range(0, len(rest), 2000):
                own = rest[at : at + 2000]
                text = f" {FENCE} ".join([chunks[i] for i in own])
                ids = np.array(tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, dtype="<u4")
                last = len(ids) - len(fence) + 1
                cut = np.flatnonzero(np.logical_and.reduce([ids[k : last + k] == f for k, f in enumerate(fence)]))
                body = ids.tobytes()
                for i, s, e in zip(own, [0, *(4 * (cut + len(fence))).tolist()], [*(4 * cut).tolist(), len(body)], strict=True):
                    out[i] = body[s:e]
            return out

        def by_pieces(chunk: str) -> bytes:
            """A plain chunk's ids by the library's model alone, without its normalizers' and splits' cost."""
            ids = [token.id for piece in PIECE.findall(chunk.lower()) for token in merge(piece if piece.isascii() else spell(piece)[0][0])]
            return struct.pack(f"<{len(ids)}I", *ids)

        def work_out(chunks: list[str]) -> list[bytes]:
            plain = [added is not None and PLAIN.fullmatch(c) is not None and added not in c for c in chunks]
            rest = iter(whole([c for c, p in zip(chunks, plain, strict=True) if not p]))
            return [by_pieces(c) if p else next(rest) for c, p in zip(chunks, plain, strict=True)]

        _TABLES[path] = ChunkTable(work_out), added
    return _TABLES[path]


def encode(column: pa.Array, path: str, end_id: int) -> list[bytes]:
    """Ids of each text, with the end id, as little-endian bytes; a null is empty."""
    table, added = _table(path)
    texts = pc.fill_null(column, "")
    as_is = added is None or texts.nbytes > 64 << 20  # more than a batch: one huge text, of which there should be no more copies
    words = pc.ascii_split_whitespace(texts if as_is else _spread(texts, added))
    end = struct.pack("<I", end_id)
    coded = words.flatten().dictionary_encode()
    if not len(coded):
        return [end] * len(column)
    parts = table.lookup(coded.dictionary.to_numpy(zero_copy_only=False).tolist())
    flat = pa.array(parts, pa.large_binary()).take(coded.indices)
    starts, data = np.frombuffer(flat.buffers()[1], dtype=np.int64), memoryview(flat.buffers()[2] or b"")
    offsets = words.offsets.to_numpy()
    cuts = starts[offsets - offsets[0]].tolist()
    return [bytes(data[s:e]) + end for s, e in itertools.pairwise(cuts)]


class ShardWriter:
    """Appends documents to one shard; ``close`` writes the tables and commits it under its name."""

    def __init__(self, directory: str, name: str, level: int = 3):
        self.fs, path = shared.store(directory)
        self.fs.create_dir(path, recursive=True)
        self.name, self.final = name, f"{path}/{name}"
        self.temporary = f"{path}/_{name}.{uuid.uuid4().hex}"
        self.out = self.fs.open_output_stream(self.temporary, compression=None)
        self.compress = zstandard.ZstdCompressor(level=level).compress
        self.entries: list[tuple[int, int, int]] = []
        self.doc_ids: list[int] = []
        self.tokens = self.nulls = 0

    def add(self, doc_id: int | None, ids: bytes) -> None:
        frame = self.compress(ids)
        self.out.write(frame)
        self.entries.append((len(frame), len(ids), xxhash.xxh64_intdigest(ids) & 0xFFFFFFFF))
        self.nulls += doc_id is None
        self.doc_ids.append(0 if doc_id is None else doc_id)
        self.tokens += len(ids) // 4

    def close(self) -> tuple[str, int, int, int, int | None, int | None]:
        ids = struct.pack("<q", self.nulls) + np.array(self.doc_ids, dtype="<i8").tobytes()
        table = b"".join(struct.pack("<III", *e) for e in self.entries)
        self.out.write(struct.pack("<II", IDS_FRAME, len(ids)) + ids)
        self.out.write(struct.pack("<II", SKIPPABLE, len(table) + 9) + table + struct.pack("<IBI", len(self.entries), 0x80, SEEKABLE))
        size = self.out.tell()
        self.out.close()
        shared.commit(self.fs, self.temporary, self.final)
        known = self.doc_ids[self.nulls :]
        return self.name, len(self.entries), self.tokens, size, (known[0] if known else None), (known[-1] if known else None)


class ShardReader:
    """Reads documents of a shard by position; decompresses only what is asked for."""

    def __init__(self, directory: str, name: str):
        fs, path = shared.store(directory)
        self.file = fs.open_input_file(f"{path}/{name}")
        size = self.file.size()
        count, flags, magic = struct.unpack("<IBI", self.file.read_at(9, size - 9))
        if magic != SEEKABLE or not flags & 0x80:
            raise ValueError(f"{name}: no seek table with checksums")
        self.entries = np.frombuffer(self.file.read_at(12 * count, size - 9 - 12 * count), dtype="<u4").reshape(count, 3)
        self.starts = np.concatenate([[0], np.cumsum(self.entries[:, 0], dtype=np.int64)])
        ids = np.frombuffer(self.file.read_at(8 * count + 8, size - 9 - 12 * count - 16 - 8 * count), dtype="<i8")
        self.nulls, self.doc_ids = int(ids[0]), ids[1:]
        self.decompressor = zstandard.ZstdDecompressor()

    def _frame(self, i: int, frame: bytes) -> bytes:
        length, check = int(self.entries[i, 1]), int(self.entries[i, 2])
        ids = self.decompressor.decompress(frame, max_output_size=length) if length else b""
        if len(ids) != length or xxhash.xxh64_intdigest(ids) & 0xFFFFFFFF != check:
            raise ValueError(f"frame {i}: wrong checksum")
        return ids

    def document(self, i: int) -> bytes:
        """Ids of the i-th document of the shard, from its own frame alone."""
        return self._frame(i, self.file.read_at(int(self.entries[i, 0]), int(self.starts[i])))

    def positions(self, doc_id: int | None) -> range:
        """Where the documents with an id are."""
        if doc_id is None:
            return range(self.nulls)
        known = self.doc_ids[self.nulls :]
        return range(self.nulls + int(np.searchsorted(known, doc_id)), self.nulls + int(np.searchsorted(known, doc_id, "right")))

    def documents(self) -> Iterator[tuple[int | None, bytes]]:
        """All documents in order, read some MB at a time."""
        i, n = 0, len(self.entries)
        while i < n:
            j = max(i + 1, int(np.searchsorted(self.starts, self.starts[i] + (4 << 20), "right")) - 1)
            block = self.file.read_at(int(self.starts[j] - self.starts[i]), int(self.starts[i]))
            for k in range(i, j):
                at = int(self.starts[k] - self.starts[i])
                yield (None if k < self.nulls else int(self.doc_ids[k])), self._frame(k, block[at : at + int(self.entries[k, 0])])
            i = j


def write_ids(docs: DataFrame, directory: str, tokenizer_path: str, end_id: int = 2, level: int = 3, shard_bytes: int = ranges.LEAST) -> DataFrame:
    """Encode ``docs`` (doc_id, text) into shards below ``directory``; returns the manifest, one row per shard.

    The manifest is itself a table beside the shards (``directory``/manifest). Texts are
    shuffled once, by ranges of doc_id; encoding happens behind that shuffle, so that no
    ids are shuffled.
    """
    spark = docs.sparkSession
    shared.small_batches(spark)
    shards = f"{directory}/shards"

    def write(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, writer, done = None, None, []
        for batch in batches:
            ids = encode(batch.column("text"), tokenizer_path, end_id)
            for shard, doc_id, one in zip(batch.column("shard").to_pylist(), batch.column("doc_id").to_pylist(), ids, strict=True):
                if shard != now:
                    done += [(now, *writer.close())] if writer else []
                    now, writer = shard, ShardWriter(shards, f"part-{shard:07d}.ids.zst", level)
                writer.add(doc_id, one)
        done += [(now, *writer.close())] if writer else []
        if done:
            types = [pa.int32(), pa.string(), *[pa.int64()] * 5]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done, strict=True), types, strict=True)], names=["shard", "file", "documents", "tokens", "bytes", "first_id", "last_id"])

    points = ranges.split_points(docs, "doc_id", F.coalesce(F.octet_length("text"), F.lit(0)) + 64, shard_bytes)
    dealt = docs.select("doc_id", "text").withColumn("shard", ranges.range_of("doc_id", points))
    ordered = dealt.repartitionById(len(points) + 1, F.col("shard")).sortWithinPartitions("shard", "doc_id", "text")
    with shared.step(spark):
        ordered.mapInArrow(write, MANIFEST).write.parquet(f"{directory}/manifest")
    shared.remove_unfinished(shards)
    return spark.read.schema(MANIFEST).parquet(f"{directory}/manifest")


def read_documents(wanted: DataFrame, directory: str) -> DataFrame:
    """(doc_id, ids) of the documents whose doc_id is in ``wanted``; opens the shards that have one and decompresses its frame alone.

    An id that no document has gives no row, one that several have gives all of them,
    a null id gives those without an id, and a repeated one counts once.
    """
    spark, source = wanted.sparkSession, f"{directory}/shards"
    manifest = spark.read.schema(MANIFEST).parquet(f"{directory}/manifest").orderBy("shard").collect()  # a row for each shard
    firsts = [r.first_id for r in manifest if r.first_id is not None]
    files = [r.file for r in manifest]
    if not files:
        return spark.createDataFrame([], "doc_id long, ids array<long>")
    # The lowest shard may hold null ids alone; ids below the first border are looked for in it and in the next.
    skipped = len(files) - len(firsts)
    asked = wanted.select(F.col("doc_id").cast("long").alias("doc_id")).distinct()
    at = F.greatest(ranges.range_of("doc_id", firsts) - 1, F.lit(0)) + skipped if firsts else F.lit(0)
    asked = asked.withColumn("shard", F.when(F.col("doc_id").isNull(), F.lit(0)).otherwise(at))

    def read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, reader = None, None
        for batch in batches:
            out = []
            for shard, doc_id in zip(batch.column("shard").to_pylist(), batch.column("doc_id").to_pylist(), strict=True):
                if shard != now:
                    now, reader = shard, ShardReader(source, files[shard])
                out += [(doc_id, np.frombuffer(reader.document(i), dtype="<u4")) for i in reader.positions(doc_id)]
            for s in range(0, len(out), 500):
                part = out[s : s + 500]
                yield pa.RecordBatch.from_arrays([pa.array([d for d, _ in part], pa.int64()), pa.array([x.astype(np.int64) for _, x in part], pa.list_(pa.int64()))], names=["doc_id", "ids"])

    return asked.repartition("shard").sortWithinPartitions("shard", "doc_id").mapInArrow(read, "doc_id long, ids array<long>")


def read_ids(spark: SparkSession, directory: str) -> DataFrame:
    """Per document, from the files alone: doc_id, start, n_tokens, ids_crc32.

    The manifest has a row per shard, that is per write task; their running sum is made
    on the driver and gives each shard the ids before it.
    """
    rows = spark.read.schema(MANIFEST).parquet(f"{directory}/manifest").orderBy("shard").collect()
    before = itertools.accumulate((r.tokens for r in rows), initial=0)
    plan = [(r.shard, r.file, b) for r, b in zip(rows, before, strict=False)]
    shards = spark.createDataFrame(plan, "shard int, file string, before long").repartition(max(1, len(plan)))
    source = f"{directory}/shards"

    def read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                start = row["before"]
                documents = ShardReader(source, row["file"]).documents()
                while part := list(itertools.islice(documents, 2000)):
                    counts = np.array([len(ids) // 4 for _, ids in part], dtype=np.int64)
                    starts = start + np.cumsum(counts) - counts
                    start += int(counts.sum())
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([d for d, _ in part], pa.int64()), pa.array(starts), pa.array(counts), pa.array([zlib.crc32(ids) for _, ids in part], pa.int64())],
                        names=["doc_id", "start", "n_tokens", "ids_crc32"],
                    )

    return shards.mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op4_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All of ``documents`` written as token ids and read back."""
    import public_tokenizers

    directory = shared.shared_dir(spark, "ids")
    write_ids(spark.read.parquet(f"{sf_dir}/documents.parquet"), directory, public_tokenizers.path(TOKENIZER))
    return read_ids(spark, directory).select("doc_id", F.col("start"), "n_tokens", "ids_crc32")
