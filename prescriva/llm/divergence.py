"""How far the sources of a language are from each other and from the language, by smoothed term shares, exactly.

Shares are whole billionths: p = 1 + floor(10^9 (count + 5) / (N + 5 V)) of each of the V
kept terms, N a source's occurrences of them. Two sources are as far apart as their p
differ, summed over all kept terms. Taken literally that is sources x sources x terms; it
is split in a heavy and a light part that are added up exactly:

* at their floors b = p(0), all terms make (terms) |b - b'| for a pair;
* a heavy term is in at least a quarter of the sources: numpy tiles of ``SIDE`` x ``SIDE``
  sources hold the p of a batch of such terms densely, and |p - p'| takes the floors' place;
* a light term leaves most sources at their floor. A source's own light terms, as a
  histogram of p, change |b - b'| to |p - b'|; and where two sources share a light term,
  a correction for the pair from the term's postings brings that to |p - p'|.

Texts are read once and counted in Arrow batches; then everything is (language, source,
term) rows. A tile's group is a chunk of terms and is streamed, so that a task holds
``2 SIDE`` x batch numbers whatever the vocabulary; postings of a light term are at most a
quarter of the sources. The result itself has a row for each pair of a language's sources.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from prescriva.llm import shared

LEAST_DOCS, SMOOTHING, SCALE, TOP = 30, 5, 1_000_000_000, 50
#: What parts terms: all of ASCII but letters.
PARTING = r"[\x00-\x40\x5B-\x60\x7B-\x7F]+"
#: A heavy term is in at least one of so many sources. Sources on a tile's side. Terms of a chunk, about.
HEAVY, SIDE, CHUNK = 4, 64, 1024
SENT_MOST = 8 << 20


def _batch_counts(batch: pa.RecordBatch) -> pa.RecordBatch:
    """(lang, source, term, n, docs): occurrences and documents of each term of each group; a row with a null term for each group."""
    docs = batch.num_rows
    lang, source = (batch.column(c).dictionary_encode() for c in ("lang", "source"))
    group = lang.indices.to_numpy(zero_copy_only=False).astype(np.int64) * len(source.dictionary) + source.indices.to_numpy(zero_copy_only=False)
    lists = pc.split_pattern_regex(pc.ascii_lower(batch.column("text").cast(pa.large_string())), pattern=PARTING)
    own = np.repeat(np.arange(docs), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
    words = lists.flatten()
    real = pc.not_equal(words, "")
    own, words = own[real.to_numpy(zero_copy_only=False)], words.filter(real).dictionary_encode()
    kinds = max(len(words.dictionary), 1)
    code = words.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    pair, times = np.unique(own * kinds + code, return_counts=True)  # a row for each document and term
    key, at = np.unique(group[pair // kinds] * kinds + pair % kinds, return_inverse=True)
    n, d = np.bincount(at, times, len(key)).astype(np.int64), np.bincount(at, minlength=len(key))
    seen, per = np.unique(group, return_counts=True)
    groups = np.concatenate([key // kinds, seen])
    terms = pa.concat_arrays([words.dictionary.take(pa.array(key % kinds)).cast(pa.large_string()), pa.nulls(len(seen), pa.large_string())])
    arrays = [lang.dictionary.take(pa.array(groups // len(source.dictionary))), source.dictionary.take(pa.array(groups % len(source.dictionary))), terms.cast(pa.string()), pa.array(np.concatenate([n, np.zeros(len(seen), np.int64)])), pa.array(np.concatenate([d, per]).astype(np.int64))]
    return pa.RecordBatch.from_arrays(arrays, names=["lang", "source", "term", "n", "docs"])


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs) of all documents, written; each group has a row with a null term and its documents. Nulls are empty texts."""
    shared.small_batches(docs.sparkSession)
    own = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield _batch_counts(batch)
        shared.give_back()

    found = own.mapInArrow(run, "lang string, source string, term string, n long, docs long")
    return shared.written(found.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")), "counts")


def share(count: Column, total: Column, kinds: Column, scale: int = SCALE, smoothing: int = SMOOTHING) -> Column:
    """p, exactly; null where there is no kept term."""
    whole = "decimal(38,0)"
    above, below = ((count + smoothing).cast(whole) * F.lit(scale).cast("decimal(12,0)")).cast(whole), (total + kinds * smoothing).cast(whole)
    return F.when(kinds > 0, 1 + F.call_function("div", above, below))


def _sent(df: DataFrame, *texts: str) -> DataFrame:
    """``df`` marked to be sent to all tasks, if its own bytes are few."""
    size = sum((F.octet_length(c) for c in texts), F.lit(64))
    return F.broadcast(df) if shared.small_enough(df, size, SENT_MOST) else df


class _Tile:
    """The pairs (i < j) of two blocks of sources over a chunk of terms."""

    def __init__(self, lang: str, first: int, second: int):
        self.lang, self.first, self.second = lang, first, second
        self.ids, self.floors, self.kinds = np.empty(0, np.int64), np.empty(0, np.int64), 0
        self.waiting: list[pa.RecordBatch] = []
        self.sums: np.ndarray | None = None

    def floor_rows(self, rows: pa.RecordBatch) -> None:
        """Sources in order: a source's floor b in ``p``, the number of terms that it counts for in ``k``."""
        self.ids, self.floors = np.append(self.ids, rows.column("i").to_numpy()), np.append(self.floors, rows.column("p").to_numpy())
        self.kinds = max(self.kinds, int(rows.column("k").to_numpy().max(initial=0)))

    def begin(self) -> None:
        """sums[i, j] and sums[j, i] are added at the end: what a pair has in common stands above the diagonal."""
        if self.sums is None:
            self.sums = np.triu(np.abs(self.floors[:, None] - self.floors) * self.kinds, 1)

    def heavy_rows(self, rows: pa.RecordBatch | None) -> None:
        """A heavy term's p in rows sorted by term. The last term waits for its other rows; None: there are none."""
        self.begin()
        self.waiting += [] if rows is None else [rows]
        if not self.waiting or rows is not None and sum(x.num_rows for x in self.waiting) < 1 << 16:
            return
        table = pa.Table.from_batches(self.waiting).combine_chunks()
        term, end = table.column("term"), table.num_rows
        if rows is not None:
            end = int(np.argmax(pc.equal(term, term[-1]).to_numpy()))
        self.waiting = table.slice(end).to_batches()
        table = table.slice(0, end)
        code = table.column("term").combine_chunks().dictionary_encode().indices.to_numpy(zero_copy_only=False)
        at, p = np.searchsorted(self.ids, table.column("i").to_numpy()), table.column("p").to_numpy()
        for start in range(0, int(code.max(initial=-1)) + 1, CHUNK):
            inside = (code >= start) & (code < start + CHUNK)
            dense = np.repeat(self.floors[:, None], int(code[inside].max()) + 1 - start, axis=1)
            dense[at[inside], code[inside] - start] = p[inside]
            for row in range(len(dense) - 1):
                self.sums[row, row + 1 :] += np.abs(dense[row + 1 :] - dense[row]).sum(axis=1) - dense.shape[1] * np.abs(self.floors[row + 1 :] - self.floors[row])

    def light_rows(self, rows: pa.RecordBatch) -> None:
        """So many light terms (``k``) of a source with a p: against sources that have none of them."""
        self.heavy_rows(None)
        at, p, k = np.searchsorted(self.ids, rows.column("i").to_numpy()), rows.column("p").to_numpy(), rows.column("k").to_numpy()
        for row in np.unique(at):
            own = at == row
            self.sums[row] += (np.abs(p[own][:, None] - self.floors) * k[own][:, None]).sum(axis=0) - k[own].sum() * np.abs(self.floors[row] - self.floors)

    def result(self) -> pa.RecordBatch:
        self.heavy_rows(None)
        block = self.ids // SIDE
        i, j = np.nonzero(np.less.outer(self.ids, self.ids) & np.logical_and.outer(block == self.first, block == self.second))
        return pa.RecordBatch.from_arrays([pa.array([self.lang] * len(i), pa.string()), pa.array(self.ids[i]), pa.array(self.ids[j]), pa.array((self.sums + self.sums.T)[i, j])], names=["lang", "i", "j", "value"])


def _spans(batch: pa.RecordBatch, columns: list[str]) -> Iterator[pa.RecordBatch]:
    """Slices of a batch in which these columns stay the same."""
    cut = np.zeros(batch.num_rows, dtype=bool)
    cut[:1] = True
    for c in columns:
        own = batch.column(c).dictionary_encode().indices.to_numpy(zero_copy_only=False)
        cut[1:] |= own[1:] != own[:-1]
    starts = [*np.flatnonzero(cut).tolist(), batch.num_rows]
    for start, end in zip(starts, starts[1:], strict=False):
        yield batch.slice(start, end - start)


def _tiles(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of pairs over rows that are sorted by lang, ti, tj, chunk, kind, term and i."""
    key, tile = None, None
    for batch in batches:
        for part in _spans(batch, ["lang", "ti", "tj", "chunk", "kind"]):
            now = tuple(part.column(c)[0].as_py() for c in ("lang", "ti", "tj", "chunk"))
            if now != key:
                if tile:
                    yield tile.result()
                key, tile = now, _Tile(*now[:3])
            (tile.floor_rows, tile.heavy_rows, tile.light_rows)[part.column("kind")[0].as_py()](part)
    if tile:
        yield tile.result()


def _corrections(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of pairs (i < j) over rows (lang, term, i, p, b) that are sorted by lang, term and i: what sharing light terms changes."""
    held: pa.Table | None = None

    def pairs(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        rows = rows.combine_chunks()
        lang = rows.column("lang").combine_chunks().dictionary_encode()
        term = rows.column("term").combine_chunks().dictionary_encode().indices.to_numpy(zero_copy_only=False)
        of = lang.indices.to_numpy(zero_copy_only=False)
        i, p, b = (rows.column(c).to_numpy() for c in ("i", "p", "b"))
        lag = 1
        while lag < len(i):
            same = np.flatnonzero((term[lag:] == term[:-lag]) & (of[lag:] == of[:-lag]))
            if not len(same):
                return
            a, z = same, same + lag
            value = np.abs(p[a] - p[z]) - np.abs(p[a] - b[z]) - np.abs(p[z] - b[a]) + np.abs(b[a] - b[z])
            trio, at = np.unique(np.stack([of[a], i[a], i[z]]), axis=1, return_inverse=True)
            total = np.zeros(trio.shape[1], np.int64)
            np.add.at(total, at.ravel(), value)
            yield pa.RecordBatch.from_arrays([lang.dictionary.take(pa.array(trio[0])), pa.array(trio[1]), pa.array(trio[2]), pa.array(total)], names=["lang", "i", "j", "value"])
            lag += 1

    for batch in batches:
        rows = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
        if not rows.num_rows:
            continue
        # The last term may go on in the next batch.
        last = (rows.column("lang")[-1], rows.column("term")[-1])
        tail = pc.and_(pc.equal(rows.column("lang"), last[0]), pc.equal(rows.column("term"), last[1])).to_numpy()
        first = int(np.argmax(tail))
        yield from pairs(rows.slice(0, first))
        held = rows.slice(first)
    if held is not None:
        yield from pairs(held)


PAIRS = "lang string, i long, j long, value long"


def audit(docs: DataFrame, least_docs: int = LEAST_DOCS, top: int = TOP) -> DataFrame:
    """(lang, source, part, item, value, rank) of the sources of ``docs`` (text, lang, source; other columns are not looked at).

    Part ``pair``: each other source of the language and the sum of |p - q| over all kept
    terms, 0 where none is kept. Part ``term``: the ``top`` terms whose share in the
    source is above that in the language. Null texts, languages and sources are empty
    ones; a source without any term has the floor everywhere. No rows give no rows.
    """
    counts = term_counts(docs)
    by_term = counts.where("term is not null").groupBy("lang", "term").agg(F.sum("n").alias("total"), F.sum("docs").alias("docs"), F.count(F.lit(1)).alias("spread"))
    kept = by_term.where(F.col("docs") >= least_docs).drop("docs")
    postings = shared.written(counts.where("term is not null").drop("docs").join(kept, ["lang", "term"]), "postings")

    groups = counts.where("term is null").select("lang", "source")
    own = postings.groupBy("lang", "source").agg(F.sum("n").alias("many"))
    terms = postings.groupBy("lang", "term").agg(F.first("total").alias("total"))
    sources = groups.groupBy("lang").agg(F.count(F.lit(1)).alias("sources"))
    is_heavy = F.col("spread") * HEAVY >= F.col("sources")
    of_lang = terms.groupBy("lang").agg(F.count(F.lit(1)).alias("kinds"), F.sum("total").alias("all"))
    langs = shared.written(sources.join(of_lang, "lang", "left").fillna(0, ["kinds", "all"]), "languages")
    # A language's sources are numbered in one task; the result has the square of their number.
    number = (F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1).cast("long")
    stats = groups.join(own, ["lang", "source"], "left").fillna(0, ["many"]).join(_sent(langs, "lang"), "lang")
    stats = stats.select("*", number.alias("i"), F.coalesce(share(F.lit(0), F.col("many"), F.col("kinds")), F.lit(0)).cast("long").alias("b"))
    stats = shared.written(stats, "sources")
    small = _sent(stats, "lang", "source")

    shares = postings.join(small, ["lang", "source"]).select(
        "lang", "source", "term", "i", "b", "kinds", "sources", is_heavy.alias("heavy"),
        share(F.col("n"), F.col("many"), F.col("kinds")).alias("p"), share(F.col("total"), F.col("all"), F.col("kinds")).alias("q"),
    )
    shares = shared.written(shares, "shares")

    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    above = shares.where("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))
    above = above.withColumn("rank", rank).where(F.col("rank") <= top)

    blocks, last = F.floor((F.col("sources") - 1) / SIDE), F.ceil(F.col("kinds") / CHUNK)
    chunks = F.greatest(last, F.lit(1)).cast("long")
    # A row goes to the tiles of its block with each block.
    tiled = lambda df: df.withColumn("block", F.floor(F.col("i") / SIDE)).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), blocks))).withColumns({"ti": F.least("block", "other"), "tj": F.greatest("block", "other")})
    columns = ["lang", "ti", "tj", "chunk", "kind", "term", "i", "p", "k"]
    several = F.col("sources") > 1
    floors = tiled(stats.where(several).withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), chunks - 1))))
    floors = floors.select("lang", "ti", "tj", "chunk", F.lit(0).alias("kind"), F.lit("").alias("term"), "i", F.col("b").alias("p"), F.when(F.col("chunk") == 0, F.col("kinds")).otherwise(0).alias("k"))
    heavy = tiled(shares.where(several & F.col("heavy"))).withColumn("chunk", F.pmod(F.xxhash64("term"), chunks)).withColumns({"kind": F.lit(1), "k": F.lit(1).cast("long")}).select(columns)
    light = shares.where(several & ~F.col("heavy"))
    histogram = light.groupBy("lang", "i", "p", "sources").agg(F.count(F.lit(1)).alias("k"))
    histogram = tiled(histogram).select("lang", "ti", "tj", F.lit(0).cast("long").alias("chunk"), F.lit(2).alias("kind"), F.lit("").alias("term"), "i", "p", "k")
    rows = floors.unionByName(heavy).unionByName(histogram)
    dense = rows.repartition("lang", "ti", "tj", "chunk").sortWithinPartitions("lang", "ti", "tj", "chunk", "kind", "term", "i").mapInArrow(_tiles, PAIRS)
    sparse = light.select("lang", "term", "i", "p", "b").repartition("lang", "term").sortWithinPartitions("lang", "term", "i").mapInArrow(_corrections, PAIRS)
    sums = shared.written(dense.union(sparse).groupBy("lang", "i", "j").agg(F.sum("value").alias("value")), "pairs")
    both = sums.union(sums.select("lang", F.col("j").alias("i"), F.col("i").alias("j"), "value"))
    name = lambda k, c: _sent(stats.select("lang", F.col("i").alias(k), F.col("source").alias(c)), "lang", c)
    named = both.join(name("i", "source"), ["lang", "i"]).join(name("j", "item"), ["lang", "j"])
    pairs = named.select("lang", "source", F.lit("pair").alias("part"), "item", "value").withColumn("rank", rank)
    return pairs.unionByName(above)


def op12_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The audit of all documents."""
    return audit(spark.read.parquet(f"{sf_dir}/documents.parquet"))


_P = f"1 + ({SCALE}::HUGEINT * ({{n}} + {SMOOTHING})) // ({{total}} + {SMOOTHING} * kinds)"
SQL = f"""WITH d AS (SELECT ROW_NUMBER() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS terms FROM documents),
x AS (SELECT id, lang, source, unnest(terms) AS term FROM d),
c AS (SELECT lang, source, term, COUNT(*) AS n FROM x GROUP BY ALL),
k AS (SELECT lang, term, COUNT(*) AS total FROM x GROUP BY lang, term HAVING COUNT(DISTINCT id) >= {LEAST_DOCS}),
g AS (SELECT DISTINCT lang, source FROM d),
v AS (SELECT lang, COUNT(*) AS kinds, SUM(total) AS whole FROM k GROUP BY lang),
s AS (SELECT lang, source, SUM(n) AS many FROM c JOIN k USING (lang, term) GROUP BY lang, source),
p AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, {_P.format(n='coalesce(c.n, 0)', total='coalesce(many, 0)')} AS p, {_P.format(n='k.total', total='whole')} AS q FROM g JOIN k ON k.lang = g.lang JOIN v ON v.lang = g.lang LEFT JOIN s ON s.lang = g.lang AND s.source = g.source LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
f AS (SELECT a.lang, a.source, b.source AS item, SUM(abs(a.p - b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
u AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0)::BIGINT AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source
UNION ALL SELECT lang, source, 'term', term, (p - q)::BIGINT FROM p WHERE n > 0 AND p > q)
SELECT * FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS rank FROM u) WHERE part = 'pair' OR rank <= {TOP}"""
