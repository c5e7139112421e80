"""A Merkle manifest of a dataset: a tree of three children a node for each source, and one over the sources' roots.

Leaves have places in their source by global positions. The tree is built in stages of
``LEVELS`` levels: a chunk is ``WIDE`` consecutive nodes, so that one row holds a small
subtree, and a source of any size is chunks that know nothing of each other. A chunk
stores its parents' preimages, the joined hashes of their children; its top is a node of
the next stage, which has a ``WIDE``-th of the rows. From the top down, a chunk joins the
path of its top; a node's path is, level by level, the preimage of its parent without
its own 64 characters: the siblings left and right of it. Hashed together they are a
proof, and folding puts another hash where the own one was, level by level up to a root.

All is column expressions; the number of stages grows with the logarithm of the largest
source. Digests travel as 32 bytes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from prescriva.llm import shared
from prescriva.operators.ranks import positions

FANOUT, LEVELS = 3, 6
WIDE = FANOUT**LEVELS
SENT_MOST = 8 << 20
_STEP = "array<struct<l:string,r:string>>"


def digest(c: Column) -> Column:
    return F.sha2(c, 256)


def leaf_hash(text: Column) -> Column:
    """The hash of a row with this text: each value with its length in bytes, so that no two rows have one preimage."""
    values = [F.col("doc_id").cast("string"), F.col("source").cast("string"), F.col("lang").cast("string"), F.col("n_chars").cast("string"), text]
    parts = [F.when(v.isNull(), "-").otherwise(F.concat(F.octet_length(v).cast("string"), F.lit(":"), v)) for v in values]
    return digest(F.concat(*parts))


def _hex(c: Column) -> Column:
    return F.lower(F.hex(c))


def _height(nodes: Column) -> Column:
    """Levels of a stage that a tree of so many nodes goes through: until one is left, ``LEVELS`` at most."""
    return sum(((nodes > FANOUT**k).cast("int") for k in range(LEVELS)), F.lit(0))


def _preimages(hashes: str) -> Column:
    """Each run of ``FANOUT`` hashes as one text."""
    runs = F.sequence(F.lit(0), F.ceil(F.size(hashes) / float(FANOUT)).cast("int") - 1)
    return F.transform(runs, lambda i: F.array_join(F.slice(hashes, i * FANOUT + 1, FANOUT), ""))


def chunks(nodes: DataFrame, extra: list[str]) -> DataFrame:
    """(tree, chunk, own, height, pres, top) of ``nodes`` (tree, pos, many, hash: 32 bytes, and ``extra``).

    ``own``: a chunk's nodes in order. ``pres``: for each level the preimages of its
    parents. ``many``: the nodes of the tree in this stage.
    """
    chunk = F.expr(f"pos div {WIDE}").alias("chunk")
    own = F.array_sort(F.collect_list(F.struct("pos", "hash", *extra)))
    out = nodes.groupBy("tree", chunk).agg(own.alias("own"), F.first("many").alias("many"))
    out = out.withColumn("height", _height(F.col("many"))).withColumn("h0", F.transform("own", lambda x: _hex(x.hash)))
    for k in range(1, LEVELS + 1):
        rises = F.col("height") >= k
        out = out.withColumn(f"p{k}", F.when(rises, _preimages(f"h{k - 1}")).otherwise(F.array().cast("array<string>")))
        out = out.withColumn(f"h{k}", F.when(rises, F.transform(f"p{k}", digest)).otherwise(F.col(f"h{k - 1}")))
    pres = F.array(*(f"p{k}" for k in range(1, LEVELS + 1)))
    return out.select("tree", "chunk", "many", "own", "height", pres.alias("pres"), F.unhex(F.get(f"h{LEVELS}", F.lit(0))).alias("top"))


def stages(nodes: DataFrame, most: int, extra: list[str]) -> list[DataFrame]:
    """The chunks of each stage, written; the last one's tops are the roots of the largest trees (``most`` nodes)."""
    out = []
    while True:
        out.append(shared.written(chunks(nodes, extra), "chunks"))
        if most <= WIDE:
            return out
        most, extra = -(-most // WIDE), []
        nodes = out[-1].where(F.col("many") > WIDE).select("tree", F.col("chunk").alias("pos"), F.ceil(F.col("many") / WIDE).alias("many"), F.col("top").alias("hash"))


def tops(done: list[DataFrame]) -> DataFrame:
    """(tree, hash): the root of each tree, from the stage that it ends in."""
    out = [c.where(F.col("many") <= WIDE).select("tree", F.col("top").alias("hash")) for c in done]
    for other in out[1:]:
        out[0] = out[0].union(other)
    return out[0]


def _own_path(j: Column) -> Column:
    """The steps from a chunk's node ``j`` to its top: of each parent's preimage what is left and right of the own 64 characters."""
    powers = F.array(*(F.lit(FANOUT**k) for k in range(LEVELS + 1)))

    def one(k: Column) -> Column:
        parent = F.floor(j / F.get(powers, k)).cast("int")
        slot = (F.floor(j / F.get(powers, k - 1)) % FANOUT).cast("int")
        pre = F.get(F.get("pres", k - 1), parent)
        return F.struct(F.substring(pre, F.lit(1), slot * 64).alias("l"), F.substring(pre, slot * 64 + 65, F.lit(64 * FANOUT)).alias("r"))

    ks = F.filter(F.sequence(F.lit(1), F.lit(LEVELS)), lambda k: k <= F.col("height"))
    return F.transform(ks, one)


def paths(done: list[DataFrame], above: DataFrame, kept: list[str]) -> DataFrame:
    """(tree, one of the first stage's nodes as ``node``, path, and ``kept`` columns of ``above``) for each node.

    ``above``: (tree, path, kept...), what comes after a tree's root.
    """
    upper = None
    for at in range(len(done) - 1, -1, -1):
        own = done[at]
        rooted = own.where(F.col("many") <= WIDE).select("tree", "chunk").join(above, "tree").select("tree", "chunk", "path", *kept)
        upper = rooted if upper is None else rooted.unionByName(upper.select("tree", F.col("node.pos").alias("chunk"), "path", *kept))
        upper = shared.written(upper, "paths")
        size = F.octet_length(F.to_json("path"))
        joined = own.join(F.broadcast(upper) if shared.small_enough(upper, size, SENT_MOST) else upper, ["tree", "chunk"])
        spread = joined.select("tree", "pres", "height", F.col("path").alias("rest"), *kept, F.posexplode("own").alias("j", "node"))
        upper = spread.select("tree", "node", F.concat(_own_path(F.col("j")), "rest").alias("path"), *kept)
    return upper


def folded(path: Column, start: Column) -> Column:
    """The root that a leaf's hash and its siblings give."""
    return F.aggregate(path, start, lambda h, s: digest(F.concat(s.l, h, s.r)))


def manifest(docs: DataFrame, tampered: Column | None = None) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified) of each row of ``docs``.

    ``tampered``: the text that a row has now, by default its own; ``folded_root`` is
    recomputed from it and the row's untampered siblings. Leaves of a source stand in the
    order of doc_id, null first, and then of their hashes; rows that repeat have leaves
    of their own. A null source is a source, the first. No rows give no rows; of one row
    alone the leaf is the root, and its proof the hash of nothing.
    """
    spark = docs.sparkSession
    now = F.col("text") if tampered is None else tampered
    changed = F.when(~now.eqNullSafe(F.col("text")), F.unhex(leaf_hash(now)))
    leaves = docs.select("doc_id", F.col("source").cast("string").alias("source"), F.unhex(leaf_hash(F.col("text"))).alias("hash"), changed.alias("changed"), F.monotonically_increasing_id().alias("_row"))
    leaves = shared.written(leaves, "leaves")
    placed = positions(leaves, ["source", "doc_id", "hash", "_row"], "at", ["doc_id", "source", "hash", "changed"])
    of = placed.groupBy("source").agg(F.min("at").alias("start"), F.count(F.lit(1)).alias("many"))
    sources = shared.written(positions(of, ["source"], "tree"), "sources")
    count, most = sources.agg(F.count(F.lit(1)), F.max("many")).first()
    if not count:
        return spark.createDataFrame([], "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean")
    named = sources.withColumnRenamed("source", "_source")
    named = F.broadcast(named) if shared.small_enough(sources, F.coalesce(F.octet_length("source"), F.lit(0)), SENT_MOST) else named
    nodes = placed.join(named, F.col("source").eqNullSafe(F.col("_source"))).select("tree", (F.col("at") - F.col("start")).alias("pos"), "many", "hash", "changed", "doc_id")

    trees = stages(nodes, most, ["changed", "doc_id"])
    subroots = tops(trees)
    over = stages(subroots.select(F.lit(0).cast("long").alias("tree"), F.col("tree").alias("pos"), F.lit(count).alias("many"), "hash"), count, [])
    root = tops(over).first().hash.hex()
    after = paths(over, spark.createDataFrame([(0, [])], f"tree long, path {_STEP}"), [])
    above = after.select(F.col("node.pos").alias("tree"), "path", _hex(F.col("node.hash")).alias("subroot"))
    out = paths(trees, above, ["subroot"])
    leaf, start = _hex(F.col("node.hash")), _hex(F.coalesce("node.changed", "node.hash"))
    siblings = F.array_join(F.transform("path", lambda s: F.concat(s.l, s.r)), "")
    out = out.select(F.col("node.doc_id").alias("doc_id"), leaf.alias("leaf"), "subroot", F.lit(root).alias("root"), digest(siblings).alias("proof_sha256"), folded(F.col("path"), start).alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


def op13_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The manifest of ``documents``; where 2 divides crc32 of doc_id, the text is read without its line feeds."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    unchanged = shared.crc_mod("doc_id", 2) != 0
    return manifest(docs, F.when(unchanged, F.col("text")).otherwise(F.replace("text", F.lit("\n"), F.lit(""))))


#: Levels that the SQL goes up: sources of up to 3 to this power documents.
SQL_LEVELS = 9


def _sql() -> str:
    """Level by level; ``n{k}``: tree, place, hash; ``m{k}``: each node with its siblings left and right of it."""
    part = lambda e: f"CASE WHEN {e} IS NULL THEN '-' ELSE octet_length(encode({e}))::VARCHAR || ':' || {e} END"
    row = " || ".join(part(e) for e in ("doc_id::VARCHAR", "source", "lang", "n_chars::VARCHAR", "{text}"))
    crc = "xor(list_reduce(list_prepend(4294967295::BIGINT, [ascii(c)::BIGINT FOR c IN string_split(coalesce(doc_id::VARCHAR, ''), '')]), lambda a, b: xor(a >> 8, crc[(xor(a, b) & 255) + 1])), 4294967295::BIGINT)"
    out = [
        "WITH RECURSIVE t(i, c, k) AS (SELECT i, i::BIGINT, 0 FROM range(256) AS r(i) UNION ALL SELECT i, CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END, k + 1 FROM t WHERE k < 8)",
        "tab AS (SELECT list(c ORDER BY i) AS crc FROM t WHERE k = 8)",
        f"d AS (SELECT doc_id, source, sha256({row.format(text='text')}) AS leaf, sha256({row.format(text='now')}) AS changed FROM (SELECT *, CASE WHEN {crc} % 2 = 0 THEN replace(text, chr(10), '') ELSE text END AS now FROM documents, tab))",
        "s AS (SELECT source, ROW_NUMBER() OVER (ORDER BY source NULLS FIRST) - 1 AS tree FROM (SELECT DISTINCT source FROM d))",
        "x AS (SELECT d.*, tree, ROW_NUMBER() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos FROM d JOIN s ON d.source IS NOT DISTINCT FROM s.source)",
        "n0 AS (SELECT tree, pos, leaf AS h FROM x)",
    ]

    def climb(n: str, m: str, levels: int) -> None:
        for k in range(levels):
            beside = {"l": "UNBOUNDED PRECEDING AND 1 PRECEDING", "r": "1 FOLLOWING AND UNBOUNDED FOLLOWING"}
            sides = ", ".join(f"CASE WHEN many = 1 THEN '' ELSE coalesce(string_agg(h, '') OVER (PARTITION BY tree, pos // 3 ORDER BY pos ROWS BETWEEN {rows}), '') END AS {side}" for side, rows in beside.items())
            out.append(f"{m}{k} AS (SELECT tree, pos, h, many, {sides} FROM (SELECT *, COUNT(*) OVER (PARTITION BY tree) AS many FROM {n}{k}))")
            out.append(f"{n}{k + 1} AS (SELECT tree, pos // 3 AS pos, CASE WHEN ANY_VALUE(many) = 1 THEN ANY_VALUE(h) ELSE sha256(string_agg(h, '' ORDER BY pos)) END AS h FROM {m}{k} GROUP BY tree, pos // 3)")

    climb("n", "m", SQL_LEVELS)
    out.append(f"o0 AS (SELECT 0 AS tree, tree AS pos, h FROM n{SQL_LEVELS})")
    climb("o", "q", SQL_LEVELS)
    sides = [(f"m{k}", f"m{k}.tree = x.tree AND m{k}.pos = x.pos // {3**k}") for k in range(SQL_LEVELS)] + [(f"q{k}", f"q{k}.pos = x.tree // {3**k}") for k in range(SQL_LEVELS)]
    joins = "".join(f" JOIN {t} ON {on}" for t, on in sides)
    path = ", ".join(f"{{many: {t}.many, l: {t}.l, r: {t}.r}}" for t, _ in sides)
    out.append(f"y AS (SELECT doc_id, leaf, changed, x.tree, x.pos, {' || '.join(f'{t}.l || {t}.r' for t, _ in sides)} AS proof, [{path}] AS path FROM x{joins})")
    step = "CASE WHEN path[i + 1].many = 1 THEN h ELSE sha256(path[i + 1].l || h || path[i + 1].r) END"
    out.append(f"f(tree, pos, i, h) AS (SELECT tree, pos, 0, changed FROM y UNION ALL SELECT f.tree, f.pos, i + 1, {step} FROM f JOIN y ON y.tree = f.tree AND y.pos = f.pos WHERE i < {2 * SQL_LEVELS})")
    return ",\n".join(out) + f"\nSELECT y.doc_id, leaf, n{SQL_LEVELS}.h AS subroot, o{SQL_LEVELS}.h AS root, sha256(proof) AS proof_sha256, f.h AS folded_root, f.h = o{SQL_LEVELS}.h AS verified FROM y JOIN n{SQL_LEVELS} ON n{SQL_LEVELS}.tree = y.tree JOIN f ON f.tree = y.tree AND f.pos = y.pos AND f.i = {2 * SQL_LEVELS}, o{SQL_LEVELS}"


SQL = _sql()
