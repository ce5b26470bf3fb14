"""Merkle manifest of a table: leaves by source, runs of ``arity`` nodes to the root, proofs by a recursive query.

1. Every row becomes a leaf: the hash of its columns, each with its length. One pass over the texts; from then on only
   numbers and digests travel.
2. Leaves get their place in their source: rows are dealt by Spark's range partitioning over (source, id, leaf), stored,
   numbered inside a range, and the ranges' counts are added, so a source with a third of all rows is spread over tasks.
3. Levels are built ``stride`` at a time, in groups of at most arity ** stride rows by place; all sources advance
   together. The subroots are the leaves of one more such tree.
4. Every stride's nodes are stored as rows (node, parent, siblings before and after on the levels between). A recursive
   query starts at every leaf with its (tampered) hash, meets the row of its node, appends the siblings and folds the hash
   with them, until a node has no row: the root.

A node's number is that of the first leaf below it, times 64, plus its stride (those of the upper tree from 32 on), so
both trees are in one table and no step counts rows again. Digests travel as 32 bytes. Taking three levels in a step
shuffles each leaf five times instead of fourteen, and only the seed of the query reads the rows of the leaves' nodes.

Cases: null columns are hashed as ``-``; null sources are one source, first; null ids come first in their source, equal
ids in order of their leaves, repeated rows are leaves each; a source of one row is its own subroot, one source alone is
the root; a single document has no siblings; an empty table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import durable, text_crc

#: Levels in a node's number; those of the upper tree begin at half.
LEVELS = 64
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def encoded(column: Column) -> Column:
    """``-`` for null, else the UTF-8 byte count, a colon and the value."""
    text = column.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(columns: list[Column]) -> Column:
    """Digest of a row's columns (32 bytes)."""
    return F.unhex(F.sha2(F.concat(*map(encoded, columns)).cast("binary"), 256))


def as_hex(digests: Column) -> Column:
    return F.lower(F.hex(digests))


def folded(digests: Column) -> Column:
    """Digest of digests end to end, taken as hexadecimal text."""
    return F.unhex(F.sha2(as_hex(digests).cast("binary"), 256))


def joined(digests: Column) -> Column:
    """An array of binaries end to end."""
    return F.aggregate(digests, F.lit(b""), lambda a, x: F.concat(a, x))


def numbered(df: DataFrame, order: list[str]) -> DataFrame:
    """``df`` with ``place``, each row's number from 0 in ``order`` (nulls first), without a task that holds all rows."""
    cells = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    df = durable(df.repartitionByRange(cells, *order).withColumn("_cell", F.spark_partition_id()))
    counts = df.groupBy("_cell").agg(F.count("*").alias("_n"))
    before = Window.orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    counts = counts.select("_cell", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inside = F.row_number().over(Window.partitionBy("_cell").orderBy(*order)) - 1
    return df.withColumn("place", inside.cast("long")).join(F.broadcast(counts), "_cell").withColumn("place", F.col("place") + F.col("_before")).drop("_cell", "_before")


def _height(n: Column, arity: int) -> Column:
    """Levels above ``n`` nodes until one is left (0 for one)."""
    sizes = [arity**i for i in range(LEVELS // 2) if arity**i < 1 << 62]
    return F.aggregate(F.array(*(F.lit(x).cast("long") for x in sizes)), F.lit(0), lambda a, x: a + (x < n).cast("int"))


def built(leaves: DataFrame, most: int, arity: int, stride: int, first_level: int, root: Column) -> tuple[DataFrame | None, DataFrame]:
    """All node rows of the trees over ``leaves`` (base, n, spot, top, digest), and (top, digest) of their roots.

    ``base`` is the number of a tree's first leaf, ``n`` its leaves, ``spot`` the leaf's place in it, ``most`` the largest
    ``n``; ``root`` is the number that a tree's root goes by as a node.
    """
    nodes, roots, size, passes = [], [leaves.where("n = 1").select("top", "digest")], 1, 0
    step = leaves.where("n > 1").withColumn("left", _height(F.col("n"), arity))
    while size < most:
        child = (F.col("base") + F.col("spot") * size) * LEVELS + first_level + passes
        up = F.floor(F.col("spot") / arity**stride).alias("up")
        runs = step.groupBy("top", "base", "left", up).agg(F.array_sort(F.collect_list(F.struct("spot", "digest", child.alias("node")))).alias("run")).withColumn("d0", F.col("run.digest"))
        for i in range(stride):
            digests = F.col(f"d{i}")
            folds = F.transform(F.sequence(F.lit(0), F.floor((F.size(digests) - 1) / arity).cast("int")), lambda j: folded(joined(F.slice(digests, j * arity + 1, F.lit(arity)))))  # noqa: B023
            runs = runs.withColumn(f"d{i + 1}", F.when(F.col("left") > i, folds))
        size, passes = size * arity**stride, passes + 1
        last = F.col("left") <= stride
        ends = F.coalesce(*(F.col(f"d{i}") for i in range(stride, 0, -1)))[0]
        parent = F.when(last, root).otherwise((F.col("base") + F.col("up") * size) * LEVELS + first_level + passes)
        runs = durable(runs.select("top", "base", "up", "left", "run", *(f"d{i}" for i in range(stride)), ends.alias("digest"), parent.alias("parent")))
        each = runs.select("parent", "left", *(f"d{i}" for i in range(stride)), F.posexplode("run").alias("i", "own"))
        nodes.append(each.select(F.col("own.node").alias("node"), "parent", F.filter(F.array(*(F.when(F.col("left") > j, _siblings(F.col(f"d{j}"), F.floor(F.col("i") / arity**j).cast("int"), arity)) for j in range(stride))), lambda x: x.isNotNull()).alias("siblings")))
        roots.append(runs.where(last).select("top", "digest"))
        step = runs.where(~last).select("top", "base", F.col("up").alias("spot"), "digest", (F.col("left") - stride).alias("left"))
    return (reduce(DataFrame.unionByName, nodes) if nodes else None), reduce(DataFrame.unionByName, roots)


def _siblings(level: Column, i: Column, arity: int) -> Column:
    """The other nodes of the run of the i-th node of a level, before and after it."""
    start = (i - i % arity).cast("int")
    return F.struct(joined(F.slice(level, start + 1, i - start)).alias("before"), joined(F.slice(level, i + 2, start + arity - 1 - i)).alias("after"))


#: The first step is taken in the seed, so that the recursion meets only the rows of higher nodes.
CLIMB = """
with recursive climb (leaf, node, folded, step, siblings) as (
  select s.place, n.parent, {first}, 0, n.siblings from {starts} s join {nodes} n on s.node = n.node
  union all
  select c.leaf, n.parent, {next}, c.step + 1, n.siblings from climb c join {upper} n on c.node = n.node
)
select * from climb
"""
FOLD = "aggregate(n.siblings, {}, (a, s) -> unhex(sha2(lower(hex(concat(s.before, a, s.after))), 256)))"


def climbed(starts: DataFrame, nodes: DataFrame, first: DataFrame) -> DataFrame:
    """For each start (place, node, folded): the siblings of every step, and the hash folded with them up to the root.

    ``first`` has the rows of the starts' nodes, ``nodes`` those above them.

    Spark stops recursive queries at a million rows; the bound is lifted for this query alone. Its depth is that of the trees.
    """
    spark = starts.sparkSession
    limit = "spark.sql.cteRecursionRowLimit"
    kept = spark.conf.get(limit)
    spark.conf.set(limit, "-1")
    try:
        steps = durable(spark.sql(CLIMB.replace("{first}", FOLD.format("s.folded")).replace("{next}", FOLD.format("c.folded")), starts=starts, nodes=first, upper=nodes))
    finally:
        spark.conf.set(limit, kept)
    proof = F.array_sort(F.collect_list(F.struct("step", "siblings")))
    own = steps.select("leaf", "step", "folded", joined(F.transform("siblings", lambda x: F.concat(x["before"], x["after"]))).alias("siblings"))
    return own.groupBy(F.col("leaf").alias("place")).agg(F.max_by("folded", "step").alias("folded_root"), joined(proof["siblings"]).alias("proof"))


def manifest(docs: DataFrame, tampered: Column, text: Column, arity: int = 3, stride: int = 3) -> DataFrame:
    """doc_id, leaf, subroot, root, proof (siblings end to end), folded_root of every row; digests as bytes.

    Where ``tampered`` holds, the proof is folded from a leaf whose text is ``text`` instead of the row's own.
    """
    own = leaf([F.col(c) for c in FIELDS])
    other = leaf([F.col(c) if c != "text" else text for c in FIELDS])
    rows = docs.select("doc_id", "source", own.alias("leaf"), F.when(tampered, other).alias("changed"))
    rows = durable(numbered(rows, ["source", "doc_id", "leaf"]))
    sources = rows.groupBy("source").agg(F.min("place").alias("base"), F.count("*").alias("n"))
    sources = durable(numbered(sources, ["source"]).withColumnRenamed("place", "top"))
    total, most = sources.agg(F.count("*"), F.max("n")).first()
    if not total:
        return rows.selectExpr("doc_id", "leaf", "leaf as subroot", "leaf as root", "leaf as proof", "leaf as folded_root")
    upper = (F.col("top") * LEVELS + LEVELS // 2).cast("long")
    rows = rows.join(sources.withColumnRenamed("source", "_source"), F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    rows = durable(rows.withColumn("node", F.when(F.col("n") == 1, upper).otherwise(F.col("place") * LEVELS)))
    leaves = rows.select("top", "base", "n", (F.col("place") - F.col("base")).alias("spot"), F.col("leaf").alias("digest"))
    lower_nodes, subroots = built(leaves, most, arity, stride, 0, upper)
    subroots = durable(subroots)
    whole = subroots.select(F.lit(0).cast("long").alias("base"), F.lit(total).alias("n"), F.col("top").alias("spot"), F.lit(0).cast("long").alias("top"), "digest")
    upper_nodes, roots = built(whole, total, arity, stride, LEVELS // 2, F.lit(LEVELS - 1).cast("long"))
    root = roots.first()["digest"]  # one row
    parts = [x for x in (lower_nodes, upper_nodes) if x is not None]
    level = F.col("node") % LEVELS
    alone = F.col("n") == 1  # such a leaf's node is one of the upper tree
    starts = rows.select("place", "node", F.coalesce("changed", "leaf").alias("folded"))
    if parts:
        nodes = durable(reduce(DataFrame.unionByName, parts))
        lone = sources.where(alone).select(upper.alias("node"))
        first = nodes.where(level == 0).unionByName(nodes.where(level == LEVELS // 2).join(lone, "node", "left_semi"))
        ends = climbed(starts, nodes.where(level > 0), first)
    else:
        ends = starts.select("place", F.col("folded").alias("folded_root"), F.lit(b"").alias("proof"))
    return rows.select("doc_id", "leaf", "place", "top").join(ends, "place").join(subroots.withColumnRenamed("digest", "subroot"), "top").select("doc_id", "leaf", "subroot", F.lit(bytes(root)).alias("root"), "proof", "folded_root")


def report(docs: DataFrame) -> DataFrame:
    """The manifest in hexadecimal text, tampered (line ends deleted from the text) where 2 divides crc32 of the id; null ids are not tampered."""
    tampered = F.coalesce(text_crc("doc_id") % 2 == 0, F.lit(False))
    found = manifest(docs, tampered, F.replace(F.col("text"), F.lit("\n"), F.lit("")))
    out = found.select("doc_id", *(as_hex(F.col(c)).alias(c) for c in ("leaf", "subroot", "root")), F.sha2(as_hex(F.col("proof")).cast("binary"), 256).alias("proof_sha256"), as_hex(F.col("folded_root")).alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))
