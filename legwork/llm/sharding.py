"""Consistent-hash ring with virtual nodes and bounded loads, in DataFrame functions alone.

Every row has a point on a ring of 64-bit hashes; every shard has ``vnodes`` nodes
there, each owning the arc from its place to the next node's. A shard takes at most
its capacity; the rows of an arc that find their shard full continue clockwise to
the next arc whose shard has room. Without ``slack`` the capacities add up to the
number of rows and differ by one at most, so the law held is ``rows``: counts are at
most one apart, and only the rows beyond a full shard leave the arc that the plain
ring gives them. With ``slack`` a shard may hold that share more than its part and
fewer rows move when a shard is added.

Plan: one aggregate drops repeated rows to (row, copies), a second counts the
cells into which arcs are cut. The driver sees one count for each arc
(``shards * vnodes`` numbers, whatever the data), walks the ring over them and
sends back ranges of ranks as a small table. Ranks are counted cell by cell
(their number follows the data), so no window holds more than about ``cell_rows``
distinct rows however large a shard is; the copies of a repeated row are dealt out
COPIES at a time.

Cases: null text counts as empty; null ids are a value like any other; equal
rows are told apart by their count alone and get consecutive ranks; an empty
table gives an empty result; further columns of the input are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import durable

#: The table that finds a point's arc has 2^SLOT_BITS rows and one more for each node.
SLOT_BITS = 13
#: Copies of a row that one task writes out.
COPIES = 4096
LOWEST, HIGHEST = -(1 << 63), (1 << 63) - 1


def literal(spark: SparkSession, rows: list[tuple], **kinds: str) -> DataFrame:
    """A table of numbers without Python workers: one text that Spark splits."""
    if not rows:
        return spark.range(0).select(*(F.lit(None).cast(k).alias(n) for n, k in kinds.items()))
    cells = F.split("row", ",")
    text = spark.range(1).select(F.explode(F.split(F.lit(";".join(",".join(map(str, r)) for r in rows)), ";")).alias("row"))
    return text.select(*(cells[i].cast(k).alias(n) for i, (n, k) in enumerate(kinds.items())))


def ring(spark: SparkSession, shards: int, vnodes: int, seed: int) -> list[tuple[int, int]]:
    """(place, shard) of every node in clockwise order; of nodes at one place the first counts."""
    nodes = spark.range(shards * vnodes).select((F.col("id") % shards).cast("int").alias("shard"), F.xxhash64(F.lit(seed), F.col("id") % shards, F.floor(F.col("id") / shards)).alias("at"))
    found: dict[int, int] = {}
    for row in nodes.orderBy("at", "shard").collect():  # shards * vnodes rows
        found.setdefault(row["at"], row["shard"])
    return sorted(found.items())


def arcs_of(nodes: list[tuple[int, int]]) -> list[tuple[int, int, int, int]]:
    """(first point, last point, arc, shard); the last arc goes on at the beginning."""
    out = [(at, (nodes[i + 1][0] if i + 1 < len(nodes) else HIGHEST + 1) - 1, i, shard) for i, (at, shard) in enumerate(nodes)]
    if nodes[0][0] > LOWEST:
        out.append((LOWEST, nodes[0][0] - 1, len(nodes) - 1, nodes[-1][1]))
    return out


def capacities(total: int, shards: int, slack: float = 0.0) -> list[int]:
    """The most rows of each shard."""
    even = [total // shards + (s < total % shards) for s in range(shards)]
    return [-(-int(total * (1 + slack)) // shards) for _ in even] if slack else even


def flow(counts: list[int], owners: list[int], room: list[int]) -> list[tuple[int, int, int, int, int]]:
    """(arc, from rank, to rank, shard, first slot): own rows first, then what overflows continues clockwise."""
    room, arcs = list(room), len(owners)
    if sum(room[s] for s in set(owners)) < sum(counts):
        raise ValueError("the shards that own arcs have less room than there are rows")
    taken, following = [0] * len(room), list(range(arcs))
    plan, over = [], []

    def give(arc: int, low: int, high: int, shard: int) -> int:
        n = min(high - low, room[shard])
        if n:
            plan.append((arc, low, low + n, shard, taken[shard]))
            room[shard] -= n
            taken[shard] += n
        return low + n

    def open_from(arc: int) -> int:
        """The first arc from here on, clockwise, whose shard has room; arcs of full shards are skipped for good."""
        seen = []
        while not room[owners[arc]]:
            seen.append(arc)
            arc = following[arc] if following[arc] != arc else (arc + 1) % arcs
        for a in seen:
            following[a] = arc
        return arc

    for arc, n in enumerate(counts):
        if (low := give(arc, 0, n, owners[arc])) < n:
            over.append((arc, low, n))
    for arc, low, high in over:
        while low < high:
            low = give(arc, low, high, owners[open_from(arc)])
    return plan


def bounded_ring(rows: DataFrame, key: list[str], shards: int = 8, vnodes: int = 64, seed: int = 7, slack: float = 0.0, cell_rows: int = 50_000) -> DataFrame:
    """``rows`` (columns of ``key`` and whatever else is equal in repeated rows) with shard, slot and home_shard.

    ``rows`` is read twice; pass a stored or cheap one. Its columns must not begin with an underscore.
    """
    spark = rows.sparkSession
    nodes = ring(spark, shards, vnodes, seed)
    columns = rows.columns
    packed = rows.groupBy(*columns).agg(F.count(F.lit(1)).alias("_copies")).withColumn("_point", F.xxhash64(F.lit(seed), *key))

    # a point's arc: the arcs are cut at multiples of 2^-SLOT_BITS of the ring, so that the join has an equi key
    slot = lambda c: F.shiftright(c, 64 - SLOT_BITS)
    spans = literal(spark, arcs_of(nodes), _from="long", _to="long", _arc="int", home_shard="int")
    spans = spans.withColumn("_slot", F.explode(F.sequence(slot(F.col("_from")), slot(F.col("_to")))))
    packed = packed.withColumn("_slot", slot(F.col("_point"))).join(F.broadcast(spans), "_slot").where("_point between _from and _to").drop("_slot", "_from", "_to")

    # cells so fine that their number follows the data
    total = rows.count()
    bits = max(1, (total // cell_rows).bit_length())
    packed = packed.withColumn("_cell", F.shiftright("_point", 64 - bits))
    cells = durable(packed.groupBy("_arc", "_cell").agg(F.sum("_copies").alias("_n")))
    counts = dict(cells.groupBy("_arc").agg(F.sum("_n").alias("n")).collect())  # a number for each arc
    plan = flow([int(counts.get(i, 0)) for i in range(len(nodes))], [s for _, s in nodes], capacities(total, shards, slack))
    ranges = literal(spark, plan, _arc="int", _low="long", _high="long", shard="int", _first="long")  # a few rows for each arc

    before = Window.partitionBy("_arc").orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.select("_arc", "_cell", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inside = Window.partitionBy("_arc", "_cell").orderBy("_point", *columns).rowsBetween(Window.unboundedPreceding, -1)
    ranked = packed.withColumn("_rank", F.coalesce(F.sum("_copies").over(inside), F.lit(0))).join(cells, ["_arc", "_cell"]).withColumn("_rank", F.col("_rank") + F.col("_before"))
    part = ranked.withColumn("_part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_copies") - 1, F.lit(COPIES).cast("long")))).repartition("_point", "_part")
    part = part.withColumn("_rank", F.explode(F.sequence(F.col("_rank") + F.col("_part"), F.col("_rank") + F.least(F.col("_part") + COPIES, F.col("_copies")) - 1)))
    placed = part.join(F.broadcast(ranges), "_arc").where("_rank >= _low and _rank < _high")
    return placed.select(*columns, "shard", (F.col("_first") + F.col("_rank") - F.col("_low")).alias("slot"), "home_shard")


def shard_documents(docs: DataFrame, shards: int = 8, vnodes: int = 64, seed: int = 7, slack: float = 0.0) -> DataFrame:
    """Shards of documents (doc_id, text): see the module's text. One row for each input row."""
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    rows = durable(docs.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32")))
    placed = bounded_ring(rows, ["doc_id", "text_crc32"], shards, vnodes, seed, slack)
    law = "rows" if not slack else "bounded"
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit(law).alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "home_shard", (F.col("shard") != F.col("home_shard")).alias("moved")
    )
