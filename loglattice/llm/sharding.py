"""K-d tree sharding: split by weight at distributed medians until each leaf is one shard.

A node that owes ``m`` shards is cut along its widest metadata dimension so that the two sides
weigh as m//2 to m - m//2.  The cut is found by counting weights in equal-width bins of a 52-bit
key and zooming into the bin that holds the cut; the driver sees bins of at most one node per
shard, never rows.  Everything is DataFrame expressions.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loglattice.llm import common as c
from loglattice.llm.registry import query

OVERHEAD = 16  # bytes a row takes besides its text
BINS = 1 << 15  # counted in one pass, over all nodes
TOLERANCE = 0.0002  # of a shard's weight: a cut this near its goal is taken
GROUP_TOLERANCE = 0.005  # ... and this near, if coming nearer would part equal texts
KEY_BITS, VALUE_BITS = 52, 20
DIMENSIONS = ("_by_size", "_by_width", "_by_hash")


@dataclass
class Node:
    first: int  # its first shard
    shards: int
    weight: float = 0.0
    axis: int = 0
    low: int = 0  # the bin under search is [low, high)
    high: int = 1 << KEY_BITS
    below: float = 0.0  # weight of its rows under ``low``
    inside: float = 0.0  # weight of its rows in the bin
    rows: int = 0  # their number
    cut: int = 1 << KEY_BITS  # rows at this key or above go right
    tie: int = 0  # ... and of the rows at ``cut`` itself those with this hash or above

    @property
    def goal(self) -> float:
        return self.weight * (self.shards // 2) / self.shards

    def miss(self) -> float:
        """How far the nearer end of the bin is from the goal."""
        return min(abs(self.goal - self.below), abs(self.below + self.inside - self.goal))

    def nearer(self) -> int:
        return self.low if self.goal - self.below <= self.below + self.inside - self.goal else self.high


def keys(docs: DataFrame) -> DataFrame:
    """Metadata of each row as 52-bit numbers whose low half is a hash of the text: equal texts
    stand side by side in every dimension, and no two texts tie.  ``_tie`` hashes the row's own
    number, so that rows alike in id and text can be parted too; it holds once the rows are stored."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    salt = F.pmod(F.xxhash64(text), F.lit(1 << 32))
    scaled = {
        "_by_size": F.log2(1 + F.octet_length(text).cast("double")) / 32,
        "_by_width": F.octet_length(text) / (4.0 * F.greatest(F.char_length(text), F.lit(1))),
        "_by_hash": F.pmod(F.xxhash64(F.lit("axis"), text), F.lit(1 << VALUE_BITS)) / float(1 << VALUE_BITS),
    }
    top = (1 << VALUE_BITS) - 1
    as_key = {
        name: F.least(F.floor(value * top), F.lit(top)).cast("long") * F.lit(1 << 32) + salt for name, value in scaled.items()
    }
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.octet_length(text) + F.lit(OVERHEAD)).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        *[value.alias(name) for name, value in as_key.items()],
        F.pmod(F.xxhash64(F.lit("tie"), F.monotonically_increasing_id()), F.lit(1 << KEY_BITS)).alias("_tie"),
    )


def beside(rows: DataFrame, nodes: list[Node], wanted: set[int]) -> DataFrame:
    """``rows`` with the figures of their node in ``_at`` and their key along its axis; never more
    nodes than shards, so the small side is bounded.  (As a table, not as literals, the figures
    leave the generated code alone, which Spark then compiles once.)"""
    figures = ", ".join(
        f"({i}, named_struct('wanted', {i in wanted}, 'axis', {n.axis}, 'low', {n.low}L, 'high', {n.high}L, 'cut', {n.cut}L, 'tie', {n.tie}L))"
        for i, n in enumerate(nodes)
    )
    small = rows.sparkSession.sql(f"SELECT * FROM VALUES {figures} AS t(_node, _at)")
    key = F.element_at(F.array(*DIMENSIONS), F.col("_at.axis") + 1)
    return rows.join(F.broadcast(small), "_node").withColumn("_key", key)


def widest(rows: DataFrame, nodes: list[Node]) -> None:
    """Give every node its weight and the dimension with the largest weighted spread."""
    measures = [F.sum("size").alias("w")]
    for name in DIMENSIONS:
        value = F.shiftright(F.col(name), 32).cast("double")
        measures += [F.sum(value * F.col("size")).alias(f"{name}_1"), F.sum(value * value * F.col("size")).alias(f"{name}_2")]
    for row in rows.groupBy("_node").agg(*measures).collect():  # one row per node, never more nodes than shards
        node = nodes[row["_node"]]
        node.weight = float(row["w"])
        spread = [row[f"{d}_2"] / node.weight - (row[f"{d}_1"] / node.weight) ** 2 for d in DIMENSIONS]
        node.axis = max(range(len(spread)), key=lambda i: (float(f"{spread[i]:.6g}"), -i))


def zoom(rows: DataFrame, nodes: list[Node], wanted: list[int], key: str, near: float) -> None:
    """Narrow the bin of the wanted nodes around their goal until an end is near, or it has one
    key or row."""
    wanted = list(wanted)
    while wanted:
        bins = BINS // len(wanted)
        found = beside(rows, nodes, set(wanted)).where("_at.wanted")
        if key == "_tie":
            found = found.where("_key = _at.cut")
        counted = (
            found.where(F.col(key).between(F.col("_at.low"), F.col("_at.high") - 1))
            .select("_node", F.expr(f"({key} - _at.low) div ceil((_at.high - _at.low) / {bins})").alias("bin"), "size")
            .groupBy("_node", "bin").agg(F.sum("size").alias("w"), F.count("*").alias("n")).collect()
        )
        by_node: dict[int, list[tuple[int, float, int]]] = {}
        for row in counted:  # at most BINS rows
            by_node.setdefault(row["_node"], []).append((row["bin"], float(row["w"]), row["n"]))
        for i in list(wanted):
            node = nodes[i]
            start, last, step = node.low, node.high, max(1, -(-(node.high - node.low) // bins))
            for number, weight, count in sorted(by_node.get(i, [])):
                node.low = start + number * step
                node.high, node.inside, node.rows = min(node.low + step, last), weight, count
                if node.below + weight >= node.goal:
                    break
                node.below += weight
            if i not in by_node or node.miss() <= near or node.high - node.low <= 1 or node.rows == 1:
                wanted.remove(i)


def find_cuts(rows: DataFrame, nodes: list[Node], leaf: float) -> None:
    split = [i for i, n in enumerate(nodes) if n.shards > 1 and n.weight > 0]
    zoom(rows, nodes, split, "_key", TOLERANCE * leaf)
    parted = []  # one key, hence equal texts, that weighs too much to stay on one side
    for i in split:
        node = nodes[i]
        if node.rows > 1 and node.high - node.low <= 1 and node.miss() > GROUP_TOLERANCE * leaf:
            node.cut, node.low, node.high = node.low, 0, 1 << KEY_BITS
            parted.append(i)
        else:
            node.cut = node.nearer()
    zoom(rows, nodes, parted, "_tie", TOLERANCE * leaf)
    for i in parted:
        nodes[i].tie = nodes[i].nearer()


def sharded(docs: DataFrame, shards: int) -> DataFrame:
    """One row per row of ``docs``: doc_id, size, text_crc32, shard, slot.

    Shards weigh as equal as single rows allow.  Equal texts share a shard unless parting them
    is needed to keep the weights within half a percent of a shard.  Null text counts as empty;
    null ids are ids like any other; repeated rows each get a place.  Slots count from 0 without
    gaps in every shard, by id within hashed parts of it, so that no task sorts a whole shard.
    Empty tables give an empty one; other columns are not read, so their names cannot clash.
    """
    rows = c.stored(keys(docs).withColumn("_node", F.lit(0)), "keys")
    total = rows.agg(F.sum("size")).first()[0] or 0
    nodes = [Node(0, shards)]
    while any(n.shards > 1 for n in nodes):
        widest(rows, nodes)
        find_cuts(rows, nodes, total / shards)
        children, names = [], []
        for node in nodes:
            left = node.shards // 2 or 1
            parts = [Node(node.first, left)]
            if node.shards > 1:
                parts.append(Node(node.first + left, node.shards - left))
            names.append((len(children), len(children) + len(parts) - 1))
            children += parts
        for node, (a, b) in zip(nodes, names):  # figures no longer needed carry the children's numbers
            node.low, node.high = a, b
        right = (F.col("_key") > F.col("_at.cut")) | ((F.col("_key") == F.col("_at.cut")) & (F.col("_tie") >= F.col("_at.tie")))
        child = F.when(right, F.col("_at.high")).otherwise(F.col("_at.low")).cast("int")
        moved = beside(rows, nodes, set()).withColumn("_node", child).select(*rows.columns)
        rows, nodes = c.stored(moved, "keys"), children

    placed = rows.select("doc_id", "size", "text_crc32", F.col("_node").alias("shard"), "_tie")
    parts = c.shards_for(docs, 4 << 20)
    placed = placed.withColumn("_part", F.pmod("_tie", F.lit(parts)).cast("int"))
    counts = placed.groupBy("shard", "_part").agg(F.count("*").alias("_n"))
    before = counts.select(
        "shard", "_part", (F.sum("_n").over(Window.partitionBy("shard").orderBy("_part")) - F.col("_n")).alias("_before")
    )
    order = Window.partitionBy("shard", "_part").orderBy("doc_id", "text_crc32", "size")
    return (
        placed.withColumn("_row", F.row_number().over(order))
        .join(before, ["shard", "_part"])
        .select("doc_id", "size", "text_crc32", "shard", (F.col("_before") + F.col("_row") - 1).alias("slot"))
    )


@query("op9_sharding")
def op9(spark: SparkSession, folder: str) -> DataFrame:
    """Law ``bytes``: sizes near equal."""
    return sharded(c.table(spark, folder, "documents"), 40).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )
