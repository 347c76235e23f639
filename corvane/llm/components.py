"""Connected components, and links among the members of candidate buckets, without all pairs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm.recovery import discard, join_small, stored
from corvane.llm.set_pairs import search_cells

#: Neighbours of a node beyond which its edges are handled apart; so there are at most edges / HUB such nodes.
HUB = 1 << 20
#: Members of a cell, and pairs for each member that the first search of a cell gives.
BLOCK, PAIRS = 4096, 4


def _fingerprint(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def _hung(edges: DataFrame, of: DataFrame, hub: int, n_edges: int) -> DataFrame:
    """``edges`` with the least neighbour m of their u in ``of``; the edges of hubs stay where they are, and the hubs go to them."""
    least = of.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("d")).withColumn("m", F.least("u", "m"))
    if n_edges <= hub:
        return edges.join(least.drop("d"), "u")
    hubs = stored(least.where(F.col("d") > hub).drop("d"))
    rest = edges.join(F.broadcast(hubs.select("u")), "u", "left_anti").join(least.drop("d"), "u")
    return rest.union(edges.join(F.broadcast(hubs), "u"))


def components(edges: DataFrame, u: str = "u", v: str = "v", hub: int = HUB) -> DataFrame:
    """(node, component) for each node with an edge; a component is named by its least node.

    Union-find by alternating stars: each node hangs its larger neighbours, then its smaller
    ones, on the least of them, until nothing changes; that takes about log(longest path)
    rounds. Each round is two aggregates with map-side minimum and joins on the node. Nodes with over ``hub``
    neighbours are broadcast to their edges instead (at most edges / hub of them), so the
    neighbours of a node are never gathered in one task.
    """
    edges = stored(edges.select(F.greatest(u, v).alias("u"), F.least(u, v).alias("v")).where("u <> v").distinct())
    before = _fingerprint(edges)
    while before[0]:
        both = edges.union(edges.select("v", "u"))
        large = _hung(both.where("v > u"), both, hub, before[0]).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        small = _hung(large, large, hub, before[0]).select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*").where("u <> v").distinct()
        old, edges = edges, stored(small)
        discard(old)
        now = _fingerprint(edges)
        if now == before:
            break
        before = now
    found = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return found.union(found.select(F.col("component").alias("node"), "component")).distinct()


def _cells(labelled: DataFrame, block: int) -> DataFrame:
    """(bucket, i, j, side, node, label): the members of buckets with several labels, dealt to cells in which all pairs of different labels meet.

    A bucket of up to ``block`` members is one cell. Of a larger one, the members with the most
    frequent label are dealt to g cells' rows and the others to h; the former needn't meet each other. Main cells (g, h)
    hold a part of either, the other cells a pair of parts of the others; so no cell holds more than about two blocks.
    """
    by_label = labelled.groupBy("bucket", "label").agg(F.count("*").alias("k"))
    opened = by_label.groupBy("bucket").agg(F.sum("k").alias("n"), F.max("k").alias("k"), F.max_by("label", "k").alias("main"), F.count("*").alias("labels")).where("labels > 1")
    opened = stored(opened.select("bucket", "n", "main", F.ceil(F.col("k") / block).alias("g"), F.ceil((F.col("n") - F.col("k")) / block).alias("h")))
    salt = "pmod(xxhash64(node), %s)"
    one = "array(struct(0L as i, 0L as j, 0 as side))"
    main = f"transform(sequence(0L, h - 1), t -> struct({salt % 'g'} as i, -1L - t as j, 0 as side))"
    other = f"concat(transform(sequence(0L, g - 1), t -> struct(t as i, -1L - {salt % 'h'} as j, 1 as side)), transform(sequence(0L, h - 1), t -> struct(least(t, {salt % 'h'}) as i, greatest(t, {salt % 'h'}) as j, if(t < {salt % 'h'}, 1, 0) as side)))"
    dealt = labelled.join(opened, "bucket").select("bucket", "node", "label", F.explode(F.expr(f"if(n <= {block}, {one}, if(label = main, {main}, {other}))")).alias("c"))
    return dealt.select("bucket", "c.i", "c.j", "c.side", "node", "label")


def link_buckets(members: DataFrame, traits: DataFrame, confirm: Callable[[DataFrame], DataFrame], similarity: int, block: int = BLOCK, pairs_each: int = PAIRS) -> DataFrame:
    """Edges (a, b) that connect exactly what confirmed links connect: each node with the least one of its component, and the links found last.

    ``members`` has distinct (bucket, node), ``traits`` (node, n, bits): the size and parity bitmap of each
    node's set; both are stored. ``confirm`` gets distinct (a, b) with a < b and returns those that are linked.

    First the candidates of a bucket are a star: its least node with all others. Links found
    join nodes to components, and only pairs between different components of a bucket are of
    interest from then on. They are compared by bitmaps where they lie, in cells of bounded size, and a cell
    gives only pairs that the exact bound allows: all of them if they are at most ``pairs_each`` for each
    member, or else one for each member, which join components, and then the bucket, but no other, is searched again,
    with twice as many allowed. So no link that would connect two components is lost, and pairs
    that are left out are either proved too different or in one component already.
    """
    heads = stored(members.groupBy("bucket").agg(F.min("node").alias("c"), F.max("node").alias("hi")).where("c <> hi").select("bucket", "c"))
    pairs = tested = stored(members.join(heads, "bucket").where("node <> c").select(F.col("c").alias("a"), F.col("node").alias("b")).distinct())
    links = stored(confirm(pairs).select("a", "b"))
    searched = members
    while True:
        named = components(links, "a", "b")
        labelled = stored(searched.join(named, "node", "left").select("bucket", "node", F.coalesce("component", "node").alias("label")))
        cells = _cells(labelled, block).join(traits, "node").select("bucket", "i", "j", "side", "node", "label", "n", "bits")
        near = cells.repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j")
        found = stored(near.mapInArrow(search_cells(similarity, pairs_each), "a long, b long, again boolean, bucket long"))
        crowded = stored(found.where("again").select("bucket").distinct())
        pairs = stored(found.select("a", "b").distinct().join(tested, ["a", "b"], "left_anti"))
        discard(found, labelled)
        tested = tested.union(pairs)
        # what is connected already goes on as stars, which the next search of components leaves as they are
        links = named.where("node <> component").select(F.col("component").alias("a"), F.col("node").alias("b")).union(stored(confirm(pairs).select("a", "b")))
        if crowded.isEmpty():
            return links
        searched = join_small(searched, crowded, "bucket")  # the others gave all their pairs
        pairs_each *= 2
