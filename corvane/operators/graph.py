"""Graph queries over edges (source, target, type): traversal, reachability, components, order, layers.

Loops keep one row for each node on the frontier, write each level to the checkpoint folder and
stop on the driver by counts only.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.session import checkpointed, ranked, tasks_for

# Edge types that a traversal follows.
FOLLOWED = ["contains", "imports", "exports", "calls", "inherits", "implements", "overrides", "mentions", "references", "injects", "routes", "invokes"]
BUDGETS = {"max_seeds": 5, "max_nodes": 80, "max_edges": 160}


def adjacency(edges: DataFrame, types: Sequence[str] | None = FOLLOWED) -> DataFrame:
    """(node, to, edge columns): each followed edge from either end."""
    e = edges if types is None else edges.where(F.col("type").isin(*types))
    return e.select(F.col("source").alias("node"), F.col("target").alias("to"), "source", "target", "type").unionByName(e.select(F.col("target").alias("node"), F.col("source").alias("to"), "source", "target", "type"))


def one_hop(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """(node) of the seeds and their neighbours in either direction."""
    near = adjacency(edges).join(seeds.select("node"), "node", "left_semi").select(F.col("to").alias("node"))
    return seeds.select("node").unionByName(near).distinct()


# A frontier of fewer nodes than this is broadcast, after it has been counted; 2^16 nodes are a few MB.
FEW_NODES = 1 << 16


def levels(edges: DataFrame, seeds: DataFrame, max_hops: int | None = None, directed: bool = False, types: Sequence[str] | None = None, targets: Sequence = ()) -> DataFrame:
    """(node, hop): how many edges each node reached is away from the nearest seed. Nodes are visited once; cycles end. With targets, nothing beyond the first level that has one.

    Edges are kept once for both directions. They meet a small frontier where they lie; only a large one makes them move.
    """
    e = edges if types is None else edges.where(F.col("type").isin(*types))
    step = checkpointed(e.select(F.col("source").alias("node"), F.col("target").alias("to")))
    ways = [step] if directed else [step, step.select(F.col("to").alias("node"), F.col("node").alias("to"))]
    seen = frontier = checkpointed(seeds.select("node").distinct().withColumn("hop", F.lit(0)))
    size, hop = frontier.count(), 0
    found = bool(targets) and not frontier.where(F.col("node").isin(*targets)).isEmpty()
    while size and not found and (max_hops is None or hop < max_hops):
        hop += 1
        few = size < FEW_NODES
        near = F.broadcast(frontier.select("node")) if few else frontier.select("node").hint("merge")  # few by the count
        ahead = None
        for way in ways:
            part = way.join(near, "node", "left_semi").select(F.col("to").alias("node"))
            ahead = part if ahead is None else ahead.unionByName(part)
        frontier = checkpointed(ahead.distinct().join(seen.select("node").hint("merge"), "node", "left_anti").withColumn("hop", F.lit(hop)))
        size = frontier.count()
        if size:
            seen = seen.unionByName(frontier)
            found = bool(targets) and not frontier.where(F.col("node").isin(*targets)).isEmpty()
    return seen


def reachable(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """(node) reached from the roots along the edges' direction, roots included."""
    return levels(edges, roots, directed=True).select("node")


def weak_components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, component): the least node of each weakly connected component.

    Each round a node takes the least label around it, and then the label of its label, so long
    chains halve. Minimums are taken map-side, so hubs are no bottleneck.
    """
    both = edges.select("source", "target").union(edges.select("target", "source")).toDF("node", "to").where("node <> to").distinct()
    both = checkpointed(both)
    labels = checkpointed(nodes.select("node").distinct().withColumn("component", F.col("node")))
    while True:
        near = both.join(labels.withColumnRenamed("node", "to"), "to").groupBy("node").agg(F.min("component").alias("m"))
        lower = labels.join(near, "node", "left").select("node", F.least("component", F.coalesce("m", "component")).alias("component"))
        jump = lower.select(F.col("node").alias("component"), F.col("component").alias("root"))
        now = checkpointed(lower.join(jump, "component", "left").select("node", F.coalesce("root", "component").alias("component")))
        moved = now.join(labels.withColumnRenamed("component", "was"), "node").where("component <> was")
        if moved.isEmpty():
            return now
        labels = now


# Up to so many edges one task finishes strong components, after they have been counted; it holds some 50 MB then.
FEW_EDGES = 1 << 17


def _strong_in_one_task(links: DataFrame) -> DataFrame:
    """(node, component) of nodes with edges, by Tarjan's search without recursion; for few edges."""
    kind = links.schema["source"].dataType.simpleString()

    def search(parts):
        ahead: dict = {}
        for part in parts:
            for a, b in zip(part["source"].tolist(), part["target"].tolist(), strict=True):
                ahead.setdefault(a, []).append(b)
                ahead.setdefault(b, [])
        place, low, held, stack, out = {}, {}, set(), [], []
        for root in ahead:
            work = [] if root in place else [(root, iter(ahead[root]))]
            if work:
                place[root] = low[root] = len(place)
                stack.append(root)
                held.add(root)
            while work:
                n, rest = work[-1]
                m = next((m for m in rest if m not in place or m in held), None)
                if m is None:
                    work.pop()
                    if work:
                        low[work[-1][0]] = min(low[work[-1][0]], low[n])
                    if low[n] == place[n]:
                        own = [stack.pop()]
                        while own[-1] != n:
                            own.append(stack.pop())
                        held.difference_update(own)
                        least = min(own)
                        out += [(x, least) for x in own]
                elif m in place:
                    low[n] = min(low[n], place[m])
                else:
                    place[m] = low[m] = len(place)
                    stack.append(m)
                    held.add(m)
                    work.append((m, iter(ahead[m])))
        yield pd.DataFrame(out, columns=["node", "component"])

    return links.coalesce(1).mapInPandas(search, f"node {kind}, component {kind}")


def strong_components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, component): the least node of each strongly connected component, by forward and backward colours.

    Colours spread the greatest node forward to a fixpoint; what reaches a colour's own node backwards
    inside the colour is its component and leaves the graph. Each round settles a component of every
    colour; nodes without edges in or out are trimmed first. Once few edges are left, one task searches them.
    """
    left = checkpointed(nodes.select("node").distinct())
    done = None
    links = checkpointed(edges.select("source", "target").where("source <> target").distinct())
    while not left.isEmpty():
        # nodes that lack an edge in or out inside the rest are components by themselves
        while True:
            inner = links.join(left.withColumnRenamed("node", "source"), "source", "left_semi").join(left.withColumnRenamed("node", "target"), "target", "left_semi")
            links = checkpointed(inner)
            if links.count() <= FEW_EDGES:
                found = checkpointed(_strong_in_one_task(links))
                own = found.unionByName(left.join(found, "node", "left_anti").select("node", F.col("node").alias("component")))
                return own if done is None else done.unionByName(own)
            core = links.select(F.col("source").alias("node")).distinct().join(links.select(F.col("target").alias("node")), "node", "left_semi")
            alone = checkpointed(left.join(core, "node", "left_anti"))
            if alone.isEmpty():
                break
            own = alone.withColumn("component", F.col("node"))
            done = own if done is None else done.unionByName(own)
            left = checkpointed(left.join(alone, "node", "left_anti"))
        if left.isEmpty():
            break
        colour = checkpointed(left.withColumn("colour", F.col("node")))
        while True:
            incoming = links.join(colour.withColumnRenamed("node", "source"), "source").groupBy(F.col("target").alias("node")).agg(F.max("colour").alias("m"))
            now = checkpointed(colour.join(incoming, "node", "left").select("node", F.greatest("colour", F.coalesce("m", "colour")).alias("colour")))
            same = now.join(colour.withColumnRenamed("colour", "was"), "node").where("colour <> was").isEmpty()
            colour = now
            if same:
                break
        inside = links.join(colour.select(F.col("node").alias("source"), F.col("colour").alias("cs")), "source").join(colour.select(F.col("node").alias("target"), F.col("colour").alias("ct")), "target").where("cs = ct").select(F.col("target").alias("source"), F.col("source").alias("target"))
        found = levels(inside.withColumn("type", F.lit("")), colour.where("node = colour").select("node"), directed=True).select("node")
        settled = checkpointed(found.join(colour, "node"))
        names = settled.groupBy("colour").agg(F.min("node").alias("component"))
        own = settled.join(names, "colour").select("node", "component")
        done = own if done is None else done.unionByName(own)
        left = checkpointed(left.join(settled, "node", "left_anti"))
    return done if done is not None else nodes.select("node", F.col("node").alias("component"))


def shortest_path(edges: DataFrame, seeds: Sequence, targets: Sequence, max_hops: int = 6, types: Sequence[str] | None = None) -> DataFrame:
    """(pos, node): one shortest undirected path from a seed to a target, of equal ones that with the least nodes from the target back; empty if there is none in reach."""
    spark = edges.sparkSession
    kind = edges.schema["source"].dataType.simpleString()
    reached = levels(edges, spark.createDataFrame([(s,) for s in seeds], f"node {kind}"), max_hops, types=types, targets=targets)
    end = reached.where(F.col("node").isin(*targets)).orderBy("hop", "node").first()
    path = []
    if end is not None:
        path, around = [end["node"]], adjacency(edges, types).select("node", "to")
        for hop in range(end["hop"] - 1, -1, -1):
            before = around.where(F.col("node") == F.lit(path[-1])).select(F.col("to").alias("node")).join(reached.where(F.col("hop") == hop), "node").agg(F.min("node")).first()[0]
            path.append(before)
    return spark.createDataFrame([(i, n) for i, n in enumerate(reversed(path))], f"pos int, node {kind}")


def traverse(edges: DataFrame, seeds: Sequence, max_hops: int = 4, targets: Sequence = (), budgets: dict | None = None, types: Sequence[str] | None = FOLLOWED) -> tuple[list, list, dict]:
    """Bounded breadth-first search: (nodes, edges, boundary) with the reason it stopped.

    The reasons, first that applies: found, edge-budget, node-budget, max-hops, seed-budget, then
    unreachable with targets or exhausted without. Neighbours are taken in the order of (frontier
    place, other end, type, source, target). Of each level at most as many edges come to the
    driver as the budgets can use, one for each frontier node's place in that order.
    """
    b = BUDGETS | (budgets or {})
    used, wanted = list(seeds[: b["max_seeds"]]), set(targets)
    visited, order, edges_kept, edge_keys = set(used), list(used), [], set()
    found = next((s for s in used if s in wanted), None)
    frontier, hops, over = list(used), 0, {"edge-budget": False, "node-budget": False, "max-hops": False}
    around = adjacency(edges, types)
    spark = edges.sparkSession
    kind = edges.schema["source"].dataType.simpleString()
    while frontier and found is None and not (over["edge-budget"] or over["node-budget"]):
        places = spark.createDataFrame([(n, i) for i, n in enumerate(frontier)], f"node {kind}, place int")
        # everything that can still be taken is among the first edges by this order: each takes an edge or was seen
        room = b["max_edges"] + len(edge_keys) + 1
        rows = around.join(F.broadcast(places), "node").distinct().orderBy("place", "to", "type", "source", "target").limit(2 * room).collect()  # the frontier is bounded by max_nodes
        ahead = []
        for r in rows:
            new = r["to"] not in visited
            if new and hops + 1 > max_hops:
                over["max-hops"] = True
                continue
            key = (r["type"], r["source"], r["target"])
            if key not in edge_keys and len(edge_keys) >= b["max_edges"]:
                over["edge-budget"] = True
                break
            if new:
                if len(visited) >= b["max_nodes"]:
                    over["node-budget"] = True
                    break
                visited.add(r["to"])
                order.append(r["to"])
                ahead.append(r["to"])
                if r["to"] in wanted:
                    found = r["to"]
            if key not in edge_keys:
                edge_keys.add(key)
                edges_kept.append(key)
            if found is not None:
                break
        if not ahead:
            break
        if found is None and not (over["edge-budget"] or over["node-budget"]):
            hops += 1
        frontier = ahead
    reason = "found" if found is not None else next((k for k, v in over.items() if v), None) or ("seed-budget" if len(seeds) > b["max_seeds"] else "unreachable" if wanted else "exhausted")
    boundary = {"reason": reason, "truncated": reason in ("edge-budget", "node-budget", "max-hops", "seed-budget"), "hops": hops, "seeds_requested": len(seeds), "seeds_used": len(used), "nodes": len(visited), "edges": len(edge_keys)}
    return order, edges_kept, boundary


def file_graph(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(source, target) of distinct pairs of files, lifted from edges of nodes (id, path), and (reason, edges) of those left out."""
    ends = nodes.select("id", "path")
    lifted = edges.join(ends.toDF("source", "from"), "source", "left").join(ends.toDF("target", "into"), "target", "left")
    reason = F.when(F.col("from").isNull() | F.col("into").isNull(), "unresolved").when(F.col("from") == F.col("into"), "same-file").otherwise("kept")
    lifted = lifted.withColumn("reason", reason)
    pairs = lifted.where("reason = 'kept'").select(F.col("from").alias("source"), F.col("into").alias("target")).distinct()
    return pairs, lifted.groupBy("reason").agg(F.count("*").alias("edges"))


def fan(pairs: DataFrame) -> DataFrame:
    """(node, fan_in, fan_out) of distinct pairs."""
    sides = pairs.select(F.explode(F.array(F.struct(F.col("source").alias("node"), F.lit(0).alias("i"), F.lit(1).alias("o")), F.struct(F.col("target").alias("node"), F.lit(1).alias("i"), F.lit(0).alias("o")))).alias("e"))
    return sides.groupBy("e.node").agg(F.sum("e.i").alias("fan_in"), F.sum("e.o").alias("fan_out"))


def reading_order(pairs: DataFrame, start: DataFrame, max_depth: int) -> DataFrame:
    """(node, depth, place): level by level, files of more fan-in first, then by path."""
    reached = levels(pairs.withColumn("type", F.lit("")), start, max_depth, directed=True)
    ranked = reached.join(fan(pairs).select("node", "fan_in"), "node", "left")
    w = Window.partitionBy("hop").orderBy(F.desc(F.coalesce("fan_in", F.lit(0))), "node")
    return ranked.select("node", F.col("hop").alias("depth"), F.row_number().over(w).alias("place"))


def detect_layers(files: DataFrame, patterns: Sequence[tuple[str, Sequence[str]]], default: str = "Core") -> DataFrame:
    """(path, layer): the first layer in the list of which a path segment is a pattern or its plural, in lower case."""
    rows = [(i, name, p) for i, (name, words) in enumerate(patterns) for w in words for p in (w, w + "s")]
    table = files.sparkSession.createDataFrame(rows, "priority int, layer string, segment string")
    segments = files.select("path", F.explode(F.split(F.lower("path"), "/")).alias("segment"))
    hit = segments.join(table, "segment").groupBy("path").agg(F.min_by("layer", "priority").alias("layer"))
    return files.select("path").join(hit, "path", "left").select("path", F.coalesce("layer", F.lit(default)).alias("layer"))


def layer_stats(members: DataFrame, nodes: DataFrame) -> DataFrame:
    """(layer, nodes, complexity): complex if over 30 % of a layer's nodes are, then moderate likewise, else simple."""
    rows = members.join(nodes, "id")
    n, c, m = F.count("*"), F.count_if(F.col("complexity") == "complex"), F.count_if(F.col("complexity") == "moderate")
    return rows.groupBy("layer").agg(n.alias("nodes"), F.when(c > 0.3 * n, "complex").when(m > 0.3 * n, "moderate").otherwise("simple").alias("complexity"))


def first_layer(members: DataFrame) -> DataFrame:
    """(id, layer): the first layer, by position, that names a node."""
    return members.groupBy("id").agg(F.min_by("layer", "position").alias("layer"))


def filter_nodes(nodes: DataFrame, types: Sequence[str], complexities: Sequence[str], members: DataFrame | None = None, layers: Sequence[str] = ()) -> DataFrame:
    """Nodes of the types and complexities (unknown complexity passes), in any of the layers if some are chosen."""
    out = nodes.where(F.col("type").isin(*types) & (F.coalesce(F.col("complexity"), F.lit("")).isin("", *complexities)))
    return out if not layers else out.join(members.where(F.col("layer").isin(*layers)), "id", "left_semi")


def filter_edges(edges: DataFrame, visible: DataFrame, categories: dict[str, str], active: Sequence[str]) -> DataFrame:
    """Edges with both ends visible whose type's category is active; types without a category pass."""
    seen = edges.join(visible.select(F.col("id").alias("source")), "source", "left_semi").join(visible.select(F.col("id").alias("target")), "target", "left_semi")
    category = F.element_at(F.create_map(*[F.lit(x) for kv in categories.items() for x in kv]), F.col("type"))
    return seen.where(category.isNull() | category.isin(*active))


def affected(nodes: DataFrame, edges: DataFrame, changed_paths: DataFrame) -> DataFrame:
    """(id, state): nodes of changed files, and their neighbours in either direction."""
    changed = nodes.join(changed_paths, "path", "left_semi").select("id")
    near = adjacency(edges, None).join(changed.withColumnRenamed("id", "node"), "node", "left_semi").select(F.col("to").alias("id")).distinct().join(changed, "id", "left_anti")
    return changed.withColumn("state", F.lit("changed")).unionByName(near.join(nodes.select("id"), "id", "left_semi").withColumn("state", F.lit("affected")))


def induced(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with both ends among the nodes."""
    return edges.join(nodes.select(F.col("node").alias("source")), "source", "left_semi").join(nodes.select(F.col("node").alias("target")), "target", "left_semi")


def chunk_groups(groups: DataFrame, small: int = 3, size: int = 25) -> DataFrame:
    """(member, batch): groups of fewer than ``small`` members pooled, in the order of members, in chunks of ``size``; others stay."""
    counted = groups.join(groups.groupBy("grp").agg(F.count("*").alias("n")), "grp")
    pooled = ranked(counted.where(F.col("n") < small).select("member"), "member")
    return counted.where(F.col("n") >= small).select("member", F.concat(F.lit("g:"), F.col("grp").cast("string")).alias("batch")).unionByName(pooled.select("member", F.concat(F.lit("pool:"), F.floor(F.col("__rank") / size).cast("string")).alias("batch")))


def neighbours_outside(batches: DataFrame, edges: DataFrame, cap: int = 50) -> DataFrame:
    """(batch, neighbour, degree): 1-hop neighbours of a batch outside it, the ``cap`` of most edges."""
    around = adjacency(edges, None).join(batches.toDF("node", "batch"), "node").join(batches.toDF("to", "other"), "to", "left").where("other is null or other <> batch")
    degree = around.groupBy("batch", F.col("to").alias("neighbour")).agg(F.count("*").alias("degree"))
    w = Window.partitionBy("batch").orderBy(F.desc("degree"), "neighbour")
    return degree.withColumn("n", F.row_number().over(w)).where(F.col("n") <= cap).drop("n")  # the cap is the report's


def propagate_least(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, level): the least level among a node and everything that reaches it, to a fixpoint over any graph."""
    now = checkpointed(nodes.select("node", "level"))
    while True:
        incoming = edges.join(now.withColumnRenamed("node", "source"), "source").groupBy(F.col("target").alias("node")).agg(F.min("level").alias("m"))
        nxt = checkpointed(now.join(incoming, "node", "left").select("node", F.least("level", F.coalesce("m", "level")).alias("level")))
        if nxt.join(now.withColumnRenamed("level", "was"), "node").where("level <> was").isEmpty():
            return nxt
        now = nxt


# A node with at least as many neighbours counts their groups in arrays.
FEW_NEIGHBOURS = 48


def communities(edges: DataFrame, components: DataFrame) -> DataFrame:
    """(node, community): Louvain-style local moving within each weak component, one component for each group.

    Deterministic: nodes move in order to the neighbouring community of the largest gain, ties to the least name.
    A component must fit one worker, which holds for the module graphs this is for.
    """
    rows = edges.select("source", "target").where("source <> target").distinct().join(components.select(F.col("node").alias("source"), "component"), "source")

    def move(part: pd.DataFrame) -> pd.DataFrame:
        sides = part["source"].to_numpy(), part["target"].to_numpy()
        names, place = np.unique(np.concatenate(sides), return_inverse=True)
        from_, to = place, np.concatenate([place[len(part) :], place[: len(part)]])
        near = to[np.argsort(from_, kind="stable")]
        degree = np.bincount(from_, minlength=len(names))
        starts, total = np.concatenate([[0], np.cumsum(degree)]).tolist(), len(near)
        group, weight = np.arange(len(names)), degree.copy()
        for _ in range(20):
            moved = False
            for n, d in enumerate(degree.tolist()):
                own, around = int(group[n]), group[near[starts[n] : starts[n + 1]]]
                weight[own] -= d
                if d < FEW_NEIGHBOURS:
                    links: dict = {}
                    for g in around.tolist():
                        links[g] = links.get(g, 0) + 1
                    best = min({*links, own}, key=lambda g: (int(weight[g]) * d / total - links.get(g, 0), g != own, g))
                else:
                    found, count = np.unique(around, return_counts=True)
                    score = count - weight[found] * d / total
                    at, mine = int(np.argmax(score)), int(np.searchsorted(found, own))
                    held = score[mine] if mine < len(found) and found[mine] == own else -(int(weight[own]) * d / total)
                    best = own if held >= score[at] else int(found[at])
                weight[best] += d
                if best != own:
                    group[n], moved = best, True
            if not moved:
                break
        _, first, which = np.unique(group, return_index=True, return_inverse=True)
        return pd.DataFrame({"node": names, "community": names[first[which]]})

    kind = edges.schema["source"].dataType.simpleString()
    return rows.repartition(tasks_for(rows), "component").groupBy("component").applyInPandas(move, f"node {kind}, community {kind}")


def own_confidence(signals: Column) -> Column:
    """high, medium or low: the least of an array of levels 2, 1, 0; high without any."""
    least = F.coalesce(F.array_min(signals), F.lit(2))
    return F.when(least >= 2, "high").when(least == 1, "medium").otherwise("low")
