"""Multi-hop paths, reachability and effective connectivity by unrolled joins."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import BROADCAST_IDS, DEAL, Blocks, Graph, among, block_edges, check_ids, id_frame, input_normalized, input_totals, per_node, settle


def small(df: DataFrame, rows: int) -> DataFrame:
    """``df``, to be broadcast if its counted rows are few enough."""
    return F.broadcast(df) if rows <= BROADCAST_IDS else df


#: Rows of a join that one cell of a heavy key makes.
CELL_ROWS = 1_000_000


def heavy_keys(left: DataFrame, right_rows: DataFrame, key: str, cell_rows: int) -> DataFrame:
    """(key, _a, _b): the keys that make more than ``cell_rows`` rows in a join of ``left`` with the side that has
    ``right_rows`` (key, _m) rows a key, and into how many parts each side of them is cut."""
    both = left.groupBy(key).agg(F.count("*").alias("_n")).join(right_rows, key)
    cells = F.ceil(F.col("_n") * F.col("_m") / cell_rows)
    both = both.where(F.col("_n") * F.col("_m") > cell_rows).withColumn("_a", F.least("_n", F.ceil(F.sqrt(cells))))
    return both.select(key, F.col("_a").cast("int").alias("_a"), F.least("_m", F.ceil(cells / F.col("_a"))).cast("int").alias("_b"))


def grid_join(left: DataFrame, right: DataFrame, key: str, *, right_rows: DataFrame | None = None, cell_rows: int | None = None) -> DataFrame:
    """``left`` joined with ``right`` on ``key``, where hubs are cut on both sides. The sides of a heavy key are dealt by hashes
    into a and b parts, and each part meets every part of the other side, so a hub's rows are made by a x b cells, which
    are keys of their own: a task makes about ``cell_rows`` rows of it, for b copies of its left and a copies of its right
    rows. The other keys keep one cell. Both sides should be settled, as they are counted first."""
    cell_rows = cell_rows or CELL_ROWS
    if right_rows is None:
        right_rows = right.groupBy(key).agg(F.count("*").alias("_m"))
    hubs = settle(heavy_keys(left, right_rows, key, cell_rows))
    n = hubs.count()
    if not n:
        return left.join(right, key)
    hubs = small(hubs, n)

    def dealt(side: DataFrame, own: str, parts: str, other: str, copies: str) -> DataFrame:
        at = F.pmod(F.xxhash64(*side.columns), F.coalesce(parts, F.lit(1)))
        every = F.explode(F.sequence(F.lit(0), F.coalesce(copies, F.lit(1)) - 1))
        return side.join(hubs, key, "left").select(*side.columns, at.alias(own), every.alias(other))

    cells = dealt(left, "_i", "_a", "_j", "_b").join(dealt(right, "_j", "_b", "_i", "_a"), [key, "_i", "_j"])
    return cells.select(*left.columns, *(c for c in right.columns if c != key))


def settled(graph: Graph) -> Graph:
    """``graph`` with its tables computed once, for operators that read them several times. Edges of blocks stay blocks, of which
    the edges are made where they are read."""
    b = graph.factored
    if b is None:
        return replace(graph, nodes=settle(graph.nodes), edges=settle(graph.edges))
    plain, pre, post, weights = map(settle, (b.plain, b.pre, b.post, b.weights))
    dealt = pre.repartition(DEAL * graph.spark.sparkContext.defaultParallelism, "pre")
    edges = plain.unionByName(dealt.join(weights, "pre_block").join(post, "post_block").select("pre", "post", "weight"))
    return replace(graph, nodes=settle(graph.nodes), edges=edges, blocks=Blocks(edges, plain, pre, post, weights))


def filtered_edges(graph: Graph, min_weight: int = 1, min_edge_fraction: float = 0.0) -> DataFrame:
    """(pre, post, weight, fraction) at ``min_weight`` and ``min_edge_fraction`` or more; the totals are those
    of the unfiltered graph."""
    e = _at_least(input_normalized(graph), min_weight)
    return e.where(F.col("fraction") >= min_edge_fraction) if min_edge_fraction > 0 else e


def _at_least(edges: DataFrame, min_weight: int) -> DataFrame:
    """Edges of ``min_weight`` or more; the filter that says nothing would stand in the way of semi-joins."""
    return edges.where(F.col("weight") >= min_weight) if min_weight > 1 else edges


@dataclass(frozen=True)
class Parts:
    """Edges as ``plain`` ones and, where the graph has blocks, ``pre`` (pre, pre_block) and ``links`` (pre_block, post, weight): each
    node of a pre_block has an edge to each post of its links."""

    plain: DataFrame
    pre: DataFrame | None = None
    links: DataFrame | None = None

    def where(self, keep: Callable[[DataFrame], DataFrame]) -> Parts:
        """The edges that ``keep``, a filter of post, weight and fraction, leaves."""
        return Parts(keep(self.plain)) if self.links is None else Parts(keep(self.plain), self.pre, keep(self.links))


def _parts(graph: Graph, min_weight: int, min_edge_fraction: float = 0.0) -> Parts:
    """The edges at ``min_weight`` and ``min_edge_fraction`` or more, with fractions only if these are asked for."""
    b = graph.factored
    all_ = Parts(graph.edges) if b is None else Parts(b.plain, b.pre, b.links())
    if min_edge_fraction > 0:
        all_ = _with_fractions(all_, per_node(input_totals(graph))).where(lambda e: e.where(F.col("fraction") >= min_edge_fraction))
    all_ = all_.where(lambda e: _at_least(e, min_weight))
    return all_ if b is None else replace(all_, pre=settle(all_.pre), links=settle(all_.links))


def _with_fractions(parts: Parts, totals: DataFrame) -> Parts:
    frac = F.coalesce(F.when(F.col("total") > 0, F.col("weight") / F.col("total")).otherwise(F.lit(0.0)), F.lit(0.0))
    return parts.where(lambda e: e.join(totals, "post", "left").withColumn("fraction", frac).drop("total"))


def _between(graph: Graph, parts: Parts, nodes: DataFrame) -> DataFrame:
    """(pre, post, weight, fraction) of the edges whose two ends are among ``nodes`` (neuron_id, settled); the totals are those of the
    graph, and are summed for these nodes alone."""
    n = nodes.count()
    ends = lambda c: small(nodes.select(F.col("neuron_id").alias(c)), n)
    near = parts.where(lambda e: e.join(ends("post"), "post", "left_semi"))
    if "fraction" not in parts.plain.columns:
        near = _with_fractions(near, small(settle(input_totals(graph, posts=ends("post"))), n))
    plain = near.plain.join(ends("pre"), "pre", "left_semi").select("pre", "post", "weight", "fraction")
    if near.links is None:
        return plain
    made = block_edges(near.pre.join(ends("pre"), "pre", "left_semi"), near.links)
    return plain.unionByName(made.select("pre", "post", "weight", "fraction"))


def bfs_distances(edges: DataFrame | Parts, start: Sequence[int], max_depth: int, *, backwards: bool = False) -> DataFrame:
    """(node, distance) of nodes within ``max_depth`` hops of ``start`` (0 for these).

    Edges of blocks (``Parts``) are not made: a frontier meets the blocks of its nodes, and these the nodes at their other ends.
    Edges may be a plan: ``start`` is a filter on them, a later frontier a semi-join, and the ends are told apart by an aggregate that
    keeps one row a node, so no edge is moved."""
    parts = edges if isinstance(edges, Parts) else Parts(edges)
    a, b = ("post", "pre") if backwards else ("pre", "post")
    enter, leave = (parts.links, parts.pre) if backwards else (parts.pre, parts.links)
    steps = parts.plain.select(F.col(a).alias("_from"), F.col(b).alias("_to"))
    seen = frontier = id_frame(parts.plain, start, "node").withColumn("distance", F.lit(0))
    size = total = len(set(start))
    for depth in range(1, max_depth + 1):
        met = lambda df, c: among(df, c, start) if depth == 1 else df.join(small(frontier.select(F.col("node").alias(c)), size), c, "left_semi")  # noqa: B023, E731
        new = met(steps, "_from").select(F.col("_to").alias("node"))
        if enter is not None:
            new = new.unionByName(leave.join(met(enter, a).select("pre_block").distinct(), "pre_block", "left_semi").select(F.col(b).alias("node")))
        new = new.distinct()
        # A few joins of settled edges make a frontier again if an executor is lost, so it is cached and not written.
        frontier = new.join(small(seen.select("node"), total), "node", "left_anti").withColumn("distance", F.lit(depth)).persist()
        size = frontier.count()
        if not size:
            break
        seen, total = seen.unionByName(frontier), total + size
    return seen


def nodes_on_paths(graph: Graph, sources: Sequence[int], targets: Sequence[int], *, max_hops: int = 3, min_weight: int = 1, min_edge_fraction: float = 0.0) -> DataFrame:
    """Nodes whose distances from the sources and to the targets sum up to ``max_hops`` or less, all sources,
    and the targets that are reached."""
    sources, targets = check_ids(graph, sources), check_ids(graph, targets)
    return _reach(_parts(graph, min_weight, min_edge_fraction), sources, targets, max_hops).select("neuron_id")


def _reach(e: Parts, sources: Sequence[int], targets: Sequence[int], max_hops: int) -> DataFrame:
    fwd = bfs_distances(e, sources, max_hops)
    back = bfs_distances(e, targets, max_hops, backwards=True).withColumnRenamed("distance", "to_target")
    near = fwd.join(back, "node", "full").where((F.coalesce("distance", F.lit(max_hops + 1)) + F.coalesce("to_target", F.lit(max_hops + 1)) <= max_hops) | (F.col("distance") == 0))
    return near.select(F.col("node").alias("neuron_id"), F.coalesce("to_target", F.lit(max_hops + 1)).alias("to_target"))


def find_paths(graph: Graph, sources: Sequence[int], targets: Sequence[int], *, max_hops: int = 3, min_weight: int = 1, min_edge_fraction: float = 0.0, min_strength: float = 0.0, label: str | None = None, max_paths: int | None = None) -> DataFrame:
    """Node-simple paths from sources to targets, where a path ends at the first target it reaches.

    Columns: path, hops, weights, signs, path_sign (0 if any sign is), strength (product of input fractions),
    min_weight, source, target, truncated and, with ``label``, labels. Each level is one join with the edges that can
    still reach a target in time (a semi-join reduction by distances from both ends); a level's rows that
    reach a target are emitted, the rest goes on. ``max_paths`` (None: no limit) keeps the first paths in order of
    source position and then ids, as a depth-first search over sorted ids would meet them; ``truncated`` tells
    whether there are more."""
    if max_hops < 1:
        raise ValueError("max_hops must be >= 1")
    graph = replace(graph, nodes=settle(graph.nodes))
    sources, targets = check_ids(graph, sources), check_ids(graph, targets)
    parts = _parts(graph, min_weight, min_edge_fraction)
    on_path = settle(_reach(parts, sources, targets, max_hops))
    signs = graph.nodes.select(F.col("neuron_id").alias("pre"), F.col("sign").cast("double").alias("sign"))
    steps = settle(
        _between(graph, parts, on_path.select("neuron_id"))
        .join(on_path.select(F.col("neuron_id").alias("post"), "to_target"), "post")
        .join(signs, "pre")
        .select(F.col("pre").alias("_last"), F.col("post").alias("_next"), F.col("weight").cast("long").alias("_w"), "fraction", "sign", "to_target")
    )
    n_steps = steps.count()
    degrees = settle(steps.groupBy("_last").agg(F.count("*").alias("_m"))) if n_steps > BROADCAST_IDS else None
    goal = id_frame(graph.nodes, targets, "_last").withColumn("_hit", F.lit(True))
    first = graph.spark.createDataFrame([(i, int(s)) for i, s in enumerate(dict.fromkeys(sources))], "_turn int, _last long")
    frontier = first.select("_turn", "_last", F.array("_last").alias("path"), F.expr("cast(array() as array<bigint>)").alias("weights"), F.expr("cast(array() as array<double>)").alias("signs"), F.lit(1.0).alias("strength"))
    found = None
    for depth in range(1, max_hops + 1):
        grown = (
            (frontier.join(F.broadcast(steps), "_last") if degrees is None else grid_join(frontier, steps, "_last", right_rows=degrees))
            .where((F.col("to_target") <= max_hops - depth) & ~F.array_contains("path", F.col("_next")) & (F.col("strength") * F.col("fraction") >= min_strength))
            .select("_turn", F.col("_next").alias("_last"), F.array_append("path", F.col("_next")).alias("path"), F.array_append("weights", F.col("_w")).alias("weights"), F.array_append("signs", F.col("sign")).alias("signs"), (F.col("strength") * F.col("fraction")).alias("strength"))
            .join(goal, "_last", "left")
        )
        grown = settle(grown)
        reached = grown.where("_hit").drop("_hit")
        found = reached if found is None else found.unionByName(reached)
        frontier = grown.where("_hit is null").drop("_hit")
        if depth < max_hops and frontier.isEmpty():
            break
    product = F.aggregate("signs", F.lit(1.0), lambda a, x: a * x)
    out = found.select(
        "path",
        (F.size("path") - 1).alias("hops"),
        "weights",
        "signs",
        F.when(product == 0, F.lit(0.0)).otherwise(product).alias("path_sign"),
        "strength",
        F.array_min("weights").alias("min_weight"),
        F.element_at("path", 1).alias("source"),
        F.element_at("path", -1).alias("target"),
        "_turn",
    )
    if max_paths is not None:
        more = out.limit(max_paths + 1).agg((F.count("*") > max_paths).alias("truncated"))
        out = out.orderBy("_turn", "path").limit(max_paths).join(F.broadcast(more))
    else:
        out = out.withColumn("truncated", F.lit(False))
    out = out.drop("_turn")
    if label:
        out = with_labels(out, graph, label)
    return out.orderBy(F.desc("strength"), "hops", "path")


#: Partial paths that the first, inexact pass of ``strongest_paths`` keeps a level, for each path asked for.
BEAM = 4


def strongest_paths(graph: Graph, sources: Sequence[int], targets: Sequence[int], k: int, *, max_hops: int = 3, min_weight: int = 1, min_edge_fraction: float = 0.0) -> DataFrame:
    """The ``k`` first rows (path, hops, strength, path_sign, min_weight, source, target) of ``find_paths`` in its order, without
    growing the others.

    The best product from a node to a target in at most h hops, found backwards, bounds what a partial path can still reach. A first
    pass keeps the ``BEAM * k`` best partial paths a level; the kth strength that it finds is met by k paths, so the second,
    exact pass drops every partial path whose bound is below it. Where the first pass finds fewer than k paths,
    the second one grows all. ``BEAM * k`` rows a level pass through one task, so k is for reports, not for exports."""
    if max_hops < 1 or k < 1:
        raise ValueError("max_hops and k must be >= 1")
    graph = replace(graph, nodes=settle(graph.nodes))
    sources, targets = check_ids(graph, sources), check_ids(graph, targets)
    parts = _parts(graph, min_weight, min_edge_fraction)
    near = settle(_reach(parts, sources, targets, max_hops).select("neuron_id"))
    signs = graph.nodes.select(F.col("neuron_id").alias("pre"), F.col("sign").cast("double").alias("sign"))
    steps = _between(graph, parts, near).join(signs, "pre")
    steps = settle(steps.select(F.col("pre").alias("_last"), F.col("post").alias("_next"), F.col("weight").cast("long").alias("_w"), "fraction", "sign"))
    goal = id_frame(graph.nodes, targets, "_next").withColumn("_hit", F.lit(True))
    ahead = [id_frame(graph.nodes, targets, "_next").withColumn("_bound", F.lit(1.0))]
    for _ in range(1, max_hops):
        longer = steps.join(ahead[-1], "_next").select(F.col("_last").alias("_next"), (F.col("fraction") * F.col("_bound")).alias("_bound"))
        ahead.append(settle(ahead[0].unionByName(longer).groupBy("_next").agg(F.max("_bound").alias("_bound"))))
    start = graph.spark.createDataFrame([(int(s),) for s in dict.fromkeys(sources)], "_last long")
    start = start.select("_last", F.array("_last").alias("path"), F.lit(1.0).alias("strength"), F.lit(1.0).alias("path_sign"), F.lit(None).cast("long").alias("min_weight"))

    def grow(low: float, beam: int | None) -> DataFrame:
        frontier, found = start, None
        for depth in range(1, max_hops + 1):
            strength = F.col("strength") * F.col("fraction")
            grown = frontier.join(steps, "_last").where(~F.array_contains("path", F.col("_next"))).join(ahead[max_hops - depth], "_next")
            # Products in another order differ in their last bits, hence the margin.
            grown = grown.where(strength * F.col("_bound") >= low * (1 - 1e-9)).join(goal, "_next", "left")
            grown = grown.select(
                F.col("_next").alias("_last"), F.array_append("path", F.col("_next")).alias("path"), strength.alias("strength"), (F.col("path_sign") * F.col("sign")).alias("path_sign"), F.least("min_weight", "_w").alias("min_weight"), "_hit", (strength * F.col("_bound")).alias("_best")
            )
            grown = settle(grown if beam is None else grown.orderBy(F.desc("_best"), "path").limit(beam)).drop("_best")
            reached = grown.where("_hit").drop("_hit")
            found = reached if found is None else found.unionByName(reached)
            frontier = grown.where("_hit is null").drop("_hit")
        return found

    best = [r["strength"] for r in grow(0.0, BEAM * k).select("strength").orderBy(F.desc("strength")).limit(k).collect()]
    found = grow(best[-1] if len(best) == k else 0.0, None)
    rows = found.select("path", (F.size("path") - 1).alias("hops"), "strength", (F.col("path_sign") + 0.0).alias("path_sign"), "min_weight", F.element_at("path", 1).alias("source"), F.element_at("path", -1).alias("target"))
    return rows.orderBy(F.desc("strength"), "hops", "path").limit(k)


def all_paths(graph: Graph, sources: Sequence[int], targets: Sequence[int], *, max_hops: int = 3, min_weight: int = 1) -> DataFrame:
    """(path) of ``find_paths`` by plain self-joins without any reduction, for checks on small graphs."""
    e = graph.edges.where(F.col("weight") >= min_weight).select(F.col("pre").alias("_a"), F.col("post").alias("_b"))
    goal = id_frame(graph.nodes, targets, "_last").withColumn("_hit", F.lit(True))
    walk, found = id_frame(graph.nodes, sources, "_last").select("_last", F.array("_last").alias("path")), None
    for _ in range(max_hops):
        walk = walk.join(e, F.col("_last") == F.col("_a")).where(~F.array_contains("path", F.col("_b"))).select(F.col("_b").alias("_last"), F.array_append("path", F.col("_b")).alias("path"))
        walk = walk.join(goal, "_last", "left")
        hit = walk.where("_hit").select("path")
        found, walk = hit if found is None else found.unionByName(hit), walk.where("_hit is null").drop("_hit")
    return found


def with_labels(paths: DataFrame, graph: Graph, label: str) -> DataFrame:
    """Adds the label of every node of a path."""
    names = graph.nodes.select(F.col("neuron_id").alias("_n"), F.col(label).cast("string").alias("_l"))
    long = paths.select("path", F.posexplode("path").alias("_i", "_n")).distinct().join(names, "_n", "left")
    labels = long.groupBy("path").agg(F.transform(F.sort_array(F.collect_list(F.struct("_i", "_l"))), lambda s: s["_l"]).alias("labels"))
    return paths.join(labels, "path")


def _powers(graph: Graph, hops: int, signed: bool, threshold: float, sources: Sequence[int] | None) -> list[DataFrame]:
    """Powers 1 to ``hops`` of the (signed) input-normalised matrix, each settled. With ``sources`` the edges stay a plan, of which
    each power takes the rows that leave the one before; edges of blocks are not made. Hubs between are cut by ``grid_join``; beyond
    an empty power all are empty."""
    if hops < 1:
        raise ValueError("hops must be >= 1")
    if sources is None:
        graph = replace(graph, edges=settle(graph.edges))
    totals = per_node(input_totals(graph))
    signs = per_node(graph.nodes.select(F.col("neuron_id").alias("pre"), "sign")) if signed else None

    b = graph.factored if sources is not None else None

    def through_blocks(power: DataFrame) -> DataFrame:
        """(pre, post, value): the product of ``power`` and the matrix of the edges of blocks. What enters a block is summed before
        it is dealt to the block's ends, so the edges are not made."""
        rows, value = power.withColumnRenamed("pre", "_source").withColumnRenamed("post", "pre").join(b.pre, "pre"), F.col("value")
        if signed:
            rows, value = rows.join(signs, "pre").where("sign <> 0"), value * F.col("sign")
        entering = rows.groupBy("_source", "pre_block").agg(F.sum(value).alias("value"))
        leaving = entering.join(b.weights.where("weight <> 0"), "pre_block").groupBy("_source", "post_block").agg(F.sum(F.col("value") * F.col("weight")).alias("value"))
        ends = leaving.join(b.post, "post_block").join(totals, "post").where("total > 0")
        return ends.select(F.col("_source").alias("pre"), "post", (F.col("value") / F.col("total")).alias("value"))

    def values(edges: DataFrame) -> DataFrame:
        """The entries of the matrix that ``edges`` are."""
        rows = input_normalized(replace(graph, edges=edges), totals=totals)
        value = F.col("fraction")
        if signed:
            rows, value = rows.join(signs, "pre"), value * F.col("sign")
        return rows.select("pre", "post", value.alias("value")).where("value <> 0")

    prune = lambda d: d.where(F.abs("value") >= threshold) if threshold > 0 else d
    as_step = lambda d: d.select(F.col("pre").alias("post"), F.col("post").alias("_post"), F.col("value").alias("_v"))
    count = lambda d: settle(d.groupBy("post").agg(F.count("*").alias("_m"))) if hops > 1 else None
    if sources is None:
        base = settle(values(graph.edges))
        step, power = as_step(base), prune(base)
        degrees = count(step)
    else:
        power = prune(values(among(graph.edges, "pre", sources)))
    out = [settle(power)]
    for _ in range(2, hops + 1):
        if out[-1].isEmpty():
            out.append(out[-1])
            continue
        if sources is not None:  # only the rows that the last power meets are read from the edges
            ends = settle(out[-1].select(F.col("post").alias("pre")).distinct())
            step = settle(as_step(values((graph.edges if b is None else b.plain).join(small(ends, ends.count()), "pre", "left_semi"))))
            degrees = count(step)
        rows = grid_join(out[-1], step, "post", right_rows=degrees)
        product = rows.groupBy("pre", "_post").agg(F.sum(F.col("value") * F.col("_v")).alias("value")).withColumnRenamed("_post", "post")
        if b is not None:
            product = product.unionByName(through_blocks(out[-1])).groupBy("pre", "post").agg(F.sum("value").alias("value"))
        out.append(settle(prune(product)))
    return out


def effective_connectivity(graph: Graph, hops: int, *, signed: bool = True, cumulative: bool = False, threshold: float = 0.0, sources: Sequence[int] | None = None) -> DataFrame:
    """(pre, post, value): the ``hops``-th power of the (signed) input-normalised matrix, entries below
    ``threshold`` in size pruned after every product; ``cumulative`` sums powers 1 to ``hops``. With ``sources``
    only their rows are computed, which are exact because pruning is entry by entry."""
    powers = _powers(graph, hops, signed, threshold, sources)
    if not cumulative:
        return powers[-1]
    total = powers[0]
    for p in powers[1:]:
        total = total.unionByName(p)
    return total.groupBy("pre", "post").agg(F.sum("value").alias("value"))


def effective_by_hops(graph: Graph, sources: Sequence[int], targets: Sequence[int], *, max_hops: int = 3, signed: bool = True, threshold: float = 0.0) -> DataFrame:
    """(hops, value, mean_per_target, n_sources, n_targets) of the effect of sources on targets per hop."""
    sources, targets = check_ids(graph, sources), check_ids(graph, targets)
    goal, out = id_frame(graph.nodes, targets, "post"), None
    for k, power in enumerate(_powers(graph, max_hops, signed, threshold, sources), 1):
        part = power.join(goal, "post", "left_semi")
        row = part.agg(F.coalesce(F.sum("value"), F.lit(0.0)).alias("value")).select(F.lit(k).alias("hops"), "value", (F.col("value") / len(set(targets))).alias("mean_per_target"), F.lit(len(set(sources))).alias("n_sources"), F.lit(len(set(targets))).alias("n_targets"))
        out = row if out is None else out.unionByName(row)
    return out


def compress_paths_signed(graph: Graph, hops: int, *, output_threshold: float = 0.0, threshold: float = 0.0) -> DataFrame:
    """Net excitatory minus inhibitory effect per pair at exactly ``hops``, below ``output_threshold`` dropped."""
    out = effective_connectivity(graph, hops, threshold=threshold)
    return out.where(F.abs("value") >= output_threshold) if output_threshold > 0 else out


__all__ = ["all_paths", "bfs_distances", "compress_paths_signed", "effective_by_hops", "effective_connectivity", "filtered_edges", "find_paths", "grid_join", "input_totals", "nodes_on_paths", "strongest_paths", "with_labels"]
