"""Walks over edge tables: neighbourhoods, blast radius, cycles, closures, hubs.

``keys`` names the columns that tell projects apart: walks stay within a project, and shares and top lists are a
project's own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomspan.operators.rank import best_rows
from loomspan.operators.tables import written

Keys = tuple[str, ...]


def _turned(edges: DataFrame, keys: Keys) -> DataFrame:
    return edges.select(*keys, F.col("dst").alias("src"), F.col("src").alias("dst"))


def reach(edges: DataFrame, seeds: DataFrame, depth: int, keys: Keys = ()) -> DataFrame:
    """``(seed, node, depth)``: nodes within ``depth`` steps of each seed, with the least number; the seed itself at 0.

    Breadth first for all seeds at once: each round joins the frontier and takes away what was seen. Rounds are written
    to the shared folder, so the plan does not grow.
    """
    step = edges.select(*keys, F.col("src").alias("node"), F.col("dst").alias("next")).distinct()
    frontier = seeds.select(*keys, F.col("seed"), F.col("seed").alias("node"), F.lit(0).alias("depth")).distinct()
    seen = frontier
    for i in range(1, depth + 1):
        new = frontier.join(step, [*keys, "node"]).select(*keys, "seed", F.col("next").alias("node")).distinct().join(seen.select(*keys, "seed", "node"), [*keys, "seed", "node"], "left_anti")
        frontier = written(new.withColumn("depth", F.lit(i)), "frontier")
        seen = seen.unionByName(frontier)
        if frontier.isEmpty():
            break
    return seen


def neighbourhood(edges: DataFrame, seeds: DataFrame, depth: int = 5, direction: str = "both", keys: Keys = ()) -> DataFrame:
    """``(seed, node, depth, direction)`` along imports, against them (importedBy), or each; as deep as asked."""
    parts = []
    if direction in ("imports", "both"):
        parts.append(reach(edges, seeds, depth, keys).withColumn("direction", F.lit("imports")))
    if direction in ("importedBy", "both"):
        parts.append(reach(_turned(edges, keys), seeds, depth, keys).withColumn("direction", F.lit("importedBy")))
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def neighbourhood_summary(edges: DataFrame, seeds: DataFrame, depth: int = 5, direction: str = "both", external: DataFrame | None = None, components: DataFrame | None = None, keys: Keys = ()) -> DataFrame:
    """Per seed: the files within ``depth`` steps (over edges of the direction, either way for both), their imports and importers, the external packages they need and the cycles that the seed is on.

    ``external(node, package)`` lists packages; ``components`` is the result of ``cycles``. The columns are ``files``,
    ``imports``, ``imported_by``, ``packages`` (how many), ``external`` (their sorted names) and ``cycle`` (the component or
    null). A seed without edges is its only file.
    """
    step = {"imports": edges.select(*keys, "src", "dst"), "importedBy": _turned(edges, keys), "both": edges.select(*keys, "src", "dst").unionByName(_turned(edges, keys))}[direction]
    found = reach(step, seeds, depth, keys).select(*keys, "seed", "node")
    counted = lambda a, b, name: edges.select(*keys, F.col(a).alias("node"), F.col(b)).distinct().groupBy(*keys, "node").agg(F.count("*").alias(name))
    own = [*keys, "node"]
    held = found.join(counted("src", "dst", "i"), own, "left").join(counted("dst", "src", "b"), own, "left")
    out = held.groupBy(*keys, "seed").agg(F.count("*").alias("files"), F.coalesce(F.sum("i"), F.lit(0)).alias("imports"), F.coalesce(F.sum("b"), F.lit(0)).alias("imported_by"))
    if external is not None:
        needs = found.join(external.select(*keys, "node", "package").distinct(), own).groupBy(*keys, "seed").agg(F.array_sort(F.collect_set("package")).alias("external"))
        out = out.join(needs, [*keys, "seed"], "left").withColumn("external", F.coalesce("external", F.array().cast("array<string>"))).withColumn("packages", F.size("external").cast("long"))
    if components is not None:
        out = out.join(components.select(*keys, F.col("node").alias("seed"), F.col("component").alias("cycle")), [*keys, "seed"], "left")
    return out


def blast_radius(edges: DataFrame, targets: DataFrame, files: DataFrame, depth: int = 3, keys: Keys = ()) -> DataFrame:
    """Per target: dependents (direct and all), the files they are in, and how severe a change is. ``files(node, file)``."""
    found = reach(_turned(edges, keys), targets, depth, keys).where("depth > 0")
    held = found.join(files.select(*keys, "node", "file"), [*keys, "node"], "left")
    out = held.groupBy(*keys, "seed").agg(F.countDistinct("node").alias("symbols"), F.countDistinct(F.when(F.col("depth") == 1, F.col("node"))).alias("direct"), F.countDistinct("file").alias("files"))
    every = targets.select(*keys, "seed").distinct().join(out, [*keys, "seed"], "left").fillna(0, ["symbols", "direct", "files"])
    severity = F.when((F.col("files") > 5) | (F.col("symbols") > 15), "high").when((F.col("files") > 1) | (F.col("symbols") > 3), "medium").otherwise("low")
    return every.withColumn("severity", severity)


def high_impact_changes(changed: DataFrame, edges: DataFrame, files: DataFrame, keys: Keys = ()) -> DataFrame:
    """Changed exported symbols ``(seed, name, exported)`` with names of more than two letters whose blast radius at depth 2 is high."""
    some = changed.where("exported and length(name) > 2")
    high = blast_radius(edges, some, files, 2, keys).where("severity = 'high'")
    return high.select(*keys, "seed", "symbols", "files", F.lit(85).alias("confidence"))


def hubs(edges: DataFrame, k: int = 5, keys: Keys = ()) -> DataFrame:
    """``(node, dependents, centrality)``: the k nodes with most distinct dependents; centrality is their share of all nodes."""
    degree = edges.groupBy(*keys, F.col("dst").alias("node")).agg(F.countDistinct("src").alias("dependents"))
    total = edges.select(*keys, F.explode(F.array("src", "dst")).alias("n")).groupBy(*keys).agg(F.countDistinct("n").alias("total"))
    top = best_rows(degree, list(keys), [F.desc("dependents"), "node"], k)
    held = top.join(total, list(keys)) if keys else top.join(total)
    return held.select(*keys, "node", "dependents", (F.col("dependents") / F.col("total")).alias("centrality"))


def cycles(edges: DataFrame, keys: Keys = ()) -> DataFrame:
    """``(node, component)``: nodes on cycles with the least node of their strongly connected component.

    Nodes without incoming or without outgoing edges are trimmed, chains of them by pointer doubling, which also finds the
    rings that nothing leaves (or enters): such a ring is a component. In what is left every node learns the largest node
    that reaches it; the node that keeps its own number heads a component, and what reaches it backwards among nodes of
    its colour is that component. These walks also use the jumps that doubling has found along chains. So a ring or chain
    takes rounds by the logarithm of its length; where every node branches, a walk takes as many rounds as its shortest
    path has steps. There is no bound on rounds. Found components leave, and the rest goes again.
    """
    own = list(keys)
    node = [*own, "node"]
    left = written(edges.where("src <> dst").select(*own, "src", "dst").distinct(), "scc")
    loops = edges.where("src = dst").select(*own, F.col("src").alias("node")).distinct()
    found = written(edges.where("false").select(*own, F.col("src").alias("node"), F.col("src").alias("component")), "scc")
    while True:
        left, jumps, rings = _shrunk(left, own)
        found = found.unionByName(rings)
        if left.isEmpty():
            break
        paths = left.unionByName(jumps)
        colour = _largest_reaching(left, paths, own)
        at = lambda c, name: colour.select(*own, F.col("node").alias(c), F.col("colour").alias(name))  # noqa: B023, E731
        same = written(paths.join(at("src", "a"), [*own, "src"]).join(at("dst", "b"), [*own, "dst"]).where("a = b").select(*own, "src", "dst", F.col("a").alias("colour")), "scc")
        members = _backwards(same, colour.where("node = colour"), own)
        of = members.groupBy(*own, "colour").agg(F.min("node").alias("component"), F.count("*").alias("n")).where("n > 1")
        found = found.unionByName(written(members.join(of, [*own, "colour"]).select(*node, "component"), "scc"))
        left = written(_without(left, members, own), "scc")
    return found.unionByName(loops.join(found, node, "left_anti").select(*node, F.col("node").alias("component")))


def _without(edges: DataFrame, nodes: DataFrame, own: list[str]) -> DataFrame:
    for c in ("src", "dst"):
        edges = edges.join(nodes.select(*own, F.col("node").alias(c)), [*own, c], "left_anti")
    return edges.select(*own, "src", "dst")


def _shrunk(edges: DataFrame, own: list[str]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The edges without nodes that no cycle holds and without rings; the jumps along what chains are left; the rings ``(node, component)``."""
    before, rings = edges.count(), None
    turned = lambda df: df.select(*own, F.col("dst").alias("src"), F.col("src").alias("dst"))
    while True:
        ends = lambda c, as_: edges.select(*own, F.col(c).alias(as_)).distinct()  # noqa: B023, E731
        edges = written(edges.join(ends("src", "dst"), [*own, "dst"], "left_semi").join(ends("dst", "src"), [*own, "src"], "left_semi").select(*own, "src", "dst"), "scc")
        ahead, gone, ring = _chains(edges, own)
        edges = written(_without(edges, gone, own), "scc")
        rings = ring if rings is None else rings.unionByName(ring)
        behind, gone, ring = _chains(turned(edges), own)
        edges = written(_without(edges, gone, own), "scc")
        rings = rings.unionByName(ring)
        now = edges.count()
        if not now or now > 0.7 * before:  # what little could still go, goes with the next components
            return edges, ahead.unionByName(turned(behind)), rings
        before = now


def _chains(edges: DataFrame, own: list[str]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Jumps of 4, 16, 64, ... steps along nodes with one successor; nodes that lead nowhere or are on a ring of such nodes; and the rings.

    A node's jump is doubled by that of the node it leads to, until it leaves the chain. What is still on a chain after
    as many steps as there are such nodes is on a ring, or leads to one, and its jump stands on the ring.
    """
    on = [*own, "node"]
    single = edges.groupBy(*own, F.col("src").alias("node")).agg(F.count("*").alias("n"), F.min("dst").alias("jump")).where("n = 1").select(*on, "jump")
    sinks = edges.select(*own, F.col("dst").alias("node")).distinct().join(edges.select(*own, F.col("src").alias("node")), on, "left_anti")
    chained = single.unionByName(sinks.withColumn("jump", F.lit(None).cast(dict(edges.dtypes)["dst"])))
    marks = chained.select(*own, F.col("node").alias("jump"), F.lit(True).alias("on"))
    state = written(chained.join(marks, [*own, "jump"], "left").select(*on, "jump", F.col("on").isNull().alias("done"), F.col("node").alias("low")), "scc")
    size = state.count()
    jumps = edges.where("false").select(*own, "src", "dst")

    def doubled(state: DataFrame) -> DataFrame:
        further = state.select(*own, F.col("node").alias("jump"), F.col("jump").alias("jump2"), F.col("done").alias("done2"), F.col("low").alias("low2"))
        moved = state.where("not done").join(further, [*own, "jump"]).select(*on, F.col("jump2").alias("jump"), F.col("done2").alias("done"), F.least("low", "low2").alias("low"))
        return state.where("done").unionByName(moved)

    steps = 1
    while steps <= size and not state.where("not done").isEmpty():
        state = written(doubled(doubled(state)), "scc")  # twice for each table that is written
        jumps = jumps.unionByName(state.where("jump is not null").select(*own, F.col("node").alias("src"), F.col("jump").alias("dst")))
        steps *= 4
    dead = state.where("done and jump is null").select(*on)
    ring = state.join(state.where("not done").select(*own, F.col("jump").alias("node")).distinct(), on, "left_semi").where("not done").select(*on, F.col("low").alias("component"))
    return jumps.where("src <> dst").distinct(), dead.unionByName(ring.select(*on)), ring


def _largest_reaching(edges: DataFrame, paths: DataFrame, own: list[str]) -> DataFrame:
    nodes = edges.select(*own, F.explode(F.array("src", "dst")).alias("node")).distinct()
    colour = written(nodes.withColumn("colour", F.col("node")), "scc")
    while True:
        sent = paths.join(colour.select(*own, F.col("node").alias("src"), "colour"), [*own, "src"]).groupBy(*own, F.col("dst").alias("node")).agg(F.max("colour").alias("got"))
        new = written(colour.join(sent, [*own, "node"], "left").select(*own, "node", F.greatest("colour", F.coalesce("got", "colour")).alias("colour"), (F.coalesce("got", "colour") > F.col("colour")).alias("moved")), "scc")
        colour = new.select(*own, "node", "colour")
        if new.where("moved").isEmpty():
            return colour


def _backwards(same: DataFrame, heads: DataFrame, own: list[str]) -> DataFrame:
    on = [*own, "node", "colour"]
    frontier = seen = written(heads.select(*on), "scc")
    while True:
        new = same.join(frontier.select(*own, F.col("node").alias("dst"), "colour"), [*own, "dst", "colour"]).select(*own, F.col("src").alias("node"), "colour").distinct().join(seen, on, "left_anti")
        frontier = written(new, "scc")
        if frontier.isEmpty():
            return seen
        seen = seen.unionByName(frontier)


def ancestors(tree: DataFrame, max_depth: int = 64, keys: Keys = ()) -> DataFrame:
    """``(node, ancestor, distance)`` of ``tree(node, parent)``, every node its own ancestor at 0."""
    up = tree.where("parent is not null").select(*keys, F.col("node").alias("ancestor"), "parent")
    out = frontier = tree.select(*keys, "node", F.col("node").alias("ancestor"), F.lit(0).alias("distance"))
    for i in range(1, max_depth + 1):
        frontier = written(frontier.join(up, [*keys, "ancestor"]).select(*keys, "node", F.col("parent").alias("ancestor"), F.lit(i).alias("distance")), "closure")
        if frontier.isEmpty():
            return out
        out = out.unionByName(frontier)
    raise ValueError("deeper than max_depth, or a cycle")


def scope_metrics(closure: DataFrame, scope_symbols: DataFrame, keys: Keys = ()) -> DataFrame:
    """``(scope, depth, symbols, children, descendants)``."""
    on = [*keys, "node"]
    depth = closure.groupBy(*on).agg(F.max("distance").alias("depth"))
    below = closure.where("distance > 0").groupBy(*keys, F.col("ancestor").alias("node")).agg(F.count_if(F.col("distance") == 1).alias("children"), F.count("*").alias("descendants"))
    own = scope_symbols.groupBy(*keys, F.col("scope").alias("node")).agg(F.count("*").alias("symbols"))
    return depth.join(own, on, "left").join(below, on, "left").fillna(0, ["symbols", "children", "descendants"]).select(*keys, F.col("node").alias("scope"), "depth", "symbols", "children", "descendants")


def entry_points(edges: DataFrame, keys: Keys = ()) -> DataFrame:
    """Nodes that nothing imports."""
    return edges.select(*keys, F.col("src").alias("node")).distinct().join(edges.select(*keys, F.col("dst").alias("node")), [*keys, "node"], "left_anti")


def leaf_nodes(edges: DataFrame, keys: Keys = ()) -> DataFrame:
    """Nodes that import nothing."""
    return edges.select(*keys, F.col("dst").alias("node")).distinct().join(edges.select(*keys, F.col("src").alias("node")), [*keys, "node"], "left_anti")


def related_symbols(edges: DataFrame, co: DataFrame, k: int | None = 10, keys: Keys = ()) -> DataFrame:
    """``(symbol, related, score)``: callees 0.9, callers 0.8, the five most co-occurring min(0.7, n / 10); best score each, the k best, or all with None."""
    calls = edges.where("src <> dst").select(*keys, "src", "dst").distinct()
    top = co.withColumn("r", F.row_number().over(Window.partitionBy(*keys, "a").orderBy(F.desc("n"), "b"))).where("r <= 5")
    legs = calls.select(*keys, F.col("src").alias("symbol"), F.col("dst").alias("related"), F.lit(0.9).alias("score"))
    legs = legs.unionByName(calls.select(*keys, F.col("dst").alias("symbol"), F.col("src").alias("related"), F.lit(0.8).alias("score")))
    legs = legs.unionByName(top.select(*keys, F.col("a").alias("symbol"), F.col("b").alias("related"), F.least(F.lit(0.7), F.col("n") / 10).alias("score")))
    best = legs.groupBy(*keys, "symbol", "related").agg(F.max("score").alias("score"))
    if k is None:
        return best
    return best.withColumn("r", F.row_number().over(Window.partitionBy(*keys, "symbol").orderBy(F.desc("score"), "related"))).where(f"r <= {k}").drop("r")


def relevant_symbols(imported: DataFrame, related: DataFrame, k: int = 20, keys: Keys = ()) -> DataFrame:
    """``(related, score)``: the k symbols with the largest sum of scores over the imported set ``(symbol)``.

    ``related`` is that of ``related_symbols``; with its ``k`` None no symbol's score is missing from a sum.
    """
    sums = related.join(imported.select(*keys, "symbol").distinct(), [*keys, "symbol"], "left_semi").groupBy(*keys, "related").agg(F.sum("score").alias("score"))
    return best_rows(sums, list(keys), [F.desc("score"), "related"], k)


def file_edges(resolved: DataFrame, keys: Keys = ()) -> DataFrame:
    """``(src, dst, symbols)`` from resolved imports ``(src, dst, name)``."""
    return resolved.groupBy(*keys, "src", "dst").agg(F.array_sort(F.collect_set("name")).alias("symbols"))


def affected_sources(affected: DataFrame, files: DataFrame, keys: Keys = ()) -> DataFrame:
    """The files whose id is among the affected."""
    return files.join(affected.select(*keys, "file").distinct(), [*keys, "file"], "left_semi")
