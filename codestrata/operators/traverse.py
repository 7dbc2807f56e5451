"""Graph traversal over edge relations: reverse impact, blast radius, paths, traces, cycles.

Every walk is a frontier loop: one equi-join of the frontier with the edges and
one anti-join with what is visited, so cost follows the edges touched. A loop
ends when the frontier is empty; lineage is cut by writing each level to the
shared folder. Depth is the least one; among paths of that depth a node is
``resolved`` if any of them is resolved on every hop, so the result does not
depend on row order.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.durable import stored
from .walks import counted, pairs, walk

MAX_NODES = 2000
FILE_NODES = 200
SCORED_NODES = 200
TRACE_NODES = 800


def reach(edges: DataFrame, seeds: DataFrame, max_depth: int = 10_000, source: str = "from_id", target: str = "to_id", carry: str | None = "confidence", enough: int | None = None, held: bool = False) -> DataFrame:
    """(seed, id, depth, confidence): all nodes from which a seed can be reached along source -> target edges.

    seeds has a column ``seed``. Start nodes themselves are left out. With
    ``carry`` None every confidence is resolved. With ``enough`` the walk ends
    after the level in which it has found more nodes than that: all levels
    before are whole, so the first ``enough`` by depth are right. ``held``:
    edges are a stored table and are read as they are.
    """
    confidence = F.col(carry) if carry else F.lit("resolved")
    e = edges.select(F.col(source).alias("id"), F.col(target).alias("at"), confidence.alias("hop")).where("id is not null and at is not null")
    e = e if held else stored(e, "edges")
    frontier = stored(seeds.select("seed", F.col("seed").alias("id"), F.lit(0).alias("depth"), F.lit("resolved").alias("confidence")).distinct(), "frontier")
    levels, total = [frontier], 0
    for depth in range(1, max_depth + 1):
        steps = frontier.select("seed", F.col("id").alias("at"), "confidence").join(e, "at")
        found = steps.groupBy("seed", "id").agg(F.max(F.when(F.col("hop") == "resolved", F.col("confidence")).otherwise("inferred")).alias("confidence"))
        seen = reduce(DataFrame.unionByName, levels).select("seed", "id")
        frontier = stored(found.join(seen, ["seed", "id"], "left_anti").select("seed", "id", F.lit(depth).alias("depth"), "confidence"), "frontier")
        more = frontier.count()
        if not more:
            break
        levels.append(frontier)
        total += more
        if enough is not None and total > enough:
            break
        if len(levels) % 32 == 0:  # keep the union short on long chains
            levels = [stored(reduce(DataFrame.unionByName, levels), "visited")]
    return reduce(DataFrame.unionByName, levels).where("depth > 0")


def kind_of(node: Column) -> Column:
    return F.substring_index(node, ":", 1)


def impact_of(impact_edges: DataFrame, entity: str, max_depth: int = 10_000, max_nodes: int = MAX_NODES) -> DataFrame:
    """(id, kind, depth, confidence, truncated): what depends on an entity, nearest first, at most max_nodes by (depth, id)."""
    seed = impact_edges.sparkSession.createDataFrame([(entity,)], "seed string")
    found = reach(impact_edges, seed, max_depth, enough=max_nodes).select("id", kind_of(F.col("id")).alias("kind"), "depth", "confidence")
    total = found.count()
    return found.orderBy("depth", "id").limit(max_nodes).withColumn("truncated", F.lit(total > max_nodes))


def dependents_of(impact_edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """nodes (with id) and how many distinct nodes depend on each directly."""
    counts = impact_edges.join(nodes.select(F.col("id").alias("to_id")).distinct(), "to_id", "left_semi").groupBy(F.col("to_id").alias("id")).agg(F.count_distinct("from_id").alias("dependents"))
    return nodes.join(counts, "id", "left").withColumn("dependents", F.coalesce("dependents", F.lit(0)))


def blast_radius(impact_edges: DataFrame, entity: str, top: int = 20) -> DataFrame:
    """The impacted nodes that most others depend on: (id, kind, depth, dependents, confidence). The graph is built once."""
    graph = stored(impact_edges.select("from_id", "to_id", "confidence"), "graph")
    near = stored(impact_of(graph, entity, max_nodes=SCORED_NODES).drop("truncated"), "near")
    scored = dependents_of(graph, near)
    return scored.orderBy(F.desc("dependents"), "depth", "id").limit(top).select("id", "kind", "depth", "dependents", "confidence")


def diff_impact(impact_edges: DataFrame, changed: DataFrame, max_files: int = 30, max_nodes: int | None = None) -> DataFrame:
    """(id, kind, depth, hits, truncated): what changed entities (column id) affect, less themselves, and how many of them affect it.

    One walk from the first ``max_files`` of them, each as far as ``max_nodes``
    nodes; truncated says whether there are more of either.
    """
    seeds = stored(changed.select(F.col("id").alias("seed")).where("seed is not null").distinct().orderBy("seed").limit(max_files + 1), "changed")
    more = seeds.count() > max_files
    seeds = seeds.orderBy("seed").limit(max_files)
    w = walk(impact_edges, seeds, enough=max_nodes)
    hit = w.levels.groupBy("id").agg(F.min("depth").alias("depth"), F.sum(F.bit_count("bits")).cast("long").alias("hits"))
    cut = more or w.stopped is not None and not w.stopped.isEmpty()
    return hit.join(seeds.select(F.col("seed").alias("id")), "id", "left_anti").select("id", kind_of(F.col("id")).alias("kind"), "depth", "hits", F.lit(cut).alias("truncated"))


def file_impact(edges: DataFrame, files: DataFrame, max_nodes: int | None = None) -> DataFrame:
    """(file, direct, transitive): distinct importers of each given file (column file), and all files that reach it. A file on a cycle counts itself.

    With ``max_nodes`` a file's walk ends after the level that exceeds it, and no more are counted.
    """
    w = walk(edges, files.select(F.col("file").alias("seed")), source="from_file", target="to_file", starts=True, enough=max_nodes)
    n = counted(w.levels.select("block", "bits", (F.col("depth") == 1).alias("first")), w.seeds, "first")
    total = F.sum("n") if max_nodes is None else F.least(F.sum("n"), F.lit(max_nodes))
    return n.groupBy(F.col("seed").alias("file")).agg(F.sum(F.when(F.col("first"), F.col("n"))).alias("direct"), total.cast("long").alias("transitive"))


def impact_index(edges: DataFrame, max_depth: int = 4, listed_direct: int = 30, listed: int = 100, max_nodes: int | None = None) -> DataFrame:
    """For every file with importers: direct and transitive counts, exact to max_depth, the first of each by name, and whether there are more (truncated).

    With ``max_nodes`` the nearest so many count, by (depth, name), and a file
    with more is truncated. Lists are cut by the tasks that write pairs out, so
    what is shuffled for a file is no more than it lists.
    """
    w = walk(edges, edges.select(F.col("to_file").alias("seed")), max_depth + 1, "from_file", "to_file", enough=max_nodes)
    levels = w.levels.withColumn("zone", F.when(F.col("depth") == 1, 1).when(F.col("depth") <= max_depth, 2).otherwise(3))
    n = counted(levels, w.seeds, "zone").groupBy("seed").agg(*(F.coalesce(F.sum(F.when(F.col("zone") == z, F.col("n"))), F.lit(0)).alias(f"n{z}") for z in (1, 2, 3)))
    transitive = F.col("n1") + F.col("n2")
    most = F.lit(max_nodes).cast("long") if max_nodes is not None else transitive
    n = n.where("n1 > 0").select("seed", F.col("n1").alias("direct"), F.least(transitive, most).alias("transitive"), ((F.col("n3") > 0) | (transitive > most)).alias("truncated"))

    def first(zones: str, k: int, name: str) -> DataFrame:
        within = pairs(levels.where(zones), w.seeds)
        if max_nodes is not None:  # the nearest count, then the first of these by name
            near = F.row_number().over(Window.partitionBy("seed").orderBy("depth", "id"))
            within = within.withColumn("near", near).where(F.col("near") <= max_nodes)
        by_name = F.row_number().over(Window.partitionBy("seed").orderBy("id"))
        return within.withColumn("r", by_name).where(F.col("r") <= k).groupBy("seed").agg(F.sort_array(F.collect_list("id")).alias(name))

    lists = first("zone = 1", listed_direct, "direct_files").join(first("zone < 3", listed, "transitive_files"), "seed")
    return n.join(lists, "seed").select(F.col("seed").alias("file"), "direct", "transitive", "direct_files", "transitive_files", "truncated")


def find_path(edges: DataFrame, start: str, goal: str | list[str], max_depth: int = 10_000, source: str = "from_file", target: str = "to_file", held: bool = False) -> DataFrame:
    """(step, id): the shortest path from start to a goal, of several the one whose ids sort first; no rows if there is none.

    Two walks, one from the start and one back from all goals; the one with
    fewer nodes in its last level goes on, until they meet. Every node that is
    met carries the least path to it or on from it. ``held``: edges are a stored
    table and are read as they are.
    """
    spark = edges.sparkSession
    goals = [goal] if isinstance(goal, str) else list(goal)
    if start in goals:
        return spark.createDataFrame([(0, start)], "step int, id string")
    e = edges.select(F.col(source).alias("a"), F.col(target).alias("b")).where("a is not null and b is not null")
    e = e if held else stored(e, "edges")
    first = lambda ids: stored(spark.createDataFrame([(x, [x]) for x in ids], "id string, path array<string>"), "frontier")
    ahead, back = first([start]), first(sorted(set(goals)))
    seen = {"ahead": ahead.select("id"), "back": back.select("id")}
    sizes = {"ahead": 1, "back": len(set(goals))}
    for _ in range(max_depth):
        side = min(sizes, key=sizes.get)
        if side == "ahead":
            met = ahead.select(F.col("id").alias("a"), "path").join(e, "a").groupBy(F.col("b").alias("id")).agg(F.min("path").alias("path"))
            path = F.concat("path", F.array("id"))
        else:
            met = back.select(F.col("id").alias("b"), "path").join(e, "b").groupBy(F.col("a").alias("id")).agg(F.min("path").alias("path"))
            path = F.concat(F.array("id"), "path")
        level = stored(met.join(seen[side], "id", "left_anti").select("id", path.alias("path")), "frontier")
        sizes[side] = level.count()
        if not sizes[side]:
            break
        seen[side] = stored(seen[side].unionByName(level.select("id")), "visited")
        ahead, back = (level, back) if side == "ahead" else (ahead, level)
        whole = ahead.join(back.select("id", F.col("path").alias("rest")), "id").select(F.concat("path", F.slice("rest", 2, F.size("rest"))).alias("path"))
        there = whole.agg(F.min("path").alias("path")).where("path is not null").select(F.posexplode("path").alias("step", "id"))
        if not there.isEmpty():
            return there
    return spark.createDataFrame([], "step int, id string")


def trace_edges(edges: DataFrame, cg_nodes: DataFrame, cg_edges: DataFrame) -> DataFrame:
    """One relation for cross-tier walks, A depends on B: imports between files, and calls between the files (else node ids) of call-graph nodes."""
    place = cg_nodes.select("id", F.coalesce(F.when(F.col("layer") != "database", F.col("file")), F.col("id")).alias("place"))
    calls = cg_edges.join(place.select(F.col("id").alias("from_id"), F.col("place").alias("a")), "from_id").join(place.select(F.col("id").alias("to_id"), F.col("place").alias("b")), "to_id")
    calls = calls.select(F.col("a").alias("from_id"), F.col("b").alias("to_id"), F.when(F.col("confidence").isin("high", "resolved"), "resolved").otherwise("inferred").alias("confidence"))
    code = edges.select(F.col("from_file").alias("from_id"), F.col("to_file").alias("to_id"), "confidence")
    return code.unionByName(calls).where("from_id != to_id").groupBy("from_id", "to_id").agg(F.max("confidence").alias("confidence"))


def trace(links: DataFrame, nodes: DataFrame, entry: str, max_nodes: int = TRACE_NODES, held: bool = False) -> DataFrame:
    """(id, layer, depth, on_path, truncated): what is upstream of an entry, the nearest max_nodes, and a sample path.

    The path leads from the deepest frontend node (else the deepest node; ties
    to the least id) down to the entry. nodes: (id, layer). ``held``: links are a
    stored table and are read as they are.
    """
    spark = links.sparkSession
    links = links if held else stored(links.select("from_id", "to_id", "confidence"), "links")  # built once for both walks
    up = reach(links, spark.createDataFrame([(entry,)], "seed string"), enough=max_nodes, held=True).select("id", "depth")
    near = stored(up.unionByName(spark.createDataFrame([(entry, 0)], "id string, depth int")).orderBy("depth", "id").limit(max_nodes + 1), "near")
    layers = nodes.select("id", "layer").join(F.broadcast(near.select("id")), "id", "left_semi").dropDuplicates(["id"])  # at most max_nodes + 1
    ranked = stored(near.join(layers, "id", "left").withColumn("layer", F.coalesce("layer", F.lit("code"))), "trace")
    kept = stored(ranked.orderBy("depth", "id").limit(max_nodes).withColumn("truncated", F.lit(ranked.count() > max_nodes)), "trace")
    first = kept.orderBy(F.col("layer") != "frontend", F.desc("depth"), "id").select("id").first()
    path = find_path(links, first.id, entry, source="from_id", target="to_id", held=True).select("id").withColumn("on_path", F.lit(True))
    return kept.join(path, "id", "left").withColumn("on_path", F.coalesce("on_path", F.lit(False)))


def resolve_entry(nodes: DataFrame, query: str) -> DataFrame:
    """(id, rank): call-graph nodes that a free name may mean, best first: label, a dotted part, the shortest label with that prefix or holding it, a file."""
    label, q = F.upper("label"), query.upper()
    parts = [p for p in q.split(".") if p]
    rank = F.when(label == q, 1).when(label.isin(parts), 2).when(label.startswith(q), 3).when(label.contains(q), 4).when(F.upper("file").contains(q), 5)
    return nodes.withColumn("rank", rank).where("rank is not null").orderBy("rank", F.length("label"), "id").select("id", "rank")


def flow(links: DataFrame, seeds: DataFrame, max_depth: int = 10_000) -> DataFrame:
    """(id, direction, depth): backward and forward closure of seeds (column seed)."""
    links = stored(links.select("from_id", "to_id"), "links")  # built once for both walks
    back = reach(links, seeds, max_depth, carry=None, held=True).groupBy("id").agg(F.min("depth").alias("depth"))
    ahead = reach(links, seeds, max_depth, source="to_id", target="from_id", carry=None, held=True).groupBy("id").agg(F.min("depth").alias("depth"))
    return back.select("id", F.lit("upstream").alias("direction"), "depth").unionByName(ahead.select("id", F.lit("downstream").alias("direction"), "depth"))


def _peeled(e: DataFrame) -> DataFrame:
    """Edges (from_id, to_id) without nodes that no cycle can hold: those without an edge in or out, again and again."""
    n = e.count()
    while n:
        ins, outs = e.select(F.col("to_id").alias("from_id")).distinct(), e.select(F.col("from_id").alias("to_id")).distinct()
        e = stored(e.join(ins, "from_id", "left_semi").join(outs, "to_id", "left_semi").select("from_id", "to_id"), "digraph")
        before, n = n, e.count()
        if n == before:
            break
    return e


def circular(edges: DataFrame, source: str = "from_file", target: str = "to_file") -> DataFrame:
    """(from_id, to_id): edges a -> b where b also reaches a, that is, edges inside a cycle."""
    return components(edges, source, target).select("from_id", "to_id")


def components(edges: DataFrame, source: str = "from_file", target: str = "to_file") -> DataFrame:
    """(from_id, to_id, component): edges inside a cycle, with the node that names their component.

    Strongly connected components by colouring: the largest id that reaches a
    node is its colour; what reaches that id back inside the colour is its
    component. Each round takes one component of every colour out, so no pairs of
    nodes are ever kept.
    """
    e = _peeled(stored(edges.select(F.col(source).alias("from_id"), F.col(target).alias("to_id")).where("from_id is not null and to_id is not null and from_id != to_id").distinct(), "digraph"))
    spark, found = edges.sparkSession, []
    while not e.isEmpty():
        color = stored(e.select(F.col("from_id").alias("id"), F.col("from_id").alias("color")).distinct(), "colors")  # peeled: every node has an edge out
        while True:
            offered = e.join(color.withColumnRenamed("id", "from_id"), "from_id").groupBy(F.col("to_id").alias("id")).agg(F.max("color").alias("offer"))
            now = stored(color.join(offered, "id", "left").select("id", F.greatest("color", "offer").alias("color"), (F.col("offer") > F.col("color")).alias("moved")), "colors")
            color, moved = now.select("id", "color"), now.where("moved")
            if moved.isEmpty():
                break
        ends = e.join(color.select(F.col("id").alias("from_id"), "color"), "from_id").join(color.select(F.col("id").alias("to_id"), F.col("color").alias("to_color")), "to_id")
        inside = stored(ends.where("color = to_color").select("from_id", "to_id"), "inside")
        frontier = taken = stored(color.where("id = color"), "component")
        while True:
            back = inside.join(frontier.select(F.col("id").alias("to_id"), "color"), "to_id").select(F.col("from_id").alias("id"), "color").distinct()
            frontier = stored(back.join(taken.select("id"), "id", "left_anti"), "component")
            if frontier.isEmpty():
                break
            taken = stored(taken.unionByName(frontier), "taken")
        held = inside.join(taken.select(F.col("id").alias("from_id"), F.col("color").alias("component")), "from_id")
        found.append(held.join(taken.select(F.col("id").alias("to_id")), "to_id", "left_semi").select("from_id", "to_id", "component"))
        gone = taken.select("id")
        e = _peeled(stored(e.join(gone.withColumnRenamed("id", "from_id"), "from_id", "left_anti").join(gone.withColumnRenamed("id", "to_id"), "to_id", "left_anti").select("from_id", "to_id"), "digraph"))
    return reduce(DataFrame.unionByName, found) if found else spark.createDataFrame([], "from_id string, to_id string, component string")


def resolve_id(impact_edges: DataFrame, symbols: DataFrame, files: DataFrame, query: str) -> DataFrame:
    """(id, rank): ids that a free name may mean, best first, by (rank, id).

    1 the id itself; 2 a file; 3 a database object or table of that name (up to
    10); 4 a file by suffix or part of its path (up to 5); 5 an object that is
    the last dotted part, if nothing before fits; 6 the file of a symbol.
    """
    spark = impact_edges.sparkSession
    ids = impact_edges.select(F.col("from_id").alias("id")).union(impact_edges.select("to_id")).distinct()
    name = F.substring_index("id", ":", -1)
    q = query.lower()
    exact = ids.where(F.col("id") == query).select("id", F.lit(1).alias("rank"))
    file = files.where(F.col("rel_path") == query).select(F.concat(F.lit("file:"), "rel_path").alias("id"), F.lit(2).alias("rank"))
    objects = ids.where((kind_of(F.col("id")) != "file") & (F.lower(name) == q)).orderBy("id").limit(10).select("id", F.lit(3).alias("rank"))
    part = files.where(F.lower("rel_path").contains(q)).orderBy(~F.lower("rel_path").endswith(q), F.length("rel_path"), "rel_path").limit(5).select(F.concat(F.lit("file:"), "rel_path").alias("id"), F.lit(4).alias("rank"))
    symbol = symbols.where(F.lower("simple_name") == q).select(F.concat(F.lit("file:"), "file").alias("id"), F.lit(6).alias("rank"))
    found = exact.unionByName(file).unionByName(objects).unionByName(part).unionByName(symbol)
    if "." in query:
        last = query.rsplit(".", 1)[1].lower()
        dotted = ids.where((kind_of(F.col("id")) != "file") & (F.lower(name) == last)).select("id", F.lit(5).alias("rank"))
        found = found.unionByName(dotted) if found.isEmpty() else found
    return found.groupBy("id").agg(F.min("rank").alias("rank")).orderBy("rank", "id") if found is not None else spark.createDataFrame([], "id string, rank int")


def resolve_file(files: DataFrame, query: str) -> DataFrame:
    """(rel_path): the file that a free name means: exact, else the shortest path that ends with it, else that holds it."""
    path, q = F.lower("rel_path"), query.lower()
    rank = F.when(F.col("rel_path") == query, 0).when(path.endswith(q), 1).when(path.contains(q), 2)
    return files.withColumn("rank", rank).where("rank is not null").orderBy("rank", F.length("rel_path"), "rel_path").limit(1).select("rel_path")
