"""Roll-ups of the graph to containers, and views that keep the top of each group."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import extension, tokens_of
from ..sources.durable import stored
from .build import central_files

SHOWN_FILES = 150


def with_ends(edges: DataFrame, files: DataFrame) -> DataFrame:
    """edges with module, layer and file of both ends (a_, b_); edges to unknown files drop out."""
    side = lambda p, c: files.select(F.col("rel_path").alias(c), F.col("module").alias(f"{p}_module"), F.col("layer").alias(f"{p}_layer"))
    return edges.join(side("a", "from_file"), "from_file").join(side("b", "to_file"), "to_file")


def _rolled(rows: DataFrame) -> DataFrame:
    sure = F.sum((F.col("confidence") == "resolved").cast("long"))
    return rows.where("from_id is not null and to_id is not null and from_id != to_id").groupBy("from_id", "to_id").agg(F.count("*").alias("weight"), sure.alias("resolved_weight"))


def module_matrix(edges: DataFrame, files: DataFrame) -> DataFrame:
    """(from_id, to_id, weight, resolved_weight) between different modules."""
    return _rolled(with_ends(edges, files).select(F.col("a_module").alias("from_id"), F.col("b_module").alias("to_id"), "confidence"))


def level(edges: DataFrame, files: DataFrame, layers: tuple[str, ...] = (), modules: tuple[str, ...] = (), shown: int = SHOWN_FILES) -> DataFrame:
    """Edges between visible containers: (from_id, to_id, weight, resolved_weight).

    Unexpanded layers are nodes; an expanded layer shows its modules; an
    expanded module (its layer counts as expanded) shows its ``shown`` files of
    the highest degree and one node for the rest. Self-loops are dropped.
    """
    opened = set(layers) | ({r.layer for r in files.where(F.col("module").isin(*modules)).select("layer").distinct().collect()} if modules else set())
    place = files.select("rel_path", "module", "layer")
    if modules:
        ends = edges.select(F.inline(F.array(F.struct(F.col("from_file").alias("rel_path")), F.struct(F.col("to_file").alias("rel_path"))))).groupBy("rel_path").agg(F.count("*").alias("degree"))
        inside = place.where(F.col("module").isin(*modules)).join(ends, "rel_path")
        top = inside.withColumn("r", F.row_number().over(Window.partitionBy("module").orderBy(F.desc("degree"), "rel_path"))).where(F.col("r") <= shown).select("rel_path", F.lit(True).alias("shown"))
        place = place.join(top, "rel_path", "left")
    else:
        place = place.withColumn("shown", F.lit(None).cast("boolean"))
    node = F.concat(F.lit("layer:"), "layer")
    if opened:
        node = F.when(F.col("layer").isin(*opened), F.concat(F.lit("module:"), "module")).otherwise(node)
    if modules:
        node = F.when(F.col("shown"), F.concat(F.lit("file:"), "rel_path")).when(F.col("module").isin(*modules), F.concat(F.lit("more:"), "module")).otherwise(node)
    at = place.select("rel_path", node.alias("node"))
    rows = edges.join(at.select(F.col("rel_path").alias("from_file"), F.col("node").alias("from_id")), "from_file").join(at.select(F.col("rel_path").alias("to_file"), F.col("node").alias("to_id")), "to_file")
    return _rolled(rows)


def node_weights(rolled: DataFrame) -> DataFrame:
    """(id, in_weight, out_weight) of rolled-up edges."""
    both = F.inline(F.array(F.struct(F.col("from_id").alias("id"), F.col("weight").alias("o"), F.lit(0).cast("long").alias("i")), F.struct(F.col("to_id").alias("id"), F.lit(0).cast("long").alias("o"), F.col("weight").alias("i"))))
    return rolled.select(both).groupBy("id").agg(F.sum("i").alias("in_weight"), F.sum("o").alias("out_weight"))


def majority(rows: DataFrame, group: str, value: str) -> DataFrame:
    """(group, value): the commonest value of each group, ties to the least."""
    counts = rows.groupBy(group, value).agg(F.count("*").alias("n"))
    return counts.groupBy(group).agg(F.min_by(value, F.struct(-F.col("n"), F.col(value))).alias(value))


def zoom_out(edges: DataFrame, files: DataFrame, modules: int = 12, flows: int = 15) -> DataFrame:
    """(section, a, b, n): the largest modules with their layer, and the heaviest flows between modules."""
    size = files.groupBy("module").agg(F.count("*").alias("n")).join(majority(files, "module", "layer"), "module")
    top = size.orderBy(F.desc("n"), "module").limit(modules).select(F.lit("module").alias("section"), F.col("module").alias("a"), F.col("layer").alias("b"), "n")
    heavy = module_matrix(edges, files).orderBy(F.desc("weight"), "from_id", "to_id").limit(flows).select(F.lit("flow").alias("section"), F.col("from_id").alias("a"), F.col("to_id").alias("b"), F.col("weight").alias("n"))
    return top.unionByName(heavy)


def top_per_layer(edges: DataFrame, files: DataFrame, top: int = 12) -> DataFrame:
    """(layer, id, degree): the nodes of the highest out-degree in each layer."""
    out = edges.groupBy(F.col("from_file").alias("rel_path")).agg(F.count_distinct("to_file").alias("degree"))
    ranked = files.join(out, "rel_path").withColumn("r", F.row_number().over(Window.partitionBy("layer").orderBy(F.desc("degree"), "rel_path")))
    return ranked.where(F.col("r") <= top).select("layer", F.col("rel_path").alias("id"), "degree")


def multigraph(nodes: DataFrame, edges: DataFrame, top: int = 12) -> tuple[DataFrame, DataFrame]:
    """The top nodes of each layer by out-degree, and the number of edges of each type with both ends among them."""
    out = edges.groupBy(F.col("from_id").alias("id")).agg(F.count("*").alias("degree"))
    ranked = nodes.join(out, "id", "left").withColumn("degree", F.coalesce("degree", F.lit(0)))
    kept = ranked.withColumn("r", F.row_number().over(Window.partitionBy("layer").orderBy(F.desc("degree"), "id"))).where(F.col("r") <= top).drop("r")
    ids = kept.select("id")
    seen = edges.join(ids.withColumnRenamed("id", "from_id"), "from_id", "left_semi").join(ids.withColumnRenamed("id", "to_id"), "to_id", "left_semi")
    return kept, seen.groupBy("type").agg(F.count("*").alias("n"))


def module_pairs(edges: DataFrame, files: DataFrame, http: DataFrame | None = None) -> DataFrame:
    """(from_id, to_id, kind): distinct module pairs, then pairs tied by HTTP only."""
    pairs = module_matrix(edges, files).select("from_id", "to_id", F.lit("import").alias("kind"))
    if http is None:
        return pairs
    far = module_matrix(http, files).select("from_id", "to_id")
    return pairs.unionByName(far.join(pairs, ["from_id", "to_id"], "left_anti").withColumn("kind", F.lit("http")))


def dead_files(files: DataFrame, edges: DataFrame, suffix: str, entries: tuple[str, ...] = ("main", "index", "app", "setup", "polyfills", "test", "environment")) -> DataFrame:
    """(id): files whose path matches suffix and that nothing imports, save entry points by name."""
    from ..functions.text import base_name

    stem = F.lower(F.regexp_extract(base_name(F.col("rel_path")), r"^([^.]*)", 1))
    return files.where(F.col("rel_path").rlike(suffix) & ~stem.isin(*entries)).join(edges.select(F.col("to_file").alias("rel_path")), "rel_path", "left_anti").select(F.col("rel_path").alias("id"))


def dead_objects(objects: DataFrame, calls: DataFrame) -> DataFrame:
    """objects (name, pkg) whose name and whose package nothing calls. calls: (callee, pkg)."""
    upper = lambda c: F.upper(F.col(c))
    free = objects.join(calls.select(upper("callee").alias("__n")).distinct(), upper("name") == F.col("__n"), "left_anti")
    return free.join(calls.where("pkg is not null").select(upper("pkg").alias("__p")).distinct(), upper("pkg") == F.col("__p"), "left_anti")


def object_report(objects: DataFrame, cg_edges: DataFrame, name: str, access: DataFrame | None = None, most: int = 10) -> DataFrame:
    """(section, item, truncated) of a database object: object, place, reads, writes, caller, callee, the first ``most`` of each by name.

    The object is the one of that name (and package, if the name has a dot),
    else the first whose name holds it; without any, section available lists 20
    procedures and functions. objects: (kind, name, pkg, file, line); access:
    (object, table, mode read or write), object with or without its package;
    calls are edges of the call graph whose end holds the object's name.
    """
    *pkg, last = [x for x in name.upper().strip().split(".") if x][-2:] or [""]
    upper = F.upper("name")
    exact = (upper == last) & (F.upper("pkg") == pkg[0] if pkg else F.lit(True))
    rank = F.when(exact, 0).when(upper.contains(last), 1)
    full = F.concat_ws(".", "pkg", "name")
    found = objects.withColumn("rank", rank).where("rank is not null").orderBy("rank", "pkg", "name", "file", "line").select("kind", "name", "pkg", "file", "line").first()

    def first(section: str, items: DataFrame, n: int) -> DataFrame:
        kept = items.toDF("item").where("item is not null").distinct().orderBy("item").limit(n + 1)
        ranked = stored(kept, "report")
        return ranked.orderBy("item").limit(n).select(F.lit(section).alias("section"), "item", F.lit(ranked.count() > n).alias("truncated"))

    if found is None:
        return first("available", objects.where(F.lower("kind").isin("procedure", "function")).select(full), 20)
    title = f"{found.pkg}.{found.name}" if found.pkg else found.name
    out = objects.sparkSession.createDataFrame([("object", f"{found.kind} {title}", False), ("place", f"{found.file}:{found.line}", False)], "section string, item string, truncated boolean")
    if access is not None:
        own = access.where(F.upper("object").isin(title.upper(), found.name.upper()))
        out = out.unionByName(first("reads", own.where("mode = 'read'").select("table"), most)).unionByName(first("writes", own.where("mode = 'write'").select("table"), most))
    calls = cg_edges.where(F.col("type").isin("PLSQL_CALL", "DB_CALL"))
    out = out.unionByName(first("caller", calls.where(F.col("to_id").contains(found.name)).select("from_id"), most))
    return out.unionByName(first("callee", calls.where(F.col("from_id").contains(found.name)).select(F.coalesce("label", "to_id")), most))


def zoom_out_entity(impacted: DataFrame, files: DataFrame, entity: str, top: int = 8) -> DataFrame:
    """(section, name, n): the entity's own module and layer (home), the ``top`` modules with most of what depends on it, and counts by kind.

    impacted: (id, kind, ...); only files (``file:<path>``) have a module. files: (rel_path, module, layer).
    """
    place = files.select(F.concat(F.lit("file:"), "rel_path").alias("id"), "module", "layer")
    own = F.inline(F.array(*(F.struct(F.lit(f"home {c}").alias("section"), F.col(c).alias("name"), F.lit(1).cast("long").alias("n")) for c in ("module", "layer"))))
    home = place.where(F.col("id") == entity).dropDuplicates(["id"]).select(own).where("name is not null")
    kinds = impacted.groupBy(F.col("kind").alias("name")).agg(F.count("*").alias("n")).select(F.lit("kind").alias("section"), "name", "n")
    by = impacted.join(place, "id").where("module is not null and module != ''").groupBy(F.col("module").alias("name")).agg(F.count("*").alias("n"))
    return home.unionByName(by.orderBy(F.desc("n"), "name").limit(top).select(F.lit("module").alias("section"), "name", "n")).unionByName(kinds)


def fuzzy_modules(modules: DataFrame, query: str) -> DataFrame:
    """(name, score): 100 equal, 80 prefix, 60 contained, else up to 40 by the share of the query's words in the name."""
    name, q = F.lower("name"), query.lower()
    words = [w for w in q.replace("-", " ").replace("_", " ").split() if w]
    share = sum((name.contains(w).cast("int") for w in words), F.lit(0)) * 40 / max(1, len(words))
    score = F.when(name == q, 100).when(name.startswith(q), 80).when(name.contains(q), 60).otherwise(F.floor(share)).cast("int")
    return modules.select("name", score.alias("score")).where("score > 0").orderBy(F.desc("score"), "name")


def concept_map(sections: dict[str, tuple[DataFrame, Column, Column]], concept: str) -> DataFrame:
    """(section, id): rows of every section (frame, id, searched text) that hold the concept, in any case."""
    parts = [df.where(F.lower(text).contains(concept.lower())).select(F.lit(name).alias("section"), ident.cast("string").alias("id")) for name, (df, ident, text) in sections.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.distinct()


def gaps(modules: DataFrame, files: DataFrame, edges: DataFrame, endpoints: DataFrame, rules: DataFrame, thin: int = 3, external: DataFrame | None = None) -> DataFrame:
    """(gap, id): modules without endpoints or rules, thin modules (of more than three), files that no edge touches, and external packages (package). endpoints and rules: (file)."""
    where = lambda df: df.select(F.col("file").alias("rel_path")).distinct().join(files, "rel_path").select(F.col("module").alias("name")).distinct()
    row = lambda df, gap, c="name": df.select(F.lit(gap).alias("gap"), F.col(c).alias("id"))
    touched = edges.select(F.col("from_file").alias("rel_path")).union(edges.select("to_file")).distinct()
    sizes = files.groupBy(F.col("module").alias("name")).agg(F.count("*").alias("n"))
    several = sizes.agg((F.count("*") > 3).alias("several"))  # one row
    out = (
        row(modules.join(where(endpoints), "name", "left_anti"), "no endpoint")
        .unionByName(row(modules.join(where(rules), "name", "left_anti"), "no rule"))
        .unionByName(row(sizes.crossJoin(several).where((F.col("n") < thin) & F.col("several")), "thin module"))
        .unionByName(row(files.join(touched, "rel_path", "left_anti"), "isolated file", "rel_path"))
    )
    return out if external is None else out.unionByName(row(external, "external package", "package"))


def openapi(endpoints: DataFrame) -> DataFrame:
    """(path, methods, params): endpoints grouped by path, :x written as {x}, and the parameters of the path."""
    path = F.regexp_replace("path", r":([A-Za-z_][A-Za-z0-9_]*)", r"{$1}")
    grouped = endpoints.withColumn("path", path).groupBy("path").agg(F.array_join(F.sort_array(F.collect_set("method")), ",").alias("methods"))
    return grouped.withColumn("params", F.array_join(F.regexp_extract_all("path", F.lit(r"\{([^}]*)\}"), 1), ","))


def module_index(modules: DataFrame, files: DataFrame, risks: DataFrame) -> DataFrame:
    """(module, files, languages, risks): files, their languages and risks by path prefix, not by membership: a file counts for every module whose path its own begins with.

    modules (name, path), files (file, language), risks (file, a row each). A
    prefix is one of the file's own beginnings, cut at the lengths that module
    paths have, so the join is an equi-join.
    """
    lengths = [r.n for r in modules.select(F.length("path").alias("n")).distinct().collect()]  # the different lengths of module paths
    cut = F.explode(F.array(*(F.substring("file", 1, n) for n in lengths)) if lengths else F.expr("cast(array() as array<string>)"))
    count = risks.groupBy("file").agg(F.count("*").alias("n"))
    rows = files.join(count, "file", "left").select("language", F.coalesce("n", F.lit(0)).alias("n"), cut.alias("path"), "file")
    hit = modules.join(rows.select("file", "language", "n", "path").distinct(), "path")
    return hit.groupBy(F.col("name").alias("module")).agg(F.count("*").alias("files"), F.count_distinct("language").alias("languages"), F.sum("n").cast("long").alias("risks"))


def call_graph_dump(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(part, id, to_id, kind, label, confidence): all nodes (kind is their layer), then all edges of a call graph."""
    none = F.lit(None).cast("string")
    n = nodes.select(F.lit("node").alias("part"), "id", none.alias("to_id"), F.col("layer").alias("kind"), "label", none.alias("confidence"))
    return n.unionByName(edges.select(F.lit("edge").alias("part"), F.col("from_id").alias("id"), "to_id", F.col("type").alias("kind"), "label", "confidence"))


def executive_report(snapshots: DataFrame, risks: DataFrame, knowledge: DataFrame, costs: DataFrame, activity: DataFrame) -> DataFrame:
    """(section, a, b, n): the last 20 scores, the first 10 critical and high risks, the 8 gravest knowledge risks, the 8 costliest modules and the last 10 activities.

    snapshots (ts, event_id, grade, score), risks (level, title), knowledge
    (file, author, weight), costs (module, cost), activity (ts, event_id, type).
    Times are whole seconds.
    """
    seconds = F.floor(F.unix_micros("ts") / 1000000.0 + 0.5).cast("string")
    last = lambda df, n: df.orderBy(F.desc("ts"), F.desc("event_id")).limit(n)
    row = lambda df, name, a, b, n: df.select(F.lit(name).alias("section"), a.alias("a"), b.alias("b"), n.cast("double").alias("n"))
    grave = risks.where("level in ('critical', 'high')").orderBy("level", "title").limit(10)
    return (
        row(last(snapshots, 20), "trend", seconds, F.col("grade"), F.col("score"))
        .unionByName(row(grave, "risk", F.col("level"), F.col("title"), F.lit(1)))
        .unionByName(row(knowledge.orderBy(F.desc("weight"), "file").limit(8), "knowledge", F.col("file"), F.col("author"), F.col("weight")))
        .unionByName(row(costs.orderBy(F.desc("cost"), "module").limit(8), "cost", F.col("module"), F.lit(""), F.col("cost")))
        .unionByName(row(last(activity, 10), "activity", seconds, F.col("type"), F.col("event_id")))
    )


def module_context(module: str, files: DataFrame, contents: DataFrame, edges: DataFrame, risks: DataFrame, endpoints: DataFrame, budget: int = 75_000, listed: int = 50, shown: int = 10) -> DataFrame:
    """(section, place, text, truncated) about a module, sections in order, as far as ``budget`` tokens go.

    module: its name, languages and counts; file: the first ``listed`` by path,
    central ones with a star, then how many more; risk: the first 20, all or
    none, and only with over 1,000 tokens left; endpoint: as many as fit, with
    over 1,000 left; content: whole files, central ones first and then by path,
    ``shown`` of them at most, while 2,000 tokens are left; the one that
    doesn't fit is cut to what does, if that is over 500 characters.

    files: (rel_path, module, lines); contents: (rel_path, content); edges:
    (from_file, to_file); risks: (level, title, rel_path, line); endpoints:
    (method, path, file, line). Nulls in texts are left out of them. A file that
    files list twice is one. An unknown module has only its first line, with no files.
    """
    first = files.where(F.col("module") == module).groupBy("rel_path").agg(F.max("lines").alias("lines"))
    own = stored(first.join(F.broadcast(central_files(edges).withColumnRenamed("file", "rel_path")), "rel_path", "left"), "own")
    here = own.select("rel_path")
    hit = stored(risks.join(here, "rel_path", "left_semi").select("level", "title", "rel_path", "line"), "risks")
    served = stored(endpoints.join(here.withColumnRenamed("rel_path", "file"), "file", "left_semi").select("method", "path", "file", "line"), "endpoints")
    n_files, n_risks, n_served = own.count(), hit.count(), served.count()
    ext = F.when(extension(F.col("rel_path")) != "", extension(F.col("rel_path")))
    languages = F.sort_array(F.collect_set(ext))
    line = F.concat_ws(", ", F.lit(module), F.lit(f"{n_files} files"), F.lit(f"{n_risks} risks"), F.lit(f"{n_served} endpoints"), F.when(F.size(languages) > 0, F.array_join(languages, " ")))

    def section(name: str, rows: DataFrame, text: Column, *order) -> DataFrame:
        place = F.row_number().over(Window.orderBy(*order))
        return rows.select(F.lit(name).alias("section"), place.cast("long").alias("place"), text.alias("text"), F.lit(False).alias("truncated"))

    head = section("module", own.agg(line.alias("text")), F.col("text"), "text")
    star = F.when(F.col("in_degree").isNotNull(), F.lit("*"))
    size = F.concat(F.lit("("), F.col("lines").cast("string"), F.lit(" lines)"))
    parts = [head, section("file", own.orderBy("rel_path").limit(listed), F.concat_ws(" ", "rel_path", size, star), "rel_path")]
    if n_files > listed:
        more = own.limit(1).select(F.lit(f"and {n_files - listed} more").alias("text"))
        parts.append(more.select(F.lit("file").alias("section"), F.lit(listed + 1).cast("long").alias("place"), "text", F.lit(True).alias("truncated")))

    def fitting(rows: DataFrame, left: int) -> tuple[DataFrame, int]:
        upto = F.sum(tokens_of(F.col("text"))).over(Window.orderBy("place"))  # rows of one section: ``listed``, or a budget's
        kept = stored(rows.withColumn("upto", upto).where(F.col("upto") <= left), "section")
        return kept.drop("upto"), left - (kept.agg(F.max("upto")).first()[0] or 0)

    def tokens(rows: DataFrame) -> int:
        return rows.agg(F.sum(tokens_of(F.col("text")))).first()[0] or 0

    left = budget
    out = []
    for part in parts:
        part, left = fitting(part, left)
        out.append(part)
    order: list
    if n_risks and left > 1000:
        order = ["level", "rel_path", "line", "title"]
        most = section("risk", hit.orderBy(*order).limit(20), F.concat_ws(" ", F.concat(F.lit("["), F.upper("level"), F.lit("]")), "title", F.concat_ws(":", "rel_path", "line")), *order)
        most = stored(most, "section")
        if tokens(most) <= left:
            out, left = [*out, most], left - tokens(most)
    if n_served and left > 1000:
        order = ["path", "method", "file", "line"]
        # every line takes a token at least, so no more than that many can fit
        lines = section("endpoint", served.orderBy(*order).limit(left), F.concat_ws(" ", "method", "path", F.concat_ws(":", "file", "line")), *order)
        part, left = fitting(lines, left)
        out.append(part)
    if left > 5000:
        order = [F.col("in_degree").isNull(), F.desc("in_degree"), "rel_path"]
        chosen = F.broadcast(own.orderBy(*order).limit(shown))  # ten rows
        texts = contents.join(chosen, "rel_path").where("content is not null").dropDuplicates(["rel_path"])
        block = section("content", texts, F.concat_ws("\n", "rel_path", "content"), *order)
        before = F.coalesce(F.sum(tokens_of(F.col("text"))).over(Window.orderBy("place").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        rest = F.lit(left) - F.col("before")
        fits, cut = tokens_of(F.col("text")) <= rest, (rest * 4 - 200).cast("int")
        kept = block.withColumn("before", before).where(rest >= 2000).where(fits | (cut > 500))
        out.append(kept.select("section", "place", F.when(fits, F.col("text")).otherwise(F.expr(f"substr(text, 1, cast(({left} - before) * 4 - 200 as int))")).alias("text"), (~fits).alias("truncated")))
    return reduce(DataFrame.unionByName, out)
