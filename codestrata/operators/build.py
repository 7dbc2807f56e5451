"""Graph construction: dependency, call and impact graphs from extracted rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import base_name, domain_keyword, node_id
from ..sources.durable import spread, stored
from .routes import match_routes

CENTRAL = 20

#: What may follow an import's path, in order of preference.
IMPORT_ENDINGS = ("", ".ts", ".tsx", ".js", ".jsx", "/index.ts", "/index.js")


def dependency_edges(*sources: DataFrame, rows_in_all: int = 0) -> DataFrame:
    """(from_file, to_file, kind, confidence): union of edge sources without self-edges; duplicates keep the better confidence.

    ``rows_in_all``: of the sources, where known; many are dealt to as many more tasks.
    """
    rows = reduce(DataFrame.unionByName, [s.select("from_file", "to_file", F.coalesce("kind", F.lit("import")).alias("kind"), F.coalesce("confidence", F.lit("inferred")).alias("confidence")) for s in sources])
    rows = spread(rows.where("from_file != to_file"), rows_in_all, "from_file", "to_file")
    return rows.groupBy("from_file", "to_file", "kind").agg(F.max("confidence").alias("confidence"))


def degrees(edges: DataFrame) -> DataFrame:
    """(file, in_degree, out_degree) over distinct pairs, in one aggregation of both ends."""
    ends = F.array(F.struct(F.col("from_file").alias("file"), F.lit(1).alias("o"), F.lit(0).alias("i")), F.struct(F.col("to_file").alias("file"), F.lit(0).alias("o"), F.lit(1).alias("i")))
    rows = edges.select("from_file", "to_file").distinct().select(F.inline(ends))
    return rows.groupBy("file").agg(F.sum("i").alias("in_degree"), F.sum("o").alias("out_degree"))


def central_files(edges: DataFrame, top: int = CENTRAL) -> DataFrame:
    return degrees(edges).where("in_degree > 0").orderBy(F.desc("in_degree"), "file").limit(top)


def resolve_imports(imports: DataFrame, files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Edges and external packages of imports (from_file, spec).

    A relative spec is tried with every ending; the first that is a file wins.
    Others are packages: the first segment, two if it is scoped.
    """
    folder = F.regexp_extract("from_file", r"^(.*/)?[^/]*$", 1)
    joined = F.concat(folder, F.col("spec"))

    def step(parts: Column, p: Column) -> Column:
        keep = F.size(parts) > 0
        return F.when((p == ".") | (p == ""), parts).when(p == "..", F.when(keep, F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0)))).otherwise(parts)).otherwise(F.concat(parts, F.array(p)))

    clean = F.array_join(F.aggregate(F.split(joined, "/", -1), F.array().cast("array<string>"), step), "/")
    local = imports.where(F.col("spec").startswith(".")).select("from_file", "spec", clean.alias("path"))
    tried = local.select("from_file", "spec", F.posexplode(F.array(*(F.concat("path", F.lit(e)) for e in IMPORT_ENDINGS))).alias("place", "to_file"))
    hit = tried.join(files.select(F.col("rel_path").alias("to_file")), "to_file").groupBy("from_file", "spec").agg(F.min_by("to_file", "place").alias("to_file"))
    edges = hit.select("from_file", "to_file", F.lit("import").alias("kind"), F.lit("inferred").alias("confidence")).distinct()
    package = F.when(F.col("spec").startswith("@"), F.regexp_extract("spec", "^(@[^/]+/[^/]+|@[^/]+)", 1)).otherwise(F.substring_index("spec", "/", 1))
    external = imports.where(~F.col("spec").startswith(".") & ~F.col("spec").startswith("/")).groupBy(package.alias("package")).agg(F.count_distinct("from_file").alias("files"))
    return edges, external


def symbol_edges(calls: DataFrame, types: DataFrame, fields: DataFrame, imports: DataFrame) -> DataFrame:
    """(from_file, to_file, kind, confidence): calls through typed receivers, and implements / extends.

    calls (file, receiver, method), types (file, name, kind, package, supers),
    fields (file, name, type), imports (file, name, origin). A name means the
    explicit import, else its package's type, else a global one. An interface
    with one implementor leads to it, resolved; with several to each, inferred;
    with none to itself.
    """
    named = types.select("name", F.col("file").alias("to_file"), F.col("package").alias("to_package"), F.col("kind").alias("to_kind"))
    uses = calls.join(fields.select("file", F.col("name").alias("receiver"), "type"), ["file", "receiver"]).select("file", F.col("type").alias("name")).distinct().withColumn("kind", F.lit("call"))
    supers = types.select("file", F.explode("supers").alias("s")).select("file", F.col("s.name").alias("name"), F.col("s.kind").alias("kind")).distinct()
    own = types.groupBy("file").agg(F.first("package", True).alias("package"))
    wanted = uses.unionByName(supers).join(own, "file", "left").join(imports.select("file", "name", "origin"), ["file", "name"], "left")
    options = wanted.join(named, "name").withColumn("rank", F.when(F.col("origin").isNotNull() & (F.col("to_file") == F.col("origin")), 1).when(F.col("to_package") == F.col("package"), 2).otherwise(3))
    best = options.withColumn("r", F.rank().over(Window.partitionBy("file", "name", "kind").orderBy("rank"))).where("r = 1").where("file != to_file")
    implementors = types.select(F.col("file").alias("impl"), F.explode("supers").alias("s")).where("s.kind = 'implements'").select("impl", F.col("s.name").alias("name")).distinct()
    counted = implementors.withColumn("n", F.count("*").over(Window.partitionBy("name")))
    through = best.where("kind = 'call'").join(counted, "name", "left")
    many = F.count("*").over(Window.partitionBy("file", "name", "kind"))
    target = F.when((F.col("to_kind") == "interface") & F.col("impl").isNotNull(), F.col("impl")).otherwise(F.col("to_file"))
    sure = F.when((F.col("to_kind") == "interface") & (F.col("n") > 1), "inferred").when(F.col("n").isNull() & (many > 1), "inferred").otherwise("resolved")
    called = through.withColumn("confidence", sure).select(F.col("file").alias("from_file"), target.alias("to_file"), "kind", "confidence")
    direct = best.where("kind != 'call'").select(F.col("file").alias("from_file"), "to_file", "kind", F.lit("resolved").alias("confidence"))
    return dependency_edges(called, direct)


def barrels(imports: DataFrame, exports: DataFrame) -> DataFrame:
    """imports (file, name, origin) with origins followed through re-exports (file, name, origin) to where a name is defined.

    Re-exports double their reach each round, so chains of any length take few
    rounds; a name that only leads in circles keeps its origin.
    """
    hop = exports.groupBy(F.col("file").alias("at"), "name").agg(F.min("origin").alias("to"))
    hop = stored(hop, "exports")
    for _ in range(max(1, hop.count()).bit_length()):
        further = hop.select(F.col("at").alias("to"), "name", F.col("to").alias("further"))
        step = stored(hop.join(further, ["to", "name"], "left").select("at", "name", F.coalesce("further", "to").alias("to"), F.col("further").isNotNull().alias("moved")), "exports")
        hop, moved = step.select("at", "name", "to"), step.where("moved")
        if moved.isEmpty():
            break
    ends = hop.join(hop.select(F.col("at").alias("to"), "name"), ["to", "name"], "left_anti").select(F.col("at").alias("origin"), "name", F.col("to").alias("end"))
    return imports.join(ends, ["origin", "name"], "left").select("file", "name", F.coalesce("end", "origin").alias("origin"))


def match_names(files: DataFrame, endpoints: DataFrame) -> DataFrame:
    """files (file) with the first endpoint (endpoint_id, file, by ord) whose subject is a prefix of the file's, or the other way round.

    Prefixes are equal on their first three letters, so those are the join key.
    """
    f = files.select("file", domain_keyword(F.col("file")).alias("k")).where("k is not null").withColumn("head", F.substring("k", 1, 3))
    e = endpoints.select("endpoint_id", "ord", domain_keyword(F.col("file")).alias("ek")).where("ek is not null").withColumn("head", F.substring("ek", 1, 3))
    pairs = f.join(e, "head").where(F.col("k").startswith(F.col("ek")) | F.col("ek").startswith(F.col("k")))
    return pairs.groupBy("file").agg(F.min_by("endpoint_id", "ord").alias("endpoint_id"))


def call_graph(calls: DataFrame, endpoints: DataFrame, db_calls: DataFrame, objects: DataFrame, plsql_calls: DataFrame, access: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes (id, label, layer, file, line) and edges (from_id, to_id, type, confidence, label).

    calls (call_id, file, url, confidence); endpoints (endpoint_id, ord, file,
    path, line); db_calls (file, name, confidence); objects (name, file, line);
    plsql_calls (caller, callee); access (file, table, mode). A frontend file
    without any url match falls back to names, at low confidence.
    """
    routed = match_routes(calls.select("call_id", "url"), endpoints).join(calls, "call_id").select("file", "endpoint_id", "confidence", F.col("url").alias("label"))
    rest = calls.select("file").distinct().join(routed.select("file"), "file", "left_anti")
    named = match_names(rest, endpoints).select("file", "endpoint_id", F.lit("low").alias("confidence"), F.lit("name").alias("label"))
    target = endpoints.select("endpoint_id", F.col("file").alias("to_file"))
    fe, be = node_id("fe", F.col("file")), node_id("be", F.col("to_file"))
    http = routed.unionByName(named).join(target, "endpoint_id").select(fe.alias("from_id"), be.alias("to_id"), F.lit("HTTP_CALL").alias("type"), "confidence", "label")
    own, db = node_id("be", F.col("file")), lambda c: node_id("db", F.upper(F.col(c)))
    sql = db_calls.select(own.alias("from_id"), db("name").alias("to_id"), F.lit("DB_CALL").alias("type"), "confidence", F.col("name").alias("label"))
    inner = plsql_calls.select(db("caller").alias("from_id"), db("callee").alias("to_id"), F.lit("PLSQL_CALL").alias("type"), F.lit("high").alias("confidence"), F.col("callee").alias("label"))
    table = access.select(own.alias("from_id"), node_id("tbl", F.upper("table")).alias("to_id"), F.lit("TABLE_ACCESS").alias("type"), F.lit("high").alias("confidence"), F.col("mode").alias("label"))
    rank = F.when(F.col("confidence") == "high", 0).otherwise(1)
    first = Window.partitionBy("from_id", "to_id", "type").orderBy(rank, "label")
    edges = reduce(DataFrame.unionByName, (http, sql, inner, table)).withColumn("r", F.row_number().over(first)).where("r = 1").drop("r")

    def nodes(df: DataFrame, node: Column, label: Column, layer: str, file: Column, line: Column) -> DataFrame:
        return df.select(node.alias("id"), label.alias("label"), F.lit(layer).alias("layer"), file.alias("file"), line.cast("int").alias("line"))

    none = F.lit(None)
    every = [
        nodes(calls, node_id("fe", F.col("file")), base_name(F.col("file")), "frontend", F.col("file"), none),
        nodes(endpoints, node_id("be", F.col("file")), base_name(F.col("file")), "backend", F.col("file"), F.col("line")),
        nodes(db_calls, own, base_name(F.col("file")), "backend", F.col("file"), none),
        nodes(access, own, base_name(F.col("file")), "backend", F.col("file"), none),
        nodes(objects, db("name"), F.upper("name"), "database", F.col("file"), F.col("line")),
        nodes(db_calls, db("name"), F.upper("name"), "database", none.cast("string"), none),
        nodes(access, node_id("tbl", F.upper("table")), F.upper("table"), "database", none.cast("string"), none),
    ]
    named_first = Window.partitionBy("id").orderBy(F.col("file").isNull(), F.col("line").isNull(), "line", "label")
    return reduce(DataFrame.unionByName, every).withColumn("r", F.row_number().over(named_first)).where("r = 1").drop("r"), edges


def typed_edges(*sources: DataFrame) -> DataFrame:
    """The impact graph: (from_id, to_id, from_kind, to_kind, via, confidence) of all sources in order; of one (from, to, via) the first source's confidence stays."""
    columns = ("from_id", "to_id", "from_kind", "to_kind", "via", "confidence")
    ranked = [s.select(*columns, F.lit(i).alias("rank")) for i, s in enumerate(sources)]
    rows = reduce(DataFrame.unionByName, ranked).where("from_id is not null and to_id is not null and from_id != to_id")
    best = F.min(F.struct("rank", F.when(F.col("confidence") == "resolved", 0).otherwise(1).alias("c"), "from_kind", "to_kind", "confidence")).alias("b")
    return rows.groupBy("from_id", "to_id", "via").agg(best).select("from_id", "to_id", "b.from_kind", "b.to_kind", "via", "b.confidence")


def resolve_names(names: DataFrame, declared: DataFrame, synonyms: DataFrame) -> DataFrame:
    """names (name, optionally pkg.name) to (name, id, confidence).

    A synonym is replaced first. A qualified hit or a unique simple name is
    resolved (inferred if its package is another); of several the least id,
    inferred; nothing declared gives the synthetic id ``plsql:<name>``.
    declared: (id, pkg, simple); synonyms: (name, target).
    """
    n = names.select("name").distinct().join(synonyms.select("name", "target"), "name", "left").withColumn("real", F.upper(F.coalesce("target", "name")))
    n = n.withColumn("simple", F.substring_index("real", ".", -1)).withColumn("pkg", F.when(F.col("real").contains("."), F.element_at(F.split("real", r"\."), -2)))
    d = declared.select(F.upper("simple").alias("simple"), F.upper("pkg").alias("d_pkg"), F.col("id").alias("d_id"))
    both = n.join(d, "simple", "left")
    exact = F.col("pkg").isNotNull() & (F.col("pkg") == F.col("d_pkg"))
    g = both.groupBy("name", "real", "pkg").agg(F.count("d_id").alias("n"), F.min(F.when(exact, F.col("d_id"))).alias("qualified"), F.min("d_id").alias("least"))
    found = F.coalesce("qualified", "least", F.concat(F.lit("plsql:"), "real"))
    sure = F.when(F.col("qualified").isNotNull(), "resolved").when((F.col("n") == 1) & F.col("pkg").isNull(), "resolved").otherwise("inferred")
    return g.select("name", found.alias("id"), sure.alias("confidence"))
