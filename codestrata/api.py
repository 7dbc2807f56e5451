"""The estate's named tools as functions over opened index relations: each returns a DataFrame.

``Estate`` holds relations (see schemas.RELATIONS) and what was extracted besides;
a tool is looked up by name with ``Estate.call``.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .operators import govern, levels, score, search, traverse
from .sources.durable import stored


@dataclass
class Estate:
    """relations: the index; facts: endpoints, permissions, rules, risks, patterns, tables, jobs and so on, by name."""

    relations: dict[str, DataFrame]
    facts: dict[str, DataFrame] = field(default_factory=dict)

    def __getattr__(self, name: str) -> DataFrame:
        for store in ("relations", "facts"):
            held = self.__dict__.get(store, {})
            if name in held:
                return held[name]
        raise AttributeError(f"this estate has no {name}")

    def call(self, tool: str, **arguments) -> DataFrame:
        return TOOLS[tool](self, **arguments)


def _matching(df: DataFrame, columns: tuple[str, ...], text: str | None) -> DataFrame:
    if not text:
        return df
    hit = F.lit(False)
    for c in columns:
        hit = hit | F.lower(F.col(c)).contains(text.lower())
    return df.where(hit)


def _fact(name: str, *columns: str):
    """A tool that lists a fact, filtered by a text in any of the columns."""
    return lambda e, query=None: _matching(getattr(e, name), columns, query)


def get_module(e: Estate, module: str, budget: int = 75_000) -> DataFrame:
    """The module's files, risks, endpoints and contents, central files first, as far as the budget of tokens goes."""
    return levels.module_context(module, e.files, e.contents, e.edges, e.risks, e.endpoints, budget)


def get_plsql_object(e: Estate, name: str) -> DataFrame:
    """One object with what it reads and writes, who calls it and what it calls."""
    return levels.object_report(e.objects, e.cg_edges, name, e.facts.get("object_access"))


def get_zoom_out(e: Estate, entity: str | None = None) -> DataFrame:
    if entity is None:
        return levels.zoom_out(e.edges, e.files)
    return levels.zoom_out_entity(traverse.impact_of(e.impact_edges, entity, max_depth=3), e.files, entity)


def _entity(e: Estate, name: str) -> str:
    """A graph id as given, or the best that a free name may mean."""
    if ":" in name:
        return name
    best = traverse.resolve_id(e.impact_edges, e.symbols, e.files, name).first()
    return best.id if best else name


def get_diagnosis(e: Estate, entity: str, to: str | None = None, most: int = 5) -> DataFrame:
    """Suspects and a hypothesis for each: one node of each depth upstream, by predicted risk. With ``to``, only what that end depends on. predictions: (id or file, score, reasons)."""
    from pyspark.sql import Window

    entity = _entity(e, entity)
    p = e.predictions
    ident = F.col("id") if "id" in p.columns else F.concat(F.lit("file:"), "file")
    near = traverse.impact_of(e.impact_edges, entity, max_nodes=1500).join(p.select(ident.alias("id"), "score", "reasons"), "id", "left")
    if to is not None:
        end = e.impact_edges.sparkSession.createDataFrame([(_entity(e, to),)], "seed string")
        between = traverse.reach(e.impact_edges, end, source="to_id", target="from_id").select("id").unionByName(end.select(F.col("seed").alias("id")))
        near = near.join(between, "id", "left_semi")
    first = Window.partitionBy("depth").orderBy(F.desc_nulls_last("score"), "id")
    weak = F.when(F.col("confidence") == "inferred", ", by an inferred link").otherwise("")
    risk = F.when(F.col("score").isNotNull(), F.concat(F.lit(", risk "), F.col("score").cast("string"))).otherwise("")
    said = F.concat(F.lit("a change of "), "id", F.lit(" (depth "), F.col("depth").cast("string"), weak, risk, F.lit(f") reaches {entity}"))
    ranked = near.withColumn("r", F.row_number().over(first)).where("r = 1").orderBy(F.desc_nulls_last("score"), "depth").limit(most)
    return ranked.select("id", "depth", "confidence", "score", "reasons", said.alias("hypothesis"))


def get_agent_brief(e: Estate, entity: str) -> DataFrame:
    """(section, id, n): the blast radius, what must still work afterwards, then symbols and methods of the entity's file."""
    entity = _entity(e, entity)
    near = stored(traverse.blast_radius(e.impact_edges, entity, top=10), "brief")
    radius = near.select(F.lit("impact").alias("section"), "id", F.col("dependents").cast("long").alias("n"))
    must = near.orderBy(F.desc("dependents"), "depth", "id").limit(6).select(F.lit("criterion").alias("section"), F.concat("id", F.lit(" still works")).alias("id"), F.col("dependents").cast("long").alias("n"))
    file = entity.partition(":")[2]
    kinds = e.symbols.where(F.col("file") == file).orderBy("line").limit(12).select(F.lit("symbol").alias("section"), F.col("simple_name").alias("id"), F.col("line").cast("long").alias("n"))
    methods = e.method_edges.where(F.col("from_file") == file).groupBy("from_method").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "from_method").limit(8).select(F.lit("method").alias("section"), F.col("from_method").alias("id"), "n")
    return radius.unionByName(must).unionByName(kinds).unionByName(methods)


def get_quick_context(e: Estate, budget: int = 12_000) -> DataFrame:
    """(section, line, cum_tokens): top rows of each section, as long as the running token sum fits. Languages (stack) and external packages are there if the estate has them."""
    risk = lambda level, n: e.risks.where(F.col("level") == level).orderBy("rel_path", "line").limit(n)
    counted = lambda df, name, n, top: df.orderBy(F.desc(n), name).limit(top).select(F.concat_ws(" ", name, F.col(n).cast("string")).alias("line"))
    stack, packages = e.facts.get("stack"), e.facts.get("packages")
    parts = [
        ("language", None if stack is None else counted(stack.where("kind = 'language'"), "name", "n", 6)),
        ("module", e.modules.orderBy(F.desc("file_count"), "name").limit(15).select(F.concat_ws(" ", "name", "layer").alias("line"))),
        ("central", e.files.orderBy(F.desc("in_degree"), "rel_path").limit(10).select(F.col("rel_path").alias("line"))),
        ("risk", risk("critical", 8).unionByName(risk("high", 5)).select(F.concat_ws(" ", "level", "title", "rel_path").alias("line"))),
        ("endpoint", e.endpoints.orderBy("path", "method").limit(20).select(F.concat_ws(" ", "method", "path").alias("line"))),
        ("external", None if packages is None else counted(packages, "package", "files", 20)),
    ]
    rows = None
    for i, (name, df) in enumerate(parts):
        if df is not None:
            part = df.select(F.lit(i).alias("place"), F.lit(name).alias("section"), "line")
            rows = part if rows is None else rows.unionByName(part)
    return score.within_budget(rows, "line", budget, ["place", "line"]).select("section", "line", "cum_tokens")


def search_code(e: Estate, query: str, vector: list[float] | None = None, top: int = 10) -> DataFrame:
    """By vector if one is given, else by BM25 over contents if the estate holds them, else by the inverted index of terms."""
    if vector is not None:
        return search.vector_search(e.embeddings, "file", "vec", vector, top)
    contents = e.facts.get("contents")
    if contents is not None:
        return search.bm25(contents, "rel_path", "content", query, top).withColumnRenamed("rel_path", "file")
    return search.inverted(e.search_terms, "file", "terms", query, top)


#: Where a concept is looked for: fact or relation, its id, and the text that is searched.
CONCEPTS = {
    "module": ("modules", "name", "name"), "file": ("files", "rel_path", "rel_path"), "endpoint": ("endpoints", "path", "path"), "table": ("tables", "name", "name"),
    "object": ("objects", "name", "name"), "rule": ("rules", "text", "text"), "symbol": ("symbols", "simple_name", "simple_name"),
}


def get_concept_map(e: Estate, concept: str) -> DataFrame:
    """(section, id) of everything in the estate's sections that holds the concept."""
    held = e.relations | e.facts
    return levels.concept_map({k: (held[name], F.col(i), F.col(t)) for k, (name, i, t) in CONCEPTS.items() if name in held}, concept)


def get_violations(e: Estate) -> DataFrame:
    """Layer violations, and edges that lie on a cycle."""
    ring = traverse.circular(e.edges).select(F.lit("circular").alias("rule"), F.lit("high").alias("severity"), F.col("from_id").alias("from_file"), F.col("to_id").alias("to_file"))
    return govern.layer_violations(e.edges).unionByName(ring)


TOOLS = {
    "list_modules": lambda e: e.modules.orderBy(F.desc("file_count"), "name"),
    "get_module": get_module,
    "get_quick_context": get_quick_context,
    "search_module": lambda e, query: levels.fuzzy_modules(e.modules, query),
    "get_diagram": lambda e: levels.module_pairs(e.edges, e.files),
    "get_openapi": lambda e: levels.openapi(e.endpoints),
    "get_gaps": lambda e: levels.gaps(e.modules, e.files, e.edges, e.endpoints.select("file"), e.rules.select("file")),
    "get_permissions": _fact("permissions", "file", "kind"),
    "get_multigraph": lambda e: levels.multigraph(e.cg_nodes, e.cg_edges)[0],
    "get_business_rules": _fact("rules", "type", "text", "file"),
    "get_impact": lambda e, file: traverse.file_impact(e.edges, e.files.where(F.col("rel_path") == file).select(F.col("rel_path").alias("file"))),
    "get_impact_of": lambda e, entity, **k: traverse.impact_of(e.impact_edges, entity, **k),
    "get_blast_radius": lambda e, entity, top=20: traverse.blast_radius(e.impact_edges, entity, top),
    "get_table_impact": lambda e, table, top=20: traverse.blast_radius(e.impact_edges, table if ":" in table else f"table:{table.upper()}", top),
    "get_graph_level": lambda e, layers=(), modules=(): levels.level(e.edges, e.files, tuple(layers), tuple(modules)),
    "get_arch_rules": lambda e, rules: govern.arch_rules(levels.with_ends(e.edges, e.files), rules),
    "get_arch_suggestions": lambda e: govern.deepening(e.metrics.withColumnRenamed("rel_path", "file"), e.files.select(F.col("rel_path").alias("file"), "in_degree", "out_degree"), traverse.circular(e.edges)),
    "get_risk_prediction": lambda e: e.predictions.orderBy(F.desc("score"), "file"),
    "get_agent_brief": get_agent_brief,
    "get_diagnosis": get_diagnosis,
    "get_zoom_out": get_zoom_out,
    "get_out_of_scope": _fact("out_of_scope", "id", "decision"),
    "list_triage": lambda e, state=None, category=None: govern.triage_list(e.triage, state, category),
    "update_triage": lambda e, changes: govern.triage_transition(e.triage, changes),
    "get_portfolio": lambda e: govern.portfolio(e.portfolio),
    "get_roi": lambda e: score.roi(e.metrics.groupBy("module").agg(F.sum("debt").alias("debt"))),
    "get_ownership": lambda e: score.ownership(e.author_counts, e.metrics.withColumnRenamed("rel_path", "file")),
    "suggest_reviewers": lambda e, changed: score.reviewers(e.author_counts.where("primary"), changed),
    "get_activity": lambda e, keep=50: govern.capped(e.activity, keep, ["ts", "event_id"]),
    "get_health": lambda e: score.health_delta(e.snapshots),
    "get_metrics": lambda e: score.module_metrics(e.metrics),
    "get_hotspots": lambda e, top=20: score.top_metrics(e.metrics, "debt", top),
    "get_patterns": _fact("patterns", "pattern", "file"),
    "get_violations": get_violations,
    "get_inheritance": lambda e: e.classes.where("parent is not null").groupBy("parent").agg(F.count("*").alias("children")).orderBy(F.desc("children"), "parent").limit(20),
    "get_diff_impact": lambda e, changed: traverse.diff_impact(e.impact_edges, changed),
    "get_db_schema": _fact("tables", "name"),
    "get_analysis_json": lambda e: e.export,
    "get_plsql_object": get_plsql_object,
    "get_table_access": lambda e, table: _matching(e.access, ("table",), table),
    "get_table_columns": lambda e, table: e.column_access.where(F.lower("table") == table.lower()).select("column", "mode", F.col("from_file").alias("file")).distinct(),
    "get_dead_plsql": lambda e: levels.dead_objects(e.objects.where("kind in ('procedure', 'function')"), e.plsql_calls.select("callee", "pkg")),
    "get_transactions": _fact("transactions", "file"),
    "get_batch_jobs": _fact("jobs", "file", "kind"),
    "get_angular_modules": _fact("angular", "name", "file"),
    "get_dead_components": lambda e: levels.dead_files(e.files, e.edges, r"\.tsx$|\.(component|directive|pipe)\.ts$"),
    "find_path": lambda e, start, goal: traverse.find_path(e.edges, start, goal),
    "trace_flow": lambda e, entry: traverse.trace(traverse.trace_edges(e.edges, e.cg_nodes, e.cg_edges), e.cg_nodes.select(F.coalesce("file", "id").alias("id"), "layer"), entry),
    "search_code": search_code,
    "get_concept_map": get_concept_map,
}
