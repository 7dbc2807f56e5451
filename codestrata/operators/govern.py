"""Rules, comparisons and keyed state: violations, deltas, gates, triage, portfolio, alerts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import glob_regex, js_round
from ..sources.durable import stored
from .walks import counted, walk

#: Path segments of each side of the layer rules; a slash must stand before them.
FRONTEND = r"/(components?|pages?|views?|screens?|ui|hooks?|contexts?)/"
SERVER = r"/(controllers?|services?|repositor(?:y|ies)|dao|persistence|database|db|server)/"
DATA = r"/(repositor(?:y|ies)|dao|persistence|database|db)/"
CONTROLLER = r"/(controllers?|handlers?|routes?)/"
LAYER_RULES = (("frontend-server", "high", FRONTEND, SERVER), ("controller-db", "medium", CONTROLLER, DATA))

#: Triage states and where each may go, categories, sources and priorities.
TRANSITIONS = {
    "needs-triage": ("needs-info", "ready-for-agent", "ready-for-human", "wontfix"),
    "needs-info": ("needs-triage",),
    "ready-for-agent": ("needs-triage", "done"),
    "ready-for-human": ("needs-triage", "done"),
    "wontfix": ("needs-triage",),
    "done": (),
}
CATEGORIES = ("bug", "enhancement")
SOURCES = ("risk", "arch-rule", "pr-gate", "manual")
PRIORITIES = ("critical", "high", "medium", "low")


def layer_violations(edges: DataFrame, rules=LAYER_RULES) -> DataFrame:
    """(rule, severity, from_file, to_file): distinct edges whose ends match a rule's two path patterns, in any case; one edge may break several."""
    e = edges.select("from_file", "to_file").distinct()
    low = lambda c: F.lower(F.concat(F.lit(""), F.col(c)))
    hits = [e.where(low("from_file").rlike(a) & low("to_file").rlike(b)).select(F.lit(name).alias("rule"), F.lit(sev).alias("severity"), "from_file", "to_file") for name, sev, a, b in rules]
    return reduce(DataFrame.unionByName, hits)


def arch_rules(edges_with_ends: DataFrame, rules: list[dict]) -> DataFrame:
    """(rule_id, severity, from_file, to_file, description): edges that a rule forbids.

    A rule names any of from/to layer, module and path glob; all it names must
    hold (AND). Rules are few and given by the caller, so they become
    predicates of one pass over edges joined with both ends (levels.with_ends).
    """
    fits = []
    for r in rules:
        cond = F.lit(True)
        for side, p, file in (("from", "a", "from_file"), ("to", "b", "to_file")):
            want = r.get(side, {})
            for what in ("layer", "module"):
                if want.get(what):
                    cond &= F.col(f"{p}_{what}") == want[what]
            if want.get("path"):
                cond &= F.col(file).rlike(glob_regex(want["path"]))
        fits.append(F.when(cond, F.struct(F.lit(r["id"]).alias("rule_id"), F.lit(r.get("severity", "error")).alias("severity"), F.lit(r.get("description", "")).alias("description"))))
    hit = edges_with_ends.select("from_file", "to_file", F.explode(F.array_compact(F.array(*fits))).alias("r"))
    return hit.select("r.rule_id", "r.severity", "from_file", "to_file", "r.description").distinct()


def rule_compliance(rule_ids: DataFrame, violations: DataFrame) -> DataFrame:
    """(rule_id, n): violations of every rule, 0 included."""
    n = violations.groupBy("rule_id").agg(F.count("*").alias("n"))
    return rule_ids.join(n, "rule_id", "left").select("rule_id", F.coalesce("n", F.lit(0)).alias("n"))


#: What is said of each kind of candidate: problem, solution, benefits.
DEEPENING = {
    "pass-through": ("it only hands on what it is given", "let callers use what lies behind it", "one place less to change"),
    "shallow-interface": ("many depend on little behind it", "move behaviour of its callers behind it", "callers get simpler"),
    "god-module": ("most of the system touches it", "split it by who uses what", "changes stay local"),
    "circular": ("it can't be changed without what depends on it", "turn one link round or cut it out", "parts can be tested alone"),
}


def deepening(metrics: DataFrame, degrees: DataFrame, cycles: DataFrame, god: int = 50, shallow_lines: int = 20) -> DataFrame:
    """(kind, file, strength, problem, solution, benefits): candidates for a deeper design: pass-through (one in, one out, short), shallow interface (short, many users), god module, circular."""
    m = metrics.select("file", "lines", "cc").join(degrees, "file", "left").fillna(0, ["in_degree", "out_degree"])
    rows = F.array_compact(F.array(
        F.when((F.col("in_degree") == 1) & (F.col("out_degree") == 1) & (F.col("lines") <= shallow_lines), F.struct(F.lit("pass-through").alias("kind"), F.lit("medium").alias("strength"))),
        F.when((F.col("in_degree") >= 5) & (F.col("lines") <= shallow_lines), F.struct(F.lit("shallow-interface").alias("kind"), F.lit("medium").alias("strength"))),
        F.when(F.col("in_degree") + F.col("out_degree") >= god, F.struct(F.lit("god-module").alias("kind"), F.lit("strong").alias("strength"))),
    ))
    found = m.select("file", F.explode(rows).alias("r")).select("r.kind", "file", "r.strength")
    ring = cycles.select(F.lit("circular").alias("kind"), F.col("from_id").alias("file"), F.lit("strong").alias("strength")).distinct()
    told = F.create_map(*(x for k, v in DEEPENING.items() for x in (F.lit(k), F.struct(*(F.lit(t).alias(n) for t, n in zip(v, ("problem", "solution", "benefits"), strict=True))))))
    return found.unionByName(ring).withColumn("t", told[F.col("kind")]).select("kind", "file", "strength", "t.problem", "t.solution", "t.benefits")


def new_rows(base: DataFrame, head: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of head whose key base does not have."""
    return head.join(base.select(*keys).distinct(), keys, "left_anti")


def self_delta(prev: dict[str, DataFrame] | None, cur: dict[str, DataFrame]) -> DataFrame:
    """(type, severity, title): events between two runs. Each run: health (one row, score), risks (file, title, level), violations (rule_id, from_file, to_file), modules (name)."""
    spark = cur["health"].sparkSession
    if prev is None:
        return spark.createDataFrame([], "type string, severity string, title string")
    event = lambda df, kind, sev, title: df.select(F.lit(kind).alias("type"), sev.alias("severity"), title.alias("title"))
    change = cur["health"].select(F.col("score").alias("now")).crossJoin(prev["health"].select(F.col("score").alias("before"))).withColumn("d", F.col("now") - F.col("before"))  # one row each
    moved = change.where("d != 0").select(F.when(F.col("d") < 0, "health-down").otherwise("health-up").alias("type"), F.when(F.col("d") <= -10, "critical").when(F.col("d") < 0, "warn").otherwise("info").alias("severity"), F.concat(F.lit("health "), js_round(F.col("d")).cast("long").cast("string")).alias("title"))
    risks = new_rows(prev["risks"], cur["risks"], ["file", "title", "level"])
    rules = new_rows(prev["violations"], cur["violations"], ["rule_id", "from_file", "to_file"])
    parts = [
        moved,
        event(risks, "new-risk", F.when(F.col("level") == "critical", "critical").otherwise("warn"), F.concat_ws(": ", "title", "file")),
        event(rules, "rule-violation", F.lit("warn"), F.concat_ws(" ", "rule_id", "from_file", "to_file")),
        event(new_rows(prev["modules"], cur["modules"], ["name"]), "module-added", F.lit("info"), F.col("name")),
        event(new_rows(cur["modules"], prev["modules"], ["name"]), "module-removed", F.lit("info"), F.col("name")),
    ]
    return reduce(DataFrame.unionByName, parts)


def prediction_feedback(predicted: DataFrame, fixes_before: DataFrame, fixes_now: DataFrame, new_risk_files: DataFrame, seen: DataFrame, least: int = 60) -> tuple[DataFrame, DataFrame]:
    """Confirmed predictions (file), and (flagged, confirmed, hit_rate) over all that were flagged. predicted: (file, score); fixes: (file, fixes)."""
    flagged = predicted.where(F.col("score") >= least).select("file").distinct()
    a = flagged.join(fixes_before.select("file", F.col("fixes").alias("was")), "file", "left").join(fixes_now.select("file", F.col("fixes").alias("now")), "file", "left")
    more = a.where(F.coalesce("now", F.lit(0)) > F.coalesce("was", F.lit(0))).select("file")
    hit = more.union(flagged.join(new_risk_files.select("file").distinct(), "file", "left_semi")).distinct()
    confirmed = hit.join(seen.select("file"), "file", "left_anti")
    rate = flagged.agg(F.count("*").alias("flagged")).crossJoin(hit.agg(F.count("*").alias("confirmed")))  # one row each
    return confirmed, rate.withColumn("hit_rate", F.when(F.col("flagged") > 0, F.col("confirmed") / F.col("flagged")).otherwise(F.lit(0.0)))


def compare(base: dict[str, DataFrame], head: dict[str, DataFrame], predicted: DataFrame, changed: DataFrame) -> DataFrame:
    """(section, severity, key): what head adds to base: risks, violations, rule violations, and changed files predicted at 50 or more."""
    row = lambda df, section, sev, key: df.select(F.lit(section).alias("section"), sev.alias("severity"), key.alias("key"))
    flags = predicted.where("score >= 50").join(changed.select("file").distinct(), "file", "left_semi")
    return (
        row(new_rows(base["risks"], head["risks"], ["file", "title", "level"]), "new-risk", F.col("level"), F.concat_ws("|", "file", "title"))
        .unionByName(row(new_rows(base["violations"], head["violations"], ["rule", "from_file", "to_file"]), "new-violation", F.col("severity"), F.concat_ws("|", "rule", "from_file", "to_file")))
        .unionByName(row(new_rows(base["rules"], head["rules"], ["rule_id", "from_file", "to_file"]), "new-rule-violation", F.col("severity"), F.concat_ws("|", "rule_id", "from_file", "to_file")))
        .unionByName(row(flags, "risk-flag", F.lit("warn"), F.col("file")))
    )


def pr_review(impact_edges: DataFrame, changed: DataFrame, owners: DataFrame, decisions: DataFrame, health_delta: float | None, tiers=("plsql", "table", "column"), most: int = 50, asked: int = 5, large: int = 20) -> DataFrame:
    """(section, key, n, detail): what a change touches beside compare(): impacts of the first ``most`` changed entities, what they use in the data tier, questions, whether a decision record is due, three reviewers, the change of health. A row ``truncated`` says that more entities have changed.

    changed (id), owners (id, author), decisions (id, decision). A decision is
    asked about if the name of a changed file stands in it.
    """
    spark = impact_edges.sparkSession
    seeds = stored(changed.select(F.col("id").alias("seed")).distinct().orderBy("seed").limit(most + 1), "changed")
    more = seeds.count() > most
    seeds = stored(seeds.orderBy("seed").limit(most), "changed")
    impact_edges = stored(impact_edges.select("from_id", "to_id", "to_kind"), "graph")  # built once for the walk and the hits
    reached = walk(impact_edges, seeds)
    total = stored(counted(reached.levels.select("block", "bits"), reached.seeds).withColumnRenamed("seed", "key"), "impacts")  # at most `most` rows
    hits = impact_edges.where(F.col("to_kind").isin(*tiers)).join(total.select(F.col("key").alias("from_id")), "from_id").groupBy(F.col("from_id").alias("key")).agg(F.min("to_id").alias("detail"))
    hits = stored(hits, "hits")
    row = lambda df, section, n, detail: df.select(F.lit(section).alias("section"), "key", n.cast("long").alias("n"), detail.alias("detail"))
    name = F.regexp_replace(F.substring_index(F.substring_index("seed", ":", -1), "/", -1), r"\.\w+$", "")
    touched = decisions.crossJoin(F.broadcast(seeds.select(F.lower(name).alias("__name"))))  # at most `most` names, decisions are a configuration's
    reopened = touched.where((F.col("__name") != "") & F.lower("decision").contains(F.col("__name"))).select(F.col("id").alias("key"), F.col("decision").alias("detail"), F.lit(1).alias("rank")).distinct()
    about = hits.orderBy("key").limit(3).select("key", F.concat(F.lit("does "), "detail", F.lit(" still fit?")).alias("detail"), F.lit(0).alias("rank"))
    questions = about.unionByName(reopened).orderBy("rank", "key").limit(asked)
    adr = total.agg((F.coalesce(F.max("n"), F.lit(0)) >= large).alias("wide")).crossJoin(hits.agg((F.count("*") > 0).alias("crosses")))  # one row each
    people = owners.join(seeds.select(F.col("seed").alias("id")), "id", "left_semi").groupBy(F.col("author").alias("key")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "key").limit(3)
    none = F.lit(None).cast("string")
    out = row(total, "impact", F.col("n"), none).unionByName(row(hits, "cross-tier", F.lit(1), F.col("detail"))).unionByName(row(questions, "question", F.lit(1), F.col("detail")))
    out = out.unionByName(adr.where("wide and crosses").select(F.lit("decision-record").alias("section"), F.lit("due").alias("key"), F.lit(1).cast("long").alias("n"), none.alias("detail")))
    out = out.unionByName(row(people, "reviewer", F.col("n"), none))
    if more:
        out = out.unionByName(spark.createDataFrame([("truncated", "changed", most, None)], "section string, key string, n long, detail string"))
    if health_delta is not None:
        out = out.unionByName(spark.createDataFrame([("health", "delta", int(health_delta), str(health_delta))], "section string, key string, n long, detail string"))
    return out


def gates(found: DataFrame, health_delta: float | None, spec: str) -> DataFrame:
    """(gate, failed, n) for each known gate of a comma list; unknown names are ignored. found: compare()."""
    section = F.col("section")
    known = {
        "new-high-risks": (section == "new-risk") & F.col("severity").isin("high", "critical"),
        "new-violations": section == "new-violation",
        "new-rule-violations": (section == "new-rule-violation") & (F.col("severity") == "error"),
    }
    wanted = [g.strip() for g in spec.split(",")]
    sums = [F.coalesce(F.sum(known[g].cast("long")), F.lit(0)).alias(g) for g in known if g in wanted]
    rows = [F.struct(F.lit(g).alias("gate"), (F.col(f"`{g}`") > 0).alias("failed"), F.col(f"`{g}`").alias("n")) for g in known if g in wanted]
    for g in wanted:
        name, _, n = g.partition(":")
        if name == "health-drop" and n.isdigit():
            rows.append(F.struct(F.lit(g).alias("gate"), F.lit(health_delta is not None and health_delta < -int(n)).alias("failed"), F.lit(0).cast("long").alias("n")))
    if not rows:
        return found.sparkSession.createDataFrame([], "gate string, failed boolean, n long")
    return found.agg(*sums, F.count("*").alias("__all")).select(F.inline(F.array(*rows)))


def triage_sync(items: DataFrame, candidates: DataFrame) -> DataFrame:
    """items and, as needs-triage, those candidates (id, title, category, priority) that are new. Existing items stay as they are."""
    fresh = candidates.dropDuplicates(["id"]).join(items.select("id"), "id", "left_anti").withColumn("state", F.lit("needs-triage"))
    return items.select("id", "title", "category", "priority", "state").unionByName(fresh.select("id", "title", "category", "priority", "state"))


def triage_transition(items: DataFrame, changes: DataFrame) -> DataFrame:
    """items (id, state, history) after changes (id, to_state, ts): allowed ones are taken and appended to the history; ok tells, null without a change. To the state that an item has is no move: ok, and no history."""
    same = F.col("state") == F.col("to_state")
    allowed = same
    for state, nexts in TRANSITIONS.items():
        if nexts:
            allowed = allowed | ((F.col("state") == state) & F.col("to_state").isin(*nexts))
    j = items.join(changes, "id", "left").withColumn("ok", F.when(F.col("to_state").isNotNull(), allowed))
    moved = F.coalesce("ok", F.lit(False)) & ~same
    return j.withColumn("history", F.when(moved, F.array_append("history", F.struct(F.col("to_state").alias("state"), "ts"))).otherwise(F.col("history"))).withColumn("state", F.when(moved, F.col("to_state")).otherwise(F.col("state"))).drop("to_state", "ts")


def triage_list(items: DataFrame, state: str | None = None, category: str | None = None) -> DataFrame:
    out = items
    for c, v in (("state", state), ("category", category)):
        out = out.where(F.col(c) == v) if v else out
    return out.orderBy(F.array_position(F.array(*(F.lit(p) for p in PRIORITIES)), F.col("priority")), "id")


def manual_item(items: DataFrame, ident: str, title: str, category: str, priority: str = "medium") -> DataFrame:
    row = items.sparkSession.createDataFrame([(ident, title, category, priority, "needs-triage")], "id string, title string, category string, priority string, state string")
    return items.select("id", "title", "category", "priority", "state").unionByName(row)


def project_id(path: Column) -> Column:
    return F.substring(F.sha1(path), 1, 12)


def portfolio(rows: DataFrame, removed: DataFrame | None = None) -> DataFrame:
    """The latest row (by ts) of each project id, worst score first, without a score last. rows: (id, name, score, ts)."""
    last = rows.withColumn("r", F.row_number().over(Window.partitionBy("id").orderBy(F.desc("ts"), F.desc("score")))).where("r = 1").drop("r")
    if removed is not None:
        last = last.join(removed.select("id"), "id", "left_anti")
    return last.orderBy(F.coalesce("score", F.lit(101.0)), "id")


def summarise(runs: DataFrame) -> DataFrame:
    """(id, path, name, score, risks, arch_errors) of runs (path, analysis): the nested results of a run as a portfolio row; what is missing is null, counts 0."""
    a = F.col("analysis")
    count = lambda part, field: F.coalesce(a[part][field], F.lit(0)).cast("long")
    return runs.select(project_id(F.col("path")).alias("id"), "path", F.substring_index("path", "/", -1).alias("name"), a["health"]["score"].alias("score"), count("risks", "total").alias("risks"), count("arch", "error_count").alias("arch_errors"))


def portfolio_totals(rows: DataFrame) -> DataFrame:
    return rows.agg(F.count("*").alias("projects"), js_round(F.avg("score"), 1).alias("avg_score"), F.coalesce(F.sum((F.col("score") < 60).cast("long")), F.lit(0)).alias("at_risk"))


def alerts(events: DataFrame, drop: int = 10) -> DataFrame:
    """Events worth an alert: health drops of at least drop (column change), critical new risks, critical rule violations."""
    return events.where(((F.col("type") == "health-down") & (F.col("change") <= -drop)) | (F.col("type").isin("new-risk", "rule-violation") & (F.col("severity") == "critical")))


def capped(rows: DataFrame, keep: int, order: list[str], key: str | None = None) -> DataFrame:
    """The last ``keep`` rows by order, overall or of each key."""
    if key is None:
        return rows.orderBy(*(F.desc(c) for c in order)).limit(keep)
    return rows.withColumn("r", F.row_number().over(Window.partitionBy(key).orderBy(*(F.desc(c) for c in order)))).where(F.col("r") <= keep).drop("r")
