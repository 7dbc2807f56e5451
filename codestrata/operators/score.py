"""Metrics and scores: complexity, debt, health, risk prediction, ownership, return on investment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.durable import stored
from ..functions.text import js_round, line_count, tokens_of

#: Penalty weights of risk levels, health grades and their least scores.
RISK_WEIGHTS = {"critical": 4.0, "high": 2.0, "medium": 0.5, "low": 0.1}
GRADES = (("A", 90), ("B", 75), ("C", 60), ("D", 40))
MAX_COMPLEXITY = 999
HOURS_PER_POINT, HOURLY_RATE, CURRENCY, MINUTES_PER_IMPACT = 0.5, 50.0, "US$", 5


def complexity(content: Column) -> Column:
    """1 + branch keywords and operators outside comments and strings; ``else if`` counts besides its ``if``; a run of ``?`` counts once. Word edges are ASCII ones."""
    code = content
    for pattern in (r"(?s)/\*.*?\*/", r"//[^\n]*", r'"(?:[^"\\\n]|\\.)*"', r"'(?:[^'\\\n]|\\.)*'", r"(?s)`(?:[^`\\]|\\.)*`"):
        code = F.regexp_replace(code, pattern, " ")
    words = ("if", r"else\s+if", "for", "while", "do", "case", "catch")
    branches = [rf"(?<![A-Za-z0-9_]){w}(?![A-Za-z0-9_])" for w in words] + [r"&&", r"\|\|", r"\?(?!\?)"]
    return F.least(sum((F.regexp_count(code, F.lit(p)) for p in branches), F.lit(1)), F.lit(MAX_COMPLEXITY)).cast("long")


def file_metrics(files: DataFrame, degrees: DataFrame) -> DataFrame:
    """files (rel_path, module, content) with lines, cc, in_degree, out_degree, debt, hotspot."""
    f = files.withColumn("lines", line_count(F.col("content"))).withColumn("cc", complexity(F.col("content"))).drop("content")
    f = f.join(degrees.withColumnRenamed("file", "rel_path"), "rel_path", "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in ("in_degree", "out_degree")})
    return f.withColumn("debt", debt(F.col("cc"), F.col("lines"), F.col("out_degree"))).withColumn("hotspot", (F.col("cc") > 15) & (F.col("in_degree") > 3))


def debt(cc: Column, lines: Column, out: Column) -> Column:
    size = F.when(lines > 1500, 10).when(lines > 500, 3).otherwise(0)
    return (F.when(cc > 20, F.least(2 * (cc - 20), F.lit(40))).otherwise(0) + size + F.when(out > 15, F.least(out - 15, F.lit(15))).otherwise(0)).cast("long")


def module_metrics(metrics: DataFrame, listed: int = 5) -> DataFrame:
    """Per module: files, avg_cc (rounded), max_cc and its file, lines, avg_in (1 place), debt, first hotspots by name."""
    hot = F.slice(F.sort_array(F.collect_list(F.when(F.col("hotspot"), F.col("rel_path")))), 1, listed)
    return metrics.groupBy("module").agg(
        F.count("*").alias("files"), js_round(F.avg("cc")).cast("long").alias("avg_cc"), F.max("cc").alias("max_cc"),
        F.min_by("rel_path", F.struct(-F.col("cc"), F.col("rel_path"))).alias("max_cc_file"), F.sum("lines").alias("lines"),
        js_round(F.avg("in_degree"), 1).alias("avg_in"), F.sum("debt").alias("debt"), F.array_join(hot, ",").alias("hotspots"),
    )


def health(files: Column, lines: Column, debt_sum: Column, risk_weight: Column, violations: Column, dead: Column, coupled: Column, inferred: Column, edges: Column) -> dict[str, tuple[Column, int]]:
    """Penalty of each dimension, capped and rounded to one place, with its cap."""
    kloc = F.greatest(lines / 1000.0, F.lit(1.0))
    share = lambda part, whole: F.when(whole > 0, part * 100.0 / whole).otherwise(0.0)
    raw = {
        "debt": (debt_sum / kloc / 2, 25), "risks": (risk_weight / kloc * 2, 25), "violations": (share(violations, files) * 2, 15),
        "dead": (share(dead, files), 10), "coupling": (share(coupled, files), 15), "inference": (share(inferred, edges) / 10, 10),
    }
    return {k: (js_round(F.least(x, F.lit(float(cap))), 1), cap) for k, (x, cap) in raw.items()}


def health_score(totals: DataFrame) -> DataFrame:
    """One row of totals (files, lines, debt, risk_weight, violations, dead, coupled, inferred, edges) to (dimension, penalty, max), the score and its grade on every row."""
    parts = health(*(F.col(c) for c in ("files", "lines", "debt", "risk_weight", "violations", "dead", "coupled", "inferred", "edges")))
    total = F.greatest(F.lit(0.0), 100 - sum((p for p, _ in parts.values()), F.lit(0.0)))
    scored = totals.select(*(p.alias(k) for k, (p, _) in parts.items()), js_round(total, 1).alias("score"))
    rows = F.inline(F.array(*(F.struct(F.lit(k).alias("dimension"), F.col(k).alias("penalty"), F.lit(cap).alias("max")) for k, (_, cap) in parts.items())))
    return scored.select("score", rows).withColumn("grade", grade(F.col("score")))


def grade(score: Column) -> Column:
    out = F.lit("E")
    for name, least in reversed(GRADES):
        out = F.when(score >= least, name).otherwise(out)
    return out


def health_delta(snapshots: DataFrame, key: str = "project", ts: str = "ts") -> DataFrame:
    """snapshots with the change of score since the project's snapshot before."""
    return snapshots.withColumn("delta", F.col("score") - F.lag("score").over(Window.partitionBy(key).orderBy(ts)))


def churn(commits: DataFrame, now, days: int = 90) -> DataFrame:
    """(file, commits, fixes) of the last days before now. commits: (sha, ts, author, file, is_fix)."""
    recent = commits.where(F.col("ts") >= F.lit(now).cast("timestamp") - F.expr(f"interval {days} days"))
    return recent.where("file is not null").groupBy("file").agg(F.count_distinct("sha").alias("commits"), F.count_distinct(F.when(F.col("is_fix"), F.col("sha"))).alias("fixes"))


#: Fixed value: words of a subject that mark a fix.
FIX_SUBJECT = r"(?i)\b(fix|bug|hotfix|corrige|conserta|patch|defect)\b"


def is_fix(subject: Column) -> Column:
    return subject.rlike(FIX_SUBJECT)


def predict_risk(churned: DataFrame, metrics: DataFrame, top: int = 50) -> DataFrame:
    """(file, score, reasons): 40 % commits, 20 % fixes, 20 % complexity, 20 % coupling, each as a share of the largest. churned: churn(); metrics: (file, cc, coupling)."""
    m = metrics.join(churned, "file", "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in ("commits", "fixes")})
    most = m.agg(*(F.greatest(F.max(c), F.lit(1)).alias(f"m_{c}") for c in ("commits", "fixes", "cc", "coupling")))
    part = lambda c: F.col(c) / F.col(f"m_{c}")
    s = m.crossJoin(F.broadcast(most)).withColumn("score", js_round(100 * (0.4 * part("commits") + 0.2 * part("fixes") + 0.2 * part("cc") + 0.2 * part("coupling"))).cast("long"))
    reason = lambda c, text: F.when(part(c) >= 0.5, F.lit(text))
    reasons = F.array_join(F.array_compact(F.array(reason("commits", "changes often"), reason("fixes", "fixed often"), reason("cc", "complex"), reason("coupling", "coupled"))), ",")
    return s.where("score > 0").select("file", "score", reasons.alias("reasons")).orderBy(F.desc("score"), "file").limit(top)


def authorship(commits: DataFrame, now, days: int = 365) -> DataFrame:
    """(file, author, commits, last_days, share, primary) of the last days before now; of equal counts the least author is primary."""
    at = F.lit(now).cast("timestamp")
    seconds = lambda c: F.unix_micros(c) / F.lit(1e6)  # noqa: E731  # with their fractions: a day is whole to the microsecond
    days_ago = F.floor((seconds(at) - seconds(F.col("ts").cast("timestamp"))) / 86400)
    g = commits.where((F.col("ts") >= at - F.expr(f"interval {days} days")) & F.col("file").isNotNull()).groupBy("file", "author").agg(F.count_distinct("sha").alias("commits"), F.min(days_ago).alias("last_days"))
    per = Window.partitionBy("file")
    return g.withColumn("share", F.col("commits") / F.sum("commits").over(per)).withColumn("primary", F.row_number().over(per.orderBy(F.desc("commits"), "author")) == 1)


def bus_factor(counts: DataFrame, key: str) -> DataFrame:
    """(key, bus_factor): the fewest authors who together have at least half of the commits. counts: (key, author, commits)."""
    order = Window.partitionBy(key).orderBy(F.desc("commits"), "author")
    upto = counts.withColumn("n", F.row_number().over(order)).withColumn("sum", F.sum("commits").over(order.rowsBetween(Window.unboundedPreceding, 0))).withColumn("total", F.sum("commits").over(Window.partitionBy(key)))
    return upto.where("2 * sum >= total").groupBy(key).agg(F.min("n").alias("bus_factor"))


def ownership(author_counts: DataFrame, metrics: DataFrame) -> DataFrame:
    """Per module: primary owner, pct, authors, bus_factor, hours to get started, difficulty. author_counts: (file, author, commits); metrics: (file, module, cc)."""
    by = author_counts.join(metrics.select("file", "module"), "file").groupBy("module", "author").agg(F.sum("commits").alias("commits"))
    top = by.groupBy("module").agg(F.min_by("author", F.struct(-F.col("commits"), F.col("author"))).alias("owner"), F.max("commits").alias("most"), F.sum("commits").alias("total"), F.count("*").alias("authors"))
    size = metrics.groupBy("module").agg(F.count("*").alias("files"), F.avg("cc").alias("avg_cc"))
    m = top.join(bus_factor(by, "module"), "module").join(size, "module")
    hours = js_round((F.col("files") * 0.3 + F.col("avg_cc") * 1.5) * F.when(F.col("bus_factor") <= 1, 1.5).otherwise(1.0)).cast("long")
    m = m.withColumn("hours", hours).withColumn("pct", js_round(100 * F.col("most") / F.col("total")).cast("long"))
    return m.withColumn("difficulty", F.when(F.col("hours") > 40, "high").when(F.col("hours") > 16, "medium").otherwise("low")).select("module", "owner", "pct", "authors", "bus_factor", "hours", "difficulty")


def start_here(owned: DataFrame, top: int = 5) -> DataFrame:
    return owned.where("difficulty = 'low'").orderBy("hours", "module").limit(top)


def knowledge_risk(author_counts: DataFrame, metrics: DataFrame, least: int = 8, top: int = 30) -> DataFrame:
    """(file, author, weight): files of one author whose in-degree + debt is at least ``least``. metrics: (file, in_degree, debt)."""
    alone = author_counts.groupBy("file").agg(F.count_distinct("author").alias("n"), F.min("author").alias("author")).where("n = 1")
    return alone.join(metrics.select("file", (F.col("in_degree") + F.col("debt")).alias("weight")), "file").where(F.col("weight") >= least).orderBy(F.desc("weight"), "file").limit(top).select("file", "author", "weight")


def reviewers(owners: DataFrame, changed: DataFrame) -> DataFrame:
    """(author, n, files): changed files (file) by their owner, most first. owners: (file, author)."""
    return changed.select("file").distinct().join(owners, "file").groupBy("author").agg(F.count("*").alias("n"), F.array_join(F.sort_array(F.collect_list("file")), ",").alias("files")).orderBy(F.desc("n"), "author")


def roi(module_debt: DataFrame, hours_per_point: float = HOURS_PER_POINT, rate: float = HOURLY_RATE, top: int = 20) -> DataFrame:
    """(module, debt, hours, days, cost) of modules (module, debt), dearest first."""
    hours = F.col("debt") * F.lit(float(hours_per_point))
    return module_debt.where("debt > 0").select("module", "debt", js_round(hours, 1).alias("hours"), js_round(hours / 8, 1).alias("days"), js_round(hours * F.lit(float(rate)), 2).alias("cost")).orderBy(F.desc("cost"), "module").limit(top)


def roi_total(module_debt: DataFrame, reviews: DataFrame, hours_per_point: float = HOURS_PER_POINT, rate: float = HOURLY_RATE, minutes: float = MINUTES_PER_IMPACT) -> DataFrame:
    """(hours, cost, days, saved_hours, saved_cost, net): all debt against what impact reviews (impacted) saved."""
    d = module_debt.agg((F.coalesce(F.sum("debt"), F.lit(0)) * float(hours_per_point)).alias("hours"))
    s = reviews.agg((F.coalesce(F.sum("impacted"), F.lit(0)) * float(minutes) / 60).alias("saved_hours"))
    both = d.crossJoin(s)  # one row each
    return both.select("hours", (F.col("hours") * rate).alias("cost"), (F.col("hours") / 8).alias("days"), "saved_hours", (F.col("saved_hours") * rate).alias("saved_cost"), ((F.col("saved_hours") - F.col("hours")) * rate).alias("net"))


def within_budget(rows: DataFrame, content: str, budget: int, order: list[str], group: str | None = None) -> DataFrame:
    """rows with tokens and cum_tokens, in order, as long as the running sum fits the budget, per group or over all.

    Over all, rows are dealt to ranges of the order first. The tokens before each
    range come from one sum per range, so only the range in which the budget
    ends is ever counted row by row, and rows without tokens cost nothing.
    """
    t = rows.withColumn("tokens", tokens_of(F.col(content)))
    if group:
        window = Window.partitionBy(group).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
        return t.withColumn("cum_tokens", F.sum("tokens").over(window)).where(F.col("cum_tokens") <= budget)
    parts = max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    ranged = stored(t.repartitionByRange(parts, *order).withColumn("__part", F.spark_partition_id()), "ranges")
    sums = ranged.groupBy("__part").agg(F.sum("tokens").alias("__sum"))  # a row for each range
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    begins = sums.select("__part", F.coalesce(F.sum("__sum").over(before), F.lit(0)).alias("__before")).where(F.col("__before") <= budget)
    near = ranged.join(F.broadcast(begins), "__part")  # at most `parts` rows
    within = Window.partitionBy("__part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    counted = near.withColumn("cum_tokens", F.col("__before") + F.sum("tokens").over(within))
    return counted.where(F.col("cum_tokens") <= budget).drop("__part", "__before")


def usage(log: DataFrame) -> DataFrame:
    """(tool, calls, tokens) of a call log (tool, tokens)."""
    return log.groupBy("tool").agg(F.count("*").alias("calls"), F.sum("tokens").alias("tokens"))


def risk_level(score: Column, critical_open: Column, arch_errors: Column) -> Column:
    return F.when((critical_open > 0) | (score < 40), "CRITICAL").when((arch_errors > 0) | (score < 60), "HIGH").when(score < 80, "MEDIUM").otherwise("LOW")


def top_metrics(metrics: DataFrame, by: str, top: int = 20) -> DataFrame:
    return metrics.orderBy(F.desc(by), "rel_path").limit(top)
