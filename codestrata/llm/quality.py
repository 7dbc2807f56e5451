"""Quality rules as a bitmask ledger (operator 5), in DataFrame functions only.

Every rule is evaluated once per document. The ledger keeps the measurements
and one long whose bit k says that rule k failed. A policy is a mask of rules,
kept under a version, so a change of policy, a comparison of two policies and
the ablation of each rule are bit operations over the ledger and never read a
text again. Nothing is shuffled to build it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rules in bit order: what makes a document fail, in the ledger's measurements.
RULES: dict[str, str] = {
    "few_words": "n_words < 50",
    "repeated_words": "100 * n_repeat_words > 50 * n_words",
    "symbols": "20 * n_symbols > word_chars",
    "repeated_lines": "n_lines >= 4 and 100 * n_dup_lines > 60 * n_lines",
    "exclamations": "2 * n_bangs > n_words",
    "long_words": "word_chars > 40 * n_words",
    "short_words": "word_chars < 2 * n_words",
}

#: Versioned policies: the rules whose failure rejects a document.
POLICIES: dict[str, tuple[str, ...]] = {
    "base": ("few_words", "repeated_words"),
    "v1": ("few_words", "repeated_words", "symbols", "repeated_lines", "exclamations", "long_words"),
}

_BLANKS = "\t\n\x0b\x0c\r"
_SYMBOLS = "#*$%&|<>"


def mask(rules: tuple[str, ...]) -> int:
    names = list(RULES)
    return sum(1 << names.index(r) for r in rules)


def _without(text: Column, chars: str, put: str = "") -> Column:
    for c in chars:
        text = F.replace(text, F.lit(c), F.lit(put))
    return text


def measure(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with the measurements of text_col: n_words, word_chars, n_symbols,
    n_lines, n_dup_lines, n_bangs, n_repeat_words. A null text has no words.

    A word is a run outside ``\\x20\\x09-\\x0D``. n_repeat_words counts the words
    inside 3-word windows found twice or more in the text: windows are hashed,
    sorted with their places, and kept where a neighbour is equal; each kept
    place then covers min(3, distance to the next) words.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    spaced = _without(text, _BLANKS, " ")
    a = docs.withColumn("__words", F.filter(F.split(spaced, " ", -1), lambda w: w != ""))
    a = a.withColumn("__lines", F.filter(F.split(text, "\n", -1), lambda x: F.trim(x, F.lit(" " + _BLANKS)) != ""))
    a = a.withColumn("n_words", F.size("__words").cast("long")).withColumn("word_chars", F.length(F.replace(spaced, F.lit(" "), F.lit(""))).cast("long"))
    a = a.withColumn("n_symbols", (F.length(text) - F.length(_without(text, _SYMBOLS))).cast("long"))
    a = a.withColumn("n_bangs", (F.length(text) - F.length(_without(text, "!"))).cast("long"))
    a = a.withColumn("n_lines", F.size("__lines").cast("long")).withColumn("n_dup_lines", (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long"))
    a = a.withColumn("__hashes", F.expr("slice(transform(__words, (w, i) -> xxhash64(w, get(__words, i + 1), get(__words, i + 2))), 1, greatest(size(__words) - 2, 0))"))
    a = a.withColumn("__sorted", F.expr("sort_array(transform(__hashes, (h, i) -> struct(h as h, i as i)))"))
    a = a.withColumn("__places", F.expr("sort_array(transform(filter(__sorted, (x, k) -> coalesce(x.h = get(__sorted, k - 1).h, false) or coalesce(x.h = get(__sorted, k + 1).h, false)), x -> x.i))"))
    covered = F.expr("aggregate(transform(__places, (p, k) -> least(3, coalesce(get(__places, k + 1) - p, 3))), 0L, (s, x) -> s + x)")
    return a.withColumn("n_repeat_words", covered).drop("__words", "__lines", "__hashes", "__sorted", "__places")


def ledger(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: bool = False) -> DataFrame:
    """One row per document: its id as doc_id, measurements, and failures, the bits of the rules that it fails.

    With carry, the document's own row is there too, as the struct ``row``.
    """
    own = [F.struct(*(docs[c] for c in docs.columns)).alias("row")] if carry else []
    out = measure(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("__text"), *own), "__text").drop("__text")
    bits = sum((F.when(F.expr(rule), F.lit(1 << k)).otherwise(0) for k, rule in enumerate(RULES.values())), F.lit(0))
    # a generated row keeps later filters above the measuring: pushed below, they would repeat it inside their conditions
    measured = [c for c in out.columns if c not in ("doc_id", "row")]
    return out.select("doc_id", *["row"] * carry, F.inline(F.array(F.struct(*measured, bits.cast("long").alias("failures")))))


def judge(book: DataFrame, policy: str = "v1") -> DataFrame:
    """The ledger with base_failed and kept under a policy.

    Null or empty texts have no words and fail few_words; texts of any length
    are measured whole; repeated rows and null ids are judged each by itself;
    other columns are ignored; no rows give no rows.
    """
    failed = lambda name: F.col("failures").bitwiseAND(F.lit(mask(POLICIES[name]) | mask(POLICIES["base"]))) != 0
    base = F.col("failures").bitwiseAND(F.lit(mask(POLICIES["base"]))) != 0
    return book.withColumn("base_failed", base).withColumn("kept", ~failed(policy))


def ablations(book: DataFrame, policy: str = "v1") -> DataFrame:
    """For each rule of a policy: failed (documents that fail it), alone (that only it rejects),
    kept_without (documents kept if it were dropped). One pass over the ledger: equal bit
    patterns are counted first, so rules expand at most 2**rules rows."""
    whole = mask(POLICIES[policy])
    patterns = book.groupBy(F.col("failures").bitwiseAND(F.lit(whole)).alias("bits")).agg(F.count("*").alias("n"))
    rules = F.explode(F.array(*(F.struct(F.lit(r).alias("rule"), F.lit(mask((r,))).cast("long").alias("bit")) for r in POLICIES[policy])))
    each = patterns.select("bits", "n", rules.alias("r")).select("bits", "n", "r.rule", "r.bit")
    hit, rest = F.col("bits").bitwiseAND(F.col("bit")) != 0, F.col("bits").bitwiseAND(F.lit(whole).bitwiseXOR(F.col("bit"))) == 0
    add = lambda cond: F.sum(F.when(cond, F.col("n")).otherwise(0))
    return each.groupBy("rule").agg(add(hit).alias("failed"), add(hit & rest).alias("alone"), add(rest).alias("kept_without"))


def compare(book: DataFrame, old: str, new: str) -> DataFrame:
    """How many documents each pair of verdicts of two policies holds: kept_old, kept_new, n."""
    kept = lambda p: F.col("failures").bitwiseAND(F.lit(mask(POLICIES[p]))) == 0
    return book.groupBy(kept(old).alias("kept_old"), kept(new).alias("kept_new")).agg(F.count("*").alias("n"))
