"""Search: term extraction, BM25 over postings, an inverted-index fallback, and vectors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import camel_words, js_round

K1, B = 1.2, 0.75
MAX_TERMS = 400

#: Words that say nothing about a file, English, Portuguese and of code; and those of SQL.
STOPWORDS = (
    "the and for are was this that with from have has had not but you all can her his one will more use get set let var new null true false else then void type enum class"
    " interface extends implements import export return public private protected static final const que nao com por para uma dos das nos nas seu sua num ser ter tem foi como mais mas"
    " sem quando muito bem entre depois antes onde tambem isso isto aqui"
).split()
SQL_WORDS = (
    "select insert update delete where join inner outer left right group order having create table index primary foreign key values commit rollback begin declare procedure"
    " function trigger cursor fetch open close"
).split()


def terms(content: Column, path: Column | None = None, most: int = MAX_TERMS) -> Column:
    """Distinct lower-case words of at least three letters in order, split at case changes, without stopwords."""
    words = camel_words(F.concat_ws(" ", path, content) if path is not None else content)
    return F.slice(F.array_except(F.array_distinct(words), F.array(*(F.lit(w) for w in STOPWORDS + SQL_WORDS))), 1, most)


def snippet(content: Column, lines: int = 3, width: int = 120) -> Column:
    """The first lines that say something, trimmed, at most width characters each, joined by a bar: no comments, imports or packages."""
    good = F.filter(F.transform(F.split(content, "\n", -1), lambda x: F.trim(x)), lambda x: (x != "") & ~x.rlike(r"^(//|\*|#)|^import\s|^from\s|^require\s*\(|^package\s"))
    return F.array_join(F.transform(F.slice(good, 1, lines), lambda x: F.substring(x, 1, width)), " | ")


def query_tokens(query: str) -> list[str]:
    """Words of at least three letters, their camel-case pieces and the whole words, distinct, lower-case."""
    import re

    out: list[str] = []
    for word in re.findall(r"[A-Za-z]{3,}", query):
        out += [p.lower() for p in re.findall(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+", word) if len(p) >= 3] + [word.lower()]
    return list(dict.fromkeys(out))


def postings(docs: DataFrame, key: str, content: str) -> DataFrame:
    """(key, term, tf, size) of lower-case words of three or more letters."""
    words = F.regexp_extract_all(F.lower(F.col(content)), F.lit("[a-z]{3,}"), 0)
    each = docs.select(F.col(key), words.alias("w")).select(key, F.size("w").alias("size"), F.explode("w").alias("term"))
    return each.groupBy(key, "term").agg(F.count("*").alias("tf"), F.first("size").alias("size"))


def bm25(docs: DataFrame, key: str, content: str, query: str, top: int = 10, k1: float = K1, b: float = B) -> DataFrame:
    """(key, score): BM25 of words that begin with any token of the query, each such word a term of its own.

    Texts are reduced to matching words and lengths on the scan side, so only
    those are shuffled; idf = ln(1 + (N - df + 0.5) / (df + 0.5)).
    """
    tokens = query_tokens(query)
    words = F.regexp_extract_all(F.lower(F.col(content)), F.lit("[a-z]{3,}"), 0)
    sized = docs.select(F.col(key).alias("key"), words.alias("w")).withColumn("size", F.size("w"))
    totals = sized.agg(F.count("*").alias("N"), F.avg("size").alias("avg"))
    hit = F.filter("w", lambda x: F.exists(F.array(*(F.lit(t) for t in tokens)), lambda t: x.startswith(t)))
    tf = sized.select("key", "size", F.explode(hit).alias("term")).groupBy("key", "size", "term").agg(F.count("*").alias("tf"))
    df = tf.groupBy("term").agg(F.count("*").alias("df"))
    scored = tf.join(df, "term").crossJoin(F.broadcast(totals))  # one row
    idf = F.log(1 + (F.col("N") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weight = idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("size") / F.col("avg")))
    out = scored.groupBy("key").agg(js_round(F.sum(weight), 1).alias("score"))
    return out.orderBy(F.desc("score"), "key").limit(top).withColumnRenamed("key", key)


def inverted(docs: DataFrame, key: str, term_list: str, query: str, top: int = 10) -> DataFrame:
    """(key, score): 2 for each term equal to a token, 1 for each that begins with it."""
    tokens = query_tokens(query)
    points = lambda t: sum((F.when(t == q, 2).when(t.startswith(q), 1).otherwise(0) for q in tokens), F.lit(0))
    score = F.aggregate(F.transform(F.col(term_list), points), F.lit(0), lambda a, x: a + x)
    return docs.select(key, score.cast("long").alias("score")).where("score > 0").orderBy(F.desc("score"), key).limit(top)


def cosine(a: Column, b: Column) -> Column:
    """0 if either vector has no length."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm > 0, dot(a, b) / norm).otherwise(0.0)


def vector_search(vectors: DataFrame, key: str, vector: str, query: list[float], top: int = 10) -> DataFrame:
    """(key, score): the most similar vectors by cosine, to three places."""
    q = F.array(*(F.lit(float(x)) for x in query))
    return vectors.select(key, js_round(cosine(F.col(vector), q), 3).alias("score")).orderBy(F.desc("score"), key).limit(top)
