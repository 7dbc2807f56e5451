"""Route joins by a trie kept as a relation: one equi-join for each segment.

A state is a prefix of a route of known length; a step leads from a state over a
segment to the next one. A plain segment of a call follows the step of its own
name and the one of a parameter, a parameter of a call follows every step. So a
call meets at most two steps at a state, or those that match it, however many
routes begin alike.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import is_parameter, segments
from ..sources.durable import stored

#: Marks that no segment equals: a parameter of a route, and any step.
PARAMETER, ANY = "\0parameter", "\0any"
FEW_STEPS = 100_000


def _parts(path: Column) -> Column:
    """Segments, with all parameters as one mark: routes that differ in names of parameters only are the same."""
    return F.transform(segments(path), lambda s: F.when(is_parameter(s), F.lit(PARAMETER)).otherwise(s))


def _state(parts: str, depth: Column) -> Column:
    """The first ``depth`` segments behind the length of the route; a segment has no slash, so states don't coincide."""
    return F.concat_ws("/", F.size(parts).cast("string"), F.slice(parts, F.lit(1), depth))


def route_trie(endpoints: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(state, key, next) steps and (state, ord, endpoint_id) ends: of equal routes the first endpoint by ord, ties to the smaller id.

    Every step is there twice, under its segment and under ANY. endpoints:
    (endpoint_id, path, ord); those with a null path or ord have no route.
    """
    routes = stored(endpoints.select("endpoint_id", "ord", _parts(F.col("path")).alias("parts")).where("parts is not null and ord is not null"), "routes")
    first = F.min(F.struct("ord", "endpoint_id")).alias("e")
    ends = routes.groupBy(_state("parts", F.size("parts")).alias("state")).agg(first).select("state", "e.ord", "e.endpoint_id")
    places = routes.select("parts").distinct().select("parts", F.posexplode("parts").alias("d", "segment"))
    steps = places.select(_state("parts", F.col("d")).alias("state"), "segment", _state("parts", F.col("d") + 1).alias("next")).distinct()
    return steps.select("state", F.explode(F.array("segment", F.lit(ANY))).alias("key"), "next"), ends


def match_routes(calls: DataFrame, endpoints: DataFrame) -> DataFrame:
    """calls (call_id, url) with the first endpoint (endpoint_id, path, by ord) of equal route.

    Equal are segments of the same text, and a parameter on either side with
    anything, in routes of the same length. A url that many calls have takes its
    steps once. Calls with a null url, or longer than any route, match nothing;
    of calls that share an id the first endpoint of any is given.
    """
    steps, ends = route_trie(endpoints)
    steps, ends = stored(steps, "steps"), stored(ends, "ends")
    few = steps.limit(FEW_STEPS + 1).count() <= FEW_STEPS
    steps = F.broadcast(steps) if few else steps
    asked = stored(calls.select("call_id", _parts(F.col("url")).alias("parts")).where("parts is not null"), "calls")
    at = asked.select("parts").distinct().withColumn("state", F.size("parts").cast("string"))
    found, depth = [], 0
    while True:
        segment = F.element_at("parts", depth + 1)
        key = F.explode(F.when(segment == PARAMETER, F.array(F.lit(ANY))).otherwise(F.array(segment, F.lit(PARAMETER))))
        depth += 1
        at = stored(at.withColumn("key", key).join(steps, ["state", "key"]).select("parts", F.col("next").alias("state")), "level")
        if at.isEmpty():
            break
        found.append(at.where(F.size("parts") == depth))
        at = at.where(F.size("parts") > depth)
    if not found:
        return asked.join(ends, F.lit(False)).select("call_id", "endpoint_id")
    best = F.min(F.struct("ord", "endpoint_id")).alias("e")
    matched = reduce(DataFrame.unionByName, found).join(ends, "state").groupBy("parts").agg(best)
    return asked.join(stored(matched, "matched"), "parts").groupBy("call_id").agg(F.min("e").alias("e")).select("call_id", "e.endpoint_id")
