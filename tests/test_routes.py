"""Routes by trie against a comparison of all pairs."""

import random

from codestrata.operators.build import match_routes
from codestrata.operators.routes import route_trie


def parameter(s):
    return len(s) > 1 and (s[0] == "{" and s[-1] == "}" or s[0] == ":")


def plainly(calls, routes):
    """The first route by (ord, id) for each call id; paths here have no prefix, scheme or query."""
    out = {}
    for call, url in calls:
        c = url.lower().strip("/").split("/") if url is not None else None
        for ident, path, order in routes:
            if c is None or path is None or order is None:
                continue
            r = path.lower().strip("/").split("/")
            if len(c) == len(r) and all(a == b or parameter(a) or parameter(b) for a, b in zip(c, r)):
                out[call] = min(out.get(call, (order, ident)), (order, ident))
    return {k: v[1] for k, v in out.items()}


def frames(spark, calls, routes):
    return spark.createDataFrame(calls, "call_id int, url string"), spark.createDataFrame(routes, "endpoint_id int, path string, ord int")


def matched(spark, calls, routes):
    rows = match_routes(*frames(spark, calls, routes)).collect()
    assert len(rows) == len({r.call_id for r in rows})
    return {r.call_id: r.endpoint_id for r in rows}


def test_random_routes(spark):
    rng = random.Random(5)
    word = lambda: rng.choice(["a", "b", "C", "c", "{x}", ":y", "{Other}", ""])
    path = lambda: "/" + "/".join(word() or "d" for _ in range(rng.randrange(1, 5)))
    routes = [(i, path(), rng.randrange(9)) for i in range(40)] + [(90, None, 1), (91, "/a/b", None), (92, "/", 3)]
    calls = [(i, path()) for i in range(200)] + [(500, None), (501, "/"), (502, "/a/b/c/a/b/c/a"), (7, "/a"), (503, "/{z}/{z}")]
    want = plainly(calls, routes)
    assert matched(spark, calls, routes) == want and len(want) > 50


def test_prefix_query_and_host_are_cut(spark):
    routes = [(1, "/api/v2/users/{id}", 1), (2, "users/{id}/", 2)]
    assert matched(spark, [(1, "https://host/api/users/7?x=/y#z"), (2, "/Users/:id/"), (3, "/users")], routes) == {1: 1, 2: 1}


def test_empty_tables(spark):
    assert matched(spark, [], [(1, "/a", 1)]) == {} and matched(spark, [(1, "/a")], []) == {}


def test_a_common_first_segment_leads_to_matches_only(spark):
    """600 routes below one segment: a call meets the steps of its own route, not those of the others."""
    routes = [(i, f"/shop/item{i}/{{id}}", i) for i in range(600)]
    calls = [(i, f"/shop/item{i}/5") for i in range(600)]
    assert matched(spark, calls, routes) == {i: i for i in range(600)}
    steps, _ = route_trie(frames(spark, calls, routes)[1])
    assert steps.count() == 2 * (1 + 600 + 600)
    plain = steps.where("key != '\0any'").groupBy("state", "key").count()
    assert plain.where("count > 1").isEmpty()
