"""DuckDB SQL of the same results, for the operators that SQL can express over whole tables."""

from __future__ import annotations

_WORDS = r"regexp_extract_all({}, '[^\x20\x09-\x0D]+')"
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

def _host(url: str) -> str:
    return f"translate(regexp_extract({url}, '^[\\s\\S]*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _path(url: str) -> str:
    return f"regexp_extract({url}, '^[\\s\\S]*?://[^/?#]*([^?#]*)', 1)"


#: Canonical links and refreshes with absolute, scheme-relative, rooted and relative targets tie pages to one another.
URLS = f"""WITH RECURSIVE rules AS (SELECT * FROM (VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')) v(rh, rp, said)),
  host_path AS (SELECT page_id, html, {_host("coalesce(url, '')")} AS host, {_path("coalesce(url, '')")} AS path FROM pages),
  tags AS (SELECT host, path, regexp_extract(unnest(regexp_extract_all(html, '(?is)<link\\b[^>]*\\brel\\s*=\\s*["'']?canonical\\b[^>]*>')), '(?is)\\bhref\\s*=\\s*["'']?\\s*([^"''\\s>]+)', 1) AS t FROM host_path WHERE host <> ''
    UNION ALL SELECT host, path, regexp_extract(unnest(regexp_extract_all(html, '(?is)<meta\\b[^>]*\\bhttp-equiv\\s*=\\s*["'']?refresh\\b[^>]*>')), '(?is)\\burl\\s*=\\s*["'']?\\s*([^"''\\s>]+)', 1) FROM host_path WHERE host <> ''),
  absolute AS (SELECT *, CASE WHEN contains(t, '://') THEN t WHEN starts_with(t, '//') THEN 'x:' || t END AS u, regexp_extract(t, '^[^?#]*') AS plain, regexp_extract(path, '^[\\s\\S]*/') AS folder FROM tags WHERE t <> ''),
  linked AS (SELECT host || path AS a, CASE WHEN u IS NOT NULL THEN {_host("u")} ELSE host END AS b_host,
      CASE WHEN u IS NOT NULL THEN {_path("u")} WHEN starts_with(t, '/') THEN plain WHEN plain = '' THEN path ELSE CASE folder WHEN '' THEN '/' ELSE folder END || plain END AS b_path FROM absolute),
  ends AS (SELECT a, b_host || b_path AS b FROM linked WHERE b_host <> '' UNION SELECT b_host || b_path, a FROM linked WHERE b_host <> ''),
  fits AS (SELECT n, arg_max(said, length(rh || rp)) AS said FROM (SELECT a AS n, regexp_extract(a, '^[^/]*') AS h, regexp_extract(a, '^[^/]*([\\s\\S]*)$', 1) AS p FROM ends) x JOIN rules ON (h = rh OR ends_with(h, '.' || rh)) AND starts_with(p, rp) GROUP BY n),
  spread(n) AS (SELECT n FROM fits WHERE said = 'block' UNION SELECT b FROM ends JOIN spread ON a = n),
  best AS (SELECT page_id, host, path, arg_max(rh || rp, length(rh || rp)) AS rule, arg_max(said, length(rh || rp)) AS said
    FROM host_path LEFT JOIN rules ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp) GROUP BY page_id, host, path)
  SELECT page_id, host, path, rule, coalesce(said, CASE WHEN host || path IN (SELECT n FROM spread) THEN 'block' ELSE 'allow' END) AS verdict FROM best JOIN (SELECT page_id FROM pages) p USING (page_id)"""

QUALITY = f"""WITH w AS (SELECT doc_id, coalesce(text, '') AS t, {_WORDS.format("coalesce(text, '')")} AS w FROM documents),
  places AS (SELECT doc_id, unnest(range(1, greatest(len(w) - 1, 1))) AS p, w FROM w WHERE len(w) >= 3),
  grams AS (SELECT doc_id, p, [w[p], w[p + 1], w[p + 2]] AS g FROM places),
  twice AS (SELECT doc_id, g FROM grams GROUP BY 1, 2 HAVING count(*) > 1),
  covered AS (SELECT doc_id, count(*) AS n FROM (SELECT DISTINCT doc_id, unnest([p, p + 1, p + 2]) AS p FROM grams SEMI JOIN twice USING (doc_id, g)) x GROUP BY 1),
  lines AS (SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT l) AS n_dup FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS l FROM w) x WHERE regexp_matches(l, '[^\\x20\\x09-\\x0D]') GROUP BY 1),
  m AS (SELECT w.doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars, (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
    (length(t) - length(replace(t, '!', '')))::BIGINT AS n_bangs, coalesce(n_lines, 0) AS n_lines, coalesce(n_dup, 0) AS n_dup_lines, coalesce(n, 0) AS n_repeat_words FROM w LEFT JOIN lines USING (doc_id) LEFT JOIN covered USING (doc_id)),
  f AS (SELECT *, (n_words < 50)::BIGINT + 2 * (100 * n_repeat_words > 50 * n_words)::BIGINT + 4 * (20 * n_symbols > word_chars)::BIGINT + 8 * (n_lines >= 4 AND 100 * n_dup_lines > 60 * n_lines)::BIGINT
    + 16 * (2 * n_bangs > n_words)::BIGINT + 32 * (word_chars > 40 * n_words)::BIGINT + 64 * (word_chars < 2 * n_words)::BIGINT AS failures FROM m)
  SELECT *, failures & 3 <> 0 AS base_failed, failures & 63 = 0 AS kept FROM f"""

NEAR = f"""WITH RECURSIVE w AS (SELECT doc_id, {_WORDS.format(_LOWER)} AS w FROM documents),
  s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 4 THEN [array_to_string(w[i:i + 3], ' ') FOR i IN range(1, len(w) - 2)] WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g FROM w),
  n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
  common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
  links AS (SELECT a, b FROM common JOIN n x ON a = x.doc_id JOIN n y ON b = y.doc_id WHERE 100 * c >= 80 * (x.n + y.n - c)),
  reach(a, b) AS (SELECT doc_id, doc_id FROM w UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a)
  SELECT r.a AS doc_id, coalesce(max(n.n), 0) AS n_shingles, min(b) AS component_id, min(b) = r.a AS kept FROM reach r LEFT JOIN n ON n.doc_id = r.a GROUP BY r.a"""

REPEATS = f"""WITH w AS (SELECT doc_id, {_WORDS.format("coalesce(text, '')")} AS w FROM documents),
  win AS (SELECT doc_id, p, md5(array_to_string(w[p:p + 49], ' ')) AS k FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS p FROM w WHERE len(w) >= 50) x),
  first AS (SELECT k, min(doc_id) AS m FROM win GROUP BY k HAVING min(doc_id) < max(doc_id)),
  gone AS (SELECT DISTINCT doc_id, unnest(range(p, p + 50)) AS i, true AS hit FROM win JOIN first USING (k) WHERE m < doc_id),
  words AS (SELECT doc_id, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS i FROM w),
  cut AS (SELECT doc_id, count(hit) AS n_removed, string_agg(x, ' ' ORDER BY i) FILTER (hit IS NULL) AS kept FROM words LEFT JOIN gone USING (doc_id, i) GROUP BY doc_id)
  SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM w LEFT JOIN cut USING (doc_id)"""



def _yinyang(k: int = 8, rounds: int = 10) -> str:
    """Plain k-means: each round assigns all vectors by all distances (a<r>) and takes new centroids (c<r + 1>)."""
    out = f"""WITH kept AS MATERIALIZED (SELECT vec_id, row_number() OVER () AS row, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS v FROM embeddings
    WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64),
  c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('3:' || vec_id), v) - 1 AS c, v AS w FROM kept WHERE vec_id IS NOT NULL QUALIFY c < {k})"""
    for r in range(rounds + 1):
        out += f""",
  a{r} AS MATERIALIZED (SELECT row, any_value(vec_id) AS vec_id, any_value(v) AS v, min((d, c)) AS best FROM (SELECT row, vec_id, v, c, list_sum(list_transform(list_zip(v, w), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d FROM kept, c{r}) x GROUP BY row)"""
        if r < rounds:
            out += f""",
  c{r + 1} AS MATERIALIZED (SELECT c, coalesce(n, w) AS w FROM c{r} LEFT JOIN (SELECT c, list((s - ((s % m) + m) % m) // m ORDER BY i) AS n FROM
    (SELECT best[2] AS c, i, sum(v[i])::BIGINT AS s, count(*) AS m FROM a{r}, (SELECT unnest(range(1, 65)) AS i) y GROUP BY 1, 2) z GROUP BY c) u USING (c))"""
    return out + f"""
  SELECT vec_id, c::INT AS cluster, best[1] AS distance, sum(best[1]) OVER (PARTITION BY c)::BIGINT AS cluster_inertia, sum(best[1]) OVER ()::BIGINT AS inertia, sha256(array_to_string(w, ',')) AS centroid_sha256
  FROM a{rounds} JOIN c{rounds} ON c = best[2]"""


_LETTERS = "length(regexp_replace(t, '[^\\p{L}]+', '', 'g'))"
_SEEN = "length(regexp_replace(t, '[\\x20\\x09-\\x0D]+', '', 'g'))"
#: Targets by the order of most / weight: a source is held at its most as long as the level of the rest reaches it.
MIXTURE = f"""WITH t AS (SELECT doc_id, source, coalesce(text, '') AS t FROM documents),
  d AS (SELECT doc_id, source, len({_WORDS.format("t")})::BIGINT AS size, -ln((('0x' || substr(md5('12:' || coalesce(doc_id::VARCHAR, ' ')), 1, 13))::BIGINT + 0.5) / 4503599627370496) / greatest(0.05, coalesce(({_LETTERS} / nullif({_SEEN}, 0)) ** 4, 0.05)) AS key FROM t),
  s AS (SELECT source, sum(size)::BIGINT AS source_size, 2.0::DOUBLE * sum(size) AS most, [3.0, 1.0, 2.0][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1]::DOUBLE AS weight FROM d GROUP BY source),
  l AS (SELECT *, (1.5 * sum(source_size) OVER () - coalesce(sum(most) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(weight) OVER (w ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM s WINDOW w AS (ORDER BY most / weight, source NULLS LAST)),
  g AS (SELECT source, source_size, CASE WHEN most < weight * level THEN most ELSE least(most, weight * (SELECT level FROM l WHERE most >= weight * level ORDER BY most / weight, source NULLS LAST LIMIT 1)) END AS target FROM l),
  e AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS epochs FROM g),
  p AS (SELECT d.*, source_size, target, epochs, round(target - epochs * source_size)::BIGINT AS left_, sum(size) OVER (PARTITION BY d.source ORDER BY key, doc_id NULLS FIRST, size RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS through, count(*) OVER (PARTITION BY d.source, key, doc_id, size) AS n FROM d JOIN e ON d.source IS NOT DISTINCT FROM e.source)
  SELECT doc_id, size, source_size, target, (epochs * size + CASE WHEN size = 0 THEN 0 WHEN through <= left_ THEN size WHEN through - n * size >= left_ THEN 0 ELSE round((left_ - (through - n * size)) / n) END)::BIGINT AS taken, source, epochs FROM p"""

ORACLES = {"op11_yinyang": _yinyang(), "op12_mixture": MIXTURE, "op4_url_filter": URLS, "op5_quality_rules": QUALITY, "op8_near_dedup": NEAR, "op9_substring_dedup": REPEATS}
