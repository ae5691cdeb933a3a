"""DuckDB SQL for the queries of this folder, written from their contracts."""

from __future__ import annotations

from .caps import Caps
from .codes import Codes
from .quality import RULES, QualityModel
from .urls import RULES as RULES_URL
from .urls import LinkTrust

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"


def quality() -> str:
    model = QualityModel()
    names = [r.name for r in RULES]
    keep = lambda x: f"least(greatest({x}, {model.low}), {model.high})"
    posterior = "1 / (1 + exp(-(ln(prior / (1 - prior))" + "".join(
        f" + CASE WHEN {n} THEN ln(g_{n} / b_{n}) ELSE ln((1 - g_{n}) / (1 - b_{n})) END" for n in names) + ")))"
    start = ", ".join(
        f"{g}::DOUBLE AS g_{r.name}, {b}::DOUBLE AS b_{r.name}" for r in RULES
        for g, b in [(model.seldom, model.often) if r.says == "bad" else (model.praise_good, model.praise_bad)])
    rounds = [f"s0 AS MATERIALIZED (SELECT {model.prior}::DOUBLE AS prior, {start})"]
    for i in range(model.rounds):
        sums = ", ".join(
            f"{keep(f'(coalesce(sum({w}) FILTER ({n}), 0) + 1) / (sum({w}) + 2)')} AS {side}_{n}"
            for n in names for side, w in (("g", "n * q"), ("b", "n * (1 - q)")))
        rounds.append(f"""s{i + 1} AS MATERIALIZED (SELECT {keep('(sum(n * q) + 1) / (sum(n) + 2)')} AS prior, {sums}
            FROM (SELECT *, {posterior} AS q FROM patterns, s{i}))""")
    return rf"""
WITH base AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t, {_WORDS} AS w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM documents),
spelled AS (SELECT r, i, x AS a, lead(x, 1) OVER o AS b, lead(x, 2) OVER o AS c
    FROM (SELECT r, unnest(w) AS x, generate_subscripts(w, 1) AS i FROM base) WINDOW o AS (PARTITION BY r ORDER BY i)),
windows AS (SELECT r, i, count(*) OVER (PARTITION BY r, a, b, c) AS times FROM spelled WHERE c IS NOT NULL),
repeats AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest([i, i + 1, i + 2]) AS p FROM windows WHERE times > 1) GROUP BY r),
m AS (SELECT doc_id, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars,
    length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols, len(l) - len(list_distinct(l)) AS n_dup_lines,
    coalesce(n, 0) AS n_repeat_words, len(l) AS n_lines, length(regexp_replace(t, '\P{{L}}', '', 'g')) AS n_letters,
    length(regexp_replace(t, '\P{{Lu}}', '', 'g')) AS n_upper, length(regexp_replace(t, '[^.]', '', 'g')) AS n_stops,
    length(regexp_replace(t, '[^!]', '', 'g')) AS n_marks FROM base LEFT JOIN repeats USING (r)),
voted AS MATERIALIZED (SELECT *, {', '.join(f'({r.where}) AS {r.name}' for r in RULES)} FROM m),
patterns AS MATERIALIZED (SELECT {', '.join(names)}, count(*) AS n FROM voted GROUP BY ALL),
{', '.join(rounds)}
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
    NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND {posterior} >= {model.threshold} AS kept, {', '.join(names)}
FROM voted, s{model.rounds}"""


def urls() -> str:
    rules = sorted(RULES_URL, key=lambda r: (-len(r.text), r.text))
    cfg = LinkTrust()
    case = lambda v: "CASE " + " ".join(
        f"WHEN (host = '{r.host}' OR host LIKE '%.{r.host}') AND starts_with(path, '{r.path}') THEN '{v(r)}'" for r in rules) + " END"
    link = r"href\s*=\s*[\"'']?\s*(?:[a-z][a-z0-9+.\-]*:)?//([^/?#\"''\s>]+)"
    low = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    target = r"href\s*=\s*[\"'']?\s*(?:[a-z][a-z0-9+.\-]*:)?(//[^/?#\"''\s>]+[^#\"''\s>]*)"
    host = lambda u: low.format(f"coalesce(regexp_extract({u}, '://([^/?#]*)', 1), '')")
    rest = lambda u: f"regexp_extract({u}, '://[^/?#]*([^#]*)', 1)"
    address = lambda u: f"{host(u)} || CASE WHEN starts_with({rest(u)}, '/') THEN {rest(u)} ELSE '/' || {rest(u)} END"
    return rf"""
WITH RECURSIVE p AS MATERIALIZED (SELECT page_id, url, html, {host('url')} AS host,
  coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
r AS MATERIALIZED (SELECT page_id, host, path, {case(lambda r: r.text)} AS rule, {case(lambda r: r.verdict)} AS ruled FROM p),
named AS (SELECT host AS source, ':' || unnest(regexp_extract_all(html, '{target}', 1, 'i')) AS u FROM p WHERE host <> ''),
targets AS (SELECT address, {host("'://' || address")} AS host, regexp_extract('://' || address, '://[^/?#]*([^?#]*)', 1) AS path
  FROM (SELECT DISTINCT {address('u')} AS address FROM named WHERE source <> {host('u')})
  WHERE address NOT IN (SELECT {address('url')} FROM p WHERE url IS NOT NULL)),
judged AS (SELECT host, {case(lambda r: r.verdict)} AS ruled FROM targets UNION ALL SELECT host, ruled FROM r WHERE host <> ''),
seeds AS MATERIALIZED (SELECT host, count(*) FILTER (ruled = 'allow') AS allowed, count(*) FILTER (ruled = 'block') AS blocked FROM judged GROUP BY 1),
l AS MATERIALIZED (SELECT source, target, count(*) AS links FROM (SELECT host AS source,
  {low.format(f"unnest(regexp_extract_all(html, '{link}', 1, 'i'))")} AS target FROM p) WHERE source <> '' AND source <> target GROUP BY ALL),
flow AS MATERIALIZED (SELECT 'trust' AS kind, source AS start, target AS "end", links / sum(links) OVER (PARTITION BY source) AS part FROM l
  UNION ALL SELECT 'distrust', target, source, links / sum(links) OVER (PARTITION BY target) FROM l),
known AS (SELECT 'trust' AS kind, host, {1 - cfg.damping} * allowed / greatest(sum(allowed) OVER (), 1) AS mass FROM seeds
  UNION ALL SELECT 'distrust', host, {1 - cfg.damping} * blocked / greatest(sum(blocked) OVER (), 1) FROM seeds),
way(step, kind, host, mass) AS (SELECT 0, kind, host, mass FROM known WHERE mass > 0
  UNION ALL SELECT step + 1, f.kind, f."end", {cfg.damping} * sum(mass * part) FROM way w JOIN flow f ON w.kind = f.kind AND w.host = f.start
  WHERE step < 160 GROUP BY ALL),
h AS (SELECT host, sum(mass) FILTER (kind = 'trust') AS trust, sum(mass) FILTER (kind = 'distrust') AS distrust FROM way GROUP BY 1)
SELECT page_id, r.host, path, rule, coalesce(ruled, CASE WHEN coalesce(distrust, 0) > {cfg.tolerance} * coalesce(trust, 0) THEN 'block' ELSE 'allow' END) AS verdict
FROM r LEFT JOIN h ON r.host = h.host"""


_FINITE = "embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0"


def codes() -> str:
    cfg = Codes()
    nearest = lambda i: f"""a{i} AS MATERIALIZED (SELECT r, p.part, min(list_sum(list_transform(list_zip(p.y, e.y),
        lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT * {cfg.entries} + e.k) AS best FROM p JOIN e{i} e ON p.part = e.part GROUP BY ALL)"""  # noqa: E731
    moved = "".join(f""", {nearest(i)},
s{i} AS (SELECT part, k, list(m ORDER BY j) AS y FROM (SELECT a.part, a.best % {cfg.entries} AS k, j, floor(sum(p.y[j]) / count(*))::BIGINT AS m
    FROM a{i} a JOIN p ON a.r = p.r AND a.part = p.part, unnest(range(1, len(p.y) + 1)) t(j) GROUP BY ALL) GROUP BY ALL),
e{i + 1} AS MATERIALIZED (SELECT e.part, e.k, coalesce(s.y, e.y) AS y FROM e{i} e LEFT JOIN s{i} s ON e.part = s.part AND e.k = s.k)""" for i in range(cfg.rounds))
    return f"""
WITH v AS MATERIALIZED (SELECT row_number() OVER (ORDER BY vec_id) AS r, vec_id, label,
    list_transform(embedding, lambda c: floor({cfg.scale} * c::DOUBLE)::BIGINT) AS x FROM embeddings WHERE {_FINITE}),
p AS MATERIALIZED (SELECT r, part, list_slice(x, len(x) * part // {cfg.parts} + 1, len(x) * (part + 1) // {cfg.parts}) AS y
    FROM v, range({cfg.parts}) t(part)),
e0 AS MATERIALIZED (SELECT part, r - 1 AS k, y FROM p WHERE r <= {cfg.entries}){moved}, {nearest(cfg.rounds)},
coded AS (SELECT r, string_agg(printf('%02x', best % {cfg.entries}), '' ORDER BY part) AS code, sum(best // {cfg.entries})::BIGINT AS error
    FROM a{cfg.rounds} GROUP BY r),
d AS (SELECT sha256(string_agg(array_to_string(y, ','), ',' ORDER BY part, k)) AS codebooks_sha256 FROM e{cfg.rounds})
SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error, codebooks_sha256 FROM coded JOIN v USING (r), d"""


def caps() -> str:
    cfg = Caps()
    return f"""
WITH RECURSIVE v AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, embedding::DOUBLE[] AS x FROM embeddings
    WHERE {_FINITE} AND len(list_filter(embedding, lambda c: c <> 0)) > 0),
l AS MATERIALIZED (SELECT a.r AS a, b.r AS b FROM v a JOIN v b ON a.r <> b.r AND len(a.x) = len(b.x) WHERE list_dot_product(a.x, b.x)
    / (sqrt(list_dot_product(a.x, a.x)) * sqrt(list_dot_product(b.x, b.x))) >= {cfg.cosine}),
reach(a, b) AS (SELECT r, r FROM v UNION SELECT reach.a, l.b FROM reach JOIN l ON reach.b = l.a),
c AS (SELECT a AS r, min(vec_id) AS component_id FROM reach JOIN v ON reach.b = v.r GROUP BY 1),
n AS (SELECT a AS r, count(*) AS n_links FROM l GROUP BY 1),
linked AS (SELECT vec_id, coalesce(n_links, 0) AS n_links, component_id FROM v JOIN c USING (r) LEFT JOIN n USING (r)
    UNION ALL SELECT vec_id, 0, vec_id FROM embeddings WHERE NOT coalesce({_FINITE} AND len(list_filter(embedding, lambda c: c <> 0)) > 0, false))
SELECT vec_id, n_links, component_id, coalesce(vec_id = component_id, false) AS kept FROM linked"""
