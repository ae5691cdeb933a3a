"""Plain SQL over the supplied tables that states the expected results independently."""

from __future__ import annotations

FIRST_WORDS = 6

BASE = r"""
n_vec AS (SELECT count(*) AS n FROM embeddings),
n_item AS (SELECT count(*) AS n FROM benchmark),
raw_titles AS (
  SELECT page_id AS id,
         trim(regexp_extract(html, '<title>([^<]*)</title>', 1)) AS title,
         regexp_extract(html, '<html lang="([a-z]+)"', 1) AS language,
         regexp_extract(html, '<p>(?:<[a-z]+>)*([^<.]*)', 1) AS description,
         CASE WHEN page_id % 11 = 5 THEN 'pending' WHEN page_id % 11 = 3 THEN 'approved' ELSE 'active' END
           AS record_status,
         upper(regexp_extract(html, '<html lang="([a-z]+)"', 1)) || ' - ' || (page_id % 7)::VARCHAR AS raw_domain
  FROM pages),
corpus AS (
  SELECT r.*, e.label AS cluster_id,
         trim(regexp_replace(replace(lower(title), 'ß', 'ss'), '[^a-z0-9]+', ' ', 'g')) AS normalized_title,
         regexp_replace(regexp_replace(lower(trim(raw_domain)), '\s*-\s*', '-', 'g'), '\s+', '-', 'g') AS domain
  FROM raw_titles r LEFT JOIN embeddings e ON e.vec_id = r.id % (SELECT n FROM n_vec)),
usable AS (SELECT * FROM corpus WHERE record_status IN ('active', 'approved')),
units AS (
  SELECT vec_id, label,
         list_transform(embedding, lambda x: CASE WHEN len2 = 0 THEN 0::FLOAT
                                             ELSE (x::DOUBLE / sqrt(len2))::FLOAT END) AS embedding
  FROM (SELECT *, list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]) AS len2 FROM embeddings)),
vectors AS (
  SELECT p.page_id AS id, u.embedding, u.label AS cluster_id
  FROM pages p JOIN units u ON u.vec_id = p.page_id % (SELECT n FROM n_vec)),
centroids AS (
  SELECT cluster_id, list(mean ORDER BY i)::FLOAT[] AS centroid, any_value(n) AS size
  FROM (SELECT cluster_id, i, round(avg(x), 6) AS mean, count(*) AS n
        FROM (SELECT cluster_id, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM vectors)
        GROUP BY cluster_id, i)
  GROUP BY cluster_id),
proposals AS (
  SELECT r.id AS proposal_id, r.id AS seq,
         CASE r.id % 6
           WHEN 1 THEN replace(upper(title), 'ẞ', 'SS')
           WHEN 2 THEN array_to_string(list_reverse(string_split(title, ' ')), ' ')
           WHEN 3 THEN array_to_string(string_split(title, ' ')[1:len(string_split(title, ' ')) - 1], ' ')
           WHEN 4 THEN title || ' Variation ' || r.id::VARCHAR
           WHEN 5 THEN array_to_string(regexp_split_to_array(b.text, '\s+')[1:6], ' ')
           ELSE title END AS title,
         raw_domain AS domain, language, description, u.embedding
  FROM raw_titles r
  JOIN units u ON u.vec_id = (r.id + 1) % (SELECT n FROM n_vec)
  JOIN benchmark b ON b.item_id = r.id % (SELECT n FROM n_item)),
asked AS (
  SELECT *, trim(regexp_replace(replace(lower(title), 'ß', 'ss'), '[^a-z0-9]+', ' ', 'g')) AS normalized_title,
         regexp_replace(regexp_replace(lower(trim(domain)), '\s*-\s*', '-', 'g'), '\s+', '-', 'g') AS norm_domain
  FROM proposals),
probes AS (
  SELECT proposal_id, cluster_id, place FROM (
    SELECT a.proposal_id, c.cluster_id,
           row_number() OVER (PARTITION BY a.proposal_id ORDER BY
             list_dot_product(a.embedding::DOUBLE[], c.centroid::DOUBLE[])
               / (sqrt(list_dot_product(c.centroid::DOUBLE[], c.centroid::DOUBLE[])) + 1e-9) DESC, c.cluster_id) AS place
    FROM asked a, centroids c)
  WHERE place <= 3),
knn AS (
  SELECT proposal_id, id, similarity, sem_rank FROM (
    SELECT *, row_number() OVER (PARTITION BY proposal_id ORDER BY similarity DESC, id) AS sem_rank
    FROM (SELECT a.proposal_id, v.id, list_dot_product(a.embedding::DOUBLE[], v.embedding::DOUBLE[]) AS similarity
          FROM asked a, vectors v))
  WHERE sem_rank <= 60)
"""

SHEET = r"""
sheet AS (
  SELECT doc_id,
         CASE WHEN doc_id % 37 = 0 THEN NULL WHEN doc_id % 41 = 0 THEN 'nan'
              ELSE string_split(text, chr(10))[1] END AS titles,
         string_split(text, chr(10))[2] AS description,
         CASE WHEN doc_id % 29 = 0 THEN NULL ELSE source || ' - ' || lang END AS domain,
         nullif(regexp_extract(text, '[A-Za-z0-9._-]+@[A-Za-z0-9.-]+', 0), '') AS contact_info
  FROM documents)
"""


def lcs(p: str, pairs: str) -> str:
    """CTE ``{p}_lcs(x, y, common)``: LCS length of the distinct (x, y) of ``pairs``, bit-parallel."""
    return f"""
{p}_xy AS (SELECT DISTINCT x, y FROM {pairs}),
{p}_pos AS (
  SELECT x, unnest(string_split(x, '')) AS ch, generate_subscripts(string_split(x, ''), 1) - 1 AS i
  FROM (SELECT DISTINCT x FROM {p}_xy)),
{p}_mask AS (
  SELECT x, map_from_entries(list((ch, bits))) AS m
  FROM (SELECT x, ch, bit_or(1::HUGEINT << i::INT) AS bits FROM {p}_pos GROUP BY x, ch) GROUP BY x),
{p}_run AS (
  SELECT q.x, q.y, (1::HUGEINT << length(q.x)::INT) - 1 AS every,
         list_transform(string_split(q.y, ''), lambda c: coalesce(k.m[c], 0)::HUGEINT) AS hits
  FROM {p}_xy q JOIN {p}_mask k ON k.x = q.x),
{p}_lcs AS (
  SELECT x, y,
         length(x) - bit_count(list_reduce(hits, lambda s, h: ((s + (s & h)) | (s - (s & h))) & every, every)) AS common
  FROM {p}_run)"""


def token_set(p: str, pairs: str) -> str:
    """CTE ``{p}_score(a, b, score)``: token-set similarity of the distinct (a, b) of ``pairs``."""
    return rf"""
{p}_ab AS (SELECT DISTINCT a, b FROM {pairs}),
{p}_tok AS (
  SELECT s, list_sort(list_distinct(list_filter(regexp_split_to_array(s, '\s+'), lambda t: t <> ''))) AS toks
  FROM (SELECT a AS s FROM {p}_ab UNION SELECT b FROM {p}_ab)),
{p}_cut AS (
  SELECT a, b, len(l.toks) AS na, len(r.toks) AS nb,
         array_to_string(list_filter(l.toks, lambda t: list_contains(r.toks, t)), ' ') AS i,
         array_to_string(list_filter(l.toks, lambda t: NOT list_contains(r.toks, t)), ' ') AS x,
         array_to_string(list_filter(r.toks, lambda t: NOT list_contains(l.toks, t)), ' ') AS y
  FROM {p}_ab JOIN {p}_tok l ON l.s = a JOIN {p}_tok r ON r.s = b),
{lcs(p, p + "_cut")},
{p}_len AS (
  SELECT c.*, length(i)::DOUBLE AS s, (length(i) > 0)::INT::DOUBLE AS g, length(c.x)::DOUBLE AS lx,
         length(c.y)::DOUBLE AS ly, coalesce(k.common, 0)::DOUBLE AS common
  FROM {p}_cut c LEFT JOIN {p}_lcs k ON k.x = c.x AND k.y = c.y),
{p}_score AS (
  SELECT a, b, CASE
    WHEN na = 0 OR nb = 0 THEN 0.0::DOUBLE
    WHEN s > 0 AND (lx = 0 OR ly = 0) THEN 100.0::DOUBLE
    WHEN s = 0 THEN 100::DOUBLE - 100::DOUBLE * (lx + ly - 2 * common) / (lx + ly)
    ELSE greatest(100::DOUBLE - 100::DOUBLE * (lx + ly - 2 * common) / ((s + g + lx) + (s + g + ly)),
                  100::DOUBLE - 100::DOUBLE * (g + lx) / (2 * s + g + lx),
                  100::DOUBLE - 100::DOUBLE * (g + ly) / (2 * s + g + ly)) END AS score
  FROM {p}_len)"""


def token_sort(p: str, pairs: str) -> str:
    """CTE ``{p}_score(a, b, score)``: indel similarity of the token-sorted strings."""
    return rf"""
{p}_ab AS (SELECT DISTINCT a, b FROM {pairs}),
{p}_tok AS (
  SELECT s, array_to_string(list_sort(list_filter(regexp_split_to_array(s, '\s+'), lambda t: t <> '')), ' ') AS sorted
  FROM (SELECT a AS s FROM {p}_ab UNION SELECT b FROM {p}_ab)),
{p}_cut AS (SELECT a, b, l.sorted AS x, r.sorted AS y
            FROM {p}_ab JOIN {p}_tok l ON l.s = a JOIN {p}_tok r ON r.s = b),
{lcs(p, p + "_cut")},
{p}_score AS (
  SELECT a, b, CASE WHEN length(c.x) + length(c.y) = 0 THEN 100.0::DOUBLE ELSE
         (1::DOUBLE - ((length(c.x) + length(c.y))::DOUBLE - 2 * coalesce(common, 0)::DOUBLE)
            / (length(c.x) + length(c.y))::DOUBLE) * 100::DOUBLE END AS score
  FROM {p}_cut c LEFT JOIN {p}_lcs k ON k.x = c.x AND k.y = c.y)"""


FUZZY = (
    """
titles AS (SELECT cluster_id, title, min(id) AS first_id, max(id) AS last_id FROM usable
           WHERE cluster_id IS NOT NULL GROUP BY cluster_id, title),
scope AS (
  SELECT p.proposal_id, a.title AS a, t.title AS b, min(first_id) AS first_id, max(last_id) AS last_id
  FROM probes p JOIN asked a USING (proposal_id) JOIN titles t USING (cluster_id)
  GROUP BY p.proposal_id, a.title, t.title)"""
    + ","
    + token_set("fz", "scope")
    + """,
lexical AS (
  SELECT proposal_id, last_id AS id, b AS title, score, lex_rank FROM (
    SELECT s.*, z.score, row_number() OVER (PARTITION BY proposal_id ORDER BY z.score DESC, first_id) AS lex_rank
    FROM scope s JOIN fz_score z USING (a, b) WHERE z.score >= 60)
  WHERE lex_rank <= 20)"""
)

# all exact pairs here; the engine lists only those a verdict can look at
CANDIDATES = """
exact AS (SELECT a.proposal_id, u.id FROM asked a JOIN usable u USING (normalized_title)),
merged AS (
  SELECT proposal_id, id, max(similarity) AS similarity, min(sem_rank) AS sem_rank, min(lex_rank) AS lex_rank FROM (
    SELECT proposal_id, id, similarity, sem_rank, NULL AS lex_rank FROM knn
    UNION ALL SELECT proposal_id, id, NULL, NULL, lex_rank FROM lexical
    UNION ALL SELECT proposal_id, id, NULL, NULL, NULL FROM exact)
  GROUP BY proposal_id, id),
paired AS (
  SELECT m.*, u.title, u.normalized_title, u.domain, u.language, u.description, u.cluster_id,
         a.title AS q_title, a.normalized_title AS q_normalized, a.norm_domain AS q_domain,
         a.normalized_title = u.normalized_title AS by_exact,
         EXISTS (SELECT 1 FROM probes p WHERE p.proposal_id = m.proposal_id AND p.cluster_id = u.cluster_id) AS inside
  FROM merged m JOIN usable u USING (id) JOIN asked a USING (proposal_id)),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY proposal_id, (sem_rank IS NOT NULL AND NOT by_exact) ORDER BY sem_rank)
           AS place FROM paired),
admitted AS (
  SELECT *, coalesce(sem_rank IS NOT NULL AND (by_exact OR inside OR place <= 20), false) AS by_semantic,
         lex_rank IS NOT NULL AS by_lexical FROM placed),
candidates AS (
  SELECT *, CASE WHEN by_semantic THEN similarity ELSE 0 END AS raw_similarity,
         concat_ws('+', CASE WHEN by_exact THEN 'exact' END, CASE WHEN by_semantic THEN 'semantic' END,
                   CASE WHEN by_lexical THEN 'lexical' END) AS sources
  FROM admitted WHERE by_exact OR by_semantic OR by_lexical)
"""

# scored with weights 0.625 / 0.375 / 0, so that no phonetic key is needed
SCORED = (
    "norm_pairs AS (SELECT DISTINCT q_normalized AS a, normalized_title AS b FROM candidates),"
    + token_set("ns", "norm_pairs")
    + ","
    + token_sort("no", "norm_pairs")
    + """,
signals AS (
  SELECT c.*, by_exact AND q_normalized <> '' AS is_exact,
         greatest(0, least(1, raw_similarity)) AS sem,
         CASE WHEN q_normalized = '' OR normalized_title = '' THEN 0.0::DOUBLE
              WHEN by_exact THEN 1.0::DOUBLE
              ELSE greatest(ns.score / 100::DOUBLE, no.score / 100::DOUBLE) END AS lex
  FROM candidates c
  JOIN ns_score ns ON ns.a = q_normalized AND ns.b = normalized_title
  JOIN no_score no ON no.a = q_normalized AND no.b = normalized_title),
scored AS (
  SELECT *, printf('%.4f', CASE WHEN is_exact THEN 1::DOUBLE ELSE
                 greatest(0, least(1, 0.625::DOUBLE * sem + 0.375::DOUBLE * lex)) END)::DOUBLE AS final_score,
         printf('%.4f', CASE WHEN is_exact THEN 1::DOUBLE ELSE sem END)::DOUBLE AS semantic_score,
         printf('%.4f', CASE WHEN is_exact THEN 1::DOUBLE ELSE lex END)::DOUBLE AS lexical_score
  FROM signals),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY proposal_id ORDER BY final_score DESC,
      CASE WHEN by_exact THEN 0 WHEN by_semantic THEN 1 ELSE 2 END,
      CASE WHEN by_exact THEN 0 WHEN by_semantic THEN sem_rank ELSE lex_rank END, id) AS rank
  FROM scored)"""
)

VERDICTS = """
totals AS (
  SELECT proposal_id, count(*) AS candidate_count, bool_or(is_exact) AS any_exact,
         coalesce(bool_or(rank <= 3 AND domain = q_domain AND q_domain NOT IN ('', 'unknown')), false) AS same_domain
  FROM ranked GROUP BY proposal_id),
best AS (SELECT * FROM ranked WHERE rank = 1),
rated AS (
  SELECT a.proposal_id, a.seq, a.title AS q_title, a.normalized_title, a.norm_domain, t.proposal_id IS NULL AS nothing,
         coalesce(t.any_exact, false) AS any_exact, coalesce(same_domain, false) AS same_domain,
         coalesce(b.inside, false) AS same_cluster, b.semantic_score, b.lexical_score, b.title AS match_title,
         CASE WHEN any_exact THEN 1.0::DOUBLE ELSE coalesce(b.final_score, 0::DOUBLE) END AS final_score,
         coalesce(candidate_count, 0) AS candidate_count
  FROM asked a LEFT JOIN totals t USING (proposal_id) LEFT JOIN best b USING (proposal_id)),
decided AS (
  SELECT *, CASE WHEN any_exact OR final_score >= 0.75 THEN 'POTENTIAL_CONFLICT'
                 WHEN final_score >= 0.5 THEN 'REVIEW_REQUIRED' ELSE 'NO_STRONG_CONFLICT' END AS decision
  FROM rated),
worded AS (
  SELECT *, concat_ws('|',
      CASE WHEN any_exact THEN 'Exact normalized title match found' END,
      CASE WHEN NOT any_exact AND lexical_score >= 0.85 THEN 'Very high lexical similarity detected' END,
      CASE WHEN NOT any_exact AND semantic_score >= 0.80 THEN 'High semantic similarity detected' END,
      CASE WHEN same_domain THEN 'Same domain as closest matching title' END,
      CASE WHEN same_cluster THEN 'High semantic similarity within same cluster' END) AS found
  FROM decided),
verdicts AS (
  SELECT proposal_id, seq, normalized_title, norm_domain, q_title,
         'VR-' || upper(substr(sha256(proposal_id::VARCHAR), 1, 8)) AS verification_id, decision,
         CASE decision WHEN 'POTENTIAL_CONFLICT' THEN 'HIGH' WHEN 'REVIEW_REQUIRED' THEN 'MEDIUM' ELSE 'LOW' END AS risk,
         CASE decision WHEN 'POTENTIAL_CONFLICT' THEN 'rejected' WHEN 'REVIEW_REQUIRED' THEN 'pending'
                       ELSE 'approved' END AS record_status,
         final_score, coalesce(semantic_score, 0::DOUBLE) AS semantic_score,
         coalesce(lexical_score, 0::DOUBLE) AS lexical_score,
         CASE WHEN nothing THEN 'No candidate matches found in dataset'
              WHEN found <> '' THEN found
              WHEN decision = 'NO_STRONG_CONFLICT' THEN 'No high-confidence conflict found'
              ELSE 'Manual review recommended because signals conflict' END AS reasons,
         CASE WHEN nothing THEN 'No matching or similar titles were found in the dataset.'
              WHEN decision = 'POTENTIAL_CONFLICT' THEN 'A potential conflict was detected (Risk: HIGH). The proposed title '''
                || q_title || ''' closely matches existing title ''' || match_title || ''' with a score of '
                || printf('%.2f', final_score) || '.'
              WHEN decision = 'REVIEW_REQUIRED' THEN 'Manual review is recommended (Risk: MEDIUM). The proposed title '''
                || q_title || ''' shares moderate similarity with existing title ''' || match_title || ''' (score: '
                || printf('%.2f', final_score) || ').'
              ELSE 'No strong conflict was detected (Risk: LOW). The highest similarity score found is '
                || printf('%.2f', final_score) || '.' END AS explanation,
         candidate_count
  FROM worded)
"""


def query(select: str, *parts: str) -> str:
    return "WITH " + ",".join(p.strip() for p in parts) + "\n" + select
