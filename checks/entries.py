"""Every registered query with, where SQL can state it, the SQL it must equal."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from titlesieve.config import ScreeningConfig
from titlesieve.functions import scores, text
from titlesieve.functions.encoders import HashingEncoder
from titlesieve.functions.phonetic import phonetic_code
from titlesieve.operators import candidates as cand
from titlesieve.operators import clusters, decisions, exact, fuzzy, knn, profile, updates
from titlesieve.operators.ordinal import with_ordinal
from titlesieve.plans import index, ingest, requests, screen, status, submit
from titlesieve.plans.validate import profile_report
from titlesieve.session import compute_tasks, ensure_checkpoint_dir, ship_package
from titlesieve.sources.reports import flatten_nested
from titlesieve.sources.schemas import RAW_COLUMNS
from titlesieve.sources.sheets import MISSING_CELLS, POSITION, read_positioned, read_sheet
from titlesieve.sources.store import TitleStore

from . import sql, views

CFG = ScreeningConfig()
# phonetic weight 0 and no phonetic reason: the outcome then needs no phonetic key
PLAIN = ScreeningConfig(semantic_weight=0.625, lexical_weight=0.375, phonetic_weight=0.0, phonetic_reason_min=1.01)
ALL = (sql.BASE, sql.FUZZY, sql.CANDIDATES, sql.SCORED, sql.VERDICTS)


@dataclass(frozen=True)
class Entry:
    run: Callable[[SparkSession, str], DataFrame]
    oracle: str | None


ENTRIES: dict[str, Entry] = {}


def register(oracle: str | None = None):
    def add(run):
        ENTRIES[run.__name__] = Entry(run, oracle)
        return run

    return add


def _prepared(spark, sf, cfg=PLAIN):
    library = views.library(spark, sf)
    return screen.prepare_proposals(views.proposals(spark, sf), library, cfg), library


def _model(library, cfg=CFG):
    return clusters.load_model(library.centroids, cfg)


# ---------------------------------------------------------------- text and scalar functions

@register(sql.query("SELECT id, normalized_title FROM corpus", sql.BASE))
def normalize_title(spark, sf):
    ship_package(spark)
    return views.raw_titles(spark, sf).select("id", text.normalize_title(F.col("title")).alias("normalized_title"))


@register(sql.query(r"""
SELECT doc_id, CASE WHEN domain IS NULL OR domain = '' THEN 'unknown' ELSE
  regexp_replace(regexp_replace(lower(regexp_replace(domain, '^\s+|\s+$', '', 'g')), '\s*-\s*', '-', 'g'),
                 '\s+', '-', 'g') END AS domain FROM sheet""", sql.SHEET))
def normalize_domain(spark, sf):
    return views.sheet(spark, sf).select("doc_id", text.normalize_domain(F.col("domain")).alias("domain"))


@register(r"""
SELECT doc_id, CASE WHEN text = '' THEN false
  WHEN length(regexp_replace(text, '[^\p{L}]', '', 'g')) = 0 THEN true
  ELSE length(regexp_replace(regexp_replace(text, '[^\p{L}]', '', 'g'), '[^\p{Latin}]', '', 'g'))::DOUBLE
       / length(regexp_replace(text, '[^\p{L}]', '', 'g')) >= 0.8 END AS is_latin FROM documents""")
def latin_script(spark, sf):
    return views.table(spark, sf, "documents").select("doc_id", text.is_latin_script(F.col("text")).alias("is_latin"))


def _blank_sql(c: str) -> str:
    clean = rf"regexp_replace({c}, '^\s+|\s+$', '', 'g')"
    return f"CASE WHEN lower({clean}) NOT IN ('', 'nan') THEN {clean} END AS {c}"


@register(sql.query("SELECT doc_id, " + ", ".join(map(_blank_sql, ("titles", "description", "domain", "contact_info")))
                    + " FROM sheet", sql.SHEET))
def blank_to_null(spark, sf):
    cols = ("titles", "description", "domain", "contact_info")
    return views.sheet(spark, sf).select("doc_id", *[text.blank_to_null(F.col(c)).alias(c) for c in cols])


@register(sql.query("""
SELECT id, CASE WHEN trim(description) <> '' THEN title || '. ' || trim(description) ELSE title END AS text
FROM raw_titles""", sql.BASE))
def embedding_text(spark, sf):
    titles = views.raw_titles(spark, sf)
    return titles.select("id", text.embedding_text(F.col("title"), F.col("description")).alias("text"))


@register("""
SELECT vec_id, i, round((x::DOUBLE / sqrt(len2))::FLOAT::DOUBLE, 6) AS value
FROM (SELECT vec_id, list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]) AS len2,
             unnest(embedding) AS x, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings)""")
def unit_vectors(spark, sf):
    from titlesieve.functions.vectors import unit

    units = views.table(spark, sf, "embeddings").select("vec_id", unit(F.col("embedding")).alias("u"))
    return units.select("vec_id", F.posexplode("u").alias("i", "x")).select(
        "vec_id", F.col("i").cast("long").alias("i"), F.round(F.col("x").cast("double"), 6).alias("value")
    )


@register("""
SELECT event_id, printf('%.4f', greatest(0, least(1, value / 100)))::DOUBLE AS share FROM events""")
def clamp_and_round(spark, sf):
    share = text.clamp(F.col("value") / 100)
    return views.table(spark, sf, "events").select("event_id", text.round_exact(share, 4).alias("share"))


@register("SELECT page_id, 'VR-' || upper(substr(sha256(page_id::VARCHAR), 1, 8)) AS verification_id FROM pages")
def verification_ids(spark, sf):
    return views.table(spark, sf, "pages").select(
        "page_id", text.verification_id(F.col("page_id")).alias("verification_id")
    )


@register(sql.query(r"""
SELECT id, array_to_string(list_sort(list_distinct(list_filter(regexp_split_to_array(title, '\s+'), lambda t: t <> ''))), ' ')
         AS token_set,
       array_to_string(list_sort(list_filter(regexp_split_to_array(title, '\s+'), lambda t: t <> '')), ' ') AS token_sort
FROM raw_titles""", sql.BASE))
def token_sets(spark, sf):
    title = F.col("title")
    return views.raw_titles(spark, sf).select(
        "id", F.array_join(text.token_set(title), " ").alias("token_set"), text.token_sort(title).alias("token_sort")
    )


def _benchmark_sql() -> str:
    def listed(values):
        return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"

    titles = listed(t for t, _ in status.BENCHMARK_TITLES)
    domains = listed(d for _, d in status.BENCHMARK_TITLES)
    return f"""
SELECT event_id, ({titles})[event_id % 10 + 1] || ' Variation ' || (event_id + 1)::VARCHAR AS title,
       ({domains})[event_id % 10 + 1] AS domain FROM events"""


@register(_benchmark_sql())
def benchmark_proposals(spark, sf):
    return status.benchmark_proposals(views.table(spark, sf, "events").select("event_id"), "event_id")


@register(None)
def phonetic_codes(spark, sf):
    ship_package(spark)
    titles = views.raw_titles(spark, sf).withColumn("normal", text.normalize_title(F.col("title")))
    return titles.select("id", phonetic_code(F.col("title"), F.col("normal")).alias("phonetic_code"))


# ---------------------------------------------------------------- dataset checks and ingestion

_PROFILE_SQL = r"""
facts AS (
  SELECT *, CASE WHEN lower(trim(titles)) NOT IN ('', 'nan') THEN regexp_replace(titles, '^\s+|\s+$', '', 'g') END AS title
  FROM sheet),
normals AS (
  SELECT *, trim(regexp_replace(replace(lower(title), 'ß', 'ss'), '[^a-z0-9]+', ' ', 'g')) AS normal,
         CASE WHEN domain IS NULL OR domain = '' THEN 'unknown' ELSE
           regexp_replace(regexp_replace(lower(trim(domain)), '\s*-\s*', '-', 'g'), '\s+', '-', 'g') END AS norm_domain
  FROM facts)"""


@register(sql.query("""
SELECT count(*) AS total_rows, count(title) AS valid_titles_count,
       count(*) FILTER (title IS NULL) AS blank_titles_count,
       count(*) FILTER (coalesce(trim(description), '') = '' OR lower(description) = 'nan') AS missing_descriptions_count,
       count(*) FILTER (coalesce(trim(contact_info), '') = '' OR lower(contact_info) = 'nan') AS missing_contact_info_count,
       count(title) - count(DISTINCT title) AS duplicate_raw_titles_count,
       count(normal) - count(DISTINCT normal) AS duplicate_normalized_titles_count,
       coalesce(min(length(title)), 0) AS min_title_length, coalesce(max(length(title)), 0) AS max_title_length,
       count(*) FILTER (norm_domain IN ('unknown', '')) AS empty_domains_count,
       (SELECT '{' || string_agg('"' || norm_domain || '":' || n::VARCHAR, ',' ORDER BY norm_domain) || '}'
        FROM (SELECT norm_domain, count(*) AS n FROM normals GROUP BY norm_domain)) AS domain_counts,
       CASE WHEN count(title) < 6000 THEN '["Valid title count (' || count(title)::VARCHAR
         || ') is less than required minimum (6000)."]' ELSE '[]' END AS errors,
       count(title) >= 6000 AS is_valid
FROM normals""", sql.SHEET, _PROFILE_SQL))
def dataset_report(spark, sf):
    return flatten_nested(profile_report(views.sheet(spark, sf), CFG))


@register(sql.query("SELECT norm_domain AS domain, count(*) AS rows FROM normals GROUP BY norm_domain",
                    sql.SHEET, _PROFILE_SQL))
def domain_counts(spark, sf):
    return profile.domain_counts(views.sheet(spark, sf))


@register(sql.query("""
SELECT doc_id, row_number() OVER (ORDER BY doc_id) + 1 AS source_row_number FROM sheet""", sql.SHEET))
def source_row_numbers(spark, sf):
    return ingest.with_source_rows(views.sheet(spark, sf), "doc_id").select("doc_id", "source_row_number")


@register(sql.query(r"""
SELECT row_number() OVER (ORDER BY doc_id) AS id, title, normal AS normalized_title,
       CASE WHEN lower(trim(description)) NOT IN ('', 'nan') THEN regexp_replace(description, '^\s+|\s+$', '', 'g') END
         AS description,
       norm_domain AS domain, trim(domain) AS raw_domain, contact_info, 'English' AS language,
       'dataset_default' AS language_source, 'active' AS record_status, 'sheet' AS source_file, source_row_number
FROM (SELECT *, row_number() OVER (ORDER BY doc_id) + 1 AS source_row_number FROM normals) WHERE title IS NOT NULL
""", sql.SHEET, _PROFILE_SQL))
def ingested_records(spark, sf):
    records = ingest.clean_records(ingest.numbered_rows(views.sheet(spark, sf), "doc_id"), "sheet")
    return records.drop("created_at", "updated_at", "phonetic_code")


@register("""
SELECT user_id AS id, arg_max(event_type, event_id) AS status, arg_max(value, event_id) AS valid_rows
FROM events GROUP BY user_id""")
def latest_audits(spark, sf):
    log = views.table(spark, sf, "events").select(
        F.col("user_id").alias("id"), F.col("event_id").alias("event_seq"),
        F.col("event_type").alias("status"), F.col("value").alias("valid_rows"),
    )
    return ingest.latest_audits(log)


@register(sql.query("""
SELECT id, title, record_status FROM raw_titles
UNION ALL SELECT id + (SELECT max(id) + 1 FROM raw_titles), title, record_status FROM raw_titles""", sql.BASE))
def store_reload_and_append(spark, sf):
    """Full reload twice (the second replaces the first), then an append behind the existing ids."""
    import uuid

    store = TitleStore(spark, f"{ensure_checkpoint_dir(spark)}/store-{uuid.uuid4().hex}")
    rows = views.raw_titles(spark, sf)
    store.replace("corpus", rows.withColumn("title", F.lit("superseded")))
    store.replace("corpus", rows)
    top = store.read("corpus").agg(F.max("id")).first()[0]
    store.append("corpus", rows.withColumn("id", F.col("id") + top + 1))
    return store.read("corpus").select("id", "title", "record_status")


def _cell_sql(c: str) -> str:
    """A cell as scanned: the spellings of a missing one are null."""
    return f"CASE WHEN {c} NOT IN (" + ", ".join(f"'{m}'" for m in MISSING_CELLS) + f") THEN {c} END AS {c}"


@register(sql.query("SELECT doc_id::VARCHAR AS doc_id, " + ", ".join(map(_cell_sql, RAW_COLUMNS)) + " FROM sheet", sql.SHEET))
def sheet_scan(spark, sf):
    """The raw table written as CSV under untidy headers and scanned back."""
    import uuid

    path = f"{ensure_checkpoint_dir(spark)}/sheet-{uuid.uuid4().hex}"
    untidy = views.sheet(spark, sf).toDF("doc_id", " Titles ", "DESCRIPTION", "Domain ", "contact_info")
    untidy.write.options(header=True, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).csv(path)
    return read_sheet(spark, path)


@register(sql.query("""
SELECT doc_id::VARCHAR AS doc_id, row_number() OVER (ORDER BY doc_id) + 1 AS source_row_number FROM sheet""", sql.SHEET))
def scanned_source_rows(spark, sf):
    """Row numbers from the files alone: the raw table in several CSV files, each read in several blocks."""
    import uuid

    path = f"{ensure_checkpoint_dir(spark)}/sheet-{uuid.uuid4().hex}"
    ordered = views.sheet(spark, sf).repartitionByRange(5, "doc_id").sortWithinPartitions("doc_id")
    ordered.write.options(header=True, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).csv(path)
    return ingest.with_source_rows(read_positioned(spark, path), POSITION).select("doc_id", "source_row_number")


# ---------------------------------------------------------------- filters, requests, updates

@register(sql.query("SELECT id, title, record_status FROM usable", sql.BASE))
def usable_records(spark, sf):
    return exact.usable(views.raw_titles(spark, sf)).select("id", "title", "record_status")


@register(sql.query("""
SELECT doc_id, concat_ws('|', CASE WHEN titles IS NULL THEN 'title missing' END,
    CASE WHEN titles = '' THEN 'title too short' END,
    CASE WHEN length(titles) > 500 THEN 'title too long' END,
    CASE WHEN length(domain) > 200 THEN 'domain too long' END,
    CASE WHEN length(description) > 2000 THEN 'description too long' END,
    CASE WHEN length(contact_info) > 500 THEN 'contact_info too long' END) AS violations,
  coalesce(domain, 'general') AS domain, 'English' AS language FROM sheet""", sql.SHEET))
def request_limits(spark, sf):
    asked = views.sheet(spark, sf).withColumnRenamed("titles", "title").withColumn("language", F.lit(None).cast("string"))
    checked = requests.with_violations(asked)
    return checked.select("doc_id", F.array_join("violations", "|").alias("violations"), "domain", "language")


@register(sql.query("""
SELECT c.id, coalesce(b.label, c.cluster_id) AS cluster_id FROM corpus c
LEFT JOIN (SELECT vec_id * 2 AS id, label + 100 AS label FROM embeddings) b USING (id)""", sql.BASE))
def keyed_update(spark, sf):
    fresh = views.table(spark, sf, "embeddings").select(
        (F.col("vec_id") * 2).alias("id"), (F.col("label") + 100).alias("cluster_id")
    )
    return updates.update_column(views.corpus(spark, sf).select("id", "cluster_id"), fresh, "cluster_id")


@register(sql.query("""
SELECT count(*) AS updated FROM corpus WHERE id IN (SELECT vec_id * 2 FROM embeddings)""", sql.BASE))
def keyed_update_count(spark, sf):
    fresh = views.table(spark, sf, "embeddings").select((F.col("vec_id") * 2).alias("id"))
    return updates.updated_count(views.corpus(spark, sf), fresh)


# ---------------------------------------------------------------- retrieval

@register(sql.query("SELECT a.proposal_id, u.id FROM asked a JOIN usable u USING (normalized_title)", sql.BASE))
def exact_pairs(spark, sf):
    asked = views.proposals(spark, sf).withColumn("normalized_title", text.normalize_title(F.col("title")))
    return exact.exact_pairs(asked, views.corpus(spark, sf)).select("proposal_id", "id")


@register(sql.query("""
SELECT proposal_id, count(*) AS exact_total, array_to_string((list(id ORDER BY id))[1:5], ',') AS exact_ids
FROM asked a JOIN usable u USING (normalized_title) GROUP BY proposal_id""", sql.BASE))
def exact_heads(spark, sf):
    asked = views.proposals(spark, sf).withColumn("normalized_title", text.normalize_title(F.col("title")))
    heads = exact.exact_heads(asked, views.corpus(spark, sf), CFG.head_rows)
    return heads.select("proposal_id", "exact_total", F.array_join("exact_ids", ",").alias("exact_ids"))


@register(sql.query("SELECT proposal_id, id, round(similarity, 9) AS similarity, sem_rank FROM knn", sql.BASE))
def nearest_neighbours(spark, sf):
    prepared, library = _prepared(spark, sf)
    hits = knn.nearest_neighbours(prepared, library.vectors, CFG.vector_fetch, CFG, _model(library)[1])
    return hits.select("proposal_id", "id", F.round("similarity", 9).alias("similarity"), "sem_rank")


@register(sql.query("SELECT proposal_id, id, round(similarity, 9) AS similarity, sem_rank FROM knn", sql.BASE))
def nearest_neighbours_pruned(spark, sf):
    """The large-index path: cells, bounds and a second visit, whatever the size."""
    prepared, library = _prepared(spark, sf)
    hits = knn.nearest_neighbours(prepared, library.vectors, CFG.vector_fetch, CFG, _model(library)[1], prune_from=0)
    return hits.select("proposal_id", "id", F.round("similarity", 9).alias("similarity"), "sem_rank")


@register(sql.query("""
SELECT proposal_id, string_agg(cluster_id::VARCHAR, ',' ORDER BY place) AS cluster_ids FROM probes GROUP BY proposal_id
""", sql.BASE))
def nearest_clusters(spark, sf):
    prepared, _ = _prepared(spark, sf)
    return prepared.select("proposal_id", F.array_join("cluster_ids", ",").alias("cluster_ids"))


@register(sql.query("SELECT proposal_id, id, title, round(score, 9) AS score, lex_rank FROM lexical",
                    sql.BASE, sql.FUZZY))
def fuzzy_matches(spark, sf):
    prepared, library = _prepared(spark, sf)
    hits = fuzzy.fuzzy_hits(*fuzzy.scope(prepared, library.corpus, CFG, True), CFG)
    return hits.select("proposal_id", "id", "title", F.round("score", 9).alias("score"), "lex_rank")


_FALLBACK = ("""
scope AS (
  SELECT a.proposal_id, a.title AS a, t.title AS b, min(id) AS first_id, max(id) AS last_id
  FROM asked a, (SELECT id, title FROM usable) t GROUP BY a.proposal_id, a.title, t.title)"""
             + "," + sql.token_set("fz", "scope") + """,
lexical AS (
  SELECT proposal_id, last_id AS id, b AS title, score, lex_rank FROM (
    SELECT s.*, z.score, row_number() OVER (PARTITION BY proposal_id ORDER BY z.score DESC, first_id) AS lex_rank
    FROM scope s JOIN fz_score z USING (a, b) WHERE z.score >= 60)
  WHERE lex_rank <= 20)""")


@register(sql.query("SELECT proposal_id, id, title, round(score, 9) AS score, lex_rank FROM lexical", sql.BASE, _FALLBACK))
def fuzzy_fallback(spark, sf):
    """Without a cluster model all usable records are the scope."""
    asked = views.proposals(spark, sf)
    hits = fuzzy.fuzzy_hits(*fuzzy.scope(asked, views.corpus(spark, sf), CFG, False), CFG)
    return hits.select("proposal_id", "id", "title", F.round("score", 9).alias("score"), "lex_rank")


@register(sql.query("""
SELECT proposal_id, id, sources, round(raw_similarity, 9) AS raw_similarity FROM candidates
""", sql.BASE, sql.FUZZY, sql.CANDIDATES))
def candidates(spark, sf):
    """The whole candidate union, exact pairs spelled out."""
    prepared, library = _prepared(spark, sf)
    found = screen.all_candidates(prepared, library, CFG)
    return found.select("proposal_id", "id", F.array_join("sources", "+").alias("sources"),
                        F.round("raw_similarity", 9).alias("raw_similarity"))


# ---------------------------------------------------------------- similarity of pairs

def _neighbour_pairs(spark, sf):
    """Titles of every proposal next to the titles of its nearest neighbours, distinct."""
    prepared, library = _prepared(spark, sf)
    hits = knn.nearest_neighbours(prepared, library.vectors, CFG.vector_fetch, CFG, _model(library)[1])
    tasks = compute_tasks(spark)
    return (
        hits.join(library.corpus.select("id", "title", "normalized_title", "phonetic_code"), "id")
        .join(prepared.select(
            "proposal_id", F.col("title").alias("q_title"), F.col("normalized_title").alias("q_normal"),
            F.col("phonetic_code").alias("q_code")), "proposal_id")
        .repartition(tasks, "q_title")
    )


_RAW_PAIRS = """
pairs AS (SELECT DISTINCT a.title AS a, c.title AS b FROM knn k JOIN asked a USING (proposal_id) JOIN corpus c USING (id))
"""
_NORMAL_PAIRS = """
pairs AS (SELECT DISTINCT a.normalized_title AS a, c.normalized_title AS b
          FROM knn k JOIN asked a USING (proposal_id) JOIN corpus c USING (id))
"""


@register(sql.query("SELECT a, b, round(score, 9) AS score FROM ts_score", sql.BASE, _RAW_PAIRS,
                    sql.token_set("ts", "pairs")))
def token_set_ratio(spark, sf):
    pairs = _neighbour_pairs(spark, sf).select(F.col("q_title").alias("a"), F.col("title").alias("b")).distinct()
    return pairs.withColumn("score", F.round(scores.token_set_ratio(F.col("a"), F.col("b")), 9))


@register(sql.query("SELECT a, b, round(score, 9) AS score FROM ts_score", sql.BASE, _RAW_PAIRS,
                    sql.token_sort("ts", "pairs")))
def token_sort_ratio(spark, sf):
    pairs = _neighbour_pairs(spark, sf).select(F.col("q_title").alias("a"), F.col("title").alias("b")).distinct()
    return pairs.withColumn("score", F.round(scores.token_sort_ratio(F.col("a"), F.col("b")), 9))


@register(sql.query("""
SELECT a, b, round((1 - (length(a) + length(b) - 2 * coalesce(common, 0))::DOUBLE / greatest(length(a) + length(b), 1))
                   * 100, 9) AS score
FROM pairs LEFT JOIN il_lcs ON x = a AND y = b""", sql.BASE, _RAW_PAIRS,
                    "turned AS (SELECT a AS x, b AS y FROM pairs)", sql.lcs("il", "turned")))
def indel_ratio(spark, sf):
    pairs = _neighbour_pairs(spark, sf).select(F.col("q_title").alias("a"), F.col("title").alias("b")).distinct()
    return pairs.withColumn("score", F.round(scores.indel_ratio(F.col("a"), F.col("b")), 9))


@register(sql.query("""
SELECT a, b, round(CASE WHEN a = '' OR b = '' THEN 0 WHEN a = b THEN 1
                        ELSE greatest(s.score, o.score) / 100 END, 9) AS lexical_score
FROM ts_score s JOIN tt_score o USING (a, b)""", sql.BASE, _NORMAL_PAIRS, sql.token_set("ts", "pairs"),
                    sql.token_sort("tt", "pairs")))
def lexical_scores(spark, sf):
    pairs = _neighbour_pairs(spark, sf).select(
        F.col("q_normal").alias("a"), F.col("normalized_title").alias("b")).distinct()
    return pairs.withColumn("lexical_score", F.round(scores.lexical_score(F.col("a"), F.col("b")), 9))


@register(None)
def phonetic_scores(spark, sf):
    pairs = _neighbour_pairs(spark, sf).select(
        "proposal_id", "id", scores.phonetic_score(F.col("q_code"), F.col("phonetic_code")).alias("phonetic_score"))
    return pairs


# ---------------------------------------------------------------- scoring, decisions, submission

@register(sql.query("""
SELECT proposal_id, id, sources, final_score, semantic_score, lexical_score, is_exact AS is_exact_match,
       0.625::DOUBLE AS w_semantic, 0.375::DOUBLE AS w_lexical, 0.0::DOUBLE AS w_phonetic, rank
FROM ranked WHERE rank <= 5""", *ALL[:4]))
def ranked_matches(spark, sf):
    """The matches a verdict lists."""
    prepared, library = _prepared(spark, sf)
    ranked, _ = screen.ranked_candidates(prepared, library, PLAIN)
    return ranked.filter(F.col("rank") <= PLAIN.top_matches).select(
        "proposal_id", "id", F.array_join("sources", "+").alias("sources"), "final_score", "semantic_score",
        "lexical_score", "is_exact_match", F.col("weights_used.semantic").alias("w_semantic"),
        F.col("weights_used.lexical").alias("w_lexical"), F.col("weights_used.phonetic").alias("w_phonetic"), "rank",
    )


_VERDICT_COLUMNS = """proposal_id, verification_id, decision, risk, final_score, semantic_score, lexical_score, reasons,
       explanation, candidate_count"""


@register(sql.query(f"SELECT {_VERDICT_COLUMNS}, record_status FROM verdicts", *ALL))
def verdicts(spark, sf):
    """Verdicts with the phonetic weight set to 0, so that SQL can state them."""
    done = screen.screen(views.proposals(spark, sf), views.library(spark, sf), PLAIN)
    return done.select(
        "proposal_id", "verification_id", "decision", "risk", "final_score", "score_breakdown.semantic_score",
        "score_breakdown.lexical_score", F.array_join("reasons", "|").alias("reasons"), "explanation",
        "candidate_count", decisions.status_of(F.col("decision")).alias("record_status"),
    )


@register(sql.query(f"SELECT {_VERDICT_COLUMNS} FROM verdicts", *ALL))
def verdicts_incremental(spark, sf):
    """The same verdicts from a store whose derived tables grew with an append."""
    done = screen.screen(views.proposals(spark, sf), screen.load_library(views.store_of(spark, sf)), PLAIN)
    return done.select(
        "proposal_id", "verification_id", "decision", "risk", "final_score", "score_breakdown.semantic_score",
        "score_breakdown.lexical_score", F.array_join("reasons", "|").alias("reasons"), "explanation", "candidate_count")


@register(sql.query(f"""
SELECT {_VERDICT_COLUMNS}, '' AS violations FROM verdicts v JOIN asked a USING (proposal_id)
WHERE length(a.title) BETWEEN 1 AND 500 AND coalesce(length(a.description), 0) <= 2000
UNION ALL BY NAME SELECT proposal_id, concat_ws('|', CASE WHEN title = '' THEN 'title too short' END,
  CASE WHEN length(title) > 500 THEN 'title too long' END, CASE WHEN length(description) > 2000 THEN 'description too long' END) AS violations
FROM asked WHERE NOT (length(title) BETWEEN 1 AND 500 AND coalesce(length(description), 0) <= 2000)""".replace(
    "SELECT proposal_id, verification_id", "SELECT v.proposal_id, verification_id").replace("explanation, candidate_count,", "v.explanation, candidate_count,"), *ALL))
def verified_requests(spark, sf):
    """Requests through the limits: verdicts of the acceptable ones, violations of the others."""
    done, bad = screen.verify(views.proposals(spark, sf), views.library(spark, sf), PLAIN)
    listed = done.select(
        "proposal_id", "verification_id", "decision", "risk", "final_score", "score_breakdown.semantic_score",
        "score_breakdown.lexical_score", F.array_join("reasons", "|").alias("reasons"), "explanation", "candidate_count",
        F.lit("").alias("violations"))
    return listed.unionByName(bad.select("proposal_id", F.array_join("violations", "|").alias("violations")), allowMissingColumns=True)


@register(sql.query("""
SELECT r.proposal_id, r.rank, r.id, r.title, r.domain, r.language, r.description, r.semantic_score, r.lexical_score,
       r.final_score FROM ranked r WHERE r.rank <= 5""", *ALL[:4]))
def top_matches(spark, sf):
    done = screen.screen(views.proposals(spark, sf), views.library(spark, sf), PLAIN)
    listed = done.select("proposal_id", F.posexplode("top_matches").alias("place", "m"))
    return listed.select(
        "proposal_id", (F.col("place") + 1).alias("rank"), "m.id", "m.title", "m.domain", "m.language",
        "m.description", "m.semantic_score", "m.lexical_score", "m.final_score",
    )


@register(None)
def verdicts_with_phonetics(spark, sf):
    """Verdicts under the default weights."""
    done = screen.screen(views.proposals(spark, sf), views.library(spark, sf), CFG)
    return done.select(
        "proposal_id", "verification_id", "decision", "risk", "final_score", "score_breakdown.semantic_score",
        "score_breakdown.lexical_score", "score_breakdown.phonetic_score",
        F.array_join("reasons", "|").alias("reasons"), "explanation", "candidate_count",
    )


_INTAKE = """
accepted AS (SELECT v.* FROM verdicts v JOIN asked a USING (proposal_id)
             WHERE length(a.title) BETWEEN 1 AND 500 AND coalesce(length(a.description), 0) <= 2000),
first_ok AS (SELECT normalized_title, min(seq) AS first_seq FROM accepted
             WHERE record_status = 'approved' AND normalized_title <> '' GROUP BY normalized_title),
numbered AS (
  SELECT v.*, row_number() OVER (ORDER BY v.seq) + (SELECT max(id) FROM corpus) AS submission_id,
         coalesce(first_seq < v.seq, false) AS late, f.first_seq
  FROM accepted v LEFT JOIN first_ok f USING (normalized_title)),
intake AS (
  SELECT n.submission_id, n.proposal_id, n.seq, n.norm_domain AS domain,
         CASE WHEN late THEN 'rejected' ELSE n.record_status END AS record_status,
         CASE WHEN late THEN 'POTENTIAL_CONFLICT' ELSE n.decision END AS decision,
         CASE WHEN late THEN 'HIGH' ELSE n.risk END AS risk,
         CASE WHEN late THEN 1.0::DOUBLE ELSE n.final_score END AS final_score,
         CASE WHEN late THEN 'A potential conflict was detected (Risk: HIGH). The proposed title ''' || n.q_title
                || ''' closely matches existing title ''' || f.q_title || ''' with a score of 1.00.'
              ELSE n.explanation END AS explanation,
         CASE WHEN late THEN concat_ws('|', 'Exact normalized title match found',
                CASE WHEN n.norm_domain NOT IN ('', 'unknown') AND (n.norm_domain = f.norm_domain OR EXISTS (
                  SELECT 1 FROM ranked r WHERE r.proposal_id = n.proposal_id AND r.rank <= 2 AND r.domain = n.norm_domain))
                THEN 'Same domain as closest matching title' END) ELSE n.reasons END AS reasons,
         n.candidate_count + late::INT AS candidate_count
  FROM numbered n LEFT JOIN accepted f ON n.late AND f.seq = n.first_seq)
"""


@register(sql.query("SELECT * EXCLUDE (domain) FROM intake", *ALL, _INTAKE))
def submissions(spark, sf):
    """A batch of submissions in arrival order, each seeing the approved ones before it."""
    done = submit.submit(views.proposals(spark, sf), views.library(spark, sf), PLAIN).results
    return done.select(
        "submission_id", "proposal_id", "seq", "record_status", "decision", "risk", "final_score", "explanation",
        F.array_join("reasons", "|").alias("reasons"), "candidate_count",
    )


@register(sql.query("""
SELECT i.submission_id AS id, a.title, a.normalized_title, a.description, i.domain, a.domain AS raw_domain, a.language,
       'user_submitted' AS language_source, i.record_status, 'user_submission' AS source_file
FROM intake i JOIN asked a USING (proposal_id)""", *ALL, _INTAKE))
def submitted_records(spark, sf):
    done = submit.submit(views.proposals(spark, sf), views.library(spark, sf), PLAIN).records
    return done.select("id", "title", "normalized_title", "description", "domain", "raw_domain", "language",
                       "language_source", "record_status", "source_file")


@register(None)
def streamed_submissions(spark, sf):
    """The proposals arriving as a file stream, screened batch by batch."""
    import uuid

    from titlesieve.streaming import intake

    base = f"{ensure_checkpoint_dir(spark)}/stream-{uuid.uuid4().hex}"
    views.proposals(spark, sf).repartitionByRange(2, "seq").write.parquet(f"{base}/in")
    library = views.library(spark, sf)
    arriving = intake.read_proposals(spark, f"{base}/in")
    query = intake.screen_stream(arriving, library, f"{base}/out", f"{base}/state", CFG, availableNow=True)
    query.awaitTermination()
    return spark.read.parquet(f"{base}/out/results").select(
        "proposal_id", "seq", "submission_id", "record_status", "decision", "final_score", "candidate_count")


# ---------------------------------------------------------------- index, clusters, reports

@register(sql.query("""
SELECT id, row_number() OVER (ORDER BY id) - 1 AS position FROM usable""", sql.BASE))
def index_positions(spark, sf):
    rows = exact.usable(views.raw_titles(spark, sf)).select("id")
    return with_ordinal(rows, "id", "position").select("id", "position")


@register(sql.query("SELECT cluster_id, i, round(mean, 5) AS mean, size FROM ("
                    "SELECT cluster_id, unnest(centroid)::DOUBLE AS mean, generate_subscripts(centroid, 1) - 1 AS i, size"
                    " FROM centroids)", sql.BASE))
def label_centroids(spark, sf):
    model = views.centroids(spark, sf).select("cluster_id", "size", F.posexplode("centroid").alias("i", "mean"))
    return model.select("cluster_id", F.col("i").cast("long").alias("i"),
                        F.round(F.col("mean").cast("double"), 5).alias("mean"), "size")


@register(sql.query("SELECT cluster_id, count(*) AS size FROM corpus GROUP BY cluster_id", sql.BASE))
def cluster_sizes(spark, sf):
    return clusters.cluster_sizes(views.corpus(spark, sf))


@register(sql.query("""
SELECT CASE WHEN count(*) > 0 THEN 'healthy' ELSE 'degraded' END AS status, count(*) > 0 AS index_loaded,
       count(*) AS vector_count, count(DISTINCT id) = count(*) AS ids_unique,
       count(*) FILTER (id NOT IN (SELECT id FROM corpus)) AS orphan_vectors,
       (SELECT count(*) FROM centroids) AS cluster_count, 'hashing-tf-idf' AS embedding_model FROM vectors""", sql.BASE))
def index_health(spark, sf):
    """Without the time of the report, which no two runs share."""
    vectors = views.vectors(spark, sf)
    meta = index.index_meta(vectors, HashingEncoder.name, 64, {"model": HashingEncoder.name})
    return status.index_health(views.corpus(spark, sf), vectors, views.centroids(spark, sf), meta).drop("checked_at")


@register(sql.query("""
SELECT 'domain' AS dimension, domain AS value, count(*) AS rows FROM corpus GROUP BY domain
UNION ALL SELECT 'cluster_id', cluster_id::VARCHAR, count(*) FROM corpus GROUP BY cluster_id
UNION ALL SELECT 'record_status', record_status, count(*) FROM corpus GROUP BY record_status
UNION ALL SELECT 'language', language, count(*) FROM corpus GROUP BY language""", sql.BASE))
def corpus_statistics(spark, sf):
    return status.corpus_statistics(views.corpus(spark, sf))


@register("""
SELECT count(value) AS query_count, printf('%.2f', avg(value))::DOUBLE AS mean_ms,
       printf('%.2f', quantile_cont(value, 0.5))::DOUBLE AS median_ms,
       printf('%.2f', quantile_cont(value, 0.95))::DOUBLE AS p95_ms,
       printf('%.2f', quantile_cont(value, 0.99))::DOUBLE AS p99_ms,
       printf('%.2f', min(value))::DOUBLE AS min_ms, printf('%.2f', max(value))::DOUBLE AS max_ms,
       quantile_cont(value, 0.95) < 500 AS meets_target_under_500ms FROM events""")
def latency_summary(spark, sf):
    return status.latency_summary(views.table(spark, sf, "events"), "value")


@register(None)
def encoded_titles(spark, sf):
    """Corpus texts through the default encoder, as index rows."""
    ship_package(spark)
    rows = index.texts(views.raw_titles(spark, sf))
    encoder = HashingEncoder(CFG.dimension).fit(rows, "text")
    built = index.index_rows(encoder.encode(rows, "text"))
    length = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    return built.select("id", "position", F.size("embedding").alias("dimension"), F.round(length, 3).alias("length"))


@register(None)
def fitted_clusters(spark, sf):
    """K-means over the corpus vectors with the restarts and iterations of production."""
    assigned, _ = clusters.fit_clusters(views.vectors(spark, sf), ScreeningConfig())
    return clusters.cluster_sizes(assigned)
