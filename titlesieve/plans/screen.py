"""Screening a table of proposals against a corpus: retrieval, scoring, verdicts."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import ScreeningConfig
from ..functions.phonetic import phonetic_code
from ..functions.text import normalize_title
from ..functions.vectors import unit
from ..operators import candidates as cand
from ..operators import clusters, decisions, exact, fuzzy, knn
from ..session import cut_lineage, ship_package
from ..sources.store import TitleStore
from .derived import read_derived
from .requests import split_requests, with_defaults


@dataclass(frozen=True)
class Library:
    """What proposals are screened against. ``corpus`` is the record table, ``vectors`` the index
    (id, unit embedding), ``centroids`` the cluster model; without the last, nothing is clustered.
    ``heads``, ``titles`` and ``largest_id`` come from the derived tables, if there are any (see
    ``plans.derived``); without them the corpus is aggregated for every batch."""

    corpus: DataFrame
    vectors: DataFrame
    centroids: DataFrame | None = None
    heads: DataFrame | None = None
    titles: DataFrame | None = None
    largest_id: int | None = None
    dimension: int | None = None


class IndexNotReady(RuntimeError):
    """The vector index is missing, empty or does not match its metadata."""


def load_library(store: TitleStore) -> Library:
    """The published tables of a store, refused when the index is unusable."""
    if not store.exists("vectors"):
        raise IndexNotReady("no vector index has been published")
    vectors, meta = store.read("vectors"), store.read("index_meta").first()
    if meta is None or meta["record_count"] != vectors.count():
        raise IndexNotReady("the vector index does not match its metadata")
    centroids = store.read("centroids") if store.exists("centroids") else None
    heads, titles, largest = read_derived(store) or (None, None, None)
    return Library(store.read("corpus"), vectors, centroids, heads, titles, largest, meta["dimension"])


def prepare_proposals(proposals: DataFrame, library: Library, cfg: ScreeningConfig) -> DataFrame:
    """Everything about a proposal that is the same for all its pairs, computed before pairing."""
    ship_package(proposals.sparkSession)
    if library.vectors.isEmpty():
        raise IndexNotReady("the vector index is empty")
    keyed = proposals.withColumn("normalized_title", normalize_title(F.col("title"))).withColumns({
        "phonetic_code": phonetic_code(F.col("title"), F.col("normalized_title")),
        "embedding": unit(F.col("embedding")),
    })
    if library.centroids is None:
        probed = keyed.withColumn("cluster_ids", F.array().cast("array<int>"))
    else:
        ids, model = clusters.load_model(library.centroids, cfg)
        probed = clusters.with_nearest_clusters(keyed, ids, model, cfg.cluster_top_n)
    # every pass reads this table, so it is computed once and kept on shared storage
    return cut_lineage(probed)


def is_small(prepared: DataFrame, cfg: ScreeningConfig) -> bool:
    """The batch is small enough to be sent to the tasks that scan the corpus."""
    return prepared.limit(cfg.small_batch_rows + 1).count() <= cfg.small_batch_rows


def lexical_hits(prepared: DataFrame, library: Library, cfg: ScreeningConfig, clustered: bool, small: bool) -> DataFrame:
    if not clustered or library.titles is None:
        return fuzzy.fuzzy_hits(*fuzzy.scope(prepared, library.corpus, cfg, clustered), cfg)
    if small:
        return fuzzy.hits_by_scan(prepared, library.titles, cfg)
    asked = [r[0] for r in prepared.select(F.explode("cluster_ids")).distinct().collect()]  # clusters of the bounded model
    return fuzzy.fuzzy_hits(fuzzy.probe_rows(prepared), fuzzy.merged_titles(library.titles, asked), cfg)


def retrieve_candidates(prepared: DataFrame, library: Library, cfg: ScreeningConfig, small: bool = False) -> tuple[DataFrame, DataFrame]:
    """(candidates, exact heads). Candidates hold every semantic and lexical one, and of the exact
    pass the rows a verdict can look at; the heads hold the pass's full size. A ``small`` batch (see
    :func:`is_small`) is sent to the scans of corpus and index; nothing of their size is shuffled then if the
    library has derived tables."""
    clustered, model = False, None
    if library.centroids is not None:
        ids, model = clusters.load_model(library.centroids, cfg)
        clustered = len(ids) > 0
    if small:
        semantic = knn.nearest_by_scan(prepared, library.vectors, cfg.vector_fetch, cfg)
    else:
        semantic = knn.nearest_neighbours(prepared, library.vectors, cfg.vector_fetch, cfg, model)
    lexical = lexical_hits(prepared, library, cfg, clustered, small)
    if library.heads is None:
        heads = exact.exact_heads(prepared, library.corpus, cfg.head_rows)
    else:
        heads = exact.stored_heads(prepared, library.heads, cfg.head_rows, cfg)
    named = heads.select("proposal_id", F.explode("exact_ids").alias("id"))
    pairs = cand.attach_records(cand.merge_passes(semantic, lexical, named), library.corpus, prepared, small)
    return cand.admit(pairs, cfg), heads


def all_candidates(prepared: DataFrame, library: Library, cfg: ScreeningConfig) -> DataFrame:
    """The whole candidate union, every exact pair spelled out. Screening itself goes by the heads of the exact
    pass, which say the same about a verdict without listing the holders of a common title."""
    clustered, model = False, None
    if library.centroids is not None:
        ids, model = clusters.load_model(library.centroids, cfg)
        clustered = len(ids) > 0
    semantic = knn.nearest_neighbours(prepared, library.vectors, cfg.vector_fetch, cfg, model)
    lexical = fuzzy.fuzzy_hits(*fuzzy.scope(prepared, library.corpus, cfg, clustered), cfg)
    # read for the hits themselves and for those of them that are exact pairs: searched once
    hits = cut_lineage(cand.merge_passes(semantic, lexical))
    found = cand.admit(cand.attach_records(hits, library.corpus, prepared), cfg)
    return cand.with_exact_pairs(found, library.corpus, prepared, cfg)


def ranked_candidates(prepared: DataFrame, library: Library, cfg: ScreeningConfig, small: bool = False) -> tuple[DataFrame, DataFrame]:
    found, heads = retrieve_candidates(prepared, library, cfg, small)
    return cand.rank_candidates(cand.score_candidates(found, cfg)), heads


def screen(proposals: DataFrame, library: Library, cfg: ScreeningConfig = ScreeningConfig()) -> DataFrame:
    """One verdict per proposal (proposal_id, title, domain, embedding, ...), missing domains and languages by
    their defaults. Nothing is rejected here: requests from outside go through :func:`verify`."""
    return verdicts_of(prepare_proposals(with_defaults(proposals), library, cfg), library, cfg)


def verify(requests: DataFrame, library: Library, cfg: ScreeningConfig = ScreeningConfig()) -> tuple[DataFrame, DataFrame]:
    """(verdicts, rejected): the requests that keep the field limits and bring a usable vector are screened, the
    others come back with their ``violations``."""
    good, bad = split_requests(requests, library.dimension)
    return screen(good, library, cfg), bad


def verdicts_of(prepared: DataFrame, library: Library, cfg: ScreeningConfig) -> DataFrame:
    small = is_small(prepared, cfg)
    ranked, heads = ranked_candidates(prepared, library, cfg, small)
    return decisions.verdicts(prepared, decisions.summarise(ranked, library.corpus, cfg, small), heads, cfg)
