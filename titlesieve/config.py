"""Every tunable of the screening engine in one frozen object."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class ScreeningConfig:
    # retrieval
    top_k: int = 20
    vector_fetch_factor: int = 3
    cluster_top_n: int = 3
    fuzzy_floor: float = 60.0
    fallback_rows: int | None = None  # lexical scope without clusters: all usable rows, or the first so many
    # scoring
    semantic_weight: float = 0.50
    lexical_weight: float = 0.30
    phonetic_weight: float = 0.20
    # decision
    conflict_threshold: float = 0.75
    review_threshold: float = 0.50
    lexical_reason_min: float = 0.85
    semantic_reason_min: float = 0.80
    phonetic_reason_min: float = 0.80
    domain_lookback: int = 3
    top_matches: int = 5
    # dataset checks
    min_valid_titles: int = 6000
    # distinct domains a one-row report may carry as a map; the domain table itself has no bound
    max_map_entries: int = 10_000
    # clustering
    min_clusters: int = 10
    max_clusters: int = 200
    kmeans_seed: int = 42
    kmeans_restarts: int = 10
    kmeans_iterations: int = 300
    # vectors
    dimension: int = 384
    # physical sizing: rows per side of one block product
    corpus_block_rows: int = 65_536
    proposal_block_rows: int = 32_768
    title_block_rows: int = 16_384
    # characters of the titles of one side of a block, and cells of the matrices made of them at a time
    title_block_chars: int = 8_000_000
    title_matrix_cells: int = 2_000_000
    # a normal form on more rows of a side is dealt over several tasks; so many such forms may be broadcast
    hot_form_rows: int = 1_024
    most_broadcast_forms: int = 100_000
    # a batch of at most so many proposals goes to the corpus; the corpus then is scanned, not shuffled
    small_batch_rows: int = 1_024
    # tables derived from the corpus: folders of the table by normal form
    head_buckets: int = 64
    # Bloom filters that thin the corpus before it meets a larger batch
    bloom_bits_per_key: int = 16
    bloom_most_bits: int = 1 << 26
    # driver-held model rows (centroids) and cells derived from them
    max_model_rows: int = 4_096

    def __post_init__(self) -> None:
        total = self.semantic_weight + self.lexical_weight + self.phonetic_weight
        if abs(total - 1.0) >= 0.001:
            raise ValueError(f"weights must sum to 1.0, got {total}")
        if self.top_matches < 1 or self.top_k < 1:
            raise ValueError("top_matches and top_k must be positive")

    @property
    def vector_fetch(self) -> int:
        return self.top_k * self.vector_fetch_factor

    @property
    def head_rows(self) -> int:
        """How many ranked rows a verdict can ever look at."""
        return max(self.top_matches, self.domain_lookback)

    @property
    def pair_weights(self) -> tuple[float, float]:
        """Semantic and lexical weight when no phonetic score exists."""
        both = self.semantic_weight + self.lexical_weight
        if both <= 0:
            return 0.625, 0.375
        return self.semantic_weight / both, self.lexical_weight / both


USABLE_STATUSES = ("active", "approved")
