"""Tunables of the engine, with their defaults."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class Settings:
    # Field weights of the token soup.
    soup_weights: dict = field(default_factory=lambda: {"genres": 3, "director": 3, "cast": 1, "keywords": 2, "overview": 1, "writers": 1, "collection": 2, "decade": 1})
    feature_version: int = 2
    search_version: int = 2
    min_df: int = 2
    min_soup_tokens: int = 8
    like_threshold: float = 3.5
    dislike_threshold: float = 2.0
    unrated: float = 4.0
    up_rating: float = 5.0
    down_rating: float = 0.5
    negative_weight: float = 0.3
    max_liked: int = 60
    min_search_score: float = 55.0
    min_z: float = 2.5
    z_retain: float = 0.55
    reference_weight: float = 0.75
    query_weight: float = 0.5
    guard_rows: int = 10
    top_n: int = 8
    rerank_pool: int = 15
    final_n: int = 3
    taste_top_k: int = 3
    centroid_weight: float = 0.5
    collab_factors: int = 256
    collab_min_rating: float = 3.5
    collab_min_ratings: int = 20
    signal_weights: dict = field(default_factory=lambda: {"metadata": 0.40, "semantic": 0.40, "collab": 0.20, "graph": 0.0})
    query_signal_weights: dict = field(default_factory=lambda: {"metadata": 0.25, "semantic": 0.75, "collab": 0.0, "graph": 0.0})
    profile_ttl_s: int = 21_600
    rate_limit_s: float = 3.0
    #: Rows up to which a side of a join is broadcast; its size is counted first.
    broadcast_rows: int = 500_000

    def weights(self, context: str) -> dict:
        """Signal weights of a context: "query" for typed moods, "reference" for everything else."""
        return self.query_signal_weights if context == "query" else self.signal_weights


DEFAULTS = Settings()
