"""Job parameters (frozen dataclasses).

"""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class RecommenderParams:
    top_k: int = 3
    min_score: float = 0.05
    similar_users: int = 20
    # Similarity universe cap (most active users).  None = every user.
    max_users_matrix: int | None = None
    w_collaborative: float = 0.40
    w_popularity: float = 0.30
    w_history: float = 0.20
    w_novelty: float = 0.10
    expand_factor: int = 4
    audience_bonus: float = 1.3
    region_weight: float = 0.5
    # Audience match: literal "contains" by default, regex when True (Q9).
    audience_regex: bool = False
    # Collaborative component ignores the active flag in the reference (Q12).
    collaborative_require_active: bool = False
    # Courses with more raters than this never join their raters with one another.
    hot_raters: int = 1000
    strict_weights: bool = True

    def __post_init__(self):
        total = self.w_collaborative + self.w_popularity + self.w_history + self.w_novelty
        if self.strict_weights and not (0.99 < total < 1.01):
            raise ValueError(f"recommender weights sum to {total:.2f}, expected 1.0")
        if min(self.w_collaborative, self.w_popularity, self.w_history, self.w_novelty) < 0:
            raise ValueError("recommender weights must be non-negative")
        if self.top_k <= 0:
            raise ValueError("top_k must be positive")

    @property
    def expand(self) -> int:
        return self.top_k * self.expand_factor

    @property
    def weights(self) -> dict:
        return {
            "colaborativo": self.w_collaborative,
            "popularidad": self.w_popularity,
            "historial": self.w_history,
            "novedad": self.w_novelty,
        }


@dataclass(frozen=True)
class RouterParams:
    high: float = 0.82
    gap: float = 0.03
    low: float = 0.60
    candidates: int = 3
    chunk_top_k: int = 10
    general_kb: str = "general"
    # Queries per block / chunks per block in the blocked dot-product search.
    block_rows: int = 4096
    # Centroids per collection of the chunk search; 0: no index, every block is searched (the rows are the same).
    cells: int = 0
