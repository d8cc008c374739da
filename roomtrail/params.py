"""Parameters of the inference steps, with the published defaults."""

from __future__ import annotations

from dataclasses import dataclass

# Look-back minutes per movement state (index 0 = lowest state),
# by number of movement states.
LOOKBACK_MINUTES: dict[int, tuple[int, ...]] = {
    2: (30, 5),
    3: (30, 10, 5),
    4: (30, 15, 10, 5),
}


@dataclass(frozen=True)
class InferenceParams:
    window_minutes: int = 5
    # movement states
    movement_candidates: tuple[int, ...] = (2, 3, 4)
    min_cluster_fraction: float = 0.05
    min_movement_cluster_windows: int = 20
    movement_silhouette_min: float = 0.25
    near_best_silhouette: float = 0.02
    # sleep
    max_motion_interruption_minutes: int = 15
    min_sleep_candidate_minutes: int = 60
    min_sleep_low_motion_share: float = 0.60
    sleep_candidates: tuple[int, ...] = (2, 3)
    sleep_min_per_cluster: int = 2
    sleep_silhouette_min: float = 0.50
    sleep_silhouette_borderline_min: float = 0.45
    sleep_borderline_center_ratio: float = 1.50
    room_dominance_share: float = 0.60
    gap_context_minutes: int = 30
    context_room_share: float = 2 / 3
    # away
    away_silhouette_min: float = 0.50
    away_silhouette_borderline_min: float = 0.45
    away_min_runs: int = 6
    away_min_per_cluster: int = 2
    away_center_ratio: float = 2.0

    @property
    def window_s(self) -> int:
        return self.window_minutes * 60
