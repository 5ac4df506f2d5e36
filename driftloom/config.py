"""Parameters of the tracking operators: fixed values of the published runs, with presets."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class TrackingConfig:
    """Distances are in micrometres, coordinates in voxels; all gates are inclusive."""

    voxel: tuple[float, float, float] = (1.625, 0.40625, 0.40625)  # of z, y, x
    threshold: float = 0.3
    min_distance: int = 3
    nms_radius: float = 0.0
    tight_gate: float = 6.0
    loose_gate: float = 8.0
    velocity_blend: float = 0.5
    max_gap: int = 1
    gap_distance: float = 6.0
    min_track_nodes: int = 4
    match_gate: float = 7.0
    division_radius: float = 10.0
    division_angle: float = 75.0
    daughter_chain: int = 3
    mother_chain: int = 3
    chain_cap: int = 12
    division_dt: int = 1
    ilp_k: int = 5
    ilp_bias: float = 8.0
    ilp_appear: float = 0.1
    ilp_disappear: float = 0.1
    ilp_division: float = 1000.0
    refine_window: tuple[int, int, int] = (1, 3, 3)
    target_sigma: tuple[float, float, float] = (1.0, 3.0, 3.0)
    foreground: float = 0.15
    positive_weight: float = 10.0
    near_eps: float = 0.05
    dilate: int = 2


V0 = TrackingConfig(threshold=0.08, tight_gate=8.0, loose_gate=8.0)
V2 = TrackingConfig()
V2_5 = TrackingConfig(threshold=0.15, min_distance=1, nms_radius=3.0, loose_gate=10.0, min_track_nodes=2)
V2_5B = TrackingConfig(threshold=0.15, min_distance=1, nms_radius=3.0)
V3 = TrackingConfig()
