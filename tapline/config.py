"""Thresholds and weights, passed to operators and folded into the plan as literals."""

from __future__ import annotations

from dataclasses import dataclass, field

SECOND = 1_000_000  # all event times are integer microseconds


@dataclass(frozen=True)
class Config:
    # behaviour rules (thresholds are inclusive)
    port_scan_ports: int = 20
    port_scan_us: int = 2 * SECOND
    host_sweep_hosts: int = 15
    host_sweep_us: int = 2 * SECOND
    beacon_min_events: int = 5
    beacon_us: int = 10 * SECOND
    beacon_min_mean_us: int = 200_000
    beacon_max_jitter: float = 0.15
    rst_storm_count: int = 25
    rst_storm_us: int = 10 * SECOND
    # A hot source is split into time chunks of this length; each chunk also receives the
    # rows of the preceding horizon, so per-chunk answers are exact.
    chunk_us: int = 40 * SECOND
    # For sources too dense for a chunk: counts on two levels, in slots no longer than a horizon (0: by chunks).
    behaviour_slot_us: int = 0

    # correlation, flows
    incident_gap_us: int = 10 * SECOND
    incident_evidence: int = 10
    flow_idle_us: int = 60 * SECOND
    flow_age_us: int = 300 * SECOND
    flow_sweep_us: int = 5 * SECOND
    flow_slice_us: int = 5 * SECOND  # packets of a pair are reduced per slice, which divides the sweep; shorter ones spread a dense pair
    flow_iat_keep: int = 100
    flow_len_keep: int = 50

    # sliding windows: membership is (end - size, end]
    window_us: int = 5 * SECOND
    slide_us: int = 1 * SECOND
    slot_us: int = 100_000
    origin_us: int = 0
    iat_mode: str = "exact"  # "double" differences epoch doubles and keeps their rounding noise
    # Windows up to this many events are transformed as one array; larger ones take the
    # distributed transform in operators/bigfft.py.
    fft_array_limit: int = 1 << 20

    # scoring
    fusion_weights: dict[str, float] = field(default_factory=lambda: {
        "xgboost": 0.40, "lstm": 0.20, "fft": 0.15, "kitsune": 0.15, "isolation_forest": 0.10,
    })
    risk_critical: float = 0.85
    risk_warning: float = 0.60
    risk_info: float = 0.35
    asset_criticality: float = 0.5
    persistence_windows: int = 3
    persistence_score: float = 0.5
    cooldown_us: int = 30 * SECOND
    kitsune_decay: float = 0.95

    # moving baseline
    ewma_alpha: float = 0.1
    ewma_warmup: int = 20
    zscore_flag: float = 3.0
    zscore_critical: float = 5.0
    composite_flag: float = 0.65

    # reputation
    abuse_min_score: int = 40
    intel_hit_ttl_us: int = 86_400 * SECOND
    intel_clean_ttl_us: int = 3_600 * SECOND

    # retention
    keep_flows: int = 50_000
    keep_alerts: int = 10_000


DEFAULT = Config()
