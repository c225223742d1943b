"""Defaults of the engine; every operator takes its own values as arguments."""

from __future__ import annotations

import os
from collections.abc import Mapping
from dataclasses import dataclass, fields


@dataclass(frozen=True)
class EngineConf:
    """The service's published defaults, by group."""

    # flow control
    bucket_rate: float = 10.0
    bucket_burst: float = 10.0
    bucket_max_wait_ms: int = 30_000
    breaker_window_ms: int = 10_000
    breaker_min_volume: int = 10
    breaker_failure_ratio: float = 0.5
    breaker_cooldown_ms: int = 5_000
    breaker_max_probes: int = 3
    breaker_probe_successes: int = 2
    aimd_min_rate: float = 1.0
    aimd_max_rate: float = 10.0
    aimd_decrease: float = 0.7
    aimd_increase: float = 1.0
    aimd_successes: int = 20
    aimd_refractory_ms: int = 1_000
    aimd_slo_ms: float = 4_500.0
    aimd_ring: int = 100
    aimd_min_samples: int = 20
    aimd_latency_floor: float = 0.5
    admission_high: int = 5_000
    admission_low_ratio: float = 0.8
    admission_retry_cap_s: int = 300
    # retries and page budget
    retry_attempts: int = 3
    retry_base_ms: int = 200
    retry_cap_ms: int = 5_000
    page_deadline_s: int = 300
    page_degrade_s: int = 90
    requeue_pause_s: float = 0.5
    max_requeues: int = 50
    fallback_confidence: float = 0.4
    # recovery and results
    reaper_idle_ms: int = 30_000
    reaper_batch: int = 64
    result_maxlen: int = 256
    result_history: int = 512
    result_retry_ms: int = 2_000
    subscriber_slots: int = 64
    # evaluation
    iou_threshold: float = 0.5
    max_nodes: int = 2_000
    ted_budget_ms: int = 100
    ted_work_per_ms: int = 1_800
    # model side
    idempotency_ttl_s: int = 300
    idempotency_entries: int = 20_000
    # ingest
    max_pages: int = 100
    document_age_s: int = 900

    @property
    def max_ted_work(self) -> int:
        return self.ted_budget_ms * self.ted_work_per_ms

    @property
    def effective_max_requeues(self) -> int:
        return max(self.max_requeues, int(self.page_degrade_s / self.requeue_pause_s) * 2)

    @property
    def admission_low(self) -> int:
        return max(1, int(self.admission_high * self.admission_low_ratio))

    def __post_init__(self):
        """Settings out of bounds are refused: nothing is below zero, shares are at most one, and what
        something is divided by or counted up to is above zero."""
        for f in fields(self):
            value = getattr(self, f.name)
            least = 0 if f.name in ZERO else 1e-9
            most = 1 if f.name in SHARES else float("inf")
            if isinstance(value, bool) or not isinstance(value, int | float) or not least <= value <= most:
                raise ValueError(f"{f.name} must be between {least:g} and {most:g}, got {value!r}")
        if self.aimd_min_rate > self.aimd_max_rate:
            raise ValueError("aimd_min_rate must not be above aimd_max_rate")

    @classmethod
    def from_env(cls, env: Mapping[str, str] = os.environ, prefix: str = "QUILLSPARK_") -> EngineConf:
        """The defaults, but for what the environment sets, as in QUILLSPARK_BUCKET_RATE=20."""
        found = {f.name: env[prefix + f.name.upper()] for f in fields(cls) if prefix + f.name.upper() in env}
        kinds = {f.name: type(f.default) for f in fields(cls)}
        try:
            return cls(**{name: kinds[name](text) for name, text in found.items()})
        except ValueError as e:
            raise ValueError(f"in the environment: {e}") from e


#: Settings that may be zero, and those that are shares.
ZERO = frozenset("bucket_max_wait_ms breaker_cooldown_ms aimd_refractory_ms aimd_slo_ms requeue_pause_s max_requeues iou_threshold retry_base_ms fallback_confidence ted_budget_ms ted_work_per_ms max_nodes".split())
SHARES = frozenset("breaker_failure_ratio aimd_decrease aimd_latency_floor admission_low_ratio iou_threshold fallback_confidence".split())
