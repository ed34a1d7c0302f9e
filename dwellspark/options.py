"""Settings of the activity operators, with the defaults of desktop tracking."""

from dataclasses import dataclass


@dataclass(frozen=True)
class FeatureOptions:
    """Fixed windows, deep-work rule and how switches are counted.

    ``count_mode`` is "rows" (every dwell row that touches the window, heartbeat
    pieces too) or "windows" (different opened windows).
    """

    window_ms: int = 30_000
    deep_ms: int = 20_000
    deep_idle: float = 0.35
    deep_switches: int = 1
    deep_distraction_ms: int | None = None
    count_mode: str = "rows"
    extra_flags: bool = False
    night_from: int = 22
    night_to: int = 6


@dataclass(frozen=True)
class SemanticOptions:
    """Score thresholds, calibration guards and the dwell below which nothing is said."""

    t_on: float = 0.50
    t_off: float = 0.30
    t_on_floor: float = 0.45
    min_dwell_ms: int = 2_000
    boost: float = 0.15
    min_samples: int = 100
    min_mean: float = 0.30
    p_on: float = 0.80
    p_off: float = 0.50
    force_fixed: bool = False


HEARTBEAT_MS = 30_000
FLUSH_MS = 10_000
CONFIRM_MS = 3_000
CATEGORIES = ("code", "docs", "video", "social", "game", "other")
