"""Parameters of the detectors. The defaults are part of the published semantics."""

from dataclasses import dataclass


@dataclass(frozen=True)
class DetectionSettings:
    # The documented defaults.
    window_days: int = 28
    min_samples: int = 10
    fence_factor: float = 1.5
    contamination: float = 0.05
    forest_min_rows: int = 100
    forest_window_days: int = 91
    forest_trees: int = 100
    forest_sample: int = 256
    forest_seed: int = 42
    flexible_min_values: int = 10
    flexible_forest_min_rows: int = 20


DEFAULTS = DetectionSettings()

DETECTION_METRICS = ("sold", "delta_on_hand")
INCIDENT_STATUSES = ("open", "investigating", "resolved")
