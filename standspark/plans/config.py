"""Configuration: nested blocks with defaults; unknown keys and contradictions are refused."""

from __future__ import annotations

import dataclasses
import json
import typing
from dataclasses import dataclass, field
from datetime import date


class ConfigError(ValueError):
    """A configuration can't be used."""


def _choice(name: str, value, allowed) -> None:
    if value not in allowed:
        raise ConfigError(f"{name} is one of {', '.join(map(str, allowed))}, not {value!r}")


def _between(name: str, value, low, high) -> None:
    if not low <= value <= high:
        raise ConfigError(f"{name} lies between {low} and {high}, not at {value}")


@dataclass
class DateWindow:
    """Both ends belong to the window."""

    start: str
    end: str

    def __post_init__(self):
        if date.fromisoformat(self.start) > date.fromisoformat(self.end):
            raise ConfigError(f"window from {self.start} to {self.end}")


@dataclass
class Roi:
    name: str
    roi_file: str | None = None
    roi_asset: str | None = None

    def __post_init__(self):
        if bool(self.roi_file) == bool(self.roi_asset):
            raise ConfigError("exactly one of roi_file and roi_asset")


@dataclass
class Dates:
    phenology: DateWindow
    radar: DateWindow
    optical_composite: DateWindow
    climate: DateWindow = field(default_factory=lambda: DateWindow("1991-01-01", "2020-12-31"))


@dataclass
class CloudMask:
    max_cloud_pct: float = 20
    drop_classes: list[int] = field(default_factory=lambda: [3, 8, 9, 10])


@dataclass
class DataLoad:
    orbit: str = "ASCENDING"
    polarizations: list[str] = field(default_factory=lambda: ["VV", "VH"])
    mode: str = "IW"
    composite_reducer: str = "median"

    def __post_init__(self):
        _choice("composite_reducer", self.composite_reducer, ("median", "p25", "p50", "p75"))
        _choice("orbit", self.orbit, ("ASCENDING", "DESCENDING"))


@dataclass
class Optical:
    index: str = "ndvi"
    harmonic: str = "single"
    trend: bool = True
    time_reference: str = "2017-01-01"
    mean_over_window: bool = False

    def __post_init__(self):
        _choice("index", self.index, ("ndvi", "nirv"))
        _choice("harmonic", self.harmonic, ("single", "dual"))


@dataclass
class Radar:
    percentiles: list[int] = field(default_factory=lambda: [10, 50, 90])
    iqr: bool = True
    contrast: bool = True


@dataclass
class Structure:
    neighbourhood_stats: bool = True
    kernel: int = 3

    def __post_init__(self):
        if self.kernel % 2 == 0 or not 3 <= self.kernel <= 11:
            raise ConfigError("kernel is odd, from 3 to 11")


@dataclass
class Static:
    climate: bool = True
    max_distance_px: int = 1000
    cap: bool = False


@dataclass
class Embedding:
    collapse: str = "mean"
    bands: list[str] | None = None

    def __post_init__(self):
        _choice("collapse", self.collapse, ("mean", "median"))


@dataclass
class Masking:
    habitat_classes: list[int] = field(default_factory=lambda: [6, 12])
    fallback_classes: list[int] = field(default_factory=lambda: [10, 20, 30])
    water_threshold: float = 50
    first_year: int | None = None
    last_year: int | None = None


@dataclass
class Segmentation:
    size: int = 10
    compactness: float = 0.5
    connectivity: int = 8
    neighbourhood: int = 128
    zscore: bool = True
    scale_by_adjacent: bool = True
    bands: list[str] = field(default_factory=lambda: ["*"])
    mask_before: bool = False

    def __post_init__(self):
        _choice("connectivity", self.connectivity, (4, 8))


@dataclass
class Merge:
    tolerances: dict[str, float] = field(default_factory=lambda: {"canopy": 2.0, "amplitude": 0.030})
    relax_factor: float = 1.75
    min_area_ha: float = 1
    max_area_ha: float = 10
    min_defined: int = 2
    min_frac_valid: float = 0.5
    max_sweeps: int = 60
    soft_ceiling: bool = False
    exclude_below_min: bool = False
    max_regions: int = 50000

    def __post_init__(self):
        if self.min_area_ha > self.max_area_ha:
            raise ConfigError("min_area_ha is over max_area_ha")
        if self.relax_factor < 1:
            raise ConfigError("relax_factor is at least 1")


@dataclass
class Clustering:
    k: int = 6
    seed: int = 42
    sources: list[str] = field(default_factory=lambda: ["optical", "radar", "structure", "static"])
    skew_threshold: float = 1.0
    log_rule: str = "abs_skew"
    off_engine: bool = False
    exclude_undersized_from_fit: bool = False

    def __post_init__(self):
        _between("k", self.k, 2, 50)
        _choice("log_rule", self.log_rule, ("abs_skew", "right_skew"))


@dataclass
class Normalization:
    method: str = "robust"

    def __post_init__(self):
        _choice("method", self.method, ("zscore", "robust"))


@dataclass
class Elbow:
    k_min: int = 2
    k_max: int = 12
    seed: int = 42
    n_init: int = 25
    in_fit_space: bool = False

    def __post_init__(self):
        if self.k_max - self.k_min < 2:
            raise ConfigError("an elbow needs three points")


@dataclass
class Export:
    geotiff: bool = True
    scale_m: float = 10
    vector_formats: list[str] = field(default_factory=lambda: ["shp", "geojson"])
    min_pixels: int = 4


@dataclass
class Metrics:
    reference_config: str | None = None
    n_pairs: int = 10000
    per_cluster: int = 833
    r2_attributes: list[str] = field(default_factory=list)
    held_out: list[str] = field(default_factory=list)


@dataclass
class Config:
    roi: Roi
    dates: Dates
    cloud_mask: CloudMask = field(default_factory=CloudMask)
    data_load: DataLoad = field(default_factory=DataLoad)
    features_optical: Optical = field(default_factory=Optical)
    features_radar: Radar = field(default_factory=Radar)
    features_structure: Structure = field(default_factory=Structure)
    features_static: Static = field(default_factory=Static)
    features_embedding: Embedding = field(default_factory=Embedding)
    masking: Masking = field(default_factory=Masking)
    segmentation: Segmentation = field(default_factory=Segmentation)
    merge: Merge | None = None
    clustering: Clustering = field(default_factory=Clustering)
    normalization: Normalization = field(default_factory=Normalization)
    k_elbow: Elbow | None = None
    export: Export = field(default_factory=Export)
    metrics: Metrics | None = None

    def __post_init__(self):
        c = self.clustering
        if c.exclude_undersized_from_fit and self.merge is None:
            raise ConfigError("leaving undersized stands out of the fit needs a merge")
        if self.k_elbow and self.k_elbow.in_fit_space and not c.off_engine:
            raise ConfigError("an elbow in the fit's space needs the off-engine fit")
        if c.log_rule == "right_skew" and not c.off_engine:
            raise ConfigError("right_skew needs the off-engine fit")
        if c.off_engine and self.normalization.method != "robust":
            raise ConfigError("the off-engine fit needs robust scaling")
        if self.metrics and self.merge and set(self.metrics.held_out) & set(self.merge.tolerances):
            raise ConfigError("a held-out band decides merges")


def build(kind, values: dict, path: str = ""):
    """A block from a mapping, its blocks likewise; unknown and missing keys are named."""
    if not isinstance(values, dict):
        raise ConfigError(f"{path or 'configuration'} is a block")
    fields = {f.name: f for f in dataclasses.fields(kind)}
    if unknown := sorted(set(values) - set(fields)):
        raise ConfigError(f"unknown: {', '.join(f'{path}{k}' for k in unknown)}")
    hints, out = typing.get_type_hints(kind), {}
    for name, value in values.items():
        inner = next((t for t in (hints[name], *typing.get_args(hints[name])) if dataclasses.is_dataclass(t)), None)
        out[name] = build(inner, value, f"{path}{name}.") if inner and value is not None else value
    missing = [n for n, f in fields.items() if n not in out and f.default is dataclasses.MISSING and f.default_factory is dataclasses.MISSING]
    if missing:
        raise ConfigError(f"missing: {', '.join(f'{path}{k}' for k in missing)}")
    return kind(**out)


def load(path: str) -> Config:
    """A configuration from JSON, or from YAML where a YAML reader is installed."""
    with open(path, encoding="utf-8") as f:
        text = f.read()
    if path.endswith(".json"):
        return build(Config, json.loads(text))
    import yaml

    return build(Config, yaml.safe_load(text))


def without_defaults(block) -> dict:
    """What a block sets besides its defaults, so that a new option with a default changes nothing."""
    out = {}
    for f in dataclasses.fields(block):
        value = getattr(block, f.name)
        default = f.default if f.default is not dataclasses.MISSING else f.default_factory() if f.default_factory is not dataclasses.MISSING else None
        if value == default:
            continue
        out[f.name] = without_defaults(value) if dataclasses.is_dataclass(value) else value
    return out
