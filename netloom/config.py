"""Run configuration: a JSON file, read into dataclasses with defaults for every key."""

from __future__ import annotations

import json
from dataclasses import dataclass, field, fields
from typing import Any


@dataclass(frozen=True)
class DataConfig:
    data_type: str = "HyperVision"
    data_path: str = ""
    label_path: str = ""
    train_ratio: float = 0.8
    data_size: int = -1
    duration_unit: str = "ms"  # of the CSV's duration column: ms or us


@dataclass(frozen=True)
class FlowConfig:
    flow_time_out: float = 10.0
    evict_flow_time_out: float = 5.0

    def __post_init__(self):
        if self.flow_time_out < 1e-5 or self.evict_flow_time_out < 1e-5:
            raise ValueError("time-outs must be positive")


@dataclass(frozen=True)
class GraphConfig:
    ttl_ms: int = 30_000
    wheel_granularity_ms: int = 1_000  # read and kept: timers are exact here
    prune_interval_ms: int = 1_000
    mode: str = "cumulative"  # or ttl, replay
    test_graph: str = "continue"  # or empty


@dataclass(frozen=True)
class IForestConfig:
    random_seed: int = 2025
    n_trees: int = 100
    sample_size: int = 64
    max_depth: int = 10
    outline_threshold: float = 0.1


@dataclass(frozen=True)
class DbscanConfig:
    epsilon: float = 0.1
    min_points: int = 10
    outline_threshold: float = 0.65  # read and kept: the detector's rule has no threshold


@dataclass(frozen=True)
class KMeansConfig:
    k: int = 10
    batch_size: int = 64
    iterations: int = 200
    decay: float = 0.8
    seed: int = 2025


@dataclass(frozen=True)
class DbstreamConfig:
    epsilon: float = 0.05
    lambda_: float = 0.01
    mu: float = 3.0
    beta_noise: float = 1.5
    max_clusters: int = 500
    eta: float = 0.1
    connection: float = 0.3
    outlier_rule: str = "assigned"  # or comment

    def __post_init__(self):
        if self.epsilon <= 0 or self.lambda_ <= 0 or self.mu <= 0:
            raise ValueError("epsilon, lambda and mu must be positive")


@dataclass(frozen=True)
class EngineConfig:
    algorithm: str = "Analyze"
    data: DataConfig = field(default_factory=DataConfig)
    flow: FlowConfig = field(default_factory=FlowConfig)
    graph: GraphConfig = field(default_factory=GraphConfig)
    iforest: IForestConfig = field(default_factory=IForestConfig)
    dbscan: DbscanConfig = field(default_factory=DbscanConfig)
    kmeans: KMeansConfig = field(default_factory=KMeansConfig)
    dbstream: DbstreamConfig = field(default_factory=DbstreamConfig)
    partitions: int = 100
    partitioning: str = "hashed"  # or greedy, with exact node sets, or bloom
    output_dir: str = "result"

    def __post_init__(self):
        if self.partitioning not in ("hashed", "greedy", "bloom"):
            raise ValueError(f"unknown partitioning {self.partitioning}")


#: Where a section of the JSON file goes; sections of "detector" may also stand at the top level.
_SECTIONS = {
    "data": "data", "data_loader": "data", "extractor": "graph", "graph": "graph", "flow": "flow", "iforest": "iforest", "iforest_config": "iforest", "dbscan": "dbscan",
    "dbscan_config": "dbscan", "kmeans": "kmeans", "kmeans_config": "kmeans", "dbstream": "dbstream", "dbstream_config": "dbstream",
}
_RENAMED = {"lambda": "lambda_", "connection_threshold": "connection", "prune_interval": "prune_interval_ms"}


def _made(section: str, kind: type, values: dict[str, Any]):
    values = {_RENAMED.get(k, k): v for k, v in values.items()}
    if odd := sorted(values.keys() - {f.name for f in fields(kind)}):
        raise ValueError(f"unknown keys of {section}: {', '.join(odd)}")
    return kind(**values)


def from_dict(d: dict[str, Any]) -> EngineConfig:
    """Keys of d over the defaults; the data's keys may also stand at the top level.  Unknown keys raise."""
    d = dict(d)
    d |= d.pop("detector", {})
    kinds = {f.name: f.default_factory for f in fields(EngineConfig) if f.name in _SECTIONS.values()}
    found: dict[str, dict] = {}
    for section, name in _SECTIONS.items():
        if section in d:
            found[name] = found.get(name, {}) | d.pop(section)
    plain = {f.name for f in fields(EngineConfig)} - set(kinds)
    parts = {k: d.pop(k) for k in list(d) if k in plain}
    if d:
        found["data"] = found.get("data", {}) | d
    return EngineConfig(**parts, **{name: _made(name, kinds[name], values) for name, values in found.items()})


def load(path: str) -> EngineConfig:
    """The configuration in a JSON file; raises if it can't be read."""
    with open(path, encoding="utf-8") as f:
        return from_dict(json.load(f))
