"""Loaders: configuration to labelled flows in order, with the train split."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netloom.config import EngineConfig
from netloom.operators import flows as O
from netloom.sources import pcap, readers

#: A unique order of flow records.
ORDER = ["ts_start", "ts_end", "src_ip", "dst_ip", "src_port", "dst_port", "proto", "packets", "bytes", "label"]


def from_csv(spark: SparkSession, cfg: EngineConfig) -> DataFrame:
    return readers.read_flow_csv(spark, cfg.data.data_path, cfg.data.data_size, cfg.data.duration_unit).drop("line_no")


def _flows(packets: DataFrame, cfg: EngineConfig) -> DataFrame:
    return O.records(O.sessionize(O.ipv4(packets), round(cfg.flow.flow_time_out * 1e6)))


def from_packet_text(spark: SparkSession, cfg: EngineConfig) -> DataFrame:
    packets = readers.read_packets(spark, cfg.data.data_path, cfg.data.data_size)
    if cfg.data.label_path:
        packets = readers.labelled_packets(packets, readers.parse_labels(readers.numbered_lines(spark, cfg.data.label_path)))
    else:
        packets = packets.withColumn("label", F.lit(0))
    return _flows(packets, cfg)


def from_pcap(spark: SparkSession, cfg: EngineConfig) -> DataFrame:
    return _flows(pcap.read_pcap(spark, cfg.data.data_path, cfg.data.data_size).withColumn("label", F.lit(0)), cfg)


LOADERS: dict[str, Callable[[SparkSession, EngineConfig], DataFrame]] = {"CICIDS": from_csv, "HyperVision": from_packet_text, "Pcap": from_pcap}


def load(spark: SparkSession, cfg: EngineConfig) -> DataFrame:
    """Flows with flow_idx (from 1, in order of start) and is_train; raises on an unknown type or no flows."""
    if cfg.data.data_type not in LOADERS:
        raise ValueError(f"unknown data type {cfg.data.data_type}")
    flows = LOADERS[cfg.data.data_type](spark, cfg)
    out = O.prefix_split(flows, ORDER, cfg.data.train_ratio).drop("_bucket")
    if not out.limit(1).count():
        raise ValueError("no flows were loaded")
    return out
