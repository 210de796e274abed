"""python -m netloom.main --config FILE: loads flows, runs a detector, writes its tables and prints its report."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from netloom import config
from netloom.functions.ship import ship
from netloom.functions.store import stored
from netloom.operators.detectors import detect
from netloom.sinks import writers
from netloom.sources import loaders


def run(spark: SparkSession, cfg: config.EngineConfig):
    ship(spark)
    result = detect(stored(loaders.load(spark, cfg), "flows"), cfg)
    stem = cfg.data.data_path.rstrip("/").rsplit("/", 1)[-1].rsplit(".", 1)[0] or "flows"
    writers.write_results(cfg.algorithm, stem, result, cfg.output_dir)
    return result


def main() -> None:
    p = argparse.ArgumentParser()
    p.add_argument("--config", required=True)
    cfg = config.load(p.parse_args().config)
    spark = SparkSession.builder.appName("netloom").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    print(writers.report(cfg.algorithm, run(spark, cfg)))


if __name__ == "__main__":
    main()
