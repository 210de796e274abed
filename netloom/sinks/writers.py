"""Result tables and their CSV and text sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netloom.functions import codes
from netloom.operators.detectors import Result
from netloom.operators.flows import completion_seconds, flow_id


def write_csv(df: DataFrame, path: str) -> str:
    """df as CSV part files with headers; the folder is made."""
    df.write.mode("overwrite").option("header", True).csv(path)
    return path


def write_text(lines: DataFrame, path: str) -> str:
    lines.select("value").write.mode("overwrite").text(path)
    return path


def pca_rows(projected: DataFrame, columns: list[str]) -> DataFrame:
    """x, y and the given columns: label, assignments, pred or is_outlier."""
    return projected.select("x", "y", *columns)


def predictions(df: DataFrame, extra: dict[str, str] | None = None) -> DataFrame:
    """SrcIP, DstIP, extra columns (column -> name), Pred, Label."""
    more = [F.col(c).alias(n) for c, n in (extra or {}).items()]
    return df.select(codes.dotted(F.col("src_ip")).alias("SrcIP"), codes.dotted(F.col("dst_ip")).alias("DstIP"), *more, F.col("pred").alias("Pred"), F.col("label").alias("Label"))


def train_clusters(df: DataFrame) -> DataFrame:
    return df.select(F.col("flow_idx").alias("Index"), F.col("cluster").alias("Cluster"), F.col("distance").alias("Distance"))


def test_clusters(df: DataFrame) -> DataFrame:
    ends = [codes.dotted(F.col(c)).alias(n) for c, n in (("src_ip", "SrcIP"), ("dst_ip", "DstIP"))]
    return df.select(F.col("flow_idx").alias("Index"), *ends, F.col("cluster").alias("Cluster"), F.col("distance").alias("Distance"), F.col("label").alias("Label"))


def flow_lines(flows: DataFrame, labels: bool = False) -> DataFrame:
    """Text lines: flow id, start, end, completion time, packets, bytes, and with labels whether it is malicious."""
    kind = codes.stack_type(F.col("stack"))
    fixed = lambda x: F.format_string("%.6f", x)
    seconds = lambda c: fixed(codes.micros(F.col(c)) / 1e6)
    parts = [flow_id(F.col("src"), F.col("dst"), F.col("sport"), F.col("dport"), kind), seconds("ts_start"), seconds("ts_end"), fixed(completion_seconds(F.col("ts_start"), F.col("ts_end"))), F.col("packets").cast("string"), F.col("bytes").cast("string")]
    if labels:
        parts.append(F.col("label").cast("string"))
    return flows.select(F.concat_ws(" ", *parts).alias("value"))


def lineage_lines(flows: DataFrame, labels: DataFrame) -> DataFrame:
    """For each flow its packets' indexes and labels, missing ones 0; flows carry pkt_idx arrays."""
    named = flows.withColumn("flow_no", F.xxhash64("src", "dst", "sport", "dport", "stack", "sid"))
    each = named.select("flow_no", F.explode("pkt_idx").alias("pkt_idx")).join(labels, "pkt_idx", "left").withColumn("label", F.coalesce("label", F.lit(0)))
    pairs = F.array_sort(F.collect_list(F.struct("pkt_idx", "label")))
    text = F.transform(pairs, lambda x: F.concat_ws(":", x["pkt_idx"].cast("string"), x["label"].cast("string")))
    return each.groupBy("flow_no").agg(F.array_join(text, " ").alias("value"))


def result_tables(algorithm: str, stem: str, result: Result) -> dict[str, DataFrame]:
    """File name -> table, of everything that a detector leaves: predictions and
    metrics under the data's name, planes and clusters under the detector's."""
    t, pred = result.tables, result.predictions
    more = {"DBSCAN": {"distance": "Dist"}, "IForest": {"score": "Score"}}.get(algorithm)
    out = {} if pred is None else {f"{stem}_pred": predictions(pred, more), f"{stem}_metrics": result.metrics}
    if algorithm == "Analyze":
        out |= {"pca_result": pca_rows(t["pca"], ["label"]), "feature_stats": t["stats"]}
    elif algorithm == "Mini_Batch_KMeans":
        out |= {f"{stem}_train_clusters": train_clusters(t["train"]), f"{stem}_test_clusters": test_clusters(t["test"]), "cluster_stats": t["stats"], "cluster_radius": t["radius"]}
    elif algorithm == "DBSCAN":
        columns = [F.coalesce("cluster", F.lit(-1)).alias("assignments"), F.col("label"), F.col("pred").alias("is_outlier")]
        out |= {"dbscan_pca_result": t["pca"].select("x", "y", *columns), "feature_stats": t["stats"]}
    elif algorithm == "IForest":
        out |= {"iforest_pca_result": pca_rows(t["pca"], ["pred", "label"])}
    elif algorithm == "Mix":
        out |= {"partition_selection": t["selection"], "partition_signature": t["signature"]}
    return out


def write_results(algorithm: str, stem: str, result: Result, folder: str) -> list[str]:
    """Writes the tables as CSV folders, and of Mix the plane of each clustered partition under pid=..."""
    made = [write_csv(df, f"{folder}/{name}.csv") for name, df in result_tables(algorithm, stem, result).items()]
    if algorithm == "Mix":
        at = f"{folder}/dbstream_pca.csv"
        result.tables["pca"].select("pid", "x", "y", "assignments", "label", "is_outlier").repartition("pid").write.mode("overwrite").partitionBy("pid").option("header", True).csv(at)
        made.append(at)
    return made


def report(algorithm: str, result: Result) -> str:
    """The console's report: metrics and confusion, the partitions' scores, the clusters."""
    lines = [f"{algorithm}:"]
    if result.metrics is not None:
        m = result.metrics.first()
        lines += [f"  {name:<10}{100 * m[name]:8.3f} %" for name in ("accuracy", "precision", "recall", "f1", "f2", "fpr")]
        lines += ["              predicted 0   predicted 1", f"  actual 0   {m['tn']:>12}  {m['fp']:>12}", f"  actual 1   {m['fn']:>12}  {m['tp']:>12}"]
    if (chosen := result.tables.get("selection")) is not None:  # one row for each partition, a bounded set
        rows = chosen.where("selected").orderBy("place").collect()
        lines += [f"  {len(rows)} partitions selected, tau {rows[0]['tau']:.6f}" if rows else "  no partition selected"]
        lines += [f"  partition {r['pid']:>6}  score {r['score']:.6f}" for r in rows]
    if algorithm == "Mini_Batch_KMeans":
        for r in result.tables["stats"].orderBy("cluster").collect():  # at most k rows
            lines.append(f"  cluster {r['cluster']:>4}  size {r['size']:>8}  mean {r['mean']:.4f}  std {r['std']:.4f}  min {r['min']:.4f}  max {r['max']:.4f}")
    return "\n".join(lines)


def plot_frame(df: DataFrame, names: dict[int, str], only_label: int | None = None) -> DataFrame:
    """The shape that plots read: label names instead of numbers, booleans as 0 and 1."""
    name = F.create_map(*(F.lit(x) for k, v in names.items() for x in (k, v)))
    out = df if only_label is None else df.where(F.col("label") == only_label)
    flags = [c for c, t in df.dtypes if t == "boolean"]
    return out.withColumns({c: F.col(c).cast("int") for c in flags}).withColumn("label_name", F.try_element_at(name, F.col("label")))
