"""Packets to flows: gap sessionization, flow records, statistics, dumps."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from netloom.functions import codes
from netloom.operators import ordering

KEY = ["src", "dst", "sport", "dport", "stack"]


def without_bad(packets: DataFrame) -> DataFrame:
    return packets.where(F.col("kind") != "bad")


def ipv4(packets: DataFrame) -> DataFrame:
    return packets.where(F.col("kind") == "4")


def with_labels(packets: DataFrame, labels: DataFrame) -> DataFrame:
    """Packets with their label by index; a missing one is 0."""
    found = labels.select("pkt_idx", F.col("label").cast("int").alias("label"))
    return packets.join(found, "pkt_idx", "left").withColumn("label", F.coalesce("label", F.lit(0)))


def with_session(packets: DataFrame, timeout_us: int, key: list[str] = KEY) -> DataFrame:
    """Adds sid: 1, 2, ... within a key, one more at each gap of timeout_us or more.

    Packets are range-partitioned by time, and what a key's earlier ranges hold is
    added: a key of a third of all packets is not one task's."""
    us, order = codes.micros(F.col("ts")), ["ts", "pkt_idx"]
    lined = ordering.running(ordering.bucketed(packets, order), key, order, {"_last": us}, top=True, before=True)
    flagged = lined.withColumn("_new", F.when(F.col("_last").isNull() | (us - F.col("_last") >= timeout_us), 1).otherwise(0).cast("long"))
    return ordering.running(flagged, key, order, {"sid": F.col("_new")}).drop("_new", "_last", ordering.BUCKET)


def sessionize(packets: DataFrame, timeout_us: int, key: list[str] = KEY, lineage: bool = False) -> DataFrame:
    """Flows of packets (key, ts, pkt_idx, code, len, label): times, OR of codes, packets, bytes, any label.

    lineage: keeps the packets' indexes in order."""
    aggs = [
        F.min("ts").alias("ts_start"), F.max("ts").alias("ts_end"), F.bit_or("code").alias("code"), F.count("*").alias("packets"),
        F.sum("len").cast("long").alias("bytes"), F.max("label").alias("label"),
    ]
    if lineage:
        aggs.append(F.array_sort(F.collect_list("pkt_idx")).alias("pkt_idx"))
    return with_session(packets.select(*key, "ts", "pkt_idx", "code", "len", "label"), timeout_us, key).groupBy(*key, "sid").agg(*aggs)


def replay(packets: DataFrame, timeout_s: float = 10.0, evict_s: float = 5.0, chunks: int = 32, key: list[str] = KEY) -> DataFrame:
    """Parity study of chunked sessionization: packets are cut into ``chunks``
    runs of the order, a run evicts flows idle over the time-out only when a
    check is due, and fragments of a key are merged unless a gap of the time-out
    lies between them.  Runs are replayed in parallel, one task each."""
    indexed = ordering.indexed(packets, ["pkt_idx"], "_n")
    total = packets.count()
    size = max(1, -(-total // chunks))
    eps = 1e-5

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_n")
        table: dict[tuple, list] = {}
        done: list[list] = []
        checked = None
        times = pdf["ts"].astype("int64").to_numpy() / 1e9 if pdf["ts"].dtype.kind == "M" else pdf["ts"].to_numpy(float)
        for k, ts, us, code, length, label in zip(pdf[key].itertuples(index=False, name=None), times, pdf["us"], pdf["code"], pdf["len"], pdf["label"], strict=True):
            checked = ts if checked is None else checked
            f = table.get(k)
            if f is None:
                table[k] = [*k, ts, ts, us, us, code, 1, length, label]
            else:
                n = len(k)
                f[n + 1], f[n + 3] = ts, us
                f[n + 4] |= code
                f[n + 5] += 1
                f[n + 6] += length
                f[n + 7] = max(f[n + 7], label)
            if ts - checked > evict_s + eps:
                checked = ts
                for x in [x for x, f in table.items() if ts - f[len(key) + 1] > timeout_s + eps]:
                    done.append(table.pop(x))
        done += table.values()
        return pd.DataFrame(done, columns=[*key, "s", "e", "s_us", "e_us", "code", "packets", "bytes", "label"]).drop(columns=["s", "e"])

    kinds = {f.name: f.dataType.simpleString() for f in packets.schema.fields}
    schema = ", ".join([*(f"{k} {kinds[k]}" for k in key), "s_us long, e_us long, code int, packets long, bytes long, label int"])
    fed = indexed.select(*key, "ts", codes.micros(F.col("ts")).alias("us"), "code", "len", "label", "_n", F.floor((F.col("_n") - 1) / size).alias("_chunk"))
    parts = fed.groupBy("_chunk").applyInPandas(lambda pdf: run(pdf), schema)
    w = Window.partitionBy(*key).orderBy("s_us", "e_us")
    before = F.max("e_us").over(w.rowsBetween(Window.unboundedPreceding, -1))
    parts = parts.withColumn("_new", F.when(before.isNull() | (F.col("s_us") - before >= int(timeout_s * 1e6)), 1).otherwise(0))
    parts = parts.withColumn("sid", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return parts.groupBy(*key, "sid").agg(
        F.timestamp_micros(F.min("s_us")).alias("ts_start"), F.timestamp_micros(F.max("e_us")).alias("ts_end"), F.bit_or("code").alias("code"),
        F.sum("packets").alias("packets"), F.sum("bytes").alias("bytes"), F.max("label").alias("label"),
    )


def records(flows: DataFrame) -> DataFrame:
    """Flow records of sessionized flows; proto is the stack's type id."""
    return flows.select(
        F.col("src").alias("src_ip"), F.col("dst").alias("dst_ip"), F.col("sport").alias("src_port"), F.col("dport").alias("dst_port"),
        codes.stack_type(F.col("stack")).alias("proto"), "ts_start", "ts_end", "packets", "bytes", "label",
    )


def reversed_key(flows: DataFrame) -> DataFrame:
    """The opposite direction's key: addresses and ports swapped."""
    swap = {"src": "dst", "dst": "src", "sport": "dport", "dport": "sport"}
    return flows.select(*(F.col(swap.get(c, c)).alias(c) for c in flows.columns))


def duration_ms(start: Column, end: Column) -> Column:
    return (codes.millis(end) - codes.millis(start)).cast("long")


def completion_seconds(start: Column, end: Column) -> Column:
    return codes.micros(end) / 1e6 - codes.micros(start) / 1e6


def flow_vector(flows: DataFrame, keep: list[str]) -> DataFrame:
    """The 6 basic features: ports, protocol, duration, packets, bytes per packet (0 without packets)."""
    per = F.when(F.col("packets") > 0, F.col("bytes") / F.col("packets")).otherwise(F.lit(0.0))
    return flows.select(
        *keep, F.col("src_port").cast("double").alias("f_sport"), F.col("dst_port").cast("double").alias("f_dport"), F.col("proto").cast("double").alias("f_proto"),
        duration_ms(F.col("ts_start"), F.col("ts_end")).cast("double").alias("f_duration"), F.col("packets").cast("double").alias("f_packets"), per.alias("f_bytes_per_packet"),
    )


def prefix_split(flows: DataFrame, order: list[str], ratio: float = 0.8, keep: list[str] | None = None) -> DataFrame:
    """Adds flow_idx and is_train: the first floor(ratio * n) flows in order.  Of the flows' columns those of ``keep`` are stored, by default all."""
    lined = ordering.indexed(flows, order, "flow_idx", keep=keep)
    n = lined.count()
    return lined.withColumn("is_train", F.col("flow_idx") <= int(np.floor(ratio * n)))


def first_rows(df: DataFrame, order: list[str], n: int) -> DataFrame:
    """The first n rows in order; all if n is negative."""
    return df if n < 0 else df.orderBy(*order).limit(n)


def length_classes(flows: DataFrame, threshold: int = 15) -> DataFrame:
    """Flows and packets of long (over threshold packets) and short flows."""
    kind = F.when(F.col("packets") > threshold, F.lit("long")).otherwise(F.lit("short"))
    return flows.groupBy(kind.alias("kind")).agg(F.count("*").alias("flows"), F.sum("packets").alias("packets"))


def protocol_counts(flows: DataFrame) -> DataFrame:
    """Flows of each known protocol and IP version."""
    kind = codes.stack_type(F.col("stack"))
    return flows.where(kind != codes.TYPES["UNKNOWN"]).groupBy("ipver", codes.type_name(kind).alias("proto_name")).agg(F.count("*").alias("flows"))


def histograms(flows: DataFrame) -> DataFrame:
    """(hist, bin, flows): completion time by whole seconds up, packets and bytes by powers of two up."""
    bins = F.array(
        F.struct(F.lit("fct").alias("hist"), F.ceil(completion_seconds(F.col("ts_start"), F.col("ts_end"))).cast("long").alias("bin")),
        F.struct(F.lit("packets").alias("hist"), F.ceil(F.log2(F.col("packets").cast("double"))).cast("long").alias("bin")),
        F.struct(F.lit("bytes").alias("hist"), F.ceil(F.log2(F.greatest(F.col("bytes"), F.lit(1)).cast("double"))).cast("long").alias("bin")),
    )
    return flows.select(F.explode(bins).alias("x")).groupBy("x.hist", "x.bin").agg(F.count("*").alias("flows"))


def all_flows(v4: DataFrame, v6: DataFrame) -> DataFrame:
    """Flows of both versions, with ipver."""
    return v4.withColumn("ipver", F.lit(4)).unionByName(v6.withColumn("ipver", F.lit(6)))


def conserved(packets: DataFrame, flows: DataFrame) -> DataFrame:
    """One row: packets in, packets in flows, and whether they agree."""
    a, b = packets.agg(F.count("*").alias("packets")), flows.agg(F.coalesce(F.sum("packets"), F.lit(0)).alias("in_flows"))
    return a.join(b).withColumn("conserved", F.col("packets") == F.col("in_flows"))


def flow_id(src: Column, dst: Column, sport: Column, dport: Column, kind: Column) -> Column:
    return F.concat_ws(" ", codes.dotted(src), codes.dotted(dst), sport.cast("string"), dport.cast("string"), codes.type_name(kind))


def leader_vector(flows: DataFrame) -> DataFrame:
    """The 5 features of leader clustering."""
    pkts = F.log1p(F.col("packets").cast("double"))
    return flows.select(
        "*", (F.col("src_port") / 65535.0).alias("l0"), (F.col("dst_port") / 65535.0).alias("l1"), F.log1p(duration_ms(F.col("ts_start"), F.col("ts_end")).cast("double")).alias("l2"),
        pkts.alias("l3"), (F.log1p(F.col("bytes").cast("double")) - pkts).alias("l4"),
    )


def leader_clusters(flows: DataFrame, threshold: float) -> DataFrame:
    """Adds leader: within (src_ip, dst_ip), in order of flow_idx, the first group
    whose running-mean centroid has a cosine of threshold or more, else a new one."""
    cols = [f"l{i}" for i in range(5)]
    schema = "src_ip long, dst_ip long, flow_idx long, leader int"
    names = [x.split()[0] for x in schema.split(", ")]

    def leaders(rows: np.ndarray) -> list[int]:
        centres, sizes, out = np.zeros((0, 5)), [], []
        for x in rows:
            norms = np.sqrt((centres**2).sum(1)) * np.sqrt((x**2).sum())
            cos = np.where(norms > 0, centres @ x / np.where(norms > 0, norms, 1), 0.0)
            hit = np.flatnonzero(cos >= threshold)
            if len(hit):
                i = int(hit[0])
                centres[i] = (centres[i] * sizes[i] + x) / (sizes[i] + 1)
                sizes[i] += 1
            else:
                i = len(sizes)
                centres = np.vstack([centres, x])
                sizes.append(1)
            out.append(i)
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Over rows in order of (src_ip, dst_ip, flow_idx): a pair's rows are held until the next pair begins."""
        held: list[pa.RecordBatch] = []

        def made(rows: list[pa.RecordBatch]) -> pa.RecordBatch:
            ids = [np.concatenate([b.column(n).to_numpy() for b in rows]) for n in names[:3]]
            x = np.column_stack([np.concatenate([b.column(n).to_numpy() for b in rows]) for n in cols])
            cut = np.flatnonzero((ids[0][1:] != ids[0][:-1]) | (ids[1][1:] != ids[1][:-1])) + 1
            found = [i for part in np.split(x, cut) for i in leaders(part)]
            return pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in ids), pa.array(found, pa.int32())], names)

        for batch in batches:
            a, b = batch.column("src_ip").to_numpy(), batch.column("dst_ip").to_numpy()
            if not len(a):
                continue
            last = int(np.flatnonzero(np.append(True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])))[-1])  # where the batch's last pair begins
            begins = not held or (held[-1].column("src_ip")[-1].as_py(), held[-1].column("dst_ip")[-1].as_py()) != (a[0], b[0])
            if last or begins:
                done = [*held, batch.slice(0, last)] if last else held
                if done:
                    yield made(done)
                held = []
            held.append(batch.slice(last))
        if held:
            yield made(held)

    lined = leader_vector(flows).select("src_ip", "dst_ip", "flow_idx", *cols).repartition("src_ip", "dst_ip").sortWithinPartitions("src_ip", "dst_ip", "flow_idx")
    return lined.mapInArrow(run, schema)


def pair_groups(flows: DataFrame, max_packets: int = 15) -> DataFrame:
    """Short flows grouped by (src, dst): groups, flows, and the reduction in percent."""
    short = flows.where(F.col("packets") <= max_packets)
    groups = short.groupBy("src_ip", "dst_ip").agg(F.count("*").alias("n"))
    out = groups.agg(F.count("*").alias("groups"), F.coalesce(F.sum("n"), F.lit(0)).alias("flows"))
    return out.withColumn("reduction", F.when(F.col("flows") > 0, 100.0 * (1 - F.col("groups") / F.col("flows"))).otherwise(F.lit(0.0)))
