"""Structured Streaming forms: session flows, live graph degrees, stream clustering, scoring."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netloom.config import DbstreamConfig
from netloom.operators.learners import Dbstream


def session_flows(packets: DataFrame, key: list[str], timeout_us: int, watermark: str) -> DataFrame:
    """Flows of a packet stream by session windows.  The window merges at a gap
    equal to its length, so it is one microsecond shorter than the time-out."""
    # event times are compared in microseconds; the gap of a session window has that resolution
    w = F.session_window("ts", f"{timeout_us - 1} microseconds")
    live = packets.withWatermark("ts", watermark)
    out = live.groupBy(*key, w.alias("w")).agg(F.min("ts").alias("ts_start"), F.max("ts").alias("ts_end"), F.bit_or("code").alias("code"), F.count("*").alias("packets"), F.sum("len").alias("bytes"), F.max("label").alias("label"))
    return out.drop("w")


def edge_counts(flows: DataFrame, ttl_ms: int, watermark: str) -> DataFrame:
    """(src_ip, dst_ip, ts_start, edge_count): each flow's count on its edge, which
    starts anew once the edge was idle beyond ts_end + ttl; idle edges leave the state."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        count, until = state.get if state.exists else (0, -1)
        rows = pd.concat(list(frames)).sort_values(["t", "e"])
        out = []
        for t, e in zip(rows["t"], rows["e"], strict=True):
            count = count + 1 if t <= until else 1
            until = max(until, max(t, e) + ttl_ms)
            out.append(count)
        state.update((int(count), int(until)))
        state.setTimeoutTimestamp(max(int(until) + 1, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({"src_ip": key[0], "dst_ip": key[1], "t": rows["t"].to_numpy(), "edge_count": out})

    timed = flows.withWatermark("ts_start", watermark).select("src_ip", "dst_ip", "ts_start", F.unix_millis("ts_start").alias("t"), F.unix_millis("ts_end").alias("e"))
    return timed.groupBy("src_ip", "dst_ip").applyInPandasWithState(step, "src_ip long, dst_ip long, t long, edge_count long", "n long, until long", "append", "EventTimeTimeout")


def stream_clusters(points: DataFrame, columns: list[str], cfg: DbstreamConfig, watermark: str) -> DataFrame:
    """(pid, idx, assignment) of a stream of points (pid, idx, ts, columns): each
    batch is inserted in order, late points are dropped, then its points are
    assigned to the macro-clusters as they stand."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        stream = Dbstream(cfg)
        if state.exists:
            restore(stream, state.get[0])
        rows = pd.concat(list(frames)).sort_values(["t", "idx"])
        x = rows[columns].to_numpy(float)
        for v, t in zip(x, rows["t"].to_numpy(float), strict=True):
            stream.insert(v, t)
        labels = stream.macro_labels()
        state.update((dump(stream),))
        yield pd.DataFrame({"pid": key[0], "idx": rows["idx"].to_numpy(), "assignment": [stream.assign(v, labels) for v in x]})

    timed = points.withWatermark("ts", watermark).select("pid", "idx", "ts", (F.unix_micros("ts") / 1e6).alias("t"), *columns)
    return timed.groupBy("pid").applyInPandasWithState(step, "pid long, idx long, assignment int", "model string", "append", "NoTimeout")


def dump(s: Dbstream) -> str:
    return json.dumps({
        "c": {i: v.tolist() for i, v in s.centres.items()}, "w": s.weight, "s": s.seen, "made": s.made, "n": s.inserted, "last": s.last,
        "l": [[*k, *v] for k, v in s.links.items()],
    })


def restore(s: Dbstream, text: str) -> None:
    d = json.loads(text)
    s.centres = {int(i): np.array(v) for i, v in d["c"].items()}
    s.weight, s.seen = ({int(i): v for i, v in d[x].items()} for x in "ws")
    s.made, s.inserted, s.last = d["made"], d["n"], d["last"]
    s.links = {(a, b): [v, t, c] for a, b, v, t, c in d["l"]}


def scored(flows: DataFrame, score: Callable[[DataFrame], DataFrame], sink: Callable[[DataFrame, int], None], checkpoint: str):
    """Starts a query that scores each micro-batch with a fitted model and hands it to the sink."""
    return flows.writeStream.foreachBatch(lambda batch, n: sink(score(batch), n)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
