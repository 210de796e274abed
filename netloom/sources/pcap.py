"""Packet captures as a Spark data source named ``pcap``, one partition for each file.

    register(spark); spark.read.format("pcap").load(folder_or_file)

Classic files of either byte order, with micro- or nanosecond times, are read;
links: Ethernet (also VLAN-tagged), raw IP and BSD loopback.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from typing import BinaryIO

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netloom.functions.codes import BITS

SCHEMA = "file string, no long, kind string, src long, dst long, src6 string, dst6 string, sport int, dport int, ts_us long, code int, len int"


def _l4(kind: int, data: bytes) -> tuple[int, int, int]:
    """(code bits, source port, destination port) of a transport protocol."""
    if kind == 6 and len(data) >= 14:
        sport, dport = struct.unpack_from("!HH", data)
        flags = data[13]
        code = sum(1 << BITS[n] for n, bit in (("TCP_SYN", 2), ("TCP_ACK", 16), ("TCP_FIN", 1), ("TCP_RST", 4)) if flags & bit)
        return code, sport, dport
    if kind == 17 and len(data) >= 8:
        return 1 << BITS["UDP"], *struct.unpack_from("!HH", data)
    if kind in (1, 58):
        return 1 << BITS["ICMP"], 0, 0
    if kind == 2:
        return 1 << BITS["IGMP"], 0, 0
    return 1 << BITS["UNKNOWN"], 0, 0


def decode(data: bytes, link: int = 1) -> dict:
    """kind, addresses, ports, code and length of one captured packet; kind "bad" if it isn't IP."""
    bad = {"kind": "bad", "src": None, "dst": None, "src6": None, "dst6": None, "sport": None, "dport": None, "code": None, "len": None}
    if link == 1:
        if len(data) < 14:
            return bad
        (kind,), at = struct.unpack_from("!H", data, 12), 14
        while kind in (0x8100, 0x88A8) and len(data) >= at + 4:
            (kind,) = struct.unpack_from("!H", data, at + 2)
            at += 4
        if kind not in (0x0800, 0x86DD):
            return bad
        data = data[at:]
    elif link == 0:
        data = data[4:]
    elif link not in (101, 228, 229, 12, 14):
        return bad
    version = data[0] >> 4 if data else 0
    if version == 4 and len(data) >= 20:
        head, total = (data[0] & 15) * 4, struct.unpack_from("!H", data, 2)[0]
        code, sport, dport = _l4(data[9], data[head:])
        src, dst = struct.unpack_from("!II", data, 12)
        return bad | {"kind": "4", "src": src, "dst": dst, "sport": sport, "dport": dport, "code": code | 1 << BITS["IPv4"], "len": total}
    if version == 6 and len(data) >= 40:
        code, sport, dport = _l4(data[6], data[40:])
        src, dst = (str(int.from_bytes(data[i : i + 16], "big")) for i in (8, 24))
        return bad | {"kind": "6", "src6": src, "dst6": dst, "sport": sport, "dport": dport, "code": code | 1 << BITS["IPv6"], "len": struct.unpack_from("!H", data, 4)[0]}
    return bad


# A file's first four bytes -> (byte order, units in a microsecond).
MAGIC = {b"\xd4\xc3\xb2\xa1": ("<", 1), b"\xa1\xb2\xc3\xd4": (">", 1), b"\x4d\x3c\xb2\xa1": ("<", 1000), b"\xa1\xb2\x3c\x4d": (">", 1000)}


def packets(stream: BinaryIO, name: str) -> Iterator[tuple]:
    """Rows of SCHEMA of an open capture file; a cut-off last packet ends it."""
    head = stream.read(24)
    if len(head) < 24 or head[:4] not in MAGIC:
        raise ValueError(f"{name} is no classic capture file")
    order, per_us = MAGIC[head[:4]]
    link = struct.unpack(order + "I", head[20:24])[0] & 0x0FFFFFFF
    no = 0
    while len(h := stream.read(16)) == 16:
        sec, frac, size, _ = struct.unpack(order + "IIII", h)
        data = stream.read(size)
        if len(data) < size:
            return
        p = decode(data, link)
        yield name, no, p["kind"], p["src"], p["dst"], p["src6"], p["dst6"], p["sport"], p["dport"], sec * 1_000_000 + frac // per_us, p["code"], p["len"]
        no += 1


def register(spark: SparkSession) -> None:
    """Makes the format ``pcap`` known, for files that executors can open as local paths."""
    from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

    class Reader(DataSourceReader):
        def __init__(self, path: str):
            self.path = path

        def partitions(self):
            import glob
            import os

            found = sorted(glob.glob(os.path.join(self.path, "*"))) if os.path.isdir(self.path) else [self.path]
            return [InputPartition(f) for f in found]

        def read(self, partition):
            with open(partition.value, "rb") as f:
                yield from packets(f, partition.value)

    class Pcap(DataSource):
        @classmethod
        def name(cls):
            return "pcap"

        def schema(self):
            return SCHEMA

        def reader(self, schema):
            return Reader(self.options["path"])

    spark.dataSource.register(Pcap)


def read_pcap(spark: SparkSession, path: str, data_size: int = -1) -> DataFrame:
    """Packets (pkt_idx in order of file and place) of capture files on any store that Spark reads."""
    import io

    from netloom.functions.codes import stack_code
    from netloom.operators import ordering

    names = [c.split()[0] for c in SCHEMA.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for name, content in zip(pdf["path"], pdf["content"], strict=True):
                rows: list[tuple] = []
                for row in packets(io.BytesIO(content), name):
                    rows.append(row)
                    if len(rows) == 50_000:
                        yield pd.DataFrame(rows, columns=names).astype(object)
                        rows = []
                yield pd.DataFrame(rows, columns=names).astype(object)

    raw = spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, SCHEMA)
    numbered = ordering.indexed(raw, ["file", "no"], "pkt_idx").drop(ordering.BUCKET)
    out = numbered.withColumn("pkt_idx", F.col("pkt_idx") - 1).withColumn("ts", F.timestamp_micros("ts_us")).withColumn("stack", stack_code(F.col("code"))).drop("ts_us", "file", "no")
    return out if data_size < 0 else out.orderBy("pkt_idx").limit(data_size)
