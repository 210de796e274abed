"""Flow CSVs, packet texts and packet labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from netloom.functions import codes
from netloom.functions.store import stored

#: Columns that a flow CSV's line has at least.
CSV_FIELDS = 85


#: Up to so many splits their table is broadcast.
MAX_BROADCAST_SPLITS = 50_000


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(line_no, value): the lines of text files, numbered from 0 in order of file name and place."""
    return placed_lines(spark, path).drop("file_line")


def placed_lines(spark: SparkSession, path: str) -> DataFrame:
    """(line_no, file_line, value): also the line's number in its file.

    A split's lines are read in order, by one task; the lines of the splits before it
    are counted, so that lines are neither shuffled nor sorted."""
    split = [F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block")]
    raw = spark.read.text(path).select(*split, F.monotonically_increasing_id().alias("_m"), "value")
    size = raw.groupBy("file", "block").agg(F.count("*").alias("_n"), F.min("_m").alias("_first"))
    before = lambda *keys: F.coalesce(F.sum("_n").over(Window.partitionBy(*keys).orderBy("file", "block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    splits = stored(size.select("file", "block", "_first", before(F.lit(0)).alias("_all"), before("file").alias("_own")), "splits")  # one row for each split
    small = splits.limit(MAX_BROADCAST_SPLITS + 1).count() <= MAX_BROADCAST_SPLITS
    at = F.col("_m") - F.col("_first")
    return raw.join(F.broadcast(splits) if small else splits, ["file", "block"]).select((F.col("_all") + at).alias("line_no"), (F.col("_own") + at).alias("file_line"), "value")


def parse_flow_lines(lines: DataFrame, duration_unit: str = "ms", strict: bool = True) -> DataFrame:
    """Flows of CSV lines (line_no, value), the header not among them.

    Lines under CSV_FIELDS fields, with bad addresses or numbers, are skipped.
    strict: a bad time fails the query; otherwise it skips the line."""
    f = F.split("value", ",", -1)
    at = lambda i: F.get(f, F.lit(i))
    numbers = {n: codes.leading_int(at(i)) for n, i in (("sport", 2), ("dport", 4), ("proto", 5), ("duration", 7), ("packets", 8), ("bytes", 10))}
    rows = lines.where(F.size(f) >= CSV_FIELDS).select(
        "line_no", codes.ip_number(F.trim(at(1))).alias("src_ip"), codes.ip_number(F.trim(at(3))).alias("dst_ip"), *(c.alias(n) for n, c in numbers.items()),
        F.trim(at(6)).alias("time"), F.try_to_timestamp(F.trim(at(6)), F.lit("M/d/yyyy H:mm")).alias("ts_start"), label_of(F.element_at(f, -1)).alias("label"),
    )
    good = rows.dropna(subset=["src_ip", "dst_ip", *numbers])
    if strict:
        good = good.withColumn("ts_start", F.when(F.col("ts_start").isNull(), F.raise_error(F.concat(F.lit("bad time: "), "time")).cast("timestamp")).otherwise(F.col("ts_start")))
    good = good.where(F.col("ts_start").isNotNull())
    us = F.col("duration") * (1000 if duration_unit == "ms" else 1)
    return good.select(
        "line_no", "src_ip", "dst_ip", codes.wrap16(F.col("sport")).alias("src_port"), codes.wrap16(F.col("dport")).alias("dst_port"), codes.wrap16(F.col("proto")).alias("proto"),
        "ts_start", F.timestamp_micros(F.unix_micros("ts_start") + us).alias("ts_end"), "packets", "bytes", "label",
    )


def label_of(text: Column) -> Column:
    return F.when(F.regexp_replace(text, r"\s", "") == "BENIGN", 0).otherwise(1)


def read_flow_csv(spark: SparkSession, path: str, data_size: int = -1, duration_unit: str = "ms") -> DataFrame:
    """Flows of CSVs that each have a header; data_size counts accepted lines."""
    flows = parse_flow_lines(placed_lines(spark, path).where("file_line > 0").drop("file_line"), duration_unit)
    return flows if data_size < 0 else flows.orderBy("line_no").limit(data_size)


def parse_packet_lines(lines: DataFrame) -> DataFrame:
    """Packets of lines "version src dst sport dport ts_us code len"; empty lines are dropped, other versions are bad."""
    f = F.split(F.trim("value"), " +")
    at = lambda i: F.get(f, F.lit(i))
    kind = F.substring(F.ltrim("value"), 1, 1)
    known = kind.isin("4", "6")
    value = lambda c: F.when(known, c)
    code = at(6).try_cast("int")
    return lines.where(F.trim("value") != "").select(
        F.col("line_no").alias("pkt_idx"), F.when(known, kind).otherwise(F.lit("bad")).alias("kind"), value(F.when(kind == "4", at(1).try_cast("long"))).alias("src"),
        value(F.when(kind == "4", at(2).try_cast("long"))).alias("dst"), value(F.when(kind == "6", at(1))).alias("src6"), value(F.when(kind == "6", at(2))).alias("dst6"),
        value(at(3).try_cast("int")).alias("sport"), value(at(4).try_cast("int")).alias("dport"), value(F.timestamp_micros(at(5).try_cast("long"))).alias("ts"),
        value(code).alias("code"), value(at(7).try_cast("int")).alias("len"), value(codes.stack_code(code)).alias("stack"),
    )


def read_packets(spark: SparkSession, path: str, data_size: int = -1) -> DataFrame:
    packets = parse_packet_lines(numbered_lines(spark, path))
    return packets if data_size < 0 else packets.orderBy("pkt_idx").limit(data_size)


def packet_text(packets: DataFrame, align_us: int = 0) -> DataFrame:
    """The lines that parse_packet_lines reads, times shifted by align_us."""
    us = (F.unix_micros("ts") + align_us).cast("string")
    src, dst = (F.coalesce(F.col(c).cast("string"), F.col(f"{c}6")) for c in ("src", "dst"))
    line = F.concat_ws(" ", "kind", src, dst, F.col("sport").cast("string"), F.col("dport").cast("string"), us, F.col("code").cast("string"), F.col("len").cast("string"))
    return packets.where("kind <> 'bad'").select("pkt_idx", line.alias("value"))


def parse_labels(lines: DataFrame) -> DataFrame:
    """(label_no, label): each 0 or 1 in lines (line_no, value) in order, numbered
    from 0; offsets come from the lines before, of which only lengths are summed."""
    from netloom.operators import ordering

    digits = F.regexp_replace("value", "[^01]", "")
    counted = ordering.bucketed(lines.select("line_no", digits.alias("digits"), F.length(digits).cast("long").alias("n")), ["line_no"])
    lined = ordering.running(counted, [], ["line_no"], {"upto": F.col("n")})
    each = lined.select((F.col("upto") - F.col("n")).alias("begin"), F.posexplode(F.split("digits", "")).alias("at", "digit")).where("digit <> ''")
    return each.select((F.col("begin") + F.col("at")).alias("label_no"), F.col("digit").cast("int").alias("label"))


def labelled_packets(packets: DataFrame, labels: DataFrame) -> DataFrame:
    """Packets with their labels by place; fails unless there are as many labels."""
    from netloom.operators import ordering

    n, m = packets.count(), labels.count()
    if n != m:
        raise ValueError(f"{m} labels for {n} packets")
    placed = ordering.indexed(packets, ["pkt_idx"], "_place")
    return placed.join(labels.select((F.col("label_no") + 1).alias("_place"), "label"), "_place").drop("_place", ordering.BUCKET)
