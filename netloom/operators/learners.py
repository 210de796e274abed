"""Isolation forest, k-means with mini-batch refinement, DBSCAN, DBSTREAM, graph partitioning, Bloom filter.

Models are trained on bounded samples or as one task for each tree, partition or
key; scoring runs in Arrow batches against the model, whose size does not depend
on the data.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from netloom.config import DbstreamConfig, IForestConfig, KMeansConfig
from netloom.functions.store import discard, stored
from netloom.operators.joins import by_key
from netloom.operators.scaling import fit_pca

EULER = 0.5772156649015329
#: Principal axes of DBSCAN's cells, and how many of a cell's points one task compares with its neighbours.
CELL_AXES, CELL_POINTS = 3, 4096


def expected_path(n: Column) -> Column:
    """c(n), the mean path of an unsuccessful search among n points."""
    return F.when(n <= 1, F.lit(0.0)).otherwise(2.0 * (F.log(n - 1.0) + EULER) - 2.0 * (n - 1.0) / n)


def _expected_path(n: np.ndarray | float):
    n = np.asarray(n, float)
    safe = np.maximum(n, 2.0)
    return np.where(n <= 1, 0.0, 2.0 * (np.log(safe - 1.0) + EULER) - 2.0 * (safe - 1.0) / safe)


@dataclass(frozen=True)
class Tree:
    """Flat nodes: feature -1 marks a leaf, whose size is kept."""

    feature: np.ndarray
    split: np.ndarray
    left: np.ndarray
    right: np.ndarray
    size: np.ndarray

    def path(self, x: np.ndarray) -> np.ndarray:
        node, depth = np.zeros(len(x), int), np.zeros(len(x))
        while True:
            inner = np.flatnonzero(self.feature[node] >= 0)
            if not len(inner):
                return depth + _expected_path(self.size[node])
            at = node[inner]
            below = x[inner, self.feature[at]] < self.split[at]
            node[inner] = np.where(below, self.left[at], self.right[at])
            depth[inner] += 1


def grow_tree(x: np.ndarray, max_depth: int, rng: np.random.Generator) -> Tree:
    nodes: list[list] = []

    def build(rows: np.ndarray, depth: int) -> int:
        at = len(nodes)
        nodes.append([-1, 0.0, -1, -1, len(rows)])
        if len(rows) <= 1 or depth >= max_depth:
            return at
        f = int(rng.integers(x.shape[1]))
        lo, hi = x[rows, f].min(), x[rows, f].max()
        if lo == hi:
            return at
        split = float(rng.uniform(lo, hi))
        below = x[rows, f] < split
        if not below.any() or below.all():
            return at
        nodes[at][:2] = f, split
        nodes[at][2] = build(rows[below], depth + 1)
        nodes[at][3] = build(rows[~below], depth + 1)
        return at

    build(np.arange(len(x)), 0)
    a = np.array([n[:1] + n[2:] for n in nodes], int).reshape(-1, 4)
    return Tree(a[:, 0], np.array([n[1] for n in nodes], float), a[:, 1], a[:, 2], a[:, 3])


@dataclass(frozen=True)
class IsolationForest:
    columns: list[str]
    trees: list[Tree]
    sample_size: int

    def score(self, df: DataFrame, name: str = "score") -> DataFrame:
        """df with 2 ** (-mean path / c(sample size))."""
        sent = df.sparkSession.sparkContext.broadcast(self)

        @F.pandas_udf("double")
        def scored(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
            forest = sent.value
            norm = max(float(_expected_path(forest.sample_size)), 1e-12)
            for cols in batches:
                x = np.column_stack([c.to_numpy(float) for c in cols])
                mean = np.mean([t.path(x) for t in forest.trees], axis=0) if forest.trees else np.zeros(len(x))
                yield pd.Series(np.power(2.0, -mean / norm))

        return df.withColumn(name, scored(*self.columns))


def tree_rows(df: DataFrame, columns: list[str], cfg: IForestConfig, key: str) -> DataFrame:
    """(tree, _h, columns, _n): the n_trees * sample_size rows of smallest hash of key are
    dealt over the trees, so that each tree's rows are a sample of the whole table that no
    other tree has; of a smaller table, each tree gets a draw of about 4 * sample_size rows."""
    need = cfg.n_trees * cfg.sample_size
    pool = df.select(F.xxhash64(F.lit(cfg.random_seed), key).alias("_h"), *columns).orderBy("_h", *columns).limit(need)
    pool = stored(pool.withColumn("_n", F.row_number().over(Window.orderBy("_h", *columns)) - 1), "forest_pool")  # a bounded number of rows
    size = pool.count()
    if size == need:
        return pool.withColumn("tree", (F.col("_n") % cfg.n_trees).cast("long"))
    trees = df.sparkSession.range(cfg.n_trees).withColumnRenamed("id", "tree")
    picked = F.pmod(F.xxhash64("tree", "_n"), F.lit(max(size, 1))) < 4 * cfg.sample_size  # enough rows to draw from
    return trees.join(F.broadcast(pool), picked)


def fit_iforest(df: DataFrame, columns: list[str], cfg: IForestConfig, key: str) -> IsolationForest:
    """Each tree takes sample_size of its rows; see tree_rows."""
    spread = tree_rows(df, columns, cfg, key)
    schema = "tree long, feature array<int>, split array<double>, left array<int>, right array<int>, size array<int>, n int"

    def build(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        rng = np.random.default_rng([cfg.random_seed, int(key[0])])
        x = pdf.sort_values(["_h", *columns])[columns].to_numpy(float)
        n = min(len(x), cfg.sample_size)
        t = grow_tree(x[rng.permutation(len(x))[:n]], cfg.max_depth, rng)
        return pd.DataFrame([{"tree": int(key[0]), "feature": t.feature, "split": t.split, "left": t.left, "right": t.right, "size": t.size, "n": n}])

    rows = spread.groupBy("tree").applyInPandas(build, schema).orderBy("tree").collect()  # n_trees rows of bounded size
    trees = [Tree(*(np.array(r[c]) for c in ("feature", "split", "left", "right", "size"))) for r in rows]
    return IsolationForest(columns, trees, max([r["n"] for r in rows], default=cfg.sample_size))


#: Trees, depth and bins of a column in a random forest, and the rows whose values give its bins.
FOREST_TREES, FOREST_DEPTH, FOREST_BINS, FOREST_SEEN = 20, 5, 32, 10_000
#: Chance that a row counts at most 0, 1, ... times in a tree (Poisson of mean 1).
_TIMES = np.cumsum(np.exp(-1.0) / np.cumprod([1.0, *range(1, 16)]))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """[n, width] of a column of equally long byte strings."""
    ends = np.frombuffer(column.buffers()[1], np.int64 if pa.types.is_large_binary(column.type) else np.int32)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(column.buffers()[2], np.uint8)[ends[0] : ends[-1]].reshape(len(column), width)


def _times(seed: np.ndarray, tree: int) -> np.ndarray:
    """How often each row counts in a tree: a function of the row's seed, wherever it is read."""
    z = seed + np.uint64((tree + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return np.searchsorted(_TIMES, ((z ^ (z >> np.uint64(31))) >> np.uint64(11)) * 2.0**-53, side="right")


@dataclass(frozen=True)
class RandomForest:
    """feature, split: [tree, node], -1 for a leaf; node i has the children 2i + 1 (bins up to split) and 2i + 2.  votes: [tree, node, class]."""

    columns: list[str]
    cuts: list[np.ndarray]
    feature: np.ndarray
    split: np.ndarray
    votes: np.ndarray

    def bins(self, cols: list[np.ndarray]) -> np.ndarray:
        return np.column_stack([np.searchsorted(c, x) for c, x in zip(self.cuts, cols, strict=True)]).astype(np.uint8)

    def node(self, bins: np.ndarray, tree: int) -> np.ndarray:
        at = np.zeros(len(bins), np.int64)
        for _ in range(FOREST_DEPTH):
            inner = np.flatnonzero(self.feature[tree, at] >= 0)
            if not len(inner):
                break
            n = at[inner]
            at[inner] = 2 * n + 1 + (bins[inner, self.feature[tree, n]] > self.split[tree, n])
        return at

    def predict(self, df: DataFrame, name: str = "pred") -> DataFrame:
        """df with the class of the largest sum of the leaves' shares, the lowest of several."""
        sent = df.sparkSession.sparkContext.broadcast(self)

        @F.pandas_udf("int")
        def predicted(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
            forest = sent.value
            shares = forest.votes / np.maximum(forest.votes.sum(2, keepdims=True), 1.0)
            for cols in batches:
                bins = forest.bins([c.to_numpy(float) for c in cols])
                total = sum(shares[t, forest.node(bins, t)] for t in range(len(shares)))
                yield pd.Series(total.argmax(1).astype(np.int32))

        return df.withColumn(name, predicted(*self.columns))


def fit_forest(df: DataFrame, columns: list[str], key: str, label: str = "label", seed: int = 2025) -> RandomForest:
    """Trees over all rows, each row counted a Poisson number of times in each tree, by histograms of the
    bins of as many columns as the root of their number at each node; one pass for a level of all trees.

    What is kept of a row is a byte for each column, its label and its seed; a pass gives each task's sums,
    whose size does not depend on the rows.  Bins come from the FOREST_SEEN rows of smallest hash of key."""
    hashed = F.xxhash64(F.lit(seed), key)
    top = df.agg(F.max(label)).first()[0]
    if top is None:
        raise ValueError("a forest needs rows with labels")
    seen = df.select(hashed.alias("_h"), *columns).orderBy("_h", *columns).limit(FOREST_SEEN).toPandas()
    cuts = []
    for c in columns:
        values = np.unique(seen[c].to_numpy(float))
        cuts.append((values[1:] + values[:-1]) / 2 if len(values) <= FOREST_BINS else np.unique(np.quantile(seen[c].to_numpy(float), np.arange(1, FOREST_BINS) / FOREST_BINS)))
    d, classes, m, nodes = len(columns), int(top) + 1, int(np.ceil(len(columns) ** 0.5)), (1 << (FOREST_DEPTH + 1)) - 1
    forest = RandomForest(columns, cuts, np.full((FOREST_TREES, nodes), -1), np.zeros((FOREST_TREES, nodes), np.int64), np.zeros((FOREST_TREES, nodes, classes)))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bins = forest.bins([batch.column(c).to_numpy(zero_copy_only=False).astype(float) for c in columns])
            ends = pa.py_buffer((np.arange(len(bins) + 1) * d).astype(np.int32).tobytes())
            held = pa.Array.from_buffers(pa.binary(), len(bins), [None, ends, pa.py_buffer(bins.tobytes())])
            yield pa.RecordBatch.from_arrays([batch.column("_seed"), batch.column("_label"), held], ["_seed", "_label", "_bins"])

    rows = stored(df.where(F.col(label).isNotNull()).select(hashed.alias("_seed"), F.col(label).cast("int").alias("_label"), *(F.col(c).cast("double") for c in columns)).mapInArrow(cut, "_seed long, _label int, _bins binary"), "forest_rows")
    rng = np.random.default_rng(seed)
    for level in range(FOREST_DEPTH):
        ahead, wide = (1 << level) - 1, 1 << level
        picks = np.argsort(rng.random((FOREST_TREES, wide, d)), axis=2)[:, :, :m]
        sums = _forest_sums(rows, forest, picks, level)
        for t in range(FOREST_TREES):
            for i in range(wide):
                _divide(forest, t, ahead + i, picks[t, i], sums[t, i])
    discard(rows)
    return forest


def _forest_sums(rows: DataFrame, forest: RandomForest, picks: np.ndarray, level: int) -> np.ndarray:
    """[tree, node of the level, pick, bin, class]: how often rows count."""
    trees, wide, m = picks.shape
    classes, d, ahead = forest.votes.shape[2], len(forest.columns), (1 << level) - 1
    shape = (wide, m, FOREST_BINS, classes)
    sent = rows.sparkSession.sparkContext.broadcast((forest, picks))

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest, picks = sent.value
        out = np.zeros((trees, int(np.prod(shape))))
        for batch in batches:
            if not len(batch):
                continue
            bins, label = _matrix(batch.column("_bins"), d), batch.column("_label").to_numpy().astype(np.int64)
            seed = batch.column("_seed").to_numpy().view(np.uint64)
            for t in range(trees):
                times = _times(seed, t)
                mine = np.flatnonzero(times)
                at = forest.node(bins[mine], t) - ahead
                mine, at = mine[at >= 0], at[at >= 0]  # the others stopped at a leaf above
                slot = (at[:, None] * m + np.arange(m)) * FOREST_BINS + bins[mine[:, None], picks[t, at]]
                out[t] += np.bincount((slot * classes + label[mine, None]).ravel(), np.repeat(times[mine], m), out.shape[1])
        yield pa.RecordBatch.from_arrays([pa.array(range(trees), pa.int32()), pa.array([x.tobytes() for x in out], pa.binary())], ["tree", "sums"])

    def merged(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = sum((np.frombuffer(x.as_py()) for batch in batches for x in batch.column("sums")), np.zeros(int(np.prod(shape))))
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([total.tobytes()], pa.binary())], ["tree", "sums"])

    found = rows.mapInArrow(sums, "tree int, sums binary").groupBy("tree").applyInArrow(merged, "tree int, sums binary")
    out = np.zeros((trees, *shape))
    for r in found.collect():  # a row for each tree
        out[r["tree"]] = np.frombuffer(r["sums"]).reshape(shape)
    return out


def _divide(forest: RandomForest, tree: int, node: int, picks: np.ndarray, sums: np.ndarray) -> None:
    """Gives a node its votes, and children by the split of the least Gini impurity, if one lowers it."""
    whole = sums[0].sum(0)
    if whole.sum() == 0:
        return
    forest.votes[tree, node] = whole
    left = sums.cumsum(1)[:, :-1]
    right = whole - left
    n, k = left.sum(2), right.sum(2)
    with np.errstate(all="ignore"):
        impure = n - (left**2).sum(2) / n + k - (right**2).sum(2) / k
    impure = np.where((n > 0) & (k > 0), impure, np.inf)
    i, b = np.unravel_index(impure.argmin(), impure.shape)
    if impure[i, b] < whole.sum() - (whole**2).sum() / whole.sum() - 1e-9 * whole.sum():
        forest.feature[tree, node], forest.split[tree, node] = picks[i], b
        forest.votes[tree, 2 * node + 1], forest.votes[tree, 2 * node + 2] = left[i, b], right[i, b]


@dataclass(frozen=True)
class KMeans:
    columns: list[str]
    centres: np.ndarray

    def assign(self, df: DataFrame, cluster: str = "cluster", distance: str = "distance") -> DataFrame:
        """Nearest centre, the first of several, and the distance to it."""
        options = []
        for i, c in enumerate(self.centres.tolist()):
            terms = [(F.col(x) - v) * (F.col(x) - v) for x, v in zip(self.columns, c, strict=True)]
            options.append(F.struct(F.sqrt(sum(terms[1:], terms[0])).alias("d"), F.lit(i).alias("c")))
        best = F.array_min(F.array(*options))
        return df.withColumn("_best", best).select(*df.columns, F.col("_best.c").alias(cluster), F.col("_best.d").alias(distance))


def fit_kmeans(df: DataFrame, columns: list[str], cfg: KMeansConfig, key: str) -> KMeans:
    """MLlib k-means, then refinement by mini-batches from a bounded pool of rows."""
    from pyspark.ml.clustering import KMeans as MlKMeans
    from pyspark.ml.feature import VectorAssembler

    vectors = VectorAssembler(inputCols=columns, outputCol="_features").transform(df.select(*columns))
    model = MlKMeans(k=cfg.k, seed=cfg.seed, featuresCol="_features").fit(vectors)
    centres = np.array(model.clusterCenters())
    need = cfg.batch_size * cfg.iterations
    pool = df.select(F.xxhash64(F.lit(cfg.seed), key).alias("_h"), *columns).orderBy("_h", *columns).limit(need).toPandas()[columns].to_numpy(float)
    rng = np.random.default_rng(cfg.seed)
    for _ in range(cfg.iterations if len(pool) else 0):
        for x in pool[rng.integers(len(pool), size=min(cfg.batch_size, len(pool)))]:
            i = int(((centres - x) ** 2).sum(1).argmin())
            centres[i] = cfg.decay * centres[i] + (1 - cfg.decay) * x
    return KMeans(columns, centres)


def dbscan(df: DataFrame, columns: list[str], epsilon: float, min_points: int, idx: str = "idx") -> DataFrame:
    """df with cluster: the smallest core idx of its density-connected component, null for noise.

    Equal rows are one weighted point.  Points fall into cells of side epsilon on the
    first principal axes, so a pair within epsilon lies in one cell or in two that
    touch; it is met once.  No task holds a cell of many points: they are dealt over
    parts.  Grains are boxes whose points are all within epsilon of each other: the
    core points of a grain are connected without comparing them, and those of a grain
    of min_points rows are core without counting.  Pairs are counted as they are met,
    not kept; what is kept are links between grains and, for a point that is not core,
    its core neighbours, of which it has less than min_points.  Rows with a value that
    is null or not finite are noise; no rows give none; idx must be unique."""
    if not epsilon > 0:
        raise ValueError("epsilon must be positive")
    rows = stored(df.select(idx, F.xxhash64(*columns).alias("_p"), *columns), "dbscan_rows")
    finite = " AND ".join(f"abs(`{c}`) < double('Infinity')" for c in columns)
    points = stored(rows.where(finite).groupBy("_p", *columns).agg(F.count("*").alias("_w"), F.min(idx).alias("_i")), "dbscan_points")
    placed = _placed(points, columns, epsilon)
    dense = stored(placed.groupBy("_g").agg(F.sum("_w").alias("_n")).where(F.col("_n") >= min_points).select("_g", F.lit(True).alias("_d")), "dbscan_dense")
    placed = stored(by_key(placed, dense, "_g", "left").withColumn("_d", F.coalesce("_d", F.lit(False))), "dbscan_marked")
    hot = placed.groupBy("_c").agg(F.ceil(F.count("*") / CELL_POINTS).alias("_parts")).where("_parts > 1")
    hot = stored(hot, "dbscan_hot")

    counted = _within(placed, hot, epsilon, "_d", _not_both)
    ends = F.explode(F.array(F.struct(F.col("_p"), F.col("_wb").alias("_v")), F.struct(F.col("_q").alias("_p"), F.col("_wa").alias("_v")))).alias("_e")
    near = counted.select(ends).groupBy("_e._p").agg(F.sum("_e._v").alias("_n"))
    core = F.col("_d") | (F.col("_w") + F.coalesce("_n", F.lit(0)) >= min_points)
    placed = stored(placed.join(near, "_p", "left").withColumn("_core", core).drop("_n"), "dbscan_core")

    one, two = F.col("_ma"), F.col("_mb")
    met = _within(placed, hot, epsilon, "_core", _one_and_apart)
    u = F.when(one & two, F.least("_ga", "_gb")).when(one, F.col("_q")).otherwise(F.col("_p"))
    v = F.when(one & two, F.greatest("_ga", "_gb")).when(one, F.col("_ga")).otherwise(F.col("_gb"))
    met = stored(met.select(u.alias("u"), v.alias("v"), (one & two).alias("links")).distinct(), "dbscan_met")

    grains = placed.where("_core").groupBy("_g").agg(F.min("_i").alias("_i"))
    roots = min_labels(met.where("links")).select(F.col("v").alias("_g"), "root")
    grains = stored(grains.join(roots, "_g", "left").withColumn("root", F.coalesce("root", "_g")), "dbscan_grains")
    first = stored(grains.groupBy("root").agg(F.min("_i").alias("cluster")), "dbscan_clusters")
    named = stored(by_key(grains, first, "root").select("_g", "cluster"), "dbscan_named")
    inner = by_key(placed.where("_core").select("_p", "_g"), named, "_g").select("_p", "cluster")
    border = by_key(met.where("NOT links").select(F.col("u").alias("_p"), F.col("v").alias("_g")), named, "_g").groupBy("_p").agg(F.min("cluster").alias("cluster"))
    out = stored(inner.unionByName(border), "dbscan_out")
    return df.join(by_key(rows.select(idx, "_p"), out, "_p").select(idx, "cluster"), idx, "left")


def _placed(points: DataFrame, columns: list[str], epsilon: float) -> DataFrame:
    """points (_p, _w, _i, columns) with their values as columns _x0, ..., those of the
    largest spread first, their cell _c and their grain _g (a hash of 64 bits)."""
    axes = fit_pca(points, columns, min(CELL_AXES, len(columns)))
    stats = points.agg(*(F.expr(x) for i, c in enumerate(columns) for x in (f"stddev_pop(`{c}`) AS s{i}", f"max(abs(`{c}`)) AS m{i}"))).first()
    order = sorted(range(len(columns)), key=lambda i: -(stats[f"s{i}"] or 0.0))
    # room for the rounding of projections
    side = epsilon * (1 + 1e-6) + 1e-13 * len(columns) * max(stats[f"m{i}"] or 0.0 for i in order)
    grain = epsilon / len(columns) ** 0.5 * (1 - 1e-6)
    names = [f"_y{i}" for i in range(min(CELL_AXES, len(columns)))]
    values = [F.expr(f"`{columns[i]}` AS _x{n}") for n, i in enumerate(order)]
    seen = axes.transform(points, ["_p", "_w", "_i", *columns], names)
    return seen.select("_p", "_w", "_i", *values, F.struct(*(F.floor(F.col(n) / side).alias(n) for n in names)).alias("_c"), F.expr(f"xxhash64({', '.join(f'floor(`{c}` / {grain!r}D)' for c in columns)}) AS _g"))


#: A near pair: its points, and of each its weight, mark and grain.
NEAR = "_p long, _q long, _wa long, _wb long, _ma boolean, _mb boolean, _ga long, _gb long"
#: Points that are compared with a part of a cell at a time.
AGAINST = 512


def _not_both(ma: np.ndarray, mb: np.ndarray, ga: np.ndarray, gb: np.ndarray) -> np.ndarray:
    return ~(ma & mb)


def _one_and_apart(ma: np.ndarray, mb: np.ndarray, ga: np.ndarray, gb: np.ndarray) -> np.ndarray:
    return (ma | mb) & ~(ma & mb & (ga == gb))


def _within(placed: DataFrame, hot: DataFrame, epsilon: float, mark: str, where: Callable) -> DataFrame:
    """NEAR: each pair of points within epsilon once, if ``where`` holds for the marks and
    grains of both.  hot: (_c, _parts), the cells dealt over parts."""
    xs = [c for c in placed.columns if c.startswith("_x")]
    axes = placed.schema["_c"].dataType.fieldNames()
    offsets = [o for o in itertools.product((-1, 0, 1), repeat=len(axes)) if o >= (0,) * len(axes)]
    parts = F.coalesce("_parts", F.lit(1)).cast("long")
    carried = ["_p", "_w", F.col(mark).alias("_m"), "_g", *xs]
    a = by_key(placed.select("_c", F.lit(-1).alias("_o"), *carried), hot, "_c", "left").withColumn("_part", F.pmod(F.xxhash64("_p"), parts)).drop("_parts")
    cells = F.array(*(F.struct(*((F.col(f"_c.{n}") + F.lit(d).cast("long")).alias(n) for n, d in zip(axes, o, strict=True))) for o in offsets))
    b = placed.select(F.posexplode(cells).alias("_o", "_c"), *carried)
    b = by_key(b, hot, "_c", "left").withColumn("_part", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1))).drop("_parts")
    key = [*(F.col(f"_c.{n}").alias(f"_c{n}") for n in axes), "_part"]
    names = [*(f"_c{n}" for n in axes), "_part"]
    fields = ["_o", "_p", "_w", "_m", "_g", *xs]
    n = 4 * int(placed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = a.select(*key, *fields).unionByName(b.select(*key, *fields)).repartition(n, *names).sortWithinPartitions(*names, "_o")
    return rows.mapInArrow(_compared(len(names), xs, epsilon, where), NEAR)


def _compared(keys: int, xs: list[str], epsilon: float, where: Callable) -> Callable:
    """Over rows in order of their part of a cell and _o: the part's own points (_o -1) are held, and those of its
    cell (0) and of cells ahead (over 0) are compared with them by matrix products; what these leave is compared exactly."""

    def near(a: tuple, b: tuple) -> pa.RecordBatch:
        (_, p, wa, ma, ga, x), (o, q, wb, mb, gb, y) = a, b
        with np.errstate(all="ignore"):
            centre = x.mean(0)
            cx, cy = x - centre, y - centre
            nx, ny = (cx**2).sum(1), (cy**2).sum(1)
            lost = 1e-15 * len(xs) ** 0.5 * max(np.abs(x).max(), np.abs(y).max())
            limit = epsilon**2 + 1e-11 * (nx.max() + ny.max()) + 4 * lost * (epsilon + lost)
            maybe = ~(nx[:, None] + ny - 2 * (cx @ cy.T) > limit)  # an overflow is compared exactly
            maybe &= where(ma[:, None], mb, ga[:, None], gb)
            i, j = np.nonzero(maybe)
            once = (o[j] > 0) | (p[i] < q[j])
            i, j = i[once], j[once]
            d2 = np.zeros(len(i))
            for k in range(len(xs)):
                d2 += (x[i, k] - y[j, k]) * (x[i, k] - y[j, k])
        i, j = i[d2 <= epsilon * epsilon], j[d2 <= epsilon * epsilon]
        return pa.RecordBatch.from_arrays([pa.array(v) for v in (p[i], q[j], wa[i], wb[j], ma[i], mb[j], ga[i], gb[j])], [c.split()[0] for c in NEAR.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, []
        for batch in batches:
            cols = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            key, o = np.column_stack(cols[:keys]), cols[keys]
            x = np.column_stack(cols[keys + 5 :]).astype(float)
            new = np.append(True, (key[1:] != key[:-1]).any(1) | ((o[1:] < 0) != (o[:-1] < 0))) if len(key) else np.zeros(0, bool)
            cuts = [*np.flatnonzero(new).tolist(), len(key)]
            for lo, hi in itertools.pairwise(cuts):
                rows = tuple(c[lo:hi] for c in (*cols[keys : keys + 5], x))
                name = tuple(key[lo].tolist())
                if o[lo] < 0:
                    held = [np.concatenate(z) for z in zip(held, rows, strict=True)] if name == at else rows
                    at = name
                elif name == at:
                    for k in range(0, hi - lo, AGAINST):
                        yield near(held, tuple(c[k : k + AGAINST] for c in rows))

    return run


def min_labels(links: DataFrame) -> DataFrame:
    """(v, root): the smallest end of each component of links (u, v), by falling
    labels and label jumps; each round is written to the shared folder."""
    both = stored(links.select("u", "v").union(links.select("v", "u")).where("u <> v").distinct(), "links")
    labels = stored(both.groupBy("v").agg(F.least(F.min("u"), F.col("v")).alias("root")), "roots")
    while True:
        near = both.join(labels.select(F.col("v").alias("u"), "root"), "u").groupBy("v").agg(F.min("root").alias("near"))
        lower = labels.select("v", "root").join(near, "v").select("v", F.least("root", "near").alias("root"), F.col("root").alias("was"))
        jump = lower.select(F.col("v").alias("root"), F.col("root").alias("next"))
        new = stored(lower.join(jump, "root", "left").select("v", F.least(F.col("root"), F.coalesce("next", "root")).alias("root"), "was"), "roots")
        discard(labels)
        if not new.where("root <> was").limit(1).count():
            return new.select("v", "root")
        labels = new


class Dbstream:
    """Stream clustering by decaying micro-clusters with shared-density links."""

    def __init__(self, cfg: DbstreamConfig):
        self.cfg = cfg
        self.reset()

    def reset(self) -> None:
        self.centres: dict[int, np.ndarray] = {}
        self.weight: dict[int, float] = {}
        self.seen: dict[int, float] = {}
        self.links: dict[tuple[int, int], list[float]] = {}  # shared density, its time, and the connection then
        self.made = self.inserted = 0
        self.last: float | None = None

    def _near(self, x: np.ndarray, limit: float, ids: list[int]) -> list[tuple[float, int]]:
        if not ids:
            return []
        d = np.sqrt(((np.stack([self.centres[i] for i in ids]) - x) ** 2).sum(1))
        return sorted((float(v), i) for v, i in zip(d, ids, strict=True) if v <= limit)

    def insert(self, x: np.ndarray, t: float) -> None:
        """Late points (before the last one) are dropped."""
        cfg = self.cfg
        if self.last is not None and t < self.last:
            return
        self.decay(t)
        near = [(d, i) for d, i in self._near(x, cfg.epsilon, list(self.centres)) if d < cfg.epsilon]
        if not near:
            if len(self.centres) >= cfg.max_clusters:
                self.remove_noise()
                if len(self.centres) >= cfg.max_clusters:
                    return  # no room: as if the point had not come
            self.centres[self.made], self.weight[self.made], self.seen[self.made] = x.astype(float).copy(), 1.0, t
            self.made += 1
        else:
            moved = {}
            for d, i in near:
                self.weight[i] += 1.0
                self.seen[i] = t
                pull = cfg.eta * np.exp(-(d * d) / (2 * cfg.epsilon**2))
                moved[i] = self.centres[i] + pull * (x - self.centres[i])
            ids = [i for _, i in near]
            close = any(np.sqrt(((moved[a] - moved[b]) ** 2).sum()) < cfg.epsilon for k, a in enumerate(ids) for b in ids[k + 1 :])
            if not close:
                self.centres.update(moved)
            for k, a in enumerate(ids):
                for b in ids[k + 1 :]:
                    link = self.links.setdefault((min(a, b), max(a, b)), [0.0, t, 0.0])
                    link[0] = float(link[0] * np.exp(-cfg.lambda_ * (t - link[1]))) + 1.0
                    link[1:] = t, 2 * link[0] / (self.weight[a] + self.weight[b])
        self.last = t
        self.inserted += 1
        if self.inserted % 100 == 0:
            self.remove_noise()

    def decay(self, t: float) -> None:
        for i in self.weight:
            self.weight[i] *= float(np.exp(-self.cfg.lambda_ * max(0.0, t - self.seen[i])))
            self.seen[i] = t

    def remove_noise(self) -> None:
        gone = {i for i, w in self.weight.items() if w < self.cfg.beta_noise}
        for i in gone:
            del self.centres[i], self.weight[i], self.seen[i]
        self.links = {k: v for k, v in self.links.items() if not gone & set(k)}

    def core(self) -> list[int]:
        return [i for i in sorted(self.centres) if self.weight[i] >= self.cfg.mu]

    def macro_labels(self) -> dict[int, int]:
        """Labels 0, 1, ... of core micro-clusters in order of creation, joined by links
        whose connection, as of the last point that both took, is the threshold or more."""
        core = self.core()
        parent = {i: i for i in core}

        def find(i):
            while parent[i] != i:
                i = parent[i]
            return i

        for (a, b), (_, _, connection) in sorted(self.links.items()):
            if a in parent and b in parent and connection >= self.cfg.connection:
                parent[max(find(a), find(b))] = min(find(a), find(b))
        roots = list(dict.fromkeys(find(i) for i in core))
        return {i: roots.index(find(i)) for i in core}

    def assign(self, x: np.ndarray, labels: dict[int, int]) -> int:
        """The label of the nearest core micro-cluster within 1.5 epsilon, or -1."""
        near = self._near(x, 1.5 * self.cfg.epsilon, list(labels))
        return labels[near[0][1]] if near else -1


def dbstream_partitions(df: DataFrame, columns: list[str], cfg: DbstreamConfig, idx: str = "flow_idx") -> DataFrame:
    """(pid, idx, assignment, is_outlier, x, y) of each partition, its rows inserted in
    order of idx after min-max scaling of its own; x and y are the scaled rows' first
    two principal components.

    outlier_rule "assigned": every assigned point, all points if none is;
    "comment": the points of the largest cluster and those not assigned."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(idx)
        x = pdf[columns].to_numpy(float)
        lo, hi = x.min(0), x.max(0)
        x = (x - lo) / np.where(hi > lo, hi - lo, 1.0)
        stream = Dbstream(cfg)
        for row, t in zip(x, pdf["t"].to_numpy(float), strict=True):
            stream.insert(row, t)
        labels = stream.macro_labels()
        at = np.array([stream.assign(row, labels) for row in x], int)
        if not (at >= 0).any():
            out = np.ones(len(at), bool)
        elif cfg.outlier_rule == "assigned":
            out = at >= 0
        else:
            values, n = np.unique(at[at >= 0], return_counts=True)
            out = (at < 0) | (at == values[n.argmax()])
        px, py = plane(x).T
        return pd.DataFrame({"pid": pdf["pid"].astype("int64"), idx: pdf[idx].astype("int64"), "assignment": at.astype("int32"), "is_outlier": out, "x": px, "y": py})

    return df.groupBy("pid").applyInPandas(run, f"pid long, {idx} long, assignment int, is_outlier boolean, x double, y double")


def plane(x: np.ndarray) -> np.ndarray:
    """[n, 2]: rows on the first two principal components, the largest loading of each positive."""
    centred = x - x.mean(0)
    _, vectors = np.linalg.eigh(centred.T @ centred)
    top = vectors[:, ::-1][:, :2]
    top = top * np.where(top[np.abs(top).argmax(0), np.arange(top.shape[1])] < 0, -1, 1)
    return np.pad(centred @ top, ((0, 0), (0, 2 - top.shape[1])))


class Bloom:
    """A set of integers or byte strings with false positives only; bits a power of two."""

    def __init__(self, bits: int = 1 << 18, hashes: int = 8):
        if bits <= 0 or bits & (bits - 1):
            raise ValueError("bits must be a power of two")
        self.mask, self.hashes, self.field = bits - 1, hashes, np.zeros(bits, bool)

    def _places(self, x) -> list[int]:
        if isinstance(x, (bytes, str)):
            h = 0xCBF29CE484222325
            for byte in x.encode() if isinstance(x, str) else x:
                h = ((h ^ byte) * 0x100000001B3) & 0xFFFFFFFFFFFFFFFF
        else:
            h = int(x) & 0xFFFFFFFFFFFFFFFF
        out = []
        for i in range(self.hashes):
            z = (h + (i + 1) * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF
            z = ((z ^ (z >> 30)) * 0xBF58476D1CE4E5B9) & 0xFFFFFFFFFFFFFFFF
            z = ((z ^ (z >> 27)) * 0x94D049BB133111EB) & 0xFFFFFFFFFFFFFFFF
            out.append((z ^ (z >> 31)) & self.mask)
        return out

    def insert(self, x) -> None:
        self.field[self._places(x)] = True

    def __contains__(self, x) -> bool:
        return bool(self.field[self._places(x)].all())

    def clear(self) -> None:
        self.field[:] = False


def hashed_partitions(flows: DataFrame, n: int = 100) -> DataFrame:
    """pid by a hash of the source (the first 32 bits of its md5): stateless, for any size."""
    digest = F.md5(F.col("src_ip").cast("string"))
    return flows.withColumn("pid", F.pmod(F.conv(F.substring(digest, 1, 8), 16, 10).cast("long"), F.lit(n)))


def greedy_partitions(flows: DataFrame, n: int = 100, idx: str = "flow_idx", bits: int | None = None) -> DataFrame:
    """pid by linear deterministic greedy placement, in order of idx: hits of both
    ends less the share of the largest load, the lowest id of several.  Sequential
    by nature: one ordered task, with exact node sets or, given ``bits``, a Bloom
    filter of as many bits for each partition; ``hashed_partitions`` scales."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(idx)
        load = np.zeros(n)
        homes: dict[int, np.ndarray] = {}
        none = np.zeros(n, bool)
        places, fields = (Bloom(bits)._places, np.zeros((n, bits), bool)) if bits else (None, None)
        known = lambda node: fields[:, places(node)].all(1) if bits else homes.get(node, none)
        out = []
        for s, d in zip(pdf["src_ip"], pdf["dst_ip"], strict=True):
            score = known(s).astype(float) + known(d) - load / (load.max() + 1)
            p = int(score.argmax())
            load[p] += 1
            for node in (s, d):
                if bits:
                    fields[p, places(node)] = True
                else:
                    homes.setdefault(node, np.zeros(n, bool))[p] = True
            out.append(p)
        return pd.DataFrame({idx: pdf[idx].astype("int64"), "pid": np.array(out, np.int64)})

    placed = flows.select(idx, "src_ip", "dst_ip").withColumn("_one", F.lit(1)).groupBy("_one").applyInPandas(run, f"{idx} long, pid long")
    return flows.join(placed, idx)
