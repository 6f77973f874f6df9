"""Isolation forest (Liu, Ting and Zhou, 2008), grown and applied on Spark.

Fitting needs `trees` samples of at most `tree_rows` rows.  They are bottom-k sketches on
hashes of the keys, so the draw does not depend on partitioning, and only the drawn rows
are shuffled.  Each tree grows in a task of its own; scoring is one
vectorised pass with the node table (at most trees * (2 * tree_rows - 1) rows)
broadcast.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from typing import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from daywatch.functions import columns as C
from daywatch.operators.ranking import exact_quantiles
from daywatch.params import Params
from daywatch.session import materialise

NODE_SCHEMA = ("tree_id int, node_id int, feature int, threshold double, "
               "left int, right int, size int, depth int")


def path_norm(n):
    """Mean path length of an unsuccessful search among n rows (c(n) of the paper)."""
    n = np.asarray(n, dtype="float64")
    many = 2.0 * (np.log(np.maximum(n - 1.0, 1.0)) + np.euler_gamma) \
        - 2.0 * (n - 1.0) / np.maximum(n, 1.0)
    return np.where(n > 2, many, np.where(n == 2, 1.0, 0.0))


def grow_tree(rows: np.ndarray, limit: int, rng: np.random.Generator) -> list[tuple]:
    """(node, feature, threshold, left, right, size, depth) of one random tree."""
    nodes: list[list] = []
    todo = [(rows, 0, -1, 0)]
    while todo:
        part, depth, parent, slot = todo.pop()
        me = len(nodes)
        nodes.append([me, -1, 0.0, me, me, len(part), depth])
        if parent >= 0:
            nodes[parent][slot] = me
        if depth >= limit or len(part) <= 1:
            continue
        lo, hi = part.min(axis=0), part.max(axis=0)
        usable = np.flatnonzero(hi > lo)
        if not len(usable):
            continue
        f = int(rng.choice(usable))
        cut = float(rng.uniform(lo[f], hi[f]))
        goes_left = part[:, f] <= cut
        nodes[me][1], nodes[me][2] = f, cut
        todo.append((part[~goes_left], depth + 1, me, 4))
        todo.append((part[goes_left], depth + 1, me, 3))
    return [tuple(n) for n in nodes]


@dataclass(frozen=True)
class Forest:
    """All trees in flat arrays; a leaf is its own child."""
    roots: np.ndarray
    feature: np.ndarray
    threshold: np.ndarray
    child: np.ndarray     # left child of node i at 2 i, right child at 2 i + 1
    length: np.ndarray    # path length credited at the node
    depth: int
    norm: float

    def raw(self, x: np.ndarray, block: int = 256) -> np.ndarray:
        """Negated anomaly score per row, in (-1, 0): lower is more anomalous."""
        out = np.empty(len(x))
        for start in range(0, len(x), block):   # blocks that stay in cache
            part = x[start:start + block]
            flat = np.ascontiguousarray(part).ravel()
            offset = (np.arange(len(part), dtype="int32") * x.shape[1])[:, None]
            at = np.repeat(self.roots[None, :], len(part), axis=0)
            for _ in range(self.depth):
                right = flat.take(self.feature.take(at) + offset) > self.threshold.take(at)
                at = self.child.take(2 * at + right)
            out[start:start + block] = self.length.take(at).mean(axis=1)
        return -np.exp2(-out / self.norm)

    def raw_replaced(self, x: np.ndarray, other: np.ndarray, block: int = 256
                     ) -> tuple[np.ndarray, np.ndarray]:
        """`raw` of every row, and of every row with one column taken from `other`, by column.

        A tree is left alone where no node on the row's path decides otherwise for the new
        value.  Else the changed row leaves the path at the first such node, and only the
        rest of its way is walked.
        """
        trees, width = len(self.roots), x.shape[1]
        base, changed = np.empty(len(x)), np.empty((len(x), width))
        for start in range(0, len(x), block):
            old = np.ascontiguousarray(x[start:start + block]).ravel()
            new = np.ascontiguousarray(other[start:start + block]).ravel()
            n = len(old) // width
            offset = np.repeat(np.arange(n) * width, trees)       # one entry per row and tree
            at = np.tile(self.roots, n)
            left = np.zeros(len(at) * width, bool)                # by row, tree and column
            # rows off the path: which entry, which column, the node reached so far
            entry, column, place = (np.empty(0, np.int64) for _ in range(3))
            for _ in range(self.depth):
                tested, cut = self.feature.take(place), self.threshold.take(place)
                cell = offset.take(entry) + tested
                value = np.where(tested == column, new.take(cell), old.take(cell))
                place = self.child.take(2 * place + (value > cut))
                tested, cut = self.feature.take(at), self.threshold.take(at)
                cell = offset + tested
                right = old.take(cell) > cut
                turned = np.flatnonzero((new.take(cell) > cut) != right)
                mark = turned * width + tested.take(turned)
                first = ~left.take(mark)
                turned, left[mark] = turned[first], True
                entry = np.concatenate((entry, turned))
                column = np.concatenate((column, tested.take(turned)))
                place = np.concatenate((place, self.child.take(2 * at.take(turned) + ~right.take(turned))))
                at = self.child.take(2 * at + right)
            length = self.length.take(at)
            mean = length.reshape(n, trees).mean(axis=1)
            more = np.bincount(offset.take(entry) + column, minlength=n * width,
                               weights=self.length.take(place) - length.take(entry))
            base[start:start + n] = mean
            changed[start:start + n] = mean[:, None] + more.reshape(n, width) / trees
        return -np.exp2(-base / self.norm), -np.exp2(-changed / self.norm)


def _flatten(nodes: pd.DataFrame, tree_rows: int) -> Forest:
    nodes = nodes.sort_values(["tree_id", "node_id"], kind="stable").reset_index(drop=True)
    roots = np.flatnonzero(nodes["node_id"].to_numpy() == 0)
    base = np.repeat(roots, np.diff(np.append(roots, len(nodes))))
    feature = nodes["feature"].to_numpy()
    pairs = nodes[["left", "right"]].to_numpy() + base[:, None]
    return Forest(
        roots=roots.astype("int32"),
        feature=np.maximum(feature, 0).astype("int32"),
        threshold=np.where(feature < 0, np.inf, nodes["threshold"].to_numpy("float64")),
        child=pairs.ravel().astype("int32"),
        length=nodes["depth"].to_numpy() + path_norm(nodes["size"].to_numpy()),
        depth=int(nodes["depth"].max()),
        norm=float(path_norm(tree_rows)) or 1.0)


def spread(df: DataFrame, groups: int, key: str) -> DataFrame:
    """Partition by `key` for work that is heavy per row, not per byte.

    AQE would merge such small partitions into one task; an explicit number of
    partitions is left alone, and a group-by on `key` needs no further shuffle.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(max(1, min(groups, 4 * cores)), key)


def draw_samples(train: DataFrame, keys: list[str], p: Params, margin: float = 2.0
                 ) -> tuple[DataFrame, int]:
    """`tree_rows` rows without replacement for every tree, as (tree_id, nth, features).

    A bottom-k sketch: each tree keeps the rows with the smallest hashes of (keys, tree).
    Rows first pass a threshold on one hash, which leaves a pool of about
    `pool_rows` at any number of training rows; every tree then looks at the
    `margin` * `tree_rows` rows of the pool that its own hash lets through, and keeps the
    smallest, before and after the only shuffle.  Keys alone decide, so partitions do not
    matter, and the training rows are neither sorted nor written.  A tree that comes out
    short (less than one draw in 1e20) shows in its root's size; `fit_iforest` then draws
    again with a wider margin.
    """
    total = train.count()
    size = min(p.tree_rows, total)
    share = min(1.0, max(p.pool_rows, p.trees * p.tree_rows) / max(1, total))
    pool = train.select(*keys, "features").filter(
        _unit(F.xxhash64(*keys, F.lit(p.seed))) < share)
    through = min(1.0, margin * size / max(1.0, share * total))
    marked = (pool.withColumn("tree_id", F.explode(F.sequence(F.lit(0), F.lit(p.trees - 1))))
              .withColumn("_mark", F.xxhash64(*keys, F.lit(p.seed), "tree_id"))
              .filter(_unit(F.col("_mark")) < through))
    order = W.partitionBy("tree_id").orderBy("_mark", *keys)
    drawn = marked.withColumn("nth", F.row_number().over(order)).filter(F.col("nth") <= size)
    return spread(drawn.select("tree_id", "nth", "features"), p.trees, "tree_id"), size


def _unit(mark: Column) -> Column:
    """A 64-bit hash as a number from 0 to 1."""
    return F.shiftrightunsigned(mark, 11) / F.lit(float(1 << 53))


@dataclass(frozen=True)
class IsolationForestModel:
    nodes: pd.DataFrame       # bounded: trees * (2 * tree_rows - 1) rows
    tree_rows: int
    score_min: float
    score_max: float
    offset: float             # raw score at the contamination quantile

    def forest(self) -> Forest:
        return _flatten(self.nodes, self.tree_rows)

    def raw_score(self, spark: SparkSession, features: Column) -> Column:
        shared = self.__dict__.get("_shared")
        if shared is None:                   # one broadcast per model, not per call
            shared = spark.sparkContext.broadcast(self.forest())
            object.__setattr__(self, "_shared", shared)

        @F.pandas_udf("double")
        def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            forest = shared.value
            for batch in batches:
                yield pd.Series(forest.raw(np.stack(batch.to_numpy()))
                                if len(batch) else [], dtype="float64")

        return score(features)

    def score(self, raw: Column) -> Column:
        """0 (like the most ordinary training row) to 100 (like the oddest)."""
        span = self.score_max - self.score_min + 1e-10
        return C.clip((F.lit(1.0) - (raw - F.lit(self.score_min)) / F.lit(span)) * 100.0,
                      0.0, 100.0)

    def label(self, raw: Column) -> Column:
        """-1 for an anomaly, else 1."""
        return F.when(raw < F.lit(self.offset), F.lit(-1)).otherwise(F.lit(1))

    def save(self, spark: SparkSession, path: str) -> None:
        spark.createDataFrame(self.nodes, NODE_SCHEMA).write.mode("overwrite") \
            .parquet(f"{path}/nodes")
        spark.createDataFrame(
            [(self.tree_rows, self.score_min, self.score_max, self.offset)],
            "tree_rows int, score_min double, score_max double, offset double"
        ).coalesce(1).write.mode("overwrite").parquet(f"{path}/calibration")

    @staticmethod
    def load(spark: SparkSession, path: str) -> "IsolationForestModel":
        c = spark.read.parquet(f"{path}/calibration").first()
        return IsolationForestModel(spark.read.parquet(f"{path}/nodes").toPandas(),
                                    c.tree_rows, c.score_min, c.score_max, c.offset)


def fit_iforest(train: DataFrame, p: Params = Params(),
                keys: tuple[str, ...] = ("user", "day")) -> IsolationForestModel:
    """Grow the trees, then calibrate on all training rows."""
    samples, size = draw_samples(train, list(keys), p)
    if size == 0:
        raise ValueError("no training rows")
    margin = 2.0
    limit, seed = max(1, math.ceil(math.log2(max(size, 2)))), p.seed

    def grow(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        tree = int(key[0])
        part = part.sort_values("nth", kind="stable")
        rng = np.random.default_rng([seed, tree])
        nodes = grow_tree(np.stack(part["features"].to_numpy()), limit, rng)
        return pd.DataFrame([(tree, *n) for n in nodes], columns=[
            "tree_id", "node_id", "feature", "threshold", "left", "right", "size", "depth"])

    while True:
        nodes = samples.groupBy("tree_id").applyInPandas(grow, NODE_SCHEMA).toPandas()
        whole = nodes[(nodes["node_id"] == 0) & (nodes["size"] == size)]
        if len(whole) == p.trees:
            break
        margin *= 4
        samples, _ = draw_samples(train, list(keys), p, margin)
    draft = IsolationForestModel(nodes, size, 0.0, 0.0, 0.0)
    raw = materialise(train.select(
        draft.raw_score(train.sparkSession, F.col("features")).alias("raw")), "iforest-raw")
    ends = raw.agg(F.min("raw").alias("lo"), F.max("raw").alias("hi")).first()
    offset = exact_quantiles(raw, ["raw"], [p.contamination])[("raw", p.contamination)]
    return IsolationForestModel(nodes, size, ends.lo, ends.hi, offset)
