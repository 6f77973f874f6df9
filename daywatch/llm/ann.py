"""Nearest neighbours with an inverted multi-index.

Both halves of the vectors are quantised on their own, with centroids fitted on a
bounded sample; a vector's cell is the pair of its nearest centroids.  The number of
centroids grows with the fourth root of the table, hence that of cells with its square
root.  A query visits cells in order of the summed centroid distance, with a heap over
the two sorted lists, until the visited cells hold `want` vectors.  Their entries are
ranked by exact distance.  `want` is the smallest number that finds `recall` of the true
neighbours of sampled probes, which one pass finds among all vectors by brute force.

All vectors are indexed, but of equal vectors only the k + 1 smallest ids: no other can
be an answer.  Neighbouring cells are packed into parts of bounded size, and a large cell
is cut into several.  An entry is sent to its part once, a query to the parts that hold
its cells.  A task holds the entries of one part and streams the part's queries past them.
"""

from __future__ import annotations

import pickle
from functools import reduce
from heapq import heappop, heappush

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F

from daywatch.llm.common import mix, stored

ROUTED = "part int, tag int, id bigint, v array<double>, cells array<int>"
SURVEY = "d int, probe int, dist double, cell int, n bigint"


def kmeans(x: np.ndarray, k: int, seed: int, rounds: int = 15) -> np.ndarray:
    """Lloyd's rounds from a seeded start; k at most the distinct rows."""
    if not x.shape[1]:                       # the second half of one component
        return x[:1].copy()
    distinct = np.unique(x, axis=0)
    rng = np.random.default_rng(seed)
    c = distinct[rng.permutation(len(distinct))[:k]].copy()
    for _ in range(rounds):
        at = nearest(x, c)
        count = np.bincount(at, minlength=len(c))
        total = np.zeros_like(c)
        np.add.at(total, at, x)
        c[count > 0] = total[count > 0] / count[count > 0, None]
    return c


def squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.maximum(0, (x ** 2).sum(1)[:, None] + (c ** 2).sum(1)[None] - 2 * x @ c.T)


def nearest(x, c):
    return squared(x, c).argmin(1)


def visited(d1: np.ndarray, d2: np.ndarray, count: np.ndarray, want: int) -> list[tuple[int, int]]:
    """Cells by summed distance until they hold `want` vectors (a heap over both lists)."""
    o1, o2 = np.argsort(d1, kind="stable"), np.argsort(d2, kind="stable")
    s1, s2, a, b = d1[o1].tolist(), d2[o2].tolist(), o1.tolist(), o2.tolist()
    heap, seen, out, total = [(s1[0] + s2[0], 0, 0)], {(0, 0)}, [], 0
    while heap and total < want:
        _, i, j = heappop(heap)
        n = count[a[i], b[j]]
        if n:
            out.append((a[i], b[j]))
            total += int(n)
        for p, q in ((i + 1, j), (i, j + 1)):
            if p < len(a) and q < len(b) and (p, q) not in seen:
                seen.add((p, q))
                heappush(heap, (s1[p] + s2[q], p, q))
    return out


def centroids_for(n: int) -> int:
    """Centroids of each half for n vectors."""
    return int(np.ceil(4 * n ** 0.25))


class Index:
    """Centroids of both halves for the vectors of one length, and probes for calibration."""

    def __init__(self, ids: np.ndarray, sample: np.ndarray, cells: int, seed: int, probes: int):
        self.half = max(1, sample.shape[1] // 2)
        self.mean = sample.mean(0)           # expanded squares are exact near the origin only
        sample = sample - self.mean
        self.first = kmeans(sample[:, :self.half], cells, seed)
        self.second = kmeans(sample[:, self.half:], cells, seed + 1)
        own = np.random.default_rng(seed).permutation(len(sample))[:probes]
        self.probes, self.probe_ids = sample[own], ids[own]
        self.shape = len(self.first), len(self.second)

    def cell(self, x: np.ndarray) -> np.ndarray:
        """Numbers of the cells of centred vectors."""
        return (nearest(x[:, :self.half], self.first) * self.shape[1]
                + nearest(x[:, self.half:], self.second))

    def distances(self, x):
        return squared(x[:, :self.half], self.first), squared(x[:, self.half:], self.second)

    def calibrate(self, count: np.ndarray, near: list[tuple[int, int]], recall: float, k: int) -> None:
        """`count`: vectors per cell; `near`: (probe, cell of one of its true neighbours)."""
        self.count = count.reshape(self.shape)
        d1, d2 = self.distances(self.probes)
        cells: dict[int, list[int]] = {}
        for p, c in near:
            cells.setdefault(p, []).append(c)
        need = []
        for p, own in cells.items():
            total = (d1[p][:, None] + d2[p][None]).ravel()
            order = np.argsort(total, kind="stable")
            place = np.searchsorted(total[order], total[own], "right") - 1
            need.extend(np.cumsum(count[order])[place].tolist())
        self.want = max(k + 1, int(np.quantile(need, recall, method="higher")) if need else 0)

    def lay_out(self, first: int, rows: int) -> int:
        """Parts of about `rows` vectors (less than twice that), numbered from `first`:
        runs of small cells, and slices of a larger one.  Returns the next free number."""
        count = self.count.ravel()
        large = count > rows
        small = np.where(large, 0, count)
        run = (np.cumsum(small) - small) // rows
        self.slices = np.where(large, count // rows + 1, 1)
        cut = np.where(large, self.slices, 0)
        runs = int(run.max()) + 1
        self.part = first + np.where(large, runs + np.cumsum(cut) - cut, run)
        return first + runs + int(cut.sum())


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """vec_id and vector as doubles, without null, zero or non-finite vectors."""
    rows = vectors.select(F.col(id_col).cast("bigint").alias("vec_id"),
                          F.col(vector_col).cast("array<double>").alias("v"))
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = rows.filter(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0))
    return rows.filter(~bad).filter(F.exists("v", lambda x: x != 0))


def _matrix(column) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1)


def _by_length(batch, models):
    """For each length with a model: the model, ids, vectors and centred vectors."""
    ids, column = batch.column(0).to_numpy(), batch.column(1)
    size = pc.list_value_length(column).to_numpy(zero_copy_only=False)
    for d in np.unique(size).tolist():
        if d in models:
            at = np.flatnonzero(size == d)
            x = _matrix(column.take(pa.array(at)))
            yield models[d], d, ids[at], x, x - models[d].mean


def _fit(key, sample, cells, seed, probes):
    sample = sample.sort_values("vec_id")
    index = Index(sample["vec_id"].to_numpy(np.int64), np.array(sample["v"].tolist(), float),
                  cells[key[0]], seed, probes)
    return pd.DataFrame({"d": [key[0]], "model": [pickle.dumps(index)]})


def _survey(batches, models, k):
    """Of one task's vectors: how many lie in each cell, and the k nearest of every probe."""
    count, best = {}, {}
    for b in batches:
        for m, d, ids, _, x in _by_length(b, models):
            cell = m.cell(x)
            count[d] = count.get(d, 0) + np.bincount(cell, minlength=m.shape[0] * m.shape[1])
            dist = squared(m.probes, x)
            dist[m.probe_ids[:, None] == ids[None]] = np.inf
            cell = np.broadcast_to(cell, dist.shape)
            if d in best:
                dist, cell = np.hstack((best[d][0], dist)), np.hstack((best[d][1], cell))
            at = np.argpartition(dist, min(k, dist.shape[1]) - 1, axis=1)[:, :k]
            best[d] = np.take_along_axis(dist, at, 1), np.take_along_axis(cell, at, 1)
    for d, n in count.items():
        at = np.flatnonzero(n)
        yield _rows(SURVEY, [np.full(len(at), d), np.full(len(at), -1), np.zeros(len(at)), at, n[at]])
        dist, cell = best[d]
        p, c = np.nonzero(np.isfinite(dist))
        yield _rows(SURVEY, [np.full(len(p), d), p, dist[p, c], cell[p, c], np.ones(len(p))])


_TYPES = {"int": pa.int32(), "bigint": pa.int64(), "double": pa.float64(),
          "array<double>": pa.list_(pa.float64()), "array<int>": pa.list_(pa.int32())}


def _rows(schema: str, columns: list) -> pa.RecordBatch:
    names, types = zip(*(f.split(" ") for f in schema.split(", ")))
    return pa.RecordBatch.from_arrays([
        c if isinstance(c, pa.Array) else pa.array(np.asarray(c).astype(_TYPES[t].to_pandas_dtype()))
        for c, t in zip(columns, types)], list(names))


def _lists(offsets, values) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values)


def _vectors(x: np.ndarray) -> pa.Array:
    return _lists(np.arange(len(x) + 1) * x.shape[1], pa.array(x.ravel(), pa.float64()))


def _place(batches, models):
    """Every vector once, as an entry of its part."""
    for b in batches:
        for m, _, ids, x, centred in _by_length(b, models):
            cell = m.cell(centred)
            part = m.part[cell] + (mix(ids.astype(np.uint64)) % m.slices[cell].astype(np.uint64)).astype(int)
            yield _rows(ROUTED, [part, np.zeros(len(ids)), ids, _vectors(x),
                                 _lists(np.arange(len(ids) + 1), pa.array(cell, pa.int32()))])


def _route(batches, models):
    """A query once per part that it visits, with its cells there."""
    for b in batches:
        for m, _, ids, x, centred in _by_length(b, models):
            d1, d2 = m.distances(centred)
            for at in range(0, len(ids), 64):          # bounds what one batch grows to
                part, row, cells = [], [], []
                for r in range(at, min(at + 64, len(ids))):
                    own: dict[int, list[int]] = {}
                    for i, j in visited(d1[r], d2[r], m.count, m.want):
                        cell = i * m.shape[1] + j
                        for s in range(m.slices[cell]):
                            own.setdefault(int(m.part[cell]) + s, []).append(cell)
                    part += own
                    row += [r] * len(own)
                    cells += own.values()
                yield _rows(ROUTED, [part, np.ones(len(part)), ids[row], _vectors(x[row]),
                                     pa.array(cells, pa.list_(pa.int32()))])


def rerank(entries: pa.Table, queries: pa.Table, k: int, wide: int) -> pa.Table:
    """The k nearest entries of one part for each query, by exact distance.

    Entries name their cell (`j`), queries the cells that they visit (`js`), out of `wide`.
    """
    out_q, out_v, out_d = [], [], []
    if entries.num_rows and queries.num_rows:
        ids = entries.column("vec_id").to_numpy()
        x = _matrix(entries.column("v").combine_chunks())
        j = entries.column("j").to_numpy()
        q = _matrix(queries.column("q").combine_chunks())
        js = queries.column("js").to_pylist()
        qid = queries.column("query_id").to_pylist()
        # squares are expanded around the part's mean; their rounding error has this bound
        mean = x.mean(0)
        centred = x - mean
        slack, norm = 4 * np.finfo(float).eps * (x.shape[1] + 4), (centred ** 2).sum(1)
        for at in range(0, len(q), 64):
            own = q[at:at + 64] - mean
            d = squared(own, centred)
            error = slack * ((own ** 2).sum(1)[:, None] + norm[None])
            for r in range(len(d)):
                open_ = np.zeros(wide, bool)
                open_[js[at + r]] = True
                row = np.where(open_[j] & (ids != qid[at + r]), d[r] + error[r], np.inf)
                found = np.isfinite(row).sum()
                if not found:
                    continue
                # all that may be among the k nearest, ties and rounding included
                edge = np.partition(row, min(k, found) - 1)[min(k, found) - 1]
                near = np.flatnonzero(row - 2 * error[r] <= edge)
                exact = np.sqrt(((x[near] - q[at + r]) ** 2).sum(1))
                order = np.lexsort((ids[near], exact))[:k]
                out_q.append(np.full(len(order), qid[at + r]))
                out_v.append(ids[near][order])
                out_d.append(exact[order])
    cat = lambda p, t: pa.array(np.concatenate(p) if p else [], t)
    return pa.table({"query_id": cat(out_q, pa.int64()), "vec_id": cat(out_v, pa.int64()),
                     "score": cat(out_d, pa.float64())})


def _meet(batches, k):
    """Rows by part, entries before queries: holds a part's entries, streams its queries."""
    part, held, entries, names = None, [], None, None
    for b in batches:
        key = b.column(0).to_numpy() * 2 + b.column(1).to_numpy()
        cuts = [0, *(np.flatnonzero(np.diff(key)) + 1).tolist(), len(key)] if len(key) else []
        for lo, hi in zip(cuts, cuts[1:]):
            piece, (own, tag) = b.slice(lo, hi - lo), divmod(int(key[lo]), 2)
            if own != part:
                part, held, entries = own, [], None
            if tag == 0:
                held.append(piece)
                continue
            if entries is None and held:
                whole = pa.Table.from_batches(held)
                names, j = np.unique(whole.column(4).combine_chunks().flatten().to_numpy(), return_inverse=True)
                entries = pa.table({"vec_id": whole.column(2), "v": whole.column(3), "j": j})
            if entries is not None:          # a slice of a cell may be empty
                cells = [np.flatnonzero(np.isin(names, c)) for c in piece.column(4).to_pylist()]
                queries = pa.table({"query_id": piece.column(2), "q": piece.column(3),
                                    "js": pa.array(cells, pa.list_(pa.int64()))})
                yield from rerank(entries, queries, k, len(names)).to_batches()


def search(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 10,
           every: int = 100, cells: int | None = None, recall: float = 0.95, bound: int = 20_000,
           part_rows: int = 4000, seed: int = 17, probes: int = 200,
           model_bytes: int = 64 << 20) -> DataFrame:
    """query_id, rank, vec_id, score: for each id divisible by `every`, its k nearest found.

    Ties go to the smaller id.  Vectors take no part when null, zero, holding null or
    non-finite components.  Vectors of each length are searched among themselves: there
    is no distance between lengths.  Rows that repeat an id count once, by their first
    vector in order.  Fewer candidates than k give all of them; an empty table gives no
    rows; other columns are not read.  `recall` is what the calibration aims at, `cells`
    overrides the number of centroids of each half, and `bound` vectors of each length at
    most fit them.  Lengths are searched together as long as their models take at most
    `model_bytes`, beyond that in several runs.
    """
    spark = vectors.sparkSession
    rows = usable(vectors, id_col, vector_col).groupBy("vec_id").agg(F.min("v").alias("v"))
    turn = F.row_number().over(Window.partitionBy(F.xxhash64("v"), "v").orderBy("vec_id"))
    listed = stored(rows.withColumn("turn", turn).filter(F.col("turn") <= k + 1).select("vec_id", "v"),
                    "ann-vectors")
    wanted = rows.filter(F.col("vec_id") % every == 0)
    # as many rows as there are lengths, at most the longest vector's
    sizes = listed.groupBy(F.size("v").alias("d")).count().filter("count > 1").orderBy("d").collect()
    runs, used = [], model_bytes
    for d, n in sizes:
        c = cells or centroids_for(n)
        need = 8 * (d * (2 * c + probes) + 3 * c * c)
        if used + need > model_bytes:
            runs.append({})
            used = 0
        runs[-1][d] = (n, c)
        used += need
    schema = "query_id bigint, rank int, vec_id bigint, score double"
    if not runs:
        return spark.createDataFrame([], schema)
    found = reduce(DataFrame.unionByName, [
        _search(listed, wanted, own, k, recall, bound, part_rows, seed, probes) for own in runs])
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return (found.withColumn("rank", rank).filter(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))


def _search(listed: DataFrame, wanted: DataFrame, sizes: dict[int, tuple[int, int]], k, recall, bound,
            part_rows, seed, probes) -> DataFrame:
    """The k nearest of each query in each part that it visits; `sizes`: (vectors, cells) by length."""
    length = F.size("v")
    rate = F.element_at(F.create_map(*[F.lit(x) for d, (n, _) in sizes.items()
                                       for x in (d, int(min(1, bound / n) * (1 << 32)))]), length)
    sample = listed.withColumn("d", length).filter(
        F.pmod(F.xxhash64("vec_id", F.lit(seed)), F.lit(1 << 32)) < rate)
    cells = {d: c for d, (_, c) in sizes.items()}
    fitted = sample.groupBy("d").applyInPandas(
        lambda key, own: _fit(key, own, cells, seed, probes), "d int, model binary").collect()
    models = {r["d"]: pickle.loads(r["model"]) for r in fitted}

    seen = stored(listed.select("vec_id", "v").mapInArrow(lambda it: _survey(it, models, k), SURVEY),
                  "ann-survey")
    count = {d: np.zeros(m.shape[0] * m.shape[1], np.int64) for d, m in models.items()}
    for r in seen.filter("probe < 0").groupBy("d", "cell").agg(F.sum("n").alias("n")).collect():
        count[r["d"]][r["cell"]] = r["n"]
    turn = F.row_number().over(Window.partitionBy("d", "probe").orderBy("dist", "cell"))
    near: dict[int, list] = {}
    for r in seen.filter("probe >= 0").withColumn("turn", turn).filter(F.col("turn") <= k).collect():
        near.setdefault(r["d"], []).append((r["probe"], r["cell"]))
    free = 0
    for d, m in sorted(models.items()):
        m.calibrate(count[d], near.get(d, []), recall, k)
        free = m.lay_out(free, part_rows)
        del m.probes, m.probe_ids

    entries = listed.mapInArrow(lambda it: _place(it, models), ROUTED)
    queries = wanted.mapInArrow(lambda it: _route(it, models), ROUTED)
    met = entries.unionByName(queries).repartition("part").sortWithinPartitions("part", "tag")
    return met.mapInArrow(lambda it: _meet(it, k), "query_id bigint, vec_id bigint, score double")
