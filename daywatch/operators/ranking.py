"""Exact global ranks, running totals and quantiles without a one-task sort.

Quantiles need no order at all: mergeable sketches bracket them and counts settle them.
For ranks, a global window would pull every row into one task.  Here Spark's range partitioner
deals the rows, every row is tagged with its partition's number, and the result is
written once so that the tag is stable.  Partitions are monotone in the sort order, so
a running total is the local one plus the totals of the lower partitions.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from daywatch.params import Params
from daywatch.session import materialise


def running_totals(df: DataFrame, keys: list[str | Column],
                   sums: dict[str, str | Column]) -> DataFrame:
    """Adds, for each `name: value`, the running sum of `value` in order of `keys`.

    `keys` are column names or sort expressions that order the rows uniquely
    (aggregate equal keys first).  The same plan at every size.
    """
    values = {f"_v_{n}": (F.col(v) if isinstance(v, str) else v) for n, v in sums.items()}
    dealt = df.withColumns(values).repartitionByRange(*keys)
    parts = materialise(dealt.withColumn("_part", F.spark_partition_id()), "ranges")
    per_part = parts.groupBy("_part").agg(*[F.sum(f"_v_{n}").alias(f"_t_{n}") for n in sums])
    # one row per shuffle partition
    lower = W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    base = per_part.select(
        "_part", *[F.coalesce(F.sum(f"_t_{n}").over(lower), F.lit(0)).alias(f"_b_{n}")
                   for n in sums])
    upto = W.partitionBy("_part").orderBy(*keys).rowsBetween(W.unboundedPreceding, 0)
    local = parts.withColumns({f"_l_{n}": F.sum(f"_v_{n}").over(upto) for n in sums})
    out = local.join(F.broadcast(base), "_part")
    return out.select(*df.columns,
                      *[(F.col(f"_l_{n}") + F.col(f"_b_{n}")).alias(n) for n in sums])


def indexed(df: DataFrame, keys: list[str], seed: int, name: str = "_idx") -> DataFrame:
    """Adds a dense number from 0 in a pseudorandom order that the keys alone decide."""
    mark = F.xxhash64(*keys, F.lit(seed))
    rows = running_totals(df.withColumn("_mark", mark), ["_mark", *keys], {name: F.lit(1)})
    return rows.drop("_mark").withColumn(name, F.col(name) - 1)


def sketch_size(error: float) -> int:
    """The KLL parameter k for a rank error of about `error` (published error curve)."""
    return min(65_535, max(8, math.ceil((2.296 / error) ** (1 / 0.9021))))


def _clean(df: DataFrame, cols: list[str], keep: list[str] = []) -> DataFrame:
    """The columns as doubles, NaN as null."""
    return df.select(*keep, *[F.when(~F.isnan(F.col(c).cast("double")),
                                     F.col(c).cast("double")).alias(c) for c in cols])


def sketches(df: DataFrame, cols: list[str], by: list[str],
             error: float = Params.quantile_error) -> DataFrame:
    """A mergeable KLL sketch and a count of each column per group: `by`, `n|c`, `s|c`.

    Kept beside a table partitioned by day, they give `exact_quantiles` its brackets
    without a pass over older days.
    """
    k = sketch_size(error)
    return _clean(df, cols, by).groupBy(*by).agg(*[x for c in cols for x in (
        F.count(c).alias(f"n|{c}"), F.kll_sketch_agg_double(c, k).alias(f"s|{c}"))])


@dataclass
class _Span:
    """A bracket around the ranks `first` and `last` of a column."""
    col: str
    first: int
    last: int
    part: float          # how far the quantile lies between the two
    lo: float
    hi: float
    size: float          # values strictly inside, as far as the sketch knows

    def find(self, rank: int, below: int, at_lo: int, inside: int, at_hi: int, values):
        """The value of a rank; None when it lies inside and `values` is not given."""
        nth = rank - below
        if nth < 0 or nth >= at_lo + inside + at_hi:
            raise LookupError("the bracket misses its rank")
        if nth < at_lo:
            return self.lo
        if nth >= at_lo + inside:
            return self.hi
        return None if values is None else values[nth - at_lo]


def exact_quantiles(df: DataFrame, cols: list[str], probs: list[float],
                    error: float = Params.quantile_error, days: DataFrame | None = None,
                    keep: int = 1_000_000) -> dict[tuple[str, float], float]:
    """Linear-interpolated quantiles, exact at any size, by one path and without a shuffle.

    A KLL sketch per column (one pass, or the merged `days` of `sketches`) brackets every
    quantile.  The next pass counts what lies below and at the ends of each bracket and
    looks inside: about 6 * `error` of the rows at most, since a value with more rows than
    that is an end.  At most `keep` values in all reach the driver; larger insides are
    sketched again in the same pass and narrowed by that.
    """
    clean, k = _clean(df, cols), sketch_size(error)
    slack, grid = 2 * error, [i / 512 for i in range(513)]
    edges = F.array(*[F.lit(e) for q in probs for e in (max(0.0, q - slack), min(1.0, q + slack))])

    def bracket(n, sketch, ranks):
        return F.when(n > 0, F.kll_sketch_get_quantile_double(sketch, ranks))

    if days is None:
        known = sketches(df, cols, [], error)
    else:
        known = days.agg(*[x for c in cols for x in (
            F.sum(f"n|{c}").alias(f"n|{c}"), F.kll_merge_agg_double(f"s|{c}").alias(f"s|{c}"))])
    row = known.select(*[x for c in cols for x in (
        F.col(f"n|{c}").alias(f"n|{c}"),
        bracket(F.col(f"n|{c}"), F.col(f"s|{c}"), edges).alias(f"e|{c}"))]).first()
    out, todo = {(c, q): None for c in cols for q in probs}, {}
    for c in cols:
        n = row[f"n|{c}"] or 0
        for i, q in enumerate(probs):
            if n:
                at = q * (n - 1)
                lo, hi = row[f"e|{c}"][2 * i:2 * i + 2]
                todo[c, q] = _Span(c, math.floor(at), math.ceil(at), at - math.floor(at), lo, hi,
                                   6 * error * n)
    while todo:
        room = keep / len(todo)
        items = list(todo.items())
        counts, looks = [], []
        for g, (_, s) in enumerate(items):
            x = F.col(s.col)
            inner = (x > s.lo) & (x < s.hi)
            counts += [F.count_if(x < s.lo).alias(f"below{g}"), F.count_if(x == s.lo).alias(f"lo{g}"),
                       F.count_if(inner).alias(f"in{g}"),
                       F.count_if((x == s.hi) & (x > s.lo)).alias(f"hi{g}"),
                       (F.collect_list(F.when(inner, x)) if s.size <= room else
                        F.kll_sketch_agg_double(F.when(inner, x), k)).alias(f"x{g}")]
            look = F.col(f"x{g}")
            if s.size > room:
                look = bracket(F.col(f"in{g}"), look, F.array(*map(F.lit, grid)))
            looks += [*[F.col(f"{k_}{g}") for k_ in ("below", "lo", "in", "hi")], look.alias(f"x{g}")]
        row = clean.agg(*counts).select(*looks).first()
        todo = {}
        for g, (key, s) in enumerate(items):
            seen = [row[f"{k_}{g}"] for k_ in ("below", "lo", "in", "hi")]
            values = sorted(row[f"x{g}"]) if s.size <= room else None
            try:
                low, high = (s.find(r, *seen, values) for r in (s.first, s.last))
            except LookupError:        # widen to all values and look again, more closely
                todo[key] = replace(s, lo=-math.inf, hi=math.inf, size=math.inf)
                continue
            if low is None or high is None:
                # the grid's values around the rank, as far as the sketch may err
                nth = (s.first - seen[0] - seen[1]) / seen[2]
                a = max(0, math.floor((nth - slack) * (len(grid) - 1)))
                b = min(len(grid) - 1, math.ceil((nth + 1 / seen[2] + slack) * (len(grid) - 1)))
                todo[key] = replace(s, lo=row[f"x{g}"][a] if low is None else s.lo,
                                    hi=row[f"x{g}"][b] if high is None else s.hi,
                                    size=(grid[b] - grid[a] + 2 * error) * seen[2])
            else:
                out[key] = low + (high - low) * s.part
    return out
