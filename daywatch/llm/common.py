"""What several operators share: stored results, held-out rows, words as numpy arrays.

Words are runs of characters other than blank and tab to carriage return.  The
array helpers work on the bytes of an Arrow column, so their memory follows the
batch (or the one longest text), never the table.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, functions as F

from daywatch.session import scratch_dir

WS = " \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

IS_WS = np.zeros(256, bool)
IS_WS[[0x20, *range(0x09, 0x0E)]] = True


def stored_and_counted(df: DataFrame, name: str, which: Column | None = None):
    """`stored`, and how many rows it has (or how many of them are `which`), counted while
    they are written."""
    seen = Observation()
    count = F.count(F.lit(1)) if which is None else F.count_if(which)
    kept = stored(df.observe(seen, count.alias("n")), name)
    return kept, seen.get["n"]


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write `df` below the shared checkpoint folder and read it back.

    The copy outlives lost executors and cuts lineage.  The shuffle files of the
    write are removed when it ends: its result no longer needs them.
    """
    spark = df.sparkSession
    path, before = scratch_dir(spark, name), spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def text_of(column: str = "text") -> Column:
    """The text, null as empty."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def packed(docs: DataFrame, **columns: Column) -> DataFrame:
    """All columns of a row as one struct `_row` beside the given ones: no name can clash."""
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row")
    return docs.select(whole, *[v.alias(k) for k, v in columns.items()])


def unpacked(rows: DataFrame, names: list[str], **changed: Column) -> DataFrame:
    """The columns of `_row` again, some replaced."""
    return rows.select(*[changed.get(c, F.col(f"_row.`{c}`")).alias(c) for c in names])


class Sieve:
    """A bit table of keys, of at most 16 MB at any number of them.

    It tells rows whose key is certainly not among the keys, where they lie and without a
    shuffle; the others (the keys' rows and a few more) are then settled by a join.  When
    keys are very many, more rows pass: the work grows, the result stays.
    """

    def __init__(self, keys: DataFrame, mark: Column, name: str):
        """`mark` is a 64-bit hash of a row's key."""
        few = 1 << 15
        self.bits = min(1 << 27, max(few, 1 << (16 * keys.count()).bit_length()))
        at = self._slot(mark)
        self.table = stored(keys.select(at.alias("at")).groupBy(
            F.bitmap_bucket_number("at").alias("_bucket"))
            .agg(F.bitmap_construct_agg(F.bitmap_bit_position("at")).alias("_bits")), name)

    def _slot(self, mark: Column) -> Column:
        return F.pmod(mark, F.lit(self.bits)) + 1

    def flagged(self, rows: DataFrame, mark: Column, name: str = "_maybe") -> DataFrame:
        """Adds whether a row's key may be among the keys."""
        at = self._slot(mark)
        place = F.bitmap_bit_position(at)
        byte = F.conv(F.hex(F.substring("_bits", (F.floor(place / 8) + 1).cast("int"), F.lit(1))), 16, 10)
        bit = F.shiftright(byte.cast("int"), 0).bitwiseAND(
            F.element_at(F.array(*[F.lit(1 << i) for i in range(8)]), (place % 8 + 1).cast("int"))) != 0
        # at most 4096 rows of 4 KB
        found = rows.withColumn("_at", F.bitmap_bucket_number(at)).join(
            F.broadcast(self.table), F.col("_at") == F.col("_bucket"), "left")
        return found.withColumn(name, F.coalesce(bit, F.lit(False))).drop("_at", "_bucket", "_bits")


def with_group(rows: DataFrame, groups: DataFrame, keys: list[str], size: str, total: int) -> DataFrame:
    """`rows` left-joined with `groups` by `keys`; `size` counts a group's rows.

    A group of over a thousandth of all `total` rows is looked up in place (there are fewer
    than a thousand), so that no key of the shuffle holds more.
    """
    often = F.col(size) * 1000 > total
    others = [c for c in groups.columns if c not in keys]
    big = F.broadcast(groups.filter(often).select(
        *[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], *[F.col(c).alias(f"_g_{c}") for c in others],
        F.lit(True).alias("_big")))
    same = [F.col(k) == F.col(f"_k{i}") for i, k in enumerate(keys)]
    met = rows.join(big, reduce(lambda a, b: a & b, same), "left")
    here = met.filter("_big").select(*rows.columns, *[F.col(f"_g_{c}").alias(c) for c in others])
    rest = met.filter("_big is null").select(*rows.columns).join(
        groups.filter(~often), keys, "left").select(*rows.columns, *others)
    return here.unionByName(rest)


def id_remainder(column: str, parts: int) -> Column:
    """crc32 of the id as text, modulo `parts`; null for a null id."""
    return F.crc32(F.col(column).cast("string")) % parts


def bounded_sample(rows: DataFrame, key: str, bound: int, seed: int) -> DataFrame:
    """About `bound` rows at most, chosen by a hash of the key at one rate for all rows.

    Only for fitting a model.  The rate comes from a count, so the choice does not
    depend on partitions and has no order to favour.
    """
    n = rows.count()
    if n <= bound:
        return rows
    limit = int(bound / n * (1 << 32))
    return rows.filter(F.pmod(F.xxhash64(F.col(key), F.lit(seed)), F.lit(1 << 32)) < limit)


# ---- Arrow text columns as arrays --------------------------------------------

def text_bytes(column) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets (from 0) of a text column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    if not len(column):
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    _, ends, data = column.buffers()
    offsets = np.frombuffer(ends, np.int64)[column.offset:column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8)[offsets[0]:offsets[-1]] if data else np.empty(0, np.uint8)
    return raw, offsets - offsets[0]


def blocks_of(offsets: np.ndarray, limit: int):
    """Row ranges holding about `limit` bytes each; a longer text has its own."""
    first, n = 0, len(offsets) - 1
    while first < n:
        last = int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1
        last = min(max(last, first + 1), n)
        yield first, last
        first = last


def word_spans(data: np.ndarray, offsets: np.ndarray):
    """Start, end and row of every word; a word never crosses rows."""
    if not len(data):
        e = np.empty(0, np.int64)
        return e, e, e
    inside = ~IS_WS[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    out = ~inside
    first = inside & (np.concatenate(([True], out[:-1])) | edge[:-1])
    last = inside & (np.concatenate((out[1:], [True])) | edge[1:])
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    return start, end, np.searchsorted(offsets, start, "right") - 1


_LANES = 64
_TABLE = np.random.Generator(np.random.PCG64(20240101)).integers(
    0, 1 << 64, (256, _LANES), dtype=np.uint64)


def mix(h: np.ndarray, salt: int = 0) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    with np.errstate(over="ignore"):
        h = h + np.uint64((salt * 0x9E3779B97F4A7C15 + 0x9E3779B97F4A7C15) & ((1 << 64) - 1))
        h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return h ^ (h >> np.uint64(31))


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hash of each byte span (not empty, in order, disjoint)."""
    if not len(start):
        return np.empty(0, np.uint64)
    size = end - start
    first = np.concatenate(([0], np.cumsum(size)[:-1]))
    at = np.arange(int(size.sum())) - np.repeat(first, size)
    raw = data[np.repeat(start, size) + at]
    with np.errstate(over="ignore"):
        part = _TABLE[raw, at % _LANES] * (2 * (at // _LANES) + 1).astype(np.uint64)
        return mix(np.add.reduceat(part, first) + size.astype(np.uint64))


def _powers(base: int, n: int) -> np.ndarray:
    p = np.full(n, base & ((1 << 64) - 1), np.uint64)
    if n:
        p[0] = 1
    with np.errstate(over="ignore"):
        return np.multiply.accumulate(p)


def window_hashes(words: np.ndarray, width: int, salt: int = 0) -> np.ndarray:
    """64-bit hash of every `width` consecutive word hashes (by start)."""
    n = len(words) - width + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    base = (0xD1342543DE82EF95 + 2 * salt * 0x2545F4914F6CDD1D) | 1
    w = mix(words, salt + 1)
    with np.errstate(over="ignore"):
        total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(w * _powers(base, len(w)),
                                                                  dtype=np.uint64)))
        back = _powers(pow(base, -1, 1 << 64), n)
        return mix((total[width:] - total[:n]) * back)


class Forest:
    """Components of numbered entries; labels always point to the least entry."""

    def __init__(self, n: int):
        self.label = np.arange(n)
        self.change = np.arange(n)

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        label = self.label
        while True:
            la, lb = label[a], label[b]
            apart = la != lb
            if not apart.any():
                break
            a, b, la, lb = a[apart], b[apart], la[apart], lb[apart]
            np.minimum.at(label, np.maximum(la, lb), np.minimum(la, lb))
            while True:
                up = label[label]
                if np.array_equal(up, label):
                    break
                label = up
        self.label = label
        self.change = np.concatenate(([0], np.cumsum(label[1:] != label[:-1])))

    def together(self, alo, ahi, blo, bhi) -> np.ndarray:
        """Node pairs whose entries are all in one component."""
        c = self.change
        return ((c[alo] == c[ahi - 1]) & (c[blo] == c[bhi - 1]) & (self.label[alo] == self.label[blo]))
