"""SimHash near-dedup: a binary trie joined with itself.

Fingerprints have 64 bits; those within `errors` differing bits are linked.  Copies share
a fingerprint and are one entry from the start.

The trie: 64 bits are cut into errors + 1 blocks, and there is one trie per block, which
reads the bits in a circle from that block on.  Node pairs are walked together from the
root, differing bits are added up, and a pair goes as soon as it exceeds the budget of its
depth: j * errors // (errors + 1) after j blocks, thus 0, 1, 2, 3, 4 for four errors.  No
link is lost: if the errors of two fingerprints are laid around the circle, some starting
block exists from which every running sum stays at or below the average (cycle lemma), and
that block's trie finds the pair.  Because the first block allows no error, the subtrees
below it are independent; they are what Spark shuffles and joins on.

A walk keeps the components of its entries and drops node pairs that already hang
together, and hands out one spanning edge per joined entry, so a dense family of
thousands yields thousands of rows, never their square.  Node pairs are numpy arrays, taken from a
stack in chunks: memory is bounded by the subtree's entries and the chunk size.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from daywatch.llm.common import (Forest, blocks_of, stored, stored_and_counted, text_bytes, text_of,
                                 word_spans)
from daywatch.llm.neardup import LOWER, components

BITS = 64
SEED = 42
# 256 x 8 lanes of one byte: the bits of a byte side by side
_LANES = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1,
                       bitorder="little").view(np.uint64)[:, 0]


# ---- fingerprints -------------------------------------------------------------

def shingle_hashes(data: np.ndarray, offsets: np.ndarray, words: int):
    """XXH64 of every shingle, repeats included, and the number of shingles of each row."""
    n = len(offsets) - 1
    data = LOWER[data]
    start, end, row = word_spans(data, offsets)
    count = np.bincount(row, minlength=n)
    if not len(start):
        return np.empty(0, np.uint64), count
    # the words again, one blank behind each
    size = end - start + 1
    at = np.concatenate(([0], np.cumsum(size)))
    take = np.repeat(start - at[:-1], size) + np.arange(at[-1])
    take[at[1:] - 1] = 0
    line = data[take]
    line[at[1:] - 1] = 0x20
    raw = line.tobytes()
    first = np.concatenate(([0], np.cumsum(count)))
    per = np.where(count >= words, count - words + 1, np.minimum(count, 1))
    cut = np.concatenate(([0], np.cumsum(per)))
    lead = np.repeat(first[:-1] - cut[:-1], per) + np.arange(cut[-1])
    last = np.minimum(lead + words, np.repeat(first[1:], per))
    digest = xxhash.xxh64_intdigest
    h = [digest(raw[a:b], SEED) for a, b in zip(at[lead].tolist(), (at[last] - 1).tolist())]
    return np.array(h, np.uint64), per


def majority(h: np.ndarray, per: np.ndarray) -> np.ndarray:
    """Each row's fingerprint: the bits set in over half of its hashes; 0 without any."""
    out = np.zeros(len(per), np.uint64)
    rows = np.flatnonzero(per)
    if not len(rows):
        return out
    # runs of at most 255 hashes are added byte-wise in 64-bit words, then per row
    size = per[rows]
    runs = -(-size // 255)
    lead = np.concatenate(([0], np.cumsum(runs)))
    nth = np.arange(lead[-1]) - np.repeat(lead[:-1], runs)
    at = np.repeat(np.concatenate(([0], np.cumsum(size)[:-1])), runs) + nth * 255
    raw = h.view(np.uint8).reshape(-1, 8)
    votes = np.empty((len(rows), BITS), np.int64)
    for i in range(8):
        lanes = np.add.reduceat(_LANES[raw[:, i]], at).view(np.uint8).reshape(-1, 8)
        votes[:, 8 * i:8 * i + 8] = np.add.reduceat(lanes.astype(np.int64), lead[:-1], axis=0)
    bits = (2 * votes > size[:, None]).astype(np.uint8)
    out[rows] = np.packbits(bits, axis=1, bitorder="little").view(np.uint64)[:, 0]
    return out


def _prints(batches, words):
    for b in batches:
        data, offsets = text_bytes(b.column(1))
        for lo, hi in blocks_of(offsets, 1 << 21):
            own = offsets[lo:hi + 1]
            found = majority(*shingle_hashes(data[own[0]:own[-1]], own - own[0], words))
            yield pa.RecordBatch.from_arrays(
                [b.column(0).slice(lo, hi - lo), pa.array(found.view(np.int64))], ["id", "fp"])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 words: int = 4) -> DataFrame:
    """(id, fp): the 64-bit SimHash of each text as a signed number.

    Letters A-Z are lowered; shingles are `words` words joined by a blank, repeats
    included; a text with fewer words is one shingle; without words, or null, it has
    fingerprint 0.
    """
    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), text_of(text_col).alias("text"))
    return rows.mapInArrow(lambda it: _prints(it, words), "id bigint, fp bigint")


# ---- the trie join ------------------------------------------------------------

def cuts(errors: int) -> list[int]:
    """First bit of each of errors + 1 blocks, from the highest, and 64."""
    return [round(i * BITS / (errors + 1)) for i in range(errors + 2)]


def turned(fp: np.ndarray, by: np.ndarray) -> np.ndarray:
    """Rotated left, so that bit `by` (from the highest) comes first."""
    left = by.astype(np.uint64)
    return (fp << left) | (fp >> ((np.uint64(BITS) - left) % np.uint64(BITS)))


def budgets(block: int, errors: int) -> np.ndarray:
    """Differing bits allowed after each of 64 bits, read in a circle from `block`."""
    edges = cuts(errors)
    width = np.roll(np.diff(edges), -block)
    return np.repeat(np.arange(1, errors + 2) * errors // (errors + 1), width)


def joined(key: np.ndarray, fp: np.ndarray, side: np.ndarray | None, block: int, errors: int,
           chunk: int = 1 << 17, small: int = 16):
    """Walk one block's tries: entries sorted by (key, turned bits); labels of the entries.

    Entries of one key form a trie.  `side` marks the two halves of a split subtree: only
    pairs across halves count (None: all pairs).  Also returns how many node pairs and how
    many entry pairs were looked at.
    """
    n, allowed = len(fp), budgets(block, errors)
    forest, ones = Forest(n), {}
    seen_nodes = seen_pairs = 0

    def cumulated(depth):
        if depth not in ones:
            bit = (fp >> np.uint64(BITS - 1 - depth)) & np.uint64(1)
            ones[depth] = np.concatenate(([0], np.cumsum(bit, dtype=np.int64)))
        return ones[depth]

    def halves(depth, lo, hi):
        c = cumulated(depth)
        return hi - (c[hi] - c[lo])

    first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if n else np.empty(0, int)
    last = np.append(first[1:], n)
    begin = cuts(errors)[block + 1] - cuts(errors)[block]    # the first block is the key
    zero = np.zeros(len(first), np.int8)
    stack = [(begin, first, last, first, last, zero)] if n else []
    while stack:
        depth, alo, ahi, blo, bhi, acc = stack.pop()
        if len(alo) > chunk:
            for at in range(0, len(alo), chunk):
                stack.append((depth, *[x[at:at + chunk] for x in (alo, ahi, blo, bhi, acc)]))
            continue
        seen_nodes += len(alo)
        go = (ahi - alo > 1) | (alo != blo)
        go &= ~forest.together(alo, ahi, blo, bhi)
        alo, ahi, blo, bhi, acc = (x[go] for x in (alo, ahi, blo, bhi, acc))
        area = (ahi - alo) * (bhi - blo)
        done = (area <= small) | (depth == BITS)
        if done.any():
            a0, na, b0, nb = alo[done], (ahi - alo)[done], blo[done], (bhi - blo)[done]
            for lo, hi in _rounds(na * nb, 1 << 21):
                size = (na * nb)[lo:hi]
                nth = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
                wide = np.repeat(nb[lo:hi], size)
                a = np.repeat(a0[lo:hi], size) + nth // wide
                b = np.repeat(b0[lo:hi], size) + nth % wide
                ok = a < b if side is None else (a < b) & (side[a] != side[b])
                a, b = a[ok], b[ok]
                seen_pairs += len(a)
                near = np.bitwise_count(fp[a] ^ fp[b]) <= errors
                if near.any():
                    forest.join(a[near], b[near])
            alo, ahi, blo, bhi, acc = (x[~done] for x in (alo, ahi, blo, bhi, acc))
        if not len(alo):
            continue
        am, bm = halves(depth, alo, ahi), halves(depth, blo, bhi)
        own = alo == blo
        other = acc < allowed[depth]
        same = ((alo, am, blo, bm, acc, None), (am, ahi, bm, bhi, acc, None))
        cross = ((alo, am, bm, bhi, acc + 1, other), (am, ahi, blo, bm, acc + 1, other & ~own))
        for nodes in (cross, same):      # equal bits lie on top: close pairs are joined first
            parts = []
            for a0, a1, b0, b1, e, ok in nodes:
                full = (a1 > a0) & (b1 > b0)
                full = full if ok is None else full & ok
                parts.append([x[full] for x in (a0, a1, b0, b1, e)])
            new = [np.concatenate(x) for x in zip(*parts)]
            if len(new[0]):
                stack.append((depth + 1, *new))
    return forest.label, seen_nodes, seen_pairs


def _rounds(size: np.ndarray, limit: int):
    """Ranges whose sizes add up to about `limit`."""
    total, at = np.cumsum(size), 0
    while at < len(size):
        base = total[at - 1] if at else 0
        upto = max(at + 1, int(np.searchsorted(total, base + limit, "right")))
        yield at, upto
        at = upto


def _edges(table: pa.Table, errors: int) -> pa.Table:
    """Spanning edges (a, b) between the representatives of a bucket's fingerprints.

    A unit is a subtree, or (`pair`) two parts of a split one.
    """
    unit = table.column("unit").to_numpy()
    rep = table.column("rep").to_numpy()
    block = table.column("block").to_numpy()
    fp = table.column("fp").to_numpy().view(np.uint64)
    half = table.column("half").to_numpy()
    split = table.column("pair").to_numpy()
    starts = np.array(cuts(errors))
    out = []
    for b in range(errors + 1):
        for two in (False, True):
            own = (block == b) & (split == two)
            if not own.any():
                continue
            x = turned(fp[own], np.full(own.sum(), starts[b]))
            order = np.lexsort((x, unit[own]))
            x, u, r = x[order], unit[own][order], rep[own][order]
            label, _, _ = joined(u, x, half[own][order] if two else None, b, errors)
            to = np.flatnonzero(label != np.arange(len(label)))
            out.append((r[to], r[label[to]]))
    none = (np.empty(0, np.int64),) * 2
    a, b = (np.concatenate(x) for x in zip(none, *out))
    return pa.table({"a": pa.array(a), "b": pa.array(b)})


def near_links(classes: DataFrame, n: int, errors: int, per_bucket: int, hot: int) -> DataFrame:
    """Spanning edges that join all of the `n` classes (fp, rep) within `errors`, as pairs of reps.

    A subtree of more than `hot` entries is dealt into parts by hash, and every two parts
    meet in a task of their own: no task holds more than about 2 * hot entries.
    """
    edges = cuts(errors)
    unit = F.array(*[F.struct(
        F.lit(i).alias("block"),
        F.shiftrightunsigned(F.shiftleft("fp", lo), BITS - (hi - lo)).alias("top"))
        for i, (lo, hi) in enumerate(zip(edges[:-1], edges[1:]))])
    rows = classes.select("fp", "rep", F.explode(unit).alias("u")).select("fp", "rep", "u.*")
    sizes = rows.groupBy("block", "top").agg(F.count(F.lit(1)).alias("m")).filter(F.col("m") > hot)
    parts = sizes.select("block", "top", F.ceil(F.col("m") / hot).cast("int").alias("parts"))
    rows = rows.join(parts, ["block", "top"], "left")
    mine = F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int")
    # part i meets part j in unit (min, max); the two stand on different halves
    meets = F.when(F.col("parts").isNull(), F.array(F.struct(
        F.lit(0).alias("lo"), F.lit(0).alias("hi"), F.lit(0).alias("half")))).otherwise(
        F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda j: F.struct(
            F.least(j, mine).alias("lo"), F.greatest(j, mine).alias("hi"),
            (mine > j).cast("int").alias("half"))))
    rows = rows.withColumn("meet", F.explode(meets))
    rows = rows.select(
        F.xxhash64("block", "top", "meet.lo", "meet.hi").alias("unit"), "block", "fp", "rep",
        F.col("meet.half").alias("half"), (F.col("meet.lo") != F.col("meet.hi")).alias("pair"))
    buckets = max(1, -(-n * (errors + 1) // per_bucket))
    return rows.groupBy(F.pmod("unit", F.lit(buckets)).alias("bucket")).applyInArrow(
        lambda t: _edges(t, errors), "a bigint, b bigint")


def near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 4,
                errors: int = 4, per_bucket: int = 200_000, hot: int = 400_000) -> DataFrame:
    """One row per row of `docs`: doc_id, fingerprint (16 hex digits), component_id.

    Linked are fingerprints that differ in at most `errors` bits; component_id is the
    smallest id reachable.  Texts without words (null, empty) have fingerprint 0 and are
    linked like any other.  Texts are hashed whole.  Rows repeating an id are linked each
    by its own text: the id's rows may have different components.  A row with a null id
    has a fingerprint, takes no part in linking and has a null component.  Other columns
    are ignored; an empty table gives no rows.
    """
    signed, total = stored_and_counted(fingerprints(docs, id_col, text_col, words), "sim-prints")
    classes, n = stored_and_counted(
        signed.filter("id is not null").groupBy("fp").agg(
            F.min("id").alias("rep"), F.count(F.lit(1)).alias("m")), "sim-classes")
    links = stored(near_links(classes.select("fp", "rep"), n, errors, per_bucket, hot), "sim-links")
    label = components(links, "sim-components").withColumnRenamed("id", "rep")
    named = stored(classes.join(label, "rep", "left").select(
        "fp", "m", F.coalesce("component", "rep").alias("component_id")), "sim-named")
    # a fingerprint of over a thousandth of all rows (fewer than a thousand such) is looked
    # up in place; all others are joined by the fingerprint
    often = F.col("m") * 1000 > total
    common = F.broadcast(named.filter(often).select(
        F.col("fp").alias("_fp"), F.col("component_id").alias("_c")))
    ids, none = signed.filter("id is not null"), signed.filter("id is null")
    rows = ids.join(common, F.col("fp") == F.col("_fp"), "left")
    hot_rows = rows.filter("_fp is not null").select("id", "fp", F.col("_c").alias("component_id"))
    rest = rows.filter("_fp is null").select("id", "fp").join(
        named.filter(~often).select("fp", "component_id"), "fp").select("id", "fp", "component_id")
    none = none.select("id", "fp", F.lit(None).cast("bigint").alias("component_id"))
    return hot_rows.union(rest).union(none).select(
        F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        "component_id")
