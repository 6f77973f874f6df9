"""Substring dedup with fixed-block anchors.

A repeat of at least `window` words holds a whole reference block of `block` words when
2 * block - 1 <= window.  So:

1. Every document's non-overlapping blocks are the index; every rolling window of
   `block` words of every document probes it.  Hashes are dealt to buckets, packed: a
   probe costs about 6 to 8 bytes.  The number of buckets follows the input.
2. A hit, an anchor, is extended to all windows of `window` words that hold it.  Only
   documents with anchors go on.
3. Candidate windows are compared exactly by a 96-bit hash of all their words; the
   smallest document of each decides.  Adjacent covered windows merge to maximal exact
   repeats, whose words are removed.

Nothing is paired: a passage in m documents costs about m entries, never m * m.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from daywatch.llm.common import (blocks_of, mix, span_hashes, stored, text_bytes, text_of,
                                 window_hashes, word_spans)

PACKED = 1_500_000        # entries that a task gathers before it hands them out by bucket


def _words(data, offsets):
    start, end, row = word_spans(data, offsets)
    first = np.concatenate(([0], np.cumsum(np.bincount(row, minlength=len(offsets) - 1))))
    return span_hashes(data, start, end), row, first


def _narrow(x: np.ndarray) -> bytes:
    """Little numbers in two bytes; `_wide` tells by the length."""
    return x.astype(np.uint16 if not len(x) or x.max() < 65536 else np.uint32).tobytes()


def _wide(raw: bytes, n: int) -> np.ndarray:
    return np.frombuffer(raw, np.uint32 if n and len(raw) == 4 * n else np.uint16).astype(np.int64)


def _probes(batches, block, buckets):
    """Rows (bucket, ids, counts, hashes, places): packed probes, block starts flagged."""
    held, size = [], 0

    def flush():
        h, ident, place = (np.concatenate([x[i] for x in held]) for i in range(3))
        bucket = ((h >> np.uint64(40)) % np.uint64(buckets)).astype(
            np.uint16 if buckets < 65536 else np.uint32)
        order = np.argsort(bucket, kind="stable")
        bucket, h, ident, place = bucket[order], h[order], ident[order], place[order]
        low = (h & np.uint64(0xFFFFFFFE)).astype(np.uint32) | (place % block == 0)
        at = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1])))
        out = []
        for lo, hi in zip(at, np.append(at[1:], len(h))):
            own = ident[lo:hi]
            new = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1])))
            out.append((int(bucket[lo]), own[new].tobytes(),
                        _narrow(np.diff(np.append(new, hi - lo))),
                        low[lo:hi].tobytes(), _narrow(place[lo:hi])))
        return _rows(out, ("bucket", "ids", "counts", "hashes", "places"))

    for b in batches:
        data, offsets = text_bytes(b.column(1))
        ids = b.column(0).to_numpy(zero_copy_only=False)
        for lo, hi in blocks_of(offsets, 1 << 21):
            own = offsets[lo:hi + 1]
            h, row, first = _words(data[own[0]:own[-1]], own - own[0])
            w = window_hashes(h, block)
            ok = np.flatnonzero(row[:len(w)] == row[block - 1:]) if len(w) else np.empty(0, np.int64)
            if len(ok):
                held.append((w[ok], ids[lo:hi][row[ok]], ok - first[row[ok]]))
                size += len(ok)
            if size >= PACKED:
                yield flush()
                held, size = [], 0
    if size:
        yield flush()


def _rows(rows, names):
    cols = list(zip(*rows))
    return pa.RecordBatch.from_arrays(
        [pa.array(cols[0], pa.int64())] + [pa.array(c, pa.binary()) for c in cols[1:]], list(names))


def _anchors(table: pa.Table, groups: int) -> pa.Table:
    """Places of the windows whose hash a block of one document and another share."""
    ids, counts, low, places = [], [], [], []
    for i, c, h, p in zip(*[table.column(x).to_pylist() for x in ("ids", "counts", "hashes", "places")]):
        i, h = np.frombuffer(i, np.int64), np.frombuffer(h, np.uint32)
        ids.append(np.repeat(i, _wide(c, len(i))))
        low.append(h)
        places.append(_wide(p, len(h)).astype(np.uint32))
    ids, low, places = np.concatenate(ids), np.concatenate(low), np.concatenate(places)
    order = np.argsort(low >> 1, kind="stable")
    key = (low >> 1)[order]
    new = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    run = np.diff(np.append(new, len(key)))
    own = ids[order]
    hit = ((np.minimum.reduceat(own, new) != np.maximum.reduceat(own, new))
           & (np.maximum.reduceat(low[order] & 1, new) == 1))
    chosen = order[np.repeat(hit, run)]
    return _packed(ids[chosen], places[chosen], groups)


def _runs(x: np.ndarray):
    """Start and end of each run of equal values."""
    if not len(x):
        return []
    new = np.flatnonzero(np.concatenate(([True], x[1:] != x[:-1])))
    return list(zip(new, np.append(new[1:], len(x))))


PACKED_SCHEMA = "bucket bigint, owners binary, places binary"


def _packed(owner, places, groups: int) -> pa.Table:
    """Places by groups of owners, a row per group: what buckets found meets again by owner."""
    group = (mix(owner.astype(np.uint64)) % np.uint64(groups)).astype(np.int64)
    order = np.argsort(group, kind="stable")
    group, owner, places = group[order], owner[order], places[order].astype(np.uint32)
    runs = _runs(group)
    return pa.table({
        "bucket": pa.array([int(group[lo]) for lo, _ in runs], pa.int64()),
        "owners": pa.array([owner[lo:hi].tobytes() for lo, hi in runs], pa.binary()),
        "places": pa.array([places[lo:hi].tobytes() for lo, hi in runs], pa.binary())})


def _by_owner(table: pa.Table) -> pa.Table:
    """One row per owner: all its places, sorted."""
    owner = np.concatenate([np.frombuffer(x, np.int64) for x in table.column("owners").to_pylist()])
    places = np.concatenate([np.frombuffer(x, np.uint32) for x in table.column("places").to_pylist()])
    order = np.lexsort((places, owner))
    owner, places = owner[order], places[order]
    runs = _runs(owner)
    return pa.table({
        "owner": pa.array([int(owner[lo]) for lo, _ in runs], pa.int64()),
        "hits": pa.array([places[lo:hi].tobytes() for lo, hi in runs], pa.binary())})


def _spread(starts: np.ndarray, before: int, after: int, n: int) -> np.ndarray:
    """Which of 0..n-1 lie in [s - before, s + after] for some s in starts."""
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, np.maximum(starts - before, 0), 1)
    np.add.at(edge, np.minimum(starts + after + 1, n), -1)
    return np.cumsum(edge[:n]) > 0


def _finish(words: list[bytes], removed: np.ndarray | None, digest: bool):
    """n_removed, and the kept words joined by one blank (or their SHA-256)."""
    if removed is not None:
        words = [w for w, r in zip(words, removed.tolist()) if not r]
    kept = b" ".join(words)
    return (0 if removed is None else int(removed.sum()),
            hashlib.sha256(kept).hexdigest() if digest else kept.decode("utf-8", "surrogatepass"))


OPEN = ("id bigint, n_words bigint, n_removed bigint, kept string, text string, starts binary, "
        "h1 binary, h2 binary")


def _extend(batches, block, window, digest):
    """Documents without anchors are finished; of others the candidate windows are hashed.

    bytes.split() cuts at exactly the blanks and control characters that end a word.
    """
    for b in batches:
        for at in range(0, b.num_rows, 256):
            part = b.slice(at, 256)
            rows = []
            for ident, text, hits in zip(*[part.column(c).to_pylist() for c in range(3)]):
                raw = text.encode("utf-8", "surrogatepass")
                words = raw.split()
                if not hits or len(words) < window:
                    rows.append((ident, len(words), *_finish(words, None, digest), None, None, None, None))
                    continue
                data = np.frombuffer(raw, np.uint8)
                h, _, _ = _words(data, np.array([0, len(raw)]))
                n = len(h) - window + 1
                places = np.frombuffer(hits, np.uint32).astype(np.int64)
                places = places[places <= len(h) - block]
                edge = np.zeros(len(h) + 1, np.int64)
                np.add.at(edge, np.maximum(places - (window - block), 0), 1)
                np.add.at(edge, places + 1, -1)
                starts = np.flatnonzero(np.cumsum(edge)[:n] > 0)
                h1 = window_hashes(h, window, 5)[starts]
                h2 = (window_hashes(h, window, 6)[starts] >> np.uint64(32)).astype(np.uint32)
                rows.append((ident, len(words), None, None, text, starts.astype(np.uint32).tobytes(),
                             h1.tobytes(), h2.tobytes()))
            cols = list(zip(*rows))
            kinds = [pa.int64()] * 3 + [pa.string()] * 2 + [pa.binary()] * 3
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(cols, kinds)],
                ["id", "n_words", "n_removed", "kept", "text", "starts", "h1", "h2"])


def _deal(batches, buckets):
    """Candidate windows by bucket of their hash: (bucket, rid, id, starts, h1, h2), packed."""
    held, size = [], 0

    def flush():
        h1, h2, rid, ident, start = (np.concatenate([x[i] for x in held]) for i in range(5))
        bucket = ((h1 >> np.uint64(40)) % np.uint64(buckets)).astype(np.uint32)
        order = np.argsort(bucket, kind="stable")
        bucket = bucket[order]
        at = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1])))
        out = []
        for lo, hi in zip(at, np.append(at[1:], len(order))):
            o = order[lo:hi]
            out.append((int(bucket[lo]), rid[o].tobytes(), ident[o].tobytes(), start[o].tobytes(),
                        h1[o].tobytes(), h2[o].tobytes()))
        return _rows(out, ("bucket", "rid", "id", "starts", "h1", "h2"))

    for b in batches:
        for rid, ident, s, h1, h2 in zip(*[b.column(i).to_pylist() for i in range(5)]):
            s = np.frombuffer(s, np.uint32)
            held.append((np.frombuffer(h1, np.uint64), np.frombuffer(h2, np.uint32),
                         np.full(len(s), rid, np.int64), np.full(len(s), ident, np.int64), s))
            size += len(s)
            if size >= PACKED // 2:
                yield flush()
                held, size = [], 0
    if size:
        yield flush()


def _covered(table: pa.Table, groups: int) -> pa.Table:
    """The windows that also start in a document with a smaller id."""
    kinds = (("rid", np.int64), ("id", np.int64), ("starts", np.uint32), ("h1", np.uint64),
             ("h2", np.uint32))
    rid, ident, start, h1, h2 = (np.concatenate([np.frombuffer(x, k) for x in table.column(c).to_pylist()])
                                 for c, k in kinds)
    order = np.lexsort((h2, h1))
    a, c, own = h1[order], h2[order], ident[order]
    new = np.flatnonzero(np.concatenate(([True], (a[1:] != a[:-1]) | (c[1:] != c[:-1]))))
    least = np.repeat(np.minimum.reduceat(own, new), np.diff(np.append(new, len(a))))
    gone = order[own > least]
    return _packed(rid[gone], start[gone], groups)


def _cut(batches, window, digest):
    for b in batches:
        rows = []
        for ident, text, hits in zip(*[b.column(c).to_pylist() for c in range(3)]):
            words = text.encode("utf-8", "surrogatepass").split()
            removed = None
            if hits:
                starts = np.frombuffer(hits, np.uint32).astype(np.int64)
                removed = _spread(starts, 0, window - 1, len(words))
            rows.append((ident, len(words), *_finish(words, removed, digest)))
        if rows:
            cols = list(zip(*rows))
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(cols, [pa.int64()] * 3 + [pa.string()])],
                ["doc_id", "n_words", "n_removed", "kept"])


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                   window: int = 50, digest: bool = False) -> DataFrame:
    """One row per row of `docs`: doc_id, n_words, n_removed, kept.

    Removed is each word covered by a window of `window` consecutive words that also
    starts in a document with a smaller id; windows are judged on the input.  `kept` is
    the rest, joined by one blank (its SHA-256 with `digest`).  Null texts have no
    words.  Rows that repeat an id are one document, so neither covers the other; a row
    with a null id loses nothing and covers nothing.  Other columns are ignored.
    """
    block = (window + 1) // 2
    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), text_of(text_col).alias("text"))
    chars = rows.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    buckets = int(chars // 10_000_000) + 1           # about 2 million probes each
    probes = rows.filter("id is not null").mapInArrow(
        lambda it: _probes(it, block, buckets),
        "bucket bigint, ids binary, counts binary, hashes binary, places binary")
    anchors = probes.groupBy("bucket").applyInArrow(lambda t: _anchors(t, buckets), PACKED_SCHEMA)
    anchors = stored(anchors.groupBy("bucket").applyInArrow(_by_owner, "owner bigint, hits binary"),
                     "repeat-anchors")
    opened = rows.join(anchors, F.col("id") == F.col("owner"), "left").select("id", "text", "hits").mapInArrow(
        lambda it: _extend(it, block, window, digest), OPEN)
    opened = stored(opened.withColumn("rid", F.monotonically_increasing_id()), "repeat-windows")
    todo = opened.filter("text is not null")
    count = todo.agg(F.coalesce(F.sum(F.length("h1")), F.lit(0))).first()[0] // 8
    parts = int(count // 500_000) + 1
    covered = (todo.select("rid", "id", "starts", "h1", "h2")
               .mapInArrow(lambda it: _deal(it, parts), "bucket bigint, rid binary, id binary, "
                           "starts binary, h1 binary, h2 binary")
               .groupBy("bucket").applyInArrow(lambda t: _covered(t, parts), PACKED_SCHEMA)
               .groupBy("bucket").applyInArrow(_by_owner, "owner bigint, hits binary"))
    cut = todo.join(covered, F.col("rid") == F.col("owner"), "left").select("id", "text", "hits").mapInArrow(
        lambda it: _cut(it, window, digest),
        "doc_id bigint, n_words bigint, n_removed bigint, kept string")
    done = opened.filter("text is null").select(F.col("id").alias("doc_id"), "n_words",
                                                "n_removed", "kept")
    return done.unionByName(cut)
