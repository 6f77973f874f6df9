"""Near duplicates: a multi-index Hamming join over b-bit MinHash signatures.

A document's set is its distinct word shingles.  Its signature has `chunks` x `width`
symbols of 8 bits, one MinHash value each, packed into 64-bit columns.  Two signatures
that differ in at most 2 * chunks - 1 symbols have, by the pigeonhole principle, a chunk
with at most one different symbol; so each chunk is indexed once per symbol left out
(`width` keys), and all pairs within that distance meet under a key.  With the defaults,
80 symbols and a distance of 31, a pair of similarity 0.8 lies beyond with a chance of
2e-5 (binomial, 80 draws at 0.2); higher similarities practically never.

Equal sets form one class, whose smallest document stands for it, so copies are never
paired.  Then no step makes a row per pair:

1. Keys are packed and dealt to buckets; only those that two documents share go on.  A task
   sends each of its keys once, so a key's entries follow the tasks, not its documents.
2. Under a key, signatures are compared in memory, and only edges that join something
   leave.  Their components are families: every pair within the distance is in one.
3. A family's texts meet once and are compared exactly by posting lists, asking only
   documents outside the largest component so far.  Again only joining links leave.  A
   family beyond `room` shingles is dealt into parts, then one document per part and
   component is compared, then only what is still outside the family's main component
   meets all parts.

So near copies cost about their number.  A family whose members all stay below the
threshold is compared pair by pair, inside a task; its rows still grow in proportion until
it needs several parts.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from daywatch.llm.common import (Forest, Sieve, blocks_of, mix, packed, span_hashes, stored,
                                 stored_and_counted, text_bytes, text_of, unpacked, window_hashes,
                                 word_spans, with_group)

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def shingle_rows(data: np.ndarray, offsets: np.ndarray, words: int):
    """Distinct 64-bit shingle hashes by row: (hashes, first place of each row).

    A row with fewer words has its whole sequence as one shingle; one without words
    has none.
    """
    n = len(offsets) - 1
    data = LOWER[data]
    start, end, row = word_spans(data, offsets)
    h = span_hashes(data, start, end)
    count = np.bincount(row, minlength=n)
    first = np.concatenate(([0], np.cumsum(count)))
    if not len(h):
        return np.empty(0, np.uint64), np.zeros(n + 1, np.int64)
    grams, gram_row = np.empty(0, np.uint64), np.empty(0, np.int64)
    if len(h) >= words:
        ok = row[words - 1:] == row[:len(row) - words + 1]
        grams, gram_row = window_hashes(h, words)[ok], row[:len(row) - words + 1][ok]
    few = np.flatnonzero((count > 0) & (count < words))
    if len(few):
        whole = [_sequence(h[first[r]:first[r + 1]]) for r in few]
        grams = np.concatenate((grams, np.array(whole, np.uint64)))
        gram_row = np.concatenate((gram_row, few))
    order = np.lexsort((grams, gram_row))
    grams, gram_row = grams[order], gram_row[order]
    new = np.ones(len(grams), bool)
    new[1:] = (grams[1:] != grams[:-1]) | (gram_row[1:] != gram_row[:-1])
    grams, gram_row = grams[new], gram_row[new]
    return grams, np.concatenate(([0], np.cumsum(np.bincount(gram_row, minlength=n))))


def _sequence(h: np.ndarray) -> int:
    return int(window_hashes(h, len(h), salt=len(h))[0])


def signatures(grams: np.ndarray, first: np.ndarray, symbols: int, step: int = 200_000):
    """MinHash symbols of 8 bits, one row per non-empty set; and which rows those are."""
    filled = np.flatnonzero(np.diff(first) > 0)
    out = np.empty((len(filled), symbols), np.uint8)
    at = 0
    while at < len(filled):
        last = max(at + 1, int(np.searchsorted(first[filled], first[filled[at]] + step)))
        last = min(last, len(filled))
        lo, hi = first[filled[at]], first[filled[last - 1] + 1]
        part, cuts = grams[lo:hi], first[filled[at:last]] - lo
        for k in range(symbols):
            low = np.minimum.reduceat(mix(part, 1000 + k), cuts)
            out[at:last, k] = (low & np.uint64(0xFF)).astype(np.uint8)
        at = last
    return filled, out


def _sign(batches, words, symbols):
    for b in batches:
        data, offsets = text_bytes(b.column(1))
        for lo, hi in blocks_of(offsets, 1 << 21):
            own = offsets[lo:hi + 1]
            grams, first = shingle_rows(data[own[0]:own[-1]], own - own[0], words)
            size = np.diff(first)
            rows, sig = signatures(grams, first, symbols)
            # the class of a set: two independent sums over its shingles
            a, c = np.zeros(hi - lo, np.uint64), np.zeros(hi - lo, np.uint64)
            with np.errstate(over="ignore"):
                if len(rows):
                    a[rows] = np.add.reduceat(mix(grams, 1), first[rows])
                    c[rows] = np.add.reduceat(mix(grams, 2), first[rows])
            packed = np.zeros((hi - lo, symbols // 8), np.int64)
            packed[rows] = sig.view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [b.column(0).slice(lo, hi - lo), pa.array(size, pa.int64()),
                 pa.array(a.view(np.int64)), pa.array(c.view(np.int64)),
                 *[pa.array(packed[:, i].copy()) for i in range(symbols // 8)]],
                ["id", "n", "c1", "c2", *_columns(symbols)])


def _columns(symbols: int) -> list[str]:
    return [f"s{i}" for i in range(symbols // 8)]


def _keys(batches, chunks, width):
    """(key, id) for every chunk and symbol left out."""
    for b in batches:
        for at in range(0, b.num_rows, 2000):
            part = b.slice(at, 2000)
            sig = np.column_stack([part.column(i).to_numpy() for i in range(1, part.num_columns)])
            sig = np.ascontiguousarray(sig).view(np.uint8)
            sig = sig.reshape(part.num_rows, chunks, width).astype(np.uint64)
            out = []
            for c in range(chunks):
                for left in range(width):
                    h = np.full(part.num_rows, c * width + left, np.uint64)
                    for s in range(width):
                        if s != left:
                            h = mix(h ^ sig[:, c, s], s + 1)
                    out.append(h)
            keys = np.concatenate(out)
            ids = pa.concat_arrays([part.column(0)] * len(out))
            yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), ids], ["key", "id"])


ENTRY = np.dtype([("key", np.int64), ("rep", np.int64), ("shared", np.bool_)])


def _runs_of(key: np.ndarray):
    """Start and length of each run of a sorted array."""
    at = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else np.empty(0, int)
    return at, np.diff(np.append(at, len(key)))


def _entries(batches, chunks, width, buckets):
    """Rows (bucket, entries): packed keys by bucket.

    Of the documents of a batch that share a key, one stands for all in the key's bucket.
    They are known to share it, so the others are only passed on, under any bucket.
    """
    for b in _keys(batches, chunks, width):
        key, rep = (b.column(i).to_numpy() for i in (0, 1))
        order = np.lexsort((rep, key))
        new = np.empty(len(order), ENTRY)
        new["key"], new["rep"] = key[order], rep[order]
        at, size = _runs_of(new["key"])
        new["shared"] = np.repeat(size > 1, size)
        first = np.zeros(len(new), bool)
        first[at] = True
        bucket = np.where(first, (mix(new["key"].view(np.uint64), 3) % np.uint64(buckets)),
                          mix(new["rep"].view(np.uint64), 4) % np.uint64(buckets)).astype(np.int64)
        # the sign tells entries that are only passed on
        bucket = np.where(first, bucket, -1 - bucket)
        order = np.argsort(bucket, kind="stable")
        new, bucket = new[order], bucket[order]
        at, size = _runs_of(bucket)
        yield pa.RecordBatch.from_arrays(
            [pa.array(bucket[at]), pa.array([new[i:i + n].tobytes() for i, n in zip(at, size)],
                                            pa.binary())], ["bucket", "entries"])


def _shared(table: pa.Table) -> pa.Table:
    """(key, rep) of the keys in a bucket that two documents share."""
    new = np.frombuffer(b"".join(table.column("entries").to_pylist()), ENTRY)
    if table.column("bucket")[0].as_py() >= 0:
        new = new[np.lexsort((new["rep"], new["key"]))]
        at, size = _runs_of(new["key"])
        many = (size > 1) | np.logical_or.reduceat(new["shared"], at)
        new = new[np.repeat(many, size)]
    return pa.table({"key": pa.array(new["key"].copy()), "rep": pa.array(new["rep"].copy())})


def _nibbles(sig: np.ndarray) -> np.ndarray:
    """The lower halves of 8-bit symbols, 16 in a 64-bit word."""
    low = sig & 15
    return np.ascontiguousarray(low[:, ::2] | (low[:, 1::2] << 4)).view(np.uint64)


def _apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """In how many 4-bit symbols the rows differ: at most the distance of the whole symbols."""
    x = a ^ b
    x |= x >> np.uint64(2)
    x |= x >> np.uint64(1)
    return np.bitwise_count(x & np.uint64(0x1111111111111111)).sum(axis=1)


def _largest(run: np.ndarray, label: np.ndarray) -> np.ndarray:
    """Per entry, the commonest label of its run (runs numbered from 0, in order)."""
    order = np.lexsort((label, run))
    r, x = run[order], label[order]
    at = np.flatnonzero(np.concatenate(([True], (r[1:] != r[:-1]) | (x[1:] != x[:-1]))))
    count = np.diff(np.append(at, len(r)))
    best = np.lexsort((count, r[at]))
    last = np.flatnonzero(np.append(r[at][best][1:] != r[at][best][:-1], True))
    return x[at][best][last][run]


def _family_edges(table: pa.Table, symbols: int, most: int, percent: int) -> pa.Table:
    """Edges (a, b) that join the documents of a bucket near each other under some key.

    All keys of the bucket go in step: in each round a document of every key that does not
    hang together yet asks all others of its key.
    """
    key, rep, n = (table.column(c).to_numpy() for c in ("key", "rep", "n"))
    order = np.lexsort((rep, key))
    key, rep, n = key[order], rep[order], n[order]
    sig = np.column_stack([table.column(c).to_numpy() for c in _columns(symbols)])[order]
    sig = np.ascontiguousarray(sig).view(np.uint8)
    pad = -symbols % 16
    if pad:
        sig = np.pad(sig, ((0, 0), (0, pad)))
    sig = _nibbles(sig)
    reps, own = np.unique(rep, return_inverse=True)
    forest = Forest(len(reps))
    asked = np.zeros(len(key), bool)
    live = np.arange(len(key))
    while len(live):
        at, size = _runs_of(key[live])
        run = np.repeat(np.arange(len(at)), size)
        label = forest.label[own[live]]
        # a key is done when all that is outside its largest component has asked
        spot = np.where(asked[live] | (label == _largest(run, label)), len(live), np.arange(len(live)))
        ask = np.minimum.reduceat(spot, at)
        go = ask < len(live)
        if not go.any():
            break
        keep = go[run]
        who = live[ask[run[keep]]]
        live, label = live[keep], label[keep]
        asked[who] = True
        a, b = np.minimum(n[live], n[who]), np.maximum(n[live], n[who])
        maybe = np.flatnonzero((forest.label[own[who]] != label) & (a * 100 >= b * percent))
        maybe = maybe[_apart(sig[live[maybe]], sig[who[maybe]]) <= most]
        if len(maybe):
            forest.join(own[who[maybe]], own[live[maybe]])
    to = np.flatnonzero(forest.label != np.arange(len(reps)))
    return pa.table({"a": pa.array(reps[forest.label[to]]), "b": pa.array(reps[to])})


def linked(grams: np.ndarray, first: np.ndarray, percent: int, label: np.ndarray,
           ask: np.ndarray) -> list[tuple[int, int]]:
    """Joining links (row, row) between sets whose similarity reaches `percent`.

    Rows of one `label` hang together already.  Only rows with `ask` are compared with all
    others, and only while they are outside the largest component.  A row is compared by
    the posting lists of its shingles, in one pass over them.
    """
    k, size = len(first) - 1, np.diff(first)
    row = np.repeat(np.arange(k), size)
    _, term, uses = np.unique(grams, return_inverse=True, return_counts=True)
    order = np.argsort(term, kind="stable")
    posting, lead = row[order], np.concatenate(([0], np.cumsum(uses)))
    label, left, out = label.copy(), ask & (size > 0), []
    while True:
        main = np.bincount(label).argmax()
        todo = np.flatnonzero(left & (label != main))
        if not len(todo):
            return out
        q = int(todo[0])
        left[q] = False
        t = term[first[q]:first[q + 1]]
        width = uses[t]
        hits = posting[np.repeat(lead[t] - np.cumsum(width) + width, width) + np.arange(width.sum())]
        common = np.bincount(hits, minlength=k)
        near = np.flatnonzero((common * 100 >= percent * (size[q] + size - common)) & (label != label[q]))
        if len(near):
            old, at = np.unique(label[near], return_index=True)
            out += [(q, int(near[i])) for i in at]
            label[np.isin(label, old)] = label[q]


def _exact(table: pa.Table, words: int, percent: int) -> pa.Table:
    """Joining links (a, b) of each unit of a bucket, confirmed on full sets."""
    unit, rep, comp = (table.column(c).to_numpy() for c in ("unit", "rep", "comp"))
    ask = table.column("ask").to_numpy(zero_copy_only=False)
    order = np.lexsort((rep, unit))
    texts = table.column("text").take(pa.array(order))
    unit, rep, comp, ask = unit[order], rep[order], comp[order], ask[order]
    data, offsets = text_bytes(texts)
    parts = [shingle_rows(data[offsets[lo]:offsets[hi]], offsets[lo:hi + 1] - offsets[lo], words)
             for lo, hi in blocks_of(offsets, 1 << 21)]
    grams = np.concatenate([g for g, _ in parts])
    size = np.concatenate([np.diff(f) for _, f in parts])
    first = np.concatenate(([0], np.cumsum(size)))
    out = []
    for at, n in zip(*_runs_of(unit)):
        _, label = np.unique(comp[at:at + n], return_inverse=True)
        found = linked(grams[first[at]:first[at + n]], first[at:at + n + 1] - first[at], percent,
                       label, ask[at:at + n])
        out += [(rep[at + a], rep[at + b]) for a, b in found]
    a, b = np.array(out, np.int64).reshape(-1, 2).T
    return pa.table({"a": pa.array(a.copy()), "b": pa.array(b.copy())})


def components(links: DataFrame, name: str = "components") -> DataFrame:
    """(id, component): the smallest id reachable, for every id in links (a, b).

    Labels spread along links to the smallest neighbour, and each label then jumps to
    the label of its label, so the rounds grow with the logarithm of a path's length.
    Every round is written to the shared folder.
    """
    both = stored(links.select(F.col("a").alias("x"), F.col("b").alias("y"))
                  .union(links.select("b", "a")).distinct(), name)
    label = (both.groupBy("x").agg(F.min("y").alias("m"))
             .select(F.col("x").alias("id"), F.least("x", "m").alias("component")))
    label = stored(label, name)
    while True:
        near = (both.join(label.select(F.col("id").alias("y"), F.col("component").alias("c")), "y")
                .groupBy("x").agg(F.min("c").alias("c")))
        new = label.join(near, F.col("id") == F.col("x")).select(
            "id", F.col("component").alias("old"), F.least("component", "c").alias("l"))
        jump = label.select(F.col("id").alias("l"), F.col("component").alias("l2"))
        new = new.join(jump, "l").select("id", "old", F.least("l", "l2").alias("component"))
        new, changed = stored_and_counted(new, name, F.col("old") != F.col("component"))
        label = new.select("id", "component")
        if not changed:
            return label


def families(classes: DataFrame, n: int, chunks: int, width: int, percent: int,
             per_bucket: int = 100_000, hot: int = 100_000) -> DataFrame:
    """(rep, family) of the classes that may have a link: families hold all pairs within
    the signature distance.

    A key with more than `hot` documents joins them unseen: its documents are one family,
    which the exact comparison takes apart.
    """
    symbols = chunks * width
    names = _columns(symbols)
    buckets = max(1, -(-n * symbols // per_bucket))
    shared, rows = stored_and_counted(
        classes.select("rep", *names).mapInArrow(
            lambda it: _entries(it, chunks, width, buckets), "bucket bigint, entries binary")
        .groupBy("bucket").applyInArrow(_shared, "key bigint, rep bigint"), "near-shared")
    often = (shared.groupBy("key").agg(F.count(F.lit(1)).alias("m"), F.min("rep").alias("anchor"))
             .filter(F.col("m") > hot).select("key", "anchor"))
    rows = max(1, -(-rows // per_bucket))
    tagged = shared.join(often, "key", "left")
    meet = (tagged.filter("anchor is null").select("key", "rep")
            .join(classes.select("rep", "n", *names), "rep"))
    near = meet.groupBy(F.pmod(F.xxhash64("key"), F.lit(rows)).alias("bucket")).applyInArrow(
        lambda t: _family_edges(t, symbols, 2 * chunks - 1, percent), "a bigint, b bigint")
    star = tagged.filter("anchor < rep").select(F.col("anchor").alias("a"), F.col("rep").alias("b"))
    edges = stored(near.union(star), "near-edges")
    return components(edges, "near-families").select(F.col("id").alias("rep"),
                                                     F.col("component").alias("family"))


def _compared(rows: DataFrame, texts: DataFrame, words: int, percent: int, room: int) -> DataFrame:
    """Joining links of rows (unit, rep, n, comp, ask): each unit in one task, stored.

    Texts that cannot be wanted are left out before the shuffle.  The list of rows follows
    the input, so it is merged with the texts at every size.
    """
    weight = rows.agg(F.sum(F.col("n") + 16)).first()[0] or 0
    buckets = max(1, -(-2 * weight // room))
    wanted = Sieve(rows.select("rep").distinct(), F.xxhash64("rep"), "near-sieve").flagged(
        texts.select(F.col("id").alias("rep"), "text"), F.xxhash64("rep")).filter("_maybe")
    met = rows.select("unit", "rep", "comp", "ask").hint("merge").join(
        wanted.select("rep", "text"), "rep")
    return stored(met.groupBy(F.pmod("unit", F.lit(buckets)).alias("bucket")).applyInArrow(
        lambda t: _exact(t, words, percent), "a bigint, b bigint"), "near-links")


def _parts(df: DataFrame, by: list[str], name: str, room: int) -> DataFrame:
    """Adds `name`: in how many parts of at most about `room` shingles each group is dealt."""
    few = df.groupBy(*by).agg(F.ceil(F.sum(F.col("n") + 16) / room).cast("int").alias(name))
    return df.join(few, by)


def exact_links(members: DataFrame, texts: DataFrame, words: int, percent: int,
                room: int = 1_000_000) -> DataFrame:
    """Links (a, b) that join all of the members (rep, n, family) similar enough.

    `texts` (id, text) has one row per rep.
    """
    part = F.pmod(F.xxhash64("rep", F.lit(11)), F.col("parts")).cast("int")
    dealt = stored(_parts(members, ["family"], "parts", room).withColumn("part", part), "near-dealt")
    rows = dealt.select(F.xxhash64("family", "part").alias("unit"), "rep", "n",
                        F.col("rep").alias("comp"), F.lit(True).alias("ask"))
    links = _compared(rows, texts, words, percent, room)
    large = dealt.filter("parts > 1")
    if large.isEmpty():
        return links

    def with_components(found):
        label = components(found, "near-components").withColumnRenamed("id", "rep")
        return stored(large.join(label, "rep", "left").withColumn(
            "comp", F.coalesce("component", "rep")).drop("component"), "near-large")

    # one document of every part and component, the smallest
    now = with_components(links)
    lead = now.groupBy("family", "part", "comp").agg(F.min(F.struct("rep", "n")).alias("r"))
    lead = _parts(lead.select("family", "comp", "r.rep", "r.n"), ["family"], "blocks", room)
    block = F.pmod(F.xxhash64("rep", F.lit(12)), F.col("blocks"))
    rows = lead.select(F.xxhash64("family", block).alias("unit"), "rep", "n", "comp",
                       F.lit(True).alias("ask"))
    links = stored(links.union(_compared(rows, texts, words, percent, room)), "near-links")
    # what is outside its family's largest component meets every part
    now = with_components(links)
    main = now.groupBy("family", "comp").agg(F.count(F.lit(1)).alias("m")).groupBy("family").agg(
        F.max(F.struct("m", "comp")).alias("t")).select("family", F.col("t.comp").alias("main"))
    others = _parts(now.join(main, "family").filter("comp <> main"), ["family"], "blocks", room)
    block = F.pmod(F.xxhash64("rep", F.lit(13)), F.col("blocks")).cast("int")
    asks = others.select("family", "rep", "n", "comp", block.alias("block"), F.explode(
        F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(True).alias("ask"))
    blocks = others.groupBy("family").agg(F.max("blocks").alias("blocks"))
    hear = now.join(blocks, "family").select("family", "rep", "n", "comp", F.explode(
        F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), "part", F.lit(False).alias("ask"))
    rows = asks.unionByName(hear).withColumn("unit", F.xxhash64("family", "part", "block"))
    rows = stored(rows.select("unit", "rep", "n", "comp", "ask"), "near-rest")
    return links.union(_compared(rows, texts, words, percent, room))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    words: int = 5, percent: int = 80, chunks: int = 16, width: int = 5,
                    room: int = 1_000_000, hot: int = 100_000) -> DataFrame:
    """One row per row of `docs`: doc_id, n_shingles, component_id, kept.

    Linked are documents with 100 * common shingles >= percent * all shingles.  Letters
    A-Z are lowered; a text with fewer than `words` words is one shingle; empty and
    null texts have none and are linked with nothing.  Texts are read whole, however long.
    component_id is the smallest id reachable; kept: doc_id is component_id.  Rows
    repeating an id are one document, linked with whatever one of its texts is linked with.
    A row with a null id is linked with nothing: null component, kept.  Other columns of `docs` are ignored; an empty table gives no rows.
    """
    symbols = chunks * width
    names = _columns(symbols)
    texts = docs.select(F.col(id_col).cast("bigint").alias("id"), text_of(text_col).alias("text"))
    signed, total = stored_and_counted(texts.mapInArrow(
        lambda it: _sign(it, words, symbols),
        "id bigint, n bigint, c1 bigint, c2 bigint, " + ", ".join(f"{c} bigint" for c in names)),
        "near-signed")
    # classes of equal sets, hence of equal signatures; the smallest id stands for a class
    classes, count = stored_and_counted(
        signed.filter("n > 0 and id is not null").groupBy("n", "c1", "c2")
        .agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("m"), *[F.first(c).alias(c) for c in names]), "near-classes")
    family = families(classes, count, chunks, width, percent, hot=hot)
    members = stored(family.join(classes.select("rep", "n"), "rep"), "near-members")
    named = signed.select("id", "n", "c1", "c2").join(
        classes.select("n", "c1", "c2", "rep"), ["n", "c1", "c2"])
    again = signed.groupBy("id").agg(F.count(F.lit(1)).alias("m")).filter("m > 1")
    same = None
    if not again.isEmpty():      # an id's rows are one document, whatever their texts
        texts = texts.dropDuplicates(["id", "text"])
        first = named.groupBy("id").agg(F.min("rep").alias("a"))
        same = named.join(first, "id").filter("a < rep").select("a", F.col("rep").alias("b"))
    links = exact_links(members, texts, words, percent, room)
    links = links if same is None else links.union(same)
    label = components(links, "near-components").select(F.col("id").alias("rep"), "component")
    named = stored(classes.join(label, "rep", "left").select(
        "n", "c1", "c2", "m", F.coalesce("component", "rep").alias("component")), "near-named")
    out = with_group(signed.select("id", "n", "c1", "c2"), named, ["n", "c1", "c2"], "m", total)
    comp = F.when((F.col("n") > 0) & F.col("id").isNotNull(),
                  F.col("component")).otherwise(F.col("id"))
    return out.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"),
                      comp.alias("component_id"), comp.eqNullSafe(F.col("id")).alias("kept"))


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                     words: int = 5, percent: int = 80, **options) -> DataFrame:
    """The rows of `docs`, all columns, one document of each component.

    Rows with a null id stay, and so do all rows of an id that stays.
    """
    gone = stored(near_duplicates(docs, id_col, text_col, words, percent, **options).filter("not kept")
                  .select(F.col("doc_id").alias("_gone")).distinct(), "near-gone")
    sieve = Sieve(gone, F.xxhash64("_gone"), "near-sieve")
    rows = sieve.flagged(packed(docs, _id=F.col(id_col).cast("bigint")), F.xxhash64("_id"))
    # only rows that may go are shuffled
    some = rows.filter("_maybe").join(gone.hint("merge"), F.col("_id") == F.col("_gone"), "left_anti")
    return unpacked(rows.filter("not _maybe").select("_row").unionByName(some.select("_row")), docs.columns)
