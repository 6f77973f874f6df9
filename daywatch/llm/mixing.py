"""Mix sources to target weights from packed blocks, with DataFrame functions only.

Words of a source, document after document, form one stream that is cut into
blocks of a fixed number of words (fewer in the last one, and in all blocks of a
source whose target is a few blocks).  The mix is a row of slots, one block each,
dealt to output shards.  A shard's counts per source are multinomial draws given
the source totals: a pseudorandom permutation of all slots cuts them into runs as
long as each source's share.  The r-th slot of a source maps through that source's
index permutation, a fresh one for each pass, to a block.  Blocks are joined by
index.  No pass uses a block twice, so a cap of 3 passes caps every document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from daywatch.llm.common import WORD, packed, stored, text_of, unpacked

WEIGHTS = (5.0, 2.0, 1.0)


def word_count(column: str) -> Column:
    return F.regexp_count(text_of(column), F.lit(WORD)).cast("bigint")


def source_targets(sizes: DataFrame, weights=WEIGHTS, cap: float = 3.0) -> DataFrame:
    """Per source: source_size, target.  `sizes`: one row per source (source, source_size).

    Sources by code point, null last, take the weights in turn and share the sum of
    all sizes; a target stops at `cap` times its source, the excess is reshared by
    weight.  In closed form: targets are min(cap * size, level * weight) for one
    level; with sources ordered by cap * size / weight, a source is capped while its
    ratio is below the level that the others would have.  There is one narrow row per
    source here, never one per document.
    """
    order = Window.orderBy(F.col("source").isNull(), F.col("source"))
    turn = F.row_number().over(order) - 1
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]),
                     (F.pmod(turn, F.lit(len(weights))) + 1).cast("int"))
    rows = sizes.withColumn("_w", w).withColumn("_cap", cap * F.col("source_size"))
    rows = rows.withColumn("_ratio", F.col("_cap") / F.col("_w"))
    everything = Window.partitionBy()
    by = Window.orderBy("_ratio", F.col("source").isNull(), F.col("source"))
    before = by.rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumns({
        "_all": F.sum("source_size").over(everything),
        "_w_left": F.sum("_w").over(everything) - F.coalesce(F.sum("_w").over(before), F.lit(0.0)),
        "_used": F.coalesce(F.sum("_cap").over(before), F.lit(0.0))})
    level = (F.col("_all") - F.col("_used")) / F.col("_w_left")
    first = F.when(F.col("_ratio") >= level, F.struct(F.col("_at"), level.alias("level")))
    rows = rows.withColumn("_at", F.row_number().over(by))
    rows = rows.withColumn("_level", F.min(first).over(everything)["level"])
    return rows.select("source", "source_size",
                       F.least(F.col("_cap"), F.coalesce(F.col("_level") * F.col("_w"), F.col("_cap")))
                       .alias("target"))


def permuted(x: Column, n: Column, key: Column, walks: int = 16, back: bool = False) -> Column:
    """A pseudorandom permutation of 0..n-1, a function of x, n and key; `back`: its inverse.

    A Feistel network over a x b >= n with a near the root of n; values from n on walk
    the cycle back.  At most a of them exist, so a walk of 16 misses with a chance
    below n ** -8; such a value stays where it is below n by a last remainder.
    """
    a = F.greatest(F.ceil(F.sqrt(n.cast("double"))).cast("bigint"), F.lit(1).cast("bigint"))
    b = F.floor((n + a - 1) / a).cast("bigint")

    def step(v: Column) -> Column:
        left, right = F.floor(v / b).cast("bigint"), F.pmod(v, b)
        for i in (2, 0) if back else ():
            right = F.pmod(right - F.pmod(F.xxhash64(left, key, F.lit(i + 1)), b), b)
            left = F.pmod(left - F.pmod(F.xxhash64(right, key, F.lit(i)), a), a)
        for i in () if back else (0, 2):
            left = F.pmod(left + F.pmod(F.xxhash64(right, key, F.lit(i)), a), a)
            right = F.pmod(right + F.pmod(F.xxhash64(left, key, F.lit(i + 1)), b), b)
        return left * b + right

    first = step(x)
    walk = F.aggregate(F.sequence(F.lit(1), F.lit(walks)), first,
                       lambda acc, _: F.when(acc < n, acc).otherwise(step(acc)))
    return F.when(first < n, first).otherwise(F.pmod(walk, n))


def stream_offsets(docs: DataFrame, id_col: str, text_col: str, source_col: str,
                   rows_per_bucket: int = 20_000) -> DataFrame:
    """doc_id, source, size and the document's first word's place in its source's stream.

    Running sums go over hash buckets of a bounded number of rows, then over the
    bucket totals of a source, so no task holds a whole source.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("source"),
                       word_count(text_col).alias("size"))
    rows = stored(rows, "mix-sizes")
    buckets = max(1, rows.count() // rows_per_bucket)
    rows = rows.withColumn("_b", F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(buckets)))
    totals = rows.groupBy("source", "_b").agg(F.sum("size").alias("_t"))
    before = (Window.partitionBy("source").orderBy("_b")
              .rowsBetween(Window.unboundedPreceding, -1))
    totals = totals.select(F.col("source").alias("_s"), F.col("_b").alias("_tb"),
                           F.coalesce(F.sum("_t").over(before), F.lit(0)).alias("_base"))
    inside = (Window.partitionBy("source", "_b").orderBy(F.xxhash64("doc_id"), "doc_id", "size")
              .rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("_in", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    rows = rows.join(totals, (F.col("_b") == F.col("_tb")) & F.col("source").eqNullSafe(F.col("_s")))
    return rows.select("doc_id", "source", "size", (F.col("_base") + F.col("_in")).alias("start"))


def pass_key(seed: int, nth: Column) -> Column:
    """The key of a source's index permutation in its nth pass."""
    return F.xxhash64(F.lit(seed), F.coalesce("source", F.lit("")), F.col("source").isNull(),
                      nth.cast("bigint"))


def source_quotas(targets: DataFrame, block: int, cap: float, seed: int, least_slots: int = 16
                  ) -> DataFrame:
    """`targets` with block_words, blocks and quota: the slots whose words come nearest the target.

    Full passes give the source's size each.  The pass that is left gives whole blocks,
    and its short last one from the place on that the pass's permutation has for it.  A
    target below `least_slots` blocks is cut into blocks of a `least_slots`-th of it (one
    word at least), so it is met to half such a block.
    """
    short = F.floor(F.col("target") / least_slots).cast("bigint")
    one = F.lit(1).cast("bigint")
    rows = targets.withColumn("block_words", F.greatest(one, F.least(F.lit(block).cast("bigint"), short)))
    rows = rows.withColumn("blocks", F.ceil(F.col("source_size") / F.col("block_words")).cast("bigint"))
    size, words, n = F.greatest("source_size", one), F.col("block_words"), F.greatest("blocks", one)
    rows = rows.withColumn("_full", F.floor(F.col("target") / size).cast("bigint"))
    rows = rows.withColumns({
        "_rest": F.col("target") - F.col("_full") * F.col("source_size"),
        "_lack": F.col("blocks") * words - F.col("source_size"),
        "_short": permuted(n - 1, n, pass_key(seed, F.col("_full")), back=True)})
    rest, lack, place = F.col("_rest"), F.col("_lack"), F.col("_short")
    without = F.least(place, F.round(rest / words).cast("bigint"))
    held = F.least(n, F.greatest(place + 1, F.round((rest + lack) / words).cast("bigint")))
    rows = rows.withColumns({"_without": without, "_held": held})
    nearer = F.abs(F.col("_held") * words - lack - rest) < F.abs(F.col("_without") * words - rest)
    quota = F.col("_full") * F.col("blocks") + F.when(nearer, F.col("_held")).otherwise(F.col("_without"))
    quota = F.least(quota, F.floor(cap * F.col("blocks")).cast("bigint"))
    return rows.withColumn("quota", quota).select(*targets.columns, "block_words", "blocks", "quota")


def mix_sources(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                source_col: str = "source", weights=WEIGHTS, cap: float = 3.0,
                block: int = 32, shard_slots: int = 4096, seed: int = 11):
    """(placed, uses, slots): the documents in their streams, how often each block is taken,
    and the slots of the mix.

    placed: doc_id, source, size, start, source_size, target, block_words (`block`, or
    fewer for a small target).
    uses: source, block, uses (1 to `cap`; blocks not taken have no row).
    slots: shard, slot, source, block: one row per block of the mix.
    Null texts have size 0, null sources form a source of their own (last in order),
    an empty table gives no rows.  All results depend on the rows alone.
    """
    spark = docs.sparkSession
    placed = stream_offsets(docs, id_col, text_col, source_col)
    placed = stored(placed, "mix-places")
    per = placed.groupBy("source").agg(F.sum("size").alias("source_size"))
    targets = stored(source_quotas(source_targets(per, weights, cap), block, cap, seed), "mix-targets")
    run = Window.orderBy(F.col("source").isNull(), F.col("source"))
    shares = targets.filter("quota > 0").select(
        "source", "blocks", "quota",
        F.coalesce(F.sum("quota").over(run.rowsBetween(Window.unboundedPreceding, -1)),
                   F.lit(0)).alias("first"),
        F.row_number().over(run).alias("turn"))
    total = shares.agg(F.coalesce(F.sum("quota"), F.lit(0))).first()[0]
    # a source's run of permuted slots, found by equality on pieces of the slot range
    piece = max(1, -(-total // 1024))
    spans = shares.withColumn("_piece", F.explode(F.sequence(
        F.floor(F.col("first") / piece), F.floor((F.col("first") + F.col("quota") - 1) / piece))))
    slots = spark.range(total).select(
        F.col("id").alias("slot"), F.floor(F.col("id") / shard_slots).alias("shard"),
        permuted(F.col("id"), F.lit(total).cast("bigint"), F.lit(seed)).alias("_at"))
    slots = slots.withColumn("_piece", F.floor(F.col("_at") / piece))
    slots = slots.join(spans, "_piece").filter(
        (F.col("_at") >= F.col("first")) & (F.col("_at") < F.col("first") + F.col("quota")))
    nth = F.col("_at") - F.col("first")
    slots = slots.withColumns({"_nth": nth, "_pass": F.floor(nth / F.col("blocks"))})
    slots = slots.select("shard", "slot", "source", permuted(
        F.pmod(F.col("_nth"), F.col("blocks")), F.col("blocks"), pass_key(seed, F.col("_pass")))
        .alias("block"))
    uses = slots.groupBy("source", "block").agg(F.count(F.lit(1)).alias("uses"))
    known = targets.select(F.col("source").alias("_s"), "source_size", "target", "block_words")
    placed = placed.join(known, F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    return placed, uses, slots


def doc_blocks(placed: DataFrame, uses: DataFrame) -> DataFrame:
    """One row per document and block it reaches into: `placed` plus block, words, uses."""
    block = F.col("block_words")
    last = F.floor((F.col("start") + F.col("size") - 1) / block)
    rows = placed.withColumn("block", F.explode_outer(F.when(
        F.col("size") > 0, F.sequence(F.floor(F.col("start") / block), last))))
    lo = F.greatest(F.col("start"), F.col("block") * block)
    hi = F.least(F.col("start") + F.col("size"), (F.col("block") + 1) * block)
    rows = rows.withColumn("words", F.coalesce(hi - lo, F.lit(0)))
    u = uses.select(F.col("source").alias("_s"), F.col("block").alias("_b"), "uses")
    return (rows.join(u, (F.col("block") == F.col("_b"))
                      & F.col("source").eqNullSafe(F.col("_s")), "left")
            .drop("_s", "_b").withColumn("uses", F.coalesce("uses", F.lit(0))))


def taken_words(docs: DataFrame, block: int = 32, **options) -> DataFrame:
    """Per document: doc_id, source, size, source_size, target, taken."""
    placed, uses, _ = mix_sources(docs, block=block, **options)
    return (doc_blocks(placed, uses)
            .groupBy("doc_id", "source", "size", "start", "source_size", "target")
            .agg(F.sum(F.col("words") * F.col("uses")).cast("bigint").alias("taken")))


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    block: int = 32, cap: int = 3, **options) -> DataFrame:
    """The mix as documents, with the columns of `docs`.

    A document's n-th row holds its words that lie in blocks taken at least n times, so
    the words of all rows are the words taken.  A row that holds every word has the
    text unchanged; of others the words are joined by a blank.  Rows are matched by id
    and size; rows that repeat both share their places in order of the stream.
    """
    placed, uses, _ = mix_sources(docs, id_col=id_col, text_col=text_col, block=block,
                                  cap=float(cap), **options)
    per = (doc_blocks(placed, uses).filter("size > 0")
           .groupBy("doc_id", "source", "size", "start", "block_words")
           .agg(F.sort_array(F.collect_list(F.struct("block", "uses"))).alias("_uses")))
    per = per.select(F.col("doc_id").alias("_d"), F.col("source").alias("_src"),
                     F.col("size").alias("_z"), F.col("start").alias("_start"),
                     F.col("block_words").alias("_block"), F.col("_uses")["uses"].alias("_uses"),
                     F.row_number().over(Window.partitionBy("doc_id", "source", "size")
                                         .orderBy("start")).alias("_k"))
    rows = packed(docs, _id=F.col(id_col), _text=text_of(text_col), _z2=word_count(text_col),
                  _s2=F.col(options.get("source_col", "source")).cast("string"))
    rows = rows.withColumn("_k2", F.row_number().over(
        Window.partitionBy("_id", "_s2", "_z2").orderBy(F.xxhash64("_text"))))
    rows = rows.join(per, F.col("_id").eqNullSafe(F.col("_d")) & F.col("_s2").eqNullSafe(F.col("_src"))
                     & (F.col("_z2") == F.col("_z")) & (F.col("_k2") == F.col("_k")))
    rows = rows.withColumn("_nth", F.explode(F.sequence(F.lit(1), F.lit(cap))))
    rows = rows.filter(F.exists("_uses", lambda u: u >= F.col("_nth")))
    whole = F.forall("_uses", lambda u: u >= F.col("_nth"))
    words = F.regexp_extract_all("_text", F.lit(f"({WORD})"), 1)
    part = F.concat_ws(" ", F.filter(words, lambda w, i: F.get(F.col("_uses"), (
        F.floor((F.col("_start") + i) / F.col("_block"))
        - F.floor(F.col("_start") / F.col("_block"))).cast("int"))
        >= F.col("_nth")))
    changed = {text_col: F.when(whole, F.col(f"_row.`{text_col}`")).otherwise(part)}
    if "n_chars" in docs.columns:
        changed["n_chars"] = F.when(whole, F.col("_row.n_chars")).otherwise(
            F.length(part).cast("bigint"))
    return unpacked(rows, docs.columns, **changed)
