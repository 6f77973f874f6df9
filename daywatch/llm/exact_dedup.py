"""Exact duplicates by progressive refinement: length, prefix hash, full hash.

Only narrow rows are shuffled (id, lengths, hashes), never a text of a document that has
no copy.  Lengths that occur twice, then (length, prefix hash) pairs that do, become bit
tables of bounded size; the next level looks at the rows that pass.  So a second read
hashes the full content of surviving groups only, where the rows lie, and a common length
is no key of any join.  Counts are pre-aggregated: a group of copies that holds a third of
all rows costs a level no more than one row per task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from daywatch.llm.common import (WS, Sieve, packed, stored, stored_and_counted, text_of, unpacked,
                                 with_group)


def _judged(docs: DataFrame, id_col: str, text_col: str, prefix: int, digest_all: bool) -> DataFrame:
    """Per row: _id, _raw (hash of the text as it is), keep_id, group_size, kept, _sha."""
    text = text_of(text_col)
    body = F.translate(text, WS, "")
    keys, total = stored_and_counted(
        docs.select(F.length(body).alias("_n"), F.xxhash64(F.substring(body, 1, prefix)).alias("_p")),
        "dedup-keys")
    # level 1: lengths that occur twice; level 2: among them, prefixes that do
    length = F.xxhash64("_n", F.lit(1))
    lengths = stored(keys.groupBy("_n").count().filter("count > 1"), "dedup-lengths")
    level1 = Sieve(lengths, length, "dedup-sieve").flagged(keys, length).filter("_maybe")
    pair = F.xxhash64("_n", "_p", F.lit(2))
    prefixes = stored(level1.groupBy("_n", "_p").count().filter("count > 1"), "dedup-prefixes")
    level2 = Sieve(prefixes, pair, "dedup-sieve")
    # level 3: the full content of what is left
    full = docs.select(F.col(id_col).alias("_id"), F.xxhash64(text).alias("_raw"),
                       F.length(text).alias("_cp"), F.length(body).alias("_n"),
                       F.xxhash64(F.substring(body, 1, prefix)).alias("_p"), body.alias("_body"))
    full = level2.flagged(full, pair, "_open")
    digest = F.sha2("_body", 256)
    full = stored(full.select("_id", "_raw", "_cp", "_n", "_open", (
        digest if digest_all else F.when(F.col("_open"), digest)).alias("_sha")), "dedup-digests")
    rank = F.struct((-F.col("_cp")).alias("cp"), F.col("_id").isNull().alias("no_id"),
                    F.col("_id").alias("id"), F.col("_raw").alias("raw"))
    groups = stored(full.filter("_open").groupBy("_n", "_sha")
                    .agg(F.count(F.lit(1)).alias("_size"), F.min(rank).alias("_best"))
                    .filter("_size > 1"), "dedup-groups")
    joined = with_group(full, groups, ["_n", "_sha"], "_size", total)
    # rows that repeat an id and its text: one of them stays
    again = Window.partitionBy("_id", "_raw", "_sha").orderBy("_n")
    hit = F.col("_size").isNotNull()
    best = F.col("_best")
    mine = (best["cp"] == -F.col("_cp")) & best["id"].eqNullSafe(F.col("_id")) & (best["raw"] == F.col("_raw"))
    return joined.withColumn("_copy", F.row_number().over(again)).select(
        "_id", "_raw", "_sha", F.when(hit, best["id"]).otherwise(F.col("_id")).alias("_keep"),
        F.when(hit, F.col("_size")).otherwise(F.lit(1)).cast("bigint").alias("_group"),
        F.when(hit, mine & (F.col("_copy") == 1)).otherwise(F.lit(True)).alias("_kept"))


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                     prefix: int = 64, digest_all: bool = False) -> DataFrame:
    """One row per row of `docs`: id, keep_id, group_size, kept, text_sha256.

    Texts are equal when they agree after deleting blanks and tab to carriage
    return; null counts as empty, and empty texts are copies of each other.  Texts are
    compared whole, however long.  Of equal texts the one with the most code points stays,
    then the smallest id (a null id comes last), then the smallest hash of the text.  Rows
    that repeat an id and its text are copies: one of them stays.  `text_sha256` is the
    digest that the last level compares: null for rows that were settled earlier, unless
    `digest_all`.  Other columns of `docs` are ignored; an empty table gives no rows.
    """
    return _judged(docs, id_col, text_col, prefix, digest_all).select(
        F.col("_id").alias(id_col), F.col("_keep").alias("keep_id"), F.col("_group").alias("group_size"),
        F.col("_kept").alias("kept"), F.col("_sha").alias("text_sha256"))


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of `docs`, all columns, without the copies.

    Rows are matched by id and text; rows repeating both are reduced to one.  Nulls, empty
    and long texts and empty tables as in `exact_duplicates`.
    """
    judged = stored(_judged(docs, id_col, text_col, 64, False).select("_id", "_raw", "_kept"),
                    "dedup-judged")
    gone = judged.filter("not _kept").select("_id", "_raw").distinct()
    # a text that stays once and goes once stays in one of its rows
    left = judged.filter("_kept").select("_id", "_raw", F.lit(True).alias("_stay")).distinct()
    gone = stored(gone.join(left, gone["_id"].eqNullSafe(left["_id"]) & (gone["_raw"] == left["_raw"]), "left")
                  .select(gone["_id"].alias("_g"), gone["_raw"].alias("_r"), "_stay"), "dedup-gone")
    sieve = Sieve(gone, F.xxhash64("_g", "_r"), "dedup-sieve")
    rows = sieve.flagged(packed(docs, _id=F.col(id_col), _raw=F.xxhash64(text_of(text_col))),
                         F.xxhash64("_id", "_raw"))
    # only rows that may go are shuffled
    some = rows.filter("_maybe").join(
        gone.hint("merge"), F.col("_id").eqNullSafe(F.col("_g")) & (F.col("_raw") == F.col("_r")), "left")
    nth = F.row_number().over(Window.partitionBy("_id", "_raw").orderBy("_r"))
    some = some.withColumn("_nth", nth).filter("_r is null or (_stay and _nth = 1)")
    return unpacked(rows.filter("not _maybe").select("_row").unionByName(some.select("_row")), docs.columns)
