"""Filter interaction audit: what each filter removes in every order of the filters.

A document's verdict is five bits, one per filter, so a part of the corpus is a
2x2x2x2x2 tensor of counts (axis = filter, index 0 = pass, 1 = fail), and every figure
of every step of every order is a contraction of that tensor: each axis selects
pass, fail or all.  Spark reduces the documents to the tensors; one einsum per measure
does all 600 steps of a batch of parts.

The four filters on the text alone are column expressions.  The fifth, "identical to the
text of a smaller id", needs the least id of each text: rows are counted by (text digest,
part, labels) before texts meet, so thousands of copies of one text are a few rows when
they do, whatever their number.
"""

from __future__ import annotations

from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from daywatch.llm.common import text_of

FILTERS = "ABCDE"
SCHEMA = ("part string, filter_order string, step int, kept bigint, removed bigint, "
          "redundant bigint, unique_fails bigint, good_lost bigint, toxic_lost bigint, shapley bigint")


def text_failures(text: Column) -> dict[str, Column]:
    """Whether a text fails filter A (under 100 words), B (words repeat too much), C (too
    many capitals) and D (holds a symbol)."""
    words = F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), "")
    capitals = F.length(F.regexp_replace(text, "[^A-Z]+", ""))
    return {"A": F.size(words) < 100,
            "B": F.size(F.array_distinct(words)) * 100 < F.size(words) * 80,
            "C": capitals * 100 > F.length(text) * 10,
            "D": text.rlike("[#$%&*|]")}


def steps():
    """(order, step) of all 120 orders, and the selector of every axis: arrays [600, 5, 2]
    for `kept` (the filters so far pass), `removed` (the step's filter fails, earlier ones
    pass), `fails` (the step's filter fails) and `unique` (it alone fails)."""
    passes, fails, either = (1, 0), (0, 1), (1, 1)
    names, kept, removed, failing, unique = [], [], [], [], []
    for order in permutations(range(len(FILTERS))):
        for step, own in enumerate(order):
            before = order[:step]
            names.append(("".join(FILTERS[f] for f in order), step + 1, own))
            axes = range(len(FILTERS))
            kept.append([passes if f in before or f == own else either for f in axes])
            removed.append([fails if f == own else passes if f in before else either for f in axes])
            failing.append([fails if f == own else either for f in axes])
            unique.append([fails if f == own else passes for f in axes])
    return names, *[np.array(x, np.int64) for x in (kept, removed, failing, unique)]


def contract(tensor: np.ndarray, selectors: np.ndarray) -> np.ndarray:
    """[parts, 2, 2, 2, 2, 2] and [steps, 5, 2] to [parts, steps]."""
    return np.einsum("pabcde,sa,sb,sc,sd,se->ps", tensor,
                     *[selectors[:, i] for i in range(selectors.shape[1])], optimize=True)


def _contracted(batches):
    names, kept, removed, failing, unique = steps()
    order, step = pa.array([n[0] for n in names]), pa.array([n[1] for n in names], pa.int32())
    own = np.array([n[2] for n in names])
    for b in batches:
        for at in range(0, b.num_rows, 200):
            part = b.slice(at, 200)
            n = part.num_rows
            cells = part.column(1)
            row = np.repeat(np.arange(n), np.diff(cells.offsets.to_numpy()))
            flat = cells.flatten()
            tensors = np.zeros((3, n, 32), np.int64)
            mask = flat.field("mask").to_numpy()
            for i, name in enumerate(("n", "good", "toxic")):
                tensors[i, row, mask] = flat.field(name).to_numpy()
            # mask bit f is filter f: the highest bit is the last filter, so axes are turned
            total, good, toxic = (t.reshape(n, 2, 2, 2, 2, 2).transpose(0, 5, 4, 3, 2, 1)
                                  for t in tensors)
            out = contract(total, removed)
            share = np.zeros((n, len(FILTERS)), np.int64)
            for f in range(len(FILTERS)):
                share[:, f] = out[:, own == f].sum(1)
            figures = (contract(total, kept), out, contract(total, failing) - out,
                       contract(total, unique), contract(good, removed), contract(toxic, removed),
                       share[:, own])
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.repeat(part.column(0).to_numpy(zero_copy_only=False), len(names))),
                 pa.concat_arrays([order] * n), pa.concat_arrays([step] * n),
                 *[pa.array(x.ravel()) for x in figures]],
                ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails",
                 "good_lost", "toxic_lost", "shapley"])


def cells(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
          part_col: str = "lang") -> DataFrame:
    """(part, mask, n, good, toxic): rows by failed filters, bit f of the mask for filter f."""
    text = F.col("_text")
    fail = text_failures(text)
    rows = docs.select(F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"),
                       F.col(id_col).cast("bigint").alias("id"), text_of(text_col).alias("_text"))
    rows = rows.select("part", "id", F.unhex(F.sha2(text, 256)).alias("digest"),
                       sum((fail[f].cast("int") * (1 << i) for i, f in enumerate("ABCD")),
                           F.lit(0)).alias("bits"))
    marks = labels.groupBy(F.col("doc_id").cast("bigint").alias("id")).agg(
        (F.max("quality") == 1).alias("good"), (F.max("toxic") == 1).alias("toxic"))
    rows = rows.join(marks, "id", "left")
    yes = lambda c: F.coalesce(F.col(c), F.lit(False)).alias(c)
    kind = ["part", "digest", "bits", "good", "toxic"]
    # rows sharing an id and a text are counted first: this keeps the partitions by id
    rows = (rows.select("part", "id", "digest", "bits", yes("good"), yes("toxic"))
            .groupBy("id", *kind).agg(F.count(F.lit(1)).alias("n")))
    few = rows.groupBy(*kind).agg(
        F.sum("n").alias("n"), F.min("id").alias("first"), F.min_by("n", "id").alias("at_first"),
        F.sum(F.when(F.col("id").isNull(), F.col("n")).otherwise(0)).alias("no_id"))
    few = few.withColumn("least", F.min("first").over(W.partitionBy("digest")))
    own = F.col("no_id") + F.when(F.col("first") == F.col("least"), F.col("at_first")).otherwise(0)
    e = 1 << 4
    split = few.select("part", "good", "toxic", F.explode(F.array(
        F.struct(F.col("bits").alias("mask"), own.alias("n")),
        F.struct((F.col("bits") + e).alias("mask"), (F.col("n") - own).alias("n")))).alias("c"))
    count = F.col("c.n")
    return split.groupBy("part", F.col("c.mask").alias("mask")).agg(
        F.sum(count).alias("n"), F.sum(F.when(F.col("good"), count).otherwise(0)).alias("good"),
        F.sum(F.when(F.col("toxic"), count).otherwise(0)).alias("toxic"))


def audit_filters(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id",
                  text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """600 rows per part: part, filter_order, step and the counts of that step.

    A null text is empty and judged like any other (it fails A; its copies fail E); a
    null part joins the empty part.  Texts are judged whole, whatever their length.  A
    row with a null id has no smaller id and passes E.  Rows repeating an id are counted
    each; with the same text they pass or fail E together.  A document with several label
    rows is good or toxic if one of them says so; without a label, or without an id, neither.  Other
    columns of both tables are ignored; an empty table has no parts and gives no rows.
    """
    few = cells(docs, labels, id_col, text_col, part_col).groupBy("part").agg(
        F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("cells"))  # at most 32
    return few.mapInArrow(_contracted, SCHEMA)
