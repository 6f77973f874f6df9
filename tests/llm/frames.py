"""Small tables with nulls, empty and long texts, ties, repeats and clashing columns."""

import random

from pyspark.sql import types as T

DOCS = T.StructType([T.StructField(n, t) for n, t in (
    ("doc_id", T.LongType()), ("text", T.StringType()), ("lang", T.StringType()),
    ("source", T.StringType()), ("n_chars", T.LongType()))])

# columns that operators use inside; they must neither break nor leak into a result
CLASH = ("id", "key", "n", "kept", "size", "start", "block", "uses", "rep", "component", "score",
         "_id", "_n", "bucket", "label", "words", "y", "x")


def docs(spark, rows, clash=False):
    """rows: (doc_id, text[, lang[, source]])."""
    full = [(r[0], r[1], r[2] if len(r) > 2 else "en", r[3] if len(r) > 3 else "a",
             None if r[1] is None else len(r[1])) for r in rows]
    df = spark.createDataFrame(full, DOCS)
    if clash:
        from pyspark.sql import functions as F
        df = df.withColumns({c: F.lit("clash") for c in CLASH})
    return df


def prose(seed, n, words=("alpha", "beta", "gamma", "delta", "epsilon", "zeta", "eta", "theta")):
    r = random.Random(seed)
    return [r.choice(words) + str(r.randrange(40)) for _ in range(n)]


def near_rows(seed=1):
    """Groups of near copies, copies, chains, short and empty texts."""
    r, rows, i = random.Random(seed), [], 0
    for g in range(6):
        base = prose(100 + g, 60)
        for _ in range(8):
            own = list(base)
            for _ in range(r.randrange(5)):
                own[r.randrange(len(own))] = f"edit{r.randrange(1000)}"
            rows.append((i, " ".join(own)))
            i += 1
    chain = prose(7, 50)
    for k in range(12):                      # neighbours are near, the ends are not
        rows.append((i, " ".join(chain)))
        chain = chain[2:] + [f"link{k}a", f"link{k}b"]
        i += 1
    for t in ("", None, " \n", "one", "One", "one two", "ONE  two", "one two", "x" * 5000):
        rows.append((i, t))
        i += 1
    return rows + [rows[3], (None, rows[3][1]), (None, None)]
