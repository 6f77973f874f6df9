"""The audit against filters applied one by one, order by order."""

import re
from itertools import permutations

import numpy as np

from daywatch.llm import audit
from tests.llm.frames import docs, prose


def failures(rows, labels):
    least = {}
    for i, t, *_ in rows:
        if i is not None:
            least[t or ""] = min(i, least.get(t or "", i))
    labels = [x for x in labels if x[0] is not None]      # a null id has no label
    good = {i for i, q, _ in labels if q == 1}
    toxic = {i for i, _, x in labels if x == 1}
    for i, t, lang, *_ in rows:
        t = t or ""
        w = [x for x in re.split(r"[\x20\x09-\x0D]+", t) if x]
        bad = {"A": len(w) < 100, "B": 100 * len(set(w)) < 80 * len(w),
               "C": 100 * len(re.findall("[A-Z]", t)) > 10 * len(t),
               "D": bool(re.search("[#$%&*|]", t)), "E": i is not None and i > least[t]}
        yield lang or "", bad, i in good, i in toxic


def truth(rows, labels):
    rows = list(failures(rows, labels))
    out, share = [], {}
    for part in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == part]
        for order in permutations("ABCDE"):
            left = own
            for step, f in enumerate(order, 1):
                gone = [r for r in left if r[1][f]]
                left = [r for r in left if not r[1][f]]
                share[part, f] = share.get((part, f), 0) + len(gone)
                out.append([part, "".join(order), step, len(left), len(gone),
                            sum(r[1][f] for r in own) - len(gone),
                            sum(r[1][f] and sum(r[1].values()) == 1 for r in own),
                            sum(r[2] for r in gone), sum(r[3] for r in gone)])
    return sorted(tuple(r) + (share[r[0], r[1][r[2] - 1]],) for r in out)


LONG = " ".join(f"w{i}" for i in range(120))
ROWS = ([(i, " ".join(prose(i, 60 + 3 * i)), ("en", "de", None, "")[i % 4]) for i in range(30)]
        + [(100 + i, LONG, "en" if i % 3 else "fr") for i in range(40)]
        + [(200, LONG.upper(), "en"), (201, LONG + " #", "en"), (202, "SHOUT & MORE", "de"),
           (203, None, "de"), (204, "", "fr"), (205, " \n", "fr"), (206, "é" * 50 + "A" * 5, "fr"),
           (207, "x y " * 40000, "en"), (100, LONG, "en"), (100, LONG, "en"), (100, LONG, "de"),
           (208, "solo", "xx"), (None, LONG, "en"), (None, LONG, None), (None, None, "en")])
LABELS = [(i, i % 2, int(i % 5 == 0)) for i in range(0, 230, 3)] + [
    (102, 1, 0), (102, 0, 1), (3, None, None), (None, 1, 1), (999, 1, 1)]


def found(spark, rows, labels):
    marks = spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").selectExpr(
        "*", "'x' AS id", "'x' AS part", "'x' AS good")
    return sorted(map(tuple, audit.audit_filters(docs(spark, rows, clash=True), marks).collect()))


def test_audit_equals_brute_force(spark):
    assert found(spark, ROWS, LABELS) == truth(ROWS, LABELS)


def test_empty_tables(spark):
    assert found(spark, [], LABELS) == []
    assert found(spark, ROWS[:5], []) == truth(ROWS[:5], [])


def test_copies_meet_as_few_rows(spark):
    """One text in thousands of rows: the cells are few and no row of a copy is lost."""
    rows = [(i, "same", "en") for i in range(3000)]
    cells = audit.cells(docs(spark, rows), spark.createDataFrame([], "doc_id bigint, quality int, toxic int"))
    got = {r["mask"]: r["n"] for r in cells.collect() if r["n"]}
    assert got == {0b00001: 1, 0b10001: 2999}


def test_contractions_equal_loops():
    r = np.random.default_rng(3)
    tensor = r.integers(0, 100, (2, 2, 2, 2, 2, 2))
    names, kept, removed, *_ = audit.steps()
    assert len(names) == 600 and len({n[:2] for n in names}) == 600
    for at in (0, 17, 333, 599):
        order, step, own = names[at]
        k = g = 0
        for mask in np.ndindex(2, 2, 2, 2, 2):
            before = ["ABCDE".index(f) for f in order[:step - 1]]
            if any(mask[f] for f in before):
                continue
            g += tensor[(1, *mask)] * mask[own]
            k += tensor[(1, *mask)] * (1 - mask[own])
        assert audit.contract(tensor, kept)[1, at] == k and audit.contract(tensor, removed)[1, at] == g
