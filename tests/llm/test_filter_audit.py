"""The audit against a plain loop over all orders, and its SQL on awkward rows."""

import random
import re
from itertools import permutations

import duckdb
import pandas as pd
import pytest

from rillway.llm import filter_audit as A

SCHEMA = "doc_id long, text string, source string, A string, part string, good string, n string, bits string"
NAMES = ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]


def plain(rows, labels):
    first, good, toxic = {}, set(), set()
    for i, t, _ in rows:
        if i is not None:
            first[t or ""] = min(first.get(t or "", i), i)
    for i, q, x in labels:
        good |= {i} if i is not None and q == 1 else set()
        toxic |= {i} if i is not None and x == 1 else set()
    parts = {}
    for i, t, s in rows:
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = [len(w) < 50, 100 * len(set(w)) < 65 * len(w), 100 * len(re.findall("[A-Z]", t)) > 5 * len(t), bool(re.search("[#$%&*|]", t)), i is not None and i > first[t]]
        parts.setdefault(s or "", []).append(({f for f, bad in zip("ABCDE", fails, strict=True) if bad}, i in good, i in toxic))
    out, shapley = [], {}
    for part, docs in parts.items():
        for order in permutations("ABCDE"):
            for step, f in enumerate(order, 1):
                before = set(order[: step - 1])
                left = [d for d in docs if not d[0] & before]
                cut = [d for d in left if f in d[0]]
                shapley[part, f] = shapley.get((part, f), 0) + len(cut)
                out.append([part, "".join(order), step, len(left) - len(cut), len(cut), sum(f in d[0] for d in docs) - len(cut), sum(d[0] == {f} for d in docs), sum(d[1] for d in cut), sum(d[2] for d in cut), f])
    return sorted(tuple([*r[:-1], shapley[r[0], r[-1]]]) for r in out)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(9)
    vocab = ["of", "the", "Up", "LOUD", "50%", "a#b", "é", "ÉA", "中"] + [f"w{i}" for i in range(300)]
    texts = [" ".join(rng.choices(vocab[: rng.choice([5, 40, 309])] if rng.random() < 0.5 else vocab[9:], k=rng.choice([1, 49, 50, 51, 90, 200]))) for _ in range(150)]
    texts += [None, "", " \n", "\x0b", "x" * 4000, "É" * 60, "A " * 60, " ".join(f"w{i}" for i in range(5000)), " ".join(["w1"] * 35 + [f"v{i}" for i in range(65)]), "\x1c".join("ab" for _ in range(60)), texts[0], texts[1], texts[1], None]
    return [(1000 - i if i % 7 else None if i % 2 else i, t, rng.choice(["a", "b", None, "", "c d"])) for i, t in enumerate(texts)] + [(500, texts[2], "a"), (500, texts[2], "a"), (501, texts[2], "z")]


LABELS = [(i, i % 2, int(i % 5 == 0)) for i in range(840, 1001)] + [(900, 0, 0), (900, 1, 1), (None, 1, 1), (901, None, None), (5000, 1, 1)]


def made(spark, rows, **how):
    docs = spark.createDataFrame([(*r, "x", "x", "x", "x", "x") for r in rows], SCHEMA).repartition(3)
    labels = spark.createDataFrame([(*r, "x") for r in LABELS], "doc_id long, quality int, toxic int, part string")
    flags = A.with_labels(A.flag_texts(docs), labels, {"good": "quality", "toxic": "toxic"})
    return A.passing_counts(A.build_index(flags, [*"ABCDE", "good", "toxic"]), 5, 2)


def test_all_orders(spark, rows):
    got = A.audit(made(spark, rows), "ABCDE", ["good_lost", "toxic_lost"])
    assert got.columns == NAMES
    assert sorted(map(tuple, got.collect())) == plain(rows, LABELS)


def test_packs_in_pieces(spark, rows, monkeypatch):
    whole = sorted(map(tuple, made(spark, rows).collect()))
    monkeypatch.setattr(A, "_HELD", 10)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        assert sorted(map(tuple, made(spark, rows).collect())) == whole
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_sql(rows):
    con = duckdb.connect()
    con.register("documents", pd.DataFrame([(*r,) for r in rows], columns=["doc_id", "text", "source"]).astype({"doc_id": "Int64"}))
    con.register("labels", pd.DataFrame(LABELS, columns=["doc_id", "quality", "toxic"]).astype("Int64"))
    got = con.sql(f"SELECT {', '.join(NAMES)} FROM ({A.ORACLE})").fetchall()
    assert sorted(got) == plain(rows, LABELS)


def test_other_filters_and_empty(spark):
    rows = spark.createDataFrame([("p", True, False, True), ("p", False, None, False), (None, True, True, True)], "part string, x boolean, y boolean, l boolean")
    counts = A.passing_counts(A.build_index(rows, ["x", "y", "l"]), 2, 1)
    got = {(r.part, r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.lost, r.shapley) for r in A.audit(counts, "xy", ["lost"]).collect()}
    assert got["p", "xy", 1] == (1, 1, 0, 1, 1, 2) and got["p", "yx", 1] == (2, 0, 0, 0, 0, 0) and got["", "yx", 2] == (0, 0, 1, 0, 0, 1)
    assert made(spark, []).collect() == [] and A.audit(made(spark, []), "ABCDE", ["g", "t"]).collect() == []
