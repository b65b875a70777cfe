"""SimHash classes against all pairs of a plain restatement."""

import random
import re

import pytest
import xxhash
from pyspark.sql import functions as F

from rillway.llm import simhash

SCHEMA = "doc_id long, text string, fp string, label string, size string, hub string"


def plain(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    runs = [" ".join(w[i : i + 4]) for i in range(max(len(w) - 3, min(len(w), 1)))]
    h = [xxhash.xxh64_intdigest(r.encode(), 42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def classes(ids, prints):
    """The smallest id that each row reaches, by all pairs."""
    own = list(range(len(prints)))

    def top(i):
        while own[i] != i:
            i = own[i]
        return i

    for i, x in enumerate(prints):
        for j in range(i):
            if (x ^ prints[j]).bit_count() <= 4 and top(i) != top(j):
                own[top(i)] = top(j)
    least = {}
    for i, k in enumerate(ids):
        if k is not None:
            least[top(i)] = min(least.get(top(i), k), k)
    return [least.get(top(i)) for i in range(len(prints))]


def texts():
    rng = random.Random(5)
    vocab = [f"w{i}" for i in range(400)] + ["É", "Über", "中文"]
    make = lambda n: rng.choices(vocab, k=n)
    out = [" ".join(make(rng.randint(1, 120))) for _ in range(150)]
    long = make(300)
    for _ in range(120):  # near copies, many of them a little over the threshold from each other
        copy = list(long)
        for _ in range(rng.randint(0, 6)):
            copy[rng.randrange(300)] = rng.choice(vocab)
        out.append(" ".join(copy).upper() if rng.random() < 0.2 else "\t ".join(copy))
    return [*out, None, "", " \n", "one", "ONE", "two words", "a b c", "a b c d", "a  b\x0bc d", "x" * 5000, " ".join(make(30_000)), "a\x1cb c\x85d e", *out[:20]]


@pytest.fixture(scope="module")
def rows():
    every = [(1000 - i, t) for i, t in enumerate(texts())]
    return [*every, every[3], (None, every[4][1]), (None, "nobody else has this text at all, no one")]


def test_fingerprints_of_pieces(monkeypatch, rows):
    for size in (1, 7, 1 << 20):
        monkeypatch.setattr(simhash, "PIECE", size)
        for _, t in rows[140:]:
            if size > 1 or len(t or "") < 3000:
                assert simhash.fingerprint(t) & (1 << 64) - 1 == plain(t)


@pytest.mark.parametrize(("k", "outside"), [(None, 256), (5, 0), (7, 3), (8, 0)])
def test_classes(spark, rows, k, outside):
    docs = spark.createDataFrame([(i, t, "x", "x", "x", "x") for i, t in rows], SCHEMA)
    got = simhash.near_duplicates(docs, k=k, most_outside=outside).select("doc_id", F.hex("fp").alias("fp"), "component_id").collect()
    prints = [plain(t) for _, t in rows]
    want = zip([i for i, _ in rows], (f"{p:X}" for p in prints), classes([i for i, _ in rows], prints), strict=True)
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)


def test_empty(spark):
    assert simhash.near_duplicates(spark.createDataFrame([], SCHEMA)).collect() == []


def test_blocks_cover_all_bits():
    for k in range(5, 13):
        masks = [m & (1 << 64) - 1 for m in simhash._masks(k)]
        for flips in ((0, 1, 2, 3), (0, 16, 32, 63), (5, 21, 40, 60)):
            bits = sum(1 << b for b in flips)
            assert any(not m & bits for m in masks)
    assert [simhash.blocks_for(n) for n in (10**3, 10**5, 10**7, 10**10)] == sorted(simhash.blocks_for(n) for n in (10**3, 10**5, 10**7, 10**10))


def test_query(spark):
    got = simhash.query(spark, "/root/testdata/sf0.001").collect()
    texts = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    prints = [plain(r.text) for r in texts]
    ids = [r.doc_id for r in texts]
    want = zip(ids, (f"{p:016x}" for p in prints), classes(ids, prints), strict=True)
    assert sorted(map(tuple, got)) == sorted(want)
