"""SimHash near-duplicates by pigeonhole blocks.

A document's fingerprint has the majority bit of its four-word shingles' 64-bit hashes, in
each place. Fingerprints link at ``MOST_BITS`` or fewer differing bits. The 64 bits are split
into ``k`` blocks; two that link agree in at least ``k - MOST_BITS`` whole blocks, so each is
entered under every choice of that many blocks, entries with the same choice and bits meet,
and the Hamming distance is verified. ``k`` grows with the number of distinct fingerprints:
it is the one that costs least, entries and expected chance meetings together.

Documents with one fingerprint are one node. Within a group of entries not all pairs are
made. First each member is compared with the group's hub, the fingerprint with the most
documents. Then, in groups whose members aren't all of one component yet, the members outside
the largest component are compared with the others, if there are at most ``MOST_OUTSIDE`` of
them: at most so many comparisons a member. Denser groups meet by midpoints instead: two
fingerprints are within four bits exactly if some point is within two bits of both, so each
member is entered under the 2,081 points within two bits of it, and whoever shares a point
links with the smallest there; no pair is made at all. So the work is linear in the number of
entries, however large a group of near copies is, and no link is lost.

Defined cases: a null text, or one without words, has fingerprint zero and links like any
other; fewer than four words are one shingle; a tie (half the hashes) gives a zero bit; very
long texts are taken whole, a piece at a time; ids are cast to long; rows that share an id
are rows of their own, each with its text's component; a row with a null id takes part and
gets its component's smallest id that isn't null (null if there is none); other columns are
left out, so their names can't clash; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rillway.llm.common import components, discard, materialise, release_memory, ship_package, table, with_hot_keys_broadcast

#: Words of a shingle, the hash's seed, and the differing bits at which two fingerprints link.
SHINGLE, SEED, MOST_BITS = 4, 42, 4
#: Members outside a group's largest component that are compared with all others one by one.
MOST_OUTSIDE = 256
#: Bytes of a text that are cut into words at once, and hashes that are unpacked at once.
PIECE, UNPACKED = 1 << 20, 1 << 16
_SPACE = re.compile(rb"[\x20\x09-\x0D]")


def _pieces(text: bytes) -> Iterator[list[bytes]]:
    """The words of a text, in lists; each but the first begins with the last words before it, as many as the next shingle needs."""
    at, held = 0, []
    while at < len(text):
        space = _SPACE.search(text, at + PIECE)
        end = space.start() if space else len(text)
        held = held + text[at:end].split()
        at = end
        if len(held) >= SHINGLE:
            yield held
            held = held[len(held) - SHINGLE + 1 :]
    if 0 < len(held) < SHINGLE:
        yield held


def shingle_hashes(words: list[bytes]) -> np.ndarray:
    """XXH64 of each run of ``SHINGLE`` words; of all words if there are fewer."""
    import xxhash

    joined, run = b" ".join(words), min(SHINGLE, len(words))
    size = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(size + 1) - 1
    firsts, lasts = (ends - size)[: len(words) - run + 1].tolist(), ends[run - 1 :].tolist()
    h = xxhash.xxh64_intdigest
    return np.array([h(joined[a:b], SEED) for a, b in zip(firsts, lasts, strict=True)], dtype=np.uint64)


def fingerprint(text: str | None) -> int:
    """The fingerprint of a text as a signed long."""
    low = text.encode("utf-8", "surrogatepass").lower() if text else b""
    ones, n = np.zeros(64, dtype=np.int64), 0
    whole = True
    for words in _pieces(low):
        if len(words) < SHINGLE and not whole:
            break  # the rest of the last piece: every shingle has been taken
        whole = False
        h = shingle_hashes(words)
        n += len(h)
        for k in range(0, len(h), UNPACKED):
            ones += np.unpackbits(h[k : k + UNPACKED].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id`` and the fingerprint ``fp`` (long) of every row."""
    ship_package(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = pa.array([fingerprint(x.as_py()) for x in batch.column(1)], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), fp], names=["doc_id", "fp"])
        release_memory()

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(run, "doc_id long, fp long")


def _edges(k: int) -> list[int]:
    return [64 * j // k for j in range(k + 1)]


def blocks_for(n: int) -> int:
    """How many blocks cost least for ``n`` fingerprints: an entry for each choice, and the chance meetings of each entry."""
    cost = lambda k: comb(k, MOST_BITS) * (1 + 2 * n / 2.0 ** (64 * (k - MOST_BITS) // k))
    return min(range(MOST_BITS + 1, 2 * MOST_BITS + 5), key=cost)


def _masks(k: int) -> list[int]:
    """For each choice of ``k - MOST_BITS`` blocks the bits of these, as a signed long."""
    edges, out = _edges(k), []
    for chosen in combinations(range(k), k - MOST_BITS):
        bits = sum((1 << edges[j + 1]) - (1 << edges[j]) for j in chosen)
        out.append(bits - (1 << 64) if bits >> 63 else bits)
    return out


def entries(nodes: DataFrame, k: int) -> DataFrame:
    """Each fingerprint under every choice of blocks: ``choice``, ``bits``, and all columns of ``nodes``."""
    under = F.explode(F.array(*[F.struct(F.lit(j).alias("choice"), F.col("fp").bitwiseAND(F.lit(m).cast("long")).alias("bits")) for j, m in enumerate(_masks(k))]))
    return nodes.withColumn("_under", under).select("_under.*", *nodes.columns)


def _near(a: str, b: str) -> Column:
    return F.bit_count(F.col(a).bitwiseXOR(F.col(b))) <= MOST_BITS


def _labelled(rows: DataFrame, links: DataFrame | None) -> DataFrame:
    if links is None:
        return rows.withColumn("label", F.col("fp"))
    label = components(links)
    return rows.join(label.withColumnRenamed("node", "fp"), "fp", "left").withColumn("label", F.coalesce("label", "fp"))


def _by_midpoints(members: DataFrame) -> DataFrame:
    """Links between all of ``members`` (``fp``) within four bits, as stars around the smallest at each shared point."""
    two = "flatten(transform(sequence(0, 63), i -> transform(sequence(i, 63), j -> fp ^ shiftleft(1L, i) ^ if(i = j, 0L, shiftleft(1L, j)))))"
    points = materialise(members.select("fp", F.explode(F.expr(f"concat(array(fp), {two})")).alias("point")))
    shared = points.groupBy("point").agg(F.min("fp").alias("a"), F.count(F.lit(1)).alias("_n")).filter("_n > 1")
    return points.join(shared, "point").filter("fp <> a").select("a", F.col("fp").alias("b")).distinct()


def find_links(nodes: DataFrame, k: int, most_outside: int = MOST_OUTSIDE) -> DataFrame | None:
    """Links between fingerprints (``fp``, and ``size``, its documents) that span every component; None if there are none."""
    entered = materialise(entries(nodes, k))
    key = ["choice", "bits"]
    groups = entered.groupBy(key).agg(F.count(F.lit(1)).alias("_n"), F.max_by("fp", F.struct("size", "fp")).alias("hub")).filter("_n > 1")
    met = materialise(entered.join(groups, key).select(*key, "fp", "hub", "_n"))
    discard(entered)
    links = materialise(met.filter((F.col("fp") != F.col("hub")) & _near("fp", "hub")).select(F.least("fp", "hub").alias("a"), F.greatest("fp", "hub").alias("b")).distinct())
    # Groups of two are settled; of the others, those that aren't one component are still open.
    open_ = materialise(_labelled(met.filter("_n > 2").select(*key, "fp"), links if links.take(1) else None))
    sides = open_.groupBy(*key, "label").agg(F.count(F.lit(1)).alias("n"))
    state = sides.groupBy(key).agg(F.max_by("label", F.struct("n", "label")).alias("main"), (F.sum("n") - F.max("n")).alias("outside")).filter("outside > 0")
    live = materialise(open_.join(state, key))
    few = live.filter(F.col("outside") <= most_outside)
    o = few.filter("label <> main").select(*[F.col(c).alias(f"_{c}") for c in key], F.col("fp").alias("a"), F.col("label").alias("_of"))
    # Two that are both outside meet once.
    meet = (F.col("choice") == F.col("_choice")) & (F.col("bits") == F.col("_bits")) & (F.col("label") != F.col("_of")) & ((F.col("label") == F.col("main")) | (F.col("a") < F.col("fp")))
    more = few.join(o, meet & _near("a", "fp")).select(F.least("a", "fp").alias("a"), F.greatest("a", "fp").alias("b")).distinct()
    dense = materialise(live.filter(F.col("outside") > most_outside).select("fp").distinct())
    if dense.take(1):
        more = more.unionByName(_by_midpoints(dense))
    links = materialise(links.unionByName(more))
    discard(met, open_, live)
    return links if links.take(1) else None


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", k: int | None = None, most_outside: int = MOST_OUTSIDE) -> DataFrame:
    """One row per row of ``docs``: ``doc_id``, ``fp`` (long), ``component_id``, and ``n_same``, the rows with that fingerprint."""
    marked = materialise(fingerprints(docs, doc_id, text))
    nodes = materialise(marked.groupBy("fp").agg(F.count(F.lit(1)).alias("size"), F.min("doc_id").alias("first")))
    n_nodes = nodes.count()
    labelled = materialise(_labelled(nodes, find_links(nodes, k or blocks_for(n_nodes), most_outside)))
    smallest = labelled.groupBy("label").agg(F.min("first").alias("component_id"))
    classes = materialise(labelled.join(smallest, "label").select("fp", "component_id", F.col("size").alias("n_same")))
    found = with_hot_keys_broadcast(marked, classes, "fp", "n_same", marked.count())
    return found.select("doc_id", "fp", "component_id", "n_same")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


#: DuckDB has no XXH64; tests/llm/test_simhash.py compares with a plain restatement over all pairs.
ORACLE = None
