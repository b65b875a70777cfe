"""Stupid-backoff language-model scores, computed relationally.

The model is a bigram model over all words: nothing that is counted is cut or pooled, so it
grows with the corpus. Counts cover all documents. A pair of words that another document has
too scores ``log(c(u, v) / c(u))``; a pair that only this document has counts as unseen and
backs off to ``log(BACKOFF * c(v) / N)``. A document's score is the mean over its pairs. A
caller may close the vocabulary at ``vocabulary`` words; every other word then counts as one.
A document is an id: that two rows of one id have a pair doesn't make it seen.

The ``FREQUENT`` most frequent words have small ids, and executors get a table of their
counts; any other word is known by its hash. This changes where a count comes from and no
score. Pairs of two hot words would make a skewed shuffle: each task
adds them up into a table of at most ``(HOT + 1)^2`` cells, and a document's share of the score
is looked up there. Hot are the ``HOT`` most frequent words of a sample of about ``SAMPLE_DOCS``
documents, so that words and hot pairs are counted in one pass over the texts; which words
are hot changes no score either (a closed vocabulary takes its own, in a pass more). Every
other pair is shuffled once:

- two frequent words by the pair; the counts of its words come from the table;
- a pair with a rare word by that word, so that where it arrives all occurrences of the word
  do, and the word's count is their sum. As second word (``v``) it gives what an unseen pair
  needs, as first word (``u``) what a seen pair needs. A pair of two rare words goes both ways,
  and scores at the one that its being seen or not asks for. The first and the last word of a
  document are in no pair on one side, and are sent alone for the sum.

Defined cases: a null text, or one of fewer than two words, has no pairs and a null score;
rows that share an id, or have none, count as one document whose pairs add up, and each gets
that score; ids are read as longs (the smallest long stands for a missing one);
ties in word frequency are settled by the word's hash; very long texts are taken whole; other
columns are left out; an empty table gives an empty result.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest as _hash

from rillway.llm.common import materialise, release_memory, ship_package, table

FREQUENT, HOT, BACKOFF, WORDS_HELD, SAMPLE_DOCS, BYTES_AT_ONCE = 65_535, 400, 0.4, 250_000, 16_000, 1 << 18
#: A rare word's code has the sign bit, and this bit too where it is sent as first word of a pair.
_RARE, _FIRST = -(1 << 63), 1 << 62
#: What stands for the missing neighbour at a text's edge, and where keys of whole documents begin,
#: of a document's hot pairs and of their score; the parts of 1 that the score is sent in.
_EDGE, _DOCUMENT, _SCORE, _PARTS = 1 << 20, 1 << 40, 1 << 41, 1 << 36
#: The smallest and the largest long.
_NO_ID, _LAST_ID = -(1 << 63), (1 << 63) - 1
_COUNTED = "key long, n long, first long, last long"


def words_of(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def _cuts(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """Ranges of about ``BYTES_AT_ONCE`` of text, of one text where that is longer."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)) // BYTES_AT_ONCE
    starts = np.flatnonzero(np.diff(ends, prepend=-1))
    yield from zip(starts.tolist(), [*starts[1:].tolist(), len(texts)], strict=False)


def _hashes(words) -> np.ndarray:
    return np.fromiter(map(_hash, words), dtype=np.uint64, count=len(words)).view(np.int64)


class HotPairs:
    """How often each pair of hot words stands, and the smallest and largest id of its documents.

    The two are equal where only one document has the pair.
    """

    def __init__(self, width: int):
        self.width = width
        self.n = np.zeros(width * width, dtype=np.int64)
        self.first = np.full(width * width, _LAST_ID, dtype=np.int64)
        self.last = np.full(width * width, _NO_ID, dtype=np.int64)

    def add(self, u: np.ndarray, v: np.ndarray, of: np.ndarray, ids: np.ndarray) -> None:
        """Pairs of the documents at places ``of`` among ``ids``."""
        each, count = np.unique((of << 32) | (u * self.width + v), return_counts=True)
        pair, doc = each & 0xFFFFFFFF, ids[each >> 32]
        np.add.at(self.n, pair, count)
        np.minimum.at(self.first, pair, doc)
        np.maximum.at(self.last, pair, doc)

    def batch(self) -> pa.RecordBatch:
        at = np.flatnonzero(self.n)
        return pa.RecordBatch.from_arrays([pa.array(at), pa.array(self.n[at]), pa.array(self.first[at]), pa.array(self.last[at])], names=["key", "n", "first", "last"])


def _ids(column: pa.Array) -> np.ndarray:
    return column.fill_null(_NO_ID).to_numpy(zero_copy_only=False)


def _frequent_words(docs: DataFrame, most: int) -> list[bytes]:
    """The ``most`` most frequent words of a sample of documents."""
    whole = 1 << 20
    share = min(whole, -(-whole * SAMPLE_DOCS // max(docs.count(), 1)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            count = Counter(chain.from_iterable(words_of(t.as_py()) for t in batch.column(0)))
            yield pa.RecordBatch.from_arrays([pa.array(count.keys(), pa.binary()), pa.array(count.values(), pa.int64())], names=["word", "n"])

    sample = docs.filter(F.pmod(F.xxhash64("doc_id"), F.lit(whole)) < share).select("text")
    counts = sample.mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return [bytes(r["word"]) for r in counts.orderBy(F.desc("n"), "word").limit(most).select("word").collect()]


def _counted(docs: DataFrame, hot: list[bytes]) -> DataFrame:
    """``key``, ``n``, ``first`` and ``last``: words by hash and how often they stand (``first`` is
    null), and pairs of hot words by their places among these, with their documents' outermost ids."""
    places = {w: k + 1 for k, w in enumerate(hot)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs = HotPairs(len(hot) + 1)
        for batch in batches:
            doc = _ids(batch.column(0))
            count: Counter = Counter()
            for k, end in _cuts(batch.column(1)):
                lists = [words_of(t) for t in batch.column(1).slice(k, end - k).to_pylist()]
                flat = list(chain.from_iterable(lists))
                count.update(flat)
                if places and flat:
                    at = np.fromiter(map(places.get, flat, repeat(0)), dtype=np.int64, count=len(flat))
                    of = np.repeat(np.arange(len(lists)), [len(w) for w in lists])
                    pick = (at[:-1] > 0) & (at[1:] > 0) & (of[:-1] == of[1:])
                    pairs.add(at[:-1][pick], at[1:][pick], of[:-1][pick], doc[k:])
            none = pa.nulls(len(count), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(_hashes(count)), pa.array(count.values(), pa.int64()), none, none], names=["key", "n", "first", "last"])
        yield pairs.batch()
        release_memory()

    each = docs.select("doc_id", "text").mapInArrow(run, _COUNTED)
    return each.groupBy("key", F.col("first").isNotNull().alias("_pair")).agg(F.sum("n").alias("n"), F.min("first").alias("first"), F.max("last").alias("last"))


def _most_frequent(counts: DataFrame, most: int) -> pa.Table:
    return counts.orderBy(F.desc("n"), "word").limit(most).toArrow()


class Vocabulary:
    """Ids by frequency rank from 1; any other word has its code, or 0 in a closed vocabulary."""

    def __init__(self, hashes: np.ndarray, closed: bool):
        self.order = np.argsort(hashes)
        self.sorted = hashes[self.order]
        self.closed = closed
        self.held: dict[bytes, int] = {}

    def ids(self, words: list[bytes]) -> np.ndarray:
        held = self.held
        if len(held) > WORDS_HELD:
            held.clear()
        if new := list(set(words).difference(held)):
            h = _hashes(new)
            other = np.zeros(len(h), dtype=np.int64) if self.closed else h & (_FIRST - 1) | _RARE
            if len(self.sorted):
                at = np.minimum(np.searchsorted(self.sorted, h), len(self.sorted) - 1)
                other = np.where(self.sorted[at] == h, self.order[at] + 1, other)
            held.update(zip(new, other.tolist(), strict=True))
        return np.fromiter(map(held.__getitem__, words), dtype=np.int64, count=len(words))


def _slices(batches: Iterator[pa.RecordBatch], hashes: np.ndarray, closed: bool) -> Iterator[tuple]:
    """Some documents at a time: their batch, and of each word its code and its document's place in it."""
    vocabulary = Vocabulary(hashes, closed)
    for batch in batches:
        for k, end in _cuts(batch.column(1)):
            part = batch.slice(k, end - k)
            lists = [words_of(t) for t in part.column(1).to_pylist()]
            of = np.repeat(np.arange(len(lists)), [len(x) for x in lists])
            yield part, vocabulary.ids(list(chain.from_iterable(lists))), of
    vocabulary.held.clear()
    release_memory()


def _hot(u: np.ndarray, v: np.ndarray, hot: int) -> np.ndarray:
    return (u >= 0) & (u <= hot) & (v >= 0) & (v <= hot)


def _hot_counts(docs: DataFrame, hashes: np.ndarray, closed: bool, hot: int) -> DataFrame:
    """``key``, ``n``, ``first`` and ``last``, the outermost ids of its documents, for the pairs of hot words of each task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs = HotPairs(hot + 1)
        for part, ids, of in _slices(batches, hashes, closed):
            u, v = ids[:-1], ids[1:]
            pick = (of[:-1] == of[1:]) & _hot(u, v, hot)
            pairs.add(u[pick], v[pick], of[:-1][pick], _ids(part.column(0)))
        yield pairs.batch()

    return docs.select("doc_id", "text").mapInArrow(run, _COUNTED)


def _distinct(of: np.ndarray, g: np.ndarray, o: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A place of each distinct (document, g, o), and how often it stands."""
    if not len(g):
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    # One hash of the three, of as many bits as the words' own.
    key = (g.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) ^ (o.view(np.uint64) + of.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    key = (key ^ (key >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    key ^= key >> np.uint64(27)
    order = np.argsort(key)
    key = key[order]
    begins = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    return order[begins], np.diff(np.append(begins, len(order)))


def _pairs(docs: DataFrame, hashes: np.ndarray, closed: bool, hot: int, scores: np.ndarray, unseen: np.ndarray) -> DataFrame:
    """Distinct pairs of each document by what they are shuffled by: ``g``, ``o`` and ``n``.

    A document's hot pairs are two rows: ``n``, their number, with ``o``, those unseen; and ``o``, their score in parts.
    """
    width = hot + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, ids, of in _slices(batches, hashes, closed):
            if not len(ids):
                continue
            same = of[:-1] == of[1:]
            u, v, j = ids[:-1][same], ids[1:][same], of[:-1][same]
            is_hot = _hot(u, v, hot)
            at, hj = u[is_hot] * width + v[is_hot], j[is_hot]
            n_docs = part.num_rows
            n_hot = np.bincount(hj, minlength=n_docs)
            with_hot = np.flatnonzero(n_hot)
            key = np.array([_hash(repr(x).encode()) & 0xFFFFFFFF for x in part.column(0).take(pa.array(with_hot)).to_pylist()], dtype=np.int64) + _DOCUMENT
            s = np.bincount(hj, weights=scores[at], minlength=n_docs)[with_hot]
            b = np.bincount(hj, weights=unseen[at], minlength=n_docs)[with_hot].astype(np.int64)
            s = np.round(s * _PARTS).astype(np.int64)

            usual = ~is_hot & (u >= 0) & (v >= 0)
            each, n_usual = np.unique((j[usual] << 32) | (u[usual] << 16) | v[usual], return_counts=True)
            rare_v, rare_u = v < 0, u < 0
            starts, ends = np.concatenate([[True], ~same]) & (ids < 0), np.concatenate([~same, [True]]) & (ids < 0)
            rj = np.concatenate([j[rare_v], j[rare_u], of[starts], of[ends]])
            g = np.concatenate([v[rare_v], u[rare_u] | _FIRST, ids[starts], ids[ends] | _FIRST])
            o = np.concatenate([u[rare_v], v[rare_u], np.full(starts.sum() + ends.sum(), _EDGE)])
            first, n_rare = _distinct(rj, g, o)

            docs_at = np.concatenate([with_hot, with_hot, each >> 32, rj[first]])
            yield pa.RecordBatch.from_arrays(
                [
                    part.column(0).take(pa.array(docs_at)),
                    pa.array(np.concatenate([key, key + (_SCORE - _DOCUMENT), each & 0xFFFFFFFF, g[first]])),
                    pa.array(np.concatenate([b, s, np.zeros(len(each), dtype=np.int64), o[first]])),
                    pa.array(np.concatenate([n_hot[with_hot], np.zeros(len(s), dtype=np.int64), n_usual, n_rare]).astype(np.int32)),
                ],
                names=["doc_id", "g", "o", "n"],
            )

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, g long, o long, n int")


def score(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", vocabulary: int | None = None, frequent: int = FREQUENT, hot: int = HOT) -> DataFrame:
    """One row per document: ``doc_id``, ``n_pairs``, ``n_backoff``, ``log_score``.

    ``vocabulary`` closes the vocabulary at that many words; ``frequent`` and ``hot`` change no score.
    """
    closed = vocabulary is not None
    if max(vocabulary or 0, frequent) > FREQUENT:
        raise ValueError(f"a closed vocabulary, and the table of frequent words, have {FREQUENT} words at most")
    ship_package(docs.sparkSession)
    spark = docs.sparkSession
    thin = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    names = [] if closed or not hot else _frequent_words(thin, min(hot, frequent))
    guessed = _hashes(names)
    counted = materialise(_counted(thin, names))
    counts = counted.filter(~F.col("_pair")).select(F.col("key").alias("word"), "n")
    total = counts.agg(F.sum("n")).first()[0] or 0
    top = _most_frequent(counts, vocabulary if closed else frequent)
    hashes, known = top["word"].to_numpy(), top["n"].to_numpy()
    if not closed:
        # Hot words first; one that the table of frequent words leaves out isn't hot.
        place = {int(h): k for k, h in enumerate(guessed)}
        rank = np.array([place.get(int(h), hot) for h in hashes], dtype=np.int64)
        order = np.argsort(rank, kind="stable")
        hashes, known, rank = hashes[order], known[order], rank[order]
        hot = int((rank < hot).sum())
    logs = np.log(np.maximum(np.concatenate([[total - known.sum()], known]), 1))
    backoff = float(np.log(BACKOFF) - np.log(max(total, 1)))

    # The pairs of hot words, all of them here.
    width = hot + 1
    usual = (_hot_counts(thin, hashes, closed, hot) if closed else counted.filter("_pair")).groupBy("key").agg(F.sum("n").alias("n"), F.min("first").alias("first"), F.max("last").alias("last")).toArrow()
    pair, n = (usual[c].to_numpy() for c in ("key", "n"))
    of_one = usual["first"].to_numpy() == usual["last"].to_numpy()
    if not closed:
        # From places among the guessed words to ids.
        ids = np.zeros(len(guessed) + 1, dtype=np.int64)
        ids[rank[:hot] + 1] = np.arange(1, hot + 1)
        u, v = ids[pair // len(ids)], ids[pair % len(ids)]
        keep = (u > 0) & (v > 0)
        pair, n, of_one = (u * width + v)[keep], n[keep], of_one[keep]
    scores, unseen = np.zeros(width * width), np.zeros(width * width)
    unseen[pair] = of_one
    scores[pair] = np.where(of_one, backoff + logs[pair % width], np.log(np.maximum(n, 1)) - logs[pair // width])

    # All others. Dealt by g, which also serves the window over (g, o).
    rows = _pairs(thin, hashes, closed, hot, scores, unseen).repartition("g")
    same, doc = Window.partitionBy("g", "o"), F.coalesce("doc_id", F.lit(_NO_ID))
    rows = rows.withColumn("_c", F.sum("n").over(same)).withColumn("_several", F.max(doc).over(same) > F.min(doc).over(same)).withColumn("_w", F.sum("n").over(Window.partitionBy("g")))
    g, o, zero = F.col("g"), F.col("o"), F.lit(0).cast("long")
    seen, rare = F.col("_several"), g < 0
    as_first = rare & (g.bitwiseAND(_FIRST) != 0)
    # Of a pair of two rare words only one of its two rows counts, and an edge never does.
    counts_here = ~rare | ((o != _EDGE) & ((o >= 0) | (seen == as_first)))
    by_window = rare & (seen == as_first)
    wanted = F.when(rare, o).when(seen, F.shiftright("g", 16)).otherwise(g.bitwiseAND(0xFFFF))
    rows = rows.withColumn("_seen", seen).withColumn("_here", counts_here).withColumn("_by_window", by_window)
    rows = rows.withColumn("_id", F.when(F.col("_here") & ~F.col("_by_window") & (g < _DOCUMENT), wanted))
    words = F.broadcast(spark.createDataFrame(list(enumerate(logs.tolist())), "_id long, _log double"))
    named = rows.join(words, "_id", "left")
    log_n = F.when(F.col("_by_window"), F.log("_w")).otherwise(F.col("_log"))
    each = F.when(F.col("_seen"), F.log("_c") - log_n).otherwise(F.lit(backoff) + log_n) * F.col("n")
    whole, in_parts = (g >= _DOCUMENT) & (g < _SCORE), g >= _SCORE
    sums = named.groupBy(F.col("doc_id").alias("_id")).agg(
        F.sum(F.when(in_parts, o / _PARTS).when(F.col("_here") & ~whole, each)).alias("_s"),
        F.sum(F.when(F.col("_here"), F.col("n")).otherwise(zero)).alias("_n"),
        F.sum(F.when(whole, o).when(F.col("_here") & ~in_parts & ~F.col("_seen"), F.col("n")).otherwise(zero)).alias("_b"),
    )
    joined = thin.select("doc_id").join(sums, F.col("doc_id").eqNullSafe(F.col("_id")), "left")
    return joined.select("doc_id", F.coalesce(F.when(F.col("_n") > 0, F.col("_n")), zero).alias("n_pairs"), F.coalesce("_b", zero).alias("n_backoff"), F.when(F.col("_n") > 0, F.col("_s") / F.col("_n")).alias("log_score"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents"))


ORACLE = None
