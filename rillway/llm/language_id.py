"""Language identification by rank-order profiles.

A language's profile is the list of its ``TOP`` most frequent character n-grams of one to
three letters, a run of anything but letters counting as one blank. A document's own list is
compared with each profile by out-of-place distance: the sum, over its n-grams, of how far
their ranks differ, ``TOP`` for one that the profile lacks. The nearest profile wins; of
equally near ones the first in alphabetical order. The score is one minus the distance as a
share of its greatest possible value.

Profiles are learned from about ``ROWS_PER_LANG`` labelled documents of each language (a
share of its rows by hash, so the bound holds however many there are); every document is
read in full when it is classified.

Defined cases: a null text or one without letters gives ``und`` with score 0; a document
with a null label or a null id isn't learned from; without anything to learn from every
answer is ``und``; repeated rows get one answer each; other columns are left out; an empty
table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rillway.llm.common import ship_package, table
from rillway.llm.sentencepiece_codec import _id_type

TOP, ROWS_PER_LANG, BLANK, BITS = 300, 1500, 1, 21
_LETTERS: list[np.ndarray] = []


def _letters() -> np.ndarray:
    if not _LETTERS:
        _LETTERS.append(np.array([chr(i).isalpha() for i in range(0x110000)]))
    return _LETTERS[0]


def n_grams(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct packed n-grams of a text and their counts; none if it has no letter."""
    none = np.empty(0, np.int64), np.empty(0, np.int64)
    if not text:
        return none
    code = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.int64)
    letter = _letters()[code]
    if not letter.any():
        return none
    blank = np.concatenate([[BLANK], np.where(letter, code, BLANK), [BLANK]])
    keep = np.concatenate([[True], letter, [True]])
    keep[1:] |= keep[:-1]
    keep[1:] &= (blank[1:] != BLANK) | (blank[:-1] != BLANK)
    c = blank[keep]
    two = (c[:-1] << BITS) | c[1:]
    return np.unique(np.concatenate([c[c != BLANK], two, (two[:-1] << BITS) | c[2:]]), return_counts=True)


def ranked(grams: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The most frequent n-grams first; of equally frequent ones the smaller code."""
    if len(grams) > TOP:
        least = np.partition(counts, len(counts) - TOP)[len(counts) - TOP]
        few = counts >= least
        grams, counts = grams[few], counts[few]
    return grams[np.lexsort((grams, -counts))][:TOP]


class Profiles:
    def __init__(self, lists: dict[str, list[int]]):
        self.langs = sorted(lists)
        self.grams = np.array(sorted({g for x in lists.values() for g in x}), dtype=np.int64)
        self.ranks = np.full((len(self.langs), len(self.grams) + 1), -1, dtype=np.int64)
        for k, lang in enumerate(self.langs):
            self.ranks[k, np.searchsorted(self.grams, np.array(lists[lang], dtype=np.int64))] = np.arange(len(lists[lang]))

    def predict(self, text: str | None) -> tuple[str, float]:
        own = ranked(*n_grams(text))
        if not len(own) or not self.langs:
            return "und", 0.0
        at = np.searchsorted(self.grams, own)
        at[at < len(self.grams)] = np.where(self.grams[at[at < len(self.grams)]] == own[at < len(self.grams)], at[at < len(self.grams)], len(self.grams))
        there = self.ranks[:, at]
        apart = np.where(there < 0, TOP, np.minimum(np.abs(there - np.arange(len(own))), TOP)).sum(axis=1)
        best = int(np.argmin(apart))
        return self.langs[best], float(1 - apart[best] / (TOP * len(own)))


def held_out(doc_id: str = "doc_id"):
    """Whether the remainder is 2; a null id has none, so it isn't held out."""
    return (F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4).eqNullSafe(2)


def fit(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", rows_per_lang: int = ROWS_PER_LANG) -> Profiles:
    """Profiles from the labelled documents that are not held out."""
    ship_package(docs.sparkSession)
    seen = docs.select(F.col(doc_id).alias("_id"), F.col(text).cast("string").alias("_text"), F.col(lang).alias("_lang"))
    seen = seen.filter(F.col("_lang").isNotNull() & F.col("_id").isNotNull() & ~held_out("_id"))
    sizes = {r[0]: r[1] for r in seen.groupBy("_lang").count().toArrow().to_pylist() for r in [tuple(r.values())]}
    if not sizes:
        return Profiles({})
    whole = 1 << 20
    share = F.create_map(*[F.lit(x) for k, n in sizes.items() for x in (k, min(whole, -(-whole * rows_per_lang // n)))])
    sample = seen.filter(F.pmod(F.xxhash64("_id"), F.lit(whole)) < F.element_at(share, F.col("_lang")))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            by_lang: dict[str, list] = {}
            for value, name in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                by_lang.setdefault(name, []).append(n_grams(value))
            for name, found in by_lang.items():
                grams, place = np.unique(np.concatenate([g for g, _ in found]), return_inverse=True)
                n = np.bincount(place, np.concatenate([c for _, c in found]), minlength=len(grams)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(grams)), pa.array(grams), pa.array(n)], names=["lang", "gram", "n"])

    counts = sample.select("_text", "_lang").mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    first = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    top = counts.withColumn("rank", F.row_number().over(first)).filter(F.col("rank") <= TOP).toArrow().to_pylist()
    lists: dict[str, list[int]] = {}
    for r in sorted(top, key=lambda r: (r["lang"], r["rank"])):
        lists.setdefault(r["lang"], []).append(r["gram"])
    return Profiles(lists)


def predict(docs: DataFrame, profiles: Profiles, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: ``doc_id``, ``lang_pred``, ``score``."""
    ship_package(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [profiles.predict(x.as_py()) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())], names=["doc_id", "lang_pred", "score"])

    thin = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    return thin.mapInArrow(run, f"doc_id {_id_type(thin, 'doc_id')}, lang_pred string, score double")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return predict(docs, fit(docs)).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


ORACLE = None
