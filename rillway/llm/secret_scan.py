"""Secret scans: candidates by pattern, false positives removed by a random forest.

The forest (see ``secret_forest``) looks at a candidate's length, the make-up and transitions
of its characters, how much of it is dictionary words, its path and the words on both sides of
it. All of this, the forest included, is SQL over a row's array of candidates: nothing is
shuffled, and a text without a candidate costs one pattern match a kind.

Defined cases: a null text has no candidate; very long texts are taken whole; a value that
stands several times in a row's text, or that two kinds match, counts once, with its highest
probability; repeated rows, and rows that share an id, get one result each; a null path counts
as empty; other columns are left out; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rillway.llm import secret_forest as forest
from rillway.llm.common import table

THRESHOLD, NEAR = 0.5, 40
#: Fixed value: no pattern matches fewer characters.
LEAST = 10


def _share(value: Column, chars: str, n: Column) -> Column:
    return F.length(F.regexp_replace(value, f"[^{chars}]", "")) / n


def _words_in(text: Column, words: list[str]) -> Column:
    total = F.lit(0.0)
    for w in words:
        total = total + F.when(F.contains(text, F.lit(w)), 1.0).otherwise(0.0)
    return total


def _features(value: Column, near: Column, path: Column) -> list[Column]:
    n = F.greatest(F.length(value), F.lit(1))
    low = F.lower(value)
    # Classes of characters, then the places where the class changes.
    classes = F.translate(value, "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz", "d" * 10 + "u" * 26 + "l" * 26)
    classes = F.regexp_replace(classes, "[^dul]", "o")
    runs = F.length(F.regexp_replace(classes, r"(.)\1*", "x"))
    covered = F.lit(0)
    for w in forest.DICTIONARY:
        covered = covered + F.when(F.contains(low, F.lit(w)), len(w)).otherwise(0)
    letters = F.regexp_replace(low, "[^a-z]", "")
    sounds = F.translate(letters, forest.VOWELS + forest.CONSONANTS, "v" * len(forest.VOWELS) + "c" * len(forest.CONSONANTS))
    turns = F.length(F.regexp_replace(sounds, r"(.)\1*", "x"))
    return [
        F.length(value).cast("double"),
        _share(value, "0-9", n),
        _share(value, "A-Z", n),
        _share(value, "a-z", n),
        F.length(F.regexp_replace(value, "[0-9A-Za-z]", "")) / n,
        F.greatest(runs - 1, F.lit(0)) / n,
        turns / F.greatest(F.length(letters), F.lit(1)),
        covered / n,
        F.size(F.array_distinct(F.filter(F.split(value, ""), lambda c: c != ""))) / n,
        F.when(value.rlike(forest.CODE), 1.0).otherwise(0.0),
        _words_in(F.lower(path), forest.PATH_AGAINST),
        _words_in(F.lower(near), forest.NEAR_FOR),
        _words_in(F.lower(near), forest.NEAR_AGAINST),
    ]


def _matches(text: Column, pattern: str) -> Column:
    """Every match of the bare ``pattern``: its group 1, and up to ``NEAR`` characters on each side of the match.

    The text between matches comes from ``split``, which finds the same matches. A match has
    ``LEAST`` characters or more, so ``NEAR`` of them reach over a fixed number of matches.
    """
    reach = -(-NEAR // LEAST)

    def of(x: Column) -> Column:
        between, whole = x["between"], x["whole"]

        def near(i: Column) -> Column:
            before = [F.when(i >= k, F.concat(F.get(between, i - k), F.get(whole, i - k))).otherwise("") for k in range(reach, 0, -1)]
            after = [F.coalesce(F.concat(F.get(whole, i + k), F.get(between, i + k + 1)), F.lit("")) for k in range(1, reach + 1)]
            left = F.right(F.concat(*before, F.get(between, i)), F.lit(NEAR))
            return F.concat(left, F.lit(" "), F.left(F.concat(F.get(between, i + 1), *after), F.lit(NEAR)))

        return F.transform(x["secret"], lambda v, i: F.struct(near(i).alias("near"), v.alias("secret")))

    # Bound as a variable, so that the text is searched once.
    found = F.struct(*[F.regexp_extract_all(text, F.lit(pattern), F.lit(g)).alias(name) for g, name in ((0, "whole"), (1, "secret"))], F.split(text, pattern, -1).alias("between"))
    return F.flatten(F.transform(F.array(found), of))


def _named(pairs: Column, kind: str) -> Column:
    return F.transform(pairs, lambda p: F.struct(F.lit(kind).alias("kind"), p["secret"].alias("secret"), p["near"].alias("near")))


def _scored(docs: DataFrame, doc_id: str, text: str, path: str | None) -> DataFrame:
    """``doc_id``, ``path`` and ``_c``, a text's candidates: an array of ``kind``, ``secret``, ``near`` and ``probability``."""
    where = F.coalesce(F.col(path).cast("string"), F.lit("")) if path else F.lit("")
    d = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("_t"), where.alias("path"))
    none = F.array().cast("array<struct<near:string,secret:string>>")
    t = F.col("_t")
    found = F.concat(*[_named(F.when(t.rlike(pattern), _matches(t, pattern)).otherwise(none), kind) for kind, pattern in forest.PATTERNS.items()])

    def with_features(c: Column) -> Column:
        values = _features(c["secret"], c["near"], F.col("path"))
        return F.struct(c.alias("c"), *[v.cast("double").alias(f"f{k}") for k, v in enumerate(values)])

    trees = forest.forest()
    votes = " + ".join(forest.as_sql(t, "x.f") for t in trees)
    shown = d.select("doc_id", "path", F.transform(found, with_features).alias("_c"))
    fields = "'kind', x.c.kind, 'secret', x.c.secret, 'near', x.c.near"
    return shown.select("doc_id", "path", F.expr(f"transform(_c, x -> named_struct({fields}, 'probability', ({votes}) / {len(trees)}))").alias("_c"))


def findings(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", path: str | None = "source") -> DataFrame:
    """One row per candidate: ``doc_id``, ``path``, ``kind``, ``secret``, ``near``, ``probability``."""
    each = _scored(docs, doc_id, text, path).select("doc_id", "path", F.explode_outer("_c").alias("_c"))
    return each.filter("_c is not null").select("doc_id", "path", "_c.*")


def scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", path: str | None = "source", threshold: float = THRESHOLD) -> DataFrame:
    """One row per row with a candidate: candidates, real secrets, best probability, digest of the secrets."""

    def summary(c: Column) -> Column:
        secrets = lambda x: F.array_distinct(F.transform(x, lambda y: y["secret"]))
        real = secrets(F.filter(c, lambda y: y["probability"] >= threshold))
        return F.struct(
            F.size(secrets(c)).cast("long").alias("n_candidates"),
            F.size(real).cast("long").alias("n_secrets"),
            F.array_max(F.transform(c, lambda y: y["probability"])).alias("best"),
            F.sha2(F.array_join(F.sort_array(real), ",").cast("binary"), 256).alias("secrets_sha256"),
        )

    # Bound as a variable, so that a text is searched once; no row where there is no candidate.
    found = F.transform(F.array("_c"), summary)
    some = F.filter(found, lambda s: s["n_candidates"] > 0)
    return _scored(docs, doc_id, text, path).select("doc_id", F.explode_outer(some).alias("_s")).filter("_s is not null").select("doc_id", "_s.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))


ORACLE = None
