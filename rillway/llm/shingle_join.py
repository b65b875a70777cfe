"""N-gram Jaccard join by universe partitioning and the pigeonhole principle.

A document is the set of its distinct five-word shingles; two link when
``100 * |A & B| >= 75 * |A | B|``. Then the two differ in at most
``H = (|A| + |B|) / 7`` tokens. In each size band the universe of tokens is hashed into
segments, 32 times as many as the band's largest set has tokens, and a set's tokens in a
segment are its content there; the two sets differ in at most ``H`` segments. A set is
indexed under a subset of its segments, and the cost-based allocation says which: contents
come in one global order, by how often a sample has their rarest token, so a passage that
many documents share is indexed only where a set has too little else, and the first ``H + 1``
of one set and of the other must share one that is equal in both. A set with fewer contents
than that adds empty segments, the last in the order. A segment that is indexed with its
one-deletion neighbourhood bears one difference more, for one entry more a token; that
pays only in the band of the smallest sets (``H <= 1``), where the whole set is one segment.
A set whose larger partners may be of the next band is indexed under that band's segments too.

An entry knows how many contents before it in the order are single tokens, ``q``, and how
many contents of its set are not, ``m``. What comes before two sets' first shared content
differs between them: they differ in at least ``q_A + q_B`` tokens (two single tokens in one
segment are two differences; any other two contents, at least one). Of A's single tokens
all but ``m_B`` are missing in B, so they differ in ``2 (q_A - m_B) + |B| - |A|`` at least, too.

Texts are cut into tokens once; the table that is written holds each set's digest, bitmap and
entries. Equal sets are one class, which takes part once. Contents of common tokens are
counted with map-side sums and joined, which adaptive execution can split; the others meet
by shuffle. In each entry's group the member with the fewest single tokens before it, which
is nearest to what the group shares, is compared with all others. Pairs are ruled out by
parity bitmaps, then verified by exact intersection. A member whose place leaves
no room for a difference from any other is done, and so is a group whose members
are one component. Of what is left the members outside the group's largest component are
compared with the others, 64, 1024, 16384, ... a round, until nothing is left; there the bitmaps
are part of the join's condition, so that a pair which they rule out is never a row. Nothing is
capped. Members of a group that are near one another, but not near enough to link, still have
each of their pairs' bitmaps compared: what the bounds cannot tell apart, they have to.

Defined cases: a null text, or one without words, has an empty set, links with nothing and
is its own component; fewer than five words are one shingle; ids are integers (they are cast
to long); a null id gets a null component; rows that share an id are one node that links
wherever one of its texts does; repeated rows get one result each; other columns are left
out; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rillway.llm.common import components, discard, materialise, only_rows, release_memory, ship_package, table, with_hot_keys_broadcast, without_rows

SHINGLE = 5
#: Least size of each band; the first is indexed with one-deletion neighbourhoods.
BANDS = [1, 7, 32, 128, 512, 4096, 32768, 262144, 2097152, 1 << 60]
SAMPLE_DOCS, MAX_COMMON, WORDS_HELD, TEXTS_AT_ONCE = 16_000, 200_000, 100_000, 128
#: Bytes of a row group of tables with long arrays: what a writer or reader of them holds.
ROW_GROUP = 4 << 20
#: From this level (power of two of the sampled documents) a content's group may be hot.
HOT_LEVEL = 2
#: Fixed value: where in an entry's packed place the single tokens before it begin; below are the contents that aren't single.
_SINGLES = 32
_U = np.uint64


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        import xxhash

        found = self[word] = xxhash.xxh3_64_intdigest(word)
        return found


_WORD_HASH = _Hashes()


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


#: Odd factors by a word's place in a shingle.
_FACTORS = _mix(np.arange(1, SHINGLE + 1, dtype=np.uint64)) | _U(1)


def token_sets(texts: list[str | None]) -> list[np.ndarray]:
    """For each text the sorted hashes of its distinct shingles."""
    lists = [t.encode("utf-8", "surrogatepass").lower().split() if t else [] for t in texts]
    size = np.array([len(w) for w in lists], dtype=np.int64)
    if len(_WORD_HASH) > WORDS_HELD:
        _WORD_HASH.clear()
    h = np.fromiter(map(_WORD_HASH.__getitem__, chain.from_iterable(lists)), dtype=np.uint64, count=int(size.sum()))
    whole = np.zeros(max(len(h) - SHINGLE + 1, 0), dtype=np.uint64)
    for k in range(SHINGLE if len(whole) else 0):
        whole += h[k : k + len(whole)] * _FACTORS[k]
    whole = _mix(whole)
    out, first = [], 0
    for n in size.tolist():
        if n >= SHINGLE:
            tokens = np.sort(whole[first : first + n - SHINGLE + 1])
            out.append(tokens[np.concatenate([[True], tokens[1:] != tokens[:-1]])])
        elif n:
            out.append(_mix((h[first : first + n] * _FACTORS[:n]).sum(dtype=np.uint64, keepdims=True) + _U(n)))
        else:
            out.append(np.empty(0, dtype=np.uint64))
        first += n
    return out


def sketch_of(tokens: np.ndarray) -> np.ndarray:
    """A parity bitmap of at least two bits a token: two sets' bitmaps differ in at most as many bits as the sets in tokens."""
    bits = max(64, 1 << (2 * len(tokens) - 1).bit_length())
    odd = (np.bincount((tokens & _U(bits - 1)).astype(np.int64), minlength=bits) & 1).astype(np.uint8)
    return np.packbits(odd, bitorder="little").view(np.int64)


def _bits_apart() -> str:
    """SQL for the differing bits of ``_ka`` and ``_kb``; the longer bitmap is folded onto the shorter one."""
    fold = lambda x: f"zip_with(slice({x}, 1, size({x}) div 2), slice({x}, size({x}) div 2 + 1, size({x}) div 2), (p, q) -> p ^ q)"
    count = lambda x, y: f"aggregate(zip_with({x}, {y}, (p, q) -> bit_count(p ^ q)), 0, (n, m) -> n + m)"
    return f"case when size(_ka) = size(_kb) then {count('_ka', '_kb')} when size(_ka) = 2 * size(_kb) then {count(fold('_ka'), '_kb')} when 2 * size(_ka) = size(_kb) then {count('_ka', fold('_kb'))} else 0 end"


def _set_key(tokens: np.ndarray) -> bytes:
    import hashlib

    return hashlib.blake2b(tokens.tobytes(), digest_size=16).digest() if len(tokens) else b""


def _allowed(size: np.ndarray, most: np.ndarray) -> np.ndarray:
    """Most tokens in which a set can differ from a partner that is at least as large and has at most ``most``."""
    return (size + np.minimum(most, size * 4 // 3)) // 7


def signatures(sets: list[np.ndarray], common: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Index entries of sets, the packed place of each, and how many each set has. ``common``: sorted tokens and the level of each.

    The lowest bit of an entry says whether its group may be hot; it depends on the content alone, and is set for neighbourhoods.
    """
    size = np.array([len(s) for s in sets], dtype=np.int64)
    edges = np.array(BANDS, dtype=np.int64)
    band = np.searchsorted(edges, size, side="right") - 1
    flat = np.concatenate(sets) if sets else np.empty(0, np.uint64)
    level = np.zeros(len(flat), dtype=np.int64)
    if len(common[0]):
        at = np.minimum(np.searchsorted(common[0], flat), len(common[0]) - 1)
        level = np.where(common[0][at] == flat, common[1][at], 0)
    mixed = _mix(flat ^ _U(0x51))
    begins = np.cumsum(size) - size
    out, owner, place = [], [], []

    def add(sig: np.ndarray, of: np.ndarray, singles: np.ndarray, multiple: np.ndarray, hot: np.ndarray) -> None:
        out.append((sig & ~_U(1)) | hot.astype(np.uint64))
        owner.append(of)
        place.append((singles << _SINGLES) | multiple)

    for k in np.flatnonzero((band == 0) & (size > 0)).tolist():
        here = slice(begins[k], begins[k] + size[k])
        whole = mixed[here].sum(dtype=np.uint64, keepdims=True)
        own = _mix((whole if size[k] < 4 else np.concatenate([whole, whole - mixed[here]])) ^ _U(0xD1))
        none = np.zeros(len(own), dtype=np.int64)
        add(own, none + k, none, none, none + 1)
    doc = np.repeat(np.arange(len(sets)), size)
    for step in (0, 1):
        scheme = np.minimum(band + step, len(BANDS) - 2)
        top = np.minimum(size * 4 // 3, edges[scheme + 1] - 1)
        part = (size > 0) & (scheme > 0) & (scheme == band + step) & (top >= edges[scheme])
        if not part.any():
            continue
        mine = part[doc]
        d, t, r, m = doc[mine], flat[mine], level[mine], mixed[mine]
        segments = np.minimum(32 * (edges[scheme + 1] - 1), 1 << 32).astype(np.uint64)
        marks = scheme.astype(np.uint64) << _U(56)
        # A segment is a range of hashes, so that sorted tokens lie by segment.
        seg = ((t >> _U(32)) * segments[d]) >> _U(32)
        start = np.flatnonzero(np.concatenate([[True], (d[1:] != d[:-1]) | (seg[1:] != seg[:-1])]))
        n_tokens = np.diff(np.append(start, len(d)))
        sig = _mix(np.add.reduceat(m, start) ^ _mix(seg[start] + marks[d[start]]))
        rare = np.minimum.reduceat(r, start)
        ds = d[start]
        # One order for all sets: level, then signature.
        order = np.argsort((ds.astype(np.uint64) << _U(57)) | (rare.astype(np.uint64) << _U(52)) | (sig >> _U(12)), kind="stable")
        ds, sig, rare, single = ds[order], sig[order], rare[order], (n_tokens[order] == 1).astype(np.int64)
        first = np.searchsorted(ds, np.arange(len(sets)))
        have = np.bincount(ds, minlength=len(sets))
        multiple = have - np.bincount(ds, single, minlength=len(sets)).astype(np.int64)
        need = _allowed(size, top) + 1
        at = np.arange(len(ds)) - first[ds]
        before = np.cumsum(single) - single
        before -= before[np.minimum(first, len(ds) - 1)][ds]
        keep = at < need[ds]
        add(sig[keep], ds[keep], before[keep], multiple[ds[keep]], rare[keep] >= HOT_LEVEL)
        for k in np.flatnonzero(part & (have < need)).tolist():
            used = ((flat[begins[k] : begins[k] + size[k]] >> _U(32)) * segments[k]) >> _U(32)
            more = int(need[k] - have[k])
            empty = np.setdiff1d(np.arange(size[k] + need[k], dtype=np.uint64), used)[:more]
            none = np.zeros(more, dtype=np.int64)
            add(_mix(_mix(empty + marks[k]) ^ _U(0xE5)), none + k, none + have[k] - multiple[k], none + multiple[k], none + 1)
    if not out:
        return np.empty(0, np.uint64), np.empty(0, np.int64), np.zeros(len(sets), np.int64)
    of = np.concatenate(owner)
    order = np.argsort(of, kind="stable")
    return np.concatenate(out)[order], np.concatenate(place)[order], np.bincount(of, minlength=len(sets))


def _long_ids(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.xxhash64(F.col(text)).alias("_text"), F.col(text).cast("string").alias("text"))


def _in_parts(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    for batch in batches:
        for k in range(0, batch.num_rows, TEXTS_AT_ONCE):
            part = batch.slice(k, TEXTS_AT_ONCE)
            yield part, token_sets(part.column(column).to_pylist())
        batch = part = None  # let go of before the next one comes
    _WORD_HASH.clear()
    release_memory()


def _lists(values: np.ndarray, counts: list[int] | np.ndarray) -> pa.ListArray:
    offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))


def _common_tokens(docs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Tokens that two or more of a sample of about ``SAMPLE_DOCS`` documents have, sorted, and the power of two
    of how many: it orders contents by cost, and any order gives the same links."""
    whole = 1 << 20
    share = min(whole, -(-whole * SAMPLE_DOCS // max(docs.count(), 1)))
    sample = docs.filter(F.pmod(F.xxhash64("doc_id"), F.lit(whole)) < share).select("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, found in _in_parts(batches, 0):
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found).view(np.int64))], names=["t"])

    counts = sample.mapInArrow(run, "t long").groupBy("t").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    top = counts.orderBy(F.desc("n"), "t").limit(MAX_COMMON).toArrow()
    tokens = np.ascontiguousarray(top["t"].to_numpy()).view(np.uint64)
    order = np.argsort(tokens)
    return tokens[order], np.log2(np.maximum(top["n"].to_numpy(), 1)).astype(np.int64)[order]


def _measured(rows: DataFrame, common: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """Of each row the set's size, digest, bitmap and entries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, found in _in_parts(batches, 2):
            sketches = [sketch_of(f) if len(f) else np.empty(0, np.int64) for f in found]
            sig, place, n = signatures(found, common)
            entries = pa.StructArray.from_arrays([pa.array(sig.view(np.int64)), pa.array(place)], names=["sig", "at"])
            offsets = np.concatenate([[0], np.cumsum(n)]).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [
                    part.column(0),
                    part.column(1),
                    pa.array([len(f) for f in found], pa.int64()),
                    pa.array([_set_key(f) for f in found], pa.binary()),
                    _lists(np.concatenate(sketches), [len(s) for s in sketches]),
                    pa.ListArray.from_arrays(pa.array(offsets), entries),
                ],
                names=["doc_id", "_text", "n_shingles", "_set", "_sketch", "_entries"],
            )

    return rows.mapInArrow(run, "doc_id long, _text long, n_shingles long, _set binary, _sketch array<long>, _entries array<struct<sig:long,at:long>>")


def _tokens(docs: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, found in _in_parts(batches, 1):
            yield pa.RecordBatch.from_arrays([part.column(0), _lists(np.concatenate(found).view(np.int64), [len(f) for f in found])], names=["node", "tokens"])

    return docs.select("doc_id", "text").mapInArrow(run, "node long, tokens array<long>")


def _verified(pairs: DataFrame, docs: DataFrame, sketches: DataFrame) -> DataFrame | None:
    """The pairs that link, or None. Pairs whose bitmaps differ in more bits than linked sets can differ
    in tokens go first; only the texts of documents in the others are read into token sets."""
    ka = sketches.select(F.col("node").alias("a"), F.col("_sketch").alias("_ka"), F.col("n_shingles").alias("_na"))
    kb = sketches.select(F.col("node").alias("b"), F.col("_sketch").alias("_kb"), F.col("n_shingles").alias("_nb"))
    near = pairs.join(ka, "a").join(kb, "b").filter(F.expr(f"7 * ({_bits_apart()}) <= _na + _nb"))
    near = materialise(near.select("a", "b").distinct())
    if not near.take(1):
        return None
    nodes = materialise(near.select(F.col("a").alias("doc_id")).unionByName(near.select(F.col("b").alias("doc_id"))).distinct())
    sets = materialise(_tokens(only_rows(docs, nodes, {"doc_id": F.col("doc_id")})), ROW_GROUP)
    a = sets.select(F.col("node").alias("a"), F.col("tokens").alias("_ta"))
    b = sets.select(F.col("node").alias("b"), F.col("tokens").alias("_tb"))
    both = F.size(F.array_intersect("_ta", "_tb"))
    tried = near.join(a, "a").join(b, "b").filter((both > 0) & (100 * both >= 75 * (F.size("_ta") + F.size("_tb") - both)))
    links = materialise(tried.select("a", "b").distinct())
    discard(near, nodes, sets)
    return links if links.take(1) else None


def _same_ids(members: DataFrame) -> DataFrame | None:
    """Links between the classes of rows that share an id, or None."""
    ids = members.groupBy("doc_id").agg(F.min("node").alias("a"), F.max("node").alias("_hi")).filter("a < _hi").select("doc_id", "a")
    links = materialise(members.select("doc_id", F.col("node").alias("b")).join(ids, "doc_id").filter("a < b").select("a", "b").distinct())
    return links if links.take(1) else None


def join(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: ``doc_id``, ``n_shingles``, ``component_id``, and ``_text``, the hash of its text."""
    ship_package(docs.sparkSession)
    rows = _long_ids(docs, doc_id, text)
    thin = materialise(_measured(rows, _common_tokens(rows)), ROW_GROUP)
    full = thin.filter("n_shingles > 0 and doc_id is not null")
    ids = full.select("doc_id", "_text", "n_shingles", "_set")
    classes = materialise(ids.groupBy("_set").agg(F.min("doc_id").alias("node"), F.count(F.lit(1)).alias("_size")))
    members = materialise(with_hot_keys_broadcast(ids, classes, "_set", "_size", ids.count()).select("doc_id", "_text", "n_shingles", "node"))
    copies = materialise(members.filter("doc_id <> node").select("doc_id", "_text").distinct())
    alone = without_rows(full.select("doc_id", "_text", "n_shingles", "_entries"), copies, {"doc_id": F.col("doc_id"), "_text": F.col("_text")})
    entries = alone.select(F.col("doc_id").alias("node"), F.col("n_shingles").alias("size"), F.inline("_entries"))
    is_hot = F.col("sig").bitwiseAND(1) == 1
    hot, cold = entries.filter(is_hot), entries.filter(~is_hot)
    several = hot.groupBy("sig").agg(F.min("node").alias("_lo"), F.max("node").alias("_hi")).filter("_lo < _hi").select("sig")
    same = Window.partitionBy("sig")
    met = cold.withColumn("_lo", F.min("node").over(same)).withColumn("_hi", F.max("node").over(same)).filter("_lo < _hi").drop("_lo", "_hi")
    met = materialise(met.unionByName(hot.join(several, "sig", "left_semi").select("node", "size", "sig", "at")))
    label = _link_all(met, rows, full.select(F.col("doc_id").alias("node"), "_sketch", "n_shingles"), _same_ids(members))
    if label is None:
        labels = members.withColumn("component_id", F.col("node"))
    else:
        found = members.join(label.withColumnRenamed("label", "_label"), "node", "left")
        labels = found.withColumn("component_id", F.coalesce("_label", "node"))
    rest = thin.filter("n_shingles = 0 or doc_id is null").select("doc_id", "_text", "n_shingles", F.col("doc_id").alias("component_id"))
    return labels.select("doc_id", "_text", "n_shingles", "component_id").unionByName(rest)


def _singles(at: str = "at") -> Column:
    return F.shiftright(at, _SINGLES)


def _multiple(at: str = "at") -> Column:
    return F.col(at).bitwiseAND((1 << _SINGLES) - 1)


def _may_link(size_a: str, at_a: str, size_b: str, at_b: str) -> Column:
    """Whether sets of these sizes that first share a content at these places can link."""
    a, b = F.col(size_a), F.col(size_b)
    of_a = 2 * (_singles(at_a) - _multiple(at_b)) + b - a
    of_b = 2 * (_singles(at_b) - _multiple(at_a)) + a - b
    return (4 * F.least(a, b) >= 3 * F.greatest(a, b)) & (7 * F.greatest(_singles(at_a) + _singles(at_b), of_a, of_b) <= a + b)


def _group(entries: DataFrame, *more: Column) -> DataFrame:
    """Of each entry's group what bounds any of its pairs."""
    return entries.groupBy("sig").agg(F.min(_singles()).alias("_least"), F.max(_multiple()).alias("_most"), F.min("size").alias("_smallest"), F.max("size").alias("_largest"), *more)


def _room() -> Column:
    """Whether a member can link with any of its group."""
    size = F.col("size")
    small, large = F.greatest("_smallest", F.ceil(3 * size / 4)), F.least("_largest", F.floor(4 * size / 3))
    own = 2 * (_singles() - F.col("_most")) + small - size
    return (small <= large) & (7 * (_singles() + F.col("_least")) <= size + large) & (7 * own <= size + small)


def _labelled(entries: DataFrame, label: DataFrame | None) -> DataFrame:
    if label is None:
        return entries.withColumn("label", F.col("node"))
    return entries.join(label.withColumnRenamed("label", "_found"), "node", "left").withColumn("label", F.coalesce("_found", "node")).drop("_found")


def _link_all(met: DataFrame, docs: DataFrame, sketches: DataFrame, links: DataFrame | None) -> DataFrame | None:
    """Each linked node's component. ``links``: what is linked already."""
    # First each member with the one of its group that has the fewest single tokens before it.
    key = F.shiftleft(_singles(), 24) + F.pmod(F.xxhash64("node"), F.lit(1 << 24))
    firsts = materialise(_group(met, F.min_by("node", key).alias("hub"), F.min_by("size", key).alias("hub_size"), F.min_by("at", key).alias("hub_at"), F.count(F.lit(1)).alias("_n")))
    grouped = met.join(firsts, "sig").filter(F.col("node") != F.col("hub"))
    pairs = materialise(grouped.filter(_may_link("hub_size", "hub_at", "size", "at")).select(F.col("hub").alias("a"), F.col("node").alias("b")).distinct())
    rest = materialise(grouped.filter((F.col("_n") > 2) & _room()).select("sig", "node", "size", "at"))
    tried, hubs = None, 64
    while True:
        got = _verified(pairs, docs, sketches)
        if got is not None:
            links = got if links is None else materialise(links.unionByName(got))
        label = None if links is None else components(links)
        open_ = materialise(_labelled(rest, label))
        main = open_.groupBy("sig", "label").agg(F.count(F.lit(1)).alias("n")).groupBy("sig").agg(F.max_by("label", "n").alias("_main"), F.count(F.lit(1)).alias("_parts"))
        live = materialise(open_.join(main.filter("_parts > 1"), "sig"))
        live = live.join(_group(live), "sig").filter(_room())
        # Those outside the largest component of the group, nearest to what it shares first.
        order = Window.partitionBy("sig").orderBy(_singles(), "node")
        live = live.select("sig", "node", "size", "at", "label", (F.col("label") == F.col("_main")).alias("_is_main"))
        live = materialise(live.join(sketches.select("node", F.col("n_shingles").alias("size"), "_sketch").distinct(), ["node", "size"]), ROW_GROUP)
        hub = materialise(live.filter(~F.col("_is_main")).withColumn("_k", F.row_number().over(order)).filter(F.col("_k") <= hubs).drop("_k", "_is_main"), ROW_GROUP)
        if not hub.take(1):
            return label
        h = hub.select(F.col("sig").alias("_sig"), F.col("node").alias("a"), F.col("size").alias("_sa"), F.col("at").alias("_aa"), F.col("label").alias("_la"), F.col("_sketch").alias("_ka"))
        near = F.expr(f"7 * ({_bits_apart()}) <= _sa + size")
        other = live.withColumnRenamed("_sketch", "_kb").join(h, (F.col("sig") == F.col("_sig")) & (F.col("label") != F.col("_la")) & _may_link("_sa", "_aa", "size", "at") & near)
        found = other.select(F.least("a", "node").alias("a"), F.greatest("a", "node").alias("b")).distinct()
        seen = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        tried = seen if tried is None else tried.unionByName(seen)
        pairs = materialise(found.join(tried, ["a", "b"], "left_anti"))
        rest = materialise(live.join(hub.select("sig", "node"), ["sig", "node"], "left_anti").select("sig", "node", "size", "at"))
        hubs *= 16


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, with one document of each component: that of the smallest id."""
    found = join(docs, doc_id, text)
    dropped = materialise(found.filter("component_id < doc_id").select("doc_id", "_text").distinct())
    return without_rows(docs, dropped.withColumnRenamed("doc_id", "_id"), {"_id": F.col(doc_id).cast("long"), "_text": F.xxhash64(F.col(text))})


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


ORACLE = r"""
WITH RECURSIVE doc AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
token AS (
  SELECT DISTINCT doc_id, array_to_string(w[i + 1 : i + n], ' ') AS t
  FROM (SELECT doc_id, w, least(len(w), 5) AS n, unnest(range(0, len(w) - least(len(w), 5) + 1)) AS i FROM doc WHERE len(w) > 0)),
size AS (SELECT doc_id, count(*) AS n FROM token GROUP BY doc_id),
link AS (
  SELECT a, b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS n_both FROM token x JOIN token y ON x.t = y.t AND x.doc_id <> y.doc_id GROUP BY ALL)
  JOIN size s ON s.doc_id = a JOIN size r ON r.doc_id = b WHERE 100 * n_both >= 75 * (s.n + r.n - n_both)),
reach(doc_id, other) AS (SELECT doc_id, doc_id FROM doc UNION SELECT r.doc_id, l.b FROM reach r JOIN link l ON l.a = r.other)
SELECT r.doc_id, coalesce(any_value(s.n), 0) AS n_shingles, min(other) AS component_id
FROM reach r LEFT JOIN size s ON s.doc_id = r.doc_id GROUP BY r.doc_id
"""
