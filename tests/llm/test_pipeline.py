"""The pipeline's rows against a plain restatement of its five stages, and on awkward tables."""

import hashlib
import re

import sentencepiece

import corpus_pipeline as P
from rillway.llm import toxicity

SF = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
ITEM_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SHINGLE_WORD = re.compile(r"[^\x20\x09-\x0D]+")


def low(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def near(texts):
    """Groups of texts at 0.75 or more of their five-word shingles, by all pairs."""
    sets = {}
    for i, t in texts.items():
        w = SHINGLE_WORD.findall(low(t))
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(len(w) - 4, min(len(w), 1)))}
    group = {i: i for i in texts}
    ids = sorted(texts)
    for a in ids:
        for b in ids:
            both = len(sets[a] & sets[b])
            if a < b and both and 100 * both >= 75 * len(sets[a] | sets[b]) and group[a] != group[b]:
                lo, hi = sorted((group[a], group[b]))
                group = {i: lo if g == hi else g for i, g in group.items()}
    return group


def contaminated(text, items):
    words = ITEM_WORD.findall(low(text))
    hit = set()
    for window in items:
        for k in range(len(words) - len(window) + 1):
            if words[k : k + len(window)] == window:
                hit.update(range(k, k + len(window)))
    return bool(hit) and 20 * len(hit) >= len(words)


def windows(texts):
    for t in texts:
        w = ITEM_WORD.findall(low(t))
        yield from ([w[k : k + 13] for k in range(len(w) - 12)] if len(w) >= 13 else [w] if w else [])


def brute(spark, sf):
    """{doc_id: (number of ids, digest of the ids, digest of the decoded text)} of what stays."""
    rows = spark.read.parquet(f"{sf}/documents.parquet").collect()
    model = toxicity.fit(spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet"))
    kept = [r for r in rows if model.scores([r.text])[0] < 0.7]
    first = {}
    for r in kept:
        norm = re.sub(r"[\x20\x09-\x0D]+", " ", r.text or "")
        first[norm] = min(first.get(norm, (r.doc_id, r.text)), (r.doc_id, r.text), key=lambda x: x[0])
    texts = dict(first.values())
    group = near(texts)
    items = list(windows(r.text for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()))
    texts = {i: t for i, t in texts.items() if group[i] == i and not contaminated(t, items)}
    pieces = sentencepiece.SentencePieceProcessor(model_file="/opt/tokenizers/piece_bpe_32k.model")
    out = {}
    for i, t in texts.items():
        ids = pieces.encode(t or "")
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        out[i] = len(ids), sha(",".join(map(str, ids))), sha(pieces.decode(ids))
    return out, len(rows) - len(kept), len(group) - len({*group.values()})


def ran(spark, sf):
    return [(r.doc_id, (r.n_tokens, r.ids_sha256, r.decoded_sha256)) for r in P.run(spark, sf).collect()]


def planted(spark, to):
    """The smallest tables with copies, near copies, benchmark passages and awkward rows added."""
    docs = [tuple(r[c] for c in COLUMNS) for r in spark.read.parquet(f"{SF}/documents.parquet").select(COLUMNS).collect()]
    whole = [d for d in docs if d[1] and len(d[1].split()) > 40]
    bench = [r for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect() if r.text]
    more = []
    for d in whole[:4]:
        more += [d[1], d[1].replace(" ", " \n", 5), " ".join([*d[1].split()[:-1], "altered"]), "begun otherwise " + " ".join(d[1].split())]
    for b in bench[:4]:
        more += [b.text, f"prefix words {b.text} and a tail", " ".join(whole[5][1].split()[::-1]) + " " + " ".join(b.text.split()[:6])]
    more += [None, None, "", " \n", "one", "ONE", "two words", "▁ ▁x", "a b c d", "word " * 30_000]
    docs += [(10**6 + k, t, "en", "src", len(t or "")) for k, t in enumerate(more)]
    docs.append(docs[-1])  # one row twice
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars int").repartition(3).write.parquet(f"{to}/documents.parquet")
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{SF}/{name}.parquet").write.parquet(f"{to}/{name}.parquet")


def test_rows_are_those_of_the_plain_version(spark, tmp_path):
    planted(spark, tmp_path)
    want, n_toxic, n_near = brute(spark, str(tmp_path))
    got = ran(spark, str(tmp_path))
    assert dict(got) == want and len(got) == len(want)
    assert n_toxic > 0 and n_near >= 8


def test_stages_return_the_columns_of_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert [n for n, _ in P.STAGES][0] == "toxicity" and len(P.STAGES) == 5
    for name, stage in P.STAGES[:-1]:
        made = stage(spark, docs, SF)
        assert made.columns == docs.columns == COLUMNS, name


def test_empty_tables(spark, tmp_path):
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{SF}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert ran(spark, str(tmp_path)) == []
