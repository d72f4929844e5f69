"""Registered queries over whole small tables: those with SQL against it, the others and the pipeline against plain Python."""

import hashlib
import os
from collections import Counter

import numpy as np
import pytest
from test_small_cases import WORD, base, brute_classes, fill

import corpus_pipeline
from ringloom.llm import mixing, pieces, queries, secrets

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")


@pytest.fixture(scope="module")
def duck():
    import duckdb

    c = duckdb.connect()
    for f in os.listdir(SF):
        c.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{SF}/{f}')")
    return c


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query(spark, duck, name):
    cur = duck.execute(queries.oracle_sql()[name])
    cols = [x[0] for x in cur.description]
    want = sorted(tuple(str(r[cols.index(k)]) for k in sorted(cols)) for r in cur.fetchall())
    df = queries.queries()[name](spark, SF)
    assert sorted(df.columns) == sorted(cols)
    assert sorted(tuple(str(r[k]) for k in sorted(cols)) for r in df.collect()) == want


@pytest.fixture(scope="module")
def documents(spark):
    return [r.asDict() for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


def encoded(sp, text):
    ids = sp.encode(text or "")
    return len(ids), digest(",".join(map(str, ids))), digest(sp.decode(ids))


@pytest.fixture(scope="module")
def sp():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=pieces.default_model())


def rows(spark, name, columns):
    return sorted(tuple(r) for r in queries.queries()[name](spark, SF).select(*columns).collect())


def test_op1(spark, documents, sp):
    want = sorted((d["doc_id"], *encoded(sp, d["text"])) for d in documents)
    assert rows(spark, "op1_sentencepiece", ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]) == want


def test_op6(spark, duck, documents):
    got = {r.doc_id: r for r in queries.queries()["op6_quality_classifier"](spark, SF).collect()}
    assert got.keys() == {d["doc_id"] for d in documents}
    told = [(got[i].predicted, q) for i, q in duck.execute("SELECT doc_id, quality FROM labels").fetchall() if got[i].held_out]
    assert sum(p == q for p, q in told) >= 0.85 * len(told)


def test_op8(spark, duck):
    table = duck.execute("SELECT vec_id, embedding, label FROM embeddings").fetchall()
    unit = {i: np.array(v, np.float64) / np.linalg.norm(np.array(v, np.float64)) for i, v, label in table if v is not None and label is not None and any(v)}
    label = {i: x for i, _, x in table}
    links = {i: {j for j in unit if j != i and label[i] == label[j] and unit[i] @ unit[j] >= 0.93} for i in unit}
    got = {r.vec_id: r for r in queries.queries()["op8_embedding_near_dedup"](spark, SF).collect()}
    assert got.keys() == label.keys()
    assert all(got[i].n_links <= len(links[i]) for i in unit)
    assert sum(r.n_links for r in got.values()) >= 0.9 * sum(map(len, links.values()))
    assert all(r.kept == (r.vec_id == r.component_id) for r in got.values())


def test_op9(spark, documents):
    got = {r.doc_id: r for r in queries.queries()["op9_secrets"](spark, SF).collect()}
    for d in documents:
        r, want = got[d["doc_id"]], base(d["text"])
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(k == kind for k, *_ in want) for kind in secrets.KINDS[:3])
        assert r.base_sha256 == digest(",".join(f"{k}:{s}:{e}" for k, s, e in want))
        assert r.n_live + r.n_example == len(want) + r.n_owned and [x for x in r.spans.split(",") if x and not x.startswith("owned")] == [f"{k}:{s}:{e}" for k, s, e in want]


def test_op10(spark, documents):
    want = sorted((i, n, c) for i, (n, c) in brute_classes([(d["doc_id"], d["text"]) for d in documents]).items())
    assert rows(spark, "op10_jaccard_join", ["doc_id", "n_shingles", "component_id"]) == want


def test_pipeline(spark, duck, documents, sp):
    """Each stage on what the one before it kept, and the whole."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    stage = dict(corpus_pipeline.STAGES)

    def applied(name, docs):
        out = stage[name](spark, docs, SF)
        assert out.columns == docs.columns
        return spark.createDataFrame(out.toPandas(), out.schema), out.schema.names

    # quality rules
    good = {i for i, kept in duck.execute(f"SELECT doc_id, kept FROM ({queries.oracle_sql()['op5_quality_rules']})").fetchall() if kept}
    docs, _ = applied("quality_rules", docs)
    now = {r.doc_id: r.asDict() for r in docs.collect()}
    assert now.keys() == good and all(now[d["doc_id"]] == d for d in documents if d["doc_id"] in good)
    # one of each group at five words and 0.8
    sets = {}
    for i, d in now.items():
        w = WORD.findall("".join(c.lower() if c.isascii() else c for c in d["text"]))
        sets[i] = {tuple(w[j : j + 5]) for j in range(len(w) - 4)}
    low = {i: i for i in sets}
    links = [(a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    for _ in sets:
        for a, b in links:
            low[a] = low[b] = min(low[a], low[b])
    docs, _ = applied("ngram_jaccard_join", docs)
    assert {r.doc_id: r.asDict() for r in docs.collect()} == {i: now[i] for i in low if low[i] == i}
    # secrets
    now = {i: now[i] for i in low if low[i] == i}
    owners = {}
    for d in now.values():
        for *_, secret in secrets.all_spans(d["text"]):
            owners.setdefault(secret, set()).add(d["source"])
    for d in now.values():
        spans = [(s, e) for k, s, e, secret in secrets.all_spans(d["text"]) if k < 3 or len(owners[secret]) == 1]
        d["text"] = secrets.without(d["text"], spans)
        d["n_chars"] = len(d["text"])
    docs, _ = applied("secret_scans", docs)
    assert {r.doc_id: r.asDict() for r in docs.collect()} == now
    # the mixture
    sizes = Counter()
    for d in now.values():
        sizes[d["source"]] += len(WORD.findall(d["text"]))
    target = fill(sizes)
    copies = {}
    for i, d in now.items():
        rate = target[d["source"]] / sizes[d["source"]]
        draw = int(hashlib.md5(f"{mixing.SEED}:{i}".encode()).hexdigest()[:13], 16) / 16**13
        copies[i] = int(rate) + (draw < rate - int(rate))
    docs, _ = applied("mixing", docs)
    assert Counter(r.doc_id for r in docs.collect()) == {i: n for i, n in copies.items() if n}
    # pieces
    want = sorted((i, *encoded(sp, now[i]["text"])) for i, n in copies.items() for _ in range(n))
    last = stage["sentencepiece"](spark, docs, SF)
    key = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    assert last.columns[:4] == key
    assert sorted(map(tuple, last.select(*key).collect())) == want
    assert sorted(map(tuple, corpus_pipeline.run(spark, SF).select(*key).collect())) == want
