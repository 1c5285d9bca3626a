"""The pipeline: each stage on what its predecessor kept, and the registered queries."""

from __future__ import annotations

import duckdb

import corpus_pipeline
from lodeweave.llm import catalogue

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, before = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
        assert name == corpus_pipeline.STAGES[-1][0] or docs.columns == columns
        now = docs.count()
        assert 0 < now <= before
        before = now


def test_odd_rows_pass_the_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    odd = spark.createDataFrame([(None, None, None, None, None), (10**9, "", "en", "s", 0), (10**9 + 1, "lone words only", None, None, 1), (10**9 + 1, "lone words only", None, None, 1)], docs.schema)
    docs = docs.unionByName(odd)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF)
    assert docs.where(f"doc_id >= {10**9}").count() == 1 and docs.where("text is null or text = ''").count() == 0


def test_run_equals_plain_python(spark):
    """The whole run against each stage done plainly: languages by the stage itself, then dictionaries, sets and tiktoken."""
    import hashlib

    import public_tokenizers
    import tiktoken

    from lodeweave.llm import bpe, decontaminate, langid
    from tests.llm.test_operators import LOWER, linked, shingles

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in langid.identified(docs, langid.trained(docs)).collect()]
    assert {i for i, _ in rows} == {r.doc_id for r in docs.collect() if any(c.isalpha() for c in r.text or "")}
    best = {}
    for i, t in rows:
        key = t.translate(LOWER)
        best[key] = max(best.get(key, (-1, "")), (i, t))
    rows = sorted(best.values())
    rows = [(i, t) for (i, t), (_, n, c) in zip(rows, sorted(linked(rows, 5, 80)), strict=True) if c == i or not shingles(t, 5)]
    vocabulary = decontaminate._Vocabulary()
    index = decontaminate.Index([(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()])
    rows = [(i, t) for i, t in rows if not index.matches(decontaminate.template(t, vocabulary))]
    ranks = bpe.load_ranks(bpe.read_vocabulary(public_tokenizers.path("byte_bpe_multi_50k.tiktoken")).splitlines())
    coder = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = {i: (len(ids), hashlib.sha256(b"".join(x.to_bytes(4, "little") for x in ids)).hexdigest()) for i, t in rows for ids in [coder.encode_ordinary(t)]}
    got = {r.doc_id: (r.n_tokens, r.ids_sha256) for r in corpus_pipeline.run(spark, SF).collect()}
    assert got == want


def test_queries_with_sql(spark):
    c = duckdb.connect()
    for t in ("documents", "pages", "benchmark"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    for name, sql in catalogue.oracle_sql().items():
        df = catalogue.queries()[name](spark, SF)
        names = sorted(df.columns)
        want = c.execute(f"SELECT {', '.join(names)} FROM ({sql})").fetchall()
        assert sorted(map(repr, (tuple(r[n] for n in names) for r in df.collect()))) == sorted(map(repr, want)), name


def test_registered(spark):
    names = catalogue.queries()
    assert {n.split("_")[0] for n in names if n.startswith("op")} == {f"op{i}" for i in range(1, 11)} and "pipeline" in names
    for name in ("op1_ngram_join", "op2_suffix_dedup", "op3_secrets", "op5_sharding", "op6_decontaminate", "op7_langid", "op9_bpe", "op10_html"):
        assert names[name](spark, SF).count() > 0, name
