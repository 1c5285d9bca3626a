"""Queries over retrieval, fusion and reranking."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodeweave.functions import exact, maths, text
from lodeweave.operators import decide, retrieve
from lodeweave.plans.frames import CATALOG, NORMALIZED, SIGNALS, TITLES, WORDS, catalog, query_signals, table, titles, with_, pool

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return register


DOC_TOKENS = f"posted AS (SELECT DISTINCT doc_id, unnest({WORDS.format('text')}) AS token FROM documents)"
ITEM_TOKENS = f"wanted AS (SELECT DISTINCT item_id AS query_id, unnest({WORDS.format('text')}) AS token FROM benchmark)"
IDF = "idf AS (SELECT token, ln(((SELECT count(*) FROM {n}) + 1) / (count(*) + 1)) + 1 AS idf FROM posted GROUP BY token)"


def ranked(source: str, k: int = 25, columns: str = "") -> str:
    return f"SELECT query_id, doc_id, score{columns}, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 10) DESC, doc_id) AS rank FROM {source} QUALIFY rank <= {k}"


@query(f"WITH {DOC_TOKENS} SELECT token, count(*) AS df FROM posted GROUP BY token")
def token_document_frequency(spark: SparkSession, sf: str) -> DataFrame:
    return retrieve.frequencies(retrieve.postings(table(spark, sf, "documents"), "doc_id", text.words(F.col("text"))))


@query(
    f"WITH {DOC_TOKENS}, {ITEM_TOKENS}, {IDF.format(n='documents')}, s AS (SELECT query_id, doc_id, sum(idf) AS score FROM wanted JOIN posted USING (token) JOIN idf USING (token) GROUP BY 1, 2), "
    f"t AS ({ranked('s')}) SELECT query_id, doc_id, round(score, 6) AS score, rank FROM t"
)
def sparse_topk(spark: SparkSession, sf: str) -> DataFrame:
    """The 25 best documents of each benchmark item by shared tokens."""
    d = table(spark, sf, "documents")
    posted = retrieve.postings(d, "doc_id", text.words(F.col("text")))
    wanted = table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), F.explode(text.words(F.col("text"))).alias("token"))
    found = retrieve.top(retrieve.sparse(wanted, posted, d.agg(F.count("*").alias("n"))))
    return found.select("query_id", "doc_id", F.round("score", 6).alias("score"), "rank")


@query(
    """WITH q AS (SELECT vec_id AS query_id, embedding AS qe FROM embeddings WHERE vec_id % 50 = 0),
s AS (SELECT query_id, vec_id AS doc_id, list_dot_product(qe::DOUBLE[], embedding::DOUBLE[]) / sqrt(list_dot_product(qe::DOUBLE[], qe::DOUBLE[]) * list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) AS score FROM q, embeddings),
t AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 10) DESC, doc_id) AS rank FROM s WHERE score > 0)
SELECT query_id, doc_id, round(score, 6) AS score, rank FROM t WHERE rank <= 25"""
)
def dense_cosine_topk(spark: SparkSession, sf: str) -> DataFrame:
    """Exact nearest vectors: every vector whose id is divisible by 50 is a query against all rows."""
    e = table(spark, sf, "embeddings")
    q = e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vec"))
    found = retrieve.dense(q, e.select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("vec")))
    return found.select("query_id", "doc_id", F.round("score", 6).alias("score"), "rank")


@query(
    """WITH q AS (SELECT vec_id AS query_id, embedding AS qe, label AS ql FROM embeddings WHERE vec_id % 50 = 0),
s AS (SELECT query_id, ql, label, vec_id AS doc_id, list_dot_product(qe::DOUBLE[], embedding::DOUBLE[]) / sqrt(list_dot_product(qe::DOUBLE[], qe::DOUBLE[]) * list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) AS score FROM q, embeddings),
t AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 10) DESC, doc_id) AS rank FROM s WHERE score > 0)
SELECT ql AS label, count(DISTINCT query_id) AS queries, count_if(rank <= 5 AND doc_id <> query_id AND ql = label) AS agree_at_5, count_if(doc_id <> query_id AND ql = label) AS agree_at_25 FROM t WHERE rank <= 25 GROUP BY ql"""
)
def label_agreement_at_k(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "embeddings")
    found = dense_cosine_topk(spark, sf)
    labels = e.select("vec_id", "label")
    j = found.join(labels.withColumnsRenamed({"vec_id": "query_id", "label": "ql"}), "query_id").join(labels.withColumnRenamed("vec_id", "doc_id"), "doc_id")
    same = (F.col("doc_id") != F.col("query_id")) & (F.col("ql") == F.col("label"))
    return j.groupBy(F.col("ql").alias("label")).agg(F.countDistinct("query_id").alias("queries"), F.count_if((F.col("rank") <= 5) & same).alias("agree_at_5"), F.count_if(same).alias("agree_at_25"))




def _check(same: str, both: str, weight: float) -> str:
    return f"CASE WHEN {both} AND {same} THEN {weight}::DOUBLE WHEN {both} THEN (-{weight} * 0.35)::DOUBLE ELSE 0.0::DOUBLE END"


def _case(same: str, both: str, name: str) -> str:
    return f"CASE WHEN {both} AND {same} THEN '{name}' END"


_PAIRS = [
    ("year", "year = release_year", "year IS NOT NULL AND release_year IS NOT NULL", 2.0),
    ("collector_number", "collector = collector_number", "collector IS NOT NULL AND collector_number IS NOT NULL", 5.0),
    ("series_position", f"{NORMALIZED.format('position_text')} = {NORMALIZED.format('series_position')}", "nullif(position_text, '') IS NOT NULL AND series_position IS NOT NULL", 3.0),
    ("color", f"list_contains(color_hints, {NORMALIZED.format('color')})", "len(color_hints) > 0 AND color IS NOT NULL", 2.0),
    ("series", f"list_contains(series_hints, {NORMALIZED.format('series')})", "len(series_hints) > 0 AND series IS NOT NULL", 2.0),
]
SCORE = " + ".join(_check(s, b, w) for _, s, b, w in _PAIRS)
MATCHES = "list_filter([" + ", ".join(_case(s, b, n) for n, s, b, _ in _PAIRS) + "], lambda x: x IS NOT NULL)"
CONFLICTS = "list_filter([" + ", ".join(_case(f"NOT ({s})", b, n) for n, s, b, _ in _PAIRS) + "], lambda x: x IS NOT NULL)"
SPARSE = f"""
posted AS (SELECT DISTINCT doc_id, unnest({WORDS.format('search_text')}) AS token FROM catalog),
wanted AS (SELECT DISTINCT query_id, unnest(tokens) AS token FROM signals),
{IDF.format(n='catalog')},
sparse AS ({ranked('(SELECT query_id, doc_id, sum(idf) AS score FROM wanted JOIN posted USING (token) JOIN idf USING (token) GROUP BY 1, 2)')})"""
STRUCTURED = f"structured AS ({ranked(f'(SELECT query_id, doc_id, {SCORE} AS score FROM signals, catalog WHERE {SCORE} > 0)')})"
_EMBEDDED = "list_concat(list_filter(string_split({0}, ' '), lambda x: x <> ''), list_transform(range(1, length({0}) - 1), lambda i: substr({0}, i, 3)))"


def _vectors(name: str, key: str, text_: str, source: str) -> str:
    """Signed feature hashing by MD5 to 192 dimensions, as rows (key, dimension, number), and each vector's length."""
    return (
        f"{name}f AS (SELECT {key}, md5(unnest({_EMBEDDED.format('t')})) AS h FROM (SELECT {key}, {text_} AS t FROM {source})), "
        f"{name}v AS (SELECT {key}, CAST('0x' || substr(h, 1, 8) AS BIGINT) % 192 AS d, sum(CASE WHEN CAST('0x' || substr(h, 9, 2) AS BIGINT) % 2 = 1 THEN 1 ELSE -1 END)::DOUBLE AS v FROM {name}f GROUP BY 1, 2), "
        f"{name}n AS (SELECT {key}, sqrt(sum(v * v)) AS norm FROM {name}v GROUP BY 1)"
    )


DENSE = (
    _vectors("dq", "query_id", "normalized_title", "signals")
    + ", "
    + _vectors("dd", "doc_id", NORMALIZED.format("search_text"), "catalog")
    + ", dots AS (SELECT query_id, doc_id, sum(q.v * d.v) AS dot FROM dqv q JOIN ddv d USING (d) GROUP BY 1, 2), "
    + f"dense AS ({ranked('(SELECT query_id, doc_id, dot / (dqn.norm * ddn.norm) AS score FROM dots JOIN dqn USING (query_id) JOIN ddn USING (doc_id) WHERE dot > 0)')})"
)
FUSED = """
listed AS (SELECT query_id, doc_id, rank, score, 'dense' AS source FROM dense UNION ALL SELECT query_id, doc_id, rank, score, 'sparse' FROM sparse UNION ALL SELECT query_id, doc_id, rank, score, 'structured' FROM structured),
merged AS (SELECT query_id, doc_id, max(rank) FILTER (source = 'dense') AS dense_rank, max(rank) FILTER (source = 'sparse') AS sparse_rank, max(rank) FILTER (source = 'structured') AS structured_rank, sum(1.0 / (60 + rank)) AS rrf_score FROM listed GROUP BY query_id, doc_id),
fused AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(rrf_score, 10) DESC, doc_id) AS rrf_rank FROM merged QUALIFY rrf_rank <= 25)"""
EVIDENCE = f"""
evidence AS (SELECT f.*, s.title, s.normalized_title, c.search_text, (sparse_rank IS NOT NULL)::INTEGER + (dense_rank IS NOT NULL)::INTEGER + (structured_rank IS NOT NULL)::INTEGER AS support, {MATCHES} AS matches, {CONFLICTS} AS conflicts
  FROM fused f JOIN signals s USING (query_id) JOIN catalog c USING (doc_id))"""
BASE = (CATALOG, TITLES, SIGNALS, SPARSE, STRUCTURED, DENSE, FUSED, EVIDENCE)


@query(with_(CATALOG, TITLES, SIGNALS, SPARSE) + " SELECT query_id, doc_id, round(score, 6) AS score, rank FROM sparse")
def catalog_sparse_topk(spark: SparkSession, sf: str) -> DataFrame:
    s, c = query_signals(spark, sf), catalog(spark, sf)
    posted = retrieve.postings(c, "doc_id", text.words(F.col("search_text")))
    found = retrieve.top(retrieve.sparse(s.select("query_id", F.explode("tokens").alias("token")), posted, c.agg(F.count("*").alias("n"))))
    return found.select("query_id", "doc_id", F.round("score", 6).alias("score"), "rank")


@query(with_(CATALOG, TITLES, SIGNALS, STRUCTURED) + " SELECT query_id, doc_id, round(score, 6) AS score, rank FROM structured")
def structured_evidence_topk(spark: SparkSession, sf: str) -> DataFrame:
    found = retrieve.top(retrieve.structured(query_signals(spark, sf), catalog(spark, sf)))
    return found.select("query_id", "doc_id", F.round("score", 6).alias("score"), "rank")


@query(with_(*BASE) + " SELECT query_id, doc_id, sparse_rank, dense_rank, structured_rank, round(rrf_score, 8) AS rrf_score, rrf_rank, array_to_string(matches, ',') AS matches, array_to_string(conflicts, ',') AS conflicts FROM evidence")
def rrf_fusion(spark: SparkSession, sf: str) -> DataFrame:
    found = pool(spark, sf)
    return found.select("query_id", "doc_id", "sparse_rank", "dense_rank", "structured_rank", F.round("rrf_score", 8).alias("rrf_score"), "rrf_rank", F.array_join("matches", ",").alias("matches"), F.array_join("conflicts", ",").alias("conflicts"))


@query(
    with_(CATALOG, TITLES, SIGNALS, SPARSE, STRUCTURED)
    + ", m AS (SELECT query_id, doc_id, coalesce(1.5 / (60 + s.rank), 0) + coalesce(0.5 / (60 + t.rank), 0) AS score FROM sparse s FULL JOIN structured t USING (query_id, doc_id)), "
    f"t AS ({ranked('m', 10)}) SELECT query_id, doc_id, round(score, 8) AS score, rank FROM t"
)
def weighted_rrf(spark: SparkSession, sf: str) -> DataFrame:
    s, c = query_signals(spark, sf), catalog(spark, sf)
    posted = retrieve.postings(c, "doc_id", text.words(F.col("search_text")))
    sparse = retrieve.top(retrieve.sparse(s.select("query_id", F.explode("tokens").alias("token")), posted, c.agg(F.count("*").alias("n"))))
    fused = retrieve.fuse({"sparse": sparse, "structured": retrieve.top(retrieve.structured(s, c))}, limit=10, weights={"sparse": 1.5, "structured": 0.5})
    return fused.select("query_id", "doc_id", F.round("rrf_score", 8).alias("score"), F.col("rrf_rank").alias("rank"))


_FORMS = f"""
names AS (SELECT DISTINCT {NORMALIZED.format('casting')} AS core FROM catalog),
dforms AS (SELECT core AS owner, 'spaced' AS mode, core AS text FROM names UNION SELECT core, 'compact', replace(core, ' ', '') FROM names),
words AS (SELECT query_id, list_filter({WORDS.format('title')}, lambda x: NOT regexp_matches(x, '^[0-9]+$')) AS t FROM titles),
win AS (SELECT DISTINCT query_id, array_to_string(t[p:p + size - 1], ' ') AS core FROM words, range(1, 4) s(size), range(1, 40) r(p) WHERE p + size - 1 <= len(t)),
qforms AS (SELECT query_id AS owner, 'spaced' AS mode, core AS text FROM win UNION SELECT query_id, 'compact', replace(core, ' ', '') FROM win),
dgrams AS (SELECT owner, mode, text, unnest(list_concat(list_transform(range(1, length(text)), lambda i: substr(text, i, 2)), list_transform(range(1, length(text) - 1), lambda i: substr(text, i, 3)))) AS gram FROM dforms),
qgrams AS (SELECT owner, mode, text, unnest(list_concat(list_transform(range(1, length(text)), lambda i: substr(text, i, 2)), list_transform(range(1, length(text) - 1), lambda i: substr(text, i, 3)))) AS gram FROM qforms),
gidf AS (SELECT mode, gram, ln(((SELECT count(*) FROM names) + 1) / (count(DISTINCT owner) + 1)) + 1 AS idf FROM dgrams GROUP BY mode, gram),
dw AS (SELECT owner, mode, text, gram, count(*) * any_value(idf) AS w FROM dgrams JOIN gidf USING (mode, gram) GROUP BY owner, mode, text, gram),
dn AS (SELECT *, w / sqrt(sum(w * w) OVER (PARTITION BY owner, mode, text)) AS u FROM dw)"""


def _cosine_sql(join: str, weight: str) -> str:
    return (
        _FORMS
        + f""",
qw AS (SELECT owner, mode, text, gram, count(*) * any_value({weight}) AS w FROM qgrams {join} gidf USING (mode, gram) GROUP BY owner, mode, text, gram),
qn AS (SELECT *, w / sqrt(sum(w * w) OVER (PARTITION BY owner, mode, text)) AS u FROM qw),
dots AS (SELECT q.owner AS query_id, q.text AS qt, mode, d.owner AS doc_id, d.text AS dt, sum(q.u * d.u) AS s FROM qn q JOIN dn d USING (mode, gram) GROUP BY ALL),
best AS (SELECT query_id, doc_id, max(s) AS score FROM dots GROUP BY 1, 2 HAVING round(max(s), 10) >= 0.5)"""
    )


def _forms(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    names = catalog(spark, sf).select(text.normalize(F.col("casting")).alias("core")).distinct()
    docs = retrieve.forms_of(names, "core", F.col("core"))
    words = titles(spark, sf).select("query_id", F.filter(text.words(F.col("title")), lambda x: ~x.rlike("^[0-9]+$")).alias("t"))
    win = words.select("query_id", F.explode(F.concat(*[text.windows(F.col("t"), n) for n in (1, 2, 3)])).alias("core")).distinct()
    return retrieve.forms_of(win, "query_id", F.col("core")), docs


@query(with_(CATALOG, TITLES, _cosine_sql("JOIN", "idf")) + f", t AS ({ranked('best')}) SELECT query_id, doc_id, round(score, 6) AS score, rank FROM t")
def char_tfidf_topk(spark: SparkSession, sf: str) -> DataFrame:
    """Character n-gram cosine of title windows and castings; grams that no casting has are dropped."""
    q, d = _forms(spark, sf)
    return retrieve.top(retrieve.posting_cosine(q, d, 0.5, keep_unknown=False)).select("query_id", "doc_id", F.round("score", 6).alias("score"), "rank")


@query(with_(CATALOG, TITLES, _cosine_sql("LEFT JOIN", "coalesce(idf, ln((SELECT count(*) FROM names) + 1) + 1)")) + f", t AS ({ranked('best')}) SELECT query_id, doc_id, round(score, 6) AS score, rank FROM t")
def posting_cosine_topk(spark: SparkSession, sf: str) -> DataFrame:
    """The same with unknown grams in the query's length."""
    q, d = _forms(spark, sf)
    return retrieve.top(retrieve.posting_cosine(q, d, 0.5)).select("query_id", "doc_id", F.round("score", 6).alias("score"), "rank")


@query(
    with_(CATALOG, TITLES)
    + f""", forms AS (SELECT DISTINCT {NORMALIZED.format('casting')} AS doc_id, unnest({WORDS.format('casting')}) AS token FROM catalog),
n AS (SELECT count(DISTINCT doc_id) AS n FROM forms), idf AS (SELECT token, ln((any_value(n) + 1) / (count(*) + 1)) + 1 AS idf FROM forms, n GROUP BY token),
sizes AS (SELECT doc_id, count(*) AS need FROM forms GROUP BY 1), w AS (SELECT DISTINCT query_id, unnest({WORDS.format('title')}) AS token FROM titles)
SELECT query_id, doc_id, round(sum(idf), 6) AS score FROM w JOIN forms USING (token) JOIN idf USING (token) JOIN sizes USING (doc_id) GROUP BY query_id, doc_id, need HAVING count(*) = need"""
)
def containment_scores(spark: SparkSession, sf: str) -> DataFrame:
    """Castings all of whose tokens stand in a title."""
    forms = catalog(spark, sf).select(text.normalize(F.col("casting")).alias("doc_id")).distinct().withColumn("tokens", F.split("doc_id", " ")).withColumn("form_id", F.col("doc_id"))
    posted = forms.select("doc_id", F.explode(F.array_distinct("tokens")).alias("token"))
    idf = retrieve.frequencies(posted).crossJoin(F.broadcast(forms.agg(F.count("*").alias("n")))).select("token", maths.idf(F.col("n"), F.col("df")).alias("idf"))
    wanted = titles(spark, sf).select("query_id", F.explode(text.words(F.col("title"))).alias("token"))
    return retrieve.containment(wanted, forms, idf).select("query_id", "doc_id", F.round("score", 6).alias("score"))


_HEURISTIC = f"len(list_intersect({WORDS.format('normalized_title')}, {WORDS.format('search_text')}))::DOUBLE / len(list_distinct(list_concat({WORDS.format('normalized_title')}, {WORDS.format('search_text')}))) + 0.18 * (support / 3.0) + 0.10 * len(matches) - 0.12 * len(conflicts)"
RERANKED = f"reranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(reranker_score, 10) DESC, round(rrf_score, 10) DESC, doc_id) AS reranker_rank FROM (SELECT *, {_HEURISTIC} AS reranker_score FROM evidence))"


def reranked(spark: SparkSession, sf: str) -> DataFrame:
    found = pool(spark, sf)
    return decide.rerank(found, decide.heuristic_score(F.col("normalized_title"), F.col("search_text")))


@query(with_(*BASE, RERANKED) + " SELECT query_id, doc_id, round(reranker_score, 6) AS reranker_score, reranker_rank, rrf_rank FROM reranked")
def heuristic_rerank(spark: SparkSession, sf: str) -> DataFrame:
    return reranked(spark, sf).select("query_id", "doc_id", F.round("reranker_score", 6).alias("reranker_score"), "reranker_rank", "rrf_rank")


_COVERAGE = f"len(list_intersect({WORDS.format('normalized_title')}, {WORDS.format('search_text')}))::DOUBLE / len(list_distinct({WORDS.format('normalized_title')}))"


@query(
    with_(*BASE)
    + f", c AS (SELECT query_id, doc_id, rrf_score, {_COVERAGE} AS coverage FROM evidence), s AS (SELECT query_id, doc_id, rrf_score / (1 + 2.0 * (1 - coverage)) AS score, coverage FROM c), t AS ({ranked('s', 25, ', coverage')}) "
    "SELECT query_id, doc_id, round(score, 8) AS score, round(coverage, 6) AS coverage, rank, rank = 1 OR coverage + 1e-12 >= 0.5 AS admitted FROM t"
)
def coverage_rerank(spark: SparkSession, sf: str) -> DataFrame:
    """Fused scores penalised for what a document doesn't cover; rank 1 and well covered ones are admitted."""
    found = pool(spark, sf)
    a, b = F.array_distinct(text.words(F.col("normalized_title"))), text.words(F.col("search_text"))
    s = found.withColumn("coverage", F.size(F.array_intersect(a, b)) / F.size(a)).withColumn("score", decide.coverage_penalty(2.0))
    t = retrieve.top(s)
    return t.select("query_id", "doc_id", F.round("score", 8).alias("score"), F.round("coverage", 6).alias("coverage"), "rank", ((F.col("rank") == 1) | (F.col("coverage") + 1e-12 >= 0.5)).alias("admitted"))


def _features_sql() -> str:
    out = ["round(reranker_score, 6) AS logit", "round(rrf_score, 8) AS rrf_score", "round(1.0 / rrf_rank, 6) AS rrf_inverse"]
    out += [f"({n}_rank IS NOT NULL)::INTEGER::DOUBLE AS in_{n}" for n in decide.SOURCES] + [f"round(coalesce(1.0 / {n}_rank, 0), 6) AS {n}_inverse" for n in decide.SOURCES]
    out += [f"list_contains({kind}, '{n}')::INTEGER::DOUBLE AS {n}_{kind}" for kind in ("matches", "conflicts") for n in decide.STRUCTURED]
    return ", ".join(out + ["round(len(matches) / 5.0, 6) AS matched", "round(len(conflicts) / 5.0, 6) AS conflicting"])


@query(with_(*BASE, RERANKED) + f", t AS (SELECT r.*, x.expected_id FROM reranked r JOIN titles x USING (query_id)) SELECT query_id, doc_id, {_features_sql()}, coalesce(doc_id = expected_id, FALSE) AS target FROM t")
def ltr_feature_vector(spark: SparkSession, sf: str) -> DataFrame:
    """The 21 features of each candidate, the heuristic score standing in for a model's logit."""
    t = reranked(spark, sf).join(titles(spark, sf).select("query_id", "expected_id"), "query_id")
    target = F.coalesce(F.col("doc_id") == F.col("expected_id"), F.lit(False)).alias("target")
    return t.select("query_id", "doc_id", *[F.round(c, 8 if n == "rrf_score" else 6).alias(n) for n, c in decide.feature_vector(F.col("reranker_score")).items()], target)


@query(
    with_(*BASE)
    + ", t AS (SELECT e.*, x.expected_id FROM evidence e JOIN titles x USING (query_id)), p AS (SELECT query_id, doc_id, rrf_rank, conflicts FROM t WHERE expected_id IS NOT NULL AND doc_id <> expected_id AND len(conflicts) >= 1), "
    "k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY len(conflicts), rrf_rank, doc_id) AS pick FROM p) SELECT query_id, doc_id, pick, array_to_string(conflicts, ',') AS conflicts FROM k WHERE pick <= 5"
)
def hard_negative_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """Up to five wrong candidates of each answerable title that differ in at least one stated field, the nearest first."""
    t = pool(spark, sf).join(titles(spark, sf).select("query_id", "expected_id"), "query_id")
    p = t.where((F.col("doc_id") != F.col("expected_id")) & (F.size("conflicts") >= 1))
    pick = F.row_number().over(Window.partitionBy("query_id").orderBy(F.size("conflicts"), "rrf_rank", "doc_id"))
    return p.withColumn("pick", pick).where("pick <= 5").select("query_id", "doc_id", "pick", F.array_join("conflicts", ",").alias("conflicts"))


@query(
    with_(*BASE, RERANKED)
    + ", t AS (SELECT r.*, x.expected_id FROM reranked r JOIN titles x USING (query_id)), pos AS (SELECT query_id, reranker_score AS p FROM t WHERE doc_id = expected_id), "
    "neg AS (SELECT query_id, reranker_score AS n FROM t WHERE doc_id <> expected_id) SELECT query_id, count(*) AS pairs, round(avg(ln(1 + exp(-(p - n)))), 6) AS loss, count_if(p > n) AS won FROM pos JOIN neg USING (query_id) GROUP BY query_id"
)
def ranknet_loss(spark: SparkSession, sf: str) -> DataFrame:
    t = reranked(spark, sf).join(titles(spark, sf).select("query_id", "expected_id"), "query_id")
    pos = t.where("doc_id = expected_id").select("query_id", F.col("reranker_score").alias("p"))
    neg = t.where("doc_id <> expected_id").select("query_id", F.col("reranker_score").alias("n"))
    gap = F.col("p") - F.col("n")
    return pos.join(neg, "query_id").groupBy("query_id").agg(F.count("*").alias("pairs"), F.round(F.avg(F.log1p(F.exp(-gap))), 6).alias("loss"), F.count_if(F.round(gap, 10) > 0).alias("won"))


@query(with_(CATALOG, TITLES, SIGNALS, DENSE) + " SELECT query_id, doc_id, round(score, 6) AS score, rank FROM dense")
def hashing_dense_topk(spark: SparkSession, sf: str) -> DataFrame:
    """Nearest catalogue rows by the hashed embedding."""
    q = query_signals(spark, sf).select("query_id", exact.embed_md5("normalized_title").alias("vec"))
    found = retrieve.dense(q, retrieve.spread(catalog(spark, sf)).select("doc_id", exact.embed_md5("search_text").alias("vec")))
    return found.select("query_id", "doc_id", F.round("score", 6).alias("score"), "rank")


@query()
def pair_scorer_hook(spark: SparkSession, sf: str) -> DataFrame:
    """Fused candidates scored in batches by an injected scorer; here similarity of the texts."""
    found = pool(spark, sf)
    scored = found.withColumn("score", exact.ratio("normalized_title", "search_text"))
    return retrieve.top(scored, 5).select("query_id", "doc_id", F.round("score", 6).alias("score"), "rank")
