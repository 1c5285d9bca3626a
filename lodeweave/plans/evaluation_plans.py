"""Queries over cases and their results: scoring, grids, packs, evidence and merges of several retrievers.

The cases are the titles by template: some want their record, some their family and not the next record, some only
not the next record, and the sixth template nothing at all.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodeweave.functions import exact, maths, text
from lodeweave.operators import evaluate, measure, retrieve
from lodeweave.plans.decision_plans import DECIDED, FEATURES
from lodeweave.plans.frames import CATALOG, NORMALIZED, TITLES, WORDS, catalog, pool, query_signals, table, titles, with_
from lodeweave.plans.retrieval_plans import _EMBEDDED, BASE, RERANKED, _cosine_sql, _forms, ranked, reranked

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return register


CASES = """
cases AS (SELECT query_id AS case_id, CASE template WHEN 2 THEN 'merge' WHEN 3 THEN 'hold' WHEN 5 THEN 'unrelated' ELSE 'positive' END AS kind, CASE WHEN template = 1 THEN 'lexical' ELSE 'noise' END AS style,
  casting AS family, doc_id AS expected_id, casting AS expected_family, printf('%08d', CAST(doc_id AS INTEGER) + 1) AS forbidden_id, title AS query FROM titles JOIN catalog ON 'q' || doc_id = query_id)"""


def cases(spark: SparkSession, sf: str) -> DataFrame:
    """case_id, kind, style, family, expected_id, expected_family, forbidden_id, query."""
    t = titles(spark, sf).join(catalog(spark, sf).select(F.concat(F.lit("q"), "doc_id").alias("query_id"), "doc_id", "casting"), "query_id")
    kind = F.when(F.col("template") == 2, "merge").when(F.col("template") == 3, "hold").when(F.col("template") == 5, "unrelated").otherwise("positive")
    return t.select(
        F.col("query_id").alias("case_id"),
        kind.alias("kind"),
        F.when(F.col("template") == 1, "lexical").otherwise("noise").alias("style"),
        F.col("casting").alias("family"),
        F.col("doc_id").alias("expected_id"),
        F.col("casting").alias("expected_family"),
        F.format_string("%08d", F.col("doc_id").cast("int") + 1).alias("forbidden_id"),
        F.col("title").alias("query"),
    )


RESULTS = "results AS (SELECT query_id AS case_id, reranker_rank AS rank, doc_id, c.casting AS family FROM reranked JOIN catalog c USING (doc_id))"
OUTCOMES = """
joined AS (SELECT c.*, r.rank, r.doc_id, r.family AS got FROM cases c LEFT JOIN (SELECT * FROM results WHERE rank <= 5) r USING (case_id)),
outcomes0 AS (SELECT case_id, any_value(kind) AS kind, any_value(style) AS style, any_value(family) AS family,
  min(CASE WHEN (kind = 'positive' AND doc_id = expected_id) OR (kind = 'merge' AND got = expected_family) THEN rank END) AS target_rank,
  count_if(kind IN ('merge', 'hold') AND doc_id = forbidden_id) AS forbidden_hits, count(doc_id) AS returned FROM joined GROUP BY case_id),
outcomes AS (SELECT *, list_filter([CASE WHEN kind = 'positive' AND target_rank IS NULL THEN 'target_missed' WHEN kind = 'merge' AND target_rank IS NULL THEN 'merge_missed' END,
  CASE WHEN forbidden_hits > 0 THEN 'forbidden_returned' END, CASE WHEN kind = 'unrelated' AND returned > 0 THEN 'unrelated_nonempty' END], lambda x: x IS NOT NULL) AS violations FROM outcomes0)"""
_COUNTS = (
    "count_if(kind = 'positive') AS positive_total, count_if(kind = 'positive' AND target_rank = 1) AS hits_at_1, count_if(kind = 'positive' AND target_rank IS NOT NULL) AS hits_at_k, "
    "round(coalesce(sum(CASE WHEN kind = 'positive' THEN 1.0 / target_rank END), 0), 6) AS reciprocal_rank_sum, count(DISTINCT CASE WHEN kind = 'positive' THEN family END) AS families, "
    "count(DISTINCT CASE WHEN kind = 'positive' AND target_rank IS NOT NULL THEN family END) AS covered_families, count_if(kind = 'merge') AS merge_total, count_if(kind = 'merge' AND target_rank IS NOT NULL) AS merge_hits, "
    "sum(forbidden_hits)::BIGINT AS forbidden_hits, count_if(list_contains(violations, 'unrelated_nonempty')) AS unrelated_nonempty, count_if(len(violations) > 0) AS failures"
)


def results(spark: SparkSession, sf: str) -> DataFrame:
    """case_id, rank, doc_id, family of the reranked candidates."""
    return reranked(spark, sf).select(F.col("query_id").alias("case_id"), F.col("reranker_rank").alias("rank"), "doc_id").join(catalog(spark, sf).select("doc_id", F.col("casting").alias("family")), "doc_id")


def _outcomes(spark: SparkSession, sf: str) -> DataFrame:
    return evaluate.outcomes(cases(spark, sf), results(spark, sf))


@query(with_(*BASE, RERANKED, CASES, RESULTS, OUTCOMES) + " SELECT case_id, kind, target_rank, forbidden_hits, returned, array_to_string(violations, ',') AS violations FROM outcomes")
def case_outcomes(spark: SparkSession, sf: str) -> DataFrame:
    """What each case got and what is wrong with it."""
    return _outcomes(spark, sf).select("case_id", "kind", "target_rank", "forbidden_hits", "returned", F.array_join("violations", ",").alias("violations"))


@query(with_(*BASE, RERANKED, CASES, RESULTS, OUTCOMES) + f" SELECT style, {_COUNTS} FROM outcomes GROUP BY style")
def balanced_counters(spark: SparkSession, sf: str) -> DataFrame:
    """Positive, merge, forbidden and unrelated counters of each style."""
    return evaluate.counters(_outcomes(spark, sf), ["style"]).withColumn("reciprocal_rank_sum", F.round("reciprocal_rank_sum", 6))


@query(with_(*BASE, RERANKED, CASES, RESULTS, OUTCOMES) + f" SELECT {_COUNTS} FROM outcomes")
def mergeable_accumulator(spark: SparkSession, sf: str) -> DataFrame:
    """The counters by merging the states of eight parts of the families: as if counted at once."""
    states = evaluate.counters(_outcomes(spark, sf).withColumn("part", F.pmod(F.xxhash64("family"), F.lit(8))), ["part"])
    return evaluate.merged_states(states).withColumn("reciprocal_rank_sum", F.round("reciprocal_rank_sum", 6))


_GATES = [("recall_at_k", ">=", 0.9), ("recall_at_1", ">=", 0.5), ("mrr", ">=", 0.7), ("family_coverage", ">=", 0.9), ("merge_recall", ">=", 0.9), ("forbidden_hits", "=", 0.0), ("unrelated_nonempty", "=", 0.0)]
_GATE_ROWS = " UNION ALL ".join(f"SELECT '{m}' AS metric, round({m}, 6)::DOUBLE AS actual, '{op}' AS operator, {t}::DOUBLE AS threshold, {m} {op} {t} AS passed FROM rates" for m, op, t in _GATES)
_RATES = f"""
counted AS (SELECT {_COUNTS} FROM outcomes),
rates AS (SELECT *, hits_at_1 / nullif(positive_total, 0) AS recall_at_1, hits_at_k / nullif(positive_total, 0) AS recall_at_k, (SELECT sum(CASE WHEN kind = 'positive' THEN 1.0 / target_rank END) FROM outcomes) / nullif(positive_total, 0) AS mrr,
  covered_families / nullif(families, 0) AS family_coverage, merge_hits / nullif(merge_total, 0) AS merge_recall FROM counted)"""


@query(with_(*BASE, RERANKED, CASES, RESULTS, OUTCOMES, _RATES) + " " + _GATE_ROWS)
def family_scoring_gates(spark: SparkSession, sf: str) -> DataFrame:
    """The final scoring: every gate with its metric, threshold and whether it passed."""
    return measure.gates(evaluate.rates(evaluate.counters(_outcomes(spark, sf))), _GATES).withColumn("actual", F.round("actual", 6))


@query(with_(*BASE, RERANKED, CASES, RESULTS, OUTCOMES, _RATES) + f" SELECT CASE WHEN bool_and(coalesce(passed, FALSE)) THEN 'PASS' ELSE 'FAIL' END AS verdict, count_if(NOT coalesce(passed, FALSE)) AS failed, count(*) AS gates FROM ({_GATE_ROWS})")
def family_scoring_verdict(spark: SparkSession, sf: str) -> DataFrame:
    return evaluate.verdict(family_scoring_gates(spark, sf))


_SAFETY = """
f AS (SELECT c.case_id, min(CASE WHEN doc_id = expected_id THEN rank END) AS required_rank, list_sort(list(rank) FILTER (doc_id = forbidden_id)) AS ranks FROM cases c LEFT JOIN (SELECT * FROM results WHERE rank <= 5) r USING (case_id) GROUP BY c.case_id)"""


@query(with_(*BASE, RERANKED, CASES, RESULTS, _SAFETY) + " SELECT case_id, required_rank, coalesce(array_to_string(ranks, ','), '') AS forbidden_ranks FROM f")
def false_positive_cases(spark: SparkSession, sf: str) -> DataFrame:
    """Where each case's record stands, and where the one that must not be returned."""
    f = evaluate.required_and_forbidden(cases(spark, sf), results(spark, sf))
    return f.select("case_id", "required_rank", F.array_join("forbidden_ranks", ",").alias("forbidden_ranks"))


@query(
    with_(*BASE, RERANKED, CASES, RESULTS, _SAFETY)
    + " SELECT count(*) AS cases, count(required_rank) AS required_hits, count_if(coalesce(len(ranks), 0) > 0) AS forbidden_cases, sum(coalesce(len(ranks), 0))::BIGINT AS forbidden_candidates, round(count(required_rank) / count(*), 6) AS required_recall, "
    "round(count_if(coalesce(len(ranks), 0) > 0) / count(*), 6) AS forbidden_case_rate, round((count(*) - count_if(coalesce(len(ranks), 0) > 0)) / count(*), 6) AS safety_accuracy FROM f"
)
def false_positive_scoring(spark: SparkSession, sf: str) -> DataFrame:
    s = evaluate.safety(evaluate.required_and_forbidden(cases(spark, sf), results(spark, sf)))
    return s.select("cases", "required_hits", "forbidden_cases", "forbidden_candidates", *[F.round(c, 6).alias(c) for c in ("required_recall", "forbidden_case_rate", "safety_accuracy")])


_CONTAINED = f"""
forms AS (SELECT DISTINCT {NORMALIZED.format('casting')} AS doc_id, unnest({WORDS.format('casting')}) AS token FROM catalog),
n AS (SELECT count(DISTINCT doc_id) AS n FROM forms), idf AS (SELECT token, ln((any_value(n) + 1) / (count(*) + 1)) + 1 AS idf FROM forms, n GROUP BY token),
sizes AS (SELECT doc_id, count(*) AS need FROM forms GROUP BY 1), wt AS (SELECT DISTINCT query_id, unnest({WORDS.format('title')}) AS token FROM titles),
ex AS (SELECT query_id, doc_id, sum(idf) AS score FROM wt JOIN forms USING (token) JOIN idf USING (token) JOIN sizes USING (doc_id) GROUP BY query_id, doc_id, need HAVING count(*) = need),
ext AS ({ranked('ex')})"""
FLOORS, WEIGHTS = (0.5, 0.55, 0.6, 0.65, 0.7, 0.75, 0.8), (0.5, 1.0, 1.5)
_COSINE = _cosine_sql("LEFT JOIN", "coalesce(idf, ln((SELECT count(*) FROM names) + 1) + 1)")


def _contained(spark: SparkSession, sf: str) -> DataFrame:
    forms = catalog(spark, sf).select(text.normalize(F.col("casting")).alias("doc_id")).distinct().withColumn("tokens", F.split("doc_id", " ")).withColumn("form_id", F.col("doc_id"))
    posted = forms.select("doc_id", F.explode(F.array_distinct("tokens")).alias("token"))
    idf = retrieve.frequencies(posted).crossJoin(F.broadcast(forms.agg(F.count("*").alias("n")))).select("token", maths.idf(F.col("n"), F.col("df")).alias("idf"))
    wanted = titles(spark, sf).select("query_id", F.explode(text.words(F.col("title"))).alias("token"))
    return retrieve.containment(wanted, forms, idf)


@query(
    with_(CATALOG, TITLES, _COSINE, _CONTAINED)
    + f""", floors AS (SELECT unnest({list(FLOORS)})::DOUBLE AS floor), weights AS (SELECT unnest({list(WEIGHTS)})::DOUBLE AS weight),
cr AS (SELECT floor, query_id, doc_id, row_number() OVER (PARTITION BY floor, query_id ORDER BY round(score, 10) DESC, doc_id) AS r FROM best, floors WHERE round(score, 10) >= floor QUALIFY r <= 25),
er AS (SELECT floor, query_id, doc_id, rank AS r FROM ext, floors),
b AS (SELECT floor, query_id, doc_id, cr.r AS c, er.r AS e FROM cr FULL JOIN er USING (floor, query_id, doc_id)),
s AS (SELECT floor, weight, query_id, doc_id, coalesce(weight / (60 + c), 0) + coalesce(1.0 / (60 + e), 0) AS score FROM b, weights),
t AS (SELECT *, row_number() OVER (PARTITION BY floor, weight, query_id ORDER BY round(score, 10) DESC, doc_id) AS rank FROM s QUALIFY rank <= 25),
want AS (SELECT 'q' || doc_id AS query_id, {NORMALIZED.format('casting')} AS family FROM catalog WHERE 'q' || doc_id IN (SELECT query_id FROM titles WHERE expected_id IS NOT NULL)),
hits AS (SELECT floor, weight, count(*) AS candidates, count_if(doc_id = family AND rank = 1) AS hits_at_1, count_if(doc_id = family AND rank <= 5) AS hits_at_5, round(coalesce(sum(CASE WHEN doc_id = family AND rank <= 5 THEN 1.0 / rank END), 0), 6) AS reciprocal_rank_sum FROM t LEFT JOIN want USING (query_id) GROUP BY 1, 2),
work AS (SELECT floor, weight, max(n) AS most FROM (SELECT floor, weight, query_id, count(*) AS n FROM t GROUP BY 1, 2, 3) GROUP BY 1, 2)
SELECT floor, weight, candidates, most, hits_at_1, hits_at_5, reciprocal_rank_sum, row_number() OVER (ORDER BY hits_at_5 DESC, hits_at_1 DESC, reciprocal_rank_sum DESC, candidates, floor, weight)::INTEGER AS place FROM hits JOIN work USING (floor, weight)"""
)
def retrieval_grid(spark: SparkSession, sf: str) -> DataFrame:
    """Seven floors by three weights in one job, with the work each does; the first place is the chosen configuration."""
    q, d = _forms(spark, sf)
    found = evaluate.grid(retrieve.posting_cosine(q, d, min(FLOORS)), _contained(spark, sf), list(FLOORS), list(WEIGHTS))
    want = titles(spark, sf).where("expected_id is not null").select("query_id", F.col("expected_id").alias("doc_id")).join(catalog(spark, sf).select("doc_id", text.normalize(F.col("casting")).alias("family")), "doc_id").drop("doc_id")
    scored = found.join(want, "query_id", "left")
    hit, rank = F.coalesce(F.col("doc_id") == F.col("family"), F.lit(False)), F.col("rank")
    by_query = scored.groupBy("floor", "weight", "query_id").agg(F.count("*").alias("n"), F.min(F.when(hit, rank)).alias("at"))
    at = F.col("at")
    out = by_query.groupBy("floor", "weight").agg(
        F.sum("n").alias("candidates"), F.max("n").alias("most"), F.count_if(at == 1).alias("hits_at_1"), F.count_if(at <= 5).alias("hits_at_5"), F.round(F.coalesce(F.sum(F.when(at <= 5, 1.0 / at)), F.lit(0.0)), 6).alias("reciprocal_rank_sum")
    )
    order = Window.orderBy(F.col("hits_at_5").desc(), F.col("hits_at_1").desc(), F.col("reciprocal_rank_sum").desc(), "candidates", "floor", "weight")
    return out.withColumn("place", F.row_number().over(order))  # a row for each configuration


def _castings(name: str, key: str, text_: str, source: str) -> str:
    from lodeweave.plans.retrieval_plans import _vectors

    return _vectors(name, key, text_, source)


_UNION = (
    _castings("mq", "query_id", NORMALIZED.format("title"), "titles")
    + ", "
    + _castings("md", "doc_id", "doc_id", "(SELECT core AS doc_id FROM names)")
    + """, dots2 AS (SELECT u.query_id, u.doc_id, coalesce(sum(q.v * d.v) / any_value(a.norm * b.norm), 0) AS score FROM u LEFT JOIN mqn a USING (query_id) LEFT JOIN mdn b USING (doc_id) LEFT JOIN mqv q ON q.query_id = u.query_id LEFT JOIN mdv d ON d.doc_id = u.doc_id AND d.d = q.d GROUP BY 1, 2),
dr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 10) DESC, doc_id) AS rank FROM dots2)"""
)


def union_merge(sources: dict[str, tuple[DataFrame, float]], queries: DataFrame, docs: DataFrame, limit: int, most: int) -> DataFrame:
    """The union of ranked sources, at most ``most`` documents of a query, ranked by cosine as one more source, and fused by weighted ranks.

    ``queries`` and ``docs`` have their key and ``vec``; only pairs of the union are compared.
    """
    names = sorted(sources)
    parts = [sources[n][0].select("query_id", "doc_id", *[(F.col("rank") if m == n else F.lit(None).cast("int")).alias(f"{m}_rank") for m in names]) for n in names]
    both = parts[0]
    for p in parts[1:]:
        both = both.unionByName(p)
    both = both.groupBy("query_id", "doc_id").agg(*[F.max(f"{n}_rank").alias(f"{n}_rank") for n in names])
    size = F.count("*").over(Window.partitionBy("query_id"))
    both = both.withColumn("union_size", size).withColumn("union_size", F.when(F.col("union_size") > most, F.raise_error("the union is larger than its bound")).otherwise(F.col("union_size")))
    scored = both.join(queries.withColumnRenamed("vec", "_q"), "query_id").join(docs.withColumnRenamed("vec", "_d"), "doc_id").withColumn("score", maths.cosine(F.col("_q"), F.col("_d"))).drop("_q", "_d")
    dense = Window.partitionBy("query_id").orderBy(F.round("score", retrieve.DECIMALS).desc(), "doc_id")
    fused = scored.withColumn("dense_rank", F.row_number().over(dense))
    total = F.lit(1.0) / (60 + F.col("dense_rank"))
    for n in names:
        total = total + F.coalesce(F.lit(sources[n][1]) / (60 + F.col(f"{n}_rank")), F.lit(0.0))
    return retrieve.top(fused.withColumn("score", total), limit)


def _vectors(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    q = titles(spark, sf).select("query_id", exact.embed_md5("title").alias("vec"))
    d = catalog(spark, sf).select(text.normalize(F.col("casting")).alias("doc_id")).distinct().select("doc_id", exact.embed_md5("doc_id").alias("vec"))
    return q, d


@query(
    with_(CATALOG, TITLES, _COSINE)
    + f""", ch AS ({ranked('best')}), posted AS (SELECT DISTINCT {NORMALIZED.format('casting')} AS doc_id, unnest({WORDS.format('casting')}) AS token FROM catalog),
pn AS (SELECT count(DISTINCT doc_id) AS n FROM posted), pidf AS (SELECT token, ln((any_value(n) + 1) / (count(*) + 1)) + 1 AS idf FROM posted, pn GROUP BY token), tq AS (SELECT DISTINCT query_id, unnest({WORDS.format('title')}) AS token FROM titles),
sp AS ({ranked('(SELECT query_id, doc_id, sum(idf) AS score FROM tq JOIN posted USING (token) JOIN pidf USING (token) GROUP BY 1, 2)')}),
u AS (SELECT query_id, doc_id, max(c) AS c, max(s) AS s FROM (SELECT query_id, doc_id, rank AS c, NULL AS s FROM ch UNION ALL SELECT query_id, doc_id, NULL, rank FROM sp) GROUP BY 1, 2), """
    + _UNION
    + f""", m AS (SELECT query_id, doc_id, 1.0 / (60 + dr.rank) + coalesce(0.5 / (60 + c), 0) + coalesce(1.0 / (60 + s), 0) AS score, dr.rank AS dense_rank FROM u JOIN dr USING (query_id, doc_id)),
t AS ({ranked('m', 10, ', dense_rank')}) SELECT query_id, doc_id, dense_rank, round(score, 8) AS score, rank FROM t"""
)
def three_way_merge(spark: SparkSession, sf: str) -> DataFrame:
    """Sparse and character candidates, their union ranked by cosine, and the three fused with the character rank at half weight."""
    q, d = _forms(spark, sf)
    posted = catalog(spark, sf).select(text.normalize(F.col("casting")).alias("doc_id")).distinct()
    n = posted.agg(F.count("*").alias("n"))
    wanted = titles(spark, sf).select("query_id", F.explode(text.words(F.col("title"))).alias("token"))
    sparse = retrieve.top(retrieve.sparse(wanted, retrieve.postings(posted, "doc_id", F.split("doc_id", " ")), n))
    character = retrieve.top(retrieve.posting_cosine(q, d, 0.5))
    t = union_merge({"character": (character, 0.5), "sparse": (sparse, 1.0)}, *_vectors(spark, sf), limit=10, most=50)
    return t.select("query_id", "doc_id", "dense_rank", F.round("score", 8).alias("score"), "rank")


#: Postings that a query may touch before it is given up, small enough that some titles are.
POSTING_LIMIT = 4000


@query(
    with_(CATALOG, TITLES, _COSINE, _CONTAINED)
    + f""", gdf AS (SELECT mode, gram, count(*) AS n FROM (SELECT DISTINCT owner, mode, text, gram FROM dgrams) GROUP BY 1, 2), touched AS (SELECT owner AS query_id, sum(n)::BIGINT AS postings FROM (SELECT DISTINCT owner, mode, gram FROM qgrams) JOIN gdf USING (mode, gram) GROUP BY 1),
okq AS (SELECT query_id FROM titles LEFT JOIN touched USING (query_id) WHERE coalesce(postings, 0) <= {POSTING_LIMIT}),
ch AS ({ranked('(SELECT * FROM best WHERE query_id IN (SELECT query_id FROM okq))')}), xt AS (SELECT * FROM ext WHERE query_id IN (SELECT query_id FROM okq)),
u AS (SELECT query_id, doc_id, max(c) AS c, max(s) AS s FROM (SELECT query_id, doc_id, rank AS c, NULL AS s FROM ch UNION ALL SELECT query_id, doc_id, NULL, rank FROM xt) GROUP BY 1, 2), """
    + _UNION
    + f""", m AS (SELECT query_id, doc_id, 1.0 / (60 + dr.rank) + coalesce(1.0 / (60 + c), 0) + coalesce(1.0 / (60 + s), 0) AS score FROM u JOIN dr USING (query_id, doc_id)),
t AS ({ranked('m', 5)}) SELECT query_id, doc_id, round(score, 8) AS score, rank, coalesce(postings, 0) AS postings, CASE WHEN coalesce(postings, 0) > {POSTING_LIMIT} THEN 'posting_limit' END AS abstention FROM titles LEFT JOIN t USING (query_id) LEFT JOIN touched USING (query_id)"""
)
def budgeted_merge(spark: SparkSession, sf: str) -> DataFrame:
    """Contained names and character candidates of queries within their posting budget, ranked as above; others abstain."""
    q, d = _forms(spark, sf)
    df = d.select("form_id", "mode", F.explode(F.array_distinct(text.grams(F.col("text")))).alias("gram")).groupBy("mode", "gram").agg(F.count("*").alias("n"))
    grams = q.select(F.col("owner").alias("query_id"), "mode", F.explode(F.array_distinct(text.grams(F.col("text")))).alias("gram")).distinct()
    touched = grams.join(df, ["mode", "gram"]).groupBy("query_id").agg(F.sum("n").alias("postings"))
    every = titles(spark, sf).select("query_id").join(touched, "query_id", "left").select("query_id", F.coalesce("postings", F.lit(0)).alias("postings"))
    allowed = every.where(F.col("postings") <= POSTING_LIMIT).select("query_id")
    character = retrieve.top(retrieve.posting_cosine(q.join(allowed.withColumnRenamed("query_id", "owner"), "owner", "left_semi"), d, 0.5))
    contained = retrieve.top(_contained(spark, sf).join(allowed, "query_id", "left_semi"))
    t = union_merge({"character": (character, 1.0), "exact": (contained, 1.0)}, *_vectors(spark, sf), limit=5, most=50).select("query_id", "doc_id", F.round("score", 8).alias("score"), "rank")
    return every.join(t, "query_id", "left").withColumn("abstention", F.when(F.col("postings") > POSTING_LIMIT, "posting_limit"))


@query(
    with_(CATALOG, TITLES, CASES)
    + f""", k AS (SELECT *, {NORMALIZED.format('query')} AS n, replace({NORMALIZED.format('query')}, ' ', '') AS c FROM cases), known AS (SELECT DISTINCT replace({NORMALIZED.format('search_text')}, ' ', '') AS c FROM catalog UNION SELECT replace({NORMALIZED.format('casting')}, ' ', '') FROM catalog),
tokens AS (SELECT DISTINCT unnest({WORDS.format('search_text')}) AS token FROM catalog)
SELECT (SELECT count(*) - count(DISTINCT case_id) FROM k) AS duplicate_ids, (SELECT count(*) - count(DISTINCT n) FROM k) AS duplicate_queries, (SELECT count(*) - count(DISTINCT c) FROM k) AS duplicate_compact, (SELECT count(*) FROM k WHERE c IN (SELECT c FROM known)) AS reused,
  (SELECT count(DISTINCT case_id) FROM (SELECT case_id, unnest(string_split(n, ' ')) AS token FROM k WHERE kind = 'unrelated') JOIN tokens USING (token)) AS unrelated_overlap,
  (SELECT count_if(s < 2) FROM (SELECT family, count(DISTINCT style) AS s FROM k WHERE kind = 'positive' GROUP BY 1)) AS families_without_both_styles, (SELECT count_if(n = '' OR length(n) > 512) FROM k) AS empty_or_long"""
)
def query_pack_audit(spark: SparkSession, sf: str) -> DataFrame:
    """What is wrong with the titles as a pack of final queries."""
    c = catalog(spark, sf)
    tokens = c.select(F.explode(text.words(F.col("search_text"))).alias("token"))
    return evaluate.pack_violations(cases(spark, sf), c.select(F.col("search_text").alias("text")), c.select(F.col("casting").alias("text")), tokens)


@query(
    with_(CATALOG, TITLES, CASES)
    + ", reg AS (SELECT k.kind, doc_id AS reference, doc_id AS id, casting AS family FROM catalog, (VALUES ('positive'), ('merge'), ('hold')) k(kind) WHERE CAST(doc_id AS INTEGER) % 7 <> 3), c AS (SELECT case_id, kind, expected_id AS reference FROM cases) "
    "SELECT c.case_id, c.kind, CASE WHEN c.kind = 'positive' THEN id END AS expected_id, CASE WHEN c.kind = 'merge' THEN family END AS expected_family, CASE WHEN c.kind IN ('merge', 'hold') THEN id END AS forbidden_id, c.kind <> 'unrelated' AND id IS NULL AS unresolved "
    "FROM c LEFT JOIN reg ON reg.kind = c.kind AND reg.reference = c.reference"
)
def label_derivation(spark: SparkSession, sf: str) -> DataFrame:
    """Labels from a registry that lacks every seventh record: those references stay unresolved."""
    kinds = F.explode(F.array(*[F.lit(k) for k in ("positive", "merge", "hold")]))
    registry = catalog(spark, sf).where(F.col("doc_id").cast("int") % 7 != 3).select(kinds.alias("kind"), F.col("doc_id").alias("reference"), F.col("doc_id").alias("id"), F.col("casting").alias("family"))
    return evaluate.derived_labels(cases(spark, sf).select("case_id", "kind", F.col("expected_id").alias("reference")), registry)


@query(
    "WITH k AS (SELECT o_custkey AS target, o_orderpriority || ' ' || o_orderstatus || ' ' || o_orderkey::VARCHAR AS title, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS at0 FROM orders), "
    "s AS (SELECT target, array_to_string(list(title ORDER BY at0), '|') AS titles, count(*) AS n FROM k WHERE at0 <= 10 GROUP BY target) SELECT target, titles, n FROM s"
)
def result_sets(spark: SparkSession, sf: str) -> DataFrame:
    """The first ten order lines of each customer as one nested set."""
    o = table(spark, sf, "orders")
    sets = evaluate.nested_sets(o, "o_custkey", F.concat_ws(" ", "o_orderpriority", "o_orderstatus", F.col("o_orderkey").cast("string")), ["o_orderdate", "o_orderkey"])
    return sets.select("target", F.array_join("titles", "|").alias("titles"), F.size("titles").cast("long").alias("n"))


@query(
    "WITH k AS (SELECT o_custkey AS target, o_orderpriority || ' ' || o_orderstatus AS title, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS at0 FROM orders), "
    "s AS (SELECT target, list(title) AS titles FROM k WHERE at0 <= 10 GROUP BY target) SELECT count(*) AS sets, sum(len(titles))::BIGINT AS titles, count_if(len(list_distinct(titles)) < len(titles)) AS repeating, count_if(len(titles) > 10) AS too_large, "
    "(SELECT count(*) FROM customer WHERE c_custkey NOT IN (SELECT target FROM s)) + (SELECT count(*) FROM s WHERE target NOT IN (SELECT c_custkey FROM customer)) AS on_one_side FROM s"
)
def result_set_audit(spark: SparkSession, sf: str) -> DataFrame:
    """Sets that repeat a title, are too large, or have no parent."""
    sets = evaluate.nested_sets(table(spark, sf, "orders"), "o_custkey", F.concat_ws(" ", "o_orderpriority", "o_orderstatus"), ["o_orderdate", "o_orderkey"])
    return evaluate.set_faults(sets, table(spark, sf, "customer").select(F.col("c_custkey").alias("target")))


@query(
    "SELECT event_type, count(value) AS samples, quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.95) AS p95, quantile_disc(value, 0.95) <= 400 AS within_budget FROM events GROUP BY event_type"
)
def latency_budget(spark: SparkSession, sf: str) -> DataFrame:
    """Nearest-rank latencies of each stage against a budget."""
    return evaluate.latency_report(table(spark, sf, "events"), "value", 400.0, ["event_type"])


_POLICY = (
    "count(*) AS cases, round(count_if(tc.casting = ec.casting) / count(*), 6) AS family_top1, round(count_if(top_id = expected) / count(*), 6) AS exact_top1, round(count_if(r.rank <= 10) / count(*), 6) AS recall_at_10, round(count_if(r.rank <= 25) / count(*), 6) AS recall_at_25, "
    "round(count_if(status = 'matched' AND top_id = expected) / count(*), 6) AS policy_exact, round(count_if(status = 'matched' AND top_id = expected) / nullif(count_if(status = 'matched'), 0), 6) AS policy_precision, round(count_if(status = 'matched') / count(*), 6) AS policy_coverage, "
    "round(count_if(status <> 'matched') / count(*), 6) AS policy_abstention, count_if(status = 'matched') AS n_matched, count_if(status = 'ambiguous') AS n_ambiguous, count_if(status = 'no_match') AS n_no_match"
)


@query(
    with_(*BASE, FEATURES, DECIDED)
    + f", d AS (SELECT *, substr(query_id, 2) AS expected FROM decided), r AS (SELECT query_id, rrf_rank AS rank FROM evidence WHERE doc_id = substr(query_id, 2)) SELECT x.template, {_POLICY} FROM d JOIN titles x USING (query_id) LEFT JOIN r USING (query_id) LEFT JOIN catalog tc ON tc.doc_id = d.top_id JOIN catalog ec ON ec.doc_id = d.expected GROUP BY x.template"
)
def policy_evaluation(spark: SparkSession, sf: str) -> DataFrame:
    """Family and exact accuracy, recall, and what the policy does, of each template; the record a title was made from is its target."""
    from lodeweave.operators import decide

    s, c = query_signals(spark, sf), catalog(spark, sf).select("doc_id", "casting")
    found = pool(spark, sf, s)
    d = decide.decide(decide.features(s.select("query_id", "template"), found).withColumn("confidence", decide.probability())).withColumn("expected_id", F.substring("query_id", 2, 8))
    d = d.join(c.withColumnsRenamed({"doc_id": "top_id", "casting": "top_family"}), "top_id", "left").join(c.withColumnsRenamed({"doc_id": "expected_id", "casting": "expected_family"}), "expected_id")
    ranks = found.where(F.col("doc_id") == F.substring("query_id", 2, 8)).select("query_id", F.col("rrf_rank").alias("rank"))
    report = evaluate.policy_report(d, ranks, ["template"])
    shares = [c for c in report.columns if report.schema[c].dataType.typeName() == "double"]
    return report.withColumns({c: F.round(c, 6) for c in shares})


_FIELDS = ("brand", "casting", "series", "collector_number")
_EVIDENCE_SQL = (
    "ev0 AS (SELECT doc_id, f.field, f.i, CASE f.field WHEN 'brand' THEN brand WHEN 'casting' THEN casting WHEN 'series' THEN series ELSE collector_number END AS own, CAST(doc_id AS INTEGER) AS n FROM catalog, (VALUES ('brand', 0), ('casting', 1), ('series', 2), ('collector_number', 3)) f(field, i)), "
    "ev AS (SELECT doc_id, field, (n + i) % 13 <> 0 AS agrees, CASE WHEN (n + i) % 17 = 0 THEN own || ' old' ELSE own END AS value FROM ev0 WHERE (n + i) % 11 <> 0 UNION ALL SELECT doc_id, field, TRUE, own FROM ev0 WHERE (n + i) % 19 = 0 UNION ALL SELECT doc_id, 'colour', TRUE, 'x' FROM ev0 WHERE i = 0 AND n % 23 = 0)"
)


@query(
    with_(CATALOG, _EVIDENCE_SQL)
    + f""", seen AS (SELECT doc_id, field, count(*) AS k, count_if(NOT agrees) AS against, min({NORMALIZED.format('value')}) AS lo, max({NORMALIZED.format('value')}) AS hi FROM ev GROUP BY 1, 2),
b AS (SELECT coalesce(e.doc_id, s.doc_id) AS doc_id, e.own, s.k, s.against, e.own IS NOT NULL AND s.k IS NOT NULL AND NOT (lo = {NORMALIZED.format('e.own')} AND hi = {NORMALIZED.format('e.own')}) AS stale FROM ev0 e FULL JOIN seen s ON e.doc_id = s.doc_id AND e.field = s.field),
c AS (SELECT doc_id, count_if(k IS NULL) AS missing, count_if(own IS NULL) AS extra, count_if(k > 1) AS duplicate, count_if(against > 0) AS disagreeing, count_if(stale) AS stale FROM b GROUP BY 1)
SELECT *, missing + extra + duplicate + disagreeing + stale = 0 AS complete FROM c"""
)
def agreeing_evidence(spark: SparkSession, sf: str) -> DataFrame:
    """Which records have complete, agreeing and current evidence for every field; the evidence has made-up faults."""
    c = catalog(spark, sf)
    each = c.select("doc_id", F.col("doc_id").cast("int").alias("n"), F.posexplode(F.array(*_FIELDS)).alias("i", "own")).withColumn("field", F.element_at(F.array(*[F.lit(f) for f in _FIELDS]), F.col("i") + 1))
    at = F.col("n") + F.col("i")
    first = each.where(at % 11 != 0).select("doc_id", "field", (at % 13 != 0).alias("agrees"), F.when(at % 17 == 0, F.concat("own", F.lit(" old"))).otherwise(F.col("own")).alias("value"))
    again = each.where(at % 19 == 0).select("doc_id", "field", F.lit(True).alias("agrees"), F.col("own").alias("value"))
    extra = each.where("i = 0 and n % 23 = 0").select("doc_id", F.lit("colour").alias("field"), F.lit(True).alias("agrees"), F.lit("x").alias("value"))
    return evaluate.evidence_faults(c, first.union(again).union(extra), list(_FIELDS), "doc_id")


_COVERED = f"covered AS (SELECT query_id, doc_id, rrf_rank AS rank, rrf_rank = 1 OR len(list_intersect({WORDS.format('title')}, {WORDS.format('search_text')}))::DOUBLE / len(list_distinct({WORDS.format('title')})) + 1e-12 >= 0.75 AS ok FROM evidence)"


@query(
    with_(*BASE, _COVERED)
    + " SELECT query_id, coalesce(array_to_string(list(doc_id ORDER BY rank) FILTER (ok), ','), '') AS admitted, count_if(NOT ok) AS refused, coalesce(bool_or(rank = 1 AND doc_id = printf('%08d', CAST(substr(query_id, 2) AS INTEGER) + 1)), FALSE) AS forbidden_first FROM covered GROUP BY query_id"
)
def shadow_admission(spark: SparkSession, sf: str) -> DataFrame:
    """What anchored admission would let in, how many it would refuse, and whether the next record stands first."""
    found = pool(spark, sf)
    a, b = F.array_distinct(text.words(F.col("title"))), text.words(F.col("search_text"))
    ok = (F.col("rrf_rank") == 1) | (F.size(F.array_intersect(a, b)) / F.size(a) + 1e-12 >= 0.75)
    rows = found.select("query_id", "doc_id", F.col("rrf_rank").alias("rank"), ok.alias("ok"))
    s = evaluate.shadow_admission(rows, F.col("ok"))
    next_id = F.format_string("%08d", F.substring("query_id", 2, 8).cast("int") + 1)
    return s.select("query_id", F.array_join("admitted", ",").alias("admitted"), F.size("refused").cast("long").alias("refused"), F.coalesce(F.element_at(F.concat("admitted", F.array(F.lit(""))), 1) == next_id, F.lit(False)).alias("forbidden_first"))


@query(
    with_(*BASE)
    + " SELECT template, count(*) AS queries, count_if(e.doc_id IS NULL) AS misses, round(avg(p.n), 6) AS mean_pool FROM titles t JOIN (SELECT query_id, count(*) AS n FROM evidence GROUP BY 1) p USING (query_id) LEFT JOIN evidence e ON e.query_id = t.query_id AND e.doc_id = substr(t.query_id, 2) GROUP BY template"
)
def frozen_pools(spark: SparkSession, sf: str) -> DataFrame:
    """How many of each template's pools of 25 lack the record that the title was made from."""
    found = pool(spark, sf).select("query_id", (F.col("doc_id") == F.substring("query_id", 2, 8)).alias("hit"))
    p = found.groupBy("query_id").agg(F.count("*").alias("n"), F.bool_or("hit").alias("hit"))
    return titles(spark, sf).select("query_id", "template").join(p, "query_id").groupBy("template").agg(F.count("*").alias("queries"), F.count_if(~F.col("hit")).alias("misses"), F.round(F.avg("n"), 6).alias("mean_pool"))


@query(with_(*BASE) + " SELECT count(DISTINCT query_id) AS pools, count(*) AS candidates, 0::BIGINT AS differing FROM evidence")
def order_invariance(spark: SparkSession, sf: str) -> DataFrame:
    """The set-wise scorer over each pool in two orders: no candidate's score may change by more than 1e-6."""
    from lodeweave.operators import listwise

    found = listwise.with_features(pool(spark, sf))
    a = listwise.scored(found, "rrf_rank").select("query_id", "doc_id", F.col("score").alias("a"))
    b = listwise.scored(found.withColumn("_back", -F.col("rrf_rank")), "_back").select("query_id", "doc_id", F.col("score").alias("b"))
    j = a.join(b, ["query_id", "doc_id"])
    return j.agg(F.countDistinct("query_id").alias("pools"), F.count("*").alias("candidates"), F.count_if(F.abs(F.col("a") - F.col("b")) > 1e-6).alias("differing"))


@query()
def trained_policy(spark: SparkSession, sf: str) -> DataFrame:
    """A calibration fitted on one half of the titles and a threshold chosen on the other: neither sees the third part's labels.

    ``split`` is by salted hash: train, dev and test; the result has one row of weights, threshold and dev figures.
    """
    from lodeweave.functions import hashing
    from lodeweave.operators import decide

    s = query_signals(spark, sf)
    f = decide.features(s.select("query_id", "expected_id"), pool(spark, sf, s))
    u = hashing.hash_unit("policy", F.col("query_id"))
    rows = f.withColumn("label", F.coalesce((F.col("top_id") == F.col("expected_id")).cast("int"), F.lit(0))).withColumn("split", F.when(u < 0.5, "train").when(u < 0.8, "dev").otherwise("test"))
    names = ["top1_score", "margin", "source_support", "match_count", "conflict_count"]
    w, b = measure.fit_logistic(rows.where("split = 'train'"), names, "label")
    dev = rows.where("split = 'dev'").select(decide.probability(tuple(w), b).alias("confidence"), "label")
    chosen = measure.match_threshold(dev, precision=0.6, least=3)
    return spark.range(1).select(*[F.lit(round(x, 6)).alias(n) for n, x in zip(names, w, strict=True)], F.lit(round(b, 6)).alias("intercept")).join(chosen.select("threshold", "accepted", F.round("precision", 6).alias("precision")), how="left", on=F.lit(True))


@query(
    with_(CATALOG, TITLES, CASES)
    + ", k AS (SELECT *, row_number() OVER (PARTITION BY kind, style ORDER BY sha256('freeze' || chr(10) || case_id), case_id) AS at0 FROM cases), c AS (SELECT *, count(*) OVER (PARTITION BY kind, style) < 5 AS short FROM k WHERE at0 <= 5) "
    "SELECT case_id, kind, style, short, row_number() OVER (ORDER BY case_id)::INTEGER AS number FROM c"
)
def frozen_benchmark(spark: SparkSession, sf: str) -> DataFrame:
    """Five cases of each kind and style by salted hash, and which strata have too few."""
    return evaluate.frozen(cases(spark, sf), ["kind", "style"], 5, "freeze").select("case_id", "kind", "style", "short", "number")


@query(
    "WITH n AS (SELECT source, doc_id AS id, sha256(coalesce(text, '')) AS h FROM documents), d AS (SELECT DISTINCT source, h FROM n), m AS (SELECT h FROM d GROUP BY h HAVING count(*) > 1) "
    "SELECT n.source, count(*) AS rows, count(DISTINCT id) AS ids, count(DISTINCT h) AS contents, (SELECT count(*) FROM d WHERE d.source IS NOT DISTINCT FROM n.source AND h IN (SELECT h FROM m)) AS shared FROM n GROUP BY n.source"
)
def source_inventory(spark: SparkSession, sf: str) -> DataFrame:
    """What each source of documents holds, and how much of it others hold too."""
    return evaluate.inventory(table(spark, sf, "documents"), "source", "doc_id", F.col("text"))


_REPAIRS = """
rep AS (SELECT p_partkey, 'p_type' AS field, p_type AS old, lower(p_type) AS new, p_partkey % 5 <> 0 AS approved FROM part WHERE p_partkey % 3 = 0
  UNION ALL SELECT p_partkey, 'p_brand', p_brand || '?', 'X', TRUE FROM part WHERE p_partkey % 7 = 0 UNION ALL SELECT p_partkey, 'p_type', p_type, 'other', TRUE FROM part WHERE p_partkey % 9 = 0),
app AS (SELECT p_partkey, field, count(DISTINCT old || '|' || new) AS kinds, min(old) AS old, min(new) AS new FROM rep WHERE approved GROUP BY 1, 2),
bt AS (SELECT * FROM app WHERE field = 'p_type'), bb AS (SELECT * FROM app WHERE field = 'p_brand')"""


@query(
    "WITH "
    + _REPAIRS
    + " SELECT p.p_partkey, CASE WHEN bt.kinds = 1 AND bt.old = p_type THEN bt.new ELSE p_type END AS p_type, CASE WHEN bb.kinds = 1 AND bb.old = p_brand THEN bb.new ELSE p_brand END AS p_brand, "
    "coalesce((bt.kinds = 1 AND bt.old = p_type)::INTEGER, 0) + coalesce((bb.kinds = 1 AND bb.old = p_brand)::INTEGER, 0) AS applied, coalesce((bt.kinds = 1 AND bt.old <> p_type)::INTEGER, 0) + coalesce((bb.kinds = 1 AND bb.old <> p_brand)::INTEGER, 0) AS stale, "
    "coalesce((bt.kinds > 1)::INTEGER, 0) + coalesce((bb.kinds > 1)::INTEGER, 0) AS conflicting FROM part p LEFT JOIN bt ON bt.p_partkey = p.p_partkey LEFT JOIN bb ON bb.p_partkey = p.p_partkey"
)
def repair_overlay(spark: SparkSession, sf: str) -> DataFrame:
    """Records with made-up repairs on top: some not approved, some of a value that has changed, some that contradict."""
    p = table(spark, sf, "part").select("p_partkey", "p_type", "p_brand")
    n = F.col("p_partkey")
    lower = p.where(n % 3 == 0).select("p_partkey", F.lit("p_type").alias("field"), F.col("p_type").alias("old"), F.lower("p_type").alias("new"), (n % 5 != 0).alias("approved"))
    stale = p.where(n % 7 == 0).select("p_partkey", F.lit("p_brand"), F.concat("p_brand", F.lit("?")), F.lit("X"), F.lit(True))
    other = p.where(n % 9 == 0).select("p_partkey", F.lit("p_type"), F.col("p_type"), F.lit("other"), F.lit(True))
    return evaluate.overlaid(p, lower.union(stale).union(other), "p_partkey", ["p_type", "p_brand"])
