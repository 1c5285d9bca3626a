"""Queries over review decisions, packets, audits and the comparison of rankers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodeweave.functions import exact, hashing, maths, text
from lodeweave.operators import keep, measure
from lodeweave.plans.frames import CATALOG, TITLES, WORDS, catalog, table, titles, with_
from lodeweave.plans.decision_plans import DECIDED, FEATURES, resolve_decisions
from lodeweave.plans.retrieval_plans import BASE, RERANKED, reranked

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return register


_TARGETS = ", t AS (SELECT r.*, x.expected_id FROM reranked r JOIN titles x USING (query_id) WHERE expected_id IS NOT NULL)"


@query(
    with_(*BASE, RERANKED)
    + _TARGETS
    + ", p AS (SELECT query_id, reranker_score AS s, c.casting FROM t JOIN catalog c USING (doc_id) WHERE doc_id = expected_id), n AS (SELECT query_id, reranker_score AS s, c.casting FROM t JOIN catalog c USING (doc_id) WHERE doc_id <> expected_id) "
    "SELECT casting, count(*) AS pairs, count_if(round(p.s - n.s, 10) > 0) AS won FROM p JOIN n USING (query_id, casting) GROUP BY casting"
)
def same_family_accuracy(spark: SparkSession, sf: str) -> DataFrame:
    """How often a target beats a wrong candidate of its own name."""
    t = reranked(spark, sf).join(titles(spark, sf).where("expected_id is not null").select("query_id", "expected_id"), "query_id")
    t = t.select("query_id", "doc_id", "expected_id", "reranker_score").join(catalog(spark, sf).select("doc_id", "casting"), "doc_id")
    p = t.where("doc_id = expected_id").select("query_id", "casting", F.col("reranker_score").alias("p"))
    n = t.where("doc_id <> expected_id").select("query_id", "casting", F.col("reranker_score").alias("n"))
    return p.join(n, ["query_id", "casting"]).groupBy("casting").agg(F.count("*").alias("pairs"), F.count_if(F.round(F.col("p") - F.col("n"), 10) > 0).alias("won"))


@query(
    with_(*BASE, RERANKED)
    + _TARGETS
    + ", f AS (SELECT c.casting, bool_or(reranker_rank <= 5) AS hit FROM t JOIN catalog c ON c.doc_id = t.expected_id WHERE t.doc_id = expected_id GROUP BY 1) SELECT count(*) AS families, count_if(hit) AS covered FROM f"
)
def family_coverage_at_5(spark: SparkSession, sf: str) -> DataFrame:
    """Families with any target in the first five: a two-level aggregate."""
    t = titles(spark, sf).where("expected_id is not null").select("query_id", F.col("expected_id").alias("doc_id"))
    t = t.join(reranked(spark, sf).select("query_id", "doc_id", "reranker_rank"), ["query_id", "doc_id"]).join(catalog(spark, sf).select("doc_id", "casting"), "doc_id")
    return t.groupBy("casting").agg(F.bool_or(F.col("reranker_rank") <= 5).alias("hit")).agg(F.count("*").alias("families"), F.count_if("hit").alias("covered"))


@query(
    with_(CATALOG, TITLES)
    + f", posted AS (SELECT doc_id, token, min(p) AS p FROM (SELECT doc_id, unnest({WORDS.format('search_text')}) AS token, generate_subscripts({WORDS.format('search_text')}, 1) AS p FROM catalog) GROUP BY 1, 2), "
    f"w AS (SELECT DISTINCT query_id, unnest({WORDS.format('title')}) AS token FROM titles), h AS (SELECT query_id, doc_id, count(*) AS n, max(p) - min(p) + 1 AS span FROM w JOIN posted USING (token) GROUP BY 1, 2 HAVING count(*) >= 2), "
    "s AS (SELECT query_id, doc_id, n::DOUBLE * n / span AS score FROM h), t AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 10) DESC, doc_id) AS rank FROM s) SELECT query_id, doc_id, round(score, 6) AS score, rank FROM t WHERE rank <= 25"
)
def cover_density_topk(spark: SparkSession, sf: str) -> DataFrame:
    """Documents ranked by how close together they hold a query's words."""
    from lodeweave.operators import retrieve

    posted = catalog(spark, sf).select("doc_id", F.posexplode(text.words(F.col("search_text"))).alias("p", "token")).groupBy("doc_id", "token").agg(F.min("p").alias("p"))
    w = titles(spark, sf).select("query_id", F.explode(F.array_distinct(text.words(F.col("title")))).alias("token"))
    h = w.join(posted, "token").groupBy("query_id", "doc_id").agg(F.count("*").alias("n"), (F.max("p") - F.min("p") + 1).alias("span")).where("n >= 2")
    found = retrieve.top(h.select("query_id", "doc_id", (F.col("n").cast("double") * F.col("n") / F.col("span")).alias("score")))
    return found.select("query_id", "doc_id", F.round("score", 6).alias("score"), "rank")


@query(
    "SELECT o_orderstatus, count(*) AS queue, count_if(d.k IS NOT NULL) AS completed, count_if(d.k IS NULL) AS pending FROM orders LEFT JOIN (SELECT DISTINCT l_orderkey AS k FROM lineitem WHERE l_returnflag = 'R') d ON d.k = o_orderkey GROUP BY 1"
)
def decision_queue(spark: SparkSession, sf: str) -> DataFrame:
    """A queue with its decisions: what is done and what is pending."""
    d = table(spark, sf, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"), F.lit(True).alias("done")).distinct()
    j = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus").join(d, "o_orderkey", "left")
    return j.groupBy("o_orderstatus").agg(F.count("*").alias("queue"), F.count_if(F.col("done").isNotNull()).alias("completed"), F.count_if(F.col("done").isNull()).alias("pending"))


@query("SELECT 'unknown' AS fault, count(*) AS n FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents) UNION ALL SELECT 'repeated', count(*) FROM (SELECT doc_id FROM labels GROUP BY 1 HAVING count(*) > 1)")
def decision_faults(spark: SparkSession, sf: str) -> DataFrame:
    """Decisions about nothing, and more than one about the same."""
    l = table(spark, sf, "labels").select("doc_id")
    unknown = l.join(table(spark, sf, "documents").select("doc_id"), "doc_id", "left_anti").agg(F.count("*").alias("n")).select(F.lit("unknown").alias("fault"), "n")
    return unknown.union(keep.duplicates(l, "doc_id").agg(F.count("*").alias("n")).select(F.lit("repeated"), "n"))


@query(
    "WITH q AS (SELECT l_partkey, count(*) AS sold FROM lineitem GROUP BY 1) SELECT route, count(*) AS n FROM (SELECT CASE WHEN sold IS NULL THEN 'hold' WHEN p_retailprice < 950 THEN 'merge' ELSE 'new' END AS route FROM part LEFT JOIN q ON l_partkey = p_partkey) GROUP BY route"
)
def registry_routing(spark: SparkSession, sf: str) -> DataFrame:
    """Reviewed records go to new, merge or hold."""
    q = table(spark, sf, "lineitem").groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.count("*").alias("sold"))
    j = table(spark, sf, "part").join(q, "p_partkey", "left")
    return j.groupBy(F.when(F.col("sold").isNull(), "hold").when(F.col("p_retailprice") < 950, "merge").otherwise("new").alias("route")).agg(F.count("*").alias("n"))


@query(
    "SELECT conv_id, count(*) AS observations, sha256(array_to_string(list(turn::VARCHAR || ':' || role || ':' || length(text)::VARCHAR ORDER BY turn), ';')) AS packet FROM conversations GROUP BY conv_id"
)
def packet_assembly(spark: SparkSession, sf: str) -> DataFrame:
    """Each cluster with its observations nested in order, as a digest."""
    c = table(spark, sf, "conversations").groupBy("conv_id").agg(F.count("*").alias("observations"), F.sort_array(F.collect_list(F.struct("turn", "role", F.length("text").alias("n")))).alias("o"))
    line = F.array_join(F.transform("o", lambda x: F.concat_ws(":", x["turn"].cast("string"), x["role"], x["n"].cast("string"))), ";")
    return c.select("conv_id", "observations", F.sha2(line, 256).alias("packet"))


@query(
    "WITH p AS (SELECT p_brand, p_name, count(*) AS n FROM part GROUP BY 1, 2) SELECT p_brand, count(*) AS families, sum(n)::BIGINT AS records, count_if(n >= 2) AS complete, greatest(0, 40 - count(*))::BIGINT AS shortfall FROM p GROUP BY 1"
)
def capacity_audit(spark: SparkSession, sf: str) -> DataFrame:
    """Families, records and what is missing to a quota of 40 families a brand."""
    p = table(spark, sf, "part").groupBy("p_brand", "p_name").agg(F.count("*").alias("n"))
    return p.groupBy("p_brand").agg(F.count("*").alias("families"), F.sum("n").alias("records"), F.count_if(F.col("n") >= 2).alias("complete"), F.greatest(F.lit(0), 40 - F.count("*")).alias("shortfall"))


_ARMS = "UNPIVOT (SELECT query_id, coalesce(sparse_rank, 9999) AS sparse, coalesce(structured_rank, 9999) AS structured, coalesce(rrf_rank, 9999) AS rrf, coalesce(reranker_rank, 9999) AS reranker FROM t WHERE doc_id = expected_id) ON sparse, structured, rrf, reranker INTO NAME arm VALUE rank"


@query(
    with_(*BASE, RERANKED)
    + _TARGETS
    + f", u AS ({_ARMS}), m AS (SELECT arm, count_if(rank = 1) AS top1, round(avg(CASE WHEN rank <= 10 THEN 1.0 / rank ELSE 0 END), 6) AS mrr FROM u GROUP BY arm) SELECT arm, top1, mrr FROM m ORDER BY top1 DESC, mrr DESC, arm LIMIT 1"
)
def winning_arm(spark: SparkSession, sf: str) -> DataFrame:
    """The ranker with most first places, then the better reciprocal rank, then by name."""
    t = titles(spark, sf).where("expected_id is not null").select("query_id", F.col("expected_id").alias("doc_id")).join(reranked(spark, sf), ["query_id", "doc_id"])
    arms = F.explode(F.array(*[F.struct(F.lit(a).alias("arm"), F.col(f"{a}_rank").cast("int").alias("rank")) for a in ("sparse", "structured", "rrf", "reranker")]))
    m = t.select(arms.alias("x")).groupBy("x.arm").agg(F.count_if(F.col("x.rank") == 1).alias("top1"), F.round(measure.mrr_at(F.col("x.rank")), 6).alias("mrr"))
    return m.orderBy(F.col("top1").desc(), F.col("mrr").desc(), "arm").limit(1)


@query(
    "WITH a AS (SELECT vec_id, list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]) AS x FROM embeddings), b AS (SELECT vec_id, list_sum(list_transform(embedding, lambda e: e::DOUBLE * e::DOUBLE)) AS y FROM embeddings) SELECT count(*) AS n, round(max(abs(x - y)), 6) AS delta, count_if(round(x, 6) = round(y, 6)) AS same FROM a JOIN b USING (vec_id)"
)
def score_equivalence(spark: SparkSession, sf: str) -> DataFrame:
    """Two ways to one score: the largest difference and how many agree."""
    e = table(spark, sf, "embeddings")
    a = e.select("vec_id", maths.dot(F.col("embedding"), F.col("embedding")).alias("x"))
    squares = F.transform("embedding", lambda v: v.cast("double") * v.cast("double"))
    b = e.select("vec_id", F.aggregate(squares, F.lit(0.0), lambda s, v: s + v).alias("y"))
    return a.join(b, "vec_id").agg(F.count("*").alias("n"), F.round(F.max(F.abs(F.col("x") - F.col("y"))), 6).alias("delta"), F.count_if(F.round("x", 6) == F.round("y", 6)).alias("same"))


@query(
    "SELECT metric, actual, operator, threshold, actual >= threshold AS passed FROM (SELECT 'documents' AS metric, (SELECT count(*) FROM documents)::DOUBLE AS actual, '>=' AS operator, 100::DOUBLE AS threshold UNION ALL SELECT 'labelled', (SELECT count(*) FROM labels)::DOUBLE, '>=', 50::DOUBLE UNION ALL SELECT 'benchmark', (SELECT count(*) FROM benchmark)::DOUBLE, '>=', 1000::DOUBLE)"
)
def readiness_gates(spark: SparkSession, sf: str) -> DataFrame:
    """Whether the inputs are large enough to begin."""
    m = None
    for name, t in (("documents", "documents"), ("labelled", "labels"), ("benchmark", "benchmark")):
        one = table(spark, sf, t).agg(F.count("*").alias(name))
        m = one if m is None else m.crossJoin(one)
    return measure.gates(m, [("documents", ">=", 100), ("labelled", ">=", 50), ("benchmark", ">=", 1000)])


@query("SELECT event_type, count(*) AS events, count_if(json_exists(props, '$.label') OR json_exists(props, '$.expected')) AS with_labels, count_if(json_exists(props, '$.k')) AS with_k FROM events GROUP BY 1")
def label_blind_check(spark: SparkSession, sf: str) -> DataFrame:
    """Raw payloads must not hold keys that give the answer away."""
    keys = F.json_object_keys("props")
    return table(spark, sf, "events").groupBy("event_type").agg(F.count("*").alias("events"), F.count_if(F.array_contains(keys, "label") | F.array_contains(keys, "expected")).alias("with_labels"), F.count_if(F.array_contains(keys, "k")).alias("with_k"))


@query("SELECT doc_id, source, sha256(text) AS text_digest FROM documents")
def output_blind_projection(spark: SparkSession, sf: str) -> DataFrame:
    """Only the columns that a blind reviewer may see."""
    return table(spark, sf, "documents").select("doc_id", "source", F.sha2("text", 256).alias("text_digest"))


@query(
    "WITH d AS (SELECT date_trunc('day', ts)::DATE::VARCHAR AS day, event_type, count(*) AS n FROM events GROUP BY 1, 2) SELECT day, event_type, n, sum(n) OVER (PARTITION BY event_type ORDER BY day ROWS UNBOUNDED PRECEDING)::BIGINT AS so_far FROM d"
)
def review_progress(spark: SparkSession, sf: str) -> DataFrame:
    """What was done each day and up to it."""
    d = table(spark, sf, "events").groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day"), "event_type").agg(F.count("*").alias("n"))
    return d.withColumn("so_far", F.sum("n").over(Window.partitionBy("event_type").orderBy("day").rowsBetween(Window.unboundedPreceding, 0)))


@query(
    "WITH h AS (SELECT p_brand, p_name, p_partkey, sha256('pack' || chr(10) || p_partkey::VARCHAR) AS h FROM part), "
    "one AS (SELECT * FROM h QUALIFY row_number() OVER (PARTITION BY p_brand, p_name ORDER BY h) = 1) "
    "SELECT p_brand, p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY h) AS place FROM one QUALIFY place <= 10"
)
def challenge_pack(spark: SparkSession, sf: str) -> DataFrame:
    """Ten cases of each brand in a salted order, no name twice."""
    p = table(spark, sf, "part").select("p_brand", "p_name", "p_partkey", hashing.salted("pack", F.col("p_partkey")).alias("h"))
    one = p.withColumn("rn", F.row_number().over(Window.partitionBy("p_brand", "p_name").orderBy("h"))).where("rn = 1")
    return one.withColumn("place", F.row_number().over(Window.partitionBy("p_brand").orderBy("h"))).where("place <= 10").select("p_brand", "p_partkey", "place")


@query(
    "SELECT column_name, lower(data_type) LIKE '%int%' AS whole FROM (DESCRIBE SELECT * FROM part) d(column_name, data_type, a, b, c, e)"
)
def schema_introspection(spark: SparkSession, sf: str) -> DataFrame:
    """The columns of a table and whether they hold whole numbers."""
    from lodeweave.operators.schema import columns_of

    return columns_of(table(spark, sf, "part")).select("column_name", F.col("data_type").rlike("int").alias("whole"))


@query(
    with_(*BASE, FEATURES, DECIDED)
    + " SELECT expected_id IS NULL AS absent, count(*) AS cases, count_if(status = 'matched') AS accepted, count_if(status = 'matched' AND top_id = expected_id) AS exact, count_if(status = 'ambiguous') AS ambiguous, count_if(status = 'no_match') AS refused FROM decided GROUP BY 1"
)
def balanced_summary(spark: SparkSession, sf: str) -> DataFrame:
    """What became of titles that are in the catalogue and of those that are not."""
    d = resolve_decisions(spark, sf).join(titles(spark, sf).select("query_id", "expected_id"), "query_id")
    matched = F.col("status") == "matched"
    return d.groupBy(F.col("expected_id").isNull().alias("absent")).agg(
        F.count("*").alias("cases"), F.count_if(matched).alias("accepted"), F.count_if(matched & (F.col("doc_id") == F.col("expected_id"))).alias("exact"), F.count_if(F.col("status") == "ambiguous").alias("ambiguous"), F.count_if(F.col("status") == "no_match").alias("refused")
    )


@query()
def raw_token_offsets(spark: SparkSession, sf: str) -> DataFrame:
    """Normalised words of the titles with their places in the titles as written."""
    from lodeweave.functions import exact

    t = titles(spark, sf).select("query_id", F.explode(exact.token_offsets("title")).alias("x"))
    return t.select("query_id", "x.token", "x.start", "x.end")


@query("SELECT 'family-' || printf('%04d', i) AS knowledge_id, 'Family ' || i::VARCHAR || ' ' || (['coupe', 'sedan', 'wagon'])[i % 3 + 1] AS casting, sha256('family' || chr(10) || i::VARCHAR)[1:8] AS alias FROM range(3000) r(i)")
def synthetic_families(spark: SparkSession, sf: str) -> DataFrame:
    """3,000 made-up documents, for tests of scale."""
    i = F.col("id")
    kind = F.get(F.array(F.lit("coupe"), F.lit("sedan"), F.lit("wagon")), (i % 3).cast("int"))
    return spark.range(3000).select(F.format_string("family-%04d", i).alias("knowledge_id"), F.concat(F.lit("Family "), i.cast("string"), F.lit(" "), kind).alias("casting"), F.substring(hashing.salted("family", i), 1, 8).alias("alias"))


_JSON = """
j AS (SELECT event_id, CASE event_id % 5 WHEN 0 THEN '{"a":{"Expected_id":1},"labels_loaded":false}' WHEN 1 THEN '{"b":[{"x":{"label":2}},{"x":1}],"labels_loaded":false}' WHEN 2 THEN '{"a":1,"a":2,"c":{"d":1,"d":1}}'
  WHEN 3 THEN '{"labels_loaded":false,"inner":{"labels_loaded":false}}' ELSE '{"k":' || event_id::VARCHAR END AS payload FROM events)"""


@query(
    with_(_JSON)
    + " SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'forbidden $.a.Expected_id' WHEN 1 THEN 'forbidden $.b[0].x.label' WHEN 2 THEN 'duplicate $.a;duplicate $.c.d' WHEN 3 THEN 'forbidden $.inner.labels_loaded' ELSE 'invalid' END AS faults FROM j"
)
def json_walk(spark: SparkSession, sf: str) -> DataFrame:
    """Forbidden keys of any depth, repeated keys and broken texts among made-up payloads."""
    n = F.col("event_id") % 5
    texts = ['{"a":{"Expected_id":1},"labels_loaded":false}', '{"b":[{"x":{"label":2}},{"x":1}],"labels_loaded":false}', '{"a":1,"a":2,"c":{"d":1,"d":1}}', '{"labels_loaded":false,"inner":{"labels_loaded":false}}']
    payload = F.concat(F.lit('{"k":'), F.col("event_id").cast("string"))
    for i, t in reversed(list(enumerate(texts))):
        payload = F.when(n == i, F.lit(t)).otherwise(payload)
    e = table(spark, sf, "events").select("event_id", payload.alias("payload"))
    return e.select("event_id", F.array_join(exact.json_faults("payload", {"label", "expected"}, {"labels_loaded"}), ";").alias("faults"))
