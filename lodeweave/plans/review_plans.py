"""Queries over constraints, upserts, review queues, ledgers, mining and staged rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodeweave.functions import hashing, text
from lodeweave.operators import keep
from lodeweave.operators.graph import shared_key_components
from lodeweave.plans.frames import CATALOG, NORMALIZED, SIGNALS, TITLES, catalog, query_signals, table, titles, with_

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return register


@query("SELECT p_name, p_brand, p_type, p_size, count(*) AS n FROM part GROUP BY ALL HAVING n > 1")
def natural_key_collisions(spark: SparkSession, sf: str) -> DataFrame:
    return keep.duplicates(table(spark, sf, "part"), "p_name", "p_brand", "p_type", "p_size")


@query("SELECT 'part' AS tab, count(*) - count(DISTINCT p_partkey) AS extra FROM part UNION ALL SELECT 'orders', count(*) - count(DISTINCT o_orderkey) FROM orders UNION ALL SELECT 'documents', count(*) - count(DISTINCT doc_id) FROM documents")
def key_uniqueness_violations(spark: SparkSession, sf: str) -> DataFrame:
    out = [table(spark, sf, t).agg((F.count("*") - F.countDistinct(k)).alias("extra")).select(F.lit(t).alias("tab"), "extra") for t, k in (("part", "p_partkey"), ("orders", "o_orderkey"), ("documents", "doc_id"))]
    return out[0].union(out[1]).union(out[2])


_SPLIT = "CASE WHEN CAST('0x' || substr(sha256('leak' || chr(10) || CAST({0} AS VARCHAR)), 1, 8) AS BIGINT) / 4294967296.0 < 0.5 THEN 'a' ELSE 'b' END"


@query(f"SELECT p_name, count(DISTINCT split) AS sides FROM (SELECT p_name, {_SPLIT.format('p_partkey')} AS split FROM part) GROUP BY p_name HAVING sides > 1")
def split_leakage(spark: SparkSession, sf: str) -> DataFrame:
    """Families that a split by row puts on both sides."""
    rows = table(spark, sf, "part").select("p_name", F.when(hashing.hash_unit("leak", F.col("p_partkey")) < 0.5, "a").otherwise("b").alias("split"))
    return keep.shared_between(rows, "p_name", "split")


@query(f"SELECT c_mktsegment, count(*) AS n FROM customer WHERE c_custkey IN (SELECT c_custkey FROM customer WHERE {_SPLIT.format('c_custkey')} = 'a' INTERSECT SELECT o_custkey FROM orders) GROUP BY 1")
def split_intersection(spark: SparkSession, sf: str) -> DataFrame:
    """Customers of one side that orders name as well: a set intersection."""
    c = table(spark, sf, "customer")
    a = c.where(hashing.hash_unit("leak", F.col("c_custkey")) < 0.5).select("c_custkey").intersect(table(spark, sf, "orders").select(F.col("o_custkey").alias("c_custkey")))
    return c.join(a, "c_custkey", "left_semi").groupBy("c_mktsegment").agg(F.count("*").alias("n"))


_NEW = "SELECT p_partkey + 50 AS p_partkey, p_brand, p_name, CASE WHEN p_size > 25 THEN p_size + 1 ELSE p_size END AS p_size FROM part UNION ALL SELECT p_partkey, p_brand, p_name, p_size FROM part WHERE p_partkey < 50"


def _versions(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Parts, and a new version: some changed, some gone, some added."""
    old = table(spark, sf, "part").select("p_partkey", "p_brand", "p_name", "p_size")
    new = old.withColumn("p_size", F.when(F.col("p_size") > 40, F.col("p_size") + 1).otherwise(F.col("p_size"))).where("p_size <> 7")
    added = old.where("p_size = 3").withColumn("p_partkey", F.col("p_partkey") + 1_000_000_000)
    return old, new.unionByName(added)


_OLD_NEW = """old AS (SELECT p_partkey, p_brand, p_name, p_size FROM part),
new AS (SELECT p_partkey, p_brand, p_name, CASE WHEN p_size > 40 THEN p_size + 1 ELSE p_size END AS p_size FROM part WHERE p_size <> 7 UNION ALL SELECT p_partkey + 1000000000, p_brand, p_name, p_size FROM part WHERE p_size = 3)"""


@query(
    f"WITH {_OLD_NEW} SELECT coalesce(o.p_partkey, n.p_partkey) AS p_partkey, CASE WHEN o.p_partkey IS NULL THEN 'insert' WHEN n.p_partkey IS NULL THEN 'delete' WHEN (o.p_brand, o.p_name, o.p_size) IS NOT DISTINCT FROM (n.p_brand, n.p_name, n.p_size) THEN 'unchanged' ELSE 'update' END AS action FROM old o FULL JOIN new n ON o.p_partkey = n.p_partkey"
)
def upsert_plan(spark: SparkSession, sf: str) -> DataFrame:
    old, new = _versions(spark, sf)
    return keep.diff(old, new, ["p_partkey"], ["p_brand", "p_name", "p_size"]).select("p_partkey", "action")


@query(f"WITH {_OLD_NEW} SELECT coalesce(n.p_partkey, o.p_partkey) AS p_partkey, coalesce(n.p_size, o.p_size) AS p_size FROM old o FULL JOIN new n ON o.p_partkey = n.p_partkey")
def upsert_result(spark: SparkSession, sf: str) -> DataFrame:
    old, new = _versions(spark, sf)
    return keep.upserted(old, new, ["p_partkey"], ["p_brand", "p_name", "p_size"]).select("p_partkey", "p_size")


@query(
    f"WITH {_OLD_NEW}, a AS (SELECT p_partkey, unnest(string_split(p_name, ' ')) AS alias FROM old), b AS (SELECT p_partkey, unnest(string_split(p_name || CASE WHEN p_size > 40 THEN ' deluxe' ELSE '' END, ' ')) AS alias FROM new) "
    "SELECT action, count(*) AS n FROM (SELECT CASE WHEN a.alias IS NULL THEN 'insert' WHEN b.alias IS NULL THEN 'delete' ELSE 'unchanged' END AS action FROM a FULL JOIN b ON a.p_partkey = b.p_partkey AND a.alias = b.alias) GROUP BY action"
)
def child_sync_plan(spark: SparkSession, sf: str) -> DataFrame:
    """What has to happen to the aliases of changed records."""
    old, new = _versions(spark, sf)
    a = old.select("p_partkey", F.explode(F.split("p_name", " ")).alias("alias")).withColumn("v", F.lit(1))
    named = F.when(F.col("p_size") > 40, F.concat("p_name", F.lit(" deluxe"))).otherwise(F.col("p_name"))
    b = new.select("p_partkey", F.explode(F.split(named, " ")).alias("alias")).withColumn("v", F.lit(1))
    return keep.diff(a, b, ["p_partkey", "alias"], ["v"]).groupBy("action").agg(F.count("*").alias("n"))


@query(f"WITH {_OLD_NEW} SELECT side, count(*) AS n FROM (SELECT 'left' AS side FROM (SELECT * FROM old EXCEPT ALL SELECT * FROM new) UNION ALL SELECT 'right' FROM (SELECT * FROM new EXCEPT ALL SELECT * FROM old)) GROUP BY side")
def version_diff(spark: SparkSession, sf: str) -> DataFrame:
    return keep.same_set(*_versions(spark, sf)).groupBy("side").agg(F.count("*").alias("n"))


@query("SELECT c_mktsegment, count(*) AS absent, round(sum(c_acctbal), 2) AS balance FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey) GROUP BY 1")
def no_match_candidates(spark: SparkSession, sf: str) -> DataFrame:
    """Customers that no order names, an anti-join."""
    c = table(spark, sf, "customer").join(table(spark, sf, "orders").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_anti")
    return c.groupBy("c_mktsegment").agg(F.count("*").alias("absent"), F.round(F.sum("c_acctbal"), 2).alias("balance"))


@query(with_(CATALOG, TITLES) + " SELECT query_id, expected_id IS NOT NULL AND expected_id IN (SELECT doc_id FROM catalog) AS present FROM titles")
def absent_truth_check(spark: SparkSession, sf: str) -> DataFrame:
    """Whether what each title claims to be is in the catalogue."""
    t = titles(spark, sf)
    there = t.join(catalog(spark, sf).select(F.col("doc_id").alias("expected_id")), "expected_id", "left_semi").select("query_id", F.lit(True).alias("present"))
    return t.select("query_id").join(there, "query_id", "left").select("query_id", F.coalesce("present", F.lit(False)).alias("present"))


@query(
    f"SELECT p_partkey FROM part WHERE sha256({NORMALIZED.format('p_name')}) NOT IN (SELECT sha256({NORMALIZED.format('p_name')}) FROM part WHERE p_size = 50) AND p_brand NOT IN (SELECT 'Brand#' || n_nationkey FROM nation WHERE n_regionkey = 0)"
)
def denylist_exclusion(spark: SparkSession, sf: str) -> DataFrame:
    """Parts outside two lists, one by hash and one by key."""
    p = table(spark, sf, "part").withColumn("h", F.sha2(text.normalize(F.col("p_name")), 256))
    hashes = p.where("p_size = 50").select("h").distinct()
    brands = table(spark, sf, "nation").where("n_regionkey = 0").select(F.concat(F.lit("Brand#"), F.col("n_nationkey").cast("string")).alias("p_brand"))
    return p.join(hashes, "h", "left_anti").join(brands, "p_brand", "left_anti").select("p_partkey")


@query(
    """WITH k AS (SELECT p_brand, p_name, count(*) AS records, count(DISTINCT p_type) AS types, array_to_string(list_sort(list(DISTINCT p_type)), ',') AS labels, min(p_size) AS low, max(p_size) AS high FROM part GROUP BY 1, 2),
c AS (SELECT DISTINCT p_brand, p_name FROM part WHERE p_retailprice < 950), h AS (SELECT DISTINCT p_brand, p_name FROM part WHERE p_size > 25)
SELECT k.p_brand, k.p_name, records, labels, low, high, types > 1 AS collision, CASE WHEN c.p_name IS NOT NULL AND h.p_name IS NOT NULL THEN 'exact_both' WHEN c.p_name IS NOT NULL THEN 'canonical_only' WHEN h.p_name IS NOT NULL THEN 'human_only' ELSE 'none' END AS status,
 CASE WHEN c.p_name IS NOT NULL AND h.p_name IS NOT NULL THEN 1 WHEN c.p_name IS NOT NULL THEN 2 WHEN h.p_name IS NOT NULL THEN 3 WHEN types > 1 THEN 4 ELSE 5 END::INTEGER AS priority
FROM k LEFT JOIN c ON c.p_brand = k.p_brand AND c.p_name = k.p_name LEFT JOIN h ON h.p_brand = k.p_brand AND h.p_name = k.p_name"""
)
def casting_review_queue(spark: SparkSession, sf: str) -> DataFrame:
    """One row a (brand, name) with its labels, spread, status against two other sources, and priority."""
    p = table(spark, sf, "part")
    key = ["p_brand", "p_name"]
    k = p.groupBy(*key).agg(F.count("*").alias("records"), F.countDistinct("p_type").alias("types"), F.array_join(F.array_sort(F.collect_set("p_type")), ",").alias("labels"), F.min("p_size").alias("low"), F.max("p_size").alias("high"))
    c = p.where("p_retailprice < 950").select(*key).distinct().withColumn("c", F.lit(True))
    h = p.where("p_size > 25").select(*key).distinct().withColumn("h", F.lit(True))
    both, one, other = F.col("c") & F.col("h"), F.col("c"), F.col("h")
    j = k.join(c, key, "left").join(h, key, "left")
    return j.select(
        *key, "records", "labels", "low", "high", (F.col("types") > 1).alias("collision"),
        F.when(both, "exact_both").when(one, "canonical_only").when(other, "human_only").otherwise("none").alias("status"),
        F.when(both, 1).when(one, 2).when(other, 3).when(F.col("types") > 1, 4).otherwise(5).alias("priority"),
    )


@query(
    "WITH f AS (SELECT p_name, count(*) AS n, min(p_partkey) AS only_id FROM part GROUP BY 1), s AS (SELECT s_suppkey, (SELECT p_name FROM part WHERE p_partkey = s_suppkey) AS p_name FROM supplier) "
    "SELECT s_suppkey, CASE WHEN f.p_name IS NULL THEN 'unmapped' WHEN n = 1 THEN 'mapped' ELSE 'family_only' END AS status, CASE WHEN n = 1 THEN only_id END AS p_partkey FROM s LEFT JOIN f USING (p_name)"
)
def alignment_status(spark: SparkSession, sf: str) -> DataFrame:
    """Whether a name leads to one record, a family of several, or none."""
    p = table(spark, sf, "part")
    f = p.groupBy("p_name").agg(F.count("*").alias("n"), F.min("p_partkey").alias("only_id"))
    s = table(spark, sf, "supplier").select("s_suppkey").join(p.select(F.col("p_partkey").alias("s_suppkey"), "p_name"), "s_suppkey", "left").join(f, "p_name", "left")
    return s.select("s_suppkey", F.when(F.col("n").isNull(), "unmapped").when(F.col("n") == 1, "mapped").otherwise("family_only").alias("status"), F.when(F.col("n") == 1, F.col("only_id")).alias("p_partkey"))


@query(
    "WITH v AS (SELECT p_brand, p_name, p_type, count(*) AS n FROM part GROUP BY 1, 2, 3), c AS (SELECT p_brand, p_name, array_to_string(list_sort(list(p_type || ':' || n::VARCHAR)), ',') AS variants FROM v GROUP BY 1, 2) "
    "SELECT p_brand, count(*) AS castings, " + hashing.content_digest_sql("p_name || '[' || variants || ']'") + " AS digest FROM c GROUP BY p_brand"
)
def nested_catalog(spark: SparkSession, sf: str) -> DataFrame:
    """Variants nested in castings nested in brands, as a digest of the nested text."""
    v = table(spark, sf, "part").groupBy("p_brand", "p_name", "p_type").agg(F.count("*").alias("n"))
    c = v.groupBy("p_brand", "p_name").agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws(":", "p_type", F.col("n").cast("string")))), ",").alias("variants"))
    line = F.concat("p_name", F.lit("["), "variants", F.lit("]"))
    return c.groupBy("p_brand").agg(F.count("*").alias("castings"), hashing.content_digest(line).alias("digest"))


@query(
    """WITH RECURSIVE k AS (SELECT s_suppkey, 'n' || s_nationkey::VARCHAR AS key FROM supplier UNION ALL SELECT s_suppkey, 'b' || floor(s_acctbal / 250)::INTEGER::VARCHAR FROM supplier),
e AS (SELECT DISTINCT a.s_suppkey AS u, b.s_suppkey AS v FROM k a JOIN k b ON a.key = b.key),
r AS (SELECT u AS node, u AS label FROM e UNION SELECT e.v, r.label FROM r JOIN e ON e.u = r.node WHERE r.label <= e.v)
SELECT node AS s_suppkey, min(label) AS component FROM r GROUP BY node"""
)
def case_components(spark: SparkSession, sf: str) -> DataFrame:
    """Suppliers linked by a shared nation or a shared step of their balance."""
    s = table(spark, sf, "supplier")
    keys = F.array(F.concat(F.lit("n"), F.col("s_nationkey").cast("string")), F.concat(F.lit("b"), F.floor(F.col("s_acctbal") / 250).cast("int").cast("string")))
    return shared_key_components(s.select(F.col("s_suppkey").alias("node"), F.explode(keys).alias("key"))).select(F.col("node").alias("s_suppkey"), F.col("label").alias("component"))


@query(
    "WITH c AS (SELECT *, row_number() OVER w AS ordinal, lag(event_type) OVER w AS before FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) "
    "SELECT user_id, count(*) AS violations, min(ordinal)::INTEGER AS first_at FROM c WHERE NOT (before IS NULL OR (before = 'view' AND event_type = 'click') OR (before = 'click' AND event_type = 'purchase') OR event_type = 'view') GROUP BY user_id"
)
def event_chain_audit(spark: SparkSession, sf: str) -> DataFrame:
    """Users' events that no allowed step leads to."""
    kinds = ("view", "click", "purchase", "signup", "error")
    allowed = [(None, k) for k in kinds] + [("view", "click"), ("click", "purchase")] + [(k, "view") for k in kinds]
    bad = keep.audited(table(spark, sf, "events"), "user_id", ["ts", "event_id"], "event_type", allowed)
    return bad.groupBy("user_id").agg(F.count("*").alias("violations"), F.min("ordinal").alias("first_at"))


@query("SELECT user_id, count(*) AS events, min(h) AS first_hash FROM (SELECT user_id, sha256(concat_ws(chr(31), event_id::VARCHAR, user_id::VARCHAR, event_type)) AS h FROM events) GROUP BY user_id")
def append_only_ledger(spark: SparkSession, sf: str) -> DataFrame:
    """A ledger to which the same batch is added twice: the second time changes nothing."""
    e = table(spark, sf, "events").select("event_id", "user_id", "event_type").withColumn("h", keep.event_hash("event_id", "user_id", "event_type"))
    first = e.where("event_type = 'view'")
    ledger = keep.append_once(keep.append_once(first, e, "h"), e, "h")
    return ledger.groupBy("user_id").agg(F.count("*").alias("events"), F.min("h").alias("first_hash"))


@query("SELECT date_trunc('day', ts)::DATE::VARCHAR AS day, count(*) AS events, " + hashing.content_digest_sql("event_id::VARCHAR") + " AS digest FROM events GROUP BY 1")
def idempotent_batches(spark: SparkSession, sf: str) -> DataFrame:
    """The content digest by which an import of a day is known as done."""
    e = table(spark, sf, "events").groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day"))
    return e.agg(F.count("*").alias("events"), hashing.content_digest(F.col("event_id").cast("string")).alias("digest"))


@query("SELECT event_id, upper(trim(event_type)) AS kind, TRY_CAST(json_extract_string(props, '$.k') AS INTEGER) AS k, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS collected_at, CASE WHEN value < 0 THEN 'rejected' ELSE 'accepted' END AS status FROM events")
def staging_normalize(spark: SparkSession, sf: str) -> DataFrame:
    """Raw rows trimmed, typed and gated."""
    e = table(spark, sf, "events")
    k = F.expr("try_cast(get_json_object(props, '$.k') AS int)")
    return e.select("event_id", F.upper(F.trim("event_type")).alias("kind"), k.alias("k"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("collected_at"), F.when(F.col("value") < 0, "rejected").otherwise("accepted").alias("status"))


@query("SELECT count(*) AS labels, count_if(doc_id IN (SELECT doc_id FROM documents)) AS known, (SELECT count(*) FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)) AS unlabelled FROM labels")
def csv_overlap_audit(spark: SparkSession, sf: str) -> DataFrame:
    """Ids on both sides, and on one only."""
    d, l = table(spark, sf, "documents").select("doc_id"), table(spark, sf, "labels").select("doc_id")
    known = l.join(d, "doc_id", "left_semi").agg(F.count("*").alias("known"))
    rest = d.join(l, "doc_id", "left_anti").agg(F.count("*").alias("unlabelled"))
    return l.agg(F.count("*").alias("labels")).crossJoin(known).crossJoin(rest)


@query("SELECT o_orderpriority, " + ", ".join(f"count_if(year(o_orderdate) = {y}) AS y{y}" for y in range(1995, 2002)) + " FROM orders GROUP BY 1")
def split_year_crosstab(spark: SparkSession, sf: str) -> DataFrame:
    years = list(range(1995, 2002))
    p = table(spark, sf, "orders").withColumn("y", F.year("o_orderdate").cast("string")).groupBy("o_orderpriority").pivot("y", [str(y) for y in years]).count().fillna(0)
    return p.select("o_orderpriority", *[F.col(f"`{y}`").alias(f"y{y}") for y in years])


@query("SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS quantity FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)")
def snapshot_counts(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem").rollup("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("quantity"))


@query(
    "WITH a AS (SELECT p_brand, p_name, count(*) AS n FROM part GROUP BY 1, 2) SELECT p_name, count(*) AS owners, sum(n)::BIGINT AS records, count(*) > 1 AS collision FROM a GROUP BY p_name"
)
def authority_inventory(spark: SparkSession, sf: str) -> DataFrame:
    """Names by how many brands lay claim to them."""
    a = table(spark, sf, "part").groupBy("p_brand", "p_name").agg(F.count("*").alias("n"))
    return a.groupBy("p_name").agg(F.count("*").alias("owners"), F.sum("n").alias("records"), (F.count("*") > 1).alias("collision"))


@query(
    "SELECT o.o_orderpriority, count(*) AS orders, count_if(n >= 3) AS with_three, count_if(coalesce(n, 0) = 0) AS without FROM orders o LEFT JOIN (SELECT l_orderkey, count(DISTINCT l_suppkey) AS n FROM lineitem GROUP BY 1) l ON l_orderkey = o_orderkey GROUP BY 1"
)
def evidence_completeness(spark: SparkSession, sf: str) -> DataFrame:
    """Orders by how many independent sources (suppliers) stand behind them."""
    n = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.countDistinct("l_suppkey").alias("n"))
    j = table(spark, sf, "orders").join(n, "o_orderkey", "left")
    return j.groupBy("o_orderpriority").agg(F.count("*").alias("orders"), F.count_if(F.col("n") >= 3).alias("with_three"), F.count_if(F.coalesce("n", F.lit(0)) == 0).alias("without"))


@query(
    with_(CATALOG, TITLES, SIGNALS)
    + ", p AS (SELECT query_id, doc_id, year, release_year FROM signals JOIN catalog ON collector = collector_number) SELECT query_id, doc_id, CASE WHEN year IS NULL AND release_year IS NULL THEN 'none' WHEN year IS NULL THEN 'candidate_only' WHEN release_year IS NULL THEN 'query_only' WHEN year = release_year THEN 'equal' WHEN year % 100 = release_year % 100 THEN 'year_suffix' ELSE 'conflict' END AS relation FROM p"
)
def numeric_relation(spark: SparkSession, sf: str) -> DataFrame:
    """How the years of a title and of the record with its number stand to each other."""
    p = query_signals(spark, sf).join(catalog(spark, sf), F.col("collector") == F.col("collector_number"))
    y, r = F.col("year"), F.col("release_year")
    relation = F.when(y.isNull() & r.isNull(), "none").when(y.isNull(), "candidate_only").when(r.isNull(), "query_only").when(y == r, "equal").when(y % 100 == r % 100, "year_suffix").otherwise("conflict")
    return p.select("query_id", "doc_id", relation.alias("relation"))


@query(
    "SELECT page_id, regexp_extract(url, '^https?://([^/:?#]+)', 1) AS host, url LIKE 'https://%' AS secure, regexp_matches(url, '^https?://[^/]*example\\.net') AS independent FROM pages"
)
def source_rules(spark: SparkSession, sf: str) -> DataFrame:
    """Whether a source is secure and of an independent host."""
    host = F.parse_url("url", F.lit("HOST"))
    return table(spark, sf, "pages").select("page_id", host.alias("host"), F.col("url").startswith("https://").alias("secure"), host.endswith("example.net").alias("independent"))


@query(
    "WITH s AS (SELECT c_mktsegment, c_custkey, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal DESC, c_custkey) AS rn, sum(c_acctbal) OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal DESC, c_custkey ROWS UNBOUNDED PRECEDING) AS running FROM customer) "
    "SELECT c_mktsegment, c_custkey, rn, round(running, 2) AS running FROM s WHERE rn <= 15"
)
def capped_selection(spark: SparkSession, sf: str) -> DataFrame:
    """At most 15 of each segment by a fixed order, with the running total."""
    w = Window.partitionBy("c_mktsegment").orderBy(F.col("c_acctbal").desc(), "c_custkey")
    s = table(spark, sf, "customer").select("c_mktsegment", "c_custkey", F.row_number().over(w).alias("rn"), F.sum("c_acctbal").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("running"))
    return s.where("rn <= 15").select("c_mktsegment", "c_custkey", "rn", F.round("running", 2).alias("running"))


@query(
    "SELECT conv_id, turn, last_value(CASE WHEN role = 'user' THEN turn END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS user_before, first_value(CASE WHEN role = 'user' THEN turn END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS user_after FROM conversations"
)
def nearest_owner(spark: SparkSession, sf: str) -> DataFrame:
    """The nearest user turn at or before, and at or after, each turn."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    mine = F.when(F.col("role") == "user", F.col("turn"))
    return table(spark, sf, "conversations").select(
        "conv_id", "turn", F.last(mine, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("user_before"), F.first(mine, ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing)).alias("user_after")
    )


@query("SELECT p_brand, count(*) AS n, array_to_string(list_sort(list(DISTINCT p_type)), ',') AS vocabulary FROM part GROUP BY p_brand")
def vocabulary_collect(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").groupBy("p_brand").agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_set("p_type")), ",").alias("vocabulary"))


@query(
    "WITH p AS (SELECT conv_id, min(CASE WHEN role = 'user' THEN length(text) END) AS user_least, min(CASE WHEN role = 'assistant' THEN length(text) END) AS assistant_least, count(*) AS turns FROM conversations GROUP BY conv_id) "
    "SELECT conv_id, user_least, assistant_least, user_least IS NOT NULL AND assistant_least IS NOT NULL AS paired FROM p"
)
def paired_sources(spark: SparkSession, sf: str) -> DataFrame:
    """Rows of two sources that belong together, side by side."""
    p = table(spark, sf, "conversations").groupBy("conv_id").pivot("role", ["user", "assistant"]).agg(F.min(F.length("text")).cast("long"))
    return p.select("conv_id", F.col("user").alias("user_least"), F.col("assistant").alias("assistant_least"), (F.col("user").isNotNull() & F.col("assistant").isNotNull()).alias("paired"))


@query("SELECT c_custkey, r_name, o.n AS orders FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) o ON o_custkey = c_custkey")
def lookup_binding(spark: SparkSession, sf: str) -> DataFrame:
    """Labels bound by key lookups, with the count of what refers to each row."""
    n = table(spark, sf, "nation").join(table(spark, sf, "region"), F.col("r_regionkey") == F.col("n_regionkey")).select(F.col("n_nationkey").alias("c_nationkey"), "r_name")
    o = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("orders"))
    return table(spark, sf, "customer").join(n, "c_nationkey").join(o, "c_custkey", "left").select("c_custkey", "r_name", "orders")
