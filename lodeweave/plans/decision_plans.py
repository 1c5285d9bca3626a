"""Queries over decisions, evaluation, calibration and thresholds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodeweave.functions import exact, maths
from lodeweave.operators import decide, measure
from lodeweave.plans.frames import catalog, query_signals, table, titles, with_, pool
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


_W = decide.FUSION_WEIGHTS
FEATURES = """
scored AS (SELECT *, rrf_score * 20.0 + 0.10 * len(matches) - 0.12 * len(conflicts) AS s FROM evidence),
lead AS (SELECT *, s - coalesce(lead(s) OVER (PARTITION BY query_id ORDER BY rrf_rank), 0) AS m, count(*) OVER (PARTITION BY query_id) AS n FROM scored),
features AS (SELECT t.query_id, t.title, t.expected_id, doc_id AS top_id, coalesce(s, 0) AS top1_score, coalesce(m, 0) AS margin, coalesce(support / 3.0, 0) AS source_support,
  coalesce(len(matches), 0)::DOUBLE AS match_count, coalesce(len(conflicts), 0)::DOUBLE AS conflict_count, coalesce(n, 0) AS candidates
  FROM titles t LEFT JOIN (SELECT * FROM lead WHERE rrf_rank = 1) b USING (query_id))"""
DECIDED = f"""
confident AS (SELECT *, 1 / (1 + exp(-greatest(-40, least(40, {decide.FUSION_INTERCEPT} + {_W[0]} * top1_score + {_W[1]} * margin + {_W[2]} * source_support + {_W[3]} * match_count + {_W[4]} * conflict_count)))) AS confidence FROM features),
decided AS (SELECT *, CASE WHEN reason IN ('no_candidates', 'no_candidate_above_threshold') THEN 'no_match' WHEN reason = 'score_and_margin_above_threshold' THEN 'matched' ELSE 'ambiguous' END AS status FROM (
  SELECT *, CASE WHEN candidates = 0 THEN 'no_candidates' WHEN confidence < 0.32 OR top1_score <= 0 THEN 'no_candidate_above_threshold' WHEN conflict_count > 2 THEN 'too_many_attribute_conflicts'
    WHEN confidence < 0.67 THEN 'confidence_below_match_threshold' WHEN candidates > 1 AND round(margin, 10) < 0.08 THEN 'top1_top2_margin_too_small' ELSE 'score_and_margin_above_threshold' END AS reason FROM confident))"""


@query(with_(*BASE, FEATURES) + " SELECT query_id, round(top1_score, 6) AS top1_score, round(margin, 6) AS margin, round(source_support, 6) AS source_support, match_count, conflict_count FROM features")
def margin_features(spark: SparkSession, sf: str) -> DataFrame:
    s = query_signals(spark, sf)
    f = decide.features(s.select("query_id"), pool(spark, sf, s))
    return f.select("query_id", *[F.round(n, 6).alias(n) for n in ("top1_score", "margin", "source_support")], "match_count", "conflict_count")


@query(with_(*BASE, FEATURES, DECIDED) + " SELECT query_id, title, CASE WHEN status = 'matched' THEN top_id END AS doc_id, status, reason, round(confidence, 6) AS confidence FROM decided")
def resolve_decisions(spark: SparkSession, sf: str) -> DataFrame:
    """Every title resolved: the flagship."""
    d = decide.resolve(query_signals(spark, sf), catalog(spark, sf), embed=exact.embed_md5)
    return d.select("query_id", "title", F.when(F.col("status") == "matched", F.col("top_id")).alias("doc_id"), "status", "reason", F.round("confidence", 6).alias("confidence"))


@query(
    with_(*BASE, FEATURES, DECIDED)
    + """, r AS (SELECT d.*, (SELECT min(rrf_rank) FROM evidence e WHERE e.query_id = d.query_id AND e.doc_id = d.expected_id) AS rank FROM decided d)
SELECT count(*) AS sample_count, count(expected_id) AS matched_count, round(avg(CASE WHEN expected_id IS NOT NULL THEN coalesce((rank <= 10)::INTEGER, 0) END), 6) AS recall_at_10,
  round(avg(CASE WHEN expected_id IS NOT NULL THEN coalesce((rank <= 25)::INTEGER, 0) END), 6) AS recall_at_25, round(avg(CASE WHEN expected_id IS NOT NULL THEN coalesce((rank = 1)::INTEGER, 0) END), 6) AS top1_accuracy,
  round(avg(CASE WHEN expected_id IS NOT NULL THEN CASE WHEN rank <= 10 THEN 1.0 / rank ELSE 0 END END), 6) AS mrr_at_10,
  round(count_if(status = 'matched' AND top_id = expected_id) / nullif(count_if(status = 'matched'), 0), 6) AS precision, round(count_if(status = 'matched' AND top_id = expected_id) / nullif(count(expected_id), 0), 6) AS coverage,
  round(count_if(status = 'matched' AND expected_id IS NULL) / nullif(count_if(expected_id IS NULL), 0), 6) AS false_match_rate, round(count_if(status <> 'matched') / count(*), 6) AS abstention_rate FROM r"""
)
def recall_mrr_report(spark: SparkSession, sf: str) -> DataFrame:
    """The evaluation report in one pass over the decisions."""
    s, c = query_signals(spark, sf), catalog(spark, sf)
    found = pool(spark, sf, s)
    d = decide.decide(decide.features(s.select("query_id", "title", "expected_id"), found).withColumn("confidence", decide.probability()))
    target = found.select("query_id", F.col("doc_id").alias("expected_id"), F.col("rrf_rank").alias("rank"))
    r = d.join(target, ["query_id", "expected_id"], "left")
    known, matched = F.col("expected_id").isNotNull(), F.col("status") == "matched"
    correct = F.count_if(matched & (F.col("top_id") == F.col("expected_id")))
    rank = F.col("rank")

    def over_known(x):
        return F.round(F.avg(F.when(known, F.coalesce(x, F.lit(0.0)))), 6)

    return r.agg(
        F.count("*").alias("sample_count"),
        F.count("expected_id").alias("matched_count"),
        over_known((rank <= 10).cast("double")).alias("recall_at_10"),
        over_known((rank <= 25).cast("double")).alias("recall_at_25"),
        over_known((rank == 1).cast("double")).alias("top1_accuracy"),
        over_known(F.when(rank <= 10, 1.0 / rank)).alias("mrr_at_10"),
        F.round(F.try_divide(correct, F.count_if(matched)), 6).alias("precision"),
        F.round(F.try_divide(correct, F.count("expected_id")), 6).alias("coverage"),
        F.round(F.try_divide(F.count_if(matched & ~known), F.count_if(~known)), 6).alias("false_match_rate"),
        F.round(F.count_if(~matched) / F.count("*"), 6).alias("abstention_rate"),
    )


_STAGES = ", a AS (SELECT t.query_id, t.template, e.sparse_rank, e.structured_rank, e.rrf_rank, e.reranker_rank FROM titles t LEFT JOIN reranked e ON e.query_id = t.query_id AND e.doc_id = t.expected_id WHERE t.expected_id IS NOT NULL)"


def _stage_ranks(spark: SparkSession, sf: str) -> DataFrame:
    t = titles(spark, sf).where("expected_id is not null").select("query_id", F.col("expected_id").alias("doc_id"), "template")
    return t.join(reranked(spark, sf).select("query_id", "doc_id", "sparse_rank", "structured_rank", "rrf_rank", "reranker_rank"), ["query_id", "doc_id"], "left")


@query(
    with_(*BASE, RERANKED)
    + _STAGES
    + ", u AS (UNPIVOT (SELECT query_id, coalesce(sparse_rank, 9999) AS sparse, coalesce(structured_rank, 9999) AS structured, coalesce(rrf_rank, 9999) AS rrf, coalesce(reranker_rank, 9999) AS reranker FROM a) ON sparse, structured, rrf, reranker INTO NAME stage VALUE rank) "
    "SELECT stage, round(avg((rank = 1)::INTEGER), 6) AS top1_accuracy, round(avg((rank <= 25)::INTEGER), 6) AS recall_at_25, round(avg(CASE WHEN rank <= 10 THEN 1.0 / rank ELSE 0 END), 6) AS mrr_at_10 FROM u GROUP BY stage"
)
def ablation_by_stage(spark: SparkSession, sf: str) -> DataFrame:
    u = _stage_ranks(spark, sf).select(F.explode(F.array(*[F.struct(F.lit(n).alias("stage"), F.col(f"{n}_rank").cast("int").alias("rank")) for n in ("sparse", "structured", "rrf", "reranker")])).alias("x")).select("x.*")
    r = F.col("rank")
    return u.groupBy("stage").agg(F.round(measure.recall_at(r, 1), 6).alias("top1_accuracy"), F.round(measure.recall_at(r, 25), 6).alias("recall_at_25"), F.round(measure.mrr_at(r), 6).alias("mrr_at_10"))


@query(with_(*BASE, RERANKED) + _STAGES + " SELECT template, count(*) AS cases, count_if(rrf_rank = 1) AS numerator, round(avg(coalesce((rrf_rank = 1)::INTEGER, 0)), 6) AS top1 FROM a GROUP BY ROLLUP (template)")
def metrics_by_category(spark: SparkSession, sf: str) -> DataFrame:
    """By template, with the total."""
    first = F.coalesce(F.col("rrf_rank") == 1, F.lit(False))
    return _stage_ranks(spark, sf).rollup("template").agg(F.count("*").alias("cases"), F.count_if(first).alias("numerator"), F.round(F.avg(first.cast("double")), 6).alias("top1"))


@query(
    with_(*BASE, RERANKED)
    + _STAGES
    + " SELECT CASE WHEN coalesce(reranker_rank, 9999) < coalesce(rrf_rank, 9999) THEN 'improved' WHEN coalesce(reranker_rank, 9999) > coalesce(rrf_rank, 9999) THEN 'regressed' ELSE 'unchanged' END AS change, count(*) AS cases FROM a GROUP BY 1"
)
def rank_transitions(spark: SparkSession, sf: str) -> DataFrame:
    before, after = F.coalesce("rrf_rank", F.lit(9999)), F.coalesce("reranker_rank", F.lit(9999))
    change = F.when(after < before, "improved").when(after > before, "regressed").otherwise("unchanged").alias("change")
    return _stage_ranks(spark, sf).groupBy(change).agg(F.count("*").alias("cases"))


@query(
    with_(*BASE, RERANKED)
    + _STAGES
    + ", m AS (SELECT avg(coalesce((rrf_rank = 1)::INTEGER, 0))::DOUBLE AS top1, avg(coalesce((rrf_rank <= 25)::INTEGER, 0))::DOUBLE AS recall, count(*)::DOUBLE AS cases FROM a) "
    "SELECT metric, round(actual, 6) AS actual, operator, threshold, CASE operator WHEN '>=' THEN actual >= threshold ELSE actual <= threshold END AS passed FROM (SELECT 'top1' AS metric, top1 AS actual, '>=' AS operator, 0.5::DOUBLE AS threshold FROM m UNION ALL SELECT 'recall', recall, '>=', 0.9::DOUBLE FROM m UNION ALL SELECT 'cases', cases, '<=', 1000000::DOUBLE FROM m)"
)
def gate_table(spark: SparkSession, sf: str) -> DataFrame:
    r = F.col("rrf_rank")
    m = _stage_ranks(spark, sf).agg(measure.recall_at(r, 1).alias("top1"), measure.recall_at(r, 25).alias("recall"), F.count("*").alias("cases"))
    return measure.gates(m, [("top1", ">=", 0.5), ("recall", ">=", 0.9), ("cases", "<=", 1_000_000)]).withColumn("actual", F.round("actual", 6))


@query("SELECT event_type, quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.95) AS p95, round(median(value), 6) AS median, max(value) AS most FROM events GROUP BY event_type")
def latency_percentiles(spark: SparkSession, sf: str) -> DataFrame:
    """Nearest-rank percentiles and the interpolated median."""
    disc = [F.expr(f"percentile_disc({q}) WITHIN GROUP (ORDER BY value)").alias(n) for q, n in ((0.5, "p50"), (0.95, "p95"))]
    return table(spark, sf, "events").groupBy("event_type").agg(*disc, F.round(F.median("value"), 6).alias("median"), F.max("value").alias("most"))


#: Confidence and label of calibration: the score is made from a document's length, so quality is not given away.
CALIBRATION = """
rows AS (SELECT d.doc_id, d.source, l.quality AS label, ln(1 + d.n_chars) - 6.5 AS score, round(1 / (1 + exp(-(ln(1 + d.n_chars) - 6.5))), 8) AS confidence FROM documents d JOIN labels l USING (doc_id))"""


def calibration_rows(spark: SparkSession, sf: str) -> DataFrame:
    """doc_id, source, label, score, confidence."""
    d = table(spark, sf, "documents").select("doc_id", "source", "n_chars")
    score = F.log(1 + F.col("n_chars")) - 6.5
    return d.join(table(spark, sf, "labels"), "doc_id").select("doc_id", "source", F.col("quality").alias("label"), score.alias("score"), F.round(maths.sigmoid(score), 8).alias("confidence"))


_NLL = "-(label * ln(c) + (1 - label) * ln(1 - c))"


@query(
    with_(CALIBRATION)
    + f""", k AS (SELECT *, least(1 - 1e-15, greatest(1e-15, confidence)) AS c FROM rows), b AS (SELECT source, least(floor(c * 10), 9) AS bin, count(*) AS n, avg(c) AS mc, avg(label) AS acc FROM k GROUP BY 1, 2),
e AS (SELECT source, sum(n * abs(mc - acc)) / sum(n) AS ece FROM b GROUP BY source) SELECT source, count(*) AS sample_count, sum(label)::BIGINT AS positive_count, round(avg((c - label) ** 2), 6) AS brier, round(avg({_NLL}), 6) AS nll, round(any_value(ece), 6) AS ece FROM k JOIN e USING (source) GROUP BY source"""
)
def calibration_metrics(spark: SparkSession, sf: str) -> DataFrame:
    """Brier score, log loss and calibration error of each source."""
    rows = calibration_rows(spark, sf)
    c = measure.clipped(F.col("confidence"))
    m = rows.groupBy("source").agg(F.count("*").alias("sample_count"), F.sum("label").alias("positive_count"), F.round(F.avg((c - F.col("label")) ** 2), 6).alias("brier"), F.round(F.avg(measure.log_loss(F.col("confidence"), F.col("label"))), 6).alias("nll"))
    bins = measure.reliability(rows, ["source"])
    gap = F.sum(F.col("n") * F.abs(F.col("mean_confidence") - F.col("accuracy"))) / F.sum("n")
    return m.join(bins.groupBy("source").agg(F.round(gap, 6).alias("ece")), "source")


@query(with_(CALIBRATION) + " SELECT least(floor(confidence * 10), 9)::INTEGER AS bin, count(*) AS n, round(avg(confidence), 6) AS mean_confidence, round(avg(label), 6) AS accuracy FROM rows GROUP BY 1")
def reliability_bins(spark: SparkSession, sf: str) -> DataFrame:
    return measure.reliability(calibration_rows(spark, sf)).select("bin", "n", F.round("mean_confidence", 6).alias("mean_confidence"), F.round("accuracy", 6).alias("accuracy"))


@query(
    with_(CALIBRATION)
    + ", g AS (SELECT confidence, count(*) AS n, sum(label) AS good FROM rows GROUP BY 1) SELECT confidence, sum(n) OVER w AS accepted, (sum(n) OVER w - sum(good) OVER w)::BIGINT AS errors, round((sum(n) OVER w - sum(good) OVER w) / sum(n) OVER w, 6) AS risk FROM g WINDOW w AS (ORDER BY confidence DESC ROWS UNBOUNDED PRECEDING)"
)
def risk_coverage(spark: SparkSession, sf: str) -> DataFrame:
    r = measure.ordered_risk(calibration_rows(spark, sf))
    errors = F.col("accepted") - F.col("correct")
    return r.select("confidence", "accepted", errors.alias("errors"), F.round(errors / F.col("accepted"), 6).alias("risk"))


@query(
    with_(CALIBRATION)
    + ", g AS (SELECT score, label, count(*) AS n FROM rows GROUP BY 1, 2), t AS (SELECT step, score, label, n, 1 / (1 + exp(-greatest(-40, least(40, score / exp(step / 100.0))))) AS c0 FROM g, range(-400, 401) r(step)), c AS (SELECT *, least(1 - 1e-15, greatest(1e-15, c0)) AS c FROM t) "
    f"SELECT step::INTEGER AS step, round(sum(n * ({_NLL})) / sum(n), 6) AS nll FROM c GROUP BY step"
)
def temperature_grid(spark: SparkSession, sf: str) -> DataFrame:
    return measure.temperatures(calibration_rows(spark, sf)).select("step", F.round("nll", 6).alias("nll"))


_RUN = ", g AS (SELECT confidence, count(*) AS n, sum({label}) AS good FROM rows GROUP BY 1), r AS (SELECT confidence, sum(n) OVER w AS accepted, sum(good) OVER w AS correct FROM g WINDOW w AS (ORDER BY confidence {order} ROWS UNBOUNDED PRECEDING))"


@query(with_(CALIBRATION) + _RUN.format(label="label", order="DESC") + " SELECT confidence AS threshold, accepted::BIGINT AS accepted, correct::BIGINT AS correct, round(correct / accepted, 6) AS precision, round(accepted / (SELECT count(*) FROM rows), 6) AS coverage FROM r WHERE accepted >= 5 AND correct / accepted >= 0.85 ORDER BY confidence LIMIT 1")
def match_threshold(spark: SparkSession, sf: str) -> DataFrame:
    t = measure.match_threshold(calibration_rows(spark, sf), precision=0.85)
    return t.select("threshold", "accepted", "correct", F.round("precision", 6).alias("precision"), F.round("coverage", 6).alias("coverage"))


@query(
    with_(CALIBRATION)
    + _RUN.format(label="1 - label", order="ASC")
    + ", t AS (SELECT sum(1 - label) AS absent, sum(label) AS present FROM rows) SELECT confidence AS at_most, accepted::BIGINT AS predicted, correct::BIGINT AS correct, (accepted - correct)::BIGINT AS false, round(correct / absent, 6) AS recall FROM r, t WHERE confidence < 0.9 AND accepted >= 2 AND correct / accepted >= 0.1 AND (accepted - correct) / present <= 0.5 ORDER BY correct / absent DESC, accepted - correct, correct / accepted DESC, confidence LIMIT 1"
)
def no_match_threshold(spark: SparkSession, sf: str) -> DataFrame:
    rows = calibration_rows(spark, sf).withColumn("label", 1 - F.col("label"))
    t = measure.no_match_threshold(rows, match=0.9, least=2, precision=0.1, most_false=0.5)
    return t.withColumn("recall", F.round("recall", 6))


@query(
    with_(CALIBRATION)
    + " SELECT coalesce(min(t / 100.0), 0.99)::DOUBLE AS threshold FROM (SELECT t FROM rows, range(30, 100) r(t) WHERE confidence >= t / 100.0 GROUP BY t HAVING avg(label) >= 0.85)"
)
def dev_policy_threshold(spark: SparkSession, sf: str) -> DataFrame:
    """The lowest of 70 thresholds with enough precision; 0.99 if none has."""
    steps = F.explode(F.sequence(F.lit(30), F.lit(99))).alias("t")
    grouped = calibration_rows(spark, sf).groupBy("confidence").agg(F.count("*").alias("n"), F.sum("label").alias("good")).select("*", steps)
    ok = grouped.where(F.col("confidence") >= F.col("t") / 100).groupBy("t").agg((F.sum("good") / F.sum("n")).alias("p")).where("p >= 0.85")
    return ok.agg(F.coalesce(F.min(F.col("t") / 100), F.lit(0.99)).alias("threshold"))


@query(
    "WITH RECURSIVE "
    + CALIBRATION
    + """, fit AS (SELECT 0 AS i, 0.0::DOUBLE AS w, 0.0::DOUBLE AS b UNION ALL
  SELECT i + 1, w - 0.05 * gw, b - 0.05 * gb FROM (SELECT i, w, b, avg((1 / (1 + exp(-greatest(-40, least(40, w * score + b)))) - label) * score) AS gw, avg(1 / (1 + exp(-greatest(-40, least(40, w * score + b)))) - label) AS gb FROM fit, rows WHERE i < 500 GROUP BY i, w, b))
SELECT doc_id, label, round(1 / (1 + exp(-greatest(-40, least(40, w * score + b)))), 6) AS confidence FROM rows, fit WHERE i = 500"""
)
def logistic_gd_fit(spark: SparkSession, sf: str) -> DataFrame:
    """500 gradient steps from zero, and the confidence each row then has."""
    rows = calibration_rows(spark, sf)
    w, b = measure.fit_logistic(rows, ["score"], "label")
    return rows.select("doc_id", "label", F.round(maths.sigmoid(F.lit(b) + F.lit(w[0]) * F.col("score")), 6).alias("confidence"))


@query(
    with_(CALIBRATION)
    + """, g AS (SELECT score, count(*) AS n, sum(label) AS good, row_number() OVER (ORDER BY score) AS i FROM rows GROUP BY score), c AS (SELECT *, sum(n) OVER (ORDER BY i) AS cn, sum(good) OVER (ORDER BY i) AS cg FROM g),
v AS (SELECT a.i AS j, b.i AS k, (b.cg - a.cg + a.good) / (b.cn - a.cn + a.n) AS mean FROM c a JOIN c b ON a.i <= b.i), least_ AS (SELECT j, k, min(mean) OVER (PARTITION BY j ORDER BY k DESC ROWS UNBOUNDED PRECEDING) AS m FROM v),
f AS (SELECT k AS i, max(m) AS fitted FROM least_ GROUP BY k) SELECT doc_id, label, round(fitted, 6) AS confidence FROM rows JOIN g USING (score) JOIN f USING (i)"""
)
def isotonic_fit(spark: SparkSession, sf: str) -> DataFrame:
    rows = calibration_rows(spark, sf)
    knots = measure.fit_isotonic(rows)
    return rows.select("doc_id", "label", F.round(maths.interpolate(F.col("score"), [k[0] for k in knots], [k[1] for k in knots]), 6).alias("confidence"))


@query(
    with_(CALIBRATION)
    + ", k0 AS (SELECT 'as given' AS name, confidence AS c, label FROM rows UNION ALL SELECT 'even', 0.5, label FROM rows UNION ALL SELECT 'base rate', (SELECT avg(label) FROM rows), label FROM rows UNION ALL SELECT 'half', 0.5, label FROM rows), "
    f"k AS (SELECT name, label, least(1 - 1e-15, greatest(1e-15, c)) AS c FROM k0), b AS (SELECT name, least(floor(c * 10), 9) AS bin, count(*) AS n, avg(c) AS mc, avg(label) AS acc FROM k GROUP BY 1, 2), e AS (SELECT name, round(sum(n * abs(mc - acc)) / sum(n), 6) AS ece FROM b GROUP BY name), "
    f"m AS (SELECT name, round(avg((c - label) ** 2), 6) AS brier, round(avg({_NLL}), 6) AS nll FROM k GROUP BY name) SELECT name, brier, nll, ece, row_number() OVER (ORDER BY brier, nll, ece, name)::INTEGER AS place FROM m JOIN e USING (name)"
)
def calibrator_selection(spark: SparkSession, sf: str) -> DataFrame:
    """Calibrators ordered by Brier score, log loss, calibration error and name; two of them tie in all but the name."""
    rows = calibration_rows(spark, sf)
    base = rows.agg(F.avg("label").alias("base"))
    arms = (("as given", F.col("confidence")), ("even", F.lit(0.5)), ("base rate", F.col("base")), ("half", F.lit(0.5)))
    each = F.explode(F.array(*[F.struct(F.lit(n).alias("name"), c.alias("confidence")) for n, c in arms])).alias("x")
    return measure.calibrators(rows.crossJoin(F.broadcast(base)).select("label", each).select("label", "x.*"))


@query(
    "WITH o AS (SELECT *, row_number() OVER w AS pos, max(value) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)), "
    "l AS (SELECT *, max(CASE WHEN before IS NULL OR value > before THEN pos END) OVER (PARTITION BY user_id ORDER BY event_id) AS last FROM o), "
    "u AS (SELECT *, min(CASE WHEN pos - last >= 3 THEN pos END) OVER (PARTITION BY user_id) AS until FROM l), s AS (SELECT * FROM u WHERE until IS NULL OR pos <= until) "
    "SELECT user_id, arg_max(last, pos)::INTEGER AS selected_epoch, max(pos)::INTEGER AS stop_epoch, max(value) AS best, (max(pos) - arg_max(last, pos))::INTEGER AS stale FROM s GROUP BY user_id"
)
def early_stopping(spark: SparkSession, sf: str) -> DataFrame:
    """Each user's events as a training run: the best epoch, and where three epochs in a row without a new best end it."""
    return measure.stopped(table(spark, sf, "events"), "user_id", "event_id", "value", patience=3)


@query()
def logistic_newton_fit(spark: SparkSession, sf: str) -> DataFrame:
    """The regularised fit, solved to its optimum, and the confidence each row then has."""
    rows = calibration_rows(spark, sf)
    w, b = measure.fit_logistic_newton(rows, ["score"], "label")
    return rows.select("doc_id", "label", F.round(maths.sigmoid(F.lit(b) + F.lit(w[0]) * F.col("score")), 6).alias("confidence"))


@query(
    "WITH s AS (SELECT s_suppkey, s_nationkey, CASE WHEN CAST('0x' || substr(sha256('audit' || chr(10) || s_suppkey::VARCHAR), 1, 8) AS BIGINT) / 4294967296.0 < 0.7 THEN 'train' ELSE 'test' END AS split FROM supplier), "
    "l AS (SELECT s_nationkey, count(DISTINCT split) AS sides FROM s GROUP BY 1) SELECT split, count(*) AS rows, count(DISTINCT s.s_nationkey) AS families, count(DISTINCT CASE WHEN sides > 1 THEN s.s_nationkey END) AS shared_families, round(count(*) / (SELECT count(*) FROM s), 6) AS share FROM s JOIN l USING (s_nationkey) GROUP BY split"
)
def split_audit(spark: SparkSession, sf: str) -> DataFrame:
    """A split made anew from its salt: the rows and families of each side, and the families that are on both."""
    from lodeweave.functions import hashing

    s = table(spark, sf, "supplier").select("s_suppkey", "s_nationkey", F.when(hashing.hash_unit("audit", F.col("s_suppkey")) < 0.7, "train").otherwise("test").alias("split"))
    sides = s.groupBy("s_nationkey").agg((F.countDistinct("split") > 1).alias("shared"))
    total = s.agg(F.count("*").alias("total"))
    j = s.join(sides, "s_nationkey").crossJoin(F.broadcast(total))
    return j.groupBy("split").agg(F.count("*").alias("rows"), F.countDistinct("s_nationkey").alias("families"), F.countDistinct(F.when(F.col("shared"), F.col("s_nationkey"))).alias("shared_families"), F.round(F.count("*") / F.first("total"), 6).alias("share"))


@query(
    with_(*BASE, FEATURES)
    + ", p AS (SELECT query_id, count(*) AS n, count_if(len(conflicts) = 0 AND list_contains(matches, 'collector_number')) AS exact FROM evidence GROUP BY 1) "
    "SELECT query_id, CASE WHEN exact = 1 THEN 'matched' WHEN coalesce(n, 0) > 0 THEN 'ambiguous' ELSE 'no_match' END AS proposal FROM titles LEFT JOIN p USING (query_id)"
)
def staged_proposal(spark: SparkSession, sf: str) -> DataFrame:
    """A proposed label: one exact candidate, some candidate, or none."""
    s = query_signals(spark, sf)
    p = pool(spark, sf, s).groupBy("query_id").agg(F.count("*").alias("n"), F.count_if((F.size("conflicts") == 0) & F.array_contains("matches", "collector_number")).alias("exact"))
    label = F.when(F.col("exact") == 1, "matched").when(F.coalesce("n", F.lit(0)) > 0, "ambiguous").otherwise("no_match")
    return s.select("query_id").join(p, "query_id", "left").select("query_id", label.alias("proposal"))
