"""Evaluation of ranked results against labelled cases: outcomes, counters, grids, packs and audits.

Cases are (case_id, kind, style, family, expected_id, expected_family, forbidden_id), results (case_id, rank, doc_id,
family). Kinds: ``positive`` wants its id, ``merge`` its family, ``merge`` and ``hold`` not the forbidden id, and
``unrelated`` nothing at all. Everything is a join of both and aggregates over cases.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodeweave.functions import text
from lodeweave.operators import measure


def outcomes(cases: DataFrame, results: DataFrame, k: int = 5) -> DataFrame:
    """Each case with its ``target_rank``, ``forbidden_hits``, number of ``returned`` results and ``violations``, within the first ``k``.

    Results of unknown cases are left out; a case without results has none of all.
    """
    joined = cases.join(results.where(F.col("rank") <= k).withColumnRenamed("family", "_family"), "case_id", "left")
    target = F.when(F.col("kind") == "positive", F.col("doc_id") == F.col("expected_id")).when(F.col("kind") == "merge", F.col("_family") == F.col("expected_family"))
    bad = F.col("kind").isin("merge", "hold") & (F.col("doc_id") == F.col("forbidden_id"))
    kept = [c for c in cases.columns if c != "case_id"]
    found = joined.groupBy("case_id").agg(
        *[F.first(c).alias(c) for c in kept], F.min(F.when(target, F.col("rank"))).alias("target_rank"), F.count_if(F.coalesce(bad, F.lit(False))).alias("forbidden_hits"), F.count("doc_id").alias("returned")
    )
    kind = F.col("kind")
    missed = F.when((kind == "positive") & F.col("target_rank").isNull(), "target_missed").when((kind == "merge") & F.col("target_rank").isNull(), "merge_missed")
    violations = F.array_compact(F.array(missed, F.when(F.col("forbidden_hits") > 0, "forbidden_returned"), F.when((kind == "unrelated") & (F.col("returned") > 0), "unrelated_nonempty")))
    return found.withColumn("violations", violations)


def counters(found: DataFrame, by: list[str] | None = None) -> DataFrame:
    """The counts of ``outcomes``: one row, or one for each group."""
    positive, merge = F.col("kind") == "positive", F.col("kind") == "merge"
    rank, hit = F.col("target_rank"), F.col("target_rank").isNotNull()
    return found.groupBy(*(by or [])).agg(
        F.count_if(positive).alias("positive_total"),
        F.count_if(positive & (rank == 1)).alias("hits_at_1"),
        F.count_if(positive & hit).alias("hits_at_k"),
        F.coalesce(F.sum(F.when(positive & hit, 1.0 / rank)), F.lit(0.0)).alias("reciprocal_rank_sum"),
        F.countDistinct(F.when(positive, F.col("family"))).alias("families"),
        F.countDistinct(F.when(positive & hit, F.col("family"))).alias("covered_families"),
        F.count_if(merge).alias("merge_total"),
        F.count_if(merge & hit).alias("merge_hits"),
        F.sum("forbidden_hits").alias("forbidden_hits"),
        F.count_if(F.array_contains("violations", "unrelated_nonempty")).alias("unrelated_nonempty"),
        F.count_if(F.size("violations") > 0).alias("failures"),
    )


def rates(counted: DataFrame) -> DataFrame:
    """The metrics of ``counters``: shares of their totals, null where there is nothing to share."""
    return counted.select(
        "*",
        F.try_divide("hits_at_1", "positive_total").alias("recall_at_1"),
        F.try_divide("hits_at_k", "positive_total").alias("recall_at_k"),
        F.try_divide("reciprocal_rank_sum", F.col("positive_total").cast("double")).alias("mrr"),
        F.try_divide("covered_families", "families").alias("family_coverage"),
        F.try_divide("merge_hits", "merge_total").alias("merge_recall"),
    )


def verdict(gates: DataFrame) -> DataFrame:
    """``PASS`` if every gate has passed (a gate without a value hasn't), and how many failed."""
    failed = F.count_if(~F.coalesce("passed", F.lit(False)))
    return gates.agg(F.when(failed == 0, "PASS").otherwise("FAIL").alias("verdict"), failed.alias("failed"), F.count("*").alias("gates"))


def merged_states(states: DataFrame) -> DataFrame:
    """Partial counts (as ``counters`` gives them for any split of the cases by family) added up: the accumulator's merge."""
    summed = [c for c in states.columns if c in ("positive_total", "hits_at_1", "hits_at_k", "reciprocal_rank_sum", "families", "covered_families", "merge_total", "merge_hits", "forbidden_hits", "unrelated_nonempty", "failures")]
    return states.agg(*[F.sum(c).alias(c) for c in summed])


def required_and_forbidden(cases: DataFrame, results: DataFrame, k: int = 5) -> DataFrame:
    """Each case's ``required_rank`` and the sorted ``forbidden_ranks`` within the first ``k``."""
    joined = cases.select("case_id", "expected_id", "forbidden_id").join(results.where(F.col("rank") <= k).select("case_id", "rank", "doc_id"), "case_id", "left")
    rank = F.col("rank")
    return joined.groupBy("case_id").agg(F.min(F.when(F.col("doc_id") == F.col("expected_id"), rank)).alias("required_rank"), F.array_sort(F.collect_list(F.when(F.col("doc_id") == F.col("forbidden_id"), rank))).alias("forbidden_ranks"))


def safety(found: DataFrame) -> DataFrame:
    """Counts and rates of ``required_and_forbidden``."""
    bad = F.size("forbidden_ranks") > 0
    counted = found.agg(F.count("*").alias("cases"), F.count("required_rank").alias("required_hits"), F.count_if(bad).alias("forbidden_cases"), F.coalesce(F.sum(F.size("forbidden_ranks")), F.lit(0)).alias("forbidden_candidates"))
    share = [F.try_divide("required_hits", "cases").alias("required_recall"), F.try_divide("forbidden_cases", "cases").alias("forbidden_case_rate"), F.try_divide(F.col("cases") - F.col("forbidden_cases"), "cases").alias("safety_accuracy")]
    return counted.select("*", *share)


def grid(character: DataFrame, exact: DataFrame, floors: list[float], weights: list[float], k: int = 25, constant: int = 60) -> DataFrame:
    """Every configuration (floor, weight) at once: exact ranks fused with the ranks of character scores from the floor up.

    Character scores (query_id, doc_id, score) are ranked once for each floor, not for each configuration; weights then
    only change the sum. Gives floor, weight, query_id, doc_id, score, rank.
    """
    from lodeweave.operators import retrieve

    by_floor = character.select("*", F.explode(F.array(*[F.lit(float(f)) for f in floors])).alias("floor")).where(F.round("score", retrieve.DECIMALS) >= F.col("floor"))
    ranked = retrieve.top(by_floor.withColumn("_q", F.concat_ws("\x1f", F.col("floor").cast("string"), "query_id")), k, by="_q").select("floor", "query_id", "doc_id", F.col("rank").alias("character_rank"))
    every = retrieve.top(exact, k).select(F.explode(F.array(*[F.lit(float(f)) for f in floors])).alias("floor"), "query_id", "doc_id", F.col("rank").alias("exact_rank"))
    both = ranked.join(every, ["floor", "query_id", "doc_id"], "full").select("*", F.explode(F.array(*[F.lit(float(w)) for w in weights])).alias("weight"))
    score = F.coalesce(F.col("weight") / (constant + F.col("character_rank")), F.lit(0.0)) + F.coalesce(F.lit(1.0) / (constant + F.col("exact_rank")), F.lit(0.0))
    keyed = both.withColumn("score", score).withColumn("_q", F.concat_ws("\x1f", F.col("floor").cast("string"), F.col("weight").cast("string"), "query_id"))
    return retrieve.top(keyed, k, by="_q").select("floor", "weight", "query_id", "doc_id", "score", "rank")


def pack_violations(cases: DataFrame, indexed: DataFrame, previous: DataFrame, tokens: DataFrame, longest: int = 512) -> DataFrame:
    """One row of counts of what is wrong with a pack of queries (case_id, kind, family, style, query).

    Queries must differ once normalised and once written together, be no text of ``indexed`` or ``previous`` (column
    ``text``), and unrelated ones share no token of the corpus (``tokens``); each family has both of its styles.
    """
    n = cases.withColumn("_n", text.normalize(F.col("query"))).withColumn("_c", F.replace("_n", F.lit(" "), F.lit("")))

    def repeats(column: str, name: str) -> DataFrame:
        return n.groupBy(column).agg((F.count("*") - 1).alias("more")).agg(F.coalesce(F.sum("more"), F.lit(0)).alias(name))

    known = indexed.select("text").union(previous.select("text")).select(F.replace(text.normalize(F.col("text")), F.lit(" "), F.lit("")).alias("_c")).distinct()
    reused = n.join(known, "_c", "left_semi").agg(F.count("*").alias("reused"))
    words = n.where("kind = 'unrelated'").select("case_id", F.explode(F.split("_n", " ")).alias("token"))
    overlap = words.join(tokens.select("token").distinct(), "token", "left_semi").agg(F.countDistinct("case_id").alias("unrelated_overlap"))
    styles = n.where("kind = 'positive'").groupBy("family").agg(F.countDistinct("style").alias("styles")).agg(F.count_if(F.col("styles") < 2).alias("families_without_both_styles"))
    bad = n.agg(F.count_if((F.col("_n") == "") | (F.length("_n") > longest)).alias("empty_or_long"))
    out = repeats("case_id", "duplicate_ids")
    for other in (repeats("_n", "duplicate_queries"), repeats("_c", "duplicate_compact"), reused, overlap, styles, bad):
        out = out.crossJoin(other)  # single rows
    return out


def derived_labels(cases: DataFrame, registry: DataFrame) -> DataFrame:
    """Labels of cases (case_id, kind, reference) from a registry (kind, reference, id, family): by kind, one join each.

    A positive case gets its id, a merge case its family and the id it must not return, a hold case only the latter, an
    unrelated one nothing; a reference that the registry lacks is ``unresolved``.
    """
    found = cases.where("kind <> 'unrelated'").join(registry.select("kind", "reference", "id", "family", F.lit(True).alias("_known")), ["kind", "reference"], "left")
    null = F.lit(None).cast("string")
    parts = []
    for kind, expected, family, forbidden in (("positive", F.col("id"), null, null), ("merge", null, F.col("family"), F.col("id")), ("hold", null, null, F.col("id"))):
        parts.append(found.where(F.col("kind") == kind).select("case_id", "kind", expected.alias("expected_id"), family.alias("expected_family"), forbidden.alias("forbidden_id"), F.col("_known").isNull().alias("unresolved")))
    out = cases.where("kind = 'unrelated'").select("case_id", "kind", null.alias("expected_id"), null.alias("expected_family"), null.alias("forbidden_id"), F.lit(False).alias("unresolved"))
    for p in parts:
        out = out.unionByName(p)
    return out


def nested_sets(rows: DataFrame, target: str, title: Column, order: list, most: int = 10) -> DataFrame:
    """Up to ``most`` titles of each target, nested in order; a limit of the format, which keeps a set's size bounded."""
    from pyspark.sql import Window

    at = F.row_number().over(Window.partitionBy(target).orderBy(*order))
    chosen = rows.select(F.col(target).alias("target"), title.alias("title"), at.alias("at")).where(F.col("at") <= most)
    return chosen.groupBy("target").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "title"))), lambda x: x["title"]).alias("titles"))


def set_faults(sets: DataFrame, parents: DataFrame, most: int = 10) -> DataFrame:
    """One row: sets, titles, sets that repeat a title once normalised, sets that are too large, and targets on one side only."""
    plain = F.transform("titles", lambda x: text.normalize(x))
    own = sets.agg(
        F.count("*").alias("sets"), F.coalesce(F.sum(F.size("titles")), F.lit(0)).alias("titles"), F.count_if(F.size(F.array_distinct(plain)) < F.size("titles")).alias("repeating"), F.count_if(F.size("titles") > most).alias("too_large")
    )
    sides = sets.select("target", F.lit(1).alias("s")).unionByName(parents.select(F.col("target"), F.lit(2).alias("s"))).groupBy("target").agg(F.countDistinct("s").alias("n"))
    return own.crossJoin(sides.agg(F.count_if(F.col("n") < 2).alias("on_one_side")))


def latency_report(samples: DataFrame, value: str, budget: float, by: list[str]) -> DataFrame:
    """Nearest-rank p50 and p95 of each group, the number of samples, and whether p95 is within the budget."""
    out = samples.groupBy(*by).agg(F.count(value).alias("samples"), measure.percentile(F.col(value), 0.5).alias("p50"), measure.percentile(F.col(value), 0.95).alias("p95"))
    return out.withColumn("within_budget", F.col("p95") <= F.lit(budget))


def policy_report(decided: DataFrame, ranks: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Retrieval and policy metrics of decisions (query_id, status, top_id, top_family, expected_id, expected_family) and the target's ``rank``."""
    r = decided.join(ranks.select("query_id", "rank"), "query_id", "left")
    matched, n = F.col("status") == "matched", F.count("*")
    exact = F.coalesce(F.col("top_id") == F.col("expected_id"), F.lit(False))
    family = F.coalesce(F.col("top_family") == F.col("expected_family"), F.lit(False))
    return r.groupBy(*(by or [])).agg(
        n.alias("cases"),
        F.try_divide(F.count_if(family), n).alias("family_top1"),
        F.try_divide(F.count_if(exact), n).alias("exact_top1"),
        F.try_divide(F.count_if(F.col("rank") <= 10), n).alias("recall_at_10"),
        F.try_divide(F.count_if(F.col("rank") <= 25), n).alias("recall_at_25"),
        F.try_divide(F.count_if(matched & exact), n).alias("policy_exact"),
        F.try_divide(F.count_if(matched & exact), F.count_if(matched)).alias("policy_precision"),
        F.try_divide(F.count_if(matched), n).alias("policy_coverage"),
        F.try_divide(F.count_if(~matched), n).alias("policy_abstention"),
        *[F.count_if(F.col("status") == s).alias(f"n_{s}") for s in ("matched", "ambiguous", "no_match")],
    )


def evidence_faults(records: DataFrame, evidence: DataFrame, fields: list[str], key: str) -> DataFrame:
    """What keeps each record's evidence (key, field, agrees, value) from being complete and agreeing.

    A field that the record has a value for is required. Counts of ``missing``, ``extra``, ``duplicate``, ``disagreeing``
    and ``stale`` fields (evidence of another value than the record's, once normalised), and ``complete`` if all are 0.
    """
    have = records.select(key, F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("own")) for f in fields])).alias("x")).select(key, "x.*").where("own is not null")
    seen = evidence.groupBy(key, "field").agg(F.count("*").alias("n"), F.count_if(~F.coalesce("agrees", F.lit(False))).alias("against"), F.min(text.normalize(F.col("value"))).alias("least"), F.max(text.normalize(F.col("value"))).alias("most"))
    both = have.join(seen, [key, "field"], "full")
    own = text.normalize(F.col("own"))
    stale = F.col("own").isNotNull() & F.col("n").isNotNull() & ~(F.col("least").eqNullSafe(own) & F.col("most").eqNullSafe(own))
    counted = both.groupBy(key).agg(
        F.count_if(F.col("n").isNull()).alias("missing"),
        F.count_if(F.col("own").isNull()).alias("extra"),
        F.count_if(F.col("n") > 1).alias("duplicate"),
        F.count_if(F.col("against") > 0).alias("disagreeing"),
        F.count_if(stale).alias("stale"),
    )
    none = sum((F.col(c) for c in ("missing", "extra", "duplicate", "disagreeing", "stale")), F.lit(0)) == 0
    return counted.withColumn("complete", none)


def shadow_admission(results: DataFrame, admitted: Column) -> DataFrame:
    """Each query's admitted and refused ids in the order of their ranks (at most 25 of each)."""
    entry = F.struct("rank", "doc_id")

    def ids(which: Column) -> Column:
        return F.transform(F.array_sort(F.collect_list(F.when(which, entry))), lambda x: x["doc_id"])

    return results.groupBy("query_id").agg(ids(admitted).alias("admitted"), ids(~admitted).alias("refused"))


def frozen(cases: DataFrame, strata: list[str], quota: int, salt: str, key: str = "case_id") -> DataFrame:
    """A benchmark frozen by salted hash: the first ``quota`` cases of each stratum, numbered in the order of their keys, and
    whether their stratum is ``short`` of its quota. Cases that come later change nothing unless their hash is among the first."""
    from pyspark.sql import Window

    from lodeweave.functions import hashing

    at = F.row_number().over(Window.partitionBy(*strata).orderBy(hashing.salted(salt, F.col(key)), key))
    chosen = cases.withColumn("_at", at).where(F.col("_at") <= quota)
    short = F.count("*").over(Window.partitionBy(*strata)) < quota
    # quota rows for each stratum: few, however many cases there are
    return chosen.withColumn("short", short).withColumn("number", F.row_number().over(Window.orderBy(key))).drop("_at")


def inventory(rows: DataFrame, source: str, ids: str, content: Column) -> DataFrame:
    """Each source's rows, distinct ids and distinct contents, and of these how many other sources have as well."""
    named = rows.select(F.col(source).alias("source"), F.col(ids).alias("id"), F.sha2(F.coalesce(content, F.lit("")), 256).alias("h"))
    own = named.groupBy("source").agg(F.count("*").alias("rows"), F.countDistinct("id").alias("ids"), F.countDistinct("h").alias("contents"))
    held = named.select("source", "h").distinct()
    shared = held.join(held.groupBy("h").agg(F.count("*").alias("n")).where("n > 1"), "h").groupBy("source").agg(F.count("*").alias("shared"))
    return own.join(shared, own["source"].eqNullSafe(shared["source"]), "left").select(own["source"], "rows", "ids", "contents", F.coalesce("shared", F.lit(0)).alias("shared"))


def overlaid(base: DataFrame, overlay: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """``base`` with approved repairs (key, field, old, new, approved) on top, and what became of each record's repairs.

    A repair applies if it is approved, the record's value still is ``old`` and no other approved repair of that field says
    otherwise. ``applied``, ``stale`` and ``conflicting`` count them; repairs of unknown records are left out.
    """
    some = overlay.where("approved").groupBy(key, "field").agg(F.countDistinct(F.struct("old", "new")).alias("kinds"), F.first("old").alias("old"), F.first("new").alias("new"))
    by_record = some.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("field", F.struct("kinds", "old", "new")))).alias("_r"))  # one entry a field
    joined = base.join(by_record, key, "left")
    out, applied, stale, conflicting = joined, F.lit(0), F.lit(0), F.lit(0)
    for f in fields:
        r = F.try_element_at("_r", F.lit(f))
        clash = r.isNotNull() & (r["kinds"] > 1)
        fresh = r.isNotNull() & (r["kinds"] == 1) & r["old"].eqNullSafe(F.col(f).cast("string"))
        one = lambda c: F.coalesce(c, F.lit(False)).cast("int")
        applied, conflicting = applied + one(fresh), conflicting + one(clash)
        stale = stale + one(r.isNotNull() & (r["kinds"] == 1) & ~r["old"].eqNullSafe(F.col(f).cast("string")))
        out = out.withColumn(f"_{f}", F.when(one(fresh) == 1, r["new"]).otherwise(F.col(f).cast("string")))
    return out.select(key, *[F.col(f"_{f}").alias(f) for f in fields], applied.alias("applied"), stale.alias("stale"), conflicting.alias("conflicting"))
