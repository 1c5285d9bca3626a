"""Query envelopes: the part of a query that names a thing, found by the anchors of known names, and policies on it.

A name's anchor is its first alphabetic atom. A query's anchor is that of its atoms which begins the best aligned name;
the envelope runs from there to the query's end, and takes a number that alone stands before it. Queries meet names in an
equi-join on the anchor; only those pairs are aligned.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodeweave.functions import text
from lodeweave.operators import evidence

_FIT = T.StructType([T.StructField(n, T.DoubleType()) for n in ("ratio", "weight", "similarity")])


def core_atoms(value: Column) -> Column:
    """The atoms of a text's words without the noise words."""
    return F.flatten(F.transform(text.without(text.words(value), text.CORE_NOISE), lambda w: text.atoms(w)))


@F.pandas_udf(_FIT)
def fit(query: pd.Series, name: pd.Series, weights: pd.Series, most: pd.Series) -> pd.DataFrame:
    """How well a query's atoms from a place on cover a name's atoms from its anchor on."""

    def one(q: list[str], n: list[str], idf: dict[str, float], most: float) -> dict:
        qw, nw = ([0.0 if len(a) == 1 and a.isalpha() else idf.get(a, most) / most for a in x] for x in (q, n))
        got, _, similar, _ = evidence.align(q, n, qw, nw)
        return {"ratio": got / sum(nw) if sum(nw) else 0.0, "weight": got, "similarity": similar}

    return pd.DataFrame([one(list(q), list(n), {x["token"]: x["idf"] for x in w}, m) for q, n, w, m in zip(query, name, weights, most, strict=True)], columns=_FIT.names)


def envelopes(queries: DataFrame, names: DataFrame, idf: DataFrame) -> DataFrame:
    """For each query (query_id, title): ``status`` (anchored, unanchored or empty), ``anchor``, first atom ``start``, number of
    ``atoms`` and the envelope's ``text``.

    ``names`` has doc_id and name, ``idf`` token and idf. The best fit wins by share, weight and similarity of the aligned
    atoms, then the later place (names that begin with one anchor give one envelope). A query without any anchor is its own envelope; one
    without atoms has none.
    """
    q = queries.select("query_id", core_atoms(F.coalesce("title", F.lit(""))).alias("q"))
    forms = names.select("doc_id", core_atoms(F.col("name")).alias("n")).distinct()
    at = F.array_position(F.transform("n", lambda a: a.rlike("^[a-z]")), F.lit(True)).cast("int")
    forms = forms.withColumn("at", at).where("at > 0").select(F.concat_ws("\x1f", F.array_join("n", " "), F.col("doc_id").cast("string")).alias("form"), F.element_at("n", F.col("at")).alias("anchor"), F.slice("n", F.col("at"), F.size("n")).alias("n"))
    most = idf.agg(F.coalesce(F.max("idf"), F.lit(1.0)).alias("most"))
    none = F.array().cast(evidence.WEIGHTS)
    held = evidence.weighted(q, "query_id", F.col("q"), idf, "asked")
    named = evidence.weighted(forms, "form", F.col("n"), idf, "held")
    places = q.select("query_id", "q", F.posexplode("q").alias("pos", "anchor"))
    pairs = places.join(forms, "anchor").join(held, "query_id", "left").join(named, "form", "left").crossJoin(F.broadcast(most))
    fitted = pairs.select("query_id", "pos", "anchor", "form", fit(F.slice("q", F.col("pos") + 1, F.size("q")), F.col("n"), F.concat(F.coalesce("asked", none), F.coalesce("held", none)), F.col("most")).alias("f"))
    key = F.struct(F.round("f.ratio", 10), F.round("f.weight", 10), F.round("f.similarity", 10), F.col("pos"))
    best = fitted.groupBy("query_id").agg(F.max(F.struct(key.alias("key"), "anchor", "pos")).alias("b")).select("query_id", "b.anchor", "b.pos")
    alone = (F.col("pos") == 1) & F.element_at("q", 1).rlike("^[0-9]+$")
    start = F.when(F.col("pos").isNull(), 0).when(alone, 0).otherwise(F.col("pos"))
    out = q.join(best, "query_id", "left").withColumn("start", start)
    status = F.when(F.size("q") == 0, "empty").when(F.col("anchor").isNull(), "unanchored").otherwise("anchored")
    own = F.slice("q", F.col("start") + 1, F.greatest(F.size("q"), F.lit(1)))
    return out.select("query_id", status.alias("status"), "anchor", F.when(F.size("q") > 0, F.col("start")).alias("start"), F.size("q").alias("atoms"), F.array_join(own, " ").alias("text"))


POLICIES = ("reference-anchor", "envelope-numeric", "envelope-bilateral", "envelope-safe-form", "envelope-decision-list")


def policy(rank: Column, coverage: Column, e: dict[str, Column], name: str) -> Column:
    """Why a candidate is let in or refused under one of ``POLICIES``, as a reason; see ``admits``.

    ``e`` has numeric_relation, compact_digit_guard, query_model_residual, candidate_model_residual, anchor_relation,
    form_completion and alignment_strength.
    """
    if name not in POLICIES:
        raise ValueError(f"unknown policy {name}")
    out = F.when(rank != 1, F.when(coverage + 1e-12 >= evidence.SECONDARY, "secondary_coverage_at_least_075").otherwise("secondary_coverage_below_075"))
    if name == "reference-anchor":
        return out.otherwise("reference_rank_1")
    out = out.when(e["numeric_relation"] == "conflict", "numeric_conflict").when(e["compact_digit_guard"] == "fail", "compact_digit_guard_failed")
    if name == "envelope-numeric":
        return out.otherwise("compatible_identity")
    apart = e["anchor_relation"] == "different"
    mine, theirs = e["query_model_residual"], e["candidate_model_residual"]
    both = (mine == "present") & (theirs == "present")
    if name == "envelope-bilateral":
        return out.when(apart, "anchor_mismatch").when(both, "bilateral_model_residual").otherwise("compatible_identity")
    out = out.when((e["form_completion"] == "complete") & e["alignment_strength"].isin("exact", "shorthand"), "complete_safe_form").when(apart, "anchor_mismatch")
    if name == "envelope-safe-form":
        return out.when(mine == "present", "query_model_residual").otherwise("compatible_identity")
    fuzzy = (e["alignment_strength"] == "fuzzy") & (mine == "none") & (theirs == "none")
    return out.when(fuzzy, "bounded_fuzzy_form").when(both, "bilateral_model_residual").otherwise("ambiguous_identity")


def admits(reason: Column) -> Column:
    """Whether a reason lets the candidate in."""
    return reason.isin("secondary_coverage_at_least_075", "reference_rank_1", "compatible_identity", "complete_safe_form", "bounded_fuzzy_form")
