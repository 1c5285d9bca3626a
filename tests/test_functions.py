"""Functions against hand-checked cases and plain Python."""

from __future__ import annotations

import hashlib
import math
import uuid

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodeweave.functions import exact, hashing, maths, text
from lodeweave.operators import decide, evidence, keep, measure, retrieve


def one(spark, *columns, **values):
    schema = ", ".join(f"{k} string" for k in values) or "x string"
    return spark.createDataFrame([tuple(values.values()) or (None,)], schema).select(*columns).first()


def test_signals(spark):
    r = one(spark, *text.signals(F.col("t")), t="2022 Nomad Chartreuse Galaxy Run #101 3/10 lot of 4")
    assert (r.year, r.collector, r.position_text, r.quantity, r.multipack) == (2022, "101", "3/10", 4, True)
    r = one(spark, *text.signals(F.col("t")), t="model 12022 xylophone #A12B box12 Nomad")
    assert r.year is None and r.quantity is None
    assert one(spark, *text.signals(F.col("t")), t="Nomad x12").quantity == 12
    r = one(spark, *text.signals(F.col("t")), t="1999 2003 12/10 NIB 2-pack")
    assert r.warnings == ["multiple_years", "invalid_series_position"] and r.quantity == 2 and "nib" not in r.tokens


def test_normalizers(spark):
    r = one(spark, text.normalize(F.col("t")).alias("a"), exact.normalize("t").alias("b"), text.normalize_ascii(F.col("t")).alias("c"), text.slug(F.col("t")).alias("d"), t="Straße  ÉTÉ_1, x!")
    assert r.a == r.b == "strasse été_1 x" and r.c == "strae ete 1 x" and r.d == "strae-ete-1-x"
    assert one(spark, text.slug(F.col("t")).alias("d"), t="!!").d == "variant"
    assert one(spark, exact.normalize("t").alias("b"), t="ﬁne ＡＢ").b == "fine ab"


def test_hashes(spark):
    r = one(spark, hashing.uuid5(F.col("t")).alias("u"), hashing.natural_key(F.col("t"), F.lit(None).cast("string")).alias("k"), t="pvr:x y")
    assert r.u == str(uuid.uuid5(uuid.NAMESPACE_URL, "pvr:x y")) and r.k == "pvr x y\x1f"
    assert one(spark, hashing.salted("s", F.col("t")).alias("h"), t="a").h == hashlib.sha256(b"s\na").hexdigest()


def test_atoms(spark):
    rel = text.atom_relation(F.col("a"), F.col("b"))
    for a, b, want in (
        ("88", "1988", "leading_year_suffix"), ("camaro", "camaro", "exact"), ("37x", "37", "leading_year_uncertainty_x"), ("37", "37x", None), ("cam", "camaro", "unique_prefix_abbreviation"),
        ("camaro", "camrao", "unique_alpha_edit_1"), ("g0", "go", "ocr_o_zero"), ("oo", "00", "ocr_o_zero"), ("do", "da", None), ("1100", "100", "ocr_repeated_digit_restore"), ("120", "10", None), ("abc", "xyz", None),
    ):
        assert one(spark, rel.alias("r"), a=a, b=b).r == want, (a, b)


def test_segment():
    assert exact.segment("hotrod", frozenset({"hot", "rod", "ho", "trod"})) == ["ho", "trod"]
    assert exact.segment("zzz", frozenset({"hot"})) is None


def test_grams_and_arrays(spark):
    r = one(spark, text.grams(F.col("t")).alias("g"), maths.is_subsequence(F.array(F.lit("a"), F.lit("c")), F.array(F.lit("a"), F.lit("b"), F.lit("c"))).alias("s"), maths.combinations(F.array(F.lit("a"), F.lit("b"))).alias("c"), t="abc")
    assert r.g == ["ab", "bc", "abc"] and r.s and r.c == [["a"], ["b"], ["a", "b"]]


def ranked(spark, rows):
    return spark.createDataFrame(rows, "query_id string, doc_id string, score double, rank int")


def test_fusion(spark):
    a = ranked(spark, [("q", "2", 2.0, 1), ("q", "1", 1.0, 2)])
    b = ranked(spark, [("q", "1", 2.0, 1), ("q", "2", 1.0, 2)])
    rows = retrieve.fuse({"dense": a, "sparse": b}).orderBy("rrf_rank").collect()
    assert [r.doc_id for r in rows] == ["1", "2"] and math.isclose(rows[0].rrf_score, 1 / 61 + 1 / 62)
    with pytest.raises(ValueError):
        retrieve.fuse({"a": a}, limit=26)


@pytest.mark.parametrize(
    ("top", "second", "confidence", "want"),
    [(0.9, 0.1, 0.9, "matched"), (0.9, 0.86, 0.9, "ambiguous"), (None, None, 0.1, "no_match"), (-1.0, -2.0, 0.9, "no_match")],
)
def test_policy(spark, top, second, confidence, want):
    q = spark.createDataFrame([("q",)], "query_id string")
    rows = [("q", str(i), x, i + 1, 1, [], []) for i, x in enumerate((top, second)) if x is not None]
    c = spark.createDataFrame(rows, "query_id string, doc_id string, s double, rrf_rank int, support int, matches array<string>, conflicts array<string>")
    f = decide.features(q, c, score=F.col("s")).withColumn("confidence", F.lit(confidence))
    assert decide.decide(f).first().status == want


def test_posting_cosine(spark):
    docs = spark.createDataFrame([("a", "alpha coupe"), ("b", "beta sedan")], "id string, core string")
    forms = retrieve.forms_of(docs, "id", F.col("core"))
    got = {(r.query_id, r.doc_id): r.score for r in retrieve.posting_cosine(forms, forms, 0.01).collect()}
    assert math.isclose(got["a", "a"], 1.0) and math.isclose(got["b", "b"], 1.0)
    idf = {(r["mode"], r["gram"]): r["idf"] for r in retrieve.gram_idf(forms).collect()}
    assert math.isclose(idf["spaced", "al"], math.log(3 / 2) + 1)


def test_measures(spark):
    r = spark.createDataFrame([(1,), (3,), (None,)], "rank int").agg(measure.recall_at(F.col("rank"), 2).alias("r"), measure.mrr_at(F.col("rank")).alias("m")).first()
    assert math.isclose(r.r, 1 / 3) and math.isclose(r.m, (1 + 1 / 3) / 3)
    rows = spark.createDataFrame([(float(x), x) for x in (0, 0, 1, 0, 1, 1)], "score double, label int")
    assert measure.fit_isotonic(rows)[0][1] <= measure.fit_isotonic(rows)[-1][1]
    w, b = measure.fit_logistic(rows, ["score"], "label")
    assert w[0] > 0


def test_append_once(spark):
    a = spark.createDataFrame([("1",), ("2",)], "h string")
    b = spark.createDataFrame([("2",), ("3",), ("3",)], "h string")
    assert sorted(r.h for r in keep.append_once(keep.append_once(a, b, "h"), b, "h").collect()) == ["1", "2", "3"]


def test_support_of_long_queries(spark):
    words = [f"t{i}" for i in range(20)]
    held = spark.createDataFrame([("a", "t1\x1ft15\x1ft19"), ("b", "t18"), ("c", "t19\x1ft1"), ("d", "t2\x1ft3\x1ft4\x1ft5")], "key string, subset string")
    queries = spark.createDataFrame([(1, words), (2, words[:18]), (3, ["t18"]), (4, []), (5, ["t19", "x", "t1"])], "query_id long, tokens array<string>")
    got = {r.query_id: (r.authorities, r.status) for r in evidence.support(queries, held, "key").collect()}
    assert got == {1: (2, "ambiguous"), 2: (0, "empty"), 3: (1, "singleton"), 4: (0, "empty"), 5: (1, "singleton")}


def test_dense_takes_all_queries(spark):
    queries = spark.range(20_001).selectExpr("cast(id as string) AS query_id", "array(1D, cast(id AS double)) AS vec")
    docs = spark.createDataFrame([("d", [1.0, 0.0])], "doc_id string, vec array<double>")
    assert retrieve.dense(queries, docs, 1).count() == 20_001


def test_set_wise_reranker_against_plain_loops():
    import math

    import numpy as np

    from lodeweave.operators import listwise

    w, x = listwise.seeded(3), np.random.default_rng(1).normal(size=(7, listwise.INPUT))

    def linear(v, name):
        return [sum(a * b for a, b in zip(row, v, strict=True)) + bias for row, bias in zip(w[name], w[f"{name}_bias"], strict=True)]

    def norm(v, gain, shift):
        m = sum(v) / len(v)
        s = math.sqrt(sum((a - m) ** 2 for a in v) / len(v) + 1e-5)
        return [(a - m) / s * g + b for a, g, b in zip(v, w[gain], w[shift], strict=True)]

    h = [norm([a * 0.5 * (1 + math.erf(a / math.sqrt(2))) for a in linear(v, "encoder")], "encoder_gain", "encoder_shift") for v in x]
    qkv = [linear(v, "attention") for v in h]
    size, n = listwise.HIDDEN // listwise.HEADS, listwise.HIDDEN
    mixed = [[0.0] * n for _ in h]
    for head in range(listwise.HEADS):
        at = range(head * size, (head + 1) * size)
        for i, a in enumerate(qkv):
            z = [math.exp(sum(a[c] * b[n + c] for c in at) / math.sqrt(size)) for b in qkv]
            for c in at:
                mixed[i][c] = sum(zz * b[2 * n + c] for zz, b in zip(z, qkv, strict=True)) / sum(z)
    h = [norm([a + b for a, b in zip(v, linear(m, "output"), strict=True)], "first_gain", "first_shift") for v, m in zip(h, mixed, strict=True)]
    h = [norm([a + b for a, b in zip(v, linear([max(0.0, c) for c in linear(v, "wide")], "narrow"), strict=True)], "second_gain", "second_shift") for v in h]
    want = [linear(v, "head")[0] for v in h]
    assert np.allclose(listwise.forward(x, w), want, atol=1e-9)
    order = [3, 0, 6, 1, 5, 2, 4]
    assert np.allclose(listwise.forward(x[order], w), np.array(want)[order], atol=1e-9)


def test_running_sums(spark):
    from lodeweave.operators import measure

    rows = spark.createDataFrame([(float(i % 37) / 37, 1 + i % 3) for i in range(200)], "x double, n long").groupBy("x").sum("n").withColumnRenamed("sum(n)", "n")
    for down in (False, True):
        got = sorted(((r.x, r.n, r.run_n) for r in measure.running(rows, "x", ["n"], down).collect()), reverse=down)
        total = 0
        for _, n, run in got:
            total += n
            assert run == total


def test_isotonic_against_plain_pooling(spark):
    import random

    from lodeweave.operators import measure

    r = random.Random(3)
    data = [(r.randrange(60) / 10, int(r.random() < 0.5)) for _ in range(400)]
    pools = []
    for x in sorted({x for x, _ in data}):
        own = [y for z, y in data if z == x]
        pools.append([x, x, len(own), sum(own)])
        while len(pools) > 1 and pools[-2][3] / pools[-2][2] >= pools[-1][3] / pools[-1][2]:
            last = pools.pop()
            pools[-1] = [pools[-1][0], last[1], pools[-1][2] + last[2], pools[-1][3] + last[3]]
    want = [k for low, high, n, good in pools for k in ([(low, good / n)] + ([(high, good / n)] if high > low else []))]
    got = measure.fit_isotonic(spark.createDataFrame(data, "score double, label int").repartition(7))
    assert [(a, round(b, 9)) for a, b in got] == [(a, round(b, 9)) for a, b in want]


def test_newton_finds_the_optimum(spark):
    import random

    import numpy as np

    from lodeweave.operators import measure

    r = random.Random(2)
    data = [(a, b, int(r.random() < 1 / (1 + math.exp(-(2 * a - b + 0.5))))) for a, b in ((r.gauss(0, 1), r.gauss(0, 2)) for _ in range(300))]
    w, b = measure.fit_logistic_newton(spark.createDataFrame(data, "a double, b double, y int"), ["a", "b"], "y", strength=0.5)
    x, y = np.array([d[:2] for d in data]), np.array([d[2] for d in data])
    error = 1 / (1 + np.exp(-(x @ np.array(w) + b))) - y
    assert np.allclose(error @ x + np.array(w) / 0.5, 0, atol=1e-7) and abs(error.sum()) < 1e-7


def test_envelopes_against_plain_python(spark):
    from lodeweave.operators import envelope

    names = [("a", "blue camaro 1967"), ("b", "camaro z28"), ("c", "red nomad"), ("d", "1955"), ("e", "nomad")]
    titles = [("q1", "lot of 3 camaro z28"), ("q2", "67 camaro blue"), ("q3", "nothing known"), ("q4", ""), ("q5", "shiny red nomad wagon"), ("q6", "55 nomad"), ("q7", None)]
    idf = {"camaro": 1.5, "blue": 2.0, "red": 2.0, "nomad": 1.7, "z": 2.2}
    most = max(idf.values())

    def atoms(t):
        return [a for a, _ in evidence.atoms_of(t or "")]

    def weights(x):
        return [0.0 if len(a) == 1 and a.isalpha() else idf.get(a, most) / most for a in x]

    want = {}
    for key, t in titles:
        q, best = atoms(t), None
        for pos, a in enumerate(q):
            for _, name in names:
                n = atoms(name)
                at = next((i for i, x in enumerate(n) if x.isalpha()), None)
                if at is None or n[at] != a:
                    continue
                nw = weights(n[at:])
                got, _, similar, _ = evidence.align(q[pos:], n[at:], weights(q[pos:]), nw)
                option = (round(got / sum(nw), 10), round(got, 10), round(similar, 10), pos)
                best = max(best or option, option)
        start = None if not q else 0 if best is None or (best[3] == 1 and q[0].isdigit()) else best[3]
        want[key] = ("empty" if not q else "unanchored" if best is None else "anchored", None if best is None else q[best[3]], start, " ".join(q[start:]) if q else "")
    rows = envelope.envelopes(spark.createDataFrame(titles, "query_id string, title string"), spark.createDataFrame(names, "doc_id string, name string"), spark.createDataFrame(list(idf.items()), "token string, idf double"))
    got = {r.query_id: (r.status, r.anchor, r.start, r.text or "") for r in rows.collect()}
    assert got == want


def test_many_queries_give_what_few_give(spark, monkeypatch):
    """Beyond the size that may be broadcast, pairs meet in shuffles and by rare tokens only: the best are the same."""
    from lodeweave.plans.frames import catalog, query_signals

    sf = "/root/testdata/sf0.01"
    s, c = query_signals(spark, sf), catalog(spark, sf)
    posted = retrieve.postings(c, "doc_id", text.words(F.col("search_text")))
    wanted, n = s.select("query_id", F.explode("tokens").alias("token")), c.agg(F.count("*").alias("n"))

    def best():
        out = []
        for found in (retrieve.sparse(wanted, posted, n), retrieve.structured(s, c)):
            out.append(sorted((r.query_id, r.doc_id, round(r.score, 8), r["rank"]) for r in retrieve.top(found).collect()))
        return out

    few = best()
    monkeypatch.setattr(retrieve, "BROADCAST_ROWS", -1)
    assert best() == few and len(few[0]) == 2500


def test_classes_give_what_pairs_give(spark, monkeypatch):
    """So many pairs that they can't be made one by one: records and queries meet as classes, and the best are the same."""
    from lodeweave.plans.frames import catalog, query_signals

    sf = "/root/testdata/sf0.01"
    s, c = query_signals(spark, sf), catalog(spark, sf)
    posted = retrieve.postings(c, "doc_id", text.words(F.col("search_text")))
    wanted, n = s.select("query_id", F.explode("tokens").alias("token")), c.agg(F.count("*").alias("n"))
    made = []
    for name in ("_classed", "_expanded"):
        monkeypatch.setattr(retrieve, name, lambda *a, f=getattr(retrieve, name): made.append(f.__name__) or f(*a))

    def best():
        out = []
        for found in (retrieve.sparse(wanted, posted, n), retrieve.structured(s, c)):
            out.append(sorted((r.query_id, r.doc_id, round(r.score, 8), r["rank"]) for r in retrieve.top(found).collect()))
        return out

    few = best()
    assert not made
    for name, value in (("PAIRED_ROWS", 4), ("PAIRS", -1), ("CLASS_TOKENS", 30), ("CLASS_DF", 20)):
        monkeypatch.setattr(retrieve, name, value)
    assert best() == few and made == ["_classed", "_expanded", "_expanded"]


def test_plans_of_many_queries_stay_small(spark, monkeypatch):
    """Results by classes are cut from their plans, which else are repeated wherever a persisted table is read, and hold no tables."""
    from lodeweave.plans.frames import catalog, query_signals

    for name, value in (("PAIRED_ROWS", 4), ("PAIRS", -1), ("CLASS_TOKENS", 30), ("CLASS_DF", 20)):
        monkeypatch.setattr(retrieve, name, value)
    sf = "/root/testdata/sf0.01"
    s, c = query_signals(spark, sf), catalog(spark, sf)
    posted = retrieve.postings(c, "doc_id", text.words(F.col("search_text")))
    wanted, n = s.select("query_id", F.explode("tokens").alias("token")), c.agg(F.count("*").alias("n"))
    s.count()  # it is persisted for all sources
    before = {int(k) for k in spark.sparkContext._jsc.getPersistentRDDs()}
    for found in (retrieve.sparse(wanted, posted, n), retrieve.structured(s, c)):
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "InMemory" not in plan and "Exchange" not in plan and len(plan) < 1000
        assert found.groupBy("query_id").count().agg(F.max("count")).first()[0] == 25
    kept = [r for k, r in spark.sparkContext._jsc.getPersistentRDDs().items() if int(k) not in before]
    assert not [r for r in kept if r.getStorageLevel().useMemory()]
    assert decide.candidates(s, c)._jdf.queryExecution().executedPlan().toString().count("FileScan") < 10


def test_dense_in_blocks_against_plain_numpy(spark):
    r = np.random.default_rng(3)
    q, d = r.integers(-2, 3, (50, 8)).astype(float), r.integers(-2, 3, (300, 8)).astype(float)  # with ties and null vectors
    unit = lambda x: x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)
    scores = np.round(unit(q) @ unit(d).T, 10)
    want = sorted((f"q{i:03}", f"d{j:03}", rank) for i in range(50) for rank, j in enumerate([j for j in np.lexsort((np.arange(300), -scores[i])) if scores[i, j] > 0][:5], 1))
    frame = lambda x, n, key: spark.createDataFrame([(f"{n}{i:03}", v.tolist()) for i, v in enumerate(x)], f"{key} string, vec array<double>")
    got = retrieve.dense(frame(q, "q", "query_id"), frame(d, "d", "doc_id").repartition(7), 5, block=20)
    assert sorted((x.query_id, x.doc_id, x["rank"]) for x in got.collect()) == want


def test_many_embeddings_are_those_of_single_texts():
    texts = ["", "a", "ab", "abc  DEF", "\u0130stanbul \U0001f600x \U0001f600\U0001f600", "Brand#7 large ring LARGE large 0 2/10 ring", "x" * 50, "\ufb01ne \u00df"] * 3
    for letters in (1, 10, 1 << 20):
        for digest in (None, exact._md5):
            assert [x.tolist() for x in exact.embed_many(texts, digest=digest, letters=letters)] == [exact.embed_python(t, digest=digest) for t in texts]
    assert exact.embed_many([]) == []


def test_marked_cells_are_those_of_nonzero():
    r = np.random.default_rng(5)
    for shape in ((3, 5), (8, 16), (7, 24), (1, 8), (4, 0)):
        for share in (0.0, 0.1, 1.0):
            marked = r.random(shape) < share
            assert [x.tolist() for x in retrieve._cells(marked)] == [x.tolist() for x in np.nonzero(marked)]
            assert [x.tolist() for x in retrieve._cells(marked.T)] == [x.tolist() for x in np.nonzero(marked.T)]


def test_a_small_file_s_rows_are_dealt_over_all_cores(spark):
    """The catalogue is one small file, and so one task, but each of its rows is scored against all titles."""
    from lodeweave.plans.frames import catalog

    c, cores = catalog(spark, "/root/testdata/sf0.01"), spark.sparkContext.defaultParallelism
    assert c.rdd.getNumPartitions() < cores
    dealt = retrieve.spread(c)
    assert dealt.rdd.getNumPartitions() == cores and retrieve.spread(dealt).rdd.getNumPartitions() == cores
    assert sorted(dealt.collect()) == sorted(c.collect())


def test_many_dense_queries_are_answered_before_other_stages_wait(spark):
    """Several blocks: the result is held and the documents are not, so no broadcast of a larger plan waits behind the products."""
    one = lambda n, key: spark.range(n).selectExpr(f"cast(id as string) AS {key}", "array(1D, cast(id AS double)) AS vec")
    docs = one(9, "doc_id").select("doc_id", "vec")
    assert not retrieve.dense(one(7, "query_id"), docs, 2, block=8).is_cached
    held = retrieve.dense(one(7, "query_id"), docs, 2, block=3)
    assert held.is_cached and not docs.is_cached and not docs.select("doc_id", "vec").storageLevel.useMemory and held.count() == 14


def test_a_task_gives_only_the_best_of_its_documents(monkeypatch):
    """Each document is nearer than those before it; what is best so far mustn't leave the task. Names settle ties."""
    import pandas as pd

    monkeypatch.setattr(retrieve, "TILE", (2, 8))
    monkeypatch.setattr(retrieve, "FIRST", 16)
    angle = np.linspace(1.5, 0.1, 400)
    docs = pd.DataFrame({"doc_id": [f"d{i:03}" for i in range(400)], "vec": list(np.stack([np.cos(angle), np.sin(angle)], axis=1))})
    batches, ids, q = [docs[i : i + 50] for i in range(0, 400, 50)], np.array(["a", "b", "c"], dtype=object), np.array([[1.0, 0.0]] * 3)
    out = pd.concat(retrieve._nearest(iter(batches), ids, q, 5))
    assert sorted(zip(out["query_id"], out["doc_id"])) == [(i, f"d{j}") for i in "abc" for j in range(395, 400)]
    same = docs.assign(vec=[np.array([1.0, 1.0])] * 400)
    out = pd.concat(retrieve._nearest(iter([same[200:], same[:200]]), ids, q, 5))
    assert sorted(zip(out["query_id"], out["doc_id"])) == [(i, f"d00{j}") for i in "abc" for j in range(5)]


def test_words_without_a_common_letter_are_not_compared(monkeypatch):
    """Titles are full of numbers of their own: none of them needs a comparison with a name's words."""

    def never(*args):
        raise AssertionError("compared")

    monkeypatch.setattr(evidence, "SequenceMatcher", never)
    assert not evidence.token_match("qwrt", "90817") and evidence.group_similarity("qwrt", "90817", True) == 0.0
    assert evidence._aligned(("qwrt",), ("zx", "90817"), (1.0,), (0.5, 2.0)) == (0.0, 0.0, 0.0, 0)


def test_sets_of_candidates_are_scored_together(spark):
    """Scores are those of each set alone, without a Python call for each query."""
    from lodeweave.operators import listwise

    r = np.random.default_rng(8)
    x = {f"q{i:03}": r.normal(size=(1 + i % 25, listwise.INPUT)) for i in range(60)}
    rows = [(q, f"d{j:02}", v.tolist(), j) for q, own in x.items() for j, v in enumerate(own)]
    out = listwise.scored(spark.createDataFrame(rows, "query_id string, doc_id string, features array<double>, at int"), "at", listwise.seeded(3))
    assert "FlatMapGroupsInPandas" not in out._jdf.queryExecution().toString()
    got = {(g.query_id, g.doc_id): g.score for g in out.collect()}
    want = {(q, f"d{j:02}"): s for q, own in x.items() for j, s in enumerate(listwise.forward(own, listwise.seeded(3)))}
    assert got.keys() == want.keys() and all(math.isclose(got[k], want[k], abs_tol=1e-9) for k in want)
