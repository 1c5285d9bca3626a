"""Readers, writers and streams."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from lodeweave.plans.frames import catalog, titles
from lodeweave.sources import readers, writers
from lodeweave.streaming import resolve

SF = "/root/testdata/sf0.001"


def record(i, **more):
    base = {"canonical_uuid": f"u{i}", "canonical_id": f"c{i}", "brand": "B", "casting": "C", "release_year": 2022, "identifiers": [], "aliases": [], "provenance": [{"source_name": "s"}]}
    return base | more


def write(path, value):
    path.write_text(value if isinstance(value, str) else json.dumps(value), encoding="utf-8")
    return str(path)


def test_catalog(spark, tmp_path):
    good = {"catalog_version": "v", "products": [record(1), record(2)]}
    assert readers.read_catalog(spark, write(tmp_path / "a.json", good)).count() == 2
    same = [{"identifier_type": "upc", "identifier_value": "1", "source_id": "s"}]
    for bad in ([record(1), record(1)], [record(1, brand=" ")], [record(1, release_year=1900)], [record(1, provenance=[])], [record(1, identifiers=same), record(2, identifiers=same)]):
        with pytest.raises(readers.ConstraintError):
            readers.read_catalog(spark, write(tmp_path / "b.json", {"products": bad}))


def test_cases(spark, tmp_path):
    case = {"case_id": "1", "query": "q", "expected_status": "no_match", "casting_family": "f", "split": "dev"}
    assert readers.read_cases(spark, write(tmp_path / "a.json", {"cases": [case]})).count() == 1
    for bad in ([case | {"split": "x"}], [case | {"expected_status": "matched"}], [case, case | {"split": "test"}]):
        with pytest.raises(readers.ConstraintError):
            readers.read_cases(spark, write(tmp_path / "b.json", {"cases": bad}))


def test_csv_and_wikitext(spark, tmp_path):
    path = write(tmp_path / "a.csv", "﻿case_id,human_label_name,review_status,failure_categories\n1,n,ok,\"a, b,\"\n2,n,excluded,\n")
    assert [r.failure_categories for r in readers.read_labelled_csv(spark, path).collect()] == [["a", "b"]]
    with pytest.raises(readers.ConstraintError):
        readers.read_labelled_csv(spark, path, ("nothing",))
    page = '{| class="sortable"\n! head\n|-\n|1||2||3||4||5\n|-\n|a||b\n|}\n'
    rows = readers.wikitext_rows(spark.createDataFrame([(page,)], "wikitext string")).collect()
    assert [r.cells for r in rows] == [["1", "2", "3", "4", "5"]]


def test_snapshots(spark, tmp_path):
    path, rows = f"{tmp_path}/s", spark.createDataFrame([(1, "a"), (2, None)], "id long, v string")
    assert writers.import_snapshot(rows, path, "1") == "inserted"
    assert writers.import_snapshot(rows.orderBy(F.col("id").desc()), path, "1") == "unchanged"
    with pytest.raises(ValueError):
        writers.import_snapshot(rows.limit(1), path, "1")
    assert readers.read_snapshot(spark, path, "1").count() == 2
    writers.publish(rows.limit(1), path, "2")
    assert writers.current(spark, path).count() == 1


def test_pointer_numbers_and_claims(spark, tmp_path):
    """What is current is the largest number, whatever the clocks say; a number whose writer died is passed over."""
    path, rows = f"{tmp_path}/s", spark.createDataFrame([(1, "a"), (2, None)], "id long, v string")
    for version, n in (("1", 2), ("2", 1), ("1", 2)):
        writers.publish(rows.limit(n), path, version)
    assert writers.current(spark, path).count() == 2
    (tmp_path / "s" / "_pointer" / "000000000004.json.claim").write_text("")
    writers.publish(rows.limit(1), path, "2")
    assert writers.current(spark, path).count() == 1


def test_publication_of_several_tables(spark, tmp_path):
    root, a, b = f"{tmp_path}/p", spark.range(5), spark.range(3).withColumn("x", F.lit(None).cast("string"))
    assert writers.recover(spark, root) == "absent"
    assert writers.publish_all({"a": a, "b": b}, root) == 1 and writers.recover(spark, root) == "completed"
    # cut off behind the journal and the first table
    (tmp_path / "p" / "journal-2.json").write_text('{"number": 2, "status": "prepared", "digests": {}}')
    (tmp_path / "p" / "journal-2.json.claim").write_text("")
    a.limit(1).write.parquet(f"{root}/2/a")
    assert writers.published(spark, root, "a").count() == 5
    with pytest.raises(RuntimeError):
        writers.publish_all({"a": a.limit(2), "b": b}, root)
    assert writers.recover(spark, root) == "rolled_back" and not (tmp_path / "p" / "2").exists()
    assert writers.publish_all({"a": a.limit(2), "b": b}, root) == 2 and writers.published(spark, root, "a").count() == 2
    a.write.mode("overwrite").parquet(f"{root}/2/a")
    assert writers.recover(spark, root) == "in_doubt"


def test_reports(spark):
    rows = spark.createDataFrame([("a|b", 1), (None, 2)], "k string, n long")
    assert writers.markdown(rows, "T") == "# T\n\n| k | n |\n| --- | --- |\n| a\\|b | 1 |\n|  | 2 |\n"
    with pytest.raises(ValueError):
        writers.markdown(spark.range(4), "T", most=3)


def test_fetch(spark):
    import json
    import threading
    from http.server import BaseHTTPRequestHandler, HTTPServer

    body = json.dumps({"query": {"pages": [{"title": "P", "revisions": [{"revid": 7, "slots": {"main": {"content": "text"}}}]}]}}).encode()

    class Handler(BaseHTTPRequestHandler):
        def do_GET(self):
            self.send_response(200)
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *args):
            pass

    server = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    address = f"http://127.0.0.1:{server.server_port}/"
    try:
        with pytest.raises(readers.ConstraintError):
            readers.fetch(address)
        with pytest.raises(readers.ConstraintError):
            readers.fetch(address, most_bytes=len(body) - 1, schemes=("http",))
        assert readers.fetch(address, most_bytes=len(body), schemes=("http",)) == body
        assert [tuple(r) for r in readers.revision(spark, address, schemes=("http",)).collect()] == [("P", 7, "text")]
    finally:
        server.shutdown()


def test_tracing(spark):
    from lodeweave import tracing

    timings, seen = {}, []

    class Span:
        def set_attribute(self, key, value):
            seen.append((key, value))

        def record_exception(self, error):
            seen.append(("exception", type(error)))

    class Tracer:
        from contextlib import contextmanager

        @contextmanager
        def start_as_current_span(self, name):
            yield Span()

    with tracing.stage("quiet", timings) as span:
        assert span is None
    with pytest.raises(KeyError), tracing.stage("loud", timings, Tracer()):
        raise KeyError("x")
    assert set(timings) == {"quiet", "loud"} and ("error_type", "KeyError") in seen and ("stage", "loud") in seen
    df, got = tracing.counted(spark.range(7), "n", most=F.max("id"))
    df.write.format("noop").mode("overwrite").save()
    assert got.get == {"rows": 7, "most": 6}


def test_stream_equals_batch(spark, tmp_path):
    c = catalog(spark, SF)
    t = titles(spark, SF).select("query_id", "title")
    t.repartition(3).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(t.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    q = resolve.resolve_stream(stream, c, f"{tmp_path}/out", f"{tmp_path}/cp").trigger(availableNow=True).start()
    q.awaitTermination()
    got = {(r.query_id, r.status, r.doc_id) for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    from lodeweave.plans.decision_plans import resolve_decisions

    assert got == {(r.query_id, r.status, r.doc_id) for r in resolve_decisions(spark, SF).collect()}


def test_windowed_stream(spark, tmp_path):
    e = spark.read.parquet(f"{SF}/events.parquet")
    e.write.parquet(f"{tmp_path}/e")
    stream = spark.readStream.schema(e.schema).parquet(f"{tmp_path}/e")
    q = resolve.windowed_counts(stream).writeStream.outputMode("append").format("memory").queryName("counts").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.sql("select count(*) from counts").first()[0] > 0
