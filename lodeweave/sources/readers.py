"""Readers with explicit schemas and constraint checks; every reader takes any path that Spark can open."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ALIAS = "array<struct<alias_text:string, alias_type:string, source_id:string>>"
IDENTIFIER = "array<struct<identifier_type:string, identifier_value:string, source_id:string>>"
PROVENANCE = "array<struct<field_name:string, value_snapshot:string, source_name:string, source_reference:string, retrieved_at:string, license_note:string, confidence_note:string>>"
RECORD = (
    "canonical_uuid string, canonical_id string, brand string, casting string, release_year int, series string, color string, collector_number string, "
    f"series_position string, rarity_tier string, edition string, near_duplicate_group string, release_key string, aliases {ALIAS}, identifiers {IDENTIFIER}, provenance {PROVENANCE}"
)
CASE = (
    "case_id string, query string, expected_status string, expected_canonical_uuid string, expected_canonical_id string, failure_category string, "
    "casting_family string, split string, source_type string, hard_negative boolean"
)


class ConstraintError(ValueError):
    """Rows that a constraint forbids; the message holds a few of them."""


def refuse(bad: DataFrame, what: str) -> None:
    """Raise if ``bad`` has rows."""
    some = bad.take(3)
    if some:
        raise ConstraintError(f"{what}: {[r.asDict() for r in some]}")


def read_catalog(spark: SparkSession, path: str) -> DataFrame:
    """A catalogue file ``{"catalog_version": ..., "products": [...]}``, validated: unique ids, required fields, one owner for each identifier, provenance."""
    raw = spark.read.schema(f"dataset_version string, catalog_version string, products array<struct<{RECORD}>>").option("mode", "FAILFAST").json(path, multiLine=True)
    rows = raw.select("catalog_version", F.explode("products").alias("p")).select("catalog_version", "p.*")
    refuse(rows.where("canonical_uuid is null or canonical_id is null or nullif(trim(brand), '') is null or nullif(trim(casting), '') is null"), "a required field is missing")
    for key in ("canonical_uuid", "canonical_id"):
        refuse(rows.groupBy(key).count().where("count > 1"), f"{key} occurs twice")
    refuse(rows.where("release_year not between 1960 and 2050"), "release_year is out of range")
    refuse(rows.where("provenance is null or size(provenance) = 0"), "provenance is missing")
    owners = rows.select("canonical_uuid", F.explode("identifiers").alias("i")).where("i.identifier_type <> 'collector_number'")
    refuse(owners.groupBy("i.identifier_type", "i.identifier_value").agg(F.countDistinct("canonical_uuid").alias("n")).where("n > 1"), "an identifier has two owners")
    return rows


def read_cases(spark: SparkSession, path: str) -> DataFrame:
    """Benchmark cases ``{"cases": [...]}``: known splits, a target for every matched case, no family on two sides."""
    raw = spark.read.schema(f"dataset_version string, cases array<struct<{CASE}>>").option("mode", "FAILFAST").json(path, multiLine=True)
    rows = raw.select(F.explode("cases").alias("c")).select("c.*")
    refuse(rows.where("split is null or split not in ('train', 'dev', 'test')"), "an unknown split")
    refuse(rows.where("expected_status = 'matched' and expected_canonical_uuid is null"), "a matched case lacks its target")
    refuse(rows.groupBy("casting_family").agg(F.countDistinct("split").alias("n")).where("n > 1"), "a family is on two sides")
    return rows


def read_nested_catalog(spark: SparkSession, path: str) -> DataFrame:
    """Castings with nested provisional variants, flattened to one row for each variant."""
    variant = "provisional_variant_uuid string, provisional_variant_id string, identity_status string, series_label string, variant_label string"
    raw = spark.read.schema(f"castings array<struct<casting_uuid:string, casting_id:string, brand:string, casting:string, provisional_variants:array<struct<{variant}>>>>").json(path, multiLine=True)
    c = raw.select(F.explode("castings").alias("c")).select("c.casting_uuid", "c.casting_id", "c.brand", "c.casting", F.explode("c.provisional_variants").alias("v"))
    return c.select("casting_uuid", "casting_id", "brand", "casting", "v.*")


def union_of_knowledge(variants: DataFrame, families: DataFrame, key: str = "knowledge_id") -> DataFrame:
    """Two corpora in one table; ids must be unique over both."""
    both = variants.unionByName(families, allowMissingColumns=True)
    refuse(both.groupBy(key).count().where("count > 1"), f"{key} occurs twice")
    return both


def read_pairs(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines of training pairs."""
    return spark.read.schema("case_id string, query string, positive string, negative string, partition string").option("mode", "FAILFAST").json(path)


def read_labelled_csv(spark: SparkSession, path: str, required: tuple[str, ...] = ("case_id", "human_label_name", "review_status")) -> DataFrame:
    """A CSV with a header; excluded rows are left out and the comma list of failure categories is split."""
    rows = spark.read.option("header", True).option("mode", "FAILFAST").csv(path)
    names = [c.lstrip("﻿") for c in rows.columns]
    missing = sorted(set(required) - set(names))
    if missing:
        raise ConstraintError(f"columns are missing: {missing}")
    rows = rows.toDF(*names).where("review_status <> 'excluded'")
    if "failure_categories" in names:
        rows = rows.withColumn("failure_categories", F.filter(F.transform(F.split(F.coalesce("failure_categories", F.lit("")), ","), lambda x: F.trim(x)), lambda x: x != ""))
    return rows


def read_workbook(spark: SparkSession, path: str, header_row: int = 6) -> DataFrame:
    """An XLSX sheet as strings: blank rows skipped, formulas refused. Files are read whole by one task each."""
    import io

    import pandas as pd

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from openpyxl import load_workbook  # an optional dependency of this reader only

        for pdf in batches:
            for name, content in zip(pdf["path"], pdf["content"], strict=True):
                sheet = load_workbook(io.BytesIO(content), read_only=True).active
                rows = list(sheet.iter_rows(min_row=header_row, values_only=True))
                head = [str(h) for h in rows[0]]
                for at, row in enumerate(rows[1:], header_row + 1):
                    if any(v is not None and str(v).strip() for v in row):
                        if any(isinstance(v, str) and v.startswith("=") for v in row):
                            raise ConstraintError(f"a formula in row {at} of {name}")
                        yield pd.DataFrame({"file": [name], "row": [at], "fields": [{h: None if v is None else str(v) for h, v in zip(head, row, strict=False)}]})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "file string, row int, fields map<string,string>")


def wikitext_rows(pages: DataFrame, text_col: str = "wikitext", least_cells: int = 5) -> DataFrame:
    """Rows and cells of the first sortable table of each page: split at row marks, then at bars; short rows are left out."""
    table = F.regexp_extract(text_col, r"(?s)\{\|[^\n]*sortable(.*?)\n\|\}", 1)
    rows = pages.select("*", F.posexplode(F.split(table, r"\n\|-[^\n]*\n")).alias("row", "body"))
    cells = F.transform(F.split(F.regexp_replace("body", r"^\s*\|", ""), r"\n\||\|\|"), lambda x: F.trim(x))
    return rows.withColumn("cells", cells).where(F.size("cells") >= least_cells).drop("body")


def read_snapshot(spark: SparkSession, path: str, version: str) -> DataFrame:
    """A published snapshot, in the order of its ids, after its digest has been checked."""
    from lodeweave.sources.writers import _Files, digest_of

    rows = spark.read.parquet(f"{path}/version={version}")
    manifest = _Files(spark, path).read(f"_manifest-{version}.json")
    if manifest["digest"] != digest_of(rows):
        raise ConstraintError(f"the digest of version {version} differs")
    return rows


def fetch(url: str, most_bytes: int = 3 << 20, seconds: float = 30.0, schemes: tuple[str, ...] = ("https",)) -> bytes:
    """The body of a page, fetched by the driver: refused if it isn't of one of the ``schemes`` or is longer than ``most_bytes``."""
    from urllib.parse import urlsplit
    from urllib.request import Request, urlopen

    if urlsplit(url).scheme not in schemes:
        raise ConstraintError(f"the address must begin with {' or '.join(schemes)}")
    with urlopen(Request(url, headers={"User-Agent": "lodeweave"}), timeout=seconds) as answer:  # noqa: S310  schemes are checked
        if urlsplit(answer.url).scheme not in schemes:
            raise ConstraintError("the address leads to another scheme")
        body = answer.read(most_bytes + 1)
    if len(body) > most_bytes:
        raise ConstraintError(f"the page is longer than {most_bytes} bytes")
    return body


def revision(spark: SparkSession, address: str, **options) -> DataFrame:
    """One row (title, revision, wikitext) of a wiki's query answer for a single page's latest revision."""
    import json

    pages = json.loads(fetch(address, **options))["query"]["pages"]
    pages = list(pages.values()) if isinstance(pages, dict) else pages
    if len(pages) != 1 or "revisions" not in pages[0]:
        raise ConstraintError("the answer must hold one page with a revision")
    r = pages[0]["revisions"][0]
    content = r.get("slots", {}).get("main", r)
    return spark.createDataFrame([(pages[0]["title"], int(r["revid"]), content.get("content", content.get("*")))], "title string, revision long, wikitext string")
