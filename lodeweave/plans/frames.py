"""The tables of the engine, derived from the driver's tables, and the same as SQL for the twins.

The catalogue of records comes from ``part``. The titles to resolve are listings written by six
templates, one for each part that has a supplier of the same number; the sixth names nothing in the
catalogue.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeweave.functions import exact, text
from lodeweave.operators import decide


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, brand, casting, release_year, series, color, collector_number, series_position, alias, search_text."""
    part = table(spark, sf_dir, "part")
    out = part.select(
        F.format_string("%08d", "p_partkey").alias("doc_id"),
        F.col("p_brand").alias("brand"),
        F.col("p_name").alias("casting"),
        (F.lit(1960) + F.col("p_size")).cast("int").alias("release_year"),
        F.col("p_type").alias("series"),
        F.substring_index("p_name", " ", 1).alias("color"),
        F.col("p_partkey").cast("string").alias("collector_number"),
        F.concat((F.col("p_size") % 10 + 1).cast("string"), F.lit("/10")).alias("series_position"),
        F.substring_index("p_name", " ", -1).alias("alias"),
    )
    return out.withColumn("search_text", F.concat_ws(" ", "brand", "casting", "series", "color", "collector_number", "series_position", "alias"))


CATALOG = """
catalog AS (
  SELECT *, concat_ws(' ', brand, casting, series, color, collector_number, series_position, alias) AS search_text FROM (
    SELECT printf('%08d', p_partkey) AS doc_id, p_brand AS brand, p_name AS casting, CAST(1960 + p_size AS INTEGER) AS release_year, p_type AS series,
      split_part(p_name, ' ', 1) AS color, CAST(p_partkey AS VARCHAR) AS collector_number, CAST(p_size % 10 + 1 AS VARCHAR) || '/10' AS series_position,
      split_part(p_name, ' ', -1) AS alias
    FROM part)
)"""


def titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """query_id, title, expected_id (null where nothing fits), template."""
    c = catalog(spark, sf_dir)
    supplier = table(spark, sf_dir, "supplier").select(F.format_string("%08d", "s_suppkey").alias("doc_id"))
    year, number = F.col("release_year").cast("string"), F.col("collector_number")
    template = (number.cast("int") % 6).alias("template")
    made = (
        F.when(template == 0, F.concat(year, F.lit(" "), F.col("casting"), F.lit(" #"), number, F.lit(" "), F.col("series_position")))
        .when(template == 1, F.concat(F.col("brand"), F.lit(" "), F.col("casting"), F.lit(" "), F.col("series"), F.lit(" NIB lot of 3 "), year))
        .when(template == 2, F.concat(F.initcap("casting"), F.lit(" No."), number, F.lit(" RARE sealed")))
        .when(template == 3, F.concat(F.col("brand"), F.lit(" "), F.col("series"), F.lit(" "), F.col("casting"), F.lit(" "), year, F.lit(" #"), number))
        .when(template == 4, F.concat(F.lit("new "), F.col("casting"), F.lit(" "), F.col("series_position"), F.lit(" x2 2-pack "), year, F.lit(" 2049")))
        .otherwise(F.concat(F.lit("Zephyr Quasar 12/10 lot of "), number))
    )
    out = c.join(supplier, "doc_id", "left_semi")
    return out.select(F.concat(F.lit("q"), "doc_id").alias("query_id"), made.alias("title"), F.when(template < 5, F.col("doc_id")).alias("expected_id"), template.cast("int"))


TITLES = """
titles AS (
  SELECT 'q' || doc_id AS query_id, CASE t
      WHEN 0 THEN release_year::VARCHAR || ' ' || casting || ' #' || collector_number || ' ' || series_position
      WHEN 1 THEN brand || ' ' || casting || ' ' || series || ' NIB lot of 3 ' || release_year::VARCHAR
      WHEN 2 THEN upper(casting[1:1]) || casting[2:strpos(casting, ' ')] || upper(casting[strpos(casting, ' ') + 1:strpos(casting, ' ') + 1]) || casting[strpos(casting, ' ') + 2:] || ' No.' || collector_number || ' RARE sealed'
      WHEN 3 THEN brand || ' ' || series || ' ' || casting || ' ' || release_year::VARCHAR || ' #' || collector_number
      WHEN 4 THEN 'new ' || casting || ' ' || series_position || ' x2 2-pack ' || release_year::VARCHAR || ' 2049'
      ELSE 'Zephyr Quasar 12/10 lot of ' || collector_number END AS title,
    CASE WHEN t < 5 THEN doc_id END AS expected_id, t AS template
  FROM (SELECT *, CAST(collector_number AS INTEGER) % 6 AS t FROM catalog WHERE doc_id IN (SELECT printf('%08d', s_suppkey) FROM supplier))
)"""

NORMALIZED = r"array_to_string(regexp_extract_all(replace(lower({0}), 'ß', 'ss'), '[\p{{L}}\p{{N}}_]+'), ' ')"
WORDS = r"regexp_extract_all(replace(lower({0}), 'ß', 'ss'), '[\p{{L}}\p{{N}}_]+')"
NOISE = "('nib','nip','new','sealed','rare','vhtf','htf','hotwheels')"


def vocabularies(c: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Distinct normalised colours and series of the catalogue."""
    return c.select(text.normalize("color").alias("color")).distinct(), c.select(text.normalize("series").alias("series")).distinct()


def query_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles with everything that can be read off them, hints from the catalogue's vocabularies included.

    A vocabulary value is found by its token windows, an equi-join, and not by comparing each title
    with each value. The rows are persisted, since every retriever reads them.
    """
    t = titles(spark, sf_dir).select("query_id", "title", "expected_id", "template", *text.signals(F.col("title")))
    c = catalog(spark, sf_dir)
    return t.join(hints(t, c, "color"), "query_id", "left").join(hints(t, c, "series"), "query_id", "left").select(
        *t.columns, *[F.coalesce(f"{n}_hints", F.array().cast("array<string>")).alias(f"{n}_hints") for n in ("color", "series")]
    ).persist()


def pool(spark: SparkSession, sf_dir: str, signals: DataFrame | None = None) -> DataFrame:
    """The fused candidates of all titles, persisted since reports read them more than once; vectors by MD5, so that the twin can follow."""
    return decide.candidates(signals if signals is not None else query_signals(spark, sf_dir), catalog(spark, sf_dir), embed=exact.embed_md5).persist()


def mentions(t: DataFrame, values: DataFrame, tokens: Column) -> DataFrame:
    """query_id and each of the ``values`` (of any number of tokens) whose tokens stand in a row among the query's."""
    longest = values.agg(F.coalesce(F.max(F.size(F.split("value", " "))), F.lit(0)).alias("longest"))
    held = t.select("query_id", tokens.alias("_t")).crossJoin(F.broadcast(longest))
    return held.select("query_id", F.explode(F.array_distinct(text.windows_up_to(F.col("_t"), F.col("longest")))).alias("value")).join(values, "value").select("query_id", "value")


def hints(t: DataFrame, c: DataFrame, name: str) -> DataFrame:
    """For each title the sorted vocabulary values that stand in it."""
    values = c.select(text.normalize(F.col(name)).alias("value")).where("value <> ''").distinct()
    return mentions(t, values, F.split("normalized_title", " ")).groupBy("query_id").agg(F.array_sort(F.collect_set("value")).alias(f"{name}_hints"))


SIGNALS = (
    r"""
signals0 AS (
  SELECT query_id, title, expected_id, template, """
    + NORMALIZED.format("title")
    + r""" AS normalized_title,
    list_filter("""
    + WORDS.format("title")
    + r""", lambda x: x NOT IN """
    + NOISE
    + r""") AS tokens,
    regexp_extract_all(' ' || regexp_replace(title, '([0-9])([^0-9])', '\1 \2', 'g') || ' ', '[^0-9](19[6-9][0-9]|20[0-4][0-9])[^0-9]', 1) AS years,
    TRY_CAST(nullif(regexp_extract(' ' || title || ' ', '[^0-9]([0-9]{1,3})\s*/\s*([0-9]{1,3})[^0-9]', 1), '') AS INTEGER) AS low,
    TRY_CAST(nullif(regexp_extract(' ' || title || ' ', '[^0-9]([0-9]{1,3})\s*/\s*([0-9]{1,3})[^0-9]', 2), '') AS INTEGER) AS high,
    lower(nullif(regexp_extract(title || ' ', '(?i)(?:#|no\.?\s*)([a-z]?[0-9]{1,5}[a-z]?)[^\p{L}\p{N}_]', 1), '')) AS collector,
    CAST(coalesce(nullif(regexp_extract(' ' || title || ' ', '(?i)(?:lot\s+of|qty|quantity|[^\p{L}\p{N}_]x)\s*[:x]?\s*([0-9]{1,3})[^0-9]', 1), ''),
      nullif(regexp_extract(' ' || title || ' ', '(?i)[^0-9]([0-9]{1,2})[ -]?(?:pack|pk)[^\p{L}\p{N}_]', 1), '')) AS INTEGER) AS quantity
  FROM titles),
hints AS (
  SELECT query_id, coalesce((SELECT list_sort(list(DISTINCT v)) FROM (SELECT """
    + NORMALIZED.format("color")
    + r""" AS v FROM catalog) WHERE contains(' ' || normalized_title || ' ', ' ' || v || ' ')), []) AS color_hints,
    coalesce((SELECT list_sort(list(DISTINCT v)) FROM (SELECT """
    + NORMALIZED.format("series")
    + r""" AS v FROM catalog) WHERE contains(' ' || normalized_title || ' ', ' ' || v || ' ')), []) AS series_hints
  FROM signals0),
signals AS (
  SELECT query_id, title, expected_id, template, normalized_title, tokens, CAST(years[1] AS INTEGER) AS year, collector,
    concat_ws('/', low::VARCHAR, high::VARCHAR) AS position_text, quantity, coalesce(quantity > 1, FALSE) AS multipack,
    list_filter([CASE WHEN len(list_distinct(years)) > 1 THEN 'multiple_years' END, CASE WHEN low > high THEN 'invalid_series_position' END], lambda x: x IS NOT NULL) AS warnings,
    color_hints, series_hints
  FROM signals0 JOIN hints USING (query_id))"""
)


def with_(*parts: str) -> str:
    return "WITH " + ",".join(parts)
