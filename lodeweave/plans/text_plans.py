"""Queries over string, hash, array and JSON functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodeweave.functions import hashing, maths, text
from lodeweave.plans.frames import CATALOG, NOISE, NORMALIZED, SIGNALS, TITLES, WORDS, catalog, mentions, query_signals, table, titles, with_

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return register


ASCII = "regexp_replace(translate({0}, '" + text.ACCENTED + "', '" + text.PLAIN + r"'), '[^\x00-\x7F]', '', 'g')"
ASCII_NORMALIZED = "array_to_string(regexp_extract_all(lower(" + ASCII + "), '[a-z0-9]+'), ' ')"
SLUG = "coalesce(nullif(regexp_replace(regexp_replace(lower(" + ASCII + "), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), ''), 'variant')"
FIELD = r"coalesce(nullif(trim(regexp_replace(lower({0}), '\s+', ' ', 'g')), ''), '<missing>')"


@query(f"SELECT doc_id, sha256({NORMALIZED.format('text')}) AS digest, length({NORMALIZED.format('text')}) AS n_chars, len({WORDS.format('text')})::BIGINT AS n_words FROM documents")
def normalize_text_documents(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents")
    n = text.normalize(F.col("text"))
    return d.select("doc_id", F.sha2(n, 256).alias("digest"), F.length(n).cast("long").alias("n_chars"), F.size(text.words(F.col("text"))).cast("long").alias("n_words"))


@query(f"SELECT p_partkey, {NORMALIZED.format('p_name')} AS name, {NORMALIZED.format('p_brand')} AS brand FROM part")
def normalize_text_part(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").select("p_partkey", text.normalize(F.col("p_name")).alias("name"), text.normalize(F.col("p_brand")).alias("brand"))


@query(f"SELECT doc_id, sha256({ASCII_NORMALIZED.format('text')}) AS digest FROM documents")
def normalize_ascii_review(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", F.sha2(text.normalize_ascii(F.col("text")), 256).alias("digest"))


_RENDERED = (
    "concat_ws(' | ', "
    + ", ".join(f"'{n}=' || {FIELD.format(f'CAST({n} AS VARCHAR)')}" for n in ("brand", "casting", "release_year", "series", "color", "collector_number", "series_position"))
    + ", 'aliases=' || array_to_string(list_sort(list_distinct(["
    + FIELD.format("alias")
    + ", "
    + FIELD.format("casting")
    + "])), '; '), 'identifiers=' || "
    + FIELD.format("collector_number")
    + ")"
)


def _rendered(spark: SparkSession, sf: str) -> DataFrame:
    names = ["brand", "casting", "release_year", "series", "color", "collector_number", "series_position"]
    return catalog(spark, sf).select("doc_id", text.render(names, F.array("alias", "casting"), F.array("collector_number")).alias("rendered"))


@query(with_(CATALOG) + f" SELECT doc_id, {_RENDERED} AS rendered FROM catalog")
def render_candidate_text(spark: SparkSession, sf: str) -> DataFrame:
    return _rendered(spark, sf)


@query(
    with_(CATALOG)
    + f", r AS (SELECT doc_id, {_RENDERED} AS rendered FROM catalog) SELECT doc_id, regexp_extract(rendered, 'brand=([^|]*) [|]', 1) AS brand, regexp_extract(rendered, 'casting=([^|]*) [|]', 1) AS casting, "
    "regexp_extract(rendered, 'collector_number=([^|]*) [|]', 1) AS collector_number, len(string_split(regexp_extract(rendered, 'aliases=([^|]*) [|]', 1), '; '))::BIGINT AS n_aliases FROM r"
)
def parse_candidate_text(spark: SparkSession, sf: str) -> DataFrame:
    m = _rendered(spark, sf).select("doc_id", text.parse_rendered(F.col("rendered")).alias("m"))
    return m.select("doc_id", F.col("m")["brand"].alias("brand"), F.col("m")["casting"].alias("casting"), F.col("m")["collector_number"].alias("collector_number"), F.size(F.split(F.col("m")["aliases"], "; ")).cast("long").alias("n_aliases"))


@query(
    with_(CATALOG, TITLES, SIGNALS)
    + " SELECT query_id, normalized_title, array_to_string(tokens, ' ') AS tokens, year, collector, position_text, quantity, multipack, array_to_string(warnings, ',') AS warnings, "
    "array_to_string(color_hints, ',') AS color_hints, array_to_string(series_hints, ',') AS series_hints FROM signals"
)
def extract_signals_titles(spark: SparkSession, sf: str) -> DataFrame:
    s = query_signals(spark, sf)
    joined = {n: F.array_join(n, " " if n == "tokens" else ",") for n in ("tokens", "warnings", "color_hints", "series_hints")}
    return s.withColumns(joined).select("query_id", "normalized_title", "tokens", "year", "collector", "position_text", "quantity", "multipack", "warnings", "color_hints", "series_hints")


@query(with_(CATALOG, TITLES) + f" SELECT query_id, array_to_string(list_filter({WORDS.format('title')}, lambda x: x NOT IN {NOISE}), ' ') AS kept FROM titles")
def noise_token_filter(spark: SparkSession, sf: str) -> DataFrame:
    return titles(spark, sf).select("query_id", F.array_join(text.without(text.words(F.col("title")), text.NOISE_TOKENS), " ").alias("kept"))


@query(
    f"WITH s AS (SELECT p_partkey, {SLUG.format('p_name')} AS base, sha256({NORMALIZED.format('p_brand')} || chr(31) || {NORMALIZED.format('p_name')}) AS key FROM part), "
    "f AS (SELECT base, min(p_partkey) AS owner FROM s GROUP BY base) SELECT p_partkey, base, CASE WHEN p_partkey = owner THEN base ELSE base || '-' || substr(key, 1, 8) END AS slug FROM s JOIN f USING (base)"
)
def slug_and_collision(spark: SparkSession, sf: str) -> DataFrame:
    """The first part of a slug has it; later ones get the first digits of their fingerprint behind it."""
    s = table(spark, sf, "part").select("p_partkey", text.slug(F.col("p_name")).alias("base"), hashing.fingerprint(F.col("p_brand"), F.col("p_name")).alias("key"))
    f = s.groupBy("base").agg(F.min("p_partkey").alias("owner"))
    return s.join(f, "base").select("p_partkey", "base", F.when(F.col("p_partkey") == F.col("owner"), F.col("base")).otherwise(F.concat_ws("-", "base", F.substring("key", 1, 8))).alias("slug"))


_KEY = f"concat_ws(chr(31), {NORMALIZED.format('p_brand')}, {NORMALIZED.format('p_name')}, p_size::VARCHAR, {NORMALIZED.format('p_type')}, '')"


@query(f"SELECT p_partkey, {_KEY} AS natural_key, sha256({_KEY}) AS fingerprint, 'form-' || substr(sha256({_KEY}), 1, 16) AS form_id FROM part")
def natural_key_fingerprint(spark: SparkSession, sf: str) -> DataFrame:
    fields = [F.col("p_brand"), F.col("p_name"), F.col("p_size"), F.col("p_type"), F.lit(None).cast("string")]
    p = table(spark, sf, "part").select("p_partkey", hashing.natural_key(*fields).alias("natural_key"))
    return p.select("p_partkey", "natural_key", F.sha2("natural_key", 256).alias("fingerprint"), hashing.short_id("form", F.col("natural_key")).alias("form_id"))


@query(
    f"WITH h AS (SELECT p_partkey, sha1(from_hex('{hashing.URL_NAMESPACE}') || encode('{hashing.NAME_PREFIX}' || {_KEY})) AS h FROM part) "
    "SELECT p_partkey, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' || translate(substr(h, 17, 1), '0123456789abcdef', '89ab89ab89ab89ab') || substr(h, 18, 3) || '-' || substr(h, 21, 12) AS uuid FROM h"
)
def uuid5_mint(spark: SparkSession, sf: str) -> DataFrame:
    fields = [F.col("p_brand"), F.col("p_name"), F.col("p_size"), F.col("p_type"), F.lit(None).cast("string")]
    return table(spark, sf, "part").select("p_partkey", hashing.uuid5(F.concat(F.lit(hashing.NAME_PREFIX), hashing.natural_key(*fields))).alias("uuid"))


@query(
    "WITH n AS (SELECT p_partkey, lower(p_name) AS s FROM part), g AS (SELECT p_partkey, unnest(list_concat(list_transform(range(1, length(s)), lambda i: substr(s, i, 2)), list_transform(range(1, length(s) - 1), lambda i: substr(s, i, 3)))) AS gram FROM n) "
    "SELECT gram, count(*) AS total, count(DISTINCT p_partkey) AS parts FROM g GROUP BY gram"
)
def char_gram_bag(spark: SparkSession, sf: str) -> DataFrame:
    g = table(spark, sf, "part").select("p_partkey", F.explode(text.grams(F.lower("p_name"))).alias("gram"))
    return g.groupBy("gram").agg(F.count("*").alias("total"), F.countDistinct("p_partkey").alias("parts"))


_CORE = "list_filter({0}, lambda x: x NOT IN (" + ",".join(f"'{w}'" for w in text.CORE_NOISE) + "))"


@query(with_(CATALOG, TITLES) + f" SELECT query_id, array_to_string({_CORE.format(WORDS.format('title'))}, ' ') AS core FROM titles")
def identity_core(spark: SparkSession, sf: str) -> DataFrame:
    return titles(spark, sf).select("query_id", F.array_join(text.without(text.words(F.col("title")), text.CORE_NOISE), " ").alias("core"))


@query(
    with_(CATALOG, TITLES)
    + f", c AS (SELECT query_id, {_CORE.format(WORDS.format('title'))} AS t FROM titles), w AS (SELECT DISTINCT query_id, size, array_to_string(t[i:i + size - 1], ' ') AS form FROM c, range(1, 5) s(size), range(1, 40) p(i) WHERE i + size - 1 <= len(t)) "
    "SELECT query_id, 'spaced' AS mode, form FROM w UNION SELECT query_id, 'compact', replace(form, ' ', '') FROM w"
)
def identity_windows(spark: SparkSession, sf: str) -> DataFrame:
    """All windows of one to four core tokens, spaced and compact."""
    t = titles(spark, sf).select("query_id", text.without(text.words(F.col("title")), text.CORE_NOISE).alias("t"))
    w = t.select("query_id", F.explode(F.concat(*[text.windows(F.col("t"), n) for n in range(1, 5)])).alias("spaced"))
    modes = F.array(F.struct(F.lit("spaced").alias("mode"), F.col("spaced").alias("form")), F.struct(F.lit("compact").alias("mode"), F.replace("spaced", F.lit(" "), F.lit("")).alias("form")))
    return w.select("query_id", F.explode(modes).alias("x")).select("query_id", "x.mode", "x.form").distinct()


@query(
    with_(CATALOG, TITLES)
    + f", a AS (SELECT query_id, unnest(regexp_extract_all({NORMALIZED.format('title')}, '[a-z]+|[0-9]+')) AS atom, generate_subscripts(regexp_extract_all({NORMALIZED.format('title')}, '[a-z]+|[0-9]+'), 1)::INTEGER AS p FROM titles) "
    "SELECT query_id, p - 1 AS place, atom, CASE WHEN regexp_matches(atom, '[0-9]') THEN translate(atom, 'oil', '011') ELSE atom END AS ocr, regexp_replace(atom, '[0-9]+', '#', 'g') AS frame FROM a"
)
def atomize_tokens(spark: SparkSession, sf: str) -> DataFrame:
    a = titles(spark, sf).select("query_id", F.posexplode(text.atoms(text.normalize(F.col("title")))).alias("place", "atom"))
    return a.select("query_id", "place", "atom", text.ocr_form(F.col("atom")).alias("ocr"), text.model_frame(F.col("atom")).alias("frame"))


#: Ways to write an atom ``b`` otherwise: as SQL and as Columns of b.
_SPELLINGS = [
    ("b", lambda b: b),
    ("right(b, 2)", lambda b: F.right(b, F.lit(2))),
    ("b || 'x'", lambda b: F.concat(b, F.lit("x"))),
    ("translate(b, '0', 'o')", lambda b: F.translate(b, "0", "o")),
    ("b || right(b, 1)", lambda b: F.concat(b, F.right(b, F.lit(1)))),
    ("left(b, 3)", lambda b: F.left(b, F.lit(3))),
    ("left(b, 1) || substr(b, 3)", lambda b: F.concat(F.left(b, F.lit(1)), F.substring(b, 3, 99))),
    ("substr(b, 2, 1) || left(b, 1) || substr(b, 3)", lambda b: F.concat(F.substring(b, 2, 1), F.left(b, F.lit(1)), F.substring(b, 3, 99))),
    ("reverse(b)", F.reverse),
]


@query(
    with_(CATALOG)
    + f", v AS (SELECT DISTINCT unnest(regexp_extract_all({NORMALIZED.format('search_text')}, '[a-z]+|[0-9]+')) AS b FROM catalog UNION SELECT release_year::VARCHAR FROM catalog), p AS ("
    + " UNION ".join(f"SELECT {sql} AS a, b FROM v" for sql, _ in _SPELLINGS)
    + """), c AS (SELECT *, CASE WHEN length(a) > length(b) THEN a ELSE b END AS lo, CASE WHEN length(a) > length(b) THEN b ELSE a END AS sh FROM p) SELECT a, b, CASE WHEN a = b THEN 'exact'
WHEN regexp_matches(sh, '^[0-9]{2}$') AND regexp_matches(lo, '^(19|20)[0-9]{2}$') AND right(lo, 2) = sh THEN 'leading_year_suffix'
WHEN regexp_matches(a, '^([0-9]{2}|[0-9]{4})x$') AND left(a, length(a) - 1) = b THEN 'leading_year_uncertainty_x'
WHEN length(a) = length(b) AND regexp_matches(a || b, '[0-9]') AND contains(a || b, 'o') AND replace(a, 'o', '0') = replace(b, 'o', '0') THEN 'ocr_o_zero'
WHEN length(lo) = length(sh) + 1 AND list_contains(list_transform(range(1, length(lo) + 1), lambda i: CASE WHEN regexp_matches(lo[i], '[0-9]') AND (lo[i + 1] = lo[i] OR (i > 1 AND lo[i - 1] = lo[i])) THEN left(lo, i - 1) || substr(lo, i + 1) ELSE '!' END), sh) THEN 'ocr_repeated_digit_restore'
WHEN regexp_matches(a, '^[a-z]{2,}$') AND regexp_matches(b, '^[a-z]{5,}$') AND starts_with(b, a) THEN 'unique_prefix_abbreviation'
WHEN regexp_matches(a, '^[a-z]{4,}$') AND regexp_matches(b, '^[a-z]{4,}$') AND damerau_levenshtein(a, b) = 1 THEN 'unique_alpha_edit_1' END AS relation FROM c WHERE a <> ''"""
)
def atom_relation(spark: SparkSession, sf: str) -> DataFrame:
    """All seven relations, of the catalogue's atoms to nine spellings of each."""
    c = catalog(spark, sf)
    v = c.select(F.explode(text.atoms(text.normalize(F.col("search_text")))).alias("b")).union(c.select(F.col("release_year").cast("string"))).distinct()
    p = v.select("b", F.explode(F.array_distinct(F.array(*[make(F.col("b")) for _, make in _SPELLINGS]))).alias("a")).where("a <> ''")
    return p.select("a", "b", text.atom_relation(F.col("a"), F.col("b")).alias("relation"))


@query(
    with_(CATALOG)
    + ", v AS (SELECT DISTINCT regexp_replace(casting, ' .*', '') AS a FROM catalog UNION SELECT DISTINCT alias FROM catalog), p AS (SELECT a, substr(a, 1, 1) || substr(a, 3) AS b, 'deleted' AS edit FROM v UNION ALL SELECT a, substr(a, 2, 1) || substr(a, 1, 1) || substr(a, 3), 'swapped' FROM v UNION ALL SELECT a, a || 'x', 'added' FROM v) "
    "SELECT a, b, edit, regexp_matches(a, '^[a-z]{4,}$') AND regexp_matches(b, '^[a-z]{4,}$') AND a <> b AS one_edit FROM p"
)
def one_edit_tokens(spark: SparkSession, sf: str) -> DataFrame:
    """Every catalogue word against three edits of itself: the test must find each of four letters or more."""
    c = catalog(spark, sf)
    v = c.select(F.substring_index("casting", " ", 1).alias("a")).union(c.select("alias")).distinct()
    a = F.col("a")
    edits = F.array(
        F.struct(F.concat(F.substring(a, 1, 1), F.substring(a, 3, 99)).alias("b"), F.lit("deleted").alias("edit")),
        F.struct(F.concat(F.substring(a, 2, 1), F.substring(a, 1, 1), F.substring(a, 3, 99)).alias("b"), F.lit("swapped").alias("edit")),
        F.struct(F.concat(a, F.lit("x")).alias("b"), F.lit("added").alias("edit")),
    )
    return v.select("a", F.explode(edits).alias("x")).select("a", "x.b", "x.edit", text.one_edit(a, F.col("x.b")).alias("one_edit"))


@query(
    with_(CATALOG, TITLES)
    + f", v AS (SELECT DISTINCT {NORMALIZED.format('casting')} AS value FROM catalog) SELECT query_id, value FROM titles, v WHERE length(value) >= 4 AND contains(' ' || {NORMALIZED.format('title')} || ' ', ' ' || value || ' ')"
)
def word_boundary_mentions(spark: SparkSession, sf: str) -> DataFrame:
    """Which castings of four letters or more each title mentions, by an equi-join on token windows."""
    v = catalog(spark, sf).select(text.normalize(F.col("casting")).alias("value")).where("length(value) >= 4").distinct()
    return mentions(titles(spark, sf), v, text.words(F.col("title")))


_SANITIZE = "{0}"
for _a, _b in text.SANITIZE:
    _SANITIZE = "regexp_replace(" + _SANITIZE + f", '{_a}', '{_b}', 'g')"


@query(f"SELECT conv_id, turn, sha256(substr(trim({_SANITIZE.replace('{0}', 'text')}), 1, 512)) AS digest, length(substr(trim({_SANITIZE.replace('{0}', 'text')}), 1, 512)) AS n_chars FROM conversations")
def sanitize_query(spark: SparkSession, sf: str) -> DataFrame:
    s = text.sanitize(F.col("text"))
    return table(spark, sf, "conversations").select("conv_id", "turn", F.sha2(s, 256).alias("digest"), F.length(s).cast("long").alias("n_chars"))


@query(f"SELECT source, count(*) AS documents, count_if(regexp_matches(text, '{text.PII}')) AS with_pii FROM documents GROUP BY source")
def pii_flags(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").groupBy("source").agg(F.count("*").alias("documents"), F.count_if(F.col("text").rlike(text.PII)).alias("with_pii"))


_WIKITEXT = "{0}"
for _a, _b in text.WIKITEXT:
    _WIKITEXT = f"regexp_replace({_WIKITEXT}, '{_a}', '{_b.replace('$1', chr(92) + '1')}', 'g')"


@query(
    f"WITH c AS (SELECT page_id, string_split(html, '<li>') AS parts FROM pages), x AS (SELECT page_id, unnest(parts) AS cell, generate_subscripts(parts, 1)::INTEGER - 1 AS place FROM c) "
    f"SELECT page_id, place, sha256(trim({_WIKITEXT.replace('{0}', 'cell')})) AS digest FROM x"
)
def wikitext_cells(spark: SparkSession, sf: str) -> DataFrame:
    """Pages split into list cells, each cleaned of markup."""
    x = table(spark, sf, "pages").select("page_id", F.posexplode(F.split("html", "<li>")).alias("place", "cell"))
    return x.select("page_id", "place", F.sha2(text.clean_wikitext(F.col("cell")), 256).alias("digest"))


@query(
    "SELECT s_suppkey, s_name || ' (2nd Color)' AS label, s_name AS name, '2nd Color' AS note FROM supplier"
)
def variant_note_split(spark: SparkSession, sf: str) -> DataFrame:
    s = table(spark, sf, "supplier").select("s_suppkey", F.concat("s_name", F.lit(" (2nd Color)")).alias("label"))
    note = text.first_group(F.col("label"), r"\((2nd Color[^)]*|[^)]*variant[^)]*)\)\s*$")
    return s.select("s_suppkey", "label", F.trim(F.regexp_replace("label", r"\s*\((2nd Color[^)]*|[^)]*variant[^)]*)\)\s*$", "")).alias("name"), note.alias("note"))


@query(
    "SELECT p_partkey, p_name[1:length(p_name) // 2] || p_name[length(p_name) // 2 + 2:] AS edited, replace(p_name, ' ', '-') AS spaced, array_to_string(list_transform(string_split(p_name, ' '), lambda x: x[1:3]), ' ') AS abbreviated FROM part"
)
def query_perturbations(spark: SparkSession, sf: str) -> DataFrame:
    """A letter dropped from the middle, other spacing, and each word cut to three letters."""
    n = F.col("p_name")
    half = F.floor(F.length(n) / 2).cast("int")
    return table(spark, sf, "part").select(
        "p_partkey",
        F.concat(F.substring(n, F.lit(1), half), F.substring(n, half + 2, F.length(n))).alias("edited"),
        F.replace(n, F.lit(" "), F.lit("-")).alias("spaced"),
        F.array_join(F.transform(F.split(n, " "), lambda x: F.substring(x, 1, 3)), " ").alias("abbreviated"),
    )


_TEMPLATE_AT = "CAST('0x' || substr(sha256('template' || chr(10) || CAST(p_partkey AS VARCHAR)), 1, 8) AS BIGINT) % 3"


@query(f"SELECT p_partkey, CASE {_TEMPLATE_AT} WHEN 0 THEN p_name || ' by ' || p_brand WHEN 1 THEN p_brand || ' ' || p_name ELSE p_name || ' (' || p_type || ')' END AS authored FROM part")
def template_authoring(spark: SparkSession, sf: str) -> DataFrame:
    """A text by one of three templates, chosen by a salted hash."""
    at = F.conv(F.substring(hashing.salted("template", F.col("p_partkey")), 1, 8), 16, 10).cast("long") % 3
    made = F.array(F.concat("p_name", F.lit(" by "), "p_brand"), F.concat("p_brand", F.lit(" "), "p_name"), F.concat("p_name", F.lit(" ("), "p_type", F.lit(")")))
    return table(spark, sf, "part").select("p_partkey", F.get(made, at.cast("int")).alias("authored"))


@query("SELECT s_suppkey, coalesce(nullif(regexp_replace(regexp_extract(s_name, '#(.*)$', 1), '^0+', ''), ''), '0') AS identity_number, nfc_normalize(trim(s_name)) AS stripped FROM supplier")
def identity_key(spark: SparkSession, sf: str) -> DataFrame:
    """Numbers without their leading zeros."""
    number = F.regexp_replace(F.regexp_extract("s_name", "#(.*)$", 1), "^0+", "")
    return table(spark, sf, "supplier").select("s_suppkey", F.coalesce(F.nullif(number, F.lit("")), F.lit("0")).alias("identity_number"), F.trim("s_name").alias("stripped"))


@query("SELECT doc_id, sha256(nfc_normalize(trim(text, ' '))) AS digest FROM documents")
def nfc_strip(spark: SparkSession, sf: str) -> DataFrame:
    """The exact normaliser of application keys, as an Arrow UDF."""
    from lodeweave.functions import exact

    return table(spark, sf, "documents").select("doc_id", F.sha2(exact.nfc_strip("text"), 256).alias("digest"))


@query()
def normalize_text_exact(spark: SparkSession, sf: str) -> DataFrame:
    """Full compatibility normalisation and case folding, beside the fast form: whether both agree."""
    from lodeweave.functions import exact

    d = table(spark, sf, "documents")
    return d.select("doc_id", exact.normalize("text").alias("x"), text.normalize(F.col("text")).alias("y")).select("doc_id", F.sha2("x", 256).alias("digest"), (F.col("x") == F.col("y")).alias("same"))


@query("SELECT doc_id, CASE WHEN u < 0.7 THEN 'train' WHEN u < 0.85 THEN 'dev' ELSE 'test' END AS split FROM (SELECT doc_id, CAST('0x' || substr(sha256('split' || chr(10) || CAST(doc_id AS VARCHAR)), 1, 8) AS BIGINT) / 4294967296.0 AS u FROM documents)")
def salted_split(spark: SparkSession, sf: str) -> DataFrame:
    u = hashing.hash_unit("split", F.col("doc_id"))
    return table(spark, sf, "documents").select("doc_id", F.when(u < 0.7, "train").when(u < 0.85, "dev").otherwise("test").alias("split"))


@query("SELECT p_partkey, CASE WHEN CAST('0x' || substr(sha256('family' || chr(10) || p_name), 1, 8) AS BIGINT) / 4294967296.0 < 0.7 THEN 'train' ELSE 'test' END AS split FROM part")
def grouped_split(spark: SparkSession, sf: str) -> DataFrame:
    """Whole families to one side."""
    return table(spark, sf, "part").select("p_partkey", F.when(hashing.hash_unit("family", F.col("p_name")) < 0.7, "train").otherwise("test").alias("split"))


@query(
    """WITH o AS (SELECT o_orderkey, year(o_orderdate) AS y FROM orders), n AS (SELECT y, count(*) AS n FROM o GROUP BY y), t AS (SELECT sum(n) AS total FROM n),
q AS (SELECT y, n, floor(n * 1000.0 / total) AS base, n * 1000.0 / total - floor(n * 1000.0 / total) AS frac FROM n, t),
r AS (SELECT y, base + CASE WHEN row_number() OVER (ORDER BY frac DESC, y) <= 1000 - (SELECT sum(base) FROM q) THEN 1 ELSE 0 END AS quota FROM q),
k AS (SELECT o_orderkey, y, row_number() OVER (PARTITION BY y ORDER BY sha256('quota' || chr(10) || CAST(o_orderkey AS VARCHAR))) AS rn FROM o)
SELECT y::INTEGER AS y, count(*) AS total, count_if(rn <= quota) AS chosen, min(CASE WHEN rn <= quota THEN o_orderkey END) AS first_id FROM k JOIN r USING (y) GROUP BY y"""
)
def year_stratified_quota_split(spark: SparkSession, sf: str) -> DataFrame:
    """1,000 orders dealt to years by the greatest remainders, then chosen by a salted hash within each."""
    o = table(spark, sf, "orders").select("o_orderkey", F.year("o_orderdate").alias("y"))
    n = o.groupBy("y").agg(F.count("*").alias("n"))
    share = F.col("n") * 1000.0 / F.col("total")
    # one row a year: these windows see as many rows as there are years
    q = n.crossJoin(F.broadcast(n.agg(F.sum("n").alias("total")))).select("y", F.floor(share).alias("base"), (share - F.floor(share)).alias("frac"))
    q = q.crossJoin(F.broadcast(q.agg((F.lit(1000) - F.sum("base")).alias("rest"))))
    r = q.withColumn("rn", F.row_number().over(Window.orderBy(F.col("frac").desc(), "y"))).select("y", (F.col("base") + (F.col("rn") <= F.col("rest")).cast("int")).alias("quota"))
    k = o.withColumn("rn", F.row_number().over(Window.partitionBy("y").orderBy(hashing.salted("quota", F.col("o_orderkey")))))
    chosen = F.col("rn") <= F.col("quota")
    return k.join(F.broadcast(r), "y").groupBy("y").agg(F.count("*").alias("total"), F.count_if(chosen).alias("chosen"), F.min(F.when(chosen, F.col("o_orderkey"))).alias("first_id"))


@query("SELECT n_regionkey, " + hashing.content_digest_sql("n_nationkey::VARCHAR || '=' || n_name") + " AS digest, count(*) AS n FROM nation GROUP BY n_regionkey")
def content_checksum(spark: SparkSession, sf: str) -> DataFrame:
    """A digest of the rows of each group that doesn't depend on their order."""
    line = F.concat_ws("=", F.col("n_nationkey").cast("string"), "n_name")
    return table(spark, sf, "nation").groupBy("n_regionkey").agg(hashing.content_digest(line).alias("digest"), F.count("*").alias("n"))


_FEATURES = "list_concat(string_split(lower(p_name), ' '), list_transform(range(1, length(p_name) - 1), lambda i: substr(lower(p_name), i, 3)))"


@query(
    f"WITH f AS (SELECT p_partkey, md5(unnest({_FEATURES})) AS h FROM part), b AS (SELECT p_partkey, CAST('0x' || substr(h, 1, 8) AS BIGINT) % 192 AS bucket, sum(CASE WHEN CAST('0x' || substr(h, 9, 2) AS BIGINT) % 2 = 1 THEN 1.0 ELSE -1.0 END) AS v FROM f GROUP BY 1, 2), "
    "n AS (SELECT p_partkey, sqrt(sum(v * v)) AS norm FROM b GROUP BY 1) SELECT p_partkey, bucket, round(v / norm, 6) AS weight FROM b JOIN n USING (p_partkey) WHERE v <> 0"
)
def hashing_embedding_twin(spark: SparkSession, sf: str) -> DataFrame:
    """Signed feature hashing of words and 3-grams to 192 dimensions, with md5 so that SQL can follow."""
    name = F.lower("p_name")
    f = table(spark, sf, "part").select("p_partkey", F.explode(F.concat(F.split(name, " "), text.grams(name, (3,)))).alias("f")).select("p_partkey", F.md5("f").alias("h"))
    bucket = (F.conv(F.substring("h", 1, 8), 16, 10).cast("long") % 192).alias("bucket")
    sign = F.when(F.conv(F.substring("h", 9, 2), 16, 10).cast("long") % 2 == 1, 1.0).otherwise(-1.0)
    b = f.groupBy("p_partkey", bucket).agg(F.sum(sign).alias("v"))
    norm = F.sqrt(F.sum(F.col("v") * F.col("v")).over(Window.partitionBy("p_partkey")))
    return b.select("p_partkey", "bucket", "v", norm.alias("norm")).where("v <> 0").select("p_partkey", "bucket", F.round(F.col("v") / F.col("norm"), 6).alias("weight"))


@query()
def hashing_embedding(spark: SparkSession, sf: str) -> DataFrame:
    from lodeweave.functions import exact

    return catalog(spark, sf).select("doc_id", exact.embed("search_text").alias("vec"))


@query("SELECT doc_id, round((n_chars - m) / CASE WHEN s = 0 THEN 1 ELSE s END, 6) AS z FROM documents, (SELECT avg(n_chars) AS m, stddev_pop(n_chars) AS s FROM documents)")
def zscore_features(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").select("doc_id", "n_chars")
    fit = d.agg(F.avg("n_chars").alias("m"), F.stddev_pop("n_chars").alias("s"))
    return d.crossJoin(F.broadcast(fit)).select("doc_id", F.round((F.col("n_chars") - F.col("m")) / F.when(F.col("s") == 0, 1).otherwise(F.col("s")), 6).alias("z"))


@query("SELECT p_partkey, round(CASE WHEN p_size <= 5 THEN 0.1 WHEN p_size <= 20 THEN 0.1 + (p_size - 5) / 15.0 * 0.5 WHEN p_size <= 45 THEN 0.6 + (p_size - 20) / 25.0 * 0.3 ELSE 0.9 END, 6) AS y FROM part")
def interpolation(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").select("p_partkey", F.round(maths.interpolate(F.col("p_size"), [5.0, 20.0, 45.0], [0.1, 0.6, 0.9]), 6).alias("y"))


@query("SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS iso, ts > lag(ts) OVER (PARTITION BY user_id ORDER BY event_id) AS later, abs(user_id - lag(user_id) OVER (ORDER BY event_id)) <= 1 AS adjacent FROM events")
def iso_timestamps(spark: SparkSession, sf: str) -> DataFrame:
    """ISO text, whether each event is later than the user's last, and whether neighbours are adjacent numbers."""
    e = table(spark, sf, "events")
    # the neighbour by id is found by a join on the next id, not by one window over all rows
    before = e.select((F.col("event_id") + 1).alias("event_id"), F.col("user_id").alias("last_user"))
    later = F.col("ts") > F.lag("ts").over(Window.partitionBy("user_id").orderBy("event_id"))
    return e.join(before, "event_id", "left").select("event_id", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("iso"), later.alias("later"), (F.abs(F.col("user_id") - F.col("last_user")) <= 1).alias("adjacent"))


@query(
    "WITH t AS (SELECT p_partkey, string_split(p_name, ' ') AS w FROM part) SELECT p_partkey, list_has_any(w, ['red', 'blue']) AS shares, len(w) = len(list_distinct(w)) AS distinct_words, "
    "w[1] = 'red' AND list_contains(w, 'widget') AS red_widget FROM t"
)
def ordered_subsequence(spark: SparkSession, sf: str) -> DataFrame:
    w = F.split("p_name", " ")
    return table(spark, sf, "part").select(
        "p_partkey", F.arrays_overlap(w, F.array(F.lit("red"), F.lit("blue"))).alias("shares"), (F.array_distinct(w) == w).alias("distinct_words"), maths.is_subsequence(F.array(F.lit("red"), F.lit("widget")), w).alias("red_widget")
    )


@query(
    "WITH t AS (SELECT DISTINCT list_concat(string_split(p_name, ' '), [p_type]) AS w FROM part) SELECT array_to_string(w, ' ') AS items, array_to_string(list_filter([w[1], w[2], w[3]], lambda x, i: (m >> (i - 1)) & 1 = 1), '+') AS subset FROM t, range(1, 8) r(m)"
)
def claim_combinations(spark: SparkSession, sf: str) -> DataFrame:
    """All subsets of each distinct (colour, noun, series)."""
    t = table(spark, sf, "part").select(F.concat(F.split("p_name", " "), F.array("p_type")).alias("w")).distinct()
    return t.select(F.array_join("w", " ").alias("items"), F.explode(maths.combinations(F.col("w"))).alias("s")).select("items", F.array_join("s", "+").alias("subset"))


@query(
    "WITH c AS (SELECT p_brand, p_type, count(*) AS n FROM part GROUP BY 1, 2) SELECT p_brand, p_type AS label, n FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY n DESC, lower(p_type), p_type) AS rn FROM c) WHERE rn = 1"
)
def preferred_label(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "part").groupBy("p_brand", "p_type").agg(F.count("*").alias("n"))
    best = Window.partitionBy("p_brand").orderBy(F.col("n").desc(), F.lower("p_type"), "p_type")
    return c.withColumn("rn", F.row_number().over(best)).where("rn = 1").select("p_brand", F.col("p_type").alias("label"), "n")


@query("SELECT o_orderpriority, array_to_string(list_sort(list(o_orderstatus || '=' || n::VARCHAR)), ',') AS histogram FROM (SELECT o_orderpriority, o_orderstatus, count(*) AS n FROM orders GROUP BY 1, 2) GROUP BY 1")
def status_histograms(spark: SparkSession, sf: str) -> DataFrame:
    n = table(spark, sf, "orders").groupBy("o_orderpriority", "o_orderstatus").agg(F.count("*").alias("n"))
    return n.groupBy("o_orderpriority").agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws("=", "o_orderstatus", F.col("n").cast("string")))), ",").alias("histogram"))


@query("SELECT event_type, count(*) AS n, sum(CAST(json_extract_string(props, '$.k') AS BIGINT))::BIGINT AS total_k, count_if(json_extract_string(props, '$.missing') IS NULL) AS without FROM events GROUP BY event_type")
def json_props(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").select("event_type", F.from_json("props", "k bigint, missing string").alias("p"))
    return e.groupBy("event_type").agg(F.count("*").alias("n"), F.sum("p.k").alias("total_k"), F.count_if(F.col("p.missing").isNull()).alias("without"))
