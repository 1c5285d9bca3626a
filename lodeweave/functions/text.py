"""String functions as Column builders: everything here stays in whole-stage code generation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Accented Latin letters and the letters they reduce to (fixed values).
ACCENTED = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿÀÁÂÃÄÅÇÈÉÊËÌÍÎÏÑÒÓÔÕÖÙÚÛÜÝ"
PLAIN = "aaaaaaceeeeiiiinooooouuuuyyAAAAAACEEEEIIIINOOOOOUUUUY"
#: Words of listings that say nothing about identity (fixed values).
NOISE_TOKENS = ("nib", "nip", "new", "sealed", "rare", "vhtf", "htf", "hotwheels")
#: Words that the identity core leaves out (fixed values).
CORE_NOISE = tuple(
    "as blister black blue box boxed cabinet carded car case collectible collector diecast display estate find from gray green grey hot hotwheels in item light "
    "local loose maker miniature missing model new orange outer package pack piece pictured pickup protective purple red scale sealed shelf silver small sold "
    "storage the toy unopened unknown vehicle wear wheels white with yellow".split()
)
WORD = r"[\p{L}\p{N}_]+"
YEAR = r"(?<!\d)(19[6-9]\d|20[0-4]\d)(?!\d)"
POSITION = r"(?<!\d)(\d{1,3})\s*/\s*(\d{1,3})(?!\d)"
COLLECTOR = r"(?i)(?:#|no\.?\s*)([a-z]?\d{1,5}[a-z]?)(?![\p{L}\p{N}_])"
QUANTITY = r"(?i)(?:lot\s+of|qty|quantity|(?<![\p{L}\p{N}_])x)\s*[:x]?\s*(\d{1,3})(?!\d)"
PACK = r"(?i)(?<!\d)(\d{1,2})[ -]?(?:pack|pk)(?![\p{L}\p{N}_])"


def words(text: Column) -> Column:
    """Lower-cased word runs. Folds ß; `exact.normalize` does NFKC and full case folding."""
    return F.regexp_extract_all(F.replace(F.lower(text), F.lit("ß"), F.lit("ss")), F.lit(WORD), F.lit(0))


def normalize(text: Column) -> Column:
    """Words joined by one space."""
    return F.array_join(words(text), " ")


def ascii_words(text: Column) -> Column:
    """Accents stripped, other non-ASCII dropped, lower case, runs of a-z and 0-9."""
    plain = F.regexp_replace(F.translate(text, ACCENTED, PLAIN), r"[^\x00-\x7F]", "")
    return F.regexp_extract_all(F.lower(plain), F.lit("[a-z0-9]+"), F.lit(0))


def normalize_ascii(text: Column) -> Column:
    return F.array_join(ascii_words(text), " ")


def field(text: Column) -> Column:
    """One rendered field: lower case, single spaces, ``<missing>`` if blank."""
    return F.coalesce(F.nullif(F.trim(F.regexp_replace(F.lower(text), r"\s+", " ")), F.lit("")), F.lit("<missing>"))


def collection(values: Column) -> Column:
    """Distinct fields, sorted, joined by semicolons."""
    fields = F.array_sort(F.array_distinct(F.transform(F.coalesce(values, F.array().cast("array<string>")), field)))
    return F.coalesce(F.nullif(F.array_join(fields, "; "), F.lit("")), F.lit("<missing>"))


def render(names: list[str], aliases: Column | None = None, identifiers: Column | None = None) -> Column:
    """``name=value`` of each column, joined by bars."""
    parts = [F.concat(F.lit(f"{n}="), field(F.col(n).cast("string"))) for n in names]
    if aliases is not None:
        parts.append(F.concat(F.lit("aliases="), collection(aliases)))
    if identifiers is not None:
        parts.append(F.concat(F.lit("identifiers="), collection(identifiers)))
    return F.concat_ws(" | ", *parts)


def parse_rendered(text: Column) -> Column:
    """The map that a rendered text stands for."""
    pairs = F.transform(F.split(text, r" \| "), lambda p: F.struct(F.substring_index(p, "=", 1).alias("key"), F.regexp_replace(p, "^[^=]*=", "").alias("value")))
    return F.map_from_entries(pairs)


def slug(text: Column) -> Column:
    """Lower-case ASCII with hyphens; ``variant`` if nothing is left."""
    plain = F.regexp_replace(F.translate(text, ACCENTED, PLAIN), r"[^\x00-\x7F]", "")
    return F.coalesce(F.nullif(F.regexp_replace(F.regexp_replace(F.lower(plain), "[^a-z0-9]+", "-"), "^-+|-+$", ""), F.lit("")), F.lit("variant"))


def first_group(text: Column, pattern: str, group: int = 1) -> Column:
    """A group of the first match, or null."""
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))


def without(tokens: Column, dropped: tuple[str, ...]) -> Column:
    """Tokens outside a fixed list, in order, repeats kept."""
    return F.filter(tokens, lambda t: ~t.isin(*dropped))


def signals(title: Column) -> list[Column]:
    """Everything that a listing's title says on its own, as named columns."""
    years = F.regexp_extract_all(title, F.lit(YEAR), F.lit(1))
    low, high = F.try_to_number(first_group(title, POSITION, 1), F.lit("999")), F.try_to_number(first_group(title, POSITION, 2), F.lit("999"))
    quantity = F.coalesce(first_group(title, QUANTITY), first_group(title, PACK)).cast("int")
    warnings = F.array_compact(F.array(F.when(F.size(F.array_distinct(years)) > 1, F.lit("multiple_years")), F.when(low > high, F.lit("invalid_series_position"))))
    return [
        normalize(title).alias("normalized_title"),
        without(words(title), NOISE_TOKENS).alias("tokens"),
        F.get(years, F.lit(0)).cast("int").alias("year"),
        F.lower(first_group(title, COLLECTOR)).alias("collector"),
        F.concat_ws("/", low.cast("string"), high.cast("string")).alias("position_text"),
        quantity.alias("quantity"),
        F.coalesce(quantity > 1, F.lit(False)).alias("multipack"),
        warnings.alias("warnings"),
    ]


def grams(text: Column, sizes: tuple[int, ...] = (2, 3)) -> Column:
    """All character n-grams of the given sizes, with repeats."""

    def of(n: int) -> Column:
        return F.when(F.length(text) >= n, F.transform(F.sequence(F.lit(1), F.length(text) - (n - 1)), lambda i: F.substring(text, i, F.lit(n)))).otherwise(F.array().cast("array<string>"))

    return F.concat(*[of(n) for n in sizes])


def windows(tokens: Column, size: int) -> Column:
    """All runs of ``size`` tokens joined by spaces."""
    return F.when(
        F.size(tokens) >= size, F.transform(F.sequence(F.lit(1), F.size(tokens) - (size - 1)), lambda i: F.array_join(F.slice(tokens, i, F.lit(size)), " "))
    ).otherwise(F.array().cast("array<string>"))


def windows_up_to(tokens: Column, longest: Column) -> Column:
    """All runs of one to ``longest`` tokens joined by spaces; the most may differ from row to row."""
    most = F.least(F.size(tokens), longest)
    sizes = F.when(most >= 1, F.sequence(F.lit(1), most)).otherwise(F.array().cast("array<int>"))
    return F.flatten(F.transform(sizes, lambda n: F.transform(F.sequence(F.lit(1), F.size(tokens) - n + 1), lambda i: F.array_join(F.slice(tokens, i, n), " "))))


def atoms(text: Column) -> Column:
    """Runs of letters and runs of digits."""
    return F.regexp_extract_all(text, F.lit("[a-z]+|[0-9]+"), F.lit(0))


def ocr_form(token: Column) -> Column:
    """Letters that are read for digits, folded in tokens that hold a digit."""
    return F.when(token.rlike("[0-9]"), F.translate(token, "oil", "011")).otherwise(token)


def model_frame(token: Column) -> Column:
    """A token with its digit runs blanked out."""
    return F.regexp_replace(token, "[0-9]+", "#")


def year_suffix(a: Column, b: Column) -> Column:
    """Whether one is the other's year without its century."""

    def one_way(short: Column, long: Column) -> Column:
        return short.rlike("^[0-9]{2}$") & long.rlike("^(19|20)[0-9]{2}$") & (F.right(long, F.lit(2)) == short)

    return one_way(a, b) | one_way(b, a)


def one_edit(a: Column, b: Column) -> Column:
    """Letters only, both of four or more, different by one edit or by a swap of neighbours."""
    alpha = a.rlike("^[a-z]{4,}$") & b.rlike("^[a-z]{4,}$")
    swaps = F.exists(
        F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(a) - 1)),
        lambda i: F.concat(F.substring(a, F.lit(1), i - 1), F.substring(a, i + 1, F.lit(1)), F.substring(a, i, F.lit(1)), F.substring(a, i + 2, F.length(a))) == b,
    )
    return alpha & (a != b) & ((F.levenshtein(a, b) <= 1) | ((F.length(a) == F.length(b)) & swaps))


#: The ordered relations of two atoms (fixed values).
RELATIONS = ("exact", "leading_year_suffix", "leading_year_uncertainty_x", "ocr_o_zero", "ocr_repeated_digit_restore", "unique_prefix_abbreviation", "unique_alpha_edit_1")


def repeated_digit(a: Column, b: Column) -> Column:
    """Whether one is the other with one digit of a run of equal digits left out."""

    def one_way(short: Column, long: Column) -> Column:
        def cut(i: Column) -> Column:
            c = F.substring(long, i, F.lit(1))
            beside = (F.substring(long, i + 1, F.lit(1)) == c) | ((i > 1) & (F.substring(long, i - 1, F.lit(1)) == c))
            return c.rlike("[0-9]") & beside & (F.concat(F.substring(long, F.lit(1), i - 1), F.substring(long, i + 1, F.length(long))) == short)

        return (F.length(long) == F.length(short) + 1) & F.exists(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(long))), cut)

    return one_way(a, b) | one_way(b, a)


def atom_relation(a: Column, b: Column) -> Column:
    """The first of ``RELATIONS`` that holds between a query's atom and a public one, or null."""
    zero = (F.length(a) == F.length(b)) & F.concat(a, b).rlike("[0-9]") & F.concat(a, b).contains("o") & (F.translate(a, "o", "0") == F.translate(b, "o", "0"))
    prefix = a.rlike("^[a-z]{2,}$") & b.rlike("^[a-z]{5,}$") & b.startswith(a)
    tests = (a == b, year_suffix(a, b), a.rlike("^([0-9]{2}|[0-9]{4})x$") & (F.regexp_replace(a, "x$", "") == b), zero, repeated_digit(a, b), prefix, one_edit(a, b))
    out = F.when(tests[0], RELATIONS[0])
    for test, name in zip(tests[1:], RELATIONS[1:], strict=True):
        out = out.when(test, name)
    return out


def mentions(text: Column, value: Column) -> Column:
    """Whether normalised ``value`` stands in normalised ``text`` on token boundaries."""
    return (value != "") & F.contains(F.concat(F.lit(" "), text, F.lit(" ")), F.concat(F.lit(" "), value, F.lit(" ")))


def replace_all(text: Column, steps: list[tuple[str, str]]) -> Column:
    return reduce(lambda t, step: F.regexp_replace(t, step[0], step[1]), steps, text)


#: Links, addresses, handles and marketplace words, in the order they are taken out (fixed values).
SANITIZE = [
    (r"(?i)https?://\S+|www\.\S+", " "),
    (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}", " "),
    (r"@[A-Za-z0-9_]+", " "),
    (r"(?i)\b(?:ebay|etsy|amazon|mercari|facebook|seller|shop|store)\b", " "),
    (r"\s+", " "),
]
PII = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}|\+?\d{1,2}?[ .-]?\(?\d{3}\)?[ .-]\d{3}[ .-]\d{4}"
#: Markup of wiki tables and pages, in the order it is taken out (fixed values).
WIKITEXT = [
    (r"(?i)<br\s*/?>", " "),
    (r"\{\{[^{}]*\}\}", " "),
    (r"\[\[(?:[^\]|]*\|)?([^\]|]*)\]\]", "$1"),
    (r"<[^>]*>", " "),
    (r"&nbsp;", " "),
    (r"&quot;", "\""),
    (r"&lt;", "<"),
    (r"&gt;", ">"),
    (r"&amp;", "&"),
    (r"\s+", " "),
]


def sanitize(text: Column, most: int = 512) -> Column:
    """A query without links, addresses, handles and marketplace words, cut to its allowed length."""
    return F.substring(F.trim(replace_all(text, SANITIZE)), 1, most)


def clean_wikitext(text: Column) -> Column:
    return F.trim(replace_all(text, WIKITEXT))
