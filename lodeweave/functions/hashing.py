"""Hash functions: keys, fingerprints, name-based ids and salted orders."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lodeweave.functions import text

#: The URL namespace of name-based ids and the prefix of their names (fixed values).
URL_NAMESPACE = "6ba7b8119dad11d180b400c04fd430c8"
NAME_PREFIX = "pvr:"


def natural_key(*fields: Column) -> Column:
    """Normalised fields joined by the unit separator; null counts as empty."""
    return F.concat_ws("\x1f", *[F.coalesce(text.normalize(f.cast("string")), F.lit("")) for f in fields])


def fingerprint(*fields: Column) -> Column:
    return F.sha2(natural_key(*fields), 256)


def uuid5(name: Column, namespace: str = URL_NAMESPACE) -> Column:
    """The version 5 UUID of a name."""
    h = F.sha1(F.concat(F.unhex(F.lit(namespace)), F.encode(name, "UTF-8")))
    variant = F.translate(F.substring(h, 17, 1), "0123456789abcdef", "89ab89ab89ab89ab")
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("5"), F.substring(h, 14, 3)), F.concat(variant, F.substring(h, 18, 3)), F.substring(h, 21, 12))


def salted(salt: str, *parts: Column, separator: str = "\n") -> Column:
    """The hash by which splits and deterministic orders are made."""
    return F.sha2(F.concat_ws(separator, F.lit(salt), *[p.cast("string") for p in parts]), 256)


def hash_unit(salt: str, *parts: Column) -> Column:
    """A number in [0, 1) from the first 32 bits of the salted hash."""
    return F.conv(F.substring(salted(salt, *parts), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def short_id(kind: str, *parts: Column, length: int = 16) -> Column:
    """A readable id: the kind and the first digits of a hash."""
    return F.concat(F.lit(f"{kind}-"), F.substring(F.sha2(F.concat_ws("\x1f", *[p.cast("string") for p in parts]), 256), 1, length))


def content_digest(line: Column) -> Column:
    """An order-free digest over lines, as an aggregate: their number and the sums of their hashes in four 32-bit lanes.

    Nothing is gathered but five numbers, whatever the size of a group.
    """
    h = F.sha2(line, 256)
    lanes = [F.sum(F.conv(F.substring(h, 1 + 8 * i, 8), 16, 10).cast("decimal(38,0)")) for i in range(4)]
    return F.concat_ws("-", F.count(line).cast("string"), *[x.cast("string") for x in lanes])


def content_digest_sql(line: str) -> str:
    """``content_digest`` for DuckDB."""
    lanes = ", ".join(f"sum(CAST('0x' || substr(sha256({line}), {1 + 8 * i}, 8) AS BIGINT))::HUGEINT::VARCHAR" for i in range(4))
    return f"concat_ws('-', count({line})::VARCHAR, {lanes})"
