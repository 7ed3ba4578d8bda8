"""Identity keys and hash-based routing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TWO_64 = 18446744073709551616.0


def sha256(text: str | Column) -> Column:
    return F.sha2(F.coalesce(text if isinstance(text, Column) else F.col(text), F.lit("")), 256)


def short_id(text: str | Column, digits: int = 16) -> Column:
    """First hex digits of the text's SHA-256."""
    return F.substring(sha256(text), 1, digits)


def normalised_digest(text: Column) -> Column:
    """SHA-256 of the text with CRLF as LF and outer white space stripped."""
    return F.sha2(F.regexp_replace(F.replace(text, F.lit("\r\n"), F.lit("\n")), r"^\s+|\s+$", ""), 256)


def aliases(text: Column, doc_id: Column) -> Column:
    """The two names of a circuit; records are the same if any name is."""
    return F.array_compact(F.array(F.concat(F.lit("net:"), normalised_digest(text)), F.concat(F.lit("doc:"), doc_id.cast("string"))))


def seeded_order(seed: int, key: Column) -> Column:
    """A fixed random order: SHA-256 of seed and key."""
    return F.sha2(F.concat_ws(":", F.lit(str(seed)), key.cast("string")), 256)


def unit_interval(seed: int, key: Column) -> Column:
    """A fixed uniform number in [0, 1): the first 64 bits of the seeded digest."""
    return F.conv(F.substring(seeded_order(seed, key), 1, 16), 16, 10).cast("double") / F.lit(TWO_64)


def hash_split(seed: int, key: Column, ratios: tuple[float, float, float] = (0.8, 0.1, 0.1)) -> Column:
    """train, validation or test by the key's place in the unit interval; ratios are normalised."""
    total = sum(ratios)
    u = unit_interval(seed, key)
    return F.when(u < ratios[0] / total, "train").when(u < (ratios[0] + ratios[1]) / total, "validation").otherwise("test")
