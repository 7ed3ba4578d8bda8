"""Text columns: tokens, fields, faults, ranges."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once, also where the body's lambdas use it for each element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def tokens(text: Column) -> Column:
    """White-space tokens."""
    return F.filter(F.split(text, r"\s+"), lambda x: x != "")


def token_count(text: Column) -> Column:
    return F.size(tokens(text))


def csv_tokens(text: Column) -> Column:
    """Comma-separated names, trimmed, without empty ones."""
    return F.filter(F.transform(F.split(text, ","), lambda x: F.trim(x)), lambda x: x != "")


def parse_fault(text: Column) -> Column:
    """struct(stuck_at, net) of ``sa0 net`` or ``sa1 net``, null otherwise."""
    pattern = r"(?i)^\s*sa([01])\s+(\S+)\s*$"
    return F.when(
        text.rlike(pattern),
        F.struct(F.regexp_extract(text, pattern, 1).cast("int").alias("stuck_at"), F.regexp_extract(text, pattern, 2).alias("net")),
    )


def opposite_fault(text: Column) -> Column:
    """The fault with the other polarity."""
    return F.concat(F.when(text.startswith("sa0"), F.lit("sa1")).otherwise(F.lit("sa0")), F.substr(text, F.lit(4)))


def final_part(text: Column) -> Column:
    """What follows the last tool response and the last thought."""
    return F.substring_index(F.substring_index(text, "</tool_response>", -1), "</think>", -1)


def tagged(text: Column, tag: str) -> Column:
    """Everything inside ``<tag>...</tag>``, each occurrence, trimmed."""
    return F.transform(F.regexp_extract_all(text, F.lit(rf"(?s)<{tag}>(.*?)</{tag}>"), F.lit(1)), lambda x: F.trim(x))


def assignment(text: Column) -> Column:
    """map net -> bit of ``a: 1, b: 0``; null where a net repeats, a value is no bit, or nothing is assigned."""
    parts = csv_tokens(text)
    shape = r"^([^:\s]+)\s*:\s*([01])$"
    names = F.transform(parts, lambda p: F.regexp_extract(p, shape, 1))
    valid = (F.size(parts) > 0) & F.forall(parts, lambda p: p.rlike(shape)) & (F.size(F.array_distinct(names)) == F.size(names))
    return F.when(valid, F.map_from_arrays(names, F.transform(parts, lambda p: F.regexp_extract(p, shape, 2).cast("int"))))


def ngrams(words: Column, n: int) -> Column:
    """Runs of n words, joined by a space: the words beside themselves, one further on each time."""

    def joined(w: Column) -> Column:
        k = F.size(w) - (n - 1)
        out = F.slice(w, 1, F.greatest(k, F.lit(0)))
        for i in range(1, n):
            out = F.zip_with(out, F.slice(w, i + 1, F.greatest(k, F.lit(0))), lambda a, b: F.concat(a, F.lit(" "), b))
        return F.when(k > 0, out).otherwise(F.array().cast("array<string>"))

    return let(words, joined)


def repetition(words: Column) -> Column:
    """Share of tokens that repeat an earlier one; null without tokens."""
    return F.when(F.size(words) > 0, 1 - F.size(F.array_distinct(words)) / F.size(words))


def truncate_words(text: Column, most: int) -> Column:
    return let(tokens(text), lambda w: F.when(F.size(w) <= most, F.array_join(w, " ")).otherwise(F.concat(F.array_join(F.slice(w, 1, most), " "), F.lit(" ..."))))


def sorted_lines(text: Column) -> Column:
    return F.array_join(F.array_sort(F.split(text, "\n")), "\n")


def integer_ranges(numbers: Column) -> Column:
    """``1..3, 7`` for the array [1, 2, 3, 7]; distinct and sorted first."""

    def spans(ordered: Column) -> Column:
        starts = F.filter(ordered, lambda x: ~F.array_contains(ordered, x - 1))
        ends = F.filter(ordered, lambda x: ~F.array_contains(ordered, x + 1))
        each = F.zip_with(starts, ends, lambda a, b: F.when(a == b, a.cast("string")).otherwise(F.concat(a.cast("string"), F.lit(".."), b.cast("string"))))
        return F.array_join(each, ", ")

    return let(F.array_sort(F.array_distinct(numbers)), spans)


def bus_width(declaration: Column) -> Column:
    """Nets that ``[msb:lsb]`` declares; 1 without a range."""
    shape = r"\[\s*(\d+)\s*:\s*(\d+)\s*\]"
    msb, lsb = (F.try_to_number(F.nullif(F.regexp_extract(declaration, shape, i), F.lit("")), F.lit("999999999")).cast("int") for i in (1, 2))
    return F.coalesce(F.abs(msb - lsb) + 1, F.lit(1))


def safe_name(text: Column) -> Column:
    """Anything but letters, digits, ``_`` and ``-`` as ``_``."""
    return F.regexp_replace(text, "[^A-Za-z0-9_-]", "_")


def stripped_length(items: Column, padding: Column) -> Column:
    """Length of an array without empty items and without the run of ``padding`` at its end."""
    kept = F.filter(items, lambda x: x != "")
    return F.aggregate(kept, F.struct(F.lit(0).alias("n"), F.lit(0).alias("last")), lambda a, x: F.struct((a["n"] + 1).alias("n"), F.when(x == padding, a["last"]).otherwise(a["n"] + 1).alias("last")), lambda a: a["last"])


def parse_fault_spelling(text: Column) -> Column:
    """struct(stuck_at, net) of ``sa0 net`` or ``stuck-at-0 [at|on] net`` in any case; null otherwise."""
    pattern = r"(?i)^\s*(?:sa|stuck[-_ ]?at[-_ ]?)([01])\s+(?:(?:at|on)\s+)?(\S+)\s*$"
    return F.when(text.rlike(pattern), F.struct(F.regexp_extract(text, pattern, 1).cast("int").alias("stuck_at"), F.regexp_extract(text, pattern, 2).alias("net")))


def counted(n: Column, noun: str) -> Column:
    """``1 gate``, ``2 gates``."""
    return F.concat(n.cast("string"), F.lit(f" {noun}"), F.when(n == 1, "").otherwise("s"))


def listed(items: Column) -> Column:
    """``a``, ``a and b``, ``a, b, and c``."""
    last = F.element_at(items, -1)
    several = F.concat(F.array_join(F.slice(items, 1, F.size(items) - 1), ", "), F.lit(", and "), last)
    return F.when(F.size(items) <= 1, F.array_join(items, "")).when(F.size(items) == 2, F.array_join(items, " and ")).otherwise(several)
