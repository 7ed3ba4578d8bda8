"""Signal names, buses, bit vectors and assignments (arrays of struct(name, bit)) as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .keys import seeded_order
from .text import integer_ranges, let

BRACKET = r"^(.+)\[(\d+)\]$"
SUFFIX = r"^(.+/[A-Za-z_]+)(\d+)$"


def indexed(token: Column) -> Column:
    """struct(family, index, style) of ``x[3]`` or ``u/n73``; null for other names."""

    def parts(shape: str, style: str) -> Column:
        return F.struct(F.regexp_extract(token, shape, 1).alias("family"), F.regexp_extract(token, shape, 2).cast("int").alias("index"), F.lit(style).alias("style"))

    return F.when(token.rlike(BRACKET), parts(BRACKET, "bracket")).when(token.rlike(SUFFIX), parts(SUFFIX, "suffix"))


def compact_signals(tokens: Column) -> Column:
    """``x[0..1, 3], u/n[7..8], clk``: indexed names by family in order of appearance, then the plain ones."""

    def whole(all_tokens: Column) -> Column:
        def families(parsed: Column) -> Column:
            names = F.array_distinct(F.transform(parsed, lambda p: p["family"]))

            def one(f: Column) -> Column:
                own = F.filter(parsed, lambda p: p["family"] == f)
                numbers = F.array_distinct(F.transform(own, lambda p: p["index"]))
                single = (F.get(own, F.lit(0))["style"] == "suffix") & (F.size(numbers) == 1)
                return F.when(single, F.concat(f, F.get(numbers, F.lit(0)).cast("string"))).otherwise(F.concat(f, F.lit("["), integer_ranges(numbers), F.lit("]")))

            return F.transform(names, one)

        grouped = let(F.filter(F.transform(all_tokens, indexed), lambda p: p.isNotNull()), families)
        plain = F.array_distinct(F.filter(all_tokens, lambda t: indexed(t).isNull()))
        return F.array_join(F.concat(grouped, plain), ", ")

    return let(tokens, whole)


def compact_assignment(pairs: Column, least: int = 24) -> Column:
    """``a: 1, b: 0`` of fewer than ``least`` pairs; larger ones by bus: the bits from the lowest where a bus starts at 0 and has
    at most 16, else the ranges of its ones (``-`` without)."""

    def whole(p: Column) -> Column:
        plain = F.transform(p, lambda x: F.concat(x["name"], F.lit(": "), x["bit"].cast("string")))

        def grouped(parsed: Column) -> Column:
            def one(f: Column) -> Column:
                def bus(own: Column) -> Column:
                    numbers = F.transform(own, lambda o: o["index"])
                    low, high = F.array_min(numbers), F.array_max(numbers)
                    ones = F.transform(F.filter(own, lambda o: o["bit"] == 1), lambda o: o["index"])
                    shown = F.when(F.size(ones) > 0, integer_ranges(ones)).otherwise("-")
                    unbroken = F.size(numbers) == high - low + 1
                    bits = F.array_join(F.transform(own, lambda o: o["bit"].cast("string")), "")
                    span = F.when(unbroken, F.concat(low.cast("string"), F.lit(".."), high.cast("string"))).otherwise(integer_ranges(numbers))
                    short = F.concat(f, F.lit("[0.."), high.cast("string"), F.lit("] bits_lsb0="), bits)
                    return F.when(unbroken & (low == 0) & (F.size(numbers) <= 16), short).otherwise(F.concat(f, F.lit("["), span, F.lit("] ones={"), shown, F.lit("}")))

                own = F.filter(parsed, lambda o: o["family"] == f)
                return let(F.array_sort(F.transform(own, lambda o: F.struct(o["index"].alias("index"), o["bit"].alias("bit")))), bus)

            return F.transform(F.array_distinct(F.transform(parsed, lambda o: o["family"])), one)

        bracket = lambda x: x["name"].rlike(BRACKET)
        parsed = F.transform(F.filter(p, bracket), lambda x: F.struct(F.regexp_extract(x["name"], BRACKET, 1).alias("family"), F.regexp_extract(x["name"], BRACKET, 2).cast("int").alias("index"), x["bit"].alias("bit")))
        rest = F.transform(F.filter(p, lambda x: ~bracket(x)), lambda x: F.concat(x["name"], F.lit(": "), x["bit"].cast("string")))
        return F.when(F.size(p) < least, F.array_join(plain, ", ")).otherwise(F.array_join(F.concat(let(parsed, grouped), rest), ", "))

    return let(pairs, whole)


def bus_widths(tokens: Column) -> Column:
    """map base -> width (greatest index and one) of the indexed names of an array; scalars have width 1."""

    def widths(parsed: Column) -> Column:
        names = F.array_distinct(F.transform(parsed, lambda p: p["family"]))
        return F.map_from_arrays(names, F.transform(names, lambda f: F.array_max(F.transform(F.filter(parsed, lambda p: p["family"] == f), lambda p: p["width"]))))

    one = lambda t: F.when(t.rlike(BRACKET), F.struct(F.regexp_extract(t, BRACKET, 1).alias("family"), (F.regexp_extract(t, BRACKET, 2).cast("int") + 1).alias("width"))).otherwise(F.struct(t.alias("family"), F.lit(1).alias("width")))
    return let(F.transform(tokens, one), widths)


def reversed_buses(pairs: Column) -> Column:
    """The assignment with the bits of every bus in reverse: the lowest index gets the bit of the highest."""

    def whole(p: Column) -> Column:
        def one(x: Column) -> Column:
            family = F.regexp_extract(x["name"], BRACKET, 1)
            own = F.array_sort(F.transform(F.filter(p, lambda o: o["name"].rlike(BRACKET) & (F.regexp_extract(o["name"], BRACKET, 1) == family)), lambda o: F.struct(F.regexp_extract(o["name"], BRACKET, 2).cast("int").alias("index"), o["bit"].alias("bit"))))

            def mirrored(bus: Column) -> Column:
                at = F.array_position(F.transform(bus, lambda o: o["index"]), F.regexp_extract(x["name"], BRACKET, 2).cast("int"))
                return F.element_at(bus, (-at).cast("int"))["bit"]

            return F.struct(x["name"].alias("name"), F.when(x["name"].rlike(BRACKET), let(own, mirrored)).otherwise(x["bit"]).alias("bit"))

        return F.transform(p, one)

    return let(pairs, whole)


def random_bits(seed: int, key: Column, n: int) -> Column:
    """A fixed random string of n (at most 256) bits, from the seeded digest of the key."""
    digits = F.transform(F.split(F.substring(seeded_order(seed, key), 1, -(-n // 4)), ""), lambda h: F.lpad(F.conv(h, 16, 2), 4, "0"))
    return F.left(F.array_join(F.filter(digits, lambda d: F.length(d) == 4), ""), F.lit(n))


def named_bits(names: Column, bits: Column) -> Column:
    """The bits of a string by the names in declared order; null where the counts differ."""
    return F.when(F.size(names) == F.length(bits), F.zip_with(names, F.filter(F.split(bits, ""), lambda b: b != ""), lambda n, b: F.struct(n.alias("name"), b.cast("int").alias("bit"))))


def answer_text(names: Column, bits: Column) -> Column:
    """``a: 1, b: 0`` of names and a bit string."""
    return F.array_join(F.transform(named_bits(names, bits), lambda p: F.concat(p["name"], F.lit(": "), p["bit"].cast("string"))), ", ")


def hamming(a: Column, b: Column) -> Column:
    """Share of places at which two strings of equal length differ."""
    letters = lambda x: F.filter(F.split(x, ""), lambda c: c != "")
    return F.size(F.filter(F.zip_with(letters(a), letters(b), lambda x, y: x != y), lambda d: d)) / F.length(a)


def gate(kind: str, inputs: Column) -> Column:
    """A gate over an array of bits: and, or, xor, buf and their opposites not, nand, nor, xnor."""
    plain = {"nand": "and", "nor": "or", "xnor": "xor", "not": "buf"}.get(kind, kind)
    ones = F.aggregate(inputs, F.lit(0), lambda a, x: a + x.cast("int"))
    value = {"and": ones == F.size(inputs), "or": ones > 0, "xor": ones % 2 == 1, "buf": F.get(inputs, F.lit(0)).cast("int") == 1}[plain].cast("int")
    return value if plain == kind else 1 - value


def base_cell(cell: Column) -> Column:
    """The functional part of a cell name, before its drive strength or its technology."""
    return F.when(cell.rlike(r"^[A-Z][A-Z0-9]*x"), F.regexp_extract(cell, r"^([A-Z][A-Z0-9]*)x", 1)).otherwise(F.substring_index(cell, "_ASAP7", 1))


def drive_value(cell: Column) -> Column:
    """The drive strength of a cell name: x2 is 2, xp33 0.33, x1p5 1.5; 1 without."""
    shape = r"^.+?x(\d*)(?:p(\d+))?"
    whole, part = F.regexp_extract(cell, shape, 1), F.regexp_extract(cell, shape, 2)
    plain = F.nullif(whole, F.lit("")).cast("double")
    return F.when(part != "", F.concat(F.when(whole == "", "0").otherwise(whole), F.lit("."), part).cast("double")).otherwise(F.coalesce(F.when(plain > 0, plain), F.lit(1.0)))


def drive_class(value: Column) -> Column:
    """One of ten classes of drive strength."""
    out = F.when(value.isNull(), None)
    # The upper bounds of the classes.
    for bound, name in ((0.5, "TINY"), (1, "SMALL"), (2, "X1"), (3, "X2"), (4, "X3"), (6, "X4"), (8, "X6"), (12, "X8"), (16, "X12")):
        out = out.when(value < bound, name)
    return out.otherwise("X16_PLUS")


def input_class(n: Column) -> Column:
    return F.when(n <= 0, "UNKNOWN").when(n >= 6, "6_PLUS").otherwise(n.cast("string"))


def family(prefix: Column, names: Column) -> Column:
    """The family of a cell prefix in a map, tried again without the digits at its end."""
    return F.coalesce(F.try_element_at(names, prefix), F.try_element_at(names, F.regexp_replace(prefix, r"\d+$", "")), F.lit("UNKNOWN"))


def site_class(net: Column, inputs: Column, outputs: Column) -> Column:
    """po, pi or internal; outputs are tested first, and ``y_82`` also counts as ``y[82]``."""
    shape = r"^([A-Za-z]\w*?)_(\d+)$"
    other = F.when(net.rlike(shape), F.concat(F.regexp_extract(net, shape, 1), F.lit("["), F.regexp_extract(net, shape, 2), F.lit("]")))
    inside = lambda names, x: F.coalesce(F.array_contains(names, x), F.lit(False))
    return F.when(inside(outputs, net), "po").when(inside(inputs, net), "pi").when(inside(outputs, other), "po").when(inside(inputs, other), "pi").otherwise("internal")


def difficulty_class(status: Column, zero_status: Column, p: Column) -> Column:
    """The class of a fault by its status and the probability that one random vector detects it."""
    return (
        F.when(status != "ok", "unknown").when(status.isNull(), "unknown").when(F.coalesce(zero_status, F.lit("")) != "", zero_status)
        .when(p >= 0.25, "easy_p>=0.25").when(p >= 0.0625, "medium_0.0625<=p<0.25").when(p >= 1 / 256, "hard_0.00390625<=p<0.0625").otherwise("very_hard_p<0.00390625")
    )


def differs(good: Column, bad: Column) -> Column:
    """Whether two maps net -> bit differ in a net that both know; unknown (null) bits are no difference."""
    return F.exists(F.map_keys(good), lambda n: F.coalesce(F.element_at(good, n) != F.element_at(bad, n), F.lit(False)))


def activated(good: Column, bad: Column, net: Column, stuck: Column) -> Column:
    """Whether the faulty net holds its stuck value in the bad machine and another one in the good machine."""
    g, b = F.try_element_at(good, net), F.try_element_at(bad, net)
    return F.coalesce((b == stuck) & (g != b), F.lit(False))


def matched_share(predicted: Column, gold: Column) -> Column:
    """Share of the gold map's keys that the predicted map has with the same value; missing ones are wrong; 0 without keys."""
    keys = F.map_keys(gold)
    hits = F.size(F.filter(keys, lambda k: F.coalesce(F.try_element_at(predicted, k) == F.element_at(gold, k), F.lit(False))))
    return F.when(F.size(keys) > 0, hits / F.size(keys)).otherwise(0.0)


def complete_share(predicted: Column, required: Column) -> Column:
    """Share of the required names to which the predicted map gives 0 or 1; 0 without names."""
    hits = F.size(F.filter(required, lambda k: F.coalesce(F.try_element_at(predicted, k).isin(0, 1), F.lit(False))))
    return F.when(F.size(required) > 0, hits / F.size(required)).otherwise(0.0)
