"""JSON documents: canonical text, digests, leaves by path, merges, differences, dotted paths."""

from __future__ import annotations

import json

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


def canonical(text: Column) -> Column:
    """Canonical JSON: keys sorted, no white space, ASCII only; null for what is no JSON.  Sorting and escaping have no built-in form."""

    @F.arrow_udf("string")
    def dump(texts: pa.Array) -> pa.Array:
        def one(t):
            try:
                return None if t is None else json.dumps(json.loads(t), sort_keys=True, separators=(",", ":"), ensure_ascii=True)
            except ValueError:
                return None

        return pa.array([one(t) for t in texts.to_pylist()], pa.string())

    return dump(text)


def digest(text: Column) -> Column:
    """SHA-256 of the canonical JSON."""
    return F.sha2(canonical(text), 256)


def leaves(text: Column) -> Column:
    """map path -> JSON of the leaf (``a.b``, ``a[0]``); an empty map for what is no JSON.  A column of its own: it can't stand
    inside a lambda."""

    @F.arrow_udf("map<string,string>")
    def flat(texts: pa.Array) -> pa.Array:
        def walk(value, at, out):
            if isinstance(value, dict) and value:
                for k, v in value.items():
                    walk(v, f"{at}.{k}" if at else k, out)
            elif isinstance(value, list) and value:
                for i, v in enumerate(value):
                    walk(v, f"{at}[{i}]", out)
            else:
                out[at] = json.dumps(value, sort_keys=True)

        def one(t):
            out: dict[str, str] = {}
            try:
                if t is not None:
                    walk(json.loads(t), "", out)
            except ValueError:
                return []
            return list(out.items())

        return pa.array([one(t) for t in texts.to_pylist()], pa.map_(pa.string(), pa.string()))

    return flat(text)


def differences(before: Column, after: Column) -> Column:
    """array of struct(path, before, after) of the leaves that are not the same, by path; ``before`` and ``after`` are leaves."""
    paths = F.array_sort(F.array_union(F.map_keys(before), F.map_keys(after)))
    each = F.transform(paths, lambda p: F.struct(p.alias("path"), F.try_element_at(before, p).alias("before"), F.try_element_at(after, p).alias("after")))
    return F.filter(each, lambda d: ~d["before"].eqNullSafe(d["after"]))


def merged(base: Column, over: Column) -> Column:
    """The leaves of a document under those of another, path by path."""
    return F.map_concat(F.map_filter(base, lambda k, v: ~F.map_contains_key(over, k)), over)


def number_at(text: Column, path: str) -> Column:
    """The number at a dotted path; null where there is none."""
    return F.get_json_object(text, f"$.{path}").try_cast("double")


def named(columns: dict[str, Column]) -> Column:
    """A JSON object with these members, in order of name."""
    return F.to_json(F.struct(*(columns[k].alias(k) for k in sorted(columns))), {"ignoreNullFields": "false"})


def weighted_scalar(components: Column, weights: dict[str, float], hidden: str = "_logonly") -> Column:
    """Sum of the finite components (a map) by weight, 1 where there is none; names that end in ``hidden`` stay out."""
    table = F.create_map(*(x for k, w in weights.items() for x in (F.lit(k), F.lit(float(w)))))
    shown = F.map_filter(components, lambda k, v: ~k.endswith(hidden) & v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))
    return F.aggregate(F.map_entries(shown), F.lit(0.0), lambda acc, e: acc + e["value"] * F.coalesce(F.try_element_at(table, e["key"]), F.lit(1.0)))


def accepted(components: Column, name: str, hidden: str = "_logonly") -> Column:
    """Whether a component, or the one logged under its name, is at least 1."""
    return F.coalesce(F.try_element_at(components, F.lit(name)), F.try_element_at(components, F.lit(name + hidden)), F.lit(0.0)) >= 1


def human_bytes(n: Column) -> Column:
    """``1.5000 KB`` and so on by powers of 1024 up to TB; null beyond."""
    power = F.floor(F.log2(F.greatest(n.cast("double"), F.lit(1.0))) / 10)
    units = F.array(*(F.lit(u) for u in ("bytes", "KB", "MB", "GB", "TB")))
    return F.when(power <= 4, F.format_string("%.4f %s", F.bround(n / F.pow(F.lit(1024.0), power), 4), F.get(units, power.cast("int"))))


def days_to_seconds(seconds: Column) -> Column:
    """``2 days, 03:04:05`` of a number of seconds; without days where there are none."""
    part = lambda over, of: (F.floor(seconds / over) % of).cast("int")
    days = F.floor(seconds / 86400).cast("int")
    clock = F.format_string("%02d:%02d:%02d", part(3600, 24), part(60, 60), (seconds % 60).cast("int"))
    return F.when(days > 0, F.concat(days.cast("string"), F.lit(" days, "), clock)).otherwise(clock)
