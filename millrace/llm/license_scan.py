"""License scans by canonical digest lookup.

A text is made canonical (lower case, copyright lines left out, equivalent spellings made one, everything but letters and
digits a single space) and the SHA-256 of the whole canonical text is looked up, by a hash join, among the digests of known
licence texts, themselves made canonical by the same columns.  Notices that projects put in a file, one line each, are
looked up line by line in the same way; only lines that mention a licence are digested, as each known notice does.

Null texts count as empty; the canonical empty text has a digest and is no licence.  Long texts are digested whole.  Repeated
rows each have a result.  A digest that stands for several licences gives the first by name.  Only the id and text columns
are read; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import broadcast_if_small, own_columns, stage_table
from .license_texts import LICENSES, NOTICES, SPELLINGS

COPYRIGHT_LINE = r"(?m)^[^\p{L}\p{N}\n]*(?:copyright\b|\(c\)|©)[^\n]*$"
OTHER = r"[^\p{L}\p{N}]+"


def canonical(text: Column) -> Column:
    """The canonical form of a text or line."""
    out = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), COPYRIGHT_LINE, "")
    for variant, usual in SPELLINGS:
        out = F.replace(out, F.lit(variant), F.lit(usual))
    return F.trim(F.regexp_replace(out, OTHER, " "))


#: Notices up to which they are a literal in the plan.
MAP_NOTICES = 2_000


def digest(text: Column) -> Column:
    return F.sha2(canonical(text), 256)


def known(spark: SparkSession, texts: tuple[tuple[str, str], ...]) -> DataFrame:
    """(digest, license) of known texts."""
    rows = spark.createDataFrame(list(texts), "license string, text string")
    return rows.groupBy(digest(F.col("text")).alias("digest")).agg(F.min("license").alias("license"))


def scan(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", licenses: DataFrame | None = None, notices: DataFrame | None = None) -> DataFrame:
    """One row per row of ``docs``: id, digest of the canonical text, license (null if unknown), notices (sorted, distinct
    licences whose notice is a line of the text)."""
    spark = docs.sparkSession
    licenses = known(spark, LICENSES) if licenses is None else licenses
    notices = known(spark, NOTICES) if notices is None else notices
    rows = own_columns(docs, id=id_col, text=text_col)
    lines = F.filter(F.split("text", "\n"), lambda x: F.lower(x).rlike("licen[cs]e"))
    own = stage_table(rows.select("id", digest(F.col("text")).alias("digest"), F.coalesce(F.transform(lines, lambda x: F.sha2(_canonical_line(x), 256)), F.array().cast("array<string>")).alias("lines")), "digests")
    named = own.join(broadcast_if_small(licenses), "digest", "left")
    # a small table of notices is a map literal; a larger one meets the distinct lists of lines in a join
    table = {r["digest"]: r["license"] for r in notices.limit(MAP_NOTICES + 1).collect()}
    if not table:
        found = F.array().cast("array<string>")
    elif len(table) <= MAP_NOTICES:
        names = F.create_map(*(F.lit(x) for pair in sorted(table.items()) for x in pair))
        found = F.array_sort(F.array_distinct(F.filter(F.transform("lines", lambda x: names[x]), lambda x: x.isNotNull())))
    else:
        key = F.sha2(F.concat_ws(",", "lines"), 256)
        each = own.where(F.size("lines") > 0).select(key.alias("__key"), "lines").dropDuplicates(["__key"]).select("__key", F.explode("lines").alias("digest"))
        hits = each.join(notices, "digest").groupBy("__key").agg(F.array_sort(F.collect_set("license")).alias("__found"))
        named = named.withColumn("__own_key", key).join(hits, F.col("__own_key") == F.col("__key"), "left")
        found = F.coalesce("__found", F.array().cast("array<string>"))
    return named.select(F.col("id").alias(id_col), "digest", "license", found.alias("notices"))


def _canonical_line(line: Column) -> Column:
    out = F.lower(line)
    for variant, usual in SPELLINGS:
        out = F.replace(out, F.lit(variant), F.lit(usual))
    return F.trim(F.regexp_replace(out, OTHER, " "))


def canonical_sql(text: str, line: bool = False) -> str:
    """DuckDB SQL for the canonical form."""
    out = f"lower(coalesce({text}, ''))"
    if not line:
        out = f"regexp_replace({out}, '{COPYRIGHT_LINE}', '', 'g')"
    for variant, usual in SPELLINGS:
        out = f"replace({out}, '{variant}', '{usual}')"
    return f"trim(regexp_replace({out}, '{OTHER}', ' ', 'g'))"


def scan_sql() -> str:
    """DuckDB SQL for ``scan`` over the table documents."""
    quote = lambda t: "'" + t.replace("'", "''") + "'"
    values = lambda texts: ", ".join(f"({quote(n)}, {quote(t)})" for n, t in texts)
    return f"""
    WITH l(license, text) AS (VALUES {values(LICENSES)}), n(license, text) AS (VALUES {values(NOTICES)}),
    ld AS (SELECT sha256({canonical_sql('text')}) AS digest, min(license) AS license FROM l GROUP BY 1),
    nd AS (SELECT sha256({canonical_sql('text')}) AS digest, min(license) AS license FROM n GROUP BY 1),
    d AS (SELECT row_number() OVER () AS r, doc_id, sha256({canonical_sql('text')}) AS digest, text FROM documents),
    lines AS (SELECT r, unnest(string_split(text, chr(10))) AS line FROM d),
    hits AS (SELECT r, list_sort(list_distinct(list(nd.license))) AS notices
        FROM (SELECT r, sha256({canonical_sql('line', True)}) AS digest FROM lines WHERE regexp_matches(lower(line), 'licen[cs]e')) x
        JOIN nd USING (digest) GROUP BY r)
    SELECT doc_id, d.digest, ld.license, coalesce(hits.notices, CAST([] AS VARCHAR[])) AS notices
    FROM d LEFT JOIN ld USING (digest) LEFT JOIN hits USING (r)"""
