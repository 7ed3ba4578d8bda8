"""Quality rules by weak supervision, DataFrame functions only.

Every rule votes 1 (good), -1 (bad) or 0 (abstains) on a document.  Votes are counted by pattern over all documents
(at most 3^rules rows, whatever the input), expectation-maximisation estimates each rule's accuracy and the share of
good documents from those counts, and a document is kept if its posterior probability of being good is high enough.

Texts: null counts as empty; an empty text has no words, so its base check fails.  Very long texts are measured whole.
Equal rows each get a result; an empty table gives an empty result.  Only the id and text columns are read, so other
columns may have any name.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import own_columns, stage_table

WINDOW = 8
STRETCH = 200
SPACE = "[\\x20\\x09-\\x0D]+"
#: The end of a word whose last character, or last but one before a stop, is a letter.
PLAIN = "\\p{L}[.,;:]?(?=[\\x20\\x09-\\x0D]|\\z)"
SYMBOLS = "#*$%&|<>"
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
MORE = ("n_lines", "n_distinct_words", "n_upper", "n_chars", "n_marks", "n_plain")


@dataclass(frozen=True)
class Rule:
    """Votes good where ``value`` lies in ``good``, bad where it lies outside ``fair``; abstains between."""

    name: str
    value: str  # SQL over the statistics
    good: tuple[float, float]
    fair: tuple[float, float]

    def vote(self) -> Column:
        value = F.expr(self.value)
        return (
            F.when(value.between(*self.good), F.lit(1))
            .when(value.between(*self.fair), F.lit(0))
            .otherwise(F.when(value.isNull(), F.lit(0)).otherwise(F.lit(-1)))
            .cast("tinyint")
        )


INF = float("inf")
RULES = (
    Rule("length", "double(n_words)", (40, INF), (15, INF)),
    Rule("word_length", "word_chars / nullif(n_words, 0)", (3.0, 9.0), (2.0, 14.0)),
    Rule("symbols", "n_symbols / nullif(n_words, 0)", (0, 0.02), (0, 0.2)),
    Rule("marks", "n_marks / nullif(n_words, 0)", (0, 0.03), (0, 0.3)),
    Rule("duplicate_lines", "n_dup_lines / nullif(n_lines, 0)", (0, 0.02), (0, 0.3)),
    Rule("repeated_words", "n_repeat_words / nullif(n_words, 0)", (0, 0.01), (0, 0.3)),
    Rule("distinct_words", "n_distinct_words / nullif(n_words, 0)", (0.45, INF), (0.25, INF)),
    Rule("plain_words", "n_plain / nullif(n_words, 0)", (0.85, INF), (0.7, INF)),
    Rule("capitals", "n_upper / nullif(n_chars, 0)", (0, 0.08), (0, 0.3)),
)


def statistics(df: DataFrame, text: str = "text") -> DataFrame:
    """``df`` and the counts of each whole text (longs): BASE and MORE.

    n_words: words ``[^\\x20\\x09-\\x0D]+``; word_chars: code points in words; n_symbols: characters of ``#*$%&|<>``;
    n_dup_lines: lines (split at \\n) with a word that equal an earlier line; n_repeat_words: words inside 8-word
    windows that occur twice or more in the text; n_lines: lines with a word; n_distinct_words: distinct words of each stretch of
    200 words, added up over the text; n_marks: ``!`` and ``?``; n_plain: words that end in a letter, or a letter and a stop.
    Windows are compared by 64-bit hashes of their words' 64-bit hashes.
    """
    own = {name: f"__{name}" for name in ("text", "words", "hashes", "lines", "windows", "spots")}
    out = df.withColumn(own["text"], F.coalesce(F.col(f"`{text}`"), F.lit("")))
    out = out.withColumn(own["words"], F.array_remove(F.split(own["text"], SPACE), ""))
    out = out.withColumn(own["lines"], F.split(own["text"], "\n"))
    out = out.withColumn(own["hashes"], F.transform(own["words"], lambda w: F.xxhash64(w)))
    out = out.withColumn(own["lines"], F.filter(own["lines"], lambda x: x.rlike("[^\\x20\\x09-\\x0D]")))
    n = F.size(own["words"])
    out = out.withColumn(
        own["windows"],
        F.when(
            n > WINDOW,
            F.expr(
                f"transform(sequence(1, size({own['hashes']}) - {WINDOW - 1}), i -> xxhash64("
                + ", ".join(f"{own['hashes']}[i + {k - 1}]" for k in range(WINDOW))
                + "))"
            ),
        ).otherwise(F.array().cast("array<bigint>")),
    )
    # Starts, in order, of windows found twice or more.  Texts without any, nearly all, stop at the first test.
    out = out.withColumn(
        own["spots"],
        F.when(F.size(F.array_distinct(own["windows"])) == F.size(own["windows"]), F.array().cast("array<int>")).otherwise(
            F.expr(f"""
            transform(array(array_sort(transform({own['windows']}, (h, i) -> named_struct('h', h, 'i', i)))), s ->
                array_sort(transform(
                    filter(s, (e, k) -> (k > 0 and s[k - 1].h = e.h) or (k < size(s) - 1 and s[k + 1].h = e.h)),
                    e -> e.i)))[0]
            """)
        ),
    )
    long = lambda c: c.cast("long")
    symbols = F.col(own["text"])
    for c in SYMBOLS:
        symbols = F.replace(symbols, F.lit(c), F.lit(""))
    marks = F.replace(F.replace(F.col(own["text"]), F.lit("!"), F.lit("")), F.lit("?"), F.lit(""))
    counts = (
        {
            "n_words": long(n),
            "word_chars": long(F.char_length(F.concat_ws("", own["words"]))),
            "n_symbols": long(F.char_length(own["text"]) - F.char_length(symbols)),
            "n_dup_lines": long(F.size(own["lines"]) - F.size(F.array_distinct(own["lines"]))),
            "n_repeat_words": F.when(F.size(own["spots"]) == 0, F.lit(0)).otherwise(
                F.expr(f"""
                aggregate(transform({own['spots']}, (p, k) -> if(k = size({own['spots']}) - 1, {WINDOW},
                    least({WINDOW}, {own['spots']}[k + 1] - p))), 0, (a, x) -> a + x)""")
            ).cast("long"),
            "n_lines": long(F.size(own["lines"])),
            "n_distinct_words": F.expr(f"""
                aggregate(sequence(0, (size({own['hashes']}) - 1) div {STRETCH}), 0, (a, i) ->
                    a + size(array_distinct(slice({own['hashes']}, int(i) * {STRETCH} + 1, {STRETCH}))))""").cast("long"),
            "n_upper": long(F.regexp_count(own["text"], F.lit("\\p{Lu}"))),
            "n_chars": long(F.char_length(own["text"])),
            "n_marks": long(F.char_length(own["text"]) - F.char_length(marks)),
            "n_plain": long(F.regexp_count(own["text"], F.lit(PLAIN))),
        }
    )
    # A generator between the counts and what is made of them: a filter on verdicts is not pushed into the counting, where it
    # would repeat it for each rule.
    return out.select(*(F.col(f"`{c}`") for c in df.columns), F.inline(F.array(F.struct(*(c.alias(name) for name, c in counts.items())))))


def base_failed() -> Column:
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


@dataclass(frozen=True)
class LabelModel:
    """prior: share of good documents; on_good, on_bad: each rule's accuracy where it votes on a good or bad document."""

    prior: float
    on_good: tuple[float, ...]
    on_bad: tuple[float, ...]
    iterations: int = 0

    def posterior(self, votes: list[Column]) -> Column:
        """Probability of good, from the votes' log likelihood ratios, summed in a fixed order."""
        odds = F.lit(math.log(self.prior / (1 - self.prior)))
        for vote, g, b in zip(votes, self.on_good, self.on_bad, strict=True):
            up, down = math.log(g / (1 - b)), math.log((1 - g) / b)
            odds = odds + F.when(vote > 0, F.lit(up)).when(vote < 0, F.lit(down)).otherwise(F.lit(0.0))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-odds))


def fit(patterns: DataFrame, rules: tuple[Rule, ...] = RULES, iterations: int = 30, tolerance: float = 1e-3) -> LabelModel:
    """EM over vote patterns (columns of the rules' names and n, the documents with that pattern).

    One aggregate over at most 3^rules rows makes each iteration.  Bounds name the classes: most documents are good,
    rules seldom blame a good one (accuracy 0.8 to 0.995), and each catches only some bad ones (0.05 to 0.95).
    """
    model = LabelModel(0.85, (0.97,) * len(rules), (0.3,) * len(rules))
    votes = [F.col(r.name) for r in rules]
    clip = lambda x, low, high: min(high, max(low, x))
    for k in range(iterations):
        p, n = F.col("__p"), F.col("n")
        share = {"good": p, "bad": 1 - p}
        sums = (
            patterns.withColumn("__p", model.posterior(votes))
            .agg(
                F.sum(n).alias("n"),
                F.sum(n * p).alias("good"),
                *(
                    F.sum(F.when(v > 0 if side == "good" else v < 0, n * w)).alias(f"{side}_right_{i}")
                    for side, w in share.items()
                    for i, v in enumerate(votes)
                ),
                *(F.sum(F.when(v != 0, n * w)).alias(f"{side}_cast_{i}") for side, w in share.items() for i, v in enumerate(votes)),
            )
            .first()
        )
        if not sums["n"]:
            return model
        # One expected vote is added to each count, so that rules that never vote keep an accuracy.
        rate = lambda side, i, start: ((sums[f"{side}_right_{i}"] or 0.0) + start) / ((sums[f"{side}_cast_{i}"] or 0.0) + 1.0)
        new = LabelModel(
            clip(sums["good"] / sums["n"], 0.5, 0.95),
            tuple(clip(rate("good", i, 0.97), 0.8, 0.995) for i in range(len(rules))),
            tuple(clip(rate("bad", i, 0.3), 0.05, 0.9) for i in range(len(rules))),
            k + 1,
        )
        moved = max(abs(x - y) for x, y in zip((new.prior, *new.on_good, *new.on_bad), (model.prior, *model.on_good, *model.on_bad), strict=True))
        model = new
        if moved < tolerance:
            break
    return model


def judge(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    rules: tuple[Rule, ...] = RULES,
    keep_at: float = 0.5,
) -> DataFrame:
    """One row per row of ``docs``: id, BASE and MORE counts, base_failed, the rules' votes, posterior, kept.

    The counts, a hundred bytes a document, are written once to the shared folder; the label model and the verdicts
    both come from there, so texts are measured once.
    """
    counts = stage_table(
        statistics(own_columns(docs, **{id_col: id_col, "__judged": text_col}), "__judged").drop("__judged"), "rule_counts"
    )
    voted = counts.withColumns({r.name: r.vote() for r in rules})
    patterns = stage_table(voted.groupBy(*(r.name for r in rules)).agg(F.count(F.lit(1)).alias("n")).coalesce(1), "patterns")
    model = fit(patterns, rules)
    return (
        voted.withColumn("base_failed", base_failed())
        .withColumn("posterior", model.posterior([F.col(r.name) for r in rules]))
        .withColumn("kept", ~F.col("base_failed") & (F.col("posterior") >= keep_at))
    )


def keep_good(docs: DataFrame, *, text_col: str = "text", rules: tuple[Rule, ...] = RULES, keep_at: float = 0.5) -> DataFrame:
    """The rows of ``docs``, with their columns, that ``judge`` keeps.

    Texts are measured once: the rows go to the shared folder with their votes, the label model reads the votes alone, and the
    verdict is a filter on reading.
    """
    own = {r.name: f"__vote_{i}" for i, r in enumerate(rules)}
    columns = docs.columns
    hidden = {c: f"__doc_{i}" for i, c in enumerate(columns)}
    measured = statistics(docs.toDF(*hidden.values()), hidden[text_col])
    voted = measured.select(*hidden.values(), *(r.vote().alias(own[r.name]) for r in rules), base_failed().alias("__failed"))
    voted = stage_table(voted, "voted")
    patterns = voted.groupBy(*(F.col(own[r.name]).alias(r.name) for r in rules)).agg(F.count(F.lit(1)).alias("n"))
    model = fit(stage_table(patterns.coalesce(1), "patterns"), rules)
    kept = voted.where(~F.col("__failed") & (model.posterior([F.col(v) for v in own.values()]) >= keep_at))
    return kept.select(*(F.col(hidden[c]).alias(c) for c in columns))


def judge_sql(rules: tuple[Rule, ...] = RULES, keep_at: float = 0.5, iterations: int = 30, tolerance: float = 1e-3) -> str:
    """DuckDB SQL for ``judge`` over the table documents: counts, votes, expectation-maximisation by recursion, posterior."""
    space, number = "[\\x20\\x09-\\x0D]+", range(len(rules))
    lead = " || ' ' || ".join(f"lead(w, {k}) OVER z" for k in range(1, WINDOW))
    bound = lambda x: "'Infinity'::DOUBLE" if x == INF else repr(float(x))
    between = lambda r, span: f"({r.value}) BETWEEN {bound(span[0])} AND {bound(span[1])}"
    vote = lambda r: f"CASE WHEN {between(r, r.good)} THEN 1 WHEN {between(r, r.fair)} THEN 0 WHEN ({r.value}) IS NULL THEN 0 ELSE -1 END"
    votes = ", ".join(f"{vote(r)} AS v{i}" for i, r in enumerate(rules)).replace("double(n_words)", "n_words::DOUBLE")
    posterior = "1 / (1 + exp(-(ln(prior / (1 - prior))" + "".join(
        f" + CASE WHEN v{i} > 0 THEN ln(g[{i + 1}] / (1 - b[{i + 1}])) WHEN v{i} < 0 THEN ln((1 - g[{i + 1}]) / b[{i + 1}]) ELSE 0 END" for i in number
    ) + ")))"
    rate = lambda i, sign, weight, start: f"(coalesce(sum(CASE WHEN v{i} {sign} 0 THEN n * {weight} END), 0) + {start}) / (coalesce(sum(CASE WHEN v{i} <> 0 THEN n * {weight} END), 0) + 1)"
    goods = ", ".join(f"least(0.995, greatest(0.8, {rate(i, '>', 'p', 0.97)}))" for i in number)
    bads = ", ".join(f"least(0.9, greatest(0.05, {rate(i, '<', '(1 - p)', 0.3)}))" for i in number)
    start = "[" + ", ".join(["0.97::DOUBLE"] * len(rules)) + "]", "[" + ", ".join(["0.3::DOUBLE"] * len(rules)) + "]"
    keys = ", ".join(f"v{i}" for i in number)
    return f"""
    WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
    s AS (SELECT r, doc_id, t, list_filter(string_split_regex(t, '{space}'), lambda x: x <> '') AS w, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS l FROM d),
    tokens AS (SELECT r, unnest(w) AS w, generate_subscripts(w, 1) AS i FROM s),
    windows AS (SELECT r, i, w || ' ' || {lead} AS win FROM tokens WINDOW z AS (PARTITION BY r ORDER BY i)),
    seen AS (SELECT r, i, count(*) OVER (PARTITION BY r, win) AS k FROM windows WHERE win IS NOT NULL),
    repeats AS (SELECT r, count(DISTINCT p) AS k FROM (SELECT r, unnest(generate_series(i, i + {WINDOW - 1})) AS p FROM seen WHERE k > 1) GROUP BY r),
    stretches AS (SELECT r, sum(k) AS k FROM (SELECT r, (i - 1) // {STRETCH} AS part, count(DISTINCT w) AS k FROM tokens GROUP BY ALL) GROUP BY r),
    counts AS (SELECT s.r, doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars, CAST(len(regexp_extract_all(t, '[#*$%&|<>]')) AS BIGINT) AS n_symbols,
        CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, CAST(coalesce(repeats.k, 0) AS BIGINT) AS n_repeat_words, len(l) AS n_lines, coalesce(stretches.k, 0) AS n_distinct_words,
        len(regexp_extract_all(t, '\\p{{Lu}}')) AS n_upper, length(t) AS n_chars, len(regexp_extract_all(t, '[!?]')) AS n_marks, len(list_filter(w, lambda x: regexp_matches(x, '\\p{{L}}[.,;:]?$'))) AS n_plain
        FROM s LEFT JOIN repeats USING (r) LEFT JOIN stretches USING (r)),
    voted AS (SELECT *, {votes} FROM counts), patterns AS (SELECT {keys}, count(*) AS n FROM voted GROUP BY ALL),
    em AS (SELECT 0 AS step, 0.85::DOUBLE AS prior, {start[0]} AS g, {start[1]} AS b, 1.0::DOUBLE AS moved
        UNION ALL SELECT step + 1, prior_, g_, b_, greatest(abs(prior_ - prior), list_max(list_transform(list_zip(g_, g), lambda x: abs(x[1] - x[2]))), list_max(list_transform(list_zip(b_, b), lambda x: abs(x[1] - x[2])))) FROM (
            SELECT step, prior, g, b, least(0.95, greatest(0.5, sum(n * p) / sum(n))) AS prior_, [{goods}] AS g_, [{bads}] AS b_ FROM (SELECT em.step, em.prior, em.g, em.b, n, {keys}, {posterior} AS p FROM em, patterns WHERE em.step < {iterations} AND em.moved >= {tolerance}) GROUP BY step, prior, g, b)),
    model AS (SELECT * FROM em ORDER BY step DESC LIMIT 1),
    judged AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed, {posterior} AS posterior FROM voted, model)
    SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND posterior >= {keep_at} AS kept, round(posterior, 6) AS posterior FROM judged"""
