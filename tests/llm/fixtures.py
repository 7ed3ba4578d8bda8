"""A small table of documents with every odd case: nulls, empty and long texts, ties, repeated rows, clashing columns."""

from __future__ import annotations

import random

#: Extra columns named like those that operators use inside.
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id string, score double, size long, words string"


def sentence(rng: random.Random, n: int) -> str:
    words = ["the", "quick", "river", "stone", "over", "lazy", "house", "green", "with", "sand", "bridge", "long", "field", "cloud", "north", "paper"]
    return " ".join(rng.choice(words) + rng.choice(["", "", "", "a", "er", "s"]) for _ in range(n)).capitalize() + "."


def rows(n: int = 60, seed: int = 1) -> list[tuple]:
    rng = random.Random(seed)
    texts: list[str | None] = [sentence(rng, rng.randrange(5, 120)) for _ in range(n)]
    texts[0], texts[1], texts[2], texts[3] = None, "", " \n\t ", "one"
    texts[4] = "two words"
    texts[5] = sentence(rng, 30_000)  # long
    texts[6] = texts[7] = texts[8]  # copies
    texts[9] = "Ünï\x85cödé nbsp 漢字 😀 \U0001f600 # * $"
    texts[10] = "loop again and again one more time now " * 12
    out = [(i, t, "en", None if i == 11 else f"src{i % 3}", None, "x", 0.5, 7, "w") for i, t in enumerate(texts)]
    out[12] = (None, *out[12][1:])
    return [*out, out[13], out[13]]  # repeated rows


def frame(spark, data: list[tuple] | None = None):
    return spark.createDataFrame(rows() if data is None else data, SCHEMA)


def labels(spark, data: list[tuple] | None = None):
    data = rows() if data is None else data
    known = [(r[0], 0 if r[1] and "again" in r[1] or (r[0] or 0) % 7 == 3 else 1, 0) for r in data if r[0] is not None]
    return spark.createDataFrame([*known, (5000, None, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
