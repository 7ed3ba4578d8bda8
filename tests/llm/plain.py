"""Plain Python versions of the pipeline's stages, from the definitions, without the operators' code."""

from __future__ import annotations

import collections
import math
import re
import zlib

import numpy as np
import regex
from millrace.llm import quality_classifier, quality_rules

WORD = re.compile("[^\x20\x09-\x0d]+")


def quality_scores(data, labels):
    """One score a row: features, normal equations and calibration in dense numpy."""
    marks = collections.defaultdict(list)
    for i, y, _ in labels:
        if i is not None and y is not None:
            marks[i].append(y)
    vectors = [quality_classifier.text_statistics(None if r[1] is None else r[1].encode()) for r in data]
    fold = lambda i: zlib.crc32(str(i).encode()) % 5
    rows = [(x, float(y), fold(r[0])) for r, x in zip(data, vectors) for y in marks.get(r[0], []) if fold(r[0])]
    x, y, part = np.array([r[0] for r in rows]), np.array([r[1] for r in rows]), np.array([r[2] for r in rows])
    mean, scale = x.mean(0), x.std(0)
    scale[scale == 0] = 1.0
    rng = np.random.default_rng(11)
    weights = rng.normal(0, 1 / 4.0, (quality_classifier.N_STATISTICS, 192))
    phases = rng.uniform(0, 2 * np.pi, 192)
    feature = lambda v: np.hstack([np.cos(np.clip((v - mean) / scale, -6, 6) @ weights + phases) * np.sqrt(2 / 192), np.ones((len(v), 1))])
    z = feature(x[part != 4])
    ridge = np.linalg.solve(z.T @ z + 1e-3 * max(1.0, len(z) / 192) * np.eye(193), z.T @ y[part != 4])
    steps, levels = quality_classifier.isotonic(feature(x[part == 4]) @ ridge, y[part == 4])
    return np.interp(feature(np.array(vectors)) @ ridge, steps, levels)


def base_counts(text):
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words)."""
    words = WORD.findall(text or "")
    seen = collections.Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    hit = {j for i in range(len(words) - 7) if seen[tuple(words[i : i + 8])] > 1 for j in range(i, i + 8)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(hit)


def votes(text):
    """The rules' votes on a text, from its own counts."""
    text = text or ""
    n, chars, symbols, dups, repeats = base_counts(text)
    words = WORD.findall(text)
    lines = sum(bool(WORD.search(x)) for x in text.split("\n"))
    over = lambda a, b: a / b if b else None
    values = {
        "length": float(n), "word_length": over(chars, n), "symbols": over(symbols, n), "marks": over(text.count("!") + text.count("?"), n),
        "duplicate_lines": over(dups, lines), "repeated_words": over(repeats, n), "distinct_words": over(sum(len(set(words[a : a + 200])) for a in range(0, n, 200)), n),
        "plain_words": over(sum(bool(regex.search(r"\p{L}[.,;:]?\Z", w)) for w in words), n), "capitals": over(len(regex.findall(r"\p{Lu}", text)), len(text)),
    }
    inside = lambda v, r: r[0] <= v <= r[1]
    return tuple(0 if (v := values[r.name]) is None else 1 if inside(v, r.good) else 0 if inside(v, r.fair) else -1 for r in quality_rules.RULES)


def posteriors(all_votes):
    """Expectation-maximisation document by document, then each one's posterior probability of being good."""
    k = len(quality_rules.RULES)
    prior, good, bad = 0.85, [0.97] * k, [0.3] * k

    def posterior(v):
        odds = math.log(prior / (1 - prior))
        for x, g, b in zip(v, good, bad):
            odds += math.log(g / (1 - b)) if x > 0 else math.log((1 - g) / b) if x < 0 else 0.0
        return 1 / (1 + math.exp(-odds))

    clip = lambda x, a, b: min(b, max(a, x))
    for _ in range(30):
        p = [posterior(v) for v in all_votes]
        q = [1 - x for x in p]
        rate = lambda i, w, sign, start: (sum(x for v, x in zip(all_votes, w) if sign * v[i] > 0) + start) / (sum(x for v, x in zip(all_votes, w) if v[i]) + 1)
        new = clip(sum(p) / len(p), 0.5, 0.95), [clip(rate(i, p, 1, 0.97), 0.8, 0.995) for i in range(k)], [clip(rate(i, q, -1, 0.3), 0.05, 0.9) for i in range(k)]
        moved = max(abs(a - b) for a, b in zip((new[0], *new[1], *new[2]), (prior, *good, *bad)))
        prior, good, bad = new
        if moved < 1e-3:
            break
    return [posterior(v) for v in all_votes]


def shingles(text):
    words = [w.lower() for w in WORD.findall(text or "")] if (text or "").isascii() else (text or "").encode().lower().split()
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def first_of_groups(data):
    """The (id, text) that stay: the least row, nulls last, of each component of texts with a shingle similarity of 0.8 or more."""
    sets = [shingles(r[1]) for r in data]
    parent = list(range(len(data)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            if 9 * len(a & sets[j]) >= 4 * (len(a) + len(sets[j])):
                x, y = find(i), find(j)
                parent[max(x, y)] = min(x, y)
    best = {}
    for i, r in enumerate(data):
        key = (r[0] is None, r[0] or 0)
        root = find(i)
        if root not in best or key < best[root][0]:
            best[root] = (key, (r[0], r[1]))
    return [row for _, row in best.values()]
