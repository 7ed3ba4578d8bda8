"""URL filters: host and path rules, and gradient-boosted trees on lexical features for the rest.

Rules name a host and a path prefix; a rule fits its host and all subdomains, and the longest that fits decides.  The trees
(logistic loss, histogram splits, shallow) are trained from labelled URLs: length, depth, digit ratio, entropy, parameter
counts and the like, and for the host's last label and last two labels how many labelled URLs have them and which share
of those is good.  Suffix statistics live in a hashed table with four slots and more for each suffix that the training rows have, so
they grow with the suffixes and are bounded by the rows; a training row's own label is left out of its suffixes' shares.

Training takes at most ``max_fit_rows`` labelled URLs, the first by hash, URL and label, so that reruns agree.  Null labels are no training rows; repeated ones count
as often as they occur.  A null URL, or one without ``://``, has an empty host and path, fits no rule, and is judged by its
features like any other (a null as an empty text).  Without labels of both kinds the method's score is the share of good
ones (1 without any).  Only the named columns are read; each row gets a result.  Empty tables give empty results.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import own_columns

LEAST_SLOTS = 4096
MAX_FIT_ROWS = 100_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
N_FEATURES = 18
PRIOR_ROWS = 20.0


@dataclass(frozen=True)
class UrlRule:
    """``allow`` or ``block`` for ``host/path``, like ``example.org/es/``."""

    verdict: str
    rule: str

    @property
    def host(self) -> str:
        return self.rule.partition("/")[0]

    @property
    def path(self) -> str:
        return "/" + self.rule.partition("/")[2]


def host_of(url: str | Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty without ``://``."""
    url = F.col(url) if isinstance(url, str) else url
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER)


def path_of(url: str | Column) -> Column:
    """What follows the host, up to ``?``, ``#`` or the end."""
    url = F.col(url) if isinstance(url, str) else url
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def fitting_rule(host: Column, path: Column, rules: list[UrlRule]) -> Column:
    """struct(rule, verdict) of the longest rule that fits, or null.  Rules are configuration: one branch each."""
    out = None
    for r in sorted(rules, key=lambda r: (-len(r.rule), r.rule)):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        value = F.struct(F.lit(r.rule).alias("rule"), F.lit(r.verdict).alias("verdict"))
        out = F.when(fits, value) if out is None else out.when(fits, value)
    return F.lit(None).cast("struct<rule:string,verdict:string>") if out is None else out


def _hash(text: str) -> int:
    return xxhash.xxh32_intdigest(text, 5)


def lexical(url: str | None) -> tuple[list[float], int, int]:
    """(features, hash of the host's last label, hash of its last two) of a URL."""
    url = url or ""
    scheme, found, rest = url.partition("://")
    if not found:
        scheme, rest = "", url
    cut = min((i for c in "/?#" if (i := rest.find(c)) >= 0), default=len(rest))
    host, tail = rest[:cut].lower(), rest[cut:]
    path, _, query = tail.partition("#")[0].partition("?")
    n = max(1, len(url))
    digits = sum(c.isdigit() for c in url)
    _, counts = np.unique(np.frombuffer(url.encode("utf-8", "replace"), np.uint8), return_counts=True) if url else (None, np.ones(1))
    shares = counts / counts.sum()
    labels = host.split(".")
    longest = max(labels, key=len)
    params = [p for p in query.split("&") if p]
    features = [
        len(url), len(host), len(path), len(query), path.count("/"), len(labels), digits / n, sum(c.isdigit() for c in host) / max(1, len(host)),
        float(-(shares * np.log2(shares)).sum()), len(params), sum("=" in p for p in params), host.count("-"), len(longest),
        sum(not c.isalnum() for c in url) / n, float(scheme == "https"), float("%" in url), float("#" in url), float("." in path.rpartition("/")[2]),
    ]
    return features, _hash(labels[-1]), _hash(".".join(labels[-2:]))


@dataclass
class Trees:
    """Boosted trees of one depth: split features and cuts level by level (heap order), leaf values."""

    depth: int
    start: float = 0.0
    features: list[np.ndarray] = field(default_factory=list)
    cuts: list[np.ndarray] = field(default_factory=list)
    leaves: list[np.ndarray] = field(default_factory=list)

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.start)
        rows = np.arange(len(x))
        for f, c, leaf in zip(self.features, self.cuts, self.leaves):
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (x[rows, f[node]] > c[node])
            out += leaf[node - (len(f))]
        return out


def boost(x: np.ndarray, y: np.ndarray, *, trees: int = 40, depth: int = 3, rate: float = 0.15, bins: int = 64, penalty: float = 5.0, least_gain: float = 1e-3) -> Trees:
    """Gradient boosting with logistic loss on quantile bins.  Nodes without a split that gains keep their rows on the left."""
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(x.shape[1])]
    binned = np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)], axis=1)
    level = y.mean()
    model = Trees(depth, float(np.log(level / (1 - level))))
    margin = np.full(len(y), model.start)
    n_inner = 2**depth - 1
    rows = np.arange(len(y))
    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        gradient, curve = y - p, np.maximum(p * (1 - p), 1e-9)
        node = np.zeros(len(y), np.int64)
        split, cut = np.zeros(n_inner, np.int64), np.full(n_inner, np.inf)
        split_bin = np.full(n_inner, bins + 1)
        for d in range(depth):
            first, width = 2**d - 1, 2**d
            at = node - first
            best = np.full(width, least_gain)
            g_all, h_all = np.bincount(at, gradient, width), np.bincount(at, curve, width)
            for j, e in enumerate(edges):
                if not len(e):
                    continue
                key = at * (len(e) + 1) + binned[:, j]
                g = np.bincount(key, gradient, width * (len(e) + 1)).reshape(width, -1).cumsum(1)[:, :-1]
                h = np.bincount(key, curve, width * (len(e) + 1)).reshape(width, -1).cumsum(1)[:, :-1]
                gain = g**2 / (h + penalty) + (g_all[:, None] - g) ** 2 / (h_all[:, None] - h + penalty) - (g_all**2 / (h_all + penalty))[:, None]
                top = gain.argmax(1)
                better = gain[np.arange(width), top] > best
                for k in np.flatnonzero(better):
                    best[k], split[first + k], cut[first + k], split_bin[first + k] = gain[k, top[k]], j, e[top[k]], top[k]
            node = 2 * node + 1 + (binned[rows, split[node]] > split_bin[node])
        leaf = node - n_inner
        values = rate * np.bincount(leaf, gradient, 2**depth) / (np.bincount(leaf, curve, 2**depth) + penalty)
        model.features.append(split)
        model.cuts.append(cut)
        model.leaves.append(values)
        margin += values[leaf]
    return model


@dataclass
class UrlModel:
    """seen, good: labelled URLs and good ones by suffix slot; both and the trees are of fixed size."""

    seen: np.ndarray
    good: np.ndarray
    level: float
    trees: Trees | None

    def matrix(self, urls: list[str | None], own: np.ndarray | None = None) -> np.ndarray:
        """Feature rows; own: the rows' labels, left out of their suffixes' shares."""
        parts = [lexical(u) for u in urls]
        out = np.zeros((len(urls), N_FEATURES + 4))
        out[:, :N_FEATURES] = np.array([p[0] for p in parts]).reshape(-1, N_FEATURES)
        for k in (1, 2):
            slots = np.array([p[k] for p in parts], np.int64) % self.seen.shape[1]
            seen, good = self.seen[k - 1][slots], self.good[k - 1][slots]
            if own is not None:
                seen, good = seen - 1, good - own
            out[:, N_FEATURES + 2 * k - 2] = np.log1p(np.maximum(seen, 0))
            out[:, N_FEATURES + 2 * k - 1] = (good + PRIOR_ROWS * self.level) / (seen + PRIOR_ROWS)
        return out

    def scores(self, urls: list[str | None]) -> np.ndarray:
        """Probability of good."""
        if self.trees is None or not urls:
            return np.full(len(urls), self.level)
        return 1 / (1 + np.exp(-self.trees.margin(self.matrix(urls))))

    def column(self, url: str | Column) -> Column:
        model = self

        @F.arrow_udf("double")
        def score(urls: pa.Array) -> pa.Array:
            return pa.array(model.scores(urls.to_pylist()))

        return score(url)


def fit(labelled: DataFrame, *, url_col: str = "url", label_col: str = "label", max_fit_rows: int = MAX_FIT_ROWS, **options) -> UrlModel:
    """A model from labelled URLs (1 good, 0 bad).  The sample, at most ``max_fit_rows`` rows, is boosted on the driver."""
    known = own_columns(labelled, url=url_col, label=label_col).where(F.col("label").isNotNull())
    n = known.count()
    if n > max_fit_rows:
        known = known.where(F.pmod(F.xxhash64("url", F.lit(3)), F.lit(1_000_000)) < int(1e6 * max_fit_rows / n))
    # fixed rows in a fixed order, so that sums, and with them splits, are the same in each run
    known = known.select("url", F.col("label").cast("double").alias("label"))
    table = known.orderBy(F.xxhash64("url", F.lit(3)), "url", "label").limit(max_fit_rows).toArrow().sort_by([("url", "ascending"), ("label", "ascending")])
    urls, y = table.column("url").to_pylist(), table.column("label").to_numpy()
    if not len(y) or y.min() == y.max():
        return UrlModel(np.zeros((2, 1)), np.zeros((2, 1)), float(y.mean()) if len(y) else 1.0, None)
    parts = [lexical(u) for u in urls]
    hashes = [np.array([p[k] for p in parts], np.int64) for k in (1, 2)]
    size = max(LEAST_SLOTS, 1 << (4 * max(len(np.unique(h)) for h in hashes)).bit_length())
    slots = [h % size for h in hashes]
    model = UrlModel(np.array([np.bincount(s, minlength=size) for s in slots], float), np.array([np.bincount(s, y, size) for s in slots]), float(y.mean()), None)
    model.trees = boost(model.matrix(urls, y), y, **options)
    return model


def judge(pages: DataFrame, rules: list[UrlRule], model: UrlModel, *, id_col: str = "page_id", url_col: str = "url", allow_at: float = 0.5) -> DataFrame:
    """One row per row of ``pages``: id, host, path, rule (null where none fits), verdict, score."""
    out = own_columns(pages, id=id_col, url=url_col).withColumns({"host": host_of("url"), "path": path_of("url"), "score": model.column("url")})
    out = out.withColumn("fit", fitting_rule(F.col("host"), F.col("path"), rules))
    by_method = F.when(F.col("score") >= allow_at, "allow").otherwise("block")
    return out.select(F.col("id").alias(id_col), "host", "path", F.col("fit.rule").alias("rule"), F.coalesce("fit.verdict", by_method).alias("verdict"), "score")
