"""URL filtering by rules, and by gradient-boosted trees where no rule speaks.

Every URL is taken apart with SQL functions only. Rules name a host, which stands for all its
subdomains too, and the beginning of a path; of the rules that fit, the longest wins. URLs that
a rule judges are the labelled ones. From a bounded sample of them (SAMPLE_ROWS, a parameter)
boosted trees are fitted on the driver over quantile bins of lexical features: lengths, path
depth, digit ratio, character entropy, numbers of parameters, host labels and hyphens, and two
statistics of the host's suffix. Suffix statistics (share blocked among the other labelled rows,
number of URLs) are counted over all rows, in SUFFIX_BUCKETS hash buckets, so their table has a
fixed bound and can be broadcast; suffixes that share a bucket share its statistics. The fitted
trees become CASE expressions: scoring is one projection inside whole-stage code, without Python,
and no URL is ever shuffled. Of rules of one length that fit, the last one given wins.

Defined cases: a null URL, or one without '://', has an empty host and path; an empty host has
an empty suffix; an empty URL has zero features; without labels of both kinds the verdict of
all others is allow. Rows may repeat.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .labels import least

SAMPLE_ROWS = 20_000
SUFFIX_BUCKETS = 1024
TREES, DEPTH, RATE, BINS, LEAST = 40, 3, 0.3, 32, 10
#: (verdict, host, beginning of the path)
RULES = (("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/"))
FEATURES = ("f_length", "f_host", "f_path", "f_depth", "f_digits", "f_entropy", "f_params", "f_labels", "f_hyphens", "f_suffix_block", "f_suffix_count")
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: str | Column) -> Column:
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"://([^/?#]*)", 1), _UPPER, _LOWER)


def path_of(url: str | Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"://[^/?#]*(/[^?#]*)?", 1)


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The winning rule as a string and its verdict; null without one."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for v, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):  # longer ones override
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        name, verdict = F.when(fits, F.lit(h + p)).otherwise(name), F.when(fits, F.lit(v)).otherwise(verdict)
    return name, verdict


def lexical(df: DataFrame, url: str) -> DataFrame:
    """Adds the lexical features and the suffix bucket; expects host and path columns."""
    u = F.coalesce(F.col(url), F.lit(""))
    n = F.length(u).cast("double")
    some = F.greatest(n, F.lit(1.0))
    query = F.regexp_extract(u, r"\?([^#]*)", 1)
    count = lambda text, what: (F.length(text) - F.length(F.replace(text, F.lit(what), F.lit("")))).cast("double")
    chars = F.array_distinct(F.split(u, ""))
    times = lambda c: F.when(c == "", F.lit(0.0)).otherwise(n - F.length(F.replace(u, c, F.lit(""))))
    # H = log2 n - sum(c log2 c) / n over the distinct characters.
    weighed = F.aggregate(F.transform(chars, times), F.lit(0.0), lambda acc, c: acc + F.when(c > 0, c * F.log2(c)).otherwise(0.0))
    return df.withColumns({
        "f_length": n,
        "f_host": F.length("host").cast("double"),
        "f_path": F.length("path").cast("double"),
        "f_depth": count(F.col("path"), "/"),
        "f_digits": (n - F.length(F.regexp_replace(u, "[0-9]", ""))) / some,
        "f_entropy": F.log2(some) - weighed / some,
        "f_params": F.when(query == "", F.lit(0.0)).otherwise(count(query, "&") + 1),
        "f_labels": count(F.col("host"), ".") + 1,
        "f_hyphens": count(F.col("host"), "-"),
        "suffix_bucket": F.pmod(F.xxhash64(F.regexp_extract("host", r"([^.]*)$", 1)), F.lit(SUFFIX_BUCKETS)),
    })


class Boosted:
    """Logistic gradient boosting with depth-limited trees over quantile bins."""

    def __init__(self, x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH, rate: float = RATE):
        self.cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) for j in range(x.shape[1])]
        binned = np.stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(self.cuts)], axis=1)
        share = np.clip(y.mean(), 1e-3, 1 - 1e-3)
        self.base = float(np.log(share / (1 - share)))
        self.trees = []
        total = np.full(len(y), self.base)
        for _ in range(trees):
            p = 1 / (1 + np.exp(-total))
            step = np.zeros(len(y))
            self.trees.append(self._grow(binned, y - p, p * (1 - p), np.arange(len(y)), depth, rate, step))
            total += step

    def _grow(self, binned, gradient, weight, rows, depth, rate, step):
        g, h = gradient[rows].sum(), weight[rows].sum()
        best = (1e-6, None, None)
        if depth and len(rows) >= 2 * LEAST:
            for j, cuts in enumerate(self.cuts):
                code, size = binned[rows, j], len(cuts) + 1
                gs, hs = np.cumsum(np.bincount(code, gradient[rows], size))[:-1], np.cumsum(np.bincount(code, weight[rows], size))[:-1]
                ns = np.cumsum(np.bincount(code, minlength=size))[:-1]
                gain = gs**2 / (hs + 1) + (g - gs) ** 2 / (h - hs + 1) - g * g / (h + 1)
                gain[(ns < LEAST) | (len(rows) - ns < LEAST)] = 0
                if len(gain) and gain.max() > best[0]:
                    best = (float(gain.max()), j, int(gain.argmax()))
        if best[1] is None:
            value = float(rate * g / (h + 1))
            step[rows] = value
            return value
        _, j, k = best
        left = binned[rows, j] <= k
        return (j, float(self.cuts[j][k]), *(self._grow(binned, gradient, weight, rows[m], depth - 1, rate, step) for m in (left, ~left)))

    def sql(self, names=FEATURES) -> str:
        """The probability as an SQL expression over feature columns."""

        def tree(node) -> str:
            if isinstance(node, float):
                return f"{node!r}D"
            j, cut, low, high = node
            return f"CASE WHEN {names[j]} <= {cut!r}D THEN {tree(low)} ELSE {tree(high)} END"

        return f"1D / (1D + exp(-({self.base!r}D + {' + '.join(map(tree, self.trees))})))"


def judge(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", rules=RULES, rows: int = SAMPLE_ROWS) -> DataFrame:
    """page_id, host, path, rule, verdict and block_score of every row."""
    host, path = host_of(F.col(url_col)), path_of(F.col(url_col))
    read = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), host.alias("host"), path.alias("path"))
    name, verdict = rule_of(F.col("host"), F.col("path"), rules)
    base = lexical(read.withColumns({"rule": name, "ruled": verdict}), "url")
    base = base.withColumns({"known": F.col("ruled").isNotNull().cast("double"), "blocked": F.col("ruled").eqNullSafe("block").cast("double")})
    suffix = base.groupBy("suffix_bucket").agg(  # at most SUFFIX_BUCKETS rows
        F.sum("blocked").alias("all_blocked"), F.sum("known").alias("all_known"), F.log1p(F.count("*")).alias("f_suffix_count"),
    )
    # A labelled row doesn't see its own label.
    others = (F.col("all_blocked") - F.col("blocked") + 1) / (F.col("all_known") - F.col("known") + 2)
    full = base.join(F.broadcast(suffix), "suffix_bucket", "left").withColumn("f_suffix_block", others)
    labelled = full.where("ruled is not null").withColumn("y", (F.col("ruled") == "block").cast("int"))
    sample = least(labelled, rows, "url", "page_id").select("y", *FEATURES).collect()
    y = np.array([r.y for r in sample], dtype=float)
    if len(set(y.tolist())) == 2:
        score = F.expr(Boosted(np.array([[r[f] for f in FEATURES] for r in sample], dtype=float), y).sql())
    else:
        score = F.lit(0.0)
    return full.withColumn("block_score", score).select(
        "page_id", "host", "path", "rule", F.coalesce("ruled", F.when(F.col("block_score") >= 0.5, F.lit("block")).otherwise(F.lit("allow"))).alias("verdict"), "block_score",
    )
