"""URL filter: longest-rule lookup, and gradient-boosted trees over lexical features.

Rules name a host and a path prefix; a rule fits its host and all subdomains,
and the longest one that fits decides.  URLs that a rule decides are the
labelled rows; the trees learn from them and decide the rest.  The labelled
sample is the LABELLED distinct URLs with the smallest hashes, weighted by how
often they occur; counts of labels by host suffix come from all labelled rows,
in a table of SUFFIXES hashed entries by FOLDS folds of hosts.

A labelled row's suffix rate comes from the hosts of the other folds, so no row
tells its own label.  One labelled url in HIDE is shown with the overall rate, as
a url of an unlabelled suffix is: the trees learn to judge such urls by their
other features and the share of blocked ones.

Features: lengths of url, host and path, path depth, host labels, digit ratio,
hyphens, byte entropy, query parameters, percent signs, fragment, and the
suffix's smoothed block rate.

Null urls or urls without ``://``: empty host and path; the trees decide them
too.  Repeated urls get equal results.  Without labelled urls everything is
allowed.  Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stacksmith.llm import text as T
from stacksmith.llm.shared import LOWERED, UPPER, hashed_sample

# The rules.
RULES = (("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"),
         ("block", "net", "/es/"), ("block", "net", "/fr/"))
LABELLED = 20_000
SUFFIXES = 4096
FOLDS, HIDE = 5, 5
TREES, DEPTH, RATE, BINS, L2 = 40, 4, 0.2, 64, 1.0


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    host = F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), UPPER, LOWERED)
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1), F.lit(""))


def matching_rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule as text, its verdict) of the longest rule that fits; null if none does."""
    name = verdict = F.lit(None).cast("string")
    for kind, h, p in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[1] + r[2])):  # the longest is tried first
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        name, verdict = F.when(fits, h + p).otherwise(name), F.when(fits, kind).otherwise(verdict)
    return name, verdict


def features(url: pa.Array, host: pa.Array, path: pa.Array, suffix_rate: np.ndarray) -> np.ndarray:
    """One row of features a url, from the bytes of the whole url."""
    out = []
    hosts, paths = T.binary(host), T.binary(path)
    length_of = lambda a: np.diff(np.frombuffer(a.buffers()[1], np.int64)[a.offset:a.offset + len(a) + 1])
    host_len, path_len = length_of(hosts), length_of(paths)
    for lo, hi, buf, offs in T.slices(url, 1 << 19):
        m, size = hi - lo, np.diff(offs)
        row = np.repeat(np.arange(m), size)
        count = lambda mask: np.bincount(row[mask], minlength=m)  # noqa: B023, E731
        share = np.zeros(m)
        cells, n = np.unique(row * 256 + buf, return_counts=True)
        p = n / np.maximum(1, size)[cells // 256]
        np.subtract.at(share, cells // 256, p * np.log2(p))
        digits = count((buf >= 48) & (buf <= 57))
        out.append(np.column_stack([
            size, host_len[lo:hi], path_len[lo:hi], count(buf == 47), count(buf == 46), digits / np.maximum(1, size), count(buf == 45),
            share, count((buf == 61) | (buf == 38)), count(buf == 37), count(buf == 35) > 0, suffix_rate[lo:hi]]).astype(np.float64))
    return np.concatenate(out) if out else np.empty((0, 12))


class Trees:
    """Boosted trees of fixed depth on binned features, logistic loss; nodes of a tree are numbered as in a heap."""

    def __init__(self, x: np.ndarray, y: np.ndarray, w: np.ndarray) -> None:
        share = float((w * y).sum() / max(w.sum(), 1e-9))
        self.start = float(np.log((share + 1e-6) / (1 - share + 1e-6)))
        self.cuts = [np.unique(np.quantile(col, np.linspace(0, 1, BINS + 1)[1:-1])) for col in x.T] if len(x) else []
        self.trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        if not len(x) or share in (0.0, 1.0):
            return
        bins, raw = self._bins(x), np.full(len(x), self.start)
        for _ in range(TREES):
            p = 1 / (1 + np.exp(-raw))
            tree = self._grow(bins, w * (p - y), w * p * (1 - p))
            self.trees.append(tree)
            raw += self._leaf(tree, bins)

    def _bins(self, x: np.ndarray) -> np.ndarray:
        return np.column_stack([np.searchsorted(c, col, "left") for c, col in zip(self.cuts, x.T)]).astype(np.int64)

    @staticmethod
    def _grow(bins: np.ndarray, g: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        inner = 2 ** DEPTH - 1
        feature, cut, value = np.zeros(inner, np.int64), np.full(inner, BINS), np.zeros(2 ** DEPTH)
        node = np.zeros(len(g), np.int64)
        for level in range(DEPTH):
            first, width = 2 ** level - 1, 2 ** level
            best = np.full(width, 1e-6)
            for f in range(bins.shape[1]):
                cell = (node - first) * BINS + bins[:, f]
                gs, hs = (np.bincount(cell, v, minlength=width * BINS).reshape(width, BINS).cumsum(axis=1) for v in (g, h))
                gt, ht = gs[:, -1:], hs[:, -1:]
                gain = gs ** 2 / (hs + L2) + (gt - gs) ** 2 / (ht - hs + L2) - gt ** 2 / (ht + L2)
                at = gain.argmax(axis=1)
                top = gain[np.arange(width), at]
                better = top > best
                best[better] = top[better]
                feature[first:first + width][better], cut[first:first + width][better] = f, at[better]
            node = 2 * node + 1 + (bins[np.arange(len(g)), feature[node]] > cut[node])
        leaf = node - inner
        value = -RATE * np.bincount(leaf, g, minlength=2 ** DEPTH) / (np.bincount(leaf, h, minlength=2 ** DEPTH) + L2)
        return feature, cut, value

    @staticmethod
    def _leaf(tree: tuple[np.ndarray, np.ndarray, np.ndarray], bins: np.ndarray) -> np.ndarray:
        feature, cut, value = tree
        node = np.zeros(len(bins), np.int64)
        for _ in range(DEPTH):
            node = 2 * node + 1 + (bins[np.arange(len(bins)), feature[node]] > cut[node])
        return value[node - len(feature)]

    def __call__(self, x: np.ndarray) -> np.ndarray:
        raw = np.full(len(x), self.start)
        if self.trees and len(x):
            bins = self._bins(x)
            for tree in self.trees:
                raw += self._leaf(tree, bins)
        return 1 / (1 + np.exp(-raw))


def _judge(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees, rates = model.value
        for batch in batches:
            x = features(batch.column("url"), batch.column("host"), batch.column("path"),
                         rates[batch.column("suffix").to_numpy(zero_copy_only=False)])
            keep = [batch.column(n) for n in ("page_id", "url", "host", "path", "rule", "label")]
            yield pa.record_batch([*keep, pa.array(trees(x))], names=["page_id", "url", "host", "path", "rule", "label", "score"])
    return run


def suffix_rates(counts: np.ndarray, overall: float) -> np.ndarray:
    """Share of blocked rows by suffix, drawn towards the overall share; ``counts`` (suffix, (rows, blocked rows))."""
    return (counts[..., 1] + 10 * overall) / (counts[..., 0] + 10)


def fit_trees(known: DataFrame, labelled: int = LABELLED) -> tuple[Trees, np.ndarray]:
    """(trees, suffix rates) from labelled rows of url, host, path, label and suffix."""
    fold = F.pmod(F.xxhash64("host", F.lit("fold")), F.lit(FOLDS)).cast("int")
    blocked = (F.col("label") == "block").cast("int")
    counts = np.zeros((SUFFIXES, FOLDS, 2))
    for suffix, f, n, b in known.groupBy("suffix", fold.alias("fold")).agg(F.count("*"), F.sum(blocked)).collect():  # at most SUFFIXES * FOLDS rows
        counts[suffix, f] = n, b
    total = counts.sum(axis=1)
    overall = total[:, 1].sum() / max(1.0, total[:, 0].sum())
    distinct = known.groupBy("url").agg(*[F.first(c).alias(c) for c in ("host", "path", "label", "suffix")], F.count("*").alias("n"))
    hidden = F.pmod(F.xxhash64("url", F.lit("hide")), F.lit(HIDE)) == 0
    sample = sorted(hashed_sample(distinct.withColumn("fold", fold).withColumn("hidden", hidden), labelled, "url").collect())
    if not sample:
        return Trees(np.empty((0, 12)), np.empty(0), np.empty(0)), suffix_rates(total, overall)
    columns = [pa.array([r[c] for r in sample], pa.string()) for c in ("url", "host", "path")]
    suffix, own = np.array([r.suffix for r in sample]), np.array([r.fold for r in sample])
    others = suffix_rates(total[suffix] - counts[suffix, own], overall)
    x = features(*columns, np.where([r.hidden for r in sample], overall, others))
    return Trees(x, np.array([r.label == "block" for r in sample], float), np.log1p(np.array([r.n for r in sample], float))), suffix_rates(total, overall)


def filter_urls(pages: DataFrame, rules=RULES, labelled: int = LABELLED) -> DataFrame:
    """One row per page: page_id, url, host, path, rule, score (of being blocked), verdict."""
    spark = pages.sparkSession
    host, path = host_and_path(F.col("url"))
    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string")).withColumn("host", host).withColumn("path", path)
    rule, verdict = matching_rule(F.col("host"), F.col("path"), rules)
    rows = (rows.withColumn("rule", rule).withColumn("label", verdict)
            .withColumn("suffix", F.pmod(F.xxhash64(F.substring_index("host", ".", -1)), F.lit(SUFFIXES)).cast("int")))
    trees, rates = fit_trees(rows.filter("label is not null"), labelled)
    judged = rows.mapInArrow(_judge(spark.sparkContext.broadcast((trees, rates))),
                             "page_id long, url string, host string, path string, rule string, label string, score double")
    own = F.when(F.col("score") >= 0.5, "block").otherwise("allow")
    return judged.withColumn("verdict", F.coalesce("label", own)).drop("label")
