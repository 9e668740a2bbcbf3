"""Operator 12: targets against plain water filling, and what the mix takes of hot, null, empty and repeated rows."""

import collections
import re

import pytest

from stacksmith.llm import mixing


def targets(sizes, weights=(5, 2, 1), share=1.5, most=2):
    """source -> target; sizes: source -> words."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    out, open_ = {}, set(order)
    budget = share * sum(sizes.values())
    while open_:
        level = (budget - sum(out.values())) / sum(w[s] for s in open_)
        full = {s for s in open_ if most * sizes[s] <= level * w[s]}
        if not full:
            return out | {s: level * w[s] for s in open_}
        out |= {s: float(most * sizes[s]) for s in full}
        open_ -= full
    return out


def mixed(spark, rows, **more):
    """Rows of the mix as tuples, checked for what always holds."""
    df = spark.createDataFrame([(i, t, s, 7, "x", 1.0) for i, t, s in rows], "doc_id long, text string, source string, size int, taken string, target double")
    got = [tuple(r) for r in mixing.mix_sources(df, **more).collect()]
    count = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    assert collections.Counter((d, s, n) for d, s, n, *_ in got) == collections.Counter((i, s, count(t)) for i, t, s in rows)
    sizes = collections.Counter()
    for i, t, s in rows:
        sizes[s] += count(t)
    want, taken = targets(dict(sizes)), collections.Counter()
    for _, s, n, total, target, k in got:
        assert total == sizes[s] and target == pytest.approx(want[s]) and k in (0, n, 2 * n)
        taken[s] += k
    assert all(taken[s] <= want[s] for s in sizes)
    assert sum(taken.values()) <= 1.5 * sum(sizes.values())
    return got, {s: want[s] - taken[s] for s in sizes}


def test_targets_are_met(spark):
    rows = [(i, "w " * (1 + i * i % 37), "abc"[i % 3]) for i in range(300)]
    first, short = mixed(spark, rows)
    assert max(short.values()) < 2
    assert sorted(mixed(spark, list(reversed(rows)))[0]) == sorted(first)


def test_odd_rows(spark):
    long = "x " * 60_000
    rows = [(1, None, "a"), (2, "", "a"), (3, " \t\r\n", "b"), (None, "a b c", None), (None, "a b c", None), (4, "é x y", ""), (5, long, "b"),
            (6, "b " * 100, "b"), (7, "one", "\U0001F600"), (8, "one", "￮")]
    mixed(spark, rows)


def test_hot_row_is_split_evenly(spark):
    got, short = mixed(spark, [(1, "a b c", "hot")] * 3000 + [(i, "a b c d", "cold") for i in range(2, 2000)])
    assert max(short.values()) < 8
    assert len({k for d, *_, k in got if d == 1}) <= 2


def test_one_long_document_does_not_starve_its_source(spark):
    rows = [(0, "z " * 5000, "a")] + [(i, "z " * (i % 9 + 1), "a") for i in range(1, 1200)] + [(i, "z " * 10, "b") for i in range(2000, 3000)]
    assert max(mixed(spark, rows)[1].values()) < 12


def test_empty(spark):
    assert mixed(spark, [])[0] == []
    assert mixed(spark, [(1, "", "a"), (2, None, None)])[1] == {"a": 0, None: 0}


def test_queue_order(spark):
    rows = [(i, "w " * (i % 5 + 1), "ab"[i % 2]) for i in range(100)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    groups = df.select("source", "doc_id", mixing.word_count("text").alias("size")).groupBy("source", "doc_id", "size").count().withColumnRenamed("count", "n")
    t, budget = mixing.source_targets(groups, (5, 2, 1), 1.5, 2)
    g = groups.join(t.select("source", "source_no"), "source").drop("source")
    mix = sorted(mixing.fair_queue(g, t, budget, 2, 3).collect(), key=lambda r: r.start)
    at = 0
    for r in mix:
        assert r.start == at
        at += r.copies * r["size"]
    assert at <= budget and [(r["round"], r.finish) for r in mix] == sorted((r["round"], r.finish) for r in mix)
