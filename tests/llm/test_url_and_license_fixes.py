"""Unlabelled suffixes, out-of-fold suffix rates, and phrase places in long texts."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from stacksmith.llm import licenses, urls

# The three suffixes are made of the same letters, so that no other feature tells them apart.
RULES = (("allow", "com", "/"), ("block", "cmo", "/"))


def _verdicts(spark, n_com, n_net):
    name = lambda i: f"http://h{100 + 7 * i % 900}"  # noqa: E731  (one length, so that only the suffix tells)
    hosts = [f"{name(i)}.com/{i % 7}" for i in range(n_com)] + [f"{name(i)}.cmo/{i % 7}" for i in range(n_net)]
    new = [f"{name(i)}.ocm/{i % 7}" for i in range(200)]
    pages = spark.createDataFrame(list(enumerate(hosts + new)), "page_id long, url string")
    rows = urls.filter_urls(pages, RULES).filter("rule is null").collect()
    assert len(rows) == 200
    return [r.verdict for r in rows], [r.score for r in rows]


@pytest.mark.parametrize("n_com,n_net,verdict", [(400, 100, "allow"), (100, 400, "block")])
def test_an_unlabelled_suffix_is_judged_by_the_prior(spark, n_com, n_net, verdict):
    verdicts, scores = _verdicts(spark, n_com, n_net)
    assert verdicts.count(verdict) > 160
    assert abs(np.mean(scores) - n_net / (n_com + n_net)) < 0.2


def test_suffix_rates_leave_the_own_hosts_out(spark):
    """Suffixes of one host each: their rates tell nothing of other hosts, so held-out labels stay a guess."""
    rng = np.random.default_rng(3)
    label = rng.integers(0, 2, 600)
    rows = spark.createDataFrame([(f"http://x.s{i}/", f"x.s{i}", "/", "block" if label[i] else "allow", i) for i in range(600)],
                                 "url string, host string, path string, label string, suffix int")
    trees, rates = urls.fit_trees(rows)
    assert len(trees.trees) == urls.TREES and rates[:600][label == 1].min() > rates[:600][label == 0].max()
    base = urls.features(*[rows.select(c).toArrow().column(0).combine_chunks() for c in ("url", "host", "path")], np.full(600, label.mean()))
    high, low = base.copy(), base.copy()
    high[:, -1], low[:, -1] = rates.max(), rates.min()
    # Trees that had seen a row's own label in its rate would follow the rate.
    assert abs(trees(high).mean() - trees(low).mean()) < 0.3


def test_phrase_places_in_a_long_text(spark):
    words = []
    for i in range(60_000):
        words += ["word", "mit", "license"] if i % 2 else ["general", "public", "license", "x"]
    text = " ,".join(words)
    row = licenses.scan_licenses(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    places = [i for i, w in enumerate(words) if words[i:i + 2] == ["mit", "license"] or words[i:i + 3] == ["general", "public", "license"]]
    assert (row.n_words, row.n_base, row.first_word, row.last_word) == (len(words), len(places), places[0], places[-1])
    assert row.base_labels == ["gpl", "mit"]
