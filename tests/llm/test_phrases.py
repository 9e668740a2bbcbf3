"""Operator 13 against plain counting, and its quicksort against a dictionary."""

import collections
import re

import numpy as np

from stacksmith.llm import phrases as P

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, least, top=2000, most=4):
    f, n = collections.Counter(), collections.Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOW)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            f.update((lang, *w[i:i + m]) for m in range(1, most + 1) for i in range(len(w) - m + 1))
    f = {p: c for p, c in f.items() if c >= least}
    cover = collections.Counter()
    for (lang, *w), c in f.items():
        for m in range(2, len(w)):
            for i in range(len(w) - m + 1):
                cover[lang, *w[i:i + m]] = max(cover[lang, *w[i:i + m]], c)
    rows = collections.defaultdict(list)
    for (lang, *w), a in f.items():
        if len(w) > 1 and not 100 * cover[lang, *w] >= 80 * a:
            cuts = [(2000000 * a // (f[lang, *w[:k]] + f[lang, *w[k:]]), k) for k in range(1, len(w))]
            score, k = min(cuts)
            rows[lang].append((-score, -a, " ".join(w).encode(), f[lang, *w[:k]], f[lang, *w[k:]]))
    return sorted((lang, i + 1, p.decode(), -a, l, r, n[lang], -s) for lang, found in rows.items() for i, (s, a, p, l, r) in enumerate(sorted(found)[:top]))


def mined(spark, rows, **more):
    df = spark.createDataFrame([(t, g, 1, "x", 2.0) for t, g in rows], "text string, lang string, n int, phrase string, h double")
    return sorted(tuple(r) for r in P.mine_phrases(df, **more).collect())


def test_small_vocabulary(spark):
    rng = np.random.default_rng(1)
    words = ["a", "B", "ß", "of", "THE", "new", "york", "x-y", "中文", "d"]
    rows = [(" ".join(words[i] + ("." if rng.random() < 0.1 else "") for i in rng.integers(0, 10, rng.integers(0, 60))), [None, "und", "en", ""][j % 4])
            for j in range(300)]
    want = brute(rows, 5)
    assert len(want) > 200 and mined(spark, rows, min_count=5) == want
    assert mined(spark, rows, min_count=5, top=7) == brute(rows, 5, 7)


def test_odd_rows(spark):
    rows = [(None, "en"), ("", "en"), (" \t\n", None), (".,;", "en"), ("one", "en"), ("la la " * 40_000, "fr"), ("x y\x0bx y\x0cx\ty\rx\x00y " * 50, None)] + [("Same text here, same text", "de")] * 50
    want = brute(rows, 30)
    assert mined(spark, rows) == want and any(r[0] == "fr" for r in want)
    assert mined(spark, []) == [] and mined(spark, [(None, None)]) == []


def test_covered_phrases_go_even_if_the_longer_one_goes(spark):
    rows = [("p q r s", "en")] * 30 + [("p q r", "en")] * 7 + [("p q", "en")] * 3 + [("p q z", "en")] * 40
    assert mined(spark, rows) == brute(rows, 30)


def test_quicksort_counts_equal_pointers():
    rng = np.random.default_rng(2)
    words = rng.integers(0, 6, (5000, 3)).astype(np.uint64) * np.uint64(1 << 61)
    weights = rng.integers(1, 4, 5000)
    want = collections.Counter()
    for w, n in zip(map(tuple, words.tolist()), weights.tolist()):
        want[w] += n
    for least in (1, 40, 10 ** 6):
        at, f = P.multikey_quicksort(words, weights, least)
        assert {tuple(words[i].tolist()): n for i, n in zip(at, f.tolist())} == {w: n for w, n in want.items() if n >= least}
        assert len(at) == len({tuple(words[i].tolist()) for i in at})
