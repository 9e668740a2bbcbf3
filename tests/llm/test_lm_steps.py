"""Training and scoring steps of the language model write to arrays that are used again."""

import tracemalloc

import numpy as np

from stacksmith.llm import lm


def test_training_steps_reuse_their_arrays():
    rng = np.random.default_rng(3)
    classes = lm.Classes(rng.integers(0, 50, lm.VOCABULARY))
    w = lm.initial(classes)
    windows = rng.integers(0, lm.VOCABULARY + 1, (lm.BATCH, lm.SPAN + 1))
    target = windows[:, lm.CONTEXT:]
    batch = classes.symbol[windows[:, :lm.SPAN]], classes.of[np.minimum(target, lm.VOCABULARY - 1)], target < lm.VOCABULARY
    space = lm.Space(lm.BATCH)
    loss, grad = lm.gradients(w, *batch, space)
    tracemalloc.start()
    again = lm.gradients(w, *batch, space)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 2 << 20  # without the space over 4 MB
    for other in (again, lm.gradients(w, *batch, part=7)):
        assert np.isclose(other[0], loss, rtol=1e-5)
        assert all(np.allclose(other[1][n], grad[n], rtol=1e-4, atol=1e-6) for n in grad)


def test_scores_do_not_depend_on_the_parts():
    rng = np.random.default_rng(4)
    classes = lm.Classes(rng.integers(0, 50, lm.VOCABULARY))
    w = lm.initial(classes)
    texts = [rng.integers(0, lm.VOCABULARY, n).astype(np.uint32) for n in (1, 16, 17, 700, 3000)]
    whole = lm.Scorer(w, classes, part=128)(texts)
    assert np.allclose(lm.Scorer(w, classes)(texts), whole, rtol=1e-6)
    assert np.allclose([lm.Scorer(w, classes, chunk=48, part=5)([t])[0] for t in texts], whole, rtol=1e-6)


def test_training_steps_leave_out_the_loss():
    rng = np.random.default_rng(5)
    classes = lm.Classes(rng.integers(0, 50, lm.VOCABULARY))
    w = lm.initial(classes)
    x, y, real = rng.integers(0, lm.SYMBOLS, (9, lm.SPAN)), rng.integers(0, lm.CLASSES, (9, lm.BLOCK)), rng.random((9, lm.BLOCK)) < 0.8
    loss, grad = lm.gradients(w, x, y, real)
    none, same = lm.gradients(w, x, y, real, measure=False)
    assert loss > 0 and none == 0 and all((grad[n] == same[n]).all() for n in grad)


def test_frequent_words_are_found_by_their_first_bits():
    rng = np.random.default_rng(7)
    near = np.uint64(1 << 60) + np.arange(50, dtype=np.uint64)
    top = np.unique(np.concatenate([rng.integers(0, 1 << 64, 5000, dtype=np.uint64), near, np.array([0, 2**64 - 1], np.uint64)]))
    for some in (top, top[:1], near):
        h = np.concatenate([some, some + np.uint64(1), rng.integers(0, 1 << 64, 5000, dtype=np.uint64)])
        at, hit = lm._finder(some)(h)
        assert (hit == np.isin(h, some)).all() and (some[at[hit]] == h[hit]).all()


def test_every_turn_learns_every_text_at_any_size(spark):
    """a corpus that fills the shards is not gone through once instead of ROUNDS times."""
    texts = spark.createDataFrame([((i * 0x9E3779B97F4A7C15 + 2**63) % 2**64 - 2**63, 4, bytes([i])) for i in range(90)], "h long, n long, ids binary")
    for shard in (20, 1000):
        seen = {}
        for turn, part, shards, most in lm.steps(texts, shard):
            assert shards >= 1 and most >= shard
            seen.setdefault(turn, []).extend(bytes(r.ids) for r in part.select("ids").collect())
        assert [sorted(v) for v in seen.values()] == [[bytes([i]) for i in range(90)]] * lm.ROUNDS


def test_training_windows_of_a_corpus_that_fills_the_shards(spark, monkeypatch):
    """the windows fitted are those of all texts, ROUNDS times; before, once."""
    rng = np.random.default_rng(8)
    ids = [rng.integers(0, 300, 16 * 4).astype("<u2") for _ in range(60)]
    texts = spark.createDataFrame([(int(h), 4, t.tobytes()) for h, t in zip(rng.integers(-2**62, 2**62, 60), ids)], "h long, n long, ids binary")
    fitted, real = spark.sparkContext.accumulator(0), lm._shard

    def counting(*a):
        run = real(*a)

        def counted(batches):
            for out in run(batches):
                fitted.add(sum(out.column(0).to_pylist()))
                yield out
        return counted

    monkeypatch.setattr(lm, "_shard", counting)
    w = lm.train(texts, lm.Classes(sum(np.bincount(t, minlength=lm.VOCABULARY) for t in ids)), 20)
    assert fitted.value == 60 * 4 * lm.ROUNDS and all(np.isfinite(a).all() for a in w.values())
