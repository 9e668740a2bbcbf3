"""Language-model scores: a causal self-attention model over subword ids, and smoothed word counts.

The model predicts the class of the next subword from the CONTEXT subwords
before it; the subword inside its class has its share of the counts of all
training texts.  Frequent subwords are classes of their own.  Queries, keys and
values are linear in the symbols' embeddings and positions enter as a bias of
the distance, so at scoring time they are tables looked up by symbol.

Training: every subword of every training text is a target.  Texts are dealt to
shards by a hash; shards run Adam from the same weights and the weights are
averaged.  The whole corpus is gone through ROUNDS times at any size.  A corpus
that fills ROUNDS shards is averaged ROUNDS times on the way, after a part of the texts each.
Scoring cuts each text in blocks of BLOCK targets whose context windows overlap,
so every token is scored once and always sees CONTEXT tokens.

Word counts cover all training texts.  Counts of the TOP most frequent words
(a fixed bound) travel with the tasks, all other words meet their counts in a
join, pre-aggregated per document.

Null text: empty, the end token alone.  Null id: hashed as an empty string.
Equal rows get equal scores.  Without training texts all counts are 0.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stacksmith.llm import text as T
from stacksmith.llm.packing import encoder
from stacksmith.llm.shared import same, text_col, written

FOLDS, HELD = 7, 2
VOCABULARY, END = 49_408, 49_407
SYMBOLS, CLASSES, SINGLE, WIDTH = 1024, 64, 48, 16
CONTEXT = BLOCK = 16
SPAN = CONTEXT + BLOCK - 1
ROUNDS, SHARD, BATCH, RATE_ADAM = 3, 32_768, 128, 0.01
TOP, FIRST_BITS = 1 << 17, 20
END_HASH = np.uint64(0x8000000000000001)


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % FOLDS == HELD


# ------------------------------------------------------------------- gathering

def _merge(h: np.ndarray, n: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes with their summed counts (1 each without ``n``)."""
    order = np.argsort(h)
    h = h[order]
    first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])) if len(h) else np.empty(0, np.int64)
    return h[first], np.diff(np.append(first, len(h))) if n is None else np.add.reduceat(n[order], first) if len(h) else n


def _gather(path: str):
    """Rows by kind.  0, 1: counts n of words (hash h) and of subwords (id h) in training texts; 2, 3: the subword ids
    of each training text and of each held-out one, 16 bits each, with its number n of blocks and a number h to deal it by."""
    names = ["kind", "h", "n", "ids", "doc_id", "text_key"]

    def batch_of(kind: int, h, n) -> pa.RecordBatch:
        m = len(n)
        return pa.record_batch([pa.array(np.full(m, kind, np.int32)), pa.array(h, pa.int64()), pa.array(n, pa.int64()),
                                pa.nulls(m, pa.binary()), pa.nulls(m, pa.int64()), pa.nulls(m, pa.int64())], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, counts = encoder(path), np.zeros(VOCABULARY, np.int64)
        held_h, held_n = [], []
        seen = TaskContext.get().partitionId() << 40
        for batch in batches:
            train = ~batch.column(1).to_numpy(zero_copy_only=False)
            for lo, hi, buf, offs in T.slices(batch.column(3)):
                learn = train[lo:hi]
                starts, ends, doc = T.words(buf, offs, T.NONSPACE)
                h = T.word_hashes(buf, starts, ends)[learn[doc]]
                h, n = _merge(np.concatenate([h, np.full(int(learn.sum()), END_HASH)]), None)
                held_h.append(h)
                held_n.append(n)
                if sum(map(len, held_h)) > 1_000_000:
                    h, n = _merge(np.concatenate(held_h), np.concatenate(held_n))
                    held_h, held_n = [], []
                    yield batch_of(0, h.view(np.int64), n)
                texts = _with_end(*encode(buf, offs))
                m = hi - lo
                deal = T.mix(np.arange(seen, seen + m, dtype=np.uint64)).view(np.int64)
                seen += m
                yield pa.record_batch([pa.array(np.where(learn, 2, 3).astype(np.int32)), pa.array(deal), pa.array([-(-len(t) // BLOCK) for t in texts], pa.int64()),
                                       pa.array([t.astype("<u2").tobytes() for t in texts], pa.binary()),
                                       batch.column(0).slice(lo, m), batch.column(2).slice(lo, m)], names=names)
                texts = [t for t, some in zip(texts, learn) if some]
                if texts:
                    counts += np.bincount(np.concatenate(texts), minlength=VOCABULARY)
        if held_h:
            h, n = _merge(np.concatenate(held_h), np.concatenate(held_n))
            yield batch_of(0, h.view(np.int64), n)
        some = np.flatnonzero(counts)
        yield batch_of(1, some, counts[some])
    return run


def _with_end(ids: np.ndarray, first: np.ndarray) -> list[np.ndarray]:
    end = np.array([END], np.uint32)
    return [np.concatenate([ids[a:b], end]) for a, b in zip(first[:-1].tolist(), first[1:].tolist())]


def _padded(ids: np.ndarray, blocks: int) -> np.ndarray:
    """CONTEXT start marks, the ids, and marks up to whole blocks; a mark is VOCABULARY."""
    z = np.full(CONTEXT + blocks * BLOCK, VOCABULARY, np.int64)
    z[CONTEXT:CONTEXT + len(ids)] = ids
    return z


def _blocks(texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The padded texts one after another, where each block's window of SPAN + 1 ids starts, and its text."""
    blocks = np.array([-(-len(t) // BLOCK) for t in texts], np.int64)
    owner = np.repeat(np.arange(len(texts)), blocks)
    first = np.concatenate([[0], np.cumsum(blocks * BLOCK + CONTEXT)])
    z = np.concatenate([_padded(t, b) for t, b in zip(texts, blocks.tolist())]) if texts else np.empty(0, np.int64)
    return z, first[owner] + (np.arange(len(owner)) - np.concatenate([[0], np.cumsum(blocks)])[owner]) * BLOCK, owner


# ------------------------------------------------------------------- the model

class Classes:
    """Maps of subword ids to input symbols and output classes, from the training counts."""

    def __init__(self, counts: np.ndarray) -> None:
        rank = np.argsort(-counts, kind="stable")
        self.symbol = np.empty(VOCABULARY + 1, np.int64)
        self.symbol[rank] = np.minimum(np.arange(VOCABULARY), SYMBOLS - 65)
        self.symbol[rank[SYMBOLS - 65:]] = SYMBOLS - 65 + rank[SYMBOLS - 65:] % 64
        self.symbol[VOCABULARY] = SYMBOLS - 1
        self.of = np.empty(VOCABULARY, np.int64)
        self.of[rank[:SINGLE]] = np.arange(SINGLE)
        rest = np.cumsum(counts[rank[SINGLE:]] + 1.0)
        self.of[rank[SINGLE:]] = SINGLE + np.minimum((rest - 1) * (CLASSES - SINGLE) / rest[-1], CLASSES - SINGLE - 1).astype(np.int64)
        mass = np.bincount(self.of, counts + 1.0, minlength=CLASSES)
        self.prior = np.log(mass / mass.sum())
        self.inside = np.log10((counts + 1.0) / mass[self.of])


def initial(classes: Classes, seed: int = 11) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(seed)
    small = lambda *shape: (rng.standard_normal(shape) * 0.2).astype(np.float32)
    return {"e": small(SYMBOLS, WIDTH), "q": small(WIDTH, WIDTH), "k": small(WIDTH, WIDTH), "v": small(WIDTH, WIDTH),
            "r": np.zeros(CONTEXT, np.float32), "u": small(WIDTH, CLASSES), "b": classes.prior.astype(np.float32)}


#: Distance of key k from target o, and which keys a target sees: its own last token is the nearest.
_DISTANCE = np.arange(BLOCK)[:, None] + CONTEXT - 1 - np.arange(SPAN)[None, :]
_SEEN = (_DISTANCE >= 0) & (_DISTANCE < CONTEXT)
#: Where a distance's bias lies; hidden keys share one more.
_BIAS_AT = np.where(_SEEN, _DISTANCE, CONTEXT)
#: Where the numbers of a symbol's embedding lie, two at a time.
_PAIRS = np.arange(SYMBOLS * WIDTH // 2).reshape(SYMBOLS, WIDTH // 2)


def _bias(r: np.ndarray) -> np.ndarray:
    return np.append(r, np.array(-1e9, r.dtype))[_BIAS_AT]


def _exp(x: np.ndarray) -> None:
    # Clipped, not shifted, as in the scorer: exponents stay finite and the shares sum to one.
    np.exp(np.clip(x, -40, 40, out=x), out=x)


def _flat(a: np.ndarray) -> np.ndarray:
    return a.reshape(-1, a.shape[-1])


class Space:
    """Arrays that the steps of a batch of n windows write to, so that batch after batch stays in the processor's caches.

    The last columns of ``kv`` and ``h`` stay 1: products with them give the sums of the weights and add the output bias.
    """

    def __init__(self, n: int, kind=np.float32) -> None:
        new = lambda *shape: np.ones((n, *shape), kind)
        self.z, self.last, self.q, self.kv = new(SPAN, WIDTH), new(BLOCK, WIDTH), new(BLOCK, WIDTH), new(SPAN, 2 * WIDTH + 1)
        self.p, self.ds, self.a, self.h, self.out = new(BLOCK, SPAN), new(BLOCK, SPAN), new(BLOCK, WIDTH + 1), new(BLOCK, WIDTH + 1), new(BLOCK, CLASSES)
        self.dh, self.da, self.dq, self.dkv, self.dz, self.back = new(BLOCK, WIDTH), new(BLOCK, WIDTH + 1), new(BLOCK, WIDTH), new(SPAN, 2 * WIDTH), new(SPAN, WIDTH), new(BLOCK, WIDTH)
        self.cells = np.empty((n, SPAN, WIDTH // 2), np.int64)


def gradients(w: dict[str, np.ndarray], x: np.ndarray, y: np.ndarray, real: np.ndarray, space: Space | None = None,
              part: int = 128, measure: bool = True) -> tuple[float, dict[str, np.ndarray]]:
    """Mean cross-entropy (0 unless ``measure``) and its gradients; x: (n, SPAN) symbols, y: (n, BLOCK) classes, real: which targets count.

    Windows are gone through ``part`` at a time; ``space`` is overwritten.
    """
    scale, kind = np.float32(1 / math.sqrt(WIDTH)), w["e"].dtype
    part = min(part, len(x))
    s = space if space is not None and len(space.z) >= part else Space(part, kind)
    kv_of, q_of, bias, u_of = np.concatenate([w["k"], w["v"]], axis=1), w["q"] * scale, _bias(w["r"]), np.concatenate([w["u"], w["b"][None]])
    n = max(1, int(real.sum()))
    # Pairs of numbers are added as complex ones.
    loss, de = 0.0, np.zeros(SYMBOLS * WIDTH // 2, np.result_type(kind, np.complex64))
    d_q, d_kv, d_r, d_u = (np.zeros(shape, kind) for shape in (w["q"].shape, kv_of.shape, _SEEN.shape, u_of.shape))
    for lo in range(0, len(x), part):
        some = x[lo:lo + part]
        z, last, q, kv, p, ds, a, h, out, dh, da, dq, dkv, dz, back, cells = (b[:len(some)] for b in (
            s.z, s.last, s.q, s.kv, s.p, s.ds, s.a, s.h, s.out, s.dh, s.da, s.dq, s.dkv, s.dz, s.back, s.cells))
        # Symbols are in range: "clip" spares numpy a copy.
        np.take(w["e"], some, axis=0, out=z, mode="clip")
        last[...] = z[:, CONTEXT - 1:]
        np.matmul(_flat(last), q_of, out=_flat(q))
        np.matmul(_flat(z), kv_of, out=_flat(kv)[:, :2 * WIDTH])
        k, v = kv[:, :, :WIDTH], kv[:, :, WIDTH:]
        np.matmul(q, k.transpose(0, 2, 1), out=p)
        p += bias
        _exp(p)
        np.matmul(p, v, out=a)  # the last column sums the weights
        over, mean, d_mean = 1 / a[:, :, WIDTH:], a[:, :, :WIDTH], da[:, :, :WIDTH]
        mean *= over
        np.add(mean, last, out=h[:, :, :WIDTH])
        chances = _flat(out)
        np.matmul(_flat(h), u_of, out=chances)
        _exp(chances)
        counted, of, at = real[lo:lo + part].ravel(), y[lo:lo + part].ravel(), np.arange(len(chances))
        share = (counted / n).astype(kind)
        chances *= (share / (chances @ np.ones(CLASSES, kind)))[:, None]
        chosen = chances[at, of]
        if measure:
            loss -= float(np.log(chosen[counted] * n + 1e-30).sum())
        chances[at, of] = chosen - share
        d_u += _flat(h).T @ chances
        np.matmul(chances, w["u"].T, out=_flat(dh))
        np.multiply(dh, over, out=d_mean)
        np.negative(np.einsum("ijk,ijk->ij", d_mean, mean), out=da[:, :, WIDTH])
        np.matmul(da, v.transpose(0, 2, 1), out=ds)
        ds *= p
        d_r += ds.sum(axis=0)
        np.matmul(ds, k, out=dq)
        np.matmul(ds.transpose(0, 2, 1), q, out=dkv[:, :, :WIDTH])
        np.matmul(p.transpose(0, 2, 1), d_mean, out=dkv[:, :, WIDTH:])
        d_kv += _flat(z).T @ _flat(dkv)
        d_q += _flat(last).T @ _flat(dq)
        np.matmul(_flat(dkv), kv_of.T, out=_flat(dz))
        np.matmul(_flat(dq), q_of.T, out=_flat(back))
        back += dh
        dz[:, CONTEXT - 1:] += back
        np.add.at(de, np.take(_PAIRS, some, axis=0, out=cells, mode="clip").ravel(), dz.ravel().view(de.dtype))
    return loss / n, {"e": de.view(kind).reshape(SYMBOLS, WIDTH), "q": d_q * scale, "k": d_kv[:, :WIDTH], "v": d_kv[:, WIDTH:],
                      "r": np.bincount(_DISTANCE[_SEEN], d_r[_SEEN], minlength=CONTEXT).astype(kind), "u": d_u[:WIDTH], "b": d_u[WIDTH]}


def fit(w: dict[str, np.ndarray], classes: Classes, windows: np.ndarray, rate: float = RATE_ADAM) -> dict[str, np.ndarray]:
    """One pass of Adam over windows of SPAN + 1 ids: SPAN inputs, of which the last BLOCK - 1 are targets too, and the last target."""
    # All weights, and all gradients, lie in one array each.
    names, ends = list(w), np.cumsum([0, *(a.size for a in w.values())])
    now = np.concatenate([a.ravel() for a in w.values()])
    g, m, s = (np.zeros_like(now) for _ in range(3))
    w, grad = ({n: a[lo:hi].reshape(w[n].shape) for n, lo, hi in zip(names, ends[:-1], ends[1:])} for a in (now, g))
    space = Space(min(BATCH, len(windows)))
    for t, lo in enumerate(range(0, len(windows), BATCH), 1):
        part = windows[lo:lo + BATCH]
        target = part[:, CONTEXT:]
        real = target < VOCABULARY
        for n, a in gradients(w, classes.symbol[part[:, :SPAN]], classes.of[np.minimum(target, VOCABULARY - 1)], real, space, measure=False)[1].items():
            grad[n][...] = a
        m *= 0.9
        m += 0.1 * g
        s *= 0.99
        s += 0.01 * g * g
        now -= rate * (m / (1 - 0.9 ** t)) / (np.sqrt(s / (1 - 0.99 ** t)) + 1e-6)
    return w


def _pack(w: dict[str, np.ndarray]) -> bytes:
    return b"".join(w[n].astype("<f4").tobytes() for n in sorted(w))


def _unpack(data: np.ndarray, like: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    out, at = {}, 0
    for n in sorted(like):
        out[n] = data[at:at + like[n].size].reshape(like[n].shape).astype(np.float32)
        at += like[n].size
    return out


def _shard(shared, rate: float, most: int = 2 * SHARD):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        T.let_go()
        w, classes = shared.value
        total, weight, held, size = None, 0, [], 0

        def flush():
            nonlocal total, weight, held, size
            z, start, _ = _blocks(held)
            # Neighbours of one text apart; the same order when a task is run again.
            start = start[np.random.default_rng(len(start)).permutation(len(start))]
            sums = np.frombuffer(_pack(fit(w, classes, z[start[:, None] + np.arange(SPAN + 1)], rate)), "<f4").astype(np.float64) * len(start)
            total, weight, held, size = sums if total is None else total + sums, weight + len(start), [], 0

        for batch in batches:
            for ids in batch.column("ids"):
                held.append(np.frombuffer(ids.as_py(), "<u2"))
                size += -(-len(held[-1]) // BLOCK)
                if size >= most:
                    flush()
        if held:
            flush()
        if weight:
            yield pa.record_batch([pa.array([weight], pa.int64()), pa.array([total.tobytes()], pa.binary())], names=["n", "w"])
    return run


def _sum_weights(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    n, total = 0, None
    for batch in batches:
        for c, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            part = np.frombuffer(data, "<f8")
            n, total = n + c, part if total is None else total + part
    if n:
        yield pa.record_batch([pa.array([n], pa.int64()), pa.array([total.tobytes()], pa.binary())], names=["n", "w"])


def _size(texts: DataFrame) -> int:
    return texts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def rounds(texts: DataFrame, shard: int = SHARD, blocks: int | None = None) -> list[tuple[DataFrame, int]]:
    """The texts (h, n, ids) up to each averaging, and the shards to deal them to: all texts in ROUNDS parts, or all of them every time."""
    blocks = _size(texts) if blocks is None else blocks
    parts = ROUNDS if blocks >= ROUNDS * shard else 1
    return [(texts.filter(F.pmod("h", F.lit(parts)) == turn % parts), max(1, round(blocks / parts / shard))) for turn in range(ROUNDS)]


def steps(texts: DataFrame, shard: int = SHARD) -> list[tuple[int, DataFrame, int, int]]:
    """(turn, dealt texts, shards, blocks that fill a shard) up to each averaging: every turn holds all texts, at any size of the corpus.

    Parts are dealt once, to tables that every turn reads; a task of theirs may hold several shards.
    """
    blocks = _size(texts)
    once = rounds(texts, shard, blocks)
    if blocks < ROUNDS * shard:
        # Hash deals differ a little in size: such a shard is fitted whole.
        return [(turn, _dealt(part, shards, turn), shards, 2 * shard) for turn, (part, shards) in enumerate(once)]
    tables = [(written(_dealt(part, shards, i), "dealt"), shards) for i, (part, shards) in enumerate(once)]
    return [(turn, table, shards, shard) for turn in range(ROUNDS) for table, shards in tables]


def _dealt(texts: DataFrame, shards: int, turn: int) -> DataFrame:
    # An equal deal by hash, the same one when a task is run again.
    return texts.select("h", "ids").repartition(shards, F.xxhash64("h", F.lit(turn))).sortWithinPartitions("h")


def train(texts: DataFrame, classes: Classes, shard: int = SHARD) -> dict[str, np.ndarray]:
    """Weights after ROUNDS turns of shard training and averaging; the driver gets the square root of the shards' rows."""
    spark, w = texts.sparkSession, initial(classes)
    for turn, dealt, shards, most in steps(texts, shard):
        shared = spark.sparkContext.broadcast((w, classes))
        sums = dealt.select("ids").mapInArrow(_shard(shared, RATE_ADAM / (1 + 2 * turn), most), "n long, w binary")
        averaged = sums.repartition(max(1, math.isqrt(shards))).mapInArrow(_sum_weights, "n long, w binary").collect()
        if averaged:
            n = sum(p[0] for p in averaged)
            w = _unpack(sum(np.frombuffer(p[1], "<f8") for p in averaged) / n, w)
    return w


class Scorer:
    """Log10 probabilities of id sequences with the weights turned into tables by symbol."""

    def __init__(self, w: dict[str, np.ndarray], classes: Classes, chunk: int = 128, part: int = 32) -> None:
        self.classes, self.chunk, self.part = classes, chunk, part
        new = lambda *shape: np.empty((part, *shape), np.float32)
        self.buffers = new(BLOCK, WIDTH), new(SPAN, WIDTH), new(SPAN, WIDTH + 1), new(BLOCK, SPAN), new(BLOCK, WIDTH + 1), new(BLOCK, CLASSES)
        self.more = new(BLOCK, CLASSES)
        self.q = (w["e"] @ w["q"] / math.sqrt(WIDTH)).astype(np.float32)
        self.k = np.ascontiguousarray(w["e"] @ w["k"])
        self.v = np.concatenate([w["e"] @ w["v"], np.ones((SYMBOLS, 1), np.float32)], axis=1)
        self.direct = np.ascontiguousarray(w["e"] @ w["u"] + w["b"])
        self.u, self.bias, self.ones = w["u"], _bias(w["r"]), np.ones(CLASSES, np.float32)

    def __call__(self, texts: list[np.ndarray]) -> np.ndarray:
        """Sum over the ids of each text, every id scored once."""
        z, start, owner = _blocks(texts)
        out, rows = np.zeros(len(texts)), self.part * BLOCK
        for lo in range(0, len(start), self.chunk):
            at = start[lo:lo + self.chunk]
            ids = z[at[:, None] + np.arange(SPAN + 1)]
            target = ids[:, CONTEXT:].ravel()
            real = target < VOCABULARY
            known = np.where(real, target, 0)
            of, score = self.classes.of[known], np.empty(len(known), np.float32)
            for a in range(0, len(known), rows):
                score[a:a + rows] = self._log_shares(self.classes.symbol[ids[a // BLOCK:a // BLOCK + self.part, :SPAN]], of[a:a + rows])
            score = score / math.log(10) + self.classes.inside[known]
            score[~real] = 0
            out += np.bincount(owner[lo:lo + self.chunk], score.reshape(-1, BLOCK).sum(axis=1), minlength=len(texts))
        return out

    def _log_shares(self, x: np.ndarray, of: np.ndarray) -> np.ndarray:
        """Natural log of the share of each target's class; x: symbols of some windows, of: the classes."""
        n = len(x)
        q, k, v, p, a, logits = (b[:n] for b in self.buffers)
        last = x[:, CONTEXT - 1:]
        # Symbols are in range: "clip" spares numpy a copy.
        for table, at, out in ((self.q, last, q), (self.k, x, k), (self.v, x, v)):
            np.take(table, at, axis=0, out=out, mode="clip")
        np.matmul(q, k.transpose(0, 2, 1), out=p)
        p += self.bias
        # Clipped, not shifted: exponents stay finite and the shares still sum to one.
        np.exp(np.clip(p, -40, 40, out=p), out=p)
        np.matmul(p, v, out=a)  # the last column sums the weights
        logits = _flat(logits)
        np.matmul(_flat(a[:, :, :WIDTH] / a[:, :, WIDTH:]), self.u, out=logits)
        logits += np.take(self.direct, last.ravel(), axis=0, out=_flat(self.more[:n]), mode="clip")
        np.clip(logits, -40, 40, out=logits)
        chosen = logits[np.arange(len(logits)), of]
        return chosen - np.log(np.exp(logits, out=logits) @ self.ones)


# --------------------------------------------------------------------- scoring

def _model_scores(model):
    """(doc_id, text_key, score) from the subword ids."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(*model.value)
        for batch in batches:
            lo, ids = 0, batch.column(2)
            while lo < len(ids):
                texts, size = [], 0
                while lo + len(texts) < len(ids) and size < T.SLICE_BYTES:
                    texts.append(np.frombuffer(ids[lo + len(texts)].as_py(), "<u2"))
                    size += 2 * len(texts[-1])
                m = len(texts)
                yield pa.record_batch([batch.column(0).slice(lo, m), batch.column(1).slice(lo, m), pa.array(scorer(texts))],
                                      names=["doc_id", "text_key", "score"])
                lo += m
    return run


def _finder(top: np.ndarray):
    """A function from hashes to (places in ``top``, which are there); ``top`` is sorted."""
    shift = np.uint64(64 - FIRST_BITS)
    # Most places follow from a hash's first bits, a binary search takes ten times as long.
    first = np.minimum(np.searchsorted(top, np.arange(1 << FIRST_BITS, dtype=np.uint64) << shift), len(top) - 1).astype(np.int32)
    more = np.append(top[1:] >> shift == top[:-1] >> shift, False)

    def find(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = first[(h >> shift).astype(np.int64)]
        hit = top[at] == h
        look = np.flatnonzero(~hit & more[at])
        at[look] = np.minimum(np.searchsorted(top, h[look]), len(top) - 1)
        hit[look] = top[at[look]] == h[look]
        return at, hit
    return find


def _word_scores(table):
    """One row a document with the sums over frequent words, and rows (uid, h, tf) of its other words."""
    names = ["uid", "doc_id", "text_key", "held_out", "n_words", "known", "logs", "h", "tf"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        top_h, top_log, end_log = table.value
        find = _finder(top_h)
        uid = TaskContext.get().partitionId() << 40
        for batch in batches:
            for lo, hi, buf, offs in T.slices(batch.column(3)):
                m = hi - lo
                starts, ends, doc = T.words(buf, offs, T.NONSPACE)
                h = T.word_hashes(buf, starts, ends)
                words = np.bincount(doc, minlength=m)
                if len(top_h):
                    at, hit = find(h)
                    known = np.bincount(doc[hit], minlength=m)
                    logs = np.bincount(doc[hit], top_log[at[hit]], minlength=m)
                else:
                    hit, known, logs = np.zeros(len(h), bool), np.zeros(m, np.int64), np.zeros(m)
                rest_doc, rest_h = doc[~hit], h[~hit]
                order = np.lexsort((rest_h, rest_doc))
                rest_doc, rest_h = rest_doc[order], rest_h[order]
                new = np.concatenate([[True], (rest_doc[1:] != rest_doc[:-1]) | (rest_h[1:] != rest_h[:-1])]) if len(rest_h) else []
                new = np.flatnonzero(new)
                tf, rest_doc, rest_h = np.diff(np.append(new, len(rest_h))), rest_doc[new], rest_h[new]
                r = len(tf)
                pad = lambda x: pa.concat_arrays([x, pa.nulls(r, x.type)])
                more = lambda x: pa.concat_arrays([pa.nulls(m, pa.int64()), pa.array(x, pa.int64())])
                yield pa.record_batch([
                    pa.array(uid + np.concatenate([np.arange(m), rest_doc])), *(pad(batch.column(i).slice(lo, m)) for i in (0, 2, 1)),
                    pad(pa.array(words, pa.int64())), pad(pa.array(known + (end_log > 0), pa.int64())), pad(pa.array(logs + end_log)),
                    more(rest_h.view(np.int64)), more(tf)], names=names)
                uid += m
    return run


def _most_frequent(vocabulary: DataFrame, top: int) -> tuple[np.ndarray, np.ndarray]:
    """At most ``top`` words as (sorted hashes, log10(count + 1)): all above a count that a histogram of log counts gives."""
    level = F.floor(F.log2("c") * 8).cast("int")
    bins = sorted(((r[0], r[1]) for r in vocabulary.groupBy(level.alias("l")).count().collect()), reverse=True)
    cut, held = None, 0
    for bin_, n in bins:
        if held + n > top:
            break
        cut, held = bin_, held + n
    rows = [] if cut is None else vocabulary.filter(level >= cut).select("h", "c").collect()
    h = np.array([r[0] for r in rows], np.int64).view(np.uint64)
    order = np.argsort(h)
    return h[order], np.log10(np.array([r[1] for r in rows], np.float64) + 1)[order]


def score_texts(docs: DataFrame, tokenizer: str, top: int = TOP) -> DataFrame:
    """One row per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    spark = docs.sparkSession
    texts = docs.select(F.col("doc_id").cast("long"), held_out(F.col("doc_id")).alias("held_out"),
                        F.xxhash64(text_col()).alias("text_key"), text_col().alias("text"))
    gathered = written(texts.mapInArrow(_gather(tokenizer), "kind int, h long, n long, ids binary, doc_id long, text_key long"), "gathered")
    vocabulary = written(gathered.filter("kind = 0").groupBy("h").agg(F.sum("n").alias("c")), "vocabulary")
    tokens, distinct = vocabulary.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    end = vocabulary.filter(F.col("h") == int(END_HASH.view(np.int64))).first()
    counts = np.zeros(VOCABULARY, np.int64)
    for i, n in gathered.filter("kind = 1").groupBy("h").agg(F.sum("n").alias("n")).collect():
        counts[i] = n
    classes = Classes(counts)
    weights = train(gathered.filter("kind = 2").select("h", "n", "ids"), classes)
    scores = (gathered.filter("kind >= 2").select("doc_id", "text_key", "ids")
              .mapInArrow(_model_scores(spark.sparkContext.broadcast((weights, classes))), "doc_id long, text_key long, score double")
              .groupBy("doc_id", "text_key").agg(F.first("score").alias("score")))
    top_h, top_log = _most_frequent(vocabulary, top)
    table = spark.sparkContext.broadcast((top_h, top_log, math.log10(end.c + 1) if end else 0.0))
    words = written(texts.mapInArrow(_word_scores(table), "uid long, doc_id long, text_key long, held_out boolean, n_words long, known long, "
                                                          "logs double, h long, tf long"), "word-scores")
    rare = (words.filter("h is not null").select("uid", "h", "tf").join(vocabulary, "h")
            .groupBy("uid").agg(F.sum("tf").alias("more"), F.sum(F.col("tf") * F.log10(F.col("c") + 1)).alias("more_logs")))
    n_tokens = F.col("n_words") + 1
    based = words.filter("h is null").drop("h", "tf").join(rare, "uid", "left")
    return same(based, scores, ["doc_id", "text_key"]).select(
        "doc_id", "held_out", n_tokens.alias("n_tokens"), (F.col("known") + F.coalesce("more", F.lit(0))).alias("n_known"),
        F.lit(int(tokens)).cast("long").alias("train_tokens"),
        (F.col("logs") + F.coalesce("more_logs", F.lit(0.0)) - n_tokens * math.log10(tokens + distinct + 1)).alias("base_score"), "score")
