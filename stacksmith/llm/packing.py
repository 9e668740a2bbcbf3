"""Best-fit packing with exact-complement hashing.

Texts become token ids (plus one end id), only longer ones are cut, and the
pieces are placed in sequences of at most ``capacity`` tokens.  All decisions
are taken on the histogram of piece lengths, which has at most ``capacity``
rows whatever the corpus: sums of one, two and three lengths are indexed, and a
combination that fills a gap exactly is used as often as its counts allow; what
is left goes best-fit, longest first.  The plan (which ranks of a length go to
which sequences) is as small as the histogram, and each piece finds its place
from its rank among the pieces of its length.  Ranks are counted in hashed
buckets, so a length that a third of the pieces share is split.

Null text: empty, one end token.  Equal rows are separate pieces.  Null ids
are kept.  Other columns are ignored; an empty table gives no pieces.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stacksmith.llm import text as T
from stacksmith.llm.shared import text_col, written

CAPACITY = 2048
END_ID = 0
#: A worker's table of known parts, and the ids it has room for.
SLOTS, POOL = 1 << 20, 8_000_000
#: Copies of a piece that one task makes at a time.
COPIES = 4096
RANK_BUCKETS = 1024

_PART = ~np.isin(np.arange(256), (10, 32))
_LETTER = np.isin(np.arange(256), [*range(65, 91), *range(97, 123)])
#: Parts that fall into runs of letters, single digits and runs of signs: no apostrophes, which may begin a suffix.
_MIXED = re.compile("[!-&(-~À-ÖØ-öø-ÿ]+")
_RUNS = re.compile("[a-zß-öø-ÿ]+|[0-9]|[^a-zß-öø-ÿ0-9]+")

_PIECES = "doc_id long, piece int, start long, length long, ids binary"


def _runs(part: str) -> list[str]:
    """The lower-cased words that the tokenizer makes of a part; empty where only the whole tokenizer tells."""
    if part.isalpha() and (part.isascii() or max(part) < "\u0130"):
        return [part.lower()]
    return _RUNS.findall(part.lower()) if _MIXED.fullmatch(part) and "<|" not in part else []


class WordIds:
    """Ids of texts as the concatenation of the ids of their blank-separated parts.

    Valid for tokenizers whose pre-tokenizer drops white space, never joins
    characters across it, parts letters from other characters, and lower-cases;
    ``tests/llm`` compares with whole-text encoding.  A full stop or comma after
    a letter and before a blank is a part of its own.  Parts seen lately are
    found by their 64-bit hash in a table of SLOTS entries, two for each hash:
    the first keeps the part that came first, in the second the newest wins.
    """

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        settings = json.loads(self.tokenizer.to_str())
        # Lower-cased Latin-1 words need no normalising.
        self.plain = Tokenizer.from_str(json.dumps(settings | {"normalizer": None}))
        suffix = settings["model"].get("end_of_word_suffix")
        self.ends = np.zeros(self.tokenizer.get_vocab_size(), bool)
        self.ends[[i for w, i in self.tokenizer.get_vocab().items() if suffix and w.endswith(suffix)]] = True
        self._reset(POOL)

    def _reset(self, room: int) -> None:
        # A part's hash, and where its ids begin and their number side by side: one look at the memory gives both.
        self.known = np.zeros((SLOTS, 2), np.uint64)
        self.pool, self.used = np.empty(room, np.uint32), 0

    def _encode(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all parts one after another, number of ids of each)."""
        found = [e.ids for e in self.tokenizer.encode_batch_fast(parts, add_special_tokens=False)]
        return np.array([i for ids in found for i in ids], np.uint32), np.array([len(ids) for ids in found], np.int64)

    def _encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The same for lower-case Latin-1 words, many in one call: a word's last id carries the end-of-word suffix."""
        out, sizes = [np.empty(0, np.uint32)], [np.empty(0, np.int64)]
        for lo in range(0, len(words), 2000):
            some = words[lo:lo + 2000]
            ids = np.array(self.plain.encode_batch_fast([" ".join(some)], add_special_tokens=False)[0].ids, np.uint32)
            size = np.diff(np.flatnonzero(self.ends[ids]), prepend=-1)
            if len(size) != len(some):
                ids, size = self._encode(some)
            out.append(ids)
            sizes.append(size)
        return np.concatenate(out), np.concatenate(sizes)

    def _encode_parts(self, parts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids of all parts, where those of each part begin, their number)."""
        texts = [s.decode("utf-8", "replace") for s in parts]
        runs = [_runs(s) for s in texts]
        latin = [bool(r) for r in runs]
        words, word_sizes = self._encode_words([w for r in runs for w in r])
        if words.size:
            word_sizes = np.add.reduceat(word_sizes, np.cumsum([0, *(len(r) for r in runs if r)])[:-1])
        others, other_sizes = self._encode([s for s, is_latin in zip(texts, latin) if not is_latin])
        size, order = np.concatenate([word_sizes, other_sizes]), np.argsort(~np.array(latin, bool), kind="stable")
        begin, sizes = np.empty(len(texts), np.int64), np.empty(len(texts), np.int64)
        begin[order], sizes[order] = np.cumsum(size) - size, size
        return np.concatenate([words, others]), begin, sizes

    def __call__(self, buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of a slice, where each row's ids begin and the last end)."""
        n = len(offs) - 1
        if not len(buf):
            return np.empty(0, np.uint32), np.zeros(n + 1, np.int64)
        blank = ~_PART[buf]
        stop = np.flatnonzero((buf == 46) | (buf == 44))
        stop = stop[(stop > 0) & ~np.isin(stop, offs)]
        after = np.append(blank, True)
        after[offs] = True
        before = buf[stop - 1]
        latin = (before >= 0x80) & (before <= 0xBF) & (before != 0x97) & (before != 0xB7) & (buf[np.maximum(stop - 2, 0)] == 0xC3)
        stop = stop[after[stop + 1] & (_LETTER[before] | latin)]
        starts, ends, doc = T.words(buf, offs, _PART, stop)
        data = buf.tobytes()
        # Special tokens are matched before lower-casing.
        h = T.word_hashes(buf, starts, ends, lower=b"<|" not in data) | np.uint64(1)
        slot = ((h >> np.uint64(8)) & np.uint64(SLOTS - 2)).astype(np.int64)
        entry = np.take(self.known, slot, axis=0)
        hit = entry[:, 0] == h
        second = np.flatnonzero(~hit)
        slot[second] ^= 1
        entry[second] = np.take(self.known, slot[second], axis=0)
        hit[second] = entry[second, 0] == h[second]
        at, size = (entry[:, 1] >> np.uint64(32)).astype(np.int64), (entry[:, 1] & np.uint64(0xFFFFFFFF)).astype(np.int64)
        for _ in range(2):
            miss = np.flatnonzero(~hit)
            if not len(miss):
                break
            _, first, which = np.unique(h[miss], return_index=True, return_inverse=True)
            some = miss[first]
            found, begin, sizes = self._encode_parts([data[a:b] for a, b in zip(starts[some].tolist(), ends[some].tolist())])
            room = len(found)
            if self.used + room > len(self.pool):
                if self.used:  # a new pool; what was known is encoded again
                    self._reset(POOL)
                    hit[:] = False
                    continue
                self._reset(room)
            places = self.used + begin
            self.pool[self.used:self.used + room] = found
            self.used += room
            at[miss], size[miss] = places[which], sizes[which]
            to = slot[some] ^ 1
            to[self.known[to, 0] > 0] ^= 1
            self.known[to] = np.stack([h[some], (places << 32 | sizes).astype(np.uint64)], axis=1)
            break
        total = np.concatenate([[0], np.cumsum(size)])
        ids = self.pool[np.repeat(at - total[:-1], size) + np.arange(total[-1])]
        return ids, total[np.searchsorted(doc, np.arange(n + 1))]


def encoder(path: str) -> WordIds:
    """This process's encoder; later tasks of the stage find its words known."""
    return T.kept(f"encoder {path}", lambda: WordIds(path))


def _tokenize(path: str, capacity: int, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path)
        end, step = np.array([end_id], "<u4").tobytes(), 4 * capacity
        for batch in batches:
            ids = batch.column(0)
            for lo, _, buf, offs in T.slices(batch.column(1)):
                rows, piece, start, parts = [], [], [], []
                tokens, first = encode(buf, offs)
                data_of, first = tokens.astype("<u4", copy=False).tobytes(), (4 * first).tolist()
                for i, (a, b) in enumerate(zip(first, first[1:]), lo):
                    data = data_of[a:b] + end
                    for k, at in enumerate(range(0, len(data), step)):
                        rows.append(i)
                        piece.append(k)
                        start.append(at // 4)
                        parts.append(data[at:at + step])
                yield pa.record_batch(
                    [ids.take(pa.array(rows, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()),
                     pa.array([len(p) // 4 for p in parts], pa.int64()), pa.array(parts, pa.binary())],
                    names=["doc_id", "piece", "start", "length", "ids"])
    return run


def token_pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """doc_id, piece, start, length and ids (little-endian unsigned 32-bit) of every piece."""
    return docs.select(F.col("doc_id").cast("long"), text_col().alias("text")).mapInArrow(_tokenize(tokenizer, capacity, end_id), _PIECES)


def plan_lengths(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[tuple[int, ...], int]]:
    """Sequences as (piece lengths, how often), using every piece of the histogram once."""
    left = np.zeros(capacity + 1, np.int64)
    for n, c in counts.items():
        left[n] = c
    plan: list[tuple[tuple[int, ...], int]] = []

    def pair(gap: int) -> tuple[int, ...] | None:
        """Two available lengths that sum to ``gap``, the longest first member."""
        b = np.arange(max(1, gap // 2), gap)
        if not len(b):
            return None
        ok = (left[b] > 0) & (left[gap - b] > 0) & ((2 * b != gap) | (left[b] > 1)) & (2 * b >= gap)
        at = np.flatnonzero(ok)
        return (int(b[at[-1]]), gap - int(b[at[-1]])) if len(at) else None

    def fill(gap: int) -> tuple[int, ...] | None:
        if gap == 0:
            return ()
        if left[gap] > 0:
            return (gap,)
        if found := pair(gap):
            return found
        for b in np.flatnonzero(left[:gap])[::-1].tolist():
            left[b] -= 1
            found = pair(gap - b)
            left[b] += 1
            if found:
                return (b, *found)
        return None

    def use(lengths: tuple[int, ...]) -> None:
        need = {n: lengths.count(n) for n in lengths}
        times = int(min(left[n] // k for n, k in need.items()))
        for n, k in need.items():
            left[n] -= k * times
        plan.append((lengths, times))

    for n in range(capacity, 0, -1):
        while left[n] > 0:
            left[n] -= 1
            found = fill(capacity - n)
            left[n] += 1
            if found is None:
                break
            use((n, *found))

    open_bins: dict[int, list[tuple[tuple[int, ...], int]]] = {}
    for n in range(capacity, 0, -1):
        todo = int(left[n])
        while todo:
            gap = min((g for g in open_bins if g >= n), default=None)
            if gap is None:
                each = min(capacity // n, todo)
                times = todo // each
                open_bins.setdefault(capacity - each * n, []).append(((n,) * each, times))
                todo -= each * times
                continue
            lengths, times = open_bins[gap].pop()
            if not open_bins[gap]:
                del open_bins[gap]
            each = min(gap // n, todo)
            used = min(times, todo // each)
            if used < times:
                open_bins.setdefault(gap, []).append((lengths, times - used))
            open_bins.setdefault(gap - each * n, []).append((lengths + (n,) * each, used))
            todo -= each * used
    plan += [b for bins in open_bins.values() for b in bins]
    return plan


def places(plan: list[tuple[tuple[int, ...], int]]) -> np.ndarray:
    """Rows (length, first rank, copies a sequence, first sequence, offset), sorted by length and rank."""
    rows, used, sequence = [], {}, 0
    for lengths, times in plan:
        offset = 0
        for n in dict.fromkeys(lengths):
            each = lengths.count(n)
            rows.append((n, used.get(n, 0), each, sequence, offset))
            used[n] = used.get(n, 0) + each * times
            offset += each * n
        sequence += times
    return np.array(sorted(rows), np.int64).reshape(-1, 5)


def _place(table):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = table.value
        key = (t[:, 0] << 48) + t[:, 1]
        for batch in batches:
            length, rank = (batch.column(k).to_numpy(zero_copy_only=False) for k in ("length", "rank"))
            row = t[np.searchsorted(key, (length << 48) + rank, "right") - 1]
            nth = rank - row[:, 1]
            out = pa.Table.from_batches([batch]).drop_columns(["rank"])
            out = out.append_column("sequence_id", pa.array(row[:, 3] + nth // row[:, 2]))
            out = out.append_column("offset", pa.array(row[:, 4] + nth % row[:, 2] * length))
            yield from out.to_batches()
    return run


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Add sequence_id and offset to a table of pieces (doc_id, piece, length, and any more columns but maps).

    Equal pieces are one row with a count until they get their places, so neither a repeated id nor a
    repeated piece gathers in one task, and a task that runs again gives the same ranks.
    """
    spark = pieces.sparkSession
    cols = pieces.columns
    kinds = pieces.groupBy(*cols).agg(F.count("*").alias("__copies"))
    rows = written(kinds.withColumn("__bucket", F.pmod(F.xxhash64(*cols), F.lit(RANK_BUCKETS))), "piece-kinds")
    counts = rows.groupBy("length", "__bucket").agg(F.sum("__copies").alias("__n"))
    totals = {r[0]: r[1] for r in counts.groupBy("length").agg(F.sum("__n")).collect()}  # at most ``capacity`` rows
    table = spark.sparkContext.broadcast(places(plan_lengths(totals, capacity)))
    # Both windows are bounded: RANK_BUCKETS rows a length, and the kinds in one bucket of one length.
    before = counts.withColumn("__before", F.sum("__n").over(Window.partitionBy("length").orderBy("__bucket")) - F.col("__n"))
    order = Window.partitionBy("length", "__bucket").orderBy(*cols).rowsBetween(Window.unboundedPreceding, 0)
    first = (rows.withColumn("__nth", F.sum("__copies").over(order) - F.col("__copies")).join(before.drop("__n"), ["length", "__bucket"])
             .withColumn("__first", F.col("__before") + F.col("__nth")))
    # Copies come back in runs of COPIES, dealt anew, so that no task makes all of a frequent piece.
    runs = first.select(*cols, "__copies", "__first", F.explode(F.sequence(F.lit(0).cast("long"), F.col("__copies") - 1, F.lit(COPIES).cast("long"))).alias("__run"))
    runs = runs.repartition("length", "__first", "__run")
    last = F.least(F.col("__run") + COPIES, F.col("__copies")) - 1
    ranked = runs.select(*cols, F.explode(F.sequence(F.col("__first") + F.col("__run"), F.col("__first") + last)).alias("rank"))
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in pieces.schema)
    return ranked.mapInArrow(_place(table), f"{schema}, sequence_id long, offset long")


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """Pieces with ids_crc32 and their place; ids are hashed where they are made, so only a few numbers a piece move."""
    pieces = token_pieces(docs, tokenizer, capacity, end_id)
    small = written(pieces.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32")), "pieces")
    return pack(small, capacity)
