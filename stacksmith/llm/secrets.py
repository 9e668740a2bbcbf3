"""Secret scan: fixed patterns, and a battery of randomness tests under false-discovery control.

DataFrame functions only; no shuffle of texts, no Python on the executors.

Candidates are runs of at least CANDIDATE characters of an encoding's alphabet.
The encoding is inferred from the characters (digits, hex, base32, letters of
one case, lower-case or mixed alphanumerics, base64, base64url).  A '=' inside a
run ends it (KEY=value).  The parts of a run between '/', '_' and '-' that are
long enough are candidates too, each with its own encoding; they count where the
whole run is no discovery.

The null hypothesis is "ordinary string": a chain of symbols that follow one
another as in the words of all documents (``ordinary``), kept to the encoding's
alphabet.  The p-value is the chain's likelihood over that of even random
symbols, at most 1: an ordinary string reaches a ratio of p with chance p at
most, whatever its length (Markov's inequality).  A random string must also
pass, at GATE standard deviations, tests of its symbols' places in the alphabet:
chi-squared uniformity, runs above and below the middle, lag-1 serial correlation.

Benjamini-Hochberg at rate Q then runs in every stratum of encoding and length
class, on a histogram of p-values over all documents: its size is fixed, and
only it reaches the driver.

Null or empty text: no spans.  Equal rows get equal results.  Other columns stay.
"""

from __future__ import annotations

import math
from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stacksmith.llm.shared import text_col

# The base patterns, in the order of the kinds.
KINDS = ("assign", "access", "hex", "random")
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: A greedy run of a class that is long enough is the whole run, so the length can be part of the pattern.
ACCESS = "AKIA[A-Z0-9]{12,}"
HEX = "[0-9a-f]{32,}"
ASSIGN_VALUE = 8

CANDIDATE = 20
#: A run, with '=' as padding only where nothing follows it, and the parts of a run.
RANDOM = f"[A-Za-z0-9+/_-]{{{CANDIDATE},}}(?:=+(?![A-Za-z0-9+/_=-]))?"
PART = f"[A-Za-z0-9+]{{{CANDIDATE},}}=*"
#: How many sightings after a symbol the shares without regard to it count for.
SHRINK = 10.0
GATE = 3.3
Q = 0.01
LENGTHS = (24, 32, 48, 96)
#: Width of a histogram bin in powers of ten, and bins.
BIN, BINS = 0.05, 1200

_DIGITS, _LOWER, _UPPER = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Encodings, most special first: name, pattern of the body, alphabet in its own order.
ENCODINGS = (
    ("digits", "[0-9]+", _DIGITS),
    ("hex", "[0-9a-f]+", _DIGITS + "abcdef"),
    ("HEX", "[0-9A-F]+", _DIGITS + "ABCDEF"),
    ("lower", "[a-z]+", _LOWER),
    ("upper", "[A-Z]+", _UPPER),
    ("base32", "[A-Z2-7]+", _UPPER + "234567"),
    ("lower36", "[a-z0-9]+", _DIGITS + _LOWER),
    ("upper36", "[A-Z0-9]+", _DIGITS + _UPPER),
    ("base62", "[A-Za-z0-9]+", _UPPER + _LOWER + _DIGITS),
    # Even random symbols of these have letters of both cases; one case is words joined by separators.
    ("base64", "(?=.*[a-z])(?=.*[A-Z])[A-Za-z0-9+/]+", _UPPER + _LOWER + _DIGITS + "+/"),
    ("base64url", "(?=.*[a-z])(?=.*[A-Z])[A-Za-z0-9_-]+", _UPPER + _LOWER + _DIGITS + "-_"),
)

_TEXT = "coalesce(text, '')"
_SPAN = "array<struct<start:int,end:int,token:string>>"


def _matches(text: str, pattern: str, group: int = 0, least: int = 1) -> str:
    """SQL for the places (code points, end exclusive) of leftmost matches whose ``group`` has ``least`` characters.

    Java reports no offsets here: the texts between matches give them.
    """
    p = "r'" + pattern.replace("'", r"\x27") + "'"
    # Fields of the zipped row: the text before the match, the match, its group; the text after the last has no match.
    start = "a.at + length(x.`0`)"
    end = f"{start} + length(x.`1`)"
    found = (f"aggregate(arrays_zip(split({text}, {p}, -1), regexp_extract_all({text}, {p}, 0), regexp_extract_all({text}, {p}, {group})), "
             f"named_struct('at', 0, 'out', cast(array() as {_SPAN})), (a, x) -> if(x.`1` is null, a, named_struct('at', {end}, 'out', "
             f"if(length(x.`2`) >= {least}, concat(a.out, array(named_struct('start', {start}, 'end', {end}, 'token', x.`1`))), a.out))), "
             "a -> a.out)")
    return f"if({text} rlike {p}, {found}, cast(array() as {_SPAN}))"


def ordinary(docs: DataFrame) -> dict[str, int]:
    """Counts of two neighbouring symbols (66 * 66 at most) in the words of all documents."""
    words = docs.select(F.explode(F.expr(f"regexp_extract_all({_TEXT}, '[A-Za-z0-9+/_-]{{2,64}}', 0)")).alias("w")).groupBy("w").count()
    pairs = words.select(F.explode(F.expr("transform(sequence(1, length(w) - 1), i -> substring(w, i, 2))")).alias("pair"), "count")
    return {r[0]: r[1] for r in pairs.groupBy("pair").agg(F.sum("count")).collect()}


def evidence(pairs: dict[str, int]) -> list[int]:
    """Hundredths of log10(even share / ordinary share) of a symbol after another: an encoding's table row by row, encoding by encoding.

    An ordinary share is that of the next symbol's kind after this kind, times that of the symbol in its kind (after this
    symbol, if both are letters or both digits).  Letters of both cases share their counts; so do their kinds in an
    encoding of one case.
    """
    kind = lambda c: "u" if c in _UPPER else "l" if c in _LOWER else "d" if c in _DIGITS else c
    follows: dict[tuple[str, str], float] = {}
    single: dict[str, float] = {}
    double: dict[tuple[str, str], float] = {}
    for (a, b), n in pairs.items():
        follows[kind(a), kind(b)] = follows.get((kind(a), kind(b)), 0) + n
        a, b = a.lower(), b.lower()
        single[b] = single.get(b, 0) + n
        if a.isalpha() == b.isalpha() and a.isdigit() == b.isdigit() and a.isalnum():
            double[a, b] = double.get((a, b), 0) + n

    out = []
    for _, _, alphabet in ENCODINGS:
        both = any(c in _UPPER for c in alphabet) and any(c in _LOWER for c in alphabet)
        group = lambda k: "l" if k == "u" and not both else k
        kinds: dict[tuple[str, str], float] = {}
        for (a, b), n in follows.items():
            kinds[group(a), group(b)] = kinds.get((group(a), group(b)), 0) + n
        share = {}
        for k in {group(kind(c)) for c in alphabet}:
            letters = [c for c in alphabet if group(kind(c)) == k]
            total = sum(single.get(c.lower(), 0) + 1 for c in letters)
            share.update({c: (single.get(c.lower(), 0) + 1) / total for c in letters})
        for a in alphabet:
            row, ka = [], group(kind(a))
            like = {k: [c for c in alphabet if group(kind(c)) == k] for k in {group(kind(c)) for c in alphabet}}
            seen = {k: sum(double.get((a.lower(), c.lower()), 0) for c in cs) for k, cs in like.items()}
            for b in alphabet:
                kb = group(kind(b))
                row.append((kinds.get((ka, kb), 0) + 0.5) * (double.get((a.lower(), b.lower()), 0) + SHRINK * share[b]) / (seen[kb] + SHRINK))
            total = sum(row)
            out += [round(100 * math.log10(total / len(alphabet) / p)) for p in row]
    return out


def _tested(token: Column, table: Column) -> Column:
    """Struct of stratum and -log10 p of a candidate; p is 1 where a test says it is not random."""
    body = F.regexp_replace(token, "=+$", "")
    name = alphabet = offset = None
    offsets = list(accumulate((len(letters) ** 2 for *_, letters in ENCODINGS), initial=0))
    for (n, pattern, letters), first in reversed(list(zip(ENCODINGS, offsets))):
        is_it = body.rlike(f"^{pattern}$")
        name = F.when(is_it, n) if name is None else F.when(is_it, n).otherwise(name)
        alphabet = F.when(is_it, letters) if alphabet is None else F.when(is_it, letters).otherwise(alphabet)
        offset = F.when(is_it, first) if offset is None else F.when(is_it, first).otherwise(offset)
    one = F.struct(body.alias("body"), name.alias("name"), alphabet.alias("alphabet"), offset.alias("offset"))

    def places(s: Column) -> Column:
        k = F.length(s["alphabet"]).cast("double")
        x = F.transform(F.split(s["body"], ""), lambda c: F.instr(s["alphabet"], c).cast("double"))
        return F.struct(s["name"].alias("name"), k.alias("k"), F.length(s["body"]).cast("double").alias("n"), x.alias("x"), s["offset"].alias("offset"),
                        F.aggregate(F.array_distinct(F.split(s["body"], "")), F.lit(0.0),
                                    lambda a, c: a + F.pow(F.length(s["body"]) - F.length(F.replace(s["body"], c, F.lit(""))), F.lit(2.0))).alias("squares"))

    def sums(s: Column) -> Column:
        mean = F.aggregate(s["x"], F.lit(0.0), lambda a, v: a + v)
        mean = F.try_divide(mean, s["n"])
        high = F.size(F.filter(s["x"], lambda v: v > s["k"] / 2)).cast("double")
        pairs = F.zip_with(F.slice(s["x"], F.lit(1), F.size(s["x"]) - 1), F.slice(s["x"], F.lit(2), F.size(s["x"]) - 1),
                           lambda a, b: F.struct(((a - mean) * (b - mean)).alias("p"), ((a > s["k"] / 2) != (b > s["k"] / 2)).alias("turn"),
                                                 F.get(table, (s["offset"] + (a - 1) * s["k"] + b - 1).cast("int")).cast("double").alias("e")))
        return F.struct(s["name"].alias("name"), s["k"].alias("k"), s["n"].alias("n"), s["squares"].alias("squares"), high.alias("high"),
                        F.aggregate(s["x"], F.lit(0.0), lambda a, v: a + (v - mean) * (v - mean)).alias("spread"),
                        F.aggregate(pairs, F.lit(0.0), lambda a, p: a + p["p"]).alias("serial"),
                        F.aggregate(pairs, F.lit(0.0), lambda a, p: a + p["e"]).alias("evidence"),
                        (F.size(F.filter(pairs, lambda p: p["turn"])) + 1).cast("double").alias("runs"))

    def result(s: Column) -> Column:
        n, k = s["n"], s["k"]
        free = k - 1
        over = F.try_divide  # strings of one symbol or none have no statistic: null, not random
        chi = over(s["squares"] * k, n) - n
        z = over(chi - free, F.sqrt(2 * free))
        mean = over(2 * s["high"] * (n - s["high"]), n) + 1
        z_runs = over(s["runs"] - mean, F.sqrt(over((mean - 1) * (mean - 2), n - 1)))
        z_serial = (over(s["serial"], s["spread"]) + over(F.lit(1.0), n)) * F.sqrt(n)
        fine = (F.abs(z_runs) < GATE) & (F.abs(z_serial) < GATE) & (z < GATE) & s["name"].isNotNull() & (n >= CANDIDATE)
        length = F.lit(0)
        for i, edge in enumerate(LENGTHS, 1):
            length = F.when(n >= edge, i).otherwise(length)
        level = F.when(fine & (s["evidence"] > 0), s["evidence"] / 100).otherwise(0.0)
        return F.struct(F.concat_ws("-", s["name"], length.cast("string")).alias("stratum"),
                        F.least(F.lit(BINS), F.floor(level / BIN)).cast("int").alias("bin"))

    # Nested one-element transforms give each step a name that later steps share.
    steps = F.transform(F.transform(F.transform(F.array(one), places), sums), result)
    return F.element_at(steps, 1)


def _candidates(text: str, table: list[int]) -> Column:
    """Runs, each followed by its parts; ``run``: where the run of a part begins, -1 for a run."""
    parts = f"filter({_matches('s.token', PART)}, p -> length(p.token) < length(s.token))"
    found = F.expr(f"flatten(transform({_matches(text, RANDOM)}, s -> concat(array(named_struct('start', s.start, 'end', s.end, 'token', s.token, 'run', -1)), "
                   f"transform({parts}, p -> named_struct('start', s.start + p.start, 'end', s.start + p.end, 'token', p.token, 'run', s.start)))))")
    known = F.expr(f"cast(split('{','.join(map(str, table))}', ',') as array<int>)")
    return F.transform(found, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["run"].alias("run"), _tested(s["token"], known).alias("t")))


def thresholds(docs: DataFrame, rate: float = Q, table: list[int] | None = None) -> dict[str, int]:
    """By stratum, the histogram bin from which candidates are discoveries; strata without any are left out."""
    table = evidence(ordinary(docs)) if table is None else table
    texts = docs.select(text_col().alias("__text"))
    tests = texts.select(F.explode(_candidates("__text", table)).alias("c")).select("c.t.stratum", "c.t.bin")
    tails: dict[str, dict[int, int]] = {}
    for stratum, bin_, n in tests.groupBy("stratum", "bin").count().collect():
        tails.setdefault(stratum, {})[bin_] = n
    out = {}
    for stratum, bins in tails.items():
        tested, seen = sum(bins.values()), 0
        for b in sorted((b for b in bins if b > 0), reverse=True):
            seen += bins[b]
            if tested * 10 ** (-b * BIN) <= rate * seen:
                out[stratum] = b
    return out


def unused(docs: DataFrame, name: str) -> str:
    """``name``, with underscores before it while ``docs`` has a column of that name."""
    taken = {c.lower() for c in docs.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def find_secrets(docs: DataFrame, rate: float = Q, out: str = "spans") -> DataFrame:
    """``docs`` with ``out``: array of (start, kind_no, end), sorted; kind_no indexes KINDS.  A column of that name is replaced."""
    text, base_at, random_at = (unused(docs, n) for n in ("__text", "__base", "__random"))
    table = evidence(ordinary(docs))
    cuts = thresholds(docs, rate, table)
    docs = docs.withColumn(text, text_col())
    tag = lambda found, kind: F.transform(found, lambda s: F.struct(
        s["start"].alias("start"), F.lit(kind).alias("kind_no"), s["end"].alias("end")))
    base = F.concat(tag(F.expr(_matches(text, ASSIGN, 1, ASSIGN_VALUE)), 0), tag(F.expr(_matches(text, ACCESS)), 1),
                    tag(F.expr(_matches(text, HEX)), 2))
    docs = docs.withColumn(base_at, base)
    if not cuts:
        return docs.withColumn(out, F.array_sort(base_at)).drop(text, base_at)
    least = F.create_map(*[F.lit(x) for s, b in sorted(cuts.items()) for x in (s, b)])
    docs = docs.withColumn(random_at, F.filter(_candidates(text, table), lambda c: c["t"]["bin"] >= F.element_at(least, c["t"]["stratum"])))
    random = F.filter(random_at, lambda c: ~F.exists(base_at, lambda b: (b["start"] < c["end"]) & (c["start"] < b["end"]))
                      & ~F.exists(random_at, lambda r: (c["run"] == r["start"]) & (r["run"] < 0)))
    return docs.withColumn(out, F.array_sort(F.concat(base_at, tag(random, 3)))).drop(text, base_at, random_at)


def span_strings(spans: Column, kinds: int) -> Column:
    """kind:start:end of the spans of the first ``kinds`` kinds, joined by commas."""
    names = F.array(*[F.lit(k) for k in KINDS])
    some = F.filter(spans, lambda s: s["kind_no"] < kinds)
    return F.concat_ws(",", F.transform(some, lambda s: F.concat_ws(":", F.element_at(names, s["kind_no"] + 1), s["start"], s["end"])))


def redact(docs: DataFrame, mark: str = "[SECRET]", spans: str = "spans") -> DataFrame:
    """``docs`` with every span of ``spans`` replaced in ``text``, overlapping ones as one; ``spans`` goes."""
    done = F.expr(f"aggregate(`{spans}`, named_struct('at', 0, 'out', ''), (a, s) -> if(s.end <= a.at, a, named_struct("
                  f"'at', s.end, 'out', if(s.start < a.at, a.out, concat(a.out, substring(text, a.at + 1, s.start - a.at), '{mark}')))), "
                  "a -> concat(a.out, substring(text, a.at + 1)))")
    return docs.withColumn("text", F.when(F.size(spans) > 0, done).otherwise(F.col("text"))).drop(spans)
