"""Best-fit packing by a configuration linear program.

Pass 1 encodes each text, appends the end id, cuts only documents longer than a
sequence, and keeps (doc_id, piece, length, checksum). Full pieces are sequences
of their own. The histogram of the other lengths (fewer bins than a sequence has
tokens, however many documents) is all the driver sees. There:

* configurations (multisets of length classes that fit a sequence) are the columns of
  a covering linear program: as few sequences as possible that hold all pieces.
  Multiplicative weights solve it: each round prices the classes, finds the best
  configuration by a knapsack dynamic program, and lowers the prices of what it
  covers. Any prices bound the program from below (their worth of all pieces over
  the best configuration's worth), so the gap is known. Pivots over the
  configurations found, priced by the same knapsack, then make the solution basic,
  one configuration a class at most, and close the gap;
* whole counts are dealt, the program is solved again for what remains (each time
  the counts of one half or more go up to one), and the last pieces are packed best
  fit, longest first, into gaps and new sequences.

With at most ``EXACT`` different lengths each is a class of its own, and a plan has
at most as many sequences as the bound and one a class; with more, lengths go to
classes of ``GRAIN`` tokens.

Pass 2 deals real pieces to planned places: a piece's rank among the pieces of
its length is found by a range partitioning (no key in one task) and looked up
in the plan, whose size depends on the histogram alone.

Null text counts as empty and is one piece holding the end id. Rows are never
merged, so repeated rows are packed each. Rows with a null doc_id are packed too.
"""

from __future__ import annotations

import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import prepare, read, table
from .tokens import encoder

SIZE = 4096
GRAIN = 16  # tokens of one length class in the linear program
EXACT = 48  # different lengths up to which each is a class of its own
ROUNDS, RATE = 150, 0.2  # of the multiplicative weights
PIVOTS = 3000
GAP = 1e-4  # of the bound by which a solution may exceed it
SOLVES = 6  # of the linear program, for what remains of the one before


def _pieces(path: str, size: int, end: int):
    def run(batches):
        for b in batches:
            ids, at = encoder(path).encode(b.column("text"))
            docs, out = b.column("doc_id").to_pylist(), [[], [], [], [], []]
            for r, d in enumerate(docs):
                x = np.append(ids[at[r] : at[r + 1]].astype("<u4"), np.uint32(end))
                for k, s in enumerate(range(0, len(x), size)):
                    y = x[s : s + size]
                    for c, v in zip(out, (d, k, s, len(y), zlib.crc32(y.tobytes()))):
                        c.append(v)
            yield pa.RecordBatch.from_arrays(
                [pa.array(out[0], pa.int64()), pa.array(out[1], pa.int32()), *(pa.array(c, pa.int64()) for c in out[2:])], ["doc_id", "piece", "start", "length", "ids_crc32"]
            )

    return run


def _knapsack(price: np.ndarray, sizes: np.ndarray, cap: int) -> np.ndarray:
    """How many of each class (ascending sizes) the multiset of the highest total price within cap holds."""
    best, pick = np.zeros(cap + 1), np.full(cap + 1, -1)
    fits = np.searchsorted(sizes, np.arange(cap + 1), "right")
    for c in range(1, cap + 1):
        best[c] = best[c - 1]
        m = fits[c]
        if m:
            v = best[c - sizes[:m]] + price[:m]
            k = int(v.argmax())
            if v[k] > best[c]:
                best[c], pick[c] = v[k], k
    uses, c = np.zeros(len(sizes)), cap
    while c > 0:
        if pick[c] >= 0:
            uses[pick[c]] += 1
            c -= int(sizes[pick[c]])
        else:
            c -= 1
    return uses


def _weights(sizes: np.ndarray, need: np.ndarray, cap: int) -> tuple[list[np.ndarray], float]:
    """Configurations that multiplicative weights choose, and the best lower bound of their prices."""
    price, bound, columns = sizes / cap, 0.0, {}
    for _ in range(min(ROUNDS, 20 * len(sizes))):
        uses = _knapsack(price, sizes, cap)
        bound = max(bound, float(need @ price / (uses @ price)))
        columns[uses.tobytes()] = uses
        on = uses > 0
        share = uses[on] / need[on]  # of each class that one such sequence covers
        price[on] *= np.exp(-RATE * share / share.max())
        price /= price.max()
    return list(columns.values()), bound


def configurations(sizes: np.ndarray, demand: np.ndarray, cap: int) -> tuple[list[tuple[np.ndarray, float]], float]:
    """(configuration, how many) that cover demand[i] > 0 pieces of sizes[i] (ascending),
    not more configurations than classes, and a lower bound of any cover's total."""
    unit = int(np.gcd.reduce(sizes))
    sizes, cap = sizes // unit, cap // unit
    need = demand.astype(float)
    found, bound = _weights(sizes, need, cap)
    columns = np.array(found)
    m = len(sizes)
    # a basis of configurations of one class each, to start from; a shade more of some
    # classes keeps pivots from standing still
    rhs = need * (1 + 1e-7 * np.random.default_rng(1).random(m))
    base = np.diag((cap // sizes).astype(float))
    cost = np.ones(m)
    inverse = np.diag(1 / base.diagonal())
    for _ in range(PIVOTS):
        x = inverse @ rhs
        price = cost @ inverse
        worth = columns @ price
        k, low = int(worth.argmax()), int(price.argmin())
        if price[low] < -1e-9:  # a class is covered more than it need be
            enter, what = -np.eye(m)[low], 0.0
        elif worth[k] > 1 + 1e-9:
            enter, what = columns[k], 1.0
        else:
            enter, what = _knapsack(np.maximum(price, 0), sizes, cap), 1.0
            best = float(enter @ np.maximum(price, 0))
            bound = max(bound, float(need @ np.maximum(price, 0)) / best)
            if best <= 1 + 1e-9 or cost @ x <= bound * (1 + GAP):
                break
            columns = np.vstack([columns, enter])
        u = inverse @ enter
        up = np.flatnonzero(u > 1e-9)
        out = int(up[(x[up] / u[up]).argmin()])
        base[:, out], cost[out] = enter, what
        row = inverse[out] / u[out]
        inverse -= np.outer(u, row)
        inverse[out] = row
    x = np.maximum(inverse @ need, 0)
    return [(base[:, i].astype(int), float(x[i])) for i in range(m) if cost[i] and x[i] > 1e-9], bound


def best_fit(open_: list[tuple[int, list[int], int]], left: Counter, size: int) -> list[tuple[list[int], int]]:
    """Best-fit-decreasing over (free, lengths, multiplicity) groups of equal bins;
    returns (lengths, multiplicity). Works on groups, not on single pieces."""
    bins: dict[int, list[tuple[tuple[int, ...], int]]] = defaultdict(list)
    for free, lens, m in open_:
        if m:
            bins[free].append((tuple(lens), m))
    has = np.zeros(size + 1, bool)
    for f in bins:
        has[f] = True
    for length in sorted(left, reverse=True):
        n = left[length]
        while n:
            fits = np.flatnonzero(has[length:])
            if len(fits):
                free = length + int(fits[0])
                lens, m = bins[free].pop()
                if not bins[free]:
                    has[free] = False
                t = min(m, max(1, n // max(1, free // length)) if n >= free // length else 1)
                k = min(free // length, n // t)
                if m > t:
                    bins[free].append((lens, m - t))
                    has[free] = True
            else:
                lens, free = (), size
                k = min(size // length, n)
                t = n // k
            n -= k * t
            bins[free - k * length].append((lens + (length,) * k, t))
            has[free - k * length] = True
    return [(list(lens), m) for v in bins.values() for lens, m in v]


def plan(hist: dict[int, int], size: int = SIZE, grain: int = GRAIN) -> tuple[list[tuple[list[int], int]], float]:
    """(lengths of one sequence, how many such sequences), covering hist exactly, and
    the linear program's lower bound (of the length classes).

    With many lengths, one's class is the nearest multiple of the grain. Rounding deals
    real lengths to each configuration: the longest left of a class, and as its last
    piece the longest that still fits, at most two grains shorter than the gap. What no
    configuration takes that well is packed best fit, longest first."""
    stock = np.zeros(size + 1, np.int64)
    for length, n in hist.items():
        stock[length] = n
    grain = 1 if np.count_nonzero(stock) <= EXACT else grain
    klass = np.maximum(1, (np.arange(size + 1) + grain // 2) // grain)
    bound, dealt = 0.0, []

    def longest(low: int, high: int) -> int:
        """The longest length in stock from low to high, 0 if there is none."""
        at = np.flatnonzero(stock[max(low, 1) : high + 1])
        return max(low, 1) + int(at[-1]) if len(at) and high >= low else 0

    for solve in range(SOLVES):
        remain = np.bincount(klass, stock, size // grain + 1).astype(np.int64)
        sizes = np.flatnonzero(remain)
        if not len(sizes):
            break
        solution, least = configurations(sizes, remain[sizes], size // grain)
        bound = bound or least
        before = len(dealt)
        for uses, x in sorted(solution, key=lambda p: -p[1]):
            config = np.repeat(sizes, uses)[::-1].tolist()
            whole = int(x + 1e-6)
            m = min([whole if whole or not solve else int(x + 0.5), *(int(remain[c]) // k for c, k in Counter(config).items())])
            while m > 0:
                lens: list[int] = []
                for c in config[: None if grain == 1 else -1]:
                    n = longest(max(1, c * grain - grain // 2), min(c * grain + (grain - 1) // 2, size - sum(lens)))
                    if not n:
                        break
                    lens.append(n)
                    stock[n] -= 1
                free = size - sum(lens)
                if grain > 1:
                    n = longest(free - 2 * grain, free) if len(lens) == len(config) - 1 else 0
                for y in lens:
                    stock[y] += 1
                if not n:
                    break
                if grain > 1:
                    lens.append(n)
                t = min([m, *(int(stock[y]) // k for y, k in Counter(lens).items())])
                if t < 1:
                    break
                for y, k in Counter(lens).items():
                    stock[y] -= k * t
                    remain[klass[y]] -= k * t
                dealt.append((lens, t))
                m -= t
        if solve and len(dealt) == before:
            break
    left = Counter({int(n): int(stock[n]) for n in np.flatnonzero(stock)})
    return best_fit([(size - sum(v), v, m) for v, m in dealt], left, size), bound


def places(sequences: list[tuple[list[int], int]]) -> dict[int, np.ndarray]:
    """By length: rows (first rank, copies in a sequence, first sequence, offset of the first copy)."""
    rows: dict[int, list[tuple[int, int, int, int]]] = defaultdict(list)
    rank: Counter = Counter()
    seq = 0
    for lens, m in sequences:
        at = 0
        for length, k in sorted(Counter(lens).items(), reverse=True):
            rows[length].append((rank[length], k, seq, at))
            rank[length] += k * m
            at += k * length
        seq += m
    return {k: np.array(v, np.int64) for k, v in rows.items()}


def _place(book, total):
    def run(batches):
        for b in batches:
            length, rank = b.column("length").to_numpy(), b.column("rank").to_numpy()
            seq, off = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            for n in np.unique(length).tolist():
                on = np.flatnonzero(length == n)
                if n not in book.value:  # a full piece: a sequence of its own
                    seq[on] = total + rank[on]
                    continue
                p = book.value[n]
                i = np.searchsorted(p[:, 0], rank[on], "right") - 1
                r = rank[on] - p[i, 0]
                seq[on] = p[i, 2] + r // p[i, 1]
                off[on] = p[i, 3] + (r % p[i, 1]) * n
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")), pa.array(seq), pa.array(off)], ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return run


def ranked(spark: SparkSession, df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """df with ``rank``, from 0, of each row among the rows of its key. Rows are
    dealt by ranges of (key, order), so a key with most of the rows spans many tasks."""
    spread = (
        df.repartitionByRange(key, *order)
        .sortWithinPartitions(key, *order)
        .withColumn("_p", F.spark_partition_id())
        .withColumn("_i", F.monotonically_increasing_id() % (1 << 33))
        .checkpoint()
    )
    firsts = spread.groupBy("_p", key).agg(F.count("*").alias("n"), F.min("_i").alias("first")).collect()  # partitions + keys rows at most
    seen: Counter = Counter()
    rows = []
    for r in sorted(firsts, key=lambda r: (r["_p"])):
        rows.append((r["_p"], r[key], seen[r[key]] - r["first"]))
        seen[r[key]] += r["n"]
    if not rows:
        return spread.withColumn("rank", F.lit(0).cast("long")).drop("_p", "_i")
    base = spark.createDataFrame(rows, f"_p int, {key} long, _base long")
    return spread.join(F.broadcast(base), ["_p", key]).withColumn("rank", F.col("_i") + F.col("_base")).drop("_p", "_i", "_base")


def pack(spark: SparkSession, docs: DataFrame, path: str, size: int = SIZE, end: int = 1) -> DataFrame:
    """One row per piece of docs(doc_id, text): its place in the packed sequences."""
    prepare(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    pieces = table(spark, docs.mapInArrow(_pieces(path, size, end), "doc_id long, piece int, start long, length long, ids_crc32 long"), "pieces")
    hist = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most `size` rows
    hist.pop(size, None)
    sequences, _ = plan(hist, size)
    book = spark.sparkContext.broadcast(places(sequences))
    rank = ranked(spark, pieces, "length", ["doc_id", "piece"])
    return rank.mapInArrow(_place(book, sum(m for _, m in sequences)), "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def op10_configuration_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(spark, read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
