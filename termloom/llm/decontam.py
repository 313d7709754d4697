"""Benchmark decontamination: edit-distance search for item-sized windows.

A document is contaminated by an item of n words if one of its n-word windows is
within word edit distance floor(0.2 n) of it (words: ASCII-lower-cased runs of
letters, digits and non-ASCII bytes). A window may hang over a document's ends, each
word missing there counting as an edit: so leaks cut short are found. Items of fewer
than ``MIN_WORDS`` words are too short to tell a leak from chance and are matched
exactly. Items without words match nothing.

1. Regions. If a window is within k edits of an item, one of k + 1 equal blocks
   of the item stands in it unchanged; so only the neighbourhood of such blocks
   is looked at, and nothing is lost. Blocks are found by hash over whole texts.
2. CGK embedding. All n-word windows there walk through random bits: step j emits
   the current word and moves on if bit(j, word) is 1. Windows and items share the
   bits, so a small edit distance becomes a small Hamming distance.
3. Bit-sampling LSH. ``WALKS`` independent walks, each sampled ``TABLES`` times at
   ``SAMPLED`` positions, give the bucket keys; windows meet items of their length.
4. Candidates are verified by the exact (banded) edit distance.

Benchmarks are read in blocks of ``ITEMS`` items, each broadcast: its size is
bounded whatever the benchmark's size. Null or empty texts match nothing; items
with equal texts are all reported, repeated rows of the benchmark once; an item
without item_id is reported under a null item_id, and rows without doc_id keep a
null doc_id.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import U, groups, mix, prepare, read, span_hashes, text_buffer

ITEMS = 20_000
MIN_WORDS = 10
WALKS, TABLES, SAMPLED = 12, 6, 3
SHARE = 0.2

INK = np.zeros(256, bool)
INK[48:58] = INK[65:91] = INK[97:123] = INK[128:] = True
FOLD = np.arange(256, dtype=np.uint8)
FOLD[65:91] += 32


def word_hashes(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the rows' words, one after the other, and each row's offset in them."""
    n = len(data)
    if not n:
        return np.zeros(0, U), np.zeros(len(offs), np.int64)
    low = FOLD[data]
    ink = INK[low]
    cut = np.zeros(n + 1, bool)
    cut[offs] = True
    first, last = ink.copy(), ink.copy()
    first[1:] &= ~ink[:-1] | cut[1:n]
    last[:-1] &= ~ink[1:] | cut[1:n]
    starts = np.flatnonzero(first)
    return span_hashes(low, starts, np.flatnonzero(last) + 1), np.searchsorted(starts, offs)


def budget(n: int) -> int:
    """Edits allowed for an item of n words."""
    return int(SHARE * n + 1e-9) if n >= MIN_WORDS else 0


def grams(h: np.ndarray, q: int) -> np.ndarray:
    """Hash of each q consecutive words."""
    if len(h) < q:
        return np.zeros(0, U)
    g = np.zeros(len(h) - q + 1, U)
    for i in range(q):
        g *= U(0x9E3779B97F4A7C55)
        g += h[i : len(h) - q + 1 + i]
    return mix(g)


def _coin(walk: int, step: int, symbols: np.ndarray) -> np.ndarray:
    salt = U((walk * 1_000_003 + step * 7919 + 1) * 0x9E3779B97F4A7C15 % (1 << 64) | 1)
    x = symbols * salt
    return ((x ^ (x >> U(29))) * U(0xBF58476D1CE4E5B9) >> U(63)).astype(np.int64)


def cgk(windows: np.ndarray, walk: int) -> np.ndarray:
    """windows (m x n word hashes) embedded into m x 3n symbols; 0 pads past the end."""
    m, n = windows.shape
    padded = np.concatenate([windows, np.zeros((m, 1), U)], axis=1)
    at, rows = np.zeros(m, np.int64), np.arange(m)
    out = np.empty((m, 3 * n), U)
    for j in range(3 * n):
        s = padded[rows, at]
        out[:, j] = s
        at = np.minimum(at + _coin(walk, j, s), n)
    return out


def buckets(windows: np.ndarray) -> np.ndarray:
    """m x (WALKS * TABLES) LSH keys of equal-length windows."""
    m, n = windows.shape
    keys = np.empty((m, WALKS * TABLES), U)
    for w in range(WALKS):
        e = cgk(windows, w)
        rng = np.random.default_rng(977 * w + n)
        for t in range(TABLES):
            at = rng.choice(3 * n, SAMPLED, replace=False)
            k = np.full(m, U((w * TABLES + t + 1) * 0x9E3779B97F4A7C15 % (1 << 64)))
            for p in at:
                k = mix(k + e[:, p])
            keys[:, w * TABLES + t] = k
    return keys


def edit_distance(a: list[int], b: list[int], most: int) -> int:
    """Word edit distance, or most + 1 if it is larger; banded."""
    if a == b:
        return 0
    if abs(len(a) - len(b)) > most:
        return most + 1
    big = most + 1
    prev = {j: j for j in range(min(len(b), most) + 1)}
    for i, x in enumerate(a, 1):
        row = {}
        for j in range(max(0, i - most), min(len(b), i + most) + 1):
            row[j] = min(prev.get(j, big) + 1, row.get(j - 1, big) + 1, prev.get(j - 1, big) + (j == 0 or x != b[j - 1])) if j else i
        if min(row.values()) > most:
            return big
        prev = row
    return min(prev.get(len(b), big), big)


class Book:
    """A block of items, ready for lookup."""

    def __init__(self, ids: list, texts: list):
        data, offs = text_buffer(pa.array(texts, pa.string()))
        h, at = word_hashes(data, offs)
        self.items = [(ids[i], h[at[i] : at[i + 1]]) for i in range(len(ids)) if at[i + 1] > at[i]]
        blocks: dict[int, dict[int, list[tuple[int, int]]]] = {}
        by_size: dict[int, list[int]] = {}
        for x, (_, w) in enumerate(self.items):
            n, k = len(w), budget(len(w))
            q = n // (k + 1)
            for b in range(k + 1):
                key = int(grams(w[b * q : b * q + min(q, 8)], min(q, 8))[0])
                blocks.setdefault(min(q, 8), {}).setdefault(key, []).append((n, b * q))
            by_size.setdefault(n, []).append(x)
        self.blocks = {q: {k: sorted(set(v)) for k, v in d.items()} for q, d in blocks.items()}
        self.sieve = {}
        for q, d in self.blocks.items():
            bits = np.zeros(1 << 20, bool)
            bits[np.fromiter(d, U, len(d)) >> U(44)] = True
            self.sieve[q] = bits
        self.tables: dict[int, dict[int, list[int]]] = {}
        for n, xs in by_size.items():
            t = self.tables[n] = {}
            for x, row in zip(xs, buckets(np.stack([self.items[x][1] for x in xs])).tolist()):
                for key in row:
                    t.setdefault(key, []).append(x)

    def windows(self, h: np.ndarray, at: np.ndarray) -> dict[int, np.ndarray]:
        """By length: (row, first word) of all windows that hold an unchanged block of an
        item, those that hang over the row's ends by the edits allowed included."""
        found: dict[int, set[tuple[int, int]]] = {}
        for q, d in self.blocks.items():
            g = grams(h, q)
            near = np.flatnonzero(self.sieve[q][g >> U(44)])
            for p, key in zip(near.tolist(), g[near].tolist()):
                for n, o in d.get(key, ()):
                    row = int(np.searchsorted(at, p, "right")) - 1
                    k = budget(n)
                    first, end = int(at[row]), int(at[row + 1])
                    lo, hi = max(first - k, p - o - k), min(end - n + k, p - o + k)
                    if hi >= lo:
                        found.setdefault(n, set()).update((row, x) for x in range(lo, hi + 1))
        return {n: np.array(sorted(s), np.int64) for n, s in found.items()}

    def search(self, h: np.ndarray, at: np.ndarray) -> list[tuple[int, int, int, int, int]]:
        """(row, item, distance, first word, words): each row's best window per item."""
        best: dict[tuple[int, int], tuple[int, int, int]] = {}
        for n, found in self.windows(h, at).items():
            table, most = self.tables[n], budget(n)
            for lo in range(0, len(found), 4096):
                rows, part = found[lo : lo + 4096].T
                first, end = at[rows], at[rows + 1]
                place = part[:, None] + np.arange(n)
                inside = (place >= first[:, None]) & (place < end[:, None])
                w = np.where(inside, h[np.where(inside, place, 0)], U(0))  # no word hashes to 0
                starts, size = np.maximum(part, first) - first, inside.sum(axis=1)
                for r, p, m, x, keys in zip(rows.tolist(), starts.tolist(), size.tolist(), w, buckets(w).tolist()):
                    for item in {i for key in keys for i in table.get(key, ())}:
                        d = edit_distance(self.items[item][1].tolist(), x.tolist(), most)
                        if d <= most:
                            got = (d, p, m)
                            best[r, item] = min(best.get((r, item), got), got)
        return [(r, item, *v) for (r, item), v in sorted(best.items())]


def _found(book: Book, text: pa.Array):
    """(row, item_id, distance, first word, words) over a column of texts."""
    data, offs = text_buffer(text)
    for i, j in groups(offs):
        h, at = word_hashes(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i])
        for r, item, *rest in book.search(h, at):
            yield i + r, book.items[item][0], *rest


def _clean(book):
    def run(batches):
        for b in batches:
            keep = np.ones(b.num_rows, bool)
            keep[[r for r, *_ in _found(book.value, b.column("text"))]] = False
            yield b.filter(pa.array(keep))

    return run


def _search(book):
    def run(batches):
        for b in batches:
            out: list[list] = [[] for _ in range(5)]
            docs = b.column("doc_id")
            for r, *rest in _found(book.value, b.column("text")):
                for c, v in zip(out, (docs[r].as_py(), *rest)):
                    c.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], ["doc_id", "item_id", "distance", "first_word", "n_words"])

    return run


def _books(spark: SparkSession, benchmark: DataFrame):
    """The benchmark in broadcast blocks of about ITEMS items."""
    items = benchmark.where("text is not null").select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).distinct()
    blocks = -(-items.count() // ITEMS)
    numbered = items.withColumn("b", F.pmod(F.xxhash64("item_id", "text"), F.lit(max(1, blocks))))
    for b in range(blocks):
        rows = numbered.where(F.col("b") == b).orderBy("item_id", "text").collect()  # about ITEMS rows
        yield spark.sparkContext.broadcast(Book([r["item_id"] for r in rows], [r["text"] for r in rows]))


def contaminated(spark: SparkSession, docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, distance, first_word, n_words): the best window of each
    contaminated document for each item it holds."""
    prepare(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    out = spark.createDataFrame([], "doc_id long, item_id long, distance long, first_word long, n_words long")
    for b, book in enumerate(_books(spark, benchmark)):
        found = docs.mapInArrow(_search(book), out.schema)
        out = out.union(found) if b else found
    return out


def uncontaminated(spark: SparkSession, docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs, with all their columns, that hold no window of any item; by
    the same search, in one pass a block of items and without a shuffle."""
    prepare(spark)
    docs = docs.withColumn("text", F.col("text").cast("string"))
    for book in _books(spark, benchmark):
        docs = docs.mapInArrow(_clean(book), docs.schema)
    return docs


def op7_cgk_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(spark, read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
