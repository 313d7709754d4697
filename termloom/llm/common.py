"""Shared plumbing of the training-data operators: worker imports, scratch
tables in the cluster's shared folder, Arrow text buffers and 64-bit hashing."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

ROOT = str(Path(__file__).resolve().parents[2])
GROUP_BYTES = 1 << 18  # bytes of text that one vectorised step works on: its arrays stay small and near the cache


def prepare(spark: SparkSession) -> SparkSession:
    """Let workers import this package, bound Arrow batches, and make sure of a
    shared folder. ``spark.checkpoint.dir`` is used where the cluster names it; only a
    session on one machine may do without."""
    env = spark.sparkContext.environment
    if ROOT not in env.get("PYTHONPATH", "").split(":"):
        env["PYTHONPATH"] = ":".join(x for x in (ROOT, env.get("PYTHONPATH", "")) if x)
    env.setdefault("MALLOC_ARENA_MAX", "2")  # workers give memory of one stage back before the next
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(8 << 20))
    if not shared_dir(spark):
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="termloom-"))
    return spark


def shared_dir(spark: SparkSession) -> str | None:
    return spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()


def table(spark: SparkSession, df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: lineage ends here and a
    lost executor costs only a re-read."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_buffer(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column and the rows' offsets in them (null: empty)."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    col = pc.fill_null(col.cast(pa.large_string()), "")
    n = len(col)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offs, data = col.buffers()
    o = np.frombuffer(offs, np.int64)[col.offset : col.offset + n + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[o[0] : o[-1]], o - o[0]


def groups(offs: np.ndarray, limit: int = GROUP_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``limit`` bytes; a longer row is a range of its own."""
    i, n = 0, len(offs) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offs, offs[i] + limit, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


U = np.uint64
P = U(0x9E3779B97F4A7C55)
P_INV = U(pow(int(P), -1, 1 << 64))
_powers: list[np.ndarray] = [np.ones(1, U), np.ones(1, U)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """P**i and P**-i modulo 2**64 for i < n."""
    if len(_powers[0]) < n:
        for k, p in enumerate((P, P_INV)):
            full = np.full(n, p, U)
            full[0] = 1
            _powers[k] = np.multiply.accumulate(full)
    return _powers[0][:n], _powers[1][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix)."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of each data[start:end], equal for equal bytes wherever they stand."""
    n = len(data)
    if not len(starts):
        return np.zeros(0, U)
    pw, ipw = powers(n + 1)
    c = np.empty(n + 1, U)
    c[0] = 0
    np.cumsum((data.astype(U) + U(1)) * pw[:n], out=c[1:])
    return mix((c[ends] - c[starts]) * ipw[starts] + (ends - starts).astype(U) * U(0xD6E8FEB86659FD93))


SPACE = np.zeros(256, bool)
SPACE[[0x20, 9, 10, 11, 12, 13]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def words(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and first word of each row, for words ``[^\\x20\\x09-\\x0D]+``;
    no word crosses a row's end."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offs), np.int64)
    ink = ~SPACE[data]
    cut = np.zeros(n + 1, bool)
    cut[offs] = True
    gap = ~ink
    first = ink.copy()
    first[1:] &= gap[:-1] | cut[1:n]
    last = ink.copy()
    last[:-1] &= gap[1:] | cut[1:n]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offs)


def shingles(data: np.ndarray, offs: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct hashes of each row's k-word shingles (ASCII-lower-cased) and
    their offsets by row. With 1 to k-1 words the whole sequence is one shingle."""
    low = LOWER[data]
    starts, ends, at = words(low, offs)
    h = span_hashes(low, starts, ends)
    rows, n = len(offs) - 1, np.diff(at)
    odd = [U((0xA24BAED4963EE407 + 2 * i * 0x9FB21C651E98DF25) % (1 << 64) | 1) for i in range(k)]
    m = len(h)
    full = np.zeros(max(0, m - k + 1), U)
    for i in range(k):
        full += h[i : m - k + 1 + i] * odd[i] if m >= k else U(0)
    full = mix(full)
    row = np.repeat(np.arange(rows), n)[: len(full)]
    full_ok = (np.arange(len(full)) + k <= at[1:][row]) if len(full) else np.zeros(0, bool)
    vals, owner = full[full_ok], row[full_ok]
    few = np.flatnonzero((n > 0) & (n < k))
    if len(few):
        short = mix(np.array([np.add.reduce(h[at[r] : at[r + 1]] * np.array(odd[: n[r]], U)) for r in few.tolist()], U) + n[few].astype(U) * P)
        vals, owner = np.concatenate([vals, short]), np.concatenate([owner, few])
        order = np.argsort(owner, kind="stable")
        vals, owner = vals[order], owner[order]
    bound = np.searchsorted(owner, np.arange(rows + 1))
    for a, b in zip(bound[:-1].tolist(), bound[1:].tolist()):
        vals[a:b].sort()
    keep = np.ones(len(vals), bool)
    keep[1:] = (vals[1:] != vals[:-1]) | (owner[1:] != owner[:-1])
    total = np.concatenate([[0], np.cumsum(keep)])
    return vals[keep], total[bound]


def runs(batches: Iterator[pa.RecordBatch], key: list[str], rows: int = 1 << 16) -> Iterator[pa.Table]:
    """Regroup batches sorted by ``key`` so that no key is split between tables;
    a table has about ``rows`` rows, or one key."""
    held: list[pa.RecordBatch] = []
    count = 0

    def changes(t: pa.Table) -> np.ndarray:
        diff = np.zeros(max(0, t.num_rows - 1), bool)
        for c in key:
            v = t[c].to_numpy()
            diff |= v[1:] != v[:-1]
        return np.flatnonzero(diff) + 1

    for b in batches:
        if not b.num_rows:
            continue
        held.append(b)
        count += b.num_rows
        if count >= rows:
            t = pa.Table.from_batches(held)
            cuts = changes(t)
            if len(cuts):
                yield t.slice(0, int(cuts[-1]))
                held = t.slice(int(cuts[-1])).to_batches()
                count = t.num_rows - int(cuts[-1])
    if held:
        yield pa.Table.from_batches(held)


def key_bounds(t: pa.Table, key: list[str]) -> np.ndarray:
    """Offsets at which a new key begins in a table sorted by it, and its length."""
    n = t.num_rows
    diff = np.zeros(n + 1, bool)
    diff[[0, n]] = True
    for c in key:
        v = t[c].to_numpy()
        diff[1:n] |= v[1:] != v[:-1]
    return np.flatnonzero(diff)
