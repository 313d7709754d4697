"""Token-id files as wavelet matrices.

Documents are range-partitioned by doc_id, encoded, closed by an end id and cut
into files of about ``FILE_TOKENS`` tokens at document ends. A file holds the
sorted alphabet it uses, its documents' ids and lengths, and one bit-plane per
level of the wavelet matrix with a rank directory. Access, counting, occurrence
lookup (rank and select) and full decoding all work on the file's bytes.

Files are rows (part, before, n_tokens, payload) of a Parquet table in the
cluster's shared folder, so any store Spark writes to will do; ``before`` counts
the tokens of earlier files in the same part, and a row per part gives the rest.

File format, little-endian: magic ``TWM1``; u32 alphabet size, documents, levels;
u64 tokens; u32 alphabet; i64 doc ids; u8 null marks; u32 lengths; then per level
u64 zeros, u32 ones before each 512-bit block, and the bits (padded to 64 bytes).
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import prepare, read, table
from .tokens import encoder

MAGIC = b"TWM1"
BLOCK_BITS = 512
FILE_TOKENS = 1 << 20


class WaveletMatrix:
    """A sequence of symbols with access, rank, select and range counting."""

    def __init__(self, alphabet: np.ndarray, n: int, zeros: list[int], planes: list[np.ndarray], ones: list[np.ndarray]):
        self.alphabet, self.n, self.zeros, self.planes, self.ones = alphabet, n, zeros, planes, ones
        self.levels = len(planes)

    @classmethod
    def build(cls, symbols: np.ndarray) -> WaveletMatrix:
        present = np.bincount(symbols) if len(symbols) else np.zeros(0, np.int64)
        alphabet = np.flatnonzero(present).astype(np.uint32)
        code = np.zeros(len(present), np.uint16 if len(alphabet) <= 1 << 16 else np.uint32)
        code[alphabet] = np.arange(len(alphabet))
        a = code[symbols]
        levels = max(1, int(len(alphabet) - 1).bit_length()) if len(alphabet) else 0
        zeros, planes, ones = [], [], []
        for level in range(levels):
            bit = (a & a.dtype.type(1 << (levels - 1 - level))) != 0
            low = a[~bit]
            zeros.append(len(low))
            a = np.concatenate([low, a[bit]])
            plane = np.packbits(bit, bitorder="little")
            plane = np.pad(plane, (0, -len(plane) % (BLOCK_BITS // 8)))
            planes.append(plane)
            ones.append(cls._directory(plane))
        return cls(alphabet, len(symbols), zeros, planes, ones)

    @staticmethod
    def _directory(plane: np.ndarray) -> np.ndarray:
        count = np.bitwise_count(plane.view(np.uint64)).reshape(-1, BLOCK_BITS // 64).sum(axis=1)
        return np.concatenate([[0], np.cumsum(count)]).astype(np.uint32)

    def _bit(self, level: int, i: int) -> int:
        return int(self.planes[level][i >> 3]) >> (i & 7) & 1

    def _rank1(self, level: int, i: int) -> int:
        """Ones among the first i bits of a level."""
        block = i // BLOCK_BITS
        head = int(self.ones[level][block])
        part = self.planes[level][block * (BLOCK_BITS // 8) : (i + 7) // 8]
        if i % 8 and len(part):
            part = part.copy()
            part[-1] &= (1 << (i % 8)) - 1
        return head + int(np.bitwise_count(part).sum())

    def _select(self, level: int, bit: int, k: int) -> int:
        """Position of the k-th (from 0) bit of that value on a level."""
        if bit:
            block = int(np.searchsorted(self.ones[level], k, "right")) - 1
            left = k - int(self.ones[level][block])
        else:
            before = np.arange(len(self.ones[level])) * BLOCK_BITS - self.ones[level].astype(np.int64)
            block = int(np.searchsorted(before, k, "right")) - 1
            left = k - int(before[block])
        step = BLOCK_BITS // 8
        bits = np.unpackbits(self.planes[level][block * step : (block + 1) * step], bitorder="little")
        return block * BLOCK_BITS + int(np.flatnonzero(bits == bit)[left])

    def _code(self, symbol: int) -> int | None:
        i = int(np.searchsorted(self.alphabet, symbol))
        return i if i < len(self.alphabet) and self.alphabet[i] == symbol else None

    def access(self, i: int) -> int:
        code = 0
        for level in range(self.levels):
            b, r = self._bit(level, i), self._rank1(level, i)
            i = self.zeros[level] + r if b else i - r
            code = code << 1 | b
        return int(self.alphabet[code])

    def _range(self, code: int, a: int, z: int) -> tuple[int, int]:
        for level in range(self.levels):
            p, q = self._rank1(level, a), self._rank1(level, z)
            if code >> (self.levels - 1 - level) & 1:
                a, z = self.zeros[level] + p, self.zeros[level] + q
            else:
                a, z = a - p, z - q
        return a, z

    def count(self, symbol: int, a: int = 0, z: int | None = None) -> int:
        """Occurrences of a symbol in positions a to z - 1."""
        code = self._code(symbol)
        if code is None:
            return 0
        p, q = self._range(code, a, self.n if z is None else z)
        return q - p

    def rank(self, symbol: int, i: int) -> int:
        return self.count(symbol, 0, i)

    def select(self, symbol: int, k: int) -> int:
        """Position of the k-th occurrence, from 0."""
        code = self._code(symbol)
        if code is None or not 0 <= k < self.count(symbol):
            raise IndexError(k)
        i = self._range(code, 0, self.n)[0] + k
        for level in range(self.levels - 1, -1, -1):
            b = code >> (self.levels - 1 - level) & 1
            i = self._select(level, b, i - self.zeros[level] if b else i)
        return i

    def occurrences(self, symbol: int) -> list[int]:
        return [self.select(symbol, k) for k in range(self.count(symbol))]

    def decode(self) -> np.ndarray:
        """All symbols in order, from the last plane up."""
        if not self.n:
            return np.zeros(0, np.uint32)
        v = np.zeros(self.n, np.uint16 if self.levels <= 16 else np.uint32)
        for level in range(self.levels - 1, -1, -1):
            bit = np.unpackbits(self.planes[level], count=self.n, bitorder="little").view(bool)
            up = np.empty_like(v)
            z = self.zeros[level]
            up[~bit] = v[:z]
            up[bit] = v[z:] | v.dtype.type(1 << (self.levels - 1 - level))
            v = up
        return self.alphabet[v]


def write_file(doc_ids: list[int | None], lengths: np.ndarray, tokens: np.ndarray) -> bytes:
    w = WaveletMatrix.build(tokens)
    out = [MAGIC, struct.pack("<IIIQ", len(w.alphabet), len(doc_ids), w.levels, w.n), w.alphabet.astype("<u4").tobytes()]
    out += [np.array([d or 0 for d in doc_ids], "<i8").tobytes(), np.array([d is None for d in doc_ids], np.uint8).tobytes(), lengths.astype("<u4").tobytes()]
    for z, plane, ones in zip(w.zeros, w.planes, w.ones):
        out += [struct.pack("<Q", z), ones.astype("<u4").tobytes(), plane.tobytes()]
    return b"".join(out)


def read_file(payload: bytes) -> tuple[list[int | None], np.ndarray, WaveletMatrix]:
    """Document ids, their lengths, and the matrix, without decoding it."""
    if payload[:4] != MAGIC:
        raise ValueError("not a token file")
    k, docs, levels, n = struct.unpack_from("<IIIQ", payload, 4)
    at = 24

    def take(kind: str, count: int) -> np.ndarray:
        nonlocal at
        x = np.frombuffer(payload, kind, count, at)
        at += x.nbytes
        return x

    alphabet, ids, null, lens = take("<u4", k), take("<i8", docs), take("u1", docs), take("<u4", docs)
    zeros, planes, ones = [], [], []
    blocks = -(-n // BLOCK_BITS)
    for _ in range(levels):
        zeros.append(int(take("<u8", 1)[0]))
        ones.append(take("<u4", blocks + 1))
        planes.append(take("u1", blocks * BLOCK_BITS // 8))
    return [None if x else i for i, x in zip(ids.tolist(), null.tolist())], lens, WaveletMatrix(alphabet, n, zeros, planes, ones)


def _encode(path: str, end: int):
    def run(batches):
        part, before = TaskContext.get().partitionId(), 0
        ids: list = []
        lens: list[np.ndarray] = []
        toks: list[np.ndarray] = []
        held = 0

        def out():
            return pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int32()), pa.array([before], pa.int64()), pa.array([held], pa.int64()), pa.array([write_file(ids, np.concatenate(lens), np.concatenate(toks))], pa.large_binary()).cast(pa.binary())],
                ["part", "before", "n_tokens", "payload"],
            )

        for b in batches:
            if not b.num_rows:
                continue
            tok, at = encoder(path).encode(b.column("text"))
            rows = b.num_rows
            closed = np.insert(tok, at[1:], np.uint16(end))
            bound = at + np.arange(rows + 1)
            docs = b.column("doc_id").to_pylist()
            r = 0
            while r < rows:
                e = max(r + 1, int(np.searchsorted(bound, bound[r] + FILE_TOKENS - held, "right")) - 1)
                e = min(e, rows)
                ids += docs[r:e]
                lens.append(np.diff(bound[r : e + 1]))
                toks.append(closed[bound[r] : bound[e]])
                held += int(bound[e] - bound[r])
                r = e
                if held >= FILE_TOKENS or r < rows:
                    yield out()
                    before += held
                    ids, lens, toks, held = [], [], [], 0
        if held:
            yield out()

    return run


def _digests(batches):
    for b in batches:
        for base, before, payload in zip(b.column("base").to_pylist(), b.column("before").to_pylist(), b.column("payload")):
            ids, lens, w = read_file(payload.as_buffer().to_pybytes())
            raw = w.decode().astype("<u4")
            ends = np.cumsum(lens, dtype=np.int64)
            starts = ends - lens
            crc = [zlib.crc32(raw[a:z]) for a, z in zip(starts.tolist(), ends.tolist())]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(starts + base + before), pa.array(lens.astype(np.int64)), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])


def write_tokens(spark: SparkSession, docs: DataFrame, path: str, end: int = 2) -> DataFrame:
    """Encode docs(doc_id, text) into token files; returns the table of files."""
    prepare(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    ordered = docs.repartitionByRange("doc_id").sortWithinPartitions("doc_id")
    return table(spark, ordered.mapInArrow(_encode(path, end), "part int, before long, n_tokens long, payload binary"), "token-files")


def read_tokens(spark: SparkSession, files: DataFrame) -> DataFrame:
    """Per document, decoded from the files: where its ids start, how many, their CRC-32."""
    totals = sorted((r["part"], r["n"]) for r in files.groupBy("part").agg(F.sum("n_tokens").alias("n")).collect())  # a row per partition
    rows, n = [], 0
    for p, k in totals:
        rows.append((p, n))
        n += k
    base = spark.createDataFrame(rows, "part int, base long")
    return files.join(F.broadcast(base), "part").select("base", "before", "payload").mapInArrow(_digests, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op6_wavelet_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return read_tokens(spark, write_tokens(spark, read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json")))
