"""Exact top-k inner-product search with the threshold algorithm.

Vectors are packed into blocks. Each block keeps, per dimension, its rows
sorted by component. For a query the lists are walked together, best end first
(the sign of the query's component chooses the end); a row met in any list is
scored in full by random access. With the walk at some depth, the sum of query
component times list value there bounds every unmet row, so the walk stops as
soon as that bound is below the kth score (a tie could still win by id).
A block's k best per query go on to one top-k over all blocks.

Queries are rows of the table themselves, taken in blocks: every vector block meets
every query block once, through an equi-join on the query block's number. Before
that, each query walks one block of the table; its kth score there is a floor that
all other walks start from, so blocks without better rows are left early.

Vectors that are null, or hold a null or non-finite component, take no part.
Shorter vectors count as padded with zeros. Rows with a null id take no part. Rows
that repeat an id are queries and candidates each; only a query's own row is left
out for it. Components or scores that could exceed a long raise an error.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from .common import prepare, read, table

BLOCK = 8192  # vectors of one block
QUERIES = 32_768  # queries of one query block
STEP = 32  # list entries of each dimension that one step of the walk reads


def _pack(most: int):
    """One row per ``most`` vectors of a partition: ids, row numbers, dims, integers as bytes."""

    def run(batches):
        ids: list[np.ndarray] = []
        nos: list[np.ndarray] = []
        vecs: list[np.ndarray] = []

        def out():
            m = max(v.shape[1] for v in vecs)
            full = np.concatenate([np.pad(v, ((0, 0), (0, m - v.shape[1]))) for v in vecs])
            cols = [pa.array([x.tobytes()], pa.binary()) for x in (np.concatenate(ids), np.concatenate(nos), full)]
            return pa.RecordBatch.from_arrays([*cols[:2], pa.array([m], pa.int32()), cols[2]], ["ids", "nos", "dims", "vals"])

        held = 0
        for b in batches:
            if not b.num_rows:
                continue
            v = b.column("v")
            size = np.diff(np.asarray(v.offsets))
            flat = v.flatten().to_numpy(zero_copy_only=False)
            m = int(size.max())
            dense = np.zeros((b.num_rows, m), np.int64)
            dense[np.arange(m) < size[:, None]] = flat
            ids.append(b.column("id").to_numpy())
            nos.append(b.column("no").to_numpy())
            vecs.append(dense)
            held += b.num_rows
            if held >= most:
                yield out()
                ids, nos, vecs, held = [], [], [], 0
        if held:
            yield out()

    return run


def _matrix(ids: bytes, nos: bytes, dims: int, vals: bytes, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    i = np.frombuffer(ids, np.int64)
    v = np.frombuffer(vals, np.int64).reshape(len(i), dims)
    return i, np.frombuffer(nos, np.int64), np.pad(v, ((0, 0), (0, width - dims)))


def threshold_topk(ids: np.ndarray, nos: np.ndarray, vecs: np.ndarray, q_nos: np.ndarray, queries: np.ndarray, k: int, floors: np.ndarray | None = None):
    """For each query its number and the k best (score desc, id asc) rows of one block
    but the row of its own number; of rows that cannot reach its floor, any number less."""
    n, d = vecs.shape
    order = np.argsort(vecs, axis=0, kind="stable").T.copy()  # row numbers, ascending by component
    ranked = np.take_along_axis(vecs, order.T, 0).T.copy()
    top = max(1, *(abs(int(f())) for f in (vecs.min, vecs.max))) * max(1, *(abs(int(f())) for f in (queries.min, queries.max))) * d
    if top >= 1 << 63:
        raise OverflowError(f"inner products of {d} components may exceed a long: scale the vectors down")
    kind = np.float64 if top < 1 << 53 else np.int64  # products are whole numbers: exact in doubles below 2**53
    table_, qs = vecs.astype(kind), queries.astype(kind)
    dims = np.arange(d)
    met = np.zeros(n, bool)
    floors = np.full(len(qs), np.iinfo(np.int64).min) if floors is None else floors
    for no, q, least in zip(q_nos.tolist(), qs, floors.tolist()):
        met[:] = False
        best_s, best_i = np.zeros(0, kind), np.zeros(0, np.int64)
        use = dims[q != 0] if (q != 0).any() else dims[:1]
        up = q[use] > 0
        depth = 0
        while depth < n:
            upto = min(n, depth + STEP)
            span = np.arange(depth, upto)
            at = np.where(up[:, None], n - 1 - span, span)
            rows = order[use[:, None], at].ravel()
            met_before = met[rows]
            rows = rows[~met_before]
            met[rows] = True
            rows = np.flatnonzero(np.bincount(rows, minlength=n)) if len(rows) > n // 4 else np.unique(rows)
            if len(rows):
                s, i = table_[rows] @ q, ids[rows]
                other = (nos[rows] != no) & (s >= least)
                s, i = s[other], i[other]
                best_s, best_i = np.concatenate([best_s, s]), np.concatenate([best_i, i])
                keep = np.lexsort((best_i, -best_s))[:k] if len(best_s) <= 4 * k else None
                if keep is None:
                    floor = np.partition(best_s, len(best_s) - k)[len(best_s) - k]
                    near = np.flatnonzero(best_s >= floor)
                    keep = near[np.lexsort((best_i[near], -best_s[near]))[:k]]
                best_s, best_i = best_s[keep], best_i[keep]
            depth = upto
            enough = max(least, int(best_s[k - 1])) if len(best_s) >= k else least
            edge = np.where(up, n - upto, upto - 1)
            if (ranked[use, edge].astype(kind) * q[use]).sum() < enough:
                break
        yield no, best_i, best_s


def _walks(row: dict, k: int, floors: np.ndarray | None):
    width = max(row["dims"], row["q_dims"])
    ids, nos, vecs = _matrix(row["ids"], row["nos"], row["dims"], row["vals"], width)
    q_ids, q_nos, qs = _matrix(row["q_ids"], row["q_nos"], row["q_dims"], row["q_vals"], width)
    return q_ids, threshold_topk(ids, nos, vecs, q_nos, qs, k, floors)


def _floors(k: int, block):
    """Each query's kth score in one broadcast block, least if the block has fewer rows."""

    def run(batches):
        for b in batches:
            for row in b.to_pylist():
                got = [int(s[k - 1]) if len(s) >= k else np.iinfo(np.int64).min for _, _, s in _walks(row | block.value, k, None)[1]]
                yield pa.RecordBatch.from_arrays([pa.array([row["qb"]], pa.int64()), pa.array([np.array(got, np.int64).tobytes()], pa.binary())], ["qb", "floors"])

    return run


def _search(k: int):
    def run(batches):
        for b in batches:
            for row in b.to_pylist():
                q_ids, walks = _walks(row, k, np.frombuffer(row["floors"], np.int64))
                got = list(walks)
                size = [len(g[1]) for g in got]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.repeat(q_ids, size)),
                        pa.array(np.repeat(np.array([g[0] for g in got], np.int64), size)),
                        pa.array(np.concatenate([g[1] for g in got])),
                        pa.array(np.concatenate([g[2] for g in got]).astype(np.int64)),
                    ],
                    ["query_id", "query_no", "vec_id", "score"],
                )

    return run


def exact_topk(spark: SparkSession, vectors: DataFrame, is_query: Column, k: int = 10, scale: int = 1024) -> DataFrame:
    """(query_id, rank, vec_id, score) over vectors(id, v); is_query: a condition on id."""
    prepare(spark)
    d = vectors.select(F.col("id").cast("long").alias("id"), F.transform("v", lambda x: x.cast("double")).alias("v"))
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    whole = d.where(F.col("id").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0) & fine)
    fits = F.forall("v", lambda x: F.abs(x * float(scale)) < float(1 << 62))
    scaled = F.when(fits, F.transform("v", lambda x: F.floor(x * float(scale)).cast("long"))).otherwise(F.raise_error(F.lit("a component exceeds a long")))
    rows = table(spark, whole.select("id", F.monotonically_increasing_id().alias("no"), scaled.alias("v")), "rows")
    shape = "ids binary, nos binary, dims int, vals binary"
    packed = table(spark, rows.mapInArrow(_pack(BLOCK), shape), "vectors")
    asked = rows.where(is_query).coalesce(max(1, rows.where(is_query).count() // QUERIES)).mapInArrow(_pack(QUERIES), shape)
    asked = asked.select(F.monotonically_increasing_id().alias("qb"), *(F.col(c).alias(f"q_{c}") for c in ("ids", "nos", "dims", "vals")))
    asked = table(spark, asked, "queries")
    first = packed.limit(1).collect()  # one block: BLOCK vectors
    if not first:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    block = spark.sparkContext.broadcast(first[0].asDict())
    floors = asked.mapInArrow(_floors(k, block), "qb long, floors binary")
    asked = table(spark, asked.join(floors, "qb"), "floors")
    # every vector block once per query block; the block numbers are 1 row per QUERIES queries
    numbers = F.lit([r.qb for r in asked.select("qb").collect()]).cast("array<long>")
    meet = packed.withColumn("qb", F.explode(F.array_sort(numbers)))
    pairs = meet.repartition("qb", "nos").join(asked, "qb")
    found = pairs.select("ids", "nos", "dims", "vals", "q_ids", "q_nos", "q_dims", "q_vals", "floors").mapInArrow(_search(k), "query_id long, query_no long, vec_id long, score long")
    w = Window.partitionBy("query_no").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op5_threshold_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    return exact_topk(spark, e, F.col("id") % 100 == 0, k=10)


OP5_SQL = """
WITH v AS MATERIALIZED (
  SELECT row_number() OVER () AS no, vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
  FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.no, q.vec_id AS query_id, c.vec_id,
         CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.no <> c.no WHERE q.vec_id % 100 = 0
), r AS (SELECT *, row_number() OVER (PARTITION BY no ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 10
"""
