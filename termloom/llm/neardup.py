"""MinHash near-duplicate detection.

Pass 1 turns each text into its set of k-word shingles (64-bit hashes), a
128-bit fingerprint of the set and ``HASHES`` universal-hash minima. Documents
with one fingerprint form a class; only its least doc_id goes on. The first
``BANDS * ROWS`` minima give the band keys; one byte of every minimum is the
signature that candidates are verified by.
Pass 2 finds each bucket's most popular class (the one that shares most buckets:
the base of a group of copies) and lets a class meet the LEADS most popular of
its buckets, a star and not all pairs; a pair must pass the signature estimate and
then the threshold on full sets. Large-star/small-star gives components.
Pass 3 takes the buckets whose classes still lie in several components (of buckets
with the same classes only one). Classes outside the bucket's largest component are
its guests. Guests and members are dealt to cells of bounded size, and every guest
meets every member of another component in one cell. A pair is looked at in the first
band it shares only. Classes with a partner that passes the estimate go on with their
full sets; their cell counts all intersections exactly and gives back only links that
join two components, fewer than it has classes. So every pair that shares a bucket is
either tested or already connected, and rows out grow with classes, not with pairs.

With 4 rows and 24 bands a pair at similarity 0.85 shares no bucket with
probability 2e-8 (0.8: 4e-6); the estimate from 512 minima is allowed an error
of 0.075, over four standard deviations.

Full sets are computed again only for classes in some candidate pair. A bitmap
of their ids, never above ``BITMAP`` bits, lets the other texts pass by unread
before any shuffle; what it lets through in error falls out in the join.

Nulls: null text is an empty set, linked with nothing. Rows without doc_id are
returned with a null component and kept. Rows that repeat a doc_id are one node.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from .common import U, groups, key_bounds, mix, prepare, read, runs, shingles, table, text_buffer
from .components import connected_components

BANDS, ROWS = 24, 4
HASHES = 512
SLACK = 0.075
SALT = np.array([0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], U)
BLOCK = 2048  # classes on either side of a cell
WEIGHT = 1 << 19  # shingles on either side of a cell
COMMON = 32  # classes of a cell that hold a shingle, from which its column is dense
LEADS = 2  # most popular classes a class is first compared with
BITMAP = 1 << 27  # bits: 16 MB


def _coefficients() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20240229)
    return rng.integers(0, 1 << 63, HASHES, dtype=U) * U(2) + U(1), rng.integers(0, 1 << 63, HASHES, dtype=U)


A, B = _coefficients()


def signatures(vals: np.ndarray, bound: np.ndarray) -> np.ndarray:
    """rows x HASHES minima of universal hashes (multiply, add, upper 32 bits)."""
    out = np.zeros((len(bound) - 1, HASHES), np.uint32)
    some = np.flatnonzero(np.diff(bound))
    if len(some):
        at = bound[some]
        for k in range(HASHES):
            h = vals * A[k]
            h += B[k]
            h >>= U(32)
            out[some, k] = np.minimum.reduceat(h, at)
    return out


def _band_keys(sig: np.ndarray) -> np.ndarray:
    rows = sig[:, : BANDS * ROWS].reshape(-1, BANDS, ROWS).astype(U)
    key = np.broadcast_to(mix(np.arange(1, BANDS + 1, dtype=U)), rows.shape[:2]).copy()
    for r in range(ROWS):
        key = mix(key * U(0x9E3779B97F4A7C15) + rows[:, :, r])
    return key


def _profile(k: int):
    def run(batches):
        for b in batches:
            data, offs = text_buffer(b.column("text"))
            ids = b.column("doc_id")
            for i, j in groups(offs):
                vals, bound = shingles(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i], k)
                n = np.diff(bound)
                sums = np.zeros((2, len(n)), U)
                some = np.flatnonzero(n)
                if len(some):
                    for q in (0, 1):
                        sums[q, some] = np.add.reduceat(mix(vals + SALT[q]), bound[some])
                sig = signatures(vals, bound)
                packed = np.concatenate([_band_keys(sig).view(np.uint8), sig.astype(np.uint8)], axis=1)
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(i, j - i), pa.array(n), pa.array(sums[0].view(np.int64)), pa.array(sums[1].view(np.int64)), pa.array([x.tobytes() for x in packed], pa.binary())],
                    ["doc_id", "n", "f1", "f2", "sig"],
                )

    return run


def _unpacked(column) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, 8 * BANDS + HASHES)


def _bands(batches):
    for b in batches:
        if b.num_rows:
            keys = np.ascontiguousarray(_unpacked(b.column("sig"))[:, : 8 * BANDS]).view(np.int64)
            n, rep = (np.repeat(b.column(c).to_numpy(), BANDS) for c in ("n", "rep"))
            yield pa.RecordBatch.from_arrays([pa.array(keys.reshape(-1)), pa.array(np.tile(np.arange(BANDS, dtype=np.int32), b.num_rows)), pa.array(rep), pa.array(n)], ["key", "band", "rep", "n"])


def _bit(ids: np.ndarray, bits: int) -> np.ndarray:
    return (mix(ids.view(U)) & U(bits - 1)).astype(np.int64)


def _sets(k: int, wanted):
    """Sets of the documents whose id's bit is set."""

    def run(batches):
        bits = np.unpackbits(wanted.value, bitorder="little").view(bool)
        for b in batches:
            ids = b.column("doc_id").to_numpy()
            b = b.filter(pa.array(bits[_bit(ids, len(bits))]))
            data, offs = text_buffer(b.column("text"))
            for i, j in groups(offs):
                vals, bound = shingles(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i], k)
                yield pa.RecordBatch.from_arrays(
                    [b.column("doc_id").slice(i, j - i), pa.array([vals[x:y].tobytes() for x, y in zip(bound[:-1].tolist(), bound[1:].tolist())], pa.binary())],
                    ["id", "hashes"],
                )

    return run


def _estimate(floor: float):
    def run(batches):
        for b in batches:
            if b.num_rows:
                x, y = (_unpacked(b.column(c))[:, 8 * BANDS :] for c in ("sig_u", "sig_v"))
                ok = (x == y).mean(axis=1) >= floor
                yield pa.RecordBatch.from_arrays([pa.array(b.column(c).to_numpy()[ok]) for c in ("u", "v")], ["u", "v"])

    return run


def _exact(percent: int):
    def run(batches):
        for b in batches:
            us, vs = [], []
            for u, v, x, y in zip(*(b.column(c).to_pylist() for c in ("u", "v", "hu", "hv"))):
                p, q = np.frombuffer(x, U), np.frombuffer(y, U)
                if 100 * min(len(p), len(q)) < percent * max(len(p), len(q)) or not len(p):
                    continue
                both = len(np.intersect1d(p, q, assume_unique=True))
                if 100 * both >= percent * (len(p) + len(q) - both):
                    us.append(u)
                    vs.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(us, pa.int64()), pa.array(vs, pa.int64())], ["u", "v"])

    return run


MAJOR, MINOR, GUEST = range(3)  # members of a bucket's largest component, other members, guests


def _partnered(floor: float):
    """Rows of each (key, cell) that have a partner of another component which passes
    the estimate and shares no earlier band."""

    def run(batches):
        for t in runs(batches, ["key", "cell"], 4096):
            at = key_bounds(t, ["key", "cell"])
            rep, comp, role, band = (t[c].to_numpy() for c in ("rep", "comp", "role", "band"))
            packed = _unpacked(t["sig"])
            keys, sig = np.ascontiguousarray(packed[:, : 8 * BANDS]).view(np.int64), packed[:, 8 * BANDS :]
            some = np.zeros(len(rep), bool)
            for a, z in zip(at[:-1].tolist(), at[1:].tolist()):
                own = np.flatnonzero(role[a:z] != GUEST) + a
                early = np.ascontiguousarray(keys[own, : band[a]])
                for x in (np.flatnonzero(role[a:z] == GUEST) + a).tolist():
                    may = (comp[own] != comp[x]) & ((role[own] == MAJOR) | (rep[own] > rep[x]))
                    may[may] = ~(early[may] == keys[x, : band[a]]).any(axis=1)
                    ys = own[may]
                    ys = ys[(sig[ys] == sig[x]).mean(axis=1) >= floor] if len(ys) else ys
                    some[ys] = True
                    some[x] |= len(ys) > 0
            if some.any():
                yield pa.RecordBatch.from_arrays([pa.array(t[c].to_numpy()[some]) for c in ("key", "cell", "rep", "comp", "role")], ["key", "cell", "rep", "comp", "role"])

    return run


def shared_counts(sets: list[np.ndarray], guests: np.ndarray, own: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of the sets of guests and own (row numbers):
    by matrix product for common elements, by pairs for those of few sets."""
    owner = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    code, freq = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)[1:]
    out = np.zeros((len(guests), len(own)), np.float32)
    common = np.flatnonzero(freq > COMMON)
    column = np.full(len(freq), -1)
    for lo in range(0, len(common), 1024):
        part = common[lo : lo + 1024]
        column[part] = np.arange(len(part))
        on = np.flatnonzero(column[code] >= 0)
        dense = np.zeros((len(sets), len(part)), np.float32)
        dense[owner[on], column[code[on]]] = 1
        out += dense[guests] @ dense[own].T
        column[part] = -1
    row, col = (np.full(len(sets), -1) for _ in range(2))
    row[guests], col[own] = np.arange(len(guests)), np.arange(len(own))
    few = np.flatnonzero((freq[code] <= COMMON) & (freq[code] > 1))
    few = few[np.argsort(code[few], kind="stable")]
    c, o = code[few], owner[few]
    flat = out.reshape(-1)
    for d in range(1, COMMON):
        same = np.flatnonzero(c[d:] == c[:-d])
        if not len(same):
            break
        for x, y in ((o[same], o[same + d]), (o[same + d], o[same])):
            on = (row[x] >= 0) & (col[y] >= 0)
            at, n = np.unique(row[x[on]] * len(own) + col[y[on]], return_counts=True)
            flat[at] += n
    return out


def _joining(percent: int):
    """Links of each (key, cell) that join components, none twice."""

    def run(batches):
        for t in runs(batches, ["key", "cell"], 1):
            at = key_bounds(t, ["key", "cell"])
            us, vs = [], []
            for a, z in zip(at[:-1].tolist(), at[1:].tolist()):
                part = t.slice(a, z - a)
                rep, comp, role = (part[c].to_numpy() for c in ("rep", "comp", "role"))
                sets = [np.frombuffer(x.as_buffer(), U) for c in part["hashes"].chunks for x in c]
                guests, own = np.flatnonzero(role == GUEST), np.flatnonzero(role != GUEST)
                if not len(guests) or not len(own):
                    continue
                n = np.array([len(x) for x in sets])
                both = shared_counts(sets, guests, own).astype(np.int64)
                i, j = np.nonzero(100 * both >= percent * (n[guests][:, None] + n[own] - both))
                i, j = guests[i], own[j]
                p, q = np.minimum(comp[i], comp[j]), np.maximum(comp[i], comp[j])
                once = np.unique(np.stack([p, q]), axis=1, return_index=True)[1] if len(p) else []
                root: dict[int, int] = {}

                def top(x):
                    while root.get(x, x) != x:
                        x = root[x]
                    return x

                for k in once:
                    x, y = sorted((top(int(p[k])), top(int(q[k]))))
                    if x != y:
                        root[y] = x
                        us.append(min(rep[i[k]], rep[j[k]]))
                        vs.append(max(rep[i[k]], rep[j[k]]))
            if us:
                yield pa.RecordBatch.from_arrays([pa.array(us, pa.int64()), pa.array(vs, pa.int64())], ["u", "v"])

    return run


def _bitmap(spark: SparkSession, ids: DataFrame):
    """A broadcast bitmap of ids: 16 bits an id, BITMAP bits at most."""
    n = max(1, ids.count())
    bits = min(BITMAP, 1 << max(15, (16 * n - 1).bit_length()))

    def place(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array(_bit(b.column("id").to_numpy(), bits))], ["at"])

    chunk = 1 << 15
    at = ids.mapInArrow(place, "at long").select(F.expr(f"at div {chunk}").alias("c"), (F.col("at") % chunk).alias("o"))
    out = np.zeros(bits // 8, np.uint8)
    for r in at.groupBy("c").agg(F.bitmap_construct_agg("o").alias("m")).collect():  # BITMAP bits at most
        out[r["c"] * chunk // 8 : (r["c"] + 1) * chunk // 8] = np.frombuffer(r["m"], np.uint8)[: chunk // 8]
    return spark.sparkContext.broadcast(out)


def near_duplicates(spark: SparkSession, docs: DataFrame, shingle: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of docs(doc_id, text)."""
    prepare(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    floor = percent / 100 - SLACK
    prof = table(spark, docs.mapInArrow(_profile(shingle), "doc_id long, n long, f1 long, f2 long, sig binary"), "profiles")
    classes = table(
        spark,
        prof.where("n > 0 and doc_id is not null").groupBy("f1", "f2", "n").agg(F.min("doc_id").alias("rep"), F.min("sig").alias("sig")),
        "classes",
    )
    sigs = classes.select("rep", "sig")
    banded = table(spark, classes.select("rep", "n", "sig").mapInArrow(_bands, "key long, band int, rep long, n long"), "bands")
    size = banded.groupBy("key").agg(F.count("*").alias("size")).where("size > 1")
    popular = banded.join(size, "key").checkpoint()  # only classes that share a bucket
    score = popular.groupBy("rep").agg(F.sum("size").alias("score"))
    scored = popular.join(score, "rep")
    best = F.max(F.struct("score", (-F.col("rep")).alias("rep")))
    leads = scored.groupBy("key").agg(best.alias("b")).select("key", F.col("b.score").alias("score"), (-F.col("b.rep")).alias("lead"))
    # a class meets the most popular leads of its (at most BANDS) buckets
    met = popular.join(leads, "key").where("rep <> lead").groupBy("rep", "lead").agg(F.first("score").alias("score"))
    order = Window.partitionBy("rep").orderBy(F.desc("score"), "lead")
    met = met.withColumn("n", F.row_number().over(order)).where(F.col("n") <= LEADS)
    stars = met.select(F.least("lead", "rep").alias("u"), F.greatest("lead", "rep").alias("v")).distinct().checkpoint()

    def sets_of(ids: DataFrame) -> DataFrame:
        ids = ids.distinct().checkpoint()
        found = docs.where("doc_id is not null").mapInArrow(_sets(shingle, _bitmap(spark, ids)), "id long, hashes binary")
        return table(spark, found.join(ids, "id", "left_semi").distinct(), "sets")

    s = stars.join(sigs.select(F.col("rep").alias("u"), F.col("sig").alias("sig_u")), "u").join(sigs.select(F.col("rep").alias("v"), F.col("sig").alias("sig_v")), "v")
    near = s.select("u", "v", "sig_u", "sig_v").mapInArrow(_estimate(floor), "u long, v long").checkpoint()
    sets = sets_of(near.select(F.explode(F.array("u", "v")).alias("id")))
    full = near.join(sets.select(F.col("id").alias("u"), F.col("hashes").alias("hu")), "u").join(sets.select(F.col("id").alias("v"), F.col("hashes").alias("hv")), "v")
    links = full.select("u", "v", "hu", "hv").mapInArrow(_exact(percent), "u long, v long").distinct().checkpoint()
    comp = connected_components(links)
    parted = popular.join(comp.withColumnRenamed("node", "rep"), "rep", "left").select("key", "band", "rep", "n", F.coalesce("component", "rep").alias("comp"))
    counts = parted.groupBy("key", "band", "comp").agg(F.count("*").alias("m"), F.sum("n").alias("n"), F.sum(F.xxhash64("rep").cast("decimal(38,0)")).alias("who"))
    total = counts.groupBy("key", "band").agg(
        F.max_by("comp", F.struct("m", "comp")).alias("major"), F.max("m").alias("most"), F.max_by("n", F.struct("m", "comp")).alias("major_n"),
        F.count("*").alias("comps"), F.sum("m").alias("m"), F.sum("n").alias("n"), F.sum("who").alias("who"),
    )

    def blocks(m, n):
        return F.greatest(F.ceil(m / F.lit(BLOCK)), F.ceil(n / F.lit(WEIGHT)))

    # of buckets with the same classes the one of the first band
    open_ = total.where("comps > 1").groupBy("who", "m", "n").agg(F.min_by(F.struct("key", "major", "most", "major_n"), "band").alias("b")).select("b.*", "m", "n")
    open_ = open_.select("key", "major", blocks(F.col("m"), F.col("n")).alias("nb"), blocks(F.col("m") - F.col("most"), F.col("n") - F.col("major_n")).alias("ng"))
    members = parted.join(open_, "key").checkpoint()
    if not members.isEmpty():
        upto = lambda c: F.explode(F.sequence(F.lit(0).cast("long"), F.col(c) - 1))
        own = members.withColumns({"g": upto("ng"), "m": F.pmod(F.xxhash64("rep"), "nb"), "role": F.when(F.col("comp") == F.col("major"), MAJOR).otherwise(MINOR)})
        guests = members.where("comp <> major").withColumns({"m": upto("nb"), "g": F.pmod(F.xxhash64("rep", F.lit(1)), "ng"), "role": F.lit(GUEST)})
        met = own.unionByName(guests).select("key", "band", "rep", "comp", "role", (F.col("g") * F.col("nb") + F.col("m")).alias("cell"))
        met = met.join(sigs, "rep").repartition("key", "cell").sortWithinPartitions("key", "cell")
        some = table(spark, met.mapInArrow(_partnered(floor), "key long, cell long, rep long, comp long, role int"), "partnered")
        if not some.isEmpty():
            sets = sets_of(some.select(F.col("rep").alias("id")))
            held = some.join(sets.withColumnRenamed("id", "rep"), "rep").repartition("key", "cell").sortWithinPartitions("key", "cell")
            more = held.mapInArrow(_joining(percent), "u long, v long").distinct().checkpoint()
            if not more.isEmpty():
                comp = connected_components(links.union(more))
    named = classes.join(comp, F.col("rep") == F.col("node"), "left").select("f1", "f2", "n", F.coalesce("component", "rep").alias("component_id"))
    out = prof.select("doc_id", "n", "f1", "f2").join(named, ["f1", "f2", "n"], "left")
    cid = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), cid.alias("component_id"), F.coalesce(F.col("doc_id") == cid, F.lit(True)).alias("kept"))


def op2_minhash_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark, read(spark, sf_dir, "documents"), shingle=3, percent=85)


OP2_SQL = """
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents
), s AS (
  SELECT doc_id, list_distinct(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 3 THEN [array_to_string(ws, ' ')]
    ELSE list_transform(generate_series(1, len(ws) - 2), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2]) END) AS sh FROM w
), n AS (SELECT doc_id, CAST(len(sh) AS BIGINT) AS n FROM s),
e AS (SELECT doc_id, unnest(sh) AS x FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM e a JOIN e b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n x ON a = x.doc_id JOIN n y ON b = y.doc_id WHERE 100 * k >= 85 * (x.n + y.n - k)),
sym AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r(doc_id, c) AS (SELECT doc_id, doc_id FROM n UNION SELECT sym.b, r.c FROM r JOIN sym ON r.doc_id = sym.a)
SELECT doc_id, any_value(n) AS n_shingles, min(c) AS component_id, doc_id = min(c) AS kept FROM r JOIN n USING (doc_id) GROUP BY doc_id
"""
