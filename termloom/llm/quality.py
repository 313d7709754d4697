"""Quality classifier from weak labels.

1. Heuristic labellers vote on every document (1 against, 0 for, -1 abstain) in
   one pass: symbol tails, shouting, bare marks, stutter, bangs, function words,
   variety, punctuation, plain word ends; for abuse two word lists and their density.
2. Vote patterns are counted over all documents (3**labellers patterns at most).
   Expectation-maximisation on the counts estimates each labeller's behaviour on
   either class and the posterior of each pattern. Where a ``labels`` table has
   judgements, they fix the class of their rows in it.
3. Posterior labels train a hashed linear scorer (logistic): words, word heads,
   word shapes, and the votes themselves. It is fitted on ``SAMPLE`` rows chosen
   by a hash of doc_id, half of them judged and half not (where one kind has fewer
   rows, the other fills up): a documented bound, equal at any size. So posteriors
   train the scorer however many judgements there are.
4. The scorer reads every whole document; a document is kept if neither the junk
   nor the abuse probability reaches one half. Documents without words are not.

There are two such models, because junk and abuse are independent failings.
Null text counts as empty. Rows without doc_id are voted on and scored alike; if none
has one, the scorers know only the votes. Rows that repeat a doc_id are scored each,
and one of them may be in the sample. Columns of docs named like those added
(n_words, p_junk, p_abuse, keep) are replaced; all others are passed on.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import LOWER, U, groups, mix, prepare, read, span_hashes, table, text_buffer, words

SAMPLE = 8_000  # rows the scorer is fitted on
DIMS = 1 << 18
JUNK = ("symbols", "shouting", "marks", "stutter", "bangs", "function_words", "variety", "punctuation", "plain_ends")
ABUSE = ("persons", "contempt", "density")
FALSE_ALARM = 0.01  # a labeller votes against a good document at most this often
LEAST_DF = 3  # sample rows a hashed feature must occur in
TELLING = 3.0  # standard deviations by which it must go with a class

FUNCTION_WORDS = (
    "the of and to in a is that for it on was with be as by are this from at have or an not "
    "le la les de des du et un une en que qui dans pour sur par est pas au ce il "
    "der die das und in von zu den mit sich ein eine auf ist im dem nicht es "
    "el los las del y una que con por para su se lo como mas"
).split()
PERSONS = "idiot idiots moron morons loser losers scum clown clowns imbecile imbeciles cretin bastard jerk dumbass crétin connard abruti idiota imbécil estúpido dummkopf arschloch trottel".split()
CONTEMPT = "stupid disgusting worthless pathetic trash dumb vile filthy garbage débile minable asqueroso patético basura widerlich erbärmlich abschaum".split()

ALNUM = np.zeros(256, bool)
ALNUM[48:58] = ALNUM[65:91] = ALNUM[97:123] = ALNUM[128:] = True
UPPER = np.zeros(256, bool)
UPPER[65:91] = True
LETTER = np.zeros(256, bool)
LETTER[65:91] = LETTER[97:123] = LETTER[128:] = True
PLAIN_ENDS = np.frombuffer(b".,;:?!", np.uint8)


def _hash_list(terms: list[str]) -> np.ndarray:
    raw = [t.encode() for t in terms]
    data = np.frombuffer(b"".join(raw), np.uint8)
    ends = np.cumsum([len(r) for r in raw])
    return np.unique(span_hashes(data, ends - [len(r) for r in raw], ends))


FUNCTION_HASH, PERSON_HASH, CONTEMPT_HASH = _hash_list(FUNCTION_WORDS), _hash_list(PERSONS), _hash_list(CONTEMPT)


class Sieve:
    """Membership of many hashes in a small set."""

    def __init__(self, members: np.ndarray):
        self.members, self.bits = members, np.zeros(1 << 16, bool)
        self.bits[members >> U(48)] = True

    def __call__(self, h: np.ndarray) -> np.ndarray:
        hit = self.bits[h >> U(48)]
        at = np.flatnonzero(hit)
        hit[at] = np.isin(h[at], self.members)
        return hit


IS_FUNCTION, IS_PERSON, IS_CONTEMPT = Sieve(FUNCTION_HASH), Sieve(PERSON_HASH), Sieve(CONTEMPT_HASH)


class Features:
    """What one group of rows shows: word spans, bare-word hashes, per-word flags."""

    def __init__(self, data: np.ndarray, offs: np.ndarray):
        low = LOWER[data]
        self.starts, self.ends, self.at = words(data, offs)
        n = len(self.starts)
        self.n = np.diff(self.at)
        # the bare word: without leading and trailing marks
        self.size = self.ends - self.starts
        alnum = np.concatenate([[0], np.cumsum(ALNUM[data])])
        here = alnum[self.ends] - alnum[self.starts]
        pos = np.flatnonzero(ALNUM[data])
        has = here > 0
        b, e = self.starts.copy(), self.ends.copy()
        if len(pos):
            b[has] = pos[alnum[self.starts[has]]]
            e[has] = pos[alnum[self.ends[has]] - 1] + 1
        self.bare = span_hashes(low, b, e)
        self.whole = span_hashes(low, self.starts, self.ends)
        self.head4 = span_hashes(low, b, np.minimum(b + 5, e))
        self.head6 = span_hashes(low, b, np.minimum(b + 7, e))
        letters = np.concatenate([[0], np.cumsum(LETTER[data])])
        upper = np.concatenate([[0], np.cumsum(UPPER[data])])
        nl, nu = letters[self.ends] - letters[self.starts], upper[self.ends] - upper[self.starts]
        self.is_upper = (nl >= 2) & (2 * nu > nl) & (nu >= 2)
        self.is_mark = ~has
        tail = self.ends - e
        last = data[self.ends - 1] if n else np.zeros(0, np.uint8)
        self.tail = has & (tail >= 3)
        self.marks = self.size - here
        self.plain = has & ((tail == 0) | ((tail == 1) & np.isin(last, PLAIN_ENDS)))
        self.bang = (tail >= 2) & (last == 33)
        self.same = np.zeros(n, bool)
        self.same[1:] = self.whole[1:] == self.whole[:-1]
        self.same[self.at[:-1][self.n > 0]] = False
        # shape: size class, tail class, case and marks of a word
        self.shape = mix((np.minimum(tail, 3) * 64 + np.minimum(self.size, 15) * 4 + self.is_upper * 2 + self.is_mark).astype(U) + U(1 << 40))

    def per_row(self, flag: np.ndarray) -> np.ndarray:
        c = np.concatenate([[0], np.cumsum(flag)])
        return c[self.at[1:]] - c[self.at[:-1]]

    def votes(self) -> np.ndarray:
        n = self.n
        d = np.maximum(n, 1)

        def two(share, bad, good, least=1):
            return np.where(n < least, -1, np.where(share >= bad, 1, np.where(share <= good, 0, -1)))

        rows = len(n)
        code = pd.factorize(self.whole)[0]
        span = int(code.max()) + 1 if len(code) else 1
        distinct = np.bincount(np.unique(np.repeat(np.arange(rows), n) * span + code) // span, minlength=rows)
        fun = self.per_row(IS_FUNCTION(self.bare)) / d
        person, contempt = self.per_row(IS_PERSON(self.bare)), self.per_row(IS_CONTEMPT(self.bare))
        both = person + contempt
        variety = distinct / d
        plain = np.where(n > 0, self.per_row(self.plain) / d, 1.0)
        return np.stack(
            [
                two(self.per_row(self.tail) / d, 0.2, 0.02),
                two(self.per_row(self.is_upper) / d, 0.25, 0.05),
                two(self.per_row(self.is_mark) / d, 0.2, 0.02),
                two(self.per_row(self.same) / d, 0.15, 0.02),
                two(self.per_row(self.bang) / d, 0.1, 0.01),
                np.where(n < 20, -1, np.where(fun < 0.03, 1, np.where(fun > 0.1, 0, -1))),
                np.where(n < 30, -1, np.where(variety < 0.15, 1, np.where(variety > 0.45, 0, -1))),
                np.where(n < 20, -1, two(self.per_row(self.marks) / np.maximum(self.per_row(self.size), 1), 0.12, 0.06)),
                np.where(n < 20, -1, np.where(plain < 0.6, 1, np.where(plain > 0.9, 0, -1))),
                (person > 0).astype(int),
                (contempt > 0).astype(int),
                (both / d >= 0.005).astype(int),
            ],
            axis=1,
        ).astype(np.int8)

    def hashed(self) -> tuple[np.ndarray, np.ndarray]:
        """Distinct hashed features of each row, and their offsets by row."""
        rows = len(self.n)
        row = np.repeat(np.arange(rows, dtype=np.int64), self.n) << 18
        idx = [row | (mix(h + U(i + 1)) >> U(46)).astype(np.int64) for i, h in enumerate((self.bare, self.head4, self.head6, self.shape))]
        keys = np.unique(np.concatenate(idx)) if len(row) else np.zeros(0, np.int64)
        return keys & (DIMS - 1), np.searchsorted(keys >> 18, np.arange(rows + 1))


def _each(batches, text="text"):
    for b in batches:
        data, offs = text_buffer(b.column(text))
        for i, j in groups(offs):
            yield b, i, j, Features(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i])


def _vote(batches):
    for b, i, j, f in _each(batches):
        v = f.votes()
        yield pa.RecordBatch.from_arrays([b.column("doc_id").slice(i, j - i), pa.array(f.n), pa.array([x.tobytes() for x in v + 1], pa.binary())], ["doc_id", "n_words", "votes"])


def fit_labels(patterns: np.ndarray, counts: np.ndarray, known: np.ndarray | None = None, capped: bool = False, rounds: int = 100) -> tuple[np.ndarray, np.ndarray, float]:
    """EM over vote patterns (m x k of -1, 0, 1): posterior of class 1 per pattern,
    behaviour (class, labeller: the rate of votes against) and the class's share. Where ``known`` is 0
    or 1 the class is given. An abstention says nothing of the class. ``capped``: while no class 0 is given, no labeller is
    believed to vote against class 0 more often than FALSE_ALARM."""
    said = np.stack([patterns == v for v in (0, 1)], axis=2).astype(float)  # m x k x 2
    known = np.full(len(patterns), -1) if known is None else known
    given = known >= 0
    judged = counts[given & (known == 0)].sum() > 0
    post = np.where(given, known, np.where((patterns == 1).any(axis=1), 0.95, 0.02)).astype(float)
    behaviour, share = np.zeros((2, patterns.shape[1])), 0.5
    for _ in range(rounds):
        old = post
        for c, p in enumerate((1 - post, post)):
            seen = np.einsum("i,ikv->kv", p * counts, said)
            behaviour[c] = (seen[:, 1] + 0.1) / (seen.sum(axis=1) + 0.2)
        if capped and not judged:
            behaviour[0] = np.minimum(behaviour[0], FALSE_ALARM)
        share = float(np.clip((post * counts).sum() / counts.sum(), 1e-4, 1 - 1e-4))
        odds = np.log(np.stack([1 - behaviour, behaviour], axis=2))
        ll = np.einsum("ikv,ckv->ic", said, odds) + np.log([1 - share, share])
        post = np.where(given, known, 1 / (1 + np.exp(np.clip(ll[:, 0] - ll[:, 1], -500, 500))))
        if np.abs(post - old).max() < 1e-7:
            break
    return post, behaviour, share


def fit_scorer(idx: np.ndarray, bound: np.ndarray, dense: np.ndarray, target: np.ndarray, rounds: int = 80, l2: float = 1e-3) -> tuple[np.ndarray, np.ndarray]:
    """Logistic regression on hashed presence features plus dense columns, by
    full-batch gradient steps scaled per feature; the rarer class weighs more."""
    rows = len(target)
    owner = np.repeat(np.arange(rows), np.diff(bound))
    pos = float(np.clip(target.mean(), 1e-3, 1 - 1e-3))
    # only features that go with the class by more than chance: others are learnt by heart
    n, up = np.bincount(idx, minlength=DIMS), np.bincount(idx, target[owner], DIMS)
    telling = (n >= LEAST_DF) & (np.abs(up - n * pos) >= TELLING * np.sqrt(n * pos * (1 - pos) + 0.5))
    some = telling[idx]
    owner, (used, local) = owner[some], np.unique(idx[some], return_inverse=True)
    weight = np.sqrt(np.where(target > 0.5, 0.5 / pos, 0.5 / (1 - pos)))
    weight /= weight.sum()
    x = np.concatenate([dense, np.ones((rows, 1))], axis=1)
    w, d = np.zeros(len(used)), np.zeros(x.shape[1])
    gw, gd = np.full(len(used), 1e-8), np.full(x.shape[1], 1e-8)
    for _ in range(rounds):
        z = np.bincount(owner, w[local], rows) + x @ d
        err = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - target) * weight
        a, b = np.bincount(local, err[owner], len(used)) + l2 * w, x.T @ err
        gw += a * a
        gd += b * b
        w -= 0.1 * a / np.sqrt(gw)
        d -= 0.1 * b / np.sqrt(gd)
    full = np.zeros(DIMS, np.float32)
    full[used] = w
    return full, d.astype(np.float32)


def _features(batches):
    for b, i, j, f in _each(batches):
        idx, bound = f.hashed()
        yield pa.RecordBatch.from_arrays(
            [b.column("doc_id").slice(i, j - i), pa.array([idx[x:y].astype(np.uint32).tobytes() for x, y in zip(bound[:-1].tolist(), bound[1:].tolist())], pa.binary())], ["doc_id", "idx"]
        )


def dense_votes(v: np.ndarray) -> np.ndarray:
    return np.concatenate([v == 1, v == 0], axis=1).astype(np.float32)


def _score(models):
    def run(batches):
        for b, i, j, f in _each(batches):
            v = f.votes()
            idx, bound = f.hashed()
            out = []
            for (w, d), cols in zip(models.value, (slice(0, len(JUNK)), slice(len(JUNK), None))):
                c = np.concatenate([[0.0], np.cumsum(w[idx].astype(float))])
                z = c[bound[1:]] - c[bound[:-1]] + dense_votes(v[:, cols]) @ d[:-1] + d[-1]
                out.append(1 / (1 + np.exp(-np.clip(z, -30, 30))))
            junk, abuse = out
            keep = (f.n > 0) & (junk < 0.5) & (abuse < 0.5)
            rest = [b.column(c).slice(i, j - i) for c in b.schema.names]
            yield pa.RecordBatch.from_arrays([*rest, pa.array(f.n), pa.array(junk), pa.array(abuse), pa.array(keep)], [*b.schema.names, "n_words", "p_junk", "p_abuse", "keep"])

    return run


def train(spark: SparkSession, docs: DataFrame, labels: DataFrame | None):
    """Both scorers, fitted on docs(doc_id, text) and, if given, labels(doc_id, quality, toxic)."""
    prepare(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    votes = table(spark, docs.mapInArrow(_vote, "doc_id long, n_words long, votes binary"), "votes")
    if labels is None:
        votes = votes.withColumn("j", F.lit(-1)).withColumn("a", F.lit(-1))
    else:
        judged = labels.groupBy("doc_id").agg((1 - F.min("quality")).cast("int").alias("j"), F.max("toxic").cast("int").alias("a"))
        votes = votes.join(judged, "doc_id", "left").withColumns({"j": F.coalesce("j", F.lit(-1)), "a": F.coalesce("a", F.lit(-1))})
    votes = votes.where("n_words > 0")
    counted = votes.groupBy("votes", "j", "a").agg(F.count("*").alias("n")).collect()  # 3**12 * 9 rows at most, far fewer occur
    if not counted:
        zero = tuple((np.zeros(DIMS, np.float32), np.full(2 * len(k) + 1, -1, np.float32)) for k in (JUNK, ABUSE))
        return zero, {}
    raw = np.stack([np.frombuffer(r["votes"], np.int8) - 1 for r in counted])
    n = np.array([r["n"] for r in counted], float)
    views = {"junk": (slice(0, len(JUNK)), "j"), "abuse": (slice(len(JUNK), None), "a")}
    fits = {}
    for name, (cols, judge) in views.items():
        known = np.array([r[judge] for r in counted])
        pats, inv = np.unique(np.column_stack([raw[:, cols], known]), axis=0, return_inverse=True)
        post, behaviour, share = fit_labels(pats[:, :-1], np.bincount(inv.ravel(), n), pats[:, -1], capped=True)
        fits[name] = {"posterior": {tuple(p): float(x) for p, x in zip(pats.tolist(), post)}, "behaviour": behaviour, "share": share}
    known = votes.where("doc_id is not null").select("doc_id", "votes", "j", "a")
    with_judgement, without = known.where("j >= 0"), known.where("j < 0")
    have = known.agg(F.count_if(F.col("j") >= 0), F.count_if(F.col("j") < 0)).first()
    of_judged = max(SAMPLE // 2, SAMPLE - have[1])
    order = F.xxhash64("doc_id"), "doc_id"
    sample = with_judgement.orderBy(*order).limit(of_judged).union(without.orderBy(*order).limit(SAMPLE - min(have[0], of_judged)))
    sample = sample.dropDuplicates(["doc_id"]).checkpoint()
    got = docs.join(F.broadcast(sample.select("doc_id")), "doc_id", "left_semi").dropDuplicates(["doc_id"])
    feats = {r["doc_id"]: r["idx"] for r in got.mapInArrow(_features, "doc_id long, idx binary").collect()}  # SAMPLE rows at most
    rows = [r for r in sample.orderBy("doc_id").collect() if r["doc_id"] in feats]
    idx = [np.frombuffer(feats[r["doc_id"]], np.uint32) for r in rows]
    if not rows:  # no row has a doc_id: the vote patterns alone train the scorers
        rows, idx = counted, [np.zeros(0, np.uint32)] * len(counted)
    v = np.stack([np.frombuffer(r["votes"], np.int8) - 1 for r in rows])
    models = []
    for name, (cols, judge) in views.items():
        given = np.array([r[judge] for r in rows])
        # where there are judgements, a row that no one judged and no labeller voted
        # against is no evidence: it may be of the kind the labellers miss
        use = (given >= 0) | (v[:, cols] == 1).any(axis=1) if (given >= 0).any() else np.ones(len(rows), bool)
        target = np.array([fits[name]["posterior"][(*x[cols].tolist(), g)] for x, g in zip(v[use], given[use].tolist())])
        picked = [x for x, u in zip(idx, use) if u]
        bound = np.concatenate([[0], np.cumsum([len(x) for x in picked])])
        flat = np.concatenate([np.zeros(0, np.int64), *picked]).astype(np.int64)
        models.append(fit_scorer(flat, bound, dense_votes(v[use][:, cols]), target))
    return tuple(models), fits


def classify(spark: SparkSession, docs: DataFrame, labels: DataFrame | None) -> DataFrame:
    """docs with n_words, p_junk, p_abuse and keep."""
    prepare(spark)
    models, _ = train(spark, docs, labels)
    shared = spark.sparkContext.broadcast(models)  # two vectors of DIMS floats
    cols = [c for c in docs.columns if c not in ("n_words", "p_junk", "p_abuse", "keep")]
    narrowed = docs.select(*cols).withColumn("text", F.col("text").cast("string"))
    shape = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in narrowed.schema.fields)
    return narrowed.mapInArrow(_score(shared), shape + ", n_words long, p_junk double, p_abuse double, keep boolean")


def op8_weak_label_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(spark, read(spark, sf_dir, "documents").select("doc_id", "text"), read(spark, sf_dir, "labels")).drop("text")
