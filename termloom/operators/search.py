"""Ranked search for a table of queries.

One search is a one-row table; nothing is collected. Queries are parsed, spelled,
mapped to phrases (whole or in segments), met with the postings, merged by best
score, re-ranked for side and site, demoted, ranked and explained. Every step is a
join or an aggregate keyed by (qid, code) or a row-wise expression.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import ArrayType, BooleanType, StringType, StructField, StructType

from ..functions import codes as C, rules as R, text as X, values as V
from ..session import stage
from .hierarchy import prefix_join, top_rows
from .index import Index, source_weight

CANDIDATE = "qid long, code string, s double, kind string, atm boolean, def boolean"


# --- spelling ------------------------------------------------------------------
def spellfix(words: DataFrame, tokens: DataFrame) -> DataFrame:
    """(word, tok, fix): for words whose stem no document has. Candidates share the
    first letter and nearly the length; the closest wins, then those that the word is
    a subsequence of, the nearest length, the most frequent, the first in order."""
    unknown = words.select("word", "tok").distinct().where((F.length("word") >= V.FUZZY_MIN) & ~F.col("tok").rlike("[0-9]")).join(tokens, F.col("tok") == F.col("token"), "left_anti")
    most = F.when(F.length("tok") >= 9, 2).otherwise(1)
    asked = unknown.withColumn("most", most).withColumn("len", F.explode(F.sequence(F.length("tok") - F.col("most") - 1, F.length("tok") + F.col("most") + 1)))
    vocab = tokens.where(~F.col("token").rlike(f"[{V.CJK}]")).select("token", "df", F.substring("token", 1, 1).alias("head"), F.length("token").alias("len"))
    near = asked.withColumn("head", F.substring("tok", 1, 1)).join(vocab, ["head", "len"])
    d = F.least(R.osa_distance("tok", "token", "most"), R.osa_distance("word", "token", "most"))
    near = near.withColumn("d", d).where(F.col("d") <= F.col("most"))
    sub = R.is_subsequence(F.col("tok"), F.col("token")) | R.is_subsequence(F.col("word"), F.col("token"))
    order = F.struct("d", F.when(sub, 0).otherwise(1).alias("o"), F.abs(F.length("token") - F.length("tok")).alias("l"), (-F.col("df")).alias("f"), "token")
    return near.groupBy("word", "tok").agg(F.min_by("token", order).alias("fix"))


def corrected(q: DataFrame, ix: Index, fold: bool = True) -> DataFrame:
    """q(qid, text) with spelling mended; in queries of several words, approved
    abbreviations are spelled out first."""
    w = q.select("qid", F.split(X.normalise(F.col("text"), fold), " ").alias("ws"))
    w = w.select("qid", (F.size(F.filter("ws", lambda x: x != "")) > 1).alias("multi"), F.posexplode("ws").alias("pos", "word"))
    plain = w.where((F.col("word") != "") & ~F.col("word").rlike(f"[{V.CJK}]")).withColumn("tok", X.stem(F.col("word")))
    fixes = spellfix(plain, ix.tokens).select("word", "fix")
    abbr = ix.abbreviations.select(F.col("short").alias("word"), "long")
    j = w.join(fixes, "word", "left").join(abbr, "word", "left")
    new = F.when(F.col("multi") & F.col("long").isNotNull(), F.col("long")).otherwise(F.coalesce("fix", "word"))
    parts = j.select("qid", "pos", new.alias("new"))
    back = parts.groupBy("qid").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "new"))), lambda x: x["new"]), " ").alias("fixed"))
    return q.join(back, "qid", "left").withColumn("text", F.coalesce("fixed", "text")).drop("fixed")


# --- segmentation --------------------------------------------------------------
_HAN = re.compile(f"[{V.CJK}]")


def segment_han(run: str, words: set[str], longest: int = 12) -> list[tuple[str, bool]]:
    """Cheapest split: a dictionary word costs 1, a single character 3; on ties the
    earlier found stands. Neighbouring characters outside the dictionary join."""
    best: list = [(0, [])] + [None] * len(run)
    for i in range(len(run)):
        if best[i] is None:
            continue
        for size in range(min(longest, len(run) - i), 0, -1):
            w = run[i : i + size]
            known = size >= 2 and w in words
            if size > 1 and not known:
                continue
            cost = best[i][0] + (1 if known else 3)
            if best[i + size] is None or cost < best[i + size][0]:
                best[i + size] = (cost, [*best[i][1], (w, known)])
    out: list[tuple[str, bool]] = []
    for w, known in best[len(run)][1]:
        if out and not known and not out[-1][1]:
            out[-1] = (out[-1][0] + w, False)
        else:
            out.append((w, known))
    return out


def segments_of(text: str, phrases: set[str], words: set[str]) -> list[tuple[str, bool]]:
    """Greedy spans of up to five words that are phrases; Chinese words are split."""
    ws, out, i = [w for w in text.split(" ") if w], [], 0
    while i < len(ws):
        if _HAN.search(ws[i]):
            out += segment_han(ws[i], words)
            i += 1
            continue
        for size in range(min(V.SPAN_WORDS, len(ws) - i), 0, -1):
            span = " ".join(ws[i : i + size])
            if span in phrases and not _HAN.search(span):
                out.append((span, True))
                i += size
                break
        else:
            out.append((ws[i], False))
            i += 1
    return out


@F.pandas_udf(ArrayType(StructType([StructField("text", StringType()), StructField("mapped", BooleanType())])))
def _segmented(text: pd.Series, phrases: pd.Series, words: pd.Series) -> pd.Series:
    out = [segments_of(t or "", set(p) if p is not None else set(), set(w) if w is not None else set()) for t, p, w in zip(text, phrases, words)]
    return pd.Series([[{"text": a, "mapped": m} for a, m in row] for row in out], dtype=object)


def segments(q: DataFrame, ix: Index, fold: bool = True) -> DataFrame:
    """q(qid, atm) to (qid, whole, seg, text, key, mapped): one row per segment.
    Which spans are phrases, and which pieces are words, is found by joins."""
    t = q.select("qid", X.normalise(F.col("atm"), fold).alias("t"))
    t = t.withColumn("key", X.phrase_key(F.col("t")))
    keys = ix.phrases.select("key").distinct()
    whole = t.join(keys, "key", "left_semi").select("qid", F.lit(True).alias("whole"), F.lit(0).alias("seg"), F.col("t").alias("text"), "key", F.lit(True).alias("mapped"))
    rest = t.join(keys, "key", "left_anti")
    ws = F.split("t", " ")
    spans = F.flatten(
        F.transform(F.sequence(F.lit(1), F.size(ws)), lambda i: F.transform(F.sequence(F.lit(1), F.least(F.lit(V.SPAN_WORDS), F.size(ws) - i + 1)), lambda n: F.array_join(F.slice(ws, i, n), " ")))
    )
    span = rest.select("qid", F.explode(F.array_distinct(spans)).alias("span")).withColumn("key", X.phrase_key(F.col("span"))).where("key <> ''")
    known = span.join(keys, "key", "left_semi").groupBy("qid").agg(F.collect_set("span").alias("phrases"))
    runs = F.flatten(
        F.transform(
            X.han_runs(F.col("t")),
            lambda r: F.flatten(F.transform(F.sequence(F.lit(1), F.length(r)), lambda i: F.transform(F.sequence(F.lit(1), F.least(F.lit(12), F.length(r) - i + 1)), lambda n: F.substring(r, i, n)))),
        )
    )
    piece = rest.select("qid", F.explode(F.array_distinct(runs)).alias("word")).where(F.length("word") >= 2)
    words = piece.join(ix.zh_dict, "word", "left_semi").groupBy("qid").agg(F.collect_set("word").alias("words"))
    cut = rest.join(known, "qid", "left").join(words, "qid", "left").select("qid", F.posexplode(_segmented("t", "phrases", "words")).alias("seg", "s"))
    split = cut.select("qid", F.lit(False).alias("whole"), "seg", F.col("s.text").alias("text"), X.phrase_key(F.col("s.text")).alias("key"), F.col("s.mapped").alias("mapped"))
    return whole.union(split)


# --- free text -----------------------------------------------------------------
def query_tokens(q: DataFrame, ix: Index, fold: bool = True) -> tuple[DataFrame, DataFrame]:
    """(qid, qi, token, alt) for query tokens that some document has, numbered, and
    (qid, live). A missing last English word stands for the first 40 words it begins."""
    t = q.select("qid", X.normalise(F.col("text"), fold).alias("t")).withColumn("en", X.english(F.col("t")))
    t = t.withColumn("n_en", F.size("en"))
    each = t.select("qid", "n_en", F.posexplode(X.tokens(F.col("t"))).alias("qi", "token"))
    known = ix.tokens.select("token").withColumn("known", F.lit(True))
    each = each.join(known, "token", "left")
    direct = each.where("known").select("qid", "qi", "token", F.col("token").alias("alt"))
    open_ = each.where((F.col("known").isNull()) & (F.col("qi") == F.col("n_en") - 1) & (F.length("token") >= V.PREFIX_MIN)).select("qid", "qi", "token")
    stems = open_.select(F.col("token").alias("root")).distinct()
    grown = prefix_join(stems, "root", ix.tokens.where(~F.col("token").rlike(f"[{V.CJK}]")).select("token"), "token").where("token <> root")
    grown = top_rows(grown, ["root"], [F.asc("token")], V.PREFIX_MOST).select(F.col("root").alias("token"), F.col("token").alias("alt"))
    alts = direct.union(open_.join(grown, "token").select("qid", "qi", "token", "alt"))
    live = Window.partitionBy("qid").orderBy("qi")
    alts = alts.withColumn("qi", F.dense_rank().over(live) - 1)
    return alts, alts.groupBy("qid").agg(F.countDistinct("qi").alias("live"))


def bm25(alts: DataFrame, postings: DataFrame, tokens: DataFrame, doc: str = "code") -> DataFrame:
    """(qid, doc, score, hit, mask): the best alternative of each query token, summed."""
    a = alts.select("qid", "qi", F.col("alt").alias("token")).join(tokens.select("token", "idf"), "token")
    s = a.join(postings.select("token", doc, "impact"), "token").select("qid", "qi", doc, (F.col("idf") * F.col("impact")).alias("s"))
    per = s.groupBy("qid", doc, "qi").agg(F.max("s").alias("s"))
    bit = F.expr("shiftleft(1L, least(qi, 62))")
    return per.groupBy("qid", doc).agg(F.sum("s").alias("score"), F.count("*").alias("hit"), F.bit_or(bit).alias("mask"))


def free_text(scores: DataFrame, live: DataFrame) -> DataFrame:
    """Scores by squared coverage; below half of the live words a document is out."""
    c = F.col("hit") / F.col("live")
    j = scores.join(live, "qid").withColumn("cov", c)
    return j.where((F.col("cov") >= V.MIN_COVERAGE) | (F.col("live") <= 1)).withColumn("s", F.col("score") * F.col("cov") * F.col("cov"))


# --- merging -------------------------------------------------------------------
def code_hits(q: DataFrame, codes: DataFrame) -> DataFrame:
    """Codes typed as such: the code, its descendants, or a range."""
    asked = q.select("qid", F.explode("codes").alias("c")).select("qid", "c.kind", F.col("c.code").alias("asked"), F.col("c.last").alias("last"))
    one = asked.where("kind in ('cm', 'pcs')")
    all_ = codes.select("code")
    exact = one.join(all_, F.col("asked") == F.col("code")).select("qid", "code", F.lit(V.CODE_EXACT).alias("s"), F.lit("code").alias("kind"))
    below = prefix_join(one.select("qid", "asked"), "asked", all_, "code").where("code <> asked").select("qid", "code", (F.lit(V.CODE_PREFIX) - F.length("code")).alias("s"), F.lit("code-prefix").alias("kind"))
    rng = asked.where("kind = 'range' and asked is not null and last is not null").select("qid", F.col("asked").alias("first"), "last")
    span = rng.join(all_, C.in_range(F.col("code"), F.col("first"), F.col("last"))).select("qid", "code", F.lit(V.CODE_RANGE).alias("s"), F.lit("code-range").alias("kind"))
    return exact.union(below).union(span).select("qid", "code", "s", "kind", F.lit(False).alias("atm"), F.lit(False).alias("def"))


def best(candidates: DataFrame) -> DataFrame:
    """The best candidate per (qid, code); a default mark sticks from any of them."""
    order = F.struct("s", "kind")
    top = F.max_by(F.struct("kind", "atm"), order)
    return candidates.groupBy("qid", "code").agg(F.max("s").alias("s"), top.alias("t"), F.bool_or("def").alias("def")).select("qid", "code", "s", "t.kind", "t.atm", "def")


def segment_sets(segs: DataFrame, q: DataFrame, ix: Index) -> tuple[DataFrame, DataFrame]:
    """Concepts (qid, seg, code, src_id, flags) of mapped segments, and the weighted
    set (qid, seg, code, w, node) of each with its descendants."""
    concepts = segs.where("mapped").join(ix.phrases, "key").select("qid", "seg", "code", "src_id", "flags")
    w = concepts.withColumn("w", source_weight(F.col("src_id")))
    nodes = w.join(ix.codes.select("code"), "code").select("qid", "seg", "code", (F.col("w") * 2).alias("w"), F.lit(True).alias("node"))
    roots = w.join(q.where("explode").select("qid"), "qid", "left_semi").groupBy("qid", "seg", F.col("code").alias("root")).agg(F.max("w").alias("w"))
    below = prefix_join(roots, "root", ix.codes.select("code"), "code").where("code <> root").select("qid", "seg", "code", "w", F.lit(False).alias("node"))
    return concepts, nodes.union(below).groupBy("qid", "seg", "code").agg(F.max("w").alias("w"), F.bool_or("node").alias("node"))


def whole_mapping(sets: DataFrame, concepts: DataFrame, scores: DataFrame, ix: Index) -> DataFrame:
    """Candidates of queries that are one phrase: the node, its descendants, and the
    default child of a node that cannot be billed."""
    direct = F.col("src_id").isin(V.DIRECT_SOURCES) & (F.col("flags").bitwiseAND(1) == 0)
    title = (F.col("src_id") < 0) & (F.col("flags").bitwiseAND(1) == 0)
    per = concepts.groupBy("qid", "code").agg(F.bool_or(direct).alias("direct"), F.bool_or(title).alias("title"))
    any_ = per.groupBy("qid").agg(F.bool_or("direct").alias("any_direct"))
    per = per.join(any_, "qid").select("qid", "code", F.when(F.col("any_direct"), F.col("direct")).otherwise(F.col("title")).alias("named"))
    j = sets.join(scores.select("qid", "code", "score"), ["qid", "code"], "left").join(ix.codes.select("code", "use"), "code").join(per, ["qid", "code"], "left")
    s = F.when(F.col("node"), V.NODE).otherwise(V.EXPLODE) * F.col("w") + F.coalesce("score", F.lit(0.0))
    is_def = F.col("node") & (F.col("use") == 1) & F.coalesce("named", F.lit(False))
    rows = j.withColumn("s", s).withColumn("def", is_def)
    here = rows.select("qid", "code", F.when(F.col("def"), F.col("s") * V.DIRECT_BONUS).otherwise(F.col("s")).alias("s"), F.lit("atm").alias("kind"), F.lit(True).alias("atm"), "def")
    kids = rows.where("node and use <> 1").join(ix.defaults, F.col("code") == F.col("header"))
    return here.union(kids.select("qid", F.col("child").alias("code"), F.col("s") * V.DEFAULT_CHILD, F.lit("atm"), F.lit(True), F.lit(True)))


def segmented_mapping(segs: DataFrame, sets: DataFrame, scores: DataFrame, live: DataFrame, alts: DataFrame, fold: bool = True) -> DataFrame:
    """Candidates of queries of several segments: every segment must hold, by its
    concept set or by three quarters of its live words; and pure intersections."""
    many = segs.groupBy("qid").agg(F.count("*").alias("n_segs"), F.bool_and("mapped").alias("all_mapped")).where("n_segs > 1")
    mine = segs.join(many, "qid")
    bits = alts.groupBy("qid", "token").agg(F.max("qi").alias("qi"))
    toks = mine.select("qid", "seg", F.explode(X.tokens(X.normalise(F.col("text"), fold))).alias("token")).join(bits, ["qid", "token"])
    need = toks.groupBy("qid", "seg").agg(F.bit_or(F.expr("shiftleft(1L, least(qi, 62))")).alias("m"), F.greatest(F.lit(1), F.ceil(F.count("*") * V.SEGMENT_SHARE)).alias("need"))
    lone = F.col("text").rlike(f"^[{V.CJK}]$") & ~F.col("mapped")
    tests = mine.withColumn("lone", lone).join(need, ["qid", "seg"], "left").select("qid", "seg", "n_segs", "lone", "m", "need")
    met = scores.join(live, "qid").join(tests, "qid").join(sets.select("qid", "seg", "code", "w"), ["qid", "seg", "code"], "left")
    by_words = F.coalesce(F.bit_count(F.col("mask").bitwiseAND(F.col("m"))) >= F.col("need"), F.lit(False))
    ok = F.col("w").isNotNull() | F.col("lone") | by_words
    held = met.groupBy("qid", "code").agg(F.count_if(ok).alias("ok"), F.first("n_segs").alias("n_segs"), F.coalesce(F.sum("w"), F.lit(0.0)).alias("w"), F.first("score").alias("score"), F.first("hit").alias("hit"), F.first("live").alias("live"))
    cov = F.col("hit") / F.col("live")
    bonus = F.col("w") * V.SEGMENT_BONUS
    and_ = held.where("ok = n_segs").select("qid", "code", (F.col("score") * cov * cov + bonus).alias("s"), F.lit("atm-seg").alias("kind"), (bonus > 0).alias("atm"), F.lit(False).alias("def"))
    inter = sets.join(many.where("all_mapped").select("qid", "n_segs"), "qid").groupBy("qid", "code", "n_segs").agg(F.count("*").alias("k"), F.sum("w").alias("w")).where("k = n_segs")
    return and_.union(inter.select("qid", "code", F.col("w") * V.SEGMENT_BONUS * 2, F.lit("atm-and"), F.lit(True), F.lit(False)))


def drop_negated(cands: DataFrame, q: DataFrame, ix: Index, fold: bool = True) -> DataFrame:
    """Candidates whose texts hold any word the query excludes go."""
    neg = q.select("qid", F.explode("neg").alias("w")).select("qid", F.explode(X.tokens(X.normalise(F.col("w"), fold))).alias("token")).distinct()
    hit = neg.join(ix.postings.where("not gap").select("token", "code"), "token").select("qid", "code").distinct()
    return cands.join(hit, ["qid", "code"], "left_anti")


# --- side and site -------------------------------------------------------------
def _side_ok(lat: Column) -> Column:
    return F.coalesce((lat == F.col("side.lat")) | ((lat == V.ONE) & (F.col("side.lat") != V.BOTH)), F.lit(False))


def _later(f: str = "f_enc") -> Column:
    return F.col(f).isNotNull() & (F.col(f) != V.FIRST_VISIT) & ~F.col("side.later")


def _opened(f: str = "f_fx") -> Column:
    return F.coalesce(F.col(f) == V.OPEN_FRACTURE, F.lit(False)) & ~F.col("side.open")


def anchors(concepts: DataFrame, ix: Index) -> DataFrame:
    """(qid, cat, anchor, content): per three-character category, the common prefix of
    the deepest mapped codes, and the telling words of that code's English name."""
    m = concepts.select("qid", "code", F.substring("code", 1, 3).alias("cat")).distinct()
    deeper = m.select("qid", F.col("code").alias("other"), "cat")
    inner = m.join(deeper, ["qid", "cat"]).where((F.col("other") != F.col("code")) & F.col("other").startswith(F.col("code"))).select("qid", "code").distinct()
    leaves = m.join(inner, ["qid", "code"], "left_anti")
    ends = leaves.groupBy("qid", "cat").agg(F.min("code").alias("lo"), F.max("code").alias("hi"))
    a = ends.select("qid", "cat", C.common_prefix(F.col("lo"), F.col("hi")).alias("anchor"))
    stop = F.array(*[F.lit(w) for w in sorted({*V.CONTENT_STOP, *V.SITE_STOP})])
    stop = F.array_union(stop, F.transform(stop, X.stem))
    words = F.filter("en_tokens", lambda t: (F.length(t) >= 4) & ~F.array_contains(stop, t))
    names = ix.codes.select(F.col("code").alias("anchor"), words.alias("content"))
    return a.join(names, "anchor", "left").select("qid", "cat", "anchor", F.when(F.size("content") > 0, F.col("content")).alias("content"))


def lateralize(cands: DataFrame, q: DataFrame, concepts: DataFrame, scores: DataFrame, ix: Index, fold: bool = True) -> DataFrame:
    """Re-rank for queries with a side: multiply by how side, site, encounter and
    subtype agree, then offer the matching codes of the best families."""
    sided = q.where("side.lat is not null").select("qid", "side", F.array_distinct(X.english(X.normalise(F.col("text"), fold))).alias("q_words"))
    features = ["code", "zh", "en", "use", "f_lat", "f_enc", "f_fx", "sites", "hint_bits", "avoid_bits", "fbody", "generic", "generic_part", "unspecified", "unspecified_site", "en_tokens"]
    feat = ix.codes.select(*features)
    anc = anchors(concepts, ix)
    mine = cands.where(~F.col("kind").startswith("code")).join(sided, "qid").join(feat, "code")
    fam5 = ix.sided.withColumn("fam_sided", F.lit(True))
    mine = mine.withColumn("cat", F.substring("code", 1, 3)).withColumn("fam5", F.substring("code", 1, 5)).join(anc, ["qid", "cat"], "left").join(fam5, "fam5", "left")
    same = F.col("content").isNull() | F.arrays_overlap("content", "en_tokens")
    lat, ok = F.col("f_lat"), _side_ok(F.col("f_lat"))
    exact = F.coalesce(lat == F.col("side.lat"), F.lit(False))
    avoided = F.col("side.avoid").bitwiseAND(F.col("avoid_bits")) != 0
    on_site = R.site_ok(F.col("side.sites"), F.col("sites"))
    clash = R.site_conflict(F.col("side.sites"), F.col("sites")) | F.col("unspecified_site")
    k = V.SIDE
    one = F.lit(1.0)
    m = F.when(exact, F.when(same, k["match"]).otherwise(k["off_topic"])).when(ok, one).when(lat.isNotNull() & (lat != V.SIDE_UNKNOWN), k["other"]).when(lat.isNotNull(), k["unspecified"]).when(F.col("fam_sided"), k["none"]).otherwise(one)
    m = m * F.when(on_site, one).when(clash, k["site_conflict"]).otherwise(k["site_miss"])
    m = m * F.when(_later(), k["later"]).otherwise(one) * F.when(_opened(), k["open"]).otherwise(one)
    m = m * F.when(~F.col("side.fbody") & F.col("fbody"), k["open"]).otherwise(one) * F.when(avoided, k["open"]).otherwise(one)
    m = m * F.when(ok & F.col("generic_part"), k["generic"]).otherwise(one)
    mine = mine.withColumn("orig", F.col("s")).withColumn("s", F.col("s") * m).withColumn("ok", ok).withColumn("avoided", avoided)

    top = top_rows(mine, ["qid"], [F.desc("s"), F.asc("code")], k["top"], "place").where(~(F.col("ok") & (F.col("use") == 1)))
    wrong = F.col("f_lat").isNotNull() & (F.col("f_lat") != V.SIDE_UNKNOWN) & ~F.col("ok")
    fam = F.when((F.col("use") == 0) & F.col("ok"), F.col("code")).when((F.col("use") == 0) | wrong | F.col("unspecified"), F.col("cat")).otherwise(F.col("fam5"))
    fams = top.withColumn("fam", F.regexp_replace(fam, r"\.$", ""))
    fams = top_rows(fams, ["qid", "fam"], [F.asc("place")], 1, "first").select("qid", "fam", "orig", "avoided", "atm", "side", "q_words", "anchor", "content")
    kin = prefix_join(fams.withColumnRenamed("avoided", "from_avoided"), "fam", feat, "code").where("use = 1")
    kin = kin.withColumn("ok", _side_ok(F.col("f_lat"))).where("ok").where(R.site_ok(F.col("side.sites"), F.col("sites")) & ~_later() & ~_opened() & ~(~F.col("side.fbody") & F.col("fbody")))
    kin = kin.withColumn("share", F.when(F.col("content").isNull(), 0).otherwise(F.size(F.array_intersect("content", "en_tokens")))).where(F.col("content").isNull() | (F.col("share") > 0))
    kin = kin.join(scores.select("qid", "code", "score"), ["qid", "code"], "left")
    order = [
        F.asc((F.col("side.avoid").bitwiseAND(F.col("avoid_bits")) != 0).cast("int")),
        F.desc("share"),
        F.desc(F.when(F.col("anchor").isNull(), 0).otherwise(F.length(C.common_prefix(F.col("code"), F.coalesce("anchor", F.lit("")))))),
        F.desc((F.col("side.hints").bitwiseAND(F.col("hint_bits")) != 0).cast("int")),
        F.desc(F.size(F.array_intersect("q_words", "en_tokens"))),
        F.desc(F.col("generic").cast("int")),
        F.desc(F.coalesce("score", F.lit(0.0))),
        F.asc("code"),
    ]
    picks = top_rows(kin, ["qid", "fam"], order, 3, "place")
    s = F.col("orig") * k["match"] * k["member"] * F.when(F.col("from_avoided"), k["open"]).otherwise(one) * (1 - 0.02 * (F.col("place") - 1))
    new = picks.select("qid", "code", s.alias("s"), F.lit("text").alias("kind"), "atm", F.lit(False).alias("def"))
    kept = cands.join(mine.select("qid", "code"), ["qid", "code"], "left_anti").select(*cands.columns)
    return best(kept.union(mine.select(*cands.columns)).union(new.select(*cands.columns)))


# --- finish --------------------------------------------------------------------
def negation(q: DataFrame, fold: bool = True) -> DataFrame:
    t = X.normalise(F.col("text"), fold)
    flat = F.regexp_replace(t, r"\s+", "")
    return q.select("qid", F.when(flat.rlike(f"[{V.CJK}]"), flat).alias("neg_zh"), X.english(t).alias("neg_en"), F.lower("text").rlike(V.PREGNANCY).alias("pregnant"))


def demoted(cands: DataFrame, q: DataFrame, ix: Index, fold: bool = True) -> DataFrame:
    """Final scores: headings, manifestations, negated titles and obstetric codes sink;
    codes typed as such stay."""
    j = cands.join(negation(q, fold), "qid").join(ix.codes.select("code", "zh", "en", "use", "elsewhere", "zh_flat", "without_words"), "code")
    at = F.when(F.col("neg_zh").isNotNull(), F.instr("zh_flat", F.col("neg_zh"))).otherwise(0)
    before = F.substring(F.col("zh_flat"), F.lit(1), at - 1)
    zh_no = F.lit(False)
    for w in V.ZH_NEGATIONS:
        zh_no = zh_no | before.endswith(w)
    en_no = (F.size("neg_en") > 0) & (F.size("without_words") > 0) & (F.size(F.array_except("neg_en", "without_words")) == 0)
    negated = (F.coalesce(at > 1, F.lit(False)) & zh_no) | en_no
    one = F.lit(1.0)
    m = F.when(F.col("use") == 0, V.HEADER).otherwise(one) * F.when(F.col("elsewhere"), V.MANIFESTATION).otherwise(one)
    m = m * F.when(F.coalesce(negated, F.lit(False)), V.NEGATION).otherwise(one) * F.when(~F.coalesce("pregnant", F.lit(False)) & F.col("code").startswith("O"), V.OBSTETRIC).otherwise(one)
    return j.withColumn("score", F.when(F.col("kind") == "code", F.col("s")).otherwise(F.col("s") * m)).select("qid", "code", "zh", "en", "use", "score", "atm", "def", "kind")


def explain(rows: DataFrame, q: DataFrame, ix: Index, fold: bool = True) -> DataFrame:
    """rows with the field that shows most of the query's words; titles win ties."""
    asked = q.select("qid", F.array_distinct(X.tokens(X.normalise(F.col("text"), fold))).alias("want"))
    top = rows.select("qid", "code", "zh", "en")
    titles = top.select("qid", "code", F.posexplode(F.array("zh", "en")).alias("ord", "text"), F.lit(-1).alias("src_id"))
    entries = top.select("qid", "code").join(ix.terms.select("code", "ord", "text", "src_id"), "code").select("qid", "code", (F.col("ord") + 2).alias("ord"), "text", "src_id")
    t = titles.union(entries).join(asked, "qid")
    n = F.size(F.array_intersect("want", F.array_distinct(X.tokens(X.normalise(F.col("text"), fold)))))
    rate = F.struct((n - F.when(F.col("src_id") < 0, 0.0).otherwise(0.1)).alias("n"), (-F.col("ord")).alias("o"))
    found = t.groupBy("qid", "code").agg(F.max_by(F.struct("text", "src_id"), rate).alias("why"))
    return rows.join(found, ["qid", "code"], "left")


def search(queries: DataFrame, ix: Index, limit: int = V.LIMIT, fold: bool = True, scope: str = "cm") -> DataFrame:
    """queries(qid, raw) to ranked (qid, rank, code, zh, en, use, score, atm, def, kind, why)."""
    spark = queries.sparkSession
    keep = lambda df, name: stage(spark, df, f"search-{name}")  # noqa: E731  used by several later steps
    q = queries.select("qid", R.parsed(F.col("raw"), scope).alias("p")).select("qid", "p.text", "p.codes", "p.neg", (~F.col("p.noexp")).alias("explode"), F.col("p.code").alias("codes_only"))
    q = keep(q, "queries")
    typed = code_hits(q, ix.codes)
    words = corrected(q.where("text <> '' and not codes_only"), ix, fold).withColumn("side", R.side("text"))
    keys = ix.phrases.select(F.col("key").alias("whole_key")).distinct().withColumn("is_term", F.lit(True))
    words = words.withColumn("whole_key", X.phrase_key(X.normalise(F.col("text"), fold))).join(keys, "whole_key", "left")
    words = words.withColumn("atm", F.when(F.col("side.lat").isNotNull() & F.col("is_term").isNull(), F.col("side.strip")).otherwise(F.col("text"))).drop("whole_key", "is_term")
    words = keep(words, "words")
    segs = keep(segments(words, ix, fold), "segments")
    concepts, sets = segment_sets(segs, words, ix)
    concepts, sets = keep(concepts, "concepts"), keep(sets, "sets")
    alts, live = query_tokens(words, ix, fold)
    alts = keep(alts, "tokens")
    live = alts.groupBy("qid").agg(F.countDistinct("qi").alias("live"))
    single = words.where(F.col("text").rlike(f"^[{V.CJK}]$")).select("qid", "text")
    scores = keep(bm25(alts, ix.postings, ix.tokens).union(prefixless_scan(single, ix)), "scores")
    live = live.union(single.select("qid", F.lit(1).cast("long"))).groupBy("qid").agg(F.max("live").alias("live"))
    is_whole = segs.where("whole").select("qid")
    whole = whole_mapping(sets.join(is_whole, "qid", "left_semi"), concepts.join(is_whole, "qid", "left_semi"), scores, ix)
    split = segmented_mapping(segs.where("not whole"), sets.join(is_whole, "qid", "left_anti"), scores, live, alts, fold)
    text = free_text(scores, live).select("qid", "code", "s", F.lit("text").alias("kind"), F.lit(False).alias("atm"), F.lit(False).alias("def"))
    merged = keep(drop_negated(best(typed.union(whole).union(split).union(text)), q, ix, fold), "merged")
    merged = keep(lateralize(merged, words, concepts, scores, ix, fold), "reranked")
    final_text = q.select("qid", F.col("text").alias("asked")).join(words.select("qid", "text"), "qid", "left").select("qid", F.coalesce("text", "asked").alias("text"))
    ranked = keep(top_rows(demoted(merged, final_text, ix, fold), ["qid"], [F.desc("score"), F.asc("code")], limit), "ranked")
    return explain(ranked, final_text, ix, fold).withColumn("score", F.round("score", 2))


def prefixless_scan(single: DataFrame, ix: Index) -> DataFrame:
    """A query of one Chinese character: titles that hold it. Characters of titles are
    the join key, so the scan is an equi-join."""
    chars = ix.codes.select("code", F.explode(F.array_distinct(F.split("zh", ""))).alias("text"))
    one = F.lit(1).cast("long")
    return single.join(chars, "text").select("qid", "code", F.lit(1.0).alias("score"), one.alias("hit"), one.alias("mask"))
