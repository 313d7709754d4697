"""Code algebra: canonical forms, prefixes, ranges, crosswalk flags, note specs."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def canonical(s: Column) -> Column:
    """``l400`` and ``L40.0`` as ``L40.0``; null if it is no diagnosis code."""
    t = F.regexp_replace(F.upper(F.trim(s)), r"\s+", "")
    shape = r"^([A-Z])([0-9])([0-9A-Z])(?:\.?([0-9A-Z]{1,4}))?$"
    head = F.regexp_extract(t, shape, 1), F.regexp_extract(t, shape, 2), F.regexp_extract(t, shape, 3)
    tail = F.regexp_extract(t, shape, 4)
    return F.when(t.rlike(shape), F.when(tail == "", F.concat(*head)).otherwise(F.concat(*head, F.lit("."), tail)))


#: What the source writes for a row's change, and its short form.
STATUS = {"代碼新增": "new", "英文名稱修改": "en", "中文名稱修改": "zh"}


def status(s: Column) -> Column:
    """A row's change as a short form; null for none and for unknown ones."""
    out = F.lit(None).cast("string")
    for long, short in STATUS.items():
        out = F.when(F.trim(s) == long, short).otherwise(out)
    return out


def dotted(s: Column) -> Column:
    t = F.upper(F.trim(s))
    return F.when((F.length(t) <= 3) | t.contains("."), t).otherwise(F.concat(F.substring(t, 1, 3), F.lit("."), F.substr(t, F.lit(4))))


def undotted(s: Column) -> Column:
    return F.replace(F.regexp_replace(s, r"[-.]+$", ""), F.lit("."), F.lit(""))


def is_diagnosis(s: Column) -> Column:
    return s.rlike(r"^[A-Z][0-9][0-9A-Z](\.[0-9A-Z]{1,4})?$")


def is_procedure(s: Column) -> Column:
    return s.rlike(r"^[0-9A-HJ-NP-Z]{7}$")


def lineage(code: Column) -> Column:
    """The code and every prefix down to three characters, longest first."""
    n = F.length(code)
    cuts = F.transform(F.sequence(n, F.least(n, F.lit(3)), F.lit(-1)), lambda i: F.regexp_replace(F.substring(code, F.lit(1), i), r"\.$", ""))
    return F.when(n <= 3, F.array(code)).otherwise(F.array_distinct(cuts))


def shard_key(code: Column) -> Column:
    c = F.upper(F.substring(code, 1, 1))
    return F.when(c.rlike("^[0-9A-Z]$"), c).otherwise(F.lit("_"))


def in_range(code: Column, first: Column, last: Column) -> Column:
    """Between two codes, the last one's descendants included."""
    return (code >= first) & ((code <= last) | code.startswith(last))


def matches(code: Column, spec: Column) -> Column:
    """A code against a spec (struct of first, last, prefix)."""
    return F.when(spec["prefix"].isNotNull(), code.startswith(spec["prefix"])).otherwise(in_range(code, spec["first"], spec["last"]))


CODE = r"[A-Z][0-9][0-9A-Z](?:\.[0-9A-Z]{0,4})?(?:-(?!\s*[A-Z][0-9]))?"


def _bare(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(c, r"\.?-$", ""), r"\.$", "")


def specs(text: Column) -> Column:
    """Codes, prefixes (``E08.-``) and ranges (``A00-A09``) inside parentheses."""
    inner = F.regexp_extract_all(text, F.lit(r"\(([^()]*)\)"), F.lit(1))
    found = F.flatten(F.transform(inner, lambda x: F.regexp_extract_all(x, F.lit(f"({CODE}(?:\\s*-\\s*{CODE})?)"), F.lit(1))))
    two = f"^({CODE})\\s*-\\s*({CODE})$"

    def parse(x: Column) -> Column:
        a, b = _bare(F.regexp_extract(x, two, 1)), _bare(F.regexp_extract(x, two, 2))
        none = F.lit(None).cast("string")
        return F.when(x.rlike(two), F.struct(a.alias("first"), b.alias("last"), none.alias("prefix"))).otherwise(
            F.struct(none.alias("first"), none.alias("last"), _bare(x).alias("prefix"))
        )

    return F.transform(found, parse)


def common_prefix(a: Column, b: Column) -> Column:
    n = F.aggregate(
        F.sequence(F.lit(1), F.greatest(F.least(F.length(a), F.length(b)), F.lit(1))),
        F.lit(0),
        lambda acc, i: F.when((acc == i - 1) & (F.length(a) >= i) & (F.length(b) >= i) & (F.substring(a, i, F.lit(1)) == F.substring(b, i, F.lit(1))), i).otherwise(acc),
    )
    return F.substring(a, F.lit(1), n)


def gem_flag(flag: Column) -> Column:
    """The five marks of a crosswalk flag, as text."""
    at = lambda i: F.substring(flag, i, 1)
    parts = [
        F.when(at(2) == "1", F.lit("no map")),
        F.when(at(1) == "1", F.lit("approximate")).otherwise(F.lit("exact")),
        F.when(at(3) == "1", F.concat(F.lit("combination "), at(4), F.lit("/"), at(5))),
    ]
    return F.concat_ws(", ", *parts)


def chapter_range(text: Column) -> Column:
    p = r"\(([A-Z0-9]{3})-([A-Z0-9]{3})\)"
    return F.struct(F.nullif(F.regexp_extract(text, p, 1), F.lit("")).alias("first"), F.nullif(F.regexp_extract(text, p, 2), F.lit("")).alias("last"))


def roc_date(s: Column) -> Column:
    """``115/6/1``, ``1150601`` (years since 1911) and ``20260601`` as dates; the
    open end ``9991231`` and anything invalid as null."""
    slashed = r"^([0-9]{2,3})/([0-9]{1,2})/([0-9]{1,2})$"
    seven = r"^([0-9]{3})([0-9]{2})([0-9]{2})$"
    eight = r"^([0-9]{4})([0-9]{2})([0-9]{2})$"

    def made(p: str, plus: int) -> Column:
        y, m, d = (F.regexp_extract(s, p, i) for i in (1, 2, 3))
        return F.to_date(F.try_to_timestamp(F.concat_ws("-", (y.cast("int") + plus).cast("string"), F.lpad(m, 2, "0"), F.lpad(d, 2, "0")), F.lit("yyyy-MM-dd")))

    return F.when(s == "9991231", None).when(s.rlike(slashed), made(slashed, 1911)).when(s.rlike(seven), made(seven, 1911)).when(s.rlike(eight), made(eight, 0))


def revision_dates(text: Column) -> Column:
    """All slashed dates in a text, distinct and in order."""
    found = F.regexp_extract_all(text, F.lit(r"([0-9]{2,3}/[0-9]{1,2}/[0-9]{1,2})"), F.lit(1))
    return F.array_sort(F.array_distinct(F.filter(F.transform(found, roc_date), lambda d: d.isNotNull())))


def freshness(day: Column, today: Column, stale: int = 21) -> Column:
    age = F.datediff(today, day)
    return F.struct(age.alias("days"), (age > stale).alias("stale"))
