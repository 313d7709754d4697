"""Personal data by anchor expansion.

One Aho-Corasick automaton finds anchors: at-signs, scheme marks, plus signs,
digit pairs (with one dot, space or hyphen between, or none) and identifier
cues. From an anchor a deterministic parser walks left and right as far as the
kind's alphabet allows, validates (octet range, Luhn, digit count, IBAN mod 97)
and fixes the boundary. Text without an anchor costs one pass of the automaton.

Base kinds, leftmost and non-overlapping per kind: email, ip, card, phone.
Added kinds: url (credentials in a URL, ``scheme://user:password@``), iban
(after the cue IBAN, checked by mod 97), secret (well-known key prefixes).
Offsets are code points, end exclusive. Null text counts as empty.
"""

from __future__ import annotations

import hashlib
import re

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StringType

from .common import prepare, read

BASE = ("email", "ip", "card", "phone")
KINDS = BASE + ("url", "iban", "secret")
DIGITS = "0123456789"
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
LABEL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-")
ALNUM = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789")
PHONE = frozenset(" ().-" + DIGITS)
DIGIT = frozenset(DIGITS)
CUES = {"IBAN": "iban", "ghp_": "secret", "sk-": "secret", "AKIA": "secret"}
SECRET_LENGTH = {"ghp_": 36, "sk-": 20, "AKIA": 16}


def _automaton() -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    a.add_word("@", ("at", 1))
    a.add_word("://", ("scheme", 3))
    for x in DIGITS:
        a.add_word("+" + x, ("plus", 2))
        for y in DIGITS:
            for sep in ("", " ", "-"):
                a.add_word(x + sep + y, ("pair", 2 + len(sep)))
            a.add_word(f"{x}.{y}", ("dot", 3))
    for cue, kind in CUES.items():
        a.add_word(cue, (kind, len(cue)))
    a.make_automaton()
    return a


_machine: list[ahocorasick.Automaton] = []


def machine() -> ahocorasick.Automaton:
    if not _machine:
        _machine.append(_automaton())
    return _machine[0]


def _email(t: str, at: int, floor: int) -> tuple[int, int] | None:
    a = at
    while a > floor and t[a - 1] in LOCAL:
        a -= 1
    if a == at:
        return None
    n = len(t)
    z = at + 1
    while z < n and t[z] in LABEL:
        z += 1
    if z == at + 1:
        return None
    end = None
    while z + 1 < n and t[z] == "." and t[z + 1] in LABEL:
        z += 1
        while z < n and t[z] in LABEL:
            z += 1
        end = z
    return (a, end) if end else None


def _chain(t: str, a: int, z: int, seps: str) -> tuple[int, int]:
    """The maximal run of digits with single separators between them around t[a:z]."""
    n = len(t)
    while a > 0 and (t[a - 1] in DIGIT or (a > 1 and t[a - 1] in seps and t[a - 2] in DIGIT)):
        a -= 1 if t[a - 1] in DIGIT else 2
    while z < n and (t[z] in DIGIT or (z + 1 < n and t[z] in seps and t[z + 1] in DIGIT)):
        z += 1 if t[z] in DIGIT else 2
    return a, z


def luhn(digits: str) -> bool:
    s = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        s += d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return s % 10 == 0


def _ips(t: str, a: int, z: int) -> list[tuple[int, int]]:
    parts, at, out = [], a, []
    for x in t[a:z].split("."):
        parts.append((at, at + len(x)))
        at += len(x) + 1
    for i in range(0, len(parts) - 3, 4):
        four = parts[i : i + 4]
        if all(len(v := t[x:y].lstrip("0")) <= 3 and int(v or 0) <= 255 for x, y in four):
            out.append((four[0][0], four[3][1]))
    return out


def _phone(t: str, plus: int) -> tuple[int, int] | None:
    z, n = plus + 2, len(t)
    while z < n and t[z] in PHONE:
        z += 1
    while z > plus + 1 and t[z - 1] not in DIGIT:
        z -= 1
    if z < plus + 4:
        return None
    return (plus, z) if 8 <= sum(c in DIGIT for c in t[plus:z]) <= 15 else None


def _url(t: str, scheme_end: int) -> tuple[int, int] | None:
    """scheme://user:password@ ; scheme_end is the index after '://'."""
    a = scheme_end - 3
    while a > 0 and t[a - 1] in ALNUM:
        a -= 1
    if a == scheme_end - 3:
        return None
    z, n, colon = scheme_end, len(t), False
    while z < n and not t[z].isspace() and t[z] not in "/@?#\"'<>":
        colon |= t[z] == ":"
        z += 1
    return (a, z + 1) if colon and z < n and t[z] == "@" else None


def _iban(t: str, cue_end: int) -> tuple[int, int] | None:
    n, a = len(t), cue_end
    while a < n and t[a] in ": \t":
        a += 1
    z, got = a, []
    while z < n and len(got) < 34:
        c = t[z]
        if c in ALNUM:
            got.append(c.upper())
            z += 1
        elif c == " " and z + 1 < n and t[z + 1] in ALNUM and len(got) % 4 == 0:
            z += 1
        else:
            break
    for size in range(len(got), 14, -1):
        s = "".join(got[:size])
        if s[:2].isalpha() and s[2:4].isdigit() and int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1:
            end, left = a, size
            while left:
                left -= t[end] in ALNUM
                end += 1
            return a, end
    return None


def _secret(t: str, a: int, z: int) -> tuple[int, int] | None:
    need, e = SECRET_LENGTH[t[a:z]], z
    while e < len(t) and t[e] in ALNUM:
        e += 1
    return (a, e) if e - z >= need and (a == 0 or t[a - 1] not in ALNUM) else None


def find(t: str) -> dict[str, list[tuple[int, int]]]:
    """Spans by kind, in order of start."""
    out: dict[str, list[tuple[int, int]]] = {k: [] for k in KINDS}
    done = dict.fromkeys(KINDS, 0)
    for last, (anchor, size) in machine().iter(t):
        a, z = last - size + 1, last + 1
        if anchor == "at":
            if a >= done["email"] and (s := _email(t, a, done["email"])):
                out["email"].append(s)
                done["email"] = s[1]
        elif anchor == "dot":
            if a >= done["ip"]:
                a, z = _chain(t, a, z, ".")
                out["ip"] += _ips(t, a, z)
                done["ip"] = z
        elif anchor == "pair":
            if a >= done["card"]:
                a, z = _chain(t, a, z, " -")
                digits = t[a:z].replace(" ", "").replace("-", "")
                if 16 <= len(digits) <= 19 and luhn(digits):
                    out["card"].append((a, z))
                done["card"] = z
        elif anchor == "plus":
            if s := _phone(t, a):
                out["phone"].append(s)
        else:
            s = _url(t, z) if anchor == "scheme" else _iban(t, z) if anchor == "iban" else _secret(t, a, z)
            kind = "url" if anchor == "scheme" else anchor
            if s and s[0] >= done[kind]:
                out[kind].append(s)
                done[kind] = s[1]
    return out


def listed(spans: dict[str, list[tuple[int, int]]], kinds: tuple[str, ...]) -> str:
    return ",".join(f"{k}:{a}:{z}" for k in kinds for a, z in spans[k])


def mask(t: str, spans: dict[str, list[tuple[int, int]]]) -> str:
    """The text with each span replaced by its kind; overlapping spans become one."""
    flat = sorted((a, -z, k) for k in KINDS for a, z in spans[k])
    out, at = [], 0
    for a, z, k in flat:
        if a >= at:
            out += [t[at:a], f"<{k.upper()}>"]
        at = max(at, -z)
    return "".join([*out, t[at:]])


def _scan(batches):
    for b in batches:
        rows = []
        for t in b.column("text").to_pylist():
            s = find(t or "")
            rows.append([*(len(s[k]) for k in BASE), hashlib.sha256(listed(s, BASE).encode()).hexdigest(), listed(s, KINDS)])
        cols = list(zip(*rows)) if rows else [[]] * 6
        yield pa.RecordBatch.from_arrays(
            [b.column("doc_id"), *(pa.array(c, pa.int64()) for c in cols[:4]), *(pa.array(c, pa.string()) for c in cols[4:])],
            ["doc_id", *(f"n_{k}" for k in BASE), "base_sha256", "spans"],
        )


def find_pii(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """One row per row of docs(doc_id, text): counts, digest and list of spans."""
    prepare(spark)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(
        _scan, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"
    )


@F.pandas_udf(StringType())
def redacted(text):
    """Text with personal data masked; null stays null."""
    return text.map(lambda t: mask(t, find(t)), na_action="ignore")


def op9_anchor_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_pii(spark, read(spark, sf_dir, "documents"))


# the contract's patterns, for tests
EMAIL_RE = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP_RE = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD_RE = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE_RE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
