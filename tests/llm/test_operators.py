"""Each operator against a brute-force version, on a fixture of odd cases."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from termloom.llm import components, decontam, licenses, neardup, packing, pii, quality, sharding, suffixdedup, tokens, topk, wavelet

from .fixtures import documents, empty

VOCAB = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def docs(spark):
    return documents(spark).cache()


@pytest.fixture(scope="module")
def rows(docs):
    return docs.select("doc_id", "text").collect()


# --- 1 -------------------------------------------------------------------------
def test_suffix_dedup(spark, docs, rows):
    least: dict[bytes, int] = {}
    known = [(r.doc_id, (r.text or "").encode()) for r in rows if r.doc_id is not None]
    for d, b in known:
        for i in range(len(b) - 49):
            least[b[i : i + 50]] = min(d, least.get(b[i : i + 50], d))
    want = Counter()
    for d, b in [*known, *((None, (r.text or "").encode()) for r in rows if r.doc_id is None)]:
        gone = np.zeros(len(b) + 1, bool)
        for i in range(len(b) - 49):
            if d is not None and least[b[i : i + 50]] < d:
                gone[i : i + 50] = True
        spans = int((gone[:-1] & ~np.concatenate([[False], gone[:-2]])).sum()) if b else 0
        kept = bytes(x for x, g in zip(b, gone) if not g)
        want[d, len(b), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()] += 1
    got = Counter(tuple(r) for r in suffixdedup.substring_dedup(spark, docs).collect())
    assert got == want
    assert any(n for (_, _, n, _, _) in want)


@pytest.mark.parametrize("hot", [1, suffixdedup.HOT])
def test_partly_shared_passage_repeated_in_one_document(spark, hot):
    rng = random.Random(9)
    word = lambda n, abc: "".join(rng.choice(abc) for _ in range(n))
    line, shared, x, y = word(60, "abcdef ") + "\n", word(70, "ghijkl "), word(200, "mnopqr "), word(200, "mnopqr ")
    texts = [
        (1, word(150, "stuvw ") + line + word(150, "stuvw ")),
        (2, line * 6 + word(90, "xyz ") + line * 5),
        (3, word(100, "ABCD ") + shared + word(100, "ABCD ")),
        (4, x + shared + y + word(120, "EFGH ") + x + shared + y),
        (4, word(80, "IJKL ") + x + shared + y),
        (5, line * 3 + x + shared + y),
    ]
    least: dict[str, int] = {}
    for d, t in texts:
        for i in range(len(t) - 49):
            least[t[i : i + 50]] = min(d, least.get(t[i : i + 50], d))
    want = Counter()
    for d, t in texts:
        gone = np.zeros(len(t), bool)
        for i in range(len(t) - 49):
            if least[t[i : i + 50]] < d:
                gone[i : i + 50] = True
        want[d, len(t), int(gone.sum()), hashlib.sha256("".join(c for c, g in zip(t, gone) if not g).encode()).hexdigest()] += 1
    got = suffixdedup.substring_dedup(spark, documents(spark, [(d, t, None, None) for d, t in texts]), hot=hot).collect()
    assert Counter((r.doc_id, r.n_bytes, r.n_removed, r.kept_sha256) for r in got) == want


def test_hot_contexts_go_by_window(spark):
    rng = random.Random(3)
    shared = "".join(rng.choice("abcdef ") for _ in range(120))
    rows = [(i, "".join(rng.choice("ghijkl ") for _ in range(60)) + shared + "".join(rng.choice("mnopqr ") for _ in range(60)), None, None) for i in range(30)]
    plain = sorted(map(tuple, suffixdedup.substring_dedup(spark, documents(spark, rows)).collect()))
    hot = sorted(map(tuple, suffixdedup.substring_dedup(spark, documents(spark, rows), hot=3).collect()))
    assert hot == plain
    assert sum(r[2] >= 120 for r in plain) == 29


def test_texts_are_dealt_once(spark, tmp_path, monkeypatch):
    """The steps that read whole texts share one exchange of them."""
    monkeypatch.setattr(suffixdedup, "table", lambda spark, df, name: df, raising=False)
    documents(spark).write.parquet(f"{tmp_path}/documents.parquet")
    out = suffixdedup.op1_suffix_dedup(spark, str(tmp_path))
    out.collect()
    plan = spark._jvm.PythonSQLUtils.explainString(out._jdf.queryExecution(), "formatted")
    final, details = plan.split("== Initial Plan ==")
    made = set(re.findall(r"\bExchange \((\d+)\)", final))
    inputs = dict(re.findall(r"^\((\d+)\) Exchange\nInput \[\d+\]: (.*)$", details, re.M))
    assert made and made <= set(inputs)
    assert sum("text#" in inputs[n] for n in made) == 1


def test_only_contexts_that_share_a_side_are_open():
    """Texts with a passage too short to be removed, but longer than an anchor's gram, have
    keys in common and nothing for the merge; passages of SPAN bytes at any place have."""
    rng = random.Random(4)
    word = lambda n: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(n))
    states, short = {}, word(26)
    for size in (26, 50):
        shared = short if size == 26 else word(50)
        texts = [word(rng.randint(0, 200)) + shared + word(rng.randint(0, 200)) for _ in range(40)]
        t = pa.table({"doc_id": pa.array(range(40), pa.int64()), "th": pa.array(range(40), pa.int64()), "text": texts, "bucket": pa.array([0] * 40, pa.int64())})
        sent = suffixdedup._send(1)(t)
        states[size] = np.concatenate([np.frombuffer(x, np.uint8) for b in suffixdedup._meet(suffixdedup.HOT)(iter(sent.to_batches())) for x in b.column("states").to_pylist()])
    assert (states[26] == suffixdedup.SETTLED).all()
    assert (states[50] > suffixdedup.COPY).sum() >= 40


@pytest.mark.parametrize("hot", [1, suffixdedup.HOT])
def test_passages_of_every_length_at_every_place(spark, hot):
    """Passages around SPAN bytes, at the texts' ends too, shift the anchor over all places."""
    rng = random.Random(8)
    word = lambda n, abc="abcdefgh ": "".join(rng.choice(abc) for _ in range(n))
    source = word(4000)
    texts = [(0, source)]
    for d in range(1, 150):
        n, a = rng.randint(40, 75), rng.randint(0, 3900)
        texts.append((d, word(rng.choice([0, 3, 14, 15, 16, 29, 30, 31, 90])) + source[a : a + n] + word(rng.choice([0, 3, 14, 15, 16, 29, 30, 31, 90]))))
    least: dict[str, int] = {}
    for d, t in texts:
        for i in range(len(t) - 49):
            least[t[i : i + 50]] = min(d, least.get(t[i : i + 50], d))
    want = {}
    for d, t in texts:
        gone = np.zeros(len(t), bool)
        for i in range(len(t) - 49):
            if least[t[i : i + 50]] < d:
                gone[i : i + 50] = True
        want[d] = (int(gone.sum()), hashlib.sha256("".join(c for c, g in zip(t, gone) if not g).encode()).hexdigest())
    got = suffixdedup.substring_dedup(spark, documents(spark, [(d, t, None, None) for d, t in texts]), hot=hot).collect()
    assert {r.doc_id: (r.n_removed, r.kept_sha256) for r in got} == want
    assert sum(n > 0 for n, _ in want.values()) > 80


def test_repeated_matches_brute_force():
    rng = random.Random(5)
    texts = ["".join(rng.choice("ab") for _ in range(rng.randint(0, 40))).encode() for _ in range(40)]
    docs = np.array([rng.randint(0, 12) for _ in texts])
    for span, shard in ((6, 7), (9, 100)):
        least: dict[bytes, int] = {}
        for d, t in zip(docs.tolist(), texts):
            for i in range(len(t) - span + 1):
                least[t[i : i + span]] = min(d, least.get(t[i : i + span], d))
        want = {(x, i) for x, (d, t) in enumerate(zip(docs.tolist(), texts)) for i in range(len(t) - span + 1) if least[t[i : i + span]] < d}
        assert {(int(x), int(i)) for x, i in zip(*suffixdedup.repeated(texts, docs, span, shard))} == want


# --- 2 -------------------------------------------------------------------------
def brute_components(rows, k, percent):
    sets: dict[int, list[frozenset]] = defaultdict(list)
    for r in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), r.text or ""))
        if r.doc_id is not None:
            sets[r.doc_id].append(frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)]) if w else frozenset())
    parent = {d: d for d in sets}

    def root(a):
        while parent[a] != a:
            a = parent[a]
        return a

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            for x in sets[a]:
                for y in sets[b]:
                    if a < b and x and y and 100 * len(x & y) >= percent * len(x | y):
                        p, q = sorted((root(a), root(b)))
                        parent[q] = p
    return {d: root(d) for d in ids}, sets


@pytest.mark.parametrize("k, percent", [(3, 85), (5, 80)])
def test_near_duplicates(spark, docs, rows, k, percent):
    want, sets = brute_components(rows, k, percent)
    got = neardup.near_duplicates(spark, docs, k, percent).collect()
    assert len(got) == len(rows)
    for r in got:
        if r.doc_id is None:
            assert r.component_id is None and r.kept
        else:
            assert (r.component_id, r.kept) == (want[r.doc_id], want[r.doc_id] == r.doc_id)
            assert r.n_shingles in {len(s) for s in sets[r.doc_id]}
    assert len(set(want.values())) < len(want)


def test_components(spark):
    edges = [(i, i + 1) for i in range(1, 60)] + [(100, 101), (105, 101), (7, 7)]
    got = dict(map(tuple, components.connected_components(spark.createDataFrame(edges, "u long, v long")).collect()))
    assert all(got[i] == 1 for i in range(2, 61)) and got[101] == got[105] == 100


# --- 3 -------------------------------------------------------------------------
@pytest.mark.parametrize(
    "text, want",
    [
        ("foo.\nReleased under the MIT License.\nbar", ["MIT"]),
        ("Licensed under the Apache License, Version 2.0. And more text.", ["Apache-2.0"]),
        ("This work is licensed under the GNU General Public License, version 3.", ["GPL-3.0"]),
        ("no licence here, though a license is named", []),
        ("", []),
        (
            "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:\n"
            "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.\n"
            "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
            ["BSD-2-Clause"],
        ),
    ],
)
def test_license_rules(text, want):
    assert [x[0] for x in licenses.scan(text)] == want


MIT_TEXT = """MIT License
Copyright (c) 2020 A. Holder
Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT."""
BSD_TEXT = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution."""
ENDORSE = """

3. Neither the name of the copyright holder nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission."""
GPL_TEXT = """    This program is free software: you can redistribute it and/or modify
    it under the terms of the GNU General Public License as published by
    the Free Software Foundation, either version 3 of the License, or
    (at your option) any later version.

    This program is distributed in the hope that it will be useful,
    but WITHOUT ANY WARRANTY; without even the implied warranty of
    MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
    GNU General Public License for more details."""


@pytest.mark.parametrize("mark", ["", "# ", " * ", "// ", "rem "])
@pytest.mark.parametrize("line", ["\n", "\r\n"])
def test_wrapped_licence_texts(mark, line):
    for text, want, start, end in (
        (MIT_TEXT, ["MIT", "MIT"], "Permission", "NONINFRINGEMENT."),
        (BSD_TEXT, ["BSD-2-Clause"], "Redistribution and", "distribution."),
        (BSD_TEXT + ENDORSE, ["BSD-3-Clause"], "Redistribution and", "written permission."),
        (GPL_TEXT, ["GPL-3.0"], "This program is free", "PARTICULAR PURPOSE."),
    ):
        t = line.join(mark + x for x in f"some words\n\n{text}\n\nmore words".split("\n"))
        got = licenses.scan(t)
        assert [x[0] for x in got] == want
        found = t[got[-1][1] : got[-1][2]]
        assert start in found[: len(mark) + 6 + len(start)] and found.endswith(end)


def test_lines_without_marks_keep_their_own_sentences():
    flat = [" ".join(x.split()).rstrip(".:") for x in MIT_TEXT[MIT_TEXT.index("Permission") :].split("\n\n")]
    got = licenses.scan("\n".join(["title", *flat, "more"]))
    assert [x[0] for x in got] == ["MIT"]
    got = licenses.scan("MIT License\nnext words follow\nLicensed under CC BY 4.0")
    assert [x[0] for x in got] == ["MIT", "CC-BY-4.0"]


def test_sentences_of_any_length():
    grant = " ".join(MIT_TEXT[MIT_TEXT.index("Permission") :].split()).lower()
    assert [x[0] for x in licenses.scan(grant + " and so on" * 1000)] == ["MIT"]
    assert [x[0] for x in licenses.scan("Released" + " " * 5000 + "under the MIT License.")] == ["MIT"]


def test_every_license_sentence_is_known_and_has_a_cue():
    for name, s in licenses.SENTENCES:
        assert licenses.identify(s.replace("*", "x y")) == name and licenses.CUE.search(s)


@pytest.mark.parametrize(
    "text, want",
    [
        ("// SPDX-License-Identifier: MIT", ["MIT"]),
        ("/* SPDX-License-Identifier: BSD-3-Clause */", ["BSD-3-Clause"]),
        ("# SPDX-License-Identifier: (MIT OR Apache-2.0) AND GPL-2.0-only WITH Classpath-exception-2.0", ["MIT", "Apache-2.0", "GPL-2.0"]),
        ("SPDX-License-Identifier: LicenseRef-own", []),
        ("This project is released under the MIT License.", ["MIT"]),
        ("The software is licensed under the terms of the\nGNU General Public License, version 3, or later.", ["GPL-3.0"]),
        ("Released under CC BY-SA 4.0.", ["CC-BY-SA-4.0"]),
        ("This dataset is available under the Creative Commons Attribution 4.0 International Licence.", ["CC-BY-4.0"]),
        ("The bridge lies under the MIT building.", []),
    ],
)
def test_tags_and_names(text, want):
    assert [x[0] for x in licenses.scan(text)] == want


def test_rules_match_brute_force():
    """Random orders of known sentences and others, one a line, against a plain matcher."""
    rng = random.Random(8)
    known = [(name, s.replace("*", "some words")) for name, s in licenses.SENTENCES if not s.endswith("*")]
    for _ in range(300):
        names, lines = [], []
        for _ in range(rng.randint(1, 14)):
            name, s = rng.choice(known) if rng.random() < 0.6 else (None, "Quite another sentence.")
            names.append(name)
            lines += [s, ""]
        want, i = [], 0
        while i < len(names):
            for licence, rule in licenses.RULES:
                at = [i]
                if names[i] != rule[0]:
                    continue
                for x in rule[1:]:
                    at.append(next((j for j in range(at[-1] + 1, min(len(names), at[-1] + licenses.GAP + 2)) if names[j] == x), -1))
                    if at[-1] < 0:
                        break
                if at[-1] >= 0:
                    want.append(licence)
                    i = at[-1]
                    break
            i += 1
        assert [x[0] for x in licenses.scan("\n".join(lines))] == want


def test_license_scan_of_odd_rows(spark, docs, rows):
    got = licenses.license_scan(spark, docs).collect()
    assert Counter((r.doc_id, r.n_rules, r.licences) for r in got) == Counter(
        (r.doc_id, len(x), ",".join(sorted({n for n, _, _ in x}))) for r in rows for x in [licenses.scan(r.text or "")]
    )


# --- 4 -------------------------------------------------------------------------
def test_shards(spark, docs, rows):
    got = sharding.shard(spark, docs, 4).collect()
    count = Counter(r.shard for r in got)
    assert len(got) == len(rows) and max(count.values()) - min(count.values()) <= 1
    for s in count:
        assert sorted(r.slot for r in got if r.shard == s) == list(range(count[s]))
    want = Counter((r.doc_id, len((r.text or "").encode()) + 16, zlib.crc32((r.text or "").encode())) for r in rows)
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in got) == want
    order = sorted(got, key=lambda r: (r.shard, r.slot))
    assert [r.hilbert for r in order] == sorted(r.hilbert for r in got)


def test_hilbert_curve_visits_neighbours():
    side = np.arange(8)
    cells = np.array(np.meshgrid(side, side, side)).reshape(3, -1).T
    h = sharding.hilbert_index(cells, 3)
    assert sorted(h.tolist()) == list(range(512))
    path = cells[np.argsort(h)]
    assert (np.abs(np.diff(path, axis=0)).sum(axis=1) == 1).all()


# --- 5 -------------------------------------------------------------------------
def test_topk(spark, monkeypatch):
    rng = np.random.default_rng(1)
    rows = [(i, [float(x) for x in rng.integers(-3, 4, 6) / 4]) for i in range(120)]
    rows += [(200, None), (201, [1.0, None]), (202, [float("nan"), 1.0]), (203, [float("inf")]), (204, []), (None, [1.0]), (205, [0.0] * 6)]
    rows += [rows[0], rows[0], (5, [float(x) for x in rng.integers(-3, 4, 6) / 4]), rows[7]]  # repeated rows and ids
    df = spark.createDataFrame([(i, v, 1, 2, 3) for i, v in rows], "id long, v array<float>, rank int, no long, qb long").repartition(3)
    good = [(i, np.floor(1024 * np.array(v, np.float32).astype(float)).astype(np.int64)) for i, v in rows if i is not None and v and i not in (201, 202, 203)]
    want = Counter()
    for x, (q, v) in enumerate(good):
        if q % 5 == 0:
            best = sorted((-int(v @ w), c) for y, (c, w) in enumerate(good) if y != x)[:10]
            want.update((q, k + 1, c, -s) for k, (s, c) in enumerate(best))
    monkeypatch.setattr(topk, "BLOCK", 16)
    monkeypatch.setattr(topk, "QUERIES", 8)
    got = topk.exact_topk(spark, df, F.col("id") % 5 == 0, 10)
    assert Counter(map(tuple, got.collect())) == want


@pytest.mark.parametrize("big", [3e9, 1e300])
def test_topk_scores_beyond_a_long_raise(spark, big):
    df = spark.createDataFrame([(0, [big]), (1, [big])], "id long, v array<double>")
    with pytest.raises(Exception, match="exceed"):
        topk.exact_topk(spark, df, F.col("id") == 0).collect()


def test_topk_with_few_rows_and_none(spark):
    df = spark.createDataFrame([(0, [1.0]), (5, [2.0])], "id long, v array<float>")
    assert sorted(map(tuple, topk.exact_topk(spark, df, F.lit(True), 10).collect())) == [(0, 1, 5, 1024 * 2048), (5, 1, 0, 1024 * 2048)]
    assert topk.exact_topk(spark, df.limit(0), F.lit(True), 10).count() == 0


def test_threshold_walk_stops_early():
    rng = np.random.default_rng(2)
    vecs = np.zeros((4000, 3), np.int64)
    vecs[:, 0] = rng.integers(0, 100, 4000)
    vecs[:20, 0] = 1000
    seen = []
    ids = np.arange(4000)
    got = list(topk.threshold_topk(ids, ids, vecs, np.array([-1]), np.array([[1, 0, 0]]), 10))
    seen.append(got[0][1].tolist())
    assert seen == [list(range(10))]


# --- 6 -------------------------------------------------------------------------
def test_encoder_is_exact(rows):
    import pyarrow as pa

    full = Tokenizer.from_file(VOCAB)
    texts = [r.text for r in rows] + ["'s 'll I'VE ''s x'", "12 1.2,3 a1b2", "ÀÉ×÷ß é, \x1c a\x85b", "<|startoftext|>", "w" * 5000]
    ids, at = tokens.encoder(VOCAB).encode(pa.array(texts))
    for i, t in enumerate(texts):
        assert ids[at[i] : at[i + 1]].tolist() == full.encode(t or "", add_special_tokens=False).ids


def test_encoder_cuts_very_long_texts(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(tokens, "GROUP_BYTES", 50)
    full = Tokenizer.from_file(VOCAB)
    texts = ["", "some words, and more " * 20, "", "x" * 300, None, "end here"]
    ids, at = tokens.Encoder(VOCAB).encode(pa.array(texts))
    for i, t in enumerate(texts):
        assert ids[at[i] : at[i + 1]].tolist() == full.encode(t or "", add_special_tokens=False).ids


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 40), max_size=700))
def test_wavelet_matrix(symbols):
    a = np.array(symbols, np.uint16)
    payload = wavelet.write_file([5, None], np.array([len(a), 0]), a)
    ids, lens, w = wavelet.read_file(payload)
    assert ids == [5, None] and w.decode().tolist() == symbols
    for i in range(0, len(symbols), 37):
        assert w.access(i) == symbols[i]
    for s in {0, 3, 41, *symbols[:3]}:
        where = [i for i, x in enumerate(symbols) if x == s]
        assert w.count(s) == len(where) and w.occurrences(s) == where
        assert w.rank(s, len(symbols) // 2) == sum(i < len(symbols) // 2 for i in where)


def test_token_files(spark, docs, rows):
    full = Tokenizer.from_file(VOCAB)
    got = sorted(wavelet.read_tokens(spark, wavelet.write_tokens(spark, docs, VOCAB)).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == sorted((r.doc_id for r in rows), key=lambda d: (d is not None, d))
    texts = defaultdict(list)
    for r in rows:
        texts[r.doc_id].append(np.array(full.encode(r.text or "", add_special_tokens=False).ids + [2], "<u4"))
    at = 0
    for r in got:
        assert r.start == at and (r.n_tokens, r.ids_crc32) in {(len(x), zlib.crc32(x.tobytes())) for x in texts[r.doc_id]}
        at += r.n_tokens


# --- 7 -------------------------------------------------------------------------
def test_decontamination_recall(spark):
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefghijklm") for _ in range(rng.randint(3, 8)))
    items = [(i, [word() for _ in range(rng.randint(12, 60))]) for i in range(30)]
    rows, want = [], {}
    for d in range(300):
        i, w = rng.choice(items)
        k = rng.randint(0, int(0.2 * len(w)))
        x = list(w)
        for _ in range(k):
            p = rng.randrange(len(x))
            kind = rng.random()
            if kind < 0.6:
                x[p] = word()
            elif kind < 0.8:
                x.pop(p)
            else:
                x.insert(p, word())
        hay = [word() for _ in range(80)]
        hay[40:40] = x
        rows.append((d, " ".join(hay).capitalize(), None, None))
        n = len(w)
        most = int(0.2 * n)
        hay_ = [""] * most + [h.lower() for h in hay] + [""] * most
        best = min(_distance(w, hay_[s : s + n]) for s in range(len(hay_) - n + 1))
        if best <= int(0.2 * n):
            want[d, i] = best
    rows += [(900, None, None, None), (901, "", None, None), (902, " ".join(word() for _ in range(500)), None, None)]
    bench = spark.createDataFrame([(i, " ".join(w).upper()) for i, w in items] + [(77, None), (78, "a b")], "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.distance for r in decontam.contaminated(spark, documents(spark, rows), bench).collect()}
    assert all(got[k] >= want[k] for k in got) and set(got) <= set(want)
    assert len(got) >= 0.9 * len(want), (len(got), len(want))
    assert all(k in got for k, v in want.items() if v == 0)


@pytest.mark.parametrize("n", [12, 30, 60])
@pytest.mark.parametrize("kind", ["change", "drop", "add"])
def test_recall_at_the_greatest_distance(n, kind):
    """Of windows at exactly the edits allowed, at least 0.9 are found."""
    rng = random.Random(n)
    word = lambda: "".join(rng.choice("abcdefghijklm") for _ in range(rng.randint(3, 8)))
    items = [[word() for _ in range(n)] for _ in range(40)]
    book = decontam.Book(list(range(40)), [" ".join(w) for w in items])
    import pyarrow as pa

    found = total = 0
    for _ in range(3):
        for i, w in enumerate(items):
            k = int(0.2 * n) if kind == "change" else int(0.2 * n) // 2  # a drop or an addition costs one edit at a window's end as well
            x, at = list(w), sorted(rng.sample(range(1, n - 1), k), reverse=True)
            for p in at:
                x[p : p + (kind != "add")] = [word()] if kind != "drop" else []
            hay = [word() for _ in range(20)] + x + [word() for _ in range(20)]
            found += i in {g[1] for g in decontam._found(book, pa.array([" ".join(hay)]))}
            total += 1
    assert found >= 0.9 * total, (found, total)


def test_short_items_cut_leaks_and_missing_ids(spark):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefghijklm") for _ in range(rng.randint(3, 8)))
    long_, hay = [word() for _ in range(30)], [word() for _ in range(50)]
    rows = [
        (1, " ".join(hay + long_[:28]), None, None),
        (2, " ".join(long_[3:] + hay), None, None),
        (3, " ".join(long_[2:27]), None, None),
        (4, " ".join(hay[:20] + ["quite", "short"] + hay[20:]), None, None),
        (5, " ".join(hay + long_[:20]), None, None),
        (6, " ".join(hay[:9] + ["alone"] + hay[9:]), None, None),
        (None, " ".join(hay + long_), None, None),
        (8, " ".join(long_ + hay) + " " + " ".join(word() for _ in range(9000)), None, None),
        (8, None, None, None),
        (9, "", None, None),
    ]
    bench = spark.createDataFrame([(1, " ".join(long_), 7), (1, " ".join(long_), 8), (2, " ".join(long_), 8), (3, "Quite short!", 1), (None, "alone", 1), (5, "...", 1), (6, None, 1)], "item_id long, text string, distance int")
    docs = documents(spark, rows)
    got = Counter((r.doc_id, r.item_id, r.distance) for r in decontam.contaminated(spark, docs, bench).collect())
    whole = [(d, i, k) for d, k in ((1, 2), (2, 3), (3, 5), (None, 0), (8, 0)) for i in (1, 2)]
    assert got == Counter([*whole, (4, 3, 0), (6, None, 0)])
    kept = decontam.uncontaminated(spark, docs, bench)
    assert kept.columns == docs.columns and Counter((r.doc_id, r.text) for r in kept.collect()) == Counter([(5, rows[4][1]), (8, None), (9, "")])


def _distance(a, b):
    prev = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            row.append(min(prev[j] + 1, row[j - 1] + 1, prev[j - 1] + (x != y)))
        prev = row
    return prev[-1]


def test_banded_distance():
    rng = random.Random(1)
    for _ in range(200):
        a, b = ([rng.randint(0, 3) for _ in range(rng.randint(0, 9))] for _ in range(2))
        d = _distance(a, b)
        for most in (0, 2, 9):
            assert decontam.edit_distance(a, b, most) == min(d, most + 1)


def test_no_benchmark(spark, docs):
    assert decontam.contaminated(spark, docs, spark.createDataFrame([], "item_id long, text string")).count() == 0


# --- 8 -------------------------------------------------------------------------
def test_label_model_recovers_accuracies():
    rng = np.random.default_rng(4)
    y = rng.random(20_000) < 0.3
    acc = [0.9, 0.8, 0.7, 0.85]
    votes = np.stack([np.where(rng.random(len(y)) < 0.2, -1, np.where(rng.random(len(y)) < a, y, ~y)) for a in acc], axis=1).astype(int)
    pats, inv, n = np.unique(votes, axis=0, return_inverse=True, return_counts=True)
    post, behaviour, share = quality.fit_labels(pats, n.astype(float))
    assert abs(share - 0.3) < 0.05
    odds = np.log(0.3 / 0.7) + sum(np.where(votes[:, k] < 0, 0, (2 * votes[:, k] - 1) * np.log(a / (1 - a))) for k, a in enumerate(acc))
    best = ((odds > 0) == y).mean()  # what the true accuracies allow
    assert ((post[inv.ravel()] > 0.5) == y).mean() > best - 0.005
    for k, a in enumerate(acc):
        assert abs(behaviour[1, k] - a) < 0.06


def test_quality_on_held_out_labels(spark, sf):
    """Fitted with the even documents' judgements, measured on the odd ones'."""
    sf = sf.replace("sf0.001", "sf0.1")
    d = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    got = {r.doc_id: r for r in quality.classify(spark, d, labels.where("doc_id % 2 = 0")).drop("text").collect()}
    held = labels.where("doc_id % 2 = 1").collect()
    clean = [got[r.doc_id].keep for r in held if r.quality == 1 and r.toxic == 0]
    junk = [not got[r.doc_id].keep for r in held if r.quality == 0]
    toxic = [not got[r.doc_id].keep for r in held if r.toxic == 1]
    assert np.mean(clean) > 0.97 and np.mean(junk) > 0.95 and np.mean(toxic) > 0.8


@pytest.mark.parametrize("size", [400, 1200])
def test_posteriors_train_the_scorer_however_many_rows_are_judged(spark, sf, monkeypatch, size):
    sf = sf.replace("sf0.001", "sf0.1")
    d = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf}/labels.parquet")  # more judged rows than the sample holds
    targets = []
    fit = quality.fit_scorer
    monkeypatch.setattr(quality, "SAMPLE", size)
    monkeypatch.setattr(quality, "fit_scorer", lambda idx, bound, dense, target: targets.append(target) or fit(idx, bound, dense, target))
    quality.train(spark, d, labels)
    assert len(targets) == 2
    for t in targets:
        weak = ((t > 0) & (t < 1)).sum()
        assert 0 < weak and size // 2 <= len(t) <= size


def test_quality_odd_rows(spark, docs, rows):
    clash = docs.withColumns({"keep": F.lit("x"), "p_junk": F.lit("y"), "votes": F.lit(1), "idx": F.lit(2)})
    frame = quality.classify(spark, clash, None)
    assert frame.columns == [*docs.columns, "votes", "idx", "n_words", "p_junk", "p_abuse", "keep"]
    got = frame.collect()
    assert len(got) == len(rows) and all(not r.keep for r in got if not (r.text or "").strip())
    plain = Counter((r.doc_id, r.text, r.keep) for r in quality.classify(spark, docs, None).collect())
    assert Counter((r.doc_id, r.text, r.keep) for r in got) == plain
    nameless = quality.classify(spark, docs.withColumn("doc_id", F.lit(None).cast("long")), None).collect()
    assert len(nameless) == len(rows) and all(not r.keep for r in nameless if not (r.text or "").strip())
    assert quality.classify(spark, empty(spark), None).count() == 0


# --- 9 -------------------------------------------------------------------------
ALPHABET = "aZ09.@+-_ ()%\nÉ1234567890"


def brute_pii(t):
    s = {
        "email": [m.span() for m in pii.EMAIL_RE.finditer(t)],
        "ip": [m.span() for m in pii.IP_RE.finditer(t) if all(int(p) <= 255 for p in m.group().split("."))],
        "card": [m.span() for m in pii.CARD_RE.finditer(t) if 16 <= len(d := re.sub("[ -]", "", m.group())) <= 19 and pii.luhn(d)],
        "phone": [m.span() for m in pii.PHONE_RE.finditer(t) if 8 <= len(re.sub(r"\D", "", m.group())) <= 15],
    }
    return s


@settings(max_examples=600, deadline=None)
@given(st.text(alphabet=ALPHABET, max_size=60))
def test_pii_base(t):
    got = pii.find(t)
    assert {k: got[k] for k in pii.BASE} == brute_pii(t)


def test_pii_examples():
    t = "mail a.b@c.org, 4111 1111 1111 1111 call +1 (202) 555-0142 at 10.0.0.256 or 10.0.0.25 http://u:pw@h/ IBAN: GB82 WEST 1234 5698 7654 32 ok ghp_" + "a1" * 18
    s = pii.find(t)
    assert [t[a:z] for a, z in s["email"]] == ["a.b@c.org"] and [t[a:z] for a, z in s["ip"]] == ["10.0.0.25"]
    assert [t[a:z] for a, z in s["iban"]] == ["GB82 WEST 1234 5698 7654 32"] and len(s["url"]) == len(s["secret"]) == len(s["card"]) == len(s["phone"]) == 1
    assert pii.mask("x a@b.co y", pii.find("x a@b.co y")) == "x <EMAIL> y"


def test_pii_table(spark, docs, rows):
    got = pii.find_pii(spark, docs).collect()
    assert len(got) == len(rows)
    assert Counter((r.doc_id, r.n_email) for r in got) == Counter((r.doc_id, len(brute_pii(r.text or "")["email"])) for r in rows)


# --- 10 ------------------------------------------------------------------------
def check_packing(got, size):
    seq = defaultdict(list)
    for r in got:
        seq[r.sequence_id].append((r.offset, r.length))
    for v in seq.values():
        at = 0
        for o, n in sorted(v):
            assert o == at
            at += n
        assert at <= size
    return len(seq)


def test_packing(spark, docs, rows):
    full = Tokenizer.from_file(VOCAB)
    got = packing.pack(spark, docs, VOCAB, size=64).collect()
    want = Counter()
    for r in rows:
        x = np.array(full.encode(r.text or "", add_special_tokens=False).ids + [1], "<u4")
        for k, s in enumerate(range(0, len(x), 64)):
            want[r.doc_id, k, s, len(x[s : s + 64]), zlib.crc32(x[s : s + 64].tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    n = check_packing(got, 64)
    assert n <= -(-sum(r.length for r in got) // 64) + 3


@settings(max_examples=30, deadline=None)
@given(st.dictionaries(st.integers(1, 255), st.integers(1, 400), max_size=30))
def test_plan_covers_the_histogram(hist):
    got = Counter()
    for lens, m in packing.plan(hist, size=256, grain=8)[0]:
        assert sum(lens) <= 256
        for x in lens:
            got[x] += m
    assert got == Counter(hist)


def test_plan_is_near_the_bound():
    rng = random.Random(2)
    hist = dict(Counter(min(4095, int(rng.expovariate(1 / 900)) + 1) for _ in range(20_000)))
    used = sum(m for _, m in packing.plan(hist)[0])
    assert used <= 1.01 * -(-sum(k * n for k, n in hist.items()) // 4096)


@pytest.mark.parametrize(
    "hist, least",
    [
        ({1400: 999, 1300: 999}, 750),
        ({1400: 3000, 1300: 3000}, 2250),
        ({2100: 500, 1000: 700, 900: 333}, 550),
        ({1366: 1000, 1365: 1000, 1: 50}, 750),
        ({3000: 7, 1500: 5, 600: 11}, 10),
        ({4000: 1}, 1),
        ({}, 0),
    ],
)
def test_plan_of_few_lengths_is_the_linear_programs(hist, least):
    sequences, bound = packing.plan(hist)
    used = sum(m for _, m in sequences)
    assert least - 1 < bound <= least + 1e-6
    assert used <= least + len(hist) and used <= np.ceil(bound - 1e-6) + len(hist)
    assert used == least


def test_bound_is_below_every_cover():
    rng = random.Random(4)
    for _ in range(6):
        hist = {rng.randint(20, 255): rng.randint(1, 60) for _ in range(rng.randint(1, 8))}
        sequences, bound = packing.plan(hist, size=256)
        greedy = packing.best_fit([], Counter(hist), 256)
        assert bound <= min(sum(m for _, m in sequences), sum(m for _, m in greedy)) + 1e-6
        assert sum(m for _, m in sequences) <= np.ceil(bound - 1e-6) + len(hist)


# --- all -----------------------------------------------------------------------
def test_empty_tables(spark):
    e = empty(spark)
    assert suffixdedup.substring_dedup(spark, e).count() == 0
    assert neardup.near_duplicates(spark, e).count() == 0
    assert licenses.license_scan(spark, e).count() == 0
    assert sharding.shard(spark, e).count() == 0
    assert wavelet.read_tokens(spark, wavelet.write_tokens(spark, e, VOCAB)).count() == 0
    assert pii.find_pii(spark, e).count() == 0
    assert packing.pack(spark, e, VOCAB).count() == 0
