"""Licence scans by sentence rules.

Texts are cut into lines and sentences; lines that follow each other without a
blank line (comment marks do not count) are one sentence up to the next sentence
end. Pieces are normalised (lower case, runs of anything but letters and digits
become one space), and from the start of each piece, single lines and joined ones
are looked up among known licence sentences, with a wildcard for years and holders;
the longest that is known counts. A wildcard at the end takes the rest of the
sentence, up to a piece where another known one starts. Two more kinds of sentence are
known by form: ``SPDX-License-Identifier:`` lines, whose expression gives an identifier
for each licence in it, and "... is released under the <licence name>" (any of the
subjects, verbs and names below). The document's
sequence of identifiers is then matched against ordered rules: a rule holds if
its identifiers occur in that order, with at most ``GAP`` other sentences between.
The first rule that holds at a place wins there; all licences found are returned.

The sentence table is a fixed list of public licence wording.
Null or empty text: no licence. Rows without doc_id keep a null doc_id.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import prepare, read

GAP = 3

#: Identifier, licence sentence as published (``*``: any words).
SENTENCES = [
    ("mit-grant", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction *"),
    ("mit-notice", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    ("mit-as-is", "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND *"),
    ("mit-name", "Released under the MIT License."),
    ("mit-name", "Licensed under the MIT License."),
    ("mit-name", "MIT License"),
    ("mit-name", "The MIT License (MIT)"),
    ("bsd-grant", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    ("bsd-source", "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."),
    ("bsd-binary", "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."),
    ("bsd-endorse", "Neither the name of * may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("apache2-name", "Licensed under the Apache License, Version 2.0."),
    ("apache2-name", "Licensed under the Apache License, Version 2.0 (the \"License\");"),
    ("apache2-name", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License."),
    ("apache2-copy", "You may obtain a copy of the License at"),
    ("apache2-as-is", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."),
    ("gpl3-name", "This work is licensed under the GNU General Public License, version 3."),
    ("gpl3-name", "Licensed under the GNU General Public License, version 3."),
    ("gpl2-name", "Licensed under the GNU General Public License, version 2."),
    ("gpl-free", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("gpl-free2", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("gpl-hope", "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE."),
    ("mpl2-name", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("cc-by", "Licensed under CC BY 4.0."),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0."),
    ("cc-by-sa", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0."),
    ("cc-by-nc", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("cc-by-nd", "Licensed under CC BY-ND 4.0."),
    ("cc0", "Licensed under CC0 1.0."),
    ("cc0", "To the extent possible under law, * has waived all copyright and related or neighboring rights to this work."),
    ("unlicense", "This is free and unencumbered software released into the public domain."),
    ("reserved", "All rights reserved."),
]

#: Rules in order: longer identifier sequences before those they contain.
RULES = [
    ("MIT", ("mit-grant", "mit-notice", "mit-as-is")),
    ("MIT", ("mit-grant", "mit-notice")),
    ("BSD-3-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-endorse")),
    ("BSD-2-Clause", ("bsd-grant", "bsd-source", "bsd-binary")),
    ("Apache-2.0", ("apache2-name", "apache2-copy", "apache2-as-is")),
    ("GPL-3.0", ("gpl-free", "gpl-hope")),
    ("GPL-2.0", ("gpl-free2", "gpl-hope")),
    ("MIT", ("mit-name",)),
    ("MIT", ("mit-grant",)),
    ("Apache-2.0", ("apache2-name",)),
    ("GPL-3.0", ("gpl3-name",)),
    ("GPL-2.0", ("gpl2-name",)),
    ("GPL-3.0", ("gpl-free",)),
    ("GPL-2.0", ("gpl-free2",)),
    ("MPL-2.0", ("mpl2-name",)),
    ("CC-BY-4.0", ("cc-by",)),
    ("CC-BY-SA-4.0", ("cc-by-sa",)),
    ("CC-BY-NC-4.0", ("cc-by-nc",)),
    ("CC-BY-ND-4.0", ("cc-by-nd",)),
    ("CC0-1.0", ("cc0",)),
    ("Unlicense", ("unlicense",)),
    ("All-rights-reserved", ("reserved",)),
]

#: SPDX identifiers (``-only``, ``-or-later`` and ``+`` left off).
SPDX = (
    "0BSD AFL-3.0 AGPL-3.0 Apache-1.1 Apache-2.0 Artistic-2.0 BSD-2-Clause BSD-3-Clause BSD-4-Clause BSL-1.0 BUSL-1.1 "
    "CC-BY-3.0 CC-BY-4.0 CC-BY-SA-3.0 CC-BY-SA-4.0 CC-BY-NC-4.0 CC-BY-ND-4.0 CC-BY-NC-SA-4.0 CC-BY-NC-ND-4.0 CC0-1.0 "
    "CDDL-1.0 CECILL-2.1 EPL-1.0 EPL-2.0 EUPL-1.2 GFDL-1.3 GPL-1.0 GPL-2.0 GPL-3.0 HPND ISC LGPL-2.0 LGPL-2.1 LGPL-3.0 "
    "MIT MIT-0 MPL-1.1 MPL-2.0 MS-PL MS-RL NCSA ODbL-1.0 OFL-1.1 OpenSSL OSL-3.0 PostgreSQL Python-2.0 Ruby SSPL-1.0 "
    "Unlicense UPL-1.0 W3C WTFPL X11 Zlib ZPL-2.1"
).split()

#: Names a licence goes by.
NAMES = {
    "MIT": ("MIT", "MIT License", "MIT X11 License", "Expat License"),
    "Apache-2.0": ("Apache License, Version 2.0", "Apache License 2.0", "Apache License v2.0", "Apache 2.0 License", "Apache 2.0"),
    "BSD-2-Clause": ("BSD 2-Clause License", "2-Clause BSD License", "Simplified BSD License", "FreeBSD License"),
    "BSD-3-Clause": ("BSD 3-Clause License", "3-Clause BSD License", "New BSD License", "Modified BSD License"),
    "GPL-2.0": ("GNU General Public License, version 2", "GNU General Public License v2.0", "GNU GPL version 2", "GPLv2", "GPL v2", "GPL-2.0"),
    "GPL-3.0": ("GNU General Public License, version 3", "GNU General Public License v3.0", "GNU GPL version 3", "GPLv3", "GPL v3", "GPL-3.0"),
    "LGPL-2.1": ("GNU Lesser General Public License, version 2.1", "LGPLv2.1", "LGPL-2.1"),
    "LGPL-3.0": ("GNU Lesser General Public License, version 3", "LGPLv3", "LGPL-3.0"),
    "AGPL-3.0": ("GNU Affero General Public License, version 3", "AGPLv3", "AGPL-3.0"),
    "MPL-2.0": ("Mozilla Public License, v. 2.0", "Mozilla Public License, version 2.0", "Mozilla Public License 2.0", "MPL 2.0"),
    "EPL-2.0": ("Eclipse Public License 2.0", "Eclipse Public License v2.0", "EPL 2.0"),
    "EUPL-1.2": ("European Union Public Licence 1.2", "EUPL 1.2"),
    "ISC": ("ISC License", "ISC"),
    "Zlib": ("zlib License",),
    "BSL-1.0": ("Boost Software License, Version 1.0", "Boost Software License 1.0"),
    "Artistic-2.0": ("Artistic License 2.0",),
    "OFL-1.1": ("SIL Open Font License, Version 1.1",),
    "Unlicense": ("Unlicense",),
    "WTFPL": ("WTFPL",),
    "CC0-1.0": ("CC0", "CC0 1.0", "Creative Commons Zero 1.0"),
    "CC-BY-4.0": ("CC BY 4.0", "Creative Commons Attribution 4.0 International License", "Creative Commons Attribution 4.0 License"),
    "CC-BY-SA-4.0": ("CC BY-SA 4.0", "Creative Commons Attribution-ShareAlike 4.0 International License", "Creative Commons Attribution-ShareAlike 4.0 License"),
    "CC-BY-NC-4.0": ("CC BY-NC 4.0", "Creative Commons Attribution-NonCommercial 4.0 International License"),
    "CC-BY-ND-4.0": ("CC BY-ND 4.0", "Creative Commons Attribution-NoDerivatives 4.0 International License"),
    "CC-BY-NC-SA-4.0": ("CC BY-NC-SA 4.0", "Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License"),
    "CC-BY-NC-ND-4.0": ("CC BY-NC-ND 4.0", "Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License"),
}
SUBJECTS = "it this project the project this software the software this work this program this library the library this code the code the source code this file this package this repository this module this document this dataset".replace(" this ", "|this ").replace(" the ", "|the ")
VERBS = "(?:dual )?licensed|released|distributed|available|made available|published|provided|offered|covered"

#: by form: one identifier a licence, each a rule of its own
RULES += [(x, (f"spdx {x}",)) for x in SPDX] + [(x, (f"under {x}",)) for x in NAMES]

_NOISE = re.compile(r"[^a-z0-9*]+")
_END = re.compile(r"(?<=[.;:!?])[ \t]+(?=[\"(A-Z])|[\r\n\v\f  ]+")
_ABBREVIATION = re.compile(r"\b(v|no|inc|ltd|co|e\.g|i\.e)\.$", re.I)


def normalise(s: str) -> str:
    return _NOISE.sub(" ", s.lower().replace("licence", "license")).strip()


_BY_NAME = {normalise(n): x for x, names in NAMES.items() for n in names}
_UNDER = re.compile(
    rf"(?:(?:{SUBJECTS}) (?:is|are) )?(?:{VERBS}) under (?:the )?(?:terms (?:and conditions )?of )?(?:the )?"
    rf"({'|'.join(sorted(_BY_NAME, key=len, reverse=True))})(?: or later| or any later version| or at your option any later version)?(?![^ ])"
)
_TAG = re.compile(r"SPDX-License-Identifier:[ \t]*([^\r\n]*)", re.I)
_BY_TAG = {x.lower(): x for x in SPDX}


def tagged(expression: str) -> list[str]:
    """Licences of an SPDX expression, in order; exceptions after WITH and unknown names are none."""
    out, words = [], re.findall(r"[A-Za-z0-9.+-]+", expression)
    for i, w in enumerate(words):
        x = _BY_TAG.get(re.sub(r"(-only|-or-later|\+)$", "", w.lower()))
        if not i or words[i - 1].upper() in ("OR", "AND"):
            out += [x] if x else []
        elif w.upper() not in ("OR", "AND", "WITH") and words[i - 1].upper() != "WITH":
            break
    return out


def _known() -> tuple[dict[str, str], list[tuple[str, str, str]], set[str]]:
    """Sentences without wildcard; (name, before, after) of those with one; and what
    a join of lines may begin with: the first words of the former."""
    exact, open_ = {}, []
    for name, s in SENTENCES:
        n = normalise(s)
        if "*" in n:
            before, after = (x.strip() for x in n.split("*"))
            open_.append((name, before, after))
        else:
            exact[n] = name
    return exact, open_, {" ".join(w[:k]) for n in exact for w in [n.split()] for k in range(1, len(w) + 1)}


EXACT, OPEN, BEGINNINGS = _known()
#: every known sentence has one of these; texts and sentences without any are passed over
CUE = re.compile(r"licen[cs]e|warranty|permission|redistribution|as[\W_]+is|rights|public[\W_]+domain|gnu[\W_]+general|(?:released|distributed|available|published|provided|offered|covered)[\W_]+under", re.I)
_BREAK = re.compile(r"\r\n|[^ \t]")
_MARKS_AHEAD = re.compile(r"[ \t]*(?:(?:[#/*;%|>!-]+|rem\b|dnl\b)[ \t]*)*", re.I)
_STOP = re.compile(r"[.;:!?][\"')]*[ \t#/*|-]*$")


def sentences(text: str):
    """(start, end) of the sentences: ends of lines, and sentence marks before a capital."""
    a = 0
    for m in _END.finditer(text):
        if m.group()[0] in " \t" and (_ABBREVIATION.search(text, max(a, m.start() - 6), m.start()) or text[max(a, m.start() - 24) : m.start()].lower().endswith("spdx-license-identifier:")):
            continue
        if m.start() > a:
            yield a, m.start()
        a = m.end()
    if a < len(text):
        yield a, len(text)


def identify(sentence: str) -> str | None:
    return next((name for _, _, name in _match([_bare(sentence)])), None)


def _bare(piece: str) -> str:
    """A piece without its comment marks, normalised."""
    return normalise(piece[_MARKS_AHEAD.match(piece).end() :]).replace("*", " ").strip()


def _match(pieces: list[str]) -> list[tuple[int, int, str]]:
    """(first, last, name) of the known sentences in the normalised pieces of one."""
    whole = " ".join(pieces)
    starts, ends, at = [], [], 0
    for x in pieces:
        starts.append(at)
        ends.append(at + len(x))
        at += len(x) + 1
    place = {z: j for j, z in enumerate(ends)}
    found: list[tuple[int, int, str, bool]] = []  # and whether a wildcard ends it
    i = 0
    while i < len(pieces):
        best = (-1, "", False)
        a = starts[i]
        for j in range(i, len(pieces)):
            acc = whole[a : ends[j]] if ends[j] - a <= WIDEST else ""
            if acc in EXACT:
                best = (j, EXACT[acc], False)
            if acc not in BEGINNINGS:
                break
        m = _UNDER.match(whole, a)
        if m and place.get(m.end(), -1) > best[0]:
            best = max(best, (place[m.end()], f"under {_BY_NAME[m.group(1)]}", False))
        for name, before, after in OPEN:
            z = a + len(before)
            if not whole.startswith(before, a) or whole[z : z + 1] not in ("", " "):
                continue
            if not after:
                best = max(best, (next(j for j in range(i, len(ends)) if ends[j] >= z), name, True))
                continue
            # the wildcard stands for one word at least
            at = whole.find(" " + after, z + 2)
            while at >= 0 and at + 1 + len(after) not in place:
                at = whole.find(" " + after, at + 1)
            if at >= 0:
                best = max(best, (place[at + 1 + len(after)], name, False))
        if best[0] >= 0:
            found.append((i, *best))
            i = best[0]
        i += 1
    nexts = [x[0] for x in found[1:]] + [len(pieces)]
    return [(i, n - 1 if wild else j, name) for (i, j, name, wild), n in zip(found, nexts)]


def _joined(text: str):
    """Lists of pieces (start, end, normalised) that make up one sentence."""
    run: list[tuple[int, int, str]] = []
    for a, z in sentences(text):
        ahead = _MARKS_AHEAD.match(text, a, z).end()
        bare = _bare(text[a:z])
        if run:
            y = run[-1][1]
            apart = not bare or len(_BREAK.findall(text, y, a)) != 1 or "\f" in text[y:a]
            stop = _STOP.search(text, run[-1][0], y)
            ends = stop and not _ABBREVIATION.search(text, max(run[-1][0], y - 6), y) and (text[ahead] in '"(' or text[ahead].isupper())
            if apart or ends:
                yield run
                run = []
        if bare:
            run.append((a, z, bare))
    if run:
        yield run


WIDEST = max(map(len, EXACT))


def scan(text: str) -> list[tuple[str, int, int]]:
    """(licence, start, end) of the rules that hold, in order."""
    if not text or not CUE.search(text):
        return []
    found: list[tuple[int, str, int, int]] = []
    k = 0
    for run in _joined(text):
        tag = _TAG.search(text, run[0][0], run[-1][1])
        if tag:
            found += [(k, f"spdx {x}", tag.start(), tag.end()) for x in tagged(tag.group(1))]
            k += 1
        elif CUE.search(text, run[0][0], run[-1][1]):
            last = -1
            for i, j, name in _match([x for _, _, x in run]):
                k += i > last + 1  # what stands before it in the sentence
                found.append((k, name, run[i][0], run[j][1]))
                k, last = k + 1, j
            k += last + 1 < len(run)
        else:
            k += 1
    out, i = [], 0
    while i < len(found):
        for licence, rule in RULES:
            j, last = i, found[i][0]
            if found[i][1] != rule[0]:
                continue
            for want in rule[1:]:
                j = next((x for x in range(j + 1, len(found)) if found[x][1] == want and found[x][0] - last <= GAP + 1), -1)
                if j < 0:
                    break
                last = found[j][0]
            if j >= 0:
                out.append((licence, found[i][2], found[j][3]))
                i = j
                break
        i += 1
    return out


def _scan(batches):
    for b in batches:
        out: list[list] = [[], [], [], []]
        for d, t in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist()):
            got = scan(t or "")
            out[0].append(d)
            out[1].append(len(got))
            out[2].append(",".join(sorted({x[0] for x in got})))
            out[3].append(",".join(f"{n}:{a}:{z}" for n, a, z in got))
        yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.string()), pa.array(out[3], pa.string())], ["doc_id", "n_rules", "licences", "spans"])


def license_scan(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """One row per row of docs(doc_id, text): rules that hold, licences, spans."""
    prepare(spark)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(
        _scan, "doc_id long, n_rules long, licences string, spans string"
    )


def op3_license_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(spark, read(spark, sf_dir, "documents"))
