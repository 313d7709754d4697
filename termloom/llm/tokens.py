"""Bulk tokenisation with the tokenizers library, word by word.

The vocabulary's normaliser and splitter never look across ASCII white space,
nor across the border of an ASCII letter run, a digit or an ASCII punctuation
run (apostrophes and bytes outside plain Latin letters are left joined to their
neighbours). So a text's ids are the ids of its chunks in order, and a chunk
need be encoded once. Chunks are found and hashed over whole byte buffers; the
library encodes those a worker has not met; a bounded cache keeps their ids.
Texts that spell out a special token go through the library whole.
"""

from __future__ import annotations

import os

import numpy as np
import pandas as pd
import pyarrow as pa

from .common import LOWER, SPACE, groups, span_hashes, text_buffer

CACHE_WORDS = 400_000  # chunks a worker keeps; beyond it starts afresh
GROUP_BYTES = 1 << 20  # bytes of text in one step: a word is looked up once a step, so fewer are cheaper
_S, _L, _D, _P, _G = range(5)


def _classes() -> np.ndarray:
    c = np.full(256, _P, np.uint8)
    c[SPACE] = _S
    c[65:91] = c[97:123] = _L
    c[48:58] = _D
    c[0x27] = _G
    c[0x80:] = _G
    return c


CLASS = _classes()
BEGINS = np.zeros(64, bool)
ENDS = np.zeros(64, bool)
for _a in range(5):
    for _b in range(5):
        _cut = _a != _b and _G not in (_a, _b) or _a == _b == _D or _S in (_a, _b)
        BEGINS[_a * 8 + _b] = _cut and _b != _S
        ENDS[_a * 8 + _b] = _cut and _a != _S


def _byte_chars() -> dict[int, str]:
    """The byte-level alphabet: printable bytes stand for themselves."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(own)]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


BYTE_CHARS = _byte_chars()


class Encoder:
    """Ids of texts by one vocabulary file, without added special tokens."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.full = Tokenizer.from_file(path)
        self.bare = Tokenizer(self.full.model)
        self.bare.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        self.special = [t.content.encode() for t in self.full.get_added_tokens_decoder().values()]
        vocab = self.full.get_vocab()
        self.final = np.zeros(max(vocab.values()) + 1, bool)
        for t, i in vocab.items():
            self.final[i] = t.endswith("</w>")
        self.reset()

    def reset(self) -> None:
        self.at: dict[int, int] = {}
        self.off, self.len, self.pool = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int32), np.zeros(1 << 18, np.uint16)
        self.used = 0

    def _keep(self, hashes: list[int], ids: np.ndarray, lens: np.ndarray) -> None:
        n, k = len(self.at), len(hashes)
        while n + k > len(self.off):
            self.off, self.len = np.concatenate([self.off, self.off * 0]), np.concatenate([self.len, self.len * 0])
        while self.used + len(ids) > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros_like(self.pool)])
        self.pool[self.used : self.used + len(ids)] = ids
        self.len[n : n + k] = lens
        self.off[n : n + k] = self.used + np.cumsum(lens) - lens
        self.used += len(ids)
        self.at.update(zip(hashes, range(n, n + k)))

    def _learn(self, hashes: list[int], chunks: list[bytes]) -> None:
        plain, plain_h, other, other_h = [], [], [], []
        for h, b in zip(hashes, chunks):
            if b.isascii():
                s = b.decode()
                if s.isprintable() and "'" not in s:
                    plain.append(s)
                    plain_h.append(h)
                    continue
            elif (s := b.decode()).isalpha() and max(s) < "Ā" and not any(c in "ªµº" for c in s):
                plain.append(b.decode("latin-1").translate(BYTE_CHARS))
                plain_h.append(h)
                continue
            other.append(b.decode())
            other_h.append(h)
        if plain:
            lines = [" ".join(plain[i : i + 256]) for i in range(0, len(plain), 256)]
            ids = np.concatenate([np.array(e.ids, np.uint16) for e in self.bare.encode_batch_fast(lines, add_special_tokens=False)])
            ends = np.flatnonzero(self.final[ids])
            if len(ends) != len(plain):
                raise RuntimeError("a word did not end in one end-of-word token")
            self._keep(plain_h, ids, np.diff(ends, prepend=-1))
        if other:
            got = [e.ids for e in self.full.encode_batch_fast(other, add_special_tokens=False)]
            self._keep(other_h, np.array([i for x in got for i in x], np.uint16), np.array([len(x) for x in got], np.int64))

    def _span(self, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = len(data)
        if not n:
            return np.zeros(0, np.uint16), np.zeros(len(offs), np.int64)
        low = LOWER[data]
        cls = CLASS[low]
        lead = np.flatnonzero(low == 0xC3)
        if len(lead):
            second = low[lead + 1]
            up = (second <= 0x9E) & (second != 0x97)
            low[lead[up] + 1] += 0x20
            word = lead[(second != 0x97) & (second != 0xB7)]
            cls[word] = cls[word + 1] = _L
        pair = (cls[:-1] << 3) | cls[1:]
        first, last = np.empty(n, bool), np.empty(n, bool)
        first[0], last[-1] = cls[0] != _S, cls[-1] != _S
        first[1:], last[:-1] = BEGINS[pair], ENDS[pair]
        inner = offs[(offs > 0) & (offs < n)]
        first[inner] |= cls[inner] != _S
        last[inner - 1] |= cls[inner - 1] != _S
        starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
        codes, uniq = pd.factorize(span_hashes(low, starts, ends))
        if len(self.at) > CACHE_WORDS:
            self.reset()
        known = uniq.tolist()
        get = self.at.get
        idx = np.array([get(h, -1) for h in known], np.int64)
        new = np.flatnonzero(idx < 0)
        if len(new):
            pos = np.empty(len(known), np.int64)
            pos[codes[::-1]] = np.arange(len(codes) - 1, -1, -1)
            raw = low.tobytes()
            at = pos[new]
            self._learn([known[i] for i in new.tolist()], [raw[a:z] for a, z in zip(starts[at].tolist(), ends[at].tolist())])
            idx[new] = [get(known[i]) for i in new.tolist()]
        which = idx[codes]
        lens = self.len[which].astype(np.int64)
        upto = np.cumsum(lens)
        total = int(upto[-1]) if len(upto) else 0
        take = np.repeat(self.off[which] - (upto - lens), lens)
        take += np.arange(total)
        return self.pool[take], np.concatenate([[0], upto])[np.searchsorted(starts, offs)]

    def encode(self, col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts of a column, one after the other, and each text's offset in them."""
        data, offs = text_buffer(col)
        more = []
        for r in np.flatnonzero(np.diff(offs) > GROUP_BYTES).tolist():
            for at in range(int(offs[r]) + GROUP_BYTES, int(offs[r + 1]), GROUP_BYTES):
                gap = np.flatnonzero(SPACE[data[at : min(at + GROUP_BYTES, int(offs[r + 1]))]])
                if len(gap):
                    more.append(at + int(gap[0]))
        cuts = np.sort(np.concatenate([offs, np.array(more, np.int64)]), kind="stable")
        row_at = np.arange(len(offs)) + np.searchsorted(np.array(more, np.int64), offs)
        ids, at, base = [], [np.zeros(1, np.int64)], 0
        for i, j in groups(cuts, GROUP_BYTES):
            t, o = self._span(data[cuts[i] : cuts[j]], cuts[i : j + 1] - cuts[i])
            ids.append(t)
            at.append(o[1:] + base)
            base += len(t)
        tok = np.concatenate(ids) if ids else np.zeros(0, np.uint16)
        bound = np.concatenate(at)[row_at]
        raw = data.tobytes()
        hit = sorted({int(np.searchsorted(offs, p, "right")) - 1 for s in self.special for p in _all(raw, s)})
        if hit:
            parts, lens = np.split(tok, bound[1:-1]), np.diff(bound)
            for r in hit:
                parts[r] = np.array(self.full.encode(raw[offs[r] : offs[r + 1]].decode(), add_special_tokens=False).ids, np.uint16)
                lens[r] = len(parts[r])
            tok, bound = np.concatenate(parts), np.concatenate([[0], np.cumsum(lens)])
        return tok, bound


def _all(raw: bytes, what: bytes) -> list[int]:
    out, at = [], raw.find(what)
    while at >= 0:
        out.append(at)
        at = raw.find(what, at + 1)
    return out


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """This worker's encoder for a vocabulary file."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]
