"""Ids of whole texts from the tokenizers library, each distinct unit encoded once.

A unit ends where the tokenizer's own pre-tokenisation always ends a token, so
the ids of a text are those of its units in a row. Units are found and put into
a dictionary by Arrow, a batch of texts at a time, so that Python looks up each
distinct unit once, and the ids are taken from there in the units' order. Each
Python worker keeps the units that it has met lately, at most twice ``MEMO`` and
a batch's, whatever the corpus holds.

A new unit is cut in the tokenizer's pre-tokens, and pre-tokens that are new as
well are handed to the library many in one string, which costs less than one
by one. Where the ids of each end there follows from the bytes that an id
stands for (byte style) or from the mark on a pre-token's last id (word
style). Units for which that isn't certain, and strings in which the ends
don't come out even, are encoded as they are.
"""

from __future__ import annotations

import gc
import os
import re
from array import array
from contextlib import contextmanager

import numpy as np
import pyarrow as pa

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: Units and pre-tokens after which a worker puts those that it remembers aside, in the place of those put aside before.
MEMO, PARTS = 450_000, 300_000
#: Longer units are not remembered.
LONGEST = 64
#: White space other than space and line feed, and the separators that only Python takes for white space.
OTHER_SPACE = "\t\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0 ᠎           ​    　﻿"
ODD = (*OTHER_SPACE, "\0", "<|")
ODD_ASCII = tuple(x for x in ODD if x.isascii())
RUNS = ("  ", " \n", "\n ", "\n\n")
#: Pre-tokens that are encoded together in one string.
TOGETHER = 512
#: Letters of Latin blocks that lower case and composition leave as single letters, and typographic marks.
LETTERS = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u0148\u014a-\u024f"
CERTAIN = re.compile(f" ?[!-~{LETTERS}\u2013\u2014\u2018-\u201e\u2026]+")
#: Pre-tokens of such units: those of the word tokenizer after lower-casing, and those of the byte tokenizer.
PRETOKENS = {
    "word": re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{LETTERS}]+|[0-9]|[^0-9{LETTERS}]+"),
    "byte": re.compile(f"'s|'t|'re|'ve|'m|'ll|'d| ?[{LETTERS}]+| ?[0-9]+| ?[^ 0-9{LETTERS}]+"),
}
#: Units that are one pre-token of the byte tokenizer, made of letters or of ASCII signs.
WHOLE = re.compile(f" ?(?:[{LETTERS}]+|[!-/:-@\\[-`{{-~]+)")
#: What a byte can be where texts are cut: an ASCII letter, an ASCII sign, a space, a line feed. TRAIL: the second bytes of Latin letters that begin with C3.
LETTER, SIGN, LINE, FEED = 1, 2, 3, 4
KIND = np.array([LETTER if chr(k).isalpha() else SIGN if chr(k).isprintable() and not chr(k).isalnum() else 0 for k in range(128)] + [0] * 128, np.uint8)
KIND[ord(" ")], KIND[ord("\n")] = LINE, FEED
TRAIL = np.array([0x80 <= k < 0xC0 and k not in (0x97, 0xB7) for k in range(256)])


@contextmanager
def uncollected():
    """No search for cycles meanwhile: it goes through everything that is remembered again and again, and nothing here makes cycles."""
    was = gc.isenabled()
    gc.disable()
    try:
        yield
    finally:
        if was:
            gc.enable()


class MemoTokenizer:
    """``style`` is ``byte`` (byte-level BPE, spaces lead words) or ``word`` (white space is dropped)."""

    def __init__(self, path: str, style: str, memo: int = MEMO):
        from tokenizers import Tokenizer

        self.tokenizer, self.style, self.memo = Tokenizer.from_file(path), style, memo
        self.code = "H" if self.tokenizer.get_vocab_size() <= 1 << 16 else "I"
        self.known: dict[str, bytes] = {}
        self.parts: dict[str, bytes] = {}  # ids of pre-tokens
        self.known_before, self.parts_before = {}, {}  # what was put aside; what is met again moves back
        tokens = sorted(self.tokenizer.get_vocab().items(), key=lambda kv: kv[1])
        self.ends = np.array([t.endswith("</w>") for t, _ in tokens])
        self.sizes = np.array([len(t) for t, _ in tokens])

    def odd(self, text: str) -> bool:
        """Whether the text must be encoded as one unit."""
        if any(x in text for x in (ODD_ASCII if text.isascii() else ODD)):
            return True
        return self.style == "byte" and any(x in text for x in RUNS)

    def units(self, texts: list[str]) -> tuple[pa.DictionaryArray, np.ndarray]:
        """All units of the texts in a row, and the number of units before each text's end.

        Units are cut in the texts' bytes: before a space, around a line feed,
        and between a letter and a sign, where pre-tokens end in both styles.
        """
        column = pa.array(texts, pa.large_string())
        _, bounds, data = column.buffers()
        bounds = np.frombuffer(bounds, np.int64, len(texts) + 1)
        raw = np.frombuffer(data, np.uint8, bounds[-1]) if data else np.zeros(0, np.uint8)
        kind = KIND[raw]
        cut = kind >= LINE
        cut[1:] |= kind[:-1] == FEED
        letter = kind == LETTER
        letter[1:] |= (raw[:-1] == 0xC3) & TRAIL[raw[1:]]
        cut[1:] |= letter[:-1] & (kind[1:] == SIGN)
        for k, text in enumerate(texts):
            if self.odd(text):
                cut[bounds[k] : bounds[k + 1]] = False
        cut[bounds[:-1][bounds[:-1] < bounds[1:]]] = True
        start = np.flatnonzero(cut)
        offsets = pa.py_buffer(np.append(start, bounds[-1]))
        units = pa.LargeStringArray.from_buffers(len(start), offsets, data or pa.py_buffer(b""))
        return units.dictionary_encode(), np.searchsorted(start, bounds[1:])

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, as native-endian integers of ``self.code``."""
        with uncollected():
            return self._encode(texts)

    def _encode(self, texts: list[str]) -> list[bytes]:
        if len(self.known) > self.memo:
            self.known_before, self.known = self.known, {}
        if len(self.parts) > PARTS:
            self.parts_before, self.parts = self.parts, {}
        units, ends = self.units(texts)
        names = units.dictionary.to_numpy(zero_copy_only=False).tolist()
        if self.style == "word":
            names = [x.strip(" \n") for x in names]
        found = list(map(self.known.get, names))
        gaps = [k for k, x in enumerate(found) if x is None]
        new = recalled({names[k] for k in gaps}, self.known_before, self.known)
        self.learn(new)
        for k in gaps:
            found[k] = self.known[names[k]]
        for unit in new:
            if len(unit) > LONGEST:
                del self.known[unit]
        ids = pa.array(found, pa.large_binary()).take(units.indices)
        _, at, data = ids.buffers()
        at = np.frombuffer(at, np.int64, len(ids) + 1)[ends].tolist()
        data = data.to_pybytes() if data else b""
        return [data[a:b] for a, b in zip([0, *at], at)]

    def learn(self, new: list[str]) -> None:
        """Puts the ids of ``new`` units into ``known``."""
        if self.style == "byte":  # most are pre-tokens already
            whole = list(filter(WHOLE.fullmatch, new))
            self.learn_parts(whole, self.known)
            new = [u for u in new if u not in self.known]
        alone = [u for u in new if not CERTAIN.fullmatch(u) or "<|" in u]
        skip, cut = set(alone), PRETOKENS[self.style].findall
        sure = [(u, cut(u.lower() if self.style == "word" else u)) for u in new if u not in skip]
        self.learn_parts(recalled({p for _, own in sure for p in own} - self.parts.keys(), self.parts_before, self.parts), self.parts)
        get = self.parts.get
        for unit, own in sure:
            try:
                self.known[unit] = b"".join(map(get, own))
            except TypeError:  # a part whose end wasn't found
                alone.append(unit)
        for unit, got in zip(alone, self.tokenizer.encode_batch_fast(alone, add_special_tokens=False)):
            self.known[unit] = array(self.code, got.ids).tobytes()

    def learn_parts(self, new: list[str], into: dict[str, bytes]) -> None:
        """Puts the ids of ``new`` pre-tokens into ``into``, where their ends are certain."""
        groups = [new[at : at + TOGETHER] for at in range(0, len(new), TOGETHER)]
        for at in range(0, len(groups), 100):
            some = groups[at : at + 100]
            for group, got in zip(some, self.tokenizer.encode_batch_fast([self.joined(g) for g in some], add_special_tokens=False)):
                ids = np.array(got.ids, self.code)
                bounds = self.bounds(group, ids)
                if bounds is not None:
                    raw, width = ids.tobytes(), ids.itemsize
                    into.update(zip(group, [raw[a:b] for a, b in zip((bounds[0] * width).tolist(), (bounds[1] * width).tolist())]))

    def joined(self, group: list[str]) -> str:
        return " ".join(group) if self.style == "word" else "".join([p if p[0] == " " else "\n" + p for p in group])

    def bounds(self, group: list[str], ids: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
        """Where each pre-token's ids begin and end, or None where that doesn't come out even."""
        if self.style == "word":
            end = np.flatnonzero(self.ends[ids]) + 1
            return (np.append(0, end[:-1]), end) if len(end) == len(group) and end[-1] == len(ids) else None
        lead = np.array([p[0] != " " for p in group], np.int64)
        stop = np.cumsum(np.array([len(p.encode()) for p in group]) + lead)
        start = np.append(0, stop[:-1]) + lead
        at = np.append(0, np.cumsum(self.sizes[ids]))
        begin, end = np.searchsorted(at, start), np.searchsorted(at, stop)
        return (begin, end) if at[-1] == stop[-1] and (at[begin] == start).all() and (at[end] == stop).all() else None


def recalled(wanted: set[str], before: dict[str, bytes], now: dict[str, bytes]) -> list[str]:
    """Moves what was put aside back; returns the rest."""
    if not before:
        return list(wanted)
    back = wanted & before.keys()
    now.update(zip(back, map(before.__getitem__, back)))
    return list(wanted - back)


_OWN: dict[tuple[str, str], MemoTokenizer] = {}


def tokenizer(path: str, style: str) -> MemoTokenizer:
    """The worker's own copy, kept from task to task."""
    if (path, style) not in _OWN:
        _OWN[path, style] = MemoTokenizer(path, style)
    return _OWN[path, style]


def vocabulary(name: str, path: str | None = None) -> str:
    """The file's path; where none is given, that of the installed public tokenizers."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path(name)
    return path
