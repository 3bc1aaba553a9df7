"""Ids of a byte-level BPE tokenizer for many texts.

The tokenizers library encodes every distinct pre-token once; texts are cut
into pre-tokens by arrays, as the tokenizer's own pattern does it.  Texts with
code points whose class this module does not hold, or with a special token's
string, go to the library whole.
"""

from __future__ import annotations

import unicodedata
from functools import cache, lru_cache

import numpy as np

from . import words as W

LETTER, NUMBER, SPACE, OTHER, UNKNOWN = range(5)
#: Code points below this have a class here.
HELD = 0x2100
#: Pre-tokens kept by a worker.
MOST = 2_000_000
#: Pre-tokens that are found by a look.
SLOTS = 1 << 20
#: New pre-tokens that go to the library as one text.
CHUNK = 512
#: The pattern's contractions (fixed values), by what follows the apostrophe.
CONTRACTIONS = ("s", "t", "re", "ve", "m", "ll", "d")
WHITE = {9, 10, 11, 12, 13, 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F}


@cache
def classes() -> np.ndarray:
    out = np.full(HELD + 1, UNKNOWN, np.uint8)
    for c in range(HELD):
        kind = unicodedata.category(chr(c))
        out[c] = SPACE if c in WHITE else LETTER if kind[0] == "L" else NUMBER if kind[0] == "N" else UNKNOWN if kind == "Cn" else OTHER
    return out


def pre_tokens(chars: np.ndarray, kind: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends, in code points, of the pre-tokens of texts that lie one behind another."""
    n = len(chars)
    if not n:
        z = np.zeros(0, np.int64)
        return z, z
    new = np.ones(n, bool)
    new[1:] = kind[1:] != kind[:-1]
    begins = off[:-1][off[:-1] < off[1:]]
    text_start = np.zeros(n + 1, bool)
    text_start[begins] = True
    text_start[n] = True
    new |= text_start[:n]
    start = np.flatnonzero(new)
    end = np.append(start[1:], n)
    what = kind[start]
    is_space = what == SPACE
    closes = text_start[end]  # the run is a text's last
    lone = chars[end - 1] == 32  # white space that ends in a space gives it to what follows
    # what is not white space, with a space before it
    word = np.flatnonzero(~is_space)
    takes = np.zeros(len(start), bool)
    takes[1:] = is_space[:-1] & ~closes[:-1] & lone[:-1]
    word_start, word_end = start[word] - takes[word], end[word].copy()
    # contractions: an apostrophe by itself, and letters that follow it
    quote = np.flatnonzero((what[word] == OTHER) & (word_end - word_start == 1) & (chars[start[word]] == 39) & ~closes[word])
    for w in quote.tolist():
        run = word[w] + 1
        if what[run] != LETTER:
            continue
        follow = "".join(map(chr, chars[start[run] : min(end[run], start[run] + 2)]))
        for c in CONTRACTIONS:
            if follow.startswith(c):
                word_end[w] += len(c)
                word_start[w + 1] += len(c)
                break
    ok = word_start < word_end
    # white space: all of it at a text's end, else without the last, which stands alone unless it is a space
    s = np.flatnonzero(is_space)
    tail, body = s[closes[s]], s[~closes[s]]
    long = body[end[body] - start[body] > 1]
    alone = body[~lone[body]]
    starts = np.concatenate([word_start[ok], start[tail], start[long], end[alone] - 1])
    ends = np.concatenate([word_end[ok], end[tail], end[long] - 1, end[alone]])
    order = np.argsort(starts, kind="stable")
    return starts[order], ends[order]


class Encoder:
    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        if self.tokenizer.get_vocab_size() > 1 << 16:
            raise ValueError("ids have two bytes here")
        self.special = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        #: Bytes of each id: a byte is a character of the vocabulary's strings.
        self.bytes = np.zeros(1 << 16, np.int64)
        for t, i in self.tokenizer.get_vocab().items():
            self.bytes[i] = len(t)
        self._forget()

    def _forget(self) -> None:
        # two sorted tables, of old and of new pre-tokens: keys, and where their ids are
        empty = (np.zeros(0, np.uint64), np.zeros(0, np.int32), np.zeros(0, np.int32))
        self.tables, self.ids, self.used = [empty, empty], np.zeros(1 << 20, np.uint16), 0
        # of each of 2**20 hash values the first pre-token that had it: its key, where its ids are, how many
        self.near = np.zeros(SLOTS, np.uint64), np.full(SLOTS, -1, np.int32), np.zeros(SLOTS, np.int32)

    def _together(self, raw: list[bytes]) -> tuple[np.ndarray, np.ndarray] | None:
        """Ids of pre-tokens without white space but a leading space, and how many each has.

        They go to the library as one text, which cuts it at their spaces, or at
        a line feed before one without.  None if it cuts elsewhere.
        """
        ids, size = [], []
        chunks = [raw[a : a + CHUNK] for a in range(0, len(raw), CHUNK)]
        joined = [[r if r[0] == 32 else b"\n" + r for r in c] for c in chunks]
        whole = [b"".join(j) for j in joined]
        if any(s in t for t in whole for s in self.special):
            return None
        for c, j, e in zip(chunks, joined, self.tokenizer.encode_batch_fast([t.decode() for t in whole], add_special_tokens=False), strict=True):
            got = np.array(e.ids, np.int64)
            at = np.concatenate([[0], np.cumsum(self.bytes[got])])
            stop = np.cumsum([len(x) for x in j])
            start = stop - [len(x) for x in c]
            first, last = np.searchsorted(at, start), np.searchsorted(at, stop)
            if at[-1] != stop[-1] or (at[first] != start).any() or (at[last] != stop).any():
                return None
            n = last - first
            ids.append(got[np.repeat(first - np.cumsum(n) + n, n) + np.arange(int(n.sum()))])
            size.append(n)
        return np.concatenate(ids), np.concatenate(size)

    def _ids(self, raw: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of strings, one behind another, and how many each has."""
        got = [e.ids for e in self.tokenizer.encode_batch_fast([r.decode() for r in raw], add_special_tokens=False)]
        size = np.array([len(g) for g in got], np.int64)
        return np.fromiter((i for g in got for i in g), np.int64, int(size.sum())), size

    def _learn(self, keys: np.ndarray, raw: list[bytes], plain: np.ndarray) -> None:
        """``plain``: which strings are pre-tokens without white space but a leading space."""
        order = np.argsort(~plain, kind="stable")
        some, other = ([raw[i] for i in part.tolist()] for part in np.split(order, [int(plain.sum())]))
        together = (self._together(some) or self._ids(some)) if some else (np.zeros(0, np.int64), np.zeros(0, np.int64))
        ids, size = (np.concatenate(x) for x in zip(together, self._ids(other), strict=True))
        keys = keys[order]
        total = len(ids)
        if self.used + total > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros(max(len(self.ids), total), np.uint16)])
        self.ids[self.used : self.used + total] = ids
        new = keys, (self.used + np.cumsum(size) - size).astype(np.int32), size.astype(np.int32)
        self.used += total
        old, late = self.tables
        late = self._joined(late, new)
        # the new one joins the old one when it has grown, so that each key is moved a few times only
        self.tables = [self._joined(old, late), tuple(x[:0] for x in new)] if 4 * len(late[0]) > len(old[0]) else [old, late]

    @staticmethod
    def _joined(a: tuple, b: tuple) -> tuple:
        parts = [np.concatenate(x) for x in zip(a, b, strict=True)]
        order = np.argsort(parts[0])
        return tuple(x[order] for x in parts)

    def _find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the ids of each key begin (-1 if it isn't known), and how many they are."""
        first, size = np.full(len(keys), -1, np.int64), np.zeros(len(keys), np.int64)
        for own, begin, n in self.tables:
            if len(own):
                at = np.minimum(np.searchsorted(own, keys), len(own) - 1)
                hit = np.flatnonzero(own[at] == keys)
                first[hit], size[hit] = begin[at[hit]], n[at[hit]]
        return first, size

    def encode(self, raw: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts (UTF-8), and where each text's begin (one more at the end)."""
        off = np.concatenate([[0], np.cumsum([len(r) for r in raw])]).astype(np.int64)
        buf = np.frombuffer(b"".join(raw), np.uint8)
        lead = np.flatnonzero((buf & 0xC0) != 0x80)
        chars = np.frombuffer(buf.tobytes().decode().encode("utf-32-le"), "<u4")
        at = np.searchsorted(lead, off)
        kind = classes()[np.minimum(chars, HELD)]
        starts, ends = pre_tokens(chars, kind, at)
        text = np.searchsorted(at, starts, "right") - 1
        # texts that the library cuts by itself
        whole = {int(t) for t in np.unique(np.searchsorted(at, np.flatnonzero(kind == UNKNOWN), "right") - 1)}
        whole |= {i for i, r in enumerate(raw) if any(s in r for s in self.special)}
        if whole:
            w = np.array(sorted(whole))
            keep = ~np.isin(text, w)
            starts, ends, text = np.concatenate([starts[keep], at[w]]), np.concatenate([ends[keep], at[w + 1]]), np.concatenate([text[keep], w])
            order = np.argsort(starts, kind="stable")
            starts, ends, text = starts[order], ends[order], text[order]
        byte = np.append(lead, len(buf))
        begin, stop = byte[starts], byte[ends]
        key = W.hasher(3).ranges(buf, begin, stop)
        if whole:
            key[np.isin(text, w)] ^= np.uint64(0xA5A5A5A5A5A5A5A5)  # not the same as such a pre-token
        if sum(len(t[0]) for t in self.tables) > MOST:
            self._forget()
        slot = (key >> np.uint64(44)).astype(np.int64)
        first, size = self.near[1][slot], self.near[2][slot]
        far = np.flatnonzero((self.near[0][slot] != key) | (first < 0))
        if len(far):
            distinct, one, back = np.unique(key[far], return_index=True, return_inverse=True)
            one = far[one]
            place, n = self._find(distinct)
            new = np.flatnonzero(place < 0)
            if len(new):
                data = buf.tobytes()
                some = one[new]
                plain = kind[ends[some] - 1] != SPACE
                if whole:
                    plain &= ~np.isin(text[some], w)
                self._learn(distinct[new], [data[a:b] for a, b in zip(begin[some].tolist(), stop[some].tolist(), strict=True)], plain)
                place, n = self._find(distinct)
            first[far], size[far] = place[back], n[back]
            free = np.flatnonzero(self.near[1][slot[one]] < 0)
            _, once = np.unique(slot[one[free]], return_index=True)
            free = free[once]
            for t, x in zip(self.near, (distinct, place, n), strict=True):
                t[slot[one[free]]] = x[free]
        total = np.concatenate([[0], np.cumsum(size)])
        ids = self.ids[np.repeat(first - total[:-1], size) + np.arange(total[-1])]
        return ids, total[np.searchsorted(text, np.arange(len(raw) + 1))]


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)
