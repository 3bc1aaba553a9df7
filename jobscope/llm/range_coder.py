"""An adaptive context-mixing range coder for id streams, many blocks at a time.

Every block is coded by itself, from a fresh model.  Order-2 and order-1 tables
predict the next id from the last two and the last one; how sure they are
selects adaptive counts for "the order-2 id", "the order-1 id" and "neither".
Otherwise the id's class (its two leading bits and how many follow) is coded by
adaptive order-0 counts, and the bits that follow are kept as they are.  The
blocks of a call run in lockstep, one numpy operation for the same step of all
of them.

A block's bytes: b"IDB2", the number of ids, their crc32 (as little-endian
unsigned 32-bit integers) and the number of the coder's words, all three 4
bytes; then the coder's 16-bit words, all little-endian, and the plain bits,
lowest first.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

MAGIC = b"IDB2"
HEAD = 16
#: Ids in a block, and the largest id (two bytes).
BLOCK = 2048
LARGEST = (1 << 16) - 1

#: A range is at least LEAST and at most LEAST * WHOLE between two steps: whole numbers that doubles hold exactly.
LEAST = 2.0**32
WHOLE = 1 << 16
ORDER2, ORDER1 = 1024, 512
SLOTS = ORDER2 + ORDER1
#: Classes of ids, and one that stands for a predicted id.
CLASSES = 32
#: Parts of the frequency that is left for all classes.
PARTS = 4096
#: Steps between two refreshes of the frequencies.
REFRESH = 64
#: Blocks whose plain bits are packed at once.
PACKED = 32

_ids = np.arange(LARGEST + 1)
_width = np.array([i.bit_length() for i in range(LARGEST + 1)])
_below = np.maximum(_width - 2, 0)
#: The class of each id; of each class how many plain bits follow, and its least id.
CLASS = np.where(_ids < 2, _ids, 2 * (_width - 1) + (_ids >> _below & 1)).astype(np.uint8)
BELOW = np.array([max(c // 2 - 1, 0) for c in range(CLASSES)], np.uint8)
LEAD = np.array([c if c < 2 else (2 + c % 2) << (c // 2 - 1) for c in range(CLASSES)], np.int32)
#: Masks of so many bits.
MASK = np.array([(1 << b) - 1 for b in range(16)], np.int32)


class Model:
    """The adaptive state of ``n`` blocks, each table one flat array."""

    def __init__(self, n: int):
        self.n = n
        #: By context the id seen last, and above its 16 bits how sure it is (0 to 3, times 4 for two ids).
        self.seen = np.zeros(n * SLOTS, np.int32)
        self.one = np.array([[4 * WHOLE], [WHOLE]], np.int32)
        self.two, self.three = 3 * self.one - 1, 3 * self.one
        start = np.array([(1 + 40 * a, 1 + 20 * b, 60) for a in range(4) for b in range(4)])
        #: Counts of the order-2 id, the order-1 id and neither, of each block's contexts; of its classes.
        self.hits = np.repeat(start.T[:, None], n, axis=1).reshape(3, 16 * n)
        self.counts = np.full((CLASSES, n), 4)
        self.x1, self.x2 = np.zeros(n, np.int64), np.zeros(n, np.int64)
        self.lanes = np.arange(n)
        self.at2, self.at1, self.at_context = self.lanes * SLOTS, self.lanes * SLOTS + ORDER2, self.lanes * 16
        self.slots = np.zeros((2, n), np.int64)
        self.step, self.past = 0, []
        self._refresh()

    def _refresh(self) -> None:
        """Frequencies from the counts; old counts fade."""
        if self.past:
            context, by2, by1, at = (np.concatenate(x) for x in zip(*self.past, strict=True))
            kind = 2 - by2.view(np.uint8) - by1.view(np.uint8)
            self.hits += 24 * np.bincount(np.multiply(kind, 16 * self.n, dtype=np.int64) + context, minlength=self.hits.size).reshape(self.hits.shape)
            self.counts += 8 * np.bincount(at[~by1], minlength=self.counts.size).reshape(self.counts.shape)
            self.past = []
        total, sums = self.hits.sum(axis=0), np.cumsum(self.counts, axis=0)
        share = np.floor(self.hits[:2] * ((WHOLE - 8192) / total)) + 1
        #: Up to where the order-2 id, and either, goes, of WHOLE.
        self.upto2, self.upto1 = share[0], share[0] + share[1]
        #: Where each class begins, of PARTS: a row for each class and one behind the last.
        self.limits = np.zeros((CLASSES + 1, self.n), np.int16)
        self.limits[1:] = sums * ((PARTS - CLASSES) / sums[-1]) + np.arange(1, CLASSES + 1)[:, None]
        self.flat = self.limits.ravel().astype(np.float64)
        for t, sum_ in ((self.hits, total), (self.counts, sums[-1])):
            high = np.flatnonzero(sum_ > 4000)
            if len(high):
                t[:, high] = (t[:, high] + 1) // 2

    def predict(self, a: int):
        """For the first ``a`` blocks: both predicted ids, and up to where they go."""
        x1, slots = self.x1[:a], self.slots[:, :a]
        h = x1 * 40503
        h += self.x2[:a] * 9973
        h >>= 3
        h &= ORDER2 - 1
        np.add(h, self.at2[:a], out=slots[0])
        np.bitwise_and(x1, ORDER1 - 1, out=h)
        np.add(h, self.at1[:a], out=slots[1])
        self.held = self.seen.take(slots, mode="clip")
        sure = self.held >> 16
        self.context = self.at_context[:a] + (sure[0] + sure[1])
        return self.held & LARGEST, self.upto2.take(self.context, mode="clip"), self.upto1.take(self.context, mode="clip")

    def span(self, a: int, by2, by1, upto2, upto1, kind: np.ndarray):
        """Start and end, of WHOLE, of what is coded: the order-2 id, the order-1 id or a class."""
        at = np.multiply(kind, self.n, dtype=np.int64)
        at += self.lanes[:a]
        self.past.append((self.context, by2, by1, at))
        part = (WHOLE - upto1) * (1 / PARTS)
        low, high = (np.floor(self.flat.take(x, mode="clip") * part) + upto1 for x in (at, at + self.n))
        return np.where(by2, 0.0, np.where(by1, upto2, low)), np.where(by2, upto2, np.where(by1, upto1, high))

    def update(self, a: int, x: np.ndarray, same: np.ndarray) -> None:
        """``same``: which predicted ids are ``x``."""
        more = np.minimum(self.held, self.two)
        more &= self.three
        more *= same
        more += self.one
        more += x
        self.seen[self.slots[:, :a]] = more
        self.x2[:a], self.x1[:a] = self.x1[:a], x
        self.step += 1
        if self.step % REFRESH == 0 or self.step in (16, 32):
            self._refresh()


def _active(sizes: np.ndarray, steps: int) -> list[int]:
    """How many blocks are longer than each step; ``sizes`` falls."""
    return np.searchsorted(-sizes, -np.arange(steps), "left").tolist()


def _pack(values: np.ndarray, widths: np.ndarray) -> list[bytes]:
    """Each row's values as plain bits, lowest first."""
    if not widths.size:
        return [b""] * len(widths)
    upto = np.cumsum(widths, axis=1, dtype=np.int64)
    size = (upto[:, -1] + 31) // 32  # words of 32 bits: a row begins with one
    first = np.cumsum(size) - size
    at = (upto - widths + 32 * first[:, None]).ravel()
    word = at >> 5
    cuts = np.flatnonzero(np.diff(word, prepend=-1))
    sums = np.add.reduceat(values.ravel().astype(np.int64) << (at & 31), cuts)  # values share words, not bits
    out = np.zeros(int(size.sum()) + 2, np.int64)
    out[word[cuts]] = sums & 0xFFFFFFFF
    out[word[cuts] + 1] += sums >> 32
    raw = out.astype("<u4").tobytes()
    return [raw[4 * a : 4 * a + n] for a, n in zip(first.tolist(), ((upto[:, -1] + 7) // 8).tolist(), strict=True)]


def encode(blocks: list[np.ndarray]) -> list[bytes]:
    """A block's bytes for each array of ids."""
    order = sorted(range(len(blocks)), key=lambda i: -len(blocks[i]))
    sizes = np.array([len(blocks[i]) for i in order], np.int64)
    n, steps = len(blocks), int(sizes.max(initial=0))
    columns = np.zeros((steps, n), np.uint16)
    for k, i in enumerate(order):
        if len(blocks[i]) and int(blocks[i].max()) > LARGEST:
            raise ValueError(f"an id is over {LARGEST}")
        columns[: sizes[k], k] = blocks[i]
    model, kinds = Model(n), CLASS.take(columns)
    low, range_, at = np.zeros(n), np.full(n, LEAST * WHOLE), np.arange(n)
    words = np.zeros((steps + 1, n), np.uint32)
    flat = words.ravel()
    free = np.zeros((steps, n), bool)
    for t, a in enumerate(_active(sizes, steps)):
        x = columns[t, :a].astype(np.int32)
        held, upto2, upto1 = model.predict(a)
        same = held == x
        by2, by1 = same[0], same[0] | same[1]
        np.logical_not(by1, out=free[t, :a])
        start, end = model.span(a, by2, by1, upto2, upto1, kinds[t, :a])
        unit = np.floor(range_[:a] * (1 / WHOLE))
        start *= unit
        end *= unit
        end -= start
        start += low[:a]
        low[:a], range_[:a] = start, end
        # a word goes out where the range is short; its 17th bit is a carry
        short = np.flatnonzero(end < LEAST)
        lo, where = start[short], at[short]
        top = np.floor(lo * (1 / LEAST))
        flat[where] = top
        at[short] = where + n
        low[short] = (lo - top * LEAST) * WHOLE
        range_[short] = end[short] * WHOLE
        model.update(a, x, same)
    flat[at] = np.ceil(low * (1 / LEAST))  # the last word: a place in the range, zeros follow
    at //= n
    carry = np.zeros(n, np.uint32)
    for t in range(int(at.max(initial=0)), -1, -1):
        words[t] += carry
        carry = words[t] >> 16
    out: list[bytes] = [b""] * n
    for first in range(0, n, PACKED):
        some = slice(first, first + PACKED)
        width = BELOW.take(kinds[:, some].T) * free[:, some].T
        plain = _pack(columns[:, some].T & MASK.take(width), width)
        coded = np.ascontiguousarray(words[: int(at[some].max()) + 1, some].T).astype("<u2")
        for k in range(len(plain)):
            i, m = order[first + k], int(at[first + k]) + 1
            out[i] = MAGIC + struct.pack("<III", int(sizes[first + k]), zlib.crc32(blocks[i].astype("<u4").tobytes()), m) + coded[k, :m].tobytes() + plain[k]
    return out


def decode(blocks: list[bytes]) -> list[np.ndarray]:
    """The ids of each block; an error where a block's checksum is wrong."""
    heads = []
    for b in blocks:
        if b[:4] != MAGIC:
            raise ValueError("not an id block")
        heads.append(struct.unpack("<III", b[4:HEAD]))
        if HEAD + 2 * heads[-1][2] > len(b):
            raise ValueError("an id block is cut")
    order = sorted(range(len(blocks)), key=lambda i: -heads[i][0])
    sizes = np.array([heads[i][0] for i in order], np.int64)
    n, steps = len(blocks), int(sizes.max(initial=0))
    model = Model(n)
    # all blocks' words, with the zeros that follow, and all plain bits, 4 bytes from each byte on
    coded = [blocks[i][HEAD : HEAD + 2 * heads[i][2]] + bytes(6) for i in order]
    plain = [blocks[i][HEAD + 2 * heads[i][2] :] for i in order]
    words = np.frombuffer(b"".join(coded), "<u2")
    at = np.cumsum([0, *(len(c) // 2 for c in coded)])[:-1]
    raw = np.frombuffer(b"".join([*plain, bytes(4)]), np.uint8)
    bits = raw[:-3].astype(np.uint32)
    for k in (1, 2, 3):
        bits |= raw[k : len(raw) - 3 + k].astype(np.uint32) << np.uint32(8 * k)
    place = 8 * np.cumsum([0, *map(len, plain)])[:-1]
    code, range_ = np.zeros(n), np.full(n, LEAST * WHOLE)
    for _ in range(3):
        code = code * WHOLE + words[at]
        at += 1
    columns = np.zeros((steps, n), np.uint16)
    for t, a in enumerate(_active(sizes, steps)):
        held, upto2, upto1 = model.predict(a)
        unit = np.floor(range_[:a] * (1 / WHOLE))
        v = np.minimum(np.floor(code[:a] / unit), WHOLE - 1)  # exact: the quotient has 16 bits, the unit 32
        by2, by1 = v < upto2, v < upto1
        # floor(limit * rest / PARTS) is at most a place exactly if limit is at most ((place + 1) * PARTS - 1) / rest
        v -= upto1
        within = ((np.maximum(v, 0) * PARTS + (PARTS - 1)) / (WHOLE - upto1)).astype(np.int16)
        kind = np.add.reduce((model.limits[1:-1, :a] <= within).view(np.uint8), axis=0, dtype=np.uint8)
        start, end = model.span(a, by2, by1, upto2, upto1, kind)
        width = BELOW.take(kind) * ~by1
        spot = place[:a]
        tail = (bits.take(spot >> 3, mode="clip") >> (spot & 7).astype(np.uint32)).astype(np.int32) & MASK.take(width)
        spot += width
        x = np.where(by2, held[0], np.where(by1, held[1], LEAD.take(kind) + tail))
        start *= unit
        end *= unit
        end -= start
        code[:a] -= start
        range_[:a] = end
        short = np.flatnonzero(end < LEAST)
        where = at[short]
        code[short] = np.minimum(code[short] * WHOLE + words.take(where, mode="clip"), LEAST * WHOLE)  # a damaged block's can be anything
        at[short] = where + 1
        range_[short] = end[short] * WHOLE
        model.update(a, x, held == x)
        columns[t, :a] = x
    out: list = [None] * n
    for k, i in enumerate(order):
        ids = columns[: sizes[k], k].astype("<u4")
        if zlib.crc32(ids.tobytes()) != heads[i][1]:
            raise ValueError("an id block's checksum is wrong")
        out[i] = ids
    return out
