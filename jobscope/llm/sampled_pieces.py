"""SentencePiece encoding and decoding: segmentations sampled without replacement.

A text's lattice falls into units (a run of the space sign and what follows up to
the next), as no piece crosses their borders.  Each distinct unit's lattice is
built once for a slice of texts, and kept for later ones: edges are the model's pieces, a character
without one is spelled in bytes, and sums from the end backwards give the
probability of every edge.

The K most likely segmentations after a Gumbel perturbation are K samples
without replacement.  They are found by perturbed A* search: a region is the
set of segmentations that share a prefix and leave an excluded choice behind
it; its mass is exact, and its perturbed maximum is drawn top-down from a
Gumbel truncated at the region it was cut from.  The best region's segmentation
is sampled, emitted, and cuts its region at each following unit.  The perturbed
maximum behind the last sample gives the inclusion probabilities.
"""

from __future__ import annotations

import heapq
import math
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import words as W
from .common import register, table, texts

#: Samples of each text.
K = 2
#: Regions of a mass below e**-FAINT of their text's are left out: less than a double's rounding of the rest.
FAINT = 38.0
#: A piece of rank r in a BPE model weighs 1 / (r + SHIFT), as words of a language do.
SHIFT = 10.0
#: Units whose masses are looked at first.
NEAR = 64
SPACE = "▁"
#: The bits of a key.
ALL = (1 << 64) - 1
#: Code points handled at once (a longer document is a slice of its own).
SLICE_CHARS = 1 << 17
#: States of the lattices that a task keeps from slice to slice.
KNOWN_STATES = 5 << 17


class Pieces:
    """The model's pieces, as a lattice needs them."""

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        self.text = [sp.id_to_piece(i) for i in range(n)]
        score = np.array([sp.get_score(i) for i in range(n)])
        self.special = np.array([sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i) or sp.is_byte(i) for i in range(n)])
        normal = np.flatnonzero(~self.special)
        if (score[normal] == np.round(score[normal])).all():  # BPE: scores are ranks
            weight = -np.log(np.arange(len(normal)) + SHIFT)
        else:
            weight = score[normal]
        weight = weight - np.logaddexp.reduce(weight)
        self.byte = {int(t[1:-1], 16): i for i, t in enumerate(self.text) if sp.is_byte(i)}
        self.unknown = sp.unk_id()
        #: Weight of a byte, or of the unknown piece in a model without bytes: that of the rarest piece.
        self.rare = float(weight.min())
        h = W.hasher(2)
        keys = np.array([h_chars(h, char_sums(h, np.frombuffer(self.text[i].encode("utf-32-le"), "<u4")), np.array([0]), np.array([len(self.text[i])]))[0] for i in normal], np.uint64)
        length = np.array([len(self.text[i]) for i in normal])
        self.longest = int(length.max())
        self.keys, self.ids, self.weight = keys, normal, weight
        #: Of each of 2**20 hash values a piece that has it, and of each piece the next one: most strings are told by a look.
        self.slot, self.next = np.full(1 << 20, -1, np.int32), np.full(len(keys), -1, np.int32)
        for j, v in enumerate((keys >> np.uint64(44)).tolist()):
            self.next[j], self.slot[v] = self.slot[v], j
        #: Which of them any beginning of a longer piece has: a place is left once no piece can go on from it.
        self.goes_on = np.zeros(1 << 20, bool)
        at = np.concatenate([[0], np.cumsum(length)])
        sums = char_sums(h, np.frombuffer("".join(self.text[i] for i in normal).encode("utf-32-le"), "<u4"))
        for n in range(1, self.longest):
            some = at[:-1][length > n]
            self.goes_on[h_chars(h, sums, some, some + n) >> np.uint64(44)] = True
        self.lengths = set(length.tolist())
        self._spelling: dict[int, np.ndarray] = {}
        self.bytes_text = np.array([bytes([int(t[1:-1], 16)]) if sp.is_byte(i) else t.encode() for i, t in enumerate(self.text)], object)

    def find(self, marks: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which hashes are a piece's, and its place; ``first`` holds ``slot`` of each."""
        at = np.flatnonzero(first >= 0)
        piece = first[at]
        while True:
            other = np.flatnonzero((self.keys[piece] != marks[at]) & (piece >= 0))
            if not len(other):
                hit = np.flatnonzero(piece >= 0)
                return at[hit], piece[hit]
            piece[other] = self.next[piece[other]]

    def spelling(self, char: int) -> np.ndarray:
        """The pieces of a code point that is no piece itself."""
        if char not in self._spelling:
            if len(self._spelling) >= 1 << 16:
                self._spelling.clear()
            self._spelling[char] = np.array([self.byte[b] for b in chr(char).encode("utf-8", "surrogatepass")] if self.byte else [self.unknown], np.int64)
        return self._spelling[char]

    def decode(self, ids) -> str:
        """The text of piece ids: space signs are spaces, but for the one that encoding puts first."""
        out = b"".join(self.bytes_text[np.asarray(ids, np.int64)].tolist()).decode(errors="replace").replace(SPACE, " ")
        return out[1:] if out.startswith(" ") else out


@lru_cache(maxsize=2)
def pieces(path: str) -> Pieces:
    return Pieces(path)


def char_sums(h: W.Hasher, chars: np.ndarray) -> np.ndarray:
    h._powers(len(chars) + 1)
    c = np.zeros(len(chars) + 1, np.uint64)
    np.cumsum(W.mix(chars.astype(np.uint64) + np.uint64(1)) * h.up[: len(chars)], out=c[1:])
    return c


def h_chars(h: W.Hasher, sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of ranges of code points, from their sums."""
    return W.mix((sums[ends] - sums[starts]) * h.down[starts] + (ends - starts).astype(np.uint64))


class Lattices:
    """Lattices of distinct units: a state for each code point and one behind the last."""

    def __init__(self, model: Pieces, chars: np.ndarray, begin: np.ndarray, size: np.ndarray):
        """``begin``, ``size``: the distinct units' ranges of ``chars``."""
        h = W.hasher(2)
        total = int(size.sum())
        offset = np.concatenate([[0], np.cumsum(size)])
        own = chars[np.repeat(begin - offset[:-1], size) + np.arange(total)]
        left = np.repeat(offset[1:], size) - np.arange(total)  # code points up to the unit's end
        state = np.arange(total) + np.repeat(np.arange(len(size)), size)  # with an end state behind each unit
        self.start = offset[:-1] + np.arange(len(size))
        self.end = self.start + size
        source, length, piece, weight = [], [], [], []
        single = np.zeros(total, bool)
        sums = char_sums(h, own)
        places = np.arange(total)
        for n in range(1, model.longest + 1):
            places = places[left[places] >= n]
            if not len(places):
                break
            mark = h_chars(h, sums, places, places + n)
            short = mark >> np.uint64(44)
            if n in model.lengths:
                hit, found = model.find(mark, model.slot[short])
                source.append(places[hit])
                length.append(np.full(len(hit), n))
                piece.append(model.ids[found])
                weight.append(model.weight[found])
                if n == 1:
                    single[places[hit]] = True
            places = places[model.goes_on[short]]
        bare = np.flatnonzero(~single)  # spelled in bytes: piece -1 less the code point
        source.append(bare)
        length.append(np.ones(len(bare), np.int64))
        piece.append(-1 - own[bare].astype(np.int64))
        width = 1 + (own[bare] > 0x7F) + (own[bare] > 0x7FF) + (own[bare] > 0xFFFF) if model.byte else 1
        weight.append(model.rare * width * np.ones(len(bare)))
        source, length, piece, weight = (np.concatenate(x) for x in (source, length, piece, weight))
        order = np.argsort(source, kind="stable")  # a few ascending runs
        source, length, self.piece, weight = source[order], length[order], piece[order].astype(np.int64), weight[order]
        self.to = state[source] + length
        first = np.searchsorted(source, np.arange(total))
        count = np.diff(np.append(first, len(source)))
        states = total + len(size)
        self.first, self.count = np.zeros(states, np.int64), np.zeros(states, np.int64)
        self.first[state], self.count[state] = first, count
        # sums from the end: all states as far from it as another at once
        beta = np.zeros(states)
        by = np.argsort(left, kind="stable")
        cuts = np.searchsorted(left[by], np.arange(1, int(left.max(initial=0)) + 2))
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            s = by[a:b]
            n = count[s]
            begin_ = np.cumsum(n) - n
            e = np.repeat(first[s] - begin_, n) + np.arange(int(n.sum()))
            value = weight[e] + beta[self.to[e]]
            top = np.maximum.reduceat(value, begin_)
            beta[state[s]] = top + np.log(np.add.reduceat(np.exp(value - np.repeat(top, n)), begin_))
        logp = weight + beta[self.to] - beta[state[source]]
        # a state's likeliest edge stands first
        if len(logp):
            best = np.flatnonzero(logp == np.repeat(np.maximum.reduceat(logp, first), count))
            best = best[np.searchsorted(best, first)]
            for a in (logp, self.piece, self.to):
                a[first], a[best] = a[best], a[first]
        self.logp = logp
        p = np.exp(self.logp)
        run = np.cumsum(p)
        whole = np.repeat(np.add.reduceat(p, first), count) if len(p) else p
        #: Probability of a state's edges up to each, for drawing.
        self.upto = (run - np.repeat(run[first] - p[first], count)) / whole if len(p) else p
        self.upto[first + count - 1] = 1.0
        #: Probability of a state's other edges: summed without the edge where the difference would lose digits.
        self.other = np.maximum(whole - p, 0.0)
        rest = p.copy()
        rest[first] = 0.0
        if len(p):
            self.other[first] = np.add.reduceat(rest, first)


class Known:
    """Lattices of a task's units: those met first are kept, as far as KNOWN_STATES
    go, and behind them stand those that only the slice at hand has."""

    #: Of each array what it counts along, what its numbers are places of, and its type.
    ARRAYS = {"start": ("unit", "state", np.int64), "end": ("unit", "state", np.int64), "mark": ("unit", None, np.uint64),
              "first": ("state", "edge", np.int64), "count": ("state", None, np.int32), "to": ("edge", "state", np.int32),
              "piece": ("edge", None, np.int32), "logp": ("edge", None, np.float64), "upto": ("edge", None, np.float64), "other": ("edge", None, np.float64)}

    def __init__(self):
        self.kept = {"unit": 0, "state": 0, "edge": 0}
        for name, (_, _, kind) in self.ARRAYS.items():
            setattr(self, name, np.zeros(1, kind))
        #: Of each of 2**20 hash values a unit that has it.
        self.slot = np.full(1 << 20, -1, np.int32)

    def units(self, model: Pieces, chars: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
        """The number of each unit, a range of ``chars``, after the lattices of new ones have been built."""
        h = W.hasher(2)
        mark = h_chars(h, char_sums(h, chars), begin, begin + size)
        unit = self.slot[mark >> np.uint64(44)].astype(np.int64)
        new = np.flatnonzero((unit < 0) | (self.mark[unit] != mark))
        if len(new):
            marks, one, number = np.unique(mark[new], return_index=True, return_inverse=True)
            unit[new] = self.kept["unit"] + number
            one = new[one]
            self.add(Lattices(model, chars, begin[one], size[one]), marks)
        return unit

    def add(self, lat: Lattices, marks: np.ndarray) -> None:
        lat.mark = marks
        for name, (along, places, _) in self.ARRAYS.items():
            own, a, n = getattr(lat, name), getattr(self, name), self.kept[along]
            if len(a) < n + len(own):
                grown = np.empty(max(n + len(own), n + n // 2), a.dtype)
                grown[:n] = a[:n]
                setattr(self, name, grown)
                a = grown
            a[n : n + len(own)] = own + self.kept[places] if places else own
        if self.kept["state"] + len(lat.first) <= KNOWN_STATES:
            self.slot[marks >> np.uint64(44)] = self.kept["unit"] + np.arange(len(marks))
            self.kept = {"unit": self.kept["unit"] + len(marks), "state": self.kept["state"] + len(lat.first), "edge": self.kept["edge"] + len(lat.to)}

    def draw(self, at: np.ndarray, u: np.ndarray) -> np.ndarray:
        """An edge out of each state, by its probability."""
        e = self.first[at]
        more = np.flatnonzero(u >= self.upto[e])
        while len(more):
            e[more] += 1
            more = more[u[more] >= self.upto[e[more]]]
        return e


def uniform(key: np.ndarray, *more) -> np.ndarray:
    """Numbers in (0, 1) by key: the same for the same key wherever it is computed."""
    for m in more:
        key = W.mix(key * np.uint64(0x9E3779B97F4A7C15) + np.asarray(m).astype(np.uint64) + np.uint64(1))
    return ((key >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53


def spread(h: int) -> int:
    """``words.mix`` of one number: a text's own draws need no arrays."""
    h ^= h >> 32
    h = h * 0xD6E8FEB86659FD93 & ALL
    h ^= h >> 32
    h = h * 0xD6E8FEB86659FD93 & ALL
    return h ^ h >> 32


def step_key(key: int, more: int) -> int:
    """The key that ``uniform`` goes on with after one of its numbers."""
    return spread(key * 0x9E3779B97F4A7C15 + more + 1 & ALL)


def walk(lat: Known, unit: np.ndarray, seed: np.ndarray):
    """Sample a segmentation of each unit occurrence: (edges, first edge of each, log p, probability of all others)."""
    n = len(unit)
    at = lat.start[unit]
    live = np.arange(n)
    logp, other = np.zeros(n), np.zeros(n)
    steps, who, edges = np.zeros(n, np.int64), [], []
    k = 0
    while len(live):
        e = lat.draw(at[live], uniform(seed[live], k))
        other[live] += np.exp(logp[live]) * lat.other[e]
        logp[live] += lat.logp[e]
        at[live] = lat.to[e]
        who.append(live)
        edges.append(e)
        steps[live] += 1
        live = live[at[live] != lat.end[unit[live]]]
        k += 1
    first = np.concatenate([[0], np.cumsum(steps)])
    out = np.zeros(first[-1], np.int64)
    for k, (w, e) in enumerate(zip(who, edges, strict=True)):
        out[first[w] + k] = e
    return out, first, logp, other


def _edges(lat: Known, state: int, taken: list) -> tuple[int, list, dict]:
    """The first edge out of a state, the probability of each less that of ``taken``, and what follows the taken ones."""
    e = int(lat.first[state])
    p = np.exp(lat.logp[e : e + int(lat.count[state])]).tolist()
    by: dict[int, list] = {}
    for t in taken:
        by.setdefault(int(t[0]), []).append(t[1:])
    for f, rest in by.items():
        p[f - e] *= _free(lat, int(lat.to[f]), rest)
    return e, p, by


def _free(lat: Known, state: int, taken: list) -> float:
    """Probability from ``state`` on of all segmentations but those in ``taken`` (edge tuples)."""
    if not taken:
        return 1.0
    if () in taken:
        return 0.0
    return sum(_edges(lat, state, taken)[1])


def _other_than(lat: Known, unit: int, taken: list, key: int) -> list:
    """Sample a segmentation of a unit that is not in ``taken``."""
    state, end, path, k = int(lat.start[unit]), int(lat.end[unit]), [], 0
    while state != end:
        e, p, by = _edges(lat, state, taken)
        x = ((step_key(key, k) >> 11) + 0.5) * 2.0**-53 * sum(p)
        choice = max((i for i, v in enumerate(p) if v > 0), default=0)
        for i, v in enumerate(p):
            x -= v
            if x < 0 and v > 0:
                choice = i
                break
        path.append(e + choice)
        taken = by.get(e + choice, [])
        state, k = int(lat.to[e + choice]), k + 1
    return path


class Sample:
    """A segmentation of a text: for each unit its edges, log p and the probability of its others."""

    __slots__ = ("edges", "first", "logp", "other", "total")

    def __init__(self, edges, first, logp, other):
        self.edges, self.first, self.logp, self.other = edges, first, logp, other
        self.total = float(logp.sum())


class Search:
    """The regions of one text, of which ``k`` samples are wanted."""

    def __init__(self, key: int, units: np.ndarray, k: int = K):
        self.key, self.units, self.heap, self.n, self.cuts, self.k = key, units, [], 0, 0, k

    def cut(self, lat: Known, x: Sample, g: float, begin: int, taken: list, last: bool = False) -> None:
        """Cut the region of ``x``, whose maximum is g: from unit ``begin`` on free, where ``taken`` is excluded.

        After the ``last`` sample only the best region's maximum is asked for."""
        w = len(self.units)
        if begin >= w:
            return
        near = begin + NEAR
        while True:  # a few units on, what follows is faint
            before = np.concatenate([[0.0], np.cumsum(x.logp[:near])])[begin:min(near, w)]
            some = int(np.searchsorted(-before, FAINT - before[0], "right"))
            if some < len(before) or near >= w:
                break
            near = begin + 4 * (near - begin)
        before = before[:some]
        mass = x.other[begin : begin + len(before)].copy()
        own = tuple(x.edges[x.first[begin] : x.first[begin + 1]])
        if taken:
            mass[0] = _free(lat, int(lat.start[self.units[begin]]), [*taken, own])
        some = np.flatnonzero(mass > 0)
        if not len(some):
            return
        phi = before[some] + np.log(mass[some])
        u = uniform(np.array([step_key(self.key, 1_000_003 + self.cuts)], np.uint64), begin + some)
        top = -np.logaddexp(-g, np.log(-np.log(u)) - phi)
        if last:
            heapq.heappush(self.heap, (-float(top.max()), self.n))
            self.n += 1
            return
        # only the k + 1 best of a text's regions can ever be chosen, or bound the samples
        for i in np.argpartition(-top, min(self.k, len(top) - 1))[: self.k + 1]:
            j = int(begin + some[i])
            heapq.heappush(self.heap, (-float(top[i]), self.n, j, x, [*(taken if j == begin else []), tuple(x.edges[x.first[j] : x.first[j + 1]])]))
            self.n += 1
        self.cuts += 1


def _slices(batches):
    """(ids, texts) of about SLICE_CHARS code points, over batch borders."""
    ids, own, size = [], [], 0
    for batch in batches:
        for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if size and size + len(t) > SLICE_CHARS:
                yield ids, own
                ids, own, size = [], [], 0
            ids.append(i)
            own.append(t)
            size += len(t)
    if own:
        yield ids, own


def sample_slice(model: Pieces, own: list[str], keys: np.ndarray, k: int, known: Known | None = None):
    """For each text its samples: (piece ids, log p, perturbed log p, inclusion probability), best first."""
    lat = known or Known()
    joined = [SPACE + t.replace(" ", SPACE) if t else "" for t in own]
    chars = np.frombuffer("".join(joined).encode("utf-32-le", "surrogatepass"), "<u4")
    off = np.concatenate([[0], np.cumsum([len(j) for j in joined])])
    space = chars == ord(SPACE)
    first = space.copy()
    first[1:] &= ~space[:-1]
    first[off[:-1][off[:-1] < off[1:]]] = True
    begin = np.flatnonzero(first)
    size = np.diff(np.append(begin, len(chars)))
    row_units = np.searchsorted(begin, off)
    unit = lat.units(model, chars, begin, size)

    rows = len(own)
    searches = [Search(int(keys[r]), unit[row_units[r] : row_units[r + 1]], k) for r in range(rows)]
    results: list[list] = [[] for _ in range(rows)]
    # what each row samples next: from which unit on, and what stands before
    todo = [(r, 0, None, None, g) for r, g in enumerate((-np.log(-np.log(uniform(keys, 0, 0)))).tolist())]
    for n in range(k):
        if not todo:
            break
        from_, lengths = [], []
        for r, j, _, path, _ in todo:
            a = j + (path is not None)
            from_.append(searches[r].units[a:])
            lengths.append(len(searches[r].units) - a)
        at = np.concatenate([[0], np.cumsum(lengths)])
        row = np.repeat([t[0] for t in todo], lengths)
        place = np.arange(at[-1]) - np.repeat(at[:-1], lengths)
        seed = W.mix(keys[row] * np.uint64(0xD6E8FEB86659FD93) + np.uint64((n + 1) * 0x9E3779B97F4A7C15 % (1 << 64)) + place.astype(np.uint64))
        edges, start, logp, other = walk(lat, np.concatenate(from_).astype(np.int64), seed)
        following = []
        for i, (r, j, base, path, g) in enumerate(todo):
            a, b = at[i], at[i + 1]
            new = edges[start[a] : start[b]], start[a : b + 1] - start[a], logp[a:b], other[a:b]
            if path is None:
                x, cut_from, taken = Sample(*new), 0, []
            else:
                base, taken = base
                head = base.first[j]
                chosen = np.array(path)
                p = float(lat.logp[chosen].sum())
                before = np.concatenate([[0.0], np.cumsum(lat.logp[chosen])[:-1]])
                rest = float((np.exp(before) * lat.other[chosen]).sum())
                x = Sample(
                    np.concatenate([base.edges[:head], chosen, new[0]]),
                    np.concatenate([base.first[: j + 1], head + len(chosen) + new[1]]),
                    np.concatenate([base.logp[:j], [p], new[2]]),
                    np.concatenate([base.other[:j], [rest], new[3]]),
                )
                cut_from = j
            results[r].append((x, g))
            s = searches[r]
            s.cut(lat, x, g, cut_from, taken, n + 1 == k)
            if s.heap and n + 1 < k:
                top, _, j2, x2, taken2 = heapq.heappop(s.heap)
                key = spread(s.key + 77_777 * (n + 1) & ALL)
                following.append((r, j2, (x2, taken2), _other_than(lat, int(s.units[j2]), taken2, key), -top))
        todo = following

    out = []
    for r in range(rows):
        heap = searches[r].heap
        limit = -heap[0][0] if heap else -math.inf
        got = []
        for x, g in results[r]:
            ids = lat.piece[x.edges]
            bare = np.flatnonzero(ids < 0)
            if len(bare):
                ids = _spelled(model, ids, bare)
            got.append((ids.astype("<u4"), x.total, g + 0.0, 1.0 if limit == -math.inf else -math.expm1(-math.exp(min(x.total - limit, 700.0)))))
        out.append(got)
    return out


def _spelled(model: Pieces, ids: np.ndarray, bare: np.ndarray) -> np.ndarray:
    parts, last = [], 0
    for i in bare:
        parts.append(ids[last:i])
        parts.append(model.spelling(-1 - int(ids[i])))
        last = i + 1
    return np.concatenate([*parts, ids[last:]])


def _lists(found) -> pa.ListArray:
    ends = np.cumsum([0, *map(len, found)], dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.zeros(0, "<u4"), *found]).astype(np.int32)))


def sampler(path: str, k: int, with_ids: bool):
    def sample(batches):
        model, known = pieces(path), Known()
        for ids, own in _slices(batches):
            keys = W.mix(np.array([-1 if i is None else i for i in ids], np.int64).view(np.uint64) + np.uint64(0x5EED))
            out = []
            for i, t, got in zip(ids, own, sample_slice(model, own, keys, k, known), strict=True):
                for n, (found, logp, g, q) in enumerate(got):
                    raw = found.tobytes()
                    out.append((i, n, len(found), logp, g, q, zlib.crc32(raw), model.decode(found) == t, found if with_ids else None))
            cols = list(zip(*out, strict=True)) or [()] * 9
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.float64(), pa.float64(), pa.float64(), pa.int64(), pa.bool_())
            names = ["doc_id", "sample", "n_tokens", "log_prob", "perturbed", "inclusion", "ids_crc32", "round_trip", "ids"]
            arrays = [pa.array(c, t) for c, t in zip(cols[:8], kinds, strict=True)]
            if with_ids:
                arrays.append(_lists(cols[8]))
            yield pa.RecordBatch.from_arrays(arrays, names=names[: len(arrays)])

    return sample


def samples(docs: DataFrame, model: str, k: int = K, with_ids: bool = True) -> DataFrame:
    """Up to ``k`` distinct segmentations of each row's text, best perturbed score first.

    Columns: doc_id, sample (from 0), n_tokens, log_prob, perturbed (log_prob
    plus Gumbel noise, falling), inclusion (probability of being among the k),
    ids_crc32 (of the ids as little-endian unsigned 32-bit integers),
    round_trip (decoding gives the text back) and, with ``with_ids``, ids.
    Seeded by doc_id (a null one by -1): rows with equal id and text have equal
    samples.  A text with fewer than k segmentations has a row for each, with
    inclusion 1; an empty or null one has one row without ids.
    ``round_trip`` is false for a text that has the space sign itself.
    """
    W.small_batches(docs.sparkSession)
    schema = "doc_id long, sample int, n_tokens long, log_prob double, perturbed double, inclusion double, ids_crc32 long, round_trip boolean"
    return texts(docs).mapInArrow(sampler(model, k, with_ids), schema + (", ids array<int>" if with_ids else ""))


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


@register("op9_sentencepiece_sampling")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return samples(table(spark, sf_dir, "documents"), default_model())
