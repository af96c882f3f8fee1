"""Adaptive context-mixing range coder for token ids.

A block of ids is coded by itself: its model starts afresh, and its alphabet (the distinct ids,
any unsigned 32-bit values) stands in front.  Three orders predict every id:

* order 0: the frequencies of the block's ids so far, over the whole alphabet;
* order 1 and order 2: the id that followed the last one or two ids, with how often running it did.

The three predictions are mixed linearly, and the mixture drives the arithmetic coder.  The weights
are learned: of every pair of confidences, the block counts how often either guess was right.

A block is cut into lanes, which are coded side by side, one numpy element each, and share one
model: what is learned in a lane serves all.  The coder has 64-bit state and 32-bit output words;
a carry goes into the words already written.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np

#: Ids must be below this; a larger or negative one is refused when it is encoded.
ID_LIMIT = 1 << 32
#: Lanes of a block at most, and ids for which one more lane is opened.
LANES, LANE_IDS = 8192, 256
_SURE = 3  # bits of a confidence
_MOST = (1 << _SURE) - 1
_CONTEXTS = 1 << (2 * _SURE)
_PAIRS = 16  # log2 of the slots of the order-2 table
_WEIGHT = 8  # bits of a mixture weight
_EVERY = 16  # steps between two renewals of frequencies and weights, fewer at the start
_COUNTED = 5  # of so many steps, one is counted for the weights; an odd number, as lanes may run in step
_WORD = np.uint64(32)
_FULL = np.uint64(1 << 32)

# A coded letter stands below (0), at (1) or above (2) the guess of order 1, and that of order 2: nine cases of every context.
_CASE = np.arange(_CONTEXTS * 9)
_BY1, _BY2 = _CASE // 3 % 3, _CASE % 3
_NEXT1 = np.where(_BY1 == 1, np.minimum((_CASE // 9 & _MOST) + 1, _MOST), 0)
_NEXT2 = np.where(_BY2 == 1, np.minimum((_CASE // 9 >> _SURE) + 1, _MOST), 0)


class _Mixture:
    """The shared model of a block of ``letters`` distinct ids, coded by ``lanes`` lanes."""

    def __init__(self, letters: int, lanes: int, invert: bool):
        self.letters, self.invert = letters, invert
        size = int(letters - 1).bit_length()
        self.bits = max(16, min(size + 6, 20), size + 2)
        self.total = self.bits + _WEIGHT
        self.one, self.two = np.zeros(letters, np.int64), np.zeros(1 << _PAIRS, np.int64)
        self.last, self.before = np.zeros(lanes, np.int64), np.zeros(lanes, np.int64)
        self.seen = np.zeros(letters, np.int64)
        self.hits = np.zeros(_CONTEXTS * 9, np.int64)
        self.renew()

    def renew(self) -> None:
        """Frequencies and weights from the counts so far."""
        room, n = 1 << self.bits, int(self.seen.sum())
        self.size = 1 + self.seen * (room - self.letters) // n if n else np.full(self.letters, room // self.letters)
        self.size[int(self.seen.argmax())] += room - int(self.size.sum())
        self.start = np.cumsum(self.size) - self.size
        if self.invert:
            self.letter = np.repeat(np.arange(self.letters, dtype=np.uint16 if self.letters <= 1 << 16 else np.uint32), self.size)
        hits = self.hits.reshape(_CONTEXTS, 3, 3)
        tries, space = hits.sum(axis=(1, 2)) + 2, (1 << _WEIGHT) - 4
        # where both guesses held, the higher order takes the credit
        two = hits[:, :, 1].sum(axis=1) * space // tries
        one = (hits[:, 1].sum(axis=1) - hits[:, 1, 1]) * space // tries
        self.w0, self.w1, self.w2 = (1 << _WEIGHT) - one - two, one << self.bits, two << self.bits
        w1, w2 = np.repeat(self.w1, 9), np.repeat(self.w2, 9)
        self.below = w1 * (_BY1 == 2) + w2 * (_BY2 == 2)
        self.extra = w1 * (_BY1 == 1) + w2 * (_BY2 == 1)

    def guess(self, n: int) -> None:
        """For the first ``n`` lanes: the guesses of orders 1 and 2, and the context that weighs them."""
        self.p1 = self.last[:n]
        p2 = self.p1 * 0x2F0B4C47
        p2 += self.before[:n] * 0x1E35A7BD
        p2 >>= 12
        p2 &= (1 << _PAIRS) - 1
        self.p2 = p2
        e1, e2 = self.one[self.p1], self.two[p2]
        self.g1, self.g2 = e1 >> _SURE, e2 >> _SURE
        e1 &= _MOST
        e2 &= _MOST
        e2 <<= _SURE
        e1 += e2
        self.context = e1
        self.a0 = self.w0[e1]

    def interval(self, s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Start and size of the letters ``s`` in the mixture; keeps their cases."""
        by1 = (s >= self.g1).view(np.int8) + (s > self.g1).view(np.int8)
        by2 = (s >= self.g2).view(np.int8) + (s > self.g2).view(np.int8)
        by1 *= 3
        by1 += by2
        self.case = self.context * 9
        self.case += by1
        start, size = self.start[s], self.size[s]
        start *= self.a0
        start += self.below[self.case]
        size *= self.a0
        size += self.extra[self.case]
        return start, size

    def find(self, t: np.ndarray) -> np.ndarray:
        """The letters whose intervals hold the targets ``t``.

        A letter's interval begins with the weights of the guesses that name it.  What of them
        stands below the target is taken off, which leaves the order-0 part.
        """
        a1, a2 = self.w1[self.context], self.w2[self.context]
        s1, s2 = self.start[self.g1], self.start[self.g2]
        s1 *= self.a0
        s1 += a2 * (self.g1 > self.g2)
        s2 *= self.a0
        s2 += a1 * (self.g2 >= self.g1)
        np.subtract(t, s1, out=s1)
        np.maximum(s1, 0, out=s1)
        np.minimum(s1, a1, out=s1)
        np.subtract(t, s2, out=s2)
        np.maximum(s2, 0, out=s2)
        np.minimum(s2, a2, out=s2)
        t -= s1
        t -= s2
        return self.letter[(t / self.a0).astype(np.int64)].astype(np.int64)

    def learn(self, n: int, s: np.ndarray, counted: bool) -> None:
        """The letters of the first ``n`` lanes after ``interval``; of lanes that share a slot, the last one's stays."""
        entry = s << _SURE
        self.one[self.p1] = entry + _NEXT1[self.case]
        entry += _NEXT2[self.case]
        self.two[self.p2] = entry
        if counted:
            self.hits += np.bincount(self.case, minlength=len(self.hits))
        self.before[:n] = self.p1
        self.last[:n] = s


class _Grid:
    """The ids of a block by step and lane.

    Lanes take consecutive ids, the first ones one more where it does not come out even.
    """

    def __init__(self, n: int):
        self.n, self.lanes = n, max(1, min(LANES, n // LANE_IDS))
        self.whole, self.more = divmod(n, self.lanes)
        self.cells = np.zeros((self.whole + 1, self.lanes), np.int32)

    def _parts(self, flat: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        edge = self.more * (self.whole + 1)
        return flat[:edge].reshape(self.more, self.whole + 1), flat[edge:].reshape(self.lanes - self.more, self.whole)

    def fill(self, flat: np.ndarray) -> None:
        first, rest = self._parts(flat)
        self.cells[:, : self.more] = first.T
        self.cells[: self.whole, self.more :] = rest.T

    def flat(self) -> np.ndarray:
        out = np.zeros(self.n, np.int32)
        first, rest = self._parts(out)
        first[:] = self.cells[:, : self.more].T
        rest[:] = self.cells[: self.whole, self.more :].T
        return out

    def steps(self, model: _Mixture) -> Iterator[tuple[int, int]]:
        """(step, lanes that have an id); between two steps, the model is renewed where it is time."""
        known = 0
        for t in range(self.whole + (self.more > 0)):
            yield t, self.lanes if t < self.whole else self.more
            if t % _EVERY == 0 or (t < _EVERY and t & (t - 1) == 0):
                model.seen += np.bincount(self.cells[known : t + 1].ravel(), minlength=model.letters)
                known = t + 1
                model.renew()


def _letters(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(distinct ids in order, the place of every id among them)."""
    if int(ids.max()) < 1 << 20:
        there = np.zeros(int(ids.max()) + 1, dtype=bool)
        there[ids] = True
        return np.flatnonzero(there), (np.cumsum(there, dtype=np.int32) - 1)[ids]
    return np.unique(ids, return_inverse=True)


def encode_block(ids: np.ndarray) -> bytes:
    """A block of ids (integers from 0 to below ``ID_LIMIT``) as bytes."""
    ids = np.asarray(ids, dtype=np.int64)
    n = len(ids)
    if not n:
        return b""
    if ids.min() < 0 or ids.max() >= ID_LIMIT:
        raise ValueError(f"ids must be from 0 to {ID_LIMIT - 1}")
    alphabet, letters = _letters(ids)
    grid = _Grid(n)
    grid.fill(letters)
    lanes, model = grid.lanes, _Mixture(len(alphabet), grid.lanes, invert=False)
    shift = np.uint64(model.total)
    low, wide = np.zeros(lanes, np.uint64), np.full(lanes, np.iinfo(np.uint64).max)
    room = (grid.whole + 1) * model.total // 32 + 4
    out, begin = np.zeros(lanes * room, np.uint32), np.arange(lanes) * room
    at = begin.copy()

    def carry(lane: np.ndarray) -> None:
        place = at[lane] - 1
        while len(place):
            out[place] += np.uint32(1)
            place = place[out[place] == 0] - 1

    for t, m in grid.steps(model):
        s = grid.cells[t, :m].astype(np.int64)
        model.guess(m)
        start, size = model.interval(s)
        mine, part = low[:m], wide[:m]
        part >>= shift
        add = part * start.view(np.uint64)
        mine += add
        over = np.flatnonzero(mine < add)
        if len(over):
            carry(over)
        part *= size.view(np.uint64)
        full = np.flatnonzero(part < _FULL)
        if len(full):
            word, place = mine[full], at[full]
            out[place] = (word >> _WORD).astype(np.uint32)
            at[full] = place + 1
            mine[full] = word << _WORD
            part[full] <<= _WORD
        model.learn(m, s, t % _COUNTED == 0)
    tail = low + np.uint64((1 << 32) - 1)
    carry(np.flatnonzero(tail < low))
    out[at] = (tail >> _WORD).astype(np.uint32)
    sizes = at + 1 - begin
    words = out.reshape(lanes, room)[np.arange(room)[None, :] < sizes[:, None]]
    head = zlib.compress(np.diff(alphabet, prepend=0).astype("<u4").tobytes() + sizes.astype("<u4").tobytes(), 6)
    return struct.pack("<II", len(alphabet), len(head)) + head + words.astype("<u4").tobytes()


def decode_block(data: bytes, n: int) -> np.ndarray:
    """The ``n`` ids of a block."""
    if not n:
        return np.zeros(0, np.uint32)
    count, packed = struct.unpack_from("<II", data)
    head = zlib.decompress(data[8 : 8 + packed])
    alphabet = np.cumsum(np.frombuffer(head, "<u4", count).astype(np.int64))
    grid = _Grid(n)
    lanes, model = grid.lanes, _Mixture(count, grid.lanes, invert=True)
    sizes = np.frombuffer(head, "<u4", lanes, 4 * count).astype(np.int64)
    # every lane ends with two words of zero to read on into
    words = np.zeros(int(sizes.sum()) + 2 * lanes, np.uint64)
    at = np.cumsum(sizes + 2) - sizes - 2
    words[np.arange(int(sizes.sum())) + np.repeat(2 * np.arange(lanes), sizes)] = np.frombuffer(data, "<u4", int(sizes.sum()), 8 + packed)
    shift, most = np.uint64(model.total), np.uint64((1 << model.total) - 1)
    wide, gap = np.full(lanes, np.iinfo(np.uint64).max), (words[at] << _WORD) | words[at + 1]
    at += 2
    for t, m in grid.steps(model):
        model.guess(m)
        mine, part = gap[:m], wide[:m]
        part >>= shift
        s = model.find(np.minimum(mine // part, most).view(np.int64))
        grid.cells[t, :m] = s
        start, size = model.interval(s)
        mine -= part * start.view(np.uint64)
        part *= size.view(np.uint64)
        short = np.flatnonzero(part < _FULL)
        if len(short):
            place = at[short]
            at[short] = place + 1
            mine[short] = (mine[short] << _WORD) | words[np.minimum(place, len(words) - 1)]
            part[short] <<= _WORD
        model.learn(m, s, t % _COUNTED == 0)
    return alphabet[grid.flat()].astype(np.uint32)
