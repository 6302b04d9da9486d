"""An adaptive context-mixing range coder for token ids, many blocks at a time.

Three models predict an id. Order 0: sixteen classes of ids of like total frequency, whose shares
adapt, and fixed shares within a class. Orders 1 and 2: the id that last followed the same one or two
ids, with a confidence. The mixture

    P(x) = w2 [x = guess 2] + w1 [x = guess 1] + w0 P0(x)

drives a range coder with 64-bit state. A guess weighs as its kind (order and confidence) has hit so
far in the block, what is left is w0. Every block begins with the same models, those of its group's
`Prior` (which ids occur and about how often), and knows nothing of other blocks. Blocks are coded
side by side, one numpy lane each, so a step codes one id of hundreds or thousands of blocks. All
arithmetic is on whole numbers, so the decoder sees what the encoder saw.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: Parts of a range, of the classes' shares, of the shares within a class; ids fit 16 bits.
TOTAL, CLASS_BITS, SHARE_BITS = 30, 15, 16
CLASSES, RATE, LEAST = 16, 5, 64
#: Places of a block's tables of orders 1 and 2, as powers of two; most confident a place can be.
PLACES, SURE = (10, 11), 7
_SHIFT, _LOW = np.uint64(32), np.uint64(1 << 32)
#: Most that guesses weigh together: what is left for order 0 gives every id of every class a part.
_MOST = 15 << TOTAL - 4
#: Weight of a level: four levels double it.
_STEPS = np.array([16, 19, 23, 27])
_1, _ENDS = np.int16(1), np.int64((1 << CLASS_BITS) - 1)
#: Kinds of guess: an empty place, confidence 1 to SURE, a place of other ids. Rows of _NEXT: wrong, right guesses.
_OTHER, KINDS = SURE + 1, SURE + 2
_NEXT = np.r_[[max(k >> 1, 1) for k in range(_OTHER)], 1, 1, [min(k + 1, SURE) for k in range(1, _OTHER)], 1].astype(np.int64) << 16
_MASKS, _CHECKS = np.array([[(1 << p) - 1] for p in PLACES]), np.array([[24 - p] for p in PLACES])
_HELD = np.arange(KINDS) % _OTHER > 1  # a wrong guess stays


def levels_of(counts: np.ndarray) -> np.ndarray:
    """Frequencies as levels from 0, four of which double them."""
    return np.minimum(np.round(4 * np.log2(np.maximum(counts, 1))), 159).astype(np.uint8)


class Prior:
    """Where the blocks of a group begin: distinct ids, ascending, and the level of each one's frequency.

    Ids are coded as ranks: 0 is the most frequent one.
    """

    def __init__(self, ids: np.ndarray, levels: np.ndarray):
        order = np.argsort(-levels.astype(np.int64), kind="stable")
        self.ids, n = ids[order].astype(np.uint16), len(ids)
        self.rank = np.zeros(1 << 16, np.uint16)
        self.rank[self.ids] = np.arange(n)
        level = levels[order].astype(np.int64)
        weight = _STEPS[level & 3] << np.minimum(level >> 2, 40)
        cum = np.r_[0, np.cumsum(weight)]
        # a class ends where it has its part of what was left, or where each class after it needs one id
        firsts, at = [], 0
        for k in range(min(CLASSES, n)):
            firsts.append(at)
            left = min(CLASSES, n) - k
            at = max(at + 1, min(n - left + 1, int(np.searchsorted(cum, cum[at] + (cum[n] - cum[at]) // left))))
        firsts = np.array(firsts, np.int64)
        ends = np.r_[firsts[1:], n]
        self.kind = np.repeat(np.arange(len(firsts)), ends - firsts)
        size, mass = (ends - firsts)[self.kind], (cum[ends] - cum[firsts])[self.kind]
        place = np.arange(n) - firsts[self.kind]
        # in floats, as whole numbers would not fit; both sides compute the same
        room = ((1 << SHARE_BITS) - size).astype(np.float64)
        self.low = np.floor((cum[:-1] - cum[firsts[self.kind]]) / mass * room).astype(np.int64) + place
        self.high = np.r_[self.low[1:], 0]
        self.high[ends - 1] = 1 << SHARE_BITS
        self.parts = self.kind << 36 | self.low << 18 | self.high  # looked up at once
        self.find = np.zeros(CLASSES << SHARE_BITS, np.uint16)  # rank at each place of each class
        self.find[: len(firsts) << SHARE_BITS] = np.repeat(np.arange(n), self.high - self.low)
        share = np.full(CLASSES, LEAST, np.int64)
        share[: len(firsts)] += ((cum[ends] - cum[firsts]) / cum[n] * ((1 << CLASS_BITS) - CLASSES * LEAST)).astype(np.int64)
        share[0] += (1 << CLASS_BITS) - share.sum()
        self.start = (np.cumsum(share) - share).astype(np.int16)
        # where the classes' starts move when a class is seen; each keeps a share
        at = np.arange(CLASSES)
        self.toward = np.where(at[None, :] <= at[:, None], at * LEAST, (1 << CLASS_BITS) - (CLASSES - at) * LEAST).astype(np.int16)


class Models:
    """The models of each lane."""

    def __init__(self, lanes: int, prior: Prior):
        self.prior, self.lane = prior, np.arange(lanes)
        self.cells = np.r_[np.tile(prior.start, lanes), np.int16(0)]  # starts of the classes; the first one's is always 0
        self.starts = self.cells[:-1].reshape(lanes, CLASSES)
        # orders 1 and 2, one after the other; a place: rank, confidence (from 1; 0: empty) << 16, check << 24
        self.lanes = lanes
        self.places = np.zeros(lanes * sum(1 << p for p in PLACES), np.uint32)
        self.rates = np.tile(np.r_[0, np.full(SURE, 16_384), 0], 2 * lanes)
        self.last = [np.zeros(lanes, np.int64), np.zeros(lanes, np.int64)]
        self.widened()

    def narrow(self, lanes: int) -> None:
        self.lane, self.last = self.lane[:lanes], [x[:lanes] for x in self.last]
        self.widened()

    def widened(self) -> None:
        """What each lane adds to a place in a table."""
        self.row = self.lane * CLASSES
        self.kinds = np.stack([self.lane, self.lane + self.lanes]) * KINDS
        self.tables = np.stack([self.lane << PLACES[0], (self.lanes << PLACES[0]) + (self.lane << PLACES[1])])

    def begin(self) -> None:
        """Guesses of both orders, a row each, and what they weigh."""
        a, b = self.last
        keys = np.empty((2, len(a)), np.int64)
        keys[0], two = a, keys[1]
        np.multiply(a, 40_503, out=two)
        two += b * 60_493
        two *= 2_654_435_761
        two >>= 7
        self.at = keys & _MASKS
        self.at += self.tables
        keys <<= _CHECKS
        keys &= 255 << 24
        held = self.places.take(self.at).astype(np.int64)
        self.guess, self.check = held & 0xFFFF, keys
        held ^= keys
        held >>= 16  # with the place's own check, all that is left is the confidence
        self.sure = np.minimum(held, _OTHER, out=held)
        self.kindrate = self.kinds + held
        self.rate = self.rates.take(self.kindrate)
        self.share = np.empty_like(keys)
        first, second = self.share
        np.multiply(self.rate[1], _MOST >> 16, out=second)
        np.subtract(_MOST, second, out=first)
        first *= self.rate[0]
        first >>= 16
        self.rest = (1 << TOTAL) - first - second

    def part_of(self, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(start, size) of classes in order 0's part of the range."""
        at = self.row + kind
        low = self.rest * self.cells.take(at)
        low >>= CLASS_BITS
        at += 1
        end = self.cells.take(at) - _1 & _ENDS  # after the last class stands the 0 of the next lane
        end += 1
        end *= self.rest
        end >>= CLASS_BITS
        end -= low
        return low, end

    def plain(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(class, start, size) of ranks x in order 0's part of the range."""
        size = self.prior.parts.take(x)
        kind = size >> 36
        low, part = self.part_of(kind)
        start = size >> 18
        start &= (1 << 18) - 1
        start *= part
        start >>= SHARE_BITS
        size &= (1 << 18) - 1
        size *= part
        size >>= SHARE_BITS
        size -= start
        start += low
        return kind, start, size

    def range_of(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(start, size) of ranks x in the mixture, out of 2^TOTAL."""
        self.hit = self.guess == x
        self.kind, start, size = self.plain(x)
        for more in self.share * (self.guess < x):
            start += more
        for more in self.share * self.hit:
            size += more
        return start, size

    def rank_at(self, place: np.ndarray) -> np.ndarray:
        """The rank whose part of the mixture holds place."""
        guess, share = self.guess, self.share
        _, start, size = self.plain(guess)
        start += share[::-1] * (guess[::-1] < guess)
        beyond = place >= start
        size += share
        size += share[::-1] * (guess[0] == guess[1])
        size += start
        inside = place < size
        inside &= beyond
        first, second = share * beyond
        rest = place - first
        rest -= second
        np.maximum(rest, 0, out=rest)
        np.minimum(rest, self.rest - 1, out=rest)
        part = ((rest + 1 << CLASS_BITS) - 1) // self.rest
        under = np.bitwise_count((self.starts[: len(self.lane)] <= part.astype(np.int16)[:, None]).view(np.uint64))
        kind = under[:, 0].astype(np.int64) + under[:, 1] - 1
        low, part = self.part_of(kind)
        rest -= low
        within = ((rest + 1 << SHARE_BITS) - 1) // np.maximum(part, 1)
        within &= (1 << SHARE_BITS) - 1  # beyond it only where a guess is right
        x = self.prior.find.take((kind << SHARE_BITS) + within).astype(np.int64)
        return np.where(inside[1], guess[1], np.where(inside[0], guess[0], x))

    def told(self, x: np.ndarray) -> None:
        """The ranks that range_of() was asked last."""
        starts = self.starts[: len(self.lane)]
        move = self.prior.toward.take(self.kind, axis=0)
        move -= starts
        move >>= RATE
        starts += move
        hit = self.hit.astype(np.int64)
        aim = hit * 65_535
        aim -= self.rate
        aim >>= RATE
        aim += self.rate
        self.rates[self.kindrate.reshape(-1)] = aim.reshape(-1)
        self.rates[0::KINDS] = self.rates[_OTHER::KINDS] = 0  # what is not known weighs nothing
        # a wrong guess loses confidence, and its place below two
        held = np.where(_HELD.take(self.sure), self.guess, x)
        held |= self.check
        hit *= KINDS
        hit += self.sure
        held |= _NEXT.take(hit)
        self.places[self.at.reshape(-1)] = held.astype(np.uint32).reshape(-1)  # of the same type: else far slower
        self.last = [x, self.last[0]]


def _lanes(n: int, block: int) -> Iterator[tuple[int, int]]:
    """(step, lanes at work): all blocks are full but for the last."""
    whole, rest = divmod(n, block)
    for step in range(min(n, block)):
        yield step, whole + (step < rest)


def encode(ids: np.ndarray, block: int, prior: Prior) -> list[bytes]:
    """The coded blocks of so many ids each."""
    lanes = -(-len(ids) // block)
    ranks = np.zeros(lanes * block, np.uint16)
    ranks[: len(ids)] = prior.rank[ids]
    ranks = np.ascontiguousarray(ranks.reshape(lanes, block).T)
    models, low, span = Models(lanes, prior), np.zeros(lanes, np.uint64), np.full(lanes, (1 << 64) - 1, np.uint64)
    width = min(len(ids), block) + 2
    out, begins = np.zeros(lanes * width, np.uint32), np.arange(lanes) * width
    ends = begins.copy()  # of what each lane has written

    def carried(over: np.ndarray) -> None:
        back = ends[over] - 1
        while len(back):  # a carry runs back into what is written
            word = out[back] + np.uint32(1)
            out[back] = word
            back = back[word == 0] - 1

    for step, active in _lanes(len(ids), block):
        if active < len(models.lane):
            models.narrow(active)
        x = ranks[step, :active].astype(np.int64)
        models.begin()
        start, size = models.range_of(x)
        unit = span[:active] >> np.uint64(TOTAL)
        at, wide = low[:active] + unit * start.view(np.uint64), unit * size.view(np.uint64)
        over = np.flatnonzero(at < low[:active])
        if len(over):
            carried(over)
        shift = np.flatnonzero(wide < _LOW)
        if len(shift):
            top, end = at[shift], ends[shift]
            out[end] = (top >> _SHIFT).astype(np.uint32)
            ends[shift] = end + 1
            at[shift] = top << _SHIFT
            wide[shift] <<= _SHIFT
        low[:active], span[:active] = at, wide
        models.told(x)
    # one word more names a place inside the last range; words after it read as zeros
    last = (low >> _SHIFT) + ((low & _LOW - np.uint64(1)) > 0)
    carried(np.flatnonzero(last >= _LOW))
    out[ends] = last.astype(np.uint32)
    return [out[a : b + 1].astype("<u4").tobytes() for a, b in zip(begins.tolist(), ends.tolist(), strict=True)]


def decode(blocks: list[bytes], n: int, block: int, prior: Prior) -> np.ndarray:
    """The n ids of blocks that encode() made."""
    lanes = len(blocks)
    words = np.zeros((lanes, max(map(len, blocks)) // 4 + 3), np.uint32)
    for i, b in enumerate(blocks):
        words[i, : len(b) // 4] = np.frombuffer(b, "<u4")
    code, ends = words[:, 0].astype(np.uint64) << _SHIFT | words[:, 1], np.arange(lanes) * words.shape[1] + 2  # of what each lane has read
    words = words.reshape(-1)
    models, span, ranks = Models(lanes, prior), np.full(lanes, (1 << 64) - 1, np.uint64), np.zeros((min(n, block), lanes), np.uint16)
    for step, active in _lanes(n, block):
        if active < len(models.lane):
            models.narrow(active)
        models.begin()
        unit = span[:active] >> np.uint64(TOTAL)
        x = models.rank_at((code[:active] // unit).view(np.int64))
        start, size = models.range_of(x)
        rest, wide = code[:active] - unit * start.view(np.uint64), unit * size.view(np.uint64)
        shift = np.flatnonzero(wide < _LOW)
        if len(shift):
            end = ends[shift]
            rest[shift] = rest[shift] << _SHIFT | words.take(end)
            ends[shift] = end + 1
            wide[shift] <<= _SHIFT
        code[:active], span[:active] = rest, wide
        models.told(x)
        ranks[step, :active] = x
    return prior.ids[np.ascontiguousarray(ranks.T).reshape(-1)[:n]]
