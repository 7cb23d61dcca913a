"""A range coder for token ids, driven by an adaptive mix of order-2, order-1 and order-0 predictions.

Blocks of ids are coded independently: each starts with fresh predictions and ends with its own digits, so that blocks
decode apart. Many blocks are coded side by side, one id of each at a time, as array operations over the blocks ("lanes").

* Order 2 and order 1 each predict one id: the one that last followed the same two ids, or the same id, with a confidence
  of 0 to 3 that grows with hits and falls with misses.
* Order 0 gives every id its share of a power of two. The shares are the caller's, from counts of what is to be coded
  (``shares``); without them all ids are alike.
* The mix: for each pair of confidences, and whether the two predictions agree, a block learns what share of the range
  the order-2 prediction and the order-1 prediction get; order 0 gets the rest.

The range has 64 bits. Digits of 32 bits leave the coder when the range is below 2**32; carries are added to digits that
were written before, once all are known.
"""

from __future__ import annotations

import numpy as np

#: Ids of a block, blocks coded side by side at most.
BLOCK, LANES = 1024, 6144
#: Slots of the predictions of order 1 and 2 (a collision only costs a miss), bits of the mix's total, adaptation shift.
SLOTS_1, SLOTS_2, BITS, SLOW = 1 << 10, 1 << 11, 12, 5
TOTAL = 1 << BITS
#: Shares of the range that a prediction keeps at least and has at most, of TOTAL; what is left goes to order 0.
LEAST, MOST = 16, TOTAL - 64
#: Order 0 has 2**SPARE slots for each id that occurs, about.
SPARE = 4

_U32 = np.uint64(32)
_LOW = np.uint64(1) << _U32
_ONES = _LOW - np.uint64(1)
_SURE = 1 << 16


def shares(counts: np.ndarray) -> np.ndarray:
    """The share of each id in order 0: one at least where its count is not 0, together a power of two."""
    counts = np.asarray(counts, dtype=np.int64)
    held = counts > 0
    n = int(held.sum())
    if not n:
        return np.zeros(len(counts), dtype=np.int64)
    total = 1 << ((n - 1).bit_length() + SPARE)
    out = held + counts * (total - n) // counts.sum()
    out[np.argsort(-counts, kind="stable")[: total - int(out.sum())]] += 1
    return out


class _Models:
    """The predictions of order 1 and 2 and the mix of ``lanes`` blocks; arrays of two rows have order 1 first.

    A slot's entries of all lanes stand side by side, so that slots in frequent use are close together in memory.
    """

    def __init__(self, lanes: int):
        self.lanes, lane = lanes, np.arange(lanes)
        self.table, self.share = np.empty(self.lanes * (SLOTS_1 + SLOTS_2), dtype=np.int32), np.empty(2 * self.lanes * 32, dtype=np.int16)
        self.first_slot, self.first_state = np.stack([lane, self.lanes * SLOTS_1 + lane]), np.stack([lane, self.lanes * 32 + lane])
        self.last, self.before = np.empty(lanes, dtype=np.int64), np.empty(lanes, dtype=np.int64)
        self.reset()

    def reset(self) -> None:
        for t in (self.table, self.last, self.before):
            t[:] = 0
        self.share[:] = TOTAL // 8
        # order 1 where it says the same as order 2: a share below 2**SLOW does not grow without hits
        self.share[: 32 * self.lanes].reshape(32, self.lanes)[::2] = 0

    def predict(self, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For the first ``k`` lanes: both predictions, and the shares of TOTAL of order 1 and 2; kept for ``learn``."""
        last = self.last[:k]
        mixed = last * 40503
        mixed += self.before[:k] * 60493
        mixed ^= mixed >> 11
        self.at = np.empty((2, k), dtype=np.int64)
        np.bitwise_and(last, SLOTS_1 - 1, out=self.at[0])
        np.bitwise_and(mixed, SLOTS_2 - 1, out=self.at[1])
        self.at *= self.lanes
        self.at += self.first_slot[:, :k]
        self.found = self.table.take(self.at)
        self.ids = self.found & 0xFFFF
        self.apart = self.ids[0] != self.ids[1]
        self.sure = self.found - self.ids
        state = (self.sure[1] >> 13) + (self.sure[0] >> 15)
        state += self.apart
        state *= self.lanes
        self.state = self.first_state[:, :k] + state
        self.now = self.share.take(self.state)
        return self.ids, *self.now.astype(np.uint64)

    def learn(self, k: int, ids: np.ndarray) -> None:
        """The ids that came, as 32-bit integers."""
        hit = self.ids == ids
        kept = np.where(self.found >= 2 * _SURE, self.ids, ids)
        np.minimum(self.sure, 2 * _SURE, out=self.sure)
        self.sure *= hit
        self.sure += _SURE
        kept += self.sure
        self.table[self.at] = kept
        hit[0] &= self.apart
        move = hit * np.int16(MOST - LEAST)
        move -= self.now
        move += np.int16(LEAST)
        move >>= SLOW
        move += self.now
        self.share[self.state] = move
        self.before[:k] = self.last[:k]
        self.last[:k] = ids


def _turned(ids: np.ndarray) -> np.ndarray:
    """Rows as columns, in strips that the cache holds."""
    out = np.zeros((ids.shape[1], ids.shape[0] + 32), dtype=ids.dtype)[:, : ids.shape[0]]  # 64 bytes more: rows apart by a power of two share cache lines
    for i in range(0, ids.shape[1], 64):
        out[i : i + 64] = ids[:, i : i + 64].T
    return out


class _Order0:
    """Shares of a power of two: where each id's begins and how large it is (32 bits each), and which id a slot belongs to."""

    def __init__(self, share: np.ndarray):
        total = int(share.sum())
        if total & (total - 1) or (len(share) and share.min() < 0):
            raise ValueError("shares must add up to a power of two")
        self.bits, self.most = np.uint64(max(total.bit_length() - 1, 0)), np.uint64(max(total - 1, 0))
        self.spans = (((np.cumsum(share) - share) << 32) + share).astype(np.uint64)
        self.slots = np.repeat(np.arange(len(share), dtype=np.int32), share)


def _groups(lengths: np.ndarray, lanes: int):
    """Block numbers in groups of ``lanes``, the longest first, so that the lanes still at work are always the first ones."""
    order = np.argsort(-lengths, kind="stable")
    return [order[i : i + lanes] for i in range(0, len(order), lanes)]


class Coder:
    """Encodes and decodes blocks of ids below ``vocabulary``; keeps the models' memory between calls."""

    def __init__(self, vocabulary: int, lanes: int = LANES):
        if not 0 < vocabulary <= 1 << 16:
            raise ValueError("ids have 16 bits at most")
        self.vocabulary, self.lanes = vocabulary, min(lanes, LANES)
        self._models: _Models | None = None

    def _fresh(self, lanes: int) -> _Models:
        if self._models is None or self._models.lanes < lanes:
            self._models = _Models(lanes)
        else:
            self._models.reset()
        return self._models

    def _order_0(self, share: np.ndarray | None) -> _Order0:
        return _Order0(shares(np.ones(self.vocabulary)) if share is None else np.asarray(share, dtype=np.int64))

    def encode(self, blocks: list[np.ndarray], share: np.ndarray | None = None) -> list[bytes]:
        """The digits of each block; ``share``: those of order 0 (see ``shares``), not 0 for any id of the blocks."""
        lengths, order_0 = np.array([len(b) for b in blocks], dtype=np.int64), self._order_0(share)
        out = [b""] * len(blocks)
        for group in _groups(lengths, self.lanes):
            for i, made in zip(group.tolist(), self._encode([blocks[i] for i in group], lengths[group], order_0), strict=True):
                out[i] = made
        return out

    def _encode(self, blocks: list[np.ndarray], lengths: np.ndarray, order_0: _Order0) -> list[bytes]:
        n, steps = len(blocks), int(lengths[0]) if len(lengths) else 0
        if any(len(b) and (b.min() < 0 or b.max() >= self.vocabulary) for b in blocks):
            raise ValueError("an id is outside the vocabulary")
        ids, held = np.zeros((n, steps + 32), dtype=np.uint16)[:, :steps], (order_0.spans & _ONES) > 0
        for i, b in enumerate(blocks):
            ids[i, : len(b)] = b
            if not held[ids[i, : len(b)]].all():
                raise ValueError("an id has no share of order 0")
        ids = _turned(ids)
        models = self._fresh(n)
        low, span, written = np.zeros(n, dtype=np.uint64), np.full(n, 0xFFFFFFFFFFFFFFFF, dtype=np.uint64), np.zeros(n, dtype=np.int64)
        digits: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        carries: list[tuple[np.ndarray, np.ndarray]] = []
        active = np.searchsorted(-lengths, -np.arange(steps), side="left")  # lanes with more than t ids
        for t in range(steps):
            k = int(active[t])
            now = ids[t, :k].astype(np.int32)
            found, share_1, share_2 = models.predict(k)
            unit, old = span[:k] >> np.uint64(BITS), low[:k]
            both = share_1 + share_2
            # order 0, in what the mix leaves to it
            part = (unit * (np.uint64(TOTAL) - both)) >> order_0.bits
            spans = order_0.spans.take(now)
            new, narrow = old + unit * both + part * (spans >> _U32), part * (spans & _ONES)
            hit_1, hit_2 = found == now
            hit = np.flatnonzero(hit_1 | hit_2)
            if len(hit):
                second = hit_2[hit]
                new[hit] = old[hit] + np.where(second, np.uint64(0), unit[hit] * share_2[hit])
                narrow[hit] = unit[hit] * np.where(second, share_2[hit], share_1[hit])
            over = np.flatnonzero(new < old)
            if len(over):
                carries.append((over, written[over] - 1))
            short = np.flatnonzero(narrow < _LOW)
            if len(short):
                top = new[short]
                digits.append((short, written[short], top >> _U32))
                written[short] += 1
                new[short] = top << _U32
                narrow[short] <<= _U32
            low[:k], span[:k] = new, narrow
            models.learn(k, now)
        everyone = np.arange(n)
        for shift in (_U32, np.uint64(0)):  # what is left of the range's begin
            digits.append((everyone, written.copy(), (low >> shift) & _ONES))
            written += 1
        starts = np.r_[0, np.cumsum(written)]
        flat = np.zeros(starts[-1], dtype=np.uint64)
        for who, place, digit in digits:
            flat[starts[who] + place] = digit
        for who, place in carries:
            np.add.at(flat, starts[who] + place, np.uint64(1))
        while (over := np.flatnonzero(flat >= _LOW)).size:
            flat[over] &= _ONES
            np.add.at(flat, over - 1, np.uint64(1))
        words = flat.astype(">u4")
        return [words[starts[i] : starts[i + 1]].tobytes() for i in range(n)]

    def decode(self, payloads: list[bytes], lengths: list[int] | np.ndarray, share: np.ndarray | None = None) -> list[np.ndarray]:
        """The ids of each block, given its digits, its number of ids and the shares that it was encoded with."""
        lengths, order_0 = np.asarray(lengths, dtype=np.int64), self._order_0(share)
        out: list[np.ndarray] = [np.zeros(0, dtype=np.uint32)] * len(payloads)
        for group in _groups(lengths, self.lanes):
            for i, made in zip(group.tolist(), self._decode([payloads[i] for i in group], lengths[group], order_0), strict=True):
                out[i] = made
        return out

    def _decode(self, payloads: list[bytes], lengths: np.ndarray, order_0: _Order0) -> list[np.ndarray]:
        n, steps = len(payloads), int(lengths[0]) if len(lengths) else 0
        sizes = np.array([len(p) // 4 for p in payloads], dtype=np.int64)
        flat = np.r_[np.frombuffer(b"".join(payloads), dtype=">u4").astype(np.uint64), np.zeros(2, dtype=np.uint64)]
        at_digit = np.cumsum(sizes) - sizes
        ids = np.zeros((steps, n + 32), dtype=np.uint16)[:, :n]
        models = self._fresh(n)
        off, span = (flat[at_digit] << _U32) | flat[at_digit + 1], np.full(n, 0xFFFFFFFFFFFFFFFF, dtype=np.uint64)
        at_digit += 2
        active = np.searchsorted(-lengths, -np.arange(steps), side="left")
        for t in range(steps):
            k = int(active[t])
            found, share_1, share_2 = models.predict(k)
            unit, old = span[:k] >> np.uint64(BITS), off[:k]
            both = share_1 + share_2
            known = unit * both
            part = (unit * (np.uint64(TOTAL) - both)) >> order_0.bits
            new = old - known
            now = order_0.slots.take(np.minimum(new // part, order_0.most).view(np.int64))
            spans = order_0.spans.take(now)
            new -= part * (spans >> _U32)
            narrow = part * (spans & _ONES)
            hit = np.flatnonzero(old < known)
            if len(hit):
                rest, unit, size_2 = old[hit], unit[hit], share_2[hit]
                border = unit * size_2
                second = rest < border
                new[hit] = np.where(second, rest, rest - border)
                narrow[hit] = unit * np.where(second, size_2, share_1[hit])
                now[hit] = np.where(second, found[1, hit], found[0, hit])
            short = np.flatnonzero(narrow < _LOW)
            if len(short):
                place = at_digit[short]
                new[short] = (new[short] << _U32) | flat.take(place, mode="clip")
                narrow[short] <<= _U32
                at_digit[short] = place + 1
            off[:k], span[:k] = new, narrow
            ids[t, :k] = now
            models.learn(k, now)
        ids = _turned(ids)
        return [ids[i, : lengths[i]].astype(np.uint32) for i in range(n)]
