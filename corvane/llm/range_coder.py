"""Adaptive context-mixing range coder for token ids, in numpy lanes.

A stream of ids is cut into blocks of BLOCK ids. A block is coded by itself: all
of its models start anew, and it carries its own list of distinct ids and a CRC-32
of its ids, so any block can be read or rejected alone. Inside a block the ids are
dealt to STRANDS runs that are coded side by side, one numpy lane each, and share
the block's models; GROUP blocks are coded at once.

Model. Order 2: the id that last followed the hash of the two ids before. Order 1:
the id that last followed the id before. Order 0: counts of the block's ids. Each
order's prediction has a confidence (how often in a row it was right). The chances
that order 2 hits and that order 1 does are mixed by what was seen, in this block
so far, under the same pair of confidences and the same agreement of both; what
they leave is dealt to all ids by order 0. Chances and counts are brought up to
date every REFRESH steps. The coder carries 64 bits and writes 32-bit words; a
carry is added to the word before.

Ids are unsigned 32-bit; others are refused with ValueError.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

BLOCK, STRANDS, GROUP, REFRESH = 1 << 16, 256, 32, 8
SLOTS, TRUST = 1 << 14, 8
M, M0 = 20, 17  # bits of a chance; of an order-0 chance
#: What order 2 and order 1 may have together of a chance; the rest is order 0's.
MOST = (1 << M) - (1 << M0 + 1)
U = np.uint64
WORD, LOW = U(32), U(0xFFFFFFFF)
HEAD = struct.Struct("<IIIII")  # ids, crc32 of the ids as little-endian 32-bit, distinct ids, bytes of their list, bytes of the words
#: confidence after a miss and after a hit
_NEXT = np.array([[0] * TRUST, [*range(1, TRUST), TRUST - 1]], dtype=np.int32).ravel()


def _strands(n: int) -> int:
    """Lanes of a block of n ids; short blocks have fewer."""
    return min(STRANDS, max(1, n // 256))


class _Models:
    """The models of some blocks of equal shape, each with its own part of every table. A symbol is an id's place in its block's list."""

    def __init__(self, sizes: list[int], strands: int):
        blocks = len(sizes)
        self.block = np.repeat(np.arange(blocks), strands)
        self.sizes = np.array(sizes)
        self.base = np.concatenate([[0], np.cumsum(self.sizes)])
        self.first = self.base[self.block]  # a lane's first place in the tables by symbol
        self.t2 = np.zeros(blocks * SLOTS, dtype=np.int32)
        self.t1 = np.zeros(int(self.base[-1]), dtype=np.int32)
        self.slots, self.contexts = self.block * SLOTS, self.block * (2 * TRUST * TRUST)
        n = blocks * 2 * TRUST * TRUST
        self.seen, self.right2, self.right1 = np.full(n, 2.0), np.full(n, 0.5), np.full(n, 0.25)
        self.counts = np.zeros(int(self.base[-1]), dtype=np.int64)
        self.owner = np.repeat(np.arange(blocks), self.sizes)
        self.a = self.b = np.zeros(len(self.block), dtype=np.int64)
        self.met: list[tuple] = []
        self.told: list[np.ndarray] = []
        self.refresh()

    def refresh(self) -> None:
        if self.met:
            at = np.concatenate([x for x, _, _ in self.met])
            n = len(self.seen)
            self.seen += np.bincount(at, minlength=n)
            self.right2 += np.bincount(at[np.concatenate([x for _, x, _ in self.met])], minlength=n)
            self.right1 += np.bincount(at[np.concatenate([x for _, _, x in self.met])], minlength=n)
            self.counts += np.bincount(np.concatenate(self.told), minlength=len(self.counts)) * 32
        self.m2 = (self.right2 / self.seen * MOST).astype(np.int64) + 1
        self.m1 = (self.right1 / self.seen * MOST).astype(np.int64) + 1
        total = np.add.reduceat(self.counts, self.base[:-1]) + self.sizes
        share = 1 + (self.counts + 1) * ((1 << M0) - self.sizes)[self.owner] // total[self.owner]  # of 1 << M0 at most in all
        run = np.cumsum(share)
        before = np.concatenate([[0], run])
        self.high = run - before[self.base[:-1]][self.owner]
        self.low = self.high - share
        # ends of a block's symbols one block above the other, for one search in all
        self.line = self.high + (self.owner << M0 + 1)
        self.met, self.told = [], []

    def predict(self) -> None:
        """p2, p1: predicted symbols; c2, c1: their parts of 1 << M; rest: what is left."""
        self.at2 = self.slots + ((self.a * 40503 + self.b * 30011 >> 3) & (SLOTS - 1))
        self.at1 = self.first + self.b
        x2, x1 = self.t2.take(self.at2), self.t1.take(self.at1)
        self.k2, self.k1 = x2 & (TRUST - 1), x1 & (TRUST - 1)
        self.p2, self.p1 = x2 >> 3, x1 >> 3
        self.context = self.contexts + (self.k2 * TRUST + self.k1) + (self.p1 == self.p2) * (TRUST * TRUST)
        self.c2, self.c1 = self.m2.take(self.context), self.m1.take(self.context)
        self.rest = (1 << M) - self.c2 - self.c1

    def update(self, symbols: np.ndarray, hit2: np.ndarray, hit1: np.ndarray, told: np.ndarray) -> None:
        """told: places, in the tables by symbol, of those that order 0 told."""
        self.met.append((self.context, hit2, hit1))
        self.told.append(told)
        entry = (symbols << 3).astype(np.int32)
        self.t2[self.at2] = entry | _NEXT.take(self.k2 + TRUST * hit2)
        self.t1[self.at1] = entry | _NEXT.take(self.k1 + TRUST * (symbols == self.p1))
        self.a, self.b = self.b, symbols


def _encode(grids: list[np.ndarray], sizes: list[int]) -> list[bytes]:
    """Blocks of equal shape (strands x steps of symbols) to each one's words, lane by lane, with their numbers before them."""
    lanes, steps = len(grids) * grids[0].shape[0], grids[0].shape[1]
    m = _Models(sizes, grids[0].shape[0])
    wide = steps * M // 32 + 4
    out = np.zeros(lanes * wide, dtype=np.int64)
    begin = np.arange(lanes) * wide + 1  # a carry out of the first word cannot be; place 0 stays empty
    used = begin.copy()
    low, size = np.zeros(lanes, dtype=U), np.full(lanes, (1 << 64) - 1, dtype=U)
    columns = np.ascontiguousarray(np.concatenate(grids).T)
    for t in range(steps):
        if t and t % REFRESH == 0:
            m.refresh()
        symbols = columns[t]
        m.predict()
        hit2 = symbols == m.p2
        hit1 = (symbols == m.p1) & ~hit2
        start, part = np.where(hit2, 0, m.c2), np.where(hit2, m.c2, m.c1)
        told = np.flatnonzero(~(hit2 | hit1))
        place = m.first.take(told) + symbols.take(told)
        rest = m.rest.take(told)
        under = m.low.take(place) * rest >> M0
        start[told] = (1 << M) - rest + under
        part[told] = (m.high.take(place) * rest >> M0) - under
        r = size >> U(M)
        step = r * start.astype(U)
        low = low + step
        carry = np.flatnonzero(low < step)
        if len(carry):
            out[used[carry] - 1] += 1
        size = r * part.astype(U)
        full = np.flatnonzero(size <= LOW)
        if len(full):
            x, to = low.take(full), used.take(full)
            out[to] = x >> WORD
            used[full] = to + 1
            low[full] = x << WORD
            size[full] = size.take(full) << WORD
        m.update(symbols, hit2, hit1, place)
    # one word inside the last interval, all ones after it: no second one is needed, the reader adds zeros
    top = low + U(LOW)
    carry = np.flatnonzero(top < low)
    out[used[carry] - 1] += 1
    out[used] = top >> WORD
    used = used + 1
    for back in range(int((used - begin).max()) - 1, 0, -1):  # carries, last words first
        at = begin + back
        over = np.flatnonzero((at < used) & (out[np.minimum(at, len(out) - 1)] >> 32 > 0))
        if len(over):
            out[at[over]] &= 0xFFFFFFFF
            out[at[over] - 1] += 1
    n = grids[0].shape[0]
    words = []
    for k in range(len(grids)):
        mine = range(k * n, (k + 1) * n)
        words.append((used - begin)[k * n : (k + 1) * n].astype("<u2").tobytes() + np.concatenate([out[begin[i] : used[i]] for i in mine]).astype("<u4").tobytes())
    return words


def _decode(words: list[bytes], sizes: list[int], strands: int, steps: int) -> np.ndarray:
    """Symbols (blocks * strands x steps) of blocks of equal shape."""
    m = _Models(sizes, strands)
    lengths = np.concatenate([np.frombuffer(w, dtype="<u2", count=strands) for w in words]).astype(np.int64)
    flat = np.concatenate([*(np.frombuffer(w, dtype="<u4", offset=2 * strands) for w in words)]).astype(U)
    at = np.cumsum(lengths) - lengths
    end = at + lengths
    lanes, last = len(at), len(flat) - 1

    def take(places: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return np.where(places < ends, flat.take(np.minimum(places, last)), U(0))

    code = take(at, end) << WORD | take(at + 1, end)
    at = at + 2
    size = np.full(lanes, (1 << 64) - 1, dtype=U)
    out = np.zeros((steps, lanes), dtype=np.int64)
    for t in range(steps):
        if t and t % REFRESH == 0:
            m.refresh()
        m.predict()
        r = size >> U(M)
        target = np.minimum(code // np.maximum(r, U(1)), U((1 << M) - 1)).astype(np.int64)
        edge = (1 << M) - m.rest
        hit2 = target < m.c2
        hit1 = (target < edge) & ~hit2
        symbols = np.where(hit2, m.p2, m.p1).astype(np.int64)
        start, part = np.where(hit2, 0, m.c2), np.where(hit2, m.c2, m.c1)
        told = np.flatnonzero(target >= edge)
        rest = m.rest.take(told)
        most = (((target.take(told) - edge.take(told) + 1) << M0) - 1) // rest
        place = np.searchsorted(m.line, most + (m.block.take(told) << M0 + 1), side="right")
        place = np.minimum(place, m.base.take(m.block.take(told) + 1) - 1)  # room that no symbol has is the last one's in damaged blocks only
        symbols[told] = place - m.first.take(told)
        under = m.low.take(place) * rest >> M0
        start[told] = (1 << M) - rest + under
        part[told] = (m.high.take(place) * rest >> M0) - under
        code = code - r * start.astype(U)
        size = r * part.astype(U)
        more = np.flatnonzero(size <= LOW)
        if len(more):
            to = at.take(more)
            code[more] = code.take(more) << WORD | take(to, end.take(more))
            size[more] = size.take(more) << WORD
            at[more] = to + 1
        out[t] = symbols
        m.update(symbols, hit2, hit1, place)
    return out.T


def _listed(block: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct ids, ascending, and each id's place among them."""
    if int(block.max()) >= 1 << 20:
        return np.unique(block, return_inverse=True)
    here = np.bincount(block) > 0
    return np.flatnonzero(here).astype("<u4"), (np.cumsum(here) - 1).take(block)


def encode(ids: np.ndarray) -> bytes:
    """ids (unsigned 32-bit) as blocks, one after another."""
    ids = np.asarray(ids)
    if len(ids) and (int(ids.min()) < 0 or int(ids.max()) >= 1 << 32):
        raise ValueError("a token id is not an unsigned 32-bit number")
    ids = ids.astype("<u4")
    heads, todo = [], []
    for k in range(0, len(ids), BLOCK):
        block = ids[k : k + BLOCK]
        known, symbols = _listed(block)
        strands = _strands(len(block))
        steps = -(-len(block) // strands)
        grid = np.zeros(strands * steps, dtype=np.int64)
        grid[: len(block)] = symbols
        listed = zlib.compress(np.diff(known.astype(np.int64), prepend=0).astype("<u4").tobytes())
        heads.append((len(block), zlib.crc32(block.tobytes()), len(known), listed))
        todo.append(grid.reshape(strands, steps))
    words: list[bytes] = []
    whole = len(ids) // BLOCK
    for some in [*(slice(k, min(k + GROUP, whole)) for k in range(0, whole, GROUP)), *([slice(whole, whole + 1)] if whole < len(todo) else [])]:
        words += _encode(todo[some], [h[2] for h in heads[some]])
    return b"".join(HEAD.pack(n, crc, known, len(listed), len(w)) + listed + w for (n, crc, known, listed), w in zip(heads, words))


class Damaged(ValueError):
    """A block whose ids do not have the checksum it carries."""


def decode(data: bytes) -> np.ndarray:
    """The ids of encode()'s blocks; raises Damaged if a block is cut short or a checksum fails."""
    blocks, at = [], 0
    try:
        while at < len(data):
            n, crc, k, a, b = HEAD.unpack_from(data, at)
            at += HEAD.size
            if not 0 < n <= BLOCK or not 0 < k <= n or at + a + b > len(data):
                raise Damaged(f"block {len(blocks)}")
            known = np.cumsum(np.frombuffer(zlib.decompress(data[at : at + a]), dtype="<u4"), dtype="<u4")
            if len(known) != k:
                raise Damaged(f"block {len(blocks)}")
            blocks.append((n, crc, known, data[at + a : at + a + b]))
            at += a + b
    except (struct.error, zlib.error) as e:
        raise Damaged(f"block {len(blocks)}") from e
    parts: list[np.ndarray] = []
    k = 0
    while k < len(blocks):
        n = blocks[k][0]
        some = [b for b in blocks[k : k + GROUP] if b[0] == n]
        strands = _strands(n)
        steps = -(-n // strands)
        for i, b in enumerate(some):
            if len(b[3]) < 2 * strands or len(b[3]) - 2 * strands != 4 * int(np.frombuffer(b[3], dtype="<u2", count=strands).sum()):
                raise Damaged(f"block {k + i}")
        with np.errstate(all="ignore"):  # damaged blocks lead anywhere before their checksum tells
            grid = _decode([b[3] for b in some], [len(b[2]) for b in some], strands, steps)
        for i, (_, crc, known, _) in enumerate(some):
            row = known.take(grid[i * strands : (i + 1) * strands].ravel()[:n])
            if zlib.crc32(row.tobytes()) != crc:
                raise Damaged(f"block {k + i}")
            parts.append(row)
        k += len(some)
    return np.concatenate(parts) if parts else np.zeros(0, dtype="<u4")
