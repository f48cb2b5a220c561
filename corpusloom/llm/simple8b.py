"""Simple-8b: word-aligned coding of unsigned integers, for arrays.

The top four bits of a 64-bit word select how many values its other 60 bits hold and how wide each is
(fixed values of the format, from the published scheme). Values are packed in blocks of a fixed number
of ids; a block's words stand together and an offset for each block says where they begin, so that all
blocks are decoded at once. Two selectors carry no values but runs of zeros; the second of them, with
payload 1, is an escape: the next word is one raw value of up to 64 bits.
"""

from __future__ import annotations

import numpy as np

COUNTS = np.array([240, 120, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1])
BITS = np.array([0, 0, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60])
BLOCK = 512
_ESCAPE = 16
_ESCAPE_WORD = np.uint64((1 << 60) | 1)
_STEP = np.append(COUNTS, 1)


def _widths(values: np.ndarray) -> np.ndarray:
    low = np.frexp((values & np.uint64(0xFFFFFFFF)).astype(np.float64))[1]
    high = values >> np.uint64(32)
    return np.where(high > 0, np.frexp(high.astype(np.float64))[1] + 32, low) if high.any() else low


def _and_next(fits: np.ndarray, n: int) -> None:
    """Whether a place and the n - 1 after it fit; what lies beyond a block does."""
    done = 1
    while done < n:
        step = min(done, n - done)
        fits[:, :-step] &= fits[:, step:]
        done += step


def pack(values: np.ndarray, block: int = BLOCK) -> tuple[np.ndarray, np.ndarray]:
    """Words, and for each block the place of its first word (one more for the end)."""
    n = len(values)
    blocks = -(-n // block)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(1, np.uint32)
    flat = np.zeros(blocks * block, np.uint64)  # zeros after the end fill the last word
    flat[:n] = values
    width = _widths(flat).astype(np.int8).reshape(blocks, block)
    widest = int(width.max())
    choice = np.full((blocks, block), _ESCAPE, np.int8)
    least = min((s for s in range(2, 16) if BITS[s] >= widest), default=15)  # narrower selectors are never better than it
    for s in range(least, -1, -1):
        fits = width <= BITS[s]
        if np.count_nonzero(fits) >= min(COUNTS[s], block):
            _and_next(fits, min(int(COUNTS[s]), block))
            np.copyto(choice, s, where=fits)
    ends = np.full(blocks, block)
    ends[-1] = n - (blocks - 1) * block
    begins = np.zeros((blocks, block), bool)
    at, live = np.zeros(blocks, int), np.arange(blocks)
    while len(live):
        here = at[live]
        begins[live, here] = True
        at[live] = here + _STEP[choice[live, here]]
        live = live[at[live] < ends[live]]
    start = np.flatnonzero(begins)
    selected = choice.reshape(-1)[start]
    size = np.where(selected == _ESCAPE, 2, 1)
    end = np.cumsum(size)
    words = np.zeros(end[-1], np.uint64)
    first = end - size
    # a block's last word reaches beyond it: zeros follow each block
    pad = int(COUNTS[np.clip(selected.min(), 2, 15)])
    padded = np.zeros((blocks, block + pad), np.uint64)
    padded[:, :block] = flat.reshape(blocks, block)
    padded, at = padded.reshape(-1), start + start // block * pad
    for s in range(16):
        own = np.flatnonzero(selected == s)
        if len(own):
            word = np.full(len(own), s << 60, np.uint64)
            for k in range(COUNTS[s] if s > 1 else 0):
                word |= padded[at[own] + k] << np.uint64(BITS[s] * k)
            words[first[own]] = word
    own = np.flatnonzero(selected == _ESCAPE)
    words[first[own]] = _ESCAPE_WORD
    words[first[own] + 1] = flat[start[own]]
    offsets = np.zeros(blocks + 1, np.uint32)
    offsets[1:] = np.cumsum(np.bincount(start // block, weights=size, minlength=blocks))
    return words, offsets


def unpack(words: np.ndarray, offsets: np.ndarray, n: int, block: int = BLOCK) -> np.ndarray:
    """The n values that pack() got."""
    out = np.zeros(n, np.uint64)
    if not n:
        return out
    selected = (words >> np.uint64(60)).astype(int)
    escapes = words == _ESCAPE_WORD
    raw = np.zeros(len(words), bool)
    if escapes.any():  # in a run of words that look like escapes every second one is a raw value
        i = np.arange(len(words))
        run = i - np.maximum.accumulate(np.where(escapes, -1, i))
        escapes &= run % 2 == 1
        raw[1:] = escapes[:-1]
    count = COUNTS[selected]
    count[escapes], count[raw] = 0, 1
    ends = np.cumsum(count)
    of = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets.astype(int)))
    before = np.concatenate([[0], ends])[offsets[:-1].astype(int)]
    start = ends - count - before[of] + of * block
    stop = np.minimum((of + 1) * block, n)
    plain = ~(escapes | raw)
    for s in range(2, 16):
        own = np.flatnonzero(plain & (selected == s))
        if len(own):
            mask = np.uint64((1 << int(BITS[s])) - 1)
            for k in range(COUNTS[s]):
                place = start[own] + k
                fits = place < stop[own]
                out[place[fits]] = (words[own[fits]] >> np.uint64(BITS[s] * k)) & mask
    out[start[raw]] = words[raw]
    return out
