"""Simple-8b coding of token ids: each 64-bit word holds as many ids as fit, its top four bits say how many and how wide.

In a width of b bits the largest value, all ones, is an escape: the id itself is in the block's escape list. Words do not cross
runs of `RUN` ids, and a block stores the word at which each run begins, so runs are decoded independently.

A block is: magic, ids, words, escapes, runs (five unsigned 32-bit integers) and a zero, then run offsets and escaped ids
(unsigned 32-bit, padded to eight bytes) and the words, all little-endian.
"""

import numpy as np

RUN = 4096
MAGIC = 0x31423853
ESCAPED = 20  # ids that need more bits are escaped
SHAPES = tuple((n, 60 // n) for n in (60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3))  # ids in a word, bits of each
_COUNTS = np.array([n for n, _ in SHAPES])


_LIMITS = np.array([(1 << width) - 1 for _, width in SHAPES], np.uint32)  # ids below it fit the width
_SMALL = np.searchsorted(_LIMITS, np.arange(1 << 16, dtype=np.uint32), side="right").astype(np.int8)
_PAD = 64  # zeros after each run, so that no window sees the next run


def _widths(ids: np.ndarray) -> np.ndarray:
    """The first shape that is wide enough for each id."""
    if not len(ids) or ids.max() < len(_SMALL):
        return _SMALL[ids]
    return np.searchsorted(_LIMITS, ids, side="right").astype(np.int8)


def _window_maxima(x: np.ndarray) -> dict[int, np.ndarray]:
    """The largest of the next n entries, for every number of ids that a word can hold."""
    most = {1: x}
    sums = ((1, 1), (2, 1), (2, 2), (4, 1), (4, 2), (4, 3), (4, 4), (8, 2), (8, 4), (8, 7), (8, 8), (16, 4), (15, 15), (30, 30))
    for a, b in sums:
        most[a + b] = _both(most[a], most[b], a)
    return most


def _both(first: np.ndarray, second: np.ndarray, shift: int) -> np.ndarray:
    """The larger of an entry and the one `shift` further on; nothing follows the end."""
    out = first.copy()
    np.maximum(first[:-shift], second[shift:], out=out[:-shift])
    return out


def encode_block(ids: np.ndarray, escaped: int = ESCAPED) -> bytes:
    """One block of ids (any unsigned 32-bit integers)."""
    ids = np.asarray(ids, np.uint32)
    size = len(ids)
    runs = -(-size // RUN)
    away = np.flatnonzero(ids >= (1 << escaped) - 1)
    padded = np.zeros((runs, RUN + _PAD), np.uint32)
    full = size // RUN
    padded[:full, :RUN] = ids[: full * RUN].reshape(full, RUN)
    padded[full:, : size - full * RUN] = ids[full * RUN :]
    flat = padded.ravel()
    widths = _widths(flat)
    gone = away // RUN * (RUN + _PAD) + away % RUN
    widths[gone] = 0  # an escape fits any width
    most = _window_maxima(widths)
    shape = np.full(len(flat), len(SHAPES), np.int8)  # what fits narrow also fits wide, so the first that fits
    for k, (count, _) in enumerate(SHAPES):
        shape -= most[count] <= k
    kinds = shape.tobytes()
    counts = [n for n, _ in SHAPES]
    starts: list[int] = []
    offsets = []
    for run in range(runs):
        spot = run * (RUN + _PAD)
        stop = spot + min(RUN, size - run * RUN)
        offsets.append(len(starts))
        while spot < stop:
            starts.append(spot)
            spot += counts[kinds[spot]]
    first = np.array(starts, np.int64)
    kind = shape[first] if size else np.zeros(0, np.int8)
    words = kind.astype(np.uint64) << np.uint64(60)
    values = flat.astype(np.uint64)
    values[gone] = np.uint64((1 << 60) - 1)
    for k, (count, width) in enumerate(SHAPES):
        mine = np.flatnonzero(kind == k)
        begin = first[mine]
        packed = np.zeros(len(mine), np.uint64)
        for place in range(count if len(mine) else 0):
            value = values[begin + place]
            if len(gone):
                value &= np.uint64((1 << width) - 1)  # an escape becomes all ones
            packed |= value << np.uint64(place * width)
        words[mine] |= packed
    table = np.concatenate([np.array(offsets, np.uint32), ids[away]])
    table = np.concatenate([table, np.zeros(len(table) % 2, np.uint32)])
    head = np.array([MAGIC, size, len(words), len(away), runs, 0], "<u4")
    return head.tobytes() + table.astype("<u4").tobytes() + words.astype("<u8").tobytes()


def decode_block(data: bytes) -> np.ndarray:
    """The ids of one block."""
    magic, size, count, escapes, runs, _ = np.frombuffer(data, "<u4", 6).tolist()
    if magic != MAGIC:
        raise ValueError("not a block of token ids")
    table = np.frombuffer(data, "<u4", runs + escapes, 24)
    words = np.frombuffer(data, "<u8", count, 24 + 4 * (runs + escapes + (runs + escapes) % 2))
    offsets = table[:runs].astype(np.int64)
    kinds = (words >> np.uint64(60)).astype(np.int64)
    held = _COUNTS[kinds] if count else np.zeros(0, np.int64)
    before = np.cumsum(held) - held
    run = np.repeat(np.arange(runs), np.diff(np.append(offsets, count)))
    place = run * RUN + before - before[offsets][run] if count else before
    stops = np.minimum((run + 1) * RUN, size)
    out = np.zeros(size, np.uint32)
    gone = np.zeros(size, bool)
    for k, (per, width) in enumerate(SHAPES):
        mine = np.flatnonzero(kinds == k)
        if not len(mine):
            continue
        mask = np.uint64((1 << width) - 1)
        values = (words[mine, None] >> (np.arange(per) * width).astype(np.uint64)) & mask
        spots = place[mine, None] + np.arange(per)
        keep = spots < stops[mine, None]
        out[spots[keep]] = values[keep].astype(np.uint32)
        gone[spots[keep]] = values[keep] == mask
    out[gone] = table[runs:]
    return out
