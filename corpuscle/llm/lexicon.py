"""A minimal acyclic transducer from words to token ids, as flat arrays in one file that is memory-mapped.

Words that end alike share states. Each edge carries how many words come before it, so the sum along a path is the word's number in
sorted order; a table gives that number's ids.
"""

from collections.abc import Iterable

import numpy as np

_MAGIC = np.int64(0x31584C43)


def compile_lexicon(words: Iterable[tuple[bytes, list[int]]]) -> bytes:
    """The file of a lexicon; words are made distinct and sorted here."""
    entries = sorted(dict(words).items())
    register: dict[tuple, int] = {}
    open_: list[tuple[list, list, list]] = [([], [], [False])]  # labels, targets, final, from the root down

    def close() -> None:
        labels, targets, final = open_.pop()
        open_[-1][1].append(register.setdefault((final[0], bytes(labels), tuple(targets)), len(register)))

    before = b""
    for word, _ in entries:
        shared = next((k for k, (a, b) in enumerate(zip(before, word, strict=False)) if a != b), min(len(before), len(word)))
        while len(open_) > shared + 1:
            close()
        for byte in word[shared:]:
            open_[-1][0].append(byte)
            open_.append(([], [], [False]))
        open_[-1][2][0] = True
        before = word
    while len(open_) > 1:
        close()
    labels, targets, final = open_.pop()
    register[(final[0], bytes(labels), tuple(targets), "root")] = len(register)

    below = np.zeros(len(register), np.int64)  # words from each state on; targets come before their sources
    keys, goals, skips, ends = [], [], [], np.zeros(len(register), bool)
    for (final, labels, targets, *_), state in register.items():
        ends[state] = final
        passed = int(final)
        for byte, target in zip(labels, targets, strict=True):
            keys.append(state * 256 + byte)
            goals.append(target)
            skips.append(passed)
            passed += int(below[target])
        below[state] = passed
    offsets = np.concatenate([[0], np.cumsum([len(ids) for _, ids in entries])]) if entries else np.zeros(1)
    flat = [x for _, ids in entries for x in ids]
    head = np.array([_MAGIC, len(register), len(keys), len(entries), len(flat)], np.int64)
    parts = [head, *(np.array(x, np.int64) for x in (keys, goals, skips)), offsets.astype(np.int64)]
    return b"".join(x.tobytes() for x in parts) + np.array(flat, np.uint32).tobytes() + ends.astype(np.uint8).tobytes()


class Lexicon:
    """A compiled lexicon over a file or bytes; many words walk it at once."""

    def __init__(self, data: np.ndarray | bytes) -> None:
        whole = np.frombuffer(data, np.uint8) if isinstance(data, bytes) else data
        magic, states, edges, words, ids = whole[:40].view(np.int64)
        if magic != _MAGIC:
            raise ValueError("not a lexicon file")
        cuts = np.cumsum([40, *[8 * edges] * 3, 8 * (words + 1), 4 * ids, states])
        kinds = (np.int64, np.int64, np.int64, np.int64, np.uint32, np.uint8)
        parts = [whole[a:b].view(k) for a, b, k in zip(cuts, cuts[1:], kinds, strict=False)]
        self._keys, self._goals, self._skips, self.offsets, self.ids, self._final = parts
        self._root = int(states) - 1

    @classmethod
    def mapped(cls, path: str) -> "Lexicon":
        """The lexicon of a file, which all processes of a machine share."""
        return cls(np.memmap(path, np.uint8, "r"))

    def find(self, data: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
        """The number of each byte range's word, -1 for words that are not in the lexicon."""
        state = np.full(len(start), self._root, np.int64)
        number = np.zeros(len(start), np.int64)
        live = np.flatnonzero(length > 0)
        lost = np.zeros(len(start), bool)
        step = 0
        while len(live) and len(self._keys):
            key = state[live] * 256 + data[start[live] + step]
            edge = np.minimum(np.searchsorted(self._keys, key), len(self._keys) - 1)
            there = self._keys[edge] == key
            lost[live[~there]] = True
            live, edge = live[there], edge[there]
            state[live] = self._goals[edge]
            number[live] += self._skips[edge]
            step += 1
            live = live[length[live] > step]
        known = ~lost & (self._final[state] > 0) & (len(self._keys) > 0)
        return np.where(known, number, -1)
