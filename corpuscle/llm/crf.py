"""A linear-chain conditional random field over word shapes, in numpy.

A word's shape is a few small numbers: which kinds of characters it has, digits, dots, length, ends. Scores of a word add up from tables
for its own numbers and for those of its neighbours; labels in a row add transition scores. All sequences of a batch
are decoded together, one word further at each step.
"""

from dataclasses import dataclass

import numpy as np

from corpuscle.llm.words import Words

KINDS = ("email", "ip", "card", "phone")
LABELS = ("out", *(f"{how}-{kind}" for kind in KINDS for how in ("begin", "inside")))
N = len(LABELS)

_CLASS = np.full(256, 7, np.uint8)  # other characters
_CLASS[[*range(65, 91), *range(97, 123)]] = 0
_CLASS[48:58] = 1
_CLASS[ord("@")], _CLASS[ord(".")], _CLASS[ord("-")], _CLASS[ord("+")] = 2, 3, 4, 5
_CLASS[[ord("("), ord(")")]] = 6
_COUNTS = np.array([0, 1, 2, 3, 4, 5, 7, 10, 13, 16, 17, 20])
_LENGTHS = np.array([1, 2, 4, 7, 10, 14, 17, 22])
SIZES = (256, 12, 8, 5, 64)  # kinds of characters, digits, length, dots, first and last character
NEAR = (256, 12)  # what is seen of the word before and after


def shapes(words: Words) -> np.ndarray:
    """One row of small numbers per word, as wide as `SIZES`."""
    if not len(words.start):
        return np.zeros((0, len(SIZES)), np.int64)
    kinds = _CLASS[words.data]
    begins = np.stack([words.start, words.end], 1).ravel()
    begins[-1] = min(begins[-1], len(kinds) - 1)
    has = np.bitwise_or.reduceat(np.uint8(1) << kinds, begins)[::2]
    counts = np.add.reduceat((kinds == 1).astype(np.int64) + ((kinds == 3).astype(np.int64) << 32), begins)[::2]
    digits, dots = counts & 0xFFFFFFFF, counts >> 32
    last = words.end - 1
    one = words.end - words.start == 1  # the last word's range is cut at the end of the data
    if begins[-2] == begins[-1] or one[-1]:
        k = kinds[words.start[-1]]
        has[-1], digits[-1], dots[-1] = np.uint8(1) << k, k == 1, k == 3
    else:
        tail = kinds[words.start[-1] : words.end[-1]]
        has[-1], digits[-1], dots[-1] = np.bitwise_or.reduce(np.uint8(1) << tail), (tail == 1).sum(), (tail == 3).sum()
    length = words.end - words.start
    columns = [
        has.astype(np.int64),
        np.searchsorted(_COUNTS, digits, side="right") - 1,
        np.searchsorted(_LENGTHS, length, side="right") - 1,
        np.minimum(dots, 4),
        kinds[words.start].astype(np.int64) * 8 + kinds[last],
    ]
    return np.stack(columns, 1)


def neighbours(shape: np.ndarray, sequence: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What is seen of the words before and after, as one number; the number beyond the last for none."""
    near = shape[:, 0] * NEAR[1] + shape[:, 1]
    none = NEAR[0] * NEAR[1]
    before, after = np.full(len(near), none), np.full(len(near), none)
    same = sequence[1:] == sequence[:-1]
    before[1:][same] = near[:-1][same]
    after[:-1][same] = near[1:][same]
    return before, after


@dataclass
class Field:
    """Weights: a table for each number of a shape, tables for the two neighbours, transitions."""

    own: list[np.ndarray]
    near: list[np.ndarray]  # before and after; each a table of character kinds and one of digits
    moves: np.ndarray

    def _near(self, side: int) -> np.ndarray:
        """Scores by what is seen of a neighbour, with a row of zeros for none."""
        kinds, digits = self.near[2 * side], self.near[2 * side + 1]
        return np.concatenate([(kinds[:, None] + digits[None]).reshape(-1, N), np.zeros((1, N))])

    def emissions(self, shape: np.ndarray, before: np.ndarray, after: np.ndarray) -> np.ndarray:
        """Score of each label for each word."""
        out = self._near(0)[before] + self._near(1)[after]
        for table, column in zip(self.own, shape.T, strict=True):
            out += table[column]
        return out

    def quiet(self, shape: np.ndarray) -> np.ndarray:
        """Words that no neighbours and no transitions can make anything but `out`.

        A stretch of other labels over such words alone loses more at each word than its transitions can bring.
        """
        own = sum(table[column] for table, column in zip(self.own, shape.T, strict=True))
        near = sum((t - t[:, :1]).max(0) for t in (self._near(0), self._near(1)))
        gain = (own - own[:, :1] + near)[:, 1:].max(1)
        return gain + 2 * max(0.0, float((self.moves - self.moves[0, 0]).max())) < 0

    def decode(self, emissions: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """The best label of each word of sequences that begin at `starts`."""
        order = np.argsort(-lengths, kind="stable")
        starts, lengths = starts[order], lengths[order]
        labels = np.zeros(len(emissions), np.int8)
        if not len(starts):
            return labels
        back = np.zeros((len(emissions), N), np.int8)
        best = emissions[starts].copy()
        best[:, 2::2] = -np.inf  # a sequence does not begin inside
        last = best.copy()
        for step in range(1, int(lengths[0])):
            live = int(np.searchsorted(-lengths, -step, side="left"))
            at = starts[:live] + step
            ways = best[:live, :, None] + self.moves
            back[at] = ways.argmax(1)
            best = ways.max(1) + emissions[at]
            last[:live] = best
        now = last.argmax(1)
        for step in range(int(lengths[0]) - 1, -1, -1):
            live = int(np.searchsorted(-lengths, -step, side="left"))
            at = starts[:live] + step
            labels[at] = now[:live]
            now[:live] = back[at, now[:live]]
        return labels


def _allowed() -> np.ndarray:
    """0 for transitions that may be, minus infinity for an inside label after anything but its own kind."""
    moves = np.zeros((N, N))
    for k in range(2, N, 2):
        moves[:, k] = -np.inf
        moves[[k - 1, k], k] = 0
    return moves


def fit(shape: np.ndarray, sequence: np.ndarray, labels: np.ndarray, *, rounds: int = 120, rate: float = 0.15, decay: float = 2e-3) -> Field:
    """Maximise the regularised likelihood of labelled sequences by forward and backward sums; `sequence` is sorted."""
    before, after = neighbours(shape, sequence)
    none = NEAR[0] * NEAR[1]
    cuts = np.flatnonzero(np.concatenate([[True], sequence[1:] != sequence[:-1], [True]]))
    starts, lengths = cuts[:-1], np.diff(cuts)
    count, width = len(starts), int(lengths.max())
    spot = starts[:, None] + np.arange(width)
    real = np.arange(width) < lengths[:, None]
    spot = np.where(real, spot, 0)
    field = Field([np.zeros((n, N)) for n in SIZES], [np.zeros((n, N)) for n in (*NEAR, *NEAR)], np.zeros((N, N)))
    barred = _allowed()
    tables = [*field.own, *field.near, field.moves]
    first, second = [np.zeros_like(t) for t in tables], [np.zeros_like(t) for t in tables]
    sides = [(before, before < none), (after, after < none)]
    truth = np.zeros((len(labels), N))
    truth[np.arange(len(labels)), labels] = 1
    pairs = np.zeros((N, N))
    joined = sequence[1:] == sequence[:-1]
    np.add.at(pairs, (labels[:-1][joined], labels[1:][joined]), 1)
    for step in range(1, rounds + 1):
        moves = field.moves + barred
        scores = field.emissions(shape, before, after)[spot]
        scores[:, 0, 2::2] = -np.inf
        ahead = np.full((count, width, N), -np.inf)
        ahead[:, 0] = scores[:, 0]
        for t in range(1, width):
            ahead[:, t] = np.where(real[:, t, None], _logsum(ahead[:, t - 1, :, None] + moves, 1) + scores[:, t], ahead[:, t - 1])
        whole = _logsum(ahead[:, -1], 1)
        behind = np.zeros((count, width, N))
        expected = np.zeros((N, N))
        for t in range(width - 2, -1, -1):
            follow = scores[:, t + 1] + behind[:, t + 1]
            ways = moves + follow[:, None, :]
            behind[:, t] = np.where(real[:, t + 1, None], _logsum(ways, 2), 0)
            chance = np.exp(ahead[:, t, :, None] + ways - whole[:, None, None])
            expected += chance[real[:, t + 1]].sum(0)
        odds = np.exp(ahead + behind - whole[:, None, None])
        away = np.zeros((len(labels), N))
        away[spot[real]] = odds[real]
        away = (away - truth) / count
        grads = []
        for table, column in zip(field.own, shape.T, strict=True):
            g = np.zeros_like(table)
            np.add.at(g, column, away)
            grads.append(g)
        for seen, there in sides:
            for part in (seen[there] // NEAR[1], seen[there] % NEAR[1]):
                g = np.zeros_like(field.near[len(grads) - len(field.own)])
                np.add.at(g, part, away[there])
                grads.append(g)
        grads.append((expected - pairs) / count)
        for k, g in enumerate(grads):
            g = g + decay * tables[k]
            first[k] = 0.9 * first[k] + 0.1 * g
            second[k] = 0.99 * second[k] + 0.01 * g * g
            tables[k] -= rate * first[k] / (1 - 0.9**step) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-6)
    field.moves = field.moves + barred
    return field


def _logsum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis, keepdims=True)
    top = np.where(np.isfinite(top), top, 0)
    with np.errstate(divide="ignore"):
        return np.log(np.exp(x - top).sum(axis)) + np.squeeze(top, axis)
