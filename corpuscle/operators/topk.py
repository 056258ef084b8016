"""Questions in bounded blocks, and the best rows of each question within a task.

Searches give a block of questions to every task and read the corpus once for it; what moves afterwards is at most `k` rows for each
question and task.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TILE_CELLS = 1 << 22  # questions times rows that are scored at a time
HELD = 1 << 18  # rows held before the best are chosen again


def question_blocks(rows: DataFrame, size: int) -> Iterator[pa.Table]:
    """Rows of questions (query_id) in blocks of about `size` questions; a question's rows stay together."""
    count = rows.agg(F.count_distinct("query_id")).first()[0]
    blocks = -(-count // size)
    for k in range(blocks):
        yield rows.filter(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == k).toArrow()


class BestRows:
    """The best `k` rows of each question so far: by score, then by id."""

    def __init__(self, k: int) -> None:
        self._k = k
        self._parts: list[tuple[np.ndarray, ...]] = []
        self._size = 0

    def add(self, question: np.ndarray, row_id: np.ndarray, score: np.ndarray, note: np.ndarray) -> None:
        """Offer rows."""
        self._parts.append((question, row_id, score, note))
        self._size += len(question)
        if self._size > 2 * HELD:
            self._parts = [self.best()]
            self._size = len(self._parts[0][0])

    def add_scores(self, questions: np.ndarray, scores: np.ndarray, row_id: np.ndarray, note: np.ndarray) -> None:
        """Offer a matrix of scores, one row for each question; scores of minus infinity are no rows."""
        if not scores.size:
            return
        least = np.full(len(scores), -np.inf)
        if scores.shape[1] > self._k:
            least = np.partition(scores, scores.shape[1] - self._k, axis=1)[:, scores.shape[1] - self._k]
        at, row = np.nonzero((scores >= least[:, None]) & (scores > -np.inf))
        self.add(questions[at], row_id[row], scores[at, row], note[row])

    def best(self) -> tuple[np.ndarray, ...]:
        """Question, row id, score and note of the rows kept."""
        if not self._parts:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0), np.zeros(0, object)
        question, row_id, score, note = (np.concatenate(x) for x in zip(*self._parts, strict=True))
        order = np.lexsort((row_id, -score, question))
        ordered = question[order]
        first = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]])) if len(ordered) else np.zeros(0, int)
        place = np.arange(len(ordered)) - np.repeat(first, np.diff(np.append(first, len(ordered))))
        kept = order[place < self._k]
        return question[kept], row_id[kept], score[kept], note[kept]
