"""Periodic runs of words, found online by catching squares over dyadic blocks.

Words are appended to a ``Catchers``. At level k the words are cut into blocks of m = 2^k, and each completed block is a catcher for the
squares whose first half holds it and whose period p is in [2m - 1, 4m - 2]: every stretch of that period's length holds a whole block, so every square is
caught at its level. A catcher lives while its copy can still end, so two catchers per level compare themselves with the suffix of m words that an
appended word completes. Suffixes are compared by 64-bit names that are doubled from level to level; what is equal by name is
compared word by word, to the left and to the right as far as the words p apart agree, which also is the merging: the squares of one
stretch are one run. A run that reaches the last word stays open, and appended words extend it. Squares inside a known run whose period divides
theirs are not compared again, and a stretch that is found with several periods has the smallest one.

Appending many words at once is the same as one by one (the comparisons of a level are array operations over the appended words), so
``runs`` appends the documents of a batch of about two million bytes, a word of its own after each. All work is in the task that read the
document: O(log n) comparisons per word, eight bytes a word and level for the last 6m words. Nothing is shuffled.

A run is a stretch of words with smallest period q and a length of at least max(min_length, min_exponent * q) that no
neighbouring word extends. Words are between white space. Null and empty texts have no words, no runs and the empty text; repeated
rows give repeated rows; no rows give no rows; other columns stay behind.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tributary.llm.common import documents_of, pieces, texts_of

#: Words compared one by one for all candidates of a level before the rest goes on in growing slices.
STEPS = 12
APPEND = 1 << 18


def _named(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Names of pairs of names."""
    x = left * np.uint64(0x9E3779B97F4A7C15) + right
    x ^= x >> np.uint64(29)
    return x * np.uint64(0xBF58476D1CE4E5B9) + right


class Catchers:
    """Runs of the words appended so far. ``longest`` bounds the period (default: none)."""

    def __init__(self, min_length: int = 6, min_exponent: int = 4, longest: int | None = None):
        if min_exponent < 2:
            raise ValueError("a run holds a square")
        self.min_length, self.min_exponent, self.longest = min_length, min_exponent, longest
        self._held = np.zeros(1024, np.int64)
        self.n = 0
        self.levels: list[tuple[int, np.ndarray]] = []  # first position and names of each level's last blocks
        self.found: dict[tuple[int, int], int] = {}  # (start, end) of closed stretches to period
        self.open: list[tuple[int, int]] = []  # (start, period) of stretches that reach the last word
        self.owner = np.zeros((2, 1024), np.int64)  # end and period of a run over each word

    @property
    def words(self) -> np.ndarray:
        return self._held[: self.n]

    def append(self, words: np.ndarray) -> None:
        """Extends the text by words (non-negative numbers, or negative ones that never come twice)."""
        before, self.n = self.n, self.n + len(words)
        if self.n > len(self._held):
            size = max(self.n, 2 * len(self._held))
            self._held = np.concatenate([self._held[:before], np.zeros(size - before, np.int64)])
            self.owner = np.concatenate([self.owner[:, :before], np.zeros((2, size - before), np.int64)], axis=1)
        self._held[before : self.n] = words
        self.owner[:, before : self.n] = 0
        stretches, self.open = self.open, []
        for start, period in stretches:
            self._keep(start, before + self._agree(before, before - period, 1), period)
        m, level, base, names = 1, 0, before, None
        while m <= self.n and (self.longest is None or 2 * m - 1 <= self.longest):
            if names is None:
                new = words.astype(np.int64).view(np.uint64) * np.uint64(0xD1B54A32D192ED03)
            else:
                half = m // 2
                begin = max(0, before - m + 1)  # the first position whose block of m words the appended words complete
                side = names[begin - base :]
                base, new = begin, _named(side[: max(0, len(side) - half)], side[half:])
            if level < len(self.levels):
                first, old = self.levels[level]
                names = np.concatenate([old[: base - first], new])
                base = first
            else:
                names = new
                # Positions before the appended words, when this level did not exist yet.
                if base:
                    base, names = 0, self._names_from_start(m)
            self._catch(m, max(0, before - m + 1), base, names)
            keep = max(0, len(names) - 6 * m)
            entry = (base + keep, names[keep:].copy())
            if level < len(self.levels):
                self.levels[level] = entry
            else:
                self.levels.append(entry)
            m, level = 2 * m, level + 1

    def _names_from_start(self, m: int) -> np.ndarray:
        names = self.words.view(np.uint64) * np.uint64(0xD1B54A32D192ED03)
        half = 1
        while half < m:
            names = _named(names[: max(0, len(names) - half)], names[half:])
            half *= 2
        return names

    def _catch(self, m: int, begin: int, base: int, names: np.ndarray) -> None:
        """Both catchers of each suffix of m words beginning at ``begin`` or later."""
        place = np.arange(max(begin, 2 * m - 1), base + len(names))
        if not len(place):
            return
        nearest = (place - (2 * m - 1)) // m * m
        for block in (nearest, nearest - m):
            there = block >= 0
            equal = np.zeros(len(place), bool)
            equal[there] = names[block[there] - base] == names[place[there] - base]
            if self.longest is not None:
                equal &= place - block <= self.longest
            head = equal.copy()
            head[m:] &= ~equal[:-m]  # the block before agrees at the same distance: the same stretch
            at = np.flatnonzero(head)
            if len(at):
                self._compare(block[at], place[at], m)

    def _compare(self, left: np.ndarray, right: np.ndarray, m: int) -> None:
        period = right - left
        end, known = self.owner[:, left]
        fresh = (known == 0) | (end < right + m) | (period % np.maximum(known, 1) != 0)
        left, right, period = left[fresh], right[fresh], period[fresh]
        words, n = self._held, self.n
        back, ahead = np.zeros(len(left), np.int64), np.zeros(len(left), np.int64)
        for count, sign in ((ahead, 1), (back, -1)):
            alive = np.arange(len(left))
            for i in range(STEPS):
                a, b = (left[alive] + i, right[alive] + i) if sign > 0 else (left[alive] - 1 - i, right[alive] - 1 - i)
                fits = (b < n) if sign > 0 else (a >= 0)
                fits[fits] = words[a[fits]] == words[b[fits]]
                alive = alive[fits]
                count[alive] += 1
                if not len(alive):
                    break
        need = np.maximum(self.min_length, self.min_exponent * period) - period
        grows = (ahead == STEPS) | (right + ahead == n)
        for x in np.flatnonzero((back + ahead >= need) | grows | (back == STEPS)):
            p, a = int(period[x]), int(left[x])
            end, known = self.owner[:, a]
            if known and end >= right[x] + m and p % known == 0:
                continue  # found by a candidate before
            ends = int(right[x] + ahead[x])
            if ahead[x] == STEPS:
                ends += self._agree(ends, ends - p, 1)
            begins = a - int(back[x])
            if back[x] == STEPS:
                begins -= self._agree(begins - 1, begins + p - 1, -1)
            self._keep(begins, ends, p)

    def _agree(self, a: int, b: int, step: int) -> int:
        """How many words from a and from b on (backwards for -1) are equal, in slices that grow."""
        words, n, total, size = self._held, self.n, 0, 64
        while True:
            if step > 0:
                size_here = min(size, n - max(a, b) - total)
                x, y = words[a + total : a + total + size_here], words[b + total : b + total + size_here]
            else:
                size_here = min(size, min(a, b) + 1 - total)
                x = words[a + 1 - total - size_here : a + 1 - total][::-1]
                y = words[b + 1 - total - size_here : b + 1 - total][::-1]
            other = np.flatnonzero(x != y)
            if len(other):
                return total + int(other[0])
            total += size_here
            if size_here < size:
                return total
            size *= 2

    def _keep(self, start: int, end: int, period: int) -> None:
        if end == self.n:
            if (start, period) not in self.open:
                self.open.append((start, period))
        elif self._is_run(start, end, period):
            self.found[start, end] = min(period, self.found.get((start, end), period))
        if end - start >= 2 * period and end - start > self.owner[0, start] - start:
            reach = self.owner[:, start:end]
            shorter = reach[0] < end
            reach[0][shorter], reach[1][shorter] = end, period

    def _is_run(self, start: int, end: int, period: int) -> bool:
        return end - start >= max(self.min_length, self.min_exponent * period)

    def runs(self) -> list[tuple[int, int, int]]:
        """(start, length, period) by start, then period, of all runs of the words so far."""
        found = dict(self.found)
        for start, period in self.open:
            if self._is_run(start, self.n, period):
                found[start, self.n] = min(period, found.get((start, self.n), period))
        return sorted((start, end - start, p) for (start, end), p in found.items())


RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words joined by blanks, without those that a run holds after its first period."""
    if runs:
        edge = np.zeros(len(words) + 1, np.int64)
        for start, length, period in runs:
            edge[start + period] += 1
            edge[start + length] -= 1
        words = [w for w, k in zip(words, np.cumsum(edge)) if not k]
    return b" ".join(words)


def runs(docs: DataFrame, min_length: int = 6, min_exponent: int = 4, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, n_words, runs (start, length, period; by start, then period), and the collapsed text."""
    source = documents_of(docs, doc_id, text)
    names = ["doc_id", "n_words", "runs", "collapsed"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            split = [t.encode().split() for t in texts_of(batch)]
            ids: defaultdict[bytes, int] = defaultdict()
            ids.default_factory = ids.__len__
            begins, total = [], 0
            for words in split:
                begins.append(total)
                total += len(words) + 1
            numbers = np.empty(total, np.int64)
            for number, (at, words) in enumerate(zip(begins, split)):
                numbers[at : at + len(words)] = np.fromiter(map(ids.__getitem__, words), np.int64, len(words))
                numbers[at + len(words)] = -1 - number
            catchers = Catchers(min_length, min_exponent, max(map(len, split)) // min_exponent)
            for i in range(0, total, APPEND):
                catchers.append(numbers[i : i + APPEND])
            found: list[list] = [[] for _ in split]
            all_runs = catchers.runs()
            owner = np.searchsorted(begins, [r[0] for r in all_runs], "right") - 1 if all_runs else ()
            for d, (start, length, period) in zip(owner, all_runs):
                found[d].append((start - begins[d], length, period))
            columns = [
                batch.column(0), pa.array([len(w) for w in split], pa.int64()),
                pa.array([[dict(zip(("start", "length", "period"), r)) for r in f] for f in found], pa.list_(RUN)),
                pa.array([collapsed(w, f).decode() for w, f in zip(split, found)], pa.string()),
            ]
            yield pa.RecordBatch.from_arrays(columns, names)

    kind = source.schema["doc_id"].dataType.simpleString()
    return source.mapInArrow(
        run, f"doc_id {kind}, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string"
    )
