"""Log partition functions of many contexts at once and the model's part of their gradients, in numpy.

Word w and feature f share the parameter (a_w + b_f) mod BUCKETS. So contexts that differ in one feature alone have their partition
functions side by side in one circular correlation of exp(theta) with the words' other factors, and their gradients in two convolutions:
transforms of BUCKETS numbers in place of a product of contexts and words. Contexts that share too little, or whose sums are so small that
a transform's rounding would show, are summed word by word."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator, Sequence

import numpy as np

BUCKETS, WORD, FEATURE = 1 << 20, 73856093, 19349663
#: Cells that are summed word by word at a time, and from which on transforms are cheaper.
CELLS = 2_000_000
#: Relative rounding of a transform, by the norms of both sides, and what of it a sum may show.
ROUNDING, SHOWN = 1e-15, 1e-11


def words_at(ids) -> np.ndarray:
    return np.asarray(ids, np.int64) % BUCKETS * WORD % BUCKETS


def features_at(ids) -> np.ndarray:
    return np.asarray(ids, np.int64) % BUCKETS * FEATURE % BUCKETS


class Scores:
    """Sums over all words for bags of features, by parameters theta."""

    def __init__(self, theta: np.ndarray, words: Sequence[int]):
        self.theta, self.at = theta, words_at(words)
        self.top = theta.max()
        self.exp = np.exp(theta - self.top)
        self.mean = self.exp.mean()
        self.rest = self.exp - self.mean
        self.rest_norm, self.rest_transform = np.linalg.norm(self.rest), None

    def _correlated(self, transform: np.ndarray, total: float) -> np.ndarray:
        """The sum over a of x[a] exp[a + b] for each b, of x with that transform and total. The mean is left out of the transforms, as it needs none."""
        if self.rest_transform is None:
            self.rest_transform = np.fft.rfft(self.rest)
        return np.fft.irfft(np.conj(transform) * self.rest_transform, BUCKETS) + self.mean * total

    def _groups(self, bags: Sequence[Sequence[int]]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """Rows that share all features but the last, places of the last, places of the others, and the words' scores by those."""
        shared = defaultdict(list)
        for i, bag in enumerate(bags):
            shared[tuple(bag[:-1])].append(i)
        for base, rows in shared.items():
            others = features_at(base)
            scores = np.zeros(len(self.at))
            for f in others:
                scores += self.theta[(self.at + f) % BUCKETS]
            yield np.array(rows), features_at([bags[i][-1] for i in rows]), others, scores

    def _many(self, rows) -> bool:
        return len(rows) * len(self.at) > 4 * CELLS

    def _chunks(self, n: int) -> Iterator[slice]:
        size = max(1, CELLS // max(1, len(self.at)))
        return (slice(i, i + size) for i in range(0, n, size))

    def _log_z(self, last: np.ndarray, scores: np.ndarray) -> np.ndarray:
        out, left = np.empty(len(last)), np.arange(len(last))
        if self._many(last):
            top = scores.max()
            p = np.bincount(self.at, np.exp(scores - top), BUCKETS)
            z = self._correlated(np.fft.rfft(p), p.sum())[last]
            sure = z * SHOWN > ROUNDING * np.linalg.norm(p) * self.rest_norm
            out[sure] = np.log(z[sure]) + top + self.top
            left = np.flatnonzero(~sure)
        for part in self._chunks(len(left)):
            s = scores + self.theta[(self.at + last[left[part], None]) % BUCKETS]
            top = s.max(1)
            out[left[part]] = top + np.log(np.exp(s - top[:, None]).sum(1))
        return out

    def log_z(self, bags: Sequence[Sequence[int]]) -> np.ndarray:
        out = np.empty(len(bags))
        for rows, last, _, scores in self._groups(bags):
            out[rows] = self._log_z(last, scores)
        return out

    def model(self, bags: Sequence[Sequence[int]], m: Sequence[float], strength: float) -> tuple[float, np.ndarray, np.ndarray]:
        """Of contexts that are seen m times: the sum of -m (log Z + strength / 2 (log Z)^2), its gradient, and which parameters have one."""
        m = np.asarray(m, float)
        value, grad, met = 0.0, np.zeros(BUCKETS), np.zeros(BUCKETS, bool)
        for rows, last, others, scores in self._groups(bags):
            z = self._log_z(last, scores)
            value -= float((m[rows] * (z + strength / 2 * z * z)).sum())
            r = m[rows] * (1 + strength * z)
            if not (self._many(last) and self._by_transforms(last, others, scores, r, z, grad, met)):
                self._by_words(last, others, scores, r, z, grad, met)
        return value, grad, met

    def _by_transforms(self, last, others, scores, r, z, grad, met) -> bool:
        top = scores.max()
        factor = np.exp(scores - top)
        p, seen = np.bincount(self.at, factor, BUCKETS), np.bincount(last, r * np.exp(top + self.top - z), BUCKETS)
        noise = ROUNDING * np.linalg.norm(seen) * max(np.linalg.norm(p), self.rest_norm)
        if not noise < SHOWN * np.abs(r).sum():
            return False
        of_seen, here, there = np.fft.rfft(seen), np.zeros(BUCKETS), np.zeros(BUCKETS)
        grad -= self.exp * np.fft.irfft(np.fft.rfft(p) * of_seen, BUCKETS)
        here[self.at], there[last] = 1, 1
        met |= np.fft.irfft(np.fft.rfft(here) * np.fft.rfft(there), BUCKETS) > 0.5
        if len(others):
            w = factor * self._correlated(of_seen, seen.sum())[self.at]
            for f in others:
                grad -= np.bincount((self.at + f) % BUCKETS, w, BUCKETS)
                met[(self.at + f) % BUCKETS] = True
        return True

    def _by_words(self, last, others, scores, r, z, grad, met) -> None:
        total = np.zeros(len(self.at))
        for part in self._chunks(len(last)):
            ids = (self.at + last[part, None]) % BUCKETS
            w = r[part, None] * np.exp(scores + self.theta[ids] - z[part, None])
            total += w.sum(0)
            grad -= np.bincount(ids.ravel(), w.ravel(), BUCKETS)
            met[ids.ravel()] = True
        for f in others:
            grad -= np.bincount((self.at + f) % BUCKETS, total, BUCKETS)
            met[(self.at + f) % BUCKETS] = True
