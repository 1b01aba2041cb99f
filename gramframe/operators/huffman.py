"""Huffman codes of a vocabulary. The tree needs the counts in order, so it is built on the driver from a vocabulary that is cut first."""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame


def codes_of(weights: dict[str, float]) -> dict[str, str]:
    """Codes from leaf to root: of the two lightest trees the lighter takes 0; ties go by the smallest word."""
    heap = [(w, word, [word]) for word, w in weights.items()]
    heapq.heapify(heap)
    codes = dict.fromkeys(weights, "")
    while len(heap) > 1:
        a, b = heapq.heappop(heap), heapq.heappop(heap)
        for bit, (_, _, words) in zip("01", (a, b)):
            for word in words:
                codes[word] += bit
        heapq.heappush(heap, (a[0] + b[0], min(a[1], b[1]), a[2] + b[2]))
    return codes


def code_book(counts: DataFrame, most_words: int = 1_000_000) -> DataFrame:
    """(word, code) of (word, c). Refuses vocabularies that the driver should not hold: cut them first."""
    n = counts.count()
    if n > most_words:
        raise ValueError(f"{n} words; cut the vocabulary to {most_words} first")
    rows = sorted(codes_of({r["word"]: r["c"] for r in counts.select("word", "c").toLocalIterator()}).items())
    return counts.sparkSession.createDataFrame(rows, "word string, code string")
