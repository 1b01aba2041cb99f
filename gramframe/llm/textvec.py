"""Words, lines and n-grams of a column of texts as arrays of 64-bit hashes, without a Python object a word.

A word is a run of bytes other than the white space 0x20 and 0x09-0x0D. Its hash is the sum of a random number for each byte at each
place in the word, mixed again: a table for the first 64 places, and a mix of the table's number and the place's block for later ones.
No polynomial modulo 2^64 is used, as that gives long words of regular structure one hash.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
GOLD, STEP = U(0x9E3779B97F4A7C15), U(0xD1342543DE82EF95)
#: Capital letters become small, and what is no letter or digit becomes a space, among the bytes of ASCII.
PLAIN = np.array([ord(chr(b).lower()) if b >= 128 or chr(b).isalnum() else 32 for b in range(128)] + list(range(128, 256)), np.uint8)
def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit numbers (the finaliser of splitmix64)."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


PLACES = 64
TABLE = mix(np.arange(1, PLACES * 256 + 1, dtype=U) * GOLD)


def sums_of(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Sums of runs modulo 2^64."""
    sums = np.zeros(len(values) + 1, U)
    np.cumsum(values, out=sums[1:])
    return sums[ends] - sums[starts]


def placed(hashes: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Random numbers of hashes at places of a sequence, whose sum stands for the sequence."""
    return mix(hashes ^ mix(place.astype(U) * GOLD + U(1)))


def utf8(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts in a row, and where each begins; null is empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    col = pc.fill_null(col, "").cast(pa.large_string())
    offs = np.frombuffer(col.buffers()[1], np.int64)[col.offset : col.offset + len(col) + 1] if len(col) else np.zeros(1, np.int64)
    data = np.frombuffer(col.buffers()[2], np.uint8)[offs[0] : offs[-1]] if offs[-1] > offs[0] else np.zeros(0, np.uint8)
    return data, offs - offs[0]


class Words:
    """Of all texts: where words begin and end, their hash, and the text each is in."""

    def __init__(self, data: np.ndarray, offs: np.ndarray):
        solid = (data - np.uint8(9) > 4) & (data != 32)
        first = solid.copy()
        first[1:] &= ~solid[:-1]
        last = solid.copy()
        last[:-1] &= ~solid[1:]
        edges = offs[(offs > 0) & (offs < len(data))]
        first[edges] = solid[edges]
        last[edges - 1] = solid[edges - 1]
        self.starts, self.ends = np.flatnonzero(first), np.flatnonzero(last) + 1
        size = self.ends - self.starts
        edge = np.cumsum(size)
        # a text has fewer than 2^31 bytes, and texts are taken together only up to a few megabytes, so 32 bits hold a place
        place = np.arange(edge[-1] if len(edge) else 0, dtype=np.int32) - np.repeat((edge - size).astype(np.int32), size)
        long_words = len(size) and size.max() > PLACES
        value = TABLE.take(((place & (PLACES - 1) if long_words else place) << 8) | data[solid])
        if long_words:
            late = np.flatnonzero(place >= PLACES)
            value[late] = mix(value[late] ^ ((place[late] // PLACES).astype(U) * GOLD))
        self.hash = mix((np.add.reduceat(value, edge - size) if len(size) else value) + size.astype(U) * STEP)
        self.doc = np.searchsorted(offs, self.starts, "right") - 1
        self.count = np.bincount(self.doc, minlength=len(offs) - 1)
        self.at = np.concatenate([[0], np.cumsum(self.count)])

    def ngrams(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Place of the first word and hash of each run of k words within a text."""
        n = len(self.hash) - k + 1
        if n <= 0:
            return np.zeros(0, np.int64), np.zeros(0, U)
        h = self.hash[:n].copy()
        for j in range(1, k):
            h *= STEP
            h += self.hash[j : j + n]
        at = np.flatnonzero(self.doc[:n] == self.doc[k - 1 :])
        return at, mix(h[at])

    def shingles(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Text and hash of each run of k words; a text of fewer words, but at least one, has one of them all. Sorted by text."""
        at, h = self.ngrams(k)
        doc = self.doc[at]
        few = np.flatnonzero((self.count > 0) & (self.count < k))
        if len(few):
            own = np.zeros(len(few), U)
            for i, d in enumerate(few):
                for x in self.hash[self.at[d] : self.at[d + 1]].tolist():
                    own[i] = (int(own[i]) * int(STEP) + x) & 0xFFFFFFFFFFFFFFFF
            doc, h = np.concatenate([doc, few]), np.concatenate([h, mix(own + U(1))])
            order = np.argsort(doc, kind="stable")
            doc, h = doc[order], h[order]
        return doc, h


def distinct_shingles(col: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Text, 44-bit id and number of each distinct shingle, sorted by text and id, and the number of texts (fewer than 2^20)."""
    data, offs = utf8(col)
    doc, h = Words(data, offs).shingles(k)
    key = np.sort((doc.astype(U) << U(44)) | (h >> U(20)))
    new = np.ones(len(key), bool)
    new[1:] = key[1:] != key[:-1]
    at = np.flatnonzero(new)
    return (key[at] >> U(44)).astype(np.int64), key[at] & U((1 << 44) - 1), np.diff(np.append(at, len(key))), len(offs) - 1


def byte_ngrams(data: np.ndarray, offs: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Text and hash of each run of k bytes within a text, repeats included."""
    n = len(data) - k + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, U)
    doc = np.repeat(np.arange(len(offs) - 1), np.diff(offs))
    h = data[:n].astype(U) + U(k)
    for j in range(1, k):
        h *= STEP
        h += data[j : j + n]
    at = doc[:n] == doc[k - 1 :]
    return doc[:n][at], mix(h[at])


def lists(values: np.ndarray, at: np.ndarray, kind: pa.DataType) -> pa.Array:
    """A column of lists, of which at says where each begins."""
    return pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(values, kind))
