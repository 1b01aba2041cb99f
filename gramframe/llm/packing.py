"""Best-fit packing with bounds that certify it.

Documents become token ids in one pass over their text; only (id, piece, start, length, crc) goes on. Pieces are dealt at random to
partitions of a bounded size, each packed by best-fit decreasing. Dual feasible functions give a lower bound of the sequences that a
partition needs; one that meets its bound is final and certified. Of the others the full sequences are final, while the pieces in
sequences that have a gap go back, are dealt anew among fewer partitions and packed again. After a number of rounds what is left is
final, and certified only if its partition met its bound. `bound` gives the bound of all pieces together.

Defined results: a null text is empty and has the closing id alone; repeated rows are packed as often as they occur; an empty table
gives an empty result; extra columns are ignored. Ids are the tokenizer's, which takes strings of its special tokens for these.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gramframe.llm.common import by_chunk, cut


@dataclass(frozen=True)
class Packing:
    """Tokens a sequence, the id that closes a document, pieces that one task packs, rounds of exchange, and the vocabulary's files (by default those of public_tokenizers)."""

    capacity: int = 2048
    close: int = 0
    partition_rows: int = 40_000
    rounds: int = 4
    tokenizer: str | None = None
    ranks: str | None = None
    cache_units: int = 400_000


class Encoder(dict):
    """Ids of a text as little-endian bytes. Text of printable characters, single spaces and single line breaks is split at them; what
    stands between is encoded once and kept, up to a number of units. Any other text goes to the tokenizer whole."""

    def __init__(self, p: Packing):
        import base64

        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        super().__init__()
        self.whole = Tokenizer.from_file(p.tokenizer or public_tokenizers.path("byte_bpe_50k.json"))
        special = sorted(t.content for t in self.whole.get_added_tokens_decoder().values())
        self.special = re.compile("|".join(map(re.escape, special))) if special else None
        with open(p.ranks or public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.core = tiktoken.Encoding("units", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.single, self.most = self.core._core_bpe.encode_single_piece, p.cache_units

    def __missing__(self, unit: str) -> bytes:
        if unit.isalpha():
            ids = self.single((" " + unit).encode())
        else:
            ids = self.core.encode_ordinary(unit if unit[0] == "\n" else " " + unit)
        self[unit] = out = np.array(ids, "<u4").tobytes()
        return out

    def encode(self, text: str) -> bytes:
        flat = text.replace("\n", " ")
        if not text:
            return b""
        if not flat.isprintable() or "  " in flat or flat[0] == " " or flat[-1] == " " or self.special and self.special.search(text):
            return np.array(self.whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        if len(self) > self.most:
            self.clear()
        first, *units = text.replace("\n", " \n").split(" ")
        return np.array(self.core.encode_ordinary(first), "<u4").tobytes() + b"".join(map(self.__getitem__, units))


_encoders: dict[Packing, Encoder] = {}


def encoder_of(p: Packing) -> Encoder:
    """One for each worker process."""
    if p not in _encoders:
        _encoders[p] = Encoder(p)
    return _encoders[p]


def pieces(docs: DataFrame, p: Packing, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of each piece; the first piece of a long document takes what its length is over."""

    def make(part: pa.RecordBatch) -> pa.RecordBatch:
        encoder = encoder_of(p)
        close, rows = np.array([p.close], "<u4").tobytes(), []
        for doc, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
            ids = encoder.encode(text or "") + close
            n, at, k = len(ids) // 4, 0, 0
            while at < n:
                size = (n - 1) % p.capacity + 1 if k == 0 else p.capacity
                rows.append((doc, k, at, size, zlib.crc32(ids[4 * at : 4 * (at + size)])))
                at, k = at + size, k + 1
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(by_chunk(make, "text"), "doc_id long, piece int, start long, length long, ids_crc32 long")


def lower_bound(lengths: np.ndarray, capacity: int, counts: np.ndarray | None = None) -> int:
    """The largest of the bounds that the dual feasible functions give: sizes as they are; sizes over capacity - e count as a whole,
    those under e as nothing; and sizes rounded to k parts. counts: how often each length occurs, once if not given."""
    if not len(lengths):
        return 0
    values, n = np.unique(lengths, return_counts=True) if counts is None else (np.asarray(lengths), np.asarray(counts))
    x, best = values / capacity, int(-(-int((values * n).sum()) // capacity))
    for e in np.unique(np.minimum(values, capacity - values)):
        if 0 < e <= capacity // 2:
            best = max(best, int(n[values > capacity - e].sum()) + int(-(-int((values * n)[(values >= e) & (values <= capacity - e)].sum()) // capacity)))
    for k in range(1, 21):
        whole = x * (k + 1)
        near = np.isclose(whole, np.round(whole))
        best = max(best, int(np.ceil((np.where(near, x, np.floor(whole + 1e-12) / k) * n).sum() - 1e-9)))
    return best


def bound(rows: DataFrame, p: Packing | None = None) -> int:
    """Fewest sequences that all pieces together can take, by their lengths, of which there are no more than the capacity."""
    p = p or Packing()
    found = rows.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()
    return lower_bound(np.array([r["length"] for r in found], np.int64), p.capacity, np.array([r["n"] for r in found], np.int64))


def best_fit(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Bin and offset of each piece, and the number of bins: the largest piece first, each into the fullest bin that has room."""
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    open_by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    room_mask, n = 0, 0
    for i in np.argsort(-lengths, kind="stable").tolist():
        size = int(lengths[i])
        fit = room_mask >> size
        if fit:
            room = size + (fit & -fit).bit_length() - 1
            b = open_by_room[room].pop()
            if not open_by_room[room]:
                room_mask ^= 1 << room
        else:
            room, b, n = capacity, n, n + 1
        bins[i], offsets[i] = b, capacity - room
        left = room - size
        if left:
            open_by_room[left].append(b)
            room_mask |= 1 << left
    return bins, offsets, n


def pack(rows: DataFrame, p: Packing) -> DataFrame:
    """Pieces with sequence_id, offset and certified: whether the sequence's partition met its bound, or the sequence is full."""
    kind = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long, certified boolean, again boolean"
    done, left = None, rows
    for k in range(p.rounds):
        total = left.count()
        parts, last = max(1, -(-total // p.partition_rows)), k == p.rounds - 1 or total <= p.partition_rows

        def run(batches: Iterator[pa.RecordBatch], k=k, last=last) -> Iterator[pa.RecordBatch]:
            from pyspark import TaskContext

            table = pa.Table.from_batches(batches) if (batches := list(batches)) else None
            if table is None or not table.num_rows:
                return
            lengths = table.column("length").to_numpy()
            bins, offsets, n = best_fit(lengths, p.capacity)
            fill = np.bincount(bins, lengths, n)
            met = n == lower_bound(lengths, p.capacity)
            certified = (fill == p.capacity)[bins] | met
            again = ~certified & (not last)
            sequence = (np.int64(k) << 56) + (np.int64(TaskContext.get().partitionId()) << 32) + bins
            yield from table.append_column("sequence_id", pa.array(sequence)).append_column("offset", pa.array(offsets)).append_column("certified", pa.array(certified)).append_column("again", pa.array(again)).to_batches(10_000)

        spot = F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32", F.lit(k)), F.lit(1 << 40))
        dealt = left.repartitionByRange(parts, spot) if parts > 1 else left.coalesce(1)
        packed = cut(dealt.mapInArrow(run, kind), "packed")
        final = packed.where("not again").drop("again")
        done = final if done is None else done.unionByName(final)
        left = packed.where("again").select(rows.columns)
        if last or left.isEmpty():
            break
    return done


def pack_documents(docs: DataFrame, p: Packing | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    p = p or Packing()
    return pack(cut(pieces(docs, p, id_col, text_col), "pieces"), p)


def query(spark, sf_dir: str) -> DataFrame:
    """Each piece of each document with its sequence and its place there."""
    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
