"""What the operators share: tables in the shared folder, joins of a checked size, chunks of Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gramframe.functions.text import once  # noqa: F401
from gramframe.sources.stage import BROADCAST_ROWS, cut, shared_dir, sized  # noqa: F401

#: Bytes of text that one step of vectorised work takes.
CHUNK_BYTES = 2 << 20
#: A key is heavy if it has more than this part of a table's rows, so there are no more heavy keys than this.
HEAVY_PART = 2000


def join_split(rows: DataFrame, keys: DataFrame, on: list[str], count: str = "rows") -> DataFrame:
    """rows joined with keys, a written table with one row a key and the number of rows that it meets in `count`.

    Heavy keys, of which there are at most HEAVY_PART, are broadcast and meet their rows wherever those are; the others are shuffled, so
    no task gets more of one key than its part of the rows."""
    total = keys.agg(F.sum(count)).first()[0] or 0
    heavy = F.col(count) * HEAVY_PART > total
    few = F.broadcast(keys.where(heavy))
    light = rows.join(few.select(*on), on, "left_anti").join(keys.where(~heavy), on)
    return rows.join(few, on).unionByName(light)


def text_key(text: Column) -> Column:
    """128 bits that stand for a text; null counts as empty."""
    return F.unhex(F.md5(F.coalesce(text, F.lit(""))))


def chunks(batch: pa.RecordBatch, size_of: str, limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of a batch of about limit bytes of the column size_of; a longer value stands alone."""
    import numpy as np
    import pyarrow.compute as pc

    if not batch.num_rows:
        return
    lengths = pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(size_of))), 0)
    ends, start = np.cumsum(lengths.to_numpy(zero_copy_only=False).astype(np.int64)), 0
    while start < batch.num_rows:
        done = int(ends[start - 1]) if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, done + limit, "right")))
        yield batch.slice(start, stop - start)
        start = stop


def by_chunk(make: Callable[[pa.RecordBatch], pa.RecordBatch | None], size_of: str, limit: int = CHUNK_BYTES):
    """A function for mapInArrow that applies make to chunks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, size_of, limit):
                out = make(part)
                if out is not None and out.num_rows:
                    yield out

    return run
