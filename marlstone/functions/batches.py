"""Arrow batches cut to parts of few bytes, so that a task's memory does not grow with what Spark puts into a batch."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that Python holds as strings at once.
PART_BYTES = 2_000_000


def parts(texts: pa.Array, limit: int = PART_BYTES) -> Iterator[tuple[int, int]]:
    """(start, stop) of runs of texts of about ``limit`` bytes, at least one text each."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < len(ends):
        stop = max(at + 1, int(np.searchsorted(ends, (int(ends[at - 1]) if at else 0) + limit, "right")))
        yield at, stop
        at = stop
