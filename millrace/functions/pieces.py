"""Arrow functions of texts that hold a bounded part of a batch as Python objects."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import functions as F

BYTES = 1 << 20  # of text whose results are made together


def pieces(texts: pa.Array, most: int = BYTES) -> Iterator[pa.Array]:
    """texts in slices of about most bytes, a longer text alone: slices share the batch's memory."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64) + 8)
    at = 0
    while at < len(texts):
        before = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, before + most, "right")))
        yield texts.slice(at, to - at)
        at = to


def by_pieces(work: Callable[[], Callable[[str | None], object]], returns: str, kind: pa.DataType):
    """An Arrow function text -> work()(text), Spark's type and Arrow's. work() is called once a task and may keep a bounded cache;
    the results of a piece leave before those of the next are made, however large the batch."""

    @F.arrow_udf(returns)
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        one = work()
        for texts in batches:
            for some in pieces(texts):
                yield pa.array([one(t) for t in some.to_pylist()], kind)

    return run
