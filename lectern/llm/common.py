"""Helpers shared by the training-text operators."""

from __future__ import annotations

import ctypes
import os
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

#: Python operators work on slices of an Arrow batch of at most so many text bytes and rows, which bounds
#: their temporary arrays; one longer text makes a slice of its own.
SLICE_BYTES = 2 << 20
SLICE_ROWS = 4096


def tokenizer_path(name: str) -> str:
    """Default place of a public vocabulary file; every operator also takes a path of its own."""
    import public_tokenizers

    return public_tokenizers.path(name)


def set_aside(df: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """The rows with columns named ``c0, c1, ...``, which can't clash with an operator's own, and each column's new name."""
    names = {c: f"c{i}" for i, c in enumerate(df.columns)}
    return df.toDF(*names.values()), names


def slices(batches: Iterable[pa.RecordBatch], text: str = "text", size: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Parts of the batches that hold at most SLICE_ROWS rows and about ``size`` bytes of ``text``."""
    import numpy as np
    import pyarrow.compute as pc

    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(sizes.astype(np.int64))
        at = 0
        while at < n:
            base = ends[at - 1] if at else 0
            to = int(np.searchsorted(ends, base + size, side="right"))
            to = min(max(to, at + 1), at + SLICE_ROWS, n)
            yield batch.slice(at, to - at)
            at = to


def quiet_threads() -> None:
    """One thread for each Python worker: Spark already runs one task on each core."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")


_HELD: dict[str, Callable[[], None]] = {}


def release_caches(*keep: str) -> None:
    """Give back what other operators' tasks have cached in this Python worker, which goes on from stage to stage."""
    for name in [n for n in _HELD if n not in keep]:
        _HELD.pop(name)()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def hold_cache(name: str, clear: Callable[[], None], *beside: str) -> None:
    """Keep a cache for this worker's next tasks; of the others only those named stay."""
    _HELD[name] = clear
    release_caches(name, *beside)
