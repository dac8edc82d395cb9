"""Terms of many texts at once, as arrays; for kernels that run over Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute

from textloom.functions.rulers import index_terms

#: Bytes of text whose terms are held at once.
SLICE_BYTES = 4 << 20


def sliced(batch: pa.RecordBatch, column: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """A batch in slices of at most `most` bytes of a column, at least a row each."""
    sizes = np.asarray(pa.compute.fill_null(pa.compute.binary_length(batch.column(column)), 0), np.int64)
    ends, at = np.cumsum(sizes), 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, side="right")))
        yield batch.slice(at, to - at)
        at = to


def counted(texts: Sequence[str | None]) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """(distinct terms, sorted; and of each pair of a term and a text that holds it: the term's number, the text's, how often), by term and text."""
    own = [index_terms(t) if t else [] for t in texts]
    found = pa.array(list(chain.from_iterable(own)), pa.string()).dictionary_encode()
    order = np.asarray(pa.compute.sort_indices(found.dictionary), np.int64)
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    n = max(1, len(own))
    text = np.repeat(np.arange(len(own)), np.fromiter(map(len, own), np.int64, len(own)))
    pairs, times = np.unique(rank[np.asarray(found.indices, np.int64)] * n + text, return_counts=True)
    return found.dictionary.take(pa.array(order)), pairs // n, pairs % n, times
