"""Words, folds and other facts about texts that several operators share.

Texts are handled as UTF-8: ``bytes.split`` parts words at exactly the code points
``\\x20\\x09-\\x0D``, and ``bytes.lower`` lowers exactly ``A-Z``.
"""

from __future__ import annotations

import binascii
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fold(doc_id: object, n: int) -> int:
    """crc32 of the id as text, modulo n. A null id counts as the empty text."""
    return binascii.crc32(b"" if doc_id is None else str(doc_id).encode()) % n


def fold_column(doc_id: Column, n: int) -> Column:
    """:func:`fold` as a Spark expression."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % F.lit(n)


def pieces(batch: pa.RecordBatch, weights: np.ndarray, most: int) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that each piece weighs about `most`; a single heavy row stands alone."""
    start, total = 0, 0
    for i, w in enumerate(weights.tolist()):
        if total and total + w > most:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += w
    if start < batch.num_rows:
        yield batch.slice(start)


def text_bytes(column: pa.Array) -> np.ndarray:
    """Bytes of each text; null has none."""
    import pyarrow.compute as pc

    return pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)


def pick(df: DataFrame, **columns: str) -> DataFrame:
    """Only the named columns, under the names that the operator works with.

    Whatever else the input carries, clashing names included, is left behind here.
    """
    return df.select(*(df[old].alias(new) for new, old in columns.items()))
