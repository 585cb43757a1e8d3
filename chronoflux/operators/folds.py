"""Order-dependent passes over the rows of a key: one row at a time, a small state, nothing copied."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType, _parse_datatype_string


def fold(rows: DataFrame, keys: list[str], order: list[Column | str], out: str, start: Callable[[], object], step: Callable[..., Iterable[tuple]], end: Callable[..., Iterable[tuple]] | None = None) -> DataFrame:
    """``keys`` and the columns of ``out`` for each tuple that ``step(state, *row)`` or ``end(state)`` gives.

    Rows of a key come in ``order``, their key columns left off; ``start()`` makes the
    state of a key, which ``step`` changes in place.  Spark deals keys out and sorts
    them; a task streams its rows batch by batch, so memory is the state and work is
    linear in the rows, however many a key has.
    """
    schema = StructType([rows.schema[k] for k in keys] + _parse_datatype_string(out).fields)
    arrow, n = to_arrow_schema(schema), len(keys)
    rest = [c for c in rows.columns if c not in keys]
    dealt = rows.select(*keys, *rest).repartition(*keys).sortWithinPartitions(*keys, *order)

    def batch_of(found: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*found, strict=True), arrow, strict=True)], schema=arrow)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key: tuple | None = None
        state: object = None
        for batch in batches:
            found: list[tuple] = []
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                own = row[:n]
                if own != key:
                    if key is not None and end is not None:
                        found += [(*key, *x) for x in end(state)]
                    key, state = own, start()
                found += [(*own, *x) for x in step(state, *row[n:])]
            if found:
                yield batch_of(found)
        if key is not None and end is not None:
            found = [(*key, *x) for x in end(state)]
            if found:
                yield batch_of(found)

    return dealt.mapInArrow(run, schema)
