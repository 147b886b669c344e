"""Folds over logs that depend on order: dealt by key, sorted, gone through once with the state of one key."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema


def folded(log: DataFrame, by: str, order: list[str], fields: list[str], start: Callable[[], list], step: Callable[[list, tuple], tuple], schema: T.StructType, last_only: bool = False) -> DataFrame:
    """``step(state, fields)`` for the events of each key in order, whose results are rows of ``schema`` after the key; of each key
    only the last one if so wished."""
    names = [by, *fields]
    rows = log.select(*[F.col(c) for c in dict.fromkeys([by, *order, *fields])]).repartition(by).sortWithinPartitions(by, *order)
    out_schema = T.StructType([log.schema[by], *schema.fields])
    arrow = to_arrow_schema(out_schema)

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nothing = object()
        key, state, pending = nothing, [], None
        for b in batches:
            out = []
            for now, *event in zip(*[b.column(n).to_pylist() for n in names], strict=True):
                if now != key:
                    if pending is not None:
                        out.append(pending)
                    key, state, pending = now, start(), None
                row = (now, *step(state, tuple(event)))
                if last_only:
                    pending = row
                else:
                    out.append(row)
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], f.type) for i, f in enumerate(arrow)], schema=arrow)
        if pending is not None:
            yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(pending, arrow, strict=True)], schema=arrow)

    return rows.mapInArrow(walk, out_schema)
