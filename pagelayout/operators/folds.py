"""Order-dependent folds: rows of a group stream through a small per-group state.

Spark shuffles by group key and sorts; Python sees Arrow batches in order and keeps only the state, so a
long group needs no more memory than a short one.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T


class Fold:
    """State of one group: ``add`` takes one row and yields finished output rows, ``close`` the rest."""

    def add(self, row: tuple) -> list[tuple]:
        raise NotImplementedError

    def close(self) -> list[tuple]:
        return []


def ordered_fold(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    columns: Sequence[str],
    make: Callable[[], Fold],
    schema: str,
) -> DataFrame:
    """Fold ``columns`` of each group in ``order``; output rows are the keys followed by what the fold yields."""
    keys, columns = list(keys), list(columns)
    nk = len(keys)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, state = None, None
        out_names = [part.strip().split(" ")[0].strip("`") for part in _split_schema(schema)]
        for pdf in batches:
            rows: list[tuple] = []
            cols = [pdf[c].tolist() for c in [*keys, *columns]]
            for rec in zip(*cols):
                key = rec[:nk]
                if key != current:
                    if state is not None:
                        rows.extend(current + r for r in state.close())
                    current, state = key, make()
                rows.extend(key + r for r in state.add(rec[nk:]))
            if rows:
                yield pd.DataFrame(rows, columns=out_names)
        if state is not None:
            rest = [current + r for r in state.close()]
            if rest:
                yield pd.DataFrame(rest, columns=out_names)

    needed = list(dict.fromkeys([*keys, *order, *columns]))
    placed = df.select(*needed).repartition(*keys).sortWithinPartitions(*keys, *order)
    return placed.mapInPandas(run, schema=schema)


def ordered_label(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    inputs: Sequence[str],
    make: Callable[[], Callable[[tuple], int]],
    label: str,
) -> DataFrame:
    """Add an integer column: each group's rows, in ``order``, go through a fresh labelling function.

    All other columns pass through as Arrow data untouched.
    """
    keys, inputs = list(keys), list(inputs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, step = None, None
        for batch in batches:
            key_cols = [batch.column(k).to_pylist() for k in keys]
            in_cols = [batch.column(c).to_pylist() for c in inputs]
            labels = []
            for key, rec in zip(zip(*key_cols), zip(*in_cols)):
                if key != current:
                    current, step = key, make()
                labels.append(step(rec))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(labels, pa.int64())], names=[*batch.schema.names, label])

    schema = T.StructType([*df.schema.fields, T.StructField(label, T.LongType())])
    placed = df.repartition(*keys).sortWithinPartitions(*keys, *order)
    return placed.mapInArrow(run, schema=schema)


def _split_schema(schema: str) -> list[str]:
    parts, depth, cur = [], 0, ""
    for ch in schema:
        if ch == "," and depth == 0:
            parts.append(cur)
            cur = ""
            continue
        depth += ch == "<"
        depth -= ch == ">"
        cur += ch
    return [*parts, cur]
