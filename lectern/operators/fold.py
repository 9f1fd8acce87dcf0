"""Ordered passes over the rows of one document, for rules whose state no window holds.

`scan` is an expression: rows are an array, the state a struct, and nothing leaves the JVM. `fold_by_doc` hands a document to
Python and is for rules that look back and forth at will."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from lectern.functions.binding import let


def scan(rows: Column, start: Column, emits: str, step: Callable[[Column, Column], Column]) -> Column:
    """An array of what `step` emits for each row, in order. step(state, row) gives a struct of `state`, as start, and `out`, of type emits."""
    begin = F.struct(start.alias("state"), F.array().cast(f"array<{emits}>").alias("out"))

    def grown(held: Column, row: Column) -> Column:
        return let(step(held["state"], row), lambda x: F.struct(x["state"].alias("state"), F.concat(held["out"], F.array(x["out"])).alias("out")))

    return F.aggregate(rows, begin, grown, lambda held: held["out"])


def in_order(df: DataFrame, by: Sequence[str], order: str, name: str = "rows") -> DataFrame:
    """One row for each document with an array of its rows (structs of all other columns), sorted by `order`, which comes first."""
    rest = [c for c in df.columns if c not in by and c != order]
    return df.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct(order, *rest))).alias(name))


def fold_by_doc(df: DataFrame, by: Sequence[str], order: Sequence[str], fn: Callable[[list[dict]], list[dict]], schema: str) -> DataFrame:
    """fn gets a document's rows in order and gives the rows that take their place. A document is the unit of memory; documents stream
    through Arrow batches one after another, so small ones cost little."""
    kind = StructType.fromDDL(schema)
    names, target = kind.names, to_arrow_schema(kind)

    def batch(rows: list[dict]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r.get(n) for r in rows], t) for n, t in zip(names, target.types, strict=True)], schema=target)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []
        done: list[dict] = []
        now: tuple | None = None
        for rows in batches:
            for r in rows.to_pylist():
                if (key := tuple(r[c] for c in by)) != now:
                    if held:
                        done += fn(held)
                    held, now = [], key
                    if len(done) > 8192:
                        yield batch(done)
                        done = []
                held.append(r)
        if held:
            done += fn(held)
        yield batch(done)

    return df.repartition(*by).sortWithinPartitions(*by, *order).mapInArrow(run, schema)
