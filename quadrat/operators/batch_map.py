"""Row functions around a batch model: the boundary where a pipeline leaves Spark's expressions."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


#: Rows that are turned into dicts, and back, at a time.
BLOCK_ROWS = 1024


def whole(values: list) -> pd.Series:
    """A column; integers beside nulls stay integers, where a frame would make them floats."""
    return pd.Series(values, dtype=object if any(v is None for v in values) else None)


def batch_map(df: DataFrame, run: Callable[[list[dict]], list[dict]], schema: str, inputs: Sequence[str], keep: Sequence[str] = (), chunk: int = 64, setup: Callable[[], None] | None = None) -> DataFrame:
    """``run`` gets up to ``chunk`` rows as dicts and returns as many; failed batches give rows with an error.

    Rows keep their order in a partition. ``setup`` runs once a task (load a model there). Adds ``error``.
    Chunks go to and from Spark some ``BLOCK_ROWS`` rows at a time, so that small ones do not each pay for a frame.
    """
    columns = [c.split()[0] for c in schema.split(", ")]
    kept = ", ".join(f"{c} {df.schema[c].dataType.simpleString()}" for c in keep)

    def work(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        if setup:
            setup()
        step = chunk * -(-BLOCK_ROWS // chunk)
        for pdf in parts:
            for start in range(0, len(pdf), step):
                block = pdf.iloc[start : start + step]
                records = block[list(inputs)].to_dict("records")
                out, errors = {c: [] for c in columns}, []
                for at in range(0, len(block), chunk):
                    part = records[at : at + chunk]
                    n = len(part)
                    try:
                        got, error = run(part), None
                        if len(got) != n:
                            raise ValueError(f"{n} rows in, {len(got)} out")
                        values = {c: [g.get(c) for g in got] for c in columns}
                    except Exception as e:  # the row keeps its slot and says why it is empty
                        values, error = {c: [None] * n for c in columns}, f"{type(e).__name__}: {e}"[:500]
                    for c in columns:
                        out[c] += values[c]
                    errors += [error] * n
                yield pd.DataFrame({**{c: list(block[c]) for c in keep}, **{c: whole(v) for c, v in out.items()}, "error": errors})

    return df.select(*dict.fromkeys([*keep, *inputs])).mapInPandas(work, ", ".join(x for x in (kept, schema, "error string") if x))


def rows_to_do(todo: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Rows without a finished result: absent, or ended in error."""
    return todo.join(done.where(F.col("error").isNull()).select(key).distinct(), key, "left_anti")


def decision_tree(df: DataFrame, tree: dict, out: str = "decision", path: str | None = None) -> DataFrame:
    """Evaluate a JSON tree of {"if": SQL, "then": node or value, "else": node or value} as one CASE expression."""

    def value(node):
        return F.when(F.expr(node["if"]), value(node["then"])).otherwise(value(node["else"])) if isinstance(node, dict) else F.lit(node)

    def steps(node):
        return F.when(F.expr(node["if"]), F.concat(F.array(F.lit("y")), steps(node["then"]))).otherwise(F.concat(F.array(F.lit("n")), steps(node["else"]))) if isinstance(node, dict) else F.array().cast("array<string>")

    df = df.withColumn(out, value(tree))
    return df if path is None else df.withColumn(path, F.array_join(steps(tree), ""))
