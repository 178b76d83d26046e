"""Runs bar builders: a grouped Arrow kernel over each key's ordered rows, 0 to n rows out for a row in."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from ..operators.bars import BARS
from .spark import as_floats


def build_bars(df: DataFrame, name: str, *, key: str | list[str], order: list[str], inputs: dict[str, str] | None = None, **params) -> DataFrame:
    """Key and order columns of the row that closed the bar, its number among that row's bars, and the bar's fields."""
    b = BARS[name]
    unknown = set(params) - set(b.params)
    if unknown:
        raise ValueError(f"{name} has no parameter {sorted(unknown)}")
    params = b.params | params
    b.make(**params)  # checks parameters while the plan is built
    keys = [key] if isinstance(key, str) else list(key)
    cols = [(inputs or {}).get(k, k) for k in b.inputs]
    kinds = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    ddl = ", ".join([f"`{c}` {kinds[c]}" for c in [*keys, *order]] + ["bar int"] + [f"{f} double" for f in b.fields])

    def run(table: pa.Table) -> pa.Table:
        table = table.take(pc.sort_indices(table, [(c, "ascending") for c in order]))
        rows = np.stack([as_floats(table.column(c), c) for c in cols], axis=1)
        step, at, number, out = b.make(**params), [], [], []
        for i in np.flatnonzero(np.isfinite(rows).all(axis=1)):
            for k, bar in enumerate(step(*rows[i].tolist())):
                at.append(i)
                number.append(k)
                out.append(bar)
        head = table.select([*keys, *order]).take(pa.array(at, pa.int64()))
        head = head.append_column("bar", pa.array(number, pa.int32()))
        for j, f in enumerate(b.fields):
            head = head.append_column(f, pa.array([float(r[j]) for r in out], pa.float64()))
        return head

    return df.select(*keys, *order, *[c for c in dict.fromkeys(cols) if c not in (*keys, *order)]).groupBy(*keys).applyInArrow(run, ddl)
