"""Operators and candles over Structured Streaming queries: the expressions of the batch plans, one row at a time per key."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators import catalog
from ..plans.expr import Stepper
from ..plans.spark import flat, named


def stream_operator(df: DataFrame, name: str, *, key: str, order: list[str], inputs: dict[str, str] | None = None, out: str | None = None, **params) -> DataFrame:
    """Key, order and output columns of an operator over a stream. Each key's state (last rows of its windows and
    the recursions' numbers) is in the state store; rows of a micro-batch are taken in ``order``."""
    op = catalog.get(name)
    wanted = {k: (inputs or {}).get(k, k) for k in catalog.INPUTS[op.kind]}
    outs = named(op.outputs(**params), out or name.lower())
    nodes = flat(outs)
    kinds = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    plain = {k: v for k, v in outs.items() if not isinstance(v, list)}
    if len(plain) != len(outs):
        raise ValueError(f"{name} yields arrays, which this runner doesn't")
    ddl = ", ".join([f"`{c}` {kinds[c]}" for c in [key, *order]] + [f"`{k}` double" for k in outs])

    def run(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        stepper = cloudpickle.loads(bytes(state.get[0])) if state.exists else Stepper(nodes)
        rows = pd.concat(list(frames)).sort_values(order)
        x = rows[list(wanted.values())].to_numpy(float)
        got = np.full((len(rows), len(nodes)), np.nan)
        for i in np.flatnonzero(np.isfinite(x).all(axis=1)):
            got[i] = stepper.step(dict(zip(wanted, x[i].tolist(), strict=True)))
        state.update((cloudpickle.dumps(stepper),))
        result = rows[[key, *order]].reset_index(drop=True)
        for j, c in enumerate(outs):
            result[c] = pd.Series(got[:, j]).astype(object).where(~np.isnan(got[:, j]), None)
        yield result

    used = list(dict.fromkeys([key, *order, *wanted.values()]))
    return df.select(*used).groupBy(key).applyInPandasWithState(run, ddl, "state binary", "append", GroupStateTimeout.NoTimeout)


def stream_candles(ticks: DataFrame, window: str, *, key: str, ts: str = "ts", price: str = "price", volume: str = "volume", seq: str, late: str = "0 seconds") -> DataFrame:
    """Candles of a tick stream (ts is a timestamp), emitted once the watermark passes their end."""
    at = F.struct(ts, seq)
    d = ticks.withWatermark(ts, late).groupBy(key, F.window(ts, window).alias("w")).agg(
        F.min_by(price, at).alias("open"), F.max(price).alias("high"), F.min(price).alias("low"), F.max_by(price, at).alias("close"), F.sum(volume).alias("volume")
    )
    return d.select(key, F.col("w.start").alias(ts), "open", "high", "low", "close", "volume")
