"""Runs operators on DataFrames.

Operators without recursions of their own become Catalyst window expressions: one exchange by key,
one sort, then a WindowExec for each dependency level. Exponential averages are windows too: over
rows e = 0.. of a block, y = r^e (sum of a x_i r^-i), plus what the block before adds; a block is
long enough that older ones vanish below double precision, so no state is carried in Python.

Other operators run in an Arrow kernel over each key's ordered rows (``kernel``), or, with
``bounded=True``, row by row over sorted partitions with the state of one key at a time, for
series that do not fit one task's memory.

Rows with a null or non-finite input yield null and are invisible to the state: they form
window partitions of their own.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators import catalog
from .expr import Node, Stepper, evaluate

#: Decay over one block of an exponential average, as a power of e.
BLOCK = 230.0


def flat(outputs: dict) -> list[Node]:
    return [z for v in outputs.values() for z in (v if isinstance(v, list) else [v])]


def decay(x: Node) -> tuple[int, float, float, bool] | None:
    """(seed rows, weight of a value, decay, seed is a sum) of an exponential recursion node."""
    tag = x.param[0].tag[2] if x.kind == "scan" else ()
    if not isinstance(tag, tuple):
        return None
    if tag[:1] == ("ema",) and 0 < tag[2] <= 1:
        return tag[1], tag[2], 1 - tag[2], False
    if tag[:1] == ("wsum",):
        return tag[1], 1.0, 1 - 1 / tag[1], True
    return None


def is_native(nodes: list[Node]) -> bool:
    seen, todo = set(), list(nodes)
    while todo:
        x = todo.pop()
        if id(x) in seen:
            continue
        seen.add(id(x))
        if x.kind in ("window", "pick") or x.kind == "scan" and decay(x) is None:
            return False
        todo += x.args
    return True


def _guard(c: Column, *args: Column) -> Column:
    ok = args[0].isNotNull()
    for a in args[1:]:
        ok = ok & a.isNotNull()
    return F.when(ok, c)


FN = {
    "add": lambda a, b: a + b, "sub": lambda a, b: a - b, "mul": lambda a, b: a * b, "div": lambda a, b: F.when(b != 0, a / b),
    "abs": F.abs, "gt": lambda a, b: a > b, "ge": lambda a, b: a >= b, "eq": lambda a, b: a == b,
    "max": lambda a, b: _guard(F.greatest(a, b), a, b), "min": lambda a, b: _guard(F.least(a, b), a, b),
    "sqrt": lambda a: _guard(F.sqrt(F.greatest(a, F.lit(0.0))), a), "ln": lambda a: F.when(a > 0, F.ln(a)), "log10": lambda a: F.when(a > 0, F.log10(a)), "exp": F.exp, "sign": F.signum,
    "pow": lambda a, b: F.pow(a, b), "tanh": F.tanh, "atan": F.atan, "atan2": F.atan2, "sin": F.sin, "cos": F.cos,
    "floor": lambda a: F.floor(a).cast("double"), "ceil": lambda a: F.ceil(a).cast("double"), "round": lambda a: F.bround(a).cast("double"),
    "where": lambda c, a, b: F.when(c, a).when(~c, b), "only": lambda c, x: F.when(c, x), "isnull": lambda a: a.isNull(), "coalesce": lambda a, b: F.coalesce(a, b),
    # on integers, where null is strict: a guard names each side twice, and a chain of n conditions then has 2^n terms
    "and": lambda a, b: a.cast("int").bitwiseAND(b.cast("int")) == 1, "or": lambda a, b: a.cast("int").bitwiseOR(b.cast("int")) == 1, "not": lambda a: ~a,
}
#: Arguments that are conditions.
CONDITIONS = {"where": (0,), "only": (0,), "and": (0, 1), "or": (0, 1), "not": (0,)}
BOOLEAN = {"gt", "ge", "eq", "and", "or", "not", "isnull"}


def _is_bool(x: Node) -> bool:
    return x.kind == "fn" and x.param in BOOLEAN


class Compiler:
    """Adds the nodes' columns to a frame, level by level; windowed nodes and shared ones are columns of their own."""

    def __init__(self, df: DataFrame, keys: list[str], order: list[str], inputs: dict[str, str]):
        self.df, self.inputs = df, inputs
        self.base = Window.partitionBy(*keys, "_valid").orderBy(*order)
        self.keys, self.order = keys, order
        self.names: dict[int, str] = {}
        self.n = 0

    def name(self) -> str:
        self.n += 1
        return f"_t{self.n}"

    def add(self, c: Column) -> Column:
        name = self.name()
        self.df = self.df.withColumn(name, c)
        return F.col(name)

    def run(self, nodes: list[Node]) -> list[Column]:
        uses: dict[int, int] = {}
        order: list[Node] = []

        def visit(x: Node) -> None:
            uses[id(x)] = uses.get(id(x), 0) + 1
            if uses[id(x)] == 1:
                for y in x.args:
                    visit(y)
                order.append(x)

        for x in nodes:
            visit(x)
        level: dict[int, int] = {}
        for x in order:
            level[id(x)] = max([level[id(y)] for y in x.args], default=0) + (x.kind not in ("fn", "col", "lit"))
        done: dict[int, Column] = {}
        for k in range(max(level.values(), default=0) + 1):
            new: dict[str, Column] = {}
            for x in order:
                if level[id(x)] != k:
                    continue
                c = self.column(x, [done[id(y)] for y in x.args])
                if x.kind in ("col", "lit"):
                    done[id(x)] = c
                elif x.kind == "fn" and uses[id(x)] == 1:
                    done[id(x)] = c
                elif x.kind == "fn":
                    if new:
                        self.df, new = self.df.withColumns(new), {}
                    done[id(x)] = self.add(c)
                else:
                    name = self.name()
                    new[name] = c
                    done[id(x)] = F.col(name)
            if new:
                self.df = self.df.withColumns(new)
        return [done[id(x)].cast("double") for x in nodes]

    def column(self, x: Node, a: list[Column]) -> Column:
        k, p, w = x.kind, x.param, self.base
        if k == "lit":
            return F.lit(p)
        if k == "col":
            return F.lit(1.0) if p == "_valid" else F.col(self.inputs[p]).cast("double")
        if k == "fn":
            return FN[p](*[self.typed(c, y, i in CONDITIONS.get(p, ())) for i, (c, y) in enumerate(zip(a, x.args, strict=True))])
        a = [c.cast("double") if _is_bool(y) else c for c, y in zip(a, x.args, strict=True)]
        if k == "lag":
            return F.lag(a[0], p).over(w)
        if k == "cum":
            u = w.rowsBetween(Window.unboundedPreceding, 0)
            if p == "fill":
                return F.last(a[0], ignorenulls=True).over(u)
            return F.when(a[0].isNotNull(), {"sum": F.sum, "max": F.max, "min": F.min}[p](a[0]).over(u))
        if k == "weighted":
            n = len(p)
            u = w.rowsBetween(1 - n, 0)
            zipped = F.zip_with(F.collect_list(a[0]).over(u), F.array(*[F.lit(z) for z in p]), lambda s, t: s * t)
            return F.when(F.count(a[0]).over(u) == n, F.aggregate(zipped, F.lit(0.0), lambda s, t: s + t))
        if k == "scan":
            return self.decayed(a[0], *decay(x))
        kind, n, q = p
        u = w.rowsBetween(1 - n, 0)
        full = F.count(a[0]).over(u) == n
        if len(a) > 1:
            full = full & (F.count(a[1]).over(u) == n)
        if kind == "q":
            c = F.percentile(a[0], F.lit(q)).over(u)
        elif kind == "slope":
            c = F.regr_slope(a[0], self.rank()).over(u)
        elif kind in ("skew", "kurt"):
            f = F.skewness if kind == "skew" else F.kurtosis
            c = F.when(F.var_pop(a[0]).over(u) == 0, 0.0).otherwise(f(a[0]).over(u))
        elif kind == "cov":
            c = F.covar_pop(a[0], a[1]).over(u)
        else:
            c = {"sum": F.sum, "avg": F.avg, "max": F.max, "min": F.min, "var": F.var_pop, "std": F.stddev_pop, "vars": F.var_samp, "stds": F.stddev_samp}[kind](a[0]).over(u)
        return F.when(full, c)

    @staticmethod
    def typed(c: Column, x: Node, condition: bool) -> Column:
        if condition:
            return c if _is_bool(x) else c != 0
        return c.cast("double") if _is_bool(x) else c

    def rank(self) -> Column:
        if 0 not in self.names:
            self.names[0] = self.name()
            self.df = self.df.withColumn(self.names[0], F.row_number().over(self.base).cast("double"))
        return F.col(self.names[0])

    def decayed(self, x: Column, m: int, weight: float, r: float, summed: bool) -> Column:
        if r <= 0:
            return x
        size = max(1, int(BLOCK / -math.log(r)))
        u = self.base.rowsBetween(Window.unboundedPreceding, 0)
        x = self.add(x)
        k = self.add(F.count(x).over(u) - m)
        seed = (F.sum if summed else F.avg)(x).over(u)
        term = self.add(F.when(x.isNotNull(), F.when(k == 0, seed).when(k > 0, F.lit(weight) * x)))
        block = self.add(F.floor(k / size))
        at = k - block * size
        inside = Window.partitionBy(*self.keys, "_valid", block).orderBy(*self.order).rowsBetween(Window.unboundedPreceding, 0)
        # blocks rise with the order, so that an order led by them is the same, and the sort that ``inside`` needs serves what follows
        self.base = Window.partitionBy(*self.keys, "_valid").orderBy(block, *self.order)
        y = self.add(F.when(term.isNotNull(), F.sum(term * F.pow(F.lit(r), -at)).over(inside) * F.pow(F.lit(r), at)))
        before = F.last(F.when(at == size - 1, y), ignorenulls=True).over(self.base.rowsBetween(Window.unboundedPreceding, -1))
        return y + F.when(block > 0, F.coalesce(before, F.lit(0.0)) * F.pow(F.lit(r), at + 1)).otherwise(0.0)


def finite(columns: list[Column]) -> Column:
    ok = F.lit(True)
    for c in columns:
        c = c.cast("double")
        ok = ok & c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))
    return ok


def named(outputs: dict, out: str) -> dict[str, Node | list[Node]]:
    return {out if k == "value" and len(outputs) == 1 else f"{out}_{k}": v for k, v in outputs.items()}


def apply(df: DataFrame, name: str, *, key: str | list[str], order: list[str], inputs: dict[str, str] | None = None, out: str | None = None, bounded: bool = False, native: bool | None = None, **params) -> DataFrame:
    """``df`` with the operator's output column(s).

    key: columns that identify a series; order: columns that order it (add a tiebreaker);
    inputs: operator input -> column, where names differ; out: output name, the operator's in lower case by default."""
    op = catalog.get(name)
    keys = [key] if isinstance(key, str) else list(key)
    wanted = {k: (inputs or {}).get(k, k) for k in catalog.INPUTS[op.kind]}
    outs = named(op.outputs(**params), out or name.lower())
    nodes = flat(outs)
    missing = [c for c in [*wanted.values(), *keys, *order] if c not in df.columns]
    if missing:
        raise ValueError(f"{name} needs columns {missing}")
    if clash := [k for k in outs if k in df.columns]:
        raise ValueError(f"output columns {clash} are there already; give another out")
    if bounded:
        return stepped(df, outs, keys, order, wanted)
    if native is None:
        native = is_native(nodes)
    if not native:
        return kernel(df, outs, keys, order, wanted)
    numeric = {k: F.when(F.lower(F.col(c).cast("string")).isin("buy", "1", "1.0"), 1.0).otherwise(-1.0) if k == "side" and dict(df.dtypes)[c] == "string" else F.col(c).cast("double") for k, c in wanted.items()}
    used = {p for p in _columns(nodes)}
    work = df.withColumn("_valid", finite([numeric[k] for k in wanted]))
    work = work.withColumns({f"_i_{k}": F.when(F.col("_valid"), numeric[k]) for k in used})
    comp = Compiler(work, keys, order, {k: f"_i_{k}" for k in used})
    cols = iter(comp.run(nodes))
    result = {}
    for k, v in outs.items():
        c = F.array(*[next(cols) for _ in v]) if isinstance(v, list) else next(cols)
        result[k] = F.when(F.col("_valid"), c)
    return comp.df.select(*[F.col(f"`{c}`") for c in df.columns], *[c.alias(k) for k, c in result.items()])


def _columns(nodes: list[Node]) -> set[str]:
    seen, todo, out = set(), list(nodes), set()
    while todo:
        x = todo.pop()
        if id(x) not in seen:
            seen.add(id(x))
            todo += x.args
            if x.kind == "col" and x.param != "_valid":
                out.add(x.param)
    return out


def _ddl(df: DataFrame, outs: dict) -> str:
    return ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields] + [f"`{k}` {'array<double>' if isinstance(v, list) else 'double'}" for k, v in outs.items()])


def as_floats(column: pa.ChunkedArray | pa.Array, name: str) -> np.ndarray:
    """float64 with NaN for null; a side given as text is 1 for buy and -1 otherwise."""
    if pa.types.is_string(column.type) or pa.types.is_large_string(column.type):
        return np.array([np.nan if s is None else 1.0 if s.lower() == "buy" else -1.0 for s in column.to_pylist()])
    if pa.types.is_timestamp(column.type):
        return np.array(pc.divide(column.cast(pa.timestamp("us")).cast(pa.int64()), 1000).to_numpy(zero_copy_only=False), float)
    return column.cast(pa.float64()).to_numpy(zero_copy_only=False) if isinstance(column, pa.Array) else column.cast(pa.float64()).to_numpy()


def _results(outs: dict, arrays: list[np.ndarray], ok: np.ndarray) -> list[pa.Array]:
    """Arrow columns; missing rows are null, arrays of missing values too."""
    size, got, it = len(ok), [], iter(arrays)

    def spread(a: np.ndarray) -> np.ndarray:
        full = np.full(size, np.nan)
        full[ok] = a
        return full

    for v in outs.values():
        if isinstance(v, list):
            m = np.stack([spread(next(it)) for _ in v], axis=1) if v else np.empty((size, 0))
            got.append(pa.array([None if np.isnan(r).all() else r for r in m], pa.list_(pa.float64())))
        else:
            a = spread(next(it))
            got.append(pa.array(a, mask=np.isnan(a)))
    return got


def kernel(df: DataFrame, outs: dict, keys: list[str], order: list[str], inputs: dict[str, str]) -> DataFrame:
    nodes = flat(outs)

    def run(table: pa.Table) -> pa.Table:
        table = table.take(pc.sort_indices(table, [(c, "ascending") for c in order]))
        cols = {k: as_floats(table.column(c), k) for k, c in inputs.items()}
        ok = np.isfinite(np.stack(list(cols.values()))).all(axis=0)
        arrays = evaluate(nodes, {k: v[ok] for k, v in cols.items()}, int(ok.sum()))
        for k, a in zip(outs, _results(outs, arrays, ok), strict=True):
            table = table.append_column(k, a)
        return table

    return df.groupBy(*keys).applyInArrow(run, _ddl(df, outs))


def stepped(df: DataFrame, outs: dict, keys: list[str], order: list[str], inputs: dict[str, str]) -> DataFrame:
    nodes = flat(outs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, stepper = object(), None
        for b in batches:
            cols = {k: as_floats(b.column(b.schema.get_field_index(c)), k) for k, c in inputs.items()}
            ok = np.isfinite(np.stack(list(cols.values()))).all(axis=0)
            ids = list(zip(*(b.column(b.schema.get_field_index(k)).to_pylist() for k in keys), strict=True))
            rows = []
            for i in np.flatnonzero(ok):
                if ids[i] != now:
                    now, stepper = ids[i], Stepper(nodes)
                rows.append(stepper.step({k: float(v[i]) for k, v in cols.items()}))
            arrays = list(np.array(rows, float).reshape(-1, len(nodes)).T)
            yield pa.RecordBatch.from_arrays([*b.columns, *_results(outs, arrays, ok)], names=[*b.schema.names, *outs])

    return df.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(run, _ddl(df, outs))
