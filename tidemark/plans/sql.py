"""The same expressions as DuckDB SQL, for checking results with another engine."""

from __future__ import annotations

from ..operators import catalog
from .expr import Node
from .spark import BOOLEAN, CONDITIONS, decay, flat, named

FN = {
    "add": "({0} + {1})", "sub": "({0} - {1})", "mul": "({0} * {1})", "div": "(CASE WHEN {1} != 0 THEN {0} / {1} END)", "abs": "abs({0})",
    "gt": "({0} > {1})", "ge": "({0} >= {1})", "eq": "({0} = {1})", "max": "(CASE WHEN {0} IS NOT NULL AND {1} IS NOT NULL THEN greatest({0}, {1}) END)",
    "min": "(CASE WHEN {0} IS NOT NULL AND {1} IS NOT NULL THEN least({0}, {1}) END)", "sqrt": "(CASE WHEN {0} IS NOT NULL THEN sqrt(greatest({0}, 0.0)) END)", "ln": "(CASE WHEN {0} > 0 THEN ln({0}) END)",
    "log10": "(CASE WHEN {0} > 0 THEN log10({0}) END)", "exp": "exp({0})", "sign": "CAST(sign({0}) AS DOUBLE)", "pow": "pow({0}, {1})", "tanh": "tanh({0})", "atan": "atan({0})",
    "sin": "sin({0})", "cos": "cos({0})", "floor": "floor({0})", "ceil": "ceil({0})", "round": "round_even({0}, 0)",
    "where": "(CASE WHEN {0} THEN {1} WHEN NOT ({0}) THEN {2} END)", "only": "(CASE WHEN {0} THEN {1} END)", "isnull": "({0} IS NULL)", "coalesce": "coalesce({0}, {1})",
    "and": "(CASE WHEN {0} IS NOT NULL AND {1} IS NOT NULL THEN {0} AND {1} END)", "or": "(CASE WHEN {0} IS NOT NULL AND {1} IS NOT NULL THEN {0} OR {1} END)", "not": "(NOT {0})",
}


def query(source: str, name: str, key: str, order: str, inputs: dict[str, str] | None = None, out: str | None = None, digits: int = 6, **params) -> str:
    """SELECT of key, order columns and rounded outputs over a source query with finite inputs."""
    op = catalog.get(name)
    outs = named(op.outputs(**params), out or name.lower())
    nodes = flat(outs)
    cols = {k: (inputs or {}).get(k, k) for k in catalog.INPUTS[op.kind]}
    seq: list[Node] = []
    uses: dict[int, int] = {}

    def visit(x: Node) -> None:
        uses[id(x)] = uses.get(id(x), 0) + 1
        if uses[id(x)] == 1:
            for y in x.args:
                visit(y)
            seq.append(x)

    for x in nodes:
        visit(x)
    ctes = [f"s0 AS (SELECT {key}, {order}, " + ", ".join(f"CAST({c} AS DOUBLE) AS i_{k}" for k, c in cols.items()) + f", CAST(row_number() OVER (PARTITION BY {key} ORDER BY {order}) AS DOUBLE) AS rn FROM ({source}) src)"]
    over = f"PARTITION BY {key} ORDER BY {order}"
    text: dict[int, str] = {}
    n = 0

    def add(expr: str) -> str:
        nonlocal n
        n += 1
        ctes.append(f"s{len(ctes)} AS (SELECT *, {expr} AS t{n} FROM s{len(ctes) - 1})")
        return f"t{n}"

    def number(x: Node) -> str:
        return f"CAST({text[id(x)]} AS DOUBLE)" if x.kind == "fn" and x.param in BOOLEAN else text[id(x)]

    for x in seq:
        k, p = x.kind, x.param
        if k == "lit":
            text[id(x)] = f"CAST({p!r} AS DOUBLE)" if abs(p) != float("inf") else f"CAST('{p}' AS DOUBLE)"
        elif k == "col":
            text[id(x)] = "1.0" if p == "_valid" else f"i_{p}"
        elif k == "fn":
            a = [number(y) if i not in CONDITIONS.get(p, ()) else text[id(y)] if y.kind == "fn" and y.param in BOOLEAN else f"({text[id(y)]} != 0)" for i, y in enumerate(x.args)]
            t = FN[p].format(*a)
            text[id(x)] = add(t) if uses[id(x)] > 1 or len(t) > 400 else t
        else:
            a = [number(y) for y in x.args]
            cum = f"OVER ({over} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
            if k == "lag":
                t = f"lag({a[0]}, {p}) OVER ({over})"
            elif k == "cum":
                t = f"last_value({a[0]} IGNORE NULLS) {cum}" if p == "fill" else f"CASE WHEN {a[0]} IS NOT NULL THEN {p}({a[0]}) {cum} END"
            elif k == "weighted":
                v = add(a[0])
                t = " + ".join(f"lag({v}, {len(p) - 1 - i}) OVER ({over}) * {w!r}" for i, w in enumerate(p))
            elif k == "scan":
                m, weight, r, summed = decay(x)
                if r <= 0:
                    text[id(x)] = a[0]
                    continue
                v = add(a[0])
                c = add(f"CAST(count({v}) {cum} - {m} AS DOUBLE)")
                e = add(f"CASE WHEN {v} IS NULL OR {c} < 0 THEN NULL WHEN {c} = 0 THEN {'sum' if summed else 'avg'}({v}) {cum} ELSE {weight!r} * {v} END")
                z = add(f"{e} * pow(CAST({r!r} AS DOUBLE), -{c})")
                t = f"CASE WHEN {e} IS NOT NULL THEN (sum({z}) {cum}) * pow(CAST({r!r} AS DOUBLE), {c}) END"
            else:
                kind, size, q = p
                w = f"OVER ({over} ROWS BETWEEN {size - 1} PRECEDING AND CURRENT ROW)"
                v = [add(z) for z in a]
                full = " AND ".join(f"count({z}) {w} = {size}" for z in v)
                f = {"sum": "sum({0})", "avg": "avg({0})", "max": "max({0})", "min": "min({0})", "var": "var_pop({0})", "std": "stddev_pop({0})", "vars": "var_samp({0})", "stds": "stddev_samp({0})", "cov": "covar_pop({0}, {1})", "q": f"quantile_cont({{0}}, {q})", "slope": "regr_slope({0}, rn)"}
                if kind in ("skew", "kurt"):
                    mean = add(f"avg({v[0]}) {w}")
                    power = 3 if kind == "skew" else 4
                    terms = " + ".join(f"pow(lag({v[0]}, {i}) OVER ({over}) - {mean}, {power})" for i in range(size))
                    var = add(f"var_pop({v[0]}) {w}")
                    t = f"CASE WHEN {full} THEN CASE WHEN {var} = 0 THEN 0.0 ELSE ({terms}) / {size} / pow({var}, {power / 2}) - {3 if power == 4 else 0} END END"
                else:
                    t = f"CASE WHEN {full} THEN {f[kind].format(*v)} {w} END"
            text[id(x)] = add(t)
    it = iter(nodes)
    sel = []
    for k, v in outs.items():
        if isinstance(v, list):
            sel.append("[" + ", ".join(f"round({number(next(it))}, {digits})" for _ in v) + f"] AS {k}")
        else:
            sel.append(f"round({number(next(it))}, {digits}) + 0.0 AS {k}")
    return "WITH " + ",\n".join(ctes) + f"\nSELECT {key}, {order}, {', '.join(sel)} FROM s{len(ctes) - 1}"
