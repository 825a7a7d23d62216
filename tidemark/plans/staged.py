"""Staged column plans over ordered series.

A ``Plan`` collects column formulas over the bars of each symbol.  Equal formulas are kept once.  A formula that uses other
columns of the plan goes to the stage after theirs, because window functions cannot be nested; all formulas of a stage are
one ``select``, and all share one partitioning and order, so Spark plans one exchange and one sort for the whole plan.
Linear recurrences y[t] = a[t] x[t] + b[t] y[t-1] (moving averages of the exponential family) are columns too; those of
one stage, with those that use them directly, run in a single Arrow-fed kernel per symbol.  ``duck`` writes the same plan as DuckDB SQL, recurrences as
recursive queries.

Missing values are NULL everywhere.  A window of n gives NULL until it holds n values, unless it is ``growing``.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import kernels
from ..functions.machines import Machine, machine


def rounded(x: str) -> str:
    """SQL of x rounded for comparison: to 4 places (of millions or of 10**12, for large values), with a small shift that
    keeps decimal fractions off the rounding boundary, where engines differ by their order of summation."""
    x = f"CAST({x} AS DOUBLE)"
    return f"CASE WHEN abs({x}) < 1e7 THEN round({x} + 1.37e-5, 4) WHEN abs({x}) < 1e10 THEN round({x} * 1e-6 + 1.37e-5, 4) ELSE round({x} * 1e-12 + 1.37e-5, 4) END"


BASE = ("symbol", "trade_date", "open", "high", "low", "close", "volume", "amount", "turnover", "rn")
_NAME = re.compile(r"[A-Za-z_][A-Za-z_0-9]*")
_NUMBER = re.compile(r"-?[0-9.]+(e-?[0-9]+)?")
Formula = str | tuple[str, str]


@dataclass(frozen=True)
class Recurrence:
    """seed: ``first`` (the first value), ``sma`` (mean of the first n values, nothing before), or a number that stands
    before the first value.  A missing x keeps the last y.  a and b are numbers or columns."""

    x: str
    a: float | str
    b: float | str
    seed: str | float = "first"
    n: int = 1

    def inputs(self) -> list[str]:
        return [v for v in (self.x, self.a, self.b) if isinstance(v, str)]


@dataclass(frozen=True)
class Sliding:
    """An order statistic of x over the last n bars, from a window that is kept sorted: ``median`` of the values that are
    there, or ``spread``, their mean distance from the column ``centre``, missing unless all n are there.  sql is the same as a
    window for DuckDB."""

    what: str
    x: str
    n: int
    centre: str
    sql: str

    def inputs(self) -> list[str]:
        return [v for v in (self.x, self.centre) if v]


@dataclass
class Kernel:
    names: tuple[str, ...]
    inputs: tuple[str, ...]
    fn: Callable
    sql: Machine | None = None


@dataclass
class Stage:
    """Columns, all made at once, and then recurrences and kernels, which may use these columns and each other in the
    order in which they were added."""

    columns: dict[str, Formula] = field(default_factory=dict)
    steps: dict[str, Recurrence | Sliding | Kernel] = field(default_factory=dict)


class Plan:
    def __init__(self, key: str = "symbol", order: str = "trade_date", base: Iterable[str] = BASE):
        self.key, self.order = key, order
        self.level = dict.fromkeys(base, 0)
        self.depth: dict[str, int] = {}
        self.stages: list[Stage] = []
        self.made: dict = {}
        self.outputs: dict[str, str] = {}
        self.has_kernel, self.has_sql = False, True

    # --- building

    def _level(self, *formulas: str) -> int:
        return max([self.level[w] for f in formulas for w in _NAME.findall(f) if w in self.level], default=0) + 1

    def _stage(self, level: int) -> Stage:
        while len(self.stages) < level:
            self.stages.append(Stage())
        return self.stages[level - 1]

    def c(self, formula: Formula) -> str:
        """The column of a formula (a pair: for Spark and for DuckDB, where they differ)."""
        if isinstance(formula, str) and formula in self.level:
            return formula
        if formula not in self.made:
            name = f"x{len(self.made)}_"
            level = self._level(*([formula] if isinstance(formula, str) else formula))
            self._stage(level).columns[name] = formula
            self.level[name] = level
            self.made[formula] = name
        return self.made[formula]

    def _step(self, inputs: Iterable[str]) -> tuple[Stage, int, int]:
        """The stage of a recurrence or kernel, its number, and how many steps of that stage it waits for."""
        level = max([1, *(self.level[i] for i in inputs)])
        return self._stage(level), level, max([0, *(self.depth.get(i, 0) for i in inputs if self.level[i] == level)]) + 1

    def recur(self, x: str, a: str | float, b: str | float, seed: str | float = "first", n: int = 1) -> str:
        factor = lambda v: float(v) if isinstance(v, float) or _NUMBER.fullmatch(v) else self.c(f"CAST({v} AS DOUBLE)")
        r = Recurrence(self.c(x), factor(a), factor(b), seed, n)
        return self._added(r)

    def _added(self, step: Recurrence | Sliding) -> str:
        if step not in self.made:
            name = f"x{len(self.made)}_"
            stage, self.level[name], self.depth[name] = self._step(step.inputs())
            stage.steps[name] = step
            self.made[step] = name
        return self.made[step]

    def sliding_median(self, x: str, n: int) -> str:
        x = self.c(f"CAST({x} AS DOUBLE)")
        return self._added(Sliding("median", x, n, "", self.over(f"quantile_cont({x}, 0.5)", self.frame(1 - n))))

    def sliding_spread(self, x: str, centre: str, n: int) -> str:
        x, at = self.c(f"CAST({x} AS DOUBLE)"), self.frame(1 - n)
        total = f"list_sum(list_transform({self.over(f'list({x})', at)}, lambda v: abs(v - {centre})))"
        return self._added(Sliding("spread", x, n, self.c(centre), f"CASE WHEN {self.over(f'count({x})', at)} = {n} THEN {total} / {n} END"))

    def kernel(self, fn: Callable, inputs: Iterable[str], outputs: int, *args) -> list[str]:
        """Columns made by fn(*arrays, *args) -> arrays, for state machines that no window expresses; their SQL form is the
        machine of fn's name, where there is one."""
        inputs = tuple(self.c(i) for i in inputs)
        mark = (fn.__name__, inputs, args)
        if mark not in self.made:
            names = tuple(f"x{len(self.made)}_{i}_" for i in range(outputs))
            stage, level, depth = self._step(inputs)
            back = lambda x, k: self.over(f"lag({x}, {k})") if k else x
            stage.steps[names[0]] = Kernel(names, inputs, lambda *v: fn(*v, *args), machine(fn.__name__, args, back))
            self.level |= dict.fromkeys(names, level)
            self.depth |= dict.fromkeys(names, depth)
            self.made[mark] = list(names)
            self.has_kernel = True
            self.has_sql &= stage.steps[names[0]].sql is not None
        return self.made[mark]

    def over(self, function: str, frame: str = "") -> str:
        return f"{function} OVER (PARTITION BY {self.key} ORDER BY {self.order}{' ' + frame if frame else ''})"

    def frame(self, lo: int | None, hi: int | None = 0) -> str:
        place = lambda k: "UNBOUNDED PRECEDING" if k is None else "CURRENT ROW" if k == 0 else f"{-k} PRECEDING" if k < 0 else f"{k} FOLLOWING"
        return f"ROWS BETWEEN {place(lo)} AND {'UNBOUNDED FOLLOWING' if hi is None else place(hi)}"

    def window(self, function: str, x: str, n: int, growing: bool = False, end: int = 0, more: str = "") -> str:
        """function(x{more}) over the n bars up to ``end``."""
        x = self.c(x)
        at = self.frame(end - n + 1, end)
        value = self.over(f"{function}({x}{more})", at)
        return self.c(value if growing else f"CASE WHEN {self.over(f'count({x})', at)} = {n} THEN {value} END")

    def avg(self, x, n, **k): return self.window("avg", x, n, **k)  # noqa: E704
    def sum(self, x, n, **k): return self.window("sum", x, n, **k)  # noqa: E704
    def max(self, x, n, **k): return self.window("max", x, n, **k)  # noqa: E704
    def min(self, x, n, **k): return self.window("min", x, n, **k)  # noqa: E704
    def sd(self, x, n, **k): return self.window("stddev_pop", x, n, **k)  # noqa: E704

    def lag(self, x: str, k: int = 1) -> str:
        return self.c(self.over(f"{'lag' if k >= 0 else 'lead'}({self.c(x)}, {abs(k)})")) if k else self.c(x)

    def cum(self, x: str, function: str = "sum") -> str:
        return self.c(self.over(f"{function}({self.c(x)})", self.frame(None)))

    def gate(self, x: str, n: int) -> str:
        return self.c(f"CASE WHEN rn >= {n} THEN {self.c(x)} END")

    def ratio(self, x: str, y: str) -> str:
        return self.c(f"({x}) / nullif({y}, 0)")

    def dot(self, x: str, weights: Iterable[float]) -> str:
        """Sum of weights[k] times x of k bars ago; NULL until all are there."""
        parts = [f"{w!r} * {self.lag(x, k)}" for k, w in enumerate(weights)]
        return self.c(" + ".join(parts))

    def ema(self, x: str, n: int, seed: str | float = "sma") -> str:
        return self.smooth(x, 2 / (n + 1), seed, n)

    def rma(self, x: str, n: int, seed: str | float = "sma") -> str:
        return self.smooth(x, 1 / n, seed, n)

    def smooth(self, x: str, alpha: float, seed: str | float, n: int) -> str:
        return self.recur(x, repr(alpha), repr(1 - alpha), seed, n)

    def out(self, **named: str) -> None:
        for name, formula in named.items():
            self.outputs[name] = self.c(formula)

    # --- Spark

    def spark(self, bars: DataFrame, compare: bool = False, keep: bool = False) -> DataFrame:
        """The outputs of every bar, with key and order (all base columns if keep); ``rounded`` if compare."""
        df = bars
        if "rn" not in df.columns:
            df = df.withColumn("rn", F.expr(self.over("row_number()")))
        always = {self.key, self.order, *(bars.columns if keep else ())}
        for stage, used in zip(self.stages, self._used(), strict=True):
            if stage.columns:
                df = df.withColumns({n: F.expr(f if isinstance(f, str) else f[0]) for n, f in stage.columns.items()})
            if stage.steps:
                df = self._run(df.select(*[c for c in df.columns if c in used | always]), stage)
        value = (lambda c: F.expr(rounded(c))) if compare else F.col
        head = [c for c in bars.columns] if keep else [self.key, self.order]
        return df.select(*head, *[value(c).alias(n) for n, c in self.outputs.items()])

    def _used(self) -> list[set[str]]:
        """Of each stage, the names that its steps, the stages after it or the outputs use: what its kernel must be sent, as
        columns are not pruned through one."""
        used, found = set(self.outputs.values()), []
        for stage in reversed(self.stages):
            for s in stage.steps.values():
                used |= set(s.inputs if isinstance(s, Kernel) else s.inputs())
            found.append(set(used))
            for f in stage.columns.values():
                used |= set(_NAME.findall(f if isinstance(f, str) else f[0]))
        return found[::-1]

    def _run(self, df: DataFrame, stage: Stage) -> DataFrame:
        """One Arrow pass a symbol; the columns that no step uses go through as they are."""
        order, steps = self.order, dict(stage.steps)
        new = [n for name, s in steps.items() for n in (s.names if isinstance(s, Kernel) else (name,))]
        schema = T.StructType([*df.schema, *(T.StructField(n, T.DoubleType()) for n in new)])

        def run(rows: pa.Table) -> pa.Table:
            rows = rows.take(pc.sort_indices(rows, [(order, "ascending")]))
            have: dict[str, np.ndarray] = {}

            def get(v: float | str) -> float | np.ndarray:
                if not isinstance(v, str):
                    return v
                if v not in have:
                    have[v] = rows.column(v).cast(pa.float64()).to_numpy()
                return have[v]

            for name, s in steps.items():
                if isinstance(s, Kernel):
                    have |= dict(zip(s.names, s.fn(*map(get, s.inputs)), strict=True))
                elif isinstance(s, Sliding):
                    have[name] = kernels.sliding_median(get(s.x), s.n) if s.what == "median" else kernels.sliding_spread(get(s.x), get(s.centre), s.n)
                else:
                    have[name] = recurrence(get(s.x), get(s.a), get(s.b), s.seed, s.n)
            for n in new:
                rows = rows.append_column(n, pa.array(have[n], pa.float64(), from_pandas=True))
            return rows

        return df.groupBy(self.key).applyInArrow(run, schema)

    # --- DuckDB

    def duck(self, base: str, compare: bool = True) -> str:
        """The same as a query over ``base``, a query that gives the base columns without rn."""
        if not self.has_sql:
            raise ValueError("a kernel of this plan has no SQL form")
        ctes = [f"s0 AS (SELECT *, {self.over('row_number()')} AS rn FROM ({base}))"]
        last = 0
        for stage in self.stages:
            if stage.columns:
                ctes.append(f"s{last + 1} AS (SELECT *, {', '.join(f'{f if isinstance(f, str) else f[1]} AS {n}' for n, f in stage.columns.items())} FROM s{last})")
                last += 1
            for depth in sorted({self.depth[n] for n in stage.steps}):
                here = {n: r for n, r in stage.steps.items() if self.depth[n] == depth}
                if slid := {n: r.sql for n, r in here.items() if isinstance(r, Sliding)}:
                    ctes.append(f"s{last + 1} AS (SELECT *, {', '.join(f'{f} AS {n}' for n, f in slid.items())} FROM s{last})")
                    last += 1
                for names in self._looked_back(here):
                    ctes.append(f"s{last + 1} AS (SELECT *, {', '.join(names)} FROM s{last})")
                    last += 1
                if recurrences := {n: r for n, r in here.items() if n not in slid}:
                    ctes += self._recursive(recurrences, last)
                    last += 1
        value = rounded if compare else str
        return f"WITH RECURSIVE {', '.join(ctes)} SELECT {self.key}, {self.order}, {', '.join(f'{value(c)} AS {n}' for n, c in self.outputs.items())} FROM s{last}"

    @staticmethod
    def _looked_back(steps: dict) -> list[list[str]]:
        """By rounds, the columns that machines need before they run."""
        rounds: dict[int, list[str]] = {}
        for name, k in steps.items():
            if isinstance(k, Kernel) and k.sql:
                own = {c: f"{name}{c}" for some in k.sql.before for c in some}
                for i, some in enumerate(k.sql.before):
                    rounds.setdefault(i, []).extend(f"{f.format(*k.inputs, **own)} AS {own[c]}" for c, f in some.items())
        return [rounds[i] for i in sorted(rounds)]

    @staticmethod
    def _machine(name: str, k: Kernel) -> tuple[list[str], list[str], list[str]]:
        """Names of the states, their values at the first bar and at a later one."""
        own = dict(zip(k.sql.states, [*k.names, *[f"{name}{s}" for s in list(k.sql.states)[len(k.names) :]]], strict=True))
        inputs, ahead = [f"t.{i}" for i in k.inputs], {c: f"t.{name}{c}" for some in k.sql.before for c in some}
        start = ahead | {s: f"CAST({value} AS DOUBLE)" for s, (value, _) in k.sql.states.items()}
        go = ahead | {s: f"r.{n}" for s, n in own.items()}
        first = [f"CAST({f.format(*inputs, **start)} AS DOUBLE) AS {own[s]}" for s, (_, f) in k.sql.states.items()]
        return list(own.values()), first, [f"CAST({f.format(*inputs, **go)} AS DOUBLE)" for _, f in k.sql.states.values()]

    def _recursive(self, recurrences: dict[str, Recurrence | Kernel], last: int) -> list[str]:
        first, step, names, outputs = [], [], [], []
        for name, r in recurrences.items():
            if isinstance(r, Kernel):
                for have, new in zip((names, first, step), self._machine(name, r), strict=True):
                    have += new
                outputs += r.names
                continue
            outputs.append(name)
            x = f"t.{r.x}"
            names += [name, f"{name}k", f"{name}s"]
            start = lambda y: f"CASE WHEN {x} IS NOT NULL THEN {y} END"
            a, b = (f"t.{v}" if isinstance(v, str) else f"{v!r}::DOUBLE" for v in (r.a, r.b))
            y0 = start(x) if r.seed == "first" else start(f"CASE WHEN {r.n} = 1 THEN {x} END") if r.seed == "sma" else f"CASE WHEN {x} IS NULL THEN {float(r.seed)!r} ELSE {a} * {x} + {b} * {float(r.seed)!r} END"
            first += [f"CAST({y0} AS DOUBLE) AS {name}", f"CASE WHEN {x} IS NULL THEN 0 ELSE 1 END AS {name}k", f"CAST(coalesce({x}, 0) AS DOUBLE) AS {name}s"]
            go = f"{a} * {x} + {b} * r.{name}"
            if r.seed == "sma":
                y = f"CASE WHEN {x} IS NULL THEN r.{name} WHEN r.{name}k + 1 < {r.n} THEN NULL WHEN r.{name}k + 1 = {r.n} THEN (r.{name}s + {x}) / {r.n} ELSE {go} END"
            elif r.seed == "first":
                y = f"CASE WHEN {x} IS NULL THEN r.{name} WHEN r.{name}k = 0 THEN {x} ELSE {go} END"
            else:
                y = f"CASE WHEN {x} IS NULL THEN r.{name} ELSE {go} END"
            step += [y, f"r.{name}k + CASE WHEN {x} IS NULL THEN 0 ELSE 1 END", f"r.{name}s + coalesce({x}, 0)"]
        r = f"r{last + 1}"
        recursive = f"{r}(k_, rn_, {', '.join(names)}) AS (SELECT t.{self.key}, t.rn, {', '.join(first)} FROM s{last} t WHERE t.rn = 1 UNION ALL SELECT t.{self.key}, t.rn, {', '.join(step)} FROM {r} r JOIN s{last} t ON t.{self.key} = r.k_ AND t.rn = r.rn_ + 1)"
        return [recursive, f"s{last + 1} AS (SELECT t.*, {', '.join(f'r.{n}' for n in outputs)} FROM s{last} t JOIN {r} r ON t.{self.key} = r.k_ AND t.rn = r.rn_)"]


BLOCK = 128
_scans: dict[float, tuple[np.ndarray, np.ndarray]] = {}


def scan(x: np.ndarray, b: float, y: float) -> np.ndarray:
    """y[t] = x[t] + b y[t-1] for a constant b, from y before the first x: a triangular product a block and one carry each."""
    if b not in _scans:
        k = np.arange(BLOCK)
        apart = k[:, None] - k[None, :]
        _scans[b] = np.where(apart >= 0, float(b) ** np.maximum(apart, 0), 0.0).T, float(b) ** (k + 1)
    within, reach = _scans[b]
    n = len(x)
    inside = np.append(x, np.zeros(-n % BLOCK)).reshape(-1, BLOCK) @ within
    before = np.empty(len(inside))
    for i, end in enumerate(inside[:, -1].tolist()):
        before[i] = y
        y = end + reach[-1] * y
    return (inside + before[:, None] * reach).ravel()[:n]


def recurrence(x: np.ndarray, a: float | np.ndarray, b: float | np.ndarray, seed: str | float, n: int) -> np.ndarray:
    return recurrence_on(x, a, b, seed, n, [np.nan, 0.0, 0.0])[0]


def recurrence_on(x: np.ndarray, a: float | np.ndarray, b: float | np.ndarray, seed: str | float, n: int, carry: list[float]) -> tuple[np.ndarray, list[float]]:
    """Values from a carry on, and the carry after them: the last y, how many of the values that the seed is made of were
    there, and their sum."""
    there = x == x
    v = x[there]
    at = lambda c: c[there] if isinstance(c, np.ndarray) else c
    a, b = at(a), at(b)
    head = n if seed == "sma" else 1 if seed == "first" else 0
    last, seen, total = carry
    before = last if seen or isinstance(seed, str) else float(seed)
    need = head - int(min(seen, head))
    y = np.full(len(v), np.nan)
    if len(v) >= need and len(v):
        if need:
            last = y[need - 1] = (total + v[:need].sum()) / head
        elif not seen:
            last = float(seed)
        tail = (a[need:] if isinstance(a, np.ndarray) else a) * v[need:]
        if isinstance(b, float):
            y[need:] = scan(tail, b, last)
        else:
            for t, (p, q) in enumerate(zip(tail.tolist(), b[need:].tolist(), strict=True), need):
                last = y[t] = p + q * last
        last = float(y[-1])
    #: A missing x shows the last y, or what stands before the first.
    return np.append(before, y)[np.cumsum(there)], [last, seen + len(v), total + float(v[:need].sum())]
