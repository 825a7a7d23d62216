"""Plans that go on from saved state, bar by bar.

``Resumable`` compiles a ``Plan`` to a bounded state of one symbol: its last bars, with the columns of the plan that windows
look back at (as many bars as the longest window), the running sums, and of each recurrence the last value and what its seed
still needs.  ``advance`` takes a state and the bars that follow and gives their outputs and the next state.  The formulas are
the plan's own, run by DuckDB on these few rows, and the recurrences run in the same kernel as in a batch, from their carry.
Plans that look ahead, or over a whole series, and those with state machines cannot go on from a bounded state and are refused.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

from .staged import Plan, Recurrence, recurrence_on

_WINDOW = re.compile(r"(\w+)\(([^()]*(?:\([^()]*\)[^()]*)*)\) OVER \(PARTITION BY symbol ORDER BY trade_date([^)]*)\)")
_FRAME = re.compile(r" ROWS BETWEEN (UNBOUNDED|\d+) PRECEDING AND (?:CURRENT ROW|\d+ PRECEDING)")
_NAME = re.compile(r"[A-Za-z_][A-Za-z_0-9]*")
INPUTS = ("open", "high", "low", "close", "volume", "amount", "turnover")


@dataclass
class State:
    """Plain numbers: ``tail`` is row by row; NaN is missing."""

    n: int
    sums: list[float]
    carries: list[float]
    tail: list[float]


class Resumable:
    def __init__(self, plan: Plan):
        if plan.has_kernel:
            raise ValueError("a plan with state machines cannot be resumed")
        self.plan, self.reach = plan, 1
        self.history: list[str] = []
        self.sums: list[str] = []
        self.stages: list[list[tuple[str, str]]] = []
        self.slid: dict[str, str] = {}
        for stage in plan.stages:
            self.stages.append([(name, self._compiled(f if isinstance(f, str) else f[1])) for name, f in stage.columns.items()])
            self.slid |= {name: self._compiled(s.sql) for name, s in stage.steps.items() if not isinstance(s, Recurrence)}
        self.steps = [name for stage in plan.stages for name, s in stage.steps.items() if isinstance(s, Recurrence)]
        self._db = self._kinds = None

    def _compiled(self, formula: str) -> str:
        found = list(_WINDOW.finditer(formula))
        if len(found) != formula.count(" OVER "):
            raise ValueError(f"not by symbol and date alone: {formula}")

        def one(m: re.Match) -> str:
            fn, args, frame = m.groups()
            if fn == "lag":
                self.reach = max(self.reach, int(args.rsplit(",", 1)[1]))
            elif fn == "row_number" and not frame:
                return "rn"
            else:
                if not (at := _FRAME.fullmatch(frame)):
                    raise ValueError(f"looks ahead or has no bound: {formula}")
                if at[1] == "UNBOUNDED":
                    if fn != "sum":
                        raise ValueError(f"only sums run from the first bar: {formula}")
                    if args not in self.sums:
                        self.sums.append(args)
                    return f"sum(sum{self.sums.index(args)}_) OVER (ORDER BY trade_date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
                self.reach = max(self.reach, int(at[1]))
            self.history += [w for w in _NAME.findall(args) if (w in self.plan.level or w in INPUTS) and w != "rn" and w not in self.history]
            return m[0].replace("PARTITION BY symbol ", "")

        return _WINDOW.sub(one, formula)

    def start(self) -> State:
        return State(0, [np.nan] * len(self.sums), [np.nan, 0.0, 0.0] * len(self.steps), [])

    def __getstate__(self):
        return self.__dict__ | {"_db": None, "_kinds": None}

    def _table(self, columns: dict[str, np.ndarray]) -> pa.Table:
        return pa.table({k: pa.array(v, pa.float64(), from_pandas=True) if v.dtype.kind == "f" else pa.array(v) for k, v in columns.items()})

    def _run(self, columns: dict[str, np.ndarray], formulas: list[tuple[str, str]]) -> dict[str, pa.ChunkedArray]:
        if self._db is None:
            import duckdb

            self._db, self._kinds = duckdb.connect(config={"threads": 1, "temp_directory": ""}), {}
        flags = [k for k, kind in self._kinds.items() if kind == "b" and k in columns]
        self._db.register("t", self._table(columns))
        base = f"(SELECT * REPLACE ({', '.join(f'CAST({k} AS BOOLEAN) AS {k}' for k in flags)}) FROM t)" if flags else "t"
        out = self._db.sql(f"SELECT {', '.join(f'{f} AS {n}' for n, f in formulas)} FROM {base} ORDER BY rn").to_arrow_table()
        self._db.unregister("t")
        self._kinds |= {n: "b" if pa.types.is_boolean(out.schema.field(n).type) else "f" for n in out.column_names}
        return {n: out.column(n).cast(pa.float64()) for n in out.column_names}

    def advance(self, state: State, new: dict[str, np.ndarray]) -> tuple[dict[str, np.ndarray], State]:
        """The outputs of the new bars (``INPUTS`` as arrays of doubles, in order), and the state after them."""
        m, width = len(new["close"]), len(self.history)
        if m == 0:
            return {name: np.zeros(0) for name in self.plan.outputs}, state
        tail = np.array(state.tail, float).reshape(-1, width) if width else np.zeros((min(state.n, self.reach), 0))
        k = len(tail)
        old = {name: tail[:, i] for i, name in enumerate(self.history)}
        nothing = np.full(k, np.nan)
        columns = {c: np.concatenate([old.get(c, nothing), np.asarray(new[c], float)]) for c in INPUTS}
        columns["rn"] = np.arange(state.n - k + 1, state.n + m + 1)
        columns["trade_date"] = columns["rn"]
        totals, carries, at = list(state.sums), list(state.carries), 0
        for stage, formulas in zip(self.plan.stages, self.stages, strict=True):
            if formulas:
                text = " ".join(f for _, f in formulas)
                for i, name in enumerate(self.sums):
                    if f"sum{i}_" in text:
                        run = np.concatenate([nothing, columns[name][k:]])
                        if k:
                            run[k - 1] = totals[i]
                        columns[f"sum{i}_"] = run
                for name, got in self._run(columns, formulas).items():
                    columns[name] = np.concatenate([old.get(name, nothing), got.to_numpy()[k:]])
            for name, r in stage.steps.items():
                if name in self.slid:
                    got = self._run(columns, [(name, self.slid[name])])[name]
                    columns[name] = np.concatenate([old.get(name, nothing), got.to_numpy()[k:]])
                    continue
                get = lambda v: columns[v][k:].astype(float) if isinstance(v, str) else v
                y, carries[3 * at : 3 * at + 3] = recurrence_on(get(r.x), get(r.a), get(r.b), r.seed, r.n, carries[3 * at : 3 * at + 3])
                columns[name] = np.concatenate([old.get(name, nothing), y])
                at += 1
        for i, name in enumerate(self.sums):
            part = columns[name][k:]
            if (part == part).any():
                totals[i] = np.nansum(part) + (totals[i] if totals[i] == totals[i] else 0.0)
        kept = np.column_stack([columns[h][-self.reach :].astype(float) for h in self.history]).ravel().tolist() if width else []
        return {name: columns[c][k:].astype(float) for name, c in self.plan.outputs.items()}, State(state.n + m, totals, carries, kept)
