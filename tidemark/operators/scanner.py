"""Market scan: a predicate tree over the last bar of every symbol, scored and sorted.

A node is a dict: ``{"op": "AND" | "OR", "children": [...]}``, ``{"op": "COMPARE", "indicator", "params", "compare": ">" | "<" |
">=" | "<=" | "==" | "!=", "value"}`` or ``{"op": "CROSS", "indicator", "params", "value", "compare": "above" | "below"}``.  The
tree is compiled once; equal indicators share their columns; only the last bar of each symbol is kept.  COMPARE looks at an
indicator's first output.  CROSS is true where output 0 crosses output 1, or the only output crosses ``value``.  Equality and a
crossed value score 1.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.staged import Plan
from .indicators import REGISTRY, add

TOLERANCE = 1e-6
COMPARISONS = {">": ">", "gt": ">", "<": "<", "lt": "<", ">=": ">=", "gte": ">=", "<=": "<=", "lte": "<="}


def _outputs(p: Plan, node: dict) -> list[str]:
    params = node.get("params") or {}
    name = node["indicator"]
    if name in ("open", "high", "low", "close", "volume", "amount", "turnover"):
        return [name]
    spec = REGISTRY.get(name)
    if spec is None:
        raise ValueError(f"unknown indicator {name!r}")
    before = dict(p.outputs)
    named = list(add(p, name, **params).values())
    p.outputs = before
    return named


def compile_node(p: Plan, node: dict) -> tuple[str, str]:
    """Formulas of a node's truth (1 or 0) and score."""
    op = node["op"].upper()
    if op in ("AND", "OR"):
        parts = [compile_node(p, c) for c in node["children"]]
        if not parts:
            return p.c("0"), p.c("0.0")
        hit, score = parts[0]
        for h, s in parts[1:]:
            if op == "AND":
                hit, score = p.c(f"CASE WHEN {hit} = 1 AND {h} = 1 THEN 1 ELSE 0 END"), p.c(f"greatest(least({score}, {s}), 1) * ({score} + {s}) / 20")
            else:
                score = p.c(f"CASE WHEN {hit} = 1 AND {h} = 1 THEN greatest({score}, {s}) WHEN {hit} = 1 THEN {score} ELSE {s} END")
                hit = p.c(f"CASE WHEN {hit} = 1 OR {h} = 1 THEN 1 ELSE 0 END")
        return hit, score
    lines = _outputs(p, node)
    value = float(node.get("value") or 0.0)
    t = f"{value!r}e0"
    way = str(node.get("compare") or "above").lower()
    if op == "COMPARE":
        x = lines[0]
        near = f"abs({x} - {t}) < {TOLERANCE!r}"
        if way in ("==", "=", "eq", "!=", "ne"):
            return p.c(f"CASE WHEN {near if way in ('==', '=', 'eq') else f'NOT ({near})'} THEN 1 ELSE 0 END"), p.c("1.0")
        if way not in COMPARISONS:
            raise ValueError(f"unknown comparison {way!r}")
        return p.c(f"CASE WHEN {x} {COMPARISONS[way]} {t} THEN 1 ELSE 0 END"), p.c(f"abs({x} - {t}) / {max(value, TOLERANCE)!r}e0")
    if op == "CROSS":
        if way not in ("above", "up", "below", "down"):
            raise ValueError(f"unknown direction {way!r}")
        x, y = (lines[0], lines[1]) if len(lines) > 1 else (lines[0], p.c(f"{lines[0]} * 0 + {t}"))
        before, now = ("<=", ">") if way in ("above", "up") else (">=", "<")
        return p.c(f"CASE WHEN {p.lag(x)} {before} {p.lag(y)} AND {x} {now} {y} THEN 1 ELSE 0 END"), p.c(f"abs({x} - {y}) / greatest({y}, {TOLERANCE!r})" if len(lines) > 1 else "1.0")
    raise ValueError(f"unknown node {op!r}")


def plan(tree: dict) -> Plan:
    p = Plan()
    hit, score = compile_node(p, tree)
    p.out(hit=hit, score=score, close="close", last=p.c(f"CASE WHEN {p.over('row_number()', '').replace(f'ORDER BY {p.order}', f'ORDER BY {p.order} DESC')} = 1 THEN 1 ELSE 0 END"))
    return p


def _plain(v: float) -> str:
    return str(int(v)) if float(v).is_integer() else repr(float(v))


def signals(node: dict) -> list[str]:
    """What the leaves of a tree ask for, in words, in the order of the tree; a comparison without a value says nothing."""
    op = node["op"].upper()
    if op in ("AND", "OR"):
        return [s for c in node["children"] for s in signals(c)]
    of = f"{node['indicator']}({','.join(f'{k}={_plain(v)}' for k, v in sorted((node.get('params') or {}).items()))})"
    if op == "CROSS":
        return [f"CROSS({of}, {node.get('compare') or 'above'})"]
    return [f"{of} {node['compare']} {_plain(node['value'])}"] if node.get("compare") and node.get("value") is not None else []


def scan(bars: DataFrame, tree: dict) -> DataFrame:
    """Matching symbols with their score and the conditions that were asked for, best first."""
    found = plan(tree).spark(bars).filter("last = 1 AND hit = 1")
    said = F.array(*[F.lit(s) for s in signals(tree)]).cast("array<string>")
    return found.select("symbol", "trade_date", "close", F.col("score").cast("double").alias("score"), said.alias("signals")).orderBy(F.desc("score"), "symbol")


def scan_sql(base: str, tree: dict) -> str:
    return f"SELECT symbol, trade_date, close, CAST(score AS DOUBLE) AS score FROM ({plan(tree).duck(base, compare=False)}) WHERE last = 1 AND hit = 1"
