"""State machines as DuckDB SQL, for comparison with the kernels of the same names.

A machine is states that go from bar to bar: name -> (value before the first bar, value after a bar).  In the latter ``{0}``,
``{1}``, ... are the kernel's inputs at the bar and ``{name}`` is a state before it.  The first states are the kernel's
outputs.  ``before`` are columns, by rounds, that need windows and no state; they are used as ``{name}`` too.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from .kernels import QUADRATURE


@dataclass(frozen=True)
class Machine:
    states: dict[str, tuple[str, str]]
    before: list[dict[str, str]] = field(default_factory=list)


def position(most) -> Machine:
    leave = f"{{inside}} = 1 AND ({{1}} > 0 OR {most} > 0 AND {{age}} + 1 >= {most} OR {{3}} IS NOT NULL AND {{2}} < {{entry}} - {{3}})"
    enter = "{inside} = 0 AND {0} > 0"
    return Machine({
        "out": ("0", f"CASE WHEN {leave} THEN -1 WHEN {enter} THEN 1 ELSE 0 END"),
        "inside": ("0", f"CASE WHEN {leave} THEN 0 WHEN {enter} THEN 1 ELSE {{inside}} END"),
        "entry": ("0", f"CASE WHEN {enter} THEN {{2}} ELSE {{entry}} END"),
        "age": ("0", f"CASE WHEN {enter} THEN 0 ELSE {{age}} + 1 END"),
    })


def rotation() -> Machine:
    leave = "({inside} = 1 OR {0} > 0) AND {1} > 0"
    return Machine({
        "out": ("0", f"CASE WHEN {leave} THEN -1 WHEN {{inside}} = 0 AND {{0}} > 0 THEN 1 ELSE 0 END"),
        "inside": ("0", f"CASE WHEN {leave} THEN 0 WHEN {{0}} > 0 THEN 1 ELSE {{inside}} END"),
    })


def cool_down(n) -> Machine:
    keep = "coalesce({0}, 0) > 0.5 AND {wait} <= 0"
    return Machine({"out": ("0", f"CASE WHEN {keep} THEN 1 ELSE 0 END"), "wait": ("0", f"CASE WHEN {keep} THEN {n - 1} ELSE {{wait}} - 1 END")})


def supertrend(multiplier) -> Machine:
    """Inputs: high, low, close, true range."""
    above, below = f"(({{0}} + {{1}}) / 2 + {multiplier} * {{3}})", f"(({{0}} + {{1}}) / 2 - {multiplier} * {{3}})"
    ceiling = f"CASE WHEN {{3}} IS NULL THEN {{ceiling}} WHEN {{ceiling}} IS NULL OR {above} < {{ceiling}} OR {{last}} > {{ceiling}} THEN {above} ELSE {{ceiling}} END"
    floor = f"CASE WHEN {{3}} IS NULL THEN {{floor}} WHEN {{floor}} IS NULL OR {below} > {{floor}} OR {{last}} < {{floor}} THEN {below} ELSE {{floor}} END"
    rising = f"CASE WHEN {{3}} IS NULL THEN {{up}} = 1 WHEN {{ceiling}} IS NULL THEN {{2}} > ({{0}} + {{1}}) / 2 WHEN {{up}} = 1 THEN {{2}} >= {floor} ELSE {{2}} > {ceiling} END"
    return Machine({
        "out": ("NULL", f"CASE WHEN {{3}} IS NULL THEN NULL WHEN {rising} THEN {floor} ELSE {ceiling} END"),
        "ceiling": ("NULL", ceiling), "floor": ("NULL", floor), "up": ("1", f"CASE WHEN {rising} THEN 1 ELSE 0 END"), "last": ("NULL", "{2}"),
    })


def psar(step, most) -> Machine:
    """Inputs: high, low."""
    extreme, factor = "greatest({extreme}, {0})", f"CASE WHEN {{0}} > {{extreme}} THEN least({{factor}} + {step}, {most}) ELSE {{factor}} END"
    return Machine({
        "out": ("NULL", "{stop}"),
        "stop": ("NULL", f"CASE WHEN {{stop}} IS NULL THEN {{1}} ELSE least({{stop}} + ({factor}) * ({extreme} - {{stop}}), {{low}}, {{1}}) END"),
        "extreme": ("NULL", f"CASE WHEN {{extreme}} IS NULL THEN {{0}} ELSE {extreme} END"), "factor": (repr(step), factor), "low": ("NULL", "{1}"),
    })


def jma(alpha) -> Machine:
    """Input: close."""
    return Machine({"out": ("NULL", f"CASE WHEN {{one}} IS NULL THEN {{0}} ELSE {{out}} + {alpha!r} * ({{0}} - {{out}}) + {1 - alpha!r} * ({{out}} - {{one}}) END"), "one": ("NULL", "{out}")})


def _phases(period: int, lag: Callable[[str, int], str]) -> list[dict[str, str]]:
    smooth = " + ".join(f"{w} * {lag('{0}', k)}" for k, w in enumerate((0.4, 0.3, 0.2, 0.1)))
    quad = " + ".join(f"{w} * {lag('{trendless}', 2 * k)}" for k, w in enumerate(QUADRATURE))
    return [{"smooth": smooth}, {"trendless": f"{{smooth}} - {lag('{smooth}', period)}"}, {"inphase": lag("{trendless}", 3), "quad": f"0.5 * ({quad})"}, {"raw": "atan2({quad}, {inphase})"}]


def _turn(angle: str) -> str:
    return f"CASE WHEN {angle} < -pi() THEN {angle} + 2 * pi() WHEN {angle} > pi() THEN {angle} - 2 * pi() ELSE {angle} END"


def phasor(period, lag) -> Machine:
    phase = f"CASE WHEN {{raw}} IS NULL OR {{phase}} IS NULL THEN {{raw}} ELSE {{phase}} + {_turn('({raw} - {phase})')} END"
    return Machine({"phase": ("NULL", phase), "size": ("NULL", "sqrt({quad} * {quad} + {inphase} * {inphase})")}, _phases(period, lag))


def hilbert_sine(period, lag) -> Machine:
    alpha = 2 / (period + 1)
    fresh = "2 * pi() / nullif({turn}, 0)"
    cycle = f"CASE WHEN {{turn}} <> 0 THEN least(50.0, greatest(6.0, CASE WHEN {{cycle}} IS NULL THEN {fresh} ELSE {alpha!r} * {fresh} + {1 - alpha!r} * {{cycle}} END)) END"
    turned = f"({{angle}} + 2 * pi() / ({cycle}))"
    angle = f"CASE WHEN ({cycle}) IS NULL THEN {{angle}} WHEN {turned} > pi() THEN {turned} - 2 * pi() ELSE {turned} END"
    seen = lambda x: f"CASE WHEN ({cycle}) IS NOT NULL THEN {x} END"
    before = [*_phases(period, lag), {"apart": f"({{raw}} - {lag('{raw}', 1)})"}, {"turn": _turn("{apart}")}]
    return Machine({"sine": ("NULL", seen(f"sin({angle})")), "lead": ("NULL", seen(f"sin({angle} + pi() / 4)")), "cycle": ("NULL", cycle), "angle": ("0", angle)}, before)


#: Whose kernel also needs a way to look back.
LOOKING_BACK = {f.__name__: f for f in (phasor, hilbert_sine)}
PLAIN = {f.__name__: f for f in (position, rotation, cool_down, supertrend, psar, jma)}


def machine(name: str, args: tuple, lag: Callable[[str, int], str]) -> Machine | None:
    """The machine of a kernel, or None where there is none; lag(x, k): SQL of x of k bars ago."""
    if name in LOOKING_BACK:
        return LOOKING_BACK[name](*args, lag)
    return PLAIN[name](*args) if name in PLAIN else None
