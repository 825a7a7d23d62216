"""What candlestick and chart patterns should match, bar by bar, from SURVEY's definitions; nothing here uses a plan.

Each rule sees a window object and returns matches as (direction, confidence, bars spanned).
"""

import numpy as np

UP, DOWN, NEITHER = 1, -1, 0


class Window:
    """Bars up to place i of a frame, the current one first: w.o[0] is its open, w.o[1] the one before."""

    def __init__(self, d, i):
        part = d.iloc[max(0, i - 5) : i + 1].iloc[::-1]
        self.o, self.h, self.l, self.c = (part[k].tolist() for k in ("open", "high", "low", "close"))
        self.n = i + 1
        before = d.iloc[max(0, i - 20) : i]
        self.avg = (before.close - before.open).abs().mean() if i else 0.01
        self.avg_range = (before.high - before.low).mean() if i else 0.01
        self.b = [abs(c - o) for o, c in zip(self.o, self.c)]
        self.r = [h - low for h, low in zip(self.h, self.l)]
        self.us = [h - max(o, c) for o, h, c in zip(self.o, self.h, self.c)]
        self.ls = [min(o, c) - low for o, low, c in zip(self.o, self.l, self.c)]
        self.bull, self.bear = [c > o for o, c in zip(self.o, self.c)], [c < o for o, c in zip(self.o, self.c)]
        self.top, self.bottom = [max(x) for x in zip(self.o, self.c)], [min(x) for x in zip(self.o, self.c)]
        self.mid = [(o + c) / 2 for o, c in zip(self.o, self.c)]

    def doji(self, k): return self.r[k] > 0 and self.b[k] / self.r[k] < 0.1
    def cross(self, k): return self.b[k] / max(self.r[k], 1e-4) < 0.1
    def near(self, x, y, share): return abs(x - y) / max(self.avg, 1e-4) < share


RULES = {}


def rule(bars):
    def add(fn):
        RULES[fn.__name__] = (bars, fn)
        return fn

    return add


def side(up): return UP if up else DOWN
def body(w, k=0): return max(w.b[k], 1e-4)


@rule(1)
def doji(w):
    if w.doji(0):
        yield (DOWN if w.us[0] > 2 * w.ls[0] else UP if w.ls[0] > 2 * w.us[0] else NEITHER), 1 - w.b[0] / w.r[0], 1


def pin(w, long, short): return w.n > 1 and w.b[0] > 0.3 * w.avg and long[0] > 2 * w.b[0] and short[0] < 0.5 * w.b[0]
def rising(w): return w.n > 3 and all(w.bull[1:4])


@rule(1)
def hammer(w):
    if pin(w, w.ls, w.us):
        fell = w.n > 3 and all(w.bear[k] or k + 1 < w.n and w.c[k] < w.c[k + 1] for k in (1, 2, 3))
        yield UP, min(w.ls[0] / body(w), 5) / 5 * (1 if fell else 0.6), 1


@rule(1)
def inv_hammer(w):
    if pin(w, w.us, w.ls):
        yield UP, min(w.us[0] / body(w), 5) / 5 * (1 if w.n > 3 and all(w.bear[1:4]) else 0.6), 1


@rule(1)
def hanging_man(w):
    if pin(w, w.ls, w.us) and rising(w):
        yield DOWN, min(w.ls[0] / body(w), 5) / 5, 1


@rule(1)
def shooting_star(w):
    if pin(w, w.us, w.ls) and rising(w):
        yield DOWN, min(w.us[0] / body(w), 5) / 5, 1


@rule(1)
def marubozu(w):
    if w.r[0] > 0 and w.b[0] / w.r[0] > 0.9:
        yield side(w.bull[0]), w.b[0] / w.r[0], 1


@rule(1)
def spinning_top(w):
    if w.r[0] > 0 and w.b[0] / w.r[0] < 0.3 and w.us[0] > w.b[0] and w.ls[0] > w.b[0]:
        yield NEITHER, 0.7, 1


@rule(1)
def dragonfly_doji(w):
    if w.doji(0) and w.ls[0] > 0.6 * w.r[0] and w.us[0] < 0.1 * w.r[0]:
        yield UP, 0.85, 1


@rule(1)
def gravestone_doji(w):
    if w.doji(0) and w.us[0] > 0.6 * w.r[0] and w.ls[0] < 0.1 * w.r[0]:
        yield DOWN, 0.85, 1


@rule(1)
def long_body(w):
    if w.n > 5 and w.b[0] > 2 * w.avg:
        yield side(w.bull[0]), min(w.b[0] / max(w.avg, 1e-4) - 1, 1), 1


@rule(1)
def long_upper(w):
    if w.n > 5 and w.us[0] > 2 * w.b[0] and w.us[0] > w.ls[0]:
        yield DOWN, min(w.us[0] / body(w) / 3, 1), 1


@rule(1)
def long_lower(w):
    if w.n > 5 and w.ls[0] > 2 * w.b[0] and w.ls[0] > w.us[0]:
        yield UP, min(w.ls[0] / body(w) / 3, 1), 1


@rule(1)
def belt_hold(w):
    if w.n > 1 and w.b[0] > 1.5 * w.avg:
        if w.bull[0] and w.ls[0] < 0.1 * w.b[0] and w.o[0] <= w.l[0] * 1.01:
            yield UP, 0.75, 1
        if w.bear[0] and w.us[0] < 0.1 * w.b[0] and w.o[0] >= w.h[0] * 0.99:
            yield DOWN, 0.75, 1


@rule(2)
def engulfing(w):
    if w.b[0] > 1.2 * w.b[1] and w.b[1] > 0.5 * w.avg:
        conf = min(w.b[0] / body(w, 1), 3) / 3
        if not w.bull[1] and w.bull[0] and w.o[0] < w.c[1] and w.c[0] > w.o[1]:
            yield UP, conf, 2
        if w.bull[1] and not w.bull[0] and w.o[0] > w.c[1] and w.c[0] < w.o[1]:
            yield DOWN, conf, 2


def inside(w): return w.bottom[0] >= w.bottom[1] and w.top[0] <= w.top[1]


@rule(2)
def harami(w):
    if w.b[1] > 1.5 * w.avg and w.b[0] < 0.5 * w.b[1] and inside(w):
        yield side(w.bull[0]), 1 - w.b[0] / body(w, 1), 2


@rule(2)
def harami_cross(w):
    if w.b[1] > 1.5 * w.avg and w.cross(0) and inside(w):
        yield side(not w.bull[1]), 0.9, 2


@rule(2)
def piercing(w):
    if w.bear[1] and w.bull[0] and w.o[0] < w.l[1] and w.mid[1] < w.c[0] < w.o[1] and w.b[1] > 0.5 * w.avg:
        yield UP, min((w.c[0] - w.mid[1]) / body(w, 1) + 0.5, 1), 2


@rule(2)
def dark_cloud(w):
    if w.bull[1] and w.bear[0] and w.o[0] > w.h[1] and w.o[1] < w.c[0] < w.mid[1] and w.b[1] > 0.5 * w.avg:
        yield DOWN, min((w.mid[1] - w.c[0]) / body(w, 1) + 0.5, 1), 2


@rule(2)
def tweezer(w):
    if abs(w.h[0] - w.h[1]) < 0.1 * w.avg_range:
        yield (DOWN if w.bear[0] else NEITHER), 0.8, 2
    if abs(w.l[0] - w.l[1]) < 0.1 * w.avg_range:
        yield (UP if w.bull[0] else NEITHER), 0.8, 2


@rule(2)
def kicking(w):
    if min(w.b[:2]) > 1.3 * w.avg:
        if w.bear[1] and w.bull[0] and w.o[0] > w.o[1]:
            yield UP, 0.9, 2
        if w.bull[1] and w.bear[0] and w.o[0] < w.o[1]:
            yield DOWN, 0.9, 2


@rule(2)
def meeting_lines(w):
    if min(w.b[:2]) > w.avg and w.bear[1] and w.bull[0] and w.near(w.c[0], w.c[1], 0.1):
        yield UP, 0.8, 2


@rule(2)
def separating_lines(w):
    if min(w.b[:2]) > w.avg and w.bear[1] and w.bull[0] and w.near(w.o[0], w.o[1], 0.1):
        yield UP, 0.75, 2


@rule(2)
def matching_low(w):
    if min(w.b[:2]) > w.avg and w.bear[1] and w.bear[0] and w.near(w.c[0], w.c[1], 0.1):
        yield UP, 0.7, 2


def neck(share, direction):
    def fn(w):
        if w.bear[1] and w.bull[0] and w.b[1] >= 0.5 * w.avg and w.near(w.c[0], w.l[1] + share * (w.o[1] - w.c[1]), 0.15):
            yield direction, 0.65, 2

    return fn


for _n, _s, _d in (("on_neck", 0.0, DOWN), ("in_neck", 0.1, DOWN), ("thrusting", 0.3, UP)):
    RULES[_n] = (2, neck(_s, _d))


@rule(3)
def tasuki_gap(w):
    if w.b[1] > w.avg:
        if w.bull[2] and w.bull[1] and w.l[1] > w.h[2] and w.bear[0] and w.c[2] < w.c[0] < w.o[1]:
            yield UP, 0.7, 3
        if w.bear[2] and w.bear[1] and w.h[1] < w.l[2] and w.bull[0] and w.o[1] < w.c[0] < w.c[2]:
            yield DOWN, 0.7, 3


@rule(3)
def side_by_side_white(w):
    if w.bear[2] and w.b[2] > w.avg and w.bull[1] and w.bull[0] and w.h[1] < w.l[2] and w.near(w.c[0], w.c[1], 0.15) and w.near(w.o[0], w.o[1], 0.15):
        yield UP, 0.7, 2


def turn(w, up):
    first, last = (w.bear[2], w.bull[0]) if up else (w.bull[2], w.bear[0])
    return first and last and w.b[2] > 1.2 * w.avg and w.b[0] > 1.2 * w.avg


def star(up, cross, conf):
    def fn(w):
        if turn(w, up) and (w.c[0] > w.mid[2] if up else w.c[0] < w.mid[2]):
            if cross and w.cross(1) and (w.c[1] < w.c[2] if up else w.c[1] > w.c[2]) or not cross and w.b[1] < 0.6 * w.avg and (w.top[1] < w.c[2] if up else w.bottom[1] > w.c[2]):
                yield side(up), conf, 3

    return fn


for _n, _a in (("morning_star", (True, False, 0.85)), ("evening_star", (False, False, 0.85)), ("morning_doji_star", (True, True, 0.9)), ("evening_doji_star", (False, True, 0.9))):
    RULES[_n] = (3, star(*_a))


def three(up):
    def fn(w):
        s = 1 if up else -1
        same = all((w.bull if up else w.bear)[:3]) and min(w.b[:3]) > 0.7 * w.avg
        if same and all(s * w.c[k] > s * w.c[k + 1] and s * w.o[k] > s * w.o[k + 1] and s * w.o[k] < s * w.c[k + 1] for k in (0, 1)):
            yield side(up), 1 - (max(w.b[:3]) - min(w.b[:3])) / max(*w.b[:3], 1e-4), 3

    return fn


RULES["three_white_soldiers"], RULES["three_black_crows"] = (3, three(True)), (3, three(False))


@rule(3)
def three_inside_up(w):
    if w.bear[2] and w.b[2] > w.avg and w.bull[1] and w.b[1] < 0.5 * w.b[2] and w.bottom[1] >= w.c[2] and w.top[1] <= w.o[2] and w.bull[0] and w.b[0] > 2 * w.b[1] and w.c[0] > w.o[2]:
        yield UP, 0.8, 3


@rule(3)
def three_inside_down(w):
    if w.bull[2] and w.b[2] > w.avg and w.bear[1] and w.b[1] < 0.5 * w.b[2] and w.bottom[1] >= w.o[2] and w.top[1] <= w.c[2] and w.bear[0] and w.b[0] > 2 * w.b[1] and w.c[0] < w.o[2]:
        yield DOWN, 0.8, 3


@rule(3)
def three_outside_up(w):
    if w.bear[2] and w.b[2] < w.avg and w.bull[1] and w.b[1] > 1.5 * w.b[2] and w.o[1] < w.c[2] and w.c[1] > w.o[2] and w.bull[0] and w.c[0] > w.c[1]:
        yield UP, 0.8, 3


@rule(3)
def three_outside_down(w):
    if w.bull[2] and w.b[2] < w.avg and w.bear[1] and w.b[1] > 1.5 * w.b[2] and w.o[1] > w.c[2] and w.c[1] < w.o[2] and w.bear[0] and w.c[0] < w.c[1]:
        yield DOWN, 0.8, 3


@rule(3)
def abandoned_baby(w):
    if w.cross(1):
        if turn(w, True) and w.h[1] < w.l[2] and w.l[0] > w.h[1]:
            yield UP, 0.95, 3
        if turn(w, False) and w.l[1] > w.h[2] and w.h[0] < w.l[1]:
            yield DOWN, 0.95, 3


@rule(3)
def tristar(w):
    if w.doji(0) and w.doji(1) and w.doji(2):
        if w.c[1] > w.c[2] and w.c[0] < w.c[1]:
            yield DOWN, 0.8, 3
        elif w.c[1] < w.c[2] and w.c[0] > w.c[1]:
            yield UP, 0.8, 3


@rule(3)
def unique_three_river(w):
    if w.bear[2] and w.b[2] > 1.2 * w.avg and w.b[1] < 0.5 * w.b[2] and w.bull[0] and w.b[0] < w.b[1] and w.l[0] > w.l[1]:
        yield UP, 0.7, 3


@rule(3)
def three_stars_south(w):
    if all(w.bear[:3]) and w.b[2] > 1.2 * w.avg and w.b[1] < w.b[2] and w.l[1] < w.l[2] and w.b[0] < w.b[1] and w.l[0] > w.l[1]:
        yield UP, 0.75, 3


@rule(4)
def squeeze_alert(w):
    tight = 1 - w.r[0] / max(w.r[3], 1e-4)
    if w.r[0] < w.r[1] < w.r[2] < w.r[3] and tight > 0.5 and w.bull[0]:
        yield UP, tight, 4


@rule(6)
def ladder_bottom(w):
    if w.c[1] < w.c[2] < w.c[3] < w.c[4] and w.o[0] > w.c[1] and w.bull[0] and w.c[0] > w.o[2]:
        yield UP, 0.75, 5


def methods(up):
    def fn(w):
        small = all((w.bear if up else w.bull)[k] and w.b[k] < w.avg and w.l[k] > w.l[4] and w.h[k] < w.h[4] for k in (1, 2, 3))
        if small and (w.bull if up else w.bear)[4] and w.b[4] > 1.2 * w.avg and (w.bull[0] and w.c[0] > w.h[4] if up else w.bear[0] and w.c[0] < w.l[4]):
            yield side(up), 0.85, 5

    return fn


RULES["rising_three"], RULES["falling_three"] = (5, methods(True)), (5, methods(False))


@rule(5)
def mat_hold(w):
    if w.bull[4] and w.b[4] >= 1.5 * w.avg and all(w.b[k] < w.avg and w.l[k] > w.l[4] and w.h[k] <= w.h[4] for k in (1, 2, 3)) and w.bull[0] and w.c[0] > w.h[4]:
        yield UP, 0.8, 5


def candles(d):
    """(pattern, start, end, direction, confidence) of a whole frame."""
    out = []
    for i in range(len(d)):
        w = Window(d, i)
        for name, (bars, fn) in RULES.items():
            if w.n >= bars:
                out += [(name, i - span + 1, i, direction, conf) for direction, conf, span in fn(w)]
    return out


def charts(d):
    h, low, c = (d[k].to_numpy() for k in ("high", "low", "close"))
    n, out = len(d), []
    around = range(5, n - 5)
    for high in (True, False):
        x, s = (h, 1) if high else (low, -1)
        points = [i for i in around if all(s * x[i] >= s * x[j] for j in range(i - 5, i + 6))]

        def broken(a, b):
            neck = low[a : b + 1].min() if high else h[a : b + 1].max()
            return any(v < neck if high else v > neck for v in c[b + 1 :])

        for a, b in zip(points, points[1:]):
            if n >= 40 and 8 <= b - a <= 60 and abs(x[a] - x[b]) / max((x[a] + x[b]) / 2, 0.01) < 0.03 and broken(a, b):
                out.append(("double_top" if high else "double_bottom", a, b, -s, 0.8))
        for a, m, b in zip(points, points[1:], points[2:]):
            mid = (x[a] + x[b]) / 2
            tall = x[m] > max(x[a], x[b]) and x[m] >= 1.02 * mid if high else x[m] < min(x[a], x[b]) and x[m] <= 0.98 * mid
            if n >= 60 and b - a <= 60 and tall and abs(x[a] - x[b]) / max(mid, 0.01) <= 0.05 and broken(a, b):
                out.append(("head_shoulders" if high else "inv_head_shoulders", a, b, -s, 0.75))
    if n >= 20:
        w = min(30, n)
        rh, rl = h[-w:], low[-w:]
        up, down, size = rh[-10:].max() - rh[:10].max(), rl[-10:].min() - rl[:10].min(), abs(rh[:10].max() - rl[:10].min())
        conf = max(min((down - up) / max(size, 0.01), 1), 0.5)
        for name, ok, direction in (("asc_triangle", up < 0.05 * size and down > 0.05 * size, 1), ("desc_triangle", down > -0.05 * size and up < -0.05 * size, -1), ("sym_triangle", up < -0.03 * size and down > 0.03 * size, 0)):
            if ok:
                out.append((name, n - w, n - 1, direction, conf))
        a, b = h[-20:], low[-20:]
        box = a.mean() - b.mean()
        if a.std() < 0.2 * box and b.std() < 0.2 * box and box > 0.01:
            out.append(("rectangle", n - 20, n - 1, 0, 0.6))
        if a[-5:].max() > a[:5].max() and b[-5:].min() < b[:5].min():
            out.append(("lsd_top", n - 20, n - 1, -1, 0.55))
    if n >= 30:
        move = (c[n - 10] - c[n - 20]) / max(c[n - 20], 0.01)
        if abs(move) >= 0.05 and (h - low)[-10:].mean() >= 0.01:
            out += [(name, n - 20, n - 1, 1 if move > 0 else -1, 0.65) for name in ("flag", "wedge")]
        if (h - low)[n - 25 : n - 15].mean() > 0.01 and (h - low)[n - 15 :].mean() < 0.6 * (h - low)[n - 25 : n - 15].mean():
            out.append(("diamond", n - 25, n - 1, -1, 0.5))
    if n >= 40:
        cup = c[n - 35 : n - 5]
        left, right = cup[:15].mean(), cup[15:].mean()
        if abs(left - right) / max(left, 0.01) < 0.05 and cup.min() < 0.85 * left:
            out.append(("cup_handle", n - 35, n - 1, 1, 0.6))
        bowl = c[-40:]
        left, right = bowl[:20].mean(), bowl[20:].mean()
        if 5 < int(np.argmin(bowl)) < 35 and bowl.min() < 0.85 * left and abs(left - right) / max(left, 0.01) < 0.08:
            out.append(("rounding_bottom", n - 40, n - 1, 1, 0.6))
    return out
