"""All registered queries of the market-analytics engine, with their DuckDB equivalents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import backtest, blocks, distribution, factors, gram, indicators, patterns, relational, risk, scanner, search, strategies
from .plans.staged import Plan, Recurrence, rounded
from .script.compile import compile_script
from .sources import bars as B
from .sources import day as day_files
from .sources import files, shared, tables
from .streaming import bars as S
from .streaming import late
from .streaming import state as live

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql:
            SQL[name] = sql
        return fn

    return add


def _of_plan(name: str, plan: Plan) -> None:
    QUERIES[name] = lambda spark, d: plan.spark(B.bars_orders(spark, d), compare=True)
    if plan.has_sql:
        SQL[name] = plan.duck(B.SQL_ORDERS)


def _r(*columns: str) -> list:
    return [F.expr(rounded(c)).alias(c) for c in columns]


def _rs(*columns: str) -> str:
    return ", ".join(f"{rounded(c)} AS {c}" for c in columns)


# --- indicators and factors: one query a category, and the kernels' apart

for _category in dict.fromkeys(i.category for i in indicators.REGISTRY.values()):
    _names = [n for n, i in indicators.REGISTRY.items() if i.category == _category]
    _plain = [n for n in _names if not indicators.plan([n]).has_kernel]
    if _plain:
        _of_plan(f"indicators_{_category}", indicators.plan(_plain))
_of_plan("indicators_state_machines", indicators.plan([n for n in indicators.REGISTRY if indicators.plan([n]).has_kernel]))
_of_plan("indicators_recursive", indicators.plan(["supertrend", "psar", "jma", "hilbert_sine", "phasor"]))
_of_plan("indicators_sorted_windows", indicators.plan({"median": {"period": 250}, "mad": {"period": 250}, "cci": {"period": 120}}))
for _category in dict.fromkeys(c for c, _, _ in factors.REGISTRY.values()):
    _of_plan(f"factors_{_category}", factors.plan(factors.by_category(_category)))


@query("indicator_range_stats", f"""WITH b AS (SELECT *, row_number() OVER w AS i, lag(close) OVER w AS c1 FROM ({B.SQL_ORDERS}) WINDOW w AS (PARTITION BY symbol ORDER BY trade_date)),
t AS (SELECT *, CASE WHEN i > 1 THEN greatest(high - low, abs(high - c1), abs(low - c1)) END AS tr FROM b WHERE i BETWEEN 100 AND 400),
p AS (SELECT *, 1 - close / max(close) OVER (PARTITION BY symbol ORDER BY i) AS fall FROM t)
SELECT symbol, {rounded('100 * (arg_max(close, i) / arg_min(close, i) - 1)')} AS pct_change, {rounded('100 * max(fall)')} AS max_drawdown, {rounded('avg(tr)')} AS mean_true_range FROM p GROUP BY symbol""")
def _range(spark, d):
    return indicators.range_stats(B.bars_orders(spark, d), 100, 400).select("symbol", *_r("pct_change", "max_drawdown", "mean_true_range"))


# --- patterns, strategies, scanner, script

@query("patterns_candles", f"SELECT symbol, pattern, start_date, end_date, direction, {rounded('confidence')} AS confidence FROM ({patterns.candles_sql(B.SQL_ORDERS)})")
def _candles(spark, d):
    return patterns.candles(B.bars_orders(spark, d)).select("symbol", "pattern", "start_date", "end_date", "direction", *_r("confidence"))


@query("patterns_charts")
def _charts(spark, d):
    return patterns.charts(B.bars_orders(spark, d))


def _signals() -> tuple[Plan, Plan]:
    plain, kernel = Plan(), Plan()
    for name in strategies.REGISTRY:
        own = strategies.plan(name)
        p = kernel if own.has_kernel else plain
        p.out(**{name: strategies.formula(p, name)})
    return plain, kernel


for _name, _plan in zip(("strategies_signals", "strategies_with_position"), _signals(), strict=True):
    _of_plan(_name, _plan)

TREE = {"op": "AND", "children": [
    {"op": "OR", "children": [{"op": "COMPARE", "indicator": "rsi", "params": {"period": 14}, "compare": ">", "value": 30}, {"op": "CROSS", "indicator": "macd"}]},
    {"op": "COMPARE", "indicator": "close", "compare": ">", "value": 1},
]}


@query("scanner", f"SELECT symbol, trade_date, close, {rounded('score')} AS score, 'rsi(period=14) > 30; CROSS(macd(), above); close() > 1' AS signals FROM ({scanner.scan_sql(B.SQL_ORDERS, TREE)})")
def _scan(spark, d):
    return scanner.scan(B.bars_orders(spark, d), TREE).select("symbol", "trade_date", "close", *_r("score"), F.concat_ws("; ", "signals").alias("signals"))


SCRIPT = """
let fast = sma(close, 5); let slow = sma(C, 20);
plot golden = cross(fast, slow); plot dif = macd(close, 12, 26, 9).dif;
TP: (high + low + close) / 3; PREV := close[1];
up: if (close > prev) then 1 else 0; best: hhv(high, 10); since: barslast(golden); spread: bb_upper(close, 20, 2) - bb_lower(close, 20, 2);
r: rsi(close, 14); z: zscore(close, 20) * -1; ok: every(close > 0, 5) and not (volume == 0); j: kdj_j(high, low, close, 9, 3, 3);
"""
_of_plan("script", compile_script(SCRIPT))
#: Every function of the language but ``filter``, which has no SQL form, and those of SCRIPT.
FUNCTIONS_SCRIPT = """
m1: ma(close, 7); m2: simple_ma(open, 3); e: ema(close, 12); w: wma(close, 9); rm: rma(close, 9); hm: hma(close, 16); sd: stdev(close, 10); sd2: std(close, 5);
va: variance(close, 10); va2: var(close, 4); md: macd_dif(close); me: macd_dea(close); mh: macd_hist(close, 5, 10, 4); kk: kdj_k(high, low, close); kd: kdj_d(high, low, close, 5, 3, 3);
cc: cci(high, low, close, 14); mf: mfi(14); at: atr(high, low, close, 14); ax: adx(14); bu: bbands_upper(close, 20, 2); bm: bb_middle(close, 20, 2); bn: bbands_middle(close, 10); bl: bbands_lower(close, 20, 2);
ob: obv(close, volume); cu: cross_over(close, open); cd: crossunder(close, open); hi: highest(high, 9); lo: llv(low, 9); lw: lowest(low, 4); su: sum(volume, 6);
bs: barssince(close > open); ct: count(close > open, 10); ex: exist(close > open, 3); ab: abs(close - open); mx: max(open, close); mn: min(open, close); pw: pow(close / 100000, 2);
sq: sqrt(close); lg: log(close); ll: ln(close); xp: exp(close / 1000000); ro: round(close / 7); ce: ceil(close / 7); fl: floor(close / 7); sg: sign(close - open);
si: sin(close / 1000); co: cos(close / 1000); ta: tan(close / 1000000); fi: iff(close > open, high, low); be: between(close, open, high); ra: range(close, low, high);
rc: roc(close, 5); pr: percent_return(close, 3); dr: drawdown(close); sh: shift(close, 2);
d1: cdl_doji(open, high, low, close); d2: cdl_hammer(open, high, low, close); d3: cdl_shooting_star(open, high, low, close); d4: cdl_marubozu(); d5: cdl_engulfing(open, high, low, close); d6: cdl_harami();
d7: cdl_morning_star(); d8: cdl_evening_star(); d9: cdl_three_white_soldiers(); mo: volume % 7; xo: close > open xor volume > 5; ne: close <> open;
"""
_of_plan("script_functions", compile_script(FUNCTIONS_SCRIPT))
_of_plan("script_filter", compile_script("once: filter(close > open, 5);"))
_of_plan("heikin_ashi", relational.heikin_ashi_plan())


# --- bars and relational operators

@query("bars_daily", f"SELECT symbol, trade_date, {_rs(*B.VALUES)} FROM ({B.SQL_ORDERS})")
def _daily(spark, d):
    return B.bars_orders(spark, d).select("symbol", "trade_date", *_r(*B.VALUES))


@query("bars_hourly", f"SELECT symbol, trade_date, {_rs(*B.VALUES)} FROM ({B.SQL_EVENTS})")
def _hourly(spark, d):
    return B.bars_events(spark, d).select("symbol", "trade_date", *_r(*B.VALUES))


def _resample_sql(to: str) -> str:
    return f"""SELECT symbol, trade_date, {_rs(*B.VALUES)} FROM (SELECT symbol, max(trade_date) AS trade_date, arg_min(open, trade_date) AS open, max(high) AS high, min(low) AS low, arg_max(close, trade_date) AS close,
sum(volume) AS volume, sum(amount) AS amount, arg_max(turnover, trade_date) AS turnover FROM ({B.SQL_ORDERS}) GROUP BY symbol, date_trunc('{to}', trade_date))"""


@query("resample_week", _resample_sql("week"))
def _week(spark, d):
    return B.resample(B.bars_orders(spark, d), "week").select("symbol", "trade_date", *_r(*B.VALUES))


@query("resample_month", _resample_sql("month"))
def _month(spark, d):
    return B.resample(B.bars_orders(spark, d), "month").select("symbol", "trade_date", *_r(*B.VALUES))


@query("stock_summary", "SELECT c_custkey::VARCHAR AS symbol, c_name AS name, count(o_orderkey) AS bars, min(o_orderdate)::DATE AS first_date, max(o_orderdate)::DATE AS last_date FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY 1, 2")
def _summary(spark, d):
    stocks = B.table(spark, d, "customer").select(F.col("c_custkey").cast("string").alias("symbol"), F.col("c_name").alias("name"))
    rows = B.table(spark, d, "orders").select(F.col("o_custkey").cast("string").alias("symbol"), F.to_date("o_orderdate").alias("trade_date"))
    return relational.summary(stocks, rows)


@query("latest_bars", f"SELECT symbol, trade_date, close FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY trade_date DESC) AS k FROM ({B.SQL_ORDERS})) WHERE k <= 100")
def _latest(spark, d):
    return relational.latest(B.bars_orders(spark, d), 100).select("symbol", "trade_date", "close")


@query("bars_in_range", f"SELECT symbol, trade_date, close FROM ({B.SQL_ORDERS}) WHERE symbol = '2-HIGH' AND trade_date BETWEEN DATE '1994-01-01' AND DATE '1995-06-30' ORDER BY trade_date LIMIT 50000")
def _in_range(spark, d):
    return relational.in_range(B.bars_orders(spark, d), "2-HIGH", "1994-01-01", "1995-06-30", 50000).select("symbol", "trade_date", "close")


@query("indicators_wide_universe", indicators.plan({"sma": {}, "rsi": {}, "macd": {}, "atr": {}, "obv": {}}).duck(B.SQL_CUSTOMERS))
def _wide(spark, d):
    return indicators.plan({"sma": {}, "rsi": {}, "macd": {}, "atr": {}, "obv": {}}).spark(B.bars_customers(spark, d), compare=True)


_ROUNDED_PRICES = "round(open, 2) AS open, round(high, 2) AS high, round(low, 2) AS low, round(close, 2) AS close"


@query("source_csv_lines", f"SELECT symbol, trade_date, {_ROUNDED_PRICES}, volume FROM ({B.SQL_ORDERS})")
def _csv(spark, d):
    """Bars written as delimited text and read again."""
    b = B.bars_orders(spark, d)
    line = F.concat_ws(",", F.date_format("trade_date", "yyyyMMdd"), *[F.round(c, 2).cast("decimal(18,2)").cast("string") for c in ("open", "high", "low", "close")], F.col("volume").cast("long").cast("string"))
    return files.csv_lines(b.select("symbol", line.alias("value")), "date,open,high,low,close,volume").select("symbol", "trade_date", "open", "high", "low", "close", "volume")


@query("source_feed_lines", f"SELECT symbol, trade_date, {_ROUNDED_PRICES}, volume, 1.5::DOUBLE AS turnover FROM ({B.SQL_ORDERS})")
def _feed(spark, d):
    b = B.bars_orders(spark, d)
    line = F.concat_ws(",", F.col("trade_date").cast("string"), *[F.round(c, 2).cast("decimal(18,2)").cast("string") for c in ("open", "close", "high", "low")], F.col("volume").cast("string"), *[F.lit(x) for x in ("0", "0", "0", "0", "150")])
    return files.feed_lines(b.select("symbol", line.alias("line"))).select("symbol", "trade_date", "open", "high", "low", "close", "volume", "turnover")


@query("source_day_records", f"SELECT 'SH60000' || left(symbol, 1) AS symbol, trade_date, {_ROUNDED_PRICES}, volume FROM ({B.SQL_ORDERS})")
def _day(spark, d):
    """Bars written as binary day files and read again; six digits of a code are made of the symbol's first character."""
    b = B.bars_orders(spark, d).withColumn("symbol", F.concat(F.lit("sh60000"), F.substring("symbol", 1, 1)))
    return files.day_records(files.to_day_records(b)).select("symbol", "trade_date", "open", "high", "low", "close", "volume")


@query("source_day_files", SQL["source_day_records"])
def _day_files(spark, d):
    """Day files written by tasks and read as a data source, 1000 records a task."""
    day_files.register(spark)
    at = shared.folder(spark, "day")
    day_files.write(B.bars_orders(spark, d).withColumn("symbol", F.concat(F.lit("sh60000"), F.substring("symbol", 1, 1))), at)
    return spark.read.format("dayfile").option("records", 1000).load(at).select("symbol", "trade_date", "open", "high", "low", "close", "volume")


@query("watchlist_members", """SELECT n_name AS list, c_custkey::VARCHAR AS symbol, c_name AS name, count(o_orderkey) AS bars, min(o_orderdate)::DATE AS first_date, max(o_orderdate)::DATE AS last_date
FROM customer JOIN nation ON c_nationkey = n_nationkey LEFT JOIN orders ON c_custkey = o_custkey WHERE c_mktsegment = 'BUILDING' GROUP BY 1, 2, 3""")
def _members(spark, d):
    c = B.table(spark, d, "customer")
    stocks = c.select(F.col("c_custkey").cast("string").alias("symbol"), F.col("c_name").alias("name"))
    items = c.filter("c_mktsegment = 'BUILDING'").join(B.table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("n_name").alias("list"), F.col("c_custkey").cast("string").alias("symbol"))
    rows = B.table(spark, d, "orders").select(F.col("o_custkey").cast("string").alias("symbol"), F.to_date("o_orderdate").alias("trade_date"))
    return relational.members(items, stocks, rows).select("list", "symbol", "name", "bars", "first_date", "last_date")


@query("watchlists", "SELECT n_nationkey AS list, n_name AS name, count(c_custkey) AS members FROM nation LEFT JOIN customer ON n_nationkey = c_nationkey AND c_acctbal > 5000 GROUP BY 1, 2")
def _lists(spark, d):
    items = B.table(spark, d, "customer").filter("c_acctbal > 5000").select(F.col("c_nationkey").alias("list"))
    return relational.lists(B.table(spark, d, "nation").select(F.col("n_nationkey").alias("list"), F.col("n_name").alias("name")), items)


@query("trades_with_stocks", "SELECT o_orderkey, o_custkey::VARCHAR AS symbol, o_totalprice, c_name AS name FROM orders LEFT JOIN customer ON o_custkey = c_custkey AND c_acctbal > 0")
def _lookup(spark, d):
    stocks = B.table(spark, d, "customer").filter("c_acctbal > 0").select(F.col("c_custkey").cast("string").alias("symbol"), F.col("c_name").alias("name"))
    return relational.with_stock(B.table(spark, d, "orders").select("o_orderkey", F.col("o_custkey").cast("string").alias("symbol"), "o_totalprice"), stocks).select("o_orderkey", "symbol", "o_totalprice", "name")


@query("table_counts", "SELECT 'stocks' AS name, count(*) AS rows FROM customer UNION ALL SELECT 'bars', count(*) FROM orders")
def _counts(spark, d):
    return relational.counts(stocks=B.table(spark, d, "customer"), bars=B.table(spark, d, "orders"))


@query("insert_or_ignore", f"SELECT symbol, trade_date, close FROM ({B.SQL_ORDERS}) WHERE trade_date >= DATE '1996-01-01'")
def _ingest(spark, d):
    b = B.bars_orders(spark, d)
    return relational.insert_or_ignore(b.filter("trade_date < DATE '1996-01-01'"), b, ["symbol", "trade_date"], ["close"]).select("symbol", "trade_date", "close")


@query("upsert", f"SELECT symbol, trade_date, CASE WHEN trade_date >= DATE '1996-01-01' THEN close + 1 ELSE close END AS close FROM ({B.SQL_ORDERS})")
def _upsert(spark, d):
    b = B.bars_orders(spark, d).select("symbol", "trade_date", "close")
    return relational.upsert(b, b.filter("trade_date >= DATE '1996-01-01'").withColumn("close", F.col("close") + 1), ["symbol", "trade_date"])


_BROKEN = f"SELECT symbol, trade_date, open, CASE WHEN day(trade_date) = 3 THEN low ELSE high END AS high, low, close, CASE WHEN day(trade_date) = 5 THEN -volume ELSE volume END AS volume FROM ({B.SQL_ORDERS})"


@query("quality_rules", f"""WITH x AS ({_BROKEN}), b AS (SELECT * FROM x UNION ALL SELECT * FROM x WHERE day(trade_date) = 7)
SELECT symbol, trade_date, 'gap' AS rule FROM (SELECT symbol, trade_date, lag(trade_date) OVER (PARTITION BY symbol ORDER BY trade_date) AS before FROM b) WHERE trade_date - before > 10
UNION ALL SELECT symbol, trade_date, 'negative' FROM b WHERE least(open, high, low, close) <= 0 OR volume < 0
UNION ALL SELECT symbol, trade_date, 'ohlc' FROM b WHERE high < greatest(open, close, low) OR low > least(open, close)
UNION ALL SELECT symbol, trade_date, 'duplicate' FROM b WHERE (symbol, trade_date) IN (SELECT (symbol, trade_date) FROM b GROUP BY symbol, trade_date HAVING count(*) > 1)""")
def _quality(spark, d):
    """Over bars that were broken on purpose: highs on the 3rd, volumes on the 5th, copies on the 7th of a month."""
    on = lambda n: F.dayofmonth("trade_date") == n
    b = B.bars_orders(spark, d).withColumns({"high": F.when(on(3), F.col("low")).otherwise(F.col("high")), "volume": F.when(on(5), -F.col("volume")).otherwise(F.col("volume"))})
    return relational.quality(b.unionByName(b.filter(on(7))))


TRADES = "SELECT l_suppkey::VARCHAR AS symbol, l_orderkey * 1000 + row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS seq, CASE WHEN l_returnflag = 'R' THEN 'sell' ELSE 'buy' END AS direction, l_extendedprice / l_quantity AS price, l_quantity AS quantity FROM lineitem"


@query("fifo_matching", f"""WITH RECURSIVE t AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY seq) AS i FROM ({TRADES})),
h AS (SELECT symbol, i, seq, direction, price, quantity, CASE WHEN direction = 'buy' THEN quantity ELSE 0.0::DOUBLE END AS held, CASE WHEN direction = 'buy' THEN quantity ELSE 0.0::DOUBLE END AS moved FROM t WHERE i = 1
UNION ALL SELECT t.symbol, t.i, t.seq, t.direction, t.price, t.quantity, CASE WHEN t.direction = 'buy' THEN h.held + t.quantity ELSE greatest(h.held - t.quantity, 0) END, CASE WHEN t.direction = 'buy' THEN t.quantity ELSE least(h.held, t.quantity) END FROM h JOIN t ON t.symbol = h.symbol AND t.i = h.i + 1),
c AS (SELECT *, sum(moved) OVER (PARTITION BY symbol, direction ORDER BY i) AS hi FROM h WHERE moved > 0), e AS (SELECT *, hi - moved AS lo FROM c),
m AS (SELECT b.symbol, (s.price - b.price) * (least(b.hi, s.hi) - greatest(b.lo, s.lo)) AS pnl, s.seq FROM e b JOIN e s ON b.symbol = s.symbol AND b.direction = 'buy' AND s.direction = 'sell' AND b.lo < s.hi AND s.lo < b.hi),
g AS (SELECT symbol, seq, sum(pnl) AS p FROM m GROUP BY symbol, seq), k AS (SELECT symbol, count(*) AS trades, count_if(direction = 'sell') AS sells FROM t GROUP BY symbol),
f AS (SELECT k.symbol, trades, sells, count_if(p > 0) AS wins, count_if(p < 0) AS losses, coalesce(sum(p), 0) AS pnl, coalesce(sum(p) FILTER (p > 0), 0) AS gain, coalesce(sum(p) FILTER (p < 0), 0) AS loss, greatest(coalesce(max(p), 0), 0) AS max_win, least(coalesce(min(p), 0), 0) AS max_loss FROM k LEFT JOIN g USING (symbol) GROUP BY 1, 2, 3)
SELECT symbol, trades, sells, wins, losses, {rounded('100 * wins / nullif(sells, 0)')} AS win_rate, {rounded('pnl')} AS pnl, {rounded('CASE WHEN wins > 0 THEN gain / wins ELSE 0 END')} AS avg_win, {rounded('CASE WHEN losses > 0 THEN loss / losses ELSE 0 END')} AS avg_loss,
{rounded('max_win')} AS max_win, {rounded('max_loss')} AS max_loss, {rounded('CASE WHEN abs(loss) > 1e-9 THEN abs(gain / loss) ELSE 0 END')} AS profit_factor FROM f""")
def _fifo(spark, d):
    from pyspark.sql import Window as W

    line = B.table(spark, d, "lineitem")
    at = F.row_number().over(W.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"))
    t = line.select(F.col("l_suppkey").cast("string").alias("symbol"), (F.col("l_orderkey") * 1000 + at).alias("seq"), F.when(F.col("l_returnflag") == "R", "sell").otherwise("buy").alias("direction"), (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"), F.col("l_quantity").alias("quantity"))
    return relational.fifo_summary(t).select("symbol", "trades", "sells", "wins", "losses", *_r("win_rate", "pnl", "avg_win", "avg_loss", "max_win", "max_loss", "profit_factor"))


def _alert_rules(spark):
    rows = [(i, s, k, p, True, None) for i, (s, k, p) in enumerate([("1-URGENT", "price_breakout", '{"direction":"above","price":1}'), ("2-HIGH", "ma_cross", '{"short_period":5,"long_period":20,"direction":"golden"}'), ("3-MEDIUM", "volume_spike", '{"multiplier":1.1,"lookback":20}'), ("5-LOW", "price_breakout", '{"direction":"below","price":1}')])]
    return spark.createDataFrame(rows, "rule_id int, symbol string, condition_type string, params string, enabled boolean, last_triggered date")


@query("alerts", f"""WITH b AS (SELECT symbol, trade_date, close, volume, row_number() OVER (PARTITION BY symbol ORDER BY trade_date DESC) AS k FROM ({B.SQL_ORDERS}) WHERE trade_date <= DATE '1998-07-01'),
g AS (SELECT symbol, max(CASE WHEN k = 1 THEN trade_date END) AS trade_date, max(CASE WHEN k = 1 THEN close END) AS close, max(CASE WHEN k = 1 THEN volume END) AS volume, avg(CASE WHEN k BETWEEN 2 AND 21 THEN volume END) AS usual,
avg(CASE WHEN k <= 5 THEN close END) - avg(CASE WHEN k <= 20 THEN close END) AS now, avg(CASE WHEN k BETWEEN 2 AND 6 THEN close END) - avg(CASE WHEN k BETWEEN 2 AND 21 THEN close END) AS before FROM b GROUP BY symbol)
SELECT * FROM (SELECT 0 AS rule_id, symbol, 'price_breakout' AS condition_type, trade_date, close FROM g WHERE symbol = '1-URGENT' AND close > 1 UNION ALL SELECT 1, symbol, 'ma_cross', trade_date, close FROM g WHERE symbol = '2-HIGH' AND before <= 0 AND now > 0
UNION ALL SELECT 2, symbol, 'volume_spike', trade_date, close FROM g WHERE symbol = '3-MEDIUM' AND usual > 0 AND volume > 1.1 * usual UNION ALL SELECT 3, symbol, 'price_breakout', trade_date, close FROM g WHERE symbol = '5-LOW' AND close < 1)""")
def _alerts(spark, d):
    return relational.check_alerts(_alert_rules(spark), B.bars_orders(spark, d), "1998-07-01")


@query("statistics", f"""WITH b AS ({B.SQL_ORDERS}), m AS (SELECT symbol, avg(close) AS mu FROM b GROUP BY symbol), g AS (SELECT b.symbol, count(*) AS n, avg(close) AS mean, stddev_samp(close) AS std, var_samp(close) AS variance, avg(power(close - mu, 3)) / power(stddev_pop(close), 3) AS s, avg(power(close - mu, 4)) / power(var_pop(close), 2) - 3 AS k FROM b JOIN m USING (symbol) GROUP BY b.symbol)
SELECT symbol, n, q25, q50, q75, {rounded('mean')} AS mean, {rounded('std')} AS std, {rounded('variance')} AS variance, {rounded('s * sqrt(n * (n - 1.0::DOUBLE)) / (n - 2)')} AS skew, {rounded('(n - 1) / ((n - 2) * (n - 3.0::DOUBLE)) * ((n + 1) * k + 6)')} AS kurtosis FROM g
JOIN (SELECT symbol, max(CASE WHEN i = floor(0.25 * (n - 1) + 0.5) THEN close END) AS q25, max(CASE WHEN i = floor(0.5 * (n - 1) + 0.5) THEN close END) AS q50, max(CASE WHEN i = floor(0.75 * (n - 1) + 0.5) THEN close END) AS q75
FROM (SELECT symbol, close, row_number() OVER (PARTITION BY symbol ORDER BY close) - 1 AS i, count(*) OVER (PARTITION BY symbol) AS n FROM b) GROUP BY symbol) USING (symbol)""")
def _statistics(spark, d):
    return relational.statistics(B.bars_orders(spark, d), "close").select("symbol", "n", "q25", "q50", "q75", *_r("mean", "std", "variance", "skew", "kurtosis"))


@query("spearman", f"""SELECT symbol, {rounded('corr(a, b)')} AS spearman FROM (SELECT symbol, rank() OVER (PARTITION BY symbol ORDER BY close) + (count(*) OVER (PARTITION BY symbol, close) - 1) / 2 AS a,
rank() OVER (PARTITION BY symbol ORDER BY volume) + (count(*) OVER (PARTITION BY symbol, volume) - 1) / 2 AS b FROM ({B.SQL_ORDERS})) GROUP BY symbol""")
def _spearman(spark, d):
    return relational.spearman(B.bars_orders(spark, d), "close", "volume").select("symbol", *_r("spearman"))


@query("zscore_series", f"SELECT symbol, trade_date, {rounded('coalesce((close - avg(close) OVER (PARTITION BY symbol)) / nullif(stddev_samp(close) OVER (PARTITION BY symbol), 0), 0)')} AS zscore FROM ({B.SQL_ORDERS})")
def _zscore(spark, d):
    return relational.standardized(B.bars_orders(spark, d), "close").select("symbol", "trade_date", *_r("zscore"))


@query("winsorized", f"""WITH r AS (SELECT symbol, trade_date, close, row_number() OVER (PARTITION BY symbol ORDER BY close) - 1 AS i, count(*) OVER (PARTITION BY symbol) AS n FROM ({B.SQL_ORDERS})),
q AS (SELECT symbol, max(CASE WHEN i = floor(0.05 * (n - 1) + 0.5) THEN close END) AS lo, max(CASE WHEN i = floor(0.95 * (n - 1) + 0.5) THEN close END) AS hi FROM r GROUP BY symbol)
SELECT symbol, trade_date, {rounded('greatest(least(close, hi), lo)')} AS winsorized FROM r JOIN q USING (symbol)""")
def _winsorized(spark, d):
    return relational.winsorized(B.bars_orders(spark, d), "close").select("symbol", "trade_date", *_r("winsorized"))


@query("indicator_catalogue")
def _catalogue(spark, d):
    """Every indicator with the number of symbols that have more bars than its longest parameter."""
    bars = B.bars_customers(spark, d).groupBy("symbol").agg(F.count("*").alias("bars")).groupBy("bars").agg(F.count("*").alias("symbols"))
    most = F.coalesce(F.array_max(F.map_values("params")), F.lit(1.0))
    long = indicators.catalogue(spark).withColumn("_most", most)
    return long.join(bars, F.col("bars") > F.col("_most"), "left").groupBy("name", "category", "tier", "lookahead").agg(F.coalesce(F.sum("symbols"), F.lit(0)).alias("symbols"))


@query("pattern_signal", f"""WITH b AS (SELECT symbol, trade_date, open AS o, close AS c, abs(close - open) AS x, lag(open) OVER w AS o1, lag(close) OVER w AS c1, avg(abs(close - open)) OVER (w ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING) AS usual FROM ({B.SQL_ORDERS}) WINDOW w AS (PARTITION BY symbol ORDER BY trade_date)),
t AS (SELECT *, abs(c1 - o1) AS x1 FROM b)
SELECT symbol, trade_date, CASE WHEN x > 1.2 * x1 AND x1 > 0.5 * usual AND c1 <= o1 AND c > o AND o < c1 AND c > o1 THEN 1.0::DOUBLE WHEN x > 1.2 * x1 AND x1 > 0.5 * usual AND c1 > o1 AND c <= o AND o > c1 AND c < o1 THEN -1.0::DOUBLE ELSE 0.0::DOUBLE END AS signal FROM t""")
def _pattern_signal(spark, d):
    return patterns.signal(B.bars_orders(spark, d), "engulfing")


# --- back-tests

def _crossed(bars: str = B.SQL_ORDERS, fast: int = 5, slow: int = 20) -> str:
    return f"""SELECT symbol, trade_date, close, rn, CASE WHEN rn >= {slow + 2} AND a1 <= b1 AND a > b THEN 1 WHEN rn >= {slow + 2} AND a1 >= b1 AND a < b THEN -1 ELSE 0 END AS sig, count(*) OVER (PARTITION BY symbol) AS n FROM (SELECT *, lag(a) OVER (PARTITION BY symbol ORDER BY rn) AS a1, lag(b) OVER (PARTITION BY symbol ORDER BY rn) AS b1 FROM (
SELECT symbol, trade_date, close, row_number() OVER w AS rn, avg(close) OVER (w ROWS BETWEEN {fast - 1} PRECEDING AND CURRENT ROW) AS a, avg(close) OVER (w ROWS BETWEEN {slow - 1} PRECEDING AND CURRENT ROW) AS b FROM ({bars}) WINDOW w AS (PARTITION BY symbol ORDER BY trade_date)))"""


def _simulated(crossed: str) -> str:
    return f"""s AS MATERIALIZED ({crossed}),
sim AS (SELECT symbol, rn, n, close, 100000.0::DOUBLE AS cash, 0.0::DOUBLE AS shares, 0.0::DOUBLE AS entry, NULL::DOUBLE AS pnl FROM s WHERE rn = 1
UNION ALL SELECT s.symbol, s.rn, s.n, s.close, CASE WHEN sig = 1 AND shares = 0 THEN 0.0 WHEN sig = -1 AND shares > 0 THEN cash + shares * s.close * 0.999 * (1 - 0.0013) ELSE cash END,
CASE WHEN sig = 1 AND shares = 0 THEN cash / 1.0003 / (s.close * 1.001) WHEN sig = -1 THEN 0.0 ELSE shares END, CASE WHEN sig = 1 AND shares = 0 THEN s.close * 1.001 ELSE entry END,
CASE WHEN sig = -1 AND shares > 0 THEN (s.close * 0.999 - entry) * shares - shares * s.close * 0.999 * 0.0013 END FROM sim JOIN s ON s.symbol = sim.symbol AND s.rn = sim.rn + 1),
e AS (SELECT symbol, rn, n, CASE WHEN rn = n AND shares > 0 THEN cash + shares * close * 0.999 * (1 - 0.0013) ELSE cash + shares * close * 0.999 END AS equity, CASE WHEN rn = n AND shares > 0 THEN (close * 0.999 - entry) * shares - shares * close * 0.999 * 0.0013 ELSE pnl END AS pnl FROM sim)"""


def _measured(crossed: str, value=rounded) -> str:
    """The metrics of each symbol; value: how doubles are shown."""
    return f"""WITH RECURSIVE {_simulated(crossed)},
r AS (SELECT *, equity / lag(equity) OVER w - 1 AS r, max(equity) OVER w AS peak, lag(max_before) OVER w AS before FROM (SELECT *, max(equity) OVER (PARTITION BY symbol ORDER BY rn) AS max_before FROM e) WINDOW w AS (PARTITION BY symbol ORDER BY rn)),
i AS (SELECT *, count_if(before IS NOT NULL AND equity > before) OVER (PARTITION BY symbol ORDER BY rn) AS island, before IS NOT NULL AND equity > before AS risen FROM r),
d AS (SELECT symbol, max(k) AS longest FROM (SELECT symbol, island, count_if(NOT risen) AS k FROM i GROUP BY symbol, island) GROUP BY symbol),
g AS (SELECT symbol, max(n) AS n, arg_max(equity, rn) AS final_equity, min(equity / peak - 1) AS max_drawdown, avg(r) AS mean, stddev_pop(r) AS sd, sqrt(sum(r * r) FILTER (r < 0) / nullif(count_if(r < 0), 0)) AS down,
count(pnl) AS n_trades, count_if(pnl > 0) AS wins, avg(pnl) FILTER (pnl > 0) AS avg_win, -avg(pnl) FILTER (pnl <= 0) AS avg_loss FROM r GROUP BY symbol),
x AS (SELECT *, power(final_equity / 100000, 252.0 / n) - 1 AS annual_return FROM g)
SELECT symbol, n_trades, longest AS max_drawdown_bars, {value('final_equity / 100000 - 1')} AS total_return, {value('annual_return')} AS annual_return, {value('sd * sqrt(252)')} AS annual_volatility, {value('max_drawdown')} AS max_drawdown, {value('CASE WHEN sd > 0 THEN mean / sd * sqrt(252) ELSE 0 END')} AS sharpe,
{value('coalesce(mean / nullif(down, 0) * sqrt(252), 0)')} AS sortino, {value('coalesce(annual_return / nullif(-max_drawdown, 0), 0)')} AS calmar, {value('coalesce(wins / nullif(n_trades, 0), 0)')} AS win_rate, {value('coalesce(coalesce(avg_win, 0) / nullif(avg_loss, 0), 0)')} AS profit_loss_ratio, {value('final_equity')} AS final_equity FROM x JOIN d USING (symbol)"""


_SIMULATED = _simulated(_crossed())


@query("backtest_metrics", _measured(_crossed()))
def _backtest(spark, d):
    whole = ("n_trades", "max_drawdown_bars")
    return backtest.run(B.bars_orders(spark, d), "ma_cross").select("symbol", *whole, *_r(*[m for m in backtest.METRICS if m not in whole]))


@query("backtest_equity", f"WITH RECURSIVE {_SIMULATED} SELECT e.symbol, trade_date, {rounded('equity')} AS equity FROM e JOIN s ON e.symbol = s.symbol AND e.rn = s.rn")
def _equity(spark, d):
    return backtest.equity_curve(B.bars_orders(spark, d), "ma_cross").select("symbol", "trade_date", *_r("equity"))


@query("backtest_trades", f"""WITH RECURSIVE s AS MATERIALIZED (SELECT symbol, trade_date, close, signal, row_number() OVER w AS rn, count(*) OVER (PARTITION BY symbol) AS n FROM ({strategies.plan('turtle').duck(B.SQL_ORDERS, compare=False)}) WINDOW w AS (PARTITION BY symbol ORDER BY trade_date)),
sim AS (SELECT symbol, rn, n, trade_date, close, 100000.0::DOUBLE AS cash, 0.0::DOUBLE AS shares, 0.0::DOUBLE AS entry, NULL::DATE AS entry_date, 0.0::DOUBLE AS sold FROM s WHERE rn = 1
UNION ALL SELECT s.symbol, s.rn, s.n, s.trade_date, s.close, CASE WHEN signal > 0 AND shares = 0 THEN 0.0 WHEN signal < 0 AND shares > 0 THEN cash + shares * s.close * 0.999 * (1 - 0.0013) ELSE cash END,
CASE WHEN signal > 0 AND shares = 0 THEN cash / 1.0003 / (s.close * 1.001) WHEN signal < 0 THEN 0.0 ELSE shares END, CASE WHEN signal > 0 AND shares = 0 THEN s.close * 1.001 ELSE entry END,
CASE WHEN signal > 0 AND shares = 0 THEN s.trade_date ELSE entry_date END, CASE WHEN signal < 0 THEN shares ELSE 0.0 END FROM sim JOIN s ON s.symbol = sim.symbol AND s.rn = sim.rn + 1),
t AS (SELECT *, close * 0.999 AS got, sold AS k FROM sim WHERE sold > 0 UNION ALL SELECT *, close * 0.999, shares FROM sim WHERE rn = n AND shares > 0)
SELECT symbol, entry_date, trade_date AS exit_date, CAST(greatest(1, trade_date - entry_date) AS INTEGER) AS holding_days, {rounded('entry')} AS entry_price, {rounded('got')} AS exit_price, {rounded('k')} AS shares, {rounded('(got - entry) * k - k * got * 0.0013')} AS pnl, {rounded('got / entry - 1')} AS pnl_pct FROM t""")
def _trades(spark, d):
    return backtest.trades(B.bars_orders(spark, d), "turtle").select("symbol", "entry_date", "exit_date", "holding_days", *_r("entry_price", "exit_price", "shares", "pnl", "pnl_pct"))


@query("backtest_monthly", f"WITH RECURSIVE {_SIMULATED}, m AS (SELECT e.symbol, trade_date, equity / lag(equity) OVER (PARTITION BY e.symbol ORDER BY e.rn) - 1 AS r FROM e JOIN s ON e.symbol = s.symbol AND e.rn = s.rn WHERE (e.rn - 1) % 21 = 0) SELECT symbol, trade_date, {rounded('r')} AS return FROM m WHERE r IS NOT NULL")
def _monthly(spark, d):
    return backtest.monthly_returns(B.bars_orders(spark, d), "ma_cross").select("symbol", "trade_date", *_r("return"))


def _searched(bars: str, sets: list[tuple[int, int]]) -> str:
    """Metrics of each symbol and parameter set, with fast, slow and the set's place."""
    one = lambda i, fast, slow: f"SELECT *, {i} AS param_id, {fast}::DOUBLE AS fast, {slow}::DOUBLE AS slow FROM ({_measured(_crossed(bars, fast, slow), str)})"
    return " UNION ALL ".join(one(i, *s) for i, s in enumerate(sets))


@query("grid_search", f"""SELECT symbol, fast, slow, n_trades, max_drawdown_bars, {_rs(*[m for m in backtest.METRICS if m not in ('n_trades', 'max_drawdown_bars')])} FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY sharpe DESC, param_id) AS place FROM ({_searched(B.SQL_ORDERS, [(5, 20), (5, 30), (10, 20), (10, 30)])})) WHERE place = 1""")
def _grid(spark, d):
    best = backtest.grid_search(B.bars_orders(spark, d), "ma_cross", {"fast": [5, 10], "slow": [20, 30]})
    whole = ("n_trades", "max_drawdown_bars")
    return best.select("symbol", F.col("params.fast").alias("fast"), F.col("params.slow").alias("slow"), *whole, *_r(*[m for m in backtest.METRICS if m not in whole]))


@query("genetic_search")
def _genetic(spark, d):
    best, fit = backtest.genetic_search(B.bars_orders(spark, d), "ma_cross", {"fast": (4, 10, 2), "slow": (15, 40, 5)})
    return spark.createDataFrame([(k, v, float(fit)) for k, v in sorted(best.items())], "parameter string, value double, fitness double")


#: Every slice as a series of its own: the windows that a bar lies in are found by trying all of them.
_SLICES = f"""SELECT b.symbol || '|' || win || '|' || CASE WHEN i < win * 63 + 252 THEN 'in' ELSE 'out' END AS symbol, trade_date, close FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY trade_date) - 1 AS i, count(*) OVER (PARTITION BY symbol) AS n FROM ({B.SQL_ORDERS})) b, range(1000) r(win) WHERE i BETWEEN win * 63 AND win * 63 + 314 AND win * 63 + 315 <= n"""
_WALKED = ("in_return", "out_return", "in_sharpe", "out_sharpe", "correlation", "variation", "efficiency")


@query("walk_forward", f"""WITH m AS MATERIALIZED (SELECT split_part(symbol, '|', 1) AS symbol, split_part(symbol, '|', 2) AS win, split_part(symbol, '|', 3) AS part, param_id, fast, annual_return, sharpe FROM ({_searched(_SLICES, [(5, 20), (10, 20)])})),
b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY symbol, win ORDER BY sharpe DESC, param_id) AS place FROM m WHERE part = 'in') WHERE place = 1),
p AS (SELECT b.symbol, b.fast, b.annual_return AS x, b.sharpe AS xs, m.annual_return AS y, m.sharpe AS ys FROM b JOIN m ON m.symbol = b.symbol AND m.win = b.win AND m.param_id = b.param_id AND m.part = 'out'),
g AS (SELECT symbol, count(*) AS windows, avg(x) AS in_return, avg(y) AS out_return, avg(xs) AS in_sharpe, avg(ys) AS out_sharpe, coalesce(covar_pop(x, y) / nullif(stddev_pop(x) * stddev_pop(y), 0), 0) AS correlation, (stddev_pop(fast) / avg(fast) + 0) / 2 AS variation FROM p GROUP BY symbol)
SELECT symbol, windows, {_rs(*_WALKED)}, grade FROM (SELECT *, CASE WHEN abs(in_return) >= 0.0001 THEN out_return / in_return ELSE 0 END AS efficiency, CASE WHEN out_sharpe > 1 AND variation < 0.3 THEN 'excellent' WHEN out_sharpe > 0.5 AND variation < 0.5 THEN 'good' WHEN out_sharpe > 0 THEN 'fair' ELSE 'warning' END AS grade FROM g)""")
def _walk(spark, d):
    found = backtest.walk_forward(B.bars_orders(spark, d), "ma_cross", {"fast": [5, 10], "slow": [20]})
    return backtest.walk_forward_summary(found).select("symbol", "windows", *_r(*_WALKED), "grade")


def _simulations(spark, d, method):
    b = B.bars_orders(spark, d)
    return backtest.monte_carlo_summary(backtest.monte_carlo(backtest.equity_curve(b, "ma_cross", sampled=True), backtest.share_profits(b, "ma_cross"), method))


for _method in backtest.METHODS:
    query(f"monte_carlo_{_method}")(lambda spark, d, method=_method: _simulations(spark, d, method))


# --- distribution

_PROFILE = f"""b AS ({B.SQL_ORDERS}), edge AS (SELECT symbol, min(close) AS lo, max(close) AS hi FROM b GROUP BY symbol HAVING max(close) - min(close) >= 1e-12),
g AS (SELECT symbol, level, sum(close * volume) / sum(volume) AS price, sum(volume) AS volume FROM (SELECT b.symbol, close, volume, CAST(least(floor((close - lo) / ((hi - lo) / 100)), 99) AS INTEGER) AS level FROM b JOIN edge USING (symbol)) GROUP BY 1, 2 HAVING sum(volume) > 0),
k AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY price) AS i, count(*) OVER (PARTITION BY symbol) AS n, sum(volume) OVER (PARTITION BY symbol) AS total, row_number() OVER (PARTITION BY symbol ORDER BY volume DESC, price) = 1 AS is_poc FROM g),
a AS (SELECT symbol, i AS lo, i AS hi, volume AS inside, total, n FROM k WHERE is_poc UNION ALL
SELECT a.symbol, CASE WHEN coalesce(x.volume, -1) >= coalesce(y.volume, -1) THEN lo - 1 ELSE lo END, CASE WHEN coalesce(x.volume, -1) >= coalesce(y.volume, -1) THEN hi ELSE hi + 1 END, inside + greatest(coalesce(x.volume, -1), coalesce(y.volume, -1)), a.total, a.n
FROM a LEFT JOIN k x ON x.symbol = a.symbol AND x.i = a.lo - 1 LEFT JOIN k y ON y.symbol = a.symbol AND y.i = a.hi + 1 WHERE inside < 0.7 * a.total AND hi - lo < a.n - 1),
f AS (SELECT symbol, min(lo) AS lo, max(hi) AS hi FROM a GROUP BY symbol), prof AS (SELECT k.*, i BETWEEN lo AND hi AS in_value_area FROM k JOIN f USING (symbol))"""


@query("volume_profile", f"WITH RECURSIVE {_PROFILE} SELECT symbol, level, is_poc, in_value_area, {_rs('price', 'volume')} FROM prof")
def _profile(spark, d):
    return distribution.volume_profile(B.bars_orders(spark, d)).select("symbol", "level", "is_poc", "in_value_area", *_r("price", "volume"))


@query("value_area", f"WITH RECURSIVE {_PROFILE} SELECT symbol, {rounded('max(price) FILTER (is_poc)')} AS poc, {rounded('min(price) FILTER (in_value_area)')} AS val, {rounded('max(price) FILTER (in_value_area)')} AS vah FROM prof GROUP BY symbol")
def _value_area(spark, d):
    return distribution.value_area(distribution.volume_profile(B.bars_orders(spark, d))).select("symbol", *_r("poc", "val", "vah"))


@query("volume_levels", f"""WITH RECURSIVE {_PROFILE}, z AS (SELECT symbol, arg_max(close, trade_date) AS last FROM b GROUP BY symbol), m AS (SELECT *, avg(volume) OVER (PARTITION BY symbol) AS mean FROM prof JOIN z USING (symbol))
SELECT symbol, {_rs('price', 'volume')}, kind FROM (SELECT symbol, price, volume, CASE WHEN price > last THEN 'resistance' ELSE 'support' END AS kind FROM m WHERE volume > 1.5 * mean UNION ALL SELECT symbol, price, volume, 'poc' FROM m WHERE is_poc)""")
def _levels(spark, d):
    b = B.bars_orders(spark, d)
    return distribution.sr_levels(distribution.volume_profile(b), b).select("symbol", *_r("price", "volume"), "kind")


#: Chips by the definition: each bar's volume times the product over all later bars.
_CHIPS = f"""b AS (SELECT *, least(greatest(coalesce(turnover, 0.02), 0), 1)::DOUBLE AS t, min(low) OVER (PARTITION BY symbol) AS lo, max(high) OVER (PARTITION BY symbol) AS hi, row_number() OVER (PARTITION BY symbol ORDER BY trade_date) AS i, count(*) OVER (PARTITION BY symbol) AS n FROM ({B.SQL_ORDERS})),
kept AS (SELECT symbol, i, n, close, volume, lo, hi, 1.0::DOUBLE AS left, t FROM b WHERE i = n UNION ALL SELECT b.symbol, b.i, b.n, b.close, b.volume, b.lo, b.hi, kept.left * (1 - kept.t), b.t FROM kept JOIN b ON b.symbol = kept.symbol AND b.i = kept.i - 1),
lev AS (SELECT symbol, CASE WHEN hi > lo THEN CAST(least(floor((close - lo) / ((hi - lo) / 100)), 99) AS INTEGER) ELSE 0 END AS level, sum(volume * "left") AS c FROM kept GROUP BY 1, 2),
edge AS (SELECT symbol, any_value(lo) AS lo, any_value(hi) AS hi, arg_max(close, trade_date) AS last_price, sum(close * volume * (1 - t)) / nullif(sum(volume * (1 - t)), 0) AS mean FROM b GROUP BY symbol),
chips AS (SELECT edge.symbol, x.level, lo + (hi - lo) / 100 * (x.level + 0.5) AS price, coalesce(100 * c / sum(c) OVER (PARTITION BY edge.symbol), 0) AS chips, last_price, mean FROM edge CROSS JOIN (SELECT unnest(range(100))::INTEGER AS level) x LEFT JOIN lev ON lev.symbol = edge.symbol AND lev.level = x.level)"""


@query("cost_distribution", f"WITH RECURSIVE {_CHIPS} SELECT symbol, level, {_rs('price', 'chips')} FROM chips")
def _cost(spark, d):
    return distribution.cost_distribution(B.bars_orders(spark, d)).select("symbol", "level", *_r("price", "chips"))


@query("profit_and_loss", f"""WITH RECURSIVE {_CHIPS} SELECT symbol, {rounded('sum(CASE WHEN price < last_price THEN chips ELSE 0 END) / sum(chips) * 100')} AS profit_pct, {rounded('100 - sum(CASE WHEN price < last_price THEN chips ELSE 0 END) / sum(chips) * 100')} AS loss_pct,
{rounded('coalesce(any_value(mean), any_value(last_price))')} AS avg_cost, {rounded('sum(price * chips) / sum(chips)')} AS weighted_avg_cost, {rounded('any_value(last_price)')} AS last_price FROM chips GROUP BY symbol""")
def _profit(spark, d):
    b = B.bars_orders(spark, d)
    return distribution.profit_ratio(distribution.cost_distribution(b), b).select("symbol", *_r("profit_pct", "loss_pct", "avg_cost", "weighted_avg_cost", "last_price"))


@query("chip_concentration", f"""WITH RECURSIVE {_CHIPS}, r AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY chips DESC, level) AS k FROM chips), g AS (SELECT symbol, sum(chips) FILTER (k <= 5) AS cr5, sum(chips) FILTER (k <= 10) AS cr10, sum(chips) FILTER (k <= 20) AS cr20, least(sum(chips * chips) / 100, 100) AS trend FROM r GROUP BY symbol)
SELECT symbol, {_rs('cr5', 'cr10', 'cr20', 'trend')}, CASE WHEN trend > 60 THEN 'high' WHEN trend > 35 THEN 'medium' WHEN trend > 15 THEN 'low' ELSE 'scattered' END AS description FROM g""")
def _concentration(spark, d):
    return distribution.concentration(distribution.cost_distribution(B.bars_orders(spark, d))).select("symbol", *_r("cr5", "cr10", "cr20", "trend"), "description")


def _parts(ends: str) -> str:
    """Chips of parts of the history: ``ends`` gives symbol and i of the last bars of the parts from ``b``."""
    return f"""b AS MATERIALIZED (SELECT *, min(low) OVER w AS lo, max(high) OVER w AS hi, sum(close * volume * (1 - t)) OVER w AS paid, sum(volume * (1 - t)) OVER w AS weight, count(*) OVER (PARTITION BY symbol) AS n FROM (SELECT *, least(greatest(coalesce(turnover, 0.02), 0), 1)::DOUBLE AS t, row_number() OVER (PARTITION BY symbol ORDER BY trade_date) AS i FROM ({B.SQL_ORDERS})) WINDOW w AS (PARTITION BY symbol ORDER BY i)),
e AS MATERIALIZED (SELECT symbol, i AS e, n, trade_date, close AS last_price, lo, hi, CASE WHEN weight > 0 THEN paid / weight ELSE close END AS avg_cost FROM b JOIN ({ends}) USING (symbol, i)),
kept AS (SELECT symbol, e, e AS i, 1.0::DOUBLE AS "left" FROM e UNION ALL SELECT kept.symbol, e, kept.i - 1, "left" * (1 - t) FROM kept JOIN b ON b.symbol = kept.symbol AND b.i = kept.i WHERE kept.i > 1),
lev AS (SELECT symbol, e, CASE WHEN e.hi > e.lo THEN CAST(least(floor((close - e.lo) / ((e.hi - e.lo) / 100)), 99) AS INTEGER) ELSE 0 END AS level, sum(volume * "left") AS c FROM kept JOIN b USING (symbol, i) JOIN e USING (symbol, e) GROUP BY 1, 2, 3),
chips AS (SELECT e.*, x.level, e.lo + (e.hi - e.lo) / 100 * (x.level + 0.5) AS price, coalesce(100 * c / sum(c) OVER (PARTITION BY e.symbol, e.e), 0) AS chips FROM e CROSS JOIN (SELECT unnest(range(100))::INTEGER AS level) x LEFT JOIN lev ON lev.symbol = e.symbol AND lev.e = e.e AND lev.level = x.level)"""


@query("moving_cost", f"""WITH RECURSIVE {_parts('SELECT symbol, i FROM b WHERE i > n - 60')} SELECT symbol, trade_date, {rounded('any_value(avg_cost)')} AS avg_cost, {rounded('CASE WHEN sum(chips) > 0 THEN sum(price * chips) / sum(chips) ELSE any_value(avg_cost) END')} AS weighted_avg_cost FROM chips GROUP BY symbol, trade_date""")
def _moving(spark, d):
    return distribution.moving_distribution(B.bars_orders(spark, d)).select("symbol", "trade_date", *_r("avg_cost", "weighted_avg_cost"))


_FRAME_ENDS = "SELECT DISTINCT symbol, least((frame + 1) * greatest(n // 30, 1), n) AS i FROM b, range(30) f(frame) WHERE n >= 20"


@query("cost_frames", f"""WITH RECURSIVE {_parts(_FRAME_ENDS)}, p AS (SELECT symbol, e, CASE WHEN sum(chips) > 0 THEN 100 * sum(CASE WHEN price < last_price THEN chips ELSE 0 END) / sum(chips) ELSE 50 END AS profit_pct FROM chips GROUP BY symbol, e)
SELECT symbol, CAST(frame AS INTEGER) AS frame, trade_date, CAST(n - e AS INTEGER) AS ago, level, {_rs('avg_cost', 'profit_pct')}, {rounded('100 - profit_pct')} AS loss_pct, {_rs('price', 'chips')} FROM chips JOIN p USING (symbol, e) JOIN range(30) f(frame) ON e = least((frame + 1) * greatest(n // 30, 1), n)""")
def _frames(spark, d):
    return distribution.historical_frames(B.bars_orders(spark, d)).select("symbol", "frame", "trade_date", "ago", "level", *_r("avg_cost", "profit_pct", "loss_pct", "price", "chips"))


# --- risk

_RETURNS = f"SELECT symbol, trade_date, r FROM (SELECT symbol, trade_date, CASE WHEN lag(close) OVER (PARTITION BY symbol ORDER BY trade_date) > 0 THEN ln(close / lag(close) OVER (PARTITION BY symbol ORDER BY trade_date)) END AS r FROM ({B.SQL_ORDERS})) WHERE r IS NOT NULL"
_MARKET = f"SELECT trade_date, avg(r) AS m FROM ({_RETURNS}) GROUP BY trade_date"


FIVE = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
_RISKS = ("total_return", "annual_return", "volatility", "sharpe", "sortino", "max_drawdown", "var_95", "cvar_95", "var_99", "cvar_99", "calmar", "best_day", "worst_day")


@query("risk_metrics", f"""WITH x AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY r, trade_date) - 1 AS i, count(*) OVER (PARTITION BY symbol) AS n, sum(r) OVER (PARTITION BY symbol ORDER BY trade_date) AS s FROM ({_RETURNS})),
y AS (SELECT *, greatest(max(s) OVER (PARTITION BY symbol ORDER BY trade_date), 0) - s AS fall FROM x),
g AS (SELECT symbol, count(*) AS n, product(1 + r) - 1 AS total_return, avg(r) * 252 AS annual_return, stddev_pop(r) * sqrt(252) AS volatility, max(fall) AS max_drawdown, sqrt(avg(power(least(r - 0.02 / 252, 0), 2))) * sqrt(252) AS down,
max(r) FILTER (i = floor(n * 0.05)) AS var_95, coalesce(avg(r) FILTER (i < floor(n * 0.05)), max(r) FILTER (i = floor(n * 0.05))) AS cvar_95, max(r) FILTER (i = floor(n * 0.01)) AS var_99, coalesce(avg(r) FILTER (i < floor(n * 0.01)), max(r) FILTER (i = floor(n * 0.01))) AS cvar_99,
count_if(r > 0) AS positive_days, count_if(r < 0) AS negative_days, max(r) AS best_day, min(r) AS worst_day FROM y GROUP BY symbol),
h AS (SELECT *, (annual_return - 0.02) / volatility AS sharpe, (annual_return - 0.02) / down AS sortino, annual_return / max_drawdown AS calmar FROM g) SELECT symbol, n, positive_days, negative_days, {_rs(*_RISKS)} FROM h""")
def _risk(spark, d):
    return risk.metrics(risk.returns(B.bars_orders(spark, d))).select("symbol", "n", "positive_days", "negative_days", *_r(*_RISKS))


@query("beta_alpha", f"SELECT symbol, {rounded('covar_pop(r, m) / var_pop(m)')} AS beta, {rounded('avg(r) - 0.02 / 252 - covar_pop(r, m) / var_pop(m) * (avg(m) - 0.02 / 252)')} AS alpha FROM ({_RETURNS}) JOIN ({_MARKET}) USING (trade_date) GROUP BY symbol")
def _beta(spark, d):
    r = risk.returns(B.bars_orders(spark, d))
    return risk.beta_alpha(r, risk.market(r)).select("symbol", *_r("beta", "alpha"))


@query("equal_weight", f"SELECT trade_date, {rounded('m')} AS m FROM ({_MARKET})")
def _equal(spark, d):
    return risk.market(risk.returns(B.bars_orders(spark, d))).select("trade_date", *_r("m"))


@query("correlation_matrix", f"SELECT x.symbol AS a, y.symbol AS b, {rounded('corr(x.r, y.r)')} AS corr, {rounded('covar_samp(x.r, y.r)')} AS cov, count(*) AS n FROM ({_RETURNS}) x JOIN ({_RETURNS}) y ON x.trade_date = y.trade_date AND x.symbol <= y.symbol GROUP BY 1, 2")
def _pairs(spark, d):
    return risk.pairs(risk.returns(B.bars_orders(spark, d)), FIVE).select("a", "b", *_r("corr", "cov"), "n")


@query("max_drawdown", f"SELECT symbol, {rounded('max(1 - close / peak)')} AS max_drawdown FROM (SELECT symbol, close, max(close) OVER (PARTITION BY symbol ORDER BY trade_date) AS peak FROM ({B.SQL_ORDERS})) GROUP BY symbol")
def _drawdown(spark, d):
    return risk.max_drawdown(B.bars_orders(spark, d)).select("symbol", *_r("max_drawdown"))


@query("rolling_beta", f"SELECT symbol, trade_date, {rounded('CASE WHEN count(r) OVER w = 60 THEN coalesce(covar_pop(r, m) OVER w / nullif(var_pop(m) OVER w, 0), 1) END')} AS beta FROM ({_RETURNS}) JOIN ({_MARKET}) USING (trade_date) WINDOW w AS (PARTITION BY symbol ORDER BY trade_date ROWS BETWEEN 59 PRECEDING AND CURRENT ROW)")
def _rolling_beta(spark, d):
    r = risk.returns(B.bars_orders(spark, d))
    return risk.rolling_beta(r, risk.market(r)).select("symbol", "trade_date", *_r("beta"))


@query("rolling_metrics", f"""WITH x AS (SELECT symbol, trade_date, list(r) OVER w AS rs, avg(r) OVER w AS mean, stddev_pop(r) OVER w AS sd FROM ({_RETURNS}) WINDOW w AS (PARTITION BY symbol ORDER BY trade_date ROWS BETWEEN 59 PRECEDING AND CURRENT ROW)),
y AS (SELECT *, list_sort(rs) AS s, list_transform(range(1, 61), lambda i: list_sum(rs[1:i])) AS c FROM x WHERE len(rs) = 60),
z AS (SELECT symbol, trade_date, list_product(list_transform(rs, lambda v: 1 + v)) - 1 AS total_return, mean * 252 AS annual_return, sd * sqrt(252) AS volatility, list_max(list_transform(range(1, 61), lambda i: greatest(list_max(c[1:i]), 0) - c[i])) AS max_drawdown,
sqrt(list_avg(list_transform(rs, lambda v: power(least(v - 0.02 / 252, 0), 2)))) * sqrt(252) AS down, s[4] AS var_95, list_avg(s[1:3]) AS cvar_95, s[1] AS var_99, s[1] AS cvar_99, s[60] AS best_day, s[1] AS worst_day,
len(list_filter(rs, lambda v: v > 0)) AS positive_days, len(list_filter(rs, lambda v: v < 0)) AS negative_days FROM y),
q AS (SELECT *, coalesce((annual_return - 0.02) / nullif(volatility, 0), 0) AS sharpe, coalesce((annual_return - 0.02) / nullif(down, 0), 0) AS sortino, coalesce(annual_return / nullif(max_drawdown, 0), 0) AS calmar FROM z)
SELECT symbol, trade_date, positive_days::INTEGER AS positive_days, negative_days::INTEGER AS negative_days, {_rs(*_RISKS)} FROM q""")
def _rolling(spark, d):
    return risk.rolling(risk.returns(B.bars_orders(spark, d))).select("symbol", "trade_date", "positive_days", "negative_days", *_r(*_RISKS))


@query("price_correlation", f"SELECT x.symbol AS a, y.symbol AS b, {rounded('corr(x.close, y.close)')} AS corr, count(*) AS n FROM ({B.SQL_ORDERS}) x JOIN ({B.SQL_ORDERS}) y ON x.trade_date = y.trade_date AND x.symbol <= y.symbol GROUP BY 1, 2 HAVING count(*) >= 20")
def _prices(spark, d):
    return risk.price_correlation(B.bars_orders(spark, d), FIVE).select("a", "b", *_r("corr"), "n")


@query("portfolio_concentration", f"SELECT industry, {rounded('value')} AS value, round(100 * value / sum(value) OVER (), 2) AS weight FROM (SELECT c_mktsegment AS industry, sum(o_totalprice) AS value FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1)")
def _held(spark, d):
    h = B.table(spark, d, "orders").join(B.table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).select(F.col("c_mktsegment").alias("industry"), F.col("o_totalprice").alias("value"))
    return risk.concentration(h).select("industry", *_r("value"), "weight")


@query("attribution", f"WITH p AS (SELECT n_name AS holding, sum(c_acctbal) AS pnl FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1) SELECT holding, {rounded('pnl')} AS pnl, {rounded('pnl / nullif((SELECT sum(pnl) FROM p), 0)')} AS share FROM p")
def _attribution(spark, d):
    p = B.table(spark, d, "customer").join(B.table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).groupBy(F.col("n_name").alias("holding")).agg(F.sum("c_acctbal").alias("pnl"))
    return risk.attribution(p).select("holding", *_r("pnl", "share"))


@query("replay_score", f"SELECT symbol, count(*) AS total, count_if((close > open) = (ahead >= close)) AS correct FROM (SELECT *, lead(close) OVER (PARTITION BY symbol ORDER BY trade_date) AS ahead FROM ({B.SQL_ORDERS})) WHERE ahead IS NOT NULL GROUP BY symbol")
def _replay(spark, d):
    b = B.bars_orders(spark, d)
    return risk.replay_score(b, b.select("symbol", "trade_date", (F.col("close") > F.col("open")).alias("bull")))


@query("portfolio_var", f"""WITH p AS (SELECT trade_date, sum(r * 0.2) AS p FROM ({_RETURNS}) GROUP BY trade_date HAVING count(*) = 5), k AS (SELECT p, row_number() OVER (ORDER BY p, trade_date) AS i, count(*) OVER () AS days FROM p)
SELECT days, {rounded('-p')} AS var FROM k WHERE i = greatest(ceil(days * 0.05 - 1e-9), 1)""")
def _var(spark, d):
    return risk.portfolio_var(risk.returns(B.bars_orders(spark, d)), dict.fromkeys(FIVE, 0.2)).select("days", *_r("var"))


_TWO = f"SELECT avg(x.r) AS m1, avg(y.r) AS m2, var_samp(x.r) AS v1, var_samp(y.r) AS v2, covar_samp(x.r, y.r) AS c FROM ({_RETURNS}) x JOIN ({_RETURNS}) y ON x.trade_date = y.trade_date AND x.symbol = '1-URGENT' AND y.symbol = '2-HIGH'"


@query("min_variance", f"SELECT {rounded('w')} AS w1, {rounded('1 - w')} AS w2 FROM (SELECT least(greatest((v2 - c) / (v1 + v2 - 2 * c), 0), 1) AS w FROM ({_TWO}))")
def _least_variance(spark, d):
    return risk.min_variance(risk.returns(B.bars_orders(spark, d)), "1-URGENT", "2-HIGH").select(*_r("w1", "w2"))


@query("efficient_frontier", f"SELECT {rounded('w')} AS weight, {rounded('w * m1 + (1 - w) * m2')} AS return, {rounded('sqrt(w * w * v1 + (1 - w) * (1 - w) * v2 + 2 * w * (1 - w) * c)')} AS risk FROM ({_TWO}) CROSS JOIN (SELECT unnest(range(21)) / 20 AS w)")
def _frontier(spark, d):
    return risk.frontier(risk.returns(B.bars_orders(spark, d)), "1-URGENT", "2-HIGH").select(*_r("weight", "return", "risk"))


# --- search

@query("regime_features", f"""WITH r AS ({_RETURNS}), day AS (SELECT trade_date, avg(r) AS m, stddev_pop(r) AS spread FROM r GROUP BY trade_date HAVING count(*) = (SELECT count(DISTINCT symbol) FROM r)), x AS (SELECT r.* FROM r JOIN day USING (trade_date)),
v AS (SELECT trade_date, avg(sd) * sqrt(252) AS cs_vol FROM (SELECT trade_date, stddev_pop(r) OVER (PARTITION BY symbol ORDER BY trade_date ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS sd FROM x) GROUP BY trade_date),
c AS (SELECT trade_date, avg(c) AS mean_corr FROM (SELECT trade_date, coalesce(covar_pop(a, b) OVER w / nullif(stddev_pop(a) OVER w * stddev_pop(b) OVER w, 0), 0) AS c FROM (SELECT x.trade_date, x.symbol AS s, y.symbol AS t, x.r AS a, y.r AS b FROM x JOIN x y ON x.trade_date = y.trade_date AND x.symbol < y.symbol) WINDOW w AS (PARTITION BY s, t ORDER BY trade_date ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)) GROUP BY trade_date),
d AS (SELECT trade_date, m, cs_vol, mean_corr, spread, row_number() OVER (ORDER BY trade_date) AS i, product(1 + m) OVER (ORDER BY trade_date) AS value FROM day JOIN v USING (trade_date) JOIN c USING (trade_date)),
f AS (SELECT trade_date, m, cs_vol, mean_corr, CASE WHEN avg(cs_vol) OVER (ORDER BY trade_date) > 1e-10 THEN cs_vol / avg(cs_vol) OVER (ORDER BY trade_date) ELSE 1 END AS vol_ratio, CASE WHEN i > 60 THEN avg(m) OVER q * 252 / (stddev_pop(m) OVER q * sqrt(252)) ELSE 0 END AS trend,
CASE WHEN max(value) OVER y > 0 THEN value / max(value) OVER y - 1 ELSE 0 END AS drawdown, avg(spread) OVER (ORDER BY trade_date ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS dispersion FROM d WINDOW q AS (ORDER BY trade_date ROWS BETWEEN 59 PRECEDING AND CURRENT ROW), y AS (ORDER BY trade_date ROWS BETWEEN 251 PRECEDING AND CURRENT ROW))
SELECT trade_date, {_rs('m', *search.FEATURES)} FROM f""")
def _regimes(spark, d):
    return search.regime_features(risk.returns(B.bars_orders(spark, d))).select("trade_date", *_r("m", *search.FEATURES))


@query("portfolio_search")
def _search(spark, d):
    """Projected Sharpe ratios of every weighting for the pool of all five and for greedy pools."""
    r = search.matrix(risk.returns(B.bars_orders(spark, d)), FIVE)
    pools = {"all": r} | {",".join(FIVE[i] for i in p): r[:, p] for p, _, _ in search.diverse_pools(r, 2, 2)}
    return spark.createDataFrame(search.caps(pools), "pool string, strategy string, projected_sharpe double, assets int")


@query("diverse_pools")
def _pools(spark, d):
    return gram.diverse_pools(risk.returns(B.bars_orders(spark, d)), 2, 2)


_RETURNS_WIDE = _RETURNS.replace(B.SQL_ORDERS, B.SQL_CUSTOMERS)


@query("correlated_pairs", f"SELECT x.symbol AS a, y.symbol AS b, {rounded('corr(x.r, y.r)')} AS corr, {rounded('covar_samp(x.r, y.r)')} AS cov, count(*) AS n FROM ({_RETURNS_WIDE}) x JOIN ({_RETURNS_WIDE}) y ON x.trade_date = y.trade_date AND x.symbol < y.symbol GROUP BY 1, 2 HAVING count(*) >= 20 AND abs(corr(x.r, y.r)) >= 0.1")
def _correlated(spark, d):
    """The pairs of a wide universe that are correlated by a tenth or more, from tiles of 16 symbols."""
    return gram.correlated(risk.returns(B.bars_customers(spark, d)), least=0.1, days=20, tile=16).select("a", "b", *_r("corr", "cov"), "n")


@query("greedy_pool")
def _greedy(spark, d):
    """Twelve of a wide universe, one pass a pick."""
    found = gram.greedy(risk.returns(B.bars_customers(spark, d)), 12)
    return spark.createDataFrame([(i + 1, s, q, c) for i, (s, q, c) in enumerate(found)], "place int, symbol string, quality double, correlations double")


@query("loewdin")
def _loewdin(spark, d):
    """The correlations of five symbols, orthogonalised."""
    m = search.loewdin(search.correlation(search.matrix(risk.returns(B.bars_orders(spark, d)), FIVE)))
    return spark.createDataFrame([(a, b, float(m[i, j])) for i, a in enumerate(FIVE) for j, b in enumerate(FIVE)], "a string, b string, value double")


@query("regimes")
def _clusters(spark, d):
    return search.regimes(search.regime_features(risk.returns(B.bars_orders(spark, d))))


@query("mars")
def _mars(spark, d):
    """The strategy of each regime, among weightings of the five symbols."""
    r = risk.returns(B.bars_orders(spark, d))
    labels = search.regimes(search.regime_features(r)).orderBy("trade_date").select("regime").toPandas()["regime"].to_numpy()
    x = search.matrix(r, FIVE)
    import numpy as np

    cov, mean = np.cov(x.T), x.mean(axis=0)
    current, best, sizes = search.mars(labels, {s: x @ search.weights(cov, mean, s) for s in search.WEIGHTS})
    return spark.createDataFrame([(k, best[k], sizes[k], k == current) for k in best], "regime int, strategy string, days int, current boolean")


@query("meta_search")
def _meta(spark, d):
    """Thirty steps, each scored by the projected Sharpe ratio of a weighting that the node's ensemble stands for."""
    r = search.matrix(risk.returns(B.bars_orders(spark, d)), FIVE)
    stand_in = dict(zip(search.DIMENSIONS["ensemble"], ("equal_weight", "risk_parity", "min_variance"), strict=True))
    meta = search.MetaSearch()
    for _ in range(30):
        node = meta.select()
        meta.record(node, search.projected_sharpe(r, stand_in[node["ensemble"]]) or 0.0)
    return spark.createDataFrame([(i, *n.values(), float(v)) for i, (n, v) in enumerate(meta.tried)], "round int, alpha_tier string, objective string, ensemble string, factor_subset string, sharpe double")


# --- another series, given signals, weighted portfolios

@query("correlation_between", f"""WITH b AS ({B.SQL_ORDERS}), x AS (SELECT b.symbol, b.trade_date, CASE WHEN o.close IS NOT NULL THEN b.close END AS x, o.close AS y FROM b LEFT JOIN b o ON o.trade_date = b.trade_date AND o.symbol = '2-HIGH')
SELECT symbol, trade_date, {rounded('CASE WHEN count(x) OVER w = 20 THEN covar_pop(x, y) OVER w END / nullif(stddev_pop(x) OVER w * stddev_pop(y) OVER w, 0)')} AS correlation FROM x WINDOW w AS (PARTITION BY symbol ORDER BY trade_date ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)""")
def _between(spark, d):
    b = B.bars_orders(spark, d)
    return indicators.plan({"correlation": {"period": 20, "col": 1}}).spark(indicators.beside(b, b.filter("symbol = '2-HIGH'")), compare=True)


@query("backtest_signals", SQL["backtest_metrics"])
def _given(spark, d):
    """The signals of a strategy, written down and given back."""
    b, whole = B.bars_orders(spark, d), ("n_trades", "max_drawdown_bars")
    given = strategies.signals(b, "ma_cross").select("symbol", "trade_date", "signal")
    return backtest.run_with_signals(b, given).select("symbol", *whole, *_r(*[m for m in backtest.METRICS if m not in whole]))


#: The script's crossings are there from the bar on that has both averages' former values.
@query("backtest_script", SQL["backtest_metrics"].replace("rn >= 22 AND", "rn >= 21 AND"))
def _backtest_script(spark, d):
    whole = ("n_trades", "max_drawdown_bars")
    source = "let f = sma(close, 5); let s = sma(close, 20); plot buy = cross(f, s); plot sell = cross(s, f);"
    return backtest.run_script(B.bars_orders(spark, d), source).select("symbol", *whole, *_r(*[m for m in backtest.METRICS if m not in whole]))


_WEIGHTS = [("1-URGENT", 0.4), ("2-HIGH", 0.3), ("5-LOW", 0.5)]
_WEIGHTED = f"SELECT trade_date, sum(r * w) AS r FROM ({_RETURNS}) JOIN (VALUES ('1-URGENT', 0.4::DOUBLE), ('2-HIGH', 0.3), ('5-LOW', 0.5)) v(symbol, w) USING (symbol) GROUP BY trade_date HAVING count(*) = 3"


@query("portfolio_weighted", f"SELECT trade_date, {rounded('r')} AS r FROM ({_WEIGHTED})")
def _weighted(spark, d):
    return risk.weighted(risk.returns(B.bars_orders(spark, d)), spark.createDataFrame(_WEIGHTS, "symbol string, weight double")).select("trade_date", *_r("r"))


@query("portfolio_metrics", SQL["risk_metrics"].replace(_RETURNS, f"SELECT 'portfolio' AS symbol, trade_date, r FROM ({_WEIGHTED})"))
def _portfolio_metrics(spark, d):
    m = risk.portfolio_metrics(risk.returns(B.bars_orders(spark, d)), spark.createDataFrame(_WEIGHTS, "symbol string, weight double"))
    return m.select("symbol", "n", "positive_days", "negative_days", *_r(*_RISKS))


# --- series in blocks

@query("recurrence_blocks", f"""WITH x AS (SELECT l_extendedprice AS v, row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) - 1 AS t FROM lineitem),
y AS (SELECT a.t, a.t // 1000 AS part, sum(b.v * CASE WHEN b.t = 0 THEN pow(11/13::DOUBLE, a.t) ELSE 2/13::DOUBLE * pow(11/13::DOUBLE, a.t - b.t) END) AS ema FROM x a JOIN x b ON b.t BETWEEN a.t - 250 AND a.t GROUP BY a.t)
SELECT part, count(*) AS n, {rounded('avg(ema)')} AS mean, {rounded('min(ema)')} AS low, {rounded('max(ema)')} AS high FROM y GROUP BY part""")
def _recurrence(spark, d):
    """The exponential average over all sales as one series, which no task holds; summed up by thousands.  The place of a sale is
    its rank among all, by prefix counts."""
    line = B.table(spark, d, "lineitem")
    place = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"]
    at = blocks.numbered(line.select(*place), place)
    y = blocks.recurrences(at.select(F.lit("all").alias("symbol"), F.col("_row").alias("t"), F.col("l_extendedprice").alias("v")), {"ema": Recurrence("v", 2 / 13, 11 / 13)}, order="t")
    return y.groupBy(F.floor(F.col("t") / 1000).alias("part")).agg(F.count("*").alias("n"), F.avg("ema").alias("mean"), F.min("ema").alias("low"), F.max("ema").alias("high")).select("part", "n", *_r("mean", "low", "high"))


@query("quantile_blocks", """WITH r AS (SELECT l_returnflag AS symbol, l_extendedprice AS x, row_number() OVER (PARTITION BY l_returnflag ORDER BY l_extendedprice) - 1 AS i, count(*) OVER (PARTITION BY l_returnflag) AS n FROM lineitem)
SELECT symbol, max(n) AS n, max(x) FILTER (i = floor(0.01 * (n - 1) + 0.5)) AS q1, max(x) FILTER (i = floor(0.5 * (n - 1) + 0.5)) AS q50, max(x) FILTER (i = floor(0.99 * (n - 1) + 0.5)) AS q99 FROM r GROUP BY symbol""")
def _quantiles(spark, d):
    x = B.table(spark, d, "lineitem").select(F.col("l_returnflag").alias("symbol"), F.col("l_extendedprice").alias("x"))
    return blocks.quantiles(x, "x", {f"q{round(100 * q)}": blocks.nearest(q) for q in (0.01, 0.5, 0.99)})


@query("rank_blocks", """SELECT symbol, x, count(*) AS count, min(r) - 1 AS below, any_value(n) AS n FROM (SELECT l_returnflag AS symbol, l_quantity AS x, rank() OVER (PARTITION BY l_returnflag ORDER BY l_quantity) AS r, count(*) OVER (PARTITION BY l_returnflag) AS n FROM lineitem) GROUP BY symbol, x""")
def _ranks(spark, d):
    return blocks.ranks(B.table(spark, d, "lineitem").select(F.col("l_returnflag").alias("symbol"), F.col("l_quantity").alias("x")), "x")


@query("tail_blocks", f"""WITH k AS (SELECT symbol, r, row_number() OVER (PARTITION BY symbol ORDER BY r) - 1 AS i, count(*) OVER (PARTITION BY symbol) AS n FROM ({_RETURNS}))
SELECT symbol, max(n) AS n, {rounded('max(r) FILTER (i = floor(n * 0.05))')} AS var, {rounded('coalesce(avg(r) FILTER (i < floor(n * 0.05)), max(r) FILTER (i = floor(n * 0.05)))')} AS cvar FROM k GROUP BY symbol""")
def _tail(spark, d):
    return blocks.tail(risk.returns(B.bars_orders(spark, d)), "r", 0.05).select("symbol", "n", *_r("var", "cvar"))


# --- tables that are written to, and streams

@query("table_inserts", f"""WITH b AS ({B.SQL_ORDERS}), x AS (SELECT count(*) AS n, count_if(trade_date < DATE '1996-01-01') AS old, count(DISTINCT date_trunc('year', trade_date)) AS years, count(DISTINCT CASE WHEN trade_date < DATE '1996-01-01' THEN date_trunc('year', trade_date) END) AS old_years FROM b)
SELECT 0 AS batch, old AS inserted, 0 AS skipped, old_years AS partitions, old AS rows FROM x UNION ALL SELECT 1, n - old, old, years, n FROM x UNION ALL SELECT 2, n - old, old, years, n FROM x""")
def _inserts(spark, d):
    """Bars before 1996, then all, then all again as the same batch: what each did and how many rows there are."""
    b = B.bars_orders(spark, d)
    t = tables.KeyedTable(spark, shared.folder(spark, "table"), B.SCHEMA, ("symbol", "trade_date"), "date_format(trade_date, 'yyyy')")
    rows = []
    for i, (new, number) in enumerate(((b.filter("trade_date < DATE '1996-01-01'"), 0), (b, 1), (b, 1))):
        c = t.insert_or_ignore(new, number)
        rows.append((i, c.inserted, c.skipped, c.partitions, t.read().count()))
    return spark.createDataFrame(rows, "batch int, inserted long, skipped long, partitions long, rows long")


@query("table_upserts", SQL["upsert"])
def _upserts(spark, d):
    b = B.bars_orders(spark, d).select("symbol", "trade_date", "close")
    t = tables.KeyedTable(spark, shared.folder(spark, "table"), "symbol string, trade_date date, close double", ("symbol", "trade_date"), "date_format(trade_date, 'yyyy')")
    t.insert_or_ignore(b)
    t.upsert(b.filter("trade_date >= DATE '1996-01-01'").withColumn("close", F.col("close") + 1))
    return t.read().select("symbol", "trade_date", "close")


_LIVE = indicators.plan({"ema": {}, "rsi": {}, "macd": {}, "atr": {}})


def _in_two(spark, bars: DataFrame, run) -> str:
    """Calls run twice, with a folder that a stream reads: first with half of the hours in it, then with all."""
    at = shared.folder(spark, "bars")
    middle = bars.agg(F.percentile_approx(F.unix_timestamp("trade_date"), 0.5)).first()[0]
    for early in (True, False):
        part = bars.filter((F.unix_timestamp("trade_date") < middle) == early)
        part.withColumnRenamed("trade_date", "ts").write.mode("append").parquet(at)
        run(at)
    return at


@query("stream_indicators", _LIVE.duck(B.SQL_EVENTS))
def _stream_indicators(spark, d):
    """Hourly bars as a stream that is stopped half way and started again."""
    live.use_rocksdb(spark)
    out, at = shared.folder(spark, "out"), shared.folder(spark, "checkpoint")
    schema = B.SCHEMA.replace("trade_date date", "ts timestamp")
    _in_two(spark, B.bars_events(spark, d), lambda path: S.run_available(live.indicators(spark.readStream.schema(schema).parquet(path), _LIVE), out, at))
    return spark.read.parquet(out).select("symbol", F.col("ts").alias("trade_date"), *_r(*_LIVE.outputs))


@query("late_indicators", _LIVE.duck(B.SQL_EVENTS))
def _late(spark, d):
    """Every seventh hour's bars come after all others, in two batches, the second of which is repeated."""
    b = B.bars_events(spark, d)
    t = late.LiveIndicators(spark, shared.folder(spark, "live"), _LIVE, "timestamp", "date_format(date_trunc('week', trade_date), 'yyyy-MM-dd')")
    behind = (F.floor(F.unix_timestamp("trade_date") / 3600) % 7) == 3
    for number, part in ((0, b.filter(~behind)), (1, b.filter(behind & (F.col("symbol") < "p"))), (2, b.filter(behind)), (2, b)):
        t.apply(part, number)
    return t.values.read().select("symbol", "trade_date", *_r(*_LIVE.outputs))


_HOURLY_RULES = [(0, "click", "price_breakout", '{"direction":"above","price":400}', True, None), (1, "view", "price_breakout", '{"direction":"below","price":10}', True, None), (2, "error", "ma_cross", '{"short_period":5,"long_period":20,"direction":"golden"}', True, None), (3, "purchase", "ma_cross", '{"short_period":3,"long_period":12,"direction":"dead"}', True, None), (4, "signup", "volume_spike", '{"multiplier":1.8,"lookback":20}', True, None), (5, "click", "volume_spike", "{}", False, None)]
_ALERTS_HOURLY = f"""WITH b AS (SELECT *, row_number() OVER w AS i, avg(volume) OVER (w ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING) AS usual, avg(close) OVER (w ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS a5, avg(close) OVER (w ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS a20, avg(close) OVER (w ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS a3, avg(close) OVER (w ROWS BETWEEN 11 PRECEDING AND CURRENT ROW) AS a12 FROM ({B.SQL_EVENTS}) WINDOW w AS (PARTITION BY symbol ORDER BY trade_date)),
c AS (SELECT *, lag(a5) OVER w AS b5, lag(a20) OVER w AS b20, lag(a3) OVER w AS b3, lag(a12) OVER w AS b12 FROM b WINDOW w AS (PARTITION BY symbol ORDER BY trade_date)),
f AS (SELECT 0 AS rule_id, 'price_breakout' AS condition_type, * FROM c WHERE symbol = 'click' AND close > 400 UNION ALL SELECT 1, 'price_breakout', * FROM c WHERE symbol = 'view' AND close < 10
UNION ALL SELECT 2, 'ma_cross', * FROM c WHERE symbol = 'error' AND i > 20 AND b5 <= b20 AND a5 > a20 UNION ALL SELECT 3, 'ma_cross', * FROM c WHERE symbol = 'purchase' AND i > 12 AND b3 >= b12 AND a3 < a12 UNION ALL SELECT 4, 'volume_spike', * FROM c WHERE symbol = 'signup' AND i > 20 AND usual > 0 AND volume > 1.8 * usual)
SELECT rule_id, symbol, condition_type, trade_date, close FROM (SELECT *, row_number() OVER (PARTITION BY rule_id, CAST(trade_date AS DATE) ORDER BY trade_date) AS k FROM f) WHERE k = 1"""


@query("stream_alerts", _ALERTS_HOURLY)
def _stream_alerts(spark, d):
    """Rules polled at every hourly bar of a stream that is stopped half way and started again from its checkpoint."""
    live.use_rocksdb(spark)
    out, at, rules = (shared.folder(spark, n) for n in ("out", "checkpoint", "rules"))
    spark.createDataFrame(_HOURLY_RULES, live.RULES).coalesce(1).write.parquet(rules)
    schema = B.SCHEMA.replace("trade_date date", "ts timestamp")
    _in_two(spark, B.bars_events(spark, d), lambda path: S.run_available(live.poll_rules(spark.readStream.schema(schema).parquet(path), spark.readStream.schema(live.RULES).parquet(rules)), out, at))
    return spark.read.parquet(out)


@query("replay_alerts", _ALERTS_HOURLY)
def _replay_alerts(spark, d):
    """The same from the whole table at once."""
    return relational.replay_alerts(spark.createDataFrame(_HOURLY_RULES, live.RULES), B.bars_events(spark, d))


# --- streaming, run over what is there

@query("stream_bars", f"SELECT symbol, trade_date AS ts, {_rs('open', 'high', 'low', 'close', 'volume', 'amount')} FROM ({B.SQL_EVENTS})")
def _stream(spark, d):
    """The streaming definition, on the table as a batch; tests run it as a stream."""
    return S.bars(B.table(spark, d, "events")).select("symbol", "ts", *_r("open", "high", "low", "close", "volume", "amount"))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days on which a symbol's 5-day average crosses its 20-day average upwards."""
    p = Plan()
    a, b = p.avg("close", 5), p.avg("close", 20)
    p.out(fast=a, slow=b, hit=p.c(f"CASE WHEN {p.lag(a)} <= {p.lag(b)} AND {a} > {b} THEN 1 ELSE 0 END"))
    return p.spark(B.bars_orders(spark, sf_dir)).filter("hit = 1")
