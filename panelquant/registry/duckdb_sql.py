"""The same queries in SQL, for an independent engine."""

from __future__ import annotations

from panelquant.registry.spark_queries import (COVARIANCE_DAYS, FIRST_DATE, GAMMA, LAST_DATE,
                                               WEEKS)

PANEL = """
wk AS (
  SELECT CAST(date_trunc('week', l_shipdate) AS date) AS date, l_suppkey,
         sum(l_quantity) AS qty,
         CAST(sum(CAST(l_extendedprice AS decimal(18,2))) AS double) AS ext,
         sum(CASE WHEN l_returnflag = 'R' THEN CAST(0 AS double) ELSE l_quantity END) AS daily_volume,
         CAST(sum(CAST(l_discount AS decimal(18,2))) AS double) / count(*) AS disc,
         CAST(sum(CAST(l_tax AS decimal(18,2))) AS double) / count(*) AS bid_ask_spread
  FROM lineitem GROUP BY 1, 2),
px AS (
  SELECT wk.*,
         concat(CASE WHEN n_regionkey IN (0,1,2) THEN 'US' ELSE 'XX' END,
                lpad(CAST(l_suppkey AS varchar(20)), 6, '0')) AS barrid,
         CASE WHEN n_regionkey IN (0,1,2) THEN 'USA' ELSE n_name END AS iso_country_code,
         ext / qty AS price,
         CAST(50 + (l_suppkey % 100) AS double) / 100 AS predicted_beta
  FROM wk JOIN supplier ON s_suppkey = l_suppkey JOIN nation ON n_nationkey = s_nationkey),
panel AS (
  SELECT date, barrid,
         CASE WHEN l_suppkey % 17 = 16 THEN 'US999999' ELSE barrid END AS rootid,
         concat('T', CAST(l_suppkey AS varchar(20))) AS ticker, iso_country_code, price,
         100 * (price / lag(price) OVER (PARTITION BY barrid ORDER BY date) - 1) AS "return",
         50 * (price / lag(price) OVER (PARTITION BY barrid ORDER BY date) - 1) AS specific_return,
         l_suppkey % 10 <> 9 AS in_universe,
         1 + 100 * disc AS specific_risk, daily_volume, bid_ask_spread,
         price * qty AS market_cap, predicted_beta
  FROM px)"""

USA = "iso_country_code = 'USA' AND rootid = barrid AND barrid LIKE 'US%'"

DECIMAL = PANEL + """,
dec AS (
  SELECT * REPLACE ("return" / 100 AS "return", specific_return / 100 AS specific_return,
                    specific_risk / 100 AS specific_risk,
                    nullif(daily_volume, 0) AS daily_volume)
  FROM panel)"""

CLEAN = DECIMAL + f""",
clean AS (
  SELECT * FROM dec
  WHERE {USA} AND "return" IS NOT NULL AND specific_risk IS NOT NULL)"""

ALPHA = CLEAN + """,
sig AS (
  SELECT *, CASE WHEN count(ln(1 + "return")) OVER w >= 22
                 THEN -(sum(ln(1 + "return")) OVER w) END AS str
  FROM clean
  WINDOW w AS (PARTITION BY barrid ORDER BY date ROWS BETWEEN 21 PRECEDING AND CURRENT ROW)),
scored AS (
  SELECT *, (str - avg(str) OVER (PARTITION BY date))
            / nullif(stddev_samp(str) OVER (PARTITION BY date), 0) AS str_score
  FROM sig),
alpha AS (SELECT *, str_score * specific_risk AS str_alpha FROM scored)"""

MOMENTS = ALPHA + f""",
rows_d AS (
  SELECT date, barrid, str_alpha AS a, predicted_beta AS b, specific_risk,
         1 / ({GAMMA} * specific_risk * specific_risk) AS d
  FROM alpha WHERE str_alpha IS NOT NULL),
sums AS (
  SELECT date, sum(d) AS s0, sum(d * b) AS s1, sum(d * b * b) AS s2, sum(d * a) AS t0,
         sum(d * a * b) AS t1, min(b) = 1 AND max(b) = 1 AS all_one
  FROM rows_d GROUP BY date)"""

BUDGET_WEIGHTS = MOMENTS + """,
weights AS (
  SELECT date, barrid, d * (a - (t0 - 1) / s0) AS weight
  FROM rows_d JOIN sums USING (date))"""

FULL_BETA_WEIGHTS = MOMENTS + """,
det AS (
  SELECT *, CASE WHEN s0 * s2 - s1 * s1 > 1e-12 * s0 * s2 THEN s0 * s2 - s1 * s1 END AS det
  FROM sums),
solved AS (
  SELECT date,
         CASE WHEN all_one THEN (t0 - 1) / s0 ELSE ((t0 - 1) * s2 - (t1 - 1) * s1) / det END AS l1,
         CASE WHEN all_one THEN 0 ELSE ((t1 - 1) * s0 - (t0 - 1) * s1) / det END AS l2
  FROM det),
weights AS (
  SELECT date, barrid, d * (a - l1 - l2 * b) AS weight
  FROM rows_d JOIN solved USING (date))"""

BUCKETS = ALPHA + """,
edges AS (
  SELECT date, quantile_cont(str_alpha, 0.2) AS e1, quantile_cont(str_alpha, 0.4) AS e2,
         quantile_cont(str_alpha, 0.6) AS e3, quantile_cont(str_alpha, 0.8) AS e4
  FROM alpha WHERE str_alpha IS NOT NULL GROUP BY date),
bucketed AS (
  SELECT alpha.date, "return",
         CASE WHEN str_alpha IS NULL THEN NULL
              ELSE CAST(str_alpha > e1 AS integer) + CAST(str_alpha > e2 AS integer)
                   + CAST(str_alpha > e3 AS integer) + CAST(str_alpha > e4 AS integer)
         END AS quantile
  FROM alpha LEFT JOIN edges USING (date)),
means AS (
  SELECT date, quantile, avg("return") AS quantile_return FROM bucketed GROUP BY date, quantile)"""

EQUAL_RETURNS = ALPHA + """,
held AS (
  SELECT date, barrid, 1.0 / count(*) OVER (PARTITION BY date) AS weight
  FROM alpha WHERE str_alpha > 0),
ahead AS (
  SELECT date, barrid, lead("return") OVER (PARTITION BY barrid ORDER BY date) AS earned
  FROM alpha WHERE str_alpha IS NOT NULL),
returns AS (
  SELECT date, sum(CAST(weight AS double) * earned) AS portfolio_return, avg(earned) AS bench
  FROM ahead LEFT JOIN held USING (date, barrid) GROUP BY date
  HAVING sum(weight * earned) IS NOT NULL),
grown AS (
  SELECT *, CASE WHEN min(portfolio_return) OVER w > -1
                 THEN sum(ln(1 + portfolio_return)) OVER w END AS growth,
            CASE WHEN min(bench) OVER w > -1 THEN sum(ln(1 + bench)) OVER w END AS bench_growth
  FROM returns WINDOW w AS (ORDER BY date ROWS UNBOUNDED PRECEDING))"""

POSITIONS = """
pos AS (
  SELECT concat('T', CAST(l_suppkey AS varchar)) AS ticker, sum(l_quantity) AS shares,
         CAST(sum(CAST(l_extendedprice AS decimal(18,2))) AS double) / sum(l_quantity) AS price
  FROM lineitem GROUP BY l_suppkey),
held AS (
  SELECT *, shares * price AS market_value,
         shares * price / (SELECT sum(shares * price) FROM pos) AS weight
  FROM pos)"""

BASKET = PANEL + "," + POSITIONS + f""",
today AS (SELECT * FROM panel WHERE date = DATE '{LAST_DATE}' AND in_universe),
basket AS (
  SELECT ticker, market_cap / (SELECT sum(market_cap) FROM today) AS weight FROM today),
ids AS (
  SELECT ticker, barrid FROM today WHERE {USA} AND specific_risk IS NOT NULL),
aligned AS (
  SELECT barrid AS asset, coalesce(held.weight, 0) AS p, coalesce(basket.weight, 0) AS e
  FROM held FULL JOIN basket USING (ticker) JOIN ids USING (ticker))"""

PAIRS = f""",
win AS (
  SELECT barrid, date, "return" / 100 AS r FROM panel
  WHERE date > DATE '{LAST_DATE}' - INTERVAL {COVARIANCE_DAYS} DAY
    AND date <= DATE '{LAST_DATE}' AND "return" IS NOT NULL),
pairs AS (
  SELECT x.barrid AS asset_i, y.barrid AS asset_j, count(*) AS n,
         covar_samp(x.r, y.r) * {WEEKS} AS cov
  FROM win x JOIN win y ON x.date = y.date AND x.barrid <= y.barrid
  GROUP BY 1, 2)"""

COV_PRODUCTS = BASKET + PAIRS + f""",
cells AS (
  SELECT asset_i, asset_j, cov / {WEEKS} AS cov FROM pairs
  UNION ALL
  SELECT asset_j, asset_i, cov / {WEEKS} FROM pairs WHERE asset_i <> asset_j),
products AS (
  SELECT asset_i AS asset, sum(cov * aj.e) AS v
  FROM cells JOIN aligned aj ON aj.asset = asset_j AND aj.e <> 0
       JOIN aligned ai ON ai.asset = asset_i
  GROUP BY asset_i),
totals AS (
  SELECT sum(v * p) AS covariance, sum(v * e) AS variance FROM products JOIN aligned USING (asset))"""

SIZE = ALPHA + f""",
sized AS (
  SELECT *, 1 / ({GAMMA} * specific_risk * specific_risk) AS d
  FROM alpha WHERE str_alpha IS NOT NULL),
series AS (SELECT date, avg("return" * predicted_beta) AS f FROM sized GROUP BY date),
fcov AS (
  SELECT date, sqrt(greatest(coalesce(covar_pop(f, f) OVER (
           ORDER BY date ROWS BETWEEN {WEEKS - 1} PRECEDING AND CURRENT ROW), 0), 0)) AS root
  FROM series)"""


LONG_ONLY = """,
        range_b AS (SELECT date, min(b) <= 1 AND max(b) >= 1 AS ok FROM rows_d GROUP BY date),
        halved AS (
          SELECT date, 0 AS step, CAST(-1e6 AS double) AS low, CAST(1e6 AS double) AS high
          FROM range_b WHERE ok
          UNION ALL
          SELECT date, step + 1, CASE WHEN beta > 1 THEN (low + high) / 2 ELSE low END,
                 CASE WHEN beta > 1 THEN high ELSE (low + high) / 2 END
          FROM (SELECT date, any_value(step) AS step, any_value(low) AS low, any_value(high) AS high,
                       sum(d * greatest(x - lam, 0) * b) AS beta
                FROM (SELECT *, max(lam_k) OVER (PARTITION BY date) AS lam
                      FROM (SELECT *, (sum(d * x) OVER w - 1) / sum(d) OVER w AS lam_k
                            FROM (SELECT h.*, r.barrid, r.b, r.d, r.a - (low + high) / 2 * r.b AS x
                                  FROM halved h JOIN rows_d r ON h.date = r.date WHERE step < 90)
                            WINDOW w AS (PARTITION BY date ORDER BY x DESC, barrid
                                         ROWS UNBOUNDED PRECEDING)))
                GROUP BY date)),
        priced AS (SELECT r.*, r.a - (low + high) / 2 * r.b AS x
                   FROM rows_d r JOIN halved h ON h.date = r.date AND step = 90),
        ranked AS (SELECT *, (sum(d * x) OVER w - 1) / sum(d) OVER w AS lam_k
                   FROM priced WINDOW w AS (PARTITION BY date ORDER BY x DESC, barrid
                                            ROWS UNBOUNDED PRECEDING)),
        solved AS (SELECT date, barrid, d * greatest(x - max(lam_k) OVER (PARTITION BY date), 0)
                          AS weight FROM ranked)"""

STUDY = PANEL + """,
base AS (SELECT date, barrid, price, "return" / 100 AS r, specific_risk, predicted_beta, bid_ask_spread,
                nullif(daily_volume, 0) AS daily_volume FROM panel WHERE in_universe),
measured AS (
  SELECT *, CASE WHEN count(daily_volume) OVER w >= 7 THEN avg(daily_volume) OVER w END AS adv,
         CASE WHEN count(bid_ask_spread) OVER w >= 13 THEN avg(bid_ask_spread) OVER w END AS spread,
         CASE WHEN count(ln(1 + r)) OVER v >= 21 THEN -(sum(ln(1 + r)) OVER v) END AS reversal
  FROM base
  WINDOW w AS (PARTITION BY barrid ORDER BY date ROWS BETWEEN 12 PRECEDING AND CURRENT ROW),
         v AS (PARTITION BY barrid ORDER BY date ROWS BETWEEN 20 PRECEDING AND CURRENT ROW)),
study AS (
  SELECT * FROM (
    SELECT *, (reversal - avg(reversal) OVER (PARTITION BY date))
              / nullif(stddev_samp(reversal) OVER (PARTITION BY date), 0) / nullif(specific_risk, 0) AS reversal_alpha
    FROM measured) WHERE reversal_alpha IS NOT NULL),
q1 AS (SELECT * FROM (SELECT *, lag(price) OVER (PARTITION BY barrid ORDER BY date) AS price_lag FROM study)
       WHERE price_lag >= 1000),
q2 AS (SELECT * FROM (SELECT *, lag(adv) OVER (PARTITION BY barrid ORDER BY date) * price_lag AS addv FROM q1)
       WHERE addv >= 50000),
quality AS (SELECT * FROM (SELECT *, lag(spread) OVER (PARTITION BY barrid ORDER BY date) AS spread_lag FROM q2)
            WHERE spread_lag <= 0.04)"""


def _study(name: str, rows: str) -> str:
    """Returns of the reversal study on the rows of one universe."""
    return "WITH RECURSIVE " + STUDY + f""",
      rows_d AS (SELECT date, barrid, reversal_alpha AS a, predicted_beta AS b,
                        1 / (10 * (specific_risk / 100) * (specific_risk / 100)) AS d FROM {rows})""" + LONG_ONLY + f""",
      ahead AS (SELECT date, barrid, lead(r) OVER (PARTITION BY barrid ORDER BY date) AS earned FROM base),
      paid AS (SELECT date, sum(weight * earned) AS portfolio_return, avg(earned) AS bench, count(earned) AS n
               FROM ahead LEFT JOIN solved USING (date, barrid) GROUP BY date)
      SELECT date, '{name}' AS portfolio, portfolio_return, bench, CASE WHEN ok THEN 'held' ELSE 'no_weights' END AS status
      FROM paid JOIN range_b USING (date) WHERE portfolio_return IS NOT NULL OR (NOT ok AND n > 0)"""


def _r(expression: str, name: str, digits: int = 6) -> str:
    return f"round({expression}, {digits}) + 0.0 AS {name}"


def _select(prefix: str, columns: str, source: str, tail: str = "") -> str:
    return f"WITH {prefix} SELECT {columns} FROM {source} {tail}"


def _rolling(value: str, aggregate: str, size: int, least: int) -> str:
    frame = (f"(PARTITION BY barrid ORDER BY date "
             f"ROWS BETWEEN {size - 1} PRECEDING AND CURRENT ROW)")
    return f"CASE WHEN count({value}) OVER {frame} >= {least} THEN {aggregate}({value}) OVER {frame} END"


def _late(source: str, value: str, rows: int, name: str) -> str:
    return (f", late AS (SELECT date, barrid, lag({value}, {rows}) OVER "
            f"(PARTITION BY barrid ORDER BY date) AS {name} FROM {source})")


def _signal(value: str, aggregate: str, size: int, least: int, sign: str, shift: int,
            digits: int, name: str) -> str:
    base = CLEAN + f", s AS (SELECT date, barrid, {sign}({_rolling(value, aggregate, size, least)}) AS v FROM clean)"
    return _select(base + _late("s", "v", shift, "v"), f"date, barrid, {_r('v', name, digits)}",
                   "late")


def _interpolated(values: str, prob: str) -> str:
    place = f"({prob} * (len({values}) - 1))"
    low, high = (f"{values}[CAST({f}({place}) AS integer) + 1]" for f in ("floor", "ceil"))
    return (f"CASE WHEN {low} = {high} THEN {low} ELSE (ceil({place}) - {place}) * {low} "
            f"+ ({place} - floor({place})) * {high} END")


def _histogram(prefix: str, source: str, value: str, digits: int | None) -> str:
    def shown(e, name):
        return f"{e} AS {name}" if digits is None else _r(e, name, digits)

    edge = "CASE WHEN {i} = 50 THEN hi ELSE lo + {i} * ((hi - lo) / 50) END"
    left, right = edge.format(i="k"), edge.format(i="(k + 1)")
    return f"""WITH {prefix},
    x AS (SELECT {value} AS x FROM {source} WHERE {value} IS NOT NULL),
    b AS (SELECT min(x) AS lo, max(x) AS hi FROM x),
    bins AS (SELECT k, {left} AS l, {right} AS r FROM b, range(50) t(k))
    SELECT k AS bin, {shown('l', 'bin_left')}, {shown('r', 'bin_right')}, count(x) AS count
    FROM bins LEFT JOIN x ON x >= l AND (x < r OR (k = 49 AND x <= r))
    GROUP BY k, l, r"""


def _check(prefix: str) -> str:
    """Invariants of fully invested, long-only, unit-beta weights."""
    return _select(prefix + """,
      c AS (SELECT date, count(*) AS assets, min(predicted_beta) <= 1 AND max(predicted_beta) >= 1 AS ok
            FROM alpha WHERE str_alpha IS NOT NULL GROUP BY date)""",
                   """date, assets, CASE WHEN ok THEN 'optimal' ELSE 'infeasible' END AS status,
      CASE WHEN ok THEN CAST(1 AS double) END AS total_weight,
      CASE WHEN ok THEN CAST(1 AS double) END AS beta, CAST(0 AS bigint) AS shorts""", "c")


_PASS_TEXT = """
txt AS (
  SELECT CASE WHEN length(ticker) % 2 = 0 THEN ticker || ' US' ELSE ticker END AS ticker,
         CASE WHEN shares > 15000 THEN '-' ELSE format('{:,}', CAST(shares AS bigint)) END AS quantity,
         '-$' || format('{:,}', CAST(floor(shares * price) AS bigint)) AS notional_value,
         '$' || format('{:,}', CAST(floor(shares * price) AS bigint)) AS market_value,
         CAST(CAST(shares AS bigint) % 700 AS varchar) AS weight_percent
  FROM pos)"""

_TEXT_CLEAN = _select(
    POSITIONS + "," + _PASS_TEXT,
    r"""regexp_replace(ticker, ' US$', '') AS ticker,
    TRY_CAST(replace(quantity, ',', '') AS bigint) AS quantity,
    TRY_CAST(regexp_replace(notional_value, '[$|,]', '', 'g') AS double) AS notional_value,
    TRY_CAST(regexp_replace(market_value, '[$|,]', '', 'g') AS double) AS market_value,
    TRY_CAST(regexp_replace(market_value, '[$|,]', '', 'g') AS double) AS current_market_value,
    TRY_CAST(weight_percent AS double) / 100 AS weight_decimal""",
    "txt", "WHERE TRY_CAST(weight_percent AS double) <> 0")

_RETURNS = """,
ahead AS (
  SELECT date, barrid, lead("return") OVER (PARTITION BY barrid ORDER BY date) AS earned
  FROM {source}),
returns AS (
  SELECT date, sum(weight * earned) AS portfolio_return, avg(earned) AS bench
  FROM ahead LEFT JOIN weights USING (date, barrid) GROUP BY date)"""

_RETURN_COLUMNS = (f"date, '{{name}}' AS portfolio, {_r('portfolio_return', 'portfolio_return')}, "
                   + _r("bench", '"return"'))

SQL: dict[str, str] = {
    "panel_scan": _select(PANEL, 'date, barrid, ticker, price, "return"', "panel",
                          f"WHERE in_universe AND date BETWEEN DATE '{FIRST_DATE}' AND DATE '{LAST_DATE}'"),
    "snapshot": _select(PANEL, "barrid, ticker", "panel",
                        f"WHERE in_universe AND date = DATE '{LAST_DATE}'"),
    "pct_to_decimal": _select(DECIMAL, 'date, barrid, "return", specific_return, specific_risk', "dec"),
    "zero_volume_null": _select(DECIMAL, "date, barrid, daily_volume", "dec"),
    "missing_columns": _select(PANEL, "date, barrid, price, CAST(NULL AS double) AS yield", "panel"),
    "filter_usa": _select(PANEL, "date, barrid", "panel", f"WHERE {USA}"),
    "filter_price_cap": _select(PANEL, "date, barrid, price, market_cap", "panel",
                                "WHERE price >= 1500 AND market_cap >= 50000"),
    "filter_required": _select(PANEL, 'date, barrid, "return", specific_risk', "panel",
                               'WHERE "return" IS NOT NULL AND specific_risk IS NOT NULL'),
    "row_counts": _select(PANEL, f"""count(*) AS rows_loaded,
        count(*) FILTER (WHERE {USA} AND price >= 1500 AND "return" IS NOT NULL
                               AND specific_risk IS NOT NULL) AS rows_kept""", "panel"),
    "distinct_countries": _select(PANEL, "DISTINCT iso_country_code", "panel"),
    "log_returns": _select(CLEAN, f"""date, barrid, {_r('ln(1 + "return")', 'log_return')}""", "clean"),
    # quantile_cont may return slightly less than x when it lies between two equal values x,
    # which would drop the ties at the cut; so the definition is spelled out.
    "percentile_screen": _select(CLEAN + f""",
        sorted AS (SELECT date, list_sort(list(price * daily_volume)
                                          FILTER (WHERE price * daily_volume IS NOT NULL)) AS dv,
                          list_sort(list(bid_ask_spread)) AS sp
                   FROM clean GROUP BY date),
        cuts AS (SELECT date, {_interpolated('dv', '0.1::double')} AS low,
                        {_interpolated('sp', '(1 - 0.1::double)')} AS high FROM sorted)""",
                                 "clean.date, barrid, price, bid_ask_spread",
                                 "clean JOIN cuts USING (date)",
                                 "WHERE price * daily_volume >= low AND bid_ask_spread <= high"),
    "quality_filter": _select(CLEAN + f""",
        q0 AS (SELECT *, {_rolling('daily_volume', 'avg', 13, 7)} AS adv,
                      {_rolling('bid_ask_spread', 'avg', 13, 13)} AS spread FROM clean),
        q1 AS (SELECT *, lag(price) OVER (PARTITION BY barrid ORDER BY date) AS price_lag FROM q0),
        q2 AS (SELECT *, lag(adv) OVER (PARTITION BY barrid ORDER BY date) * price_lag AS addv
               FROM (SELECT * FROM q1 WHERE price_lag >= 1000)),
        q3 AS (SELECT *, lag(spread) OVER (PARTITION BY barrid ORDER BY date) AS spread_lag
               FROM (SELECT * FROM q2 WHERE addv >= 50000))""",
                              f"""date, barrid, price_lag,
                              addv AS avg_daily_dollar_volume,
                              {_r('spread_lag', 'spread_lag', 10)}""", "q3", "WHERE spread_lag <= 0.04"),
    "rolling_mean_min": _select(CLEAN, f"date, barrid, {_r(_rolling('daily_volume', 'avg', 22, 11), 'mean_volume')}", "clean"),
    "rolling_sum_full": _select(CLEAN, f"date, barrid, {_r(_rolling('daily_volume', 'sum', 22, 22), 'sum_volume')}", "clean"),
    "rolling_std": _select(CLEAN, "date, barrid, " + _r(_rolling('"return"', 'stddev_samp', 22, 11), 'vol'), "clean"),
    "lag_k": _select(PANEL, """date, barrid,
        lag(price, 2) OVER (PARTITION BY barrid ORDER BY date) AS price_lag2,
        lead(price) OVER (PARTITION BY barrid ORDER BY date) AS price_next""", "panel"),
    "idio_vol_signal": _signal("specific_risk", "avg", 22, 22, "-", 2, 10, "idio_vol_22"),
    "idio_vol_long_signal": _signal("specific_risk", "avg", 52, 26, "-", 2, 10, "idio_vol"),
    "str_signal": _select(ALPHA, f"date, barrid, {_r('str', 'str')}", "alpha"),
    "price_impact_signal": _signal('abs("return") / nullif(price * daily_volume, 0)', "avg", 22, 11,
                                   "", 2, 12, "impact"),
    "cost_signal": _signal("bid_ask_spread", "avg", 52, 52, "", 2, 10, "cost"),
    "zscore_by_date": _select(CLEAN, "date, barrid, " + _r(
        "(specific_risk - avg(specific_risk) OVER (PARTITION BY date)) "
        "/ nullif(stddev_samp(specific_risk) OVER (PARTITION BY date), 0)", "score"), "clean"),
    "str_alpha": _select(ALPHA, f"""date, barrid, {_r('str', 'str')}, {_r('str_score', 'str_score')},
        {_r('str_alpha', 'str_alpha')}""", "alpha"),
    "alpha_divided": _select(DECIMAL + f""",
        s AS (SELECT date, barrid, specific_risk,
                     -({_rolling('ln(1 + "return")', 'sum', 21, 21)}) AS v
              FROM dec WHERE "return" IS NOT NULL),
        z AS (SELECT *, (v - avg(v) OVER (PARTITION BY date))
                        / nullif(stddev_samp(v) OVER (PARTITION BY date), 0) AS score FROM s)""",
                             f"date, barrid, {_r('score / nullif(specific_risk, 0) / 100', 'alpha')}", "z"),
    "zscore_recover": _select(ALPHA, f"date, barrid, {_r('str_alpha / specific_risk', 'zscore')}",
                              "alpha", "WHERE str_alpha IS NOT NULL"),
    "histogram_price": _histogram(PANEL, "panel", "price", None),
    "histogram_zscore": _histogram(ALPHA, "alpha", "str_alpha / specific_risk", 5),
    "histogram_weight": _histogram(FULL_BETA_WEIGHTS, "weights", "weight", 5),
    "quantile_returns": _select(BUCKETS, f"date, quantile, {_r('quantile_return', 'quantile_return')}", "means"),
    "quantile_pivot": _select(BUCKETS, "date, " + ", ".join(
        _r(f"max(quantile_return) FILTER (WHERE quantile = {k})", f"q{k}") for k in range(5)),
                              "means", "GROUP BY date"),
    "quantile_spread": _select(BUCKETS + """,
        s AS (SELECT date, max(quantile_return) FILTER (WHERE quantile = 4)
                           - max(quantile_return) FILTER (WHERE quantile = 0) AS spread
              FROM means GROUP BY date)""", f"date, {_r('spread', 'spread')}", "s",
                               "WHERE spread IS NOT NULL"),
    "mvo_input": _select(ALPHA, f"date, barrid, {_r('str_alpha', 'alpha')}, predicted_beta", "alpha",
                         "WHERE str_alpha IS NOT NULL"),
    "mvo_closed_form": _select(FULL_BETA_WEIGHTS, f"date, barrid, {_r('weight', 'weight')}", "weights"),
    "mvo_budget": _select(BUDGET_WEIGHTS, f"date, barrid, {_r('weight', 'weight')}", "weights"),
    "mvo_no_margin": _select(MOMENTS + """,
        det AS (SELECT *, CASE WHEN s0 * s2 - s1 * s1 > 1e-12 * s0 * s2
                               THEN s0 * s2 - s1 * s1 END AS det FROM sums),
        lam AS (SELECT date, t0 - (t1 - 1) / s2 * s1 <= 1 AS slack, (t1 - 1) / s2 AS free,
                       ((t0 - 1) * s2 - (t1 - 1) * s1) / det AS l1,
                       ((t1 - 1) * s0 - (t0 - 1) * s1) / det AS l2 FROM det),
        weights AS (SELECT date, barrid, d * (a - CASE WHEN slack THEN 0 ELSE l1 END
                           - CASE WHEN slack THEN free ELSE l2 END * b) AS weight
                    FROM rows_d JOIN lam USING (date))""",
                             f"date, barrid, {_r('weight', 'weight')}", "weights"),
    # Long-only with a budget: the assets held are the best ones, up to the last whose alpha
    # still exceeds the multiplier of the best k.
    "mvo_long_only_budget": _select(MOMENTS + """,
        ranked AS (SELECT *, (sum(d * a) OVER w - 1) / sum(d) OVER w AS lam
                   FROM rows_d WINDOW w AS (PARTITION BY date ORDER BY a DESC, barrid
                                            ROWS UNBOUNDED PRECEDING)),
        chosen AS (SELECT date, arg_min(lam, a) AS lam FROM ranked WHERE a > lam GROUP BY date)""",
                                    f"date, barrid, {_r('d * greatest(a - lam, 0)', 'weight')}",
                                    "rows_d JOIN chosen USING (date)"),
    # With a unit beta as well: the beta of the best portfolio falls as the price of beta rises, so
    # that price is found by halving, and the budget's multiplier for it as above.
    "mvo_long_only": "WITH RECURSIVE " + MOMENTS + LONG_ONLY + f"""
      SELECT r.date, r.barrid, {_r('weight', 'weight')},
             CASE WHEN weight IS NULL THEN 'infeasible' ELSE 'optimal' END AS status
      FROM rows_d r LEFT JOIN solved USING (date, barrid)""",
    "mvo_long_only_check": _check(ALPHA),
    "mvo_factor_check": _check(ALPHA),
    "mvo_factor_budget": _select(SIZE + f""",
        m AS (SELECT date, sum(d) AS s0, sum(d * x) AS s1, sum(d * x * x) + 1.0 / {GAMMA} AS s2,
                     sum(d * str_alpha) - 1 AS t0, sum(d * str_alpha * x) AS t1
              FROM (SELECT sized.*, predicted_beta * root AS x FROM sized JOIN fcov USING (date))
              GROUP BY date),
        lam AS (SELECT date, (t0 * s2 - t1 * s1) / (s0 * s2 - s1 * s1) AS l,
                       (t1 * s0 - t0 * s1) / (s0 * s2 - s1 * s1) AS mu FROM m)""",
                                 "date, barrid, " + _r(
        "d * (str_alpha - l - mu * predicted_beta * root)", "weight"),
                                 "sized JOIN fcov USING (date) JOIN lam USING (date)"),
    "portfolio_returns": _select(BUDGET_WEIGHTS + _RETURNS.format(source="dec"),
                                 _RETURN_COLUMNS.format(name="str"), "returns",
                                 "WHERE portfolio_return IS NOT NULL"),
    "portfolio_returns_cap": _select(BUDGET_WEIGHTS + """,
        returns AS (SELECT date, sum(weight * "return") AS portfolio_return,
                           sum(market_cap * "return")
                             / nullif(sum(market_cap) FILTER (WHERE "return" IS NOT NULL), 0) AS bench
                    FROM dec LEFT JOIN weights USING (date, barrid) GROUP BY date)""",
                                     _RETURN_COLUMNS.format(name="str"), "returns",
                                     "WHERE portfolio_return IS NOT NULL"),
    "cumulative": _select(EQUAL_RETURNS, f"""date, 'top_half' AS portfolio,
        {_r('growth', 'log_growth')}, {_r('bench_growth', 'benchmark_log_growth')}""", "grown"),
    "summary": _select(EQUAL_RETURNS + f""",
        dd AS (SELECT *, exp(growth) / greatest(1, max(exp(growth)) OVER (
                 ORDER BY date ROWS UNBOUNDED PRECEDING)) - 1 AS drawdown FROM grown),
        s AS (SELECT count(portfolio_return) AS n, avg(portfolio_return) AS m, avg(bench) AS bm,
                     stddev_samp(portfolio_return) AS sd, min(drawdown) AS mdd,
                     covar_samp(portfolio_return, bench) / nullif(var_samp(bench), 0) AS beta,
                     CASE WHEN min(portfolio_return) > -1 THEN sum(ln(1 + portfolio_return)) END AS g
              FROM dd)""",
                       f"""'top_half' AS portfolio, n AS n_periods, {_r(f'm * {WEEKS}', 'mean_return')},
        {_r(f'sd * sqrt({WEEKS})', 'volatility')}, {_r(f'm / nullif(sd, 0) * sqrt({WEEKS})', 'sharpe')},
        {_r('mdd', 'max_drawdown')}, {_r(f'(m - beta * bm) * {WEEKS}', 'alpha')}, {_r('beta', 'beta')},
        {_r('g', 'log_total_return')}""", "s"),
    "positions": _select(POSITIONS, f"ticker, shares, price, market_value, {_r('weight', 'weight', 9)}", "held"),
    "holdings_text_clean": _TEXT_CLEAN,
    "holdings_csv_preamble": _TEXT_CLEAN,
    "holdings_csv_footer": _select(POSITIONS, """ticker,
        CAST(floor(market_value) AS bigint) AS market_value,
        CAST(CAST(shares AS bigint) % 700 AS double) / 100 AS weight""", "held"),
    "holdings_json": _select(POSITIONS, "ticker, shares, price", "pos"),
    "ticker_map_join": _select(BASKET, f"ticker, {_r('weight', 'weight', 9)}, barrid",
                               "held JOIN ids USING (ticker)"),
    "holdings_outer": _select(BASKET, f"""ticker, {_r('coalesce(held.weight, 0)', 'portfolio_weight', 9)},
        {_r('coalesce(basket.weight, 0)', 'basket_weight', 9)}""", "held FULL JOIN basket USING (ticker)"),
    "all_tickers": _select(BASKET, "ticker", "held", "UNION SELECT ticker FROM basket"),
    "tickers_dropped": _select(BASKET, "ticker",
                               "(SELECT ticker FROM held UNION SELECT ticker FROM basket)",
                               "WHERE ticker NOT IN (SELECT ticker FROM ids)"),
    "pair_covariance": _select(PANEL + PAIRS, f"asset_i, asset_j, n, {_r('cov', 'cov', 4)}", "pairs"),
    "daily_covariance": _select(PANEL + PAIRS + f""",
        cells AS (SELECT asset_i, asset_j, cov / {WEEKS} AS cov FROM pairs UNION ALL
                  SELECT asset_j, asset_i, cov / {WEEKS} FROM pairs WHERE asset_i <> asset_j)""",
                                f"asset_i, asset_j, {_r('cov', 'cov', 4)}", "cells"),
    "portfolio_etf_beta": _select(COV_PRODUCTS, f"""{_r('covariance', 'covariance')},
        {_r('variance', 'variance')},
        {_r('CASE WHEN variance = 0 THEN 0 ELSE covariance / variance END', 'beta')}""", "totals"),
    "asset_beta_vector": _select(COV_PRODUCTS, f"asset, {_r('v / variance', 'beta')}",
                                 "products, totals"),
    "etf_beta_job": _select(COV_PRODUCTS + f""",
        job AS (
          SELECT 'beta' AS "table", 'covariance' AS key, {_r('covariance', 'value')} FROM totals
          UNION ALL SELECT 'beta', 'variance', {_r('variance', 'value')} FROM totals
          UNION ALL SELECT 'beta', 'beta',
            {_r('CASE WHEN variance = 0 THEN 0 ELSE covariance / variance END', 'value')} FROM totals
          UNION ALL SELECT 'asset_beta', asset, {_r('v / variance', 'value')} FROM products, totals
          UNION ALL SELECT 'overlay', asset, {_r('p - covariance / variance * e', 'value')} FROM aligned, totals
          UNION ALL SELECT 'dropped', ticker, NULL
            FROM (SELECT ticker FROM held UNION SELECT ticker FROM basket)
            WHERE ticker NOT IN (SELECT ticker FROM ids))""", '"table", key, value', "job"),
    "neutral_overlay": _select(COV_PRODUCTS, f"asset, {_r('p - covariance / variance * e', 'weight')}",
                               "aligned, totals"),
    "panel_written_and_read": _select(PANEL, 'date, barrid, price, "return", market_cap', "panel",
                                      "WHERE in_universe"),
    "alphas_written_and_read": _select(ALPHA, f"date, barrid, {_r('str_alpha', 'str_alpha')}", "alpha"),
    "configured_panel": _select(CLEAN, """date, barrid, "return", specific_risk, daily_volume,
        CAST(NULL AS double) AS yield""", "clean", "WHERE in_universe AND price >= 50"),
}
SQL["summary_written_and_read"] = SQL["summary"]


def _ic(value: str) -> str:
    return _select(ALPHA + f""",
      n AS (SELECT date, str_alpha AS x,
                   lead({value}) OVER (PARTITION BY barrid ORDER BY date) AS y FROM alpha),
      i AS (SELECT date, covar_samp(x, y) / nullif(stddev_samp(x) * stddev_samp(y), 0) AS ic
            FROM n WHERE x IS NOT NULL AND y IS NOT NULL GROUP BY date)""",
                   f"date, {_r('ic', 'ic')}", "i", "WHERE ic IS NOT NULL")


SQL["ic_series"] = _ic("str_alpha")
SQL["ic_forward_return"] = _ic('"return"')
SQL["research_job"] = _select(
    FULL_BETA_WEIGHTS.replace('WHERE ' + USA, 'WHERE in_universe AND price >= 50 AND ' + USA)
    + _RETURNS.format(source="(SELECT * FROM dec WHERE in_universe) whole"),
    _RETURN_COLUMNS.format(name="str_22"), "returns", "WHERE portfolio_return IS NOT NULL")
SQL["research_job_in_parts"] = SQL["research_job"]
SQL["diagnostics_job"] = _select(
    BUDGET_WEIGHTS + _RETURNS.format(source="dec") + f""",
    paid AS (SELECT * FROM returns WHERE portfolio_return IS NOT NULL),
    grown AS (SELECT *, CASE WHEN min(portfolio_return) OVER w > -1 THEN sum(ln(1 + portfolio_return)) OVER w END AS growth,
                     CASE WHEN min(bench) OVER w > -1 THEN sum(ln(1 + bench)) OVER w END AS bench_growth
              FROM (SELECT date, CASE WHEN min(portfolio_return) OVER (ORDER BY date) > -1 THEN portfolio_return END
                             AS portfolio_return, portfolio_return AS whole, bench FROM paid)
              WINDOW w AS (ORDER BY date ROWS UNBOUNDED PRECEDING)),
    alive AS (SELECT *, CASE WHEN min(whole) OVER w > -1 THEN growth END AS wealth
              FROM grown WINDOW w AS (ORDER BY date ROWS UNBOUNDED PRECEDING)),
    dd AS (SELECT *, exp(wealth) / greatest(1, max(exp(wealth)) OVER (
             ORDER BY date ROWS UNBOUNDED PRECEDING)) - 1 AS drawdown FROM alive),
    p AS (SELECT count(whole) AS n, avg(whole) AS m, avg(bench) AS bm, stddev_samp(whole) AS sd, min(drawdown) AS mdd,
                 covar_samp(whole, bench) / nullif(var_samp(bench), 0) AS beta FROM dd),
    n AS (SELECT date, str_alpha AS x, lead(str_alpha) OVER (PARTITION BY barrid ORDER BY date) AS y
          FROM alpha),
    i AS (SELECT date, covar_samp(x, y) / nullif(stddev_samp(x) * stddev_samp(y), 0) AS ic
          FROM n WHERE x IS NOT NULL AND y IS NOT NULL GROUP BY date),""" +
    BUCKETS[len(ALPHA) + 1:] + f""",
    s AS (SELECT date, max(quantile_return) FILTER (WHERE quantile = 4)
                       - max(quantile_return) FILTER (WHERE quantile = 0) AS spread
          FROM means GROUP BY date),
    t AS (SELECT 'cumulative_returns' AS "table", CAST(date AS varchar) AS key, 'portfolio' AS measure, wealth AS value
          FROM alive
          UNION ALL SELECT 'cumulative_returns', CAST(date AS varchar), 'benchmark', bench_growth FROM alive
          UNION ALL SELECT 'performance_summary', 'portfolio', u.measure, u.value
            FROM p, LATERAL (VALUES ('n_periods', CAST(n AS double)), ('mean_return', m * {WEEKS}),
              ('volatility', sd * sqrt({WEEKS})), ('sharpe', m / nullif(sd, 0) * sqrt({WEEKS})), ('max_drawdown', mdd),
              ('alpha', (m - beta * bm) * {WEEKS}), ('beta', beta)) AS u (measure, value)
          UNION ALL SELECT 'information_coefficient', CAST(date AS varchar), 'ic', ic FROM i WHERE ic IS NOT NULL
          UNION ALL SELECT 'quantile_spread', CAST(date AS varchar), 'spread', spread FROM s WHERE spread IS NOT NULL
          UNION ALL SELECT 'zscore_histogram', CAST(bin AS varchar), 'count', CAST(count AS double)
            FROM ({SQL["histogram_zscore"]})
          UNION ALL SELECT 'weight_histogram', CAST(bin AS varchar), 'count', CAST(count AS double)
            FROM ({_histogram(BUDGET_WEIGHTS, "weights", "weight", 5)}))""",
    f'"table", key, measure, {_r("value", "value")}', "t")
SQL["mvo_factor_kkt"] = _select(ALPHA + """,
    c AS (SELECT date, count(*) AS assets, min(predicted_beta) <= 1 AND max(predicted_beta) >= 1 AS ok
          FROM alpha WHERE str_alpha IS NOT NULL GROUP BY date)""",
    """date, assets, CASE WHEN ok THEN 'optimal' ELSE 'infeasible' END AS status,
    CASE WHEN ok THEN CAST(0 AS double) END AS stationarity, CASE WHEN ok THEN CAST(0 AS double) END AS budget,
    CASE WHEN ok THEN CAST(0 AS double) END AS beta, CAST(0 AS bigint) AS shorts""", "c")
_STUDIES = f"({_study('all', 'study')}) UNION ALL ({_study('quality', 'quality')})"
SQL["reversal_study_returns"] = (f"SELECT date, portfolio, status, {_r('portfolio_return', 'portfolio_return')}, "
                                 f"{_r('bench', '"return"')} FROM ({_STUDIES})")
SQL["reversal_study_summary"] = f"""
  SELECT portfolio, count(portfolio_return) AS n_periods, {_r(f'avg(portfolio_return) * {WEEKS}', 'mean_return')},
         {_r(f'stddev_samp(portfolio_return) * sqrt({WEEKS})', 'volatility')},
         {_r(f'avg(portfolio_return) / nullif(stddev_samp(portfolio_return), 0) * sqrt({WEEKS})', 'sharpe')},
         {_r('covar_samp(portfolio_return, bench) / nullif(var_samp(bench) FILTER (WHERE portfolio_return IS NOT NULL), 0)',
             'beta')}
  FROM ({_STUDIES}) GROUP BY portfolio"""
SQL["rolling_long_history"] = SQL["rolling_sum_full"]
SQL["str_alpha_by_asset"] = SQL["str_alpha"]
SQL["panel_validation"] = "WITH " + PANEL + """,
  w AS (SELECT date, barrid, "return" AS r, day(date) AS d FROM panel),
  f AS (SELECT count(*) AS n, count(*) FILTER (r IS NULL) AS gaps, count(*) FILTER (d > 7 AND r IS NOT NULL) AS whole,
               count(*) FILTER (d = 1) AS twice, count(*) FILTER (d = 2) AS dashes, count(*) FILTER (d = 3) AS holes
        FROM w)
  SELECT u.panel, u."check", CAST(u.value AS bigint) AS value FROM f, LATERAL (VALUES
    ('whole', 'rows', n), ('whole', 'missing', 0), ('whole', 'placeholders', 0), ('whole', 'ok', 1),
    ('whole', 'null_date', 0), ('whole', 'null_barrid', 0), ('whole', 'null_return', gaps),
    ('whole', 'null_specific_risk', 0), ('whole', 'repeated', 0),
    ('empty', 'rows', 0), ('empty', 'missing', 0), ('empty', 'placeholders', 0), ('empty', 'ok', 0),
    ('empty', 'null_date', 0), ('empty', 'null_barrid', 0), ('empty', 'null_return', 0),
    ('empty', 'null_specific_risk', 0), ('empty', 'repeated', 0),
    ('incomplete', 'rows', n), ('incomplete', 'missing', 1), ('incomplete', 'placeholders', 0), ('incomplete', 'ok', 0),
    ('incomplete', 'null_date', 0), ('incomplete', 'null_barrid', 0), ('incomplete', 'null_return', n - whole),
    ('incomplete', 'repeated', 0),
    ('repeated', 'rows', n + twice), ('repeated', 'missing', 0), ('repeated', 'placeholders', 0), ('repeated', 'ok', 0),
    ('repeated', 'null_date', 0), ('repeated', 'null_barrid', 0),
    ('repeated', 'null_return', gaps + (SELECT count(*) FROM w WHERE d = 1 AND r IS NULL)),
    ('repeated', 'null_specific_risk', 0), ('repeated', 'repeated', twice),
    ('placeholders', 'rows', n), ('placeholders', 'missing', 0), ('placeholders', 'placeholders', dashes),
    ('placeholders', 'ok', 0), ('placeholders', 'null_date', 0), ('placeholders', 'null_barrid', holes),
    ('placeholders', 'null_return', gaps), ('placeholders', 'null_specific_risk', 0)) AS u (panel, "check", value)"""
SQL["holdings_many_files"] = _select(POSITIONS + """,
  funds AS (SELECT *, CAST(substr(ticker, 2) AS bigint) % 3 AS k, CAST(shares AS bigint) % 700 AS percent FROM held),
  rows AS (
    SELECT kind, concat('F', k) AS fund, DATE '2001-10-27' + CAST(k AS integer) AS as_of, ticker,
           CAST(floor(market_value) AS double) AS market_value,
           CASE WHEN kind <> 'json' THEN CAST(percent AS double) / 100 END AS weight
    FROM funds, (VALUES ('footer'), ('preamble'), ('json')) AS kinds (kind)
    WHERE kind = 'json' OR percent <> 0)""", "kind, fund, CAST(as_of AS date) AS as_of, ticker, market_value, weight", "rows")
