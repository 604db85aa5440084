"""The same results in plain SQL, written independently of the operators."""

from __future__ import annotations

# Easter Sundays of the years in the tables, taken from a calendar.
EASTER = "('1995-04-16'), ('1996-04-07'), ('1997-03-30'), ('1998-04-12'), ('1999-04-04'), ('2000-04-23'), " \
    "('2001-04-15'), ('2024-03-31')"


def r6(x: str) -> str:
    return f"floor(({x}) * 1e6 + 0.5001) / 1e6"


def _with(*parts: str) -> str:
    return "WITH " + ",\n".join(parts) + "\n"


# ---------------------------------------------------------------- common table expressions

EVENTS = "raw AS (SELECT substr(props, 3, 1) AS area, ts, event_type AS series, value FROM events)"


def binned(seconds: int = 3600, name: str = "cells") -> str:
    bin_start = f"make_timestamp(CAST(floor(epoch(ts) / {seconds}) AS BIGINT) * {seconds} * 1000000)"
    return f"{name} AS (SELECT substr(props, 3, 1) AS area, {bin_start} AS ts, event_type AS series, avg(value) AS value " \
        "FROM events GROUP BY ALL)"


def grid(source: str = "cells", name: str = "hourly") -> str:
    return f"""{name} AS (
  SELECT area, ts, series, c.value
  FROM (SELECT DISTINCT area, ts FROM {source}) t JOIN (SELECT DISTINCT area, series FROM {source}) s USING (area)
  LEFT JOIN {source} c USING (area, ts, series))"""


def spine(source: str, seconds: int, name: str) -> str:
    """Mean per bin on the full grid of each area."""
    start = f"make_timestamp(CAST(floor(epoch(ts) / {seconds}) AS BIGINT) * {seconds} * 1000000)"
    return f"""{name}_m AS (SELECT area, {start} AS ts, series, avg(value) AS value FROM {source} GROUP BY ALL),
{name} AS (
  SELECT area, ts, series, m.value
  FROM (SELECT area, unnest(generate_series(min(ts), max(ts), INTERVAL {seconds} SECOND)) AS ts
        FROM {name}_m GROUP BY area) t
  JOIN (SELECT DISTINCT area, series FROM {source}) s USING (area)
  LEFT JOIN {name}_m m USING (area, ts, series))"""


def filled(source: str, name: str) -> str:
    """Interpolation by time over the whole series at once."""
    return f"""{name}_k AS (
  SELECT *, epoch(ts) AS t,
    last_value(value IGNORE NULLS) OVER up AS pv,
    last_value(CASE WHEN value IS NOT NULL THEN epoch(ts) END IGNORE NULLS) OVER up AS pt,
    first_value(value IGNORE NULLS) OVER down AS nv,
    first_value(CASE WHEN value IS NOT NULL THEN epoch(ts) END IGNORE NULLS) OVER down AS nt
  FROM {source}
  WINDOW up AS (PARTITION BY area, series ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
    down AS (PARTITION BY area, series ORDER BY ts ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
{name} AS (
  SELECT area, ts, series, CASE WHEN value IS NOT NULL THEN value WHEN pv IS NULL THEN NULL
    WHEN nv IS NULL THEN pv ELSE pv + (nv - pv) * ((t - pt) / (nt - pt)) END AS value
  FROM {name}_k)"""


COMPLETE = ",\n".join([EVENTS, spine("raw", 3600, "hours"), filled("hours", "complete")])

HOLIDAYS = f"""easter(e) AS (SELECT CAST(col0 AS DATE) FROM (VALUES {EASTER})),
years AS (SELECT year(e) AS y FROM easter),
holidays(date, name) AS (
  SELECT make_date(y, 1, 1), 'New Year''s Day' FROM years
  UNION ALL SELECT make_date(y, 5, 1), 'Labour Day' FROM years
  UNION ALL SELECT make_date(y, 10, 3), 'German Unity Day' FROM years
  UNION ALL SELECT make_date(y, 12, 25), 'Christmas Day' FROM years
  UNION ALL SELECT make_date(y, 12, 26), 'Second Day of Christmas' FROM years
  UNION ALL SELECT e - 2, 'Good Friday' FROM easter
  UNION ALL SELECT e + 1, 'Easter Monday' FROM easter
  UNION ALL SELECT e + 39, 'Ascension Day' FROM easter
  UNION ALL SELECT e + 50, 'Whit Monday' FROM easter)"""


def day_types(source: str, name: str = "days") -> str:
    """Day type of every date of ``source``."""
    return f"""{name} AS (
  SELECT date, weekday, holiday, CASE
    WHEN month(date) = 12 AND day(date) IN (24, 31) AND weekday <> 6 THEN 1
    WHEN weekday < 5 AND NOT holiday THEN 0
    WHEN weekday = 5 AND NOT holiday THEN 1 ELSE 2 END AS day_type
  FROM (SELECT DISTINCT date, CAST(isodow(date) - 1 AS INTEGER) AS weekday,
          date IN (SELECT date FROM holidays) AS holiday FROM {source}))"""


ORDER_DATES = "dates AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS date FROM orders)"
LINES = "lines AS (SELECT l_linestatus AS area, l_shipdate AS ts, l_returnflag || ' ' || l_linestatus AS series, " \
    "l_quantity AS value FROM lineitem)"
DAILY_ORDERS = ",\n".join([
    "priced AS (SELECT o_orderstatus AS area, o_orderdate AS ts, o_orderpriority AS series, o_totalprice / 1000 AS value FROM orders)",
    spine("priced", 86400, "order_days"),
    "daily AS (SELECT area, ts, series, coalesce(value, 0) AS value FROM order_days)",
])


def profile(source: str, k: int, name: str = "profiled") -> str:
    """Day by day: the k latest earlier dates of the same day type, then the slot means over them."""
    return ",\n".join([
        HOLIDAYS,
        f"{name}_d AS (SELECT DISTINCT area, CAST(ts AS DATE) AS date FROM {source})",
        day_types(f"{name}_d", f"{name}_k"),
        f"{name}_t AS (SELECT area, date, day_type FROM {name}_d JOIN {name}_k USING (date))",
        f"""{name}_b AS (
  SELECT area, date, day_type, back FROM (
    SELECT a.area, a.date, a.day_type, b.date AS back,
      row_number() OVER (PARTITION BY a.area, a.date ORDER BY b.date DESC) AS r
    FROM {name}_t a JOIN {name}_t b ON b.area = a.area AND b.day_type = a.day_type AND b.date < a.date)
  WHERE r <= {k}),
{name}_m AS (
  SELECT b.area, b.date, s.series, CAST(epoch(s.ts) AS BIGINT) % 86400 AS second,
    CASE WHEN count(s.value) = {k} THEN avg(s.value) END AS pslp
  FROM {name}_b b JOIN {source} s ON s.area = b.area AND CAST(s.ts AS DATE) = b.back GROUP BY ALL),
{name} AS (
  SELECT s.area, s.ts, s.series, s.value, t.day_type, m.pslp
  FROM {source} s JOIN {name}_t t ON t.area = s.area AND t.date = CAST(s.ts AS DATE)
  LEFT JOIN {name}_m m ON m.area = s.area AND m.date = t.date AND m.series = s.series
    AND m.second = CAST(epoch(s.ts) AS BIGINT) % 86400)""",
    ])


def partial_profile(usable_days: str, value: str) -> str:
    """20-minute profiles with lookback 2, where days may lack slots."""
    return _with(
        binned(1200), grid("cells", "bins"), HOLIDAYS,
        "d0 AS (SELECT CAST(ts AS DATE) AS date, count(DISTINCT ts) AS n FROM bins GROUP BY ALL)",
        day_types("d0", "kinds"),
        "d AS (SELECT kinds.date, day_type, n = 72 AS complete_day FROM kinds JOIN d0 USING (date))",
        f"""b AS (SELECT date, back, ok FROM (
    SELECT x.date, y.date AS back, y.complete_day AS ok,
      row_number() OVER (PARTITION BY x.date ORDER BY y.date DESC) AS r
    FROM d x JOIN (SELECT * FROM d WHERE {usable_days}) y ON y.day_type = x.day_type AND y.date < x.date)
  WHERE r <= 2)""",
        f"""m AS (SELECT b.date, s.series, CAST(epoch(s.ts) AS BIGINT) % 86400 AS sec,
    CASE WHEN count({value}) = 2 THEN avg(s.value) END AS pslp
  FROM b JOIN bins s ON CAST(s.ts AS DATE) = b.back GROUP BY ALL)""",
    ) + f"""SELECT s.area, s.ts, s.series, {r6('m.pslp')} AS pslp
FROM bins s LEFT JOIN m ON m.date = CAST(s.ts AS DATE) AND m.series = s.series
  AND m.sec = CAST(epoch(s.ts) AS BIGINT) % 86400"""


def window_sums(tw: int, pw: int, stride: int, only: str = "TRUE") -> str:
    """Sums of all cells of each window, from the row number of the timestamp."""
    return _with(
        COMPLETE,
        "per AS (SELECT ts, row_number() OVER (ORDER BY ts) - 1 AS pos, "
        "sum(CAST(CAST(value AS FLOAT) AS DOUBLE)) AS v FROM complete GROUP BY ts)",
        f"""starts AS (SELECT pos FROM per WHERE pos % {stride} = 0
    AND pos <= (SELECT count(*) FROM per) - {tw} - {pw})""",
    ) + f"""SELECT 'k' AS area, CAST(s.pos // {stride} AS BIGINT) AS window_id,
  {r6(f'sum(CASE WHEN p.pos < s.pos + {tw} THEN v END)')} AS sample_sum,
  {r6(f'sum(CASE WHEN p.pos >= s.pos + {tw} THEN v END)')} AS target_sum,
  CAST(count(CASE WHEN p.pos < s.pos + {tw} THEN 1 END) AS INTEGER) AS sample_rows,
  min(CASE WHEN p.pos >= s.pos + {tw} THEN ts END) AS target_ts
FROM starts s JOIN per p ON p.pos >= s.pos AND p.pos < s.pos + {tw + pw}
WHERE {only} GROUP BY s.pos"""


DAY_BEFORE = _with(
    binned(), grid(),
    """diff AS (SELECT coalesce(a.area, p.area) AS area, coalesce(a.ts, p.ts) AS ts,
    coalesce(a.series, p.series) AS series, a.value AS actual, p.value AS predicted, a.value - p.value AS residual
  FROM hourly a FULL JOIN (SELECT area, ts + INTERVAL 1 DAY AS ts, series, value FROM hourly) p
    ON a.area = p.area AND a.ts = p.ts AND a.series = p.series)""",
)
BATCHES = "batches AS (SELECT o_orderpriority AS run_id, CAST((year(o_orderdate) - 1995) * 12 + month(o_orderdate) - 1 " \
    "AS INTEGER) AS epoch, o_totalprice / 1000 AS loss FROM orders)"
EPOCHS = BATCHES + ",\nepochs AS (SELECT run_id, epoch, avg(loss) AS loss FROM batches GROUP BY ALL)"
CATEGORY = "CASE WHEN series IN ('click', 'view') THEN 'browse' WHEN series IN ('signup', 'purchase') THEN 'convert' " \
    "ELSE series END"


def grouped(source: str, name: str) -> str:
    return f"""{name} AS (SELECT area, ts, {CATEGORY} AS series,
    CASE WHEN count(*) = count(value) THEN sum(value) END AS value FROM {source} GROUP BY ALL)"""


def kpss(source: str, name: str, lags: int = 7) -> str:
    """Statistic from plain windows over each whole series; keys (area, series, d)."""
    pairs = "\n    + ".join(
        f"2 * {1 - j / (lags + 1)} * sum(e * lag{j})" for j in range(1, lags + 1)
    )
    lagged = ", ".join(f"coalesce(lag(e, {j}) OVER w, 0) AS lag{j}" for j in range(1, lags + 1))
    return f"""{name}_e AS (SELECT *, x - avg(x) OVER (PARTITION BY area, series, d) AS e FROM {source}),
{name}_w AS (SELECT *, sum(e) OVER (PARTITION BY area, series, d ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s, {lagged}
  FROM {name}_e WINDOW w AS (PARTITION BY area, series, d ORDER BY ts)),
{name} AS (SELECT area, series, d, count(*) AS n,
    sum(s * s) / (count(*) * count(*)) / ((sum(e * e) + {pairs}) / count(*)) AS kpss
  FROM {name}_w GROUP BY area, series, d)"""


SCALED = COMPLETE + """,
s AS (SELECT area, ts, series, (value - (SELECT min(value) FROM complete)) /
  ((SELECT max(value) FROM complete) - (SELECT min(value) FROM complete)) AS value FROM complete)"""

# Two lags, solved from covariances.
LAG_MODEL = SCALED + """,
z AS (SELECT *, lag(value, 1) OVER w AS x1, lag(value, 24) OVER w AS x2 FROM s WINDOW w AS (PARTITION BY area, series ORDER BY ts)),
c AS (SELECT area, series, count(*) AS n, avg(value) AS my, avg(x1) AS m1, avg(x2) AS m2, var_pop(value) AS cyy, var_pop(x1) AS c11,
    var_pop(x2) AS c22, covar_pop(x1, x2) AS c12, covar_pop(x1, value) AS c1y, covar_pop(x2, value) AS c2y
  FROM z WHERE value + x1 + x2 IS NOT NULL GROUP BY ALL),
b AS (SELECT *, (c1y * c22 - c2y * c12) / (c11 * c22 - c12 * c12) AS b1, (c2y * c11 - c1y * c12) / (c11 * c22 - c12 * c12) AS b2 FROM c),
model AS (SELECT *, my - b1 * m1 - b2 * m2 AS b0, cyy - b1 * c1y - b2 * c2y AS sigma2 FROM b)"""

# A lag and a lagged shock; the shock is the error of a line on the value before, on the same rows.
SHOCK_MODEL = SCALED + """,
z AS (SELECT *, lag(value, 1) OVER w AS x1, lag(value, 2) OVER w AS x2 FROM s WINDOW w AS (PARTITION BY area, series ORDER BY ts)),
l AS (SELECT area, series, regr_slope(value, x1) AS a, regr_intercept(value, x1) AS c FROM z WHERE value + x1 + x2 IS NOT NULL GROUP BY ALL),
ze AS (SELECT z.*, value - c - a * x1 AS e0, x1 - c - a * x2 AS e1 FROM z JOIN l USING (area, series)),
k AS (SELECT area, series, count(*) AS n, avg(value) AS my, avg(x1) AS m1, avg(e1) AS m2, var_pop(value) AS cyy, var_pop(x1) AS c11,
    var_pop(e1) AS c22, covar_pop(x1, e1) AS c12, covar_pop(x1, value) AS c1y, covar_pop(e1, value) AS c2y
  FROM ze WHERE value + e1 IS NOT NULL GROUP BY ALL),
b AS (SELECT *, (c1y * c22 - c2y * c12) / (c11 * c22 - c12 * c12) AS b1, (c2y * c11 - c1y * c12) / (c11 * c22 - c12 * c12) AS b2 FROM k),
model AS (SELECT *, my - b1 * m1 - b2 * m2 AS b0, cyy - b1 * c1y - b2 * c2y AS sigma2 FROM b)"""


def solved(source: str, size: int, keys: str, outputs: int = 1) -> list[str]:
    """Elimination of the equations ``a<i>_<j>`` with right sides ``a<i>_<size + o>``: ``solution`` has ``keys`` and ``d<i>_<o>``."""
    parts, last, width = [], source, size + outputs
    for k in range(size):
        cells = ", ".join(f"a{i}_{j} - a{i}_{k} * a{k}_{j} / a{k}_{k} AS a{i}_{j}" for i in range(k + 1, size) for j in range(k + 1, width))
        kept = ", ".join(f"a{i}_{j}" for i in range(k + 1) for j in range(i, width))
        parts.append(f"el{k} AS (SELECT {keys}, {kept}{', ' + cells if cells else ''} FROM {last})")
        last = f"el{k}"
    for i in reversed(range(size)):
        known = [f"(a{i}_{size + o}" + "".join(f" - a{i}_{j} * d{j}_{o}" for j in range(i + 1, size)) + f") / a{i}_{i} AS d{i}_{o}" for o in range(outputs)]
        parts.append(f"back{i} AS (SELECT *, {', '.join(known)} FROM {last})")
        last = f"back{i}"
    return parts + [f"solution AS (SELECT {keys}, {', '.join(f'd{i}_{o}' for i in range(size) for o in range(outputs))} FROM {last})"]


def wide_windows(ridge: float = 1e-6) -> str:
    """Least squares of every series on all series of the two hours before, from the sums of all rows."""
    z = ["1.0", *(f"{c}{j}" for c in "ab" for j in range(len(SERIES)))]
    k, outs = len(z), len(SERIES)
    sums = [f"sum({p} * {q}){f' + {ridge!r}' if i == j else ''} AS a{i}_{j}" for i, p in enumerate(z) for j, q in enumerate([*z, *(f"y{o}" for o in range(outs))])]
    outputs = ", ".join(" + ".join(f"d{i}_{o} * {p}" for i, p in enumerate(z)) + f" AS p{o}" for o in range(outs))
    return _with(SCALED, _vectors(), f"eq AS (SELECT 1 AS one, {', '.join(sums)} FROM x WHERE pos >= 2)", *solved("eq", k, "one", outs),
                 f"scored AS (SELECT x.*, {outputs} FROM x, solution WHERE pos >= 2)") + f"""SELECT series, {r6('avg(abs(y - p))')} AS mae,
  {r6('avg((y - p) * (y - p))')} AS mse, count(*) AS n FROM ({_long('y{j} AS y, p{j} AS p', 'scored')}) GROUP BY series"""


def product_step(start: list[float], season: int = 24) -> str:
    """One Gauss-Newton step, row by row: expanded lags, errors, their derivatives, five equations, halved until it helps."""
    _, f, g, t, u = start
    lags = [1, 2, season, season + 1, season + 2]
    x = ", ".join(f"lag(value, {k}) OVER w AS x{k}" for k in lags)
    shocks = ", ".join(f"x{k} - c - a * x{k + 1} AS e{k}" for k in (1, season, season + 1))
    one, two = season, season + 1
    pred = lambda c, f, g, t, u: (
        f"{c} + {f} * x1 + {g} * x{one} - {f} * {g} * x{two} + {t} * e1 + {u} * e{one} + {t} * {u} * e{two}")
    slopes = ["1.0", f"x1 - {g} * x{two}", f"x{one} - {f} * x{two}", f"e1 + {u} * e{two}", f"e{one} + {t} * e{two}"]
    sums = ", ".join(f"sum(j{i} * j{j}) AS a{i}_{j}" for i in range(5) for j in range(5))
    return _with(
        SCALED,
        f"z AS (SELECT *, {x} FROM s WINDOW w AS (PARTITION BY area, series ORDER BY ts))",
        f"l AS (SELECT area, series, regr_slope(value, x1) AS a, regr_intercept(value, x1) AS c FROM z WHERE x{season + 2} IS NOT NULL GROUP BY ALL)",
        f"ze AS (SELECT z.*, {shocks} FROM z JOIN l USING (area, series) WHERE x{season + 2} IS NOT NULL)",
        f"j AS (SELECT *, value - ({pred(*start)}) AS r, {', '.join(f'{s} AS j{i}' for i, s in enumerate(slopes))} FROM ze)",
        f"eq AS (SELECT area, series, {sums}, {', '.join(f'sum(j{i} * r) AS a{i}_5' for i in range(5))} FROM j GROUP BY ALL)",
        *solved("eq", 5, "area, series"),
        "tried AS (SELECT area, series, share, " + ", ".join(f"share * d{i}_0 + {v} AS f{i}" for i, v in enumerate(start))
        + " FROM solution, (SELECT pow(0.5, unnest(range(0, 20))) AS share))",
        f"err AS (SELECT area, series, share, f0, f1, f2, f3, f4, count(*) AS n, sum(pow(value - ({pred('f0', 'f1', 'f2', 'f3', 'f4')}), 2)) AS after, "
        "sum(r * r) AS before FROM j JOIN tried USING (area, series) GROUP BY ALL)",
    ) + f"""SELECT area, series, n, {r6('f0')} AS intercept, {r6('f1')} AS ar, {r6('f2')} AS seasonal_ar, {r6('f3')} AS ma,
  {r6('f4')} AS seasonal_ma, {r6('100 * after / n')} AS sigma2
FROM err WHERE after <= before QUALIFY row_number() OVER (PARTITION BY area, series ORDER BY share DESC) = 1"""


def one_step(rate: float) -> str:
    """Forward, backward and one step of the cell with one hidden unit over windows of one hour, then forward again."""
    w, n = _weights(), range(len(SERIES))
    sig = lambda x: f"(0.5 * (1 + tanh(0.5 * ({x}))))"
    names = {f"w{k}_{j}": w["w_input"][k][j] for k in (0, 2, 3) for j in n} | {f"b{k}": w["b_gate"][k] for k in (0, 2, 3)}
    names |= {f"v{j}": w["w_out"][j][0] for j in n} | {f"u{j}": w["b_out"][j] for j in n}

    def forward(source: str, name: str) -> list[str]:
        gates = {g: " + ".join([f"w{k}_{j} * x{j}" for j in n] + [f"b{k}"]) for g, k in (("i", 0), ("g", 2), ("o", 3))}
        return [
            f"{name}_g AS (SELECT *, {sig(gates['i'])} AS i, tanh({gates['g']}) AS g, {sig(gates['o'])} AS o FROM {source})",
            f"{name}_h AS (SELECT *, tanh(i * g) AS tc, o * tanh(i * g) AS h FROM {name}_g)",
            f"{name} AS (SELECT *, {', '.join(f'v{j} * h + u{j} - y{j} AS e{j}' for j in n)} FROM {name}_h)",
        ]

    back = " + ".join(f"2 * e{j} * v{j}" for j in n)
    slopes = {"i": "dc * g * i * (1 - i)", "g": "dc * i * (1 - g * g)", "o": "dh * tc * o * (1 - o)"}
    sums = {f"w{k}_{j}": f"sum(by_{g} * x{j})" for g, k in (("i", 0), ("g", 2), ("o", 3)) for j in n}
    sums |= {f"b{k}": f"sum(by_{g})" for g, k in (("i", 0), ("g", 2), ("o", 3))}
    sums |= {f"v{j}": f"sum(2 * e{j} * h)" for j in n} | {f"u{j}": f"sum(2 * e{j})" for j in n}
    moved = ", ".join(f"{v!r} - {rate!r} * G.{c} / (abs(G.{c}) + 1e-8) AS {c}" for c, v in names.items())
    loss = f"sum({' + '.join(f'e{j} * e{j}' for j in n)}) / (5 * count(*))"
    data = ", ".join(f"b{j} AS x{j}, y{j}" for j in n)
    return _with(
        SCALED, _vectors(), f"d AS (SELECT {data} FROM x WHERE pos >= 1 AND pos < floor(n * 0.6))",
        f"d0 AS (SELECT *, {', '.join(f'{v!r} AS {c}' for c, v in names.items())} FROM d)", *forward("d0", "one"),
        f"dh AS (SELECT *, {back} AS dh, ({back}) * o * (1 - tc * tc) AS dc FROM one)",
        f"dd AS (SELECT *, {', '.join(f'{v} AS by_{g}' for g, v in slopes.items())} FROM dh)",
        f"G AS (SELECT {', '.join(f'{v} / (5 * count(*)) AS {c}' for c, v in sums.items())} FROM dd)",
        f"moved AS (SELECT {moved} FROM G)", "d1 AS (SELECT * FROM d, moved)", *forward("d1", "two"),
    ) + f"""SELECT CAST(0 AS INTEGER) AS epoch, {r6(loss)} AS train_loss FROM one
UNION ALL SELECT CAST(1 AS INTEGER) AS epoch, {r6(loss)} AS train_loss FROM two"""


def _shock_models(out: dict[str, str]) -> None:
    out["m04_shock_model"] = out["m05_shock_refit"] = out["m06_shock_update"] = _with(SHOCK_MODEL) + f"""
SELECT model.area, model.series, CAST(1 AS INTEGER) AS p, CAST(1 AS INTEGER) AS q, CAST(0 AS INTEGER) AS sp,
  CAST(0 AS INTEGER) AS sq, n, l.i AS last_idx, {r6('b0')} AS intercept, {r6('b1')} AS lag_1, {r6('b2')} AS shock_1, {r6('sigma2 * 100')} AS sigma2
FROM model JOIN (SELECT area, series, CAST(epoch(max(ts)) AS BIGINT) // 3600 AS i FROM s WHERE value IS NOT NULL GROUP BY ALL) l USING (area, series)"""
    out["m08_shock_fitted"] = _with(SHOCK_MODEL) + f"""SELECT ze.area, ze.ts, ze.series, {r6('value')} AS value,
  {r6('b0 + b1 * x1 + b2 * e1')} AS predicted FROM ze JOIN model USING (area, series) WHERE value IS NOT NULL"""
    out["m07_shock_forecast"] = "WITH RECURSIVE " + SHOCK_MODEL + f""",
t AS (SELECT area, series, max(ts) AS ts, max_by(value, ts) AS v, max_by(e0, ts) AS e FROM ze GROUP BY ALL),
f AS (
  SELECT area, series, ts, 0 AS h, v AS y, e FROM t
  UNION ALL
  SELECT f.area, f.series, f.ts + INTERVAL 1 HOUR, h + 1, b0 + b1 * y + b2 * e, 0.0
  FROM f JOIN model ON model.area = f.area AND model.series = f.series WHERE h < 48)
SELECT area, ts, series, {r6('y')} AS predicted FROM f WHERE h > 0"""
    from .queries import LEARNING_RATE, PRODUCT_START

    out["m13_one_step"] = one_step(LEARNING_RATE)
    out["m04_product_step"] = product_step(PRODUCT_START)


SERIES = ["click", "error", "purchase", "signup", "view"]


def _weights() -> dict:
    from ..operators.network import initial_weights

    return {name: w.tolist() for name, w in initial_weights(len(SERIES), 1, len(SERIES)).items()}


def _cell(source: str, name: str, inputs: str, before: str | None) -> str:
    """One step of the cell with a single hidden unit: adds ``<name>_c`` and ``<name>_h``."""
    w = _weights()
    gates = []
    for k in range(4):
        parts = [f"({w['w_input'][k][j]!r}) * {inputs}{j}" for j in range(len(SERIES))] + [f"({w['b_gate'][k]!r})"]
        if before:
            parts.append(f"({w['w_hidden'][k][0]!r}) * {before}_h")
        gates.append(" + ".join(parts))
    sig = lambda x: f"(0.5 * (1 + tanh(0.5 * {x})))"
    kept = f"{sig('gf')} * {before}_c + " if before else ""
    cells = ", ".join(f"{g} AS {n}" for g, n in zip(gates, ("gi", "gf", "gg", "go")))
    return f"""{name}_g AS (SELECT *, {cells} FROM {source}),
{name} AS (SELECT * EXCLUDE (gi, gf, gg, go, cell), cell AS {name}_c, {sig('go')} * tanh(cell) AS {name}_h
  FROM (SELECT *, {kept}{sig('gi')} * tanh(gg) AS cell FROM {name}_g))"""


def _outputs(hidden: str, prefix: str) -> str:
    w = _weights()
    return ", ".join(f"({w['w_out'][j][0]!r}) * {hidden}_h + ({w['b_out'][j]!r}) AS {prefix}{j}" for j in range(len(SERIES)))


def _vectors() -> str:
    """One row per hour: the hour's own values ``y``, those two hours (``a``) and one hour before (``b``)."""
    cells = ", ".join(f"max(CASE WHEN series = '{s}' THEN CAST(CAST(value AS FLOAT) AS DOUBLE) END) AS y{j}" for j, s in enumerate(SERIES))
    lags = ", ".join(f"lag(y{j}, 2) OVER w AS a{j}, lag(y{j}, 1) OVER w AS b{j}" for j in range(len(SERIES)))
    return f"""v AS (SELECT ts, {cells} FROM s GROUP BY ts),
x AS (SELECT *, {lags}, row_number() OVER w - 1 AS pos, count(*) OVER () AS n FROM v WINDOW w AS (ORDER BY ts))"""


def _scored() -> str:
    return _with(SCALED, _vectors(), _cell("x", "one", "a", None), _cell("one", "two", "b", "one"),
                 f"scored AS (SELECT *, {_outputs('two', 'p')} FROM two WHERE pos >= 2)")


def _long(columns: str, source: str) -> str:
    return "\nUNION ALL\n".join(f"SELECT 'k' AS area, '{s}' AS series, {columns.format(j=j)} FROM {source}" for j, s in enumerate(SERIES))


def _small_models(out: dict[str, str]) -> None:
    model = _with(LAG_MODEL) + f"""SELECT model.area, model.series, CAST(1 AS INTEGER) AS p, CAST(0 AS INTEGER) AS q, CAST(1 AS INTEGER) AS sp,
  CAST(0 AS INTEGER) AS sq, n, l.i AS last_idx, {r6('b0')} AS intercept, {r6('b1')} AS lag_1, {r6('b2')} AS lag_24, {r6('sigma2 * 100')} AS sigma2
FROM model JOIN (SELECT area, series, CAST(epoch(max(ts)) AS BIGINT) // 3600 AS i FROM s WHERE value IS NOT NULL GROUP BY ALL) l USING (area, series)"""
    out["m04_lag_model"] = out["m05_lag_refit"] = out["m06_lag_update"] = out["s04_stored_models"] = model
    out["m08_lag_fitted"] = _with(LAG_MODEL) + f"""SELECT z.area, z.ts, z.series, {r6('value')} AS value,
  {r6('b0 + b1 * x1 + b2 * x2')} AS predicted FROM z JOIN model USING (area, series) WHERE value IS NOT NULL"""
    out["m07_lag_forecast"] = "WITH RECURSIVE " + LAG_MODEL + f""",
t AS (SELECT area, series, max(ts) AS ts, list(value ORDER BY ts DESC)[:24] AS last FROM s GROUP BY ALL),
f AS (
  SELECT area, series, ts, 0 AS h, last, CAST(NULL AS DOUBLE) AS y FROM t
  UNION ALL
  SELECT f.area, f.series, f.ts + INTERVAL 1 HOUR, h + 1, list_prepend(b0 + b1 * last[1] + b2 * last[24], last[:23]), b0 + b1 * last[1] + b2 * last[24]
  FROM f JOIN model ON model.area = f.area AND model.series = f.series WHERE h < 48)
SELECT area, ts, series, {r6('y')} AS predicted FROM f WHERE h > 0"""
    out["m09_cell"] = _scored() + _long(f"ts, {r6('y{j}')} AS value, {r6('p{j}')} AS predicted", "scored")
    out["m11_cell_errors"] = _scored() + f"""SELECT series, {r6('avg(abs(y - p))')} AS mae, {r6('avg((y - p) * (y - p))')} AS mse, count(*) AS n FROM (
{_long('y{j} AS y, p{j} AS p', 'scored')}) WHERE y - p IS NOT NULL GROUP BY series"""
    again = ", ".join(f"p{j} AS q{j}" for j in range(len(SERIES)))
    out["m10_two_steps"] = _with(
        SCALED, _vectors(), _cell("x", "one", "a", None), _cell("one", "two", "b", "one"),
        f"scored AS (SELECT *, {_outputs('two', 'p')} FROM two WHERE pos >= 2)",
        f"moved AS (SELECT ts, pos, " + ", ".join(f"b{j}" for j in range(len(SERIES))) + f", {again} FROM scored)",
        _cell("moved", "three", "b", None), _cell("three", "four", "q", "three"),
        f"further AS (SELECT *, {_outputs('four', 'r')} FROM four)",
    ) + _long(f"pos - 2 AS window_id, CAST(1 AS INTEGER) AS horizon, ts, {r6('p{j}')} AS predicted", "scored") + "\nUNION ALL\n" + _long(
        f"pos - 2 AS window_id, CAST(2 AS INTEGER) AS horizon, ts + INTERVAL 1 HOUR AS ts, {r6('r{j}')} AS predicted", "further")
    squares = " + ".join(f"(y{j} - p{j}) * (y{j} - p{j})" for j in range(len(SERIES)))
    out["m13_first_loss"] = _scored() + f"""SELECT CAST(0 AS INTEGER) AS epoch, {r6(f'sum({squares}) / (5 * count({squares}))')} AS train_loss
FROM scored WHERE pos < floor(n * 0.6)"""
    lines = _with(
        SCALED, "v AS (SELECT area, ts, series, CAST(CAST(value AS FLOAT) AS DOUBLE) AS y FROM s)",
        "x AS (SELECT *, lag(y) OVER w AS x, row_number() OVER w AS pos FROM v WINDOW w AS (PARTITION BY area, series ORDER BY ts))",
        "b AS (SELECT series, regr_slope(y, x) AS b1, regr_intercept(y, x) AS b0 FROM x GROUP BY series)",
    )
    out["m12_wide_windows"] = wide_windows()
    out["s05_stored_lines"] = lines + "\nUNION ALL\n".join(
        f"SELECT 'lines' AS run_id, series AS name, CAST({i} AS INTEGER) AS pos, {r6(f'b{i}')} AS value FROM b" for i in (0, 1))
    out["m12_line_per_series"] = lines + f"""SELECT area, ts, series, {r6('y')} AS value, {r6('b0 + b1 * x')} AS predicted
FROM x JOIN b USING (series) WHERE pos > 1"""


def kpss_by_length(source: str, name: str, most: int = 60) -> str:
    """As ``kpss``, with 12 (n / 100)^(1/4) lags for a series of ``n`` values; ``most`` covers them."""
    pairs = "\n    + ".join(f"2 * sum(greatest(0, 1 - {j} / (l + 1.0)) * e * lag{j})" for j in range(1, most + 1))
    lagged = ", ".join(f"coalesce(lag(e, {j}) OVER w, 0) AS lag{j}" for j in range(1, most + 1))
    return f"""{name}_e AS (SELECT *, x - avg(x) OVER p AS e, floor(12 * pow(count(*) OVER p / 100.0, 0.25)) AS l
  FROM {source} WINDOW p AS (PARTITION BY area, series, d)),
{name}_w AS (SELECT *, sum(e) OVER (PARTITION BY area, series, d ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s, {lagged}
  FROM {name}_e WINDOW w AS (PARTITION BY area, series, d ORDER BY ts)),
{name} AS (SELECT area, series, d, count(*) AS n,
    sum(s * s) / (count(*) * count(*)) / ((sum(e * e) + {pairs}) / count(*)) AS kpss
  FROM {name}_w GROUP BY area, series, d)"""


# Fixed value: critical value of the seasonal test for a season of 24, from the formula named in the lag models.
SEASONAL_24 = -1.756445


def all_oracles() -> dict[str, str]:
    out: dict[str, str] = {}
    cells = f"area, ts, series, {r6('value')} AS value"

    out["s01_range"] = _with(EVENTS) + "SELECT area, ts, series, value FROM raw " \
        "WHERE ts >= TIMESTAMP '2024-01-04 23:00:00' AND ts < TIMESTAMP '2024-01-11 23:00:00'"
    out["s02_platform"] = _with(binned(), grid()) + \
        f"SELECT area, ts, series || ' Actual Aggregated' AS series, {r6('value')} AS value FROM hourly"
    out["s03_results"] = _with(DAILY_ORDERS) + f"SELECT {cells}, 'exp1' AS experiment_id FROM daily"
    out["p01_flat_names"] = _with(LINES) + "SELECT series, count(*) AS n FROM lines GROUP BY series"
    out["p02_float"] = "SELECT event_id, CASE WHEN event_type <> 'error' THEN value END AS value FROM events"
    out["p03_fill"] = _with(binned(), grid()) + "SELECT area, ts, series, " + \
        r6("CASE WHEN series = 'error' THEN coalesce(value, 0) ELSE value END") + " AS value FROM hourly"
    out["p04_local"] = "SELECT event_id, ts + INTERVAL 1 HOUR AS ts FROM events"
    out["p05_drop"] = _with(binned(), grid()) + \
        f"SELECT {cells} FROM hourly WHERE series NOT LIKE '%sign%' AND series NOT LIKE '%err%'"
    out["p06_categories"] = _with(binned(), grid(), grouped("hourly", "g")) + f"SELECT {cells} FROM g"
    out["p07_day_type"] = _with(ORDER_DATES, HOLIDAYS, day_types("dates")) + "SELECT date, day_type FROM days"
    out["p08_holidays"] = _with(ORDER_DATES, HOLIDAYS) + \
        "SELECT 'DE' AS country, date, name FROM dates JOIN holidays USING (date)"
    calendar = _with(ORDER_DATES, HOLIDAYS, day_types("dates")) + \
        "SELECT 'DE' AS country, date, weekday, holiday, day_type AS category FROM days"
    out["p09_calendar"] = out["j04_calendar_table"] = calendar
    out["p10_next_date"] = _with(
        ORDER_DATES, HOLIDAYS,
        "span AS (SELECT CAST(unnest(generate_series(TIMESTAMP '1995-01-01', TIMESTAMP '2001-12-31', INTERVAL 1 DAY)) "
        "AS DATE) AS date)",
        day_types("span"),
    ) + """SELECT a.date, min(b.date) AS next_date FROM dates JOIN days a USING (date)
LEFT JOIN days b ON b.date > a.date AND b.date <= a.date + 7 AND b.day_type = a.day_type GROUP BY a.date"""
    out["p11_residual"] = DAY_BEFORE + f"""SELECT area, ts, series, {r6('actual')} AS actual,
  {r6('predicted')} AS predicted, {r6('residual')} AS residual FROM diff"""
    out["p12_labels"] = """SELECT series, upper(substr(t, 1, 1)) || lower(substr(t, 2)) AS label, n FROM (
  SELECT 'Price_OF_' || replace(lower(o_orderpriority), ' ', '_') AS series, replace(series, '_', ' ') AS t,
    count(*) AS n FROM orders GROUP BY ALL)"""
    out["p13_comparison"] = DAY_BEFORE + "\nUNION ALL\n".join(
        f"""SELECT area, ts, series, upper(substr(series, 1, 1)) || substr(series, 2) || '{tail}' AS label,
  '{kind}' AS kind, {r6(column)} AS value, 'Mega Watt' AS unit FROM diff"""
        for kind, column, tail in [("actual", "actual", ""), ("predicted", "predicted", " predicted"),
                                   ("residuals", "residual", " residuals")]
    )
    out["p14_dates"] = "SELECT o_orderkey, CAST(o_orderdate AS DATE) AS date, " \
        "strftime(o_orderdate, '%Y-%m-%d') AS text, CAST(o_orderdate AS DATE) + 7 AS week_later FROM orders"
    out["p15_float32"] = _with(binned(), grid()) + "SELECT area, ts, " \
        "CAST(row_number() OVER (PARTITION BY ts ORDER BY series) - 1 AS INTEGER) AS pos, " + \
        r6("CAST(CAST(value AS FLOAT) AS DOUBLE)") + " AS value FROM hourly"
    out["j01_combine"] = out["f01_align"] = _with(binned(), grid()) + f"SELECT {cells} FROM hourly"

    out["j06_paired"] = _with(binned()) + f"""SELECT a.area, a.ts, a.series, {r6('a.value')} AS actual,
  {r6('p.value')} AS predicted FROM cells a JOIN cells p ON a.ts = p.ts + INTERVAL 1 DAY AND a.series = p.series"""
    out["a01_downsample"] = out["a01_stream"] = _with(EVENTS, spine("raw", 3600, "hours")) + f"SELECT {cells} FROM hours"
    out["a01_downsample_lines"] = _with(LINES, spine("lines", 86400, "d")) + f"SELECT {cells} FROM d"
    out["a02_scaler"] = 'SELECT min(l_quantity) AS min, max(l_quantity) AS max FROM lineitem'
    out["a03_scale"] = _with(binned(), grid(), "b AS (SELECT min(value) AS lo, max(value) AS hi FROM hourly)") + \
        f"SELECT area, ts, series, {r6('(value - lo) / (hi - lo)')} AS value FROM hourly, b"
    out["a04_unscale"] = out["f01_align"]
    out["a05_partial_days"] = """SELECT area, date, min(n) AS least_rows, max(n) AS most_rows FROM (
  SELECT substr(props, 3, 1) AS area, event_type, CAST(ts AS DATE) AS date, count(*) AS n FROM events GROUP BY ALL)
GROUP BY ALL HAVING min(n) <> 24 OR max(n) <> 24"""
    out["a06_dates"] = "SELECT DISTINCT CAST(l_shipdate AS DATE) AS date FROM lineitem"
    out["a07_errors"] = _with(COMPLETE, profile("complete", 3)) + f"""SELECT series,
  {r6('avg(abs(value - pslp))')} AS mae,
  {r6('avg(abs(value - pslp) / greatest(abs(value), 2.220446049250313e-16))')} AS mape,
  {r6('avg((value - pslp) * (value - pslp))')} AS mse, count(*) AS n
FROM profiled WHERE value - pslp IS NOT NULL GROUP BY series"""
    out["a08_null_mean"] = _with(EVENTS, spine("raw", 3600, "hours"), profile("hours", 3)) + \
        f"SELECT area, ts, series, {r6('pslp')} AS pslp FROM profiled"
    out["a09_epoch_loss"] = _with(EPOCHS) + f"SELECT run_id, epoch, {r6('loss')} AS loss FROM epochs"
    out["a10_summary"] = _with(binned(), grid()) + "SELECT area, count(*) AS n_cells, " \
        "count(DISTINCT ts) AS n_rows, count(DISTINCT series) AS n_series FROM hourly GROUP BY area"
    out["f02_interpolate"] = _with(binned(), grid(), filled("hourly", "f")) + f"SELECT {cells} FROM f"

    out["w01_profile"] = _with(COMPLETE, profile("complete", 3)) + f"""SELECT area, ts, series,
  {r6('value')} AS value, day_type, {r6('pslp')} AS pslp, {r6('value - pslp')} AS residual FROM profiled"""
    out["w01_profile_orders"] = _with(DAILY_ORDERS, profile("daily", 3)) + \
        f"SELECT area, ts, series, day_type, {r6('pslp')} AS pslp FROM profiled"
    out["w02_single_date"] = _with(COMPLETE, profile("complete", 3)) + \
        f"SELECT area, ts, series, day_type, {r6('pslp')} AS pslp, 'ok' AS status FROM profiled WHERE CAST(ts AS DATE) = DATE '2024-01-27'"
    future = _with(
        COMPLETE, HOLIDAYS,
        "seen AS (SELECT DISTINCT CAST(ts AS DATE) AS date FROM complete)",
        "ahead AS (SELECT (SELECT max(date) FROM seen) + CAST(i AS INTEGER) AS date FROM range(1, 8) t(i))",
        day_types("seen", "past"), day_types("ahead", "next"),
        "goal AS (SELECT day_type, min(date) AS date FROM next GROUP BY day_type)",
        "chosen AS (SELECT date, day_type FROM (SELECT *, row_number() OVER (PARTITION BY day_type ORDER BY date DESC) "
        "AS r FROM past) WHERE r <= 3)",
        """future AS (SELECT s.area, g.date + (s.ts - CAST(CAST(s.ts AS DATE) AS TIMESTAMP)) AS ts, s.series, c.day_type,
    CASE WHEN count(s.value) = 3 THEN avg(s.value) END AS pslp
  FROM chosen c JOIN goal g USING (day_type) JOIN complete s ON CAST(s.ts AS DATE) = c.date GROUP BY ALL)""",
    )
    out["w02_future"] = future + f"SELECT area, ts, series, day_type, {r6('pslp')} AS pslp FROM future"
    out["j03_attach"] = future + f"""SELECT c.area, c.ts, c.series, {r6('c.value')} AS value, {r6('f.pslp')} AS pslp
FROM complete c LEFT JOIN future f ON f.ts - INTERVAL 14 DAY = c.ts AND f.series = c.series"""
    out["w03_last_days"] = _with(
        "d0 AS (SELECT DISTINCT l_linestatus AS area, CAST(l_shipdate AS DATE) AS date FROM lineitem)", HOLIDAYS,
        day_types("d0"),
    ) + """SELECT area, date, day_type, CAST(r AS INTEGER) AS position FROM (
  SELECT *, row_number() OVER (PARTITION BY area, day_type ORDER BY date DESC) AS r FROM d0 JOIN days USING (date))
WHERE r <= 3"""
    out["w04_slots"] = "SELECT event_id, CAST((hour(ts) * 60 + minute(ts)) // 15 AS INTEGER) AS slot FROM events"
    out["w05_skip_partial"] = partial_profile("complete_day", "s.value")
    out["w05_null_partial"] = partial_profile("TRUE", "CASE WHEN ok THEN s.value END")

    out["w06_windows"] = window_sums(168, 1, 1)
    out["w07_one_window"] = window_sums(168, 1, 1, "s.pos = 100")
    out["w07_window_count"] = _with(COMPLETE) + \
        "SELECT area, greatest(count(DISTINCT ts) - 168, 0) AS n_windows FROM complete GROUP BY area"
    out["w08_early_stop"] = _with(
        EPOCHS,
        """marked AS (SELECT *, row_number() OVER w AS pos, min(loss) OVER (PARTITION BY run_id ORDER BY epoch
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS best FROM epochs WINDOW w AS (PARTITION BY run_id ORDER BY epoch))""",
        """waits AS (SELECT *, pos - max(CASE WHEN best IS NULL OR loss <= best THEN pos END)
    OVER (PARTITION BY run_id ORDER BY epoch) AS waited FROM marked)""",
        "stops AS (SELECT run_id, min(CASE WHEN waited >= 5 THEN epoch END) AS stop_epoch FROM waits GROUP BY run_id)",
    ) + f"""SELECT run_id, CAST(stop_epoch AS BIGINT) AS stop_epoch, {r6('min(loss)')} AS best_loss
FROM epochs JOIN stops USING (run_id) WHERE stop_epoch IS NULL OR epoch <= stop_epoch GROUP BY ALL"""
    out["w09_logged"] = _with(EPOCHS) + f"SELECT run_id, epoch, {r6('loss')} AS loss FROM epochs WHERE epoch % 10 = 0"
    out["u01_difference"] = _with(binned(), grid(), grouped("hourly", "g")) + \
        "SELECT series FROM hourly EXCEPT SELECT series FROM g"
    out["u01_intersection"] = _with(binned(), grid(), grouped("hourly", "g")) + \
        "SELECT series FROM hourly INTERSECT SELECT series FROM g"
    out["g01_forecast_index"] = "SELECT 'k' AS area, unnest(generate_series(h, h + INTERVAL 7 DAY, INTERVAL 1 HOUR)) AS ts " \
        "FROM (SELECT CAST(date_trunc('hour', max(ts)) AS TIMESTAMP) AS h FROM events)"
    out["g02_day_slots"] = _with(ORDER_DATES) + "SELECT date, CAST(i AS INTEGER) AS slot, " \
        "CAST(date AS TIMESTAMP) + to_hours(CAST(i AS INTEGER)) AS ts FROM dates, range(24) t(i)"
    out["g03_next_dates"] = _with(ORDER_DATES) + \
        "SELECT date, date + CAST(i AS INTEGER) AS next_date FROM dates, range(1, 8) t(i)"

    out["m01_kpss"] = _with(DAILY_ORDERS, "x0 AS (SELECT area, series, 0 AS d, ts, value AS x FROM daily)", kpss("x0", "k")) + \
        f"SELECT area, series, n, {r6('kpss')} AS kpss FROM k"
    seasonal = _with(
        COMPLETE,
        """lagged AS (SELECT area, series, value AS y, lag(value, 1) OVER w AS l1, lag(value, 24) OVER w AS l24,
    lag(value, 25) OVER w AS l25 FROM complete WINDOW w AS (PARTITION BY area, series ORDER BY ts))""",
        """reg AS (SELECT area, series, y - l1 - l24 + l25 AS d, l1 - l25 AS a, l24 - l25 AS b FROM lagged
    WHERE y + l1 + l24 + l25 IS NOT NULL)""",
        """sums AS (SELECT area, series, count(*) AS n, sum(a * a) AS aa, sum(a * b) AS ab, sum(b * b) AS bb,
    sum(a * d) AS ad, sum(b * d) AS bd, sum(d * d) AS dd FROM reg GROUP BY ALL)""",
        """beta AS (SELECT *, aa * bb - ab * ab AS det, (bb * ad - ab * bd) / (aa * bb - ab * ab) AS ba,
    (aa * bd - ab * ad) / (aa * bb - ab * ab) AS bs FROM sums)""",
        "stat AS (SELECT area, series, bs / sqrt((dd - ba * ad - bs * bd) / (n - 2) * aa / det) AS t FROM beta)",
    )
    out["m02_seasonal_order"] = seasonal + f"SELECT area, series, {r6('t')} AS t_stat, CAST(t > -1.8 AS INTEGER) AS sd FROM stat"
    out["m01_differencing"] = seasonal.rstrip() + """,
diffs AS (SELECT area, series, ts, value, lag(value, 1) OVER w AS k1, lag(value, 2) OVER w AS k2
  FROM complete WHERE value IS NOT NULL WINDOW w AS (PARTITION BY area, series ORDER BY ts)),
xs AS (SELECT area, series, 0 AS d, ts, value AS x FROM diffs
  UNION ALL SELECT area, series, 1, ts, value - k1 FROM diffs WHERE k1 IS NOT NULL
  UNION ALL SELECT area, series, 2, ts, value - 2 * k1 + k2 FROM diffs WHERE k2 IS NOT NULL),
""" + kpss_by_length("xs", "k") + f"""
SELECT area, series, CAST(coalesce(min(CASE WHEN kpss <= 0.463 THEN d END), 2) AS INTEGER) AS d,
  CAST(any_value(t) > {SEASONAL_24} AS INTEGER) AS sd
FROM k JOIN stat USING (area, series) GROUP BY area, series"""
    columns = ["1.0", "lag(value, 1) OVER w", "lag(value, 2) OVER w", "lag(value, 24) OVER w", "value"]
    pairs = [(i, j) for i in range(5) for j in range(i, 5)]
    out["m04_cross_products"] = _with(
        COMPLETE, "s AS (SELECT area, ts, series, (value - (SELECT min(value) FROM complete)) / "
        "((SELECT max(value) FROM complete) - (SELECT min(value) FROM complete)) AS value FROM complete)",
        "z AS (SELECT area, series, " + ", ".join(f"{c} AS z{i}" for i, c in enumerate(columns)) +
        " FROM s WINDOW w AS (PARTITION BY area, series ORDER BY ts))",
    ) + "\nUNION ALL\n".join(
        f"SELECT area, series, count(*) AS n, CAST({k} AS INTEGER) AS pos, {r6(f'sum(z{i} * z{j})')} AS value "
        "FROM z WHERE z1 + z2 + z3 + z4 IS NOT NULL GROUP BY area, series" for k, (i, j) in enumerate(pairs)
    )
    out["m01_differencing_order"] = _with(
        DAILY_ORDERS,
        """diffs AS (SELECT area, series, ts, value, lag(value, 1) OVER w AS l1, lag(value, 2) OVER w AS l2
  FROM daily WINDOW w AS (PARTITION BY area, series ORDER BY ts))""",
        """xs AS (SELECT area, series, 0 AS d, ts, value AS x FROM diffs
  UNION ALL SELECT area, series, 1, ts, value - l1 FROM diffs WHERE l1 IS NOT NULL
  UNION ALL SELECT area, series, 2, ts, value - 2 * l1 + l2 FROM diffs WHERE l2 IS NOT NULL)""",
        kpss("xs", "k"),
    ) + """SELECT area, series, CAST(coalesce(min(CASE WHEN kpss <= 0.463 THEN d END), 2) AS INTEGER) AS d
FROM k GROUP BY area, series"""
    out["m03_difference"] = _with(COMPLETE) + f"""SELECT area, ts, series, {r6(
        'value - lag(value, 1) OVER w - lag(value, 24) OVER w + lag(value, 25) OVER w')} AS value
FROM complete WINDOW w AS (PARTITION BY area, series ORDER BY ts)"""
    out["d01_persistence"] = _with(COMPLETE) + f"""SELECT area, ts, series, {r6('value')} AS value,
  {r6('lag(value) OVER (PARTITION BY area, series ORDER BY ts)')} AS predicted FROM complete"""
    out["d02_category_persistence"] = _with(COMPLETE, profile("complete", 1)) + \
        f"SELECT area, ts, series, {r6('pslp')} AS pslp FROM profiled"
    out["d03_split"] = _with(
        COMPLETE, "p AS (SELECT *, rank() OVER (PARTITION BY series ORDER BY ts) - 1 AS pos, "
        "count(*) OVER (PARTITION BY series) AS n FROM complete)",
    ) + """SELECT area, series, CASE WHEN pos < floor(n * 0.6) THEN 'train' WHEN pos < floor(n * 0.8) THEN 'valid'
  ELSE 'test' END AS part, count(*) AS n, min(ts) AS first_ts, max(ts) AS last_ts FROM p GROUP BY ALL"""
    out["d04_daily_stride"] = window_sums(168, 24, 24)
    out["d05_scaled_profile"] = _with(
        COMPLETE, "s AS (SELECT area, ts, series, (value - (SELECT min(value) FROM complete)) / "
        "((SELECT max(value) FROM complete) - (SELECT min(value) FROM complete)) AS value FROM complete)",
        profile("s", 3),
    ) + f"""SELECT area, ts, series, {r6('value')} AS scaled, {r6('pslp')} AS scaled_pslp,
  {r6('value - pslp')} AS scaled_residual FROM profiled"""
    out["d06_balance"] = _with(
        COMPLETE, "b AS (SELECT area, ts, sum(CASE WHEN series <> 'view' THEN value END) AS g, "
        "sum(CASE WHEN series = 'view' THEN value END) AS l FROM complete GROUP BY ALL)",
    ) + f"SELECT area, ts, {r6('g')} AS generation, {r6('l')} AS load, {r6('g - l')} AS balance FROM b"
    out["prepared_dataset"] = _with(
        binned(), grid(),
        "zeroed AS (SELECT area, ts, series, CASE WHEN series = 'error' THEN coalesce(value, 0) ELSE value END AS value "
        "FROM hourly)",
        filled("zeroed", "f"), grouped("f", "g"), spine("g", 10800, "three"),
    ) + f"SELECT {cells} FROM three"
    _small_models(out)
    _shock_models(out)
    # All areas of the orders, by their own dates; 1 August 2001 is a Wednesday.
    day = "DATE '2001-08-01'"
    out["w02_date_of_areas"] = _with(
        DAILY_ORDERS, HOLIDAYS, "d0 AS (SELECT DISTINCT area, CAST(ts AS DATE) AS date FROM daily)", day_types("d0", "kinds"),
        "span AS (SELECT CAST(unnest(generate_series(TIMESTAMP '2001-07-01', TIMESTAMP '2001-08-08', INTERVAL 1 DAY)) AS DATE) AS date)",
        day_types("span", "near"), "ends AS (SELECT area, max(date) AS hi FROM d0 GROUP BY area)",
        f"far AS (SELECT DISTINCT area FROM ends JOIN near ON near.date > hi AND near.date < {day} AND day_type = 0)",
        f"""chosen AS (SELECT area, date FROM (
    SELECT area, date, row_number() OVER (PARTITION BY area ORDER BY date DESC) AS r FROM d0 JOIN kinds USING (date)
    WHERE day_type = 0 AND date < {day}) WHERE r <= 3)""",
        """means AS (SELECT s.area, s.series, CASE WHEN count(s.value) = 3 THEN avg(s.value) END AS pslp
  FROM chosen c JOIN daily s ON s.area = c.area AND CAST(s.ts AS DATE) = c.date GROUP BY ALL)""",
    ) + f"""SELECT area, CAST({day} AS TIMESTAMP) AS ts, series, CAST(0 AS INTEGER) AS day_type, {r6('pslp')} AS pslp, 'ok' AS status
FROM means WHERE area NOT IN (SELECT area FROM far)
UNION ALL SELECT area, NULL, NULL, NULL, NULL, '20010801 lies too far after the data' FROM far"""
    return out
