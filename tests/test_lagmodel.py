import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from wattframe.operators import lagmodel, lags
from wattframe.operators.lagmodel import Search
from wattframe.plans import sarima

SMALL = Search(m=6, long_lags=14, block=64)


def seasonal(n=400, seed=0, m=6):
    rng = np.random.default_rng(seed)
    e, y = rng.normal(size=n), np.zeros(n)
    for t in range(n):
        y[t] = 2 + 0.5 * y[t - 1] * (t >= 1) + 0.3 * y[t - m] * (t >= m) + e[t] + 0.4 * e[t - 1] * (t >= 1)
    return y


def zero_orders(df, d=0, sd=0):
    return df.select("area", "series").distinct().select("*", F.lit(d).alias("d"), F.lit(sd).alias("sd"))


def lag_columns(w, lags_):
    return np.column_stack([np.concatenate([np.full(k, np.nan), w[:-k]]) for k in lags_])


def difference(y, d, sd, m):
    w = np.array(y, dtype=float)
    for k in [1] * d + [m] * sd:
        w = np.concatenate([np.full(k, np.nan), w[k:] - w[:-k]])
    return w


def regression(x, y):
    ok = np.isfinite(x).all(axis=1) & np.isfinite(y)
    beta = np.linalg.lstsq(x[ok], y[ok], rcond=None)[0]
    return beta, float(((y[ok] - x[ok] @ beta) ** 2).sum()), int(ok.sum())


def two_stages(y, search, d=0, sd=0):
    """The two regressions over the whole series at once; every candidate on the same rows."""
    w = difference(y, d, sd, search.m)
    long = np.column_stack([np.ones(len(w)), lag_columns(w, range(1, search.long_order() + 1))])
    phi, _, _ = regression(long, w)
    e = w - long @ phi
    ar, ma = search.ar_lags(), search.ma_lags()
    full = np.column_stack([np.ones(len(w)), lag_columns(w, ar), lag_columns(e, ma)])
    ok = np.isfinite(full).all(axis=1) & np.isfinite(w)
    best = None
    for p, q, sp, sq in search.candidates():
        own_ar, own_ma = lagmodel.lag_set(p, sp, search.m), lagmodel.lag_set(q, sq, search.m)
        columns = [0] + [1 + ar.index(k) for k in own_ar] + [1 + len(ar) + ma.index(k) for k in own_ma]
        beta, rss, n = regression(full[ok][:, columns], w[ok])
        aic = n * np.log(rss / n) + 2 * (len(beta) + 1)
        if best is None or aic < best[0]:
            best = (aic, (p, q, sp, sq), beta, own_ar, own_ma)
    return phi, e, w, best


@pytest.mark.parametrize("d,sd", [(0, 0), (1, 0), (1, 1)])
def test_fit_equals_whole_series_regression(readings, d, sd):
    y = seasonal()
    df = readings(y)
    got = lagmodel.fit_new(df, zero_orders(df, d, sd), SMALL).first()
    phi, _, _, (aic, orders, beta, ar, ma) = two_stages(y, SMALL, d, sd)
    np.testing.assert_allclose(got.long_coef, phi, rtol=1e-6, atol=1e-8)
    assert (got.p, got.q, got.sp, got.sq) == orders and got.aic == pytest.approx(aic, rel=1e-8)
    np.testing.assert_allclose([got.intercept, *got.ar_coef, *got.ma_coef], beta, rtol=1e-5, atol=1e-7)
    assert (got.ar_lags, got.ma_lags) == (ar, ma)


def test_block_size_does_not_matter(readings):
    df = readings({"x": seasonal(300, 1), "y": seasonal(300, 2)})
    results = []
    for block in (50, 1000):
        search = Search(m=6, long_lags=14, block=block)
        rows = lagmodel.fit_new(df, zero_orders(df), search).orderBy("series").collect()
        results.append([(r.p, r.q, r.sp, r.sq, r.n, round(r.aic, 6)) for r in rows])
    assert results[0] == results[1]


def test_forecast_equals_recursion(readings):
    y = seasonal(300, 3)
    df = readings(y)
    models = lagmodel.fit_new(df, zero_orders(df, 1, 1), SMALL)
    start = dt.datetime(2024, 1, 1) + dt.timedelta(hours=300)
    got = lagmodel.forecast(df, models, str(start), str(start + dt.timedelta(hours=47)), SMALL).orderBy("ts").collect()
    _, e, w, (_, _, beta, ar, ma) = two_stages(y, SMALL, 1, 1)
    w, e, path = list(w), list(e) + [0.0] * 48, list(y)
    for t in range(300, 348):
        w.append(beta[0] + sum(b * w[t - k] for b, k in zip(beta[1:], ar))
                 + sum(b * e[t - k] for b, k in zip(beta[1 + len(ar):], ma)))
        path.append(w[t] + path[t - 1] + path[t - 6] - path[t - 7])
    assert len(got) == 48 and got[0].ts == start
    np.testing.assert_allclose([r.predicted for r in got], path[300:], rtol=1e-4, atol=1e-4)


def test_forecast_must_start_after_the_data(readings):
    df = readings(seasonal(200, 3))
    models = lagmodel.fit_new(df, zero_orders(df), SMALL)
    with pytest.raises(Exception, match="right after its data"):
        lagmodel.forecast(df, models, "2025-01-01", "2025-01-02", SMALL).collect()
    assert lagmodel.forecast(df, models, "2025-01-01", "2025-01-02", SMALL, any_start=True).count() == 25


def test_fitted_values(readings):
    y = seasonal(300, 4)
    df = readings(y)
    models = lagmodel.fit_new(df, zero_orders(df, 0, 1), SMALL)
    got = lagmodel.fitted_values(df, models, SMALL).orderBy("ts").collect()
    _, e, w, (_, _, beta, ar, ma) = two_stages(y, SMALL, 0, 1)
    step = beta[0] + lag_columns(w, ar) @ beta[1 : 1 + len(ar)] + lag_columns(np.array(e), ma) @ beta[1 + len(ar):]
    want = y - (w - step)
    assert len(got) == 300
    for r, v in zip(got, want):
        assert (r.predicted is None) if np.isnan(v) else r.predicted == pytest.approx(v, rel=1e-5, abs=1e-6)


def test_update_adds_the_new_rows(readings):
    y = seasonal(400, 5)
    old, both = readings(y[:300]), readings(y)
    first = lagmodel.fit_new(old, zero_orders(old), SMALL)
    got = lagmodel.update(both, first, SMALL).first()
    before = first.first()
    # All rows at the stage-1 coefficients of the first fit.
    w = np.array(y)
    long = np.column_stack([np.ones(400), lag_columns(w, range(1, SMALL.long_order() + 1))])
    e = w - long @ np.array(before.long_coef)
    x = np.column_stack([np.ones(400), lag_columns(w, SMALL.ar_lags()), lag_columns(e, SMALL.ma_lags()), w])
    x = x[np.isfinite(x).all(axis=1)]
    want = (x.T @ x)[np.triu_indices(x.shape[1])]
    np.testing.assert_allclose(got["products"], want, rtol=1e-8)
    assert got.n == len(x) and got.last_idx == before.last_idx + 100
    assert (got.p, got.q, got.sp, got.sq) == (before.p, before.q, before.sp, before.sq)
    idle = lagmodel.update(old, first, SMALL).first()
    assert idle.n == before.n and idle.aic == pytest.approx(before.aic)


def test_wrong_search_is_refused(readings):
    df = readings(seasonal(300, 6))
    with pytest.raises(Exception, match="above max_d"):
        lagmodel.fit_new(df, zero_orders(df, 0, 2), SMALL).collect()
    models = lagmodel.fit_new(df, zero_orders(df), SMALL)
    with pytest.raises(Exception, match="another search"):
        lagmodel.update(df, models, Search(m=12, long_lags=14, block=64)).collect()


def test_refit_keeps_the_orders(readings):
    df = readings(seasonal(300, 6))
    first = lagmodel.fit_new(df, zero_orders(df), SMALL)
    again = lagmodel.refit(df, first, SMALL).first()
    was = first.first()
    assert (again.p, again.q, again.sp, again.sq, again.aic) == (was.p, was.q, was.sp, was.sq, pytest.approx(was.aic))


def test_nulls_and_gaps_only_cost_their_rows(readings):
    y = list(seasonal(300, 7))
    y[150] = None
    df = readings(y)
    got = lagmodel.fit_new(df, zero_orders(df), SMALL).first()
    full = lagmodel.fit_new(readings(seasonal(300, 7)), zero_orders(df), SMALL).first()
    assert 0 < got.n < full.n


def test_plan_levels(spark, readings, tmp_path):
    path = str(tmp_path / "models")
    y = seasonal(300, 8)
    df = readings(y[:200])
    with pytest.raises(ValueError, match="checkpoint"):
        sarima.fit(df, SMALL, update_level=0)
    missing = sarima.fit(df, SMALL, update_level=0, checkpoint=str(tmp_path / "none"))
    new = sarima.fit(df, SMALL, save_to=path)
    assert missing.first().n == new.first().n
    updated = sarima.fit(readings(y), SMALL, update_level=0, checkpoint=path)
    assert updated.first().last_idx == new.first().last_idx + 100
    refitted = sarima.fit(readings(y), SMALL, update_level=1, checkpoint=path, save_to=path)
    assert refitted.first().last_idx == new.first().last_idx + 100


def kpss_whole(x, l):
    e = x - x.mean()
    s = np.cumsum(e)
    n = len(e)
    v = (e**2).sum() / n + 2 / n * sum((1 - j / (l + 1)) * (e[j:] * e[:-j]).sum() for j in range(1, l + 1))
    return (s**2).sum() / n**2 / v


@pytest.mark.parametrize("size", [17, 100, 5000])
def test_kpss_equals_whole_series(readings, size):
    rng = np.random.default_rng(9)
    x = rng.normal(size=500).cumsum()
    rows = lags.indexed(readings(x), 3600).withColumnRenamed("value", "x")
    got = lags.kpss(rows, 5, ["area", "series"], size).first()
    assert got.n == 500 and got.kpss == pytest.approx(kpss_whole(x, 5), rel=1e-9)


def test_differencing_order(readings):
    rng = np.random.default_rng(10)
    noise = rng.normal(size=400)
    df = readings({"flat": [3.0] * 400, "noise": noise, "walk": noise.cumsum(), "twice": noise.cumsum().cumsum()})
    got = {r.series: r.d for r in lags.differencing_order(df, lags=6, size=64).collect()}
    assert got == {"flat": 0, "noise": 0, "walk": 1, "twice": 2}


@pytest.mark.parametrize("size", [40, 4096])
def test_difference_and_lags(readings, values, size):
    y = np.arange(100) ** 2.0
    got = values(lags.difference(readings(y), 1, 1, 24, size=size))
    want = difference(y, 1, 1, 24)
    assert got[:25] == [None] * 25
    np.testing.assert_allclose(got[25:], want[25:])
    with_gap = readings([("2024-01-01 00:00:00", 1), ("2024-01-01 02:00:00", 4), ("2024-01-01 03:00:00", 9)])
    assert values(lags.persistence(with_gap, size=2), "predicted") == [None, None, 4]


def test_seasonal_order_equals_regression(readings):
    rng = np.random.default_rng(11)
    t = np.arange(480)
    y = np.tile(rng.normal(size=24), 20).cumsum() + rng.normal(size=480) * 0.1 + 0.01 * t
    for p in (0, 2):
        got = lagmodel.seasonal_order(readings(y), 24, critical=-1.8, lags=p, size=100).first()
        w = difference(y, 1, 1, 24)
        z4, z5 = lag_columns(difference(y, 0, 1, 24), [1]), lag_columns(difference(y, 1, 0, 24), [24])
        x = np.column_stack(([lag_columns(w, range(1, p + 1))] if p else []) + [z4, z5])
        beta, rss, n = regression(x, w)
        ok = np.isfinite(x).all(axis=1) & np.isfinite(w)
        se = np.sqrt(np.linalg.inv(x[ok].T @ x[ok])[-1, -1] * rss / (n - x.shape[1]))
        assert got.t_stat == pytest.approx(beta[-1] / se, rel=1e-6)
        assert got.sd == int(got.t_stat > -1.8)


def test_truncation_grows_with_the_series(readings):
    rng = np.random.default_rng(21)
    slow = np.zeros(2000)
    for i in range(1, 2000):
        slow[i] = 0.97 * slow[i - 1] + rng.normal()
    short = rng.normal(size=90)
    assert (lags.truncation(2000), lags.truncation(90)) == (25, 11)
    rows = lags.indexed(readings({"slow": slow, "short": short}), 3600).withColumnRenamed("value", "x")
    got = {r.series: r.kpss for r in lags.kpss(rows, None, ["area", "series"], 300).collect()}
    assert got["slow"] == pytest.approx(kpss_whole(slow, 25), rel=1e-9) and got["slow"] < kpss_whole(slow, 7)
    assert got["short"] == pytest.approx(kpss_whole(short, 11), rel=1e-9)


def test_too_few_values_are_refused(readings):
    df = readings(seasonal(20))
    with pytest.raises(Exception, match="a/x"):
        lagmodel.fit_new(df, zero_orders(df), SMALL).collect()


def test_forecast_refuses_gaps_and_missing_data(readings):
    data = [float(v) for v in seasonal(300)]
    df = readings(data)
    models = lagmodel.fit_new(df, zero_orders(df), SMALL).persist()
    at = lambda h: str(dt.datetime(2024, 1, 1) + dt.timedelta(hours=h))
    assert lagmodel.forecast(df, models, at(300), at(303), SMALL).count() == 4
    gap = readings(data[:290] + [None] + data[291:])
    with pytest.raises(Exception, match="a gap in the last"):
        lagmodel.forecast(gap, models, at(300), at(303), SMALL).collect()
    with pytest.raises(Exception, match="no data for the model of a/x"):
        lagmodel.forecast(df.where("series = 'other'"), models, at(300), at(303), SMALL).collect()


def test_stationarity_plan_is_the_same_for_any_length(readings):
    """No job runs for it, and the truncation is no part of it."""
    plans = []
    for n in (60, 3000):
        rows = lags.indexed(readings(np.arange(n) % 7.0), 3600).withColumnRenamed("value", "x")
        plans.append(lags.kpss(rows, None, ["area", "series"], 500)._jdf.queryExecution().optimizedPlan().toString())
    assert len(plans[0].splitlines()) == len(plans[1].splitlines()) < 60 and len(plans[1]) < 12_000


@pytest.mark.parametrize("size", [5, 64])
def test_kpss_with_gaps_and_more_lags_than_a_block(readings, size):
    """A missing step counts as zero; a block may be shorter than the halo."""
    rng = np.random.default_rng(31)
    x = rng.normal(size=200).cumsum()
    gone = rng.random(200) < 0.3
    e = np.where(gone, 0, x - x[~gone].mean())
    s = e.cumsum()[~gone]
    n = len(s)
    v = (e @ e + 2 * sum((1 - j / 10) * (e[j:] @ e[:-j]) for j in range(1, 10))) / n
    rows = lags.indexed(readings([None if g else v for g, v in zip(gone, x)]), 3600).withColumnRenamed("value", "x").where("x is not null")
    got = lags.kpss(rows, 9, ["area", "series"], size).first()
    assert got.n == n and got.kpss == pytest.approx(s @ s / n**2 / v, rel=1e-9)


def test_product_models_are_the_plan_s_default(readings, tmp_path):
    path = str(tmp_path / "models")
    y = seasonal(420, 8)
    search = Search(m=6, long_lags=14, block=64, product=True, max_p=1, max_q=1, max_sp=1, max_sq=1)
    new = sarima.fit(readings(y[:300]), search, save_to=path).first()
    assert list(new.ar_lags) == [1, 6, 7] and len(new.seasonal_ma_factor) == 1
    updated = sarima.fit(readings(y), search, update_level=0, checkpoint=path).first()
    refitted = sarima.fit(readings(y), search, update_level=1, checkpoint=path).first()
    assert updated.n == refitted.n and updated.sigma2 == pytest.approx(refitted.sigma2, rel=1e-7)
    assert list(updated.ma_coef) == pytest.approx(list(refitted.ma_coef), rel=1e-5)


def test_all_series_at_once_equal_the_recursion():
    """Different orders, differences and lags side by side, over a long horizon."""
    from types import SimpleNamespace

    rng = np.random.default_rng(41)
    models, y = [], rng.normal(size=(7, 60)).cumsum(1)
    for i in range(7):
        ar, ma = sorted(rng.choice(range(1, 15), i % 4, replace=False)), sorted(rng.choice(range(1, 15), (i + 1) % 3, replace=False))
        models.append(SimpleNamespace(
            d=i % 2, sd=i % 3 == 0, m=6, intercept=0.1 * i, ar_lags=ar, ar_coef=rng.uniform(-0.3, 0.3, len(ar)),
            ma_lags=ma, ma_coef=rng.uniform(-0.5, 0.5, len(ma)), long_coef=rng.uniform(-0.2, 0.2, 9)))
    got = lagmodel.predict_paths(models, y, 2_000)
    for model, own, path in zip(models, y, got):
        w = lagmodel.differenced(own, model.d, model.sd, model.m)
        e = [*lagmodel.long_residual(w, model.long_coef), *np.zeros(2_000)]
        w, all_ = list(w), list(own)
        for t in range(60, 2_060):
            w.append(model.intercept + sum(c * w[t - k] for k, c in zip(model.ar_lags, model.ar_coef))
                     + sum(c * e[t - k] for k, c in zip(model.ma_lags, model.ma_coef)))
            all_.append(w[t] - sum(c * all_[t - k] for k, c in lags.difference_weights(model.d, model.sd, 6).items() if k))
        np.testing.assert_allclose(path, all_[60:], rtol=1e-9, atol=1e-9)
