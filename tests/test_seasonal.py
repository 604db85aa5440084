import numpy as np
import pytest
from pyspark.sql import functions as F

from test_lagmodel import lag_columns, regression, zero_orders
from wattframe.operators import lagmodel, seasonal
from wattframe.operators.lagmodel import Search
from wattframe.operators.seasonal import Orders

ONE = Search(m=6, long_lags=14, block=64, max_p=1, max_q=1, max_sp=1, max_sq=1, product=True)


def product_series(n=600, seed=0, m=6, burn=200):
    """(1 - 0.6 B)(1 - 0.5 B^6) w = 1 + (1 + 0.4 B)(1 + 0.4 B^6) e."""
    rng = np.random.default_rng(seed)
    e = rng.normal(size=n + burn)
    w = np.zeros(n + burn)
    for t in range(m + 1, n + burn):
        w[t] = 1 + 0.6 * w[t - 1] + 0.5 * w[t - m] - 0.3 * w[t - m - 1] + e[t] + 0.4 * e[t - 1] + 0.4 * e[t - m] + 0.16 * e[t - m - 1]
    return w[burn:]


def design(y, search):
    """The regression's rows over the whole series, the shocks from the long autoregression on the same rows."""
    reach, long = seasonal.reach(search), search.long_order()
    lags = lag_columns(y, range(1, reach + 1))
    ok = np.isfinite(lags).all(axis=1)
    coef, _, _ = regression(np.column_stack([np.ones(ok.sum()), lags[ok][:, :long]]), y[ok])
    e = y - np.column_stack([np.ones(len(y)), lags[:, :long]]) @ coef
    x = np.column_stack([np.ones(len(y)), lag_columns(y, search.ar_lags()), lag_columns(e, search.ma_lags())])
    return x[ok], y[ok]


def test_expansion_is_the_product_of_the_polynomials():
    orders, factors = Orders(2, 1, 1, 2, 6), np.array([3.0, 0.5, -0.2, 0.4, 0.3, 0.1, -0.6])
    search = Search(m=6, max_p=2, max_q=1, max_sp=1, max_sq=2, product=True)
    coef, by = seasonal.expand(factors, orders, search.ar_lags(), search.ma_lags())
    ar = -np.polymul([0.2, -0.5, 1], [-0.4, 0, 0, 0, 0, 0, 1])[::-1]
    ma = np.polymul([0.3, 1], [-0.6, 0, 0, 0, 0, 0, 0.1, 0, 0, 0, 0, 0, 1])[::-1]
    np.testing.assert_allclose(coef, [3.0, *(ar[k] for k in search.ar_lags()), *(ma[k] for k in search.ma_lags())])
    for k in range(len(factors)):
        moved = factors.copy()
        moved[k] += 1e-6
        np.testing.assert_allclose((seasonal.expand(moved, orders, search.ar_lags(), search.ma_lags())[0] - coef) / 1e-6, by[:, k], atol=1e-5)


@pytest.mark.parametrize("block", [64, 5000])
def test_fit_is_the_least_of_the_whole_series(readings, block):
    y = product_series()
    search = Search(**{**ONE.__dict__, "block": block})
    got = seasonal.fit_new(readings(y), zero_orders(readings(y)), search).first()
    x, target = design(y, search)
    factors = np.array([got.intercept, *got.ar_factor, *got.seasonal_ar_factor, *got.ma_factor, *got.seasonal_ma_factor])
    rss = lambda f: float(((target - x @ seasonal.expand(f, Orders(1, 1, 1, 1, 6), search.ar_lags(), search.ma_lags())[0]) ** 2).sum())
    assert got.n == len(target) and got.sigma2 * got.n == pytest.approx(rss(factors), rel=1e-8)
    for k in range(5):  # no direction lowers the sum of squares
        for step in (1e-3, -1e-3):
            moved = factors.copy()
            moved[k] += step
            assert rss(moved) > rss(factors)
    np.testing.assert_allclose(factors, [1, 0.6, 0.5, 0.4, 0.4], atol=0.25)
    assert got.ar_lags == [1, 6, 7] and got.ar_coef[2] == pytest.approx(-got.ar_coef[0] * got.ar_coef[1])
    assert got.ma_coef[2] == pytest.approx(got.ma_coef[0] * got.ma_coef[1])


def test_beats_the_additive_fit(readings):
    y = product_series(2000, 1)
    df = readings(y)
    product = seasonal.fit_new(df, zero_orders(df), ONE).first()
    added = lagmodel.fit_new(df, zero_orders(df), Search(**{**ONE.__dict__, "product": False})).first()
    assert product.sigma2 < added.sigma2 and product.sigma2 == pytest.approx(1, abs=0.1)
    assert len(product.ar_factor) + len(product.ma_factor) == 2  # as many free numbers as the additive model


def test_search_over_orders(readings):
    y = product_series(900, 2)
    search = Search(m=6, long_lags=14, block=100, product=True)
    got = seasonal.fit_new(readings(y), zero_orders(readings(y)), search).first()
    x, target = design(y, search)
    gram = np.column_stack([x, target]).T @ np.column_stack([x, target])
    best = min(
        (len(target) * np.log(rss / len(target)) + 2 * (len(f) + 1), (p, q, sp, sq))
        for p, q, sp, sq in search.candidates()
        for o in [Orders(p, q, sp, sq, 6)]
        for f, rss in [seasonal.gauss_newton(gram, seasonal._start(gram, o, search.ar_lags(), search.ma_lags()), o, search.ar_lags(), search.ma_lags())])
    assert (got.p, got.q, got.sp, got.sq) == best[1] and got.aic == pytest.approx(best[0], rel=1e-7)


@pytest.mark.parametrize("d,sd", [(0, 0), (1, 1)])
def test_update_equals_refit_on_all_rows(readings, d, sd):
    """Also with shocks: the first stage is renewed from the stored sums."""
    y = product_series(500, 3)
    old, both = readings({"x": y[:350], "y": y[::-1][:350]}), readings({"x": y, "y": y[::-1]})
    first = seasonal.fit_new(old, zero_orders(old, d, sd), ONE)
    added = {r.series: r for r in seasonal.update(both, first, ONE).collect()}
    again = {r.series: r for r in seasonal.refit(both, first, ONE).collect()}
    for series in "xy":
        a, b = added[series], again[series]
        assert (a.n, a.last_idx, a.p, a.q) == (b.n, b.last_idx, b.p, b.q)
        np.testing.assert_allclose([a.intercept, *a.ar_coef, *a.ma_coef, a.sigma2], [b.intercept, *b.ar_coef, *b.ma_coef, b.sigma2], rtol=1e-6)
        np.testing.assert_allclose(a.long_coef, b.long_coef, rtol=1e-6, atol=1e-9)
    idle = seasonal.update(old, first, ONE).where("series = 'x'").first()
    assert idle.aic == pytest.approx(first.where("series = 'x'").first().aic)


def test_forecast_and_fitted_values_take_the_expanded_lags(readings):
    y = product_series(400, 4)
    df = readings(y)
    model = seasonal.fit_new(df, zero_orders(df), ONE)
    fitted = [r for r in lagmodel.fitted_values(df, model, ONE).orderBy("ts").collect() if r.predicted is not None]
    errors = np.array([r.value - r.predicted for r in fitted])[seasonal.reach(ONE):]
    assert (errors**2).mean() == pytest.approx(model.first().sigma2, rel=0.1)
    assert lagmodel.forecast(df, model, "2024-01-17 16:00", "2024-01-18 15:00", ONE).count() == 24


def test_refusals(readings):
    df = readings(product_series(300, 5))
    with pytest.raises(ValueError, match="product=True"):
        seasonal.fit_new(df, zero_orders(df), Search(m=6))
    with pytest.raises(Exception, match="too few values for a model of a/x"):
        seasonal.fit_new(readings(product_series(24)), zero_orders(df), ONE).collect()
    additive = lagmodel.fit_new(df, zero_orders(df), Search(m=6, long_lags=14, block=64))
    with pytest.raises(Exception, match="another search"):
        seasonal.update(df, additive, ONE).collect()


def test_a_gap_only_costs_the_rows_that_reach_it(readings):
    y = list(product_series(400, 6))
    full = seasonal.fit_new(readings(y), zero_orders(readings(y)), ONE).first()
    y[200] = None
    got = seasonal.fit_new(readings(y), zero_orders(readings(y)), ONE).first()
    assert got.n == full.n - seasonal.reach(ONE) - 1
