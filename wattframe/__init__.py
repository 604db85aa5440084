"""Load and generation time series as Spark tables of many areas and many series.

Every operator is a plain function ``DataFrame -> DataFrame`` over the long
layout ``readings(area, ts, series, value)``.
"""
