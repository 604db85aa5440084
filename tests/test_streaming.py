import os

import pytest

from wattframe.operators import align
from wattframe.streaming import downsample

HOURS = "2024-01-01 {:02d}:{:02d}:00".format


def land(df, folder, number):
    """One file, each a little younger than the one before."""
    df.coalesce(1).write.parquet(f"{folder}-made/{number}")
    made = next(f for f in os.listdir(f"{folder}-made/{number}") if f.endswith(".parquet"))
    os.makedirs(folder, exist_ok=True)
    os.link(f"{folder}-made/{number}/{made}", f"{folder}/{number}.parquet")
    os.utime(f"{folder}/{number}.parquet", (1_700_000_000 + number, 1_700_000_000 + number))


def run(spark, tmp_path, schema, lateness, per_batch=1):
    arriving = downsample.read_stream(spark, str(tmp_path / "in"), schema, per_batch)
    query = downsample.start(arriving, str(tmp_path / "out"), str(tmp_path / "state"), 3_600, lateness)
    assert query.awaitTermination(120)
    return downsample.downsampled(spark, str(tmp_path / "out"), 3_600)


def cells(df):
    return {(r.area, str(r.ts), r.series): None if r.value is None else round(r.value, 9) for r in df.collect()}


def test_stream_equals_batch(spark, readings, tmp_path):
    """Several files and areas, empty hours, null values; a second run goes on from the first one's state."""
    first = readings({"x": [1.0, None, 4.0], "y": [None, None, 2.5]}, step=1_200)
    second = readings([(HOURS(0, 50), 9), (HOURS(5, 10), 1), (HOURS(5, 20), 2)]).union(readings([(HOURS(7, 0), 3)], area="b"))
    third = readings([(HOURS(6, 30), 5), (HOURS(9, 30), None)])
    folder = str(tmp_path / "in")
    land(first, folder, 0)
    land(second, folder, 1)
    assert cells(run(spark, tmp_path, first.schema, "1 day")) == cells(align.downsample(first.union(second)))
    land(third, folder, 2)
    got = cells(run(spark, tmp_path, first.schema, "1 day"))
    assert got == cells(align.downsample(first.union(second).union(third)))
    assert got["a", HOURS(9, 0), "x"] is None and got["a", HOURS(0, 0), "x"] == pytest.approx(14 / 3)


def test_late_rows_on_both_sides_of_the_watermark(spark, readings, tmp_path):
    """After 10:00 and two hours of lateness the mark is at 08:00: the bin that ends at 09:00 is open, that at 08:00 is not."""
    on_time = [readings([(HOURS(1, 10), 1), (HOURS(7, 10), 10), (HOURS(8, 10), 20)]), readings([(HOURS(10, 0), 5)]), readings([(HOURS(9, 0), 6)])]
    late, too_late = readings([(HOURS(8, 20), 40)]), readings([(HOURS(7, 59), 30), (HOURS(1, 20), 3)])
    folder = str(tmp_path / "in")
    for number, df in enumerate([*on_time, late.union(too_late)]):
        land(df, folder, number)
    got = cells(run(spark, tmp_path, late.schema, "2 hours"))
    assert got == cells(align.downsample(on_time[0].union(on_time[1]).union(on_time[2]).union(late)))
    assert got["a", HOURS(8, 0), "x"] == 30 and got["a", HOURS(7, 0), "x"] == 10 and got["a", HOURS(1, 0), "x"] == 1


def test_rows_without_keys_and_a_replayed_batch(spark, readings, tmp_path):
    df = readings([(HOURS(0, 0), 1), (HOURS(2, 0), 3)])
    nameless = spark.createDataFrame([(None, None, "x", 1.0), ("a", None, "x", 1.0), (None, None, None, None)], df.schema)
    land(df.union(nameless), str(tmp_path / "in"), 0)
    want = cells(align.downsample(df))
    assert cells(run(spark, tmp_path, df.schema, "1 hour")) == want
    # the first batch once more, as after a failure before it was noted down
    for kind in ("commits", "offsets"):
        for file in os.listdir(tmp_path / "state" / kind):
            if kind == "commits" or file.strip(".").split(".")[0] != "0":
                os.unlink(tmp_path / "state" / kind / file)
    assert cells(run(spark, tmp_path, df.schema, "1 hour")) == want
    assert "0" in os.listdir(tmp_path / "state" / "commits")
