import math

from pyspark.sql import functions as F

from catalog.states import event_states
from ebbtide.operators import profile, states

ROWS = [("a", 1.0, "x"), ("a", 4.0, "y"), ("a", None, None), ("a", float("nan"), "x"), ("b", 1e9, "x"), ("b", 1e9 + 2, None), ("c", 7.0, "z"), (None, 5.0, "x")]


def rows_of(df):
    return {tuple(v for v in r[:-1]): r[-1] for r in df.collect()}


def test_merged_days_equal_one_scan(spark):
    df = spark.createDataFrame(ROWS, "day string, v double, k string").repartition(4)
    by_day = states.profile_state(df, F.col("day"), ["v"], ["k"])
    assert by_day.where("period IS NULL").count() == 2
    got = rows_of(states.profile_of_state(states.merge_states(by_day)))
    want = rows_of(profile.feature_profile(df.withColumn("v", F.nanvl("v", F.lit(None))), ["v"], ["k"]))
    assert got.keys() == want.keys() and all(math.isclose(got[k], want[k], rel_tol=1e-12) for k in want)


def test_merging_in_any_order_is_the_same(spark):
    df = spark.createDataFrame(ROWS, "day string, v double, k string")
    by_day = states.profile_state(df, F.col("day"), ["v"], ["k"]).cache()
    some = states.merge_states(by_day.where("period IN ('a', 'c')")).withColumn("period", F.lit("ac"))
    rest = by_day.where("period IS NULL OR period = 'b'")
    left = {(r.column, r.category): r for r in states.merge_states(some.unionByName(rest)).collect()}
    right = {(r.column, r.category): r for r in states.merge_states(by_day).collect()}
    assert left.keys() == right.keys()
    for k, r in right.items():
        assert (left[k].rows, left[k].low, left[k].high) == (r.rows, r.low, r.high)
        assert (left[k].mean is None) == (r.mean is None) and (r.mean is None or (math.isclose(left[k].mean, r.mean) and math.isclose(left[k].m2, r.m2, rel_tol=1e-9)))


def test_one_value_has_no_deviation_and_empty_tables_no_state(spark):
    df = spark.createDataFrame([("a", 3.0, None)], "day string, v double, k string")
    assert rows_of(states.profile_of_state(states.merge_states(states.profile_state(df, F.col("day"), ["v"], ["k"])))) == {("v", "mean"): 3.0, ("v", "std"): None}
    assert states.merge_states(states.profile_state(df.limit(0), F.col("day"), ["v"], ["k"])).count() == 0


def test_a_batch_written_again_replaces_itself(spark, tmp_path):
    df = spark.createDataFrame(ROWS, "day string, v double, k string")
    state = states.profile_state(df, F.col("day"), ["v"], ["k"])
    for batch in (1, 2, 1):
        states.store_states(state, str(tmp_path / "s"), batch)
    stored = states.read_states(spark, str(tmp_path / "s"))
    assert stored.count() == 2 * state.count()
    assert stored.where("category = 'x'").agg(F.sum("rows")).first()[0] == 2 * 4


def test_days_spread_over_micro_batches(spark, folder):
    """Files that mix days, a few per micro-batch: the merged days are those of one micro-batch."""
    spread, whole = event_states(spark, folder, 300, 1), event_states(spark, folder)
    assert spread.select("batch").distinct().count() > 2 and whole.select("batch").distinct().count() == 1
    count = {(r.period, r.column, r.category): r for r in states.merge_states(whole, ("period",)).collect()}
    for r in states.merge_states(spread, ("period",)).collect():
        w = count.pop((r.period, r.column, r.category))
        assert r.rows == w.rows and r.low == w.low and (w.mean is None or (math.isclose(r.mean, w.mean) and math.isclose(r.m2, w.m2, rel_tol=1e-9, abs_tol=1e-9)))
    assert not count
