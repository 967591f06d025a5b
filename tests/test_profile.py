import numpy as np
import pytest
from pyspark.sql import functions as F

from ebbtide.functions import scalars
from ebbtide.operators import profile, split
from ebbtide.operators import running
from ebbtide.operators.running import range_bounds, running_totals
from ebbtide.operators.statistics import quantiles


@pytest.fixture(scope="module")
def numbers(spark):
    """A third of all rows share one value; the rest are spread out."""
    values = np.random.default_rng(1)
    x = np.concatenate([np.full(400, 0.5), values.random(800)])
    return spark.createDataFrame([(i, float(v), "a" if i % 3 else "b") for i, v in enumerate(x)], "id long, x double, g string").cache()


@pytest.mark.parametrize("limit", [10_000, 50])
def test_quantiles_are_exact_both_ways(numbers, limit):
    probs = [0.0, 0.1, 0.25, 0.5, 0.9, 1.0]
    rows = quantiles(numbers, ["x"], probs, ("g",), distinct_limit=limit).collect()
    data = numbers.toPandas()
    assert len(rows) == 12
    for r in rows:
        assert r["value"] == pytest.approx(np.quantile(data[data.g == r["g"]].x, r["prob"]), abs=1e-12)
    whole = quantiles(numbers, ["x"], probs, distinct_limit=limit).collect()
    assert sorted(r["value"] for r in whole) == pytest.approx(sorted(np.quantile(data.x, probs)), abs=1e-12)


def test_quantiles_by_counting_cuts(spark, monkeypatch):
    """Several passes: few cuts a pass, values of all sizes, groups that are NULL, columns without values."""
    from ebbtide.operators import statistics

    monkeypatch.setattr(statistics, "CUTS", 64)
    rng = np.random.default_rng(3)
    x = np.concatenate([10.0 ** rng.integers(-300, 300, 200), -rng.random(200), np.zeros(150), [np.inf, -np.inf, 1.7e308, -1.7e308, np.nan]])
    rows = [(float(v), float(i % 7), None if i % 4 == 0 else "ab"[i % 2], None) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "x double, y double, g string, nothing double")
    probs = [0.0, 0.01, 0.3, 0.5, 0.77, 1.0]
    for by in ((), ("g",)):
        few, many = ({(*[r[b] for b in by], r["column"], r["prob"]): r["value"] for r in quantiles(df, ["x", "y", "nothing"], probs, by, limit).collect()} for limit in (10_000, 20))
        assert few.keys() == many.keys() and len(few) == 12 * (3 if by else 1)
        for key, value in few.items():
            assert value == many[key] or value == pytest.approx(many[key], rel=1e-12), key
    whole = {(r["column"], r["prob"]): r["value"] for r in quantiles(df, ["x", "y"], probs, (), 20).collect()}
    assert whole["x", 0.0] == -np.inf and whole["x", 1.0] == np.inf and whole["x", 0.5] == np.quantile(x[~np.isnan(x)], 0.5)


@pytest.mark.parametrize("descending", [False, True])
def test_running_totals_agree_with_and_without_ranges(numbers, descending):
    counts = numbers.groupBy("x").agg(F.count("*").alias("n"))
    bounds = range_bounds(counts, "x", 60)
    assert len(bounds) > 5
    ranged = running_totals(counts, "x", {"t": "n"}, descending=descending, bounds=bounds)
    plain = running_totals(counts, "x", {"t": "n"}, descending=descending)
    assert sorted(map(tuple, ranged.select("x", "t").collect())) == sorted(map(tuple, plain.select("x", "t").collect()))


@pytest.mark.parametrize("descending", [False, True])
def test_sums_of_ranges_by_blocks(spark, numbers, descending, monkeypatch):
    counts = numbers.select("x", F.when(F.col("x") > 50, "a").alias("g")).groupBy("g", "x").agg(F.count("*").alias("n"))
    bounds = range_bounds(counts, "x", 40)
    plain = running_totals(counts, "x", {"t": "n"}, ("g",), descending)
    monkeypatch.setattr(running, "RANGES_PER_BLOCK", 3)
    assert len(bounds) > 6
    blocks = running_totals(counts, "x", {"t": "n"}, ("g",), descending, bounds)
    assert blocks.columns == plain.columns
    assert sorted(blocks.collect(), key=str) == sorted(plain.collect(), key=str)


def test_cut_points_follow_distinct_values(spark):
    """A value on a third of the rows moves no cut; every split of the table cuts alike, and no sketch is merged."""
    values = spark.range(20_000).select((F.col("id") / 7).alias("x"))
    hot = values.unionByName(spark.range(10_000).select(F.lit(3.0).alias("x")))
    bounds = range_bounds(values, "x", 1_000)
    assert bounds == range_bounds(hot.repartition(13), "x", 1_000) and 14 <= len(bounds) <= 25
    sizes = [r["count"] for r in values.withColumn("r", F.size(F.filter(F.array(*map(F.lit, bounds)), lambda b: b <= F.col("x")))).groupBy("r").count().collect()]
    assert len(sizes) == len(bounds) + 1 and max(sizes) < 2_500
    assert range_bounds(values, "x", 1_000_000) == [] and range_bounds(values.limit(0), "x", 10) == []


def test_describe_agrees_with_pandas(numbers):
    row = profile.describe(numbers, ["x"]).first()
    want = numbers.toPandas().x.describe()
    assert [row[c] for c in ("count", "mean", "std", "min", "p25", "p50", "p75", "max")] == pytest.approx(list(want), abs=1e-12)


def test_describe_ranks_large_columns(numbers, monkeypatch):
    small = profile.describe(numbers, ["x", "id"], ("g",)).orderBy("g", "column").collect()
    monkeypatch.setattr(profile, "quantiles", lambda df, c, p, by: quantiles(df, c, p, by, distinct_limit=50))
    ranked = profile.describe(numbers, ["x", "id"], ("g",)).orderBy("g", "column").collect()
    for a, b in zip(small, ranked):
        assert tuple(a)[2:] == pytest.approx(tuple(b)[2:])


def test_histogram_agrees_with_numpy(numbers):
    rows = {r["bin"]: r["rows"] for r in profile.histogram(numbers, ["x"], 50).collect()}
    counts, _ = np.histogram(numbers.toPandas().x, bins=50)
    assert [rows.get(i, 0) for i in range(50)] == list(counts)


def test_histogram_of_a_constant(spark):
    df = spark.createDataFrame([(3.0,), (3.0,)], "x double")
    assert profile.histogram(df, ["x"], 10).first()["bin"] == 5


def test_grid_rank_counts_points_at_or_below(spark):
    points = scalars.grid(0.01, 0.9, 90)
    values = [*points, *[np.nextafter(p, 0) for p in points], *[np.nextafter(p, 1) for p in points], 0.0, 1.0]
    df = spark.createDataFrame([(float(v),) for v in values], "x double")
    for r in df.select("x", scalars.grid_rank(F.col("x"), points).alias("k")).collect():
        assert r["k"] == sum(p <= r["x"] for p in points)


def test_grid_is_the_even_grid():
    assert scalars.grid(0.01, 0.9, 90) == pytest.approx(list(np.linspace(0.01, 0.9, 90)), abs=1e-15)


def test_value_counts_and_rates(customers):
    assert [(r["value"], r["rows"], r["percent"]) for r in profile.value_counts(customers, "InternetService").collect()] == [
        ("Fiber", 2, 50.0), ("DSL", 1, 25.0), ("No Service", 1, 25.0)]
    assert [(r["value"], r["rate"]) for r in profile.rate_by(customers, "ContractType").collect()] == [
        ("Month-to-Month", 100.0), ("One Year", 0.0), ("Two Year", 0.0)]


def test_correlations_leave_nulls_out_per_pair(spark):
    df = spark.createDataFrame([(1.0, 2.0, 1.0), (2.0, None, 3.0), (3.0, 5.0, 2.0), (4.0, 9.0, None)], "a double, b double, c double")
    got = {(r["a"], r["b"]): r["correlation"] for r in profile.correlation_matrix(df, ["a", "b", "c"]).collect()}
    want = df.toPandas().corr()
    assert len(got) == 9
    for (a, b), v in got.items():
        assert v == pytest.approx(want.loc[a, b])


def test_outliers_use_both_bounds(spark):
    df = spark.createDataFrame([(float(v),) for v in [*range(10, 20), -50, 100]], "x double")
    assert sorted(r["x"] for r in profile.outliers(df, "x").collect()) == [-50.0, 100.0]
    assert profile.outlier_counts(df, ["x"]).first()["outliers"] == 2


def test_drift_counts_a_vanished_category_as_zero(spark):
    old, new = (spark.createDataFrame([(1.0, c) for c in cs], "x double, c string") for cs in (["a", "b"], ["a", "a"]))
    drift = profile.profile_drift(profile.feature_profile(old, ["x"], ["c"]), profile.feature_profile(new, ["x"], ["c"]))
    assert {r["statistic"]: r["change"] for r in drift.collect() if r["column"] == "c"} == {"share:a": 0.5, "share:b": -0.5}


def test_split_is_a_partition_with_exact_shares(spark):
    df = spark.range(1003).select(F.col("id").cast("string").alias("k"), F.when(F.col("id") % 3 == 0, "Yes").otherwise("No").alias("y"))
    marked = split.stratified_split(df, "k", "y")
    counts = {(r["y"], r["split"]): r["count"] for r in marked.groupBy("y", "split").count().collect()}
    assert sum(n for (_, s), n in counts.items() if s == "test") == 201
    for y, n in (("Yes", 335), ("No", 668)):
        assert counts[(y, "test")] + counts[(y, "train")] == n
        assert abs(counts[(y, "test")] - 0.2 * n) < 1
    train, test = split.train_test(marked)
    assert train.join(test, "k", "left_semi").count() == 0
    assert marked.exceptAll(split.stratified_split(df.repartition(5), "k", "y")).count() == 0


def test_cutoffs_end_the_quotas(spark):
    df = spark.range(2000).select("id", (F.col("id") % 3 == 0).alias("y"))
    quotas = lambda sizes: sizes.select("_class", F.when(F.col("_class"), 100).otherwise(333).alias("_quota"))
    found = {r["_class"]: (r["_last_hash"], r["_last_id"]) for r in split.hash_cutoffs(df, "id", F.col("y"), quotas, 1).collect()}
    for y, quota in ((True, 100), (False, 333)):
        hashes = [(split_hash(1, r["id"]), str(r["id"])) for r in df.filter(F.col("y") == y).collect()]
        assert found[y] == sorted(hashes)[quota - 1]


def split_hash(seed, key):
    import hashlib
    return hashlib.md5(f"{seed}:{key}".encode()).hexdigest()


def test_split_of_many_classes_and_missing_values(spark):
    df = spark.range(3000).withColumn("y", F.when(F.col("id") % 7 > 0, F.col("id") % 600))
    df = df.unionByName(spark.range(9).select(F.lit(None).cast("long").alias("id"), F.col("id").alias("y")))
    marked = split.stratified_split(df, "id", "y")
    assert marked.filter("split = 'test'").count() == 602
    shares = marked.groupBy("y").agg(F.count("*").alias("n"), F.count_if(F.col("split") == "test").alias("t"))
    assert shares.filter(F.abs(F.col("t") - 0.2 * F.col("n")) >= 1).count() == 0
    assert split.stratified_split(df.limit(0), "id", "y").count() == 0


def test_samples_are_the_smallest_hashes(spark):
    df = spark.range(500)
    want = {i for _, i in sorted((split_hash(42, i), i) for i in range(500))[:40]}
    assert {r["id"] for r in split.sample_rows(df, 40, "id").collect()} == want
    assert split.sample_rows(df, 900, "id").count() == 500 and split.sample_rows(df, None, "id").count() == 500
    assert split.sample_rows(df, 0, "id").count() == 0


def test_text_helpers(spark):
    row = spark.range(1).select(
        scalars.padded_id(F.lit(42)).alias("a"), scalars.padded_id(F.lit(12345678)).alias("b"),
        scalars.ellipsis(F.lit("x" * 51)).alias("c"), scalars.ellipsis(F.lit("x" * 50)).alias("d"),
        scalars.file_stem(F.lit("s3://bucket/a.b/file.csv")).alias("e"), scalars.file_stem(F.lit("plain")).alias("f")).first()
    assert tuple(row) == ("CUST000042", "CUST12345678", "x" * 50 + "...", "x" * 50, "file", "plain")


def test_grouped_histograms_are_the_same_salted(spark, monkeypatch):
    df = spark.range(4000).select((F.col("id") % 97).cast("double").alias("x"), F.when(F.col("id") % 3 > 0, F.col("id") % 2).alias("g"))
    plain = sorted(map(str, profile.histogram(df, ["x"], 7, by=("g",)).collect()))
    monkeypatch.setattr(profile, "RANGE_ROWS", 0)
    assert sorted(map(str, profile.histogram(df, ["x"], 7, by=("g",)).collect())) == plain and len(plain) == 21


def test_correlations_of_columns_with_gaps(spark):
    """Pairwise complete rows, a constant column, one that is constant where another has values, large offsets."""
    rng = np.random.default_rng(8)
    x = rng.normal(size=(300, 4))
    rows = [(float(a), float(a + b), None if i % 3 else float(c), 1e9 + float(b), 7.0, 5.0 if not i % 3 else float(i), float("nan") if i % 5 == 0 else float(c), None)
            for i, (a, b, c, _) in enumerate(x)]
    names = ["a", "b", "gaps", "far", "same", "same_there", "nans", "none"]
    df = spark.createDataFrame(rows, ", ".join(f"{n} double" for n in names)).repartition(5)
    data = df.toPandas().astype(float)
    got = {(r["a"], r["b"]): r["correlation"] for r in profile.correlation_matrix(df, names).collect()}
    assert len(got) == 64
    for (a, b), value in got.items():
        x, y = data[a].to_numpy(), data[b].to_numpy()
        both = ~np.isnan(x) & ~np.isnan(y)
        x, y = x[both], y[both]
        if len(x) < 2 or np.ptp(x) == 0 or np.ptp(y) == 0:
            assert value is None, (a, b)
        else:
            assert value == pytest.approx(np.corrcoef(x, y)[0, 1], abs=1e-9), (a, b)


def test_stages_by_sequence(spark):
    from ebbtide.operators import runs

    log = spark.createDataFrame([("m", 1, "Staging", False, 1, 2), ("m", 1, "Production", True, 1, 1), ("m", 2, "Production", True, 1, 3), ("m", 3, "Production", True, 1, 0)],
                                "name string, version bigint, stage string, archive_existing boolean, at int, sequence bigint")
    assert {r["version"]: r["stage"] for r in runs.current_stages(log).collect()} == {1: "Staging", 2: "Production", 3: "Archived"}
