"""Samples and draws: repeatable, in proportion, and with defined edges."""

from pyspark.sql import functions as F

from tamisol.operators import review, sampling


def test_sample_is_repeatable(spark):
    df = spark.range(1000)
    a, b = ({r.id for r in sampling.random_sample(x, 50, "id").collect()} for x in (df, df.repartition(7)))
    assert a == b and len(a) == 50 and sampling.random_sample(df.limit(3), 50, "id").count() == 3


def test_weighted_draw(spark):
    rows = spark.range(20_000).select(sampling.weighted_draw(sampling.uniform("id", 1), {"a": 1, "b": 3}).alias("v")).groupBy("v").count().collect()
    n = {r.v: r["count"] for r in rows}
    assert 0.22 < n["a"] / 20_000 < 0.28 and set(n) == {"a", "b"}


def test_customers_and_payments(spark):
    entries = spark.createDataFrame([(i, f"Family{i}, Given", "individual", "1960", "DE") for i in range(300)] + [(999, "x", "individual", None, None), (998, None, None, None, None)], "id long, full_name string, entity_type string, dob string, nationality string")
    made = sampling.synthetic_customers(entries, 200).collect()
    assert len(made) == 200 == len({r.customer_id for r in made}) and {r.variant_type for r in made} <= set(sampling.VARIANTS) and all(r.dob is None for r in made if r.variant_type == "C")
    paid = sampling.synthetic_transactions(spark.createDataFrame([("C1",), ("C2",)], "customer_id string"), 5)
    assert paid.count() == 10 and paid.filter("date between '2024-01-01' and '2024-12-31' and cast(amount as double) >= 1").count() == 10


def test_positions_equal_a_global_sort(spark):
    df = spark.range(500).select(F.concat(F.lit("A"), F.lpad(F.col("id").cast("string"), 3, "0")).alias("alert_id"), ((F.col("id") * 37 % 101) / 100).alias("score"))
    want = [r.alert_id for r in df.orderBy("score", "alert_id").collect()]
    got = review._picked(df, "score", "alert_id", 9, review.even_positions).orderBy("score", "alert_id").collect()
    assert [r.alert_id for r in got] == [want[p] for p in review.even_positions(500, 9)]
    assert review._picked(df.limit(0), "score", "alert_id", 9, review.even_positions).count() == 0
