"""The runs train, evaluate and score on all features, those against the agency among them."""

from pyspark.sql import functions as F

from procspark.plans import run_queries
from procspark.sources.tables import spend

SF = "/root/testdata/sf0.001"


def test_agency_features_vary_in_training_labelled_and_scored_rows(spark):
    rows = run_queries._with_labelled(spark, SF, seed=555)
    todo = run_queries._unscored(spark, SF, spend(spark, SF, agency=True, category=True))
    for part in (rows.filter("label is null"), rows.filter("label is not null"), todo):
        for name in ("amount_vs_category_avg", "invoice_freq_vs_category"):
            assert part.agg(F.count_distinct(name)).first()[0] > 10, name


def test_made_rows_take_the_most_frequent_agency(spark):
    real = spark.createDataFrame([(1, "b"), (1, "b"), (1, "a"), (2, "d"), (2, "c"), (3, None)], "vendor_id int, agency string")
    made = spark.createDataFrame([(1,), (2,), (3,)], "vendor_id int")
    assert dict(run_queries._with_agency(made, real).collect()) == {1: "b", 2: "c", 3: None}
