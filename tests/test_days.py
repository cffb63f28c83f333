import __spark_entry__ as entry


def test_days_registered(spark):
    df = entry.queries()["p1_ad_days"](spark, "/root/testdata/sf0.001")
    assert {"entity", "day", "total", "total_7", "total_30", "avg_7", "avg_30"} <= set(df.columns) and df.count() > 0
    assert {"p1_giver_days", "p1_ad_days"} <= set(entry.oracle_sql())
