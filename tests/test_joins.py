from docketry.operators.joins import weighted_join


def test_heavy_and_light_keys(spark):
    rows = spark.createDataFrame([("h", i) for i in range(50)] + [("l", 1), ("m", 2), (None, 3), ("z", 4)], "k string, v int")
    keyed = spark.createDataFrame([("h", 50, "H"), ("l", 1, "L"), ("m", 1, "M"), ("n", 0, "N")], "k string, n int, name string")
    for heavy in (1, 10, 1000):
        got = sorted(map(tuple, weighted_join(rows, keyed, "k", "n", heavy).collect()))
        assert got == sorted([("h", i, "H") for i in range(50)] + [("l", 1, "L"), ("m", 2, "M")])
    assert weighted_join(rows.limit(0), keyed, "k", "n").count() == 0
