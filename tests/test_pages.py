import json

from pyspark.sql import functions as F

from marlstone.sources import pages


def test_a_pull_ends_where_the_service_says(spark):
    def full(page, size):
        return 200, json.dumps({"results": [{"id": f"{page}-{i}", "memory": "m"} for i in range(size)], "count": 0})

    def refusing(page, size):
        return (200, json.dumps({"results": [{"id": f"{page}", "memory": "m"}] * size})) if page < 3 else (503, "later")

    store = spark.createDataFrame([("1-0",)], "id string")
    one = pages.summary(pages.pull(spark, full, 2, 4), store).first()
    assert tuple(one) == (4, 8, 7, 0, None)  # a total of none named ends nothing
    assert tuple(pages.summary(pages.pull(spark, refusing, 2, 9), store).first()) == (2, 4, 2, 0, 503)
    torn = pages.summary(pages.pull(spark, lambda page, size: (200, "no json"), 2, 9), store).first()
    assert tuple(torn) == (1, 0, 0, 0, None)
    odd = pages.summary(pages.pull(spark, lambda page, size: (200, json.dumps({"results": 5})), 2, 9), store).first()
    assert tuple(odd) == (1, 0, 0, 0, None)


def test_filters_of_a_mirror(spark):
    rows = spark.createDataFrame([({"user_id": "u", "run_id": "r"},), ({"agent_id": "a"},), ({},), (None,)], "f map<string,string>")
    assert [r.w for r in rows.select(pages.pull_filters(F.col("f")).alias("w")).collect()] == [{"user_id": "u"}, {}, None, None]
