import random

from pyspark.sql import functions as F

from pagetally.operators.ranks import ranked


def test_ranks_over_all_tasks(spark):
    rnd = random.Random(4)
    rows = [(rnd.choice(["a", "a", "a", "b", None]), rnd.randrange(40)) for _ in range(3000)]
    df = spark.createDataFrame(rows, "g string, v int").repartition(7)
    got = ranked(df, ["g"], [F.col("v").desc()]).collect()
    for g in ("a", "b", None):
        mine = sorted((r["rank"], r.v) for r in got if r.g == g)
        assert [k for k, _ in mine] == list(range(len(mine)))
        assert [v for _, v in mine] == sorted((v for x, v in rows if x == g), reverse=True)
        assert {r.total for r in got if r.g == g} == {len(mine)}


def test_ranks_without_groups_or_rows(spark):
    df = spark.createDataFrame([(5,), (None,), (3,)], "v int")
    assert {(r.v, r["rank"], r.total) for r in ranked(df, [], [F.col("v").asc_nulls_last()]).collect()} == {(3, 0, 3), (5, 1, 3), (None, 2, 3)}
    assert ranked(df.where("false"), [], [F.col("v").asc()]).collect() == []
