from termloom.operators import dictionary


def test_pairs_that_list_each_other_by_one_shuffle(spark):
    rows = [("x", "y"), ("y", "x"), ("y", "x"), ("x", "z"), ("x", "z"), ("z", "z"), (None, "x"), ("x", None), (None, None), ("가", "y"), ("y", "가")]
    found = dictionary.mutual(spark.createDataFrame(rows, "a string, b string"))
    assert sorted(map(tuple, found.collect())) == [("x", "y"), ("y", "가")]
    plan = found._jdf.queryExecution().executedPlan().toString().partition("== Initial Plan ==")[0]
    assert "Join" not in plan and plan.count("Exchange") == 1


def test_numbers_that_list_each_other(spark):
    found = dictionary.mutual(spark.createDataFrame([(10, 9), (9, 10), (2, 10), (-1, 3), (3, -1)], "a long, b long"))
    assert sorted(map(tuple, found.collect())) == [(-1, 3), (9, 10)]
