"""A round of EM deals times and counts; what it computes of them is not shuffled."""

from tidemark.operators import points as P


def test_a_round_deals_narrow_rows_once(spark):
    rows = spark.createDataFrame([(k, t, 1 + t % 2) for k in (1, 2) for t in range(0, 90, 3)], "k long, _t long, _m long")
    fit = spark.createDataFrame([(1, 0, 87, 45, 0.2, 0.5, 1.0, None), (2, 0, 87, 45, 0.3, 0.4, 0.5, None)], "k long, _lo long, _hi long, n long, base double, branching double, decay double, loglik double")
    plan = P._em(rows, fit, "k")._jdf.queryExecution().optimizedPlan()
    text = plan.toString()
    dealt = [i for i, line in enumerate(text.splitlines()) if "RepartitionByExpression" in line]
    assert dealt
    for i in dealt:
        assert text.splitlines()[i + 1].count("#") <= 10 and "_s#" not in text.splitlines()[i + 1]
