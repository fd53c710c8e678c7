"""Star rounds are planned in small parts, however they are joined."""

from phenospark.llm import common, components


def test_components_plan_few_shuffles_at_a_time(spark, monkeypatch):
    plans = []

    def written(df, name):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return common.written(df, name)

    monkeypatch.setattr(components, "written", written)
    edges = [(i, i + 1) for i in range(8)] + [(1000, 1001 + i) for i in range(600)]  # a path and a hub
    got = {r.node: r.root for r in components.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {i: 0 for i in range(1, 9)} | {1000 + i: 1000 for i in range(1, 601)}
    assert len(plans) > 4 and max(p.count("Exchange ") for p in plans) <= 6  # a whole round in one plan: dozens
