from glintloom.operators.graph import connected_components


def test_components_of_a_chain_keep_a_small_size_estimate(spark):
    edges = spark.range(200).selectExpr("(id * 37) % 201 AS a", "((id + 1) * 37) % 201 AS b")
    found = connected_components(edges)
    size = found._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    assert len(str(size)) < 10, "the estimate multiplies with the rounds, until it fills the driver"
    assert {r.component for r in found.collect()} == {0} and found.count() == 201
