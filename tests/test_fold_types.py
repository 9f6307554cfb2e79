from pyspark.sql import types as T

from tidestep.operators.step import DataStep
from tidestep.sources.readers import from_dicts


def chained(pdv):
    pdv["v1"] = pdv["v2"]
    pdv["v2"] = pdv["v3"]
    pdv["v3"] = pdv["v4"]
    pdv["v4"] = pdv["v5"]
    pdv["v5"] = pdv["v6"]
    pdv["v6"] = pdv["x"]


def test_types_reach_the_end_of_a_chain(spark):
    df = from_dicts(spark, [{"x": 1.5}] * 7)
    out = DataStep(df, chained, order_by=["_obs"], retain={f"v{k}": 0 for k in range(1, 7)}).ordered()
    assert out.schema["v1"].dataType == T.DoubleType()
    assert [r.v1 for r in out.collect()] == [0, 0, 0, 0, 0, 1.5, 1.5]
