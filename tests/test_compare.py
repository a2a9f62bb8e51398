"""Statistics over result rows and their text form."""

import pytest

from voxmill.operators import compare
from voxmill.params import AVERAGED_METRICS


def test_text_rounds_the_binary_value_as_sql_does(spark):
    rows = [("ALL", "m", "f1050", 0.7400015, 0.7599955, 0.5, float("nan"), 2.5e-6), ("ALL", "m", "total_fp", 12.0, None, None, None, None)]
    stats = spark.createDataFrame(rows, '`group` string, method string, metric string, mean double, median double, min double, max double, std double')
    found = {r.metric: tuple(r)[3:] for r in compare.formatted(stats).collect()}
    assert found["f1050"] == ("0.740001", "0.759996", "0.500000", "nan", "0.000003" if "%.6f" % 2.5e-6 == "0.000003" else "0.000002")
    assert found["total_fp"] == ("12", "", "", "", "")


def test_means_do_not_depend_on_the_order_of_the_sum(spark):
    names = ["scan", "method", *AVERAGED_METRICS]
    rows = [("s", "m", *[v] * len(AVERAGED_METRICS)) for v in [0.1] * 10]
    wide = [("t", "m", *[v] * len(AVERAGED_METRICS)) for v in (1e30, 2e30)]
    table = spark.createDataFrame(rows + wide, names)
    found = {(r.group, r.metric): r.mean for r in compare.grouped_statistics(table, ("m",)).collect()}
    for metric in AVERAGED_METRICS:
        assert found["s", metric] == 0.1
        assert found["t", metric] == pytest.approx(1.5e30)
