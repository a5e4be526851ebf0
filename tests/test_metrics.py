"""The nested analysis record over reports with nulls, ties and one report."""

from __future__ import annotations

from tidemark.operators import metrics as mt

SCHEMA = "event long, report long, source string, us long, lon double, lat double, kind string, score long, value double, radius_m string"
DAY = 86_400_000_000


def test_odd_events(spark):
    rows = [(1, 1, "a", 5, 0.0, 0.0, "error", 80, 10.0, "x"), (1, 2, "b", DAY + 5, None, None, None, None, None, "x"), (1, 2, "b", DAY + 5, None, None, None, None, None, "x"), (2, 3, None, 7, None, None, "view", None, None, None), (None, 4, "c", 7, 0.0, 0.0, "error", 1, 1.0, None), (3, 5, "c", None, 0.0, 0.0, "error", 1, 1.0, None)]
    got = {r.event: r for r in mt.analysis(spark.createDataFrame(rows, SCHEMA), 2 * DAY).collect()}
    assert set(got) == {1, 2}
    one, two = got[1], got[2]
    assert one.temporal.version == 2 and one.temporal.previous == 1 and one.delta.transition == "v1->v2" and one.delta.fresh == 2 and one.situation.sources == 2
    assert one.infrastructure.by_domain == {"road": 1, "transit": 0, "utility": 0, "facility": 2} and one.infrastructure.severest == "immediate"
    assert one.traffic.ratio is None and one.traffic.congestion == "not_analyzed"
    assert two.situation.radius_m is None and two.temporal.trend == "steady" and two.situation.event_class == "facility" and two.provenance.summary == "1 reports from 0 sources with low peak severity"
    assert mt.analysis(spark.createDataFrame([], SCHEMA), 0).count() == 0


def test_no_event_is_gathered(spark):
    plan = mt.analysis(spark.createDataFrame([], SCHEMA), 0)._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "collect" not in plan
