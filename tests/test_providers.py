"""Providers by name, over files of two formats."""

import pytest

from catchment.sources.datasource import Provider, Registry

SPOT = {"place_id": "id", "name": "title", "lon": "x", "lat": "y"}


def test_two_formats_in_one_layout(spark, tmp_path):
    spark.sql("select * from values (1L, 'a', 1.0D, 2.0D), (2L, 'b', 50.0D, 2.0D), (3L, null, null, 2.0D) t(id, title, x, y)").write.parquet(f"{tmp_path}/p")
    (tmp_path / "c.csv").write_text("id,title,x,y,w\n7,z,1.5,2.5,9\n8,,bad,2,1\n")
    both = Registry(Provider("pq", "Parquet folder", ("points",), SPOT))
    csv = Provider("csv", "Text", ("points", "demand"), SPOT | {"weight": "w"}, "csv", {"header": "true"}, "id bigint, title string, x double, y double, w double")
    both.register(csv)
    paths = {"pq": f"{tmp_path}/p", "csv": f"{tmp_path}/c.csv"}
    rows = both.fetch_all(spark, paths, (0.0, 0.0, 10.0, 10.0)).orderBy("place_id").collect()
    assert [tuple(r) for r in rows] == [("pq", 1, "a", 1.0, 2.0, None), ("csv", 7, "z", 1.5, 2.5, 9.0)]
    assert both.fetch_all(spark, paths).count() == 5
    assert [r.name for r in both.available(spark).collect()] == ["csv", "pq"]
    assert [r.name for r in both.available(spark, "demand").collect()] == ["csv"]
    assert both.available(spark, "roads").count() == 0 and both.get("none") is None


def test_box_reaches_the_scan(spark, tmp_path):
    spark.sql("select 1L as id, 'a' as title, 1.0D as x, 2.0D as y, 'unread' as other").write.parquet(f"{tmp_path}/p")
    plan = Provider("pq", "", (), SPOT).fetch(spark, f"{tmp_path}/p", (0.0, 0.0, 10.0, 10.0))._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(x,0.0)" in plan and "unread" not in plan and "other" not in plan.split("ReadSchema")[1]


def test_bad_requests_say_why(spark):
    p = Provider("x", "", (), {"place_id": "id", "height": "h"})
    assert p.faults(None, (5.0, 0.0, 1.0, 1.0)) == ["path is required", "unknown column height", "column lon is required", "column lat is required", "box must be west, south, east, north"]
    with pytest.raises(ValueError, match="path is required"):
        p.fetch(spark, "")
    with pytest.raises(ValueError, match="unknown providers: y"):
        Registry(p).fetch_all(spark, {"y": "/nowhere"})
    with pytest.raises(ValueError):
        Registry().fetch_all(spark, {})
