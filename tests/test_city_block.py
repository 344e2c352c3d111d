"""City-block pairs whose distance rounds to the radius."""

from catchment.queries.joins import _city_block


def test_rounded_distance_across_two_cells(spark):
    """20 000.004 m rounds to 20 000.00 and crosses two borders of cells that are little wider than the radius."""
    d = spark.createDataFrame([("a", 1, 20000.0015, 5.0)], "aoi_id string, demand_id bigint, lon double, lat double")
    s = spark.createDataFrame([("a", 7, 40000.0055, 5.0), ("a", 8, 40000.0075, 5.0)], "aoi_id string, site_id bigint, lon double, lat double")
    assert [tuple(r) for r in _city_block(d, s, digits=2).collect()] == [("a", 1, 7, 20000.0)]
    assert _city_block(d, s).count() == 0
