"""Values of scenarios, fault by fault."""

from catchment.operators import quality


def faults(spark, *cols, **given):
    names = ["scenario_id", "problem", "variant", *given]
    kinds = ", ".join(f"{n} {'bigint' if n == 'scenario_id' else 'string'}" for n in names)
    df = spark.createDataFrame([(1, *cols, *given.values())], kinds)
    return sorted((r.parameter, r.fault) for r in quality.scenario_value_faults(df).collect())


def test_every_fault_has_a_row(spark):
    assert faults(spark, "p-median", None, n_facilities="3") == []
    assert faults(spark, "p-center", "conditional") == [("n_facilities", "missing")]
    assert faults(spark, "p-center", "absolute", n_facilities="2") == [("variant", "unknown")]
    assert faults(spark, None, None) == faults(spark, "tsp", None) == [("problem", "unknown")]
    assert faults(spark, "lscp", "partial", service_radius="0", coverage_fraction="1.5") == [
        ("coverage_fraction", "must be more than 0, at most 1"), ("service_radius", "must be more than 0")]
    assert faults(spark, "lscp", "partial", service_radius="1", coverage_fraction="1") == []
    assert faults(spark, "lscp", "probabilistic", service_radius="x", coverage_reliability="1") == [
        ("coverage_reliability", "must be between 0 and 1"), ("service_radius", "not a number")]
    assert faults(spark, "mclp", None, service_radius="NaN", n_facilities="2.5") == [("n_facilities", "must be a whole number from 1"), ("service_radius", "not a number")]
    assert faults(spark, "mclp", "capacitated", service_radius="5") == [("n_facilities", "missing, and no budget")]
    assert faults(spark, "mclp", "capacitated", service_radius="5", budget="9") == []
    assert faults(spark, "mclp", "budget", service_radius="5", budget="Infinity") == [("budget", "not a number")]
    assert faults(spark, "lscp", "backup", service_radius="5", k_coverage="0") == [("k_coverage", "must be a whole number from 1")]
