"""Every probe is graded, also those whose stand-in answer is wrong."""

from pyspark.sql import functions as F

from palimpsest import queries
from palimpsest.queries import live
from tests.conftest import SF


def test_all_probes_are_graded(spark):
    n = live.probes(spark, SF).count()
    kinds = {r.k: (r.n, r.verdicts) for r in live.graded(spark, SF).groupBy(((F.col("conv_id") + F.col("probe_id")) % 5).alias("k")).agg(F.count(F.lit(1)).alias("n"), F.collect_set("verdict").alias("verdicts")).collect()}
    assert set(kinds) == set(range(5)) and sum(c for c, _ in kinds.values()) == n
    assert "wrong" in kinds[4][1]
    assert queries.queries()["e5_survival_totals"](spark, SF).collect()[0].probes == n
