"""The stored cluster index: recall against the exact search, and how much is read for it."""

import re

import pytest
from pyspark.sql import functions as F

from gleanery.operators import ann
from gleanery.operators import retrieval as R
from gleanery.plans.views import view
from gleanery.sources.tables import materialize


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    """2,000 vectors in 40 groups, with a language each, and a stored index of them."""
    base = spark.range(2000).select("id", (F.col("id") % 40).alias("g"))
    coordinate = lambda k: F.sin(F.col("g") * (k + 1) * 1.7) * 3 + F.rand(k) - 0.5
    rows = base.select("id", F.concat(F.lit("src"), F.col("id") % 7).alias("repo_id"), F.when(F.col("id") % 200 == 0, "Rare").when(F.col("id") % 20 == 1, "Some").when(F.col("id") % 2 == 0, "Half").otherwise("Rest").alias("language"), F.array(*map(coordinate, range(8))).cast("array<float>").alias("embedding"))
    vectors = materialize(rows.union(spark.createDataFrame([(9999, "src1", "Half", None)], "id long, repo_id string, language string, embedding array<float>")), "vectors")
    q = vectors.where("id % 50 = 3").select(F.col("id").alias("query_id"), F.col("embedding").alias("vector"))
    return vectors, q, ann.write_ivf(vectors, str(tmp_path_factory.mktemp("ivf")), n=10)


def pairs(df):
    return {(r.query_id, r.id) for r in df.collect()}


def test_few_lists_find_nine_tenths(stored):
    vectors, q, index = stored
    exact, got = pairs(R.nearest(vectors, q, 10)), pairs(ann.search_ivf(index, q, 10))
    assert index.table.count() == 2000 and len(exact & got) >= 0.9 * len(exact)
    assert index.probes < len(index.centers) / 3 and index.candidates < 2000 / 3
    plan = ann.search_ivf(index, q.limit(1), 10)._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*list", plan)  # other lists aren't read


@pytest.mark.parametrize("language", ["Half", "Some", "Rare"])
def test_filters_of_any_share_keep_the_recall(stored, language):
    """Half, a twentieth and two hundredths of a tenth of the rows pass: each query reads until its lists have enough of them."""
    vectors, q, index = stored
    keep = F.col("language") == language
    exact, got = pairs(R.nearest(vectors.where(keep), q, 10)), pairs(ann.search_ivf(index, q, 10, keep))
    assert len(exact & got) >= 0.9 * len(exact)
    assert len(got) == len(exact)


def test_vectors_without_clusters_and_small_tables(spark, tmp_path):
    noise = materialize(spark.range(300).select("id", F.array(*(F.randn(k) for k in range(16))).cast("array<float>").alias("embedding")), "noise")
    q = noise.where("id < 20").select(F.col("id").alias("query_id"), F.col("embedding").alias("vector"))
    index = ann.write_ivf(noise, f"{tmp_path}/a", n=10, questions=300)
    exact = pairs(R.nearest(noise, q, 10))
    assert len(exact & pairs(ann.search_ivf(index, q, 10))) >= 0.85 * len(exact)
    again = ann.read_ivf(spark, f"{tmp_path}/a")
    assert (again.probes, again.candidates, again.centers.shape) == (index.probes, index.candidates, index.centers.shape)
    none = ann.search_ivf(index, q, 10, F.col("id") < 0)
    assert none.count() == 0
