"""Steps whose work must be dealt out, or done once, however large the tables are."""

import numpy as np
from pyspark.sql import functions as F

from vouch import queries
from vouch.operators import vectors

SF = "/root/testdata/sf0.001"


def test_lists_of_an_identity_are_written_out_once(spark):
    """Below the join with the keys, not above it for each of them."""
    plan = queries.QUERIES["j9_key_embeddings"](spark, SF)._jdf.queryExecution().optimizedPlan().toString().splitlines()
    last_join = next(n for n, line in enumerate(plan) if "Join " in line)
    assert not any("array_join" in line for line in plan[:last_join]) and any("array_join" in line for line in plan[last_join:])


def test_a_cell_is_compared_some_queries_at_a_time(spark, monkeypatch):
    """The same rows however many distances are in memory at once."""
    rng = np.random.default_rng(4)
    rows = [(i, v.tolist(), int(i % 3)) for i, v in enumerate(rng.standard_normal((120, 8)))]
    store = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    asked = store.filter("vec_id % 4 = 0").withColumnRenamed("vec_id", "query_id")
    calls = [lambda: vectors.search_exact(asked, store, k=5), lambda: vectors.match_counters(asked, store, 0.3, 0.2), lambda: vectors.distance_counts(asked, store)]
    whole = [sorted(map(tuple, f().collect())) for f in calls]
    monkeypatch.setattr(vectors, "DISTANCES", 300)
    assert [sorted(map(tuple, f().collect())) for f in calls] == whole
    sizes = vectors.compare(asked, store, lambda d, q, v: q[["query_id"]].assign(n=d.size), "query_id long, n long").agg(F.max("n")).first()[0]
    assert sizes <= 300
    x = np.array([r[1] for r in rows])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    d = np.round(1 - x[::4] @ x.T, 6)
    assert sum(r[2] for r in whole[2]) == d.size and {r[0] for r in whole[2]} == {float(v) + 0.0 for v in np.unique(np.maximum(d, 0))}


def test_pairs_are_made_in_as_many_partitions_as_cells(spark, monkeypatch):
    monkeypatch.setattr(vectors, "PAIR_QUERIES", 5)
    monkeypatch.setattr(vectors, "STORE_BLOCK", 50)
    store = spark.range(400).select(F.col("id").alias("vec_id"), (F.col("id") % 3).alias("label"))
    made = vectors.make_pairs(store.filter("vec_id % 20 = 0").withColumnRenamed("vec_id", "query_id"), store)
    assert made.count() == 20 * 400 - 20 - 20 * 19 // 2
    assert made.select(F.spark_partition_id().alias("p")).distinct().count() > 8


def test_parts_are_detected_in_one_look(spark):
    """A text is lowered once, and searched once for each word and each country's names, whatever is told from that."""
    plan = queries.QUERIES["f21_detect_parts"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("lower(") == 1 and plan.count("RLIKE") <= 3, plan


def test_tokens_of_a_text_are_taken_once(spark):
    """Below the join with the names, not once for each use in the score."""
    plan = queries.QUERIES["f12_text_name_score"](spark, SF)._jdf.queryExecution().optimizedPlan().toString().splitlines()
    join = next(n for n, line in enumerate(plan) if "Join " in line)
    assert not any("translate(" in line for line in plan[:join]) and sum(line.count("translate(") for line in plan[join:]) == 2
