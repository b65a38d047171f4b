"""Queries against their SQL over small tables with the cases that only large ones have."""

import math

import duckdb

from vouch import queries


def both(spark, folder, name, **tables):
    """Rows of a query and of its SQL over these tables, columns by name, numbers with their signs."""
    con = duckdb.connect()
    for table, frame in tables.items():
        frame.coalesce(1).write.mode("overwrite").parquet(f"{folder}/{table}.parquet")
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet/*.parquet'")
    frame = queries.QUERIES[name](spark, str(folder))
    plain = lambda x: [plain(y) for y in x] if isinstance(x, (list, tuple)) else repr(x)
    columns = sorted(frame.columns)
    found = sorted(map(plain, frame.select(*columns).collect()), key=repr)
    told = con.execute(f"SELECT {', '.join(columns)} FROM ({queries.ORACLES[name]})").fetchall()
    return found, sorted(map(plain, told), key=repr)


def test_faces_of_pages_with_one_url(spark, tmp_path):
    rows = [(6, "u"), (2, "u"), (4, "u"), (1, "u"), (3, "alone"), (8, "v"), (9, None), (10, None)]
    found, told = both(spark, tmp_path, "j7_attach_face", pages=spark.createDataFrame(rows, "page_id long, url string"))
    assert found == told
    assert {r[1]: r[0] for r in found} == {"6": "0.002", "2": "0.002", "4": "0.002", "1": "0.002", "3": "None", "8": "0.008", "9": "None", "10": "None"}


def vectors_at(spark, distances):
    rows = [(n, [1 - d, math.sqrt(1 - (1 - d) ** 2)], 0) for n, d in distances.items()]
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")


def test_nearest_of_many_vectors(spark, tmp_path):
    """A difference of a millionth counts before any difference of numbers."""
    found, told = both(spark, tmp_path, "v5_nearest_other", embeddings=vectors_at(spark, {50: 0.0, 1: 0.100001, 7001: 0.1, 9001: 0.1}))
    assert found == told and [r[1:] for r in found] == [["50", "7001"]]


def test_normal_form_of_small_values_and_zero(spark, tmp_path):
    """A value that rounds to nothing is 0.0 and not -0.0; the zero vector stays as it is."""
    rows = [(1, [1.0, -1e-8]), (2, [0.0, 0.0]), (3, [-3.0, 4.0]), (4, None), (5, [])]
    found, told = both(spark, tmp_path, "v6_normalize", embeddings=spark.createDataFrame(rows, "vec_id long, embedding array<float>"))
    assert found == told
    assert {r[2]: r[0] for r in found} == {"1": ["1.0", "0.0"], "2": ["0.0", "0.0"], "3": ["-0.6", "0.8"], "4": "None", "5": []}
