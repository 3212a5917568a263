"""Points on the outlines of regions and holes of a drawing."""

import duckdb
import pandas as pd

import __spark_entry__ as entry


def test_svg_parse_of_points_on_outlines(spark, tmp_path):
    # Type 0's box reaches to 107.25 on all sides, its hole to 42.9; type 1's region ends where type 0's hole does.
    at = [(0, -100, -100), (0, 100, 100), (0, -42.9, 0), (0, 42.9, 3), (0, 0, -42.9), (0, 5, 42.9), (0, 42.9, 42.9), (0, 41, 7), (1, -107.25, 8), (1, 107.25, 9), (1, 3, -107.25), (1, 4, 107.25), (2, 30, 30.123), (2, 35.65, 12)]
    rows = [(10 * k, [x / 1000, y / 1000], t) for k, (t, x, y) in enumerate(at)]
    frame = pd.DataFrame(rows, columns=["vec_id", "embedding", "label"])
    spark.createDataFrame(frame, "vec_id long, embedding array<float>, label int").coalesce(1).write.parquet(f"{tmp_path}/embeddings.parquet")
    c = duckdb.connect()
    c.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    expected = c.execute(entry.oracle_sql()["svg_parse"]).fetchall()
    got = [tuple(r) for r in entry.queries()["svg_parse"](spark, str(tmp_path)).collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, expected))
