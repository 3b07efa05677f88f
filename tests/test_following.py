"""The first value from a row on is found going backwards: a frame to the end would be walked anew for every row."""

import random

from pyspark.sql import functions as F

from tidemark.operators.chunked import index_chunk, ordered_scan


def test_following_values_are_found_backwards(spark):
    rnd = random.Random(2)
    values = {k: [rnd.choice([None, None, rnd.randint(1, 99)]) for _ in range(70)] for k in (None, 1, 2)}
    df = spark.createDataFrame([(k, p, v) for k, vs in values.items() for p, v in enumerate(vs)], "k int, pos long, v int").repartition(4)
    out = ordered_scan(df, ["k"], ["pos"], index_chunk("pos", 8), following={"nxt": F.col("v")})
    assert "unboundedfollowing" not in out._jdf.queryExecution().executedPlan().toString().lower()
    found = {(r.k, r.pos): r.nxt for r in out.collect()}
    assert found == {(k, p): next((v for v in vs[p:] if v is not None), None) for k, vs in values.items() for p in range(len(vs))}
