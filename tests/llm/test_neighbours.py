import math
import random

from pyspark.sql import functions as F

from tidemark.llm.neighbours import nearest


def brute(rows, k):
    ok = [(i, [float(x) for x in v]) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    out = []
    for q, a in ok:
        if q % 50:
            continue
        score = lambda b: sum(x * y for x, y in zip(a, b, strict=True)) / (math.sqrt(sum(x * x for x in a)) * math.sqrt(sum(y * y for y in b)))  # noqa: B023, E731
        best = {}
        for i, b in ok:
            if i != q and len(a) == len(b):
                best[i] = max(best.get(i, -2), score(b))
        out += [(q, n + 1, i, s) for n, (i, s) in enumerate(sorted(best.items(), key=lambda x: (-x[1], x[0]))[:k])]
    return sorted(out)


def test_against_all_pairs(spark):
    r = random.Random(1)
    same = [r.gauss(0, 1) for _ in range(12)]
    rows = [(i, same if i % 3 == 0 else [r.gauss(0, 1) for _ in range(12)]) for i in range(400)]
    rows += [(1000, None), (1001, []), (1002, [0.0] * 12), (1003, [1.0, None] * 6), (1004, [float("nan")] * 12), (None, same), (1050, [1.0, 2.0]), (1051, [2.0, 1.0]), (1052, [1e-30, 1e-30])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("rank", F.lit("clash")).repartition(5)
    found = sorted(tuple(x) for x in nearest(df, F.col("vec_id") % 50 == 0).collect())
    expected = brute(rows, 5)
    assert [f[:3] for f in found] == [e[:3] for e in expected]
    assert all(abs(f[3] - e[3]) < 1e-12 for f, e in zip(found, expected, strict=True))


def test_few_and_none(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [-1.0, 0.0])], "vec_id long, embedding array<float>")
    assert [tuple(r) for r in nearest(df, F.col("vec_id") == 0).orderBy("rank").collect()] == [(0, 1, 1, 0.0), (0, 2, 2, -1.0)]
    assert nearest(df.limit(0), F.col("vec_id") == 0).count() == 0
