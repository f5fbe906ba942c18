"""Hard negatives: intervals hold every score, results equal all pairs', odd rows."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tallyspark.llm import negatives


def batch(vectors, labels, width, first=0):
    codes, norms, alignments = negatives.encoded(negatives.filled(vectors, width))
    cols = [pa.array(np.arange(len(vectors)) + first), pa.array(np.arange(len(vectors)) + first), pa.array(labels), pa.array([np.asarray(v, float).tobytes() for v in vectors], pa.binary()), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(norms), pa.array(alignments)]
    return pa.RecordBatch.from_arrays(cols, [c.split()[0] for c in negatives.CODED.split(", ")])


@pytest.mark.parametrize(("dims", "scale"), [(3, 9), (64, 100), (100, 100), (200, 1e6), (64, 0)])
def test_intervals_hold_the_scores(dims, scale):
    r = np.random.default_rng(dims)
    vectors = [np.floor(r.normal(size=dims) * scale + (k % 3) * scale) for k in range(300)]
    width = negatives.width_of(dims)
    rows, anchors = negatives.Rows([batch(vectors, np.zeros(300, np.int64), width)], width), negatives.Anchors([batch(vectors[:20], np.zeros(20, np.int64), width)], width)
    low, high = negatives.intervals(anchors, rows, slice(0, 300))
    true = np.array(vectors[:20]) @ np.array(vectors).T
    assert (low <= true).all() and (true <= high).all()
    assert np.allclose(np.linalg.norm(negatives.rotated(rows.vector), axis=1), rows.norm)
    i, j = np.nonzero(high >= low)
    assert (negatives.scores(anchors, rows, i, j) == true[i, j]).all() and (negatives.scores(anchors, rows, i[::97], j[::97]) == true[i[::97], j[::97]]).all()
    if scale:  # the signs leave under 0.7 of a vector, here
        assert ((high - low) / 2 / (anchors.norm[:, None] * rows.norm)).mean() < 0.7


def brute(rows, every):
    """rows: (id, label, whole-number vector) that take part, in the order of the table."""
    dot = lambda a, b: sum(int(x) * int(y) for x, y in zip(a, b))
    by = lambda x: (-x[0], x[1] is None, x[1] or 0, x[2])
    out = []
    for n, (vec_id, label, v) in enumerate(rows):
        if vec_id is None or vec_id % every:
            continue
        every_one = sorted(((dot(v, w), i, m, k) for m, (i, k, w) in enumerate(rows) if m != n), key=by)
        for ps, pid, _, _ in [x for x in every_one if x[3] == label][:5]:
            fits = [x for x in every_one if x[3] != label and 30 * ps <= 100 * x[0] <= 90 * ps][:10]
            out += [(vec_id, pid, k + 1, x[1], ps, x[0]) for k, x in enumerate(fits)]
    return sorted(map(str, out))


@pytest.mark.parametrize("kind", ["clusters", "ties", "copies"])
def test_mined_by_all_pairs(spark, kind):
    r = np.random.default_rng(7)
    if kind == "clusters":
        mid = r.normal(size=(6, 40))
        rows = [(i, int(r.integers(0, 6)), (mid[r.integers(0, 6)] + r.normal(size=40) * 0.4).tolist()) for i in range(400)]
    elif kind == "ties":
        rows = [(i, i % 3, r.integers(-1, 2, 5).astype(float).tolist()) for i in range(300)]
    else:
        rows = [(i, i % 2, [1.0, 2.0, 0.5]) for i in range(200)] + [(i, 5, [0.5 * (i % 4), 1.0, 1.0]) for i in range(200, 300)]
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>")
    want = brute([(i, k, np.floor(np.array(v) * 256)) for i, k, v in rows], 10)
    got = sorted(map(str, map(tuple, negatives.mined(df.repartition(5), 10).collect())))
    assert got == want and want


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, 1, [0.5, 0.25]), (1, 1, [0.5]), (2, 1, []), (None, 2, [0.25, 0.1]), (4, 2, None), (5, None, [1.0]), (6, 2, [nan]), (8, 2, [inf, 1.0]), (9, 2, [None, 1.0]), (10, 2, [0.3, 0.1, 9.0]), (10, 1, [0.4, 0.0]), (10, 1, [0.4, 0.0]), (11, 2, [0.25, 0.1]), (-10, 3, [1e9, -1e9]), (13, 3, [1.0, 1.0]), (14, 3, [-1.0, -0.5]), (20, 4, [0.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>").withColumns({c: F.lit("mine") for c in ("row", "score", "rank", "code", "norm", "anchor_row", "scores")})
    fill = lambda v: np.floor(np.array([*v, *[0.0] * (3 - len(v))]) * 256)
    taken = [(i, k, fill(v)) for i, k, v in rows if k is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    got = sorted(map(str, map(tuple, negatives.mined(df.coalesce(1), 10).collect())))
    assert got == brute(taken, 10) and got
    assert negatives.mined(df.limit(0), 10).count() == 0 and negatives.mined(df.filter("vec_id = 11"), 10).count() == 0
    assert negatives.mined(df.filter("vec_id = 20"), 10).columns == negatives.mined(df, 10).columns


def test_large_scores_are_exact_or_an_error(spark):
    rows = [(0, 1, [2.0**17 + 1 / 256, 2.0**17]), (1, 1, [2.0**17, 2.0**17 + 3 / 256]), (2, 2, [2.0**16 + 1 / 256, 2.0**16])]
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>")
    assert sorted(map(str, map(tuple, negatives.mined(df).collect()))) == brute([(i, k, np.floor(np.array(v) * 256)) for i, k, v in rows], 100)
    with pytest.raises(Exception, match="a score of"):
        negatives.mined(df.withColumn("embedding", F.transform("embedding", lambda x: x * 1e9))).collect()
