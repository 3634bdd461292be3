"""Searches of nearest points: against SQL over odd vectors and copies, and by what they write."""

import numpy as np
import pytest

from harness import connect, difference
from parlance.operators import vectors
from parlance.plans import ORACLES, QUERIES
from parlance.sources import work


@pytest.fixture
def odd_dir(tmp_path, spark):
    """Points of eight components: steps of 1/8 (halves in the sixth place), copies, a group closer than single precision, no direction, null."""
    rng = np.random.default_rng(7)
    rows = [(k, rng.normal(size=8).round(3).tolist(), k % 5) for k in range(300)]
    rows += [(k, rng.choice([-1.0, 1.0], size=8).tolist(), k % 5) for k in range(300, 420)]
    rows += [(k, [3.0, 1.0, 0.0, 0.0, 2.0, 0.0, 0.0, 1.0], 1) for k in range(420, 560)]
    rows += [(k, (np.arange(1.0, 9.0) + 2e-7 * rng.normal(size=8)).tolist(), 2) for k in range(560, 640)]
    rows += [(640, None, 1), (660, None, None), (680, [0.0] * 8, 1), (681, [float("nan")] + [1.0] * 7, 2), (700, [float("inf")] + [1.0] * 7, 2)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    df.repartition(3).write.parquet(f"{tmp_path}/embeddings.parquet")
    return str(tmp_path)


@pytest.mark.parametrize("name", ["knn_join", "knn_join_all"])
def test_exact_as_sql(spark, odd_dir, monkeypatch, name):
    """Many small parts give what SQL gives, not-a-number first and null last."""
    monkeypatch.setattr(vectors, "BLOCK", 256)
    monkeypatch.setattr(vectors, "TOGETHER", 3)
    assert difference(QUERIES[name](spark, odd_dir), connect(odd_dir), ORACLES[name]) == ""


def test_exact_of_few(spark, tmp_path):
    """Fewer points than asked for, and none."""
    rows = [(20, [1.0, 0.0], 0), (21, None, 0)]
    for n in (2, 1, 0):
        spark.createDataFrame(rows[:n], "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/{n}/embeddings.parquet")
        assert difference(QUERIES["knn_join_all"](spark, f"{tmp_path}/{n}"), connect(f"{tmp_path}/{n}"), ORACLES["knn_join_all"]) == ""


def test_pairs_are_never_rows(spark, odd_dir):
    """The exact search joins no questions to points: parts of both meet in tasks."""
    found = QUERIES["knn_join_all"](spark, odd_dir)
    plan = found._jdf.queryExecution().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan and "FlatMapCoGroupsInArrow" in plan


@pytest.mark.parametrize("within", [[], ["owner"]])
def test_probes_are_not_written(spark, monkeypatch, within):
    """Working tables hold hits and sizes, never a row for each question and probed cell."""
    rng = np.random.default_rng(3)
    rows = [(k, rng.normal(size=16).tolist(), k % 3) for k in range(3000)]
    df = spark.createDataFrame(rows, "id long, vector array<double>, owner int").cache()
    index = vectors.build(df, within, cells=60)
    written = []
    monkeypatch.setattr(vectors, "stored", lambda d, name: (lambda back: (written.append((name, back.count())), back)[1])(work.stored(d, name)))
    for probes in (3, 30):
        index.probes = probes
        assert vectors.search(index, df, 4).count() == 4 * 3000
    assert max(n for _, n in written) <= 4 * 3000


def test_owner_hits_are_probed_and_exact_when_all_are(spark, monkeypatch):
    """Owners of one to hundreds of points, in parts of 64: all probes give the exact result of each owner."""
    monkeypatch.setattr(vectors, "BLOCK", 256)
    monkeypatch.setattr(vectors, "TOGETHER", 2)
    rng = np.random.default_rng(4)
    sizes = [1, 2, 3, 5, 40, 300, 500]
    rows, k = [], 0
    for owner, n in enumerate(sizes):
        for _ in range(n):
            rows.append((k, rng.normal(size=8).tolist(), owner))
            k += 1
    df = spark.createDataFrame(rows, "id long, vector array<double>, owner int")
    index = vectors.build(df, ["owner"], cells=20)
    index.probes = 20
    got = sorted((r.q, r["rank"], r.id, r.score) for r in vectors.search(index, df, 3).collect())
    x = np.array([r[1] for r in rows])
    x /= np.linalg.norm(x, axis=1)[:, None]
    owner = np.array([r[2] for r in rows])
    want = []
    for q in range(k):
        same = np.flatnonzero(owner == owner[q])
        s = np.round(x[same] @ x[q], 5) + 0.0
        want += [(q, n + 1, int(same[i]), float(s[i])) for n, i in enumerate(np.lexsort((same, -s))[:3])]
    assert [g[:3] for g in got] == [w[:3] for w in want] and all(abs(g[3] - w[3]) < 2e-5 for g, w in zip(got, want))


def test_asked_points_are_not_those_of_the_fit(spark):
    """Probes are measured on other points than those that centroids lie near to: of samples of a tenth about a hundredth is shared."""
    df = spark.range(20_000)
    fit, ask = (vectors.some(df, "id", 20_000, 2000, use) for use in ("fit", "ask"))
    assert 1700 < fit.count() < 2300 and 1700 < ask.count() < 2300 and fit.join(ask, "id").count() < 400
