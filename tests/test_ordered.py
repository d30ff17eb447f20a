"""Lane-split order work against pandas, with hot groups and hot values."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from corpusgauge.plans.ordered import average_rank, framed, ordered, quantiles


@pytest.fixture(scope="module")
def frame():
    rng = np.random.default_rng(5)
    n = 3000
    key = np.where(rng.random(n) < 0.4, 0, rng.integers(1, 60, n))
    value = np.where(rng.random(n) < 0.35, 7.0, np.round(rng.normal(10, 4, n), 1))
    return pd.DataFrame({"k": key, "v": value, "id": np.arange(n), "w": rng.integers(0, 9, n)})


@pytest.mark.parametrize("parts", [1, 3, 16])
def test_positions_ranks_and_sums(spark, frame, parts):
    df = spark.createDataFrame(frame)
    got = ordered(
        df, ["k"], "v", ["id"], prev=["id"], nxt=["id"], running={"w": "w"}, rank=True, position=True, parts=parts
    ).withColumn("avg_rank", average_rank())
    got = got.toPandas().sort_values(["k", "v", "id"]).reset_index(drop=True)
    want = frame.sort_values(["k", "v", "id"]).reset_index(drop=True)
    g = want.groupby("k")
    assert len(got) == len(want)
    assert (got["pos"] == g.cumcount() + 1).all()
    assert np.allclose(got["avg_rank"], g["v"].rank(method="average"))
    assert (got["n"] == g["v"].transform("size")).all()
    assert (got["before_w"] == g["w"].cumsum() - want["w"]).all()
    assert (got["total_w"] == g["w"].transform("sum")).all()
    shift = g["id"].shift(1)
    assert [None if p is None else p["id"] for p in got["prev"]] == [None if pd.isna(x) else int(x) for x in shift]
    shift = g["id"].shift(-1)
    assert [None if p is None else p["id"] for p in got["nxt"]] == [None if pd.isna(x) else int(x) for x in shift]


@pytest.mark.parametrize("parts", [1, 16])
def test_global_positions(spark, frame, parts):
    got = ordered(spark.createDataFrame(frame), [], "v", ["id"], rank=True, position=True, parts=parts).toPandas()
    got = got.sort_values(["v", "id"]).reset_index(drop=True)
    assert (got["pos"] == np.arange(len(got)) + 1).all()
    assert (got["lo"] == got["v"].rank(method="min")).all()
    assert (got["ties"] == got.groupby("v")["v"].transform("size")).all()


def test_hot_value_is_spread(spark, frame):
    """No (lane, sub-lane) holds the hot value whole."""
    from corpusgauge.plans.ordered import cut_points

    cuts = cut_points(spark.createDataFrame(frame), "v", 16)
    assert cuts.single


@pytest.mark.parametrize("parts", [1, 16])
def test_quantiles(spark, frame, parts):
    probs = {"q05": 0.05, "q50": 0.5, "q95": 0.95}
    df = spark.createDataFrame(frame)
    got = quantiles(df, ["k"], "v", probs, parts).toPandas().set_index("k")
    for name, p in probs.items():
        want = frame.groupby("k")["v"].quantile(p)
        assert np.allclose(got[name].loc[want.index], want)
    whole = quantiles(df, [], "v", probs, parts).toPandas().iloc[0]
    assert np.allclose([whole[n] for n in probs], [frame["v"].quantile(p) for p in probs.values()])


def test_frames_cross_chunks(spark, frame):
    df = ordered(spark.createDataFrame(frame), ["k"], "id", position=True)
    rows, part = framed(df, ["k"], 2, 2, chunk=7)
    w = Window.partitionBy(*part).orderBy("pos").rowsBetween(-2, 2)
    got = rows.withColumn("m", F.avg("v").over(w)).where("own").toPandas().sort_values(["k", "id"])
    want = frame.sort_values(["k", "id"]).groupby("k")["v"].rolling(5, center=True, min_periods=1).mean()
    assert np.allclose(got["m"].to_numpy(), want.to_numpy())
