"""Models against dense solutions over all rows."""

import random

import numpy as np
import pytest

from corpusgauge.operators import regression as rg


def rows(n=400, seed=2):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        config, kind, rater = rng.choice("abcd"), rng.choice(["deep", "flat"]), rng.choice([0] * 8 + list(range(20)))
        x = rng.gauss(0, 2)
        y = 5 + "abcd".index(config) + (kind == "flat") * (2 + (config == "b")) + 0.3 * x + 0.8 * ((rater * 7) % 5) + rng.gauss(0, 1 + abs(x) / 3)
        out.append((config, kind, rater, x, 3 * x, y))
    return out


SCHEMA = "config string, kind string, rater int, x double, twin double, y double"


def dense(data):
    """The columns of config + kind + config:kind + x, without the redundant one."""
    names, cols = ["intercept"], [np.ones(len(data))]
    c, k = np.array([r[0] for r in data]), np.array([r[1] for r in data])
    for v in "bcd":
        names.append(f"config[{v}]")
        cols.append((c == v) * 1.0)
    names.append("kind[flat]")
    cols.append((k == "flat") * 1.0)
    names.append("x")
    cols.append(np.array([r[3] for r in data]))
    for v in "bcd":
        names.append(f"config[{v}]:kind[flat]")
        cols.append((c == v) * (k == "flat") * 1.0)
    return names, np.stack(cols, axis=1), np.array([r[5] for r in data])


@pytest.mark.parametrize("mergers", [8, 1])
def test_robust_ols(spark, monkeypatch, mergers):
    monkeypatch.setattr(rg, "MERGERS", mergers)
    data = rows()
    names, x, y = dense(data)
    df = spark.createDataFrame([*data, (None, "deep", 1, 1.0, 3.0, 1.0), ("a", "deep", 1, None, 3.0, 1.0), ("a", "deep", 1, 1.0, 3.0, None)], SCHEMA).repartition(7)
    model = rg.design(df, ["config", "kind", "x", "twin", ("config", "kind")], ["y", "rater"])
    got = {r.term: r for r in rg.robust_ols(model, "y", "rater").collect()}
    inverse = np.linalg.inv(x.T @ x)
    b = inverse @ x.T @ y
    e = y - x @ b
    h = np.einsum("ij,jk,ik->i", x, inverse, x)
    classic = np.sqrt(np.diag(inverse) * (e @ e) / (len(y) - len(b)))
    meat = (x * (e / (1 - h))[:, None]).T @ (x * (e / (1 - h))[:, None])
    hc3 = np.sqrt(np.diag(inverse @ meat @ inverse))
    rater = np.array([r[2] for r in data])
    sums = np.array([(x * e[:, None])[rater == g].sum(axis=0) for g in np.unique(rater)])
    g, n, k = len(sums), len(y), len(b)
    among = np.sqrt(np.diag(inverse @ sums.T @ sums @ inverse) * g / (g - 1) * (n - 1) / (n - k))
    assert got["twin"].coef is None and got["twin"].se_hc3 is None and set(got) == {*names, "twin"}
    for i, name in enumerate(names):
        assert np.allclose([got[name].coef, got[name].se, got[name].se_hc3, got[name].se_cluster], [b[i], classic[i], hc3[i], among[i]], rtol=1e-8)


def test_ols_of_few_rows(spark):
    df = spark.createDataFrame([("a", 1.0, 2.0), ("b", 1.0, 3.0)], "f string, x double, y double")
    got = {r.term: r for r in rg.robust_ols(rg.design(df, ["f", "x"], ["y"]), "y").collect()}
    assert abs(got["f[b]"].coef - 1) < 1e-12 and got["x"].coef is None and got["f[b]"].se is None
    none = rg.robust_ols(rg.design(df.where("1 = 0"), ["f", "x"], ["y"]), "y").collect()
    assert all(r.coef is None for r in none)


def reml(spread, x, y, t):
    """(-2 restricted log likelihood, coefficients, errors, within) at a ratio; data turned by the eigenvectors of the covariance matrix."""
    weight = 1 / (1 + t * spread)
    h = (x * weight[:, None]).T @ x
    b = np.linalg.solve(h, x.T @ (weight * y))
    rss = (weight * (y - x @ b) ** 2).sum()
    free = len(y) - x.shape[1]
    within = rss / free
    value = free * (np.log(2 * np.pi * within) + 1) - np.log(weight).sum() + np.linalg.slogdet(h)[1]
    return value, b, np.sqrt(np.diag(np.linalg.inv(h)) * within), within


def test_mixed_model(spark):
    data = rows(250)
    names, x, y = dense(data)
    group = np.array([r[2] for r in data])
    spread, turn = np.linalg.eigh((group[:, None] == group[None, :]) * 1.0)
    x, y = turn.T @ x, turn.T @ y
    low, high = 0.0, 50.0
    for _ in range(60):  # golden section over the dense likelihood
        a, b = high - 0.618034 * (high - low), low + 0.618034 * (high - low)
        low, high = (low, b) if reml(spread, x, y, a)[0] < reml(spread, x, y, b)[0] else (a, high)
        if high - low < 1e-7:
            break
    value, coef, errors, within = reml(spread, x, y, (low + high) / 2)
    df = spark.createDataFrame([*data, ("a", "deep", None, 1.0, 3.0, 99.0)], SCHEMA).repartition(5)
    model = rg.design(df, ["config", "kind", "x", "twin", ("config", "kind")], ["y"])
    got = {r.term: r for r in rg.mixed_model(model, "y", "rater").collect()}
    assert got["twin"].estimate is None
    assert np.allclose([got[n].estimate for n in names], coef, rtol=1e-5) and np.allclose([got[n].se for n in names], errors, rtol=1e-5)
    assert np.allclose([got["within"].estimate, got["between"].estimate], [within, within * (low + high) / 2], rtol=1e-4)
    assert abs(got["loglik"].estimate + value / 2) < 1e-6


def test_mixed_model_without_between_variance(spark):
    data = [("a", float(i % 2), i // 2) for i in range(40)]
    df = spark.createDataFrame(data, "f string, y double, rater int")
    got = {r.term: r.estimate for r in rg.mixed_model(rg.design(df, ["f"], ["y"]), "y", "rater").collect()}
    assert got["between"] == 0 and abs(got["intercept"] - 0.5) < 1e-9
    assert rg.mixed_model(rg.design(df.where("1 = 0"), ["f"], ["y"]), "y", "rater").count() == 0


def test_factorial_anova_of_odd_rows(spark):
    from corpusgauge.operators.modeling import factorial_anova

    data = [(a, b, float(len(a) + b % 3 + n % 2)) for a in ("x", "yy", "zzz") for b in range(3) for n in range(4) if (a, b) != ("x", 0)]
    df = spark.createDataFrame([*data, (None, 1, 5.0), ("x", 1, None), ("new", 9, None)], "a string, b int, v double")
    got = {r.effect: r for r in factorial_anova(df, ["a", "b"], "v").collect()}
    assert [got[e].df for e in ("a", "b", "a:b")] == [2, 2, 3] and got["a:b"].ss < 1e-9
    assert factorial_anova(df.where("1 = 0"), ["a", "b"], "v").count() == 0
