import numpy as np
import pytest
from pyspark.sql import functions as F

from courtlens.config import DEFAULT
from courtlens.operators import optimise, stats
from courtlens.plans import models, rankings


def newton(x, y, w):
    """L2 logistic with a free intercept by plain Newton steps."""
    a = np.column_stack([np.ones(len(x)), x])
    b, free = np.zeros(a.shape[1]), np.r_[0.0, np.ones(x.shape[1])]
    for _ in range(50):
        p = 1 / (1 + np.exp(-a @ b))
        b = b - np.linalg.solve((a * (w * p * (1 - p))[:, None]).T @ a + np.diag(free + 1e-12), a.T @ (w * (p - y)) + free * b)
    return b


def labelled(rng, n=700):
    rows = []
    for season in ("2022-2023", "2023-2024"):
        for _ in range(n if season == "2022-2023" else n // 3):
            x = rng.normal(size=3) * [1, 10, 0.1] + [0, 5, 1]
            z = x @ [1, -0.2, 8] - 8
            rows.append((season, *map(float, x), 4.0, float(rng.random() < 1 / (1 + np.exp(-z))), float(rng.random() < 0.3),
                         float(rng.integers(1, 4))))
    return rows


def test_many_fits_at_once_match_newton(spark):
    rows = labelled(np.random.default_rng(1))
    d = spark.createDataFrame(rows, "season string, a double, b double, c double, k double, y double, z double, w double").repartition(7)
    col = lambda *names: [F.col(n) for n in names]
    data = optimise.blocks(d, "season", col("a", "b", "c", "k"), col("y", "z"), F.col("w"))
    scale = optimise.scales(data, {s: [s] for s in ("2022-2023", "2023-2024", "none")}, 4, 3)
    fits = optimise.logistic(data, {(s, t): optimise.Wanted(x, t, [s]) for s, x in scale.items() for t in (0, 1)})
    assert set(scale) == {"2022-2023", "2023-2024"} and optimise.logistic(data, {}) == {}
    for season in scale:
        v = np.array([r[1:] for r in rows if r[0] == season])
        x, w = v[:, :4], v[:, 6]
        mean = np.average(x, axis=0, weights=w)
        sd = np.sqrt(np.average((x - mean) ** 2, axis=0, weights=w))
        mean[3], sd[3] = 0.0, 1.0     # the last input is not scaled
        assert np.allclose(scale[season].mean, mean) and np.allclose(scale[season].sd, sd)
        for t in (0, 1):
            b = newton((x - mean) / sd, v[:, 4 + t], w)
            f = fits[season, t]
            assert np.allclose(np.array(f.coefficients) * sd, b[1:], atol=1e-7)
            assert f.intercept + mean @ np.array(f.coefficients) == pytest.approx(b[0], abs=1e-7)
    data.unpersist()


def test_separable_labels_still_converge(spark):
    """The penalty keeps a perfect split finite, and steps that overshoot are halved."""
    d = spark.createDataFrame([("s", float(i), float(i >= 50)) for i in range(100)], "season string, x double, y double")
    data = optimise.blocks(d, "season", [F.col("x")], [F.col("y")], F.lit(1.0))
    scale = optimise.scales(data, {"s": ["s"]}, 1, 1)
    f = optimise.logistic(data, {"s": optimise.Wanted(scale["s"], 0, ["s"])})["s"]
    b = newton((np.arange(100.0)[:, None] - 49.5) / scale["s"].sd, (np.arange(100) >= 50).astype(float), np.ones(100))
    assert f.coefficients[0] * scale["s"].sd[0] == pytest.approx(b[1], rel=1e-6)


def test_network_gradient_by_differences():
    rng = np.random.default_rng(3)
    scale = optimise.Scale(1.0, np.zeros(1), np.zeros(4), np.ones(4))
    net = optimise.new_network(scale, (5, 3), 1)
    block = ("s", rng.normal(size=(40, 4)), rng.integers(0, 2, (40, 1)).astype(float), rng.random(40) + 0.5)
    part, v = optimise.network_part(net, block, 0.3), optimise.flat(net)
    assert part[0] > 0 and part[2] > 0 and part[0] + part[2] == pytest.approx(block[3].sum())
    for i in range(0, len(v), 3):
        up, down = v.copy(), v.copy()
        up[i] += 1e-6
        down[i] -= 1e-6
        slope = (optimise.network_part(optimise.with_values(net, up), block, 0.3)[1]
                 - optimise.network_part(optimise.with_values(net, down), block, 0.3)[1]) / 2e-6
        assert part[4 + i] == pytest.approx(slope, abs=1e-4)


def adam(x, y, w, net, rounds, share=0.1, rate=0.01, alpha=1e-4, tolerance=1e-4, patience=10):
    """The same training in one piece: whole gradients, early stop on the held-out rows. Gives the least held-out loss."""
    out = optimise.held_out(x, share)
    m = v = 0.0
    best, anchor, stale = np.inf, np.inf, 0
    for step in range(1, rounds + 2):
        part = optimise.network_part(net, ("s", x, y[:, None], w), share)
        seen = part[3] / part[2]
        stale = 0 if seen < best - tolerance else stale + 1
        best = min(best, seen)
        if stale > patience:
            break
        now = optimise.flat(net)
        g = (part[4:] + alpha * now) / part[0]
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        net = optimise.with_values(net, now - rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8))
    return best, out


def test_perceptrons_train_side_by_side(spark):
    rows = labelled(np.random.default_rng(5), 900)
    d = spark.createDataFrame(rows, "season string, a double, b double, c double, k double, y double, z double, w double").repartition(5)
    data = optimise.blocks(d, "season", [F.col(c) for c in "abck"], [F.col("y")], F.col("w"))
    scale = optimise.scales(data, {s: [s] for s in ("2022-2023", "2023-2024")}, 4, 4)
    nets = optimise.networks(data, scale, (16, 8), 120, 42)
    for season, net in nets.items():
        v = np.array([r[1:] for r in rows if r[0] == season])
        x, y, w = v[:, :4].copy(), v[:, 4], v[:, 6]
        want, out = adam(x, y, w, optimise.new_network(scale[season], (16, 8), 42), 120)
        p = optimise.chance(net, x)
        loss = lambda keep, p: np.average(-(y * np.log(p) + (1 - y) * np.log(1 - p))[keep], weights=w[keep])
        assert loss(out, p) == pytest.approx(want, rel=0.01)
        assert loss(~out, p) < 0.8 * loss(~out, np.full(len(y), np.average(y, weights=w)))
    data.unpersist()


def test_optimality_sees_a_wrong_fit(spark):
    rows = [(r[0], *r[1:4], r[5]) for r in labelled(np.random.default_rng(7), 200)]
    d = spark.createDataFrame(rows, "season string, a double, b double, c double, y double")
    fits = models.fit_outcomes(d, ["y"], ["a", "b", "c"], ["a"], DEFAULT.but(aux_max_rows=0))
    check = lambda m: models.optimality(d, m, ["season"], {c: F.col(c) for c in "abc"}, F.col("y")).toPandas()
    good = check(fits)
    assert len(good) == 8 and good.residual.abs().max() < 1e-5
    off = fits.withColumn("coefficients", F.transform("coefficients", lambda c: c * 1.01))
    assert check(off).residual.abs().max() > 1e-2


def test_outcomes_without_a_cap(spark):
    rows = [("s", i, float(i % 7), float(i % 3 == 0)) for i in range(400)]
    d = spark.createDataFrame(rows, "season string, id int, x double, t double")
    all_rows, some = (models.fit_outcomes(d, ["t"], ["x"], ["season", "id"], DEFAULT.but(aux_max_rows=n)).first() for n in (0, 100))
    assert (all_rows.train_rows, some.train_rows) == (400, 100) and all_rows.kind == some.kind == "logistic"


def test_folds_are_scored_by_models_that_never_saw_them(spark):
    rng = np.random.default_rng(9)
    rows = [("s", i % 11, i, float(rng.normal()), float(rng.random() < 0.4)) for i in range(500)]
    d = spark.createDataFrame(rows, "season string, contestid bigint, id int, x double, t double")
    got = models.expected_outcomes(d, ["t"], ["x"], ["season", "id"], DEFAULT.but(aux_max_rows=0), folds=3).toPandas()
    fits = {r.fold: r for r in models.fit_outcomes(d, ["t"], ["x"], ["season", "id"], DEFAULT.but(aux_max_rows=0), 3).collect()}
    for fold in range(3):
        other = np.array([r[3:] for r in rows if r[1] % 3 != fold])
        mean, sd = other[:, 0].mean(), other[:, 0].std()
        b = newton((other[:, :1] - mean) / sd, other[:, 1], np.ones(len(other)))
        assert fits[fold].train_rows == len(other)
        mine = got[got.contestid % 3 == fold]
        assert np.allclose(mine.expected_t, 1 / (1 + np.exp(-(b[0] + b[1] * (mine.x - mean) / sd))), atol=1e-8)
    one = models.expected_outcomes(d.where("contestid = 1"), ["t"], ["x"], ["season", "id"], DEFAULT, folds=3)
    assert one.where("expected_t is not null").count() == 0    # all rows lie in one fold


@pytest.mark.parametrize("most", [100_000, 50, 1])
def test_medians_by_narrowing(spark, monkeypatch, most):
    monkeypatch.setattr(stats, "MEDIAN_VALUES", most)
    rng = np.random.default_rng(6)
    groups = {"hot": rng.normal(size=4_001), "even": rng.random(2_000), "ties": np.r_[np.full(900, 2.0), rng.random(300)],
              "one": np.array([3.5]), "two": np.array([1.0, 4.0]), "skew": np.r_[rng.exponential(size=999) ** 6, [1e300]]}
    rows = [(k, float(v)) for k, vs in groups.items() for v in vs] + [("hot", None), ("hot", float("nan")), ("none", None)]
    d = spark.createDataFrame(rows, "k string, v double").repartition(6)
    got = {r.k: r.m for r in stats.medians(d, ["k"], "v", "m").collect()}
    assert got == {k: pytest.approx(float(np.median(v)), abs=1e-12) for k, v in groups.items()}


def test_ridge_matches_explicit_leave_one_out(spark):
    rng = np.random.default_rng(3)
    rows = []
    for role, n in (("setter", 40), ("middle", 25), ("outside", 5)):
        x = rng.normal(size=(n, 3)) * [1, 10, 0.1] + [0, 5, 1]
        y = x @ [1, 0.3, -4] + rng.normal(size=n)
        rows += [("s", role, *map(float, r), 7.0, float(t), 50 + i) for i, (r, t) in enumerate(zip(x, y))]
    d = spark.createDataFrame(rows, "season string, role_family string, a double, b double, c double, k double, y double, n int")
    scored, info = models.ridge_by_group(d, ["season", "role_family"], ["a", "b", "c", "k"], "y", F.col("n") >= 52, "pred", 10)
    got = scored.toPandas()
    info = {r.role_family: r for r in info.collect()}
    assert info["outside"].kind == "role_mean"
    o = got[got.role_family == "outside"]
    assert np.allclose(o.pred, o.y.mean())
    for role in ("setter", "middle"):
        g = got[got.role_family == role]
        t = g[g.n >= 52]
        x, y = t[["a", "b", "c", "k"]].to_numpy(), t.y.to_numpy()
        mean, sd = x.mean(0), x.std(0)
        sd[sd < 1e-9] = 1
        z = (x - mean) / sd

        def fit(z, y, alpha):
            zc, yc = z - z.mean(0), y - y.mean()
            w = np.linalg.solve(zc.T @ zc + alpha * np.eye(4), zc.T @ yc)
            return w, y.mean() - z.mean(0) @ w

        errors = []
        for alpha in models.ALPHAS:
            e = 0.0
            for i in range(len(y)):
                keep = np.arange(len(y)) != i
                w, b = fit(z[keep], y[keep], alpha)
                e += (y[i] - z[i] @ w - b) ** 2
            errors.append(e)
        alpha = models.ALPHAS[int(np.argmin(errors))]
        assert info[role].alpha == pytest.approx(alpha)
        w, b = fit(z, y, alpha)
        assert np.allclose(g.pred, (g[["a", "b", "c", "k"]].to_numpy() - mean) / sd @ w + b)


def test_metrics_match_pairwise_auc(spark):
    rng = np.random.default_rng(4)
    y = rng.integers(0, 2, 300)
    p = np.round(rng.random(300) * 0.6 + y * 0.2, 2)
    d = spark.createDataFrame([("a", int(v), float(q)) for v, q in zip(y, p)] + [("b", 1, 0.5)], "k string, y int, p double")
    m = {r.k: r for r in stats.classifier_metrics(d, ["k"], "y", "p").collect()}
    diff = p[y == 1][:, None] - p[y == 0][None, :]
    assert m["a"].auc == pytest.approx(((diff > 0) + 0.5 * (diff == 0)).mean())
    q = np.clip(p, 1e-15, 1 - 1e-15)
    assert m["a"].log_loss == pytest.approx(-(y * np.log(q) + (1 - y) * np.log(1 - q)).mean())
    assert m["a"].brier == pytest.approx(((p - y) ** 2).mean()) and m["b"].auc is None


def test_expected_outcomes_fall_back_to_the_mean(spark):
    rows = [("s1", i, i % 3 == 0, True, float(i % 7)) for i in range(80)] + [("s2", i, i % 2 == 0, False, 1.0) for i in range(10)]
    d = spark.createDataFrame(rows, "season string, id int, t boolean, always boolean, x double")
    out = models.expected_outcomes(d, ["t", "always"], ["x"], ["season", "id"]).toPandas()
    s1, s2 = out[out.season == "s1"], out[out.season == "s2"]
    assert np.allclose(s2.expected_t, 0.5) and np.allclose(s1.expected_always, 1.0)
    assert s1.expected_t.nunique() > 1 and s1.expected_t.sum() == pytest.approx(s1.t.sum())


def test_role_rule_order(spark):
    cols = "pos string, box_total_attacks double, box_kills double, box_assists double, event_count_kill double, event_count_set double, base string, want string"
    rows = [
        ("S", 0, 0, 0, 0, 0, "setter", "setter"), ("OH", 200, 0, 600, 0, 0, "outside", "setter"),
        ("MB/RS", 200, 0, 0, 0, 0, "middle", "opposite"), ("MB", 0, 90, 0, 0, 0, "unknown", "middle"),
        ("L/DS", 10, 0, 10, 0, 0, "libero_ds", "libero_ds"), ("DS", 200, 0, 0, 0, 0, "libero_ds", "outside"),
        ("OH", 10, 0, 0, 0, 0, "outside", "outside"), (None, 0, 0, 0, 0, 0, None, "unknown"),
        ("DS", 10, 90, 0, 0, 0, "libero_ds", "libero_ds"),
    ]
    d = spark.createDataFrame([(r[0], *map(float, r[1:6]), *r[6:]) for r in rows], cols)
    assert all(r.got == r.want for r in d.select("want", rankings.inferred_role(F.col("base")).alias("got")).collect())
