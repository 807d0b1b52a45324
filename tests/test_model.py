"""Ridge from moments against closed forms, and the diagnosis fixture."""

import numpy as np
import pandas as pd
import pytest

from tallyframe.operators import diagnoses as D
from tallyframe.operators import model as M
from tallyframe.operators import moments as MO


def closed_form(x, y, w, alpha):
    mean, scale = x.mean(0), x.std(0)
    z = (x - mean) / scale
    zc, yc = z - np.average(z, axis=0, weights=w), y - np.average(y, weights=w)
    coef = np.linalg.solve((zc * w[:, None]).T @ zc + alpha * np.eye(z.shape[1]), (zc * w[:, None]).T @ yc)
    base = np.average(y, weights=w) - np.average(z, axis=0, weights=w) @ coef
    return lambda a: (a - mean) / scale @ coef + base


def data(n=150, seed=0):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, len(M.COLUMNS) - 1)) * 3 + 5
    y = 0.5 + 0.02 * x[:, 0] - 0.03 * x[:, 15] + rng.normal(size=n) * 0.05
    pdf = pd.DataFrame(x, columns=M.COLUMNS[:-1])
    return pdf.assign(win_pct=y, season=[f"s{i % 7}" for i in range(n)], weight=rng.choice([0.75, 1.5], n), unit_id=[f"u{i}" for i in range(n)])


def test_moments_ridge_and_nested_folds(spark):
    pdf = data()
    m = MO.season_moments(spark.createDataFrame(pdf).repartition(3), M.COLUMNS)
    x, y, w = pdf[M.COLUMNS[:-1]].to_numpy(), pdf.win_pct.to_numpy(), pdf.weight.to_numpy()
    q, f = x[:, M.QUALITY], x[:, M.FIT]
    target = MO.target_line(len(M.COLUMNS), len(M.COLUMNS) - 1)
    line = MO.prediction_line(MO.fit_ridge(*MO.add_up(m, list(m)), M.QUALITY, target, 3.0), M.QUALITY, len(M.COLUMNS))
    rows = np.column_stack([np.ones(len(x)), x, y])
    assert np.allclose(rows @ line, closed_form(q, y, w, 3.0)(q))

    sizes = {s: int((pdf.season == s).sum()) for s in m}
    fold = MO.grouped_folds(sizes, 6)
    assert sorted(set(fold.values())) == list(range(6))
    of = pdf.season.map(fold).to_numpy()
    errors = {}
    for a in (1.0, 30.0):
        pred = np.zeros(len(y))
        for k in range(6):
            pred[of == k] = closed_form(q[of != k], y[of != k], w[of != k], a)(q[of == k])
        errors[a] = ((y - pred) ** 2).sum()
    alpha, lines = M.cross_validated_quality(m, fold, (1.0, 30.0), target)
    assert alpha == min(errors, key=errors.get)

    # nested: residuals of inner out-of-fold quality predictions train the fit model
    k = 2
    train = pdf.season.map(fold) != k
    seasons = [s for s in m if fold[s] != k]
    inner = MO.grouped_folds({s: sizes[s] for s in seasons}, 5)
    io = pdf.season.map(inner)
    res = y.copy()
    for j in range(5):
        test = (train & (io == j)).to_numpy()
        fitin = (train & (io != j)).to_numpy()
        res[test] = y[test] - closed_form(q[fitin], y[fitin], w[fitin], 10.0)(q[test])
    t = train.to_numpy()
    want = closed_form(f[t], res[t], w[t], 30.0)(f[~t])
    got = MO.fit_ridge(*MO.add_up(m, seasons), M.FIT, M._residual_pieces(m, seasons, 10.0, 5, target), 30.0)
    assert np.allclose(rows[~t] @ MO.prediction_line(got, M.FIT, len(M.COLUMNS)), want)


def test_train_and_score(spark):
    rows = spark.createDataFrame(data(90).drop(columns="weight"))
    model = M.train(rows, M.TrainParams(trees=2, quality_alphas=(1.0, 10.0), fit_alphas=(30.0,)))
    assert 0 < model.validation["rmse"] < 0.2 and 0.7 < model.validation["interval_coverage"] < 0.9
    out = M.score_units(rows, model).toPandas()
    assert len(out) == 90 and out.projected_win_pct.between(0.10, 0.90).all() and out.quality_score.between(0, 100).all()
    fit = M.predict(rows, model).toPandas().set_index("unit_id")["fit"]
    total = out.set_index("unit_id")[[f"channel_{c}" for c in M.P.CHANNELS]].sum(axis=1) / 100 + model.fit.intercept
    assert np.allclose(total.sort_index(), fit.sort_index())


def members(spark):
    base = dict(scoring=55.0, playmaking=45.0, rebounding=50.0, rim_pressure=50.0, defense=50.0, is_shooter=False, fg3m_per36=0.8)
    rows = [dict(base, id=1, shooting=48.0, scoring=85.0, playmaking=92.0), dict(base, id=2, shooting=24.0, scoring=82.0), dict(base, id=3, shooting=18.0, scoring=50.0),
            dict(base, id=4, shooting=61.0, is_shooter=True, fg3m_per36=2.0), dict(base, id=5, shooting=58.0, is_shooter=True, fg3m_per36=1.9)]
    cols = ["id", "shooting", "scoring", "playmaking", "rebounding", "rim_pressure", "defense", "is_shooter", "fg3m_per36"]
    return spark.createDataFrame([("u", *[r[c] for c in cols]) for r in rows],
                                 "unit_id string, id int, shooting double, scoring double, playmaking double, rebounding double, rim_pressure double, defense double, is_shooter boolean, fg3m_per36 double")


def test_spacing_diagnosis(spark):
    dims = {"playmaking": 78.0, "spacing": 35.0, "rebounding": 50.0, "paint": 55.0, "defense": 50.0, "scoring": 65.0, "pace": 50.0}
    chan = {"playmaking": 0.5, "spacing": -1.2, "interior": 0.0, "defense": 0.0, "overlap": 0.0}
    unit = spark.createDataFrame([("u", *dims.values(), *chan.values(), 50.0, 2, 2, 1, 2)],
                                 "unit_id string, " + ", ".join(f"dim_{d} double" for d in dims) + ", " + ", ".join(f"channel_{c} double" for c in chan)
                                 + ", synergy_score double, creators int, shooters int, playmakers int, bigs int")
    r = D.diagnose(unit.join(D.unit_supports(members(spark)), "unit_id")).first()
    assert ("spacing", "Cramped Driving Lanes") in [(w.trait, w.head) for w in r.weaknesses]
    assert r.lead_id == 1 and r.low_volume_ids == [3, 2]
    assert len(r.weaknesses) == 2 and {w.trait for w in r.weaknesses}.isdisjoint({s.trait for s in r.strengths})


def test_grades_and_changes(spark):
    from pyspark.sql import functions as F
    arr = lambda *x: F.array(*map(F.lit, x)) if x else F.array().cast("array<string>")
    g = D.grade_picks(arr("a", "b"), arr("a", "c", "zz"), arr("a", "b", "c"))
    r = spark.range(1).select(*[c.alias(k) for k, c in g.items()]).first()
    assert (r.correct, r.wrong, r.missed, r.grade) == (["a"], ["c"], ["b"], 0.0)
    c = D.trait_changes(arr("spacing"), arr("defense", "scoring"), arr("defense", "rebounding"), arr("spacing"))
    r = spark.range(1).select(*[v.alias(k) for k, v in c.items()]).first()
    assert r.improved == ["defense"] and r.regressed == ["spacing"] and r.gained == ["scoring"] and r.lost == [] and r.fixed == ["rebounding"] and r.opened == []
    v = spark.range(1).select(D.roster_grade(F.lit(0.01), F.lit(0.02)).alias("a"), D.roster_grade(F.lit(0.0), F.lit(0.0)).alias("b"), D.roster_grade(F.lit(-0.1), F.lit(0.0)).alias("c")).first()
    assert (v.a, v.b, v.c) == (pytest.approx(25.0), 50.0, 0.0)


def test_projection_penalty_is_the_leave_one_out_choice(spark):
    from tallyframe.operators import projection as J

    rng = np.random.default_rng(9)
    n = 40
    x = rng.normal(size=(n, len(J.INPUTS)))
    y = x[:, :1] * 0.5 + rng.normal(size=(n, len(J.TARGETS)))
    pdf = pd.DataFrame(np.column_stack([x, y]), columns=[*J.INPUTS, *[f"y_{t}" for t in J.TARGETS]])
    alphas = (0.1, 5.0, 300.0)
    got = J.fit(spark.createDataFrame(pdf).repartition(3), alphas)
    z = (x - x.mean(0)) / x.std(0)
    for j, t in enumerate(J.TARGETS):
        errors = []
        for a in alphas:
            e = 0.0
            for i in range(n):  # columns stay standardized on all rows
                keep = np.arange(n) != i
                zc = z[keep] - z[keep].mean(0)
                coef = np.linalg.solve(zc.T @ zc + a * np.eye(z.shape[1]), zc.T @ (y[keep, j] - y[keep, j].mean()))
                e += (y[i, j] - y[keep, j].mean() - (z[i] - z[keep].mean(0)) @ coef) ** 2
            errors.append(e)
        assert got.models[t].alpha == alphas[int(np.argmin(errors))]
