"""Fits over blocks against plain numpy on the same rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortloom.operators import blocks as B
from cohortloom.operators import boosting as G
from cohortloom.operators import compare as C
from cohortloom.operators import heldout as H
from cohortloom.operators import linear as L
from cohortloom.operators import search as S


def frame(spark, n=260, seed=4):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 4)) * [1, 5, 0.1, 1] + [0, 100, 0, 0]
    label = (x[:, 0] + rng.normal(size=n) > 0.4).astype(int)
    x[rng.random((n, 4)) < 0.1] = np.nan
    x[:, 3] = 2.0  # a constant
    rows = [(k, int(label[k]), k % 4, float(1 + k % 3), *[None if np.isnan(v) else float(v) for v in x[k]]) for k in range(n)]
    return spark.createDataFrame(rows, "entity_id long, label int, fold int, weight double, a double, b double, c double, d double"), x, label


NAMES = ("a", "b", "c", "d")


def test_statistics_without_each_fold(spark, monkeypatch):
    monkeypatch.setattr(B, "BLOCK_ROWS", 32)
    df, x, label = frame(spark)
    blocks = B.Blocks(df.repartition(3), NAMES, fold="fold", weight="weight")
    fold = np.arange(len(x)) % 4
    for k, got in blocks.prepared().items():
        part = x[fold != k] if k != B.WHOLE else x
        y = label[fold != k] if k != B.WHOLE else label
        fill = np.nanmedian(part, axis=0)
        full = np.where(np.isnan(part), fill, part)
        assert got.fill == pytest.approx(fill) and got.mean == pytest.approx(full.mean(axis=0))
        assert got.std[:3] == pytest.approx(full.std(axis=0)[:3]) and got.std[3] == 1 and got.rows.tolist() == [(y == 0).sum(), (y == 1).sum()]
        groups = [full[y == c][:, :3] for c in (0, 1)]
        between = sum(len(g) * (g.mean(axis=0) - full[:, :3].mean(axis=0)) ** 2 for g in groups)
        within = sum(((g - g.mean(axis=0)) ** 2).sum(axis=0) for g in groups) / (len(y) - 2)
        assert got.f[:3] == pytest.approx(between / within, rel=1e-6)


def plain(x, y, weight, c, ratio):
    """Proximal gradient steps until they stand still."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x.shape[1])
    rate = 1.0 / (c * np.linalg.norm(x.T @ (weight[:, None] * x), 2) / 4 + 1)
    speed, last = w, w
    for k in range(1, 60000):
        g = c * x.T @ (weight * (1 / (1 + np.exp(-x @ speed)) - y))
        g[:-1] += (1 - ratio) * speed[:-1]
        new = speed - rate * g
        new[:-1] = np.sign(new[:-1]) * np.maximum(np.abs(new[:-1]) - rate * ratio, 0)
        if (new - speed) @ (new - last) < 0:
            speed = new
        else:
            speed = new + (k - 1) / (k + 2) * (new - last)
        if np.abs(new - last).max() < 1e-14:
            break
        last = new
    return last


@pytest.mark.parametrize("ratio", [0.0, 0.5, 0.8])
def test_path_against_proximal_gradient(spark, ratio):
    df, x, label = frame(spark)
    blocks = B.Blocks(df, NAMES, fold="fold", weight="weight")
    found = L.path(blocks, [0.01, 1.0, 10.0], [ratio])
    fold = np.arange(len(x)) % 4
    for (k, c, r, _), fit in found.items():
        rows = fold != k if k != B.WHOLE else np.ones(len(x), bool)
        balance = rows.sum() / (2 * np.bincount(label[rows]))
        weight = (1.0 + np.arange(len(x)) % 3)[rows] * balance[label[rows]]
        want = plain(fit.prepared.scaled(x[rows]), label[rows], weight, c, r)
        assert fit.w == pytest.approx(want, abs=1e-6), (k, c, r)
    if ratio == 0.8:
        assert (found[B.WHOLE, 0.01, 0.8, 0].w[:-1] == 0).any()


def test_no_rows_is_an_error(spark):
    df, _, _ = frame(spark)
    with pytest.raises(ValueError):
        L.path(B.Blocks(df.limit(0), NAMES, fold="fold"), [1.0])


def grown(x, y, weight, setting):
    """Raw scores of a boosted model by plain recursion: every split tried on every value, best leaf first."""
    raw = np.full(len(y), np.log((weight * y).sum() / (weight * (1 - y)).sum()))
    for _ in range(setting.stages):
        prob = 1 / (1 + np.exp(-raw))
        g, h = weight * (prob - y), weight * prob * (1 - prob)

        def split(rows, depth):
            if setting.depth is not None and depth >= setting.depth:
                return None
            best = None
            score = lambda r: g[r].sum() ** 2 / h[r].sum()
            for f in range(x.shape[1]):
                there = rows & ~np.isnan(x[:, f])
                for cut in np.unique(x[there, f]):
                    for miss in (False, True):
                        left = there & (x[:, f] <= cut) | (rows & np.isnan(x[:, f]) if miss else False)
                        right = rows & ~left
                        if min(left.sum(), right.sum()) < setting.min_rows or min(h[left].sum(), h[right].sum()) < setting.min_hessian:
                            continue
                        gain = score(left) + score(right) - score(rows)
                        if gain > 1e-12 and (best is None or gain > best[0] + 1e-10):
                            best = (gain, left, right)
            return best

        leaves = [(np.ones(len(y), bool), 0)]
        found = [split(*leaves[0])]
        while len(leaves) < setting.leaves and any(found):
            k = max((i for i, s in enumerate(found) if s), key=lambda i: found[i][0])
            _, left, right = found.pop(k)
            depth = leaves.pop(k)[1] + 1
            leaves += [(left, depth), (right, depth)]
            found += [split(left, depth), split(right, depth)]
        for rows, _ in leaves:
            raw[rows] -= setting.rate * g[rows].sum() / h[rows].sum()
    return 1 / (1 + np.exp(-raw))


@pytest.mark.parametrize(("depth", "leaves", "stages"), [(None, 6, 1), (2, 31, 1), (None, 31, 3)])
def test_boosting_against_plain_recursion(spark, monkeypatch, depth, leaves, stages):
    monkeypatch.setattr(B, "BLOCK_ROWS", 64)
    monkeypatch.setattr(G, "RECENT", 2)
    df, x, label = frame(spark, 220)
    blocks = B.Blocks(df, NAMES, fold="fold", weight="weight")
    setting = G.Setting(0.3, depth, leaves, stages, min_rows=12)
    models = G.fit(blocks, [setting], [B.WHOLE, 1])
    weight, fold = 1.0 + np.arange(len(x)) % 3, np.arange(len(x)) % 4
    for without in (B.WHOLE, 1):
        rows = fold != without
        want = grown(x[rows], label[rows], weight[rows], setting)
        model = models[setting.text(), without]
        assert model.probability(x[rows]) == pytest.approx(want, abs=1e-9) and len(model.trees) == stages
        assert all(t.feature.count(-1) <= leaves for t in model.trees)


def test_crowded_columns_share_bins(spark):
    df = spark.range(5000).selectExpr("id AS entity_id", "CAST(id % 2 AS int) AS label", "CAST(id * id AS double) AS a", "CAST(id % 3 AS double) AS b")
    cuts = G.cut_points(B.Blocks(df, ["a", "b"]), 255)
    sizes = np.bincount(np.searchsorted(cuts[0], np.arange(5000.0) ** 2, side="left"))
    assert len(cuts[0]) == 254 and sizes.max() <= 21 and sizes.min() >= 18 and cuts[1].tolist() == [0.5, 1.5]


FAMILIES = (
    S.Family("L2", "linear", strengths=(0.1, 1.0), percentiles=(50, 100)),
    S.Family("trees", "boosting", settings=(G.Setting(0.3, 2, 4, 3, min_rows=5), G.Setting(0.3, 1, 4, 3, min_rows=5))),
    S.Family("bayes", "bayes", smoothing=(1e-9, 1e-1), takes_weights=False),
)


def auc(label, prob):
    pairs = prob[label == 1][:, None] - prob[label == 0][None, :]
    return ((pairs > 0) + 0.5 * (pairs == 0)).mean()


def test_search_scores_rows_no_model_saw(spark, tmp_path, monkeypatch):
    df, x, label = frame(spark)
    blocks = S.train_blocks(df.withColumn("severity", df["label"]), NAMES)
    store = f"file://{tmp_path}/results"
    found = S.search(blocks, FAMILIES, store=store)
    rows = {(r["model"], r["setting"]): r for r in found.collect()}
    assert len(rows) == 8 and sum(r["best"] for r in rows.values()) == 3 and all(0.6 < r["cv_auc_roc"] < 1 for r in rows.values())
    fold = np.arange(len(x)) % 4
    for family in FAMILIES:
        own = [r for (m, _), r in rows.items() if m == family.name]
        assert max(own, key=lambda r: r["cv_auc_roc"])["cv_auc_roc"] == next(r["cv_auc_roc"] for r in own if r["best"])
    for smoothing in (1e-9, 1e-1):
        each = []
        for k in range(4):
            rest, fill = fold != k, np.nanmedian(x[fold != k], axis=0)
            full = np.where(np.isnan(x), fill, x)
            score = np.zeros((2, len(x)))
            for y in (0, 1):
                part = full[rest & (label == y)]
                var = part.var(axis=0) + smoothing * full[rest].var(axis=0).max()
                score[y] = np.log(len(part) / rest.sum()) - 0.5 * (np.log(2 * np.pi * var) + (full - part.mean(axis=0)) ** 2 / var).sum(axis=1)
            each.append(auc(label[~rest], (score[1] - score[0])[~rest]))
        setting = next(s for m, s in rows if m == "bayes" and float(s.split(": ")[1][:-1]) == smoothing)
        assert rows["bayes", setting]["cv_auc_roc"] == pytest.approx(np.mean(each), abs=1e-12)
    # A second run with the same store reads the finished tables and fits nothing.
    monkeypatch.setattr(S, "scored_settings", None)
    assert sorted(map(tuple, S.search(blocks, FAMILIES, store=store).collect())) == sorted(map(tuple, rows.values()))
    setting, model = S.fit_best(blocks, FAMILIES[0], found)
    scored = S.score(df, model, NAMES).collect()
    assert auc(label, np.array([r["prob"] for r in sorted(scored, key=lambda r: r["entity_id"])])) > 0.75


def test_saved_models_score_the_same(spark, tmp_path):
    df, x, _ = frame(spark)
    blocks = S.train_blocks(df.withColumn("severity", df["label"]), NAMES)
    models = [
        L.path(blocks, [1.0], [0.5])[B.WHOLE, 1.0, 0.5, 0], S.bayes(blocks, [1e-9], [B.WHOLE])[1e-9, B.WHOLE],
        G.fit(blocks, [G.Setting(0.3, 2, 4, 3, min_rows=5)], [B.WHOLE]).popitem()[1],
    ]
    for k, model in enumerate(models):
        S.save_model(spark, model, NAMES, f"file://{tmp_path}/m{k}")
        again, names = S.load_model(spark, f"file://{tmp_path}/m{k}")
        assert names == list(NAMES) and (again.probability(x) == model.probability(x)).all()


def test_summary_of_runs_in_one_scan(spark):
    rows = [("r1", "x", "s", 0.7, 0.6), ("r2", "x", "t", 0.75, 0.58), ("r3", "y", "s", 0.75, 0.66), ("r4", None, "t", None, 0.1)]
    runs = spark.createDataFrame(rows, "run string, family string, strategy string, auc double, f1 double")
    got = {(r.kind, r.name): r for r in C.result_summary(runs, ["family", "strategy"], "auc", "f1", "run").collect()}
    assert got.keys() == {("all", None), ("family", "x"), ("family", "y"), ("family", None), ("strategy", "s"), ("strategy", "t")}
    assert (got["all", None].best_run, got["all", None].best_tuned_run, got["all", None].runs) == ("r2", "r3", 3)
    assert (got["strategy", "s"].best_run, got["strategy", "t"].best_run, got["family", None].best_run) == ("r3", "r2", None)


def test_held_out_auc_of_pieces_and_ties(spark, monkeypatch):
    monkeypatch.setattr(B, "BLOCK_ROWS", 32)
    for name, rows in (("PIECE_ROWS", 16), ("TOGETHER", 64), ("SAMPLE", 60)):
        monkeypatch.setattr(H, name, rows)
    df, _, label = frame(spark)
    df = df.withColumn("b", F.round("a", 1))
    x = np.array([[np.nan if v is None else v for v in r] for r in df.orderBy("entity_id").select(*NAMES).collect()], float)
    blocks = B.Blocks(df.repartition(3), NAMES, fold="fold")
    sets = {"distinct": np.array([0, 2]), "ties": np.array([1])}
    models = {(name, k): S.Columns(m, sets[name]) for (name, _, k), m in S.bayes_sets(blocks, [1e-9], blocks.folds, sets).items()}
    flat = S.Bayes(np.zeros(4), np.full(2, 0.5), np.zeros((2, 4)), np.ones((2, 4)))
    models |= {("constant", k): flat for k in blocks.folds}
    assert max(len(c) for c in H._splitters(blocks, models).values()) > 1
    got = {(r.setting, r.fold): r.auc for r in H.held_out_auc(blocks, models).collect()}
    fold = np.arange(len(x)) % 4
    assert got.keys() == models.keys() and all(got["constant", k] == 0.5 for k in blocks.folds)
    for (name, k), value in got.items():
        assert value == pytest.approx(auc(label[fold == k], models[name, k].probability(x[fold == k])), abs=1e-12)
    one_class = B.Blocks(df.where("label = 1"), NAMES, fold="fold")
    assert [r.auc for r in H.held_out_auc(one_class, models).collect()] == [None] * len(models)


def compared(spark, monkeypatch):
    """Rows with a split, and the passes that a call makes over blocks."""
    df, _, _ = frame(spark)
    df = df.withColumn("severity", F.col("label") * (1 + F.col("entity_id") % 3))
    df = df.withColumn("split", F.expr("CASE entity_id % 5 WHEN 0 THEN 'val' WHEN 1 THEN 'test' ELSE 'train' END")).cache()
    passes, reduce = [], B.Blocks.reduce
    monkeypatch.setattr(B.Blocks, "reduce", lambda self, step: passes.append(1) or reduce(self, step))
    return df, passes


GRIDS = (
    S.Family("L2", "linear", strengths=(0.1, 1.0, 10.0)), S.Family("EN", "linear", strengths=(0.1, 1.0), ratios=(0.2, 0.8)),
    S.Family("bayes", "bayes", smoothing=(1e-9, 1e-1), takes_weights=False),
)


def test_sets_are_compared_in_shared_passes(spark, monkeypatch):
    df, passes = compared(spark, monkeypatch)
    S.compare_sets(df, {"ab": ("a", "b")}, GRIDS[:1], ["standard"])
    alone = len(passes)
    S.compare_sets(df, {"ab": ("a", "b"), "a": ("a",), "abc": ("a", "b", "c")}, GRIDS)
    assert len(passes) - alone < 2 * alone


def test_compared_sets_equal_their_own_searches(spark, monkeypatch):
    df, _ = compared(spark, monkeypatch)
    families = {f.name: f for f in (*GRIDS, S.Family("chosen", "linear", (0.1, 1.0), percentiles=(50, 100)), S.Family("trees", "boosting", settings=(G.Setting(0.3, 2, 4, 1, min_rows=5),)))}
    sets = {"ba": ("b", "a"), "abc": ("a", "b", "c")}
    rows = {(r.feature_set, r.strategy, r.model): r for r in S.compare_sets(df, sets, families.values(), tune="f1").collect()}
    assert len(rows) == 2 * (5 + 4)
    train, rest = df.where("split = 'train'"), df.where("split <> 'train'")
    for (name, strategy, model), r in rows.items():
        if (name, strategy) == ("ba", "standard") or model == "L2" and strategy != "standard":
            blocks = S.train_blocks(train, sets[name], strategy)
            found = S.search(blocks, [families[model]], strategy)
            setting, fitted = S.fit_best(blocks, families[model], found)
            scored = S.score(rest, fitted, sets[name])
            want = C.split_metrics(scored) | C.split_metrics(scored, threshold=r.tuned_threshold, tag="tuned_")
            assert r.best_params == setting and r.cv_auc_roc == pytest.approx(found.where("best").first().cv_auc_roc, abs=1e-9)
            assert {k: r[k] for k in want} == pytest.approx(want, abs=1e-9)
