"""Grid search over blocks: fold statistics once, every setting scored on the rows its models did not see.

`search` writes one result table per family as soon as its settings are scored, under `store` when one is given; a restart
with the same store reads what is finished and fits the rest.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Hashable, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, fields, is_dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortloom.operators import boosting, linear
from cohortloom.operators.blocks import WHOLE, Blocks, Prepared
from cohortloom.operators.compare import METRICS, _result_table
from cohortloom.operators.evaluate import binary_metrics, threshold_grid
from cohortloom.operators.heldout import held_out_auc
from cohortloom.operators.models import ModelConfig, with_training_weight
from cohortloom.operators.split import percentile_choice
from cohortloom.session import materialise, path_exists

#: Families fitted at the same time; each is a sequence of Spark jobs.
POOL = 4


@dataclass(frozen=True)
class Family:
    """A model with its grid: `strengths`, `ratios`, `percentiles` for linear ones, `settings` for boosting, `smoothing` for Bayes."""

    name: str
    kind: str
    strengths: tuple[float, ...] = (1.0,)
    ratios: tuple[float, ...] = (0.0,)
    percentiles: tuple[int, ...] = ()
    settings: tuple[boosting.Setting, ...] = ()
    smoothing: tuple[float, ...] = ()
    takes_weights: bool = True


# Grids of the comparison and of the search.
FAMILIES = (
    Family("LogisticRegression", "linear", strengths=(0.01, 0.1, 1.0, 10.0), percentiles=(30, 50, 70)),
    Family("LogisticRegression_L2", "linear", strengths=(0.01, 0.1, 1.0, 10.0, 30.0)),
    Family("LogisticRegression_EN", "linear", strengths=(0.01, 0.1, 1.0, 10.0), ratios=(0.2, 0.5, 0.8)),
    Family("GaussianNB", "bayes", smoothing=(1e-9, 1e-8, 1e-7), takes_weights=False),
)

#: The grid of histogram boosting: 60 fits of 100 trees over five folds, so a call of its own.
HISTOGRAMS = Family(
    "HistGradientBoosting", "boosting",
    settings=tuple(boosting.Setting(r, d, n) for r in (0.03, 0.1) for d in (None, 3, 5) for n in (15, 31)),
)


@dataclass
class Bayes:
    """Gaussian naive Bayes of imputed columns; every variance raised by `smoothing` of the largest one."""

    fill: np.ndarray
    share: np.ndarray
    mean: np.ndarray
    var: np.ndarray

    def probability(self, x: np.ndarray) -> np.ndarray:
        x = np.where(np.isnan(x), self.fill, x)
        score = [np.log(s) - 0.5 * (np.log(2 * np.pi * v) + (x - m) ** 2 / v).sum(axis=1) for s, m, v in zip(self.share, self.mean, self.var)]
        return 1.0 / (1.0 + np.exp(np.clip(score[0] - score[1], -700, 700)))


@dataclass
class Columns:
    """A model of some of the columns that a row has."""

    model: object
    columns: np.ndarray

    def probability(self, x: np.ndarray) -> np.ndarray:
        return self.model.probability(x[:, self.columns])


def bayes(blocks: Blocks, smoothing: Sequence[float], outs: Sequence[int]) -> dict[tuple[float, int], Bayes]:
    """Models by (smoothing, left-out fold); class moments of all folds in two passes."""
    everything = np.arange(len(blocks.features))
    return {(s, k): m for (_, s, k), m in bayes_sets(blocks, smoothing, outs, {0: everything}).items()}


def bayes_sets(blocks: Blocks, smoothing: Sequence[float], outs: Sequence[int], sets: dict[Hashable, np.ndarray]) -> dict[tuple[Hashable, float, int], Bayes]:
    """Models of each set of columns by (set, smoothing, left-out fold): a column's moments are the same in all."""
    medians, p = blocks.medians(), len(blocks.features)

    def sums(center: np.ndarray, power: int) -> np.ndarray:
        """Per left-out fold and class: rows and sums of (imputed value - center)^power."""

        def step(b) -> np.ndarray:
            out = np.zeros((len(outs), 2, 2, p))
            for i, k in enumerate(outs):
                rows = b.fold != k if k != WHOLE else np.ones(len(b.label), bool)
                x = np.where(np.isnan(b.x), medians[k], b.x)
                for y in (0, 1):
                    part = x[rows & (b.label == y)]
                    out[i, y] = [np.full(p, len(part)), ((part - center[i, y]) ** power).sum(axis=0)]
            return out

        return blocks.reduce(step)

    start = np.array([[medians[k]] * 2 for k in outs])
    first = sums(start, 1)
    n = np.maximum(first[:, :, 0], 1)
    mean = start + first[:, :, 1] / n
    var = sums(mean, 2)[:, :, 1] / n
    found = {}
    for i, k in enumerate(outs):
        share = n[i, :, 0] / n[i, :, 0].sum()
        grand = (share[:, None] * mean[i]).sum(axis=0)
        wide = (share[:, None] * (var[i] + (mean[i] - grand) ** 2)).sum(axis=0)
        for name, columns in sets.items():
            for s in smoothing:
                found[name, s, k] = Bayes(medians[k][columns], share, mean[i][:, columns], var[i][:, columns] + s * float(wide[columns].max()))
    return found


def _lines(blocks: Blocks, family: Family, columns: np.ndarray | None = None, weighting: int = 0, only: str | None = None) -> dict[tuple, linear.Path]:
    """Paths of a linear family on some columns, by (ratio, percentile); with `only`, what leads to that setting."""
    columns, outs = np.arange(len(blocks.features)) if columns is None else columns, (*blocks.folds, WHOLE)
    keeps = {None: dict.fromkeys(outs, columns)}
    if family.percentiles:
        f = {k: blocks.prepared()[k].f[columns] for k in outs}
        keeps = {q: {k: columns[percentile_choice(list(f[k]), q)] for k in outs} for q in family.percentiles}
    lines = {}
    for q, keep in keeps.items():
        for ratio in family.ratios:
            strengths = [c for c in sorted(family.strengths) if only in (None, _setting(family, c, ratio, q))]
            if strengths:
                lines[ratio, q] = linear.Path(tuple(c for c in family.strengths if c <= strengths[-1]), ratio, keep, weighting)
    return lines


def _setting(family: Family, c: float, ratio: float, percentile: int | None) -> str:
    text = {"C": c} | ({"l1_ratio": ratio} if family.ratios != (0.0,) else {}) | ({"percentile": percentile} if family.percentiles else {})
    return json.dumps(text, sort_keys=True)


def _models(blocks: Blocks, family: Family, outs: Sequence[int], only: str | None = None) -> dict[tuple[str, int], object]:
    """Fitted models by (setting, left-out fold)."""
    if family.kind == "linear":
        found = linear.paths(blocks, _lines(blocks, family, only=only), outs)
        named = {(_setting(family, c, *line), k): model for (line, k, c), model in found.items()}
    elif family.kind == "boosting":
        settings = [s for s in family.settings if only in (None, s.text())]
        named = boosting.fit(blocks, settings, outs)
    elif family.kind == "bayes":
        named = {(json.dumps({"var_smoothing": s}), k): m for (s, k), m in bayes(blocks, family.smoothing, outs).items()}
    else:
        raise ValueError(f"Unknown kind of model: {family.kind}")
    return {n: m for n, m in named.items() if only in (None, n[0])}


def scored_settings(blocks: Blocks, family: Family) -> DataFrame:
    """(setting, fold, auc) on held-out rows."""
    return held_out_auc(blocks, _models(blocks, family, blocks.folds))


def search(blocks: Blocks, families: Sequence[Family] = FAMILIES, strategy: str = "standard", store: str | None = None) -> DataFrame:
    """(model, strategy, setting, cv_auc_roc, best) of every setting; families run at the same time, POOL at most."""
    spark = blocks.table.sparkSession

    def one(family: Family) -> DataFrame:
        place = store and f"{store}/{hashlib.md5(repr((family, strategy, blocks.features)).encode()).hexdigest()}"
        if place and path_exists(spark, f"{place}/_SUCCESS"):
            return spark.read.parquet(place)
        rows = scored_settings(blocks, family).groupBy("setting").agg(F.avg("auc").alias("cv_auc_roc"))
        rows = rows.select(F.lit(family.name).alias("model"), F.lit(strategy).alias("strategy"), "setting", "cv_auc_roc")
        if not place:
            return materialise(rows, "search")
        rows.write.mode("overwrite").parquet(place)
        return spark.read.parquet(place)

    with ThreadPoolExecutor(POOL) as pool:
        tables = list(pool.map(one, families))
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    # Best mean first; of equal ones the first by name.
    first = out.groupBy("model").agg(F.min_by("setting", F.struct((-F.col("cv_auc_roc")).alias("a"), "setting")).alias("first"))
    return out.join(F.broadcast(first), "model").select("model", "strategy", "setting", "cv_auc_roc", (F.col("setting") == F.col("first")).alias("best"))


def fit_best(blocks: Blocks, family: Family, results: DataFrame) -> tuple[str, object]:
    """The family's best setting, fitted on all rows of the blocks."""
    setting = results.where(F.col("best") & (F.col("model") == family.name)).first()["setting"]
    found = _models(blocks, family, [WHOLE], setting)
    return setting, found[setting, WHOLE]


def score(df: DataFrame, model, features: Sequence[str], name: str = "prob") -> DataFrame:
    """`df` with the probability of label 1."""

    @F.pandas_udf("double")
    def probability(rows: pd.Series) -> pd.Series:
        return pd.Series(model.probability(np.stack(rows.to_numpy()).astype(float)), index=rows.index)

    values = F.array(*[F.coalesce(F.col(c).cast("double"), F.lit(float("nan"))) for c in features])
    return df.withColumn(name, probability(values))


def train_blocks(
    train: DataFrame, features: Sequence[str], strategy: str | Sequence[str] = "standard", label: str = "label", severity: str = "severity", key: str = "entity_id"
) -> Blocks:
    """Blocks of train rows (with `fold`) weighted for each strategy; class balance is left to each fold's fit."""
    strategies = [strategy] if isinstance(strategy, str) else list(strategy)
    config, names = ModelConfig("rows", "", balanced=False), []
    for i, one in enumerate(strategies):
        names.append(f"_weight{i}")
        train = with_training_weight(train, config, one, label, severity).withColumnRenamed("weight", names[-1])
    return Blocks(train, features, label, "fold", names, key)


def _set_models(
    blocks: Blocks, train: DataFrame, families: Sequence[Family], runs: Sequence[tuple], columns: dict[str, np.ndarray], strategies: Sequence[str]
) -> dict[tuple[int, str, int], object]:
    """Models by (number of the run, setting, left-out fold or WHOLE); a run is (set, strategy, family).

    All linear fits share their passes and all naive Bayes of a family its two. Boosting has blocks of its own per run.
    """
    outs, found, lines = [*blocks.folds, WHOLE], {}, {}
    for number, (set_name, strategy, family) in enumerate(runs):
        if family.kind == "linear":
            part = _lines(blocks, family, columns[set_name], strategies.index(strategy))
            lines |= {(number, *line): path for line, path in part.items()}
        elif family.kind != "bayes":
            own = train_blocks(train, [blocks.features[k] for k in columns[set_name]], strategy)
            found |= {(number, n, k): Columns(m, columns[set_name]) for (n, k), m in _models(own, family, outs).items()}
    if lines:
        fits = linear.paths(blocks, lines, outs)
        found |= {(number, _setting(runs[number][2], c, *line), k): m for ((number, *line), k, c), m in fits.items()}
    for family in families:
        if family.kind == "bayes":
            own = {number: columns[r[0]] for number, r in enumerate(runs) if r[2] is family}
            for (number, s, k), m in bayes_sets(blocks, family.smoothing, outs, own).items():
                found[number, json.dumps({"var_smoothing": s}), k] = Columns(m, own[number])
    return found


def score_each(df: DataFrame, models: Sequence, features: Sequence[str], keep: Sequence[str]) -> DataFrame:
    """(run, prob, kept columns): a row per model and row of `df`, whose features are brought to the models once."""

    @F.pandas_udf("array<double>")
    def probabilities(rows: pd.Series) -> pd.Series:
        x = np.stack(rows.to_numpy()).astype(float)
        return pd.Series(list(np.stack([m.probability(x) for m in models], axis=1)), index=rows.index)

    values = F.array(*[F.coalesce(F.col(c).cast("double"), F.lit(float("nan"))) for c in features])
    return df.select(*keep, probabilities(values).alias("_probs")).select(*keep, F.posexplode("_probs").alias("run", "prob"))


def _run_metrics(scored: DataFrame, threshold, tag: str = "") -> dict[int, dict[str, float]]:
    """`val_<tag><metric>` and `test_<tag><metric>` of each run."""
    out: dict[int, dict[str, float]] = {}
    for r in sorted(binary_metrics(scored, "label", "prob", threshold, keys=["run", "split"]).collect(), key=lambda r: r.split, reverse=True):
        out.setdefault(r.run, {}).update({f"{r.split}_{tag}{m}": r[m] for m in METRICS})
    return out


def compare_sets(
    df: DataFrame, feature_sets: dict[str, Sequence[str]], families: Sequence[Family], strategies: Sequence[str] = ("standard", "severity_weighted"),
    tune: str | None = None,
) -> DataFrame:
    """Feature set x family x weighting: the best setting of the grid, its fold score, and metrics on val and test.

    `df` has entity_id, split, label, severity, fold and the features. With `tune`, metrics at the threshold that is
    best for that metric on val are added. One table of blocks has the columns of all sets and the weights of all
    strategies, and fits, fold scores and metrics of all of them share their passes.
    """
    train, rest = df.where(F.col("split") == "train"), df.where(F.col("split") != "train")
    features = list(dict.fromkeys(f for names in feature_sets.values() for f in names))
    columns = {name: np.array([features.index(f) for f in names]) for name, names in feature_sets.items()}
    runs = [(n, s, f) for n in feature_sets for s in strategies for f in families if s == "standard" or f.takes_weights]
    blocks = train_blocks(train, features, strategies)
    models = _set_models(blocks, train, families, runs, columns, strategies)

    texts = {f"{number} {setting}": (number, setting) for number, setting, _ in models}
    aucs = held_out_auc(blocks, {(f"{number} {setting}", k): m for (number, setting, k), m in models.items() if k != WHOLE})
    settings: dict[int, list[tuple]] = {}
    for r in aucs.groupBy("setting").agg(F.avg("auc").alias("auc")).collect():
        number, setting = texts[r.setting]
        settings.setdefault(number, []).append((r.auc is not None, -(r.auc or 0.0), setting, r.auc))
    # Best mean first; of equal ones the first by name.
    best = [min(settings[number]) for number in range(len(runs))]
    chosen = [models[number, setting, WHOLE] for number, (_, _, setting, _) in enumerate(best)]
    scored = materialise(score_each(rest, chosen, features, ["split", "label"]), "scored")
    plain, cuts, tuned = _run_metrics(scored, 0.5), {}, {}
    if tune:
        for number in range(len(runs)):
            val = scored.where((F.col("split") == "val") & (F.col("run") == number))
            cuts[number] = float(threshold_grid(val, "label", "prob", tune).first().threshold)
        own = F.element_at(F.array(*[F.lit(cuts[number]) for number in range(len(runs))]), F.col("run") + 1)
        tuned = _run_metrics(scored, own, "tuned_")
    rows = []
    for number, (set_name, strategy, family) in enumerate(runs):
        _, _, setting, auc = best[number]
        row = {"feature_set": set_name, "feature_count": len(feature_sets[set_name]), "model": family.name, "strategy": strategy, "best_params": setting}
        row |= {"cv_auc_roc": auc} | plain.get(number, {})
        if tune:
            row |= {"tuned_threshold": cuts[number]} | tuned.get(number, {})
        rows.append(row)
    return _result_table(df.sparkSession, rows)


# ---- saved models ----------------------------------------------------------------------------------


def _plain(value):
    """Arrays as lists, with their kind, for JSON."""
    if isinstance(value, np.ndarray):
        return {"array": value.tolist(), "kind": value.dtype.str}
    if is_dataclass(value):
        return {"class": type(value).__name__, "fields": {f.name: _plain(getattr(value, f.name)) for f in fields(value)}}
    if isinstance(value, list):
        return [_plain(v) for v in value]
    return value


def _back(value):
    if isinstance(value, list):
        return [_back(v) for v in value]
    if isinstance(value, dict) and "array" in value:
        return np.array(value["array"], dtype=value["kind"])
    if isinstance(value, dict):
        return _SAVED[value["class"]](**{n: _back(v) for n, v in value["fields"].items()})
    return value


_SAVED = {c.__name__: c for c in (linear.Linear, Prepared, Bayes, boosting.Tree, boosting.Setting)}


def save_model(spark, model, features: Sequence[str], path: str) -> None:
    """Write a fitted model with its feature names as a table of one row."""
    if isinstance(model, boosting.Boosted):
        text = {"boosted": [model.without, _plain(model.setting), model.base, _plain(model.cuts), _plain(model.trees)]}
    else:
        text = _plain(model)
    spark.createDataFrame([(json.dumps(text), list(features))], "model string, features array<string>").coalesce(1).write.parquet(path)


def load_model(spark, path: str) -> tuple[object, list[str]]:
    """The model and feature names that `save_model` wrote."""
    row = spark.read.parquet(path).first()
    text = json.loads(row["model"])
    if "boosted" not in text:
        return _back(text), list(row["features"])
    without, setting, base, cuts, trees = text["boosted"]
    model = boosting.Boosted(without, _back(setting), base, _back(cuts))
    model.trees = _back(trees)
    return model, list(row["features"])
