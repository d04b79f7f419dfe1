"""Likelihood models over panels: targets, walk-forward folds, trainers, calibration. Driver loops run over folds, never rows."""

from __future__ import annotations

from datetime import date, timedelta

import numpy as np
from pyspark.ml import Pipeline
from pyspark.ml.classification import GBTClassifier, LinearSVC, LogisticRegression
from pyspark.ml.feature import Imputer, OneHotEncoder, StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandline.functions.strings import to_flag
from strandline.operators.metrics import ranking_scores


def vif_filter(df: DataFrame, features: list[str], limit: float = 10.0) -> list[str]:
    """Features left when the one of largest variance inflation is dropped until all are below ``limit``.

    NULLs count as the column's median. One pass gives the correlations; the rest is arithmetic on
    a matrix as wide as the features.
    """
    med = df.agg(*(F.percentile_approx(c, 0.5).alias(c) for c in features)).first()
    x = df.select(*(F.coalesce(F.col(c).cast("double"), F.lit(float(med[c] or 0.0))).alias(c) for c in features))
    sd = x.agg(*(F.stddev_pop(c).alias(c) for c in features)).first()
    keep = [c for c in features if sd[c]]
    if len(keep) < 2:
        return keep
    r = x.agg(*(F.corr(a, b).alias(f"{i}_{j}") for i, a in enumerate(keep) for j, b in enumerate(keep) if i < j)).first()
    m = np.eye(len(keep))
    for i in range(len(keep)):
        for j in range(i + 1, len(keep)):
            m[i, j] = m[j, i] = r[f"{i}_{j}"] or 0.0
    at = list(range(len(keep)))
    while len(at) > 1:
        vif = np.diag(np.linalg.pinv(m[np.ix_(at, at)]))
        worst = int(vif.argmax())
        if vif[worst] < limit:
            break
        at.pop(worst)
    return [keep[i] for i in at]


def class_weights(y: Column, share: float) -> Column:
    """Weights that give both classes the same total."""
    return F.when(y == 1, 0.5 / share).otherwise(0.5 / (1 - share))


def _prepared(features: list[str], categories: list[str] | None = None) -> list:
    """Median imputation and scaling of numbers; categories one-hot, the first one dropped, unseen ones all zero."""
    imputed = [f"__i_{c}" for c in features]
    stages = [Imputer(strategy="median", inputCols=features, outputCols=imputed), VectorAssembler(inputCols=imputed, outputCol="__raw"), StandardScaler(inputCol="__raw", outputCol="__num" if categories else "__x", withMean=True)]
    if categories:
        at, hot = [f"__a_{c}" for c in categories], [f"__h_{c}" for c in categories]
        stages += [StringIndexer(inputCols=categories, outputCols=at, handleInvalid="keep", stringOrderType="alphabetDesc"), OneHotEncoder(inputCols=at, outputCols=hot, dropLast=True, handleInvalid="keep"), VectorAssembler(inputCols=["__num", *hot], outputCol="__x")]
    return stages


def logistic(features: list[str], c: float, weight_sum: float, categories: list[str] | None = None) -> Pipeline:
    """Median imputation, scaling and L2 logistic regression of inverse strength ``c``, with one-hot categories where given."""
    return Pipeline(stages=[*_prepared(features, categories), LogisticRegression(featuresCol="__x", labelCol="y", weightCol="w", regParam=1.0 / (c * weight_sum), maxIter=50)])


def boosted(features: list[str], seed: int = 42, rounds: int = 20, depth: int = 3, step: float = 0.1, share: float = 1.0, valid: str | None = None) -> Pipeline:
    """Boosted trees; ``valid`` names a boolean column of rows held out to stop early on."""
    g = GBTClassifier(featuresCol="__x", labelCol="y", weightCol="w", maxIter=rounds, maxDepth=depth, seed=seed, stepSize=step, subsamplingRate=share)
    return Pipeline(stages=[*_prepared(features), g.setValidationIndicatorCol(valid) if valid else g])


def tuned(df: DataFrame, features: list[str], trials: int = 8, rounds: int = 60, seed: int = 42) -> tuple[object, dict]:
    """(model, its parameters): boosted trees of the random parameters that score best, by average precision, on a held-out fifth.

    Each trial stops early on the same rows. df has y, w and a key column ``panel_id`` whose digest splits it.
    """
    rnd = np.random.default_rng(seed)
    held = df.withColumn("__valid", F.pmod(F.xxhash64("panel_id", F.lit(seed)), F.lit(5)) == 0)
    best = None
    for _ in range(trials):
        p = {"depth": int(rnd.integers(2, 6)), "step": float(np.exp(rnd.uniform(np.log(0.03), np.log(0.3)))), "share": float(rnd.uniform(0.6, 1.0))}
        model = boosted(features, seed, rounds, valid="__valid", **p).fit(held)
        got = ranking_scores(scored(model, held.where("__valid")), [], "y", "p").first()
        score = (got.average_precision if got else None) or 0.0
        if best is None or score > best[0]:
            best = (score, model, p)
    return best[1], best[2] | {"average_precision": best[0]}


def margin(features: list[str]) -> Pipeline:
    return Pipeline(stages=[*_prepared(features), LinearSVC(featuresCol="__x", labelCol="y", weightCol="w", maxIter=30)])


def stratified(df: DataFrame, key: str, y: str, test: float = 0.2, seed: int = 42) -> DataFrame:
    """``df`` with ``is_test``: of each class the same share of rows, by digest of the key, the same on any cluster."""
    draw = F.pmod(F.xxhash64(F.lit(seed), F.col(y), F.col(key)), F.lit(1 << 32)) / float(1 << 32)
    return df.withColumn("is_test", draw < test)


def calibrated_margin(df: DataFrame, test: DataFrame, key: str, features: list[str], folds: int = 5) -> DataFrame:
    """``test`` with ``p_cal``: the mean over folds of a linear margin model fitted on the others, made a probability by a sigmoid fitted on the fold."""
    fold = F.pmod(F.xxhash64(key), F.lit(folds))
    out = None
    for k in range(folds):
        train, valid = df.where(fold != k), df.where(fold == k).withColumn("w", F.lit(1.0))
        s, v = train.agg(F.avg("y"), F.count("*")).first(), valid.agg(F.avg("y")).first()[0]
        if not s[1] or s[0] in (0.0, 1.0) or v in (None, 0.0, 1.0):
            continue
        model = margin(features).fit(train.withColumn("w", class_weights(F.col("y"), s[0])))
        p = calibrate(scored(model, valid), scored(model, test.withColumn("w", F.lit(1.0))), "sigmoid").select(F.col(key).alias("__k"), F.col("p_cal").alias(f"__p{k}"))
        out = p if out is None else out.join(p, "__k")
    if out is None:
        return test.withColumn("p_cal", F.lit(None).cast("double"))
    ps = [F.col(c) for c in out.columns if c != "__k"]
    return test.join(out.select("__k", (sum(ps[1:], ps[0]) / len(ps)).alias("p_cal")), F.col(key) == F.col("__k")).drop("__k")


def expert_scores(df: DataFrame, experts: dict[str, object], thresholds: dict[str, float], features_of: dict[str, str] | None = None) -> DataFrame:
    """``df`` with a probability per expert, and the one that is surest among those at or over their own thresholds; NULL where none is."""
    out = df
    for name, model in experts.items():
        out = scored(model, out, f"p_{name}")
    over = F.filter(F.array(*(F.when(F.col(f"p_{n}") >= thresholds.get(n, 0.5), F.struct(F.col(f"p_{n}").alias("p"), F.lit(n).alias("name"))) for n in experts)), lambda x: x.isNotNull())
    return out.withColumn("expert", F.array_max(over)["name"])


def resolved_labels(df: DataFrame, is_gold: Column, types: list[str], weak: str, general: str) -> DataFrame:
    """A 0/1 column ``y_<type>`` per type and ``y_<general>``: gold values for gold rows, else the weak ones.

    A weak general label that is missing is whether any weak type is on. Values are read leniently; missing ones are 0.
    """
    y = {f"y_{t}": F.when(is_gold, to_flag(F.col(t))).otherwise(to_flag(F.col(weak + t))) for t in types}
    any_ = F.greatest(*(to_flag(F.col(weak + t)) for t in types))
    weak_general = F.when(F.col(weak + general).isNull(), any_).otherwise(to_flag(F.col(weak + general))) if weak + general in df.columns else any_
    return df.withColumns(y | {f"y_{general}": F.when(is_gold, to_flag(F.col(general))).otherwise(weak_general)})


def disagreements(types: list[str], a: str, b: str) -> Column:
    """Names of the labels on which two labellers differ."""
    return F.filter(F.array(*(F.when(to_flag(F.col(a + t)) != to_flag(F.col(b + t)), F.lit(t)) for t in types)), lambda x: x.isNotNull())


def masked_target(df: DataFrame, date: str, y: str, h: int, coverage: str | None = None, covered: DataFrame | None = None, keys: list[str] | None = None) -> DataFrame:
    """``y`` made NULL where it can't be trusted: on the last ``h`` days of the whole table; with ``coverage`` where a 0 has low coverage; with
    ``covered`` where a 0 belongs to a group, by ``keys``, that table doesn't hold.
    """
    last = df.agg(F.max(date)).first()[0]
    ok = F.col(date) <= F.date_sub(F.lit(last), h) if last is not None else F.lit(True)
    if coverage:
        ok = ok & ~F.coalesce((F.col(y) == 0) & (F.col(coverage) == "low"), F.lit(False))
    out = df
    if covered is not None:
        out = out.join(covered.select(*keys).distinct().withColumn("__in", F.lit(True)), keys, "left")
        ok = ok & ~((F.col(y) == 0) & F.col("__in").isNull())
    return out.withColumn(y, F.when(ok, F.col(y))).select(*df.columns)


def group_baselines(train: DataFrame, test: DataFrame, key: str, flags: list[str]) -> DataFrame:
    """``test`` with each group's mean of the flags over the training rows; groups that training lacks get the overall mean."""
    means = train.groupBy(F.col(key).alias("__k")).agg(*(F.avg(f).alias(f"baseline_{f}") for f in flags))
    whole = train.agg(*(F.avg(f).alias(f) for f in flags)).first()
    out = test.join(means, F.col(key) == F.col("__k"), "left").drop("__k")
    return out.withColumns({f"baseline_{f}": F.coalesce(f"baseline_{f}", F.lit(whole[f]).cast("double")) for f in flags})


def importances(model, features: list[str]) -> list[tuple[str, float]]:
    """(feature, importance) of a fitted pipeline: coefficients of a linear model, gains of trees."""
    last = model.stages[-1]
    v = last.coefficients if hasattr(last, "coefficients") else last.featureImportances
    return [(f, float(x)) for f, x in zip(features, v.toArray(), strict=False)]


def mean_importances(table: DataFrame, keys: list[str], feature: Column, value: str, k: int) -> DataFrame:
    """(keys, feature, mean, rank): mean over folds per cleaned feature, the ``k`` of largest absolute mean."""
    m = table.groupBy(*keys, feature.alias("feature")).agg(F.avg(value).alias("mean"))
    w = Window.partitionBy(*keys).orderBy(F.desc(F.abs("mean")), "feature")  # a row per feature
    return m.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def scored(model, df: DataFrame, to: str = "p") -> DataFrame:
    out = model.transform(df)
    p = vector_to_array("probability")[1] if "probability" in out.columns else vector_to_array("rawPrediction")[1]
    return out.withColumn(to, p).select(*df.columns, to)


def calibrate(valid: DataFrame, test: DataFrame, kind: str) -> DataFrame:
    """``test`` with ``p_cal``: sigmoid of the score, or an isotonic step function, fitted on ``valid``; ``best`` takes the one of lower Brier score there."""
    if kind == "best":
        kind = min(("isotonic", "sigmoid"), key=lambda k: calibrate(valid, valid, k).agg(F.avg(F.pow(F.col("p_cal") - F.col("y"), 2))).first()[0])
    if kind == "isotonic":
        m = IsotonicRegression(featuresCol="p", labelCol="y").fit(valid.select(F.col("p"), F.col("y").cast("double")))
        return m.transform(test).withColumnRenamed("prediction", "p_cal")
    asm = VectorAssembler(inputCols=["p"], outputCol="__s")
    m = Pipeline(stages=[asm, LogisticRegression(featuresCol="__s", labelCol="y", regParam=0.0)]).fit(valid.select("p", F.col("y").cast("double")))
    return m.transform(test).withColumn("p_cal", vector_to_array("probability")[1]).select(*test.columns, "p_cal")


def periods(first: date, last: date, months: int) -> list[tuple[date, date, date]]:
    """(last day of training, first day, last day) of test periods of so many months: training always ends the day before."""
    out, at = [], first
    while at <= last:
        m = at.month - 1 + months
        after = date(at.year + m // 12, m % 12 + 1, 1)
        out.append((at - timedelta(1), at, min(after - timedelta(1), last)))
        at = after
    return out


def walk_forward(df: DataFrame, date: str, features: list[str], years: list[int], make, calibration: str | None = None) -> DataFrame:
    """Predictions of each test year by a model of all earlier ones; with calibration the year before is held out for it.

    ``df`` has y (0 or 1, NULL is left out), ``date`` and the features. Adds w, p, p_cal where asked, and fold.
    """
    y = F.year(date)
    folds = [(year, y < (year - 1 if calibration else year), (y == year - 1) if calibration else None, y == year) for year in years]
    return walk_folds(df, features, folds, make, calibration)


def walk_periods(df: DataFrame, date_: str, features: list[str], spans: list[tuple[date, date, date]], make) -> DataFrame:
    """The same over :func:`periods`: retrained on all that lies before each; the fold is the period's first day as YYYYMMDD."""
    day = F.col(date_)
    return walk_folds(df, features, [(int(f"{a:%Y%m%d}"), day <= F.lit(end), None, day.between(F.lit(a), F.lit(b))) for end, a, b in spans], make, None)


def walk_folds(df: DataFrame, features: list[str], folds: list[tuple], make, calibration: str | None) -> DataFrame:
    """Over (name, training rows, calibration rows or None, test rows); folds whose training rows hold one class only give nothing."""
    known = df.where("y is not null")
    out = None
    for name, train, valid, test in folds:
        rows = known.where(train)
        s = rows.agg(F.avg("y"), F.count("*")).first()
        if not s[1] or s[0] in (0.0, 1.0):
            continue
        model = make(features, s[1]).fit(rows.withColumn("w", class_weights(F.col("y"), s[0])))
        got = scored(model, known.where(test).withColumn("w", F.lit(1.0)))
        if valid is not None:
            got = calibrate(scored(model, known.where(valid).withColumn("w", F.lit(1.0))), got, calibration)
        got = got.withColumn("fold", F.lit(name))
        out = got if out is None else out.unionByName(got)
    if out is not None:
        return out
    none = F.lit(None).cast("double")  # no fold could be trained for
    return known.withColumns({"w": F.lit(1.0), "p": none} | ({"p_cal": none} if calibration else {}) | {"fold": F.lit(None).cast("int")}).limit(0)


def by_group(df: DataFrame, group: str, names: list[str], run) -> DataFrame:
    """``run``, a backtest, over each group's rows apart; the groups are named, as there are few."""
    parts = [run(df.where(F.col(group) == n)) for n in names]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def elkan_noto(p: Column, c: float) -> Column:
    """A score learnt from positives and unlabelled rows, corrected by the labelling probability, within [0, 1]; NULL stays NULL."""
    return F.when(p.isNotNull(), F.least(F.lit(1.0), F.greatest(F.lit(0.0), p / max(c, 0.5))))


def labelling_probability(df: DataFrame, label: str, covered: Column) -> float:
    """Share of positives in well covered rows; 1 if there is none, 0.5 at least."""
    got = df.where(F.col(label) == 1).agg(F.avg(covered.cast("double"))).first()[0]
    return 1.0 if got is None else max(0.5, got)


def two_stage(df: DataFrame, key: str, slow: list[str], fast: list[str], folds: int = 5) -> DataFrame:
    """Scores of a model on fast features and an out-of-fold risk score that a first model gives the slow ones."""
    fold = F.pmod(F.xxhash64(key), F.lit(folds))
    known = df.where("y is not null").withColumn("__fold", fold)
    risk = None
    for k in range(folds):
        train = known.where(F.col("__fold") != k)
        s = train.agg(F.avg("y"), F.count("*")).first()
        part = known.where(F.col("__fold") == k).withColumn("w", F.lit(1.0))
        got = part.withColumn("risk", F.lit(0.5)) if not s[1] or s[0] in (0.0, 1.0) else scored(logistic(slow, 1.0, s[1]).fit(train.withColumn("w", class_weights(F.col("y"), s[0]))), part, "risk")
        risk = got if risk is None else risk.unionByName(got)
    s = risk.agg(F.avg("y"), F.count("*")).first()
    if not s[1] or s[0] in (0.0, 1.0):
        return risk.withColumn("p", F.col("risk"))
    model = logistic([*fast, "risk"], 1.0, s[1]).fit(risk.withColumn("w", class_weights(F.col("y"), s[0])))
    return scored(model, risk)


def fold_scores(pred: DataFrame, keys: list[str], p: str = "p", least: int = 10) -> DataFrame:
    """Ranking scores per key where there are enough rows and both classes."""
    return ranking_scores(pred, keys, "y", p).where((F.col("n") >= least) & (F.col("n_pos") > 0) & (F.col("n_pos") < F.col("n")))
