"""Churn modelling (M1-M8, M14-M18): pyspark.ml logistic regression and the ensembles of ``trees``.

* split and folds are exact and stratified: a row's rank inside its class is
  its position by md5(key-seed); ranks are computed per hash-prefix bucket
  (uniform, so no hot partition even for a class with most of the rows) plus
  the bucket's offset from a small per-bucket count table;
* preprocessing is a ``SQLTransformer`` holding the train-set scaling
  constants and one-hot levels, so the fitted ``PipelineModel`` carries it
  and can be saved, reloaded and applied to batch or streaming frames;
* every fit is a series of distributed passes; only model parameters, tables
  of bins and a few scalars per fold reach the driver. The folds of a
  cross-validation share every pass (``cv_logistic``, ``trees``).
"""

from __future__ import annotations

import os
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pyarrow as pa
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import SQLTransformer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import ship_code, write_once
from . import trees as tr
from .cv_logistic import fit_folds
from .metrics import binary_metrics, ranking_metrics_by

# Fixed values of the reference pipeline.
NUMERIC_FEATURES = [
    "seats", "is_trial", "total_mrr", "mrr_per_seat", "total_subscriptions_count",
    "upgrade_count", "downgrade_count", "net_expansion_score", "annual_billing_ratio",
    "total_feature_events", "total_duration_hours", "avg_session_duration_mins",
    "total_errors", "error_rate_per_100_events", "distinct_features_used", "beta_feature_usage_ratio",
    "total_tickets", "avg_csat", "avg_first_response_min", "avg_resolution_hours",
    "total_escalations", "escalation_rate_pct", "urgent_tickets", "urgent_ticket_ratio", "tenure_months",
]
CATEGORICAL_FEATURES = ["industry", "country", "plan_tier", "referral_source"]
SEED = 42
TEST_FRACTION = 0.20
FOLDS = 5
MODEL_NAMES = ["Logistic Regression (Baseline)", "Random Forest Classifier", "Gradient-Boosted Trees"]
ROWS_PER_PARTITION = 100_000  # training-table partition size for the model fits
ALL_ROWS = -2  # the model that leaves no fold out


# --------------------------------------------------------------------- M1, M7
def hash_ranks(df: DataFrame, by: list[str], key: str, seed: int = SEED,
               prefix_hex: int = 4) -> DataFrame:
    """Adds ``_rank`` (1-based position inside the ``by`` group when ordered
    by (md5(key || '-' || seed), key)) and ``_group_n`` (group size).

    Equal to row_number() over (partition by ... order by hash, key), but
    computed per (group, hash prefix) bucket -- 16**prefix_hex buckets of
    near-equal size -- plus the bucket's offset, so no task holds a class."""
    h = F.md5(F.concat(F.col(key).cast("string"), F.lit(f"-{seed}")))
    t = (df.withColumn("_h", h)
         .withColumn("_hb", F.conv(F.substring("_h", 1, prefix_hex), 16, 10).cast("int")))
    counts = t.groupBy(*by, "_hb").agg(F.count(F.lit(1)).alias("_c"))
    w = Window.partitionBy(*by).orderBy("_hb").rowsBetween(Window.unboundedPreceding, -1)
    offs = counts.select(*by, "_hb", F.coalesce(F.sum("_c").over(w), F.lit(0)).alias("_off"),
                         F.sum("_c").over(Window.partitionBy(*by)).alias("_group_n"))
    t = t.join(offs, [*by, "_hb"])
    rn = F.row_number().over(Window.partitionBy(*by, "_hb").orderBy("_h", key))
    return t.withColumn("_rank", F.col("_off") + rn).drop("_h", "_hb", "_off")


def stratified_split(df: DataFrame, label: str = "churn_flag", key: str = "account_id",
                     test_fraction: float = TEST_FRACTION, seed: int = SEED) -> DataFrame:
    """Adds ``is_test``: the first round(test_fraction * class size) rows of
    each class in hash order, and ``train_rank`` (rank among the class's
    training rows, NULL for test rows)."""
    r = hash_ranks(df, [label], key, seed)
    n_test = F.floor(F.col("_group_n") * test_fraction + 0.5)
    return (r.withColumn("is_test", F.col("_rank") <= n_test)
            .withColumn("train_rank", F.when(~F.col("is_test"), F.col("_rank") - n_test))
            .drop("_rank", "_group_n"))


def stratified_folds(split: DataFrame, k: int = FOLDS) -> DataFrame:
    """Training rows with ``fold`` = (rank among the class's training rows - 1)
    mod k: every fold gets the same class mix."""
    return (split.where(~F.col("is_test"))
            .withColumn("fold", ((F.col("train_rank") - 1) % k).cast("int")))


# --------------------------------------------------------------------- M2, M3
def _sql_name(c: str) -> str:
    return "`" + c.replace("`", "``") + "`"


def _sql_str(v: str) -> str:
    return "'" + str(v).replace("\\", "\\\\").replace("'", "\\'") + "'"


class Encoding:
    """Train-fitted preprocessing: numerics -> (x - mean) / population std (a
    zero std divides by 1, a NULL becomes 0 = the mean), categoricals ->
    indicators for the sorted train levels minus the first; unseen levels
    give all zeros."""

    def __init__(self, train: DataFrame, numeric: list[str] = NUMERIC_FEATURES,
                 categorical: list[str] = CATEGORICAL_FEATURES, scale: bool = True,
                 levels_from: DataFrame | None = None):
        """``scale=False`` keeps numerics as they are (NULL -> 0) -- the
        notebook fits unscaled; ``levels_from`` takes the one-hot levels from
        another frame (the notebook dummy-codes all rows before splitting)."""
        self.numeric, self.categorical = list(numeric), list(categorical)
        self.scale = scale
        st = train.agg(*[F.avg(F.col(c).cast("double")).alias(f"m{i}") for i, c in enumerate(numeric)],
                       *[F.stddev_pop(F.col(c).cast("double")).alias(f"s{i}") for i, c in enumerate(numeric)]).first()
        self.means = [float(st[f"m{i}"] or 0.0) for i in range(len(numeric))]
        self.stds = [float(st[f"s{i}"] or 0.0) or 1.0 for i in range(len(numeric))]
        if not scale:
            self.means, self.stds = [0.0] * len(numeric), [1.0] * len(numeric)
        # distinct levels are found by a shuffle; what returns is as wide as the model itself
        own = train if levels_from is None else levels_from
        pairs = own.select(F.inline(F.array(*[F.struct(F.lit(i).alias("i"), F.col(c).cast("string").alias("v"))
                                              for i, c in enumerate(categorical)]))) if categorical else None
        found = pairs.where(F.col("v").isNotNull()).distinct().collect() if categorical else []
        self.levels = {c: sorted(r["v"] for r in found if r["i"] == i) for i, c in enumerate(categorical)}

    @property
    def numeric_names(self) -> list[str]:
        return list(self.numeric)

    @property
    def dummy_names(self) -> list[str]:
        return [f"{c}_{v}" for c in self.categorical for v in self.levels[c][1:]]

    @property
    def feature_names(self) -> list[str]:
        return self.numeric_names + self.dummy_names

    def statement(self) -> str:
        parts = []
        for c, m, s in zip(self.numeric, self.means, self.stds):
            parts.append(f"coalesce((CAST({_sql_name(c)} AS DOUBLE) - ({m!r})) / ({s!r}), 0.0) "
                         f"AS z{len(parts)}")
        for c in self.categorical:
            for v in self.levels[c][1:]:
                parts.append(f"CASE WHEN CAST({_sql_name(c)} AS STRING) = {_sql_str(v)} THEN 1.0 ELSE 0.0 END "
                             f"AS d{len(parts) - len(self.numeric)}")
        return "SELECT *, " + ", ".join(parts) + " FROM __THIS__"

    def inputs(self) -> str:
        """SQL array of the raw numerics (NULL stays missing) and the indicators: the trees' inputs, in the order of ``feature_names``."""
        parts = [f"CAST({_sql_name(c)} AS DOUBLE)" for c in self.numeric]
        parts += [f"CASE WHEN CAST({_sql_name(c)} AS STRING) = {_sql_str(v)} THEN 1.0D ELSE 0.0D END" for c in self.categorical for v in self.levels[c][1:]]
        return f"array({', '.join(parts)})"

    def input_columns(self) -> list[str]:
        """Names of the encoded columns, by position (a level may hold any
        character); ``feature_names`` has the names to show, in this order."""
        return [f"z{i}" for i in range(len(self.numeric))] + [f"d{i}" for i in range(len(self.dummy_names))]

    def transformer(self) -> SQLTransformer:
        return SQLTransformer(statement=self.statement())


# --------------------------------------------------------------------- M4-M6
def class_weights(df: DataFrame, label: str = "churn_flag") -> tuple[float, float]:
    """Balanced weights n / (2 n_c) for (negative, positive)."""
    r = df.agg(F.count(F.lit(1)).alias("n"), F.sum(F.col(label).cast("int")).alias("p")).first()
    n, p = float(r["n"]), float(r["p"] or 0)
    return (n / (2.0 * (n - p)) if n > p else 1.0, n / (2.0 * p) if p > 0 else 1.0)


def logistic(n_train: int) -> LogisticRegression:
    """L2 with C = 1 on balanced weights (Spark normalises the loss by the
    weight sum, which is n with balanced weights, so regParam = 1 / n)."""
    return LogisticRegression(featuresCol="_features", labelCol="label", weightCol="_w", regParam=1.0 / max(n_train, 1),
                              elasticNetParam=0.0, standardization=False, maxIter=1000, tol=1e-6)


def forest_settings(variant: str) -> tr.Forest:
    """150 trees; the script's depth is 6 with nodes split from 5 rows on, the notebook's 5 and 2."""
    return tr.Forest(150, 6, 5, SEED) if variant == "a" else tr.Forest(150, 5, 2, SEED)


def boosting_settings(variant: str, positive_weight: float) -> tr.Boosting:
    """The script: 120 trees of depth 4, positives weighted neg / pos; the notebook: 100 of depth 3, unweighted. Rate 0.05."""
    return tr.Boosting(120, 4, 0.05, positive_weight=positive_weight) if variant == "a" else tr.Boosting(100, 3, 0.05)


def prepare(df: DataFrame, label: str, weights: tuple[float, float], pos_weight_gbt: float) -> DataFrame:
    y = F.col(label).cast("double")
    return df.withColumns({
        "label": y,
        "_w": F.when(y == 1.0, weights[1]).otherwise(weights[0]),
        "_wg": F.when(y == 1.0, pos_weight_gbt).otherwise(1.0),
    })


def build_model(enc: Encoding, clf) -> Pipeline:
    return Pipeline(stages=[enc.transformer(),
                            VectorAssembler(inputCols=enc.input_columns(), outputCol="_features"), clf])


def score(model: PipelineModel, df: DataFrame) -> DataFrame:
    """Adds ``churn_probability`` (P(class 1)) and ``churn_prediction``."""
    out = model.transform(df)
    p = F.col("probability_1") if "probability_1" in out.columns else vector_to_array("probability")[1]
    return out.withColumn("churn_probability", p).withColumn("churn_prediction", (F.col("churn_probability") > 0.5).cast("int"))


def _fold_scorer(fitted: list, width: int):
    """Every row scored by each family's model of its own fold, the one that did not see it."""
    def run(batches):
        for b in batches:
            x, fold = tr._values(b.column(2), width), np.asarray(b.column(1))
            for name, model in fitted:
                score = np.zeros(len(x))
                for f in np.unique(fold):
                    rows = np.flatnonzero(fold == f)
                    if isinstance(model, tuple):
                        kind, cuts, found = model
                        score[rows] = tr.ensemble_probability(kind, found[f], tr.bin_codes(x[rows], cuts))
                    else:
                        score[rows] = model[f].probability(x[rows])
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(x)), b.column(1), b.column(0), pa.array(score)], ["model", "fold", "label", "score"])
    return run


class ChurnExperiment:
    """Split, fit the three models on the training rows, evaluate on the
    hold-out, cross-validate; the pieces the churn queries read."""

    def __init__(self, c360: DataFrame, label: str = "churn_flag", key: str = "account_id",
                 variant: str = "a", numeric: list[str] = NUMERIC_FEATURES,
                 categorical: list[str] = CATEGORICAL_FEATURES):
        """``variant='a'``: the script (scaled numerics, train levels, forest
        depth 6, boosting 120 x 4 weighted). ``'b'``: the notebook (unscaled,
        levels from all rows, depth 5, boosting 100 x 3 unweighted)."""
        self.label, self.key, self.variant = label, key, variant
        c360 = write_once(c360.select(key, label, *numeric, *categorical), "matrix")
        # iterative fitting re-reads this table many times: its partitions
        # depend on the rows alone (about ROWS_PER_PARTITION each, by key,
        # sorted), so the same seed gives the same model on any cluster
        parts = max(1, -(-c360.count() // ROWS_PER_PARTITION))
        self.data = write_once(stratified_split(c360, label, key).repartition(parts, key).sortWithinPartitions(key), "split")
        self.train = self.data.where(~F.col("is_test"))
        self.test = self.data.where(F.col("is_test"))
        self.encoding = (Encoding(self.train, numeric, categorical) if variant == "a" else
                         Encoding(self.train, numeric, categorical, scale=False, levels_from=self.data))
        self.weights = class_weights(self.train, label)
        allc = class_weights(self.data, label)
        # neg/pos over all rows (as the reference computes it)
        self.pos_weight_gbt = allc[1] / allc[0] if variant == "a" else 1.0
        self.n_train = self.train.count()
        self._models: dict[str, PipelineModel] = {}
        self._comparison: DataFrame | None = None

    def _prep(self, df: DataFrame) -> DataFrame:
        return prepare(df, self.label, self.weights, self.pos_weight_gbt)

    def _tree_table(self, rows: DataFrame, fold: str | None = None) -> tuple[DataFrame, list[list[float]]]:
        """The binned training table of the tree ensembles and its cut points."""
        rows = rows.withColumn("_inputs", F.expr(self.encoding.inputs()))
        cuts = tr.cut_points(rows, "_inputs", len(self.encoding.feature_names))
        return tr.binned(rows, self.key, self.label, "_inputs", cuts, fold), cuts

    def model(self, name: str) -> PipelineModel:
        if name not in self._models:
            if name == MODEL_NAMES[0]:
                self._models[name] = build_model(self.encoding, logistic(self.n_train)).fit(self._prep(self.train))
            else:
                table, cuts = self._tree_table(self.train)
                if name == MODEL_NAMES[1]:
                    found, importances = tr.forest(table, cuts, [ALL_ROWS], {ALL_ROWS: self.weights}, forest_settings(self.variant))
                    stage = tr.TreeEnsemble.of("forest", cuts, found[0], importances[0])
                else:
                    found = tr.boost(table, cuts, [ALL_ROWS], boosting_settings(self.variant, self.pos_weight_gbt))
                    stage = tr.TreeEnsemble.of("boosting", cuts, found[0])
                tr.release(table)
                inputs = SQLTransformer(statement=f"SELECT *, {self.encoding.inputs()} AS _inputs FROM __THIS__")
                self._models[name] = PipelineModel([inputs, stage])
        return self._models[name]

    def fit_all(self, parallel: bool = True) -> None:
        todo = [n for n in MODEL_NAMES if n not in self._models]
        if parallel and len(todo) > 1:
            with ThreadPoolExecutor(max_workers=len(todo)) as ex:
                list(ex.map(self.model, todo))
        else:
            for n in todo:
                self.model(n)

    def test_scores(self, name: str) -> DataFrame:
        return score(self.model(name), self.test)

    def evaluate(self, name: str) -> DataFrame:
        s = self.test_scores(name)
        m = binary_metrics(s, self.label, "churn_probability", prediction="churn_prediction", digits=12, cells=True)
        return m.select(F.lit(name).alias("model"), "*")

    def comparison(self) -> DataFrame:
        if self._comparison is not None:
            return self._comparison
        self.fit_all()
        out = None
        for pos, name in enumerate(MODEL_NAMES):
            e = self.evaluate(name).withColumn("position", F.lit(pos))
            out = e if out is None else out.unionByName(e)
        w = Window.orderBy(F.desc("roc_auc"), "position")
        self._comparison = write_once(out.withColumn("rank", F.row_number().over(w))
                                      .withColumn("is_best", F.col("rank") == 1).drop("position"), "comparison")
        return self._comparison

    def best_name(self) -> str:
        return self.comparison().where("is_best").select("model").first()[0]

    def cross_validate(self, k: int = FOLDS, models: list[str] | None = None) -> DataFrame:
        """k-fold stratified CV on the training rows: ROC-AUC per fold, mean
        and population std per model. The k models of a family are fitted
        together, in passes that each read the rows once; one pass scores every
        row with the models of its own fold, and one aggregation ranks them.

        Bins and indicator levels come from all training rows, without labels;
        scaling and class weights are each fold's own."""
        names = models or MODEL_NAMES
        folds = write_once(stratified_folds(self.data, k).withColumn("_inputs", F.expr(self.encoding.inputs())).select(
            self.key, self.label, "fold", "_inputs"), "folds")
        sizes = {r["fold"]: (r["n"], r["p"]) for r in folds.groupBy("fold").agg(
            F.count(F.lit(1)).alias("n"), F.sum(F.col(self.label).cast("int")).alias("p")).collect()}
        n_all, p_all = sum(n for n, _ in sizes.values()), sum(p for _, p in sizes.values())
        weights = {}
        for f in range(k):
            n, p = n_all - sizes.get(f, (0, 0))[0], p_all - sizes.get(f, (0, 0))[1]
            weights[f] = (n / (2.0 * (n - p)) if n > p else 1.0, n / (2.0 * p) if p else 1.0)
        numeric, width = len(self.encoding.numeric), len(self.encoding.feature_names)

        def fit(name):
            if name == MODEL_NAMES[0]:
                return fit_folds(folds, self.label, "fold", "_inputs", width, numeric, k, weights, scale=self.variant == "a")
            cuts = tr.cut_points(folds, "_inputs", width)
            table = tr.binned(folds, self.key, self.label, "_inputs", cuts, "fold")
            if name == MODEL_NAMES[1]:
                found, _ = tr.forest(table, cuts, list(range(k)), weights, forest_settings(self.variant))
            else:
                found = tr.boost(table, cuts, list(range(k)), boosting_settings(self.variant, self.pos_weight_gbt))
            tr.release(table)
            return "forest" if name == MODEL_NAMES[1] else "boosting", cuts, found

        with ThreadPoolExecutor(max_workers=len(names)) as ex:  # passes of one family fill the gaps of another
            fitted = list(ex.map(fit, names))
        spark = self.data.sparkSession
        ship_code(spark)
        scores = folds.select(F.col(self.label).cast("int").alias("label"), "fold", "_inputs").mapInArrow(
            _fold_scorer(list(zip(names, fitted, strict=True)), width), "model string, fold int, label int, score double")
        auc = ranking_metrics_by(scores, ["model", "fold"], "label", "score", digits=12).select("model", "fold", "roc_auc")
        return auc.groupBy("model").agg(
            F.avg("roc_auc").alias("mean_roc_auc"), F.stddev_pop("roc_auc").alias("std_roc_auc"),
            F.sort_array(F.collect_list(F.struct("fold", "roc_auc"))).alias("folds"))

    def feature_importance(self, name: str = MODEL_NAMES[1]) -> DataFrame:
        """Gini importances of the forest (even when another model wins)."""
        imp = self.model(name).stages[-1].importances
        spark = self.data.sparkSession
        rows = [(f, float(v)) for f, v in zip(self.encoding.feature_names, imp)]
        return spark.createDataFrame(rows, "feature string, importance double").orderBy(
            F.desc("importance"), "feature")

    def save_best(self, path: str) -> str:
        name = self.best_name()
        self.model(name).write().overwrite().save(path)
        return name


def score_with_saved(path: str, df: DataFrame) -> DataFrame:
    """Reload a saved PipelineModel and score (batch or streaming)."""
    return score(PipelineModel.load(path), df)


def model_path(spark, name: str = "churn_model") -> str:
    from ..session import scratch_path
    return scratch_path(spark, os.path.join("models", name))
