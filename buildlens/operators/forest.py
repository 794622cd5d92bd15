"""Isolation forest: samples drawn by Spark, one task per group of trees, Arrow scoring.

Fit: every tree gets the rows with the smallest hashes for that tree.  A hash
bound keeps about twice as many candidates as needed, and the row_number limit
is applied before the shuffle, so at most ``trees x samples`` rows per task
travel whatever the size of the table.  Each tree is then grown from its own
(at most 256) rows.  Score: the node table (at most ``trees x 511`` rows) is
broadcast and walked level by level over Arrow batches.

The method is the one of Liu, Ting and Zhou, "Isolation Forest" (2008).
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from buildlens.functions import rules
from buildlens.operators import prep
from buildlens.sources.storage import materialize, spread

NODE_SCHEMA = "variant int, tree_id int, node_id int, feature int, threshold double, lo int, hi int, path double"


def average_path(n: float) -> float:
    """Mean depth of an unsuccessful search in a tree of n values."""
    if n <= 1:
        return 0.0
    if n <= 2:
        return 1.0
    return 2.0 * (math.log(n - 1.0) + np.euler_gamma) - 2.0 * (n - 1.0) / n


def _grow(x: np.ndarray, columns: np.ndarray, rng: np.random.Generator, max_depth: int) -> list[tuple]:
    """Nodes ``(feature, threshold, lo, hi, path)`` of one tree; leaves have feature -1."""
    nodes: list[list] = [[-1, 0.0, -1, -1, 0.0]]
    todo = [(0, np.arange(len(x)), 0)]
    while todo:
        at, rows, depth = todo.pop()
        part = x[rows][:, columns]
        spread = np.flatnonzero(part.max(axis=0) > part.min(axis=0)) if len(rows) > 1 else []
        if depth >= max_depth or len(spread) == 0:
            nodes[at][4] = depth + average_path(len(rows))
            continue
        pick = spread[rng.integers(len(spread))]
        values = part[:, pick]
        threshold = rng.uniform(values.min(), values.max())
        left = values <= threshold
        lo, hi = len(nodes), len(nodes) + 1
        nodes[at] = [int(columns[pick]), float(threshold), lo, hi, 0.0]
        nodes += [[-1, 0.0, -1, -1, 0.0], [-1, 0.0, -1, -1, 0.0]]
        todo += [(lo, rows[left], depth + 1), (hi, rows[~left], depth + 1)]
    return [tuple(n) for n in nodes]


@dataclass
class Forest:
    """Flat node arrays of shape (trees, nodes) and the decision offset."""

    features: list[str]
    feature: np.ndarray
    threshold: np.ndarray
    lo: np.ndarray
    hi: np.ndarray
    path: np.ndarray
    depth: int
    samples: int
    offset: float = -0.5

    @property
    def trees(self) -> int:
        return len(self.feature)

    def _flat(self, t: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Feature, bound and the two next nodes of every node of a tree."""
        # A leaf leads to itself: nothing is above its bound.
        inner = self.feature[t] >= 0
        feature, threshold = np.where(inner, self.feature[t], 0).astype(np.int64), np.where(inner, self.threshold[t], np.inf)
        itself = np.arange(len(inner))
        next_ = np.stack([np.where(inner, self.lo[t], itself), np.where(inner, self.hi[t], itself)], axis=1).ravel()
        return feature, threshold, next_

    def paths(self, x: np.ndarray, stops: list[int] | None = None) -> np.ndarray:
        """Mean path length per row after the first k trees, for each k in ``stops``."""
        stops = stops or [self.trees]
        out = np.empty((len(x), len(stops)))
        total = np.zeros(len(x))
        values, first = np.ascontiguousarray(x).ravel(), np.arange(len(x)) * x.shape[1]
        for t in range(self.trees):
            feature, threshold, next_ = self._flat(t)
            at = np.zeros(len(x), dtype=np.int64)
            for _ in range(self.depth):
                at = next_.take(2 * at + ~(values.take(first + feature.take(at)) <= threshold.take(at)))
            total += self.path[t].take(at)
            for j, k in enumerate(stops):
                if k == t + 1:
                    out[:, j] = total / k
        return out

    def paths_with_moved(self, x: np.ndarray, moved: np.ndarray) -> np.ndarray:
        """Mean path length per row: as it is, then with each single feature taken from ``moved``.

        A row with one other value follows the row's own path up to the first node where that
        value leads to the other side; only from there on it is walked apart.
        """
        n, width = x.shape
        total = np.zeros((width + 1, n))
        own, other, first = np.ascontiguousarray(x).ravel(), np.ascontiguousarray(moved).ravel(), np.arange(n) * width
        for t in range(self.trees):
            feature, threshold, next_ = self._flat(t)
            at = np.zeros(n, dtype=np.int64)
            row = swapped = apart = np.zeros(0, dtype=np.int64)
            for _ in range(self.depth):
                tests, bound = feature.take(at), threshold.take(at)
                cell = first + tests
                right = ~(own.take(cell) <= bound)
                leaving = np.flatnonzero(~(other.take(cell) <= bound) != right)
                if len(row):
                    asked = feature.take(apart)
                    cell = first.take(row) + asked
                    value = np.where(asked == swapped, other.take(cell), own.take(cell))
                    apart = next_.take(2 * apart + ~(value <= threshold.take(apart)))
                # Later ones go first: where a feature leads away twice, the upper node is written last.
                row, swapped = np.concatenate([leaving, row]), np.concatenate([tests.take(leaving), swapped])
                apart = np.concatenate([next_.take(2 * at.take(leaving) + ~right.take(leaving)), apart])
                at = next_.take(2 * at + right)
            reached = np.repeat(self.path[t].take(at)[None, :], width + 1, axis=0)
            reached[swapped + 1, row] = self.path[t].take(apart)
            total += reached
        return (total / self.trees).T

    def _isolation(self, paths: np.ndarray) -> np.ndarray:
        return 2.0 ** (-paths / max(average_path(self.samples), 1e-12))

    def anomaly(self, x: np.ndarray, stops: list[int] | None = None) -> np.ndarray:
        """Isolation score in (0, 1]; larger means easier to isolate."""
        return self._isolation(self.paths(x, stops))

    def anomaly_with_moved(self, x: np.ndarray, moved: np.ndarray) -> np.ndarray:
        """Isolation scores of the paths of :meth:`paths_with_moved`."""
        return self._isolation(self.paths_with_moved(x, moved))


def _forest(nodes: pd.DataFrame, features: list[str], samples: int) -> Forest:
    trees = {t: g.sort_values("node_id") for t, g in nodes.groupby("tree_id")}
    width = max(len(g) for g in trees.values())

    def grid(column: str, fill, dtype) -> np.ndarray:
        out = np.full((len(trees), width), fill, dtype=dtype)
        for i, t in enumerate(sorted(trees)):
            out[i, :len(trees[t])] = trees[t][column].to_numpy()
        return out

    return Forest(features, grid("feature", -1, np.int32), grid("threshold", 0.0, float),
                  grid("lo", -1, np.int32), grid("hi", -1, np.int32), grid("path", 0.0, float),
                  depth=max(1, math.ceil(math.log2(max(samples, 2)))), samples=samples)


def _as_double(name: str) -> Column:
    v = F.col(name).cast("double")
    return F.when(v.isNull() | F.isnan(v), F.lit(0.0)).otherwise(v).alias(name)


def draw_samples(df: DataFrame, features: list[str], key: str, n_rows: int, trees: int, samples: int, seed: int,
                 group: str | None = None) -> DataFrame:
    """``(grp, tree_id, rank, features...)`` with the rows of every tree.

    The order of a tree's rows is a hash of row and tree, so it does not depend
    on partitioning.  ``group`` names an integer column: every group gets its
    own set of samples (used for cross-validation).
    """
    cells = [_as_double(c) for c in features]
    grp = F.col(group) if group else F.lit(0)
    bound = min(1.0, (2.0 * samples + 64.0) / max(n_rows, 1))
    rows = df.select(grp.alias("grp"), F.xxhash64(F.lit(seed), F.col(key), *features).alias("_row"), *cells)

    def place(t: Column) -> Column:
        return F.pmod(F.xxhash64(F.col("_row"), t), F.lit(1 << 53)).cast("double") / F.lit(float(1 << 53))

    # Tree numbers as rows, not as an array to filter: generated code goes through them ten times as fast.
    picked = rows.withColumn("tree_id", F.explode(F.sequence(F.lit(0), F.lit(trees - 1)))) \
        .select("grp", "tree_id", place(F.col("tree_id")).alias("_h"), "_row", *features).filter(F.col("_h") < bound)
    order = Window.partitionBy("grp", "tree_id").orderBy("_h", "_row", *features)
    return picked.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= samples).drop("_h", "_row")


def grow_trees(samples: DataFrame, features: list[str], max_depth: int, seed: int,
               without: list[int | None] | None = None) -> DataFrame:
    """Node table; ``without`` lists feature indexes to leave out, one variant each."""
    variants = without or [None]

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("rank")
        x = pdf[features].to_numpy(dtype=float)
        group, tree = int(pdf["grp"].iloc[0]), int(pdf["tree_id"].iloc[0])
        out = []
        for v, skip in enumerate(variants):
            columns = np.array([i for i in range(len(features)) if i != skip])
            rng = np.random.default_rng(seed + tree)
            for i, node in enumerate(_grow(x, columns, rng, max_depth)):
                out.append((v if without else group, tree, i, *node))
        return pd.DataFrame(out, columns=["variant", "tree_id", "node_id", "feature", "threshold", "lo", "hi", "path"])

    return spread(samples, "grp", "tree_id").groupBy("grp", "tree_id").applyInPandas(build, NODE_SCHEMA)


def fit_forests(df: DataFrame, features: list[str] = rules.FEATURE_NAMES, key: str = "build_id",
                trees: int = rules.N_ESTIMATORS, samples: int = rules.MAX_SAMPLES, seed: int = rules.RANDOM_STATE,
                group: str | None = None, without: list[int | None] | None = None,
                n_rows: int | None = None) -> dict[int, Forest]:
    """Forests by variant (or group), without decision offsets."""
    if n_rows is None:
        n_rows = df.count() if group is None else min(r["count"] for r in df.groupBy(group).count().collect())
    if n_rows == 0:
        raise ValueError("no rows to train on")
    size = min(samples, n_rows)
    drawn = draw_samples(df, features, key, n_rows, trees, size, seed, group)
    depth = max(1, math.ceil(math.log2(max(size, 2))))
    nodes = grow_trees(drawn, features, depth, seed, without).toPandas()
    return {int(v): _forest(g, features, size) for v, g in nodes.groupby("variant")}


def score_columns(df: DataFrame, forests: list[Forest], stops: list[int] | None = None,
                  pick: str | None = None) -> DataFrame:
    """Add ``scores``: minus the isolation score, per forest (or per number of trees).

    ``pick`` names an integer column that selects the one forest of a row.
    """
    features = forests[0].features
    shared = df.sparkSession.sparkContext.broadcast([dict(f.__dict__) for f in forests])

    @F.pandas_udf("array<double>")
    def scores(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        known = [Forest(**f) for f in shared.value]
        for batch in batches:
            x = np.column_stack([b.to_numpy(dtype=float) for b in batch[1:]])
            if pick is not None:
                chosen = batch[0].to_numpy()
                out = np.zeros((len(x), 1))
                for i, forest in enumerate(known):
                    mask = chosen == i
                    if mask.any():
                        out[mask] = -forest.anomaly(x[mask])
            elif stops:
                out = -known[0].anomaly(x, stops)
            else:
                out = np.column_stack([-f.anomaly(x)[:, 0] for f in known])
            yield pd.Series(list(out))

    chosen = F.col(pick).cast("int") if pick else F.lit(0)
    return df.withColumn("scores", scores(chosen, *[_as_double(c) for c in features]))


def score_moved(df: DataFrame, forest: Forest, moved: list[str]) -> DataFrame:
    """Add ``scores``: minus the isolation score of the row, then of the row with each feature in turn taken from ``moved``."""
    features = forest.features
    shared = df.sparkSession.sparkContext.broadcast(dict(forest.__dict__))

    @F.pandas_udf("array<double>")
    def scores(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        known = Forest(**shared.value)
        for batch in batches:
            x = np.column_stack([b.to_numpy(dtype=float) for b in batch])
            yield pd.Series(list(-known.anomaly_with_moved(x[:, :len(features)], x[:, len(features):])))

    return df.withColumn("scores", scores(*[_as_double(c) for c in [*features, *moved]]))


# ------------------------------------------------------------------ model

@dataclass
class Model:
    """Trained detector: scaler, forest with offset, statistics and metadata."""

    scaler: prep.Scaler
    forest: Forest
    contamination: float = rules.CONTAMINATION
    version: str = rules.MODEL_VERSION
    trained_at: str = ""
    stats: dict = field(default_factory=dict)

    @property
    def features(self) -> list[str]:
        return self.forest.features

    def score(self, df: DataFrame) -> DataFrame:
        """Add ``anomaly_score`` (negative is anomalous) and ``prediction`` (-1 or 1)."""
        scaled = [f"_x_{i}" for i in range(len(self.features))]
        wide = df.withColumns({
            s: (F.coalesce(F.col(n).cast("double"), F.lit(0.0)) - F.lit(self.scaler.means[n])) / F.lit(self.scaler.stds[n])
            for s, n in zip(scaled, self.features)})
        forest = Forest(**{**self.forest.__dict__, "features": scaled})
        return (
            score_columns(wide, [forest])
            .withColumn("anomaly_score", F.col("scores")[0] - F.lit(self.forest.offset))
            .withColumn("prediction", F.when(F.col("anomaly_score") < 0, -1).otherwise(1))
            .drop("scores", *scaled)
        )

    def info(self) -> dict:
        return {"is_trained": True, "model_version": self.version, "feature_names": self.features,
                "config": {"n_estimators": self.forest.trees, "contamination": self.contamination},
                "training_stats": self.stats}


def train(df: DataFrame, features: list[str] | None = None, key: str = "build_id",
          trees: int = rules.N_ESTIMATORS, samples: int = rules.MAX_SAMPLES,
          contamination: float = rules.CONTAMINATION, seed: int = rules.RANDOM_STATE,
          trained_at: str = "", version: str = rules.MODEL_VERSION) -> Model:
    """Align, impute, scale, fit, set the offset and keep training statistics."""
    available, _ = prep.align_features(df, features or rules.FEATURE_NAMES)
    if not available:
        raise ValueError("no feature column in the training table")
    # Feature rows are narrow and cost much to derive from logs: write them once.
    data = prep.impute_median(materialize(df.select(key, *available), "training-rows"), available)
    scaler = prep.fit_scaler(data, available)
    forest = fit_forests(scaler.transform(data), available, key, trees, samples, seed)[0]
    model = Model(scaler, forest, contamination, version, trained_at)
    forest.offset = 0.0
    scored = materialize(model.score(data).drop("prediction"), "training-scores")
    forest.offset = prep.exact_percentiles(scored, ["anomaly_score"], [contamination])["anomaly_score"][0]
    decided = scored.withColumn("anomaly_score", F.col("anomaly_score") - F.lit(forest.offset)) \
        .withColumn("prediction", F.when(F.col("anomaly_score") < 0, -1).otherwise(1))
    stats = prep.training_stats(decided, available).first().asDict()
    model.stats = {k: v for k, v in stats.items() if not k.startswith(("mean_", "std_"))}
    model.stats["feature_means"] = {n: stats[f"mean_{n}"] for n in available}
    model.stats["feature_stds"] = {n: stats[f"std_{n}"] or 0.0 for n in available}
    return model


# ----------------------------------------------------------- save and load

def save_model(spark: SparkSession, model: Model, path: str) -> None:
    """Node table as parquet, scaler and metadata as one JSON row, under one version folder."""
    f = model.forest
    nodes = [(0, t, n, int(f.feature[t, n]), float(f.threshold[t, n]), int(f.lo[t, n]), int(f.hi[t, n]), float(f.path[t, n]))
             for t in range(f.trees) for n in range(f.feature.shape[1])]
    spark.createDataFrame(nodes, NODE_SCHEMA).coalesce(1).write.mode("overwrite").parquet(f"{path}/nodes")
    meta = {
        "version": model.version, "trained_at": model.trained_at, "feature_names": model.features,
        "n_samples": model.stats.get("n_samples"), "training_stats": model.stats,
        "config": {"n_estimators": f.trees, "contamination": model.contamination},
        "means": model.scaler.means, "stds": model.scaler.stds,
        "samples": f.samples, "depth": f.depth, "offset": f.offset,
    }
    spark.createDataFrame(
        [(model.version, model.trained_at, model.stats.get("n_samples"), json.dumps(meta))],
        "version string, trained_at string, n_samples long, meta string",
    ).coalesce(1).write.mode("overwrite").json(f"{path}/meta")


def load_model(spark: SparkSession, path: str) -> Model:
    meta = json.loads(spark.read.schema("meta string").json(f"{path}/meta").first()[0])
    nodes = spark.read.parquet(f"{path}/nodes").toPandas()
    forest = _forest(nodes, meta["feature_names"], meta["samples"])
    forest.offset, forest.depth = meta["offset"], meta["depth"]
    return Model(prep.Scaler(meta["means"], meta["stds"]), forest, meta["config"]["contamination"],
                 meta["version"], meta["trained_at"], meta["training_stats"])


def model_versions(spark: SparkSession, folder: str) -> DataFrame:
    """Saved versions below a folder."""
    schema = "version string, trained_at string, n_samples long"
    return spark.read.schema(schema).json(f"{folder}/*/meta").select("version", "trained_at", "n_samples")


def backup_model(spark: SparkSession, path: str, folder: str, stamp: str) -> str:
    """Copy of a saved model under a time stamp."""
    target = f"{folder}/backup_{stamp}"
    save_model(spark, load_model(spark, path), target)
    return target


# -------------------------------------------------------------- selections

def normal_builds(results: DataFrame, hours: int, as_of) -> DataFrame:
    """Recent normal results that kept their features, as training rows."""
    from buildlens.operators.serving import since

    schema = ", ".join(f"{c} double" for c in rules.FEATURE_NAMES)
    return since(results, hours, as_of).filter("NOT is_anomaly AND raw_features IS NOT NULL").select(
        "build_id", F.from_json("raw_features", schema).alias("_f"), "created_at",
    ).select("build_id", "_f.*", F.lit("normal").alias("label"), "created_at")


def retrain_from_normal(results: DataFrame, as_of, hours: int = 168, min_samples: int = 100, **options) -> Model:
    rows = normal_builds(results, hours, as_of)
    found = rows.count()
    if found < min_samples:
        raise ValueError(f"insufficient normal builds: found {found}, need {min_samples}")
    return train(rows, **options)


def weighted_training_union(normals: DataFrame, real: DataFrame, third: DataFrame, sample: int = 400,
                            weight: int = 50, key: str = "build_id") -> DataFrame:
    """At most ``sample`` normals, the real builds ``weight`` times, and a third set, by column name."""
    picked = normals.filter("label = 'normal'").orderBy(F.md5(key), key).limit(sample)
    heavy = real.filter("log_line_count > 0").withColumn("label", F.lit("normal")) \
        .withColumn("_copy", F.explode(F.sequence(F.lit(1), F.lit(weight)))).drop("_copy")
    return picked.unionByName(heavy, allowMissingColumns=True).unionByName(third, allowMissingColumns=True)


def predict(df: DataFrame, model: Model) -> DataFrame:
    """Explained results for a batch of feature rows."""
    from buildlens.operators.explain import explain

    return explain(model.score(df), model.stats.get("feature_means", {}), model.stats.get("feature_stds", {}), model.version)
