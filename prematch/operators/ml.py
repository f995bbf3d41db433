"""Imputation, scaling, encoding, forests and pruned trees on MLlib."""

from __future__ import annotations

import itertools
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

from pyspark.ml.classification import DecisionTreeClassifier, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from prematch.operators import splits
from prematch.sources import tables

#: Above this the MLlib trees can't go.
DEEPEST = 30


@dataclass
class Preprocessor:
    """What was learnt from training rows: medians, means and deviations, modes, categories."""

    numeric: list[str]
    categorical: list[str]
    scale: bool = False
    medians: dict[str, float] = field(default_factory=dict)
    means: dict[str, float] = field(default_factory=dict)
    deviations: dict[str, float] = field(default_factory=dict)
    modes: dict[str, str] = field(default_factory=dict)
    categories: dict[str, list[str]] = field(default_factory=dict)

    def imputed(self, df: DataFrame) -> DataFrame:
        made = {c: F.coalesce(F.col(c).cast("double"), F.lit(self.medians[c])) for c in self.numeric}
        made |= {c: F.coalesce(F.col(c), F.lit(self.modes[c])) for c in self.categorical}
        return df.withColumns(made) if made else df

    def scaled(self, df: DataFrame) -> DataFrame:
        """Numeric columns imputed, centred and divided by the population deviation (1 where it is 0)."""
        made = {c: (F.coalesce(F.col(c).cast("double"), F.lit(self.medians[c])) - F.lit(self.means[c])) / F.lit(self.deviations[c] or 1.0) for c in self.numeric}
        return df.withColumns(made) if made else df

    def names(self) -> list[str]:
        """Names of the encoded features, in the vector's order."""
        return [*self.numeric, *[f"{c}_{v}" for c in self.categorical for v in self.categories[c]]]

    def encoded(self, df: DataFrame) -> dict[str, Column]:
        """One 0/1 column per known category; unknown values are all 0."""
        return {f"{c}_{v}": (F.coalesce(F.col(c), F.lit(self.modes[c])) == v).cast("double") for c in self.categorical for v in self.categories[c]}

    def transform(self, df: DataFrame, keep: list[str], subset: list[str] | None = None) -> DataFrame:
        """keep and a vector ``features`` of all encoded features, or of a subset."""
        base = self.scaled(df) if self.scale else self.imputed(df)
        hot = self.encoded(df)
        cols = [hot[n].alias(n) if n in hot else F.col(n).cast("double").alias(n) for n in (subset or self.names())]
        ready = base.select(*keep, *[c.alias(f"_f{i}") for i, c in enumerate(cols)])
        return VectorAssembler(inputCols=[f"_f{i}" for i in range(len(cols))], outputCol="features").transform(ready).select(*keep, "features")


#: Of the two-pass median: accuracy of the sketch that brackets it, and half the bracket's width in ranks.
_SKETCH, _HALF = 10_000, 2 / 10_000


def exact_medians(df: DataFrame, columns: list[str]) -> dict[str, float | None]:
    """The exact median of each column (null without a value), without holding all its values anywhere.

    A bounded sketch brackets each median; a second pass counts what lies below the bracket and
    ranks the distinct values inside it.  A bracket that misses its median is found out and replaced by an exact aggregate.
    """
    if not columns:
        return {}
    value = {c: F.nanvl(F.col(c).cast("double"), F.lit(None)) for c in columns}
    ends = F.array(F.lit(0.5 - _HALF), F.lit(0.5 + _HALF))
    sketch = df.agg(*[F.count(x).alias(f"n{i}") for i, x in enumerate(value.values())], *[F.percentile_approx(x, ends, _SKETCH).alias(f"e{i}") for i, x in enumerate(value.values())]).first()
    spans = {c: (sketch[f"n{i}"], *sketch[f"e{i}"]) for i, c in enumerate(columns) if sketch[f"n{i}"]}
    if not spans:
        return dict.fromkeys(columns)
    cells = F.array(*[F.struct(F.lit(c).alias("name"), F.when(value[c] < low, F.lit(float("-inf"))).when(value[c] <= high, value[c]).alias("value")) for c, (_, low, high) in spans.items()])
    counts = df.select(F.inline(cells)).where("value is not null").groupBy("name", "value").agg(F.count(F.lit(1)).alias("n"))
    upto = Window.partitionBy("name").orderBy("value").rowsBetween(Window.unboundedPreceding, 0)
    total = F.create_map(*[F.lit(x) for c, (n, _, _) in spans.items() for x in (c, n)])[F.col("name")]
    ranked = counts.select("name", "value", F.sum("n").over(upto).alias("upto"), total.alias("total"))
    # the ranks (total - 1) / 2, rounded down and up, from 0
    at = lambda rank: F.min(F.when(F.col("upto") > rank, F.col("value")))
    rows = ranked.groupBy("name").agg(at(F.expr("(total - 1) div 2")).alias("a"), at(F.expr("total div 2")).alias("b")).collect()
    found = {r["name"]: (r["a"] + r["b"]) / 2 for r in rows if r["a"] is not None and r["b"] is not None and r["a"] != float("-inf")}
    missed = [c for c in spans if c not in found]
    if missed:
        one = df.agg(*[F.median(value[c]).alias(c) for c in missed]).first()
        found |= {c: one[c] for c in missed}
    return {c: found.get(c) for c in columns}


def with_class_weights(labelled: DataFrame) -> DataFrame:
    """labelled with ``weight``: rows of every label weigh the same together, and all rows as much as there are."""
    counts = {r["label"]: r["n"] for r in labelled.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    weight = F.lit(1.0)
    for label, n in counts.items():
        weight = F.when(F.col("label") == label, F.lit(sum(counts.values()) / (len(counts) * n))).otherwise(weight)
    return labelled.withColumn("weight", weight)


def fit_preprocessor(train: DataFrame, numeric: list[str], categorical: list[str], scale: bool = False) -> Preprocessor:
    """Exact medians, population deviations and modes (ties: the smallest) of the training rows; columns without any value go.

    Categories are collected: a categorical feature is one whose values the
    model can hold (rare values are bucketed before).
    """
    medians = exact_medians(train, numeric)
    values: dict[str, list] = {c: [] for c in categorical}
    if categorical:
        cells = F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).cast("string").alias("value")) for c in categorical])
        counts = train.select(F.inline(cells)).where("value is not null").groupBy("name", "value").agg(F.count(F.lit(1)).alias("n"))
        for r in counts.orderBy("name", "value").collect():
            values[r["name"]].append((r["value"], r["n"]))
    made = Preprocessor([c for c in numeric if medians[c] is not None], [c for c in categorical if values[c]], scale)
    made.medians = {c: medians[c] for c in made.numeric}
    made.modes = {c: min(values[c], key=lambda x: (-x[1], x[0]))[0] for c in made.categorical}
    made.categories = {c: [v for v, _ in values[c]] for c in made.categorical}
    if scale and made.numeric:
        full = {c: F.coalesce(F.col(c).cast("double"), F.lit(made.medians[c])) for c in made.numeric}
        row = train.agg(*[F.avg(x).alias(f"m_{c}") for c, x in full.items()], *[F.stddev_pop(x).alias(f"s_{c}") for c, x in full.items()]).first()
        made.means, made.deviations = {c: row[f"m_{c}"] for c in full}, {c: row[f"s_{c}"] for c in full}
    return made


def accuracy(predicted: DataFrame, label: str, prediction: str = "prediction") -> float:
    return predicted.agg(F.avg((F.col(label).cast("double") == F.col(prediction).cast("double")).cast("double"))).first()[0] or 0.0


def confusion(predicted: DataFrame, label: str, prediction: str) -> DataFrame:
    """(label, prediction, n)."""
    return predicted.groupBy(F.col(label).alias("label"), F.col(prediction).alias("prediction")).agg(F.count(F.lit(1)).alias("n"))


def classification_report(predicted: DataFrame, label: str, prediction: str) -> DataFrame:
    """(label, precision, recall, f1, support) of every label that occurs or is predicted."""
    cells = confusion(predicted, label, prediction)
    parts = cells.select(F.explode(F.array(F.struct(F.col("label").alias("k"), F.col("n").alias("true"), F.lit(0).cast("long").alias("said")), F.struct(F.col("prediction").alias("k"), F.lit(0).cast("long").alias("true"), F.col("n").alias("said")))).alias("p"), F.when(F.col("label") == F.col("prediction"), F.col("n")).otherwise(0).alias("hit"))
    by = parts.groupBy(F.col("p.k").alias("label")).agg(F.sum("p.true").alias("support"), F.sum("p.said").alias("said"), (F.sum("hit") / 2).alias("hit"))
    p, r = F.coalesce(F.try_divide("hit", "said"), F.lit(0.0)), F.coalesce(F.try_divide("hit", "support"), F.lit(0.0))
    return by.select("label", p.alias("precision"), r.alias("recall"), F.coalesce(F.try_divide(2 * p * r, p + r), F.lit(0.0)).alias("f1"), "support")


# --- forests ---------------------------------------------------------------------------


def forest(trees: int = 250, depth: int | None = None, least_leaf: int = 2, seed: int = 42) -> RandomForestClassifier:
    return RandomForestClassifier(labelCol="label", weightCol="weight", numTrees=trees, maxDepth=min(depth or DEEPEST, DEEPEST), minInstancesPerNode=least_leaf, seed=seed, maxBins=64)


def row_cv(rows: DataFrame, row_id: str, numeric: list[str], categorical: list[str], target: str, model: RandomForestClassifier, folds: int | None = None) -> list[float]:
    """Accuracy of each fold by row; the preprocessor is fitted on the fold's training rows."""
    n = rows.count()
    scores = []
    for first, end in splits.row_splits(n, folds or splits.split_count(n)):
        train, test = rows.where(F.col(row_id) < first), rows.where((F.col(row_id) >= first) & (F.col(row_id) < end))
        prep = fit_preprocessor(train, numeric, categorical)
        fitted = model.fit(prep.transform(with_class_weights(train.withColumn("label", F.col(target).cast("double"))), ["label", "weight"]))
        scores.append(accuracy(fitted.transform(prep.transform(test.withColumn("label", F.col(target).cast("double")), ["label"])), "label"))
    return scores


def baseline_forest(rows: DataFrame, row_id: str, numeric: list[str], categorical: list[str], target: str, trees: int = 250, depth: int | None = None, folds: int | None = None) -> dict:
    """Cross-validated accuracy (mean and population deviation) and accuracy on the training rows."""
    model = forest(trees, depth)
    scores = row_cv(rows, row_id, numeric, categorical, target, model, folds)
    prep = fit_preprocessor(rows, numeric, categorical)
    ready = prep.transform(with_class_weights(rows.withColumn("label", F.col(target).cast("double"))), ["label", "weight"]).persist()
    try:
        train = accuracy(model.fit(ready).transform(ready), "label")
    finally:
        ready.unpersist()
    mean = sum(scores) / len(scores)
    return {"cv_scores": scores, "cv_mean": mean, "cv_std": (sum((s - mean) ** 2 for s in scores) / len(scores)) ** 0.5, "train_accuracy": train}


def eliminate_features(rows: DataFrame, row_id: str, numeric: list[str], categorical: list[str], target: str, step: int = 1, least: int = 8, trees: int = 100, depth: int = 12, folds: int | None = None) -> dict:
    """Recursive elimination with cross-validation: per fold, drop the ``step`` least important features again and again;
    the size with the best mean accuracy wins (the smallest of equals), and a last elimination on all rows names the features.

    The preprocessor is fitted once, on all rows, before the folds.
    """
    prep = fit_preprocessor(rows, numeric, categorical)
    names = prep.names()
    least = min(least, max(1, len(names) - 1))
    n = rows.count()
    model = forest(trees, depth)
    labelled = rows.withColumn("label", F.col(target).cast("double"))

    def path(train: DataFrame, test: DataFrame | None, stop: int) -> tuple[dict[int, float], list[str]]:
        kept, scores = list(names), {}
        train = with_class_weights(train)
        while True:
            ready = prep.transform(train, ["label", "weight"], kept).persist()
            try:
                fitted = model.fit(ready)
            finally:
                ready.unpersist()
            if test is not None:
                scores[len(kept)] = accuracy(fitted.transform(prep.transform(test, ["label"], kept)), "label")
            if len(kept) <= stop:
                return scores, kept
            weights = fitted.featureImportances.toArray()
            order = sorted(range(len(kept)), key=lambda i: (weights[i], -i))
            drop = set(order[: min(step, len(kept) - stop)])
            kept = [k for i, k in enumerate(kept) if i not in drop]

    totals: dict[int, list[float]] = {}
    for first, end in splits.row_splits(n, folds or splits.split_count(n)):
        train, test = labelled.where(F.col(row_id) < first), labelled.where((F.col(row_id) >= first) & (F.col(row_id) < end))
        for size, score in path(train, test, least)[0].items():
            totals.setdefault(size, []).append(score)
    means = {size: sum(v) / len(v) for size, v in totals.items()}
    best = min(means, key=lambda s: (-means[s], s))
    return {"n_features": len(names), "n_selected": best, "cv_means": dict(sorted(means.items())), "best_cv": means[best], "selected": path(labelled, None, best)[1]}


# --- one tree, pruned ---------------------------------------------------------------------


@dataclass
class Node:
    counts: list[float]
    feature: int = -1
    threshold: float = 0.0
    left: "Node | None" = None
    right: "Node | None" = None

    @property
    def n(self) -> float:
        return sum(self.counts)

    @property
    def value(self) -> float:
        return float(max(range(len(self.counts)), key=lambda i: (self.counts[i], -i)))

    @property
    def gini(self) -> float:
        return 1.0 - sum((c / self.n) ** 2 for c in self.counts) if self.n else 0.0

    def leaves(self) -> int:
        return 1 if self.left is None else self.left.leaves() + self.right.leaves()

    def depth(self) -> int:
        return 0 if self.left is None else 1 + max(self.left.depth(), self.right.depth())

    def make_leaf(self) -> None:
        self.left = self.right = None


def node_tree(fitted) -> Node:
    """The nodes of an MLlib decision tree model as plain objects."""

    def walk(j) -> Node:
        stats = [float(x) for x in j.impurityStats().stats()]
        if j.subtreeDepth() == 0:
            return Node(stats)
        split = j.split()
        return Node(stats, split.featureIndex(), float(split.threshold()), walk(j.leftChild()), walk(j.rightChild()))

    return walk(fitted._java_obj.rootNode())


def require_split(node: Node, least: int) -> Node:
    """Nodes of fewer than ``least`` rows become leaves."""
    if node.left is not None:
        if node.n < least:
            node.make_leaf()
        else:
            require_split(node.left, least)
            require_split(node.right, least)
    return node


def prune(root: Node, alpha: float) -> Node:
    """Weakest-link pruning: collapse the split that gains least per leaf, as long as that is not above alpha."""
    total = root.n or 1.0

    def risk(node: Node) -> float:
        return node.gini * node.n / total

    def below(node: Node) -> float:
        return risk(node) if node.left is None else below(node.left) + below(node.right)

    def links(node: Node):
        if node.left is not None:
            yield (risk(node) - below(node)) / (node.leaves() - 1), node
            yield from links(node.left)
            yield from links(node.right)

    while root.left is not None and alpha > 0:
        weakest, node = min(links(root), key=lambda x: x[0])
        if weakest > alpha:
            break
        node.make_leaf()
    return root


def predict(node: Node, features: Column) -> Column:
    """A nested expression over an array column: the tree runs inside the JVM."""
    if node.left is None:
        return F.lit(node.value)
    return F.when(features[node.feature] <= node.threshold, predict(node.left, features)).otherwise(predict(node.right, features))


def importances(root: Node, names: list[str]) -> dict[str, float]:
    """Share of the impurity decrease by feature, the largest first."""
    gain = [0.0] * len(names)

    def walk(node: Node) -> None:
        if node.left is not None:
            gain[node.feature] += node.n * node.gini - node.left.n * node.left.gini - node.right.n * node.right.gini
            walk(node.left)
            walk(node.right)

    walk(root)
    total = sum(gain) or 1.0
    return dict(sorted(((n, g / total) for n, g in zip(names, gain)), key=lambda x: (-x[1], x[0])))


def tree_text(node: Node, names: list[str], most_depth: int = 3, level: int = 0) -> str:
    """The tree as indented text down to a depth."""
    pad = "|   " * level
    if node.left is None:
        return f"{pad}class: {node.value:g}\n"
    if level >= most_depth:
        return f"{pad}... {node.leaves()} leaves\n"
    name = names[node.feature]
    return f"{pad}{name} <= {node.threshold:.2f}\n" + tree_text(node.left, names, most_depth, level + 1) + f"{pad}{name} > {node.threshold:.2f}\n" + tree_text(node.right, names, most_depth, level + 1)


# The grid of the search.
GRID = {"max_depth": [4, 6, 8, 10, 12, None], "min_samples_leaf": [1, 5, 20, 50], "min_samples_split": [2, 20, 50], "ccp_alpha": [0.0, 0.0005, 0.001, 0.005]}


def _grown(ready: DataFrame, depth: int | None, leaf: int) -> Node:
    return node_tree(DecisionTreeClassifier(labelCol="label", impurity="gini", seed=42, maxBins=256, maxDepth=min(depth or DEEPEST, DEEPEST), minInstancesPerNode=leaf).fit(ready))


def _copy(node: Node | None) -> Node | None:
    return None if node is None else Node(list(node.counts), node.feature, node.threshold, _copy(node.left), _copy(node.right))


def search_tree(df: DataFrame, date: str, numeric: list[str], categorical: list[str], target: str, holdout_fraction: float = 0.15, folds: int = 5, grid: dict | None = None, parallel: int = 4) -> dict:
    """Grid search over date folds, refit on all training dates, evaluation on the held-out ones.

    Depth and leaf size grow a tree each; split size and pruning strength are
    applied to it afterwards, so a grid of 288 combinations grows 24 trees per fold.
    All variants of a tree are scored in one pass over the test rows.  Of equal
    means the first combination in grid order wins.
    """
    grid = grid or GRID
    train, held = splits.holdout(df.withColumn("label", F.col(target).cast("double")), date, holdout_fraction)
    chunked = splits.date_folds(train, date, folds)
    grown = list(itertools.product(grid["max_depth"], grid["min_samples_leaf"]))
    cuts = list(itertools.product(grid["min_samples_split"], grid["ccp_alpha"]))
    scores: dict[tuple, list[float]] = {}
    for f in range(1, folds + 1):
        a, b = splits.fold(chunked, f)
        prep = fit_preprocessor(a, numeric, categorical)
        ready, test = prep.transform(a, ["label"]).persist(), prep.transform(b, ["label"]).withColumn("x", vector_to_array("features")).select("label", "x").persist()

        def run(option: tuple) -> list[tuple[tuple, float]]:
            root = _grown(ready, *option)
            variants = [prune(require_split(_copy(root), s), c) for s, c in cuts]
            row = test.agg(*[F.avg((F.col("label") == predict(v, F.col("x"))).cast("double")).alias(str(i)) for i, v in enumerate(variants)]).first()
            return [((*option, *cut), row[str(i)] or 0.0) for i, cut in enumerate(cuts)]

        try:
            with ThreadPoolExecutor(parallel) as pool:
                for found in pool.map(run, grown):
                    for key, score in found:
                        scores.setdefault(key, []).append(score)
        finally:
            ready.unpersist()
            test.unpersist()
    order = list(itertools.product(grid["max_depth"], grid["min_samples_leaf"], grid["min_samples_split"], grid["ccp_alpha"]))
    means = {k: sum(v) / len(v) for k, v in scores.items()}
    best = max(order, key=lambda k: means[k])  # max keeps the first of equals
    prep = fit_preprocessor(train, numeric, categorical)
    root = prune(require_split(_grown(prep.transform(train, ["label"]), best[0], best[1]), best[2]), best[3])
    judged = prep.transform(held, ["label"]).withColumn("x", vector_to_array("features")).select("label", predict(root, F.col("x")).alias("prediction"))
    names = prep.names()
    return {
        "best_params": dict(zip(grid, best)),
        "best_cv_accuracy": means[best],
        "holdout_accuracy": accuracy(judged, "label"),
        "confusion": {f"{int(r['label'])}->{int(r['prediction'])}": r["n"] for r in confusion(judged, "label", "prediction").collect()},
        "depth": root.depth(),
        "leaves": root.leaves(),
        "importances": importances(root, names),
        "text": tree_text(root, names),
    }


def save_metrics(metrics: dict, path: str) -> None:
    tables.write_json(metrics, path)
