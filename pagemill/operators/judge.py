"""Deciding whether a page is a target: trees, confidence, routes, human labels, the review queue."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagemill.functions.scalars import NO, TARGETS

CONFIDENCE = 70.0
#: Every leaf of the tree holds ten rows at least; a node is split if it has twenty, which that implies.
MIN_LEAF = 10
MAX_DEPTH = 30
#: Distinct rows that one task of a fit holds.
PART_ROWS = 20_000


@dataclass
class Judge:
    """A fitted tree with its feature columns."""

    model: object
    columns: list[str]

    def judged(self, df: DataFrame) -> DataFrame:
        """``df`` with decision and confidence, 100 times the largest class probability."""
        from pyspark.ml.feature import IndexToString
        from pyspark.ml.functions import vector_to_array

        labels = self.model.stages[0].labelsArray[0]
        own = [c for c in df.columns if c not in ("__label", "__index", "__features", "rawPrediction", "probability", "prediction")]
        scored = df
        for stage in self.model.stages[1:]:  # rows to be judged have no label: the first stage only keeps the list of labels
            scored = stage.transform(scored)
        named = IndexToString(inputCol="prediction", outputCol="__decision", labels=list(labels)).transform(scored)
        return named.select(
            *own, F.col("__decision").cast("int").alias("decision"), (100 * F.array_max(vector_to_array("probability"))).alias("confidence")
        )

    def save(self, path: str) -> None:
        self.model.write().overwrite().save(path)

    def text(self) -> str:
        """The tree's branches, readable."""
        return self.model.stages[-1].toDebugString

    def dot(self) -> str:
        """The tree as a picture's source, in the DOT language."""
        tree, made = self.model.stages[-1]._java_obj.rootNode(), []
        labels = self.model.stages[0].labelsArray[0]

        def add(node) -> int:
            number = len(made)
            made.append("")
            leaf = node.getClass().getSimpleName() == "LeafNode"
            if leaf:
                made[number] = f'  n{number} [shape=box, label="{labels[int(node.prediction())]}"];'
            else:
                split = node.split()
                kind = f"<= {split.threshold():g}" if split.getClass().getSimpleName() == "ContinuousSplit" else "in set"
                left, right = add(node.leftChild()), add(node.rightChild())
                made[number] = f'  n{number} [label="{self.columns[split.featureIndex()]} {kind}"];\n  n{number} -> n{left} [label=yes];\n  n{number} -> n{right} [label=no];'
            return number

        add(tree)
        return "digraph tree {\n" + "\n".join(made) + "\n}\n"

    @staticmethod
    def load(path: str) -> Judge:
        from pyspark.ml import PipelineModel

        model = PipelineModel.load(path)
        return Judge(model, model.stages[1].getInputCols())


def learn(
    training: DataFrame, columns: list[str], label: str = "label", min_leaf: int = MIN_LEAF, impurity: str = "entropy", depth: int = MAX_DEPTH, seed: int = 7, weight: str | None = None
) -> Judge | None:
    """A decision tree on all labelled rows; None without any. ``weight``: a column that says how many rows one stands for.

    Equal rows are counted once and weigh what they are: the tree is the same, and its passes, one for each level, are
    over the distinct rows.
    """
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import DecisionTreeClassifier
    from pyspark.ml.feature import StringIndexer, VectorAssembler

    rows = training.filter(F.col(label).isNotNull()).groupBy(F.col(label).cast("int").cast("string").alias("__label"), *columns)
    rows = rows.agg((F.count("*") if weight is None else F.sum(weight)).cast("double").alias("__weight")).persist()
    n, total = rows.agg(F.count("*"), F.sum("__weight")).first()
    if not n:
        rows.unpersist()
        return None
    # The least weight of a leaf is given as a share; half a row less, so that rounding is no matter.
    splits = 2 * min_leaf <= total
    stages = [
        StringIndexer(inputCol="__label", outputCol="__index", stringOrderType="alphabetAsc", handleInvalid="keep"),
        VectorAssembler(inputCols=columns, outputCol="__features", handleInvalid="keep"),
        DecisionTreeClassifier(
            labelCol="__index", featuresCol="__features", weightCol="__weight", impurity=impurity, maxDepth=depth if splits else 0, minInstancesPerNode=1,
            minWeightFractionPerNode=(min_leaf - 0.5) / total if splits else 0.0, seed=seed,
        ),
    ]
    model = Pipeline(stages=stages).fit(rows.coalesce(-(-n // PART_ROWS)))
    rows.unpersist()
    return Judge(model, columns)


def judged(df: DataFrame, judge: Judge | None) -> DataFrame:
    """Without a model: no target, at confidence 0."""
    return df.withColumns({"decision": F.lit(NO), "confidence": F.lit(0.0)}) if judge is None else judge.judged(df)


def route(decision: Column, confidence: Column, least: float = CONFIDENCE) -> Column:
    """extract or discard if surer than ``least`` per cent (not as sure), review otherwise."""
    return F.when(confidence > least, F.when(decision.isin(*TARGETS), "extract").otherwise("discard")).otherwise("review")


def with_human(predictions: DataFrame, labels: DataFrame, key: str = "id") -> DataFrame:
    """Human decisions (key, label) take the place of the model's, at confidence 100."""
    own = labels.select(F.col(key).alias("__key"), F.col("label").cast("int").alias("__human"))
    both = predictions.join(own, F.col(key) == F.col("__key"), "left")
    return both.withColumns({
        "decision": F.coalesce("__human", "decision"), "confidence": F.when(F.col("__human").isNotNull(), F.lit(100.0)).otherwise(F.col("confidence")),
    }).drop("__key", "__human")


def queue_rows(judged_pages: DataFrame, features: Column) -> DataFrame:
    """Rows of the review queue. Confidence is rounded when a page is queued first."""
    waiting = judged_pages.filter(route(F.col("decision"), F.col("confidence")) == "review")
    return waiting.select("id", "title", "url", "filename", F.round("confidence", 2).alias("confidence"), "decision", features.alias("feature"))


def refreshed(queue: DataFrame, judge: Judge | None, columns: list[str]) -> DataFrame:
    """The queue judged anew, with route; confidence is not rounded now. ``columns``: f_<id>, read from the map feature."""
    spread = queue.drop("decision", "confidence").withColumns({c: F.col("feature")[c[2:]].cast("double") for c in columns})
    out = judged(spread, judge).drop(*columns)
    return out.withColumn("route", route(F.col("decision"), F.col("confidence")))
