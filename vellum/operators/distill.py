"""Logistic-regression heads that stand in for judgments, and their evaluation."""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellum.operators import metrics, sampling


def judged(works: DataFrame, abstracts: DataFrame, source: str, least_chars: int = 50, most_chars: int = 4000) -> DataFrame:
    """work_id, relevance, domain, text of the works that a model with this name judged."""
    usable = works.filter(F.col("label_source").startswith(source) & F.col("relevance").isNotNull())
    joined = usable.join(abstracts.filter(F.length("abstract") > least_chars).select("work_id", "abstract"), "work_id")
    return joined.select("work_id", "relevance", F.coalesce("domain", F.lit("other-medical")).alias("domain"), F.concat_ws("\n\n", "title", F.substring("abstract", 1, most_chars)).alias("text"))


def fit(rows: DataFrame, label: str = "truth", vector: str = "embedding", c: float = 1.0, iterations: int = 200) -> LogisticRegressionModel:
    """L2-regularised with strength 1 / (c * rows), intercept free, features as they are."""
    data = rows.select(F.col(label).cast("double").alias("label"), array_to_vector(F.col(vector).cast("array<double>")).alias("features"))
    return LogisticRegression(regParam=1.0 / (c * max(rows.count(), 1)), standardization=False, maxIter=iterations).fit(data)


def apply(model: LogisticRegressionModel, rows: DataFrame, vector: str = "embedding") -> DataFrame:
    """rows with prob (of class 1) and pred."""
    scored = model.transform(rows.withColumn("features", array_to_vector(F.col(vector).cast("array<double>"))))
    p = vector_to_array("probability")
    return scored.withColumn("prob", F.round(F.element_at(p, 2), 6)).withColumn("pred", F.col("prediction").cast("int")).drop("features", "probability", "rawPrediction", "prediction")


def task(rows: DataFrame, key: str, seed: int = 7, vector: str = "embedding") -> dict[str, DataFrame]:
    """Held-out evaluation of one binary task: summary, per_class, thresholds."""
    marked = sampling.split(rows, "truth", key, seed=seed)
    test = apply(fit(marked.filter("not is_test"), vector=vector), marked.filter("is_test"), vector).persist()
    base = test.groupBy("truth").count().agg((F.max("count") / F.sum("count")).alias("majority"))
    summary = test.agg(F.count("*").alias("n"), F.avg((F.col("truth") == F.col("pred")).cast("int")).alias("accuracy")).crossJoin(base).crossJoin(metrics.roc_auc(test.withColumn("score", F.col("prob"))))
    return {"summary": summary, "per_class": metrics.per_class(test), "thresholds": metrics.thresholds(test), "predictions": test}


def pilot(rows: DataFrame, key: str, seed: int = 7, vector: str = "embedding") -> list[dict]:
    """task, n, accuracy, majority, auc of three tasks: relevance of 5 or more, of 7 or more, and each domain against the rest."""
    tasks = {f"relevance>={r}": F.col("relevance") >= r for r in (5, 7)}
    tasks |= {f"domain={d[0]}": F.col("domain") == d[0] for d in rows.select("domain").distinct().orderBy("domain").collect() if d[0] is not None}  # a closed vocabulary
    out = []
    for name, truth in tasks.items():
        marked = rows.filter(truth.isNotNull()).withColumn("truth", truth.cast("int"))
        if marked.select("truth").distinct().count() > 1:
            s = task(marked, key, seed, vector)["summary"].first().asDict()
            out.append({"task": name} | {k: float(s[k]) for k in ("n", "accuracy", "majority", "auc") if s.get(k) is not None})
    return out


def learning_curve(rows: DataFrame, key: str, sizes: list[int], repeats: int = 3, seed: int = 7, vector: str = "embedding") -> list[dict[str, float]]:
    """Mean and spread of accuracy, mean AUC, for growing training sets (a few fits, each distributed)."""
    out = []
    for n in sizes:
        acc, auc = [], []
        for r in range(repeats):
            marked = sampling.split(rows, "truth", key, seed=seed + r)
            train = marked.filter("not is_test").orderBy(sampling.draw(seed + 100 + r, key)).limit(n)
            if train.select("truth").distinct().count() < 2:
                continue
            test = apply(fit(train, vector=vector), marked.filter("is_test"), vector)
            acc.append(test.agg(F.avg((F.col("truth") == F.col("pred")).cast("int"))).first()[0])
            auc.append(metrics.roc_auc(test.withColumn("score", F.col("prob"))).first()[0])
        if acc:
            out.append({"n": n, "accuracy": sum(acc) / len(acc), "spread": max(acc) - min(acc), "auc": sum(auc) / len(auc)})
    return out
