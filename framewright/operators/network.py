"""A feed-forward network over feature rows: weights as literals or numpy arrays, forward pass and training."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from framewright.functions.arrays import dot, softmax


#: Tasks that add up the rows of all others, and their rows.
FAN, SUMS = 16, "k int, v binary, loss double, n long, right long"


def integer_weights(rows: int, columns: int) -> list[list[float]]:
    """Reproducible weights that any engine can build."""
    return [[(((i * i * 7 + i * 13 + j * j * 5 + j * 11 + 3) % 101) - 50) / 100.0 for j in range(1, columns + 1)] for i in range(1, rows + 1)]


def layer(x: Column, weights: list[list[float]]) -> Column:
    return F.array(*[dot(x, F.array(*map(F.lit, r))) for r in weights])


def forward(df: DataFrame, hidden: list[list[float]], out: list[list[float]]) -> DataFrame:
    """Adds `p`: softmax(out * sigmoid(hidden * features)); batches go through numpy."""
    w1, w2 = np.array(hidden).T, np.array(out).T

    @F.pandas_udf("array<double>")
    def run(features: pd.Series) -> pd.Series:
        if not len(features):
            return pd.Series([], dtype=object)
        x = np.stack(features.to_numpy()).astype(np.float64)
        z = (1 / (1 + np.exp(-(x @ w1)))) @ w2
        e = np.exp(z - z.max(axis=1, keepdims=True))
        return pd.Series(list(e / e.sum(axis=1, keepdims=True)))

    return df.withColumn("p", run("features"))


def forward_layers(df: DataFrame, layers: list[list[list[float]]], out: str = "p", features: str = "features") -> DataFrame:
    """Adds `out`: softmax of the last of any number of layers, sigmoids between them; batches go through numpy."""
    weights = [np.array(w).T for w in layers]

    @F.pandas_udf("array<double>")
    def run(rows: pd.Series) -> pd.Series:
        if not len(rows):
            return pd.Series([], dtype=object)
        x = np.stack(rows.to_numpy()).astype(np.float64)
        for w in weights[:-1]:
            x = 1 / (1 + np.exp(-(x @ w)))
        z = x @ weights[-1]
        e = np.exp(z - z.max(axis=1, keepdims=True))
        return pd.Series(list(e / e.sum(axis=1, keepdims=True)))

    return df.withColumn(out, run(features))


def backward(weights: list[np.ndarray], x: np.ndarray, target: np.ndarray) -> tuple[list[np.ndarray], float, np.ndarray]:
    """Summed gradients of the cross-entropy of softmax outputs against target rows (rows x classes), its sum, and the outputs; in the weights' own precision."""
    states = [x]
    for w in weights[:-1]:
        states.append(1 / (1 + np.exp(-(states[-1] @ w))))
    z = states[-1] @ weights[-1]
    z -= z.max(axis=1, keepdims=True)
    p = np.exp(z)
    p /= p.sum(axis=1, keepdims=True)
    loss = -float((target * np.log(np.maximum(p, np.finfo(p.dtype).tiny))).sum(dtype=np.float64))
    d, out = p - target, [np.empty(0)] * len(weights)
    for k in range(len(weights) - 1, -1, -1):
        out[k] = states[k].T @ d
        if k:
            d = d @ weights[k].T * states[k] * (1 - states[k])
    return out, loss, p


def targets(batch: pd.DataFrame, classes: int, dtype) -> np.ndarray:
    """Rows of class probabilities: those of `target` where the batch has them, else one at the label."""
    if "target" in batch:
        return np.stack(batch["target"].to_numpy()).astype(dtype)
    return np.eye(classes, dtype=dtype)[batch["label"].to_numpy()]


def training_rows(df: DataFrame) -> DataFrame:
    return df.select("features", F.col("label").cast("int").alias("label"), *(["target"] if "target" in df.columns else []))


def added(rows: DataFrame, shapes: list[tuple[int, int]]) -> tuple[list[np.ndarray], float, int, int]:
    """The sums of rows (k, v, loss, n, right), v the bytes of a vector, in the order of k: added up in a few tasks and then in one, so the driver sees one row."""
    size = sum(a * b for a, b in shapes)

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, loss, n, right = np.zeros(size), 0.0, 0, 0
        for batch in batches:
            for v in batch["v"]:
                total += np.frombuffer(v)
            loss, n, right = loss + sum(batch["loss"]), n + int(batch["n"].sum()), right + int(batch["right"].sum())
        yield pd.DataFrame({"k": [0], "v": [total.tobytes()], "loss": [loss], "n": [n], "right": [right]})

    few = rows.repartition(FAN, "k").sortWithinPartitions("k").mapInPandas(add, SUMS)
    last = few.coalesce(1).mapInPandas(add, SUMS).first()
    flat, out, at = np.frombuffer(last["v"]), [], 0
    for s in shapes:
        out.append(flat[at : at + s[0] * s[1]].reshape(s))
        at += s[0] * s[1]
    return out, float(last["loss"]), int(last["n"]), int(last["right"])


def gradients(df: DataFrame, weights: list[np.ndarray], dtype=np.float32) -> tuple[list[np.ndarray], float, int, int]:
    """Summed gradients of the cross-entropy of (features, label; or target, class probabilities), its sum, rows, and rows right.

    Products are in `dtype`, sums over batches in double; a task gives one row."""
    shapes, classes = [w.shape for w in weights], weights[-1].shape[1]
    narrow = [w.astype(dtype) for w in weights]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, loss, n, right = np.zeros(sum(a * b for a, b in shapes)), 0.0, 0, 0
        for batch in batches:
            if not len(batch):
                continue
            t = targets(batch, classes, dtype)
            g, own, p = backward(narrow, np.stack(batch["features"].to_numpy()).astype(dtype), t)
            total += np.concatenate([x.ravel() for x in g])
            loss, n, right = loss + own, n + len(batch), right + int((p.argmax(axis=1) == t.argmax(axis=1)).sum())
        yield pd.DataFrame({"k": [TaskContext.get().partitionId()], "v": [total.tobytes()], "loss": [loss], "n": [n], "right": [right]})

    return added(training_rows(df).mapInPandas(run, SUMS), shapes)


def bunches(df: DataFrame, weights: list[np.ndarray], rate: float, bunch: int, dtype=np.float32) -> tuple[list[np.ndarray], float, int]:
    """Weights after one pass in which each task updates its own copy after every `bunch` rows, the copies averaged by the rows that each has seen; the loss before each update, summed, and the rows."""
    shapes, classes = [w.shape for w in weights], weights[-1].shape[1]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own, loss, n, right = [w.astype(dtype) for w in weights], 0.0, 0, 0
        for batch in batches:
            if not len(batch):
                continue
            x, t = np.stack(batch["features"].to_numpy()).astype(dtype), targets(batch, classes, dtype)
            for i in range(0, len(x), bunch):
                g, part, p = backward(own, x[i : i + bunch], t[i : i + bunch])
                for w, d in zip(own, g, strict=True):
                    w -= dtype(rate / len(p)) * d
                loss, right = loss + part, right + int((p.argmax(axis=1) == t[i : i + bunch].argmax(axis=1)).sum())
            n += len(x)
        copies = n * np.concatenate([w.ravel() for w in own]).astype(np.float64)
        yield pd.DataFrame({"k": [TaskContext.get().partitionId()], "v": [copies.tobytes()], "loss": [loss], "n": [n], "right": [right]})

    total, loss, n, _ = added(training_rows(df).mapInPandas(run, SUMS), shapes)
    return ([w / n for w in total] if n else [w.copy() for w in weights]), loss, n


EPOCH = "epoch int, rate double, loss double, accuracy double, layer int, rows int, columns int, weights binary"


def stored(spark: SparkSession, folder: str, epoch: int, rate: float, loss: float, accuracy: float, weights: list[np.ndarray]) -> None:
    """A row for each layer, in a folder of the epoch's own; Spark's commit makes it whole or absent."""
    rows = [(epoch, rate, loss, accuracy, k, *w.shape, np.ascontiguousarray(w, np.float64).tobytes()) for k, w in enumerate(weights)]
    spark.createDataFrame(rows, EPOCH).coalesce(1).write.mode("overwrite").parquet(f"{folder}/epoch={epoch:05d}")


def restored(spark: SparkSession, folder: str) -> list[tuple[int, float, float, float, list[np.ndarray]]]:
    """(epoch, rate, loss, accuracy, weights) of every stored epoch, in order; none where the folder isn't there.  A row for each layer and epoch."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return []
    rows = spark.read.schema(EPOCH).parquet(folder).where("weights IS NOT NULL").collect()
    epochs: dict[int, list] = {}
    for r in sorted(rows, key=lambda r: (r["epoch"], r["layer"])):
        epochs.setdefault(r["epoch"], []).append(r)
    return [(e, x[0]["rate"], x[0]["loss"], x[0]["accuracy"], [np.frombuffer(r["weights"]).reshape(r["rows"], r["columns"]).copy() for r in x]) for e, x in sorted(epochs.items())]


def train_in_bunches(df: DataFrame, hidden: list[int], classes: int, held_out: DataFrame, folder: str, seed: int = 1, epochs: int = 20, rate: float = 1.0, bunch: int = 64) -> tuple[list[np.ndarray], list[dict]]:
    """Weights of a network (features, and label or target) and what each epoch saw, with every epoch stored under `folder`.

    Called again with a folder that holds epochs it goes on after the last of them, to the same weights as without the break: rows
    should be stored in order and partitions (`df` read from a table), as a task's updates follow its rows.  Targets are soft where df
    has a column `target` of class probabilities.  The rate follows `schedule`."""
    spark = df.sparkSession
    done = restored(spark, folder)
    if done:
        weights = done[-1][4]
    else:
        width = df.select(F.size("features").alias("w")).agg(F.max("w")).first()[0] or 0
        rng = np.random.default_rng(seed)
        sizes = [width, *hidden, classes]
        weights = [rng.standard_normal((a, b)) / np.sqrt(max(a, 1)) for a, b in zip(sizes, sizes[1:])]
    seen = [{"epoch": e, "rate": r, "loss": loss, "accuracy": a} for e, r, loss, a, _ in done]
    for epoch in range(len(seen), epochs):
        accuracies = [0.0, *[s["accuracy"] for s in seen]]
        now = schedule(rate, [b - a for a, b in zip(accuracies, accuracies[1:])])
        weights, _, _ = bunches(df, weights, now, bunch)
        _, loss, m, right = gradients(held_out, weights)
        seen.append({"epoch": epoch, "rate": now, "loss": loss / max(m, 1), "accuracy": right / max(m, 1)})
        stored(spark, folder, epoch, now, seen[-1]["loss"], seen[-1]["accuracy"], weights)
    return weights, seen


def schedule(rate: float, gains: list[float], least: float = 0.005, ramp: float = 0.5) -> float:
    """The next epoch's rate: as it is while the last epoch gained at least `least` of accuracy, then ramped down for good."""
    return rate if all(g >= least for g in gains) else rate * ramp ** sum(1 for k in range(len(gains)) if any(g < least for g in gains[: k + 1]))


def train(df: DataFrame, hidden: list[int], classes: int, held_out: DataFrame, seed: int = 1, epochs: int = 20, rate: float = 1.0) -> tuple[list[np.ndarray], list[dict]]:
    """Weights of a network (features, label) by full-batch descent, and what each epoch saw: rate, loss and accuracy of the held-out frames.

    Gradients are summed by the tasks; the driver holds the weights.  The data are read once an epoch: store them first."""
    width = df.select(F.size("features").alias("w")).agg(F.max("w")).first()[0]
    rng = np.random.default_rng(seed)
    sizes = [width, *hidden, classes]
    weights = [rng.standard_normal((a, b)) / np.sqrt(a) for a, b in zip(sizes, sizes[1:])]
    seen, gains, last = [], [], 0.0
    for _ in range(epochs):
        now = schedule(rate, gains)
        g, _, n, _ = gradients(df, weights)
        weights = [w - now * x / max(n, 1) for w, x in zip(weights, g, strict=True)]
        _, loss, m, right = gradients(held_out, weights)
        gains.append(right / max(m, 1) - last)
        last = right / max(m, 1)
        seen.append({"rate": now, "loss": loss / max(m, 1), "accuracy": last})
    return weights, seen


__all__ = ["bunches", "forward", "forward_layers", "gradients", "integer_weights", "layer", "schedule", "softmax", "train", "train_in_bunches"]
