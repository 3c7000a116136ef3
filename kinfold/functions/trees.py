"""Scores of boosted trees from their JSON dumps: a list of trees, nested by "children", numbers as 32-bit floats."""

import hashlib
import json
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import FEATURES


@dataclass
class Trees:
    """All nodes of all trees, end to end. Leaves have feature -1 and their value as threshold."""

    roots: np.ndarray
    feature: np.ndarray
    threshold: np.ndarray
    yes: np.ndarray
    no: np.ndarray
    missing: np.ndarray
    base: float = 0.0

    @classmethod
    def parse(cls, dump: str | list, base_score: float = 0.5, names: tuple[str, ...] = FEATURES) -> "Trees":
        trees = json.loads(dump) if isinstance(dump, str) else dump
        places = {n: i for i, n in enumerate(names)} | {f"f{i}": i for i in range(len(names))}
        nodes: list[list] = []

        def add(node: dict) -> int:
            at = len(nodes)
            nodes.append([-1, node.get("leaf", 0.0), at, at, at])
            if "leaf" not in node:
                child = {c["nodeid"]: add(c) for c in node["children"]}
                nodes[at] = [places[node["split"]], node["split_condition"], child[node["yes"]], child[node["no"]], child[node.get("missing", node["yes"])]]
            return at

        roots = [add(t) for t in trees]
        columns = list(zip(*nodes)) if nodes else [[]] * 5
        ints = [np.array(columns[i], dtype=np.int64) for i in (0, 2, 3, 4)]
        return cls(np.array(roots, dtype=np.int64), ints[0], np.array(columns[1], dtype=np.float32), ints[1], ints[2], ints[3], float(np.log(base_score / (1 - base_score))))

    def predict(self, x: np.ndarray) -> np.ndarray:
        """Probabilities of the rows of a float32 matrix; NaN is missing."""
        total = np.full(len(x), np.float32(self.base), dtype=np.float32)
        rows = np.arange(len(x))
        for root in self.roots:
            at = np.full(len(x), root)
            while (inner := self.feature[at] >= 0).any():
                value = x[rows, np.maximum(self.feature[at], 0)]
                step = np.where(np.isnan(value), self.missing[at], np.where(value < self.threshold[at], self.yes[at], self.no[at]))
                at = np.where(inner, step, at)
            total += self.threshold[at]
        return (1 / (1 + np.exp(-total))).astype(np.float32)


def with_tree_scores(pairs: DataFrame, models: list[Trees], features: tuple[str, ...] = FEATURES) -> DataFrame:
    """pairs plus p0, p1, ... of each model, from feature columns. Models are sent out once."""
    shared = pairs.sparkSession.sparkContext.broadcast(models)

    @F.pandas_udf(", ".join(f"p{i} float" for i in range(len(models))))
    def predicted(x: pd.DataFrame) -> pd.DataFrame:
        matrix = x.to_numpy(dtype=np.float32)
        return pd.DataFrame({f"p{i}": m.predict(matrix) for i, m in enumerate(shared.value)})

    return pairs.withColumn("_p", predicted(F.struct(*features))).select("*", "_p.*").drop("_p")


def read_models(spark: SparkSession, paths: list[str], hashes: list[str] | None = None) -> tuple[list[Trees], list[str]]:
    """Models and the SHA-256 of their files: JSON objects of feature_names, trees (a dump) and, if not 0.5, base_score.

    Raises if a file is missing, if its hash isn't the one that is given, or if its features aren't FEATURES in this order.
    """
    if hashes and len(hashes) != len(paths):
        raise ValueError(f"{len(paths)} models, but {len(hashes)} hashes")
    models, found = [], []
    for i, path in enumerate(paths):
        content = bytes(spark.read.format("binaryFile").load(path).first()["content"])
        found.append(hashlib.sha256(content).hexdigest())
        if hashes and found[-1] != hashes[i].lower():
            raise ValueError(f"{path} has the SHA-256 {found[-1]}, not {hashes[i]}")
        model = json.loads(content)
        if tuple(model["feature_names"]) != FEATURES:
            raise ValueError(f"{path} isn't of the {len(FEATURES)} features in their order")
        models.append(Trees.parse(model["trees"], model.get("base_score", 0.5)))
    return models, found
