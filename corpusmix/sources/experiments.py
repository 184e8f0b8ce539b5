"""Results of experiments and items of evaluation bundles in folders of JSON."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmix.operators.params import CURVE, WEIGHTS
from corpusmix.schema import CRITERIA

META = (
    "experiment_id bigint, train_loss double, val_loss double, val_ppl double, num_steps bigint, sampled_docs bigint, training_docs bigint, val_docs bigint, "
    "quality_weights map<string, map<string, double>>, sampling_params map<string, map<string, double>>, per_task_losses map<string, double>"
)
ITEM = "query string, choices array<string>, gold int, context string, context_options array<string>, continuation string, answer string"


def read_meta(spark: SparkSession, folder: str) -> DataFrame:
    """The meta.json of every exp_* folder that has one, with the folder's name as run; bad files give nulls."""
    d = spark.read.schema(META).option("multiLine", True).json(f"{folder}/exp_*/meta.json")
    return d.withColumn("run", F.regexp_extract(F.input_file_name(), r"/(exp_[^/]+)/", 1))


def read_items(spark: SparkSession, path: str) -> DataFrame:
    """Items of any of the three task types, as JSON lines; fields a type lacks are null."""
    return spark.read.schema(ITEM).json(path)


def theta_json(theta: DataFrame) -> str:
    """One set of parameters (a row for each domain) as JSON by names, in full precision."""
    rows = theta.collect()
    weights = {str(r["domain"]): {c: r[a] for c, a in zip(CRITERIA, WEIGHTS)} for r in rows}
    curves = {str(r["domain"]): {c: r[c] for c in CURVE} for r in rows}
    return json.dumps({"quality_weights": weights, "sampling_params": curves}, sort_keys=True)


def theta_of_json(spark: SparkSession, text: str) -> DataFrame:
    """The table of theta_json again, matched by names."""
    d = json.loads(text)
    rows = [(int(k), *[float(d["quality_weights"].get(k, {}).get(c, 0.0)) for c in CRITERIA], *[float(v[c]) for c in CURVE]) for k, v in d["sampling_params"].items()]
    return spark.createDataFrame(rows, "domain long, " + ", ".join(f"{c} double" for c in (*WEIGHTS, *CURVE)))
