"""Jobs: what to train or evaluate on, as dataclasses that read from JSON."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field, fields, is_dataclass
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.objective import AdaGrad, Ftrl, LearningRate, penalty
from ..operators import descent, online
from ..operators.evaluate import evaluate
from ..operators.localize import score
from ..operators.profile import profile
from ..operators.sketch import cumulative_filter, tail_filter
from ..sources.examples import entries, labels, read_examples
from ..sources.models import read_model, write_model


@dataclass(frozen=True)
class Data:
    """Files of examples: text formats by name, ignore_groups to put all features into slot 1."""

    file: tuple[str, ...] = ()
    text: str = "LIBSVM"
    ignore_groups: bool = False
    max_lines: int = 0
    replica: int = 1
    shuffle: bool = False
    hash_kernel: int = 0

    def read(self, spark: SparkSession) -> DataFrame:
        return read_examples(spark, list(self.file), self.text, self.ignore_groups, self.hash_kernel, self.max_lines)


@dataclass(frozen=True)
class Penalty:
    type: str = "L1"
    weights: tuple[float, ...] = (1.0,)


@dataclass(frozen=True)
class Rate:
    type: str = "CONSTANT"
    alpha: float = 1.0
    beta: float = 1.0


@dataclass(frozen=True)
class Online:
    algo: str = "FTRL"
    minibatch: int = 1000
    passes: int = 1
    tail: int = 0
    countmin_n: int = 100_000_000
    countmin_k: int = 2


@dataclass(frozen=True)
class Job:
    """Training with `batch` (options of block descent) or `online`; evaluation where validation_data and model_input are given."""

    training_data: Data | None = None
    validation_data: Data | None = None
    model_output: str = ""
    model_input: str = ""
    loss: str = "LOGIT"
    penalty: Penalty = field(default_factory=Penalty)
    rate: Rate = field(default_factory=Rate)
    batch: dict | None = None
    online: Online | None = None
    work: str = ""

    @classmethod
    def from_json(cls, text: str) -> Job:
        return _build(cls, json.loads(text), {"training_data": Data, "validation_data": Data, "penalty": Penalty, "rate": Rate, "online": Online})


def _build(kind: type, values: dict[str, Any], nested: dict[str, type]) -> Any:
    known = {f.name for f in fields(kind)}
    if unknown := set(values) - known:
        raise ValueError(f"no such options: {', '.join(sorted(unknown))}")
    made = {k: _build(nested[k], v, {}) if k in nested and is_dataclass(nested[k]) and v is not None else tuple(v) if isinstance(v, list) else v for k, v in values.items()}
    return kind(**made)


def run(spark: SparkSession, job: Job, report: Callable[[Any], None] | None = None) -> DataFrame:
    """The evaluation row, or the trained model (key, w), written to model_output if given.

    Training parses its input once: examples are written to job.work (spark.checkpoint.dir if empty), by minibatch or by
    block, and passes read only the part that they need. `report` gets the progress of each pass or minibatch; with
    batch.save_every, models of passes are written beside model_output.
    """
    if job.validation_data and job.model_input:
        examples = job.validation_data.read(spark)
        flat = entries(examples).where("slot > 0")
        scored = labels(examples).join(score(flat, read_model(spark, job.model_input), examples), "row_id")
        return evaluate(scored.select(F.col("y").alias("label"), "score"))
    if job.training_data is None:
        raise ValueError("nothing to train on")
    folder = _folder(spark, job)
    job.training_data.read(spark).write.parquet(f"{folder}/examples")
    examples = spark.read.parquet(f"{folder}/examples")
    if job.batch is not None:
        model = _descend(job, examples, folder, report)
    else:
        model = _learn(job, examples, folder, report)
    if job.model_output:
        write_model(model, job.model_output)
    return model


def _folder(spark: SparkSession, job: Job) -> str:
    top = job.work or spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not top:
        raise ValueError("set work, or spark.checkpoint.dir, to a folder that the driver and all executors share")
    return f"{top.rstrip('/')}/job-{uuid.uuid4().hex}"


def _descend(job: Job, examples: DataFrame, folder: str, report: Callable[[Any], None] | None) -> DataFrame:
    cfg = descent.DescentConfig(l1=job.penalty.weights[0], rate=job.rate.alpha, loss=job.loss, penalty=job.penalty.type, **job.batch)
    flat = entries(examples).where("slot > 0").select("row_id", "slot", "key", "val")
    if cfg.tail:
        flat = tail_filter(flat, cfg.tail)
    slots = [(r["slot"], int(r["min_key"]), int(r["max_key"]), r["nnz_ele"], r["nnz_ex"]) for r in profile(examples).collect()]  # a row for each of at most 4096 slots
    save = (lambda model, turn: write_model(model, job.model_output, turn)) if job.model_output else None
    return descent.train(flat, labels(examples), descent.block_plan(slots, cfg.block_ratio), cfg, report, save, work=folder).select("key", "w")


def _learn(job: Job, examples: DataFrame, folder: str, report: Callable[[Any], None] | None) -> DataFrame:
    """Minibatches are the next rows in order, each in a folder of its own. With `tail`, a key takes part from the minibatch
    on in which its running estimate exceeds it."""
    spark, cfg = examples.sparkSession, job.online or Online()
    rate, pen = LearningRate(job.rate.alpha, job.rate.beta, job.rate.type == "DECAY"), penalty(job.penalty.type, *job.penalty.weights)
    rule = Ftrl(rate, pen) if cfg.algo == "FTRL" else AdaGrad(rate, pen)
    online.with_batch(examples, cfg.minibatch).repartition("batch", F.pmod(F.xxhash64("row_id"), F.lit(descent.PARTS_A_BLOCK))).write.partitionBy("batch").parquet(f"{folder}/batches")
    dealt = spark.read.parquet(f"{folder}/batches")
    passing = None
    if cfg.tail:
        counts = entries(dealt, "batch").where("slot > 0").groupBy("batch", "key").agg(F.count("*").alias("cnt"))
        cumulative_filter(counts, cfg.tail, cfg.countmin_n, cfg.countmin_k).where("passes").select("batch", "key").write.partitionBy("batch").parquet(f"{folder}/passing")
        passing = spark.read.schema("key long, batch long").parquet(f"{folder}/passing")
    state, seen = None, 0
    for turn in range(cfg.passes):
        for row in dealt.select("batch").distinct().orderBy("batch").toLocalIterator():  # one number for each superstep
            here = F.col("batch") == row["batch"]
            part = dealt.where(here)
            flat, rows = entries(part).where("slot > 0").select("row_id", "key", "val"), labels(part)
            if passing is not None:
                flat = flat.join(passing.where(here).select("key"), "key", "left_semi")
            state = online.superstep(state, flat, rows, rule, job.loss).checkpoint()
            seen += 1
            if report:
                report({"turn": turn, "batch": row["batch"], "steps": seen})
    if state is None:
        raise ValueError("no examples to train on")
    return state.select("key", F.col("state.w").alias("w"))
