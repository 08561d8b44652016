"""Batch training: proximal block coordinate descent for logistic loss with an L1 penalty."""

from __future__ import annotations

import math
import random
import uuid
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.keys import KeyRange, in_range
from ..functions.objective import Logit


@dataclass(frozen=True)
class DescentConfig:
    """epsilon: relative gain below which the screen is lifted and, at the second time in a row, training ends."""

    l1: float = 1.0
    rate: float = 1.0
    block_ratio: float = 4.0
    shuffle: bool = True
    prior_groups: tuple[int, ...] = ()
    prior_rounds: int = 5
    delay: int = 0
    passes: int = 10
    epsilon: float = 1e-4
    tail: int = 0
    delta_start: float = 1.0
    delta_most: float = 5.0
    screen_ratio: float = 10.0
    loss: str = "LOGIT"
    penalty: str = "L1"
    seed: int = 0
    save_every: int = 0

    def __post_init__(self) -> None:
        if self.loss != "LOGIT" or self.penalty != "L1":
            raise ValueError("block descent is for logistic loss with an L1 penalty")


#: A threshold that screens nothing, for the first pass.
NO_SCREEN = 1e20


def block_plan(slots: list[tuple[int, int, int, int, int]], ratio: float) -> list[tuple[int, KeyRange]]:
    """Blocks (slot, keys) from (slot, min_key, max_key, nnz_ele, nnz_ex): a slot with more than one key a row has
    ceil(keys a row * ratio) even parts, others one. The label and empty parts are left out."""
    plan = []
    for slot, low, high, elements, rows in slots:
        if slot:
            each = elements / rows
            n = max(1, math.ceil(each * ratio)) if each > 1 + 1e-6 else 1
            plan += [(slot, r) for r in KeyRange(low, high).divide(n) if not r.empty]
    return plan


def block_order(plan: list[tuple[int, KeyRange]], turn: int, cfg: DescentConfig) -> list[int]:
    """Places in the plan in the order of a pass; in the first, blocks of prior groups come first, several times."""
    order = list(range(len(plan)))
    if cfg.shuffle:
        random.Random(cfg.seed + turn).shuffle(order)
    if turn == 0 and cfg.prior_groups:
        prior = [i for i, (slot, _) in enumerate(plan) if slot in cfg.prior_groups]
        order = prior * cfg.prior_rounds + order
    return order


def waits_for(time: int, delay: int, first: int = 0) -> range:
    """The times whose updates a block has to see."""
    return range(max(first, time - 2 * delay - 1), max(first + 1, time - delay))


def block_gradient(entries: DataFrame, rows: DataFrame, model: DataFrame) -> DataFrame:
    """(key, g, u): gradient and bound on the curvature of the model's active keys, at margins m of `rows` (row_id, y, m)."""
    tau = Logit.tau(F.col("y"), F.col("m"))
    live = entries.join(model.where("active").select("key", "delta"), "key").join(rows.select("row_id", "y", tau.alias("tau")), "row_id")
    v, t = F.col("val"), F.col("tau")
    bound = F.least(t * (1 - t) * F.exp(F.abs(v) * F.col("delta")), F.lit(0.25)) * v * v
    return live.groupBy("key").agg(F.sum(-F.col("y") * t * v).alias("g"), F.sum(bound).alias("u"))


def step_columns(w: Column, delta: Column, g: Column, u: Column, screen: Column | float, cfg: DescentConfig) -> dict[str, Column]:
    """For an active key: change, violation of the optimality conditions, and whether it is screened out."""
    up, down = g + cfg.l1, g - cfg.l1
    curve = u / cfg.rate + 1e-10
    zero = w == 0
    violation = F.when(zero & (up < 0), -up).when(zero & (down > 0), down).otherwise(F.lit(0.0))
    screened = zero & (up >= 0) & (down <= 0) & (up > screen) & (down < -(screen if isinstance(screen, Column) else F.lit(float(screen))))
    move = F.when(up <= curve * w, -up / curve).when(down >= curve * w, -down / curve).otherwise(-w)
    change = F.when(screened, F.lit(0.0)).otherwise(F.least(delta, F.greatest(-delta, move)))
    return {"change": change, "violation": F.when(screened, F.lit(0.0)).otherwise(violation), "screened": screened}


def weight_update(model: DataFrame, grad: DataFrame, cfg: DescentConfig, screen: float = NO_SCREEN) -> DataFrame:
    """(key, w, delta, active, change, violation) and what else the model has: the model after one block. Keys that are
    inactive, or outside the block (without a gradient), stay."""
    own = [c for c in model.columns if c not in ("key", "w", "delta", "active")]
    joined = model.join(grad, "key", "left")
    columns = step_columns(F.col("w"), F.col("delta"), F.col("g"), F.col("u"), screen, cfg)
    moved = F.col("active") & F.col("g").isNotNull()
    told = joined.withColumns({k: F.when(moved, c).otherwise(F.lit(False) if k == "screened" else F.lit(0.0)) for k, c in columns.items()})
    delta = F.least(F.lit(float(cfg.delta_most)), 2 * F.abs("change") + 0.1)
    return told.select(
        *own,
        "key",
        (F.col("w") + F.col("change")).alias("w"),
        F.when(moved & ~F.col("screened"), delta).otherwise(F.col("delta")).alias("delta"),
        (F.col("active") & ~F.col("screened")).alias("active"),
        "change",
        "violation",
    )


def margin_update(rows: DataFrame, entries: DataFrame, changed: DataFrame) -> DataFrame:
    """rows with m moved by the changed weights (key, change). Margins are kept rather than exp(y m), which overflows."""
    moved = entries.join(changed.where("change <> 0").select("key", "change"), "key").groupBy("row_id").agg(F.sum(F.col("change") * F.col("val")).alias("_d"))
    return rows.join(moved, "row_id", "left").withColumn("m", F.col("m") + F.coalesce("_d", F.lit(0.0))).drop("_d")


def objective(rows: DataFrame, model: DataFrame, cfg: DescentConfig) -> DataFrame:
    """(loss, penalty, nnz, active): the parts of the objective; one row."""
    loss = rows.agg(F.coalesce(F.sum(Logit().value(F.col("y"), F.col("m"))), F.lit(0.0)).alias("loss"))
    w = F.col("w")
    other = model.agg((F.coalesce(F.sum(F.when(F.col("active"), F.abs(w))), F.lit(0.0)) * cfg.l1).alias("penalty"), F.count_if(F.col("active") & (w != 0)).alias("nnz"), F.count_if("active").alias("active"))
    return loss.join(F.broadcast(other), F.lit(True))  # one row each


def start_model(keys: DataFrame, cfg: DescentConfig, init: DataFrame | None = None) -> DataFrame:
    """(key, slot, w, delta, active); weights 0, or those of `init` (key, w)."""
    model = keys.select("key", "slot").distinct()
    model = model.withColumn("w", F.lit(0.0)) if init is None else model.join(init.select("key", "w"), "key", "left").withColumn("w", F.coalesce("w", F.lit(0.0)))
    return model.select("key", "slot", "w", F.lit(float(cfg.delta_start)).alias("delta"), F.lit(True).alias("active"))


@dataclass
class Progress:
    turn: int
    objective: float
    nnz: int
    active: int
    violation: float
    relative: float


def _work_folder(spark: SparkSession, work: str | None) -> str:
    top = work or spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not top:
        raise ValueError("give a folder that the driver and all executors share, or set spark.checkpoint.dir")
    return f"{top.rstrip('/')}/descent-{uuid.uuid4().hex}"


#: Files over which the entries of a block are spread at most.
PARTS_A_BLOCK = 32
#: The block of keys that no block of the plan holds; they keep their weights.
NO_BLOCK = -1


def stored_blocks(entries: DataFrame, plan: list[tuple[int, KeyRange]], path: str) -> DataFrame:
    """(row_id, slot, key, val, block): the entries in a folder for each block, so that a step reads its own and no other."""
    ranges: dict[int, list[tuple[int, KeyRange]]] = {}
    for i, (slot, keys) in enumerate(plan):
        ranges.setdefault(slot, []).append((i, keys))
    block = F.lit(NO_BLOCK)
    for slot, own in ranges.items():
        inside = F.lit(NO_BLOCK)
        for i, keys in own:
            inside = F.when(in_range(F.col("key"), keys.begin, keys.end), F.lit(i)).otherwise(inside)
        block = F.when(F.col("slot") == slot, inside).otherwise(block)
    dealt = entries.select("row_id", "slot", "key", "val", block.alias("block")).repartition("block", F.pmod(F.xxhash64("row_id"), F.lit(PARTS_A_BLOCK)))
    dealt.write.partitionBy("block").parquet(path)
    return entries.sparkSession.read.schema("row_id long, slot int, key long, val double, block int").parquet(path)


def train(entries: DataFrame, rows: DataFrame, plan: list[tuple[int, KeyRange]], cfg: DescentConfig, report: Callable[[Progress], None] | None = None, save: Callable[[DataFrame, int], None] | None = None, init: DataFrame | None = None, work: str | None = None) -> DataFrame:
    """(key, slot, w, delta, active) after training on entries (row_id, slot, key, val) and rows (row_id, y).

    The entries are computed once and written by block to `work` (spark.checkpoint.dir if None); a step reads the files of
    its block alone. The model is kept block by block: a step joins and writes its own keys. delay + 1 blocks in a row see
    the same margins and are one plan. What a step makes is checkpointed, so a lost executor costs its partitions and no
    more. Only sums of a step or pass reach the driver. `report` gets each pass's progress, `save` the model (key, w) every
    cfg.save_every passes.
    """
    from .localize import score

    spark = entries.sparkSession
    folder = _work_folder(spark, work)
    stored = stored_blocks(entries, plan, f"{folder}/entries")
    start = start_model(stored, cfg, init).join(stored.select("key", "block").distinct(), "key")
    start.write.partitionBy("block").parquet(f"{folder}/model")
    whole = spark.read.schema("key long, slot int, w double, delta double, active boolean, block int").parquet(f"{folder}/model")
    models = {b: whole.where(F.col("block") == b) for b in [NO_BLOCK, *range(len(plan))]}
    every = lambda: reduce(DataFrame.union, models.values()).select("key", "slot", "w", "delta", "active")

    state = rows.select("row_id", "y")
    state = state.withColumn("m", F.lit(0.0)) if init is None else state.join(score(stored, whole, rows).withColumnRenamed("score", "m"), "row_id")
    state = state.checkpoint()
    screen, before, lifted = NO_SCREEN, None, False
    n_rows = state.count()
    for turn in range(cfg.passes):
        worst = 0.0
        order = block_order(plan, turn, cfg)
        for at in range(0, len(order), cfg.delay + 1):
            some = list(dict.fromkeys(order[at : at + cfg.delay + 1]))
            part = stored.where(F.col("block").isin(some))
            model = reduce(DataFrame.union, [models[b] for b in some])
            new = weight_update(model, block_gradient(part, state, model), cfg, screen).checkpoint()
            worst = max(worst, new.agg(F.max("violation")).first()[0] or 0.0)
            state = margin_update(state, part, new).checkpoint()
            for b in some:
                models[b] = new.where(F.col("block") == b).select(*whole.columns)
        found = objective(state, every(), cfg).first()
        now = found["loss"] + found["penalty"]
        relative = 1.0 if before is None else before / now - 1
        before = now
        if report:
            report(Progress(turn, now, found["nnz"], found["active"], worst, relative))
        if save and cfg.save_every and (turn + 1) % cfg.save_every == 0:
            save(every().select("key", "w"), turn + 1)
        screen = worst / n_rows * cfg.screen_ratio
        if 0 < relative <= cfg.epsilon:
            if lifted:
                break
            lifted = True
            models = {b: m.withColumn("active", F.lit(True)) for b, m in models.items()}
        else:
            lifted = False
    return every()
