"""Queries of whole runs, stores with rules of their own, file sources, and plans of work."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.objective import AdaGrad, ElasticNet, LearningRate, penalty
from ..functions.transfer import FixedPoint, Noise
from ..operators import descent, linalg, localize, online, sketch, store
from ..sources import examples, files, models, records
from .catalogue import ADAGRAD, FTRL, QUERIES, SCORED, SQL, query, r, scored
from .config import Data, Job, Online, Penalty, Rate, run
from .tables import ROWS_SQL, entries, entries_sql, read, rows, tasks, weight, weight_sql


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the folder that all executors share; in a temporary one in a local session that has none."""
    top = spark.conf.get("spark.checkpoint.dir", None)
    if top is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        import tempfile

        top = tempfile.mkdtemp(prefix="spark-")
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(top)
    return f"{top.rstrip('/')}/{name}-{uuid.uuid4().hex}"


# --- files ------------------------------------------------------------------------------------------------------------


def _put(spark: SparkSession, path: str, content: bytes) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = where.getFileSystem(spark._jsc.hadoopConfiguration()).create(where, True)
    try:
        out.write(bytearray(content))
    finally:
        out.close()


@query("raw_array_roundtrip", "SELECT row_number() OVER (ORDER BY n_nationkey) - 1 AS idx, n_nationkey * 7 + 3 AS value FROM nation")
def raw_array_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    import numpy as np

    values = [x[0] * 7 + 3 for x in read(spark, d, "nation").select("n_nationkey").orderBy("n_nationkey").collect()]  # a table of fixed size
    path = scratch(spark, "array")
    _put(spark, path, np.asarray(values, "<u8").tobytes())
    return records.read_array(spark, path).select("idx", "value")


@query("raw_matrix_roundtrip", "SELECT n_regionkey AS row, n_nationkey AS col, n_nationkey / 4.0::DOUBLE AS val FROM nation")
def raw_matrix_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    import numpy as np

    found = read(spark, d, "nation").select("n_regionkey", "n_nationkey").orderBy("n_regionkey", "n_nationkey").collect()  # a table of fixed size
    counts = np.bincount([x[0] for x in found])
    stem = scratch(spark, "matrix")
    _put(spark, f"{stem}.offset", np.r_[0, np.cumsum(counts)].astype("<u8").tobytes())
    _put(spark, f"{stem}.index", np.asarray([x[1] for x in found], "<u4").tobytes())
    _put(spark, f"{stem}.value", np.asarray([x[1] / 4 for x in found], "<f8").tobytes())
    return records.read_matrix(spark, stem)


@query("file_parts", "SELECT r_regionkey % 2 AS part, 'region_' || r_regionkey || '.txt' AS name FROM region WHERE r_regionkey < 4")
def file_parts(spark: SparkSession, d: str) -> DataFrame:
    top = scratch(spark, "files")
    for row in read(spark, d, "region").collect():  # a table of fixed size
        _put(spark, f"{top}/region_{row['r_regionkey']}.txt", row["r_name"].encode())
    found = files.search_files(spark, [rf"{top}/region_[0-3]\.txt", rf"{top}/region_0\..*"])
    dealt = [(k, f.rpartition("/")[2]) for k, part in enumerate(files.divide_files(found, 2)) for f in part]
    return spark.createDataFrame(dealt, "part int, name string")


def _lines(spark: SparkSession, d: str, path: str) -> str:
    """Orders with supplier and line number as features, written as text in one of the formats."""
    n = tasks(spark, d)
    e = localize.dealt(entries(spark, d, 2, 3), n, "row_id").groupBy("row_id").agg(F.array_sort(F.collect_list(F.struct("slot", "key"))).alias("e"))
    keys = lambda s: F.array_join(F.transform(F.filter("e", lambda x: x["slot"] == s), lambda x: x["key"].cast("string")), " ")
    line = F.concat(F.col("y").cast("int").cast("string"), F.lit("; 2 "), keys(2), F.lit("; 3 "), keys(3), F.lit(";"))
    rows(spark, d).join(e, "row_id").repartitionByRange(n, "row_id").sortWithinPartitions("row_id").select(line.alias("value")).write.text(path)
    return path


@query("line_limit", "SELECT least(count(*), 100) AS n FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem)")
def line_limit(spark: SparkSession, d: str) -> DataFrame:
    return examples.read_examples(spark, _lines(spark, d, scratch(spark, "lines")), "SPARSE_BINARY", max_lines=100, one_text=True).agg(F.count("*").alias("n"))


@query("slot_cache", f"WITH {ROWS_SQL}, {entries_sql(2, 3)} SELECT slot, count(*) AS n, count(DISTINCT key) AS n_keys FROM entries JOIN rows USING (row_id) WHERE slot = 3 GROUP BY slot")
def slot_cache(spark: SparkSession, d: str) -> DataFrame:
    top = scratch(spark, "slots")
    examples.write_slots(examples.read_examples(spark, _lines(spark, d, f"{top}-text"), "SPARSE_BINARY"), top, tasks(spark, d))
    return examples.read_slots(spark, top, 3).groupBy("slot").agg(F.count("*").alias("n"), F.count_distinct("key").alias("n_keys"))


@query("minibatch_reader", "SELECT batch, count(*) AS n, min(k) AS first, max(k) AS last FROM (SELECT o_orderkey AS k, (row_number() OVER (ORDER BY o_orderkey) - 1) // 700 AS batch FROM orders WHERE o_orderkey % 3 <> 1) GROUP BY batch")
def minibatch_reader(spark: SparkSession, d: str) -> DataFrame:
    gaps = read(spark, d, "orders").where("o_orderkey % 3 <> 1").select(F.col("o_orderkey").alias("row_id"))
    return online.with_batch(gaps, 700).groupBy("batch").agg(F.count("*").alias("n"), F.min("row_id").alias("first"), F.max("row_id").alias("last"))


@query("model_checkpoint", f"WITH {entries_sql(1)} SELECT key, round({weight_sql()}, 6) AS w FROM (SELECT DISTINCT key FROM entries) WHERE {weight_sql()} <> 0")
def model_checkpoint(spark: SparkSession, d: str) -> DataFrame:
    path = scratch(spark, "model")
    models.write_model(entries(spark, d, 1).select("key").distinct().select("key", weight(F.col("key")).alias("w")), path, 3)
    return models.read_model(spark, f"{path}_it_3").select("key", r("w").alias("w"))


# --- arrays, noise, quantising ----------------------------------------------------------------------------------------

_LISTS = "SELECT vec_id, embedding[1:4]::DOUBLE[] AS a, embedding[61:64]::DOUBLE[] AS b FROM embeddings"


@query("array_segments", f"SELECT vec_id, round(list_sum(list_concat(a, b)), 5) AS appended, round(list_sum(a[2:3]), 5) AS part, round(list_sum(a[1:3]), 5) AS cut, round(list_sum(a) + 2 * 0.5, 5) AS filled FROM ({_LISTS})")
def array_segments(spark: SparkSession, d: str) -> DataFrame:
    e = read(spark, d, "embeddings").select("vec_id", F.slice("embedding", 1, 4).cast("array<double>").alias("a"), F.slice("embedding", 61, 4).cast("array<double>").alias("b"))
    total = lambda x: r(F.aggregate(x, F.lit(0.0), lambda s, v: s + v), 5)
    a = F.col("a")
    return e.select("vec_id", total(linalg.append(a, F.col("b"))).alias("appended"), total(linalg.segment(a, 1, 3)).alias("part"), total(linalg.resize(a, 3, F.lit(0.5))).alias("cut"), total(linalg.resize(a, 6, F.lit(0.5))).alias("filled"))


@query("initial_values", "SELECT count(*) AS n, 0.0::DOUBLE AS zero, 2.5 * count(*)::DOUBLE AS constant, true AS mean_near, true AS std_near, true AS same_again FROM events")
def initial_values(spark: SparkSession, d: str) -> DataFrame:
    # Drawn values can't be told by SQL, what has to hold of them can: at n draws, ten standard errors.
    drawn = lambda seed: linalg.initial("GAUSSIAN", mean=1.0, std=3.0, seed=seed)
    e = read(spark, d, "events").select(linalg.initial("ZERO").alias("z"), linalg.initial("CONSTANT", 2.5).alias("c"), drawn(4).alias("g"), drawn(4).alias("h"), drawn(5).alias("o"))
    error = 30.0 / F.sqrt(F.count("*"))
    return e.agg(F.count("*").alias("n"), F.sum("z").alias("zero"), F.sum("c").alias("constant"), (F.abs(F.avg("g") - 1.0) < error).alias("mean_near"), (F.abs(F.stddev("g") - 3.0) < error).alias("std_near"), (F.bool_and(F.col("g") == F.col("h")) & ~F.bool_and(F.col("g") == F.col("o"))).alias("same_again"))


@query("noise_moments", "SELECT count(*) AS n, true AS mean_near, true AS std_near, true AS kept_back FROM events")
def noise_moments(spark: SparkSession, d: str) -> DataFrame:
    noise = Noise(0.5, 2.0, seed=9)
    e = read(spark, d, "events").select("value", (noise.encode(F.col("value")) - F.col("value")).alias("x"))
    error = 20.0 / F.sqrt(F.count("*"))
    return e.agg(F.count("*").alias("n"), (F.abs(F.avg("x") - 0.5) < error).alias("mean_near"), (F.abs(F.stddev("x") - 2.0) < error).alias("std_near"), F.bool_and(noise.decode(F.col("value")) == F.col("value")).alias("kept_back"))


@query("quantize_own_range", "WITH m AS (SELECT min(value) AS lo, max(value) AS hi FROM events) SELECT event_id, floor((value - lo) / (hi - lo) * 65534)::BIGINT AS code FROM events, m")
def quantize_own_range(spark: SparkSession, d: str) -> DataFrame:
    e = read(spark, d, "events").select("event_id", "value")
    return e.select("event_id", FixedPoint.of(e, "value", 2).encode(F.col("value")).alias("code"))


# --- stores -----------------------------------------------------------------------------------------------------------


@query("kvmap_pull", "SELECT s_suppkey AS key, CASE WHEN s_suppkey % 3 = 0 THEN s_acctbal ELSE 0 END::DOUBLE AS w, CASE WHEN s_suppkey % 3 = 0 THEN 1.0 ELSE 0.0 END::DOUBLE AS s FROM supplier")
def kvmap_pull(spark: SparkSession, d: str) -> DataFrame:
    sup = read(spark, d, "supplier")
    held = sup.where("s_suppkey % 3 = 0").select(F.col("s_suppkey").alias("key"), F.struct(F.col("s_acctbal").alias("w"), F.lit(1.0).alias("s")).alias("state"))
    rule = AdaGrad(LearningRate(), ElasticNet())
    pulled = store.MapStore(rule.start(), rule.step, online.state_kind(rule)).pull(sup.select(F.col("s_suppkey").alias("key")), held)
    return pulled.select("key", "state.w", "state.s")


@query("kvlayer_updater", "SELECT label AS layer, i AS idx, round(sum(x) * 0.5 * (-0.1) + sum(2 * x) * (-0.1), 5) AS value FROM (SELECT label, unnest(embedding)::DOUBLE AS x, unnest(range(64)) AS i FROM embeddings) GROUP BY 1, 2")
def kvlayer_updater(spark: SparkSession, d: str) -> DataFrame:
    pushes = read(spark, d, "embeddings").select(F.col("label").alias("layer"), F.posexplode("embedding").alias("idx", "v")).select("layer", F.col("idx").cast("bigint").alias("idx"), F.col("v").cast("double").alias("value"))
    decay = lambda old, got: old * 0.5 - got * 0.1
    twice = store.LayerStore().push(pushes, decay).push(pushes.withColumn("value", F.col("value") * 2), decay)
    return twice.table.select("layer", "idx", r("value", 5).alias("value"))


@query("penalty_kinds", "SELECT s_suppkey, round(0.3 * abs(z) + 0.2 * z * z, 8) AS l1, round(0.2 * z * z, 8) AS l2 FROM (SELECT s_suppkey, s_acctbal / 10000 AS z FROM supplier)")
def penalty_kinds(spark: SparkSession, d: str) -> DataFrame:
    z = F.col("s_acctbal") / 10000
    return read(spark, d, "supplier").select("s_suppkey", r(penalty("L1", 0.3, 0.2).value(z), 8).alias("l1"), r(penalty("L2", 0.2).value(z), 8).alias("l2"))


@query("sketch_sizes", "WITH u AS (SELECT count(DISTINCT l_partkey) AS n FROM lineitem) SELECT w, greatest(64, floor(w / ln(w + 1) * n * 2.5)::BIGINT) AS size FROM u, (SELECT unnest(range(1, 9)) AS w)")
def sketch_sizes(spark: SparkSession, d: str) -> DataFrame:
    unique = read(spark, d, "lineitem").select("l_partkey").distinct().count()
    return spark.createDataFrame([(w, sketch.sketch_size(unique, 2.5, w)) for w in range(1, 9)], "w bigint, size bigint")


# --- online runs ------------------------------------------------------------------------------------------------------


@query(
    "progress_merged",
    f"WITH {SCORED}, b AS (SELECT row_id % 4 AS b, count(*) AS n, sum(ln(1 + exp(-label * score))) AS objective, avg(CASE WHEN (label > 0 AND score > 0) OR (label < 0 AND score <= 0) THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS acc FROM scored GROUP BY 1) SELECT sum(n)::BIGINT AS n, round(sum(objective), 3) AS objective, round(avg(greatest(acc, 1 - acc)), 6) AS accuracy, (sum(b + 1))::BIGINT AS nnz, round(sqrt(sum((b + 1) * 2)) / sqrt(sum((b + 1) * 8)), 6) AS relative_change FROM b",
)
def progress_merged(spark: SparkSession, d: str) -> DataFrame:
    rows_ = scored(spark, d).select((F.col("row_id") % 4).alias("batch"), F.col("label").alias("y"), F.col("score").alias("m"))
    told = online.batch_metrics(rows_).withColumns({"auc": F.lit(0.5), "nnz_change": F.col("batch") + 1, "delta_sum": (F.col("batch") + 1) * 2.0, "weight_sum": (F.col("batch") + 1) * 8.0})
    found = online.merge_progress(told)
    return found.select("n", r("objective", 3).alias("objective"), r("accuracy").alias("accuracy"), "nnz", r("relative_change").alias("relative_change"))


def _job(algo: str) -> Job:
    rule = FTRL if algo == "FTRL" else ADAGRAD
    return Job(penalty=Penalty("L1", (rule.penalty.l1, rule.penalty.l2)), rate=Rate("DECAY", 0.1, 1.0), online=Online(algo, minibatch=1_000_000_000))


def _one_batch_sql() -> str:
    grad = f"WITH {ROWS_SQL}, {entries_sql(2, 3)}, g AS (SELECT key, sum(-y / 2 * val) AS g FROM entries JOIN rows USING (row_id) GROUP BY key)"
    return f"{grad}, s AS (SELECT key, 0.1::DOUBLE / (abs(g) + 1) AS eta, g FROM g) SELECT key, round((CASE WHEN -g * eta > 0.5 * eta THEN -g * eta - 0.5 * eta WHEN -g * eta < -0.5 * eta THEN -g * eta + 0.5 * eta ELSE 0 END) / (1 + 0.1 * eta), 5) AS w FROM s"


@query("job_online", _one_batch_sql())
def job_online(spark: SparkSession, d: str) -> DataFrame:
    """A job from text files to a model: one minibatch of FTRL from nothing."""
    from dataclasses import replace

    top = scratch(spark, "job")
    job = replace(_job("FTRL"), training_data=Data((_lines(spark, d, f"{top}-text"),), "SPARSE_BINARY"), work=top)
    return run(spark, job).select("key", r("w", 5).alias("w"))


# --- block descent ----------------------------------------------------------------------------------------------------

_L1, _RATE = 4.0, 0.9


def _pass_sql(k: int, screen: str) -> str:
    """One pass over one block of all supplier keys, from w{k}, margins t{k} to w{k + 1} and t{k + 1}."""
    return f"""g{k} AS (SELECT key, sum(-y * (1 / (1 + exp(y * m))) * val) AS g, sum(least((1 / (1 + exp(y * m))) * (1 - 1 / (1 + exp(y * m))) * exp(abs(val) * delta), 0.25) * val * val) AS u FROM entries JOIN t{k} USING (row_id) JOIN w{k} USING (key) WHERE active GROUP BY key),
c{k} AS (SELECT key, w, delta, active, g IS NOT NULL AND active AS live, g + {_L1} AS up, g - {_L1} AS down, u / {_RATE} + 1e-10 AS curve FROM w{k} LEFT JOIN g{k} USING (key)),
d{k} AS (SELECT *, live AND w = 0 AND up >= 0 AND down <= 0 AND up > {screen} AND down < -{screen} AS screened, CASE WHEN live THEN least(delta, greatest(-delta, CASE WHEN up <= curve * w THEN -up / curve WHEN down >= curve * w THEN -down / curve ELSE -w END)) ELSE 0 END AS step, CASE WHEN live AND w = 0 AND up < 0 THEN -up WHEN live AND w = 0 AND down > 0 THEN down ELSE 0 END AS v FROM c{k}),
e{k} AS (SELECT key, w, delta, active, live, screened, CASE WHEN screened THEN 0 ELSE step END AS change, CASE WHEN screened THEN 0 ELSE v END AS violation FROM d{k}),
w{k + 1} AS (SELECT key, w + change AS w, CASE WHEN live AND NOT screened THEN least(5.0, 2 * abs(change) + 0.1) ELSE delta END AS delta, active AND NOT screened AS active FROM e{k}),
t{k + 1} AS (SELECT row_id, y, m + coalesce(sum(change * val), 0) AS m FROM t{k} LEFT JOIN entries USING (row_id) LEFT JOIN e{k} USING (key) GROUP BY row_id, y, m)"""


_DESCENT = f"""WITH {ROWS_SQL}, {entries_sql(2)}, w0 AS (SELECT DISTINCT key, 0.0::DOUBLE AS w, 1.0::DOUBLE AS delta, true AS active FROM entries), t0 AS (SELECT row_id, y, 0.0::DOUBLE AS m FROM rows),
{_pass_sql(0, "1e20")}, {_pass_sql(1, "(SELECT max(violation) / (SELECT count(*) FROM rows) * 10 FROM e0)")}"""


def _plan(spark: SparkSession, d: str) -> list:
    from ..functions.keys import KeyRange
    from .tables import SPACE

    return [(2, KeyRange(2 * SPACE, 3 * SPACE))]


def _two_passes(spark: SparkSession, d: str, report=None) -> DataFrame:  # noqa: ANN001
    cfg = descent.DescentConfig(l1=_L1, rate=_RATE, passes=2, epsilon=1e-12)
    return descent.train(entries(spark, d, 2), rows(spark, d), _plan(spark, d), cfg, report, work=scratch(spark, "descent"))


@query("descent_two_passes", f"{_DESCENT} SELECT key, round(w, 5) AS w, active FROM w2")
def descent_two_passes(spark: SparkSession, d: str) -> DataFrame:
    return _two_passes(spark, d).select("key", r("w", 5).alias("w"), "active")


@query(
    "descent_progress",
    f"{_DESCENT}, o AS (SELECT 0 AS turn, (SELECT sum(ln(1 + exp(-y * m))) FROM t1) + {_L1} * (SELECT sum(abs(w)) FROM w1 WHERE active) AS objective, (SELECT count(*) FROM w1 WHERE active AND w <> 0) AS nnz, (SELECT count(*) FROM w1 WHERE active) AS active, (SELECT max(violation) FROM e0) AS violation UNION ALL SELECT 1, (SELECT sum(ln(1 + exp(-y * m))) FROM t2) + {_L1} * (SELECT sum(abs(w)) FROM w2 WHERE active), (SELECT count(*) FROM w2 WHERE active AND w <> 0), (SELECT count(*) FROM w2 WHERE active), (SELECT max(violation) FROM e1)) SELECT turn, round(objective, 3) AS objective, nnz, active, round(violation, 4) AS violation, round(coalesce(lag(objective) OVER (ORDER BY turn) / objective - 1, 1), 6) AS relative FROM o",
)
def descent_progress(spark: SparkSession, d: str) -> DataFrame:
    told: list[descent.Progress] = []
    _two_passes(spark, d, told.append)
    made = [(p.turn, round(p.objective, 3), p.nnz, p.active, round(p.violation, 4), round(p.relative, 6)) for p in told]
    return spark.createDataFrame(made, "turn int, objective double, nnz bigint, active bigint, violation double, relative double")


@query("block_orders", "SELECT * FROM (VALUES (0, 0, 1), (0, 1, 2), (0, 2, 1), (0, 3, 2), (0, 4, 0), (0, 5, 1), (0, 6, 2), (1, 0, 0), (1, 1, 1), (1, 2, 2)) AS t(turn, place, block)")
def block_orders(spark: SparkSession, d: str) -> DataFrame:
    from ..functions.keys import KeyRange

    plan = [(1, KeyRange(0, 5)), (2, KeyRange(0, 5)), (2, KeyRange(5, 9))]
    cfg = descent.DescentConfig(shuffle=False, prior_groups=(2,), prior_rounds=2)
    made = [(turn, place, block) for turn in (0, 1) for place, block in enumerate(descent.block_order(plan, turn, cfg))]
    return spark.createDataFrame(made, "turn int, place int, block int")


@query("bounded_delay", "SELECT t.t::BIGINT AS time, d.d::BIGINT AS delay, unnest(range(greatest(0, t.t - 2 * d.d - 1), greatest(1, t.t - d.d))) AS waits_for FROM (SELECT unnest(range(8)) AS t) t, (SELECT unnest(range(3)) AS d) d")
def bounded_delay(spark: SparkSession, d: str) -> DataFrame:
    made = [(t, delay, x) for t in range(8) for delay in range(3) for x in descent.waits_for(t, delay)]
    return spark.createDataFrame(made, "time bigint, delay bigint, waits_for bigint")


@query("descent_preconditions", "SELECT * FROM (VALUES ('LOGIT', 'L1', true), ('LOGIT', 'L2', false), ('SQUARE_HINGE', 'L1', false)) AS t(loss, penalty, taken)")
def descent_preconditions(spark: SparkSession, d: str) -> DataFrame:
    def taken(loss: str, pen: str) -> bool:
        try:
            descent.DescentConfig(loss=loss, penalty=pen)
        except ValueError:
            return False
        return True

    return spark.createDataFrame([(a, b, taken(a, b)) for a, b in (("LOGIT", "L1"), ("LOGIT", "L2"), ("SQUARE_HINGE", "L1"))], "loss string, penalty string, taken boolean")


@query("nonzero_start", f"WITH {SCORED} SELECT row_id, round(exp(label * score), 4) AS dual FROM scored")
def nonzero_start(spark: SparkSession, d: str) -> DataFrame:
    e = entries(spark, d, 1, 2)
    init = e.select("key").distinct().select("key", weight(F.col("key")).alias("w"))
    model = descent.start_model(e, descent.DescentConfig(), init)
    rs = rows(spark, d)
    scores = localize.score(e, model, rs, tasks(spark, d)).withColumn("score", r("score"))
    return rs.join(scores, "row_id").select("row_id", r(F.exp(F.col("y") * F.col("score")), 4).alias("dual"))


__all__ = ["QUERIES", "SQL"]
