"""Values that follow from the definitions."""

import math
import random

import pytest
from pyspark.sql import functions as F

from keyspan.functions import hashing, keys, numbers, objective, transfer
from keyspan.operators import descent, evaluate, linalg, localize, online, profile, sketch, store
from keyspan.plans import catalogue, solver_queries, tables


def test_hashes(spark):
    df = spark.createDataFrame([(0,), (1,), (2,), (12345678901234,), (-1,)], "key long")
    assert [r[0] for r in df.select(hashing.sketch_hash(F.col("key"))).collect()] == [1901488498, 3074456014, 3636564896, 2211112458, 716976191]
    few = df.limit(3)
    assert [r[0] for r in few.select(hashing.probes(F.col("key"), 64, 2)).collect()] == [[50, 29], [14, 46], [32, 0]]
    assert [r[0] for r in few.select(hashing.probes(F.col("key"), 1000, 3)).collect()] == [[498, 397, 296], [14, 246, 182], [896, 248, 600]]
    assert hashing.crc32c_of([b"123456789", b"", b"1"])[:2].tolist() == [0xE3069283, 0]
    h1, h2 = hashing.murmur3_x64_128([b"hello", b"x" * 33, b""], 0)
    assert (int(h1[0]), int(h2[0])) == (0xCBD8A7B341BD9B02, 0x5B1E906A48AE1D19) and (int(h1[2]), int(h2[2])) == (0, 0)


def test_ranges_tile():
    for n in (1, 3, 7, 64):
        parts = keys.KeyRange.all().divide(n)
        assert parts[0].begin == 0 and parts[-1].end == keys.TOP - 1 and all(a.end == b.begin for a, b in zip(parts, parts[1:]))
    r = keys.KeyRange(2, 7)
    assert r.intersect(keys.KeyRange(5, 9)) == keys.KeyRange(5, 7) and r.hull(keys.KeyRange(9, 10)) == keys.KeyRange(2, 10)
    assert (r.project(1), r.project(4), r.project(9)) == (2, 4, 7) and 6 in r and 7 not in r and r.shift(1).scale(2) == keys.KeyRange(6, 16)


def test_keys(spark):
    df = spark.createDataFrame([("18446744073709551615",), ("-1",), ("99999999999999999999",), ("7",)], "s string")
    assert [r[0] for r in df.select(keys.parse_key(F.col("s"))).collect()] == [-1, -1, -1, 7]
    assert [int(r[0]) for r in df.select(keys.format_key(keys.parse_key(F.col("s")))).collect()] == [keys.TOP - 1] * 3 + [7]
    last = keys.KeyRange.all().divide(4)
    assert [r[0] for r in df.select(keys.range_index(keys.parse_key(F.col("s")), last)).collect()] == [3, 3, 3, 0]


def test_numbers(spark):
    df = spark.createDataFrame([("",), (" 5",), ("5 ",), ("x",), ("3000000000",), ("1e3",), (None,)], "s string")
    s = F.col("s")
    assert [r[0] for r in df.select(numbers.to_int(s)).collect()] == [0, 5, None, None, None, None, None]
    assert [r[0] for r in df.select(numbers.to_float(s)).collect()] == [0.0, 5.0, None, None, 3e9, 1000.0, None]


def test_sketch_never_underestimates(spark):
    rng = random.Random(1)
    counts = spark.createDataFrame([(k, rng.randint(1, 300)) for k in range(500)], "key long, cnt long")
    est = sketch.query(counts, sketch.insert(counts, 200, 2), 200, 2).join(counts, "key")
    assert est.where("est < least(cnt, 254)").count() == 0
    one = spark.createDataFrame([(5,)] * 300, "key long")
    capped = profile.key_counts(one, 255)
    assert capped.first()["cnt"] == 255 and sketch.query(capped, sketch.insert(capped, 64, 2), 64, 2).first()["est"] == 254


def test_sets_and_ranges(spark):
    df = lambda xs: spark.createDataFrame([(x,) for x in xs], "key long")
    got = lambda d: sorted(r[0] for r in d.collect())
    assert got(localize.key_union(df([3, 5, 8, 10]), df([5, 9, 10, 11]))) == [3, 5, 8, 9, 10, 11]
    assert got(localize.key_intersection(df([1, 2, 3, 5, 6, 7, 8]), df([3, 4, 7, 10]))) == [3, 7]
    assert tuple(localize.lookup_range(df([1, 3, 5, 7, 9]), 2, 7).first()) == (1, 3)
    assert {r["key"]: r["rank"] for r in localize.dictionary(df([5, -1, 0, 5, 2]), 3).collect()} == {0: 0, 2: 1, 5: 2, -1: 3}
    assert localize.dictionary(df([])).count() == 0


def test_vector_store(spark):
    table = spark.createDataFrame([(0, k, [float(i + 1)]) for i, k in enumerate([0, 1, 3, 4, 5])], "channel int, key long, value array<double>")
    held = store.VectorStore(table)
    pull = lambda ks: {r["key"]: r["value"][0] for r in held.pull(spark.createDataFrame([(0, k) for k in ks], "channel int, key long")).collect()}
    assert pull([0, 2, 4, 5]) == {0: 1, 2: 0, 4: 4, 5: 5} and pull([0, 1, 3, 4]) == {0: 1, 1: 2, 3: 3, 4: 4}
    rows = [(7, s, 0, k, a, b) for s, ks in ((0, [0, 2, 4, 5]), (1, [0, 1, 3, 4])) for k in ks for a, b in [(1.0, 3.0), (3.0, 5.0)][:1]]
    sums = held.push_buffered(spark.createDataFrame(rows, "ts long, sender int, channel int, key long, v0 double, v1 double"))
    assert {r["key"]: (r["v0"], r["v1"], r["n_senders"]) for r in sums.collect()} == {0: (2, 6, 2), 1: (1, 3, 1), 3: (1, 3, 1), 4: (2, 6, 2), 5: (1, 3, 1)}
    unknown = spark.createDataFrame([(0, 2, [1.0])], "channel int, key long, value array<double>")
    assert held.unmatched(unknown).count() == 1 and held.push(unknown).table.agg(F.sum(F.col("value")[0])).first()[0] == 15


def test_layers(spark):
    pushes = spark.createDataFrame([(layer, i, 1.0) for _ in range(3) for layer, n in ((0, 5), (1, 10), (2, 4)) for i in range(n)], "layer int, idx long, value double")
    assert {r["value"] for r in store.LayerStore().push(pushes).table.collect()} == {3.0}


def test_map_fold_in_batches_equals_one_fold(spark):
    rng = random.Random(4)
    rule = objective.Ftrl(objective.LearningRate(0.1, 1.0), objective.ElasticNet(0.05, 0.1))
    pushes = spark.createDataFrame([(k % 3, i, rng.uniform(-1, 1)) for i, k in enumerate(range(90))], "key long, at long, g double")
    held = store.MapStore(rule.start(), rule.step, objective.FTRL_STATE)
    whole = {r["key"]: r["state"].asDict() for r in held.fold(pushes, "g", ["at"]).collect()}
    parts = {r["key"]: r["state"].asDict() for r in held.fold_batches([pushes.where("at < 40"), pushes.where("at >= 40")], "g", ["at"]).collect()}
    assert whole == parts
    w = z = n = 0.0
    for r in sorted(pushes.where("key = 1").collect(), key=lambda r: r["at"]):
        new = math.sqrt(n * n + r["g"] ** 2)
        z, n = z + r["g"] - (new - n) / 0.1 * w, new
        eta = 0.1 / (n + 1)
        u = -z * eta
        w = math.copysign(max(abs(u) - 0.05 * eta, 0), u) / (1 + 0.1 * eta)
    assert whole[1]["w"] == pytest.approx(w)


def test_prox_and_gradients(spark):
    net = objective.ElasticNet(1.0, 0.0)
    z = spark.createDataFrame([(0.4,), (1.0,), (-1.0,)], "z double")
    assert [r[0] for r in z.select(net.prox(F.col("z"), 0.5)).collect()] == [0.0, 0.5, -0.5]
    assert z.where("z = 1").select(objective.ElasticNet(1.0, 2.0).prox(F.col("z"), 0.5)).first()[0] == 0.25
    ym = spark.createDataFrame([(y, m / 3) for y in (1.0, -1.0) for m in range(-9, 10)], "y double, m double")
    for loss in (objective.Logit(), objective.SquaredHinge(), objective.Square()):
        y, m, h = F.col("y"), F.col("m"), 1e-6
        slope = (loss.value(y, m + h) - loss.value(y, m - h)) / (2 * h)
        assert ym.select(F.max(F.abs(slope - loss.slope(y, m)))).first()[0] < 1e-5


def test_quantise(spark):
    df = spark.createDataFrame([(100.0,), (0.1,), (-100.0,)], "x double")
    q = transfer.FixedPoint(-90.0, 90.0, 3)
    out = [r[0] for r in df.select(q.decode(q.encode(F.col("x")))).collect()]
    assert out[0] == 90 and out[2] == -90 and abs(out[1] - 0.1) <= 180 / (2**24 - 2)
    assert bytes(df.limit(1).select(q.to_bytes(q.encode(F.col("x")))).first()[0]) == (2**24 - 2).to_bytes(3, "little")
    noisy = transfer.FixedPoint(-90.0, 90.0, 3, seed=1)
    assert all(0 <= r["a"] - r["b"] <= 1 for r in df.select(noisy.encode(F.col("x")).alias("a"), q.encode(F.col("x")).alias("b")).collect())


def test_auc(spark):
    df = lambda rows: spark.createDataFrame(rows, "label double, score double")
    four = [(1.0, 0.9), (-1.0, 0.8), (1.0, 0.7), (-1.0, 0.1)]
    assert evaluate.auc(df(four), reflect=False).first()[0] == 0.75
    assert evaluate.auc(df([(y, 1.0) for y, _ in four])).first()[0] == 0.5
    assert evaluate.auc(df([(1.0, 0.5)])).first()[0] is None
    rng = random.Random(9)
    rows = [(rng.choice([1.0, -1.0]), rng.randint(0, 30) / 7) for _ in range(200)]
    pairs = [(a > b) + 0.5 * (a == b) for y, a in rows if y > 0 for t, b in rows if t < 0]
    assert evaluate.auc(df(rows), reflect=False).first()[0] == pytest.approx(sum(pairs) / len(pairs))


def test_transposing_twice_and_blocks(spark):
    m = spark.createDataFrame([(r, c, float(r * c)) for r in range(6) for c in range(r)], "row long, col long, val double")
    assert linalg.row_major(linalg.column_major(m)).exceptAll(m).count() == 0
    assert linalg.row_block(m, 2, 4).count() == 5 and linalg.col_block(m, 0, 2).count() == 9


def test_descent_lowers_the_objective(spark):
    rng = random.Random(8)
    rows, entries = [], []
    for i in range(120):
        xs = [(k, rng.choice([1.0, 0.5])) for k in rng.sample(range(8), 3)]
        y = 1.0 if sum(v * (1 if k < 4 else -1) for k, v in xs) + rng.uniform(-0.5, 0.5) > 0 else -1.0
        rows.append((i, y))
        entries += [(i, 1, k, v) for k, v in xs]
    e, r = spark.createDataFrame(entries, "row_id long, slot int, key long, val double"), spark.createDataFrame(rows, "row_id long, y double")
    plan = descent.block_plan([(0, 0, 1, 120, 120), (1, 0, 8, 360, 120)], 0.5)
    assert len(plan) == 2
    seen = []
    model = descent.train(e, r, plan, descent.DescentConfig(l1=1.0, passes=4, epsilon=1e-9), seen.append)
    values = [p.objective for p in seen]
    assert all(b <= a + 1e-9 for a, b in zip(values, values[1:])) and values[-1] < 120 * math.log(2)
    assert {k for k, w in model.select("key", "w").collect() if w > 0} <= {0, 1, 2, 3}
    with pytest.raises(ValueError):
        descent.DescentConfig(loss="HINGE")


def test_block_order_and_waits():
    plan = [(1, keys.KeyRange(0, 5)), (2, keys.KeyRange(0, 5))]
    cfg = descent.DescentConfig(prior_groups=(2,), prior_rounds=2)
    assert descent.block_order(plan, 0, cfg)[:2] == [1, 1] and sorted(descent.block_order(plan, 1, cfg)) == [0, 1]
    assert list(descent.waits_for(5, 0)) == [4] and list(descent.waits_for(5, 1)) == [2, 3]


def test_progress(spark):
    before, after = (spark.createDataFrame(x, "key long, w double") for x in ([(1, 1.0), (2, 0.5)], [(1, 0.0), (2, 1.0), (3, 2.0)]))
    assert tuple(online.weight_change(before, after).first()) == (0, 5.0, 5.25)


def test_dictionary_and_auc_with_clustered_and_far_values(spark):
    ks = [k for base in (0, 1 << 40, (1 << 62) + 5) for k in range(base, base + 300)] + [-1, -(1 << 63)]
    found = {r["key"]: r["rank"] for r in localize.dictionary(spark.createDataFrame([(k,) for k in ks * 2], "key long"), 16).collect()}
    assert found == {k: i for i, k in enumerate(sorted(ks, key=lambda k: k % (1 << 64)))}
    rng = random.Random(2)
    rows = [(rng.choice([1.0, -1.0]), rng.randint(0, 400) / 1e6) for _ in range(500)] + [(1.0, 1e9)]
    pairs = [(a > b) + 0.5 * (a == b) for y, a in rows if y > 0 for t, b in rows if t < 0]
    assert evaluate.auc(spark.createDataFrame(rows, "label double, score double"), reflect=False).first()[0] == pytest.approx(sum(pairs) / len(pairs))


def test_number_rows_over_gaps(spark):
    ids = [3, 7, 8, (1 << 20) - 1, 1 << 20, (1 << 33) + 2, (5 << 33) + 1]
    df = spark.createDataFrame([(i, g) for i in ids for g in "ab"], "row_id long, g string").repartition(3)
    assert {(r["row_id"], r["g"]): r["n"] for r in online.number_rows(df, by=("g",)).collect()} == {(i, g): k for k, i in enumerate(ids, 1) for g in "ab"}
    assert sorted((r["row_id"], r["batch"]) for r in online.with_batch(df.where("g = 'a'"), 3).collect()) == [(i, k // 3) for k, i in enumerate(ids)]


def test_fold_in_rounds_equals_one_fold(spark):
    rule = objective.AdaGrad(objective.LearningRate(0.1, 1.0), objective.ElasticNet(0.05, 0.1))
    pushes = spark.createDataFrame([(0 if i % 4 else 1, i, math.sin(i)) for i in range(80)], "key long, at long, g double")
    held = store.MapStore(rule.start(), rule.step, objective.ADAGRAD_STATE)
    one, rounds = ({r["key"]: r["state"].asDict() for r in d.collect()} for d in (held.fold(pushes, "g", ["at"]), held.fold_all(pushes, "g", ["at"], most=7)))
    assert one == rounds


def test_quantise_within_own_limits(spark):
    q = transfer.FixedPoint.of(spark.createDataFrame([(2.0,), (-1.0,), (None,)], "x double"), "x", 2)
    assert (q.low, q.high) == (-1.0, 2.0)
    one = transfer.FixedPoint.of(spark.createDataFrame([(5.0,)], "x double"), "x")
    assert (one.low, one.high) == (5.0, 6.0) and transfer.FixedPoint.of(spark.createDataFrame([], "x double"), "x").high == 1.0


def test_long_keys_do_not_pad_others():
    keys = [b"a", b"x" * 3_000_000, b"bc"] * 2
    h1, h2 = hashing.murmur3_x64_128(keys, 1)
    for i, k in enumerate(keys):
        one = hashing.murmur3_x64_128([k], 1)
        assert (h1[i], h2[i]) == (one[0][0], one[1][0])
    assert len(hashing._by_length(keys)) > 1


def test_literal_step_where_margins_are_one(spark, tmp_path):
    """Margins of exactly 1 in hundredths: the sum's rounding decides, as in SQL, in whatever order rows are shuffled."""
    import random

    import duckdb
    import pandas as pd

    from keyspan.plans import catalogue
    from keyspan.plans.tables import SPACE

    rng, lines = random.Random(3), []
    hundredths = lambda slot, k: (slot * SPACE + k) % 101 - 50
    while len(lines) < 2400:
        own = [(rng.randrange(2000), rng.randrange(500)) for _ in range(4)]
        if sum(hundredths(1, p) + hundredths(2, s) for p, s in own) == 100:
            lines += [(len(lines) // 4, p, s, i + 1, 50.0) for i, (p, s) in enumerate(own)]
    con = duckdb.connect()
    pd.DataFrame(lines, columns=["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity"]).to_parquet(tmp_path / "lineitem.parquet")
    pd.DataFrame([(i, "F") for i in range(len(lines) // 4)], columns=["o_orderkey", "o_orderstatus"]).to_parquet(tmp_path / "orders.parquet")
    for t in ("lineitem", "orders"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet'")
    want = dict(con.execute(catalogue.SQL["sqhinge_grad_literal"]).fetchall())
    assert {r["key"]: r["g"] for r in catalogue.QUERIES["sqhinge_grad_literal"](spark, str(tmp_path)).collect()} == want


def test_common_keys_are_told_by_broadcast_and_others_meet_in_as_many_tasks_as_asked(spark):
    e = spark.createDataFrame([(i, i % 7 if i < 3_000 else 10 + i, 1.0) for i in range(5_000)], "row_id long, key long, val double")
    ranks = localize.dictionary(e.where("key <> 3").select("key"), 4)
    common = localize.common_keys(profile.key_counts(e))
    assert sorted(r["key"] for r in common.collect()) == list(range(7))
    told, plain = localize.remap(e, ranks, 3, common), localize.remap(e, ranks)
    want = sorted(tuple(r) for r in plain.select("row_id", "key", "val", "idx").collect())
    assert sorted(tuple(r) for r in told.select("row_id", "key", "val", "idx").collect()) == want and len(want) == 5_000 - sum(i % 7 == 3 for i in range(3_000))
    rows = spark.range(6_000).select(F.col("id").alias("row_id"))
    found = localize.row_offsets(rows, told, 3)
    assert sorted(tuple(r) for r in found.collect()) == sorted(tuple(r) for r in localize.row_offsets(rows, plain).collect())
    assert localize.common_keys(profile.key_counts(e.limit(0))).collect() == []


@pytest.mark.parametrize("name", ["row_offsets", "scores", "nonzero_start"])
def test_tasks_grow_with_the_tables_whatever_the_session_says(spark, monkeypatch, tmp_path, name):
    spark.range(10).select(F.rand(1)).coalesce(1).write.parquet(str(tmp_path / "lineitem.parquet"))
    assert tables.tasks(spark, str(tmp_path)) == spark.sparkContext.defaultParallelism
    monkeypatch.setattr(catalogue, "tasks", lambda *_: 7)
    monkeypatch.setattr(solver_queries, "tasks", lambda *_: 7)
    ours = {"spark.sql.shuffle.partitions": 2, "spark.sql.autoBroadcastJoinThreshold": -1}
    before = {k: spark.conf.get(k) for k in ours}
    for k, v in ours.items():
        spark.conf.set(k, v)
    try:
        assert catalogue.QUERIES[name](spark, "/root/testdata/sf0.001").rdd.getNumPartitions() == 7  # 1 or 2 before
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_slots_are_written_in_tasks_that_grow_with_the_table(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(solver_queries, "tasks", lambda *_: 7, raising=False)
    monkeypatch.setattr(solver_queries, "scratch", lambda _, name: str(tmp_path / name))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", 2)
    try:
        (found,) = catalogue.QUERIES["slot_cache"](spark, "/root/testdata/sf0.001").collect()
        lines = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet").select("l_orderkey", "l_linenumber")
        want = lines.join(spark.read.parquet("/root/testdata/sf0.001/orders.parquet").select(F.col("o_orderkey").alias("l_orderkey")), "l_orderkey")
        assert (found["n"], found["n_keys"]) == (want.count(), want.select("l_linenumber").distinct().count())
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert len(list((tmp_path / "slots" / "slot=3").glob("*.parquet"))) > 2  # 1 or 2 before
    assert len(list((tmp_path / "slots-text").glob("part-*"))) == 7
