"""The streaming solver makes what the batch solver makes, and jobs run end to end."""

import json
import os
import shutil

import pytest
from pyspark.sql import functions as F

from keyspan.functions.objective import ElasticNet, Ftrl, LearningRate
from keyspan.operators import online
from keyspan.plans.config import Job, run
from keyspan.sources import examples
from keyspan.streaming import online as stream

LINES = [["1 1:1 2:1", "-1 2:1 3:0.5"], ["1 1:0.5", "-1 3:1"], ["1 1:1 4:1", "bad line", "-1 2:2"]]


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "in").mkdir()
    for i, lines in enumerate(LINES):
        (tmp_path / "in" / f"{i}.txt").write_text("\n".join(lines) + "\n")
        os.utime(tmp_path / "in" / f"{i}.txt", (1_000_000 + i, 1_000_000 + i))  # files of one time come in no fixed order
    return tmp_path


def test_stream_equals_supersteps(spark, folder):
    rule = Ftrl(LearningRate(0.5, 1.0), ElasticNet(0.01, 0.0))
    order = []
    q = stream.learn(spark, str(folder / "in"), "LIBSVM", rule, str(folder / "model"), str(folder / "c"), on_batch=lambda n, _: order.append(n))
    q.awaitTermination(120)
    assert order == [0, 1, 2]
    got = {r["key"]: r["w"] for r in spark.read.parquet(stream.version(str(folder / "model"), 3)).select("key", "state.w").collect()}
    batches = []
    for i in range(3):
        read = examples.read_examples(spark, str(folder / "in" / f"{i}.txt"), "LIBSVM")
        batches.append((examples.entries(read).where("slot > 0").select("row_id", "key", "val"), examples.labels(read)))
    want = {r["key"]: r["w"] for r in online.train(batches, rule).select("key", "state.w").collect()}
    assert got == pytest.approx(want) and len(got) == 4


def test_jobs(spark, folder):
    common = {"training_data": {"file": [str(folder / "in")]}, "penalty": {"type": "L1", "weights": [0.01]}}
    trained = run(spark, Job.from_json(json.dumps(common | {"online": {"minibatch": 4}, "rate": {"type": "DECAY", "alpha": 0.5}, "model_output": str(folder / "m")})))
    assert trained.where(F.col("w") != 0).count() > 0
    row = run(spark, Job.from_json(json.dumps({"validation_data": {"file": [str(folder / "in")]}, "model_input": str(folder / "m")}))).first()
    assert row["n"] == 6 and row["auc"] > 0.5
    assert run(spark, Job.from_json(json.dumps(common | {"batch": {"passes": 2}}))).count() > 0
    with pytest.raises(ValueError):
        Job.from_json('{"nothing": 1}')


def test_jobs_read_their_input_once(spark, folder, tmp_path):
    """Once the first pass or minibatch is reported, the source goes away, and the job goes on."""
    for k, options in enumerate(({"batch": {"passes": 3, "save_every": 2, "epsilon": 1e-12}}, {"online": {"minibatch": 2, "passes": 2, "tail": 1, "countmin_n": 1000}})):
        source = tmp_path / f"copy{k}"
        shutil.copytree(folder / "in", source)
        told = []

        def report(x, source=source, told=told):
            told.append(x)
            shutil.rmtree(source, ignore_errors=True)

        common = {"training_data": {"file": [str(source)]}, "penalty": {"type": "L1", "weights": [0.01]}, "model_output": str(tmp_path / f"m{k}"), "work": str(tmp_path / f"w{k}")}
        model = run(spark, Job.from_json(json.dumps(common | options)), report)
        assert model.count() > 0 and not source.exists()
        assert len(told) == (3 if k == 0 else 6)
    assert (tmp_path / "m0_it_2").exists() and not (tmp_path / "m0_it_1").exists()


def test_a_step_reads_its_own_block(spark, folder, tmp_path):
    from keyspan.functions.keys import KeyRange
    from keyspan.operators import descent

    e = spark.createDataFrame([(i, 1 + i % 2, i % 6, 1.0) for i in range(60)], "row_id long, slot int, key long, val double")
    held = descent.stored_blocks(e, [(1, KeyRange(0, 6)), (2, KeyRange(0, 3)), (2, KeyRange(3, 6))], str(tmp_path / "blocks"))
    part = held.where(F.col("block") == 1)
    assert part.count() == sum(i % 2 == 1 and i % 6 < 3 for i in range(60))
    assert all("block=1" in r[0] for r in part.select(F.input_file_name()).distinct().collect())
    assert held.where(F.col("block") == descent.NO_BLOCK).count() == 0 and held.count() == 60
