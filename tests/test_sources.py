"""Parsers, records, files and models on the awkward lines."""

import pytest
from pyspark.sql import functions as F

from keyspan.functions.keys import unsigned
from keyspan.functions.numbers import to_int
from keyspan.sources import examples, files, models, records

CASES = [
    ("LIBSVM", False, "2 3:0.5 7:1", [(0, [], [2.0]), (1, [3, 7], [0.5, 1.0])]),
    ("LIBSVM", False, "1 7:1 3:1", None),
    ("LIBSVM", False, "1 3:1 3:2", [(0, [], [1.0]), (1, [3, 3], [1.0, 2.0])]),
    ("LIBSVM", False, "1 3", None),
    ("LIBSVM", False, "", None),
    ("LIBSVM", False, "-1 1: 2:3\r", [(0, [], [-1.0]), (1, [1, 2], [0.0, 3.0])]),
    ("ADFEA", False, "9 1 1 100:5 200:5 300:6", [(0, [], [1.0]), (5, [100, 200], []), (6, [300], [])]),
    ("ADFEA", False, "9 1 0 100:5 300:6 200:5", [(0, [], [-1.0]), (5, [100], []), (6, [300], []), (5, [200], [])]),
    ("ADFEA", True, "9 1 1 100:5 300:6", [(0, [], [1.0]), (1, [100, 300], [])]),
    ("ADFEA", False, "9 1 1", [(0, [], [1.0])]),
    ("ADFEA", False, "9 1 1 5:0", None),
    ("TERAFEA", False, "1 42 | 54043195528446029", [(0, [], [1.0]), (3, [54043195528446029], [])]),
    ("SPARSE", False, "1; 2 5:0.5 6:1; 4 9:2;", [(0, [], [1.0]), (2, [5, 6], [0.5, 1.0]), (4, [9], [2.0])]),
    ("SPARSE_BINARY", False, "0; 2 5 6;", [(0, [], [-1.0]), (2, [5, 6], [])]),
    ("DENSE", False, "1; 1 0.5 0.25", [(0, [], [1.0]), (1, [], [0.5, 0.25])]),
    ("SPARSE_BINARY", True, "1; 2 5 6; 4 9", [(0, [], [1.0]), (1, [5, 6, 9], [])]),
    ("SPARSE", False, "x; 1 2", None),
    ("SPARSE", False, "1.5; 1 2", None),
    ("SPARSE_BINARY", False, "1; 5000 1", None),
]


@pytest.mark.parametrize(("fmt", "ignore", "line", "want"), CASES)
def test_lines(spark, fmt, ignore, line, want):
    row = examples.parse_lines(spark.createDataFrame([(1, line)], "row_id long, value string"), fmt, ignore).first()
    assert row["ok"] == (want is not None)
    if want:
        assert [(s["id"], s["keys"], s["vals"]) for s in row["slots"]] == want


def test_null_line_is_rejected(spark):
    lines = spark.createDataFrame([(1, None)], "row_id long, value string")
    assert not any(examples.parse_lines(lines, f).first()["ok"] for f in ("LIBSVM", "ADFEA", "TERAFEA", "SPARSE", "CRITEO"))


def test_criteo(spark):
    counts = ["4", "1"] + [""] * 10 + ["0"]
    words = ["68fd1e64", "80e26c9b", "abcd"] + ["fb936136"] * 23
    lines = spark.createDataFrame([(1, "\t".join(["1", *counts, *words])), (2, "\t".join(["0", "-1", *counts[1:], *words])), (3, "1\t2")], "row_id long, value string")
    found = {r["row_id"]: r for r in examples.parse_lines(lines, "CRITEO").collect()}
    keys = {s["id"]: [unsigned(k) for k in s["keys"]] for s in found[1]["slots"]}
    assert keys[1] == [4] and keys[2] == [1418980313362273202] and keys[13] == [17027763760347278412]
    assert keys[14] == [1233128445504940974] and keys[15] == [9465419651991975025] and 16 not in keys
    assert keys[17] == [15578302193590252556]
    assert unsigned(found[2]["slots"][1]["keys"][0]) == 18446744073709551615 and not found[3]["ok"]
    merged = examples.parse_lines(lines.where("row_id = 1"), "CRITEO", True).first()["slots"]
    assert [s["id"] for s in merged] == [0, 1] and len(merged[1]["keys"]) == 13 + 25


def test_read_examples_and_entries(spark, tmp_path):
    (tmp_path / "part.1").write_text("1 1:2 5:3\nbad\n-1 2:1\n1 9:9\n")
    read = examples.read_examples(spark, str(tmp_path), "LIBSVM", kernel=4, max_lines=3)
    assert examples.labels(read).agg(F.sum("y")).first()[0] == 0.0
    assert sorted((r["key"], r["val"]) for r in examples.entries(read).where("slot = 1").collect()) == [(1, 2.0), (1, 3.0), (2, 1.0)]


def test_first_lines_of_a_text_in_parts(spark, tmp_path):
    """The limit counts over the parts in order of names, whatever their sizes, without putting them into one file."""
    for k, n in enumerate((3, 0, 2, 40)):
        (tmp_path / f"part-{k}").write_text("".join(f"1 {10 * k + i + 1}:1\n" for i in range(n)))
    for limit, want in ((2, [1, 2]), (5, [1, 2, 3, 21, 22]), (7, [1, 2, 3, 21, 22, 31, 32])):
        read = examples.read_examples(spark, str(tmp_path), "LIBSVM", max_lines=limit, one_text=True)
        assert sorted(r["key"] for r in examples.entries(read).where("slot = 1").collect()) == want


def test_rehash(spark):
    line = spark.createDataFrame([(1, "1 42 | 12345")], "row_id long, value string")
    slots = examples.parse_lines(line, "TERAFEA", True, rehash=True).first()["slots"]
    assert unsigned(slots[1]["keys"][0]) == 11238047913958135678


def test_records_round_trip(spark, tmp_path):
    slots = [{"id": 0, "keys": [], "vals": [1.0]}, {"id": 7, "keys": [3, -1], "vals": [0.5, 2.0]}, {"id": 9, "keys": [1 << 40], "vals": []}]
    raw = b"".join(records.frame(records.encode_example(slots)) for _ in range(3))
    (tmp_path / "x.recordio").write_bytes(raw + raw[:20])  # the last is cut short
    got = records.read_records(spark, str(tmp_path / "x.recordio")).collect()
    assert len(got) == 3 and [s.asDict() for s in got[0]["slots"]] == slots


def test_many_small_record_files(spark):
    """Files of a batch are decoded together, and one without content has no records."""
    one = records.frame(records.encode_example([{"id": 3, "keys": [5, -2], "vals": [0.25, -4.0]}]))
    files = spark.createDataFrame([(str(i), None if i % 3 == 2 else bytearray(one * (i % 3 + 1))) for i in range(3000)], "file string, content binary")
    found = records.decode_records(files).select("file", "seq", F.expr("slots[0].keys[1]").alias("key"), F.expr("slots[0].vals[1]").alias("val")).collect()
    assert sorted((int(r["file"]), r["seq"]) for r in found) == sorted((i, k) for i in range(3000) if i % 3 < 2 for k in range(i % 3 + 1))
    assert {(r["key"], r["val"]) for r in found} == {(-2, -4.0)}


def test_arrays_and_matrices(spark, tmp_path):
    import numpy as np

    for name, dtype, data in (("offset", "<u8", [0, 2, 2, 3]), ("index", "<u4", [1, 4, 0]), ("value", "<f8", [0.5, 1.5, 2.0])):
        (tmp_path / f"m.{name}").write_bytes(np.array(data, dtype).tobytes())
    found = records.read_matrix(spark, str(tmp_path / "m"))
    assert sorted(tuple(r) for r in found.collect()) == [(0, 1, 0.5), (0, 4, 1.5), (2, 0, 2.0)]
    part = records.read_array(spark, str(tmp_path / "m.value"), "<f8", 1, 3)
    assert sorted((r["idx"], r["value"]) for r in part.collect()) == [(1, 1.5), (2, 2.0)]


def test_files(spark, tmp_path):
    for n in ("part.2", "part.1", "other", "part.x.gz"):
        (tmp_path / n).write_text("")
    found = files.search_files(spark, [f"{tmp_path}/part\\..*", f"{tmp_path}/part\\.1"])
    assert [f.rpartition("/")[2] for f in found] == ["part.1", "part.2", "part.x.gz"]
    assert files.divide_files(list("abcde"), 2) == [["a", "c", "e"], ["b", "d"]] and files.divide_files(list("abcde"), 2, 1) == [["a"], ["b"]]
    assert sorted(files.epochs(["a", "b"], 2, True)) == ["a", "a", "b", "b"] and files.append_files(["a"], ["b"]) == ["a", "b"]


def test_models(spark, tmp_path):
    model = spark.createDataFrame([(1, 0.5), (-1, 2.0), (2, 0.0), (3, float("nan"))], "key long, w double")
    models.write_model(model, str(tmp_path / "m"), 4)
    assert {(r["key"], r["w"]) for r in models.read_model(spark, str(tmp_path / "m_it_4")).collect()} == {(1, 0.5), (-1, 2.0)}
    lines = spark.createDataFrame([(0, "5\t1"), (1, "x y"), (2, "5 2"), (3, "6")], "line long, value string")
    assert [tuple(r) for r in models.parse_model(lines).collect()] == [(5, 2.0)]


def test_categories_are_hashed_once_and_entries_are_compiled(spark, monkeypatch):
    import pandas as pd

    asked = []
    real = examples.category_keys
    monkeypatch.setattr(examples, "category_keys", lambda texts: asked.extend(texts) or real(texts))
    found = examples._category_keys.func(pd.Series([["abcdef", "abc", None], None, ["abcdef", "\u00e9\u00e9\u00e9", "ghijk"]])).tolist()
    key = lambda t: real([t.encode()]).tolist()
    assert found == [[key("abcdef"), [], []], [], [key("abcdef"), key("\u00e9\u00e9\u00e9"), key("ghijk")]]
    assert sorted(asked) == sorted(t.encode() for t in ("abcdef", "\u00e9\u00e9\u00e9", "ghijk"))
    parsed = spark.createDataFrame([(1, [(0, [], [1.0]), (3, [7, 8], []), (4, [9], [0.5]), (5, [], [])])], f"row_id long, slots {examples.SLOTS}")
    flat = examples.entries(parsed)
    assert sorted(map(tuple, flat.collect())) == [(1, 0, 0, 0, 0, 1.0), (1, 1, 3, 0, 7, 1.0), (1, 1, 3, 1, 8, 1.0), (1, 2, 4, 0, 9, 0.5)]
    assert "lambdafunction" not in flat._jdf.queryExecution().optimizedPlan().toString()


def test_plain_integers_need_no_pattern(spark):
    texts = ["", "0", "-0", "+5", " 7", "7 ", "007", "-12", "2147483647", "2147483648", "1.0", "x", None]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select(to_int(F.col("t"))).collect()
    assert [r[0] for r in rows] == [0, 0, 0, 5, 7, None, 7, -12, 2147483647, None, None, None, None]


def test_criteo_lines_are_dealt_to_tasks_that_grow_with_the_table(spark, monkeypatch):
    from keyspan.plans import text_queries

    monkeypatch.setattr(text_queries, "tasks", lambda *_: 7, raising=False)
    for name in ("parse_criteo_full", "parse_criteo_ints"):
        assert text_queries.QUERIES[name](spark, "/root/testdata/sf0.001").rdd.getNumPartitions() == 7  # 1 before


def test_criteo_rows_of_all_kinds_in_one_batch(spark):
    words = ["", "abcd", "abcde", "äö", "äöü", "日本", "x" * 40]
    rows = [None, "", "1\t2", "\t".join(["1", *["3"] * 13, *[words[i % 7] for i in range(26)]]), "\t".join(["0"] * 14 + [""] * 26), "\t".join(["1", *["5"] * 13, *["longer"] * 40])]
    lines = spark.createDataFrame(list(enumerate(rows)), "row_id long, value string").coalesce(1)
    found = {r["row_id"]: [s["id"] for s in r["slots"] if s["id"] > 13] if r["ok"] else None for r in examples.parse_lines(lines, "CRITEO").collect()}
    named = [14 + i for i in range(26) if len(words[i % 7].encode()) > 4]
    assert found == {0: None, 1: None, 2: None, 3: named, 4: [], 5: list(range(14, 40))}
