import json
import os

import pytest

from pyspark.sql import functions as F

from actiscope.operators import sampling
from actiscope.operators.guards import finite_drops
from actiscope.plans.generate import build_records, write_counted
from actiscope.schema import LAYER_STATE_SCHEMA
from actiscope.session import broadcast_if_small, work_root
from actiscope.sources import instructions, records, sinks, tables
from actiscope.streaming import incremental


def some_states(spark, ids, layers=2):
    rows = [(g, k, [float(g), 1.0, 2.0], [float(k), -1.0, float(g)]) for g in ids for k in range(layers)]
    return spark.createDataFrame(rows, LAYER_STATE_SCHEMA)


def test_empty_and_missing_directories(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        records.scan_records(spark, str(tmp_path))
    with pytest.raises(FileNotFoundError):
        records.scan_records(spark, str(tmp_path / "nowhere"))
    (tmp_path / "resume_state.json").write_text("{}")
    with pytest.raises(FileNotFoundError):
        records.scan_records(spark, str(tmp_path))


def test_parts_are_bounded_and_appended(spark, tmp_path):
    sink = str(tmp_path / "sink")
    sinks.write_records(build_records(some_states(spark, range(20))).coalesce(1), sink, 60)
    first = {f for f in os.listdir(sink) if f.endswith(".parquet")}
    (tmp_path / "sink" / "resume_state.json").write_text(json.dumps({"last": 1}))
    sinks.write_records(build_records(some_states(spark, range(20, 30))), sink, 60)
    assert first < set(os.listdir(sink))
    parts = records.scan_records(spark, sink, locate=True).groupBy("file_path").count().collect()
    assert max(p["count"] for p in parts) <= 60 and sum(p["count"] for p in parts) == 300


def test_only_asked_columns_are_read(spark, tmp_path):
    sink = str(tmp_path / "sink")
    sinks.write_records(build_records(some_states(spark, range(3))), sink)
    plan = records.scan_labels(spark, sink)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<layer_index:int,label:int>" in plan
    plan = records.filter_layer(records.scan_records(spark, sink), 1)._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(layer_index,1)" in plan


def test_by_layer_folders(spark, tmp_path):
    sink = str(tmp_path / "sink")
    sinks.write_records(build_records(some_states(spark, range(4), 3)), sink, by_layer=True)
    assert {f for f in os.listdir(sink) if "=" in f} == {f"layer_index={k}" for k in range(3)}
    back = records.scan_records(spark, sink)
    assert back.count() == 60 and back.where("layer_index = 2").count() == 20


@pytest.mark.parametrize("by_layer", [False, True])
def test_fetch_by_address(spark, tmp_path, by_layer):
    sink = str(tmp_path / "a sink")
    sinks.write_records(build_records(some_states(spark, range(10))), sink, 15, by_layer=by_layer)
    wanted = records.row_locator(spark, sink).where("label = 2")
    got = records.fetch_rows(spark, sink, wanted).collect()
    assert len(got) == 20 and {r.label for r in got} == {2} and {r.layer_index for r in got} == {0, 1}
    assert all(r.sample_id == f"{r.instruction_id:05d}_L{r.layer_index:03d}_T2" for r in got)


def test_sample_by_address(spark, tmp_path):
    sink = str(tmp_path / "sink")
    sinks.write_records(build_records(some_states(spark, range(20))), sink, 15)
    drawn = sorted(r.sample_id for r in records.sample_records(spark, sink, 50).collect())
    whole = sampling.stratified_sample(records.scan_records(spark, sink), n_samples=50)
    assert len(drawn) == 50 and drawn == sorted(r.sample_id for r in whole.collect())


def test_resume_finds_any_missing_instruction(spark, tmp_path):
    sink = str(tmp_path / "sink")
    everything = some_states(spark, range(10))
    sinks.write_records(build_records(everything.where("instruction_id in (0, 5, 9)")), sink)
    incremental.resume_generation(everything, sink)
    got = records.scan_records(spark, sink)
    assert got.count() == 100 and got.select("sample_id").distinct().count() == 100
    incremental.resume_generation(everything, sink)
    assert records.scan_records(spark, sink).count() == 100


def test_resume_adds_missing_layers_and_labels(spark, tmp_path):
    sink, everything = str(tmp_path / "sink"), some_states(spark, range(4), 3)
    part = build_records(everything).where("not (instruction_id = 0 and layer_index = 1) and not (instruction_id = 2 and layer_index = 0 and label = 3)")
    sinks.write_records(part.where("instruction_id < 3"), sink)
    incremental.resume_generation(everything, sink)
    got = sorted(map(str, records.scan_records(spark, sink).collect()))
    assert got == sorted(map(str, build_records(everything).collect()))


def test_stream_gives_the_batch_result_however_files_arrive(spark, tmp_path):
    states = some_states(spark, range(6), 3).selectExpr(
        "instruction_id", "layer_index", "input_vec", "if(instruction_id = 2 and layer_index = 1, array(float(1)), output_vec) as output_vec"
    )
    want = sorted(map(str, build_records(states).collect()))
    for n, order in enumerate(([0, 1, 2], [1, 2, 0], [2, 0, 1])):
        source, sink, state = (str(tmp_path / f"{d}{n}") for d in ("in", "out", "state"))
        for layer in order:
            states.where(f"layer_index = {layer}").write.mode("append").parquet(source)
            incremental.stream_generation(spark, source, sink, state)
        assert sorted(map(str, incremental.streamed_records(spark, sink).collect())) == want


def test_copies_of_a_key_are_chosen_by_rule(spark):
    rows = [(1, 0, [2.0], [1.0]), (1, 0, [1.0], [9.0]), (1, 1, [0.0], [0.0])]
    got = incremental.once(spark.createDataFrame(rows, LAYER_STATE_SCHEMA).repartition(3)).collect()
    assert sorted((r.layer_index, r.input_vec) for r in got) == [(0, [1.0]), (1, [0.0])]


@pytest.mark.parametrize("max_rows", [0, 4, 100])
def test_pending_by_either_list(spark, max_rows):
    everything = some_states(spark, range(10), 1)
    done = spark.createDataFrame([(i,) for i in range(7)], "instruction_id int")
    todo = incremental.pending_states(everything, done, max_rows=max_rows)
    assert sorted(r.instruction_id for r in todo.collect()) == [7, 8, 9]


def test_stream_restarts_and_redelivery(spark, tmp_path):
    source, sink, state = (str(tmp_path / d) for d in ("in", "out", "state"))
    some_states(spark, range(6)).write.parquet(source)
    incremental.stream_generation(spark, source, sink, state, files_per_batch=1)
    assert records.scan_records(spark, sink).count() == 60
    incremental.stream_generation(spark, source, sink, state)
    assert records.scan_records(spark, sink).count() == 60
    some_states(spark, range(3, 9)).unionByName(some_states(spark, [8])).coalesce(1).write.mode("append").parquet(source)
    incremental.stream_generation(spark, source, sink, state)
    got = records.scan_records(spark, sink)
    assert got.count() == 90 and got.select("sample_id").distinct().count() == 90


def test_the_sink_is_read_once_per_start(spark, tmp_path, monkeypatch):
    """Three batches of one file each; what a batch run wrote before the stream, in part, is not written again."""
    source, sink, state = (str(tmp_path / d) for d in ("in", "out", "state"))
    reads, sink_rows = [], incremental.sink_rows
    monkeypatch.setattr(incremental, "sink_rows", lambda *a: reads.append(1) or sink_rows(*a))
    before = build_records(some_states(spark, [1, 7])).where("not (instruction_id = 7 and label > 2)")
    sinks.write_records(before, sink)
    for ids in ([0, 1], [2, 3], [7, 8]):
        some_states(spark, ids).coalesce(1).write.mode("append").parquet(source)
    query = incremental.stream_generation(spark, source, sink, state, files_per_batch=1)
    assert len([p for p in query.recentProgress if p.numInputRows]) == 3 and len(reads) == 2
    want = build_records(some_states(spark, [0, 1, 2, 3, 7, 8])).collect()
    assert sorted(map(str, records.scan_records(spark, sink).collect())) == sorted(map(str, want))


def test_bounded_memory_of_a_stream(spark, tmp_path):
    source, sink, state = (str(tmp_path / d) for d in ("in", "out", "state"))
    for ids in ([0, 1], [1, 2], [0, 2, 3]):
        some_states(spark, ids).coalesce(1).write.mode("append").parquet(source)
        incremental.stream_generation(spark, source, sink, state, remember="10 days")
    assert sorted(map(str, records.scan_records(spark, sink).collect())) == sorted(map(str, build_records(some_states(spark, range(4))).collect()))


def parents(df, mark):
    """Lines of the plan from the one that holds ``mark`` up to the join above it."""
    lines = df._jdf.queryExecution().executedPlan().toString().splitlines()
    at = next(i for i, line in enumerate(lines) if mark in line)
    depth = lambda line: len(line) - len(line.lstrip(" :+-"))
    found, level = [], depth(lines[at])
    for line in reversed(lines[:at]):
        if depth(line) < level:
            level = depth(line)
            found.append(line)
            if "Join" in line:
                break
    return found


@pytest.fixture
def table(spark):
    yield "bucketed_records_test"
    spark.sql("drop table if exists bucketed_records_test")


def test_bucketed_records_are_joined_where_they_lie(spark, table):
    states = some_states(spark, range(12), 3)
    tables.write_table(build_records(states.where("instruction_id < 5")), table, 4)
    for df in (tables.pending_in_table(states, table), tables.score_table(build_records(states).select("instruction_id", "sample_id"), table)):
        above = parents(df, "Bucketed: true")
        assert "Join" in above[-1] and not any("Exchange" in line for line in above)
    todo = tables.pending_in_table(states, table)
    assert sorted({r.instruction_id for r in todo.collect()}) == list(range(5, 12))
    tables.resume_table(states, table, 4)
    tables.resume_table(states, table, 4)
    assert sorted(map(str, tables.scan_table(spark, table).collect())) == sorted(map(str, build_records(states).collect()))
    scored = tables.scan_table(spark, table).select("sample_id", "instruction_id", (F.lit(4) - F.col("label")).alias("y_pred"))
    joined = tables.score_table(scored, table)
    assert joined.where("label + y_pred != 4").isEmpty() and joined.count() == 180


def test_a_missing_table_lacks_everything(spark, table):
    states = some_states(spark, range(3))
    assert tables.pending_in_table(states, table).count() == 6
    tables.resume_table(states, table, 2)
    assert tables.scan_table(spark, table).count() == 30


def test_counts_come_from_the_job_that_writes(spark, tmp_path):
    bad = some_states(spark, range(6), 3).selectExpr(
        "instruction_id", "layer_index", "if(instruction_id = 1 and layer_index = 2, array(float('nan')), input_vec) as input_vec",
        "if(instruction_id = 1 and layer_index = 2, array(float(1)), if(instruction_id = 3, array(float('inf'), float(1), float(2)), output_vec)) as output_vec",
    )
    run = write_counted(bad, str(tmp_path / "sink"), 3)
    assert run.n_records == records.scan_records(spark, str(tmp_path / "sink")).count() == 5 * (18 - 3 - 1)
    assert sorted(map(tuple, run.drops(spark).collect())) == sorted(map(tuple, finite_drops(bad).collect()))


def test_best_model_is_replaced_only_when_better(spark, tmp_path):
    from pyspark.ml.feature import SQLTransformer

    model, folder = SQLTransformer(statement="select * from __THIS__"), str(tmp_path)
    save = lambda name, f1: sinks.save_best_model(spark, model, name, "layer_1", f1, False, folder)
    assert save("a", 0.5) and not save("b", 0.5) and not save("c", 0.4) and save("d", 0.6)
    meta = sinks.best_meta(spark, "layer_1", folder)
    assert meta["classifier"] == "d" and meta["f1_weighted"] == 0.6
    assert os.path.isdir(tmp_path / "layer_1" / meta["model_file"])


def test_instructions_first_n(spark, monkeypatch):
    rows = [(i * 3, f"do {i}", None if i % 3 == 0 else "" if i % 3 == 1 else "more") for i in range(50)] + [(999, None, "x")]
    df = spark.createDataFrame(rows, "k int, instruction string, input string").repartition(5)
    want = [(i, f"do {i}" + ("\nmore" if i % 3 == 2 else "")) for i in range(20)]
    for top in (100_000, 5):
        monkeypatch.setattr(instructions, "TOP_K_ROWS", top)
        got = sorted((r.instruction_id, r.text) for r in instructions.load_instructions(df, "k", 20).collect())
        assert got == want
    assert instructions.load_instructions(df, "k", 60).where("k = 999").first().text == "\nx"


def test_broadcast_needs_a_small_side(spark):
    df = spark.range(10)
    hinted = lambda d: "ResolvedHint" in d._jdf.queryExecution().analyzed().toString()
    assert hinted(broadcast_if_small(df, 10)) and not hinted(broadcast_if_small(df, 9))


class FakeSession:
    """Just what ``work_root`` asks of a session."""

    def __init__(self, master, folder=None):
        self.conf = {"spark.checkpoint.dir": folder} if folder else {}
        self.sparkContext = type("Context", (), {"master": master, "applicationId": f"app-{master}"})()


def test_work_folder_comes_from_the_session():
    assert work_root(FakeSession("yarn", "hdfs:///shared/work/")) == "hdfs:///shared/work"
    assert os.path.isdir(work_root(FakeSession("local[2]")))
    with pytest.raises(RuntimeError):
        work_root(FakeSession("yarn"))
