import pytest
from pyspark.sql import functions as F

from actiscope.operators import guards
from actiscope.plans.generate import build_records, failing_instructions
from actiscope.schema import label_name

NAN, INF = float("nan"), float("inf")


@pytest.fixture
def mixed(states):
    return states(
        [
            (0, 0, [1.0, 2.0], [3.0, 4.0]),
            (0, 1, [3.0, 4.0], [NAN, 1.0]),
            (0, 2, [INF, 1.0], [1.0, 1.0]),
            (0, 3, [1.0, 1.0], [1.0, -INF]),
            (1, 0, [1.0, 2.0], [3.0, 4.0]),
            (1, 1, [1.0], [3.0, 4.0]),
            (2, 0, [1.0, 1.0], [3.4e38, -3.4e38]),
            (2, 1, [1.0, 1.0], [1.0, 1.0]),
            (3, 0, [1.0, None], [1.0, 1.0]),
            (4, 0, None, [1.0, 1.0]),
            (5, 0, [], []),
            (6, 0, [0.0, 0.0], [0.0, 0.0]),
        ]
    )


def keys(df):
    return sorted((r.instruction_id, r.layer_index) for r in df.select("instruction_id", "layer_index").distinct().collect())


def test_finite_guard(mixed):
    kept = keys(guards.finite_guard(mixed))
    assert kept == [(0, 0), (1, 0), (1, 1), (2, 0), (2, 1), (5, 0), (6, 0)]


def test_finite_drops(mixed):
    drops = {r.layer_index: tuple(r)[1:] for r in guards.finite_drops(mixed).collect()}
    assert drops[1] == (3, 0, 1) and drops[2] == (1, 1, 0) and drops[3] == (1, 0, 1)
    assert drops[0] == (7, 2, 0)


def test_shape_guard_drops_the_instruction(mixed):
    assert {g for g, _ in keys(guards.shape_guard(mixed))} == {0, 2, 3, 6}


def test_build_drops_whole_instructions_and_single_layers(mixed):
    failing = {r.instruction_id for r in failing_instructions(mixed).collect()}
    assert failing == {1, 2, 4, 5}
    for engine in ("arrow", "columns"):
        records = build_records(mixed, engine=engine)
        assert keys(records) == [(0, 0), (6, 0)]
        assert records.count() == 10


@pytest.mark.parametrize("max_rows", [0, 1, 10])
def test_drop_groups_with_short_and_long_lists(mixed, max_rows):
    offenders = mixed.where(F.col("instruction_id").isin(1, 2))
    assert {g for g, _ in keys(guards.drop_groups(mixed, offenders, "instruction_id", max_rows))} == {0, 3, 4, 5, 6}


def test_quarantine(spark):
    rows = spark.createDataFrame([(1, [1.0, 2.0]), (2, [NAN, 1.0]), (3, [1.0, INF])], "id int, v array<float>")
    good, bad = guards.variant_finite_guard(rows, "v")
    assert [r.id for r in good.collect()] == [1] and sorted(r.id for r in bad.collect()) == [2, 3]


def test_unknown_label_fails(spark):
    with pytest.raises(Exception, match="unknown label: 9"):
        spark.createDataFrame([(9,)], "label int").select(label_name(F.col("label"))).collect()
