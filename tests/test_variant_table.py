import numpy as np
import pyarrow as pa

from actiscope.catalog.fixtures import layer_states
from actiscope.operators import variant_table, variants

ASK = "select * from {name}(table(select instruction_id, layer_index, input_vec, output_vec from some_states))"


def rows_of(df):
    return sorted((r.instruction_id, r.layer_index, r.label, r.label_name, tuple(r.vector)) for r in df.collect())


def test_equal_to_the_expansion_in_a_plan(spark, sf_dir):
    states = layer_states(spark, sf_dir)
    states.createOrReplaceTempView("some_states")
    variant_table.register(spark)
    found = spark.sql(ASK.format(name="expand_variants"))
    assert rows_of(found) == rows_of(variants.expand(states))


def test_own_generators(spark, sf_dir):
    layer_states(spark, sf_dir).createOrReplaceTempView("some_states")

    def negated(given: pa.Array, out: pa.Array) -> pa.Array:
        return pa.array([[-x for x in v] for v in out.to_pylist()], pa.list_(pa.float32()))

    variant_table.register(spark, "more_variants", generators={2: ("negated", negated), 9: ("again", negated)})
    found = {(r.instruction_id, r.layer_index, r.label): r for r in spark.sql(ASK.format(name="more_variants")).collect()}
    assert {label for *_, label in found} == {0, 1, 2, 3, 4, 9}
    for (i, k, label), r in found.items():
        if label in (2, 9):
            assert np.allclose(r.vector, [-x for x in found[i, k, 0].vector]) and r.label_name == ("negated" if label == 2 else "again")


def test_empty_table(spark, sf_dir):
    layer_states(spark, sf_dir).where("false").createOrReplaceTempView("some_states")
    variant_table.register(spark)
    assert spark.sql(ASK.format(name="expand_variants")).count() == 0
