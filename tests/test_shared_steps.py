"""What several steps read is made once, over several tasks."""

import pyarrow as pa
import pyarrow.parquet as pq

from varloom.operators import graphs
from varloom.plans import synth
from varloom.plans.catalogue import NESTED
from varloom.plans.durable import stage_costs, traced
from varloom.sources import pvst

LINES = [*NESTED[:-1], "P\tHG3#1#chr1\t0+,2+,5+\t*"]


def suppliers(tmp_path, n=40):
    pq.write_table(pa.table({"s_suppkey": pa.array(range(1, n + 1), pa.int64())}), tmp_path / "supplier.parquet")
    return str(tmp_path)


def test_copies_are_dealt_to_tasks(spark, tmp_path):
    g = synth.copies(spark, suppliers(tmp_path), LINES)
    for df in (g.segments, g.links, g.paths, g.steps):
        assert len(df.inputFiles()) > 1  # of the keys' one file, one task made all copies
    assert (g.segments.count(), g.links.count(), g.paths.count(), g.steps.count()) == (240, 280, 120, 480)


def test_tree_and_regions_are_made_once(spark, tmp_path):
    g = synth.copies(spark, suppliers(tmp_path), LINES)
    with traced() as told:
        calls = g.call(["HG1"], apart=True).count()
        assert g.inversions(["HG1"], apart=True).count() == 0
    n = {stage: calls for stage, calls, *_ in stage_costs(told)}
    assert calls == 40 and n["tree"] == 1 and n["called"] == 2  # one by verb
    plan = pvst.nodes(g.tree)._jdf.queryExecution().toString()
    assert "MapInArrow" not in plan and "Window" not in plan


def test_genotype_columns_without_a_window_over_all_samples(spark):
    names = ["B#2#c", "raw1", "A#1#c", "B#1#c", "B#2#d", "raw2", "A#7#c"]
    cols = graphs.genotype_columns(spark.createDataFrame(list(enumerate(names)), "path_id long, name string"))
    got = [(r.sample, r.hap_col, r.phase) for r in cols.orderBy("path_id").collect()]
    assert got == [("B", 0, 1), ("raw1", 1, 0), ("A", 2, 0), ("B", 0, 0), ("B", 0, 1), ("raw2", 3, 0), ("A", 2, 1)]
    assert "windowspecdefinition(first" not in cols._jdf.queryExecution().toString()
