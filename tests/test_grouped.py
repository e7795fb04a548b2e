"""Kernels per key: groups over borders of batches, large groups, and what a long component takes."""

import tracemalloc

import numpy as np

from varloom.operators import calling, decompose
from varloom.operators.grouped import by_key
from varloom.plans.graph_api import Graph


def _ladder(sites):
    pairs = ((0, 1), (0, 2), (1, 3), (2, 3), (0, 3), (1, 2))
    return np.array([(k, 3 * s + x, 1, 3 * s + y, 0) for k, (s, x, y) in enumerate((s, x, y) for s in range(sites) for x, y in pairs)], np.int64).T.copy()


def test_groups_over_batches(spark):
    rows = spark.range(60_000).selectExpr("IF(id < 45000, 7, id) AS k", "id AS x")
    got = by_key(rows, lambda x: (np.sort(x), [len(x)] * len(x)), "k long, x long, n long")
    assert got.count() == got.distinct().count() == 60_000
    assert {(r.k, r.n) for r in got.where("k = 7").select("k", "n").distinct().collect()} == {(7, 45_000)}
    assert got.where("k <> 7 AND (n <> 1 OR x <> k)").count() == 0


def test_a_long_component_is_kept_as_numbers():
    sites = 3000
    links = _ladder(sites)
    tracemalloc.start()
    tree = decompose._tree(np.arange(3 * sites + 1), *links)
    told = decompose.stack_columns(tree, decompose.cycle_classes(tree)[0])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(told[0]) == 3 * sites + 1
    assert peak / (3 * sites) < 1000  # bytes a segment; an object for each bracket, side and edge took 1720


def test_no_data_frame_per_component(spark):
    g = Graph.build(spark, [(i, "A") for i in range(4)], [(0, "r", 1, "l"), (0, "r", 2, "l"), (1, "r", 3, "l"), (2, "r", 3, "l")], [("H#1#c", [(0, ">"), (1, ">"), (3, ">")])])
    tree = g.decompose()
    cols = calling.columns(tree, g.links, g.comps)
    assert [(r.col, r.seg_id) for r in cols.orderBy("col").collect()] == [(0, 0), (1, 1), (2, 2), (3, 3)]
    for df in (decompose.class_stacks(g.links, g.comps), tree, cols):
        plan = df._jdf.queryExecution().toString()
        assert "MapInArrow" in plan and "FlatMapGroupsInPandas" not in plan


def test_genotypes_of_a_record_stay_in_its_row(spark):
    paths = spark.createDataFrame([(0, "A#1#c"), (1, "A#2#c"), (2, "B#1#c"), (3, "C#1#c"), (4, "D#1#c"), (5, "D#2#c")], "path_id long, name string")
    m = "array<struct<hap_col:bigint,phase:bigint>>"
    rec = spark.createDataFrame([("1:0", 0, 0, 2, "SUB", [(0, 0), (2, 0)], [[(1, 0)], [(0, 1)]]), ("1:4", 0, 0, 2, "DEL", [], [[(3, 1)]])], f"rov_id string, ref long, u long, v long, vartype string, refs {m}, alts array<{m}>")
    got = calling.genotype_matrix(rec, paths)
    assert sorted((r.rov_id, r.gts) for r in got.collect()) == [("1:0", ["0|2", "1", "0", "."]), ("1:4", [".", ".", ".", ".|1"])]
    assert sorted((r.vartype, r.hap_col, r.phase, r.allele) for r in calling.genotypes(rec).collect()) == [("DEL", 3, 1, 1), ("SUB", 0, 0, 0), ("SUB", 0, 1, 2), ("SUB", 1, 0, 1), ("SUB", 2, 0, 0)]
    # the records themselves are dealt to no other task
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(rov_id" not in plan
