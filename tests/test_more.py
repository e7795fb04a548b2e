"""Trees, texts, inversions, loops, views and the stream."""

import random

import pytest
from test_graphs import _frame, _lines

from varloom.operators import calling, inversions, profiles, views
from varloom.operators.align import align, cost
from varloom.plans.durable import written
from varloom.plans.graph_api import Graph
from varloom.plans.structures import PIECE
from varloom.sources import pvst, texts, vcf


@pytest.fixture(scope="module")
def nested(spark):
    return Graph.from_lines(_frame(spark, _lines("nested")))


def test_tree_written_and_read(spark, nested, tmp_path):
    tree = nested.decompose()
    text = [r.line for r in pvst.lines(tree).orderBy("comp_id", "idx").collect()]
    assert text == ["H\t0.0.3\t.\t.\t.", "D\t0\t.\t1\t.", "F\t1\t>0>5\t2\tL", "F\t2\t>1>4\t.\tL"]
    pvst.write(tree, str(tmp_path / "forest"))
    got = sorted((r.idx, r.sym, r.label, r.parent_idx) for r in pvst.read(spark, str(tmp_path / "forest")).collect())
    assert got == [(0, "D", ".", None), (1, "F", ">0>5", 0), (2, "F", ">1>4", 1)]
    with pytest.raises(pvst.InvalidTree):
        pvst.parse(spark.createDataFrame([("f", "H\t0.0.2\t.\t.\t.")], "file string, value string"))


def test_text_forms(spark, nested):
    tree = nested.decompose()
    assert texts.gml_tree(tree).count() == texts.dot_tree(tree).count() == 5
    assert texts.dot_graph(nested.segments, nested.links).count() == 13
    kinds = texts.structure_json(tree, nested.call(["HG1"])).groupBy("kind").count().collect()
    assert {r.kind: r["count"] for r in kinds} == {"pvst_node": 3, "variant_call": 1}


def test_fasta(spark):
    lines = spark.createDataFrame(list(enumerate([">a one", "ACG", "T", "", ">b", ">c", "GG"])), "line_no long, value string")
    assert {r.name: r.sequence for r in texts.fasta(lines).collect()} == {"a": "ACGT", "b": "", "c": "GG"}


def test_reference_list(spark, tmp_path):
    (tmp_path / "refs.txt").write_text("# chosen\nHG1 more words\n\n  HG2\t#x\n#HG3\nref#0#c\n")
    assert sorted(r.prefix for r in texts.reference_list(spark, str(tmp_path / "refs.txt")).collect()) == ["HG1", "HG2", "ref#0#c"]


def test_inversion_of_a_whole_path(spark):
    text = [f"S\t{i}\t{s}" for i, s in enumerate("ACGTA", 1)] + [f"L\t{a}\t+\t{b}\t+\t0M" for a, b in ((1, 2), (2, 3), (3, 4), (4, 5), (1, 5))] + [f"L\t{a}\t-\t{b}\t-\t0M" for a, b in ((5, 4), (4, 3), (3, 2), (2, 1))]
    text += ["P\tref\t1+,2+,3+,4+,5+\t*", "P\talt\t5-,4-,3-,2-,1-\t*"]
    g = Graph.from_lines(_frame(spark, text))
    got = [tuple(r) for r in g.inversions(["ref"]).collect()]
    assert got == [("ref", 2, ">1>5", "ACGTA", "TACGT", "1", 2, 2, ">1>2>3>4>5,<5<4<3<2<1", "1")]
    assert g.call(["ref"]).count() == 0


def _grow(ref, alt, i, j, down, up):
    """(start on ref, start on alt, length) of the longest stretch through ref[i] and alt[j] that alt reads backwards."""
    same = lambda x, y: x[0] == y[0] and x[1] != y[1]
    if not same(ref[i], alt[j]):
        return i, j, 0
    a, b, c, d = i, j, i, j
    while a + 1 < len(ref) and b > 0 and (up is None or a + 1 - i <= up) and same(ref[a + 1], alt[b - 1]):
        a, b = a + 1, b - 1
    while c > 0 and d + 1 < len(alt) and (down is None or i - c + 1 <= down) and same(ref[c - 1], alt[d + 1]):
        c, d = c - 1, d + 1
    return c, b, a - c + 1


def _added(spans):
    """Spans (start on ref, start on alt, length) put in one by one: joined with those of one turning point that they touch,
    then those dropped whose place on alt lies within another's."""
    held = []
    for s, t, n in spans:
        turn, lo, hi = s + t + n, t, t + n
        while True:
            met = next((x for x in held if x[0] == turn and x[1] <= hi and lo <= x[2]), None)
            if met is None:
                break
            held.remove(met)
            lo, hi = min(lo, met[1]), max(hi, met[2])
        held.append((turn, lo, hi))
    inside = lambda x, y: x != y and y[1] <= x[1] and x[2] <= y[2] and ((x[1], x[2]) != (y[1], y[2]) or y[0] < x[0])
    return {(turn - hi, lo, hi - lo) for turn, lo, hi in held if not any(inside((turn, lo, hi), y) for y in held)}


def test_merged_spans_in_every_order(spark):
    from itertools import permutations

    cases = {  # name: (spans, what is left)
        "exists": ([(5, 5, 3), (5, 5, 3)], {(5, 5, 3)}),
        "contained": ([(4, 4, 9), (6, 6, 5)], {(4, 4, 9)}),
        "contained, another turn": ([(4, 4, 9), (60, 6, 3)], {(4, 4, 9)}),
        "replaced": ([(6, 6, 5), (4, 4, 9)], {(4, 4, 9)}),
        "extended": ([(10, 4, 5), (7, 7, 5)], {(7, 4, 8)}),
        "extended before": ([(7, 7, 5), (10, 4, 5)], {(7, 4, 8)}),
        "repeat at one start": ([(5, 5, 3), (5, 20, 3)], {(5, 5, 3), (5, 20, 3)}),
        "no overlap": ([(5, 5, 3), (30, 40, 3)], {(5, 5, 3), (30, 40, 3)}),
        "same place on alt": ([(50, 5, 3), (5, 5, 3)], {(5, 5, 3)}),
        "chain": ([(10, 4, 3), (4, 10, 3), (7, 7, 3), (90, 5, 2)], {(4, 4, 9)}),
    }
    rows, want = [], set()
    for k, (spans, left) in enumerate(cases.values()):
        for order in permutations(spans):
            assert _added(order) == left
        rows += [(0, k, *x) for x in spans]
        want |= {(0, k, *x) for x in left}
    rng = random.Random(21)
    for k in range(100, 160):
        spans = [(30 - t - n + rng.choice([0, 0, 0, 7]), t, n) for t, n in ((rng.randrange(20), rng.randrange(2, 7)) for _ in range(rng.randrange(1, 9)))]
        rows += [(0, k, *x) for x in spans]
        assert len({frozenset(_added(rng.sample(spans, len(spans)))) for _ in range(20)}) == 1
        want |= {(0, k, *x) for x in _added(spans)}
    got = inversions.merged(spark.createDataFrame(rows, "ref long, alt long, ref_start long, alt_start long, len long")).collect()
    assert {tuple(r) for r in got} == want and len(got) == len(want)


def test_pieces_read_backwards_are_found_with_places(spark):
    g = Graph.from_lines(_frame(spark, PIECE))
    assert g.inversions(["ref"]).count() == 0
    got = [(r.chrom, r.pos, r.id, r.ref_seq, r.alt, r.ac, r["at"]) for r in g.inversions(["ref"], local=True).collect()]
    assert got == [("ref#1#c", 5, ">2>4", "TAAC", "GTTA", "1", ">2>3>4,<4<3<2")]


def test_pins_of_a_pair_are_seen_from_both_sides(spark):
    pins = spark.createDataFrame([(0, 1, 3, 9), (0, 2, 4, 8)], "ref long, alt long, i long, j long")
    refs = spark.createDataFrame([(0,), (1,)], "path_id long")
    assert {tuple(r) for r in inversions.paired(pins, refs).collect()} == {(0, 1, 3, 9), (0, 2, 4, 8), (1, 0, 9, 3)}


def test_stretches_against_growing_each_pin(spark):
    random.seed(11)
    turn = {">": "<", "<": ">"}
    ref = [(random.randint(1, 40), random.choice("><")) for _ in range(120)]
    alts = []
    for _ in range(4):
        w = [(s, turn[o]) for s, o in reversed(ref)]
        for _ in range(12):
            w[random.randrange(len(w))] = (99, ">")
        alts.append(w)
    steps = spark.createDataFrame([(p, k, s, o) for p, w in enumerate([ref, *alts]) for k, (s, o) in enumerate(w)], "path_id long, step_idx long, seg_id long, strand string")
    pins = {(p, i, j) for p, w in enumerate(alts, 1) for i, j in ((random.randrange(120), random.randrange(120)) for _ in range(400)) if i + j == 119 or ref[i][0] == w[j][0]}
    want = set()
    for p, w in enumerate(alts, 1):
        own = sorted(x[1:] for x in pins if x[0] == p)
        grown = []
        for k, (i, j) in enumerate(own):
            down = (i - own[k - 1][0] + 1) // 2 if k else None
            up = (own[k + 1][0] - i + 1) // 2 if k + 1 < len(own) else None
            grown.append(_grow(ref, w, i, j, down, up))
        want |= {(0, p, *x) for x in _added([x for x in grown if x[2] > 1])}
    got = inversions.stretches(spark.createDataFrame([(0, *x) for x in pins], "ref long, alt long, i long, j long"), steps).collect()
    assert {tuple(r) for r in got} == want and len(want) > 8


def test_alignments_are_cheapest():
    random.seed(1)

    def plain(a, b, before=""):
        if not a and not b:
            return 0
        best = 10**9
        if a and b:
            best = min(best, (a[0] != b[0]) + plain(a[1:], b[1:]))
        if b:
            best = min(best, 1 + 2 * (before != "I") + plain(a, b[1:], "I"))
        if a:
            best = min(best, 1 + 2 * (before != "D") + plain(a[1:], b, "D"))
        return best

    for _ in range(60):
        a, b = ([random.choice("xyz") for _ in range(random.randint(0, 4))] for _ in range(2))
        t = align(a, b)
        assert sum(c != "I" for c in t) == len(a) and sum(c != "D" for c in t) == len(b)
        assert cost(t) == plain(a, b)


def test_loops_are_called_lap_by_lap(spark):
    text = [f"S\t{i}\t{s}" for i, s in enumerate("ACGTCAG")] + [f"L\t{a}\t+\t{b}\t+\t0M" for a, b in ((4, 0), (0, 1), (0, 2), (1, 3), (2, 3), (3, 5), (5, 0), (3, 6))]
    text += ["P\tHG1#1#c\t4+,0+,1+,3+,5+,0+,1+,3+,6+\t*", "P\tHG2#1#c\t4+,0+,1+,3+,5+,0+,2+,3+,6+\t*"]
    rows = Graph.from_lines(_frame(spark, text)).call(["HG1"]).collect()
    assert [(r.tangled, r.id, r["at"], r.vartype, r.pos, r.an) for r in rows] == [("T", ">0>3", ">1,>2", "SUB", 7, 2)]


def test_order_of_laps():
    assert calling.lap_order([]) == []
    assert calling.lap_order([[0, 2, 4], [0, 1, 4], [0, 1, 3, 2, 3, 4]]) == [0, 2, 1, 3, 4]
    # 3 lies between 2 and 1 of its lap, which the order has the other way round: it goes before 2
    assert calling.lap_order([[0, 1, 2, 4], [0, 2, 3, 1, 4]]) == [0, 1, 3, 2, 4]


def test_cyclic_regions_follow_the_haplotypes(spark):
    text = [f"S\t{i}\t{s}" for i, s in enumerate("ACGT")] + [f"L\t{a}\t+\t{b}\t+\t0M" for a, b in ((0, 1), (0, 3), (1, 2), (2, 1), (2, 3))]
    text += ["P\tHG1#1#c\t0+,1+,2+,3+\t*", "P\tHG2#1#c\t0+,1+,2+,1+,2+,3+\t*", "P\tHG3#1#c\t0+,3+\t*"]
    g = Graph.from_lines(_frame(spark, text))
    called = written(calling.colour(g.decompose(), g.steps, g.references(["HG1"])), "called")
    assert [(r.seg_id, r.cyclic) for r in g._columns(called).orderBy("col").collect()] == [(0, True), (1, True), (2, True), (3, True)]
    got = sorted((r.vartype, r.id, r.ref_seq, r.alt, r["at"], r.tangled) for r in g.call(["HG1"]).collect())
    assert got == [("DEL", ">0>3", "ACG", "A", ">0>1>2,>0", "F"), ("INS", ">0>3", "ACG", "ACGCG", ">0>1>2,>0>1>2>1>2", "F")]


def test_profiles_that_reject(spark, nested):
    rec = vcf.records(_frame(spark, ["c\t2\t>1>4\tCT\tC\t60\tPASS\tLV=1\tGT\t0\t1"]))
    tree = nested.decompose()
    assert profiles.raw_graph(rec, tree, nested.steps, nested.references(["HG1"])).count() == 1
    with pytest.raises(profiles.ProfileRejected, match=">1>4"):
        profiles.raw_graph(rec, tree, nested.steps, nested.references(["HG3"]))
    with pytest.raises(profiles.ProfileRejected):
        profiles.inserted_path_raw(rec)


def test_views(spark, nested):
    assert [r.context for r in views.step_context(nested.steps, 1, 1).orderBy("path_id").collect()] == [">0>1>3", ">0>1>4"]
    assert views.path_window(nested.steps, 0, 2, 1).count() == 3
    assert views.repeats(nested.steps).count() == 0 and views.longest_loop(nested.steps).count() == 3


def test_stream(spark, tmp_path):
    from varloom.streaming.gfa_stream import call_stream

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.gfa").write_text("\n".join(_lines("nested")) + "\n")
    call_stream(spark, str(tmp_path / "in"), ["HG1"], str(tmp_path / "out"), str(tmp_path / "ckpt")).awaitTermination()
    assert [r.id for r in spark.read.parquet(str(tmp_path / "out")).collect()] == [">1>4"]
