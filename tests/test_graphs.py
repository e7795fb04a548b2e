"""The engine's fixtures in one graph of many components, and rules on small inputs."""

import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from varloom.operators import calling, collinear, decompose, graphs, profiles, subbubbles, validate
from varloom.plans.durable import numbered
from varloom.plans.graph_api import Graph
from varloom.sources import gfa, vcf

#: Small graphs and their calls against HG1, as text files. Fixed values.
DATA = os.path.join(os.path.dirname(os.path.abspath(__file__)), "data")
NAMES = sorted(x.removesuffix(".vcf") for x in os.listdir(DATA) if x.endswith(".vcf"))


#: Tree edges of each fixture by class, black edges only. Fixed values.
GROUPS = {"minimal": {(1, 5), (3,), (8,)}, "insertion": {(1, 3, 5), (8,)}, "deletion": {(1, 3, 5), (8,)}, "nested": {(1, 9), (3, 7), (5,), (12,)}, "nested_sub": {(1, 9), (3, 7), (5,), (12,), (15,)}, "two": {(1, 5, 9), (3,), (7,), (12,), (15,)}}


def _read(name):
    with open(os.path.join(DATA, name)) as f:
        return f.read().splitlines()


def _lines(name):
    return _read(f"{name}.gfa")


def _links(name):
    """(number, segment, side, segment, side) of a graph's links."""
    f = [x.split("\t") for x in _lines(name) if x[0] == "L"]
    return [(k, int(a), "r" if x == "+" else "l", int(b), "l" if y == "+" else "r") for k, (_, a, x, b, y, _) in enumerate(f)]


def _size(name):
    return sum(x[0] == "S" for x in _lines(name))


def _frame(spark, text):
    return spark.createDataFrame(list(enumerate(text)), gfa.LINES)


@pytest.mark.parametrize("name", NAMES)
def test_calls(spark, name):
    g = Graph.from_lines(_frame(spark, _lines(name)))
    assert [r.line for r in g.gfa2vcf(["HG1"]).orderBy("pos", "id").collect()] == _read(f"{name}.vcf")


@pytest.mark.parametrize("name", list(GROUPS))
def test_cycle_classes(name):
    tree = decompose.spanning_tree(range(_size(name)), _links(name))
    klass, _ = decompose.cycle_classes(tree)
    groups = {}
    for _, _, edge, c in decompose.class_stack(tree, klass):
        groups.setdefault(c, []).append(edge)
    assert {tuple(sorted(g)) for g in groups.values()} == GROUPS[name]


def test_bubble_tree(spark):
    sides = "1r-3l 1r-4l 2r-4l 3r-4l 3l-2l 4r-5l 4r-6l 4l-7l 5r-6l 6r-7l".split()
    links = [(int(x[0]), x[1], int(x[3]), x[4]) for x in sides]
    g = Graph.build(spark, list(zip(range(1, 8), "AAT GTC GTG TA AA TTG C".split())), links, [("p", [(1, ">"), (3, ">")])])
    got = {r.label: (r.i, r.j, r.parent_lo, r.parent_hi, r.height) for r in g.decompose().collect()}
    assert set(got) == {">1>7", ">4>6"}
    assert got[">1>7"][4] == 1 and got[">4>6"][2:] == (got[">1>7"][0], got[">1>7"][1], 2)


@pytest.mark.parametrize("pairs,want", [([(1, 1), (2, 2), (3, 1), (4, 2)], ["1-3", "2-4"]), ([(10, 7), (11, 7), (12, 7)], []), ([(10, 1), (20, 2), (30, 1), (40, 3), (50, 1)], ["10-30", "30-50"]), ([(9, 1), (7, 2), (5, 1), (7, 3), (9, 1)], ["5-9"])])
def test_boundaries(spark, pairs, want):
    s = spark.createDataFrame([(1, i, ">", a, i, c) for i, (a, c) in enumerate(pairs)], decompose.STACK)
    assert sorted("-".join(map(str, sorted((r.start_id, r.end_id)))) for r in decompose.boundaries(s).collect()) == want


@pytest.mark.parametrize(
    "name, want",
    [
        ("minimal", {"0>3": "T"}),
        ("nested_sub", {"0>5": "F", "1>4": "T"}),
        ("two", {"0>3": "T", "3>6": "T"}),
        # from the first of five segments a link to each of the others
        ("fan", {"0>4": "O"}),
    ],
)
def test_families(name, want):
    tree = decompose.spanning_tree(range(_size(name)), _links(name))
    stack = decompose.class_stack(tree, decompose.cycle_classes(tree)[0])
    got = {f"{min(stack[i][1], stack[j][1])}>{max(stack[i][1], stack[j][1])}": s for i, j, s, _, _ in decompose._Families(tree).of(stack)}
    assert got == want


def test_tree_measures_against_walks():
    rng = random.Random(33)
    for _ in range(30):
        n = rng.randrange(2, 14)
        links = [(k, k, "r", k + 1, "l") for k in range(n - 1)] + [(n + k, rng.randrange(n), rng.choice("lr"), rng.randrange(n), rng.choice("lr")) for k in range(rng.randrange(6))]
        tree = decompose.spanning_tree(range(n), links)
        decompose.cycle_classes(tree)
        m, parent, arcs = decompose.tree_measures(tree), tree["parent"], subbubbles.Arcs(tree)

        def above(v):
            out = []
            while v >= 0:
                out.append(v)
                v = parent[v]
            return out

        for v in range(1, len(parent)):
            assert m["depth"][v] == len(above(v)) - 1
            assert m["size"][v] == sum(v in above(x) for x in range(len(parent)))
            cross = sum(v in above(parent[max(a, b)]) and min(a, b) in above(v)[1:] for _, a, b in tree["back"] if a != b)
            assert m["brackets"][v] == cross
            w = rng.randrange(len(parent))
            assert arcs.common(v, w) == max(set(above(v)) & set(above(w)))


def test_nested_against_the_join(spark):
    rng = random.Random(31)
    rows = []

    def fill(comp, a, b):
        while b - a > 1 and rng.random() < 0.85:
            i = rng.randrange(a, b)
            j = rng.randrange(i + 1, b + 1)
            if (comp, i, j) not in rows:
                rows.append((comp, i, j))
            fill(comp, i, j)
            a = j

    for comp in range(1, 6):
        fill(comp, 0, 200)
    s = spark.createDataFrame(rows, "comp_id long, i long, j long")
    assert sorted(map(tuple, decompose.nested(s).collect()), key=str) == sorted(map(tuple, decompose.hierarchy(s).collect()), key=str)


def test_loci_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(graphs, "STEPS", 7)
    rng = random.Random(32)
    seq = {s: "A" * rng.randrange(0, 5) for s in range(20)}
    steps = [(p, k, rng.randrange(20), ">") for p in range(3) for k in range(p * 25)]
    got = graphs.with_loci(spark.createDataFrame(steps, "path_id long, step_idx long, seg_id long, strand string"), spark.createDataFrame(list(seq.items()), "seg_id long, seq string")).collect()
    want = {}
    for p in range(3):
        at = 1
        for q, k, s, _ in steps:
            if q == p:
                want[p, k] = at
                at += len(seq[s])
    assert {(r.path_id, r.step_idx): r.locus for r in got} == want


def test_written_sets(spark, tmp_path):
    g = Graph.from_lines(_frame(spark, _lines("two")))
    g.write_vcf(["HG1", "HG2"], f"{tmp_path}/all", combined=True)
    text = lambda p: [r.value for r in spark.read.text(p).collect()]
    for p, contigs in ((f"{tmp_path}/all", 2),):
        files = sorted(x for x in os.listdir(p) if x.startswith("part"))
        lines = [x for f in files for x in open(f"{p}/{f}").read().splitlines()]
        assert lines[0] == "##fileformat=VCFv4.2" and sum(x.startswith("#CHROM") for x in lines) == 1
        assert sum(x.startswith("##contig") for x in lines) == contigs and sum(not x.startswith("#") for x in lines) == 2 * contigs
    bare = Graph.from_lines(_frame(spark, _lines("linear")))
    bare.write_vcf(["HG1"], f"{tmp_path}/none")
    assert [x for x in text(f"{tmp_path}/none/HG1") if not x.startswith("##")] == ["#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\tHG1\tHG2"]
    g.write_prune(f"{tmp_path}/prune")
    assert sorted(os.listdir(f"{tmp_path}/prune"))[-1] == "comp_id=1" and "L\t0\t+\t1\t+\t0M" in text(f"{tmp_path}/prune/comp_id=1")
    assert tuple(g.counts().first()) == (7, 8, 2) and g.vertices().count() == 7 and g.edges().count() == 8


def test_reports(spark, tmp_path):
    g = Graph.from_lines(_frame(spark, _lines("minimal")))
    lines = ["##fileformat=VCFv4.2", "c\t2\t>0>3\tC\tG\t60\tPASS\tAT=>1,>2\tGT\t0\t1", "c\t2\t>0>3\tC\tG\t60\tPASS\tAT=>1,>2\tGT\t1\t0"]
    rec = vcf.records(_frame(spark, lines))
    failed, _ = g.validate(rec)
    assert [tuple(r) for r in failed.collect()] == [(2, "2:0:0")]
    g.write_report(rec, str(tmp_path))
    text = lambda p: [r.value for r in spark.read.text(f"{tmp_path}/{p}").collect()]
    assert sorted(text("report")) == ["2\t>0>3\t2\t>2\t1\tHG1", "rec_idx\tID\tPOS\tAT\tHap-ID\tsample"]
    assert text("summary") == ["Error rate: 50.00%"]
    many = [(f"1:{s}:0", 1, s, 0, 0, ">9") for s in range(12)]
    claims = spark.createDataFrame(many[2:], "claim string, line_no long, sample_no long, phase long, path_id long, at string")
    assert [tuple(r) for r in validate.failed_records(claims, claims.select("claim", F.lit(False).alias("found"))).collect()] == [(1, "1:2:0")]


def test_left_normalising_needs_sequences(spark):
    row = "c1\t4\t>3>5\tAA\tA\t60\tPASS\tAC=1;VARTYPE=DEL\tGT\t0\t1"
    rec = vcf.records(_frame(spark, [row]))
    lone = spark.createDataFrame([("other", "AAAAAC")], "name string, sequence string")
    assert [(r.pos, r.ref, r.alts) for r in profiles.left_normalised(rec, lone).collect()] == [(1, "AA", ["A"])]
    with pytest.raises(Exception, match="no sequence for c1"):
        profiles.left_normalised(rec, lone.unionByName(lone.withColumn("name", F.lit("third")))).collect()


def test_numbers(spark):
    df = spark.createDataFrame([(x * 37 % 1000, "q") for x in range(1000)], "k long, _p string").repartition(5)
    got = numbered(df, "k", name="n").collect()
    assert [r.n for r in sorted(got, key=lambda r: r.k)] == list(range(1000))


@pytest.mark.parametrize("text", [["Z\tx"], ["S\t1"], ["S\t0\tA", "S\t1\tC", "L\t0\t+\t1\t+\t1M", "P\tp\t0+,1+\t*"], ["S\t0\tA", "P\tp\t0+"]])
def test_rejects(spark, text):
    with pytest.raises(gfa.InvalidGfa):
        Graph.from_lines(_frame(spark, text))


def test_components_of_cycles_and_singles(spark):
    seg = spark.createDataFrame([(i, "A") for i in (1, 2, 3, 5, 8, 9)], "seg_id long, seq string")
    links = spark.createDataFrame([(0, 3, "r", 1, "l"), (1, 1, "r", 2, "l"), (2, 2, "r", 3, "l"), (3, 9, "r", 9, "r")], "edge_idx long, v1 long, v1_end string, v2 long, v2_end string")
    got = {r.seg_id: r.comp_id for r in graphs.components(seg, links).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 5: 2, 8: 3, 9: 4}


def test_region():
    assert calling.parse_region("chr1:5-90") == ("chr1", 5, 90)
    for bad in ("chr1", "chr1:5", "chr1:9-5", "chr1:a-b", ":1-2"):
        with pytest.raises(ValueError):
            calling.parse_region(bad)


def _longest(a, b):
    """Index pairs of a longest common subsequence by the whole table; on ties a advances first."""
    t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a) - 1, -1, -1):
        for j in range(len(b) - 1, -1, -1):
            t[i][j] = t[i + 1][j + 1] + 1 if a[i] == b[j] else max(t[i + 1][j], t[i][j + 1])
    out, i, j = [], 0, 0
    while i < len(a) and j < len(b):
        if a[i] == b[j]:
            out.append((i, j))
            i, j = i + 1, j + 1
        elif t[i + 1][j] >= t[i][j + 1]:
            i += 1
        else:
            j += 1
    return out


def test_chains_are_longest_common_subsequences():
    import random

    random.seed(3)
    for _ in range(400):
        a, b = ([random.choice("abcd") for _ in range(random.randint(0, 9))] for _ in range(2))
        met = np.array([(i, j) for i, x in enumerate(a) for j, y in enumerate(b) if x == y], "int64").reshape(-1, 2)
        assert collinear.chained(met[:, 0], met[:, 1]) == _longest(a, b)


def test_collinear_sites_against_whole_tables(spark):
    import random

    random.seed(7)
    walks = [[(random.randint(1, 6), random.choice("><")) for _ in range(random.randint(1, 30))] for _ in range(9)]
    steps = spark.createDataFrame([(p, k, s, o) for p, w in enumerate(walks) for k, (s, o) in enumerate(w)], "path_id long, step_idx long, seg_id long, strand string")
    text = lambda w: "".join(f"{o}{s}" for s, o in w)
    want = set()
    for p, w in enumerate(walks[1:], 1):
        m = _longest(walks[0], w)
        want |= {(p, i, k, text(walks[0][i + 1 : k]), text(w[j + 1 : n])) for (i, j), (k, n) in zip(m, m[1:]) if k > i + 1 or n > j + 1}
    spans = {x[1:3] for x in want}
    want = {x for x in want if not any(x[1] <= s and e <= x[2] and (s, e) != x[1:3] for s, e in spans)}
    got = [tuple(r) for r in collinear.collinear_sites(steps, 0).collect()]
    assert len(got) == len(want) and set(got) == want and want


def test_reverse_paths(spark):
    walks = [[(1, ">"), (2, "<"), (1, ">")], [(1, "<"), (2, ">"), (1, "<")], [(1, "<"), (2, ">")], [(3, ">"), (1, "<"), (2, ">"), (1, "<")], [(1, ">"), (2, "<"), (1, ">")]]
    steps = spark.createDataFrame([(p, k, s, o) for p, w in enumerate(walks) for k, (s, o) in enumerate(w)], "path_id long, step_idx long, seg_id long, strand string")
    assert [r.path_id for r in collinear.reverse_paths(steps, 0).collect()] == [1]
    assert collinear.reverse_paths(steps, 9).count() == 0


def test_left_align():
    assert profiles.left_align("AAAAAC", 4, "AA", "A") == (1, "AA", "A")
    assert profiles.left_align("AAAAAC", 4, "A", "AA") == (1, "A", "AA")
    assert profiles.left_align("ACGT", 2, "C", "G") == (2, "C", "G")


def test_vcf_written_and_read(spark, tmp_path):
    g = Graph.from_lines(_frame(spark, _lines("two")))
    head = vcf.header(["HG1", "HG2"])
    vcf.write(g.gfa2vcf(["HG1"]), head, spark.createDataFrame([(0, "HG1#1#chr1", 5)], "k long, chrom string, length long"), str(tmp_path / "out"))
    lines = vcf.read_lines(spark, str(tmp_path / "out"))
    assert vcf.samples(lines) == ["HG1", "HG2"]
    names, rec = vcf.read(spark, str(tmp_path / "out"))
    assert names == ["HG1", "HG2"]
    assert [tuple(r) for r in rec.orderBy("pos").select("pos", "id", vcf.info("VARTYPE").alias("t")).collect()] == [(2, ">0>3", "SUB"), (4, ">3>6", "SUB")]
    text = [r.value for r in lines.orderBy("line_no").collect()]
    (tmp_path / "short.vcf").write_text("\n".join([*text[:-1], text[-1].rpartition("\t")[0]]))
    with pytest.raises(ValueError, match="11 fields a record: 10 in line"):
        vcf.read(spark, str(tmp_path / "short.vcf"))


def test_empty_graph(spark):
    empty = Graph.build(spark, [], [], [])
    assert empty.info().count() == 0 and empty.decompose().count() == 0
    assert graphs.tips(empty.segments, empty.links).count() == 0


def test_nesting_against_all_pairs(spark):
    import random

    random.seed(5)
    spans = list({(1, a, a + random.randint(1, 60)) for a in [random.randint(0, 200) for _ in range(120)]})
    got = {(r.i, r.j): r.level for r in decompose.hierarchy(spark.createDataFrame(spans, "comp_id long, i long, j long")).collect()}
    for _, i, j in spans:
        assert got[i, j] == sum(a <= i and j <= b and (a, b) != (i, j) for _, a, b in spans)


def test_queries_and_sql_share_names():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert F is not None


def test_phases_of_a_path_without_haplotypes(spark):
    """A path whose name tells no haplotypes stands for every phase of its sample, however many."""
    paths = spark.createDataFrame([(0, "ref"), (1, "A#1#c"), (2, "A#2#c")], "path_id long, name string")
    line = "\t".join(["ref", "1", ">0>2", "A", "C", "60", "PASS", "AC=1;AF=0.5;AN=2;NS=2;AT=>1,>2;VARTYPE=SUB", "GT", "|".join(["0"] * 40), "1|0|1"])
    rec = vcf.records(spark.createDataFrame([(0, line)], gfa.LINES))
    got = {(r.sample_no, r.phase): (r.path_id, r["at"]) for r in validate.claims_of_vcf(rec, paths).collect()}
    assert got == {**{(0, k): (0, ">1") for k in range(40)}, (1, 0): (1, ">2"), (1, 1): (2, ">1"), (1, 2): (-1, ">2")}


def test_written_calls_stand_in_the_order_of_contigs_places_and_ends(spark, tmp_path):
    rows = [(c, p, f">{a}>{a + d}", t) for c in ("chr10", "chr2", "other") for p in (9, 10, 100) for a in (7, 40, 300) for d in (1, 20) for t in ("SUB", "INS", "DEL")]
    random.Random(3).shuffle(rows)
    lines = spark.createDataFrame([(*r, "\t".join(map(str, r))) for r in rows], "chrom string, pos long, id string, vartype string, line string").repartition(7)
    contigs = spark.createDataFrame([(5, "chr10", 1000), (2, "chr2", 70)], "k long, chrom string, length long")
    vcf.write(lines, vcf.header(["s"]), contigs, str(tmp_path / "out"))
    text = []
    for name in sorted(x for x in os.listdir(tmp_path / "out") if x.startswith("part-")):
        text += (tmp_path / "out" / name).read_text().splitlines()
    head = vcf.header(["s"])
    ends = lambda r: tuple(map(int, r[2][1:].split(">")))
    want = sorted(rows, key=lambda r: (["chr2", "chr10", "other"].index(r[0]), r[1], ends(r), ["SUB", "INS", "DEL"].index(r[3])))
    assert text == [*head[:-1], "##contig=<ID=chr2,length=70>", "##contig=<ID=chr10,length=1000>", head[-1], *("\t".join(map(str, r)) for r in want)]
