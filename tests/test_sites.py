"""Site calls by sample, level and parent, and the record of a reversed path."""

import random

import pytest
from test_graphs import _frame, _lines, _read

from varloom.operators import sites
from varloom.plans.graph_api import Graph


def told(df):
    return [r.line for r in sites.lines(df).orderBy("pos", "first", "last").collect()]


@pytest.mark.parametrize("name", ["insertion", "deletion", "nested_sub", "two", "linear"])
def test_fixtures(spark, name):
    g = Graph.from_lines(_frame(spark, _lines(name)))
    assert told(g.site_calls("HG1")) == _read(f"{name}.vcf")


def test_reversed_path_is_the_only_record(spark):
    text = [f"S\t{i}\t{s}" for i, s in enumerate("ACGTAG", 1)] + [f"L\t{a}\t+\t{b}\t+\t0M" for a, b in ((1, 2), (2, 3), (3, 4), (4, 5), (1, 6), (6, 3))]
    text += ["P\tref\t1+,2+,3+,4+,5+\t*", "P\tother\t1+,6+,3+,4+,5+\t*"]
    g = Graph.from_lines(_frame(spark, text))
    assert told(g.site_calls("ref")) == ["ref\t2\t>1>3\tC\tG\t60\tPASS\tAC=1;AF=0.5;AN=2;NS=2;AT=>2,>6;VARTYPE=SUB;TANGLED=F;ES=>1>3;LV=0\tGT\t0\t1"]
    g = Graph.from_lines(_frame(spark, [*text, "P\talt\t5-,4-,3-,2-,1-\t*", "P\tlate\t5-,4-,3-,2-,1-\t*"]))
    assert told(g.site_calls("ref")) == ["ref\t2\t>1>5\tACGTA\tTACGT\t60\tPASS\tAC=1;AF=0.5;AN=2;NS=2;AT=>1>2>3>4>5,<5<4<3<2<1;VARTYPE=SUBR;TANGLED=F\tGT\t0\t.\t1\t."]


def graph_of(spark, walks, names, seqs):
    links = sorted({(a, b) for w in walks for a, b in zip(w, w[1:])})
    text = [f"S\t{i}\t{s}" for i, s in seqs.items()] + [f"L\t{a}\t+\t{b}\t+\t0M" for a, b in links]
    return Graph.from_lines(_frame(spark, text + [f"P\t{n}\t{','.join(f'{s}+' for s in w)}\t*" for n, w in zip(names, walks)]))


def test_mixed_kinds_raise(spark):
    seqs = {i: "ACGTACGT"[i] for i in range(6)}
    walks = [[0, 1, 3, 4], [0, 2, 3, 4], [0, 3, 4]]
    with pytest.raises(Exception, match="mixed kinds of alleles at one site: >0>3"):
        graph_of(spark, walks, ["a#1#c", "b#1#c", "c#1#c"], seqs).site_calls("a").collect()


def test_levels_parents_and_phases(spark):
    """A deletion around sites is no record; what lies in it tells it as parent, and its path is missing there."""
    seqs = {i: "ACGT"[i % 4] * (1 + i % 2) for i in range(12)}
    ref = [0, 1, 2, 3, 4, 5, 6, 7]
    walks = [ref, [0, 1, 8, 3, 4, 5, 6, 7], [0, 1, 2, 3, 4, 9, 6, 7], [0, 7], [0, 1, 10, 3, 4, 5, 6, 7], ref]
    names = ["A#1#c", "B#1#c", "B#2#c", "C#1#c", "D#1#c", "D#2#c"]
    got = graph_of(spark, walks, names, seqs).site_calls("A").orderBy("pos").collect()
    assert [(r.id, r.lv, r.parent, r.alt, r.ac, r.an, r.ns, list(r.gts)) for r in got] == [
        (">1>3", 1, ">0>7", "A,G", "1,1", 5, 3, ["0", "1|0", ".", "2|0"]),
        (">4>6", 1, ">0>7", "CC", "1", 5, 3, ["0", "0|1", ".", "0|0"]),
    ]
    assert [r.parent for r in got] == [">0>7"] * 2


def test_tree_of_spans(spark):
    rng = random.Random(12)
    spans = sorted({(a, a + 1 + int(rng.paretovariate(0.6))) for a in (rng.randrange(400) for _ in range(300))})
    got = {(r.ref_start, r.ref_end): (r.leaf, r.level, r.parent_start, r.parent_end) for r in sites.site_tree(spark.createDataFrame(spans, "ref_start long, ref_end long")).collect()}
    assert len(got) == len(spans)
    for a, b in spans:
        over = [(d - c, c, d) for c, d in spans if c < a and b < d]
        best = min(over, default=(0, None, None))
        assert got[a, b] == (not any(a < c and d < b for c, d in spans), len(over), best[1], best[2])
