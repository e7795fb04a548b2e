"""Registered queries on trees and on the finer kinds of bubbles, over forests and graphs of many components from the tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import scalars
from ..operators import calling, decompose, inversions, profiles, sites, trees, views
from ..sources import vcf
from . import synth
from .durable import stage_costs, traced, written


def _forest(spark: SparkSession, d: str) -> DataFrame:
    """A tree per nation over its suppliers: by rank within the nation, the one of rank r hangs below that of (r - 1) / 2."""
    s = spark.read.parquet(f"{d}/supplier.parquet").select(F.col("s_nationkey").alias("tree"), F.col("s_suppkey").alias("v"))
    r = s.withColumn("r", F.row_number().over(Window.partitionBy("tree").orderBy("v")) - 1)
    up = r.select("tree", F.col("v").alias("parent"), F.col("r").alias("up"))
    return r.withColumn("up", F.when(F.col("r") > 0, F.expr("(r - 1) div 2"))).join(up, ["tree", "up"], "left").select("tree", "v", "parent", F.col("r").cast("long").alias("r"))


def _meta(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    forest = written(_forest(spark, d), "forest")
    return forest, written(trees.measures(trees.tour(forest)), "meta")


def q_euler_tour(spark, d):
    return trees.tour(_forest(spark, d)).select("tree", "pos", "v", "depth")


def q_tree_measures(spark, d):
    return _meta(spark, d)[1].select("tree", "v", "depth", "pre", "post", "size")


def q_lowest_common(spark, d):
    """Each supplier with that of three times its rank, around the nation's number of suppliers."""
    forest, meta = _meta(spark, d)
    n = forest.groupBy("tree").agg(F.count("*").alias("n"))
    other = forest.select("tree", F.col("v").alias("b"), F.col("r").alias("k"))
    pairs = forest.join(n, "tree").withColumn("k", (3 * F.col("r") + 1) % F.col("n")).join(other, ["tree", "k"]).select("tree", F.col("v").alias("a"), "b")
    return trees.lowest_common(pairs, meta, trees.range_minima(meta))


def q_tree_reach(spark, d):
    """Back edges from each supplier to the parent's parent, and from those of odd key to the root."""
    forest, meta = _meta(spark, d)
    up = forest.where("parent IS NOT NULL").select("tree", F.col("v").alias("parent"), F.col("parent").alias("tgt"))
    two = forest.join(up, ["tree", "parent"]).select("tree", F.col("v").alias("src"), "tgt")
    root = forest.where("parent IS NULL").select("tree", F.col("v").alias("tgt"))
    far = forest.where("parent IS NOT NULL AND v % 2 = 1").join(root, "tree").select("tree", F.col("v").alias("src"), "tgt")
    return trees.reach(meta, two.unionByName(far).distinct()).select("tree", "v", F.coalesce("lo", F.lit(-1)).alias("lo"), F.coalesce("hid", F.lit(-1)).alias("hid"))


def q_bubble_kinds(spark, d):
    return synth.gadgets(spark, d).bubbles().select("comp_id", "idx", "sym", "label", "parent_idx", "route", F.coalesce("kind", F.lit("-")).alias("kind"))


def q_bubble_text(spark, d):
    return synth.gadgets(spark, d).bubble_lines()


def q_flubbles_apart(spark, d):
    return synth.gadgets(spark, d).decompose().select("comp_id", "label", "height")


def q_families_apart(spark, d):
    return synth.gadgets(spark, d).decompose(families=True).select("comp_id", "label", "sym")


def q_bracket_counts_apart(spark, d):
    g = synth.gadgets(spark, d)
    return decompose.bracket_counts(g.links, g.comps).groupBy("comp_id").agg(F.count("*").alias("sides"), F.max("size").alias("size"), F.max("depth").alias("depth"), F.sum("brackets").alias("brackets"))


def q_rov_columns_apart(spark, d):
    from .catalogue import NESTED

    g = synth.copies(spark, d, NESTED)
    called = written(calling.colour(g.tree, g.steps, g.references(["HG1"]), g.comps), "called")
    return calling.columns(called, g.links, g.comps).select("label", "col", "seg_id")


def q_site_calls(spark, d):
    rec = synth.levels(spark, d).site_calls("H0")
    return rec.select("chrom", "pos", "id", "ref_seq", "alt", "ac", "af", "an", "ns", "at", "vartype", "lv", F.coalesce("parent", F.lit("-")).alias("parent"), F.array_join("gts", " ").alias("gts"))


def q_hairpin_call(spark, d):
    """The chain, and two paths that walk the reference backwards: one record, of the first."""
    g = synth.chain(spark, d)
    steps = written(g.steps, "steps")
    ref = steps.where("path_id = 0")
    n = F.lit(ref.count() - 1)
    back = ref.select(F.explode(F.array(F.lit(1001).cast("bigint"), F.lit(1000).cast("bigint"))).alias("path_id"), (n - F.col("step_idx")).alias("step_idx"), "seg_id", scalars.flip(F.col("strand")).alias("strand"))
    more = g.paths.where("path_id = 0").select(F.explode(F.array(F.lit(1001).cast("bigint"), F.lit(1000).cast("bigint"))).alias("path_id")).withColumn("name", F.concat(F.lit("B"), F.col("path_id").cast("string"), F.lit("#1#chr1")))
    return sites.lines(sites.calls(steps.unionByName(back), g.segments, g.paths.unionByName(more), 0)).select("pos", "line")


#: An outer bubble whose alternative paths read a piece of the reference path backwards. Fixed values.
PIECE = [
    *[f"S\t{i}\t{s}" for i, s in enumerate(["AC", "G", "T", "AA", "C", "GT", "A", "TT"])],
    *[f"L\t{a}\t+\t{a + 1}\t+\t0M" for a in range(7)],
    "L\t1\t+\t4\t-\t0M",
    "L\t2\t-\t5\t+\t0M",
    "L\t0\t+\t7\t+\t0M",
    "P\tref#1#c\t0+,1+,2+,3+,4+,5+,6+,7+\t*",
    "P\talt#1#c\t0+,1+,4-,3-,2-,5+,6+,7+\t*",
    "P\tgap#1#c\t0+,7+\t*",
]


def q_structure_export(spark, d):
    from .catalogue import NESTED

    return synth.copies(spark, d, [*NESTED[:-1], "P\tHG3#1#chr1\t0+,2+,5+\t*"]).export(["HG1"], apart=True)


def q_stage_trace(spark, d):
    """What decomposing the chain writes, counted as it is written."""
    g = synth.chain(spark, d)
    with traced() as told:
        g.decompose(families=True)
    rows = [(stage, calls, items) for stage, calls, items, _ in stage_costs(told) if stage in ("labels", "comps", "kinds")]
    return spark.createDataFrame(rows, "stage string, calls long, items long")


def q_sql_functions(spark, d):
    """The functions that register() gives to SQL, called by their names there."""
    from .catalogue import _named

    scalars.register(spark)
    _named(spark, d).createOrReplaceTempView("varloom_named")
    return spark.sql("""SELECT path_id, pansn_sample(name) AS sample, revcomp(translate(md5(CAST(name AS BINARY)), '0123456789abcdef', 'ACGTACGTACGTACGT')) AS rc, flip_orient(IF(path_id % 2 = 0, '>', '<')) AS turned,
        forwardise(concat('<', path_id, '<', path_id + 1)) AS label, size(walk_tokens(concat('>', path_id, '<7', repeat('>1', CAST(path_id % 3 AS INT))))) AS tokens FROM varloom_named""")


def q_provenance(spark, d):
    from .catalogue import RAW

    return profiles.provenance(profiles.top_level(vcf.records(synth.call_lines(spark, d, RAW))), "top-level-only")


def q_field_violations(spark, d):
    """Call lines of which every seventh copy has lost its last genotype."""
    from .catalogue import RAW

    lines = synth.call_lines(spark, d, RAW)
    lost = F.when(F.expr(f"line_no div {synth.SEGMENTS_APART}") % 7 == 3, F.regexp_replace("value", "\t[^\t]*$", "")).otherwise(F.col("value"))
    return vcf.field_violations(lines.select("line_no", lost.alias("value")), 12)


def q_passes(spark, d):
    return views.passes(synth.walks(spark, d).steps, 2)


def q_other_ends(spark, d):
    """Each link of the chain from its other end, and where it leads from there and from a side that it has not."""
    links = synth.chain(spark, d).links.select(*scalars.reversed_link())
    far, none = scalars.other_end(F.col("v1"), F.col("v1_end")), scalars.other_end(F.col("v1"), F.lit("r"))
    return links.select("edge_idx", "v1", "v1_end", "v2", "v2_end", far["seg_id"].alias("far"), far["side"].alias("far_side"), none.isNull().alias("none"))


def q_genotype_table(spark, d):
    """A column per haplotype of the chain; its names are those of the nations' numbers."""
    g = synth.chain(spark, d)
    rec = written(g.call(["H0"]), "records")
    return views.genotype_table(calling.genotypes(rec, "id").select("id", "vartype", "hap_col", "allele"), [f"H{h}" for h in range(NATIONS)])


#: Nations of the tables, each a haplotype of the chain.
NATIONS = 25


def q_local_inversions(spark, d):
    return synth.copies(spark, d, PIECE).inversions(["ref"], apart=True, local=True).select("chrom", "pos", "id", "ref_seq", "alt", "ac", "an", "at")


def q_merged_inversions(spark, d):
    """Spans of order lines: a turning point or two for each supplier, so that they hold, touch and repeat one another."""
    li = spark.read.parquet(f"{d}/lineitem.parquet")
    t, n = F.col("l_partkey") % 200, F.lit(2) + F.col("l_orderkey") % 5
    spans = li.select(F.lit(0).cast("long").alias("ref"), F.col("l_suppkey").alias("alt"), t.alias("alt_start"), n.alias("len"), (F.lit(300) + 50 * (F.col("l_linenumber") % 2) - t - n).cast("long").alias("ref_start"))
    return inversions.merged(spans)


#: Bubbles of the small graphs in synth.GADGETS: graph, number, symbol, first and second end as strand and segment, number
#: of the bubble around, route, kind. Plain ones (F, T, O) come first; their level counts plain ones around them. Fixed values.
BUBBLES = [
    (0, 1, "F", ">", 0, ">", 3, 0, "L", "-"),
    (0, 2, "C", ">", 1, ">", 3, 1, "R", "ai_branch"),
    (1, 1, "F", ">", 1, ">", 4, 0, "L", "-"),
    (1, 2, "C", "<", 4, ">", 3, 1, "R", "ai_trunk"),
    (1, 3, "S", "<", 3, ">", 3, 2, "L", "ai_trunk"),
    (2, 1, "F", ">", 1, ">", 4, 0, "L", "-"),
    (2, 2, "C", ">", 3, ">", 1, 1, "L", "zi_trunk"),
    (3, 1, "F", ">", 1, ">", 6, 0, "L", "-"),
    (3, 2, "C", ">", 4, ">", 6, 1, "R", "ai_trunk"),
    (3, 3, "C", ">", 3, ">", 1, 1, "L", "zi_trunk"),
    (3, 4, "M", ">", 6, ">", 3, 1, "L", "midi"),
    (3, 5, "S", ">", 4, ">", 6, 2, "L", "ai_trunk"),
    (4, 1, "F", ">", 2, ">", 5, 0, "L", "-"),
    (4, 2, "C", ">", 3, ">", 5, 1, "L", "zi_trunk"),
    (4, 3, "C", ">", 4, ">", 5, 1, "L", "zi_branch"),
    (5, 1, "F", ">", 1, ">", 7, 0, "L", "-"),
    (5, 2, "T", ">", 2, ">", 4, 3, "L", "-"),
    (5, 3, "C", ">", 4, ">", 7, 1, "R", "ai_trunk"),
    (5, 4, "C", ">", 4, ">", 1, 1, "L", "zi_trunk"),
    (5, 5, "M", ">", 7, ">", 4, 1, "L", "midi"),
    (5, 6, "S", ">", 4, ">", 7, 3, "L", "ai_trunk"),
    (5, 7, "S", ">", 5, ">", 4, 4, "R", "zi_trunk"),
    (6, 1, "F", ">", 0, ">", 5, 0, "L", "-"),
    (6, 2, "T", ">", 1, ">", 4, 1, "L", "-"),
]
#: Of each graph: its tree's sides, the largest subtree of one, the deepest and their brackets together; held against walks
#: to the root in the tests. Fixed values.
TREES = [(0, 8, 8, 7, 6), (1, 10, 10, 7, 4), (2, 10, 10, 8, 4), (3, 14, 14, 10, 6), (4, 12, 12, 11, 13), (5, 26, 26, 19, 11), (6, 12, 12, 11, 19)]
GADGET = f"""
k AS (SELECT {synth.SEGMENTS_APART} * s_suppkey AS x, s_suppkey % {len(synth.GADGETS)} AS g, row_number() OVER (ORDER BY s_suppkey) AS c FROM supplier),
b AS (SELECT c, CAST(idx AS BIGINT) AS idx, sym, o1 || (x + s1) || o2 || (x + s2) AS label, CAST(up AS BIGINT) AS up, route, kind FROM k JOIN (VALUES {", ".join(map(str, BUBBLES))}) AS t(g, idx, sym, o1, s1, o2, s2, up, route, kind) ON k.g = t.g)
"""

FOREST = """
fr AS (SELECT s_nationkey AS t, s_suppkey AS v, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) - 1 AS r FROM supplier),
fp AS (SELECT c.t, c.v, c.r, p.v AS up FROM fr c LEFT JOIN fr p ON c.t = p.t AND c.r > 0 AND p.r = (c.r - 1) // 2),
an AS (SELECT t, v, v AS a, 0 AS far FROM fp UNION ALL SELECT an.t, an.v, fp.up, far + 1 FROM an JOIN fp ON fp.t = an.t AND fp.v = an.a WHERE fp.up IS NOT NULL),
pt AS (SELECT t, v, list(a ORDER BY far DESC) AS path, CAST(max(far) AS BIGINT) AS depth FROM an GROUP BY t, v),
sz AS (SELECT t, a AS v, CAST(count(*) AS BIGINT) AS size FROM an GROUP BY t, a),
mt AS (SELECT pt.t, pt.v, depth, row_number() OVER (PARTITION BY pt.t ORDER BY path) - 1 AS pre, size FROM pt JOIN sz USING (t, v))
"""


def oracle_sql() -> dict[str, str]:
    from .catalogue import CHAIN, NAMED, SEQ, WALKS

    q = SEQ.format
    levels = f"""
lc AS (SELECT s_suppkey, CAST(row_number() OVER (ORDER BY s_suppkey) - 1 AS BIGINT) AS s FROM supplier),
lb AS (SELECT s // {synth.BLOCK} AS b, count(*) = {synth.BLOCK} AS whole FROM lc GROUP BY b),
lh AS (SELECT CAST(n_nationkey AS BIGINT) AS h FROM nation),
lk AS (SELECT b, h FROM lb, lh WHERE whole AND h % 3 = 2 AND substr(md5(b || ':' || h), 1, 1) IN ('0', '1', '2', '3')),
lo AS (SELECT s, s // {synth.BLOCK} AS b, lh.h AS h, lk.h IS NOT NULL AS skip, lh.h > 0 AND (substr(md5(lh.h || ':' || s_suppkey), 1, 1) IN ('c', 'd', 'e') OR lh.h = 1 AND s % {synth.BLOCK} = 1) AS other
       FROM lc CROSS JOIN lh LEFT JOIN lk ON lk.b = s // {synth.BLOCK} AND lk.h = lh.h),
ls AS (SELECT s, {q("3 * s")} AS qb, {q("3 * s + 1")} AS qr, {q("3 * s + 2")} AS qa FROM lc),
lp AS (SELECT *, 1 + coalesce(sum(length(qb) + length(qr)) OVER (ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS locus FROM ls)"""
    return {
        "site_calls": f"""WITH {levels}, n AS (SELECT s, b, count(*) FILTER (other AND NOT skip) AS ac, count(*) FILTER (NOT skip) AS an, bool_or(skip) AND s % {synth.BLOCK} IN (1, 2) AS deep,
            string_agg(CASE WHEN skip THEN '.' WHEN other THEN '1' ELSE '0' END, ' ' ORDER BY h) AS gts FROM lo GROUP BY s, b)
            SELECT 'H0#1#chr1' AS chrom, CAST(CASE WHEN s % 2 = 0 THEN locus + length(qb) ELSE locus END AS BIGINT) AS pos, '>' || 3 * s || '>' || 3 * s + 3 AS id, CASE WHEN s % 2 = 0 THEN qr ELSE qb || qr END AS ref_seq,
            CASE WHEN s % 2 = 0 THEN qa ELSE qb END AS alt, CAST(ac AS VARCHAR) AS ac, CASE WHEN ac = an THEN '1' ELSE CAST(ac / an AS VARCHAR) END AS af, an, an AS ns,
            CASE WHEN s % 2 = 0 THEN '>' || 3 * s + 1 || ',>' || 3 * s + 2 ELSE '>' || 3 * s || '>' || 3 * s + 1 || ',>' || 3 * s END AS "at", CASE WHEN s % 2 = 0 THEN 'SUB' ELSE 'DEL' END AS vartype,
            CAST(deep AS BIGINT) AS lv, CASE WHEN deep THEN '>' || {3 * synth.BLOCK} * b || '>' || {3 * synth.BLOCK} * (b + 1) ELSE '-' END AS parent, gts FROM n JOIN lp USING (s) WHERE ac > 0""",
        "sql_functions": f"""WITH p AS (SELECT path_id, name FROM {NAMED}) SELECT CAST(path_id AS BIGINT) AS path_id, CASE WHEN regexp_full_match(name, '[^#]*#[0-9]+#[^#]*') THEN split_part(name, '#', 1) ELSE name END AS sample,
            reverse(translate(translate(md5(name), '0123456789abcdef', 'ACGTACGTACGTACGT'), 'ACGT', 'TGCA')) AS rc, CASE WHEN path_id % 2 = 0 THEN '<' ELSE '>' END AS turned, '>' || path_id + 1 || '>' || path_id AS label, CAST(2 + path_id % 3 AS INTEGER) AS tokens FROM p""",
        "field_violations": f"SELECT {synth.SEGMENTS_APART} * s_suppkey + i AS line_no, CAST(11 AS BIGINT) AS fields FROM supplier, (VALUES (0), (1)) AS t(i) WHERE s_suppkey % 7 = 3",
        "passes": f"WITH {WALKS} SELECT p AS path_id, i AS step_idx, '>' AS strand, CAST(row_number() OVER (PARTITION BY p ORDER BY i) AS INTEGER) AS nth FROM wk WHERE seg = 2",
        "other_ends": f"WITH {CHAIN} SELECT row_number() OVER (ORDER BY a, b) - 1 AS edge_idx, b AS v1, 'l' AS v1_end, a AS v2, 'r' AS v2_end, a AS far, 'r' AS far_side, true AS none FROM lk",
        "provenance": f"""SELECT CAST(json_object('profile', 'top-level-only', 'operation', 'passthrough', 'raw_record_id', '>' || x || '>' || x + 5, 'raw_alt_index', 1, 'output_record_id', '>' || x || '>' || x + 5 || ':top', 'output_pos', 1, 'output_ref', 'AAAAA', 'output_alts', ['A']) AS VARCHAR) AS json
            FROM (SELECT {synth.SEGMENTS_APART} * s_suppkey AS x FROM supplier)""",
        "genotype_table": f"""WITH {CHAIN}, g AS (SELECT id, vartype, h, CAST(CASE ch.c WHEN 'R' THEN 0 ELSE 1 END AS BIGINT) AS a FROM ca JOIN ch ON ch.s = ca.s AND ch.c IN ('R', ca.c))
            SELECT id, vartype, {", ".join(f'min(a) FILTER (h = {h}) AS "H{h}"' for h in range(NATIONS))} FROM g GROUP BY id, vartype""",
        "stage_trace": f"WITH {CHAIN}, n AS (SELECT count(DISTINCT seg) AS n FROM st) SELECT s AS stage, CAST(1 AS BIGINT) AS calls, n AS items FROM n, (VALUES ('labels'), ('comps'), ('kinds')) AS t(s)",
        "structure_export": f"""WITH k AS (SELECT s_suppkey AS k, {synth.SEGMENTS_APART} * s_suppkey AS x, {synth.PATHS_APART} * s_suppkey AS p, row_number() OVER (ORDER BY s_suppkey) AS c FROM supplier),
            j AS (SELECT 'segment' AS kind, x + i AS n, json_object('id', x + i, 'sequence', q) AS json FROM k, (VALUES (0, 'A'), (1, 'C'), (2, 'G'), (3, 'T'), (4, 'C'), (5, 'A')) AS t(i, q)
            UNION ALL SELECT 'link', x + i, json_object('order', x + i, 'from', x + a, 'from_orient', '+', 'to', x + b, 'to_orient', '+', 'overlap', '0M') FROM k, (VALUES (0, 0, 1), (1, 0, 2), (2, 1, 3), (3, 1, 4), (4, 3, 4), (5, 4, 5), (6, 2, 5)) AS t(i, a, b)
            UNION ALL SELECT 'path', p + i, json_object('order', p + i, 'name', 'HG' || i + 1 || '#1#chr1_' || k, 'steps', list_transform(w, lambda s: '>' || (x + s))) FROM k, (VALUES (0, [0, 1, 3, 4, 5]), (1, [0, 1, 4, 5]), (2, [0, 2, 5])) AS t(i, w)
            UNION ALL SELECT 'boundary_candidate', i, json_object('node_id', c || ':' || i, 'family', CASE i WHEN 1 THEN 'flubble' ELSE 'tiny' END, 'start', '>' || (x + a), 'end', '>' || (x + b), 'route', 's2e', 'boundary', '>' || (x + a) || '>' || (x + b)) FROM k, (VALUES (1, 0, 5), (2, 1, 4)) AS t(i, a, b)
            UNION ALL SELECT 'pvst_node', 0, json_object('node_id', c || ':0', 'component', c, 'family', 'dummy', 'label', '.', 'start', NULL, 'end', NULL, 'route', NULL, 'parent', NULL, 'children', [c || ':1']) FROM k
            UNION ALL SELECT 'pvst_node', i, json_object('node_id', c || ':' || i, 'component', c, 'family', CASE i WHEN 1 THEN 'flubble' ELSE 'tiny' END, 'label', '>' || (x + a) || '>' || (x + b), 'start', '>' || (x + a), 'end', '>' || (x + b), 'route', 's2e', 'parent', c || ':' || i - 1, 'children', CASE i WHEN 1 THEN [c || ':2'] ELSE [] END)
                FROM k, (VALUES (1, 0, 5), (2, 1, 4)) AS t(i, a, b)
            UNION ALL SELECT 'stack_entry', i, json_object('component', c, 'order', i, 'tree_edge_index', e, 'boundary_vertex_id', x + s, 'orientation', o, 'class_id', g, 'next_seen', nx, 'opens', nx > i + 1)
                FROM k, (VALUES (0, '>', 0, 1, 1, 5), (1, '>', 1, 3, 2, 3), (2, '>', 3, 5, 3, 2), (3, '>', 4, 7, 2, 3), (4, '<', 2, 12, 0, 4), (5, '>', 5, 9, 1, 5)) AS t(i, o, s, e, g, nx)
            UNION ALL SELECT 'variant_call', 2, json_object('source', json_object('kind', 'flubble', 'enclosing_site', '>' || x + 1 || '>' || x + 4, 'level', 1), 'chrom', 'HG1#1#chr1_' || k, 'pos', 2, 'id', '>' || x + 1 || '>' || x + 4, 'ref', 'CT', 'ref_traversal', '>' || x + 1 || '>' || x + 3,
                'alternates', [json_object('index', 1, 'dna', 'C', 'traversal', '>' || x + 1, 'count', 1)], 'variant_type', 'DEL', 'tangled', false, 'af', ['1/2'], 'an', 2, 'ns', 2, 'genotypes', ['0', '1', '.']) FROM k)
            SELECT kind, CAST(n AS BIGINT) AS n, CAST(json AS VARCHAR) AS json FROM j""",
        "local_inversions": f"""SELECT 'ref#1#c_' || k AS chrom, CAST(5 AS BIGINT) AS pos, '>' || x + 2 || '>' || x + 4 AS id, 'TAAC' AS ref_seq, 'GTTA' AS alt, '1' AS ac, CAST(2 AS BIGINT) AS an,
            '>' || x + 2 || '>' || x + 3 || '>' || x + 4 || ',<' || x + 4 || '<' || x + 3 || '<' || x + 2 AS "at" FROM (SELECT s_suppkey AS k, {synth.SEGMENTS_APART} * s_suppkey AS x FROM supplier)""",
        "merged_inversions": """WITH s AS (SELECT DISTINCT l_suppkey AS alt, l_partkey % 200 AS a, l_partkey % 200 + 2 + l_orderkey % 5 AS b, 300 + 50 * (l_linenumber % 2) AS turn FROM lineitem),
            x AS (SELECT DISTINCT alt, turn, unnest(range(a, b)) AS x FROM s),
            i AS (SELECT alt, turn, min(x) AS a, max(x) + 1 AS b FROM (SELECT alt, turn, x, x - row_number() OVER (PARTITION BY alt, turn ORDER BY x) AS g FROM x) GROUP BY alt, turn, g)
            SELECT CAST(0 AS BIGINT) AS ref, alt, CAST(turn - b AS BIGINT) AS ref_start, a AS alt_start, CAST(b - a AS BIGINT) AS len FROM i
            WHERE NOT EXISTS (SELECT 1 FROM i o WHERE o.alt = i.alt AND o.turn <> i.turn AND o.a <= i.a AND i.b <= o.b AND (o.a < i.a OR i.b < o.b OR o.turn < i.turn))""",
        "hairpin_call": f"""WITH {CHAIN}, w AS (SELECT string_agg('>' || seg, '' ORDER BY i) AS f, string_agg('<' || seg, '' ORDER BY i DESC) AS r, string_agg(q, '' ORDER BY i) AS dna, min(seg) AS a, max(seg) AS z, max(locus) FILTER (i = 1) AS pos FROM lo WHERE h = 0)
            SELECT pos, concat_ws(chr(9), 'H0#1#chr1', pos, '>' || a || '>' || z, dna, reverse(translate(dna, 'ACGT', 'TGCA')), '60', 'PASS', 'AC=1;AF=0.5;AN=2;NS=2;AT=' || f || ',' || r || ';VARTYPE=SUBR;TANGLED=F', 'GT',
            (SELECT '0' || repeat(chr(9) || '.', count(*) - 1) FROM nation), '1', '.') AS line FROM w""",
        "bubble_kinds": f"WITH {GADGET} SELECT c AS comp_id, idx, sym, label, up AS parent_idx, route, kind FROM b",
        "bubble_text": f"""WITH {GADGET}, n AS (SELECT c, idx, sym, label, up, route FROM b UNION ALL SELECT c, 0, 'D', '.', NULL, '.' FROM k),
            u AS (SELECT c, up AS idx, string_agg(idx, ', ' ORDER BY idx) AS kids FROM b GROUP BY c, up)
            SELECT c AS comp_id, CAST(idx AS BIGINT) AS idx, concat_ws(chr(9), sym, idx, label, coalesce(kids, '.'), route) AS line FROM n LEFT JOIN u USING (c, idx)
            UNION ALL SELECT c, -1, concat_ws(chr(9), 'H', '0.0.3', '.', '.', '.') FROM k""",
        "flubbles_apart": f"WITH {GADGET} SELECT c AS comp_id, label, CAST(CASE sym WHEN 'T' THEN 2 ELSE 1 END AS BIGINT) AS height FROM b WHERE sym IN ('F', 'T', 'O')",
        "families_apart": f"WITH {GADGET} SELECT c AS comp_id, label, sym FROM b WHERE sym IN ('F', 'T', 'O')",
        "bracket_counts_apart": f"WITH {GADGET} SELECT c AS comp_id, CAST(sides AS BIGINT) AS sides, CAST(size AS BIGINT) AS size, CAST(depth AS BIGINT) AS depth, CAST(brackets AS BIGINT) AS brackets FROM k JOIN (VALUES {', '.join(map(str, TREES))}) AS t(g, sides, size, depth, brackets) ON k.g = t.g",
        "rov_columns_apart": f"SELECT '>' || x + 1 || '>' || x + 4 AS label, CAST(col AS BIGINT) AS col, x + s AS seg_id FROM (SELECT {synth.SEGMENTS_APART} * s_suppkey AS x FROM supplier), (VALUES (0, 1), (1, 3), (2, 4)) AS t(col, s)",
        "euler_tour": f"WITH RECURSIVE {FOREST} SELECT t AS tree, 2 * pre - depth AS pos, v, depth FROM mt UNION ALL SELECT t, 2 * (pre + size) - depth - 1, v, depth FROM mt",
        "tree_measures": f"WITH RECURSIVE {FOREST} SELECT t AS tree, v, depth, pre, pre + size - 1 - depth AS post, size FROM mt",
        "lowest_common": f"""WITH RECURSIVE {FOREST}, n AS (SELECT t, count(*) AS n FROM fr GROUP BY t),
            p AS (SELECT x.t, x.v AS a, y.v AS b FROM fr x JOIN n USING (t) JOIN fr y ON x.t = y.t AND y.r = (3 * x.r + 1) % n.n)
            SELECT p.t AS tree, p.a AS a, p.b AS b, arg_max(m.v, m.depth) AS lca FROM p JOIN an x ON x.t = p.t AND x.v = p.a JOIN an y ON y.t = p.t AND y.v = p.b AND x.a = y.a
            JOIN mt m ON m.t = p.t AND m.v = x.a GROUP BY p.t, p.a, p.b""",
        "tree_reach": f"""WITH RECURSIVE {FOREST}, e AS (SELECT t, v AS s, a AS g FROM an WHERE far = 2 UNION SELECT an.t, an.v, an.a FROM an JOIN mt ON mt.t = an.t AND mt.v = an.a WHERE mt.depth = 0 AND an.far > 0 AND an.v % 2 = 1),
            x AS (SELECT e.t, e.s, e.g, a.pre AS sp, b.pre AS gp, a.depth AS sd, b.depth AS gd FROM e JOIN mt a ON a.t = e.t AND a.v = e.s JOIN mt b ON b.t = e.t AND b.v = e.g)
            SELECT m.t AS tree, m.v AS v, coalesce(arg_max(x.g, x.gd), -1) AS lo, coalesce(arg_min(x.s, (x.sd, x.sp)), -1) AS hid
            FROM mt m LEFT JOIN x ON x.t = m.t AND x.gp < m.pre AND m.pre < x.sp GROUP BY m.t, m.v""",
    }


def queries() -> dict:
    return {k[2:]: f for k, f in globals().items() if k.startswith("q_")}
