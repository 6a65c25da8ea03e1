"""Registered queries of the graph operators over the graph view, with the same queries in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars
from ..operators import compare, graph as g, paths as p, stats, uncertainty
from ..sources.store import edge_scan, neuron_scan
from . import graphview as view
from .graphview import SQL_EDGES, SQL_FRACTIONS, SQL_NODES

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
SOURCES = [1000000001, 1000000002]
TARGETS = [1000000000, 1000000001, 1000000002, 1000000003, 1000000004]
_S, _T = ", ".join(map(str, SOURCES)), ", ".join(map(str, TARGETS))
_E = f"WITH {SQL_EDGES}"
_N = f"WITH {SQL_NODES}"
_ALL = f"WITH RECURSIVE {SQL_NODES}, {SQL_EDGES}, {SQL_FRACTIONS}"


def _query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return register


def _r(c: str, digits: int = 9):
    return F.round(F.col(c), digits).alias(c)


# Scans, joins, sets.


@_query(f"{_E} SELECT pre, post, weight FROM edges WHERE weight >= 40")
def scan_edges_min_weight(spark, sf_dir):
    return edge_scan(view.edges(spark, sf_dir), min_weight=40).select("pre", "post", "weight")


@_query(f"{_E} SELECT pre, post, weight FROM edges WHERE pre IN ({_T}) AND weight >= 10")
def edges_semi_pre(spark, sf_dir):
    return edge_scan(view.edges(spark, sf_dir), min_weight=10, pre=TARGETS).select("pre", "post", "weight")


@_query(f"{_N} SELECT neuron_id, cell_type FROM neurons WHERE super_class = 'supplier' AND side = 'left'")
def scan_neurons_where(spark, sf_dir):
    return neuron_scan(view.neurons(spark, sf_dir), columns=["neuron_id", "cell_type"], where="super_class = 'supplier' and side = 'left'")


@_query(f"{_N}, {SQL_EDGES} SELECT neuron_id, super_class FROM neurons WHERE neuron_id NOT IN (SELECT pre FROM edges WHERE weight >= 60)")
def ids_anti(spark, sf_dir):
    strong = edge_scan(view.edges(spark, sf_dir), min_weight=60).select(F.col("pre").alias("neuron_id"))
    return view.neurons(spark, sf_dir).select("neuron_id", "super_class").join(strong, "neuron_id", "left_anti")


@_query(f"{_N}, {SQL_EDGES} SELECT (SELECT count(*) FROM neurons) AS n_neurons, (SELECT count(*) FROM edges) AS n_edges, (SELECT count(*) FROM signs WHERE sign = 0) AS n_unknown")
def graph_counts(spark, sf_dir):
    c = g.counts(view.graph(spark, sf_dir))
    return spark.createDataFrame([(c["n_neurons"], c["n_edges"], c["excluded_unknown_sign_neurons"])], "n_neurons long, n_edges long, n_unknown long")


@_query(f"{_E} SELECT pre AS id FROM edges WHERE weight >= 50 INTERSECT SELECT post FROM edges WHERE weight >= 15")
def ids_intersect(spark, sf_dir):
    graph = view.graph(spark, sf_dir)
    return g.ends(graph, "pre", 50).intersect(g.ends(graph, "post", 15))


# Labels, signs, fractions.

_AGG = """sized AS (SELECT cell_type AS label, count(*) AS n FROM neurons WHERE cell_type IS NOT NULL GROUP BY 1),
agg AS (SELECT a.cell_type AS pre_label, b.cell_type AS post_label, {value} AS weight, count(*) AS n_pairs FROM edges JOIN neurons a ON a.neuron_id = pre JOIN neurons b ON b.neuron_id = post JOIN signs s ON s.neuron_id = pre GROUP BY 1, 2)
SELECT pre_label, post_label, weight, n_pairs, x.n AS n_pre, y.n AS n_post, round(weight / y.n, 9) AS weight_per_post FROM agg JOIN sized x ON x.label = pre_label JOIN sized y ON y.label = post_label WHERE weight <> 0"""


def _label_columns(df):
    return df.select("pre_label", "post_label", "weight", "n_pairs", "n_pre", "n_post", _r("weight_per_post"))


@_query(f"{_N}, {SQL_EDGES}, " + _AGG.format(value="sum(weight)::BIGINT"))
def label_aggregate(spark, sf_dir):
    return _label_columns(g.aggregate(view.graph(spark, sf_dir), "cell_type"))


@_query(f"{_N}, {SQL_EDGES}, " + _AGG.format(value="sum(weight * sign)"))
def label_aggregate_signed(spark, sf_dir):
    return _label_columns(g.aggregate(view.graph(spark, sf_dir), "cell_type", signed=True))


@_query(f"{_N}, {SQL_EDGES} SELECT pre, post, weight::BIGINT AS weight, weight * sign AS signed FROM edges JOIN signs ON neuron_id = pre")
def signed_weights(spark, sf_dir):
    return g.signed_weights(view.graph(spark, sf_dir))


@_query(f"{_E}, {SQL_FRACTIONS} SELECT pre, post, weight::BIGINT AS weight, round(fraction, 9) AS fraction FROM fractions")
def input_fraction(spark, sf_dir):
    return g.input_normalized(view.graph(spark, sf_dir), value=lambda x: F.round(x, 9))


@_query(f"{_N}, {SQL_EDGES}, keep AS (SELECT neuron_id FROM neurons WHERE neuron_id IN ({_T}) OR neuron_id BETWEEN 3000000000 AND 3000000049) SELECT pre, post, weight::BIGINT AS weight FROM edges WHERE pre IN (SELECT neuron_id FROM keep) AND post IN (SELECT neuron_id FROM keep)")
def induced_subgraph(spark, sf_dir):
    return g.subset(view.graph(spark, sf_dir), TARGETS + list(range(3000000000, 3000000050))).edges


# Paths and reach.

_PATHS = f"""{_ALL}, f AS (SELECT pre, fractions.post, weight, fraction, sign FROM fractions JOIN signs ON neuron_id = pre WHERE weight >= {{w}} AND fraction >= {{frac}}),
walk AS (SELECT id AS source, id AS last, [id] AS path, 0 AS hops, 1.0::DOUBLE AS strength, 1.0::DOUBLE AS sgn, 2147483647 AS min_weight FROM (SELECT unnest([{_S}]::BIGINT[]) AS id)
  UNION ALL SELECT source, post, list_append(path, post), hops + 1, strength * fraction, sgn * sign, least(min_weight, weight) FROM walk JOIN f ON pre = last
  WHERE hops < {{hops}} AND NOT list_contains(path, post) AND (hops = 0 OR last NOT IN ({_T})) AND strength * fraction >= {{strength}})
SELECT array_to_string(path, '>') AS path, hops, min_weight::BIGINT AS min_weight, source, last AS target, round(strength, 12) AS strength, sgn + 0.0 AS path_sign FROM walk WHERE hops > 0 AND last IN ({_T})"""


def _paths(spark, sf_dir, hops, w, frac=0.0, strength=0.0):
    found = p.find_paths(view.graph(spark, sf_dir), SOURCES, TARGETS, max_hops=hops, min_weight=w, min_edge_fraction=frac, min_strength=strength, max_paths=None)
    return found.select(F.array_join(F.transform("path", lambda x: x.cast("string")), ">").alias("path"), "hops", "min_weight", "source", "target", F.round("strength", 12).alias("strength"), "path_sign")


@_query(_PATHS.format(hops=3, w=15, frac=0, strength=0))
def paths_3hop(spark, sf_dir):
    return _paths(spark, sf_dir, 3, 15)


@_query(_PATHS.format(hops=3, w=5, frac=0.02, strength=0))
def paths_min_fraction(spark, sf_dir):
    return _paths(spark, sf_dir, 3, 5, frac=0.02)


@_query(_PATHS.format(hops=3, w=10, frac=0, strength=0.0001))
def paths_min_strength(spark, sf_dir):
    return _paths(spark, sf_dir, 3, 10, strength=0.0001)


_BFS = f"""{_ALL}, f AS (SELECT pre, post FROM edges WHERE weight >= 18),
d1 AS (SELECT DISTINCT post AS node FROM f WHERE pre IN ({_S})), d2 AS (SELECT DISTINCT post AS node FROM f JOIN d1 ON pre = node), d3 AS (SELECT DISTINCT post AS node FROM f JOIN d2 ON pre = node),
r AS (SELECT unnest([{_S}]::BIGINT[]) AS node, 0 AS distance UNION ALL SELECT node, 1 FROM d1 UNION ALL SELECT node, 2 FROM d2 UNION ALL SELECT node, 3 FROM d3)
SELECT node, min(distance) AS distance FROM r GROUP BY node"""


@_query(_BFS)
def bfs_distance(spark, sf_dir):
    return p.bfs_distances(edge_scan(view.edges(spark, sf_dir), min_weight=18).select("pre", "post"), SOURCES, 3)


_NEAR = f"""{_ALL}, f AS (SELECT pre, post FROM edges WHERE weight >= 18),
s AS (SELECT unnest([{_S}]::BIGINT[]) AS node, 0 AS d UNION ALL SELECT post, d + 1 FROM s JOIN f ON pre = node WHERE d < 3),
t AS (SELECT unnest([{_T}]::BIGINT[]) AS node, 0 AS d UNION ALL SELECT pre, d + 1 FROM t JOIN f ON post = node WHERE d < 3)
SELECT a.node AS neuron_id FROM (SELECT node, min(d) AS d FROM s GROUP BY node) a JOIN (SELECT node, min(d) AS d FROM t GROUP BY node) b ON a.node = b.node WHERE a.d + b.d <= 3 UNION SELECT unnest([{_S}]::BIGINT[])""".replace("UNION ALL SELECT post, d + 1", "UNION SELECT post, d + 1").replace("UNION ALL SELECT pre, d + 1", "UNION SELECT pre, d + 1")


@_query(_NEAR)
def nodes_on_paths(spark, sf_dir):
    return p.nodes_on_paths(view.graph(spark, sf_dir), SOURCES, TARGETS, max_hops=3, min_weight=18)


_EFF = f"""{_ALL}, e AS (SELECT pre, fractions.post, fraction * sign AS v FROM fractions JOIN signs ON neuron_id = pre WHERE sign <> 0),
h1 AS (SELECT pre, post, v FROM e WHERE pre IN ({_S})), h2 AS (SELECT h1.pre, e.post, sum(h1.v * e.v) AS v FROM h1 JOIN e ON h1.post = e.pre GROUP BY 1, 2), h3 AS (SELECT h2.pre, e.post, sum(h2.v * e.v) AS v FROM h2 JOIN e ON h2.post = e.pre GROUP BY 1, 2)"""


@_query(_EFF + " SELECT pre, post, round(v, 12) AS value FROM h2")
def effective_2hop(spark, sf_dir):
    return p.effective_connectivity(view.graph(spark, sf_dir), 2, sources=SOURCES).select("pre", "post", F.round("value", 12).alias("value"))


@_query(_EFF + " SELECT pre, post, round(sum(v), 12) AS value FROM (SELECT * FROM h1 UNION ALL SELECT * FROM h2 UNION ALL SELECT * FROM h3) GROUP BY 1, 2")
def effective_cumulative(spark, sf_dir):
    return p.effective_connectivity(view.graph(spark, sf_dir), 3, cumulative=True, sources=SOURCES).select("pre", "post", F.round("value", 12).alias("value"))


@_query(_EFF + f" SELECT h AS hops, round(coalesce(sum(v), 0), 12) AS value FROM (SELECT 1 AS h UNION ALL SELECT 2 UNION ALL SELECT 3) LEFT JOIN (SELECT 1 AS k, * FROM h1 UNION ALL SELECT 2, * FROM h2 UNION ALL SELECT 3, * FROM h3) ON h = k AND post IN ({_T}) GROUP BY h")
def effective_by_hops(spark, sf_dir):
    return p.effective_by_hops(view.graph(spark, sf_dir), SOURCES, TARGETS).select("hops", F.round("value", 12).alias("value"))


@_query(
    f"WITH paths AS ({_PATHS.format(hops=3, w=15, frac=0, strength=0)}), n AS (SELECT path, strength, path_sign, unnest(string_split(path, '>')[2:-2])::BIGINT AS neuron_id FROM paths WHERE hops > 1) "
    "SELECT neuron_id, round(sum(strength), 9) AS score, round(sum(strength * path_sign), 9) AS signed_score, count(*) AS n_paths FROM n GROUP BY 1"
)
def pathway_scores(spark, sf_dir):
    found = p.find_paths(view.graph(spark, sf_dir), SOURCES, TARGETS, max_hops=3, min_weight=15, max_paths=None).withColumn("strength", F.round("strength", 12))
    return stats.pathway_scores(found).select("neuron_id", _r("score"), _r("signed_score"), "n_paths")


# Uncertainty.


@_query(f"{_N} SELECT neuron_id, round(CASE WHEN nt_pred = 'acetylcholine' THEN nt_conf ELSE (1 - nt_conf) / 7 END, 9) AS p_ach, round(CASE WHEN nt_pred = 'gaba' THEN nt_conf ELSE (1 - nt_conf) / 7 END, 9) AS p_gaba FROM neurons WHERE nt_pred IS NOT NULL")
def nt_confidence_model(spark, sf_dir):
    probs = uncertainty.nt_probabilities(view.neurons(spark, sf_dir), model="confidence").where("nt_probs is not null")
    return probs.select("neuron_id", F.round(F.col("nt_probs")[0], 9).alias("p_ach"), F.round(F.col("nt_probs")[2], 9).alias("p_gaba"))


_DRAW = "('0x' || substr(md5('7:' || s || ':' || neuron_id), 1, 8))::UBIGINT / 4294967296.0"
_CLASSES = ["acetylcholine", "glutamate", "gaba", "dopamine", "octopamine", "serotonin", "histamine", "tyramine"]


def _sampled_sql(n: int) -> str:
    p_of = [f"CASE WHEN nt_pred = '{c}' THEN nt_conf ELSE (1 - nt_conf) / 7 END" for c in _CLASSES]
    cum = [" + ".join(f"({x})" for x in p_of[: i + 1]) for i in range(7)]
    signs = [-1 if c in ("gaba", "glutamate", "histamine") else 1 for c in _CLASSES]
    case = " ".join(f"WHEN u <= {c} THEN {s}" for c, s in zip(cum, signs, strict=False))
    return f"{_N}, d AS (SELECT neuron_id, s, nt_pred, nt_conf::DOUBLE AS nt_conf, {_DRAW} AS u FROM neurons, range({n}) r(s)) SELECT neuron_id, s::INT AS sample, (CASE WHEN nt_pred IS NULL THEN 0 {case} ELSE 1 END)::INT AS sign FROM d"


@_query(_sampled_sql(3))
def sampled_signs(spark, sf_dir):
    return uncertainty.sample_signs(view.neurons(spark, sf_dir), 3, 7, model="confidence")


@_query()
def path_stability(spark, sf_dir):
    found = uncertainty.path_stability(view.graph(spark, sf_dir), SOURCES, TARGETS, max_hops=3, n_samples=20, seed=3, thresholds=[15, 18, 22], nt_model="confidence", max_paths=None)
    return found.select(F.array_join(F.transform("path", lambda x: x.cast("string")), ">").alias("path"), "hops", _r("threshold_presence"), "modal_sign", _r("sign_stability"))


def _version(spark, sf_dir, parity):
    line = view.table(spark, sf_dir, "lineitem").where(F.year("l_shipdate") % 2 == parity)
    return line.groupBy((F.col("l_suppkey") + view.SUPPLIER).alias("pre"), (F.col("l_partkey") + view.PART).alias("post")).agg(F.sum("l_quantity").cast("int").alias("weight"))


_V = "SELECT 1000000000 + l_suppkey AS pre, 3000000000 + l_partkey AS post, sum(l_quantity)::BIGINT AS w FROM lineitem WHERE year(l_shipdate) % 2 = {} GROUP BY 1, 2"


@_query(
    f"SELECT coalesce(a.pre, b.pre) AS pre, coalesce(a.post, b.post) AS post, a.w AS weight_old, b.w AS weight_new, CASE WHEN a.w IS NULL THEN 'added' WHEN b.w IS NULL THEN 'removed' ELSE 'changed' END AS status "
    f"FROM ({_V.format(0)}) a FULL JOIN ({_V.format(1)}) b ON a.pre = b.pre AND a.post = b.post WHERE a.w IS DISTINCT FROM b.w"
)
def version_diff_edges(spark, sf_dir):
    return uncertainty.diff_edges(_version(spark, sf_dir, 0), _version(spark, sf_dir, 1))


@_query(f"{_N} SELECT neuron_id, side AS side_old, CASE WHEN neuron_id % 5 = 0 THEN NULL ELSE side END AS side_new, cell_type AS cell_type_old, CASE WHEN neuron_id % 7 = 0 THEN upper(cell_type) || 'x' ELSE cell_type END AS cell_type_new FROM neurons WHERE neuron_id % 5 = 0 OR (neuron_id % 7 = 0 AND cell_type IS NOT NULL)")
def version_diff_attrs(spark, sf_dir):
    old = view.neurons(spark, sf_dir).select("neuron_id", "side", "cell_type")
    new = old.select("neuron_id", F.when(F.col("neuron_id") % 5 != 0, F.col("side")).alias("side"), F.when(F.col("neuron_id") % 7 == 0, F.concat(F.upper("cell_type"), F.lit("x"))).otherwise(F.col("cell_type")).alias("cell_type"))
    return uncertainty.diff_attributes(old, new).select("neuron_id", "side_old", "side_new", "cell_type_old", "cell_type_new")


# Comparison.


@_query("WITH a AS (SELECT c_mktsegment AS t, CASE WHEN c_custkey % 3 = 0 THEN c_mktsegment || ', ' || 'OTHER' WHEN c_custkey % 3 = 1 THEN c_mktsegment END AS x FROM customer), l AS (SELECT t, x, count(*) AS n FROM a WHERE x IS NOT NULL GROUP BY 1, 2), e AS (SELECT t, trim(unnest(string_split(x, ','))) AS type_b, n FROM l), b AS (SELECT c_mktsegment AS t, count(*) AS n FROM customer GROUP BY 1) SELECT e.t AS type_a, type_b, e.n AS n_a, b.n AS n_b FROM e JOIN b ON b.t = type_b")
def match_types(spark, sf_dir):
    c = view.table(spark, sf_dir, "customer")
    x = F.when(F.col("c_custkey") % 3 == 0, F.concat("c_mktsegment", F.lit(", OTHER"))).when(F.col("c_custkey") % 3 == 1, F.col("c_mktsegment"))
    a = c.select(F.col("c_mktsegment").alias("cell_type"), x.alias("fafb_783_cell_type"))
    return compare.match_types(a, c.select(F.col("c_mktsegment").alias("cell_type")), "fafb_783_cell_type")


@_query(f"{_N}, {SQL_EDGES}, m AS (SELECT neuron_id FROM neurons WHERE cell_type = 'BUILDING'), w AS (SELECT pre, coalesce(cell_type, '__unmatched__') AS label, sum(weight) AS w FROM edges JOIN neurons ON post = neuron_id WHERE pre IN (SELECT neuron_id FROM m) GROUP BY 1, 2), f AS (SELECT label, w / sum(w) OVER (PARTITION BY pre) AS f FROM w) SELECT label, round(sum(f) / (SELECT count(*) FROM m), 9) AS fraction FROM f GROUP BY label")
def type_profile(spark, sf_dir):
    return compare.type_profile(view.graph(spark, sf_dir), "BUILDING").select("label", _r("fraction"))


_COUNTS = "counts AS (SELECT pre AS neuron_id, 'out' AS dir, cell_type AS label, sum(weight) AS value FROM edges JOIN neurons ON post = neuron_id GROUP BY 1, 2, 3 UNION ALL SELECT post, 'in', cell_type, sum(weight) FROM edges JOIN neurons ON pre = neuron_id GROUP BY 1, 2, 3)"
_PROF = f"{_COUNTS}, prof AS (SELECT neuron_id, dir, label, value / sum(value) OVER (PARTITION BY neuron_id, dir) AS value FROM counts WHERE label IS NOT NULL)"


def _counts(spark, sf_dir):
    graph = view.graph(spark, sf_dir)
    return graph, compare.partner_counts(graph, compare.partner_labels(graph.nodes))


@_query(f"{_N}, {SQL_EDGES}, {_PROF} SELECT neuron_id, dir, label, round(value, 9) AS value FROM prof")
def partner_profiles(spark, sf_dir):
    return compare.profiles(_counts(spark, sf_dir)[1]).select("neuron_id", "dir", "label", _r("value"))


@_query(f"{_N}, {SQL_EDGES}, c AS (SELECT pre AS neuron_id, CASE WHEN cell_type LIKE '%A%' THEN NULL ELSE cell_type END AS label, weight FROM edges JOIN neurons ON post = neuron_id UNION ALL SELECT post, CASE WHEN cell_type LIKE '%A%' THEN NULL ELSE cell_type END, weight FROM edges JOIN neurons ON pre = neuron_id) SELECT neuron_id, round(1 - coalesce(sum(weight) FILTER (WHERE label IS NOT NULL), 0) / sum(weight), 9) AS unlabelled_fraction FROM c GROUP BY 1")
def unlabelled_fraction(spark, sf_dir):
    graph = view.graph(spark, sf_dir)
    labels = graph.nodes.select("neuron_id", F.when(~F.contains("cell_type", F.lit("A")), F.col("cell_type")).alias("label"))
    return compare.unlabelled_fraction(compare.partner_counts(graph, labels)).select("neuron_id", _r("unlabelled_fraction"))


_GROUPS = "grp AS (SELECT p.*, n.cell_type AS g, n.side FROM prof p JOIN neurons n USING (neuron_id)), sums AS (SELECT g, dir, label, sum(value) AS s FROM grp GROUP BY 1, 2, 3)"


@_query(
    f"{_N}, {SQL_EDGES}, {_PROF}, {_GROUPS}, per AS (SELECT g, neuron_id, sum(value * s) AS dot, sum(value * value) AS pp FROM grp JOIN sums USING (g, dir, label) GROUP BY 1, 2), ss AS (SELECT g, sum(s * s) AS ss FROM sums GROUP BY 1), sz AS (SELECT cell_type AS g, count(*) AS n FROM neurons GROUP BY 1), "
    "loo AS (SELECT g, (dot - pp) / sqrt(pp * (ss - 2 * dot + pp)) AS c FROM per JOIN ss USING (g) JOIN sz USING (g) WHERE n >= 2 AND pp > 0 AND ss - 2 * dot + pp > 1e-12), y AS (SELECT g, median(c) AS c FROM loo GROUP BY 1), "
    "lr AS (SELECT g, dir, label, coalesce(sum(value) FILTER (WHERE side = 'left'), 0) AS l, coalesce(sum(value) FILTER (WHERE side = 'right'), 0) AS r FROM grp GROUP BY 1, 2, 3), q AS (SELECT g, CASE WHEN sum(l * l) > 0 AND sum(r * r) > 0 THEN sum(l * r) / (sqrt(sum(l * l)) * sqrt(sum(r * r))) END AS c FROM lr GROUP BY 1) "
    "SELECT sz.g AS label, round(coalesce(y.c, (SELECT median(c) FROM y), 1), 8) AS neuron_yard, round(coalesce(q.c, (SELECT median(c) FROM q), 1), 8) AS group_yard FROM sz LEFT JOIN y USING (g) LEFT JOIN q USING (g)"
)
def atlas_yardsticks(spark, sf_dir):
    graph, counts = _counts(spark, sf_dir)
    members = graph.nodes.select("neuron_id", F.col("cell_type").alias("label"))
    return compare.yardsticks(compare.profiles(counts), members, graph.nodes).select(F.col("group").alias("label"), F.round("neuron_yard", 8).alias("neuron_yard"), F.round("group_yard", 8).alias("group_yard"))


@_query(
    f"{_N}, {SQL_EDGES}, {_PROF}, {_GROUPS}, qn AS (SELECT neuron_id, sqrt(sum(value * value)) AS q FROM prof GROUP BY 1), gn AS (SELECT g, sqrt(sum(s * s)) AS n FROM sums GROUP BY 1), "
    "d AS (SELECT neuron_id, s.g, sum(value * s.s) AS dot FROM prof JOIN sums s USING (dir, label) GROUP BY 1, 2), sc AS (SELECT neuron_id, g, dot / (q * n) AS s FROM d JOIN qn USING (neuron_id) JOIN gn USING (g)), r AS (SELECT *, row_number() OVER (PARTITION BY neuron_id ORDER BY round(s, 10) DESC, g) AS rank FROM sc) SELECT neuron_id, rank, g AS label, round(s, 6) AS s FROM r WHERE rank <= 3"
)
def centroid_topk(spark, sf_dir):
    graph = view.graph(spark, sf_dir)
    atlas = compare.build_atlas(graph)
    return compare.score(atlas, atlas.profiles, top_k=3).select("neuron_id", F.col("rank").cast("long").alias("rank"), F.col("group").alias("label"), F.round("s", 6).alias("s"))


@_query("SELECT least(floor(p * 10), 9)::BIGINT AS bin, count(*) AS n, round(avg(p), 9) AS mean_p, round(avg(y), 9) AS accuracy FROM (SELECT l_discount * 10 + 0.005 AS p, (l_returnflag = 'R')::DOUBLE AS y FROM lineitem) WHERE p IS NOT NULL GROUP BY 1")
def ece_bins(spark, sf_dir):
    df = view.table(spark, sf_dir, "lineitem").select((F.col("l_discount") * 10 + 0.005).alias("p"), (F.col("l_returnflag") == "R").cast("double").alias("y"))
    return compare.ece_bins(df, "p", "y").select("bin", "n", _r("mean_p"), _r("accuracy"))


# Statistics and experiments.

_P = "SELECT c_custkey AS id, ((c_custkey * 7919) % 10007 + 1) / 10008.0::DOUBLE AS p_value FROM customer"


@_query(f"WITH p AS ({_P}), r AS (SELECT *, row_number() OVER (ORDER BY p_value) AS k, count(*) OVER () AS n FROM p) SELECT id, round(p_value, 12) AS p_value, round(least(min(p_value * n / k) OVER (ORDER BY k DESC ROWS UNBOUNDED PRECEDING), 1), 9) AS q_value FROM r")
def bh_qvalues(spark, sf_dir):
    c = view.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), (((F.col("c_custkey") * 7919) % 10007 + 1) / F.lit(10008.0)).alias("p_value"))
    return stats.bh_qvalues(c).select("id", F.round("p_value", 12).alias("p_value"), _r("q_value"))


@_query("SELECT s_suppkey, s_nationkey, row_number() OVER (PARTITION BY s_nationkey ORDER BY abs(s_acctbal) DESC, s_suppkey)::INT AS rank FROM supplier")
def rank_within(spark, sf_dir):
    return stats.rank_within(view.table(spark, sf_dir, "supplier"), "s_nationkey", "s_acctbal", "s_suppkey").select("s_suppkey", "s_nationkey", "rank")


@_query("SELECT p_partkey, (e AND sum(e::INT) OVER (ORDER BY p_retailprice DESC, p_partkey ROWS UNBOUNDED PRECEDING) <= 25) AS taken FROM (SELECT *, p_size < 20 AS e FROM part)")
def running_eligible(spark, sf_dir):
    return stats.running_eligible(view.table(spark, sf_dir, "part"), "p_retailprice", "p_partkey", F.col("p_size") < 20, 25).select("p_partkey", "taken")


@_query(
    f"{_N}, keys AS (SELECT * FROM (VALUES ('supplier', 2), ('customer', 4), ('part', 8)) k(super_class, bin)), d AS (SELECT n.super_class, bin, s, neuron_id, ('0x' || substr(md5('11:' || n.super_class || ':' || bin || ':' || s || ':' || neuron_id), 1, 8))::UBIGINT / 4294967296.0 AS u FROM neurons n JOIN keys k ON n.super_class = k.super_class, range(5) r(s) WHERE neuron_id NOT IN ({_T})) "
    "SELECT super_class, bin::BIGINT AS bin, s::INT AS set, neuron_id FROM (SELECT *, row_number() OVER (PARTITION BY super_class, bin, s ORDER BY u, neuron_id) AS r FROM d) WHERE r <= bin"
)
def null_sets(spark, sf_dir):
    keys = spark.createDataFrame([("supplier", 2), ("customer", 4), ("part", 8)], "super_class string, bin long")
    excluded = spark.createDataFrame([(t,) for t in TARGETS], "neuron_id long")
    return stats.draw_null_sets(view.neurons(spark, sf_dir), keys, excluded, n_sets=5, seed=11)


@_query("WITH e AS (SELECT s_nationkey AS k, avg(s_acctbal) - 4500 AS difference FROM supplier GROUP BY 1), n AS (SELECT c_nationkey AS k, c_acctbal - 4500 AS d FROM customer) SELECT e.k AS nation, round((1 + count(d) FILTER (WHERE d * CASE WHEN difference >= 0 THEN 1 ELSE -1 END >= difference * CASE WHEN difference >= 0 THEN 1 ELSE -1 END)) / (count(d) + 1), 9) AS null_p FROM e LEFT JOIN n ON e.k = n.k GROUP BY e.k, difference")
def null_p(spark, sf_dir):
    e = view.table(spark, sf_dir, "supplier").groupBy(F.col("s_nationkey").alias("nation")).agg((F.avg("s_acctbal") - 4500).alias("difference"))
    n = view.table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("nation"), (F.col("c_acctbal") - 4500).alias("null_difference"))
    return stats.null_p_values(e, n, ["nation"]).select("nation", _r("null_p"))


@_query(
    "WITH e AS (SELECT p_brand AS candidate, p_type AS axis, avg(p_size) - 25 AS d, stddev_samp(p_size) / sqrt(count(*)) AS se FROM part GROUP BY 1, 2), ref AS (SELECT p_brand AS candidate, avg(p_size) - 25 AS d FROM part GROUP BY 1), l AS (SELECT e.candidate, e.axis, CASE WHEN (e.d - 2 * se > 0 OR e.d + 2 * se < 0) AND sign(e.d) = sign(ref.d) THEN 'holds' WHEN (e.d - 2 * se > 0 OR e.d + 2 * se < 0) THEN 'flips' ELSE 'weakens' END AS label FROM e JOIN ref USING (candidate) WHERE ref.d <> 0), "
    "a AS (SELECT candidate, axis, count(*) FILTER (WHERE label <> 'holds') = 0 AS ok FROM l GROUP BY 1, 2), t AS (SELECT candidate, count(*) AS n_axes, count(*) FILTER (WHERE NOT ok) AS n_failed FROM a GROUP BY 1) SELECT candidate, n_axes, n_failed, (CASE WHEN n_failed = 0 THEN 'Strong' WHEN n_failed = 1 THEN 'Conditional' ELSE 'Fragile' END) || (CASE WHEN n_axes < 2 THEN ' (thin)' ELSE '' END) AS tier FROM t"
)
def hit_scoring(spark, sf_dir):
    part = view.table(spark, sf_dir, "part").withColumnRenamed("p_brand", "candidate")
    d, se = F.avg("p_size") - 25, F.stddev_samp("p_size") / F.sqrt(F.count("*"))
    common = [F.lit("candidate").alias("role"), F.lit(0.01).alias("q_value")]
    variants = part.groupBy("candidate", F.col("p_type").alias("axis")).agg(d.alias("difference"), (d - 2 * se).alias("ci_low"), (d + 2 * se).alias("ci_high")).select("axis", F.lit("v").alias("variant"), "candidate", "difference", "ci_low", "ci_high", *common)
    ref = part.groupBy("candidate").agg(d.alias("difference")).select(F.lit("reference").alias("axis"), F.lit("r").alias("variant"), "candidate", "difference", F.lit(None).cast("double").alias("ci_low"), F.lit(None).cast("double").alias("ci_high"), *common)
    return stats.score_hits(variants.unionByName(ref)).select("candidate", "n_axes", "n_failed", "tier")


# Scalars.


@_query("SELECT c_custkey, CASE c_custkey % 5 WHEN 0 THEN 'acetylcholine' WHEN 1 THEN 'gaba' WHEN 2 THEN NULL WHEN 3 THEN 'serotonin' ELSE 'glutamate' END AS nt, CASE c_custkey % 4 WHEN 0 THEN 'left' WHEN 1 THEN 'right' WHEN 2 THEN 'center' END AS side FROM customer")
def vocabulary_norm(spark, sf_dir):
    c = view.table(spark, sf_dir, "customer")
    nt = F.get(F.lit([" ACh", "GABA", "Unclear", "5-HT ", "glut"]), (F.col("c_custkey") % 5).cast("int"))
    side = F.get(F.lit(["L", " rhs", "Midline", "elsewhere"]), (F.col("c_custkey") % 4).cast("int"))
    return c.select("c_custkey", scalars.normalize_nt(nt).alias("nt"), scalars.normalize_side(side).alias("side"))


@_query(f"{_N} SELECT neuron_id, cell_type FROM neurons WHERE cell_type GLOB '[A-H]*[0O][!Y]*'")
def glob_select(spark, sf_dir):
    return view.neurons(spark, sf_dir).where(scalars.glob_match(F.col("cell_type"), "[A-H]*[0O][!Y]*")).select("neuron_id", "cell_type")


@_query("WITH t AS (SELECT p_partkey, trim(unnest(regexp_split_to_array(p_name || ' , ;' || p_brand, '[,;# ]'))) AS token FROM part) SELECT token, count(*) AS n FROM t WHERE token <> '' GROUP BY 1")
def token_explode(spark, sf_dir):
    t = view.table(spark, sf_dir, "part").select(F.explode(scalars.tokens(F.concat("p_name", F.lit(" , ;"), "p_brand"), ",;# ")).alias("token"))
    return t.groupBy("token").agg(F.count("*").alias("n"))


# Converter aggregates and null models on the same tables.


@_query("SELECT l_partkey AS pre, l_suppkey AS post, sum(l_quantity)::INT AS weight, count(*) AS n_rois FROM lineitem GROUP BY 1, 2")
def edges_from_rois(spark, sf_dir):
    from ..sources.convert import sum_rois

    rows = view.table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("pre"), F.col("l_suppkey").alias("post"), F.col("l_returnflag").alias("roi"), F.col("l_quantity").alias("weight"))
    return sum_rois(rows)


@_query("SELECT user_id AS body, count(*) AS n_presynapses, round(avg(value)::FLOAT::DOUBLE, 4) AS mean FROM events GROUP BY 1")
def presynapse_means(spark, sf_dir):
    from ..sources.convert import mean_by_body

    e = view.table(spark, sf_dir, "events").select(F.col("user_id").alias("body"), "value")
    return mean_by_body(e, ["value"]).select("body", "n_presynapses", F.round(F.col("value").cast("double"), 4).alias("mean"))


@_query(f"{_N} SELECT sign, count(*) AS n FROM signs GROUP BY 1")
def shuffle_signs(spark, sf_dir):
    from ..operators.nulls import shuffle_signs as shuffled

    return shuffled(view.graph(spark, sf_dir), 5).nodes.groupBy("sign").agg(F.count("*").alias("n"))


@_query(f"{_E} SELECT pre AS id, 'out' AS dir, count(*) AS degree FROM edges GROUP BY 1 UNION ALL SELECT post, 'in', count(*) FROM edges GROUP BY 1")
def rewired_degrees(spark, sf_dir):
    """Degrees after a rewiring, which must equal those before."""
    from ..operators.nulls import rewired

    return rewired(view.graph(spark, sf_dir), 3).ends.select(F.col("node").alias("id"), "dir", "degree")


@_query()
def lif_rates(spark, sf_dir):
    """Mean rates of all neurons in a simulation of the whole graph, with five suppliers driven and one silenced."""
    from ..operators.sim import Condition, LIFParams, rates_table, simulate

    graph = view.graph(spark, sf_dir)
    drive = {i: 150.0 for i in TARGETS}
    counts = simulate(graph, [Condition("stimulated", drive), Condition("silenced", drive, silenced=(TARGETS[0],))], n_trials=2, n_steps=1000, params=LIFParams())
    return rates_table(counts, graph.nodes, n_trials=2, seconds=0.1)


from . import operator_queries  # noqa: E402

ORACLE["path_stability"] = operator_queries.STABILITY_SQL
