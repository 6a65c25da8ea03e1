"""More registered queries, one for each operator that the first module leaves out, with the same queries in SQL."""

from __future__ import annotations

import math
from dataclasses import replace

from pyspark.sql import functions as F

from ..functions import scalars
from ..operators import access, benchmark, calibrate, compare, graph as g, nulls, paths as p, sim, stats, typetest, uncertainty
from ..schema import NT_CLASSES
from ..sources import convert
from . import graphview as view
from .graphview import SQL_EDGES, SQL_NODES
from .queries import _CLASSES, _COUNTS, _E, _EFF, _GROUPS, _N, _PATHS, _PROF, _S, SOURCES, TARGETS, _counts, _query, _r

# Signs and nulls.

#: Probabilities of the classes by id, as SQL and as Spark see them: class j gets ((id * (j + 3)) % 11) / 100.
_MASS = [f"((neuron_id * {j + 3}) % 11) / 100.0::DOUBLE" for j in range(len(_CLASSES))]
_SIGN = [-1 if c in ("gaba", "glutamate", "histamine") else 1 for c in _CLASSES]


def _with_probabilities(spark, sf_dir):
    k = F.col("neuron_id")
    return view.neurons(spark, sf_dir).withColumns({f"nt_p_{c}": ((k * (j + 3)) % 11) / F.lit(100.0) for j, c in enumerate(NT_CLASSES)})


def _signs(spark, sf_dir, policy, seed=None):
    n = _with_probabilities(spark, sf_dir)
    return n.select("neuron_id", F.round(g.sign_column(n, policy, seed=seed), 9).alias("sign"))


_ARGMAX = "CASE WHEN nt_pred IS NULL THEN 0 WHEN nt_pred IN ('gaba', 'glutamate', 'histamine') THEN -1 ELSE 1 END"


@_query(f"{_N}, m AS (SELECT *, {' + '.join(_MASS)} AS mass, {' + '.join(f'({x}) * {s}' for x, s in zip(_MASS, _SIGN, strict=True))} AS signed FROM neurons) SELECT neuron_id, round(CASE WHEN mass > 0 THEN signed / mass ELSE {_ARGMAX} END, 9) + 0.0 AS sign FROM m")
def probabilistic_signs(spark, sf_dir):
    return _signs(spark, sf_dir, g.PROBABILISTIC)


_U = "('0x' || substr(md5('5:' || neuron_id), 1, 8))::UBIGINT / 4294967296.0"
_CUM = " ".join(f"WHEN u <= {' + '.join(f'({x}) / mass' for x in _MASS[: i + 1])} THEN {_SIGN[i]}" for i in range(len(_MASS) - 1))


@_query(f"{_N}, m AS (SELECT *, {' + '.join(_MASS)} AS mass, {_U} AS u FROM neurons) SELECT neuron_id, (CASE WHEN mass = 0 THEN {_ARGMAX} {_CUM} ELSE {_SIGN[-1]} END)::DOUBLE AS sign FROM m")
def sampled_policy_signs(spark, sf_dir):
    return _signs(spark, sf_dir, g.SAMPLED, seed=5)


@_query(f"{_N}, a AS (SELECT neuron_id, row_number() OVER (ORDER BY neuron_id) AS r FROM signs), b AS (SELECT sign, row_number() OVER (ORDER BY {_U}, neuron_id) AS r FROM signs) SELECT neuron_id, sign::DOUBLE AS sign FROM a JOIN b USING (r)")
def shuffled_signs(spark, sf_dir):
    return nulls.shuffle_signs(view.graph(spark, sf_dir), 5).nodes.select("neuron_id", "sign")


@_query(f"{_E} SELECT pre, sum(weight)::BIGINT AS out_weight, 0::BIGINT AS loops, 0::BIGINT AS repeats, true AS moved FROM edges GROUP BY pre")
def rewired_edges(spark, sf_dir):
    """Out-weights after a rewiring, which must stay, no self-loops, no repeated pairs, and most pairs new."""
    graph = p.settled(view.graph(spark, sf_dir))
    made = nulls.rewired(graph, 3)
    out = made.ends.where("dir = 'out'")
    old = g.with_edges(graph, made.edges.select("pre", "post")).count()
    checks = out.agg(F.sum("loops").alias("loops"), F.sum("repeats").alias("repeats"), F.lit(old < 0.5 * made.n_edges).alias("moved"))
    return out.select(F.col("node").alias("pre"), F.col("weight").alias("out_weight")).join(F.broadcast(checks))


# Paths.


@_query(_EFF.replace("h2 AS (SELECT h1.pre", "g1 AS (SELECT * FROM h1 WHERE abs(v) >= 0.01), h2 AS (SELECT h1.pre").replace("FROM h1 JOIN e ON h1.post = e.pre GROUP BY 1, 2)", "FROM g1 h1 JOIN e ON h1.post = e.pre GROUP BY 1, 2 HAVING abs(sum(h1.v * e.v)) >= 0.01)") + " SELECT pre, post, round(v, 12) AS value FROM h2")
def effective_pruned(spark, sf_dir):
    return p.effective_connectivity(view.graph(spark, sf_dir), 2, threshold=0.01, sources=SOURCES).select("pre", "post", F.round("value", 12).alias("value"))


def _stability_sql(seed: int, samples: int) -> str:
    p_of = [f"CASE WHEN nt_pred = '{c}' THEN nt_conf ELSE (1 - nt_conf) / 7 END" for c in _CLASSES]
    case = " ".join(f"WHEN u <= {' + '.join(f'({x})' for x in p_of[: i + 1])} THEN {_SIGN[i]}" for i in range(7))
    return f"""WITH paths AS ({_PATHS.format(hops=3, w=15, frac=0, strength=0)}),
attrs AS ({_N} SELECT neuron_id, nt_pred, nt_conf::DOUBLE AS nt_conf FROM neurons),
steps AS (SELECT path, unnest(string_split(path, '>')[:-2])::BIGINT AS neuron_id FROM paths),
d AS (SELECT a.*, s, ('0x' || substr(md5('{seed}:' || s || ':' || a.neuron_id), 1, 8))::UBIGINT / 4294967296.0 AS u FROM attrs a JOIN (SELECT DISTINCT neuron_id FROM steps) USING (neuron_id), range({samples}) r(s)),
draw AS (SELECT neuron_id, s, (CASE WHEN nt_pred IS NULL THEN 0 {case} ELSE 1 END)::INT AS sign FROM d),
prod AS (SELECT path, s, CASE WHEN min(abs(sign)) = 0 THEN 0 WHEN count(*) FILTER (WHERE sign < 0) % 2 = 1 THEN -1 ELSE 1 END AS v FROM steps JOIN draw USING (neuron_id) GROUP BY 1, 2),
tally AS (SELECT path, v, count(*) AS n FROM prod GROUP BY 1, 2),
modal AS (SELECT path, v::INT AS modal_sign, n / {samples} AS stability FROM (SELECT *, row_number() OVER (PARTITION BY path ORDER BY n DESC, v) AS r FROM tally) WHERE r = 1)
SELECT path, hops, round(((min_weight >= 15)::INT + (min_weight >= 18)::INT + (min_weight >= 22)::INT) / 3, 9) AS threshold_presence, modal_sign, round(stability, 9) AS sign_stability FROM paths JOIN modal USING (path)"""


STABILITY_SQL = _stability_sql(3, 20)


@_query(f"WITH s AS ({STABILITY_SQL}) SELECT hops, count(*) AS n_paths, round(avg(sign_stability), 9) AS sign_stability, round(avg(threshold_presence), 9) AS threshold_presence, round(avg((modal_sign > 0)::INT), 9) AS excitatory FROM s GROUP BY 1")
def stability_summary(spark, sf_dir):
    found = uncertainty.path_stability(view.graph(spark, sf_dir), SOURCES, TARGETS, max_hops=3, n_samples=20, seed=3, thresholds=[15, 18, 22], nt_model="confidence")
    return uncertainty.stability_summary(found).select("hops", "n_paths", _r("sign_stability"), _r("threshold_presence"), _r("excitatory"))


@_query(f"{_N}, {SQL_EDGES}, totals AS (SELECT post, sum(weight)::DOUBLE AS total FROM edges GROUP BY 1) SELECT pre, e.post, round((weight / total)::FLOAT::DOUBLE, 6) AS value FROM edges e JOIN totals t ON e.post = t.post JOIN signs ON neuron_id = pre WHERE sign <> 0")
def interpreter_edges(spark, sf_dir):
    return g.interpreter_inputs(view.graph(spark, sf_dir), value=lambda x: F.round(x.cast("double"), 6))[0]


@_query(f"{_N} SELECT neuron_id, CASE WHEN sign < 0 THEN -1 ELSE 1 END AS sign, cell_type AS \"group\" FROM neurons JOIN signs USING (neuron_id)")
def interpreter_nodes(spark, sf_dir):
    return g.interpreter_inputs(view.graph(spark, sf_dir), "cell_type")[1]


@_query(f"{_E} SELECT pre, post, weight::BIGINT AS weight FROM edges WHERE pre NOT IN ({_S})")
def silenced_edges(spark, sf_dir):
    return g.silence(view.graph(spark, sf_dir).edges, SOURCES)


# Comparison.

#: Two datasets: all edges with all names, and edges of 20 and more with names of a capital A taken away.
_TYPE = f"""{_N}, {SQL_EDGES}, mem AS (SELECT neuron_id, side FROM neurons WHERE cell_type = 'BUILDING' AND side IN ('left', 'right')),
raw AS (SELECT 'a' AS ds, pre AS neuron_id, cell_type AS label, weight FROM edges JOIN neurons ON post = neuron_id UNION ALL SELECT 'b', pre, CASE WHEN contains(cell_type, 'A') THEN NULL ELSE cell_type END, weight FROM edges JOIN neurons ON post = neuron_id WHERE weight >= 10),
cnt AS (SELECT ds, neuron_id, label, sum(weight) AS v FROM raw WHERE neuron_id IN (SELECT neuron_id FROM mem) AND label IS NOT NULL GROUP BY 1, 2, 3),
prof AS (SELECT ds, neuron_id, label, v / sum(v) OVER (PARTITION BY ds, neuron_id) AS v FROM cnt),
n AS (SELECT side, count(*) AS n FROM mem GROUP BY 1),
sided AS (SELECT ds, m.side, label, sum(v) AS s FROM prof JOIN mem m USING (neuron_id) GROUP BY 1, 2, 3),
ms AS (SELECT ds, side, label, s / n AS v FROM sided JOIN n USING (side)), mw AS (SELECT ds, label, sum(s) / (SELECT sum(n) FROM n) AS v FROM sided GROUP BY 1, 2),
x AS (SELECT coalesce(a.v, 0) AS u, coalesce(b.v, 0) AS v FROM (SELECT * FROM mw WHERE ds = 'a') a FULL JOIN (SELECT * FROM mw WHERE ds = 'b') b ON a.label = b.label),
y AS (SELECT coalesce(l.ds, r.ds) AS ds, coalesce(l.v, 0) AS u, coalesce(r.v, 0) AS v FROM (SELECT * FROM ms WHERE side = 'left') l FULL JOIN (SELECT * FROM ms WHERE side = 'right') r ON l.label = r.label AND l.ds = r.ds),
xs AS (SELECT sum(u * v) AS d, sqrt(sum(u * u)) * sqrt(sum(v * v)) AS q FROM x), ys AS (SELECT ds, sum(u * v) AS d, sqrt(sum(u * u)) * sqrt(sum(v * v)) AS q FROM y GROUP BY ds),
z AS (SELECT 1 - (SELECT CASE WHEN q > 0 THEN d / q ELSE 0 END FROM xs) AS between_, (SELECT avg(1 - CASE WHEN q > 0 THEN d / q ELSE 0 END) FROM (VALUES ('a'), ('b')) k(ds) LEFT JOIN ys USING (ds)) AS within_)
SELECT round(between_ - within_, 9) AS statistic, round(between_, 9) AS "between", round(within_, 9) AS "within" FROM z"""


@_query(_TYPE)
def compare_type_statistic(spark, sf_dir):
    a = p.settled(view.graph(spark, sf_dir))
    b = view.graph(spark, sf_dir, min_weight=10)
    names = a.nodes.select("neuron_id", F.when(~F.contains("cell_type", F.lit("A")), F.col("cell_type")).alias("label"))
    return compare.type_statistic(compare.type_rows(a, "BUILDING"), compare.type_rows(b, "BUILDING", labels=names)).select(_r("statistic"), _r("between"), _r("within"))


_PERMUTATIONS, _PERMUTE_SEED = 20, 3
#: All types between the two datasets of ``_TYPE``; permutation 0 is the data as they are.
_TYPES = f"""{_N}, {SQL_EDGES}, mem AS (SELECT ds, cell_type AS t, neuron_id, side FROM neurons, (VALUES ('a'), ('b')) x(ds) WHERE cell_type IS NOT NULL AND side IN ('left', 'right')),
raw AS (SELECT 'a' AS ds, pre AS neuron_id, cell_type AS label, weight FROM edges JOIN neurons ON post = neuron_id UNION ALL SELECT 'b', pre, CASE WHEN contains(cell_type, 'A') THEN NULL ELSE cell_type END, weight FROM edges JOIN neurons ON post = neuron_id WHERE weight >= 10),
cnt AS (SELECT ds, neuron_id, nullif(label, '') AS label, sum(weight) AS v FROM raw GROUP BY ALL),
prof AS (SELECT ds, neuron_id, label, v / sum(v) OVER (PARTITION BY ds, neuron_id) AS v FROM cnt WHERE label IS NOT NULL),
lost AS (SELECT ds, neuron_id, 1 - coalesce(sum(v) FILTER (label IS NOT NULL), 0) / sum(v) AS l FROM cnt GROUP BY ALL),
un AS (SELECT t, avg(coalesce(l, 0)) FILTER (ds = 'a') AS unmatched_a, avg(coalesce(l, 0)) FILTER (ds = 'b') AS unmatched_b FROM mem LEFT JOIN lost USING (ds, neuron_id) GROUP BY t),
ha AS (SELECT *, count(*) FILTER (ds = 'a') OVER (PARTITION BY t, side) AS na FROM mem),
ra AS (SELECT *, row_number() OVER (PARTITION BY t, side, k ORDER BY ('0x' || substr(md5('{_PERMUTE_SEED}:' || k || ':' || ds || ':' || neuron_id), 1, 8))::UBIGINT, ds, neuron_id) AS r FROM ha, range({_PERMUTATIONS + 1}) q(k)),
pe AS (SELECT t, k, side, ds AS own, neuron_id, CASE WHEN k = 0 THEN ds WHEN r <= na THEN 'a' ELSE 'b' END AS ds FROM ra),
n AS (SELECT t, k, ds, side, count(*) AS n FROM pe GROUP BY ALL), nw AS (SELECT t, k, ds, sum(n) AS n FROM n GROUP BY ALL),
su AS (SELECT pe.t, pe.k, pe.ds, pe.side, label, sum(v) AS s FROM pe JOIN prof ON prof.ds = own AND prof.neuron_id = pe.neuron_id GROUP BY ALL),
ms AS (SELECT t, k, ds, side, label, s / n AS v FROM su JOIN n USING (t, k, ds, side)),
mw AS (SELECT t, k, ds, label, sum(s) / any_value(n) AS v FROM su JOIN nw USING (t, k, ds) GROUP BY ALL),
be AS (SELECT t, k, 1 - coalesce(sum(v) FILTER (c = 2) / sqrt(any_value(qa)) / sqrt(any_value(qb)), 0) AS b FROM (SELECT t, k, label, product(v) AS v, count(*) AS c FROM mw GROUP BY ALL) JOIN (SELECT t, k, sum(v * v) FILTER (ds = 'a') AS qa, sum(v * v) FILTER (ds = 'b') AS qb FROM mw GROUP BY ALL) USING (t, k) GROUP BY t, k),
wc AS (SELECT t, k, ds, sum(v) FILTER (c = 2) / sqrt(any_value(ql)) / sqrt(any_value(qr)) AS c FROM (SELECT t, k, ds, label, product(v) AS v, count(*) AS c FROM ms GROUP BY ALL) JOIN (SELECT t, k, ds, sum(v * v) FILTER (side = 'left') AS ql, sum(v * v) FILTER (side = 'right') AS qr FROM ms GROUP BY ALL) USING (t, k, ds) GROUP BY t, k, ds),
wi AS (SELECT t, k, avg(1 - coalesce(c, 0)) AS w FROM (SELECT t, k, ds FROM n GROUP BY ALL HAVING count(*) = 2) LEFT JOIN wc USING (t, k, ds) GROUP BY t, k),
st AS (SELECT t, k, b, coalesce(w, 0) AS w, b - coalesce(w, 0) AS s FROM be LEFT JOIN wi USING (t, k)), ob AS (SELECT * FROM st WHERE k = 0),
te AS (SELECT t, avg(st.s) AS m, stddev_samp(st.s) AS sd, (count(*) FILTER (st.s >= ob.s - 1e-9) + 1) / {_PERMUTATIONS + 1}.0::DOUBLE AS p FROM st JOIN ob USING (t) WHERE st.k > 0 GROUP BY t)
SELECT t AS type_a, t AS type_b, na AS n_a, nb AS n_b, round(s, 9) AS statistic, round(b, 9) AS "between", round(w, 9) AS "within", CASE WHEN sd > 1e-9 THEN round((s - m) / sd, 6) ELSE 0 END AS z, round(p, 9) AS p, CASE WHEN p >= 0.05 OR s <= 0 THEN 'not distinguishable' WHEN s <= 0.045 + 0.096 THEN 'differs within the usual range' ELSE 'differs' END AS verdict, round(unmatched_a, 9) AS unmatched_a, round(unmatched_b, 9) AS unmatched_b
FROM ob JOIN te USING (t) JOIN un USING (t) JOIN (SELECT t, count(*) FILTER (ds = 'a') AS na, count(*) FILTER (ds = 'b') AS nb FROM mem GROUP BY t) USING (t)"""


@_query(_TYPES)
def compare_types(spark, sf_dir):
    """All types at once, with p, z and verdict."""
    a = p.settled(view.graph(spark, sf_dir))
    b = p.settled(view.graph(spark, sf_dir, min_weight=10))
    names = a.nodes.select("neuron_id", F.nullif("cell_type", F.lit("")).alias("label"))
    fewer = names.select("neuron_id", F.when(~F.contains("label", F.lit("A")), F.col("label")).alias("label"))
    pairs = a.nodes.where("cell_type is not null").select(F.col("cell_type").alias("type_a"), F.col("cell_type").alias("type_b"))
    rows = typetest.compare_types(a, b, pairs, n_permutations=_PERMUTATIONS, seed=_PERMUTE_SEED, labels=(names, fewer))
    return rows.select("type_a", "type_b", "n_a", "n_b", _r("statistic"), _r("between"), _r("within"), F.round("z", 6).alias("z"), _r("p"), "verdict", _r("unmatched_a"), _r("unmatched_b"))


_HIDDEN = ["BUILDING", "GERMANY"]
_MASKED = f"{_N}, {SQL_EDGES}, {_COUNTS}, prof AS (SELECT neuron_id, dir, label, value / sum(value) OVER (PARTITION BY neuron_id, dir) AS value FROM counts WHERE label IS NOT NULL AND label NOT IN ('BUILDING', 'GERMANY')), {_GROUPS}"


@_query(f"{_MASKED} SELECT g AS \"group\", dir, label, round(s, 8) AS value FROM sums WHERE g <> 'FRANCE'")
def masked_profiles(spark, sf_dir):
    """Centroid sums after masking twice and dropping a group."""
    atlas = compare.build_atlas(p.settled(view.graph(spark, sf_dir)))
    masked = compare.masked_atlas(compare.masked_atlas(atlas, _HIDDEN[:1]), _HIDDEN[1:], drop=["FRANCE"])
    return masked.sums.select("group", "dir", "label", F.round("value", 8).alias("value"))


_BENCH = f"""{_N}, {SQL_EDGES}, {_COUNTS}, t AS (SELECT DISTINCT cell_type AS truth FROM neurons ORDER BY ('0x' || substr(md5('0:' || truth), 1, 8))::UBIGINT, truth),
pm AS (SELECT truth, neuron_id, dir, label, value / sum(value) OVER (PARTITION BY truth, neuron_id, dir) AS v FROM counts, t WHERE label IS NOT NULL AND label <> truth),
cent AS (SELECT truth, cell_type AS g, dir, label, sum(v) AS s FROM pm JOIN neurons USING (neuron_id) GROUP BY ALL),
cn AS (SELECT truth, g, sqrt(sum(s * s)) AS n FROM cent GROUP BY ALL),
q AS (SELECT pm.* FROM pm JOIN neurons n USING (neuron_id) WHERE n.cell_type = truth), qn AS (SELECT truth, neuron_id, sqrt(sum(v * v)) AS n FROM q GROUP BY ALL),
dots AS (SELECT truth, neuron_id, g, sum(v * s) AS d FROM q JOIN cent USING (truth, dir, label) GROUP BY ALL),
sc AS (SELECT truth, neuron_id, g, d / (qn.n * cn.n) AS s FROM dots JOIN qn USING (truth, neuron_id) JOIN cn USING (truth, g)),
every AS (SELECT t.truth, n.neuron_id, l.g, coalesce(s, 0) AS s FROM t JOIN neurons n ON n.cell_type = truth, (SELECT DISTINCT cell_type AS g FROM neurons) l LEFT JOIN sc ON sc.truth = t.truth AND sc.neuron_id = n.neuron_id AND sc.g = l.g),
r AS (SELECT 'closed' AS protocol, *, row_number() OVER (PARTITION BY truth, neuron_id ORDER BY round(s, 10) DESC, g) AS k FROM every UNION ALL SELECT 'open', *, row_number() OVER (PARTITION BY truth, neuron_id ORDER BY round(s, 10) DESC, g) FROM every WHERE g <> truth)
SELECT protocol, truth AS type, neuron_id, max(g) FILTER (WHERE k = 1) AS top1, round(max(s) FILTER (WHERE k = 1), 7) AS s1, round(max(s) FILTER (WHERE k = 1) - max(s) FILTER (WHERE k = 2), 7) AS margin, max(g) FILTER (WHERE k = 1) = truth AS correct, count(*) FILTER (WHERE k <= 3 AND g = truth) > 0 AS top3,
  (truth, neuron_id) NOT IN (SELECT (truth, neuron_id) FROM qn) AS empty FROM r GROUP BY protocol, truth, neuron_id"""


@_query(_BENCH)
def benchmark_records(spark, sf_dir):
    """Records of all types, masked on both sides."""
    graph = p.settled(view.graph(spark, sf_dir))
    graph = replace(graph, nodes=graph.nodes.withColumn("fafb_783_cell_type", F.col("cell_type")))
    found = benchmark.run_benchmark(graph, compare.build_atlas(graph), query_ref="star", max_types=2**31 - 1)
    return found.where("level = 'neuron'").select("protocol", "type", "neuron_id", "top1", F.round("s1", 7).alias("s1"), F.round("margin", 7).alias("margin"), "correct", "top3", "empty")


def _wide(spark, sf_dir):
    """Scores as a classifier has them, from suppliers: three labels each with falling scores."""
    s = view.table(spark, sf_dir, "supplier")
    k = F.col("s_suppkey")
    score = lambda m: F.round((k * m % 97) / F.lit(100.0), 4)
    rows = s.select(k.alias("neuron_id"), F.array_sort(F.array(*(F.struct((-score(m)).alias("s"), F.concat(F.lit("T"), (k * m % 7).cast("string")).alias("g")) for m in (3, 5, 11)))).alias("r"))
    return rows.select("neuron_id", F.posexplode("r").alias("i", "x")).select("neuron_id", (F.col("i") + 1).alias("rank"), F.col("x.g").alias("group"), (-F.col("x.s")).alias("s"), (-F.col("x.s") * 2).alias("a"))


_WIDE = "x AS (SELECT s_suppkey AS neuron_id, unnest([3, 5, 11]) AS m FROM supplier), y AS (SELECT neuron_id, round((neuron_id * m % 97) / 100.0, 4)::DOUBLE AS s, 'T' || (neuron_id * m % 7) AS g FROM x), z AS (SELECT *, row_number() OVER (PARTITION BY neuron_id ORDER BY s DESC, g) AS k FROM y), w AS (SELECT neuron_id, max(g) FILTER (WHERE k = 1) AS top, max(s) FILTER (WHERE k = 1) AS s1, max(s) FILTER (WHERE k = 2) AS s2, list(g ORDER BY k) AS labels, list(s ORDER BY k) AS scores FROM z GROUP BY 1)"


@_query(f"WITH {_WIDE}, c AS (SELECT *, least(s1 * 2, 1) AS p, CASE WHEN s1 < 0.3 THEN 'unknown' WHEN least(s1 * 2, 1) >= 0.9 THEN 'type' ELSE 'ambiguous' END AS call FROM w) SELECT neuron_id, round(s1 - s2, 9) AS margin, round(p, 9) AS p, call, CASE call WHEN 'type' THEN top WHEN 'ambiguous' THEN array_to_string(list_transform(list_filter(list_zip(labels, scores), lambda v: v[2] >= s1 - 0.1), lambda v: v[1]), '|') END AS called FROM c")
def calls(spark, sf_dir):
    wide = compare.wide_scores(_wide(spark, sf_dir))
    called = compare.apply_calls(wide, F.least(F.col("s1") * 2, F.lit(1.0)), s_floor=0.3, delta=0.1, accept=0.9)
    return called.select("neuron_id", _r("margin"), _r("p"), "call", "called")


@_query(f"WITH {_WIDE} SELECT top AS label, count(*) AS n FROM w GROUP BY 1 ORDER BY n DESC, label LIMIT 10")
def votes(spark, sf_dir):
    return compare.votes(compare.wide_scores(_wide(spark, sf_dir)))


@_query(f"WITH {_WIDE}, b AS (SELECT least(floor((s1 - s2) * 20), 19) AS b, count(*) AS n, avg((neuron_id % 3 = 0)::INT) AS acc FROM w GROUP BY 1) SELECT round((SELECT quantile_cont(s1, 0.9) FROM w), 9) AS s_floor, round(coalesce((SELECT (max(b) + 1) / 20 FROM b WHERE n >= 10 AND acc < 0.5), 0.01), 9) AS delta")
def call_thresholds(spark, sf_dir):
    wide = compare.wide_scores(_wide(spark, sf_dir)).withColumn("right", F.col("neuron_id") % 3 == 0)
    return spark.createDataFrame([(round(compare.choose_s_floor(wide), 9), round(float(compare.choose_delta(wide)), 9))], "s_floor double, delta double")


_TRUTH = "SELECT c_custkey AS neuron_id, CASE c_custkey % 4 WHEN 0 THEN c_mktsegment || ' ' WHEN 1 THEN c_mktsegment || ',X' WHEN 2 THEN 'NOWHERE' END AS x FROM customer"


@_query(f"WITH t AS ({_TRUTH}) SELECT neuron_id, trim(x) AS truth FROM t WHERE x IS NOT NULL AND NOT contains(x, ',') AND trim(x) IN (SELECT c_mktsegment FROM customer)")
def truth_labels(spark, sf_dir):
    c, k = view.table(spark, sf_dir, "customer"), F.col("c_custkey") % 4
    x = F.when(k == 0, F.concat("c_mktsegment", F.lit(" "))).when(k == 1, F.concat("c_mktsegment", F.lit(",X"))).when(k == 2, F.lit("NOWHERE"))
    return compare.truth_labels(c.select(F.col("c_custkey").alias("neuron_id"), x.alias("xref")), "xref", c.select(F.col("c_mktsegment").alias("label")))


@_query(f"{_N}, {SQL_EDGES}, {_COUNTS} SELECT DISTINCT neuron_id FROM counts WHERE label IN ('BUILDING', 'GERMANY')")
def touching(spark, sf_dir):
    return compare.touching(_counts(spark, sf_dir)[1], _HIDDEN)


@_query("WITH p AS (SELECT l_orderkey AS k, (l_partkey % 1000) / 1000.0::DOUBLE AS p, (l_suppkey % 3 = 0)::INT AS y FROM lineitem), b AS (SELECT least(floor(p * 10), 9) AS b, count(*) AS n, abs(avg(p) - avg(y)) AS gap FROM p GROUP BY 1) SELECT round((SELECT sum(n * gap) / sum(n) FROM b), 9) AS ece, round((SELECT avg((p - y) * (p - y)) FROM p), 9) AS brier")
def calibration_errors(spark, sf_dir):
    df = view.table(spark, sf_dir, "lineitem").select(((F.col("l_partkey") % 1000) / F.lit(1000.0)).alias("p"), (F.col("l_suppkey") % 3 == 0).cast("double").alias("y"))
    return spark.createDataFrame([(round(compare.ece(df, "p", "y"), 9), round(compare.brier(df, "p", "y"), 9))], "ece double, brier double")


# Driver lines and image matches.

_LINES = "lines AS (SELECT 'L' || p_partkey AS line, CASE WHEN p_partkey % 5 = 0 THEN NULL ELSE (p_size % 7)::DOUBLE END AS quality, list_filter(list_transform(regexp_split_to_array(p_brand || CASE WHEN p_partkey % 3 = 0 THEN ';' || p_type ELSE '' END, '[,;]'), lambda x: trim(x)), lambda x: x <> '') AS cell_types, p_partkey AS k FROM part)"


def _lines(spark, sf_dir):
    x = view.table(spark, sf_dir, "part")
    types = F.when(F.col("p_partkey") % 3 == 0, F.concat("p_brand", F.lit(";"), "p_type")).otherwise(F.col("p_brand"))
    quality = F.when(F.col("p_partkey") % 5 != 0, (F.col("p_size") % 7).cast("double"))
    return convert.convert_lines(x.select(F.concat(F.lit("L"), F.col("p_partkey").cast("string")).alias("line"), quality.alias("quality"), types.alias("cell_types"), F.concat(F.col("p_partkey").cast("string"), F.lit("; n/a,7")).alias("em_ids")))


@_query(f"WITH {_LINES} SELECT line, quality, array_to_string(cell_types, '|') AS cell_types, k || '|7' AS bodies, len(cell_types)::INT AS n_types, 2 AS n_bodies FROM lines")
def driver_lines(spark, sf_dir):
    return _lines(spark, sf_dir).select("line", "quality", F.array_join("cell_types", "|").alias("cell_types"), F.array_join(F.transform("em_body_ids", lambda x: x.cast("string")), "|").alias("bodies"), "n_types", "n_bodies")


@_query(f"WITH {_LINES} SELECT line, quality, len(cell_types) = 1 AS specific FROM lines WHERE quality <= 4 AND len(list_filter(cell_types, lambda x: x GLOB 'Brand#1*')) > 0")
def lines_of_type(spark, sf_dir):
    return access.lines_for_type(_lines(spark, sf_dir), "Brand#1*", min_quality=4.0).select("line", "quality", "specific")


@_query(
    f"WITH {_LINES}, hits AS (SELECT unnest(['Brand#11', 'Brand#2', 'SM ', 'None']) AS label), kinds AS (SELECT line, quality, len(cell_types) = 1 AS specific, unnest(cell_types) AS t FROM lines), e AS (SELECT DISTINCT label, line, quality, specific, 'exact' AS kind FROM hits JOIN kinds ON t = label), "
    "l AS (SELECT DISTINCT label, line, quality, specific, 'glob' AS kind FROM hits JOIN kinds ON starts_with(t, label) AND t <> label WHERE label NOT IN (SELECT label FROM e)), r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY quality IS NULL, quality, NOT specific, line) AS k FROM (SELECT * FROM e UNION ALL SELECT * FROM l)), "
    "b AS (SELECT label, array_to_string(list(line ORDER BY k), '|') AS lines, any_value(kind) AS line_match FROM r WHERE k <= 5 GROUP BY 1) SELECT label, lines, coalesce(line_match, 'none') AS line_match FROM hits LEFT JOIN b USING (label)"
)
def lines_of_hits(spark, sf_dir):
    hits = spark.createDataFrame([("Brand#11",), ("Brand#2",), ("SM ",), ("None",)], "label string")
    return access.attach_lines(hits, _lines(spark, sf_dir)).select("label", F.array_join("lines", "|").alias("lines"), "line_match")


@_query("WITH m AS (SELECT 'fly:lib' || (l_suppkey % 3) || ':' || (l_partkey % 50) AS name, 'lib' || (l_suppkey % 3) AS library, l_quantity::DOUBLE AS s, l_linenumber AS p, l_returnflag = 'R' AS mirrored FROM lineitem) SELECT string_split(name, ':')[3] AS line, library, max(s) AS score, max(p)::INT AS pixels, count(*) AS n_matches, bool_or(mirrored) AS mirrored FROM m GROUP BY 1, 2")
def image_matches(spark, sf_dir):
    x = view.table(spark, sf_dir, "lineitem")
    lib = F.concat(F.lit("lib"), (F.col("l_suppkey") % 3).cast("string"))
    name = F.concat(F.lit("fly:"), lib, F.lit(":"), (F.col("l_partkey") % 50).cast("string"))
    records = x.select(F.struct(name.alias("publishedName"), lib.alias("libraryName")).alias("image"), F.col("l_quantity").cast("double").alias("normalizedScore"), F.col("l_linenumber").cast("int").alias("matchingPixels"), (F.col("l_returnflag") == "R").alias("mirrored"))
    return access.best_matches(records, direction="em_to_lm")


# Simulation tables, on spike counts made from line items.

_SPIKES = "spikes AS (SELECT CASE WHEN l_linenumber % 2 = 0 THEN 'stimulated' ELSE 'baseline' END AS condition, (l_orderkey % 4)::INT AS trial, 1000000000 + l_suppkey AS neuron_id, sum(l_quantity)::BIGINT AS n FROM lineitem WHERE l_suppkey % 5 <> 0 GROUP BY 1, 2, 3)"


def _spikes(spark, sf_dir):
    x = view.table(spark, sf_dir, "lineitem").where(F.col("l_suppkey") % 5 != 0)
    condition = F.when(F.col("l_linenumber") % 2 == 0, "stimulated").otherwise("baseline")
    return x.groupBy(condition.alias("condition"), (F.col("l_orderkey") % 4).cast("int").alias("trial"), (F.col("l_suppkey") + view.SUPPLIER).alias("neuron_id")).agg(F.sum("l_quantity").cast("long").alias("count"))


@_query(f"WITH {_SPIKES}, s AS (SELECT condition, neuron_id, sum(n) AS t, sum(n * n) AS q FROM spikes GROUP BY 1, 2), a AS (SELECT condition, 1000000000 + s_suppkey AS neuron_id FROM supplier, (SELECT DISTINCT condition FROM spikes)) SELECT condition, neuron_id, round(coalesce(t, 0) / 4 / 2, 9) AS rate_hz_mean, round(sqrt(greatest(coalesce(q, 0) - coalesce(t, 0) * coalesce(t, 0) / 4, 0) / 3) / 2, 6) AS rate_hz_std, coalesce(t, 0)::BIGINT AS spikes_total, coalesce(t, 0) > 0 AS spiked_in_any_trial FROM a LEFT JOIN s USING (condition, neuron_id)")
def firing_rates(spark, sf_dir):
    nodes = view.table(spark, sf_dir, "supplier").select((F.col("s_suppkey") + view.SUPPLIER).alias("neuron_id"))
    return sim.rates_table(_spikes(spark, sf_dir), nodes, n_trials=4, seconds=2.0).select("condition", "neuron_id", _r("rate_hz_mean"), F.round("rate_hz_std", 6).alias("rate_hz_std"), "spikes_total", "spiked_in_any_trial")


@_query(f"WITH {_SPIKES}, m AS (SELECT n_name AS label, 1000000000 + s_suppkey AS neuron_id FROM supplier JOIN nation ON s_nationkey = n_nationkey), z AS (SELECT label, count(*) AS n FROM m GROUP BY 1), s AS (SELECT condition, label, trial, sum(n) AS t FROM spikes JOIN m USING (neuron_id) GROUP BY ALL), a AS (SELECT condition, label, t::INT AS trial, n FROM z, (SELECT DISTINCT condition FROM spikes), range(4) r(t)) SELECT condition, label, trial, round(coalesce(t, 0) / n / 2, 9) AS hz FROM a LEFT JOIN s USING (condition, label, trial)")
def readout_rates(spark, sf_dir):
    n = view.table(spark, sf_dir, "nation")
    m = view.table(spark, sf_dir, "supplier").join(F.broadcast(n), F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("n_name").alias("label"), (F.col("s_suppkey") + view.SUPPLIER).alias("neuron_id"))
    return sim.group_rates(_spikes(spark, sf_dir), m, n_trials=4, seconds=2.0).select("condition", "label", "trial", _r("hz"))


@_query(f"WITH {_SPIKES} SELECT condition, sum(n)::BIGINT AS total_spikes, count(DISTINCT neuron_id) AS active_neurons FROM spikes GROUP BY 1")
def conditions_table(spark, sf_dir):
    return sim.conditions_summary(_spikes(spark, sf_dir))


@_query("WITH g AS (SELECT c_nationkey AS label, c_custkey AS neuron_id FROM customer), n AS (SELECT c_custkey AS neuron_id, CASE WHEN c_custkey % 4 > 0 THEN c_mktsegment END AS sc FROM customer), c AS (SELECT label, sc, count(*) AS c FROM g JOIN n USING (neuron_id) WHERE sc IS NOT NULL GROUP BY 1, 2), b AS (SELECT label, sc FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY c DESC, sc) AS r FROM c) WHERE r = 1), z AS (SELECT label, count(*) AS n FROM g GROUP BY 1) SELECT label, coalesce(sc, 'unknown') AS super_class, (CASE WHEN n <= 1 THEN 1 ELSE pow(2, round_even(log2(n), 0)) END)::BIGINT AS bin FROM z LEFT JOIN b USING (label)")
def null_group_keys(spark, sf_dir):
    c = view.table(spark, sf_dir, "customer")
    neurons = c.select(F.col("c_custkey").alias("neuron_id"), F.when(F.col("c_custkey") % 4 > 0, F.col("c_mktsegment")).alias("super_class"))
    return stats.null_keys(neurons, c.select(F.col("c_nationkey").alias("label"), F.col("c_custkey").alias("neuron_id")))


# Scalars.


@_query("SELECT p_partkey, (CASE WHEN p_size <= 1 THEN 1 ELSE pow(2, round_even(log2(p_size), 0)) END)::BIGINT AS bin, CASE WHEN (p_partkey % 10) / 100.0 >= 0.05 OR (p_size - 10) / 100.0 <= 0 THEN 'not distinguishable' WHEN (p_size - 10) / 100.0 <= 0.045 + 0.096 THEN 'differs within the usual range' ELSE 'differs' END AS verdict FROM part")
def bins_and_verdicts(spark, sf_dir):
    x = view.table(spark, sf_dir, "part")
    return x.select("p_partkey", scalars.size_bin(F.col("p_size")).alias("bin"), scalars.verdict((F.col("p_partkey") % 10) / F.lit(100.0), (F.col("p_size") - 10) / F.lit(100.0)).alias("verdict"))


@_query("WITH a AS (SELECT p_partkey, list_distinct(string_split(p_name, ' ')) AS x, list_distinct(string_split(p_type, ' ')) || CASE WHEN p_partkey % 2 = 0 THEN [string_split(p_name, ' ')[1]] ELSE [] END AS y FROM part) SELECT p_partkey, round(len(list_intersect(x, y)) / len(list_distinct(x || y)), 9) AS jaccard FROM a")
def set_overlap(spark, sf_dir):
    x = view.table(spark, sf_dir, "part")
    a = F.split("p_name", " ")
    b = F.concat(F.array_distinct(F.split("p_type", " ")), F.when(F.col("p_partkey") % 2 == 0, F.slice(a, 1, 1)).otherwise(F.expr("cast(array() as array<string>)")))
    return x.select("p_partkey", F.round(scalars.jaccard(F.array_distinct(a), b), 9).alias("jaccard"))


@_query("WITH n AS (SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN 'em:' || p_brand || ':' || p_type ELSE p_name END AS name FROM part), s AS (SELECT *, string_split(name, ':') AS x FROM n) SELECT p_partkey, CASE WHEN len(x) = 3 THEN x[1] ELSE 'line' END AS kind, CASE WHEN len(x) = 3 THEN x[2] ELSE '' END AS library, CASE WHEN len(x) = 3 THEN x[3] ELSE name END AS name FROM s")
def published_names(spark, sf_dir):
    x = view.table(spark, sf_dir, "part")
    name = F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("em:"), "p_brand", F.lit(":"), "p_type")).otherwise(F.col("p_name"))
    return x.select("p_partkey", scalars.published_name(name).alias("n")).select("p_partkey", "n.*")


# Converters, on tables of their releases' columns made from the same data.

_CE = "SELECT l_suppkey AS pre, 1000 + l_partkey AS post, sum(l_quantity)::INT AS weight FROM lineitem GROUP BY 1, 2"


def _ids(spark, sf_dir):
    """Suppliers and, 1000 up, parts as neurons; edges between them from line items."""
    s = view.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.lit("ALPN").alias("t"))
    q = view.table(spark, sf_dir, "part").where("p_partkey % 7 <> 0").select((F.col("p_partkey") + 1000).alias("id"), F.col("p_brand").alias("t"))
    e = view.table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("pre"), (F.col("l_partkey") + 1000).alias("post")).agg(F.sum("l_quantity").cast("int").alias("weight"))
    return s.unionByName(q), e


_CN = "SELECT s_suppkey AS id, 'ALPN' AS t FROM supplier UNION ALL SELECT 1000 + p_partkey, p_brand FROM part WHERE p_partkey % 7 <> 0"


@_query(
    f"WITH n AS ({_CN}), e AS ({_CE}) SELECT id AS neuron_id, CASE WHEN id % 3 = 0 THEN NULL ELSE t END AS cell_type, CASE id % 4 WHEN 0 THEN 'gaba' WHEN 1 THEN 'acetylcholine' WHEN 2 THEN 'dopamine' END AS nt_pred, CASE WHEN id % 4 = 3 THEN NULL WHEN id % 4 IN (0, 1) AND id % 2 = 0 THEN 0.25 WHEN id % 4 = 1 THEN 0.5 WHEN id % 4 = 2 THEN NULL END::DOUBLE AS nt_conf, "
    "coalesce((SELECT sum(weight) FROM e WHERE post = id), 0)::BIGINT AS input_synapses_total, coalesce((SELECT sum(weight) FROM e WHERE pre = id), 0)::BIGINT AS output_synapses_total, coalesce((SELECT sum(weight) FROM e WHERE pre = id AND post IN (SELECT id FROM n)), 0)::BIGINT AS output_synapses_neurons FROM n"
)
def converted_malecns(spark, sf_dir):
    n, e = _ids(spark, sf_dir)
    k = F.col("id") % 4
    none = F.lit(None).cast("string")
    notes = n.select(F.col("id").alias("bodyId"), F.lit("cb_intrinsic").alias("superclass"), none.alias("statusLabel"), F.lit("Traced").alias("status"), none.alias("class"), none.alias("subclass"), F.when(F.col("id") % 3 == 0, F.lit(" ")).otherwise(F.col("t")).alias("type"), none.alias("itoleeHl"), none.alias("trumanHl"), F.lit("L").alias("somaSide"), none.alias("somaNeuromere"), none.alias("flywireType"), none.alias("hemibrainType"), none.alias("mancType"), none.alias("dimorphism"), none.alias("vfbId"))
    nt = n.select(
        F.col("id").alias("body"),
        F.when(k == 0, "GABA").when(k == 1, "acetylcholine").when(k == 2, "dopamine").otherwise("unclear").alias("consensus_nt"),
        F.when(k == 0, "gaba").otherwise("glutamate").alias("predicted_nt"),
        F.when(k == 1, "acetylcholine").otherwise("glutamate").alias("celltype_predicted_nt"),
        F.lit(0.25).alias("predicted_nt_confidence"),
        F.lit(0.5).alias("celltype_predicted_nt_confidence"),
        none.alias("ground_truth"),
    )
    neurons, _ = convert.convert_malecns(notes, nt, e.select(F.col("pre").alias("body_pre"), F.col("post").alias("body_post"), "weight"))
    return neurons.select("neuron_id", "cell_type", "nt_pred", F.col("nt_conf").cast("double").alias("nt_conf"), "input_synapses_total", "output_synapses_total", "output_synapses_neurons")


@_query(f"WITH n AS ({_CN}), e AS ({_CE}) SELECT pre, post, weight FROM e WHERE pre <> post AND pre IN (SELECT id FROM n) AND post IN (SELECT id FROM n)")
def converted_hemibrain(spark, sf_dir):
    """Edges between traced bodies; autapses go. Suppliers above 1000 have the ids of parts, so line items make autapses too."""
    n, e = _ids(spark, sf_dir)
    traced = n.select(F.col("id").alias("bodyId"), F.col("t").alias("type"), F.lit(None).cast("string").alias("instance"))
    loops = e.select(F.col("pre").alias("bodyId_pre"), F.col("pre").alias("bodyId_post"), "weight")
    rows = e.select(F.col("pre").alias("bodyId_pre"), F.col("post").alias("bodyId_post"), "weight").unionByName(loops)
    return convert.convert_hemibrain(traced, rows)[1].select("pre", "post", "weight")


@_query("SELECT l_suppkey AS pre, 1000 + l_partkey AS post, sum(l_quantity)::INT AS weight FROM lineitem GROUP BY 1, 2")
def converted_flywire(spark, sf_dir):
    n, _ = _ids(spark, sf_dir)
    none = F.lit(None).cast("string")
    nt = ("ach_avg", "glut_avg", "gaba_avg", "da_avg", "oct_avg", "ser_avg")
    neurons = n.select(F.col("id").alias("root_id"), F.lit("ACH").alias("nt_type"), F.lit(0.5).alias("nt_type_score"), *(F.lit(0.1).alias(c) for c in nt))
    classes = n.select(F.col("id").alias("root_id"), F.lit("intrinsic").alias("flow"), F.lit("central").alias("super_class"), none.alias("class"), none.alias("sub_class"), none.alias("hemilineage"), F.lit("left").alias("side"), none.alias("cell_type"), F.lit(1).alias("_row"))
    types = n.select(F.col("id").alias("root_id"), F.col("t").alias("cell_type"), none.alias("hemibrain_type"), F.lit(1).alias("_row"))
    x = view.table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("pre_root_id"), (F.col("l_partkey") + 1000).alias("post_root_id"), F.col("l_quantity").cast("int").alias("syn_count"), F.col("l_returnflag").alias("neuropil"))
    return convert.convert_flywire(neurons, classes, types, x)[1].select("pre", "post", "weight")


@_query(f"WITH n AS ({_CN}), e AS ({_CE}) SELECT id AS neuron_id, CASE WHEN id % 2 = 0 THEN 'acetylcholine' ELSE 'gaba' END AS nt_pred FROM n WHERE id IN (SELECT pre FROM e) UNION ALL SELECT id, NULL FROM n WHERE id NOT IN (SELECT pre FROM e)")
def converted_shiu(spark, sf_dir):
    n, e = _ids(spark, sf_dir)
    sign = F.when(F.col("pre") % 2 == 0, 1).otherwise(-1)
    rows = e.select(F.col("pre").alias("Presynaptic_ID"), F.col("post").alias("Postsynaptic_ID"), F.col("weight").alias("Connectivity"), sign.alias("Excitatory"))
    return convert.convert_shiu(n.select("id"), rows)[0].select("neuron_id", "nt_pred")


# Null distributions.

_NULLS, _NULL_SEED = 20, 3


@_query(
    f"""WITH {view.SQL_NODES}, {view.SQL_EDGES}, label AS (SELECT neuron_id, cell_type AS label FROM neurons),
a AS (SELECT neuron_id, row_number() OVER (ORDER BY neuron_id) AS r FROM signs),
b AS (SELECT k AS null_, sign, row_number() OVER (PARTITION BY k ORDER BY ('0x' || substr(md5(({_NULL_SEED} * 1000003 + k) || ':' || neuron_id), 1, 8))::UBIGINT / 4294967296.0, neuron_id) AS r FROM signs, range(1, {_NULLS + 1}) t(k)),
s AS (SELECT 0 AS null_, neuron_id, sign FROM signs UNION ALL SELECT null_, neuron_id, b.sign FROM b JOIN a USING (r)),
w AS (SELECT pre, label AS post_label, sum(weight) AS weight FROM edges JOIN label ON post = neuron_id GROUP BY 1, 2),
v AS (SELECT null_, label AS pre_label, post_label, sum(weight * sign)::DOUBLE AS value FROM w JOIN label ON pre = neuron_id JOIN s ON s.neuron_id = pre GROUP BY ALL),
m AS (SELECT pre_label, post_label, avg(value) FILTER (null_ > 0) AS null_mean, coalesce(stddev_samp(value) FILTER (null_ > 0), 0) AS null_sd, max(value) FILTER (null_ = 0) AS observed FROM v GROUP BY 1, 2),
f AS (SELECT pre_label, post_label, count(*) AS far FROM v JOIN m USING (pre_label, post_label) WHERE null_ > 0 AND abs(value - null_mean) >= abs(observed - null_mean) GROUP BY 1, 2)
SELECT pre_label, post_label, observed, round(null_mean, 6) AS null_mean, round(null_sd, 6) AS null_sd, round(CASE WHEN null_sd > 0 THEN (observed - null_mean) / null_sd WHEN observed = null_mean THEN 0 ELSE sign(observed - null_mean) * 'inf'::DOUBLE END, 6) AS z,
  (1 + coalesce(far, 0)) / {_NULLS + 1}.0::DOUBLE AS p_two_sided, {_NULLS} AS n_nulls FROM m LEFT JOIN f USING (pre_label, post_label)"""
)
def null_label_weights(spark, sf_dir):
    """Signed weights between types against graphs with shuffled signs: z and p of every pair, all nulls at once."""
    found = nulls.null_table(lambda n: nulls.label_weights(n, "cell_type", signed=True), view.graph(spark, sf_dir), n_nulls=_NULLS, seed=_NULL_SEED, null=nulls.SHUFFLE)
    return found.select("pre_label", "post_label", "observed", F.round("null_mean", 6).alias("null_mean"), F.round("null_sd", 6).alias("null_sd"), F.round("z", 6).alias("z"), "p_two_sided", "n_nulls")


@_query(f"{_E} SELECT k::INT AS \"null\", pre AS id, count(*) AS degree, sum(weight)::BIGINT AS weight, 0::BIGINT AS loops FROM edges, range(0, 4) t(k) GROUP BY 1, 2")
def null_degrees(spark, sf_dir):
    """Out-degrees and out-weights of a graph and three rewired ones, made side by side; all must be alike, without repeated pairs."""
    found = nulls.out_degrees(nulls.null_graphs(view.graph(spark, sf_dir), n_nulls=3, seed=_NULL_SEED))
    return found.select("null", F.col("node").alias("id"), "degree", "weight", "loops")


@_query(f"SELECT path, hops, min_weight, source, target, round(strength, 12) AS strength, path_sign FROM ({_PATHS.format(hops=3, w=5, frac=0, strength=0).replace('round(strength, 12) AS strength', 'strength')}) ORDER BY strength DESC, hops, path LIMIT 25")
def strongest_paths(spark, sf_dir):
    """The 25 strongest paths of up to three hops; the limit is the feature."""
    found = p.strongest_paths(view.graph(spark, sf_dir), SOURCES, TARGETS, 25, max_hops=3, min_weight=5)
    return found.select(F.array_join(F.transform("path", lambda x: x.cast("string")), ">").alias("path"), "hops", "min_weight", "source", "target", F.round("strength", 12).alias("strength"), "path_sign")


# Calibration and resampling.

_BOOT, _FOLDS, _STEPS = 200, 4, 12
_U8 = "('0x' || substr(md5({key}), 1, 8))::UBIGINT / 4294967296.0"
_CUM_POISSON = [sum(math.exp(-1) / math.factorial(i) for i in range(k + 1)) for k in range(calibrate.MOST)]


@_query(
    f"""WITH s AS (SELECT o_orderpriority AS priority, o_custkey AS u, sum(o_totalprice::DOUBLE / 1000) AS s, count(*) AS c FROM orders GROUP BY 1, 2),
d AS (SELECT *, {_U8.format(key="'7:' || u || ':' || k")} AS x FROM s, range(1, {_BOOT + 1}) t(k)),
w AS (SELECT *, CASE {' '.join(f'WHEN x < {c!r} THEN {k}' for k, c in enumerate(_CUM_POISSON))} ELSE {calibrate.MOST} END AS w FROM d),
m AS (SELECT priority, k, sum(w * s) / sum(w * c) AS m FROM w WHERE w > 0 GROUP BY 1, 2),
q AS (SELECT priority, quantile_cont(m, 0.025) AS low, quantile_cont(m, 0.975) AS high FROM m GROUP BY 1)
SELECT priority, count(*) AS n_units, sum(c)::BIGINT AS n, round(sum(s) / sum(c), 6) AS mean, round(any_value(low), 6) AS ci_low, round(any_value(high), 6) AS ci_high FROM s JOIN q USING (priority) GROUP BY 1"""
)
def bootstrap_by_customer(spark, sf_dir):
    """Mean order value per priority with its interval over draws of whole customers."""
    rows = view.table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("priority"), "o_custkey", (F.col("o_totalprice").cast("double") / 1000).alias("v"))
    got = calibrate.bootstrap_means(rows, "o_custkey", "v", by=["priority"], n_boot=_BOOT, seed=7)
    return got.select("priority", "n_units", "n", *(F.round(c, 6).alias(c) for c in ("mean", "ci_low", "ci_high")))


def _outcomes(spark, sf_dir):
    c = view.table(spark, sf_dir, "customer")
    k, x = F.col("c_custkey"), F.col("c_acctbal").cast("double") / 1000
    rows = c.select(k.alias("id"), x.alias("x"), (x + (k % 11) - 5 > 4.5).alias("correct"), ((k * 37 % 100) / 100).alias("margin"), ((k * 53 % 1000) / 1000).alias("s1"))
    return p.settle(rows.withColumn("fold", calibrate.fold_of(F.col("id"), _FOLDS)))


_OUTCOMES = f"r AS (SELECT c_custkey AS id, c_acctbal::DOUBLE / 1000 AS x, c_acctbal::DOUBLE / 1000 + c_custkey % 11 - 5 > 4.5 AS correct, (c_custkey * 37 % 100) / 100 AS margin, (c_custkey * 53 % 1000) / 1000 AS s1, floor({_U8.format(key=chr(39) + '0:' + chr(39) + ' || c_custkey')} * {_FOLDS})::INT AS fold FROM customer)"


def _newton_sql() -> str:
    ctes = [_OUTCOMES, f"m0 AS (SELECT k::INT AS model, 0.0::DOUBLE AS a, 0.0::DOUBLE AS b FROM range(-1, {_FOLDS}) t(k))"]
    for i in range(_STEPS):
        ctes.append(f"g{i} AS (SELECT model, a, b, x, correct::INT AS y, 1 / (1 + exp(-(a * x + b))) AS p FROM m{i} JOIN r ON fold <> model)")
        ctes.append(f"h{i} AS (SELECT model, a, b, sum((p - y) * x) + 1e-4 * a AS ga, sum(p - y) AS gb, sum(p * (1 - p) * x * x) + 1e-4 AS haa, sum(p * (1 - p) * x) AS hab, sum(p * (1 - p)) AS hbb FROM g{i} GROUP BY model, a, b)")
        ctes.append(f"m{i + 1} AS (SELECT model, a - (hbb * ga - hab * gb) / (haa * hbb - hab * hab) AS a, b - (haa * gb - hab * ga) / (haa * hbb - hab * hab) AS b FROM h{i})")
    return f"WITH {', '.join(ctes)} SELECT id, fold, round(1 / (1 + exp(-(a * x + b))), 6) AS p FROM r JOIN m{_STEPS} ON fold = model"


@_query(_newton_sql())
def logistic_out_of_fold(spark, sf_dir):
    """Probabilities of customers by logistic models that did not learn from their fold."""
    rows = _outcomes(spark, sf_dir)
    models = calibrate.fit_logistic_folds(rows, ["x"], "correct", F.col("fold"), n_folds=_FOLDS)
    return calibrate.out_of_fold(rows, models, F.col("fold")).select("id", "fold", F.round("p", 6).alias("p"))


@_query(
    f"""WITH {_OUTCOMES}, k AS (SELECT k::INT AS k FROM range(0, {_FOLDS}) t(k)),
f AS (SELECT k, quantile_cont(s1, 0.9) AS s_floor FROM k JOIN r ON fold <> k WHERE id % 3 = 0 GROUP BY 1),
b AS (SELECT k, least(floor(margin * 20), 19) AS b, count(*) AS n, avg(correct::INT) AS acc FROM k JOIN r ON fold <> k GROUP BY 1, 2),
d AS (SELECT k, (max(b) + 1) / 20 AS delta FROM b WHERE n >= 10 AND acc < 0.5 GROUP BY 1)
SELECT k AS fold, round(coalesce(s_floor, 0), 9) AS s_floor, round(coalesce(delta, 0.01)::DOUBLE, 9) AS delta FROM k LEFT JOIN f USING (k) LEFT JOIN d USING (k)"""
)
def out_of_fold_thresholds(spark, sf_dir):
    rows = _outcomes(spark, sf_dir)
    found = calibrate.out_of_fold_thresholds(rows, rows.where("id % 3 = 0"), n_folds=_FOLDS)
    return found.select("fold", F.round("s_floor", 9).alias("s_floor"), F.round(F.col("delta").cast("double"), 9).alias("delta"))
