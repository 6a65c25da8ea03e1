"""A seeded random connectome of any size, made in tasks."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import hash_uniform
from ..schema import NT_CLASSES

SUPER_CLASSES = ("central_brain_intrinsic", "optic_lobe_intrinsic", "sensory", "descending", "motor")
FIRST_ID = 10_001


def synthetic_connectome(spark: SparkSession, n_neurons: int = 50, n_edges: int = 200, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """(neurons, edges): neurons with class probabilities that sum to 1 (the likeliest is ``nt_pred``), and distinct edges
    without self-loops.

    Edge i joins the pair with number (a i + b) modulo the number of pairs, a having no factor in common with it, so that no
    pair repeats and nothing has to be compared."""
    pairs = n_neurons * (n_neurons - 1)
    if n_edges > pairs:
        raise ValueError(f"{n_edges} edges are more than the {pairs} pairs")
    draw = lambda name, c: hash_uniform(F.lit(seed), F.lit(name), F.col(c))
    pick = lambda values, u: F.get(F.lit(list(values)), F.floor(u * len(values)).cast("int"))
    rows = spark.range(FIRST_ID, FIRST_ID + n_neurons).withColumnRenamed("id", "neuron_id")
    # Squared exponentials, normalised: a few classes take most of the mass.
    rows = rows.withColumns({f"_e{i}": F.pow(-F.log(1 - draw(f"nt{i}", "neuron_id")), F.lit(2)) for i in range(len(NT_CLASSES))})
    total = sum((F.col(f"_e{i}") for i in range(1, len(NT_CLASSES))), F.col("_e0"))
    rows = rows.withColumns({f"nt_p_{nt}": F.col(f"_e{i}") / total for i, nt in enumerate(NT_CLASSES)})
    best = F.greatest(*(F.struct(F.col(f"nt_p_{nt}").alias("p"), F.lit(nt).alias("nt")) for nt in NT_CLASSES))
    tag = [F.lit("synthetic").alias("dataset"), F.lit("0").alias("version")]
    kind = F.concat(F.lit("T"), F.lpad(F.floor(draw("type", "neuron_id") * max(1, n_neurons // 3)).cast("string"), 3, "0"))
    neurons = rows.select(*tag, "neuron_id", pick(SUPER_CLASSES, draw("class", "neuron_id")).alias("super_class"), kind.alias("cell_type"), pick(("left", "right"), draw("side", "neuron_id")).alias("side"), best["nt"].alias("nt_pred"), best["p"].alias("nt_conf"), *(f"nt_p_{nt}" for nt in NT_CLASSES))
    step = next(a for a in range(max(1, int(pairs * 0.618)), pairs + 2) if math.gcd(a, pairs) == 1) if pairs > 1 else 1
    code = F.pmod(F.col("id").cast("decimal(38,0)") * step + seed, F.lit(max(1, pairs)).cast("decimal(38,0)")).cast("long")
    edges = spark.range(n_edges).withColumn("code", code).withColumn("a", F.floor(F.col("code") / (n_neurons - 1))).withColumn("b", F.col("code") % (n_neurons - 1))
    weight = 1 + F.floor(F.log(1 - draw("weight", "code")) / math.log(0.75))
    return neurons, edges.select(*tag, (F.col("a") + FIRST_ID).cast("long").alias("pre"), (F.col("b") + F.when(F.col("b") >= F.col("a"), 1).otherwise(0) + FIRST_ID).cast("long").alias("post"), weight.cast("int").alias("weight"))
