"""Harmonised tables of neurons and edges, their vocabularies, and conforming frames to them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Transmitter classes in order, source spellings, spellings that mean unknown.
NT_CLASSES = ("acetylcholine", "glutamate", "gaba", "dopamine", "octopamine", "serotonin", "histamine", "tyramine")
NT_ALIASES = {
    "ach": "acetylcholine", "acetylcholine": "acetylcholine", "cholinergic": "acetylcholine",
    "gaba": "gaba", "gabaergic": "gaba",
    "glut": "glutamate", "glu": "glutamate", "glutamate": "glutamate", "glutamatergic": "glutamate",
    "da": "dopamine", "dopamine": "dopamine", "dopaminergic": "dopamine",
    "ser": "serotonin", "5ht": "serotonin", "5-ht": "serotonin", "serotonin": "serotonin", "serotonergic": "serotonin",
    "oct": "octopamine", "oa": "octopamine", "octopamine": "octopamine", "octopaminergic": "octopamine",
    "hist": "histamine", "his": "histamine", "histamine": "histamine", "histaminergic": "histamine",
    "tyr": "tyramine", "ta": "tyramine", "tyramine": "tyramine", "tyraminergic": "tyramine",
}
NT_UNKNOWN = ("", "unclear", "unknown", "neither", "none", "nan", "na")
NT_INHIBITORY = ("gaba", "glutamate", "histamine")

# Super classes per source, sides.
SUPER_CLASSES = {
    "codex_fafb": {"central": "central_brain_intrinsic", "optic": "optic_lobe_intrinsic"},
    "malecns": {
        "cb_intrinsic": "central_brain_intrinsic", "ol_intrinsic": "optic_lobe_intrinsic", "vnc_intrinsic": "ventral_nerve_cord_intrinsic",
        "cb_sensory": "sensory", "ol_sensory": "sensory", "vnc_sensory": "sensory",
        "ascending_neuron": "ascending", "descending_neuron": "descending", "vnc_motor": "motor", "cb_motor": "motor",
        "cb_endocrine": "endocrine", "vnc_endocrine": "endocrine", "vnc_efferent": "efferent", "cb_efferent": "efferent",
        "efferent_ascending": "efferent_ascending", "efferent_descending": "efferent_descending",
    },
    "manc": {
        "intrinsic neuron": "ventral_nerve_cord_intrinsic", "intrinsic_neuron": "ventral_nerve_cord_intrinsic",
        "sensory neuron": "sensory", "ascending neuron": "ascending", "descending neuron": "descending", "motor neuron": "motor",
        "efferent neuron": "efferent", "sensory ascending": "sensory_ascending", "efferent ascending": "efferent_ascending",
    },
    "banc": {},
    "sjcabs": {},
}
SIDES = {
    "l": "left", "left": "left", "lhs": "left",
    "r": "right", "right": "right", "rhs": "right",
    "m": "center", "mid": "center", "midline": "center", "middle": "center", "center": "center", "centre": "center", "bil": "center",
}

_TEXT = T.StringType()
# The names, order and types of the harmonised columns.
NEURON_TEXTS = (
    "status",
    "flow",
    "super_class",
    "super_class_raw",
    "cell_class",
    "cell_sub_class",
    "cell_type",
    "hemilineage",
    "hemilineage_truman",
    "side",
    "soma_neuromere",
    "nt_pred",
)
NEURON_LABELS = (
    "nt_source",
    "nt_known",
    "fafb_783_cell_type",
    "hemibrain_121_cell_type",
    "manc_121_cell_type",
    "malecns_10_cell_type",
    "dimorphism",
    "vfb_id",
)
NEURONS = T.StructType(
    [T.StructField("dataset", _TEXT), T.StructField("version", _TEXT), T.StructField("neuron_id", T.LongType())]
    + [T.StructField(c, _TEXT) for c in NEURON_TEXTS]
    + [T.StructField("nt_conf", T.DoubleType())]
    + [T.StructField(f"nt_p_{c}", T.FloatType()) for c in NT_CLASSES]
    + [T.StructField(c, _TEXT) for c in NEURON_LABELS]
)
EDGES = T.StructType(
    [
        T.StructField("dataset", _TEXT),
        T.StructField("version", _TEXT),
        T.StructField("pre", T.LongType()),
        T.StructField("post", T.LongType()),
        T.StructField("weight", T.IntegerType()),
        T.StructField("roi", _TEXT),
    ]
)
REQUIRED = {
    "neurons": ("dataset", "version", "neuron_id"),
    "edges": ("dataset", "version", "pre", "post", "weight"),
}


def _conform(df: DataFrame, schema: T.StructType, required: tuple[str, ...]) -> DataFrame:
    missing = [c for c in required if c not in df.columns]
    if missing:
        raise ValueError(f"missing required columns: {missing}")
    known = [F.col(f.name).cast(f.dataType).alias(f.name) if f.name in df.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in schema]
    return df.select(*known, *(c for c in df.columns if c not in schema.names))


def conform_neurons(df: DataFrame) -> DataFrame:
    """Schema columns first (cast, or null where absent), extra columns after them in their order."""
    return _conform(df, NEURONS, REQUIRED["neurons"])


def conform_edges(df: DataFrame) -> DataFrame:
    return _conform(df, EDGES, REQUIRED["edges"])
