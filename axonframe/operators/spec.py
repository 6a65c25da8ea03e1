"""Experiment specifications: what a YAML document may say, with defaults and refusals."""

from __future__ import annotations

import dataclasses
import hashlib
import json
from collections.abc import Callable, Collection, Mapping
from dataclasses import dataclass, field
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame

from .access import resolve_selection
from .graph import ARGMAX, PROBABILISTIC, SAMPLED, UNSIGNED

GLOBS = ("cell_type", "super_class", "cell_class", "side")


@dataclass(frozen=True)
class Selection:
    """Neurons by ids, or by globs on attributes (all must match)."""

    ids: tuple[int, ...] | None = None
    cell_type: str | None = None
    super_class: str | None = None
    cell_class: str | None = None
    side: str | None = None

    def resolve(self, neurons: DataFrame) -> list[int]:
        return resolve_selection(neurons, ids=self.ids, globs={k: v for k in GLOBS if (v := getattr(self, k)) is not None})

    def describe(self) -> str:
        said = {k: getattr(self, k) for k in ("ids", *GLOBS) if getattr(self, k) is not None}
        return ", ".join(f"{k}={v}" for k, v in said.items()) or "all"


@dataclass(frozen=True)
class Stimulus:
    select: Selection
    rate_hz: float


@dataclass(frozen=True)
class Pathway:
    """Ranking of candidates by the paths from the stimulus to a readout."""

    readout: str
    max_hops: int = 3
    min_weight: int = 5
    min_edge_fraction: float = 0.0


@dataclass(frozen=True)
class Sweep:
    """``silence_each`` group of a selection, ranked by activity or pathway, or ``rate_hz`` of the stimulus."""

    kind: str
    select: Selection = Selection()
    group_by: str = "cell_type"
    max_items: int = 50
    rank_by: str = "activity"
    pathway: Pathway | None = None
    rates_hz: tuple[float, ...] = ()


@dataclass(frozen=True)
class Robustness:
    primary_readout: str
    readout_proxy: str | None = None
    w_syn: str | tuple[float, ...] = "auto"
    nt_samples: int = 8
    min_weights: tuple[int, ...] = (3, 5)
    replicate: str | None = "flywire@783"
    null_sets: int = 40
    null_pool: str = "active"
    extra_candidates: tuple[Selection, ...] = ()
    negative_controls: int = 1


@dataclass(frozen=True)
class Controls:
    degree_preserving_rewire: int = 5
    sign_shuffle: int = 5
    unstimulated_baseline: bool = True


@dataclass(frozen=True)
class Report:
    top_neurons: int = 30
    alpha: float = 0.05
    statistics: str = "unpaired"


@dataclass(frozen=True)
class ExperimentSpec:
    """One experiment."""

    name: str
    dataset: str
    stimulate: tuple[Stimulus, ...]
    readouts: Mapping[str, Selection]
    silence: tuple[Selection, ...] = ()
    perturb_stimulate: tuple[Stimulus, ...] = ()
    min_weight: int = 1
    sign_policy: str = ARGMAX
    sign_seed: int | None = None
    duration_ms: float = 1000.0
    trials: int = 30
    seed: int = 0
    device: str = "auto"
    dtype: str = "float32"
    dt_ms: float = 0.1
    controls: Controls = field(default_factory=Controls)
    report: Report = field(default_factory=Report)
    sweep: Sweep | None = None
    w_syn_mv: float | None = None
    robustness: Robustness | None = None

    @property
    def n_steps(self) -> int:
        return round(self.duration_ms / self.dt_ms)

    @property
    def n_trials(self) -> int:
        return self.trials

    @property
    def perturbed(self) -> bool:
        return bool(self.silence or self.perturb_stimulate)

    @property
    def sha256(self) -> str:
        return hashlib.sha256(json.dumps(dataclasses.asdict(self), sort_keys=True, default=str).encode()).hexdigest()

    def describe(self) -> str:
        return f"{self.name} on {self.dataset}: {len(self.stimulate)} stimuli, {len(self.readouts)} readouts, {self.trials} trials of {self.duration_ms:g} ms, seed {self.seed}"


class Block:
    """A mapping of the document and where it stands, for messages."""

    def __init__(self, value: Any, where: str) -> None:
        if not isinstance(value, Mapping):
            raise ValueError(f"{where} must be a mapping, got {value!r}")
        self.value, self.where = value, where

    def only(self, *known: str) -> Block:
        if extra := sorted(set(self.value) - set(known)):
            raise ValueError(f"unknown {self.where} key(s) {extra}; expected some of {sorted(known)}")
        return self

    def need(self, *keys: str) -> Block:
        for k in keys:
            self.check(k in self.value, f"needs {k!r}")
        return self

    def check(self, ok: bool, message: str) -> None:
        if not ok:
            raise ValueError(f"{self.where} {message}")

    def get(self, key: str, kind: Callable[[Any], Any], default: Any = None, *, among: Collection | None = None, least: float | None = None, above: float | None = None) -> Any:
        raw = self.value.get(key)
        if raw is None:
            return default
        if kind is int:
            self.check(isinstance(raw, int) and not isinstance(raw, bool), f"{key} must be an int, got {raw!r}")
        out = kind(raw)
        self.check(among is None or out in among, f"{key} must be one of {sorted(among or [])}, got {out!r}")
        self.check(least is None or out >= least, f"{key} must be >= {least}, got {out!r}")
        self.check(above is None or out > above, f"{key} must be > {above}, got {out!r}")
        return out

    def block(self, key: str) -> Block:
        return Block(self.value.get(key) or {}, key)

    def items(self, key: str) -> list[Block]:
        rows = self.value.get(key) or []
        self.check(isinstance(rows, list), f"{key} must be a list")
        return [Block(x, key) for x in rows]


def _selection(value: Any) -> Selection:
    b = Block(value, "select").only("ids", *GLOBS)
    return Selection(b.get("ids", lambda x: tuple(map(int, x))), *(b.get(k, str) for k in GLOBS))


def _stimuli(b: Block, key: str) -> tuple[Stimulus, ...]:
    return tuple(Stimulus(_selection(x.need("select", "rate_hz").value["select"]), float(x.value["rate_hz"])) for x in b.items(key))


def _sweep(value: Any, readouts: Collection[str]) -> Sweep:
    b = Block(value, "sweep").only("silence_each", "rate_hz")
    b.check(len(b.value) == 1, "needs exactly one of silence_each and rate_hz")
    if "rate_hz" in b.value:
        rates = b.value["rate_hz"]
        b.check(isinstance(rates, list) and len(rates) > 0, "rate_hz must be a non-empty list")
        rates = tuple(map(float, rates))
        b.check(min(rates) > 0 and len(set(rates)) == len(rates), f"each rate_hz has to be above 0 and given once: {rates}")
        return Sweep("rate_hz", rates_hz=rates)
    s = Block(b.value["silence_each"], "sweep silence_each").only("select", "group_by", "max_items", "rank_by", "pathway")
    rank_by, pathway = s.get("rank_by", str, "activity", among=("activity", "pathway")), None
    s.check(rank_by == "pathway" or "select" in s.value, "needs a 'select' unless it ranks by pathway")
    if rank_by == "pathway":
        w = Block(s.value.get("pathway"), "pathway").need("readout").only("readout", "max_hops", "min_weight", "min_edge_fraction")
        pathway = Pathway(w.get("readout", str, among=readouts), w.get("max_hops", int, 3), w.get("min_weight", int, 5), w.get("min_edge_fraction", float, 0.0))
        w.check(2 <= pathway.max_hops <= 4, "a pathway takes 2, 3 or 4 max_hops; with one hop nothing lies between")
    chosen = _selection(s.value["select"]) if "select" in s.value else Selection()
    return Sweep("silence_each", chosen, s.get("group_by", str, "cell_type"), s.get("max_items", int, 50, least=1), rank_by, pathway)


def _robustness(value: Any, dataset: str, sweep: Sweep | None, readouts: Collection[str]) -> Robustness:
    b = Block(value, "robustness").only("primary_readout", "readout_proxy", "w_syn", "nt_samples", "min_weights", "replicate", "random_null", "extra_candidates", "negative_controls")
    b.check(sweep is not None and sweep.kind == "silence_each", "needs a silence_each sweep")
    b.check(b.value.get("primary_readout") in readouts, f"primary_readout must name a readout; have {sorted(readouts)}")
    w = b.value.get("w_syn", "auto")
    good = w in ("auto", "off") if isinstance(w, str) else isinstance(w, list) and len(w) > 0 and all(isinstance(x, int | float) and x > 0 for x in w)
    b.check(good, f"w_syn is 'auto', 'off' or mV values above 0, not {w!r}")
    weights = tuple(map(int, b.value.get("min_weights", [3, 5]) or []))
    b.check(all(x >= 1 for x in weights) and len(set(weights)) == len(weights), f"each of min_weights has to be 1 or more and given once: {weights}")
    replicate = b.value.get("replicate", "flywire@783")
    b.check(replicate != dataset, f"replicate must differ from the dataset ({dataset})")
    null, pool = b.value.get("random_null"), "active"
    if isinstance(null, Mapping):
        n = Block(null, "random_null").only("n_sets", "pool")
        null, pool = n.get("n_sets", int, 40), n.get("pool", str, "active", among=("active", "all"))
    b.check(null is None or isinstance(null, int), f"random_null must be true, false, a number or a mapping, got {null!r}")
    sets = 40 if null is None or null is True else int(null)
    b.check(sets >= 0, "random_null must be >= 0")
    return Robustness(
        b.get("primary_readout", str),
        b.get("readout_proxy", str),
        w if isinstance(w, str) else tuple(map(float, w)),
        b.get("nt_samples", int, 8, least=0),
        weights,
        None if replicate is None else str(replicate),
        sets,
        pool,
        tuple(_selection(x.value) for x in b.items("extra_candidates")),
        b.get("negative_controls", int, 1, least=0),
    )


def spec_from_dict(data: Mapping) -> ExperimentSpec:
    """Read and check a specification."""
    d = Block(data, "experiment").need("name", "dataset")
    d.only("name", "dataset", "stimulate", "readouts", "perturb", "network", "duration_ms", "trials", "seed", "device", "dtype", "controls", "report", "sweep", "params", "robustness")
    readouts = {str(r.value["name"]): _selection(r.value["select"]) for r in (x.need("name", "select") for x in d.items("readouts"))}
    d.check(bool(readouts), "needs at least one readout")
    stimulate, perturb = _stimuli(d, "stimulate"), d.block("perturb").only("silence", "stimulate")
    sweep = _sweep(d.value["sweep"], readouts) if d.value.get("sweep") is not None else None
    d.check(not (sweep and perturb.value), "cannot have both 'sweep' and 'perturb'")
    d.check(sweep is None or sweep.kind != "rate_hz" or bool(stimulate), "needs a 'stimulate' whose rate the sweep varies")
    net = d.block("network").only("min_weight", "sign_policy", "sign_seed")
    policy, seed = net.get("sign_policy", str, ARGMAX, among=(ARGMAX, PROBABILISTIC, SAMPLED, UNSIGNED)), net.get("sign_seed", int)
    net.check((policy == SAMPLED) == (seed is not None), "needs sign_seed with sign_policy sampled, and only then")
    ctl = d.block("controls").only(*(f.name for f in dataclasses.fields(Controls)))
    controls = Controls(ctl.get("degree_preserving_rewire", int, 5, least=0), ctl.get("sign_shuffle", int, 5, least=0), ctl.get("unstimulated_baseline", bool, True))
    robustness = _robustness(d.value["robustness"], str(d.value["dataset"]), sweep, readouts) if d.value.get("robustness") is not None else None
    rep = d.block("report").only(*(f.name for f in dataclasses.fields(Report)))
    report = Report(rep.get("top_neurons", int, 30), rep.get("alpha", float, 0.05), rep.get("statistics", str, "paired" if robustness else "unpaired", among=("paired", "unpaired")))
    rep.check(report.statistics == "unpaired" or sweep is not None, "paired statistics compare the runs of a sweep, and there is none")
    return ExperimentSpec(
        name=str(d.value["name"]),
        dataset=str(d.value["dataset"]),
        stimulate=stimulate,
        readouts=readouts,
        silence=tuple(_selection(x.need("select").value["select"]) for x in perturb.items("silence")),
        perturb_stimulate=_stimuli(perturb, "stimulate"),
        min_weight=net.get("min_weight", int, 1, least=1),
        sign_policy=policy,
        sign_seed=seed,
        duration_ms=d.get("duration_ms", float, 1000.0, above=0),
        trials=d.get("trials", int, 30, least=1),
        seed=d.get("seed", int, 0),
        device=d.get("device", str, "auto"),
        dtype=d.get("dtype", str, "float32"),
        controls=controls,
        report=report,
        sweep=sweep,
        w_syn_mv=d.block("params").only("w_syn_mv").get("w_syn_mv", float, above=0),
        robustness=robustness,
    )


def load_spec(path: str) -> ExperimentSpec:
    import yaml

    return spec_from_dict(yaml.safe_load(Path(path).read_text()))
