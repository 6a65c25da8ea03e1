"""Command line: datasets, experiments and classification."""

from __future__ import annotations

import argparse
import json

from pyspark.sql import SparkSession

VERSION = "0.1.0"

# The released datasets that the converters read.
DATASETS = {
    "banc@888": "whole nervous system, female",
    "flylight_lines@meissner2025": "driver-line catalogue",
    "flywire@630": "brain, female, first release",
    "flywire@783": "brain, female",
    "hemibrain@1.2.1": "half of a brain, female",
    "malecns@1.0": "whole nervous system, male",
    "manc@1.2.1": "nerve cord, male",
    "shiu@630": "simulation network",
}


def _session() -> SparkSession:
    return SparkSession.builder.appName("axonframe").getOrCreate()


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="axonframe")
    p.add_argument("--version", action="version", version=VERSION)
    sub = p.add_subparsers(dest="command", required=True)
    data = sub.add_parser("data").add_subparsers(dest="action", required=True)
    data.add_parser("list")
    info = data.add_parser("info")
    info.add_argument("root")
    get = data.add_parser("pull")
    get.add_argument("ref")
    get.add_argument("--registry", required=True, help="folder of dataset descriptions")
    get.add_argument("--cache", required=True)
    get.add_argument("--level", default="meta")
    get.add_argument("--force", action="store_true")
    run = sub.add_parser("run")
    run.add_argument("spec")
    run.add_argument("--store", required=True)
    run.add_argument("--out", required=True)
    run.add_argument("--w-syn", type=float, nargs="*", help="limits in mV that w_syn: auto takes")
    cl = sub.add_parser("classify")
    cl.add_argument("--query", required=True)
    cl.add_argument("--atlas", required=True)
    cl.add_argument("--cell-type")
    cl.add_argument("--ids", help="file with one id per line")
    cl.add_argument("--min-weight", type=int, default=5)
    bench = sub.add_parser("bench", help="hold-out benchmark of the classification")
    bench.add_argument("--query", required=True, action="append")
    bench.add_argument("--atlas", required=True)
    bench.add_argument("--out", required=True)
    bench.add_argument("--truth-column", default="fafb_783_cell_type")
    bench.add_argument("--max-types", type=int, default=2000)
    bench.add_argument("--folds", type=int, default=5)
    bench.add_argument("--seed", type=int, default=0)
    bench.add_argument("--min-weight", type=int, default=5)
    return p


def read_ids(path: str) -> list[int]:
    with open(path) as f:
        return sorted({int(x) for x in f.read().split()})


def main(argv: list[str] | None = None) -> int:
    a = parser().parse_args(argv)
    if a.command == "data" and a.action == "list":
        print("\n".join(f"{k}  {v}" for k, v in DATASETS.items()))
        return 0
    from .operators import compare, experiments
    from .operators.graph import build_graph
    from .report.html import render_tables
    from .sources.store import Store

    spark = _session()
    if a.command == "data" and a.action == "pull":
        from .sources.registry import Registry, pull, store_converter

        try:
            where = pull(Registry.load(a.registry).get(a.ref), a.cache, store_converter(spark), level=a.level, force=a.force)
        except (KeyError, ValueError) as e:
            print(e)
            return 1
        print(where)
    elif a.command == "bench":
        from .operators import benchmark

        graph = lambda root: build_graph(Store(spark, root).neurons(), Store(spark, root).edges(), min_weight=a.min_weight)
        atlas, records = compare.build_atlas(graph(a.atlas)), None
        for q in a.query:
            rows = benchmark.run_benchmark(graph(q), atlas, query_ref=q, truth_column=a.truth_column, max_types=a.max_types, seed=a.seed)
            records = rows if records is None else records.unionByName(rows)
        calibration = benchmark.fit_calibration(records, atlas, reference=a.atlas, n_folds=a.folds, seed=a.seed)
        benchmark.write_benchmark(records, calibration, a.out)
        print(json.dumps(calibration.metrics, indent=2))
    elif a.command == "data":
        print(json.dumps(Store(spark, a.root).provenance, indent=2))
    elif a.command == "run":
        spec, store = experiments.load_spec(a.spec), Store(spark, a.store)
        if spec.robustness is not None:
            found = experiments.run_robust_screen(spec, store.neurons(), store.edges(), a.out, auto_w_syn=a.w_syn)
        else:
            found = (experiments.run_sweep if spec.sweep else experiments.run_experiment)(spec, store.neurons(), store.edges(), a.out)
        print(render_tables(spec.describe(), {k: v for k, v in found.items() if k not in ("counts", "readout_rates")}))
    else:
        q, r = Store(spark, a.query), Store(spark, a.atlas)
        graph = lambda s: build_graph(s.neurons(), s.edges(), min_weight=a.min_weight)
        out = compare.classify(graph(q), compare.build_atlas(graph(r)), cell_type=a.cell_type, ids=read_ids(a.ids) if a.ids else None)
        out.show(50, truncate=False)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
