"""Command line: ``python -m tessera.cli COMMAND``."""

from __future__ import annotations

import argparse
import json
import sys
import time
import traceback
from pathlib import Path

import numpy as np

from tessera.functions.parameters import FieldKey, RunConfig
from tessera.operators import stages
from tessera.plans import exploratory, registry, seizure, workflows
from tessera.session import make_session, share_package
from tessera.sources import recordings
from tessera.sources.catalog import Catalog


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="tessera")
    top.add_argument("--master", default="local[*]")
    top.add_argument("--log", help="file to which a JSON line about the command is added")
    commands = top.add_subparsers(dest="command", required=True)
    commands.add_parser("list", help="names of the queries")
    run = commands.add_parser("run", help="run a query and write its result")
    run.add_argument("name")
    run.add_argument("--input", required=True)
    run.add_argument("--output", required=True)
    index = commands.add_parser("build-index", help="recordings, segments and cohort")
    index.add_argument("--root", required=True)
    index.add_argument("--annotations", required=True)
    index.add_argument("--channels", required=True, help="Parquet table patient_id, channels")
    states = commands.add_parser("field-states", help="state sequences of long signals")
    states.add_argument("--signals", required=True)
    coupling = commands.add_parser("state-coupling", help="coupling of two label tables, with group statistics")
    coupling.add_argument("--labels", required=True)
    coupling.add_argument("--field-labels", required=True)
    coupling.add_argument("--lags", type=int, nargs="+", default=[0])
    coupling.add_argument("--surrogates", type=int, default=128)
    stage = commands.add_parser("stage-analysis", help="summaries of labelled event stages")
    stage.add_argument("--labels", required=True)
    regions = commands.add_parser("region-signals", help="channel mapping and region signals")
    regions.add_argument("--signals", required=True)
    regions.add_argument("--atlas", required=True)
    explore = commands.add_parser("explore", help="exploratory analyses: one by name, or all whose tables are given")
    explore.add_argument("--analysis", default="all")
    explore.add_argument("--table", action="append", default=[], metavar="NAME=PATH", help="a Parquet table (see tessera.plans.exploratory)")
    label = commands.add_parser("label-recordings", help="power, labels by fixed templates, and topographies of long signals")
    label.add_argument("--signals", required=True)
    label.add_argument("--templates", required=True, help="Parquet table microstate, template")
    events = commands.add_parser("build-seizure-stage-index", help="stage segments, recordings and denominators")
    events.add_argument("--annotations", required=True)
    events.add_argument("--files", required=True, help="Parquet table patient_id, recording_state, has_*")
    seizures = commands.add_parser("run-seizure-stage-analysis", help="all tables of the event-stage workflow")
    seizures.add_argument("--annotations", required=True)
    seizures.add_argument("--inputs", required=True, help="folder of Parquet tables (see tessera.plans.seizure)")
    for p in (index, states, coupling, stage, regions, explore, label, events, seizures):
        p.add_argument("--cache", required=True)
        p.add_argument("--export", help="folder for CSV tables and the manifest")
        p.add_argument("--analysis-state", default="IDE_A")
        p.add_argument("--n-states", type=int, default=4)
        p.add_argument("--peak-metric", default="rms")
        p.add_argument("--normalization", default="zscore")
        p.add_argument("--min-subjects", type=int, default=7)
        p.add_argument("--seed", type=int, default=42)
    return top


def tables_of(spark, args: argparse.Namespace, config: RunConfig) -> dict:
    read = spark.read.parquet
    if args.command == "build-index":
        return workflows.build_index(spark, args.root, recordings.read_annotations(spark, args.annotations), read(args.channels), config)
    if args.command == "field-states":
        return workflows.field_states(recordings.read_signals(spark, args.signals), config)
    if args.command == "state-coupling":
        effects = workflows.state_coupling(read(args.labels), read(args.field_labels), config, lags=tuple(args.lags), surrogates=args.surrogates).cache()
        return {"effects": effects, "group": workflows.group_statistics(effects, ["lag_samples", "lag_ms"], config)}
    if args.command == "region-signals":
        return workflows.region_branch(recordings.read_signals(spark, args.signals), recordings.read_atlas(spark, args.atlas), config)
    if args.command == "explore":
        return exploratory.run(args.analysis, {name: read(path) for name, path in (t.split("=", 1) for t in args.table)}, config)
    if args.command == "label-recordings":
        return workflows.label_recordings(recordings.read_signals(spark, args.signals), template_matrix(read(args.templates)), config)
    if args.command == "build-seizure-stage-index":
        return seizure.build_stage_index(recordings.read_annotations(spark, args.annotations), read(args.files))
    if args.command == "run-seizure-stage-analysis":
        given = seizure.read_stage_inputs(spark, args.inputs)
        segments = stages.stage_segments(recordings.read_annotations(spark, args.annotations))
        return seizure.run_stage_analysis(segments, given["eeg"], given["seeg"], template_matrix(given["eeg_templates"]), given["field_templates"], given["assignments"], given["loadings"], config)
    return workflows.stage_analysis(read(args.labels))


def template_matrix(templates) -> np.ndarray:
    """A fitted model's templates, a few rows, in the order of their states."""
    return np.array([r["template"] for r in templates.orderBy("microstate").collect()], float)


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    if args.command == "list":
        print("\n".join(registry.queries()))
        return 0
    began, spark, error, key, outputs = time.time(), share_package(make_session(args.master)), None, None, []
    try:
        if args.command == "run":
            registry.queries()[args.name](spark, args.input).write.mode("overwrite").parquet(args.output)
            outputs.append(args.output)
        else:
            config = RunConfig(analysis_state=args.analysis_state, min_subjects=args.min_subjects, seed=args.seed, field=FieldKey(args.peak_metric, args.normalization, args.n_states))
            catalog, key = Catalog(spark, args.cache), config.key
            made = tables_of(spark, args, config)
            kept = {name: catalog.table(args.command, name, args.analysis_state, config.key, lambda df=df: df) for name, df in made.items()}
            outputs += [catalog.path(args.command, name, args.analysis_state, config.key) for name in made]
            if args.export:
                manifest = workflows.export_tables(catalog, kept, config, family=args.command, branch=args.analysis_state, out=args.export)
                recordings.write_report(manifest, f"{args.export}/manifest")
    except Exception as e:
        error = "".join(traceback.format_exception(e))
        raise
    finally:
        if args.log:
            line = {"command": args.command, "argv": argv or sys.argv[1:], "duration_sec": round(time.time() - began, 3), "status": "error" if error else "ok", "config": key, "outputs": outputs, "error": error}
            with Path(args.log).open("a") as log:
                log.write(json.dumps(line) + "\n")
    return 0


if __name__ == "__main__":
    sys.exit(main())
