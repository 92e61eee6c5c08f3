"""Command line: ``python -m netloom <command> ...``. Exit codes: 0 good, 2 an integrity failure, 3 not releasable."""

from __future__ import annotations

import argparse
import json
import math
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netloom.functions import features as ft
from netloom.functions.parse import epoch
from netloom.operators import contracts, duplicates, effects, joins, realism, shortcuts, splits
from netloom.plans import campaign, evidence, labeling
from netloom.sources import logs, tables

GOOD, BROKEN, NOT_RELEASABLE = evidence.EXIT["ok"], evidence.EXIT["integrity"], evidence.EXIT["release"]


def share(text: str) -> float:
    """A number from 0 to 1; NaN and infinities are refused."""
    x = float(text)
    if not math.isfinite(x) or not 0 <= x <= 1:
        raise argparse.ArgumentTypeError(f"{text} is no share")
    return x


def rows_of(d: DataFrame) -> list[dict]:
    return [r.asDict(recursive=True) for r in d.collect()]


def label(spark: SparkSession, a: argparse.Namespace) -> tuple[dict, int]:
    """Label a run: join its logs, resolve windows, check gates and publish the three tables."""
    notes = tables.read_annotations(spark, a.annotations)
    contracts.require(notes, tables.annotation_rules(notes.columns))
    bad = [f"{r.rule} ({r.violations})" for r in tables.annotation_file_rules(notes).filter("violations > 0").collect()]
    if bad:
        return {"problems": bad}, BROKEN
    windows = tables.attack_windows(notes, a.use_failed, a.padding_ms)
    conn, ssl, quic = (logs.read_zeek(spark, f"{a.logs}/{n}.log") for n in ("conn", "ssl", "quic"))
    meter = logs.read_zeek(spark, f"{a.logs}/flowmeter.log")
    labelled = labeling.label_run(conn, ssl, quic, meter if len(meter.columns) > 2 else None, windows, a.min_overlap)
    made = labeling.projections(labelled, a.run_id, a.ambiguous == "keep")
    counts = {r["label"]: r["count"] for r in made["ml"].groupBy("label").count().collect()}
    tables.publish(made, a.out, {"run_id": a.run_id, "status": "success", "class_counts": counts, "min_window_overlap": a.min_overlap}, "csv")
    return {"class_counts": counts}, GOOD


def merge(spark: SparkSession, a: argparse.Namespace) -> tuple[dict, int]:
    """Merge runs into the campaign's splits."""
    with open(a.campaign, encoding="utf-8") as f:
        manifest = campaign.load_manifest(f.read(), reproducible=not a.diagnostic)
    plan = {int(k): r["split"] for k, r in manifest["runs"].items()}
    rate = manifest.get("max_cross_split_duplicate_rate", 0.0)
    try:
        built = campaign.build(tables.load_runs(spark, a.runs), plan, max_duplicate_rate=min(rate, a.max_duplicate_rate if a.max_duplicate_rate is not None else rate), diagnostic=a.diagnostic)
    except campaign.ManifestError as e:
        return {"reasons": str(e).split("; ")}, BROKEN
    frames = {s: built.rows.filter(F.col("split") == s).drop("split") for s in campaign.SPLITS}
    tables.publish(frames, a.out, {"official": built.official, "reasons": built.reasons, "duplicates": built.duplicates, "splits": rows_of(built.manifest)}, "csv")
    return {"official": built.official, "reasons": built.reasons}, GOOD if built.official or a.diagnostic else BROKEN


def audit(spark: SparkSession, a: argparse.Namespace) -> tuple[dict, int]:
    """Look for columns, and a shallow tree, that tell the label by themselves."""
    d, numeric, text = tables.read_cells(spark, a.file, a.label, a.binary)
    d = d.withColumnRenamed(a.label, "label")
    best = rows_of(shortcuts.top(shortcuts.numeric(d, numeric, "label").select("feature", "balanced_accuracy").unionByName(shortcuts.categorical(d, text, "label").select("feature", "balanced_accuracy")), "balanced_accuracy", "feature", a.top, 0.9))
    nodes = shortcuts.tree(d, [*text, *numeric], "label")
    leaves = [n for n in nodes if "split" not in n]
    support: dict[str, int] = {}
    hits: dict[str, int] = {}
    for n in leaves:
        for k, c in n["counts"].items():
            support[k] = support.get(k, 0) + c
            hits[k] = hits.get(k, 0) + (c if k == n["label"] else 0)
    told = sum(hits[k] / support[k] for k in support) / len(support) if support else 0.0
    verdict = campaign.shortcut_verdict(max((b["balanced_accuracy"] for b in best), default=0.0), told)
    return {"constants": rows_of(shortcuts.constants(d, [*numeric, *text])), "columns": best, "tree": told, "verdict": verdict}, GOOD if verdict == "clean" else NOT_RELEASABLE


def validate(spark: SparkSession, a: argparse.Namespace) -> tuple[dict, int]:
    """Hold a split-ready file against the contract, and count duplicates and label conflicts."""
    d = tables.read_split_ready(spark, a.file)
    broken = rows_of(contracts.dataset_contract(d, "timestamp" in d.columns).filter("violations > 0"))
    found = duplicates.statistics(d, [c for c in ft.EXTENDED if c in d.columns], "run_id" if "run_id" in d.columns else None, None, "label").first().asDict()
    errors = [b for b in broken if b["severity"] == "error"]
    return {"broken": broken, "duplicates": found}, BROKEN if errors or found["conflicting_label_groups"] else GOOD


def evaluate(spark: SparkSession, a: argparse.Namespace) -> tuple[dict, int]:
    """Compare a synthetic file with a real one."""
    real, synthetic = (tables.read_split_ready(spark, f) for f in (a.real, a.synthetic))
    shared = duplicates.row_overlap(real, synthetic, ft.COMMON).first().asDict()
    if shared["share"] > a.max_overlap:
        return {"overlap": shared}, BROKEN
    means = realism.mean_distances(realism.compare(real, synthetic, ft.NUMERIC, ft.CATEGORICAL)).first().asDict()
    worst = realism.worst_class(real, synthetic, ft.NUMERIC, ft.CATEGORICAL).first().asDict()
    split, how = splits.real_split(real)
    moved = realism.transfer(split, synthetic, ft.NUMERIC, ft.CATEGORICAL, balance=a.balance)
    limits = {"max_mean_js": 0.25, "max_cat_js": 0.25, "max_cond_js": 0.3, "max_missing_rate_difference": 0.15, "min_tstr_reference_ratio": 0.8, "min_reference_f1": 0.5}
    axes = campaign.realism({**means, "cond_js": max(worst["worst_js"], worst["worst_cat_js"]), "missing_gap": realism.missing_gap(real, synthetic, ft.COMMON), "tstr_ratio": moved["ratio"], "reference_f1": moved["reference"]}, limits)
    return {"overlap": shared, **means, **worst, "split": how, "transfer": moved, "axes": axes}, GOOD if axes["overall"] != "poor" else NOT_RELEASABLE


def correlate(spark: SparkSession, a: argparse.Namespace) -> tuple[dict, int]:
    """The layered ground truth of a run: flows and requests for each event."""
    notes = tables.read_annotations(spark, a.annotations).filter("status = 'success'")
    path = F.when(F.col("label") == "BruteForce", a.login_path).otherwise(a.dos_path)
    events = notes.select("event_id", "label", F.trim("attacker_ip").alias("attacker"), F.trim("target_hostname").alias("target"), epoch("start_utc").alias("start"), epoch("end_utc").alias("end"), path.alias("path"))
    with open(a.status, encoding="utf-8") as f:
        seen = json.load(f).get("events", {})
    known = spark.createDataFrame([(k, e.get("usable_flows"), e.get("port_coverage"), e.get("port_range_width")) for k, e in seen.items()], "event_id string, usable_flows long, port_coverage double, span long")
    return {"events": rows_of(effects.ground_truth(events, known, logs.read_access_log(spark.read.text(a.access_log))))}, GOOD


def monitor(spark: SparkSession, a: argparse.Namespace) -> tuple[dict, int]:
    """Availability, latency and errors inside and outside attack windows."""
    found = effects.effects(logs.read_monitor(spark, a.monitor), logs.effect_windows(tables.read_annotations(spark, a.annotations)))
    out = rows_of(found)
    return {"urls": out, "effect_confirmed": any(r["effect_confirmed"] for r in out)}, GOOD


def hashes(spark: SparkSession, a: argparse.Namespace) -> tuple[dict, int]:
    """Hold the files under a folder against a manifest of digests."""
    wanted = tables.parse_manifest(spark.read.text(a.manifest))
    bad = rows_of(joins.manifest_diff(wanted, tables.inventory(spark, a.folder).select("path", "sha256"), extras=False).orderBy("path"))
    return {"problems": bad}, BROKEN if bad else GOOD


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="netloom", description=__doc__)
    sub = p.add_subparsers(required=True)

    def command(run, **options) -> None:
        c = sub.add_parser(run.__name__, help=run.__doc__)
        c.set_defaults(run=run)
        for name, given in options.items():
            c.add_argument(f"--{name.replace('_', '-')}", **given)

    need = {"required": True}
    command(label, logs=need, annotations=need, out=need, run_id={"type": int, **need}, min_overlap={"type": share}, padding_ms={"type": float, "default": 0.0}, use_failed={"action": "store_true"}, ambiguous={"choices": ["drop", "keep"], "default": "drop"})
    command(merge, campaign=need, runs={"nargs": "+", **need}, out=need, max_duplicate_rate={"type": share}, diagnostic={"action": "store_true"})
    command(audit, file=need, label={"default": "label"}, binary={"action": "store_true"}, top={"type": int, "default": 15})
    command(validate, file=need)
    command(evaluate, real=need, synthetic=need, max_overlap={"type": share, "default": 0.0}, balance={"action": "store_true"})
    command(correlate, annotations=need, status=need, access_log=need, login_path={"default": "/wp-login.php"}, dos_path={"default": "/"})
    command(monitor, monitor=need, annotations=need)
    command(hashes, folder=need, manifest=need)
    return p


def main(arguments: list[str] | None = None) -> int:
    a = parser().parse_args(arguments)
    spark = SparkSession.builder.config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false").getOrCreate()
    try:
        found, code = a.run(spark, a)
    except (ValueError, FileExistsError) as e:
        found, code = {"problems": [str(e)]}, BROKEN
    print(json.dumps(found, sort_keys=True, default=str))
    return code


if __name__ == "__main__":
    sys.exit(main())
