"""Command line: ``python -m tidegauge run | sweep | compare | stress | replay | series | fetch | plugins | test``.

Exit codes: 0 done, 1 expectations not met, 2 wrong arguments, 3 inputs refused, 4 a second run differs from the first.
"""

from __future__ import annotations

import argparse
import hashlib
import subprocess
import sys
import time
from pathlib import Path

DONE, UNMET, USAGE, REFUSED, DIFFERS = range(5)


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="tidegauge", description="Telemetry anomaly analytics on Spark.")
    sub = p.add_subparsers(dest="command")

    def command(name: str, about: str, **options) -> argparse.ArgumentParser:
        c = sub.add_parser(name, help=about)
        c.add_argument("--out", type=Path, default=Path("reports"))
        c.add_argument("--master", default="local[*]")
        for key, default in options.items():
            kind = {bool: {"action": "store_true"}, list: {"nargs": "*"}}.get(type(default)) or {"type": type(default) if default is not None else str}
            c.add_argument(f"--{key.replace('_', '-')}", default=default, **kind)
        return c

    command("run", "score generated frames and check what is expected", trials=1000, seed=42, threshold=0.5)
    command("sweep", "summaries over a grid of thresholds", trials=1000, seed=42, first=0.2, last=0.9, step=0.05)
    for name in ("compare", "stress"):
        command(name, "calibrate detectors alike and compare them" if name == "compare" else "the same under stress", trials=1000, streams=1000, calibration_trials=1000, calibration_streams=1000, fit_trials=1000, fit_streams=200, target_fp=0.01, seed=42, detectors=[], tracks=[], verify=False, **({"scenarios": []} if name == "stress" else {}))
    command("replay", "judge detectors on a recording under a locked protocol", replay="", protocol="", calibration="", alias=[], verify=False)
    command("series", "judge methods on labelled series under a locked protocol", data="", protocol="", expected="", manifest="", diagnostics=False, alias=[], verify=False)
    command("examples", "write the example recordings")
    command("fetch", "fetch and verify a dataset", data="", manifest="", url=[], archive="", drop_archive=False)
    command("plugins", "detectors that installed packages offer")
    sub.add_parser("test", help="run the tests")
    return p


def session(master: str):
    from pyspark.sql import SparkSession

    spark = SparkSession.builder.master(master).appName("tidegauge").config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def aliases(given: list[str]) -> dict[str, str]:
    """``theirs=ours`` pairs: names of detectors in foreign protocols."""
    return dict(x.split("=", 1) for x in given)


def verified(make, again: bool) -> tuple[dict[str, bytes], int]:
    """The files, and whether a second run gives the same bytes if one is asked for."""
    first = make()
    if not again:
        return first, DONE
    sums = lambda files: {n: hashlib.sha256(b).hexdigest() for n, b in files.items()}
    return first, DONE if sums(make()) == sums(first) else DIFFERS


def main(argv: list[str] | None = None) -> int:
    argv = sys.argv[1:] if argv is None else argv
    p = parser()
    try:
        a = p.parse_args(argv or ["run"])
    except SystemExit as e:
        return USAGE if e.code else DONE
    if a.command == "test":
        return subprocess.run([sys.executable, "-m", "pytest", "-q", str(Path(__file__).resolve().parents[1] / "tests")]).returncode
    from .sinks import outputs

    began = time.perf_counter()
    if a.command == "examples":
        print("\n".join(map(str, outputs.write_replay_inputs(a.out).values())))
        return DONE
    if a.command == "plugins":
        from .operators import detectors

        detectors.load_plugins()
        print("\n".join(detectors.available()))
        return DONE
    try:
        files, code = handlers()[a.command](a, session(a.master))
    except (OSError, TypeError, ValueError, KeyError) as e:
        print(f"refused: {e}", file=sys.stderr)
        return REFUSED
    outputs.write_set(a.out, files, {f"{a.command}_metadata.json": outputs.json_bytes(outputs.metadata(argv, time.perf_counter() - began))}, f"{a.command}.sha256")
    print("\n".join(str(a.out / n) for n in files))
    return code


def handlers() -> dict:
    return {"run": _run, "sweep": _sweep, "compare": _scorecard, "stress": _scorecard, "replay": _replay, "series": _series, "fetch": _fetch}


def table(rows: list[dict]) -> bytes:
    from .sinks import outputs

    return outputs.csv_bytes(rows, list(rows[0]) if rows else [])


def _run(a, spark):
    from .operators import scorecard
    from .settings import Frames
    from .sinks import outputs

    f = Frames(threshold=a.threshold, seed=a.seed)
    units = scorecard.unit_eval(scorecard.benchmark(spark, a.trials, f), ["regime", "trial"], f)
    summaries = scorecard.summary(units, ["regime"], scorecard.expected_of(), f.blocks)
    rows, checks = outputs.plain(summaries, "regime"), outputs.plain(scorecard.checks(summaries, ["regime"]), "regime", "check")
    print(outputs.text_table(checks))
    return {"run_results.json": outputs.json_bytes({"summaries": rows, "checks": checks}), "run_summary.csv": table(rows)}, DONE if all(c["passed"] for c in checks) else UNMET


def _sweep(a, spark):
    from .operators import scorecard
    from .settings import Frames, grid
    from .sinks import outputs

    f = Frames(seed=a.seed)
    rows = outputs.plain(scorecard.swept(scorecard.benchmark(spark, a.trials, f), grid(a.first, a.last, a.step), ["trial"], f, scorecard.expected_of()), "threshold", "regime")
    return {"sweep_summary.csv": table(rows), "sweep.json": outputs.json_bytes({"rows": rows, "thresholds_passing": sorted({r["threshold"] for r in rows if r["all_passed"]})})}, DONE


def _scorecard(a, spark):
    from .operators import scorecard
    from .settings import Compare, Frames, Stress
    from .sinks import outputs

    given = {k: getattr(a, k) for k in ("trials", "streams", "calibration_trials", "calibration_streams", "fit_trials", "fit_streams", "target_fp")}
    c = Compare(frames=Frames(seed=a.seed), **given, **({"detectors": tuple(a.detectors)} if a.detectors else {}), **({"tracks": tuple(a.tracks)} if a.tracks else {}))

    def make():
        head, rows, timing = scorecard.compare(spark, c) if a.command == "compare" else scorecard.stress(spark, Stress(c, scenarios=tuple(a.scenarios)))
        got = outputs.plain(rows, "track", "detector", "regime" if a.command == "compare" else "scenario", "threshold")
        outputs.atomic_write(a.out / f"{a.command}_timing.json", outputs.json_bytes(timing))
        return {f"{a.command}.json": outputs.json_bytes(head | {"rows": got}), f"{a.command}.csv": table(got), f"{a.command}.md": outputs.scorecard_markdown(a.command, got).encode()}

    return verified(make, a.verify)


def _replay(a, spark):
    from .operators import replay
    from .sinks import outputs
    from .sources import files, protocols

    protocol, sha = protocols.preregistration(a.protocol, aliases(a.alias))

    def make():
        frames = files.sound_replay(spark, a.replay)
        clean = files.sound_replay(spark, a.calibration) if a.calibration else None
        head, rows = replay.report(frames, protocol, clean, outputs.file_sha256(a.calibration) if a.calibration else None)
        head |= {"protocol_sha256": sha, "replay_sha256": outputs.file_sha256(a.replay)}
        order = {r: i for i, r in enumerate(head["input"]["regimes_in_first_seen_order"])}
        got = sorted(outputs.plain(rows), key=lambda r: (list(head["detectors"]).index(r["detector"]), order[r["regime"]]))
        card = [{k: ";".join(r[k]) if k == "missed_event_ids" else r[k] for k in replay.FIELDS} for r in got]
        return {"replay_report.json": outputs.json_bytes(head | {"rows": got}), "replay_scorecard.csv": outputs.csv_bytes(card, replay.FIELDS)}

    return verified(make, a.verify)


def _series(a, spark):
    from pyspark.sql import functions as F

    from .operators import sequences, series
    from .sinks import outputs
    from .sources import files, protocols

    e, _, sha = protocols.locked(a.protocol, a.expected or None, aliases(a.alias))
    info = files.require_verified(files.read_manifest(spark, a.manifest), files.hashes(spark, a.data)) if a.manifest else {"verified": False}
    labels = files.read_labels(spark, f"{a.data}/labeled_anomalies.csv")
    events = sequences.merged_windows(labels, ["dataset", "channel"])
    rows = files.read_series(spark, a.data).join(F.broadcast(labels.select("dataset", "channel").distinct()), "channel")  # a row for each channel

    def make():
        if a.diagnostics:
            return {"series_diagnostics.csv": table(outputs.plain(series.diagnostics(rows, e)))}
        head, *tables = series.results(rows, events, e, {"protocol_sha256": sha, "data_manifest": info})
        summary, comparisons, channels = (outputs.plain(t, *(c for c in ("subset", "target_fp", "dataset", "channel", "method", "baseline") if c in t.columns), places=6) for t in tables)
        flat = [{k: v for k, v in r.items() if k != "recall_by_class"} for r in summary]
        return {"series_results.json": outputs.json_bytes(head | {"summary": summary, "comparisons": comparisons, "per_channel": channels}), "series_summary.csv": table(flat), "series_comparisons.csv": table(comparisons), "series_channels.csv": table(channels), "series_f1.svg": outputs.bar_chart(summary, e.targets[0]).encode()}

    return verified(make, a.verify)


def _fetch(a, spark):
    from .sinks import outputs
    from .sources import protocols

    return {"fetch.json": outputs.json_bytes(protocols.fetch(spark, a.data, a.manifest, a.url, a.archive or None, not a.drop_archive))}, DONE


if __name__ == "__main__":
    sys.exit(main())
