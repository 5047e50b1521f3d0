"""Reports as files: canonical JSON, CSV of a fixed header, JSON lines, Markdown, SVG, manifests and metadata.

Reports are small and written by the driver, each file whole or not at all; large tables go through Spark's writers.
"""

from __future__ import annotations

import csv
import hashlib
import io
import json
import os
import platform
import tempfile
import time
from collections.abc import Iterable, Mapping, Sequence
from html import escape
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def json_bytes(data) -> bytes:
    """Sorted keys, two spaces, no NaN, one line end: equal data give equal bytes."""
    return (json.dumps(data, indent=2, sort_keys=True, allow_nan=False, ensure_ascii=False) + "\n").encode()


def jsonl_bytes(rows: Iterable[Mapping]) -> bytes:
    return "".join(json.dumps(r, separators=(",", ":"), allow_nan=False) + "\n" for r in rows).encode()


def csv_bytes(rows: Iterable[Mapping], fields: Sequence[str]) -> bytes:
    """The header as given; null is an empty cell; a field that is not in the header is an error."""
    out = io.StringIO(newline="")
    writer = csv.DictWriter(out, fields, lineterminator="\n", extrasaction="raise", restval="")
    writer.writeheader()
    writer.writerows({k: "" if v is None else v for k, v in r.items()} for r in rows)
    return out.getvalue().encode()


def atomic_write(path: str | Path, data: bytes) -> str:
    """Writes beside the target, syncs and renames; the mode is what the umask gives. Returns the SHA-256."""
    path = Path(path)
    path.parent.mkdir(parents=True, exist_ok=True)
    fd, tmp = tempfile.mkstemp(dir=path.parent, prefix=f".{path.name}.")
    try:
        with os.fdopen(fd, "wb") as f:
            f.write(data)
            f.flush()
            os.fsync(f.fileno())
        mask = os.umask(0)
        os.umask(mask)
        os.chmod(tmp, 0o666 & ~mask)
        os.replace(tmp, path)
    except BaseException:
        Path(tmp).unlink(missing_ok=True)
        raise
    return hashlib.sha256(data).hexdigest()


def file_sha256(path: str | Path) -> str:
    with open(path, "rb") as f:
        return hashlib.file_digest(f, "sha256").hexdigest()


def plain(rows: DataFrame, *order: str, places: int | None = 12) -> list[dict]:
    """A report's few rows as dictionaries, doubles rounded, in the order of some columns or all."""
    doubles = {c for c, t in rows.dtypes if t == "double"} if places is not None else set()
    shown = rows.select(*(F.round(c, places).alias(c) if c in doubles and c not in ("threshold", "cut") else F.col(c) for c in rows.columns))
    return [r.asDict(recursive=True) for r in shown.orderBy(*(order or rows.columns)).collect()]


def manifest_text(hashes: Mapping[str, str]) -> str:
    return "".join(f"{h}  {name}\n" for name, h in sorted(hashes.items()))


def dataset_manifest(found: DataFrame) -> str:
    """The manifest of (path, sha256) rows: arrays of train and test, and the label table."""
    keep = found.where("path rlike '(^|/)(train|test)/[^/]+[.]npy$' or path rlike '(^|/)labeled_anomalies[.]csv$'")
    return manifest_text({("labeled_anomalies.csv" if r["path"].endswith("labeled_anomalies.csv") else r["path"]): r["sha256"] for r in keep.collect()})


def metadata(argv: Sequence[str], seconds: float, spark=None) -> dict:
    """What a run says of itself; never part of what is hashed."""
    return {"argv": list(argv), "elapsed_seconds": seconds, "finished_at": time.strftime("%Y-%m-%dT%H:%M:%SZ", time.gmtime()), "platform": platform.platform(), "python": platform.python_version(), "spark": spark.version if spark is not None else None}


def write_set(folder: str | Path, files: Mapping[str, bytes], aside: Mapping[str, bytes] | None = None, sums: str = "SHA256SUMS") -> dict[str, str]:
    """Writes files and the manifest of their hashes; files ``aside`` (times, machines) are written but not hashed."""
    hashes = {name: atomic_write(Path(folder) / name, data) for name, data in files.items()}
    atomic_write(Path(folder) / sums, manifest_text(hashes).encode())
    for name, data in (aside or {}).items():
        atomic_write(Path(folder) / name, data)
    return hashes


def write_scorecard(folder: str | Path, name: str, head: dict, rows: list[dict], timing: list[dict], argv: Sequence[str] = (), seconds: float = 0.0, spark=None) -> dict[str, str]:
    """A comparison's or a stress suite's outputs: JSON, CSV, Markdown and hashes, and beside them times and metadata."""
    fields = list(rows[0]) if rows else []
    files = {f"{name}.json": json_bytes(head | {"rows": rows}), f"{name}.csv": csv_bytes(rows, fields), f"{name}.md": scorecard_markdown(name, rows).encode()}
    return write_set(folder, files, {f"{name}_timing.json": json_bytes(timing), f"{name}_metadata.json": json_bytes(metadata(argv, seconds, spark))}, f"{name}.sha256")


def write_results(folder: str | Path, prefix: str, results: dict, summary: list[dict], comparisons: list[dict], channels: list[dict], target: float) -> dict[str, str]:
    """A series evaluation's outputs: JSON, three CSVs, a bar chart and hashes."""
    table = lambda rows: csv_bytes(rows, list(rows[0]) if rows else [])
    files = {f"{prefix}_results.json": json_bytes(results), f"{prefix}_summary.csv": table(summary), f"{prefix}_comparisons.csv": table(comparisons), f"{prefix}_channels.csv": table(channels), f"{prefix}_f1.svg": bar_chart(summary, target).encode()}
    return write_set(folder, files)


def write_table(rows: DataFrame, path: str, by: Sequence[str] = (), kind: str = "parquet") -> None:
    """A table of any size, by Spark's committed writers; JSON lines or CSV if asked, in folders by some columns."""
    out = rows.write.mode("overwrite").partitionBy(*by) if by else rows.write.mode("overwrite")
    if kind == "jsonl":
        rows.select(F.to_json(F.struct(*rows.columns), {"ignoreNullFields": "false"}).alias("value")).write.mode("overwrite").text(path, lineSep="\n")
    elif kind == "csv":
        out.csv(path, header=True, nullValue="", emptyValue="")
    else:
        out.parquet(path)


def shown(value, places: int = 4) -> str:
    return "" if value is None else f"{value:.{places}g}" if isinstance(value, float) else str(value)


def markdown_table(rows: Sequence[Mapping], fields: Sequence[str] | None = None) -> str:
    fields = list(fields or (rows[0] if rows else []))
    line = lambda cells: "| " + " | ".join(cells) + " |\n"
    return line(fields) + line(["-"] * len(fields)) + "".join(line([shown(r.get(f)).replace("|", "\\|") for f in fields]) for r in rows)


def text_table(rows: Sequence[Mapping], fields: Sequence[str] | None = None) -> str:
    """Columns of equal width, for a terminal."""
    fields = list(fields or (rows[0] if rows else []))
    cells = [fields, *([shown(r.get(f)) for f in fields] for r in rows)]
    wide = [max(len(c[i]) for c in cells) for i in range(len(fields))]
    return "".join("  ".join(x.ljust(w) for x, w in zip(c, wide)).rstrip() + "\n" for c in cells)


def scorecard_markdown(name: str, rows: Sequence[Mapping]) -> str:
    """A table for each track, columns that are empty throughout left out."""
    out = [f"# {name}\n"]
    for track in dict.fromkeys(r.get("track") for r in rows):
        own = [r for r in rows if r.get("track") == track]
        fields = [f for f in own[0] if f != "track" and any(r.get(f) is not None for r in own)]
        out.append(f"\n## {track}\n\n" + markdown_table(own, fields))
    return "".join(out)


def bar_chart(summary: Sequence[Mapping], target: float, subset: str = "all_channels", wide: int = 640, high: int = 320) -> str:
    """Event F1 with its interval by dataset and method, as SVG; equal rows give equal text."""
    rows = [r for r in summary if r["subset"] == subset and r["target_fp"] == target]
    if not rows:
        return f'<svg xmlns="http://www.w3.org/2000/svg" width="{wide}" height="{high}"/>\n'
    left, top, foot = 40, 24, 60
    step, tall = (wide - left - 10) / len(rows), high - top - foot
    y = lambda v: round(top + tall * (1 - v), 2)
    methods = list(dict.fromkeys(r["method"] for r in rows))
    parts = [f'<svg xmlns="http://www.w3.org/2000/svg" width="{wide}" height="{high}" font-family="sans-serif" font-size="10">', f'<text x="{left}" y="14">Event F1 at a false-positive target of {escape(str(target))}</text>']
    parts += [f'<line x1="{left}" x2="{wide - 10}" y1="{y(v)}" y2="{y(v)}" stroke="#ddd"/><text x="{left - 4}" y="{y(v) + 3}" text-anchor="end">{v}</text>' for v in (0, 0.25, 0.5, 0.75, 1)]
    for i, r in enumerate(rows):
        x, f1 = round(left + i * step + step * 0.15, 2), r["event_f1"]
        mid = round(x + step * 0.35, 2)
        shade = 35 + 45 * methods.index(r["method"]) // max(1, len(methods) - 1)
        parts.append(f'<rect x="{x}" y="{y(f1)}" width="{round(step * 0.7, 2)}" height="{round(tall * f1, 2)}" fill="hsl(210,50%,{shade}%)"/>')
        parts.append(f'<line x1="{mid}" x2="{mid}" y1="{y(r["event_f1_ci_low"])}" y2="{y(r["event_f1_ci_high"])}" stroke="#000"/>')
        parts.append(f'<text transform="translate({mid},{high - foot + 8}) rotate(45)">{escape(r["dataset"])} {escape(r["method"])}</text>')
    return "\n".join([*parts, "</svg>\n"])


def write_replay_inputs(folder: str | Path) -> dict[str, Path]:
    """The example replay and its calibration recording as JSON lines."""
    from ..sources.scenarios import replay_calibration, replay_example

    paths = {"replay": Path(folder) / "synthetic_replay.jsonl", "calibration": Path(folder) / "synthetic_calibration.jsonl"}
    atomic_write(paths["replay"], jsonl_bytes(replay_example()))
    atomic_write(paths["calibration"], jsonl_bytes(replay_calibration()))
    return paths
