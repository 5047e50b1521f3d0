"""Locked inputs of evaluations: protocols, preregistrations, search spaces; and fetching of a dataset."""

from __future__ import annotations

import hashlib
import json
import os
import re
import urllib.request
import zipfile
from collections.abc import Mapping, Sequence
from pathlib import Path

from ..operators import detectors
from ..settings import Evaluation, Frames, finite, threshold, whole
from .files import strict_json


class Refused(ValueError):
    """An input is not what its format or its lock asks for."""


def read_utf8(path: str | Path, what: str = "file") -> tuple[bytes, str]:
    """The exact bytes, for hashing, and the text."""
    try:
        raw = Path(path).read_bytes()
        return raw, raw.decode("utf-8")
    except (OSError, UnicodeDecodeError) as e:
        raise Refused(f"{what} {path} cannot be read: {e}") from e


def keys(obj, required: set[str], where: str, optional: set[str] = frozenset()) -> dict:
    if not isinstance(obj, dict):
        raise Refused(f"{where} is not an object")
    for odd, says in ((required - obj.keys(), "lacks"), (obj.keys() - required - set(optional), "does not know")):
        if odd:
            raise Refused(f"{where} {says} {', '.join(sorted(odd))}")
    return obj


def checked(f, *given):
    try:
        return f(*given)
    except (TypeError, ValueError) as e:
        raise Refused(str(e)) from e


#: Rules that a preregistration must state, and the names of the two thresholds of its first version.
RULES = {"event_hit_rule": "any_alert_frame_during_event", "localization_rule": "framewise_micro_precision_recall_iou", "latency_rule": "first_alert_frame_minus_first_event_frame_ms"}
FIRST = {"candidate_threshold": "blend", "baseline_max_abs_threshold": "peak"}
WARMUP = 16


def preregistration(path: str | Path, aliases: Mapping[str, str] | None = None) -> tuple[dict, str]:
    """A preregistration, normalised, and the SHA-256 of its bytes. ``aliases`` maps its names of detectors to those known here."""
    raw, text = read_utf8(path, "preregistration")
    p, known = checked(strict_json, text), aliases or {}
    common = {"schema_version", "protocol_id", "locked_at", "score_spec", *RULES}
    version = p.get("schema_version") if isinstance(p, dict) else None
    if type(version) is not int or version not in (1, 2):
        raise Refused("schema_version is neither 1 nor 2")
    if version == 1:
        keys(p, common | set(FIRST), "preregistration")
        policy = {"mode": "fixed", "thresholds": {name: checked(threshold, p[key]) for key, name in FIRST.items()}}
        names, warmup = list(FIRST.values()), WARMUP
    else:
        keys(p, common | {"detectors", "threshold_policy"}, "preregistration", {"warmup"})
        given = p["detectors"]
        if not isinstance(given, list) or not given or not all(isinstance(n, str) for n in given) or len(set(given)) != len(given):
            raise Refused("detectors must be a list of names, each once")
        names, warmup = [known.get(n, n) for n in given], checked(whole, "warmup", p.get("warmup", WARMUP), 2)
        policy = _policy(p["threshold_policy"], given, known)
    for key in ("protocol_id", "locked_at"):
        if not isinstance(p[key], str) or not p[key].strip():
            raise Refused(f"{key} is empty")
    if not re.search(r"(Z|[+-]\d\d:\d\d)$", p["locked_at"]):
        raise Refused("locked_at has no offset")
    spec = keys(p["score_spec"], {"channel_count", "block_size", "weights", "comparison"}, "score_spec")
    f = Frames()
    if (spec["channel_count"], spec["block_size"], spec["comparison"]) != (f.channels, f.size, ">=") or keys(spec["weights"], {"peak_abs", "rms", "mean_abs"}, "weights") != dict(zip(("peak_abs", "rms", "mean_abs"), f.weights)):
        raise Refused("score_spec is not the documented score")
    if wrong := [k for k, v in RULES.items() if p[k] != v]:
        raise Refused(f"{wrong[0]} is not {RULES[wrong[0]]!r}")
    if odd := sorted(set(names) - set(detectors.available())):
        raise Refused(f"no detectors {odd}; there are {', '.join(detectors.available())}")
    return {"schema_version": version, "protocol_id": p["protocol_id"], "locked_at": p["locked_at"], "detectors": names, "warmup": warmup, "threshold_policy": policy}, hashlib.sha256(raw).hexdigest()


def _policy(policy, names: list[str], known: Mapping[str, str]) -> dict:
    mode = policy.get("mode") if isinstance(policy, dict) else None
    if mode == "fixed":
        given = keys(keys(policy, {"mode", "thresholds"}, "threshold_policy")["thresholds"], set(names), "thresholds")
        return {"mode": "fixed", "thresholds": {known.get(n, n): checked(threshold, given[n]) for n in names}}
    if mode != "calibrated":
        raise Refused("the policy is neither calibrated nor fixed")
    keys(policy, {"mode", "target_fp", "unit", "calibration_sha256"}, "threshold_policy")
    if policy["unit"] != "frame" or not isinstance(policy["calibration_sha256"], str) or not re.fullmatch(r"[0-9a-f]{64}", policy["calibration_sha256"]):
        raise Refused("a calibrated policy needs frames as unit and the calibration's SHA-256")
    return {"mode": "calibrated", "target_fp": checked(finite, "target_fp", policy["target_fp"], 0.0, 1.0), "unit": "frame", "calibration_sha256": policy["calibration_sha256"]}


def locked(path: str | Path, expected: str | None = None, aliases: Mapping[str, str] | None = None) -> tuple[Evaluation, dict, str]:
    """A series evaluation's protocol: its settings, the object as it is, and the SHA-256 of its bytes, which must be the one expected if any is."""
    raw, text = read_utf8(path, "protocol")
    sha = hashlib.sha256(raw).hexdigest()
    if expected is not None and sha != expected:
        raise Refused(f"the protocol is not the locked one: {sha}")
    p, known = checked(json.loads, text), aliases or {}
    if not isinstance(p, dict) or not isinstance(p.get("methods"), dict) or not isinstance(p.get("calibration"), dict) or not isinstance(p.get("uncertainty"), dict):
        raise Refused("a protocol has methods, calibration and uncertainty")
    c, u = p["calibration"], p["uncertainty"]
    methods = tuple(known.get(m, m) for m in p["methods"])
    given = {known.get(m, m): v if isinstance(v, dict) else {} for m, v in p["methods"].items()}
    e = checked(lambda: Evaluation(methods=methods, candidate=known.get(p.get("candidate"), p.get("candidate")), targets=(c.get("primary_target_fp"), *c.get("secondary_target_fp", [])), resamples=u.get("bootstrap_resamples"), seed=u.get("seed"), level=u.get("ci_level", 0.95), significance=p.get("success_criteria", {}).get("significance_level", 0.05), window=given.get("blend", {}).get("window", 32), lam=given.get("ewma", {}).get("lam", 0.2), k=given.get("cusum", {}).get("k", 0.5)))
    return e, p, sha


def once(result: str | Path) -> None:
    """Refuses to go on where a run-once evaluation has a result already."""
    if Path(result).exists():
        raise Refused(f"{result} exists: this evaluation runs once")


def yaml_file(path: str | Path) -> dict:
    """A search space or configuration; needs a YAML reader to be installed unless the file is JSON."""
    _, text = read_utf8(path, "configuration")
    try:
        return json.loads(text)
    except ValueError:
        try:
            import yaml
        except ImportError as e:
            raise Refused("no YAML reader is installed") from e
        return checked(yaml.safe_load, text)


# Fetching.

_ARRAY = re.compile(r"(?:^|/)(train|test)/([A-Za-z0-9_\-]+)\.npy$")
_LABELS = re.compile(r"(?:^|/)labeled_anomalies\.csv$")


def download(url: str, target: str | Path, timeout: float = 120.0) -> str:
    """The URL's bytes in ``target``, which appears whole or not at all; returns their SHA-256."""
    part, digest = Path(f"{target}.part"), hashlib.sha256()
    with urllib.request.urlopen(url, timeout=timeout) as source, open(part, "wb") as out:  # noqa: S310
        while piece := source.read(1 << 20):
            digest.update(piece)
            out.write(piece)
    os.replace(part, target)
    return digest.hexdigest()


def extract(archive: str | Path, folder: str | Path) -> int:
    """Unpacks train and test arrays and the label table to fixed places in ``folder``, nothing else; how many files."""
    places = {}
    with zipfile.ZipFile(archive) as z:
        for name in z.namelist():
            if m := _ARRAY.search(name):
                places[name] = Path(folder) / m[1] / f"{m[2]}.npy"
            elif _LABELS.search(name):
                places[name] = Path(folder) / "labeled_anomalies.csv"
        for name, place in places.items():
            place.parent.mkdir(parents=True, exist_ok=True)
            place.write_bytes(z.read(name))
    if not places:
        raise Refused(f"{archive} holds no arrays or labels")
    return len(places)


def fetch(spark, folder: str | Path, manifest: str | Path, urls: Sequence[str] = (), archive: str | Path | None = None, keep: bool = True) -> dict:
    """A dataset from the first URL that answers, or a local archive, unpacked and verified file by file against the manifest."""
    from . import files

    folder = Path(folder)
    folder.mkdir(parents=True, exist_ok=True)
    failed, source, fetched = [], str(archive), archive is None
    for url in urls if fetched else ():
        try:
            download(url, folder / "download.zip")
        except OSError as e:
            failed.append(f"{url}: {e}")
        else:
            source, archive = url, folder / "download.zip"
            break
    if archive is None:
        raise Refused("no source answered: " + "; ".join(failed))
    from ..sinks.outputs import file_sha256

    sha, n = file_sha256(archive), extract(archive, folder)
    if fetched and not keep:
        Path(archive).unlink()
    return {"source": source, "archive_sha256": sha, "extracted": n, "errors": failed} | files.require_verified(files.read_manifest(spark, str(manifest)), files.hashes(spark, str(folder)))
