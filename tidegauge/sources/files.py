"""Files: strict JSON-lines replays, manifests of hashes, label tables and numpy series."""

from __future__ import annotations

import io
import json
import math
import re
from datetime import datetime

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

REQUIRED = {"timestamp", "channels", "regime", "event_label", "event_id"}
OPTIONAL = {"affected_blocks", "incumbent_flags", "incumbent_alarm"}
_FRAME = "line long, timestamp timestamp, channels array<double>, regime string, event_label string, event_id string, affected_blocks array<int>, incumbent_flags array<boolean>, incumbent_alarm boolean, violations array<string>"


def strict_json(text: str):
    """JSON without repeated keys, NaN or infinities."""

    def pairs(items):
        keys = [k for k, _ in items]
        if len(set(keys)) != len(keys):
            raise ValueError("a key is repeated")
        return dict(items)

    def constant(name):
        raise ValueError(f"{name} is no number")

    return json.loads(text, object_pairs_hook=pairs, parse_constant=constant)


def frame(text: str, channels: int, blocks: int) -> tuple:
    """A frame's fields and what is wrong with it."""
    try:
        o = strict_json(text)
    except (ValueError, RecursionError) as e:
        return (None,) * 8 + ([f"not JSON: {e}"],)
    if not isinstance(o, dict):
        return (None,) * 8 + (["not an object"],)
    wrong = [f"{k} is missing" for k in sorted(REQUIRED - o.keys())] + [f"{k} is unknown" for k in sorted(o.keys() - REQUIRED - OPTIONAL)]
    number = lambda x: isinstance(x, (int, float)) and not isinstance(x, bool) and math.isfinite(x)
    x = o.get("channels")
    if not (isinstance(x, list) and len(x) == channels and all(map(number, x))):
        wrong.append(f"channels are not {channels} finite numbers")
        x = None
    stamp = None
    try:
        stamp = datetime.fromisoformat(o.get("timestamp").replace("Z", "+00:00"))
        if stamp.tzinfo is None:
            raise ValueError
    except (AttributeError, TypeError, ValueError):
        wrong.append("timestamp has no offset or is none")
        stamp = None
    for k in ("regime", "event_label"):
        if not (isinstance(o.get(k), str) and o[k] and o[k] == o[k].strip()):
            wrong.append(f"{k} is empty or padded")
    event = o.get("event_id")
    if (event is None) != (o.get("event_label") == "none"):
        wrong.append("event_id and event_label disagree")
    hit = o.get("affected_blocks")
    if hit is not None and not (isinstance(hit, list) and all(type(b) is int and 0 <= b < blocks for b in hit) and len(set(hit)) == len(hit) and (event is not None or not hit)):
        wrong.append("affected_blocks are no blocks")
        hit = None
    flags = o.get("incumbent_flags")
    if flags is not None and not (isinstance(flags, list) and len(flags) == blocks and all(type(b) is bool for b in flags)):
        wrong.append(f"incumbent_flags are not {blocks} booleans")
        flags = None
    alarm = o.get("incumbent_alarm")
    if alarm is not None and type(alarm) is not bool:
        wrong.append("incumbent_alarm is no boolean")
        alarm = None
    text_or_none = lambda v: v if isinstance(v, str) else None
    return stamp, [float(v) for v in x] if x else None, text_or_none(o.get("regime")), text_or_none(o.get("event_label")), text_or_none(event), hit, flags, alarm, wrong


def numbered(rows: DataFrame, name: str) -> DataFrame:
    """``rows`` with their number in the order of partitions and of rows within, without bringing them into one partition."""
    part = rows.withColumn("_id", F.monotonically_increasing_id())
    sizes = part.groupBy(F.shiftright("_id", 33).alias("p")).count().orderBy("p").collect()  # a row for each partition
    first, n = {}, 0
    for r in sizes:
        first[r["p"]] = n
        n += r["count"]
    start = F.create_map(*(F.lit(x) for kv in first.items() for x in kv))[F.shiftright("_id", 33)] if first else F.lit(0)
    return part.withColumn(name, (start + F.col("_id").bitwiseAND((1 << 33) - 1)).cast("long")).drop("_id")


def read_replay(spark: SparkSession, path: str, channels: int = 512, blocks: int = 16) -> DataFrame:
    """Frames of a JSON-lines file, one per line (only a line feed ends a line), with a list of violations each."""

    def parse(batches):
        for pdf in batches:
            out = pd.DataFrame([frame(v.removesuffix("\r"), channels, blocks) for v in pdf["value"]], columns=[c.split()[0] for c in _FRAME.split(", ")][1:])
            yield out.assign(line=pdf["line"], timestamp=pd.to_datetime(out["timestamp"], utc=True).dt.tz_localize(None))

    lines = numbered(spark.read.text(path, lineSep="\n"), "line").select("line", "value")  # the parts of one file are read in order
    return lines.mapInPandas(parse, _FRAME)


def replay_faults(frames: DataFrame) -> DataFrame:
    """Rows (fault, n): stamps that do not increase, events that change or are parted, incumbents on some frames only.

    A frame meets the one before it by a join on its number, so no partition holds the whole recording.
    """
    one = frames.select("line", "timestamp", "event_id", "regime", "event_label", F.coalesce(F.col("incumbent_flags").isNotNull() | F.col("incumbent_alarm").isNotNull()).alias("given"))
    last = one.select((F.col("line") + 1).alias("line"), F.col("timestamp").alias("_ts"), F.col("event_id").alias("_event"))
    both = one.join(last, "line", "left").withColumn("_starts", F.col("event_id").isNotNull() & ~F.col("event_id").eqNullSafe(F.col("_event")))
    event = both.where("event_id is not null").groupBy("event_id").agg(F.count_if("_starts").alias("parts"), F.count_distinct("regime", "event_label").alias("kinds"))
    flat = both.agg(F.count_if(F.col("timestamp") <= F.col("_ts")).alias("order"), F.when((F.count_if("given") > 0) & (F.count_if("given") < F.count("*")), 1).otherwise(0).cast("long").alias("incumbent"))
    of = event.agg(F.count_if(F.col("parts") > 1).alias("parted"), F.count_if(F.col("kinds") > 1).alias("changed"))
    stack = lambda row, names: row.select(F.explode(F.array(*(F.struct(F.lit(n).alias("fault"), F.col(n).alias("n")) for n in names))).alias("f")).select("f.*")
    return stack(flat, ("order", "incumbent")).unionByName(stack(of, ("parted", "changed")))


def sound_replay(spark: SparkSession, path: str, channels: int = 512, blocks: int = 16) -> DataFrame:
    """The frames of a replay; an error if a line violates the format, the file is empty, or frames do not fit together."""
    frames = read_replay(spark, path, channels, blocks)
    bad = frames.where("size(violations) > 0").orderBy("line").select("line", "violations").head(1)
    if bad:
        raise ValueError(f"{path}, line {bad[0]['line'] + 1}: {'; '.join(bad[0]['violations'])}")
    if not frames.head(1):
        raise ValueError(f"{path} has no frames")
    if faults := [f"{r['fault']} ({r['n']})" for r in replay_faults(frames).where("n > 0").collect()]:
        raise ValueError(f"{path}: {', '.join(sorted(faults))}")
    return frames.drop("violations")


def hashes(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """Rows (path, sha256) of the files under ``folder``, paths from there."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(folder)
    root = folder.split("://")[-1].rstrip("/") + "/"
    at = F.instr("path", root)
    own = F.when(at > 0, F.expr(f"substring(path, instr(path, {json.dumps(root)}) + {len(root)})")).otherwise(F.substring_index("path", "/", -2))
    return files.select(own.alias("path"), F.sha2("content", 256).alias("sha256"))


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """Rows (path, sha256) of lines ``sha256  path``; comments start with #, absolute or parent paths are refused."""
    line = spark.read.text(path).where("trim(value) != '' and not startswith(value, '#')")
    out = line.select(F.regexp_extract("value", r"^[0-9a-f]{64}  (\S.*)$", 1).alias("path"), F.regexp_extract("value", r"^([0-9a-f]{64})  \S", 1).alias("sha256"))
    good = (F.col("path") != "") & ~F.col("path").rlike(r"(^/|(^|/)\.\.(/|$))")
    return out.select(F.when(good, F.col("path")).otherwise(F.raise_error(F.lit("not a manifest line"))).alias("path"), "sha256")


def verified(manifest: DataFrame, found: DataFrame) -> DataFrame:
    """One row: files that are missing, and files that differ."""
    both = manifest.join(found.withColumnRenamed("sha256", "own"), "path", "left")
    return both.agg(F.count_if(F.col("own").isNull()).alias("missing"), F.count_if(F.col("own") != F.col("sha256")).alias("different"))


def require_verified(manifest: DataFrame, found: DataFrame) -> dict:
    """How many files the manifest names; an error if it names none, or one is missing or another."""
    n, r = manifest.count(), verified(manifest, found).first()
    if not n or r["missing"] or r["different"]:
        raise ValueError(f"of {n} files {r['missing']} are missing and {r['different']} differ")
    return {"files": n}


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    """Rows (channel, dataset, start, end, class) of a label table whose windows and classes are lists in text."""
    rows = spark.read.csv(path, header=True, quote='"', escape='"')
    names = F.split(F.regexp_replace(F.trim("class"), r"^\[|\]$", ""), r",\s*")
    both = rows.withColumn("w", F.from_json("anomaly_sequences", "array<array<bigint>>")).withColumn("c", names)
    ok = (F.size("w") == F.size("c")) & F.forall("c", lambda x: x.rlike("^[a-z]+$")) & F.forall("w", lambda x: (F.size(x) == 2) & (x[0] >= 0) & (x[0] <= x[1]) & (x[1] < F.col("num_values").cast("long")))
    both = both.withColumn("z", F.when(F.coalesce(ok, F.lit(False)), F.arrays_zip("w", "c")).otherwise(F.raise_error(F.concat(F.lit("bad labels of "), "chan_id"))))
    return both.select(F.col("chan_id").alias("channel"), F.col("spacecraft").alias("dataset"), F.explode("z").alias("z")).select("channel", "dataset", F.col("z.w")[0].alias("start"), F.col("z.w")[1].alias("end"), F.col("z.c").alias("class"))


def read_series(spark: SparkSession, folder: str) -> DataFrame:
    """Rows (channel, split, t, x): the first column of the arrays in ``folder``/train and ``folder``/test."""

    def load(batches):
        import numpy as np

        for pdf in batches:
            for path, content in zip(pdf["path"], pdf["content"]):
                a = np.load(io.BytesIO(content), allow_pickle=False)
                if a.ndim != 2 or len(a) < 2 or not np.isfinite(a[:, 0]).all():
                    raise ValueError(f"{path}: not a finite array of two dimensions with two rows or more")
                split, name = re.search(r"/(train|test)/([^/]+)\.npy$", path).groups()
                yield pd.DataFrame({"channel": name, "split": split, "t": np.arange(len(a)), "x": a[:, 0].astype(float)})

    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.npy").load(folder)
    return files.select("path", "content").mapInPandas(load, "channel string, split string, t long, x double")


def require_lengths(series: DataFrame, labels: DataFrame) -> DataFrame:
    """``series``, which fails when read if a labelled channel's test part has another length than its label says (channel, num_values)."""
    n = series.where("split = 'test'").groupBy("channel").agg(F.count("*").alias("_n")).join(labels.select("channel", "num_values").distinct(), "channel", "left")
    ok = n.select("channel", F.when(F.col("num_values").isNull() | (F.col("num_values") == F.col("_n")), F.lit(True)).otherwise(F.raise_error(F.concat(F.lit("a label says another length of "), "channel"))).alias("_ok"))
    return series.join(F.broadcast(ok), "channel").where("_ok").drop("_ok")  # a row for each channel


def series_manifest(series: DataFrame, events: DataFrame) -> DataFrame:
    """Rows (channel, train, test, fit_end, val_start, has_validation, events): sizes, the chronological split of the training part, labelled windows."""
    from ..operators.search import split_points

    n = series.groupBy("channel").agg(F.count_if(F.col("split") == "train").alias("train"), F.count_if(F.col("split") == "test").alias("test"))
    w = events.groupBy("channel").agg(F.array_sort(F.collect_list(F.array("start", "end"))).alias("events"))
    fit_end, val_start, ok = split_points(F.col("train"))
    return n.join(w, "channel", "left").select("channel", "train", "test", fit_end.alias("fit_end"), val_start.alias("val_start"), ok.alias("has_validation"), F.coalesce("events", F.array()).alias("events"))
