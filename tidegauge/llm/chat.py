"""Chat formatting in budgeted windows, with a mask of what to learn.

Turns are rendered between control strings, which texts can't hold: they are escaped, reversibly.
Prefix sums of the turns' tokens choose the longest run of whole turns that fits a window's budget beside
the system turn, which every window keeps, and some of the turns before it, repeated as history up to a
limit. An assistant turn is a target in the one window where it is new; repeated ones are masked.

Conversations are sorted by turn within their partition and streamed: a task holds a few windows of a
conversation, however long it is.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .packing import encoding

#: Strings that must not occur in a text as they are.
_CONTROL = re.compile(r"<\||\|>|</?s>|\[/?INST\]")
_INSIDE = re.compile(r"(?<=<)(?=\||/?s>)|(?<=\|)(?=>)|(?<=\[)(?=/?INST\])")
_TURN = re.compile(r"<\|((?:[^|]|\|(?!>))*)\|>\n(.*?)<\|end\|>\n", re.S)
_WINDOW = "conv_id long, window long, repeated int, text string, mask array<struct<start:int,end:int>>"


def escaped(text: str) -> str:
    return _INSIDE.sub(r"\\", text.replace("\\", "\\\\"))


def unescaped(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.S)


def rendered(turns: list[tuple[str, str]], new: int) -> tuple[str, list[dict[str, int]]]:
    """The window's text and the spans of its targets: assistant texts from turn number ``new`` on."""
    out, at, mask = [], 0, []
    for i, (role, text) in enumerate(turns):
        head, body = f"<|{escaped(role)}|>\n", escaped(text)
        if role == "assistant" and i >= new:
            mask.append({"start": at + len(head), "end": at + len(head) + len(body)})
        out += [head, body, "<|end|>\n"]
        at += len(head) + len(body) + 8
    return "".join(out), mask


def turns_of(text: str) -> list[tuple[str, str]]:
    return [(unescaped(m[1]), unescaped(m[2])) for m in _TURN.finditer(text)]


def cut(cost: np.ndarray, keep: int, budget: int, history: int, before: list[int], begun: bool, last: bool) -> list[tuple[int, int, int]]:
    """Windows (first new turn, end, turns of history) over new turns of ``cost`` after turns of cost ``before``.

    ``keep`` tokens of each window are the system turn's, which is the first turn itself unless ``begun``. Unless ``last``, the run that reaches the end is left for later.
    """
    every = np.r_[before, cost].astype(np.int64)
    sums, at, out = np.r_[0, np.cumsum(every)], len(before), []
    while at < len(every):
        low = int(np.searchsorted(sums, sums[at] - history))  # the earliest turn whose history fits
        low = min(max(low, int(keep > 0 and not begun)), at)
        room = budget - (keep if begun or at else 0)
        end = int(np.searchsorted(sums, sums[low] + room, "right")) - 1
        if end <= at:  # the new turn comes before history; over budget it stands alone
            low, end = at, max(at + 1, int(np.searchsorted(sums, sums[at] + room, "right")) - 1)
        if end >= len(every) and not last:
            break
        out.append((at - len(before), min(end, len(every)) - len(before), at - low))
        at = min(end, len(every))
    return out


def chat_windows(conversations: DataFrame, budget: int = 1024, history: int = 256, path: str | None = None) -> DataFrame:
    """Rows (conv_id, window, repeated, text, mask): windows of each conversation, numbered from 0.

    ``repeated`` turns at a window's start are repeated (the system turn among them); ``mask`` holds the spans of
    characters that are targets. Rows are ordered by turn, equal or null turns by role and text; a null text or
    role counts as empty; a null conv_id is a conversation. A turn over budget is a window of its own, with the
    system turn. Repeated rows are turns each; other columns are ignored; an empty table gives no rows.
    """

    def run(batches):
        enc = encoding(path)
        size = lambda text: len(enc.encode_to_numpy(text, allowed_special="all")) + 4  # noqa: E731  the control strings beside it
        conv, first, number, system, past, new = None, True, 0, None, [], []

        def windows(last):
            nonlocal number, past, new
            spans = cut(np.array([n for _, _, n in new], np.int64), system[2] if system else 0, budget, history, [n for _, _, n in past], number > 0, last)
            rows, done = [], 0
            every = past + new
            for a, b, h in spans:
                own = every[len(past) + a - h : len(past) + b]
                lead = [system] if system and number else []
                text, mask = rendered([(r, t) for r, t, _ in lead + own], len(lead) + h)
                rows.append((conv, number, len(lead) + h, text, mask))
                number, done = number + 1, b
            every, at = every[: len(past) + done], len(past) + done
            tail, total = [], 0
            for turn in reversed(every):
                if total + turn[2] > history or turn is system:
                    break
                tail.insert(0, turn)
                total += turn[2]
            past, new = tail, (past + new)[at:]
            return rows

        def batch(rows):
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.string(), pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], ["conv_id", "window", "repeated", "text", "mask"])

        held = 0
        for rows in batches:
            out = []
            for c, role, text in zip(*(rows.column(n).to_pylist() for n in ("conv_id", "role", "text"))):
                if first or c != conv:
                    out += windows(True) if new else []
                    conv, first, number, system, past, new, held = c, False, 0, None, [], [], 0
                turn = (role or "", text or "", size(text or ""))
                if not new and not number and system is None and turn[0] == "system":
                    system = turn
                new.append(turn)
                held += turn[2]
                if held > 8 * budget:
                    out += windows(False)
                    held = sum(t[2] for t in new)
            if out:
                yield batch(out)
        if new and (out := windows(True)):
            yield batch(out)

    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", "role", "text")
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").select("conv_id", "role", "text").mapInArrow(run, _WINDOW)


def read_back(windows: DataFrame) -> DataFrame:
    """Rows (conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars) from windows alone.

    Windows must be whole and each there once, as ``chat_windows`` gives them: a repeated window would count twice. A null conv_id is a
    conversation, empty turns count as turns, columns beside the windows' own are ignored; an empty table gives no rows.
    """
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]

    def run(batches):
        state = None
        row = lambda s: (s[0], s[1], s[2].hexdigest(), s[3], s[4].hexdigest(), s[5])
        for rows in batches:
            out = []
            for c, repeated, text, mask in zip(*(rows.column(n).to_pylist() for n in ("conv_id", "repeated", "text", "mask"))):
                if state is None or c != state[0]:
                    if state:
                        out.append(row(state))
                    state = [c, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                for role, own in turns_of(text)[repeated:]:
                    state[1] += 1
                    state[2].update(f"{role}\n{own}\n".encode())
                for span in mask:
                    own = unescaped(text[span["start"] : span["end"]])
                    state[3] += len(own)
                    state[4].update(own.encode())
                state[5] += len(text)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), kinds)], names)
        if state:
            yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row(state), kinds)], names)

    ordered = windows.repartition("conv_id").sortWithinPartitions("conv_id", "window").select("conv_id", "repeated", "text", "mask")
    return ordered.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
