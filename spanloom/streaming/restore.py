"""Restoring placeholders in text that arrives in pieces.

State is kept for each stream: its vault, its next number and the tail of text that could still become a placeholder. A piece
is released up to the last place where no placeholder can begin, so any split of a text gives the text that restoring it whole gives.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def _pattern(placeholders: Iterable[str]) -> re.Pattern | None:
    """Any of the placeholders, the longest first."""
    ordered = sorted((p for p in placeholders if p), key=lambda p: (-len(p), p))
    return re.compile("|".join(map(re.escape, ordered))) if ordered else None


def safe_length(text: str, placeholders: list[str]) -> int:
    """How much of a text can be released: all but the first tail from which a placeholder could still begin or grow.

    A complete placeholder that no longer one begins with is behind us: no tail begins inside it.
    """
    pattern, at = _pattern(placeholders), 0
    if pattern is None:
        return len(text)
    edge = max(0, len(text) - max(map(len, placeholders)) + 1)
    while True:
        found = pattern.search(text, at)
        stop = found.start() + 1 if found else len(text)
        for place in range(max(at, edge), stop):
            tail = text[place:]
            if any(len(p) > len(tail) and p.startswith(tail) for p in placeholders):
                return place
        if not found:
            return len(text)
        at = found.end()


def substituted(text: str, vault: dict[str, str]) -> str:
    """Every placeholder replaced, longest first, in one pass from the left."""
    pattern = _pattern(vault)
    return pattern.sub(lambda m: vault[m[0]], text) if pattern else text


def release(buffer: str, piece: str, vault: dict[str, str], last: bool) -> tuple[str, str]:
    """What can be told after another piece, and what is held back."""
    text = buffer + piece
    n = len(text) if last else safe_length(text, list(vault))
    return substituted(text[:n], vault), text[n:]


def restored(pieces: DataFrame, idle: str = "10 minutes") -> DataFrame:
    """stream_id, seq, text from pieces (stream_id, seq, piece, last, placeholders, values) of a stream or a table of them.

    placeholders and values are the vault of a stream, repeated on its pieces. State goes when a stream ends or idles; one that idles
    is told what was held back, restored, under the number after its latest.
    """

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            buffer, names, values, seq = state.get
            state.remove()
            text, _ = release(buffer, "", dict(zip(names, values, strict=True)), True)
            yield pd.DataFrame([(key[0], seq, text)], columns=["stream_id", "seq", "text"])
            return
        buffer, names, values, seq = state.get if state.exists else ("", [], [], 0)
        rows = []
        held = list(frames)
        for frame in [pd.concat(held).sort_values("seq", kind="stable")] if held else []:
            for r in frame.itertuples():
                vault = dict(zip(r.placeholders, r.values, strict=True))
                text, buffer = release(buffer, r.piece or "", vault, bool(r.last))
                rows.append((key[0], r.seq, text))
                names, values, seq = list(r.placeholders), list(r.values), int(r.seq) + 1
                if r.last:
                    buffer = ""
        if buffer:
            state.update((buffer, list(names), list(values), seq))
            state.setTimeoutDuration(_milliseconds(idle))
        elif state.exists:
            state.remove()
        yield pd.DataFrame(rows, columns=["stream_id", "seq", "text"])

    return pieces.select("stream_id", "seq", "piece", "last", "placeholders", "values").groupBy("stream_id").applyInPandasWithState(run, "stream_id string, seq long, text string", "buffer string, placeholders array<string>, values array<string>, next long", "append", GroupStateTimeout.ProcessingTimeTimeout)


def _milliseconds(text: str) -> int:
    n, unit = text.split()
    return int(n) * {"second": 1000, "minute": 60_000, "hour": 3_600_000}[unit.rstrip("s")]


def reframed(chunks: DataFrame, idle: str = "10 minutes") -> DataFrame:
    """stream_id, nth, event, data, id of server-sent events from chunks (stream_id, seq, chunk) of streams, wherever these were cut.

    State is the bytes behind the last blank line and the number of events so far. What a stream that idles or ends leaves incomplete is no event.
    """

    def run(key: tuple, frames_: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        carried, nth = state.get if state.exists else ("", 0)
        rows, held = [], list(frames_)
        for chunk in pd.concat(held).sort_values("seq", kind="stable")["chunk"] if held else []:
            carried += chunk or ""
            # A carriage return at the end may be half of a line end.
            whole = carried[:-1] if carried.endswith("\r") else carried
            text = whole.replace("\r\n", "\n")
            done, blank, rest = text.rpartition("\n\n")
            if blank:
                carried = rest + carried[len(whole) :]
                for f in frames(done + blank):
                    rows.append((key[0], nth, f.get("event"), f.get("data"), f.get("id")))
                    nth += 1
        state.update((carried, nth))
        state.setTimeoutDuration(_milliseconds(idle))
        yield pd.DataFrame(rows, columns=["stream_id", "nth", "event", "data", "id"])

    return chunks.select("stream_id", "seq", "chunk").groupBy("stream_id").applyInPandasWithState(run, "stream_id string, nth long, event string, data string, id string", "carried string, nth long", "append", GroupStateTimeout.ProcessingTimeTimeout)


def frames(text: str) -> list[dict[str, str]]:
    """Server-sent events of a text whose frames end in a blank line, with either kind of line end."""
    out = []
    for block in text.replace("\r\n", "\n").split("\n\n"):
        frame: dict[str, str] = {}
        for line in block.split("\n"):
            name, _, value = line.partition(":")
            if name in ("event", "data", "id"):
                value = value.removeprefix(" ")
                frame[name] = f"{frame[name]}\n{value}" if name in frame else value
        if frame:
            out.append(frame)
    return out
