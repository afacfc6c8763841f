"""Per-stage durations from a Spark event log (the UI stays off).

Usage: python tools/stage_times.py EVENT_LOG_DIR [--top N]

Reads every event file under the folder (plain or zstd-compressed, as Spark 4
writes them) and prints the slowest stages with their task counts.
"""

from __future__ import annotations

import argparse
import glob
import io
import json
import os


def _lines(path: str):
    if path.endswith(".zstd") or path.endswith(".zst"):
        import zstandard
        with open(path, "rb") as fh:
            reader = zstandard.ZstdDecompressor().stream_reader(fh)
            yield from io.TextIOWrapper(reader, encoding="utf-8")
    else:
        with open(path, encoding="utf-8") as fh:
            yield from fh


def stage_times(folder: str) -> list[tuple[int, str, int, int]]:
    out = []
    for path in sorted(glob.glob(os.path.join(folder, "**", "events_*"), recursive=True)):
        for line in _lines(path):
            if '"SparkListenerStageCompleted"' not in line:
                continue
            si = json.loads(line)["Stage Info"]
            took = si.get("Completion Time", 0) - si.get("Submission Time", 0)
            out.append((si["Stage ID"], si["Stage Name"], took, si.get("Number of Tasks", 0)))
    return out


def main():
    ap = argparse.ArgumentParser()
    ap.add_argument("folder")
    ap.add_argument("--top", type=int, default=15)
    a = ap.parse_args()
    rows = sorted(stage_times(a.folder), key=lambda r: -r[2])
    for sid, name, ms, tasks in rows[:a.top]:
        print(f"stage {sid:5d} {ms:7d} ms {tasks:5d} tasks  {name[:70]}")
    print(f"{len(rows)} stages, {sum(r[2] for r in rows)} ms in total")


if __name__ == "__main__":
    main()
