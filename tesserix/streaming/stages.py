"""Work in stages on the driver: retries with growing waits, a record of what is done, and no going on under another fingerprint.

Stages are Spark jobs or streams that can be started again; Spark itself repeats failed tasks inside them. The record is a file of any store (a folder that outlives the driver, such as the
shared one), so a driver that is started elsewhere goes on as well."""

from __future__ import annotations

import json
import time
from collections.abc import Callable

import pyarrow.fs as pafs

from tesserix.sources.scan import opened

RETRIES, LONGEST = 4, 60


def delay(attempt: int) -> int:
    """Seconds before the next attempt: twice as long each time, LONGEST at most."""
    return min(LONGEST, 2**attempt)


def with_retries(work: Callable, retries: int = RETRIES, wait: Callable[[float], None] = time.sleep):
    """work(), started again after failures; the failure that follows the last retry is raised."""
    for attempt in range(1, retries + 2):
        try:
            return work()
        except Exception:
            if attempt > retries:
                raise
            wait(delay(attempt))
    return None


def completed(path: str, fingerprint: str) -> list[str]:
    """The stages that the record at path names; a record of another fingerprint is an error, never a fresh start."""
    fs, at = opened(path)
    if fs.get_file_info(at).type != pafs.FileType.File:
        return []
    with fs.open_input_stream(at) as f:
        record = json.loads(f.read().decode("utf-8"))
    if record["fingerprint"] != fingerprint:
        raise ValueError(f"{path} was begun under another fingerprint")
    return record["completed"]


def _record(path: str, value: dict) -> None:
    """Whole or not at all: written beside its place and then moved."""
    fs, at = opened(path)
    fs.create_dir(at.rpartition("/")[0], recursive=True)
    with fs.open_output_stream(f"{at}.new") as f:
        f.write(json.dumps(value, indent=2, sort_keys=True).encode("utf-8"))
    fs.move(f"{at}.new", at)


def run(plan: list[tuple[str, Callable]], path: str, fingerprint: str, retries: int = 3, wait: Callable[[float], None] = time.sleep) -> list[str]:
    """Run the stages that the record doesn't name yet, in order; each is recorded when it is done, and a stage that goes on failing ends the run."""
    done = completed(path, fingerprint)
    for name, work in plan:
        if name not in done:
            with_retries(work, retries, wait)
            done = [*done, name]
            _record(path, {"fingerprint": fingerprint, "completed": done})
    return done
