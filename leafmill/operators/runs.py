"""Runs that can be called off: each is a tag on the session's jobs."""

from __future__ import annotations

import os
import threading
import time
from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame, Row, SparkSession

from leafmill.sources import pdf
from leafmill.sources.pdf_model import PdfError


class Runs:
    """Runs by id. An id is in use at most once; calling off one that isn't there is fine."""

    def __init__(self, spark: SparkSession):
        self.spark, self._lock, self._open, self._off = spark, threading.Lock(), set(), set()
        self._written: set[str] = set()

    def run(self, ident: str, work: Callable[[], Any]) -> Any:
        """Do work, whose jobs carry the id. PdfError 'cancelled' if it was called off."""
        with self._lock:
            if ident in self._open:
                raise PdfError("config", f"run {ident} is under way")
            self._open.add(ident)
            self._off.discard(ident)
        context, tag = self.spark.sparkContext, f"leafmill-{ident}"
        context.addJobTag(tag)
        try:
            result = work()
        except Exception as e:
            if ident in self._off:
                raise PdfError("cancelled", ident) from e
            raise
        finally:
            context.removeJobTag(tag)
            with self._lock:
                self._open.discard(ident)
        if ident in self._off:
            raise PdfError("cancelled", ident)
        return result

    def cancel(self, ident: str, wait: float = 0.0) -> bool:
        """Call a run off, and wait so many seconds until it has ended; whether there is one."""
        with self._lock:
            if ident not in self._open:
                return False
            self._off.add(ident)
        end = time.monotonic() + wait
        while True:
            self.spark.sparkContext.cancelJobsWithTag(f"leafmill-{ident}")
            if ident not in self.under_way() or time.monotonic() >= end:
                return True
            time.sleep(0.05)

    def analyze(self, ident: str, files: DataFrame, password: str | None = None) -> list[Row]:
        """The analyses of a run's files. They come to the driver, so files are those of one user's queue."""
        return self.run(ident, lambda: pdf.analyze(files, password=password).collect())

    def compress(self, ident: str, files: DataFrame, settings: dict, folder: str, target_bytes: int | None = None, password: str | None = None) -> list[Row]:
        """What became of a run's files, written to a folder; what was written may be opened from then on."""

        def work() -> list[Row]:
            done = pdf.write_files(pdf.optimize(files, settings, target_bytes, password), folder, settings["preset"]).collect()
            with self._lock:
                self._written |= {os.path.realpath(r.output_path) for r in done if r.output_path}
            return done

        return self.run(ident, work)

    def scanned(self, ident: str, files: DataFrame, settings: dict, folder: str, password: str | None = None) -> list[Row]:
        """compress() of scans, whose images and streams are worked on whatever the settings say."""
        return self.compress(ident, files, settings | {"optimize_images": True, "compress_streams": True}, folder, None, password)

    def may_open(self, path: str) -> bool:
        """Whether a run of this session wrote the file."""
        with self._lock:
            return os.path.realpath(path) in self._written

    def under_way(self) -> set[str]:
        with self._lock:
            return set(self._open)


class PendingOpens:
    """Paths that come before anybody takes them are kept; from then on they are handed on."""

    def __init__(self) -> None:
        self._lock, self._ready, self._kept = threading.Lock(), False, []

    def stage(self, paths: list[str]) -> list[str] | None:
        """The paths if somebody takes them, else None: they are kept."""
        with self._lock:
            if self._ready:
                return paths
            self._kept += paths
            return None

    def ready(self) -> list[str]:
        """What was kept, once; later paths are handed on."""
        with self._lock:
            self._ready, kept, self._kept = True, self._kept, []
            return kept
