"""Live focus: frames in, line widths out, with a least-width hold.

`frames` is a stream (or a table) of `(seq, ts)` for the made camera, or of
`(seq, ts, width, height, px)` from another source.  Each frame gives one
measurement an axis; keyed state keeps each axis's least width and its last
600 trusted measurements.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..functions import spectrum as S
from ..sources import synthetic as Y

DEPTH_GATE = 0.03
HISTORY = 600
MEASURED = "seq bigint, axis string, n_lines int, center double, fwhm double, depth double"
HELD = "axis string, seq bigint, fwhm double, held double, n_recent int, mean_recent double"


def choose(lines: list[dict], rule: str = "narrowest", near: float = 0.0) -> dict | None:
    """The narrowest, the deepest, or the line nearest a place; ties to the first."""
    if not lines:
        return None
    key = {"narrowest": lambda f: f["fwhm"], "deepest": lambda f: -f["depth"], "nearest": lambda f: abs(f["center"] - near)}[rule]
    return min(lines, key=key)


def mean_profile(frame: np.ndarray, dispersion_horizontal: bool) -> np.ndarray:
    return frame.mean(0 if dispersion_horizontal else 1, dtype=float)


def made_frames(frames: DataFrame, width: int = 512, height: int = 200) -> DataFrame:
    """The made camera's pictures for a stream of sequence numbers."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for i in range(0, len(pdf), 16):
                part = pdf.iloc[i : i + 16]
                px = [Y.focus_frame(int(s), width, height).astype(np.int32).reshape(-1) for s in part["seq"]]
                yield pd.DataFrame({"seq": part["seq"], "width": width, "height": height, "px": px})

    return frames.select("seq").mapInPandas(run, "seq bigint, width int, height int, px array<int>")


def measured(pictures: DataFrame, rule: str = "narrowest", least: float = 0.02) -> DataFrame:
    """MEASURED: the chosen line of both axes' mean profiles; null without one."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for seq, w, h, px in zip(pdf["seq"], pdf["width"], pdf["height"], pdf["px"], strict=True):
                frame = np.asarray(px).reshape(h, w)
                for axis, horizontal in (("x", True), ("y", False)):
                    lines = S.all_lines(mean_profile(frame, horizontal), least)
                    one = choose(lines, rule) or {}
                    rows.append((seq, axis, len(lines), one.get("center"), one.get("fwhm"), one.get("depth")))
            out = pd.DataFrame(rows, columns=["seq", "axis", "n_lines", "center", "fwhm", "depth"])
            yield out.astype({"center": float, "fwhm": float, "depth": float})

    return pictures.mapInPandas(run, MEASURED)


class Hold(StatefulProcessor):
    """Least width and recent history of one axis; a row whose `reset` is true
    forgets both before it is looked at."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.least = handle.getValueState("least", "fwhm double")
        self.recent = handle.getListState("recent", "fwhm double")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        held = self.least.get()[0] if self.least.exists() else np.inf
        history = [r[0] for r in self.recent.get()] if self.recent.exists() else []
        out = []
        for pdf in rows:
            pdf = pdf.sort_values("seq")
            reset = pdf["reset"].fillna(False) if "reset" in pdf else [False] * len(pdf)
            for (seq, fwhm, depth), again in zip(pdf[["seq", "fwhm", "depth"]].itertuples(index=False), reset, strict=True):
                if again:
                    held, history = np.inf, []
                    self.least.clear()
                    self.recent.clear()
                if not np.isfinite(fwhm) or not depth > DEPTH_GATE:
                    continue
                held = min(held, fwhm)
                history = [*history, fwhm][-HISTORY:]
                out.append((key[0], seq, fwhm, held, len(history), float(np.mean(history))))
        if out:
            self.least.update((float(held),))
            self.recent.put([(float(v),) for v in history])
        yield pd.DataFrame(out, columns=["axis", "seq", "fwhm", "held", "n_recent", "mean_recent"])

    def close(self) -> None:
        pass


def held(measurements: DataFrame) -> DataFrame:
    """HELD of a stream of measurements; needs the RocksDB state store."""
    return measurements.groupBy("axis").transformWithStateInPandas(statefulProcessor=Hold(), outputStructType=HELD, outputMode="Update", timeMode="None")


def calibrated(pictures: DataFrame, wavelength: float, dispersion: float, least: float = 0.02) -> DataFrame:
    """(seq, a, b, rms, n): wavelength = a + b x of each picture's lines, near an
    expected wavelength and dispersion (Angstrom, a pixel); null without a fit."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for seq, w, h, px in zip(pdf["seq"], pdf["width"], pdf["height"], pdf["px"], strict=True):
                lines = S.all_lines(mean_profile(np.asarray(px).reshape(h, w), True), least)
                got = S.calibrate(np.array([q["center"] for q in lines]), np.array([q["depth"] for q in lines]), wavelength, dispersion) if lines else None
                rows.append((seq, *((got or {}).get(k) for k in ("a", "b", "rms", "n"))))
            yield pd.DataFrame(rows, columns=["seq", "a", "b", "rms", "n"]).astype({"a": float, "b": float, "rms": float, "n": "Int32"})

    return pictures.mapInPandas(run, "seq bigint, a double, b double, rms double, n int")


def newest(batch: DataFrame) -> DataFrame:
    """The last measurement of each axis: what is behind it is dropped."""
    return batch.groupBy("axis").agg(F.max_by(F.struct(*(c for c in batch.columns if c != "axis")), "seq").alias("u")).select("axis", "u.*")


def stop(query) -> None:
    """Ends a query when the pictures at hand are done; the same checkpoint goes on from there."""
    query.processAllAvailable()
    query.stop()


def start(measurements: DataFrame, show: Callable[[DataFrame, int], None], checkpoint: str):
    """A query that hands each micro-batch's newest measurements to show(df, epoch)."""
    return measurements.writeStream.foreachBatch(lambda df, epoch: show(newest(df), epoch)).option("checkpointLocation", checkpoint).start()
