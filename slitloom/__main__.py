"""python -m slitloom synth|recon|spectrum|bench|stack|colorize|diskfit|eval|eval-velocity ..."""

from __future__ import annotations

import argparse
import json
from dataclasses import asdict, replace

import numpy as np


def _session():
    from pyspark.sql import SparkSession

    from .sources.ser import SerDataSource

    spark = SparkSession.builder.appName("slitloom").getOrCreate()
    spark.dataSource.register(SerDataSource)
    return spark


def _options(a: argparse.Namespace):
    from .plans.reconstruct import Options, Tuning

    return Options(baseline=a.baseline, deconvolve=a.deconvolve, denoise=a.denoise, flip_x=a.flip_x, flip_y=a.flip_y, rotation_deg=a.rotation, tuning=Tuning.parse(a.tune))


def main(argv: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(prog="slitloom")
    sub = p.add_subparsers(dest="command", required=True)
    for name in ("synth", "recon", "spectrum", "bench", "stack", "colorize", "diskfit", "eval", "eval-velocity"):
        q = sub.add_parser(name)
        q.add_argument("inputs", nargs="*")
        q.add_argument("--out", default=".")
        q.add_argument("--tune", default="")
        q.add_argument("--rotation", type=float, default=0.0)
        q.add_argument("--seed", type=int, default=42)
        q.add_argument("--frames", type=int, default=900)
        q.add_argument("--radius", type=float, default=255.0)
        for name_ in ("bursts", "seeing", "flexure", "jitter-x"):
            q.add_argument(f"--{name_}", type=float, default=0.0)
        q.add_argument("--scans", type=int, default=1)
        for flag in ("baseline", "deconvolve", "denoise", "flip-x", "flip-y", "velocity", "clean", "doppler", "water"):
            q.add_argument(f"--{flag}", action="store_true")
    a = p.parse_args(argv)

    from .functions import geometry, render, score, stacking
    from .plans import outputs
    from .plans import reconstruct as R
    from .sources import pictures, ser
    from .sources import synthetic as Y

    settings = Y.ScanSettings(seed=a.seed, frames=a.frames, radius=a.radius, bursts=a.bursts, seeing=a.seeing, flexure=a.flexure, jitter_x=a.jitter_x, doppler=a.doppler, water=a.water)
    settings = settings.clean() if a.clean else settings
    if a.command == "synth":
        for k in range(a.scans):
            known = Y.truth(replace(settings, seed=a.seed + 7717 * k))
            px = np.concatenate([Y.render(settings, np.arange(t, min(t + 32, a.frames)), known) for t in range(0, a.frames, 32)])
            ser.write_ser(f"{a.out}/scan{k or ''}.ser", px)
        if a.doppler:
            pictures.write_velocity_png(f"{a.out}/truth_velocity.png", Y.Sun(a.seed).velocity_image(a.radius))
        pictures.write_png16(f"{a.out}/truth.png", Y.Sun(a.seed).image(a.radius), 0, 1.6)
    elif a.command in ("recon", "spectrum"):
        frames = _session().read.format("ser").option("path", ",".join(a.inputs)).load()
        if a.command == "spectrum":
            outputs.save_spectrum(R.mean_spectrum(frames), f"{a.out}/spectrum")
        else:
            out = R.reconstruct(frames, _options(a)).persist()
            print("\n".join(outputs.save(out, a.out, a.velocity)))
            print(json.dumps(outputs.reports(out)))
    elif a.command == "bench":
        scores = outputs.bench(_session(), settings, a.inputs or None, a.tune).persist()
        scores.show(truncate=False)
        outputs.append_ledger(scores, f"{a.out}/ledger")
    else:
        if a.command == "eval-velocity":
            v, true, img, whole = (f(p) for f, p in zip((pictures.read_velocity_png,) * 2 + (lambda f: pictures.read_png_gray(f).astype(float),) * 2, a.inputs, strict=True))
            print(json.dumps(score.evaluate_velocity_pair(v, true, img, whole, a.radius)))
            return
        read = lambda f: pictures.read_fits(f) if f.endswith(".fits") else pictures.read_png_gray(f)
        images = [read(f).astype(float) for f in a.inputs]
        if a.command == "stack":
            got = stacking.stack(images)
            pictures.write_fits(f"{a.out}/stack.fits", got["image"].astype(np.float32))
            print(json.dumps({k: got[k] for k in ("n", "weights", "reference")}))
        elif a.command == "diskfit":
            e = geometry.fit_ellipse(geometry.limb_points(images[0]))
            print(json.dumps({k: v for k, v in asdict(e).items() if k != "conic"} if e else None))
        elif a.command == "colorize":
            pictures.write_png_rgb(f"{a.out}/colour.png", render.colorize(images[0]))
        else:
            print(json.dumps(score.evaluate(images[0], images[1], a.radius)))


if __name__ == "__main__":
    main()
