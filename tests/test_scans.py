import json

import numpy as np
import pytest

from slitloom.functions import score, spectrum
from slitloom.plans import reconstruct as R
from slitloom.sources import pictures, ser
from slitloom.sources import synthetic as Y
from slitloom.streaming import focus

SMALL = Y.ScanSettings(width=80, height=280, frames=300, radius=100, step=0.75)


@pytest.fixture(scope="module")
def frames(spark):
    return Y.scan(spark, SMALL).persist()


def test_ser_round_trip_and_frame_ranges(spark, tmp_path):
    px = np.random.default_rng(0).integers(0, 65536, (10, 6, 8)).astype(np.float32)
    path = str(tmp_path / "a.ser")
    ser.write_ser(path, px, "me", "it", "far", 5)
    h = ser.read_header(path)
    assert (h.width, h.height, h.frame_count, h.observer, h.date_time) == (8, 6, 10, "me", 5)
    spark.dataSource.register(ser.SerDataSource)
    df = spark.read.format("ser").option("path", path).option("framesPerPartition", "3").load()
    rows = sorted(df.collect(), key=lambda r: r["frame"])
    assert df.rdd.getNumPartitions() == 4 and [r["frame"] for r in rows] == list(range(10))
    assert all((np.array(r["px"]).reshape(6, 8) == px[r["frame"]]).all() for r in rows)
    part = spark.read.format("ser").option("path", path).option("firstFrame", "4").option("lastFrame", "6").load()
    assert sorted(r["frame"] for r in part.collect()) == [4, 5]


def test_ser_refuses_colour_and_short_files(tmp_path):
    path = str(tmp_path / "a.ser")
    ser.write_ser(path, np.zeros((2, 4, 4), np.float32))
    raw = bytearray(open(path, "rb").read())
    for bad in (raw[:100], raw[:-1], raw[:18] + b"\x64" + raw[19:]):
        with open(path, "wb") as f:
            f.write(bytes(bad))
        with pytest.raises(ValueError):
            ser.read_header(path)


def test_eight_bit_frames_are_scaled(tmp_path):
    path = str(tmp_path / "a.ser")
    ser.write_ser(path, np.zeros((1, 2, 2), np.float32))
    raw = bytearray(open(path, "rb").read()[: ser.HEADER])
    raw[34] = 8
    with open(path, "wb") as f:
        f.write(bytes(raw) + bytes([0, 1, 2, 255]))
    assert ser.read_frames(path, ser.read_header(path), 0, 1).ravel().tolist() == [0, 257, 514, 65535]


def test_pictures_round_trip(tmp_path):
    img = np.random.default_rng(0).uniform(0, 5000, (13, 17)).astype(np.float32)
    pictures.write_fits(str(tmp_path / "a.fits"), img)
    assert (pictures.read_fits(str(tmp_path / "a.fits")) == img).all()
    assert (tmp_path / "a.fits").stat().st_size % 2880 == 0
    pictures.write_png16(str(tmp_path / "a.png"), img, 0, 5000)
    assert np.abs(pictures.read_png_gray(str(tmp_path / "a.png")) / 65535 * 5000 - img).max() < 0.1
    v = np.linspace(-1.5, 1.5, 60).reshape(6, 10)
    pictures.write_velocity_png(str(tmp_path / "v.png"), v)
    assert np.abs(pictures.read_velocity_png(str(tmp_path / "v.png")) - v).max() < 1e-4
    pictures.write_png_rgb(str(tmp_path / "c.png"), np.zeros((3, 4, 3)))
    with pytest.raises(ValueError):
        pictures.read_png_gray(str(tmp_path / "c.png"))


def test_texture_is_reproducible():
    x, y = np.mgrid[:20, :20] / 3.0
    assert (Y.octaves(x, y, 7) == Y.octaves(x, y, 7)).all() and 0.1 < Y.octaves(x, y, 7).mean() < 0.9


def test_mean_spectrum_has_the_line_at_nought(frames):
    rows = {r["offset_px"]: r["intensity"] for r in R.mean_spectrum(frames).collect()}
    assert abs(min(rows, key=rows.get)) <= 1
    found, _ = R.geometries(frames)
    y = np.arange(60, 220)
    assert np.abs(found["synthetic"].line.centre(y) - Y.smile(SMALL)[y]).max() < 0.1


def test_default_beats_baseline(frames):
    truth = Y.Sun(SMALL.seed).image(SMALL.radius).astype(float)
    got = {}
    for name, o in (("baseline", R.Options(baseline=True)), ("default", R.Options())):
        out = R.reconstruct(frames, o).collect()
        disk = np.array([r["row"] for r in sorted((r for r in out if r["kind"] == "disk"), key=lambda r: r["y"])])
        got[name] = score.evaluate(disk, truth, SMALL.radius)
        report = json.loads(next(r["report"] for r in out if r["kind"] == "report"))
        assert report["ellipse"]["radius"] == pytest.approx(SMALL.radius, abs=0.5)
    assert got["default"]["disk_psnr"] > got["baseline"]["disk_psnr"]
    assert got["default"]["disk_ssim"] > got["baseline"]["disk_ssim"]


def test_result_does_not_depend_on_partitions(frames):
    o = R.Options(motion=False, scan_positions=False)
    one, four = (R.disk_of(R.reconstruct(frames.repartition(n), o))["synthetic"] for n in (1, 5))
    assert np.abs(one - four).max() <= 1e-4 * one.max()


def test_a_scan_without_light_gives_no_disk(spark):
    dark = spark.createDataFrame([("dark", t, 8, 40, [200.0] * 320) for t in range(60)], "scan_id string, frame int, width int, height int, px array<float>")
    assert R.reconstruct(dark).where("kind = 'disk'").count() == 0
    assert R.reconstruct(dark.limit(0)).count() == 0


def test_tuning_by_name():
    assert R.Tuning.parse("nlm_h=2.5, pca_k=0").nlm_h == 2.5
    with pytest.raises(KeyError):
        R.Tuning.parse("nothing=1")


def test_focus_follows_the_made_width(spark):
    seq = spark.range(0, 240, 7).withColumnRenamed("id", "seq")
    rows = focus.measured(focus.made_frames(seq), rule="deepest").where("axis = 'x'").collect()
    error = [abs(r["fwhm"] - 2.3548 * float(Y.focus_sigma(r["seq"]))) for r in rows]
    assert len(rows) == 35 and max(error) < 0.5


def test_focus_stream_holds_the_least_width(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    for k, seqs in enumerate((range(0, 40), range(40, 80))):
        spark.createDataFrame([(s,) for s in seqs], "seq bigint").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema("seq bigint").parquet(str(tmp_path / "in"))
        out = focus.held(focus.measured(focus.made_frames(stream, 256, 40), rule="deepest"))
        q = out.writeStream.outputMode("update").format("memory").queryName(f"held{k}").option("checkpointLocation", str(tmp_path / "state")).start() if k == 0 else None
        if q is not None:
            q.processAllAvailable()
            rows = spark.sql("select * from held0 where axis = 'x'").collect()
            assert len(rows) == 40
            last = max(rows, key=lambda r: r["seq"])
            assert last["held"] == min(r["fwhm"] for r in rows) and last["n_recent"] == 40
            q.stop()


def test_newest_wins(spark):
    df = spark.createDataFrame([("x", 1, 5.0), ("x", 3, 6.0), ("y", 2, 7.0)], "axis string, seq bigint, fwhm double")
    assert sorted(tuple(r) for r in focus.newest(df).collect()) == [("x", 3, 6.0), ("y", 2, 7.0)]


def test_conditions_on_the_frame_reach_the_file(spark, tmp_path):
    px = np.random.default_rng(0).integers(0, 65536, (40, 3, 4)).astype(np.float32)
    for name in ("a", "b"):
        (tmp_path / name).mkdir()
        ser.write_ser(str(tmp_path / name / "scan.ser"), px)
    spark.dataSource.register(ser.SerDataSource)
    both = spark.read.format("ser").option("path", f"{tmp_path}/a/scan.ser,{tmp_path}/b/scan.ser").load()
    assert both.select("scan_id").distinct().count() == 2  # of one name, in two folders
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        df = spark.read.format("ser").option("path", f"{tmp_path}/a/scan.ser").option("framesPerPartition", "5").option("pushdown", "true").load().where("frame > 9 and frame <= 20")
        assert sorted(r["frame"] for r in df.collect()) == list(range(10, 21)) and df.rdd.getNumPartitions() == 3
    finally:
        spark.conf.set("spark.sql.python.filterPushdown.enabled", "false")


def test_bursts_are_found_and_mended(spark):
    s = Y.ScanSettings(width=64, height=260, frames=260, radius=95, step=0.8, bursts=0.25, jitter=0.1, dust=False, cloud=False, seed=5)
    known = Y.truth(s)
    assert 0.03 < (known["blur"] > 0).mean() < 0.5
    y = np.arange(s.height)[:, None] + known["jitter"][None] - s.height / 2
    frames = Y.scan(spark, s)
    report = {}
    for name, o in (("with", R.Options()), ("without", R.Options(bursts=False))):
        out = R.reconstruct(frames, o).collect()
        report[name] = json.loads(next(r["report"] for r in out if r["kind"] == "report"))
    assert report["with"]["bursts"] > 0 and "bursts" not in report["without"] and len(y) == s.height


def test_water_lines_show_the_flexure(spark):
    s = Y.ScanSettings(width=120, height=240, frames=200, radius=95, step=1.0, water=True, flexure=0.8, jitter=0.0, cloud=False, dust=False)
    out = R.reconstruct(Y.scan(spark, s), R.Options(motion=False)).where("kind = 'report'").collect()
    assert json.loads(out[0]["report"])["water_lines"] >= 1


def test_seeing_widens_the_limb_and_weights_are_one():
    assert sum(w for *_, w in Y.stencil(1.3, 0.6)) == pytest.approx(1) and Y.stencil(0, 0) == [(0.0, 0.0, 1.0)]
    s = Y.ScanSettings(width=40, height=260, frames=3, radius=100, noise=False, dust=False, cloud=False, jitter=0.0, tilt_deg=0.0)
    sharp, soft = (Y.render(q, np.array([1]), Y.truth(q))[0].sum(1) for q in (s, Y.replace(s, seeing=3.0)))
    assert np.abs(np.diff(soft)).max() < 0.8 * np.abs(np.diff(sharp)).max()
    assert Y.truth(s)["jitter_x"].max() == 0


def test_focus_reset_forgets_the_least_width(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    rows = [(i, "x", 1, 5.0, f, 0.5, i == 6) for i, f in enumerate([5.0, 3.0, 4.0, 6.0, 5.0, 7.0, 6.5, 8.0])]
    schema = "seq bigint, axis string, n_lines int, center double, fwhm double, depth double, reset boolean"
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    q = focus.held(spark.readStream.schema(schema).parquet(str(tmp_path / "in"))).writeStream.outputMode("update").format("memory").queryName("again").option("checkpointLocation", str(tmp_path / "state")).start()
    focus.stop(q)
    got = {r["seq"]: (r["held"], r["n_recent"]) for r in spark.sql("select * from again").collect()}
    assert got[5] == (3.0, 6) and got[6] == (6.5, 1) and got[7] == (6.5, 2)


def test_each_picture_is_calibrated(spark):
    x = np.arange(900.0)
    places = [(w - 4861.34) / 0.6 + 450 for w, *_ in spectrum.CATALOG if abs(w - 4861.34) < 250]  # no two of equal depth
    dips = sum((0.5 + 0.05 * k) * np.exp(-0.5 * ((x - at) / 3) ** 2) for k, at in enumerate(p for p in [*places, 450.0] if 20 < p < 880))
    frame = np.tile(30000.0 * (1 - np.minimum(dips, 0.95)), (4, 1))
    df = spark.createDataFrame([(1, 900, 4, frame.astype(int).ravel().tolist()), (2, 900, 4, [30000] * 3600)], "seq bigint, width int, height int, px array<int>")
    rows = {r["seq"]: r for r in focus.calibrated(df, 4861.34, 0.6).collect()}
    assert set(rows) == {1, 2} and rows[2]["a"] is None
    assert rows[1]["n"] is None or rows[1]["rms"] < 5
