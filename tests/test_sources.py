import os
import struct

import numpy as np
import pandas as pd
import pytest

from lumispark.plans.workflows import stack_of
from lumispark.sources import datasource, images, tabular, tiff


def stack(kind=np.uint16, shape=(6, 9, 11)):
    return (np.arange(np.prod(shape)) % 251).reshape(shape).astype(kind)


@pytest.mark.parametrize("kind", [np.uint8, np.uint16, np.int16, np.float32, np.float64])
def test_stacks_come_back(kind):
    pages = tiff.read_pages(tiff.write_stack(stack(kind), "spacing=2.5 loop", 0.4))
    assert (np.stack([p.array() for p in pages]) == stack(kind)).all() and pages[0].array().dtype == kind
    assert tiff.spacing(pages[0])[0] == pytest.approx(0.4) and tiff.spacing(pages[0])[2] == 2.5


def by_hand(order, entries, body):
    out = (b"II" if order == "<" else b"MM") + struct.pack(order + "HI", 42, 8 + len(body)) + body
    out += struct.pack(order + "H", len(entries))
    for tag, kind, value in entries:
        out += struct.pack(order + "HHI", tag, kind, 1) + (struct.pack(order + "HH", value, 0) if kind == 3 else struct.pack(order + "I", value))
    return out + struct.pack(order + "I", 0)


def test_byte_orders_prediction_and_packing():
    plane = np.array([[1, 2, 4], [7, 7, 9]], np.uint8)
    base = [(256, 4, 3), (257, 4, 2), (258, 3, 8)]
    big = by_hand(">", [*base, (259, 3, 1), (273, 4, 8), (278, 4, 2), (279, 4, 6)], plane.tobytes())
    assert (tiff.read_pages(big)[0].array() == plane).all()
    steps = np.diff(plane, axis=1, prepend=0).astype(np.uint8).tobytes()
    predicted = by_hand("<", [*base, (259, 3, 1), (273, 4, 8), (278, 4, 2), (279, 4, 6), (317, 3, 2)], steps)
    assert (tiff.read_pages(predicted)[0].array() == plane).all()
    bits = by_hand("<", [*base, (259, 3, 32773), (273, 4, 8), (278, 4, 2), (279, 4, 8)], bytes([2, 1, 2, 4, 255, 7, 0, 9]))
    assert (tiff.read_pages(bits)[0].array() == plane).all()
    with pytest.raises(ValueError):
        tiff.read_pages(b"PK\3\4 not an image")


def test_a_damaged_last_page_leaves_no_plane(spark, tmp_path):
    whole = tiff.write_stack(stack(np.uint8, (4, 8, 8)), "slices=4")
    (tmp_path / "good.tif").write_bytes(whole)
    last = int(tiff._one(tiff.read_pages(whole)[3].tags[tiff.STRIP_OFFSETS]))
    (tmp_path / "bad.tif").write_bytes(whole.replace(struct.pack("<I", last), struct.pack("<I", len(whole) - 3)))
    planes, status = images.planes(images.files(spark, str(tmp_path)))
    assert {r.image_id: r.flag for r in status.collect()} == {"good.tif": "ok", "bad.tif": "IMAGE FAILED"}
    assert [r.image_id for r in planes.collect()] == ["good.tif"] * 4


def test_stacks_with_missing_planes_are_refused():
    plane = {"t": 0, "c": 0, "dtype": "|u1", "height": 1, "width": 1, "samples": 1, "data": b"x"}
    rows = pd.DataFrame([plane | {"z": z, "c": c} for z, c in ((0, 0), (0, 1), (1, 0))])
    with pytest.raises(ValueError):
        stack_of(rows)
    assert stack_of(rows[rows["c"] == 0]).shape == (1, 2, 1, 1, 1)


def test_files_to_planes_pixels_and_movies(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    data = stack(np.uint8)
    for k, t in enumerate([10, 2, 1]):
        (tmp_path / "sub" / f"a_T{t}_movie_x.tif").write_bytes(tiff.write_stack(data + np.uint8(k), "slices=3\nchannels=2"))
    (tmp_path / "broken_T1_movie_x.tif").write_bytes(b"II*\0junk")
    (tmp_path / "notes.txt").write_text("no image")
    planes, status = images.planes(images.files(spark, str(tmp_path)), only={"c": {1}})
    assert {r.image_id: r.flag for r in status.collect()} == {"broken_T1_movie_x.tif": "IMAGE FAILED", **{f"a_T{t}_movie_x.tif": "ok" for t in (10, 2, 1)}}
    rows = planes.orderBy("image_id", "z").collect()
    assert len(rows) == 9 and {r.c for r in rows} == {1} and [r.z for r in rows[:3]] == [0, 1, 2]
    assert (images.to_array(rows[0].dtype, rows[0].height, rows[0].width, rows[0].samples, rows[0].data) == data[1] + np.uint8(2 if "T1_" in rows[0].image_id else 0)).all()
    pixels = images.pixels(planes)
    assert pixels.count() == 9 * 99 and pixels.filter("image_id = 'a_T10_movie_x.tif' AND z = 2").agg({"v": "sum"}).first()[0] == float(data[5].sum())
    movies = images.as_movies(planes).select("image_id", "path", "t").distinct().collect()
    assert {(r.image_id, r.path.rsplit("/", 1)[-1].split("_")[1]): r.t for r in movies} == {("movie_x", "T1"): 0, ("movie_x", "T2"): 1, ("movie_x", "T10"): 2}
    back = images.stack_files(planes).collect()
    assert len(back) == 3 and len(tiff.read_pages(back[0].content)) == 3


def test_data_source_reads_chosen_pages_and_writes(spark, tmp_path):
    datasource.register(spark)
    (tmp_path / "s.tif").write_bytes(tiff.write_stack(stack(), "slices=3\nchannels=2"))
    pages = spark.read.format("tiff_pages").load(str(tmp_path))
    assert pages.count() == 6 and pages.filter("c = 1 AND z IN (0, 2)").count() == 2
    chosen = spark.read.format("tiff_pages").option("only_c", "1").option("only_z", "0,2").load(str(tmp_path))
    assert sorted((r.z, r.c) for r in chosen.collect()) == [(0, 1), (2, 1)]
    pages.repartition("image_id").write.format("tiff_pages").mode("append").save(str(tmp_path / "out"))
    again = tiff.read_pages((tmp_path / "out" / "s.tif").read_bytes())
    assert (np.stack([p.array() for p in again]) == stack()).all()


def test_csv_columns_go_by_name(spark, tmp_path):
    (tmp_path / "one.csv").write_text("image,Vol_um,Roundness,day\nw1.tif,1.5,0.9,3\n")
    (tmp_path / "two.csv").write_text("image,Vol_um,Roundness,day\nw2.tif,bad,0.4,7\n")
    rows = tabular.read_csv(spark, str(tmp_path), "acinus").orderBy("filename").collect()
    assert [(r.filename, r.vol_um, r.roundness, r.day, r.well, r.source_file) for r in rows] == [("w1.tif", 1.5, 0.9, 3, None, "one"), ("w2.tif", None, 0.4, 7, None, "two")]
    tabular.write_csv(tabular.read_csv(spark, str(tmp_path), "acinus"), str(tmp_path / "out"))
    tabular.write_parquet(tabular.read_csv(spark, str(tmp_path), "acinus"), str(tmp_path / "pq"), ["day"])
    assert tabular.read_parquet(spark, str(tmp_path / "pq")).count() == 2


def test_a_failed_write_leaves_nothing(tmp_path):
    from types import SimpleNamespace

    row = lambda name: SimpleNamespace(image_id=name, t=0, z=0, c=0, dtype="|u1", height=1, width=2, samples=1, data=b"\1\2")
    writer = datasource.TiffWriter(str(tmp_path / "out"))
    with pytest.raises(ValueError, match="a.tif"):
        writer.commit([writer.write(iter([row("a.tif")])), writer.write(iter([row("x/a.tif"), row("b.tif")]))])
    assert not list((tmp_path / "out").iterdir())
    writer.commit([writer.write(iter([row("a.tif")])), None, writer.write(iter([row("b.tif")]))])
    assert sorted(p.name for p in (tmp_path / "out").iterdir()) == ["a.tif", "b.tif"]


def test_only_the_wanted_pages_are_read(tmp_path):
    big = np.random.default_rng(0).integers(0, 256, (40, 64, 64)).astype(np.uint8)
    (tmp_path / "big.tif").write_bytes(tiff.write_stack(big, "slices=10\nchannels=4", 0.5))
    whole = (tmp_path / "big.tif").stat().st_size
    with open(tmp_path / "big.tif", "rb") as file:
        data = tiff.Ranges(file)
        pages = tiff.read_pages(data)
        directories = data.bytes_read
        assert len(pages) == 40 and tiff.spacing(pages[0])[0] == 0.5 and directories < 40 * 200
        rows = list(datasource.Pages({"only_c": "1", "only_z": "2,3"}).rows(data, datasource.Share("big.tif")))
    assert [(r[3], r[4]) for r in rows] == [(2, 1), (3, 1)] and rows[1][-1] == big[13].tobytes()
    assert data.bytes_read - 2 * directories < whole * 2.1 / 40


def test_large_files_are_split_and_filtered_twice(spark, tmp_path):
    datasource.register(spark)
    (tmp_path / "s.tif").write_bytes(tiff.write_stack(stack(), "slices=3\nchannels=2"))
    load = spark.read.format("tiff_pages").option("split_bytes", "100")
    pages = load.load(str(tmp_path))
    assert pages.rdd.getNumPartitions() > 6 and sorted((r.z, r.c) for r in pages.collect()) == [(z, c) for z in range(3) for c in range(2)]
    both = pages.filter("c = 1").select("z", "c").union(pages.filter("z = 0").select("z", "c"))
    assert sorted(map(tuple, both.collect())) == [(0, 0), (0, 1), (0, 1), (1, 1), (2, 1)] and pages.count() == 6


def test_a_stream_of_files_reads_each_once_over_restarts(spark, tmp_path):
    datasource.register(spark)
    seen, out = tmp_path / "in", tmp_path / "out"
    seen.mkdir()

    def run():
        source = spark.readStream.format("tiff_pages").option("log", str(tmp_path / "log")).option("files_a_batch", "2").load(str(seen))
        query = source.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "state")).start(str(out))
        query.processAllAvailable()
        query.stop()
        return sorted(((r.image_id, r.z, r.flag) for r in spark.read.parquet(str(out)).collect()), key=str)

    pages = lambda name: [(name, z, "ok") for z in range(3)]
    for name in "abc":
        (seen / f"{name}.tif").write_bytes(tiff.write_stack(stack(np.uint8, (3, 4, 4)), "slices=3"))
    assert run() == pages("a.tif") + pages("b.tif") + pages("c.tif")
    (seen / "0.tif").write_bytes(tiff.write_stack(stack(np.uint8, (3, 4, 4)), "slices=3"))
    os.utime(seen / "0.tif", (1, 1))  # older than all the others, and first by name
    (seen / "d.tif").write_bytes(b"II*\0junk")
    failed = ("d.tif", None, "IMAGE FAILED")
    assert run() == sorted(pages("0.tif") + pages("a.tif") + pages("b.tif") + pages("c.tif") + [failed], key=str) == run()


def test_pixels_carry_the_sizes_of_their_plane_without_a_join(spark):
    made = [(f"f{k}", np.arange(6.0).reshape(2, 3) + k, 0.5 if k else None) for k in range(3)]
    rows = [{"image_id": n, "path": n, "t": 0, "z": z, "c": 0, "height": 2, "width": 3, "samples": 1, "dtype": "<f8", "data": bytearray((a * (z + 1)).tobytes()), "px_um": px, "py_um": px, "pz_um": 1.5, "tags": {}} for n, a, px in made for z in (1, 0)]
    stacks = images.stack_files(spark.createDataFrame(rows, images.PLANE), "spacing=1.5\n").selectExpr("image_id AS path", "image_id AS filename", "content")
    read, _ = images.planes(stacks)
    found = images.pixels(read, ("px_um", "pz_um"))
    assert {(r.image_id, r.z, r.y, r.x): (r.v, r.px_um, r.pz_um) for r in found.collect()} == {(n, z, y, x): (a[y, x] * (z + 1), px, 1.5) for n, a, px in made for z in (0, 1) for y in (0, 1) for x in (0, 1, 2)}
