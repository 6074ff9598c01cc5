import numpy as np
import pyspark.sql.functions as F
import pytest

from lumispark.functions import classify, numbers, palette
from lumispark.kernels import segmentation
from lumispark.operators import pixels, stats, tables, tracks


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


@pytest.mark.parametrize(
    "name, column, want",
    [
        ("well1_d10_soft", classify.day, 1), ("xd0d1", classify.day, 0), ("nothing", classify.day, 7), ("well1_x", classify.well, 1), ("", classify.well, 2), ("SOFTstiff", classify.condition, "soft"), ("", classify.condition, "blank"),
        ("abt_bleb", classify.image_treatment, "blebbistatin"), ("x_mmpi", classify.image_treatment, "batimastat"), ("d12_x", classify.cell_day, 12), ("d1_x", classify.cell_day, 1), ("none", classify.cell_day, None),
        ("well_3", classify.cell_type, "HER2"), ("WT", classify.cell_type, "WT"), ("we_ll4", classify.stiffness, "stiff"), ("d0badER-4OHT", classify.drug_treatment, "-4OHT"), ("badER", classify.drug_treatment, "+4OHT"), ("x737", classify.drug_treatment, "ABT737"), ("x", classify.drug_treatment, "None"),
        ("ECad_C3", classify.protein_set, "ECad_C3"), ("lampax", classify.protein_set, "Lam_Pax"), ("q", classify.protein_set, "other"), ("shContvsshXPO5_X.TIF", classify.death_treatment, "_X"), ("shcontvsshxpo5_x", classify.death_treatment, "_x"), ("other", classify.death_treatment, "Unknown"),
        ("shContvsshXPO5_X.TIF", classify.death_experiment, "shContvsshXPO5"), ("shcontvsshxpo5_x", classify.death_experiment, "Other"), ("abcdef", classify.experiment_id, "cdef"), ("A_B_movie_One", classify.movie_key, "movie_one"), ("img_T12_x", classify.natural_key, 12), ("img", classify.natural_key, None),
    ],
)
def test_names_are_classified_in_order(spark, name, column, want):
    assert frame(spark, [(name,)], "n string").select(column(F.col("n"))).first()[0] == want


def test_colour_class_of_missing_measurements_is_green(spark):
    rows = frame(spark, [(None, None, None), (1.0, 0.0, 16.0), (2.0, 1.0, 15.0), (1.0, 2.0, 0.0)], "r double, g double, y double")
    assert [r[0] for r in rows.select(classify.cycle_colour(F.col("r"), F.col("g"), F.col("y"))).collect()] == ["green", "yellow", "red", "green"]


def test_numbers(spark):
    row = frame(spark, [(200, 100)], "a int, b int").select(numbers.wrapped_sum(F.col("a"), F.col("b")), numbers.widened_sum(F.col("a"), F.col("b")), numbers.rescaled(F.lit(3.0), F.lit(2.0), F.lit(4.0)), numbers.rescaled(F.lit(3.0), F.lit(3.0), F.lit(3.0)), numbers.half_even(F.lit(2.5)), numbers.volume_radius(F.lit(4 / 3 * np.pi * 8)), numbers.number_after(F.lit("a spacing=2.5 loop"), "spacing")).first()
    assert list(row)[:5] == [44, 300, 127, None, 2.0] and row[5] == pytest.approx(2) and row[6] == 2.5
    tags = frame(spark, [({"ImageDescription": "x\nspacing=0.5\nloop"},), ({"IJMetadata": "nscales=1,2,3.5\n", "ImageDescription": "spacing=9"},), ({},)], "t map<string,string>")
    assert [r[0] for r in tags.select(numbers.spacing(F.col("t"))).collect()] == [0.5, 3.5, None]


def test_tables(spark):
    left, right = frame(spark, [(1, "a"), (2, None)], "k int, v string"), frame(spark, [(1, 2.0)], "k int, w double")
    assert tables.natural_join(left, right).collect()[0].asDict() == {"k": 1, "v": "a", "w": 2.0}
    with pytest.raises(ValueError):
        tables.natural_join(left, right.withColumnRenamed("k", "q"))
    assert tables.union_all(left, right).count() == 3
    assert {r.v: r.code for r in tables.factorize(left, "v", "code").collect()} == {"a": 0, None: None}
    assert left.filter(tables.differs(F.col("v"), "a")).count() == 1
    names = lambda *n: frame(spark, [(x,) for x in n], "path string").withColumn("key", tables.file_key(F.col("path")))
    assert tables.matched_once(names("a_X_y+_c_d"), names("b/q_x_YPLUS_e_f").withColumnRenamed("path", "other"), "key").first().key == "x_yplus"
    with pytest.raises(ValueError):
        tables.matched_once(names("a_x_y_c_d"), names("a_z_y_c_d").withColumnRenamed("path", "other"), "key")


def test_summaries(spark):
    wide = frame(spark, [("a", 1.0, None), ("a", 3.0, None), ("b", None, None)], "condition string, w1 double, w2 double")
    got = {r.condition: r for r in stats.error_bars(stats.iqr_summary(wide, "condition", ["w1", "w2"]), "pooled").collect()}
    assert (got["a"].mean_pooled, got["a"].q1_w1, got["a"].mean_w2, got["a"].below_pooled) == (2.0, 1.5, None, 0.5) and got["b"].mean_pooled is None and got["b"].above_pooled is None
    profile = stats.normalised_profile(frame(spark, [("f", 5.0, 1.0)], "k string, d double, v double"), "k", "d", "v")
    assert profile.count() == 0


def test_brightness_counts_missing_pixels_as_nothing(spark):
    rows = tracks.brightness(frame(spark, [(1, 4.0)] * 5 + [(2, float(v)) for v in range(30)], "label int, v double"), ["label"], "v", 20).collect()
    got = {r.label: r for r in rows}
    assert got[1].top_mean == 1.0 and got[2].top_mean == sum(range(10, 30)) / 20


def test_solids_equal_the_kernel(spark):
    mask = sum(((g - c) / s) ** 2 for g, c, s in zip(np.indices((20, 24, 30)), (10, 12, 15), (5, 8, 12))) <= 1
    rows = [("i", int(z), int(y), int(x), 1) for z, y, x in np.argwhere(mask)]
    got = pixels.solids(frame(spark, rows, "image_id string, z int, y int, x int, label int"), ["image_id"]).first()
    assert got.volume == mask.sum() and got.inertia == pytest.approx(segmentation.eigenvalues(mask).tolist()) and got.roundness == pytest.approx(segmentation.roundness(mask))
    one = pixels.solids(frame(spark, [("i", 1, 1, 1, 1)], "image_id string, z int, y int, x int, label int"), ["image_id"]).first()
    assert one.roundness is None


def test_objects(spark):
    rows = [("i", 0, x, 1 if x < 3 else 2 if x < 6 else 0) for x in range(8)]
    labelled = frame(spark, rows, "image_id string, y int, x int, label int")
    keys = ["image_id"]
    assert {r.label for r in pixels.largest_objects(labelled, keys).collect()} == {1, 2} and {r.label for r in pixels.largest_objects(labelled, keys, ties="first").collect()} == {1}
    assert {r.label for r in pixels.clear_border(labelled, keys, {"x": 8}).collect()} == {2}
    assert pixels.large_objects(labelled, keys, 4).count() == 0 and pixels.large_objects(labelled, keys, 3).count() == 6
    near = {r.label: (r["sum"], r.external, r.internal) for r in pixels.neighbours(labelled, keys, ["y", "x"]).collect()}
    assert near == {1: (1, 1, 1), 2: (1, 1, 1)}
    assert pixels.masked(labelled.withColumn("v", F.lit(5)), labelled.filter("label = 1"), ["image_id", "y", "x"], "v").agg(F.sum("v")).first()[0] == 15
    area = labelled.filter("label > 0").groupBy("image_id", "label").count()
    assert pixels.with_property(labelled, area, keys, "count").filter("count IS NULL").count() == 2
    fits, others = pixels.whole_channels(frame(spark, [("a", 6), ("b", 7), ("c", None)], "image_id string, slices int"), "slices", 3)
    assert fits.count() == 1 and others.count() == 2


def test_flat_images_have_a_threshold_of_their_value(spark):
    flat = frame(spark, [("i", 3.0)] * 5, "image_id string, v double")
    assert pixels.triangle(flat, ["image_id"], "v").first().threshold == 3.0 and pixels.otsu(flat, ["image_id"], "v").first().threshold == 3.0
    assert pixels.rescale_images(flat, ["image_id"], "v", "u").first().u is None


def test_palettes():
    assert len(palette.shades("#1E90FF", 5)) == 5 and palette.shades("#000000", 1) == [(0.0, 0.0, 0.0)]
    colours = palette.label_colours(20)
    assert colours[0] == (0.0, 0.0, 0.0, 0.0) and set(range(21)) <= set(colours) and colours == palette.label_colours(20)
    assert palette.wide_shades("#FF0000")[7] != palette.wide_shades("#FF0000")[0]


def test_means_do_not_depend_on_the_order_of_rows(spark):
    """A cut-off that a mean meets exactly is met in every order, also by numbers of very different sizes."""
    one = frame(spark, [("a", v) for v in (0.1, 0.2, 0.3, -0.3, -0.2, -0.1, 1e-9, 1e-9)] + [("b", 59.99), ("b", 60.01), ("c", None), ("d", float("nan")), ("d", 1.0), ("e", 1e300), ("e", 1e-300)] + [("f", v) for v in (0.1,) * 10] + [("g", -1e-20), ("g", 3.5)], "k string, v double").coalesce(1)
    for rows in (one.sort("v"), one.sort(F.desc("v")), one.sort(F.abs("v"))):
        got = {r.k: r.m for r in rows.coalesce(1).groupBy("k").agg(stats.mean("v").alias("m")).collect()}
        assert got["a"] == 2.5e-10 and got["b"] == 60 and got["c"] is None and np.isnan(got["d"]) and got["e"] == 5e299 and got["f"] == 0.1 and got["g"] == 1.75


def test_both_sides_of_a_key_come_from_one_join_in_parts_by_rows(spark, monkeypatch):
    monkeypatch.setattr(tables, "PART_ROWS", 50)
    left = spark.createDataFrame([(k if k else None, f"r{k}") for k in range(2000)], "key long, name string")
    right = spark.createDataFrame([(k,) for k in range(0, 3000, 3) for _ in range(3)] + [(None,)], "key long")
    found = tables.with_and_without(left, right, "key", "side", "in", "out")
    assert sorted((r.name, r.side) for r in found.collect()) == sorted((f"r{k}", "in" if k and k % 3 == 0 else "out") for k in range(2000))
    assert found.rdd.getNumPartitions() == 60 and "Broadcast" not in found._jdf.queryExecution().toString()
