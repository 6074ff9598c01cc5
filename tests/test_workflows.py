import numpy as np
import pyspark.sql.functions as F
import pytest

from lumispark.plans import recipes, workflows
from lumispark.sources import images, tiff


def planes_of(spark, tmp_path, stacks, note="", px=0.5, axes="tzc"):
    for name, stack in stacks.items():
        (tmp_path / name).write_bytes(tiff.write_stack(stack, note, px) if isinstance(stack, np.ndarray) else stack)
    return images.planes(images.files(spark, str(tmp_path)), axes)[0]


def ball(shape, centre, r):
    return sum((g - c) ** 2 for g, c in zip(np.indices(shape), centre)) <= r * r


def test_acinus_volume_and_failures(spark, tmp_path):
    one = ball((40, 160, 160), (20, 80, 80), 0) | (sum(((g - c) / s) ** 2 for g, c, s in zip(np.indices((40, 160, 160)), (20, 80, 80), (14, 56, 56))) <= 1)
    stack = np.zeros((40, 2, 160, 160), np.uint8)
    stack[:, 0][one], stack[:, 1][one] = 100, 90
    planes = planes_of(spark, tmp_path, {"well1_d3_soft.tif": stack.reshape(80, 160, 160), "bad_d0.tif": np.zeros((4, 8, 8), np.uint8)}, "slices=40\nchannels=2\nspacing=2.0")
    rows, status = workflows.acinus_metrics(planes, rule=recipes.AcinusRule(blur=1, holes=500, objects=500))
    got = rows.collect()
    assert len(got) == 1 and (got[0].well, got[0].day, got[0].condition, got[0].flag) == (1, 3, "soft", "None")
    assert got[0].vol_um == pytest.approx(4 / 3 * np.pi * 28**3, rel=0.1) and got[0].roundness > 0.9
    assert status.filter("flag = 'ok'").count() == 1


def test_dumbbell_is_split():
    two = ball((48, 48, 110), (24, 24, 26), 18) | ball((48, 48, 110), (24, 24, 84), 15)
    two[22:27, 22:27, 26:84] = True
    mask, flag = recipes.acinus_mask(two.astype(float) * 200, recipes.AcinusRule(blur=1.5, holes=100, objects=500))
    assert flag == "multiple_acini_split" and mask[24, 24, 26] and not mask[24, 24, 84]
    assert recipes.acinus_mask(np.zeros((9, 9, 9)))[1] == "No Area"
    assert recipes.channel_sum(np.array([200], np.uint8), np.array([100], np.uint8))[0] == 44
    assert recipes.channel_sum(np.array([200], np.uint8), np.array([100], np.uint8), "widen")[0] == 300


def test_nuclei_match_cells_and_neighbours(spark):
    rows = []
    for label, x0 in ((1, 0), (2, 6)):
        for z in range(6):
            for y in range(6):
                for x in range(6):
                    inner = 2 <= z < 4 and 2 <= y < 4 and 2 <= x < 4
                    rows.append(("img", z, y, x0 + x, label if inner else 0, label, "None", 0.25))
    voxels = spark.createDataFrame(rows, "image_id string, z int, y int, x int, nucleus int, cell int, flag string, px_um double")
    got = workflows.match_nuclei(voxels).orderBy("nucleus_label").collect()
    assert [(r.nucleus_label, r.cell_label, r["sum"], r.external, r.internal) for r in got] == [(1, 1, 1, 2, 0), (2, 2, 1, 2, 0)]
    assert got[0].nucleus_cell_volume_ratio == pytest.approx(8 / 216) and got[0].cell_volume_um == 216 and got[0].cell_roundness == pytest.approx(1)
    assert [r["sum"] for r in workflows.match_nuclei(voxels, compat=True).collect()] == [2, 2]
    summary = workflows.cell_analytics(workflows.match_nuclei(voxels).withColumnRenamed("image_id", "filename")).collect()
    assert [(r.number_of_cells, r.external_share) for r in summary] == [(2, 1.0)]


def test_cycle_tracks(spark, tmp_path):
    movie = np.full((6, 4, 90, 90), 10, np.uint8)
    for t in range(6):
        movie[t, 1][ball((90, 90), (30, 25 + 3 * t), 9)] = 200
        movie[t, 3][ball((90, 90), (60, 60 - 2 * t), 9)] = 180
    nuclei, status = workflows.segment_nuclei(planes_of(spark, tmp_path, {"m.tif": movie.reshape(24, 90, 90)}, "frames=6\nchannels=4"))
    assert status.filter("flag <> 'ok'").count() == 0
    rows = workflows.cycle_tracks(nuclei, 6).collect()
    assert len(rows) == 12 and len({r.particle for r in rows}) == 2
    assert {r.color for r in rows if r.y < 45} == {"red"} and {r.color for r in rows if r.y > 45} == {"green"} and all(r.is_measured for r in rows)


def test_linking_in_spark(spark):
    points = spark.createDataFrame([("a", f, float(f * 19), 0.0) for f in range(4)] + [("a", f, float(f * 21), 500.0) for f in range(3)], "movie_id string, frame int, x double, y double")
    rows = workflows.link_tracks(points).collect()
    assert len({r.particle for r in rows if r.y == 0}) == 1 and len({r.particle for r in rows if r.y == 500}) == 3


def test_death_curve_rules(spark):
    cells = {1: (3, 2), 2: (2, 2), 3: (None, 1), 4: (None, None)}
    rows = [("shContvsshXPO5_X", f, k, 1.0 if av is not None and f >= av else 0.0, 1.0 if pi is not None and f >= pi else 0.0) for k, (av, pi) in cells.items() for f in range(5)]
    rows += [("shContvsshXPO5_X", 0, 9, 1.0, 1.0)]
    brightness = spark.createDataFrame(rows, "identifier string, frame int, label int, mean_av double, mean_pi double")
    curve = workflows.quantify_death(brightness, 5).orderBy("frame").collect()
    assert [(r.number_av, r.number_pi, r.n_dead_distinct, r.number_of_long_tracks) for r in curve] == [(0, 0, 0, 4), (0, 1, 1, 4), (1, 2, 3, 4), (2, 2, 3, 4), (2, 2, 3, 4)]
    marked, means = workflows.death_by_treatment(workflows.quantify_death(brightness, 5))
    assert {(r.experiment, r.treatment) for r in marked.collect()} == {("shContvsshXPO5", "_X")} and means.count() == 5
    with pytest.raises(ValueError):
        workflows.quantify_death(brightness, metric="total")


def test_first_crossings_match_a_frame_loop(spark):
    rng = np.random.default_rng(4)
    rows = [(f"m{m}", f, k, float(rng.random()), float(rng.random())) for m in range(20) for k in range(6) for f in range(8) if rng.random() < 0.8]
    frame = spark.createDataFrame(rows, "identifier string, frame int, label int, mean_av double, mean_pi double")
    got = {(r.identifier, r.frame): (r.number_av, r.number_pi) for r in workflows.quantify_death(frame, 8, "mean", 0.8, 0.8, 60).collect()}
    for m in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == m]
        size = {k: sum(r[2] == k for r in own) for k in range(6)}
        av_cells, pi_cells = set(), set()
        for f in range(8):
            here = [r for r in own if r[1] == f and size[r[2]] > 8 * 60 / 100]
            av_cells |= {r[2] for r in here if r[3] >= 0.8}
            pi_cells |= {r[2] for r in here if r[4] >= 0.8 and r[2] not in av_cells and r[2] not in pi_cells}
            if any(n > 4.8 for n in size.values()):
                assert got[(m, f)] == (len(av_cells), len(pi_cells))


def test_radial_profile_brightfield_and_collagen(spark, tmp_path):
    plane = np.zeros((3, 120, 120), np.uint8)
    plane[0][ball((120, 120), (60, 60), 40)] = 90
    plane[1][ball((120, 120), (60, 60), 40)] = 90
    plane[2][ball((120, 120), (60, 60), 40) & ~ball((120, 120), (60, 60), 34)] = 200
    planes = planes_of(spark, tmp_path, {"well2_d1_stiff.tif": plane}, "channels=3")
    rule = recipes.AcinusRule(blur=3, holes=10, objects=100, measure="eccentricity", limit=0.0)
    mask, far, radius, _ = recipes.radial_distances(plane[0].astype(float), rule)
    assert mask.sum() == pytest.approx(np.pi * 43**2, rel=0.05) and radius == pytest.approx(np.sqrt(3 * mask.sum() / np.pi)) and far.max() == pytest.approx(43, abs=2)
    _, status = workflows.radial_profiles(planes, 0, 1, 2, solid=False)
    assert status.count() == 1
    field = np.full((160, 160), 200.0)
    field[ball((160, 160), (80, 80), 30)] = 80
    assert set(np.unique(recipes.brightfield(field, "intensity"))) <= {0, 1, 2}
    rgb = np.full((200, 200, 3), 230, np.uint8)
    y, x = np.indices((200, 200)) - 100.0
    tissue = np.hypot(y, x) < 90
    rgb[tissue] = (120 + 60 * np.sin(np.hypot(y, x)))[tissue][:, None].astype(np.uint8)
    rgb[np.hypot(y, x) < 30] = 235
    found = recipes.collagen(rgb)
    assert found["ring"].shape == (200, 200)


def test_curves_and_subsets(spark):
    profile = spark.createDataFrame([("f1", d / 10, float(d), "soft, d1") for d in range(11)] + [("f2", 0.5, 1.0, "soft, d1")], "filename string, rounded_distance double, bm_intensity double, image_type string")
    curve = workflows.profile_curves(profile).orderBy("position").collect()
    assert len(curve) == 10 and curve[0].smoothed is None and curve[-1].mean_relative == 1.0
    wells = spark.createDataFrame([("a", 1.0), ("b", 2.0)], "condition string, w double")
    assert {k: v.count() for k, v in workflows.condition_subsets(wells, {"x": ["a"], "y": ["a", "b"]}).items()} == {"x": 1, "y": 2}
    acini = spark.createDataFrame([("yapvinc_well1", 2.0, 0.5, 1, 3, "soft"), ("yapvinc_well1_b", 4.0, 0.7, 1, 3, "soft"), ("ilk_x", 1.0, 0.1, 2, 3, "soft")], "filename string, vol_um double, roundness double, well int, day int, condition string")
    got = workflows.acinus_summary(acini).collect()
    assert [(r.key, r.mean_vol_um, r.key_index) for r in got] == [("Yap_Vinc, well1", 3.0, 0)]
    pixels = spark.createDataFrame([("i", 0, 1, 5.0, 1.0)] * 3 + [("i", 0, 0, 9.0, 9.0)], "image_id string, frame int, label int, av double, pi double")
    assert workflows.cell_brightness(pixels, n_mean=20).select("area", "amount_av", F.round("mean_av", 2).alias("m")).collect()[0].asDict() == {"area": 3, "amount_av": 15.0, "m": 0.75}


def test_rows_and_status_share_one_pass(spark):
    from lumispark.plans.workflows import per_image
    from lumispark.sources.images import PLANE

    calls = spark.sparkContext.accumulator(0)

    def measure(part):
        calls.add(1)
        if part["image_id"].iloc[0] == "bad":
            raise ValueError("no")
        return [{"n": len(part), "share": None if part["image_id"].iloc[0] == "b" else 0.5}]

    rows = [(k, k, 0, z, 0, 1, 1, 1, "|u1", bytearray(b"\1"), None, None, None, None) for k in ("a", "b", "bad") for z in (0, 1)]
    found, status = per_image(spark.createDataFrame(rows, PLANE), measure, "n int, share double")
    assert {(r.image_id, r.n, r.share) for r in found.collect()} == {("a", 2, 0.5), ("b", 2, None)}
    assert {(r.image_id, r.flag) for r in status.collect()} == {("a", "ok"), ("b", "ok"), ("bad", "IMAGE FAILED")}
    assert calls.value == 3
