"""Queries on names, files, streams and the tables of whole workflows."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumispark.functions import classify, palette
from lumispark.functions.numbers import area_radius, spacing, volume_radius, whole_steps
from lumispark.operators import pixels as ops
from lumispark.operators import stats, tables
from lumispark.plans import workflows
from lumispark.queries.measurements import _NAMES, _name_table, rounded
from lumispark.queries.standins import PIXELS, TRACKS, pixels, table
from lumispark.sources import datasource, images, tabular
from lumispark.streaming import crossings
from lumispark.streaming.runs import shared_path, table_stream, to_end

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(function):
        QUERIES[name] = function
        if sql:
            ORACLES[name] = sql
        return function

    return add


@query("q56_group_mean", "SELECT o_orderkey, round_even(o_totalprice - avg(o_totalprice) OVER (PARTITION BY o_custkey) + 1e-6::DOUBLE, 4) AS from_mean FROM orders")
def q56(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    marked = stats.with_group(orders, ["o_custkey"], mean=F.avg("o_totalprice"))
    return marked.select("o_orderkey", F.bround(F.col("o_totalprice") - F.col("mean") + F.lit(1e-6), 4).alias("from_mean"))


@query("q57_null_differs", "SELECT o_orderkey, status FROM (SELECT o_orderkey, CASE WHEN o_orderpriority <> '5-LOW' THEN o_orderstatus END AS status FROM orders) WHERE status IS DISTINCT FROM 'F'")
def q57(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.when(F.col("o_orderpriority") != "5-LOW", F.col("o_orderstatus"))
    return table(spark, sf_dir, "orders").select("o_orderkey", status.alias("status")).filter(tables.differs(F.col("status"), "F"))


@query(
    "q58_matched_files",
    """WITH n AS (SELECT replace(p_name, ' ', '_') AS name, p_partkey AS k FROM part)
    SELECT lower(name) || '_' || k || '_plus4oht' AS key, 'raw/Exp_' || name || '_' || k || '_+4oht_z1_c1.tif' AS image, 'D:\\seg\\run2_' || upper(name) || '_' || k || '_plus4OHT_seg_c2.tif' AS binary_image FROM n""",
)
def q58(spark: SparkSession, sf_dir: str) -> DataFrame:
    name, number = F.replace("p_name", F.lit(" "), F.lit("_")), F.col("p_partkey").cast("string")
    part = table(spark, sf_dir, "part")
    raw = part.select(F.concat(F.lit("raw/Exp_"), name, F.lit("_"), number, F.lit("_+4oht_z1_c1.tif")).alias("image"))
    binary = part.select(F.concat(F.lit("D:\\seg\\run2_"), F.upper(name), F.lit("_"), number, F.lit("_plus4OHT_seg_c2.tif")).alias("binary_image"))
    return tables.matched_once(raw.withColumn("key", tables.file_key(F.col("image"))), binary.withColumn("key", tables.file_key(F.col("binary_image"))), "key")


@query(
    "q59_whole_channels",
    "SELECT l_orderkey, count(*) AS slices, CASE WHEN count(*) % 3 = 0 THEN 'whole' ELSE 'other' END AS kind FROM lineitem GROUP BY 1",
)
def q59(spark: SparkSession, sf_dir: str) -> DataFrame:
    stacks = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("slices"))
    whole, other = ops.whole_channels(stacks, "slices", 3)
    return whole.withColumn("kind", F.lit("whole")).unionByName(other.withColumn("kind", F.lit("other")))


@query(
    "q60_plot_labels",
    f"""WITH {_NAMES}, l AS (SELECT name, lower(name) AS w FROM names), c AS (SELECT name, w, CASE WHEN contains(w, 'soft') THEN 'blue' WHEN contains(w, 'stiff') THEN 'red' ELSE 'grey' END AS by_condition, CASE WHEN contains(w, 'd0') THEN 'light' WHEN contains(w, 'd1') THEN 'medium' WHEN contains(w, 'd3') THEN 'dark' ELSE 'black' END AS by_day FROM l)
    SELECT name, by_condition, by_day, array_to_string(list_transform(string_split(w, ' '), lambda t: upper(t[1]) || t[2:]), ' ') AS title FROM c""",
)
def q60(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.col("name")
    by_condition, by_day = classify.axis_colour(classify.condition(name), classify.day(name))
    return _name_table(spark, sf_dir).select("name", by_condition.alias("by_condition"), by_day.alias("by_day"), classify.title_case(name).alias("title"))


@query(
    "q61_radii",
    "SELECT p_partkey, round_even(cbrt(3.0::DOUBLE * p_size / (4 * pi())), 6) AS ball, round_even(sqrt(p_size / pi()), 6) AS disc, CAST(ceil(cbrt(3.0::DOUBLE * p_size / (4 * pi()))) AS BIGINT) AS steps FROM part",
)
def q61(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = F.col("p_size").cast("double")
    return rounded(table(spark, sf_dir, "part").select("p_partkey", volume_radius(size).alias("ball"), area_radius(size, "disc").alias("disc"), whole_steps(volume_radius(size)).alias("steps")))


_TURNED = "CASE WHEN {t} < 1.0 / 6 THEN m1 + (m2 - m1) * {t} * 6 WHEN {t} < 0.5 THEN m2 WHEN {t} < 2.0 / 3 THEN m1 + (m2 - m1) * (2.0::DOUBLE / 3 - {t}) * 6 ELSE m1 END"


@query(
    "q62_shades",
    f"""WITH b AS (SELECT base, CAST('0x' || base[2:3] AS INT) / 255.0::DOUBLE AS r, CAST('0x' || base[4:5] AS INT) / 255.0::DOUBLE AS g, CAST('0x' || base[6:7] AS INT) / 255.0::DOUBLE AS b FROM (VALUES {", ".join(f"('{c}')" for c in palette.LABEL_BASES)}) AS v(base)),
    h AS (SELECT *, greatest(r, g, b) AS hi, least(r, g, b) AS lo, (hi + lo) / 2 AS l, (hi - lo) / CASE WHEN l <= 0.5 THEN hi + lo ELSE 2 - hi - lo END AS s, CASE hi WHEN r THEN (g - b) / (hi - lo) WHEN g THEN 2 + (b - r) / (hi - lo) ELSE 4 + (r - g) / (hi - lo) END / 6 AS h0, h0 - floor(h0) AS hue FROM b),
    k AS (SELECT base, CAST(k AS INT) AS step, hue, s, least(1, greatest(0, l * (0.7::DOUBLE + k * 0.15::DOUBLE))) AS l FROM h, (SELECT unnest(range(5)) AS k)),
    m AS (SELECT *, CASE WHEN l <= 0.5 THEN l * (1 + s) ELSE l + s - l * s END AS m2, 2 * l - m2 AS m1, (hue + 1.0::DOUBLE / 3) - floor(hue + 1.0::DOUBLE / 3) AS tr, (hue - 1.0::DOUBLE / 3) - floor(hue - 1.0::DOUBLE / 3) AS tb FROM k)
    SELECT base, step, round_even({_TURNED.format(t="tr")}, 4) AS r, round_even({_TURNED.format(t="hue")}, 4) AS g, round_even({_TURNED.format(t="tb")}, 4) AS b FROM m""",
)
def q62(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = [(base, step, *map(float, colour)) for base in palette.LABEL_BASES for step, colour in enumerate(palette.shades(base, 5))]
    shades = spark.createDataFrame(rows, "base string, step int, r double, g double, b double")
    return shades.select("base", "step", *(F.bround(c, 4).alias(c) for c in "rgb"))


def _cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as nuclei in cells, named after their supplier."""
    items = table(spark, sf_dir, "lineitem")
    kind = F.when(F.col("l_suppkey") % 4 == 0, "BadER_ECad_C3_-4oht").when(F.col("l_suppkey") % 4 == 1, "YAP_Vinc_737").when(F.col("l_suppkey") % 4 == 2, "Ilk").otherwise("Lam_Pax")
    return items.select(
        F.concat(kind, F.lit("_"), F.col("l_suppkey").cast("string"), F.lit(".tif")).alias("filename"), F.col("l_orderkey").alias("cell_label"), (F.col("l_discount") * 10).alias("nucleus_cell_volume_ratio"), F.col("l_quantity").alias("nucleus_volume_um"),
        (F.col("l_quantity") * 200).alias("cell_volume_um"), F.col("l_tax").alias("cell_roundness"), F.col("l_discount").alias("nucleus_roundness"), F.col("l_linenumber").alias("sum"), (F.col("l_suppkey") % 7).alias("external"), (F.col("l_suppkey") % 5).alias("internal"),
    )


@query(
    "q63_cell_analytics",
    """WITH c AS (SELECT CASE l_suppkey % 4 WHEN 0 THEN 'BadER_ECad_C3_-4oht' WHEN 1 THEN 'YAP_Vinc_737' WHEN 2 THEN 'Ilk' ELSE 'Lam_Pax' END || '_' || l_suppkey || '.tif' AS filename, CASE l_suppkey % 4 WHEN 0 THEN 'ECad_C3' WHEN 1 THEN 'Yap_Vinc' WHEN 2 THEN 'Ilk' ELSE 'Lam_Pax' END AS protein_set,
      CASE l_suppkey % 4 WHEN 0 THEN '-4OHT' WHEN 1 THEN 'ABT737' ELSE 'None' END AS treatment, CASE WHEN l_suppkey % 4 = 0 THEN 'BadER' ELSE 'WT' END AS cell_line, l_orderkey AS cell, l_discount * 10 AS ratio, l_quantity AS nv, l_quantity * 200 AS cv, l_tax AS cr, l_discount AS nr, l_linenumber AS s, l_suppkey % 7 AS external, l_suppkey % 5 AS internal FROM lineitem),
    o AS (SELECT *, count(*) OVER (PARTITION BY filename) AS number_of_cells FROM c WHERE protein_set <> 'Ilk'), f AS (SELECT *, count(*) OVER (PARTITION BY filename, cell) AS nuclei FROM o WHERE ratio < 0.95 AND cv < 4.0 / 3 * pi() * 13 ^ 3)
    SELECT filename, protein_set, treatment, cell_line, external, internal, any_value(number_of_cells) AS number_of_cells, round_even(avg(ratio), 6) AS mean_nucleus_cell_volume_ratio, round_even(avg(nv), 6) AS mean_nucleus_volume_um, round_even(avg(cv), 6) AS mean_cell_volume_um, round_even(avg(cr), 6) AS mean_cell_roundness, round_even(avg(nr), 6) AS mean_nucleus_roundness, round_even(avg(s), 6) AS mean_sum,
    round_even(external / nullif(external + internal, 0), 6) AS external_share, round_even(internal / nullif(external + internal, 0), 6) AS internal_share, cell_line || ', ' || protein_set || ', ' || treatment AS key FROM f WHERE nuclei = 1 GROUP BY ALL""",
)
def q63(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(workflows.cell_analytics(_cells(spark, sf_dir)))


@query(
    "q64_acinus_summary",
    """WITH a AS (SELECT CASE p_size % 3 WHEN 0 THEN 'Ilk' WHEN 1 THEN 'Lam_Pax' ELSE 'other' END AS protein_set, CASE WHEN p_partkey % 2 = 0 THEN 1 ELSE 2 END AS well, CASE WHEN p_partkey % 5 = 0 THEN 3 ELSE 7 END AS day, CASE WHEN p_size % 4 = 0 THEN 'soft' ELSE 'blank' END AS condition, p_retailprice AS vol_um, p_size / 50.0::DOUBLE AS roundness FROM part),
    k AS (SELECT protein_set || ', well' || well AS key, protein_set, well, day, condition, avg(vol_um) AS mean_vol_um, avg(roundness) AS mean_roundness FROM a GROUP BY ALL HAVING key <> 'Lam_Pax, well1' AND protein_set <> 'Ilk')
    SELECT key, protein_set, well, day, condition, round_even(mean_vol_um, 6) AS mean_vol_um, round_even(mean_roundness, 6) AS mean_roundness, CAST(dense_rank() OVER (ORDER BY key) - 1 AS INT) AS key_index FROM k""",
)
def q64(spark: SparkSession, sf_dir: str) -> DataFrame:
    size, key = F.col("p_size"), F.col("p_partkey")
    name = F.concat(F.when(size % 3 == 0, "ilk").when(size % 3 == 1, "lam_pax").otherwise("other"), F.when(key % 2 == 0, "_well1").otherwise("_x"), F.when(key % 5 == 0, "_d3").otherwise("_x"), F.when(size % 4 == 0, "_soft").otherwise("_x"), F.lit(".tif"))
    acini = table(spark, sf_dir, "part").select(name.alias("filename"), F.col("p_retailprice").alias("vol_um"), (size / 50.0).alias("roundness"))
    return rounded(workflows.acinus_summary(acini.withColumns(classify.image_details(F.col("filename")))))


@query("q65_spacing_tags", """SELECT event_id, CASE event_id % 4 WHEN 0 THEN 2.5 WHEN 1 THEN round_even(value, 2) WHEN 2 THEN round_even(value, 2) END::DOUBLE AS z FROM events""")
def q65(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind, text = F.col("event_id") % 4, F.bround("value", 2).cast("string")
    scales = F.when(kind == 0, "unit=um\nnscales=1,1,2.5\nunit=um").when(kind == 1, "nscales=1,7").otherwise("none")
    note = F.when(kind == 3, "loop=false").otherwise(F.concat(F.lit("unit=um\nspacing="), text, F.lit("\nloop=false")))
    tags = F.create_map(F.lit("IJMetadata"), scales, F.lit("ImageDescription"), note)
    return table(spark, sf_dir, "events").select("event_id", spacing(tags).alias("z"))


@query(
    "q66_movie_frames",
    """WITH n AS (SELECT p_partkey, p_brand || '_x_T' || (p_partkey % 40) || '_' || p_type || '_' || p_size || '.tif' AS name FROM part), k AS (SELECT DISTINCT 'lab/' || p_partkey % 3 || '/' || name AS path, name, array_to_string(string_split(lower(regexp_replace(name, '\\.tif$', '')), '_')[3:], '_') AS image_id, CAST(regexp_extract(name, 'T(\\d+)', 1) AS INT) AS t FROM n)
    SELECT image_id, path, CAST(row_number() OVER (PARTITION BY image_id ORDER BY t, name, path) - 1 AS INT) AS t FROM k""",
)
def q66(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.concat("p_brand", F.lit("_x_T"), (F.col("p_partkey") % 40).cast("string"), F.lit("_"), "p_type", F.lit("_"), F.col("p_size").cast("string"), F.lit(".tif"))
    path = F.concat(F.lit("lab/"), (F.col("p_partkey") % 3).cast("string"), F.lit("/"), name)
    planes = table(spark, sf_dir, "part").select(F.lit("file").alias("image_id"), path.alias("path"), F.lit(0).alias("t")).distinct()
    return images.as_movies(planes)


@query("q67_tiff_round_trip", f"WITH {PIXELS} SELECT CAST(image_id AS VARCHAR) || '.tif' AS image_id, z, 1 AS c, y, x, CASE z WHEN 0 THEN v ELSE v * 2 END AS v, 0.5::DOUBLE AS px_um, 1.5::DOUBLE AS pz_um FROM pix, (SELECT unnest([0, 1]) AS z)")
def q67(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Images written as multi-page files of two slices and two channels, then one channel read back."""
    pix = pixels(spark, sf_dir)
    rows = pix.groupBy("image_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("y", "x", "v"))), lambda p: p["v"]).alias("values"))

    def planes(batches):
        for batch in batches:
            out = [(f"{r.image_id}.tif", "", 0, z, c, 8, 8, 1, "<f8", (np.asarray(r.values) * (1 + z) * (1 if c else -1)).tobytes(), 0.5, 0.5, 1.5, {}) for r in batch.itertuples() for z in (0, 1) for c in (0, 1)]
            yield type(batch)(out, columns=[f.split(" ")[0] for f in images.PLANE.split(", ")])

    written = images.stack_files(rows.mapInPandas(planes, images.PLANE), "spacing=1.5\n")
    found = written.select(F.col("image_id").alias("path"), F.col("image_id").alias("filename"), "content")
    read, _ = images.planes(found, only={"c": {1}})
    return images.pixels(read, ("px_um", "pz_um")).select("image_id", "z", "c", "y", "x", "v", "px_um", "pz_um")


@query("q68_csv_round_trip", "SELECT 'supplier ' || l_suppkey AS identifier, l_linenumber AS frame, CAST(l_orderkey AS INT) AS label, CAST(l_partkey AS BIGINT) AS area, l_quantity AS amount_av, l_extendedprice AS amount_pi, l_discount AS mean_av, CASE WHEN l_returnflag <> 'N' THEN l_tax END AS mean_pi FROM lineitem")
def q68(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = {"Identifier": F.concat(F.lit("supplier "), F.col("l_suppkey").cast("string")), "Frame": F.col("l_linenumber"), "LABEL": F.col("l_orderkey"), "area": F.col("l_partkey"), "amount_av": F.col("l_quantity"), "amount_pi": F.col("l_extendedprice"), "mean_av": F.col("l_discount"), "mean_pi": F.when(F.col("l_returnflag") != "N", F.col("l_tax"))}
    path = shared_path(spark, "brightness-csv")
    tabular.write_csv(table(spark, sf_dir, "lineitem").select(*(c.alias(n) for n, c in columns.items())), path)
    return tabular.read_csv(spark, path, "cell_brightness").drop("source_file")


@query(
    "q69_stream_windows",
    f"""WITH w AS (SELECT event_type, time_bucket(INTERVAL '1 day', ts, TIMESTAMP '1970-01-01') AS start, count(*) AS n, round_even(avg(value), 6) AS mean, max(value) AS top FROM events GROUP BY ALL)
    SELECT CAST(date_diff('day', DATE '1970-01-01', CAST(start AS DATE)) AS INT) AS day, event_type, n, mean, top FROM w WHERE start + INTERVAL '1 day' <= (SELECT date_trunc('milliseconds', max(ts)) - INTERVAL '2 hours' FROM events)""",
)
def q69(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days that are closed once all events are read; the last one still waits for late rows."""
    events = table_stream(spark, f"{sf_dir}/events.parquet").select("event_type", F.col("ts").cast("timestamp").alias("ts"), "value")
    closed = to_end(crossings.windowed_brightness(events, "ts", "value", ["event_type"], "1 day", "2 hours"), "windows")
    return rounded(closed.select(F.datediff(F.to_date("window.start"), F.lit("1970-01-01").cast("date")).alias("day"), "event_type", "n", "mean", "top"))


@query(
    "q70_stream_crossings",
    f"""WITH {TRACKS}, e AS (SELECT label, min(CASE WHEN event_type = 'purchase' AND value >= 100 THEN event_id END) AS a, min(CASE WHEN event_type = 'error' AND value >= 60 THEN event_id END) AS p FROM trk GROUP BY 1)
    SELECT label, CAST(a AS INT) AS frame, 'av' AS stain FROM e WHERE a IS NOT NULL UNION ALL SELECT label, CAST(p AS INT), 'pi' FROM e WHERE p IS NOT NULL AND (a IS NULL OR p < a)""",
)
def q70(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table_stream(spark, f"{sf_dir}/events.parquet")
    cells = events.select(F.col("user_id").alias("label"), F.col("event_id").cast("int").alias("frame"), F.when(F.col("event_type") == "purchase", F.col("value")).alias("mean_av"), F.when(F.col("event_type") == "error", F.col("value")).alias("mean_pi"))
    return to_end(crossings.crossing_events(cells, 100, 60, ("label",)), "crossings")


@query("q74_tiff_stream", f"WITH {PIXELS}, f AS (SELECT vec_id, 'movie ' || vec_id // 50 || '.tif' AS image_id, CAST(row_number() OVER (PARTITION BY vec_id // 50 ORDER BY vec_id) - 1 AS INT) AS t FROM embeddings) SELECT f.image_id, t, y, x, v FROM pix JOIN f ON f.vec_id = pix.image_id")
def q74(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Images written as movies of up to 50 frames by the TIFF writer, and the folder streamed to its end."""
    values = F.transform(F.array_sort(F.collect_list(F.struct("y", "x", "v"))), lambda p: p["v"])
    frames = pixels(spark, sf_dir).groupBy("image_id").agg(values.alias("values"))
    columns = ["image_id", "path", "t", "z", "c", "height", "width", "samples", "dtype", "data"]

    def planes(batches):
        for batch in batches:
            yield type(batch)([(f"movie {r.image_id // 50}.tif", "", r.image_id % 50, 0, 0, 8, 8, 1, "<f8", np.asarray(r.values).tobytes()) for r in batch.itertuples()], columns=columns)

    datasource.register(spark)
    path = shared_path(spark, "movies")
    frames.mapInPandas(planes, datasource.SCHEMA).repartition("image_id").write.format("tiff_pages").mode("append").save(path)
    stream = spark.readStream.format("tiff_pages").option("log", f"{path}-log").load(path)
    found = to_end(stream, "planes").filter("flag = 'ok'")
    return images.pixels(found).select("image_id", "t", "y", "x", "v")
