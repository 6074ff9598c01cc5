"""Queries on measurement and track tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lumispark.functions import classify
from lumispark.functions.numbers import number_after, sphere_volume
from lumispark.operators.selection import percentiles
from lumispark.operators import stats, tables
from lumispark.operators import tracks as tracking
from lumispark.queries.standins import TRACKS, table, tracks

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(function):
        QUERIES[name] = function
        if sql:
            ORACLES[name] = sql
        return function

    return add


def six(column: str | Column) -> Column:
    return F.bround(F.col(column) if isinstance(column, str) else column, 6)


def rounded(df: DataFrame) -> DataFrame:
    """All doubles to 6 places, since sums in another order differ in their last bits."""
    return df.select(*(six(c).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


AV, PI = "CASE WHEN event_type = 'purchase' THEN value END", "CASE WHEN event_type = 'error' THEN value END"


@query("q01_long_tracks", f"WITH {TRACKS}, c AS (SELECT *, count(*) OVER (PARTITION BY label) AS n FROM trk) SELECT event_id, label, frame FROM c WHERE n > 30 * 200 / 100.0")
def q01(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tracking.long_tracks(tracks(spark, sf_dir), ["label"], 30, 200).select("event_id", "label", "frame")


@query(
    "q02_death_curve",
    f"""WITH {TRACKS}, p AS (SELECT label, frame, {AV} AS av, {PI} AS pi, count(*) OVER (PARTITION BY label) AS n FROM trk),
    e AS (SELECT label, min(CASE WHEN av >= 100 THEN frame END) AS a, min(CASE WHEN pi >= 60 THEN frame END) AS b FROM p WHERE n > 15 GROUP BY label),
    d AS (SELECT label, a, CASE WHEN a IS NULL OR b < a THEN b END AS p FROM e), t AS (SELECT count(*) AS n FROM d),
    f AS (SELECT CAST(range AS INT) AS frame FROM range(30)),
    c AS (SELECT f.frame, count(*) FILTER (a <= f.frame) AS number_av, count(*) FILTER (p <= f.frame) AS number_pi, count(*) FILTER (least(a, p) <= f.frame) AS n_dead_distinct FROM f, d GROUP BY f.frame)
    SELECT 'all' AS identifier, c.*, t.n AS number_of_long_tracks, round_even(100.0 * number_av / n, 6) AS pct_av, round_even(100.0 * number_pi / n, 6) AS pct_pi, round_even(100.0 * (number_av + number_pi) / n, 6) AS pct_total FROM c, t""",
)
def q02(spark: SparkSession, sf_dir: str) -> DataFrame:
    props = tracks(spark, sf_dir).withColumn("identifier", F.lit("all"))
    return rounded(tracking.death_curve(props, 30, 50, F.expr(AV), F.expr(PI), 100, 60, ["identifier"]))


@query(
    "q03_mean_sd",
    f"""WITH {TRACKS} SELECT c_mktsegment AS treatment, frame, round_even(avg(value), 6) AS mean, round_even(stddev_samp(value), 6) AS sd, count(value) AS n
    FROM trk JOIN customer ON label = c_custkey GROUP BY ALL""",
)
def q03(spark: SparkSession, sf_dir: str) -> DataFrame:
    treated = tracks(spark, sf_dir).join(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("label"), F.col("c_mktsegment").alias("treatment")), "label")
    return rounded(stats.mean_sd(treated, ["treatment", "frame"], "value"))


@query(
    "q04_brightness",
    f"""WITH {TRACKS}, r AS (SELECT *, row_number() OVER (PARTITION BY label, frame ORDER BY value DESC) AS k FROM trk)
    SELECT label, frame, count(*) AS area, round_even(sum(value), 6) AS amount, round_even(avg(value), 6) AS mean, round_even(coalesce(sum(value) FILTER (k <= 3), 0) / 3, 6) AS top_mean FROM r GROUP BY label, frame""",
)
def q04(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(tracking.brightness(tracks(spark, sf_dir), ["label", "frame"], "value", 3))


@query(
    "q05_positive_labels",
    f"""WITH {TRACKS}, g AS (SELECT label, frame, avg(value) AS m FROM trk GROUP BY ALL HAVING m >= 60)
    SELECT event_id, label, frame, CASE WHEN g.m IS NULL THEN 0 ELSE label END AS positive FROM trk LEFT JOIN g USING (label, frame)""",
)
def q05(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = tracks(spark, sf_dir).select("event_id", "label", "frame", "value")
    props = points.groupBy("label", "frame").agg(stats.mean("value").alias("mean"))
    return tracking.positive_labels(points.drop("value"), props, ["label", "frame"], "mean", 60)


@query(
    "q06_profile",
    """WITH b AS (SELECT l_suppkey AS k, l_returnflag AS g, CAST(p_size AS DOUBLE) AS d, l_quantity AS v FROM lineitem JOIN part ON l_partkey = p_partkey),
    s AS (SELECT *, round_even((d - min(d) OVER w) / nullif(max(d) OVER w - min(d) OVER w, 0), 2) AS position FROM b WINDOW w AS (PARTITION BY k)),
    n AS (SELECT *, v / max(v) OVER (PARTITION BY k) AS relative FROM s WHERE position < 0.99),
    m AS (SELECT g, position, avg(relative) AS mean_relative FROM n GROUP BY ALL)
    SELECT g AS image_type, position, round_even(mean_relative, 6) AS mean_relative, round_even(CASE WHEN count(mean_relative) OVER r = 2 THEN avg(mean_relative) OVER r END, 6) AS smoothed
    FROM m WINDOW r AS (PARTITION BY g ORDER BY position ROWS BETWEEN 1 PRECEDING AND CURRENT ROW)""",
)
def q06(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part").select("p_partkey", F.col("p_size").cast("double").alias("distance"))
    items = table(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey", F.col("l_returnflag").alias("image_type"), "l_quantity")
    joined = items.join(part, F.col("l_partkey") == F.col("p_partkey"))
    return rounded(stats.mean_profile(stats.normalised_profile(joined, "l_suppkey", "distance", "l_quantity"), "image_type"))


@query(
    "q07_rolling_mean",
    f"""WITH {TRACKS}, d AS (SELECT event_type, frame, avg(value) AS m FROM trk GROUP BY ALL)
    SELECT event_type, frame, round_even(m, 6) AS m, round_even(CASE WHEN count(m) OVER w = 2 THEN avg(m) OVER w END, 6) AS smoothed
    FROM d WINDOW w AS (PARTITION BY event_type ORDER BY frame ROWS BETWEEN 1 PRECEDING AND CURRENT ROW)""",
)
def q07(spark: SparkSession, sf_dir: str) -> DataFrame:
    daily = tracks(spark, sf_dir).groupBy("event_type", "frame").agg(stats.mean("value").alias("m"))
    return rounded(stats.rolling_mean(daily, ["event_type"], "frame", "m", 2, "smoothed"))


@query(
    "q08_natural_joins",
    """SELECT s_nationkey, p_brand, count(*) AS n, round_even(avg(l_quantity / p_size), 6) AS mean_ratio, round_even(max(least(l_discount, l_tax) / nullif(greatest(l_discount, l_tax), 0)), 6) AS max_roundness
    FROM lineitem JOIN part ON p_partkey = l_partkey JOIN supplier ON s_suppkey = l_suppkey GROUP BY ALL""",
)
def q08(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("nucleus"), F.col("l_suppkey").alias("cell"), "l_quantity", "l_discount", "l_tax")
    nuclei = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("nucleus"), "p_brand", "p_size")
    cells = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("cell"), "s_nationkey")
    matched = tables.natural_join(tables.natural_join(items, cells), nuclei)
    low, high = F.least("l_discount", "l_tax"), F.greatest("l_discount", "l_tax")
    out = matched.groupBy("s_nationkey", "p_brand").agg(
        F.count(F.lit(1)).alias("n"), stats.mean(F.try_divide("l_quantity", F.col("p_size"))).alias("mean_ratio"), F.max(F.try_divide(low, high)).alias("max_roundness")
    )
    return rounded(out)


_WELLS = {"w1": "l_quantity", "w2": "l_discount", "w3": "CASE WHEN l_returnflag <> 'N' THEN l_tax END"}


@query(
    "q09_iqr_summary",
    "WITH w AS (SELECT l_returnflag AS condition, l_quantity AS w1, l_discount AS w2, CASE WHEN l_returnflag <> 'N' THEN l_tax END AS w3 FROM lineitem), u AS (SELECT condition, unnest([w1, w2, w3]) AS v FROM w), p AS (SELECT condition, round_even(avg(v), 6) AS mean_pooled, round_even(quantile_cont(v, 0.25), 6) AS q1_pooled, round_even(quantile_cont(v, 0.75), 6) AS q3_pooled, avg(v) AS m, quantile_cont(v, 0.25) AS a, quantile_cont(v, 0.75) AS b FROM u GROUP BY condition) SELECT w.condition, "
    + ", ".join(f"round_even(avg({w}), 6) AS mean_{w}, round_even(quantile_cont({w}, 0.25), 6) AS q1_{w}, round_even(quantile_cont({w}, 0.75), 6) AS q3_{w}" for w in _WELLS)
    + ", any_value(mean_pooled) AS mean_pooled, any_value(q1_pooled) AS q1_pooled, any_value(q3_pooled) AS q3_pooled, round_even(greatest(any_value(m - a), 0.0), 6) AS below_pooled, round_even(greatest(any_value(b - m), 0.0), 6) AS above_pooled FROM w JOIN p ON w.condition = p.condition GROUP BY w.condition",
)
def q09(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide = table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("condition"), *(F.expr(e).alias(w) for w, e in _WELLS.items()))
    return rounded(stats.error_bars(stats.iqr_summary(wide, "condition", list(_WELLS)), "pooled"))


@query(
    "q10_percentiles",
    """SELECT o_orderpriority, round_even(quantile_cont(o_totalprice, 0.1), 6) AS p10, round_even(quantile_cont(o_totalprice, 0.5), 6) AS p50, round_even(quantile_cont(o_totalprice, 0.95), 6) AS p95,
    round_even(quantile_cont(CASE WHEN o_orderpriority <> '5-LOW' THEN o_totalprice END, 0.25), 6) AS safe FROM orders GROUP BY 1""",
)
def q10(spark: SparkSession, sf_dir: str) -> DataFrame:
    price = F.col("o_totalprice")
    some = F.when(F.col("o_orderpriority") != "5-LOW", price)
    orders = table(spark, sf_dir, "orders").select("o_orderpriority", price.cast("double").alias("price"), some.cast("double").alias("some"))
    out = percentiles(orders, ["o_orderpriority"], "price", {f"p{q}": q / 100 for q in (10, 50, 95)})
    return rounded(out.join(percentiles(orders, ["o_orderpriority"], "some", {"safe": 0.25}), "o_orderpriority", "left"))


@query(
    "q11_single_nucleus",
    """WITH f AS (SELECT *, count(*) OVER (PARTITION BY l_orderkey, l_linenumber) AS nuclei FROM lineitem WHERE l_discount < 0.95 AND l_quantity * 200 < 4.0 / 3 * pi() * 13 ^ 3),
    o AS (SELECT * FROM f WHERE nuclei = 1), t AS (SELECT l_orderkey, count(*) AS n_cells FROM lineitem GROUP BY 1)
    SELECT l_orderkey, any_value(n_cells) AS n_cells, count(*) AS kept, round_even(avg(l_quantity), 6) AS mean_quantity, round_even(avg(l_discount), 6) AS mean_ratio FROM o JOIN t USING (l_orderkey) GROUP BY 1""",
)
def q11(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "lineitem")
    fit = items.filter((F.col("l_discount") < 0.95) & (F.col("l_quantity") * 200 < sphere_volume(13)))
    single = stats.with_group(fit, ["l_orderkey", "l_linenumber"], nuclei=F.count(F.lit(1))).filter("nuclei = 1")
    means = single.groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("kept"), stats.mean("l_quantity").alias("mean_quantity"), stats.mean("l_discount").alias("mean_ratio"))
    cells = items.groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n_cells"))  # of all, not of those that fit
    return rounded(means.join(cells, "l_orderkey"))


_NAMES = """names AS (SELECT DISTINCT name FROM (SELECT p_name || '_d' || (p_size % 13) || CASE p_size % 5 WHEN 0 THEN '_Soft' WHEN 1 THEN '_stiff_well' || (p_size % 4 + 1) WHEN 2 THEN '_bleb_Well_1' WHEN 3 THEN '_baderd0_WT_' ELSE '_ECadC3_-4oht' END || '.tif' AS name FROM part
    UNION ALL SELECT CASE p_size % 4 WHEN 0 THEN 'shContvsshXPO5_' WHEN 1 THEN 'wtbvstvsbt' WHEN 2 THEN 'WTBvsTvsBT' ELSE 'yapVinc_737_abt_' END || p_brand || '.TIF' FROM part
    UNION ALL SELECT source FROM documents UNION ALL SELECT url FROM pages))"""


def _name_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = F.col("p_size")
    kind = F.when(size % 5 == 0, "_Soft").when(size % 5 == 1, F.concat(F.lit("_stiff_well"), (size % 4 + 1).cast("string"))).when(size % 5 == 2, "_bleb_Well_1").when(size % 5 == 3, "_baderd0_WT_").otherwise("_ECadC3_-4oht")
    prefix = F.when(size % 4 == 0, "shContvsshXPO5_").when(size % 4 == 1, "wtbvstvsbt").when(size % 4 == 2, "WTBvsTvsBT").otherwise("yapVinc_737_abt_")
    part = table(spark, sf_dir, "part")
    parts = [
        part.select(F.concat("p_name", F.lit("_d"), (size % 13).cast("string"), kind, F.lit(".tif")).alias("name")),
        part.select(F.concat(prefix, "p_brand", F.lit(".TIF")).alias("name")),
        table(spark, sf_dir, "documents").select(F.col("source").alias("name")),
        table(spark, sf_dir, "pages").select(F.col("url").alias("name")),
    ]
    return tables.union_all(*parts).distinct()


@query(
    "q12_classifiers",
    f"""WITH {_NAMES}, l AS (SELECT name, lower(name) AS w, replace(lower(name), '_', '') AS s, regexp_replace(name, '(.)\\.[^.]*$', '\\1') AS b FROM names),
    c AS (SELECT *, CASE WHEN contains(w, 'well1') THEN 1 ELSE 2 END AS well, CASE WHEN contains(w, 'd0') THEN 0 WHEN contains(w, 'd1') THEN 1 WHEN contains(w, 'd3') THEN 3 ELSE 7 END AS day,
    CASE WHEN contains(w, 'soft') THEN 'soft' WHEN contains(w, 'stiff') THEN 'stiff' ELSE 'blank' END AS condition,
    CASE WHEN contains(w, 'bleb') THEN 'blebbistatin' WHEN contains(w, 'rock') THEN 'ROCKi' WHEN contains(w, 'batimastat') OR contains(w, 'mmpi') THEN 'batimastat' WHEN contains(w, 'abt') THEN 'ABT737' ELSE 'none' END AS treatment FROM l)
    SELECT name, well, day, condition, treatment, condition || ', d' || day AS image_type,
    CASE WHEN contains(w, 'wt') OR contains(s, 'well1') OR contains(s, 'well2') THEN 'WT' WHEN contains(w, 'her2') OR contains(s, 'well3') OR contains(s, 'well4') THEN 'HER2' ELSE 'WT' END AS cell_type,
    CASE WHEN contains(w, 'soft') OR contains(s, 'well1') OR contains(s, 'well3') THEN 'soft' WHEN contains(w, 'stiff') OR contains(s, 'well2') OR contains(s, 'well4') THEN 'stiff' END AS stiffness,
    CASE WHEN contains(w, 'd10') THEN 10 WHEN contains(w, 'd12') OR contains(w, 'day12') THEN 12 WHEN contains(w, 'd1') THEN 1 WHEN contains(w, 'd3') THEN 3 WHEN contains(w, 'd5') THEN 5 WHEN contains(w, 'd7') THEN 7 END AS cell_day,
    CASE WHEN contains(w, 'd1') OR contains(w, 'd3') OR contains(w, 'd5') OR contains(w, 'd7') OR contains(w, 'day12') THEN 'ok' ELSE 'ERROR' END AS day_status,
    CASE WHEN contains(w, 'ecad') AND contains(w, 'c3') THEN 'ECad_C3' WHEN contains(w, 'yap') AND contains(w, 'vinc') THEN 'Yap_Vinc' WHEN contains(w, 'ilk') THEN 'Ilk' WHEN contains(w, 'lam') AND contains(w, 'pax') THEN 'Lam_Pax'
      WHEN contains(w, 'fak') AND contains(w, 'talin') THEN 'Talin_pFak' WHEN contains(w, 'col') AND contains(w, 'beta') THEN 'Col_Beta_Cat' WHEN contains(w, 'misp') THEN 'Misp_Alpha_Cat' ELSE 'other' END AS protein_set,
    CASE WHEN contains(w, 'bader') AND (contains(w, 'd0') OR contains(w, '-4oht')) THEN '-4OHT' WHEN contains(w, 'bader') THEN '+4OHT' WHEN contains(w, '737') THEN 'ABT737' ELSE 'None' END AS drug,
    CASE WHEN contains(w, 'bader') THEN 'BadER' ELSE 'WT' END AS cell_line,
    CASE WHEN starts_with(lower(b), 'shcontvsshxpo5') THEN substr(b, 15) WHEN starts_with(lower(b), 'wtbvstvsbt') THEN substr(b, 11) ELSE 'Unknown' END AS death_treatment,
    CASE WHEN starts_with(name, 'shContvsshXPO5') THEN 'shContvsshXPO5' WHEN starts_with(name, 'WTBvsTvsBT') THEN 'WTBvsTvsBT' ELSE 'Other' END AS experiment, right(name, 4) AS experiment_id FROM c""",
)
def q12(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.col("name")
    columns = classify.image_details(name) | {
        "cell_type": classify.cell_type(name),
        "stiffness": classify.stiffness(name),
        "cell_day": classify.cell_day(name),
        "day_status": classify.status_of(classify.cell_day(name)),
        "protein_set": classify.protein_set(name),
        "drug": classify.drug_treatment(name),
        "cell_line": classify.cell_line(name),
        "death_treatment": classify.death_treatment(name),
        "experiment": classify.death_experiment(name),
        "experiment_id": classify.experiment_id(name),
    }
    return _name_table(spark, sf_dir).withColumns(columns)


@query(
    "q13_factorize",
    """WITH d AS (SELECT p_brand, row_number() OVER (ORDER BY p_brand) - 1 AS k FROM (SELECT DISTINCT p_brand FROM part WHERE p_brand IS NOT NULL))
    SELECT p_partkey, CAST(k AS INT) AS code, p_brand || ', well' || (p_size % 2 + 1) AS key FROM part LEFT JOIN d USING (p_brand)""",
)
def q13(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_size")
    key = classify.composite_key(F.col("p_brand"), F.concat(F.lit("well"), (F.col("p_size") % 2 + 1).cast("string")))
    return tables.factorize(part, "p_brand", "code").select("p_partkey", "code", key.alias("key"))


@query("q14_first_rows", "SELECT o_custkey, o_orderkey, o_orderstatus FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS k FROM orders) WHERE k = 1")
def q14(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderstatus", "o_orderdate")
    return tables.first_rows(orders, ["o_custkey"], [F.col("o_orderdate"), F.col("o_orderkey")]).drop("o_orderdate")


@query(
    "q15_union",
    "SELECT c_custkey AS id, c_nationkey AS nation, c_acctbal AS balance, c_mktsegment AS segment, 'customer' AS part FROM customer UNION ALL SELECT s_suppkey, s_nationkey, s_acctbal, NULL, 'supplier' FROM supplier",
)
def q15(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("nation"), F.col("c_acctbal").alias("balance"), F.col("c_mktsegment").alias("segment"), F.lit("customer").alias("part"))
    second = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_nationkey").alias("nation"), F.col("s_acctbal").alias("balance"), F.lit("supplier").alias("part"))
    return tables.union_all(first, second)


@query(
    "q16_subset_semi_anti",
    """SELECT o_orderkey, o_orderpriority, 'with items' AS side FROM orders WHERE o_orderpriority IN ('1-URGENT', '5-LOW') AND o_orderkey IN (SELECT l_orderkey FROM lineitem)
    UNION ALL SELECT o_orderkey, o_orderpriority, 'without' FROM orders WHERE o_orderpriority IN ('1-URGENT', '5-LOW') AND o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)""",
)
def q16(spark: SparkSession, sf_dir: str) -> DataFrame:
    some = table(spark, sf_dir, "orders").filter(F.col("o_orderpriority").isin("1-URGENT", "5-LOW")).select("o_orderkey", "o_orderpriority")
    return tables.with_and_without(some, table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey")), "o_orderkey", "side", "with items", "without")


@query(
    "q29_segments",
    f"""WITH {TRACKS}, s AS (SELECT event_id, label, frame, value AS x, CAST(event_id % 97 AS DOUBLE) AS y, lead(value) OVER w AS next_x, lead(CAST(event_id % 97 AS DOUBLE)) OVER w AS next_y FROM trk WINDOW w AS (PARTITION BY label ORDER BY frame, event_id))
    SELECT * FROM s WHERE next_x IS NOT NULL""",
)
def q29(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = tracks(spark, sf_dir).select("event_id", "label", "frame", F.col("value").alias("x"), (F.col("event_id") % 97).cast("double").alias("y"))
    return tracking.segments(points, ["label"], ["frame", "event_id"])


@query(
    "q32_natural_order",
    """WITH n AS (SELECT p_partkey, p_brand || '_x_T' || (p_partkey % 40) || '_' || p_type || '.tif' AS name FROM part),
    k AS (SELECT *, array_to_string(string_split(lower(name), '_')[3:], '_') AS movie, CAST(regexp_extract(name, 'T(\\d+)', 1) AS INT) AS t FROM n)
    SELECT p_partkey, movie, CAST(row_number() OVER (PARTITION BY movie ORDER BY t, p_partkey) - 1 AS INT) AS frame FROM k""",
)
def q32(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.concat("p_brand", F.lit("_x_T"), (F.col("p_partkey") % 40).cast("string"), F.lit("_"), "p_type", F.lit(".tif"))
    named = table(spark, sf_dir, "part").select("p_partkey", name.alias("name"))
    keyed = named.select("p_partkey", classify.movie_key(F.col("name")).alias("movie"), classify.natural_key(F.col("name")).alias("t"))
    frame = (F.row_number().over(Window.partitionBy("movie").orderBy("t", "p_partkey")) - 1).cast("int")
    return keyed.select("p_partkey", "movie", frame.alias("frame"))


@query(
    "q33_spacing",
    """SELECT event_id, coalesce(TRY_CAST(nullif(regexp_extract(d, 'spacing=([0-9.eE+-]+)', 1), '') AS DOUBLE), 1.0) AS z FROM (SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'unit=um spacing=' || round_even(value, 2) || ' loop' WHEN 1 THEN 'spacing=1e-1 loop=false' WHEN 2 THEN 'spacing=..' ELSE props END AS d FROM events)""",
)
def q33(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("event_id") % 4
    text = F.when(kind == 0, F.concat(F.lit("unit=um spacing="), F.bround("value", 2).cast("string"), F.lit(" loop"))).when(kind == 1, "spacing=1e-1 loop=false").when(kind == 2, "spacing=..").otherwise(F.col("props"))
    return table(spark, sf_dir, "events").select("event_id", F.coalesce(number_after(text, "spacing"), F.lit(1.0)).alias("z"))


@query("q34_fixed_sample", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY md5(o_orderkey || '|0'), o_orderkey LIMIT 50")
def q34(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.fixed_sample(table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), ["o_orderkey"], 50)


@query(
    "q39_box_stats",
    """SELECT l_shipmode AS day, l_returnflag AS condition, round_even(quantile_cont(l_extendedprice, 0.25), 6) AS q1, round_even(quantile_cont(l_extendedprice, 0.5), 6) AS median, round_even(quantile_cont(l_extendedprice, 0.75), 6) AS q3,
    min(l_extendedprice) AS low, max(l_extendedprice) AS high, count(l_extendedprice) AS n FROM (SELECT *, l_linestatus AS l_shipmode FROM lineitem) GROUP BY 1, 2""",
)
def q39(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "lineitem").select(F.col("l_linestatus").alias("day"), F.col("l_returnflag").alias("condition"), "l_extendedprice")
    return rounded(stats.box_stats(items, ["day", "condition"], "l_extendedprice"))
