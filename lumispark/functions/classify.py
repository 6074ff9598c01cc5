"""Categories read off file names, as ordered conditions: the first that holds decides."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

Rules = list[tuple[Column, object]]


def first_match(rules: Rules, otherwise: object) -> Column:
    """The value of the first condition that holds; a null condition doesn't hold."""
    out = None
    for condition, value in rules:
        value = F.lit(value)
        out = F.when(condition, value) if out is None else out.when(condition, value)
    return out.otherwise(F.lit(otherwise))


def _has(text: Column, *parts: str) -> Column:
    """Whether the text holds any of the parts."""
    found = text.contains(parts[0])
    for part in parts[1:]:
        found = found | text.contains(part)
    return found


def well(name: Column) -> Column:
    return first_match([(_has(F.lower(name), "well1"), 1)], 2)


def day(name: Column) -> Column:
    """Day of an acinus image. "d1" also holds of d10 and d12: the order of tests is the meaning."""
    low = F.lower(name)
    return first_match([(_has(low, f"d{k}"), k) for k in (0, 1, 3)], 7)


def condition(name: Column) -> Column:
    low = F.lower(name)
    return first_match([(_has(low, c), c) for c in ("soft", "stiff")], "blank")


def image_treatment(name: Column) -> Column:
    low = F.lower(name)
    return first_match(
        [(_has(low, "bleb"), "blebbistatin"), (_has(low, "rock"), "ROCKi"), (_has(low, "batimastat", "mmpi"), "batimastat"), (_has(low, "abt"), "ABT737")],
        "none",
    )


def image_type(name: Column) -> Column:
    return F.concat(condition(name), F.lit(", d"), day(name).cast("string"))


def image_details(name: Column, with_treatment: bool = True) -> dict[str, Column]:
    """The columns that describe an acinus image."""
    out = {"well": well(name), "day": day(name), "condition": condition(name)}
    if with_treatment:
        out["treatment"] = image_treatment(name)
    return out | {"image_type": image_type(name)}


def cell_type(name: Column) -> Column:
    """Of a brightfield image; underscores are ignored where wells are tested."""
    low = F.lower(name)
    plain = F.replace(low, F.lit("_"), F.lit(""))
    return first_match([(_has(low, "wt") | _has(plain, "well1", "well2"), "WT"), (_has(low, "her2") | _has(plain, "well3", "well4"), "HER2")], "WT")


def stiffness(name: Column) -> Column:
    """Of a brightfield image; null where the name doesn't say."""
    low = F.lower(name)
    plain = F.replace(low, F.lit("_"), F.lit(""))
    return first_match([(_has(low, "soft") | _has(plain, "well1", "well3"), "soft"), (_has(low, "stiff") | _has(plain, "well2", "well4"), "stiff")], None)


def cell_day(name: Column) -> Column:
    """Day of a brightfield image; null where the name doesn't say."""
    low = F.lower(name)
    tests = (("d10",), 10), (("d12", "day12"), 12), (("d1",), 1), (("d3",), 3), (("d5",), 5), (("d7",), 7)
    return first_match([(_has(low, *parts), k) for parts, k in tests], None).cast("int")


def status_of(value: Column) -> Column:
    """ok, or ERROR where the value couldn't be read."""
    return F.when(value.isNull(), "ERROR").otherwise("ok")


def protein_set(name: Column) -> Column:
    low = F.lower(name)
    both = lambda a, b: low.contains(a) & low.contains(b)
    return first_match(
        [
            (both("ecad", "c3"), "ECad_C3"),
            (both("yap", "vinc"), "Yap_Vinc"),
            (_has(low, "ilk"), "Ilk"),
            (both("lam", "pax"), "Lam_Pax"),
            (both("fak", "talin"), "Talin_pFak"),
            (both("col", "beta"), "Col_Beta_Cat"),
            (_has(low, "misp"), "Misp_Alpha_Cat"),
        ],
        "other",
    )


def drug_treatment(name: Column) -> Column:
    low = F.lower(name)
    bader = _has(low, "bader")
    return first_match([(bader & _has(low, "d0", "-4oht"), "-4OHT"), (bader, "+4OHT"), (_has(low, "737"), "ABT737")], "None")


def cell_line(name: Column) -> Column:
    return first_match([(_has(F.lower(name), "bader"), "BadER")], "WT")


def title_case(name: Column) -> Column:
    """Words with a capital first letter and small ones after it, as labels of plots show them."""
    return F.initcap(name)


def stem(name: Column) -> Column:
    """The name without its last extension."""
    return F.regexp_replace(name, r"(?<=.)\.[^.]*$", "")


def death_treatment(name: Column, prefixes: tuple[str, ...] = ("shcontvsshxpo5", "wtbvstvsbt")) -> Column:
    """What follows a known experiment prefix (any case), in its own case; else Unknown."""
    base = stem(name)
    low = F.lower(base)
    return first_match([(low.startswith(p), F.substr(base, F.lit(len(p) + 1))) for p in prefixes], "Unknown")


def death_experiment(name: Column, prefixes: tuple[str, ...] = ("shContvsshXPO5", "WTBvsTvsBT")) -> Column:
    """The experiment prefix, in exactly this case; else Other."""
    return first_match([(name.startswith(p), p) for p in prefixes], "Other")


def experiment_id(name: Column) -> Column:
    return F.right(name, F.lit(4))


def cycle_colour(pct_red: Column, pct_green: Column, pct_yellow: Column, yellow_above: float = 15.0) -> Column:
    """Cell-cycle class of a nucleus; one without measurements is green."""
    return first_match([(pct_yellow > yellow_above, "yellow"), (pct_red > pct_green, "red")], "green")


def axis_colour(of_condition: Column, of_day: Column) -> tuple[Column, Column]:
    """Colour names of a plot's lines: by condition, by day."""
    by_condition = first_match([(of_condition == c, k) for c, k in (("blank", "grey"), ("stiff", "red"), ("soft", "blue"))], "black")
    by_day = first_match([(of_day == d, k) for d, k in ((0, "light"), (1, "medium"), (3, "dark"))], "black")
    return by_condition, by_day


def composite_key(*parts: Column) -> Column:
    """Parts joined by a comma and a space; null if any is."""
    out = [parts[0].cast("string")]
    for p in parts[1:]:
        out += [F.lit(", "), p.cast("string")]
    return F.concat(*out)


def movie_key(name: Column) -> Column:
    """Tokens after the first two of the lower-case base name."""
    tokens = F.split(F.lower(F.element_at(F.split(name, "[/\\\\]"), -1)), "_")
    return F.array_join(F.slice(tokens, 3, 1000), "_")


def natural_key(name: Column, marker: str = "T") -> Column:
    """The number after the marker, to sort names as people count."""
    return F.try_element_at(F.regexp_extract_all(name, F.lit(marker + r"(\d+)"), 1), F.lit(1)).cast("int")
