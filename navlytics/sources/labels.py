"""State label files (two INI sections per image) and state tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

# fixed key names of a label section
STATE_KEYS = ("ast_x_rot", "ast_y_rot", "ast_z_rot", "time", "x_off", "y_off", "z_off", "x_rot", "y_rot", "z_rot")


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    d = spark.read.text(path, wholetext=True).withColumn("img", F.regexp_extract(F.input_file_name(), r"([^/]+)\.lbl$", 1))
    return parse_labels(d, "img", "value")


def _section(text: Column, name: str) -> Column:
    body = F.regexp_extract(text, rf"\[{name}\]\s*\n([^\[]*(?:(?<!\n)\[[^\]\n]*\][^\[]*)*?)(?=\n\[\w+\]|\s*$)", 1)
    lines = F.filter(F.split(body, r"\r?\n"), lambda x: x.contains("="))
    pairs = F.transform(lines, lambda x: F.struct(F.trim(F.split(x, "=", 2)[0]), F.trim(F.split(x, "=", 2)[1])))
    return F.map_from_entries(pairs)


def parse_labels(df: DataFrame, img: str, text: str) -> DataFrame:
    """(img, section, keys..., sun_asteroid_pos): one row per section, real values falling back to main."""
    d = df.select(img, _section(F.col(text), "main").alias("m"), _section(F.col(text), "real").alias("r"))
    d = d.select(img, F.explode(F.array(
        F.struct(F.lit("main").alias("section"), F.col("m").alias("kv")),
        F.struct(F.lit("real").alias("section"), F.map_zip_with("m", "r", lambda k, a, b: F.coalesce(b, a)).alias("kv")))).alias("s"))
    get = lambda k: F.try_element_at(F.col("s.kv"), F.lit(k))
    nums = F.regexp_extract_all(get("sun_asteroid_pos"), F.lit(r"(-?[0-9.]+(?:[eE][-+]?[0-9]+)?)"), 1)
    return d.select(img, "s.section", *[get(k).try_cast("double").alias(k) for k in STATE_KEYS],
                    F.transform(nums, lambda x: x.cast("double")).alias("sun_asteroid_pos"))


def label_text(main: dict[str, Column], real: dict[str, Column], sun: Column | None = None) -> Column:
    """Sink form of the same file."""
    def block(name: str, kv: dict[str, Column]) -> list[Column]:
        return [F.lit(f"[{name}]"), *[F.concat(F.lit(f"{k} = "), v.cast("string")) for k, v in kv.items()]]

    tail = [] if sun is None else [F.concat(F.lit("sun_asteroid_pos = [ "), F.array_join(sun.cast("array<string>"), " "), F.lit("]"))]
    return F.concat_ws("\n", *block("main", main), *block("real", real), *tail)


def normalised(value: Column, lo: Column, hi: Column) -> Column:
    """Parameter value on its range, 0..1."""
    return (value - lo) / (hi - lo)


def inverse_distance(value: Column, lo: Column, hi: Column) -> Column:
    """Normalised value of a distance on the scale of 1/distance."""
    return (1.0 / value - 1.0 / lo) / (1.0 / hi - 1.0 / lo)


def valid(value: Column, lo: Column, hi: Column) -> Column:
    return (value >= lo) & (value < hi)


def result_errors(df: DataFrame) -> DataFrame:
    """Per-km errors of a localisation log; failed fixes (NaN) become NULL."""
    fix = lambda c: F.when(~F.isnan(c), F.col(c))
    dist = F.abs(F.col("dist"))
    return df.select(
        "*", (1000.0 * F.hypot(fix("ex"), fix("ey")) / dist).alias("lat_err"), (1000.0 * F.abs(fix("ez")) / dist).alias("dist_err"),
        F.isnan("ex").alias("failed"))


def write_state_tsv(df: DataFrame, path: str, mode: str = "append") -> None:
    """Tab-separated state or result log with a header, appended run by run."""
    df.write.mode(mode).option("sep", "\t").option("header", True).csv(path)
