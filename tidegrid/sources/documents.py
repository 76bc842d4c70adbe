"""Scans of nested feed documents: time-series XML and hour-keyed JSON.

A document is one row of text, so the work spreads over documents; nested levels
are unfolded by generators without a shuffle.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidegrid.functions.scalars import ensure_columns, parse_hour_key
from tidegrid.session import cut_lineage
from tidegrid.sources.constants import WEATHER_VARIABLES

HOUR_JSON_SCHEMA = "properties struct<parameter map<string, map<string, double>>>"


def read_documents(spark: SparkSession, path: str | list[str], glob: str | None = None) -> DataFrame:
    """Whole text files as ``(path, content)``, one row each."""
    text = spark.read.text(path, wholetext=True, pathGlobFilter=glob)
    return text.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("content"))


def _plain_tags(content: Column) -> Column:
    """XML text without comments, attributes and namespace prefixes."""
    bare = F.regexp_replace(content, r"(?s)<!--.*?-->", "")
    return F.regexp_replace(bare, r"<(/?)(?:[\w.-]+:)?([\w.-]+)(?:\s[^<>]*?)?(/?)>", "<$1$2$3>")


def _elements(text: Column, name: str) -> Column:
    """All elements of a name at any depth, in document order, as texts; they must not nest in themselves."""
    return F.regexp_extract_all(text, F.lit(f"(?s)<{name}>.*?</{name}>|<{name}/>"), F.lit(0))


def parse_series_xml(
    documents: DataFrame, *, content: str = "content", dataset_name: str | Column | None = None,
    carry: Sequence[str] = (),
) -> DataFrame:
    """One row per point of a time-series document, with series and period attributes repeated.

    Series, periods, points and labels are found at any depth. ``series_index`` is 1-based
    in document order; the label is the last ``psrType`` inside the series, NULL without
    one. Namespaces are ignored, absent positions and quantities are NULL. A malformed
    document fails the job, and so does one with a ``Point`` outside of a series' period.
    """
    strict = {"mode": "FAILFAST"}
    name = dataset_name if isinstance(dataset_name, Column) else F.lit(dataset_name).cast("string")
    whole = {"ignoreNamespace": "true", "excludeAttribute": "true", **strict}
    tags = documents.where(F.from_xml(F.col(content), "_none string", whole).isNotNull()).select(
        *carry, name.alias("dataset_name"), _plain_tags(F.col(content)).alias("tags")
    )
    nested = F.transform(
        _elements(F.col("tags"), "TimeSeries"), lambda s: F.struct(s.alias("series"), F.transform(
            _elements(s, "Period"), lambda p: F.struct(p.alias("period"), _elements(p, "Point").alias("points"))
        ).alias("periods"))
    )
    found = F.aggregate(
        "nested", F.lit(0), lambda n, s: n + F.aggregate(s["periods"], F.lit(0), lambda m, p: m + F.size(p["points"]))
    )
    lost = F.raise_error(F.lit("a Point stands outside of a series' period")).cast("int")
    checked = tags.withColumn("nested", nested).where(
        F.when(found == F.regexp_count("tags", F.lit("<Point/?>")), F.lit(1)).otherwise(lost) == 1
    )
    series = checked.select(*carry, "dataset_name", F.posexplode("nested").alias("pos", "s"))
    labels = F.transform(
        F.regexp_extract_all(F.col("s.series"), F.lit("<psrType>([^<]*)</psrType>|<psrType/>"), F.lit(1)), lambda x: F.trim(x)
    )
    rows = series.select(
        *carry,
        "dataset_name",
        (F.col("pos") + 1).alias("series_index"),
        F.from_xml(F.col("s.series"), "businessType string", strict)["businessType"].alias("business_type"),
        F.nullif(F.try_element_at(labels, F.lit(-1)), F.lit("")).alias("psr_type"),
        F.explode("s.periods").alias("p"),
    )
    head = F.from_xml(F.regexp_replace("p.period", "(?s)<Point>.*?</Point>|<Point/>", ""), "timeInterval struct<start string>, resolution string", strict)
    points = rows.select(
        *carry,
        "dataset_name",
        "series_index",
        "business_type",
        "psr_type",
        head.alias("head"),
        F.explode("p.points").alias("point"),
    ).withColumn("point", F.from_xml("point", "position int, quantity double", strict))
    return points.select(
        *carry,
        "dataset_name",
        "series_index",
        "business_type",
        "psr_type",
        F.col("head.timeInterval.start").alias("period_start"),
        F.col("head.resolution").alias("resolution"),
        F.col("point.position").alias("position"),
        F.col("point.quantity").alias("quantity"),
    )


def read_series_xml(
    spark: SparkSession, path: str | list[str], *, glob: str | None = None, dataset_name: str | None = None,
    end_tag: str = "</TimeSeries>",
) -> DataFrame:
    """Points of time-series files of any size, with ``path``; the rows of ``parse_series_xml``.

    Files are split into records at the end tag of a series, so several tasks read one file and
    no document is held whole. ``series_index`` is restored from the number of series in the
    splits of the file before. The end tag must be written as given, prefix included, and not
    stand in comments; points outside of a series fail the job.
    """
    reader = spark.read.option("lineSep", end_tag)
    text = (reader.option("pathGlobFilter", glob) if glob else reader).text(path)
    records = text.select(
        F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("_block"),
        F.monotonically_increasing_id().alias("_order"), F.col("value"),
    )
    start = F.regexp_instr("value", F.lit(r"<([\w.-]+:)?TimeSeries[\s>]"))
    prefix = F.regexp_extract(F.lit(end_tag), "</([^>]*:)?", 1)
    stray = F.regexp_count(F.when(start > 0, F.substr("value", F.lit(1), start - 1)).otherwise(F.col("value")), F.lit(r"<([\w.-]+:)?Point[\s/>]"))
    lost = F.raise_error(F.lit("a Point stands outside of a series' period")).cast("int")
    held = records.withColumn("_start", start).where(F.when(stray == 0, F.lit(1)).otherwise(lost) == 1).where("_start > 0")
    # The prefix has lost its declaration; a record declares it by itself.
    wrapped = F.concat(
        F.lit("<r"), F.when(prefix != "", F.concat(F.lit(" xmlns:"), F.rtrim(F.lit(":"), prefix), F.lit('="x"'))).otherwise(F.lit("")),
        F.lit(">"), F.substr("value", F.col("_start")), F.lit(end_tag), F.lit("</r>"),
    )
    local = F.row_number().over(Window.partitionBy("path", "_block").orderBy("_order"))
    numbered = cut_lineage(held.select("path", "_block", local.alias("_local"), wrapped.alias("content")))
    before = Window.partitionBy("path").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)  # one row per split of a file
    offsets = numbered.groupBy("path", "_block").agg(F.count(F.lit(1)).alias("_n")).select(
        "path", "_block", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before")
    )
    placed = numbered.join(offsets, ["path", "_block"]).withColumn("_index", (F.col("_local") + F.col("_before")).cast("int"))
    points = parse_series_xml(placed, dataset_name=dataset_name, carry=["path", "_index"])
    return points.withColumn("series_index", F.col("_index")).drop("_index")


def parse_hour_json(
    documents: DataFrame,
    *,
    content: str = "content",
    variables: Mapping[str, str] = WEATHER_VARIABLES,
    hour_key: str = "hour_key",
    ts: str = "timestamp_utc",
    null_values: Sequence[float] = (),
    carry: Sequence[str] = (),
) -> DataFrame:
    """One row per hour of the first variable in the document, one column per variable.

    A variable without that hour, or absent altogether, gives NULL. Values are
    kept as sent unless listed in ``null_values``.
    """
    parameter = F.col("doc.properties.parameter")
    hours = F.map_keys(F.element_at(parameter, F.map_keys(parameter)[0]))
    exploded = documents.select(
        *carry, F.from_json(F.col(content), HOUR_JSON_SCHEMA, {"mode": "FAILFAST"}).alias("doc")
    ).select(*carry, parameter.alias("parameter"), F.explode(hours).alias(hour_key))

    def cell(variable: str) -> Column:
        found = F.try_element_at(F.try_element_at("parameter", F.lit(variable)), F.col(hour_key))
        return F.when(~found.isin(*null_values), found) if null_values else found

    return exploded.select(
        *carry,
        hour_key,
        *[cell(v).alias(name) for v, name in variables.items()],
        parse_hour_key(F.col(hour_key)).alias(ts),
    )


def read_weather_hours(spark: SparkSession, path: str) -> DataFrame:
    """Weather documents as an hourly table; precipitation is always present."""
    hours = parse_hour_json(read_documents(spark, path))
    return ensure_columns(hours, {"precipitation_mm_hr": "double"})
