"""Queries through files: tables and documents are written to the shared folder and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog import oracle as O
from catalog import spark_queries as Q
from tidegrid.functions import scalars as P
from tidegrid.operators import horizons as H
from tidegrid.operators.audit import present_rows
from tidegrid.session import shared_path
from tidegrid.sources import constants as K
from tidegrid.sources import documents as D
from tidegrid.sources import sinks, tables


def split_round_trip(spark, sf_dir):
    """Test rows of a table written by horizon and split, with what was counted during the write."""
    path = shared_path(spark, "splits")
    rows = Q.labelled_targets(spark, sf_dir).select("event_type", "ts", "target", "horizon", "split")
    seen = sinks.write_with_lineage(rows, path, ts="ts", by=("horizon", "split"))
    test = spark.read.parquet(path).where(F.col("split") == "test")
    stamped = P.add_constants(test, written_rows=seen["row_count"])
    return Q.rounded(stamped.withColumns({"written_from": F.lit(seen["start_utc"]), "written_to": F.lit(seen["end_utc"])}))


def csv_round_trip(spark, sf_dir):
    """The hourly series through CSV, read by the guarded scan."""
    path = shared_path(spark, "series-csv")
    sinks.write_csv(Q.by_type(spark, sf_dir), path)
    return Q.rounded(tables.read_table(spark, path, schema="event_type string, ts timestamp_ntz, value double", format="csv"))


def guarded_scan(spark, sf_dir):
    """Events by the guarded scan: NaN is NULL, an empty table is an error."""
    return Q.rounded(tables.read_table(spark, f"{sf_dir}/events.parquet").select("event_id", "ts", "value"))


def json_records(spark, sf_dir):
    """Hours with a value as JSON records, one per row."""
    path = shared_path(spark, "series-json")
    sinks.write_json(present_rows(Q.by_type(spark, sf_dir), "value"), path)
    return Q.rounded(spark.read.schema("event_type string, ts timestamp_ntz, value double").json(path))


def json_documents(spark, sf_dir):
    """A JSON document per event type, each a file of its own, read with an open schema."""
    path = shared_path(spark, "documents-json")
    made = Q.events(spark, sf_dir).groupBy("event_type").agg(F.count(F.lit(1)).alias("rows"), F.max("ts").alias("last"))
    document = F.to_json(F.struct("event_type", F.struct("rows", "last").alias("summary")))
    made.select("event_type", document.alias("value")).write.partitionBy("event_type").text(path)
    payload = F.col("payload")
    return tables.read_json_documents(spark, path).select(
        F.variant_get(payload, "$.event_type", "string").alias("event_type"),
        F.variant_get(payload, "$.summary.rows", "bigint").alias("row_count"),
        F.to_timestamp_ntz(F.variant_get(payload, "$.summary.last", "string")).alias("last_ts"),
    )


def snapshot_points(spark, sf_dir):
    """Raw documents kept verbatim, then parsed from the snapshot."""
    path = shared_path(spark, "snapshot")
    sinks.write_snapshot(Q.xml_documents(spark, sf_dir), path)
    return Q.xml_point_rows(spark.read.parquet(path))


def latest_run_artifacts(spark, sf_dir):
    """A run per day records a dataset per event type, some twice; the artifacts of the last run."""
    path = shared_path(spark, "runs")
    day = F.date_format("ts", "yyyy-MM-dd")
    counts = Q.events(spark, sf_dir).groupBy(day.alias("run"), F.col("event_type").alias("dataset_name")).agg(F.count(F.lit(1)).alias("row_count"))
    entry = lambda folder: F.struct(
        "dataset_name", F.concat(F.lit(folder), "run", F.lit("/"), "dataset_name", F.lit(".csv")).alias("normalized_csv_path"), "row_count"
    )
    both = counts.withColumn("entries", F.array(entry("old/"), entry("csv/")))
    runs = both.groupBy("run").agg(F.flatten(F.sort_array(F.collect_list("entries"))).alias("datasets"))
    stamped = runs.withColumn("run_generated_at_utc", F.concat("run", F.lit("T00:00:00Z")))
    stamped.repartition("run").write.partitionBy("run").json(path)
    metadata = tables.require_rows(tables.read_run_metadata(spark, tables.latest_run(spark, path, "*.json")), "run metadata")
    return tables.dataset_entries(metadata).select("dataset_name", F.col("normalized_csv_path").alias("path"), "row_count")


def constant_tables(spark, sf_dir):
    """Targets counted against the fixed horizons, and the sizes of the other fixed tables."""
    wide = H.add_horizon_targets(Q.by_type(spark, sf_dir), value="value", ts="ts", series_keys=["event_type"])
    long = H.long_horizons(wide).groupBy("horizon").agg(F.count("target").alias("available"))
    rounds = K.boost_candidate_table(spark).agg(F.sum("n_estimators").alias("boost_rounds"))
    orders = K.arma_candidate_table(spark).agg(F.max(F.element_at("seasonal_order", 4)).alias("season"))
    others = {
        "boost_rounds": rounds.scalar(), "season": orders.scalar(),
        "weather_variables": K.weather_variable_table(spark).agg(F.count("variable")).scalar(),
        "model_features": K.feature_table(spark).agg(F.count("feature")).scalar(),
        "settings": K.task_table(spark).agg(F.count("setting")).scalar(),
    }
    return K.horizon_table(spark).join(long, "horizon", "left").withColumns(others)


def ensured_columns(spark, sf_dir):
    """Known values of every lag, found by prefix, and of a column that the table lacks."""
    featured = P.ensure_columns(Q.supervised(spark, sf_dir), {"wind_onshore_mw": "double"})
    first_lag = P.column_with_prefix(featured, "load_lag_")
    P.require_columns(featured, [first_lag, "wind_onshore_mw"])
    return featured.groupBy("event_type").agg(
        F.lit(first_lag).alias("first_lag"), F.count(first_lag).alias("known"), F.count("wind_onshore_mw").alias("wind_known")
    )


QUERIES = {
    f.__name__: f
    for f in (
        split_round_trip, csv_round_trip, guarded_scan, json_records, json_documents, snapshot_points,
        latest_run_artifacts, constant_tables, ensured_columns,
    )
}

ORACLE = {
    "split_round_trip": f"""WITH {O.LABELLED} SELECT event_type, ts, {O.r('target', 'target')}, horizon, split,
        (SELECT count(*) FROM lab)::INTEGER AS written_rows, (SELECT min(ts) FROM lab) AS written_from, (SELECT max(ts) FROM lab) AS written_to
        FROM lab WHERE split = 'test'""",
    "csv_round_trip": f"WITH {O.SERIES} SELECT event_type, ts, {O.r('value', 'value')} FROM series",
    "guarded_scan": f"SELECT event_id, ts, {O.r('CASE WHEN isnan(value) THEN NULL ELSE value END', 'value')} FROM events",
    "json_records": f"WITH {O.SERIES} SELECT event_type, ts, {O.r('value', 'value')} FROM series WHERE value IS NOT NULL",
    "json_documents": "SELECT event_type, count(*) AS row_count, date_trunc('millisecond', max(ts)) AS last_ts FROM events GROUP BY 1",
    "snapshot_points": O.ORACLE["xml_points"],
    "latest_run_artifacts": """WITH d AS (SELECT strftime(ts, '%Y-%m-%d') AS run, event_type, count(*) AS row_count FROM events GROUP BY 1, 2)
        SELECT event_type AS dataset_name, 'csv/' || run || '/' || event_type || '.csv' AS path, row_count FROM d WHERE run = (SELECT max(run) FROM d)""",
    "constant_tables": f"""WITH {O.SERIES},{O.targets('series', 'tg', O.BY_TYPE)}
        SELECT horizon, max(lead_steps)::INTEGER AS lead_hours, count(target) AS available, 800::BIGINT AS boost_rounds, 24::INTEGER AS season,
            7::BIGINT AS weather_variables, 18::BIGINT AS model_features, 6::BIGINT AS settings FROM tg_long GROUP BY 1""",
    "ensured_columns": f"""WITH {O.SERIES}, l AS (SELECT event_type, lag(value, 1) OVER {O.TYPE_ORDER} AS v FROM series)
        SELECT event_type, 'load_lag_1' AS first_lag, count(v) AS known, 0::BIGINT AS wind_known FROM l GROUP BY 1""",
}
