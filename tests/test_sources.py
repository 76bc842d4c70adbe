import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from tidegrid.functions import scalars as P
from tidegrid.plans import modeling as ML
from tidegrid.sources import constants as K
from tidegrid.sources import documents as D
from tidegrid.sources import sinks, tables


def point(position, quantity):
    q = "" if quantity is None else f"<quantity>{quantity}</quantity>"
    p = "" if position is None else f"<position>{position}</position>"
    return f"<Point>{p}{q}</Point>"


def period(start, resolution, points):
    return (
        f"<Period><timeInterval><start>{start}</start><end>x</end></timeInterval>"
        f"<resolution>{resolution}</resolution>{''.join(points)}</Period>"
    )


def series(periods, psr="B19", business="A01"):
    label = "" if psr is None else f"<MktPSRType><psrType>{psr}</psrType></MktPSRType>"
    return f"<TimeSeries><businessType>{business}</businessType>{label}{''.join(periods)}</TimeSeries>"


def document(*parts):
    return f'<?xml version="1.0"?><Doc xmlns="urn:example:1">{"".join(parts)}</Doc>'


HALF_HOURS = period("2024-01-01T00:00Z", "PT30M", [point(1, 10.0), point(2, 14.0), point(4, 8.0)])


def parse(spark, *texts):
    df = spark.createDataFrame([(t,) for t in texts], "content string")
    return D.parse_series_xml(df, dataset_name="load")


def test_xml_fixture_to_hourly(spark):
    points = P.add_point_timestamps(parse(spark, document(series([HALF_HOURS])))).cache()
    rows = points.orderBy("position").collect()
    assert [(r.dataset_name, r.series_index, r.business_type, r.psr_type) for r in rows] == [("load", 1, "A01", "B19")] * 3
    assert [r.timestamp_utc for r in rows] == [dt.datetime(2024, 1, 1, 0), dt.datetime(2024, 1, 1, 0, 30), dt.datetime(2024, 1, 1, 1, 30)]
    assert [r.load_mw for r in ML.hourly_load(points).orderBy("timestamp_utc").collect()] == [12.0, 8.0]


def test_xml_variants(spark):
    second = series([period("2024-01-02T00:00Z", "PT60M", [point(1, None)]), HALF_HOURS], psr=None)
    rows = parse(spark, document(series([HALF_HOURS]), second)).orderBy("series_index", "resolution", "position").collect()
    assert [r.series_index for r in rows] == [1] * 3 + [2] * 4
    assert [r.resolution for r in rows if r.series_index == 2] == ["PT30M"] * 3 + ["PT60M"]
    assert rows[-1].quantity is None and rows[-1].psr_type is None


def test_xml_without_points_is_empty(spark):
    assert parse(spark, document(series([period("2024-01-01T00:00Z", "PT60M", [])]))).count() == 0
    assert parse(spark, document("<note>none</note>")).count() == 0


def test_xml_missing_position_is_null_then_an_error(spark):
    points = parse(spark, document(series([period("2024-01-01T00:00Z", "PT60M", [point(None, 1.0)])])))
    assert points.first().position is None
    with pytest.raises(Exception, match="missing point position"):
        P.add_point_timestamps(points).collect()


def test_unknown_resolution_and_start_fail(spark):
    for start, resolution, message in (
        ("2024-01-01T00:00Z", "PT5M", "unsupported resolution"),
        ("yesterday", "PT60M", "bad period start"),
    ):
        points = parse(spark, document(series([period(start, resolution, [point(1, 1.0)])])))
        with pytest.raises(Exception, match=message):
            P.add_point_timestamps(points).collect()


def test_malformed_xml_fails(spark):
    with pytest.raises(Exception):
        parse(spark, "<Doc><TimeSeries>").collect()


def test_generation_labels(spark):
    unlabelled = series([HALF_HOURS], psr=None)
    no_business = series([HALF_HOURS]).replace("<businessType>A01</businessType>", "")
    points = P.add_point_timestamps(parse(spark, document(unlabelled, no_business)))
    out = ML.hourly_generation(points).collect()
    assert {(r.psr_type, r.business_type) for r in out} == {("UNKNOWN", "A01")}


WEATHER = {
    "properties": {
        "parameter": {
            "T2M": {"2024010100": 5.1, "2024010101": 5.0, "2024010102": 4.8},
            "WS10M": {"2024010100": 3.2, "2024010102": -999.0, "2024010103": 4.0},
        }
    }
}


def test_hour_json(spark, tmp_path):
    (tmp_path / "w.json").write_text(json.dumps(WEATHER, indent=1))
    rows = D.read_weather_hours(spark, str(tmp_path)).orderBy("timestamp_utc").collect()
    assert [r.hour_key for r in rows] == ["2024010100", "2024010101", "2024010102"]
    assert [r.wind_speed_10m_ms for r in rows] == [3.2, None, -999.0]
    assert rows[0].timestamp_utc == dt.datetime(2024, 1, 1) and rows[0].precipitation_mm_hr is None
    docs = D.read_documents(spark, str(tmp_path), "*.json")
    clean = D.parse_hour_json(docs, null_values=[-999.0]).where("hour_key = '2024010102'").first()
    assert clean.wind_speed_10m_ms is None


def test_tables_and_guard(spark, tmp_path):
    df = spark.createDataFrame([(1, 2.0), (2, float("nan"))], "a int, b double")
    sinks.write_csv(df, str(tmp_path / "c"))
    sinks.write_parquet(df, str(tmp_path / "p"))
    back = tables.read_table(spark, str(tmp_path / "c"), schema="a int, b double", format="csv")
    assert sorted(back.collect()) == [(1, 2.0), (2, None)]
    assert tables.read_table(spark, str(tmp_path / "c"), format="csv").dtypes == [("a", "int"), ("b", "double")]
    assert tables.read_table(spark, str(tmp_path / "p")).count() == 2
    sinks.write_parquet(df.where("a > 5"), str(tmp_path / "e"))
    with pytest.raises(ValueError, match="empty"):
        tables.read_table(spark, str(tmp_path / "e"))


def test_zoned_times_in_csv(spark, tmp_path):
    (tmp_path / "load.csv").write_text("timestamp_utc,load_mw\n2024-01-01 00:00:00+00:00,1.5\n2024-01-01 02:00:00+01:00,\n")
    df = tables.read_table(spark, str(tmp_path / "load.csv"), schema="timestamp_utc timestamp, load_mw double", format="csv")
    assert sorted(df.collect()) == [(dt.datetime(2024, 1, 1, 0), 1.5), (dt.datetime(2024, 1, 1, 1), None)]
    text = spark.createDataFrame([("2024-01-01 02:00:00+01:00",)], "t string")
    assert text.select(P.parse_utc(F.col("t"))).first()[0] == dt.datetime(2024, 1, 1, 1)


def run_file(folder, stamp, entries):
    payload = {"run_generated_at_utc": stamp, "datasets": entries}
    (folder / f"run_metadata_{stamp}.json").write_text(json.dumps(payload, indent=2))


def test_latest_run_and_artifacts(spark, tmp_path):
    run_file(tmp_path, "20240101", [])
    run_file(tmp_path, "20240301", [
        {"dataset_name": "load", "normalized_csv_path": "old.csv"},
        {"dataset_name": "generation", "normalized_csv_path": "g.csv"},
        {"dataset_name": "load", "normalized_csv_path": "new.csv"},
    ])
    path = tables.latest_run(spark, str(tmp_path), "run_metadata_*.json")
    assert path.endswith("run_metadata_20240301.json")
    metadata = tables.read_run_metadata(spark, path)
    assert tables.dataset_paths(metadata, ["load", "generation"]) == {"load": "new.csv", "generation": "g.csv"}
    with pytest.raises(FileNotFoundError):
        tables.dataset_paths(metadata, ["load", "weather"])
    with pytest.raises(FileNotFoundError):
        tables.latest_run(spark, str(tmp_path), "other_*.json")


def test_json_documents(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"x": {"y": 1.5}}, indent=1))
    payload = tables.read_json_documents(spark, str(tmp_path)).select(
        P.variant_value(F.col("payload"), "$.x.y", "double").alias("v"),
        P.variant_value(F.col("payload"), "$.x.z", "double", F.lit(9.0)).alias("d"),
    )
    assert payload.first() == (1.5, 9.0)


def test_sinks(spark, tmp_path):
    rows = [("t_plus_1", "train", 1), ("t_plus_1", "test", 2), ("t_plus_24", "train", 3)]
    df = spark.createDataFrame(rows, "horizon string, split string, v int")
    sinks.write_splits(df, str(tmp_path / "s"))
    assert (tmp_path / "s" / "horizon=t_plus_1" / "split=test").is_dir()
    assert spark.read.parquet(str(tmp_path / "s")).where("horizon = 't_plus_24'").first().v == 3
    sinks.write_json(df, str(tmp_path / "j"))
    assert spark.read.json(str(tmp_path / "j")).count() == 3
    (tmp_path / "raw.xml").write_text("<a>1</a>\n<b/>")
    sinks.write_snapshot(D.read_documents(spark, str(tmp_path / "raw.xml")), str(tmp_path / "snap"))
    assert spark.read.parquet(str(tmp_path / "snap")).first().content == "<a>1</a>\n<b/>"


def test_lineage(spark, tmp_path):
    df = spark.createDataFrame([(dt.datetime(2024, 1, d), 1.0) for d in (3, 1, 2)], "ts timestamp, y double")
    row = sinks.lineage_row(
        df, ts="ts", source="feed", parameters={"area": "X"}, url="http://h/api?securityToken=TESTTOKEN&a=1"
    ).first()
    assert row.row_count == 3 and row.end_utc == dt.datetime(2024, 1, 3)
    assert row.resolved_url == "http://h/api?securityToken=REDACTED&a=1"
    assert row.parameters == {"area": "X"} and row.columns == ["ts", "y"]
    assert sinks.lineage_row(df, ts="ts", source="feed").first().resolved_url is None
    seen = sinks.write_with_lineage(df, str(tmp_path / "w"), ts="ts")
    assert seen["row_count"] == 3 and seen["start_utc"] == dt.datetime(2024, 1, 1)


def test_constant_tables(spark):
    assert K.horizon_table(spark).count() == 3
    assert K.boost_candidate_table(spark).count() == 3
    assert K.arma_candidate_table(spark).where("`order`[1] = 1").count() == 1
    assert K.weather_variable_table(spark).count() == 7
    assert K.feature_table(spark).count() == 18
    assert K.task_table(spark).where("setting = 'backtesting'").first().value == "rolling-origin"


@pytest.mark.parametrize("prefix", ["", "g:"])
def test_one_file_of_many_series_is_read_by_several_tasks(spark, tmp_path, prefix):
    series = "".join(
        f"<{prefix}TimeSeries><{prefix}businessType>A{k:02}</{prefix}businessType><{prefix}Period><{prefix}timeInterval><{prefix}start>2024-01-01T00:00Z"
        f"</{prefix}start></{prefix}timeInterval><{prefix}resolution>PT60M</{prefix}resolution>"
        + "".join(f"<{prefix}Point><{prefix}position>{i}</{prefix}position><{prefix}quantity>{k * 10 + i}</{prefix}quantity></{prefix}Point>" for i in range(1, 4))
        + f"</{prefix}Period></{prefix}TimeSeries>\n"
        for k in range(90)
    )
    space = f' xmlns{":" + prefix[:-1] if prefix else ""}="urn:x"'
    for name in ("a.xml", "b.xml"):
        (tmp_path / name).write_text(f"<?xml version='1.0'?>\n<{prefix}Doc{space}><{prefix}id>1</{prefix}id>\n{series}</{prefix}Doc>")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        text = spark.read.option("lineSep", f"</{prefix}TimeSeries>").text(str(tmp_path / "a.xml"))
        assert text.rdd.getNumPartitions() > 5
        got = D.read_series_xml(spark, str(tmp_path), glob="*.xml", dataset_name="d", end_tag=f"</{prefix}TimeSeries>")
        want = D.parse_series_xml(D.read_documents(spark, str(tmp_path), "*.xml"), dataset_name="d", carry=["path"])
        rows = sorted(map(tuple, got.select(*want.columns).collect()))
        assert rows == sorted(map(tuple, want.collect())) and len(rows) == 540
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_points_outside_of_a_series_fail_the_split_scan(spark, tmp_path):
    (tmp_path / "a.xml").write_text("<Doc><TimeSeries><Period><Point><position>1</position></Point></Period></TimeSeries><Point/></Doc>")
    with pytest.raises(Exception, match="outside"):
        D.read_series_xml(spark, str(tmp_path)).collect()
