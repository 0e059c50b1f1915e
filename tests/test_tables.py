"""Files, cleaning, profiling, membership and classes on small cases."""

import json
from datetime import datetime

import pytest

from curbwait.operators import regions, trips, zones
from curbwait.operators.rings import region_polygons
from curbwait.schemas import TRIP_SCHEMA
from curbwait.sources import csv, sinks

HEADER = ", ".join(TRIP_SCHEMA.names)
GOOD = "m,h,V,1,N,2013-01-01 15:11:48,2013-01-01 15:18:10,4,382,1.0,-73.97,40.75,-73.98,40.76"


def written(folder, *lines, name="trips.csv"):
    path = folder / name
    path.write_text("\n".join(lines) + "\n")
    return str(path)


def test_trip_file(spark, tmp_path):
    path = written(
        tmp_path,
        HEADER,
        GOOD,
        GOOD.replace("2013-01-01 15:11:48", "yesterday"),
        "m,h,V,1,N,2013-01-01 15:11:48",
        GOOD + ",more,fields",
        GOOD.replace("40.75", ""),
    )
    rows = csv.read_trips(spark, path)
    assert rows.columns == TRIP_SCHEMA.names
    assert rows.count() == 5
    clean = trips.clean_trips(rows)
    assert clean.count() == 2
    first = clean.first()
    assert first.hack_license == "h"
    assert first.pickup_datetime == int(datetime(2013, 1, 1, 15, 11, 48).timestamp())
    assert first.dropoff_datetime - first.pickup_datetime == 382


@pytest.mark.parametrize(
    "header, accepted",
    [
        (HEADER, True),
        (",".join(TRIP_SCHEMA.names), True),
        (" , ".join(TRIP_SCHEMA.names) + "  ", True),
        (HEADER.replace("hack_license", "licence"), False),
        (HEADER.replace("medallion, hack_license", "hack_license, medallion"), False),
        ("", False),
    ],
)
def test_headers(spark, tmp_path, header, accepted):
    path = written(tmp_path, header, GOOD)
    if accepted:
        assert csv.read_trips(spark, path).count() == 1
        assert trips.clean_trips(csv.read_trips(spark, path)).count() == 1
    else:
        with pytest.raises(csv.HeaderMismatch):
            csv.read_trips(spark, path)


def test_every_file_is_held_to_the_header(spark, tmp_path):
    written(tmp_path, HEADER, GOOD, name="a.csv")
    written(tmp_path, HEADER, GOOD, name="b.csv")
    assert trips.clean_trips(csv.read_trips(spark, str(tmp_path))).count() == 2
    swapped = HEADER.replace("medallion, hack_license", "hack_license, medallion")
    written(tmp_path, swapped, GOOD, name="c.csv")
    with pytest.raises(Exception, match="CSV header|CSV file|header"):
        trips.clean_trips(csv.read_trips(spark, str(tmp_path))).collect()
    lenient = csv.read_trips(spark, str(tmp_path), same_headers=False)
    assert trips.clean_trips(lenient).count() == 3


def test_only_needed_columns_are_read(spark, tmp_path):
    path = written(tmp_path, HEADER, GOOD)
    plan = trips.clean_trips(csv.read_trips(spark, path))._jdf.queryExecution().toString()
    schema = plan.split("ReadSchema: ")[-1].split(">")[0]
    assert "hack_license" in schema and "medallion" not in schema


def test_zone_file_with_more_columns(spark, tmp_path):
    path = written(
        tmp_path,
        "OBJECTID,Shape_Leng,the_geom,Shape_Area,zone,LocationID,borough",
        '1,0.5,"MULTIPOLYGON (((0 0, 1 0, 1 1, 0 0)))",0.25,Z,9,B',
    )
    declared, inferred = csv.read_zones(spark, path), csv.read_zones(spark, path, infer=True)
    assert dict(declared.dtypes)["Shape_Area"] == dict(inferred.dtypes)["Shape_Area"] == "double"
    assert zones.zones_to_edges(declared).count() == zones.zones_to_edges(inferred).count() == 3


def test_borough_file(spark, tmp_path):
    path = written(
        tmp_path,
        "the_geom,BoroCode,BoroName,Shape_Leng,Shape_Area",
        '"MULTIPOLYGON (((0 0, 1 0, 1 1, 0 0)))",1,B,0.5,0.25',
        '"MULTIPOLYGON (((0 0, 1 0, 1 1, 0 0)))",2,,0.5,0.25',
    )
    rows = csv.read_boroughs(spark, path)
    assert set(rows.columns) == {"borough", "zone", "the_geom", "Shape_Leng", "Shape_Area"}
    assert zones.zones_to_edges(rows).count() == 3
    assert [r.borough for r in rows.collect()] == ["B"]


def test_hours_round_down(spark):
    rows = [(0, s) for s in (-3601, -3600, -1, 0, 3599, 3600, 14399, 14400)]
    table = spark.createDataFrame(rows, "pickup_datetime bigint, dropoff_datetime bigint")
    hours = [r.trip_in_hours for r in trips.with_hours(table).orderBy("dropoff_datetime").collect()]
    assert hours == [-2, -1, -1, 0, 0, 1, 3, 4]
    assert trips.plausible(table).count() == 4


def test_summary_of_text_and_numbers(spark):
    table = spark.createDataFrame([("7", 1.0), ("x", 3.0), (None, None)], "t string, n double")
    found = {r.column_name: r for r in trips.summary(table).collect()}
    assert (found["t"]["count"], found["t"].mean, found["t"].min, found["t"].max) == (2, 7.0, "7", "x")
    assert (found["n"]["count"], found["n"].mean, found["n"].min) == (2, 2.0, "1.0")
    assert found["t"].stddev is None


def test_approximate_quantiles_stay_within_their_error(spark):
    table = spark.range(20_000).selectExpr("0L as pickup_datetime", "(id * 7919 % 20000) * 3600 as dropoff_datetime")
    for error in (0.1, 0.01):
        for r in trips.hours_quantiles(table, error=error).collect():
            assert abs(r.value - r.probability * 20_000) <= error * 20_000 + 1


def test_points_not_in_a_list(spark):
    rows = spark.createDataFrame([(1, 1.0, 1.0), (2, 2.0, 2.0), (3, None, 1.0)], "i int, x double, y double")
    listed = spark.createDataFrame([(1.0, 1.0), (1.0, 1.0)], "x double, y double")
    gap = spark.createDataFrame([(None, 5.0)], "x double, y double")

    def kept(others):
        return sorted(r.i for r in regions.not_in(rows, others, ["x", "y"]).collect())

    assert kept(listed) == [2]
    assert kept(listed.union(gap)) == []
    assert kept(listed.limit(0)) == [1, 2, 3]


def test_frequent_points_not_in_a_list(spark):
    """A third of the rows at a listed point, a third at another, a third apart."""
    rows = spark.range(900).selectExpr(
        "id",
        "if(id % 3 = 0, 0D, if(id % 3 = 1, 1D, id / 2)) as x",
        "if(id % 7 = 0, null, 2D) as y",
    )
    listed = spark.sql("select double(id) as x, 2D as y from range(0, 400, 4) union all select 0D, 2D")
    found = sorted(r.id for r in regions.not_in(rows, listed, ["x", "y"]).collect())
    gone = {float(i) for i in range(0, 400, 4)}
    place = lambda i: 0.0 if i % 3 == 0 else 1.0 if i % 3 == 1 else i / 2
    assert found == [i for i in range(900) if i % 7 and place(i) not in gone]
    rows_beside_nothing = regions.not_in(rows, listed.limit(0), ["x", "y"])
    assert rows_beside_nothing.count() == 900


def test_regions_missing_from_the_zones(spark):
    names = spark.createDataFrame([("O'Hare",), ("B",), ("B",)], "borough string")
    table = spark.createDataFrame([("B",)], "borough string")
    assert [r.borough for r in regions.unknown_regions(names, table).collect()] == ["O'Hare"]
    assert regions.rows_of_regions(names, ["O'Hare"]).count() == 1


@pytest.mark.parametrize(
    "values, classes",
    [
        ([1.0, 2.0, 3.0, 4.0, 5.0], [0, 1, 2, 3, 4]),
        ([1.0, 1.0, 1.0, 1.0, 9.0], [0, 0, 0, 0, 2]),
        ([4.0], [0]),
        ([2.0, 2.0, 2.0], [0, 0, 0]),
        ([float(i) for i in range(10)], [0, 0, 1, 1, 2, 2, 3, 3, 4, 4]),
    ],
)
def test_classes(spark, values, classes):
    rows = [(i, v) for i, v in enumerate(values)]
    table = spark.createDataFrame(rows, "i int, v double")
    found = regions.quantile_classes(table, "v").orderBy("i").collect()
    assert [r["class"] for r in found] == classes


def test_one_value_has_no_deviation(spark):
    table = spark.createDataFrame([("B", 5), ("C", 1), ("C", 3)], "dropoff_borough string, next_fare_duration bigint")
    assert [tuple(r) for r in regions.idle_by_region(table).collect()] == [
        ("C", 2.0, pytest.approx(2**0.5)),
        ("B", 5.0, None),
    ]


def test_features_are_geojson(spark, tmp_path):
    table = spark.createDataFrame(
        [("z1", "B", "POLYGON ((0 0, 1 0, 1 1, 0 0))"), ("z2", "B", "POLYGON ((5 5, 6 5, 6 6, 5 5))")],
        "zone string, borough string, the_geom string",
    )
    classes = spark.createDataFrame([("B", 1.5, 0)], "name string, average_duration double, class int")
    outlines = region_polygons(zones.dissolve(zones.zones_to_edges(table)))
    drawn = regions.features(classes, outlines, "name")
    sinks.write_features(drawn, str(tmp_path / "map"))
    feature = json.loads(spark.read.text(str(tmp_path / "map")).first().value)
    assert feature["properties"] == {"name": "B", "average_duration": 1.5, "class": 0}
    assert feature["geometry"]["type"] == "MultiPolygon"
    assert feature["geometry"]["coordinates"][1] == [[[5.0, 5.0], [6.0, 5.0], [6.0, 6.0], [5.0, 5.0]]]


def test_a_long_report_is_refused(spark):
    assert len(sinks.report(spark.range(5))) == 5
    with pytest.raises(ValueError):
        sinks.report(spark.range(5), most=4)
