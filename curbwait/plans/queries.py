"""Every operator as a query over the derived trips and zones."""

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from curbwait import fixtures
from curbwait.operators import locate, next_fare, profiles, regions, session_store, trips, zones
from curbwait.operators.coverage import overlaps
from curbwait.operators.grid import fit_grid
from curbwait.operators.rings import region_polygons
from curbwait.operators.simplify import simplified
from curbwait.operators.union import union_areas, union_edges
from curbwait.plans import jobs
from curbwait.plans.analysis import analyse
from curbwait.schemas import DROPOFF, TRIP_ORDER, TRIP_SCHEMA
from curbwait.session import scratch_path
from curbwait.sources import csv, sinks

EVERY_TRIP = ["trip_id", *trips.TRIP_COLUMNS]


def _trips(spark: SparkSession, folder: str) -> DataFrame:
    return fixtures.trips(spark, folder)


def _clean(spark, folder, keep=("trip_id",)):
    return trips.clean_trips(fixtures.trips_raw(spark, folder), keep)


def _index(spark, folder):
    return jobs.region_index(fixtures.zones(spark, folder))


def _edges(spark, folder):
    return zones.zones_to_edges(fixtures.zones(spark, folder))


def _gaps(spark, folder):
    return next_fare.next_fare(trips.plausible(_trips(spark, folder)).drop("trip_in_hours"))


def _rounded(df: DataFrame, **places: int) -> DataFrame:
    return df.withColumns({c: F.round(c, n) for c, n in places.items()})


def _written_trips(spark, folder, header=lambda i, name: name if i == 0 else f" {name}"):
    """The trips as a CSV file with blanks in the header, like published ones."""
    rows = fixtures.trip_file_rows(spark, folder)
    path = scratch_path(spark, "trips")
    rows.toDF(*[header(i, c) for i, c in enumerate(rows.columns)]).write.csv(
        path,
        header=True,
        ignoreLeadingWhiteSpace=False,
        timestampFormat="yyyy-MM-dd HH:mm:ss",
    )
    return path


def clean_trips(spark, folder):
    points = trips.with_points(_clean(spark, folder))
    return points.select(
        "trip_id",
        "hack_license",
        "pickup_datetime",
        "dropoff_datetime",
        *[F.col(f"{end}_point.{c}").alias(f"{end}_{c}") for end in ("pickup", "dropoff") for c in "xy"],
    )


def csv_roundtrip(spark, folder):
    read = csv.read_trips(spark, _written_trips(spark, folder))
    return trips.clean_trips(read, keep=["medallion", "trip_distance"])


def header_check(spark, folder):
    """Header verdicts for the trips written with three kinds of header, beside
    the rows found below it."""
    kinds = {
        "plain": lambda i, name: name,
        "blanks": lambda i, name: f" {name} ",
        "renamed": lambda i, name: f"c{i}",
    }
    verdicts = None
    for kind, header in kinds.items():
        path = _written_trips(spark, folder, header)
        try:
            csv.check_header(spark, path)
            accepted = True
        except csv.HeaderMismatch:
            accepted = False
        rows = spark.read.csv(path, header=True, schema=TRIP_SCHEMA)
        verdict = rows.agg(
            F.lit(kind).alias("header"), F.lit(accepted).alias("accepted"), F.count("*").alias("rows")
        )
        verdicts = verdict if verdicts is None else verdicts.unionByName(verdict)
    return verdicts


def _written_zones(spark, folder, **names):
    areas = zones.area(_edges(spark, folder), "zone")
    path = scratch_path(spark, "zones")
    (
        fixtures.zones(spark, folder)
        .join(areas, "zone")
        .select(
            F.lit(1.5).alias("Shape_Leng"),
            "the_geom",
            F.col("location_area").alias("Shape_Area"),
            "zone",
            "borough",
        )
        .withColumnsRenamed(names)
        .write.csv(path, header=True)
    )
    return path


def zones_csv(spark, folder):
    return csv.read_zones(spark, _written_zones(spark, folder))


def zones_csv_inferred(spark, folder):
    return csv.read_zones(spark, _written_zones(spark, folder), infer=True)


def boroughs_csv(spark, folder):
    """The zones written as a borough table, read back by the borough reader."""
    path = _written_zones(spark, folder, zone="BoroCode", borough="BoroName")
    read = csv.read_boroughs(spark, path, infer=True)
    return read.select("borough", "the_geom", "Shape_Leng", "Shape_Area")


def trip_summary(spark, folder):
    described = trips.summary(_clean(spark, folder, keep=()))
    return described.select(
        "column_name",
        "count",
        F.round("mean", 3).alias("mean"),
        F.round("stddev", 3).alias("stddev"),
        F.col("min").cast("double").alias("min"),
        F.col("max").cast("double").alias("max"),
    )


def _profile(spark, folder):
    """The state of all trips, merged from those of four parts, each written."""
    rows, states = trips.with_hours(_clean(spark, folder)), []
    for part in range(4):
        path = scratch_path(spark, "profile")
        sinks.write_table(profiles.profile_state(rows.where(f"trip_id % 4 = {part}").drop("trip_id")), path)
        states.append(spark.read.parquet(path))
    return rows, profiles.merged(states)


def trip_profile_merged(spark, folder):
    """The summary of numbers, merged from stored states of parts."""
    _, state = _profile(spark, folder)
    return _rounded(profiles.described(state), mean=3, stddev=3)


def trip_profile_ranks(spark, folder):
    """Quantiles of the hours from merged sketches: their values' ranks, to within 0.02
    of the rows, which is more than the sketch may be off by."""
    rows, state = _profile(spark, folder)
    asked = profiles.quantiles(state, [0.05, 0.25, 0.5, 0.75, 0.97]).where("column_name = 'trip_in_hours'")
    ranked = trips.quantile_ranks(rows.drop("trip_in_hours"), asked)
    wanted, slack = F.col("probability") * F.col("rows"), 0.02 * F.col("rows")
    near = (F.col("below") <= wanted + slack) & (wanted <= F.col("upto") + slack)
    return ranked.select("probability", "rows", near.alias("ok"))


def _broken_lines(spark, folder):
    """The trips as a file in which some lines have bad, missing or too few fields."""
    rows = fixtures.trip_file_rows(spark, folder)
    date = "date_format({}, 'yyyy-MM-dd HH:mm:ss')".format
    values = {c: f"string({c})" for c in rows.columns}
    values["pickup_datetime"] = f"if(medallion % 97 = 0, 'yesterday', {date('pickup_datetime')})"
    values["dropoff_datetime"] = date("dropoff_datetime")
    values["pickup_latitude"] = "if(medallion % 103 = 0, '', string(pickup_latitude))"
    values["dropoff_longitude"] = "if(medallion % 107 = 0, 'west', string(dropoff_longitude))"
    values["trip_distance"] = "if(medallion % 109 = 0, 'far', string(trip_distance))"
    whole = f"concat_ws(',', {', '.join(values.values())})"
    line = f"case when medallion % 101 = 0 then substring_index({whole}, ',', 6) when medallion % 113 = 0 then concat({whole}, ',more') else {whole} end"
    path = scratch_path(spark, "trips")
    # one field a line, its name the header
    header = ", ".join(rows.columns)
    rows.selectExpr(f"{line} as `{header}`").write.csv(path, header=True, sep="\u0001", quote="")
    return path


def rejected_trips(spark, folder):
    """Lines that cleaning drops, with the reason."""
    rows = csv.read_trips_checked(spark, _broken_lines(spark, folder))
    return csv.rejected_trips(rows).selectExpr("medallion", "reason", "line is null as readable")


def trips_accounted_for(spark, folder):
    """Rows read, kept and rejected, by reason."""
    rows = csv.read_trips_checked(spark, _broken_lines(spark, folder))
    kinds = csv.rejected_trips(rows).groupBy(F.col("reason").alias("kind")).agg(F.count("*").alias("rows"))
    clean = trips.clean_trips(rows).agg(F.lit("clean").alias("kind"), F.count("*").alias("rows"))
    return kinds.unionByName(clean).unionByName(rows.agg(F.lit("read").alias("kind"), F.count("*").alias("rows")))


def trip_hours_histogram(spark, folder):
    return trips.hours_histogram(_trips(spark, folder))


def trip_hours_quantiles(spark, folder):
    return trips.hours_quantiles(_trips(spark, folder))


def trip_hours_quantiles_approx_ok(spark, folder):
    """Is each approximate quantile's rank within 0.01 of the rows?"""
    rows = _trips(spark, folder)
    ranked = trips.quantile_ranks(rows, trips.hours_quantiles(rows, error=0.01))
    wanted, slack = F.col("probability") * F.col("rows"), 0.01 * F.col("rows")
    near = (F.col("below") <= wanted + slack) & (wanted <= F.col("upto") + slack)
    return ranked.select("probability", "rows", near.alias("ok"))


def plausible_trips(spark, folder):
    return trips.plausible(_trips(spark, folder))


def zone_edges(spark, folder):
    return _edges(spark, folder)


def zone_area(spark, folder):
    return _rounded(zones.area(_edges(spark, folder), "zone"), location_area=9)


def rejected_zones(spark, folder):
    """Zones whose text cannot be used, with the reason."""
    return zones.rejected_zones(fixtures.mixed_zones(spark, folder)).select("zone", "borough", "fault")


def zone_edges_mixed(spark, folder):
    """Edges of zones with holes, several parts, or none, in numbers."""
    return zones.zones_to_edges(fixtures.mixed_zones(spark, folder)).groupBy("zone", "poly_idx", "ring_idx").agg(
        F.count("*").alias("edges"),
        F.sum(F.expr("x1 * 4 + y1")).alias("starts"),
        F.sum(F.expr("x1 * y2 - x2 * y1")).alias("twice_area"),
    )


def zone_area_mixed(spark, folder):
    return zones.area(zones.zones_to_edges(fixtures.mixed_zones(spark, folder)), "zone")


def borough_area(spark, folder):
    return _rounded(zones.area(zones.dissolve(_edges(spark, folder)), "borough"), location_area=9)


def borough_boundary_edges(spark, folder):
    return zones.dissolve(_edges(spark, folder)).drop("net")


def _corners(outlines):
    """The corners of each outline, in order."""
    rings = outlines.select("borough", F.posexplode("polygons").alias("polygon", "rings"))
    vertices = rings.select("borough", "polygon", F.posexplode(F.col("rings")[0]).alias("k", "v"))
    return vertices.select("borough", "polygon", "k", F.col("v")[0].alias("x"), F.col("v")[1].alias("y"))


def borough_polygons(spark, folder):
    """The corners of each region's outline, in order."""
    return _corners(region_polygons(zones.dissolve(_edges(spark, folder))))


def borough_polygons_tjunction(spark, folder):
    """The same where the zones of a region do not share their vertices."""
    edges = zones.zones_to_edges(fixtures.split_zones(spark, folder))
    return _corners(region_polygons(union_edges(edges)))


def borough_area_union(spark, folder):
    """Areas of the regions where zones of two of them overlap their own."""
    edges = zones.zones_to_edges(fixtures.zones(spark, folder, taller=["AFRICA", "ASIA"]))
    return _rounded(union_areas(edges), location_area=9)


def borough_area_overlap(spark, folder):
    """Areas where zones of two regions, stretched upwards, overlap their own."""
    edges = zones.zones_to_edges(fixtures.zones(spark, folder, taller=["AFRICA", "ASIA"]))
    found = overlaps(edges, fit_grid(edges, "borough")[0])
    areas = zones.region_areas(edges, found)
    return _rounded(areas, location_area=9).withColumn("reason", F.col("reason").isNotNull())


def dropoff_located_overlap(spark, folder):
    """Drop-offs where zones of two regions overlap within their region."""
    index = jobs.region_index(fixtures.zones(spark, folder, taller=["AFRICA", "ASIA"]))
    points = _trips(spark, folder).select("trip_id", *DROPOFF)
    return jobs.dropoff_located(points, index).drop(*DROPOFF)


def _on_corners(spark, folder):
    """Points on all zone corners, and halfway between corners of an edge."""
    ends = _edges(spark, folder).selectExpr("x1 as x", "y1 as y", "(x1 + x2) / 2 as u", "(y1 + y2) / 2 as v")
    return ends.select("x", "y").union(ends.select("u", "v")).distinct()


def dropoff_located_seam(spark, folder):
    """Points on borders, inner ones among them, beside regions that overlap."""
    index = jobs.region_index(fixtures.zones(spark, folder, taller=["AFRICA"]))
    return locate.locate(_on_corners(spark, folder), "x", "y", index)


def dropoff_distribution_unnamed(spark, folder):
    """Drop-offs by region where one region has no name, and the split by area."""
    table = fixtures.zones(spark, folder).withColumn("borough", F.nullif("borough", F.lit("ASIA")))
    index, rows = jobs.region_index(table), _trips(spark, folder)
    counts = jobs.dropoff_distribution(rows, index).withColumn("kind", F.lit("region"))
    split = jobs.by_service_area(rows, index).groupBy(F.col("in_service_area").cast("string").alias("borough"))
    return counts.unionByName(split.agg(F.count("*").alias("count")).withColumn("kind", F.lit("inside")))


def dropoff_located(spark, folder):
    points = _trips(spark, folder).select("trip_id", "hack_license", *DROPOFF)
    return jobs.dropoff_located(points, _index(spark, folder)).drop(*DROPOFF)


def dropoff_located_shuffled(spark, folder):
    """The same without broadcasts, as for an index too large for them."""
    points = _trips(spark, folder).select("trip_id", "hack_license", *DROPOFF)
    index = _index(spark, folder).shuffled()
    return jobs.dropoff_located(points, index).drop(*DROPOFF)


def dropoff_located_exact(spark, folder):
    """Places so near to borders that doubles do not tell their side."""
    index = jobs.region_index(fixtures.vast_zones(spark, folder))
    return locate.locate(fixtures.border_places(spark, folder), "x", "y", index).select("place_id", "borough")


def dropoff_located_tall(spark, folder):
    """Drop-offs where all borders are as tall as the map."""
    index = jobs.region_index(fixtures.tall_zones(spark, folder))
    return jobs.dropoff_located(_trips(spark, folder).select("trip_id", *DROPOFF), index).drop(*DROPOFF)


def dropoff_preview(spark, folder):
    return trips.preview(dropoff_located(spark, folder), ["trip_id", "borough"])


def dropoff_distribution(spark, folder):
    return jobs.dropoff_distribution(_trips(spark, folder), _index(spark, folder))


def jagged_distribution(spark, folder):
    """Drop-offs by region where each region's border has thousands of edges."""
    index = locate.build_index(fixtures.jagged_edges(spark, folder))
    return jobs.dropoff_distribution(_trips(spark, folder), index)


def trips_inside(spark, folder):
    found = jobs.by_service_area(_trips(spark, folder), _index(spark, folder))
    return found.where("in_service_area").drop("in_service_area")


def trips_outside(spark, folder):
    found = jobs.by_service_area(_trips(spark, folder), _index(spark, folder))
    return found.where("not in_service_area").drop("in_service_area")


def points_not_in(spark, folder):
    """Trips whose drop-off point is none of those outside the regions."""
    return regions.not_in(_trips(spark, folder), trips_outside(spark, folder), DROPOFF)


def points_not_in_null(spark, folder):
    """Rows NOT IN keeps of the raw trips, some without latitude, beside a list
    without missing values, one with them, and an empty one."""
    rows = fixtures.trips_raw(spark, folder).select(
        "trip_id", *[F.nanvl(c, F.lit(None)).alias(c) for c in DROPOFF]
    )
    far = rows.where("dropoff_longitude > 5")
    lists = {"complete": far.dropna(), "with missing": far, "empty": far.limit(0)}
    counts = None
    for name, listed in lists.items():
        count = regions.not_in(rows, listed, DROPOFF).agg(
            F.lit(name).alias("list"), F.count("*").alias("kept")
        )
        counts = count if counts is None else counts.unionByName(count)
    return counts


def unknown_regions(spark, folder):
    """Regions trips end in that a zone table without ASIA and EUROPE lacks."""
    ends = dropoff_distribution(spark, folder)
    known = regions.rows_of_regions(
        fixtures.zones(spark, folder), ["AFRICA", "AMERICA", "MIDDLE EAST"]
    )
    return regions.unknown_regions(ends, known)


def trips_of_regions(spark, folder):
    return regions.rows_of_regions(dropoff_located(spark, folder), ["ASIA", "EUROPE"])


def trips_view(spark, folder):
    """Trips and hours by driver, asked of a temporary view in SQL."""
    plausible_trips(spark, folder).createOrReplaceTempView("curbwait_trips")
    return spark.sql(
        "select hack_license, count(*) as trips, sum(trip_in_hours) as hours "
        "from curbwait_trips group by hack_license"
    )


def sessions_layout(spark, folder):
    """By driver: trips, slices, and as they lie in the partitions, are the trips of
    each slice side by side and in order?"""
    laid = next_fare.sessions_layout(_trips(spark, folder)).withColumns(
        {"part": F.spark_partition_id(), "at": F.monotonically_increasing_id()}
    )
    # the place in the partition is numbered before any other shuffle
    held = laid.groupBy("hack_license", "slice").agg(
        F.count("*").alias("n"),
        (F.max("at") - F.min("at") + 1).alias("span"),
        F.array_sort(F.collect_list(F.struct("at", F.struct(*TRIP_ORDER).alias("key")))).alias("rows"),
    )
    in_order = F.expr("transform(rows, r -> r.key) = array_sort(transform(rows, r -> r.key))")
    return held.groupBy("hack_license").agg(
        F.sum("n").alias("trips"),
        F.count("*").alias("slices"),
        F.every(F.col("n") == F.col("span")).alias("together"),
        F.every(in_order).alias("in_order"),
    )


def next_fare_gaps(spark, folder):
    return next_fare.positive_gaps(_gaps(spark, folder))


def next_fare_bucketed(spark, folder):
    """The gaps, paired from the bucketed tables."""
    name = f"curbwait_sessions_{uuid.uuid4().hex}"
    likely = trips.plausible(_trips(spark, folder)).drop("trip_in_hours")
    session_store.store_bucketed(likely, name, scratch_path(spark, "buckets"), buckets=8)
    return next_fare.positive_gaps(session_store.next_fare_bucketed(spark, name))


def next_fare_appended(spark, folder):
    """The gaps after three files, whose trips lie before and among those held too."""
    likely = trips.plausible(_trips(spark, folder)).drop("trip_in_hours")
    files = session_store.SessionFiles(spark, scratch_path(spark, "sessions"))
    day = "pickup_datetime div 86400"
    for part in (f"trip_id % 10 <> 0 and {day} % 5 < 2", f"trip_id % 10 <> 0 and {day} % 5 >= 2", "trip_id % 10 = 0"):
        files.append(likely.where(part))
    return next_fare.positive_gaps(files.next_fare())


def gap_quality(spark, folder):
    return next_fare.gap_quality(_gaps(spark, folder))


def next_fare_hot_driver(spark, folder):
    """Gaps by driver where one driver has a third of all trips, many of them at
    the same time."""
    rows = _trips(spark, folder)
    shared = F.when(F.col("trip_id") % 3 == 0, 0).otherwise(F.col("hack_license"))
    hour = F.floor(F.col("pickup_datetime") / 3600) * 3600
    skewed = rows.withColumns({"hack_license": shared, "pickup_datetime": hour})
    gaps = next_fare.next_fare(skewed)
    gap = F.col("next_fare_duration")

    def steps(name):
        return F.round(F.col(name) * 10000).cast("bigint")

    return gaps.groupBy("hack_license").agg(
        F.count("*").alias("trips"),
        F.count_if(gap.isNull()).alias("last_trips"),
        F.count_if(gap > 0).alias("positive_gaps"),
        F.sum(gap).alias("seconds"),
        F.sum(steps("lead_pickup_longitude") * steps("dropoff_latitude")).alias("next_longitudes"),
        F.sum(steps("lead_pickup_latitude") * steps("dropoff_longitude")).alias("next_latitudes"),
    )


def od_gaps(spark, folder):
    located = jobs.od_gaps(next_fare_gaps(spark, folder), _index(spark, folder))
    return located.select(
        "trip_id",
        "hack_license",
        "pickup_datetime",
        "dropoff_datetime",
        "next_fare_duration",
        "dropoff_borough",
        "next_pickup_borough",
    )


def idle_by_region(spark, folder):
    report = jobs.idle_report(_trips(spark, folder), _index(spark, folder))
    return _rounded(report, average_duration=6, deviation_duration=4)


def idle_by_region_shuffled(spark, folder):
    """The same without broadcasts, as for an index too large for them."""
    report = jobs.idle_report(_trips(spark, folder), _index(spark, folder).shuffled())
    return _rounded(report, average_duration=6, deviation_duration=4)


def choropleth_classes(spark, folder):
    return regions.quantile_classes(idle_by_region(spark, folder), "average_duration")


def choropleth_geojson(spark, folder):
    """The map written as text, and what its features hold when read back."""
    drawn = jobs.choropleth(idle_by_region(spark, folder), fixtures.zones(spark, folder))
    path = scratch_path(spark, "map")
    sinks.write_features(drawn, path)

    def part(name):
        return F.get_json_object("value", f"$.{name}")

    polygons = F.from_json(part("geometry.coordinates"), "array<array<array<array<double>>>>")
    return spark.read.text(path).select(
        part("properties.dropoff_borough").alias("dropoff_borough"),
        part("properties.class").cast("int").alias("class"),
        part("geometry.type").alias("geometry"),
        F.size(polygons).alias("polygons"),
        F.aggregate(
            F.transform(F.flatten(F.flatten(polygons)), lambda v, k: (k + 1) * (v[0] * 3 + v[1])),
            F.lit(0.0),
            lambda total, term: total + term,
        ).alias("coordinates"),
    )


def choropleth_simplified(spark, folder):
    """Outlines, bent so that no corner is in line with its neighbours, whose edges were
    cut in half, simplified: the corners they had before."""
    bent = [f"x{k} + y{k} * y{k} / 64 as x{k}" for k in (1, 2)]
    edges = zones.dissolve(_edges(spark, folder)).selectExpr("borough", *bent, "y1", "y2", "net")
    middle = "(x1 + x2) / 2 as mx", "(y1 + y2) / 2 as my"
    halves = edges.selectExpr("*", *middle).selectExpr(
        "borough", "inline(array(struct(x1, y1, mx as x2, my as y2), struct(mx as x1, my as y1, x2, y2)))", "net"
    )
    return simplified(halves, 1e-12).drop("net")


def report_written(spark, folder):
    """The report written as a table and read back."""
    path = scratch_path(spark, "report")
    sinks.write_table(idle_by_region(spark, folder), path)
    return spark.read.parquet(path)


def analysis(spark, folder):
    """The whole analysis from files: the trips and zones written and read."""
    out = scratch_path(spark, "analysis")
    report = analyse(spark, _written_trips(spark, folder), _written_zones(spark, folder), out)
    return _rounded(report, average_duration=6, deviation_duration=4)


def analysis_tables(spark, folder):
    """Rows of each table the whole analysis writes, service area only."""
    out = scratch_path(spark, "analysis")
    analyse(
        spark, _written_trips(spark, folder), _written_zones(spark, folder), out, service_area_only=True
    )
    sizes = None
    for name in ("trips", "dropoffs", "paired_trips", "idle_trips", "rejected_zones", "unknown_regions"):
        size = spark.read.parquet(f"{out}/{name}").agg(
            F.lit(name).alias("table"), F.count("*").alias("rows")
        )
        sizes = size if sizes is None else sizes.unionByName(size)
    return sizes


ALL = [
    clean_trips,
    csv_roundtrip,
    header_check,
    zones_csv,
    zones_csv_inferred,
    boroughs_csv,
    trip_summary,
    trip_profile_merged,
    trip_profile_ranks,
    rejected_trips,
    trips_accounted_for,
    trip_hours_histogram,
    trip_hours_quantiles,
    trip_hours_quantiles_approx_ok,
    plausible_trips,
    zone_edges,
    zone_area,
    rejected_zones,
    zone_edges_mixed,
    zone_area_mixed,
    borough_area,
    borough_boundary_edges,
    borough_polygons,
    borough_polygons_tjunction,
    borough_area_union,
    borough_area_overlap,
    dropoff_located,
    dropoff_located_shuffled,
    dropoff_located_exact,
    dropoff_located_tall,
    dropoff_preview,
    dropoff_distribution,
    dropoff_distribution_unnamed,
    dropoff_located_overlap,
    dropoff_located_seam,
    jagged_distribution,
    trips_inside,
    trips_outside,
    points_not_in,
    points_not_in_null,
    unknown_regions,
    trips_of_regions,
    trips_view,
    sessions_layout,
    next_fare_gaps,
    next_fare_bucketed,
    next_fare_appended,
    gap_quality,
    next_fare_hot_driver,
    od_gaps,
    idle_by_region,
    idle_by_region_shuffled,
    choropleth_classes,
    choropleth_geojson,
    choropleth_simplified,
    report_written,
    analysis,
    analysis_tables,
]
