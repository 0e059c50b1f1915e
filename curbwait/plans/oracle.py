"""The queries in plain SQL: nested loops over edges built from the corners."""

TRIPS = """
    trips as (
        select event_id as trip_id,
               user_id as hack_license,
               floor(epoch(ts))::bigint as pickup_datetime,
               floor(epoch(ts))::bigint + round(value * 100)::bigint - 120 as dropoff_datetime,
               ((event_id * 7919) % 5600 + 0.5::double) / 1000 as pickup_longitude,
               ((event_id * 10473) % 5300 + 0.5::double) / 1000 as pickup_latitude,
               ((event_id * 6007) % 5600 + 0.5::double) / 1000 as dropoff_longitude,
               ((event_id * 3571) % 5300 + 0.5::double) / 1000 as dropoff_latitude
        from events
    )"""

RAW = """
    raw as (
        select trip_id, hack_license, pickup_datetime,
               case when trip_id % 101 <> 0 then dropoff_datetime end as dropoff_datetime,
               case when trip_id % 97 <> 0 then pickup_longitude end as pickup_longitude,
               pickup_latitude, dropoff_longitude,
               case when trip_id % 103 = 0 then 'nan'::double else dropoff_latitude end as dropoff_latitude
        from trips
    )"""

CLEAN = f"""{TRIPS}, {RAW},
    clean as (
        select * from raw
        where dropoff_datetime is not null and pickup_longitude is not null
          and not isnan(dropoff_latitude)
    )"""

HOURS = f"""{TRIPS},
    timed as (
        select *, floor((dropoff_datetime - pickup_datetime) / 3600.0)::integer as trip_in_hours
        from trips
    ),
    plausible as (select * from timed where trip_in_hours >= 0 and trip_in_hours < 4)"""

EDGES = """
    corners as (
        select n_name as zone, r_name as borough, k,
               (n_regionkey + i) + (((n_regionkey + i) * 3 + (n_nationkey // 5 + j) * 5) % 3 - 1) * 0.125::double as x,
               (n_nationkey // 5 + j) + (((n_regionkey + i) * 5 + (n_nationkey // 5 + j) * 2) % 3 - 1) * 0.125::double as y
        from nation join region on n_regionkey = r_regionkey,
             (values (0, 0, 0), (1, 1, 0), (2, 1, 1), (3, 0, 1), (4, 0, 0)) as turn(k, i, j)
    ),
    steps as (
        select zone, borough, k, x as x1, y as y1,
               lead(x) over (partition by zone order by k) as x2,
               lead(y) over (partition by zone order by k) as y2
        from corners
    ),
    edges as (select * from steps where k < 4)"""

def edges_where(taller: str) -> str:
    """The edges, the upper corners of some regions' zones half a cell higher."""
    return EDGES.replace(
        "% 3 - 1) * 0.125::double as y", f"% 3 - 1) * 0.125::double + case when {taller} then j * 0.5 else 0 end as y"
    )


def in_some_zone(points: str, key: str, x: str, y: str) -> str:
    """(key, borough) for points with a zone of the borough on every side of them: the
    point moved a little in 16 directions is strictly inside one each time."""
    return f"""
    moved as (
        select {key}, way, {x} + 1e-6 * cos(0.1 + way * pi() / 8) as mx, {y} + 1e-6 * sin(0.1 + way * pi() / 8) as my
        from {points}, range(16) as turn(way)
    ),
    hits as (
        select distinct {key}, way, borough
        from (
            select {key}, way, zone, borough
            from moved, edges
            where least(y1, y2) <= my and my < greatest(y1, y2)
              and (x2 - x1) * (my - y1) / (y2 - y1) + x1 > mx
            group by all having count(*) % 2 = 1
        )
    ),
    held as (select {key}, borough from hits group by all having count(*) = 16)"""


BOUNDARY = f"""{EDGES},
    boundary as (
        select borough, min(x1) as x1, min(y1) as y1, min(x2) as x2, min(y2) as y2
        from edges
        group by borough, least(x1, x2), greatest(x1, x2), least(y1, y2), greatest(y1, y2),
                 (x2 > x1) = (y2 > y1)
        having count(*) = 1
    ),
    borders as (
        select borough,
               case when y1 <= y2 then x1 else x2 end as low_x, least(y1, y2) as low_y,
               case when y1 <= y2 then x2 else x1 end as high_x, greatest(y1, y2) as high_y
        from boundary
    )"""


OUTLINE = f"""{BOUNDARY},
    outline as (
        with recursive walk(borough, k, x, y, qx, qy) as (
            select borough, 0, x1, y1, x2, y2 from boundary b
            where (x1, y1) = (select (x1, y1) from boundary c where c.borough = b.borough order by x1, y1 limit 1)
            union all
            select w.borough, k + 1, x1, y1, x2, y2
            from walk w join boundary b on b.borough = w.borough and x1 = qx and y1 = qy
            where k < (select count(*) from boundary c where c.borough = w.borough)
        )
        select borough, k, x, y from walk
    )"""


#: The regions' borders where inner ones have vertices that do not match.
SPOTS = """
    spots as (
        select r_name as borough, i, j,
               (r_regionkey + i) + (((r_regionkey + i) * 3 + j * 5) % 3 - 1) * 0.125::double as x,
               j + (((r_regionkey + i) * 5 + j * 2) % 3 - 1) * 0.125::double as y
        from region, range(2) as across(i), range(6) as up(j)
    ),
    boundary as (
        select a.borough, a.x as x1, a.y as y1, b.x as x2, b.y as y2
        from spots a join spots b on a.borough = b.borough
            and (a.i = 0 and b.i = 1 and a.j = 0 and b.j = 0 or a.i = 1 and b.i = 1 and b.j = a.j + 1
                 or a.i = 1 and b.i = 0 and a.j = 5 and b.j = 5 or a.i = 0 and b.i = 0 and b.j = a.j - 1)
    )"""

#: Area of each region by slabs between the heights at which its zones' edges end or
#: cross; zones are convex, so each has one stretch at the middle of a slab.
SLABS = """
    heights as (
        select borough, y1 as h from edges
        union
        select a.borough,
               a.y1 + ((b.x1 - a.x1) * (b.y2 - b.y1) - (b.y1 - a.y1) * (b.x2 - b.x1))
                      / ((a.x2 - a.x1) * (b.y2 - b.y1) - (a.y2 - a.y1) * (b.x2 - b.x1)) * (a.y2 - a.y1)
        from edges a join edges b on a.borough = b.borough and a.zone < b.zone
            and ((a.x2 - a.x1) * (b.y1 - a.y1) - (b.x1 - a.x1) * (a.y2 - a.y1))
                * ((a.x2 - a.x1) * (b.y2 - a.y1) - (b.x2 - a.x1) * (a.y2 - a.y1)) < 0
            and ((b.x2 - b.x1) * (a.y1 - b.y1) - (a.x1 - b.x1) * (b.y2 - b.y1))
                * ((b.x2 - b.x1) * (a.y2 - b.y1) - (a.x2 - b.x1) * (b.y2 - b.y1)) < 0
    ),
    slabs as (
        select borough, h, lead(h) over (partition by borough order by h) as up from heights
    ),
    stretches as (
        select s.borough, h, up, zone, min(x1 + ((h + up) / 2 - y1) / (y2 - y1) * (x2 - x1)) as a,
               max(x1 + ((h + up) / 2 - y1) / (y2 - y1) * (x2 - x1)) as b
        from slabs s join edges e on s.borough = e.borough and least(y1, y2) < (h + up) / 2 and (h + up) / 2 < greatest(y1, y2)
        group by all
    ),
    reached as (
        select *, max(b) over (partition by borough, h order by a, b rows between unbounded preceding and 1 preceding) as far
        from stretches
    )"""


#: Rings of the mixed zones: squares from low to high, a hole the other way around.
MIXED = """
    mixed as (
        select n_name as zone, n_nationkey * 2::double as c, n_regionkey * 2::double as r, poly_idx, ring_idx, low, high, way
        from nation join (values (0, 0, 0, 0::double, 1::double, 1), (0, 0, 1, 0.25, 0.75, -1), (1, 0, 0, 0, 0.5, 1),
                                 (1, 1, 0, 0.75, 1, 1), (2, 0, 0, 0, 1, 1)) as s(kind, poly_idx, ring_idx, low, high, way)
             on n_nationkey % 6 = kind
    )"""


def located(points: str, key: str, x: str, y: str, name: str) -> str:
    """A table of (key, borough) for points strictly inside a boundary."""
    return f"""
    {name} as (
        select {key}, borough
        from (
            select {key}, borough, {y} >= low_y and {y} <= high_y as level, {y} < high_y as below_top,
                   {x} between least(low_x, high_x) and greatest(low_x, high_x) as beside,
                   (high_x - low_x) * ({y} - low_y) - ({x} - low_x) * (high_y - low_y) as side
            from {points}, borders
        )
        group by {key}, borough
        having count(*) filter (level and below_top and side > 0) % 2 = 1
           and not bool_or(level and beside and side = 0)
    )"""


ENDS = f"""{TRIPS}, {BOUNDARY}, {located("trips", "trip_id", "dropoff_longitude", "dropoff_latitude", "ends")}"""



def paired(source: str) -> str:
    return f"""
    paired as (
        select *,
               lead(pickup_datetime) over driver - dropoff_datetime as next_fare_duration,
               lead(pickup_longitude) over driver as lead_pickup_longitude,
               lead(pickup_latitude) over driver as lead_pickup_latitude
        from {source}
        window driver as (
            partition by hack_license
            order by pickup_datetime, dropoff_datetime, pickup_longitude, pickup_latitude,
                     dropoff_longitude, dropoff_latitude
        )
    ),
    gaps as (select * from paired where next_fare_duration > 0)"""


PAIRED = f"""{HOURS}, {paired("plausible")}"""

SERVED = f"""{HOURS}, {BOUNDARY},
    {located("plausible", "trip_id", "dropoff_longitude", "dropoff_latitude", "ends")},
    served as (select * from plausible where trip_id in (select trip_id from ends)),
    {paired("served")},
    {located("gaps", "trip_id", "lead_pickup_longitude", "lead_pickup_latitude", "nexts")}"""

OD = f"""{PAIRED}, {BOUNDARY},
    {located("gaps", "trip_id", "dropoff_longitude", "dropoff_latitude", "ends")},
    {located("gaps", "trip_id", "lead_pickup_longitude", "lead_pickup_latitude", "nexts")},
    od as (
        select gaps.*, next_fare_duration // 60 as minutes,
               ends.borough as dropoff_borough, nexts.borough as next_pickup_borough
        from gaps join ends using (trip_id) join nexts using (trip_id)
    )"""

IDLE = f"""{OD},
    idle as (
        select dropoff_borough,
               round(avg(minutes), 6) as average_duration,
               round(stddev_samp(minutes), 4) as deviation_duration
        from od group by dropoff_borough
    )"""

ZONE_TEXT = """
    texts as (
        select zone, borough,
               'MULTIPOLYGON (((' || string_agg(x::varchar || ' ' || y::varchar, ', ' order by k) || ')))' as the_geom
        from corners group by zone, borough
    ),
    areas as (
        select zone, abs(sum(x1 * y2 - x2 * y1)) / 2 as area from edges group by zone
    )"""

STAMPS = """make_timestamp(pickup_datetime * 1000000) as pickup_datetime,
           make_timestamp(dropoff_datetime * 1000000) as dropoff_datetime"""

CLASSED = f"""{IDLE},
    bounds as (
        select quantile_cont(average_duration, 0.2) as b1, quantile_cont(average_duration, 0.4) as b2,
               quantile_cont(average_duration, 0.6) as b3, quantile_cont(average_duration, 0.8) as b4
        from idle
    ),
    classed as (
        select idle.*,
               (average_duration > b1)::integer + (average_duration > b2)::integer
               + (average_duration > b3)::integer + (average_duration > b4)::integer as class
        from idle, bounds
    )"""


def _each_column(table: str, names: list[str]) -> str:
    return " union all ".join(
        f"""select '{c}' as column_name, count({c}) as count, round(avg({c}), 3) as mean,
                   round(stddev_samp({c}), 3) as stddev, min({c})::double as min, max({c})::double as max
            from {table}"""
        for c in names
    )


ALL = {
    "clean_trips": f"""with {CLEAN}
        select trip_id, hack_license, pickup_datetime, dropoff_datetime,
               pickup_longitude as pickup_x, pickup_latitude as pickup_y,
               dropoff_longitude as dropoff_x, dropoff_latitude as dropoff_y
        from clean""",
    "csv_roundtrip": f"""with {TRIPS}
        select trip_id::varchar as medallion, pickup_longitude as trip_distance,
               trips.* exclude (trip_id) replace (hack_license::varchar as hack_license)
        from trips""",
    "header_check": """
        select header, accepted, (select count(*) from events) as rows
        from (values ('plain', true), ('blanks', true), ('renamed', false)) as h(header, accepted)""",
    "zones_csv": f"""with {EDGES}, {ZONE_TEXT}
        select 1.5::double as "Shape_Leng", the_geom, area as "Shape_Area", zone, borough
        from texts join areas using (zone)""",
    "zones_csv_inferred": f"""with {EDGES}, {ZONE_TEXT}
        select 1.5::double as "Shape_Leng", the_geom, area as "Shape_Area", zone, borough
        from texts join areas using (zone)""",
    "boroughs_csv": f"""with {EDGES}, {ZONE_TEXT}
        select borough, the_geom, 1.5::double as "Shape_Leng", area as "Shape_Area"
        from texts join areas using (zone)""",
    "trip_summary": f"""with {CLEAN} """
    + _each_column(
        "clean",
        [
            "hack_license",
            "pickup_datetime",
            "dropoff_datetime",
            "pickup_longitude",
            "pickup_latitude",
            "dropoff_longitude",
            "dropoff_latitude",
        ],
    ),
    "trip_hours_histogram": f"""with {HOURS}
        select trip_in_hours, count(*) as count from timed group by trip_in_hours""",
    "trip_hours_quantiles": f"""with {HOURS}
        select p::double as probability, q::double as value
        from (
            select unnest([0.25, 0.5, 0.75, 0.97]) as p,
                   unnest(quantile_cont(trip_in_hours, [0.25, 0.5, 0.75, 0.97])) as q
            from timed
        )""",
    "trip_hours_quantiles_approx_ok": f"""with {HOURS}
        select p::double as probability, (select count(*) from timed) as rows, true as ok
        from (values (0.25), (0.5), (0.75), (0.97)) as asked(p)""",
    "plausible_trips": f"""with {HOURS} select * from plausible""",
    "zone_edges": f"""with {EDGES}
        select zone, borough, 0 as poly_idx, 0 as ring_idx, x1, y1, x2, y2 from edges""",
    "zone_area": f"""with {EDGES}
        select zone, round(abs(sum(x1 * y2 - x2 * y1)) / 2, 9) as location_area
        from edges group by zone""",
    "rejected_zones": """
        select n_name as zone, r_name as borough,
               if(n_nationkey % 6 = 4, 'not two coordinates', 'ring not closed') as fault
        from nation join region on n_regionkey = r_regionkey where n_nationkey % 6 >= 4""",
    "zone_edges_mixed": f"""with {MIXED}
        select zone, poly_idx, ring_idx, 4 as edges,
               4 * (4 * c + r) + 10 * (low + high) as starts, way * 2 * (high - low) * (high - low) as twice_area
        from mixed""",
    "zone_area_mixed": f"""with {MIXED}
        select zone, sum(way * (high - low) * (high - low)) as location_area from mixed group by zone""",
    "borough_area": f"""with {EDGES}
        select borough, round(abs(sum(x1 * y2 - x2 * y1)) / 2, 9) as location_area
        from edges group by borough""",
    "borough_boundary_edges": f"""with {BOUNDARY} select * from boundary""",
    "dropoff_located": f"""with {ENDS}
        select trip_id, hack_license, borough from trips join ends using (trip_id)""",
    "dropoff_located_exact": """
        with corners as (
            select r_name as borough, 4503599627370495::hugeint - 1000003 * r_regionkey as px,
                   2251799813685249::hugeint + 77777 * r_regionkey as py, 4503599627370495::hugeint as cy
            from region
        ),
        places as (
            select event_id as place_id,
                   (4503599627370495::hugeint - 1000003 * (event_id % 5)) * (event_id % 1000) // 1000 as x,
                   (2251799813685249::hugeint + 77777 * (event_id % 5)) * (event_id % 1000) // 1000
                       + event_id // 5 % 3 - 1 as y
            from events
        )
        select place_id, borough from places, corners
        where px * y - x * py > 0 and (0 - px) * (y - py) - (x - px) * (cy - py) > 0 and x * cy > 0""",
    "dropoff_located_tall": f"""with {TRIPS},
        lefts as (
            select r_name as borough, n_nationkey * 0.21875::double as x
            from nation join region on n_regionkey = r_regionkey
        ),
        borders as (
            select borough, x as low_x, 0::double as low_y, x + 0.09375 as high_x, 5::double as high_y from lefts
            union all select borough, x + 0.1875, 0, x + 0.09375, 5 from lefts
            union all select borough, x, 0, x + 0.1875, 0 from lefts
        ),
        {located("trips", "trip_id", "dropoff_longitude", "dropoff_latitude", "ends")}
        select * from ends""",
    "dropoff_preview": f"""with {ENDS}
        select trip_id, hack_license, borough from trips join ends using (trip_id)
        order by trip_id, borough limit 10""",
    "dropoff_distribution": f"""with {ENDS}
        select borough, count(*) as count from ends group by borough""",
    "trips_inside": f"""with {ENDS}
        select * from trips where trip_id in (select trip_id from ends)""",
    "trips_outside": f"""with {ENDS}
        select * from trips where trip_id not in (select trip_id from ends)""",
    "points_not_in": f"""with {ENDS}
        select * from trips
        where (dropoff_longitude, dropoff_latitude) not in (
            select (dropoff_longitude, dropoff_latitude) from trips
            where trip_id not in (select trip_id from ends)
        )""",
    "points_not_in_null": f"""with {TRIPS}, {RAW},
        points as (
            select trip_id, dropoff_longitude as x,
                   case when not isnan(dropoff_latitude) then dropoff_latitude end as y
            from raw
        ),
        far as (select distinct x, y from points where x > 5 and y is not null)
        select 'complete' as list,
               (select count(*) from points anti join far using (x, y) where points.y is not null) as kept
        union all
        select 'with missing', (select count(*) from points
                                where not exists (select 1 from points where x > 5 and y is null)
                                  and y is not null and (x, y) not in (select (x, y) from far))
        union all
        select 'empty', (select count(*) from points)""",
    "unknown_regions": f"""with {ENDS}
        select distinct borough from ends where borough not in ('AFRICA', 'AMERICA', 'MIDDLE EAST')""",
    "trips_of_regions": f"""with {ENDS}
        select trip_id, hack_license, borough from trips join ends using (trip_id)
        where borough in ('ASIA', 'EUROPE')""",
    "trips_view": f"""with {HOURS}
        select hack_license, count(*) as trips, sum(trip_in_hours)::bigint as hours
        from plausible group by hack_license""",
    "sessions_layout": f"""with {TRIPS}
        select hack_license, count(*) as trips, count(distinct pickup_datetime // 86400) as slices,
               true as together, true as in_order
        from trips group by hack_license""",
    "dropoff_located_overlap": f"""with {TRIPS}, {edges_where("r_name in ('AFRICA', 'ASIA')")},
        {in_some_zone("trips", "trip_id", "dropoff_longitude", "dropoff_latitude")}
        select * from held""",
    "dropoff_located_seam": f"""with {EDGES.replace("corners as", "flat as").replace("from corners", "from flat")
                                     .replace("steps as", "flat_steps as").replace("from steps", "from flat_steps")
                                     .replace("edges as", "flat_edges as")},
        places as (
            select distinct x, y from (
                select x1 as x, y1 as y from flat_edges union all select (x1 + x2) / 2, (y1 + y2) / 2 from flat_edges)
        ),
        points as (select row_number() over (order by x, y) as p, * from places),
        {edges_where("r_name = 'AFRICA'")}, {in_some_zone("points", "p", "x", "y")}
        select x, y, borough from held join points using (p)""",
    "borough_polygons": f"""with recursive {OUTLINE}
        select borough, 0 as polygon, k, x, y from outline""",
    "borough_polygons_tjunction": f"""with recursive {OUTLINE.replace(BOUNDARY, SPOTS)}
        select borough, 0 as polygon, k, x, y from outline""",
    "borough_area_union": f"""with {edges_where("r_name in ('AFRICA', 'ASIA')")}, {SLABS}
        select borough, round(sum((up - h) * greatest(0, b - greatest(a, coalesce(far, a)))), 9) as location_area
        from reached group by borough""",
    "jagged_distribution": f"""with {TRIPS},
        corners as (
            select r_name as borough, k, 0.3::double + ((k * 7919 + r_regionkey * 1049) % 1000) / 5000.0::double as reach,
                   r_regionkey
            from region, range(4000) as turn(k)
        ),
        places as (
            select borough, k, round(r_regionkey + 0.5::double + reach * cos(2 * pi() * k / 4000), 9) as x,
                   round(2.5::double + 5 * reach * sin(2 * pi() * k / 4000), 9) as y
            from corners
        ),
        jagged as (
            select a.borough, a.x as x1, a.y as y1, b.x as x2, b.y as y2
            from places a join places b on a.borough = b.borough and b.k = (a.k + 1) % 4000
        ),
        found as (
            select trip_id, borough
            from trips join jagged on least(y1, y2) <= dropoff_latitude and dropoff_latitude < greatest(y1, y2)
                and (x2 - x1) * (dropoff_latitude - y1) / (y2 - y1) + x1 > dropoff_longitude
            group by all having count(*) % 2 = 1
        )
        select borough, count(*) as count from found group by borough""",
    "borough_area_overlap": f"""with {EDGES}
        select borough, case when borough not in ('AFRICA', 'ASIA') then round(abs(sum(x1 * y2 - x2 * y1)) / 2, 9) end
               as location_area, borough in ('AFRICA', 'ASIA') as reason
        from edges group by borough""",
    "dropoff_distribution_unnamed": f"""with {ENDS}
        select nullif(borough, 'ASIA') as borough, count(*) as count, 'region' as kind from ends group by borough
        union all
        select (trip_id in (select trip_id from ends))::varchar, count(*), 'inside' from trips group by 1""",
    "next_fare_gaps": f"""with {PAIRED}
        select trip_id, hack_license, {STAMPS}, pickup_longitude, pickup_latitude,
               dropoff_longitude, dropoff_latitude, lead_pickup_longitude, lead_pickup_latitude,
               next_fare_duration
        from gaps""",
    "gap_quality": f"""with {PAIRED}
        select count(*) filter (next_fare_duration is null) as last_trips,
               count(*) filter (next_fare_duration < 0) as negative_gaps,
               count(*) filter (next_fare_duration = 0) as zero_gaps,
               count(*) filter (next_fare_duration > 0) as positive_gaps
        from paired""",
    "next_fare_hot_driver": f"""with {TRIPS},
        skewed as (
            select trips.* replace (
                case when trip_id % 3 = 0 then 0 else hack_license end as hack_license,
                pickup_datetime // 3600 * 3600 as pickup_datetime)
            from trips
        ),
        paired as (
            select *, lead(pickup_datetime) over driver - dropoff_datetime as gap,
                   lead(pickup_longitude) over driver as x, lead(pickup_latitude) over driver as y
            from skewed
            window driver as (
                partition by hack_license
                order by pickup_datetime, dropoff_datetime, pickup_longitude, pickup_latitude,
                         dropoff_longitude, dropoff_latitude
            )
        )
        select hack_license, count(*) as trips,
               count(*) filter (gap is null) as last_trips,
               count(*) filter (gap > 0) as positive_gaps,
               sum(gap)::bigint as seconds,
               sum(round(x * 10000)::bigint * round(dropoff_latitude * 10000)::bigint)::bigint as next_longitudes,
               sum(round(y * 10000)::bigint * round(dropoff_longitude * 10000)::bigint)::bigint as next_latitudes
        from paired group by hack_license""",
    "od_gaps": f"""with {OD}
        select trip_id, hack_license, {STAMPS}, minutes as next_fare_duration,
               dropoff_borough, next_pickup_borough
        from od""",
    "idle_by_region": f"""with {IDLE} select * from idle""",
    "choropleth_classes": f"""with {CLASSED} select * from classed""",
    "choropleth_geojson": f"""with recursive {CLASSED.replace(BOUNDARY, OUTLINE)}
        select dropoff_borough, class, 'MultiPolygon' as geometry, 1 as polygons, coordinates
        from classed join (
            select borough, sum((k + 1) * (x * 3 + y)) as coordinates from outline group by borough
        ) on borough = dropoff_borough""",
}
ALL["analysis_tables"] = f"""with {SERVED}
    select 'trips' as "table", (select count(*) from trips) as rows
    union all select 'dropoffs', (select count(distinct borough) from ends)
    union all select 'paired_trips', (select count(*) from served)
    union all select 'idle_trips', (select count(*) from nexts)
    union all select 'rejected_zones', 0
    union all select 'unknown_regions', 0"""
BROKEN = f"""{TRIPS},
    broken as (
        select trip_id::varchar as medallion,
               case when trip_id % 101 = 0 then 'short line' when trip_id % 97 = 0 then 'bad pickup_datetime'
                    when trip_id % 103 = 0 then 'missing pickup_latitude'
                    when trip_id % 107 = 0 then 'bad dropoff_longitude' end as reason,
               trip_id % 97 <> 0 and trip_id % 101 <> 0 and trip_id % 107 <> 0 and trip_id % 109 <> 0
                   and trip_id % 113 <> 0 as readable
        from trips
    )"""
ALL["rejected_trips"] = f"with {BROKEN} select * from broken where reason is not null"
ALL["trips_accounted_for"] = f"""with {BROKEN}
    select coalesce(reason, 'clean') as kind, count(*) as rows from broken group by 1
    union all select 'read', count(*) from trips"""
ALL["trip_profile_merged"] = f"""with {CLEAN},
    hours as (select *, floor((dropoff_datetime - pickup_datetime) / 3600.0)::integer as trip_in_hours from clean)
    """ + _each_column(
    "hours",
    [
        "hack_license",
        "pickup_datetime",
        "dropoff_datetime",
        "pickup_longitude",
        "pickup_latitude",
        "dropoff_longitude",
        "dropoff_latitude",
        "trip_in_hours",
    ],
)
ALL["trip_profile_ranks"] = f"""with {CLEAN}
    select p::double as probability, (select count(*) from clean) as rows, true as ok
    from (values (0.05), (0.25), (0.5), (0.75), (0.97)) as asked(p)"""
ALL["choropleth_simplified"] = f"""with {BOUNDARY}
    select borough, x1 + y1 * y1 / 64 as x1, y1, x2 + y2 * y2 / 64 as x2, y2 from boundary"""
ALL["next_fare_bucketed"] = ALL["next_fare_appended"] = ALL["next_fare_gaps"]
ALL["analysis"] = ALL["idle_by_region"]
ALL["dropoff_located_shuffled"] = ALL["dropoff_located"]
ALL["idle_by_region_shuffled"] = ALL["idle_by_region"]
ALL["report_written"] = ALL["idle_by_region"]
