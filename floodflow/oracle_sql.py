"""DuckDB SQL twins of the registered queries (the correctness oracle).

They read the driver's tables directly and apply the same fixed derivation
rules as ``floodflow.sources.tables``. Nearest neighbours are computed here by
brute force (every pair), which is what makes them an independent check of
the grid search on the Spark side. Literals that meet doubles are written as
DOUBLE casts so both engines compute identical IEEE values.
"""

from __future__ import annotations

BASE = """
places AS (
  SELECT c_custkey AS id, c_name AS name, c_custkey * 13 + 7 AS population,
         CASE WHEN c_mktsegment = 'BUILDING' THEN 'city' ELSE 'town' END AS place,
         CAST((c_custkey * 6151) % 1800 AS DOUBLE) / CAST(100 AS DOUBLE) + CAST(40 AS DOUBLE) AS lat,
         CAST((c_custkey * 3571) % 3600 AS DOUBLE) / CAST(100 AS DOUBLE) AS lon
  FROM customer),
places_c AS (
  SELECT *, CAST(floor(lat / CAST(0.5 AS DOUBLE)) AS BIGINT) AS cy,
            CAST(floor(lon / CAST(0.5 AS DOUBLE)) AS BIGINT) AS cx
  FROM places),
harbours AS (
  SELECT -s_suppkey AS hid,
         CAST((s_suppkey * 4093) % 1800 AS DOUBLE) / CAST(100 AS DOUBLE) + CAST(40 AS DOUBLE) AS lat,
         CAST((s_suppkey * 2741) % 3600 AS DOUBLE) / CAST(100 AS DOUBLE) AS lon
  FROM supplier),
elev AS (
  SELECT CAST((o_orderkey * 7919) % 1800 AS DOUBLE) / CAST(100 AS DOUBLE) + CAST(40 AS DOUBLE) AS lat,
         CAST((o_orderkey * 104729) % 3600 AS DOUBLE) / CAST(100 AS DOUBLE) AS lon,
         CAST((o_orderkey * 31) % 40 AS INTEGER) - 5 AS elevation
  FROM orders),
cell_elev AS (
  SELECT CAST(floor(lat / CAST(0.5 AS DOUBLE)) AS BIGINT) AS cy,
         CAST(floor(lon / CAST(0.5 AS DOUBLE)) AS BIGINT) AS cx,
         avg(elevation) AS avg_elevation
  FROM elev GROUP BY 1, 2),
safe AS (SELECT cy, cx FROM cell_elev WHERE avg_elevation >= 12),
to_relocate AS (
  SELECT p.id, p.population, p.lat, p.lon FROM places_c p
  WHERE NOT EXISTS (SELECT 1 FROM safe s WHERE s.cy = p.cy AND s.cx = p.cx)),
safe_cities AS (
  SELECT p.id AS destinationId, p.name AS destination, p.population AS destinationPopulation, p.lat, p.lon
  FROM places_c p JOIN safe s ON s.cy = p.cy AND s.cx = p.cx
  WHERE p.place = 'city'),
city_pairs AS (
  SELECT t.id, c.destinationId,
         (c.lat - t.lat) * (c.lat - t.lat) + (c.lon - t.lon) * (c.lon - t.lon) AS d
  FROM to_relocate t, safe_cities c),
nearest_city AS (
  SELECT id, destinationId, d AS cityDistance
  FROM (SELECT *, min(d) OVER (PARTITION BY id) AS m FROM city_pairs) WHERE d = m),
harbour_pairs AS (
  SELECT t.id, (h.lat - t.lat) * (h.lat - t.lat) + (h.lon - t.lon) * (h.lon - t.lon) AS d
  FROM to_relocate t, harbours h),
nearest_harbour AS (
  SELECT id, d AS harbourDistance
  FROM (SELECT *, min(d) OVER (PARTITION BY id) AS m FROM harbour_pairs) WHERE d = m),
combined AS (
  SELECT nc.id, t.population, nc.destinationId, nc.cityDistance, nh.harbourDistance
  FROM nearest_city nc JOIN nearest_harbour nh ON nc.id = nh.id JOIN to_relocate t ON t.id = nc.id),
reloc_rows AS (
  SELECT id, population AS num_evacuees, destinationId FROM combined
  WHERE NOT (harbourDistance < cityDistance)
  UNION ALL
  SELECT id, CAST(round(population * CAST(0.75 AS DOUBLE)) AS BIGINT), destinationId FROM combined
  WHERE harbourDistance < cityDistance
  UNION ALL
  SELECT id, CAST(round(population * CAST(0.25 AS DOUBLE)) AS BIGINT), CAST(-1 AS BIGINT) FROM combined
  WHERE harbourDistance < cityDistance)
"""


def with_base(body: str) -> str:
    return "WITH " + BASE.strip() + "\n" + body.strip()


SQL: dict[str, str] = {}

SQL["cell_elevation"] = with_base("SELECT cy, cx, avg_elevation FROM cell_elev")
SQL["places_to_relocate"] = with_base("SELECT id, population, lat, lon FROM to_relocate")
SQL["safe_cities"] = with_base(
    "SELECT destinationId, destination, destinationPopulation, lat, lon FROM safe_cities")
SQL["nearest_city"] = with_base("SELECT id, destinationId, cityDistance FROM nearest_city")
SQL["nearest_harbour"] = with_base("SELECT id, harbourDistance FROM nearest_harbour")
SQL["combine_nearest"] = with_base(
    "SELECT id, population, destinationId, cityDistance, harbourDistance FROM combined")
SQL["partial_relocation"] = with_base("""
SELECT id, CAST(round(population * CAST(0.75 AS DOUBLE)) AS BIGINT) AS num_evacuees, destinationId
FROM combined WHERE harbourDistance < cityDistance
UNION ALL
SELECT id, CAST(round(population * CAST(0.25 AS DOUBLE)) AS BIGINT) AS num_evacuees,
       CAST(-1 AS BIGINT) AS destinationId
FROM combined WHERE harbourDistance < cityDistance""")
SQL["union_all"] = with_base("SELECT id, num_evacuees, destinationId FROM reloc_rows")
SQL["relocations"] = with_base("""
SELECT coalesce(p.name, 'Waterworld') AS place, r.num_evacuees,
       coalesce(c.destination, 'Waterworld') AS destination
FROM reloc_rows r LEFT JOIN places p ON p.id = r.id
LEFT JOIN safe_cities c ON c.destinationId = r.destinationId""")
SQL["destinations"] = with_base("""
SELECT coalesce(c.destination, 'Waterworld') AS destination,
       coalesce(c.destinationPopulation, 0) AS old_population,
       coalesce(c.destinationPopulation, 0) + coalesce(t.arrivals, 0) AS new_population
FROM (SELECT destinationId, CAST(sum(num_evacuees) AS BIGINT) AS arrivals
      FROM reloc_rows GROUP BY destinationId) t
LEFT JOIN safe_cities c ON c.destinationId = t.destinationId""")

NODES = """
nodes AS (
  SELECT id, place, CAST(population AS VARCHAR) AS population_text, name, CAST(NULL AS VARCHAR) AS harbour,
         lat, lon FROM places
  UNION ALL
  SELECT hid, NULL, NULL, NULL, 'yes', lat, lon FROM harbours),
mixed AS (
  SELECT * FROM nodes
  UNION ALL
  SELECT 1000000000 + p_partkey,
         CASE p_partkey % 6 WHEN 0 THEN 'suburb' WHEN 1 THEN 'town' WHEN 2 THEN 'village' WHEN 5 THEN 'hamlet' END,
         CASE WHEN p_partkey % 6 IN (0, 2, 5) THEN CAST(p_partkey AS VARCHAR) END,
         CASE WHEN p_partkey % 6 IN (0, 1, 2, 5) THEN p_name END,
         CASE p_partkey % 6 WHEN 3 THEN 'no' WHEN 4 THEN 'yes' END,
         CASE WHEN p_partkey % 6 <> 2
              THEN CAST((p_partkey * 6151) % 1800 AS DOUBLE) / CAST(100 AS DOUBLE) + CAST(40 AS DOUBLE) END,
         CASE WHEN p_partkey % 6 <> 4 THEN CAST((p_partkey * 3571) % 3600 AS DOUBLE) / CAST(100 AS DOUBLE) END
  FROM part)
"""

#: The node filter of the job, spelled out.
FILTERED = """
FROM mixed WHERE ((place IN ('city', 'town', 'village', 'hamlet') AND population_text IS NOT NULL) OR harbour = 'yes')
  AND lat IS NOT NULL AND lon IS NOT NULL"""


def with_nodes(body: str) -> str:
    return "WITH " + BASE.strip() + ",\n" + NODES.strip() + "\n" + body.strip()


SQL["with_cell"] = with_base("SELECT id, cy, cx FROM places_c")
SQL["bounded_scan"] = with_base("""
SELECT e.cy, e.cx, e.avg_elevation FROM cell_elev e
WHERE EXISTS (SELECT 1 FROM places_c p WHERE p.cy = e.cy AND p.cx = e.cx)""")
SQL["threshold_filter"] = with_base("SELECT cy, cx, avg_elevation FROM cell_elev WHERE avg_elevation >= 12")
SQL["min_by_key"] = with_base("""
SELECT CAST(floor(lat / CAST(0.5 AS DOUBLE)) AS BIGINT) AS cy,
       CAST(floor(lon / CAST(0.5 AS DOUBLE)) AS BIGINT) AS cx, min(elevation) AS min_elevation
FROM elev GROUP BY 1, 2""")
SQL["argmin_rows"] = with_base("""
SELECT cy, cx, lat, lon, elevation FROM (
  SELECT *, min(elevation) OVER (PARTITION BY cy, cx) AS m FROM (
    SELECT CAST(floor(lat / CAST(0.5 AS DOUBLE)) AS BIGINT) AS cy,
           CAST(floor(lon / CAST(0.5 AS DOUBLE)) AS BIGINT) AS cx, lat, lon, elevation FROM elev))
WHERE elevation = m""")
SQL["project"] = with_nodes("SELECT id AS node_id, lat, lon" + FILTERED)
SQL["map_lookup"] = with_nodes("SELECT id, place, population_text, name, harbour FROM mixed")
SQL["in_list"] = with_nodes("SELECT id FROM mixed WHERE place IN ('city', 'town', 'village', 'hamlet')")
SQL["place_filter"] = with_nodes("SELECT id, lat, lon" + FILTERED)
SQL["hidden_column_filter"] = with_base("SELECT id, name FROM places WHERE place = 'city'")
SQL["select_distinct"] = with_base("SELECT DISTINCT cy, cx FROM places_c")
SQL["tolerant_cast"] = r"""
WITH t AS (
  SELECT c_custkey, CASE c_custkey % 8
      WHEN 0 THEN CAST(c_custkey AS VARCHAR)
      WHEN 1 THEN ' ' || CAST(c_custkey AS VARCHAR) || ' '
      WHEN 2 THEN CAST(c_custkey AS VARCHAR) || '.7'
      WHEN 3 THEN '1,' || CAST(c_custkey AS VARCHAR)
      WHEN 4 THEN CAST(c_custkey AS VARCHAR) || 'e3'
      WHEN 5 THEN ''
      WHEN 6 THEN NULL
      ELSE '+' || CAST(c_custkey AS VARCHAR) END AS text
  FROM customer),
s AS (SELECT c_custkey, text, trim(text) AS s FROM t)
SELECT c_custkey, text,
  CASE WHEN NOT regexp_full_match(s, '[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]*)') THEN NULL
       WHEN regexp_extract(s, '^[+-]?[0-9]*') IN ('', '+', '-') THEN 0
       ELSE TRY_CAST(regexp_extract(s, '^[+-]?[0-9]*') AS BIGINT) END AS value
FROM s"""
SQL["split_match"] = with_base("""
SELECT id, population, destinationId, cityDistance, harbourDistance FROM combined
WHERE harbourDistance < cityDistance""")
SQL["split_rest"] = with_base("""
SELECT id, population, destinationId, cityDistance, harbourDistance FROM combined
WHERE NOT (harbourDistance < cityDistance)""")
SQL["nearer_harbour_exists"] = with_base("""
SELECT t.id FROM to_relocate t
JOIN (SELECT id, min(cityDistance) AS cd FROM nearest_city GROUP BY id) c ON c.id = t.id
WHERE EXISTS (SELECT 1 FROM harbours h
              WHERE (h.lat - t.lat) * (h.lat - t.lat) + (h.lon - t.lon) * (h.lon - t.lon) < c.cd)""")
SQL["sum_by_destination"] = with_base("""
SELECT destinationId, CAST(sum(num_evacuees) AS BIGINT) AS arrivals FROM reloc_rows GROUP BY destinationId""")
SQL["fill_nulls"] = with_base("""
SELECT t.destinationId, t.arrivals, coalesce(c.destination, 'Waterworld') AS destination,
       coalesce(c.destinationPopulation, 0) AS destinationPopulation
FROM (SELECT destinationId, CAST(sum(num_evacuees) AS BIGINT) AS arrivals
      FROM reloc_rows GROUP BY destinationId) t
LEFT JOIN safe_cities c ON c.destinationId = t.destinationId""")
SQL["schema_contract"] = with_base("SELECT lat, lon, elevation FROM elev")
SQL["parquet_scan"] = SQL["schema_contract"]
SQL["orc_scan"] = with_nodes("SELECT id, lat, lon, place, name, population_text, harbour FROM nodes")
SQL["orc_sink"] = SQL["relocations"]
SQL["sampling_weight"] = with_base("""
SELECT id, population, population * CAST(floor(sqrt(CAST(population AS DOUBLE))) AS BIGINT) AS weight
FROM places""")
SQL["key_casts"] = """
SELECT c_custkey, CAST(c_custkey AS VARCHAR) AS key_text,
       CAST(CAST(c_custkey AS VARCHAR) AS BIGINT) AS id_back FROM customer"""

# ------------------------------------------------------------------ stream side

EVENTS = """
ev AS (
  SELECT user_id AS city_id, event_type AS city_name,
         CAST(round(value * CAST(100 AS DOUBLE)) AS BIGINT) AS refugees, ts, event_id,
         epoch_us(ts) - (((epoch_us(ts) % 3600000000) + 3600000000) % 3600000000) AS w
  FROM events),
pw AS (SELECT city_id, w, CAST(sum(refugees) AS BIGINT) AS change FROM ev GROUP BY 1, 2),
names AS (
  SELECT city_id, city_name FROM (
    SELECT city_id, city_name, row_number() OVER (PARTITION BY city_id ORDER BY ts, event_id) AS rn FROM ev)
  WHERE rn = 1),
spine AS (
  SELECT k.city_id, unnest(range(k.w0, l.wl + 3600000000, 3600000000)) AS w
  FROM (SELECT city_id, min(w) AS w0 FROM pw GROUP BY 1) k,
       (SELECT max(w) AS wl FROM pw) l),
dense AS (
  SELECT s.city_id, n.city_name, s.w, coalesce(p.change, 0) AS change
  FROM spine s JOIN names n ON n.city_id = s.city_id
  LEFT JOIN pw p ON p.city_id = s.city_id AND p.w = s.w),
totals AS (
  SELECT city_id, city_name, make_timestamp(w) AS window_start, w,
         CAST(sum(change) OVER (PARTITION BY city_id ORDER BY w
                                ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS refugees,
         CAST(change AS BIGINT) AS change
  FROM dense),
texts AS (
  SELECT ts, event_id, city_id, refugees, event_id % 10 AS k FROM ev),
decoded AS (
  SELECT ts, event_id,
         refugees,
         CASE WHEN k <= 5 THEN city_id END AS city_id,
         CASE WHEN k <= 4 THEN refugees % 100 END AS change
  FROM texts WHERE k <= 5 OR k = 9),
feats AS (
  SELECT c_custkey AS k, 0 AS version, c_custkey * 1000 + 7 AS population, c_name AS name,
         CAST((c_custkey * 6151) % 1800 AS DOUBLE) / CAST(100 AS DOUBLE) + CAST(40 AS DOUBLE) AS lat,
         CAST((c_custkey * 3571) % 3600 AS DOUBLE) / CAST(100 AS DOUBLE) AS lon
  FROM customer
  UNION ALL
  SELECT c_custkey, 1, CAST(floor(abs(c_acctbal) * CAST(100 AS DOUBLE)) AS BIGINT), c_name,
         CAST((c_custkey * 6151) % 1800 AS DOUBLE) / CAST(100 AS DOUBLE) + CAST(40 AS DOUBLE),
         CAST((c_custkey * 3571) % 3600 AS DOUBLE) / CAST(100 AS DOUBLE)
  FROM customer),
cities AS (
  SELECT k AS city_id, name, population, lon, lat FROM (
    SELECT *, row_number() OVER (PARTITION BY k ORDER BY version DESC) AS rn
    FROM feats WHERE population > 400000)
  WHERE rn = 1),
enriched AS (
  SELECT t.city_id, t.window_start, t.w,
         CASE WHEN t.city_id % 7 = 0 THEN 0 ELSE t.refugees END AS count, t.change,
         c.city_id AS fid, c.name AS fname, c.population AS fpop, c.lon AS flon, c.lat AS flat
  FROM totals t LEFT JOIN cities c ON c.city_id = t.city_id),
latest AS (
  SELECT fid AS city_id, arg_max(fname, w) AS name, arg_max(count, w) AS count,
         arg_max(change, w) AS change
  FROM enriched WHERE fid IS NOT NULL GROUP BY fid),
latest_n AS (
  SELECT *, CAST(count AS DOUBLE) / CAST((SELECT max(count) FROM latest) AS DOUBLE) AS share,
         CASE WHEN change IS NULL OR change = 0 OR count = 0 THEN CAST(0 AS DOUBLE)
              ELSE CAST(change AS DOUBLE) / CAST(count AS DOUBLE) END AS ratio
  FROM latest)
"""


def with_events(body: str) -> str:
    return "WITH " + EVENTS.strip() + "\n" + body.strip()


SQL["first_name"] = with_events("SELECT city_id, city_name FROM names")
SQL["window_change"] = with_events("SELECT city_id, make_timestamp(w) AS window_start, change FROM pw")
SQL["running_total"] = with_events("""
SELECT city_id, make_timestamp(w) AS window_start,
       CAST(sum(change) OVER (PARTITION BY city_id ORDER BY w
                              ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS refugees
FROM pw""")
SQL["dense_window_totals"] = with_events(
    "SELECT city_id, city_name, window_start, refugees, change FROM totals")
SQL["kafka_record_shape"] = with_events("""
SELECT CAST(city_id AS VARCHAR) AS key,
       '{"city_id":' || city_id || ',"city_name":"' || city_name || '","refugees":' || refugees
       || ',"change":' || change || '}' AS value
FROM totals""")
SQL["json_decode_strict"] = with_events("""
SELECT event_id, epoch_us(ts) // 1000 AS timestamp, city_id, city_name, refugees FROM ev""")
SQL["json_decode_tolerant"] = with_events(
    "SELECT ts, event_id, refugees, city_id, change FROM decoded")
SQL["latest_per_key"] = with_events("""
SELECT city_id, arg_max(refugees, (ts, event_id)) AS refugees FROM decoded
WHERE city_id IS NOT NULL GROUP BY city_id""")
SQL["latest_non_null"] = with_events("""
SELECT city_id, arg_max(change, (ts, event_id)) FILTER (WHERE change IS NOT NULL) AS change FROM decoded
WHERE city_id IS NOT NULL GROUP BY city_id""")
SQL["geojson_features"] = """
SELECT c_custkey AS city_id, c_name AS name, CAST(floor(abs(c_acctbal) * CAST(100 AS DOUBLE)) AS BIGINT) AS population,
       CAST((c_custkey * 3571) % 3600 AS DOUBLE) / CAST(100 AS DOUBLE) AS lon,
       CAST((c_custkey * 6151) % 1800 AS DOUBLE) / CAST(100 AS DOUBLE) + CAST(40 AS DOUBLE) AS lat
FROM customer
WHERE c_acctbal >= 0 AND CAST(floor(abs(c_acctbal) * CAST(100 AS DOUBLE)) AS BIGINT) > 400000"""
SQL["geojson_last_wins"] = with_events("SELECT city_id, name, population, lon, lat FROM cities")
SQL["enrich_updates"] = with_events("""
SELECT city_id, window_start, count, change, CAST(fid AS VARCHAR) AS feature_id, fname AS feature_name,
       fpop AS feature_population
FROM enriched""")
SQL["json_encode"] = with_events("""
SELECT '{"count":' || count || ',"feature":' ||
       CASE WHEN fid IS NULL THEN 'null' ELSE
         '{"type":"Feature","properties":{"geoname_id":"' || fid || '","name":"' || fname
         || '","population":' || fpop || '},"geometry":{"type":"Point","coordinates":['
         || CAST(flon AS VARCHAR) || ',' || CAST(flat AS VARCHAR) || ']}}' END
       || ',"change":' || change || '}' AS event
FROM enriched""")
SQL["normalised_count"] = with_events("SELECT city_id, count, share FROM latest_n")
SQL["change_ratio"] = with_events("SELECT city_id, count, change, ratio FROM latest_n")
SQL["map_snapshot"] = with_events("""
SELECT city_id, name, count, change, share, ratio,
       CAST(7 AS DOUBLE) + share * CAST(7 AS DOUBLE) AS radius,
       CASE WHEN ratio = 0 THEN CAST(0 AS DOUBLE) ELSE CAST(0.5 AS DOUBLE) END AS fill_opacity
FROM latest_n WHERE count > 0""")
SQL["stream_updates"] = with_events("""
SELECT city_id, city_name, window_start, refugees, change FROM totals
WHERE w + 3600000000 <= (SELECT max(epoch_us(ts)) FROM events)""")

# Other ways to the same rows.
SQL["stream_topic"] = SQL["stream_updates"]
SQL["raster_scan"] = SQL["bounded_scan"]
