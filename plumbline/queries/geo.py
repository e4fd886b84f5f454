"""Places on the driver tables: names of orders and lines, and upper-cased documents."""

from pyspark.sql import functions as F

from ..functions import fixed_values as fv
from ..operators import geo as op
from ..sources import driver_tables as dt
from .base import query

ASCII = "[^ -~]"


def nation_points(spark, d):
    return {r["state"]: (r["lat"], r["lon"]) for r in op.bounded_rows(dt.nation_centroids(spark, d).orderBy("state"))}


NATIONS = "nations AS (SELECT n_name AS state, 8 + n_nationkey * 1.0::DOUBLE AS lat, 70 + n_nationkey * 0.9::DOUBLE AS lon FROM nation)"


@query(
    "extract_state", "time cost",
    r"WITH " + NATIONS.replace("nations AS (", "nations AS MATERIALIZED (") + r""",
    names AS MATERIALIZED (SELECT DISTINCT project_name, upper(regexp_replace(trim(regexp_extract(regexp_extract(project_name, '\]\s*([^\]\[]+)$', 1), '([^,]*)$', 1)), '\s+', '', 'g')) AS p
      FROM (SELECT project_name FROM time_t UNION ALL SELECT replace(project_name, 'NATION', 'nat ion') FROM cost_t)),
    tails AS MATERIALIZED (SELECT DISTINCT p FROM names WHERE p <> ''),
    hits AS MATERIALIZED (SELECT p, arg_min(state, (-length(state), state)) AS state FROM tails JOIN nations ON starts_with(state, p) GROUP BY p)
    SELECT project_name, state FROM names LEFT JOIN hits ON names.p = hits.p""",
)
def _(spark, d):
    mangled = F.replace("project_name", F.lit("NATION"), F.lit("nat ion"))
    names = dt.time_table(spark, d).select("project_name").unionByName(dt.cost_table(spark, d).select(mangled.alias("project_name")))
    return op.extract_state(names.distinct(), names=dt.nation_centroids(spark, d).select("state"), codes={}).select("project_name", "state")


@query(
    "geo_from_state", "time",
    "WITH " + NATIONS + " SELECT project_id, round(lat, 6) AS geo_latitude, round(lon, 6) AS geo_longitude FROM time_t t LEFT JOIN nations n ON t.state = n.state",
)
def _(spark, d):
    t = dt.time_table(spark, d).select("project_id", "state")
    out = op.geo_from_state(t, dt.nation_centroids(spark, d))
    return out.select("project_id", F.round("geo_latitude", 6).alias("geo_latitude"), F.round("geo_longitude", 6).alias("geo_longitude"))


@query(
    "nearest_centroid", "time",
    "WITH " + NATIONS + """,
    pts AS (SELECT project_id, geo_latitude + 0.3 * (project_id % 3) AS lat, geo_longitude AS lon FROM time_t),
    best AS (SELECT project_id, arg_min(n.state, (p.lat - n.lat) * (p.lat - n.lat) + (p.lon - n.lon) * (p.lon - n.lon)) AS state FROM pts p, nations n
             WHERE p.lat IS NOT NULL GROUP BY project_id)
    SELECT p.project_id, coalesce(state, 'UNKNOWN') AS state FROM pts p LEFT JOIN best b ON p.project_id = b.project_id""",
)
def _(spark, d):
    lat = F.col("geo_latitude") + 0.3 * (F.col("project_id") % 3)
    state = op.nearest_centroid(lat, F.col("geo_longitude"), nation_points(spark, d))
    return dt.time_table(spark, d).select("project_id", state.alias("state"))


@query(
    "nearest_place", "time cost",
    """WITH places AS MATERIALIZED (SELECT agency AS name, round(avg(geo_latitude), 4) + (min(CAST(substr(agency, -4) AS INTEGER)) % 97) * 0.01::DOUBLE AS lat, round(avg(geo_longitude), 4) AS lon
         FROM cost_t WHERE geo_latitude IS NOT NULL GROUP BY agency),
       points AS MATERIALIZED (SELECT DISTINCT geo_latitude AS y, geo_longitude AS x FROM time_t WHERE geo_latitude IS NOT NULL),
       best AS MATERIALIZED (SELECT y, x, arg_min(name, ((y - lat) * (y - lat) + (x - lon) * (x - lon), name)) AS near FROM points, places GROUP BY y, x)
       SELECT project_id, coalesce(near, 'UNKNOWN') AS near FROM time_t LEFT JOIN best ON geo_latitude = y AND geo_longitude = x""",
)
def _(spark, d):
    located = dt.cost_table(spark, d).filter("geo_latitude IS NOT NULL")
    number = F.substring("agency", -4, 4).cast("int")
    places = located.groupBy("agency").agg((F.round(F.avg("geo_latitude"), 4) + (F.min(number) % 97) * 0.01).alias("lat"), F.round(F.avg("geo_longitude"), 4).alias("lon"))
    return op.nearest_place(dt.time_table(spark, d), places, output="near").select("project_id", "near")


@query(
    "attach_state", "time",
    """SELECT t.project_id, CASE WHEN project_id % 2 = 0 THEN (SELECT max(n_name) FROM nation n WHERE starts_with(n_name, t.state) AND length(n_name) =
           (SELECT max(length(n_name)) FROM nation m WHERE starts_with(m.n_name, t.state)) AND n_name = (SELECT min(n_name) FROM nation q WHERE starts_with(q.n_name, t.state)
           AND length(q.n_name) = (SELECT max(length(n_name)) FROM nation m WHERE starts_with(m.n_name, t.state))))
         WHEN project_id % 3 = 0 THEN 'known ' || t.state WHEN geo_latitude IS NOT NULL THEN t.state ELSE 'UNKNOWN' END AS state FROM time_t t""",
)
def _(spark, d):
    points = nation_points(spark, d)
    t = dt.time_table(spark, d).select("project_id", "sector", "project_name", "state", "geo_latitude", "geo_longitude")
    bare = F.when(F.col("project_id") % 2 == 0, F.col("project_name")).otherwise(F.concat(F.lit("no tail "), F.col("project_id").cast("string")))
    t = t.withColumn("project_name", bare)
    known = t.filter(F.col("project_id") % 3 == 0).select("sector", "project_name", F.concat(F.lit("known "), F.col("state")).alias("state"))
    return op.attach_state(t.drop("state"), known, names=list(points), centroids=points).select("project_id", "state")


def upper_documents(spark, d):
    text = F.upper(F.regexp_replace("text", ASCII, " "))
    return dt.load(spark, d, "documents").select("doc_id", text.alias("project_name"))


def gazetteer(spark, d):
    """Places taken from the benchmark passages: their first word pair and their fourth word."""
    words = F.split(F.upper(F.regexp_replace("text", "[^A-Za-z]+", " ")), " ")
    base = dt.load(spark, d, "benchmark").select("item_id", words.alias("w"))
    places = F.array(F.concat_ws(" ", F.get("w", F.lit(0)), F.get("w", F.lit(1))), F.get("w", F.lit(3)))
    return (
        base.select("item_id", F.explode(places).alias("place"))
        .filter(F.length("place") >= 3)
        .groupBy("place")
        .agg(F.min("item_id").alias("i"))
        .select("place", (F.col("i") * 0.5).alias("lat"), (60 + F.col("i") * 0.25).alias("lon"))
    )


GAZETTEER = """
bw AS (SELECT item_id, string_split(upper(regexp_replace(text, '[^A-Za-z]+', ' ', 'g')), ' ') AS w FROM benchmark),
gaz AS (SELECT place, min(item_id) * 0.5::DOUBLE AS lat, 60 + min(item_id) * 0.25::DOUBLE AS lon FROM (
          SELECT item_id, w[1] || ' ' || w[2] AS place FROM bw UNION ALL SELECT item_id, w[4] FROM bw) WHERE length(place) >= 3 GROUP BY place)"""
UPPER_DOCS = "docs AS (SELECT doc_id, upper(regexp_replace(text, '[^ -~]', ' ', 'g')) AS name FROM documents)"
GEOCODED = (
    "WITH " + GAZETTEER.strip() + ",\n" + UPPER_DOCS + """,
    toks AS (SELECT doc_id, list_transform(regexp_extract_all(name, '[A-Z][A-Z0-9\\-]{2,}'), lambda t: regexp_replace(t, '[^A-Z0-9]', '', 'g')) AS t FROM docs),
    words AS (SELECT doc_id, unnest(t) AS w, generate_subscripts(t, 1) AS s FROM toks),
    ahead AS (SELECT *, lead(w, 1) OVER o AS w2, lead(w, 2) OVER o AS w3, lead(w, 3) OVER o AS w4, lead(w, 4) OVER o AS w5, lead(w, 5) OVER o AS w6
              FROM words WINDOW o AS (PARTITION BY doc_id ORDER BY s)),
    runs AS (SELECT doc_id, s, 1 AS k, w AS txt FROM ahead UNION ALL SELECT doc_id, s, 2, w || w2 FROM ahead UNION ALL SELECT doc_id, s, 3, w || w2 || w3 FROM ahead
             UNION ALL SELECT doc_id, s, 4, w || w2 || w3 || w4 FROM ahead UNION ALL SELECT doc_id, s, 5, w || w2 || w3 || w4 || w5 FROM ahead
             UNION ALL SELECT doc_id, s, 6, w || w2 || w3 || w4 || w5 || w6 FROM ahead),
    hits AS (SELECT doc_id, place, lat, lon, row_number() OVER (PARTITION BY doc_id ORDER BY k DESC, s, place) AS rn
             FROM runs JOIN gaz ON txt = replace(place, ' ', '')),
    coded AS (SELECT d.doc_id, place AS matched, lat AS geo_latitude, lon AS geo_longitude FROM docs d LEFT JOIN hits h ON d.doc_id = h.doc_id AND rn = 1)"""
)


@query("gazetteer_geocode", "", GEOCODED + " SELECT * FROM coded")
def geocoded(spark, d):
    return op.gazetteer_geocode(upper_documents(spark, d), gazetteer(spark, d), "doc_id").drop("project_name")


@query("token_hits", "", GEOCODED + " SELECT matched, count(*) AS n FROM coded WHERE matched IS NOT NULL GROUP BY matched")
def _(spark, d):
    return op.token_hits(geocoded(spark, d))


@query(
    "org_area_fallback", "time",
    """WITH g AS (SELECT state AS place, min(geo_latitude) AS lat, min(geo_longitude) AS lon FROM time_t GROUP BY state),
       a AS (SELECT project_id, geo_latitude, geo_longitude, CASE WHEN geo_latitude IS NULL THEN
               CASE WHEN list_contains(regexp_split_to_array(upper(project_name), '[^A-Z0-9]+'), 'URGENT') THEN 'NATION_3'
                    WHEN list_contains(regexp_split_to_array(upper(project_name), '[^A-Z0-9]+'), 'HIGH') THEN 'NATION_5' END END AS area FROM time_t)
       SELECT project_id, round(coalesce(geo_latitude, lat), 6) AS geo_latitude, round(coalesce(geo_longitude, lon), 6) AS geo_longitude FROM a LEFT JOIN g ON area = place""",
)
def _(spark, d):
    t = dt.time_table(spark, d).select("project_id", "project_name", "state", "geo_latitude", "geo_longitude")
    places = t.groupBy(F.col("state").alias("place")).agg(F.min("geo_latitude").alias("lat"), F.min("geo_longitude").alias("lon"))
    out = op.org_area_fallback(t, places, areas={"URGENT": "NATION_3", "HIGH": "NATION_5"})
    return out.select("project_id", F.round("geo_latitude", 6).alias("geo_latitude"), F.round("geo_longitude", 6).alias("geo_longitude"))


@query(
    "propagate_geo", "time",
    """WITH n AS (SELECT project_id, sector || ' ' || agency || ' [' || CAST(project_id % 500 AS VARCHAR) || '],' || state AS name, geo_latitude AS lat, geo_longitude AS lon FROM time_t),
       k AS (SELECT *, regexp_replace(lower(name), '[^a-z0-9]', '', 'g') AS f, regexp_replace(lower(split_part(name, '[', 1)), '[^a-z0-9]', '', 'g') AS b FROM n),
       full_k AS (SELECT f, arg_min(lat, project_id) AS lat, arg_min(lon, project_id) AS lon FROM k WHERE lat IS NOT NULL GROUP BY f),
       base_k AS (SELECT b, arg_min(lat, project_id) AS lat, arg_min(lon, project_id) AS lon FROM k WHERE lat IS NOT NULL GROUP BY b)
       SELECT project_id, round(coalesce(k.lat, x.lat, y.lat), 6) AS geo_latitude, round(coalesce(k.lon, x.lon, y.lon), 6) AS geo_longitude
       FROM k LEFT JOIN full_k x ON k.f = x.f LEFT JOIN base_k y ON k.b = y.b""",
)
def _(spark, d):
    t = dt.time_table(spark, d)
    name = F.concat("sector", F.lit(" "), "agency", F.lit(" ["), (F.col("project_id") % 500).cast("string"), F.lit("],"), "state")
    rows = t.select("project_id", name.alias("project_name"), "geo_latitude", "geo_longitude")
    out = op.propagate_geo(rows, [rows], "project_id", ("full", "base"))
    return out.select("project_id", F.round("geo_latitude", 6).alias("geo_latitude"), F.round("geo_longitude", 6).alias("geo_longitude"))


FINGERPRINT = (
    "list_sort(list_distinct(list_transform(list_filter(list_transform(regexp_split_to_array(line, '\\s+'), "
    "lambda w: regexp_replace(lower(w), '[^a-z0-9]', '', 'g')), lambda w: length(w) >= 5 AND w NOT IN ("
    + ", ".join(f"'{s}'" for s in fv.FINGERPRINT_STOP)
    + ")), lambda w: substr(w, 1, 6))))"
)


@query(
    "fuzzy_match", "",
    f"""WITH l AS (SELECT CAST(item_id AS BIGINT) * 1000 + i AS lid, {FINGERPRINT.replace('line', 'p[i]')} AS fp
            FROM (SELECT item_id, string_split(text, chr(10)) AS p FROM benchmark), unnest(range(1, len(p) + 1)) AS r(i)),
        c AS (SELECT conv_id * 1000 + turn AS cid, string_split(text, chr(10)) AS p FROM conversations),
        r AS (SELECT cid * 1000 + i AS rid, {FINGERPRINT.replace('line', 'p[i]')} AS fp FROM c, unnest(range(1, len(p) + 1)) AS r(i)),
        s AS (SELECT lid, rid, len(list_intersect(l.fp, r.fp)) AS shared FROM l, r)
        SELECT lid, CAST(rid AS BIGINT) AS matched_rid, shared FROM (SELECT *, row_number() OVER (PARTITION BY lid ORDER BY shared DESC, rid) AS rn FROM s WHERE shared >= 3) WHERE rn = 1""",
)
def _(spark, d):
    lines = F.posexplode(F.split("text", "\n")).alias("i", "project_name")
    left = dt.load(spark, d, "benchmark").select("item_id", lines)
    left = left.select((F.col("item_id") * 1000 + F.col("i") + 1).cast("long").alias("lid"), "project_name")
    right = dt.load(spark, d, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("cid"), lines)
    right = right.select((F.col("cid") * 1000 + F.col("i") + 1).cast("long").alias("rid"), "project_name")
    return op.fuzzy_match(left, right, "lid", "rid")


@query(
    "impute_group_mean", "time",
    """WITH m AS (SELECT sector, avg(geo_latitude) AS lat, avg(geo_longitude) AS lon FROM time_t WHERE geo_latitude IS NOT NULL GROUP BY sector)
       SELECT project_id, round(coalesce(geo_latitude, lat), 6) AS geo_latitude, round(coalesce(geo_longitude, lon), 6) AS geo_longitude
       FROM time_t t JOIN m ON t.sector = m.sector""",
)
def _(spark, d):
    out = op.impute_group_mean(dt.time_table(spark, d).select("project_id", "sector", "geo_latitude", "geo_longitude"))
    return out.select("project_id", F.round("geo_latitude", 6).alias("geo_latitude"), F.round("geo_longitude", 6).alias("geo_longitude"))


@query(
    "ngram_inventory", "",
    "WITH " + UPPER_DOCS + """,
    w AS (SELECT doc_id, list_filter(regexp_split_to_array(name, '[^A-Za-z0-9]+'), lambda t: length(t) >= 3 AND regexp_full_match(t, '[A-Z0-9]*[A-Z][A-Z0-9]*')) AS t FROM docs),
    words AS (SELECT doc_id, unnest(t) AS w, generate_subscripts(t, 1) AS s FROM w),
    usable AS (SELECT doc_id, s, CASE WHEN w NOT IN (""" + ", ".join(f"'{w}'" for w in fv.PLACE_STOP) + """) THEN w END AS w FROM words),
    ahead AS (SELECT w, lead(w, 1) OVER o AS w2, lead(w, 2) OVER o AS w3, lead(w, 3) OVER o AS w4, lead(w, 4) OVER o AS w5
              FROM usable WINDOW o AS (PARTITION BY doc_id ORDER BY s)),
    runs AS (SELECT w || ' ' || w2 AS g FROM ahead UNION ALL SELECT w || ' ' || w2 || ' ' || w3 FROM ahead
             UNION ALL SELECT w || ' ' || w2 || ' ' || w3 || ' ' || w4 FROM ahead UNION ALL SELECT w || ' ' || w2 || ' ' || w3 || ' ' || w4 || ' ' || w5 FROM ahead)
    SELECT g AS ngram, count(*) AS n FROM runs WHERE g IS NOT NULL GROUP BY g ORDER BY n DESC, g LIMIT 700""",
)
def _(spark, d):
    return op.ngram_inventory(upper_documents(spark, d))


@query(
    "coverage_report", "time",
    """SELECT count(*) AS rows, round(count(geo_latitude) / count(*), 6) AS coverage,
         count(DISTINCT CASE WHEN geo_latitude IS NOT NULL THEN (round(geo_latitude, 3), round(geo_longitude, 3)) END) AS distinct_coordinates FROM time_t""",
)
def _(spark, d):
    return op.coverage_report(dt.time_table(spark, d)).withColumn("coverage", F.round("coverage", 6))
