"""Places: states from names, centroids, gazetteer hits, propagation, fuzzy matches, imputation."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed_values as fv
from ..functions.text import norm_key, nullif_blank, strip
from ..session import cut_lineage, sized

MAX_PLACES = 10_000


def bounded_rows(df: DataFrame, limit: int = MAX_PLACES) -> list:
    """Rows of a dimension that must stay small; raises beyond ``limit``."""
    rows = df.limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"dimension has more than {limit} rows")
    return rows


# --------------------------------------------------------------------------- state from name
def _name_table(df: DataFrame, names: Sequence[str] | DataFrame) -> DataFrame:
    """``__name`` and its blank-free form; a list of names is a table like any other."""
    if not isinstance(names, DataFrame):
        names = df.sparkSession.createDataFrame([(n,) for n in names], "name string")
    table = names.select(F.col(names.columns[0]).alias("__name")).filter("__name IS NOT NULL").distinct()
    return sized(table.withColumn("__flat", F.upper(F.regexp_replace("__name", r"\s+", ""))))


def _pieces(text: Column) -> Column:
    """Words and what stands between them, in order: together they are the text."""
    return F.regexp_extract_all(text, F.lit(r"(\w+|\W+)"), F.lit(1))


def _named_in(texts: DataFrame, text: str, names: DataFrame, output: str) -> DataFrame:
    """``text`` and the name that stands in it first, between word borders (the longest of those at one place): runs of whole
    words are looked up in the names, so the names are joined and no pattern of all names is made."""
    # as many pieces as the longest name has, one number
    longest = names.agg(F.max(F.size(_pieces(F.col("__name"))))).first()[0] or 0
    pieces = _pieces(F.upper(text))
    runs = texts.select(text, pieces.alias("__p")).select(text, "__p", F.posexplode("__p").alias("__at", "__word")).filter(r"__word RLIKE '^\\w'")
    sizes = F.filter(F.sequence(F.lit(1), F.lit(max(longest, 1)), F.lit(2)), lambda k: F.col("__at") + k <= F.size("__p"))
    run = runs.select(text, "__at", F.explode(F.transform(sizes, lambda k: F.array_join(F.slice("__p", F.col("__at") + 1, k), ""))).alias("__run"))
    found = run.join(names.select(F.upper("__name").alias("__run")).distinct(), "__run")
    return found.groupBy(text).agg(F.min(F.struct("__at", (-F.length("__run")).alias("l"), "__run")).getField("__run").alias(output))


def extract_state(
    df: DataFrame,
    name: str = "project_name",
    names: Sequence[str] | DataFrame = tuple(fv.STATE_CENTROIDS),
    codes: Mapping[str, str] = fv.STATE_CODES,
    output: str = "state",
) -> DataFrame:
    """State of a project name: ']ORG,STATE' tail, else a full name anywhere, else a code after the comma.

    The tail matches a known name, or a cut-off beginning of one, ignoring blanks; the longest name wins. ``names`` is a list or a
    table (first column) of any length: an index of all beginnings is joined with the tails, and runs of words with the names.
    Tails are looked up row by row; only names that these leave open are searched for names of states, repeated ones once.
    """
    table = _name_table(df, names)
    index = sized(
        table.select("__name", F.explode(F.transform(F.sequence(F.lit(1), F.length("__flat")), lambda k: F.substring("__flat", F.lit(1), k))).alias("__tail"), F.length("__flat").alias("l"))
        .groupBy("__tail").agg(F.min(F.struct((-F.col("l")).alias("l"), "__name")).getField("__name").alias("__by_suffix"))
    )
    text, part = F.col(name), strip(F.regexp_extract(F.regexp_extract(name, fv.SUFFIX_PATTERN, 1), "([^,]*)$", 1))
    tail = nullif_blank(F.upper(F.regexp_replace(part, r"\s+", "")))
    # written once: the names that no tail settles are looked up further
    marked = cut_lineage(df.drop(output).withColumn("__tail", tail).join(index, "__tail", "left").drop("__tail"))
    open_ = marked.filter(F.col("__by_suffix").isNull() & text.isNotNull()).select(text.alias("__text")).distinct()
    texts = sized(open_.withColumn("__part", strip(F.regexp_extract(F.regexp_extract("__text", fv.SUFFIX_PATTERN, 1), "([^,]*)$", 1))))
    in_part = _named_in(texts.select("__part").distinct(), "__part", table, "__in_part")
    anywhere = _named_in(texts, "__text", table, "__anywhere")
    code_map = F.create_map(*[F.lit(x) for pair in codes.items() for x in pair]) if codes else None
    by_code = F.try_element_at(code_map, F.regexp_extract("__text", fv.CODE_PATTERN, 1)) if codes else F.lit(None)
    found = texts.join(in_part, "__part", "left").join(anywhere, "__text", "left")
    known = sized(found.select("__text", F.coalesce("__in_part", "__anywhere", by_code).cast("string").alias("__state")).filter("__state IS NOT NULL"))
    return marked.join(known, text == F.col("__text"), "left").withColumn(output, F.coalesce("__by_suffix", "__state")).drop("__text", "__state", "__by_suffix")


def geo_from_state(df: DataFrame, centroids: DataFrame, state: str = "state") -> DataFrame:
    """Centroid of the state as geo_latitude and geo_longitude, NULL if unknown."""
    table = centroids.select(F.upper("state").alias("__s"), F.col("lat").alias("__lat"), F.col("lon").alias("__lon"))
    return (
        df.drop("geo_latitude", "geo_longitude")
        .join(table, F.upper(F.trim(state)) == F.col("__s"), "left")
        .withColumnsRenamed({"__lat": "geo_latitude", "__lon": "geo_longitude"})
        .drop("__s")
    )


def nearest_centroid(
    lat: Column, lon: Column, centroids: Mapping[str, tuple[float, float]] = fv.STATE_CENTROIDS
) -> Column:
    """Name of the nearest centroid by squared degrees; UNKNOWN without coordinates.

    For a short list, which is an array literal: each row looks at all of them in place and nothing is joined. A table of places is
    searched by ``nearest_place``.
    """
    places = [(n, c) for n, c in centroids.items() if n != fv.NOT_A_PLACE]
    table = F.array(
        *[
            F.struct(F.lit(float(c[0])).alias("lat"), F.lit(float(c[1])).alias("lon"), F.lit(i).alias("i"), F.lit(n).alias("name"))
            for i, (n, c) in enumerate(places)
        ]
    )

    def distance(p: Column) -> Column:
        dy, dx = lat - p["lat"], lon - p["lon"]
        return F.struct((dy * dy + dx * dx).alias("d"), p["i"].alias("i"), p["name"].alias("name"))

    nearest = F.array_min(F.transform(table, distance)).getField("name")
    return F.when(lat.isNotNull() & lon.isNotNull(), nearest).otherwise(fv.UNKNOWN)


def nearest_place(df: DataFrame, places: DataFrame, lat: str = "geo_latitude", lon: str = "geo_longitude", output: str = "state") -> DataFrame:
    """``nearest_centroid`` for a table of places (name, lat, lon) of any length: name of the nearest place by squared degrees, ties by name;
    UNKNOWN without coordinates or places.

    A pyramid of grids: each distinct point looks at the 3 x 3 cells around its own. What lies outside of them is a cell's width away
    or more, so a nearer hit is final; the other points go on with cells of twice the width, until 3 x 3 cells are all there is.
    """
    known = sized(places.toDF("__n", "__y", "__x").filter(f"__y IS NOT NULL AND __x IS NOT NULL AND __n <> '{fv.NOT_A_PLACE}'"))
    box = known.agg(F.count(F.lit(1)).alias("n"), F.min("__y").alias("y0"), F.max("__y").alias("y1"), F.min("__x").alias("x0"), F.max("__x").alias("x1")).first()
    points = cut_lineage(df.select(F.col(lat).cast("double").alias("__py"), F.col(lon).cast("double").alias("__px")).filter("__py IS NOT NULL AND __px IS NOT NULL").distinct())
    extent = max(box["y1"] - box["y0"], box["x1"] - box["x0"], 1e-9) if box["n"] else 0.0
    width, open_, done = extent / max(1.0, box["n"] ** 0.5), points, None
    while box["n"]:

        def cell(value: Column, low: float, high: float, w: float = width) -> Column:
            inside = F.least(F.greatest(value, F.lit(float(low))), F.lit(float(high)))
            return F.floor((inside - low) / w)

        grid = known.withColumns({"__i": cell(F.col("__y"), box["y0"], box["y1"]), "__j": cell(F.col("__x"), box["x0"], box["x1"])})
        around = lambda c: F.explode(F.array(*[F.col(c) + F.lit(k) for k in (-1, 0, 1)]))
        at = open_.withColumns({"__i": cell(F.col("__py"), box["y0"], box["y1"]), "__j": cell(F.col("__px"), box["x0"], box["x1"])})
        probes = at.withColumn("__i", around("__i")).withColumn("__j", around("__j"))
        dy, dx = F.col("__py") - F.col("__y"), F.col("__px") - F.col("__x")
        hits = probes.join(grid, ["__i", "__j"]).groupBy("__py", "__px").agg(F.min(F.struct((dy * dy + dx * dx).alias("d"), F.col("__n").alias("n"))).alias("b"))
        last = width >= extent
        tried = cut_lineage(open_.join(hits, ["__py", "__px"], "left").select("__py", "__px", F.col("b.n").alias("__near"), (F.lit(last) | F.coalesce(F.col("b.d") < width * width, F.lit(False))).alias("__final")))
        final = tried.filter("__final").select("__py", "__px", "__near")
        done = final if done is None else done.unionByName(final)
        open_ = tried.filter("NOT __final").select("__py", "__px")
        if last or open_.isEmpty():
            break
        width *= 2
    found = points.withColumn("__near", F.lit(None).cast("string")) if done is None else done
    joined = df.join(sized(found), (F.col(lat).cast("double") == F.col("__py")) & (F.col(lon).cast("double") == F.col("__px")), "left")
    return joined.withColumn(output, F.coalesce("__near", F.lit(fv.UNKNOWN))).drop("__py", "__px", "__near")


def attach_state(
    df: DataFrame,
    known: DataFrame | None = None,
    keys: Sequence[str] = ("sector", "project_name"),
    names: Sequence[str] = tuple(fv.STATE_CENTROIDS),
    centroids: Mapping[str, tuple[float, float]] = fv.STATE_CENTROIDS,
) -> DataFrame:
    """State by name, else by key from ``known`` (unique keys: keys + state), else by the nearest centroid."""
    out = extract_state(df.drop("state"), names=names)
    if known is not None:
        lookup = known.select(*keys, F.col("state").alias("__known"))
        out = out.join(lookup, list(keys), "left").withColumn("state", F.coalesce("state", "__known")).drop("__known")
    nearest = nearest_centroid(F.col("geo_latitude"), F.col("geo_longitude"), centroids)
    return out.withColumn("state", F.coalesce("state", nearest))


# --------------------------------------------------------------------------- gazetteer
def windows(tokens: Column, longest: int) -> Column:
    """For every token the run of up to ``longest`` tokens that begins with it."""
    return F.transform(tokens, lambda _, i: F.slice(tokens, i + 1, F.lit(longest)))


def joined(tokens: Column | str, start: Column | int, k: Column | int, joiner: str) -> Column:
    """Text of the ``k`` tokens from place ``start`` (from 1)."""
    return F.array_join(F.slice(tokens, start, k), joiner)


def gazetteer_geocode(df: DataFrame, gazetteer: DataFrame, key: str, name: str = "project_name", longest: int = 6) -> DataFrame:
    """Place of each row by the longest run of upper-case tokens found in the gazetteer.

    ``gazetteer`` has place, lat, lon; ``key`` identifies the rows. Runs ignore
    punctuation; the earliest of equally long runs wins. A run is spelt out only where
    its first token is how some place begins, and only hits are shuffled.
    """
    places = sized(
        gazetteer.select(
            F.regexp_replace(F.upper("place"), "[^A-Z0-9]", "").alias("__text"),
            F.col("place").alias("matched"),
            F.col("lat").alias("geo_latitude"),
            F.col("lon").alias("geo_longitude"),
        ).filter("__text <> ''")
    )
    begin = F.transform(F.sequence(F.lit(1), F.length("__text")), lambda k: F.substring("__text", F.lit(1), k))
    beginnings = sized(places.select(F.explode(begin).alias("__first")).distinct())
    # a token holds nothing but upper-case letters, digits and dashes
    tokens = F.transform(F.regexp_extract_all(F.col(name), F.lit(r"([A-Z][A-Z0-9\-]{2,})"), F.lit(1)), lambda t: F.replace(t, F.lit("-")))
    at = df.select(key, tokens.alias("t")).select(key, F.posexplode(windows(F.col("t"), longest)).alias("start", "w"))
    opened = at.withColumn("__first", F.get("w", F.lit(0))).join(beginnings, "__first", "left_semi")
    run = F.transform(F.sequence(F.lit(1), F.size("w")), lambda k: F.struct(k.alias("k"), joined("w", F.lit(1), k, "").alias("text")))
    hits = opened.select(key, "start", F.explode(run).alias("g")).select(key, "start", "g.k", F.col("g.text").alias("__text")).join(places, "__text")
    best = hits.groupBy(key).agg(
        F.min_by(F.struct("matched", "geo_latitude", "geo_longitude"), F.struct(-F.col("k"), F.col("start"), F.col("matched"))).alias("b")
    )
    return (
        df.drop("geo_latitude", "geo_longitude", "matched")
        .join(best, key, "left")
        .select(*[c for c in df.columns if c not in ("geo_latitude", "geo_longitude", "matched")], "b.*")
    )


def org_area(name: Column, areas: Mapping[str, str] = fv.ORG_AREAS) -> Column:
    """Operating area of the first listed organisation code that is a whole word of the name."""
    words = F.split(F.upper(name), "[^A-Z0-9]+")
    out = None
    for code, area in areas.items():
        hit = F.array_contains(words, code)
        out = F.when(hit, area) if out is None else out.when(hit, area)
    return out


def org_area_fallback(
    df: DataFrame, gazetteer: DataFrame, name: str = "project_name", areas: Mapping[str, str] = fv.ORG_AREAS
) -> DataFrame:
    """Fill missing coordinates from the operating area of an organisation in the name."""
    table = gazetteer.select(F.col("place").alias("__area"), F.col("lat").alias("__lat"), F.col("lon").alias("__lon"))
    missing = F.col("geo_latitude").isNull()
    marked = df.withColumn("__a", F.when(missing, org_area(F.col(name), areas)))
    return (
        marked.join(table, F.col("__a") == F.col("__area"), "left")
        .withColumns(
            {
                "geo_latitude": F.coalesce("geo_latitude", "__lat"),
                "geo_longitude": F.coalesce("geo_longitude", "__lon"),
            }
        )
        .drop("__a", "__area", "__lat", "__lon")
    )


# --------------------------------------------------------------------------- propagation
def _keys(name: Column) -> tuple[Column, Column]:
    return norm_key(name), norm_key(F.split_part(name, F.lit("["), F.lit(1)))


def propagate_geo(
    df: DataFrame,
    sources: Sequence[DataFrame],
    order: str,
    prefer: tuple[str, str] = ("base", "full"),
    name: str = "project_name",
) -> DataFrame:
    """Fill missing coordinates from rows with the same full or base name.

    The first coordinate per key counts: sources in the given order, then by
    ``order``. Both lookups are aggregated (map-side) before the joins.
    """
    rows = None
    for i, source in enumerate(sources):
        full, base = _keys(F.col(name))
        part = source.filter(F.col("geo_latitude").isNotNull()).select(
            full.alias("full"),
            base.alias("base"),
            F.struct(F.lit(i).alias("i"), F.col(order).alias("o")).alias("rank"),
            F.struct(F.col("geo_latitude").alias("lat"), F.col("geo_longitude").alias("lon")).alias("geo"),
        )
        rows = part if rows is None else rows.unionByName(part)
    full, base = _keys(F.col(name))
    out = df.withColumns({"__k_full": full, "__k_base": base})
    for kind in ("full", "base"):
        lookup = rows.groupBy(F.col(kind).alias(f"__{kind}")).agg(F.min_by("geo", "rank").alias(f"__geo_{kind}"))
        out = out.join(sized(lookup), F.col(f"__k_{kind}") == F.col(f"__{kind}"), "left")
    found = F.coalesce(F.col(f"__geo_{prefer[0]}"), F.col(f"__geo_{prefer[1]}"))
    missing = F.col("geo_latitude").isNull()
    return out.withColumns(
        {
            "geo_latitude": F.when(missing, found["lat"]).otherwise(F.col("geo_latitude")),
            "geo_longitude": F.when(missing, found["lon"]).otherwise(F.col("geo_longitude")),
        }
    ).select(*df.columns)


# --------------------------------------------------------------------------- fuzzy match
def fingerprint(name: Column) -> Column:
    """Sorted distinct 6-character beginnings of the words with at least five letters or digits."""
    words = F.transform(F.split(name, r"\s+"), norm_key)
    stop = F.array(*[F.lit(s) for s in fv.FINGERPRINT_STOP])
    kept = F.filter(words, lambda w: (F.length(w) >= fv.FINGERPRINT_MIN_TOKEN) & ~F.array_contains(stop, w))
    return F.array_sort(F.array_distinct(F.transform(kept, lambda w: F.substring(w, 1, fv.FINGERPRINT_PREFIX))))


def fuzzy_match(
    left: DataFrame,
    right: DataFrame,
    left_id: str,
    right_id: str,
    name: str = "project_name",
    least: int = fv.FINGERPRINT_MIN_SHARED,
) -> DataFrame:
    """Right row sharing most fingerprint tokens with each left row (at least ``least``), earliest on ties.

    A set-similarity join by prefix filter, exact and without a frequency cap. Equal fingerprints are merged first. All tokens have one order, from rare to
    frequent; two sets that share ``least`` tokens share one among the first size - least + 1 of each, so only these are joined and a frequent
    token is looked up only by sets that have hardly a rarer one. Pairs whose places leave too few tokens behind them go before
    the sets are compared.
    """
    lf = left.select(F.col(left_id).alias("lid"), fingerprint(F.col(name)).alias("fp")).filter(F.size("fp") >= least)
    rf = (
        right.select(F.col(right_id).alias("rid"), fingerprint(F.col(name)).alias("fp"))
        .filter(F.size("fp") >= least)
        .groupBy("fp")
        .agg(F.min("rid").alias("rid"))
    )
    rights, lefts = cut_lineage(rf), cut_lineage(lf.select("fp").distinct())
    # a token of one side only cannot be shared, so the right side's counts order all that matter
    counts = sized(rights.select(F.explode("fp").alias("t")).groupBy("t").agg(F.count(F.lit(1)).alias("n")))

    def prefixes(df: DataFrame, *keep: str) -> DataFrame:
        each = df.select("fp", F.explode("fp").alias("t")).join(counts, "t")
        ordered = each.groupBy("fp").agg(F.array_sort(F.collect_list(F.struct("n", "t"))).alias("o")).filter(F.size("o") >= least)
        first = ordered.select("fp", F.size("o").alias("size"), F.posexplode(F.slice("o", F.lit(1), F.size("o") - least + 1)).alias("at", "e"))
        rows = first.select("fp", (F.col("size") - F.col("at")).alias("left"), F.col("e.t").alias("t"))
        return rows.join(df, "fp").select("fp", "left", "t", *keep) if keep else rows

    met = prefixes(lefts).join(prefixes(rights, "rid").select("t", F.col("fp").alias("rfp"), F.col("left").alias("rleft"), "rid"), "t")
    shared = met.filter(F.least("left", "rleft") >= least).select("fp", "rid", F.size(F.array_intersect("fp", "rfp")).alias("shared"))
    best = shared.filter(F.col("shared") >= least).groupBy("fp").agg(F.min(F.struct((-F.col("shared")).alias("neg"), F.col("rid"))).alias("b"))
    return lf.join(best, "fp").select(
        F.col("lid").alias(left_id), F.col("b.rid").alias(f"matched_{right_id}"), (-F.col("b.neg")).alias("shared")
    )


# --------------------------------------------------------------------------- imputation and reports
def impute_group_mean(
    df: DataFrame, group: str = "sector", train: DataFrame | None = None, fallback: tuple[float, float] = fv.DEFAULT_LAT_LON
) -> DataFrame:
    """A row missing either coordinate gets both from its group mean, else the overall mean, else the fallback."""
    lat, lon = F.col("geo_latitude"), F.col("geo_longitude")
    both = lat.isNotNull() & lon.isNotNull()
    cells = (df if train is None else train).filter(both).groupBy(group).agg(
        F.sum(lat).alias("sy"), F.sum(lon).alias("sx"), F.count(F.lit(1)).alias("n")
    )
    overall = cells.agg(F.struct((F.sum("sy") / F.sum("n")).alias("lat"), (F.sum("sx") / F.sum("n")).alias("lon")).alias("o"))
    means = cells.select(F.col(group).alias("__g"), (F.col("sy") / F.col("n")).alias("__lat"), (F.col("sx") / F.col("n")).alias("__lon"))
    joined = df.join(sized(means), F.col(group) == F.col("__g"), "left").withColumn("__o", overall.scalar())
    return joined.withColumns(
        {
            "geo_latitude": F.when(both, lat).otherwise(F.coalesce("__lat", "__o.lat", F.lit(fallback[0]))),
            "geo_longitude": F.when(both, lon).otherwise(F.coalesce("__lon", "__o.lon", F.lit(fallback[1]))),
        }
    ).drop("__g", "__lat", "__lon", "__o")


def ngram_inventory(
    df: DataFrame, name: str = "project_name", low: int = 2, high: int = 5, top: int = 700, stop: Sequence[str] = fv.PLACE_STOP
) -> DataFrame:
    """Most frequent runs of 2..5 upper-case words without stop words.

    A run is at most as frequent as the shortest runs in it. These are counted first; the count that ``top`` of them reach is a bound that
    every run of the result reaches too, so longer runs are counted only where they begin and end with a run that reaches it.
    """
    # maximal runs of letters and digits, three or more, with an upper-case letter and no lower-case one
    words = F.regexp_extract_all(F.col(name), F.lit("(?<![A-Za-z0-9])(?=[0-9]*[A-Z])([A-Z0-9]{3,}+)(?![A-Za-z0-9])"), F.lit(1))
    # A stop word ends every run through it: cut the word list there instead of testing each run.
    marked = F.transform(words, lambda t: F.when(t.isin(*stop), F.lit("|")).otherwise(t)) if stop else words
    pieces = F.split(F.array_join(marked, " "), r" ?\| ?")
    lists = cut_lineage(df.select(F.explode(pieces).alias("piece")).select(F.split(F.trim("piece"), " ").alias("w")).filter(F.size("w") >= low))
    runs = lists.select(F.explode(windows(F.col("w"), high)).alias("w")).filter(F.size("w") >= low)
    shortest = cut_lineage(runs.groupBy(joined("w", 1, low, " ").alias("ngram")).agg(F.count(F.lit(1)).alias("n")))
    reached = shortest.select("n").orderBy(F.col("n").desc()).limit(top).agg(F.count("n").alias("k"), F.min("n").alias("n")).first()
    often = sized(shortest.filter(F.col("n") >= (reached["n"] if reached["k"] == top and top else 1)))
    head = often.select(F.col("ngram").alias("__head"))
    tail = often.select(F.col("ngram").alias("__tail"))
    begun = runs.filter(F.size("w") > low).join(head, joined("w", 1, low, " ") == F.col("__head"), "left_semi")
    sizes = F.sequence(F.lit(low + 1), F.size("w"))
    each = begun.select(F.explode(F.transform(sizes, lambda k: F.struct(joined("w", F.lit(1), k, " ").alias("ngram"), joined("w", k - low + 1, F.lit(low), " ").alias("tail")))).alias("g"))
    longer = each.select("g.ngram", F.col("g.tail").alias("__tail")).join(tail, "__tail", "left_semi").groupBy("ngram").agg(F.count(F.lit(1)).alias("n"))
    return often.unionByName(longer).orderBy(F.col("n").desc(), "ngram").limit(top)


def coverage_report(df: DataFrame) -> DataFrame:
    """Rows, share with coordinates, and distinct coordinates at three decimals."""
    lat, lon = F.round("geo_latitude", 3), F.round("geo_longitude", 3)
    cells = df.groupBy(lat.alias("lat"), lon.alias("lon")).agg(F.count(F.lit(1)).alias("n"))
    found = F.col("lat").isNotNull()
    return cells.agg(
        F.sum("n").alias("rows"),
        (F.sum(F.when(found, F.col("n")).otherwise(0)) / F.sum("n")).alias("coverage"),
        F.count(F.when(found, F.lit(1))).alias("distinct_coordinates"),
    )


def token_hits(df: DataFrame, matched: str = "matched") -> DataFrame:
    return df.filter(F.col(matched).isNotNull()).groupBy(matched).agg(F.count(F.lit(1)).alias("n"))
