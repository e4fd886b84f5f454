"""Table assembly: from extracted cells to labelled, deduplicated, joined project tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed_values as fv
from ..functions import text
from ..plans.ordered import exact_percentiles
from ..session import sized

CHUNK_PAGES = 64


# --------------------------------------------------------------------------- cells
def _cell(cells: Column, i: int) -> Column:
    return text.strip(F.coalesce(F.get(cells, F.lit(i)), F.lit("")))


def is_header_row(cells: Column) -> Column:
    """No serial, an all-caps name with a letter, and nothing from the fourth cell on."""
    name = _cell(cells, 1)
    rest_empty = F.forall(
        F.slice(cells, 4, F.greatest(F.size(cells) - 3, F.lit(0))),
        lambda c: text.strip(F.coalesce(c, F.lit(""))) == "",
    )
    return (
        (F.size(cells) >= 4)
        & (_cell(cells, 0) == "")
        & name.rlike(r"\p{L}")
        & (name == F.upper(name))
        & rest_empty
    )


def is_project_row(cells: Column, min_cells: int = 8) -> Column:
    """Digit serial and a name that is not a total line."""
    name = _cell(cells, 1)
    return (
        (F.size(cells) >= min_cells)
        & _cell(cells, 0).rlike("^[0-9]+$")
        & (name != "")
        & ~F.lower(name).isin(*fv.TOTAL_ROW_NAMES)
    )


def fill_down_header(rows: DataFrame, default: str = "Unknown") -> DataFrame:
    """Give every row the name of the last header row above it in its document.

    Columns doc_id, page, row, cells. Pages bound the work: one window runs over
    ``CHUNK_PAGES`` pages at a time, and a second one carries the last header of
    a chunk into the next, so a single huge document is still spread out.
    """
    marked = rows.withColumn("chunk", F.floor(F.col("page") / CHUNK_PAGES)).withColumn(
        "header", F.when(is_header_row(F.col("cells")), F.replace(_cell(F.col("cells"), 1), F.lit("\n"), F.lit(" ")))
    )
    here = Window.partitionBy("doc_id", "chunk").orderBy("page", "row").rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy("doc_id").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    carried = (
        marked.groupBy("doc_id", "chunk")
        .agg(F.max_by("header", F.when(F.col("header").isNotNull(), F.struct("page", "row"))).alias("last_header"))
        .select("doc_id", "chunk", F.last("last_header", ignorenulls=True).over(before).alias("carried"))
    )
    filled = marked.withColumn("local", F.last("header", ignorenulls=True).over(here))
    return filled.join(carried, ["doc_id", "chunk"]).select(
        *rows.columns,
        F.col("header").isNotNull().alias("is_header"),
        F.coalesce("local", "carried", F.lit(default)).alias("sector"),
    )


def section_bounds(pages: DataFrame, start_marker: str, stop_markers: Sequence[str]) -> DataFrame:
    """Per document: first page with the start marker, first later page with a stop marker.

    ``pages`` has doc_id, page, text; several rows per page are fine.
    """
    lowered = F.lower("text")
    hit_start = F.contains(lowered, F.lit(start_marker.lower()))
    hit_stop = F.lit(False)
    for m in stop_markers:
        hit_stop = hit_stop | F.contains(lowered, F.lit(m.lower()))
    marks = pages.groupBy("doc_id", "page").agg(F.max(hit_start).alias("start"), F.max(hit_stop).alias("stop"))
    starts = marks.filter("start").groupBy("doc_id").agg(F.min("page").alias("start_page"))
    stops = (
        marks.filter("stop").join(starts, "doc_id").filter(F.col("page") > F.col("start_page"))
        .groupBy("doc_id").agg(F.min("page").alias("stop_page"))
    )
    return starts.join(stops, "doc_id", "left")


def section_slice(
    rows: DataFrame, pages: DataFrame, start_marker: str, stop_markers: Sequence[str] = ()
) -> DataFrame:
    """Rows from the start page up to the page before the stop page."""
    bounds = section_bounds(pages, start_marker, stop_markers)
    return (
        rows.join(bounds, "doc_id")
        .filter((F.col("page") >= F.col("start_page")) & (F.coalesce(F.col("page") < F.col("stop_page"), F.lit(True))))
        .select(*rows.columns)
    )


def time_rows_from_cells(rows: DataFrame) -> DataFrame:
    """Typed TIME columns from filled cell rows (11-column layout)."""
    c = F.col("cells")
    doc_year = F.coalesce(text.parse_year_token(F.get(c, F.lit(6))), text.parse_year_token(F.get(c, F.lit(7))))
    return rows.filter(is_project_row(c)).select(
        "doc_id",
        "page",
        "row",
        "sector",
        F.replace(_cell(c, 1), F.lit("\n"), F.lit(" ")).alias("project_name"),
        text.clean_number_cell(F.get(c, F.lit(3))).alias("original_cost_cr"),
        text.clean_number_cell(F.get(c, F.lit(4))).alias("anticipated_cost_cr"),
        text.clean_number_cell(F.get(c, F.lit(5))).alias("expenditure_cum_cr"),
        text.parse_year_token(F.get(c, F.lit(2))).alias("approval_year"),
        doc_year.alias("planned_doc_year"),
        text.clean_number_cell(F.get(c, F.lit(8))).alias("tor_months"),
        text.clean_number_cell(F.get(c, F.lit(9))).alias("cost_overrun_pct"),
        text.strip(F.replace(F.get(c, F.lit(10)), F.lit("\n"), F.lit(" "))).alias("reasons"),
    )


def cost_rows_from_cells(rows: DataFrame) -> DataFrame:
    """Typed COST columns from filled cell rows; rows without both costs are dropped."""
    c = F.col("cells")
    split = text.split_original_revised(F.get(c, F.lit(3)))
    return (
        rows.filter(is_project_row(c))
        .select(
            "doc_id",
            "page",
            "row",
            "sector",
            F.replace(_cell(c, 1), F.lit("\n"), F.lit(" ")).alias("project_name"),
            split.getField("original").alias("original_cost_cr"),
            split.getField("revised").alias("revised_cost_cr"),
            text.clean_number_cell(F.get(c, F.lit(4))).alias("anticipated_cost_cr"),
            text.clean_number_cell(F.get(c, F.lit(5))).alias("expenditure_cum_cr"),
            text.clean_number_cell(F.get(c, F.lit(8))).alias("cost_overrun_pct"),
        )
        .dropna(subset=["original_cost_cr", "anticipated_cost_cr"])
    )


def snapshot_rows(records: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Labelled SNAPSHOT rows from record texts (``keys``, sector, name, approval, doc, cost, spent, progress).

    ``doc`` and ``cost`` read 'original (revised) {anticipated}'. The name ends at its first bracket; records whose name is
    shorter than four characters are dropped. A record without two dates has no delay, months or duration.
    """
    def once(df: DataFrame, **fields: Column) -> DataFrame:
        # a generator keeps the optimizer from copying the parses into every use of their fields
        return df.select("*", F.explode(F.array(F.struct(*[v.alias(k) for k, v in fields.items()]))).alias(f"__{'_'.join(fields)}"))

    texts = ("sector", "name", "approval", "doc", "cost", "spent", "progress")
    read = once(records, **{c: F.col(c) for c in texts}).select(*keys, F.col("__" + "_".join(texts) + ".*"))
    named = read.withColumn("project_name", F.upper(text.strip(F.split_part("name", F.lit("("), F.lit(1))))).filter(F.length("project_name") >= 4)
    parsed = once(named, c=text.bracket_cost_fields(F.col("cost")))
    parsed = once(once(parsed, d=text.bracket_date_fields(F.col("doc"))), a=text.parse_month_year(F.col("approval")))
    typed = parsed.select(
        *keys,
        F.coalesce(F.upper("sector"), F.lit("")).alias("sector"),
        "project_name",
        F.col("__c.c.original").alias("original_cost_cr"),
        F.col("__c.c.revised").alias("revised_cost_cr"),
        F.col("__c.c.anticipated").alias("anticipated_cost_cr"),
        text.clean_number_na(F.col("spent")).alias("expenditure_cum_cr"),
        F.col("__a.a.year").alias("approval_year"),
        F.col("__d.d.original.year").alias("original_doc_year"),
        F.col("__d.d.original.month_index").alias("original_doc_index"),
        F.col("__d.d.anticipated.month_index").alias("anticipated_doc_index"),
        text.clean_number_na(F.col("progress")).alias("physical_progress"),
    )
    return derive_snapshot_labels(typed)


def state_rows_from_cells(rows: DataFrame, labels: DataFrame, order: Sequence[str]) -> DataFrame:
    """STATE rows from the cells of a state-wise table (ten columns or more): one row per state, its first in ``order``.

    ``labels`` (name, state) gives the spellings to accept, cut-off ones included, and the label of each; other rows are
    passed over. An unreadable count is 0; an unreadable share or range is NULL.
    """
    c = F.col("cells")
    spelling = F.upper(text.strip(F.replace(F.coalesce(F.get(c, F.lit(1)), F.lit("")), F.lit("\n"), F.lit(" "))))
    months = text.parse_int_range(F.coalesce(F.get(c, F.lit(9)), F.lit("")))
    read = rows.filter(F.size(c) >= 10).select(
        spelling.alias("__name"),
        F.struct(*order).alias("__order"),
        F.struct(
            F.coalesce(text.clean_number_token(F.get(c, F.lit(2))), F.lit(0.0)).cast("long").alias("n_projects"),
            text.clean_number_token(F.get(c, F.lit(5))).alias("cost_overrun_pct"),
            months.getField("low").alias("tor_min_months"),
            months.getField("high").alias("tor_max_months"),
        ).alias("__row"),
    )
    known = sized(labels.select(F.upper("name").alias("__name"), "state").distinct())
    first = read.join(known, "__name").groupBy("state").agg(F.min_by("__row", "__order").alias("__row"))
    return first.select("state", "__row.*")


# --------------------------------------------------------------------------- labels
def overrun_ratio(orig: Column, ant: Column) -> Column:
    return F.when(orig != 0, (ant - orig) / orig)


def label_by_section(positive: DataFrame, negative: DataFrame, label: str) -> DataFrame:
    """Union by name with label 1 for the positive section, 0 for the negative."""
    return positive.withColumn(label, F.lit(1)).unionByName(
        negative.withColumn(label, F.lit(0)), allowMissingColumns=True
    )


def derive_snapshot_labels(df: DataFrame) -> DataFrame:
    """Labels from shown costs and dates.

    Needs original / revised / anticipated cost, month indices original_doc_index
    and anticipated_doc_index, and approval_year, original_doc_year.
    Unknown dates leave delayed, tor_months and the duration NULL.
    """
    orig = F.col("original_cost_cr")
    eff = F.coalesce("revised_cost_cr", "anticipated_cost_cr")
    known = (orig > 0) & (eff != 0)
    pct = F.when(known, F.greatest(F.lit(0.0), F.bround((eff - orig) / orig * 100, 4))).otherwise(F.lit(0.0))
    gap = F.col("anticipated_doc_index") - F.col("original_doc_index")
    return (
        df.withColumn("cost_overrun_pct", pct)
        .withColumn("overrun_flag", (F.col("cost_overrun_pct") > 0).cast("int"))
        .withColumn("overrun_ratio", F.bround(F.col("cost_overrun_pct") / 100, 6))
        .withColumn("delayed", (gap > 0).cast("int"))
        .withColumn("tor_months", F.greatest(gap, F.when(gap.isNotNull(), F.lit(0))).cast("double"))
        .withColumn(
            "planned_duration_years",
            F.when(gap.isNotNull(), F.col("original_doc_year") - F.col("approval_year")).cast("double"),
        )
    )


def planned_duration(df: DataFrame) -> DataFrame:
    """Planned completion year minus approval year where both are known."""
    gap = (F.col("planned_doc_year") - F.col("approval_year")).cast("double")
    current = F.col("planned_duration_years") if "planned_duration_years" in df.columns else F.lit(None).cast("double")
    return df.withColumn("planned_duration_years", F.coalesce(gap, current))


def fill_time_defaults(df: DataFrame, tor_rules: bool = True) -> DataFrame:
    """Load-time defaults: cost to the table median, expenditure to 0, tor rules."""
    median = exact_percentiles(df, ["original_cost_cr"]).select("value").scalar()
    out = df.withColumn("original_cost_cr", F.coalesce(F.col("original_cost_cr"), median)).withColumn(
        "expenditure_cum_cr", F.coalesce("expenditure_cum_cr", F.lit(0.0))
    )
    if not tor_rules:
        return out
    tor = F.col("tor_months")
    return out.withColumn(
        "tor_months",
        F.when(F.col("delayed") == 0, F.lit(0.0))
        .when((F.col("delayed") == 1) & tor.isNotNull(), F.least(tor, F.lit(fv.TOR_CAP_MONTHS)))
        .otherwise(tor),
    )


def census_age(df: DataFrame, cap: float = fv.TOR_CAP_MONTHS) -> DataFrame:
    """Recompute the delay label and duration of newly arrived rows.

    The flag is derived from a shown overrun only when the whole column is
    absent or empty (checked by a scalar subquery); otherwise it is kept.
    """
    tor = F.col("tor_months")
    shown = F.coalesce((tor > 0).cast("int"), F.lit(0))
    if "delayed" in df.columns:
        filled = df.agg(F.count("delayed").alias("n")).scalar()
        df = df.withColumn("delayed", F.when(filled == 0, shown).otherwise(F.col("delayed").cast("int")))
    else:
        df = df.withColumn("delayed", shown)
    df = df.withColumn(
        "tor_months",
        F.when(tor.isNull() | (F.col("delayed") == 0), F.lit(0.0))
        .when(F.col("delayed") == 1, F.least(tor, F.lit(float(cap))))
        .otherwise(tor),
    )
    if {"planned_duration_years", "approval_year", "planned_doc_year"} <= set(df.columns):
        df = planned_duration(df)
    return df


# --------------------------------------------------------------------------- keys and joins
def dedupe_keep_last(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Last row per key by ``order``.

    ``max_by`` is combined on the map side, so a key that owns a third of all
    rows costs one row per map task in the shuffle, unlike row_number.
    """
    return _pick(df, keys, F.max_by, order)


def dedupe_keep_first(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    return _pick(df, keys, F.min_by, order)


def _pick(df: DataFrame, keys: Sequence[str], pick, order: Sequence[str]) -> DataFrame:
    rest = [c for c in df.columns if c not in keys]
    if not rest:
        return df.distinct()
    return (
        df.groupBy(*keys)
        .agg(pick(F.struct(*rest), F.struct(*order)).alias("r"))
        .select(*keys, *[F.col(f"r.{c}").alias(c) for c in rest])
        .select(*df.columns)
    )


def attach_by_key(
    df: DataFrame,
    dates: DataFrame,
    keys: Sequence[str],
    columns: Sequence[str],
    policy: str,
    order: Sequence[str] = (),
) -> DataFrame:
    """Left equi-join of ``columns`` from ``dates``.

    ``policy`` settles duplicate keys on the right: 'last' or 'first' by
    ``order``, or 'fan_out' (every match). A column that ``df`` already fills
    anywhere is left alone.
    """
    if policy not in ("last", "first", "fan_out"):
        raise ValueError(f"unknown policy: {policy}")
    if policy != "fan_out" and not order:
        raise ValueError("policies 'last' and 'first' need an order")
    right = dates.select(*dict.fromkeys([*keys, *columns, *order]))
    if policy != "fan_out":
        right = (dedupe_keep_last if policy == "last" else dedupe_keep_first)(right, keys, order)
    right = right.select(*keys, *[F.col(c).alias(f"__n_{c}") for c in columns])
    out = df.join(right if policy == "fan_out" else sized(right), list(keys), "left")
    for c in columns:
        if c in df.columns:
            filled = df.agg(F.count(c).alias("n")).scalar()
            out = out.withColumn(c, F.when(filled > 0, F.col(c)).otherwise(F.col(f"__n_{c}")))
        else:
            out = out.withColumn(c, F.col(f"__n_{c}"))
    return out.drop(*[f"__n_{c}" for c in columns])


def upsert(existing: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Replace the keys found in ``new``; untouched rows, duplicates included, stay.

    NULL and empty keys are the same key.
    """

    def plain(df: DataFrame) -> DataFrame:
        return df.withColumns({k: F.coalesce(F.col(k).cast("string"), F.lit("")) for k in keys})

    existing, new = plain(existing), plain(new)
    kept = existing.join(new.select(*keys).distinct(), list(keys), "left_anti")
    return kept.unionByName(new, allowMissingColumns=True)


def augment_train(base: DataFrame, snapshot: DataFrame, label: str) -> DataFrame:
    """Union of both documents' labelled rows, tagged by document.

    Feature medians are taken per side: pass both through the pace features
    before, with their own vintage.
    """
    known = snapshot.filter(F.col(label).isNotNull())
    return base.withColumn("document", F.lit("annexure")).unionByName(
        known.withColumn("document", F.lit("snapshot")), allowMissingColumns=True
    )


def attach_year_covariates(
    df: DataFrame, yearly: DataFrame, columns: Sequence[str], year: str = "approval_year"
) -> DataFrame:
    """Left join on the year; a year without a value takes the next known one, else the previous.

    The windows run over the distinct years only.
    """
    spine = df.select(F.col(year).cast("int").alias("year")).distinct().unionByName(yearly.select("year").distinct())
    known = spine.filter("year is not null").distinct().join(yearly, "year", "left")
    by_year = Window.orderBy("year")
    later = by_year.rowsBetween(0, Window.unboundedFollowing)
    earlier = by_year.rowsBetween(Window.unboundedPreceding, 0)
    filled = known.select(
        F.col("year").alias("__year"),
        *[
            F.coalesce(
                F.first(c, ignorenulls=True).over(later), F.last(c, ignorenulls=True).over(earlier)
            ).alias(c)
            for c in columns
        ],
    )
    return df.join(sized(filled), F.col(year).cast("int") == F.col("__year"), "left").drop("__year")


# --------------------------------------------------------------------------- splits
def temporal_split(df: DataFrame, cutoff: int, width: int = 2, year: str = "approval_year"):
    """(train, test): approved up to the cutoff, and in the ``width`` years after it."""
    return df.filter(F.col(year) <= cutoff), df.filter(F.col(year).between(cutoff + 1, cutoff + width))


def clean_for_eval(df: DataFrame, label: str, cost: str = "original_cost_cr", year: str = "approval_year") -> DataFrame:
    """Rows with label, cost and approval year, with integer label and year."""
    return (
        df.dropna(subset=[label, cost, year])
        .withColumn(label, (F.col(label) > 0).cast("int"))
        .withColumn(year, F.col(year).cast("int"))
    )


