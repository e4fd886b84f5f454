"""Text cleaning, assembly, joins and upserts on the driver tables."""

from pyspark.sql import functions as F

from ..functions import text
from ..operators import assembly as op
from ..operators import portfolio, quality
from ..session import cut_lineage
from ..sources import driver_tables as dt
from .base import query

NUMBER = r"[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?"


def number_sql(expr: str) -> str:
    return f"CASE WHEN regexp_full_match({expr}, '{NUMBER}') THEN try_cast({expr} AS DOUBLE) END"


BLANKS = "' ' || chr(9) || chr(10) || chr(13)"


def strip_sql(expr: str) -> str:
    return f"trim({expr}, {BLANKS})"


def cell_sql(expr: str) -> str:
    """SQL of clean_number_cell."""
    plain = strip_sql("replace(" + expr + ", ',', '')")
    return number_sql(strip_sql(f"split_part(split_part({plain}, chr(10), 1), '-', 1)"))


def first_line_sql(expr: str) -> str:
    plain = strip_sql("replace(" + expr + ", ',', '')")
    return strip_sql(f"split_part({plain}, chr(10), 1)")


def cell(i):
    return F.get("cells", F.lit(i))


@query(
    "clean_number_cell", "cells",
    f"""SELECT doc_id, page, "row", {cell_sql('cells[4]')} AS cost, {cell_sql('cells[5]')} AS anticipated, {cell_sql('cells[6]')} AS spent,
        {cell_sql('cells[10]')} AS pct FROM cells_t""",
)
def _(spark, d):
    c = text.clean_number_cell
    return dt.cell_rows(spark, d).select(
        "doc_id", "page", "row", c(cell(3)).alias("cost"), c(cell(4)).alias("anticipated"), c(cell(5)).alias("spent"), c(cell(9)).alias("pct")
    )


@query(
    "clean_number_compact", "cells",
    f"""SELECT doc_id, page, "row", {number_sql("split_part(split_part(replace(replace(cells[6], ',', ''), ' ', ''), '-', 1), chr(10), 1)")} AS spent,
        {number_sql("trim(split_part(split_part(replace(replace(cells[4], ',', ''), ' ', ''), '-', 1), chr(10), 1))")} AS cost FROM cells_t""",
)
def _(spark, d):
    c = text.clean_number_compact
    return dt.cell_rows(spark, d).select("doc_id", "page", "row", c(cell(5)).alias("spent"), c(cell(3)).alias("cost"))


@query(
    "clean_number_na", "cells",
    f"""WITH l AS (SELECT doc_id, page, "row", {first_line_sql('cells[5]')} AS a, {first_line_sql('cells[6]')} AS b FROM cells_t)
        SELECT doc_id, page, "row", CASE WHEN upper(a) NOT IN ('N.A.', 'NA', '-', '--', '') THEN {number_sql('a')} END AS anticipated,
          CASE WHEN upper(b) NOT IN ('N.A.', 'NA', '-', '--', '') THEN {number_sql('b')} END AS spent FROM l""",
)
def _(spark, d):
    c = text.clean_number_na
    return dt.cell_rows(spark, d).select("doc_id", "page", "row", c(cell(4)).alias("anticipated"), c(cell(5)).alias("spent"))


@query(
    "clean_number_default", "cells",
    f"""WITH l AS (SELECT doc_id, page, "row", split_part(regexp_extract(replace(cells[6], ',', ''), '^\\s*(\\S+)', 1), '-', 1) AS a,
            split_part(regexp_extract(replace(cells[2], ',', ''), '^\\s*(\\S+)', 1), '-', 1) AS b FROM cells_t)
        SELECT doc_id, page, "row", coalesce({number_sql('a')}, 0.0) AS spent, coalesce({number_sql('b')}, 0.0) AS name FROM l""",
)
def _(spark, d):
    c = text.clean_number_default
    return dt.cell_rows(spark, d).select("doc_id", "page", "row", c(cell(5)).alias("spent"), c(cell(1)).alias("name"))


@query(
    "split_original_revised", "cells",
    f"""WITH l AS (SELECT doc_id, page, "row", string_split(replace(cells[4], ',', ''), chr(10)) AS p FROM cells_t)
        SELECT doc_id, page, "row", {cell_sql('p[1]')} AS original, {cell_sql('p[2]')} AS revised FROM l""",
)
def _(spark, d):
    both = dt.cell_rows(spark, d).select("doc_id", "page", "row", text.split_original_revised(cell(3)).alias("c"))
    return both.select("doc_id", "page", "row", "c.original", "c.revised")


@query(
    "parse_month_year", "cells",
    """WITH l AS (SELECT doc_id, page, "row", regexp_extract(cells[7], '([0-9]{1,2})[/-]([0-9]{4})', 1) AS m,
            regexp_extract(cells[7], '([0-9]{1,2})[/-]([0-9]{4})', 2) AS y FROM cells_t)
       SELECT doc_id, page, "row", try_cast(y AS INTEGER) AS year, try_cast(m AS INTEGER) AS month,
         try_cast(y AS INTEGER) * 12 + try_cast(m AS INTEGER) AS month_index FROM l""",
)
def _(spark, d):
    return dt.cell_rows(spark, d).select("doc_id", "page", "row", text.parse_month_year(cell(6)).alias("m")).select(
        "doc_id", "page", "row", "m.year", "m.month", "m.month_index"
    )


@query(
    "parse_year_token", "cells",
    r"""SELECT doc_id, page, "row", try_cast(regexp_extract(replace(cells[7], chr(10), ' '), '(?:^|\s)[^/\s]*/([^/\s]{4})(?:\s|$)', 1) AS INTEGER) AS planned_year,
          try_cast(regexp_extract(cells[3], '(?:^|\s)[^/\s]*/([^/\s]{4})(?:\s|$)', 1) AS INTEGER) AS approval_year FROM cells_t""",
)
def _(spark, d):
    y = text.parse_year_token
    return dt.cell_rows(spark, d).select("doc_id", "page", "row", y(cell(6)).alias("planned_year"), y(cell(2)).alias("approval_year"))


@query(
    "bracket_fields", "cells",
    """WITH l AS (SELECT doc_id, page, "row", cells FROM cells_t WHERE cells[1] <> '')
       SELECT doc_id, page, "row", try_cast(split_part(cells[3], '/', 2) AS INTEGER) AS original_year,
         try_cast(split_part(split_part(cells[7], chr(10), 1), '/', 2) AS INTEGER) AS revised_year,
         CASE WHEN CAST(cells[1] AS INTEGER) % 3 = 0 THEN NULL ELSE try_cast(split_part(cells[8], '/', 2) AS INTEGER) END AS anticipated_year,
         try_cast(replace(split_part(cells[4], chr(10), 1), ',', '') AS DOUBLE) AS original_cost,
         try_cast(replace(cells[5], ',', '') AS DOUBLE) AS revised_cost FROM l""",
)
def _(spark, d):
    rows = dt.cell_rows(spark, d).filter(cell(0) != "")
    first = F.split_part(cell(6), F.lit("\n"), F.lit(1))
    third = F.when(cell(0).cast("int") % 3 == 0, F.lit("")).otherwise(F.concat(F.lit(" {"), cell(7), F.lit("}")))
    dates = text.bracket_date_fields(F.concat(cell(2), F.lit(" ("), first, F.lit(")"), third))
    costs = text.bracket_cost_fields(F.concat(F.split_part(cell(3), F.lit("\n"), F.lit(1)), F.lit(" ("), cell(4), F.lit(")")))
    return rows.select("doc_id", "page", "row", dates.alias("d"), costs.alias("c")).select(
        "doc_id",
        "page",
        "row",
        F.col("d.original.year").alias("original_year"),
        F.col("d.revised.year").alias("revised_year"),
        F.col("d.anticipated.year").alias("anticipated_year"),
        F.col("c.original").alias("original_cost"),
        F.col("c.revised").alias("revised_cost"),
    )


@query(
    "parse_int_range", "",
    """SELECT l_orderkey, l_partkey, l_suppkey, CAST(-l_linenumber AS INTEGER) AS low, CAST(l_quantity AS INTEGER) AS high FROM lineitem""",
)
def _(spark, d):
    line = dt.load(spark, d, "lineitem")
    cell_text = F.concat((-F.col("l_linenumber")).cast("string"), F.lit("\n - "), F.col("l_quantity").cast("int").cast("string"), F.lit(" mo"))
    return line.select("l_orderkey", "l_partkey", "l_suppkey", text.parse_int_range(cell_text).alias("r")).select(
        "l_orderkey", "l_partkey", "l_suppkey", "r.low", "r.high"
    )


@query(
    "norm_key", "cells",
    """SELECT doc_id, page, "row", regexp_replace(lower(name), '[^a-z0-9]', '', 'g') AS k FROM (SELECT doc_id, page, "row", cells[2] AS name FROM cells_t)""",
)
def _(spark, d):
    return dt.cell_rows(spark, d).select("doc_id", "page", "row", text.norm_key(cell(1)).alias("k"))


LABELS = ("BUILDING", "BUILDING WORKS", "AUTOMOBILE", "HOUSEHOLD GOODS AND REPAIR", "MACHINERY", "FURNITURE MAKING", "SMALL MACHINERY")


@query(
    "snap_label", "",
    """WITH v AS (SELECT c_custkey, c_mktsegment AS raw, CASE c_custkey % 4 WHEN 0 THEN c_mktsegment WHEN 1 THEN substr(c_mktsegment, 1, 4)
              WHEN 2 THEN 'GOODS AND REPAIR' ELSE lower(c_mktsegment) || ' works:' END AS t FROM customer),
         k(label) AS (VALUES ('BUILDING'), ('BUILDING WORKS'), ('AUTOMOBILE'), ('HOUSEHOLD GOODS AND REPAIR'), ('MACHINERY'), ('FURNITURE MAKING'), ('SMALL MACHINERY')),
         n AS (SELECT *, rtrim(upper(t), ':') AS u FROM v),
         hits AS (SELECT c_custkey, label, row_number() OVER (PARTITION BY c_custkey ORDER BY label <> u, length(label) DESC, label) AS rn
                  FROM n, k WHERE contains(replace(label, ' ', ''), replace(u, ' ', '')) OR contains(replace(u, ' ', ''), replace(label, ' ', ''))
                    OR starts_with(label || ' ', u || ' ') OR (contains(u, ' ') AND ends_with(' ' || label, ' ' || u)))
       SELECT n.c_custkey, t, coalesce(label, t) AS label FROM n LEFT JOIN hits ON n.c_custkey = hits.c_custkey AND rn = 1""",
)
def _(spark, d):
    seg, key = F.col("c_mktsegment"), F.col("c_custkey") % 4
    t = F.when(key == 0, seg).when(key == 1, F.substring(seg, 1, 4)).when(key == 2, F.lit("GOODS AND REPAIR"))
    rows = dt.load(spark, d, "customer").withColumn("t", t.otherwise(F.concat(F.lower(seg), F.lit(" works:"))))
    return rows.select("c_custkey", "t", text.snap_label(F.col("t"), LABELS).alias("label"))


@query(
    "alias_label", "",
    """WITH c AS (SELECT c_custkey, c_acctbal, CASE upper(substr(c_mktsegment, 1, 4)) WHEN 'BUIL' THEN 'BUILDING' WHEN 'FURN' THEN 'FURNITURE'
              ELSE upper(substr(c_mktsegment, 1, 4)) END AS label FROM customer)
       SELECT label, c_custkey, c_acctbal FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY c_custkey) AS rn FROM c) WHERE rn = 1""",
)
def _(spark, d):
    short = F.substring("c_mktsegment", 1, 4)
    rows = dt.load(spark, d, "customer").select(
        "c_custkey", "c_acctbal", text.alias_label(short, {"BUIL": "BUILDING", "FURN": "FURNITURE"}).alias("label")
    )
    return text.first_per_label(rows, "label", ["c_custkey"])


@query(
    "extract_agency", "time cost",
    r"""SELECT project_name, nullif(upper(trim(regexp_extract(project_name, '\]\s*([^,\]]+?)\s*,', 1))), '') AS agency
        FROM (SELECT project_name FROM time_t UNION ALL SELECT project_name FROM cost_t)""",
)
def _(spark, d):
    names = dt.time_table(spark, d).select("project_name").unionByName(dt.cost_table(spark, d).select("project_name"))
    return names.select("project_name", text.extract_agency(F.col("project_name")).alias("agency"))


@query(
    "extract_base_name", "cost",
    r"""WITH b AS (SELECT project_name, upper(trim(regexp_extract(project_name, '^([^\[(]*)', 1))) AS base FROM cost_t)
        SELECT project_name, CASE WHEN length(base) >= 4 THEN base END AS base_name FROM b""",
)
def _(spark, d):
    return dt.cost_table(spark, d).select("project_name", text.extract_base_name(F.col("project_name")).alias("base_name"))


# --------------------------------------------------------------------------- assembly
def written_cells(spark, d):
    """Cell rows written once: headers, carried headers and section marks read them apart, and each would spell out all cells anew."""
    return cut_lineage(dt.cell_rows(spark, d))


@query("fill_down_header", "cells", 'SELECT doc_id, page, "row", is_header, sector FROM filled_cells')
def _(spark, d):
    return op.fill_down_header(written_cells(spark, d)).select("doc_id", "page", "row", "is_header", "sector")


@query("is_project_row", "cells", 'SELECT doc_id, page, "row", cells[2] AS name FROM flagged_cells WHERE is_project')
def _(spark, d):
    rows = dt.cell_rows(spark, d)
    return rows.filter(op.is_project_row(F.col("cells"))).select("doc_id", "page", "row", cell(1).alias("name"))


SLICE_SQL = """
starts AS (SELECT doc_id, min(page) AS start_page FROM cells_t WHERE contains(lower(line), 'that') GROUP BY doc_id),
stops AS (SELECT c.doc_id, min(page) AS stop_page FROM cells_t c JOIN starts s ON c.doc_id = s.doc_id
          WHERE (contains(lower(line), 'whom') OR contains(lower(line), 'she')) AND page > start_page GROUP BY c.doc_id),
sliced AS (SELECT f.* FROM filled_cells f JOIN starts s ON f.doc_id = s.doc_id LEFT JOIN stops e ON f.doc_id = e.doc_id
           WHERE page >= start_page AND (stop_page IS NULL OR page < stop_page))"""


def section(rows, cells):
    """Rows of the section, whose marks stand in the lines of ``cells``."""
    pages = cells.select("doc_id", "page", F.col("line").alias("text"))
    return op.section_slice(rows, pages, "that", ("whom", "she"))


@query("section_slice", "cells", "WITH " + SLICE_SQL.strip() + ' SELECT doc_id, page, "row", line FROM sliced')
def _(spark, d):
    rows = written_cells(spark, d)
    return section(op.fill_down_header(rows), rows).select("doc_id", "page", "row", "line")


@query(
    "label_by_section", "cells",
    "WITH " + SLICE_SQL.strip() + f""",
    typed AS (SELECT doc_id, page, "row", sector, cells[2] AS project_name, {cell_sql("split_part(cells[4], chr(10), 1)")} AS original_cost_cr,
        {cell_sql("string_split(cells[4], chr(10))[2]")} AS revised_cost_cr, {cell_sql('cells[5]')} AS anticipated_cost_cr, {cell_sql('cells[6]')} AS expenditure_cum_cr
      FROM filled_cells WHERE is_project),
    tagged AS (SELECT t.*, s.doc_id IS NOT NULL AS inside FROM typed t LEFT JOIN sliced s ON t.doc_id = s.doc_id AND t.page = s.page AND t."row" = s."row")
    SELECT doc_id, page, "row", sector, project_name, original_cost_cr, revised_cost_cr, anticipated_cost_cr, expenditure_cum_cr,
      CAST(inside AS INTEGER) AS overrun_flag, round(CASE WHEN original_cost_cr <> 0 THEN (anticipated_cost_cr - original_cost_cr) / original_cost_cr END, 6) AS overrun_ratio
    FROM tagged WHERE original_cost_cr IS NOT NULL AND anticipated_cost_cr IS NOT NULL""",
)
def _(spark, d):
    rows = written_cells(spark, d)
    cost = cut_lineage(op.cost_rows_from_cells(op.fill_down_header(rows)))
    inside = section(cost, rows)
    keys = ["doc_id", "page", "row"]
    outside = cost.join(inside.select(*keys), keys, "left_anti")
    both = op.label_by_section(inside, outside, "overrun_flag").drop("cost_overrun_pct")
    ratio = op.overrun_ratio(F.col("original_cost_cr"), F.col("anticipated_cost_cr"))
    return both.withColumn("overrun_ratio", F.round(ratio, 6))


@query(
    "time_rows_from_cells", "cells",
    f"""SELECT doc_id, page, "row", sector, cells[2] AS project_name, {cell_sql('cells[4]')} AS original_cost_cr, {cell_sql('cells[5]')} AS anticipated_cost_cr,
          {cell_sql('cells[6]')} AS expenditure_cum_cr, CAST(split_part(cells[3], '/', 2) AS INTEGER) AS approval_year,
          CAST(split_part(split_part(cells[7], chr(10), 1), '/', 2) AS INTEGER) AS planned_doc_year, {cell_sql('cells[9]')} AS tor_months,
          {cell_sql('cells[10]')} AS cost_overrun_pct, replace(cells[11], chr(10), ' ') AS reasons FROM filled_cells WHERE is_project""",
)
def _(spark, d):
    return op.time_rows_from_cells(op.fill_down_header(written_cells(spark, d)))


def month_sql(expr: str, part: int) -> str:
    return f"try_cast(split_part({expr}, '/', {part}) AS INTEGER)"


_REVISED = "string_split(cells[4], chr(10))[2]"
_GAP = "(a_year * 12 + a_month) - (o_year * 12 + o_month)"


@query(
    "snapshot_rows_from_cells", "cells",
    f"""WITH r AS (
      SELECT doc_id, page, "row", upper(sector) AS sector, upper(trim(cells[2])) AS project_name, {cell_sql("split_part(cells[4], chr(10), 1)")} AS original_cost_cr,
        CASE WHEN {_REVISED} <> '-' THEN {cell_sql(_REVISED)} END AS revised_cost_cr,
        CASE WHEN cells[5] <> 'N.A.' THEN {cell_sql('cells[5]')} END AS anticipated_cost_cr, try_cast(cells[9] AS DOUBLE) AS expenditure_cum_cr,
        {month_sql('cells[3]', 2)} AS approval_year, {month_sql("split_part(cells[7], chr(10), 1)", 2)} AS o_year, {month_sql("split_part(cells[7], chr(10), 1)", 1)} AS o_month,
        CASE WHEN CAST(cells[1] AS INTEGER) % 3 <> 0 THEN {month_sql('cells[8]', 2)} END AS a_year, {month_sql('cells[8]', 1)} AS a_month,
        CASE WHEN cells[10] <> '-' THEN try_cast(cells[10] AS DOUBLE) END AS physical_progress
      FROM filled_cells WHERE is_project AND length(trim(cells[2])) >= 4),
    e AS (SELECT *, coalesce(revised_cost_cr, anticipated_cost_cr) AS eff, {_GAP} AS gap FROM r),
    o AS (SELECT *, CASE WHEN original_cost_cr > 0 AND eff <> 0 THEN greatest(0.0, round_even((eff - original_cost_cr) / original_cost_cr * 100, 4)) ELSE 0.0 END AS pct FROM e)
    SELECT doc_id, page, "row", sector, project_name, original_cost_cr, revised_cost_cr, anticipated_cost_cr, expenditure_cum_cr, approval_year,
      o_year AS original_doc_year, physical_progress, pct AS cost_overrun_pct, CAST(pct > 0 AS INTEGER) AS overrun_flag, round_even(pct / 100, 6) AS overrun_ratio,
      CAST(gap > 0 AS INTEGER) AS delayed, CAST(greatest(gap, CASE WHEN gap IS NOT NULL THEN 0 END) AS DOUBLE) AS tor_months,
      CASE WHEN gap IS NOT NULL THEN CAST(o_year - approval_year AS DOUBLE) END AS planned_duration_years FROM o""",
)
def _(spark, d):
    rows = op.fill_down_header(written_cells(spark, d))
    anticipated = F.when(cell(0).cast("int") % 3 == 0, F.lit("")).otherwise(F.concat(F.lit(" {"), cell(7), F.lit("}")))
    records = rows.filter(op.is_project_row(F.col("cells"))).select(
        "doc_id", "page", "row", "sector",
        F.concat(cell(1), F.lit(" (STATE)")).alias("name"),
        cell(2).alias("approval"),
        F.concat(F.split_part(cell(6), F.lit("\n"), F.lit(1)), F.lit(" (12/2030)"), anticipated).alias("doc"),
        F.concat(F.split_part(cell(3), F.lit("\n"), F.lit(1)), F.lit(" ("), F.split_part(cell(3), F.lit("\n"), F.lit(2)), F.lit(") {"), cell(4), F.lit("}")).alias("cost"),
        cell(8).alias("spent"),
        cell(9).alias("progress"),
    )
    return op.snapshot_rows(records, ["doc_id", "page", "row"]).drop("original_doc_index", "anticipated_doc_index")


@query(
    "state_rows_from_cells", "time",
    """WITH c AS (SELECT project_id, state, CASE WHEN project_id % 7 = 0 THEN 'n.a.' ELSE format('{:,}', project_id) END AS n, format('{:,.2f}', cost_overrun_pct) AS pct,
           CAST(tor_months AS INTEGER) - 12 AS low, CAST(tor_months AS INTEGER) AS high FROM time_t WHERE project_id % 11 <> 0),
       f AS (SELECT *, row_number() OVER (PARTITION BY state ORDER BY project_id) AS k FROM c)
       SELECT state, coalesce(try_cast(replace(n, ',', '') AS BIGINT), 0) AS n_projects, CAST(replace(pct, ',', '') AS DOUBLE) AS cost_overrun_pct,
         low AS tor_min_months, high AS tor_max_months, CASE WHEN high IS NOT NULL THEN least(high, 120) / 120.0::DOUBLE END AS delay_risk FROM f WHERE k = 1""",
)
def _(spark, d):
    key, tor = F.col("project_id"), F.col("tor_months").cast("int")
    short = F.replace(F.col("state"), F.lit("NATION_"), F.lit("N"))
    name = F.when(key % 11 == 0, F.lit("Total")).when(key % 3 == 0, short).when(key % 3 == 1, F.concat(F.lit(" "), F.lower("state"), F.lit("\n"))).otherwise(F.col("state"))
    blank = F.lit("")
    cells = F.array(
        key.cast("string"), name, F.when(key % 7 == 0, F.lit("n.a.")).otherwise(F.format_number(key, 0)), blank, blank,
        F.concat(F.format_number("cost_overrun_pct", 2), F.lit("-\n")), blank, blank, blank,
        F.coalesce(F.concat((tor - 12).cast("string"), F.lit("\n- "), tor.cast("string")), F.lit("Nil")),
    )
    rows = dt.time_table(spark, d).select("project_id", cells.alias("cells"))
    names = dt.load(spark, d, "nation").select(F.col("n_name").alias("state"))
    labels = names.select(F.col("state").alias("name"), "state").unionByName(names.select(short.alias("name"), "state"))
    return portfolio.state_risk_index(op.state_rows_from_cells(rows, labels, ["project_id"]))


@query(
    "derive_snapshot_labels", "snap",
    """SELECT project_id, line, project_name, original_cost_cr, round(cost_overrun_pct, 4) AS cost_overrun_pct, overrun_flag, round(overrun_ratio, 6) AS overrun_ratio,
         delayed, tor_months, planned_duration_years FROM snap_t""",
)
def _(spark, d):
    return op.derive_snapshot_labels(dt.snapshot_table(spark, d)).select(
        "project_id", "line", "project_name", "original_cost_cr", "cost_overrun_pct", "overrun_flag", "overrun_ratio", "delayed",
        "tor_months", "planned_duration_years",
    )


ORDER_ALL = ["l_shipdate", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus"]


@query(
    "dedupe_keep_last", "",
    f"""SELECT l_orderkey, l_linenumber, l_shipdate, l_partkey, l_suppkey, l_quantity, l_extendedprice FROM (
         SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY {', '.join(c + ' DESC' for c in ORDER_ALL)}) AS rn FROM lineitem) WHERE rn = 1""",
)
def _(spark, d):
    kept = op.dedupe_keep_last(dt.load(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"], ORDER_ALL)
    return kept.select("l_orderkey", "l_linenumber", "l_shipdate", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")


@query("planned_duration", "time", "SELECT project_id, CAST(planned_doc_year - approval_year AS DOUBLE) AS planned_duration_years FROM time_t")
def _(spark, d):
    t = dt.time_table(spark, d).drop("planned_duration_years")
    return op.planned_duration(t).select("project_id", "planned_duration_years")


@query(
    "fill_time_defaults", "time",
    """WITH t AS (SELECT project_id, CASE WHEN project_id % 3 = 0 THEN NULL ELSE original_cost_cr END AS c, expenditure_cum_cr AS e, tor_months * 4 AS tor, delayed FROM time_t)
       SELECT project_id, round(coalesce(c, (SELECT median(c) FROM t)), 6) AS original_cost_cr, coalesce(e, 0) AS expenditure_cum_cr,
         CASE WHEN delayed = 0 THEN 0 WHEN delayed = 1 THEN least(tor, 240) ELSE tor END AS tor_months FROM t""",
)
def _(spark, d):
    t = dt.time_table(spark, d)
    holes = t.withColumns(
        {"original_cost_cr": F.when(F.col("project_id") % 3 != 0, F.col("original_cost_cr")), "tor_months": F.col("tor_months") * 4}
    )
    out = op.fill_time_defaults(holes).select("project_id", "original_cost_cr", "expenditure_cum_cr", "tor_months")
    return out.withColumn("original_cost_cr", F.round("original_cost_cr", 6))


def dated(spark, d):
    return dt.time_table(spark, d).select("project_id", "sector", "approval_year", "planned_duration_years")


@query(
    "attach_by_key_last", "time cost",
    """WITH r AS (SELECT sector, approval_year, planned_duration_years, row_number() OVER (PARTITION BY sector ORDER BY project_id DESC) AS rn FROM time_t)
       SELECT state, p.sector, count(*) AS n, min(r.approval_year) AS year_low, max(r.approval_year) AS year_high, sum(r.planned_duration_years) AS years
       FROM (SELECT state, sector FROM time_t) p LEFT JOIN r ON p.sector = r.sector AND rn = 1 GROUP BY state, p.sector""",
)
def _(spark, d):
    projects = dt.time_table(spark, d).select("state", "sector")
    out = op.attach_by_key(projects, dated(spark, d), ["sector"], ["approval_year", "planned_duration_years"], "last", ["project_id"])
    return out.groupBy("state", "sector").agg(
        F.count(F.lit(1)).alias("n"), F.min("approval_year").alias("year_low"), F.max("approval_year").alias("year_high"),
        F.sum("planned_duration_years").alias("years"),
    )


@query(
    "attach_by_key_first", "time cost",
    """SELECT c.project_id, c.line, c.project_name, c.original_cost_cr, t.approval_year, t.planned_duration_years
       FROM cost_t c LEFT JOIN time_t t ON c.project_id = t.project_id""",
)
def _(spark, d):
    cost = dt.cost_table(spark, d).select("project_id", "line", "project_name", "original_cost_cr")
    return op.attach_by_key(cost, dated(spark, d), ["project_id"], ["approval_year", "planned_duration_years"], "first", ["sector"])


@query(
    "attach_by_key_fan_out", "time cost",
    """SELECT t.project_id, c.line, c.overrun_flag FROM time_t t LEFT JOIN cost_t c ON t.project_id = c.project_id""",
)
def _(spark, d):
    return op.attach_by_key(
        dt.time_table(spark, d).select("project_id"), dt.cost_table(spark, d), ["project_id"], ["line", "overrun_flag"], "fan_out"
    ).select("project_id", "line", "overrun_flag")


@query(
    "upsert", "",
    """WITH e AS (SELECT CAST(user_id AS VARCHAR) AS user_id, event_type, event_id, value FROM events WHERE ts < TIMESTAMP '2024-01-16'),
         n AS (SELECT CAST(user_id AS VARCHAR) AS user_id, event_type, event_id, value FROM events WHERE ts >= TIMESTAMP '2024-01-16')
       SELECT * FROM e WHERE (user_id, event_type) NOT IN (SELECT user_id, event_type FROM n) UNION ALL SELECT * FROM n""",
)
def _(spark, d):
    e = dt.load(spark, d, "events").select("user_id", "event_type", "event_id", "value", "ts")
    old = e.filter(F.col("ts") < F.lit("2024-01-16").cast("timestamp")).drop("ts")
    new = e.filter(F.col("ts") >= F.lit("2024-01-16").cast("timestamp")).drop("ts")
    return op.upsert(old, new, ["user_id", "event_type"])


@query(
    "census_age", "time",
    """SELECT project_id, CAST(coalesce(tor_months > 0, false) AS INTEGER) AS delayed,
         CASE WHEN coalesce(tor_months, 0) > 0 THEN least(tor_months, 36) ELSE 0 END AS tor_months,
         CAST(planned_doc_year - approval_year AS DOUBLE) AS planned_duration_years FROM time_t""",
)
def _(spark, d):
    t = dt.time_table(spark, d).withColumn("delayed", F.lit(None).cast("int"))
    return op.census_age(t, 36.0).select("project_id", "delayed", "tor_months", "planned_duration_years")


@query(
    "augment_train", "snap",
    """SELECT document, sector, count(*) AS n, CAST(sum(label) AS BIGINT) AS positives, round(avg(share), 6) AS mean_share FROM (
         SELECT 'annexure' AS document, sector, delayed AS label, CASE WHEN planned_duration_years > 0 THEN
             least(greatest((2001.92::DOUBLE - approval_year) / greatest(planned_duration_years, 0.5), 0), 6) END AS share FROM time_t
         UNION ALL
         SELECT 'snapshot', sector, delayed, CASE WHEN planned_duration_years > 0 THEN
             least(greatest((2002.92::DOUBLE - approval_year) / greatest(planned_duration_years, 0.5), 0), 6) END FROM snap_t WHERE delayed IS NOT NULL)
       GROUP BY document, sector""",
)
def _(spark, d):
    from ..operators.features import pace_features

    base = pace_features(dt.time_table(spark, d).select("sector", "delayed", "approval_year", "planned_duration_years", "original_cost_cr", "expenditure_cum_cr"), dt.SNAP_YEAR)
    snap = op.derive_snapshot_labels(dt.snapshot_table(spark, d))
    snap = pace_features(snap.select("sector", "delayed", "approval_year", "planned_duration_years", "original_cost_cr", "expenditure_cum_cr"), dt.SNAP_YEAR + 1)
    return op.augment_train(base, snap, "delayed").groupBy("document", "sector").agg(
        F.count(F.lit(1)).alias("n"), F.sum("delayed").alias("positives"), F.round(F.avg("elapsed_share"), 6).alias("mean_share")
    )


@query(
    "attach_year_covariates", "time prices",
    """SELECT project_id, approval_year, CASE WHEN approval_year <> 1997 THEN wpi_metal ELSE (SELECT wpi_metal FROM prices_t WHERE year = 1998) END AS wpi_metal,
         CASE WHEN approval_year < 2000 THEN wpi_cement ELSE (SELECT wpi_cement FROM prices_t WHERE year = 1999) END AS wpi_cement
       FROM time_t JOIN prices_t ON approval_year = year""",
)
def _(spark, d):
    yearly = dt.yearly_prices(spark, d)
    yearly = yearly.withColumn("wpi_cement", F.when(F.col("year") < 2000, F.col("wpi_cement")))
    t = dt.time_table(spark, d).select("project_id", "approval_year")
    return op.attach_year_covariates(t, yearly, ["wpi_metal", "wpi_cement"])


@query(
    "temporal_split", "time",
    """SELECT CASE WHEN approval_year <= 1998 THEN 'train' ELSE 'test' END AS part, count(*) AS n, round(avg(delayed), 6) AS rate FROM time_t
       WHERE approval_year <= 2000 GROUP BY 1""",
)
def _(spark, d):
    train, test = op.temporal_split(dt.time_table(spark, d), 1998)
    both = train.withColumn("part", F.lit("train")).unionByName(test.withColumn("part", F.lit("test")))
    return both.groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("delayed"), 6).alias("rate"))


@query("clean_for_eval", "time", "SELECT project_id, CAST(delayed > 0 AS INTEGER) AS delayed, approval_year FROM time_t WHERE delayed IS NOT NULL")
def _(spark, d):
    return op.clean_for_eval(dt.time_table(spark, d), "delayed").select("project_id", "delayed", "approval_year")


# --------------------------------------------------------------------------- quality
@query(
    "schema_report", "time",
    """SELECT 'missing_column' AS "check", 'physical_progress' AS "column", CAST(1 AS BIGINT) AS violations
       UNION ALL SELECT 'null', 'delayed', count(*) FILTER (delayed IS NULL) FROM time_t
       UNION ALL SELECT 'null', 'reasons', count(*) FILTER (reasons IS NULL) FROM time_t
       UNION ALL SELECT 'duplicate_key', 'sector|agency', count(*) - count(DISTINCT (sector, agency)) FROM time_t""",
)
def _(spark, d):
    t = dt.time_table(spark, d).select("sector", "agency", "delayed", "reasons")
    return quality.schema_report(t, [*t.columns, "physical_progress"], ["delayed", "reasons"], ["sector", "agency"])


@query(
    "validate_rules", "rules",
    """WITH v AS (SELECT count(*) FILTER (NOT start_date < original_completion_date) AS a,
           count(*) FILTER (delay_months > 0 AND NOT original_completion_date < revised_completion_date) AS b,
           count(*) FILTER (delay_months = 0 AND NOT abs(revised_budget_cr - original_budget_cr) <= 1e-8 + 1e-5 * abs(original_budget_cr)) AS c,
           count(*) FILTER (delay_months > 12 AND revised_budget_cr > original_budget_cr AND NOT revised_budget_cr >= 1.15::DOUBLE * original_budget_cr) AS d,
           count(*) FILTER (NOT financial_progress_pct - physical_progress_pct <= 25.000001) AS e,
           count(*) FILTER (physical_progress_pct > 60 AND NOT land_acquisition_pct > 75) AS f FROM rules_t)
       SELECT 'chronology_start_lt_orig' AS rule, a AS violations, a = 0 AS passed FROM v
       UNION ALL SELECT 'chronology_orig_lt_revised' AS rule, b AS violations, b = 0 AS passed FROM v
       UNION ALL SELECT 'zero_delay_cost_equal' AS rule, c AS violations, c = 0 AS passed FROM v
       UNION ALL SELECT 'high_delay_cost_gte_15pct' AS rule, d AS violations, d = 0 AS passed FROM v
       UNION ALL SELECT 'physical_financial_gap' AS rule, e AS violations, e = 0 AS passed FROM v
       UNION ALL SELECT 'land_constraint' AS rule, f AS violations, f = 0 AS passed FROM v""",
)
def _(spark, d):
    return quality.validate_rules(dt.rule_table(spark, d))


@query(
    "target_leak_check", "time",
    """WITH l AS (SELECT 'tor_months' AS feature, tor_months AS s, delayed AS y FROM time_t WHERE delayed IS NOT NULL
           UNION ALL SELECT 'cost_overrun_pct', cost_overrun_pct, delayed FROM time_t WHERE delayed IS NOT NULL),
         r AS (SELECT *, rank() OVER (PARTITION BY feature ORDER BY s) + (count(*) OVER (PARTITION BY feature, s) - 1) / 2.0::DOUBLE AS rk FROM l),
         a AS (SELECT feature, avg(CAST(CAST(s > 0 AS INTEGER) = y AS DOUBLE)) AS agreement,
             (sum(rk) FILTER (y = 1) - count(*) FILTER (y = 1)::DOUBLE * (count(*) FILTER (y = 1) + 1) / 2) / (count(*) FILTER (y = 1)::DOUBLE * count(*) FILTER (y = 0)) AS auc
           FROM r GROUP BY feature)
       SELECT feature, round(agreement, 6) AS agreement, round(auc, 6) AS auc, agreement >= 0.98 OR greatest(auc, 1 - auc) >= 0.98 AS collinear FROM a""",
)
def _(spark, d):
    out = quality.target_leak_check(dt.time_table(spark, d), ["tor_months", "cost_overrun_pct"], "delayed")
    return out.withColumns({"agreement": F.round("agreement", 6), "auc": F.round("auc", 6)})


@query(
    "profile", "time",
    """SELECT 'tor_months' AS "column", count(*) AS rows, count(*) - count(tor_months) AS nulls, count(DISTINCT tor_months) AS distinct_values,
         round(avg(tor_months), 6) AS mean, min(tor_months) AS minimum, max(tor_months) AS maximum FROM time_t
       UNION ALL SELECT 'original_cost_cr', count(*), count(*) - count(original_cost_cr), count(DISTINCT original_cost_cr), round(avg(original_cost_cr), 6),
         min(original_cost_cr), max(original_cost_cr) FROM time_t""",
)
def _(spark, d):
    return quality.profile(dt.time_table(spark, d), ["tor_months", "original_cost_cr"]).withColumn("mean", F.round("mean", 6))


@query("value_counts", "time", "SELECT reasons, count(*) AS n FROM time_t GROUP BY reasons")
def _(spark, d):
    return quality.value_counts(dt.time_table(spark, d), "reasons")
