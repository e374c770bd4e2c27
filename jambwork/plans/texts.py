"""Queries over the lines of schedule pages, which are written from the tables and read back.

The oracles state what the lines were written from, not the rules by which they are
read. Two openings in a row share a format; in two of the three they share a page.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from jambwork.operators import annotation, boxes, edits, grammar, grids, healing, pages, quantity
from jambwork.functions import taxonomy as C
from jambwork.functions import text as T
from jambwork.plans.catalog import query
from jambwork.sources.tables import frame, table

#: Each item of an opening as the page's columns; n counts the opening's items.
PARTS = """
SELECT *, CASE n % 3 WHEN 0 THEN concat('L', 100 + n, CAST(qty AS STRING)) WHEN 1 THEN concat(CAST(1000 + n * 7 AS STRING), 'XP 3/4') ELSE '' END AS catalog,
  CASE WHEN kind = 2 THEN 'US26D' ELSE CASE n % 4 WHEN 0 THEN '626' WHEN 1 THEN 'US32D' WHEN 2 THEN 'AL' ELSE '' END END AS finish,
  CASE kind WHEN 0 THEN CASE n % 5 WHEN 0 THEN '' WHEN 1 THEN 'IVE' WHEN 2 THEN 'LCN' WHEN 3 THEN 'ZER' ELSE 'B/O' END
    WHEN 1 THEN CASE n % 3 WHEN 0 THEN 'Zero' WHEN 1 THEN '' ELSE 'Von Duprin' END ELSE 'Schlage' END AS maker,
  CASE kind WHEN 0 THEN CASE WHEN n % 3 = 0 THEN 'HVY WT' ELSE '' END
    WHEN 1 THEN CASE n % 4 WHEN 0 THEN 'International' WHEN 1 THEN 'Wt' WHEN 2 THEN 'At header only' ELSE 'Per door schedule' END ELSE '' END AS more
FROM (SELECT opening_id, opening_id - opening_id % 2 + CASE WHEN kind = 0 THEN opening_id % 2 ELSE 0 END AS page, kind, n, qty, base
  FROM (SELECT opening_id, CAST(floor(opening_id / 2) AS BIGINT) % 3 AS kind, qty, trim(regexp_replace(regexp_replace(name, '[0-9].*$', ''), '[(].*$', '')) AS base,
    row_number() OVER (PARTITION BY opening_id ORDER BY pos, name, qty, leaf_side) AS n FROM {hardware}))
"""

#: Lines of pages: headings, doors, sizes, marks, items, what goes on with them, notes and ends.
LINES = """
SELECT opening_id - opening_id % 2 + CASE WHEN kind = 0 THEN opening_id % 2 ELSE 0 END AS page, opening_id % 2 * 100000 + k AS line, text FROM (
  SELECT opening_id, kind, stack(6,
    1, CASE kind WHEN 0 THEN concat('Heading ', hw_set, ' (HwSet ', opening_id % 40, 'A)') WHEN 1 THEN concat('Heading #: ', hw_set) ELSE concat('Hardware Set ', hw_set) END,
    2, CASE WHEN kind = 2 THEN concat('For ', leaf_count, CASE WHEN leaf_count > 1 THEN ' Pair' ELSE ' Single' END, ' Doors #', 100 + opening_id % 900)
      ELSE concat('1 ', CASE WHEN leaf_count > 1 THEN 'PR' ELSE 'SGL' END, ' DOOR(S)', opening_id % 90 + 1, '.01.E.0', opening_id % 10, 'A Corridor from Lobby ', hand, ' HMD') END,
    3, CASE kind WHEN 0 THEN '( 2) 3 EA Hinge before the list' WHEN 1 THEN '3'' 0" x 7'' 0" x 1 3/4" HMD' ELSE 'Notes on hinges follow' END,
    4, CASE kind WHEN 0 THEN 'Totals Each Assembly to have:' ELSE '' END,
    90000, CASE kind WHEN 0 THEN 'Project: Tower' WHEN 1 THEN 'Phase: 2' ELSE '12 pages' END,
    90001, CASE kind WHEN 0 THEN '( 9) 9 EA Hinge after the end' ELSE NULL END) AS (k, text) FROM {o}
  UNION ALL SELECT opening_id, kind, n * 10 + k, text FROM (SELECT opening_id, kind, n, stack(3,
    100, rtrim(CASE kind WHEN 0 THEN concat('( ', qty * 2, ') ', qty, ' EA ', base, ' ', catalog, ' ', finish, ' ', maker)
      WHEN 1 THEN concat(qty, ' EA ', base, ' ', catalog, ' ', finish, ' (HI-', n, ') ', maker)
      ELSE concat(qty, '  ', base, CAST(chr(9) AS STRING), maker, '   ', CASE WHEN catalog = '' THEN '-' ELSE catalog END, '  ', finish) END),
    101, more,
    102, 'HEI: by the editor') AS (k, text) FROM {p}) WHERE k < 102 OR kind = 0
)
"""
OPENINGS = "SELECT *, CAST(floor(opening_id / 2) AS BIGINT) % 3 AS kind FROM {openings}"


def parts(spark: SparkSession, sf: str) -> DataFrame:
    return spark.sql(PARTS, hardware=frame(spark, sf, "hardware", by="l_orderkey"))


def schedule(spark: SparkSession, sf: str) -> DataFrame:
    """(page, line, text) of all openings and their items."""
    return spark.sql(LINES, o=spark.sql(OPENINGS, openings=frame(spark, sf, "openings")), p=parts(spark, sf))


def _sql(text: str, **names: str) -> str:
    return text.format(**names).replace("AS STRING", "AS VARCHAR")


WRITTEN = f"o AS ({_sql(OPENINGS, openings='openings')}), p AS ({_sql(PARTS, hardware='hardware')})"
SPACED = "regexp_replace(trim({}), '\\s+', ' ', 'g')"
#: What is not hardware by name, and so is left out by the generic format.
PLAIN = "('Door', 'Frame', 'Widget', 'Auto Operator', 'Door Viewer')"


@query(rf"""WITH {WRITTEN} SELECT p.page, CASE WHEN kind = 0 THEN 1 ELSE CASE WHEN two THEN opening_id % 2 + 1 ELSE 1 END END::BIGINT AS section, hw_set AS set_id,
CASE WHEN kind = 0 THEN concat(opening_id % 40, 'A') ELSE hw_set END AS generic_id, qty::BIGINT AS qty, CASE WHEN kind = 0 THEN qty * 2 END::BIGINT AS qty_total,
CASE kind WHEN 0 THEN trim(concat(base, ' ', more)) WHEN 1 THEN trim(concat(base, CASE WHEN maker <> '' AND n % 4 = 1 THEN ' Wt' ELSE '' END)) ELSE base END AS name,
CASE kind WHEN 1 THEN CASE WHEN n % 4 = 0 THEN trim(concat(maker, ' International')) WHEN n % 4 = 1 AND maker = '' THEN 'Wt' ELSE maker END ELSE maker END AS manufacturer,
CASE WHEN kind = 2 AND catalog = '' THEN '-' ELSE catalog END AS model, finish
FROM p JOIN (SELECT opening_id, hw_set FROM openings) USING (opening_id) JOIN (SELECT page, count(DISTINCT opening_id) > 1 AS two FROM (SELECT opening_id, opening_id - opening_id % 2 + CASE WHEN kind = 0 THEN opening_id % 2 ELSE 0 END AS page FROM o) GROUP BY 1) USING (page)
WHERE kind < 2 OR base NOT IN {PLAIN}""")
def s14_items(spark, sf):
    """Items of all formats, read back from the lines."""
    got = grammar.items(grammar.sectioned(schedule(spark, sf)))
    return got.select("page", F.col("section").cast("long"), "set_id", "generic_id", "qty", "qty_total", "name", "manufacturer", "model", "finish")


@query(rf"""WITH {WRITTEN}, g AS (SELECT opening_id - opening_id % 2 + CASE WHEN kind = 0 THEN opening_id % 2 ELSE 0 END AS page, * FROM o), c AS (SELECT page, count(*) > 1 AS two FROM g GROUP BY 1)
SELECT page, CASE WHEN kind > 0 AND two THEN opening_id % 2 + 1 ELSE 1 END::BIGINT AS section, hw_set AS set_id, CASE WHEN kind = 0 THEN concat(opening_id % 40, 'A') ELSE hw_set END AS generic_id,
CASE WHEN kind = 2 THEN leaf_count ELSE 1 END::BIGINT AS doors, CASE WHEN kind = 2 THEN leaf_count * leaf_count ELSE leaf_count END::BIGINT AS leaves FROM g JOIN c USING (page)""")
def s13_sections(spark, sf):
    """Sections of pages with their ids, doors and leaves."""
    got = grammar.section_counts(grammar.sectioned(schedule(spark, sf)))
    return got.select("page", F.col("section").cast("long"), "set_id", "generic_id", "doors", "leaves")


@query(rf"""WITH {WRITTEN} SELECT opening_id - opening_id % 2 + CASE WHEN kind = 0 THEN opening_id % 2 ELSE 0 END AS page, concat(opening_id % 90 + 1, '.01.E.0', opening_id % 10, 'A') AS door_number, 1::BIGINT AS n, leaf_count::BIGINT AS leaves, CASE WHEN leaf_count > 1 THEN 'PR' ELSE 'SGL' END AS door_type, hand FROM o WHERE kind < 2""")
def x25_dealt_doors(spark, sf):
    """Doors, counts and hands of the lines that deal doors out."""
    return grammar.doors(grammar.sectioned(schedule(spark, sf))).drop("section", "line")


@query(rf"""WITH {WRITTEN}, i AS (SELECT *, CASE WHEN kind = 2 AND catalog = '' THEN '-' ELSE catalog END AS m, trim(concat(base, CASE WHEN kind = 0 THEN concat(' ', more) WHEN kind = 1 AND maker <> '' AND n % 4 = 1 THEN ' Wt' ELSE '' END)) AS said FROM p WHERE kind < 2 OR base NOT IN {PLAIN}),
k AS (SELECT page, opening_id, CASE WHEN m <> '' THEN 'm' || lower(m) ELSE 'n' || lower(said) END AS k FROM i) SELECT page, opening_id % 2 AS half, count(DISTINCT k) AS items FROM k GROUP BY 1, 2""")
def u05_items_once(spark, sf):
    """Items of each section without repeats, by model else name."""
    got = grammar.once(grammar.items(grammar.sectioned(schedule(spark, sf))))
    return got.withColumn("half", F.expr("line div 100000")).groupBy("page", "half").agg(F.count("*").alias("items"))


#: Lists of a project's openings as grids: six columns, whose order is the project's; some have no doors, some are contacts.
GRID = """
SELECT project_id AS table_id, project_id % 50 AS page, r AS row, CAST((k + project_id) % 6 AS INT) AS col, CASE
  WHEN r = 0 THEN CASE k WHEN 0 THEN 'Opening No.' WHEN 1 THEN 'HW Set' WHEN 2 THEN 'Swing' WHEN 3 THEN 'Fire Rating' WHEN 4 THEN 'Room Location' ELSE 'Type' END
  WHEN k = 0 THEN CASE WHEN project_id % 7 = 0 THEN 'n/a' ELSE concat(100 + r, CASE WHEN opening_id % 2 = 0 THEN 'A' ELSE '' END) END
  WHEN k = 1 THEN hw_set WHEN k = 2 THEN hand WHEN k = 3 THEN fire_rating
  WHEN k = 4 THEN CASE WHEN project_id % 5 = 0 THEN 'call 555-123-4567' WHEN location = '' THEN NULL ELSE concat(' Corridor  from ', location, ' —') END ELSE 'HMD' END AS cell
FROM (SELECT project_id, opening_id, hw_set, hand, fire_rating, location, CAST(row_number() OVER (PARTITION BY project_id ORDER BY opening_id) AS INT) AS r FROM {openings}
  UNION ALL SELECT DISTINCT project_id, 0, '', '', '', '', 0 FROM {openings}) AS o, {ks} AS ks
"""
GRID_SQL = f"g AS ({_sql(GRID, openings='openings', ks='(SELECT unnest(range(6)) AS k)')}), sizes AS (SELECT project_id, count(*) AS n FROM openings GROUP BY 1)"


def grid(spark: SparkSession, sf: str) -> DataFrame:
    """(page, table_id, row, col, cell) of all projects' lists."""
    return spark.sql(GRID, openings=frame(spark, sf, "openings"), ks=spark.range(6).selectExpr("CAST(id AS INT) AS k"))


@query(f"WITH {GRID_SQL} SELECT project_id AS table_id, 0 AS header, field, ((k + project_id) % 6)::INT AS col FROM sizes, (VALUES ('door_number', 0), ('hw_set', 1), ('hand', 2), ('fire_rating', 3), ('location', 4), ('door_type', 5)) f(field, k) WHERE n >= 8 AND project_id % 7 <> 0")
def s09_tables_by_content(spark, sf):
    """Lists of openings and their columns, found by what cells hold."""
    return grids.detected(grid(spark, sf))


@query(f"WITH {GRID_SQL}, f AS (SELECT table_id, col, list(trim(regexp_replace(cell, '—', ''))) AS c FROM g WHERE row BETWEEN 1 AND 30 AND coalesce(cell, '') <> '' GROUP BY 1, 2), s AS (SELECT table_id, col, c, (col - table_id % 6 + 6) % 6 AS k FROM f WHERE len(c) >= 3) SELECT table_id, col, len(c) AS n, CASE k WHEN 0 THEN (table_id % 7 <> 0)::INT * 10000 ELSE 0 END::BIGINT AS door_number, CASE k WHEN 1 THEN 10000 WHEN 0 THEN (table_id % 7 <> 0)::INT * 10000 ELSE 0 END::BIGINT AS hw_set, CASE k WHEN 2 THEN 10000 ELSE 0 END::BIGINT AS hand, CASE WHEN k = 3 OR k = 0 AND table_id % 7 = 0 THEN 10000 WHEN k = 0 THEN 10000 * len(list_filter(c, lambda x: x = '120')) // len(c) ELSE 0 END::BIGINT AS fire_rating, CASE k WHEN 4 THEN 10000 ELSE 0 END::BIGINT AS location FROM s")
def s08_value_scores(spark, sf):
    """Shares of a column's values that look like some fields' values, below the first row."""
    got = grids.value_scores(grid(spark, sf)).where("header = 0 and n >= 3")
    share = lambda f: F.get(F.filter("scores", lambda x: x["field"] == f), F.lit(0))["score"].cast("long").alias(f)
    return got.select("table_id", "col", "n", *map(share, ("door_number", "hw_set", "hand", "fire_rating", "location")))


@query(f"WITH {GRID_SQL}, h AS (SELECT table_id, bool_or(cell <> '') AS said FROM g WHERE row BETWEEN 1 AND 5 AND (col - table_id % 6 + 6) % 6 = 2 GROUP BY 1) SELECT table_id, field, ((CASE WHEN table_id % 6 <> 5 THEN k WHEN field = 'door_number' THEN 1 WHEN field = 'hw_set' THEN 5 ELSE k END + table_id) % 6)::INT AS col, CASE WHEN field = 'door_type' OR field = 'hand' AND NOT said THEN 50 WHEN field = 'hw_set' AND table_id % 6 = 5 THEN 70 ELSE 100 END::BIGINT AS confidence FROM h, (VALUES ('door_number', 0), ('hw_set', 1), ('hand', 2), ('fire_rating', 3), ('location', 4), ('door_type', 5)) f(field, k) WHERE table_id % 6 <> 5 OR field <> 'door_type'")
def s10_confidences(spark, sf):
    """Mapped columns by headers and samples together. Sets look like doors: where their column is the first, it is taken for that of the doors."""
    return grids.confidences(grid(spark, sf))


@query(f"WITH {GRID_SQL} SELECT project_id % 50 AS page, min(project_id) AS table_id, 13308::BIGINT AS quality FROM sizes WHERE n >= 3 AND project_id % 7 <> 0 AND project_id % 5 <> 0 GROUP BY 1")
def x05_schedule_tables(spark, sf):
    """The best list of doors of each page."""
    return grids.schedules(grid(spark, sf))


#: Words of pages with places: ten a line, in columns that don't quite line up.
PLACED = "SELECT page_id AS page, page_id * 1000000 + i AS word_id, CAST(i % 10 * 50 + (i * 7 + page_id) % 23 AS DOUBLE) AS x0, CAST(i % 10 * 50 + (i * 7 + page_id) % 23 + 5 * length(w) AS DOUBLE) AS x1, CAST(CAST(floor(i / 10) AS BIGINT) * 12 + i % 3 AS DOUBLE) AS top, CAST(CAST(floor(i / 10) AS BIGINT) * 12 + i % 3 + 9 AS DOUBLE) AS bottom, w AS text FROM {words}"
PLACED_SQL = f"""t AS (SELECT page_id, list_filter(regexp_split_to_array(regexp_replace(coalesce(html, ''), '<[^>]*>', ' ', 'g'), '\\s+'), lambda x: x <> '') AS ws FROM pages),
w AS (SELECT page_id, unnest(ws) AS w, (generate_subscripts(ws, 1) - 1)::BIGINT AS i FROM t), b AS ({PLACED.format(words='w')})"""
#: Three columns a page, and regions of all sizes: one a line, some squares, and a page whole.
COLUMNS = "SELECT page_id AS page, k AS col, CAST(k * 170 + page_id % 40 AS DOUBLE) AS start FROM {pages} AS p, {ks} AS ks"
REGIONS = """SELECT page_id * 10 + k AS region_id, page_id AS page, CAST(CASE WHEN k = 3 THEN -5 ELSE k * 90 + page_id % 50 END AS DOUBLE) AS x0, CAST(CASE WHEN k = 3 THEN 5000 ELSE k * 90 + 60 * (k + 1) + page_id % 50 END AS DOUBLE) AS x1,
CAST(CASE WHEN k = 3 THEN 0 ELSE k * 24 END AS DOUBLE) AS top, CAST(CASE WHEN k = 3 THEN 100 + page_id ELSE k * 24 + 30 * (k + 1) END AS DOUBLE) AS bottom FROM {pages} AS p, {ks} AS ks"""


def placed(spark: SparkSession, sf: str) -> DataFrame:
    """(page, word_id, x0, x1, top, bottom, text) of all words of all pages."""
    ws = F.filter(F.split(F.regexp_replace(F.coalesce("html", F.lit("")), "<[^>]*>", " "), r"\s+"), lambda x: x != "")
    return spark.sql(PLACED, words=table(spark, sf, "pages").select("page_id", F.posexplode(ws).alias("i", "w")))


def _laid(spark: SparkSession, sf: str, text: str, n: int) -> DataFrame:
    return spark.sql(text, pages=table(spark, sf, "pages").select("page_id"), ks=spark.range(n).selectExpr("CAST(id AS INT) AS k"))


KS = "(SELECT unnest(range({}))::INT AS k)"


@query(f"WITH {PLACED_SQL}, c AS ({COLUMNS.format(pages='pages', ks=KS.format(3))}) SELECT b.page, word_id, col FROM b ASOF LEFT JOIN c ON b.page = c.page AND b.x0 + 10 >= c.start")
def s12_words_to_columns(spark, sf):
    """Each word's column: the last that starts before it."""
    return pages.nearest_column(placed(spark, sf), _laid(spark, sf, COLUMNS, 3))


@query(f"WITH {PLACED_SQL}, c AS ({COLUMNS.format(pages='pages', ks=KS.format(3))}) SELECT b.page AS table_id, floor(top / 12)::INT AS row, col, string_agg(text, ' ' ORDER BY x0, word_id) AS cell FROM b ASOF JOIN c ON b.page = c.page AND b.x0 + 10 >= c.start GROUP BY 1, 2, 3")
def s12_cells(spark, sf):
    """Cells of pages by lines and columns of words."""
    return boxes.cells(placed(spark, sf), _laid(spark, sf, COLUMNS, 3))


@query(f"WITH {PLACED_SQL}, r AS ({REGIONS.format(pages='pages', ks=KS.format(4))}) SELECT region_id, count(*) AS n, sum(word_id)::BIGINT AS words FROM r JOIN b ON r.page = b.page AND b.x0 >= r.x0 AND b.x1 <= r.x1 AND b.top >= r.top AND b.bottom <= r.bottom GROUP BY 1")
def s17_regions(spark, sf):
    """Words within regions of very different sizes, without a product."""
    return boxes.within(_laid(spark, sf, REGIONS, 4), placed(spark, sf)).groupBy("region_id").agg(F.count("*").alias("n"), F.sum("word_id").alias("words"))


@query(f"WITH {PLACED_SQL}, r AS ({REGIONS.format(pages='pages', ks=KS.format(4))}), l AS (SELECT region_id, floor(b.top / 12) AS line, string_agg(text, ' ' ORDER BY b.x0, word_id) AS text, count(*) AS n FROM r JOIN b ON r.page = b.page AND b.x0 >= r.x0 AND b.x1 <= r.x1 AND b.top >= r.top AND b.bottom <= r.bottom GROUP BY 1, 2) SELECT region_id, sum(n)::BIGINT AS n, string_agg(text, chr(10) ORDER BY line) AS text FROM l GROUP BY 1")
def s17_region_texts(spark, sf):
    """The text of each region in reading order."""
    return boxes.region_texts(_laid(spark, sf, REGIONS, 4), placed(spark, sf))


@query(f"WITH {GRID_SQL}, o AS (SELECT opening_id, project_id, hw_set, row_number() OVER (PARTITION BY project_id ORDER BY opening_id) AS r, count(*) OVER (PARTITION BY project_id) AS n FROM openings), d AS (SELECT project_id AS table_id, concat(100 + r, CASE WHEN opening_id % 2 = 0 THEN 'A' ELSE '' END) AS door_number, hw_set, n >= 8 AND project_id % 7 <> 0 AS whole, r % 3 = 0 AS also FROM o) SELECT table_id, door_number, CASE WHEN whole THEN hw_set ELSE 'late' END AS hw_set, CASE WHEN whole THEN 0 ELSE 1 END AS strategy FROM d WHERE whole OR also UNION ALL SELECT table_id, 'ST-100', 'late', 1 FROM d WHERE also GROUP BY 1")
def s11_openings(spark, sf):
    """Openings of lists found by content, and of a second list for what the first lacks."""
    g = grid(spark, sf)
    first = boxes.openings(g, grids.detected(g)).select("table_id", "row", "door_number", "hw_set")
    o = frame(spark, sf, "openings").withColumn("r", F.row_number().over(Window.partitionBy("project_id").orderBy("opening_id"))).where("r % 3 = 0")
    second = o.selectExpr("project_id AS table_id", "r AS row", "concat(100 + r, IF(opening_id % 2 = 0, 'A', '')) AS door_number", "'late' AS hw_set")
    third = o.selectExpr("project_id AS table_id", "r AS row", "'ST-100' AS door_number", "'late' AS hw_set")
    return boxes.openings_by_priority([first, second.unionByName(third)], ["table_id"]).select("table_id", "door_number", "hw_set", "strategy")


#: Sets of projects and their openings: by its number, a set's heading says its doors, or openings name it as their heading, by its generic id, or with a hyphen.
NUMBERED = "SELECT project_id, opening_id, leaf_count, opening_id % 40 AS n, concat('H', lpad(CAST(opening_id % 40 AS STRING), 3, '0')) AS set_id FROM {openings}"
SETS = "SELECT project_id, set_id, n, CASE WHEN n % 5 = 2 THEN concat('G', n) ELSE set_id END AS generic_id, CASE WHEN n % 5 = 0 THEN count(*) ELSE 0 END AS heading_doors, CASE WHEN n % 5 = 0 THEN CAST(sum(leaf_count) AS BIGINT) ELSE 0 END AS heading_leaves, CASE WHEN n % 7 = 0 THEN 'per_opening' ELSE 'unknown' END AS convention FROM {o} GROUP BY project_id, set_id, n"
NAMED = "SELECT project_id, leaf_count, CASE WHEN n % 5 = 1 THEN set_id ELSE '' END AS hw_heading, CASE n % 5 WHEN 2 THEN concat('g', n) WHEN 3 THEN concat('h-', substr(set_id, 2), 'x') ELSE NULL END AS hw_set FROM {o}"
TOTALS = "SELECT project_id, set_id, name, CAST(sum(qty) AS BIGINT) AS qty, min(pos) AS pos FROM (SELECT project_id, set_id, pos, qty, CASE WHEN name = 'Lockset RHR' AND leaf_side <> 'shared' THEN CASE leaf_side WHEN 'active' THEN 'Lockset RHR' ELSE 'Lockset LHR' END ELSE name END AS name FROM {h} JOIN {o} USING (opening_id)) GROUP BY project_id, set_id, name"
#: Category, the most of it on an opening, and what a set's total is divided by.
KINDS = "k(name, category, most, pref) AS (VALUES ('Hinge', 'hinge', 5, 'leaf'), ('Hinges', 'hinge', 5, 'leaf'), ('Continuous Hinge', 'continuous_hinge', 2, 'leaf'), ('Lockset RHR', 'lockset', 1, 'opening'), ('Lockset LHR', 'lockset', 1, 'opening'), ('Exit Device 99EO US26D', 'exit_device', 2, 'leaf'), ('Flush Bolt', 'flush_bolt', 2, 'opening_only'), ('Closer LH', 'closer', 2, 'opening'), ('Kick Plate', 'kick_plate', 2, 'leaf'), ('Wall Stop', 'stop', 2, 'leaf'), ('Threshold', 'threshold', 1, 'opening_only'), ('Gasketing', 'seal', 3, 'opening_only'), ('Silencer', 'silencer', 4, 'opening'), ('Coordinator', 'coordinator', 1, 'opening_only'), ('Auto Operator', 'auto_operator', 1, 'opening'), ('Cylinder Housing', 'cylinder', 2, 'opening'), ('Permanent Core', 'cylinder', 2, 'opening'), ('Astragal', 'astragal', 1, 'opening_only'), ('Strike', 'strike', 2, 'opening'))"
ANNOTATED = f"""no AS ({_sql(NUMBERED, openings='openings')}), st AS ({_sql(SETS, o='no')}), tt AS ({_sql(TOTALS, h='hardware', o='no')}), {KINDS},
d AS (SELECT project_id, set_id, n, convention, CASE WHEN n % 5 < 4 THEN count(*) ELSE 0 END AS doors, CASE WHEN n % 5 < 4 THEN sum(leaf_count) ELSE 0 END::BIGINT AS leaves, ['heading', 'opening', 'generic', 'crossed', 'none'][n % 5 + 1] AS origin FROM st JOIN no USING (project_id, set_id, n) GROUP BY project_id, set_id, n, convention),
a AS (SELECT d.project_id, d.set_id, tt.name, pos, qty, origin, category, coalesce(most, 4) AS most, doors, leaves, convention = 'per_opening' AND doors > 1 AS every, doors <= 1 AND leaves <= 1 AS single, CASE WHEN pref = 'leaf' AND leaves > 1 THEN leaves WHEN doors > 1 THEN doors END AS dv FROM tt JOIN d USING (project_id, set_id) LEFT JOIN k USING (name)),
s AS (SELECT *, CASE WHEN single AND NOT every AND qty > most THEN 'needs_cap' WHEN NOT every AND NOT single AND dv > 1 AND qty >= dv THEN 'needs_division' ELSE 'parsed' END AS src, count(DISTINCT name) FILTER (name LIKE 'Lockset %') OVER (PARTITION BY project_id, set_id) AS hands, bool_or(name = 'Auto Operator') OVER (PARTITION BY project_id, set_id) AS auto FROM a),
r AS (SELECT *, CASE WHEN src = 'needs_division' AND hands > 1 AND name LIKE 'Lockset %' THEN 'rhr_lhr_pair' WHEN src = 'needs_division' AND auto AND category = 'closer' THEN 'needs_review' ELSE src END AS qty_source, CASE WHEN NOT single OR every OR qty > most THEN qty END AS qty_total, CASE WHEN every THEN doors WHEN single THEN NULL WHEN src = 'needs_division' THEN dv WHEN qty < coalesce(dv, 2) THEN coalesce(dv, nullif(doors, 0)) END AS divisor FROM s)"""


def _totals(hardware: DataFrame, o: DataFrame) -> DataFrame:
    """The rows of TOTALS, moved once to where their set's are, as all that follows is by set."""
    side = F.when(F.col("leaf_side") == "active", "Lockset RHR").otherwise("Lockset LHR")
    name = F.when((F.col("name") == "Lockset RHR") & (F.col("leaf_side") != "shared"), side).otherwise(F.col("name"))
    rows = hardware.select("opening_id", "pos", "qty", name.alias("name")).join(o.select("opening_id", "project_id", "set_id"), "opening_id").drop("opening_id")
    return rows.repartition("project_id", "set_id").groupBy("project_id", "set_id", "name").agg(F.sum("qty").cast("long").alias("qty"), F.min("pos").alias("pos"))


def _annotated(spark: SparkSession, sf: str) -> DataFrame:
    o = spark.sql(NUMBERED, openings=frame(spark, sf, "openings"))
    items = _totals(frame(spark, sf, "hardware"), o).withColumn("model", F.lit(""))
    return annotation.annotated(items, spark.sql(SETS, o=o), spark.sql(NAMED, o=o), "project_id")


@query(f"WITH {ANNOTATED} SELECT project_id, set_id, name, pos, qty, origin, qty_source, qty_total, divisor FROM r")
def m04_annotated(spark, sf):
    """What the quantities of all sets' items are to be divided by, and why."""
    return _annotated(spark, sf).select("project_id", "set_id", "name", "pos", "qty", "origin", "qty_source", "qty_total", "divisor")


@query(f"""WITH {ANNOTATED}, v AS (SELECT *, qty_source = 'needs_division' AS divides, qty % greatest(coalesce(divisor, 1), 1) = 0 AS even, category = 'hinge' AS hinge FROM r)
SELECT project_id, set_id, name, (CASE WHEN qty_source = 'rhr_lhr_pair' THEN 1 WHEN divides AND even THEN qty // divisor WHEN divides AND coalesce(hinge, false) THEN ceil(qty / divisor) WHEN divides THEN floor(qty / divisor + 0.5) WHEN qty_source = 'needs_cap' THEN most ELSE qty END)::BIGINT AS qty,
CASE WHEN qty_source = 'rhr_lhr_pair' OR divides AND (even OR coalesce(hinge, false)) THEN 'divided' WHEN divides OR qty_source = 'needs_review' THEN 'flagged' WHEN qty_source = 'needs_cap' THEN 'capped' ELSE qty_source END AS qty_source FROM v""")
def m05_set_quantities(spark, sf):
    """Quantities of openings out of the sets' totals."""
    rows = _annotated(spark, sf).withColumns({"is_hinge": F.coalesce(F.col("category") == "hinge", F.lit(False)), "most": C.most_of(F.col("category"))})
    return quantity.normalise(rows).select("project_id", "set_id", "name", "qty", "qty_source")


@query("SELECT opening_id, CASE opening_id % 6 WHEN 0 THEN '90 MIN' WHEN 1 THEN '1.5HR' WHEN 3 THEN '3 HOURS' WHEN 5 THEN fire_rating ELSE '' END AS rating, CASE opening_id % 6 WHEN 0 THEN concat('Pair  ', hw_set) WHEN 5 THEN concat('20Min ', hw_set) ELSE hw_set END AS heading, CASE opening_id % 6 WHEN 1 THEN trim(concat(location, '  rated')) WHEN 2 THEN '3/4 HOUR' WHEN 3 THEN 'Stair,  door' WHEN 4 THEN '4 hr 1000 min' ELSE location END AS location FROM (SELECT *, CASE WHEN opening_id % 6 = 5 AND fire_rating = '' THEN 'x' ELSE fire_rating END AS fr FROM openings) WHERE opening_id % 6 <> 5 OR fire_rating <> ''")
def f17_stamped_ratings(spark, sf):
    """Ratings out of headings, else out of locations, of openings that have none; what is taken is gone from there."""
    o = frame(spark, sf, "openings").where("opening_id % 6 <> 5 OR fire_rating <> ''")
    o = o.selectExpr("opening_id", "IF(opening_id % 6 = 5, fire_rating, '') AS rating", "CASE opening_id % 6 WHEN 0 THEN concat('Pair 90 min ', hw_set) WHEN 5 THEN concat('20Min ', hw_set) ELSE hw_set END AS heading", "CASE opening_id % 6 WHEN 1 THEN concat(location, ' 1.5hr rated') WHEN 2 THEN '3/4 HOUR' WHEN 3 THEN 'Stair, 3 hours door' WHEN 4 THEN '4 hr 1000 min' ELSE location END AS location")
    return edits.stamped_ratings(o, "rating", "heading", "location")


SIZES = ["3'0\" x 7'0\"", "opening 6'-4\" X 8'", "3070", "30100", "9999", "36 x 84", "36\" × 84\"", "914 x 2134", "36 x 50", "10 x 84", "1270", ""]


@query("SELECT opening_id, [36.0, 76, 36, NULL, 117, 36, 36, 36, NULL, NULL, NULL, NULL][(opening_id % 12)::INT + 1] AS width, [84.0, 96, 84, NULL, 117, 84, 84, 84, NULL, NULL, NULL, NULL][(opening_id % 12)::INT + 1] AS height FROM openings")
def f15_opening_sizes(spark, sf):
    """Sizes in all forms, and what only looks like them."""
    size = T.opening_size(F.element_at(F.array(*map(F.lit, SIZES)), (F.col("opening_id") % 12 + 1).cast("int")))
    return frame(spark, sf, "openings").select("opening_id", size["width"].alias("width"), size["height"].alias("height"))


#: Makers whose abbreviations end a name.
ABBREVIATED = ["IV", "LC", "ZE"]
BROKEN = "SELECT opening_id, pos, n, base, concat(substr(base, 1, length(base) - 2), CASE WHEN base = name THEN ' ' ELSE '' END, substr(base, length(base) - 1)) AS broken FROM (SELECT *, trim(regexp_replace(regexp_replace(name, '[0-9].*$', ''), '[(].*$', '')) AS base, pos % 6 AS n FROM {h})"
CUT = """SELECT opening_id, pos, CASE n WHEN 0 THEN concat(broken, ' 8400 X 626 IV') WHEN 1 THEN broken WHEN 2 THEN concat(base, ' by others 12 IV') WHEN 3 THEN substr(base, 1, length(base) - 3) WHEN 4 THEN base ELSE concat(base, ' US26D') END AS name,
CASE n WHEN 3 THEN substr(base, length(base) - 2) WHEN 4 THEN 'LC' ELSE '' END AS manufacturer, CASE n WHEN 3 THEN 'L9010' WHEN 4 THEN '4040XP' ELSE '' END AS model, CASE n WHEN 3 THEN '630' WHEN 4 THEN 'AL' ELSE '' END AS finish FROM {b}"""


@query(f"""WITH b AS ({BROKEN.format(h='hardware')}), m AS (SELECT *, CASE WHEN right(base, 2) IN ('me', 'or') AND broken <> base THEN broken ELSE base END AS healed FROM b)
SELECT opening_id, pos, CASE n WHEN 2 THEN concat(base, ' by others 12 IV') WHEN 4 THEN base WHEN 5 THEN base WHEN 3 THEN CASE WHEN regexp_matches(base, '[a-z]..$| LH$') THEN base ELSE trim(left(base, -3)) END ELSE healed END AS name, CASE n WHEN 0 THEN 'IV' WHEN 4 THEN 'LC' ELSE CASE WHEN n = 3 AND NOT regexp_matches(base, '[a-z]..$| LH$') THEN right(base, 3) ELSE '' END END AS manufacturer,
CASE n WHEN 0 THEN '8400 X' WHEN 3 THEN 'L9010' WHEN 4 THEN '4040XP' ELSE '' END AS model, CASE n WHEN 0 THEN '626' WHEN 3 THEN '630' WHEN 4 THEN 'AL' WHEN 5 THEN 'US26D' ELSE '' END AS finish FROM m""")
def m13_mended_fields(spark, sf):
    """Broken words, cut fields and joined fields put right."""
    b = spark.sql(BROKEN, h=frame(spark, sf, "hardware"))
    return healing.mended(spark.sql(CUT, b=b), ABBREVIATED)
