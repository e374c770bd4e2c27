"""Queries over corrections, revisions, nested writes, pages and their texts, with the DuckDB SQL that checks them."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from jambwork.functions import text as T
from jambwork.operators import edits, lines, matching, pages, sets, views
from jambwork.plans.catalog import query
from jambwork.sources.tables import PLACE, frame, table


@query("WITH a AS (SELECT opening_id AS k, hand, status FROM openings WHERE opening_id % 10 < 8), b AS (SELECT opening_id AS k, upper(location) AS hand, opening_id % 2 = 0 AS keep FROM openings WHERE opening_id % 10 > 2) SELECT b.k AS opening_id, b.hand, CASE WHEN a.k IS NOT NULL AND keep THEN status END AS status, CASE WHEN a.k IS NULL THEN 'inserted' ELSE 'updated' END AS state FROM b LEFT JOIN a USING (k)")
def m03_applied_revision(spark, sf):
    o = frame(spark, sf, "openings")
    new = o.where("opening_id % 10 > 2").select("opening_id", F.upper("location").alias("hand"))
    return edits.apply_revision(o.where("opening_id % 10 < 8").select("opening_id", "hand", "status"), new, "opening_id", ["hand"], ["status"], F.col("opening_id") % 2 == 0)


@query("WITH i AS (SELECT opening_id AS set_id, pos, name, qty FROM hardware), d AS (SELECT * FROM i WHERE name <> 'Widget'), f AS (SELECT set_id, pos, CASE WHEN name = 'Threshold' AND set_id % 2 = 0 THEN 'Saddle' ELSE name END AS name, CASE WHEN name = 'Threshold' AND set_id % 2 = 0 THEN 9 ELSE qty END::INT AS qty, CASE WHEN name = 'Threshold' AND set_id % 2 = 0 THEN 'fixed' ELSE 'kept' END AS state FROM d), n AS (SELECT DISTINCT opening_id AS set_id FROM openings WHERE opening_id % 5 = 0 AND opening_id NOT IN (SELECT set_id FROM i WHERE name = 'Astragal')) SELECT * FROM f UNION ALL SELECT set_id, 1::BIGINT, 'Astragal', 1, 'added' FROM n")
def m09_corrected_items(spark, sf):
    i = frame(spark, sf, "hardware").selectExpr("opening_id AS set_id", "pos", "name", "qty")
    o = frame(spark, sf, "openings").select(F.col("opening_id").alias("set_id"))
    fixed = o.where("set_id % 2 = 0").selectExpr("set_id", "'threshold ' AS name", "'Saddle' AS new_name", "9 AS new_qty", "1 AS pos")
    return edits.corrected(i, o.selectExpr("set_id", "'WIDGET' AS name"), fixed, o.where("set_id % 5 = 0").selectExpr("set_id", "CAST(1 AS BIGINT) AS pos", "'Astragal' AS name", "1 AS qty"))


@query("WITH e AS (SELECT opening_id AS k, arg_min('v' || item_id, sort_order * 1000000 + item_id) AS v FROM items WHERE damaged GROUP BY 1) SELECT door_key, coalesce(v, hand) AS hand, location, CASE WHEN v IS NULL THEN '' ELSE 'hand' END AS edited FROM (SELECT opening_id AS door_key, hand, location FROM openings) LEFT JOIN e ON k = door_key")
def m11_bulk_edits(spark, sf):
    e = frame(spark, sf, "items").where("damaged").selectExpr("opening_id AS door_key", "'hand' AS field", "concat('v', item_id) AS value", "sort_order * 1000000 + item_id AS pos")
    return edits.set_fields(frame(spark, sf, "openings").selectExpr("opening_id AS door_key", "hand", "location"), e, ["hand", "location"])


@query("SELECT item_id, CASE WHEN size % 7 = 0 THEN 'canonical ' || lower(manufacturer) ELSE model END AS model FROM products")
def m12_canonical_models(spark, sf):
    p = frame(spark, sf, "products")
    v = p.where("size % 7 = 0").selectExpr("upper(manufacturer) AS manufacturer", "concat(upper(model), ' ,') AS variant", "concat('canonical ', lower(manufacturer)) AS canonical").withColumn("variant", F.regexp_replace("variant", " ,$", "."))
    return edits.canonical_models(p.select("item_id", "manufacturer", "model"), v).select("item_id", "model")


@query("SELECT opening_id, pos, CASE WHEN name = 'Hinge' AND opening_id IN (SELECT opening_id FROM openings WHERE status = 'F') THEN 99 ELSE qty END::INT AS qty FROM hardware")
def x11_bulk_update(spark, sf):
    o = frame(spark, sf, "openings").where("status = 'F'")
    return edits.set_by_name(frame(spark, sf, "hardware"), o, "opening_id", "Hinge", {"qty": F.lit(99)}).select("opening_id", "pos", "qty")


BODY = "array<struct<door_number:string,leaf_count:int,items:array<struct<name:string,qty:int,sort_order:int>>>>"


@query("SELECT project_id AS run, door_number, name, coalesce(qty, 1)::INT AS qty, sort_order FROM (SELECT o.project_id, o.door_number, h.name, nullif(h.qty, 0) AS qty, (h.pos % 5)::INT AS sort_order FROM openings o JOIN hardware h USING (opening_id)) WHERE project_id % 3 > 0")
def k01_nested_write(spark, sf):
    h = frame(spark, sf, "hardware").groupBy("opening_id").agg(F.collect_list(F.struct("name", F.nullif("qty", F.lit(0)).alias("qty"), (F.col("pos") % 5).cast("int").alias("sort_order"))).alias("items"))
    o = frame(spark, sf, "openings").join(h, "opening_id").groupBy(F.col("project_id").alias("run")).agg(F.to_json(F.collect_list(F.struct("door_number", F.col("leaf_count").cast("int").alias("leaf_count"), "items"))).alias("body"))
    return edits.unnested(o, BODY, frame(spark, sf, "projects").where("project_id % 3 > 0").select(F.col("project_id").alias("run")))[1]


@query("WITH f AS (SELECT hw_set, count(*) AS doors, min(struct_pack(d := door_number, o := opening_id)) AS x FROM openings GROUP BY 1), l AS (SELECT opening_id, string_agg(name, '|' ORDER BY pos, name) AS items FROM hardware GROUP BY 1) SELECT hw_set, doors, x.d AS door_number, coalesce(items, '') AS items FROM f LEFT JOIN l ON opening_id = x.o")
def m16_renested(spark, sf):
    return edits.renested(frame(spark, sf, "openings"), frame(spark, sf, "hardware"))


NOTES = "SELECT event_id AS note_id, CASE event_id % 4 WHEN 0 THEN 'project' WHEN 1 THEN 'opening' WHEN 2 THEN 'leaf' ELSE 'item' END AS scope, event_id % 900 AS opening_id, event_id % 40 AS item_id, CASE event_id % 3 WHEN 0 THEN 'active' ELSE NULL END AS leaf_side FROM activity"


@query(f"WITH n AS ({NOTES}) SELECT note_id, CASE WHEN scope = 'project' THEN 'project' WHEN opening_id NOT IN (SELECT opening_id FROM openings) THEN 'none' WHEN scope = 'item' AND (opening_id, item_id) IN (SELECT (opening_id, item_id) FROM items) THEN 'item' WHEN scope = 'leaf' AND leaf_side = 'active' THEN 'leaf' ELSE 'opening' END AS bucket FROM n")
def m15_note_buckets(spark, sf):
    n = frame(spark, sf, "activity").selectExpr("event_id AS note_id", "CASE event_id % 4 WHEN 0 THEN 'project' WHEN 1 THEN 'opening' WHEN 2 THEN 'leaf' ELSE 'item' END AS scope", "event_id % 900 AS opening_id", "event_id % 40 AS item_id", "IF(event_id % 3 = 0, 'active', NULL) AS leaf_side")
    return edits.note_buckets(n, frame(spark, sf, "openings"), frame(spark, sf, "items")).select("note_id", "bucket")


@query("WITH s AS (SELECT hw_set AS set_id, opening_id AS pos, opening_id % 2 AS items, opening_id % 3 AS door_count, CASE WHEN opening_id % 3 = 0 THEN ['D' || (opening_id % 5), 'E'] ELSE [] END AS doors, CASE opening_id % 4 WHEN 0 THEN 'per_opening' WHEN 1 THEN 'aggregate' ELSE 'unknown' END AS convention FROM openings), d AS (SELECT set_id, list_sort(list(DISTINCT d)) AS doors FROM (SELECT set_id, unnest(doors) AS d FROM s) GROUP BY 1), g AS (SELECT set_id, sum(items)::BIGINT AS items, sum(door_count)::BIGINT AS said, coalesce(arg_min(convention, pos) FILTER (convention <> 'unknown'), 'unknown') AS convention FROM s GROUP BY 1) SELECT set_id, items, greatest(said, coalesce(len(doors), 0)) AS door_count, coalesce(array_to_string(doors, ','), '') AS doors, convention FROM g LEFT JOIN d USING (set_id) WHERE items > 0 OR len(doors) > 0")
def u06_merged_pages(spark, sf):
    s = frame(spark, sf, "openings").selectExpr("hw_set AS set_id", "opening_id AS pos", "opening_id % 2 AS items", "opening_id % 3 AS door_count", "IF(opening_id % 3 = 0, array(concat('D', opening_id % 5), 'E'), CAST(array() AS ARRAY<STRING>)) AS doors", "CASE opening_id % 4 WHEN 0 THEN 'per_opening' WHEN 1 THEN 'aggregate' ELSE 'unknown' END AS convention")
    return edits.merged_pages(s)


#: Two sources' sets of each project: ids equal, nearly equal or unlike, headings of few words, so that many want the same.
SETS_A = "SELECT project_id, hw_set AS set_id, min(opening_id) AS pos, min(concat(lower(location), ' ', status, ' doors')) AS heading FROM {o} GROUP BY project_id, hw_set"
SETS_B = "SELECT project_id, CASE n % 3 WHEN 0 THEN hw_set WHEN 1 THEN concat('dh-', substr(hw_set, 3)) ELSE concat('Set ', n, ' of ', hw_set) END AS set_id, n AS pos, heading FROM (SELECT project_id, hw_set, max(opening_id) AS n, max(concat(status, ' DOORS ', location)) AS heading FROM {o} GROUP BY project_id, hw_set)"


@query(rf"""WITH RECURSIVE x AS ({SETS_A.format(o='openings')}), y AS ({SETS_B.format(o='openings')}),
one AS (SELECT x.project_id, x.set_id AS a, y.set_id AS b FROM x JOIN y USING (project_id, set_id)),
two AS (SELECT x.project_id, x.set_id AS a, y.set_id AS b FROM x JOIN y ON x.project_id = y.project_id AND lower(x.set_id) = replace(lower(y.set_id), '-', '') WHERE (x.project_id, x.set_id) NOT IN (SELECT project_id, a FROM one) AND (y.project_id, y.set_id) NOT IN (SELECT project_id, b FROM one)),
got AS (SELECT *, 1 AS tier FROM one UNION ALL SELECT *, 2 FROM two),
fx AS (SELECT *, list_distinct(list_filter(string_split(lower(heading), ' '), lambda z: z <> '')) AS w FROM x WHERE (project_id, set_id) NOT IN (SELECT project_id, a FROM got)),
fy AS (SELECT *, list_distinct(list_filter(string_split(lower(heading), ' '), lambda z: z <> '')) AS w FROM y WHERE (project_id, set_id) NOT IN (SELECT project_id, b FROM got)),
p AS (SELECT fx.project_id, fx.set_id AS a, fx.pos AS a_pos, fy.set_id AS b, fy.pos AS b_pos, len(list_intersect(fx.w, fy.w)) / (len(fx.w) + len(fy.w) - len(list_intersect(fx.w, fy.w))) AS score FROM fx JOIN fy USING (project_id)),
c AS (SELECT project_id, b, list(a ORDER BY score DESC, a_pos, a) AS cands, row_number() OVER (PARTITION BY project_id ORDER BY b_pos, b) AS k FROM p WHERE score >= 0.5 GROUP BY project_id, b, b_pos),
s AS (SELECT DISTINCT project_id, 0::BIGINT AS k, []::VARCHAR[] AS taken, NULL::VARCHAR AS a, NULL::VARCHAR AS b FROM c UNION ALL SELECT s.project_id, c.k, CASE WHEN len(list_filter(cands, lambda z: NOT list_contains(taken, z))) > 0 THEN list_append(taken, list_filter(cands, lambda z: NOT list_contains(taken, z))[1]) ELSE taken END, list_filter(cands, lambda z: NOT list_contains(taken, z))[1], c.b FROM s JOIN c ON c.project_id = s.project_id AND c.k = s.k + 1)
SELECT project_id, a, b, tier::INT AS tier FROM got UNION ALL SELECT project_id, a, b, 3 FROM s WHERE a IS NOT NULL""")
def j17_matched_sets(spark, sf):
    """Sets of two sources, in turn where several want the same."""
    o = frame(spark, sf, "openings")
    return matching.matched_sets(spark.sql(SETS_A, o=o), spark.sql(SETS_B, o=o), ["project_id"])


#: Items of two sources: of the second's some are in capitals, some are others, some come twice.
ITEMS_A = "SELECT opening_id, pos, name, qty, model AS manufacturer, model, leaf_side AS finish FROM (SELECT *, row_number() OVER (PARTITION BY opening_id, pos ORDER BY name, qty) AS k FROM {h}) WHERE k = 1"
ITEMS_B = "SELECT opening_id, pos * 2 + 1 AS pos, CASE pos % 4 WHEN 0 THEN upper(name) WHEN 1 THEN concat('zzz', pos) ELSE name END AS name, CASE WHEN pos % 5 = 0 THEN qty + 1 ELSE qty END AS qty, CASE WHEN pos % 7 = 0 THEN '' ELSE upper(manufacturer) END AS manufacturer, CASE WHEN pos % 3 = 0 THEN 'M2' ELSE model END AS model, finish FROM {a} UNION ALL SELECT opening_id, pos * 2 + 2, lower(name), qty, '', '', '' FROM {a} WHERE pos % 6 = 0"


def _field_sql(f: str, second: bool) -> str:
    x, y = f"coalesce(a.{f}::VARCHAR, '')", f"coalesce(b.{f}::VARCHAR, '')"
    value = f"CASE WHEN a.pos IS NULL OR {x} = '' THEN {y} WHEN b.pos IS NULL OR {y} = '' OR lower({x}) = lower({y}) THEN {x} ELSE {y if second else x} END"
    return f"{value} AS {f}, CASE WHEN a.pos IS NULL OR b.pos IS NULL THEN 1 WHEN {x} = '' AND {y} = '' THEN 0 WHEN {x} = '' OR {y} = '' THEN 1 WHEN lower({x}) = lower({y}) THEN 2 ELSE 0 END AS c_{f}"


@query(rf"""WITH ia AS ({ITEMS_A.format(h='hardware')}), ib AS ({ITEMS_B.format(a='ia')}), fa AS (SELECT opening_id, name, min(pos) AS pos FROM ia GROUP BY 1, 2), w AS (SELECT DISTINCT ib.opening_id, ib.name AS asked, coalesce(max(fa.name) FILTER (fa.name = ib.name) OVER v, min(fa.name) OVER v) AS name FROM ib JOIN fa ON fa.opening_id = ib.opening_id AND lower(fa.name) = lower(ib.name) WINDOW v AS (PARTITION BY ib.opening_id, ib.name)),
m AS (SELECT ib.opening_id, w.name, min(ib.pos) AS b_pos FROM ib JOIN w ON w.opening_id = ib.opening_id AND w.asked = ib.name GROUP BY 1, 2), j AS (SELECT m.opening_id, fa.pos AS a_pos, b_pos FROM m JOIN fa USING (opening_id, name)),
l AS (SELECT ia.opening_id, ia.pos AS a_pos, j.b_pos FROM ia LEFT JOIN j ON j.opening_id = ia.opening_id AND j.a_pos = ia.pos UNION ALL SELECT opening_id, NULL, pos FROM ib WHERE (opening_id, pos) NOT IN (SELECT opening_id, b_pos FROM j)),
f AS (SELECT l.opening_id, l.a_pos, l.b_pos, {', '.join(_field_sql(f, second) for f, second in matching.FIELDS.items())} FROM l LEFT JOIN ia a ON a.opening_id = l.opening_id AND a.pos = l.a_pos LEFT JOIN ib b ON b.opening_id = l.opening_id AND b.pos = l.b_pos)
SELECT opening_id, a_pos, b_pos, name, qty, manufacturer, model, finish, ['conflict', 'single_source', 'full'][least(c_name, c_qty, c_manufacturer, c_model, c_finish) + 1] AS overall FROM f""")
def m08_reconciled_items(spark, sf):
    """Items of two sources, paired by their names and reconciled field by field."""
    h = frame(spark, sf, "hardware", by="l_orderkey").select("opening_id", "pos", "name", "qty", "model", "leaf_side")
    a = sets.first_per_group(h, ["opening_id", "pos"], F.col("name"), F.col("qty")).selectExpr("opening_id", "pos", "name", "qty", "model AS manufacturer", "model", "leaf_side AS finish")
    got = matching.reconciled_items(a, spark.sql(ITEMS_B, a=a), "opening_id")
    return got.select("opening_id", "a_pos", "b_pos", *(F.col(f)["value"].alias(f) for f in matching.FIELDS), "overall")


@query("WITH s AS (SELECT hw_set AS set_id, arg_max(location, length(location) * 1000000000 - opening_id) AS heading, min(opening_id) AS pos, count(*) AS chunks FROM openings GROUP BY 1) SELECT * FROM s")
def u04_merged_chunks(spark, sf):
    s = frame(spark, sf, "openings").selectExpr("hw_set AS set_id", "location AS heading", "opening_id AS pos")
    i = frame(spark, sf, "hardware").selectExpr("opening_id AS set_id", "pos", "name", "model", "'' AS manufacturer", "'' AS finish")
    return sets.merge_chunks(s, i)[0]


SAMPLES = [
    ("Table of  Contents", "cover", 90, "", "unknown", "unknown"), ("FINISH LEGEND: 626", "reference", 85, "", "unknown", "unknown"), ("Door Schedule 101 102A", "door_schedule", 90, "", "unknown", "bare_numeric"),
    ("Heading #3 (Set #I2S-1E) 3 Hinge", "hardware_set", 95, "I2S-1E", "himmel", "unknown"), ("Hardware Set: DH4 and Set: 07A qty 3", "hardware_set", 95, "DH4,07A", "hw_prefix", "unknown"), ("hinge, closer, strike set up", "hardware_set", 70, "", "bare_set", "unknown"),
    ("see 101-01 102-02A 103-03 A-201 B-202", "door_schedule", 60, "", "unknown", "dash_numeric"), ("see 101-01 A-201B 10.E1.03", "door_schedule", 50, "", "unknown", "mixed"), ("short text", "cover", 50, "", "unknown", "unknown"),
    ("word " * 25, "other", 0, "", "unknown", "unknown"),
]


def _sample(k: int) -> str:
    return "[" + ", ".join(f"'{x[k]}'" for x in SAMPLES) + f"][(opening_id % {len(SAMPLES)})::INT + 1]"


@query(f"SELECT opening_id, {_sample(1)} AS type, [" + ", ".join(str(x[2]) for x in SAMPLES) + f"][(opening_id % {len(SAMPLES)})::INT + 1]::INT AS confidence, {_sample(3)} AS ids, {_sample(4)} AS heading, {_sample(5)} AS doors FROM openings")
def s04_page_kinds(spark, sf):
    text = F.element_at(F.array(*(F.lit(x[0]) for x in SAMPLES)), (F.col("opening_id") % len(SAMPLES) + 1).cast("int"))
    kind, mark = pages.page_type(text), pages.fingerprint(text)
    return frame(spark, sf, "openings").select("opening_id", kind["type"].alias("type"), kind["confidence"].alias("confidence"), F.array_join(pages.set_ids(text), ",").alias("ids"), mark["heading"].alias("heading"), mark["doors"].alias("doors"))


PAGE_SQL = r"""t AS (SELECT page_id, coalesce(html, '') AS html, regexp_replace(coalesce(html, ''), '<[^>]*>', ' ', 'g') AS t FROM pages)"""


#: What is no set id after the word, as RE2 has no lookahead.
STOPPED = "(?i)^(" + pages.NOT_A_SET[3:]


@query(rf"""WITH {PAGE_SQL}, c AS (SELECT page_id, html, t, regexp_matches(t, '{pages.COVER}') AS cover, regexp_matches(t, '{pages.REFERENCE}') AS ref, regexp_matches(t, '{pages.SCHEDULE}') AS schedule,
regexp_matches(t, '{pages.HEADING[0]}') OR regexp_matches(t, '{pages.HEADING[1]}') OR len(list_filter(regexp_extract_all(t, '(?i)(?:^|[^\w.])set\s*[:#]\s*([A-Z0-9][A-Z0-9.\-:]{{1,14}})\b', 1), lambda x: NOT regexp_matches(x, '{STOPPED}'))) > 0 AS heading,
len(regexp_extract_all(t, '{pages.ITEM}')) AS items, len(regexp_extract_all(t, '{pages.DOOR}')) AS doors, len(list_filter(regexp_split_to_array(t, '\s+'), lambda x: x <> '')) AS words FROM t)
SELECT page_id, length(trim(html)) < 50 AS scanned, CASE WHEN cover THEN 'cover' WHEN ref THEN 'reference' WHEN schedule THEN 'door_schedule' WHEN heading OR items >= 3 THEN 'hardware_set' WHEN doors >= 3 THEN 'door_schedule' WHEN words < 20 THEN 'cover' ELSE 'other' END AS type,
CASE WHEN cover THEN 90 WHEN ref THEN 85 WHEN schedule THEN 90 WHEN heading THEN 95 WHEN items >= 3 THEN 70 WHEN doors >= 5 THEN 60 WHEN doors >= 3 OR words < 20 THEN 50 ELSE 0 END::INT AS confidence FROM c""")
def s04_page_types(spark, sf):
    """Of all pages."""
    rows = table(spark, sf, "pages").withColumn("html", F.coalesce("html", F.lit(""))).withColumn("t", F.regexp_replace("html", "<[^>]*>", " "))
    kind = pages.page_type(F.col("t"))
    return rows.select("page_id", pages.scan_status(F.col("html"), F.lit(1))["scanned"].alias("scanned"), kind["type"].alias("type"), kind["confidence"].alias("confidence"))


HEADERS = ["Door No.", "Opening Number", "Hardware Set", "Hdwr Group", "Room Location", "Hand", "Fire Rating Label", "Door Type", "Frame", "Remarks and other notes on doors", "From", "", "12"]


def _plain_score(header: str, words: list[tuple[str, int]]) -> int:
    """A header's score for a field's words, word by word: what the SQL's values are made of."""
    tokens = [t for t in re.split(r"[\s._/#\-]+", header.lower().strip()) if t]
    hits = [next((w * 100 if t == k else w * 70 for k, w in words if t == k or (len(t) > 2 and (t.startswith(k) or k.startswith(t)))), None) for t in tokens]
    found = [h for h in hits if h]
    n = sum(found)
    return min(n * 6 // 5 if len(found) > 1 else n // 2 if len(tokens) > 3 else n, 10_000)


SCORED = "hs(header, field, score) AS (VALUES " + ", ".join(f"('{h}', '{f}', {_plain_score(h, w)})" for h in HEADERS for f, w in pages.KEYWORDS.items()) + ")"
WIDTH = 5


def headers(spark, sf):
    """The openings' tables: five headers each, one after another from the list."""
    pick = F.transform(F.sequence(F.lit(0), F.lit(WIDTH - 1)), lambda i: F.element_at(F.array(*map(F.lit, HEADERS)), ((F.col("opening_id") * 3 + i * (1 + F.col("opening_id") % 4)) % len(HEADERS) + 1).cast("int")))
    return frame(spark, sf, "openings").select(F.col("opening_id").alias("table_id"), F.posexplode(pick).alias("col", "header"))


@query(f"WITH {SCORED}, h AS (SELECT opening_id AS table_id, i::INT AS col, [" + ", ".join(f"'{h}'" for h in HEADERS) + f"][((opening_id * 3 + i * (1 + opening_id % 4)) % {len(HEADERS)})::INT + 1] AS header FROM openings, range(0, {WIDTH}) r(i)) SELECT table_id, col, field, score::BIGINT AS score FROM h JOIN hs USING (header) WHERE score > 0")
def s06_header_scores(spark, sf):
    return pages.header_scores(headers(spark, sf))


@query()
def s07_column_mapping(spark, sf):
    return pages.assign_columns(pages.header_scores(headers(spark, sf)))


@query()
def a34_chunks(spark, sf):
    p = frame(spark, sf, "activity").selectExpr("actor_id AS doc", "event_id AS page", "CASE action WHEN 'click' THEN 'hardware_set' WHEN 'view' THEN 'door_schedule' WHEN 'purchase' THEN 'cover' ELSE 'other' END AS type", "IF(action = 'click', array(concat('S', event_id % 3)), CAST(array() AS ARRAY<STRING>)) AS ids", "event_id % 5 = 0 AS continued")
    return pages.chunks(p, 4)


@query("WITH p AS (SELECT actor_id AS doc, event_id AS page, CASE action WHEN 'click' THEN 'hardware_set' WHEN 'view' THEN 'door_schedule' ELSE 'reference' END AS type, CASE WHEN action = 'click' THEN ['S' || (event_id % 3), 'T'] ELSE [] END AS ids, CASE event_id % 4 WHEN 0 THEN 'himmel' WHEN 1 THEN 'bare_set' ELSE 'unknown' END AS heading, CASE event_id % 3 WHEN 0 THEN 'dotted' ELSE 'unknown' END AS doors FROM activity), i AS (SELECT doc, count(DISTINCT id) AS sets, count(*) AS named FROM (SELECT doc, unnest(ids) AS id FROM p) GROUP BY 1), h AS (SELECT doc, heading FROM (SELECT doc, heading, count(*) AS n, min(page) AS f FROM p WHERE heading <> 'unknown' GROUP BY 1, 2) QUALIFY row_number() OVER (PARTITION BY doc ORDER BY n DESC, f) = 1) SELECT p.doc, coalesce(max(sets), 0)::INT AS sets, coalesce(max(named), 0)::BIGINT AS named, count(*) FILTER (type = 'door_schedule') AS schedule_pages, bool_or(type = 'reference') AS has_references, coalesce(max(h.heading), 'unknown') AS heading, NOT bool_or(p.doors = 'dotted') AS no_doors FROM p LEFT JOIN i USING (doc) LEFT JOIN h ON h.doc = p.doc GROUP BY p.doc")
def a24_document_profiles(spark, sf):
    p = frame(spark, sf, "activity").selectExpr("actor_id AS doc", "event_id AS page", "CASE action WHEN 'click' THEN 'hardware_set' WHEN 'view' THEN 'door_schedule' ELSE 'reference' END AS type", "IF(action = 'click', array(concat('S', event_id % 3), 'T'), CAST(array() AS ARRAY<STRING>)) AS ids", "CASE event_id % 4 WHEN 0 THEN 'himmel' WHEN 1 THEN 'bare_set' ELSE 'unknown' END AS heading", "CASE event_id % 3 WHEN 0 THEN 'dotted' ELSE 'unknown' END AS doors")
    return pages.profile(p).withColumn("no_doors", F.col("doors") == "unknown").drop("doors")


VALUES = "CASE opening_id % 9 WHEN 0 THEN '101' WHEN 1 THEN '12' WHEN 2 THEN '2024' WHEN 3 THEN '555-123-4567' WHEN 4 THEN '90210' WHEN 5 THEN 'A 101' WHEN 6 THEN 'lobby' WHEN 7 THEN '110-01C' ELSE '' END"


@query("SELECT opening_id, opening_id % 9 IN (0, 7) AS valid, opening_id % 4 IN (1, 2, 3) AS contact FROM openings")
def p21_light_doors(spark, sf):
    row = F.expr("CASE opening_id % 4 WHEN 0 THEN array('101', 'Lobby') WHEN 1 THEN array('call', '555.123.4567') WHEN 2 THEN array('Main Street 5') ELSE array('a.b@c.org', NULL) END")
    return frame(spark, sf, "openings").select("opening_id", pages.looks_like_door(F.expr(VALUES)).alias("valid"), pages.contact_row(row).alias("contact"))


@query("WITH o AS (SELECT opening_id AS page, CASE opening_id % 5 WHEN 0 THEN 'schedule' END AS to_, opening_id % 7 = 0 AS gone FROM openings WHERE opening_id % 2 = 0) SELECT p.opening_id AS page, coalesce(to_, CASE WHEN p.status = 'F' THEN 'hardware_set' ELSE 'other' END) AS type FROM openings p LEFT JOIN o ON o.page = p.opening_id WHERE NOT coalesce(gone, false)")
def p18_page_overrides(spark, sf):
    p = frame(spark, sf, "openings").selectExpr("opening_id AS page", "IF(status = 'F', 'hardware_set', 'other') AS type")
    o = frame(spark, sf, "openings").where("opening_id % 2 = 0").selectExpr("opening_id AS page", "IF(opening_id % 5 = 0, 'schedule', NULL) AS new_type", "opening_id % 7 = 0 AS excluded")
    return pages.overridden(p, o)


@query("SELECT opening_id FROM openings WHERE door_type = '' AND frame_type = '' AND opening_id NOT IN (SELECT opening_id FROM items)")
def p24_zero_items(spark, sf):
    o = frame(spark, sf, "openings").where("trim(door_type) = '' AND trim(frame_type) = ''").select("opening_id")
    return o.join(frame(spark, sf, "items").select("opening_id"), "opening_id", "left_anti")


@query("SELECT event_id, json_extract(details, '$.k') IS NOT NULL AS has_k, json_extract(details, '$.none') IS NOT NULL AS has_none, try_cast(json_extract_string(details, '$.k') AS INTEGER) AS k FROM activity")
def p07_json_keys(spark, sf):
    keys = F.json_object_keys("details")
    return frame(spark, sf, "activity").select("event_id", F.array_contains(keys, "k").alias("has_k"), F.array_contains(keys, "none").alias("has_none"), F.get_json_object("details", "$.k").try_cast("int").alias("k"))


@query("WITH p AS (SELECT event_id, actor_id, action, action IN ('click', 'view') AS keep FROM activity) SELECT actor_id, count(*) FILTER (keep) AS schedule, count(*) FILTER (NOT keep) AS other, min(event_id) FILTER (keep) AS first FROM p GROUP BY 1")
def x07_schedule_pages(spark, sf):
    keep = F.col("action").isin("click", "view")
    return frame(spark, sf, "activity").groupBy("actor_id").agg(F.count(F.when(keep, 1)).alias("schedule"), F.count(F.when(~keep, 1)).alias("other"), F.min(F.when(keep, F.col("event_id"))).alias("first"))


@query("WITH g AS (SELECT actor_id, action, string_agg(event_id::VARCHAR, ',' ORDER BY event_id) AS pages FROM activity GROUP BY 1, 2) SELECT actor_id, coalesce(max(pages) FILTER (action = 'click'), '') AS click, coalesce(max(pages) FILTER (action = 'view'), '') AS view FROM g GROUP BY 1")
def x08_pages_by_type(spark, sf):
    rows = frame(spark, sf, "activity").groupBy("actor_id", "action").agg(F.array_join(F.transform(F.array_sort(F.collect_list("event_id")), lambda x: x.cast("string")), ",").alias("pages"))
    wide = rows.groupBy("actor_id").pivot("action", ["click", "view"]).agg(F.first("pages"))
    return wide.na.fill("")


@query("WITH c AS (SELECT hw_set, hand, count(*) AS n FROM openings WHERE hand <> '' GROUP BY 1, 2) SELECT hw_set, hand, n, row_number() OVER (PARTITION BY hw_set ORDER BY n DESC, hand) AS place FROM c QUALIFY place <= 2")
def x10_top_issues(spark, sf):
    c = frame(spark, sf, "openings").where("hand <> ''").groupBy("hw_set", "hand").agg(F.count("*").alias("n"))
    return views.ranked_by(c, ["hw_set"], 2, F.desc("n"), F.asc("hand")).withColumn("place", F.col("place").cast("long"))


@query("SELECT o.opening_id, o.door_number, arg_min(n, n * 10 + 1) AS score FROM openings o JOIN (SELECT opening_id, qty AS n FROM items) i USING (opening_id) GROUP BY 1, 2")
def x20_worst_chunk(spark, sf):
    i = frame(spark, sf, "items").groupBy("opening_id").agg(F.min_by("qty", "qty").alias("score"))
    return frame(spark, sf, "openings").select("opening_id", "door_number").join(i, "opening_id")


@query("WITH p AS (SELECT opening_id, item_id, CASE sort_order % 3 WHEN 0 THEN NULL ELSE sort_order % 3 END AS leaf, sort_order * 1000000 + item_id AS pos, checked FROM items), k AS (SELECT opening_id, coalesce(leaf, 1) AS leaf, arg_min(checked, pos) AS checked FROM p GROUP BY 1, 2) SELECT o.opening_id, l.leaf, k.checked FROM openings o CROSS JOIN (VALUES (1), (2)) l(leaf) LEFT JOIN k ON k.opening_id = o.opening_id AND k.leaf = l.leaf")
def x22_leaf_progress(spark, sf):
    p = frame(spark, sf, "items", PLACE).selectExpr("opening_id", "nullif(sort_order % 3, 0) AS leaf", "sort_order * 1000000 + item_id AS pos", "place", "checked").where("pos is not null and checked is not null")
    k = p.groupBy("opening_id", F.coalesce("leaf", F.lit(1)).cast("int").alias("leaf")).agg(F.min_by("checked", F.struct("pos", "place")).alias("checked"))
    leaves = frame(spark, sf, "openings").select("opening_id", F.explode(F.array(F.lit(1), F.lit(2))).alias("leaf"))
    return leaves.join(k, ["opening_id", "leaf"], "left")


@query("SELECT d.o AS door, h.opening_id FROM (SELECT 'D' || (i * 37) AS o FROM range(0, 400) r(i)) d JOIN openings h ON h.door_number = d.o")
def x19_sibling_fill(spark, sf):
    wanted = spark.range(400).selectExpr("concat('D', id * 37) AS door")
    return wanted.join(frame(spark, sf, "openings").select(F.col("door_number").alias("door"), "opening_id"), "door")


@query("SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(nfc_normalize(replace(coalesce(text, ''), chr(160), ' ')), '[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F\\x7F]', '', 'g'), '\\(cid:[0-9]+\\)', '', 'g'), '  +', ' ', 'g'), '^\\s+|\\s+$', '', 'g'), '[—–‒-]+$', '') AS cell FROM documents")
def f10_clean_cells(spark, sf):
    return table(spark, sf, "documents").select("doc_id", T.clean_cell(F.coalesce("text", F.lit(""))).alias("cell"))


BLOCKS = [
    ("1 Pair Doors #1.01.B.03A\n1 Single Door #2.01.E.08, #110-07B", 2, 3, "1.01.B.03A,2.01.E.08,110-07B", "counted", "1.01.B.03A,2.01.E.08,110-07B", "", ""),
    ("Heading #I2S-1E:WI (Set #I2S-1E)\n2 Double Egress Doors #110-07B", 2, 4, "110-07B,I2S-1E:WI", "counted", "110-07B", "I2S-1E:WI", "I2S-1E"),
    ("1 SGL DOOR(S)3.01.H.04 Lobby LH\n1 PR DOOR(S)3.01.E.02A", 0, 0, "3.01.H.04,3.01.E.02A", "dealt", "3.01.H.04,3.01.E.02A", "", ""),
    ("Hardware Set: DH4A\nFor Openings: 101, 102A, 94", 0, 0, "", "inline", "101,102A", "DH4A", "DH4A"),
    ("33. HW Set EL-XL1 is noted", 0, 0, "", "none", "", "", ""),
    ("Heading #: E1-XL.1 LOBBY", 0, 0, "", "none", "", "E1-XL.1", "E1-XL.1"),
]


def _block(k: int, text: bool = True) -> str:
    return "[" + ", ".join(f"'{x[k]}'" if text else str(x[k]) for x in BLOCKS) + f"][(opening_id % {len(BLOCKS)})::INT + 1]"


@query(f"SELECT opening_id, {_block(1, False)}::BIGINT AS doors, {_block(2, False)}::BIGINT AS leaves, {_block(3)} AS numbers, {_block(4)} AS family, {_block(5)} AS assigned, {_block(6)} AS heading_id, {_block(7)} AS generic_id FROM openings")
def a33_heading_blocks(spark, sf):
    text = F.element_at(F.array(*(F.lit(x[0]) for x in BLOCKS)), (F.col("opening_id") % len(BLOCKS) + 1).cast("int"))
    counts, inline, heading = lines.heading_doors(text), lines.inline_doors(text), lines.set_heading(text)
    return frame(spark, sf, "openings").select("opening_id", counts["doors"].alias("doors"), counts["leaves"].alias("leaves"), F.array_join(lines.heading_door_numbers(text), ",").alias("numbers"), inline["family"].alias("family"), F.array_join(inline["doors"], ",").alias("assigned"), heading["heading_id"].alias("heading_id"), heading["generic_id"].alias("generic_id"))


MADE = [("Microsoft(R) Word", "", "word_excel"), ("", "Bluebeam PDF", "bluebeam"), ("Openings Studio", "x", "assa_abloy"), ("Spec4", "", "s4h"), ("x", "y", "unknown"), ("Overtur", "LibreOffice", "allegion")]


@query("SELECT opening_id, [" + ", ".join(f"'{x[2]}'" for x in MADE) + f"][(opening_id % {len(MADE)})::INT + 1] AS producer FROM openings")
def s05_producers(spark, sf):
    pick = lambda k: F.element_at(F.array(*(F.lit(x[k]) for x in MADE)), (F.col("opening_id") % len(MADE) + 1).cast("int"))
    return frame(spark, sf, "openings").select("opening_id", lines.producer(pick(0), pick(1)).alias("producer"))


PROSE = [('{"b": 1, "a": [2]}', '{"a":[2],"b":1}'), ('Sure!\n```json\n{"x": "y"}\n``` done', '{"x":"y"}'), ('first {no} then [1, 2] and {"z": 3}', "[1,2]"), ("nothing here", None), ("", None), ('text {"a": {"b": "}"}} tail', '{"a":{"b":"}"}}')]


@query("SELECT opening_id, [" + ", ".join("NULL" if b is None else f"'{b}'" for _, b in PROSE) + f"][(opening_id % {len(PROSE)})::INT + 1] AS json FROM openings")
def f29_json_in_prose(spark, sf):
    given = F.element_at(F.array(*(F.lit(a) for a, _ in PROSE)), (F.col("opening_id") % len(PROSE) + 1).cast("int"))
    return frame(spark, sf, "openings").select("opening_id", lines.json_in(given).alias("json"))


@query("WITH l AS (SELECT *, CASE WHEN action IN ('click', 'purchase') THEN 'D' || event_id END AS d FROM activity), g AS (SELECT *, sum((d IS NOT NULL)::INT) OVER (PARTITION BY actor_id ORDER BY event_id) AS k FROM l) SELECT actor_id, min(event_id) AS event_id, min(d) AS door, string_agg(action, ' ' ORDER BY event_id) AS action FROM g WHERE k > 0 GROUP BY actor_id, k")
def w06_stitched_lines(spark, sf):
    a = frame(spark, sf, "activity").select("actor_id", "event_id", "action")
    door = F.when(F.col("action").isin("click", "purchase"), F.concat(F.lit("D"), F.col("event_id").cast("string")))
    return lines.carried(a, "actor_id", "event_id", "action", door)
