"""Queries over hardware schedules: categories, names, rules, quantities, scores, with the DuckDB SQL that checks them."""

from __future__ import annotations

from pyspark.sql import functions as F

from jambwork.functions import taxonomy as C
from jambwork.functions import text as T
from jambwork.operators import linkage, merge, quality, quantity, rollups, scores, sets
from jambwork.plans.catalog import query
from jambwork.sources.tables import frame

#: What each name and model is: category, scope, place on a pair, category of sets, its most, keyword, plain name.
KINDS = """kinds(name, model, category, scope, place, set_category, most, keyword, plain) AS (VALUES
('Hinge', '5BB1 4 1/2 x 4 1/2', 'hinges', 'per_leaf', 'split', 'hinge', 5, 'hinge', 'hinge'), ('Hinges', '5BB1 CON TW8', 'electric_hinge', 'per_opening', 'active', 'hinge', 5, 'hinge', 'hinges'),
('Continuous Hinge', '780', 'continuous_hinge', 'per_leaf', 'split', 'continuous_hinge', 2, 'hinge', 'continuous hinge'), ('Lockset RHR', 'ND80', 'lockset', 'per_leaf', 'active', 'lockset', 1, 'lockset', 'lockset rhr'),
('Exit Device 99EO US26D', '99EO', 'exit_device', 'per_leaf', 'active', 'exit_device', 2, 'exit', 'exit device'), ('Flush Bolt', '458', 'flush_bolt', 'per_pair', 'inactive', 'flush_bolt', 2, 'flush', 'flush bolt'),
('Closer LH', '4040XP', 'closer', 'per_opening', 'split', 'closer', 2, 'closer', 'closer lh'), ('Kick Plate', '8400', 'kick_plate', 'per_leaf', 'split', 'kick_plate', 2, 'kick', 'kick plate'),
('Wall Stop', 'WS406', 'stop', 'per_opening', 'split', 'stop', 2, 'stop', 'wall stop'), ('Threshold', '171A', 'threshold', 'per_frame', 'shared', 'threshold', 1, 'threshold', 'threshold'),
('Gasketing', '188S', 'gasketing', 'per_frame', 'shared', 'seal', 3, NULL, 'gasketing'), ('Silencer', 'SR64', 'silencer', 'per_frame', 'shared', 'silencer', 4, NULL, 'silencer'),
('Coordinator', '3094', 'coordinator', 'per_pair', 'shared', 'coordinator', 1, 'coordinator', 'coordinator'), ('Door', '', 'unknown', NULL, NULL, NULL, 4, NULL, 'door'), ('Door (Active Leaf)', '', 'unknown', NULL, NULL, NULL, 4, NULL, 'door'),
('Door (Inactive Leaf)', '', 'unknown', NULL, NULL, NULL, 4, NULL, 'door'), ('Frame', '', 'unknown', NULL, NULL, NULL, 4, NULL, 'frame'), ('Auto Operator', '4640', 'auto_operator', 'per_opening', 'active', 'auto_operator', 1, NULL, 'auto operator'),
('Cylinder Housing', '20-057', 'cylinder_housing', 'per_leaf', 'active', 'cylinder', 2, NULL, 'cylinder housing'), ('Permanent Core', '23-030', 'core', 'per_leaf', 'active', 'cylinder', 2, NULL, 'permanent core'),
('Door Viewer', '', 'viewer', 'per_leaf', 'split', NULL, 4, NULL, 'door viewer'), ('Astragal', '', 'astragal', 'per_pair', 'shared', 'astragal', 1, NULL, 'astragal'), ('Widget', 'X1', 'unknown', NULL, NULL, NULL, 4, NULL, 'widget'),
('Strike', 'ES', 'strike', 'per_opening', 'shared', 'strike', 2, NULL, 'strike'))"""


@query(f"WITH {KINDS} SELECT opening_id, pos, category, scope, coalesce(place, CASE WHEN qty > 1 THEN 'split' ELSE 'shared' END) AS place FROM hardware JOIN kinds USING (name, model)")
def f11_categories(spark, sf):
    h = sets.per_distinct(frame(spark, sf, "hardware"), ["name", "model"], category=C.category(F.col("name"), F.col("model")), scope=C.scope(F.col("name"), F.col("model")))
    return h.select("opening_id", "pos", "category", "scope", C.placement(F.col("category"), F.col("qty")).alias("place"))


@query(f"WITH {KINDS} SELECT h.opening_id, h.pos, CASE h.name WHEN 'Door (Active Leaf)' THEN 'active' WHEN 'Door (Inactive Leaf)' THEN 'inactive' WHEN 'Frame' THEN 'shared' WHEN 'Door' THEN CASE WHEN leaf_count <= 1 THEN 'active' END ELSE CASE WHEN leaf_count > 1 THEN nullif(coalesce(place, CASE WHEN qty > 1 THEN 'split' ELSE 'shared' END), 'split') END END AS leaf_side FROM hardware h JOIN kinds USING (name, model) JOIN openings USING (opening_id)")
def f12_leaf_sides(spark, sf):
    h = sets.per_distinct(frame(spark, sf, "hardware"), ["name", "model"], category=C.category(F.col("name"), F.col("model")))
    h = h.join(frame(spark, sf, "openings").select("opening_id", "leaf_count"), "opening_id")
    return h.select("opening_id", "pos", C.leaf_side(F.col("name"), F.col("category"), F.col("leaf_count"), F.col("qty")).alias("leaf_side"))


@query(f"WITH {KINDS} SELECT opening_id, pos, set_category, most, keyword, plain FROM hardware JOIN kinds USING (name, model)")
def f13_set_categories(spark, sf):
    h = sets.per_distinct(frame(spark, sf, "hardware").select("opening_id", "pos", "name"), ["name"], set_category=C.set_category(F.col("name")), keyword=C.keyword(F.col("name")), plain=T.item_name(F.col("name")))
    return h.select("opening_id", "pos", "set_category", C.most_of(F.col("set_category")).alias("most"), "keyword", "plain")


SPELLINGS = [("Cont. Hinge", "continuous hinge"), ("FLR Stop (w/ hold)", "floor stop w/ hold"), ("closer w/o mtd. brkt.", "closer without mounted brkt"), ("Conc Closer hd", "concealed closer heavy duty"), ("Adj.  Thresh;", "adjustable thresh"), ("elec strike ss", "electric strike stainless steel"), ("", "")]


@query("SELECT opening_id, [" + ", ".join(f"'{b}'" for _, b in SPELLINGS) + f"][(opening_id % {len(SPELLINGS)})::INT + 1] AS spelled FROM openings")
def f06_spelled_out(spark, sf):
    given = F.element_at(F.array(*(F.lit(a) for a, _ in SPELLINGS)), (F.col("opening_id") % len(SPELLINGS) + 1).cast("int"))
    return frame(spark, sf, "openings").select("opening_id", T.spelled_out(given).alias("spelled"))


MODELS = [("L9080P 06A", "Schlage", "L9080"), ("99EO-F", "Von Duprin", "99"), ("4040XP REG", "LCN Closers", "4040XP"), ("8205", "SARGENT", "8205"), ("4x4 5BB1-", "Ives", "5BB1"), ("4 1/2 x 4 1/2", "Ives", "4"), ("", "Ives", ""), ("ML2051", "Corbin Russwin", "ML2051"), ("x99", "", "X99")]


@query("SELECT opening_id, [" + ", ".join(f"'{s}'" for *_, s in MODELS) + f"][(opening_id % {len(MODELS)})::INT + 1] AS series FROM openings")
def f09_base_series(spark, sf):
    pick = lambda k: F.element_at(F.array(*(F.lit(x[k]) for x in MODELS)), (F.col("opening_id") % len(MODELS) + 1).cast("int"))
    return frame(spark, sf, "openings").select("opening_id", T.base_series(pick(0), pick(1)).alias("series"))


TYPES = "CASE o_type WHEN 0 THEN '6070' WHEN 1 THEN '3070' WHEN 2 THEN 'HM PR' ELSE '' END"
PAIRS = f"SELECT opening_id, leaf_count, opening_id % 3 AS named, opening_id % 2 AS doors, {TYPES} AS door_type, CASE WHEN opening_id % 7 = 0 THEN 'Double doors' ELSE 'Single' END AS heading FROM (SELECT *, opening_id % 4 AS o_type FROM openings)"


@query(f"SELECT opening_id, CASE WHEN named >= 2 THEN 'primary' WHEN doors >= 1 AND leaf_count > doors THEN 'secondary' WHEN door_type = '6070' THEN 'tertiary' WHEN door_type = 'HM PR' OR heading = 'Double doors' THEN 'quaternary' ELSE 'none' END AS tier FROM ({PAIRS})")
def f16_pair_signals(spark, sf):
    o = frame(spark, sf, "openings").withColumn("o_type", F.col("opening_id") % 4).selectExpr("opening_id", "leaf_count", "opening_id % 3 AS named", "opening_id % 2 AS doors", f"{TYPES} AS door_type", "CASE WHEN opening_id % 7 = 0 THEN 'Double doors' ELSE 'Single' END AS heading")
    return o.select("opening_id", T.pair_signal(F.col("named"), F.col("leaf_count"), F.col("doors"), F.col("door_type"), F.lit(""), F.col("heading")).alias("tier"))


FOUND = [("Opening Description: 90Min 3' 0\" x 7' 0\"", "90Min", "location", 40), ("RHRA", "", "hand", 95), ("90 min", "", "fire_rating", 90), ("Room 101 90Min LH", "", "location", 70), ("", "", "unknown", 0), ("Lobby", "", "location", 40), ("opening description: Type A", "", "location", 40)]


@query("SELECT opening_id, [" + ", ".join(f"'{r}'" for _, r, *_ in FOUND) + f"][(opening_id % {len(FOUND)})::INT + 1] AS rating, [" + ", ".join(f"'{f}'" for _, _, f, _ in FOUND) + f"][(opening_id % {len(FOUND)})::INT + 1] AS field, [" + ", ".join(str(c) for *_, c in FOUND) + f"][(opening_id % {len(FOUND)})::INT + 1]::INT AS confidence FROM openings")
def f20_detected_fields(spark, sf):
    given = F.element_at(F.array(*(F.lit(x[0]) for x in FOUND)), (F.col("opening_id") % len(FOUND) + 1).cast("int"))
    found = T.detected_field(given)
    return frame(spark, sf, "openings").select("opening_id", T.described_rating(given).alias("rating"), found["field"].alias("field"), found["confidence"].alias("confidence"))


FIELDS = ["door_number", "hw_set", "location", "door_type", "frame_type", "fire_rating", "hand"]
FULL = "(" + " + ".join(f"(coalesce(trim({c}), '') <> '')::INT" for c in FIELDS) + ") / 7.0"
FITS = {"door_number": "false", "hw_set": "regexp_matches(trim(hw_set), '^DH[0-9]{1,4}$')", "fire_rating": "fire_rating IN ('45 MIN', '90 MIN')", "hand": "hand IN ('LH', 'RH', 'LHR', 'RHR')", "door_type": "false", "frame_type": "false"}
SCORE = {c: f"round(0.4 * (coalesce(trim({c}), '') <> '')::INT + 0.25 * " + (f"CASE WHEN coalesce(trim({c}), '') = '' THEN 0 WHEN {FITS[c]} THEN 1 ELSE 0.3 END" if c in FITS else "0.5") + f" + 0.25 * {FULL}, 6)::DOUBLE" for c in FIELDS}


@query("SELECT opening_id, " + ", ".join(f"{e} AS {c}_score" for c, e in SCORE.items()) + " FROM openings")
def f22_field_scores(spark, sf):
    return scores.field_scores(frame(spark, sf, "openings")).select("opening_id", *(f"{c}_score" for c in FIELDS))


@query("SELECT round(sum(" + " + ".join(SCORE.values()) + ") / (7 * count(*)), 6) AS average, count(*) AS doors FROM openings")
def a18_average_score(spark, sf):
    return scores.average_score(scores.field_scores(frame(spark, sf, "openings")))


REVIEWED = "SELECT opening_id, CASE WHEN opening_id % 40 = 3 THEN 'N/A' ELSE hw_set END AS hw_set, door_number, location, door_type, frame_type, fire_rating, hand, opening_id % 6 AS sure FROM openings"
DOUBTS = f"d AS ({REVIEWED}), i AS (SELECT opening_id, hw_set, list_filter([CASE WHEN hw_set = 'N/A' THEN 'missing_hw_set' END, CASE WHEN trim(location) = '' THEN 'missing_location' END, CASE WHEN trim(fire_rating) = '' THEN 'missing_fire_rating' END, CASE WHEN trim(hand) = '' THEN 'missing_hand' END, CASE WHEN trim(door_type) = '' THEN 'missing_door_type' END, CASE WHEN trim(frame_type) = '' THEN 'missing_frame_type' END], lambda x: x IS NOT NULL) AS m, CASE WHEN sure < 2 THEN ['low_confidence_hand'] ELSE [] END AS l FROM d)"


def reviewed(spark, sf):
    o = frame(spark, sf, "openings").withColumn("hw_set", F.expr("CASE WHEN opening_id % 40 = 3 THEN 'N/A' ELSE hw_set END"))
    return scores.door_issues(o.withColumn("field_confidence", F.expr("map('hand', IF(opening_id % 6 < 2, 0.5D, 0.9D), 'location', 0.7D)")))


@query(f"WITH {DOUBTS} SELECT opening_id, array_to_string(list_concat(m, l), ',') AS issues, CASE WHEN hw_set = 'N/A' THEN 'low' WHEN len(l) > 0 OR len(list_filter(m, lambda x: x <> 'missing_hw_set')) >= 3 THEN 'medium' ELSE 'high' END AS level FROM i")
def f24_review_levels(spark, sf):
    return reviewed(spark, sf).select("opening_id", F.array_join("issues", ",").alias("issues"), "level")


@query(f"WITH {DOUBTS}, e AS (SELECT hw_set, unnest(list_concat(m, l)) AS issue FROM i), g AS (SELECT issue, count(*) AS doors, count(DISTINCT hw_set) AS sets, CASE WHEN issue = 'missing_hw_set' THEN 'high' WHEN issue IN ('missing_location', 'missing_door_type', 'missing_frame_type') THEN 'soft' ELSE 'med' END AS severity FROM e GROUP BY 1) SELECT *, row_number() OVER (ORDER BY CASE severity WHEN 'high' THEN 0 WHEN 'med' THEN 1 ELSE 2 END, doors DESC, issue) AS place FROM g")
def a16_issue_groups(spark, sf):
    return scores.issue_groups(reviewed(spark, sf))


DOORS = "regexp_matches(name, '^Door(\\s|$|\\()')"
RULES = f"k AS (SELECT opening_id, count(*) FILTER ({DOORS}) AS d, count(*) FILTER (name = 'Frame') AS f, count(*) FILTER (name = 'Door') AS b, count(*) FILTER (name = 'Door (Active Leaf)') AS a, count(*) FILTER (name = 'Door (Inactive Leaf)') AS n, bool_or(leaf_side = 'inactive') AS i, bool_or(name = 'Lockset RHR') AS r, bool_or(name = 'Closer LH') AS l FROM hardware GROUP BY 1), o AS (SELECT *, hand LIKE 'RH%' AS right_, hand LIKE 'LH%' AS left_ FROM openings LEFT JOIN k USING (opening_id)), v AS (SELECT 'too_many_doors' AS rule, 'blocker' AS severity, opening_id FROM o WHERE d > 2 UNION ALL SELECT 'conflicting_door_variants', 'blocker', opening_id FROM o WHERE b > 0 AND a + n > 0 UNION ALL SELECT 'too_many_frames', 'blocker', opening_id FROM o WHERE f > 1 UNION ALL SELECT 'single_leaf_door_count_mismatch', 'blocker', opening_id FROM o WHERE leaf_count = 1 AND d > 1 UNION ALL SELECT 'pair_leaf_door_count_mismatch', 'blocker', opening_id FROM o WHERE leaf_count = 2 AND d > 0 AND NOT (d = 2 AND a = 1 AND n = 1) UNION ALL SELECT 'location_matches_fire_rating', 'warning', opening_id FROM o WHERE location LIKE '5-%' AND false UNION ALL SELECT 'leaf_count_consistency', 'blocker', opening_id FROM o WHERE leaf_count = 1 AND i UNION ALL SELECT 'handing_consistency', 'blocker', opening_id FROM o WHERE leaf_count = 1 AND ((right_ AND l) OR (left_ AND r)))"


@query(f"WITH {RULES} SELECT * FROM v")
def q01_violations(spark, sf):
    return quality.violations(frame(spark, sf, "openings"), frame(spark, sf, "hardware"))


@query(f"WITH {RULES} SELECT rule, severity, CASE severity WHEN 'blocker' THEN 0 ELSE 1 END::INT AS rank, count(*) AS n, min(opening_id) AS first, array_to_string(list_sort(list(opening_id))[1:10], ',') AS samples FROM v GROUP BY rule, severity")
def q02_grouped_violations(spark, sf):
    return quality.grouped(q01_violations(spark, sf))


@query(f"WITH {KINDS}, p AS (SELECT h.*, category, scope FROM hardware h JOIN kinds USING (name, model) JOIN openings o USING (opening_id) WHERE leaf_count = 2 AND NOT {DOORS.replace('name', 'h.name')} AND h.name <> 'Frame'), s AS (SELECT 'per_leaf_qty_sum_mismatch' AS rule, opening_id, name FROM p WHERE scope = 'per_leaf' GROUP BY opening_id, name HAVING bool_or(leaf_side = 'active') AND bool_or(leaf_side = 'inactive') AND (sum(qty) > 2 * max(qty))), t AS (SELECT 'pair_leaf_hinge_duplication', opening_id, lower(name) FROM p WHERE category = 'hinges' GROUP BY opening_id, name, model, leaf_side HAVING count(*) > 1) SELECT *, 'warning' AS severity FROM (SELECT * FROM s UNION ALL SELECT * FROM t)")
def q03_leaf_rules(spark, sf):
    return quality.leaf_violations(frame(spark, sf, "openings"), frame(spark, sf, "hardware"))


@query("SELECT 'heading_door_set_mismatch' AS rule, 'blocker' AS severity, opening_id, hw_set || '.1' AS set_id FROM openings WHERE opening_id % 3 = 0")
def q04_heading_doors(spark, sf):
    o = frame(spark, sf, "openings")
    listed = o.where("opening_id % 3 = 0").groupBy("hw_set").agg(F.collect_list(F.concat(F.lit(" "), F.lower("door_number"))).alias("heading_doors"))
    s = listed.select(F.concat("hw_set", F.lit(".1")).alias("set_id"), F.col("hw_set").alias("generic_id"), "heading_doors")
    return quality.heading_mismatches(o, s)


@query("SELECT h.opening_id, h.pos, CASE WHEN o.opening_id IS NULL THEN 'no_opening' WHEN leaf_count >= 2 THEN 'pair' WHEN hand = '' THEN 'unknown_hand' WHEN name NOT IN ('Lockset RHR', 'Closer LH') THEN 'any_hand' WHEN (name = 'Lockset RHR') = (hand LIKE 'RH%') THEN 'same_hand' ELSE 'dropped' END AS fate FROM hardware h LEFT JOIN (SELECT * FROM openings WHERE status <> 'P') o USING (opening_id)")
def p23_hand_filter(spark, sf):
    return quality.hand_filtered(frame(spark, sf, "hardware"), frame(spark, sf, "openings").where("status <> 'P'")).select("opening_id", "pos", "fate")


@query(f"WITH {KINDS}, e AS (SELECT h.opening_id, sum(qty) AS e FROM hardware h JOIN kinds USING (name, model) JOIN openings USING (opening_id) WHERE category = 'electric_hinge' AND leaf_count > 1 GROUP BY 1 HAVING sum(qty) > 0), t AS (SELECT opening_id, max(qty) - min(qty) AS d, min(struct_pack(q := qty, p := pos)).p AS pos FROM hardware JOIN kinds USING (name, model) WHERE category = 'hinges' GROUP BY opening_id, name, model HAVING count(*) = 2) SELECT opening_id, pos FROM hardware WHERE (opening_id, pos) NOT IN (SELECT (t.opening_id, t.pos) FROM t JOIN e USING (opening_id) WHERE d = e)")
def u08_consolidated_hinges(spark, sf):
    h = frame(spark, sf, "hardware").withColumn("leaf_side", F.lit(None).cast("string"))
    return quality.consolidated(h, frame(spark, sf, "openings")).select("opening_id", "pos")


USUAL = "usual(category, l1, m1, l2, m2) AS (VALUES ('hinges', 3, 5, 6, 10), ('electric_hinge', 1, 1, 1, 1), ('continuous_hinge', 1, 1, 2, 2), ('lockset', 1, 1, 1, 2), ('exit_device', 1, 1, 2, 2), ('flush_bolt', 0, 0, 1, 2), ('closer', 1, 1, 2, 2), ('kick_plate', 1, 1, 2, 2), ('stop', 1, 1, 2, 2), ('threshold', 1, 1, 1, 1), ('gasketing', 1, 1, 2, 2), ('silencer', 1, 3, 1, 3), ('coordinator', 0, 0, 1, 1), ('auto_operator', 1, 1, 1, 2), ('cylinder_housing', 1, 1, 1, 2), ('core', 1, 2, 1, 2), ('viewer', 1, 1, 1, 2), ('astragal', 0, 0, 1, 1), ('strike', 0, 1, 0, 2))"


@query(f"WITH {KINDS}, {USUAL}, r AS (SELECT h.opening_id, h.pos, qty, CASE WHEN leaf_count > 1 THEN l2 ELSE l1 END AS least, CASE WHEN leaf_count > 1 THEN m2 ELSE m1 END AS most FROM hardware h JOIN kinds USING (name, model) JOIN openings USING (opening_id) LEFT JOIN usual USING (category)) SELECT opening_id, pos, CASE WHEN least = 0 AND most = 0 THEN NULL WHEN qty < least THEN 'low' WHEN qty > 2 * most THEN 'high' END AS warning FROM r")
def q05_quantity_warnings(spark, sf):
    h = frame(spark, sf, "hardware").join(frame(spark, sf, "openings").select("opening_id", "leaf_count"), "opening_id")
    h = sets.per_distinct(h, ["name", "model"], category=C.category(F.col("name"), F.col("model")))
    return h.select("opening_id", "pos", C.quantity_warning(F.col("category"), F.col("qty"), F.col("leaf_count") > 1).alias("warning"))


EXPECTED = {(0, 0, 0): "continuous_hinge,pivot_hinge,spring_hinge,hinges,lockset,closer,core,stop,silencer,signage", (1, 0, 0): "electric_hinge,continuous_hinge,pivot_hinge,spring_hinge,hinges,exit_device,elec_modification,auto_operator,closer,cylinder_housing,core,kick_plate,door_sweep,threshold,gasket,gasketing,weatherstrip,rain_drip,viewer", (0, 1, 1): "continuous_hinge,pivot_hinge,spring_hinge,hinges,lockset,exit_device,flush_bolt,closer,core,stop,gasket,smoke_seal,gasketing,silencer,signage"}


@query("SELECT opening_id, CASE opening_id % 3 " + " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(EXPECTED.values())) + " END AS expected FROM openings")
def q06_expected_categories(spark, sf):
    of = lambda k: F.element_at(F.array(*(F.lit(bool(x[k])) for x in EXPECTED)), (F.col("opening_id") % 3 + 1).cast("int"))
    return frame(spark, sf, "openings").select("opening_id", F.array_join(C.expected(of(0), of(1), of(2)), ",").alias("expected"))


@query(f"WITH {KINDS}, r AS (SELECT h.opening_id, h.pos, leaf_count, CASE WHEN pos % 3 > 0 THEN leaf_side END AS side, coalesce(place, CASE WHEN qty > 1 THEN 'split' ELSE 'shared' END) AS place FROM hardware h JOIN kinds USING (name, model) JOIN openings USING (opening_id)), g AS (SELECT opening_id, pos, CASE WHEN leaf_count <= 1 AND side = 'inactive' THEN [] WHEN leaf_count <= 1 AND side = 'shared' THEN ['shared'] WHEN leaf_count <= 1 THEN ['leaf1'] WHEN coalesce(side, place) = 'active' THEN ['leaf1'] WHEN coalesce(side, place) = 'inactive' THEN ['leaf2'] WHEN coalesce(side, place) = 'shared' THEN ['shared'] ELSE ['leaf1', 'leaf2'] END AS g FROM r) SELECT opening_id, pos, unnest(g) AS \"group\" FROM g")
def m07_rendered_leaves(spark, sf):
    h = sets.per_distinct(frame(spark, sf, "hardware"), ["name", "model"], category=C.category(F.col("name"), F.col("model")))
    h = h.withColumn("leaf_side", F.expr("IF(pos % 3 > 0, leaf_side, NULL)")).withColumn("place", C.placement(F.col("category"), F.col("qty")))
    return quantity.rendered(h.join(frame(spark, sf, "openings").select("opening_id", "leaf_count"), "opening_id")).select("opening_id", "pos", "group")


@query("WITH d AS (SELECT i AS category, 7 AS q FROM range(0, 5) r(i)), r AS (SELECT opening_id, sort_order, item_id % 9 AS category, qty, CASE item_id % 4 WHEN 0 THEN 'divided' WHEN 1 THEN 'auto_corrected' ELSE 'parsed' END AS s FROM items) SELECT opening_id, sort_order, category, s = 'parsed' AND q IS NOT NULL AND qty <> q AS hit, CASE WHEN s = 'parsed' AND qty <> q THEN q ELSE qty END::INT AS qty FROM r LEFT JOIN d USING (category)")
def m10_propagated(spark, sf):
    i = frame(spark, sf, "items").selectExpr("opening_id", "sort_order", "item_id % 9 AS category", "qty", "CASE item_id % 4 WHEN 0 THEN 'divided' WHEN 1 THEN 'auto_corrected' ELSE 'parsed' END AS qty_source")
    out = quantity.propagate(i, spark.range(5).selectExpr("id AS category", "7 AS qty"))
    return out.select("opening_id", "sort_order", "category", (F.col("qty_source") == "propagated").alias("hit"), "qty")


SETS = ["Each opening to have:\n1 Lockset", "(42) 3 EA Hinge\n(14) 1 EA Closer", "24 Hinge\n8 Closer\n3 Stop", "1 SGL Door 101\n24 Hinge", "no items"]


@query("SELECT opening_id, ['per_opening', 'per_opening', CASE WHEN leaf_count > 1 THEN 'aggregate' ELSE 'unknown' END, 'unknown', 'unknown'][(opening_id % 5)::INT + 1] AS convention, CASE WHEN opening_id % 5 = 1 THEN '42/3,14/1' ELSE '' END AS dual FROM openings")
def a32_conventions(spark, sf):
    text = F.element_at(F.array(*map(F.lit, SETS)), (F.col("opening_id") % 5 + 1).cast("int"))
    dual = F.array_join(F.transform(quantity.dual_quantities(text), lambda x: F.concat_ws("/", x["total"].cast("string"), x["each"].cast("string"))), ",")
    return frame(spark, sf, "openings").select("opening_id", quantity.convention(text, F.col("leaf_count")).alias("convention"), dual.alias("dual"))


@query("WITH s AS (SELECT upper(hw_set) AS id, sum(CASE WHEN opening_id % 40 < 20 THEN 1 ELSE 0 END) AS d, sum(CASE WHEN opening_id % 40 < 20 THEN 2 ELSE 0 END) AS l, count(*) AS od, sum(leaf_count) AS ol FROM openings GROUP BY 1) SELECT id, CASE WHEN d > 0 THEN d ELSE od END::BIGINT AS doors, CASE WHEN l > 0 THEN l ELSE ol END::BIGINT AS leaves FROM s")
def a13_heading_totals(spark, sf):
    o = frame(spark, sf, "openings")
    return quantity.heading_totals(o.selectExpr("concat(hw_set, '.', opening_id) AS set_id", "hw_set AS generic_id", "IF(opening_id % 40 < 20, 1, 0) AS heading_doors", "IF(opening_id % 40 < 20, 2, 0) AS heading_leaves"), o)


@query("SELECT upper(trim(hw_set)) AS hw_set, count(*) AS doors, sum(CASE WHEN opening_id % 4 = 1 THEN 2 ELSE 1 END)::BIGINT AS leaves FROM openings GROUP BY 1")
def a14_leaves_of_types(spark, sf):
    return quantity.leaves_of_types(frame(spark, sf, "openings").withColumn("door_type", F.expr("CASE opening_id % 4 WHEN 0 THEN 'HM' WHEN 1 THEN 'HM PR' WHEN 2 THEN 'PRIMED' ELSE '' END")), "hw_set")


@query("WITH s AS (SELECT DISTINCT upper(substr(hw_set, 1, 3)) AS set_id FROM openings) SELECT set_id, (SELECT count(*) FROM openings o WHERE starts_with(upper(hw_set), set_id) OR starts_with('DH' || o.opening_id % 7, set_id)) AS doors FROM s")
def j15_cross_field_counts(spark, sf):
    o = frame(spark, sf, "openings")
    return quantity.counted_across(o.select(F.upper(F.substring("hw_set", 1, 3)).alias("set_id")).distinct(), o.selectExpr("hw_set", "concat('DH', opening_id % 7) AS hw_heading"))


HEALTH = "d AS (SELECT project_id AS job, hw_set, upper(hw_set) AS id FROM openings), s AS (SELECT project_id AS job, hw_set AS set_id, sum(opening_id % 3) AS items, min(opening_id) AS pos FROM openings WHERE opening_id % 5 > 0 GROUP BY 1, 2)"


@query(f"WITH {HEALTH}, a AS (SELECT job, count(*) AS doors, count(*) FILTER (trim(hw_set) <> '') AS assigned FROM d GROUP BY 1), b AS (SELECT job, sum(items)::BIGINT AS items, count(*) FILTER (items = 0) AS empty_sets, count(*) FILTER (items > 0) AS filled_sets, arg_max(set_id, items * 1000000000 - pos) FILTER (items > 0) AS best FROM s GROUP BY 1), m AS (SELECT job, count(*) AS missing_sets FROM (SELECT DISTINCT job, id FROM d) x WHERE (job, id) NOT IN (SELECT (job, upper(set_id)) FROM s) GROUP BY 1) SELECT job, doors, assigned, coalesce(items, 0)::BIGINT AS items, coalesce(empty_sets, 0)::BIGINT AS empty_sets, coalesce(filled_sets, 0)::BIGINT AS filled_sets, best, coalesce(missing_sets, 0)::BIGINT AS missing_sets, CASE WHEN coalesce(items, 0) = 0 OR filled_sets = 0 THEN 'critical' WHEN empty_sets > 0 OR missing_sets > 0 THEN 'warning' ELSE 'good' END AS grade FROM a LEFT JOIN b USING (job) LEFT JOIN m USING (job)")
def a17_health(spark, sf):
    o = frame(spark, sf, "openings")
    s = o.where("opening_id % 5 > 0").groupBy(F.col("project_id").alias("job"), F.col("hw_set").alias("set_id")).agg(F.sum(F.col("opening_id") % 3).alias("items"), F.min("opening_id").alias("pos"))
    return scores.health(o.select(F.col("project_id").alias("job"), "hw_set"), s.withColumn("generic_id", F.lit(None).cast("string")))


@query("WITH r AS (SELECT project_id, sum(opening_id % 5) AS items, sum(opening_id % 2) AS e, sum((opening_id % 7 = 0)::INT) AS c, sum((opening_id % 14 = 0)::INT) AS f, count(*) AS n, sum((opening_id % 3 = 0)::INT) AS u FROM openings GROUP BY 1), p AS (SELECT *, 100 - CASE WHEN items > 0 THEN floor(e / items * 30 + 0.5) ELSE 0 END - least(20, CASE WHEN items > 0 THEN floor(c / items * 20 + 0.5) ELSE 0 END) - least(10, CASE WHEN c > 0 THEN floor(f / c * 10 + 0.5) ELSE 0 END) - floor(u / n * 10 + 0.5) - floor(u / n * 15 + 0.5) AS s FROM r), q AS (SELECT *, greatest(0, least(100, CASE WHEN c = 0 THEN least(100, s + 5) ELSE s END))::BIGINT AS score FROM p) SELECT project_id, score, CASE WHEN (c > 0 AND 2 * f > c) OR (items > 0 AND 5 * c > items) THEN 'low' WHEN score >= 80 THEN 'high' WHEN score >= 50 THEN 'medium' ELSE 'low' END AS overall FROM q")
def a19_confidence(spark, sf):
    of = lambda e: F.sum(F.expr(f"cast({e} as int)"))
    r = frame(spark, sf, "openings").groupBy("project_id").agg(of("opening_id % 5").alias("items"), of("opening_id % 2").alias("empty_fields"), of("opening_id % 7 = 0").alias("corrections"), of("opening_id % 14 = 0").alias("fuzzy"), F.count("*").alias("sets"), of("opening_id % 3 = 0").alias("statistical"), F.lit(0).alias("empty_sets"), F.count("*").alias("doors"), of("opening_id % 3 = 0").alias("unmatched"))
    return scores.confidence(r).select("project_id", "score", "overall")


@query("WITH d AS (SELECT project_id AS job, opening_id AS pos, hw_set, leaf_count, opening_id % 9 AS items FROM openings), b AS (SELECT *, row_number() OVER (PARTITION BY job, hw_set ORDER BY leaf_count > 1 DESC, items DESC, pos) AS k, min(pos) OVER (PARTITION BY job, hw_set) AS seen FROM d), p AS (SELECT *, CASE WHEN k = 1 THEN 0 WHEN leaf_count > 1 THEN 1 ELSE 2 END AS phase FROM b) SELECT job, pos, row_number() OVER (PARTITION BY job ORDER BY phase, CASE WHEN phase = 0 THEN seen END, CASE WHEN phase = 2 THEN -items END, pos) AS turn FROM p QUALIFY turn <= 4")
def w09_samples(spark, sf):
    d = frame(spark, sf, "openings").selectExpr("project_id AS job", "opening_id AS pos", "hw_set", "leaf_count", "opening_id % 9 AS items")
    return scores.sample(d, 4).select("job", "pos", F.col("turn").cast("long").alias("turn"))


@query("WITH c AS (SELECT upper(trim(hw_set)) AS k, count(*) AS n FROM openings GROUP BY 1), s AS (SELECT 'DH' || i AS set_id, 'dh' || (i % 20) AS generic_id, 25 AS door_count FROM range(0, 60) r(i)) SELECT set_id, generic_id, door_count, coalesce(a.n, b.n, 0) AS emitted, greatest(door_count - coalesce(a.n, b.n, 0), 0) AS missing FROM s LEFT JOIN c a ON a.k = upper(set_id) LEFT JOIN c b ON b.k = upper(generic_id)")
def a26_opening_audit(spark, sf):
    s = spark.range(60).selectExpr("concat('DH', id) AS set_id", "concat('dh', id % 20) AS generic_id", "25 AS door_count")
    return scores.audit(frame(spark, sf, "openings"), s)


@query("SELECT opening_id, CASE min(CASE item_id % 5 WHEN 0 THEN 1 WHEN 1 THEN 2 WHEN 2 THEN 3 WHEN 3 THEN 4 END) WHEN 1 THEN 'unverified' WHEN 2 THEN 'low' WHEN 3 THEN 'medium' WHEN 4 THEN 'high' ELSE 'unverified' END AS level FROM items GROUP BY 1")
def a20_worst_levels(spark, sf):
    i = frame(spark, sf, "items").withColumn("level", F.expr("CASE item_id % 5 WHEN 0 THEN 'unverified' WHEN 1 THEN 'low' WHEN 2 THEN 'medium' WHEN 3 THEN 'high' END"))
    return i.groupBy("opening_id").agg(rollups.worst(F.col("level"), ["unverified", "low", "medium", "high"], "unverified").alias("level"))


@query("WITH r AS (SELECT i.opening_id AS block, i.sort_order AS a, i.sort_order % 3 AS b FROM items i) SELECT block, a, b FROM r QUALIFY row_number() OVER (PARTITION BY block, b ORDER BY a) = 1")
def j18_assigned_once(spark, sf):
    r = frame(spark, sf, "items").selectExpr("opening_id AS block", "sort_order AS a", "sort_order % 3 AS b").distinct()
    return linkage.assign_once(r, "block", "a", "b")


@query("WITH a AS (SELECT opening_id AS k, hand AS h FROM openings WHERE opening_id % 10 < 8), b AS (SELECT opening_id AS k, CASE WHEN opening_id % 3 = 0 THEN lower(hand) ELSE 'X' END AS h FROM openings WHERE opening_id % 10 > 2), j AS (SELECT coalesce(a.h, '') AS x, coalesce(b.h, '') AS y FROM a FULL JOIN b ON a.k = b.k), c AS (SELECT CASE WHEN x = '' AND y = '' THEN 'conflict' WHEN x = '' OR y = '' THEN 'single_source' WHEN lower(x) = lower(y) THEN 'full' ELSE 'conflict' END AS c FROM j) SELECT count(*) AS fields, count(*) FILTER (c = 'full') AS full, count(*) FILTER (c = 'single_source') AS single, count(*) FILTER (c = 'conflict') AS conflicts, floor(avg(CASE c WHEN 'full' THEN 100 WHEN 'single_source' THEN 50 ELSE 25 END) + 0.5)::BIGINT AS score FROM c")
def a21_reconciliation_summary(spark, sf):
    o = frame(spark, sf, "openings")
    b = o.where("opening_id % 10 > 2").selectExpr("opening_id", "CASE WHEN opening_id % 3 = 0 THEN lower(hand) ELSE 'X' END AS hand")
    return merge.reconciliation_summary(merge.reconcile(o.where("opening_id % 10 < 8").select("opening_id", "hand"), b, "opening_id", {"hand": True}), ["hand"])


@query("SELECT opening_id, CASE WHEN s IS NULL THEN 'unverified' WHEN s >= 85 THEN 'high' WHEN s >= 60 THEN 'medium' ELSE 'low' END AS level FROM (SELECT opening_id, CASE WHEN opening_id % 11 = 0 THEN NULL ELSE opening_id % 101 END AS s FROM openings)")
def f23_levels(spark, sf):
    return frame(spark, sf, "openings").select("opening_id", T.level(F.expr("IF(opening_id % 11 = 0, NULL, opening_id % 101 / 100D)")).alias("level"))
