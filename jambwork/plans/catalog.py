"""All queries of the library by name, and DuckDB SQL for the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jambwork.functions import text as T
from jambwork.operators import linkage, merge, pages, quantity, rollups, sets
from jambwork.sources import sinks
from jambwork.sources.tables import frame, frames_sql, table
from jambwork.streaming import progress

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
AS_OF = "2024-01-30 12:00:00"


def query(sql: str | None = None):
    """Registers a query under its function's name; the SQL can use the frames."""

    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            head = next((x for x in ("WITH RECURSIVE ", "WITH ") if sql.strip().startswith(x)), "")
            ORACLE_SQL[f.__name__] = f"{head or 'WITH '}{frames_sql()}{',' if head else ''} {sql.strip().removeprefix(head)}"
        return f

    return keep


PROGRESS = "p AS (SELECT opening_id, count(*) AS items, count(*) FILTER (checked) AS checked, count(*) FILTER (qa_qc OR installed) AS completed FROM items GROUP BY 1)"
PCT = "CASE WHEN {t} = 0 THEN 0 ELSE floor(100 * {c}::DOUBLE / {t} + 0.5) END::BIGINT"


@query("SELECT s AS stage, count(i.stage2) AS n FROM (VALUES ('ordered'), ('received'), ('pre_install'), ('installed'), ('qa_qc')) k(s) LEFT JOIN (SELECT coalesce(stage, 'ordered') AS stage2 FROM items) i ON s = stage2 GROUP BY s")
def a01_stage_counts(spark, sf):
    return rollups.stage_counts(frame(spark, sf, "items"))


@query(f"WITH {PROGRESS} SELECT * FROM p")
def a02_opening_progress(spark, sf):
    return rollups.opening_progress(frame(spark, sf, "items"))


def _group_sql(by: str, source: str) -> str:
    return f"WITH {PROGRESS}, g AS (SELECT coalesce({by}::VARCHAR, 'Unassigned') AS {by}, sum(coalesce(items, 0))::BIGINT AS total, sum(coalesce(completed, 0))::BIGINT AS completed FROM {source} o LEFT JOIN p USING (opening_id) GROUP BY 1) SELECT {by}, total, completed, total - completed AS remaining, {PCT.format(t='total', c='completed')} AS pct FROM g"


@query(_group_sql("floor_number", "(SELECT * FROM openings WHERE is_active)"))
def a03_floor_rollup(spark, sf):
    return rollups.group_rollup(frame(spark, sf, "openings").where("is_active"), frame(spark, sf, "items"), "floor_number")


@query(_group_sql("zone", "(SELECT opening_id, r_name AS zone FROM openings JOIN projects USING (project_id) JOIN nation ON nation_id = n_nationkey JOIN region ON n_regionkey = r_regionkey)"))
def a04_zone_rollup(spark, sf):
    zones = table(spark, sf, "nation").join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_nationkey").alias("nation_id"), F.col("r_name").alias("zone"))
    own = frame(spark, sf, "projects").join(zones, "nation_id").select("project_id", "zone")
    return rollups.group_rollup(frame(spark, sf, "openings").join(own, "project_id").select("opening_id", "zone"), frame(spark, sf, "items"), "zone")


@query(f"WITH c AS (SELECT unnest(generate_series(DATE '{AS_OF[:10]}' - 29, DATE '{AS_OF[:10]}', INTERVAL 1 DAY))::DATE AS day), n AS (SELECT acted_at::DATE AS day, count(*) AS n FROM activity GROUP BY 1) SELECT day::VARCHAR AS day, coalesce(n, 0)::BIGINT AS n, sum(coalesce(n, 0)) OVER (ORDER BY day)::BIGINT AS cumulative FROM c LEFT JOIN n USING (day)")
def a05_daily_timeline(spark, sf):
    return rollups.timeline(frame(spark, sf, "activity"), AS_OF[:10]).withColumn("day", F.col("day").cast("string"))


PORTFOLIO = f"{PROGRESS}, s AS (SELECT project_id, count(*) AS openings, count(*) FILTER (coalesce(items, 0) > 0 AND checked >= items) AS complete, sum(coalesce(items, 0))::BIGINT AS items, sum(coalesce(checked, 0))::BIGINT AS checked FROM openings LEFT JOIN p USING (opening_id) WHERE is_active GROUP BY 1), f AS (SELECT project_id, project, coalesce(openings, 0)::BIGINT AS openings, coalesce(complete, 0)::BIGINT AS complete, coalesce(items, 0)::BIGINT AS items, coalesce(checked, 0)::BIGINT AS checked FROM projects LEFT JOIN s USING (project_id))"


@query(f"WITH {PORTFOLIO} SELECT *, openings - complete AS incomplete, {PCT.format(t='items', c='checked')} AS pct FROM f")
def a06_portfolio_stats(spark, sf):
    return rollups.portfolio(*(frame(spark, sf, x) for x in ("projects", "openings", "items")))


@query(f"WITH {PORTFOLIO} SELECT count(*) AS projects, sum(openings)::BIGINT AS openings, sum(complete)::BIGINT AS complete, sum(items)::BIGINT AS items, sum(checked)::BIGINT AS checked FROM f")
def a06_portfolio_totals(spark, sf):
    return rollups.totals(a06_portfolio_stats(spark, sf))


@query("WITH o AS (SELECT opening_id, count(*) FILTER (checked) AS checked, count(*) FILTER (installed) AS installed, count(*) FILTER (qa_qc) AS qa_qc, max((leaf_side = 'active')::INT) AS active, max((leaf_side = 'inactive')::INT) AS inactive, max((leaf_side = 'shared')::INT) AS shared FROM items GROUP BY 1) SELECT project_id, sum(checked)::BIGINT AS checked, sum(installed)::BIGINT AS installed, sum(qa_qc)::BIGINT AS qa_qc, sum(active)::BIGINT AS active, sum(inactive)::BIGINT AS inactive, sum(shared)::BIGINT AS shared FROM openings JOIN o USING (opening_id) GROUP BY 1")
def a07_project_summary(spark, sf):
    return rollups.project_summary(frame(spark, sf, "openings"), frame(spark, sf, "items"))


@query("SELECT count(*) FILTER (action = 'click') AS click, count(*) FILTER (action = 'view') AS view, count(*) FILTER (action = 'nothing') AS nothing FROM activity")
def a10_tag_counts(spark, sf):
    return rollups.tag_counts(frame(spark, sf, "activity").select(F.array("action", "details").alias("tags")), "tags", ["click", "view", "nothing"])


@query("SELECT upper(hw_set) AS hw_set, count(*) AS doors, sum(coalesce(leaf_count, 1))::BIGINT AS leaves FROM openings GROUP BY 1")
def a12_set_counts(spark, sf):
    return rollups.set_counts(frame(spark, sf, "openings"))


@query("WITH v AS (SELECT lower(manufacturer) AS manufacturer, rtrim(split_part(lower(model), ' ', 1), '-,;:') AS series, lower(model) AS variant, count(*) AS n, min(item_id) AS first FROM products GROUP BY ALL), k AS (SELECT *, row_number() OVER (PARTITION BY manufacturer, series ORDER BY n DESC, first) AS rn FROM v) SELECT manufacturer, series, sum(n)::BIGINT AS total, count(*) AS variants, min(variant) FILTER (rn = 1) AS canonical FROM k GROUP BY 1, 2")
def a15_product_families(spark, sf):
    return rollups.families(frame(spark, sf, "products"))


@query("SELECT opening_id, string_agg(coalesce(name, '') || ':' || coalesce(qty::VARCHAR, '1'), '|' ORDER BY coalesce(name, '') || ':' || coalesce(qty::VARCHAR, '1')) AS signature, count(*) AS items FROM items JOIN products USING (item_id) GROUP BY 1")
def a22_signatures(spark, sf):
    return rollups.signatures(frame(spark, sf, "items"), frame(spark, sf, "products"))


@query("WITH c AS (SELECT actor_id, action, count(*) AS n, min(event_id) AS first FROM activity GROUP BY 1, 2) SELECT actor_id, action, n FROM c QUALIFY row_number() OVER (PARTITION BY actor_id ORDER BY n DESC, first) = 1")
def a23_most_common(spark, sf):
    return rollups.most_common(frame(spark, sf, "activity"), ["actor_id"], "action", "event_id")


DOORS = "CASE opening_id % 9 WHEN 0 THEN 'ST-' || opening_id WHEN 1 THEN opening_id || '-' || (opening_id % 7) || 'A' ELSE opening_id || 'B' END"


@query(f"WITH d AS (SELECT opening_id, {DOORS} AS door_number FROM openings), s AS (SELECT *, translate(regexp_replace(regexp_replace(door_number, '[A-Za-z]+', chr(1), 'g'), '[0-9]+', chr(2), 'g'), chr(1) || chr(2), 'LD') AS shape FROM d), c AS (SELECT shape, count(*) AS n, sum(count(*)) OVER () AS total FROM s GROUP BY 1), k AS (SELECT shape, n >= 3 AND n >= 0.15 * total AS dominant, bool_or(n >= 3 AND n >= 0.15 * total) OVER () AS any_one, total FROM c) SELECT opening_id, door_number, shape, (dominant OR NOT any_one OR total < 5) AS confirmed FROM s JOIN k USING (shape)")
def a25_shape_consensus(spark, sf):
    return rollups.shape_consensus(frame(spark, sf, "openings").selectExpr("opening_id", f"{DOORS} AS door_number"))


@query(f"WITH r AS (SELECT actor_id, count(*) AS n, min(acted_at) AS oldest FROM activity WHERE acted_at > TIMESTAMP '{AS_OF}' - INTERVAL 24 HOUR AND acted_at <= TIMESTAMP '{AS_OF}' GROUP BY 1) SELECT actor_id, n, n < 3 AS allowed, CASE WHEN n < 3 THEN 0 ELSE greatest(ceil((epoch_us(oldest + INTERVAL 24 HOUR) - epoch_us(TIMESTAMP '{AS_OF}')) / 1000000.0), 0) END::BIGINT AS retry_after FROM r")
def a28_rate_limit(spark, sf):
    return rollups.rate_limit(frame(spark, sf, "activity"), AS_OF, 3, 24 * 60)


@query("SELECT DISTINCT project_id, opening_id, n_name AS nation FROM openings JOIN items USING (opening_id) JOIN supplier ON s_suppkey = supplier_id JOIN nation ON s_nationkey = n_nationkey WHERE is_active AND damaged")
def j01_blocked(spark, sf):
    suppliers = table(spark, sf, "supplier").join(table(spark, sf, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("s_suppkey").alias("supplier_id"), F.col("n_name").alias("nation"))
    return linkage.blocked(frame(spark, sf, "openings"), frame(spark, sf, "items"), suppliers)


@query("WITH k AS (SELECT opening_id, string_agg(item_id || 'x' || qty, ',' ORDER BY item_id, qty) AS s, count(*) AS n FROM items GROUP BY 1) SELECT opening_id, door_number, coalesce(s, '') AS children, coalesce(n, 0)::BIGINT AS n FROM openings LEFT JOIN k USING (opening_id)")
def j03_nested_children(spark, sf):
    rows = linkage.nested(frame(spark, sf, "openings").select("opening_id", "door_number"), frame(spark, sf, "items"), "opening_id", "children", "item_id", "qty")
    return rows.select("opening_id", "door_number", F.array_join(F.transform("children", lambda x: F.concat_ws("x", x["item_id"].cast("string"), x["qty"].cast("string"))), ",").alias("children"), F.size("children").cast("long").alias("n"))


@query("SELECT opening_id, door_number FROM openings WHERE opening_id NOT IN (SELECT opening_id FROM items)")
def j05_orphans(spark, sf):
    return linkage.orphans(frame(spark, sf, "openings").select("opening_id", "door_number"), frame(spark, sf, "items"), "opening_id")


@query("SELECT opening_id, project_id, status FROM openings WHERE project_id IN (SELECT project_id FROM projects WHERE segment = 'BUILDING')")
def j07_secured_rows(spark, sf):
    return linkage.secured(frame(spark, sf, "openings").select("opening_id", "project_id", "status"), frame(spark, sf, "projects").where("segment = 'BUILDING'"), "project_id")


SIDES = ("opening_id % 10 < 8", "opening_id % 10 > 2")
LEFT = ["CASE WHEN opening_id % 4 = 1 THEN '' ELSE location END AS location", "CASE WHEN opening_id % 8 = 1 THEN '' ELSE hand END AS hand", "fire_rating", "CASE WHEN opening_id % 8 = 1 THEN ' ' ELSE hw_set END AS hw_set"]


@query(f"WITH a AS (SELECT door_number, {', '.join(LEFT)} FROM openings WHERE {SIDES[0]}), b AS (SELECT door_number, location, hand, fire_rating, hw_set FROM openings WHERE {SIDES[1]}), "
       + "j AS (SELECT coalesce(a.door_number, b.door_number) AS door_number, CASE WHEN a.door_number IS NULL THEN 'right' WHEN b.door_number IS NULL THEN 'left' ELSE 'both' END AS origin, "
       + "a.door_number IS NOT NULL AND (" + " OR ".join(f"(nullif(trim(a.{f}), '') IS NULL AND nullif(trim(b.{f}), '') IS NOT NULL)" for f in ("location", "hand", "fire_rating", "hw_set")) + ") AS enriched, "
       + ", ".join(f"coalesce(nullif(trim(a.{f}), ''), nullif(trim(b.{f}), ''), '{'NR' if f == 'fire_rating' else ''}') AS {f}" for f in ("location", "hand", "fire_rating", "hw_set"))
       + " FROM a FULL JOIN b ON a.door_number = b.door_number) SELECT * FROM j WHERE NOT (origin = 'left' AND location = '' AND hand = '' AND hw_set = '')")
def j11_coalescing_full_join(spark, sf):
    o = frame(spark, sf, "openings")
    a = o.where(SIDES[0]).selectExpr("door_number", *LEFT)
    return linkage.coalescing_full_join(a, o.where(SIDES[1]), "door_number", ["location", "hand", "fire_rating", "hw_set"], ["location", "hand", "hw_set"])


@query("WITH a AS (SELECT hw_set AS key, max(opening_id) AS value FROM openings WHERE status = 'P' GROUP BY 1), b AS (SELECT hand AS key, min(opening_id) AS value FROM openings WHERE hand <> '' GROUP BY 1) SELECT opening_id, coalesce(a.value, b.value) AS value, CASE WHEN a.value IS NOT NULL THEN 'first' WHEN b.value IS NOT NULL THEN 'second' ELSE 'none' END AS via FROM openings o LEFT JOIN a ON a.key = o.hw_set LEFT JOIN b ON b.key = o.hand")
def j12_priority_lookup(spark, sf):
    o = frame(spark, sf, "openings")
    first = o.where("status = 'P'").groupBy(F.col("hw_set").alias("key")).agg(F.max("opening_id").alias("value"))
    second = o.where("hand <> ''").groupBy(F.col("hand").alias("key")).agg(F.min("opening_id").alias("value"))
    return linkage.priority_lookup(o.select("opening_id", "hw_set", "hand"), first, second, F.col("hw_set"), F.col("hand"), "value").select("opening_id", "value", "via")


NAMES = "CASE item_id % 3 WHEN 0 THEN name || ':WI' WHEN 1 THEN name || ' left' ELSE substr(name, 1, length(name) - 1) END"


@query(f"""WITH k AS (SELECT DISTINCT {NAMES} AS key FROM products), n AS (SELECT name, count(*) AS value FROM products WHERE size > 25 GROUP BY 1),
b AS (SELECT key, regexp_replace(key, '[:\\-](WI|EX|OPP)$', '') AS bare FROM k WHERE length(key) > 0),
m AS (SELECT key, 1 AS tier, name, value FROM b JOIN n ON key = name UNION ALL SELECT key, 2, name, value FROM b JOIN n ON bare = name UNION ALL SELECT key, 3, name, value FROM b JOIN n ON starts_with(bare, name) OR starts_with(name, bare)),
r AS (SELECT * FROM m QUALIFY row_number() OVER (PARTITION BY key ORDER BY tier, length(name) DESC, name) = 1)
SELECT b.key, tier, name, value FROM b LEFT JOIN r USING (key)""")
def j14_tiered_lookup(spark, sf):
    p = frame(spark, sf, "products")
    return linkage.tiered_lookup(p.selectExpr(f"{NAMES} AS key"), p.where("size > 25").groupBy("name").agg(F.count("*").alias("value")))


PLAIN = r'''trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower({n}), '\s*\([^)]*\)\s*', ' ', 'g'), '[,\s]+[0-9][0-9\-/]*"?(\s*x\s*[0-9][0-9\-/]*"?)*\s*$', ''), '(\s+[a-z]*[0-9][a-z0-9]*)+\s*$', ''), '[,."''\s]+$', ''), '\s+', ' ', 'g'))'''
TOKENS = "list_distinct(list_filter(regexp_split_to_array(lower({n}), '\\s+'), lambda x: x <> ''))"
KEYWORD = "CASE " + " ".join(f"WHEN contains(lower({{n}}), '{k}') THEN '{k}'" for k in ("hinge", "closer", "lockset", "exit", "stop", "seal", "threshold", "kick", "flush", "coordinator", "bolt")) + " END"


@query(f"WITH w AS (SELECT manufacturer, item_id AS a_id, CASE item_id % 3 WHEN 0 THEN upper(name) WHEN 1 THEN name || ' (left)' ELSE name END AS a FROM products), o AS (SELECT DISTINCT manufacturer, name AS b FROM products), p AS (SELECT DISTINCT manufacturer, a, b, {TOKENS.format(n='a')} AS ta, {TOKENS.format(n='b')} AS tb, coalesce({KEYWORD.format(n='a')} = {KEYWORD.format(n='b')}, true) AS alike FROM (SELECT DISTINCT manufacturer, a FROM w) JOIN o USING (manufacturer)), j AS (SELECT *, CASE WHEN len(ta) = 0 AND len(tb) = 0 THEN 1.0 ELSE len(list_intersect(ta, tb))::DOUBLE / len(list_distinct(list_concat(ta, tb))) END AS score FROM p), t AS (SELECT manufacturer, a, b, round(score, 6) AS score, CASE WHEN a = b THEN 1 WHEN lower(a) = lower(b) THEN 2 WHEN alike AND {PLAIN.format(n='a')} = {PLAIN.format(n='b')} THEN 3 WHEN alike AND length(a) >= 8 AND (contains(lower(a), lower(b)) OR contains(lower(b), lower(a))) AND 2 * least(length(a), length(b)) >= greatest(length(a), length(b)) THEN 4 WHEN alike AND score > 0.5 THEN 5 END AS tier FROM j), r AS (SELECT *, count(*) OVER (PARTITION BY manufacturer, a, tier, score) AS n, row_number() OVER (PARTITION BY manufacturer, a ORDER BY tier, score DESC, b) AS k FROM t WHERE tier IS NOT NULL) SELECT w.manufacturer, w.a, w.a_id, r.tier, r.score, r.b FROM w LEFT JOIN r ON r.manufacturer = w.manufacturer AND r.a = w.a AND r.k = 1 AND (r.tier <= 2 OR r.n = 1)")
def j16_match_names(spark, sf):
    p = frame(spark, sf, "products")
    wanted = p.selectExpr("manufacturer", "item_id AS a_id", "CASE item_id % 3 WHEN 0 THEN upper(name) WHEN 1 THEN concat(name, ' (left)') ELSE name END AS a")
    return linkage.match_names(wanted, p.selectExpr("manufacturer", "name AS b").distinct(), "manufacturer")


@query("WITH n AS (SELECT DISTINCT s_nationkey AS block, s_name AS name FROM supplier) SELECT x.block, x.name AS a, y.name AS b FROM n x JOIN n y ON x.block = y.block AND x.name < y.name WHERE levenshtein(x.name, y.name) = 1")
def j24_typo_pairs(spark, sf):
    return linkage.typo_pairs(table(spark, sf, "supplier").selectExpr("s_nationkey AS block", "s_name AS name"), "block")


@query("WITH n AS (SELECT DISTINCT s_name AS name FROM supplier) SELECT 'DH' AS block, x.name AS a, y.name AS b FROM n x JOIN n y ON x.name < y.name WHERE levenshtein(x.name, y.name) = 1")
def j24_typo_names(spark, sf):
    return linkage.typo_pairs(table(spark, sf, "supplier").selectExpr("'DH' AS block", "s_name AS name"), "block")


@query("WITH k AS (SELECT manufacturer, model FROM products GROUP BY 1, 2 HAVING count(*) > 2), n AS (SELECT DISTINCT category, lower(manufacturer) AS manufacturer, lower(model) AS name FROM products p WHERE NOT EXISTS (SELECT 1 FROM k WHERE lower(k.manufacturer) = lower(p.manufacturer) AND lower(k.model) = lower(p.model))) SELECT category, manufacturer, x.name AS a, y.name AS b FROM n x JOIN n y USING (category, manufacturer) WHERE x.name < y.name AND levenshtein(x.name, y.name) = 1")
def j24_typo_products(spark, sf):
    p = frame(spark, sf, "products").select("category", "manufacturer", F.col("model").alias("name"))
    return linkage.typo_candidates(p, p.groupBy("manufacturer", "name").count().where("count > 2"))


@query("SELECT project_id, opening_id, created_at FROM openings QUALIFY row_number() OVER (PARTITION BY project_id ORDER BY created_at NULLS LAST, opening_id) = 1")
def w02_first_per_group(spark, sf):
    return sets.first_per_group(frame(spark, sf, "openings").select("project_id", "opening_id", "created_at"), ["project_id"], *sets.nulls_last(F.col("created_at")), F.col("opening_id"))


@query("WITH g AS (SELECT project_id, opening_id, opening_id - lag(opening_id) OVER w AS b, lead(opening_id) OVER w - opening_id AS a FROM openings WINDOW w AS (PARTITION BY project_id ORDER BY opening_id)) SELECT project_id, opening_id FROM g WHERE (a IS NOT NULL OR b IS NOT NULL) AND coalesce(a, 1000000) > 900 AND coalesce(b, 1000000) > 900")
def w03_gap_outliers(spark, sf):
    return sets.gap_outliers(frame(spark, sf, "openings").select("project_id", "opening_id"), ["project_id"], "opening_id", 900)


@query("WITH g AS (SELECT *, acted_at > lag(acted_at) OVER w + INTERVAL 600 MINUTE AS gap FROM activity WINDOW w AS (PARTITION BY actor_id ORDER BY acted_at, event_id)), s AS (SELECT *, 1 + sum(coalesce(gap, false)::INT) OVER (PARTITION BY actor_id ORDER BY acted_at, event_id) AS segment FROM g) SELECT actor_id, segment::BIGINT AS segment, count(*) AS n, min(acted_at) AS started, max(acted_at) AS ended FROM s GROUP BY 1, 2")
def w04_sessions(spark, sf):
    return sets.sessions(frame(spark, sf, "activity"), "actor_id", "acted_at", 600)


@query("WITH g AS (SELECT *, sum(CASE WHEN action <> 'view' THEN 1 ELSE 0 END) OVER (PARTITION BY actor_id ORDER BY event_id) AS k FROM activity), h AS (SELECT *, k - min(k) OVER (PARTITION BY actor_id) AS kk FROM g) SELECT actor_id, min(event_id) AS event_id, string_agg(action, ' ' ORDER BY event_id) AS action FROM h GROUP BY actor_id, kk")
def w05_merge_fragments(spark, sf):
    return sets.merge_fragments(frame(spark, sf, "activity").select("actor_id", "event_id", "action"), ["actor_id"], "event_id", F.col("action") == "view", "action").drop("segment")


@query("SELECT opening_id, created_at FROM openings ORDER BY created_at DESC NULLS LAST, opening_id OFFSET 50 LIMIT 25")
def o03_page(spark, sf):
    return sets.page(frame(spark, sf, "openings").select("opening_id", "created_at"), 3, 25, F.desc_nulls_last("created_at"), F.asc("opening_id"))


@query("WITH u AS (SELECT text, doc_id, source, 0 AS strategy FROM documents WHERE doc_id % 3 = 0 UNION ALL SELECT text, doc_id, source, 1 FROM documents WHERE doc_id % 3 <> 0) SELECT doc_id, source, strategy FROM u QUALIFY row_number() OVER (PARTITION BY md5(text) ORDER BY strategy, doc_id) = 1")
def u03_union_by_priority(spark, sf):
    d = table(spark, sf, "documents").select(F.md5(F.col("text").cast("binary")).alias("key"), "doc_id", "source")
    return sets.union_by_priority([d.where("doc_id % 3 = 0"), d.where("doc_id % 3 <> 0")], ["key"], "doc_id").select("doc_id", "source", "strategy")


@query("WITH k AS (SELECT lower(name) AS key, item_id, CASE WHEN item_id % 3 = 0 THEN '' ELSE manufacturer END AS manufacturer, CASE WHEN item_id % 5 = 0 THEN ' ' ELSE model END AS model FROM products), s AS (SELECT *, (trim(manufacturer) <> '')::INT + (trim(model) <> '')::INT AS score FROM k) SELECT key, item_id, score, min(item_id) OVER (PARTITION BY key) AS first FROM s QUALIFY row_number() OVER (PARTITION BY key ORDER BY score DESC, item_id) = 1")
def u05_most_complete(spark, sf):
    p = frame(spark, sf, "products").selectExpr("name", "item_id", "CASE WHEN item_id % 3 = 0 THEN '' ELSE manufacturer END AS manufacturer", "CASE WHEN item_id % 5 = 0 THEN ' ' ELSE model END AS model")
    return sets.most_complete(p, F.lower("name"), ["manufacturer", "model"], "item_id").select("key", "item_id", "score", "first")


@query("WITH r AS (SELECT actor_id, coalesce(list_sort(list(DISTINCT action) FILTER (event_id % 2 = 0)), []) AS a, coalesce(list_sort(list(DISTINCT action) FILTER (event_id % 3 = 0)), []) AS b FROM activity GROUP BY 1) SELECT actor_id, array_to_string(list_sort(list_distinct(list_concat(a, b))), ', ') AS value, array_to_string(list_sort(list_filter(a, lambda x: NOT list_contains(b, x))), ', ') AS only_a, array_to_string(list_sort(list_filter(b, lambda x: NOT list_contains(a, x))), ', ') AS only_b, CASE WHEN a = b AND len(a) > 0 THEN 'full' WHEN len(a) = 0 OR len(b) = 0 THEN 'single_source' ELSE 'conflict' END AS confidence FROM r")
def u02_two_sources(spark, sf):
    rows = frame(spark, sf, "activity").groupBy("actor_id").agg(F.collect_set(F.when(F.col("event_id") % 2 == 0, F.col("action"))).alias("a"), F.collect_set(F.when(F.col("event_id") % 3 == 0, F.col("action"))).alias("b"))
    return sets.two_sources(rows, "a", "b").drop("a", "b")


SIGNED = "sg AS (SELECT opening_id, string_agg(item_id || ':' || qty, '|' ORDER BY item_id || ':' || qty) AS signature FROM items GROUP BY 1)"


@query(f"WITH {SIGNED}, a AS (SELECT door_number, location, is_active, signature AS s FROM openings LEFT JOIN sg USING (opening_id) WHERE {SIDES[0]}), b AS (SELECT door_number, upper(hand) AS location, CASE WHEN opening_id % 7 = 0 THEN signature || '*' ELSE signature END AS s FROM openings LEFT JOIN sg USING (opening_id) WHERE {SIDES[1]}), j AS (SELECT coalesce(a.door_number, b.door_number) AS door_number, CASE WHEN a.door_number IS NULL THEN 'added' WHEN b.door_number IS NULL THEN 'removed' WHEN a.s IS NOT DISTINCT FROM b.s THEN 'unchanged' ELSE 'updated' END AS action, CASE WHEN b.door_number IS NOT NULL THEN b.location ELSE a.location END AS location, b.door_number IS NOT NULL AS is_active, a.s AS old, b.s AS new FROM a FULL JOIN b ON a.door_number = b.door_number) SELECT door_number, action, location, is_active, CASE WHEN action IN ('added', 'updated') THEN new ELSE old END AS signature FROM j")
def m01_promote(spark, sf):
    o, i = frame(spark, sf, "openings"), frame(spark, sf, "items")
    sign = i.groupBy("opening_id").agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws(":", F.col("item_id").cast("string"), F.col("qty").cast("string")))), "|").alias("signature"))
    rows = o.join(sign, "opening_id", "left")
    old, new = rows.where(SIDES[0]), rows.where(SIDES[1]).withColumn("signature", F.expr("CASE WHEN opening_id % 7 = 0 THEN concat(signature, '*') ELSE signature END"))
    return merge.promote(old.select("door_number", "location", "is_active"), new.select("door_number", F.upper("hand").alias("location")), old.select("door_number", "signature"), new.select("door_number", "signature"))


@query(f"WITH a AS (SELECT opening_id AS key, lower(trim(location)) AS location, lower(hand) AS hand, lower(fire_rating) AS fire_rating FROM openings WHERE {SIDES[0]}), b AS (SELECT opening_id AS key, lower(trim(location)) AS location, CASE WHEN opening_id % 7 = 0 THEN 'rhra' ELSE lower(hand) END AS hand, CASE WHEN opening_id % 5 = 0 THEN 'n/a' ELSE lower(fire_rating) END AS fire_rating FROM openings WHERE {SIDES[1]}), j AS (SELECT ltrim(coalesce(a.key, b.key)::VARCHAR, '0') AS key, a.key AS ka, b.key AS kb, concat_ws(',', CASE WHEN a.hand <> b.hand AND b.hand NOT IN ('', '-', 'n/a', 'null', 'undefined') THEN 'hand' END, CASE WHEN a.fire_rating <> b.fire_rating AND b.fire_rating NOT IN ('', '-', 'n/a', 'null', 'undefined') THEN 'fire_rating' END) AS fields FROM a FULL JOIN b ON a.key = b.key), s AS (SELECT key, fields, CASE WHEN kb IS NULL THEN 'removed' WHEN ka IS NULL THEN 'added' WHEN fields = '' THEN 'matched' ELSE 'changed' END AS state FROM j) SELECT key, state, CASE WHEN state = 'changed' THEN fields ELSE '' END AS fields FROM s")
def m02_revision_diff(spark, sf):
    o = frame(spark, sf, "openings")
    new = o.where(SIDES[1]).withColumn("hand", F.expr("CASE WHEN opening_id % 7 = 0 THEN 'RHRA' ELSE hand END")).withColumn("fire_rating", F.expr("CASE WHEN opening_id % 5 = 0 THEN 'N/A' ELSE fire_rating END"))
    return merge.changes(o.where(SIDES[0]), new, T.revision_key(F.col("opening_id").cast("string")), ["location", "hand", "fire_rating"])


@query("WITH n AS (SELECT opening_id, count(*) AS divisor FROM items GROUP BY 1), r AS (SELECT i.opening_id, i.item_id, i.qty::BIGINT AS q, n.divisor, CASE i.item_id % 4 WHEN 0 THEN 'needs_division' WHEN 1 THEN 'needs_cap' WHEN 2 THEN 'propagated' ELSE 'parsed' END AS s, i.item_id % 8 = 0 AS h FROM items i JOIN n USING (opening_id)), c AS (SELECT *, s = 'needs_division' AND divisor > 1 AND q >= divisor AS dv, s = 'needs_cap' AND q > 20 AS cp FROM r) SELECT opening_id, item_id, (CASE WHEN dv AND q % divisor = 0 THEN q // divisor WHEN dv AND h THEN ceil(q / divisor) WHEN dv THEN floor(q / divisor + 0.5) WHEN cp THEN 20 ELSE q END)::BIGINT AS qty, CASE WHEN dv AND (q % divisor = 0 OR h) THEN 'divided' WHEN dv THEN 'flagged' WHEN cp THEN 'capped' ELSE s END AS qty_source, CASE WHEN dv OR cp THEN q END AS qty_total FROM c")
def m05_quantities(spark, sf):
    i = frame(spark, sf, "items")
    rows = i.join(i.groupBy("opening_id").agg(F.count("*").alias("divisor")), "opening_id").selectExpr("opening_id", "item_id", "CAST(qty AS BIGINT) AS qty", "divisor", "20 AS most", "item_id % 8 = 0 AS is_hinge", "CASE item_id % 4 WHEN 0 THEN 'needs_division' WHEN 1 THEN 'needs_cap' WHEN 2 THEN 'propagated' ELSE 'parsed' END AS qty_source")
    return quantity.normalise(rows).select("opening_id", "item_id", "qty", "qty_source", "qty_total")


KIND = "CASE item_id % 6 WHEN 0 THEN 'electric_hinge' WHEN 1 THEN 'hinge' WHEN 2 THEN 'leaf' ELSE 'opening' END"


@query(f"WITH e AS (SELECT opening_id, sum(qty) FILTER (item_id % 6 = 0)::BIGINT AS electric FROM items GROUP BY 1), r AS (SELECT i.opening_id, i.item_id, o.leaf_count > 1 AS pair, {KIND} AS kind, CASE WHEN coalesce(qty, 0) = 0 THEN 1 ELSE qty END::BIGINT AS q, coalesce(electric, 0) AS e FROM items i JOIN openings o USING (opening_id) JOIN e USING (opening_id)) SELECT opening_id, item_id, kind, 'active' AS leaf_side, CASE WHEN kind = 'hinge' THEN q - e ELSE q END AS leaf_qty FROM r WHERE pair AND kind <> 'opening' UNION ALL SELECT opening_id, item_id, kind, 'inactive', q FROM r WHERE pair AND kind IN ('hinge', 'leaf') UNION ALL SELECT opening_id, item_id, kind, 'shared', q FROM r WHERE NOT pair OR kind = 'opening'")
def m06_leaf_rows(spark, sf):
    i = frame(spark, sf, "items").selectExpr("opening_id", "item_id", "qty", f"{KIND} AS kind")
    electric = i.where("kind = 'electric_hinge'").groupBy("opening_id").agg(F.sum("qty").alias("electric"))
    rows = i.join(frame(spark, sf, "openings").select("opening_id", "leaf_count"), "opening_id").join(electric, "opening_id", "left")
    return quantity.leaf_rows(rows).select("opening_id", "item_id", "kind", "leaf_side", "leaf_qty")


@query("WITH d AS (SELECT opening_id, 0 AS k, CASE WHEN leaf_count > 1 THEN 'Door (Active Leaf)' ELSE 'Door' END AS name, CASE WHEN leaf_count > 1 THEN 'active' ELSE 'shared' END AS leaf_side FROM openings WHERE door_type <> '' UNION ALL SELECT opening_id, 1, 'Door (Inactive Leaf)', 'inactive' FROM openings WHERE door_type <> '' AND leaf_count > 1 UNION ALL SELECT opening_id, 2, 'Frame', 'shared' FROM openings WHERE frame_type <> '') SELECT opening_id, row_number() OVER (PARTITION BY opening_id ORDER BY k) - 1 AS sort_order, name, leaf_side FROM d")
def m06_structural_rows(spark, sf):
    return quantity.structural_rows(frame(spark, sf, "openings"))


@query("WITH a AS (SELECT opening_id AS k, hand AS h, leaf_count::VARCHAR AS q FROM openings WHERE opening_id % 10 < 8), b AS (SELECT opening_id AS k, CASE WHEN opening_id % 3 = 0 THEN lower(hand) ELSE 'X' END AS h, CASE WHEN opening_id % 4 = 0 THEN '' ELSE '2' END AS q FROM openings WHERE opening_id % 10 > 2), j AS (SELECT coalesce(a.k, b.k) AS opening_id, coalesce(a.h, '') AS ah, coalesce(b.h, '') AS bh, coalesce(a.q, '') AS aq, coalesce(b.q, '') AS bq FROM a FULL JOIN b ON a.k = b.k) SELECT opening_id, CASE WHEN ah = '' AND bh = '' THEN '' WHEN bh = '' THEN ah WHEN ah = '' THEN bh WHEN lower(ah) = lower(bh) THEN ah ELSE bh END AS hand, CASE WHEN ah = '' AND bh = '' THEN 'conflict' WHEN ah = '' OR bh = '' THEN 'single_source' WHEN lower(ah) = lower(bh) THEN 'full' ELSE 'conflict' END AS hand_confidence, CASE WHEN aq = '' AND bq = '' THEN '' WHEN aq = '' THEN bq ELSE aq END AS qty, CASE WHEN aq = '' AND bq = '' THEN 'conflict' WHEN aq = '' OR bq = '' THEN 'single_source' WHEN aq = bq THEN 'full' ELSE 'conflict' END AS qty_confidence FROM j")
def m08_reconcile(spark, sf):
    o = frame(spark, sf, "openings")
    b = o.where("opening_id % 10 > 2").selectExpr("opening_id", "CASE WHEN opening_id % 3 = 0 THEN lower(hand) ELSE 'X' END AS hand", "CASE WHEN opening_id % 4 = 0 THEN '' ELSE '2' END AS qty")
    rows = merge.reconcile(o.where("opening_id % 10 < 8").selectExpr("opening_id", "hand", "leaf_count AS qty"), b, "opening_id", {"hand": True, "qty": False})
    return rows.select("opening_id", F.col("hand.value").alias("hand"), F.col("hand.confidence").alias("hand_confidence"), F.col("qty.value").alias("qty"), F.col("qty.confidence").alias("qty_confidence"))


DOORS_GIVEN = {"1.01.A.01A": True, "110-01C": True, "ER-ADJ9.8-94": True, "B1-101": True, "2A-201": True, "A101": True, "DCB2": False, "SET A": False, "AA": False, "MCA1-2-": False, "#2.01.A.14": False, "626-630": False, "09-15A REV1": True, "CC-993": False, "L9175": False, "3MM": False, "10-012": False, "0123": False, "A-US26": False, "EXIT": False, "C01511": False, "N/A": False}


@query("SELECT opening_id, d AS door, CASE opening_id % 7 WHEN 0 THEN false WHEN 1 THEN opening_id < 10000 WHEN 2 THEN false WHEN 3 THEN [" + ", ".join(str(v).lower() for v in DOORS_GIVEN.values()) + f"][(opening_id % {len(DOORS_GIVEN)})::INT + 1] ELSE opening_id BETWEEN 100 AND 9999 AND opening_id NOT BETWEEN 600 AND 699 END AS valid FROM (SELECT opening_id, CASE opening_id % 7 WHEN 0 THEN hw_set WHEN 1 THEN 'ST-' || opening_id WHEN 2 THEN opening_id || ':' WHEN 3 THEN [" + ", ".join(f"'{d}'" for d in DOORS_GIVEN) + f"][(opening_id % {len(DOORS_GIVEN)})::INT + 1] ELSE opening_id::VARCHAR END AS d FROM openings)")
def p20_door_numbers(spark, sf):
    given = F.element_at(F.array(*map(F.lit, DOORS_GIVEN)), (F.col("opening_id") % len(DOORS_GIVEN) + 1).cast("int"))
    d = frame(spark, sf, "openings").withColumn("given", given).selectExpr("opening_id", "CASE opening_id % 7 WHEN 0 THEN hw_set WHEN 1 THEN concat('ST-', opening_id) WHEN 2 THEN concat(opening_id, ':') WHEN 3 THEN given ELSE CAST(opening_id AS STRING) END AS door")
    return d.withColumn("valid", pages.valid_door(F.col("door")))


@query("SELECT opening_id, regexp_extract(upper(hand), '(RH|LH)', 1) AS hand_side, NOT lower(fire_rating) IN ('', 'n/a', 'none') AS rated, lower(replace(hw_set, '-', '')) AS set_key, ltrim(door_number, '0') AS door_key, 36.0::DOUBLE + opening_id % 2 * 36 AS width FROM openings")
def f01_keys_and_sizes(spark, sf):
    o = frame(spark, sf, "openings")
    size = T.opening_size(F.when(F.col("opening_id") % 2 == 0, "3070").otherwise("6'0\" x 7'0\""))
    return o.select("opening_id", F.coalesce(T.hand(F.col("hand")), F.lit("")).alias("hand_side"), T.fire_rated(F.col("fire_rating")).alias("rated"), T.set_key(F.col("hw_set")).alias("set_key"), T.door_key(F.col("door_number")).alias("door_key"), size["width"].alias("width"))


@query("WITH t AS (SELECT item_id, list_distinct(list_filter(regexp_split_to_array(lower(name), '\\s+'), lambda x: x <> '')) AS a, list_distinct(list_filter(regexp_split_to_array(lower(CASE item_id % 3 WHEN 0 THEN name ELSE category END), '\\s+'), lambda x: x <> '')) AS b FROM products) SELECT item_id, CASE WHEN len(list_distinct(list_concat(a, b))) = 0 THEN 1.0 ELSE round(len(list_intersect(a, b))::DOUBLE / len(list_distinct(list_concat(a, b))), 6) END AS jaccard FROM t")
def u10_jaccard(spark, sf):
    p = frame(spark, sf, "products").selectExpr("item_id", "name", "CASE item_id % 3 WHEN 0 THEN name ELSE category END AS other")
    return p.select("item_id", F.round(T.jaccard(T.tokens(F.col("name")), T.tokens(F.col("other"))), 6).alias("jaccard"))


WORDS = "list_distinct(list_filter(regexp_split_to_array(lower(text), '\\s+'), lambda x: x <> ''))"


@query(f"SELECT doc_id, item_id, round(len(list_intersect(a, b))::DOUBLE / len(list_distinct(list_concat(a, b))), 6) AS jaccard FROM (SELECT doc_id, {WORDS} AS a FROM documents) JOIN (SELECT item_id, {WORDS} AS b FROM benchmark) ON list_has_any(a, b)")
def u10_jaccard_all(spark, sf):
    return linkage.jaccard_pairs(table(spark, sf, "documents"), table(spark, sf, "benchmark"), "doc_id", "item_id")


@query("SELECT opening_id, coalesce(o.door_number, '') AS door_number, coalesce(o.location, '') AS location, coalesce(i.item_id::VARCHAR, '') AS item_id, coalesce(i.qty::VARCHAR, '') AS qty FROM openings o LEFT JOIN items i USING (opening_id)")
def k02_export(spark, sf):
    return sinks.export_rows(frame(spark, sf, "openings").select("opening_id", "door_number", "location"), frame(spark, sf, "items").select("opening_id", "item_id", "qty"), ["door_number", "location", "item_id", "qty"])


@query("WITH n AS (SELECT opening_id + 5 AS opening_id, 'new' AS hand FROM openings WHERE opening_id % 4 = 0) SELECT coalesce(o.opening_id, n.opening_id) AS opening_id, CASE WHEN n.opening_id IS NOT NULL THEN n.hand ELSE o.hand END AS hand, o.location FROM openings o FULL JOIN n ON o.opening_id = n.opening_id")
def k03_upsert(spark, sf):
    o = frame(spark, sf, "openings").select("opening_id", "hand", "location")
    return merge.upsert(o, o.where("opening_id % 4 = 0").select((F.col("opening_id") + 5).alias("opening_id"), F.lit("new").alias("hand")), ["opening_id"], ["hand"])


@query("SELECT opening_id, status FROM openings WHERE NOT (created_at < TIMESTAMP '2001-06-01 00:00:00' - INTERVAL 365 DAY AND status IN ('F', 'O'))")
def k08_retained(spark, sf):
    return sinks.retained(frame(spark, sf, "openings").select("opening_id", "status", "created_at"), "created_at", "2001-06-01 00:00:00", 365, ["F", "O"]).select("opening_id", "status")


@query("SELECT actor_id, action, amount, acted_at, n FROM (SELECT *, count(*) OVER (PARTITION BY actor_id, action) AS n FROM activity) QUALIFY row_number() OVER (PARTITION BY actor_id, action ORDER BY acted_at DESC, event_id DESC) = 1")
def st02_latest_state(spark, sf):
    return progress.latest(frame(spark, sf, "activity"), ["actor_id", "action"], ["amount"])


@query("WITH m AS (SELECT *, max(acted_at) FILTER (event_id % 2 = 0) OVER (PARTITION BY actor_id) AS seen FROM activity) SELECT event_id, actor_id FROM m WHERE event_id % 2 = 1 AND acted_at < seen")
def st03_stale_writes(spark, sf):
    a = frame(spark, sf, "activity")
    state = progress.latest(a.where("event_id % 2 = 0"), ["actor_id"], ["amount"]).drop("n")
    return progress.fold(state, a.where("event_id % 2 = 1"), ["actor_id"], ["amount"])[1].select("event_id", "actor_id")


@query("SELECT date_trunc('day', acted_at)::DATE::VARCHAR AS day, action, count(*) AS n FROM activity GROUP BY 1, 2")
def st09_daily_actions(spark, sf):
    return progress.daily(progress.with_event_time(frame(spark, sf, "activity"))).select(F.to_date("day").cast("string").alias("day"), "action", "n")


@query("SELECT action, CAST(json_extract(details, '$.k') AS BIGINT) AS k, count(*) AS n FROM activity GROUP BY 1, 2")
def f28_json_fields(spark, sf):
    k = F.from_json("details", "k LONG")["k"].alias("k")
    return frame(spark, sf, "activity").groupBy("action", k).agg(F.count("*").alias("n"))


@query("SELECT c.n_regionkey AS region, coalesce(status, 'all') AS status, count(*) AS n FROM openings JOIN projects USING (project_id) JOIN nation c ON c.n_nationkey = nation_id GROUP BY GROUPING SETS ((c.n_regionkey, status), (c.n_regionkey))")
def x01_rollup_extension(spark, sf):
    o = frame(spark, sf, "openings").join(frame(spark, sf, "projects"), "project_id").join(table(spark, sf, "nation"), F.col("nation_id") == F.col("n_nationkey"))
    return o.groupingSets([["n_regionkey", "status"], ["n_regionkey"]], "n_regionkey", "status").agg(F.count("*").alias("n")).select(F.col("n_regionkey").alias("region"), F.coalesce("status", F.lit("all")).alias("status"), "n")
