"""Queries over promotions, kept state, refreshes and headings' doors, with the SQL of what they should come to."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jambwork.functions import taxonomy as C
from jambwork.functions import text as T
from jambwork.operators import grammar, promotion
from jambwork.plans.catalog import query
from jambwork.plans.texts import WRITTEN, schedule
from jambwork.sources import versions
from jambwork.sources.sinks import stored
from jambwork.sources.tables import frame
from jambwork.streaming import live


def folder(spark: SparkSession) -> str:
    """A new folder beside those that cut lineage."""
    stored(spark.range(0))  # sets the shared folder where there is none
    return f"{spark.conf.get('spark.checkpoint.dir').rstrip('/')}/{uuid.uuid4().hex}"


@query("WITH g AS (SELECT *, coalesce(acted_at - lag(acted_at) OVER w > INTERVAL 6 HOUR, true) AS new FROM activity WINDOW w AS (PARTITION BY actor_id ORDER BY acted_at)), r AS (SELECT *, sum(new::INT) OVER (PARTITION BY actor_id ORDER BY acted_at) AS run FROM g) SELECT actor_id, min(acted_at)::VARCHAR AS began, (max(acted_at) + INTERVAL 6 HOUR)::VARCHAR AS due, count(*) AS n FROM r GROUP BY actor_id, run")
def st01_refreshes(spark, sf):
    rows = live.refreshes(frame(spark, sf, "activity").withColumn("acted_at", F.col("acted_at").cast("timestamp")), ["actor_id"], "6 hours")
    return rows.withColumns({c: F.col(c).cast("string") for c in ("began", "due")})


def _kept(spark: SparkSession, sf: str, name: str) -> DataFrame:
    """Activity folded in two batches, by even and odd ids; the first comes twice."""
    events, path = frame(spark, sf, "activity").select("actor_id", "action", "amount", "acted_at", "event_id"), folder(spark)
    for part in (0, 0, 1):
        live.folded(events.where(F.col("event_id") % 2 == part), path, part, ["actor_id", "action"], ["amount"], buckets=8)
    return (versions.current if name == "state" else versions.log)(spark, path, name, events.schema if name == "rejected" else events.drop("event_id").schema)


EVENS = "e AS (SELECT actor_id, action, max(acted_at) AS seen FROM activity WHERE event_id % 2 = 0 GROUP BY ALL)"


@query("SELECT actor_id, action, arg_max(amount, acted_at) AS amount, max(acted_at)::VARCHAR AS acted_at FROM activity GROUP BY ALL")
def st02_kept_state(spark, sf):
    return _kept(spark, sf, "state").select("actor_id", "action", "amount", F.col("acted_at").cast("string").alias("acted_at"))


@query(f"WITH {EVENS} SELECT event_id, 1::BIGINT AS version FROM activity JOIN e USING (actor_id, action) WHERE event_id % 2 = 1 AND acted_at < seen")
def st03_kept_rejected(spark, sf):
    return _kept(spark, sf, "rejected").select("event_id", "version")


#: Statuses that come back for queued events; every actor's queue is in the order of times.
STATUS = "CASE WHEN event_id % 97 = 0 THEN 401 WHEN event_id % 11 = 0 THEN 500 WHEN event_id % 7 = 0 THEN 409 WHEN event_id % 13 = 0 THEN NULL ELSE 200 END"


@query(f"WITH q AS (SELECT *, {STATUS} AS status, event_id % 6 AS tries FROM activity), s AS (SELECT actor_id, min(acted_at) AS stop FROM q WHERE status = 401 AND tries < 5 GROUP BY 1), x AS (SELECT event_id, tries, CASE WHEN acted_at >= stop THEN 'waiting' WHEN tries >= 5 THEN 'given_up' WHEN status = 200 THEN 'synced' WHEN status = 409 THEN 'conflict' ELSE 'failed' END AS outcome FROM q LEFT JOIN s USING (actor_id)) SELECT event_id, outcome, (tries + CASE outcome WHEN 'failed' THEN 1 ELSE 0 END)::BIGINT AS retry_count FROM x")
def st04_replayed_queue(spark, sf):
    queue = frame(spark, sf, "activity").withColumns({"status": F.expr(STATUS), "retry_count": F.expr("event_id % 6")})
    return live.replayed(queue, F.col("status"), ["acted_at", "event_id"], ["actor_id"]).select("event_id", "outcome", F.col("retry_count").cast("long").alias("retry_count"))


#: Each project has a run; a third of the doors aren't staged, a fifth are new.
STAGED, OLD = "opening_id % 3 <> 0", "opening_id % 5 <> 0"
OPENING = "project_id, door_number, hw_set, concat('H', hw_set) AS hw_heading, {location} AS location, door_type, frame_type, fire_rating, hand, CAST(opening_id % 50 AS INT) AS pdf_page, {leaves} AS leaf_count"
BEFORE, AFTER = OPENING.format(location="location", leaves="leaf_count"), OPENING.format(location="hand", leaves="CASE WHEN opening_id % 4 = 0 THEN NULL ELSE leaf_count END")
RUN = "CASE project_id % 5 WHEN 0 THEN 'promoted' WHEN 1 THEN 'completed_with_issues' ELSE 'reviewing' END"


def _staged(spark: SparkSession, sf: str) -> dict[str, DataFrame]:
    """Production's openings and items, the runs that are to be promoted and what they stage."""
    o = frame(spark, sf, "openings")
    h = stored(frame(spark, sf, "hardware").join(o.select("opening_id", "project_id", "door_number"), "opening_id").select("opening_id", "project_id", "door_number", "name", "qty", "model", "leaf_side"))
    projects = frame(spark, sf, "projects").select("project_id")
    return {
        "openings": o.where(OLD).selectExpr(*_columns(BEFORE), "is_active"), "items": h.where(OLD).select("project_id", "door_number", "name", "qty", "model"),
        "requests": projects.selectExpr("CASE WHEN project_id % 17 = 3 THEN -project_id ELSE project_id END AS run_id", "project_id % 50 AS user_id"),
        "runs": projects.selectExpr("project_id AS run_id", "project_id", f"{RUN} AS status"),
        "members": projects.selectExpr("project_id", "project_id % 50 AS user_id", "CASE WHEN project_id % 11 = 0 THEN 'member' ELSE 'admin' END AS role"),
        "staged": o.where(STAGED).withColumnRenamed("project_id", "p").selectExpr("p AS run_id", *_columns(AFTER.replace("project_id, ", "", 1))),
        "parts": h.where(f"{STAGED} AND NOT (opening_id % 7 = 0 AND leaf_side = 'active')").selectExpr("project_id AS run_id", "door_number", "name", "qty", "model"),
    }


def _merged(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    t = _staged(spark, sf)
    accepted = promotion.decided(t["requests"], t["runs"], t["members"], t["staged"], t["parts"]).where("error IS NULL")
    return promotion.merged(t["openings"], t["items"], accepted, t["staged"], t["parts"])


def _published(spark: SparkSession, sf: str) -> DataFrame:
    """What the promotion of all runs into versioned tables has told of them."""
    t, path = _staged(spark, sf), folder(spark)
    before = {n: versions.with_bucket(t[n], ["project_id"], 8) for n in ("openings", "items")}
    versions.publish(spark, path, 0, before, before["openings"].select("bucket").union(before["items"].select("bucket")).distinct(), promotion.CHECKS)
    promotion.promote(spark, path, 1, t["requests"], t["runs"], t["members"], t["staged"], t["parts"], t["openings"].schema, t["items"].schema, 8)
    told = "run_id long, user_id long, project_id long, error string, orphan_doors array<string>, added long, updated long, unchanged long, deactivated long, items_promoted long, success boolean"
    return versions.log(spark, path, "promotions", spark.createDataFrame([], told).schema)


def _columns(text: str) -> list[str]:
    """Expressions of a list; commas in brackets don't part them."""
    out, depth = [""], 0
    for c in text:
        depth += (c == "(") - (c == ")")
        if c == "," and not depth:
            out.append("")
        else:
            out[-1] += c
    return [x.strip() for x in out]


RUNS = f"""b AS (SELECT *, opening_id % 5 <> 0 AS old, opening_id % 3 <> 0 AS comes FROM openings),
h AS (SELECT opening_id, name, qty, model, NOT (opening_id % 7 = 0 AND leaf_side = 'active') AS comes FROM hardware),
d AS (SELECT b.opening_id, count(h.name) FILTER (h.comes) AS n, count(h.name) FILTER (NOT h.comes) AS less FROM b LEFT JOIN h USING (opening_id) GROUP BY 1),
q AS (SELECT project_id, count(*) FILTER (comes AND n = 0) AS bare, string_agg(door_number, ', ' ORDER BY door_number) FILTER (comes AND n = 0) AS doors, bool_or(comes) AS any_staged FROM b JOIN d USING (opening_id) GROUP BY 1),
r AS (SELECT project_id, CASE WHEN project_id % 17 = 3 THEN 'Extraction run not found' WHEN project_id % 5 = 0 THEN 'Cannot promote extraction in status "promoted". Must be "reviewing" or "completed_with_issues".'
  WHEN project_id % 11 = 0 THEN 'User must be a project admin to promote extraction'
  WHEN bare > 0 THEN concat('Cannot promote: ', bare, ' door(s) have no hardware items: ', doors, '. Exclude them or add hardware before promoting.') END AS error, coalesce(any_staged, false) AS any_staged FROM projects LEFT JOIN q USING (project_id)),
f AS (SELECT b.*, d.n, error IS NULL AS promoted, CASE WHEN error IS NOT NULL THEN NULL WHEN comes AND NOT old THEN 'added' WHEN comes AND less > 0 THEN 'updated' WHEN comes THEN 'unchanged' WHEN old AND is_active AND any_staged THEN 'deactivated' END AS did
  FROM b JOIN d USING (opening_id) JOIN r USING (project_id))"""


@query(f"""WITH {RUNS} SELECT project_id, door_number, hw_set, concat('H', hw_set) AS hw_heading, CASE WHEN t THEN hand ELSE location END AS location, door_type, frame_type, fire_rating, hand, (opening_id % 50)::INT AS pdf_page,
CASE WHEN t AND opening_id % 4 = 0 THEN 1 ELSE leaf_count END AS leaf_count, CASE WHEN t THEN true WHEN did = 'deactivated' THEN false ELSE is_active END AS is_active FROM (SELECT *, promoted AND comes AS t FROM f) WHERE old OR t""")
def m01_merged_openings(spark, sf):
    return _merged(spark, sf)[0].drop("action")


@query(f"WITH {RUNS} SELECT project_id, door_number, name, qty::INT AS qty, model FROM f JOIN h USING (opening_id) WHERE CASE WHEN did IN ('added', 'updated') THEN h.comes ELSE old END")
def m01_merged_items(spark, sf):
    return _merged(spark, sf)[1]


@query(f"""WITH {RUNS}, c AS (SELECT project_id, count(*) FILTER (did = 'added') AS added, count(*) FILTER (did = 'updated') AS updated, count(*) FILTER (did = 'unchanged') AS unchanged, count(*) FILTER (did = 'deactivated') AS deactivated,
sum(CASE WHEN did IN ('added', 'updated') THEN n ELSE 0 END)::BIGINT AS items_promoted FROM f GROUP BY 1)
SELECT CASE WHEN project_id % 17 = 3 THEN -project_id ELSE project_id END AS run_id, error IS NULL AS success, error, CASE WHEN error IS NULL THEN coalesce(added, 0) END AS added, CASE WHEN error IS NULL THEN coalesce(updated, 0) END AS updated,
CASE WHEN error IS NULL THEN coalesce(unchanged, 0) END AS unchanged, CASE WHEN error IS NULL THEN coalesce(deactivated, 0) END AS deactivated, CASE WHEN error IS NULL THEN coalesce(items_promoted, 0) END AS items_promoted FROM r LEFT JOIN c USING (project_id)""")
def m01_merged_runs(spark, sf):
    return _published(spark, sf).select("run_id", "success", "error", "added", "updated", "unchanged", "deactivated", "items_promoted")


#: Lines that describe a section's openings, below their doors.
DESCRIBED = "SELECT opening_id - opening_id % 2 + CASE WHEN floor(opening_id / 2) % 3 = 0 THEN opening_id % 2 ELSE 0 END AS page, opening_id % 2 * 100000 + 2.5 AS line, concat('Opening Description: 3070 ', fire_rating) AS text FROM {o} WHERE fire_rating <> ''"
DOORS = f"{WRITTEN}, w AS (SELECT opening_id - opening_id % 2 + CASE WHEN kind = 0 THEN opening_id % 2 ELSE 0 END AS page, opening_id % 2 * 100000 + 2 AS line, concat(opening_id % 90 + 1, '.01.E.0', opening_id % 10, 'A') AS door_number, CASE WHEN fire_rating LIKE '%MIN' THEN fire_rating END AS fire_rating, CASE WHEN kind = 0 THEN concat(opening_id % 40, 'A') ELSE hw_set END AS id FROM o WHERE kind < 2)"


@query(f"WITH {DOORS} SELECT door_number, arg_min(page, (page, line)) AS page, arg_min({{'r': fire_rating}}, (page, line)).r AS fire_rating FROM w GROUP BY 1")
def x03_heading_map(spark, sf):
    rows = schedule(spark, sf).unionByName(spark.sql(DESCRIBED, o=frame(spark, sf, "openings")))
    rows = grammar.sectioned(rows)
    return grammar.heading_map(rows, grammar.doors(rows)).select("door_number", "page", "fire_rating")


@query(f"WITH {DOORS} SELECT door_number, arg_min(page, (page, line)) AS page, arg_min(concat('S', id), (page, line)) AS set_id FROM w WHERE NOT regexp_matches(id, '^(DH)?3') GROUP BY 1")
def x02_set_doors(spark, sf):
    rows = grammar.sectioned(schedule(spark, sf))
    listed = grammar.doors(rows).join(rows.select("page", "section", "set_id", "generic_id").distinct(), ["page", "section"])
    ids = rows.select(F.coalesce("generic_id", "set_id").alias("generic_id")).where("generic_id IS NOT NULL AND NOT generic_id RLIKE '^(DH)?3'").distinct()
    known = ids.select(F.explode(F.array(F.lit("S"), F.lit("Z"))).alias("k"), "generic_id").select(F.concat("k", "generic_id").alias("set_id"), "generic_id", F.col("k").alias("position"))
    return grammar.set_doors(listed, known).select("door_number", "page", "set_id")


#: Names with what makes them no hardware, dealt by kinds.
NAMED = "CASE pos % 8 WHEN 0 THEN concat(' Notes: ', name) WHEN 1 THEN concat(lower(substr(name, 1, 1)), substr(name, 2)) WHEN 2 THEN concat('* ', name) WHEN 3 THEN concat(name, ' as noted') WHEN 4 THEN concat('NTOWN IO N T LC ', substr(name, 1, 2)) WHEN 5 THEN '  ' ELSE name END"


@query("SELECT opening_id, pos, CASE pos % 8 WHEN 0 THEN 'pattern' WHEN 1 THEN CASE WHEN name IN ('Door', 'Frame') THEN 'pattern' ELSE 'lower case' END WHEN 2 THEN 'punctuation' WHEN 3 THEN 'sentence' WHEN 4 THEN 'garble' WHEN 5 THEN 'empty' ELSE CASE WHEN name IN ('Door', 'Frame') THEN 'pattern' END END AS why FROM hardware")
def p19_not_hardware(spark, sf):
    rows = frame(spark, sf, "hardware").withColumn("name", F.expr(NAMED))
    names = rows.select("name").distinct().withColumn("why", C.not_hardware(F.col("name")))
    return rows.join(names, "name", "left").select("opening_id", "pos", "why")


FIELD = "CASE opening_id % 4 WHEN 0 THEN 'fire_rating' WHEN 1 THEN 'location' WHEN 2 THEN 'hand' ELSE 'door_number' END"


@query("SELECT opening_id, CASE opening_id % 4 WHEN 0 THEN fire_rating WHEN 1 THEN CASE WHEN location = '' THEN '' ELSE location END WHEN 2 THEN hand ELSE concat('x R) ', door_number) END AS value FROM openings")
def f21_without_marks(spark, sf):
    rows = frame(spark, sf, "openings").withColumn("field", F.expr(FIELD))
    raw = F.expr("CASE opening_id % 4 WHEN 0 THEN concat('x\n', fire_rating) WHEN 1 THEN concat('R)\nL) ', location, CASE WHEN location = '' THEN '' ELSE ' L)' END) WHEN 2 THEN concat(' L) x ', hand) ELSE concat(' x R) ', door_number, ' ') END")
    return rows.select("opening_id", T.without_marks(F.col("field"), raw).alias("value"))
