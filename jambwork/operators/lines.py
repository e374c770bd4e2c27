"""Lines of schedule text: set headings, doors listed under them, assignments within lines, JSON within prose.

Everything works on a text column with built-in functions; only the search for
JSON in prose is Python, on Arrow batches.
"""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from jambwork.functions import text as T
from jambwork.operators.pages import valid_door

#: How lines list doors.
KIND = r"(Pair|Single|Double\s+Egress)"
COUNTED = r"(?i)(?:For\s+|Qty[:\s]+)?(\d+)\s*[-–]?\s*" + KIND + r"\s+Doors?\s*(?:Opening)?s?\s*(?:#|$)"
NUMBERED = r"(?i)(?:For\s+|Qty[:\s]+)?\d+\s*[-–]?\s*" + KIND + r"\s+Doors?\s*(?:Opening)?s?\s*#\s*(\S+)"
LISTED = r"(?i)(?:For\s+|Qty[:\s]+)?\d+\s*[-–]?\s*" + KIND + r"\s+Doors?\s*(?:Opening)?s?\s*#?\s*(.+)"
INLINE = r"(?i)(?:For\s+(?:Openings?|Doors?)\s*[:\-]\s*|Doors?\s*[:\-]\s*|Openings?\s*[:\-]\s*|Assigned\s+(?:to\s+)?(?:Doors?|Openings?)\s*[:\-]\s*)(.+)"
DEALT = r"(?i)^\s*(\d+)\s*(SGL|PRA/PRI|PR)\s+DOOR(?:\(S\))?:?\s*(\S+)"
TOKEN = r"#?\s*([A-Za-z0-9][A-Za-z0-9.\-]{1,14})"

#: Which program made a document, by words of its metadata, the first that fits.
PRODUCERS = [("(?i)bluebeam", "bluebeam"), ("(?i)overtur|allegion", "allegion"), ("(?i)assa|abloy|openings studio", "assa_abloy"), ("(?i)s4h|specification 4|spec4", "s4h"), ("(?i)comsense", "comsense"), ("(?i)microsoft word|microsoft excel|libreoffice|openoffice", "word_excel")]


def lines(text: Column) -> Column:
    return F.split(text, "\n")


def _total(numbers: Column) -> Column:
    return F.aggregate(numbers, F.lit(0).cast("long"), lambda a, x: a + x)


def heading_doors(text: Column) -> Column:
    """(doors, leaves) that a heading block lists by kind; pairs and double egress have two leaves."""
    one, two = (F.regexp_extract_all(text, F.lit("(?m)" + COUNTED), F.lit(k)) for k in (1, 2))
    each = F.zip_with(one, two, lambda n, k: F.struct(n.cast("long").alias("n"), F.when(F.lower(k).startswith("single"), 1).otherwise(2).alias("leaves")))
    return F.struct(_total(F.transform(each, lambda x: x["n"])).alias("doors"), _total(F.transform(each, lambda x: x["n"] * x["leaves"])).alias("leaves"))


def dealt_doors(text: Column) -> Column:
    """(door, count, leaves, hand) of the lines that deal doors out by the number of leaves."""
    own = F.filter(lines(text), lambda x: x.rlike(DEALT))

    def row(x: Column) -> Column:
        raw = F.regexp_extract(x, DEALT, 3)
        dotted = F.regexp_extract(raw, r"^(\d{1,3}\.\d{2}\.[A-Z]\.\d{2}[A-Z]?)", 1)
        leaves = F.when(F.upper(F.regexp_extract(x, DEALT, 2)) == "SGL", 1).otherwise(2)
        hand = F.regexp_extract(x, r"\b(LH|RH|LHR|RHR|LHRA|RHRA|LHA|RHA)\b", 1)
        return F.struct(F.coalesce(T.blank_to_null(dotted), raw).alias("door"), F.regexp_extract(x, DEALT, 1).cast("int").alias("count"), leaves.alias("leaves"), hand.alias("hand"))

    return F.transform(own, row)


def _valid(tokens: Column) -> Column:
    clean = F.transform(tokens, lambda t: F.upper(F.regexp_replace(F.trim(t), "[,;:]+$", "")))
    return F.array_distinct(F.filter(clean, valid_door))


def heading_door_numbers(text: Column) -> Column:
    """The valid door numbers of a heading block in their order: after counted kinds, after any #, then of dealt lines."""
    counted, marked = F.regexp_extract_all(text, F.lit(NUMBERED), F.lit(2)), F.regexp_extract_all(text, F.lit(r"#\s*(\S+)"), F.lit(1))
    dealt = F.transform(dealt_doors(text), lambda x: F.upper(x["door"]))
    return F.array_distinct(F.concat(_valid(counted), _valid(marked), dealt))


def inline_doors(text: Column) -> Column:
    """(family, doors) of a page's assignments: dealt lines, else counted lists, else lists after a word; the first family with a valid door counts."""
    of = lambda p, k: F.flatten(F.transform(F.regexp_extract_all(text, F.lit(p), F.lit(k)), lambda x: F.regexp_extract_all(x, F.lit(TOKEN), F.lit(1))))
    families = [("dealt", _valid(F.transform(dealt_doors(text), lambda x: x["door"]))), ("counted", _valid(of(LISTED, 2))), ("inline", _valid(of(INLINE, 1)))]
    out = F.when(F.lit(False), F.struct(F.lit("").alias("family"), families[0][1].alias("doors")))
    for name, doors in families:
        out = out.when(F.size(doors) > 0, F.struct(F.lit(name).alias("family"), doors.alias("doors")))
    return out.otherwise(F.struct(F.lit("none").alias("family"), F.array().cast("array<string>").alias("doors")))


#: Kinds of set headings: pattern, and which groups are the heading's and the generic id.
SET_HEADINGS = [
    (r"(?im)^(?!\s*\d+\.\s).*?heading\s*#?\s*([A-Z0-9][A-Z0-9.\-:]*)\s*\((?:hw\s*)?set\s*#?\s*([A-Z0-9][A-Z0-9.\-:]*)\)", 1, 2),
    (r"(?im)^(?!\s*\d+\.\s).*?heading\s*#:\s*([A-Z0-9][A-Z0-9.\-]*)", 1, 1),
    (r"(?im)^(?!\s*\d+\.\s).*?(?:hardware|hw)\s+(?:set|group)\s*[:# ]\s*#?\s*([A-Z0-9][A-Z0-9.\-:]*)", 1, 1),
    (r"(?im)^(?!\s*\d+\.\s).*?([A-Z0-9][A-Z0-9.\-]*)\s*[-–—]\s*hardware\s+set\b", 1, 1),
    (r"(?im)^(?!\s*\d+\.\s).*?\bset\s*[:#]\s*([A-Z0-9][A-Z0-9.\-:]+)", 1, 1),
]


def set_heading_kind(text: Column, kind: int) -> Column:
    """(heading_id, generic_id) of the heading of one kind in a text, or null."""
    pattern, a, b = SET_HEADINGS[kind]
    own = T.blank_to_null(F.regexp_extract(text, pattern, a))
    return F.when(own.isNotNull(), F.struct(own.alias("heading_id"), F.regexp_extract(text, pattern, b).alias("generic_id")))


def set_heading(text: Column) -> Column:
    """(heading_id, generic_id) of a text's set heading, by the first kind that fits; lines of numbered lists are none. Empty if there is none."""
    found = [(T.blank_to_null(F.regexp_extract(text, p, a)), F.regexp_extract(text, p, b)) for p, a, b in SET_HEADINGS]
    pick = lambda k: F.coalesce(*(F.when(h.isNotNull(), (h, g)[k]) for h, g in found), F.lit(""))
    return F.struct(pick(0).alias("heading_id"), pick(1).alias("generic_id"))


def producer(creator: Column, program: Column) -> Column:
    """The kind of program that made a document, marks of trade aside."""
    both = F.regexp_replace(F.concat_ws(" ", F.coalesce(creator, F.lit("")), F.coalesce(program, F.lit(""))), r"(?i)[®©™]|\((?:R|C|TM)\)", "")
    return T.ladder(both, PRODUCERS, "unknown")


def carried(rows: DataFrame, by: str, position: str, text: str, door: Column) -> DataFrame:
    """Lines (by, position, text) stitched: what names no door goes on with the text of the door's line before it; what comes before any door is left out."""
    from jambwork.operators.sets import segments

    own = segments(rows.withColumn("_d", door), [by], [position], F.col("_d").isNotNull())
    out = own.groupBy(by, "segment").agg(F.min(position).alias(position), F.min_by("_d", position).alias("door"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(position, text))), lambda x: x[text]), " ").alias(text))
    return out.where("door is not null").drop("segment")


def _candidates(text: str):
    """A text whole, its fenced blocks, then what begins with a bracket."""
    yield text
    parts = text.split("```")
    for block in parts[1:-1:2]:
        yield block.removeprefix("json").strip()


def salvaged(text: str | None) -> str | None:
    """The first JSON value of a text as canonical JSON: all of it, else a fenced block, else the first object or array that parses."""
    if not text or not text.strip():
        return None
    for x in _candidates(text):
        try:
            return json.dumps(json.loads(x), sort_keys=True, separators=(",", ":"), ensure_ascii=False)
        except (ValueError, RecursionError):
            continue
    decoder, at = json.JSONDecoder(), 0
    while (at := min((i for i in (text.find("{", at), text.find("[", at)) if i >= 0), default=-1)) >= 0:
        try:
            return json.dumps(decoder.raw_decode(text, at)[0], sort_keys=True, separators=(",", ":"), ensure_ascii=False)
        except (ValueError, RecursionError):
            at += 1
    return None


@F.pandas_udf(StringType())
def json_in(texts: pd.Series) -> pd.Series:
    """salvaged() of each text."""
    return texts.map(salvaged)
