"""Items and doors out of the lines of schedule pages.

Lines are rows (page, line, text), of any number of pages. Every line is classed by
itself; what an automaton would remember between lines (the open section, the open
item, whether the list of items has begun or ended) is a running count over the lines
of its page, so a page is one window and pages are spread over all tasks. Lines of one
page are in memory together; texts without a line break are lines like others, nulls
and blank lines are none.

A page's format is that of its headings: `specworks` where one names a set in brackets
with HW, `esc` where one has "Heading #:", else `generic`. A page of the first is one
section; others are cut at their headings if they have two or more, and what comes
before the first has no items or doors. Sections without a set's id have no items.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from jambwork.functions import text as T
from jambwork.operators import lines as L
from jambwork.operators import sets

#: Lines that begin a section, items, doors, ends of a page's text, and lines that are nothing of the kind.
SECTION = (
    r"(?i)^(?:heading\s+#?([A-Z0-9][A-Z0-9.\-:]*)\s*\((?:hw\s*)?set|heading\s+#:\s*([A-Z0-9][A-Z0-9.\-]*)|heading\s+#([A-Z0-9][A-Z0-9.\-:]*)"
    r"|(?:hardware\s+|hw\s+)(?:set|group)\s*[:#\s]\s*([A-Z0-9][A-Z0-9.\-:]*)|set\s*[:#]\s*([A-Z0-9][A-Z0-9.\-:]*)|([A-Z0-9][A-Z0-9.\-]{0,14})\s+[-–—]\s+(?:hardware\s+)?set\b)"
)
SPECWORKS_PAGE, ESC_PAGE = r"(?i)heading\s+\S+\s*\(hw\s*set", r"(?i)heading\s*#:\s*[A-Z0-9]"
BEGIN = r"(?i)totals each assembly|each assembly to have"
SPECWORKS_ITEM, ESC_ITEM, GENERIC_ITEM = r"^\(\s*(\d+)\)\s+(\d+)\s+(EA|SET|PR)\s+(.+)", r"(?i)^(\d+)\s+(EA|SET|PR)\s+(.+)", r"^(\d{1,2})\s+(.+)"
SPECWORKS_END, ESC_END = r"^(?:Project:|SpecWorks|Supplier:)", r"^(?:Engineering\s*Special|SpecWorks|Supplier:)"
DOOR = r"(?i)^(\d+)\s+(SGL|PRA/PRI|PR)\s+DOOR(?:\(S\)|:)(\d{1,3}\.\d{2}\.[A-Z]\.\S+)"
DOOR_NUMBER, HAND = r"^(\d{1,3}\.\d{2}\.[A-Z]\.\d{2}[A-Z]?)", r"\b(LH|RH|LHR|RHR|LHRA|RHRA|LHA|RHA)\b"
ESC_SKIP = r"(?i)^Heading\s*#|^\d+['′-]|^(?:Phase:|Project\s*ID:|Hardware\s*Schedule)|^at\s+(?:header|jamb|hinge|lock|latch|pull)"
REFERENCE = r"\(([A-Z]{2,4}-\d{1,3})\)"
FINISH = r"(?i)^(\d{3}[A-Z]?|US\d{2}[A-Z]?|SP\d{2,3}|Z\d{2}|AL|GRY|BK|BSP|S4|CLR|DKB)$"
MAKERS = ["IVE", "SCH", "LCN", "VON", "NGP", "GLY", "ZER", "ECS", "B/O", "ABH", "AME", "BEA", "DON", "HAG", "HES", "KAB", "KEM", "MED", "PEM", "ROC", "SEC", "SIM", "STA", "TRI"]
MAKER_END = r"(?i)^(?:International|Closers|Builders\s*Hardware|Products|Industries|Corp|Inc)$"
NO_MAKER = r"(?i)^(?:at\s|per\s|extended|mortise\s*door|concealed|gasketing\s*change|please|EU\s*=|permanent|length|coordinator|closer)"
NOTE = r"(?i)^(?:gasketing\s*change|please|ESC\s|per\s|EU\s*=|permanent|length|coordinator|closer\s*mounted|mortise\s*door\s*bottom|concealed\s*OH|extended\s*lip)"
HARDWARE = (
    r"(?i)(hinge|pivot|spring\s*hinge|continuous\s*hinge|lockset|latchset|latch\s*set|lock\s*set|passage|privacy|storeroom|classroom|entrance|office|mortise.*lock|cylindrical|deadbolt|dead\s*bolt|night\s*latch"
    r"|exit\s*device|panic|rim\s*device|concealed\s*vertical|surface\s*vertical|crossbar|touch\s*bar|push\s*bar|flush\s*bolt|constant\s*latching|surface\s*bolt|dust\s*proof|strike|electric\s*strike|power\s*strike"
    r"|elec.*modif|electrif|power\s*transfer|ept|wire\s*harness|connector|molex|con-\d|wiring|pigtail|closer|door\s*check|floor\s*closer|coordinator|cylinder|core|interchangeable"
    r"|kick\s*plate|protection\s*plate|mop\s*plate|armor\s*plate|wall\s*stop|floor\s*stop|overhead\s*stop|door\s*stop|holder|hold\s*open|door\s*sweep|auto.*door\s*bottom|drop\s*seal|door\s*bottom|threshold|saddle"
    r"|gasket|smoke\s*seal|gasketing|acoustic\s*seal|weatherstrip|perimeter\s*seal|sound\s*seal|rain\s*drip|drip\s*cap|astragal|meeting\s*stile|silencer|bumper|mute"
    r"|by\s*others|hardware\s*by\s*others|not\s*in\s*contract|not\s*used|no\s*hardware|pull|push|plate|lever|knob|key|magnetic|roller|catch)"
)
#: Abbreviations in names of items.
SHORT = {
    "cont.": "continuous", "cont": "continuous", "flr": "floor", "flr.": "floor", "w/": "with ", "w/o": "without", "mtd": "mounted", "mtd.": "mounted", "hd": "heavy duty", "hd.": "heavy duty", "adj": "adjustable", "adj.": "adjustable",
    "ss": "stainless steel", "alum": "aluminum", "alum.": "aluminum", "sfc": "surface", "sfc.": "surface", "conc": "concealed", "conc.": "concealed", "thresh": "threshold", "thresh.": "threshold",
}


def sectioned(rows: DataFrame) -> DataFrame:
    """rows (page, line, text) with format, section (from 1; 0 for what comes before the first of several headings) and the section's set_id and generic_id,
    and list_begins and list_ends, the first lines of its list of items and below it (null if there is none).

    Lines without text say nothing and are left out before anything is moved.
    """
    # all windows are in the order of lines, so that one sort of each kind does for what is asked here and by others
    by_line = Window.partitionBy("page").orderBy("line")
    page, so_far = by_line.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing), by_line.rowsBetween(Window.unboundedPreceding, 0)
    text, said = F.col("text"), F.col("_said")
    rows = rows.withColumn("text", F.trim("text")).where("text <> ''").withColumn("_said", F.lower("text"))
    rows = rows.withColumn("_heading", said.contains("heading")).withColumn("_named", F.col("_heading") | said.contains("set") | said.contains("group"))
    is_in = lambda pattern: F.max(F.col("_heading") & text.rlike(pattern)).over(page)
    rows = rows.withColumn("_begins", (F.col("_named") & text.rlike(SECTION)).cast("int"))
    rows = rows.withColumns({"format": F.when(is_in(SPECWORKS_PAGE), "specworks").when(is_in(ESC_PAGE), "esc").otherwise("generic"), "section": F.sum("_begins").over(so_far), "_headings": F.sum("_begins").over(page)})
    whole = (F.col("format") == "specworks") | (F.col("_headings") < 2)
    rows = rows.withColumn("section", F.when(whole, 1).otherwise(F.col("section")))
    kind = lambda x: F.coalesce(*(F.when(x.rlike(p), F.struct(F.lit(k).alias("kind"), L.set_heading_kind(x, k).alias("ids"))) for k, (p, *_) in enumerate(L.SET_HEADINGS)))
    rows = rows.withColumn("_best", F.when(F.col("_named"), T.let(text, kind)))
    best, section = F.col("_best"), Window.partitionBy("page", "section").orderBy("line").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    found = F.min(F.when(best.isNotNull(), F.struct(best["kind"].alias("kind"), "line", best["ids"].alias("ids")))).over(section)
    ends = F.when(F.col("format") == "specworks", text.rlike(SPECWORKS_END)).when(F.col("format") == "esc", text.rlike(ESC_END))
    first = lambda fits: F.min(F.when(fits, F.col("line"))).over(section)
    rows = rows.withColumns({"_ids": found["ids"], "list_begins": first((F.col("format") != "specworks") | text.rlike(BEGIN)), "list_ends": first(ends)})
    rows = rows.withColumns({"set_id": F.col("_ids")["heading_id"], "generic_id": F.col("_ids")["generic_id"]})
    return rows.drop("_begins", "_headings", "_ids", "_best", "_heading", "_named", "_said")


def doors(rows: DataFrame) -> DataFrame:
    """page, section, line, door_number, n (openings), leaves (of all of them), door_type and hand of the lines that deal out doors."""
    rows = rows.where((F.col("section") > 0) & F.col("text").rlike(DOOR))
    raw, n, pair = F.regexp_extract("text", DOOR, 3), F.regexp_extract("text", DOOR, 1).cast("long"), F.upper(F.regexp_extract("text", DOOR, 2)).startswith("PR")
    return rows.select("page", "section", "line", F.coalesce(T.blank_to_null(F.regexp_extract(raw, DOOR_NUMBER, 1)), raw).alias("door_number"), n.alias("n"), (n * F.when(pair, 2).otherwise(1)).alias("leaves"), F.when(pair, "PR").otherwise("SGL").alias("door_type"), F.regexp_extract("text", HAND, 1).alias("hand"))


def section_counts(rows: DataFrame) -> DataFrame:
    """page, section, set_id, generic_id, doors and leaves of each section with an id.

    In the two formats that deal doors out by lines these count; else counted kinds do, and what a page counts
    beyond its sections (before the first heading) goes to the first section that counts none.
    """
    n, leaves = F.regexp_extract("text", DOOR, 1).cast("long"), F.when(F.upper(F.regexp_extract("text", DOOR, 2)).startswith("PR"), 2).otherwise(1)
    own, listed = F.col("text").rlike(DOOR) & (F.col("format") != "generic"), L.heading_doors(F.col("text"))
    each = lambda k, dealt: F.sum(F.when(own, dealt).when(F.col("format") == "generic", listed[k]).otherwise(0))
    out = rows.groupBy("page", "section", "set_id", "generic_id", "format").agg(each("doors", n).alias("doors"), each("leaves", n * leaves).alias("leaves"))
    page, none = Window.partitionBy("page"), (F.col("section") > 0) & F.col("set_id").isNotNull() & (F.col("doors") == 0) & (F.col("leaves") == 0)
    before = lambda c: F.sum(F.when((F.col("section") == 0) & (F.col("format") == "generic"), F.col(c)).otherwise(0)).over(page)
    gets = F.coalesce(F.col("section") == F.min(F.when(none, F.col("section"))).over(page), F.lit(False))
    out = out.withColumns({c: F.col(c) + F.when(gets, before(c)).otherwise(0) for c in ("doors", "leaves")})
    return out.where("section > 0 and set_id is not null").drop("format")


def _opened(rows: DataFrame) -> DataFrame:
    """Lines with `item` (how many items of the section have begun) and whether one begins here; without lines outside of lists of items."""
    so_far = Window.partitionBy("page", "section").orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    kind = F.col("format")
    pick = lambda a, b, c: F.when(kind == "specworks", a).when(kind == "esc", b).otherwise(c)
    text = F.col("text")
    skip = pick(text.rlike(BEGIN) | text.startswith("HEI:"), text.rlike(ESC_SKIP) | text.rlike(DOOR), ~text.rlike(GENERIC_ITEM))
    rows = rows.where("section > 0 and set_id is not null and line >= list_begins and (list_ends is null or line < list_ends)").where(~skip)
    starts = pick(text.rlike(SPECWORKS_ITEM), text.rlike(ESC_ITEM), text.rlike(GENERIC_ITEM) & F.regexp_extract(text, GENERIC_ITEM, 2).rlike(HARDWARE))
    rows = rows.withColumn("starts", starts)
    return rows.withColumn("item", F.sum(F.col("starts").cast("int")).over(so_far))


def _first(tokens: Column, test) -> Column:
    """The place (from 1) of the first token that passes, 0 if none does."""
    return F.array_position(F.transform(tokens, lambda x: F.coalesce(test(x), F.lit(False))), True)


def _words(text: Column) -> Column:
    return F.filter(F.split(text, r"\s+"), lambda x: x != "")


def _head(words: Column, n: Column) -> Column:
    """The first n words."""
    return F.slice(words, F.lit(1), F.greatest(n, F.lit(0)).cast("int"))


def _tail(words: Column, n: Column) -> Column:
    """The words after the first n."""
    return F.slice(words, n.cast("int") + 1, F.greatest(F.size(words), F.lit(1)))


def _continued(own: DataFrame) -> DataFrame:
    """Items with `maker`, and `rest`: the further lines that go on with the name.

    In the first format all do, and a maker's code ends the first line. In the second, the maker stands behind the
    reference in brackets; the next line may be the maker or end its name, and further ones count up to a note.
    """
    first, rest = F.col("first"), F.col("rest")
    own = own.withColumns({
        "marked": (F.col("format") == "esc") & first.rlike(REFERENCE), "next": F.coalesce(F.get(rest, F.lit(0)), F.lit("")),
        "maker": F.when(F.col("format") == "specworks", F.upper(F.element_at(F.split(first, r"\s+"), -1))).otherwise(F.trim(F.regexp_extract(first, r"^.*?" + REFERENCE + "(.*)$", 2))),
    })
    next_, maker = F.col("next"), F.col("maker")
    own = own.withColumn("maker", F.when((F.col("format") == "specworks") & ~maker.isin(MAKERS), "").otherwise(maker))
    named = next_.rlike("^[A-Z][a-z]") & ~next_.rlike(NO_MAKER) & (F.size(F.split(next_, r"\s+")) <= 3)
    own = own.withColumn("taken", F.col("marked") & F.when(maker == "", named).otherwise(next_.rlike(MAKER_END)))
    own = own.withColumn("rest", F.when(F.col("taken"), _tail(rest, F.lit(1))).otherwise(rest))
    own = own.withColumn("note", F.when(F.col("marked"), _first(F.col("rest"), lambda x: x.rlike(NOTE))).otherwise(0))
    own = own.withColumn("rest", F.when(F.col("note") > 0, _head(rest, F.col("note") - 1)).otherwise(rest))
    return own.withColumn("said", F.trim(F.concat_ws(" ", "maker", F.when(F.col("taken"), next_))))


def _parted(own: DataFrame) -> DataFrame:
    """Items with `name`, `model` and `finish` words: finishes end what stands before the maker or the reference; a model begins
    at the first word after the first that begins with a digit or has letters before one. Without a reference all lines are one."""
    first, words, spec = F.col("first"), F.col("words"), F.col("format") == "specworks"
    text = F.when(spec, first).when(F.col("marked"), F.regexp_extract(first, r"^(.*?)" + REFERENCE, 1)).when(F.col("format") == "esc", F.concat_ws(" ", F.concat(F.array(first), F.col("rest")))).otherwise("")
    own = own.withColumn("words", _words(text)).withColumn("words", F.when(spec & (F.col("maker") != ""), _head(words, F.size(words) - 1)).otherwise(words))
    own = own.withColumn("plain", _first(F.reverse(words), lambda x: ~x.rlike(FINISH))).withColumn("n", F.when(F.col("plain") > 0, F.col("plain") - 1).otherwise(F.size(words)))
    own = own.withColumn("n", F.when(spec, F.least("n", F.lit(1))).when(F.col("marked"), F.col("n")).otherwise(0))
    own = own.withColumns({"finish": _tail(words, F.size(words) - F.col("n")), "words": _head(words, F.size(words) - F.col("n"))})
    own = own.withColumn("at", _first(_tail(words, F.lit(1)), lambda x: x.rlike(r"^\d") | (x.rlike(r"^[A-Z]+\d") & (F.length(x) >= 3))))
    own = own.withColumn("at", F.when(F.col("at") > 0, F.col("at")).otherwise(F.size(words)))
    rest = F.when(spec | F.col("marked"), F.col("rest")).otherwise(F.array().cast("array<string>"))
    return own.withColumns({"name": F.concat(_head(words, F.col("at")), rest), "model": _tail(words, F.col("at"))})


def items(rows: DataFrame) -> DataFrame:
    """page, section, set_id, generic_id, line, qty, qty_total, name, manufacturer, model and finish of all items of sectioned lines.

    qty_total is what the first format says in brackets, else null. A line that begins no item goes on with the one
    above it in its section; one without an item above is left out.
    """
    own = _opened(rows).where("item > 0")
    line = lambda pick: F.array_sort(F.collect_list(F.when(pick, F.struct("line", "text"))))
    own = own.groupBy("page", "section", "item").agg(F.min(F.when(F.col("starts"), F.struct("line", "text", "set_id", "generic_id", "format"))).alias("_f"), line(~F.col("starts")).alias("_r"))
    own = own.select("page", "section", "_f.*", F.transform("_r", lambda x: x["text"]).alias("rest"))
    text, kind = F.col("text"), F.col("format")
    own = own.withColumn("first", F.trim(F.when(kind == "specworks", F.regexp_extract(text, SPECWORKS_ITEM, 4)).when(kind == "esc", F.regexp_extract(text, ESC_ITEM, 3)).otherwise(F.regexp_extract(text, GENERIC_ITEM, 2))))
    qty = F.when(kind == "specworks", F.regexp_extract(text, SPECWORKS_ITEM, 2)).when(kind == "esc", F.regexp_extract(text, ESC_ITEM, 1)).otherwise(F.regexp_extract(text, GENERIC_ITEM, 1))
    total = F.when(kind == "specworks", F.regexp_extract(text, SPECWORKS_ITEM, 1).cast("long"))
    own = _parted(_continued(own)).withColumn("columns", F.split("first", r"\s{2,}|\t"))
    column = lambda k: F.coalesce(F.get("columns", F.lit(k)), F.lit(""))
    name = F.regexp_replace(F.concat_ws(" ", "name"), r"^[,. ]+|[,. ]+$", "")
    fields = {"name": name, "manufacturer": F.col("said"), "model": F.concat_ws(" ", "model"), "finish": F.concat_ws(" ", "finish")}
    fields = [F.when(kind == "generic", column(k)).otherwise(x).alias(f) for k, (f, x) in enumerate(fields.items())]
    return own.select("page", "section", "set_id", "generic_id", "line", qty.cast("long").alias("qty"), total.alias("qty_total"), *fields)


def item_key(name: Column, model: Column) -> Column:
    """What makes items of a section the same: the model, else the name without abbreviations."""
    said, model = F.lower(F.trim(name)), F.lower(F.trim(model))
    spelled = lambda text: reduce(lambda c, x: F.regexp_replace(c, rf"\b{_escaped(x[0])}\b", x[1]), SHORT.items(), text)
    # spelled out are only names that have one of the abbreviations
    plain = F.when(said.rlike(ANY_SHORT), T.let(said, spelled)).otherwise(said)
    plain = F.regexp_replace(F.regexp_replace(plain, r"\s+", " "), r"^[ ,;.]+|[ ,;.]+$", "")
    return F.when(model != "", F.concat(F.lit("model:"), model)).otherwise(F.concat(F.lit("name:"), plain))


def _escaped(word: str) -> str:
    return word.replace(".", r"\.")


ANY_SHORT = rf"\b(?:{'|'.join(map(_escaped, SHORT))})\b"


def once(rows: DataFrame) -> DataFrame:
    """items without repeats in a section: of equal keys the one with most filled fields, ties to the first; in the place of the first."""
    return sets.most_complete(rows, item_key(F.col("name"), F.col("model")), ["name", "model", "manufacturer", "finish"], "line", by=("page", "section")).drop("key", "score", "line").withColumnRenamed("first", "line")


#: Fixed value: the line that describes a section's openings.
DESCRIPTION = r"(?i)^\s*opening\s+description\s*[:\-]"


def heading_map(rows: DataFrame, listed: DataFrame) -> DataFrame:
    """One row for each door number of listed doors (page, section, line, door_number and more) with the rating of its section.

    The first place of a door number in the order of pages and lines counts. Its rating is the one of the first line that
    describes openings below it in its section, null if none does; rows are sectioned lines. Doors without a number are left out.
    """
    said = rows.where(F.col("text").rlike(DESCRIPTION)).select("page", "section", "line", T.fire_rating(F.col("text")).alias("rating")).where("rating IS NOT NULL")
    plain = listed.where("door_number IS NOT NULL").withColumn("rating", F.lit(None).cast("string"))
    below = Window.partitionBy("page", "section").orderBy("line").rowsBetween(1, Window.unboundedFollowing)
    both = plain.unionByName(said, allowMissingColumns=True).withColumn("fire_rating", F.first("rating", ignorenulls=True).over(below))
    kept = [c for c in listed.columns if c != "door_number"] + ["fire_rating"]
    first = both.where("door_number IS NOT NULL").groupBy("door_number").agg(F.min_by(F.struct(*kept), F.struct("page", "line")).alias("_r"))
    return first.select("door_number", "_r.*")


def set_doors(listed: DataFrame, known: DataFrame) -> DataFrame:
    """page, section, line, door_number and set_id of doors that sections list, for known sets (set_id, generic_id, position).

    listed has page, section, line, set_id, generic_id and door_number. A section belongs to the first known set with its generic
    id, where either lacks one with its own; doors of sections without a known set are left out. A door number counts once,
    in any case, at its first place in the order of pages and lines.
    """
    match = lambda: F.coalesce(T.blank_to_null(F.col("generic_id")), F.col("set_id"))
    first = known.groupBy(match().alias("_m")).agg(F.min_by("set_id", "position").alias("_set"))
    rows = listed.withColumn("_m", match()).join(first, "_m").groupBy(F.upper("door_number").alias("_d"))
    rows = rows.agg(F.min_by(F.struct("page", "section", "line", "door_number", F.col("_set").alias("set_id")), F.struct("page", "line")).alias("_r"))
    return rows.where("_d IS NOT NULL").select("_r.*")
