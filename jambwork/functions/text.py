"""Scalar functions as columns: keys, names, ratings, hands, sizes and scores. All but one stay in generated code."""

from __future__ import annotations

import re
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


def ladder(value: Column, rules: list[tuple[str, str]], otherwise: str | None = None) -> Column:
    """The label of the first pattern that matches; order decides."""
    first, *rest = rules
    out = F.when(value.rlike(first[0]), first[1])
    for pattern, label in rest:
        out = out.when(value.rlike(pattern), label)
    return out.otherwise(F.lit(otherwise))


def let(value: Column, f) -> Column:
    """f of a value that is worked out once, however often f uses it; f is no part of generated code, which it may make too large to be compiled."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def blank_to_null(value: Column) -> Column:
    return F.nullif(F.trim(value), F.lit(""))


def set_key(value: Column) -> Column:
    """Lower case without white space, hyphens and underscores."""
    return F.regexp_replace(F.lower(value), r"[\s\-_]+", "")


def door_key(value: Column) -> Column:
    """The linkage key: trimmed, upper case, without white space."""
    return F.regexp_replace(F.upper(F.trim(value)), r"\s+", "")


def revision_key(value: Column) -> Column:
    """The revision key: the door key without leading zeros, then a letter O beside a digit as zero."""
    out = F.regexp_replace(door_key(value), "^0+", "")
    return F.regexp_replace(F.regexp_replace(out, "(?<=[0-9])O", "0"), "O(?=[0-9])", "0")


def item_name(value: Column) -> Column:
    """Lower case, without text in brackets, trailing dimensions, trailing words with digits (models and finishes) and punctuation; white space squeezed."""
    steps = [(r"\s*\([^)]*\)\s*", " "), (r'[,\s]+[0-9][0-9\-/]*"?(\s*x\s*[0-9][0-9\-/]*"?)*\s*$', ""), (r"(\s+[a-z]*[0-9][a-z0-9]*)+\s*$", ""), (r"""[,."'\s]+$""", ""), (r"\s+", " ")]
    return F.trim(reduce(lambda c, s: F.regexp_replace(c, *s), steps, F.lower(value)))


#: Abbreviations in item names, and what they stand for.
ABBREVIATIONS = {
    "cont.": "continuous", "cont": "continuous", "flr": "floor", "flr.": "floor", "w/": "with ", "w/o": "without", "mtd": "mounted", "mtd.": "mounted", "hd": "heavy duty", "hd.": "heavy duty",
    "adj": "adjustable", "adj.": "adjustable", "auto": "automatic", "auto.": "automatic", "elec": "electric", "elec.": "electric", "mag": "magnetic", "mag.": "magnetic", "mech": "mechanical", "mech.": "mechanical",
    "ss": "stainless steel", "alum": "aluminum", "alum.": "aluminum", "brz": "bronze", "brz.": "bronze", "sfc": "surface", "sfc.": "surface", "conc": "concealed", "conc.": "concealed",
    "ovhd": "overhead", "ovhd.": "overhead", "thresh": "threshold", "thresh.": "threshold",
}


def spelled_out(value: Column) -> Column:
    """An item's name in lower case with its abbreviations spelled out, word by word, without brackets and trailing punctuation."""
    words = F.split(F.trim(F.lower(value)), r"\s+")
    known = F.create_map(*(F.lit(x) for kv in ABBREVIATIONS.items() for x in kv))
    full = F.array_join(F.transform(words, lambda w: F.coalesce(F.try_element_at(known, w), w)), " ")
    return F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(full, "[()]", ""), r"\s+", " "), "[,;.]+$", ""))


#: Makers, and what of a model names its series.
SERIES = [
    ("schlage", r"^(L[0-9]{4})"), ("von duprin", r"^([0-9]{2})(?:EO|NL|L|TP|DT|-|$|\s)"), ("lcn", r"^([0-9]{4}[A-Z]*)"), ("sargent", r"^([0-9]{2,4})"), ("corbin russwin", r"^([MC]L[0-9]{4})"),
    ("adams rite", r"^([0-9]{4})"), ("securitron", r"^([A-Z][0-9]{2,3})"), ("dorma", r"^([0-9]{4})"), ("norton", r"^([0-9]{4})"),
]


def base_series(model: Column, maker: Column) -> Column:
    """A model's series: by its maker's pattern, else the first word that isn't a size, without trailing punctuation; in upper case."""
    text, own = F.trim(F.coalesce(model, F.lit(""))), F.lower(F.coalesce(maker, F.lit("")))
    size = r"""^[0-9][0-9\s\-/]*\s*[xX\u00d7]\s*[0-9]|^[0-9]+['"\u2033]"""
    known = [F.when(own.contains(m), F.nullif(F.regexp_extract(text, f"(?i){p}", 1), F.lit(""))) for m, p in SERIES]
    words = F.transform(F.filter(F.split(text, r"\s+"), lambda w: ~w.rlike(size) & w.rlike("[A-Za-z0-9]")), lambda w: F.regexp_replace(w, r"[\-,;:]+$", ""))
    return F.upper(F.coalesce(*known, F.try_element_at(F.filter(words, lambda w: w != ""), F.lit(1)), F.lit("")))


def model_key(value: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.trim(F.lower(value)), r"\s+", " "), r"[.,;:]+$", "")


def tokens(value: Column) -> Column:
    """Distinct lower-case words."""
    return F.array_distinct(F.filter(F.split(F.lower(F.coalesce(value, F.lit(""))), r"\s+"), lambda x: x != ""))


def jaccard(a: Column, b: Column) -> Column:
    """Of two token sets: 1 if both are empty, 0 if one is."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / F.greatest(union, F.lit(1)))


def door_shape(value: Column) -> Column:
    """Runs of letters as L and of digits as D, other characters as they are."""
    marks = F.regexp_replace(F.regexp_replace(value, r"\p{L}+", "\u0001"), r"[0-9]+", "\u0002")
    return F.translate(marks, "\u0001\u0002", "LD")


def hand(value: Column) -> Column:
    """RH or LH from the first hand token; null if there is none."""
    return F.nullif(F.regexp_extract(F.upper(value), r"\b([RL]H)(RA?)?\b", 1), F.lit(""))


#: A rating of up to three digits of minutes, or of one to three hours.
RATING = r"(?i)\b(\d{1,3}\s*min(?:ute)?s?|[123](?:\.5)?\s*h(?:ou)?rs?)\b"


def fire_rating(value: Column) -> Column:
    """The first rating in minutes or hours of a text, as it stands there but in capitals; null if there is none."""
    return F.nullif(F.regexp_extract(F.upper(value), RATING, 1), F.lit(""))


def without_rating(value: Column) -> Column:
    """A text without its first rating."""
    at = F.regexp_instr(value, F.lit(RATING))
    return F.when(at > 0, F.trim(F.concat(F.substr(value, F.lit(1), at - 1), F.substr(value, at + F.length(F.regexp_substr(value, F.lit(RATING))))))).otherwise(value)


def fire_rated(value: Column) -> Column:
    """False for blank, n/a and none."""
    return ~F.lower(F.trim(F.coalesce(value, F.lit("")))).isin("", "n/a", "none")


def flag(value: Column) -> Column:
    """True, false, or null for what is neither."""
    v = F.lower(F.trim(value))
    return F.when(v.isin("true", "1", "yes"), True).when(v.isin("false", "0", "no"), False)


def opening_size(value: Column) -> Column:
    """(width, height) in inches of a text that holds 3'0" x 7'0", or is 3070 or 30100, 36 x 84, or 914 x 2134 in millimetres; null if nothing fits.

    Digits alone count if they are 20 to 120 by 60 to 144 inches; of five digits the first three are the width.
    Plain numbers count from 20 to 144 by 60 to 144, or as millimetres if both are 300 or more.
    """
    value = F.trim(value)
    part = lambda pattern, *i: [F.try_to_number(F.nullif(F.regexp_extract(value, pattern, k), F.lit("")), F.lit("99999")) for k in i]
    a, b, c, d = part(r"""(\d+)\s*'\s*[-\s]?\s*(\d{1,2})?\s*"?\s*[x×X*]\s*(\d+)\s*'\s*[-\s]?\s*(\d{1,2})?\s*"?""", 1, 2, 3, 4)
    e, f, g, h = part(r"^(\d{1,2})(\d)(\d)(\d)$", 1, 2, 3, 4)
    m, n = part(r"""^(\d{2,4})\s*"?\s*[x×X*]\s*(\d{2,4})\s*"?$""", 1, 2)
    size = lambda w, h: F.struct(w.cast("double").alias("width"), h.cast("double").alias("height"))
    none, width, height = F.lit(0), 12 * e + f, 12 * g + h
    out = F.when(a.isNotNull() & c.isNotNull(), size(12 * a + F.coalesce(b, none), 12 * c + F.coalesce(d, none))).when(width.between(20, 120) & height.between(60, 144), size(width, height))
    return out.when((m >= 300) & (n >= 300), size(F.round(m / 25.4, 1), F.round(n / 25.4, 1))).when(m.between(20, 144) & n.between(60, 144), size(m, n))


def level(score: Column) -> Column:
    return F.when(score.isNull(), "unverified").when(score >= 0.85, "high").when(score >= 0.6, "medium").otherwise("low")


#: Hours within which an issue of a severity is due.
SLA_HOURS = {"critical": 4, "high": 24, "medium": 72, "low": 168}


def due(created: Column, severity: Column) -> Column:
    hours = reduce(lambda c, x: c.when(severity == x[0], x[1]), SLA_HOURS.items(), F.when(F.lit(False), 0))
    return created + F.make_interval(hours=hours)


def rounded(value: Column) -> Column:
    """Halves up, also for negative numbers."""
    return F.floor(value + 0.5).cast("long")


def percent(part: Column, whole: Column) -> Column:
    """A whole percentage; 0 of nothing."""
    return F.when(whole == 0, F.lit(0).cast("long")).otherwise(rounded(100 * part / F.greatest(whole, F.lit(1))))


def token_overlap(a: Column, b: Column) -> Column:
    """How many words of one text the other has, by the larger number of words; 0 if either has none."""
    words = lambda c: F.filter(F.split(F.trim(F.regexp_replace(F.lower(c), "[^a-z0-9]+", " ")), r"\s+"), lambda x: x != "")
    x, y = words(a), words(b)
    most = F.greatest(F.size(x), F.size(y))
    return F.when((F.size(x) == 0) | (F.size(y) == 0), F.lit(0.0)).otherwise(F.size(F.filter(x, lambda t: F.array_contains(y, t))) / F.greatest(most, F.lit(1)))


def mail_domain(address: Column) -> Column:
    return F.lower(F.split_part(address, F.lit("@"), F.lit(2)))


def first_quantity(answer: Column) -> Column:
    """The number that an answer begins with; null if there is none or it isn't positive."""
    n = F.regexp_extract(F.trim(answer), "^([0-9]+)", 1).try_cast("bigint")
    return F.when(n > 0, n)


#: Least width of a pair's opening, in inches.
PAIR_WIDTH = 48.0


def pair_signal(leaf_named: Column, leaves: Column, doors: Column, door_type: Column, location: Column, heading: Column) -> Column:
    """The tier that says that an opening is a pair: rows named by leaf, more leaves than doors, a width, or a word; none if nothing does."""
    wide = lambda c: F.coalesce(opening_size(c)["width"] >= PAIR_WIDTH, F.lit(False))
    low, kind = F.lower(F.coalesce(heading, F.lit(""))), F.lower(F.coalesce(door_type, F.lit("")))
    word = low.contains("pair") | low.contains("double") | kind.contains("pr") | kind.contains("pair")
    more = (F.coalesce(doors, F.lit(0)) >= 1) & (F.coalesce(leaves, F.lit(0)) > F.coalesce(doors, F.lit(0)))
    return F.when(leaf_named >= 2, "primary").when(more, "secondary").when(wide(door_type) | wide(location) | wide(heading), "tertiary").when(word, "quaternary").otherwise("none")


def described_rating(line: Column) -> Column:
    """The rating in a line that describes an opening; empty for other lines."""
    rating = F.regexp_extract(line, r"(?i)\b([0-9]+(?:\.[0-9])?\s*(?:MIN(?:UTE)?S?|HR|HOURS?))\b", 1)
    return F.when(line.rlike(r"(?i)^\s*Opening\s+Description"), rating).otherwise("")


def detected_field(text: Column) -> Column:
    """(field, value, confidence in hundredths) of a piece of text: a hand or a rating as a whole, a place with a hand after it, or a place."""
    t = F.trim(F.coalesce(text, F.lit("")))
    row = lambda f, v, c: F.struct(F.lit(f).alias("field"), v.alias("value"), F.lit(c).alias("confidence"))
    place = F.trim(F.regexp_extract(t, r"(?i)^(.*\S)\s+(?:RHRA|LHRA|RHR|LHR|RH|LH)$", 1))
    return F.when(t == "", row("unknown", F.lit(""), 0)).when(t.rlike("(?i)^(RHRA|LHRA|RHR|LHR|RH|LH)$"), row("hand", F.upper(t), 95)).when(t.rlike(r"(?i)^[0-9]+(\.[0-9])?\s*(MIN(UTE)?S?|HR|HOURS?)$"), row("fire_rating", t, 90)).when(place != "", row("location", place, 70)).otherwise(row("location", t, 40))


#: Sequences of wrongly decoded text and what they stand for; longer ones are replaced first.
WRONGLY_DECODED = {
    "\u00c2\u00b7": "\u00b7", "\u00c3\u0097": "\u00d7", "\u00c3\u00b7": "\u00f7", "\u00c2\u00bd": "\u00bd", "\u00c2\u00bc": "\u00bc", "\u00c2\u00be": "\u00be", "\u00c2\u00ae": "\u00ae", "\u00c2\u00a9": "\u00a9", "\u00c2\u00b0": "\u00b0",
    "\u00e2\u0080\u0093": "\u2013", "\u00e2\u0080\u0094": "\u2014", "\u00e2\u0080\u0099": "\u2019", "\u00e2\u0080\u0098": "\u2018", "\u00e2\u0080\u009c": "\u201c", "\u00e2\u0080\u009d": "\u201d", "\u00e2\u0080\u00a2": "\u2022", "\u00e2\u0080\u00a6": "\u2026", "\u00e2\u0080": "\u2014",
    "\u00c3\u00a0": "\u00e0", "\u00c3\u00a4": "\u00e4", "\u00c3\u00a8": "\u00e8", "\u00c3\u00a9": "\u00e9", "\u00c3\u00ad": "\u00ed", "\u00c3\u00b3": "\u00f3", "\u00c3\u00b6": "\u00f6", "\u00c3\u00ba": "\u00fa", "\u00c3\u00bc": "\u00fc", "\u00c3\u00b1": "\u00f1", "\u00c3\u00a7": "\u00e7", "\u00c2\u00a0": " ",
    "\x91": "\u2018", "\x92": "\u2019", "\x93": "\u201c", "\x94": "\u201d", "\x95": "\u2022", "\x96": "\u2013", "\x97": "\u2014", "\x85": "\u2026", "\x99": "\u2122", "\xa0": " ",
    "\u00c3\u00a2\u00e2\u201a\u00ac\u00e2\u20ac\u0153": "\u2013", "\u00c3\u00a2\u00e2\u201a\u00ac\u00e2\u20ac": "\u2014", "\u00c3\u00a2\u00e2\u201a\u00ac\u00c2\u00a2": "\u2022", "\u00c3\u00a2\u00e2\u201a\u00ac\u00c5\u201c": "\u201c", "\u00c3\u00a2\u00e2\u201a\u00ac\u0178": "\u201d",
    "\u00e0\u2016": "\u2013", "\u00e0\u00a1": "!", "\u00e0\u00a2": '"', "\u00e0\u00a8": "(", "\u00e0\u00a9": ")", "\u00e0\u00ab": "+", "\u00e0\u00ac": ",", "\u00e0\u00ad": "-", "\u00e0\u00ae": ".", "\u00e0\u00af": "/", "\u00e0\u00ba": ":",
    "\ufb01": "fi", "\ufb02": "fl", "\ufb00": "ff", "\ufb03": "ffi", "\ufb04": "ffl",
}
_WRONG = re.compile("|".join(map(re.escape, sorted(WRONGLY_DECODED, key=len, reverse=True))))


@F.pandas_udf(StringType())
def _repaired(texts: pd.Series) -> pd.Series:
    """Texts with wrongly decoded sequences replaced, in compatibility composition; null stays null."""
    return texts.str.replace(_WRONG, lambda m: WRONGLY_DECODED[m[0]], regex=True).str.normalize("NFKC")


def clean_cell(value: Column) -> Column:
    """A cell's text: wrongly decoded sequences mended, composed for compatibility, without control characters (but tab and
    line ends) and glyph marks; double bars are spaces, spaces are single, and dashes at the end are dropped. Null is empty.

    Only texts with characters outside ASCII go to Python: a branch keeps no row from it, so others are null there.
    """
    value = F.coalesce(value, F.lit(""))
    text = F.coalesce(_repaired(F.when(value.rlike(r"[^\x00-\x7F]"), value)), value)
    steps = [(r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]", ""), (r"\(cid:\d+\)", ""), ("[\u2016\u2551]", " "), (r"  +", " "), (r"^\s+|\s+$", ""), ("[\u2014\u2013\u2012-]+$", "")]
    return reduce(lambda c, s: F.regexp_replace(c, *s), steps, text)


#: Marks of a leaf before and after a value, and of a column before it.
LEAF_BEFORE, LEAF_AFTER, COLUMN_MARK = r"^(?:[RL]\)[\s\n]*)+", r"\s+[RL]\)\s*$", r"^x(?:\s+|$)"


def without_marks(field: Column, value: Column) -> Column:
    """A value read for a field, trimmed and without marks of leaves and columns; door numbers and other fields are only trimmed. Null is empty."""
    text = F.regexp_replace(F.coalesce(value, F.lit("")), r"^\s+|\s+$", "")
    strip = lambda *patterns: reduce(lambda c, p: F.regexp_replace(c, p, ""), patterns, text)
    out = F.when(field == "fire_rating", strip(COLUMN_MARK, LEAF_BEFORE)).when(field == "location", strip(LEAF_BEFORE, LEAF_AFTER)).when(field == "hand", strip(LEAF_BEFORE, COLUMN_MARK))
    return F.regexp_replace(out.otherwise(text), r"^\s+|\s+$", "")
