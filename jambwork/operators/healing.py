"""Fields of items mended: words with spaces in them, fields cut at the wrong column, all fields in one.

Each row is mended by itself, so nothing moves; words are folded in Arrow batches, once for equal texts. Null
fields are empty, and white space between words becomes one space.
"""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from jambwork.operators.grammar import FINISH

#: Short words that are no fragments, makers' abbreviations, and what ends a line but is no maker or finish.
WHOLE_WORDS = ["to", "in", "of", "or", "by", "an", "at", "on", "is", "it", "as", "no", "so", "up", "if", "we", "be", "do", "he", "me", "us", "am", "my"]
NO_MAKER = ["RH", "LH", "RHR", "LHR", "RHRA", "RHA", "LHA", "MISC", "B/O'S", "B/O’S", "HIMM", "SUPPLIER"]
NO_FINISH = r"""^\d+['"”″]|^CON-\w+|^\d+FP$"""
BY_OTHERS = r"(?i)\b(by\s*o\s*thers|by\s*door\s*supplier|by\s*supplier|by\s*security|not\s*used|not\s*in\s*contract|no\s*hardware|b\s*y\s*o\b)\b"
FIELDS = ["name", "manufacturer", "model", "finish"]


def _words(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), r"\s+"), lambda x: x != "")


_LETTER = ("Lu", "Ll", "Lt", "Lm", "Lo")


def _healer():
    """The function of texts; what it calls lies within it, so that workers need none of these modules."""

    def fragment(last: str, token: str) -> bool:
        words = token.lower() in WHOLE_WORDS or last.lower() in WHOLE_WORDS
        return unicodedata.category(token[0]) == "Ll" and token != "x" and not words and (len(last) <= 3 or len(token) <= 3)

    def whole(text: str) -> str:
        got, out, kept = [], [], ""
        for t in filter(None, re.split(r"[ \t\n\x0b\f\r]+", text)):
            if got and fragment(got[-1], t):
                got[-1] += t
            else:
                got.append(t)
        for t, follows in zip(got, [*got[1:], ""], strict=False):
            token, kept = kept + t, ""
            if len(token) == 1 and unicodedata.category(token) in _LETTER and token.lower() != "x":
                if follows and unicodedata.category(follows[0]) in _LETTER:
                    kept = token
                    continue
                if out and unicodedata.category(out[-1][-1]) in _LETTER:
                    out[-1] += token
                    continue
            out.append(token)
        return " ".join(out)

    def healed(texts: pd.Series) -> pd.Series:
        return texts.map({t: whole(t) for t in texts.unique()})  # equal texts of a batch once

    return F.pandas_udf(healed, StringType())


def healed(text: Column) -> Column:
    """A text whose broken words are whole again.

    A token that begins in lower case goes on with the one before it if either has three letters at most and neither is a
    short word of its own; then single letters (but x) go to the next word, or at the end to the last.
    """
    return _healer()(F.coalesce(text, F.lit("")))


def reassembled(items: DataFrame, makers: list[str]) -> DataFrame:
    """items whose fields were cut at the wrong columns have all of it in their name again.

    Signs of that: a maker that begins in lower case or is a fragment of two letters, a finish with lower case that is no
    finish, a model of two characters that is no number. A known maker with a model is taken as it is.
    """
    name, maker, model, finish = (F.trim(F.coalesce(F.col(f), F.lit(""))) for f in FIELDS)
    lower, known = maker.rlike(r"^\p{Ll}"), F.upper(maker).isin(makers)
    right = known & (F.length(model) > 2) & ((name == "") | ~lower)
    cut = F.when(maker != "", lower | ((F.length(maker) <= 2) & ~known)).otherwise(False) | (finish.rlike("[a-z]") & ~finish.rlike(FINISH)) | ((model != "") & (F.length(model) <= 2) & ~model.rlike(r"^\d+$"))
    blank = lambda x: F.nullif(x, F.lit(""))
    begin = F.when(lower, F.concat(name, maker)).otherwise(F.concat_ws(" ", name, blank(maker)))
    text = F.trim(F.regexp_replace(F.concat_ws(" ", begin, blank(model), blank(finish)), r"\s+", " "))
    cut = cut & ~right
    return items.withColumns({"name": F.when(cut, text).otherwise(F.col("name"))} | {f: F.when(cut, "").otherwise(F.col(f)) for f in FIELDS[1:]})


def split_fields(items: DataFrame, makers: list[str]) -> DataFrame:
    """items that have all in their name with maker, finish, name and model in their own fields.

    From the right: a maker's abbreviation, then a finish; from the left the words without digits are the name, of
    which there is one at least, and the rest is the model. What others supply stays as it is.
    """
    plain = F.coalesce(F.greatest(*(F.length(F.trim(f)) for f in FIELDS[1:])), F.lit(0)) == 0
    words = F.col("_w")
    rows = items.withColumn("_w", _words(F.col("name")))
    rows = rows.withColumn("_on", plain & ~F.coalesce(F.col("name").rlike(BY_OTHERS), F.lit(False)) & (F.size(words) >= 2))
    cut = lambda yes: F.when(yes, F.slice(words, F.lit(1), F.greatest(F.size(words) - 1, F.lit(0)))).otherwise(words)
    last = F.coalesce(F.get(words, F.size(words) - 1), F.lit(""))
    made = F.upper(last).isin(makers) & ~F.upper(last).isin(NO_MAKER)
    rows = rows.withColumn("_maker", F.when(made, last).otherwise("")).withColumn("_w", cut(F.col("_maker") != ""))
    done = last.rlike(FINISH) & ~last.rlike(NO_FINISH)
    rows = rows.withColumn("_finish", F.when(done, last).otherwise("")).withColumn("_w", cut(F.col("_finish") != ""))
    number = F.array_position(F.transform(words, lambda x: x.rlike(r"\d")), True)
    rows = rows.withColumn("_at", F.when(number > 0, F.greatest(number - 1, F.lit(1))).otherwise(F.size(words)).cast("int"))
    size = F.greatest(F.size(words), F.lit(1))
    rows = rows.withColumns({"_name": F.array_join(F.slice(words, F.lit(1), F.greatest("_at", F.lit(0))), " "), "_model": F.array_join(F.slice(words, F.col("_at") + 1, size), " ")})
    on = F.col("_on") & (F.concat("_model", "_maker", "_finish") != "")
    new = dict(zip(FIELDS, ("_name", "_maker", "_model", "_finish"), strict=True))
    return rows.withColumns({f: F.when(on, F.col(c)).otherwise(F.col(f)) for f, c in new.items()}).drop("_w", "_on", "_maker", "_finish", "_at", "_name", "_model")


def mended(items: DataFrame, makers: list[str]) -> DataFrame:
    """items (name, manufacturer, model, finish) with fields put together, words healed and fields split again, in this order."""
    rows = reassembled(items, makers)
    return split_fields(rows.withColumn("name", healed(F.col("name"))), makers)
