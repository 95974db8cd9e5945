"""Text columns: flattened arguments, the detection view, decoded blobs, clauses."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import StringType

from . import lexicon as L

ARGS = "array<struct<k:string,v:string>>"


def flat_args(args: Column) -> Column:
    """``k=v`` of all arguments in their order, joined by blanks; '' for none."""
    return F.coalesce(F.array_join(F.transform(args, lambda a: F.concat(a["k"], F.lit("="), F.coalesce(a["v"], F.lit("None")))), " "), F.lit(""))


def beyond_ascii(text: Column) -> Column:
    """Whether a text holds other than ASCII signs."""
    return F.octet_length(text) != F.length(text)


def strip_invisible(text: Column) -> Column:
    return F.when(beyond_ascii(text), F.regexp_replace(text, L.INVISIBLE, "")).otherwise(text)


def has_hidden(text: Column) -> Column:
    return text.rlike(L.HIDDEN)


@F.pandas_udf(StringType())
def _fold(text: pd.Series) -> pd.Series:
    return text.map(L.normalize, na_action="ignore")


def with_view(df: DataFrame, column: str, into: str, squeeze: bool = True, guarded: bool = False) -> DataFrame:
    """Adds the detection view of a text column (``squeeze=False``: letter-spacing is left).

    guarded: look for what is to be replaced first, which is faster over whole texts but makes a larger
    plan.

    Texts whose signs all fold one to one stay in the JVM; only others reach the Arrow UDF, which
    gets null for the rest.  Each step is a column of its own, so nothing is computed twice.
    """
    bare, odd, rest = f"_{into}_bare", f"_{into}_odd", f"_{into}_rest"
    df = df.withColumn(bare, strip_invisible(F.col(column)))
    # what is left without ASCII and the simple signs; a character class of them would be slow
    strange = F.translate(F.regexp_replace(bare, r"[\x00-\x7F]+", ""), "".join(L.SIMPLE), "") != ""
    df = df.withColumn(odd, F.when(beyond_ascii(F.col(bare)), F.when(strange, F.col(column))))
    df = df.withColumn(rest, _fold(F.col(odd)))
    simple = F.when(beyond_ascii(F.col(bare)), F.translate(bare, "".join(L.SIMPLE), "".join(L.SIMPLE.values()))).otherwise(F.col(bare))
    view = F.coalesce(F.col(rest), simple)
    if not squeeze:
        return df.withColumn(into, view).drop(bare, odd, rest)
    if not guarded:
        return df.withColumn(into, collapse(view)).drop(bare, odd, rest)
    raw = f"_{into}_raw"
    return with_collapsed(df.withColumn(raw, view), raw, into).drop(raw, bare, odd, rest)


def _closed(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)(?:\b(?=(?:\w[ \t]){3,}\w\b)|(?!^)\G)(\w)(?: |(\t))(?=\w\b)", "$1$2")


def collapse(text: Column) -> Column:
    """Undo letter-spacing, then squeeze blanks."""
    return F.regexp_replace(_closed(text), r"[ \t]{2,}", " ")


def close_up(text: Column) -> Column:
    """Undo letter-spacing; most texts have no single letters in a row."""
    return F.when(text.rlike(r"\S[ \t]\S[ \t]\S[ \t]\S"), _closed(text)).otherwise(text)


def one_blank(text: Column) -> Column:
    """Squeeze blanks."""
    return F.when(F.contains(text, F.lit("  ")) | F.contains(text, F.lit("\t")), F.regexp_replace(text, r"[ \t]{2,}", " ")).otherwise(text)


def with_collapsed(df: DataFrame, column: str, into: str) -> DataFrame:
    """``collapse`` that looks first; a column for each step, as in with_view."""
    close = f"_{into}_close"
    return df.withColumn(close, close_up(F.col(column))).withColumn(into, one_blank(F.col(close))).drop(close)


@F.pandas_udf(StringType())
def _nfkc(text: pd.Series) -> pd.Series:
    return text.map(lambda x: unicodedata.normalize("NFKC", x), na_action="ignore")


def _utf8(b: Column) -> Column:
    """Bytes as text, without what is no UTF-8."""
    return F.replace(F.make_valid_utf8(b.cast("string")), F.lit("�"), F.lit(""))


def with_scanned(df: DataFrame, column: str, into: str) -> DataFrame:
    """Adds a text for the secret scan: compatibility forms without signs that split words, and what
    its first base64 and hex runs decode to, after a blank."""
    text, wide, b64, hexa = (f"_{into}_{x}" for x in ("text", "wide", "b64", "hex"))
    df = df.withColumn(wide, _nfkc(F.when(F.col(column).rlike(r"[^\x00-\x7F]"), F.col(column))))
    df = df.withColumn(text, F.regexp_replace(F.coalesce(wide, column), L.EGRESS_INVISIBLE, "")).drop(wide)
    window = F.substring(text, 1, L.WINDOW)

    def runs(pattern):
        return F.slice(F.regexp_extract_all(window, F.lit(pattern), F.lit(0)), 1, L.BLOBS)

    df = df.withColumn(b64, F.transform(runs(L.BASE64), lambda m: _utf8(F.try_to_binary(F.concat(m, F.repeat(F.lit("="), F.pmod(-F.length(m), F.lit(4)))), F.lit("base64")))))
    df = df.withColumn(hexa, F.transform(runs(L.HEX), lambda m: _utf8(F.unhex(m))))
    extra = F.array_join(F.concat(b64, hexa), " ")
    return df.withColumn(into, F.when(extra != "", F.concat(F.col(text), F.lit(" "), extra)).otherwise(F.col(text))).drop(text, b64, hexa)


def clause(window: Column) -> Column:
    """The start of a 200-sign window up to a sentence's end (from the seventh sign), at most 120."""
    w = F.substring(window, 1, 200)
    at = [F.when(F.locate(sep, w, 7) > 0, F.locate(sep, w, 7) - 1) for sep in L.CLAUSE_ENDS]
    return F.substring(w, F.lit(1), F.least(F.least(*at), F.length(w), F.lit(120)))
