"""The normalisation tiers as Column expressions. Only texts that NFC can change visit Python, in Arrow batches."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quotewright.functions.spec import ALEFS, ARABIC, KASHIDA, LOSSY, MARKS, TIERS

#: What Python's \\s matches, as a class for Java's regular expressions.
SPACES = "[\\s\\x{1c}-\\x{1f}\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]+"


#: A class that holds every code point which NFC may change or join with a neighbour, and few others; a short class,
#: since the JVM tries its ranges one after another.
COMPOSABLE = "[\\p{M}\\x{370}-\\x{38f}\\x{900}-\\x{11ff}\\x{1f00}-\\x{2001}\\x{2126}-\\x{232a}\\x{2adc}\\x{f900}-\\x{fb4f}\\x{1d100}-\\x{1d1ff}\\x{2f800}-\\x{2fa1f}]"


@F.pandas_udf(T.StringType())
def _nfc(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else unicodedata.normalize("NFC", t))


@F.pandas_udf(T.StringType())
def _nfkd(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else unicodedata.normalize("NFKD", t))


def nfc(text: Column) -> Column:
    """NFC; a text that is in NFC already stays in the JVM."""
    return F.coalesce(_nfc(F.when(text.rlike(COMPOSABLE), text)), text)


def nfkd(text: Column) -> Column:
    """NFKD; ASCII stays in the JVM."""
    return F.coalesce(_nfkd(F.when(text.rlike("[^\\x{0}-\\x{7f}]"), text)), text)


def squeeze(text: Column) -> Column:
    """Runs of white space as one space, none at the ends."""
    return F.trim(F.regexp_replace(text, SPACES, " "))


def _class(ranges: list[tuple[int, int]]) -> str:
    return "[" + "".join(f"\\x{{{a:x}}}-\\x{{{b:x}}}" for a, b in ranges) + "]"


def folded(text: Column, tier: str) -> Column:
    """The tier of a text that is in NFC."""
    if tier not in TIERS:
        raise ValueError(f"unknown tier {tier!r}; expected one of {TIERS}")
    out = F.replace(text, F.lit(KASHIDA), F.lit(""))
    if tier != "light":
        out = F.translate(F.regexp_replace(out, _class(MARKS), ""), *ALEFS)
    if tier == "aggressive":
        out = F.regexp_replace(F.translate(out, *LOSSY), f"[^\\x{{{ARABIC[0]:x}}}-\\x{{{ARABIC[1]:x}}}]", " ")
    return squeeze(out)


def normalize(text: Column, tier: str) -> Column:
    """The text at a tier. Null stays null; an unknown tier raises ValueError when the plan is made."""
    if tier not in TIERS:
        raise ValueError(f"unknown tier {tier!r}; expected one of {TIERS}")
    return folded(nfc(text), tier)


def tiers(df, text: str, prefix: str = "norm_"):
    """df with all three tiers of a column, NFC worked out once."""
    plain = df.withColumn("_nfc", nfc(F.col(text)))
    return plain.withColumns({f"{prefix}{t}": folded(F.col("_nfc"), t) for t in TIERS}).drop("_nfc")
