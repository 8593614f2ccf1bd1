"""The few functions that built-in expressions cannot give, as vectorised UDFs."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexloom.functions import lexicons as L


def _nfc(s: pd.Series) -> pd.Series:
    return s.map(lambda t: unicodedata.normalize("NFC", t), na_action="ignore")


def _match_spans(text: str | None, words: list[str] | None) -> list[dict[str, int]]:
    """Half-open spans of the words, longest first, ignoring case, not overlapping."""
    keys = sorted({w for w in words or [] if w and w.strip()}, key=lambda w: (-len(w), w))
    if not text or not keys:
        return []
    return [{"start": m.start(), "end": m.end()} for m in re.finditer("|".join(map(re.escape, keys)), text, re.I)]


def _spans(text: pd.Series, words: pd.Series) -> pd.Series:
    return pd.Series([_match_spans(t, list(w) if w is not None else []) for t, w in zip(text, words)])


_ONSETS = re.compile("|".join(L.CONSONANTS))
_NUCLEI = re.compile("|".join(L.VOWELS))


def romanised_to_script(text: str) -> str:
    """Left to right: a consonant takes the sign of the vowel after it or the virama; other characters stay."""
    out, i = [], 0
    while i < len(text):
        onset = _ONSETS.match(text, i)
        nucleus = _NUCLEI.match(text, onset.end() if onset else i)
        if onset:
            out.append(L.CONSONANTS[onset[0]] + (L.SIGNS[nucleus[0]] if nucleus else L.VIRAMA))
            i = (nucleus or onset).end()
        elif nucleus:
            out.append(L.VOWELS[nucleus[0]])
            i = nucleus.end()
        else:
            out.append(text[i])
            i += 1
    return "".join(out)


def _script(s: pd.Series) -> pd.Series:
    return s.map(romanised_to_script, na_action="ignore")


# Types as objects: this module is imported by workers too, where no session parses them.
_SPANS = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))
nfc = F.pandas_udf(_nfc, T.StringType())  # type: ignore[call-overload]
highlight_offsets = F.pandas_udf(_spans, _SPANS)  # type: ignore[call-overload]
transliterate = F.pandas_udf(_script, T.StringType())  # type: ignore[call-overload]


def register(spark: SparkSession) -> None:
    """Make the functions callable from SQL."""
    for name, f in (("nfc", nfc), ("highlight_offsets", highlight_offsets), ("transliterate", transliterate)):
        spark.udf.register(name, f)
