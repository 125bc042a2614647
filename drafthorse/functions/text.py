"""Column functions on strings, and the two UDFs that Spark has no function for."""

from __future__ import annotations

import json
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

# Shapes of marker codes, and the words that tell a fence from a gate.
CODE = r"^[A-Za-z]{0,3}[-.]?\d{1,4}[A-Za-z]?$"
TOKEN = r"^[A-Za-z]{1,3}$"
MARKER_SHAPE = r"^(?:[A-Za-z]{0,3}[-.]?\d{1,4}[A-Za-z]?|[A-Za-z]{1,3}|\d{1,4}[A-Za-z]{1,3})$"
KEYWORD = r"(?i)fenc|chain[ -]?link"
FENCE = r"(?i)\b(?:FENC(?:E[DS]?|ING)|FENCELINES?)\b"
GATE = r"(?i)\bGATES?\b"
TITLE = r"(?i)\b(?:DETAIL|ELEVATION)\s*$"
REJECTED_LABELS = ("view title", "note", "legend entry")


def upper(c: Column) -> Column:
    return F.upper(F.replace(c, F.lit("ß"), F.lit("ss")))


def norm_text(c: Column) -> Column:
    """White space collapsed to single blanks, trimmed, upper case."""
    return upper(F.trim(F.regexp_replace(c, r"\s+", " ")))


def norm_code(c: Column) -> Column:
    return upper(F.regexp_replace(c, r"\s+", ""))


def norm_value(c: Column) -> Column:
    """Lower case letters and digits; a single o is 0, a single i or l is 1."""
    v = F.regexp_replace(F.lower(c), "[^a-z0-9]", "")
    return F.when(v == "o", "0").when(v.isin("i", "l"), "1").otherwise(v)


def words(c: Column) -> Column:
    return F.regexp_extract_all(upper(c), F.lit("([A-Z0-9]+)"), F.lit(1))


def preview(c: Column, n: int = 60) -> Column:
    return F.left(c, F.lit(n))


def slugify(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def is_gate(c: Column) -> Column:
    return c.rlike(GATE) & ~c.rlike(FENCE)


def row_code(c: Column) -> tuple[Column, Column]:
    """(major, minor) of `12.3`, null for anything else."""
    whole = c.rlike(r"^\d{1,3}\.\d{1,3}$")
    part = lambda k: F.when(whole, F.split_part(c, F.lit("."), F.lit(k)).cast("int"))
    return part(1), part(2)


def placement_key(c: Column) -> tuple[Column, Column]:
    """(symbol, placement) of `s3:0`."""
    get = lambda k: F.nullif(F.regexp_extract(c, r"^s(\d+):(\d+)$", k), F.lit("")).cast("int")
    return get(1), get(2)


def fnv1a(c: Column) -> Column:
    """32-bit FNV-1a of the bytes of a string."""
    octets = F.transform(F.sequence(F.lit(1), F.octet_length(c)), lambda i: F.conv(F.substring(F.hex(c.cast("binary")), 2 * i - 1, F.lit(2)), 16, 10).cast("long"))
    fold = F.aggregate(octets, F.lit(2166136261).cast("long"), lambda h, b: (h.bitwiseXOR(b) * 16777619) % 4294967296)
    return F.when(F.octet_length(c) > 0, fold).when(c.isNotNull(), F.lit(2166136261).cast("long"))


@F.pandas_udf(StringType())
def text_token(s: pd.Series) -> pd.Series:
    """NFKC, white space collapsed, trimmed, upper case."""
    return s.map(lambda v: None if v is None else " ".join(unicodedata.normalize("NFKC", v).split()).upper())


def _top_level(body: str) -> list[str]:
    """What stands between the commas of an array's own level, up to its bracket or the end of the text."""
    parts, begin, deep, quoted, skip = [], 0, 0, False, False
    for i, c in enumerate(body):
        if skip:
            skip = False
        elif quoted:
            quoted, skip = c != '"', c == "\\"
        elif c == '"':
            quoted = True
        elif c in "[{":
            deep += 1
        elif c in "]}" and deep:
            deep -= 1
        elif c == "]" or (c == "," and not deep):
            parts.append(body[begin:i])
            begin = i + 1
            if c == "]":
                return parts
    return [*parts, body[begin:].rstrip("` \r\n\t")]


@F.pandas_udf(ArrayType(StringType()))
def recover_json_array(s: pd.Series) -> pd.Series:
    """The complete elements of a JSON array in a reply that may be fenced, wrapped in words, or cut off.

    Elements come back as JSON text; the first one that is not JSON ends the list. No array: an empty list.
    """

    def whole(raw: str) -> list[str]:
        found = []
        for part in _top_level(raw.partition("[")[2]):
            if part.strip():
                try:
                    found.append(json.dumps(json.loads(part), sort_keys=True, ensure_ascii=False))
                except json.JSONDecodeError:
                    break
        return found

    return s.map(lambda v: None if v is None else whole(v))
