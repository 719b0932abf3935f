"""Names: normal form, comparison key, validity, keyed tokens."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Blanks as Python's str.split() has them.
BLANKS = r"[\s\x1c-\x1f\x85\p{Z}]+"


def tidy(text: Column) -> Column:
    """Runs of blanks become one space, none at the ends."""
    return F.trim(F.regexp_replace(text, BLANKS, " "))


def _key(name: str) -> str:
    plain = "".join(c for c in unicodedata.normalize("NFKD", name).upper() if not unicodedata.combining(c))
    return " ".join(re.sub(r"[\W_]", " ", plain).split())


def _each(names: pd.Series, change) -> pd.Series:
    """Change each distinct value once."""
    known = {x: change(x) for x in names.dropna().unique()}
    return names.map(known).astype(object).where(names.notna(), None)


def _plain() -> tuple[str, str]:
    """The characters below U+0250 and the combining marks after them whose key is one character or none: those, and their keys, the ones without last."""
    keys = {chr(c): re.sub(r"[\W_]", " ", "".join(x for x in unicodedata.normalize("NFKD", chr(c)).upper() if not unicodedata.combining(x))) for c in [*range(1, 0x250), *range(0x300, 0x370)]}
    one = sorted((c for c, k in keys.items() if len(k) <= 1), key=lambda c: (-len(keys[c]), c))
    return "".join(one), "".join(keys[c] for c in one)


#: Characters whose keys don't need Python, as each stands for itself, and the keys of the first of them; the rest have none.
PLAIN, PLAIN_KEYS = _plain()


@F.pandas_udf(StringType())
def _normalize_any(names: pd.Series) -> pd.Series:
    return _each(names, lambda x: " ".join(unicodedata.normalize("NFC", x).split()))


@F.pandas_udf(StringType())
def _key_any(names: pd.Series) -> pd.Series:
    return _each(names, _key)


def _column(name: Column | str) -> Column:
    return F.col(name) if isinstance(name, str) else name


def _ascii(text: Column) -> Column:
    return F.octet_length(text) == F.length(text)


def normalize_name(name: Column | str) -> Column:
    """Unicode NFC, blanks tidied. Null stays null. Characters below U+0300 are in normal form as they are; only texts with others go through Python."""
    name = _column(name)
    other = F.when(_ascii(name), False).otherwise(name.rlike(r"[^\x{0}-\x{2ff}]"))
    return F.when(other, _normalize_any(F.when(other, name))).otherwise(tidy(name))


def name_key(name: Column | str) -> Column:
    """Letters without accents in upper case; all but letters, digits and their like becomes a space. Null stays null.

    Each character stands for itself: those of ``PLAIN`` are translated, only texts with others go through Python.
    """
    name = _column(name)
    other = F.when(_ascii(name), False).otherwise(F.translate(name, PLAIN, "") != "")
    plain = F.trim(F.regexp_replace(F.translate(name, PLAIN, PLAIN_KEYS), " +", " "))
    return F.when(_ascii(name), plain_name_key(name)).when(other, _key_any(F.when(other, name))).otherwise(plain)


def plain_name_key(name: Column) -> Column:
    """``name_key`` for text known to be ASCII, without Python."""
    return F.trim(F.regexp_replace(F.upper(name), "[^A-Z0-9]+", " "))


def query_name(name: Column, mode: str = "full") -> Column:
    """What a predictor is asked: the whole normal name in upper case, or its first word. An empty name is an error."""
    if mode not in ("full", "first"):
        raise ValueError(f"unknown name mode: {mode}")
    clean = F.upper(normalize_name(name))
    checked = F.when(clean == "", F.raise_error(F.lit("empty name")).cast("string")).otherwise(clean)
    return F.split(checked, " ")[0] if mode == "first" else checked


def valid_name(name: Column) -> Column:
    """Not empty, in upper case, and of letters, marks, spaces and . ' - ’ only."""
    return F.coalesce((name == F.upper(name)) & name.rlike("^[\\p{L}\\p{Mn} .'’-]+$"), F.lit(False))


def hmac_token(name: Column, key: bytes) -> Column:
    """HMAC-SHA256 of a name, in hex, from Spark's own SHA-256."""
    import hashlib

    key = (hashlib.sha256(key).digest() if len(key) > 64 else key).ljust(64, b"\0")
    pad = lambda b: F.lit(bytes(x ^ b for x in key))
    inner = F.sha2(F.concat(pad(0x36), F.encode(name, "UTF-8")), 256)
    return F.sha2(F.concat(pad(0x5C), F.unhex(inner)), 256)


def alias_map(aliases: dict[str, str]) -> dict[str, str]:
    return {_key(a): _key(b) for a, b in aliases.items()}


def course_alias(course_key: Column, aliases: dict[str, str]) -> Column:
    """The key that the alias table gives for a course key, or the key itself."""
    known = alias_map(aliases)
    if not known:
        return course_key
    return F.coalesce(F.create_map(*[F.lit(x) for pair in known.items() for x in pair])[course_key], course_key)


def keys_of(names: Iterable[str]) -> list[str]:
    return [_key(x) for x in names]
