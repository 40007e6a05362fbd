"""Column functions for text, numbers and vectors."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F


def _accents() -> tuple[str, str]:
    """Latin letters that decompose into an ASCII letter and marks, and those letters."""
    pairs = [(chr(c), unicodedata.normalize("NFD", chr(c))) for c in (*range(0xC0, 0x250), *range(0x1E00, 0x1F00))]
    pairs = [(a, b[0]) for a, b in pairs if len(b) > 1 and b[0].isascii() and b[0].isalpha()]
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


MARKED, BARE = _accents()


def unaccent(x: Column) -> Column:
    return F.translate(x, MARKED, BARE)


def lexemes(x: Column) -> Column:
    """Distinct lower-case words without accents."""
    return F.array_distinct(F.filter(F.split(F.lower(unaccent(x)), r"[^\p{L}\p{N}]+"), lambda w: w != ""))


def matches_all(text: Column, keyword: str) -> Column:
    """Every word of the keyword stands in the text; false without words."""
    asked = lexemes(F.lit(keyword))
    return (F.size(asked) > 0) & (F.size(F.array_except(asked, lexemes(text))) == 0)


def blank_to_null(x: Column) -> Column:
    return F.nullif(F.trim(x), F.lit(""))


def parse_long(x: Column, fallback: int) -> Column:
    return F.coalesce(x.try_cast("bigint"), F.lit(fallback).cast("bigint"))


def parse_uuid(x: Column) -> Column:
    """Null unless it has the form of a UUID."""
    return F.when(x.rlike("^[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$"), F.lower(x))


def epoch_millis(x: Column) -> Column:
    return F.timestamp_millis(x.try_cast("bigint"))


def uuid7(at_ms: Column) -> Column:
    """A time-ordered id: 48 bits of milliseconds, version 7, random bits."""
    clock = F.lpad(F.lower(F.hex(at_ms.cast("bigint"))), 12, "0")
    noise = F.translate(F.uuid(), "-", "")
    variant = F.substr(F.lit("89ab"), F.conv(F.substring(noise, 20, 1), 16, 10).cast("int") % 4 + 1, F.lit(1))
    return F.concat(F.substring(clock, 1, 8), F.lit("-"), F.substring(clock, 9, 4), F.lit("-7"), F.substring(noise, 1, 3), F.lit("-"), variant, F.substring(noise, 5, 3), F.lit("-"), F.substring(noise, 9, 12))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def page_count(total: Column, size: int) -> Column:
    return F.ceil(total / F.lit(size)) if size > 0 else F.lit(0).cast("bigint")


#: The platform's result codes.
CODES = {
    -1: "ROOM_NOT_FOUND",
    -2: "ROOM_NOT_WAITING",
    -3: "ALREADY_SEATED",
    -4: "SEAT_TAKEN",
    -5: "SPECTATORS_LOCKED",
    -6: "INVALID_ROLE",
    -7: "ROOM_IS_PRIVATE",
    -8: "USER_OFFLINE",
    -9: "ALREADY_IN_ROOM",
    -10: "NOT_IN_ROOM",
    -12: "NOT_A_PLAYER",
    -13: "ROOM_NOT_COUNTDOWN",
    -14: "START_TIME_NOT_REACHED",
    -15: "NOT_YOUR_TURN",
    -16: "GAME_NOT_FOUND",
    -17: "TIME_OUT",
    -18: "ROOM_IN_PROGRESS",
    -19: "SEAT_SWITCH_NOT_ALLOWED",
}


def code_name(code: Column) -> Column:
    out = F.when(code >= 0, "OK")
    for k, name in CODES.items():
        out = out.when(code == k, name)
    return out.otherwise("UNKNOWN")
