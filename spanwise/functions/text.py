"""Column builders for spellings: plain comparison, split names, unknown marks, hashes."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

#: Spellings of the three splits.
SPLIT_SPELLINGS = {
    "train": ("train", "training"),
    "valid": ("valid", "val", "validation"),
    "test": ("test", "testing"),
}

#: Words and marks that stand for an unknown value.
UNKNOWN_MARKS = (
    "null", "none", "nil", "n/a", "na", "nan", "nat", "unknown", "unk", "undefined", "unset",
    "missing", "not available", "tbd", "tba", "?", "??", "???", "-", "--", "---", ".", "_", "#n/a",
)

_BLANKS = " \t\n\r\x0b\x0c\u0085\u00a0\u2007\u202f\u3000\ufeff"


def trimmed(c: Column) -> Column:
    """Without surrounding blanks of any kind."""
    return F.btrim(c, F.lit(_BLANKS))


def plain(c: Column) -> Column:
    """The form in which names are compared: no surrounding blanks, lower case."""
    return F.lower(trimmed(c))


def unify_split(c: Column) -> Column:
    """train, valid or test from any spelling; null for anything else."""
    p = plain(c)
    out = F.when(p.isin(*SPLIT_SPELLINGS["train"]), "train")
    out = out.when(p.isin(*SPLIT_SPELLINGS["valid"]), "valid")
    return out.when(p.isin(*SPLIT_SPELLINGS["test"]), "test")


def unify_source(c: Column) -> Column:
    """Source names with blanks and hyphens written as one underscore, lower case."""
    return F.regexp_replace(plain(c), r"[\s\-_]+", "_")


def present_text(c: Column) -> Column:
    """True for text that is neither null, blank nor a mark standing for unknown."""
    return F.coalesce((plain(c) != "") & ~plain(c).isin(*UNKNOWN_MARKS), F.lit(False))


def filled(c: Column) -> Column:
    """True for text that is neither null nor blank."""
    return F.coalesce(trimmed(c) != "", F.lit(False))


def hex_text(c: Column, digits: int) -> Column:
    """Lower-case hex digits without blanks and 0x; null unless exactly `digits` long."""
    p = plain(c)
    h = F.when(F.startswith(p, F.lit("0x")), F.substring(p, 3, digits + 1)).otherwise(p)
    only_hex = (F.length(h) == digits) & (F.translate(h, "0123456789abcdef", "") == "")
    return F.when(only_hex, h)


def hex_long(h: Column, start: int) -> Column:
    """16 hex digits from `start` (1-based) as a signed 64-bit number."""
    high = F.conv(F.substring(h, start, 8), 16, 10).cast("bigint")
    low = F.conv(F.substring(h, start + 8, 8), 16, 10).cast("bigint")
    return F.shiftleft(high, 32).bitwiseOR(low)
