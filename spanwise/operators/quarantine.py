"""Rows that fail to parse: strict load plus anti-join.

Every line keeps its offset (line_id). Only conforming lines are loaded, typed;
their offsets are subtracted from the raw offsets, and what remains is
diagnosed, the first reason that applies. All of it is built-in expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

#: The columns of a training log, in order.
RESULT_COLUMNS = (
    "epoch", "time", "train_box_loss", "train_cls_loss", "train_l1_loss", "precision", "recall", "map50", "map50_95",
    "val_box_loss", "val_cls_loss", "val_l1_loss", "lr_pg0", "lr_pg1", "lr_pg2", "remark",
)
BOX_COLUMNS = ("class_id", "x", "y", "width", "height")
RATES = ("precision", "recall", "map50", "map50_95")

_COUNT = r"^\+?0*[1-9][0-9]*\z"
_COMMA, _NEVER = "\x01", "\x02"


def records(lines: DataFrame) -> DataFrame:
    """Lines that are records: not null or blank, of a known feed, and no header; without one carriage return at the end."""
    line = F.regexp_replace("line", r"\r\z", "")
    return (
        lines.select("line_id", "feed", "file_name", "line_no", line.alias("line"))
        .where(F.col("feed").isin("results", "boxes") & F.coalesce(F.trim(F.translate("line", "\t\r\n\x0b\x0c", "     ")) != "", F.lit(False)))
        .where("not (feed = 'results' and coalesce(line_no, 0) = 1)")
    )


def quoted_well(line: Column) -> Column:
    """True if every double quote belongs to a field that starts and ends with one; inside it a quote is doubled.

    Split at the quotes, the pieces at even places lie outside; there must be an
    odd number of pieces, the first empty or ending in a comma, the last empty
    or starting with one, those between empty (a doubled quote) or both.
    """
    pieces = F.split(line, '"', -1)
    last = F.size(pieces) - 1
    even = F.filter(pieces, lambda p, i: i % 2 == 0)

    def sound(p: Column, i: Column) -> Column:
        opens, closes = (i == 0) | F.startswith(p, F.lit(",")), (i * 2 == last) | F.endswith(p, F.lit(","))
        return (p == "") | (opens & closes)

    return (last % 2 == 0) & (F.size(F.filter(even, lambda p, i: ~sound(p, i))) == 0)


def fields(line: Column) -> Column:
    """The comma-separated fields of a well quoted line, outer quotes removed, doubled ones single, numbers' blanks kept."""
    pieces = F.split(F.translate(line, _COMMA, _NEVER), '"', -1)
    marked = F.array_join(F.transform(pieces, lambda p, i: F.when(i % 2 == 0, F.translate(p, ",", _COMMA)).otherwise(p)), '"')
    return F.transform(
        F.split(marked, _COMMA, -1),
        lambda f: F.when(F.startswith(f, F.lit('"')), F.replace(F.substring(f, F.lit(2), F.greatest(F.length(f) - 2, F.lit(0))), F.lit('""'), F.lit('"'))).otherwise(f),
    )


def _bare(c: Column) -> Column:
    return F.btrim(c, F.lit(" \t"))


def _number(c: Column) -> Column:
    """The double that a text of digits, signs, points and exponents stands for, else null; infinity is none."""
    value = c.try_cast("double")
    return F.when(F.abs(value) < float("inf"), value)


def _numeric(fields: Column) -> Column:
    """Whether the fields hold nothing but what plain and exponent decimals are made of. Of such texts just the decimals can be cast, so no field needs a pattern of its own."""
    return F.translate(F.array_join(fields, ""), "0123456789+-.eE \t", "") == ""


def _parsed(rows: DataFrame, feed: str) -> DataFrame:
    """Adds `f` (fields), `ok_quotes`, `ok_count` and `v` (values, null where invalid)."""
    if feed == "results":
        # Most lines have no quote and need no quoting rules.
        plain = ~F.contains("line", F.lit('"'))
        cut, names = F.when(plain, F.split("line", ",", -1)).when(quoted_well(F.col("line")), fields(F.col("line"))), RESULT_COLUMNS
    else:
        cut, names = F.split(_bare(F.col("line")), r"[ \t]+", -1), BOX_COLUMNS
    # explode(array(x)) keeps the optimizer from copying x into every place that uses it.
    out = rows.where(F.col("feed") == feed).select("*", F.explode(F.array(cut)).alias("f"))
    out = out.select("*", F.col("f").isNotNull().alias("ok_quotes"), F.coalesce(F.size("f") == len(names), F.lit(False)).alias("ok_count"))
    numbers = F.slice("f", 2, 14 if feed == "results" else 4)
    at = lambda i: F.get("f", F.lit(i))
    values = []
    for i, name in enumerate(names):
        if name == "remark":
            values.append(at(i).alias(name))
        elif name == "epoch":
            values.append(F.when(_bare(at(i)).rlike(_COUNT), _bare(at(i))).alias(name))
        elif name == "class_id":
            values.append(F.when(at(i).rlike(r"^[0-5]\z"), at(i).cast("int")).alias(name))
        else:
            x = _number(_bare(at(i)))
            if feed == "results":
                good = (x >= 0) & ((x <= 1) if name in RATES else F.lit(True))
            else:
                good = (x <= 1) & ((x > 0) if name in ("width", "height") else (x >= 0))
            values.append(F.when(good, x).alias(name))
    return out.select("*", F.explode(F.array(F.when(F.col("ok_count") & _numeric(numbers), F.struct(*values)))).alias("v"))


def _valid(feed: str) -> Column:
    names = [n for n in (RESULT_COLUMNS if feed == "results" else BOX_COLUMNS) if n != "remark"]
    out = F.col("v").isNotNull()
    for n in names:
        out = out & F.col(f"v.{n}").isNotNull()
    return out


def load_results(lines: DataFrame) -> DataFrame:
    """The conforming rows of training logs, typed; an epoch beyond 64 bits is valid but has no number (null)."""
    rows = _parsed(records(lines), "results").where(_valid("results"))
    cells = [F.col(f"v.{n}") for n in RESULT_COLUMNS[1:]]
    return rows.select("line_id", "file_name", "line_no", F.col("v.epoch").try_cast("bigint").alias("epoch"), *cells)


def load_boxes(lines: DataFrame) -> DataFrame:
    """The conforming label rows, typed."""
    rows = _parsed(records(lines), "boxes").where(_valid("boxes"))
    return rows.select("line_id", "file_name", "line_no", *(F.col(f"v.{n}") for n in BOX_COLUMNS))


def _offsets(rows: DataFrame) -> DataFrame:
    """Adds the key of a line's offset: its id (null as -1) and a hash of feed, file and number, nulls told apart."""
    part = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("\x00"))
    return rows.select("*", F.coalesce("line_id", F.lit(-1)).alias("id"), F.xxhash64(part("line_id"), part("feed"), part("file_name"), part("line_no")).alias("offset"))


def rejected(lines: DataFrame) -> DataFrame:
    """(line_id, feed, file_name, line_no, line, reason) of records that don't conform.

    Null, blank and header lines and those of other feeds are no records. A
    line's offset is its feed, file, number and id; of lines that share all of
    them, one that conforms stands for all. A null part of an offset equals null.
    """
    raw = _offsets(records(lines))
    loaded = None
    for feed in ("results", "boxes"):
        good = _parsed(raw, feed).where(_valid(feed)).select("id", "offset")
        loaded = good if loaded is None else loaded.unionByName(good)
    rest = raw.join(loaded, ["id", "offset"], "left_anti")
    reason = F.when(~F.col("ok_quotes"), "broken_quoting").when(~F.col("ok_count"), "column_count").otherwise("invalid_value")
    keep = ("line_id", "feed", "file_name", "line_no", "line")
    return _parsed(rest, "results").select(*keep, reason.alias("reason")).unionByName(_parsed(rest, "boxes").select(*keep, reason.alias("reason")))
