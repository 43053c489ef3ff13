"""Values between storage and wire: keys, numbers, booleans, JSON."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

STAMP = r"^\d{4}-\d{2}-\d{2}[ T]\d{2}:\d{2}(:\d{2}(\.\d+)?)?(Z|[+-]\d{2}(:?\d{2})?)?$"
NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"


def canonical_pk(*columns: str) -> Column:
    """The key columns in declared order as one JSON object, nulls kept."""
    return F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})


def text_to_number(text: Column) -> Column:
    """Numeric text as a double, SQL and ISO timestamps as epoch milliseconds (UTC where no offset is given), else NULL."""
    stamp = F.regexp_replace(F.regexp_replace(text, " ", "T"), r"([+-]\d{2})$", "$1:00")
    stamp = F.regexp_replace(stamp, r"([+-]\d{2})(\d{2})$", "$1:$2")
    stamp = F.regexp_replace(stamp, r"(\.\d{3})\d+", "$1")
    zoned = F.when(stamp.rlike(r"(Z|[+-]\d{2}:\d{2})$"), stamp).otherwise(F.concat(stamp, F.lit("Z")))
    millis = F.unix_millis(F.try_to_timestamp(zoned)).cast("double")
    return F.when(text.rlike(NUMBER), text.try_cast("double")).when(text.rlike(STAMP), millis)


def loose_boolean(text: Column) -> Column:
    """True for 1, true and t; NULL stays NULL; all else is false."""
    return F.when(text.isNotNull(), text.isin("1", "true", "t"))


def strict_boolean(text: Column) -> Column:
    """0 and 1 only; anything else is an error."""
    return F.when(text.isNull(), F.lit(None).cast("boolean")).when(text.isin("1", "true"), True).when(text.isin("0", "false"), False).otherwise(
        F.raise_error(F.concat(F.lit("not a boolean: "), text)).cast("boolean")
    )


def canonical_json(text: Column) -> Column:
    """JSON with sorted keys and no blanks; text that is no JSON as it is."""
    return F.coalesce(F.to_json(F.try_parse_json(text)), text)


def json_number(x: Column) -> Column:
    """A double as JSON: whole values without a fraction, null where it isn't finite."""
    whole = (x == F.floor(x)) & (F.abs(x) < 9e15)
    return F.when(F.isnan(x) | (F.abs(x) == float("inf")), F.lit(None)).when(whole, x.cast("long").cast("string")).otherwise(x.cast("string"))
