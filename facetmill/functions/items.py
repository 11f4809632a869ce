"""Items: one `column___value` string for each non-null cell.

Names that hold the separator or end in an underscore are escaped inside items, so that an item always names its column.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SEP = "___"
#: Whole cells that count as null (fixed values).
NULL_LITERALS = ["None", "none", "NONE", "nan", "NaN", "NAN", "NaT", "nat", "NAT", "null", "NULL"]


def quoted(name: str) -> Column:
    """A column by its exact name, also with dots or blanks in it."""
    return F.col("`" + name.replace("`", "``") + "`")


def item_prefix(column: str) -> str:
    """The column's part of an item; in names whose underscores could be read as the separator they are written backslash, hyphen."""
    name = column.replace("\\", "\\\\")
    return (name.replace("_", "\\-") if SEP in name or name.endswith("_") else name) + SEP


def item(column: str) -> Column:
    return F.when(quoted(column).isNotNull(), F.concat(F.lit(item_prefix(column)), quoted(column).cast("string")))


def item_column(c: Column) -> Column:
    """The column of an item, as it is named in the table."""
    name = F.substring_index(c, SEP, 1)
    plain = F.replace(F.replace(F.replace(name, F.lit("\\\\"), F.lit("\1")), F.lit("\\-"), F.lit("_")), F.lit("\1"), F.lit("\\"))
    return F.when(name.contains("\\"), plain).otherwise(name)


def item_value(c: Column) -> Column:
    return F.substring(c, F.length(F.substring_index(c, SEP, 1)) + len(SEP) + 1, F.length(c))


def literal_map(values: dict[str, float]) -> Column:
    pairs = [F.lit(x) for k, v in sorted(values.items()) for x in (k, float(v))]
    return F.create_map(*pairs) if pairs else F.expr("cast(map() as map<string,double>)")


def item_key(items: Column) -> Column:
    """Sorted items as one string: the tie rule of rankings."""
    return F.array_join(F.array_sort(items), "|")
