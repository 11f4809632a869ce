"""Column preparation: rounding, constant and unique columns, correlated columns, buckets, null literals, descriptions.

All statistics of a table come from a few aggregate passes; only numbers for each column reach the driver.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from facetmill.functions.items import NULL_LITERALS, quoted

DATE_FORMATS = ["yyyy-MM-dd", "yyyy/MM/dd", "dd-MM-yyyy", "dd/MM/yyyy", "yyyy-MM-dd HH:mm:ss", "yyyy/MM/dd HH:mm:ss"]
BUCKETS = {"time_of_day", "day_of_week", "season", "year"}
HIGH_CARDINALITY, KEEP_TOP_N = 200, 10


def _plain(df: DataFrame) -> list[str]:
    """Columns with a text form: nested and binary ones take no part."""
    return [f.name for f in df.schema.fields if not isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType, T.BinaryType))]


def value_counts(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """(col, val, count) of all columns in one pass; null is a value of its own."""
    columns = columns or _plain(df)
    if not columns:
        return df.sparkSession.createDataFrame([], "col string, val string, count long")
    cells = F.array(*[F.struct(F.lit(c).alias("col"), quoted(c).cast("string").alias("val")) for c in columns])
    return df.select(F.explode(cells).alias("x")).select("x.col", "x.val").groupBy("col", "val").agg(F.count(F.lit(1)).alias("count"))


def round_floats(df: DataFrame) -> DataFrame:
    """Float columns to bigint, halves to even; NaN becomes null."""
    floats = {f.name for f in df.schema.fields if isinstance(f.dataType, (T.FloatType, T.DoubleType))}
    return df.select(*[F.rint(F.nanvl(quoted(c), F.lit(None))).cast("bigint").alias(c) if c in floats else quoted(c) for c in df.columns])


def constant_columns(df: DataFrame) -> list[str]:
    """Columns with exactly one distinct value, null counted as a value; min, max and the number of nulls decide.

    Least and greatest values, of texts those of their hashes, rule most columns out; the texts of the others are compared where equal ends do not settle it.
    """
    columns = _plain(df)
    if not columns:
        return []
    text = lambda c: quoted(c).cast("string")
    kind = {c: df.schema[c].dataType for c in columns}
    by_value = {c for c in columns if isinstance(kind[c], (T.NumericType, T.BooleanType, T.DateType, T.TimestampType, T.TimestampNTZType))}
    ends = lambda c: [f(quoted(c)).cast("string") if c in by_value else f(F.xxhash64(text(c))) for f in (F.min, F.max)]
    same = lambda c: (lambda a, b: a.eqNullSafe(b))(*ends(c))
    stats = df.agg(F.count(F.lit(1)).alias("n"), *[x for i, c in enumerate(columns) for x in (F.count(quoted(c)).alias(f"k{i}"), same(c).alias(f"s{i}"))]).first()
    n = stats["n"]
    found = {c for i, c in enumerate(columns) if n > 0 and (stats[f"k{i}"] == 0 or stats[f"s{i}"] and stats[f"k{i}"] == n)}
    open_ = [c for i, c in enumerate(columns) if c in found and stats[f"k{i}"] and not _text_by_value(kind[c])]
    if open_:
        texts = df.agg(*[(F.min(text(c)) == F.max(text(c))).alias(f"s{i}") for i, c in enumerate(open_)]).first()
        found -= {c for i, c in enumerate(open_) if not texts[f"s{i}"]}
    return [c for c in columns if c in found]


def _text_by_value(kind: T.DataType) -> bool:
    """Whether values are equal if and only if their texts are, and can be counted as they are: not so -0.0 and 0.0, or the hour that a clock shows twice."""
    return isinstance(kind, (T.IntegralType, T.BooleanType, T.DateType, T.TimestampNTZType, T.DecimalType))


def drop_constant_columns(df: DataFrame, row_id: str | None = None) -> DataFrame:
    found = set(constant_columns(df)) - {row_id}
    return df.select(*[quoted(c) for c in df.columns if c not in found])


def unique_columns(df: DataFrame, row_id: str | None = None) -> list[str]:
    """Columns whose distinct count (null counted) equals the row count; row_id is exempt.

    An approximate count rules most columns out; only the others are counted exactly.
    """
    columns = [c for c in _plain(df) if c != row_id]
    if not columns:
        return []
    about = df.agg(F.count(F.lit(1)).alias("n"), *[F.approx_count_distinct(quoted(c), 0.02).alias(f"c{i}") for i, c in enumerate(columns)]).first()
    n = about["n"]
    near = [c for i, c in enumerate(columns) if about[f"c{i}"] + 1 >= 0.8 * n]
    if not near or n == 0:
        return []
    counts, nulls = distinct_counts(df, near), df.agg(*[F.max(quoted(c).isNull().cast("int")).alias(f"c{i}") for i, c in enumerate(near)]).first()
    return [c for i, c in enumerate(near) if counts[c] + nulls[f"c{i}"] == n]


def drop_unique_columns(df: DataFrame, row_id: str | None = None) -> DataFrame:
    found = set(unique_columns(df, row_id))
    return df.select(*[quoted(c) for c in df.columns if c not in found])


def prepare_data(df: DataFrame, row_id: str | None = None) -> DataFrame:
    """Round floats, drop constant columns, then drop all-unique ones; row_id stays, also that of a single row."""
    return drop_unique_columns(drop_constant_columns(round_floats(df), row_id), row_id)


def correlated_column_groups(df: DataFrame, row_id: str) -> list[list[str]]:
    """Groups of columns with a pair of fully correlated (r = 1) parts; see _equal_parts and _equal_numbers.

    A two-valued number with nulls is compared with text on the rows where it has a value.
    """
    fields = [f for f in df.schema.fields if f.name in _plain(df) and f.name != row_id]
    text = [f.name for f in fields if isinstance(f.dataType, T.StringType)]
    numbers = [f.name for f in fields if isinstance(f.dataType, (T.NumericType, T.BooleanType))]
    if not text and not numbers:
        return []
    number = lambda c: quoted(c).cast("double")
    limits = df.agg(*[x for i, c in enumerate(numbers) for x in (F.max(number(c)).alias(f"b{i}"), F.approx_count_distinct(number(c), 0.01).alias(f"d{i}"), F.count(number(c)).alias(f"n{i}"))], F.count(F.lit(1)).alias("n")).first()
    two = {c: limits[f"b{i}"] for i, c in enumerate(numbers) if limits[f"d{i}"] == 2}
    whole = {c: v for c, v in two.items() if limits[f"n{numbers.index(c)}"] == limits["n"]}
    pairs = _equal_parts(df, row_id, text, whole, limits["n"]) | _equal_numbers(df, numbers)
    for c in two.keys() - whole.keys():
        given = df.where(quoted(c).isNotNull())
        pairs |= {p for p in _equal_parts(given, row_id, text, {c: two[c]}, limits[f"n{numbers.index(c)}"]) if c in p}
    group = {c: c for p in pairs for c in p}
    for a, b in sorted(pairs):  # union of overlapping groups of column names
        old, new = max(group[a], group[b]), min(group[a], group[b])
        group = {c: new if g == old else g for c, g in group.items()}
    return sorted(sorted(c for c in group if group[c] == g) for g in set(group.values()))


def _equal_parts(df: DataFrame, row_id: str, text: list[str], high: dict[str, float], n_rows: int) -> set[tuple[str, str]]:
    """Pairs of columns with equal parts: values of text columns, and the greater value of two-valued numbers (high).

    A part is a value of a text column or a two-valued number or boolean, seen as its set of rows; equal sets have equal
    fingerprints (count, sum and xor of row hashes) and are confirmed by an exact count of rows in which both or none
    hold; where the first pair of parts of two columns is not confirmed, all their parts are counted.  Only one pair of
    parts for each pair of columns reaches the driver.
    """
    as_number = {c: quoted(c).cast("double") for c in high}
    part_of = {c: quoted(c) for c in text} | {c: F.when(as_number[c] == high[c], F.lit("high")) for c in high}
    holds = F.array(*[F.struct(F.lit(c).alias("col"), v.alias("val")) for c, v in part_of.items()])
    pairs: set[tuple[str, str]] = set()
    if part_of:
        row = F.xxhash64(quoted(row_id).cast("string"))
        cells = df.select(row.alias("h"), F.explode(holds).alias("x")).select("h", "x.col", "x.val").where("val is not null")
        prints = cells.groupBy("col", "val").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("h").cast("decimal(38,0)")).alias("s"), F.bit_xor("h").alias("x")).where(F.col("n") < n_rows)
        # of parts with equal fingerprints one a column, and of those one pair of parts for each pair of columns: at most c * c
        firsts = prints.groupBy("n", "s", "x", "col").agg(F.min("val").alias("val"))
        same = firsts.groupBy("n", "s", "x").agg(F.array_sort(F.collect_list(F.struct("col", "val"))).alias("parts")).where("size(parts) > 1")
        couples = F.expr("flatten(transform(parts, (a, i) -> transform(slice(parts, i + 2, size(parts)), b -> named_struct('a', a, 'b', b))))")
        likely = same.select(F.explode(couples).alias("p")).groupBy("p.a.col", "p.b.col").agg(F.min("p").alias("p")).select("p").collect()
        checks = sorted((tuple(r["p"]["a"]), tuple(r["p"]["b"])) for r in likely)
        is_part = lambda p: F.coalesce((as_number[p[0]] == high[p[0]]) if p[0] in high else (quoted(p[0]) == p[1]), F.lit(False))
        for i in range(0, len(checks), 200):
            part = checks[i : i + 200]
            off = df.agg(*[F.coalesce(F.sum((is_part(a) != is_part(b)).cast("long")), F.lit(0)).alias(f"c{j}") for j, (a, b) in enumerate(part)]).first()
            pairs |= {(a[0], b[0]) for j, (a, b) in enumerate(part) if off[f"c{j}"] == 0}
        # where that pair only looks equal, all parts of the two columns are counted
        rest = [(a[0], b[0]) for a, b in checks if (a[0], b[0]) not in pairs]
        if rest:
            met = F.explode(F.array(*[F.struct(F.lit(a).alias("a"), part_of[a].alias("a_val"), F.lit(b).alias("b"), part_of[b].alias("b_val")) for a, b in rest]))
            both = df.select(met.alias("x")).select("x.*").where("a_val is not null and b_val is not null").groupBy("a", "a_val", "b", "b_val").agg(F.count(F.lit(1)).alias("n"))
            for end in ("a", "b"):
                both = both.join(prints.select(F.col("col").alias(end), F.col("val").alias(f"{end}_val"), "n"), [end, f"{end}_val", "n"])
            pairs |= {(r["a"], r["b"]) for r in both.select("a", "b").distinct().collect()}
    return pairs


def _equal_numbers(df: DataFrame, numbers: list[str]) -> set[tuple[str, str]]:
    """Pairs of numeric columns with a Pearson r of 1 on the rows where both have a value."""
    as_number = {c: quoted(c).cast("double") for c in numbers}
    pairs: set[tuple[str, str]] = set()
    numeric = [(a, b) for i, a in enumerate(numbers) for b in numbers[i + 1 :]]
    for i in range(0, len(numeric), 200):
        part = numeric[i : i + 200]
        both = [(F.when(as_number[b].isNotNull(), as_number[a]), F.when(as_number[a].isNotNull(), as_number[b])) for a, b in part]
        r = df.agg(*[F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y)).alias(f"c{j}") for j, (x, y) in enumerate(both)]).first()
        pairs |= {p for j, p in enumerate(part) if r[f"c{j}"] is not None and r[f"c{j}"] >= 1 - 1e-12}
    return pairs


def drop_correlated(df: DataFrame, groups: list[list[str]], drop: list[str]) -> tuple[DataFrame, list[str]]:
    """Drop the chosen columns that belong to a group; also give the names that do not."""
    known = {c for g in groups for c in g}
    return df.select(*[quoted(c) for c in df.columns if c not in known & set(drop)]), [c for c in drop if c not in known]


def is_datetime_column(df: DataFrame, column: str, sample: int = 100) -> bool:
    """Dates and timestamps; texts of which over 80 % of the first non-null values read as a date."""
    kind = df.schema[column].dataType
    if isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return True
    if not isinstance(kind, T.StringType):
        return False
    c = F.col("v")
    seen = df.select(quoted(column).alias("v")).where("v is not null").limit(sample)
    shares = seen.agg(
        F.count(F.lit(1)).alias("n"),
        *[F.avg(F.try_to_timestamp(c, F.lit(f)).isNotNull().cast("int")).alias(f"f{i}") for i, f in enumerate(DATE_FORMATS)],
        F.avg((F.expr("try_cast(v as timestamp)").isNotNull() & c.rlike("[-/:]")).cast("int")).alias("free"),
    ).first()
    return bool(shares["n"]) and (any(shares[f"f{i}"] > 0.8 for i in range(len(DATE_FORMATS))) or shares["free"] > 0.8)


def datetime_columns(df: DataFrame) -> list[str]:
    return [c for c in _plain(df) if is_datetime_column(df, c)]


def as_timestamp(df: DataFrame, column: str):
    if not isinstance(df.schema[column].dataType, T.StringType):
        return quoted(column).cast("timestamp")
    tries = [F.try_to_timestamp(quoted(column), F.lit(f)) for f in reversed(DATE_FORMATS)]
    return F.coalesce(*tries, quoted(column).try_cast("timestamp"))


def bucket_datetime(df: DataFrame, column: str, kind: str) -> DataFrame:
    """Replace a date column by time_of_day, day_of_week, season or year; null stays null."""
    c = as_timestamp(df, column)
    if kind == "time_of_day":
        h = F.hour(c)
        out = F.when(h.between(6, 11), "Morning").when(h.between(12, 17), "Afternoon").when(h.between(18, 21), "Evening").when(h.isNotNull(), "Night")
    elif kind == "day_of_week":
        out = F.date_format(c, "EEEE")
    elif kind == "season":
        m = F.month(c)
        out = F.when(m.isin(12, 1, 2), "Winter").when(m.between(3, 5), "Spring").when(m.between(6, 8), "Summer").when(m.isNotNull(), "Autumn")
    elif kind == "year":
        out = F.year(c).cast("string")
    else:
        raise ValueError(f"unknown bucket {kind!r}: one of {sorted(BUCKETS)}")
    return df.select(*[out.alias(column) if x == column else quoted(x) for x in df.columns])


def frequent_values(df: DataFrame, most: dict[str, int]) -> dict[str, list[str]]:
    """For each column its so many most frequent values as text, ties by value; all are counted in one job, in which a column's counts read that column only."""
    if not most:
        return {}

    def best(c: str, n: int) -> DataFrame:
        key = quoted(c) if _text_by_value(df.schema[c].dataType) else quoted(c).cast("string")
        counts = df.select(key.alias("val")).where("val is not null").groupBy("val").count()
        return counts.select(F.lit(c).alias("col"), F.col("val").cast("string").alias("val"), "count").orderBy(F.desc("count"), "val").limit(n)

    found: dict[str, list[str]] = {c: [] for c in most}
    for r in reduce(DataFrame.unionByName, [best(c, n) for c, n in most.items()]).collect():  # at most n values of a column
        found[r["col"]].append(r["val"])
    return found


def bucket_categorical(df: DataFrame, column: str, keep_top_n: int = KEEP_TOP_N) -> DataFrame:
    """Keep the N most frequent values (ties by value); others become `others`, null stays null."""
    return _kept(df, column, frequent_values(df, {column: keep_top_n})[column])


def _kept(df: DataFrame, column: str, values: list[str]) -> DataFrame:
    c, kind = quoted(column).cast("string"), df.schema[column].dataType
    among = quoted(column).isin([F.lit(v).cast(kind) for v in values]) if _text_by_value(kind) else c.isin(values)
    out = F.when(quoted(column).isNull(), F.lit(None)).when(among, c).otherwise("others")
    return df.select(*[out.alias(column) if x == column else quoted(x) for x in df.columns])


def high_cardinality_columns(df: DataFrame, threshold: int = HIGH_CARDINALITY, row_id: str | None = None) -> DataFrame:
    """(col, n_unique, kind, samples) of columns with more than threshold distinct non-null values; 5 samples each."""
    columns = [c for c in _plain(df) if c != row_id]
    empty = "col string, n_unique long, kind string, samples array<string>"
    if not columns:
        return df.sparkSession.createDataFrame([], empty)
    about = df.agg(*[F.approx_count_distinct(quoted(c), 0.02).alias(f"c{i}") for i, c in enumerate(columns)]).first()
    near = [c for i, c in enumerate(columns) if about[f"c{i}"] > 0.8 * threshold]
    if not near:
        return df.sparkSession.createDataFrame([], empty)
    kinds = F.create_map(*[F.lit(x) for c in near for x in (c, "datetime" if is_datetime_column(df, c) else "categorical")])
    values = value_counts(df, near).where("val is not null")
    first = W.partitionBy("col").orderBy("val")
    counts = values.groupBy("col").agg(F.count(F.lit(1)).alias("n_unique")).where(F.col("n_unique") > threshold)
    samples = values.withColumn("r", F.row_number().over(first)).where("r <= 5").groupBy("col").agg(F.array_sort(F.collect_list("val")).alias("samples"))
    return counts.join(F.broadcast(samples), "col").select("col", "n_unique", kinds[F.col("col")].alias("kind"), "samples")  # a row for each column


def default_plan(df: DataFrame, threshold: int = HIGH_CARDINALITY, row_id: str | None = None) -> dict[str, str]:
    """season or top10 for each column that high_cardinality_columns gives.

    An approximate count decides for columns far from the threshold; only those near it, which have few values, are counted exactly.
    """
    columns = [c for c in _plain(df) if c != row_id]
    if not columns:
        return {}
    about = df.agg(*[F.approx_count_distinct(quoted(c), 0.02).alias(f"c{i}") for i, c in enumerate(columns)]).first()
    near = [c for i, c in enumerate(columns) if 0.8 * threshold < about[f"c{i}"] <= 2 * threshold]
    counts = value_counts(df, near).where("val is not null").groupBy("col").agg(F.count(F.lit(1)).alias("n")).collect() if near else []  # a row for each column
    found = {r["col"] for r in counts if r["n"] > threshold} | {c for i, c in enumerate(columns) if about[f"c{i}"] > 2 * threshold}
    return {c: "season" if is_datetime_column(df, c) else "top10" for c in columns if c in found}


def apply_buckets(df: DataFrame, plan: dict[str, str] | None = None, row_id: str | None = None, threshold: int = HIGH_CARDINALITY) -> DataFrame:
    """plan: column -> time_of_day, day_of_week, season, year, top10, top20, top50, top100 or drop; else the default plan."""
    plan = default_plan(df, threshold, row_id) if plan is None else plan
    tops = ("top10", "top20", "top50", "top100")
    for column, kind in plan.items():
        if kind != "drop" and kind not in BUCKETS and kind not in tops:
            raise ValueError(f"unknown bucket {kind!r} for {column}")
    values = frequent_values(df, {c: int(kind[3:]) for c, kind in plan.items() if kind in tops})
    for column, kind in plan.items():
        if kind == "drop":
            df = df.drop(column)
        elif kind in BUCKETS:
            df = bucket_datetime(df, column, kind)
        else:
            df = _kept(df, column, values[column])
    return df


def _may_spell_null(df: DataFrame, column: str) -> bool:
    """Not whole numbers, decimals, booleans, dates and times: their texts need not be looked at."""
    kind = df.schema[column].dataType
    return not (_text_by_value(kind) or isinstance(kind, T.TimestampType))


def blank_nulls(df: DataFrame, row_id: str | None = None) -> DataFrame:
    """Cells that spell a null become null; types stay as they are."""
    plain = {c for c in _plain(df) if c != row_id and _may_spell_null(df, c)}
    return df.select(*[F.when(~quoted(c).cast("string").isin(NULL_LITERALS), quoted(c)).alias(c) if c in plain else quoted(c) for c in df.columns])


def normalize_nulls(df: DataFrame, row_id: str | None = None) -> DataFrame:
    """Every plain column as text, cells that spell a null as null; nested columns are left out."""
    spelled = lambda c: F.when(~quoted(c).cast("string").isin(NULL_LITERALS), quoted(c).cast("string"))
    text = lambda c: (spelled(c) if _may_spell_null(df, c) else quoted(c).cast("string")).alias(c)
    return df.select(*[quoted(c) if c == row_id else text(c) for c in _plain(df)])


def describe_columns(df: DataFrame, itemset_columns: list[str], constants: dict[str, str] | None = None, row_id: str | None = None) -> DataFrame:
    """(col, description): a sentence for each column that an itemset uses and each constant one."""
    constants = constants or {}
    spark = df.sparkSession
    rows = [(c, f"constant with the value {v}") for c, v in constants.items()]
    used = [f for f in df.schema.fields if f.name in set(itemset_columns) and f.name not in constants and f.name != row_id]
    values = value_counts(df, [f.name for f in used]).where("val is not null") if used else None
    stats: dict[str, tuple] = {}
    if used:
        order = W.partitionBy("col").orderBy(F.desc("count"), "val")
        n = values.groupBy("col").agg(F.count(F.lit(1)).alias("n"))
        five = values.withColumn("r", F.row_number().over(order)).where("r <= 5").groupBy("col").agg(F.array_sort(F.collect_list(F.struct("r", "val"))).alias("five"))
        stats = {r["col"]: (r["n"], [x["val"] for x in r["five"]]) for r in n.join(five, "col").collect()}  # a row for each column
        ends = df.agg(*[x for i, f in enumerate(used) for x in (F.min(quoted(f.name)).alias(f"a{i}"), F.max(quoted(f.name)).alias(f"b{i}"))]).first()
    for i, f in enumerate(used):
        n, five = stats.get(f.name, (0, []))
        low, top = ends[f"a{i}"], ends[f"b{i}"]
        number = isinstance(f.dataType, T.NumericType)
        if n == 0:
            said = "no values"
        elif isinstance(f.dataType, T.StringType) or (number and n <= 10):
            said = f"categorical with {n} values such as {', '.join(five)}{', etc.' if n > 5 else ''}"
        elif isinstance(f.dataType, T.IntegralType):
            said = f"whole numbers from {low} to {top}"
        elif number:
            said = f"numbers from {low:.2f} to {top:.2f}"
        elif isinstance(f.dataType, (T.DateType, T.TimestampType, T.TimestampNTZType)):
            said = f"dates from {low:%Y-%m-%d} to {top:%Y-%m-%d}"
        elif isinstance(f.dataType, T.BooleanType):
            said = f"boolean with the values {', '.join(sorted(five))}"
        else:
            said = f"{f.dataType.simpleString()} with {n} values"
        rows.append((f.name, said))
    return spark.createDataFrame(rows, "col string, description string")


def drop_zero_weight(df: DataFrame, weights: dict[str, float]) -> tuple[DataFrame, dict[str, float]]:
    """Without the columns of weight 0, in the table and in the weights."""
    zero = {c for c, w in weights.items() if w == 0}
    return df.select(*[quoted(c) for c in df.columns if c not in zero]), {c: w for c, w in weights.items() if c not in zero}


TRACKED, CANDIDATES, FEW_VALUES = 10_000, 64, 2_000  # values that the frequent-items sketch of a column holds; that are counted again; up to which all are counted
PROFILE = "col string, n_rows long, n_nulls long, n_distinct long, min_value string, max_value string, mean double, stddev double, quantiles array<double>, histogram array<long>, top_values array<string>"


def distinct_counts(df: DataFrame, columns: list[str]) -> dict[str, int]:
    """Exact numbers of distinct non-null values; what is shuffled of a cell are two hashes of 96 bits in all, not its text."""
    if not columns:
        return {}
    hashes = lambda c: F.when(quoted(c).isNotNull(), F.struct(F.xxhash64(quoted(c).cast("string")).alias("h"), F.hash(quoted(c).cast("string")).alias("g")))
    cells = F.array(*[F.struct(F.lit(i).alias("i"), hashes(c).alias("x")) for i, c in enumerate(columns)])
    each = df.select(F.explode(cells).alias("c")).select("c.i", "c.x").where("x is not null").groupBy("i", "x").agg(F.lit(1).alias("one"))
    found = {r["i"]: r["n"] for r in each.groupBy("i").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row for each column
    return {c: found.get(i, 0) for i, c in enumerate(columns)}


def column_profile(df: DataFrame, top: int = 5, bins: int = 10, shares: tuple[float, ...] = (0.25, 0.5, 0.75)) -> DataFrame:
    """A row for each column: rows, nulls, distinct, min, max, the most frequent values (ties by value) and, of numbers, mean, stddev, quantiles and a histogram.

    One aggregate pass gives exact moments and ends and mergeable sketches: distinct counts, frequent items, quantiles (approximate, the only
    figures that stay so).  A second one counts exactly: the values of columns with few of them, the candidates of the frequent-items sketch of the others, and the bins
    of equal width between the ends.  A column whose candidates cannot be told from what the sketch left out is undecided; only such a column's values
    are shuffled as text, and if no value repeats not even they.
    """
    fields = [f for f in df.schema.fields if f.name in set(_plain(df))]
    spark = df.sparkSession
    if not fields:
        return spark.createDataFrame([], PROFILE)
    names = [f.name for f in fields]
    number = {f.name for f in fields if isinstance(f.dataType, T.NumericType)}
    text = lambda c: quoted(c).cast("string")
    as_double = lambda c: F.nanvl(quoted(c).cast("double"), F.lit(None))

    def first_pass(i: int, c: str) -> list[Column]:
        numbers = [F.avg(quoted(c)), F.stddev_samp(quoted(c)), F.min(as_double(c)), F.max(as_double(c)), F.percentile_approx(as_double(c), list(shares), 10_000)] if c in number else [F.lit(None)] * 5
        common = [F.count(quoted(c)), F.min(quoted(c)).cast("string"), F.max(quoted(c)).cast("string"), F.approx_count_distinct(text(c), 0.02), F.call_function("approx_top_k", text(c), F.lit(CANDIDATES), F.lit(TRACKED))]
        return [x.alias(f"{k}{i}") for k, x in zip(("count", "low", "high", "about", "often", "mean", "stddev", "from", "to", "quantiles"), common + numbers)]

    seen = df.agg(F.count(F.lit(1)).alias("n"), *[x for i, c in enumerate(names) for x in first_pass(i, c)]).first()
    n = seen["n"]
    few = {c for i, c in enumerate(names) if seen[f"about{i}"] <= FEW_VALUES}
    likely = {c: {x["item"]: x["count"] for x in seen[f"often{i}"] or [] if x["item"] is not None} for i, c in enumerate(names) if c not in few}

    # exact counts of values, candidates and bins in one pass
    def bin_of(i: int, c: str) -> Column:
        low, high = seen[f"from{i}"], seen[f"to{i}"]
        return F.least(F.floor((as_double(c) - F.lit(low)) * bins / F.lit(high - low)), F.lit(bins - 1)).cast("string")

    binned = {c: i for i, c in enumerate(names) if c in number and seen[f"from{i}"] is not None and seen[f"from{i}"] < seen[f"to{i}"] and math.isfinite(seen[f"to{i}"] - seen[f"from{i}"])}
    values = [(f"v{i}", text(c) if c in few else F.when(text(c).isin(sorted(likely[c])), text(c))) for i, c in enumerate(names)] + [(f"b{i}", bin_of(i, c)) for c, i in binned.items()]
    cells = F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), v.alias("val")) for k, v in values]))
    counted: dict[str, dict[str, int]] = {k: {} for k, _ in values}
    for r in df.select(cells.alias("x")).select("x.*").where("val is not null").groupBy("kind", "val").agg(F.count(F.lit(1)).alias("n")).collect():  # at most about FEW_VALUES for each column
        counted[r["kind"]][r["val"]] = r["n"]
    best = lambda counts: sorted(counts.items(), key=lambda x: (-x[1], x[0].encode()))[:top]

    def decided(i: int, c: str) -> bool:
        """Whether each value outside the candidates is rarer than the last of the best."""
        exact, last = best(counted[f"v{i}"]), min(likely[c].values(), default=0) if len(likely[c]) >= CANDIDATES else 0
        return len(exact) == top and exact[-1][1] > max(last, 3.5 * n / TRACKED)

    many = distinct_counts(df, sorted(likely))
    rows = []
    for i, c in enumerate(names):
        exact = counted[f"v{i}"]
        distinct = len(exact) if c in few else many[c]
        if c in few or decided(i, c):
            most = best(exact)
        elif distinct == seen[f"count{i}"]:  # no value repeats: the first ones
            most = [(r["val"], 1) for r in df.select(text(c).alias("val")).where("val is not null").orderBy("val").limit(top).collect()]
        else:
            most = [(r["val"], r["count"]) for r in value_counts(df, [c]).where("val is not null").orderBy(F.desc("count"), "val").limit(top).collect()]
        histogram = [counted[f"b{i}"].get(str(b), 0) for b in range(bins)] if c in binned else None
        mean, spread = (None if seen[f"{k}{i}"] is None else float(seen[f"{k}{i}"]) for k in ("mean", "stddev"))
        rows.append((c, n, n - seen[f"count{i}"], distinct, seen[f"low{i}"], seen[f"high{i}"], mean, spread, seen[f"quantiles{i}"], histogram, [f"{v}:{k}" for v, k in most]))
    return spark.createDataFrame(rows, PROFILE)
