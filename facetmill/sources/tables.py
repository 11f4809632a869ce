"""Sources and sinks: tables, catalogs, ranking configurations, reports."""

from __future__ import annotations

import re
from datetime import date

from pyspark.sql import DataFrame, DataFrameWriter, SparkSession
from pyspark.sql import functions as F

from facetmill.functions.items import quoted

CONFIG = "table_name string, weights map<string,double>, min_support double, max_collection int, gamma double, lr_weights double, lr_gamma double"
TRAIN_DEFAULTS = {"min_support": 0.1, "max_collection": -1, "gamma": 0.7, "lr_weights": 0.12, "lr_gamma": 0.8}
CLUSTER_DEFAULTS = {"min_support": 0.1, "max_collection": 5, "gamma": 0.7}
DATABASE_DEFAULTS = {"min_support": 0.1, "max_collection": -1, "gamma": 0.5, "similarity_threshold": 0.4}


def read_table(spark: SparkSession, source: str, format: str = "parquet", columns: list[str] | None = None, **options) -> DataFrame:
    """One table: a path for parquet, orc, csv or json (the last two want schema=...), a name for `table`, a table for `jdbc`.

    For jdbc give url; with partitionColumn and numPartitions it is read in parallel, in stretches of about as many rows each (see
    balanced_predicates), or in equal steps of the column if lowerBound and upperBound are given as well.
    """
    if format == "table":
        df = spark.table(source)
    elif format == "jdbc":
        if "partitionColumn" in options and "lowerBound" not in options:
            column, parts = options.pop("partitionColumn"), int(options.pop("numPartitions", 8))
            predicates = balanced_predicates(spark, source, column, parts, options)
            url = options.pop("url")
            df = spark.read.jdbc(url, source, predicates=predicates, properties={k: str(v) for k, v in options.items()})
        else:
            df = spark.read.format("jdbc").options(dbtable=source, **options).load()
    else:
        schema = options.pop("schema", None)
        if schema is None and format in ("csv", "json"):
            raise ValueError(f"{format} needs a schema: inferring one reads the data twice")
        reader = spark.read.schema(schema) if schema is not None else spark.read
        df = reader.format(format).options(**options).load(source)
    return df.select(*[quoted(c) for c in columns]) if columns else df


def balanced_predicates(spark: SparkSession, source: str, column: str, parts: int, options: dict) -> list[str]:
    """WHERE clauses of a jdbc read that share out the rows evenly, however skewed the column (numbers, dates, timestamps) is.

    The database gives the ends of the column; the column alone is then read in equal steps between them, and its quantiles cut the
    stretches.  Null keys go with the first one.  Rows of one key are never parted.
    """
    column = spark._jvm.org.apache.spark.sql.jdbc.JdbcDialects.get(options["url"]).quoteIdentifier(column)  # as Spark quotes it
    read = lambda query, **more: spark.read.format("jdbc").options(dbtable=f"({query}) q", **options, **more).load()
    ends = read(f"SELECT MIN({column}) AS low_end, MAX({column}) AS high_end FROM {source}").toDF("low", "high").first()
    if ends["low"] is None or ends["low"] == ends["high"] or parts < 2:
        return ["1 = 1"]
    keys = read(f"SELECT {column} AS part_key FROM {source}", partitionColumn="part_key", lowerBound=str(ends["low"]), upperBound=str(ends["high"]), numPartitions=str(parts)).toDF("key")
    shares = [i / parts for i in range(1, parts)]
    cuts = keys.agg(F.percentile_approx("key", shares, 100 * parts).alias("cuts")).first()["cuts"]
    cuts = [c for c in sorted(set(cuts)) if ends["low"] <= c < ends["high"]]  # a cut is the last key of its stretch
    said = lambda v: f"'{v}'" if isinstance(v, date) else str(v)  # noqa: E731  (as Spark writes the bounds of dates and timestamps)
    if not cuts:
        return ["1 = 1"]
    middle = [f"{column} > {said(a)} AND {column} <= {said(b)}" for a, b in zip(cuts, cuts[1:])]
    return [f"{column} <= {said(cuts[0])} OR {column} IS NULL", *middle, f"{column} > {said(cuts[-1])}"]


def list_tables(spark: SparkSession, database: str | None = None) -> DataFrame:
    """(name, kind, n_tables, n_views, n_rows) of base tables and views, temporary views included, with the number of both.

    n_rows: what the catalog's statistics say of a table (see analyze_tables), null without; views have none.
    """
    listed = spark.catalog.listTables(database) if database else spark.catalog.listTables()
    found = sorted((t.name, "view" if t.isTemporary or t.tableType == "VIEW" else "table", bool(t.isTemporary)) for t in listed)
    count = lambda kind: sum(k == kind for _, k, _ in found)
    rows = [(name, kind, count("table"), count("view"), None if kind == "view" else _rows_by_statistics(spark, name, database)) for name, kind, _ in found]
    return spark.createDataFrame(rows, "name string, kind string, n_tables int, n_views int, n_rows long")


def _rows_by_statistics(spark: SparkSession, name: str, database: str | None) -> int | None:
    full = f"{_named(database)}.{_named(name)}" if database else _named(name)
    said = {r["col_name"]: r["data_type"] for r in spark.sql(f"DESCRIBE TABLE EXTENDED {full}").collect()}  # a row for each column and property
    found = re.search(r"(\d+) rows", said.get("Statistics") or "")
    return int(found[1]) if found else None


def _named(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def analyze_tables(spark: SparkSession, database: str) -> None:
    """Let the catalog count the rows of every base table; the statistics also guide Spark's joins."""
    spark.sql(f"ANALYZE TABLES IN {_named(database)} COMPUTE STATISTICS")


def save_database(spark: SparkSession, database: str, tables: dict[str, DataFrame], views: dict[str, str] | None = None, path: str | None = None) -> None:
    """Save tables in a database, with views (name -> query over them), and have the catalog count them.  path: the database's folder."""
    spark.sql(f"CREATE DATABASE IF NOT EXISTS {_named(database)}" + (f" LOCATION '{path}'" if path else ""))
    for name, df in tables.items():
        df.write.mode("overwrite").saveAsTable(f"{_named(database)}.{_named(name)}")
    for name, query in (views or {}).items():
        spark.sql(f"CREATE OR REPLACE VIEW {_named(database)}.{_named(name)} AS {query}")
    analyze_tables(spark, database)


def describe_table(df: DataFrame) -> DataFrame:
    """(position, name, type, not_null, row_count)."""
    rows = [(i, f.name, f.dataType.simpleString(), not f.nullable) for i, f in enumerate(df.schema.fields)]
    schema = df.sparkSession.createDataFrame(rows, "position int, name string, type string, not_null boolean")
    return schema.crossJoin(F.broadcast(df.agg(F.count(F.lit(1)).alias("row_count"))))  # one row


def sample_rows(df: DataFrame, n: int = 10, max_len: int = 50, key: str | None = None) -> DataFrame:
    """The first n rows by key as text: long cells are cut and end in ..., null reads None."""
    key = key or df.columns[0]
    text = lambda c: F.coalesce(quoted(c).cast("string"), F.lit("None"))
    first = df.orderBy(quoted(key)).limit(n)
    return first.select(*[F.when(F.length(text(c)) > max_len, F.concat(F.substring(text(c), 1, max_len - 3), F.lit("..."))).otherwise(text(c)).alias(c) for c in df.columns])


def by_table(writer: DataFrameWriter) -> DataFrameWriter:
    """Overwrite the folders of the tables that are written, and leave all others as they are."""
    return writer.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("table_name")


def save_config(df: DataFrame, path: str) -> None:
    """One JSON folder for each table_name; configurations of other tables stay."""
    by_table(df.write).json(path)


def load_config(spark: SparkSession, path: str, table: str, columns: list[str], mode: str = "train") -> dict:
    """The table's configuration; a column without a weight gets 1 / number of columns.

    Without one, train mode starts from the defaults and cluster mode is an error.
    """
    weight = 1 / max(1, len(columns))
    try:
        row = spark.read.schema(CONFIG).json(path).where(F.col("table_name") == table).first()
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        row = None
    if row is None and mode != "train":
        raise ValueError(f"no configuration for table {table}: train it first")
    defaults = TRAIN_DEFAULTS if mode == "train" else CLUSTER_DEFAULTS
    stored = {k: v for k, v in (row.asDict() if row else {}).items() if v is not None}
    return defaults | stored | {"table_name": table, "weights": {c: weight for c in columns} | dict(stored.get("weights") or {})}


def write_report(report: DataFrame, path: str) -> None:
    """Cluster reports as JSON lines; with a table_name a folder for each table, and reports of other tables stay."""
    (by_table(report.write) if "table_name" in report.columns else report.write.mode("overwrite")).json(path)
