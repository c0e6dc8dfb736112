"""Input tables: schemas, readers and the mapping onto the TPC-H-style test data.

The recommendation jobs read six relational tables (product, stock, sale,
sale_detail, review, users); the scoring jobs read one record table each
(employee records, product records). All are plain DataFrames, so any Spark
source works: parquet, a catalog table, JDBC.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shopcast.session import materialize

SCHEMAS: dict[str, T.StructType] = {
    "product": T.StructType([
        T.StructField("id", T.LongType()),
        T.StructField("name", T.StringType()),
        T.StructField("price", T.DoubleType()),
    ]),
    "stock": T.StructType([
        T.StructField("id", T.LongType()),
        T.StructField("product_id", T.LongType()),
    ]),
    "sale": T.StructType([
        T.StructField("id", T.LongType()),
        T.StructField("user_id", T.LongType()),
        T.StructField("status", T.StringType()),
        T.StructField("grand_total", T.DoubleType()),
        T.StructField("created_at", T.TimestampNTZType()),
    ]),
    "sale_detail": T.StructType([
        T.StructField("sale_id", T.LongType()),
        T.StructField("stock_id", T.LongType()),
        T.StructField("quantity", T.DoubleType()),
    ]),
    "review": T.StructType([
        T.StructField("id", T.LongType()),
        T.StructField("user_id", T.LongType()),
        T.StructField("product_id", T.LongType()),
        T.StructField("rating", T.DoubleType()),
    ]),
    "users": T.StructType([
        T.StructField("id", T.LongType()),
        T.StructField("email", T.StringType()),
    ]),
    "employee_record": T.StructType([
        T.StructField("employee_id", T.LongType()),
        T.StructField("completed_tasks", T.DoubleType()),
        T.StructField("total_tasks", T.DoubleType()),
        T.StructField("avg_task_hours", T.DoubleType()),
    ]),
    "product_record": T.StructType([
        T.StructField("product_id", T.LongType()),
        T.StructField("name", T.StringType()),
        T.StructField("price", T.DoubleType()),
        T.StructField("units_sold", T.DoubleType()),
        T.StructField("stock", T.DoubleType()),
    ]),
}

RELATIONAL = ("product", "stock", "sale", "sale_detail", "review", "users")

COMPLETED = "completed"
#: Column by which a stored sale table is partitioned.
SALE_MONTH = "sale_month"


@dataclass(frozen=True)
class Tables:
    """The six relational inputs of the recommendation jobs."""

    product: DataFrame
    stock: DataFrame
    sale: DataFrame
    sale_detail: DataFrame
    review: DataFrame
    users: DataFrame

    @classmethod
    def from_frames(cls, **frames: DataFrame) -> "Tables":
        missing = [name for name in RELATIONAL if name not in frames]
        if missing:
            raise ValueError(f"missing tables: {missing}")
        return cls(**{name: normalize(frames[name], name) for name in RELATIONAL})


def store_bucketed(t: Tables, prefix: str, folder: str, buckets: int = 64) -> None:
    """Write ``t`` as tables ``<prefix>_<name>`` of the catalog, with their files below ``folder``.

    ``sale`` and ``sale_detail`` are dealt into the same buckets by the id of the sale and sorted by it, so the join of the
    two largest tables needs no shuffle; ``sale`` is also partitioned by the month it was made in, so that
    recent sales are read alone. ``buckets`` is fixed for the life of the tables: some MB to a bucket of a month.
    """
    month = F.trunc(F.col("created_at").cast("date"), "month")
    layouts = {"sale": (t.sale.withColumn(SALE_MONTH, month), "id", [SALE_MONTH]), "sale_detail": (t.sale_detail, "sale_id", [])}
    for name in RELATIONAL:
        df, key, parts = layouts.get(name, (getattr(t, name), None, []))
        if key:  # a task has whole buckets, so it writes a file for each
            writer = df.repartition(buckets, key).write.bucketBy(buckets, key).sortBy(key)
        else:
            writer = df.write
        writer = writer.partitionBy(*parts) if parts else writer
        writer.mode("overwrite").option("path", f"{folder}/{name}").saveAsTable(f"{prefix}_{name}")


def catalog_tables(spark: SparkSession, prefix: str) -> Tables:
    """The tables that :func:`store_bucketed` wrote."""
    return Tables(**{name: spark.table(f"{prefix}_{name}") for name in RELATIONAL})


def normalize(df: DataFrame, name: str) -> DataFrame:
    """Cast the known columns to the fixed schema; NaN becomes NULL.

    Extra columns pass through unchanged (record inputs carry them to the
    output).
    """
    schema = SCHEMAS[name]
    missing = [f.name for f in schema.fields if f.name not in df.columns]
    if missing:
        raise ValueError(f"{name}: missing required columns {missing}")
    cols: list[Column] = []
    known = {f.name: f.dataType for f in schema.fields}
    for c in df.columns:
        if c in known:
            # A string that is no date, or no number, is NULL rather than the end of the job.
            col = F.col(c).try_cast(known[c])
            if isinstance(known[c], T.DoubleType):
                col = F.nanvl(col, F.lit(None).cast("double"))
            cols.append(col.alias(c))
        else:
            cols.append(F.col(c))
    return df.select(*cols)


def require_columns(df: DataFrame, required: list[str]) -> None:
    """Plan-time check that every required column is present."""
    missing = [c for c in required if c not in df.columns]
    if missing:
        raise ValueError(f"the input lacks the columns {missing}")


def require_rows(df: DataFrame, what: str = "input") -> None:
    """Raise when the input is empty (a limit-1 job, not a count)."""
    if df.isEmpty():
        raise ValueError(f"{what}: the input has no rows")


def read_records(spark: SparkSession, path: str, kind: str, fmt: str = "json",
                 extra: T.StructType | None = None) -> DataFrame:
    """Employee or product records from JSON files (an array, or an object per record) or another format.

    The schema is fixed: the known columns and those of ``extra``, which pass
    through. So the files are read once, and a column that is missing in them is
    NULL. An input without rows is an error.
    """
    schema = T.StructType([*SCHEMAS[kind].fields, *(extra.fields if extra else [])])
    reader = spark.read.schema(schema)
    df = reader.option("multiLine", True).json(path) if fmt == "json" else reader.format(fmt).load(path)
    require_rows(df, kind)
    return normalize(df, kind)


@dataclass(frozen=True)
class Ingest:
    """Records of files: those ``accepted``, with their types; those ``rejected`` (``reason, record``); and how many of each (``counts``: read, accepted, rejected)."""

    accepted: DataFrame
    rejected: DataFrame
    counts: dict[str, int]


def ingest_records(spark: SparkSession, path: str, kind: str, key: str, fmt: str = "json", multi_line: bool = True,
                   extra: T.StructType | None = None) -> Ingest:
    """Employee or product records from files, with those that can't be read set aside instead of filled with NULLs.

    Every value is read as text first. A record is rejected when it is no record of the format ("unreadable"), when its
    ``key`` is missing ("no <key>"), or when a value is not of its column's type ("<column> is no <type>", the first such column in the
    order of the schema). A missing value, or NaN, is NULL and no reason. The files are read once: what was read and judged is
    written, and the two tables and the counts come from that.
    """
    fields = [*SCHEMAS[kind].fields, *(extra.fields if extra else [])]
    corrupt, reason = "__unreadable", F.lit(None).cast("string")
    text = T.StructType([*[T.StructField(f.name, T.StringType()) for f in fields], T.StructField(corrupt, T.StringType())])
    if fmt in ("json", "csv"):
        raw = spark.read.schema(text).option("columnNameOfCorruptRecord", corrupt).option("multiLine", multi_line).option("header", True).format(fmt).load(path)
    else:
        have = spark.read.format(fmt).load(path)
        raw = have.select(*[(F.col(f"`{f.name}`") if f.name in have.columns else F.lit(None)).cast("string").alias(f.name) for f in fields], F.lit(None).cast("string").alias(corrupt))
    for f in reversed(fields):
        reason = F.when(F.col(f.name).isNotNull() & F.col(f.name).try_cast(f.dataType).isNull(), F.lit(f"{f.name} is no {f.dataType.simpleString()}")).otherwise(reason)
    reason = F.when(F.col(corrupt).isNotNull(), F.lit("unreadable")).when(F.col(key).isNull(), F.lit(f"no {key}")).otherwise(reason)
    judged = materialize(raw.withColumn("__reason", reason))
    n = judged.agg(F.count(F.lit(1)).alias("read"), F.count_if(F.col("__reason").isNull()).alias("accepted"), F.count("__reason").alias("rejected")).first()
    values = F.to_json(F.struct(*[F.col(f.name) for f in fields]))
    rejected = judged.where(F.col("__reason").isNotNull()).select(F.col("__reason").alias("reason"), F.coalesce(corrupt, values).alias("record"))
    accepted = normalize(judged.where(F.col("__reason").isNull()).select(*[F.col(f.name) for f in fields]), kind)
    if extra:
        accepted = accepted.withColumns({f.name: F.col(f.name).try_cast(f.dataType) for f in extra.fields})
    return Ingest(accepted, rejected, n.asDict())


# ---------------------------------------------------------------------------
# Mapping of the TPC-H-style test tables onto the logical inputs.
# The same SELECTs are used as leading CTEs of the DuckDB oracles, so both
# engines see identical inputs.
# ---------------------------------------------------------------------------

MAPPING_SQL: dict[str, str] = {
    "product": "select p_partkey as id, p_name as name, p_retailprice as price from part",
    "stock": (
        "select distinct l_partkey * 1000000 + l_suppkey as id, l_partkey as product_id from lineitem"
    ),
    "sale": (
        "select o_orderkey as id, o_custkey as user_id, "
        "case o_orderstatus when 'F' then 'completed' when 'O' then 'pending' else 'cancelled' end as status, "
        "o_totalprice as grand_total, o_orderdate as created_at, o_orderpriority as priority "
        "from orders"
    ),
    "sale_detail": (
        "select l_orderkey as sale_id, l_partkey * 1000000 + l_suppkey as stock_id, "
        "l_quantity as quantity from lineitem"
    ),
    "review": (
        "select l_orderkey * 100 + l_linenumber as id, o_custkey as user_id, l_partkey as product_id, "
        "cast(case when l_orderkey % 17 = 0 then null "
        "else 1 + (l_orderkey + l_partkey + l_linenumber) % 5 end as double) as rating "
        "from lineitem join orders on l_orderkey = o_orderkey where l_returnflag = 'R'"
    ),
    "users": (
        "select c_custkey as id, concat(lower(replace(c_name, '#', '.')), '@example.com') as email "
        "from customer"
    ),
    "employee_record": (
        "select user_id as employee_id, "
        "cast(sum(case when event_type in ('click', 'purchase') then 1 else 0 end) as double) as completed_tasks, "
        "cast(sum(case when event_type <> 'signup' then 1 else 0 end) as double) as total_tasks, "
        "cast(sum(case when event_type = 'purchase' then cast(value as decimal(18,2)) end) as double) "
        "/ nullif(sum(case when event_type = 'purchase' then 1 else 0 end), 0) / 100.0E0 as avg_task_hours "
        "from events group by user_id"
    ),
    "product_record": (
        "select p_partkey as product_id, p_name as name, p_retailprice as price, "
        "coalesce(u.units, 0.0E0) as units_sold, cast(p_size * 10 as double) as stock "
        "from part left join ("
        "select l_partkey, sum(l_quantity) as units from lineitem join orders on l_orderkey = o_orderkey "
        "where o_orderstatus = 'F' group by l_partkey) u on p_partkey = u.l_partkey"
    ),
}

SOURCE_TABLES = ("part", "lineitem", "orders", "customer", "events")


def mapping_ctes(names: list[str] | tuple[str, ...] = tuple(MAPPING_SQL)) -> str:
    """``with a as (...), b as (...)`` prefix for an oracle query."""
    return "with " + ",\n".join(f"{n} as ({MAPPING_SQL[n]})" for n in names)


def register_source(spark: SparkSession, sf_dir: str, names=SOURCE_TABLES) -> None:
    for n in names:
        spark.read.parquet(f"{sf_dir}/{n}.parquet").createOrReplaceTempView(f"src_{n}")


def _mapped(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    register_source(spark, sf_dir)
    # Point the table names at the registered src_ views, token by token.
    tokens = [f"src_{tok}" if tok in SOURCE_TABLES else tok for tok in MAPPING_SQL[name].split(" ")]
    return spark.sql(" ".join(tokens))


def tpch_tables(spark: SparkSession, sf_dir: str) -> Tables:
    """The six relational inputs derived from the TPC-H-style parquet files."""
    return Tables.from_frames(**{n: _mapped(spark, sf_dir, n) for n in RELATIONAL})


def tpch_employee_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mapped(spark, sf_dir, "employee_record")


def tpch_product_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mapped(spark, sf_dir, "product_record")


def user_lookup(t: Tables, emails: DataFrame) -> DataFrame:
    """Resolve e-mails to user ids: ``email, user_id`` (first match = smallest id).

    E-mails without a user are absent; :func:`unknown_emails` lists them.
    """
    first = t.users.where(F.col("email").isNotNull()).groupBy("email").agg(F.min("id").alias("user_id"))
    return emails.select("email").distinct().join(first, "email")


def unknown_emails(t: Tables, emails: DataFrame) -> DataFrame:
    return emails.select("email").distinct().join(t.users.select("email"), "email", "left_anti")
