"""Queries over the test tables, one or more per operator, with the SQL that gives the same result.

Queries that need a source other than Parquet first write the given table in that form to the scratch folder. All of
them take whole tables; where an operator needs a stored table and a batch, two different tables play these parts.
"""

from __future__ import annotations

import sys
import uuid
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

sys.path.insert(0, str(Path(__file__).resolve().parent))

import tableload as tl  # noqa: E402
from tableload.plans import jobs  # noqa: E402

try:  # the training-data operators may be left out, or a package that they need be missing
    from tableload.llm import queries as llm  # noqa: E402
except ImportError as missing:
    print(f"without the training-data operators: {missing}", file=sys.stderr)
    llm = None
try:
    import corpus_pipeline  # noqa: E402
except ImportError as missing:
    print(f"without the corpus pipeline: {missing}", file=sys.stderr)
    corpus_pipeline = None

SMOKE_DIR = "/root/testdata/sf0.001"

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def money(column: str):
    return F.col(column).cast("decimal(18,2)")


def day_text(column: str):
    return F.date_format(column, "yyyy-MM-dd")


def micros_text(column: str):
    return F.date_format(column, "yyyy-MM-dd HH:mm:ss.SSSSSS")


# --- Inputs shared by several queries -------------------------------------------------------------------------------


def customers_as_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").withColumn("c_acctbal", money("c_acctbal"))


def orders_as_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        table(spark, sf_dir, "orders")
        .withColumn("o_totalprice", money("o_totalprice"))
        .withColumn("o_orderdate", day_text("o_orderdate"))
    )


def lines_as_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    prices = {c: money(c) for c in ("l_quantity", "l_extendedprice", "l_discount", "l_tax")}
    return table(spark, sf_dir, "lineitem").withColumns(prices).withColumn("l_shipdate", day_text("l_shipdate"))


LINES_TYPED = """
SELECT CAST(l_orderkey AS INTEGER) AS l_orderkey, CAST(l_partkey AS INTEGER) AS l_partkey,
       CAST(l_suppkey AS INTEGER) AS l_suppkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax,
       l_returnflag, l_linestatus, strftime(l_shipdate, '%Y-%m-%d') AS l_shipdate
FROM lineitem
"""


def order_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What customers ordered: several postings per account and day, the highest version being the latest."""
    return table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("account"),
        F.col("o_orderdate").cast("date").alias("day"),
        F.col("o_orderkey").alias("version"),
        money("o_totalprice").alias("amount"),
        F.col("o_orderstatus").alias("status"),
    )


def line_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What suppliers shipped, in the columns of ``order_postings``; some accounts and days occur in both."""
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("account"),
        F.col("l_shipdate").cast("date").alias("day"),
        F.col("l_orderkey").alias("version"),
        money("l_extendedprice").alias("amount"),
        F.col("l_linestatus").alias("status"),
    )


def shown(postings: DataFrame) -> DataFrame:
    """Postings in types that every engine hands over alike."""
    return postings.withColumn("day", F.col("day").cast("string")).withColumn("amount", F.col("amount").cast("double"))


POSTINGS = """
WITH order_postings AS (
  SELECT o_custkey AS account, CAST(o_orderdate AS DATE) AS day, o_orderkey AS version,
         CAST(o_totalprice AS DECIMAL(18,2)) AS amount, o_orderstatus AS status FROM orders),
line_postings AS (
  SELECT l_suppkey AS account, CAST(l_shipdate AS DATE) AS day, l_orderkey AS version,
         CAST(l_extendedprice AS DECIMAL(18,2)) AS amount, l_linestatus AS status FROM lineitem),
stored AS (
  SELECT * FROM order_postings QUALIFY row_number() OVER
    (PARTITION BY account, day ORDER BY version DESC, amount DESC, status DESC) = 1),
batch AS (
  SELECT * FROM line_postings QUALIFY row_number() OVER
    (PARTITION BY account, day ORDER BY version DESC, amount DESC, status DESC) = 1)
"""

SHOWN = "SELECT account, CAST(day AS VARCHAR) AS day, version, CAST(amount AS DOUBLE) AS amount, status FROM "

POSTING_KEY, POSTING_ORDER = ["account", "day"], ["version"]


def stored_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = tl.scratch_path(spark, "stored")
    tl.bulk_load(order_postings(spark, sf_dir), path, POSTING_KEY, POSTING_ORDER)
    return spark.read.parquet(path)


def event_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").withColumn("ts", micros_text("ts"))


EVENT_SCHEMA = (
    StructType()
    .add("event_id", "long")
    .add("ts", "string")
    .add("user_id", "long")
    .add("event_type", "string")
    .add("value", "double")
    .add("props", "string")
)

EVENTS = """
SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S.%f') AS ts, user_id, event_type, value, props FROM events
"""

LATEST_EVENTS = (
    f"SELECT * FROM ({EVENTS}) QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1"
)


# Rows of a file that stands for an input: a hundred megabytes or so.
FILE_ROWS = 500_000


def in_files(df: DataFrame, rows: int, least: int) -> DataFrame:
    """A table of so many rows dealt out for files of about ``FILE_ROWS`` rows each, ``least`` of them at least."""
    return df.repartition(max(least, rows // FILE_ROWS))


def event_files(spark: SparkSession, sf_dir: str) -> str:
    """The events as envelopes in text files, about a hundred megabytes of events each and four files at least."""
    path, events = tl.scratch_path(spark, "envelopes"), event_records(spark, sf_dir)
    in_files(tl.encode_envelope(events), events.count(), 4).write.text(path)
    return path


def parties(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Customers or suppliers in common columns."""
    c = name[0]
    return table(spark, sf_dir, name).select(
        F.col(f"{c}_{'cust' if c == 'c' else 'supp'}key").alias("id"),
        F.col(f"{c}_name").alias("name"),
        F.col(f"{c}_nationkey").alias("nation"),
        F.col(f"{c}_acctbal").alias("balance"),
        F.floor(F.col(f"{c}_acctbal") / 250).cast("int").alias("band"),
    )


PARTIES = """
WITH customers AS (
  SELECT c_custkey AS id, c_name AS name, c_nationkey AS nation, c_acctbal AS balance,
         CAST(floor(c_acctbal / 250) AS INTEGER) AS band FROM customer),
suppliers AS (
  SELECT s_suppkey AS id, s_name AS name, s_nationkey AS nation, s_acctbal AS balance,
         CAST(floor(s_acctbal / 250) AS INTEGER) AS band FROM supplier)
"""


def new_database(spark: SparkSession) -> str:
    name = f"tableload_{uuid.uuid4().hex}"
    spark.sql(
        "CREATE DATABASE IDENTIFIER(:name) LOCATION :path", args={"name": name, "path": tl.scratch_path(spark, name)}
    )
    return name


def entry_of(spark: SparkSession, sf_dir: str, name: str) -> dict:
    """The catalog entry of a given table."""
    columns = [{"Name": f.name, "Type": f.dataType.simpleString()} for f in table(spark, sf_dir, name).schema]
    return {"Table": {"StorageDescriptor": {"Columns": columns, "Location": f"{sf_dir}/{name}.parquet"}}}


# --- Sources --------------------------------------------------------------------------------------------------------


def csv_scan_comma(spark, sf_dir):
    path = tl.scratch_path(spark, "orders-csv")
    tl.write_csv(orders_as_text(spark, sf_dir), path)
    return tl.scan_csv(spark, path)


def csv_scan_semicolon(spark, sf_dir):
    path = tl.scratch_path(spark, "customer-csv")
    tl.write_csv(customers_as_text(spark, sf_dir), path, sep=";")
    return tl.scan_csv(spark, path, sep=";")


def csv_scan_quoted_texts(spark, sf_dir):
    path = tl.scratch_path(spark, "conversations-csv")
    tl.write_csv(table(spark, sf_dir, "conversations"), path)
    return tl.scan_csv(spark, path, multiLine=True)


def csv_scan_quoted_splits(spark, sf_dir):
    """The same in splits of 64 KB, which cut values with line breaks."""
    path = tl.scratch_path(spark, "conversations-csv")
    tl.write_csv(table(spark, sf_dir, "conversations"), path)
    return tl.scan_quoted_csv(spark, path, max_partition_bytes=64 << 10)


def large_csv_scan(spark, sf_dir):
    path = tl.scratch_path(spark, "lineitem-csv")
    tl.write_csv(lines_as_text(spark, sf_dir), path)
    return tl.scan_large_csv(spark, path).withColumn("l_shipdate", F.col("l_shipdate").cast("string"))


def parquet_declared_schema(spark, sf_dir):
    schema = StructType.fromDDL("c_custkey bigint, c_nationkey bigint, c_comment string, c_name string")
    return tl.scan_parquet(spark, f"{sf_dir}/customer.parquet", schema)


def catalog_entry_scan(spark, sf_dir):
    return tl.scan_catalog_entry(spark, entry_of(spark, sf_dir, "part"))


def catalog_table_scan(spark, sf_dir):
    database = new_database(spark)
    schema = table(spark, sf_dir, "supplier").schema
    tl.create_table(spark, f"{database}.supplier", schema, f"{sf_dir}/supplier.parquet")
    return tl.scan_catalog_table(spark, database, "supplier")


def format_scan(spark, sf_dir):
    path, schema = tl.scratch_path(spark, "supplier"), table(spark, sf_dir, "supplier").schema
    tl.create(table(spark, sf_dir, "supplier"), f"{path}/csv", "csv", header=True)
    parquet = tl.scan(spark, f"{sf_dir}/supplier.parquet")
    csv = tl.scan(spark, f"{path}/csv", "csv").select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema])
    return csv.withColumn("format", F.lit("csv")).unionByName(parquet.withColumn("format", F.lit("parquet")))


def records_to_table(spark, sf_dir):
    texts = event_records(spark, sf_dir).select(F.to_json(F.struct("*")).alias("value"))
    return tl.records_to_table(spark, texts, EVENT_SCHEMA)


def records_without_schema(spark, sf_dir):
    texts = table(spark, sf_dir, "conversations").select(F.to_json(F.struct("*")).alias("value"))
    payload = F.col("payload")
    return tl.records_to_table(spark, texts).select(*[payload[c].alias(c) for c in ("conv_id", "turn", "role", "text")])


def envelope_decode(spark, sf_dir):
    return tl.good_records(tl.decode_envelope(tl.encode_envelope(event_records(spark, sf_dir)), EVENT_SCHEMA))


def envelope_decode_texts(spark, sf_dir):
    documents = table(spark, sf_dir, "documents")
    return tl.only_good_records(tl.decode_envelope(tl.encode_envelope(documents, 10), documents.schema, ["doc_id"]))


def envelope_quarantine(spark, sf_dir):
    """Errors come with broken base64 and signups with something that is no JSON; the rest is sound."""
    payload = F.base64(F.encode(F.to_json(F.struct(*EVENT_SCHEMA.fieldNames())), "UTF-8"))
    kind = F.col("event_type")
    data = (
        F.when(kind == "error", F.lit("%%%"))
        .when(kind == "signup", F.base64(F.encode(F.lit("no json"), "UTF-8")))
        .otherwise(payload)
    )
    record = F.array(F.struct(F.struct(data.alias("data")).alias("kinesis"))).alias("Records")
    events = event_records(spark, sf_dir).select(F.to_json(F.struct(record)).alias("value"))
    decoded = tl.decode_envelope(events, EVENT_SCHEMA, ["event_id"])
    found = F.coalesce(F.concat(F.lit("bad "), "_bad_record"), "event_type").alias("found")
    return decoded.groupBy(found).agg(
        F.count(F.lit(1)).alias("records"),
        F.sum(F.when(F.col("_bad_record").isNull(), F.col("event_id"))).alias("id_sum"),
    )


# --- Columns and SQL ------------------------------------------------------------------------------------------------


def load_stamp(spark, sf_dir):
    stamped = tl.stamp_load_time(table(spark, sf_dir, "orders"))
    return stamped.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_distinct("last_upd_timestamp").alias("n_stamps"),
        F.count_if(F.col("last_upd_timestamp").isNull()).alias("n_unstamped"),
    )


def projected_view(spark, sf_dir):
    view = f"customer_{uuid.uuid4().hex}"
    table(spark, sf_dir, "customer").createTempView(view)
    try:
        return tl.project(tl.select_all(tl.scan_view(spark, view)), ["c_mktsegment", "c_name", "c_custkey"])
    finally:
        spark.catalog.dropTempView(view)


USER_SQL = """
SELECT n_name, o_orderpriority, count(*) AS n_lines,
       CAST(round(sum(l_extendedprice * (1 - l_discount)), 2) AS DOUBLE) AS revenue
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
     JOIN nation ON c_nationkey = n_nationkey
WHERE l_returnflag <> 'R'
GROUP BY n_name, o_orderpriority
"""


def user_sql(spark, sf_dir):
    views = {n: table(spark, sf_dir, n) for n in ("lineitem", "orders", "customer", "nation")}
    return tl.sql_transform(spark, USER_SQL.replace("'R'", ":flag"), views, flag="R")


# --- Sinks ----------------------------------------------------------------------------------------------------------


def append_twice(spark, sf_dir):
    path = tl.scratch_path(spark, "parties")
    for name in ("supplier", "customer"):
        tl.append(parties(spark, sf_dir, name), path)
    return spark.read.parquet(path)


def overwrite_replaces(spark, sf_dir):
    path = tl.scratch_path(spark, "parties")
    for name in ("supplier", "customer"):
        tl.overwrite(parties(spark, sf_dir, name), path)
    return spark.read.parquet(path)


def create_new(spark, sf_dir):
    path = tl.scratch_path(spark, "part")
    tl.create(table(spark, sf_dir, "part"), path)
    return spark.read.parquet(path)


def single_csv_report(spark, sf_dir):
    """The check report, read back from its one file."""
    path = tl.scratch_path(spark, "reports")
    tl.write_reports(spark, tl.verify(table(spark, sf_dir, "customer"), [customer_checks()]), path)
    columns = "`check` string, check_level string, check_status string, `constraint` string, constraint_status string, "
    return spark.read.schema(columns + "constraint_message string").csv(f"{path}/verification-results").na.fill("")


def create_and_insert_all(spark, sf_dir):
    name = f"{new_database(spark)}.orders"
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice")
    tl.create_table(spark, name, orders.schema, tl.scratch_path(spark, "orders"), properties={"kind": "test"})
    tl.insert_all(orders, name)
    return tl.scan_table(spark, name)


def insert_by_name(spark, sf_dir):
    name = f"{new_database(spark)}.customer"
    customers = table(spark, sf_dir, "customer")
    tl.create_table(spark, name, customers.schema, tl.scratch_path(spark, "customer"))
    tl.insert_by_name(customers, name, ["c_mktsegment", "c_acctbal", "c_name", "c_custkey"])
    return tl.scan_table(spark, name)


def partitioned_table(spark, sf_dir):
    """Customers by balance band; the bands that suppliers have are then replaced by the suppliers."""
    name, path = f"{new_database(spark)}.parties", tl.scratch_path(spark, "parties")
    customers = parties(spark, sf_dir, "customer")
    tl.create_table(spark, name, customers.schema, path, partition_by=["band"])
    tl.insert_by_name(customers.hint("rebalance", "band"), name)
    tl.overwrite_partitions(parties(spark, sf_dir, "supplier"), path, ["band"])
    return tl.scan_parquet(spark, path, customers.schema).select(*customers.columns)


def table_partitions_replaced(spark, sf_dir):
    """The same by an insert into the table, which also has to learn of bands that only suppliers have."""
    name = f"{new_database(spark)}.parties"
    customers, suppliers = parties(spark, sf_dir, "customer"), parties(spark, sf_dir, "supplier")
    tl.create_table(spark, name, customers.schema, tl.scratch_path(spark, "parties"), partition_by=["band"])
    tl.insert_by_name(customers.hint("rebalance", "band"), name)
    tl.replace_partitions(suppliers.hint("rebalance", "band"), name)
    return tl.scan_table(spark, name)


def warehouse_load(spark, sf_dir):
    database = new_database(spark)
    for name in ("supplier", "customer", "customer"):
        tl.load_warehouse(parties(spark, sf_dir, name), "parties", database)
    return spark.table(f"{database}.parties")


def observed_write_counts(spark, sf_dir):
    rows, counted = tl.observe_counts(table(spark, sf_dir, "orders"), ["o_custkey", "o_orderdate"])
    tl.append(rows, tl.scratch_path(spark, "orders"))
    found = counted.get
    return spark.createDataFrame(
        [(found["rows"], found["o_custkey"], found["o_orderdate"])], "n_rows bigint, n_cust bigint, n_date bigint"
    )


# --- Keyed changes --------------------------------------------------------------------------------------------------


def dedupe_batch(spark, sf_dir):
    return tl.dedupe_batch(table(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"]).withColumn(
        "ts", micros_text("ts")
    )


def keyed_parallelism(spark, sf_dir):
    return tl.dedupe_batch(table(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"], parallelism=2).withColumn(
        "ts", micros_text("ts")
    )


def bulk_load(spark, sf_dir):
    return shown(stored_postings(spark, sf_dir))


def upsert_with(**options) -> Query:
    def query(spark, sf_dir):
        target, batch = stored_postings(spark, sf_dir), line_postings(spark, sf_dir)
        return shown(tl.upsert(target, batch, POSTING_KEY, POSTING_ORDER, **options))

    return query


def upsert_bucketed_target(spark, sf_dir):
    """A batch that is too large to broadcast, against a table stored by buckets of the key."""
    name = f"{new_database(spark)}.postings"
    tl.bulk_load_table(order_postings(spark, sf_dir), name, POSTING_KEY, POSTING_ORDER, buckets=8)
    batch = line_postings(spark, sf_dir)
    return shown(tl.upsert(spark.table(name), batch, POSTING_KEY, POSTING_ORDER, max_broadcast_bytes=0))


def upsert_snapshots(spark, sf_dir):
    """Two loads into a published table, the second one repeated as after a lost driver."""
    path = tl.scratch_path(spark, "table")
    tl.upsert_snapshot(order_postings(spark, sf_dir), path, POSTING_KEY, POSTING_ORDER)
    for _ in range(2):
        tl.upsert_snapshot(line_postings(spark, sf_dir), path, POSTING_KEY, POSTING_ORDER)
    return shown(tl.read_snapshot(spark, path))


def upsert_touched_partitions(spark, sf_dir):
    """The same in a table partitioned by year, rewriting it in place."""
    path, year = tl.scratch_path(spark, "table"), F.year("day")
    for postings in (order_postings(spark, sf_dir), line_postings(spark, sf_dir)):
        batch = postings.withColumn("year", year)
        tl.upsert_partitions(batch, path, POSTING_KEY, POSTING_ORDER, ["year"], keep_latest=True)
    return shown(spark.read.parquet(path).drop("year"))


def keyed_table_by_name(spark, sf_dir):
    """Two loads into a published and into a partitioned table, both read by name, commit columns included."""
    database, found = new_database(spark), []
    for kind in ("snapshots", "partitions"):
        path, name = tl.scratch_path(spark, "table"), f"{database}.{kind}"
        for batch_id, postings in enumerate((order_postings(spark, sf_dir), line_postings(spark, sf_dir))):
            options = {"keep_latest": True, "batch_id": batch_id, "table": name}
            if kind == "snapshots":
                tl.upsert_snapshot(postings, path, POSTING_KEY, POSTING_ORDER, **options)
            else:
                batch = postings.withColumn("year", F.year("day"))
                tl.upsert_partitions(batch, path, POSTING_KEY, POSTING_ORDER, ["year"], **options)
        commit = F.split("_commit_seqno", "_")[0].cast("int").alias("committed_by")
        keyed = F.col("_record_key").startswith("account:").alias("keyed")
        found.append(shown(spark.table(name)).select("account", "day", "version", "amount", "status", commit, keyed))
    return found[0].withColumn("kind", F.lit("snapshots")).unionByName(found[1].withColumn("kind", F.lit("partitions")))


def upsert_moved_partitions(spark, sf_dir):
    """Postings by status: a posting whose status changed leaves its old partition, found by the locator."""
    path, options = tl.scratch_path(spark, "table"), {"unique_across_partitions": True, "locator_buckets": 8}
    for postings in (order_postings(spark, sf_dir), line_postings(spark, sf_dir)):
        tl.upsert_partitions(postings, path, POSTING_KEY, POSTING_ORDER, ["status"], **options)
    return shown(tl.read_partitions(spark, path))


def upsert_partitions_new_column(spark, sf_dir):
    """The second load brings a column of its own; read by path and by name."""
    path, name = tl.scratch_path(spark, "table"), f"{new_database(spark)}.postings"
    postings = order_postings(spark, sf_dir), line_postings(spark, sf_dir).withColumn("origin", F.lit("lines"))
    for batch in postings:
        batch = batch.withColumn("year", F.year("day"))
        tl.upsert_partitions(batch, path, POSTING_KEY, POSTING_ORDER, ["year"], table=name)
    found = [
        shown(df).select("account", "day", "version", "amount", "status", "origin", F.lit(how).alias("read_by"))
        for how, df in (("path", tl.read_partitions(spark, path)), ("name", spark.table(name)))
    ]
    return found[0].unionByName(found[1])


def rows_since_commit(spark, sf_dir):
    """What the second load has committed, by the range of its commit."""
    path = tl.scratch_path(spark, "table")
    for batch_id, postings in enumerate((order_postings(spark, sf_dir), line_postings(spark, sf_dir))):
        before = 0 if batch_id == 0 else tl.read_partitions(spark, path).agg(F.max("_commit_instant")).first()[0]
        batch = postings.withColumn("year", F.year("day"))
        tl.upsert_partitions(batch, path, POSTING_KEY, POSTING_ORDER, ["year"], batch_id=batch_id)
    return shown(tl.rows_since(spark, path, before).select("account", "day", "version", "amount", "status"))


def merge_partitions(spark, sf_dir):
    """A source without partition columns changes what it matches in a table partitioned by status."""
    path = tl.scratch_path(spark, "table")
    tl.overwrite(line_postings(spark, sf_dir), path, partition_by=["status"])
    source = stored_postings(spark, sf_dir).drop("status")
    tl.merge_partitions(source, path, POSTING_KEY, ["amount", "version"], ["status"], insert=False)
    return shown(tl.read_partitions(spark, path))


def merge_snapshots(spark, sf_dir):
    path = tl.scratch_path(spark, "table")
    tl.overwrite(line_postings(spark, sf_dir), f"{path}/snapshot=0")
    tl.merge_snapshot(stored_postings(spark, sf_dir), path, POSTING_KEY, ["amount", "status"])
    return shown(tl.read_snapshot(spark, path))


def commit_metadata(spark, sf_dir):
    path = tl.scratch_path(spark, "customer")
    committed = tl.with_commit_metadata(table(spark, sf_dir, "customer"), ["c_custkey"], ["c_mktsegment"], batch_id=7)
    tl.append(committed, path, partition_by=["c_mktsegment"])
    return (
        tl.with_file_name(spark.read.parquet(path))
        .groupBy("_partition_path")
        .agg(
            F.count_distinct("_commit_seqno").alias("n_seqnos"),
            F.count_distinct("_commit_time").alias("n_times"),
            F.count_if(F.col("_record_key") == F.col("c_custkey").cast("string")).alias("n_keys"),
            (F.count_distinct("_file_name") > 0).alias("has_files"),
        )
    )


def merge_with(**options) -> Query:
    def query(spark, sf_dir):
        target, source = line_postings(spark, sf_dir), stored_postings(spark, sf_dir)
        return shown(tl.merge_into(target, source, POSTING_KEY, ["amount", "status"], **options))

    return query


MERGED = (
    "SELECT t.account, t.day, t.version, CASE WHEN s.account IS NULL THEN t.amount ELSE s.amount END AS amount, "
    "CASE WHEN s.account IS NULL THEN t.status ELSE s.status END AS status "
    "FROM line_postings t LEFT JOIN stored s ON t.account = s.account AND t.day = s.day"
)
INSERTED = (
    "SELECT * FROM stored s WHERE NOT EXISTS "
    "(SELECT 1 FROM line_postings t WHERE t.account = s.account AND t.day = s.day)"
)


# --- Quality --------------------------------------------------------------------------------------------------------


def rounded(metrics: DataFrame) -> DataFrame:
    return metrics.withColumn("value", F.round("value", 4))


def metrics_report(spark, sf_dir):
    analyzers = [tl.Size(), tl.Completeness("o_orderstatus"), tl.Mean("o_totalprice"), tl.Mean("o_orderstatus")]
    return rounded(tl.metrics_table(spark, tl.run_analyzers(table(spark, sf_dir, "orders"), analyzers)))


def approx_distinct_error(spark, sf_dir):
    """Whether the estimate is within three standard deviations of the exact number."""
    orders = table(spark, sf_dir, "orders")
    estimate = tl.run_analyzers(orders, [tl.ApproxCountDistinct("o_custkey", 0.05)])[0].value
    exact = orders.agg(F.count_distinct("o_custkey").alias("n_distinct"))
    return exact.withColumn("within", F.abs(F.lit(estimate) - F.col("n_distinct")) <= F.col("n_distinct") * 0.15)


def non_negative_large(spark, sf_dir):
    """Balances of more digits than the decimal of the check has."""
    wide = (F.col("c_acctbal").cast("double") * 1e12).cast("string").alias("wide")
    outcome = tl.run_analyzers(table(spark, sf_dir, "customer").select(wide), [tl.NonNegative("wide")])
    return rounded(tl.metrics_table(spark, outcome))


def uniqueness(spark, sf_dir):
    analyzers = [tl.Uniqueness(("l_orderkey", "l_linenumber")), tl.Uniqueness(("l_orderkey",))]
    return rounded(tl.metrics_table(spark, tl.run_analyzers(table(spark, sf_dir, "lineitem"), analyzers)))


def customer_checks() -> tl.Check:
    return (
        tl.Check("Warning", "Customers")
        .has_size(lambda rows: rows >= 1_000)
        .is_complete("c_name")
        .is_unique("c_custkey")
        .is_unique("c_mktsegment")
        .is_non_negative("c_acctbal")
    )


def verification_report(spark, sf_dir):
    return tl.verify(table(spark, sf_dir, "customer"), [customer_checks()]).check_table(spark)


def verification_metrics(spark, sf_dir):
    """The check on a text-only CSV scan, read back from the written metrics report."""
    source, reports = tl.scratch_path(spark, "customer-csv"), tl.scratch_path(spark, "reports")
    tl.write_csv(customers_as_text(spark, sf_dir), source, sep=";")
    outcome = tl.verify(tl.scan_csv(spark, source, sep=";"), [customer_checks()])
    tl.write_reports(spark, outcome, reports)
    columns = "entity string, instance string, name string, value double"
    return rounded(spark.read.schema(columns).csv(f"{reports}/verification-results-metrics"))


# --- Layout and streams ---------------------------------------------------------------------------------------------


def metrics_from_states(spark, sf_dir):
    """Metrics of the orders from the states of their years, two of which arrive after the first check."""
    path, states = tl.scratch_path(spark, "table"), tl.scratch_path(spark, "states")
    orders = table(spark, sf_dir, "orders").withColumn("year", F.year("o_orderdate"))
    check = tl.Check("Error", "orders").has_size(lambda n: n > 0).is_complete("o_orderstatus").is_unique("o_orderkey")
    check = check.is_non_negative("o_totalprice").is_unique("o_custkey")
    for years in (F.col("year") < 1997, F.col("year") >= 1997):
        tl.append(orders.where(years), path, partition_by=["year"])
        verification = tl.check_partitions(spark, path, states, [check])
    return rounded(verification.metrics_table(spark))


def rechunk_rows(spark, sf_dir):
    source, target = tl.scratch_path(spark, "lineitem-csv"), tl.scratch_path(spark, "chunks")
    lines = lines_as_text(spark, sf_dir)
    tl.write_csv(in_files(lines, lines.count(), 3), source)
    tl.rechunk(spark, source, target, chunk_bytes=1 << 20)
    return tl.scan_csv(spark, target)


def stream_upsert(spark, sf_dir):
    envelopes = tl.read_envelopes(spark, event_files(spark, sf_dir), files_per_batch=1)
    target = tl.scratch_path(spark, "table")
    options = {"keep_latest": True, "stamp": None, "snapshots": True}
    tl.stream_upsert(envelopes, target, EVENT_SCHEMA, ["user_id"], ["ts", "event_id"], **options).awaitTermination()
    return tl.read_snapshot(spark, target)


def stream_upsert_partitions(spark, sf_dir):
    envelopes = tl.read_envelopes(spark, event_files(spark, sf_dir), files_per_batch=1)
    target = tl.scratch_path(spark, "table")
    options = {"keep_latest": True, "partition_by": ["event_type"], "quarantine": tl.scratch_path(spark, "bad")}
    key = ["event_type", "user_id"]
    tl.stream_upsert(envelopes, target, EVENT_SCHEMA, key, ["ts", "event_id"], **options).awaitTermination()
    return spark.read.parquet(target).select(*EVENT_SCHEMA.fieldNames())


def stream_counts(spark, sf_dir):
    """What every micro-batch read, kept back, added and replaced, summed over the batches."""
    payload = F.to_json(F.struct(*EVENT_SCHEMA.fieldNames()))
    text = F.when(F.col("event_id") % 100 == 0, F.lit("no json")).otherwise(payload)
    record = F.struct(F.struct(F.base64(F.encode(text, "UTF-8")).alias("data")).alias("kinesis"))
    source, target, bad, counts = (tl.scratch_path(spark, name) for name in ("envelopes", "table", "bad", "counts"))
    events = event_records(spark, sf_dir).select(F.to_json(F.struct(F.array(record).alias("Records"))).alias("value"))
    in_files(events, events.count(), 3).write.text(source)
    stream, options = tl.read_envelopes(spark, source, files_per_batch=1), {"buckets": 4, "quarantine": bad, "counts": counts}
    tl.stream_upsert(stream, target, EVENT_SCHEMA, ["user_id"], ["ts"], True, **options).awaitTermination()
    read = spark.read.parquet(counts)
    kept = F.sum(F.col("inserted") + F.col("replaced") + F.col("outdated")) <= F.sum("good")
    sums = [F.sum(c).alias(c) for c in ("read", "good", "bad", "inserted")]
    return read.agg(*sums, kept.alias("no_more_than_good"), (F.count("*") > 1).alias("several"))


def stream_append(spark, sf_dir):
    envelopes = tl.read_envelopes(spark, event_files(spark, sf_dir), files_per_batch=2)
    target = tl.scratch_path(spark, "table")
    tl.stream_append(envelopes, target, EVENT_SCHEMA, ["event_id"]).awaitTermination()
    return spark.read.parquet(target).select(*EVENT_SCHEMA.fieldNames())


def stream_append_quarantine(spark, sf_dir):
    """Every hundredth event is no JSON; the others are appended, and both are counted."""
    payload = F.to_json(F.struct(*EVENT_SCHEMA.fieldNames()))
    text = F.when(F.col("event_id") % 100 == 0, F.lit("no json")).otherwise(payload)
    record = F.struct(F.struct(F.base64(F.encode(text, "UTF-8")).alias("data")).alias("kinesis"))
    source, target, bad = (tl.scratch_path(spark, name) for name in ("envelopes", "table", "bad"))
    events = event_records(spark, sf_dir).select(F.to_json(F.struct(F.array(record).alias("Records"))).alias("value"))
    in_files(events, events.count(), 3).write.text(source)
    stream = tl.read_envelopes(spark, source, files_per_batch=1)
    tl.stream_append(stream, target, EVENT_SCHEMA, ["event_id"], quarantine=bad).awaitTermination()
    good = spark.read.parquet(target).agg(F.count("*").alias("good"), F.sum("event_id").alias("id_sum"))
    return good.withColumn("bad", F.lit(spark.read.parquet(bad).count()))


# --- Whole jobs -----------------------------------------------------------------------------------------------------


def load_csv(spark, sf_dir):
    source, target = tl.scratch_path(spark, "orders-csv"), tl.scratch_path(spark, "table")
    tl.write_csv(orders_as_text(spark, sf_dir), source)
    for _ in range(2):
        jobs.load_csv(spark, source, target)
    return spark.read.parquet(target).drop("last_upd_timestamp")


def load_csv_by_key(spark, sf_dir):
    """Customers and then suppliers, divided by buckets of the key; where both have an id the later load wins."""
    target = tl.scratch_path(spark, "table")
    for name in ("customer", "supplier"):
        source = tl.scratch_path(spark, f"{name}-csv")
        tl.write_csv(parties(spark, sf_dir, name).drop("balance"), source, sep=";")
        jobs.load_csv_by_key(spark, source, target, ["id"], ["name"], ";", buckets=4)
    return spark.read.parquet(target).drop("last_upd_timestamp", "key_bucket")


def load_csv_to_table(spark, sf_dir):
    source, name = tl.scratch_path(spark, "part-csv"), f"{new_database(spark)}.parts"
    tl.write_csv(table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand"), source)
    return jobs.load_csv_to_table(spark, source, name, tl.scratch_path(spark, "table"), partition_by=["p_brand"])


def load_csv_to_warehouse(spark, sf_dir):
    source, database = tl.scratch_path(spark, "nation-csv"), new_database(spark)
    tl.write_csv(parties(spark, sf_dir, "supplier").drop("balance"), source, sep=";")
    for _ in range(2):
        jobs.load_csv_to_warehouse(spark, source, "suppliers", database, ";")
    return spark.table(f"{database}.suppliers")


def load_events(spark, sf_dir):
    target = tl.scratch_path(spark, "table")
    events = tl.encode_envelope(event_records(spark, sf_dir))
    options = {"quarantine": tl.scratch_path(spark, "bad"), "batch_id": 0, "snapshots": True}
    jobs.load_events(events, target, ["user_id"], EVENT_SCHEMA, ["ts", "event_id"], **options)
    return tl.read_snapshot(spark, target).select(*EVENT_SCHEMA.fieldNames())


def load_events_buckets(spark, sf_dir):
    """Two loads into a table divided by buckets of the key, with commit columns, read back by name."""
    target, name = tl.scratch_path(spark, "table"), f"{new_database(spark)}.events"
    events = event_records(spark, sf_dir)
    for part in ("event_type <> 'purchase'", "event_type = 'purchase'"):
        batch = tl.encode_envelope(events.where(part))
        options = {"buckets": 4, "commit": True, "batch_id": part[11:12], "table": name}
        jobs.load_events(batch, target, ["event_id"], EVENT_SCHEMA, ["ts"], **options)
    found = spark.table(name).where(F.col("_record_key") == F.col("event_id").cast("string"))
    return found.select(*EVENT_SCHEMA.fieldNames())


def append_then_compact(spark, sf_dir):
    """Small batches are appended, one of them twice, and compacted to the latest event of each user, in two rounds of
    which the second reads the new batches only."""
    appended, target, bad = (tl.scratch_path(spark, name) for name in ("appended", "table", "bad"))
    for round_of in ((0, 1), (2, 1)):
        for batch_id in round_of:
            batch = event_records(spark, sf_dir).where(F.pmod("event_id", F.lit(3)) == batch_id)
            jobs.append_events(tl.encode_envelope(batch), appended, ["user_id"], EVENT_SCHEMA, batch_id, bad)
        jobs.compact_events(spark, appended, target, ["user_id"], ["ts", "event_id"], buckets=4)
    return tl.read_partitions(spark, target).select(*EVENT_SCHEMA.fieldNames())


def check_quality(spark, sf_dir):
    """The check job on a CSV, its metrics read back from the report."""
    source, reports = tl.scratch_path(spark, "customer-csv"), tl.scratch_path(spark, "reports")
    tl.write_csv(customers_as_text(spark, sf_dir), source, sep=";")
    jobs.check_quality(spark, source, [customer_checks()], reports, "csv", sep=";")
    columns = "entity string, instance string, name string, value double"
    return rounded(spark.read.schema(columns).csv(f"{reports}/verification-results-metrics"))


def read_catalog_entry(spark, sf_dir):
    return jobs.read_catalog_entry(spark, entry_of(spark, sf_dir, "nation"))




def entry(spark: SparkSession) -> DataFrame:
    """Semicolon CSV of postings -> scan -> load stamp -> upsert by key into a published table."""
    source, target = tl.scratch_path(spark, "postings-csv"), tl.scratch_path(spark, "table")
    tl.upsert_snapshot(tl.stamp_load_time(order_postings(spark, SMOKE_DIR)), target, POSTING_KEY, POSTING_ORDER)
    tl.write_csv(line_postings(spark, SMOKE_DIR), source, sep=";")
    batch = tl.stamp_load_time(tl.scan_csv(spark, source, sep=";", schema=line_postings(spark, SMOKE_DIR).schema))
    tl.upsert_snapshot(batch, target, POSTING_KEY, POSTING_ORDER)
    return tl.read_snapshot(spark, target)


def queries() -> dict[str, Query]:
    pipeline = {"pipeline": corpus_pipeline.run} if corpus_pipeline else {}
    return library_queries() | (llm.queries() if llm else {}) | pipeline


def library_queries() -> dict[str, Query]:
    return {
        "csv_scan_comma": csv_scan_comma,
        "csv_scan_semicolon": csv_scan_semicolon,
        "csv_scan_quoted_texts": csv_scan_quoted_texts,
        "csv_scan_quoted_splits": csv_scan_quoted_splits,
        "large_csv_scan": large_csv_scan,
        "parquet_declared_schema": parquet_declared_schema,
        "catalog_entry_scan": catalog_entry_scan,
        "catalog_table_scan": catalog_table_scan,
        "format_scan": format_scan,
        "records_to_table": records_to_table,
        "records_without_schema": records_without_schema,
        "envelope_decode": envelope_decode,
        "envelope_decode_texts": envelope_decode_texts,
        "envelope_quarantine": envelope_quarantine,
        "load_stamp": load_stamp,
        "projected_view": projected_view,
        "user_sql": user_sql,
        "append_twice": append_twice,
        "overwrite_replaces": overwrite_replaces,
        "create_new": create_new,
        "single_csv_report": single_csv_report,
        "create_and_insert_all": create_and_insert_all,
        "insert_by_name": insert_by_name,
        "partitioned_table": partitioned_table,
        "table_partitions_replaced": table_partitions_replaced,
        "warehouse_load": warehouse_load,
        "observed_write_counts": observed_write_counts,
        "dedupe_batch": dedupe_batch,
        "keyed_parallelism": keyed_parallelism,
        "bulk_load": bulk_load,
        "upsert_incoming_wins": upsert_with(),
        "upsert_incoming_wins_shuffled": upsert_with(max_broadcast_bytes=0),
        "upsert_incoming_wins_bitmap": upsert_with(max_broadcast_bytes=2 << 20),
        "upsert_keep_latest_bitmap": upsert_with(keep_latest=True, max_broadcast_bytes=2 << 20),
        "upsert_keep_latest": upsert_with(keep_latest=True),
        "upsert_keep_latest_shuffled": upsert_with(keep_latest=True, max_broadcast_bytes=0),
        "upsert_bucketed_target": upsert_bucketed_target,
        "upsert_snapshots": upsert_snapshots,
        "upsert_touched_partitions": upsert_touched_partitions,
        "rows_since_commit": rows_since_commit,
        "upsert_partitions_new_column": upsert_partitions_new_column,
        "upsert_moved_partitions": upsert_moved_partitions,
        "commit_metadata": commit_metadata,
        "merge_update_insert": merge_with(),
        "merge_update_insert_shuffled": merge_with(max_broadcast_bytes=0),
        "merge_update_only": merge_with(insert=False),
        "metrics_report": metrics_report,
        "approx_distinct_error": approx_distinct_error,
        "uniqueness": uniqueness,
        "verification_report": verification_report,
        "verification_metrics": verification_metrics,
        "metrics_from_states": metrics_from_states,
        "rechunk_rows": rechunk_rows,
        "stream_upsert": stream_upsert,
        "stream_upsert_partitions": stream_upsert_partitions,
        "stream_append": stream_append,
        "stream_counts": stream_counts,
        "stream_append_quarantine": stream_append_quarantine,
        "keyed_table_by_name": keyed_table_by_name,
        "merge_snapshots": merge_snapshots,
        "merge_partitions": merge_partitions,
        "non_negative_large": non_negative_large,
        "load_csv": load_csv,
        "load_csv_by_key": load_csv_by_key,
        "load_csv_to_table": load_csv_to_table,
        "load_csv_to_warehouse": load_csv_to_warehouse,
        "load_events": load_events,
        "load_events_buckets": load_events_buckets,
        "append_then_compact": append_then_compact,
        "check_quality": check_quality,
        "read_catalog_entry": read_catalog_entry,
    }


def _as_text(columns: str) -> str:
    return ", ".join(f"CAST({c} AS VARCHAR) AS {c}" for c in columns.split())


CUSTOMER_METRICS = """
SELECT 'Dataset' AS entity, '*' AS instance, 'Size' AS name, CAST(count(*) AS DOUBLE) AS value FROM customer
UNION ALL SELECT 'Column', 'c_name', 'Completeness', count(c_name) / count(*) FROM customer
UNION ALL SELECT 'Column', 'c_custkey', 'Uniqueness', sum(CASE WHEN n = 1 THEN 1 ELSE 0 END) / sum(n)
  FROM (SELECT c_custkey, count(*) AS n FROM customer WHERE c_custkey IS NOT NULL GROUP BY c_custkey)
UNION ALL SELECT 'Column', 'c_mktsegment', 'Uniqueness', sum(CASE WHEN n = 1 THEN 1 ELSE 0 END) / sum(n)
  FROM (SELECT c_mktsegment, count(*) AS n FROM customer WHERE c_mktsegment IS NOT NULL GROUP BY c_mktsegment)
UNION ALL SELECT 'Column', 'c_acctbal is non-negative', 'Compliance',
  sum(CASE WHEN coalesce(c_acctbal, 0) >= 0 THEN 1 ELSE 0 END) / count(*) FROM customer
"""

CUSTOMER_CHECKS = f"""
WITH metrics AS ({CUSTOMER_METRICS}),
judged AS (
  SELECT name, instance, value, CASE WHEN name = 'Size' THEN value >= 1000 ELSE value = 1 END AS holds FROM metrics)
SELECT 'Customers' AS "check", 'Warning' AS check_level,
       CASE WHEN (SELECT bool_and(holds) FROM judged) THEN 'Success' ELSE 'Warning' END AS check_status,
       CASE name WHEN 'Size' THEN 'SizeConstraint(Size(None))'
                 WHEN 'Completeness' THEN 'CompletenessConstraint(Completeness(' || instance || ',None))'
                 WHEN 'Uniqueness' THEN 'UniquenessConstraint(Uniqueness(List(' || instance || '),None))'
                 ELSE 'ComplianceConstraint(Compliance(' || instance
                      || ',COALESCE(CAST(c_acctbal AS DECIMAL(20,10)), 0.0) >= 0,None))' END AS "constraint",
       CASE WHEN holds THEN 'Success' ELSE 'Failure' END AS constraint_status,
       CASE WHEN holds THEN ''
            ELSE 'Value: ' || CASE WHEN name = 'Size' THEN CAST(CAST(value AS BIGINT) AS VARCHAR)
                                   ELSE CAST(value AS VARCHAR) END
                 || ' does not meet the constraint requirement!' END AS constraint_message
FROM judged
"""

LINEITEM_UNIQUENESS = """
SELECT 'Multicolumn' AS entity, 'l_orderkey,l_linenumber' AS instance, 'Uniqueness' AS name,
       round(sum(CASE WHEN n = 1 THEN 1 ELSE 0 END) / sum(n), 4) AS value
FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_orderkey, l_linenumber)
UNION ALL
SELECT 'Column', 'l_orderkey', 'Uniqueness', round(sum(CASE WHEN n = 1 THEN 1 ELSE 0 END) / sum(n), 4)
FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_orderkey)
"""


def oracle_sql() -> dict[str, str]:
    pipeline = {"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline and corpus_pipeline.ORACLE_SQL else {}
    return library_sql() | (llm.oracle_sql() if llm else {}) | pipeline


def library_sql() -> dict[str, str]:
    latest_of_both = (
        f"{POSTINGS}, newest AS (SELECT * FROM (SELECT *, 0 AS incoming FROM stored UNION ALL "
        "SELECT *, 1 AS incoming FROM batch) QUALIFY row_number() OVER "
        "(PARTITION BY account, day ORDER BY version DESC, incoming DESC) = 1) "
        f"{SHOWN} newest"
    )
    incoming_wins = (
        f"{POSTINGS} {SHOWN} (SELECT * FROM batch UNION ALL SELECT * FROM stored s WHERE NOT EXISTS "
        "(SELECT 1 FROM batch b WHERE b.account = s.account AND b.day = s.day))"
    )
    merged = f"{POSTINGS} {SHOWN} ({MERGED} UNION ALL {INSERTED})"
    lines_text = LINES_TYPED.replace("AS INTEGER", "AS VARCHAR").replace(
        "l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax",
        "CAST(l_linenumber AS VARCHAR) AS l_linenumber, "
        + ", ".join(
            f"CAST(CAST({c} AS DECIMAL(18,2)) AS VARCHAR) AS {c}"
            for c in ("l_quantity", "l_extendedprice", "l_discount", "l_tax")
        ),
    )
    orders_text = (
        f"SELECT {_as_text('o_orderkey o_custkey o_orderstatus o_orderpriority')}, "
        "CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS VARCHAR) AS o_totalprice, "
        "strftime(o_orderdate, '%Y-%m-%d') AS o_orderdate FROM orders"
    )
    return {
        "csv_scan_comma": orders_text,
        "csv_scan_semicolon": f"SELECT {_as_text('c_custkey c_name c_nationkey c_mktsegment')}, "
        "CAST(CAST(c_acctbal AS DECIMAL(18,2)) AS VARCHAR) AS c_acctbal FROM customer",
        "csv_scan_quoted_texts": f"SELECT {_as_text('conv_id turn role text')} FROM conversations",
        "csv_scan_quoted_splits": f"SELECT {_as_text('conv_id turn role text')} FROM conversations",
        "large_csv_scan": LINES_TYPED,
        "parquet_declared_schema": "SELECT c_custkey, CAST(c_nationkey AS BIGINT) AS c_nationkey, "
        "CAST(NULL AS VARCHAR) AS c_comment, c_name FROM customer",
        "catalog_entry_scan": "SELECT * FROM part",
        "catalog_table_scan": "SELECT * FROM supplier",
        "format_scan": "SELECT *, 'csv' AS format FROM supplier UNION ALL SELECT *, 'parquet' FROM supplier",
        "records_to_table": EVENTS,
        "records_without_schema": f"SELECT {_as_text('conv_id turn role text')} FROM conversations",
        "envelope_decode": EVENTS,
        "envelope_decode_texts": "SELECT * FROM documents",
        "envelope_quarantine": "SELECT found, count(*) AS records, CAST(sum(id) AS BIGINT) AS id_sum FROM ("
        "SELECT CASE event_type WHEN 'error' THEN 'bad %%%' WHEN 'signup' THEN 'bad bm8ganNvbg==' "
        "ELSE event_type END AS found, CASE WHEN event_type IN ('error', 'signup') THEN NULL ELSE event_id END AS id "
        "FROM events) GROUP BY found",
        "load_stamp": "SELECT count(*) AS n_rows, CAST(1 AS BIGINT) AS n_stamps, CAST(0 AS BIGINT) AS n_unstamped "
        "FROM orders",
        "projected_view": "SELECT c_mktsegment, c_name, c_custkey FROM customer",
        "user_sql": USER_SQL,
        "append_twice": f"{PARTIES} SELECT * FROM suppliers UNION ALL SELECT * FROM customers",
        "overwrite_replaces": f"{PARTIES} SELECT * FROM customers",
        "create_new": "SELECT * FROM part",
        "single_csv_report": CUSTOMER_CHECKS,
        "create_and_insert_all": "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice FROM orders",
        "insert_by_name": "SELECT c_custkey, c_name, CAST(NULL AS INTEGER) AS c_nationkey, c_acctbal, c_mktsegment "
        "FROM customer",
        "partitioned_table": f"{PARTIES} SELECT * FROM suppliers UNION ALL "
        "SELECT * FROM customers WHERE band NOT IN (SELECT band FROM suppliers)",
        "table_partitions_replaced": f"{PARTIES} SELECT * FROM suppliers UNION ALL "
        "SELECT * FROM customers WHERE band NOT IN (SELECT band FROM suppliers)",
        "warehouse_load": f"{PARTIES} SELECT * FROM customers",
        "observed_write_counts": "SELECT count(*) AS n_rows, count(o_custkey) AS n_cust, count(o_orderdate) AS n_date "
        "FROM orders",
        "dedupe_batch": LATEST_EVENTS,
        "keyed_parallelism": LATEST_EVENTS,
        "bulk_load": f"{POSTINGS} {SHOWN} stored",
        "upsert_incoming_wins": incoming_wins,
        "upsert_incoming_wins_shuffled": incoming_wins,
        "upsert_incoming_wins_bitmap": incoming_wins,
        "upsert_keep_latest_bitmap": latest_of_both,
        "upsert_keep_latest": latest_of_both,
        "upsert_keep_latest_shuffled": latest_of_both,
        "upsert_bucketed_target": incoming_wins,
        "upsert_snapshots": incoming_wins,
        "upsert_touched_partitions": latest_of_both,
        "upsert_moved_partitions": incoming_wins,
        "upsert_partitions_new_column": f"{POSTINGS}, both_loads AS (SELECT *, 'lines' AS origin FROM batch UNION ALL "
        "SELECT *, NULL FROM stored s WHERE NOT EXISTS "
        "(SELECT 1 FROM batch b WHERE b.account = s.account AND b.day = s.day)), "
        f"shown AS ({SHOWN.replace('status FROM', 'status, origin FROM')} both_loads) "
        "SELECT *, 'path' AS read_by FROM shown UNION ALL SELECT *, 'name' FROM shown",
        "rows_since_commit": f"{POSTINGS} {SHOWN} batch",
        "merge_partitions": f"{POSTINGS} {SHOWN} (SELECT t.account, t.day, coalesce(s.version, t.version) AS version, "
        "coalesce(s.amount, t.amount) AS amount, t.status FROM line_postings t "
        "LEFT JOIN stored s ON t.account = s.account AND t.day = s.day)",
        "commit_metadata": "SELECT 'c_mktsegment=' || c_mktsegment AS _partition_path, count(*) AS n_seqnos, "
        "CAST(1 AS BIGINT) AS n_times, count(*) AS n_keys, true AS has_files FROM customer GROUP BY c_mktsegment",
        "merge_update_insert": merged,
        "merge_update_insert_shuffled": merged,
        "merge_update_only": f"{POSTINGS} {SHOWN} ({MERGED})",
        "metrics_report": "SELECT 'Dataset' AS entity, '*' AS instance, 'Size' AS name, "
        "CAST(count(*) AS DOUBLE) AS value FROM orders "
        "UNION ALL SELECT 'Column', 'o_orderstatus', 'Completeness', "
        "round(count(o_orderstatus) / count(*), 4) FROM orders "
        "UNION ALL SELECT 'Column', 'o_totalprice', 'Mean', round(avg(o_totalprice), 4) FROM orders",
        "approx_distinct_error": "SELECT count(DISTINCT o_custkey) AS n_distinct, true AS within FROM orders",
        "uniqueness": LINEITEM_UNIQUENESS,
        "verification_report": CUSTOMER_CHECKS,
        "verification_metrics": "SELECT entity, instance, name, round(value, 4) AS value "
        f"FROM ({CUSTOMER_METRICS})",
        "metrics_from_states": "SELECT 'Dataset' AS entity, '*' AS instance, 'Size' AS name, "
        "CAST(count(*) AS DOUBLE) AS value FROM orders "
        "UNION ALL SELECT 'Column', 'o_orderstatus', 'Completeness', round(count(o_orderstatus) / count(*), 4) FROM orders "
        "UNION ALL SELECT 'Column', 'o_totalprice is non-negative', 'Compliance', "
        "round(count(*) FILTER (o_totalprice >= 0) / count(*), 4) FROM orders "
        "UNION ALL SELECT 'Column', 'o_orderkey', 'Uniqueness', round(count(*) FILTER (n = 1) / sum(n), 4) "
        "FROM (SELECT count(*) AS n FROM orders GROUP BY o_orderkey) "
        "UNION ALL SELECT 'Column', 'o_custkey', 'Uniqueness', round(count(*) FILTER (n = 1) / sum(n), 4) "
        "FROM (SELECT count(*) AS n FROM orders GROUP BY o_custkey)",
        "rechunk_rows": lines_text,
        "stream_upsert": LATEST_EVENTS,
        "stream_upsert_partitions": f"SELECT * FROM ({EVENTS}) QUALIFY row_number() OVER "
        "(PARTITION BY event_type, user_id ORDER BY ts DESC, event_id DESC) = 1",
        "stream_counts": "SELECT count(*) AS read, count(*) FILTER (event_id % 100 <> 0) AS good, "
        "count(*) FILTER (event_id % 100 = 0) AS bad, "
        "count(DISTINCT user_id) FILTER (event_id % 100 <> 0) AS inserted, "
        "true AS no_more_than_good, true AS several FROM events",
        "stream_append": EVENTS,
        "stream_append_quarantine": "SELECT count(*) FILTER (event_id % 100 <> 0) AS good, "
        "CAST(sum(event_id) FILTER (event_id % 100 <> 0) AS BIGINT) AS id_sum, "
        "CAST(count(*) FILTER (event_id % 100 = 0) AS INTEGER) AS bad FROM events",
        "keyed_table_by_name": f"{POSTINGS}, newest AS (SELECT * FROM (SELECT *, 0 AS committed_by FROM stored "
        "UNION ALL SELECT *, 1 FROM batch) QUALIFY row_number() OVER "
        "(PARTITION BY account, day ORDER BY version DESC, committed_by DESC) = 1), "
        f"shown AS ({SHOWN.replace('status FROM', 'status, committed_by, true AS keyed FROM')} newest) "
        "SELECT *, 'snapshots' AS kind FROM shown UNION ALL SELECT *, 'partitions' FROM shown",
        "merge_snapshots": merged,
        "non_negative_large": "SELECT 'Column' AS entity, 'wide is non-negative' AS instance, 'Compliance' AS name, "
        "round(count(*) FILTER (c_acctbal >= 0) / count(*), 4) AS value FROM customer",
        "load_csv": f"SELECT * FROM ({orders_text}) UNION ALL SELECT * FROM ({orders_text})",
        "load_csv_by_key": f"{PARTIES}, both_ids AS (SELECT *, 1 AS load FROM suppliers UNION ALL SELECT *, 0 FROM customers) "
        f"SELECT {_as_text('id name nation band')} FROM both_ids "
        "QUALIFY row_number() OVER (PARTITION BY id ORDER BY load DESC) = 1",
        "load_csv_to_table": f"SELECT {_as_text('p_partkey p_name p_brand')} FROM part",
        "load_csv_to_warehouse": f"{PARTIES} SELECT {_as_text('id name nation band')} FROM suppliers",
        "load_events": LATEST_EVENTS,
        "load_events_buckets": EVENTS,
        "append_then_compact": LATEST_EVENTS,
        "check_quality": f"SELECT entity, instance, name, round(value, 4) AS value FROM ({CUSTOMER_METRICS})",
        "read_catalog_entry": "SELECT * FROM nation",
    }
