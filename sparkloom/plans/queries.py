"""Queries over the test tables, one or more for each operator, with equal SQL."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkloom.functions import frames, partitions
from sparkloom.functions.predicates import predicate
from sparkloom.functions.schemas import cast_to, drop_null_columns, infer_dtypes, same_zones, union_all
from sparkloom.operators import keys, maintenance, merge
from sparkloom.session import tasks_for
from sparkloom.sources.files import Dataset
from sparkloom.sources.read import file_stats, read_dataset, read_files, sql
from sparkloom.sources.write import write_dataset, write_files

Query = Callable[[SparkSession, str], DataFrame]
TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def add(fn: Query) -> Query:
        QUERIES[name] = fn
        if oracle:
            ORACLES[name] = oracle
        return fn

    return add


def t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def filtered(name: str, table: str, columns: list[str], filters, where: str) -> None:
    """A scan with a filter given as text or tuples, and the same as SQL."""
    query(name, f"SELECT {', '.join(columns)} FROM {table} WHERE {where}")(lambda s, d: read_dataset(s, f"{d}/{table}.parquet", columns, filters))


L = ["l_orderkey", "l_linenumber", "l_quantity", "l_returnflag"]
filtered("filter_cmp", "lineitem", L, "l_quantity >= 30 AND l_returnflag IN ('A','R')", "l_quantity >= 30 AND l_returnflag IN ('A','R')")
filtered("filter_in", "lineitem", L, "l_returnflag IN ('N') AND l_linenumber IN (1, 3)", "l_returnflag IN ('N') AND l_linenumber IN (1, 3)")
filtered("filter_not_in", "lineitem", L, "l_returnflag NOT IN ('N', 'A')", "l_returnflag NOT IN ('N', 'A')")
filtered("filter_or_not", "lineitem", L, "NOT (l_quantity < 45 OR l_linenumber = 2)", "NOT (l_quantity < 45 OR l_linenumber = 2)")
filtered("filter_is_null", "events", ["event_id", "event_type"], "props IS NOT NULL AND value > 50.5", "props IS NOT NULL AND value > 50.5")
filtered("filter_negative", "customer", ["c_custkey", "c_acctbal"], "c_acctbal < -100", "c_acctbal < -100")
filtered("filter_tuples_and", "lineitem", L, [("l_quantity", ">", 10), ("l_returnflag", "in", ["A"]), ("l_linenumber", "!=", 1)], "l_quantity > 10 AND l_returnflag = 'A' AND l_linenumber <> 1")
filtered("filter_dnf_or", "lineitem", L, [[("l_quantity", "<", 3)], [("l_returnflag", "=", "R"), ("l_linenumber", ">=", 6)]], "l_quantity < 3 OR (l_returnflag = 'R' AND l_linenumber >= 6)")
filtered("filter_timestamp", "orders", ["o_orderkey", "o_totalprice"], "o_orderdate >= TIMESTAMP_NTZ '1996-06-01 00:00:00'", "o_orderdate >= TIMESTAMP '1996-06-01 00:00:00'")
filtered("filter_unprojected", "orders", ["o_orderkey"], "o_orderstatus = 'F'", "o_orderstatus = 'F'")


@query("filter_column", "SELECT o_orderkey, o_custkey FROM orders WHERE o_totalprice > 200000 AND o_orderpriority LIKE '1%'")
def _(s, d):
    return read_dataset(s, f"{d}/orders.parquet", ["o_orderkey", "o_custkey"], (F.col("o_totalprice") > 200000) & F.col("o_orderpriority").startswith("1"))


NAN = "CASE WHEN event_id % 10 = 0 THEN 'NaN'::DOUBLE WHEN event_id % 7 = 0 THEN NULL ELSE value END"


filtered("filter_text_as_time", "orders", ["o_orderkey"], "o_orderdate >= '1995-06-01' AND o_orderkey <> '7' AND o_orderkey IN ('1', '2', '3', '4', '5', '6', '7', '32', '33')", "o_orderdate >= TIMESTAMP '1995-06-01' AND o_orderkey <> 7 AND o_orderkey IN (1, 2, 3, 4, 5, 6, 7, 32, 33)")
filtered("filter_number_as_text", "part", ["p_partkey"], "p_brand <> 11 AND p_size > '10'", "p_brand <> '11' AND p_size > 10")


def nan_events(s, d):
    return t(s, d, "events").select("event_id", F.when(F.col("event_id") % 10 == 0, F.lit(float("nan"))).when(F.col("event_id") % 7 == 0, F.lit(None)).otherwise(F.col("value")).alias("v"))


@query("filter_null_or_nan", f"SELECT event_id FROM (SELECT event_id, {NAN} AS v FROM events) WHERE v IS NULL OR isnan(v)")
def _(s, d):
    df = nan_events(s, d)
    return df.where(predicate("v IS NULL", df.schema)).select("event_id")


@query("filter_nan_ordered", f"SELECT event_id FROM (SELECT event_id, {NAN} AS v FROM events) WHERE v > 20 AND NOT isnan(v)")
def _(s, d):
    df = nan_events(s, d)
    return df.where(predicate("v > 20", df.schema)).select("event_id")


@query("filter_not_in_keep_nulls", f"SELECT event_id FROM (SELECT event_id, CASE WHEN event_id % 7 = 0 THEN NULL ELSE event_type END AS k FROM events) WHERE k IS NULL OR k NOT IN (SELECT min(event_type) FROM events)")
def _(s, d):
    df = t(s, d, "events").withColumn("k", F.when(F.col("event_id") % 7 != 0, F.col("event_type")))
    low = df.agg(F.min("event_type")).first()[0]
    return df.where(predicate(f"k NOT IN ('{low}')", df.schema, nulls="keep")).select("event_id")


@query("semi_join", "SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 5000)")
def _(s, d):
    c = t(s, d, "customer").where("c_acctbal > 5000").select(F.col("c_custkey").alias("o_custkey"))
    return keys.matching(t(s, d, "orders"), c, ["o_custkey"]).select("o_orderkey")


@query("anti_join", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')")
def _(s, d):
    return keys.missing_from(t(s, d, "customer").select("c_custkey"), t(s, d, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("c_custkey")), ["c_custkey"])


@query("null_safe_join", "WITH e AS (SELECT event_id, nullif(user_id % 7, 0) AS k FROM events) SELECT event_id, k FROM e WHERE EXISTS (SELECT 1 FROM (SELECT nullif(n_nationkey % 3, 0) AS k FROM nation) n WHERE n.k IS NOT DISTINCT FROM e.k)")
def _(s, d):
    e = t(s, d, "events").select("event_id", F.nullif(F.col("user_id") % 7, F.lit(0)).alias("k"))
    return keys.matching(e, t(s, d, "nation").select(F.nullif(F.col("n_nationkey") % 3, F.lit(0)).cast("long").alias("k")), ["k"])


@query("delta", "SELECT doc_id, lang FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id IS NOT DISTINCT FROM d.doc_id)")
def _(s, d):
    return keys.delta(t(s, d, "documents").select("doc_id", "lang"), t(s, d, "labels"), ["doc_id"])


@query("dedupe_last", "SELECT user_id, event_id, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1")
def _(s, d):
    return keys.dedupe(t(s, d, "events"), ["user_id"], ["ts", "event_id"], "last").select("user_id", "event_id", "value")


@query("dedupe_first", "SELECT user_id, event_id, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY value DESC NULLS LAST, event_id) = 1")
def _(s, d):
    return keys.dedupe(t(s, d, "events"), ["user_id"], ["-value", "event_id"]).select("user_id", "event_id", "value")


@query("dedupe_nan_keys", f"SELECT count(*) AS n FROM (SELECT DISTINCT v FROM (SELECT {NAN} AS v FROM events))")
def _(s, d):
    return keys.dedupe_any(nan_events(s, d).select("v")).agg(F.count(F.lit(1)).alias("n"))


TARGET = "SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_orderkey % 2 = 1 OR o_orderkey % 4 = 0"
SOURCE = "SELECT o_orderkey, o_custkey, o_totalprice + 1000 AS o_totalprice FROM orders WHERE o_orderkey % 3 = 0"


def _merged(strategy: str) -> Query:
    def run(s, d):
        o = t(s, d, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
        target = o.where("o_orderkey % 2 = 1 OR o_orderkey % 4 = 0")
        source = o.where("o_orderkey % 3 = 0").withColumn("o_totalprice", F.col("o_totalprice") + 1000)
        return merge.merge_frames(target, source, ["o_orderkey"], strategy, ["o_custkey"])

    return run


_left = f"SELECT t.o_orderkey, coalesce(s.o_custkey, t.o_custkey) AS o_custkey, coalesce(s.o_totalprice, t.o_totalprice) AS o_totalprice FROM ({TARGET}) t LEFT JOIN ({SOURCE}) s USING (o_orderkey)"
_new = f"SELECT * FROM ({SOURCE}) WHERE o_orderkey NOT IN (SELECT o_orderkey FROM ({TARGET}))"
query("merge_insert", f"{TARGET} UNION ALL {_new}")(_merged("insert"))
query("merge_update", _left)(_merged("update"))
query("merge_upsert", f"{_left} UNION ALL {_new}")(_merged("upsert"))


@query("merge_partial_columns", f"SELECT t.o_orderkey, t.o_custkey, coalesce(s.o_totalprice, t.o_totalprice) AS o_totalprice FROM ({TARGET}) t LEFT JOIN ({SOURCE}) s USING (o_orderkey)")
def _(s, d):
    o = t(s, d, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    source = o.where("o_orderkey % 3 = 0").select("o_orderkey", (F.col("o_totalprice") + 1000).alias("o_totalprice"))
    return merge.merge_frames(o.where("o_orderkey % 2 = 1 OR o_orderkey % 4 = 0"), source, ["o_orderkey"], "update", ["o_totalprice"])


def folder(s: SparkSession) -> str:
    """A new folder in the one that driver and executors share; a temporary one where none is set."""
    shared = s.conf.get("spark.checkpoint.dir", None)
    if not shared and not s.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    return f"{shared.rstrip('/')}/data-{uuid.uuid4().hex}" if shared else tempfile.mkdtemp(prefix="sparkloom-")


@query("merge_dataset_upsert", f"{_left} UNION ALL {_new}")
def _(s, d):
    o, path = t(s, d, "orders").select("o_orderkey", "o_custkey", "o_totalprice"), folder(s)
    write_dataset(o.where("o_orderkey % 2 = 1 OR o_orderkey % 4 = 0").repartitionByRange(6, "o_orderkey"), path)
    merge.merge_dataset(s, path, o.where("o_orderkey % 3 = 0").withColumn("o_totalprice", F.col("o_totalprice") + 1000), ["o_orderkey"], "upsert", ["o_custkey"])
    return s.read.parquet(path)


@query("union_unify_types", "SELECT c_custkey, CAST(c_nationkey AS BIGINT) AS c_nationkey, NULL::VARCHAR AS note FROM customer WHERE c_custkey % 2 = 0 UNION ALL SELECT c_custkey, CAST(c_nationkey AS BIGINT), 'x' FROM customer WHERE c_custkey % 2 = 1")
def _(s, d):
    c = t(s, d, "customer").select("c_custkey", "c_nationkey")
    return union_all([c.where("c_custkey % 2 = 0"), c.where("c_custkey % 2 = 1").select("c_custkey", F.col("c_nationkey").cast("long").alias("c_nationkey"), F.lit("x").alias("note"))])


@query("read_files_many_schemas", "SELECT c_custkey, CAST(c_nationkey AS VARCHAR) AS c_nationkey FROM customer")
def _(s, d):
    c, path = t(s, d, "customer").select("c_custkey", "c_nationkey"), folder(s)
    for i, kind in enumerate(("int", "bigint", "string")):
        c.where(f"c_custkey % 3 = {i}").withColumn("c_nationkey", F.col("c_nationkey").cast(kind)).write.parquet(f"{path}/{kind}")
    return read_files(s, path)


@query("read_csv_json", "SELECT r_regionkey::BIGINT AS r_regionkey, r_name FROM region UNION ALL SELECT r_regionkey::BIGINT, r_name FROM region")
def _(s, d):
    r, path = t(s, d, "region"), folder(s)
    r.write.option("header", True).csv(f"{path}/c")
    r.write.json(f"{path}/j")
    return union_all([read_files(s, f"{path}/c", "csv"), read_files(s, f"{path}/j", "json").select("r_regionkey", "r_name")])


@query("cast_try_nulls", "SELECT event_id, TRY_CAST(event_type AS INTEGER) AS event_type FROM events")
def _(s, d):
    return cast_to(t(s, d, "events").select("event_id", "event_type"), T.StructType([T.StructField("event_id", T.LongType()), T.StructField("event_type", T.IntegerType())]), strict=False)


@query("infer_dtypes", "SELECT o_orderkey, o_totalprice, o_orderstatus FROM orders")
def _(s, d):
    o = t(s, d, "orders").select(F.col("o_orderkey").cast("string"), F.col("o_totalprice").cast("string"), "o_orderstatus")
    return infer_dtypes(o)


@query("drop_null_columns", "SELECT n_nationkey FROM nation")
def _(s, d):
    return drop_null_columns(t(s, d, "nation").select("n_nationkey", F.lit(None).cast("string").alias("empty")))


@query("date_parts", "SELECT o_orderkey, year(o_orderdate)::INT AS year, month(o_orderdate)::INT AS month, day(o_orderdate)::INT AS day, dayofyear(o_orderdate)::INT AS year_day, hour(o_orderdate)::INT AS hour, strftime(o_orderdate, '%W')::INT AS week FROM orders")
def _(s, d):
    return frames.with_datepart_columns(t(s, d, "orders"), "o_orderdate", ["year", "month", "day", "year_day", "hour", "week"]).select("o_orderkey", "year", "month", "day", "year_day", "hour", "week")


@query("strftime", "SELECT event_id, strftime(ts, '%Y-%m-%d') AS _strftime_Y_m_d_ FROM events")
def _(s, d):
    return frames.with_strftime_columns(t(s, d, "events"), "ts", ["%Y-%m-%d"]).select("event_id", "_strftime_Y_m_d_")


@query("truncate", "SELECT event_id, epoch(time_bucket(INTERVAL '15 minutes', ts))::BIGINT AS q, epoch(date_trunc('hour', ts))::BIGINT AS h FROM events")
def _(s, d):
    e = frames.with_truncated_columns(t(s, d, "events"), "ts", ["15m", "1h"])
    return e.select("event_id", F.unix_seconds(F.col("_truncated_15m_").cast("timestamp")).alias("q"), F.unix_seconds(F.col("_truncated_1h_").cast("timestamp")).alias("h"))


@query("row_number_over", "SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS row_nr FROM events")
def _(s, d):
    return frames.with_row_count(t(s, d, "events"), ["event_id"], ["user_id"]).select("event_id", "user_id", F.col("row_nr").cast("long"))


@query("row_number_all", "SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) AS row_nr FROM orders")
def _(s, d):
    return frames.with_row_count(t(s, d, "orders").select("o_orderkey"), ["o_orderkey"])


@query("split_counts", "SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY ALL")
def _(s, d):
    parts = frames.split_by(t(s, d, "orders"), ["o_orderstatus"])
    out = [df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(k["o_orderstatus"]).alias("o_orderstatus"), "n") for k, df in parts]
    return union_all(out)


@query("split_by_format", "SELECT strftime(o_orderdate, '%Y-%m') AS key, o_orderstatus AS status, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY ALL")
def _(s, d):
    keyed, names = frames.with_split_keys(t(s, d, "orders"), ["o_orderstatus"], "o_orderdate", formats=["%Y-%m"])
    return keyed.groupBy(*names).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total")).toDF("status", "key", "n", "total")


@query("split_by_duration", "SELECT year(ts)::INT AS year, epoch(time_bucket(INTERVAL '2 hours', ts))::BIGINT AS start, count(*) AS n FROM events GROUP BY ALL")
def _(s, d):
    keyed, (year, start) = frames.with_split_keys(t(s, d, "events"), ["year"], "ts", durations=["2h"])
    return keyed.groupBy(F.col(year).cast("int").alias("year"), F.unix_seconds(F.col(start).cast("timestamp")).alias("start")).agg(F.count(F.lit(1)).alias("n"))


@query("split_by_rows", "SELECT o_orderstatus, (row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_orderkey) - 1) // 100 AS row_run, o_orderkey FROM orders")
def _(s, d):
    keyed, _names = frames.with_split_keys(t(s, d, "orders").select("o_orderstatus", "o_orderkey"), ["o_orderstatus"], rows=100, order_by=["o_orderkey"])
    return keyed


@query("partition_by_parts", "SELECT year(o_orderdate)::INT AS year, count(*) AS n, min(o_orderkey) AS low FROM orders GROUP BY ALL")
def _(s, d):
    """Each part is a frame of its own, without the key."""
    parts = frames.partition_by(t(s, d, "orders"), ["year"], time_column="o_orderdate")
    return union_all([df.agg(F.count(F.lit(1)).alias("n"), F.min("o_orderkey").alias("low")).select(F.lit(k["year"]).cast("int").alias("year"), "n", "low") for k, df in parts])


@query("time_from_text", "SELECT event_id, epoch_us(ts)::BIGINT - CASE WHEN event_id % 3 = 1 THEN 5400000000 WHEN event_id % 3 = 2 THEN -12600000000 ELSE 0 END AS us, epoch_us(ts)::BIGINT AS own FROM events")
def _(s, d):
    """Times written with offsets, as instants, and as the clock shows them."""
    e = t(s, d, "events").select("event_id", F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.when(F.col("event_id") % 3 == 1, "+01:30").when(F.col("event_id") % 3 == 2, "-0330").otherwise("Z")).alias("x"))
    return e.select("event_id", F.unix_micros(frames.time_from_text(F.col("x"))).alias("us"), F.unix_micros(frames.time_from_text(F.col("x"), naive=True).cast("timestamp")).alias("own"))


@query("zones_by_majority", "SELECT event_id, epoch_us(ts)::BIGINT AS us FROM events")
def _(s, d):
    """Two frames have instants, one has times without a zone: all become instants."""
    e = t(s, d, "events").select("event_id", F.col("ts").cast("timestamp_ntz").alias("ts"))
    zoned = F.col("ts").cast("timestamp").alias("ts")
    three = [e.where("event_id % 3 = 0").select("event_id", zoned), e.where("event_id % 3 = 1").select("event_id", zoned), e.where("event_id % 3 = 2")]
    return union_all(same_zones(three)).select("event_id", F.unix_micros("ts").alias("us"))


@query("derived_keys_in_zone", "SELECT d, count(*) AS n FROM (SELECT strftime(timezone('Asia/Tokyo', timezone('UTC', ts)), '%Y-%m-%d') AS d FROM events) GROUP BY d")
def _(s, d):
    """Days of Tokyo, from the only time column, as folders."""
    path, e = folder(s), t(s, d, "events").select("event_id", "ts")
    write_dataset(e.withColumn("d", partitions.derived_key("auto", "%Y-%m-%d", "Asia/Tokyo", e.schema)), path, partition_by=["d"])
    return s.read.parquet(path).groupBy(F.col("d").cast("string").alias("d")).agg(F.count(F.lit(1)).alias("n"))


@query("partition_values", "SELECT DISTINCT o_orderstatus AS value FROM orders WHERE o_orderstatus <> 'P'")
def _(s, d):
    """Values of a partition column as paths have them, one left out by a filter of paths."""
    path = folder(s)
    write_dataset(t(s, d, "orders").select("o_orderkey", "o_orderstatus"), path, partition_by=["o_orderstatus"])
    files = Dataset(s, path).files()
    values = partitions.partition_values(files)["o_orderstatus"] - {"P"}
    kept = partitions.filter_paths(files, {"o_orderstatus": values})
    return s.createDataFrame([(v,) for v in sorted(partitions.partition_values(kept)["o_orderstatus"])], "value string")


@query("repartition_derived", "SELECT o_orderkey, strftime(o_orderdate, '%Y%m') AS folder FROM orders")
def _(s, d):
    """New folders from a time; the gate compares each row with its folder."""
    path = folder(s)
    write_dataset(t(s, d, "orders").select("o_orderkey", "o_orderdate"), path)
    maintenance.maintain(s, "repartition", path, partition_by=["m"], derived={"m": partitions.derived_key("o_orderdate", "%Y%m")})
    return s.read.parquet(path).select("o_orderkey", F.regexp_extract("_metadata.file_path", "/m=([^/]*)/", 1).alias("folder"))


ORDERS = ["o_orderkey", "o_orderstatus", "o_orderpriority"]


@query("csv_json_orders", f"SELECT {', '.join(ORDERS)}, 'csv' AS kind FROM orders UNION ALL SELECT {', '.join(ORDERS)}, 'json' FROM orders")
def _(s, d):
    """Written by the library as CSV and JSON, appended once, and read back."""
    path, o = folder(s), t(s, d, "orders").select(*ORDERS)
    out = []
    for kind in ("csv", "json"):
        write_files(o.where("o_orderkey % 2 = 0"), f"{path}/{kind}", kind)
        write_files(o.where("o_orderkey % 2 = 1"), f"{path}/{kind}", kind, mode="append")
        out.append(read_files(s, f"{path}/{kind}", kind).select(F.col("o_orderkey").cast("long").alias("o_orderkey"), *ORDERS[1:], F.lit(kind).alias("kind")))
    return union_all(out)


@query("read_in_batches", "SELECT o_orderkey, o_orderstatus FROM orders")
def _(s, d):
    path = folder(s)
    write_dataset(cut(t(s, d, "orders").select("o_orderkey", "o_orderstatus"), 5, "o_orderkey"), path)
    return union_all(list(read_files(s, path, batch_size=2)))


@query("write_unique", "SELECT DISTINCT o_custkey, o_orderstatus FROM orders")
def _(s, d):
    path = folder(s)
    write_files(t(s, d, "orders").select("o_custkey", "o_orderstatus"), path, unique=True)
    return s.read.parquet(path)


@query("flatten_struct", "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS p_k FROM events")
def _(s, d):
    return frames.unnest_all(t(s, d, "events").select("event_id", F.from_json("props", "k long").alias("p")))


@query("explode_list", "SELECT vec_id, count(*) AS n, round(sum(e), 4) AS total FROM (SELECT vec_id, unnest(embedding)::DOUBLE AS e FROM embeddings) GROUP BY vec_id")
def _(s, d):
    return frames.explode_all(t(s, d, "embeddings").select("vec_id", "embedding")).groupBy("vec_id").agg(F.count("embedding").alias("n"), F.round(F.sum(F.col("embedding").cast("double")), 4).alias("total"))


@query("derived_partition_keys", "SELECT year(o_orderdate)::INT AS y, month(o_orderdate)::INT AS m, count(*) AS n FROM orders GROUP BY ALL")
def _(s, d):
    path = folder(s)
    o = t(s, d, "orders").withColumns({"y": partitions.derived_key("o_orderdate", "year"), "m": partitions.derived_key("o_orderdate", "month")})
    write_dataset(o, path, partition_by=["y", "m"])
    return s.read.parquet(path).groupBy(F.col("y").cast("int").alias("y"), F.col("m").cast("int").alias("m")).agg(F.count(F.lit(1)).alias("n"))


def cut(df: DataFrame, least: int, by: str) -> DataFrame:
    """At least so many parts, more where a part would be too much for a task."""
    return df.repartition(max(least, tasks_for(df.count())), by)


def small_files(s, d) -> str:
    path = folder(s)
    li = t(s, d, "lineitem").select(*L)
    write_dataset(cut(li, 6, "l_orderkey"), path, partition_by=["l_returnflag"])
    write_dataset(cut(li.where("l_orderkey % 5 = 0"), 2, "l_orderkey"), path, partition_by=["l_returnflag"])
    return path


ALL_TWICE = f"SELECT {', '.join(L)} FROM lineitem UNION ALL SELECT {', '.join(L)} FROM lineitem WHERE l_orderkey % 5 = 0"


@query("compact", ALL_TWICE)
def _(s, d):
    path = small_files(s, d)
    maintenance.maintain(s, "compact", path)
    return s.read.parquet(path).select(*L)


@query("deduplicate_dataset", "SELECT l_orderkey, l_linenumber, l_returnflag, max(l_quantity) AS l_quantity FROM lineitem GROUP BY ALL")
def _(s, d):
    path = small_files(s, d)
    maintenance.maintain(s, "deduplicate", path, keys=["l_orderkey", "l_linenumber"], order_by=["-l_quantity"])
    return s.read.parquet(path).select(*L)


@query("repartition_dataset", ALL_TWICE)
def _(s, d):
    path = small_files(s, d)
    maintenance.maintain(s, "repartition", path, partition_by=["l_linenumber"])
    return s.read.parquet(path).select("l_orderkey", F.col("l_linenumber").cast("int").alias("l_linenumber"), "l_quantity", "l_returnflag")


@query("order_dataset", f"SELECT *, row_number() OVER (PARTITION BY l_returnflag ORDER BY l_quantity DESC, l_orderkey, l_linenumber) AS place FROM ({ALL_TWICE})")
def _(s, d):
    """``place``: where rows stand, by file and row: after all rows of the files before."""
    path = small_files(s, d)
    maintenance.maintain(s, "order", path, sort_by=["-l_quantity", "l_orderkey", "l_linenumber"], target_bytes=1 << 18)
    read = s.read.parquet(path).select(*L, F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"))
    files = read.groupBy("l_returnflag", "file").agg(F.count(F.lit(1)).alias("n"))
    earlier = Window.partitionBy("l_returnflag").orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    starts = files.select("file", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("start"))
    return read.join(F.broadcast(starts), "file").select(*L, (F.col("start") + F.col("row") + 1).alias("place"))


@query("compact_mixed_schemas", "SELECT o_orderkey, CASE WHEN o_orderkey % 3 > 0 THEN o_orderstatus END AS o_orderstatus, o_orderkey % 100 AS k, CASE WHEN o_orderkey % 3 = 2 THEN o_totalprice END AS o_totalprice FROM orders")
def _(s, d):
    """Files with columns that others lack, and k as int in some, bigint in others."""
    o, path = t(s, d, "orders"), folder(s)
    k = F.col("o_orderkey") % 100
    for i, columns in enumerate([["o_orderkey", k.cast("int").alias("k")], ["o_orderkey", "o_orderstatus", k.alias("k")], ["o_orderkey", "o_orderstatus", k.alias("k"), "o_totalprice"]]):
        cut(o.where(F.col("o_orderkey") % 3 == i).select(*columns), 2, "o_orderkey").write.mode("append").parquet(path)
    maintenance.maintain(s, "compact", path)
    return s.read.parquet(path).select("o_orderkey", "o_orderstatus", "k", "o_totalprice")


@query("compact_text_partitions", "SELECT o_orderkey, printf('m=%02d', month(o_orderdate)) AS folder FROM orders")
def _(s, d):
    """Partitions that are spelled with zeros keep their names."""
    path = folder(s)
    write_dataset(cut(t(s, d, "orders").select("o_orderkey", F.date_format("o_orderdate", "MM").alias("m")), 3, "o_orderkey"), path, partition_by=["m"])
    maintenance.maintain(s, "compact", path)
    return s.read.parquet(path).select("o_orderkey", F.regexp_extract("_metadata.file_path", "/(m=[^/]*)/", 1).alias("folder"))


@query("deduplicate_globally", "SELECT o_custkey, o_orderkey, o_orderstatus FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) = 1")
def _(s, d):
    """The last order of each customer in the whole dataset, under other partitions."""
    path = folder(s)
    write_dataset(cut(t(s, d, "orders").select("o_custkey", "o_orderkey", "o_orderstatus", "o_orderpriority"), 3, "o_orderkey"), path, partition_by=["o_orderpriority"])
    maintenance.maintain(s, "repartition", path, partition_by=["o_orderstatus"], dedup_keys=["o_custkey"], order_by=["-o_orderkey"])
    return s.read.parquet(path).select("o_custkey", "o_orderkey", "o_orderstatus")


@query("rewrite_schema_loose", "SELECT o_orderkey, try_cast(o_orderkey AS TINYINT) AS small FROM orders")
def _(s, d):
    """Values that do not fit the narrower type become null."""
    path = folder(s)
    write_dataset(t(s, d, "orders").select("o_orderkey", F.col("o_orderkey").alias("small")), path)
    goal = T.StructType([T.StructField("o_orderkey", T.LongType()), T.StructField("small", T.ByteType())])
    maintenance.maintain(s, "rewrite_schema", path, schema=goal, policy="loose")
    return s.read.parquet(path)


@query("rewrite_schema_safe", "SELECT o_orderkey, (o_orderkey % 100)::TINYINT AS small FROM orders")
def _(s, d):
    """A narrower type that every value fits."""
    path = folder(s)
    write_dataset(t(s, d, "orders").select("o_orderkey", (F.col("o_orderkey") % 100).alias("small")), path)
    goal = T.StructType([T.StructField("o_orderkey", T.LongType()), T.StructField("small", T.ByteType())])
    maintenance.maintain(s, "rewrite_schema", path, schema=goal, policy="safe")
    return s.read.parquet(path)


@query("stats_of_files", "SELECT CAST(count(*) AS BIGINT) AS n, min(o_orderkey) AS low, max(o_orderkey) AS high, CAST(0 AS BIGINT) AS nulls FROM orders")
def _(s, d):
    """Statistics of files, added up."""
    path = folder(s)
    write_dataset(cut(t(s, d, "orders").select("o_orderkey"), 4, "o_orderkey"), path)
    return file_stats(s, path, ["o_orderkey"]).agg(F.sum("n_rows").alias("n"), F.min("o_orderkey_min").alias("low"), F.max("o_orderkey_max").alias("high"), F.sum("o_orderkey_nulls").alias("nulls"))


@query("rewrite_schema", "SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber, l_quantity, l_returnflag FROM lineitem")
def _(s, d):
    path = folder(s)
    write_dataset(t(s, d, "lineitem").select(*L), path)
    goal = T.StructType([T.StructField(f.name, T.LongType() if f.name == "l_linenumber" else f.dataType) for f in t(s, d, "lineitem").select(*L).schema])
    maintenance.maintain(s, "rewrite_schema", path, schema=goal, policy="strict")
    return s.read.parquet(path)


@query("optimize_dataset", f"SELECT DISTINCT {', '.join(L)} FROM lineitem")
def _(s, d):
    path = small_files(s, d)
    maintenance.maintain(s, "optimize", path, dedup_keys=["l_orderkey", "l_linenumber", "l_quantity"])
    return s.read.parquet(path).select(*L)


#: Plain SQL, as users pass it through. Doubles are rounded, orders are total.
PASSED = {
    "sql_group_agg": "SELECT l_returnflag, l_linestatus, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, count(*) AS n, round(avg(l_quantity), 6) AS avg_qty FROM lineitem GROUP BY l_returnflag, l_linestatus",
    "sql_join_agg": "SELECT n_name, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name",
    "sql_left_join": "SELECT c_custkey, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey",
    "sql_cube": "SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)",
    "sql_rollup": "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY ROLLUP (o_orderstatus, o_orderpriority)",
    "sql_grouping_sets": "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY GROUPING SETS ((o_orderstatus), (o_orderpriority))",
    "sql_having": "SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) > 12",
    "sql_distinct_agg": "SELECT event_type, count(DISTINCT user_id) AS n FROM events GROUP BY event_type",
    "sql_window_rank": "SELECT o_orderkey, rank() OVER (PARTITION BY o_orderstatus ORDER BY o_orderdate) AS r FROM orders",
    "sql_running_sum": "SELECT l_orderkey, l_linenumber, l_quantity, sum(l_quantity) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_quantity ROWS UNBOUNDED PRECEDING) AS q FROM lineitem",
    "sql_intersect": "SELECT c_custkey AS k FROM customer INTERSECT SELECT o_custkey FROM orders",
    "sql_except": "SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey FROM orders WHERE o_orderstatus = 'P'",
    "sql_scalar_subquery": "SELECT o_orderkey FROM orders WHERE o_totalprice > (SELECT avg(o_totalprice) * 1.5 FROM orders)",
    "sql_exists": "SELECT c_custkey FROM customer c WHERE EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_totalprice > 250000)",
    "sql_topk": "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20",
    "sql_cte_union": "WITH a AS (SELECT n_name AS name FROM nation), b AS (SELECT r_name AS name FROM region) SELECT name FROM a UNION ALL SELECT name FROM b",
    "sql_case": "SELECT p_partkey, CASE WHEN p_size < 10 THEN 'small' WHEN p_size < 30 THEN 'medium' ELSE 'large' END AS kind FROM part",
}


def _passed(text: str) -> Query:
    def run(s, d):
        from sparkloom.functions.predicates import table_names

        return sql(s, text, {n: f"{d}/{n}.parquet" for n in table_names(text) if n in TABLES})

    return run


for _name, _text in PASSED.items():
    query(_name, _text)(_passed(_text))


def flagship(s, d):
    """A scan, a filter and a projection through the library's own reader."""
    return read_dataset(s, f"{d}/lineitem.parquet", L, "l_quantity >= 30 AND l_returnflag IN ('A','R')")
