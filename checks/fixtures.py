"""Inputs of the operators, derived from the given tables. Each grows with its table and
names its tables, files and symbols after keys of the data, so that nothing stays small."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession, functions as F

from lakeimpact.operators.overlay import OWNER, own
from lakeimpact.operators.sqlrefs import READS, WRITES

from .templates import CTES, PYTHON, STATEMENTS, choose

AS_OF = datetime(2024, 1, 31)
THIRTY_DAYS = 30 * 24 * 60


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """A table that arrives in fewer partitions than there are cores (one small file) is
    redistributed before row work that costs more than the exchange; a large one is not."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def text(*parts):
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


# Event pipeline


def raw_events(spark, sf) -> DataFrame:
    customer = table(spark, sf, "customer").select("c_custkey", "c_nationkey")
    nation = table(spark, sf, "nation").select("n_nationkey", F.col("n_name").alias("country"))
    day = F.date_format("ts", "yyyyMMdd")
    return (
        table(spark, sf, "events")
        .join(customer, F.col("user_id") == F.col("c_custkey"), "left")
        .join(nation, F.col("c_nationkey") == F.col("n_nationkey"), "left")
        .select(
            "event_id",
            F.col("ts").alias("event_ts"),
            "user_id",
            text(F.col("user_id"), "-", day).alias("session_id"),
            F.round(F.col("value") * 100).cast("bigint").alias("revenue_cents"),
            "country",
        )
    )


def raw_users(spark, sf) -> DataFrame:
    first_order = (
        table(spark, sf, "orders")
        .groupBy(F.col("o_custkey").alias("c_custkey"))
        .agg(F.min("o_orderdate").alias("first_order"))
    )
    return (
        table(spark, sf, "customer")
        .join(first_order, "c_custkey", "left")
        .select(
            F.when(F.col("c_acctbal") >= 0, F.col("c_custkey").cast("string")).alias("id"),
            F.concat("c_name", F.lit("@Example.com")).alias("email"),
            F.to_date("first_order").alias("signup_date"),
            F.col("c_mktsegment").alias("plan_tier"),
        )
    )


# Source texts


def _numbered(spark, sf) -> DataFrame:
    layer = F.col("o_orderkey") % 5
    return spread(table(spark, sf, "orders").select("o_orderkey", "o_custkey")).select(
        "o_orderkey",
        text("main.l", layer, ".t", F.col("o_custkey")).alias("r"),
        text("main.l", layer, ".t", F.col("o_custkey") + 7).alias("r2"),
        text("main.l", layer + 1, ".t", F.col("o_custkey") + 3).alias("w"),
        layer.alias("l"),
        F.col("o_custkey").alias("c"),
    )


def statements(spark, sf) -> DataFrame:
    key = F.col("o_orderkey")
    return _numbered(spark, sf).select(
        text("q/", key, ".sql").alias("file_path"), choose(key % 8, STATEMENTS).alias("text")
    )


def ctes(spark, sf) -> DataFrame:
    key = F.col("o_orderkey")
    return _numbered(spark, sf).select(
        text("c/", key, ".sql").alias("file_path"), choose(key % 5, CTES).alias("text")
    )


def python_files(spark, sf) -> DataFrame:
    key = F.col("o_orderkey")
    return _numbered(spark, sf).select(
        text("p/", key, ".py").alias("file_path"), choose(key % 6, PYTHON).alias("text")
    )


# The function in each Python template: name, first and last line.
FUNCTIONS = [("load", 3, 4), ("save", 1, 2), ("build", 2, 7), ("guess", 1, 4), None, ("both", 1, 3)]


def python_symbols(spark, sf) -> DataFrame:
    key = F.col("o_orderkey")
    path = text("p/", key, ".py")
    shape = F.when(F.lit(False), None)
    for i, function in enumerate(FUNCTIONS):
        if function:
            name, start, end = function
            shape = shape.when(
                key % 6 == i,
                F.struct(
                    F.lit(name).alias("name"),
                    F.lit(start).alias("start_line"),
                    F.lit(end).alias("end_line"),
                ),
            )
    return (
        spread(table(spark, sf, "orders").select("o_orderkey"))
        .select(path.alias("file_path"), shape.alias("s"))
        .where("s is not null")
        .select(F.concat("file_path", F.lit("::"), "s.name").alias("id"), "file_path", "s.*")
    )


def statement_symbols(spark, sf) -> DataFrame:
    """Symbols around SQL references: a third of the files has two nested ones, a third one, a third none."""
    key = F.col("o_orderkey")
    spans = F.array(*[F.struct(F.lit(name).alias("name"), F.lit(1).alias("start_line"), F.lit(end).alias("end_line"))
                      for name, end in (("all", 9), ("head", 2))])
    return (
        spread(table(spark, sf, "orders").select("o_orderkey"))
        .where(key % 3 != 2)
        .select(text("q/", key, ".sql").alias("file_path"), F.inline(F.slice(spans, 1, F.when(key % 3 == 0, 2).otherwise(1))))
        .select(F.concat("file_path", F.lit("::"), "name").alias("id"), "file_path", "name", "start_line", "end_line")
    )


def known_tables(spark, sf) -> DataFrame:
    """Live tables for the names in the statements: some layers of each customer's table."""
    layer = F.explode(F.array(*[F.lit(n) for n in range(7)])).alias("layer")
    return (
        table(spark, sf, "customer")
        .select("c_custkey", layer)
        .where((F.col("c_custkey") + F.col("layer")) % 3 != 0)
        .select(text("main.l", F.col("layer"), ".t", F.col("c_custkey")).alias("table_name"))
    )


# Symbols, references, edges


def symbols(spark, sf) -> DataFrame:
    item = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber").distinct()
    path = text("m", F.col("l_orderkey"), ".py")
    n = F.col("l_linenumber")
    functions = item.select(
        path.alias("file_path"),
        text("f", n).alias("name"),
        F.lit("function").alias("kind"),
        (n * 10 - 8).alias("start_line"),
        (n * 10).alias("end_line"),
    )
    classes = item.select(path.alias("file_path")).distinct().select(
        "file_path",
        F.lit("C").alias("name"),
        F.lit("class").alias("kind"),
        F.lit(1).alias("start_line"),
        F.lit(60).alias("end_line"),
    )
    both = functions.unionByName(classes)
    return both.select(F.concat("file_path", F.lit("::"), "name").alias("id"), *both.columns)


def references(spark, sf) -> DataFrame:
    line = (F.col("l_partkey") % 80 + 1).cast("int")
    return (
        table(spark, sf, "lineitem")
        .select("l_orderkey", line.alias("line"))
        .distinct()
        .select("l_orderkey", text("m", F.col("l_orderkey"), ".py").alias("file_path"), "line")
    )


def symbol_lines(spark, sf) -> DataFrame:
    """NDJSON: symbols, some without optional fields, among other records and broken lines."""
    s = symbols(spark, sf)
    full = F.to_json(
        F.struct(F.lit("symbol").alias("record_type"), "id", "name", "kind", "file_path", "start_line", "end_line")
    )
    bare = F.to_json(F.struct(F.lit("symbol").alias("record_type"), "id", "name", "file_path"))
    other = F.to_json(F.struct(F.lit("relation").alias("record_type"), "id", "name"))
    return s.select(
        F.explode(
            F.when(
                F.col("kind") == "class", F.array(bare, other, F.concat(F.lit("{"), "id"))
            ).otherwise(F.array(full))
        ).alias("value")
    )


def layered_edges(spark, sf) -> DataFrame:
    """One job per order that reads tables of its layer and writes tables of the next."""
    key, n = F.col("l_orderkey"), F.col("l_linenumber")
    odd = n % 2 == 1
    layer = key % 6 + F.when(odd, 0).otherwise(1)
    name = text("L", layer, ".t", F.col("l_partkey"), "_", F.floor((n + 1) / 2))
    # Made distinct before the texts are made: they name all three keys, and there is no name without all of them.
    part = F.when(key.isNotNull() & n.isNotNull(), F.col("l_partkey")).alias("l_partkey")
    return (
        table(spark, sf, "lineitem")
        .select("l_orderkey", "l_linenumber", part)
        .distinct()
        .select(
            text("s", key).alias("from_id"),
            F.when(odd, READS).otherwise(WRITES).alias("type"),
            name.alias("table_name"),
            text("m", key, ".py").alias("file_path"),
            n.alias("line"),
        )
        .withColumn("resolution", F.lit("literal"))
    )


def owned_edges(spark, sf) -> DataFrame:
    """The references as edges of the symbols around them, in four layers of tables."""
    key, line = F.col("l_orderkey"), F.col("line")
    odd = line % 2 == 1
    layer = key % 4 + F.when(odd, 0).otherwise(1)
    refs = references(spark, sf).select(
        "file_path",
        "line",
        text("L", layer, ".T", F.floor((key + line * 7) / 3)).alias("table_name"),
        F.when(odd, READS).otherwise(WRITES).alias("type"),
        F.lit("literal").alias("resolution"),
    )
    return own(refs, symbols(spark, sf))


def unseen(key):
    """Some 2 % of the owned files can't be read any more."""
    return key % 47 == 5


def owned_sources_read(spark, sf) -> DataFrame:
    """The owned files as they were read this time: (file_path, text, reason)."""
    lost = unseen(F.regexp_extract("file_path", "[0-9]+", 0).cast("bigint"))
    return owned_sources(spark, sf).select(
        "file_path", F.when(~lost, F.col("text")).alias("text"), F.when(lost, F.lit("not UTF-8")).alias("reason")
    )


# The column each line of an owned file mentions: COLUMNS names c0, c1, ...
COLUMNS = 11


def owned_sources(spark, sf) -> DataFrame:
    key = F.col("l_orderkey")
    lines = [F.concat(F.lit("use C"), ((key * 7 + i * i) % COLUMNS).cast("string")) for i in range(1, 81)]
    return (
        table(spark, sf, "lineitem")
        .select("l_orderkey")
        .distinct()
        .select(text("m", key, ".py").alias("file_path"), F.concat_ws("\n", *lines).alias("text"))
    )


def owned_catalog(spark, sf) -> DataFrame:
    """Live columns of the owned tables; every fifth table has none."""
    tables = owned_table_names(spark, sf).where("id % 5 <> 0")
    column = F.posexplode(F.array(*[F.lit(f"c{i}") for i in range(COLUMNS)]))
    return tables.select("table_name", column.alias("ordinal", "column_name")).withColumn(
        "data_type", F.lit("bigint")
    )


def owned_table_names(spark, sf) -> DataFrame:
    key, line = F.col("l_orderkey"), F.col("line")
    layer = key % 4 + F.when(line % 2 == 1, 0).otherwise(1)
    number = F.floor((key + line * 7) / 3)
    return (
        references(spark, sf)
        .select(text("L", layer, ".T", number).alias("table_name"), number.alias("id"))
        .distinct()
    )


def diffs(spark, sf) -> DataFrame:
    """One diff payload per order: a changed function, a nameless entity, a file without changes."""
    key = F.col("l_orderkey")
    payload = text(
        '{"files":[{"path":"m', key, '.py","changes":[{"name":"f1","type":"body_changed"},'
        '{"type":"removed","was":', key, '}]},{"path":"x.sql"},{"changes":[{"name":"lost"}]}]}',
    )
    # Some payloads are no JSON at all. Branches are conversations, times their turns.
    return (
        table(spark, sf, "lineitem")
        .select("l_orderkey")
        .distinct()
        .select(
            key.alias("change_id"),
            (key % 1200).alias("branch"),
            (key % 7).alias("changed_at"),
            F.when(key % 50 == 49, F.lit("{oops")).otherwise(payload).alias("payload"),
        )
    )


# Columns


def core_table(key):
    return text("main.core.t", key)


# Names in place of those of ``orders``, most of them no single word.
ODD_NAMES = ["o-orderkey", "o custkey", "o.order.status", "o_totalprice", "order/date", "o  order priority"]


def live_catalog(spark, sf, names=None) -> DataFrame:
    """Each customer in good standing has a table with the columns of ``orders``, or others of the same types."""
    fields = table(spark, sf, "orders").schema
    names = names or fields.names
    columns = F.array(
        *[
            F.struct(
                F.lit(name).alias("column_name"),
                F.lit(f.dataType.simpleString()).alias("data_type"),
                F.lit(i).alias("ordinal"),
            )
            for i, (f, name) in enumerate(zip(fields, names))
        ]
    )
    return (
        table(spark, sf, "customer")
        .where("c_acctbal >= 0")
        .select(core_table(F.col("c_custkey")).alias("table_name"), F.inline(columns))
    )


def proposals(spark, sf) -> DataFrame:
    """One change per order, to the table of its customer: it still mentions column i when
    bit i of its key is set. The first word contains a column name and must not count."""
    orders = table(spark, sf, "orders")
    key = F.col("o_orderkey")
    mentioned = [
        F.when(
            F.getbit(key, F.lit(i)) == 1,
            F.lit(", " + (name.upper() if i % 2 else name)),
        ).otherwise("")
        for i, name in enumerate(orders.columns)
    ]
    return orders.select(
        key.alias("change_id"),
        core_table(F.col("o_custkey")).alias("table_name"),
        F.concat(F.lit("SELECT 1 AS k_o_custkey_x"), *mentioned, F.lit(" FROM orders")).alias("text"),
    )


def reader_files(spark, sf, names=None) -> DataFrame:
    """One file per event with a line per column of ``orders``: used when bit i is set."""
    key = F.col("event_id")
    names = names or table(spark, sf, "orders").columns
    lines = [
        F.when(F.getbit(key, F.lit(i)) == 1, F.lit(f"use {name}")).otherwise("pass")
        for i, name in enumerate(names)
    ]
    return table(spark, sf, "events").select(
        text("r", key, ".py").alias("file_path"), F.concat_ws("\n", *lines).alias("text")
    )


def reader_edges(spark, sf) -> DataFrame:
    """Both scopes of each reader file read the table of the event's user."""
    path = text("r", F.col("event_id"), ".py")
    scope = F.inline(
        F.array(
            *[
                F.struct(
                    F.lit(name).alias("owner_name"),
                    F.lit(start).alias("owner_start"),
                    F.lit(end).alias("owner_end"),
                )
                for name, start, end in (("top", 1, 3), ("bottom", 4, 6))
            ]
        )
    )
    return (
        table(spark, sf, "events")
        .select(path.alias("file_path"), core_table(F.col("user_id")).alias("table_name"), scope)
        .select(
            F.concat("file_path", F.lit("::"), "owner_name").alias("from_id"),
            "table_name",
            F.lit(READS).alias("type"),
            "file_path",
            F.col("owner_start").alias("line"),
            F.lit("literal").alias("resolution"),
            F.concat("file_path", F.lit("::"), "owner_name").alias("owner_id"),
            *OWNER[1:],
        )
    )


# Files and tables of their own


def source_tree(spark, sf) -> DataFrame:
    """A file per customer: packages, SQL files with a name that Spark's readers skip, other files; two kinds of line ends."""
    key = F.col("c_custkey")
    path = F.when(key % 3 == 0, text("r", key % 20, "/p", key, "/__init__.py")).when(
        key % 11 == 0, text("r", key % 20, "/notes", key, ".txt")
    )
    return table(spark, sf, "customer").select(
        F.coalesce(path, text("r", key % 20, "/_q", key, ".sql")).alias("file_path"),
        F.concat(F.lit("-- "), "c_name", F.when(key % 2 == 0, "\r\n").otherwise("\n"), text("SELECT ", key, "\rFROM t")).alias("text"),
    )


def order_tables(spark, sf, root: str) -> DataFrame:
    """The orders as one Parquet table per ten customers, written below ``root``: (table_name, path)."""
    number = F.floor(F.col("o_custkey") / 10).alias("k")
    orders = table(spark, sf, "orders").withColumn("k", number)
    orders.repartition("k").write.partitionBy("k").parquet(root)
    return orders.select(text("main.o", F.col("k")).alias("table_name"), text(root, "/k=", F.col("k")).alias("path")).distinct()


# Checkpoints


def checkpoint_payloads(spark, sf) -> DataFrame:
    """One list of envelopes per turn of a conversation, in three versions of the format."""
    conv, turn, role = F.col("conv_id"), F.col("turn"), F.col("role")
    tag = text(conv, "-", turn)
    one, two = conv * 7 + turn, conv * 7 + turn + 1
    version = conv % 3
    payload = (
        F.when(
            version == 0,
            text('[{"id":"  c', tag, '  ","session":"s', conv, '","intent":"', role, ' asks",'
                 '"files":["q/', one, '.sql","q/', two, '.sql"]}]'),
        )
        .when(
            version == 1,
            text('{"checkpoints":[{"id":"  ","checkpoint_id":"k', tag, '","session_id":" s', conv,
                 '","intent":null,"summary":"', role, '","files":[],"changed_files":[{"path":"q/', one,
                 '.sql","kind":"modified"},3,{"other":1},{"path":" ","file":"q/', two, '.sql"}]}]}'),
        )
        .otherwise(
            text('[{"sha":"h', tag, '","id":7,"description":"', role, ' done","files":[{"file_path":"q/',
                 one, '.sql"},"q/', two, '.sql"]},{"sha":"older', tag, '"}]'),
        )
    )
    return table(spark, sf, "conversations").select(
        conv.alias("branch"), turn.alias("turn"), payload.alias("payload")
    )


