"""Registered queries: each runs one operator over inputs derived from the whole tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from lakeimpact.operators import checkpoints as ck
from lakeimpact.operators import blind, columns, graph, impact, medallion, overlay, pyrefs, sqlrefs
from lakeimpact.plans import audit as auditing
from lakeimpact.session import Scratch, apply_settings, stored
from lakeimpact.sources import files, landing, records, tables

from . import fixtures as fx

EDGE = list(overlay.EDGE)


def _sessions(spark, sf, minutes=fx.THIRTY_DAYS):
    return medallion.clean_sessions(fx.raw_events(spark, sf), fx.AS_OF, minutes, ("event_id",))


def _users(spark, sf):
    return medallion.clean_users(fx.raw_users(spark, sf))


def _cents(df, *names):
    """Exact decimals as the doubles that the check SQL has."""
    return df.withColumns({n: F.round(n, 2).cast("double") for n in names})


def bronze_ingest(spark, sf):
    stamped = landing.stamp(fx.raw_events(spark, sf), fx.AS_OF)
    return stamped.withColumn("_ingested_at", F.col("_ingested_at").cast("timestamp_ntz"))


def silver_sessions(spark, sf):
    return _cents(_sessions(spark, sf, medallion.SESSION_WINDOW_MINUTES), "revenue")


def silver_sessions_month(spark, sf):
    return _cents(_sessions(spark, sf), "revenue")


def silver_users(spark, sf):
    return _users(spark, sf)


def gold_daily_revenue(spark, sf):
    return _cents(medallion.daily_revenue(_sessions(spark, sf), _users(spark, sf)), "revenue")


def gold_user_retention(spark, sf):
    return medallion.user_retention(_sessions(spark, sf), _users(spark, sf))


def gold_revenue_by_country(spark, sf):
    return _cents(medallion.revenue_by_country(_sessions(spark, sf)), "revenue")


def dashboard_revenue(spark, sf):
    daily = medallion.daily_revenue(_sessions(spark, sf), _users(spark, sf))
    return _cents(medallion.dashboard_revenue(daily, fx.AS_OF), "revenue")


def sql_table_refs(spark, sf):
    return sqlrefs.sql_table_refs(fx.statements(spark, sf))


def sql_refs_in_documents(spark, sf):
    documents = fx.spread(fx.table(spark, sf, "documents").select("doc_id", "text"))
    return sqlrefs.sql_table_refs(documents)


def cte_exclusion(spark, sf):
    return sqlrefs.sql_table_refs(fx.ctes(spark, sf))


def known_table_refs(spark, sf):
    return sqlrefs.known_table_refs(
        sqlrefs.sql_table_refs(fx.statements(spark, sf)), fx.known_tables(spark, sf)
    )


def sql_file_edges(spark, sf):
    return overlay.sql_file_edges(fx.statements(spark, sf), fx.statement_symbols(spark, sf), "k").select(*EDGE)


def python_table_refs(spark, sf):
    return pyrefs.python_table_refs(fx.python_files(spark, sf))


def python_file_edges(spark, sf):
    return overlay.python_file_edges(
        fx.python_files(spark, sf), fx.python_symbols(spark, sf), "k"
    ).select(*EDGE)


def edges(spark, sf):
    sources = fx.statements(spark, sf).unionByName(fx.python_files(spark, sf))
    symbols = fx.python_symbols(spark, sf).unionByName(fx.statement_symbols(spark, sf))
    return overlay.build_edges(sources, symbols, "k").select(*EDGE)


def ref_owner(spark, sf):
    refs = fx.references(spark, sf).select("file_path", "line")
    return overlay.ref_owner(refs, fx.symbols(spark, sf)).select("file_path", "line", "owner_id")


def symbols_from_ndjson(spark, sf):
    return records.symbols_from_ndjson(fx.symbol_lines(spark, sf))


def relation_records(spark, sf):
    found = overlay.relation_records(fx.layered_edges(spark, sf), "k")
    return found.select(
        *[c for c in found.columns if c != "evidence"],
        F.col("evidence.file_path").alias("evidence_file"),
        F.col("evidence.line").alias("evidence_line"),
    )


def table_graph(spark, sf):
    return graph.table_graph(fx.layered_edges(spark, sf))


def _all_written(edges):
    return edges.where(F.col("type") == sqlrefs.WRITES).select("table_name").distinct()


def blast_radius(spark, sf):
    found = stored(fx.layered_edges(spark, sf), "edges")
    return graph.blast_radius(_all_written(found), *graph.links(found))


def blast_radius_order(spark, sf):
    found = stored(fx.layered_edges(spark, sf), "edges")
    return graph.blast_radius(_all_written(found), *graph.links(found), ordered=True)


def changed_entities(spark, sf):
    found = records.changed_entities(fx.diffs(spark, sf))
    was = F.try_variant_get("entity", "$.was", "bigint").alias("was")
    return found.select("change_id", "file_path", "name", "change_type", was)


def _changed(spark, sf):
    changed = records.changed_entities(fx.diffs(spark, sf))
    return stored(changed.select("change_id", "file_path", "name"), "changed")


def tables_written(spark, sf):
    edges = stored(fx.owned_edges(spark, sf), "edges")
    return impact.tables_written(edges, _changed(spark, sf))


def consumers(spark, sf):
    owned = stored(fx.owned_edges(spark, sf), "edges")
    written = stored(impact.tables_written(owned, _changed(spark, sf)), "written")
    affected = graph.reached_tables(written.select("table_name"), *graph.links(owned))
    return impact.consumers(owned, affected)


def columns_mentioned(spark, sf):
    found = columns.columns_mentioned(fx.proposals(spark, sf), fx.live_catalog(spark, sf))
    return found.select("change_id", "table_name", "column_name")


def dropped_columns(spark, sf):
    return columns.dropped_columns(fx.proposals(spark, sf), fx.live_catalog(spark, sf))


def _readers(spark, sf, dropped):
    gone = stored(dropped.select("table_name", "column_name").distinct(), "gone")
    return columns.reader_mentions(fx.reader_edges(spark, sf), fx.reader_files(spark, sf), gone)


def odd_name_mentions(spark, sf):
    """Readers of columns whose names are mostly no single word."""
    catalog = fx.live_catalog(spark, sf, fx.ODD_NAMES)
    return columns.reader_mentions(fx.reader_edges(spark, sf), fx.reader_files(spark, sf, fx.ODD_NAMES), catalog)


def column_breaks(spark, sf):
    dropped = stored(dropped_columns(spark, sf), "dropped")
    return columns.column_breaks(dropped, _readers(spark, sf, dropped))


def change_verdict(spark, sf):
    changes = fx.proposals(spark, sf).select("change_id", "table_name")
    catalog = fx.live_catalog(spark, sf)
    dropped = stored(dropped_columns(spark, sf), "dropped")
    statuses = impact.change_verdict(changes, dropped, _readers(spark, sf, dropped), catalog)
    return impact.verdicts(changes, statuses)


def _checkpoints(spark, sf):
    return ck.checkpoints_normalized(records.checkpoint_envelopes(fx.checkpoint_payloads(spark, sf)))


def checkpoints_normalized(spark, sf):
    return (
        _checkpoints(spark, sf)
        .withColumn("files", F.array_join("files", ","))
        .drop("raw")
    )


def latest_checkpoint(spark, sf):
    newest_first = F.struct((-F.col("turn")).alias("turn"), "position", "id")
    placed = _checkpoints(spark, sf).withColumn("place", newest_first)
    latest = ck.latest_checkpoint(placed, "branch", "place")
    return latest.withColumn("files", F.array_join("files", ","))


def checkpoint_tables(spark, sf):
    found = overlay.sql_file_edges(fx.statements(spark, sf), fx.statement_symbols(spark, sf))
    return ck.checkpoint_tables(_checkpoints(spark, sf), found, ["branch", "id"])


def audit_summary(spark, sf):
    """Files that can't be read any more keep their former edges; intent is that of the time of the change."""
    # Sources are a table, as files that were read are; the texts are made once.
    diffs, sources = fx.diffs(spark, sf), stored(fx.owned_sources_read(spark, sf), "sources")
    unseen = stored(blind.unseen_files(sources), "unseen")
    former = stored(fx.owned_edges(spark, sf), "former")
    return auditing.audit(
        former.join(unseen, "file_path", "left_anti").select(*former.columns),
        records.changed_entities(diffs),
        sources.where("reason is null").drop("reason"),
        fx.owned_catalog(spark, sf),
        changes=records.change_list(diffs),
        unseen=unseen,
        former=former,
        history=_checkpoints(spark, sf).withColumnRenamed("turn", "recorded_at"),
    ).summary


def intent_at(spark, sf):
    changes = fx.diffs(spark, sf).drop("payload")
    return ck.intent_at(changes, _checkpoints(spark, sf), recorded_at="turn")


def sessions_from_landing(spark, sf):
    """Landing files of all events, read back by schema, to sessions."""
    raw = fx.raw_events(spark, sf)
    work = Scratch(spark, "landing")
    raw.write.option("timestampNTZFormat", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").json(f"{work.root}/events")
    read = landing.read_events(spark, f"{work.root}/events", raw.schema)
    window = medallion.SESSION_WINDOW_MINUTES
    return _cents(medallion.clean_sessions(read, fx.AS_OF, window, ("event_id",)), "revenue")


def users_from_landing(spark, sf):
    """Landing files of all users as CSV, read back by schema, to users."""
    raw = fx.raw_users(spark, sf)
    work = Scratch(spark, "landing")
    raw.write.option("header", True).csv(f"{work.root}/users")
    users = medallion.clean_users(landing.read_users(spark, f"{work.root}/users"))
    return users.withColumn("signup_date", F.col("signup_date").cast("date"))  # CSV has text only


def revenue_tables(spark, sf):
    """Daily revenue through the table sinks: another table's rows, replaced by a select, overwritten by position."""
    name = f"revenue_{uuid.uuid4().hex}"
    users = _users(spark, sf)
    daily = medallion.daily_revenue(_sessions(spark, sf), users)
    tables.overwrite_table(users, name)
    tables.replace_table_as(daily.withColumn("revenue", -F.col("revenue")), name)
    tables.insert_overwrite(daily, name)
    # The rows outlive the table: nothing stays in the catalog.
    rows = Scratch(spark, "revenue").cut(_cents(spark.table(name), "revenue"), "rows")
    spark.sql(f"DROP TABLE {name}")
    return rows


def source_files(spark, sf):
    """A tree of source files, written and read back."""
    root = f"{Scratch(spark, 'tree').root}/files"
    files.write_source_files(fx.source_tree(spark, sf), root)
    return files.read_source_files(spark, root)


def catalog_columns(spark, sf):
    """Columns of many tables from the footers of their files."""
    return tables.file_columns(fx.order_tables(spark, sf, f"{Scratch(spark, 'tables').root}/orders"))


REGISTERED = (
    bronze_ingest, silver_sessions, silver_sessions_month, silver_users, gold_daily_revenue,
    gold_user_retention, gold_revenue_by_country, dashboard_revenue, sql_table_refs,
    sql_refs_in_documents, cte_exclusion, known_table_refs, sql_file_edges, python_table_refs,
    python_file_edges, edges, ref_owner, symbols_from_ndjson, relation_records, table_graph,
    blast_radius, blast_radius_order, changed_entities, tables_written, consumers,
    columns_mentioned, dropped_columns, odd_name_mentions, column_breaks, change_verdict, checkpoints_normalized,
    latest_checkpoint, checkpoint_tables, intent_at, audit_summary, sessions_from_landing,
    users_from_landing, revenue_tables, source_files, catalog_columns,
)


def _with_settings(query):
    def run(spark, sf):
        return query(apply_settings(spark), sf)

    run.__name__ = query.__name__
    return run


def queries():
    return {q.__name__: _with_settings(q) for q in REGISTERED}
