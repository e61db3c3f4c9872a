"""Edges between code and tables: who owns each table reference."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import text as tx
from ..functions.intervals import BITS, LARGE, SMALL, cut_ranges
from ..session import Scratch
from .pyrefs import LITERAL, python_table_refs
from .sqlrefs import sql_table_refs

OWNER = ("owner_id", "owner_name", "owner_start", "owner_end")
EDGE = ("from_id", "table_name", "type", "file_path", "line", "resolution")


def innermost_by_piece(symbols: DataFrame) -> DataFrame:
    """Symbols cut into pieces of blocks, and of those with the same piece the innermost.

    The narrowest symbol wins, then the earliest (column ``ordinal``, or the id where there
    is none). However many symbols overlap in a file, a block keeps a bounded number of
    different pieces.
    """
    span = F.col("end_line").cast("bigint") - F.col("start_line").cast("bigint")
    order = ["ordinal"] if "ordinal" in symbols.columns else []
    owner = F.struct(
        F.col("id").alias("owner_id"),
        F.col("name").alias("owner_name"),
        F.col("start_line").cast("int").alias("owner_start"),
        F.col("end_line").cast("int").alias("owner_end"),
    )
    candidates = symbols.select(
        "file_path",
        # Compared field by field: the owner starts with its id.
        F.struct(span.alias("span"), *order, owner.alias("owner")).alias("candidate"),
        "start_line",
        "end_line",
    )
    return (
        cut_ranges(candidates, "start_line", "end_line")
        # Once for this grouping and one by block.
        .repartition("file_path", "size", "block")
        .groupBy("file_path", "size", "block", "low", "high")
        .agg(F.min("candidate").alias("candidate"))
    )


def owners_by_block(symbols: DataFrame) -> DataFrame:
    """(file_path, size, block, pieces): the pieces of each block, some 2,000 of a small one at most, one of a large one."""
    return innermost_by_piece(symbols).groupBy("file_path", "size", "block").agg(
        F.collect_list(F.struct("low", "high", "candidate")).alias("pieces")
    )


def ref_owner(refs: DataFrame, symbols: DataFrame) -> DataFrame:
    """Add the innermost enclosing symbol of each (file_path, line), null where none.

    A reference meets one row per size of blocks, so that nothing is multiplied and references are exchanged once. The
    blocks are stored: both sides of the join come straight from an exchange, so that the runtime splits a block, or a
    line, with very many references.
    """
    columns, line = refs.columns, F.col("line").cast("bigint")
    blocks = Scratch(refs.sparkSession, "blocks").cut(owners_by_block(symbols), "blocks")
    small = blocks.where(F.col("size") == SMALL).select("file_path", F.col("block").alias("_small"), F.col("pieces").alias("_pieces"))
    # Ranges that fill a block of 4,096 lines are few, if any.
    large = blocks.where(F.col("size") == LARGE).select(
        "file_path", F.col("block").alias("_large"), F.col("pieces")[0]["candidate"].alias("_whole")
    )
    around = F.filter("_pieces", lambda piece: line.between(piece["low"], piece["high"]))
    best = F.least(F.array_min(F.transform(around, lambda piece: piece["candidate"])), F.col("_whole"))
    return (
        refs.withColumns({"_small": F.shiftright(line, BITS), "_large": F.shiftright(line, 2 * BITS)})
        # Both sides grow with the code, which size estimates do not see: never a broadcast.
        .join(small.hint("merge"), ["file_path", "_small"], "left")
        .join(large, ["file_path", "_large"], "left")
        .select(*columns, best.alias("_best"))
        .select(*columns, "_best.owner.*")
    )


def own(refs: DataFrame, symbols: DataFrame, repo_key: str = "") -> DataFrame:
    """References to edges: the enclosing symbol is the origin, or else the file itself."""
    file_id = F.concat(F.lit(f"{repo_key}:file:"), F.col("file_path"))
    return ref_owner(refs, symbols).withColumn("from_id", F.coalesce("owner_id", file_id)).select(
        *EDGE, *OWNER
    )


def sql_file_refs(sources: DataFrame) -> DataFrame:
    """References of .sql files; the line is where the last name part first occurs."""
    found = sql_table_refs(sources.select("file_path", "text"), keep=["file_path", "text"])
    return found.select(
        "file_path",
        "table_name",
        "type",
        tx.line_of(F.col("text"), tx.last_part(F.col("table_name"))).alias("line"),
        F.lit(LITERAL).alias("resolution"),
    )


def sql_file_edges(sources: DataFrame, symbols: DataFrame, repo_key: str = "") -> DataFrame:
    return own(sql_file_refs(sources), symbols, repo_key)


def python_file_edges(sources: DataFrame, symbols: DataFrame, repo_key: str = "") -> DataFrame:
    refs = python_table_refs(sources.select("file_path", "text"))
    return own(refs, symbols, repo_key)


def suffix_is(suffix: str) -> Column:
    """Whether the file name ends in ``suffix`` and has more than it."""
    name = F.substring_index("file_path", "/", -1)
    return name.endswith(suffix) & (F.length(name) > len(suffix))


def build_edges(sources: DataFrame, symbols: DataFrame, repo_key: str = "") -> DataFrame:
    """Edges of all SQL and Python files; both kinds share one ownership join."""
    refs = sql_file_refs(sources.where(suffix_is(".sql"))).unionByName(
        python_table_refs(sources.where(suffix_is(".py")).select("file_path", "text"))
    )
    return own(refs, symbols, repo_key)


def relation_records(edges: DataFrame, repo_key: str = "") -> DataFrame:
    """Edges in the record shape that graph snapshots use."""
    return edges.select(
        F.lit("relation").alias("record_type"),
        "type",
        "from_id",
        F.concat(F.lit(f"{repo_key}:Table:"), F.col("table_name")).alias("to_id"),
        F.lit("table").alias("to_kind"),
        "resolution",
        F.struct("file_path", "line").alias("evidence"),
    )
