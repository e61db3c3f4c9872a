"""Who owns a reference, and the whole way from files to edges."""

import random

from pyspark.sql import functions as F

from lakeimpact.operators.overlay import build_edges, ref_owner, relation_records
from lakeimpact.operators.graph import blast_radius, links, table_graph
from lakeimpact.session import apply_settings

SYMBOLS = "id string, name string, kind string, file_path string, start_line int, end_line int, ordinal int"


def innermost(symbols, path, line):
    inside = [s for s in symbols if s[3] == path and s[4] <= line <= s[5]]
    return min(inside, key=lambda s: (s[5] - s[4], s[6]))[0] if inside else None


def test_innermost_owner_equals_brute_force(spark):
    rng = random.Random(7)
    symbols, n = [], 0
    for path in ("a.py", "b.py"):
        for _ in range(150):
            start = rng.choice([rng.randint(0, 200), rng.randint(1, 20_000)])
            length = rng.choice([0, 3, 60, 64, 500, 4096, 9000, -2])
            symbols.append((f"s{n}", f"f{n}", "function", path, start, start + length, n))
            n += 1
    # Edges of blocks, equal ranges, and a range without a sensible end.
    for start, end in ((0, 63), (64, 127), (64, 127), (63, 64), (4096, 8191), (4095, 8192), (1, 300_000)):
        symbols.append((f"s{n}", f"f{n}", "class", "c.py", start, end, n))
        n += 1
    refs = [(p, line) for p in ("a.py", "b.py", "none.py") for line in rng.sample(range(0, 30_000), 300)]
    refs += [("c.py", line) for line in (0, 1, 62, 63, 64, 65, 127, 128, 4094, 4095, 4096, 8191, 8192, 8193, 300_001)]
    refs += refs[:20]
    got = ref_owner(
        spark.createDataFrame(refs, "file_path string, line int"), spark.createDataFrame(symbols, SYMBOLS)
    ).collect()
    assert len(got) == len(refs)
    for row in got:
        assert row["owner_id"] == innermost(symbols, row["file_path"], row["line"]), row


def test_ties_go_to_the_earliest_symbol(spark):
    symbols = [("z", "z", "f", "a.py", 1, 9, 0), ("a", "a", "f", "a.py", 1, 9, 1), ("b", "b", "f", "a.py", 2, 10, 2)]
    refs = spark.createDataFrame([("a.py", 5)], "file_path string, line int")
    df = spark.createDataFrame(symbols, SYMBOLS)
    assert ref_owner(refs, df).first()["owner_id"] == "z"
    assert ref_owner(refs, df.drop("ordinal")).first()["owner_id"] == "a"


# The stock of a medical depot. The lines matter, so they are written out.
SCANS = [
    "import json",
    "",
    "def receive(spark, box):",
    '    rows = spark.read.option("multiLine", True).json(box)',
    '    rows.write.insertInto("depot.inbox.scan")',
]
SHELVES = [
    'AREA = "depot.shelf"',
    'STOCK = f"{AREA}.stock"',
    "KEEP_DAYS = 400",
    "class Shelves:",
    "    def fill(self, spark):",
    '        seen = spark.table("depot.inbox.scan")',
    '        seen.select("sku", "batch", "expires").write.saveAsTable(STOCK)',
    "    def recall(self, spark, reason):",
    '        spark.sql("INSERT INTO depot.shelf.recalled "',
    '                  "SELECT sku, batch FROM depot.shelf.stock JOIN depot.ref.maker USING (sku)")',
    "        spark.table(reason)",
]
EXPIRY = [
    "def soon(spark, days):",
    '    stock = spark.read.table("depot.shelf.stock")',
    '    stock.where(stock.expires < days).write.saveAsTable("depot.mart.expiring")',
    "",
    "def wanted(spark):",
    '    spark.sql("""',
    "        CREATE TABLE IF NOT EXISTS depot.mart.reorder AS",
    "        WITH gone AS (SELECT sku FROM depot.shelf.recalled)",
    '        SELECT sku, batch FROM depot.shelf.stock ANTI JOIN gone USING (sku)""")',
]
BOARD = [
    "CREATE VIEW depot.mart.board AS",
    "SELECT e.sku",
    "FROM depot.mart.expiring e",
    "JOIN depot.mart.reorder r",
    "  ON e.sku = r.sku;",
]
SOURCES = [
    ("etl/scans.py", "\n".join(SCANS)),
    ("etl/shelves.py", "\n".join(SHELVES)),
    ("marts/expiry.py", "\n".join(EXPIRY)),
    ("views/board.sql", "\n".join(BOARD)),
    ("views/returns.sql", "SELECT count(*)\nFROM depot.shelf.recalled"),
    ("notes.md", "spark.table('depot.none.t')"),
]
FUNCTIONS = [
    ("etl/scans.py", "receive", 3, 5),
    ("etl/shelves.py", "Shelves", 4, 11),
    ("etl/shelves.py", "fill", 5, 7),
    ("etl/shelves.py", "recall", 8, 11),
    ("marts/expiry.py", "soon", 1, 3),
    ("marts/expiry.py", "wanted", 5, 9),
    ("views/board.sql", "board", 1, 5),
]
R, W = "READS_TABLE", "WRITES_TABLE"
EDGES = [
    ("etl/scans.py", 5, "receive", W, "depot.inbox.scan", "literal"),
    ("etl/shelves.py", 6, "fill", R, "depot.inbox.scan", "literal"),
    ("etl/shelves.py", 7, "fill", W, "depot.shelf.stock", "inferred"),
    ("etl/shelves.py", 9, "recall", R, "depot.shelf.stock", "literal"),
    ("etl/shelves.py", 9, "recall", R, "depot.ref.maker", "literal"),
    ("etl/shelves.py", 9, "recall", W, "depot.shelf.recalled", "literal"),
    ("marts/expiry.py", 2, "soon", R, "depot.shelf.stock", "literal"),
    ("marts/expiry.py", 3, "soon", W, "depot.mart.expiring", "literal"),
    ("marts/expiry.py", 6, "wanted", R, "depot.shelf.recalled", "literal"),
    ("marts/expiry.py", 6, "wanted", R, "depot.shelf.stock", "literal"),
    ("marts/expiry.py", 6, "wanted", W, "depot.mart.reorder", "literal"),
    ("views/board.sql", 1, "board", W, "depot.mart.board", "literal"),
    ("views/board.sql", 3, "board", R, "depot.mart.expiring", "literal"),
    ("views/board.sql", 4, "board", R, "depot.mart.reorder", "literal"),
    ("views/returns.sql", 2, None, R, "depot.shelf.recalled", "literal"),
]


def project(spark, replace=None):
    """Edges and sources of the depot, optionally with one text replaced."""
    files = [(p, (replace or {}).get(p, t)) for p, t in SOURCES]
    sources = spark.createDataFrame(files, "file_path string, text string")
    symbols = spark.createDataFrame(
        [(f"{p}::{n}", n, "function", p, a, b, i) for i, (p, n, a, b) in enumerate(FUNCTIONS)], SYMBOLS
    )
    return build_edges(sources, symbols, "repo"), sources


def test_whole_overlay(spark):
    edges, _ = project(spark)
    got = sorted(
        (r["file_path"], r["line"], r["owner_name"] or "", r["type"], r["table_name"], r["resolution"])
        for r in edges.collect()
    )
    assert got == sorted((p, line, o or "", *rest) for p, line, o, *rest in EDGES)
    origin = {r["file_path"]: r["from_id"] for r in edges.where("owner_id is null").collect()}
    assert origin == {"views/returns.sql": "repo:file:views/returns.sql"}


def test_graph_and_radius_of_the_depot(spark, rows):
    edges, _ = project(spark)
    graph = table_graph(edges)
    stock, recalled, maker = "depot.shelf.stock", "depot.shelf.recalled", "depot.ref.maker"
    expiring, reorder, board = (f"depot.mart.{t}" for t in ("expiring", "reorder", "board"))
    assert rows(graph) == sorted(
        [("depot.inbox.scan", stock), (stock, recalled), (maker, recalled), (stock, expiring)]
        + [(recalled, reorder), (stock, reorder), (expiring, board), (reorder, board)]
    )
    starts = spark.createDataFrame([(stock,), (maker,)], "t string")
    for hops in ((graph,), links(edges)):
        found = blast_radius(starts, *hops, ordered=True).orderBy("start_table", "bfs_rank").collect()
        order = {}
        for r in found:
            order.setdefault(r["start_table"], []).append(r["table_name"])
        assert order == {stock: [expiring, reorder, recalled, board], maker: [recalled, reorder, board]}


def test_relation_records(spark, tmp_path):
    from lakeimpact.sources.records import write_relations

    edges, _ = project(spark)
    write_relations(relation_records(edges.where("resolution = 'inferred'"), "repo"), str(tmp_path / "out"))
    (record,) = spark.read.json(str(tmp_path / "out")).collect()
    assert record.asDict(recursive=True) == {
        "record_type": "relation",
        "type": W,
        "from_id": "etl/shelves.py::fill",
        "to_id": "repo:Table:depot.shelf.stock",
        "to_kind": "table",
        "resolution": "inferred",
        "evidence": {"file_path": "etl/shelves.py", "line": 7},
    }


def test_tasks_read_small_parts_of_an_exchange(spark):
    """A task makes wide rows from what it reads, so its part must not grow with the input while there are partitions left."""
    apply_settings(spark)
    partitions = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "64")
    try:
        dealt = spark.range(8_000_000).select(F.xxhash64("id").alias("key")).repartition("key")
        assert dealt.groupBy(F.spark_partition_id()).count().count() >= 9
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", partitions)


def test_references_are_read_once_and_not_multiplied(spark):
    """A reference meets one row per size of blocks, however many symbols enclose it."""
    symbols = spark.createDataFrame(
        [(f"s{i}", f"n{i}", "a.py", 1, 9000 + i) for i in range(5)] + [("in", "in", "a.py", 4000, 4200)],
        "id string, name string, file_path string, start_line int, end_line int",
    )
    lines = spark.range(10_000).selectExpr("'a.py' AS file_path", "CAST(id AS int) AS line", "id % 3 AS other")
    found = ref_owner(lines, symbols)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Range (") == 1 and "Generate" not in plan
    owners = {r["line"]: r["owner_id"] for r in found.collect()}
    assert owners == {
        n: None if n == 0 or n > 9004 else "in" if 4000 <= n <= 4200 else f"s{max(0, n - 9000)}" for n in range(10_000)
    }
