"""Readers and writers as queries: a graph of the test tables is written as text, read again, and compared in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import fixtures
from .graph import symmetrize, vertices
from .operators import convert
from .operators import degrees as deg
from .oracles import DEG, FLOW, K, SYM, VERTS
from .partition import loop, quality
from .partition import propagation as lp
from .plans.bsp import cut, new_path
from .sources import readers, writers

QUERIES: dict = {}
SQL: dict[str, str] = {}
#: Labels of the flow graph, and its lines as ``id_part`` with plain or labelled neighbours.
LABELS = f"l AS (SELECT id, (id % {K})::INT AS part FROM v)"
WRITTEN = "WITH " + ", ".join((FLOW, VERTS, LABELS))


def query(name: str, sql: str):
    def register(f):
        f.__name__ = name
        QUERIES[name], SQL[name] = f, sql
        return f

    return register


def flow(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Directed edges and the labels id mod K of their ends."""
    e = cut(fixtures.user_flow(spark, sf_dir), "f-flow")
    return e, fixtures.labels_mod(vertices(e), K)


def put(spark: SparkSession, lines: DataFrame) -> str:
    """The folder of a new text table of lines(value)."""
    path = new_path(spark, "text")
    lines.write.text(path)
    return path


def text(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).select(F.col("value").alias("line"))


# Sources: adjacency lists.

VALUES = {"partition": (-1, 2, False), "partition_default": (-1, 1, True), "double_double": (1, 1, False), "double_float": (1, 1, False), "double_null": (-1, 1, False), "long_double": (1, 1, False), "labelled": (1, 1, False), "labelled_array": (1, 1, False), "labelled_head": (1, 1, False), "quality": (-1, 2, False)}


def _read_adjacency(name: str):
    def run(s, d):
        e, labels = flow(s, d)
        if name in ("labelled", "labelled_array"):
            sym = e.withColumn("is_virtual", F.lit(False))
            lines = convert.partitioned_adjacency(sym, labels).select(F.col("line").alias("value"))
        elif name in ("labelled_head", "quality"):
            lines = convert.partitioned_adjacency(e.withColumn("is_virtual", F.lit(False)), labels, plain_neighbours=True).select(F.col("line").alias("value"))
        else:
            lines = convert.adjacency(e, " ").filter("neighbours <> ''").select(F.concat_ws(" ", "id", "neighbours").alias("value"))
        _, back = readers.read_adjacency(s, put(s, lines), **readers.ADJACENCY[name])
        return back.select("src", F.coalesce("src_part", F.lit(-1)).alias("src_part"), "dst", F.coalesce("dst_part", F.lit(-1)).alias("dst_part"), F.col("weight").cast("int").alias("weight"), F.coalesce(F.col("value").cast("double"), F.lit(-1.0)).alias("value"), "is_virtual")

    return run


for _name, (_value, _weight, _virtual) in VALUES.items():
    _head = f"(src % {K})::INT" if _name.startswith("labelled") or _name == "quality" else "-1"
    _tail = f"(dst % {K})::INT" if _name in ("labelled", "labelled_array") else "-1"
    query(f"source_adjacency_{_name}", f"WITH {FLOW} SELECT src, {_head} AS src_part, dst, {_tail} AS dst_part, {_weight} AS weight, {_value}::DOUBLE AS value, {str(_virtual).lower()} AS is_virtual FROM e")(_read_adjacency(_name))


@query("source_adjacency_vertices", f"WITH {FLOW}, {VERTS} SELECT id, (id % {K})::INT AS part, 0.0::DOUBLE AS value FROM v")
def source_adjacency_vertices(s, d):
    e, labels = flow(s, d)
    lines = convert.partitioned_adjacency(e.withColumn("is_virtual", F.lit(False)), labels).select(F.col("line").alias("value"))
    return readers.read_adjacency(s, put(s, lines), **readers.ADJACENCY["labelled"])[0]


# Sources: vertices with and without labels.


def _read_vertices(line):
    def run(s, d):
        _, labels = flow(s, d)
        return readers.read_vertex_values(s, put(s, labels.select(line().alias("value")))).select("id", F.coalesce("part", F.lit(-1)).alias("part"))

    return run


for _name, _line, _part in (
    ("ids", lambda: F.col("id").cast("string"), "-1"), ("joined", lambda: F.concat_ws("_", "id", "part"), f"(id % {K})::INT"), ("tab", lambda: F.concat_ws("\t", "id", "part"), f"(id % {K})::INT"),
    ("blank", lambda: F.concat_ws(" ", "id", "part"), f"(id % {K})::INT"), ("control", lambda: F.concat_ws("\u0001", "id", "part"), f"(id % {K})::INT"),
):
    query(f"source_vertices_{_name}", f"WITH {FLOW}, {VERTS} SELECT id, {_part} AS part FROM v")(_read_vertices(_line))


# Sources: edge lists. Every second edge has a third field; where it is required all have one.

THIRD = "(1 + (src * 31 + dst) % 10)"
EDGE_SQL = {
    "weight": f"SELECT src, dst, CASE WHEN src % 2 = 0 THEN {THIRD} ELSE 1 END::INT AS value FROM e", "double_default": f"SELECT src, dst, CASE WHEN src % 2 = 0 THEN {THIRD} ELSE 0 END::DOUBLE AS value FROM e", "double": f"SELECT src, dst, {THIRD}::DOUBLE AS value FROM e",
    "zeros": "SELECT src, dst, 0.0::DOUBLE AS value FROM e", "zeros_reverse": "SELECT src, dst, 0.0::DOUBLE AS value FROM e UNION ALL SELECT dst, src, 0.0::DOUBLE FROM e", "null": "SELECT src, dst FROM e", "null_reverse": "SELECT src, dst FROM e UNION ALL SELECT dst, src FROM e",
}


def _read_edges(name: str):
    def run(s, d):
        e, _ = flow(s, d)
        third = (1 + (F.col("src") * 31 + F.col("dst")) % 10).cast("string")
        if name != "double":
            third = F.when(F.col("src") % 2 == 0, third)
        lines = e.select(F.concat_ws("\t" if "null" in name else "\u0001", "src", "dst", *([third] if name in ("weight", "double_default", "double") else [])).alias("value"))
        back = readers.read_edge_list(s, put(s, lines), **readers.EDGE_LISTS[name])
        return back.withColumn("value", F.col("value").cast("int")) if name == "weight" else back

    return run


for _name, _sql in EDGE_SQL.items():
    query(f"source_edges_{_name}", f"WITH {FLOW} {_sql}")(_read_edges(_name))


@query("source_edges_text", f"WITH {FLOW} SELECT 'u' || src AS src, 'u' || dst AS dst FROM e")
def source_edges_text(s, d):
    """Names become numbers, which the dictionary takes back."""
    e, _ = flow(s, d)
    lines = e.select(F.concat(F.lit("u"), "src", F.lit("\tu"), "dst").alias("value"))
    numbered, names = readers.densify(readers.read_edge_list(s, put(s, lines), **readers.EDGE_LISTS["text"]))
    one, two = names.select(F.col("id").alias("src"), F.col("name").alias("s")), names.select(F.col("id").alias("dst"), F.col("name").alias("t"))
    return numbered.join(one, "src").join(two, "dst").select(F.col("s").alias("src"), F.col("t").alias("dst"))


@query("source_generated_vertices", "SELECT 499 - i AS id FROM range(500) r(i)")
def source_generated_vertices(s, d):
    return readers.generated_vertices(s, 500, reverse=True)


@query("source_generated_edges", "SELECT i AS src, i + 1 AS dst FROM range(500) r(i)")
def source_generated_edges(s, d):
    return readers.generated_edges(s, 500)


# Sinks: every line that is written.


def _labels_out(delimiter: str):
    def run(s, d):
        _, labels = flow(s, d)
        path = new_path(s, "text")
        writers.write_labels(labels.withColumn("part", F.expr("nullif(part, 3)")), path, delimiter, blank_unassigned=delimiter == ",")
        return text(s, path)

    return run


for _name, _sep in writers.LABEL_DELIMITERS.items():
    _text = f"id || {'chr(9)' if _sep == chr(9) else repr(_sep)} || part"
    query(f"sink_labels_{_name}", f"{WRITTEN} SELECT CASE WHEN part = 3 THEN '' ELSE {_text} END AS line FROM l" if _sep == "," else f"{WRITTEN} SELECT {_text} AS line FROM l WHERE part <> 3")(_labels_out(_sep))


@query("sink_label_values", f"{WRITTEN} SELECT id || chr(9) || part || chr(9) || count(e.dst) AS line FROM l LEFT JOIN e ON e.src = id GROUP BY id, part")
def sink_label_values(s, d):
    e, labels = flow(s, d)
    path = new_path(s, "text")
    writers.write_columns(labels.join(deg.out_degree(e), "id"), path, ["id", "part", "out_degree"])
    return text(s, path)


@query("sink_label_degrees", f"WITH {FLOW}, {SYM}, {DEG} SELECT id || chr(9) || id % {K} || chr(9) || out_deg || chr(9) || in_deg AS line FROM g")
def sink_label_degrees(s, d):
    e, labels = flow(s, d)
    path = new_path(s, "text")
    writers.write_columns(labels.join(deg.out_degree(e), "id").join(deg.in_degree(e), "id"), path, ["id", "part", "out_degree", "in_degree"])
    return text(s, path)


@query("sink_values", f"WITH {FLOW}, {VERTS} SELECT id || chr(9) || count(e.src) AS line FROM v LEFT JOIN e ON e.dst = id GROUP BY id")
def sink_values(s, d):
    e, _ = flow(s, d)
    path = new_path(s, "text")
    writers.write_columns(deg.in_degree(e), path, ["id", "in_degree"])
    return text(s, path)


@query("sink_adjacency_partitioned", f"WITH {FLOW}, {SYM} SELECT src || '_' || src % {K} || chr(9) || string_agg(dst || '_' || dst % {K}, chr(9) ORDER BY dst) AS line FROM s GROUP BY src")
def sink_adjacency_partitioned(s, d):
    e, labels = flow(s, d)
    path = new_path(s, "text")
    writers.write_partitioned_adjacency(symmetrize(e), labels, path)
    return text(s, path)


@query("sink_adjacency_real", f"WITH {FLOW}, {VERTS} SELECT id || '_' || id % {K} || chr(9) || coalesce(string_agg(dst::VARCHAR, chr(9) ORDER BY dst), '') AS line FROM v LEFT JOIN e ON e.src = v.id GROUP BY id")
def sink_adjacency_real(s, d):
    e, labels = flow(s, d)
    path = new_path(s, "text")
    writers.write_partitioned_adjacency(symmetrize(e), labels, path, real_only=True, plain_neighbours=True)
    return text(s, path)


ADJACENT = "string_agg(dst::VARCHAR, chr(9) ORDER BY dst)"


@query("sink_adjacency", f"WITH {FLOW}, {VERTS} SELECT CASE WHEN count(e.dst) = 0 THEN '' ELSE id || chr(9) || {ADJACENT} END AS line FROM v LEFT JOIN e ON e.src = v.id AND e.dst % 3 = 0 GROUP BY id")
def sink_adjacency(s, d):
    """Edges to every third vertex, from a graph of all vertices: ids without such an edge give a blank line."""
    e, _ = flow(s, d)
    path = new_path(s, "text")
    some = e.filter("dst % 3 = 0")
    writers.write_adjacency(some, path)
    blank = vertices(e).join(vertices(some), "id", "left_anti").select(F.lit("").alias("line"))
    return text(s, path).union(blank)


@query("sink_metis", f"WITH {FLOW}, {VERTS} SELECT id || chr(9) || {ADJACENT} AS line FROM v JOIN e ON e.src = v.id GROUP BY id UNION ALL SELECT (SELECT count(*) FROM v) || ' ' || (SELECT count(*) FROM e)")
def sink_metis(s, d):
    e, _ = flow(s, d)
    path = new_path(s, "text")
    writers.write_adjacency(e, path, blank_sinks=False, header=True)
    return text(s, path)


@query("sink_adjacency_no_values", f"WITH {FLOW}, {VERTS} SELECT id || ';;' || coalesce(string_agg(dst::VARCHAR, ';' ORDER BY dst), '') AS line FROM v LEFT JOIN e ON e.src = v.id GROUP BY id")
def sink_adjacency_no_values(s, d):
    e, _ = flow(s, d)
    path = new_path(s, "text")
    writers.write_adjacency_no_values(e, path, ";")
    return text(s, path)


@query("sink_degree_distribution", f"WITH {FLOW}, {SYM}, {DEG} SELECT deg || ',' || count(*) AS line FROM g GROUP BY deg")
def sink_degree_distribution(s, d):
    e, _ = flow(s, d)
    path = new_path(s, "text")
    writers.write_degree_distribution(deg.degree_distribution(e), path)
    return text(s, path)


@query("sink_nothing", "SELECT 0::BIGINT AS n_lines")
def sink_nothing(s, d):
    """The job runs and leaves no line."""
    e, _ = flow(s, d)
    writers.write_nothing(e)
    return s.createDataFrame([(0,)], "n_lines long")


def _report(s, d) -> str:
    """The folder of a report file of the flow graph under its labels."""
    e, labels = flow(s, d)
    path = new_path(s, "text")
    writers.write_report(quality.report(cut(symmetrize(e), "f-sym"), labels, K, {"ALGORITHM": "given", "GRAPH": "flow", "TAU": 3, "WORKERS": 8, "LP time": 12}), path)
    return path


@query("sink_report_blocks", f"""WITH {FLOW}, {VERTS}, {SYM}, c AS (SELECT (SELECT count(*) FROM v) AS v, (SELECT count(*) FROM e) AS e, (SELECT count(*) FROM s) AS s)
    SELECT unnest(['ALGORITHM,given', 'GRAPH,flow', 'VERTICES,' || v, 'REAL EDGES,' || e, 'VIRTUAL EDGES,' || s, 'PARITIONS,{K}', 'blank 4', 'lines 87']) AS line FROM c""")  # fmt: skip
def sink_report_blocks(s, d):
    lines = cut(text(s, _report(s, d)), "f-lines")
    counts = lines.agg(F.sum(F.when(F.col("line") == "", 1).otherwise(0)).alias("b"), F.count(F.lit(1)).alias("n"))
    told = counts.select(F.explode(F.array(F.concat(F.lit("blank "), "b"), F.concat(F.lit("lines "), "n"))).alias("line"))
    return lines.filter("line RLIKE '^(ALGORITHM|GRAPH|VERTICES|REAL EDGES|VIRTUAL EDGES|PARITIONS),'").union(told)


@query("sink_collator", f"""WITH {FLOW}, {VERTS}, {SYM}, c AS (SELECT count(*) AS real, count(*) FILTER (src % {K} <> dst % {K}) AS cut FROM e), y AS (SELECT count(*) AS n, count(*) FILTER (src % {K} <> dst % {K}) AS cut FROM s)
    SELECT 'test' AS mode, '8' AS workers, 'flow' AS file, 'given' AS algorithm, '3' AS tau, '{K}' AS partitions, (SELECT count(*) FROM v)::VARCHAR AS vertices, real::VARCHAR AS real_edges, n::VARCHAR AS virtual_edges, c.cut::VARCHAR AS real_cut, y.cut::VARCHAR AS virtual_cut, '12' AS lp_time FROM c, y""")  # fmt: skip
def sink_collator(s, d):
    return writers.collate_reports(s, _report(s, d), "test").select("mode", "workers", "file", "algorithm", "tau", "partitions", "vertices", "real_edges", "virtual_edges", "real_cut", "virtual_cut", "lp_time")


@query("sink_timing", f"WITH {FLOW}, {VERTS}, {SYM} SELECT 23 AS fields, (SELECT count(*) FROM v)::VARCHAR AS vertices, (SELECT count(*) FROM s)::VARCHAR AS virtual_edges, (SELECT count(*) FROM e)::VARCHAR AS real_edges, printf('%.3f', (SELECT count(*) FROM s)::DOUBLE / (SELECT count(*) FROM e)) AS ratio, '2' AS partitions")
def sink_timing(s, d):
    e, _ = flow(s, d)
    row = writers.timing_row(loop.partition(e, lp.Objective("edge", 2), "uniform", limit=1).facts).split(";")
    return s.createDataFrame([(len(row), row[3], row[4], row[5], row[6], row[8])], "fields int, vertices string, virtual_edges string, real_edges string, ratio string, partitions string")
