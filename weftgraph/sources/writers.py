"""Writers of labels, adjacency and reports as text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.convert import adjacency, partitioned_adjacency

#: Delimiters of ``id<delimiter>part``.
LABEL_DELIMITERS = {"comma": ",", "joined": "_", "tab": "\t"}


def write_labels(labels: DataFrame, path: str, delimiter: str = ",", blank_unassigned: bool = False) -> None:
    """``id,part`` a line; unassigned vertices are left out, or give an empty line."""
    line = F.concat_ws(delimiter, F.col("id"), F.col("part"))
    rows = labels.select(F.when(F.col("part").isNull(), "").otherwise(line).alias("value"))
    (rows if blank_unassigned else rows.filter("value <> ''")).write.text(path)


def write_columns(df: DataFrame, path: str, columns: list[str], delimiter: str = "\t") -> None:
    """``id<tab>part<tab>value`` and the like, nulls empty."""
    df.select(F.array_join(F.array(*[F.col(c).cast("string") for c in columns]), delimiter, "").alias("value")).write.text(path)


def write_partitioned_adjacency(sym: DataFrame, labels: DataFrame, path: str, real_only: bool = False, plain_neighbours: bool = False) -> None:
    partitioned_adjacency(sym, labels, real_only, plain_neighbours).select(F.col("line").alias("value")).write.text(path)


def write_adjacency(edges: DataFrame, path: str, blank_sinks: bool = True, header: bool = False) -> None:
    """``id<tab>n1<tab>n2...``; a vertex without out-edges gives a blank line or none. header puts ``n m`` into its own file."""
    rows = adjacency(edges)
    if header:
        n, m = rows.count(), edges.count()
        edges.sparkSession.createDataFrame([(f"{n} {m}",)], "value string").write.mode("append").text(path)
    line = F.when(F.col("neighbours") == "", "").otherwise(F.concat_ws("\t", "id", "neighbours"))
    rows = rows.select(line.alias("value"))
    (rows if blank_sinks else rows.filter("value <> ''")).write.mode("append").text(path)


def write_adjacency_no_values(edges: DataFrame, path: str, delimiter: str = "\t") -> None:
    """``id``, the delimiter twice, then the neighbours with one between; an id alone has both delimiters too."""
    rows = adjacency(edges, delimiter)
    rows.select(F.concat(F.col("id").cast("string"), F.lit(delimiter * 2), "neighbours").alias("value")).write.text(path)


def write_nothing(df: DataFrame) -> None:
    """Run the job and keep no output."""
    df.write.format("noop").mode("overwrite").save()


def write_report(report: DataFrame, path: str) -> None:
    """``KEY,value`` lines in one file, in order; a report is a few dozen rows."""
    report.orderBy("line").coalesce(1).select(F.concat_ws(",", F.when(F.col("metric") != "", F.col("metric")), "value").alias("value")).write.text(path)


def write_degree_distribution(distribution: DataFrame, path: str) -> None:
    write_columns(distribution, path, ["degree", "n"], ",")


#: Columns of a run summary after its mode, and the report keys they come from.
SUMMARY = {
    "job_id": "JOB ID", "workers": "WORKERS", "file": "GRAPH", "algorithm": "ALGORITHM", "tau": "TAU", "sigma": "SIGMA", "beta": "BETA", "partitions": "PARITIONS", "vertices": "VERTICES", "real_edges": "REAL EDGES", "virtual_edges": "VIRTUAL EDGES",
    "total_time": "TOTAL TIME", "sampling_time": "Sampling time", "lp_time": "LP time", "score": "REAL SCORE", "migrations": "TOT MIGRATIONS", "real_max_norm": "REAL E MAXNORMLOAD", "virtual_max_norm": "VIRTUAL E MAXNORM LOAD",
    "vertex_max_norm": "REAL V MAXNORMLOAD", "real_cut": "REAL EC", "real_cut_share": "REAL EC PCT", "virtual_cut": "VIRTUAL EC", "virtual_cut_share": "VIRTUAL EC PCT", "vertex_jsd": "REAL VB JSD", "real_jsd": "REAL EB JSD", "virtual_jsd": "VIRTUAL ED JSD",
}


def collate_reports(spark: SparkSession, path: str, mode: str = "") -> DataFrame:
    """mode and a column for each summary field, one row a report file under path; degree distributions (GDD in the name) and other files are left out."""
    lines = spark.read.text(path, recursiveFileLookup=True).select(F.input_file_name().alias("name"), "value").filter("value LIKE '%,%' AND name NOT LIKE '%GDD%'")
    pairs = lines.select("name", F.substring_index("value", ",", 1).alias("key"), F.regexp_extract("value", "^[^,]*,(.*)$", 1).alias("v"))
    rows = pairs.groupBy("name").agg(*[F.max(F.when(F.col("key") == k, F.col("v"))).alias(c) for c, k in SUMMARY.items()])
    return rows.filter("partitions IS NOT NULL").select(F.lit(mode).alias("mode"), *SUMMARY)


#: Fields of a timing row; what this engine has no counter for stays empty.
TIMING = (
    "JOB ID", "DATE", "JOB NAME", "VERTICES", "VIRTUAL EDGES", "REAL EDGES", "EDGE RATIO", "WORKERS", "PARITIONS", "LP CYCLES", "Initializing algorithm time", "FIRST LP TIME", "LP time", "INPUT TIME (not included in total)", "Avg. LP cycle time",
    "TOT MIGRATIONS", "TOTAL MESSAGES", "VIRTUAL MEMORY BYTES", "PHYSICAL MEMORY BYTES", "COMMITTED HEAP BYTES", "MAP INPUT BYTES", "CPU MILLISECONDS", "OUT DEGREE THRESHOLD",
)


def timing_row(facts: dict) -> str:
    """The run's 23 facts as one line, fields separated by semicolons."""
    if facts.get("REAL EDGES"):
        facts = {"EDGE RATIO": f"{facts.get('VIRTUAL EDGES', 0) / facts['REAL EDGES']:.3f}"} | facts
    return ";".join(str(facts.get(k, "")) for k in TIMING)
