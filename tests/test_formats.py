"""Text formats: reading, writing and reading again."""

import pytest

from weftgraph.graph import symmetrize
from weftgraph.operators import convert
from weftgraph.partition import loop, quality
from weftgraph.partition import propagation as lp
from weftgraph.sources import readers, writers


def put(path, text):
    path.mkdir()
    (path / "a.txt").write_text(text)
    return str(path)


def lines(path):
    return sorted(x for f in path.glob("part-*") for x in f.read_text().splitlines())


def test_adjacency_formats(spark, tmp_path):
    p = put(tmp_path / "in", "1 2 3\n2\t3\n4\n\n5_1 6_0 7\n")
    for name, options in readers.ADJACENCY.items():
        v, e = readers.read_adjacency(spark, p, **options)
        assert sorted(r.id for r in v.collect()) == [1, 2, 4, 5], name
        assert sorted((r.src, r.dst) for r in e.collect()) == [(1, 2), (1, 3), (2, 3), (5, 6), (5, 7)]
    v, e = readers.read_adjacency(spark, p, **readers.ADJACENCY["labelled"])
    assert {(r.src_part, r.dst, r.dst_part, r.value) for r in e.filter("src = 5").collect()} == {(1, 6, 0, 1.0), (1, 7, None, 1.0)}
    assert {r.id: r.part for r in v.collect()} == {1: None, 2: None, 4: None, 5: 1}
    assert dict(readers.read_adjacency(spark, p, **readers.ADJACENCY["labelled_array"])[0].dtypes)["value"] == "array<bigint>"
    assert {r.weight for r in readers.read_adjacency(spark, p, **readers.ADJACENCY["partition"])[1].collect()} == {2}


def test_edge_lists(spark, tmp_path):
    p = put(tmp_path / "in", "1\t2\n2\t3\t4\n")
    read = lambda name: readers.read_edge_list(spark, p, **readers.EDGE_LISTS[name])
    assert {(r.src, r.dst, r.value) for r in read("weight").collect()} == {(1, 2, 1), (2, 3, 4)}
    assert {(r.src, r.dst, r.value) for r in read("double_default").collect()} == {(1, 2, 0.0), (2, 3, 4.0)}
    with pytest.raises(Exception, match="no value"):
        read("double").collect()
    assert read("zeros_reverse").count() == 4 and read("null_reverse").columns == ["src", "dst"]
    names = put(tmp_path / "names", "a\tb\nb\tc\n")
    e, dictionary = readers.densify(readers.read_edge_list(spark, names, **readers.EDGE_LISTS["text"]))
    by = {r.name: r.id for r in dictionary.collect()}
    assert {(r.src, r.dst) for r in e.collect()} == {(by["a"], by["b"]), (by["b"], by["c"])}


def test_vertex_values(spark, tmp_path):
    p = put(tmp_path / "in", "1\t2\n3\u00014\n5_6\n7\n")
    assert {(r.id, r.part) for r in readers.read_vertex_values(spark, p).collect()} == {(1, 2), (3, 4), (5, 6), (7, None)}


def test_generators(spark):
    v, e = readers.ring(spark, 4)
    assert [(r.id, r.value) for r in v.orderBy("id").collect()] == [(0, 0.0), (1, 10.0), (2, 20.0), (3, 30.0)]
    assert [(r.src, r.dst, r.value) for r in e.orderBy("src").collect()][-1] == (3, 0, 300.0)
    assert [r.id for r in readers.generated_vertices(spark, 3, reverse=True).collect()] == [2, 1, 0]
    assert readers.generated_edges(spark, 3).count() == 3


def test_labels_round_trip(spark, tmp_path):
    labels = spark.createDataFrame([(1, 0), (2, 1), (3, None)], "id long, part int")
    writers.write_labels(labels, str(tmp_path / "comma"))
    assert lines(tmp_path / "comma") == ["1,0", "2,1"]
    writers.write_labels(labels, str(tmp_path / "blank"), blank_unassigned=True)
    assert lines(tmp_path / "blank") == ["", "1,0", "2,1"]
    writers.write_labels(labels, str(tmp_path / "joined"), writers.LABEL_DELIMITERS["joined"])
    assert {(r.id, r.part) for r in readers.read_vertex_values(spark, str(tmp_path / "joined")).collect()} == {(1, 0), (2, 1)}
    writers.write_columns(labels, str(tmp_path / "columns"), ["id", "part"])
    assert lines(tmp_path / "columns") == ["1\t0", "2\t1", "3\t"]


def test_adjacency_round_trip(spark, tmp_path):
    e = spark.createDataFrame([(1, 2), (1, 3), (3, 1)], "src long, dst long")
    writers.write_adjacency(e, str(tmp_path / "adj"))
    assert lines(tmp_path / "adj") == ["", "1\t2\t3", "3\t1"]
    _, back = readers.read_adjacency(spark, str(tmp_path / "adj"))
    assert {(r.src, r.dst) for r in back.collect()} == {(1, 2), (1, 3), (3, 1)}
    writers.write_adjacency(e, str(tmp_path / "metis"), blank_sinks=False, header=True)
    assert lines(tmp_path / "metis") == ["1\t2\t3", "3\t1", "3 3"]
    labels = spark.createDataFrame([(1, 0), (2, 1), (3, 0)], "id long, part int")
    writers.write_partitioned_adjacency(symmetrize(e), labels, str(tmp_path / "part"))
    assert lines(tmp_path / "part") == ["1_0\t2_1\t3_0", "2_1\t1_0", "3_0\t1_0"]
    writers.write_nothing(e)


def test_placement(spark):
    ids = spark.range(10)
    put_ = convert.placed(convert.place_by_hash(ids, 4, 2), 4)
    from pyspark.sql import functions as F

    assert all(r.part == r.p for r in put_.select("part", F.spark_partition_id().alias("p")).collect())


def test_reports(spark, tmp_path):
    e = spark.createDataFrame([(a, b) for a in range(6) for b in range(6) if a != b], "src long, dst long")
    r = loop.partition(e, lp.Objective("edge", 2), "uniform", limit=3)
    report = quality.report(r.sym, r.labels, 2, r.facts)
    for i in range(2):
        writers.write_report(report, str(tmp_path / "runs" / str(i)))
    rows = writers.collate_reports(spark, str(tmp_path / "runs")).collect()
    assert len(rows) == 2 and {x.real_edges for x in rows} == {"30"} and {x.algorithm for x in rows} == {"uniform"}
    assert len(rows[0]) == 27 and writers.timing_row(r.facts).count(";") == 22
    told = report.collect()
    assert [x.line for x in told] == list(range(87)) and [x.line for x in told if not x.metric] == [17, 57, 66, 72]
    kept = {x.metric: x.value for x in told}
    assert int(kept["TOTAL MESSAGES"]) == sum(int(kept[m]) for m in ("INITIAL MESSAGES", "SAMPLING MESSAGES", "LP MESSAGES", "SHUTDOWN MESSAGES"))
