"""The command line: algorithms, runs, sweeps, collation."""

import pytest

from weftgraph.__main__ import main
from weftgraph.registry import ALGORITHMS, algorithm


@pytest.fixture(scope="module")
def edges(tmp_path_factory):
    path = tmp_path_factory.mktemp("edges") / "e.txt"
    path.write_text("".join(f"{a + s}\t{b + s}\n" for s in (0, 100) for a in range(8) for b in range(8) if a != b) + "0\t100\n")
    return str(path)


def lines(path):
    return sorted(x for f in path.glob("part-*") for x in f.read_text().splitlines())


def test_run(spark, edges, tmp_path):
    main(["run", "components", edges, str(tmp_path / "cc")], spark)
    assert lines(tmp_path / "cc") == sorted(f"{a + s}\t0" for s in (0, 100) for a in range(8))
    with pytest.raises(SystemExit):
        main(["run", "nothing", edges, str(tmp_path / "x")], spark)


def test_partition_sweep_and_collate(spark, edges, tmp_path):
    main(["partition", edges, str(tmp_path / "one"), "-k", "2", "--init", "uniform"], spark)
    assert len(lines(tmp_path / "one" / "labels")) == 16 and len(lines(tmp_path / "one" / "report")) == 87
    main(["sweep", edges, str(tmp_path / "many"), "-k", "2", "--init", "hub,rd", "--beta", "0.3", "--sigma", "0.2", "--runs", "1"], spark)
    runs = sorted(p.name for p in (tmp_path / "many").iterdir())
    assert runs == ["hub-edge-k2-b0.3-s0.2-t3-r1", "rd-edge-k2-b0.3-s0.2-t3-r1"]
    main(["collate", str(tmp_path / "many"), str(tmp_path / "all"), "--mode", "test"], spark)
    rows = spark.read.option("header", True).csv(str(tmp_path / "all")).collect()
    assert sorted(r.algorithm for r in rows) == ["hub", "rd"] and {r.vertices for r in rows} == {"16"} and {r.mode for r in rows} == {"test"}


def test_registry():
    with pytest.raises(ValueError):
        algorithm("pagerank")(lambda e: e)
    assert ALGORITHMS["sssp"].description and callable(ALGORITHMS["sssp"].run)
