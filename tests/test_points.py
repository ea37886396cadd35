import pytest
from pyspark.sql import functions as F

from vicinal.plans import runs as R
from vicinal.sources import points as P


def write(tmp_path, text):
    (tmp_path / "p.csv").write_text(text)
    return str(tmp_path / "p.csv")


def read(df):
    return [(r.idx, r.label, list(r.v)) for r in df.orderBy("idx").collect()]


def test_reads_ranges_and_prefixes(spark, tmp_path):
    path = write(tmp_path, "h\n1,2,3\n4,5,6\n7,8,9\n")
    assert read(P.read_points_csv(spark, path)) == [(0, None, [1, 2, 3]), (1, None, [4, 5, 6]), (2, None, [7, 8, 9])]
    assert read(P.read_points_csv(spark, path, start=1, n=9, d=2)) == [(1, None, [4, 5]), (2, None, [7, 8])]
    assert read(P.read_points_csv(spark, write(tmp_path, "header only\n"))) == []


def test_labels_types_and_bad_values(spark, tmp_path):
    path = write(tmp_path, "h,x,y\na,1,2\nb,3,z\n")
    assert read(P.read_points_csv(spark, path, labelled=True, bad_value="zero")) == [(0, "a", [1, 2]), (1, "b", [3, 0])]
    with pytest.raises(Exception, match="not a number"):
        P.read_points_csv(spark, path, labelled=True).collect()
    assert read(P.read_points_csv(spark, write(tmp_path, "h\n5\n6\n"), labelled=True, element_type="int")) == [(0, "5", [5]), (1, "6", [6])]
    with pytest.raises(ValueError):
        P.read_points_csv(spark, path, element_type="text")


@pytest.mark.parametrize("labelled", [False, True])
def test_loads_queries_and_corpus(spark, tmp_path, labelled):
    label = "z," if labelled else ""
    path = write(tmp_path, "h\n" + "".join(f"{label}{i},{i * 10},{i * 100}\n" for i in range(9)))
    (tmp_path / "other.csv").write_text("h\n" + f"{label}5,6,7\n{label}8,9,10\n")
    name = "z" if labelled else None
    q, c = P.load(spark, path, 1, 3, str(tmp_path / "other.csv"), 0, 9, 2, labelled)
    assert read(q) == [(1, name, [1, 10]), (2, name, [2, 20])] and read(c) == [(0, name, [5, 6]), (1, name, [8, 9])]
    q, c = P.load(spark, path, 0, 2, path, 7, 9, 3, labelled)
    assert [i for i, _, _ in read(q)] == [0, 1] and read(c) == [(7, name, [7, 70, 700]), (8, name, [8, 80, 800])]


def test_header_of_every_file_is_skipped(spark, tmp_path):
    for i in range(3):
        (tmp_path / f"part-{i}.csv").write_text(f"x,y\n{i},1\n{i},2\n")
    assert read(P.read_points_csv(spark, str(tmp_path))) == [(j, None, [j // 2, j % 2 + 1]) for j in range(6)]


def test_nanoseconds(spark):
    assert spark.range(1).select(R.milliseconds(F.lit(2_500_000)).alias("ms")).first().ms == 2.5


def test_ragged_rows_raise(spark, tmp_path):
    with pytest.raises(Exception, match="coordinates"):
        P.read_points_csv(spark, write(tmp_path, "h\n1,2\n3\n")).collect()


def test_numbers_lines_over_many_blocks(spark, tmp_path):
    path = write(tmp_path, "h\n" + "".join(f"{i},{i * 2}\n" for i in range(5000)))
    was = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "7000")
    try:
        found = P.read_points_csv(spark, path)
        assert found.rdd.getNumPartitions() > 1
        assert read(found) == [(i, None, [i, i * 2]) for i in range(5000)]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", was)


@pytest.mark.parametrize("labelled", [False, True])
def test_round_trip(spark, tmp_path, labelled):
    points = P.random_grid(spark, 0, 300, 3, seed=5)[1].withColumn("v", F.transform("v", lambda x: x / 7))
    points = points.withColumn("label", F.concat(F.lit("n"), "idx")) if labelled else points
    P.write_points_csv(points, str(tmp_path / "out"), 3, labelled=labelled)
    assert read(P.read_points_csv(spark, str(tmp_path / "out"), labelled=labelled)) == read(points)


def test_generators(spark):
    a = read(P.random_grid(spark, 3, 50, 2, seed=1)[1].repartition(7))
    assert a == read(P.random_grid(spark, 9, 50, 2, seed=1)[1]) != read(P.random_grid(spark, 3, 50, 2, seed=2)[1])
    assert all(0 <= x < 1000 and x == int(x) for _, _, v in a for x in v)
    assert read(P.regular_grid(spark, 3, 2)[1])[5] == (5, None, [2, 1])
    assert read(P.sequential_points(spark, 2, 4, 3)) == [(2, None, [6, 7, 8]), (3, None, [9, 10, 11])]
    assert P.generate_points(spark, "regular", 2, s=4, labels=True).where("label = '0'").count() == 16
    with pytest.raises(ValueError):
        P.generate_points(spark, "regular", 2, n=4)


def test_runs(spark, tmp_path):
    grid = R.grid(spark, [1, 2], [10, 100], [3], [20])
    assert {(r.num_processors, r.n) for r in grid.collect()} == {(1, 100), (2, 100)}
    rows = [("c", "d", p, 100, 3, 20, t) for p, t in ((1, 8.0), (1, 4.0), (2, 3.0))]
    runs = spark.createDataFrame(rows, R.RUNS)
    R.write_runs(runs, str(tmp_path / "runs"))
    back = R.with_speedup(R.read_runs(spark, str(tmp_path / "runs")))
    assert sorted((r.num_processors, r.speedup) for r in back.collect()) == [(1, 0.75), (1, 1.5), (2, 2.0)]


def test_command_line(spark, tmp_path, capsys):
    from vicinal import __main__ as cli

    out = str(tmp_path / "grid")
    cli.main(["generate", "-f", out, "-g", "regular", "-s", "3", "-d", "2", "-l"])
    cli.main(["query", "-f", out, "-n", "9", "-d", "2", "-k", "2", "-l", "-P"])
    assert "X:0->9 | Y:0->9" in capsys.readouterr().out
    cli.main(["query", "-f", out, "-n", "9", "-d", "2", "-k", "2", "-l", "-m"])
    shown = capsys.readouterr().out
    assert "point 1, label 0\n  1   0\n  1: label 0, squared distance 0\n  1   0\n  2: label 0, squared distance 1\n" in shown and shown.count(", squared distance") == 18
    with pytest.raises(SystemExit):
        cli.main(["query", "-f", out, "-n", "0", "-d", "2", "-k", "2"])
