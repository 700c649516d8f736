"""Array files: round trips, ranges, and files one after another."""

import numpy as np
import pytest

from tidewave.sources.arrays import header, read_array, read_csv_array, read_geom, read_metrics, write_array, write_csv_array, write_metrics, write_ranges


def put(path, array, kind):
    path.write_bytes(header(kind, list(array.shape)) + array.astype(kind).tobytes(order="F"))


@pytest.mark.parametrize("kind", ["uint8", "float32", "int16", "int32", "uint16", "float64", "uint32"])
def test_types(spark, tmp_path, kind):
    x = np.arange(30).reshape(3, 10)
    put(tmp_path / "a.mda", x, kind)
    rows = read_array(spark, str(tmp_path / "a.mda"), chunk=4).collect()
    assert {(r["channel"], r["t"]): r["v"] for r in rows} == {(c + 1, t): float(x[c, t]) for c in range(3) for t in range(10)}


def test_ranges_are_pushed_down(spark, tmp_path):
    put(tmp_path / "a.mda", np.arange(40).reshape(2, 20), "float32")
    part = read_array(spark, str(tmp_path / "a.mda"), chunk=3).where("t >= 5 AND t < 9 AND channel = 2")
    assert sorted((r["t"], r["v"]) for r in part.collect()) == [(t, 20.0 + t) for t in range(5, 9)]


def test_folder_and_list(spark, tmp_path):
    for n in ("a", "b"):
        put(tmp_path / f"{n}.mda", np.full((1, 3), ord(n)), "int16")
    want = [97.0] * 3 + [98.0] * 3
    assert [r["v"] for r in read_array(spark, str(tmp_path)).orderBy("t").collect()] == want
    both = f"[{tmp_path}/b.mda][{tmp_path}/a.mda]"
    assert [r["v"] for r in read_array(spark, both).orderBy("t").collect()] == want[::-1]


def test_written_file_reads_back(spark, tmp_path):
    x = np.random.default_rng(1).normal(size=(3, 50))
    rows = spark.createDataFrame([(c + 1, t, float(x[c, t])) for c in range(3) for t in range(50)], "channel int, t long, v double")
    out = str(tmp_path / "o")
    for append, parts in ((False, 1), (False, 4), (True, 3)):
        write_array(rows, out, 3, "float64", append=append, partitions=parts)
        back = read_array(spark, out).orderBy("channel", "t").collect()
        assert np.array_equal(np.array([r["v"] for r in back]).reshape(3, -1), np.concatenate([x, x], 1) if append else x)
    assert [tuple(r) for r in read_array(spark, out).where("t = 60 AND channel = 2").select("t", "v").collect()] == [(60, x[1, 10])]
    assert not list((tmp_path / "o").glob("*.part"))


def test_raw_files_must_be_whole(spark, tmp_path):
    (tmp_path / "r.bin").write_bytes(np.arange(8, dtype="int16").tobytes())
    rows = read_array(spark, str(tmp_path / "r.bin"), num_channels=2, dtype="int16").orderBy("t", "channel").collect()
    assert [r["v"] for r in rows] == list(range(8))
    with pytest.raises(Exception, match="whole samples"):
        read_array(spark, str(tmp_path / "r.bin"), num_channels=3, dtype="int16").collect()


def test_texts(spark, tmp_path):
    (tmp_path / "g.csv").write_text("1,2\n3 4\n\n5\n")
    assert [list(r["values"]) for r in read_csv_array(spark, str(tmp_path / "g.csv")).orderBy("row").collect()] == [[1, 2], [3, 4], [5]]
    assert [tuple(r) for r in read_geom(spark, str(tmp_path / "g.csv")).orderBy("channel").collect()] == [(1, 1, 2), (2, 3, 4), (3, 5, 0)]
    (tmp_path / "m.json").write_text('{"clusters": [{"label": 2, "metrics": {"a": 1.5}, "tags": ["x"]}]}')
    assert [tuple(r) for r in read_metrics(spark, str(tmp_path / "m.json")).collect()] == [(2, "a", 1.5)]
    write_csv_array(spark.createDataFrame([(2, [3.0, 4.5]), (1, [1.0])], "row int, values array<double>"), str(tmp_path / "t"))
    assert [list(r["values"]) for r in read_csv_array(spark, str(tmp_path / "t")).orderBy("row").collect()] == [[1], [3, 4.5]]
    write_metrics(spark.createDataFrame([(2, "a", 1.5), (2, "b", 2.0), (1, "a", 0.0)], "label int, name string, value double"), str(tmp_path / "j"))
    assert sorted(tuple(r) for r in read_metrics(spark, str(tmp_path / "j")).collect()) == [(1, "a", 0.0), (2, "a", 1.5), (2, "b", 2.0)]


def test_ranges_in_any_order(spark, tmp_path):
    path = str(tmp_path / "a.mda")
    want = np.zeros((3, 500))
    rng = np.random.default_rng(2)
    rows = []
    for first in (420, 10, 200):  # ranges of all channels, and single values of some
        want[:, first : first + 50] = rng.normal(size=(3, 50))
        rows += [(t, c + 1, float(want[c, t])) for t in range(first, first + 50) for c in range(3)]
    for t in (0, 100, 499):
        want[1, t] = t + 0.5
        rows.append((t, 2, t + 0.5))
    df = spark.createDataFrame([rows[i] for i in rng.permutation(len(rows))], "t long, channel int, v double").repartition(5)
    write_ranges(df, path, 3, 500, "float64")
    get = lambda: np.array([r["v"] for r in read_array(spark, path).orderBy("channel", "t").collect()]).reshape(3, -1)
    assert np.array_equal(get(), want)
    assert (tmp_path / "a.mda").stat().st_size == len(header("float64", [3, 500])) + 3 * 500 * 8
    want[:, 300:303] = 7
    write_ranges(spark.createDataFrame([(t, c, 7.0) for t in (302, 300, 301) for c in (1, 3, 2)], "t long, channel int, v double"), f"file://{path}", 3, 500, "float64", update=True)
    assert np.array_equal(get(), want)
    for bad in ([(500, 1, 1.0)], [(0, 4, 1.0)], [(-1, 1, 1.0)]):  # outside: the file stays as it is
        with pytest.raises(Exception, match="lies outside"):
            write_ranges(spark.createDataFrame(bad, "t long, channel int, v double"), path, 3, 500, "float64", update=True)
    with pytest.raises(ValueError, match="another type or size"):
        write_ranges(df, path, 3, 501, "float64", update=True)
    with pytest.raises(ValueError, match="mounted folder"):
        write_ranges(df, "mock://x/a.mda", 3, 500)
    assert np.array_equal(get(), want) and not list(tmp_path.glob("*.part"))
    write_ranges(df.limit(0), path, 2, 4)
    assert [r["v"] for r in read_array(spark, path).collect()] == [0.0] * 8


def test_texts_are_read_in_ranges(spark, tmp_path):
    rng = np.random.default_rng(3)
    values = [[float(i), *rng.integers(0, 1000, rng.integers(0, 6)).tolist()] for i in range(1, 2001)]
    (tmp_path / "t").mkdir()
    for name, part in (("a", values[:700]), ("b", values[700:701]), ("c", values[701:])):
        (tmp_path / "t" / f"{name}.csv").write_text("\n" + "".join(",".join(map(str, v)) + ("\r\n" if i % 3 else "\n\n  \n") for i, v in enumerate(part)))
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "900")
        spark.conf.set("spark.sql.files.openCostInBytes", "10")
        assert spark.read.text(str(tmp_path / "t")).rdd.getNumPartitions() > 20
        rows = sorted((r["row"], list(r["values"])) for r in read_csv_array(spark, str(tmp_path / "t")).collect())
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    assert rows == [(i, v) for i, v in enumerate(values, 1)]
