"""Quoted CSV files in byte ranges against Spark's whole-file reader."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from bedtide.sources import csvsplits, readers


def states(line):
    """The plain state machine: one character at a time, for both states a line may begin in."""
    out = []
    for inside in (False, True):
        state, start = ("quoted" if inside else "begin"), 0
        i = 0
        while i < len(line):
            c = line[i]
            if state == "begin":
                state = "quoted" if c == '"' else "begin" if c == "," else "plain"
            elif state == "plain":
                state = "begin" if c == "," else "plain"
            elif state == "quoted" and c == '"':
                if line[i + 1:i + 2] == '"':
                    i += 1
                else:
                    state = "plain"
            i += 1
        out.append(state == "quoted")
    return out


def test_states_of_lines():
    rng = np.random.default_rng(3)
    lines = ["".join(rng.choice(list('a",x ')) for _ in range(int(rng.integers(0, 12)))) for _ in range(4000)] + ['"' * n for n in range(9)] + ["x" * 200000 + '"', '"' + 'ab""' * 100000]
    for line in lines:
        assert [csvsplits.ends_inside(line, s) for s in (False, True)] == states(line), line


FIELDS = ["plain", "", "5 in", '"quoted"', '"a, b"', '"say ""hi"""', '"two\nlines"', '"\n\n,\n"', '"ends""\n""so"', "naïve", '""']


@pytest.fixture(scope="module")
def files(tmp_path_factory):
    folder = tmp_path_factory.mktemp("csv")
    rng = np.random.default_rng(1)
    for name in ("a.csv", "b.csv"):
        rows = [",".join([str(i), *rng.choice(FIELDS, 3)]) for i in range(3000)]
        rows[7] = "7,only two"
        rows[9] = "9,a,b,c,d,e"
        rows[11] = '11,"' + "long\n" * 2000 + '",x,y'
        (folder / name).write_text('id,one,"two",three\n' + "\n".join(rows) + "\n")
    (folder / "c.csv").write_text('id,one,"two",three\n')
    return str(folder)


@pytest.mark.parametrize("size", [1000, 4096, 1 << 20])
def test_reads_as_whole_files_do(spark, files, size):
    key = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(key)
    spark.conf.set(key, str(size))
    try:
        rows = readers.read_raw(spark, files)
        lines, _ = csvsplits.placed_lines(spark, files)
        if size < 5000:
            assert lines.select("_file", "_start").distinct().count() > 20 and rows.rdd.getNumPartitions() > 5
        order = lambda df: sorted(tuple("NULL" if v is None else v for v in r) for r in df.collect())
        assert order(rows) == order(readers.read_raw(spark, files, split=False))
    finally:
        spark.conf.set(key, before)


def test_partition_folders_and_headers(spark, tmp_path):
    for part in ("x", "y"):
        (tmp_path / "in" / f"site={part}").mkdir(parents=True)
        (tmp_path / "in" / f"site={part}" / "f.csv").write_text(f'a,b\n1,"{part}\n"\n\n2,\n')
    got = readers.read_raw(spark, str(tmp_path / "in"), with_file=True)
    assert sorted((r.a, r.b or "", r.site) for r in got.collect()) == [("1", "x\n", "x"), ("1", "y\n", "y"), ("2", "", "x"), ("2", "", "y")]
    assert got.where(~F.col("_file").endswith("f.csv")).isEmpty()
    (tmp_path / "in" / "site=y" / "g.csv").write_text("b,a\n1,2\n")
    with pytest.raises(ValueError, match="different headers"):
        readers.read_raw(spark, str(tmp_path / "in"))
