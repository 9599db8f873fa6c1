"""Files read in blocks: numbers, quotes, headers; with blocks of some bytes."""

import pytest

from strideframe.sources import tables, text_files

COLUMNS = ("a", "b")


@pytest.fixture
def small_blocks(spark):
    conf = {"spark.sql.files.maxPartitionBytes": "200", "spark.sql.files.openCostInBytes": "1"}
    old = {k: spark.conf.get(k) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    yield
    for k, v in old.items():
        spark.conf.set(k, v)


def test_lines_of_many_blocks(spark, tmp_path, small_blocks):
    texts = {f"f{i}.txt": [f"{i} line {j} ä{'x' * (j * 7 % 50)}" if j % 11 else "" for j in range(n)] for i, n in enumerate((120, 0, 1, 77))}
    for name, own in texts.items():
        (tmp_path / name).write_text("".join(x + ("\r\n" if name == "f3.txt" else "\n") for x in own), newline="")
    scan = text_files.text_lines(spark, str(tmp_path))
    assert scan.rdd.getNumPartitions() > 10
    numbered = text_files.Blocks.of(scan).numbered(scan)
    got = [(r.file_name, r.line_no, r.value, r.ordinal) for r in numbered.orderBy("ordinal").collect()]
    want = [(name, j, x) for name in sorted(texts) for j, x in enumerate(texts[name])]
    assert got == [(*w, i) for i, w in enumerate(want)]
    again = sorted((r.file_name, r.line_no, r.value) for r in text_files.lines(spark, str(tmp_path)).collect())
    assert again == sorted(want)


def test_files_cut_otherwise_are_found_out(spark, tmp_path, small_blocks):
    (tmp_path / "a.txt").write_text("".join(f"line {i}\n" for i in range(300)))
    counted = text_files.Blocks.of(text_files.text_lines(spark, str(tmp_path)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "350")
    with pytest.raises(Exception, match="cut otherwise"):
        counted.numbered(text_files.text_lines(spark, str(tmp_path))).collect()


def test_delimited_rows_in_order(spark, tmp_path, small_blocks):
    """Two orders of columns, blank lines, quotes with separators and, in one file, with line ends."""
    rows = {"1.csv": [(f"x{i}", f"y;{i}") for i in range(60)], "2.csv": [(f"u{i}", None if i % 3 else f'q"{i}') for i in range(40)], "3.csv": [("p\nq", "r"), ("s", "t\n;\nu"), ("v", "w")], "4.csv": [("last", "z")], "5.csv": []}
    quoted = lambda v: "" if v is None else '"' + v.replace('"', '""') + '"'
    for name, own in rows.items():
        swap = name in ("2.csv", "5.csv")
        lines = ["b;a" if swap else "a;b"] + [";".join(map(quoted, reversed(r) if swap else r)) for r in own]
        (tmp_path / name).write_text("\n\n".join(lines) + "\n")
    catalogue = text_files.by_header(spark, str(tmp_path))
    assert {k: [f.rsplit("/", 1)[1] for f in v] for k, v in catalogue.items()} == {("a", "b"): ["1.csv", "3.csv", "4.csv"], ("b", "a"): ["2.csv", "5.csv"]}
    got = sorted((r.ordinal, r.file_name, r.row.a, r.row.b) for _, df in text_files.delimited(spark, catalogue) for r in df.collect())
    assert got == [(i, *r) for i, r in enumerate((name, *v) for name in sorted(rows) for v in rows[name])]
    ev = tables.events(spark, str(tmp_path))
    assert sorted(r.row_idx for r in ev.collect()) == list(range(len(got))) and "home_team" in ev.columns


def test_first_lines_read_little(spark, tmp_path):
    """A header without the rest: a file that grows while its first line stays costs no more bytes."""
    (tmp_path / "big.csv").write_text("﻿a;b\n" + "1;2\n" * 2_000_000)
    (tmp_path / "empty.csv").write_text("")
    store = spark._jvm.org.apache.hadoop.fs.FileSystem
    read = lambda: sum(s.getBytesRead() for s in store.getAllStatistics())
    before = read()
    assert {k.rsplit("/", 1)[1]: v for k, v in text_files.first_lines(spark, str(tmp_path)).items()} == {"big.csv": "a;b", "empty.csv": ""}
    assert read() - before < 100_000
    assert text_files.delimited(spark, {}) == []
