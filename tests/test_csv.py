import csv
import io

import pytest

from fieldweave.sources.pairs import ends_inside, read_csv

CELLS = [("A", "B", "label"), ("plain", "x", "DIRECT"), ("two\nlines", "a,b", "NO_MATCH"), ('say "hi"', "", "DIRECT"), ("", "three\n\nlines\nof", "x"), ('5" disk', "é😀", "y"), ("\n", '""', ' "z" ')]


def read_by_python(text):
    rows = [r for r in csv.reader(io.StringIO(text.removeprefix("\ufeff"), newline="")) if r]
    return [(*r, k) for k, r in enumerate(rows[1:], start=2)]


def written(rows, end="\n"):
    out = io.StringIO(newline="")
    csv.writer(out, lineterminator=end).writerows(rows)
    return out.getvalue()


def read_by_spark(spark, path, size):
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    for key in before:
        spark.conf.set(key, str(size))
    try:
        return sorted(map(tuple, read_csv(spark, path, ("A",)).collect()), key=lambda r: r[-1])
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)


@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_cut_at_every_byte(spark, tmp_path, end):
    text = "\ufeff" + written(CELLS, end) + end + written(CELLS[1:3], end)
    path = tmp_path / "in.csv"
    path.write_bytes(text.encode())
    want = read_by_python(text)
    assert [r[-1] for r in want] == list(range(2, 10))
    for size in [*range(5, 40, 3), 61, 90, 1000]:
        assert read_by_spark(spark, str(path), size) == want, size


def test_many_blocks_without_quotes(spark, tmp_path):
    path = tmp_path / "in.csv"
    rows = [("A", "B"), *((f"name{k}", "v" * (k % 7)) for k in range(3000))]
    path.write_text(written(rows))
    assert read_by_spark(spark, str(path), 1000) == [(*r, k) for k, r in enumerate(rows[1:], start=2)]


@pytest.mark.parametrize("size", [6, 10_000])
def test_records_of_another_length_fail(spark, tmp_path, size):
    for bad in ("a,b\n", "a,b,c,d\n", '"a\nb",c\n'):
        path = tmp_path / f"{len(bad)}.csv"
        path.write_text("A,B,label\nx,y,z\n" + bad + "x,y,z\n")
        with pytest.raises(Exception):  # noqa: B017
            read_by_spark(spark, str(path), size)


def test_headers_only_and_no_last_line_end(spark, tmp_path):
    (tmp_path / "a.csv").write_text("A,B\n")
    (tmp_path / "b.csv").write_text('A,B\n1,"2\n3"')
    assert read_by_spark(spark, str(tmp_path / "a.csv"), 3) == []
    assert read_by_spark(spark, str(tmp_path / "b.csv"), 3) == [("1", "2\n3", 2)]


@pytest.mark.parametrize(
    ("line", "outside", "within"),
    [("a,b", False, True), ('"a', True, False), ('a"', False, False), ('"a""', True, False), ('"a""",b', False, False), ('x,"y,z', True, False), ('5" disk,"x"', False, False), ("", False, True), ('""', False, True), ('"', True, False), ('",', True, False), ('","', False, True)],
)
def test_where_a_line_ends(line, outside, within):
    assert (ends_inside(line, False), ends_inside(line, True)) == (outside, within)
