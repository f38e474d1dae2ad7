import random

import pytest
from helpers import HEADER, csv_line, plan_of, write_csv
from pyspark.sql import functions as F
from rackpulse.schemas import CORRUPT, RAW_CSV_SCAN
from rackpulse.sources.csv import OPTIONS, quoted_records, read_csv, read_numbered_csv, split_by_form

BYTES = "spark.sql.files.maxPartitionBytes"


@pytest.fixture
def splits_of(spark):
    """Sets the size of the input splits for a test."""
    usual = spark.conf.get(BYTES)
    yield lambda size: spark.conf.set(BYTES, str(size))
    spark.conf.set(BYTES, usual)


def whole_file(spark, path):
    """The rows of files parsed by one task each, with one kind of line end in them."""
    rows = spark.read.schema(RAW_CSV_SCAN).options(**OPTIONS).option("multiLine", True).csv(path)
    return rows.select(*(F.regexp_replace(name, "\r\n", "\n").alias(name) for name in rows.columns))


def field(rng):
    kind = rng.randrange(7)
    if kind < 3:
        return "".join(rng.choice("abc xyz") for _ in range(rng.randrange(12)))
    inner = "".join(rng.choice(['a', 'b', ' ', ',', '""', '\n', '\r\n', '\n\n', 'word']) for _ in range(rng.randrange(9)))
    return f'"{inner}"'


def lines(rng, count, end):
    out = []
    for number in range(count):
        width = 12 if rng.random() < 0.9 else rng.choice([1, 11, 13])
        row = [field(rng) for _ in range(width)]
        row[0] = f"r{number}"
        out.append(",".join(row) + rng.choice([end] * 8 + [end * 2]))
    return "".join(out)


@pytest.mark.parametrize("seed", range(2))
def test_splits_give_the_rows_of_the_whole_file(spark, tmp_path, splits_of, rows_of, seed):
    rng = random.Random(seed)
    folder = tmp_path / "in"
    folder.mkdir()
    for number in range(3):
        end = rng.choice(["\n", "\r\n"])
        body = HEADER + end + lines(rng, rng.choice([1, 40, 300]), end)
        (folder / f"f {number}.csv").write_text(body, newline="")
    want = rows_of(whole_file(spark, str(folder)))
    order = [row[0] for row in whole_file(spark, str(folder / "f 0.csv")).select("timestamp").collect()]
    for size in (1 << 27, 1500):
        splits_of(size)
        assert rows_of(read_csv(spark, str(folder))) == want
        numbered = read_numbered_csv(spark, str(folder)).orderBy("row_num").collect()
        assert [row.row_num for row in numbered] == list(range(len(want)))
        assert [row.timestamp for row in numbered][:len(order)] == order


def test_one_file_is_read_by_many_tasks(spark, tmp_path, splits_of):
    long = csv_line("GPU-1")[:-1] + '"' + "\n".join(f"line {n}" for n in range(200)) + '"'
    folder = write_csv(tmp_path / "in", *([csv_line("GPU-0"), long] * 30))
    splits_of(4096)
    assert len(split_by_form(spark, folder).whole) == 1
    found = quoted_records(spark, [folder])
    assert found.bare == [] and found.rows.where("length(labels_raw) > 1000").count() == 30
    assert found.rows.select("_start").distinct().count() > 10
    # What is parsed comes from the written records: no scan of one task is left.
    plan = plan_of(read_csv(spark, folder))
    assert "FileScan csv" not in plan and "FileScan parquet" in plan


def test_record_over_several_splits(spark, tmp_path, splits_of, rows_of):
    huge = csv_line("GPU-1")[:-1] + '"' + "\n".join("x" * 50 for _ in range(100)) + '"'
    folder = write_csv(tmp_path / "in", csv_line("GPU-0"), huge, huge, csv_line("GPU-2"))
    splits_of(700)
    rows = read_numbered_csv(spark, folder)
    assert rows_of(rows, "row_num", "uuid", F.length("labels_raw")) == [
        (0, "GPU-0", 1), (1, "GPU-1", 5099), (2, "GPU-1", 5099), (3, "GPU-2", 1)]


def test_open_quote_and_bare_quotes(spark, tmp_path, splits_of, rows_of):
    folder = tmp_path / "in"
    write_csv(folder, csv_line("GPU-0"), csv_line("GPU-1")[:-1] + '"a\nb"', csv_line("GPU-2")[:-1] + '"never closed',
              csv_line("GPU-3"), name="a.csv")
    # A quote inside an unquoted field is a letter; only the whole-file reader knows it.
    write_csv(folder, csv_line("GPU-4")[:-1] + '5" pipe', csv_line("GPU-5")[:-1] + '"a\nb"', name="b c+d.csv")
    for size in (1 << 27, 120):
        splits_of(size)
        rows = read_numbered_csv(spark, str(folder))
        assert rows_of(rows.where(F.col(CORRUPT).isNull()), "row_num", "uuid", "labels_raw") == [
            (0, "GPU-0", "x"), (1, "GPU-1", "a\nb"), (3, "GPU-4", '5" pipe'), (4, "GPU-5", "a\nb")]
        assert rows_of(rows.where(F.col(CORRUPT).isNotNull()), "row_num", "uuid") == [(2, "GPU-2")]


def test_empty_files_and_headers_alone(spark, tmp_path, rows_of):
    folder = write_csv(tmp_path / "in", name="a.csv")
    (tmp_path / "in" / "b.csv").write_text("")
    write_csv(tmp_path / "in", "", "  ", csv_line("GPU-1")[:-1] + '"\n\n"', "", name="c.csv")
    assert rows_of(read_csv(spark, folder), "uuid", "labels_raw") == sorted([(None, None), ("GPU-1", "\n\n")], key=repr)
    assert read_csv(spark, folder, multiline=True).count() == 2
