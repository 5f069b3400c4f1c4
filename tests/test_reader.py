"""SC2: a line limit reads a prefix of the files, and of a large file's splits."""

import os

import pytest

from logsift.sources.logs import _count_splits, _raw_lines, read_log_text


def write(folder, name, lines):
    with open(os.path.join(folder, name), "wb") as f:
        f.write(b"".join(line + b"\n" for line in lines))


@pytest.fixture
def logs(tmp_path):
    """Files of unlike line lengths and counts; the last one can't be read."""
    lines, at = [], 0
    for k, (n, width) in enumerate([(0, 0), (3, 5), (700, 90), (1, 4), (40, 300), (900, 12), (250, 60)]):
        some = [b"%d %s" % (at + i, b"x" * width) for i in range(n)]
        write(tmp_path, f"a{k} [{k}].log", some)
        lines += some
        at += n
    (tmp_path / "z.log.gz").write_bytes(b"\x1f\x8b no archive" * 1000)
    return str(tmp_path), [x.decode() for x in lines]


@pytest.mark.parametrize("limit", [1, 3, 4, 650, 703, 704, 705, 1643, 1644, 1800, 1893])
def test_limit_keeps_a_prefix_and_opens_no_file_behind_it(spark, logs, limit):
    path, lines = logs
    got = read_log_text(spark, path, limit)
    assert sorted(tuple(r) for r in got.collect()) == list(enumerate(lines[:limit]))


def test_limit_beyond_the_readable_files_opens_the_last(spark, logs):
    with pytest.raises(Exception):
        read_log_text(spark, logs[0], 1895).collect()


def test_splits_of_a_large_file_are_counted_up_to_the_limit(spark, tmp_path):
    lines = [b"%06d %s" % (i, b"y" * (i % 50)) for i in range(20000)]
    write(tmp_path, "one.log", lines)
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        raw = _raw_lines(spark, [str(tmp_path)])
        splits, behind = _count_splits(raw, 1000, True)
        assert behind == sum(1 for _ in splits) * 20000 < 200_000 and sum(s[3] for s in splits) >= 1000
        for limit in (1, 1000, 7777, 20000, 30000):
            got = read_log_text(spark, str(tmp_path), limit)
            assert sorted(tuple(r) for r in got.collect()) == [(i, x.decode()) for i, x in enumerate(lines[:limit])]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_empty_input(spark, tmp_path):
    write(tmp_path, "none.log", [])
    assert read_log_text(spark, str(tmp_path), 10).count() == 0 == read_log_text(spark, str(tmp_path)).count()
