"""CSV rules, checked one by one and against a character-by-character reader."""

import random

import pytest
from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from conftest import stored
from recordloom import workload
from recordloom.operators import registry
from recordloom.plans.export import write_csv, write_json_array
from recordloom.plans import load
from recordloom.plans.load import create_from_csv
from recordloom.session import fresh_folder
from recordloom.sources import csv_records, csv_text, sniff
from recordloom.sources.records import ROWNR


@pytest.mark.parametrize(
    "data, columns, rows",
    [
        ("a,b", ["a", "b"], []),
        ("a;b", ["a;b"], []),
        ("a,,b\n1,2", ["a", "b"], [("1", "2")]),
        (" A ,a,b\n1,2", ["a", "b"], [("1", "2")]),
        ("a,A,b\n1,2,3", None, None),
        ("a,b,c\n1", ["a", "b", "c"], [("1", None, None)]),
        ("a,b\n\n1,2\n", ["a", "b"], [("", None), ("1", "2")]),
        ('a,b,c\n"x\\"y","x""y","x\\\\"', ["a", "b", "c"], [('x"y', 'x"y', "x\\")]),
        ('a,b\n1,"l1\nl2"\r\n3,4', ["a", "b"], [("1", "l1\nl2"), ("3", "4")]),
        ('a,b\n1,"x\n2,3', None, None),
        ('"a,b\n1,2', None, None),
        (b"\xef\xbb\xbfa,b\n1,2", ["a", "b"], [("1", "2")]),
        ("a;b\n1;2;3", ["a;b"], [("1;2;3",)]),
        ("a,b\n1,2\na,b\n3,4", ["a", "b"], [("1", "2"), ("a", "b"), ("3", "4")]),
        ('"a\nx",b\n1,2\n"a\nx",b', ["a\nx", "b"], [("1", "2"), ("a\nx", "b")]),
        ("a,b\n1,é\n".encode("utf-16"), ["a", "b"], [("1", "é")]),
        ("a,b\r1,2\r", ["a", "b"], [("1", "2")]),
        ("a,b,c,,\n1,2,3\n4,5,,\n", None, None),
        ("a,b,c,,\n1,2,3\n4,5,\n", ["a", "b", "c"], [("1", "2", "3"), ("4", "5", "")]),
        ("", None, None),
        ("a,b\n5 \x80,x".encode("latin-1"), ["a", "b"], [("5 €", "x")]),
        pytest.param(b"a,b\n" + b"1,2\n" * 150_000 + b"\xe9,1\n", ["a", "b"], [("1", "2")] * 150_000 + [("é", "1")], id="late-latin"),
        pytest.param("a,b\né,ü\nß,1\n".encode() + b"x\xffy,1\n", ["a", "b"], [("é", "ü"), ("ß", "1"), ("x\ufffdy", "1")], id="bad-byte"),
        pytest.param(b"a,b\nx\xffy,1\n" + "é,ü\nß,1\n".encode(), ["a", "b"], [("x\ufffdy", "1"), ("é", "ü"), ("ß", "1")], id="early-bad-byte"),
        (b"a,b\n\xe9,\x81\n", ["a", "b"], [("é", "\ufffd")]),
        ("__rownr,b\n1,2\n", None, None),
        ("a.b,`c`\n1,2", ["a.b", "`c`"], [("1", "2")]),
    ],
)
def test_loading_rules(catalog, write_file, data, columns, rows):
    dataset_id, status = create_from_csv(catalog, write_file(data))
    if rows is None:
        assert status == registry.ERROR and catalog.log("loads").count() == 0
    else:
        assert status == registry.AVAILABLE
        assert catalog.records(dataset_id).columns == [ROWNR, *columns]
        assert stored(catalog, dataset_id) == rows


def read_by_character(text: str, sep: str = ","):
    """Records of a CSV text, or None if a quote stays open."""
    records, cells, raw, inside, i = [], [], "", False, 0
    while i < len(text):
        ch, nxt = text[i], text[i + 1 : i + 2]
        if ch == "\\" and (nxt in '"\\' and nxt or inside and nxt):
            raw, i = raw + ch + nxt, i + 2
            continue
        if ch == '"' and inside and nxt == '"':
            raw, i = raw + '""', i + 2
            continue
        if ch == '"':
            inside = not inside
        if not inside and ch == sep:
            cells, raw = cells + [raw], ""
        elif not inside and ch == "\n":
            records, cells, raw = records + [cells + [raw]], [], ""
        else:
            raw += ch
        i += 1
    if inside:
        return None
    if raw or cells:
        records.append(cells + [raw])
    return records


def cell_by_character(raw: str) -> str:
    body = raw.lstrip()
    if len(body) > 1 and body[0] == '"':
        i = 1
        while i < len(body) and body[i] != '"' or body[i : i + 2] == '""' and i + 1 < len(body):
            i += 2 if body[i] in '\\"' else 1
        if i == len(body) - 1:
            raw = body[1:-1]
    out, i = "", 0
    while i < len(raw):
        if raw[i] == "\\" and raw[i + 1 : i + 2] in ('"', "\\") or raw[i : i + 2] == '""':
            out, i = out + raw[i + 1], i + 2
        else:
            out, i = out + raw[i], i + 1
    return out


def random_text(seed: int, length: int) -> str:
    rng = random.Random(seed)
    return "".join(rng.choices('ab,"\\\n ', weights=[6, 3, 4, 3, 1, 3, 1], k=length))


def test_cells_agree_with_a_character_reader(spark):
    lines = [line for seed in range(60) for line in random_text(seed, 400).split("\n")]
    closed = [(line,) for line in lines if read_by_character(line) is not None]
    assert len(closed) > 1000
    df = spark.createDataFrame(closed, "v string")
    for row in df.select("v", csv_text.cells(F.col("v"), ",").alias("c"), csv_text.ends_open(F.col("v")).alias("o")).collect():
        raw = read_by_character(row["v"])
        expected = [cell_by_character(c) for c in (raw[0] if raw else [""])]
        assert row["c"] == expected, row["v"]
        assert not row["o"]
        assert csv_text.header_cells(row["v"], ",") == expected
    still_open = spark.createDataFrame([(x,) for x in lines if read_by_character(x) is None], "v string")
    assert still_open.where(~csv_text.ends_open(F.col("v"))).isEmpty()


@pytest.mark.parametrize("seed, broadcast_rows", [(0, 10**6), (1, 10**6), (2, 10**6), (3, 0)])
def test_records_across_scan_blocks(spark, write_file, monkeypatch, seed, broadcast_rows):
    """Tiny scan blocks: quoted line breaks fall on every kind of block edge."""
    monkeypatch.setattr(csv_records, "BROADCAST_ROWS", broadcast_rows)
    text = "h1,h2\n" + random_text(1000 + seed, 6000)
    while read_by_character(text) is None:
        text += '"'
    expected = read_by_character(text)[1:]
    width = max(map(len, expected))
    text = text.replace("h1,h2", ",".join(f"h{i}" for i in range(width)), 1)
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "97")
        spark.conf.set("spark.sql.files.openCostInBytes", "0")
        path = write_file(text)
        assert csv_records.lines(spark, sniff.file_groups(spark, path)[0]).rdd.getNumPartitions() > 20
        rows = [list(r)[1:] for r in csv_records.scan_csv(spark, path).orderBy(ROWNR).collect()]
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert rows == [[cell_by_character(c) for c in r] + [None] * (width - len(r)) for r in expected]


def test_long_cells_need_no_regex_stack(catalog, write_file):
    long, escaped = "x" * 200_000, '""' * 80_000
    dataset_id, status = create_from_csv(catalog, write_file(f'a,b\n"{long}","{escaped}"\n'))
    assert status == registry.AVAILABLE and stored(catalog, dataset_id) == [(long, '"' * 80_000)]


cell = st.text(alphabet=st.sampled_from('aZ0 ,;"\\\nåß€𝄞\t'), max_size=6)


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(cell, cell, cell), min_size=1, max_size=12))
def test_round_trip(spark, catalog, rows):
    numbered = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], f"{ROWNR} long, x string, y string, z string")
    folder = fresh_folder(spark, "round-trip")
    write_csv(numbered.coalesce(1), folder, ordered=True, escape_backslash=True)
    dataset_id, status = create_from_csv(catalog, folder)
    assert status == registry.AVAILABLE and stored(catalog, dataset_id) == rows


def test_lone_backslash_option(catalog, write_file):
    path = write_file("a\nx\\y")
    assert stored(catalog, create_from_csv(catalog, path)[0]) == [("x\\y",)]
    assert stored(catalog, create_from_csv(catalog, path, lone_backslash="drop")[0]) == [("xy",)]


def test_charset_rule():
    assert sniff.charset_of("é".encode()) == "UTF-8" and sniff.charset_of("é".encode("cp1252")) == "windows-1252"
    cut = b"x" * (sniff.HEAD_BYTES - 1) + "é".encode()[:1]
    assert sniff.charset_of(cut) == "UTF-8" and sniff.charset_of(cut[1:]) == "windows-1252"
    assert sniff.charset_of("a".encode("utf-16")) == "UTF-16LE"


def test_overlong_rows_are_listed(spark, write_file):
    rows = csv_records.overlong_rows(spark, write_file('a,b\n1,2\n1,"x,y",3\n')).collect()
    assert [tuple(r)[1:] for r in rows] == [(3, 2, '1,"x,y",3')]


def test_json_array(spark):
    df = spark.createDataFrame([(0, "x", None), (1, "", 'q"')], f"{ROWNR} long, a string, b string").coalesce(1)
    folder = fresh_folder(spark, "json-array")
    write_json_array(df, folder)
    lines = [r["value"] for r in spark.read.text(folder, wholetext=True).collect()]
    assert lines == ['[{"a":"x"},\n{"a":"","b":"q\\""}]\n']
    write_json_array(df.filter("a = 'none'"), folder + "-empty")
    assert {r["value"] for r in spark.read.text(folder + "-empty").collect()} <= {"[]"}


def test_heads_read_through_hadoop_are_the_same(spark, write_file):
    for data in (b'a;"b\n";c\nx;y;z\n', "é,b\n".encode("cp1252") + b"x" * 600_000, b"a," + b"b" * 700_000 + b"\n1,2\n"):
        path = write_file(data)
        row = sniff.sniff_files(spark, path).first()
        assert tuple(row)[2:] == sniff._look_through_hadoop(spark, f"file:{path}")


def test_charset_and_separator_can_be_named(catalog, write_file):
    path = write_file("a;b,c\né;1\n".encode("cp1252"))
    dataset_id, _ = create_from_csv(catalog, path, charset="windows-1252", sep=",")
    assert stored(catalog, dataset_id) == [("é;1", None)]


@pytest.mark.parametrize("names", [("0.csv", "1.csv"), ("1.csv", "0.csv")])
def test_header_alone_takes_the_separator_of_its_like(catalog, write_file, names):
    """What Spark writes for an empty first partition: a file without rows, which tells no separator."""
    folder = write_file("a;b\n", f"parts/{names[0]}").rpartition("/")[0]
    write_file("a;b\n1;2\n", f"parts/{names[1]}")
    dataset_id, status = create_from_csv(catalog, folder)
    assert status == registry.AVAILABLE and stored(catalog, dataset_id) == [("1", "2")]


@pytest.mark.parametrize("text, columns", [("a;b\n", ["a;b"]), ("a;b", ["a;b"]), ("a,b\n", ["a", "b"]), ("a;b\n\n", ["a;b"])])
def test_header_alone_without_others(catalog, write_file, text, columns):
    dataset_id, status = create_from_csv(catalog, write_file(text))
    assert status == registry.AVAILABLE and catalog.records(dataset_id).columns == [ROWNR, *columns]


def test_row_numbers_of_many_small_blocks(spark, tmp_path):
    """Several blocks of short lines in one scan partition still have numbers of their own, in file order."""
    for i in range(3):
        (tmp_path / f"{i}.csv").write_text("a\n" + f"{i}\n" * 60_000)
    settings = {"spark.sql.files.maxPartitionBytes": "20000", "spark.sql.files.openCostInBytes": "0", "spark.sql.files.maxPartitionNum": "2"}
    for name, value in settings.items():
        spark.conf.set(name, value)
    try:
        rows = csv_records.scan_csv(spark, str(tmp_path)).select(ROWNR, "a").toPandas()
    finally:
        for name in settings:
            spark.conf.unset(name)
    assert len(rows) == rows[ROWNR].nunique() == 180_000
    assert rows.sort_values(ROWNR)["a"].tolist() == [str(i) for i in range(3) for _ in range(60_000)]


def test_small_blocks_grow_with_the_table(spark, tmp_path, monkeypatch):
    """More rows are dealt over more files and scan partitions, and their lines still lie behind many small blocks."""
    monkeypatch.setattr(workload, "FILE_ROWS", 20_000, raising=False)
    monkeypatch.setattr(workload, "SCAN_BYTES", 70_000, raising=False)
    spark.range(0, 120_000, 1, 4).select(F.col("id").alias("event_id")).write.parquet(f"{tmp_path}/events.parquet")
    seen = []

    def create(catalog, folder):
        text = csv_records.lines(spark, sniff.file_groups(spark, folder)[0])
        counts = text.agg(F.count_distinct("base"), F.count_distinct("base", "block"), F.count_if(csv_records._crowded())).first()
        seen.append((text.rdd.getNumPartitions(), *counts))
        return create_from_csv(catalog, folder)

    monkeypatch.setattr(load, "create_from_csv", create)
    assert workload.rownr_unique(spark, str(tmp_path)).collect() == [(120_000, 120_000, True)]
    ((partitions, files, blocks, crowded),) = seen
    assert partitions >= 10 and files == 6 and blocks >= 20 * partitions and crowded > 60_000


def test_many_paths_are_read_as_several_scans(spark, tmp_path, monkeypatch):
    for i in range(5):
        (tmp_path / f"{i}.csv").write_text(f"a\n{i}\n")
    monkeypatch.setattr(csv_records, "PATH_CHARS", 2 * len(str(tmp_path)) + 60)
    rows = csv_records.scan_csv(spark, str(tmp_path)).orderBy(ROWNR).collect()
    assert [r["a"] for r in rows] == list("01234")


def test_filters_for_short_columns_only(spark, catalog, write_file):
    import glob
    import os

    import pyarrow.parquet as pq

    dataset_id, _ = create_from_csv(catalog, write_file("a,b,c\n1," + "x" * 400 + ",2\n"))
    folder = catalog.segments(dataset_id)[0]["path"].replace("file:", "")
    (part,) = glob.glob(f"{folder}/*.parquet")
    assert pq.ParquetFile(part).metadata.row_group(0).num_columns == 4
    assert os.path.getsize(part) < 20_000
    assert "parquet.bloom.filter.enabled#b" not in load.lookup_options(["a", "c"])
