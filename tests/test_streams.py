import datetime as dt

from conftest import STATION_FILE, STATION_ROWS, stored
from recordloom.operators import registry, traffic
from recordloom.session import fresh_folder
from recordloom.streaming import drop_folder
from recordloom.streaming import traffic as stream_traffic


def test_drop_folder(spark, catalog, write_file, tmp_path):
    write_file(STATION_FILE, "drop/people/1.csv")
    write_file("a,b\n1,2\n", "drop/pairs/1.csv")
    write_file("a,b\n1,2,3\n", "drop/broken/1.csv")
    write_file("a,b\n1,2\n", "drop/not an alias/1.csv")
    folder, progress = str(tmp_path / "drop"), fresh_folder(spark, "progress")

    def run():
        drop_folder.watch_folder(spark, catalog, folder, progress, loads_at_once=2, files_per_batch=2).awaitTermination()

    run()
    assert [r["folder"] for r in drop_folder.refused(spark, progress).collect()] == ["not an alias"]
    people, pairs, broken = (catalog.resolve(n) for n in ("people", "pairs", "broken"))
    assert stored(catalog, people) == STATION_ROWS and stored(catalog, pairs) == [("1", "2")]
    assert catalog.status(broken) == registry.ERROR and catalog.status(people) == registry.AVAILABLE
    write_file("b,a\n4,3\n", "drop/pairs/2.csv")
    run()
    assert catalog.datasets().count() == 3
    assert stored(catalog, pairs) == [("1", "2"), ("3", "4")] and stored(catalog, people) == STATION_ROWS


def test_replayed_batch_loads_nothing_twice(spark, catalog, write_file):
    path = write_file("a,b\n1,2\n", "again/pairs/1.csv")
    files = spark.createDataFrame([(f"file:{path}",)], "path string")
    for _ in range(2):
        drop_folder.ingest_batch(catalog, files, "batch-1")
    assert stored(catalog, catalog.resolve("pairs")) == [("1", "2")]


def test_files_of_a_batch_are_one_load_per_dataset(spark, catalog, write_file):
    """Twelve files of two datasets: one load where all are sound; a broken file harms only itself."""
    good = [write_file(f"a,b\n{i},x\n" if i % 2 == 0 else f"b;a\ny;{i}\n", f"many/good/{i}.csv") for i in range(6)]
    mixed = [write_file(f"a\n{i}\n" if i != 2 else "a\n1,2,3\n", f"many/mixed/f[{i}].csv") for i in range(6)]
    files = spark.createDataFrame([(f"file:{p}",) for p in good + mixed], "path string")
    for _ in range(2):
        drop_folder.ingest_batch(catalog, files, "batch-7")
    sound, partly = catalog.resolve("good"), catalog.resolve("mixed")
    assert [r[0] for r in stored(catalog, sound)] == [str(i) for i in range(6)]
    assert [r[0] for r in stored(catalog, partly)] == ["0", "1", "3", "4", "5"]
    entries = lambda d: len(catalog.log("loads", d).inputFiles())
    assert entries(sound) == 1 and entries(partly) == 5 and catalog.status(sound) == registry.AVAILABLE
    later = spark.createDataFrame([(f"file:{write_file('a,b' + chr(10) + '9,z' + chr(10), 'many/good/9.csv')}",)], "path string")
    drop_folder.ingest_batch(catalog, later, "batch-8")
    assert [r[0] for r in stored(catalog, sound)] == [*map(str, range(6)), "9"]


def test_streamed_admission_equals_batch(spark, tmp_path):
    start = dt.datetime(2024, 1, 1)
    rows = [(i, f"k{i % 3}", start + dt.timedelta(milliseconds=137 * i * (1 + i % 2))) for i in range(400)]
    rows.sort(key=lambda r: r[2])
    source, schema = str(tmp_path / "in"), "id long, key string, ts timestamp_ntz"
    spark.createDataFrame(rows[:200], schema).coalesce(1).write.parquet(source)
    target, progress = fresh_folder(spark, "out"), fresh_folder(spark, "progress")

    def run():
        events = spark.readStream.schema(schema).parquet(source)
        out = stream_traffic.sliding_admission_stream(events, "key", "ts", "id", 3, 5, "10 seconds")
        out.writeStream.format("parquet").option("path", target).option("checkpointLocation", progress).trigger(
            availableNow=True
        ).start().awaitTermination()

    run()
    spark.createDataFrame(rows[200:], schema).coalesce(1).write.mode("append").parquet(source)
    run()
    got = {(r["order"], r["admitted"]) for r in spark.read.parquet(target).collect()}
    batch = traffic.sliding_admission(spark.createDataFrame(rows, schema), "key", "ts", "id", 3, 5)
    assert got == {(r["id"], r["admitted"]) for r in batch.collect()} and len(got) == 400
