"""Side tables: same answers as plain queries, and little is read for them."""

import random
import re

import pytest
from pyspark.sql import functions as F

from recordloom.errors import LoadRejected
from recordloom.functions import grams, patterns
from recordloom.operators import fingerprint, paging, predicates
from recordloom.plans import indexed, interleaved
from recordloom.plans.load import create_from_csv, load_csv
from recordloom.plans.order_directory import OrderDirectory
from recordloom.plans.row_directory import RowDirectory, with_rows_before
from recordloom.plans.trigram_index import TrigramIndex
from recordloom.session import fresh_folder
from recordloom.sources.csv_records import scan_csv
from recordloom.sources.records import ROWNR

BLOCK = 1000  # rows of a file, and so of a row group


def blocks(spark, rows):
    folder = fresh_folder(spark, "test-records")
    rows.write.option("maxRecordsPerFile", BLOCK).parquet(folder)
    return spark.read.parquet(folder)


def rows_read(df):
    """Rows that the scans of a query gave to the plan, row groups that were skipped not among them."""
    query = df._jdf.queryExecution()
    list(df.collect())

    def scans(plan):
        name = plan.getClass().getSimpleName()
        if name == "AdaptiveSparkPlanExec":
            return scans(plan.executedPlan())
        if name.endswith("QueryStageExec"):
            return scans(plan.plan())
        if name == "FileSourceScanExec":
            return int(plan.metrics().apply("numOutputRows").value())
        children = plan.children()
        return sum(scans(children.apply(i)) for i in range(children.size()))

    return scans(query.executedPlan())


@pytest.fixture(scope="module")
def words(spark):
    """20,000 rows of made-up words with gaps between the row numbers; one word is rare, one value fills half of the rows."""
    k = F.col("id")
    words = F.concat_ws(" ", *[F.concat(F.lit("w"), F.conv(F.substring(F.sha2(F.concat_ws("-", k, F.lit(i)), 256), 1, 2), 16, 36)) for i in range(6)])
    text = F.when(k.isin(4321, 4322, 17500), F.concat(words, F.lit(" Brass-Lantern "), words)).when(k % 97 != 0, words)
    owner = F.when(k % 2 == 0, F.lit("half")).when(k % 31 != 0, F.concat(F.lit("o"), F.conv(F.substring(F.md5(k.cast("string")), 1, 4), 16, 10)))
    rows = spark.range(0, 20_000, 1, 4).select((k * 37 + F.expr("id div 5000") * 1_000_003 + 11).alias(ROWNR), text.alias("text"), owner.alias("owner"))
    return blocks(spark, rows)


# -- conditions on pieces ------------------------------------------------------------


def holds(condition, text):
    if isinstance(condition, str):
        return condition in grams.fold(text)
    return (all if isinstance(condition, grams.All) else any)(holds(p, text) for p in condition.parts)


PATTERNS = [
    "lantern", "(cold|small)", "co?ld", "ab+c", "(ab){2}c", "(ab){2,}", "x{3}yz", "[ab]cd[ef]", "[a-f]cde", "[^a]bcd", "^abc.*def$", "abc|", "(abc|d.f)ghi",
    r"\mabc\M", r"a\.b\.c", r"\d+abc", "(?i)LANTern", "(?i)kelvin", "(?i)süßes", "***=a.b|c", "abc(?=def)", "(?:abc)?def", "a.c", "", "Straße", "(a|b|c)(d|e|f)(g|h|i)xyz", "[[:alpha:]]bcd",
    "((abc)|(def))+ghi", "a{0}bcd", r"[\.x]abc", "[]a]bc", "ab{2}c", "a(bc|cb)?d", "[a-]bc", r"(.)bc\1",
]


@pytest.mark.parametrize("pattern", PATTERNS)
def test_every_match_meets_the_condition(pattern):
    rng = random.Random(pattern)
    java = patterns.to_java(pattern)
    if java.startswith(r"\Q"):
        rule = re.compile(re.escape(pattern[4:]))
    else:
        body = java[java.index(")") + 1 :].replace(r"\z", r"\Z").replace(r"\p{IsAlphabetic}", "a-zA-Zäöüß").replace(r"\x{61}", "a")
        rule = re.compile(body, re.DOTALL | (re.IGNORECASE if "iu" in java[: java.index(")")] else 0))
    condition, matched = grams.required(pattern), 0
    alphabet = "abcdefghixyz. -" + pattern
    samples = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 30))) for _ in range(3000)]
    samples += ["a lanTERN here", "LANTERN", "Kelvın", "KELVİN", "SÜßES", "the small cold co ld", "abcdef ghi", "abdefghi", "ababc", "xxxyz", "acde bcdf", "a.b|c", "Straße", "abccbd abcd", "a.b.c", "1abc", "aghixyz adgxyz", "abbc", "a lantern", "an abc.", "kelvin \u212aelvin", "süßes", "abcabcghi dxfghi", "cde", "bcd", "abcdefghi", "]bc a-bc", "xbcb", "bcbc", "abcdef", "a.cdef", "zbcd"]
    for text in samples:
        if rule.search(text):
            matched += 1
            assert holds(condition, text), (condition, text)
    assert matched


def test_conditions_that_say_much_or_nothing():
    assert grams.required("a.c") == grams.ANYTHING and grams.required("(abc|)") == grams.ANYTHING and grams.required(".*") == grams.ANYTHING
    assert grams.pieces_of(grams.required("(cold|small)")) == ["col", "old", "sma", "mal", "all"]
    assert holds(grams.required("xy(cold|warm)"), "xycold") and not holds(grams.required("xy(cold|warm)"), "xy warm xy cold")
    assert grams.pieces_of(grams.required("(?i)aéb cde")) == ["b c", " cd", "cde"]
    assert len(grams.pieces_of(grams.required("x" * 10 + "abcdefghijklmnopqrstuvwxyz" * 4))) <= grams.MOST_PIECES


# -- the index of pieces ---------------------------------------------------------------


@pytest.fixture(scope="module")
def index(spark, words):
    rows = RowDirectory.write(words, fresh_folder(spark, "test-rows"), cell_rows=250)
    return TrigramIndex.write(words, ["text", "owner"], fresh_folder(spark, "test-pieces"), rows)


@pytest.mark.parametrize("request_", [{"text": "ss-[lL]antern"}, {"text": "~rass.?Lan", "owner": "half"}, {"text": "(Brass-L|nowhere to be found)"}, {"text": "Lantern w", "owner": "~^o[0-9]"}])
def test_rare_patterns_read_few_row_groups(words, index, request_):
    found, plain = index.matching(words, request_), predicates.matching(words, request_)
    assert sorted(found.collect()) == sorted(plain.collect())
    assert 0 < rows_read(found) < 20_000 / 5 and rows_read(plain) >= 4 * rows_read(found)


@pytest.mark.parametrize("request_, mode", [({"text": "w.*w"}, "full"), ({"text": "^w"}, "simple"), ({"owner": "half"}, "disabled"), ({"text": "[0-9]{3}"}, "full"), ({}, "full"), ({"text": "no such text"}, "full"), ({"text": "~(w1|w2) "}, "full")])
def test_any_request_gives_the_same_rows(words, index, request_, mode):
    assert sorted(index.matching(words, request_, mode).collect()) == sorted(predicates.matching(words, request_, mode).collect())


def test_a_pattern_without_pieces_scans_and_ranges_are_bounded(words, index, monkeypatch):
    assert index.ranges([("text", grams.required("w.*w"))]) is None and index.narrowed(words, [("text", grams.ANYTHING)]) is words
    assert index.ranges([("text", grams.required("never-seen"))]) == []
    from recordloom.plans import trigram_index

    monkeypatch.setattr(trigram_index, "MOST_RANGES", 3)
    spans = index.ranges([("owner", grams.pieces("o17"))])
    assert 0 < len(spans) <= 4
    assert sorted(index.matching(words, {"owner": "o17"}).collect()) == sorted(predicates.matching(words, {"owner": "o17"}).collect())


def test_contains_ignoring_case(words, index):
    found = index.contains_ignoring_case(words, "text", "bRASS-lANTERN")
    assert len(found.collect()) == 3 and rows_read(found) < 20_000 / 5


# -- the row directory -------------------------------------------------------------------


def test_gaps_between_files_do_not_widen_cells(spark):
    k = F.col("id")
    rows = spark.range(0, 5_000).select((k * 50 + F.expr("id div 500") * (1 << 33)).alias(ROWNR))
    directory = RowDirectory.write(rows, fresh_folder(spark, "test-rows"), cell_rows=100)
    assert 40 <= directory.cells.count() <= 90
    assert [r[0] for r in directory.rows(rows, 2_499, 3).collect()] == [(i * 50 + i // 500 * (1 << 33)) for i in (2499, 2500, 2501)]


def test_rows_before(spark, monkeypatch):
    from recordloom.plans import row_directory

    monkeypatch.setattr(row_directory, "FAN", 4)
    rng = random.Random(2)
    cells = sorted(rng.sample(range(500), 200))
    rows = [(c, rng.randint(1, 9)) for c in cells]
    got = {r["cell"]: r["before"] for r in with_rows_before(spark.createDataFrame(rows, "cell long, rows long"), 499).collect()}
    assert got == {c: sum(n for d, n in rows if d < c) for c, _ in rows}


@pytest.mark.parametrize("cell_rows", [1, 64, 8192])
def test_directory_pages(spark, words, cell_rows):
    directory = RowDirectory.write(words, fresh_folder(spark, "test-rows"), cell_rows)
    assert directory.count() == 20_000
    for offset in (0, 1, 4_999, 12_345, 19_950, 20_000, 10**12):
        assert directory.page(words, 100, offset).collect() == paging.page_of(words, 100, offset).collect()
    numbers = [r[0] for r in words.select(ROWNR).orderBy(ROWNR).collect()]
    for rownr in (-5, 11, 12, numbers[7_000], numbers[7_000] + 1, numbers[-1], 10**15):
        assert directory.rank(rownr, words) == sum(n < rownr for n in numbers)


def test_a_page_far_behind_reads_one_row_group(spark):
    """Nine million rows before the page; 12 files of a million rows."""
    rows = spark.range(0, 12_000_000, 1, 12).select((F.col("id") * 3).alias(ROWNR), F.col("id").cast("string").alias("v"))
    folder = fresh_folder(spark, "test-many")
    rows.write.parquet(folder)
    stored = spark.read.parquet(folder)
    directory = RowDirectory.write(stored, fresh_folder(spark, "test-rows"))
    page = directory.page(stored, 10, 9_000_000)
    assert [r["v"] for r in page.collect()] == [str(9_000_000 + i) for i in range(10)]
    assert rows_read(page) <= 1_000_000 and page.first()["result_count"] == 12_000_000


def test_directory_of_no_rows(spark):
    empty = spark.createDataFrame([], f"{ROWNR} long, a string")
    directory = RowDirectory.write(empty, fresh_folder(spark, "test-rows"))
    assert directory.count() == 0 and directory.page(empty, 10).collect() == [] and directory.rank(5, empty) == 0
    order = OrderDirectory.write(empty, "a", fresh_folder(spark, "test-order"))
    assert order.page(empty, 10).collect() == []


# -- the order directory ------------------------------------------------------------------


@pytest.mark.parametrize("label", ["owner", "text"])
def test_sorted_directory_pages(spark, words, label, monkeypatch):
    from recordloom.plans import order_directory

    monkeypatch.setattr(order_directory, "PARTITION_ROWS", 3_000)
    directory = OrderDirectory.write(words, label, fresh_folder(spark, "test-order"), cell_rows=500)
    present = directory.shape["present"]
    for down in (False, True):
        whole = words.orderBy(*paging.sort_columns(["text", "owner"], f"{label},{'desc' if down else 'asc'}")).collect()
        for offset in (0, 1, 4_900, 9_990, 13_333, present - 30, present + 7, 19_990, 30_000):
            got = directory.page(words, 60, offset, down).drop("result_count").collect()
            assert got == whole[offset : offset + 60], (label, down, offset)
    assert rows_read(directory.entries_at(12_000, 12_050)) < 20_000 / 3


def test_a_long_sorted_page_and_merged_loads(spark, words, monkeypatch):
    from recordloom.plans import order_directory

    monkeypatch.setattr(order_directory, "LISTED", 50)
    parts = [words.where(f"{ROWNR} % 2 = {i}") for i in (0, 1)]
    held = [OrderDirectory.write(p, "owner", fresh_folder(spark, "test-order"), 300) for p in parts]
    merged = OrderDirectory.merged(held, fresh_folder(spark, "test-order"), 700)
    got = merged.page(words, 2_000, 9_000, True).collect()
    assert got == paging.page_of(words, 2_000, 9_000, "owner,desc").collect()
    with pytest.raises(ValueError):
        OrderDirectory.merged([held[0], OrderDirectory.write(parts[1], "text", fresh_folder(spark, "test-order"))], fresh_folder(spark, "test-order"))


# -- the interleaved layout --------------------------------------------------------------


def test_interleaved_layout_skips_for_each_column(spark):
    k = F.col("id")
    code = lambda salt, mod: F.lpad((F.crc32(F.concat_ws("-", k, F.lit(salt)).cast("binary")) % mod).cast("string"), 5, "0")
    rows = spark.range(0, 64_000, 1, 4).select(k.alias(ROWNR), code(1, 3000).alias("a"), code(2, 2000).alias("b"), F.when(k % 3 != 0, code(3, 900)).alias("c"))
    folder, plain = fresh_folder(spark, "test-layout"), fresh_folder(spark, "test-plain")
    interleaved.write_interleaved_layout(rows, folder, ["a", "b", "c"], file_rows=1000)
    rows.write.option("maxRecordsPerFile", 1000).parquet(plain)
    laid, old = spark.read.parquet(folder), spark.read.parquet(plain)
    assert sorted(laid.collect()) == sorted(old.collect())
    for request in ({"a": "00017"}, {"b": "01999"}, {"c": "00400"}):
        found, before = predicates.matching(laid, request), predicates.matching(old, request)
        assert sorted(found.collect()) == sorted(before.collect()) != []
        assert rows_read(found) < 0.3 * 64_000 and rows_read(found) < 0.8 * rows_read(before)
    both = predicates.matching(laid, {"a": "00017", "b": "01999"})
    assert rows_read(both) <= 64_000 / 5
    with pytest.raises(ValueError):
        interleaved.write_interleaved_layout(rows, folder, ["nosuch"])


def test_interleaved_ranks(spark):
    cuts = ["b", "d", "f"]
    got = spark.createDataFrame([(x,) for x in ["a", "b", "c", "d", "e", "f", "z", None]], "v string").select(interleaved.rank(F.col("v"), cuts)).collect()
    assert [r[0] for r in got] == [0, 1, 1, 2, 2, 3, 3, 0]
    key = spark.range(1).select(interleaved.interleaved([F.lit(5), F.lit(2)], [7, 3])).first()[0]
    assert key == 0b110_01  # bits 1,1 then 0,0 then 1
    assert interleaved.splitters(spark.createDataFrame([], f"{ROWNR} long, v string"), ["v"], 0) == {"v": []}


# -- stored datasets -----------------------------------------------------------------------


def test_indexed_datasets_answer_alike(spark, catalog, write_file, monkeypatch):
    monkeypatch.setattr(indexed, "MANY_ROWS", 200)
    line = lambda i: f"name {i % 7},{'' if i % 5 else 'x' * (i % 90)},note {i}{' zebra-crossing' if i == 333 else ''}\n"
    dataset_id, _ = create_from_csv(catalog, write_file("Name,Size,Note\n" + "".join(map(line, range(400)))))
    assert indexed.row_directory(catalog, catalog.segments(dataset_id)[0]["path"]) is not None
    load_csv(catalog, dataset_id, write_file("Size,Note,Name\n" + "".join(f"s{i},note {i},name {i % 3}\n" for i in range(300))))
    requests = [{}, {"_limit": "7", "_offset": "395"}, {"_offset": "699"}, {"_offset": "700"}, {"_sort": "name,desc", "_offset": "350", "_limit": "20"}, {"_sort": "size,asc", "_offset": "10"}, {"note": "zebra[- ]cross"}, {"NOTE": "note 29", "name": "~[12]"}, {"note": "~e 2.$", "_limit": "5", "_offset": "3"}]
    for step in range(3):
        if step:
            indexed.index(catalog, dataset_id, pieces_of=["Note"], order_by=["name", "size"] if step > 1 else ["name"])
        for request in requests:
            assert indexed.query(catalog, dataset_id, request).collect() == catalog.query(dataset_id, request).collect(), (step, request)
    assert indexed.row_count(catalog, dataset_id) == 700
    load_csv(catalog, dataset_id, write_file("Name,Size,Note\nlast,1,zebra cross\n"))
    for request in requests:
        assert indexed.query(catalog, dataset_id, request).collect() == catalog.query(dataset_id, request).collect()
    assert indexed.query(catalog, dataset_id, {"note": "zebra[- ]cross"}).count() == 2


# -- one answer for loads and scans, names of the total --------------------------------------


def test_scans_and_loads_agree_on_late_characters(spark, catalog, write_file):
    plain = "".join(f"{i},plain ascii text to fill the head of the file {i}\n" for i in range(16_000))
    path = write_file(("a,b\n" + plain).encode() + "1,Åkesson é\n".encode("cp1252"))
    got = scan_csv(spark, path).where("b like '%kesson%'").collect()
    assert [r["b"] for r in got] == ["Åkesson é"]
    dataset_id, _ = create_from_csv(catalog, path)
    assert [r["b"] for r in catalog.records(dataset_id).where("b like '%kesson%'").collect()] == ["Åkesson é"]
    mixed = write_file(("a,b\n" + plain + "1,Åkesson é\n2,née\n").encode() + b"3,x\xffy\n")
    assert [r["b"] for r in scan_csv(spark, mixed).where("a < '4' and b not like 'plain%'").collect()] == ["Åkesson é", "née", "x�y"]


@pytest.mark.parametrize("names", [["result_count"], ["result_count", "__result_count"], ["__result_count"], ["____result_count", "result_count"]])
def test_columns_named_like_the_total(spark, catalog, write_file, names):
    dataset_id, _ = create_from_csv(catalog, write_file(",".join(names) + "\n" + ",".join(str(17 + i) for i in range(len(names))) + "\n"))
    page = catalog.query(dataset_id)
    row, total = page.first(), paging.counted_by(page)
    assert [row[n] for n in names] == [str(17 + i) for i in range(len(names))] and row[total] == 1 and total not in names
    whole = paging.envelope(page, 100).first()
    assert whole["result_count"] == 1 and whole["results"][0].asDict() == {n: str(17 + i) for i, n in enumerate(names)}


def test_reserved_name_is_refused(spark, write_file):
    with pytest.raises(LoadRejected):
        scan_csv(spark, write_file("__rownr,a\n1,2\n"))


# -- fingerprints ------------------------------------------------------------------------------


def test_fingerprints_of_tables(spark):
    schema = f"{ROWNR} long, a string, b string"
    rows = [(1, "x", "y"), (2, "x", "y"), (3, None, "x"), (4, "", "x"), (5, "x", None)]
    table = lambda r: fingerprint.of_table(spark.createDataFrame(r, schema))
    whole = table(rows)
    assert whole == table(rows[::-1]) == fingerprint.of_table(spark.createDataFrame(rows, schema).select("b", ROWNR, "a").repartition(3))
    assert whole == fingerprint.added([table(rows[:2]), table(rows[2:])]) and whole.startswith("5:")
    for other in (rows[1:], [*rows, rows[0]], [(1, "y", "x"), *rows[1:]], [*rows[:2], (3, "", "x"), (4, "", "x"), rows[4]], [*rows[:2], (3, "x", None), *rows[3:]]):
        assert table(other) != whole
    assert table([]) == fingerprint.added([]) and table([(1, None, "b")]) != table([(1, "b", None)])


def test_datasets_are_compared_without_reading_them(spark, catalog, write_file, monkeypatch):
    path = write_file("a,b\n1,x\n1,x\n2\n")
    first, _ = create_from_csv(catalog, path)
    other, _ = create_from_csv(catalog, write_file("B;A\nx;1\n;2\nx;1\n"))
    again, _ = create_from_csv(catalog, [path, write_file("b,a\nx,1\n")])
    monkeypatch.setattr(indexed, "_records", None)
    assert indexed.same_rows(catalog, first, first) and not indexed.same_rows(catalog, first, other)  # absent is not empty
    assert not indexed.same_rows(catalog, first, again)
    assert indexed.loaded_already(catalog, first, path) and not indexed.loaded_already(catalog, again, path)
    load_csv(catalog, other, path)
    assert indexed.loaded_already(catalog, other, path) and not indexed.loaded_already(catalog, other, write_file("a,b\n1,x\n"))
