"""Life of a dataset: load, look up, name, append, replace, drop."""

import pytest

from conftest import STATION_FILE, STATION_FILE_SEMICOLON, STATION_ROWS, read_back, stored
from recordloom import errors
from recordloom.operators import paging, registry
from recordloom.plans.load import create_from_csv, load_csv

LABELS = ["code", "place", "open since"]


def page(catalog, dataset_id, **request):
    return [tuple(r) for r in catalog.query(dataset_id, request).drop("__rownr").collect()]


def test_create_info_and_alias_life(spark, catalog, write_file):
    dataset_id, status = create_from_csv(catalog, write_file(STATION_FILE))
    assert status == registry.AVAILABLE and stored(catalog, dataset_id) == STATION_ROWS
    other, _ = create_from_csv(catalog, write_file("a,b\n1,2"))
    assert catalog.aliases_of(dataset_id) == []
    assert catalog.set_aliases(dataset_id, ["people"]) and catalog.aliases_of(dataset_id) == ["people"]
    assert catalog.add_aliases(dataset_id, ["people", "persons"]) and len(catalog.aliases_of(dataset_id)) == 2
    assert not catalog.set_aliases(other, ["free", "people"]) and catalog.aliases_of(other) == []
    assert not catalog.set_aliases(other, [dataset_id]) and not catalog.set_aliases(other, ["no blanks"])
    assert catalog.set_aliases(other, ["été9"])
    info = catalog.info("people", "http://host/").first()
    assert (info["status"], info["rowcount"], info["columnnames"]) == (3, len(STATION_ROWS), LABELS)
    assert info["identifier"] == dataset_id and info["@id"] == f"http://host/dataset/{dataset_id}"
    assert info["aliases"] == ["people", "persons"]
    assert catalog.set_aliases(dataset_id, []) and catalog.aliases_of(dataset_id) == []
    with pytest.raises(errors.NotFound):
        catalog.resolve("people")
    catalog.drop(other)
    assert not catalog.exists(other) and catalog.exists(dataset_id) and not catalog.exists("people")
    assert registry.dataset_count(catalog.datasets()).first()["amount"] == 1
    assert catalog.aliases().count() == 0


def test_queries(catalog, write_file, tmp_path):
    dataset_id, _ = create_from_csv(catalog, write_file(STATION_FILE))
    by_place = {row[1]: row for row in STATION_ROWS}
    north, south = (by_place[p] for p in ("Troms\u00f8", "Malm\u00f8"))
    assert page(catalog, dataset_id, PLACE="Harbour") == [by_place["Harbour"] + (1,)]
    assert page(catalog, dataset_id, **{"open since": "1907"}) == [north + (2,), south + (2,)]
    assert page(catalog, dataset_id, place='(\u00f8$|"Old")') == [r + (3,) for r in STATION_ROWS if r[1] and (r[1].endswith("\u00f8") or '"Old"' in r[1])]
    assert page(catalog, dataset_id, place="m\u00f8$") == [south + (1,)]
    assert page(catalog, dataset_id, code="1[37]", _limit="1") == [north + (2,)]
    assert page(catalog, dataset_id, code="1[37]", _limit="1", _offset="1") == [south + (2,)]
    assert page(catalog, dataset_id, place="") == [by_place[""] + (1,)] and page(catalog, dataset_id, code="7") == []
    for request, error in (
        ({"nosuch": "1"}, errors.UnknownColumn),
        ({"format": "json"}, errors.UnknownColumn),
        ({"place": "x", "PLACE": "y"}, errors.UnknownColumn),
        ({"place": "~"}, errors.BadPattern),
        ({"place": "(x"}, errors.BadPattern),
        ({"_limit": "ten"}, errors.BadNumber),
        ({"_offset": "1.5"}, errors.BadNumber),
    ):
        with pytest.raises(error):
            catalog.query(dataset_id, request)
    empty = catalog.create()
    with pytest.raises(errors.NotReady):
        catalog.query(empty)
    with pytest.raises(errors.NotReady):
        catalog.export(empty, str(tmp_path / "none"))
    catalog.export(dataset_id, str(tmp_path / "csv"))
    exported = [tuple(cell or "" for cell in row) for row in STATION_ROWS]  # one cell per column
    assert stored(catalog, create_from_csv(catalog, str(tmp_path / "csv"))[0]) == exported
    catalog.export(dataset_id, str(tmp_path / "json"), form="json")
    assert catalog.spark.read.json(str(tmp_path / "json")).count() == len(STATION_ROWS)
    with pytest.raises(errors.Locked):
        catalog.drop(empty)


def test_append_and_replace(catalog, write_file):
    dataset_id, status = create_from_csv(catalog, write_file(STATION_FILE.encode("cp1252")))
    assert status == registry.AVAILABLE and stored(catalog, dataset_id) == STATION_ROWS
    assert load_csv(catalog, dataset_id, write_file(STATION_FILE_SEMICOLON)) == registry.AVAILABLE
    assert read_back(STATION_FILE_SEMICOLON, ";") == STATION_ROWS and stored(catalog, dataset_id) == STATION_ROWS * 2
    numbers = [r[0] for r in catalog.records(dataset_id).select("__rownr").collect()]
    assert len(set(numbers)) == 2 * len(STATION_ROWS)
    assert load_csv(catalog, dataset_id, write_file("name,b\n1,2")) == registry.ERROR
    assert load_csv(catalog, dataset_id, write_file(STATION_FILE + ",6"), mode="replace") == registry.ERROR
    assert stored(catalog, dataset_id) == STATION_ROWS * 2
    assert load_csv(catalog, dataset_id, write_file("x\n1\n2"), mode="replace") == registry.AVAILABLE
    assert stored(catalog, dataset_id) == [("1",), ("2",)]
    catalog.remove_replaced(dataset_id)
    assert stored(catalog, dataset_id) == [("1",), ("2",)]


def test_append_reordered_columns_and_after_header_only(catalog, write_file):
    dataset_id, status = create_from_csv(catalog, write_file("q,r"))
    assert status == registry.AVAILABLE and stored(catalog, dataset_id) == []
    assert load_csv(catalog, dataset_id, write_file("a,b\n1,2")) == registry.AVAILABLE
    assert load_csv(catalog, dataset_id, write_file("B,a\n4,3")) == registry.AVAILABLE
    assert stored(catalog, dataset_id) == [("1", "2"), ("3", "4")]


def test_interrupted_loads_become_errors(catalog):
    dataset_id = catalog.create()
    catalog.set_status(dataset_id, registry.PROCESSING)
    assert registry.service_counters(catalog.datasets(), "1").first()["active_loads"] == 1
    catalog.settle_interrupted()
    assert catalog.status(dataset_id) == registry.ERROR


def test_folder_of_files_is_one_load(catalog, write_file, tmp_path):
    write_file("a,b\n1,2\n", "drop/p1.csv")
    write_file("a,b\n3,4\n", "drop/p 2.csv")
    write_file("b;a\n6;5\n", "drop/p[3].csv")
    write_file("a,b\n7,é\n".encode("cp1252"), "drop/p4.csv")
    dataset_id, status = create_from_csv(catalog, str(tmp_path / "drop"))
    assert status == registry.AVAILABLE
    assert sorted(stored(catalog, dataset_id)) == [("1", "2"), ("3", "4"), ("5", "6"), ("7", "é")]
    write_file("a,c\n1,2\n", "drop/p5.csv")
    assert load_csv(catalog, dataset_id, str(tmp_path / "drop")) == registry.ERROR
    assert catalog.records(dataset_id).count() == 4


def test_lookup_columns_use_exact_lengths(catalog, write_file):
    dataset_id, _ = create_from_csv(catalog, write_file("a,b\n" + "x" * 256 + "," + "y" * 257))
    assert catalog.lookup_columns(dataset_id) == ["a"]


def test_a_label_may_be_called_result_count(catalog, write_file):
    dataset_id, _ = create_from_csv(catalog, write_file("result_count,b\n17,x\n18,x\n"))
    rows = catalog.query(dataset_id, {"b": "x"}).collect()
    assert [(r["result_count"], r["__result_count"]) for r in rows] == [("17", 2), ("18", 2)]
    whole = paging.envelope(catalog.query(dataset_id, {"b": "x"}), 100).first()
    assert whole["result_count"] == 2 and [r["result_count"] for r in whole["results"]] == ["17", "18"]


def test_far_offsets(catalog, write_file):
    dataset_id, _ = create_from_csv(catalog, write_file("a\n1\n"))
    assert catalog.query(dataset_id, {"_offset": str(2**40)}).collect() == []


def test_unpublished_entry_is_an_error(catalog, monkeypatch):
    dataset_id = catalog.create()
    real = catalog._filesystem

    class NoRename:
        def __init__(self, fs):
            self.fs = fs

        def __getattr__(self, name):
            return (lambda *_: False) if name == "rename" else getattr(self.fs, name)

    monkeypatch.setattr(catalog, "_filesystem", lambda path: (NoRename(real(path)[0]), real(path)[1]))
    with pytest.raises(OSError):
        catalog.set_status(dataset_id, registry.PROCESSING)


def test_questions_about_a_dataset_read_its_own_entries(spark, catalog):
    mine, other = catalog.create(), catalog.create()
    for n in range(50):
        catalog.set_status(other, registry.ACCEPTED)
    assert catalog.log("status").count() == 52 and len(catalog.log("status", mine).inputFiles()) == 1
    assert catalog.resolve(mine) == mine and catalog.status(mine) == registry.CREATED
    for unknown in ("../status", "00000000-0000-0000-0000-000000000000"):
        assert not catalog.exists(unknown)
        with pytest.raises(errors.NotFound):
            catalog.status(unknown)
