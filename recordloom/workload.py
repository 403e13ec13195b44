"""Named queries over the test tables, each with the SQL that must agree.

Every query reads whole tables; those that load or export first write the
table as CSV or JSON into the shared folder and then run the loader on it.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from recordloom.functions import ids, patterns, text, web
from recordloom.operators import paging, predicates, profile, registry, sets, traffic
from recordloom.plans import export, indexed, interleaved, load
from recordloom.plans.catalog import Catalog
from recordloom.plans.order_directory import OrderDirectory, sorted_page as directory_sorted
from recordloom.plans.row_directory import RowDirectory
from recordloom.plans.trigram_index import TrigramIndex
from recordloom.session import fresh_folder
from recordloom.sources import csv_records, records, sniff
from recordloom.sources.records import ROWNR, as_records
from recordloom.streaming import drop_folder
from recordloom.streaming import traffic as stream_traffic

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def case(sql: str | None = None):
    def register(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLES[fn.__name__] = sql
        return fn

    return register


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf.rstrip('/')}/{name}.parquet")


# -- record views of the tables ---------------------------------------------

ORDERS = ["o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority"]
ORDERS_SQL = """o_orderkey AS __rownr, CAST(o_orderkey AS VARCHAR) AS o_orderkey,
    CAST(o_custkey AS VARCHAR) AS o_custkey, o_orderstatus, o_orderpriority"""
PART = ["p_partkey", "p_name", "p_brand", "p_type", "p_size"]
PART_SQL = """CAST(p_partkey AS VARCHAR) AS p_partkey, p_name, p_brand, p_type, CAST(p_size AS VARCHAR) AS p_size"""
CUSTOMER = ["c_custkey", "c_name", "c_nationkey", "c_mktsegment"]
CUSTOMER_SQL = """CAST(c_custkey AS VARCHAR) AS c_custkey, c_name, CAST(c_nationkey AS VARCHAR) AS c_nationkey, c_mktsegment"""
SUPPLIER = ["s_suppkey", "s_name", "s_nationkey"]
SUPPLIER_SQL = "CAST(s_suppkey AS VARCHAR) AS s_suppkey, s_name, CAST(s_nationkey AS VARCHAR) AS s_nationkey"
DOCUMENTS = ["doc_id", "lang", "source", "text"]
DOCUMENTS_SQL = "CAST(doc_id AS VARCHAR) AS doc_id, lang, source, text"


def orders(spark, sf):
    return as_records(table(spark, sf, "orders"), ORDERS, "o_orderkey")


def part(spark, sf):
    return as_records(table(spark, sf, "part"), PART, "p_partkey")


def customer(spark, sf):
    return as_records(table(spark, sf, "customer"), CUSTOMER, "c_custkey")


def supplier(spark, sf):
    return as_records(table(spark, sf, "supplier"), SUPPLIER, "s_suppkey")


def documents(spark, sf):
    return as_records(table(spark, sf, "documents"), DOCUMENTS, "doc_id")


# -- filters -----------------------------------------------------------------


@case(f"SELECT {ORDERS_SQL} FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority = '1-URGENT'")
def equality_filter(spark, sf):
    return predicates.matching(orders(spark, sf), {"O_OrderStatus": "F", "o_orderpriority": "1-URGENT"})


@case(f"SELECT s_suppkey AS __rownr, {SUPPLIER_SQL} FROM supplier")
def no_filter_scan(spark, sf):
    return predicates.matching(supplier(spark, sf), {})


@case(f"SELECT p_partkey AS __rownr, {PART_SQL} FROM part WHERE regexp_matches(p_name, '(cold|small)')")
def regex_full(spark, sf):
    return predicates.matching(part(spark, sf), {"P_Name": "(cold|small)"})


@case(f"SELECT p_partkey AS __rownr, {PART_SQL} FROM part WHERE regexp_matches(p_name, 'd w.dget')")
def regex_forced(spark, sf):
    return predicates.matching(part(spark, sf), {"p_name": "~d w.dget"})


@case(f"SELECT p_partkey AS __rownr, {PART_SQL} FROM part WHERE starts_with(p_name, 'cold')")
def regex_simple_prefix(spark, sf):
    return predicates.matching(part(spark, sf), {"p_name": "^cold"}, mode="simple")


@case(
    f"""SELECT p_partkey AS __rownr, CAST(p_partkey AS VARCHAR) AS p_partkey, '~' || p_name AS p_name, p_brand, p_type,
    CAST(p_size AS VARCHAR) AS p_size FROM part WHERE '~' || p_name = '~cold widget'"""
)
def regex_disabled_literal(spark, sf):
    marked = part(spark, sf).withColumn("p_name", F.concat(F.lit("~"), "p_name"))
    return predicates.matching(marked, {"p_name": "~cold widget"}, mode="disabled")


@case(
    f"""SELECT p_partkey AS __rownr, {PART_SQL} FROM part
    WHERE regexp_matches(p_brand, '^Brand#[0-9]{{2}}$') AND regexp_matches(p_name, '\\b[a-z]{{4}}\\b')"""
)
def regex_dialect(spark, sf):
    return predicates.matching(part(spark, sf), {"p_brand": "^Brand#[[:digit:]]{2}$", "p_name": r"~\m[a-z]{4}\M"})


@case("SELECT doc_id FROM documents WHERE regexp_matches(text, '(?s)^[A-Z].*\n.*[.]$')")
def regex_across_lines(spark, sf):
    return predicates.matching(documents(spark, sf), {"text": "^[A-Z].*\n.*[.]$"}).select(F.col(ROWNR).alias("doc_id"))


@case(r"SELECT doc_id, regexp_matches(text, '[\^$(|\[*+{?/]') AS is_pattern FROM documents")
def regex_sniff(spark, sf):
    docs = table(spark, sf, "documents")
    return docs.select("doc_id", patterns.looks_like_pattern_column(F.col("text")).alias("is_pattern"))


@case(f"SELECT p_partkey AS __rownr, {PART_SQL} FROM part WHERE contains(lower(p_type), 'onom')")
def contains_ci(spark, sf):
    return predicates.contains_ignoring_case(part(spark, sf), "p_type", "OnOm")


@case(f"SELECT p_partkey AS __rownr, {PART_SQL} FROM part WHERE lower(p_type) = 'economy'")
def equals_ci(spark, sf):
    return predicates.equals_ignoring_case(part(spark, sf), "p_type", "Economy")


@case(
    """WITH t AS (SELECT c_custkey AS id, CASE WHEN c_mktsegment = 'FURNITURE' THEN NULL
      WHEN c_mktsegment = 'MACHINERY' THEN '' ELSE c_mktsegment END AS seg FROM customer)
    SELECT 'empty' AS probe, id FROM t WHERE seg = '' UNION ALL SELECT 'any' AS probe, id FROM t WHERE seg IS NOT NULL"""
)
def missing_vs_empty(spark, sf):
    seg = F.when(F.col("c_mktsegment") == "FURNITURE", None).when(F.col("c_mktsegment") == "MACHINERY", "")
    rows = customer(spark, sf).withColumn("c_mktsegment", seg.otherwise(F.col("c_mktsegment")))
    empty = predicates.matching(rows, {"c_mktsegment": ""}).select(F.lit("empty").alias("probe"), F.col(ROWNR).alias("id"))
    present = predicates.matching(rows, {"c_mktsegment": "~.*"}).select(F.lit("any").alias("probe"), F.col(ROWNR).alias("id"))
    return empty.unionAll(present)


# -- pages -------------------------------------------------------------------


@case(
    f"""SELECT {ORDERS_SQL}, count(*) OVER () AS result_count FROM orders WHERE o_orderstatus = 'F'
    ORDER BY __rownr LIMIT 20 OFFSET 40"""
)
def page(spark, sf):
    return paging.query(orders(spark, sf), {"o_orderstatus": "F"}, limit=20, offset=40)


@case(
    f"""SELECT {ORDERS_SQL}, count(*) OVER () AS result_count FROM orders WHERE o_orderpriority = '2-HIGH'
    ORDER BY __rownr LIMIT 100 OFFSET 1000000000"""
)
def page_past_end(spark, sf):
    return paging.query(orders(spark, sf), {"o_orderpriority": "2-HIGH"}, limit=100_000, offset=1_000_000_000)


@case(
    f"""SELECT {ORDERS_SQL}, count(*) OVER () AS result_count FROM orders
    ORDER BY o_orderpriority DESC, __rownr LIMIT 25 OFFSET 10"""
)
def sorted_page(spark, sf):
    return paging.query(orders(spark, sf), {}, limit=25, offset=10, sort="O_OrderPriority,desc")


@case(
    """WITH m AS (SELECT * FROM orders WHERE o_orderstatus = 'O'),
    p AS (SELECT o_orderkey, o_custkey FROM m ORDER BY o_orderkey LIMIT 10 OFFSET 10),
    n AS (SELECT count(*) AS n FROM m)
    SELECT (SELECT CAST(to_json(list({'o_orderkey': CAST(o_orderkey AS VARCHAR), 'o_custkey': CAST(o_custkey AS VARCHAR)}
      ORDER BY o_orderkey)) AS VARCHAR) FROM p) AS results,
      10 AS "limit", 10 AS "offset", n AS result_count, 0 AS prev_offset,
      CASE WHEN n >= 20 THEN 20 END AS next_offset,
      'http://host/dataset/x/json?_offset=0&_limit=10&o_orderstatus=O' AS prev,
      CASE WHEN n >= 20 THEN 'http://host/dataset/x/json?_offset=20&_limit=10&o_orderstatus=O' END AS next FROM n"""
)
def page_envelope(spark, sf):
    rows = orders(spark, sf).select(ROWNR, "o_orderkey", "o_custkey", "o_orderstatus")
    request = {"o_orderstatus": "O", "_limit": "10", "_offset": "10"}
    found = paging.query_request(rows, request).drop("o_orderstatus")
    out = paging.envelope(found, 10, 10, base_url="http://host/dataset/x", others=request)
    return out.withColumn("results", F.to_json("results")).drop("query_time")


# -- profiles ----------------------------------------------------------------

GAPPY_SQL = """SELECT c_custkey, nullif(c_custkey, 0) AS a, CASE WHEN c_custkey >= 0 THEN c_name END AS b,
    CASE WHEN c_custkey < 0 THEN c_name END AS c, CASE WHEN c_mktsegment <> 'FURNITURE' THEN c_mktsegment END AS d FROM customer"""


def gappy(spark, sf):
    c = table(spark, sf, "customer")
    key = F.col("c_custkey")
    return c.select(
        key.alias(ROWNR),
        key.cast("string").alias("c_custkey"),
        F.when(key != 0, key.cast("string")).alias("a"),
        F.when(key >= 0, F.col("c_name")).alias("b"),
        F.when(key < 0, F.col("c_name")).alias("c"),
        F.when(F.col("c_mktsegment") != "FURNITURE", F.col("c_mktsegment")).alias("d"),
    )


@case("SELECT count(*) AS row_count FROM lineitem")
def row_count(spark, sf):
    return profile.row_count(table(spark, sf, "lineitem"))


@case("SELECT min(o_orderkey) AS min_rownr FROM orders")
def first_rownr(spark, sf):
    return profile.first_rownr(orders(spark, sf))


@case(
    f"""WITH g AS ({GAPPY_SQL}), f AS (SELECT * FROM g WHERE c_custkey = (SELECT min(c_custkey) FROM g))
    SELECT 'c_custkey' AS column_name FROM f UNION ALL SELECT 'a' FROM f WHERE a IS NOT NULL
    UNION ALL SELECT 'b' FROM f WHERE b IS NOT NULL UNION ALL SELECT 'c' FROM f WHERE c IS NOT NULL
    UNION ALL SELECT 'd' FROM f WHERE d IS NOT NULL"""
)
def column_names(spark, sf):
    return profile.column_names(gappy(spark, sf))


@case(
    f"""WITH g AS ({GAPPY_SQL}) SELECT 'c_custkey' AS column_name UNION ALL
    SELECT 'a' WHERE EXISTS (SELECT 1 FROM g WHERE a IS NOT NULL) UNION ALL
    SELECT 'b' WHERE EXISTS (SELECT 1 FROM g WHERE b IS NOT NULL) UNION ALL
    SELECT 'c' WHERE EXISTS (SELECT 1 FROM g WHERE c IS NOT NULL) UNION ALL
    SELECT 'd' WHERE EXISTS (SELECT 1 FROM g WHERE d IS NOT NULL)"""
)
def all_column_names(spark, sf):
    return profile.all_column_names(gappy(spark, sf))


@case(
    """SELECT 'doc_id' AS column_name, max(length(CAST(doc_id AS VARCHAR))) AS max_length FROM documents
    UNION ALL SELECT 'lang', max(length(lang)) FROM documents UNION ALL SELECT 'source', max(length(source)) FROM documents
    UNION ALL SELECT 'text', max(length(text)) FROM documents"""
)
def max_lengths(spark, sf):
    return profile.max_lengths(documents(spark, sf))


# -- side tables ----------------------------------------------------------------


def _stored(spark: SparkSession, rows: DataFrame) -> DataFrame:
    folder = fresh_folder(spark, "records")
    rows.write.parquet(folder)
    return spark.read.parquet(folder)


@case(
    r"""SELECT doc_id FROM documents WHERE regexp_matches(text, '([Aa]ll|no) rights? reserved') AND NOT contains(lang, '?')
    UNION ALL SELECT -1 - doc_id FROM documents WHERE contains(lower(text), 'rights reserved')"""
)
def trigram_regex(spark, sf):
    """Two unanchored searches through an index of pieces, one of them ignoring case."""
    rows = _stored(spark, documents(spark, sf))
    directory = RowDirectory.write(rows, fresh_folder(spark, "rows"), cell_rows=64)
    index = TrigramIndex.write(rows, ["text", "lang"], fresh_folder(spark, "pieces"), directory)
    found = index.matching(rows, {"text": "([Aa]ll|no) rights? reserved", "lang": "~[^?]"})
    any_case = index.contains_ignoring_case(rows, "text", "Rights Reserved")
    return found.select(F.col(ROWNR).alias("doc_id")).unionAll(any_case.select((-1 - F.col(ROWNR)).alias("doc_id")))


@case(
    f"""SELECT {ORDERS_SQL}, (SELECT count(*) FROM orders) AS result_count FROM orders
    ORDER BY __rownr LIMIT 100 OFFSET (SELECT count(*) * 2 // 3 FROM orders)"""
)
def directory_page(spark, sf):
    """A page far behind the start, whose place and total come from the row directory."""
    rows = _stored(spark, orders(spark, sf))
    directory = RowDirectory.write(rows, fresh_folder(spark, "rows"))
    return directory.page(rows, 100, directory.count() * 2 // 3)


ORDER_SPLIT = """(SELECT o_orderkey, o_custkey, o_orderstatus, nullif(o_orderpriority, '5-LOW') AS p FROM orders)"""


@case(
    f"""WITH o AS {ORDER_SPLIT}, n AS (SELECT count(*) AS n FROM o),
    up AS (SELECT 'up' AS way, o_orderkey, p FROM o ORDER BY p ASC NULLS LAST, o_orderkey LIMIT 100 OFFSET (SELECT n // 2 FROM n)),
    down AS (SELECT 'down' AS way, o_orderkey, p FROM o ORDER BY p DESC NULLS LAST, o_orderkey LIMIT 100 OFFSET (SELECT n // 3 FROM n)),
    last AS (SELECT 'last' AS way, o_orderkey, p FROM o ORDER BY p DESC NULLS LAST, o_orderkey LIMIT 100 OFFSET (SELECT count(p) - 50 FROM o))
    SELECT x.*, n AS result_count FROM (SELECT * FROM up UNION ALL SELECT * FROM down UNION ALL SELECT * FROM last) x, n"""
)
def directory_sorted_page(spark, sf):
    """Deep pages by a column with five values and absent ones, up, down, and across the last value."""
    rows = orders(spark, sf).withColumn("o_orderpriority", F.expr("nullif(o_orderpriority, '5-LOW')"))
    rows = _stored(spark, rows)
    directory = OrderDirectory.write(rows, "o_orderpriority", fresh_folder(spark, "order"))
    total, present = directory.shape["rows"], directory.shape["present"]
    pages = [("up", "asc", total // 2), ("down", "desc", total // 3), ("last", "desc", present - 50)]
    found = [directory_sorted(directory, rows, 100, offset, f"o_orderpriority,{way}").withColumn("way", F.lit(name)) for name, way, offset in pages]
    columns = ["way", "o_orderkey", "o_orderpriority", "result_count"]
    out = found[0].select(*columns).unionAll(found[1].select(*columns)).unionAll(found[2].select(*columns))
    return out.select("way", F.col("o_orderkey").cast("long").alias("o_orderkey"), F.col("o_orderpriority").alias("p"), "result_count")


@case(
    f"""SELECT 'customer' AS key, o_orderkey AS __rownr FROM orders WHERE o_custkey = 7
    UNION ALL SELECT 'both', o_orderkey FROM orders WHERE o_orderpriority = '2-HIGH' AND o_orderstatus = 'F'"""
)
def interleaved_lookup(spark, sf):
    """Equality on different columns of one layout."""
    folder = fresh_folder(spark, "interleaved")
    interleaved.write_interleaved_layout(orders(spark, sf), folder, ["o_custkey", "o_orderpriority", "o_orderstatus"], file_rows=20_000)
    rows = spark.read.parquet(folder)
    one = predicates.matching(rows, {"o_custkey": "7"}).select(F.lit("customer").alias("key"), ROWNR)
    two = predicates.matching(rows, {"o_orderpriority": "2-HIGH", "o_orderstatus": "F"}).select(F.lit("both").alias("key"), ROWNR)
    return one.unionAll(two)


@case(
    """SELECT CAST(o_orderkey AS VARCHAR) AS result_count, CAST(o_custkey AS VARCHAR) AS __result_count, o_orderkey AS __rownr,
    count(*) OVER () AS ____result_count FROM orders ORDER BY o_orderkey LIMIT 50 OFFSET 20"""
)
def page_with_count_names(spark, sf):
    """Columns that are called like the total of a page stay as they are."""
    rows = orders(spark, sf).select(ROWNR, F.col("o_orderkey").alias("result_count"), F.col("o_custkey").alias("__result_count"))
    return paging.query(rows, {}, limit=50, offset=20)


@case(
    """WITH o AS (SELECT CAST(o_orderkey AS VARCHAR) AS k, o_orderpriority AS p, o_orderkey AS i FROM orders)
    SELECT k, p, (SELECT count(*) FROM o) AS result_count FROM o ORDER BY i LIMIT 100 OFFSET (SELECT count(*) - 150 FROM o)"""
)
def indexed_dataset_page(spark, sf):
    """A late page of a stored dataset of two loads, through the row directories of both."""
    catalog = _catalog(spark)
    rows = table(spark, sf, "orders").select(F.col("o_orderkey").alias(ROWNR), F.col("o_orderkey").cast("string").alias("k"), F.col("o_orderpriority").alias("p"))
    middle = rows.agg(F.expr(f"percentile_disc(0.5) within group (order by {ROWNR})")).first()[0]
    parts = [_csv_in_order(spark, part) for part in (rows.where(F.col(ROWNR) <= middle), rows.where(F.col(ROWNR) > middle))]
    dataset_id, _ = load.create_from_csv(catalog, parts[0])
    load.load_csv(catalog, dataset_id, parts[1])
    indexed.index(catalog, dataset_id)
    offset = indexed.row_count(catalog, dataset_id) - 150
    return indexed.query(catalog, dataset_id, {"_limit": "100", "_offset": str(offset)}).drop(ROWNR)


# -- the catalogue as tables ---------------------------------------------------

UUID_SQL = """substr(md5({0}), 1, 8) || '-' || substr(md5({0}), 9, 4) || '-' || substr(md5({0}), 13, 4) || '-' ||
    substr(md5({0}), 17, 4) || '-' || substr(md5({0}), 21, 12)"""
SUPPLIER_ID = UUID_SQL.format("s_name")
DATASETS_SQL = f"""SELECT {SUPPLIER_ID} AS id, CAST(s_suppkey % 5 AS INT) AS status,
    'data_' || md5(s_name) AS data_table FROM supplier"""
OWNER = "'Supplier#' || lpad(CAST(c_custkey % 97 AS VARCHAR), 9, '0')"
ALIASES_SQL = f"""SELECT {UUID_SQL.format(OWNER)} AS dataset_id, 'c' || c_custkey AS alias FROM customer WHERE c_custkey % 2 = 0"""
NAME_SQL = f"""CASE o_orderkey % 3 WHEN 0 THEN 'c' || o_custkey WHEN 1 THEN
    {UUID_SQL.format("'Supplier#' || lpad(CAST(o_custkey % 200 AS VARCHAR), 9, '0')")} ELSE 'x-' || o_custkey END"""


def uuid_of(c: Column) -> Column:
    h = F.md5(c)
    cuts = [(1, 8), (9, 4), (13, 4), (17, 4), (21, 12)]
    return F.concat_ws("-", *[F.substring(h, a, n) for a, n in cuts])


def _md5_uuid(name: str) -> uuid.UUID:
    return uuid.UUID(hashlib.md5(name.encode()).hexdigest())


def _supplier_named(c: Column) -> Column:
    return uuid_of(F.concat(F.lit("Supplier#"), F.lpad(c.cast("string"), 9, "0")))


def datasets(spark, sf):
    s = table(spark, sf, "supplier").withColumn("id", uuid_of(F.col("s_name")))
    status = (F.col("s_suppkey") % 5).cast("int").alias("status")
    return s.select("id", status, ids.table_name(F.col("id")).alias("data_table"))


def aliases(spark, sf):
    c = table(spark, sf, "customer").where("c_custkey % 2 = 0")
    key = F.col("c_custkey")
    return c.select(_supplier_named(key % 97).alias("dataset_id"), F.concat(F.lit("c"), key.cast("string")).alias("alias"))


def names(spark, sf):
    o, cust = F.col("o_orderkey") % 3, F.col("o_custkey")
    name = F.when(o == 0, F.concat(F.lit("c"), cust.cast("string"))).when(o == 1, _supplier_named(cust % 200))
    name = name.otherwise(F.concat(F.lit("x-"), cust.cast("string")))
    return table(spark, sf, "orders").select("o_orderkey", name.alias("name"))


@case(
    f"""WITH d AS ({DATASETS_SQL}), a AS ({ALIASES_SQL}), n AS (SELECT o_orderkey, {NAME_SQL} AS name FROM orders),
    w AS (SELECT n.*, coalesce(a.dataset_id, CASE WHEN regexp_matches(name, '^[0-9a-f]{{8}}(-[0-9a-f]{{4}}){{3}}-[0-9a-f]{{12}}$') THEN name END) AS wanted
      FROM n LEFT JOIN a ON n.name = a.alias)
    SELECT o_orderkey, name, d.id AS dataset_id, d.status, d.data_table, wanted IS NOT NULL AS valid
    FROM w LEFT JOIN d ON w.wanted = d.id"""
)
def alias_resolve(spark, sf):
    return registry.resolve_names(names(spark, sf), aliases(spark, sf), datasets(spark, sf))


@case(
    f"""WITH d AS ({DATASETS_SQL}), a AS ({ALIASES_SQL}), n AS (SELECT o_orderkey, {NAME_SQL} AS alias FROM orders)
    SELECT * FROM n WHERE alias NOT IN (SELECT id FROM d) AND alias NOT IN (SELECT alias FROM a)"""
)
def alias_available(spark, sf):
    candidates = names(spark, sf).withColumnRenamed("name", "alias")
    return registry.available_aliases(candidates, aliases(spark, sf), datasets(spark, sf))


REQUEST_SQL = f"""SELECT {SUPPLIER_ID} AS dataset_id,
    CASE s_suppkey % 4 WHEN 0 THEN 'new' || s_suppkey WHEN 1 THEN 'c' || (s_suppkey % 97) WHEN 2 THEN 'bad alias' ELSE NULL END AS alias
    FROM supplier WHERE s_suppkey % 3 > 0 UNION SELECT {SUPPLIER_ID}, 'second' || s_suppkey FROM supplier
    WHERE s_suppkey % 3 > 0 AND s_suppkey % 4 < 2"""
ALIAS_RULE_SQL = """, k AS (SELECT r.*, r.alias IS NULL OR coalesce(a.dataset_id = r.dataset_id, FALSE) OR coalesce(
      regexp_matches(r.alias, '^[a-zA-Z0-9]+$') AND a.dataset_id IS NULL AND r.alias NOT IN (SELECT id FROM d)
      AND (SELECT count(*) FROM r r2 WHERE r2.alias = r.alias) = 1, FALSE) AS good FROM r LEFT JOIN a ON r.alias = a.alias),
    ok AS (SELECT dataset_id FROM k GROUP BY dataset_id HAVING bool_and(good))
    SELECT dataset_id, alias FROM a WHERE dataset_id NOT IN (SELECT dataset_id FROM ok)
    UNION ALL SELECT dataset_id, alias FROM r WHERE alias IS NOT NULL AND dataset_id IN (SELECT dataset_id FROM ok)"""


def alias_requests(spark, sf):
    s = table(spark, sf, "supplier").where("s_suppkey % 3 > 0")
    key = F.col("s_suppkey")
    alias = F.when(key % 4 == 0, F.concat(F.lit("new"), key.cast("string")))
    alias = alias.when(key % 4 == 1, F.concat(F.lit("c"), (key % 97).cast("string"))).when(key % 4 == 2, "bad alias")
    first = s.select(uuid_of(F.col("s_name")).alias("dataset_id"), alias.alias("alias"))
    second = s.where("s_suppkey % 4 < 2").select(
        uuid_of(F.col("s_name")).alias("dataset_id"), F.concat(F.lit("second"), key.cast("string")).alias("alias")
    )
    return first.unionAll(second)


@case(f"WITH d AS ({DATASETS_SQL}), a AS ({ALIASES_SQL}), r AS ({REQUEST_SQL}) {ALIAS_RULE_SQL}")
def alias_set(spark, sf):
    return registry.replace_aliases(alias_requests(spark, sf), aliases(spark, sf), datasets(spark, sf))


@case(
    f"""WITH d AS ({DATASETS_SQL}), a AS ({ALIASES_SQL}), q AS ({REQUEST_SQL}),
    r AS (SELECT * FROM q UNION SELECT dataset_id, alias FROM a WHERE dataset_id IN (SELECT dataset_id FROM q)) {ALIAS_RULE_SQL}"""
)
def alias_add(spark, sf):
    return registry.add_aliases(alias_requests(spark, sf), aliases(spark, sf), datasets(spark, sf))


@case(
    f"""SELECT user_id AS dataset_id, CAST(arg_max(event_id % 5, event_id) AS INT) AS status,
    CASE arg_max(event_id % 5, event_id) WHEN 0 THEN 'Created' WHEN 1 THEN 'Accepted data' WHEN 2 THEN 'Processing'
      WHEN 3 THEN 'Available' ELSE 'Error' END AS status_name,
    CAST(CASE WHEN arg_max(event_id % 5, event_id) = 2 THEN 4 ELSE arg_max(event_id % 5, event_id) END AS INT) AS settled
    FROM events GROUP BY user_id"""
)
def status_current(spark, sf):
    log = table(spark, sf, "events").select(
        F.col("user_id").alias("dataset_id"), F.col("event_id").alias("seq"), (F.col("event_id") % 5).cast("int").alias("status")
    )
    now = registry.current_status(log).withColumn("status_name", registry.status_name(F.col("status")))
    return now.join(registry.settle_interrupted(log).withColumnRenamed("status", "settled"), "dataset_id")


@case(f"WITH d AS ({DATASETS_SQL}) SELECT id FROM d")
def registry_list(spark, sf):
    return registry.dataset_ids(datasets(spark, sf))


@case(
    f"""WITH d AS ({DATASETS_SQL}), n AS (SELECT o_orderkey, {NAME_SQL} AS name FROM orders)
    SELECT * FROM n WHERE name IN (SELECT id FROM d)"""
)
def registry_exists(spark, sf):
    return registry.existing(names(spark, sf), datasets(spark, sf))


@case(
    f"""WITH d AS ({DATASETS_SQL}) SELECT count(*) AS datasets, count(*) FILTER (status = 2) AS active_loads,
    '1.0' AS version, count(*) AS amount FROM d"""
)
def service_counters(spark, sf):
    d = datasets(spark, sf)
    return registry.service_counters(d, "1.0").withColumn("amount", registry.dataset_count(d).scalar())


@case(
    f"""WITH d AS ({DATASETS_SQL}), a AS ({ALIASES_SQL}),
    g AS (SELECT id FROM d WHERE status IN (3, 4) AND id IN (SELECT {SUPPLIER_ID} FROM supplier WHERE s_suppkey % 2 = 0))
    SELECT 'dataset' AS kind, id AS name FROM d WHERE id NOT IN (SELECT id FROM g)
    UNION ALL SELECT 'alias', alias FROM a WHERE dataset_id NOT IN (SELECT id FROM g)"""
)
def dataset_drop(spark, sf):
    asked = table(spark, sf, "supplier").where("s_suppkey % 2 = 0").select(uuid_of(F.col("s_name")).alias("id"))
    left, kept = registry.drop_datasets(asked, datasets(spark, sf), aliases(spark, sf))
    return left.select(F.lit("dataset").alias("kind"), F.col("id").alias("name")).unionAll(
        kept.select(F.lit("alias").alias("kind"), F.col("alias").alias("name"))
    )


# -- scalar functions ----------------------------------------------------------


@case(
    """SELECT p_partkey, md5(p_name) AS md5, sha1(p_name) AS sha1, length(p_name) AS len,
    length(p_name) - length(replace(p_name, 'd', '')) AS n_d,
    regexp_matches(p_name, '^[a-z0-9]+$') AS name_alnum, regexp_matches(replace(p_name, ' ', ''), '^[a-z0-9]+$') AS packed_alnum FROM part"""
)
def hash_scalars(spark, sf):
    name = F.col("p_name")
    return table(spark, sf, "part").select(
        "p_partkey",
        ids.md5_hex(name).alias("md5"),
        ids.sha1_hex(name).alias("sha1"),
        F.length(name).alias("len"),
        text.count_of(name, "d").alias("n_d"),
        text.is_alphanumeric(name).alias("name_alnum"),
        text.is_alphanumeric(F.replace(name, F.lit(" "), F.lit(""))).alias("packed_alnum"),
    )


@case(
    f"""WITH t AS (SELECT c_custkey, c_name, {UUID_SQL.format("c_name")} AS id FROM customer)
    SELECT c_custkey, 'data_' || replace(id, '-', '') AS data_table,
    'data_' || replace(id, '-', '') || '_jsonidx_' || substr(md5(c_name), 1, 8) AS index_name,
    CASE WHEN c_custkey % 2 = 0 THEN 'http://host/' ELSE 'http://host' || '/' END || 'dataset/' || id AS url,
    TRUE AS id_ok, FALSE AS name_ok FROM t"""
)
def table_names(spark, sf):
    t = table(spark, sf, "customer").withColumn("id", uuid_of(F.col("c_name")))
    base = F.when(F.col("c_custkey") % 2 == 0, "http://host/").otherwise("http://host")
    name = ids.table_name(F.col("id"))
    return t.select(
        "c_custkey",
        name.alias("data_table"),
        ids.index_name(name, F.col("c_name")).alias("index_name"),
        ids.dataset_url(base, F.col("id")).alias("url"),
        ids.is_uuid(F.col("id")).alias("id_ok"),
        ids.is_uuid(F.col("c_name")).alias("name_ok"),
    )


@case(
    """WITH q AS (SELECT page_id, regexp_extract(url, '^[^?#]*[?]([^#]*)', 1) AS t FROM pages WHERE regexp_matches(url, '^[^?#]*[?]')),
    i AS (SELECT page_id, unnest(string_split(t, '&')) AS item, generate_subscripts(string_split(t, '&'), 1) AS pos FROM q),
    p AS (SELECT page_id, pos, trim(url_decode(replace(string_split(item, '=')[1], '+', ' '))) AS key,
      trim(url_decode(replace(CASE WHEN contains(item, '=') THEN substr(item, instr(item, '=') + 1) ELSE '' END, '+', ' '))) AS value FROM i)
    SELECT page_id, key, arg_max(value, pos) AS value FROM p WHERE key <> '' GROUP BY page_id, key"""
)
def query_string_params(spark, sf):
    pages = table(spark, sf, "pages").select("page_id", web.query_text(F.col("url")).alias("t")).where("t IS NOT NULL")
    return pages.select("page_id", F.explode(web.query_parameters(F.col("t"))))


@case(
    """SELECT page_id, replace(replace(replace(url_encode(url), '%20', '+'), '%2A', '*'), '~', '%7E') AS encoded, url AS decoded FROM pages"""
)
def url_codec(spark, sf):
    url = F.col("url")
    return table(spark, sf, "pages").select("page_id", web.encode(url).alias("encoded"), web.decode(web.encode(url)).alias("decoded"))


@case(
    """SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S+0000') AS created,
    list_distinct([o_orderstatus, o_orderpriority, o_orderstatus])[1] IS NOT NULL AS has_first,
    CASE WHEN o_orderstatus = o_orderpriority THEN 1 ELSE 2 END AS n_texts FROM orders"""
)
def timestamps_and_json_lists(spark, sf):
    o = table(spark, sf, "orders")
    zone_free = F.concat(F.date_format(F.col("o_orderdate"), "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+0000"))
    payload = F.to_json(F.array("o_orderstatus", "o_orderpriority", "o_orderstatus"))
    listed = text.json_texts(payload)
    return o.select(
        "o_orderkey", zone_free.alias("created"), F.get(listed, F.lit(0)).isNotNull().alias("has_first"), F.size(listed).alias("n_texts")
    )


@case(
    """SELECT c_custkey, array_to_string(CASE WHEN lower(c_mktsegment) = lower(c_name) THEN [lower(c_name)]
      ELSE [lower(c_name), lower(c_mktsegment)] END, '|') AS labels,
    CASE WHEN c_custkey % 2 = 0 THEN ';' ELSE ',' END AS sep, c_mktsegment = 'FURNITURE' AS shared FROM customer"""
)
def header_normalise(spark, sf):
    c = table(spark, sf, "customer")
    raw = F.array(F.concat(F.lit(" \t"), "c_name"), F.lit(""), F.upper("c_mktsegment"), F.lower("c_mktsegment"), F.lit("  "))
    second = F.when(F.col("c_custkey") % 2 == 0, F.concat("c_mktsegment", F.lit(";"))).otherwise(F.col("c_mktsegment"))
    return c.select(
        "c_custkey",
        F.array_join(text.normal_header(raw), "|").alias("labels"),
        sniff.separator_column(F.concat("c_name", F.lit(";")), second).alias("sep"),
        (F.size(sets.shared_keys(F.array("c_mktsegment"), F.array(F.lit("FURNITURE"), F.lit("x")))) > 0).alias("shared"),
    )


# -- loads and exports ---------------------------------------------------------


def _catalog(spark: SparkSession) -> Catalog:
    return Catalog(spark, fresh_folder(spark, "catalog"))


def _csv(spark: SparkSession, rows: DataFrame, **options) -> str:
    folder = fresh_folder(spark, "csv")
    export.write_csv(rows, folder, **options)
    return folder


# Rows of a file, and bytes of a scan partition, from which a table is dealt into more of them.
FILE_ROWS = 2_000_000
SCAN_BYTES = 16 << 20


def _csv_in_order(spark: SparkSession, rows: DataFrame, files: int = 1) -> str:
    """Files in order of row numbers, more than ``files`` of a large table."""
    ranges = rows.repartitionByRange(max(files, rows.count() // FILE_ROWS), ROWNR)
    return _csv(spark, ranges.sortWithinPartitions(ROWNR))


def _csv_lines(spark: SparkSession, line: DataFrame, header: str) -> str:
    """Write ready-made CSV lines (``value``), a header on top of every file."""
    folder = fresh_folder(spark, "csv")
    first = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)) == 0
    top = F.when(first, F.concat(F.lit(header + "\n"), F.col("value"))).otherwise(F.col("value"))
    line.select(top.alias("value")).write.text(folder)
    return folder


def _loaded(spark: SparkSession, path: str) -> DataFrame:
    catalog = _catalog(spark)
    dataset_id, status = load.create_from_csv(catalog, path)
    if status != registry.AVAILABLE:
        raise RuntimeError(f"load ended with status {status}")
    return catalog.records(dataset_id).drop(ROWNR)


@case(f"SELECT {PART_SQL} FROM part")
def ingest_roundtrip(spark, sf):
    return _loaded(spark, _csv(spark, part(spark, sf)))


@case("""SELECT CAST(l_orderkey AS VARCHAR) AS l_orderkey, CAST(l_partkey AS VARCHAR) AS l_partkey,
    CAST(l_linenumber AS VARCHAR) AS l_linenumber, l_returnflag, l_linestatus FROM lineitem""")
def ingest_lineitem(spark, sf):
    columns = ["l_orderkey", "l_partkey", "l_linenumber", "l_returnflag", "l_linestatus"]
    return _loaded(spark, _csv(spark, as_records(table(spark, sf, "lineitem"), columns)))


def _as_text(df: DataFrame, number: Column) -> DataFrame:
    """All columns of a table as records: doubles with two decimals, times to the second."""
    kinds = {"double": lambda c: F.col(c).cast("decimal(18,2)"), "timestamp_ntz": lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss")}
    return df.select(number.alias(ROWNR), *[kinds.get(kind, F.col)(c).cast("string").alias(c) for c, kind in df.dtypes])


def _whole_sql(table_name: str, whole: list[str], doubles: list[str], times: list[str]) -> str:
    cells = [f"CAST({c} AS VARCHAR) AS {c}" for c in whole] + [f"CAST(CAST({c} AS DECIMAL(18,2)) AS VARCHAR) AS {c}" for c in doubles]
    return f"SELECT {', '.join([*cells, *[f'strftime({c}, $$%Y-%m-%d %H:%M:%S$$) AS {c}' for c in times]])} FROM {table_name}"


@case(
    _whole_sql("lineitem", ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_returnflag", "l_linestatus"],
               ["l_quantity", "l_extendedprice", "l_discount", "l_tax"], ["l_shipdate"])
)
def ingest_lineitem_whole(spark, sf):
    """All columns of the largest table through a file and back."""
    return _loaded(spark, _csv(spark, _as_text(table(spark, sf, "lineitem"), F.monotonically_increasing_id())))


@case(
    _whole_sql("orders", ["o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority"], ["o_totalprice"], ["o_orderdate"])
    + " WHERE regexp_matches(CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS VARCHAR), '^[1-4].*[05]$') AND strftime(o_orderdate, $$%Y-%m$$) = '1995-03'"
)
def orders_whole_query(spark, sf):
    """Patterns on amounts and dates of whole records."""
    rows = _as_text(table(spark, sf, "orders"), F.col("o_orderkey"))
    return predicates.matching(rows, {"o_totalprice": "^[1-4].*[05]$", "o_orderdate": "^1995-03-"}).drop(ROWNR)


@case(f"SELECT {CUSTOMER_SQL} FROM customer")
def ingest_semicolon(spark, sf):
    return _loaded(spark, _csv(spark, customer(spark, sf), sep=";"))


@case(
    """SELECT CAST(c_custkey AS VARCHAR) AS key, 'Åke ' || c_name || ' é' AS name, '5 €' AS price FROM customer"""
)
def ingest_charset(spark, sf):
    c = table(spark, sf, "customer")
    line = F.concat(F.col("c_custkey").cast("string"), F.lit(",Åke "), "c_name", F.lit(" é,5 €"))
    single_byte = F.encode(F.translate(line, "€", "\x80"), "ISO-8859-1").cast("string")
    return _loaded(spark, _csv_lines(spark, c.select(single_byte.alias("value")), "Key,Name,Price"))


@case(
    """SELECT CAST(o_orderkey AS VARCHAR) AS k, CASE o_orderkey % 4 WHEN 0 THEN o_orderstatus WHEN 1 THEN o_orderstatus WHEN 2 THEN '' END AS status,
    CASE o_orderkey % 4 WHEN 0 THEN o_orderpriority WHEN 2 THEN '' END AS prio FROM orders"""
)
def ingest_ragged(spark, sf):
    o = table(spark, sf, "orders")
    k, m = F.col("o_orderkey").cast("string"), F.col("o_orderkey") % 4
    line = F.when(m == 0, F.concat_ws(",", k, "o_orderstatus", "o_orderpriority")).when(m == 1, F.concat_ws(",", k, "o_orderstatus"))
    line = line.when(m == 2, F.concat(k, F.lit(",,"))).otherwise(k)
    return _loaded(spark, _csv_lines(spark, o.select(line.alias("value")), "k,status,prio"))


def _overlong(spark, sf):
    o = table(spark, sf, "orders")
    k = F.col("o_orderkey").cast("string")
    line = F.concat_ws(",", k, F.concat(F.lit('"'), "o_orderstatus", F.lit(',x"')))
    line = F.when(F.col("o_orderkey") % 7 == 0, F.concat(line, F.lit(",extra"))).otherwise(line)
    return _csv_lines(spark, o.select(line.alias("value")), "k,status")


@case(
    """SELECT 3 AS n_cells, 2 AS n_labels, o_orderkey || ',"' || o_orderstatus || ',x",extra' AS line FROM orders WHERE o_orderkey % 7 = 0"""
)
def ingest_overlong_report(spark, sf):
    return csv_records.overlong_rows(spark, _overlong(spark, sf)).drop(ROWNR)


@case(
    """SELECT CAST(CASE WHEN (SELECT count(*) FROM orders WHERE o_orderkey % 7 = 0) > 0 THEN 4 ELSE 3 END AS INT) AS status,
    CAST(0 AS BIGINT) AS n_segments"""
)
def ingest_overlong_rejected(spark, sf):
    catalog = _catalog(spark)
    dataset_id, _ = load.create_from_csv(catalog, _overlong(spark, sf))
    left = catalog.log("loads").where(F.col("dataset_id") == dataset_id).agg(F.count("*"))
    status = registry.current_status(catalog.log("status")).where(F.col("dataset_id") == dataset_id)
    return status.select("status", left.scalar().alias("n_segments"))


@case(f"SELECT {DOCUMENTS_SQL} FROM documents")
def ingest_multiline(spark, sf):
    return _loaded(spark, _csv(spark, documents(spark, sf)))


@case(f"SELECT {DOCUMENTS_SQL} FROM documents")
def ingest_late_charset(spark, sf):
    """Files in a single-byte charset whose lines beyond ASCII come last, past 1 MB where the table is large enough."""
    rows = documents(spark, sf).sortWithinPartitions(F.octet_length("text") != F.length("text"))
    return _loaded(spark, _csv(spark, rows, charset="iso-8859-1"))


@case(f"SELECT {DOCUMENTS_SQL} FROM documents")
def scan_late_charset(spark, sf):
    """The same files as a lazy scan."""
    rows = documents(spark, sf).sortWithinPartitions(F.octet_length("text") != F.length("text"))
    return csv_records.scan_csv(spark, _csv(spark, rows, charset="iso-8859-1")).drop(ROWNR)


@case(
    """SELECT CAST(o_orderkey AS VARCHAR) AS id, 'é' || o_orderstatus AS status,
    CASE WHEN o_orderkey % 5 = 0 THEN 'x' || chr(65533) || 'y' ELSE o_orderpriority END AS priority FROM orders"""
)
def ingest_bad_byte(spark, sf):
    """UTF-8 files with a stray byte in every fifth line, from the start on."""
    broken = F.unhex(F.lit("78FF79")).cast("string")
    cell = F.when(F.col("o_orderkey") % 5 == 0, broken).otherwise(F.col("o_orderpriority"))
    line = F.concat_ws(",", F.col("o_orderkey").cast("string"), F.concat(F.lit("é"), "o_orderstatus"), cell)
    return _loaded(spark, _csv_lines(spark, table(spark, sf, "orders").select(line.alias("value")), "id,status,priority"))


@case("SELECT count(*) AS n_rows, count(DISTINCT event_id) AS n_numbers, TRUE AS in_order FROM events")
def rownr_unique(spark, sf):
    """Row numbers where a scan partition holds many small blocks: all different, in file order.

    Every block is opened on its own and read some 64 KiB ahead, so partitions become more with
    the table and their blocks longer, 256 a partition."""
    events = table(spark, sf, "events").select(F.col("event_id").cast("long").alias(ROWNR), F.col("event_id").cast("string").alias("id"))
    folder = _csv_in_order(spark, events, files=3)
    size = sniff.files_under(spark, folder).agg(F.sum("size")).first()[0] or 0
    parts = max(2, size // SCAN_BYTES)
    block = max(2000, size // parts // 256)
    tight = {"spark.sql.files.maxPartitionBytes": str(block), "spark.sql.files.openCostInBytes": "0", "spark.sql.files.maxPartitionNum": str(parts)}
    before = {name: spark.conf.get(name, None) for name in tight}
    for name, value in tight.items():
        spark.conf.set(name, value)
    try:
        catalog = _catalog(spark)
        dataset_id, _ = load.create_from_csv(catalog, folder)
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)
    rows = catalog.records(dataset_id)
    runs = rows.groupBy(F.floor(F.col("id").cast("long") / 1000).alias("run")).agg(F.min(ROWNR).alias("low"), F.max(ROWNR).alias("high"))
    after = F.col("low") > F.lag("high", 1, -1).over(Window.orderBy("run"))  # one row per thousand events
    order = runs.select(after.alias("after")).agg(F.bool_and("after"))
    return rows.agg(F.count("*").alias("n_rows"), F.count_distinct(ROWNR).alias("n_numbers")).withColumn("in_order", order.scalar())


@case(
    """SELECT CAST(p_partkey AS VARCHAR) AS id, 'a "' || p_name || '" \\ ' || p_brand || chr(10) || '\\\\' AS cell, '' AS none FROM part"""
)
def ingest_escapes(spark, sf):
    p = table(spark, sf, "part")
    cell = F.concat(F.lit('a "'), "p_name", F.lit('" \\ '), "p_brand", F.lit("\n\\\\"))
    rows = p.select(F.col("p_partkey").cast("long").alias(ROWNR), F.col("p_partkey").cast("string").alias("id"), cell.alias("cell"), F.lit("").alias("none"))
    return _loaded(spark, _csv(spark, rows, escape_backslash=True))


@case(
    f"""SELECT {SUPPLIER_SQL} FROM supplier WHERE s_suppkey % 2 = 0 UNION ALL
    SELECT {SUPPLIER_SQL} FROM supplier WHERE s_suppkey % 2 = 1"""
)
def append_reordered(spark, sf):
    rows = supplier(spark, sf)
    even, odd = rows.where(f"{ROWNR} % 2 = 0"), rows.where(f"{ROWNR} % 2 = 1")
    catalog = _catalog(spark)
    dataset_id, _ = load.create_from_csv(catalog, _csv(spark, even))
    load.load_csv(catalog, dataset_id, _csv(spark, odd.select(ROWNR, *reversed(SUPPLIER))))
    return catalog.records(dataset_id).drop(ROWNR)


@case(f"SELECT {CUSTOMER_SQL} FROM customer")
def replace_load(spark, sf):
    catalog = _catalog(spark)
    dataset_id, _ = load.create_from_csv(catalog, _csv(spark, supplier(spark, sf)))
    load.load_csv(catalog, dataset_id, _csv(spark, customer(spark, sf)), mode="replace")
    return catalog.records(dataset_id).drop(ROWNR)


@case(f"SELECT {SUPPLIER_SQL}, CAST(4 AS INT) AS status FROM supplier")
def append_mismatch_rejected(spark, sf):
    catalog = _catalog(spark)
    dataset_id, _ = load.create_from_csv(catalog, _csv(spark, supplier(spark, sf)))
    load.load_csv(catalog, dataset_id, _csv(spark, customer(spark, sf)))
    status = registry.current_status(catalog.log("status")).where(F.col("dataset_id") == dataset_id).select("status")
    return catalog.records(dataset_id).drop(ROWNR).withColumn("status", status.scalar())


@case("SELECT 'same' AS pair, TRUE AS same UNION ALL SELECT 'other', FALSE")
def loaded_table_comparison(spark, sf):
    rows = part(spark, sf).drop(ROWNR)
    loaded = _loaded(spark, _csv(spark, part(spark, sf)))
    one = sets.same_rows(rows, loaded).select(F.lit("same").alias("pair"), "same")
    changed = rows.withColumn("p_name", F.upper("p_name"))
    return one.unionAll(sets.same_rows(changed, loaded).select(F.lit("other").alias("pair"), "same"))


@case(
    """SELECT 'doc_id' AS column_name, max(length(CAST(doc_id AS VARCHAR))) AS max_length FROM documents HAVING max(length(CAST(doc_id AS VARCHAR))) <= 256
    UNION ALL SELECT 'lang', max(length(lang)) FROM documents HAVING max(length(lang)) <= 256
    UNION ALL SELECT 'source', max(length(source)) FROM documents HAVING max(length(source)) <= 256
    UNION ALL SELECT 'text', max(length(text)) FROM documents HAVING max(length(text)) <= 256"""
)
def lookup_layout(spark, sf):
    folder = fresh_folder(spark, "lookup")
    load.write_lookup_layout(documents(spark, sf), folder)
    return profile.lookup_columns(spark.read.parquet(folder))


@case("SELECT o_orderkey AS __rownr, CAST(o_custkey AS VARCHAR) AS o_custkey, o_orderstatus FROM orders WHERE o_custkey = 7")
def lookup_layout_query(spark, sf):
    folder = fresh_folder(spark, "lookup")
    rows = orders(spark, sf).select(ROWNR, "o_custkey", "o_orderstatus")
    load.write_lookup_layout(rows, folder, sort_by="o_custkey")
    return predicates.matching(spark.read.parquet(folder), {"o_custkey": "7"})


@case(
    """SELECT CAST(to_json({'c_custkey': CAST(c_custkey AS VARCHAR), 'c_name': c_name, 'c_nationkey': CAST(c_nationkey AS VARCHAR),
    'c_mktsegment': c_mktsegment}) AS VARCHAR) AS value FROM customer"""
)
def export_json(spark, sf):
    folder = fresh_folder(spark, "json")
    export.write_json_lines(customer(spark, sf), folder)
    return spark.read.text(folder)


@case(f"SELECT c_custkey AS __rownr, {CUSTOMER_SQL} FROM customer WHERE c_custkey % 10 > 0")
def json_records_decode(spark, sf):
    stored = records.to_json_records(customer(spark, sf))
    broken = F.when(F.col(ROWNR) % 10 == 0, F.lit("{oops")).otherwise(F.col("data"))
    return records.from_json_records(stored.withColumn("data", broken), CUSTOMER)


@case(f"SELECT {DOCUMENTS_SQL} FROM documents")
def export_csv_roundtrip(spark, sf):
    folder = _csv(spark, documents(spark, sf), ordered=True)
    return csv_records.scan_csv(spark, folder).drop(ROWNR)


@case(
    """SELECT CAST(3 AS INT) AS status, 'c_custkey|c_name|c_nationkey|c_mktsegment' AS columnnames, count(*) AS rowcount,
    'first|second' AS aliases, TRUE AS url_ok, TRUE AS created_ok FROM customer"""
)
def dataset_info(spark, sf):
    catalog = _catalog(spark)
    dataset_id, _ = load.create_from_csv(catalog, _csv(spark, customer(spark, sf)))
    catalog.set_aliases(dataset_id, ["second", "first"])
    return catalog.info("first", "http://host").select(
        "status",
        F.array_join("columnnames", "|").alias("columnnames"),
        "rowcount",
        F.array_join("aliases", "|").alias("aliases"),
        (F.col("@id") == F.concat(F.lit("http://host/dataset/"), "identifier")).alias("url_ok"),
        F.col("created").rlike(r"^\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d[+-]\d{4}$").alias("created_ok"),
    )


@case(
    """SELECT CAST(p_partkey AS VARCHAR) AS p_partkey, p_name, (SELECT count(*) FROM part WHERE regexp_matches(p_name, '(cold|small)')) AS result_count
    FROM part WHERE regexp_matches(p_name, '(cold|small)') ORDER BY part.p_partkey LIMIT 10"""
)
def ingest_and_query(spark, sf):
    catalog = _catalog(spark)
    rows = part(spark, sf).select(ROWNR, "p_partkey", "p_name")
    dataset_id, _ = load.create_from_csv(catalog, _csv(spark, rows, ordered=True))
    return catalog.query(dataset_id, {"P_Name": "(cold|small)", "_limit": "10"}).drop(ROWNR)


@case("SELECT c_custkey AS __rownr, c_name AS name, CASE WHEN c_custkey % 3 > 0 THEN c_mktsegment END AS segment FROM customer")
def json_field_text(spark, sf):
    gaps = F.when(F.col(ROWNR) % 3 > 0, F.col("c_mktsegment")).alias("c_mktsegment")
    stored = records.to_json_records(customer(spark, sf).select(ROWNR, "c_name", gaps))
    data = F.col("data")
    return stored.select(ROWNR, records.field_text(data, "c_name").alias("name"), records.field_text(data, "c_mktsegment").alias("segment"))


@case("SELECT count(*) AS n, count(*) AS n_ids, TRUE AS well_formed FROM customer")
def new_ids(spark, sf):
    made = table(spark, sf, "customer").select(ids.new_id().alias("id"))
    return made.agg(
        F.count("*").alias("n"), F.count_distinct("id").alias("n_ids"), F.bool_and(ids.is_uuid(F.col("id"))).alias("well_formed")
    )


@case(f"WITH a AS ({ALIASES_SQL}) SELECT alias FROM a WHERE dataset_id = {UUID_SQL.format("'Supplier#000000004'")}")
def alias_list(spark, sf):
    return registry.aliases_of(aliases(spark, sf), str(_md5_uuid("Supplier#000000004")))


@case(
    """SELECT 'file loaded twice' AS question, TRUE AS same UNION ALL SELECT 'columns in another order', TRUE
    UNION ALL SELECT 'one row more', FALSE UNION ALL SELECT 'loaded already', TRUE
    UNION ALL SELECT 'rows', count(*) = 2 * (SELECT count(*) FROM part) FROM (SELECT * FROM part UNION ALL SELECT * FROM part)"""
)
def table_fingerprints(spark, sf):
    """Stored tables compared by what their loads have noted; repeated rows count."""
    rows = part(spark, sf)
    catalog, path = _catalog(spark), _csv(spark, rows)
    first, second, third = (load.create_from_csv(catalog, path)[0] for _ in range(3))
    turned = _csv(spark, rows.select(ROWNR, *reversed(PART)).repartition(3))
    fourth, _ = load.create_from_csv(catalog, turned)
    load.load_csv(catalog, third, path)
    load.load_csv(catalog, second, _csv(spark, rows.orderBy(ROWNR).limit(1)))
    fifth, _ = load.create_from_csv(catalog, path)
    answers = [
        ("file loaded twice", indexed.same_rows(catalog, first, fifth)),
        ("columns in another order", indexed.same_rows(catalog, first, fourth)),
        ("one row more", indexed.same_rows(catalog, first, second)),
        ("loaded already", indexed.loaded_already(catalog, third, path)),
        ("rows", int(indexed.table_fingerprint(catalog, third).split(":")[0]) == indexed.row_count(catalog, third)),
    ]
    return spark.createDataFrame(answers, "question string, same boolean")


# -- request rates -------------------------------------------------------------

DAY = 86_400
FRAME = "RANGE BETWEEN INTERVAL 86399999999 MICROSECONDS PRECEDING AND INTERVAL 1 MICROSECONDS PRECEDING"


@case(f"SELECT event_id, user_id, count(*) OVER (PARTITION BY user_id ORDER BY ts {FRAME}) AS trailing_count FROM events")
def trailing_request_count(spark, sf):
    events = table(spark, sf, "events").select("event_id", "user_id", "ts")
    return traffic.trailing_counts(events, "user_id", "ts", DAY).drop("ts")


@case(f"SELECT event_id, count(*) OVER (ORDER BY ts {FRAME}) AS trailing_count FROM events")
def trailing_count_global(spark, sf):
    events = table(spark, sf, "events").select("event_id", "ts")
    return traffic.trailing_counts(events, None, "ts", DAY, hot_rows=2_000).drop("ts")


@case(
    f"""SELECT event_id, event_type, count(*) OVER w AS trailing_count, count(*) OVER w >= 30 AS over_limit FROM events
    WINDOW w AS (PARTITION BY event_type ORDER BY ts {FRAME})"""
)
def over_limit(spark, sf):
    events = table(spark, sf, "events").select("event_id", "event_type", "ts")
    return traffic.trailing_counts(events, "event_type", "ts", DAY, limit=30).drop("ts")


@case(
    f"""WITH e AS (SELECT event_id, user_id, count(*) OVER w AS n, min(ts) OVER w AS oldest FROM events
      WINDOW w AS (PARTITION BY user_id ORDER BY ts {FRAME}))
    SELECT event_id, n AS trailing_count, n >= 3 AS over_limit,
    CASE WHEN n >= 3 THEN epoch_us(oldest) + 86400000000 + 1000 END AS retry_us FROM e"""
)
def retry_after(spark, sf):
    events = table(spark, sf, "events").select("event_id", "user_id", "ts")
    out = traffic.trailing_counts(events, "user_id", "ts", DAY, limit=3, retry_after=True)
    return out.select("event_id", "trailing_count", "over_limit", F.unix_micros("retry_at").alias("retry_us"))


@case(
    f"""WITH e AS (SELECT event_id, user_id, count(*) OVER w AS n, min(ts) OVER w AS oldest FROM events
      WINDOW w AS (PARTITION BY user_id ORDER BY ts {FRAME}))
    SELECT event_id, n AS trailing_count, n >= 3 AS over_limit,
    CASE WHEN n >= 3 THEN epoch_us(oldest) + 86400000000 + 1000 END AS retry_us FROM e"""
)
def retry_after_hot_keys(spark, sf):
    events = table(spark, sf, "events").select("event_id", "user_id", "ts")
    out = traffic.trailing_counts(events, "user_id", "ts", DAY, limit=3, retry_after=True, hot_rows=20)
    return out.select("event_id", "trailing_count", "over_limit", F.unix_micros("retry_at").alias("retry_us"))


@case(
    """WITH b AS (SELECT event_id, event_type, CASE WHEN event_id % 10 = 0 THEN ts ELSE
        make_timestamp(epoch_us(TIMESTAMP '2024-01-15 12:00:00') + epoch_us(ts) % 3600000000 // 250000 * 250000) END AS moment FROM events),
    e AS (SELECT event_id, count(*) OVER w AS n, min(moment) OVER w AS oldest FROM b
      WINDOW w AS (PARTITION BY event_type ORDER BY moment RANGE BETWEEN INTERVAL 599999999 MICROSECONDS PRECEDING AND INTERVAL 1 MICROSECONDS PRECEDING))
    SELECT event_id, n AS trailing_count, n >= 20 AS over_limit, CASE WHEN n >= 20 THEN epoch_us(oldest) + 600000000 + 1000 END AS retry_us FROM e"""
)
def trailing_count_burst(spark, sf):
    """Nine tenths of all requests in one hour, at quarters of seconds; no stretch of a timeline exceeds 500 rows."""
    events = table(spark, sf, "events")
    us = traffic.micros(events, "ts")
    noon = F.unix_micros(F.lit("2024-01-15 12:00:00").cast("timestamp"))
    burst = F.timestamp_micros(noon + F.floor(us % 3_600_000_000 / 250_000).cast("long") * 250_000)
    rows = events.select("event_id", "event_type", F.when(F.col("event_id") % 10 == 0, F.timestamp_micros(us)).otherwise(burst).alias("at"))
    out = traffic.trailing_counts(rows, "event_type", "at", 600, limit=20, retry_after=True, hot_rows=500)
    return out.select("event_id", "trailing_count", "over_limit", F.unix_micros("retry_at").alias("retry_us"))


@case(
    f"""WITH r AS (SELECT event_id, ts, CASE event_id % 3 WHEN 0 THEN 'GET' WHEN 1 THEN 'HEAD' ELSE 'POST' END AS method,
      CASE WHEN event_type = 'click' THEN '/x/status' ELSE '/x/' || event_type END AS path,
      CASE WHEN event_id % 2 = 0 THEN 'u' || user_id ELSE 'fallback' || (user_id % 5) END AS client FROM events)
    SELECT event_id, client, count(*) OVER (PARTITION BY client ORDER BY ts {FRAME}) AS trailing_count FROM r
    WHERE method IN ('GET', 'HEAD') AND NOT ends_with(path, '/status')"""
)
def limited_request_count(spark, sf):
    key = F.col("event_id")
    forwarded = F.when(key % 2 == 0, F.concat(F.lit("u"), F.col("user_id").cast("string")))
    address = F.concat(F.lit("fallback"), (F.col("user_id") % 5).cast("string"))
    requests = table(spark, sf, "events").select(
        "event_id",
        "ts",
        F.when(key % 3 == 0, "GET").when(key % 3 == 1, "HEAD").otherwise("POST").alias("method"),
        F.when(F.col("event_type") == "click", "/x/status").otherwise(F.concat(F.lit("/x/"), "event_type")).alias("path"),
        traffic.client_key(forwarded, address).alias("client"),
    )
    counted = traffic.limited_requests(requests).select("event_id", "ts", "client")
    return traffic.trailing_counts(counted, "client", "ts", DAY).drop("ts")


@case(
    """WITH RECURSIVE e AS (SELECT event_id, user_id, epoch_ms(ts) AS ms,
      row_number() OVER (PARTITION BY user_id ORDER BY epoch_ms(ts), event_id) AS rn FROM events),
    r AS (SELECT event_id, user_id, rn, TRUE AS admitted, [ms] AS taken FROM e WHERE rn = 1
      UNION ALL SELECT e.event_id, e.user_id, e.rn, len(list_filter(r.taken, lambda x: e.ms - x < 86400000)) < 3,
        CASE WHEN len(list_filter(r.taken, lambda x: e.ms - x < 86400000)) < 3
          THEN list_distinct(list_append(list_filter(r.taken, lambda x: e.ms - x < 86400000), e.ms))
          ELSE list_filter(r.taken, lambda x: e.ms - x < 86400000) END
      FROM r JOIN e ON e.user_id = r.user_id AND e.rn = r.rn + 1)
    SELECT event_id, user_id, admitted FROM r"""
)
def sliding_admission(spark, sf):
    events = table(spark, sf, "events").select("event_id", "user_id", "ts")
    return traffic.sliding_admission(events, "user_id", "ts", "event_id", 3, DAY).drop("ts")


@case(
    """WITH RECURSIVE p AS (SELECT 3e0 / 86400e0 AS rate, 1e6 / (3e0 / 86400e0) AS gap),
    e AS (SELECT event_id, user_id, epoch_us(ts) AS us,
      row_number() OVER (PARTITION BY user_id ORDER BY epoch_us(ts), event_id) AS rn FROM events),
    r AS (SELECT event_id, user_id, rn, TRUE AS admitted, us + CAST(trunc(gap) AS BIGINT) AS free, 0e0 AS kept FROM e, p WHERE rn = 1
      UNION ALL SELECT event_id, user_id, rn, free <= us,
        CASE WHEN free <= us THEN us + CAST(trunc((1e0 - least(1e0, now)) * gap) AS BIGINT) ELSE free END,
        CASE WHEN free <= us THEN now - least(1e0, now) ELSE kept END
      FROM (SELECT e.*, r.free, r.kept, gap, least(rate, r.kept + greatest(e.us - r.free, 0) / gap) AS now
        FROM p, r JOIN e ON e.user_id = r.user_id AND e.rn = r.rn + 1) s)
    SELECT event_id, user_id, admitted FROM r"""
)
def average_admission(spark, sf):
    events = table(spark, sf, "events").select("event_id", "user_id", "ts")
    return traffic.average_admission(events, "user_id", "ts", "event_id", 3, DAY).drop("ts")


# -- streams -------------------------------------------------------------------


def _event_stream(spark: SparkSession, sf: str) -> DataFrame:
    folder = f"{sf.rstrip('/')}"
    schema = table(spark, sf, "events").schema
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/events.parquet")
    is_folder = path.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(path).isDirectory()
    reader = spark.readStream.schema(schema)
    if is_folder:
        return reader.parquet(f"{folder}/events.parquet")
    return reader.option("pathGlobFilter", "events.parquet").parquet(folder)


def _run_stream(spark: SparkSession, out: DataFrame) -> DataFrame:
    target, checkpoint = fresh_folder(spark, "stream"), fresh_folder(spark, "progress")
    writer = out.writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint)
    writer.trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(out.schema).parquet(target)


@case(
    """WITH w AS (SELECT time_bucket(INTERVAL 12 HOUR, ts, TIMESTAMP '1970-01-01') - k * INTERVAL 12 HOUR AS s, event_type
      FROM events, (SELECT unnest([0, 1]) AS k) x)
    SELECT epoch_us(s) AS start_us, epoch_us(s + INTERVAL 24 HOUR) AS end_us, event_type AS key, count(*) AS n FROM w
    WHERE s + INTERVAL 24 HOUR <= (SELECT date_trunc('millisecond', max(ts)) - INTERVAL 1 HOUR FROM events) GROUP BY s, event_type"""
)
def stream_sliding_counts(spark, sf):
    counts = stream_traffic.sliding_counts(_event_stream(spark, sf), "event_type", "ts", DAY, DAY // 2, "1 hour")
    out = _run_stream(spark, counts)
    return out.select(F.unix_micros("window_start").alias("start_us"), F.unix_micros("window_end").alias("end_us"), "key", "n")


@case(ORACLES["sliding_admission"])
def stream_sliding_admission(spark, sf):
    out = stream_traffic.sliding_admission_stream(_event_stream(spark, sf), "user_id", "ts", "event_id", 3, DAY, "1 hour")
    return _run_stream(spark, out).select(F.col("order").alias("event_id"), F.col("key").alias("user_id"), "admitted")


@case(
    f"""SELECT 'suppliers' AS dataset, CAST(s_suppkey AS VARCHAR) AS key, s_name AS name FROM supplier
    UNION ALL SELECT 'customers', CAST(c_custkey AS VARCHAR), c_name FROM customer"""
)
def drop_folder_ingest(spark, sf):
    catalog, folder = _catalog(spark), fresh_folder(spark, "drop")
    for name, rows in (("suppliers", supplier(spark, sf)), ("customers", customer(spark, sf))):
        columns = rows.columns[1:3]
        export.write_csv(rows.select(ROWNR, F.col(columns[0]).alias("key"), F.col(columns[1]).alias("name")), f"{folder}/{name}")
    drop_folder.watch_folder(spark, catalog, folder, fresh_folder(spark, "progress"), loads_at_once=2).awaitTermination()
    parts = [
        catalog.records(catalog.resolve(name)).select(F.lit(name).alias("dataset"), "key", "name") for name in ("suppliers", "customers")
    ]
    return parts[0].unionAll(parts[1])
