"""Near dedup: ProbMinHash signatures, banding, exact verification, components.

1. One pass over the texts: shingles, signature, band keys; only these are kept.
2. Texts with equal shingle sets become one node.
3. Nodes that share a band key are candidates. Pairs within a bucket are not written
   out: every member is first compared with one leader, the member that meets most
   others. Links found so become components, and in the buckets that still hold
   several components the members of different components are compared, first with
   eight leaders, then with each other. Two members of one component need no
   comparison, as their link could change no class. Members of large buckets meet in
   tiles: all pairs of two tiles are compared inside a task, on the sets themselves,
   and only links that join components leave it. In the rounds before that, and in
   small buckets, pairs are passed over only where the numbers of shingles alone
   rule a link out: the similarity is at most the smaller number by the larger.
4. A comparison is exact: the Jaccard similarity of the sets of five-word shingles,
   0.8 or more for a link.
5. Components give the classes; a class is named by its smallest doc_id.

Defined cases: null and empty texts are classes of their own; texts of one to four
words are one shingle; equal texts are one class; rows with the same doc_id count as
one document in ``classes``; null doc_ids never name a class that has others; an empty
table gives an empty result; further columns are ignored, or carried by ``drop_near_copies``.
That keeps one row of each class, told apart by doc_id and digest of the text, so unrelated
texts under one doc_id, or under none, all stay; copies without a doc_id of texts that have
one stay with the other rows without a doc_id if one of those names its class.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, Window, functions as F

from recordloom.llm import prob_minhash as pm
from recordloom.llm.common import saved, own_names, plain_names, text_or_empty, worker_holds
from recordloom.llm.components import components

SIMILARITY = 0.8
BLOCK_SHINGLES = 300_000
SMALL_BUCKET = 32
TILE_UNITS, UNIT_SHINGLES = 256, 1024
COLUMNS = 8192


def text_digest() -> Column:
    """With the doc_id, it tells rows apart."""
    return F.unhex(F.sha2(text_or_empty(), 256))


def signature_rows(docs: DataFrame) -> DataFrame:
    """doc_id, digest of the text, key of the shingle set (null without words), band keys, number of shingles."""

    def sign(batches):
        hashes = worker_holds("word hashes", pm.new_word_hashes)

        def block(ids, digests, found):
            sizes = [len(e) for e, _ in found]
            owner = np.repeat(np.arange(len(found)), sizes)
            signed = pm.signatures(np.concatenate([e for e, _ in found]), np.concatenate([w for _, w in found]), owner, len(found))
            keys = pm.band_keys(signed)
            empty = np.array(sizes) == 0
            names = [None if none else pm.set_key(e) for none, (e, _) in zip(empty, found)]
            bands = pa.FixedSizeListArray.from_arrays(pa.array(keys.ravel()), pm.BANDS).cast(pa.list_(pa.int64()))
            return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(digests, pa.binary()), pa.array(names, pa.binary()), bands, pa.array(sizes, pa.int32())], ["doc_id", "digest", "key", "bands", "extent"])

        for batch in batches:
            ids, digests, found, n = [], [], [], 0
            for doc_id, digest, text in zip(batch["doc_id"].to_pylist(), batch["digest"].to_pylist(), batch["text"]):
                ids.append(doc_id)
                digests.append(digest)
                found.append(pm.shingles(text.as_py(), hashes))
                n += len(found[-1][0]) + 16
                if n >= BLOCK_SHINGLES:
                    yield block(ids, digests, found)
                    ids, digests, found, n = [], [], [], 0
            if ids:
                yield block(ids, digests, found)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_digest().alias("digest"), text_or_empty().alias("text"))
    return rows.mapInArrow(sign, "doc_id long, digest binary, key binary, bands array<long>, extent int")


def shingle_sets(docs: DataFrame) -> DataFrame:
    """key and the sorted shingles, for documents with words; needs doc_id and text."""

    def sets(batches):
        hashes = worker_holds("word hashes", pm.new_word_hashes)
        for batch in batches:
            found = [pm.shingles(text.as_py(), hashes)[0] for text in batch["text"]]
            yield pa.RecordBatch.from_arrays(
                [pa.array([pm.set_key(e) for e in found], pa.binary()), pa.array([e.view(np.int64) for e in found], pa.list_(pa.int64()))],
                ["key", "shingles"],
            )

    return docs.select(text_or_empty().alias("text")).mapInArrow(sets, "key binary, shingles array<long>")


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose shingle sets are similar enough."""
    left = sets.select(F.col("key").alias("a"), F.col("shingles").alias("x"))
    right = sets.select(F.col("key").alias("b"), F.col("shingles").alias("y"))
    both = pairs.join(left, "a").join(right, "b")
    shared = F.size(F.array_intersect("x", "y"))
    united = F.size("x") + F.size("y") - shared
    return both.filter(shared * 100 >= united * int(100 * SIMILARITY)).select("a", "b")


def _ordered(a: str, b: str):
    return F.least(a, b).alias("a"), F.greatest(a, b).alias("b")


def _buckets(nodes: DataFrame) -> DataFrame:
    """bucket, key, extent, size, weight: members of the band buckets that hold more than one node."""
    exploded = nodes.select("key", "extent", F.explode("bands").alias("bucket"))
    shared = exploded.groupBy("bucket").agg(F.count(F.lit(1)).alias("size")).filter("size > 1")
    members = saved(exploded.join(shared, "bucket"), "buckets")
    weight = members.groupBy("key").agg(F.sum("size").alias("weight"))
    return saved(members.join(weight, "key"), "bucket-members")


def _possible(a: str, b: str):
    """Whether sets of so many shingles can be similar enough."""
    return F.least(a, b) * 100 >= F.greatest(a, b) * int(100 * SIMILARITY)


def _leader_pairs(members: DataFrame, leaders: int, salt: int) -> DataFrame:
    """Members with leaders of their bucket that lie in another component."""
    part = F.pmod(F.xxhash64("key", F.lit(salt)), F.lit(leaders))
    chosen = members.groupBy("bucket", part.alias("part")).agg(F.max_by(F.struct("key", "component", "extent"), F.struct("weight", "key")).alias("leader"))
    found = members.join(chosen.drop("part"), "bucket").filter("component != leader.component").filter(_possible("extent", "leader.extent"))
    return found.select(*_ordered("key", "leader.key")).distinct()


def _crossing_pairs(members: DataFrame) -> DataFrame:
    """All pairs of a bucket whose members lie in different components."""
    main = members.groupBy("bucket", "component").count().groupBy("bucket").agg(F.max_by("component", "count").alias("main"))
    minor = members.join(main, "bucket").filter("component != main").select("bucket", F.col("key").alias("other"), F.col("component").alias("apart"), F.col("extent").alias("theirs"))
    found = members.join(minor, "bucket").filter("component != apart").filter(_possible("extent", "theirs"))
    return found.select(*_ordered("key", "other")).distinct()


def joining_links(a: dict, b: dict) -> list[tuple[bytes, bytes]]:
    """Links between the nodes of two tiles, as many as join their components.

    Shared shingles are counted by products of 0/1 matrices over the shingles that
    both tiles hold, some thousand of them at a time.
    """
    both = np.intersect1d(a["shingles"], b["shingles"])
    shared = np.zeros((len(a["keys"]), len(b["keys"])), dtype=np.float32)
    for k in range(0, len(both), COLUMNS):
        some = both[k : k + COLUMNS]
        sides = []
        for x in (a, b):
            at = np.minimum(np.searchsorted(some, x["shingles"]), len(some) - 1)
            hit = some[at] == x["shingles"]
            matrix = np.zeros((len(x["keys"]), len(some)), dtype=np.float32)
            matrix[np.repeat(np.arange(len(x["keys"])), x["sizes"])[hit], at[hit]] = 1
            sides.append(matrix)
        shared += sides[0] @ sides[1].T
    counts = np.rint(shared).astype(np.int64)
    united = a["sizes"][:, None] + b["sizes"][None, :] - counts
    names: dict[bytes, bytes] = {}

    def root(c: bytes) -> bytes:
        while c in names:
            c = names[c]
        return c

    found = []
    for i, j in zip(*np.nonzero(counts * 100 >= united * int(100 * SIMILARITY))):
        x, y = root(a["components"][i]), root(b["components"][j])
        if x != y:
            names[max(x, y)] = min(x, y)
            found.append((a["keys"][i], b["keys"][j]))
    return found


def _tile_links(members: DataFrame, sets: DataFrame) -> DataFrame:
    """Links (a, b) that join components of large buckets; every pair of a bucket is compared."""
    schema = "tile long, keys array<binary>, components array<binary>, sizes array<int>, shingles array<long>"
    arrow = pa.schema([("tile", pa.int64()), ("keys", pa.list_(pa.binary())), ("components", pa.list_(pa.binary())), ("sizes", pa.list_(pa.int32())), ("shingles", pa.list_(pa.int64()))])

    def gather(key, table):
        shingles = table["shingles"].combine_chunks()
        row = [key[0].as_py(), table["key"].to_pylist(), table["component"].to_pylist(), pa.compute.list_value_length(shingles).to_pylist(), shingles.flatten().to_numpy()]
        return pa.table([pa.array([x], t) for x, t in zip(row, arrow.types)], schema=arrow)

    def compare(batches):
        for batch in batches:
            for r in range(len(batch)):
                sides = []
                for s in "ab":
                    side = {c: batch[f"{c}_{s}"][r] for c in ("keys", "components", "sizes", "shingles")}
                    sides.append({c: v.as_py() if c in ("keys", "components") else v.values.to_numpy().astype(np.int64) for c, v in side.items()})
                if len({*sides[0]["components"], *sides[1]["components"]}) > 1:
                    found = joining_links(*sides)
                    yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], pa.binary()) for i in (0, 1)], ["a", "b"])

    home = members.groupBy("key").agg(F.max_by("bucket", F.struct("size", "bucket")).alias("home"), F.min("component").alias("component"))
    loaded = saved(home.join(sets, "key"), "large-buckets")
    # Tiles are equal runs of a line on which the nodes lie home by home, however they are partitioned.
    units = F.greatest(F.ceil(F.size("shingles") / UNIT_SHINGLES), F.lit(1))
    homes = loaded.groupBy("home").agg(F.sum(units).alias("units"))
    before = F.sum("units").over(Window.orderBy("home").rowsBetween(Window.unboundedPreceding, -1))  # one short row per large bucket
    place = F.col("start") + F.pmod(F.xxhash64("key"), F.col("units"))
    placed = loaded.join(homes.withColumn("start", F.coalesce(before, F.lit(0))), "home").withColumn("tile", F.floor(place / TILE_UNITS))
    placed = saved(placed.select("tile", "key", "component", "shingles"), "placed")
    tiles = saved(placed.groupBy("tile").applyInArrow(gather, schema), "tiles")
    touched = members.select("bucket", "key").join(placed.select("tile", "key"), "key").select("bucket", "tile").distinct()
    pairs = touched.withColumnRenamed("tile", "tile_a").join(touched.withColumnRenamed("tile", "tile_b"), "bucket")
    pairs = saved(pairs.filter("tile_a <= tile_b").select("tile_a", "tile_b").distinct(), "tile-pairs")
    side = lambda s: tiles.select(*(F.col(c).alias(f"{c}_{s}") for c in tiles.columns))
    return pairs.join(side("a"), "tile_a").join(side("b"), "tile_b").mapInArrow(compare, "a binary, b binary")


def links(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Verified links (a, b) between nodes, enough of them to connect every class; ``nodes`` has key, rep_id, rep_digest, bands, extent."""
    members = _buckets(nodes)
    wanted = members.select("key").distinct().join(nodes.select("key", "rep_id", "rep_digest"), "key")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_digest().alias("digest"), "text")
    texts = texts.join(wanted, F.col("doc_id").eqNullSafe(F.col("rep_id")) & (F.col("digest") == F.col("rep_digest")))
    sets = saved(shingle_sets(texts).dropDuplicates(["key"]), "shingle-sets")
    state = members.withColumn("component", F.col("key"))
    tested = edges = None
    for number, leaders in enumerate((1, 8, None)):
        pairs = _leader_pairs(state, leaders, number) if leaders else _crossing_pairs(state.filter(F.col("size") <= SMALL_BUCKET))
        if tested is not None:
            pairs = pairs.join(tested, ["a", "b"], "left_anti")
        pairs = saved(pairs, "pairs")
        fresh = _verified(pairs, sets)
        edges = saved(fresh if edges is None else edges.unionAll(fresh), "links")
        if leaders is None:
            return saved(edges.unionAll(_tile_links(state.filter(F.col("size") > SMALL_BUCKET), sets)), "all-links")
        tested = pairs if tested is None else tested.unionAll(pairs)
        labels = components(edges)
        named = members.join(labels.withColumnRenamed("node", "key"), "key", "left")
        named = named.withColumn("component", F.coalesce("component", "key"))
        open_ = named.groupBy("bucket").agg(F.min("component").alias("low"), F.max("component").alias("high")).filter("low != high")
        state = saved(named.filter("size > 2").join(open_.select("bucket"), "bucket"), "open-buckets")


def _first_row(*more: str) -> Column:
    """The row with the smallest doc_id; rows without one come last."""
    return F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "digest", *more))


def _classified(docs: DataFrame) -> DataFrame:
    """One row per row: doc_id, digest, class_id, class_key (null without words)."""
    rows = saved(signature_rows(docs), "signatures")
    worded = rows.filter("key is not null")
    nodes = worded.groupBy("key").agg(_first_row().alias("rep"), F.first("bands").alias("bands"), F.first("extent").alias("extent"))
    nodes = saved(nodes.select("key", F.col("rep.doc_id").alias("rep_id"), F.col("rep.digest").alias("rep_digest"), "bands", "extent"), "nodes")
    labels = saved(components(links(docs, nodes)), "labels")
    members = nodes.select("key", "rep_id").join(labels.withColumnRenamed("node", "key"), "key")
    least = members.groupBy("component").agg(F.min("rep_id").alias("least_id"))
    linked = members.join(least, "component").select("key", "component", "least_id")
    named = nodes.select("key", "rep_id").join(linked, "key", "left").select("key", F.coalesce("least_id", "rep_id").alias("class_id"), F.coalesce("component", "key").alias("class_key"))
    named = saved(named, "class-names")  # no join above it: the next one can split a key that many rows share
    found = worded.select("doc_id", "digest", "key").join(named, "key").select("doc_id", "digest", "class_id", "class_key")
    return found.unionAll(rows.filter("key is null").select("doc_id", "digest", F.col("doc_id").alias("class_id"), F.lit(None).cast("binary").alias("class_key")))


def classes(docs: DataFrame) -> DataFrame:
    """One row per row: doc_id, class_id, kept (the document names its class)."""
    return _classified(docs).select("doc_id", "class_id", F.col("doc_id").eqNullSafe(F.col("class_id")).alias("kept"))


def drop_near_copies(docs: DataFrame) -> DataFrame:
    """One row of each class, one with the doc_id that names it, with all its columns."""
    found = saved(_classified(docs), "classes")
    counted = found.groupBy("class_key", "class_id", "doc_id", "digest").agg(F.count(F.lit(1)).alias("twins"))
    first = counted.filter("class_key is not null").groupBy("class_key").agg(_first_row("twins").alias("first"))
    kept = first.select("first.doc_id", "first.digest", (F.col("first.twins") > 1).alias("__once"))
    kept = kept.unionAll(counted.filter("class_key is null").select("doc_id", "digest", F.expr("doc_id is not null and twins > 1")))
    if not found.filter("doc_id is null and class_id is null").isEmpty():
        kept = kept.unionAll(counted.filter("doc_id is null and class_id is not null").select("doc_id", "digest", F.lit(False)))
    kept = kept.withColumnsRenamed({"doc_id": "__id", "digest": "__kept"})
    plain, names = plain_names(docs, "doc_id", "text")
    rows = plain.withColumn("__digest", text_digest())
    rows = rows.join(saved(kept, "kept"), F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("__digest") == F.col("__kept")))
    once = rows.filter("__once").dropDuplicates(["doc_id", "__digest"])
    return own_names(rows.filter("not __once").select(*plain.columns).unionAll(once.select(*plain.columns)), names)
