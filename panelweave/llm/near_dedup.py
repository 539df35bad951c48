"""Near-duplicates by b-bit MinHash.

Each distinct shingle set gets a signature of ``bands * rows`` minima.  Bands
of whole minima give candidates: sets that agree in a band share a bucket.  Of
every minimum only the low bits are kept, packed into machine words; counting
equal fields estimates the similarity, corrected for fields that agree by
chance, and pairs whose estimate is six standard errors too low are dropped.
Links are confirmed on full sets.

A pair at the threshold misses all bands with a probability of 3e-6 by the
default parameters, and one that is linked fails the estimate with one of 1e-9.

Pairs of a group are never written out.  Equal sets are one node.  Then, in
three rounds, a bucket's members are compared with its first member, each with
its most similar member outside its own component, and last with all members
that are still in other components, by sets that come to the bucket, so that
only links leave it; a group of copies is one component after the first rounds,
and the last has nothing to do in it.  Buckets larger than a
block are compared block by block, each pair of blocks on its own.

Defined results: letters A-Z are lower-cased and words are
``[^\\x20\\x09-\\x0D]+``.  A text with fewer words than a shingle is one shingle.
Null, empty and wordless texts have no shingles and link with nothing.  The
component is the smallest id that can be reached; where a component has no id
it is null, and rows without an id are kept only there.  Repeated rows belong
to one component and have equal results.  Other columns are ignored, whatever
their names; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .components import components
from .shared import settle, small_side, stored, taken, text_slices
from .words import mix, run_hashes, word_hashes


@dataclass(frozen=True)
class Options:
    shingle_words: int = 5
    percent: int = 80  #: least similarity of a link, in hundredths
    bands: int = 32
    rows: int = 5
    bits: int = 4  #: kept of each minimum
    errors: float = 6.0  #: standard errors that an estimate may fall short by
    block: int = 1000  #: members of a bucket compared at once

    @property
    def least_estimate(self) -> float:
        chance = 2.0**-self.bits
        share = self.percent / 100
        agree = chance + (1 - chance) * share
        error = math.sqrt(agree * (1 - agree) / (self.bands * self.rows)) / (1 - chance)
        return share - self.errors * error

    @property
    def most_differing(self) -> int:
        """Fields that may differ for the estimate to reach its bound."""
        chance = 2.0**-self.bits
        agree = chance + (1 - chance) * self.least_estimate
        return math.floor((1 - agree) * self.bands * self.rows)


def shingle_set(words: np.ndarray, size: int) -> np.ndarray:
    """Sorted distinct hashes of a text's shingles."""
    if not len(words):
        return np.empty(0, dtype=np.uint64)
    return np.unique(run_hashes(words, min(size, len(words))))


class Signer:
    """Minima of a set under fixed hash functions."""

    def __init__(self, options: Options):
        rng = np.random.default_rng(971)
        count = options.bands * options.rows
        self.options = options
        self.times = rng.integers(0, 1 << 63, count, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.plus = rng.integers(0, 1 << 63, count, dtype=np.uint64)
        self.band = mix(rng.integers(0, 1 << 63, (options.bands, options.rows), dtype=np.uint64)) | np.uint64(1)

    def minima(self, shingles: np.ndarray) -> np.ndarray:
        least = np.full(len(self.times), np.iinfo(np.uint64).max, dtype=np.uint64)
        for i in range(0, len(shingles), 256):
            hashed = np.multiply.outer(self.times, shingles[i : i + 256])
            hashed += self.plus[:, None]
            np.minimum(least, hashed.min(axis=1), out=least)
        return least

    def band_keys(self, minima: np.ndarray) -> np.ndarray:
        options = self.options
        keys = (mix(minima).reshape(options.bands, options.rows) * self.band).sum(axis=1, dtype=np.uint64)
        return mix(keys + np.arange(options.bands, dtype=np.uint64))

    def packed(self, minima: np.ndarray) -> bytes:
        """The kept bits, as 64-bit words of whole fields."""
        per_word = 64 // self.options.bits
        kept = mix(minima) & np.uint64((1 << self.options.bits) - 1)
        kept = np.concatenate([kept, np.zeros(-len(kept) % per_word, dtype=np.uint64)]).reshape(-1, per_word)
        return (kept << (np.arange(per_word, dtype=np.uint64) * np.uint64(self.options.bits))).sum(axis=1, dtype=np.uint64).astype("<u8").tobytes()


def differing(a: np.ndarray, b: np.ndarray, bits: int) -> np.ndarray:
    """Fields that differ between packed signatures (last axis: words)."""
    x = a ^ b
    folded = x.copy()
    for shift in range(1, bits):
        folded |= x >> np.uint64(shift)
    ones = np.uint64(sum(1 << i for i in range(0, 64, bits)))
    return np.bitwise_count(folded & ones).sum(axis=-1, dtype=np.int64)


FEATURES = T.StructType(
    [
        T.StructField("text_key", T.BinaryType()),
        T.StructField("n_shingles", T.LongType()),
        T.StructField("node", T.BinaryType()),
        T.StructField("signature", T.BinaryType()),
        T.StructField("keys", T.ArrayType(T.LongType())),
    ]
)


def signatures(docs: DataFrame, options: Options) -> DataFrame:
    """``doc_id`` and :data:`FEATURES` for rows of ``doc_id, text_key, text``.

    A node is a digest of a whole shingle set; null where the set is empty.
    """
    schema = T.StructType([docs.schema["doc_id"], *FEATURES.fields])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        signer = Signer(options)
        for batch in batches:
            at = 0
            for texts in text_slices(batch.column("text").to_pylist()):
                counts, nodes, packed, keys = [], [], [], []
                for words in word_hashes([t.encode().lower() for t in texts]):
                    shingles = shingle_set(words, options.shingle_words)
                    counts.append(len(shingles))
                    if not len(shingles):
                        nodes.append(None), packed.append(None), keys.append(None)
                        continue
                    minima = signer.minima(shingles)
                    nodes.append(hashlib.blake2b(shingles.tobytes(), digest_size=16).digest())
                    packed.append(signer.packed(minima))
                    keys.append(signer.band_keys(minima).astype(np.int64))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").slice(at, len(texts)),
                        batch.column("text_key").slice(at, len(texts)),
                        pa.array(counts, pa.int64()),
                        pa.array(nodes, pa.binary()),
                        pa.array(packed, pa.binary()),
                        pa.array(keys, pa.list_(pa.int64())),
                    ],
                    schema.names,
                )
                at += len(texts)

    return docs.mapInArrow(work, schema)


def full_sets(docs: DataFrame, nodes: DataFrame, options: Options) -> DataFrame:
    """``number``, ``shingles`` of the given nodes (``number``, ``text_key``),
    from the text of one document each."""
    schema = T.StructType([T.StructField("number", T.LongType()), T.StructField("shingles", T.ArrayType(T.LongType()))])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for texts in text_slices(batch.column("text").to_pylist()):
                words = word_hashes([t.encode().lower() for t in texts])
                sets = pa.array([shingle_set(w, options.shingle_words).astype(np.int64) for w in words], pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([batch.column("number").slice(at, len(texts)), sets], schema.names)
                at += len(texts)

    texts = docs.select("text_key", "text").join(small_side(nodes, 72), "text_key").dropDuplicates(["number"])
    return texts.select("number", "text").mapInArrow(work, schema)


def confirmed(pairs: DataFrame, sets: DataFrame, options: Options) -> DataFrame:
    """Those of the pairs ``a``, ``b`` whose full sets are similar enough."""
    left = sets.select(F.col("number").alias("a"), F.col("shingles").alias("sa"))
    right = sets.select(F.col("number").alias("b"), F.col("shingles").alias("sb"))
    shared = F.size(F.array_intersect("sa", "sb")).cast("long")
    union = F.size("sa") + F.size("sb") - shared
    return pairs.join(left, "a").join(right, "b").where(shared * 100 >= union * options.percent).select("a", "b")


PAIRS = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType())])


def compare_buckets(members: DataFrame, options: Options, all_pairs: bool) -> DataFrame:
    """Pairs ``a``, ``b`` between components inside buckets.

    ``members`` has ``key``, ``number``, ``root``, ``signature`` and ``count``
    (members of the bucket).  Without ``all_pairs`` each member gives the pair
    with its most similar member of another component, a mere candidate.  With
    ``all_pairs``, which also takes the full sets as ``shingles``, every pair
    whose estimate is high enough is confirmed where it is found, and only
    links come out; a member linked to a component is not compared with the
    rest of it.  A pair that shares several bands (``keys``, of each member) is
    confirmed in the bucket of the first of them only.
    """
    blocks = F.ceil(F.col("count") / options.block).cast("int")
    own = F.pmod(F.xxhash64("number", "key"), blocks).cast("int")
    others = F.transform(F.sequence(F.lit(0), blocks - 1), lambda i: F.struct(F.least(own, i).alias("low"), F.greatest(own, i).alias("high")))
    carried = ["number", "root", "signature", *(["shingles", "keys"] if all_pairs else [])]
    placed = members.select("key", *carried, own.alias("own"), F.explode(others).alias("pair")).select(
        "key", "pair.low", "pair.high", *carried
    )
    partitions = int(members.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = placed.repartition(partitions, "key", "low", "high").sortWithinPartitions("key", "low", "high", "number")
    most, bits = options.most_differing, options.bits

    def compare(group: list[tuple], key: int) -> Iterator[tuple[int, int]]:
        if len(group) < 2 or all(g[1] == group[0][1] for g in group):
            return
        signed = np.frombuffer(b"".join(g[2] for g in group), dtype="<u8").reshape(len(group), -1)
        number = {root: i for i, root in enumerate({g[1] for g in group})}
        roots = np.array([number[g[1]] for g in group])
        bands = np.array([g[4] for g in group]) if all_pairs else None
        for i in range(len(group)):
            first = i + 1 if all_pairs else 0
            apart = np.flatnonzero(roots[first:] != roots[i]) + first
            if not len(apart):
                continue
            found = differing(signed[apart], signed[i], bits)
            if all_pairs:
                near = apart[found <= most]
                if not len(near):
                    continue
                first_shared = (bands[near] == bands[i]).argmax(axis=1)
                reached = set()
                for j in near[bands[i][first_shared] == key].tolist():
                    if roots[j] not in reached and similar(group[i][3], group[j][3]):
                        reached.add(roots[j])
                        yield ordered(group[i][0], group[j][0])
            else:
                best = int(found.argmin())
                if found[best] <= most:
                    yield ordered(group[i][0], group[int(apart[best])][0])

    def ordered(a: int, b: int) -> tuple[int, int]:
        return (a, b) if a < b else (b, a)

    def similar(a: np.ndarray, b: np.ndarray) -> bool:
        # Sets are sorted and distinct.
        if 100 * min(len(a), len(b)) < options.percent * max(len(a), len(b)):
            return False
        both = np.concatenate([a, b])
        both.sort(kind="stable")
        shared = int(np.count_nonzero(both[1:] == both[:-1]))
        return 100 * shared >= options.percent * (len(both) - shared)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, group, out = None, [], set()
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("key", "low", "high", "number", "root", "signature")]
            if all_pairs:
                columns += [[s.values.to_numpy() for s in batch.column(c)] for c in ("shingles", "keys")]
            for key, low, high, *member in zip(*columns):
                if (key, low, high) != current:
                    out.update(compare(group, current[0] if current else 0))
                    current, group = (key, low, high), []
                group.append(tuple(member))
            if len(out) > 50_000:
                yield _pair_batch(out)
                out = set()
        out.update(compare(group, current[0] if current else 0))
        yield _pair_batch(out)

    return ranged.mapInArrow(work, PAIRS)


def _pair_batch(pairs: set[tuple[int, int]]) -> pa.RecordBatch:
    a, b = zip(*sorted(pairs)) if pairs else ((), ())
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], PAIRS.names)


def _estimated(pairs: DataFrame, options: Options) -> DataFrame:
    """Pairs with signatures ``ga``, ``gb`` whose estimate is high enough."""
    most, bits = options.most_differing, options.bits

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            a, b = (
                np.frombuffer(b"".join(batch.column(c).to_pylist()), dtype="<u8").reshape(batch.num_rows, -1)
                for c in ("ga", "gb")
            )
            keep = pa.array(differing(a, b, bits) <= most)
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(keep), batch.column("b").filter(keep)], PAIRS.names)

    return pairs.select("a", "b", "ga", "gb").mapInArrow(work, PAIRS)


def _joined_labels(labels: DataFrame, links: DataFrame) -> DataFrame:
    """Labels after further links: only roots are linked, which are few."""
    ends = links
    for side in ("a", "b"):
        held = labels.select(F.col("number").alias(side), F.col("root").alias(f"r{side}"))
        ends = ends.join(held, side, "left")
    ends = ends.select(F.coalesce("ra", "a").alias("a"), F.coalesce("rb", "b").alias("b"))
    moved = components(ends).select(F.col("node").alias("root"), F.col("root").alias("to"))
    kept = labels.join(moved, "root", "left").select("number", F.coalesce("to", "root").alias("root"))
    # Ends that had no label were their own roots.
    fresh = moved.join(labels, moved["root"] == labels["number"], "left_anti").select(
        F.col("root").alias("number"), F.col("to").alias("root")
    )
    return settle(kept.unionByName(fresh))


def link_nodes(docs: DataFrame, features: DataFrame, options: Options) -> DataFrame:
    """``node`` and ``root`` of all nodes; the root is the number of some node
    of the component."""
    nodes = (
        features.where("node is not null")
        .groupBy("node")
        .agg(F.first("text_key").alias("text_key"), F.first("signature").alias("signature"), F.first("keys").alias("keys"))
    )
    # The numbers are written down with the nodes, so they stay what they are.
    held = stored(nodes.withColumn("number", F.monotonically_increasing_id()), "nodes")
    spread = held.select("number", F.explode("keys").alias("key"))
    shared = settle(
        spread.groupBy("key").agg(F.count("*").alias("count"), F.min("number").alias("leader")).where("count > 1")
    )
    members = settle(spread.join(small_side(shared.select("key"), 24), "key", "left_semi"))
    signed = settle(
        held.select("number", "text_key", "signature").join(
            small_side(members.select("number").distinct(), 24), "number", "left_semi"
        )
    )
    sets = stored(full_sets(docs, signed.select("number", "text_key"), options), "sets")

    star = (
        members.join(shared, "key")
        .where("number <> leader")
        .select(F.col("leader").alias("a"), F.col("number").alias("b"))
        .distinct()
    )
    sides = {
        side: signed.select(F.col("number").alias(side), F.col("signature").alias(f"g{side}")) for side in ("a", "b")
    }
    candidates = settle(_estimated(star.join(sides["a"], "a").join(sides["b"], "b"), options))
    links = settle(confirmed(candidates, sets, options))
    labels = components(links).select(F.col("node").alias("number"), "root")
    for all_pairs in (False, True):
        rooted = members.join(labels, "number", "left").select(
            "key", "number", F.coalesce("root", "number").alias("root")
        )
        mixed = settle(
            rooted.groupBy("key")
            .agg(F.count("*").alias("count"), F.min("root").alias("least"), F.max("root").alias("most"))
            .where("least <> most")
            .select("key", "count")
        )
        if mixed.isEmpty():
            break
        open_members = rooted.join(mixed, "key").join(signed.select("number", "signature"), "number")
        if all_pairs:
            told = open_members.join(sets, "number").join(held.select("number", "keys"), "number")
            more = settle(compare_buckets(told, options, True).distinct())
        else:
            more = settle(confirmed(settle(compare_buckets(open_members, options, False).distinct()), sets, options))
        if not more.isEmpty():
            labels = _joined_labels(labels, more)
    return held.select("node", "number").join(labels, "number", "left").select(
        "node", F.coalesce("root", "number").alias("root")
    )


def _least(features: DataFrame, labels: DataFrame, value: Column) -> DataFrame:
    """For every node the least ``value`` of the rows of its component."""
    own = features.where("node is not null").groupBy("node").agg(F.min(value).alias("least"))
    rooted = settle(own.join(labels, "node"))
    roots = rooted.groupBy("root").agg(F.min("least").alias("component"))
    return settle(rooted.join(roots, "root").select("node", "component"))


def _linked(df: DataFrame, id_col: str, text_col: str, options: Options) -> tuple[DataFrame, DataFrame]:
    """Features of every row, and the root of every node."""
    docs = taken(df, {"doc_id": F.col(id_col), "text": F.coalesce(F.col(text_col), F.lit(""))})
    docs = docs.withColumn("text_key", F.unhex(F.md5("text")))
    features = stored(signatures(docs, options), "signatures")
    return features, link_nodes(docs, features, options)


def near_duplicates(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", options: Options = Options()
) -> DataFrame:
    """One row per input row: ``doc_id``, ``n_shingles``, ``component_id``
    (smallest id of its component) and ``kept``."""
    features, labels = _linked(df, id_col, text_col, options)
    found = _least(features, labels, F.col("doc_id"))
    component = F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component"))
    return features.select("doc_id", "n_shingles", "node").join(found, "node", "left").select(
        "doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept")
    )


def _row_key(doc_id: Column, text_key: Column) -> Column:
    """One text for id and digest; no id differs from every id."""
    return F.concat(text_key, F.coalesce(F.concat(F.lit("="), doc_id.cast("string")), F.lit("")))


def one_of_each(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", options: Options = Options()) -> DataFrame:
    """The rows of ``df`` that stay, with all their columns: of each component
    one row, with the smallest id and of that id's texts the one with the
    smallest digest, and every row without shingles.  A row without an id stays
    only where its component has no id."""
    features, labels = _linked(df, id_col, text_col, options)
    first = F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "text_key")
    mine = _row_key(F.col("doc_id"), F.lower(F.hex("text_key")))
    rows = features.join(_least(features, labels, first), "node").select(
        mine.alias("_key"),
        (F.col("doc_id").eqNullSafe(F.col("component.doc_id")) & (F.col("text_key") == F.col("component.text_key"))).alias("stays"),
    )
    told = settle(rows.groupBy("_key").agg(F.first("stays").alias("stays"), F.count("*").alias("count")))
    gone, repeated = (told.where(c).select("_key") for c in ("not stays", "stays and count > 1"))
    keyed = df.withColumn("_key", _row_key(F.col(id_col), F.md5(F.coalesce(F.col(text_col), F.lit("")))))
    kept = keyed.join(small_side(gone, 96), "_key", "left_anti")
    if not repeated.isEmpty():
        repeated = small_side(repeated, 96)
        kept = kept.join(repeated, "_key", "left_anti").unionByName(
            kept.join(repeated, "_key", "left_semi").dropDuplicates(["_key"])
        )
    return kept.select(*df.columns)
