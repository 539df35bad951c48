"""Removal of passages that occur more than once, by level-wise doubling.

Short windows are looked up first; only those that occur again, anywhere, are
extended to twice their length and looked up again, until the asked length is
reached or none is left.  Three choices keep this small:

* The shortest windows are taken at anchors only: words whose window of
  ``base`` words has the least hash of all windows in some asked window.  Two
  equal passages of the asked length have an anchor at the same place, about
  one word in fourteen is one, and which words are anchors follows from the
  passage alone.
* A window grows to both sides.  While its length is at most a third of the
  asked one, at least one of the two windows of twice that length lies within
  any asked window that holds it; so doubling goes on that far, from 8 to 16
  for a window of 35, to 128 for one of 200, and the asked length is last.
* Behind the first doubling, texts are read only where a window survived.

Windows travel as packed records in buckets of their hash.  A hash that occurs
twice in one piece of a task's input is settled there and sends a single record
on as evidence, so the most frequent passage is one record for each megabyte of
text, not one for each place; equal texts are worked on once a task.

The asked windows are compared by 128 bits of hash.

Defined results: words are ``[^\\x20\\x09-\\x0D]+``, unchanged.  A null or empty
text has none.  Of texts that occur more than once all words go, if they fill a
window.  Overlapping places of one text are different places.  Rows with null or
repeated ids are rows like any other, and a repeated row repeats its passages.
Other columns are ignored, whatever their names.  An empty table gives an empty
result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import settle, small_side, stored, taken, text_slices
from .words import mix, run_hashes, word_hashes

WINDOW = 35
BASE = 8
#: Bytes of text for each bucket of window hashes.
BUCKET_BYTES = 4 << 20
SLICE_CHARS = 1 << 20
_PLACE = [("k1", "<u8"), ("k2", "<u8"), ("at", "<i4")]
ANCHOR = np.dtype([("h", "<u8"), *_PLACE, ("left", "<u8"), ("right", "<u8"), ("state", "u1")])
DOUBLED = np.dtype([("h", "<u8"), *_PLACE, ("state", "u1")])
ASKED = np.dtype([("h", "<u8"), ("h2", "<u8"), *_PLACE, ("state", "u1")])
PLACE = np.dtype(_PLACE)
#: Record states: to be looked up, already known to repeat, mere evidence.
OPEN, KNOWN, EVIDENCE = 0, 1, 2
_ROWS = T.StructType([T.StructField("bucket", T.IntegerType()), T.StructField("payload", T.BinaryType())])
_FOUND = T.StructType([T.StructField("text_key", T.BinaryType()), T.StructField("places", T.BinaryType())])


def anchors_of(words: np.ndarray, base: int, window: int) -> np.ndarray:
    """Places of base windows that are the least in some asked window (the
    first of equals)."""
    if len(words) < window:
        return np.empty(0, dtype=np.int64)
    order = mix(run_hashes(words, base))
    spans = np.lib.stride_tricks.sliding_window_view(order, window - base + 1)
    return np.unique(np.argmin(spans, axis=1) + np.arange(len(spans)))


def _groups(records: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Records sorted by hash, and for each whether its hash has two places or
    evidence; copies of one record are one place."""
    names = ["h2", "h"] if "h2" in records.dtype.names else ["h"]
    records = records[np.lexsort([records["at"], records["k2"], records["k1"], *[records[n] for n in names]])]
    if not len(records):
        return records, np.zeros(0, dtype=bool)
    new = np.ones(len(records), dtype=bool)
    new[1:] = np.logical_or.reduce([records[n][1:] != records[n][:-1] for n in names])
    fresh = new.copy()
    for name in ("k1", "k2", "at"):
        fresh[1:] |= records[name][1:] != records[name][:-1]
    group = np.cumsum(new) - 1
    places = np.bincount(group, weights=fresh)
    proven = np.bincount(group, weights=records["state"] == EVIDENCE)
    return records, ((places > 1) | (proven > 0))[group]


def _send(records: np.ndarray, buckets: int) -> Iterator[tuple[int, bytes]]:
    """Pack records by bucket.  What repeats among them is known; each such
    hash goes on as one piece of evidence, its places to where they balance."""
    records, repeated = _groups(records)
    known = records[repeated]
    first = np.ones(len(known), dtype=bool)
    first[1:] = known["h"][1:] != known["h"][:-1]
    if "h2" in known.dtype.names:
        first[1:] |= known["h2"][1:] != known["h2"][:-1]
    evidence = known[first].copy()
    evidence["state"] = EVIDENCE
    known["state"] = KNOWN
    sent = np.concatenate([records[~repeated], evidence, known])
    target = sent["h"] % np.uint64(buckets)
    spread = sent["state"] == KNOWN
    target[spread] = mix(sent["k1"][spread]) % np.uint64(buckets)
    order = np.lexsort([sent["at"], sent["k1"], target])
    sent, target = sent[order], target[order]
    cuts = np.flatnonzero(np.diff(target)) + 1
    for part, bucket in zip(np.split(sent, cuts), target[np.concatenate([[0], cuts])] if len(sent) else []):
        yield int(bucket), part.tobytes()


def _batch(rows: list[tuple[int, bytes]]) -> pa.RecordBatch:
    numbers, payloads = zip(*rows) if rows else ((), ())
    return pa.RecordBatch.from_arrays([pa.array(numbers, pa.int32()), pa.array(payloads, pa.binary())], _ROWS.names)


def _by_bucket(
    rows: DataFrame, kind: np.dtype, then: Callable[[np.ndarray], Iterator[pa.RecordBatch]], schema: T.StructType
) -> DataFrame:
    """Bring the records of each bucket together and hand them to ``then``."""
    partitions = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = rows.repartition(partitions, "bucket").sortWithinPartitions("bucket")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, held = None, []
        for batch in batches:
            for bucket, payload in zip(batch.column("bucket").to_pylist(), batch.column("payload").to_pylist()):
                if bucket != current and held:
                    yield from then(np.frombuffer(b"".join(held), dtype=kind))
                    held = []
                current = bucket
                held.append(payload)
        if held:
            yield from then(np.frombuffer(b"".join(held), dtype=kind))

    return ranged.mapInArrow(work, schema)


def _look_up(rows: DataFrame, kind: np.dtype, then: Callable[[np.ndarray], Iterator[pa.RecordBatch]]) -> DataFrame:
    """Hand the repeated records of each bucket to ``then``."""

    def resolve(records: np.ndarray) -> Iterator[pa.RecordBatch]:
        open_ones, repeated = _groups(records[records["state"] != KNOWN])
        found = open_ones[repeated & (open_ones["state"] == OPEN)]
        yield from then(np.concatenate([found, records[records["state"] == KNOWN]]))

    return _by_bucket(rows, kind, resolve, _ROWS)


def _texts_of(rows: DataFrame) -> DataFrame:
    """One row for each text, with the places found in it by all buckets."""
    return _by_bucket(rows, PLACE, _by_text, _FOUND)


def _keyed(records: np.ndarray, key: bytes) -> np.ndarray:
    records["k1"], records["k2"] = np.frombuffer(key, dtype="<u8")
    return records


def _to_texts(records: np.ndarray, buckets: int) -> Iterator[pa.RecordBatch]:
    """Pack the places found by buckets of texts."""
    target = mix(records["k1"]) % np.uint64(buckets)
    order = np.lexsort([records["at"], records["k1"], target])
    places = np.empty(len(records), dtype=PLACE)
    for name in PLACE.names:
        places[name] = records[name][order]
    cuts = np.flatnonzero(np.diff(target[order])) + 1
    firsts = target[order][np.concatenate([[0], cuts])] if len(places) else []
    yield _batch([(int(bucket), part.tobytes()) for part, bucket in zip(np.split(places, cuts), firsts)])


def _by_text(records: np.ndarray) -> Iterator[pa.RecordBatch]:
    """One row for each text: its key and the places found."""
    records = records[np.lexsort([records["at"], records["k2"], records["k1"]])]
    if not len(records):
        return
    cuts = np.flatnonzero((np.diff(records["k1"]) != 0) | (np.diff(records["k2"]) != 0)) + 1
    parts = np.split(records, cuts)
    keys = [np.array([p["k1"][0], p["k2"][0]], dtype="<u8").tobytes() for p in parts]
    places = [np.unique(p["at"]).astype("<i4").tobytes() for p in parts]
    yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(places, pa.binary())], _FOUND.names)


def _anchor_records(key: bytes, words: np.ndarray, base: int, window: int) -> np.ndarray:
    at = anchors_of(words, base, window)
    doubled = run_hashes(words, 2 * base)
    made = np.zeros(len(at), dtype=ANCHOR)
    made["h"], made["at"] = run_hashes(words, base)[at], at
    inside = at + 2 * base <= len(words)
    made["right"][inside] = doubled[at[inside]]
    made["left"][at >= base] = doubled[at[at >= base] - base]
    return _keyed(made, key)


def _doubled_records(anchors: np.ndarray, base: int) -> np.ndarray:
    """Both extensions of each anchor; a hash of 0 says there is none."""
    sides = []
    for name, shift in (("left", -base), ("right", 0)):
        held = anchors[anchors[name] != 0]
        made = np.zeros(len(held), dtype=DOUBLED)
        made["h"], made["k1"], made["k2"], made["at"] = held[name], held["k1"], held["k2"], held["at"] + shift
        sides.append(made)
    return np.concatenate(sides)


def _extended_records(key: bytes, words: np.ndarray, starts: np.ndarray, length: int) -> np.ndarray:
    """The windows of twice ``length`` that extend those at ``starts`` to
    either side."""
    at = np.unique(np.concatenate([starts - length, starts]))
    at = at[(at >= 0) & (at + 2 * length <= len(words))]
    made = np.zeros(len(at), dtype=DOUBLED)
    made["h"], made["at"] = run_hashes(words, 2 * length)[at], at
    return _keyed(made, key)


def _asked_records(key: bytes, words: np.ndarray, starts: np.ndarray, length: int, window: int) -> np.ndarray:
    """The asked windows that hold any of the windows of ``length`` words at
    ``starts``."""
    count = len(words) - window + 1
    change = np.zeros(count + 1, dtype=np.int64)
    np.add.at(change, np.clip(starts - (window - length), 0, count), 1)
    np.add.at(change, np.clip(starts + 1, 0, count), -1)
    at = np.flatnonzero(np.cumsum(change[:-1]) > 0)
    made = np.zeros(len(at), dtype=ASKED)
    made["h"], made["h2"], made["at"] = run_hashes(words, window)[at], run_hashes(words, window, seed=1)[at], at
    return _keyed(made, key)


def _kept_digest(words: list[bytes], removed: np.ndarray | None = None) -> str:
    if removed is not None:
        words = [w for w, gone in zip(words, removed.tolist()) if not gone]
    return hashlib.sha256(b" ".join(words)).hexdigest()


def repeated_windows(df: DataFrame, text_col: str = "text", window: int = WINDOW, base: int = BASE) -> DataFrame:
    """Distinct texts with asked windows that start at two places or more:
    ``text_key``, ``text``, ``places`` (packed 4-byte starts)."""
    if not 1 <= base <= (window + 1) // 3:
        raise ValueError("the base length must be at most a third of the window")
    docs = taken(df, {"text": F.col(text_col)}).where("length(text) > 0")
    docs = docs.select(F.unhex(F.md5("text")).alias("text_key"), "text")
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // BUCKET_BYTES))

    def emit(records_of: Callable[..., np.ndarray], extra: bool) -> Callable:
        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            seen: set[bytes] = set()
            for batch in batches:
                keys = batch.column("text_key").to_pylist()
                more = batch.column("places").to_pylist() if extra else None
                at = 0
                for texts in text_slices(batch.column("text").to_pylist(), SLICE_CHARS):
                    made = []
                    for i, words in enumerate(word_hashes([t.encode() for t in texts]), at):
                        if keys[i] not in seen:
                            seen.add(keys[i])
                            made.append(records_of(keys[i], words, *([more[i]] if extra else [])))
                    at += len(texts)
                    if made:
                        yield _batch(list(_send(np.concatenate(made), buckets)))

        return work

    def to_doubled(anchors: np.ndarray) -> Iterator[pa.RecordBatch]:
        yield _batch(list(_send(_doubled_records(anchors, base), buckets)))

    def to_texts(found: np.ndarray) -> Iterator[pa.RecordBatch]:
        return _to_texts(found, buckets)

    def placed(records_of: Callable[..., np.ndarray], *sizes: int) -> Callable[..., np.ndarray]:
        def work(key: bytes, words: np.ndarray, places: bytes) -> np.ndarray:
            return records_of(key, words, np.frombuffer(places, dtype="<i4").astype(np.int64), *sizes)

        return work

    first = docs.mapInArrow(emit(lambda key, words: _anchor_records(key, words, base, window), False), _ROWS)
    second = _look_up(first, ANCHOR, to_doubled)
    held, length, texts = settle(_texts_of(_look_up(second, DOUBLED, to_texts))), 2 * base, docs
    while True:
        wanted = small_side(held.select("text_key"), 40)
        texts = texts.join(wanted, "text_key", "left_semi").dropDuplicates(["text_key"])
        candidates = stored(texts.join(held, "text_key"), "candidates")
        if length > (window + 1) // 3 or held.isEmpty():
            break
        extended = candidates.mapInArrow(emit(placed(_extended_records, length), True), _ROWS)
        held = settle(_texts_of(_look_up(extended, DOUBLED, to_texts)))
        length, texts = 2 * length, candidates.drop("places")
    third = candidates.mapInArrow(emit(placed(_asked_records, length, window), True), _ROWS)
    found = _texts_of(_look_up(third, ASKED, to_texts))
    return candidates.drop("places").join(found, "text_key")


def remove_repeats(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    window: int = WINDOW,
    base: int = BASE,
    with_text: bool = False,
) -> DataFrame:
    """One row per input row: ``doc_id``, ``n_words``, ``n_removed``,
    ``kept_sha256`` (of the kept words joined by spaces) and, if asked for,
    ``kept_text``."""
    docs = taken(df, {"doc_id": F.col(id_col), "text": F.coalesce(F.col(text_col), F.lit(""))})
    docs = docs.withColumn("text_key", F.unhex(F.md5("text")))
    kind = docs.schema["doc_id"]
    text_field = [T.StructField("kept_text", T.StringType())] if with_text else []
    plain_schema = T.StructType(
        [
            kind,
            T.StructField("text_key", T.BinaryType()),
            T.StructField("n_words", T.LongType()),
            T.StructField("plain_sha256", T.StringType()),
        ]
    )

    def plain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, digests = [], []
            for text in batch.column("text"):
                words = text.as_py().encode().split()
                counts.append(len(words))
                digests.append(_kept_digest(words))
            made = [batch.column("doc_id"), batch.column("text_key"), pa.array(counts, pa.int64()), pa.array(digests, pa.string())]
            yield pa.RecordBatch.from_arrays(made, plain_schema.names)

    slim = settle(docs.mapInArrow(plain, plain_schema))
    copies = slim.where(F.col("n_words") >= window).groupBy("text_key").count().where("count > 1")
    cut_schema = T.StructType(
        [
            T.StructField("text_key", T.BinaryType()),
            T.StructField("removed", T.LongType()),
            T.StructField("cut_sha256", T.StringType()),
            *text_field,
        ]
    )

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, digests, texts = [], [], []
            for text, places in zip(batch.column("text"), batch.column("places")):
                words = text.as_py().encode().split()
                change = np.zeros(len(words) + 1, dtype=np.int64)
                starts = np.unique(np.frombuffer(places.as_py(), dtype="<i4"))
                change[starts] += 1
                change[starts + window] -= 1
                gone = np.cumsum(change[:-1]) > 0
                counts.append(int(gone.sum()))
                digests.append(_kept_digest(words, gone))
                if with_text:
                    texts.append(b" ".join(w for w, g in zip(words, gone.tolist()) if not g).decode())
            made = [batch.column("text_key"), pa.array(counts, pa.int64()), pa.array(digests, pa.string())]
            yield pa.RecordBatch.from_arrays(
                [*made, pa.array(texts, pa.string())] if with_text else made, cut_schema.names
            )

    cuts = settle(repeated_windows(df, text_col, window, base).mapInArrow(cut, cut_schema))
    empty = F.sha2(F.lit(""), 256)
    whole = settle(
        copies.select("text_key", F.lit(True).alias("copied"))
        .join(cuts, "text_key", "full")
        .select("text_key", F.coalesce("copied", F.lit(False)).alias("copied"), "removed", "cut_sha256", *[f.name for f in text_field])
    )
    joined = slim.join(whole, "text_key", "left")
    columns = [
        "doc_id",
        "n_words",
        F.when(F.col("copied"), F.col("n_words")).otherwise(F.coalesce("removed", F.lit(0))).alias("n_removed"),
        F.when(F.col("copied"), empty).otherwise(F.coalesce("cut_sha256", "plain_sha256")).alias("kept_sha256"),
    ]
    if with_text:
        texts = docs.select("text_key", F.col("text").alias("whole_text")).dropDuplicates(["text_key"])
        spaced = F.trim(F.regexp_replace("whole_text", r"[\x20\x09-\x0D]+", " "))
        joined = joined.join(texts, "text_key")
        columns.append(F.when(F.col("copied"), "").otherwise(F.coalesce("kept_text", spaced)).alias("kept_text"))
    return joined.select(*columns)
