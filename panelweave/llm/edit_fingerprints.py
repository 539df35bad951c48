"""Fingerprints of texts whose likeness follows edit distance.

A text is spelled out by a random walk.  At every step the character under the
cursor is written down, and a random bit, shared by all texts and drawn by step
and character, decides whether the cursor moves on.  Two texts that differ by
an edit soon stand on the same characters at the same steps again, so a small
edit distance becomes a small Hamming distance between what was written.  A
fingerprint keeps a sample of that string: steps drawn once for all texts, and
four bits of a hash of the character written at each.

Texts of up to :math:`2^n` characters have level n.  A level has its own steps,
spread evenly over the length of its walks, and a fingerprint has the samples of
its own level and of the next, so texts whose lengths differ by less than half
always share a level.

:func:`likeness` is the share of sampled steps at which both texts write the
same, corrected for hashes that agree by chance.  :func:`search` finds texts
within a given edit distance: samples are joined in bands, texts that agree in
a band are compared by likeness, and what is alike is verified by exact edit
distance over whole texts.  Every pair is looked at in its first common band
only, in blocks of a bucket, so no bucket has to fit in a task.

Edits scattered over a text can keep two walks apart for long, so likeness is a
lower bound that some pairs miss: of pairs of the driver's documents with 0.5 %
random edits the default bands find 0.95, with 1 % 0.88.

Shared bits repeat after :data:`PERIOD` steps, and characters share them by 64
classes of a hash; what is written down is the character itself.

Defined results: a null text is an empty one.  Characters are code points.  A
text without characters is like another such text (1) and unlike any other (0);
texts whose lengths are more than a level apart are unlike (0).  Equal texts
have equal fingerprints.  In the order of documents a null id follows all ids,
equal ids are ordered by a hash of the text, and the document before the first
is the last; a table of one row is its own neighbour.  Repeated rows have a row
each, all but one of them with their own text as neighbour.  Other columns are
ignored, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

import bisect
import hashlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .resampling import regular_splitters, sort_keys
from .shared import stored, taken
from .words import mix

#: Steps after which the shared bits repeat, and classes of characters.
PERIOD, CLASSES = 1 << 13, 64
#: Level of the shortest texts.
LEAST_LEVEL = 6
#: Samples of a level, and bits of each.
SAMPLES, BITS = 256, 4
#: Cells of the table in which texts walk side by side.
CELLS = 4 << 20
#: Fewer texts than this walk one by one.
SIDE_BY_SIDE = 24
#: Documents of a range of the order.
RANGE_ROWS = 50_000

_RNG = np.random.default_rng(480)
_TURN = np.uint64(int(_RNG.integers(1 << 62, 1 << 63)) | 1)
_SALT = np.tile(mix(_RNG.integers(0, 1 << 63, SAMPLES, dtype=np.uint64)), 2)
_tables: dict[str, np.ndarray] = {}


def _waits() -> np.ndarray:
    """By step and class, for how many steps the cursor stays."""
    if "waits" not in _tables:
        moves = np.random.default_rng(481).integers(0, 2, (PERIOD, CLASSES), dtype=np.uint8)
        moves[0] = 1  # at the latest
        wait = np.empty((PERIOD, CLASSES), dtype=np.uint8)
        after = np.ones(CLASSES, dtype=np.int32)  # at step 0 of the next period
        for step in range(PERIOD - 1, -1, -1):
            after = np.where(moves[step] == 1, 1, after + 1)
            wait[step] = after
        _tables["waits"] = wait.reshape(-1)
    return _tables["waits"]


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), dtype="<u4")


def _classes(points: np.ndarray) -> np.ndarray:
    return ((points.astype(np.uint64) * _TURN) >> np.uint64(58)).astype(np.int32)


def walks(points: Sequence[np.ndarray]) -> list[np.ndarray]:
    """For each text, the step at which each character is first written, and
    last the number of steps."""
    wait, mask = _waits(), PERIOD - 1
    out: list[np.ndarray] = [np.zeros(1, dtype=np.int32)] * len(points)
    order = sorted((i for i in range(len(points)) if len(points[i])), key=lambda i: -len(points[i]))
    at = 0
    while at < len(order):
        longest = len(points[order[at]])
        group = order[at : at + max(1, CELLS // longest)]
        at += len(group)
        if len(group) < SIDE_BY_SIDE:
            if "bytes" not in _tables:
                _tables["bytes"] = wait.tobytes()
            flat = _tables["bytes"]
            for i in group:
                step, steps = 0, [0]
                for c in _classes(points[i]).tolist():
                    step += flat[((step & mask) << 6) | c]
                    steps.append(step)
                out[i] = np.array(steps, dtype=np.int32)
            continue
        lengths = np.array([len(points[i]) for i in group])
        classes = np.zeros((len(group), longest), dtype=np.uint8)
        for k, i in enumerate(group):
            classes[k, : lengths[k]] = _classes(points[i])
        classes = np.ascontiguousarray(classes.T)
        steps = np.zeros((longest + 1, len(group)), dtype=np.int32)
        # How many texts, longest first, have a character at each place.
        active = len(group) - np.searchsorted(lengths[::-1], np.arange(longest), side="right")
        for t, n in enumerate(active.tolist()):
            now = steps[t, :n]
            cell = now & mask
            cell <<= 6
            cell |= classes[t, :n]
            np.add(now, wait.take(cell), out=steps[t + 1, :n])
        steps = np.ascontiguousarray(steps.T)
        for k, i in enumerate(group):
            out[i] = steps[k, : lengths[k] + 1]
    return out


def level_of(length: int) -> int:
    return max(LEAST_LEVEL, (length - 1).bit_length() if length else 0)


def sampled_steps(level: int) -> np.ndarray:
    """The steps of a level: one in each of equal parts of its walks."""
    name = f"steps{level}"
    if name not in _tables:
        width = 2.5 * 2.0**level / SAMPLES
        _tables[name] = ((np.arange(SAMPLES) + np.random.default_rng([482, level]).random(SAMPLES)) * width).astype(np.int64)
    return _tables[name]


def sampled_pair(level: int) -> np.ndarray:
    """The steps of a level and of the next."""
    name = f"pair{level}"
    if name not in _tables:
        _tables[name] = np.concatenate([sampled_steps(level), sampled_steps(level + 1)])
    return _tables[name]


@dataclass(frozen=True)
class Fingerprint:
    level: int
    steps: int  #: of the text's walk
    samples: np.ndarray  #: of this level, then of the next

    def __str__(self) -> str:
        return f"{self.level}:{self.steps}:{np.packbits(np.unpackbits(self.samples[:, None], axis=1)[:, 8 - BITS:]).tobytes().hex()}"

    @staticmethod
    def parse(value: str) -> "Fingerprint":
        level, steps, rest = value.split(":")
        bits = np.unpackbits(np.frombuffer(bytes.fromhex(rest), dtype=np.uint8)).reshape(-1, BITS)
        return Fingerprint(int(level), int(steps), np.packbits(bits, axis=1)[:, 0] >> (8 - BITS))

    def at(self, level: int) -> np.ndarray:
        start = (level - self.level) * SAMPLES
        return self.samples[start : start + SAMPLES]


def fingerprints(texts: Sequence[str]) -> list[Fingerprint]:
    points = [code_points(t) for t in texts]
    out = []
    for text, steps in zip(points, walks(points)):
        level = level_of(len(text))
        asked = sampled_pair(level)
        place = np.searchsorted(steps, asked, side="right") - 1
        inside = place < len(text)
        written = text[place[inside]].astype(np.uint64) + np.uint64(1)
        samples = np.zeros(len(asked), dtype=np.uint8)
        samples[inside] = mix(written * _TURN + _SALT[inside]) & np.uint64((1 << BITS) - 1)
        out.append(Fingerprint(level, int(steps[-1]), samples))
    return out


def likeness(a: Fingerprint, b: Fingerprint) -> float:
    if a.steps == 0 or b.steps == 0:
        return float(a.steps == b.steps)
    level = max(a.level, b.level)
    if level - min(a.level, b.level) > 1:
        return 0.0
    steps = sampled_steps(level)
    either, both = (int(np.searchsorted(steps, f(a.steps, b.steps))) for f in (max, min))
    agree = int(np.count_nonzero(a.at(level)[:both] == b.at(level)[:both]))
    chance = 2.0**-BITS
    return min(1.0, max(0.0, (agree - both * chance) / (1 - chance) / either))


def edit_distance(a: str, b: str, limit: int | None = None) -> int:
    """Insertions, deletions and replacements between two texts; any number
    above ``limit`` stands for a larger distance.

    The columns of the table of distances are held as bits of whole numbers.
    """
    if len(a) > len(b):
        a, b = b, a
    start = 0
    while start < len(a) and a[start] == b[start]:
        start += 1
    end = 0
    while end < len(a) - start and a[-1 - end] == b[-1 - end]:
        end += 1
    a, b = a[start : len(a) - end], b[start : len(b) - end]
    if not a:
        return len(b)
    where: dict[str, int] = {}
    for i, c in enumerate(a):
        where[c] = where.get(c, 0) | 1 << i
    full, top = (1 << len(a)) - 1, 1 << (len(a) - 1)
    up, down, distance = full, 0, len(a)
    for i, c in enumerate(b):
        same = where.get(c, 0)
        kept = same | down
        across = (((same & up) + up) ^ up) | same
        more, less = down | (~(across | up) & full), up & across
        distance += 1 if more & top else -1 if less & top else 0
        if limit is not None and distance - (len(b) - 1 - i) > limit:
            return limit + 1
        more = ((more << 1) | 1) & full
        up, down = ((less << 1) & full) | (~(kept | more) & full), more & kept
    return distance


def _documents(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    docs = taken(df, {"doc_id": F.col(id_col), "text": F.coalesce(F.col(text_col), F.lit(""))})
    return docs.select("doc_id", F.xxhash64("text").alias("text_key"), "text")


def with_neighbours(docs: DataFrame) -> DataFrame:
    """``doc_id, text_key, text, copies, range, guard``, partitioned by range
    and sorted, so that the row before a document is the one of the next lower
    id.  The first row of a range is a copy (``guard``) of the last document of
    the range before.

    Ids are cut into ranges by regular samples, and the ends of the ranges, a
    key a range, tell which documents are sent twice: texts move once.
    """
    spark = docs.sparkSession
    names = ["doc_id", "text_key"]
    keys = docs.select(*names).groupBy(*names).count()
    repeated = stored(keys.where("count > 1").select(*names), "repeated")
    one = docs.withColumn("copies", F.lit(1).cast("long"))
    if not repeated.isEmpty():
        other = repeated.select(F.col("doc_id").alias("i"), F.col("text_key").alias("k"))
        same = F.col("doc_id").eqNullSafe(F.col("i")) & (F.col("text_key") == F.col("k"))
        many = docs.join(other, same, "left_semi").groupBy(*names).agg(F.first("text").alias("text"), F.count("*").alias("copies"))
        one = one.join(other, same, "left_anti").unionByName(many)
    order = [F.col("doc_id").asc_nulls_last(), F.col("text_key").asc()]
    runs = docs.select(F.lit(0).cast("long").alias("score"), *names, F.lit(0).cast("long").alias("row")).sortWithinPartitions(*order)
    total = runs.count()
    count = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // RANGE_ROWS))
    ends = sorted(set(regular_splitters(runs, total, count)))
    held = spark.sparkContext.broadcast(ends)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [bisect.bisect_left(held.value, k) for k in sort_keys(batch)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_key"), pa.array(found, pa.int32())], [*names, "range"])

    ranged = T.StructType([docs.schema["doc_id"], docs.schema["text_key"], T.StructField("range", T.IntegerType())])
    last = F.max(F.struct(F.col("doc_id").isNull().alias("none"), *names)).alias("last")
    found = runs.mapInArrow(place, ranged).groupBy("range").agg(last).orderBy("range").collect()  # a row a range
    filled = [row["range"] for row in found]
    sent = {(row["last"]["doc_id"], row["last"]["text_key"]): after for row, after in zip(found, filled[1:] + filled[:1])}
    guards = spark.sparkContext.broadcast(sent)
    schema = T.StructType([*one.schema.fields, T.StructField("range", T.IntegerType()), T.StructField("guard", T.BooleanType())])

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column("doc_id").to_pylist(), batch.column("text_key").to_pylist()
            own = [bisect.bisect_left(held.value, (0, i is None, i, t, 0)) for i, t in zip(ids, texts)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(own, pa.int32()), pa.array([False] * len(own))], schema.names)
            twice = [k for k, key in enumerate(zip(ids, texts)) if key in guards.value]
            if twice:
                some = batch.take(pa.array(twice))
                to = [guards.value[ids[k], texts[k]] for k in twice]
                yield pa.RecordBatch.from_arrays([*some.columns, pa.array(to, pa.int32()), pa.array([True] * len(to))], schema.names)

    dealt = one.mapInArrow(deal, schema).repartitionById(len(ends) + 1, "range")
    return dealt.sortWithinPartitions(F.col("guard").desc(), *order)


NEIGHBOURS = T.StructType(
    [
        T.StructField("n_chars", T.LongType()),
        T.StructField("edited_sha256", T.StringType()),
        T.StructField("fingerprint", T.StringType()),
        T.StructField("edited_fingerprint", T.StringType()),
        T.StructField("near_edited", T.DoubleType()),
        T.StructField("near_next", T.DoubleType()),
        T.StructField("shared_bands", T.LongType()),
    ]
)


def edited(text: str, other: str) -> str:
    """``text``, its latter half replaced by the start of ``other``."""
    half = len(text) // 2
    return text[: len(text) - half] + other[:half]


def compare_neighbours(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", bands: "Bands | None" = None
) -> DataFrame:
    """``doc_id`` and :data:`NEIGHBOURS`: fingerprints of every text and of the
    text edited with the document of the next lower id, their likeness, and how
    many bands they share."""
    bands = bands or Bands()
    docs = with_neighbours(_documents(df, id_col, text_col))
    schema = T.StructType([docs.schema["doc_id"], *NEIGHBOURS.fields])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before: tuple[str, Fingerprint] | None = None
        for batch in batches:
            columns = zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "copies", "guard")))
            for rows in _slices(columns):
                texts = [r[1] for r in rows]
                others = [before[0] if before else "", *texts[:-1]]
                asked = [*texts]
                places = []
                for (_, text, copies, guard), other in zip(rows, others):
                    makes = [] if guard else [other] if copies == 1 else [other, text]
                    places.append([(len(asked) + k, new) for k, new in enumerate(makes)])
                    asked += [edited(text, new) for new in makes]
                made = fingerprints(asked)
                out = []
                for k, (doc_id, text, copies, guard) in enumerate(rows):
                    prior = made[k - 1] if k else before[1] if before else made[k]
                    for turn, (at, _) in enumerate(places[k]):
                        row = (
                            doc_id, len(text), hashlib.sha256(asked[at].encode()).hexdigest(), str(made[k]), str(made[at]),
                            likeness(made[k], made[at]), likeness(made[k], prior if turn == 0 else made[k]), bands.shared(made[k], made[at]),
                        )
                        out += [row] * (1 if turn == 0 else copies - 1)
                        if len(out) >= 10_000:
                            yield _rows(out, schema, batch)
                            out = []
                before = (texts[-1], made[len(texts) - 1])
                yield _rows(out, schema, batch)

    return docs.mapInArrow(work, schema)


def _rows(rows: list[tuple], schema: T.StructType, batch: pa.RecordBatch) -> pa.RecordBatch:
    kinds = [batch.schema.field("doc_id").type, pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.int64()]
    columns = list(zip(*rows)) or [[]] * len(kinds)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], schema.names)


def _slices(rows: Iterator[tuple], limit: int = 4 << 20) -> Iterator[list[tuple]]:
    """Rows whose texts have about ``limit`` characters together."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += len(row[1])
        if size >= limit:
            yield held
            held, size = [], 0
    if held:
        yield held


@dataclass(frozen=True)
class Bands:
    """Groups of samples that are looked up together."""

    count: int = 128
    size: int = 6  #: samples of a band

    def keys(self, found: Fingerprint, level: int) -> np.ndarray:
        """Hashes of the bands of a level; 0 for one that the walk does not
        reach, which holds nothing of the text."""
        name = f"bands{self.count}.{self.size}.{level}"
        if name not in _tables:
            # Only steps that every walk of the level has; the shortest has about 2**level.
            able = max(self.size, int(np.searchsorted(sampled_steps(level), 2**level)))
            rng = np.random.default_rng([483, level])
            _tables[name] = np.array([rng.choice(able, self.size, replace=False) for _ in range(self.count)])
        chosen = _tables[name]
        samples = found.at(level)[chosen].astype(np.uint64)
        packed = (samples << (np.arange(self.size, dtype=np.uint64) * np.uint64(BITS))).sum(axis=1, dtype=np.uint64)
        key = mix(mix(packed) + np.arange(self.count, dtype=np.uint64) + np.uint64(level << 32))
        whole = sampled_steps(level)[chosen].max(axis=1) < max(found.steps, 1)
        if level_of(1) == level:  # texts shorter than a level have no other bands
            whole = np.ones(self.count, dtype=bool)
        return np.where(whole, key | np.uint64(1), np.uint64(0))

    def shared(self, a: Fingerprint, b: Fingerprint) -> int:
        level = max(a.level, b.level)
        if level - min(a.level, b.level) > 1:
            return 0
        mine, other = self.keys(a, level), self.keys(b, level)
        return int(np.count_nonzero((mine == other) & (mine != 0)))


MEMBER = T.StructType(
    [
        T.StructField("text_digest", T.BinaryType()),
        T.StructField("fingerprint", T.StringType()),
        T.StructField("asked", T.BooleanType()),
        T.StructField("band", T.IntegerType()),
        T.StructField("key", T.LongType()),
    ]
)


@dataclass(frozen=True)
class SearchOptions:
    most_percent: int = 1  #: edits, in hundredths of the longer text's characters
    least_likeness: float = 0.1  #: of fingerprints, for a pair to be verified
    bands: Bands = Bands()
    block: int = 1000  #: members of a bucket that are held at once


def _levels(found: Fingerprint, options: SearchOptions, n_chars: int) -> list[int]:
    """The levels at which a text can meet one within the asked distance."""
    longest = n_chars * 100 // (100 - options.most_percent) + 1
    return [found.level, found.level + 1] if level_of(longest) > found.level else [found.level]


def band_members(texts: DataFrame, options: SearchOptions) -> DataFrame:
    """:data:`MEMBER` rows of distinct texts ``text_digest, text, asked``."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in _slices(zip(*(batch.column(c).to_pylist() for c in ("text_digest", "text", "asked")))):
                out: list[tuple] = []
                for (digest, text, asked), found in zip(rows, fingerprints([r[1] for r in rows])):
                    name = str(found)
                    for level in _levels(found, options, len(text)):
                        keys = options.bands.keys(found, level).astype(np.int64).tolist()
                        out += [(digest, name, asked, band, key) for band, key in enumerate(keys) if key]
                columns = list(zip(*out)) or [[]] * len(MEMBER)
                kinds = (pa.binary(), pa.string(), pa.bool_(), pa.int32(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], MEMBER.names)

    return texts.mapInArrow(work, MEMBER)


def candidates(members: DataFrame, options: SearchOptions) -> DataFrame:
    """Pairs ``asked``, ``found`` of digests whose fingerprints are alike.

    A bucket's members are dealt to blocks by their digest; asked texts go to
    every block of their bucket.
    """
    counted = members.groupBy("key").agg(F.count("*").alias("n"), F.count_if("asked").alias("a")).where("n > 1 and a > 0")
    blocks = F.ceil(F.col("n") / options.block).cast("int")
    own = F.pmod(F.xxhash64("text_digest", "key"), blocks).cast("int")
    turn = F.struct(F.lit(0).alias("role"), own.alias("at"))
    asks = F.transform(F.sequence(F.lit(0), blocks - 1), lambda i: F.struct(F.lit(1).alias("role"), i.alias("at")))
    turns = F.when(F.col("asked"), F.concat(F.array(turn), asks)).otherwise(F.array(turn))
    placed = members.join(counted, "key").select("key", "band", "text_digest", "fingerprint", F.explode(turns).alias("t"))
    placed = placed.select("key", F.col("t.at").alias("at"), F.col("t.role").alias("role"), "band", "text_digest", "fingerprint")
    parts = int(members.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sorted_rows = placed.repartition(parts, "key", "at").sortWithinPartitions("key", "at", "role", "text_digest")
    schema = T.StructType([T.StructField("asked", T.BinaryType()), T.StructField("found", T.BinaryType())])
    bands, names = options.bands, placed.columns

    def first_common(a: Fingerprint, b: Fingerprint, band: int, key: int) -> bool:
        """Whether the pair meets in no band before this one."""
        for level in range(max(a.level, b.level), min(a.level, b.level) + 2):
            mine, other = bands.keys(a, level), bands.keys(b, level)
            met = np.flatnonzero((mine == other) & (mine != 0))
            if len(met):
                return int(met[0]) == band and int(mine[met[0]].astype(np.int64)) == key
        return False

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, held = None, []
        for batch in batches:
            out: list[tuple] = []
            for key, at, role, band, digest, name in zip(*(batch.column(c).to_pylist() for c in names)):
                if (key, at) != current:
                    current, held = (key, at), []
                made = Fingerprint.parse(name)
                if role == 0:
                    held.append((digest, made))
                    continue
                for other, theirs in held:
                    if other != digest and likeness(made, theirs) >= options.least_likeness and first_common(made, theirs, band, key):
                        out.append((digest, other))
            columns = list(zip(*out)) or [[], []]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.binary()) for c in columns], schema.names)

    return sorted_rows.mapInArrow(work, schema)


def search(
    df: DataFrame, asked: Column, options: SearchOptions = SearchOptions(), id_col: str = "doc_id", text_col: str = "text"
) -> tuple[DataFrame, DataFrame]:
    """Texts near those of the rows where ``asked`` holds.

    The first result has a row for each pair of different texts within the asked
    distance: ``asked``, ``found`` (digests) and ``edits``.  The second has
    ``doc_id``, ``text_digest`` and ``asked`` of every row, so a text that many
    rows share is compared once.  Texts without characters are near none.
    """
    docs = taken(
        df, {"doc_id": F.col(id_col), "text": F.coalesce(F.col(text_col), F.lit("")), "asked": F.coalesce(asked, F.lit(False))}
    ).withColumn("text_digest", F.unhex(F.md5("text")))
    texts = docs.where("text <> ''").groupBy("text_digest").agg(F.first("text").alias("text"), F.max("asked").alias("asked"))
    texts = stored(texts, "texts")
    pairs = stored(candidates(stored(band_members(texts, options), "bands"), options), "candidates")
    ends = pairs
    for side in ("asked", "found"):
        ends = ends.join(texts.select(F.col("text_digest").alias(side), F.col("text").alias(f"{side}_text")), side)
    schema = T.StructType([*pairs.schema.fields, T.StructField("edits", T.LongType())])
    percent = options.most_percent

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for asked, found, a, b in zip(*(batch.column(c).to_pylist() for c in ("asked", "found", "asked_text", "found_text"))):
                limit = percent * max(len(a), len(b)) // 100
                if abs(len(a) - len(b)) <= limit and (edits := edit_distance(a, b, limit)) <= limit:
                    out.append((asked, found, edits))
            columns = list(zip(*out)) or [[]] * 3
            kinds = (pa.binary(), pa.binary(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], schema.names)

    return ends.mapInArrow(verify, schema), docs.select("doc_id", "text_digest", "asked")
