"""Token ids in patched frame-of-reference blocks.

A segment is one binary value: a header, a table of its documents, an index of
its blocks and the blocks.  A block holds up to 512 ids: the block's least id
is subtracted, the rest is packed at the width that a chosen share of the ids
fits into, and the high parts of all others stand in an exception list with
their places, unless the full width takes less room.  The index has the byte offset of each block, so any range of
ids is read without unpacking what lies before it.

Segments are written by Spark's own committed writer, one row each, so they go
to any store that Spark writes to and a task that is run twice leaves one copy.
Documents stand in ascending order of id: a range partition holds neighbouring
ids, is sorted, and is cut into segments of bounded size.

Defined results: a null or empty text has only the end id.  Rows without an id
come first.  Rows that share an id stand in the order of a hash of their text,
and this hash also lets a range cut fall between them, so no id is too frequent
for one task; repeated rows are stored as often as they occur.  Other columns
are ignored, whatever their names.  An empty table gives no segments.
"""

from __future__ import annotations

import os
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bpe import PieceCache
from .pretokens import PATTERN, PretokenCache
from .shared import taken

BLOCK = 512
#: Share of a block's ids that fit the packed width.
PACKED_SHARE = 0.9
#: Ids of a segment, unless one document has more.
SEGMENT_IDS = 2_000_000
MAGIC = b"PFOR1\0\0\0"
_HEAD = struct.Struct("<IBBH")  # least id, width, width of high parts, exceptions


def _pack(values: np.ndarray, width: int) -> np.ndarray:
    """Rows of ``values`` as rows of bytes, ``width`` bits each, least first."""
    if width in (8, 16, 32):
        return np.ascontiguousarray(values.astype(f"<u{width // 8}")).view(np.uint8)
    rows, count = values.shape
    if width > 16:
        held = np.ascontiguousarray(values.astype("<u4")).view(np.uint8).reshape(rows, count, 4)
        bits = np.unpackbits(held, axis=-1, bitorder="little")[..., :width]
        return np.packbits(bits.reshape(rows, -1), axis=1, bitorder="little")
    # Eight values are ``width`` bytes: two words of four values each.
    eights = np.zeros((rows, -(-count // 8) * 8), dtype=np.uint64)
    eights[:, :count] = values
    eights = eights.reshape(-1, 2, 4)
    fours = eights[..., 0].copy()
    for i in range(1, 4):
        fours |= eights[..., i] << np.uint64(i * width)
    words = np.empty((len(fours), 2), dtype="<u8")
    words[:, 0] = fours[:, 0] | fours[:, 1] << np.uint64(4 * width)
    words[:, 1] = fours[:, 1] >> np.uint64(64 - 4 * width)
    return words.view(np.uint8)[:, :width].reshape(rows, -1)[:, : -(-count * width // 8)]


def _unpack(data: np.ndarray, count: int, width: int) -> np.ndarray:
    """The inverse of :func:`_pack` for rows of ``count`` values."""
    if width in (8, 16, 32):
        return np.ascontiguousarray(data).view(f"<u{width // 8}").astype(np.uint32)
    rows = len(data)
    if width > 16:
        bits = np.unpackbits(data, axis=1, count=count * width, bitorder="little").reshape(rows, count, width)
        full = np.zeros((rows, count, 32), dtype=np.uint8)
        full[..., :width] = bits
        packed = np.packbits(full, axis=-1, bitorder="little")
        return packed.reshape(rows, -1).view("<u4").astype(np.uint32)
    eights = -(-count // 8)
    padded = np.zeros((rows, eights * width), dtype=np.uint8)
    padded[:, : data.shape[1]] = data
    full = np.zeros((rows * eights, 16), dtype=np.uint8)
    full[:, :width] = padded.reshape(-1, width)
    words = full.view("<u8")
    low, high = words[:, 0], words[:, 0] >> np.uint64(4 * width) | words[:, 1] << np.uint64(64 - 4 * width)
    out = np.empty((rows * eights, 8), dtype=np.uint32)
    mask = np.uint64((1 << width) - 1)
    for i in range(4):
        out[:, i] = low >> np.uint64(i * width) & mask
        out[:, 4 + i] = high >> np.uint64(i * width) & mask
    return out.reshape(rows, -1)[:, :count]


def _widths(values: np.ndarray) -> np.ndarray:
    """Bits that each value needs."""
    return np.frexp(values.astype(np.float64))[1].astype(np.int64)


def encode_blocks(ids: np.ndarray, share: float = PACKED_SHARE) -> list[bytes]:
    """All blocks of ``ids``; whole blocks of one width are packed together."""
    whole = len(ids) // BLOCK * BLOCK
    return [
        *_encode_rows(ids[:whole].reshape(-1, BLOCK), share),
        *(_encode_rows(ids[whole:].reshape(1, -1), share) if whole < len(ids) else []),
    ]


def _encode_rows(rows: np.ndarray, share: float) -> list[bytes]:
    if not len(rows):
        return []
    least = rows.min(axis=1)
    rest = rows - least[:, None]
    place = max(0, int(np.ceil(share * rows.shape[1])) - 1)
    widths = _widths(np.partition(rest, place, axis=1)[:, place])
    # Exceptions only where they take less room than the full width.
    full = _widths(rest.max(axis=1))
    over = np.count_nonzero(rest >> widths.astype(np.uint32)[:, None], axis=1)
    saved = rows.shape[1] * (full - widths) - over * (16 + full - widths)
    widths = np.where(saved > 0, widths, full)
    blocks: list[bytes] = [b""] * len(rows)
    for width in np.unique(widths).tolist():
        chosen = np.flatnonzero(widths == width)
        low = rest[chosen]
        counts = np.where(widths[chosen] < full[chosen], over[chosen], 0)
        high_widths, tails = [0] * len(chosen), [b""] * len(chosen)
        if counts.any():  # then the width is below 32
            high, low = low >> np.uint32(width), low & np.uint32((1 << width) - 1)
            high_widths, tails = _encode_outside(high)
        packed = _pack(low, width) if width else np.empty((len(chosen), 0), dtype=np.uint8)
        for i, number in enumerate(chosen.tolist()):
            head = _HEAD.pack(int(least[number]), width, high_widths[i], int(counts[i]))
            blocks[number] = head + packed[i].tobytes() + tails[i]
    return blocks


def _encode_outside(high: np.ndarray) -> tuple[list[int], list[bytes]]:
    """For each row of high parts their width, and the places of those above
    zero with the parts; rows of one width are packed together."""
    rows, places = np.nonzero(high)
    above, places = high[rows, places], places.astype("<u2")
    counts = np.bincount(rows, minlength=len(high))
    firsts = np.cumsum(counts) - counts
    nth = np.arange(len(rows)) - firsts[rows]
    widths = _widths(high.max(axis=1))
    tails = [b""] * len(high)
    for width in np.unique(widths[counts > 0]).tolist():
        members = np.flatnonzero(widths == width)
        slot = np.cumsum(widths == width) - 1
        own = widths[rows] == width
        grid = np.zeros((len(members), int(counts[members].max())), dtype=np.uint32)
        grid[slot[rows[own]], nth[own]] = above[own]
        packed = _pack(grid, width)
        for row, member in zip(packed, members.tolist()):
            first, count = int(firsts[member]), int(counts[member])
            tails[member] = places[first : first + count].tobytes() + row[: -(-count * width // 8)].tobytes()
    return widths.tolist(), tails


def _cut(data: bytes, firsts: list[int], size: int) -> np.ndarray:
    """Rows of ``size`` bytes from these places, zeros beyond the end."""
    rows = b"".join([data[first : first + size].ljust(size, b"\0") for first in firsts])
    return np.frombuffer(rows, dtype=np.uint8).reshape(-1, size)


def decode_blocks(data: bytes, offsets: list[int], counts: list[int]) -> np.ndarray:
    """Ids of the blocks at ``offsets``, which hold ``counts`` ids."""
    heads = [_HEAD.unpack_from(data, offset) for offset in offsets]
    out: list[np.ndarray] = [np.empty(0, dtype=np.uint32)] * len(offsets)
    alike: dict[tuple[int, int], list[int]] = {}
    for i, (head, count) in enumerate(zip(heads, counts)):
        alike.setdefault((head[1], count), []).append(i)
    for (width, count), members in alike.items():
        size = -(-count * width // 8)
        firsts = [offsets[i] + _HEAD.size for i in members]
        if width:
            rows = _unpack(_cut(data, firsts, size), count, width)
        else:
            rows = np.zeros((len(members), count), dtype=np.uint32)
        outside: dict[int, list[tuple[int, int, int]]] = {}
        for row, (i, first) in enumerate(zip(members, firsts)):
            _, _, high_width, exceptions = heads[i]
            if exceptions:
                outside.setdefault(high_width, []).append((row, first + size, exceptions))
        for high_width, found in outside.items():
            own, exceptions = np.array([x[0] for x in found]), np.array([x[2] for x in found])
            most = int(exceptions.max())
            places = np.frombuffer(b"".join([data[at : at + 2 * n] for _, at, n in found]), dtype="<u2")
            parts = _unpack(_cut(data, [at + 2 * n for _, at, n in found], -(-most * high_width // 8)), most, high_width)
            above = parts[np.arange(most) < exceptions[:, None]]
            rows[np.repeat(own, exceptions), places] |= above << np.uint32(width)
        rows += np.array([heads[i][0] for i in members], dtype=np.uint32)[:, None]
        for row, i in zip(rows, members):
            out[i] = row
    return np.concatenate(out) if out else np.empty(0, dtype=np.uint32)


def encode_segment(ids: np.ndarray, lengths: np.ndarray) -> bytes:
    """All ids of a segment's documents, whose numbers of ids are ``lengths``."""
    blocks = encode_blocks(ids)
    ends = np.cumsum([0, *map(len, blocks)]).astype("<u8")
    head = struct.pack("<8sQQQ", MAGIC, len(ids), len(lengths), len(blocks))
    return b"".join([head, lengths.astype("<u8").tobytes(), ends.tobytes(), *blocks])


class Segment:
    """Random access to the ids of one segment."""

    def __init__(self, data: bytes):
        magic, self.n_ids, n_docs, n_blocks = struct.unpack_from("<8sQQQ", data)
        if magic != MAGIC:
            raise ValueError("not a token segment")
        self.data = data
        at = struct.calcsize("<8sQQQ")
        self.lengths = np.frombuffer(data, "<u8", n_docs, at)
        self.offsets = np.frombuffer(data, "<u8", n_blocks + 1, at + 8 * n_docs)
        self.first = at + 8 * n_docs + 8 * (n_blocks + 1)

    def read(self, start: int, stop: int) -> np.ndarray:
        """Ids ``start`` to ``stop`` of the segment, from the blocks they are in."""
        if stop <= start:
            return np.empty(0, dtype=np.uint32)
        blocks = range(start // BLOCK, (stop - 1) // BLOCK + 1)
        found = decode_blocks(
            self.data,
            [self.first + int(self.offsets[b]) for b in blocks],
            [min(BLOCK, self.n_ids - b * BLOCK) for b in blocks],
        )
        low = blocks[0] * BLOCK
        return found[start - low : stop - low]

    def documents(self) -> Iterator[np.ndarray]:
        """The ids of each document; about a million are held at once."""
        ends = np.cumsum(self.lengths).astype(np.int64).tolist()
        low, first, held = 0, 0, np.empty(0, dtype=np.uint32)
        for i, end in enumerate(ends):
            if end > first + len(held):
                ahead = int(np.searchsorted(ends, low + (1 << 20)))
                first, held = low, self.read(low, max(end, ends[min(ahead, len(ends) - 1)]))
            yield held[low - first : end - first]
            low = end


def _alphabet() -> np.ndarray:
    """The character that stands for each byte in a byte-level vocabulary: its
    own where that is visible, else one of those from 256 on."""
    own = np.array([*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)])
    out = np.zeros(256, dtype="<u4")
    out[own] = own
    out[out == 0] = np.arange(256, 512 - len(own))
    return out


@lru_cache(maxsize=4)
def _pieces(path: str, pattern: str) -> PieceCache:
    from tokenizers import Tokenizer
    from tokenizers.pre_tokenizers import CharDelimiterSplit

    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = True
    # Pre-tokens come ready, in characters for bytes; no byte is a space there.
    tokenizer.pre_tokenizer = CharDelimiterSplit(" ")
    alphabet = _alphabet()
    sizes = np.zeros(tokenizer.get_vocab_size(), dtype=np.int64)
    for token, number in tokenizer.get_vocab(with_added_tokens=False).items():
        sizes[number] = len(token)  # a character for each byte

    def encode(raw: bytes, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        spelled = np.full(len(raw) + len(lengths), ord(" "), dtype="<u4")
        own = np.arange(len(raw)) + np.repeat(np.arange(len(lengths)), lengths)
        spelled[own] = alphabet[np.frombuffer(raw, dtype=np.uint8)]
        (encoding,) = tokenizer.encode_batch_fast([spelled.tobytes().decode("utf-32-le")], add_special_tokens=False)
        ids = np.array(encoding.ids, dtype=np.uint32)
        until = np.searchsorted(np.cumsum(sizes[ids]), np.cumsum(lengths), side="right")
        return ids, np.diff(until, prepend=0)

    if pattern == PATTERN:
        return PretokenCache(encode)
    return PieceCache(regex.compile(pattern).findall, encode, "<u4")


def write_segments(
    df: DataFrame,
    path: str,
    tokenizer: str,
    pattern: str,
    end_id: int,
    id_col: str = "doc_id",
    text_col: str = "text",
    segment_ids: int = SEGMENT_IDS,
) -> None:
    """Encode every text, add ``end_id``, and write segments to ``path``.

    Columns there: ``part`` and ``number`` (order of segments), ``n_ids``,
    ``doc_ids`` and ``segment``.  ``tokenizer`` is a JSON file of the tokenizers
    library, at one path on all machines or shipped by ``addFile``; ``pattern``
    is its pre-tokenizer's.
    """
    docs = taken(df, {"doc_id": F.col(id_col), "text": F.coalesce(F.col(text_col), F.lit(""))})
    order = ["doc_id", F.xxhash64("text")]
    partitions = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = docs.repartitionByRange(partitions, *order).sortWithinPartitions(*order)
    ranged = ranged.select(F.spark_partition_id().alias("part"), "doc_id", "text")
    kind = docs.schema["doc_id"].dataType
    schema = T.StructType(
        [
            T.StructField("part", T.IntegerType()),
            T.StructField("number", T.IntegerType()),
            T.StructField("n_ids", T.LongType()),
            T.StructField("doc_ids", T.ArrayType(kind)),
            T.StructField("segment", T.BinaryType()),
        ]
    )

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        file = tokenizer if os.path.exists(tokenizer) else SparkFiles.get(os.path.basename(tokenizer))
        cache = _pieces(file, pattern)
        part, number, held, lengths, names, total = 0, 0, [], [], [], 0

        def flush() -> pa.RecordBatch:
            ids = np.concatenate(held)
            data = encode_segment(ids, np.array(lengths, dtype=np.int64))
            columns = [
                pa.array([part], pa.int32()),
                pa.array([number], pa.int32()),
                pa.array([len(ids)], pa.int64()),
                pa.array([names], pa.list_(id_type)),
                pa.array([data], pa.binary()),
            ]
            return pa.RecordBatch.from_arrays(columns, schema.names)

        for batch in batches:
            id_type = batch.column("doc_id").type
            keys = batch.column("doc_id").to_pylist()
            if keys:
                part = batch.column("part")[0].as_py()
            for at, ids in enumerate(cache.encode_texts(batch.column("text").to_pylist())):
                ids = np.append(ids, np.uint32(end_id))
                if held and total + len(ids) > segment_ids:
                    yield flush()
                    number, held, lengths, names, total = number + 1, [], [], [], 0
                held.append(ids)
                lengths.append(len(ids))
                names.append(keys[at])
                total += len(ids)
        if held:
            yield flush()

    ranged.mapInArrow(encode, schema).write.parquet(path)


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """One row per stored document: ``doc_id``, ``start`` (ids of all documents
    before it), ``n_tokens`` and ``ids_crc32``, from the segments alone."""
    stored = spark.read.parquet(path)
    starts = stored.select("part", "number", "n_ids").withColumn(
        "start", F.sum("n_ids").over(Window.orderBy("part", "number")) - F.col("n_ids")
    )
    starts = starts.select("part", "number", "start")
    kind = stored.schema["doc_ids"].dataType.elementType
    schema = T.StructType(
        [
            T.StructField("doc_id", kind),
            T.StructField("part", T.IntegerType()),
            T.StructField("number", T.IntegerType()),
            T.StructField("within", T.LongType()),
            T.StructField("n_tokens", T.LongType()),
            T.StructField("ids_crc32", T.LongType()),
        ]
    )

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                segment = Segment(batch.column("segment")[i].as_py())
                n = len(segment.lengths)
                within = np.cumsum(segment.lengths).astype(np.int64) - segment.lengths.astype(np.int64)
                sums = [zlib.crc32(ids.astype("<u4").tobytes()) for ids in segment.documents()]
                columns = [
                    batch.column("doc_ids")[i].values,
                    pa.array(np.full(n, batch.column("part")[i].as_py(), dtype=np.int32)),
                    pa.array(np.full(n, batch.column("number")[i].as_py(), dtype=np.int32)),
                    pa.array(within),
                    pa.array(segment.lengths.astype(np.int64)),
                    pa.array(sums, pa.int64()),
                ]
                yield pa.RecordBatch.from_arrays(columns, schema.names)

    read = stored.select("part", "number", "doc_ids", "segment").mapInArrow(decode, schema)
    return read.join(starts, ["part", "number"]).select(
        "doc_id", (F.col("start") + F.col("within")).alias("start"), "n_tokens", "ids_crc32"
    )
