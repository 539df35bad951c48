"""Byte-level BPE by a hierarchical-bitmap rank queue.

All adjacent token pairs that a merge exists for wait in buckets, one for each
merge rank; a bucket holds positions in a linked list of tokens.  A bitmap of
two levels tells the lowest rank that has entries by two find-first-set
operations.  A popped position is skipped if its pair has changed since (a
stale entry).  One queue works on many pre-tokens at once, as pairs never cross
their borders, and a pre-token of any length costs n log n.

Texts are cut at single spaces between other characters, where no pre-token
can cross, and the tokens of each piece are remembered in a bounded cache per
worker process.

Defined results: a null or empty text has no tokens and decodes to nothing.
Rows with null or repeated ids are rows like any other.  Bytes that are not
UTF-8 cannot occur in a text column.  Other columns are ignored by
:func:`encode_documents`, whatever their names; an empty table gives an empty
result.
"""

from __future__ import annotations

import base64
import hashlib
import os
import re
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import taken, text_slices
from .words import bytes_hashes

LEAF = 256
#: Bytes of pieces that a worker process remembers in one of two generations,
#: a quarter of it for pre-tokens, and what a pre-token takes besides its ids.
CACHE_BYTES, ENTRY_BYTES = 24 << 20, 260
#: Ids that are handed on at once.
OUT_IDS = 1 << 20
#: Longer ones are not remembered.
LONG_PIECE = 64
#: Texts are cut into parts of this many characters, and worked on by as many.
PART_CHARS = 1 << 19
_CUT = re.compile(r"(?<=\S) (?=\S)")
_BLANK = np.zeros(256, dtype=bool)
_BLANK[[0x20, *range(0x09, 0x0E)]] = True
_LETTER = np.zeros(256, dtype=bool)
_LETTER[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = True
#: Characters that some definition of white space has beyond these, and the
#: bytes that they can start with.
_ODD = re.compile("[\x1c-\x1f\x85\xa0\u1680\u180e\u2000-\u200f\u2028-\u202f\u205f-\u2064\u3000\ufeff]")
_ODD_LEAD = np.zeros(256, dtype=bool)
_ODD_LEAD[[0x1C, 0x1D, 0x1E, 0x1F, 0xC2, 0xE1, 0xE2, 0xE3, 0xEF]] = True


class RankQueue:
    """Buckets of positions by rank under a two-level bitmap."""

    def __init__(self, ranks: int):
        self.top = 0
        self.leaves = [0] * (ranks // LEAF + 1)
        self.buckets: dict[int, list[int]] = {}

    def open(self, rank: int, positions: list[int]) -> None:
        """Start the bucket of a rank that has none."""
        self.buckets[rank] = positions
        leaf = rank // LEAF
        self.leaves[leaf] |= 1 << rank % LEAF
        self.top |= 1 << leaf

    def take(self) -> tuple[int, list[int]]:
        """Remove the bucket of the lowest rank, its positions in order."""
        leaf = (self.top & -self.top).bit_length() - 1
        word = self.leaves[leaf]
        rank = leaf * LEAF + (word & -word).bit_length() - 1
        word &= word - 1
        self.leaves[leaf] = word
        if not word:
            self.top &= self.top - 1
        positions = self.buckets.pop(rank)
        positions.sort()
        return rank, positions


class BytePairEncoder:
    """Encode pre-tokens by the ranks of a byte-level vocabulary."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = ranks
        self.names = {rank: token for token, rank in ranks.items()}
        self.pattern = regex.compile(pattern)
        self.queue = RankQueue(max(ranks.values()) + 1)
        self.single = np.array([ranks.get(bytes([i]), -1) for i in range(256)])
        # The rank of the merge of two tokens: by the left one, then by the right.
        none: dict[int, int] = {}
        self.merges = [none] * (max(ranks.values()) + 1)
        self.first = np.full((256, 256), -1)
        for token, rank in ranks.items():
            for i in range(1, len(token)):
                left, right = ranks.get(token[:i]), ranks.get(token[i:])
                if left is not None and right is not None:
                    if self.merges[left] is none:
                        self.merges[left] = {}
                    self.merges[left][right] = rank
            if len(token) == 2:
                self.first[token[0], token[1]] = rank

    @classmethod
    def from_file(cls, path: str, pattern: str) -> BytePairEncoder:
        with open(path, "rb") as lines:
            return cls({base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}, pattern)

    def pretokens(self, piece: str) -> list[str]:
        return self.pattern.findall(piece)

    def encode_pretokens(self, pretokens: list[str]) -> list[np.ndarray]:
        """Ranks of each pre-token."""
        raws = [pretoken.encode() for pretoken in pretokens]
        ids, counts = self.encode_joined(b"".join(raws), np.array([len(raw) for raw in raws], dtype=np.int64))
        return np.split(ids, np.cumsum(counts)[:-1])

    def encode_joined(self, raw: bytes, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ranks of pre-tokens that stand one after another, and how many each
        has.  A pre-token that is a token is that token; merges go by the lowest
        rank and, where equal, from the left."""
        bounds, get = np.cumsum(lengths).tolist(), self.ranks.get
        whole = np.array([get(raw[a:b], -1) for a, b in zip([0, *bounds], bounds)], dtype=np.int64)
        rest = whole < 0
        if not rest.any():
            return whole, np.ones(len(whole), dtype=np.int64)
        own = lengths[rest]
        tokens = np.array(self._merge(np.frombuffer(raw, dtype=np.uint8)[np.repeat(rest, lengths)], own))
        alive = tokens >= 0
        counts = np.ones(len(whole), dtype=np.int64)
        counts[rest] = np.diff(np.cumsum(alive)[np.cumsum(own) - 1], prepend=0)
        merged = np.repeat(rest, counts)
        ids = np.empty(len(merged), dtype=np.int64)
        ids[merged], ids[~merged] = tokens[alive], whole[~rest]
        return ids, counts

    def _merge(self, data: np.ndarray, lengths: np.ndarray) -> list[int]:
        """Token at each byte where one starts after all merges, else -1."""
        tokens = self.single[data].tolist()
        size = len(data)
        after, before = list(range(1, size + 1)), list(range(-1, size - 1))
        ends = np.cumsum(lengths)
        pair = np.full(size, -1)
        pair[:-1] = self.first[data[:-1], data[1:]]
        pair[ends - 1] = -1
        for end in ends.tolist():
            after[end - 1] = -1
            if end < size:
                before[end] = -1
        queue, current, merges = self.queue, pair.tolist(), self.merges
        buckets = queue.buckets
        order = np.argsort(pair, kind="stable")
        order = order[np.searchsorted(pair[order], 0) :]
        cuts = np.flatnonzero(np.diff(pair[order])) + 1
        for positions in np.split(order, cuts):
            if len(positions):
                queue.open(int(pair[positions[0]]), positions.tolist())
        while queue.top:
            rank, positions = queue.take()
            lower = False
            for place, at in enumerate(positions):
                if current[at] != rank:
                    continue  # stale
                following = after[at]
                beyond = after[following]
                tokens[at], tokens[following], current[following] = rank, -1, -1
                after[at] = beyond
                new = -1
                if beyond >= 0:
                    before[beyond] = at
                    new = merges[rank].get(tokens[beyond], -1)
                    if new >= 0:
                        if new in buckets:
                            buckets[new].append(at)
                        else:
                            queue.open(new, [at])
                        lower |= new < rank
                current[at] = new
                previous = before[at]
                if previous >= 0:
                    new = merges[tokens[previous]].get(rank, -1)
                    current[previous] = new
                    if new >= 0:
                        if new in buckets:
                            buckets[new].append(previous)
                        else:
                            queue.open(new, [previous])
                        lower |= new < rank
                if lower:  # a new pair goes first; the rest of the bucket waits
                    left = positions[place + 1 :]
                    if left:
                        if rank in buckets:
                            buckets[rank] += left
                        else:
                            queue.open(rank, left)
                    break
        return tokens

    def decode(self, ids) -> bytes:
        return b"".join(map(self.names.__getitem__, ids))


def safe_parts(text: str, size: int = PART_CHARS) -> list[str]:
    """Parts of about ``size`` characters that no pre-token crosses."""
    if len(text) <= size:
        return [text]
    parts, at = [], 0
    while (cut := _CUT.search(text, at + size)) is not None:
        parts.append(text[at : cut.start()])
        at = cut.start()
    return [*parts, text[at:]]


class Pieces:
    """Ids of pieces by 128 bits of hash: arrays in the order of the first half."""

    def __init__(self, dtype: str):
        self.keys = self.checks = np.empty(0, dtype=np.uint64)
        self.starts = self.counts = np.empty(0, dtype=np.int64)
        self.ids = np.empty(0, dtype=dtype)

    @property
    def size(self) -> int:
        """Bytes held."""
        return 32 * len(self.keys) + self.ids.nbytes

    def find(self, keys: np.ndarray, checks: np.ndarray) -> np.ndarray:
        """The place of each piece, -1 where it is not held."""
        if not len(self.keys):
            return np.full(len(keys), -1)
        at = np.searchsorted(self.keys, keys)
        at[at == len(self.keys)] = 0
        return np.where((self.keys[at] == keys) & (self.checks[at] == checks), at, -1)

    def add(self, keys: np.ndarray, checks: np.ndarray, counts: np.ndarray, ids: np.ndarray) -> None:
        """Remember further pieces, whose keys ascend."""
        at = np.searchsorted(self.keys, keys)
        starts = len(self.ids) + np.cumsum(counts) - counts
        self.keys, self.checks = np.insert(self.keys, at, keys), np.insert(self.checks, at, checks)
        self.starts, self.counts = np.insert(self.starts, at, starts), np.insert(self.counts, at, counts)
        self.ids = np.concatenate([self.ids, ids])


def gathered(values: np.ndarray, starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Runs of ``values``, one after another."""
    until = np.cumsum(counts)
    return values[np.repeat(starts - until + counts, counts) + np.arange(until[-1] if len(until) else 0)]


class PieceCache:
    """Encodes texts piece by piece and remembers pieces up to a bound.

    A piece starts at a single space between two other characters, where no
    pre-token can cross.  Pieces of many texts are cut, told apart by 128 bits
    of hash and looked up by array operations; new ones of a space and letters
    are pre-tokens as they stand, and only the others are looked at as strings.
    ``cut`` maps a piece to its pre-tokens.  ``encode`` maps pre-tokens, joined as
    bytes, and their lengths to all their ids and the number of ids of each.
    Pre-tokens are remembered only where a piece has several of them.  A cache
    has a bound in bytes: a full one becomes the old generation, from which what
    is still in use is taken over.
    """

    def __init__(
        self,
        cut: Callable[[str], list[str]],
        encode: Callable[[bytes, np.ndarray], tuple[np.ndarray, np.ndarray]],
        dtype: str = "<u4",
        limit: int = CACHE_BYTES,
    ):
        self.cut, self.encode, self.dtype, self.limit = cut, encode, dtype, limit
        self.pieces, self.old_pieces = Pieces(dtype), Pieces(dtype)
        self.pretoken_bytes = 0
        self.pretokens: dict[str, bytes] = {}
        self.old_pretokens: dict[str, bytes] = {}

    def encode_texts(self, texts: list[str]) -> Iterator[np.ndarray]:
        """The ids of each text."""
        parts = [safe_parts(text) for text in texts]
        held: list[np.ndarray] = []
        flat = text_slices(chain.from_iterable(parts), PART_CHARS)
        for own in parts:
            while len(held) < len(own):
                held += self._encode_parts(next(flat))
            yield np.concatenate(held[: len(own)]) if len(own) > 1 else held[0]
            del held[: len(own)]

    def _encode_parts(self, parts: list[str]) -> list[np.ndarray]:
        raws = [part.encode() for part in parts]
        buffer = b"\n".join(raws)
        data = np.frombuffer(buffer, dtype=np.uint8)
        sizes = np.array([len(raw) for raw in raws])
        firsts = np.cumsum(sizes + 1) - sizes - 1
        starts, ends = self._pieces_of(data, firsts, parts)
        keys, check = bytes_hashes(data, starts, ends)
        distinct, place, number = np.unique(keys, return_index=True, return_inverse=True)
        if (check[place][number] != check).any():  # two pieces share a hash
            return [self._ids_of([part])[0] for part in parts]
        ids, begin, lengths = self._looked_up(distinct, check[place], data, buffer, starts[place], ends[place])
        own = lengths[number]
        totals = np.concatenate([[0], np.cumsum(own)])
        cuts = totals[np.searchsorted(starts, firsts[1:])]
        return np.split(gathered(ids, begin[number], own), cuts)

    @staticmethod
    def _pieces_of(data: np.ndarray, firsts: np.ndarray, parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Start and end of every piece in a buffer of texts on lines."""
        blank = _BLANK[data]
        cuts = np.zeros(len(data), dtype=bool)
        cuts[1:-1] = (data[1:-1] == 0x20) & ~blank[:-2] & ~blank[2:]
        begins = np.flatnonzero(cuts)
        if _ODD_LEAD[data].any():
            # Blanks beyond ASCII: cut texts that have any at their first only.
            odd = [i for i, part in enumerate(parts) if _ODD.search(part)]
            if odd:
                kept = np.ones(len(parts), dtype=bool)
                kept[odd] = False
                begins = begins[kept[np.searchsorted(firsts, begins, side="right") - 1]]
        starts = np.sort(np.concatenate([begins, firsts]))
        ends = np.append(starts[1:], len(data))
        last = np.searchsorted(starts, firsts[1:]) - 1
        ends[last] = firsts[1:] - 1
        full = ends > starts
        return starts[full], ends[full]

    def _looked_up(self, keys, checks, data, buffer, starts, ends) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids, and where in them those of each piece start and how many they
        are; pieces that the present generation lacks are added to it."""
        if self.pieces.size > self.limit:
            self.pieces, self.old_pieces = Pieces(self.dtype), self.pieces
        held, old = self.pieces, self.old_pieces
        at = held.find(keys, checks)
        begin, lengths = np.zeros(len(keys), dtype=np.int64), np.zeros(len(keys), dtype=np.int64)
        found = at >= 0
        begin[found], lengths[found] = held.starts[at[found]], held.counts[at[found]]
        if found.all():
            return held.ids, begin, lengths
        missing = np.flatnonzero(~found)
        again = old.find(keys[missing], checks[missing])
        known, fresh = missing[again >= 0], missing[again < 0]
        again = again[again >= 0]
        kept = gathered(old.ids, old.starts[again], old.counts[again])
        lengths[known] = old.counts[again]
        made, lengths[fresh] = self._ids_at(data, buffer, starts[fresh], ends[fresh])
        order = np.concatenate([known, fresh])
        ids = np.concatenate([held.ids, kept, made])
        begin[order] = len(held.ids) + np.cumsum(lengths[order]) - lengths[order]
        short = missing[ends[missing] - starts[missing] <= LONG_PIECE]
        held.add(keys[short], checks[short], lengths[short], gathered(ids, begin[short], lengths[short]))
        return ids, begin, lengths

    def _ids_at(self, data, buffer, starts, ends) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the pieces at these places, and how many each has."""
        # A space and letters are one pre-token, as are letters.
        others = np.concatenate([[0], np.cumsum(~_LETTER[data])])
        plain = (ends - starts > 1) & (others[ends] == others[starts + 1])
        plain &= (data[starts] == 0x20) | _LETTER[data[starts]]
        rest = np.flatnonzero(~plain)
        bounds = list(zip(starts[rest].tolist(), ends[rest].tolist()))
        spelled, mixed, strings = [], [], []
        for i, (a, b) in zip(rest.tolist(), bounds):
            piece = buffer[a:b].decode()
            if piece[1:].isalpha() and (piece[0] == " " or piece[0].isalpha()):
                spelled.append(i)
            else:
                mixed.append(i)
                strings.append(piece)
        plain[spelled] = True
        counts = np.zeros(len(starts), dtype=np.int64)
        own = ends[plain] - starts[plain]
        ids, counts[plain] = self.encode(gathered(data, starts[plain], own).tobytes(), own) if len(own) else (self._none, 0)
        listed = self._ids_of(strings)
        counts[mixed] = [len(x) for x in listed]
        of_plain = np.repeat(plain, counts)
        out = np.empty(len(of_plain), dtype=self.dtype)
        out[of_plain] = ids
        out[~of_plain] = np.concatenate(listed) if listed else self._none
        return out, counts

    @property
    def _none(self) -> np.ndarray:
        return np.empty(0, dtype=self.dtype)

    def _ids_of(self, pieces: list[str]) -> list[np.ndarray]:
        if self.pretoken_bytes > self.limit // 4:
            self.pretokens, self.old_pretokens, self.pretoken_bytes = {}, self.pretokens, 0
        cuts = [self.cut(piece) for piece in pieces]
        tokens, old_tokens = self.pretokens, self.old_pretokens
        wanted = set(chain.from_iterable(cuts)).difference(tokens)
        for token in wanted.intersection(old_tokens):
            tokens[token] = old_tokens[token]
            self.pretoken_bytes += ENTRY_BYTES + len(tokens[token])
        fresh = list(wanted.difference(old_tokens))
        long = {}
        if fresh:
            raws = [token.encode() for token in fresh]
            ids, counts = self.encode(b"".join(raws), np.array([len(raw) for raw in raws], dtype=np.int64))
            made = np.asarray(ids, dtype=self.dtype).tobytes()
            stops = (np.cumsum(counts) * np.dtype(self.dtype).itemsize).tolist()
            for token, a, b in zip(fresh, [0, *stops], stops):
                if len(token) <= LONG_PIECE:
                    tokens[token] = made[a:b]
                    self.pretoken_bytes += ENTRY_BYTES + b - a
                else:
                    long[token] = made[a:b]

        def ids_of(token: str) -> bytes:
            return tokens[token] if token in tokens else long[token]

        return [np.frombuffer(b"".join(map(ids_of, cut)), dtype=self.dtype) for cut in cuts]


class Spelling:
    """Byte strings by number, put one after another by array lookups."""

    def __init__(self, strings: list[bytes]):
        self.lengths = np.array([len(s) for s in strings], dtype=np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.data = np.frombuffer(b"".join(strings), dtype=np.uint8)

    def parts(self, numbers: np.ndarray, step: int = 1 << 18) -> Iterator[np.ndarray]:
        for i in range(0, len(numbers), step):
            part = numbers[i : i + step]
            lengths = self.lengths[part]
            ends = np.cumsum(lengths)
            shift = np.repeat(self.starts[part] - ends + lengths, lengths)
            yield self.data[shift + np.arange(len(shift))]


@lru_cache(maxsize=4)
def _encoder(path: str, pattern: str) -> tuple[PieceCache, Spelling, Spelling]:
    """The cache, the ids as decimals behind commas, and the tokens' bytes."""
    encoder = BytePairEncoder.from_file(path, pattern)
    size = max(encoder.names) + 1
    cache = PieceCache(encoder.pretokens, encoder.encode_joined, "<u2" if size <= 1 << 16 else "<u4")
    decimals = Spelling([b",%d" % i for i in range(size)])
    return cache, decimals, Spelling([encoder.names.get(i, b"") for i in range(size)])


def _digests(ids: np.ndarray, decimals: Spelling, tokens: Spelling) -> tuple[str, str]:
    listed, decoded = hashlib.sha256(), hashlib.sha256()
    for i, part in enumerate(decimals.parts(ids)):
        listed.update(part[1:] if i == 0 else part)
    for part in tokens.parts(ids):
        decoded.update(part)
    return listed.hexdigest(), decoded.hexdigest()


def encode_documents(
    df: DataFrame, vocabulary: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True
) -> DataFrame:
    """One row per input row: ``doc_id``, ``n_tokens``, ``ids`` (unless
    ``with_ids`` is false), ``ids_sha256`` and ``decoded_sha256``, the digest of
    the bytes that the ids decode to.

    ``vocabulary`` is a file of base64 tokens and ranks, at one path on all
    machines or shipped by ``SparkContext.addFile``.
    """
    docs = taken(df, {"doc_id": F.col(id_col), "text": F.coalesce(F.col(text_col), F.lit(""))})

    schema = T.StructType(
        [
            docs.schema["doc_id"],
            T.StructField("n_tokens", T.LongType()),
            T.StructField("ids_sha256", T.StringType()),
            T.StructField("decoded_sha256", T.StringType()),
            *([T.StructField("ids", T.ArrayType(T.IntegerType()))] if with_ids else []),
        ]
    )

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:

        path = vocabulary if os.path.exists(vocabulary) else SparkFiles.get(os.path.basename(vocabulary))
        cache, decimals, tokens = _encoder(path, pattern)
        for batch in batches:
            counts, lists, digests, decoded, first, held = [], [], [], [], 0, 0

            def made(last: int) -> pa.RecordBatch:
                columns = [batch.column("doc_id").slice(first, last - first), pa.array(counts, pa.int64()), pa.array(digests), pa.array(decoded)]
                if with_ids:
                    columns.append(pa.array(lists, pa.list_(pa.int32())))
                return pa.RecordBatch.from_arrays(columns, schema.names)

            for row, ids in enumerate(cache.encode_texts(batch.column("text").to_pylist()), 1):
                listed, spelled = _digests(ids, decimals, tokens)
                counts.append(len(ids))
                digests.append(listed)
                decoded.append(spelled)
                if with_ids:
                    lists.append(ids.astype(np.int32))
                held += len(ids)
                if held >= OUT_IDS:
                    yield made(row)
                    counts, lists, digests, decoded, first, held = [], [], [], [], row, 0
            if counts:
                yield made(batch.num_rows)

    return docs.mapInArrow(encode, schema)
