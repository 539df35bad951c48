import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from corpus import empty, messy, messy_rows
from tokenizers import Tokenizer

from panelweave.llm import pretokens, token_store

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def tokenizer():
    held = Tokenizer.from_file(PATH)
    held.encode_special_tokens = True
    return held


def test_files_read_back(spark, tokenizer, tmp_path):
    path = f"{tmp_path}/tokens"
    rows = [*messy_rows(), (20, "a <|endoftext|> b"), (-5, "minus")]
    token_store.write_segments(messy(spark, rows), path, PATH, public_tokenizers.PATTERN, end_id=2, segment_ids=3000)
    found = token_store.read_documents(spark, path).orderBy("start").collect()
    assert [r["doc_id"] for r in found] == sorted((d for d, _ in rows), key=lambda d: (d is not None, d or 0))
    wanted, at = [], 0
    for doc_id, text in rows:
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 2], dtype="<u4")
        wanted.append((doc_id, len(ids), zlib.crc32(ids.tobytes())))
    assert sorted([(r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in found], key=repr) == sorted(wanted, key=repr)
    for r in found:
        assert r["start"] == at
        at += r["n_tokens"]
    assert spark.read.parquet(path).count() > 3


def test_empty_table(spark, tmp_path):
    token_store.write_segments(empty(spark), f"{tmp_path}/none", PATH, public_tokenizers.PATTERN, end_id=2)
    assert token_store.read_documents(spark, f"{tmp_path}/none").count() == 0


def test_random_texts(tokenizer):
    cache = token_store._pieces(PATH, public_tokenizers.PATTERN)
    rng = random.Random(6)
    letters = list(" \n\t\r   aabbccddeetthh's'llABéèß漢字🎉1234.,!?\x85\xa0\x1c-_²ª\ufdd0")
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 60))) for _ in range(1500)]
    for text, ids in zip(texts, cache.encode_texts(texts)):
        assert ids.tolist() == tokenizer.encode(text, add_special_tokens=False).ids, repr(text)


@pytest.mark.parametrize("count,high", [(1, 5), (511, 1), (512, 50_257), (3000, 2**32 - 1), (5120, 700), (0, 1)])
def test_blocks(count, high):
    ids = np.random.default_rng(count).integers(0, high, count, dtype=np.uint64).astype(np.uint32)
    ids[::37] = high - 1
    lengths = np.array([count // 3, 0, count - count // 3])
    segment = token_store.Segment(token_store.encode_segment(ids, lengths))
    assert (segment.read(0, count) == ids).all()
    assert not count or (segment.read(count // 3, count // 2 + 1) == ids[count // 3 : count // 2 + 1]).all()
    parts = list(segment.documents())
    assert [len(p) for p in parts] == lengths.tolist() and (np.concatenate(parts) == ids).all()


def test_outliers_are_exceptions():
    ids = np.random.default_rng(1).integers(100, 116, 512).astype(np.uint32)
    ids[[5, 300]] = 2**31
    (block,) = token_store.encode_blocks(ids)
    least, width, _, exceptions = token_store._HEAD.unpack_from(block)
    assert (least, width, exceptions) == (100, 4, 2) and len(block) < 512 * 4 // 8 + 30
    with pytest.raises(ValueError, match="segment"):
        token_store.Segment(b"x" * 100)


def test_each_pretoken_reaches_the_library_once(tokenizer):
    token_store._pieces.cache_clear()
    cache = token_store._pieces(PATH, public_tokenizers.PATTERN)
    encode, handed = cache.encode, []

    def counted(raw, lengths):
        ends = np.cumsum(lengths).tolist()
        handed.extend(raw[a:b].decode() for a, b in zip([0, *ends], ends))
        return encode(raw, lengths)

    cache.encode = counted
    texts = ["A hound. The hound, a hound! Its hound's hound;\n hound", "", "hound hound. (hound) 12 hound12 hound"]
    found = [ids.tolist() for _ in range(2) for ids in cache.encode_texts(texts)]
    token_store._pieces.cache_clear()
    assert found == 2 * [tokenizer.encode(text, add_special_tokens=False).ids for text in texts]
    assert sorted(handed) == sorted(set(handed))


def test_blocks_with_exceptions_are_packed_together(monkeypatch):
    ids = np.random.default_rng(2).integers(0, 4000, 300 * 512).astype(np.uint32)
    ids[::50] = 50_000
    pack, unpack, calls = token_store._pack, token_store._unpack, []
    monkeypatch.setattr(token_store, "_pack", lambda *a: calls.append(1) or pack(*a))
    monkeypatch.setattr(token_store, "_unpack", lambda *a: calls.append(1) or unpack(*a))
    segment = token_store.Segment(token_store.encode_segment(ids, np.array([len(ids)])))
    assert (segment.read(0, len(ids)) == ids).all()
    assert len(calls) < 20


@pytest.mark.parametrize("width", range(1, 33))
def test_packed_bits(width):
    for count in (1, 7, 8, 9, 512):
        values = np.random.default_rng(width).integers(0, 1 << width, (3, count), dtype=np.uint64).astype(np.uint32)
        packed = token_store._pack(values, width)
        bits = ["".join(f"{v:0{width}b}"[::-1] for v in row).ljust(-(-count * width // 8) * 8, "0") for row in values.tolist()]
        assert [r.tobytes() for r in packed] == [int(b[::-1], 2).to_bytes(len(b) // 8, "little") for b in bits]
        assert (token_store._unpack(packed, count, width) == values).all()


def test_other_patterns(tokenizer):
    texts = ["Words, and 12 more.\n\n It's 'fine'  here", " \ufdd0 <|endoftext|>", ""]
    cache = token_store._pieces(PATH, f"(?:{public_tokenizers.PATTERN})")
    assert not isinstance(cache, pretokens.PretokenCache)
    for text, ids in zip(texts, cache.encode_texts(texts)):
        assert ids.tolist() == tokenizer.encode(text, add_special_tokens=False).ids
