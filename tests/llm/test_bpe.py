import base64
import hashlib
import random

import pytest
import public_tokenizers
import tiktoken
from corpus import empty, messy, messy_rows

from panelweave.llm import bpe

PATH, PATTERN = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


@pytest.fixture(scope="module")
def ranks():
    return {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}


@pytest.fixture(scope="module")
def reference(ranks):
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def encoder(ranks):
    return bpe.BytePairEncoder(ranks, PATTERN)


def test_documents(spark, reference):
    rows = bpe.encode_documents(messy(spark), PATH, PATTERN).collect()
    wanted = []
    for doc_id, text in messy_rows():
        ids = reference.encode_ordinary(text or "")
        listed = ",".join(map(str, ids))
        wanted.append(
            (doc_id, len(ids), hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest(), ids)
        )
    found = [(r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"], r["ids"]) for r in rows]
    assert sorted(found, key=repr) == sorted(wanted, key=repr)
    assert bpe.encode_documents(empty(spark), PATH, PATTERN).count() == 0


def test_random_texts(encoder, reference):
    cache = bpe.PieceCache(encoder.pretokens, encoder.encode_joined, limit=10_000)
    rng = random.Random(4)
    letters = list(" \n\t\r   aabbccddeetthh's'lléèß漢字🎉1234.,!?\x85\xa0\x1c -")
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 60))) for _ in range(1500)]
    for text, ids in zip(texts, cache.encode_texts(texts)):
        assert ids.tolist() == reference.encode_ordinary(text), repr(text)
        assert encoder.decode(ids.tolist()) == text.encode()


def test_long_pretokens_and_parts(encoder, reference, monkeypatch):
    for text in ("ab" * 20_000, "aaaaaaaaab" * 3_000, "😀" * 500):
        assert encoder.encode_pretokens([text])[0].tolist() == reference.encode_ordinary(text)
    monkeypatch.setattr(bpe, "PART_CHARS", 100)
    text = " ".join(messy_rows()[9][1].split()[:300]) + "   \n end"
    cache = bpe.PieceCache(encoder.pretokens, encoder.encode_joined)
    parts = bpe.safe_parts(text, 100)
    assert len(parts) > 3 and "".join(parts) == text
    assert next(iter(cache.encode_texts([text]))).tolist() == reference.encode_ordinary(text)


def test_queue_takes_lowest_rank_first():
    queue = bpe.RankQueue(70_000)
    for rank, places in ((69_999, [3]), (5, [9, 2]), (300, [1])):
        queue.open(rank, places)
    assert [queue.take() for _ in range(3)] == [(5, [2, 9]), (300, [1]), (69_999, [3])]
    assert queue.top == 0


def test_lower_rank_made_by_a_merge_goes_first():
    """A vocabulary in which merges do not come in the order of ranks."""
    ranks = {bytes([c]): i for i, c in enumerate(b"abc")} | {b"ab": 20, b"abc": 5, b"ca": 10, b"abcabc": 3, b"aa": 30}
    encoder = bpe.BytePairEncoder(ranks, r"\S+|\s+")
    own = tiktoken.Encoding("small", pat_str=r"\S+|\s+", mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(2)
    texts = ["".join(rng.choice("abc") for _ in range(rng.randint(1, 30))) for _ in range(500)]
    assert [ids.tolist() for ids in encoder.encode_pretokens(texts)] == [own.encode_ordinary(t) for t in texts]
