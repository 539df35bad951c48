import collections
import hashlib
import random

import pytest
from corpus import empty, messy, messy_rows, sentence

from panelweave.llm import substring_dedup


def brute(rows, window):
    cut = [(text or "").encode().split() for _, text in rows]
    seen = collections.Counter(tuple(w[i : i + window]) for w in cut for i in range(len(w) - window + 1))
    out = []
    for (doc_id, _), words in zip(rows, cut):
        gone = set()
        for i in range(len(words) - window + 1):
            if seen[tuple(words[i : i + window])] > 1:
                gone.update(range(i, i + window))
        kept = b" ".join(w for i, w in enumerate(words) if i not in gone)
        out.append((doc_id, len(words), len(gone), hashlib.sha256(kept).hexdigest(), kept.decode()))
    return sorted(out, key=repr)


def run(spark, rows, **options):
    out = substring_dedup.remove_repeats(messy(spark, rows), with_text=True, **options).collect()
    return sorted([(r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"], r["kept_text"]) for r in out], key=repr)


def test_messy_corpus(spark):
    assert run(spark, messy_rows()) == brute(messy_rows(), 35)
    assert substring_dedup.remove_repeats(empty(spark)).count() == 0


@pytest.mark.parametrize("window,base", [(35, 8), (12, 4), (7, 2), (4, 1), (50, 2), (100, 8)])
def test_random_passages(spark, window, base):
    rng = random.Random(window)
    passages = [sentence(1000 + i, rng.randint(window - 2, 2 * window)) for i in range(8)]
    rows = []
    for i in range(40):
        parts = [sentence(i * 10 + k, rng.randint(1, 2 * window)) for k in range(3)]
        parts.insert(rng.randrange(4), rng.choice(passages))
        rows.append((i, "\n".join(parts)))
    rows.append((99, "same " * (2 * window)))
    assert run(spark, rows, window=window, base=base) == brute(rows, window)


def test_base_must_leave_room():
    with pytest.raises(ValueError, match="third"):
        substring_dedup.repeated_windows(None, window=10, base=5)


def test_levels_double_until_none_survives(spark, monkeypatch):
    """A long window takes a level for every doubling; without repeats the first are the last."""
    levels, look_up = [], substring_dedup._look_up
    monkeypatch.setattr(substring_dedup, "_look_up", lambda rows, kind, then: levels.append(kind) or look_up(rows, kind, then))
    unlike, shared = [sentence(i * 700, 150) for i in range(4)], sentence(9_000, 120)
    substring_dedup.remove_repeats(messy(spark, list(enumerate(unlike))), window=100)
    assert len(levels) == 3
    levels.clear()
    rows = [(i, f"{text} {shared}") for i, text in enumerate(unlike)]
    assert all(r["n_removed"] == 120 for r in substring_dedup.remove_repeats(messy(spark, rows), window=100).collect())
    assert len(levels) == 5
