import itertools
import random

import numpy as np
import pytest
from corpus import empty, messy, messy_rows, sentence

from panelweave.llm import near_dedup
from panelweave.llm.components import components


def shingles(text, size):
    words = ["".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in w) for w in (text or "").encode().decode().replace("\t", " ").replace("\n", " ").split(" ")]
    words = [w for w in words if w]
    if not words:
        return frozenset()
    size = min(size, len(words))
    return frozenset(tuple(words[i : i + size]) for i in range(len(words) - size + 1))


def brute(rows, size, percent=80):
    sets = [shingles(text, size) for _, text in rows]
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, j in itertools.combinations(range(len(rows)), 2):
        union = len(sets[i] | sets[j])
        if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * union:
            parent[find(i)] = find(j)
    least = {}
    for i, (doc_id, _) in enumerate(rows):
        if sets[i]:
            root = find(i)
            least[root] = min((x for x in (least.get(root), doc_id) if x is not None), default=None)
    return [
        (d, len(s), least[find(i)] if s else d, d == (least[find(i)] if s else d)) for i, ((d, _), s) in enumerate(zip(rows, sets))
    ]


def run(spark, rows, **options):
    out = near_dedup.near_duplicates(messy(spark, rows), options=near_dedup.Options(**options)).collect()
    return sorted([(r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in out], key=repr)


@pytest.mark.parametrize("size", [2, 5])
def test_messy_corpus(spark, size):
    rows = [r for r in messy_rows() if r[0] != 14]  # blanks beyond ASCII: see below
    assert run(spark, rows, shingle_words=size) == sorted(brute(rows, size), key=repr)


def test_chain_of_edits_and_large_bucket(spark):
    """Every text is near its neighbours only, and all share a long passage;
    small blocks make the buckets span several of them."""
    rng = random.Random(3)
    words = sentence(50, 100).split()
    rows = []
    for i in range(60):
        rows.append((i, " ".join(words)))
        for _ in range(3):
            words[rng.randrange(len(words))] = f"w{rng.randrange(10**6)}"
    rows += [(100 + i, sentence(51, 60) + " " + sentence(200 + i, 30)) for i in range(30)]
    assert run(spark, rows, shingle_words=2, block=7) == sorted(brute(rows, 2), key=repr)


def test_one_of_each_keeps_columns(spark):
    df = messy(spark)
    kept = near_dedup.one_of_each(df)
    assert kept.columns == df.columns
    assert {r["doc_id"] for r in kept.collect()} == {1, 2, 3, 4, 6, 9, 10, 11, 12, 13, 14, 15, None}
    assert near_dedup.one_of_each(empty(spark)).count() == 0


def test_signature_estimates(spark):
    options = near_dedup.Options()
    signer = near_dedup.Signer(options)
    rng = np.random.default_rng(0)
    pool = rng.integers(0, 1 << 63, 1000, dtype=np.uint64)
    a, b = (
        np.frombuffer(signer.packed(signer.minima(s)), "<u8") for s in (np.sort(pool[:900]), np.sort(pool[100:]))
    )
    count = options.bands * options.rows
    agree = 1 - near_dedup.differing(a, b, options.bits) / count
    chance = 2.0**-options.bits
    assert (agree - chance) / (1 - chance) == pytest.approx(0.8, abs=0.12)
    assert near_dedup.differing(a, a, options.bits) == 0
    x, y = rng.integers(0, 1 << 63, (2, 5, 3), dtype=np.uint64)
    fields = [(v[..., None] >> (np.arange(16, dtype=np.uint64) * np.uint64(4))) & np.uint64(15) for v in (x, y)]
    assert (near_dedup.differing(x, y, 4) == (fields[0] != fields[1]).sum(axis=(1, 2))).all()


def test_components_of_chains_stars_and_loops(spark):
    rng = random.Random(8)
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 140)] + [(7, 7), (3, 2)]
    edges += [(rng.randrange(200, 260), rng.randrange(200, 260)) for _ in range(40)]
    found = components(spark.createDataFrame(edges, "a long, b long")).collect()
    parent = {n: n for e in edges for n in e}
    for _ in parent:
        for a, b in edges:
            parent[a] = parent[b] = min(parent[a], parent[b])
    groups = {}
    for r in found:
        groups.setdefault(r["root"], set()).add(r["node"])
    wanted = {}
    for n, root in parent.items():
        wanted.setdefault(root, set()).add(n)
    assert sorted(map(sorted, groups.values())) == sorted(sorted(g) for g in wanted.values() if len(g) > 1)
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_one_of_each_by_id_and_text(spark):
    """Repeated ids with different texts, and rows without an id."""
    near = sentence(61, 80)
    nameless = sentence(62, 80)
    rows = [(1, near), (2, near + " more"), (2, sentence(63, 80)), (2, ""), (None, near + " again"), (None, nameless)]
    rows += [(None, nameless), (None, nameless + " end"), (None, None), (None, ""), (3, nameless[:40]), (3, nameless[:40])]
    kept = near_dedup.one_of_each(messy(spark, rows), options=near_dedup.Options(shingle_words=2))
    found = sorted([(r["doc_id"], r["text"]) for r in kept.collect()], key=repr)
    (left,) = [t for d, t in found if d is None and t]
    assert left in (nameless, nameless + " end")
    assert found == sorted([(1, near), (2, sentence(63, 80)), (2, ""), (None, None), (None, ""), (None, left), (3, nameless[:40])], key=repr)


def test_components_by_rounds_and_in_one_task_agree(spark, monkeypatch):
    rng = random.Random(8)
    edges = [(rng.randint(0, 400), rng.randint(0, 400)) for _ in range(260)]
    frame = spark.createDataFrame(edges, "a long, b long")

    def groups():
        held = {}
        for node, root in components(frame).collect():
            held.setdefault(root, set()).add(node)
        return sorted(map(sorted, held.values()))

    at_once = groups()
    monkeypatch.setattr("panelweave.llm.components.FEW_EDGES", 20)
    assert groups() == at_once and len(at_once) > 3
