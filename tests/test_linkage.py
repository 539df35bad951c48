import itertools
import math
import random

import pytest
from pyspark.sql import functions as F

from panelweave.functions import jaro_winkler
from panelweave.functions.geometry import EARTH_RADIUS_M
from panelweave.operators import fuzzy, linkage, spatial


@pytest.fixture(scope="module")
def sides(spark):
    left = spark.createDataFrame([(1, "a"), (2, "b"), (2, "c"), (None, "d"), (9, "e")], "k int, v string")
    right = spark.createDataFrame([(1, "x"), (2, "y"), (2, "z"), (None, "n"), (7, "w")], "k int, v string")
    return left, right


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_exact_left(sides):
    linked, summary = linkage.exact_match(*sides, "k")
    assert linked.columns == ["k", "v", "v_right"]
    assert rows(linked) == sorted(
        [(1, "a", "x"), (2, "b", "y"), (2, "b", "z"), (2, "c", "y"), (2, "c", "z"), (None, "d", None), (9, "e", None)], key=str
    )
    s = summary.first()
    assert (s["n_source"], s["n_matched"], s["n_unmatched"], s["n_rows"]) == (5, 3, 2, 7)
    assert s["match_rate"] == pytest.approx(0.6)


def test_exact_variants(sides):
    left, right = sides
    plain, _ = linkage.exact_match(left, right, ["k"])
    split, _ = linkage.exact_match(left, right, ["k"], skewed_right=True)
    assert rows(plain) == rows(split)
    inner, s = linkage.exact_match(left, right, "k", "inner")
    assert inner.count() == 5 == s.first()["n_rows"]
    outer, s = linkage.exact_match(left, right, "k", "outer")
    assert outer.count() == 9 == s.first()["n_rows"]
    safe, s = linkage.exact_match(left, right, "k", null_safe=True)
    assert (None, "d", "n") in [tuple(r) for r in safe.collect()] and s.first()["n_matched"] == 4
    _, s = linkage.exact_match(left, right, "k", compat_counts=True)
    assert s.first()["n_matched"] == 5
    _, s = linkage.exact_match(left, right, "k", "inner", compat_counts=True)
    assert (s.first()["n_matched"], s.first()["n_unmatched"]) == (5, 0)


def test_merge_validation(sides):
    left, right = sides
    with pytest.raises(Exception, match="not unique"):
        linkage.exact_match(left, right, "k", validate_merge="many_to_one")[0].collect()
    one = right.filter("v <> 'z'")
    assert linkage.exact_match(left, one, "k", validate_merge="many_to_one")[0].count() == 5
    with pytest.raises(ValueError):
        linkage.exact_match(left, right, "k", validate_merge="odd")


def test_pass_through_and_rate(spark, sides):
    linked, summary = linkage.link_sources(sides[0], {"other": spark.range(2).withColumnRenamed("id", "zz")})
    assert {"source_file", "link_status"} < set(linked.columns)
    assert summary.first()["match_type"] == "passthrough" and summary.first()["match_rate"] == 1.0
    df = spark.createDataFrame([(1, "a"), (2, None), (3, "c"), (4, None)], "key int, value string")
    assert tuple(linkage.calculate_match_rate(df, "key", "value").first()) == (2, 2, 4, 0.5)
    assert tuple(linkage.calculate_match_rate(df.limit(0), "key", "value").first()) == (0, 0, 0, 0.0)


def distance(a, b):
    last = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        line = [i]
        for j, y in enumerate(b, 1):
            line.append(min(last[j] + 1, line[-1] + 1, last[j - 1] + (x != y)))
        last = line
    return last[-1]


def similarity(a, b):
    longest = max(len(a), len(b))
    return 1.0 if longest == 0 else 1 - distance(a.lower(), b.lower()) / longest


def words():
    """Short and long strings over a small alphabet: many near pairs."""
    left, right = set(), set()
    for i in range(160):
        n = 1 + (i * 7) % 13
        left.add("".join("abcX"[(i * 5 + k * k + k * i) % 4] for k in range(n)))
        right.add("".join("abcx"[(i * 3 + k * k + (k * i) // 2) % 4] for k in range(1 + (i * 5) % 13)))
    return sorted(left | {"", "Supplier#00012", "suppl1er#00034"}), sorted(right | {"Supplier#00034", "Supplier#00035", ""})


@pytest.mark.parametrize("threshold", [0.5, 0.66, 0.75, 0.8, 0.85, 0.9])
def test_levenshtein_join_finds_what_brute_force_finds(spark, threshold):
    left, right = words()
    expected = {}
    for a in left:
        scored = [(similarity(a, b), b) for b in right]
        best = max(s for s, _ in scored)
        if best >= threshold:
            expected[a] = (min(b for s, b in scored if s == best), best)
    l = spark.createDataFrame([(w,) for w in left] + [(None,)], "l string")
    r = spark.createDataFrame([(w,) for w in right] + [(None,)], "r string")
    got = {x["left_value"]: (x["match_value"], x["match_score"]) for x in fuzzy.best_matches(l, r, "l", "r", threshold).collect()}
    assert got.keys() == expected.keys()
    for key, (name, score) in expected.items():
        assert got[key][0] == name and got[key][1] == pytest.approx(score)


def brute_jaro_winkler(a, b):
    a, b = a.lower(), b.lower()
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    reach = max(max(len(a), len(b)) // 2 - 1, 0)
    used, pairs = set(), []
    for i, ch in enumerate(a):
        for j in range(len(b)):
            if abs(i - j) <= reach and j not in used and b[j] == ch:
                used.add(j)
                pairs.append(i)
                break
    m = len(pairs)
    if not m:
        return 0.0
    half = sum(a[i] != b[j] for i, j in zip(pairs, sorted(used))) / 2
    jaro = (m / len(a) + m / len(b) + (m - half) / m) / 3
    lead = sum(1 for _ in itertools.takewhile(lambda p: p[0] == p[1], zip(a[:4], b[:4])))
    return jaro + lead * 0.1 * (1 - jaro)


@pytest.mark.parametrize("threshold", [0.7, 0.8, 0.9])
def test_jaro_winkler_join(spark, threshold):
    left, right = words()
    l = spark.createDataFrame([(w,) for w in left], "l string")
    r = spark.createDataFrame([(w,) for w in right], "r string")
    got = {x["left_value"]: x["match_score"] for x in fuzzy.best_matches(l, r, "l", "r", threshold, "jaro_winkler").collect()}
    expected = {}
    for a in left:
        best = max(brute_jaro_winkler(a, b) for b in right)
        if best >= threshold:
            expected[a] = best
    assert got.keys() == expected.keys()
    assert all(got[k] == pytest.approx(v) for k, v in expected.items())


@pytest.mark.parametrize("a, b, expected", [("MARTHA", "marhta", 0.961111), ("DIXON", "DICKSONX", 0.813333), ("abc", "xyz", 0.0), ("", "", 1.0)])
def test_jaro_winkler_values(spark, a, b, expected):
    df = spark.createDataFrame([(a, b)], "a string, b string")
    assert df.select(jaro_winkler("a", "b").alias("s")).first()["s"] == pytest.approx(expected, abs=1e-6)


def random_names(count, seed):
    rng = random.Random(seed)
    parts = [c + v for c in "bcdfghklmnprstvwz" for v in "aeiou"]
    return ["".join(rng.choices(parts, k=rng.randint(2, 4))).title() + " " + "".join(rng.choices(parts, k=rng.randint(2, 5))).title() for _ in range(count)]


def test_jaro_winkler_writes_few_pairs(spark):
    """Of 10,000 by 10,000 names, few pairs are left for the exact score."""
    left, right = (spark.createDataFrame([(n,) for n in sorted(set(random_names(10_000, i)))], f"{c} string") for i, c in enumerate("lr"))
    pairs = fuzzy.jaro_winkler_candidates(left, right, [], 0.85).count()
    assert 0 < pairs < 0.05 * left.count() * right.count()


def test_jaro_winkler_on_names(spark):
    """Names with typing errors, and strings of very different lengths."""
    rng, right = random.Random(3), sorted(set(random_names(250, 7)) | {"a", "ab", "x" * 60, "bada " * 12})
    left = [n[:i] + rng.choice("aeioux") + n[i + rng.randint(0, 2) :] for n in right for i in [rng.randrange(len(n))]] + ["q", "", "badab"]
    l, r = (spark.createDataFrame([(w,) for w in words], f"{c} string") for words, c in ((left, "l"), (right, "r")))
    for threshold in (0.8, 0.93):
        got = {x["left_value"]: (x["match_value"], x["match_score"]) for x in fuzzy.best_matches(l, r, "l", "r", threshold, "jaro_winkler").collect()}
        best = {a: max((round(brute_jaro_winkler(a, b), 12), [-ord(c) for c in b], b) for b in right) for a in left}
        assert got.keys() == {a for a, (s, *_) in best.items() if s >= threshold}
        assert all(score == pytest.approx(best[a][0]) and brute_jaro_winkler(a, name) == pytest.approx(score) for a, (name, score) in got.items())


@pytest.mark.parametrize("threshold", [0.9, 0.96, 0.985])
def test_jaro_winkler_of_the_same_characters(spark, threshold):
    """Strings of the same characters: all close pairs are found."""
    orders = ["".join(p) for p in itertools.permutations("12345")]
    right = [head + o for head in ("", "x", "xyzw") for o in orders] + ["aab", "aba", "ab", "ba", "a"]
    left = right[::7] + ["xzyw12345", "yx21345", "baa"]
    l, r = (spark.createDataFrame([(w,) for w in words], f"{c} string") for words, c in ((left, "l"), (right, "r")))
    got = {tuple(x) for x in fuzzy.jaro_winkler_candidates(l, r, [], threshold).collect()}
    assert {(a, b) for a in left for b in right if brute_jaro_winkler(a, b) >= threshold} <= got


def test_jaro_winkler_of_many_orders(spark):
    """All orders of six digits behind one name: few pairs differ at two places."""
    names = ["customer#000" + "".join(p) for p in itertools.permutations("123456")]
    l, r = (spark.createDataFrame([(w,) for w in names], f"{c} string") for c in "lr")
    pairs = {tuple(x) for x in fuzzy.jaro_winkler_candidates(l, r, [], 0.985).collect()}
    assert len(pairs) < 0.1 * len(names) ** 2
    assert {(a, b) for a in names[::40] for b in names if sum(x != y for x, y in zip(a, b)) <= 2} <= pairs


def test_contains_and_equality(spark):
    l = spark.createDataFrame([("Cat",), ("a",), ("zz",), ("",), ("longer phrase",), (None,)], "l string")
    r = spark.createDataFrame([("concatenate",), ("CATALOG",), ("a longer Phrase",), ("b",)], "r string")
    got = {x["left_value"]: x["match_value"] for x in fuzzy.best_matches(l, r, "l", "r", method="contains").collect()}
    assert got == {"Cat": "CATALOG", "a": "CATALOG", "": "CATALOG", "longer phrase": "a longer Phrase"} or got["a"] in ("CATALOG", "a longer Phrase")
    lefts = [x["l"] for x in l.collect() if x["l"] is not None]
    rights = [x["r"] for x in r.collect()]
    for a in lefts:
        inside = [b for b in rights if a.lower() in b.lower()]
        assert got.get(a) == (min(inside) if inside else None)
    assert fuzzy.best_matches(l, l, "l", "l", method="other").count() == 5


def test_fuzzy_match_keeps_rows_and_blocks(spark):
    l = spark.createDataFrame([(1, "N", "alpha"), (2, "S", "alpha"), (3, "N", None), (4, "N", "qqqqq")], "id int, zone string, name string")
    r = spark.createDataFrame([("N", "alphq", 10), ("N", "alphq", 11), ("S", "beta", 12)], "zone string, name string, id int")
    linked, summary = fuzzy.fuzzy_match(l, r, "name", "name", 0.75, block_on=["zone"])
    found = {(x["id"], x["match_value"], x["id_right"]) for x in linked.collect()}
    assert found == {(1, "alphq", 10), (1, "alphq", 11), (2, None, None), (3, None, None), (4, None, None)}
    assert (summary.first()["n_matched"], summary.first()["n_unmatched"]) == (1, 3)


def haversine(a, b):
    (p1, l1), (p2, l2) = [(math.radians(x), math.radians(y)) for x, y in (a, b)]
    h = math.sin((p2 - p1) / 2) ** 2 + math.cos(p1) * math.cos(p2) * math.sin((l2 - l1) / 2) ** 2
    return 2 * EARTH_RADIUS_M * math.asin(min(1.0, math.sqrt(h)))


@pytest.mark.parametrize("radius", [50_000.0, 400_000.0, 3_000_000.0])
def test_nearest_matches_brute_force(spark, radius):
    def point(i, a, b):
        return (i, ((i * a) % 1801) / 10.0 - 90, ((i * b) % 3601) / 10.0 - 180)

    left = [point(i, 611, 1303) for i in range(120)] + [(900, 89.99, 10.0), (901, -89.99, 0.0), (902, 0.0, 179.99)]
    right = [point(i, 727, 977) for i in range(150)] + [(910, 89.98, -170.0), (911, 0.01, -179.98), (912, -89.9, 179.0)]
    schema = "id int, latitude double, longitude double"
    linked, _ = spatial.link_with_spatial(
        spark.createDataFrame(left, schema), spark.createDataFrame(right, schema).withColumnRenamed("id", "rid"), "id", "rid", radius
    )
    got = {r["id"]: (r["match_key"], r["distance_m"]) for r in linked.collect()}
    for i, lat, lon in left:
        best = min((haversine((lat, lon), (a, b)), j) for j, a, b in right)
        if best[0] <= radius:
            assert got[i][1] == pytest.approx(best[0], rel=1e-6, abs=1e-3)
        else:
            assert got[i] == (None, None)


def test_map_group_value(spark):
    df = spark.createDataFrame([(1, 5), (1, 7), (2, 1)], "u int, v int")
    out = linkage.map_group_value(df, "u", F.max("v"), "top")
    assert sorted(map(tuple, out.collect())) == [(1, 5, 7), (1, 7, 7), (2, 1, 1)]


def test_salted_join_equals_plain_join(spark):
    from panelweave.operators.grouping import salted_join

    left = spark.createDataFrame([(k, i) for i in range(30) for k in (0, i % 5)], "k int, a int")
    right = spark.createDataFrame([(0 if i % 3 else i % 7, i) for i in range(200)], "k int, b int")
    plain = sorted(map(tuple, left.join(right, "k").select("k", "a", "b").collect()))
    assert sorted(map(tuple, salted_join(left, right, ["k"], ["b"], share=9).select("k", "a", "b").collect())) == plain
