"""Fuzzy record linkage as a similarity join.

Both sides are reduced to distinct strings.  Equal strings are settled by an
equi-join.  For the rest, candidate pairs come from an equi-join on rare
tokens that provably finds every pair at or above the threshold, candidates
are scored where they are found, and the best partner of each left string is
taken by an aggregate with map-side combine.  There is no cap on candidates;
frequent tokens are dealt to shares so that no task meets all their pairs.

Why no pair is lost: write a string as a set of numbered q-grams (the second
"ab" differs from the first).  If every pair above the threshold shares at
least ``o`` tokens, then after sorting the tokens of each string by one global
order, the first ``size - o + 1`` tokens of the two strings must have one in
common.  The global order is rarest first, so the join avoids frequent tokens
whenever the bound allows it.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.similarity import MAX_PREFIX, PREFIX_BONUS, jaro_winkler, levenshtein_similarity
from .grouping import salted_join
from .linkage import match_summary

# Default and recommended thresholds.
FUZZY_THRESHOLD = 0.8
BLOCKED_THRESHOLD = 0.85
NEAR_COPY = 0.9
METHODS = ("levenshtein", "jaro_winkler", "contains")
_EPS = 1e-9


def fuzzy_match(
    left: DataFrame,
    right: DataFrame,
    left_on: str,
    right_on: str,
    threshold: float = FUZZY_THRESHOLD,
    method: str = "levenshtein",
    block_on: Sequence[str] = (),
    suffix: str = "_right",
    source: str = "secondary",
) -> tuple[DataFrame, DataFrame]:
    """Left rows joined to all right rows that carry the best matching string.

    Adds ``match_value`` and ``match_score``.  NULL strings never match; ties
    go to the smallest right string.  A method name outside :data:`METHODS`
    means equality.  ``block_on`` columns must be equal on both sides.
    """
    block = list(block_on)
    pairs = best_matches(left, right, left_on, right_on, threshold, method, block)
    keyed = pairs.withColumnRenamed("left_value", left_on)
    scored = left.join(keyed, [left_on, *block], "left").select(*left.columns, "match_value", "match_score")
    clash = {c: c + suffix for c in right.columns if c in left.columns and c not in block}
    lookup = right.withColumnsRenamed(clash)
    on = F.col("a.match_value") == F.col(f"b.{clash.get(right_on, right_on)}")
    for name in block:
        on = on & (F.col(f"a.{name}") == F.col(f"b.{name}"))
    kept = [F.col(f"b.{c}") for c in lookup.columns if c not in block]
    linked = scored.alias("a").join(lookup.alias("b"), on, "left").select("a.*", *kept)
    summary = match_summary(scored, right, "match_value", source, f"fuzzy_{method}", f"{left_on},{right_on}")
    return linked, summary


def best_matches(
    left: DataFrame,
    right: DataFrame,
    left_on: str,
    right_on: str,
    threshold: float = FUZZY_THRESHOLD,
    method: str = "levenshtein",
    block_on: Sequence[str] = (),
) -> DataFrame:
    """Table (block..., left_value, match_value, match_score), one row per matched left string."""
    block = list(block_on)
    lefts = _distinct_strings(left, left_on, block, "l")
    rights = _distinct_strings(right, right_on, block, "r")
    if method not in METHODS:
        same = lefts.withColumn("r", F.col("l")).join(rights, [*block, "r"])
        return _named(same.withColumn("score", F.lit(1.0)), block)
    if method == "contains":
        found = _containing(lefts, rights, block)
        return _named(found, block)
    # Strings equal but for case have score 1, which nothing can beat.
    equal = rights.withColumn("lower_l", F.lower("r")).groupBy(*block, "lower_l").agg(F.min("r").alias("r"))
    tagged = lefts.withColumn("lower_l", F.lower("l")).join(equal, [*block, "lower_l"], "left")
    settled = tagged.filter(F.col("r").isNotNull()).select(*block, "l", "r", F.lit(1.0).alias("score"))
    open_left = tagged.filter(F.col("r").isNull()).select(*block, "l")
    if method == "jaro_winkler":
        scored = _jaro_winkler_pairs(open_left, rights, block, threshold)
        return _named(settled.unionByName(_best(scored, block)), block)
    # Near copies are settled first: a high threshold needs few tokens per
    # string, and a left string with such a partner is done.
    for level in [t for t in (NEAR_COPY,) if t > threshold] + [threshold]:
        best = _best(_levenshtein_pairs(open_left, rights, block, level), block)
        settled = settled.unionByName(best)
        open_left = open_left.join(best.select(*block, "l"), [*block, "l"], "left_anti")
    return _named(settled, block)


def _named(df: DataFrame, block: list[str]) -> DataFrame:
    return df.select(
        *block, F.col("l").alias("left_value"), F.col("r").alias("match_value"), F.col("score").alias("match_score")
    )


def _distinct_strings(df: DataFrame, column: str, block: list[str], name: str) -> DataFrame:
    text = F.col(column).cast("string")
    return df.filter(text.isNotNull()).select(*block, text.alias(name)).distinct()


def _best(scored: DataFrame, block: list[str]) -> DataFrame:
    """Highest score per left string, then the smallest right string."""
    top = F.min(F.struct((-F.col("score")).alias("s"), F.col("r").alias("r"))).alias("top")
    return scored.groupBy(*block, "l").agg(top).select(
        *block, "l", F.col("top.r").alias("r"), (-F.col("top.s")).alias("score")
    )


def _grams(text: Column, q: int) -> Column:
    """Numbered q-grams of a string; empty when it is shorter than q."""
    starts = F.when(F.length(text) >= q, F.sequence(F.lit(1), F.length(text) - (q - 1)))
    grams = F.sort_array(F.transform(F.coalesce(starts, F.array().cast("array<int>")), lambda i: F.substring(text, i, F.lit(q))))
    # All grams have q characters, so the number can simply follow.
    return _bound(grams, lambda all_: F.transform(all_, lambda g, i: F.concat(g, (i - F.array_position(all_, g)).cast("string"))))


def _bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)``, with the value computed once: a lambda that names an
    expression outside of it would compute that again for each element."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _with_prefix(df: DataFrame, name: str, block: list[str], q: int, order: DataFrame, overlap: Column) -> DataFrame:
    """Rows (block, string, len, prefix, token): one per token of the prefix."""
    lower = F.lower(F.col(name))
    base = df.withColumn("len", F.length(lower)).withColumn("tokens", _grams(lower, q))
    exploded = base.select(*block, name, "len", F.explode("tokens").alias("token"))
    weighed = exploded.join(order, "token", "left").withColumn("f", F.coalesce("f", F.lit(0)))
    # The list per string is as long as the string.
    sorted_tokens = F.sort_array(F.collect_list(F.struct("f", "token"))).alias("ordered")
    ranked = weighed.groupBy(*block, name, "len").agg(sorted_tokens)
    tokens = F.transform("ordered", lambda t: t["token"])
    size = F.size("ordered")
    length = F.greatest(F.lit(0), F.least(size, size - F.greatest(overlap, F.lit(1)) + 1)).cast("int")
    return (
        ranked.withColumn("all_tokens", tokens)
        .withColumn("prefix", F.slice("all_tokens", F.lit(1), length))
        .select(*block, name, "len", "all_tokens", "prefix", F.explode("prefix").alias("token"))
    )


def _token_order(rights: DataFrame, q: int) -> DataFrame:
    """How many right strings hold each token; the global order is by this."""
    tokens = rights.select(F.explode(_grams(F.lower("r"), q)).alias("token"))
    return tokens.groupBy("token").agg(F.count(F.lit(1)).alias("f"))


def _candidates(
    lefts: DataFrame, rights: DataFrame, block: list[str], q: int, overlap: Column, once: bool
) -> DataFrame:
    """Every pair whose prefixes share a token.

    With ``once`` a pair is kept only at its first common token.  Without, it
    may come up again; a cheap score then costs less than the comparison.
    """
    order = _token_order(rights, q)
    a = _with_prefix(lefts, "l", block, q, order, overlap).withColumnsRenamed(
        {"len": "len_l", "prefix": "prefix_l", "all_tokens": "tokens_l"}
    )
    b = _with_prefix(rights, "r", block, q, order, overlap).withColumnsRenamed(
        {"len": "len_r", "prefix": "prefix_r", "all_tokens": "tokens_r"}
    )
    pairs = salted_join(a, b, [*block, "token"], ["r"])
    if not once:
        return pairs
    return pairs.filter(F.element_at(F.array_intersect("prefix_l", "prefix_r"), 1) == F.col("token"))


def gram_size(threshold: float) -> int:
    """Longest q-gram for which the overlap bound still covers every length.

    A pair at or above the threshold has distance at most ``(1 - t) * longest``
    and shares at least ``longest - q + 1 - q * distance`` grams.  Where that
    is below one, no inequality may be possible at all for the length.
    """
    slack = 1.0 - threshold
    for q in (3, 2):
        gain = 1.0 - q * slack
        if gain <= 0:
            continue
        # Longest string for which the bound is below one token.
        weakest = (q - 1) / gain
        if slack * math.floor(weakest + _EPS) / threshold < 1.0 - _EPS:
            return q
    return 1


def _levenshtein_pairs(lefts: DataFrame, rights: DataFrame, block: list[str], threshold: float) -> DataFrame:
    if threshold <= 0:
        raise ValueError("the threshold must be positive")
    q = gram_size(threshold)
    slack = 1.0 - threshold
    overlap = F.ceil(F.col("len") * (1.0 - q * slack) - (q - 1) - _EPS).cast("int")
    pairs = _candidates(lefts, rights, block, q, overlap, once=False)
    shorter, longer = F.least("len_l", "len_r"), F.greatest("len_l", "len_r")
    close = pairs.filter(longer - shorter <= F.floor(longer * slack + _EPS))
    scored = close.withColumn("score", levenshtein_similarity("l", "r"))
    return scored.filter(F.col("score") >= threshold).select(*block, "l", "r", "score")


#: Tokens whose frequencies order the others; rarer ones count as never seen.
COMMON_TOKENS = 1000


#: From this sum of shares on, tokens are worth their rows for any lead.
STRONG_SUM = 1.5


def _token_counts(strings: DataFrame, name: str) -> DataFrame:
    """One row: how often the most frequent tokens occur, as a map."""
    tokens = strings.select(F.explode(_grams(F.lower(name), 1)).alias("token"))
    top = tokens.groupBy("token").agg(F.count(F.lit(1)).alias("f")).orderBy(F.col("f").desc(), "token").limit(COMMON_TOKENS)
    return top.agg(F.map_from_arrays(F.collect_list("token"), F.collect_list("f")).alias("_counts"))


def _least_sum(threshold: float, lead: int) -> float:
    """What common/m + common/n must reach for a score at the threshold, with
    ``lead`` equal first characters and no transposition."""
    plain = (threshold - PREFIX_BONUS * lead) / (1 - PREFIX_BONUS * lead)
    return 3 * plain - 1 - _EPS


def _band_ratio(total: float) -> float:
    """Ratio of the bounds of a length band: a quarter of the lengths that fit."""
    return min(max(1 + (1 / (total - 1) - 1) / 4, 1.02), 1.3)


def _band(length: Column, ratio: float) -> Column:
    return F.floor(F.log(length.cast("double")) / math.log(ratio) + _EPS).cast("int")


def _band_start(band: Column, ratio: float) -> Column:
    return F.pow(F.lit(ratio), band.cast("double"))


KEYS = "array<struct<lead:int,head:string,band_l:int,band_r:int,token:string>>"


def _ratios(threshold: float) -> list[float]:
    """For every lead the ratio of its length bands."""
    totals = [_least_sum(threshold, lead) for lead in range(MAX_PREFIX + 1)]
    return [_band_ratio(total) if total > 1 else 2.0 for total in totals]


def _bands(strings: DataFrame, name: str, threshold: float) -> DataFrame:
    """One row: for every lead the length bands that have strings."""
    lengths = strings.select(F.length(F.lower(name)).alias("len")).filter(F.col("len") > 0).distinct()
    return lengths.agg(*[F.collect_set(_band(F.col("len"), r)).alias(f"_bands_{lead}") for lead, r in enumerate(_ratios(threshold))])


def _changes(length: Column, total: Column | float) -> Column:
    """Most places at which two strings of this length may differ if all their
    characters have to be common: ``(2 + 1 - d / (2 * length)) / 3`` is their
    plain score.  As ``length * (2 - total) < 2`` then, there are at most three."""
    return F.floor(2 * length * (2 - total) + 1e-6)


def _dealt(pieces: int) -> Column:
    """The characters dealt to so many pieces, in turns."""
    places = F.sequence(F.lit(0), F.lit(pieces - 1))
    return F.transform(places, lambda at: F.array_join(F.filter("_chars", lambda c, i: i % pieces == at), ""))


def _changed_tokens(lead: int, changes: Column) -> Column:
    """Tokens of strings whose partner has the same characters, at all but
    ``changes`` places the same one.

    The characters are dealt to two pieces more than changes.  Two pieces at
    least are then equal, so each pair of them is a token, next to all
    characters in order.  Behind a lead below the greatest stands a character
    that differs; pairs with its piece are left out.  One change alone cannot
    be.
    """

    def tokens(places: int) -> Column:
        pieces = places + 2
        open_ = [i for i in range(pieces) if lead == MAX_PREFIX or i != lead % pieces]
        of = [F.element_at(f"_pieces_{pieces}", i + 1) for i in range(pieces)]
        return F.array(*[F.xxhash64("_sorted", F.lit(a), F.lit(b), of[a], of[b]).cast("string") for a, b in combinations(open_, 2)])

    same = F.array(F.col("_lower"))
    none = same if lead == MAX_PREFIX else F.when(F.col("len") == lead, same).otherwise(F.array().cast("array<string>"))
    return F.when(changes < 2, none).when(changes == 2, tokens(2)).otherwise(tokens(3))


def _lead_keys(df: DataFrame, name: str, facts: DataFrame, threshold: float, is_left: bool) -> DataFrame:
    """Index rows of strings: for every lead and every length band that has
    partners, the first characters and the rarest tokens of the rest.

    With ``c`` the least number of common characters for two bands, less the
    lead, two strings that fit share a token among the first ``rest - c + 1``
    of each, by one order of all tokens.  Where the bound is weak, leads of
    three and more are left without tokens, as is a bound of no further common
    characters.  Where no string can do without a character, both have the same
    ones and may differ at few places only (see :func:`_changed_tokens`).
    ``facts`` has the token counts and the partners' bands in one row.
    """
    lower = F.col("_lower")
    base = df.withColumn("_lower", F.lower(name)).withColumn("len", F.length(lower)).filter(F.col("len") > 0)
    marked = base.join(F.broadcast(facts))

    def bit(token: Column) -> Column:
        return F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(F.xxhash64(token), F.lit(64)).cast("int"))

    def by_count(tokens: Column) -> Column:
        weighed = F.transform(tokens, lambda t: F.struct(F.coalesce(F.element_at("_counts", t), F.lit(0).cast("long")).alias("f"), t.alias("t")))
        return F.transform(F.sort_array(weighed), lambda s: s["t"])

    totals = [_least_sum(threshold, lead) for lead in range(MAX_PREFIX + 1)]
    ratios = _ratios(threshold)
    tokened = [lead for lead, total in enumerate(totals) if lead == 0 or total >= STRONG_SUM or (total > 1 and lead < 3)]

    def bounds(lead: int, other: Column) -> tuple[Column, Column]:
        """Least number of common characters of two bands, and their longest string."""
        band, ratio = F.col(f"_band_{lead}"), ratios[lead]
        mine, theirs = (F.ceil(_band_start(b, ratio) - 1e-6) for b in (band, other))
        least = F.greatest(F.ceil(totals[lead] * mine * theirs / (mine + theirs) - 1e-6).cast("int"), F.lit(1))
        return least, F.floor(_band_start(F.greatest(band, other) + 1, ratio) + 1e-6)

    def others(lead: int) -> Column:
        # The shorter one has at least total - 1 of the longer one's length.
        share, ratio = totals[lead] - 1, ratios[lead]
        first = F.greatest(_band(F.greatest(F.lit(1.0), F.col("len") * share), ratio) - 1, F.lit(0))
        return F.array_intersect(F.sequence(first, _band(F.col("len") / share, ratio) + 1), f"_bands_{lead}")

    def rarest(lead: int) -> Column:
        ordered = by_count(_grams(F.substring(lower, lead + 1, 1 << 30), 1))
        if totals[lead] <= 1:
            return ordered

        def by_tokens(other: Column) -> Column:
            least, longest = bounds(lead, other)
            return longest > least

        return F.when(F.exists(f"_others_{lead}", by_tokens), ordered)

    strong = [lead for lead in tokened if totals[lead] > 1]
    marked = marked.withColumns(
        {f"_band_{lead}": _band(F.col("len"), ratios[lead]) for lead in strong} | {f"_others_{lead}": others(lead) for lead in strong}
    )
    chars = F.transform(F.sequence(F.lit(1), F.col("len")), lambda i: F.substring(lower, i, F.lit(1)))
    marked = marked.withColumns(
        {"_chars": chars, "_grams_0": _grams(lower, 1)} | {f"_rarest_{lead}": rarest(lead) for lead in tokened}
    )
    # A longer lead has more changes; beyond three a character can be missing.
    fewest, most = (_changes(F.col("len"), totals[lead]) for lead in (0, MAX_PREFIX))
    marked = marked.withColumns(
        {"_sorted": F.array_join(F.sort_array("_chars"), "")}
        | {f"_pieces_{places + 2}": F.when((fewest <= 3) & (most >= places), _dealt(places + 2)) for places in (2, 3)}
    )
    signature = F.aggregate("_grams_0", F.lit(0).cast("long"), lambda bits, t: bits.bitwiseOR(bit(t)))
    kinds = []
    for lead, total in enumerate(totals):

        def key(token: Column, other: Column | None = None) -> Column:
            own, theirs = (F.lit(-1), F.lit(-1)) if other is None else (F.col(f"_band_{lead}"), other)
            left, right = (own, theirs) if is_left else (theirs, own)
            return F.struct(
                F.lit(lead).alias("lead"), F.substring(lower, 1, lead).alias("head"), left.alias("band_l"), right.alias("band_r"), token.alias("token")
            )

        ordered = F.col(f"_rarest_{lead}")

        def of_band(other: Column) -> Column:
            least, longest = bounds(lead, other)
            common = least - lead
            kept = F.slice(ordered, F.lit(1), F.greatest(F.col("len") - lead - common + 1, F.lit(0)))
            some = F.transform(kept, lambda t: key(t, other))
            # Where no string of the bands can do without a token, both have one length.
            changed = _changed_tokens(lead, _changes(F.col("len"), total))
            whole = F.when(other == F.col(f"_band_{lead}"), F.transform(changed, lambda t: key(t, other))).otherwise(F.array().cast(KEYS))
            return F.when(longest <= least, whole).when(common <= 0, F.array(key(F.lit(""), other))).otherwise(some)

        if lead not in tokened:
            found = F.array(key(F.lit("")))
        elif total <= 1:  # any length may fit, but one character is common
            found = F.transform(ordered, lambda t: key(t))
        else:
            found = F.flatten(F.transform(f"_others_{lead}", of_band))
        kinds.append(F.when(F.col("len") >= lead, found).otherwise(F.array().cast(KEYS)))
    # A plain inline lets the optimizer test the size of all keys before, for which it makes them once more.
    keys = F.inline_outer(F.concat(*kinds))
    return marked.select(*df.columns, "len", signature.alias("signature"), keys).filter(F.col("lead").isNotNull())


def jaro_winkler_candidates(lefts: DataFrame, rights: DataFrame, block: Sequence[str], threshold: float) -> DataFrame:
    """Pairs ``l``, ``r`` that can reach the threshold by their characters.

    With ``c`` common characters the plain score of strings of lengths m and n
    is at most ``(c/m + c/n + 1) / 3``.  Pairs meet at their number of equal
    first characters and at rare common tokens (see :func:`_lead_keys`).  A
    64-bit signature of the numbered characters tells how many of them the
    other string lacks at least; pairs that lack too many are not written, nor
    are those that need all characters and have too many at other places.
    """
    if threshold <= 0:
        raise ValueError("the threshold must be positive")
    block = list(block)
    # Few bytes of strings make many rows; left alone they would lie in one task.
    tasks = int(lefts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # By a hash, as Spark drops a repartition by the columns of a distinct before it.
    lefts, rights = lefts.repartition(tasks, F.xxhash64("l")), rights.repartition(tasks, F.xxhash64("r"))
    counts = _token_counts(rights, "r")
    of_rights, of_lefts = (counts.join(F.broadcast(_bands(df, name, threshold))) for df, name in ((rights, "r"), (lefts, "l")))
    a = _lead_keys(lefts, "l", of_rights, threshold, True).withColumnsRenamed({"len": "len_l", "signature": "bits_l"})
    b = _lead_keys(rights, "r", of_lefts, threshold, False).withColumnsRenamed({"len": "len_r", "signature": "bits_r"})
    pairs = salted_join(a, b, [*block, "lead", "head", "band_l", "band_r", "token"], ["r"])
    lacks_l = F.bit_count(F.col("bits_l").bitwiseAND(F.bitwise_not("bits_r")))
    lacks_r = F.bit_count(F.col("bits_r").bitwiseAND(F.bitwise_not("bits_l")))
    common = F.least(F.col("len_l") - lacks_l, F.col("len_r") - lacks_r)
    needed = F.element_at(F.array(*[F.lit(_least_sum(threshold, lead)) for lead in range(MAX_PREFIX + 1)]), F.col("lead") + 1)
    longer_lead = (F.least("len_l", "len_r") > F.col("lead")) & (
        F.substring(F.lower("l"), F.col("lead") + 1, F.lit(1)) == F.substring(F.lower("r"), F.col("lead") + 1, F.lit(1))
    )
    hopeful = pairs.filter(
        (common > 0) & (common / F.col("len_l") + common / F.col("len_r") >= needed) & ((F.col("lead") == MAX_PREFIX) | ~longer_lead)
    )
    # Strings of one length that need all characters differ at few places, so their edit distance is as small.
    all_common = (F.col("len_l") == F.col("len_r")) & (F.col("len_l") * (2 - needed) < 2)
    edits = F.levenshtein(F.lower("l"), F.lower("r"), 3)  # -1 beyond
    hopeful = hopeful.filter(~all_common | edits.between(0, _changes(F.col("len_l"), needed)))
    return hopeful.select(*block, "l", "r").distinct()


def _jaro_winkler_pairs(lefts: DataFrame, rights: DataFrame, block: list[str], threshold: float) -> DataFrame:
    """Pairs at or above the threshold with their score."""
    scored = jaro_winkler_candidates(lefts, rights, block, threshold).withColumn("score", jaro_winkler("l", "r"))
    return scored.filter(F.col("score") >= threshold)


def _containing(lefts: DataFrame, rights: DataFrame, block: list[str], width: int = 3) -> DataFrame:
    """Left strings found inside right strings; the smallest right one wins.

    A contained string brings all its grams along, so it is enough to look
    the right strings up by one gram: the rarest of the left string.
    """
    size = F.least(F.length(F.lower("l")), F.lit(width))
    pieces = [
        rights.select(*block, "r", F.explode(F.array_distinct(F.transform(_grams(F.lower("r"), q), lambda t: F.substring(t, 1, q)))).alias("gram"))
        for q in range(1, width + 1)
    ]
    index = pieces[0]
    for piece in pieces[1:]:
        index = index.unionByName(piece)
    frequency = index.groupBy(*block, "gram").agg(F.count(F.lit(1)).alias("f"))
    starts = F.sequence(F.lit(1), F.length(F.lower("l")) - size + 1)
    grams = lefts.filter(F.length("l") > 0).select(
        *block, "l", F.explode(F.transform(starts, lambda i: F.substring(F.lower("l"), i, size))).alias("gram")
    )
    # A gram no right string has proves that nothing contains the left string.
    weighed = grams.join(frequency, [*block, "gram"], "left").withColumn("f", F.coalesce("f", F.lit(0)))
    rarest = weighed.groupBy(*block, "l").agg(F.min(F.struct("f", "gram")).alias("key")).filter(F.col("key.f") > 0)
    keyed = rarest.select(*block, "l", F.col("key.gram").alias("gram"))
    hits = salted_join(keyed, index, [*block, "gram"], ["r"]).filter(F.contains(F.lower("r"), F.lower("l")))
    best = hits.groupBy(*block, "l").agg(F.min("r").alias("r"))
    # The empty string is inside every string.
    smallest = rights.groupBy(*block).agg(F.min("r").alias("r"))
    blank = lefts.filter(F.length("l") == 0)
    empties = blank.join(smallest, block) if block else blank.join(F.broadcast(smallest.filter("r IS NOT NULL")))
    both = best.select(*block, "l", "r").unionByName(empties.select(*block, "l", "r"))
    return both.withColumn("score", F.lit(1.0))
