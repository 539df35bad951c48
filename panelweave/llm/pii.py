"""Personal data by gradient-boosted candidates.

High-recall patterns propose overlapping spans.  Spans of the strict base
patterns that pass the checks of their kind are always selected.  All other
spans (loose ones: other ways of writing the same kinds, and long tokens that
may be secrets) have to pass the checks of their kind and the threshold of
boosted trees that see their format and what stands around them, an announcing
word among it.  Nothing touches a base span.

The trees learn here, from every span that has a label; spans with the same
features are one row with their weight.  There are no span labels; labels are
taken from checks that format and context do not show.  Positive is a base span, and a card, ip
or secret that passes (check digit; octets or eight groups; letters mixed with
digits).  Negative is a span that fails: a wrong check digit, a bad octet, too
few groups, an address without a domain, a run of more digits than any phone
has, a long token that is plain word or number.  As e-mail and phone checks are
weak, their loose spans that pass are negative too, each with the weight of one
in ``look_alikes``.  What the checks read is no feature.  Scores have four
decimals.  A kind's threshold is the lowest at which at least the share
``precision`` of the spans above it is positive.  A hash deals the spans to two
halves; each half teaches trees, whose thresholds the other half gives, and an
added span has to pass both.  Where there is no such threshold, or a half lacks
one of the kind's labels, nothing of that kind is added.

Defined results: a null or empty text has no spans.  Spans are code-point
offsets, end exclusive.  Equal texts have equal spans and are worked on once.
Rows with a null or repeated id are rows like any other.  Without both classes,
as in an empty table, nothing is added to the base spans.  Other
columns of the input are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import settle, taken

KINDS = ("email", "ip", "card", "phone")
#: Kinds of all spans; a secret has no base pattern.
ALL_KINDS = (*KINDS, "secret")

# Base patterns.  Possessive repeats and the look-behind keep long runs linear
# without changing what is matched.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
# Loose patterns: written-out and bare addresses, long addresses of hosts,
# numbers without a prefix or with other signs between groups, long tokens.
LOOSE = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++(?:\s?(?:\(at\)|\[at\])\s?[A-Za-z0-9-]++(?:\s?(?:\(dot\)|\[dot\]|\.)\s?[A-Za-z0-9-]{2,})*+|@[A-Za-z0-9-]++(?!\.[A-Za-z0-9-]))",
    "ip": r"(?<![0-9A-Za-z:])(?:[0-9A-Fa-f]{1,4}:){4,7}[0-9A-Fa-f]{1,4}(?![0-9A-Za-z:])",
    "card": r"(?<![0-9])[0-9]{4}(?:[\x20._/-]{1,2}[0-9]{3,7}){1,4}(?![0-9])",
    "phone": r"(?<![0-9+.,:/-])(?:(?:00[1-9][0-9]?[\x20./-])?\(?[0-9]{2,5}\)?[\x20./-]{1,2}[0-9]{3,4}[\x20./-][0-9]{3,5}|(?<![A-Za-z_])[0-9]{9,19}(?![A-Za-z_]))(?![0-9]|[.,:/-][0-9])",
    "secret": r"(?<![A-Za-z0-9_-])[A-Za-z0-9_-]{16,}+",
}
CUE = {
    "email": r"(?i)(?:mail|contact|write|kontakt|correo|courriel)[^\n]{0,12}$",
    "ip": r"(?i)(?:\bip\b|host|server|addr)[^\n]{0,12}$",
    "card": r"(?i)(?:card|visa|credit|karte|tarjeta|carte)[^\n]{0,12}$",
    "phone": r"(?i)(?:tel|phone|call|fax|mobile|cell)[^\n]{0,12}$",
    "secret": r"(?i)(?:token|key|secret|passw|auth|credential)[^\n]{0,12}$",
}
#: Characters before and after a span that its context is taken from.
CONTEXT = 32
#: Scores are multiples of one over this.
SCORES = 10_000
#: What the trees see; nothing that a check reads.
FEATURES = (
    "announced", "n_groups", "n_signs", "n_blanks", "after_word", "before_word", "after_space", "after_colon", "quoted",
    "after_number", "before_number", "line_start", "line_end", "digits_before", "digits_after",
    *[f"is_{k}" for k in ALL_KINDS],
)


@dataclass(frozen=True)
class Options:
    look_alikes: int = 20  #: so many loose e-mails and phones that pass count as one negative
    rounds: int = 12
    depth: int = 3
    floor: float = 0.5  #: least score of an added span
    precision: float = 0.9  #: least share of positives above a threshold


def digits_of(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether 12 to 19 digits end in their check digit."""
    backwards = F.reverse(digits)

    def part(i: Column) -> Column:
        digit = F.substring(backwards, i, F.lit(1)).cast("int")
        doubled = digit * 2
        return F.when(i % 2 == 1, digit).otherwise(F.when(doubled > 9, doubled - 9).otherwise(doubled))

    total = F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), lambda held, i: held + part(i))
    return F.when(F.length(digits).between(12, 19), total % 10 == 0).otherwise(False)


def _valid(kind: Column, value: Column, base: Column) -> Column:
    """Whether a span passes the checks of its kind."""
    part = r"0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"
    digits = digits_of(value)
    changes = F.regexp_count(value, F.lit("[A-Za-z][0-9]|[0-9][A-Za-z]"))
    return (
        F.when(kind == "email", base | value.rlike(r"(?:\.|\(dot\)|\[dot\])\s?[A-Za-z]{2,}$"))
        .when(kind == "ip", value.rlike(rf"^{part}(?:\.{part}){{3}}$|^(?:[^:]+:){{7}}[^:]+$"))
        .when(kind == "card", luhn(digits))
        .when(kind == "secret", changes >= 4)
        .otherwise(F.length(digits).between(9, 15))
    )


def _proposals(docs: DataFrame) -> DataFrame:
    """All spans proposed for each distinct text: ``text_key``, ``kind``,
    ``base``, ``start``, ``end``, ``value``, ``before``, ``after``.

    Where a pattern splits a text, gaps and matches alternate; the running sum
    of their lengths is the position.  A window over one text's matches takes
    it, so even a text full of matches costs no more than its length.
    """
    text = F.col("text")
    may = {"email": text.rlike(r"@|\(at\)|\[at\]")}
    number = text.rlike("[0-9]")
    arrays = {}
    for base, patterns in ((True, BASE), (False, LOOSE)):
        for kind in patterns:
            gaps, found = F.split(text, patterns[kind], -1), F.regexp_extract_all(text, F.lit(patterns[kind]), F.lit(0))
            zipped = F.arrays_zip(gaps.alias("gap"), found.alias("value"), F.slice(gaps, 2, 1 << 30).alias("next"))
            rows = F.transform(
                zipped,
                lambda x: F.struct(
                    F.length(x["gap"]).alias("gap"),
                    x["value"].alias("value"),
                    F.right(x["gap"], F.lit(CONTEXT)).alias("before"),
                    F.left(x["next"], F.lit(CONTEXT)).alias("after"),
                ),
            )
            arrays[(kind, base)] = F.when(may.get(kind, number) & text.rlike(patterns[kind]), rows)
    tagged = F.array(
        *[
            F.struct(F.lit(kind).alias("kind"), F.lit(base).alias("base"), rows.alias("rows"))
            for (kind, base), rows in arrays.items()
        ]
    )
    matches = (
        docs.where(number | may["email"])
        .select("text_key", F.explode(tagged).alias("found"))
        .where("found.rows is not null")
        .select("text_key", "found.kind", "found.base", F.posexplode("found.rows").alias("place", "row"))
        .select("text_key", "kind", "base", "place", "row.*")
        .where("value is not null")
        .distinct()
    )
    order = Window.partitionBy("text_key", "kind", "base").orderBy("place")
    end = F.sum(F.col("gap") + F.length("value")).over(order)
    return matches.select(
        "text_key", "kind", "base", (end - F.length("value")).alias("start"), end.alias("end"), "value", "before", "after"
    )


def _described(spans: DataFrame) -> DataFrame:
    """Checks and the features of format and context.  Features of format are
    for cards and ips only: of the other kinds the checks, or the base pattern
    that makes a positive, show in the format."""
    kind, value, before, after, base = (F.col(c) for c in ("kind", "value", "before", "after", "base"))
    cue = F.lit(False)
    for name, pattern in CUE.items():
        cue = F.when(kind == name, before.rlike(pattern)).otherwise(cue)

    def formed(count: Column) -> Column:
        return F.when(kind.isin("ip", "card"), count)

    number = {
        "announced": cue,
        "n_groups": formed(F.regexp_count(value, F.lit("[0-9]+"))),
        "n_signs": formed(F.regexp_count(value, F.lit("[^0-9A-Za-z]"))),
        "n_blanks": formed(F.regexp_count(value, F.lit(r"\s"))),
        "after_word": before.rlike(r"\w$"),
        "before_word": after.rlike(r"^\w"),
        "after_space": before.rlike(r"(?:^|\s)$"),
        "after_colon": before.rlike(r"[:=]\s*[\"'`]?$"),
        "quoted": before.rlike("[\"'`]$") & after.rlike("^[\"'`]"),
        "after_number": before.rlike(r"[0-9][^\w\n]*$"),
        "before_number": after.rlike(r"^[^\w\n]*[0-9]"),
        "line_start": before.rlike(r"(?:^|\n)\s*$"),
        "line_end": after.rlike(r"^[.;,]?\s*(?:\n|$)"),
        "digits_before": F.regexp_count(before, F.lit("[0-9]")),
        "digits_after": F.regexp_count(after, F.lit("[0-9]")),
    } | {f"is_{k}": kind == k for k in ALL_KINDS}
    return spans.select(
        "text_key", "kind", "start", "end", "base",
        _valid(kind, value, base).alias("valid"),
        F.length(digits_of(value)).between(12, 19).alias("has_check_digit"),
        *[F.coalesce(column.cast("double"), F.lit(0.0)).alias(name) for name, column in number.items()],
    )


def _labelled(described: DataFrame, options: Options = Options()) -> DataFrame:
    """All spans with ``touched``, by a valid base span, ``label``, ``weight``
    and ``half``, by a hash of the span.  A number too short or long to be a
    card teaches nothing."""
    solid = F.expr("base and valid")
    order = Window.partitionBy("text_key").orderBy("start", F.desc("solid"))
    last_end = F.max(F.when(F.col("solid"), F.col("end"))).over(order.rowsBetween(Window.unboundedPreceding, -1))
    next_start = F.min(F.when(F.col("solid"), F.col("start"))).over(order.rowsBetween(1, Window.unboundedFollowing))
    touched = F.coalesce(last_end > F.col("start"), F.lit(False)) | F.coalesce(next_start < F.col("end"), F.lit(False))
    half = F.pmod(F.xxhash64("text_key", "kind", "start"), F.lit(2)).cast("int")
    weak = ~F.col("solid") & F.expr("valid and kind in ('email', 'phone')")
    label = (
        F.when(F.col("solid"), 1.0)
        .when(F.col("touched") | F.expr("kind = 'card' and not has_check_digit"), None)
        .when(~F.col("valid"), 0.0)
        .otherwise(F.when(weak, 0.0).otherwise(1.0))
    )
    weight = F.when(weak, 1 / options.look_alikes).otherwise(1.0)
    return described.withColumn("solid", solid).withColumns({"touched": touched, "half": half}).withColumns(
        {"label": label, "weight": weight}
    )


def _limit(held: list[tuple[float, ...]], options: Options) -> float | None:
    """The lowest score, ``floor`` at least, with enough positives among all
    scores from there on.  Rows are score, label and, unless 1, weight."""
    limit, positive, total = None, 0.0, 0.0
    held = sorted(held, reverse=True)
    for i, (score, label, *weight) in enumerate(held, 1):
        own = weight[0] if weight else 1.0
        positive, total = positive + label * own, total + own
        last_of_score = i == len(held) or held[i][0] < score
        if score >= options.floor and last_of_score and positive >= options.precision * total:
            limit = score
    return limit


def _model(spans: DataFrame, options: Options):
    """What scores spans by how far they are above the thresholds of their kind,
    and the kinds that have any, from all labelled spans; or None."""
    known = spans.where("label is not null").groupBy("kind", "label", "half", *FEATURES)
    # Sums of counts, so that no order of rows changes a weight.
    known = settle(known.agg((F.count(F.lit(1)) * F.first("weight")).alias("weight")))
    taught = {tuple(row) for row in known.select("kind", "label", "half").distinct().collect()}  # 20 at most
    kinds = [kind for kind in ALL_KINDS if {(kind, label, half) for label in (0.0, 1.0) for half in (0, 1)} <= taught]
    if not kinds:
        return None
    judges = []
    for half in (0, 1):
        score = _taught(known.where(F.col("half") == half), options)
        held = score(known.where((F.col("half") != half) & F.col("kind").isin(kinds)))
        by_kind: dict[str, list[tuple[float, float, float]]] = {kind: [] for kind in kinds}
        # Two rows for each of 10,001 scores of a kind at most.
        for row in held.groupBy("kind", "score", "label").agg(F.sum("weight").alias("weight")).collect():
            by_kind[row["kind"]].append((row["score"], row["label"], row["weight"]))
        judges.append((score, {kind: _limit(rows, options) for kind, rows in by_kind.items()}))
    kinds = [kind for kind in kinds if all(limits[kind] is not None for _, limits in judges)]

    def surplus(rows: DataFrame) -> DataFrame:
        for i, (score, limits) in enumerate(judges):
            rows = score(rows).withColumn(f"over_{i}", F.col("score") - _limit_of({k: limits[k] for k in kinds})).drop("score")
        return rows.withColumn("score", F.least("over_0", "over_1"))

    return surplus, {kind: 0.0 for kind in kinds}


def _limit_of(limits: dict[str, float]) -> Column:
    """The threshold of a row's kind; one that no score reaches without."""
    limit = F.lit(2.0)
    for kind, value in limits.items():
        limit = F.when(F.col("kind") == kind, F.lit(value)).otherwise(limit)
    return limit


def _taught(known: DataFrame, options: Options) -> Callable[[DataFrame], DataFrame]:
    """What adds ``score``, by trees that these rows teach, to others."""
    assembler = VectorAssembler(inputCols=list(FEATURES), outputCol="features")
    # The trees look at each distinct row of features some forty times.
    trees = GBTClassifier(
        featuresCol="features", labelCol="label", weightCol="weight", maxIter=options.rounds, maxDepth=options.depth, seed=7
    ).fit(assembler.transform(known))

    def score(rows: DataFrame) -> DataFrame:
        scored = trees.transform(assembler.transform(rows))
        levels = F.floor(vector_to_array("probability")[1] * SCORES) / SCORES
        return scored.withColumn("score", levels).drop("features", "rawPrediction", "probability", "prediction")

    return score


def find_spans(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", options: Options = Options()
) -> DataFrame:
    """One row per input row: ``doc_id``, ``text`` and ``spans``, an array of
    (start, order of the kind, end, kind, base)."""
    docs = taken(df, {"doc_id": F.col(id_col), "text": F.coalesce(F.col(text_col), F.lit(""))})
    docs = docs.withColumn("text_key", F.md5("text"))
    described = settle(_described(_proposals(docs)))
    labelled = settle(_labelled(described, options))
    chosen = described.where("base and valid").select("text_key", "kind", "start", "end", "base").unionByName(
        _added(labelled, _model(labelled, options))
    )
    order = F.array_position(F.array(*map(F.lit, ALL_KINDS)), F.col("kind"))
    by_text = chosen.groupBy("text_key").agg(
        F.sort_array(F.collect_list(F.struct("start", order.alias("order"), "end", "kind", "base"))).alias("spans")
    )
    spans = settle(by_text)  # a join of written sides can split a text that many rows share
    return docs.select("doc_id", "text_key").join(spans, "text_key", "left").select(
        "doc_id", F.coalesce("spans", F.array().cast(spans.schema["spans"].dataType)).alias("spans")
    )


def _added(labelled: DataFrame, model) -> DataFrame:
    """Loose spans that pass their checks, from their kind's threshold on, that
    no valid base span of any kind touches; of those that overlap, the one that
    starts first."""
    free = labelled.where("valid and not base and not touched")
    names = ("text_key", "kind", "start", "end", "base")
    if not model or not model[1]:
        return free.select(*names).where("false")
    score, limits = model
    return _first_ones(score(free).where(F.col("score") >= _limit_of(limits)).select(*names))


def _first_ones(spans: DataFrame) -> DataFrame:
    """Of spans that overlap, the one that starts first, then of the rest again.

    Only spans linked by overlaps are gathered, a few as a rule; each takes its
    turn against the end of the last one chosen.
    """
    order = Window.partitionBy("text_key").orderBy("start", F.desc("end"), "kind")
    ends = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    fresh = spans.withColumn("ends", ends).withColumn("fresh", F.expr("int(ends is null or ends <= start)"))
    linked = fresh.withColumn("cluster", F.sum("fresh").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    row = F.struct("start", (-F.col("end")).alias("back"), "kind", "end", "base")
    clusters = linked.groupBy("text_key", "cluster").agg(F.sort_array(F.collect_list(row)).alias("rows"))
    kind = clusters.schema["rows"].dataType
    chosen = F.aggregate(
        "rows",
        F.array().cast(kind),
        lambda held, r: F.when(
            (F.size(held) == 0) | (F.element_at(held, -1)["end"] <= r["start"]), F.array_append(held, r)
        ).otherwise(held),
    )
    return clusters.select("text_key", F.explode(chosen).alias("row")).select(
        "text_key", "row.kind", "row.start", "row.end", "row.base"
    )
