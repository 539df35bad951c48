"""Small awkward corpora for the corpus operators."""

import random

#: Names that operators use inside; an input may have them too.
CLASHES = (
    "node", "text_key", "hash", "chunk", "shard", "slot", "start", "term", "position", "recipe", "label", "kind",
    "words", "spans", "count", "key", "number", "root", "bucket", "payload", "doc_key", "lang_pred", "score", "_shard",
)
WORDS = [a + b for a in ("ba", "do", "ki", "lu", "mé", "ßo", "zz") for b in ("n", "ra", "ti", "mo", "q1", "x,")]


def sentence(seed: int, size: int) -> str:
    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) for _ in range(size))


def messy_rows() -> list[tuple]:
    long_run = "a1" * 20_000
    rows = [
        (1, sentence(1, 60)),
        (2, None),
        (3, ""),
        (4, " \n\t  "),
        (5, sentence(1, 60)),
        (6, sentence(6, 80) + "\n" + sentence(7, 50)),
        (6, sentence(6, 80) + "\n" + sentence(7, 50)),
        (None, sentence(8, 70)),
        (None, None),
        (9, sentence(9, 4000)),
        (10, long_run),
        (11, "Word"),
        (12, "word word"),
        (13, "12 !? ..."),
        (14, "x\x85y \xa0 z w  two  spaces \x1c end "),
        (15, sentence(6, 80) + " extra"),
    ]
    return rows


def messy(spark, rows=None):
    df = spark.createDataFrame(messy_rows() if rows is None else rows, "doc_id long, text string")
    return df.selectExpr("*", *[f"{i} as `{name}`" for i, name in enumerate(CLASHES)]).repartition(3)


def empty(spark):
    return messy(spark).limit(0)
