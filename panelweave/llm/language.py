"""Language by compression: the language whose text helps most to compress it.

Each language has a raw-content zstandard dictionary cut from labelled texts.
A text, in lower case and without signs and digits, is compressed
block by block against every dictionary; the smallest total decides.  The margin to the second smallest says how sure that is: where
it is narrow, ``rejected`` is true and the language is a guess.

The dictionaries are learnt from a sample of at most ``sample_texts`` labelled
different texts of a language in the order of a hash, ``piece_chars`` from the
middle of each, so their size is bounded by the number of languages.
Prediction uses whole texts.

Defined results: a text that is null or has no letter is ``und`` with score 0,
and rejected.  A tie goes to the language with more labelled texts, or else to
the one that sorts first.  Rows with a null
label teach nothing; without any labelled row every text is ``und``.  Rows with
null or repeated ids are rows like any other.  Other columns are ignored,
whatever their names.  An empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import regex
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import taken

UNKNOWN = "und"
_NO_LETTERS = regex.compile(r"\P{L}+")


def normalise(text: str) -> bytes:
    """Lower-case letters, with one space for whatever stands between them."""
    return _NO_LETTERS.sub(" ", text.lower()).encode()


@dataclass(frozen=True)
class Options:
    sample_texts: int = 1000  #: labelled texts of a language that are learnt from
    piece_chars: int = 256  #: characters of each
    max_languages: int = 500
    block_bytes: int = 2048  #: a text is compressed in blocks of this size
    level: int = 6
    margin: float = 0.005  #: least advantage over the second language, as a share


def held_out(doc_id: Column) -> Column:
    """Whether a document is set aside for testing: a third of all ids."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def learn(df: DataFrame, label_col: str = "lang", text_col: str = "text", options: Options = Options()) -> dict[str, bytes]:
    """Dictionary content by language, from the labelled rows of ``df``, the
    languages with more texts first.

    Copies of a text in a language count and teach once.  A first pass counts
    the texts of each language, a second takes the share of them with the
    smallest hashes, so no language is sorted as a whole.
    """
    middle = F.greatest((F.length("text") - options.piece_chars).cast("int") / 2, F.lit(0)).cast("int") + 1
    rows = (
        taken(df, {"label": F.col(label_col), "text": F.col(text_col)})
        .where("label is not null and length(text) > 0")
        .select(
            "label", F.xxhash64("text").alias("draw"), F.substring("text", middle, F.lit(options.piece_chars)).alias("piece")
        )
    )
    # Texts are told apart by 64 bits of hash; the piece only has to be one of
    # theirs, and is not carried while they are counted.
    distinct = rows.select("label", "draw").distinct()
    counts = {r["label"]: r["count"] for r in distinct.groupBy("label").count().limit(options.max_languages + 1).collect()}
    if len(counts) > options.max_languages:
        raise ValueError(f"more than {options.max_languages} labels")
    if not counts:
        return {}
    share = F.lit(0.0)
    for label, count in counts.items():
        wanted = options.sample_texts + 6 * math.sqrt(options.sample_texts)
        share = F.when(F.col("label") == label, min(1.0, wanted / count)).otherwise(share)
    near = rows.where(F.pmod("draw", F.lit(1 << 30)) < share * (1 << 30)).groupBy("label", "draw").agg(
        F.min("piece").alias("piece")
    )
    order = Window.partitionBy("label").orderBy("draw", "piece")
    sample = near.withColumn("place", F.row_number().over(order)).where(F.col("place") <= options.sample_texts)
    content = {label: b"" for label in sorted(counts, key=lambda label: (-counts[label], label))}
    for row in sample.orderBy("label", "place").collect():  # bounded by languages and sample_texts
        content[row["label"]] = content[row["label"]] + normalise(row["piece"])
    return content


class Classifier:
    """Compressors of all languages, made once per process."""

    def __init__(self, content: dict[str, bytes], options: Options):
        self.options = options
        self.names = list(content)
        parameters = zstandard.ZstdCompressionParameters.from_level(
            options.level, write_content_size=False, write_checksum=False, write_dict_id=False
        )
        self.compressors = []
        for name in self.names:
            held = zstandard.ZstdCompressionDict(content[name], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            held.precompute_compress(compression_params=parameters)
            self.compressors.append(zstandard.ZstdCompressor(dict_data=held, compression_params=parameters))

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        """Language, score and whether the margin is too narrow."""
        raw, step = normalise(text or ""), self.options.block_bytes
        if not raw.strip() or not self.names:
            return UNKNOWN, 0.0, True
        blocks = [raw[i : i + step] for i in range(0, len(raw), step)]
        sizes = [sum(len(c.compress(b)) for b in blocks) for c in self.compressors]
        ordered = sorted(range(len(sizes)), key=lambda i: (sizes[i], i))
        best = sizes[ordered[0]]
        if len(sizes) == 1:
            return self.names[0], 1.0, False
        margin = (sizes[ordered[1]] - best) / sizes[ordered[1]]
        score = 0.5 + 0.5 * min(1.0, margin / 0.25)
        return self.names[ordered[0]], score, margin < self.options.margin


def classify(
    df: DataFrame, content: dict[str, bytes], id_col: str = "doc_id", text_col: str = "text", options: Options = Options()
) -> DataFrame:
    """One row per input row: ``doc_id``, ``text``, ``lang_pred``, ``score``,
    ``rejected``."""
    docs = taken(df, {"doc_id": F.col(id_col), "text": F.col(text_col)})
    return with_language(docs, content, "text", options).drop("text")


def with_language(
    df: DataFrame,
    content: dict[str, bytes],
    text_col: str = "text",
    options: Options = Options(),
    names: tuple[str, str, str] = ("lang_pred", "score", "rejected"),
) -> DataFrame:
    """``df`` with ``lang_pred``, ``score`` and ``rejected``, or what ``names``
    calls them, behind its columns; columns of these names are replaced."""
    shared = df.sparkSession.sparkContext.broadcast(content)
    added = [
        T.StructField(names[0], T.StringType()),
        T.StructField(names[1], T.DoubleType()),
        T.StructField(names[2], T.BooleanType()),
    ]
    df = df.drop(*[f.name for f in added])
    schema = T.StructType([*df.schema.fields, *added])

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classifier = Classifier(shared.value, options)
        for batch in batches:
            found = [classifier.predict(text.as_py()) for text in batch.column(text_col)]
            labels, scores, rejected = zip(*found) if found else ((), (), ())
            made = [pa.array(labels, pa.string()), pa.array(scores, pa.float64()), pa.array(rejected, pa.bool_())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *made], schema.names)

    return df.mapInArrow(predict, schema)
