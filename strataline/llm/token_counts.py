"""Token counts by rank-synchronous merging.

Defined results: a null text counts as empty and has 0 bytes and 0 tokens;
special strings inside a text are one token each, as the library reads them by
default. Texts are never cut. Rows that are there twice are counted twice; an
empty table gives an empty result. Only the text column is read beside those that
are kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bpe import UnicodeTables, chunks, engine, unicode_tables
from .common import table
from .workers import released

TOKENIZER = "word_bpe_49k.json"


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def count_tokens(df: DataFrame, path: str, text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """Columns ``keep`` of df with n_bytes and n_tokens of each row's text, by the vocabulary file at path on every node."""
    fields = [df.schema[c] for c in keep]
    tables = df.sparkSession.sparkContext.broadcast(tuple(unicode_tables()))

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = engine(path, False, UnicodeTables(*tables.value))
        for batch in batches:
            texts = batch.column(0).to_pylist()
            counts: list[int] = []
            for a, b in chunks(texts):
                counts += bpe.encode(texts[a:b]).counts.tolist()
            sizes = pa.array([len(t.encode()) if t else 0 for t in texts], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], sizes, pa.array(counts, pa.int64())], [*keep, "n_bytes", "n_tokens"])

    schema = T.StructType([*fields, T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType())])
    return df.select(F.col(text).alias("__text"), *keep).mapInArrow(run, schema)


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = count_tokens(table(spark, sf_dir, "documents"), tokenizer_path(), keep=("doc_id",))
    return out.withColumn("over_limit", F.col("n_tokens") > 2048)
