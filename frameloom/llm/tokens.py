"""Sizes of texts in tokens of a public tokenizer."""

from __future__ import annotations

import os
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Folder of the vocabulary files; a parameter wherever tokens are counted.
TOKENIZERS = "/opt/tokenizers"
BATCH = 256


@cache
def _tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    made = Tokenizer.from_file(path)
    made.encode_special_tokens = True  # their strings in a text are ordinary text
    made.no_truncation()
    return made


def token_counts(df: DataFrame, text: str, keep: list[str], name: str = "byte_bpe_50k.json", folder: str = TOKENIZERS) -> DataFrame:
    """The columns ``keep`` and ``n_tokens`` of every row; whole texts are counted. A null or empty text has 0 tokens."""
    path = os.path.join(folder, name)

    def run(batches):
        for batch in batches:
            texts, sizes = batch.column(0).to_pylist(), []
            for a in range(0, len(texts), BATCH):
                encoded = _tokenizer(path).encode_batch_fast([t or "" for t in texts[a : a + BATCH]], add_special_tokens=False)
                sizes += [len(e) for e in encoded]
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(sizes, pa.int64())], [*batch.schema.names[1:], "n_tokens"])

    kinds = ", ".join(f"c{i} {df.schema[c].dataType.simpleString()}" for i, c in enumerate(keep))
    counted = df.select(F.col(text).alias("text"), *[F.col(c).alias(f"c{i}") for i, c in enumerate(keep)]).mapInArrow(run, f"{kinds}, n_tokens bigint")
    return counted.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(keep)], "n_tokens")
