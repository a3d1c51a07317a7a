"""Token counts of whole documents under a unigram vocabulary."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import LongType, StructField, StructType

from aisle.llm import lattice
from aisle.llm.spans import Spans, slices, texts_of


def count_tokens(df: DataFrame, path: str, key: str = "doc_id", text: str = "text",
                 slice_bytes: int = 3_000_000) -> DataFrame:
    """Tokens of every whole text: doc_id, n_pretokens, n_tokens.

    Pre-tokens are the words between blanks (space and 0x09-0x0D), each opening
    with the vocabulary's word mark. A pre-token has as many tokens as its best
    segmentation into pieces. Every slice of a task's documents puts its
    distinct pre-tokens in a trie, which scores each shared prefix once and
    stores the count at the pre-token's node; documents add up these counts.
    Null and empty texts have none. A row that repeats is counted each time.
    """
    schema = StructType([StructField("doc_id", df.schema[key].dataType), StructField("n_pretokens", LongType()),
                         StructField("n_tokens", LongType())])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = lattice.pieces_of(path)
        for batch in batches:
            texts = texts_of(batch.column(1))
            words, tokens = np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64)
            for low, high in slices([len(t) for t in texts], slice_bytes):
                spans = Spans(texts[low:high])
                starts, ends, doc = spans.words()
                _, first, which = np.unique(spans.hashes(starts, ends), return_index=True, return_inverse=True)
                _, counts = lattice.forward(pieces, spans, starts[first], ends[first], marginal=False)
                words[low:high] = np.bincount(doc, minlength=high - low)
                tokens[low:high] = np.bincount(doc, counts[which], minlength=high - low)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(words, pa.int64()), pa.array(tokens, pa.int64())], schema=arrow)

    return df.select(F.col(key), F.col(text)).mapInArrow(run, schema)
