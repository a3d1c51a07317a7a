"""Document probabilities from a lattice of vocabulary pieces and words counted in the corpus."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import BinaryType, BooleanType, DoubleType, LongType, StructField, StructType

from aisle.llm import lattice
from aisle.llm.spans import Spans, slices, texts_of
from aisle.session import scratch_path

_WORDS = StructType([*[StructField(c, LongType()) for c in ("block", "word", "count")],
                     StructField("spelt", BinaryType())])
_USES = StructType([StructField("piece", LongType()), StructField("uses", DoubleType())])


def held_out(key, folds: int, remainder: int):
    """Whether crc32 of the key as text leaves the remainder; a null key counts as an empty text."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % folds == remainder


def _block_words(slice_bytes: int):
    """Distinct words (hashes) of a block with their counts in its training documents, and how they are spelt."""
    schema = to_arrow_schema(_WORDS)

    def run(table: pa.Table) -> pa.Table:
        block, training = table.column("block")[0].as_py(), ~table.column("held_out").to_numpy()
        texts = texts_of(table.column("text").combine_chunks())
        seen, counts, spelt = [np.zeros(0, np.uint64)], [np.zeros(0)], []
        for low, high in slices([len(t) for t in texts], slice_bytes):
            spans = Spans(texts[low:high], lower=True)
            starts, ends, doc = spans.words()
            words, first, which = np.unique(spans.hashes(starts, ends), return_index=True, return_inverse=True)
            seen.append(words)
            counts.append(np.bincount(which, training[low:high][doc], minlength=len(words)))
            spelt += [spans.bytes[starts[i] : ends[i]].tobytes() for i in first]
        words, first, which = np.unique(np.concatenate(seen), return_index=True, return_inverse=True)
        total = np.bincount(which, np.concatenate(counts), minlength=len(words)).astype(np.int64)
        return pa.Table.from_arrays([
            pa.array([block] * len(words), pa.int64()), pa.array(words.view(np.int64)), pa.array(total),
            pa.array([spelt[i] for i in first], pa.binary())], schema=schema)

    return run


def _piece_uses(path: str, slice_bytes: int):
    """Expected uses of pieces by distinct words, each word once: the next unknown word is more like a rare one."""
    schema = to_arrow_schema(_USES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = lattice.pieces_of(path)
        uses = np.zeros(len(pieces))
        for batch in batches:
            words = batch.column(0).to_pylist()
            for low, high in slices([len(w) for w in words], slice_bytes):
                spans = Spans(words[low:high])
                lattice.forward(pieces, spans, spans.starts, spans.ends - 1, True, uses)
        used = np.flatnonzero(uses)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(uses[used])], schema=schema)

    return run


def _earlier(doc: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each token: how many tokens, and how many equal ones, come before it in its document."""
    n = len(doc)
    place = np.arange(n)
    starts = np.searchsorted(doc, doc, side="left")
    order = np.lexsort((place, words, doc))
    first = np.ones(n, bool)
    first[1:] = (words[order][1:] != words[order][:-1]) | (doc[order][1:] != doc[order][:-1])
    run = place - np.maximum.accumulate(np.where(first, place, 0))
    same = np.empty(n)
    same[order] = run
    return place - starts, same


def _scores(path: str, uses: np.ndarray, stats: tuple[int, int, int], memory: float, slice_bytes: int,
            schema: pa.Schema):
    """Score the documents of a block against the corpus counts of its words."""
    tokens, types, texts_seen = stats
    floor = tokens + types

    def run(docs: pa.Table, words: pa.Table) -> pa.Table:
        pieces = lattice.pieces_of(path).learned(uses)
        keys = words.column("word").to_numpy().view(np.uint64)
        order = np.argsort(keys)
        keys, total = keys[order], words.column("total").to_numpy()[order].astype(float)
        texts = texts_of(docs.column("text").combine_chunks())
        n = len(texts)
        n_tokens, known, base, score = np.ones(n, np.int64), np.zeros(n, np.int64), np.zeros(n), np.zeros(n)
        end = math.log(texts_seen / floor) if texts_seen else pieces.end
        for low, high in slices([len(t) for t in texts], slice_bytes):
            m = high - low
            spans = Spans(texts[low:high], lower=True)
            starts, ends, doc = spans.words()
            distinct, first, which = np.unique(
                spans.hashes(starts, ends), return_index=True, return_inverse=True)
            count = total[np.searchsorted(keys, distinct)] if len(distinct) else np.zeros(0)
            by_pieces, _ = lattice.forward(pieces, spans, starts[first], ends[first], marginal=True)
            # Arcs of a word: itself, as often as the corpus has it, and all its segmentations.
            if floor:
                with np.errstate(divide="ignore"):
                    whole = np.log(count)
                arcs = np.logaddexp(whole, math.log(types) + by_pieces) - math.log(floor)
            else:
                arcs = by_pieces + math.log1p(-math.exp(end))
            before, same = _earlier(doc, which)
            token = np.log((memory * np.exp(arcs[which]) + same) / (memory + before))
            # Rare words may underflow; what is left of them is the logarithm itself.
            token = np.where((same == 0), math.log(memory) + arcs[which] - np.log(memory + before), token)
            size = np.bincount(doc, minlength=m)
            n_tokens[low:high] = size + 1
            known[low:high] = np.bincount(doc, count[which] > 0, minlength=m) + (texts_seen > 0)
            base[low:high] = np.bincount(doc, np.log10(count + 1)[which], minlength=m) + math.log10(texts_seen + 1)
            score[low:high] = (np.bincount(doc, token, minlength=m) + math.log(memory) + end
                               - np.log(memory + size)) / math.log(10)
        base -= n_tokens * math.log10(tokens + types + 1)
        return pa.Table.from_arrays(
            [docs.column("doc_id").combine_chunks(), docs.column("held_out").combine_chunks(), pa.array(n_tokens),
             pa.array(known), pa.array(np.full(n, tokens)), pa.array(base), pa.array(score)], schema=schema)

    return run


def score_documents(df: DataFrame, path: str, key: str = "doc_id", text: str = "text", folds: int = 7,
                    remainder: int = 2, memory: float = 1_000.0, block_bytes: int = 8_000_000,
                    slice_bytes: int = 1_500_000) -> DataFrame:
    """Probability of each whole text: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    A-Z count as lower case; tokens are the words between blanks and one end. A
    text is a lattice: every word can be spelt by any sequence of pieces of the
    existing vocabulary, weighted by its scores and by the expected use of the
    pieces in the training words under these scores (one step of expectation
    and maximisation), or be taken whole, weighted by its count in the training
    documents; and it can repeat an earlier word of its own text, weighted by
    ``memory``. The forward recursion in log space adds
    up all paths. Word boundaries are the only nodes that all paths share, so a
    text's value is the sum of its words' values. The weights make one
    distribution over texts: a word has (count + types * P(pieces)) / (tokens +
    types), mixed with the text's own earlier words as in an urn that starts
    with ``memory`` balls. Training documents are those outside the held-out
    fold. ``base_score`` is the add-one unigram score.

    Documents are dealt into blocks of some ``block_bytes`` by their key and
    text, so that many rows without a key, or of one key, are spread as well;
    they are worked on in slices of ``slice_bytes``. Each block gives its distinct words
    once; counts are summed over the blocks, and go back to the blocks that hold
    the word. So a frequent word has one row a block, however often it occurs.
    Piece uses come from the summed words: each distinct training word of the
    corpus counts once, so neither blocks nor slices change a weight. Null and empty texts are the end alone, rows
    that repeat are scored (and counted) each time, and without training
    documents the pieces decide alone.
    """
    spark = df.sparkSession
    body = F.coalesce(F.col(text), F.lit(""))
    size = df.agg(F.sum(F.octet_length(body))).first()[0] or 0
    blocks = max(1, -(-size // block_bytes))
    docs = df.select(
        F.col(key).alias("doc_id"), held_out(F.col(key), folds, remainder).alias("held_out"), body.alias("text"),
        F.pmod(F.xxhash64(F.col(key), body), F.lit(blocks)).alias("block"))
    found = docs.groupBy("block").applyInArrow(_block_words(slice_bytes), _WORDS)
    same = Window.partitionBy("word")
    totals = found.select(
        "block", "word", F.sum("count").over(same).alias("total"),
        (F.row_number().over(same.orderBy("block")) == 1).alias("first"), "spelt"
    ).withColumn("spelt", F.when(F.expr("first AND total > 0"), F.col("spelt")))
    where = scratch_path(spark, "words")
    totals.write.parquet(where)
    totals = spark.read.schema(totals.schema).parquet(where)
    sums = totals.where("first AND total > 0").agg(F.sum("total"), F.count("*")).first()
    uses = np.zeros(len(lattice.pieces_of(path)))
    spelt = totals.where("first AND total > 0").select("spelt")
    for r in spelt.mapInArrow(_piece_uses(path, slice_bytes), _USES).groupBy("piece").agg(
            F.sum("uses").alias("uses")).collect():
        uses[r.piece] = r.uses
    training = df.where(~held_out(F.col(key), folds, remainder)).count()
    stats = ((sums[0] or 0) + training, sums[1] + (training > 0), training)
    schema = StructType([
        docs.schema["doc_id"], StructField("held_out", BooleanType()), StructField("n_tokens", LongType()),
        StructField("n_known", LongType()), StructField("train_tokens", LongType()),
        StructField("base_score", DoubleType()), StructField("score", DoubleType())])
    run = _scores(path, uses, stats, memory, slice_bytes, to_arrow_schema(schema))
    words = totals.select("block", "word", "total")
    return docs.groupBy("block").cogroup(words.groupBy("block")).applyInArrow(run, schema)
