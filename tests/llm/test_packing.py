import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from aisle.llm import packing

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    tokenizer = Tokenizer.from_file(PATH)
    tokenizer.encode_special_tokens = True
    return lambda texts: [e.ids for e in tokenizer.encode_batch(texts, add_special_tokens=False)]


def check_sequences(rows, capacity):
    by = defaultdict(list)
    for r in rows:
        by[r.sequence_id].append((r.offset, r.length))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by)


def expected_pieces(docs, library, capacity):
    out = []
    for (doc, text), ids in zip(docs, library([t or "" for _, t in docs]), strict=True):
        ids = np.array([*ids, 1], "<u4")
        out += [(str(doc), k, k * capacity, len(part), zlib.crc32(part.tobytes()))
                for k, part in enumerate(ids[i : i + capacity] for i in range(0, len(ids), capacity))]
    return sorted(out)


def test_ids_equal_the_library(library):
    draw = random.Random(1)
    ranges = [(32, 0x250), (0x300, 0x400), (0x1E00, 0x2100), (0x3000, 0xD000), (0x1F300, 0x1F700)]
    texts = ["".join(chr(draw.randrange(*draw.choice(ranges))) if draw.random() < 0.8 else draw.choice(" \t\n'\x1c\x85")
                     for _ in range(200)) for _ in range(300)]
    texts += ["it's I'LL 'S ΣΑΣ İ ẞ ŉ", "\x1c", "", "<|endoftext|> x"]
    ours = packing.WordBpe(PATH)
    assert [np.frombuffer(x, "<u4").tolist() for x in ours.ids(texts)] == library(texts)
    small = packing.WordBpe(PATH, memo=10)
    assert [y for t in texts for y in small.ids([t])] == ours.ids(texts)


def test_documents(documents, library):
    rows = packing.pack_documents(documents, PATH).collect()
    docs = [(r.doc_id, r.text) for r in documents.collect()]
    assert sorted((str(r.doc_id), r.piece, r.start, r.length, r.ids_crc32) for r in rows) == expected_pieces(
        docs, library, 4096)
    used = check_sequences(rows, 4096)
    assert used <= 1.05 * sum(r.length for r in rows) / 4096 + 2


def test_odd_rows(odd, nothing, library):
    rows = packing.pack_documents(odd, PATH, capacity=100).collect()
    docs = [(r.doc_id, r.text) for r in odd.collect()]
    assert sorted((str(r.doc_id), r.piece, r.start, r.length, r.ids_crc32) for r in rows) == expected_pieces(
        docs, library, 100)
    check_sequences(rows, 100)
    assert packing.pack_documents(nothing, PATH).count() == 0


def test_rounds_merge_the_open_bins_of_all_tasks(spark):
    pieces = spark.range(5_000).select("id", (F.pmod(F.xxhash64("id"), F.lit(90)) + 1).alias("length"))
    rows = packing.best_fit(pieces, 100, open_bins=8, rows_per_task=300).withColumnRenamed("id", "doc").collect()
    assert len(rows) == 5_000 and len({r.doc for r in rows}) == 5_000
    assert check_sequences(rows, 100) <= 1.1 * sum(r.length for r in rows) / 100


def test_best_fit_takes_the_fullest_bin_that_fits_and_closes_the_fullest():
    bins = packing.BestFit(10, 2)
    assert [bins.add(n) for n in (6, 7, 3)] == [(0, 0), (1, 0), (1, 7)]
    assert [bins.add(n) for n in (5, 9, 4)] == [(2, 0), (3, 0), (0, 6)]
    assert sorted(bins.left()) == [(2, 5)]
