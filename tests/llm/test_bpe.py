import base64
import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from aisle.llm import bpe

PATH, PATTERN = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


@pytest.fixture(scope="module")
def library():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def pairs(rows, library):
    return sorted((str(i), library.encode_ordinary(t or "")) for i, t in rows)


def found(frame):
    return sorted((str(r.doc_id), np.frombuffer(r.ids, "<u4").tolist()) for r in frame.collect())


@pytest.mark.parametrize("chunk,overlap", [(32_768, 2_048), (300, 40), (64, 17)])
def test_ids_equal_the_library_for_any_chunk_size(documents, library, chunk, overlap):
    some = documents.where("doc_id < 60").select("doc_id", "text")
    out = bpe.encode(some, PATH, PATTERN, chunk=chunk, overlap=overlap)
    assert found(out) == pairs([tuple(r) for r in some.collect()], library)


def test_blanks_and_long_pre_tokens_across_chunks(spark, library):
    draw = random.Random(3)
    texts = ["".join(draw.choice([" ", "  ", "\n", "'re", "'", "ll", "word", "ê", "日本", "12", "!!", "\t \t"])
                     for _ in range(draw.randrange(600))) for _ in range(150)]
    texts += [" " * 500 + "x", "a" * 999 + " b c " * 40, "x" * 90 + " y'll " * 30 + " " * 200 + "z" * 300]
    rows = list(enumerate(texts))
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    assert found(bpe.encode(frame, PATH, PATTERN, chunk=64, overlap=20)) == pairs(rows, library)


def test_odd_rows(odd, nothing, library):
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    encoded = bpe.encode(odd, PATH, PATTERN)
    assert found(encoded) == pairs(rows, library)
    assert bpe.encode(nothing, PATH, PATTERN).count() == 0


def test_digests_and_round_trip(odd, library):
    encoded = bpe.encode(odd, PATH, PATTERN)
    expected = sorted(
        (str(r.doc_id), len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(),
         hashlib.sha256((r.text or "").encode()).hexdigest())
        for r in odd.collect() for ids in [library.encode_ordinary(r.text or "")])
    assert sorted((str(r[0]), *r[1:]) for r in bpe.digests(odd, PATH, PATTERN, chunk=2_000, overlap=100).collect()) == expected
    decoded = sorted((str(r.doc_id), bytes(r.decoded)) for r in bpe.decode(encoded, PATH, PATTERN).collect())
    assert decoded == sorted((str(r.doc_id), (r.text or "").encode()) for r in odd.collect())
    gaps = odd.sparkSession.createDataFrame([(1, None), (2, b"")], "doc_id long, ids binary")
    assert sorted(map(tuple, bpe.decode(gaps, PATH, PATTERN).collect())) == [(1, None), (2, b"")]
