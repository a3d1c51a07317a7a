import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from aisle.llm import sharding


def test_adding_a_shard_moves_rows_only_into_it(documents):
    rows = sharding.shard_documents(documents, 24).collect()
    assert len(rows) == documents.count()
    moved = [r for r in rows if r.shard != r.grown_shard]
    assert moved and {r.grown_shard for r in moved} == {24}
    after = {r.doc_id: r.shard for r in sharding.shard_documents(documents, 25).collect()}
    assert after == {r.doc_id: r.grown_shard for r in rows}


def test_slots_sizes_and_checksums(odd, nothing):
    rows = sharding.shard_documents(odd, 5).collect()
    texts = Counter((r.doc_id, len((r.text or "").encode()) + 8, zlib.crc32((r.text or "").encode()))
                    for r in odd.collect())
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in rows) == texts
    for shard in {r.shard for r in rows}:
        slots = sorted(r.slot for r in rows if r.shard == shard)
        assert slots == list(range(len(slots)))
    assert len({r.shard for r in rows if r.doc_id == 1}) == 1
    assert sharding.shard_documents(nothing, 5).count() == 0


def test_weights_set_the_shares(spark):
    rows = spark.range(20_000).select(sharding.rendezvous(F.col("id"), [1.0, 3.0, 0.0, 4.0]).alias("s"))
    share = {r.s: r["count"] / 20_000 for r in rows.groupBy("s").count().collect()}
    assert 2 not in share
    assert all(abs(share[i] - w / 8) < 0.02 for i, w in ((0, 1), (1, 3), (3, 4)))
    with pytest.raises(ValueError):
        sharding.rendezvous(F.col("id"), [0.0])


def test_written_shards_hold_every_row(odd, tmp_path):
    path = str(tmp_path / "shards")
    sharding.write_shards(odd, path, 3)
    back = odd.sparkSession.read.parquet(path)
    # The rows have a column "shard" of their own; it stays.
    assert set(back.columns) == {*odd.columns, "shard_"}
    assert sorted(map(str, back.select(*odd.columns).collect())) == sorted(map(str, odd.collect()))
    plain = str(tmp_path / "plain")
    sharding.write_shards(odd.drop("shard"), plain, 3)
    assert odd.sparkSession.read.parquet(plain).where("shard BETWEEN 0 AND 2").count() == odd.count()
