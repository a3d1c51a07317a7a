import numpy as np
import pyarrow as pa

from aisle.llm import media


def every_offset(mine, theirs, least=8):
    """Smallest share of wrong bits over all offsets, and that offset."""
    (at, a, _), (to, b, _) = mine, theirs
    best = (1.0, 0)
    for offset in range(-int(at.max()), int(to.max()) + 1):
        _, x, y = np.intersect1d(at + offset, to, return_indices=True)
        if len(x) >= least:
            best = min(best, (sum(int(v).bit_count() for v in a[x] ^ b[y]) / 32 / len(x), offset))
    return best


def near(spark, frame, queries):
    """Matched pairs of ids with offset and bit errors, own class included."""
    classes, members = media.sounds(media.fingerprints(frame))
    links = media.align(queries, classes, members)
    who = {}
    for r in members.collect():
        who.setdefault(r["class"], []).append((r.id, r.start))
    asked = {r.id for r in queries.collect()}
    pairs = {(q, i): (0, 0.0, t - s) for w in who.values() for q, s in w for i, t in w if q != i and q in asked}
    for r in links.collect():
        for q, s in who[r.query]:
            for i, t in who[r["class"]]:
                if q in asked:
                    pairs[q, i] = (r.matches, r.bit_error, r.offset + t - s)
    summary = media.summary(queries, classes, members, links).collect()
    return pairs, {r.query: r for r in summary}


def test_area_sums_and_silence():
    frames, values, _ = media.fingerprint(np.zeros(8_000))
    assert not len(frames) and not len(values)
    tone = np.sin(2 * np.pi * 440 * np.arange(8_000) / media.RATE) * 9_000
    image = media.chroma(tone)
    assert (image.argmax(axis=1) == 0).all() and np.allclose(np.linalg.norm(image, axis=1), 1)
    frames, values, weak = media.fingerprint(tone)
    assert len(set(values.tolist())) <= 4 and values.max() < 1 << 32
    assert all(len({w & 31, w >> 5 & 31, w >> 10}) == 3 and w < 1 << 15 for w in weak.tolist())


def noisy(sounds, start, quiet, noise, draw):
    sound = sounds[start] + draw.normal(0, noise, len(sounds[start]))
    return np.concatenate([np.zeros(quiet), sound]).clip(-32_768, 32_767).astype("<i2")


def test_matches_equal_a_search_of_all_offsets(spark, folder):
    vectors = spark.read.parquet(f"{folder}/embeddings.parquet").limit(30)
    sounds = {r.vec_id: np.frombuffer(r.pcm, "<i2") for r in media.recordings(vectors).collect()}
    draw, originals = np.random.default_rng(1), sorted(sounds)
    for n, start in enumerate(originals):
        for k, noise in enumerate((150, 2_000, 4_000, 5_000)):
            sounds[10_000 * (k + 1) + n] = noisy(sounds, start, n % 7 * media._HOP, noise, draw)
    frame = spark.createDataFrame([(int(i), x.tobytes()) for i, x in sounds.items()], "vec_id long, pcm binary")
    queries = spark.createDataFrame([(int(i),) for i in originals], "id long")
    pairs, rows = near(spark, frame.repartition(5), queries)
    prints = {i: media.fingerprint(x) for i, x in sounds.items()}
    copies = [(start, 10_000 * (k + 1) + n) for n, start in enumerate(originals) for k in range(4)]
    right = {p: every_offset(prints[p[0]], prints[p[1]]) for p in copies}
    wanted = [p for p in copies if right[p][0] <= 0.1]
    assert len(wanted) > 100 and max(right[p][0] for p in wanted) > 0.07
    found = [p for p in wanted if p in pairs]
    assert len(found) >= 0.98 * len(wanted)
    assert sum(abs(pairs[p][1] - right[p][0]) < 1e-12 and pairs[p][2] == right[p][1] for p in found) >= 0.95 * len(found)
    other = [p for p in pairs if p not in right]
    assert all(every_offset(prints[q], prints[i])[0] <= 0.25 for q, i in other)
    assert set(rows) == set(originals)
    for q in originals:
        mine = {p[1]: v for p, v in pairs.items() if p[0] == q}
        assert rows[q].n_links == len(mine) and rows[q].bit_error == min(v[1] for v in mine.values())
        assert mine[rows[q].id][1:] == (rows[q].bit_error, rows[q].offset)


def test_copies_are_one_class_and_repeated_ids_stay(spark, folder):
    vectors = spark.read.parquet(f"{folder}/embeddings.parquet").limit(3)
    a, b, c = (np.frombuffer(r.pcm, "<i2") for r in media.recordings(vectors).collect())
    loud = lambda x: np.concatenate([np.zeros(4_096, "<i2"), x]).tobytes()
    rows = [(i, loud(a)) for i in range(1, 41)] + [(50, bytes(512) + loud(a)), (60, loud(b)), (60, loud(a)), (60, loud(a)), (70, loud(c))]
    queries = spark.createDataFrame([(1,), (2,), (50,), (60,), (70,), (77_777,), (None,), (1,)], "id long")
    frame = spark.createDataFrame(rows, "vec_id long, pcm binary").repartition(4)
    pairs, out = near(spark, frame, queries)
    assert {q: (r.n_links, r.id) for q, r in out.items()} == {
        1: (41, 2), 2: (41, 1), 50: (41, 1), 60: (41, 1), 70: (0, None), 77_777: (0, None)}
    assert (out[1].bit_error, out[1].offset, out[50].offset) == (0, 0, -1) and out[1].overlap == out[1].matches
    classes, members = media.sounds(media.fingerprints(frame))
    assert classes.count() == 3 and members.count() == 44


def test_few_recordings_go_to_python_at_once(spark):
    """Each print made here is the number of rows that came to Python together."""
    setting = "spark.sql.execution.arrow.maxRecordsPerBatch"
    own = spark.conf.get(setting)

    def run(batches):
        for b in batches:
            lists = [pa.array([[v]] * b.num_rows, t) for v, t in (
                (0, pa.list_(pa.int32())), (b.num_rows, pa.list_(pa.int64())), (0, pa.list_(pa.int32())))]
            yield pa.RecordBatch.from_arrays([b.column(0), *lists], names=["id", "frames", "prints", "weak"])

    prints = spark.range(0, 100, 1, 1).mapInArrow(run, "id long, frames array<int>, prints array<long>, weak array<int>")
    classes, members = media.sounds(prints)
    assert max(r.prints[0] for r in classes.collect()) <= 16 and members.count() == 100
    assert spark.conf.get(setting) == own


def test_odd_recordings(spark):
    rows = [(1, None), (2, b""), (3, b"\x01"), (4, bytes(9_000)), (None, bytes(10)), (1, None)]
    frame = spark.createDataFrame(rows, "vec_id long, pcm binary")
    prints = media.fingerprints(frame)
    classes, members = media.sounds(prints)
    links = media.align(prints, classes, members)
    assert (prints.count(), classes.count(), members.count(), links.count()) == (6, 0, 0, 0)
    assert sorted((r.query, r.n_links, r.id) for r in media.summary(prints, classes, members, links).collect()) == [
        (i, 0, None) for i in (1, 2, 3, 4)]
    vectors = spark.createDataFrame([(1, None), (2, []), (3, [1.0, None]), (4, [float("nan")]), (5, [0.0] * 64), (None, [1.0, 2.0])],
                                    "vec_id long, embedding array<double>")
    assert {r.vec_id: r.pcm is None for r in media.recordings(vectors).collect()} == {
        1: True, 2: True, 3: True, 4: True, 5: False, None: False}
    assert media.recordings(vectors.limit(0)).count() == 0
