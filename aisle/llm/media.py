"""Media columns: chroma fingerprints of recordings, and their alignment."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, LongType, StructField, StructType

from aisle.session import batches_of, stored

RATE = 4_000  # samples a second
_FRAME, _HOP = 1_024, 256
_SPAN = 8  # frames that a filter looks at
_CLASSES = 12
_WEAK = 3  # least certain bits kept of a print
_GAP = 8  # frames between the two prints of a landmark
_AT_ONCE = 16  # recordings in memory together, some 1 MB of samples

#: Filters over (frames, pitch classes): kind, first class, classes; kinds compare halves of their area.
_FILTERS = [(kind, low, high) for kind, low, high in (
    ("level", 0, 4), ("level", 4, 4), ("level", 8, 4), ("time", 0, 6), ("time", 6, 6), ("time", 0, 12),
    ("pitch", 0, 4), ("pitch", 3, 4), ("pitch", 6, 4), ("pitch", 8, 4), ("pitch", 0, 12), ("cross", 0, 6),
    ("cross", 6, 6), ("cross", 0, 12), ("time", 3, 6), ("pitch", 2, 8))]


def _pitch_class() -> np.ndarray:
    """Pitch class of every FFT bin between 80 and 1,800 Hz, -1 outside."""
    hertz = np.fft.rfftfreq(_FRAME, 1 / RATE)
    out = np.full(len(hertz), -1)
    heard = (hertz >= 80) & (hertz <= 1_800)
    out[heard] = np.round(12 * np.log2(hertz[heard] / 440)).astype(int) % _CLASSES
    return out


def chroma(samples: np.ndarray) -> np.ndarray:
    """Energy by frame and pitch class, each frame scaled to length 1; silent frames are zero."""
    if len(samples) < _FRAME:
        return np.zeros((0, _CLASSES))
    frames = np.lib.stride_tricks.sliding_window_view(samples.astype(np.float32), _FRAME)[::_HOP]
    power = np.abs(np.fft.rfft(frames * np.hanning(_FRAME).astype(np.float32), axis=1)) ** 2
    classes = _pitch_class()
    table = np.zeros((len(classes), _CLASSES))
    table[np.arange(len(classes))[classes >= 0], classes[classes >= 0]] = 1
    energy = power @ table
    length = np.linalg.norm(energy, axis=1, keepdims=True)
    return np.where(length > 1.0, energy / np.maximum(length, 1.0), 0.0)


def fingerprint(samples: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Frame numbers, packed 32-bit values of a recording, and the places of their least certain bits.

    An integral image of the chroma frames gives each filter's areas with four
    reads. Every filter is quantised to two bits (a Gray code), sixteen filters
    fill an integer. The filters nearest to one of their thresholds are the least
    certain; the bit that changes there is named with five bits, the first lowest.
    Values over silence are left out.
    """
    image = chroma(samples)
    n = len(image) - _SPAN + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    total = np.zeros((len(image) + 1, _CLASSES + 1))
    total[1:, 1:] = image.cumsum(0).cumsum(1)
    at = np.arange(n)

    def area(t0: int, t1: int, c0: int, c1: int) -> np.ndarray:
        return total[at + t1, c1] - total[at + t0, c1] - total[at + t1, c0] + total[at + t0, c0]

    half, values = _SPAN // 2, np.zeros(n, np.int64)
    slack, place = np.empty((n, len(_FILTERS))), np.empty((n, len(_FILTERS)), np.int64)
    for i, (kind, low, size) in enumerate(_FILTERS):
        high, mid = low + size, low + size // 2
        if kind == "level":
            x = np.log((1 + area(0, _SPAN, low, high)) / (1 + area(0, _SPAN, 0, _CLASSES) * size / _CLASSES))
        elif kind == "time":
            x = np.log((1 + area(0, half, low, high)) / (1 + area(half, _SPAN, low, high)))
        elif kind == "pitch":
            x = np.log((1 + area(0, _SPAN, low, mid)) / (1 + area(0, _SPAN, mid, high)))
        else:
            x = np.log((1 + area(0, half, low, mid) + area(half, _SPAN, mid, high))
                       / (1 + area(0, half, mid, high) + area(half, _SPAN, low, mid)))
        level = (x > -0.25).astype(np.int64) + (x > 0) + (x > 0.25)
        values = (values << 2) | np.array([0, 1, 3, 2])[level]
        away = np.abs(x[:, None] - np.array([-0.25, 0, 0.25]))
        slack[:, i] = away.min(1)
        place[:, i] = 2 * (len(_FILTERS) - 1 - i) + np.array([0, 1, 0])[away.argmin(1)]
    nearest = np.take_along_axis(place, slack.argsort(1, kind="stable")[:, :_WEAK], 1)
    weak = (nearest << (5 * np.arange(_WEAK))).sum(1)
    loud = area(0, _SPAN, 0, _CLASSES) > 0.5
    return at[loud], values[loud], weak[loud]


def recordings(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """A tune for each vector: vec_id, pcm (16-bit samples), silent before it starts for a while that differs by row.

    Each number is a note of an eighth of a second; its place among 24 semitones
    follows the normal distribution of the vector's own numbers. So near copies
    of a vector sound alike, at other offsets. Null, empty or non-finite vectors
    have no sound (null pcm).
    """
    schema = StructType([StructField("vec_id", LongType()), StructField("pcm", BinaryType())])
    arrow = to_arrow_schema(schema)
    time = np.arange(RATE // 8) / RATE
    fade = np.minimum(1, np.minimum(np.arange(len(time)), np.arange(len(time))[::-1]) / 40)
    notes = np.stack([np.sin(2 * np.pi * 220 * 2 ** (k / 12) * time) * fade for k in range(24)])

    def sound(key, numbers):
        if not numbers or any(x is None for x in numbers) or not np.isfinite(numbers).all():
            return None
        x = np.array(numbers, float)
        x = (x - x.mean()) / (x.std() or 1)
        pitch = np.clip(np.floor((x + 2.4) * 5), 0, 23).astype(int)
        quiet = np.zeros((int(key or 0) % 5) * _HOP * 3)
        return np.concatenate([quiet, notes[pitch].ravel() * 9_000]).astype("<i2").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, _AT_ONCE):
                keys = batch.column(0)[low : low + _AT_ONCE]
                pcm = [sound(k, v) for k, v in zip(
                    keys.to_pylist(), batch.column(1)[low : low + _AT_ONCE].to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([keys, pa.array(pcm, pa.binary())], schema=arrow)

    return vectors.select(F.col(key).cast("bigint"), F.col(vector).cast("array<double>")).mapInArrow(run, schema)


def fingerprints(df: DataFrame, key: str = "vec_id", pcm: str = "pcm") -> DataFrame:
    """Fingerprint of each recording: id, frames, prints, weak (arrays of equal length).

    A null, empty or too short recording, and one of silence, has empty arrays.
    """
    schema = StructType([StructField("id", LongType()), StructField("frames", ArrayType(IntegerType())),
                         StructField("prints", ArrayType(LongType())), StructField("weak", ArrayType(IntegerType()))])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [fingerprint(np.frombuffer(x[: len(x) // 2 * 2], "<i2"))
                    for x in ((p.as_py() or b"") for p in batch.column(1))]
            yield pa.RecordBatch.from_arrays([
                batch.column(0), pa.array([a for a, _, _ in rows], pa.list_(pa.int32())),
                pa.array([b for _, b, _ in rows], pa.list_(pa.int64())),
                pa.array([c for _, _, c in rows], pa.list_(pa.int32()))], schema=arrow)

    return df.select(F.col(key).cast("bigint"), F.col(pcm)).mapInArrow(run, schema)


def sounds(prints: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Classes of recordings that sound the same from their first sound on, and who is in them.

    The classes have class (any distinct numbers), lead (smallest id), frames
    (counted from the first print), prints and weak; the members have class,
    lead, id and start (the first print's frame; the smallest, if a class holds
    an id more than once). Each recording of a repeated id is a member of its
    own class. Recordings without an id or without prints are in none. The
    prints and both frames are written to the shared folder. While the prints
    are made, few recordings at once go to Python: a session's batch of 10,000
    would hold hundreds of MB of samples, in the JVM and in each worker.
    """
    first = F.col("frames")[0]
    heard = prints.where("id IS NOT NULL AND size(prints) > 0").select(
        "id", first.alias("start"), F.transform("frames", lambda f: f - first).alias("frames"), "prints", "weak")
    text = F.concat_ws(",", F.col("frames").cast("array<string>"), F.col("prints").cast("array<string>"))
    with batches_of(prints.sparkSession, _AT_ONCE):
        heard = stored(heard.withColumn("sound", F.sha2(text, 256)), "prints")
    one = heard.groupBy("sound").agg(F.min(F.struct("id", "frames", "prints", "weak")).alias("one"))
    classes = stored(one.select(
        "sound", F.monotonically_increasing_id().alias("class"), F.col("one.id").alias("lead"), "one.frames",
        "one.prints", "one.weak"), "sounds")
    members = heard.groupBy("sound", "id").agg(F.min("start").alias("start")).join(
        classes.select("sound", "class", "lead"), "sound").select("class", "lead", "id", "start")
    return classes.drop("sound"), stored(members, "members")


def landmarks(classes: DataFrame, variants: bool = False) -> DataFrame:
    """Pairs of prints ``_GAP`` frames apart as one number: class, key, frame (of the first print).

    With ``variants`` both prints also come with any of their least certain bits
    turned over, 64 keys a pair.
    """
    schema = StructType([StructField("class", LongType()), StructField("key", LongType()), StructField("frame", IntegerType())])
    arrow = to_arrow_schema(schema)
    turned = range(1 << _WEAK) if variants else range(1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (b.slice(low, _AT_ONCE) for b in batches for low in range(0, b.num_rows, _AT_ONCE)):
            for name, frames, prints, weak in zip(*(c.to_pylist() for c in part.columns), strict=True):
                at, value = np.array(frames, np.int64), np.array(prints, np.int64)
                bits = 1 << ((np.array(weak, np.int64)[:, None] >> (5 * np.arange(_WEAK))) & 31)
                later = np.searchsorted(at, at + _GAP)
                here = np.flatnonzero(at[np.minimum(later, len(at) - 1)] == at + _GAP)
                there = later[here]
                forms = [value ^ (bits * [n >> i & 1 for i in range(_WEAK)]).sum(1) for n in turned]
                for a in forms:
                    keys = [(a[here] << 32) | b[there] for b in forms]
                    yield pa.RecordBatch.from_arrays([
                        pa.array(np.full(len(here) * len(keys), name)), pa.array(np.concatenate(keys)),
                        pa.array(np.tile(at[here], len(keys)).astype(np.int32))], schema=arrow)

    return classes.select("class", "frames", "prints", "weak").mapInArrow(run, schema)


def align(
    queries: DataFrame, classes: DataFrame, members: DataFrame, least: int = 8, error: float = 0.25
) -> DataFrame:
    """Classes that match the class of a query: query, class, offset, matches, overlap, bit_error.

    ``queries`` has id; ``classes`` and ``members`` are those of ``sounds``.
    Equal landmarks vote for the difference of their frames, and those of a
    query vote with their least certain bits turned over too, so that a print
    with a few wrong bits is still found; the histogram's highest offset (of
    ties, the lowest) is the alignment. Bit errors are then counted over all
    frames that both have at that offset, ``least`` at fewest; pairs with a share
    of ``error`` or less are returned. A class is not matched with itself. Two
    prints together are rare, so unrelated recordings hardly meet in the join.
    """
    ids = queries.select(F.col("id").cast("bigint")).distinct()
    asked = classes.join(members.join(ids, "id", "left_semi").select("class").distinct(), "class", "left_semi")
    mine = landmarks(asked, variants=True).withColumnsRenamed({"class": "query", "frame": "mine"})
    votes = mine.join(landmarks(classes), "key").where("query <> class").groupBy(
        "query", "class", (F.col("frame") - F.col("mine")).alias("offset")).agg(F.count("*").alias("matches"))
    best = votes.groupBy("query", "class").agg(
        F.max(F.struct("matches", (-F.col("offset")).alias("low"))).alias("top")
    ).select("query", "class", (-F.col("top.low")).alias("offset"), F.col("top.matches").alias("matches"))
    lookup = F.map_from_arrays("frames", "prints")
    both = best.join(classes.select(F.col("class").alias("query"), F.col("frames").alias("mine"),
                                    F.col("prints").alias("own")), "query").join(
        classes.select("class", lookup.alias("theirs")), "class")
    bits = F.transform(
        F.filter(F.arrays_zip("mine", "own"), lambda x: F.map_contains_key("theirs", x["mine"] + F.col("offset"))),
        lambda x: F.bit_count(x["own"].bitwiseXOR(F.col("theirs")[x["mine"] + F.col("offset")])))
    scored = both.withColumn("bits", bits).select(
        "query", "class", "offset", "matches", F.size("bits").alias("overlap"),
        (F.aggregate("bits", F.lit(0), lambda s, x: s + x) / (32.0 * F.size("bits"))).alias("bit_error"))
    return scored.where((F.col("bit_error") <= error) & (F.col("overlap") >= least))


def summary(queries: DataFrame, classes: DataFrame, members: DataFrame, links: DataFrame) -> DataFrame:
    """One row per distinct query id: query, n_links (recordings it matches, 0 without one) and the nearest of them.

    A query matches the other members of its class and all members of the linked
    ones, but no recording of its own id. The nearest (id, offset, matches,
    overlap, bit_error; null without a match) has the fewest bit errors, then the
    most matches, then the smallest id; in its own class all prints match. The
    offset is in frames of the two recordings. Copies stay counts: a class adds
    its size and its two smallest ids.
    """
    asked = queries.where("id IS NOT NULL").select(F.col("id").cast("bigint").alias("query")).distinct()
    own = members.join(asked, F.col("id") == F.col("query"), "left_semi").select(
        F.col("id").alias("query"), F.col("class").alias("mine"), F.col("start").alias("begin"))
    place = F.struct("id", "start")
    sizes = members.groupBy("class").agg(
        F.count("*").alias("n"), F.min(place).alias("one"), F.min(F.when(F.col("id") > F.col("lead"), place)).alias("two"))
    same = classes.select(
        F.col("class").alias("mine"), "class", F.lit(0).alias("offset"), F.size("prints").cast("bigint").alias("matches"),
        F.size("prints").alias("overlap"), F.lit(0.0).alias("bit_error"))
    near = own.join(same, "mine").unionByName(own.join(links.withColumnRenamed("query", "mine"), "mine"))
    order = F.struct("bit_error", (-F.col("matches")).alias("votes"), "offset")
    near = near.groupBy("query", "class").agg(
        F.min_by(F.struct("begin", "offset", "matches", "overlap", "bit_error"), order).alias("best")
    ).select("query", "class", "best.*")
    also = own.select("query", F.col("mine").alias("class"), F.lit(1).alias("self"))
    met = near.join(sizes, "class").join(also, ["query", "class"], "left").withColumn(
        "n", F.col("n") - F.coalesce("self", F.lit(0))).where("n > 0").withColumn(
        "at", F.when(F.col("one.id") == F.col("query"), F.col("two")).otherwise(F.col("one")))
    found = met.select(
        "query", "n", F.col("at.id").alias("id"), (F.col("offset") + F.col("at.start") - F.col("begin")).alias("offset"),
        "matches", "overlap", "bit_error")
    order = F.struct("bit_error", (-F.col("matches")).alias("votes"), "id")
    best = found.groupBy("query").agg(
        F.sum("n").alias("n_links"), F.min_by(F.struct("id", "offset", "matches", "overlap", "bit_error"), order).alias("best"))
    return asked.join(best, "query", "left").select("query", F.coalesce("n_links", F.lit(0)).alias("n_links"), "best.*")
