"""Fuzzy brand matching and word counts over whole titles."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from aisle.functions import titles
from aisle.session import checkpointed, stored


def _piece(length: Column, number: Column, pieces: Column) -> tuple[Column, Column]:
    """Start and size of one of the equal pieces of a text of this length."""
    first = F.floor(length * number / pieces).cast("int")
    after = F.floor(length * (number + 1) / pieces).cast("int")
    return first + 1, after - first


def _moves(most: int) -> Column:
    """Places where an unchanged piece of a text some edits away can stand, for 0 to ``most`` edits.

    With ``gap`` the difference of the lengths, piece i can have moved by m only
    if i edits before it and ``edits - i`` edits after it can explain both m and
    the gap.
    """
    out = []
    for edits in range(most + 1):
        for gap in range(-edits, edits + 1):
            for number in range(edits + 1):
                low, high = max(-number, gap - (edits - number)), min(number, gap + (edits - number))
                out += [
                    F.struct(F.lit(edits).alias("edits"), F.lit(gap).alias("gap"), F.lit(number).alias("piece"),
                             F.lit(move).alias("move"))
                    for move in range(low, high + 1)
                ]
    return F.array(*out)


def _useful_edits(length: Column, most: int, accept: int | None) -> Column:
    """Edits that can still leave a similarity above ``accept``; insertions cost least."""
    out = F.lit(0)
    for edits in range(1, most + 1):
        fits = F.lit(True) if accept is None else F.round(200 * length / (2 * length + edits)) > accept
        out = F.when(fits & (length > edits), edits).otherwise(out)
    return out


def near_matches(
    left: DataFrame, right: DataFrame, a: str, b: str, edits: int = 2, accept: int | None = None
) -> DataFrame:
    """Rows of ``left`` with every distinct entry of ``right`` at most ``edits`` edits away, and their distance.

    With ``accept`` only matches of a higher similarity are wanted, so short
    entries need fewer edits. If two texts are e edits apart, one of e + 1
    pieces of the entry stands unchanged in the other text near its old place.
    An equi-join on (length, piece number, piece) therefore finds every
    candidate, and the edit distance decides. A pair that agrees on several
    pieces appears several times.
    """
    entries = right.select(b).distinct().where(F.length(b) > 0).select(b, F.length(b).alias("_len")).withColumn(
        "_edits", _useful_edits(F.col("_len"), edits, accept))
    pieces = entries.select(b, "_len", "_edits", F.explode(F.sequence(F.lit(0), F.col("_edits"))).alias("_piece"))
    keyed = pieces.select(
        b, "_len", "_piece",
        F.substr(F.col(b), *_piece(F.col("_len"), F.col("_piece"), F.col("_edits") + 1)).alias("_text"))
    # One row per entry length and move: at most 27 times the longest entry.
    spots = entries.select("_len", "_edits").distinct().select(
        "_len", "_edits", F.explode(_moves(edits)).alias("_m")).where("_m.edits = _edits")
    start, size = _piece(F.col("_len"), F.col("_m.piece"), F.col("_edits") + 1)
    spots = spots.select(
        (F.col("_len") + F.col("_m.gap")).alias("_size_a"), "_len", F.col("_m.piece").alias("_piece"),
        (start + F.col("_m.move")).alias("_at"), size.alias("_size")
    ).where((F.col("_at") >= 1) & (F.col("_at") + F.col("_size") - 1 <= F.col("_size_a")))
    probed = left.join(F.broadcast(spots), F.length(a) == F.col("_size_a")).select(
        *left.columns, "_len", "_piece", F.substr(F.col(a), F.col("_at"), F.col("_size")).alias("_text"))
    return probed.join(keyed, ["_len", "_piece", "_text"]).select(
        *left.columns, b, F.levenshtein(F.col(a), F.col(b), edits).alias("edits")).where("edits >= 0")


#: Places of the table of words; words that share one only let more runs through.
_SLOTS = 1 << 20


def _slot(word: Column) -> Column:
    return F.pmod(F.xxhash64(word), F.lit(_SLOTS)).cast("int")


def _word_costs(words: DataFrame, entries: DataFrame, entry: str, accept: int | None) -> DataFrame:
    """One row, costs: an array of ``_SLOTS`` numbers, each 1 + 4 * 2 + 16 * 3 for words of one hash.

    Number 1 is the fewest edits between such a word and any begin of an entry,
    number 2 to any end (0 to 2; 3: more), number 3 is 1 if a word is near a
    whole entry. To begins and ends of one or two letters a word of one or two
    letters counts one edit, if it is not found to need none, a word of three or four two.
    """
    size = F.length(entry)
    cuts = entries.where(size > 0).select(entry, F.explode(F.sequence(F.lit(1), size)).alias("_n"))
    first, last, whole = F.lit(3).alias("first"), F.lit(3).alias("last"), F.lit(0).alias("whole")
    begins = near_matches(words, cuts.select(F.substr(entry, F.lit(1), F.col("_n")).alias("_cut")), "word", "_cut")
    ends = near_matches(words, cuts.select(F.substr(entry, F.col("_n")).alias("_cut")), "word", "_cut")
    near = near_matches(words, entries.select(F.col(entry).alias("_cut")), "word", "_cut", accept=accept)
    short = F.when(F.length("word") <= 2, 1).otherwise(2)
    found = (
        begins.select("word", F.col("edits").alias("first"), last, whole)
        .unionByName(ends.select("word", first, F.col("edits").alias("last"), whole))
        .unionByName(near.select("word", first, last, F.lit(1).alias("whole")))
        .unionByName(words.where(F.length("word") <= 4).select("word", short.alias("first"), short.alias("last"), whole))
    )
    slots = found.groupBy(_slot(F.col("word")).alias("id")).agg(
        (F.min("first") + 4 * F.min("last") + 16 * F.max("whole")).cast("tinyint").alias("cost"))
    every = words.sparkSession.range(_SLOTS).join(slots, "id", "left")
    placed = F.sort_array(F.collect_list(F.struct("id", F.coalesce("cost", F.lit(15).cast("tinyint")).alias("cost"))))
    return every.agg(placed.alias("_all")).select(F.col("_all.cost").alias("costs"))


def title_ngrams(
    df: DataFrame, key: str, text: str, sizes: Sequence[int], entries: DataFrame, entry: str, accept: int | None = None
) -> DataFrame:
    """Distinct word runs of each title, without those that cannot be near an entry; stored.

    If a run is at most two edits from an entry, its first word is some edits
    from a begin of the entry and its last word from an end, two at most in sum.
    Each distinct word is compared with all begins and ends once; its fewest
    edits are kept by the word's hash in a table of fixed size, which every task
    reads. So few runs are listed, and no run is lost that ``near_matches`` finds with ``accept``.
    """
    bounds = entries.where(F.length(entry) > 0).agg(F.min(F.length(entry)), F.max(F.length(entry))).first()
    low, high = (bounds[0] or 0) - 2, (bounds[1] or 0) + 2
    tokens = df.select(key, titles.tokens_of(text).alias("_tokens"))
    words = stored(tokens.select(F.explode("_tokens").alias("word")).where(F.length("word") <= high).distinct(), "tokens")
    costs = stored(_word_costs(words, entries, entry, accept), "costs").scalar()
    names = [f"_w{k}" for k in range(max(sizes))]
    shifts = [F.slice("_tokens", k + 1, F.greatest(F.size("_tokens"), F.lit(1))).alias(n) for k, n in enumerate(names)]
    placed = tokens.select(key, F.inline(F.arrays_zip(*shifts)).alias(*names))
    cost = [F.get(costs, _slot(F.col(n))) for n in names]
    keeps = {}
    for n in sizes:
        run, end = F.concat_ws(" ", *names[:n]), cost[n - 1]
        edits = cost[0].bitwiseAND(F.lit(3)) + F.shiftright(end, 2).bitwiseAND(F.lit(3))
        fits = cost[0] >= 16 if n == 1 else (edits <= 2) & F.length(run).between(low, high)
        keeps[n] = F.when(F.col(names[n - 1]).isNotNull() & fits, run)
    runs = placed.where(F.coalesce(*keeps.values()).isNotNull()).select(
        key, F.explode(F.array(*keeps.values())).alias("ngram")).where("ngram IS NOT NULL")
    return stored(runs.distinct(), "runs")


def run_sizes(entries: DataFrame, entry: str) -> range:
    """Lengths of word runs that can match an entry: up to the words of the longest entry, two at least."""
    most = entries.agg(F.max(F.size(F.split(entry, " ")))).first()[0] or 0
    return range(1, max(2, most) + 1)


def _scored_runs(grams: DataFrame, entries: DataFrame, entry: str, accept: int) -> DataFrame:
    """Distinct runs with the entries whose similarity is above ``accept``: ngram, entry, ratio."""
    return near_matches(grams.select("ngram").distinct(), entries, "ngram", entry, accept=accept).select(
        "ngram", entry, titles.near_ratio(F.col("ngram"), F.col(entry), F.col("edits")).alias("ratio")
    ).where(F.col("ratio") > accept).distinct()


def fuzzy_brands(
    df: DataFrame, key: str, text: str, brands: DataFrame, brand: str, accept: int = 85
) -> DataFrame:
    """Brands whose best similarity to a word run of the title is the title's highest and above ``accept``.

    Runs have as many words as the longest brand at most. Each distinct run is
    matched once. The matches are stored, so Spark knows their size when they
    go back to the titles; few runs match, and then the titles stay in place.
    """
    grams = title_ngrams(df, key, text, run_sizes(brands, brand), brands, brand, accept)
    matches = stored(_scored_runs(grams, brands, brand, accept), "matches")
    scored = grams.join(matches, "ngram").groupBy(key, brand).agg(F.max("ratio").alias("ratio"))
    # A title has at most as many rows here as the dictionary has brands.
    best = F.max("ratio").over(Window.partitionBy(key))
    return scored.withColumn("_best", best).where("ratio = _best").select(key, brand, "ratio")


def main_brand(
    df: DataFrame, key: str, text: str, found: DataFrame, brand: str, families: DataFrame, family: str,
    accept: float = 90.0,
) -> DataFrame:
    """Final family of each title from the brands found in it; ``not-detected`` where there is none.

    One family is final at once. Of several, a family whose phrase stands in the
    title scores 100; any other scores the mean over its words of the best
    similarity to a title word, where a word more than two edits away from all
    of them counts 0. The highest scores above ``accept`` win. A family can only
    pass if each of its words scores ``100 - (100 - accept) * words`` at least, so
    lower matches are not looked for. Each distinct run is matched once.
    """
    named = checkpointed(found.join(families.select(brand, family), brand).select(key, family).distinct())
    counted = named.groupBy(key).agg(F.count(family).alias("_families"))
    single = named.join(counted.where("_families = 1"), key).select(key, family)
    several = named.join(counted.where("_families > 1"), key).select(key, family)
    parts = several.select(
        key, family, F.size(F.split(family, " ")).alias("_words"), F.explode(F.split(family, " ")).alias("_word"))
    # Stored, so that few keys go to the titles and the titles stay in place.
    open_titles = df.select(key, text).join(stored(counted.where("_families > 1").select(key), "open"), key, "left_semi")
    most = parts.agg(F.max("_words")).first()[0] or 1
    least = max(0, int(100 - (100 - accept) * most) - 1)
    # Runs are compared with the words of the families, and found again as whole families.
    wanted = parts.select("_word").union(several.select(family)).distinct()
    grams = title_ngrams(open_titles, key, text, run_sizes(families, family), wanted, "_word", least)
    matches = stored(_scored_runs(grams, parts.select("_word").distinct(), "_word", least), "words")
    per_title = grams.join(matches, "ngram").groupBy(key, "_word").agg(F.max("ratio").alias("ratio"))
    by_words = (
        parts.join(per_title, [key, "_word"], "left").groupBy(key, family)
        .agg((F.sum(F.coalesce("ratio", F.lit(0))) / F.max("_words")).alias("score"))
    )
    phrases = several.join(
        grams.withColumnRenamed("ngram", family), [key, family], "left_semi").withColumn("_phrase", F.lit(100.0))
    scored = by_words.join(phrases, [key, family], "left").select(
        key, family, F.coalesce("_phrase", "score").alias("score")).where(F.col("score") > accept)
    best = F.max("score").over(Window.partitionBy(key))
    chosen = scored.withColumn("_best", best).where("score = _best").select(key, family).unionByName(single)
    return (
        df.select(key).distinct().join(chosen, key, "left").groupBy(key)
        .agg(F.array_join(F.sort_array(F.collect_set(family)), "|").alias("brand_final"))
        .withColumn("brand_final", F.when(F.col("brand_final") == "", "not-detected").otherwise(F.col("brand_final")))
    )


def _numbered_grams(text: Column, size: int) -> Column:
    """Character runs of a text as an array without repeats: the second ``ab`` is another gram than the first.

    Runs of two include the text's begin and end.
    """
    inner = F.concat(F.lit("\x02"), text, F.lit("\x03")) if size == 2 else text
    starts = F.sequence(F.lit(1), F.length(inner) - (size - 1))
    grams = F.transform(starts, lambda i: F.substr(inner, i, F.lit(size)))
    return F.transform(grams, lambda g, i: F.concat(
        g, F.size(F.filter(F.slice(grams, F.lit(1), i + 1), lambda other: other == g)).cast("string")))


def _least_common(total: Column, accept: int, size: int) -> Column:
    """Grams that two texts with ``total`` characters share at least if their similarity reaches ``accept``.

    It rounds to whole numbers, so the common subsequence has ``need`` characters
    or more. Runs of one: those characters. Runs of two: of one text's
    ``length + 1`` runs each missing character breaks two, and each character
    that only the other text has breaks one.
    """
    need = F.ceil(total * F.lit((accept - 0.5) / 200) - F.lit(1e-9)).cast("int")
    return need if size == 1 else 3 * need - total + 1


def entry_candidates(df: DataFrame, pred: str, dictionary: DataFrame, entry: str, accept: int = 70) -> DataFrame:
    """Distinct pairs of a prediction and an entry that can be as similar as ``accept``: pred, entry.

    Two texts that reach ``accept`` share some number of character runs, which
    follows from their lengths. If both list their runs in one order, rarest in
    the dictionary first, they share one among the first ``runs - shared + 1``.
    So an equi-join of these first runs finds every pair, frequent runs hardly
    take part, and the pairs found are kept only if they share enough. Runs are
    of two characters; below an ``accept`` of 68 that promises nothing, and runs
    of one are used.
    """
    size = 2 if accept >= 68 else 1
    share = (accept - 0.5) / (200 - (accept - 0.5))
    lengths = lambda n: F.sequence(F.greatest(F.ceil(n * share - 1e-9), F.lit(1)).cast("int"), F.floor(n / share + 1e-9).cast("int"))

    def listed(texts: DataFrame, text: str) -> DataFrame:
        some = texts.select(text).distinct().where(F.length(text) > 0).select(text, F.length(text).alias("_len"))
        least = F.array_min(F.transform(lengths(F.col("_len")), lambda n: _least_common(F.col("_len") + n, accept, size)))
        grams = some.select(text, "_len", least.alias("_least"), _numbered_grams(F.col(text), size).alias("_grams"))
        return grams.withColumn("_first", F.size("_grams") - F.greatest(F.col("_least"), F.lit(1)) + 1)

    entries, wanted = listed(dictionary, entry), listed(df, pred)
    held = entries.select(F.explode("_grams").alias("_gram")).groupBy("_gram").agg(F.count("_gram").alias("_n"))

    def first_grams(texts: DataFrame, text: str, name: str) -> DataFrame:
        order = Window.partitionBy(text).orderBy(F.coalesce("_n", F.lit(0)), "_gram")
        rows = texts.select(text, F.col("_len").alias(name), "_first", F.explode("_grams").alias("_gram")).join(
            held, "_gram", "left")
        return rows.withColumn("_no", F.row_number().over(order)).where("_no <= _first").select(text, name, "_gram")

    met = first_grams(wanted, pred, "_a").join(first_grams(entries, entry, "_b"), "_gram")
    need = F.ceil((F.col("_a") + F.col("_b")) * F.lit((accept - 0.5) / 200) - F.lit(1e-9))
    pairs = met.where(F.least("_a", "_b") >= need).select(pred, entry).distinct()
    full = pairs.join(wanted.select(pred, F.col("_grams").alias("_x"), F.col("_len").alias("_a")), pred).join(
        entries.select(entry, F.col("_grams").alias("_y"), F.col("_len").alias("_b")), entry)
    shared = F.size(F.array_intersect("_x", "_y")) >= _least_common(F.col("_a") + F.col("_b"), accept, size)
    return full.where(shared).select(pred, entry)


def best_entries(df: DataFrame, pred: str, dictionary: DataFrame, entry: str, accept: int = 70) -> DataFrame:
    """Best dictionary entry of each distinct prediction, or ``not-detected`` below ``accept``; ties by the entry.

    Only the pairs of ``entry_candidates`` are scored. Null and empty texts take no part.
    """
    wanted = df.select(pred).distinct().where(F.length(pred) > 0)
    scored = entry_candidates(df, pred, dictionary, entry, accept).select(
        pred, entry, titles.similarity(F.col(pred), F.col(entry)).alias("score")).where(F.col("score") >= accept)
    best = scored.groupBy(pred).agg(
        F.min(F.struct((-F.col("score")).alias("score"), F.col(entry).alias("entry"))).alias("best"))
    return wanted.join(best, pred, "left").select(
        pred, F.coalesce("best.entry", F.lit("not-detected")).alias("brand_mapped"),
        F.coalesce(-F.col("best.score"), F.lit(0)).alias("score"))


def bag_of_words(df: DataFrame, key: str, text: str, stop_words: Sequence[str] | None = None) -> DataFrame:
    """Word counts of each text without stop words; the default list is Spark ML's English one."""
    if stop_words is None:
        from pyspark.ml.feature import StopWordsRemover

        stop_words = StopWordsRemover.loadDefaultStopWords("english")
    stops = list(stop_words)
    words = df.select(key, F.explode(titles.tokens_of(text)).alias("word")).where(~F.col("word").isin(stops))
    return words.groupBy(key, "word").agg(F.count("word").alias("n"))


def token_counts(df: DataFrame, keys: Sequence[str], column: str, tokens: Sequence[str], prefix: str) -> DataFrame:
    """How often each listed token occurs in a column, over all rows of a key."""
    return df.groupBy(*keys).agg(*[
        F.sum(F.regexp_count(F.col(column), F.lit(token))).cast("bigint").alias(f"{prefix}{i}")
        for i, token in enumerate(tokens, 1)
    ])
