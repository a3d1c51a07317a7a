"""Column expressions for product titles and promotion texts."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, functions as F
from pyspark.sql.types import StringType

from aisle.functions.exprs import col

#: Words that mark a multi-pack title.
COMBO_WORDS = ("combo", "cặp", "bộ", "set", "sét", "comnbo")


@F.pandas_udf(StringType())
def _nfkc(text: pd.Series) -> pd.Series:
    return text.str.normalize("NFKC")


def standardize(text: Column | str) -> Column:
    """Lower case after Unicode compatibility composition (Spark has no built-in for it)."""
    return F.lower(_nfkc(F.lower(col(text))))


def remove_brackets(text: Column | str) -> Column:
    return F.regexp_replace(col(text), r"\[.*?\]", "")


def clean_title(text: Column | str) -> Column:
    """Without bracketed parts and punctuation, and without tokens that hold no letter."""
    plain = F.regexp_replace(remove_brackets(text), r"[^\p{L}\p{N}_\s]", "")
    tokens = F.split(plain, r"\s+")
    return F.array_join(F.filter(tokens, lambda t: t.rlike(r"\p{L}")), " ")


def keep_combo(text: Column | str) -> Column:
    """Drop bracketed parts, but carry a bracketed "combo" over to the front of the title."""
    text = col(text)
    inside = F.regexp_extract(text, r"\[([A-Za-z0-9_]+)\]", 1)
    rest = remove_brackets(text)
    carry = inside.contains("combo") & ~rest.contains("combo")
    return F.when(carry, F.concat(F.lit("combo "), rest)).otherwise(rest)


def tokens_of(text: Column | str) -> Column:
    """Lower-case words of letters and digits."""
    return F.array_remove(F.split(F.lower(col(text)), r"[^\p{L}\p{N}]+"), "")


def first_keyword(text: Column | str, keywords: Mapping[str, str] | Sequence[str]) -> Column:
    """Value of the longest listed keyword the text contains; ties by keyword."""
    text = col(text)
    pairs = keywords if isinstance(keywords, Mapping) else {k: k for k in keywords}
    out = None
    for word in sorted(pairs, key=lambda k: (-len(k), k)):
        test = text.contains(word)
        out = F.when(test, F.lit(pairs[word])) if out is None else out.when(test, F.lit(pairs[word]))
    return out


def full_exclusion(text: Column | str, keywords: Sequence[str]) -> Column:
    """First listed keyword that occurs as a phrase, else NO."""
    text = col(text)
    out = F.lit("NO")
    for word in reversed(keywords):
        out = F.when(text.contains(word), F.lit(word)).otherwise(out)
    return out


def partial_exclusion(text: Column | str, keywords: Sequence[str]) -> Column:
    """First listed keyword all of whose words occur, else NO."""
    text = col(text)
    out = F.lit("NO")
    for word in reversed(keywords):
        test = F.lit(True)
        for part in word.split(" "):
            test = test & text.contains(part)
        out = F.when(test, F.lit(word)).otherwise(out)
    return out


def pack_type(text: Column | str, formats: Column) -> Column:
    """``single`` without a combo word; with one, ``combo`` from two formats on, else ``multi``."""
    marked = F.lower(col(text)).rlike("|".join(COMBO_WORDS))
    return F.when(~marked, "single").when(formats >= 2, "combo").otherwise("multi")


#: Events named in a promotion's grouping, and the groupings that are a discount.
SPECIAL_EVENTS = ("hot price", "mnudl", "pwp")
DISCOUNT_PATTERN = "discount - (normal|mnudl|pwd|hot price)"


def promotion_classes(grouping: Column | str, gift: Column | str) -> list[Column]:
    """Special event, key event, gift, u-gift and discount class of a promotion text."""
    grouping, gift = col(grouping), col(gift)
    event = F.coalesce(*[F.when(grouping.contains(name), name) for name in SPECIAL_EVENTS], F.lit("unknown"))
    pick = lambda test, value, rest: F.coalesce(F.when(test, value), F.lit(rest))
    return [
        event.alias("special_event"),
        F.regexp_replace(grouping, " ", "").contains("keyevent").alias("key_event"),
        pick(grouping.rlike("(?<!u-)gift"), gift, "no-gift").alias("gift"),
        pick(grouping.contains("u-gift"), gift, "no-gift").alias("ugift"),
        pick(grouping.rlike(DISCOUNT_PATTERN), grouping, "no-discount").alias("discount"),
    ]


#: Gift kinds paid from the promotion budget and from the brand budget.
BUDGET_GIFTS = ("food selling", "food selling (pri)", "hc selling", "hc selling (pri)", "pc selling", "pc selling (pri)")
BRAND_GIFTS = (
    "food non-selling", "food sampling", "hc non-selling", "hc sampling", "pc non-selling", "pc sampling",
)


def investment_type(text: Column | str) -> Column:
    """Budgets a promotion draws on, from its grouping and gift text joined by underscores."""
    lowered = F.lower(col(text))
    gifts = F.transform(F.split(F.trim(F.regexp_replace(lowered, "u-gift", "")), "_"), F.trim)
    is_ugift = lowered.contains("u-gift")
    overlap = lambda values: is_ugift & F.arrays_overlap(gifts, F.array(*map(F.lit, values)))
    tts = lowered.contains("discount") | overlap(BUDGET_GIFTS)
    bmi = (lowered.contains("gift") & ~is_ugift) | overlap(BRAND_GIFTS)
    return F.concat_ws(" ", F.when(bmi, "bmi"), F.when(tts, "tts"))


def url_key(url: Column | str) -> Column:
    """URL without its query string."""
    return F.split_part(col(url), F.lit("?"), F.lit(1))


def store_parts(name: Column | str) -> list[Column]:
    """Province and district codes at fixed places of a store code."""
    return [F.substring(col(name), 5, 3).alias("province"), F.substring(col(name), 9, 3).alias("district")]


def near_ratio(a: Column, b: Column, edits: Column) -> Column:
    """Similarity 0–100 of two strings from their edit distance of 0 to 2.

    It is ``100 * (len(a) + len(b) - d) / (len(a) + len(b))``, rounded, where d
    counts insertions and deletions only. Up to two edits d follows from the
    edit distance; at equal length two edits are one insertion plus one
    deletion exactly when a one-letter deletion makes the strings meet.
    """
    gap = F.abs(F.length(a) - F.length(b))
    cut = lambda s: F.transform(
        F.sequence(F.lit(1), F.length(s)), lambda i: F.concat(F.substring(s, F.lit(1), i - 1), F.substr(s, i + 1))
    )
    shifted = F.arrays_overlap(cut(a), cut(b))
    distance = (
        F.when(edits == 0, 0).when((edits == 1) & (gap == 1), 1).when(edits == 1, 2)
        .when((edits == 2) & (gap == 2), 2).when((edits == 2) & (gap == 1), 3)
        .when(shifted, 2).otherwise(4)
    )
    whole = F.length(a) + F.length(b)
    return F.round(100 * (whole - distance) / whole, 0).cast("int")


def common_length(a: Column, b: Column) -> Column:
    """Length of the longest common subsequence, row by row of the usual table."""
    letters = F.filter(F.split(b, ""), lambda c: F.length(c) > 0)
    start = F.transform(F.array_append(letters, F.lit("")), lambda c: F.lit(0))

    def next_row(row: Column, letter: Column) -> Column:
        taken = F.transform(
            letters, lambda c, j: F.when(c == letter, F.element_at(row, j + 1) + 1).otherwise(F.element_at(row, j + 2))
        )
        return F.aggregate(
            taken, F.array(F.lit(0)), lambda done, v: F.array_append(done, F.greatest(F.element_at(done, -1), v))
        )

    rows = F.filter(F.split(a, ""), lambda c: F.length(c) > 0)
    return F.element_at(F.aggregate(rows, start, next_row), -1)


def similarity(a: Column, b: Column) -> Column:
    """Similarity 0–100 of any two strings by their common subsequence."""
    return F.round(200 * common_length(a, b) / (F.length(a) + F.length(b)), 0).cast("int")
