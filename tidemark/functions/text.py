"""Text clean-up and phrase checks as column expressions."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters counted as white space.
SPACES = " \t\n\x0b\x0c\r\x1c\x1d\x1e\x1f\x85\xa0\u1680" + "".join(chr(c) for c in range(0x2000, 0x200B)) + "\u2028\u2029\u202f\u205f\u3000"
SPACE_RUN = r"[\s\p{Z}\x0b\x1c-\x1f\x{85}]+"
# Words that, shortly before a phrase, mean it is being denied.
NEGATIONS = ("不支持", "不能", "不应", "无法", "否认", "排除", "拒绝", "不等于", "并非", "不是", "不可", "不宜", "避免")
# Opening quotation marks.
OPEN_QUOTES = ("「", "“", "『", "《", "'", '"')


def squeeze(text: Column) -> Column:
    """Runs of white space become one blank."""
    return F.regexp_replace(text, SPACE_RUN, " ")


def strip(text: Column) -> Column:
    """White space off both ends, looking at the ends only."""
    return F.btrim(text, F.lit(SPACES))


def condense(text: Column, limit: int = 420) -> Column:
    """Squeezed text, cut at ``limit`` characters with an ellipsis when longer (a display form)."""
    flat = F.trim(squeeze(text))
    return F.when(F.length(flat) <= limit, flat).otherwise(F.concat(F.substring(flat, 1, limit), F.lit("…")))


def blank_to_null(text: Column) -> Column:
    return F.nullif(F.trim(squeeze(text)), F.lit(""))


def shorten_list(items: Column, keep: int = 8) -> Column:
    """First and last ``keep // 2`` items around a note of how many are not shown."""
    head = keep // 2
    note = F.format_string("…（省略 %d 项）", F.size(items) - keep)
    return F.when(F.size(items) <= keep, items).otherwise(
        F.concat(F.slice(items, 1, head), F.array(note), F.slice(items, -(keep - head), keep - head))
    )


def asserts_phrase(text: Column, phrase: str, lookback: int = 20, negations: Sequence[str] = NEGATIONS, quotes: Sequence[str] = OPEN_QUOTES) -> Column:
    """True when ``phrase`` occurs at least once without a denial or an opening quote just before it.

    The text is cut at every occurrence and walked with the last ``lookback`` characters
    as the only state, so the cost is linear in the text.
    """
    pieces = F.split(text, F.lit(rf"\Q{phrase}\E"), -1)

    def denied(before: Column) -> Column:
        closed = F.regexp_replace(before, SPACE_RUN + "$", "")
        quoted = reduce(lambda a, b: a | b, [closed.endswith(q) for q in quotes])
        negated = reduce(lambda a, b: a | b, [before.contains(w) for w in negations])
        return quoted | negated

    def tail(state: Column, piece: Column) -> Column:
        return F.right(F.concat(state["tail"], piece), F.lit(lookback))

    start = F.struct(F.lit("").alias("tail"), F.lit(False).alias("found"))
    # every piece but the last is followed by an occurrence
    walked = F.aggregate(
        F.slice(pieces, 1, F.size(pieces) - 1), start,
        lambda s, piece: F.struct(
            F.right(F.concat(tail(s, piece), F.lit(phrase)), F.lit(lookback)).alias("tail"),
            (s["found"] | ~denied(tail(s, piece))).alias("found")))
    return walked["found"]


def tokens(text: Column) -> Column:
    """Lower-case word tokens plus bigrams of the CJK characters taken in order, gaps ignored."""
    low = F.lower(text)
    words = F.regexp_extract_all(low, F.lit("[a-z0-9_]+"), F.lit(0))
    cjk = F.regexp_replace(low, r"[^\x{4e00}-\x{9fff}]+", "")
    pairs = F.when(
        F.length(cjk) >= 2,
        F.transform(F.sequence(F.lit(1), F.length(cjk) - 1), lambda i: F.substring(cjk, i, F.lit(2))),
    ).otherwise(F.array().cast("array<string>"))
    return F.concat(words, pairs)


def char_ngrams(text: Column) -> Column:
    """Single characters and character pairs of the text without white space."""
    chars = F.filter(F.split(F.regexp_replace(text, SPACE_RUN, ""), ""), lambda c: c != "")
    shifted = F.slice(chars, 2, F.size(chars))
    pairs = F.filter(F.zip_with(chars, shifted, lambda a, b: F.concat(a, b)), lambda p: p.isNotNull())
    return F.concat(chars, pairs)
