"""String functions over columns: tokens, similarities, masking, templates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What separates tokens: anything but letters, digits and the underscore.
NOT_TOKEN = r"[^\p{L}\p{N}_]+"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def words(text: Column | str) -> Column:
    """Distinct lower-cased tokens."""
    return F.array_distinct(F.filter(F.split(F.lower(_col(text)), NOT_TOKEN), lambda t: t != ""))


def bigrams(token: Column, keep_short: bool) -> Column:
    """Character bigrams of a token; a token of up to two characters is its own (if keep_short)."""
    n = F.char_length(token)
    own = F.array(token) if keep_short else F.when(n == 2, F.array(token)).otherwise(F.array().cast("array<string>"))
    return F.when(n <= 2, own).otherwise(F.transform(F.sequence(F.lit(1), n - 1), lambda i: F.substring(token, i, F.lit(2))))


def tokens(text: Column | str, keep_short: bool = True) -> Column:
    """Words, and the character bigrams of those with a non-ASCII character."""
    base = words(text)
    foreign = F.filter(base, lambda t: t.rlike(r"[^\x00-\x7F]"))
    return F.array_distinct(F.concat(base, F.flatten(F.transform(foreign, lambda t: bigrams(t, keep_short)))))


def overlap(a: Column, b: Column) -> Column:
    """Shared tokens over the size of the larger set; 0 if either is empty."""
    most = F.greatest(F.size(a), F.size(b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / most)


def jaccard(a: Column, b: Column) -> Column:
    both = F.size(F.array_intersect(a, b))
    every = F.size(F.array_union(a, b))
    return F.when(every == 0, F.lit(0.0)).otherwise(both / every)


def normalised(query: Column | str) -> Column:
    return F.lower(F.regexp_replace(F.trim(_col(query)), r"\s+", " "))


def visible_length(query: Column | str) -> Column:
    return F.char_length(F.regexp_replace(_col(query), r"\s", ""))


def lexical_text(data: Column | str, metadata: Column | str) -> Column:
    return F.concat_ws(" ", _col(data), F.array_join(F.map_values(_col(metadata)), " "))


def mask_personal(text: Column | str) -> Column:
    """Tokens with @ and a dot become [EMAIL], those with seven or more digits [PHONE]; white space becomes single."""
    def one(t: Column) -> Column:
        digits = F.char_length(F.regexp_replace(t, "[^0-9]", ""))
        return F.when(F.contains(t, F.lit("@")) & F.contains(t, F.lit(".")), F.lit("[EMAIL]")).when(digits >= 7, F.lit("[PHONE]")).otherwise(t)

    return F.array_join(F.transform(F.filter(F.split(_col(text), r"\s+"), lambda t: t != ""), one), " ")


def forbidden_word(text: Column | str, forbidden: list[str]) -> Column:
    """The first forbidden word in the text, ignoring case; null if none."""
    found = F.filter(F.array(*map(F.lit, forbidden)), lambda w: F.contains(F.lower(_col(text)), F.lower(w)))
    return F.try_element_at(found, F.lit(1))


def tail(text: Column | str, n: int) -> Column:
    return F.right(_col(text), F.lit(n))


def community_line(level: Column, community: Column, size: Column, nodes: Column) -> Column:
    return F.concat(F.lit("L"), level.cast("string"), F.lit("-C"), community.cast("string"), F.lit(": "), size.cast("string"), F.lit(" nodes, key ["), F.array_join(nodes.cast("array<string>"), ", "), F.lit("]"))


def snapshot_lsn(name: Column | str) -> Column:
    """LSN of a snapshot name wal-lsn-<n>; null for others."""
    return F.try_to_number(F.regexp_extract(_col(name), r"^wal-lsn-([0-9]+)$", 1), F.lit("9999999999999999999")).cast("bigint")


def as_of_millis(when: Column | str) -> Column:
    """Unix ms of a time: a date stands for its last millisecond in UTC, otherwise RFC 3339."""
    day = F.try_to_timestamp(_col(when), F.lit("yyyy-MM-dd"))
    return F.coalesce(F.unix_millis(day) + 86_399_999, F.unix_millis(F.try_to_timestamp(_col(when))))
