"""Counts, words, hashes and clean-up of text columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns counted in engagement texts.
COUNTED = {
    "quest": r"\?",
    "excl_quest": r"!|\?",
    "pilcrow": "¶",
    "hash": "#",
    "at": "@",
    "photo": "Photo",
    "video": "Video",
    "gif": "GIF",
    "capital_words": r"(?<![\p{L}\p{N}_])[A-Z]{2,}(?![\p{L}\p{N}_])",
    "retweet": "retweet",
    "rt": " rt ",
}
CLOSING_MARK = r"(?s)^(.+)[!?:;.,]\z"
STAR_WORDS = ("one", "two", "three", "four", "five")


def token_count(c: Column, sep: str = "\t") -> Column:
    """Delimited tokens; null counts as none."""
    return F.when(c.isNull(), 0).otherwise(F.size(F.split(c, sep)))


def pattern_count(c: Column, pattern: str) -> Column:
    return F.coalesce(F.regexp_count(c, F.lit(pattern)), F.lit(0))


def char_count(c: Column) -> Column:
    return F.length(c)


def space_count(c: Column) -> Column:
    return F.length(c) - F.length(F.replace(c, F.lit(" "), F.lit("")))


def word_at(c: Column, place: int, default: str | None = None) -> Column:
    """The word at a 0-based place, or counted from the end when negative."""
    at = place + 1 if place >= 0 else place
    word = F.try_element_at(F.split(c, " "), F.lit(at))
    return word if default is None else F.coalesce(word, F.lit(default))


def md5_u32(c: Column) -> Column:
    """md5 modulo 2^32; texts of up to two characters all hash as '0'."""
    source = F.when(F.length(c) <= 2, F.lit("0")).otherwise(c)
    return F.conv(F.right(F.md5(source), F.lit(8)), 16, 10).cast("long")


def hex_to_long(c: Column) -> Column:
    """Last 16 hex digits as a signed 64-bit integer."""
    return F.conv(F.right(c, F.lit(16)), 16, -10).cast("long")


def hex_to_u32(c: Column, sep: str = "\t") -> Column:
    """First token modulo 2^32; null becomes 0."""
    head = F.element_at(F.split(c, sep), 1)
    return F.coalesce(F.conv(F.right(head, F.lit(8)), 16, 10).cast("long"), F.lit(0))


def strip_mark(c: Column) -> Column:
    """Drop one closing punctuation mark, unless nothing else is left."""
    return F.regexp_replace(c, CLOSING_MARK, "$1")


def mention(c: Column, nth: int = 0, lead: str = "@") -> Column:
    """The nth word behind ``lead``, re-joined over ' _ '; '' when absent."""
    behind = F.try_element_at(F.split(F.lower(c), lead), F.lit(nth + 2))
    word = F.regexp_extract(behind, r"^[^ ]*(?: _ [^ ]*)*", 0)
    pieces = F.transform(F.split(word, " _ "), strip_mark)
    return F.coalesce(F.array_join(pieces, "_"), F.lit(""))


def mention_hash(c: Column, nth: int = 0, lead: str = "@") -> Column:
    return md5_u32(mention(c, nth, lead))


def rejoin(c: Column) -> Column:
    """Lower-case decoded text with its links, mentions and tags re-joined."""
    text = F.lower(c)
    for split_form, joined in (
        ("http : / / t. co / ", "http"),
        ("https : / / t. co / ", "http"),
        (" _ ", "_"),
        ("@ ", "@"),
        ("# ", "#"),
    ):
        text = F.replace(text, F.lit(split_form), F.lit(joined))
    text = F.replace(text, F.lit("[cls] rt @"), F.lit("@"))
    return F.replace(text, F.lit("[cls] "), F.lit(" "))


def collapse_blanks(c: Column) -> Column:
    bare = F.replace(c, F.lit("¶ "), F.lit(" "))
    return F.regexp_replace(F.regexp_replace(bare, r"\s+", " "), r"^ | $", "")


def clean_text(c: Column) -> Column:
    return collapse_blanks(rejoin(c))


def retweet_head(c: Column, is_retweet: Column) -> Column:
    """Text before the first ':' of a retweet, else ''."""
    return F.when(is_retweet, F.substring_index(c, ":", 1)).otherwise("")


def retweet_body(c: Column, is_retweet: Column) -> Column:
    """Text behind the first ':' of a retweet, else the whole text."""
    at = F.locate(":", c)
    behind = F.when(at > 0, F.substring(c, at + 1, F.length(c))).otherwise("")
    return F.when(is_retweet, behind).otherwise(c)


def ending_class(c: Column) -> Column:
    """How a text ends: 1 '?', 2 '!?', 3 '?!', 4 '!', 0 otherwise.

    Links and what follows them, the first tag and the first mention are
    removed before looking.
    """
    text = F.substring_index(F.replace(c, F.lit("[sep]"), F.lit("")), "http", 1)
    for lead in "#@":
        around = rf"(?s)^([^{lead}]*){lead}[^{lead} ]*(?: ([^{lead}]*))?.*\z"
        text = F.regexp_replace(text, around, "$1$2")
    text = F.regexp_replace(text, r"\s+\z", "")
    return (
        F.when(F.length(text) < 2, 0)
        .when(text.endswith("!?"), 2)
        .when(text.endswith("?!"), 3)
        .when(text.endswith("?"), 1)
        .when(text.endswith("!"), 4)
        .otherwise(0)
    )


def has_text(c: Column, part: str) -> Column:
    return c.contains(part).cast("int")


def path_head(c: Column, sep: str = "/") -> Column:
    return F.substring_index(c, sep, 1)


def amenity_tokens(c: Column, sep: str = "|") -> Column:
    """Sorted distinct amenities of a property list as lower-case words.

    Star labels ('4 Star', 'From 3 Stars') collapse into one '<n> star' entry:
    the first plain label, or the highest 'From' label when there is none.
    """
    plain = F.replace(F.replace(c, F.lit("24/7"), F.lit("anytime")), F.lit("-"), F.lit(" "))
    plain = F.regexp_replace(plain, r"[&/()']", "")
    items = F.split(plain, r"\|") if sep == "|" else F.split(plain, sep)
    is_star = lambda x: x.rlike(r"^[A-Za-z]* *[1-9]+ [A-Za-z]+$")
    number = lambda x: F.regexp_extract(x, r"([1-9]+)", 1).cast("int")
    stars = F.filter(items, is_star)
    exact = F.transform(F.filter(stars, lambda x: ~x.startswith("From")), number)
    lower = F.transform(F.filter(stars, lambda x: x.startswith("From")), number)
    rating = F.coalesce(F.try_element_at(exact, F.lit(1)), F.array_max(lower))
    words = F.array(*[F.lit(w + " star") for w in STAR_WORDS])
    label = F.try_element_at(words, rating)
    rest = F.filter(items, lambda x: ~is_star(x))
    named = F.when(label.isNull(), rest).otherwise(F.concat(rest, F.array(label)))
    ordered = F.array_sort(F.array_distinct(named))
    joined = F.lower(F.array_join(ordered, " xxnext "))
    return F.filter(F.split(joined, " "), lambda w: w != "")
