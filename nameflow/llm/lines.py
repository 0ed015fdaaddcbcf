"""Line-first cleaning with built-in expressions alone.

Every line is judged by itself - punctuation, navigation, boilerplate - and failing lines go; a document is
rejected if too many of its word characters went with them, or too few words are left.  The base rules
(document length, repeated five-word windows) are computed beside, over the whole text.

Everything about a document is an expression over its own row, so there is no shuffle; values that an
expression needs several times are bound as lambda variables, so they are computed once.

Defined results: null counts as empty text; a text without words fails the base rules; a line of white
space alone is kept and has no words; repeated rows stay repeated; other columns are ignored; an empty table
gives an empty table.
"""

from __future__ import annotations

import functools
import operator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACES = "[\\x20\\x09-\\x0D]+"
WORD = "[^\\x20\\x09-\\x0D]+"
SYMBOLS = "[#*$%&|<>]"
#: Characters outside letters, digits and white space (the plain ones first, which decides most).
MARKS = "[^A-Za-z0-9\\x20\\x09-\\x0D\\p{L}\\p{M}\\p{N}]"
SEPARATORS = "[|»›•·]| > | / "
#: Phrases of boilerplate lines, in lower case.
BOILERPLATE = (
    "all rights reserved", "copyright (c)", "copyright ©", "cookie policy", "we use cookies", "accept cookies", "privacy policy",
    "terms of service", "terms of use", "terms and conditions", "subscribe to our newsletter", "sign up for our newsletter",
    "click here to", "enable javascript", "javascript is disabled", "share on facebook", "share on twitter", "follow us on", "powered by", "lorem ipsum",
)
#: Words of navigation, in lower case; a line of these and separators alone is navigation.
NAVIGATION = ("home", "about", "contact", "login", "logout", "register", "search", "menu", "next", "previous", "back", "sitemap", "faq", "help", "blog", "news", "shop", "cart", "account")
#: A line of such words alone.  Possessive throughout: Java's regex engine would recurse once a word otherwise.
LINKS = f"^[\\s|»›•·>/,-]*+(?:(?:{'|'.join(NAVIGATION)})(?:[\\s|»›•·>/,-]++|$))++$"
#: A line fails with more symbols than words, or so many of its characters outside letters, digits and white space (percent).
MOST_SYMBOLS_PER_WORD = 1
MOST_MARKS_PERCENT = 40
#: Separators that make a line of at most so many words per separator navigation.
LEAST_SEPARATORS, WORDS_PER_SEPARATOR = 2, 3
#: Boilerplate phrases count in lines of at most so many words.
BOILERPLATE_WORDS = 40
#: A document is rejected if it loses so many of its word characters (percent), or is left with fewer words.
MOST_LOSS_PERCENT, LEAST_WORDS = 50, 10


def bound(value: Column, use) -> Column:
    """use(value), with value computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def words(text: Column) -> Column:
    return F.filter(F.split(text, SPACES), lambda w: w != "")


def word_chars(text: Column) -> Column:
    for space in " \t\n\x0b\x0c\r":
        text = F.replace(text, F.lit(space), F.lit(""))
    return F.char_length(text)


def n_words(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD))


def repeat_words(ws: Column) -> Column:
    """Words in five-word windows that occur at least twice, the first occurrence included."""

    def windows(h: Column) -> Column:
        at = F.sequence(F.lit(0), F.size(h) - 5)
        return bound(F.transform(at, lambda i: F.xxhash64(*(F.get(h, i + k) for k in range(5)))), repeated)

    def repeated(w: Column) -> Column:
        # most texts repeat nothing: a hash set tells, without sorting
        placed = F.transform(w, lambda h, i: F.struct(h.alias("h"), i.alias("i")))
        return F.when(F.size(F.array_distinct(w)) == F.size(w), 0).otherwise(bound(F.sort_array(placed), counted))

    def counted(s: Column) -> Column:
        same = lambda i, j: F.coalesce(F.get(s, i)["h"] == F.get(s, j)["h"], F.lit(False))
        twice = F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda i: same(i, i - 1) | same(i, i + 1))
        return bound(F.sort_array(F.transform(twice, lambda i: F.get(s, i)["i"])), covered)

    def covered(p: Column) -> Column:
        after = F.slice(p, 2, F.greatest(F.size(p), F.lit(1)))
        steps = F.zip_with(p, after, lambda a, b: F.least(F.coalesce(b - a, F.lit(5)), F.lit(5)))
        return F.aggregate(steps, F.lit(0), lambda acc, x: acc + x)

    return F.when(F.size(ws) < 6, 0).otherwise(bound(F.transform(ws, lambda w: F.xxhash64(w)), windows))


def dup_lines(lines: Column) -> Column:
    """Lines with a word that equal an earlier line."""
    return bound(F.filter(lines, lambda s: s.rlike(WORD)), lambda s: F.size(s) - F.size(F.array_distinct(s)))


def line_fails(s: Column) -> Column:
    """punctuation: more symbols than words, or mostly marks; navigation: separated links, or nothing but words of
    navigation; boilerplate: a known phrase in a short line.

    Every rule begins with the cheap half of its condition, so words are counted in few lines."""
    too_many = lambda n: (n > 0) & (n > MOST_SYMBOLS_PER_WORD * n_words(s))
    links = lambda n: (n >= LEAST_SEPARATORS) & (n_words(s) <= WORDS_PER_SEPARATOR * (n + 1) + n)
    marked = lambda n: (n > 0) & (n * 100 > MOST_MARKS_PERCENT * word_chars(s))
    phrase = lambda low: functools.reduce(operator.or_, (low.contains(p) for p in BOILERPLATE))
    return (
        bound(F.regexp_count(s, F.lit(SYMBOLS)), too_many)
        | bound(F.regexp_count(s, F.lit(MARKS)), marked)
        | bound(F.regexp_count(s, F.lit(SEPARATORS)), links)
        | bound(F.lower(s), lambda low: low.rlike(LINKS) | (phrase(low) & (n_words(s) <= BOILERPLATE_WORDS)))
    )


def rules(text: Column) -> Column:
    """A struct of a text (null: empty): the base counts, base_failed, the cleaned text, n_lines_removed,
    loss_percent (of word characters) and kept."""

    def counted(t: Column, lines: Column) -> Column:
        def about_words(ws: Column) -> Column:
            return F.struct(F.size(ws).cast("bigint").alias("n_words"), repeat_words(ws).cast("bigint").alias("n_repeat_words"))

        def cleaned(good: Column) -> Column:
            removed = (F.size(lines) - F.size(good)).cast("bigint")
            return F.struct(F.when(removed == 0, t).otherwise(F.array_join(good, "\n")).alias("text"), removed.alias("removed"))

        return F.struct(
            bound(words(t), about_words).alias("w"),
            word_chars(t).cast("bigint").alias("word_chars"),
            F.regexp_count(t, F.lit(SYMBOLS)).cast("bigint").alias("n_symbols"),
            dup_lines(lines).cast("bigint").alias("n_dup_lines"),
            bound(F.filter(lines, lambda s: ~line_fails(s)), cleaned).alias("c"),
        )

    def left(r: Column) -> Column:
        """Word characters and words of the cleaned text"""
        whole, text = r["c"]["removed"] == 0, r["c"]["text"]
        return F.struct(
            F.when(whole, r["word_chars"]).otherwise(word_chars(text).cast("bigint")).alias("chars"),
            F.when(whole, r["w"]["n_words"]).otherwise(n_words(text).cast("bigint")).alias("words"),
        )

    def verdict(r: Column, k: Column) -> Column:
        n, repeated, chars = r["w"]["n_words"], r["w"]["n_repeat_words"], r["word_chars"]
        failed = (n < 10) | (100 * repeated > 20 * n)
        lost = chars - k["chars"]
        return F.struct(
            n.alias("n_words"), chars.alias("word_chars"), r["n_symbols"].alias("n_symbols"), r["n_dup_lines"].alias("n_dup_lines"),
            repeated.alias("n_repeat_words"), failed.alias("base_failed"), r["c"]["text"].alias("clean_text"), r["c"]["removed"].alias("n_lines_removed"),
            F.coalesce(100.0 * lost / F.nullif(chars, F.lit(0)), F.lit(0.0)).alias("loss_percent"),
            (~failed & (100 * lost <= MOST_LOSS_PERCENT * chars) & (k["words"] >= LEAST_WORDS)).alias("kept"),
        )

    whole = lambda t: bound(F.split(t, "\n"), lambda lines: counted(t, lines))
    return bound(bound(F.coalesce(text, F.lit("")), whole), lambda r: bound(left(r), lambda k: verdict(r, k)))


def clean(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The documents that are kept, with their cleaned text, and the columns they came with."""
    # a generator, unlike a filter, is not pushed below the expression it reads, so the rules run once
    kept = F.explode(F.filter(F.array(rules(F.col(f"`{text_col}`"))), lambda r: r["kept"]))
    judged = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("given"), kept.alias("rules"))
    return judged.select(*((F.col("rules.clean_text") if c == text_col else F.col("given")[c]).alias(c) for c in docs.columns))


def report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    shown = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_lines_removed")
    judged = docs.select(F.col(id_col).alias("doc_id"), rules(F.col(text_col)).alias("rules"))
    return judged.select("doc_id", *(F.col(f"rules.{c}").alias(c) for c in shown))
