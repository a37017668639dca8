"""Text expressions. All of them are built-in column expressions and also run on streaming DataFrames."""

from __future__ import annotations

from functools import reduce
from operator import or_
from typing import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voc import rules

# fixed value: the characters Unicode-aware stripping removes
STRIP_CHARS = (
    " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0"
    "\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)
SPACE = r"(?U)[\s\x1c-\x1f]+"
# fixed value: separators that count as white space but that the pattern class leaves out
SEPARATORS = "\x1c\x1d\x1e\x1f"
URL = r"(?U)https?://\S+|www\.\S+"
WORD = r"[\p{L}\p{N}_]{2,}"
# finds what rules.EMAIL finds in linear time: a match can only begin where a run of name characters begins or where the
# last match ended, and a run without @ behind it is not tried again from its middle
EMAIL = r"(?:\G|(?<![\w.-]))[\w.-]++@[\w.-]+\.\w+"


def word_list(words: Iterable[str]) -> Column:
    """A constant array of texts, written as one literal."""
    return F.split(F.lit("\n".join(words)), "\n")


def contains_any(col: Column, words: Iterable[str]) -> Column:
    """True where the text holds any of the words as a substring."""
    return reduce(or_, (col.contains(w) for w in words))


def once(df: DataFrame, name: str, col: Column) -> DataFrame:
    """Adds a column that is evaluated once per row.

    A filter on a plain computed column is pushed below the projection and evaluates the expression again; it is not
    pushed below a generator.
    """
    rest = [c for c in df.columns if c != name]
    return df.select(*rest, F.explode(F.array(col)).alias(name))


def below(position: Column, bound: int) -> Column:
    """The position, or an error if it does not fit below the bound."""
    return F.when(position < bound, position).otherwise(
        F.raise_error(F.concat(F.lit(f"not below {bound}: "), position.cast("string"))).cast("bigint")
    )


def strip(col: Column) -> Column:
    return F.btrim(col, F.lit(STRIP_CHARS))


def raw_text(col: Column) -> Column:
    """A raw text field as it is loaded: missing becomes empty, outer white space goes."""
    return strip(F.coalesce(col.cast("string"), F.lit("")))


def clean_text(col: Column) -> Column:
    """Links removed, then runs of white space (line breaks and tabs included) to one blank."""
    text = F.coalesce(col, F.lit(""))
    no_links = F.when(contains_any(text, ("http", "www.")), F.regexp_replace(text, URL, "")).otherwise(text)
    spaced = F.when(
        contains_any(text, SEPARATORS), F.translate(no_links, SEPARATORS, " " * len(SEPARATORS))
    ).otherwise(no_links)
    return F.trim(F.regexp_replace(spaced, r"(?U)\s+", " "))


def title_and_body(title: Column, body: Column, sep: str = " - ") -> Column:
    """``title - body``, or whichever of the two is not empty."""
    title, body = F.coalesce(title, F.lit("")), F.coalesce(body, F.lit(""))
    return F.when((title != "") & (body != ""), F.concat(title, F.lit(sep), body)).otherwise(F.concat(title, body))


def event_time(date: Column) -> Column:
    """A timestamp from the three date encodings: date-time text, ISO text, epoch seconds as text."""
    return F.coalesce(F.timestamp_seconds(date.try_cast("bigint")), date.try_cast("timestamp"))


def cut(col: Column, n: int, tail: str = "") -> Column:
    """The first ``n`` characters, followed by ``tail``."""
    return F.concat(F.substring(col, 1, n), F.lit(tail)) if tail else F.substring(col, 1, n)


def tokens(name: str) -> Column:
    """Lower-cased words of a text column: at least two letters, digits or underscores."""
    return F.expr(f"regexp_extract_all(lower({name}), r'{WORD}', 0)")


def kept_tokens(name: str, stop_words: Iterable[str]) -> Column:
    """Words without stop words; a long IN list is looked up in a hash set."""
    stop = ", ".join(f"'{w}'" for w in stop_words)
    return F.expr(f"filter(regexp_extract_all(lower({name}), r'{WORD}', 0), t -> t not in ({stop}))")


def ngrams(words: Column) -> Column:
    """Single words followed by pairs of neighbours."""
    n = F.size(words)
    pairs = F.when(
        n > 1,
        F.zip_with(
            F.slice(words, F.lit(1), n - 1), F.slice(words, F.lit(2), n - 1), lambda a, b: F.concat(a, F.lit(" "), b)
        ),
    ).otherwise(F.array().cast("array<string>"))
    return F.concat(words, pairs)


def split_list(col: Column, sep: str = ",") -> Column:
    """Items of a separated list, trimmed, empty ones dropped."""
    return F.filter(F.transform(F.split(col, sep), strip), lambda x: x != "")


def word_count(markdown: Column) -> Column:
    """Words of a Markdown text without heading and list marks."""
    plain = F.regexp_replace(F.regexp_replace(markdown, r"(?U)#+\s+", ""), r"(?U)[-*]\s+", "")
    return F.size(F.filter(F.split(plain, SPACE), lambda w: w != "")).cast("bigint")


def may_hold_pii(col: Column) -> Column:
    """A cheap necessary test: every finding holds an @, or ten characters that begin and end with a digit."""
    return col.contains("@") | col.rlike("(?U)" + rules.PHONE.removeprefix(r"\+?"))


def redact(col: Column) -> Column:
    """E-mail addresses, phone numbers, handles and long ids replaced, in this order."""
    text = col
    for pattern, mark in (
        (EMAIL, "[REDACTED_EMAIL]"),
        (rules.PHONE, "[REDACTED_PHONE]"),
        (rules.HANDLE, "@user"),
        (rules.LONG_ID, "[REDACTED_ID]"),
    ):
        text = F.regexp_replace(text, "(?U)" + pattern, mark)
    return F.when(may_hold_pii(col), text).otherwise(col)


def paraphrase(quote: Column, limit: int) -> Column:
    """The redacted quote up to its first full stop, shortened and wrapped as reported speech."""
    first = F.substring_index(redact(quote), ".", 1)
    short = F.when(F.length(first) > limit, cut(first, limit - 3, "...")).otherwise(first)
    return F.concat(F.lit('"Customer says: '), strip(short), F.lit('"'))
