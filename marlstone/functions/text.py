"""Functions of columns: text and markup, urls, dates, lists."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def keywords(tags: Column) -> Column:
    """The tags of a post as one text, parted by a comma and a blank; null without any."""
    return F.nullif(F.array_join(tags, ", "), F.lit(""))


def split_list(text: Column) -> Column:
    """The entries of a list that is written with blanks between them; runs of blanks part as one."""
    return F.filter(F.split(text, " "), lambda x: x != "")


def column_class(columns: Column) -> Column:
    """The style class of a gallery of so many columns: half for 2, third for 3, else empty."""
    return F.when(columns == 2, "half").when(columns == 3, "third").otherwise("")


def date_text(date: Column) -> Column:
    """Day, short English month and year: 14 Sep 2021."""
    return F.date_format(date, "dd MMM yyyy")


def strip_html(html: Column) -> Column:
    """Text without scripts, styles, comments and tags."""
    return F.regexp_replace(html, r"(?is)<script.*?</script>|<style.*?</style>|<!--.*?-->|<[^>]*>", "")


def compress_html(html: Column) -> Column:
    """Runs of white space as one blank, except inside <pre>, which stays as it is; comments outside <pre> are removed.

    What follows the last </pre> of a piece is compressed; a <pre> that is not closed is kept to the end.
    """
    plain = lambda c: F.regexp_replace(F.regexp_replace(c, r"(?s)<!--.*?-->", ""), r"\s+", " ")
    pieces = F.split(html, r"(?i)(?=<pre[\s>])|(?<=</pre>)")
    return F.trim(F.array_join(F.transform(pieces, lambda p: F.when(p.rlike(r"(?i)\A<pre[\s>]"), p).otherwise(plain(p))), ""))


def word_count(text: Column) -> Column:
    """Number of runs of characters that are no white space; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"\S+")), F.lit(0))


def minutes_of(words: Column, words_per_minute: int = 200) -> Column:
    """Words over words_per_minute, rounded half up, at least 1."""
    return F.greatest(F.lit(1), F.round(words / words_per_minute).cast("int"))


def reading_minutes(text: Column, words_per_minute: int = 200) -> Column:
    """minutes_of the words of a text without its markup."""
    return minutes_of(word_count(strip_html(text)), words_per_minute)


def effective_date(front_matter: Column, filename: Column) -> Column:
    """The date that the post names, else the one of its filename."""
    return F.coalesce(front_matter, F.to_date(F.try_element_at(F.regexp_extract_all(filename, F.lit(r"\d{4}-\d{2}-\d{2}"), F.lit(0)), F.lit(1))))


def absolute_url(url: Column, base: str) -> Column:
    """`base` before urls without a scheme."""
    return F.when(url.contains("://"), url).otherwise(F.concat(F.lit(base), url))


def canonical_url(url: Column) -> Column:
    """Without index.html and trailing slashes."""
    return F.regexp_replace(F.replace(url, F.lit("index.html"), F.lit("")), "/+$", "")


def first_text(*columns: Column) -> Column:
    """The first that is neither null nor empty."""
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in columns])


def links(html: Column) -> Column:
    """Targets of all <a href="…">, in order."""
    return F.regexp_extract_all(html, F.lit(r'(?i)<a\s[^>]*?href="([^"]*)"'), F.lit(1))


def title(html: Column) -> Column:
    return F.regexp_extract(html, r"(?is)<title>(.*?)</title>", 1)


def shorten_region(name: Column) -> Column:
    """A name of four characters as its first and third, any other as its first two."""
    return F.when(F.length(name) == 4, F.concat(F.substring(name, 1, 1), F.substring(name, 3, 1))).otherwise(F.substring(name, 1, 2))


def token(text: Column, place: int, lenient: bool = True) -> Column:
    """The blank-separated token at `place` (from 0). Out of range: null, or an error unless lenient."""
    parts = F.split(text, " ")
    return F.get(parts, F.lit(place)) if lenient else parts[place]
