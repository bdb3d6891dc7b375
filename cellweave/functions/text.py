"""Text expressions: names, IRIs and literals."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def parse_price(text: Column) -> Column:
    return F.regexp_replace(text, r"[$,]", "").try_cast("double")


def _words(text: Column) -> Column:
    return F.split(F.replace(text, F.lit(":"), F.lit("_")), "_")


def _title(word: Column) -> Column:
    """Upper-case every letter that follows a non-letter, lower-case the others."""
    pieces = F.regexp_extract_all(word, F.lit(r"([A-Za-z]+|[^A-Za-z]+)"), F.lit(1))
    return F.array_join(
        F.transform(pieces, lambda p: F.concat(F.upper(F.substring(p, 1, 1)), F.lower(F.substr(p, F.lit(2))))), ""
    )


def _capital(word: Column) -> Column:
    return F.concat(F.upper(F.substring(word, 1, 1)), F.lower(F.substr(word, F.lit(2))))


def camel_class(text: Column) -> Column:
    """Class name: every word capitalised, an empty word written as ``_``."""
    return F.array_join(F.transform(_words(text), lambda w: F.when(w == "", F.lit("_")).otherwise(_capital(w))), "")


def camel_key(text: Column) -> Column:
    """Key name: first word as it is, the others in title case."""
    return F.array_join(F.transform(_words(text), lambda w, i: F.when(i == 0, w).otherwise(_title(w))), "")


def iri(prefix: str, local: Column) -> Column:
    return F.concat(F.lit(prefix), local.cast("string"))


def escape_literal(text: Column) -> Column:
    """Backslash and quote are escaped, line breaks become blanks."""
    text = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    text = F.replace(text, F.lit('"'), F.lit('\\"'))
    return F.replace(text, F.lit("\n"), F.lit(" "))


def squeeze_key(text: Column) -> Column:
    return F.replace(text, F.lit(" "), F.lit(""))


def percent_encode(text: Column) -> Column:
    """Percent-encoding that keeps ``/`` and writes a blank as ``%20``."""
    enc = F.url_encode(text)
    for have, want in (("+", "%20"), ("%2F", "/"), ("%7E", "~"), ("*", "%2A")):
        enc = F.replace(enc, F.lit(have), F.lit(want))
    return enc


def wikipedia_url(tag: Column) -> Column:
    """``lang:title`` to a page address; without a language the language part is empty."""
    parts = F.split(tag, ":")
    has_lang = F.size(parts) > 1
    lang = F.when(has_lang, parts[0]).otherwise(F.lit(""))
    title = F.when(has_lang, F.get(parts, F.lit(1))).otherwise(tag)
    path = F.concat(lang, F.lit(".wikipedia.org/wiki/"), lang, F.lit(":"), title)
    return F.concat(F.lit("https://"), percent_encode(path))


def wikidata_object(tag: Column) -> Column:
    return F.when(tag.startswith("Q"), F.concat(F.lit("http://www.wikidata.org/wiki/"), tag)).otherwise(tag)


def json_to_map(text: Column) -> Column:
    return F.from_json(text, "map<string,string>")
