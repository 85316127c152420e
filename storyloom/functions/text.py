"""Text expressions: every function takes columns and returns a column, all inside whole-stage code generation where Spark allows it."""

from __future__ import annotations

import json
from collections.abc import Iterable
from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

from .vocabulary import CLUSTER_STOP_WORDS, TRACKING_PARAMS

MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")
WORD_RUN = r"[\p{L}\p{N}_]{3,}"
NUMBER = r"(?=\d)\b\d[\d,\.]*%?\b"
DATE = r"(?i)\b(?:January|February|March|April|May|June|July|August|September|October|November|December|Jan|Feb|Mar|Apr|Jun|Jul|Aug|Sep|Sept|Oct|Nov|Dec)\.?\s+\d{1,2}(?:st|nd|rd|th)?,?\s*\d{4}\b|\b\d{4}-\d{2}-\d{2}\b"
#: A tag, comment end or declaration, with quoted values as a whole or, where a quote stays open, up to the next ">"; another "<" is text.
TAG = r"""<[a-zA-Z/!?](?:[^>"']++|"[^"]*+"|'[^']*+')*+>|<[a-zA-Z/!?][^>]*>"""


def words_array(values: Iterable[str]) -> Column:
    return F.array(*(F.lit(v) for v in values))


def _code_point(code: Column) -> Column:
    """The character of a code point; the replacement character where there is none."""
    bad = (code == 0) | (code > 0x10FFFF) | ((code >= 0xD800) & (code <= 0xDFFF))
    return F.when(bad | code.isNull(), F.lit("\ufffd")).otherwise(F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32"))


def unescape_html(text: Column) -> Column:
    """``text`` with its character references decoded once: decimal, hexadecimal and all names that HTML defines, the old ones without ";" too."""
    names = F.from_json(F.lit(json.dumps(html5)), "map<string,string>")
    old = "|".join(sorted((n for n in html5 if not n.endswith(";")), key=lambda n: (-len(n), n)))

    def decoded(part: Column) -> Column:
        """What stood behind an ampersand, with the reference at its start decoded."""
        number = F.regexp_extract(part, r"^#(?:([0-9]+)|[xX][0-9a-fA-F]+);?", 1)
        figure = F.regexp_extract(part, r"^#(?:[0-9]+|[xX][0-9a-fA-F]+);?", 0)
        code = F.when(number != "", F.substring(number, 1, 12).cast("long")).otherwise(F.conv(F.regexp_extract(part, r"^#[xX]([0-9a-fA-F]{1,12})", 1), 16, 10).cast("long"))
        name = F.regexp_extract(part, r"^[a-zA-Z][a-zA-Z0-9]{0,31};", 0)
        short = F.regexp_extract(part, f"^(?:{old})", 0)
        rest = lambda ref: F.substr(part, F.length(ref) + 1)
        return (
            F.when(figure != "", F.concat(_code_point(code), rest(figure)))
            .when((name != "") & F.element_at(names, name).isNotNull(), F.concat(F.element_at(names, name), rest(name)))
            .when(short != "", F.concat(F.element_at(names, short), rest(short)))
            .otherwise(F.concat(F.lit("&"), part))
        )

    parts = F.split(text, "&", -1)
    whole = F.concat(F.get(parts, 0), F.array_join(F.transform(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))), decoded), ""))
    return F.when(F.contains(text, F.lit("&")), whole).otherwise(text)


def clean_html(raw: Column) -> Column:
    """Plain text of an HTML fragment: script, style, iframe and noscript go with their content, tags become spaces (N1). One of these, or a comment,
    that is never closed goes on to the end."""
    text = F.regexp_replace(F.coalesce(raw, F.lit("")), r"(?is)<(script|style|iframe|noscript)\b.*?(?:</\1\b[^>]*>|\z)", " ")
    text = F.regexp_replace(F.regexp_replace(text, r"(?s)<!--.*?(?:-->|\z)", " "), TAG, " ")
    return F.regexp_replace(F.regexp_replace(unescape_html(text), r"[\s\x{A0}]+", " "), "^ | $", "")


def canonical_url(url: Column, tracking: Iterable[str] = TRACKING_PARAMS) -> Column:
    """URL without tracking parameters, fragment and trailing slashes, scheme and host in lower case (N2). No scheme or host: as it is."""
    url = F.trim(F.coalesce(url, F.lit("")))
    part = lambda i: F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.\-]*)://([^/?#]+)([^?#]*)(?:\?([^#]*))?", i)
    names = words_array(tracking)
    pairs = F.filter(F.split(part(4), "&"), lambda p: (p != "") & ~F.array_contains(names, F.lower(F.try_url_decode(F.substring_index(p, "=", 1)))))
    recode = lambda x: F.url_encode(F.coalesce(F.try_url_decode(x), x))
    kept = F.transform(pairs, lambda p: F.concat(recode(F.substring_index(p, "=", 1)), F.lit("="), recode(F.when(F.contains(p, F.lit("=")), F.substr(p, F.locate("=", p) + 1)).otherwise(F.lit("")))))
    query = F.array_join(kept, "&")
    path = F.when(F.length(part(3)) > 1, F.regexp_replace(part(3), "/+$", "")).otherwise(part(3))
    full = F.concat(F.lower(part(1)), F.lit("://"), F.lower(part(2)), path, F.when(query != "", F.concat(F.lit("?"), query)).otherwise(F.lit("")))
    return F.when(part(2) == "", url).otherwise(full)


def content_hash(title: Column, url: Column) -> Column:
    """sha256 of title and URL, both trimmed and in lower case."""
    return F.sha2(F.concat_ws("|", F.lower(F.trim(title)), F.lower(F.trim(url))), 256)


def _let(value: Column, use) -> Column:
    """``use(value)`` with ``value`` computed once, however often it is named."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _respelled(s: Column, fallback: Column) -> Column:
    """Rarer spellings of a time written as the usual ones; all others as they are."""
    asctime = r"^([A-Za-z]{3,9})\.?\s+(\d{1,2})\s+(\d{1,2}:\d{2}(?::\d{2})?(?:[.,]\d+)?)\s+(?:[A-Za-z]{1,5}\s+)?(\d{4})$"
    compact = r"^(\d{4})(\d{2})(\d{2})(?:[T\s]?(\d{2})(\d{2})(\d{2})?)?(?![\d:])(.*)$"
    numbers = r"^(\d{1,2})([/.-])(\d{1,2})\2(\d{4})(?!\d)"
    hour = r"(?<![:\d])(\d{1,2})\s*([AaPp])\.?[Mm]\b\.?"

    def spread(x: Column) -> Column:
        part = lambda i: F.regexp_extract(x, compact, i)
        clock = F.when(part(4) != "", F.concat(F.lit(" "), part(4), F.lit(":"), part(5), F.when(part(6) != "", F.concat(F.lit(":"), part(6))).otherwise(F.lit("")))).otherwise(F.lit(""))
        return F.when(x.rlike(compact), F.concat(part(1), F.lit("-"), part(2), F.lit("-"), part(3), clock, part(7))).otherwise(x)

    def ordered(x: Column) -> Column:
        day_first = F.regexp_extract(x, numbers, 1).try_cast("int") > 12
        return F.when(day_first, F.regexp_replace(x, numbers, "$4-$3-$1")).otherwise(F.regexp_replace(x, numbers, "$4-$1-$3"))

    def completed(x: Column) -> Column:
        last = F.dayofmonth(F.last_day(F.try_to_timestamp(F.concat(x, F.lit("-01")), F.lit("yyyy-MM-dd"))))
        return F.when(x.rlike(r"^\d{4}-\d{2}$"), F.concat(x, F.lit("-"), F.lpad(F.least(F.dayofmonth(fallback), last).cast("string"), 2, "0"))).otherwise(x)

    s = _let(_let(F.regexp_replace(s, asctime, "$1 $2 $4 $3"), spread), ordered)
    return _let(F.regexp_replace(s, hour, "$1:00 $2m"), completed)


def parse_time(raw: Column, fallback: Column) -> Column:
    """UTC time of the date spellings that feeds use; what cannot be read is ``fallback``.

    Read are ISO 8601, also without separators, and days, months' names and years in either order, with a weekday or without, the year after the
    clock too, numbers apart by slashes, dots or hyphens (the month first unless it is over 12), years of two digits (those within fifty
    years of ``fallback``), 12 and 24 hours, hours alone with am or pm, fractions of a second, and offsets with or without a space and a colon. A month
    without a day takes the day of ``fallback``. Times without an offset are UTC, and so are those with a zone's name, as names other than UTC, GMT
    and Z don't tell an offset.
    """
    s = F.regexp_replace(F.trim(F.coalesce(raw, F.lit(""))), r"^(?i)(?:mon|tue|wed|thu|fri|sat|sun)[a-z]*\.?,?\s+", "")
    return _let(_respelled(s, fallback), lambda x: _usual_time(x, fallback))


def _usual_time(s: Column, fallback: Column) -> Column:
    iso, day_first, month_first = r"^(\d{4})[-/](\d{1,2})[-/](\d{1,2})(?![\d])(.*)$", r"^(\d{1,2})(?:st|nd|rd|th)?[\s-]+([A-Za-z]{3,9})\.?,?[\s-]+(\d{4}|\d{2})(?!\d)(.*)$", r"^([A-Za-z]{3,9})\.?\s+(\d{1,2})(?:st|nd|rd|th)?,?\s+(\d{4})(?!\d)(.*)$"
    parts = F.split(
        F.when(s.rlike(iso), F.regexp_replace(s, iso, "$1~$2~$3~$4")).when(s.rlike(day_first), F.regexp_replace(s, day_first, "$3~$2~$1~$4")).when(s.rlike(month_first), F.regexp_replace(s, month_first, "$3~$1~$2~$4")),
        "~",
    )
    clock = r"^[T,\s]*(?:(\d{1,2}):(\d{2})(?::(\d{2})(?:[.,](\d{1,9}))?)?\s*([AaPp](?=\.?[Mm]))?(?:\.?[Mm]\.?)?)?\s*(?:(?:[A-Za-z]{1,5})?\s*(?:([+-])(\d{2}):?(\d{2})?)?)?(?:\s*\([A-Za-z ]+\))?\s*$"
    # the parts of the date and of the clock are cut once, not again for each use of one of them
    cut = lambda rest: F.when(rest.rlike(clock), F.split(F.regexp_replace(rest, clock, "~".join(f"${i}" for i in range(1, 9))), "~", -1))
    return _let(parts, lambda p: _let(cut(F.get(p, 3)), lambda c: _time_of_parts(p, c, fallback)))


def _time_of_parts(parts: Column, clock: Column, fallback: Column) -> Column:
    """The time of year, month and day (``parts``) and of hour, minute, second, fraction, half of the day, sign, hours and minutes of the offset (``clock``,
    empty where one is missing, null if the clock cannot be read)."""
    year, month, day = (F.get(parts, i) for i in range(3))
    spelled = F.nullif(F.array_position(words_array(MONTHS), F.lower(F.substring(month, 1, 3))), F.lit(0))
    month = F.when(month.rlike("^[0-9]+$"), month.cast("int")).otherwise(spelled.cast("int"))
    now = F.coalesce(F.year(fallback), F.lit(2000))
    near = now - F.pmod(now, F.lit(100)) + year.cast("int")
    year = F.when(F.length(year) == 4, year.cast("int")).when(near >= now + 50, near - 100).when(near < now - 50, near + 100).otherwise(near)
    got = lambda i, default: F.coalesce(F.nullif(F.get(clock, i - 1), F.lit("")), F.lit(default))
    hour, half = got(1, "0").cast("int"), F.lower(got(5, ""))
    hour = F.when(half == "", hour).otherwise(F.pmod(hour, F.lit(12)) + F.when(half == "p", 12).otherwise(0))

    def read(month: Column) -> Column:
        local = F.format_string("%04d-%02d-%02d %02d:%s:%s.%s", year, month, day.cast("int"), hour, got(2, "00"), got(3, "00"), F.rpad(F.substring(got(4, "0"), 1, 6), 6, "0"))
        offset = F.concat(got(6, "+"), got(7, "00"), F.lit(":"), got(8, "00"))
        return F.when(month.isNotNull(), F.try_to_timestamp(F.concat(local, offset), F.lit("yyyy-MM-dd HH:mm:ss.SSSSSSxxx")))

    return F.coalesce(F.when(clock.isNotNull(), _let(month, read)), fallback)


def title_tokens(title: Column) -> Column:
    """Distinct Unicode word runs of three or more characters, in lower case."""
    return F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(title, F.lit(""))), F.lit(WORD_RUN), 0))


def informative_tokens(title: Column, stop_words: Iterable[str] = CLUSTER_STOP_WORDS) -> Column:
    """Title tokens that are plain ASCII and not stop words."""
    stops = words_array(stop_words)
    return F.filter(title_tokens(title), lambda x: x.rlike("^[a-z0-9]+$") & ~F.array_contains(stops, x))


def jaccard(a: Column, b: Column) -> Column:
    """Jaccard similarity of two arrays of distinct values, 0 if either is empty."""
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(both / (F.size(a) + F.size(b) - both))


def numbers(text: Column) -> Column:
    """Sorted distinct figures."""
    return F.array_sort(F.array_distinct(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(NUMBER), 0)))


def dates(text: Column) -> Column:
    """Sorted distinct dates, spelled with a month's name or ISO (B4). Each has four digits in a row, so texts without them are not searched for months."""
    found = F.array_sort(F.array_distinct(F.regexp_extract_all(text, F.lit(DATE), 0)))
    return F.when(text.rlike(r"\d{4}"), found).otherwise(F.array().cast("array<string>"))


def trim_words(text: Column, limit: int = 160) -> Column:
    """At most ``limit`` characters, cut after a whole word and marked by dots."""
    text = F.trim(text)
    return F.when(F.length(text) > limit, F.concat(F.regexp_replace(F.substring(text, 1, limit - 3), r" [^ ]*$", ""), F.lit("..."))).otherwise(text)


def plain_name(name: Column) -> Column:
    """Lower-case ASCII letters, digits and spaces of a name (guard form)."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(name, F.lit(""))), r"[^a-z0-9 ]+", ""))


def entity_key(name: Column) -> Column:
    """Identity of an entity: ASCII letters and digits in lower case, words joined by underscores (E5)."""
    return F.regexp_replace(F.lower(F.trim(F.regexp_replace(name, r"[^a-zA-Z0-9\s]", ""))), r"\s+", "_")


def any_contained(text: Column, phrases: Iterable[str]) -> Column:
    out = F.lit(False)
    for p in phrases:
        out = out | F.contains(text, F.lit(p))
    return out


def round2(x: Column) -> Column:
    """Two decimals, halves up, by the same arithmetic in any engine."""
    return F.floor(x * 100 + F.lit(0.5)) / 100
