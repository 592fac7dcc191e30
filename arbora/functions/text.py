"""Scalar functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from arbora import schema as S

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def tokens(*fields: Column) -> Column:
    """Distinct search tokens: runs of ASCII letters and digits, lower-cased, of 2 to 64 characters."""
    text = F.concat_ws(" ", *fields)
    runs = F.regexp_extract_all(ascii_lower(text), F.lit("[a-z0-9]+"), F.lit(0))
    return F.array_distinct(F.filter(runs, lambda t: F.length(t).between(S.TOKEN_MIN, S.TOKEN_MAX)))


def query_tokens(query: str) -> list[str]:
    """The same for a query string, in order."""
    import re

    runs = re.findall("[a-z0-9]+", query.translate(str.maketrans(UPPER, LOWER)))
    return list(dict.fromkeys(t for t in runs if S.TOKEN_MIN <= len(t) <= S.TOKEN_MAX))


def highlight_tokens(query: str) -> list[str]:
    import re

    return [t for t in re.split(r"[^A-Za-z0-9_]+", query) if len(t) >= 2]


def fits(c: Column, limit: int) -> Column:
    """The UTF-8 bytes are within the limit."""
    return F.octet_length(F.coalesce(c, F.lit(""))) <= limit


def slugify(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def display_name(c: Column) -> Column:
    return F.translate(c, "_", " ")


def parse_tags(c: Column) -> Column:
    return F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), ","), lambda t: F.trim(t)), lambda t: t != "")


def has_tag(c: Column, tag: str) -> Column:
    return F.exists(parse_tags(c), lambda t: F.lower(t) == tag.strip().lower())


def safe_hostname(url: Column) -> Column:
    return F.coalesce(F.try_parse_url(url, F.lit("HOST")), url)


def is_http_url(url: Column) -> Column:
    return F.coalesce(url.rlike("^(?i)https?://"), F.lit(False))


def truncate(c: Column, n: int) -> Column:
    """The first n characters without white space at their end and an ellipsis, where there are more."""
    return F.when(F.char_length(c) > n, F.concat(F.regexp_replace(F.substring(c, 1, n), r"\s+$", ""), F.lit("…"))).otherwise(c)


def pad(c: Column, width: int) -> Column:
    """A number with leading zeros; a longer one is left whole."""
    text = c.cast("string")
    return F.when(F.length(text) < width, F.lpad(text, width, "0")).otherwise(text)


def long_date(at: Column) -> Column:
    """``May 10, 2026``; null for the start of the epoch or before, which means no date."""
    return F.when(F.unix_timestamp(at) > 0, F.date_format(at, "MMM dd, yyyy"))


def long_date_or_dash(at: Column) -> Column:
    return F.coalesce(long_date(at), F.lit("—"))


def month_year(at: Column) -> Column:
    return F.date_format(at, "MMM yyyy")


def relative_time(seconds: Column, now: Column) -> Column:
    """``5m ago`` of epoch seconds, in the largest unit that fits; ``never`` for 0 or less."""
    gap = now - seconds
    ago = F.when(gap < 60, F.concat(gap.cast("string"), F.lit("s ago")))
    for below, unit, letter in ((3600, 60, "m"), (86400, 3600, "h"), (None, 86400, "d")):
        part = F.concat(F.floor(gap / unit).cast("string"), F.lit(f"{letter} ago"))
        ago = ago.when(gap < below, part) if below else ago.otherwise(part)
    return F.when(seconds <= 0, "never").otherwise(ago)


def dash_or_value(c: Column) -> Column:
    return F.when(F.coalesce(F.length(c), F.lit(0)) > 0, c).otherwise("—")


def url_hash(url: Column) -> Column:
    """128 bits in two longs: at 10^10 urls two equal hashes of different urls aren't to be expected."""
    return F.struct(F.xxhash64(url), F.xxhash64(url, F.lit(1)))


def submitter_id(user: Column) -> Column:
    """A stable 32-bit number other than 0 of a user's id, by two multiplicative folds over its characters."""
    # Starts and multipliers of the two folds.
    folds = ((3735928559, 2654435761, 16, 2246822507), (1103547991, 1597334677, 13, 3266489909))

    def times(a: Column, m: int) -> Column:  # modulo 2^32, in two parts that stay within 64 bits
        return (F.shiftleft((a * (m >> 16)).bitwiseAND(0xFFFF), 16) + a * (m & 0xFFFF)).bitwiseAND(0xFFFFFFFF)

    chars = F.transform(F.filter(F.split(user, ""), lambda c: c != ""), lambda c: F.ascii(c).cast("long"))
    def fold(start: int, m: int, shift: int, last: int) -> Column:
        return F.aggregate(chars, F.lit(start).cast("long"), lambda a, c: times(a.bitwiseXOR(c), m), lambda a: times(a.bitwiseXOR(F.shiftrightunsigned(a, shift)), last))

    high, low = (fold(*values) for values in folds)
    n = (F.shiftleft(high.bitwiseAND(0xFFFF), 16) + low).bitwiseAND(0xFFFFFFFF)
    return F.when(n == 0, 1).otherwise(n).cast("long")


def path_depth(c: Column) -> Column:
    return F.length(c) - F.length(F.replace(c, F.lit("/"), F.lit("")))


def path_label(names: Column) -> Column:
    """Names from the root without a leading "top", joined; of more than four: the first, an ellipsis, the last two."""
    rest = F.when(F.lower(F.get(names, F.lit(0))) == "top", F.slice(names, 2, F.greatest(F.size(names) - 1, F.lit(0)))).otherwise(names)
    short = F.concat(F.slice(rest, 1, 1), F.array(F.lit("…")), F.slice(rest, -2, 2))
    return F.array_join(F.when(F.size(rest) > 4, short).otherwise(rest), " › ")


def drift_bp(observed: Column, expected: Column) -> Column:
    """|observed - expected| in ten-thousandths of the expected; of 0: 0, or the largest 32-bit count."""
    top = F.lit(4294967295)
    gap = F.abs(observed - expected)
    return F.when(expected == 0, F.when(observed == 0, 0).otherwise(top)).otherwise(F.least(F.floor(gap * 10000 / expected), top)).cast("long")


def valid_submission(title: Column, description: Column, url: Column, category: Column) -> Column:
    return (F.char_length(F.trim(title)).between(1, 128)) & F.char_length(F.trim(description)).between(30, 256) & is_http_url(url) & (category > 0)
