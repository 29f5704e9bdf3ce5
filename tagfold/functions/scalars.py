"""Small functions on text and numbers, as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Units of durations in seconds and of sizes in bytes, smallest first.
DURATIONS = {"s": 1, "m": 60, "h": 3_600, "d": 86_400, "w": 604_800}
SIZES = {"b": 1, "k": 1 << 10, "m": 1 << 20, "g": 1 << 30, "t": 1 << 40}
#: Fixed value: the pattern by which user agents count as bots.
BOTS = r"^alexa|^blitz\.io|bot|^browsermob|crawl|^facebookexternalhit|feed|google web preview|^ia_archiver|indexer|^java|jakarta|^libwww-perl|^load impact|^magespeedtest|monitor|^Mozilla$|nagios |^\.net|^pinterest|postrank|slurp|spider|uptime|^wget|yandex"
#: File extensions of resource types that a warmer may block.
RESOURCES = {"css": "css|[to]tf|eot|woff2?", "js": "js", "images": "svg|ico|gif|png|jpe?g"}


#: What counts as true and false in options, in any case.
TRUE, FALSE = ("true", "yes", "on"), ("false", "no", "off")
#: The wire format's limits of small and medium numbers and lengths.
SMALL, LARGE = 8, 72


def matches(a: Column, b: Column) -> Column:
    """Equality but for ASCII case."""
    return _low(a) == _low(b)


def starts_with(text: Column, prefix: Column) -> Column:
    return F.startswith(_low(text), _low(prefix))


def ends_with(text: Column, suffix: Column) -> Column:
    return F.endswith(_low(text), _low(suffix))


def _low(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def boolean(text: Column) -> Column:
    """True, false, or null for anything else."""
    return F.when(_low(text).isin(*TRUE), True).when(_low(text).isin(*FALSE), False)


def signed(text: Column) -> Column:
    """A signed integer as C reads it; null if it is none."""
    size = integer(F.regexp_replace(text, "^[+-]", ""))
    return F.when(text.startswith("-"), -size).otherwise(size)


def number(text: Column) -> Column:
    """A decimal number; null if it is none."""
    return F.when(text.rlike(r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"), text.try_cast("double"))


def padded(values: Column, n: int) -> Column:
    """A list of n values: those that are missing at its end repeat the last one."""
    return F.when(F.size(values) > 0, F.slice(F.concat(values, F.array_repeat(F.element_at(values, -1), n)), 1, n))


def moment(text: Column, now: Column, future: bool = False) -> Column:
    """Epoch milliseconds of a warmer's time: a number with s, m, h, d or w before (future: after) now, which is in
    milliseconds too, or YYYY-MM-DD HH:MM:SS (blanks or _ between); null if ill-formed or on the wrong side of now."""
    ago = F.regexp_extract(text, "^([0-9]+)([smhdw])$", 1)
    unit = F.lit(0).cast("long")
    for letter, seconds in DURATIONS.items():
        unit = F.when(F.substring(text, -1, 1) == letter, seconds * 1000).otherwise(unit)
    offset = ago.cast("long") * unit * (1 if future else -1)
    named = F.when(text.rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}[ _]+[0-9]{2}:[0-9]{2}:[0-9]{2}$"), F.unix_timestamp(F.try_to_timestamp(F.regexp_replace(text, "[ _]+", " "), F.lit("yyyy-MM-dd HH:mm:ss"))) * 1000)
    return F.when(ago != "", now + offset).when(named >= now if future else named <= now, named)


def unescaped(text: Column) -> Column:
    r"""A quoted string's escapes resolved: \r, \n, \t, two hex digits for a character, and any other character for itself."""
    found = F.regexp_extract_all(text, F.lit(r"(?s)\\[0-9a-fA-F]{2}|\\.|[^\\]+|\\$"), 0)
    named = {r"\r": "\r", r"\n": "\n", r"\t": "\t"}

    def one(t: Column) -> Column:
        code = F.when(t.rlike(r"^\\[0-9a-fA-F]{2}$"), F.char(F.conv(F.substring(t, 2, 2), 16, 10).cast("int")))
        for k, v in named.items():
            code = code.when(t == k, v)
        return code.when(t.rlike(r"(?s)^\\.$"), F.substring(t, 2, 1)).otherwise(t)

    return F.array_join(F.transform(found, one), "")


def _bytes_of(n: Column) -> Column:
    """Bytes of a number from 0 on, without leading zeros but one at least."""
    return F.when(n < 1 << 8, 1).when(n < 1 << 16, 2).when(n < 1 << 24, 3).otherwise(4)


def integer_chunk(n: Column) -> Column:
    """Bytes of an integer on the wire."""
    return F.when((n >= -8) & (n < LARGE), 1).when(n < 0, 1 + _bytes_of(-9 - n)).otherwise(1 + _bytes_of(n - LARGE))


def string_chunk(text: Column) -> Column:
    """Bytes of a string on the wire, its own included."""
    n = F.octet_length(text)
    return n + F.when(n < LARGE, 1).otherwise(1 + _bytes_of(n - LARGE))


def list_chunk(texts: Column) -> Column:
    """Bytes of a list of strings on the wire; each string has its length before it."""
    n, each = F.size(texts), F.transform(texts, lambda t: F.octet_length(t) + vlq_overhead(F.octet_length(t)))
    return F.when(n < LARGE, 1).otherwise(1 + _bytes_of(n - LARGE)) + F.aggregate(each, F.lit(0).cast("long"), lambda a, x: a + x)


def integer(text: Column) -> Column:
    """An unsigned integer as C reads it: 0x is hexadecimal, a leading 0 octal; null if it is none."""
    return (
        F.when(text.rlike("^0[xX][0-9a-fA-F]+$"), F.conv(F.substring(text, 3, 32), 16, 10))
        .when(text.rlike("^0[0-7]+$"), F.conv(text, 8, 10))
        .when(text.rlike("^(0|[1-9][0-9]*)$"), text)
        .cast("long")
    )


def _parsed(text: Column, units: dict[str, int]) -> Column:
    letters = "".join(units)
    number = integer(F.regexp_extract(text, f"(?i)^(0x[0-9a-f]+|[0-9]+)([{letters}]?)$", 1))
    unit = F.lower(F.regexp_extract(text, f"(?i)^(0x[0-9a-f]+|[0-9]+)([{letters}]?)$", 2))
    factor = F.lit(1)
    for letter, value in units.items():
        factor = F.when(unit == letter, value).otherwise(factor)
    return number * factor.cast("long")


def parse_duration(text: Column) -> Column:
    """Seconds of a number with an optional s, m, h, d or w; null if it isn't one."""
    return _parsed(text, DURATIONS)


def parse_size(text: Column) -> Column:
    return _parsed(text, SIZES)


def _printed(n: Column, units: dict[str, int]) -> Column:
    """The number in the largest unit that divides it, going up only while each step divides."""
    out = None
    steps = list(units.items())
    for letter, value in reversed(steps[1:]):
        case = (n != 0) & (n % value == 0)
        text = F.concat((n / value).cast("long").cast("string"), F.lit(letter))
        out = F.when(case, text) if out is None else out.when(case, text)
    return out.otherwise(F.concat(n.cast("string"), F.lit(steps[0][0])))


def print_duration(seconds: Column) -> Column:
    return _printed(seconds, DURATIONS)


def print_size(n: Column) -> Column:
    return _printed(n, SIZES)


def mask_pattern(mask: Column) -> Column:
    """A mask, in which * stands for any text, as a pattern for ilike."""
    escaped = F.replace(F.replace(F.replace(mask, F.lit("\\"), F.lit("\\\\")), F.lit("%"), F.lit("\\%")), F.lit("_"), F.lit("\\_"))
    return F.replace(escaped, F.lit("*"), F.lit("%"))


def user_agent(text: Column, warmer: str) -> Column:
    """Class of a user-agent string: 0 unknown (absent), 2 the warmer, 1 a bot, 3 a user."""
    return F.when(text.isNull(), 0).when(text.contains(warmer), 2).when(text.rlike(f"(?i){BOTS}"), 1).otherwise(3)


def vlq_overhead(n: Column) -> Column:
    """Bytes that name the length of a string of n bytes."""
    return F.floor(n / 255) + 1


def blocked(url: Column, css: bool, js: bool, images: bool) -> Column:
    """Whether a warmer that doesn't load these resource types skips the URL: their names are looked for anywhere in it."""
    parts = [RESOURCES[k] for k, load in (("css", css), ("js", js), ("images", images)) if not load]
    return url.rlike("|".join(parts)) if parts else F.lit(False)


def clock(millis: Column) -> Column:
    """MM:SS.mmm of a duration."""
    return F.concat(F.lpad(F.floor(millis / 60_000).cast("string"), 2, "0"), F.lit(":"), F.lpad(F.floor(millis % 60_000 / 1000).cast("string"), 2, "0"), F.lit("."), F.lpad((millis % 1000).cast("string"), 3, "0"))


def rotated(template: Column, ts: Column) -> Column:
    """Name of a rotated file: %s in a template is the date and time of ts, %d its epoch seconds, %% a percent sign; null unless there is exactly one."""
    bare = F.replace(template, F.lit("%%"), F.lit("\x01"))
    places = F.regexp_count(bare, F.lit("%[sd]"))
    named = F.replace(F.replace(bare, F.lit("%s"), F.date_format(F.timestamp_seconds(ts), "yyyyMMddHHmmss")), F.lit("%d"), ts.cast("string"))
    return F.when((places == 1) & (F.regexp_count(bare, F.lit("%")) == 1), F.replace(named, F.lit("\x01"), F.lit("%")))


def shown_time(ts: Column) -> Column:
    return F.date_format(F.timestamp_seconds(ts), "yyyy.MM.dd HH:mm:ss")


def plural(n: Column, noun: str) -> Column:
    return F.concat(n.cast("string"), F.lit(f" {noun}"), F.when(n == 1, "").otherwise("s"))
