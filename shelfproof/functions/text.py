"""Text and number columns: cleaning, locale numbers, quantities, entities."""

from __future__ import annotations

from html.entities import name2codepoint

from pyspark.sql import Column
from pyspark.sql import functions as F

from shelfproof.functions.values import cases, col, filled, let, lit, lookup
from shelfproof.rules import locale as L

#: Java regexes fold umlauts and treat NBSP as space only with these flags.
IU = "(?iU)"
U = "(?U)"


def group(c: Column, pattern, index: int = 1) -> Column:
    """``regexp_extract`` with NULL in place of the empty string."""
    return filled(F.regexp_extract(c, pattern, index))


def matches(c: Column, pattern: str) -> Column:
    return F.coalesce(c.rlike(pattern), lit(False))


def squeeze(c: Column) -> Column:
    return F.regexp_replace(c, U + r"[\s\x1c-\x1f]+", " ")


#: What ``clean`` changes, or may change: text without any of it is clean.
UNCLEAN = (r"[\t-\r\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000" + L.INVISIBLE
           + r"]|[ (\[] | [,.;:!?%)\]\-]|\A | \z")


def clean(c: Column) -> Column:
    """Visible text: no bidi marks, single spaces, punctuation rejoined.  Most texts are clean and only looked through."""
    return let(F.coalesce(c, lit("")), lambda t: F.when(t.rlike(UNCLEAN), _cleaned(t)).otherwise(t))


def _cleaned(c: Column) -> Column:
    out = F.translate(c, L.INVISIBLE, "")
    out = squeeze(out)
    out = F.regexp_replace(out, r" ([,.;:!?%)\]])", "$1")
    out = F.regexp_replace(out, U + r"(?<=\w) (-[^\W\d_])", "$1")
    return F.trim(F.regexp_replace(out, r"([(\[]) ", "$1"))


def replace_matches(c: Column, pattern: str, change) -> Column:
    """Replace every match by ``change(match)`` in one pass over the text."""
    return F.array_join(
        F.zip_with(F.split(c, pattern, -1),
                   F.regexp_extract_all(c, lit(pattern), lit(0)),
                   lambda gap, hit: F.concat(gap, F.coalesce(change(hit), lit("")))), "")


ENTITY = r"&(?:[a-zA-Z][a-zA-Z0-9]{1,8}|#\d{1,5}|#[xX][0-9a-fA-F]{1,4});"


def _code_point(hex_digits: Column) -> Column:
    """The character of a numeric reference, as browsers read it.

    Bytes 80 to 9F are those of Windows-1252, halves of a surrogate pair are replaced, other controls are dropped.
    """
    old = {str(n): bytes([n]).decode("cp1252", "ignore") for n in range(0x80, 0xA0)}
    n = F.conv(hex_digits, 16, 10).cast("int")
    dropped = n.between(1, 8) | (n == 11) | n.between(14, 31) | (n == 127) | n.between(0xFDD0, 0xFDEF) | (n % 65536 >= 65534)
    return cases(
        (n.between(0x80, 0x9F), F.coalesce(filled(lookup(old, n.cast("string"))),
                                           F.decode(F.unhex(F.lpad(hex_digits, 8, "0")), "UTF-32"))),
        ((n == 0) | n.between(0xD800, 0xDFFF), lit("\ufffd")), (dropped, lit("")),
        otherwise=F.decode(F.unhex(F.lpad(hex_digits, 8, "0")), "UTF-32"))


def decode_entities(c: Column) -> Column:
    """Undo one extra round of HTML escaping; text without an entity is kept as it is."""
    names = {name: chr(point) for name, point in {**name2codepoint, "apos": 39}.items()}

    def one(hit: Column) -> Column:
        body = F.regexp_extract(hit, r"&#?(.*);", 1)
        return F.coalesce(cases(
            (hit.rlike(r"^&#[xX]"), _code_point(F.substr(body, lit(2)))),
            (hit.rlike(r"^&#"), _code_point(F.hex(body.cast("bigint")))),
            otherwise=lookup(names, body)), hit)

    return F.when(matches(c, ENTITY), clean(replace_matches(c, ENTITY, one))).otherwise(c)


NUMBER = r"-?\d[\d., ]*\d|-?\d"


def number(c: Column, decimal=",") -> Column:
    """First number of a text in a locale whose decimal mark is ``decimal``.

    The separator that comes last is the decimal mark, except that a single
    kind of separator which repeats, or which stands before exactly three
    digits and is not the locale's own mark, only groups.
    """
    raw = F.replace(F.regexp_extract(clean(c.cast("string")), NUMBER, 0), lit(" "), lit(""))

    def read(r: Column) -> Column:
        parts = F.struct(F.replace(F.replace(r, lit(","), lit("")), lit("."), lit("")).alias("plain"),
                         F.substring_index(F.replace(r, lit(","), lit(".")), ".", -1).alias("tail"))

        def marked(x: Column) -> Column:
            after = F.length(x["tail"])
            mark = F.substr(r, F.length(r) - after, lit(1))
            both = r.contains(".") & r.contains(",")
            grouping = ~both & ((F.length(r) - F.length(x["plain"]) > 1) | ((after == 3) & (mark != col(decimal))))
            split = F.concat(F.substr(x["plain"], lit(1), F.length(x["plain"]) - after), lit("."), x["tail"])
            return F.when(grouping, x["plain"]).otherwise(split)

        return F.when(r.contains(".") | r.contains(","), let(parts, marked)).otherwise(r).try_cast("double")

    return let(raw, read)


def whole_number(c: Column, decimal=",") -> Column:
    """The first number when it has no fraction, else NULL."""
    return let(number(c, decimal), lambda n: F.when(n == F.floor(n), n.try_cast("bigint")))


UNIT_NAMES = "|".join(sorted(L.UNITS, key=len, reverse=True))


def quantity(c: Column, decimal=",") -> Column:
    """``STRUCT<amount, unit, base>`` in grams or millilitres, NULL without a unit."""
    text = F.replace(F.lower(clean(c.cast("string"))), lit("×"), lit("x"))

    def read(t: Column) -> Column:
        times = F.coalesce(group(t, r"^\s*(\d+)\s*x\s*(.+)$", 1).cast("double"), lit(1.0))
        body = F.coalesce(group(t, r"^\s*(\d+)\s*x\s*(.+)$", 2), t)
        pattern = U + r"(\d[\d., ]*)\s*(" + UNIT_NAMES + r")\b"
        name = group(body, pattern, 2)
        amount = number(group(body, pattern, 1), decimal) * times
        # An amount has a digit, so a text without one is not searched for units.
        return let(F.when(t.rlike("[0-9]"), F.struct(name.alias("name"), amount.alias("amount"))), found)

    def found(x: Column) -> Column:
        name, amount = x["name"], x["amount"]
        factor = lookup({k: v[1] for k, v in L.UNITS.items()}, name)
        return F.when(name.isNotNull() & amount.isNotNull(), F.struct(
            amount.alias("amount"),
            lookup({k: v[0] for k, v in L.UNITS.items()}, name).alias("unit"),
            (amount * factor).alias("base")))

    return let(text, read)


def word_pattern(stem, language) -> Column:
    """Pattern for a word stem: German may continue it into a compound, others may not.

    An empty stem is an error, raised by the task that meets it.
    """
    stem, language = col(stem), col(language)
    escaped = F.regexp_replace(stem, r"([^\w\s])", r"\\$1")
    pattern = F.concat(lit(IU + r"\b"), escaped,
                       F.when(language == "de", lit("")).otherwise(lit(r"\b")))
    return F.when(F.length(F.trim(F.coalesce(stem, lit("")))) == 0,
                  F.raise_error(lit("word stem must not be empty"))).otherwise(pattern)


ISO_STAMP = r"^\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}(:\d{2}([.,]\d{1,9})?)?(Z|[+-]\d{2}:?\d{2})?)?$"


def timestamp(c: Column) -> Column:
    """ISO stamp in UTC; a missing or unreadable stamp is older than any real one.

    A date must be whole: a time or a year alone says nothing and does not become today or 1 January.
    """
    dashed = F.regexp_replace(F.trim(c), r"^(\d{4})(\d{2})(\d{2})(?=$|[T ])", "$1-$2-$3")
    return F.coalesce(F.when(dashed.rlike(ISO_STAMP), F.try_to_timestamp(F.translate(dashed, ",", "."))),
                      lit("0001-01-01 00:00:00").cast("timestamp"))
