"""Tokens, masking and roles as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# A token is a run of letters and digits of the lower-cased text.
TOKEN_PATTERN = r"[\p{L}\p{N}]+"

EMAIL_PATTERN = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"
PHONE_PATTERN = r"\+?[0-9][0-9 ()-]{6,}[0-9]"
DIGITS_PATTERN = r"[0-9]{4,}"
STAND_IN_DIGITS = 24  # 96 bits: no two names of a corpus share a stand-in


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN_PATTERN), F.lit(0))


def content_key(*columns: Column) -> Column:
    """A key that depends on the content alone, so that a rerun gives the same one.

    Every value goes in with its length and a null as a dash, so different rows have different keys.
    """
    texts = [c.cast("string") for c in columns]
    parts = [F.coalesce(F.concat(F.length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]
    return F.sha2(F.concat_ws(",", *parts), 256)


def tag_role(label: Column, marker: str, inside: str = "sales rep", outside: str = "customer") -> Column:
    """``inside`` where the label holds the company's marker in any case."""
    return F.when(F.lower(label).contains(marker.lower()), F.lit(inside)).otherwise(F.lit(outside))


def stand_in(value: Column, salt: str, prefix: str) -> Column:
    """The same value always gets the same stand-in, and no mapping is kept."""
    digest = F.sha2(F.concat_ws("\u0001", F.lit(salt), value), 256)
    return F.concat(F.lit(prefix), F.substring(digest, 1, STAND_IN_DIGITS))


def mask_patterns(text: Column) -> Column:
    """Blank out addresses, phone numbers and long digit runs."""
    has_address = F.contains(text, F.lit("@"))
    masked = F.when(has_address, F.regexp_replace(text, EMAIL_PATTERN, "[email]")).otherwise(text)
    masked = F.regexp_replace(masked, PHONE_PATTERN, "[phone]")
    return F.regexp_replace(masked, DIGITS_PATTERN, "[number]")


def mask_pii(text: Column, names: Column, salt: str, prefix: str = "person-") -> Column:
    """Replace every name of the array by its stand-in, and blank out the patterns in what stands between.

    A name counts only where no letter or digit goes on before or after it. All names are one alternation, longer ones
    first; the text is cut at its matches, and pieces and stand-ins are put together in one go, so the cost does
    not grow with the number of names, and neither the patterns nor a shorter name can touch a stand-in.
    """
    wanted = F.array_sort(
        F.array_distinct(F.filter(names, lambda n: n.isNotNull() & (n != ""))),
        lambda a, b: F.when(F.length(a) > F.length(b), F.lit(-1))
        .when(F.length(a) < F.length(b), F.lit(1))
        .when(a < b, F.lit(-1))
        .when(a > b, F.lit(1))
        .otherwise(F.lit(0)),
    )
    each = F.array_join(F.transform(wanted, _quoted), "|")
    pattern = F.concat(F.lit(r"(?<![\p{L}\p{N}])(?:"), each, F.lit(r")(?![\p{L}\p{N}])"))
    between = F.transform(F.split(text, pattern, -1), mask_patterns)
    found = F.transform(F.regexp_extract_all(text, pattern, F.lit(0)), lambda n: stand_in(n, salt, prefix))
    pieces = F.transform(between, lambda piece, i: F.concat(piece, F.coalesce(F.get(found, i), F.lit(""))))
    return F.when(F.coalesce(F.size(wanted), F.lit(0)) > 0, F.array_join(pieces, "")).otherwise(mask_patterns(text))


def _quoted(name: Column) -> Column:
    """A pattern for the name as it is."""
    return F.concat(F.lit(r"\Q"), F.replace(name, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit(r"\E"))
