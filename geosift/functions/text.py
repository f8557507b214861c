"""Text normalisation and tolerant casts.

Patterns carry (?U), or (?iuU) where case doesn't matter, so that letters and
white space are those of Unicode.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ADDRESS_KEY_CHARS = 280
#: Fixed words that the tolerant boolean takes, in two languages.
YES = ("1", "true", "yes", "y", "да", "д", "истина")
NO = ("0", "false", "no", "n", "нет", "н", "ложь")


def clean_text(c: Column) -> Column:
    """Null as empty, every run of white space (no-break spaces too) as one space, trimmed."""
    return F.trim(F.regexp_replace(F.coalesce(c.cast("string"), F.lit("")), r"(?U)\s+", " "))


def norm_text(c: Column) -> Column:
    return F.lower(clean_text(c))


def address_key(c: Column) -> Column:
    """The key of the geocode cache: normalised, its first 280 characters."""
    return F.substring(norm_text(c), 1, ADDRESS_KEY_CHARS)


def address_key_or_null(c: Column) -> Column:
    """The key, for addresses of at least four characters."""
    return F.when(F.length(F.trim(F.coalesce(c, F.lit("")))) >= 4, address_key(c))


def safe_int(c: Column) -> Column:
    return F.trim(c.cast("string")).try_cast("int")


def safe_double(c: Column) -> Column:
    return F.trim(c.cast("string")).try_cast("double")


def tolerant_bool(c: Column) -> Column:
    """Words for yes and no in two languages; anything else, null too, is true."""
    word = F.lower(F.trim(c.cast("string")))
    return F.when(word.isin(*NO), False).when(word.isin(*YES), True).otherwise(True)


def match_words(c: Column) -> Column:
    """Folded words between single spaces, padded with spaces, for phrase lookups."""
    plain = F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"(?U)[^\w\s]", " ")
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(plain, r"(?U)\s+", " ")), F.lit(" "))


def blob(*columns: str) -> Column:
    """The columns' texts, lower-cased, between spaces."""
    return F.lower(F.concat_ws(" ", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns)))


def record_id_hint(query: str) -> int | None:
    """A query of one to six digits is also a record id."""
    q = query.strip()
    return int(q) if q.isascii() and q.isdigit() and len(q) <= 6 else None


def like_any(query: str, columns: list[str], escape: bool = False) -> Column:
    """Case-blind substring in any column.

    ``%`` and ``_`` typed by the user are wildcards unless ``escape`` is set.
    """
    q = query.replace("\\", "\\\\")
    if escape:
        q = q.replace("%", "\\%").replace("_", "\\_")
    hit = F.lit(False)
    for c in columns:
        hit = hit | F.coalesce(F.col(c).cast("string").ilike(f"%{q}%"), F.lit(False))
    return hit


def signature(digests: Column) -> Column:
    """SHA-256 of the sorted hex digests, one a line; an aggregate."""
    return F.sha2(F.array_join(F.array_sort(F.collect_list(digests)), "\n"), 256)


def merged_phones(a: Column, b: Column) -> Column:
    """Two phone fields in one, without repeats in another case."""
    parts = F.filter(F.transform(F.array(a, b), lambda p: clean_text(p)), lambda p: p != "")
    kept = F.filter(parts, lambda p, i: (i == 0) | (F.lower(p) != F.lower(F.get(parts, F.lit(0)))))
    return F.array_join(kept, " ; ")


def part_from_name(name: Column, position: Column) -> Column:
    """Part of the register by the file's name, else the first file is part 1 and others part 2."""
    second = name.rlike(r"(?iuU)(?:^|[^0-9a-zа-я])(?:ii|2|часть[\s_-]*(?:ii|2)|part[\s_-]*(?:ii|2)|ч[\s_.-]*(?:ii|2))(?:[^0-9a-zа-я]|$)")
    return F.when(second, 2).when(position == 1, 1).otherwise(2)


def collapse_repeats(items: Column) -> Column:
    """An array without blanks and without items that equal, case aside, the one before."""
    parts = F.filter(F.transform(items, lambda p: F.trim(p)), lambda p: p != "")
    fold = lambda p: F.lower(F.regexp_replace(p, r"(?U)\s+", " "))
    return F.filter(parts, lambda p, i: (i == 0) | (fold(p) != fold(F.get(parts, i - 1))))
