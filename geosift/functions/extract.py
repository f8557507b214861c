"""Fields of a register record out of its object and owner texts, as column expressions.

``let`` binds a value that an expression uses more than once, so that plans grow
with the number of steps and not with its powers.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import patterns as P
from .text import clean_text, collapse_repeats

_S = r"(?U)\s"
_TO_END = 1 << 20


def let(c: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that it uses more than once."""
    return F.get(F.transform(F.array(c), body), F.lit(0))


def pipe(c: Column, *steps: Callable[[Column], Column]) -> Column:
    return reduce(let, steps, c)


def _text(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def strip(c: Column, chars: str = r"\s") -> Column:
    """Without the given characters (of a class) at either end."""
    return F.regexp_replace(_text(c), rf"(?U)^[{chars}]+|[{chars}]+$", "")


def squeeze(c: Column) -> Column:
    return F.regexp_replace(_text(c), rf"{_S}+", " ")


def until(c: Column, pattern: str) -> Column:
    """The text before the first match."""
    return F.regexp_replace(_text(c), f"(?s)(?:{pattern}).*$", "")


def place_of(c: Column, pattern: str) -> Column:
    """Code points before the first match; null without one."""
    return let(_text(c), lambda s: F.when(s.rlike(pattern), F.length(until(s, pattern))))


def lines_of(c: Column) -> Column:
    """Trimmed non-blank lines."""
    split = F.split(_text(c), r"\r\n|[\n\r\f\x0b\x1c-\x1e\x85  ]")
    return F.filter(F.transform(split, lambda x: strip(x)), lambda x: x != "")


def parts_of(c: Column, sep: str) -> Column:
    return F.filter(F.transform(F.split(c, sep), lambda x: strip(x)), lambda x: x != "")


def words(c: Column) -> Column:
    return F.size(F.regexp_extract_all(_text(c), F.lit(P.WORD), F.lit(0)))


def when_has(c: Column, pattern: str, points: int) -> Column:
    return F.when(c.rlike(pattern), points).otherwise(0)


# Lines and codes ---------------------------------------------------------------------------------


def code_line(c: Column) -> Column:
    """struct(code, rest) of a line that begins a block, else null: seven digits, apart or together."""

    def found(s: Column, pattern: str) -> Column:
        return F.struct(F.regexp_replace(F.regexp_extract(s, pattern, 1), rf"{_S}+", "").alias("code"), strip(F.regexp_extract(s, pattern, 2)).alias("rest"))

    line = F.regexp_replace(F.translate(strip(c), "０１２３４５６７８９", "0123456789"), P.LINE_JUNK, "")
    return let(line, lambda s: F.when(s.rlike(P.SPACED_CODE), found(s, P.SPACED_CODE)).when(s.rlike(P.PLAIN_CODE), found(s, P.PLAIN_CODE)))


def preprocess(c: Column) -> Column:
    """Line breaks where a record's parts begin; labels and their short numbers on one line."""
    t = F.regexp_replace(F.regexp_replace(_text(c), P.ZERO_WIDTH, ""), r"\r\n|\r|\f", "\n")
    t = F.regexp_replace(t, rf"{P.I}((?:Объект|Object)(?:\s*№\.?)?)\s*\n\s*(\d{{1,5}})\b", "$1 $2")
    t = F.regexp_replace(t, r"(?<=[^\n\r\d])(\d{7})(?!\d)", "\n$1")
    t = F.regexp_replace(t, rf"{P.I}(?<!\n)\s+(?={P.OBJECT_LABEL}\d+\b)", "\n")
    return F.regexp_replace(t, rf"{P.I}(?<!\n)\s+(?=Собственник\b)", "\n")


def posted(c: Column) -> Column:
    """The text with a sign before each postcode."""
    return F.regexp_replace(F.translate(_text(c), P.POST_SIGN, ""), P.POSTCODE_IN_TEXT, f"{P.POST_SIGN}$0")


def has_post(c: Column) -> Column:
    return F.contains(c, F.lit(P.POST_SIGN))


def noise_line(c: Column) -> Column:
    """Blank, a page's footer or a lone date."""
    return let(strip(c), lambda s: (s == "") | s.rlike(P.PAGE_FOOTER) | s.rlike(P.DATE_LINE))


def service_line(c: Column) -> Column:
    return let(strip(squeeze(c), r"\s,;:."), lambda s: (s == "") | s.rlike(P.SERVICE_LINE))


def trim_tail(c: Column) -> Column:
    """Without page footers, phones and long numbers at the end."""
    return strip(until(strip(c), P.TAIL))


def clean_owner(blob: Column) -> Column:
    return strip(squeeze(trim_tail(blob)))


# Names -------------------------------------------------------------------------------------------


def _upto(s: Column, at: Column) -> Column:
    return let(at, lambda n: F.when(n.isNotNull(), F.substring(s, F.lit(1), n)).otherwise(s))


def clean_object_name(name: Column, waste_type: Column) -> Column:
    def past(s: Column, pattern: str, least: int) -> Column:
        return let(place_of(s, pattern), lambda n: F.when(n > least, n))

    def without_waste(s: Column) -> Column:
        rest = lambda w: F.regexp_replace(F.substring(s, F.length(w) + 1, F.length(s)), r"(?U)^[\s,;:.\\\-–—]+", "")
        return let(clean_text(waste_type), lambda w: F.when((w != "") & F.startswith(F.lower(s), F.lower(w)), rest(w)).otherwise(s))

    plain = F.regexp_replace(F.regexp_replace(strip(squeeze(name), r"\s,;:."), P.SERVICE_PHRASE, " "), P.SERVICE_REST, " ")
    return pipe(
        strip(plain),
        without_waste,
        lambda s: F.regexp_replace(s, P.STATE_OWNER_TAIL, ""),
        lambda s: _upto(s, past(s, P.LEGAL_TAIL, 12)),
        lambda s: _upto(s, F.least(past(s, P.POSTCODE_IN_TEXT, 8), past(s, P.NAME_PLACE_MARK, 12))),
        lambda s: strip(squeeze(s), r"\s,;:.\"'«»*\-–—"),
        lambda s: F.when(s.rlike(rf"{P.I}^(?:—|-|объект(?:ы)?)$"), "").otherwise(s),
    )


def _best(scored: Column) -> Column:
    """Of (points, text) structs the highest by points, then length, then folded order."""
    ranked = F.transform(scored, lambda x: F.struct((-x["points"]).alias("low"), (-F.length(x["text"])).alias("size"), F.lower(x["text"]).alias("fold"), x["text"].alias("text"), x["points"].alias("points")))
    return F.get(F.array_sort(ranked), F.lit(0))


def canonical_object(blob: Column, waste_type: Column) -> Column:
    """The most telling line of the object's text."""
    kept = F.filter(lines_of(posted(blob)), lambda x: ~service_line(x) & ~has_post(x))
    cleaned = F.filter(F.transform(kept, lambda x: clean_object_name(x, waste_type)), lambda x: x != "")

    def points(s: Column) -> Column:
        return (
            when_has(s, P.EQUIPMENT, 70) + F.least(F.lit(18), words(s)) + F.least(F.lit(12), F.floor(F.length(s) / 14))
            + when_has(s, P.OBJECT_SERVICE, -45) + when_has(s, P.OBJECT_GENERIC, -16)
        ).cast("int")

    return F.coalesce(_best(F.transform(cleaned, lambda s: F.struct(points(s).alias("points"), s.alias("text"))))["text"], F.lit(""))


def canonical_owner(blob: Column) -> Column:
    """The owner's line: among those with a legal form where any has one; blank below 35 points."""
    tidy = F.transform(lines_of(posted(blob)), lambda x: strip(squeeze(x), r"\s,;"))
    kept = F.filter(tidy, lambda x: ~noise_line(x) & ~F.lower(x).isin("собственник", "объект") & ~has_post(x) & ~x.rlike(P.PHONE_MARK))

    def points(s: Column) -> Column:
        return (
            when_has(s, P.LEGAL_FORM, 80) + when_has(s, P.ORGANISATION, 38) + when_has(s, '["«»]', 8) + F.least(F.lit(24), words(s))
            + F.least(F.lit(12), F.floor(F.length(s) / 12)) + when_has(s, P.OWNER_SERVICE, -45) + when_has(s, P.OWNER_TECHNICAL, -10) + when_has(s, P.GENERIC_OWNER, -65)
        ).cast("int")

    chosen = lambda rows: let(F.filter(rows, lambda x: x.rlike(P.LEGAL_FORM)), lambda few: F.when(F.size(few) > 0, few).otherwise(rows))
    scored = F.transform(let(kept, chosen), lambda s: F.struct(points(s).alias("points"), s.alias("text")))
    return let(_best(scored), lambda best: F.when(best["points"] >= 35, best["text"]).otherwise(""))


def owner_hint(text: Column) -> Column:
    """The likeliest owner among comma or semicolon parts; the first of equals, blank below 40 points."""

    def cut(pattern: str, least: int) -> Callable[[Column], Column]:
        return lambda s: let(place_of(s, pattern), lambda at: F.when(at.isNull(), s).when(at > least, F.substring(s, F.lit(1), at)).otherwise(""))

    def unnumbered(s: Column) -> Column:
        numbered = s.rlike(r"(?U)^\d{1,4}\s+") & (s.rlike(P.LEGAL_FORM) | s.rlike(P.ORGANISATION))
        return F.when(numbered, F.regexp_replace(s, r"(?U)^\d{1,4}\s+", "")).otherwise(s)

    def candidate(s: Column) -> Column:
        return pipe(s, cut(P.POST_SIGN, 6), cut(P.PHONE_MARK, 8), cut(P.PLACE_MARK, 10), lambda x: strip(x, r"\s,;:.\"'«»"), unnumbered)

    def points(s: Column) -> Column:
        return (when_has(s, P.LEGAL_FORM, 70) + when_has(s, P.ORGANISATION, 40) + when_has(s, '["«»]', 8) + F.least(F.lit(22), F.floor(F.length(s) / 7)) + when_has(s, P.GENERIC_OWNER, -60)).cast("int")

    found = F.filter(F.transform(parts_of(posted(clean_text(text)), "[;,]"), candidate), lambda x: x != "")
    ranked = F.array_sort(F.transform(found, lambda s, i: F.struct((-points(s)).alias("p"), i.alias("i"), s.alias("s"))))
    return let(F.get(ranked, F.lit(0)), lambda best: F.when(best["p"] <= -40, best["s"]).otherwise(""))


def owner_noise(c: Column) -> Column:
    return let(clean_text(c), lambda s: noise_line(s) | s.rlike(P.POSTCODE_IN_TEXT) | s.rlike(P.PHONE_MARK) | s.rlike(P.PLACE_MARK))


def owner_name(owner: Column, obj: Column, address: Column, name: Column | None = None) -> Column:
    """Canonical line, else a hint from all texts, else the name part (``name`` if it is known already), else the cleaned text."""
    name = name_and_address(owner)["name"] if name is None else name
    some = lambda c: let(c, lambda s: F.when(s != "", s))
    return F.coalesce(
        some(canonical_owner(owner)), some(owner_hint(F.concat_ws(" ", _text(owner), _text(obj), _text(address)))),
        let(name, lambda s: F.when((F.length(s) >= 6) & ~owner_noise(s), s)),
        let(clean_owner(owner), lambda s: F.when(~owner_noise(s), s)), F.lit(""),
    )


# Addresses ---------------------------------------------------------------------------------------


def name_and_address(blob: Column) -> Column:
    """struct(name, address): a fold over the lines; a postcode with a street, or far into its line, begins the address."""
    kept = F.filter(lines_of(blob), lambda x: ~service_line(x))
    none = F.array().cast("array<string>")
    begin = F.struct(F.lit(0).alias("phase"), none.alias("name"), none.alias("address"))

    def step(acc: Column, line: Column) -> Column:
        at = F.coalesce(place_of(line, P.POSTCODE_STREET), let(place_of(line, P.POSTCODE_COMMA), lambda n: F.when(n >= 12, n)))
        state = lambda phase, name, address: F.struct(F.lit(phase).alias("phase"), name.alias("name"), address.alias("address"))
        more = lambda items, x: F.concat(items, F.filter(F.array(x), lambda y: y != ""))
        began = lambda n: state(1, more(acc["name"], strip(F.substring(line, F.lit(1), n))), more(acc["address"], strip(F.substring(line, n + 1, F.length(line)))))
        before = let(at, lambda n: F.when(n.isNotNull(), began(n)).otherwise(state(0, more(acc["name"], line), acc["address"])))
        hint = line.rlike(P.ADDRESS_LINE) | line.rlike(P.POSTCODE_COMMA)
        after = F.when(hint, state(1, acc["name"], more(acc["address"], line))).otherwise(state(1, more(acc["name"], line), acc["address"]))
        ended = (acc["phase"] == 2) | F.startswith(line, F.lit("Собственник"))
        return F.when(ended, state(2, acc["name"], acc["address"])).when(acc["phase"] == 0, before).otherwise(after)

    def result(done: Column) -> Column:
        name = strip(squeeze(F.array_join(done["name"], " ")))
        address = trim_tail(squeeze(F.array_join(done["address"], " ")))
        return let(name, lambda n: F.struct(F.when(n == "", F.substring(clean_text(blob), 1, 240)).otherwise(n).alias("name"), address.alias("address")))

    return F.aggregate(kept, begin, step, result)


def address_hint(c: Column) -> Column:
    """The first street-like fragment; null without one."""
    hint = F.regexp_extract(clean_text(c), P.ADDRESS_HINT, 0)
    hint = strip(F.regexp_replace(hint, rf"{P.I}\b(?:предприятие|использует|принимает)\b.*$", ""))
    return let(F.regexp_replace(hint, r"(?U)[,\s]+$", ""), lambda s: F.when(s != "", s))


def tidy_commas(c: Column) -> Column:
    s = F.regexp_replace(F.regexp_replace(c, r"(?U)\s+,", ","), r"(?U),(?:\s*,)+", ",")
    return strip(F.regexp_replace(s, r"(?U)[,\s]+$", ""))


def dedupe_locality(c: Column) -> Column:
    """Later repeats of the first locality go."""

    def without(s: Column, f: Column) -> Column:
        upto = f["at"] + F.length(f["town"])
        rest = F.substring(s, upto + 1, F.length(s))
        same = F.filter(F.regexp_extract_all(rest, F.lit(P.LOCALITY), F.lit(0)), lambda x: F.lower(squeeze(x)) == F.lower(squeeze(f["town"])))
        gone = lambda found: F.aggregate(F.array_distinct(found), rest, lambda acc, x: F.replace(acc, x, F.lit("")))
        return let(same, lambda found: F.when(F.size(found) == 0, s).otherwise(tidy_commas(F.concat(F.substring(s, F.lit(1), upto), gone(found)))))

    first = lambda s: F.struct(F.regexp_extract(s, P.LOCALITY, 0).alias("town"), place_of(s, P.LOCALITY).alias("at"))
    return let(clean_text(c), lambda s: let(first(s), lambda f: F.when(f["at"].isNull(), s).otherwise(without(s, f))))


def collapse_commas(c: Column) -> Column:
    return let(clean_text(c), lambda s: F.when(F.contains(s, F.lit(",")), F.array_join(collapse_repeats(F.split(s, ",")), ", ")).otherwise(s))


def clean_address(c: Column) -> Column:
    """Without phones at the end, repeated localities and the placeholder for a missing town."""
    s = F.regexp_replace(clean_text(c), r"(?U)(?:,\s*|\s+)\(?0\d{2,4}\)?(?:[\s\-–]?\d){5,}\s*$", "")
    s = F.regexp_replace(s, r"(?U)(?:,\s*|\s+)8-0\d{2,4}(?:-\d{2,}){2,5}\s*$", "")
    town = lambda x: F.lower(squeeze(F.regexp_extract(x, P.LOCALITY_PART, 1)))
    named = F.transform(parts_of(s, ","), lambda x: F.struct(x.alias("part"), town(x).alias("town")))
    real = F.filter(named, lambda x: ~F.contains(x["town"], F.lit("не указано")))
    kept = let(real, lambda all_: F.filter(all_, lambda x, i: (x["town"] == "") | (F.array_position(all_["town"], x["town"]) == i + 1)))
    return tidy_commas(F.array_join(F.transform(kept, lambda x: x["part"]), ", "))


def _after_postcode(s: Column, town: Column) -> Column:
    """The town put after the postcode that the text begins with."""
    return tidy_commas(F.concat(F.substring(s, 1, 6), F.lit(", "), town, F.lit(", "), F.regexp_replace(F.substring(s, 7, _TO_END), r"(?U)^\s*,?\s*", "")))


def with_locality(address: Column, *sources: Column) -> Column:
    """The address with a town: where it has none, the first one of the sources, after the postcode or in front."""
    town = F.regexp_replace(F.regexp_extract(clean_text(F.concat_ws(" ", *(_text(x) for x in sources))), P.LOCALITY, 0), r"(?U)[,\s]+$", "")

    def placed(s: Column, t: Column) -> Column:
        put = F.when(~s.rlike(P.POSTCODE), tidy_commas(F.concat(t, F.lit(", "), s))).when(s.rlike(r"(?U)^\d{6}\b"), _after_postcode(s, t)).otherwise(tidy_commas(s))
        return F.when((s == "") | s.rlike(P.LOCALITY) | (F.length(t) < 3), s).otherwise(put)

    return dedupe_locality(let(clean_text(address), lambda s: let(town, lambda t: placed(s, t))))


def repair_address(address: Column, owner: Column, obj: Column) -> Column:
    """A space after letter, dot and digit; a broken town replaced by a street from the other texts."""
    spaced = F.regexp_replace(clean_text(address), r"([А-Яа-яA-Za-z])\.(\d)", "$1. $2")
    broken = lambda s: s.rlike(rf"{P.I}^\d{{6}},?\s*г\.\s*\d+\s*$") | s.rlike(rf"{P.I}^\d{{6}},?.*[, ]г\.\s*$")
    hint = F.coalesce(address_hint(owner), address_hint(obj))
    return let(spaced, lambda s: F.when(broken(s), F.coalesce(F.concat(F.substring(s, 1, 6), F.lit(", "), hint), s)).otherwise(s))


def postal_lines(*blobs: Column) -> Column:
    """The first line with a postcode, and the short line after it that goes on with it."""

    def of(blob: Column) -> Column:
        goes_on = lambda x: x.isNotNull() & ~has_post(x) & ~x.rlike(P.OWNER_START) & ~x.rlike(P.OBJECT_START) & (F.length(x) <= 140)
        joined = lambda x, y: strip(squeeze(F.when(goes_on(y), F.concat(x, F.lit(", "), y)).otherwise(x)), r"\s,;")
        found = lambda all_: F.transform(all_, lambda x, i: F.when(has_post(x), let(F.get(all_, i + 1), lambda y: joined(F.replace(x, F.lit(P.POST_SIGN), F.lit("")), y))))
        return F.get(F.filter(let(lines_of(posted(blob)), found), lambda x: F.length(x) >= 10), F.lit(0))

    return F.coalesce(*(of(b) for b in blobs), F.lit(""))


def repair_truncated_town(address: Column, town: Column) -> Column:
    """A missing or cut-off town filled from its postcode's commonest one.

    Where the address ends in a bare mark the town, which brings its own mark, takes its place.
    """
    ends = rf"{P.I}(?:,\s*|\s+)г\.\s*$"
    stripped = lambda s: strip(F.regexp_replace(s, ends, ""))

    def repaired(s: Column) -> Column:
        known = town.isNotNull() & s.rlike(P.POSTCODE)
        inserted = F.when(s.rlike(r"(?U)^\d{6}\b"), _after_postcode(s, town)).otherwise(tidy_commas(s))
        replaced = F.concat(F.regexp_replace(stripped(s), ",+$", ""), F.lit(", "), town)
        return F.when(~s.rlike(P.LOCALITY_MARK) & known, inserted).when(~s.rlike(ends), s).when(known, replaced).otherwise(stripped(s))

    return let(clean_text(address), repaired)


# Phones and flags --------------------------------------------------------------------------------


def digits(c: Column) -> Column:
    return F.regexp_replace(_text(c), r"\D+", "")


def plausible_phone(c: Column) -> Column:
    most = lambda d: F.when(F.startswith(d, F.lit("375")), 12).when(F.startswith(d, F.lit("80")), 11).otherwise(10)
    return let(digits(c), lambda d: (F.length(d) >= 5) & (F.length(d) <= most(d)))


def phones(*blobs: Column) -> Column:
    """Phones of the texts, pattern by pattern, each number once, twelve at most, joined by "; "."""
    text = F.concat_ws("\n", *(F.when(_text(b) != "", b) for b in blobs))
    raw = let(text, lambda t: F.concat(*(F.regexp_extract_all(t, F.lit(p), F.lit(0)) for p in P.PHONES)))

    def tidy(x: Column) -> Column:
        shorter = lambda s: let(strip(F.regexp_replace(s, r"(?U)\s\d$", "")), lambda t: F.when(plausible_phone(t) & ~plausible_phone(s), t).otherwise(s))
        return let(F.regexp_replace(strip(squeeze(x)), "[.,;]+$", ""), shorter)

    good = F.filter(F.transform(raw, tidy), lambda s: (F.length(s) >= 5) & plausible_phone(s))
    keyed = F.transform(good, lambda s: F.struct(s.alias("shown"), digits(s).alias("key")))
    once = let(keyed, lambda all_: F.filter(all_, lambda x, i: F.array_position(all_["key"], x["key"]) == i + 1))
    return F.array_join(F.transform(F.slice(once, 1, 12), lambda x: x["shown"]), "; ")


def accepts_external(blob: Column) -> Column:
    """Whether the object takes others' waste: by the second ballot box, else by phrases, else yes."""

    def judged(text: Column) -> Column:
        boxes = F.filter(F.transform(F.split(text, r"\r\n|[\n\r\f]"), lambda x: F.regexp_extract_all(x, F.lit(P.BALLOT), F.lit(0))), lambda b: F.size(b) >= 2)
        two = lambda rows: F.filter(rows, lambda b: F.size(b) == 2)
        pair = let(boxes, lambda rows: F.coalesce(F.try_element_at(two(rows), F.lit(-1)), F.get(rows, F.lit(0))))
        second = F.coalesce(F.try_element_at(pair, F.lit(-1)), F.regexp_extract(text, rf"{P.I}Принимает\s+от\s+других\s*({P.BALLOT})", 1))
        refused = text.rlike(rf"{P.I}не\s+принимает\s+(?:отходы?\s+)?от\s+других")
        return let(second, lambda b: F.when(b != "", b != "☐").otherwise(~refused))

    return let(_text(blob), judged)
