"""Text functions on columns: names, labels, rosters, links."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType

#: Latin letters that have no decomposition, and their spellings (fixed values).
LATIN = {
    "ß": "ss", "ẞ": "SS", "æ": "ae", "Æ": "AE", "œ": "oe", "Œ": "OE", "ø": "o", "Ø": "O", "ł": "l", "Ł": "L",
    "đ": "d", "Đ": "D", "ð": "d", "Ð": "D", "þ": "th", "Þ": "Th", "ħ": "h", "Ħ": "H", "ı": "i", "ŋ": "n", "Ŋ": "N",
    "ŧ": "t", "Ŧ": "T", "ĸ": "k", "ŉ": "n", "ſ": "s", "ə": "e", "Ə": "E", "’": "'", "‘": "'", "–": "-", "—": "-",
}
_TABLE = str.maketrans(LATIN)


def fold_ascii(text: str | None) -> str | None:
    """A name in ASCII: composed, extra Latin letters spelled out, accents dropped, spaces collapsed. Other scripts are dropped."""
    if text is None:
        return None
    plain = unicodedata.normalize("NFKD", unicodedata.normalize("NFC", text).translate(_TABLE))
    return " ".join(plain.encode("ascii", "ignore").decode().split())


@pandas_udf(StringType())
def ascii_name(names: pd.Series) -> pd.Series:
    """``fold_ascii`` in Arrow batches (Spark has no Unicode normalisation)."""
    return names.map(fold_ascii, na_action="ignore")


def name_key(name: Column) -> Column:
    """Trimmed, lower-cased, white space collapsed."""
    return F.regexp_replace(F.lower(F.trim(name)), r"\s+", " ")


def mapped(value: Column, table: dict[str, str], default: Column | None = None) -> Column:
    """Exact lookup in a small map; what it lacks stays, or becomes ``default``."""
    if not table:
        return F.coalesce(default if default is not None else value, value)
    pairs = [F.lit(x) for kv in table.items() for x in kv]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), value), default if default is not None else value)


def club_name(name: Column, names: dict[str, str], aliases: dict[str, str]) -> Column:
    """A club's canonical name: by the names of result files, or by further spellings, in any case and spacing; others are trimmed."""
    known = {k.lower(): v for k, v in names.items()} | aliases
    return mapped(name_key(name), known, F.trim(name))


def primary_position(position: Column, upper: bool = True) -> Column:
    """First entry of a comma list, trimmed."""
    first = F.trim(F.split(position, ",")[0])
    return F.upper(first) if upper else first


def strip_ordinal(name: Column) -> Column:
    """Without leading digits, dots and spaces."""
    return F.regexp_replace(name, "^[0-9. ]+", "")


def strip_labels(name: Column, labels: list[str]) -> Column:
    """Without one trailing label such as a position, case kept."""
    return F.regexp_replace(name, r"\s+(" + "|".join(sorted(labels, key=len, reverse=True)) + ")$", "")


def before_label(text: Column, labels: list[str]) -> Column:
    """What stands before the first label."""
    return F.trim(F.split(text, r"\s+(?:" + "|".join(sorted(labels, key=len, reverse=True)) + r")\b", 2)[0])


def squad_entries(line: Column) -> Column:
    """``Name (club, on loan), Name (club)`` as an array of entries: cut at commas before a capital."""
    return F.transform(F.split(line, r",\s*(?=\p{Lu}[^()]*\()"), lambda x: F.trim(x))


def entry_name(entry: Column) -> Column:
    return F.trim(F.regexp_extract(entry, r"^([^(]+)", 1))


def entry_club(entry: Column) -> Column:
    """The club in brackets, without what follows its first comma; null without brackets."""
    club = F.trim(F.regexp_extract(entry, r"\(([^,)]*)", 1))
    return F.when(club != "", club)


def roster_entries(raw: Column, starter_minutes: int = 60) -> Column:
    """``Name:90,Other:45`` as an array of (name, minutes, starter); the last colon counts; entries without one have null minutes."""
    def entry(x: Column) -> Column:
        name = F.trim(F.when(x.contains(":"), F.regexp_extract(x, "^(.*):([^:]*)$", 1)).otherwise(x))
        minutes = F.regexp_extract(x, "^(.*):([^:]*)$", 2)
        number = F.when(F.trim(minutes).rlike("^[0-9]+$"), F.trim(minutes).cast("int"))
        return F.struct(name.alias("name"), number.alias("minutes"), F.coalesce(number >= starter_minutes, F.lit(False)).alias("starter"))

    return F.transform(F.filter(F.split(raw, ","), lambda x: F.trim(x) != ""), entry)


def links(html: Column) -> Column:
    """Targets of href attributes, in order, repeats kept."""
    return F.regexp_extract_all(html, F.lit("href=[\"']([^\"']*)[\"']"), F.lit(1))


def number(text: Column) -> Column:
    """A double from text with thousands separators; null where it is none."""
    return F.replace(F.trim(text), F.lit(","), F.lit("")).try_cast("double")


def whole(text: Column) -> Column:
    return number(text).try_cast("bigint")


def last_word(text: Column) -> Column:
    return F.element_at(F.split(F.trim(text), r"\s+"), -1)


def outcome_label(result: Column) -> Column:
    """1, 0, -1 as words."""
    return F.when(result == 1, "home").when(result == 0, "draw").when(result == -1, "away")


def match_label(home: Column, away: Column) -> Column:
    return F.concat_ws(" vs ", home, away)


def score_label(home: Column, away: Column) -> Column:
    return F.concat_ws("-", home.cast("string"), away.cast("string"))


def first_class(text: Column, patterns: list[tuple[str, list[str]]], default: str) -> Column:
    """Class of the first pattern list with a substring of the lower-cased text."""
    low, out = F.lower(text), None
    for name, subs in patterns:
        hit = F.lit(False)
        for s in subs:
            hit = hit | low.contains(s.lower())
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return F.lit(default) if out is None else out.otherwise(default)


def is_digits(text: Column) -> Column:
    return text.rlike("^[0-9]+$")


def contains_either(a: Column, b: Column) -> Column:
    """One holds the other."""
    return a.contains(b) | b.contains(a)


def header_like(columns: list[str], wanted: list[str]) -> str | None:
    """The first column whose lower-cased name holds one of ``wanted``, in the order of ``wanted``."""
    return next((c for w in wanted for c in columns if w.lower() in c.lower()), None)


def flat_names(columns: list[tuple[str, ...] | str]) -> list[str]:
    """Leaf names of multi-level headers; a leaf met before is joined with its parents."""
    seen, found = set(), []
    for c in columns:
        parts = [p for p in ((c,) if isinstance(c, str) else c) if p and not p.startswith("Unnamed")]
        leaf = parts[-1] if parts else ""
        name = leaf if leaf not in seen else "_".join(parts)
        seen.add(leaf)
        found.append(name)
    return found


def distinct_in_order(values: Column) -> Column:
    """An array's different values in the order of their first occurrence; nulls stay, once."""
    return F.array_distinct(values)
