"""Respondent names from case titles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .binding import let

# Spellings and the names they stand for.
ALIASES = {
    "TÜRKİYE": "TURKEY",
    "TÜRKIYE": "TURKEY",
    "TURQUIE": "TURKEY",
    "REPUBLIC OF MOLDOVA": "MOLDOVA",
    "THE REPUBLIC OF MOLDOVA": "MOLDOVA",
    '"THE FORMER YUGOSLAV REPUBLIC OF MACEDONIA"': "NORTH MACEDONIA",
    "THE FORMER YUGOSLAV REPUBLIC OF MACEDONIA": "NORTH MACEDONIA",
    '"THE FORMER YOUGOSLAV REPUBLIC OF MACEDONIA"': "NORTH MACEDONIA",
    "THE FORMER YOUGOSLAV REPUBLIC OF MACEDONIA": "NORTH MACEDONIA",
    "FORMER YUGOSLAV REPUBLIC OF MACEDONIA": "NORTH MACEDONIA",
    "THE NETHERLANDS": "NETHERLANDS",
    "THE UNITED KINGDOM": "UNITED KINGDOM",
    "THE CZECH REPUBLIC": "CZECH REPUBLIC",
    "ITALIE": "ITALY",
    "FINLANDE": "FINLAND",
}
# Known names.
KNOWN = (
    "ALBANIA", "ANDORRA", "ARMENIA", "AUSTRIA", "AZERBAIJAN", "BELGIUM", "BOSNIA AND HERZEGOVINA", "BULGARIA", "CROATIA", "CYPRUS", "CZECH REPUBLIC", "DENMARK",
    "ESTONIA", "FINLAND", "FRANCE", "GEORGIA", "GERMANY", "GREECE", "HUNGARY", "ICELAND", "IRELAND", "ITALY", "LATVIA", "LIECHTENSTEIN", "LITHUANIA", "LUXEMBOURG",
    "MALTA", "MOLDOVA", "MONTENEGRO", "NETHERLANDS", "NORTH MACEDONIA", "NORWAY", "POLAND", "PORTUGAL", "ROMANIA", "RUSSIA", "SAN MARINO", "SERBIA", "SLOVAKIA",
    "SLOVENIA", "SPAIN", "SWEDEN", "SWITZERLAND", "TURKEY", "UKRAINE", "UNITED KINGDOM",
)


def _without_suffix(name: Column) -> Column:
    return F.trim(F.regexp_replace(name, r"(?i)\s*\[GC\]\s*$", ""))


def _unquoted(name: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(F.trim(name), r'^"+|"+$', ""), r"^'+|'+$", ""))


def _alias(name: Column) -> Column:
    return F.create_map(*(F.lit(x) for kv in ALIASES.items() for x in kv))[name]


def _known(name: Column) -> Column:
    return name.isin(*KNOWN)


def respondent_of(title: Column) -> Column:
    """The name behind 'v.' or, without one, 'c.', in capitals; null without either."""
    of = lambda sign: F.nullif(F.regexp_extract(title, rf"(?i)\b{sign}\.\s+(.+?)(?:\s*$|\s*\()", 1), F.lit(""))
    name = F.regexp_replace(F.trim(F.coalesce(of("v"), of("c"))), r"\.+$", "")
    return F.upper(_without_suffix(_unquoted(name)))


def normalised(name: Column) -> Column:
    """One spelling of a name."""

    def spell(n: Column) -> Column:
        bare = F.substring(n, F.lit(5), F.length(n))
        endings = [*((k, k) for k in sorted(KNOWN, key=len, reverse=True)), *ALIASES.items()]
        suffix = F.filter(F.array(*(F.struct(F.lit(e).alias("ending"), F.lit(k).alias("known")) for e, k in endings)), lambda x: n.endswith(x["ending"]))
        listed = n.startswith("V. ") | n.startswith("AND ")
        return F.coalesce(_alias(n), F.when(n.startswith("THE "), F.coalesce(_alias(bare), F.when(_known(bare), bare))), F.when(listed & (F.size(suffix) > 0), F.try_element_at(suffix, F.lit(1))["known"]), n)

    return let(_without_suffix(_unquoted(name)), spell)


def needs_extraction(name: Column) -> Column:
    """Whether a name is missing or a left-over of a title."""
    parts = F.split(name, r"\s+")
    broken = F.exists(parts, lambda p: p == "V.") & ~F.forall(parts, lambda p: p.isin("V.", "AND") | (F.length(p) > 3))
    return (name == "UNKNOWN") | name.startswith("V. ") | name.startswith("AND ") | broken


def several(name: Column) -> Column:
    """Whether a name lists several respondents."""
    good = lambda p: ((F.length(p) > 3) & ~p.startswith("V.") & p.rlike(r"^\p{L}+$")) | p.contains(" ")
    return name.contains(" AND ") & F.forall(F.transform(F.split(name, " AND "), lambda p: F.trim(p)), good)


def cleaned(name: Column, title: Column) -> Column:
    """A clean name: extracted anew if need be, normalised, the last of a broken list."""

    def last_of(first: Column) -> Column:
        last = F.trim(F.element_at(F.split(first, " AND "), -1))
        known = _alias(last).isNotNull() | last.isin(*ALIASES.values()) | _known(last)
        return F.when(first.contains(" AND ") & ~several(first) & known, normalised(last)).otherwise(first)

    raw = F.when(needs_extraction(name), F.coalesce(respondent_of(title), name)).otherwise(name)
    return normalised(let(normalised(raw), last_of))
