"""Name, label and score text as native Column expressions."""

from __future__ import annotations

import re
import sys
import unicodedata
from functools import lru_cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from courtlens import config


# --- headers ----------------------------------------------------------------

def header_name(raw: str) -> str:
    name = re.sub(r"[^a-z0-9]+", "_", str(raw).strip().lower()).strip("_")
    return config.HEADER_ALIASES.get(name, name)


def standardize_columns(df: DataFrame) -> DataFrame:
    """Normalise the header and merge columns that collide afterwards.

    Colliding columns keep, per row, the left-most non-null value. Only metadata
    is touched, so this adds a projection and no job.
    """
    names = [header_name(c) for c in df.columns]
    unique = [f"__c{i}" for i in range(len(names))]
    flat = df.toDF(*unique)
    out = []
    for name in dict.fromkeys(names):
        same = [F.col(u) for u, n in zip(unique, names) if n == name]
        out.append((same[0] if len(same) == 1 else F.coalesce(*same)).alias(name))
    return flat.select(*out)


# --- unicode folding --------------------------------------------------------

@lru_cache(maxsize=1)
def _fold_tables() -> tuple[str, str, dict[str, str]]:
    """ASCII parts of the compatibility decomposition of every character.

    Characters that fold to one ASCII character go in a pair of strings for
    ``translate``; those that fold to several go in a dict.
    """
    single_from, single_to, several = [], [], {}
    for cp in range(0x80, sys.maxunicode + 1):
        if 0xD800 <= cp <= 0xDFFF:
            continue
        ch = chr(cp)
        if not unicodedata.decomposition(ch):
            continue
        ascii_part = "".join(c for c in unicodedata.normalize("NFKD", ch) if ord(c) < 0x80)
        if len(ascii_part) == 1:
            single_from.append(ch)
            single_to.append(ascii_part)
        elif len(ascii_part) > 1:
            several[ch] = ascii_part
    return "".join(single_from), "".join(single_to), several


def _let(value: Column, use) -> Column:
    """``use(value)`` with ``value`` computed once per row."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _char_class(chars) -> str:
    """Regular-expression class of single characters, neighbours merged into ranges."""
    spans: list[list[int]] = []
    for cp in sorted(map(ord, chars)):
        if spans and cp == spans[-1][1] + 1:
            spans[-1][1] = cp
        else:
            spans.append([cp, cp])
    return "[" + "".join(rf"\x{{{a:X}}}-\x{{{b:X}}}" for a, b in spans) + "]"


def ascii_fold(c: Column, drop: str = r"[^\x00-\x7F]+") -> Column:
    """Compatibility-decompose and drop everything outside ASCII (or what ``drop`` matches).

    Characters that fold to several letters are looked up one by one, but only in rows
    that hold one.
    """
    single_from, single_to, several = _fold_tables()
    table = F.str_to_map(
        F.lit("\x01".join(f"{ch}\x02{to}" for ch, to in several.items())),
        F.lit("\x01"), F.lit("\x02"),
    )
    spread = lambda t: F.array_join(
        F.transform(F.split(t, ""), lambda ch: F.coalesce(F.element_at(table, ch), ch)), ""
    )
    rest = lambda t: F.regexp_replace(t, r"[\x00-\x7F]+", "")
    folded = _let(
        F.translate(c, single_from, single_to),
        lambda t: F.when(rest(t).rlike(_char_class(several)), spread(t)).otherwise(t),
    )
    return F.regexp_replace(F.when(c.rlike(r"[^\x00-\x7F]"), folded).otherwise(c), drop, "")


# --- names ------------------------------------------------------------------

def _squeeze(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def clean_name(c: Column) -> Column:
    """Join-safe text: ASCII, lower case, few symbols, single spaces; null becomes ''.

    Text that only needs lower case, most names, passes after one match; the chain of
    replacements runs for the rest. The last step tells Spark that there is no null, or each join by
    the name would clean it once more, in front of every shuffle, to look for one.
    """
    raw = F.coalesce(c.cast("string"), F.lit(""))
    low = F.lower(raw)
    full = F.lower(ascii_fold(raw, r"[^\x00-\x7F]+|['`]+"))
    full = F.replace(full, F.lit("&"), F.lit(" and "))
    full = F.trim(F.regexp_replace(full, r"[^a-z0-9/@().,#:-]+", " "))
    return F.coalesce(F.when(low.rlike(r"[^a-z0-9 /@().,#:-]|  |^ | $"), full).otherwise(low), F.lit(""))


def clean_team(c: Column) -> Column:
    c = clean_name(c)
    return F.when(c.contains("vs"), _squeeze(F.regexp_replace(c, r"\bvs\.?\b", " "))).otherwise(c)


def strip_opponent_noise(c: Column) -> Column:
    """Drop venue marks, rankings, places and tournament titles from an opponent text."""
    c = clean_team(c)
    events = "|".join(config.TOURNAMENT_WORDS)
    for pattern, to in [
        (r"^@\s*", ""),
        (r"\bat\b\s+", ""),
        (r"#\d+", " "),
        (r",.*$", ""),
        (rf"\b({events})\b.*$", ""),
    ]:
        c = F.regexp_replace(c, pattern, to)
    return _squeeze(c)


def _strip(c: Column) -> Column:
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def display_team(c: Column) -> Column:
    """Short team name for display: no rank, brackets, venue mark, date or hyphen.

    Names without any of those marks are returned after one test; '' becomes null.
    """
    full = c
    for pattern in [r"#\d+\s*", r"\(.*?\)", r"^@\s*", r"^vs\.?\s*", r"^at\s*"]:
        full = F.regexp_replace(full, pattern, "")
    parts = F.filter(F.transform(F.split(full, "@"), lambda p: _strip(p)), lambda p: p != "")
    full = F.get(parts, F.lit(0))
    for pattern in [r"\d{2}-\d{2}.*", r"\d{4}.*"]:
        full = F.regexp_replace(full, pattern, "")
    full = _strip(F.replace(full, F.lit("-"), F.lit(" ")))
    marked = c.rlike(r"[#(@-]|^vs|^at|\d{4}|^\s|\s$|^$")
    return F.when(marked, full).otherwise(c)


def compact(c: Column) -> Column:
    return F.regexp_replace(c, "[^a-z0-9]", "")


def composite_id(*parts: Column) -> Column:
    """Parts joined by '::'; null when any part is null."""
    pieces = []
    for p in parts:
        pieces += [F.lit("::"), p.cast("string")]
    return F.concat(*pieces[1:])


# --- classifiers and parsers ------------------------------------------------

def event_family(event: Column, description: Column) -> Column:
    """First matching rule over the two cleaned texts; everything else is 'admin'."""
    e, d = F.coalesce(event, F.lit("")), F.coalesce(description, F.lit(""))
    out = F
    for family, on_event, on_description in config.EVENT_RULES:
        out = out.when(e.rlike(on_event) | d.rlike(on_description), F.lit(family))
    return out.otherwise(F.lit("admin"))


def mentions_first_ball_kill(event: Column, description: Column) -> Column:
    return F.coalesce(event.contains("first ball kill"), F.lit(False)) | F.coalesce(
        description.contains("first ball kill"), F.lit(False)
    )


def role_of(position: Column) -> Column:
    """Role bucket of a cleaned position label."""
    by_role: dict[str, list[str]] = {}
    for label, role in config.ROLE_OF_POSITION.items():
        by_role.setdefault(role, []).append(label)
    out = F
    for role, labels in by_role.items():
        out = out.when(position.isin(labels), F.lit(role))
    return out.otherwise(F.lit("unknown"))


def result_parts(c: Column) -> tuple[Column, Column, Column]:
    """(match won, sets for, sets against) of a text such as 'W 3-1'; zeros if unparsed."""
    pattern = r"^\s*([WL])\s*(\d+)\s*-\s*(\d+)\s*$"
    c = F.coalesce(c, F.lit(""))
    won = (F.regexp_extract(c, pattern, 1) == "W").cast("int")
    sets = [
        F.coalesce(F.regexp_extract(c, pattern, i).try_cast("int"), F.lit(0)) for i in (2, 3)
    ]
    return won, sets[0], sets[1]


def score_parts(c: Column) -> tuple[Column, Column]:
    """(away, home) points of an 'away-home' text, null when not a score."""
    pattern = r"^\s*(\d+)\s*-\s*(\d+)\s*$"
    return tuple(F.regexp_extract(c, pattern, i).try_cast("int") for i in (1, 2))


# --- display helpers --------------------------------------------------------

def contains_any(columns: list[str], needle: str) -> Column:
    """Literal, case-insensitive search over several columns."""
    needle = needle.strip().lower()
    hit = F.lit(False)
    for c in columns:
        hit = hit | F.lower(F.coalesce(F.col(c), F.lit(""))).contains(needle)
    return hit


def player_label(rank: Column, player: Column, team: Column) -> Column:
    return F.concat(
        F.lit("#"), F.coalesce(rank, F.lit(0)).cast("bigint").cast("string"),
        F.lit(" | "), F.coalesce(player, F.lit("Unknown")),
        F.lit(" | "), F.coalesce(team, F.lit("Unknown")),
    )


def join_reasons(*flag_and_text: tuple[Column, Column]) -> Column:
    """Texts of the raised flags joined by '; ', '' when none is raised."""
    return F.concat_ws("; ", *[F.when(flag, text) for flag, text in flag_and_text])
