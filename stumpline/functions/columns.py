"""Column helpers that the operators share: null-safe ratios, engine-neutral rounding, names of teams and grounds."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def rounded(c: Column, digits: int) -> Column:
    """Rounds by scaling, so that binary halves fall the same way in other engines."""
    scale = F.lit(10.0**digits)
    return F.round(c * scale, 0) / scale


def ratio(num: Column, den: Column, scale: float = 1.0, digits: int | None = None) -> Column:
    """scale * num / den as double, null where den is 0."""
    out = F.lit(float(scale)) * num / F.nullif(den.cast("double"), F.lit(0.0))
    return out if digits is None else rounded(out, digits)


def count_where(condition: Column) -> Column:
    """Rows for which the condition holds (null does not)."""
    return F.count_if(condition)


def sum_where(condition: Column, value: Column) -> Column:
    """Sum of value over such rows; null if there are none."""
    return F.sum(F.when(condition, value))


def as_count(condition: Column) -> Column:
    return F.when(condition, F.lit(1)).otherwise(F.lit(0)).cast("long")


#: Franchises that changed their code, grounds that changed their name.
FRANCHISES = {"KXIP": "PBKS", "DD": "DC", "Kochi": "KTK"}
GROUNDS = {
    "Feroz Shah Kotla": "Arun Jaitley Stadium",
    "Sardar Patel Stadium": "Narendra Modi Stadium",
    "Punjab Cricket Association Stadium": "Punjab Cricket Association IS Bindra Stadium",
    "Sheikh Zayed Stadium": "Zayed Cricket Stadium",
    "Subrata Roy Sahara Stadium": "Maharashtra Cricket Association Stadium",
    "Andhra Cricket Association-Visakhapatnam District Cricket Association Stadium": "Dr. Y.S. Rajasekhara Reddy ACA-VDCA Cricket Stadium",
}


def _renamed(c: Column, names: dict[str, str]) -> Column:
    pairs = [F.lit(x) for item in names.items() for x in item]
    return F.coalesce(F.create_map(*pairs)[c], c)


def franchise(code: Column) -> Column:
    """One code for a franchise over all its seasons."""
    return _renamed(code, FRANCHISES)


def ground(venue: Column) -> Column:
    """The ground without its city, under its present name."""
    return _renamed(F.split_part(venue, F.lit(","), F.lit(1)), GROUNDS)


PHASES = ("powerplay", "middle", "death")


def phase(over: Column, powerplay: int = 6, middle: int = 15) -> Column:
    """powerplay, middle or death by 1-based over number."""
    return F.when(over <= powerplay, PHASES[0]).when(over <= middle, PHASES[1]).otherwise(PHASES[2])


def phase_order(c: Column) -> Column:
    return F.array_position(F.array(*map(F.lit, PHASES)), c)


def overs_text(balls: Column, per_over: int = 6) -> Column:
    """Balls as overs and balls, 17 -> 2.5."""
    balls = balls.cast("long")
    return F.concat(F.floor(balls / per_over).cast("string"), F.lit("."), (balls % per_over).cast("string"))


def score_text(runs: Column, wickets: Column) -> Column:
    return F.concat(runs.cast("string"), F.lit("/"), wickets.cast("string"))


def innings_text(runs: Column, is_out: Column) -> Column:
    """A batter's score, with a star if not out."""
    return F.concat(runs.cast("string"), F.when(is_out, "").otherwise("*"))


def contains_text(c: Column, wanted: str) -> Column:
    """Case-insensitive search for literal text (% and _ are taken as they are)."""
    safe = wanted.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_")
    return c.ilike(f"%{safe}%")


def all_words_in(c: Column, wanted: str) -> Column:
    """Every word of the search lies somewhere in the text, upper and lower case alike."""
    out = F.lit(True)
    for word in wanted.lower().split():
        out &= F.contains(F.lower(c), F.lit(word))
    return out


def won_by(status: Column, what: str) -> Column:
    """The margin in 'won by N runs' or 'won by N wickets', null where there is none."""
    return F.try_to_number(F.nullif(F.regexp_extract(status, rf"won by (\d+) {what}s?", 1), F.lit("")), F.lit("999999")).cast("long")


def rain_revised(status: Column) -> Column:
    """Whether the target was revised (D/L or DL in the status text)."""
    return status.rlike("D/?L")


def is_final(title: Column) -> Column:
    return title.rlike("(?i)^final$")


def is_playoff(title: Column) -> Column:
    return title.ilike("%final%") | title.ilike("%qualif%") | title.ilike("%eliminator%")


def slug(c: Column) -> Column:
    """Lower case, everything but letters and digits to single dashes."""
    return F.regexp_replace(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "-"), "^-|-$", "")


def initials(c: Column, most: int = 4) -> Column:
    """First letters of the words in capitals: the fallback code of an unknown team."""
    return F.upper(F.substring(F.array_join(F.transform(F.split(F.trim(c), r"\s+"), lambda w: F.substring(w, 1, 1)), ""), 1, most))


def without_tags(c: Column) -> Column:
    """Text of an HTML fragment: tags out, common entities resolved, blanks collapsed."""
    out = F.regexp_replace(c, "<[^>]*>", " ")
    for entity, text in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        out = F.replace(out, F.lit(entity), F.lit(text))
    return F.trim(F.regexp_replace(out, r"\s+", " "))


def trailing_number(c: Column) -> Column:
    """The id at the end of a slug such as team-a-vs-team-b-12345."""
    return F.try_to_number(F.nullif(F.regexp_extract(c, r"(\d+)$", 1), F.lit("")), F.lit("9" * 18)).cast("long")
