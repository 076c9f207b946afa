"""Names, notes and markup as Column builders."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F


def _accents() -> tuple[str, str]:
    """Every character that decomposes to a bare one and combining marks, and these bare ones."""
    marked, bare = [], []
    for point in range(0xC0, 0x30000):
        parts = unicodedata.normalize("NFD", chr(point))
        kept = "".join(c for c in parts if not "\u0300" <= c <= "\u036f")
        if len(parts) > 1 and len(kept) == 1:
            marked.append(chr(point))
            bare.append(kept)
    return "".join(marked), "".join(bare)


MARKED, BARE = _accents()
COMBINING = "[\u0300-\u036f]"
#: White space at the ends of a text: ASCII, and the other Unicode spaces.
BLANK = "[\\s\\x0B\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff]+"


def trimmed(text: Column) -> Column:
    """Text without white space of any kind at its ends."""
    return F.regexp_replace(text, f"^{BLANK}|{BLANK}$", "")


# Greek letters in Latin writing; digraphs come first.
GREEK_PAIRS = {"ου": "ou", "αυ": "av", "ευ": "ev"}
GREEK_TWO = {"θ": "th", "χ": "ch", "ψ": "ps"}
GREEK_ONE = ("αβγδεζηικλμνξοπρσςτυφω", "avgdeziiklmnxoprsstyfo")


def strip_accents(text: Column) -> Column:
    """Letters without their combining marks; others stay."""
    return F.regexp_replace(F.translate(text, MARKED, BARE), COMBINING, "")


def fold(text: Column) -> Column:
    """Lower-case search form: no accents, Turkish, Nordic and Greek letters in Latin writing.

    Text of as many bytes as characters is ASCII: there only case and white space matter.
    """
    text = F.coalesce(text, F.lit(""))
    plain = F.octet_length(text) == F.char_length(text)
    return F.when(plain, F.btrim(F.lower(text), F.lit(" \t\n\x0b\f\r"))).otherwise(_fold_any(text))


def _fold_any(text: Column) -> Column:
    out = F.lower(strip_accents(text))
    out = F.replace(F.translate(strip_accents(out), "ışğø", "isgo"), F.lit("ß"), F.lit("ss"))
    for greek, latin in {**GREEK_PAIRS, **GREEK_TWO}.items():
        out = F.replace(out, F.lit(greek), F.lit(latin))
    return trimmed(F.translate(out, *GREEK_ONE))


# Words and names that mark an airport.
AIRPORT_WORDS = ("airport", "aeroport", "havalimani", "havalimanı", "flughafen", "aeropuerto", "aeroporto")
AIRPORT_NAMES = (
    "heathrow", "gatwick", "stansted", "luton", "london city airport", "larnaca", "paphos", "ercan", "bodrum",
    "milas", "dalaman", "antalya", "rhodes airport", "diagoras", "manchester airport", "edinburgh airport",
)


def is_airport(name: Column, flag: Column) -> Column:
    """Whether a name reads like an airport, or is flagged as one; a nameless stop never is."""
    folded = strip_accents(F.lower(F.coalesce(name, F.lit(""))))
    said = folded.rlike("|".join(AIRPORT_WORDS + AIRPORT_NAMES)) | folded.rlike(r"\([a-z]{3}\)\s*$")
    return (folded != "") & (F.coalesce(flag, F.lit(False)) | said)


def clean_names(names: Column) -> Column:
    """Trimmed names without blanks; null gives none."""
    return F.coalesce(F.filter(F.transform(names, trimmed), lambda n: n.isNotNull() & (n != "")), F.array().cast("array<string>"))


def join_names(names: Column) -> Column:
    """``a``, ``a & b``, ``a, b & c``."""
    n = F.size(names)
    head = F.array_join(F.slice(names, 1, F.greatest(n - 1, F.lit(0))), ", ")
    last = F.try_element_at(names, F.lit(-1))
    return F.when(n == 0, "").when(n == 1, last).otherwise(F.concat(head, F.lit(" & "), last))


def credit_line(names: Column) -> Column:
    return F.when(F.size(names) > 0, F.concat(F.lit("— "), join_names(names))).otherwise("")


def present_tag(names: Column) -> Column:
    return F.when(F.size(names) > 0, F.concat(F.lit("with "), join_names(names))).otherwise("")


def intro_text(text: Column) -> Column:
    return trimmed(F.coalesce(text, F.lit("")))


def clamp_intro(body: Column, budget: int = 220) -> Column:
    """Text cut to a budget: at a sentence end that lies far enough, else at a word with an ellipsis."""
    whole = intro_text(body)
    cut = F.substring(whole, 1, budget)
    at_word = F.regexp_replace(cut, r"(?s) [^ ]*$", "")
    cut = F.when((at_word != "") & (F.locate(" ", cut) > 1), at_word).otherwise(cut)
    ends = F.regexp_extract(cut, r"""(?s)^(.*[.!?]["'”’)\]]?)(?=\s|$)""", 1)
    short = F.concat(F.regexp_replace(cut, r"[\s.,;:—-]+$", ""), F.lit("…"))
    return (
        F.when(F.length(whole) <= budget, whole)
        .when(F.length(ends) >= budget * 0.6, F.regexp_replace(ends, r"^\s+|\s+$", ""))
        .otherwise(short)
    )


def escape_html(text: Column) -> Column:
    out = F.coalesce(text, F.lit(""))
    for char, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        out = F.replace(out, F.lit(char), F.lit(entity))
    return out


def script_safe(json: Column) -> Column:
    """JSON text that may stand inside a script element."""
    out = F.regexp_replace(json, r"(?i)</(script)", r"\\u003c/$1")
    for found, said in (("<!--", r"\u003c!--"), ("-->", r"--\u003e"), ("\u2028", r"\u2028"), ("\u2029", r"\u2029")):
        out = F.replace(out, F.lit(found), F.lit(said))
    return out


def manifest_list(items: Column) -> Column:
    """An HTML list of (label, count) structs."""
    rows = F.transform(
        items,
        lambda i: F.concat(
            F.lit('<li class="manifest-row"><span class="manifest-label">'),
            escape_html(i["label"]),
            F.lit('</span><span class="manifest-count">'),
            i["count"].cast("string"),
            F.lit("</span></li>"),
        ),
    )
    full = F.concat(F.lit('<ul class="manifest">'), F.array_join(rows, ""), F.lit("</ul>"))
    return F.when(F.size(items) > 0, full).otherwise('<div class="manifest empty">This file is empty.</div>')


def within_one_edit(a: Column, b: Column) -> Column:
    return F.levenshtein(a, b, 1) >= 0


def display_name(name: Column, other: Column, wanted: list[str]) -> Column:
    """A place's name in the first wanted language that it has one in, else its own; other: a map by language."""
    found = [F.nullif(F.try_element_at(other, F.lit(lang)), F.lit("")) for lang in wanted if lang]
    return F.coalesce(*found, name, F.lit(""))


def country_name(code: Column, names: dict[str, str]) -> Column:
    """The name of a country code, the code itself where there is none, empty for null."""
    table = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
    return F.coalesce(F.try_element_at(table, code), code, F.lit(""))
