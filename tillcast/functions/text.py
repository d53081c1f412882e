"""String columns: whitespace strip, formula-injection scrub, file names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Leading characters that start a spreadsheet formula, and the
# characters Python's str.strip() treats as whitespace.
FORMULA_CHARS = "=+-@\t\r"
PY_WHITESPACE = ("\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
                 + "".join(chr(c) for c in range(0x2000, 0x200B)) + "\u2028\u2029\u202f\u205f\u3000")


def strip_ws(c: Column) -> Column:
    """Python ``str.strip()`` (Spark's one-argument ``trim`` removes spaces
    only).  ``btrim`` with a character set: no regex per value."""
    return F.btrim(c, F.lit(PY_WHITESPACE))


def scrub_formula(c: Column, strict: bool = False) -> Column:
    """CLEAN-10: strip, then remove the leading run of = + - @ TAB CR.

    ``strict`` (CLEAN-11): also remove whitespace inside that run and strip
    again, so '= =x' becomes 'x'.
    """
    s = strip_ws(c)
    if strict:
        return strip_ws(F.ltrim(s, F.lit(FORMULA_CHARS + PY_WHITESPACE)))
    return F.ltrim(s, F.lit(FORMULA_CHARS))


def sanitize_filename(path: Column, max_len: int = 255) -> Column:
    """GATE-2: base name, unsafe characters → '_', at most 255 characters
    keeping the extension (stem cut to 240)."""
    base = F.element_at(F.split(F.regexp_replace(path, r"\\", "/"), "/"), -1)
    safe = F.regexp_replace(base, r"[^\w\-.]", "_")
    ext = F.regexp_extract(safe, r"(\.[^.]*)$", 1)
    stem_only = F.regexp_replace(safe, r"\.[^.]*$", "")
    # A leading-dot name ('.bashrc') has no suffix in pathlib terms.
    has_suffix = (F.length(ext) > 0) & (F.length(stem_only) > 0)
    stem_final = F.when(has_suffix, stem_only).otherwise(safe)
    suffix = F.when(has_suffix, ext).otherwise(F.lit(""))
    long = F.length(safe) > max_len
    return F.when(long, F.concat(F.substring(stem_final, 1, 240), suffix)).otherwise(safe)


def file_extension(path: Column) -> Column:
    """Lower-case suffix including the dot ('' when none)."""
    base = F.element_at(F.split(path, "/"), -1)
    stem = F.regexp_replace(base, r"\.[^.]*$", "")
    ext = F.lower(F.regexp_extract(base, r"(\.[^.]*)$", 1))
    return F.when(F.length(stem) > 0, ext).otherwise(F.lit(""))
