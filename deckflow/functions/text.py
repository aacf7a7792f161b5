"""Scalar helpers: each is a Column -> Column built from Spark built-ins, so
it stays inside whole-stage codegen. They restate Python / JavaScript string
behaviour the reference relies on (truthiness, ``str.strip``, ``str.title``)."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

__all__ = [
    "first_nonempty", "py_strip", "quote_append", "title_from_slug", "truncate",
    "truncate_dots", "card_file_id", "depth_cap", "format_example", "format_probe",
    "sections_map", "repr_list", "file_stem", "day_cutoff", "pluck", "hint_suffix",
    "metadata_json", "phase_label", "phase_text", "gesture_class", "seeded_order",
    "fold_accents", "tokens",
]

# Fixed values (must equal the reference for equal results):
# Python's str.strip() whitespace = \t \n \x0b \x0c \r \x1c-\x1f space \x85 and Unicode separators.
PY_WS_CLASS = r"[\t\n\x0B\f\r\x1C-\x1F \x85\p{Z}]"
# Phase names and labels of the card viewer, in phase order 0, 1, 2.
PHASES = ["idea", "example", "probe"]
PHASE_LABELS = ["Idea", "Example", "Think about it"]
# Gesture thresholds of the viewer, in pixels: tap below 30 on both axes, swipe above 50.
TAP_PX = 30
SWIPE_PX = 50


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def first_nonempty(a, b) -> Column:
    """Python ``a or b`` for strings: empty and null both fall through."""
    return F.coalesce(F.nullif(_c(a), F.lit("")), _c(b))


def py_strip(x) -> Column:
    """Python ``str.strip()``: Spark ``trim`` removes spaces only."""
    return F.regexp_replace(_c(x), rf"\A{PY_WS_CLASS}+|{PY_WS_CLASS}+\z", "")


def quote_append(text, quoted) -> Column:
    q = _c(quoted)
    return F.when(F.coalesce(q, F.lit("")) != "", F.concat(_c(text), F.lit("\n\n> "), q)).otherwise(_c(text))


def title_from_slug(slug) -> Column:
    """``slug.replace('-', ' ').title()``: every run of letters is capitalised,
    also after digits or apostrophes (plain ``initcap`` splits on spaces only)."""
    runs = F.regexp_extract_all(F.regexp_replace(_c(slug), "-", " "), F.lit(r"\p{L}+|\P{L}+"), 0)
    return F.array_join(F.transform(runs, lambda r: F.concat(F.upper(F.substring(r, 1, 1)),
                                                                F.lower(F.substring(r, 2, 1 << 30)))), "")


def truncate(x, n: int) -> Column:
    """Python ``x[:n]`` (code points)."""
    return F.substring(_c(x), 1, n)


def truncate_dots(x, n: int) -> Column:
    """``x[:n] + '...'`` (dots are always added)."""
    return F.concat(F.substring(F.coalesce(_c(x), F.lit("")), 1, n), F.lit("..."))


def card_file_id(slug, num) -> Column:
    return F.format_string("%s-%03d", _c(slug), _c(num))


def depth_cap(num, cap: int = 3) -> Column:
    return F.least(_c(num), F.lit(cap))


def format_example(example) -> Column:
    """``**title** — body`` / body / '' for a struct<title, body> (null = empty map)."""
    e = _c(example)
    title = F.coalesce(e["title"], F.lit(""))
    body = F.coalesce(e["body"], F.lit(""))
    return (F.when(e.isNull(), F.lit(""))
            .when(title != "", F.concat(F.lit("**"), title, F.lit("** — "), body))
            .otherwise(body))


def format_probe(probe) -> Column:
    p = _c(probe)
    q = F.coalesce(p["question"], F.lit(""))
    hint = F.coalesce(p["hint"], F.lit(""))
    return (F.when(p.isNull(), F.lit(""))
            .when(hint != "", F.concat(q, F.lit("\n\n*Hint: "), hint, F.lit("*")))
            .otherwise(q))


def sections_map(body) -> Column:
    """Markdown body -> map(lower(trimmed heading) -> stripped text).

    Only lines starting with ``## `` open a section; text before the first one
    is dropped; a repeated heading keeps its last text; an empty heading is
    ignored. Works on lines, like the reference, also inside code fences."""
    parts = F.split(F.concat(F.lit("\n"), F.regexp_replace(_c(body), "\r\n", "\n")), "\n## ")
    secs = F.transform(F.slice(parts, 2, 1 << 30), lambda s: F.struct(
        py_strip(F.lower(F.substring_index(s, "\n", 1))).alias("k"),
        py_strip(F.when(F.instr(s, "\n") > 0, F.substring(s, F.instr(s, "\n") + 1, 1 << 30))
                 .otherwise(F.lit(""))).alias("v")))
    # the last of a heading counts, without reliance on the session's policy for
    # equal map keys: sorted by heading and falling place, the first of each stays
    sorted_ = F.array_sort(F.transform(secs, lambda x, i: F.struct(x["k"].alias("k"), (-i).alias("i"), x["v"].alias("v"))))
    before = F.concat(F.array(F.lit(None).cast("string")), F.transform(sorted_, lambda x: x["k"]))
    own = F.zip_with(sorted_, before, lambda x, b: F.when((x["k"] != "") & (b.isNull() | (b != x["k"])), F.struct((-x["i"]).alias("i"), x["k"].alias("k"), x["v"].alias("v"))))
    in_order = F.array_sort(F.filter(own, lambda x: x.isNotNull()))
    return F.map_from_entries(F.transform(in_order, lambda x: F.struct(x["k"].alias("k"), x["v"].alias("v"))))


def repr_list(text) -> Column:
    """Legacy Python-repr list text ``['a', 'b']`` -> array<string>; null when it
    does not parse (e.g. an apostrophe inside an item)."""
    j = F.replace(_c(text), F.lit("'"), F.lit('"'))
    return F.when(F.regexp_like(j, F.lit(r"^\s*\[")), F.from_json(j, "array<string>"))


def decoded_path(path) -> Column:
    """A file path as Spark gives it, with its percent codes read; a plus sign is
    itself, and a path that doesn't decode stays."""
    return F.coalesce(F.try_url_decode(F.replace(_c(path), F.lit("+"), F.lit("%2B"))), _c(path))


def file_stem(path) -> Column:
    return F.regexp_extract(_c(path), r"([^/]+?)(\.[^./]*)?$", 1)


def day_cutoff(as_of, days: int = 3) -> Column:
    """Midnight of (as_of - days): the reference compares event time text with
    a ``YYYY-MM-DD`` string, which is the same as ``< midnight``."""
    return F.date_sub(F.to_date(_c(as_of)), days)


def pluck(arr, field: str) -> Column:
    return F.transform(_c(arr), lambda x: x[field])


def hint_suffix(hints) -> Column:
    h = _c(hints)
    return F.when(F.coalesce(F.size(h), F.lit(0)) > 0,
                  F.concat(F.lit(" (topics: "), F.array_join(h, ", "), F.lit(")"))).otherwise(F.lit(""))


def metadata_json(m) -> Column:
    return F.coalesce(F.to_json(_c(m)), F.lit("{}"))


def phase_label(phase) -> Column:
    return F.element_at(F.array(*[F.lit(x) for x in PHASE_LABELS]), _c(phase) + 1)


def phase_text(idea, example, probe, phase) -> Column:
    return F.element_at(F.array(_c(idea), _c(example), _c(probe)), _c(phase) + 1)


def gesture_class(dx, dy) -> Column:
    adx, ady = F.abs(_c(dx)), F.abs(_c(dy))
    return (F.when((adx < TAP_PX) & (ady < TAP_PX), F.lit("next"))
            .when((adx > ady) & (adx > SWIPE_PX), F.when(_c(dx) < 0, F.lit("next")).otherwise(F.lit("prev")))
            .otherwise(F.lit("none")))


def seeded_order(seed: str, card_id) -> Column:
    """Reproducible stand-in for ORDER BY RANDOM(): md5('seed:card_id')."""
    return F.md5(F.concat(F.lit(seed), F.lit(":"), _c(card_id).cast("string")))


def _accent_table() -> tuple[str, str]:
    """Letters of Latin-1 Supplement, Latin Extended-A/B and Latin Extended
    Additional whose canonical decomposition is an ASCII letter plus marks, mapped to that letter (the
    full-text tokenizer's diacritic folding). Built by rule from Unicode data."""
    src, dst = [], []
    for cp in [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]:
        ch = chr(cp)
        base = unicodedata.normalize("NFD", ch)[0]
        if base != ch and base.isascii() and base.isalpha():
            src.append(ch)
            dst.append(base)
    return "".join(src), "".join(dst)


_ACCENT_SRC, _ACCENT_DST = _accent_table()


def fold_accents(x) -> Column:
    return F.translate(_c(x), _ACCENT_SRC, _ACCENT_DST)


def tokens(x) -> Column:
    """Case-folded, accent-folded runs of letters and digits (unicode61 style);
    combining marks belong to their letter and are dropped."""
    bare = F.regexp_replace(F.lower(_c(x)), r"\p{M}+", "")
    return F.regexp_extract_all(fold_accents(bare), F.lit(r"[\p{L}\p{N}]+"), 0)
