"""Text preparation as column expressions.

Character classes are written out (``\\p{L}``, ``\\p{N}``) because Java's ``\\w`` is ASCII-only while the rules
are about letters and digits of any script.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

WORD = r"[\p{L}\p{N}]+"
LINE_BREAK = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85  ]"
SPACE = r"[\s\x1c-\x1f\x85\p{Z}]"
SENTENCE_GAP = r"(?<=[.!?؟۔؛])[\s\x1c-\x1f\x85\p{Z}]+"

# Question and function words dropped before keyword search (English, French, Arabic).
STOP_WORDS = """
a an the and or but not no of to in on at by for from with without about into over under between
is are was were be been being am do does did done has have had can could should would will shall may might must
it its this that these those there here as if than then so such too very also just only more most less
i me my we our you your he she they them their his her
what which who whom whose when where why how whats
define definition explain describe give list tell show mean means meaning difference differences
le la les l un une des du de d au aux et ou mais ni ne pas plus moins que qu qui quoi dont où
est sont été être était étaient a ont avait avoir fait font
ce cet cette ces c se sa son ses leur leurs mon ma mes ton ta tes notre nos votre vos
je j tu il elle on nous vous ils elles me m te t lui y en s n
dans sur sous par pour avec sans entre vers chez comme si très aussi différence différences définition définir expliquer
quel quelle quels quelles comment pourquoi quand combien lequel laquelle
ما ماذا من هو هي هل كيف لماذا متى أين اين في على عن إلى الى مع و أو او ثم هذا هذه ذلك تلك التي الذي ان أن إن لا لم لن ما هم
""".split()

# Function words counted by the language guess.
FRENCH_WORDS = """le la les un une des du de est sont et ou que qui quoi quel quelle quels quelles comment pourquoi
combien avec pour dans sur entre ce cette ces il elle nous vous pas au aux""".split()
ENGLISH_WORDS = """the a an is are what which who how why when does do of in on and or to for with between this that
it""".split()
FRENCH_ACCENTS = "[àâçéèêëîïôûùüÿœ]"
ARABIC = r"[؀-ۿݐ-ݿﭐ-﷿ﹰ-﻿]"

# Document titles that say nothing, and the wrappers office programs add to titles.
GENERIC_TITLES = (r"(?iu)^(powerpoint presentation|présentation powerpoint|presentation|présentation|"
                  r"diapositive \d+|slide \d+|document|untitled|sans titre|microsoft word - .*|"
                  r"(template|modèle|modele)\b.*)$")
OFFICE_PREFIX = r"^Microsoft (PowerPoint|Word) - "
OFFICE_SUFFIX = r"(?i)\.(pptx?|docx?)$"

# Mime types by file extension.
MIME_BY_EXTENSION = {
    "pdf": "application/pdf",
    "pptx": "application/vnd.openxmlformats-officedocument.presentationml.presentation",
    "docx": "application/vnd.openxmlformats-officedocument.wordprocessingml.document",
    "md": "text/markdown",
    "txt": "text/plain",
}


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once per row. Inside a lambda, an outer expression would otherwise be
    evaluated again for every element."""
    return F.element_at(F.transform(F.array(value), body), 1)


def strip(col: Column) -> Column:
    """Remove white space of any kind at both ends."""
    return F.regexp_replace(col, f"^{SPACE}+|{SPACE}+$", "")


def squeeze(col: Column) -> Column:
    """White-space runs become one space; ends trimmed."""
    return F.trim(F.regexp_replace(col, f"{SPACE}+", " "))


def rewrite(col: Column, pattern: str, render) -> Column:
    """Replace every match of ``pattern`` with ``render(match)``, a column expression over the matched text."""
    mark = "\u0001"
    gaps = F.split(F.regexp_replace(col, pattern, mark), mark)
    hits = F.concat(F.transform(F.regexp_extract_all(col, F.lit(pattern), 0), render), F.array(F.lit("")))
    return F.array_join(F.zip_with(gaps, hits, lambda g, h: F.concat(g, F.coalesce(h, F.lit("")))), "")


def bounded_words(col: Column) -> Column:
    """White-space separated words, without empty ones."""
    return F.filter(F.split(col, f"{SPACE}+"), lambda w: w != "")


@F.pandas_udf(T.StringType())
def _compose(texts: pd.Series) -> pd.Series:
    return texts.map(lambda s: s if s is None else unicodedata.normalize("NFKC", s))


def nfkc(col: Column | str) -> Column:
    """Unicode compatibility composition, the one text step Spark has no built-in for. Only texts with a character
    beyond ASCII travel to Python."""
    col = F.col(col) if isinstance(col, str) else col
    return F.coalesce(_compose(F.when(col.rlike(r"[^\x00-\x7F]"), col)), col)


def tidy_layout(col: Column) -> Column:
    """Drop soft hyphens, rejoin words hyphenated over a line end, squeeze blanks, keep one blank line at most."""
    col = F.regexp_replace(col, r"­", "")
    col = F.regexp_replace(col, r"([\p{L}\p{N}_])-\n([\p{L}\p{N}_])", "$1$2")
    col = F.regexp_replace(col, r"[ \t ]+", " ")
    col = F.regexp_replace(col, r" *\n *", "\n")
    col = F.regexp_replace(col, r"\n{3,}", "\n\n")
    return strip(col)


def normalize(col: Column) -> Column:
    """Full normalisation: NFKC, then the layout rules."""
    return tidy_layout(nfkc(col))


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def file_stem(path: Column) -> Column:
    return F.regexp_replace(file_name(path), r"(?<=.)\.[^.]+$", "")


def file_extension(path: Column) -> Column:
    """Lower-cased extension without the dot; empty when there is none."""
    return F.lower(F.regexp_extract(file_name(path), r"[^.].*\.([^.]+)$|^[^.]+\.([^.]+)$", 1))


def clean_title(title: Column, path: Column) -> Column:
    """Strip office wrappers from a title; fall back to the file name when nothing useful is left."""
    t = F.regexp_replace(F.trim(F.coalesce(title, F.lit(""))), OFFICE_PREFIX, "")
    t = F.trim(F.regexp_replace(t, OFFICE_SUFFIX, ""))
    return F.when((t == "") | t.rlike(GENERIC_TITLES), file_stem(path)).otherwise(t)


def ink_chars(col: Column) -> Column:
    """Number of characters that are not white space."""
    return F.length(F.regexp_replace(col, SPACE, ""))


def reads_like_words(line: Column) -> Column:
    """At least two runs of 3+ letters/digits, and 60 % of the visible characters are letters or digits."""
    visible = F.length(F.regexp_replace(line, SPACE, ""))
    alnum = F.length(F.regexp_replace(line, r"[^\p{L}\p{N}]", ""))
    return ((visible > 0) & (F.regexp_count(line, F.lit(r"[\p{L}\p{N}]{3,}")) >= 2)
            & (alnum >= visible * F.lit(0.6)))


def stripped_lines(col: Column) -> Column:
    return F.transform(F.split(col, LINE_BREAK), strip)


def clean_lines(col: Column) -> Column:
    """Keep only the lines that read like words."""
    return F.array_join(F.filter(stripped_lines(col), reads_like_words), "\n")


def new_lines(base: Column, extra: Column) -> Column:
    """Lines of ``extra`` that ``base`` does not already have, then the junk-line rule."""
    fresh = let(stripped_lines(base), lambda known: F.filter(
        stripped_lines(extra), lambda x: (x != "") & reads_like_words(x) & ~F.array_contains(known, x)))
    return F.array_join(fresh, "\n")


def n_tokens(col: Column, mode: str = "chars") -> Column:
    """Token estimate: a third of the characters (at least 1), or the number of words."""
    if mode == "chars":
        return F.greatest(F.lit(1), F.floor(F.length(col) / 3).cast("int"))
    if mode == "words":
        return F.size(bounded_words(col))
    raise ValueError(f"unknown token mode {mode!r}")


def token_counter(count):
    """Wrap ``count(str) -> int`` (a model tokenizer, say) as an Arrow-batched column function."""

    @F.pandas_udf(T.IntegerType())
    def counted(texts: pd.Series) -> pd.Series:
        return texts.map(count)

    return counted


def detect_lang(col: Column) -> Column:
    """``ar`` above 30 % Arabic letters, else ``fr`` or ``en`` by function words; ties go to English."""
    low = F.lower(col)
    letters = F.regexp_count(col, F.lit(r"[\p{L}\p{Nl}\p{No}]"))
    arabic = F.regexp_count(col, F.lit(ARABIC))
    words = F.regexp_extract_all(F.translate(low, "’'", "  "), F.lit("[a-zà-ÿ]+"), 0)
    fr = (F.size(F.filter(words, lambda w: w.isin(FRENCH_WORDS)))
          + F.when(low.rlike(FRENCH_ACCENTS), 2).otherwise(0))
    en = F.size(F.filter(words, lambda w: w.isin(ENGLISH_WORDS)))
    return (F.when((letters > 0) & (arabic / letters > 0.3), "ar").when(fr > en, "fr").otherwise("en"))


def words_of(col: Column) -> Column:
    """Lower-cased runs of letters and digits, in order."""
    return F.regexp_extract_all(F.lower(col), F.lit(WORD), 0)


def keywords(col: Column) -> Column:
    """Distinct content words in order of first use; expects text that is already NFKC."""
    return F.array_distinct(
        F.filter(words_of(col), lambda w: (F.length(w) > 1) & ~w.isin(STOP_WORDS)))


def snippet(col: Column, size: int = 240) -> Column:
    """One line of at most ``size`` characters, cut at a space."""
    flat = squeeze(col)
    cut = F.regexp_replace(F.substring(flat, 1, size), r" [^ ]*$", "")
    return F.when(F.length(flat) <= size, flat).otherwise(F.concat(cut, F.lit("…")))


def excerpt(col: Column, size: int = 240) -> Column:
    """Plain-text excerpt of a Markdown passage: no headings, breadcrumb, images or emphasis marks."""
    lines = F.filter(F.split(col, "\n"),
                     lambda x: ~x.rlike(r"^\s*#{1,6}\s") & ~x.rlike(r"^\s*\*[^*].*›.*\*\s*$"))
    body = F.array_join(lines, " ")
    for pattern, to in ((r"!\[[^\]]*\]\((<[^>]*>|[^)]*)\)", ""), (r"\*\*|__|`", ""),
                        (r"(^|\s)[*_](\S)", "$1$2"), (r"(\S)[*_](?=\s|$)", "$1"), (r"\s+", " ")):
        body = F.regexp_replace(body, pattern, to)
    body = F.trim(body)
    cut = F.regexp_replace(F.substring(body, 1, size), r"\s+\S*$", "")
    return F.when(F.length(body) <= size, body).otherwise(F.concat(cut, F.lit("…")))


def without_leading_title(col: Column) -> Column:
    """Drop a note's first heading and the breadcrumb line under it."""
    col = F.regexp_replace(col, r"\A\s*#\s[^\n]*\n+", "")
    return F.regexp_replace(col, r"\A\s*\*[^*\n]*›[^*\n]*\*\s*\n+", "")


def normalise_math(col: Column) -> Column:
    r"""``\[..\]`` becomes ``$$..$$`` and ``\(..\)`` becomes ``$..$`` with the inside trimmed."""
    col = F.regexp_replace(col, r"(?s)\\\[(.+?)\\\]", r"\$\$$1\$\$")
    return F.regexp_replace(col, r"(?s)\\\(\s*(.+?)\s*\\\)", r"\$$1\$")


def strip_reasoning(col: Column) -> Column:
    """Keep what follows the last closing think tag."""
    tail = F.regexp_replace(F.substring_index(col, "</think>", -1), f"^{SPACE}+", "")
    return F.when(col.contains("</think>"), tail).otherwise(col)


def first_sentence(col: Column, size: int | None = 200) -> Column:
    """The first sentence, cut to ``size`` characters where one is given (a preview)."""
    first = F.element_at(F.split(strip(col), r"(?<=[.!?])[\s\x1c-\x1f\x85\p{Z}]", 2), 1)
    return first if size is None else F.substring(first, 1, size)


def icontains(col: Column, needle: Column | str) -> Column:
    """Case-insensitive literal containment: nothing in ``needle`` is a pattern."""
    return F.lower(col).contains(F.lower(F.lit(needle) if isinstance(needle, str) else needle))


def locator(mime: Column, page: Column, label: Column) -> Column:
    """``p. 3``, ``slide 3``, the section label, or ``note``."""
    return (F.when(mime == MIME_BY_EXTENSION["pdf"], F.concat(F.lit("p. "), page.cast("string")))
            .when(mime.endswith("presentationml.presentation"), F.concat(F.lit("slide "), page.cast("string")))
            .otherwise(F.coalesce(F.when(label != "", label), F.lit("note"))))


def module_code(course: Column, known: Column | None = None) -> Column:
    """A known code, else the initials of several words or the first six characters of one, upper-cased."""
    parts = F.filter(F.split(course, r"[\s_-]+"), lambda w: w != "")
    derived = F.upper(F.when(F.size(parts) == 1, F.substring(course, 1, 6))
                      .otherwise(F.array_join(F.transform(parts, lambda w: F.substring(w, 1, 1)), "")))
    code = derived if known is None else F.coalesce(known, derived)
    return F.when(course.isNull() | (course == ""), "NOTE").otherwise(code)


def inner_folders(path: Column) -> Column:
    """Path segments between the first folder and the file name."""
    parts = F.split(path, "/")
    return F.slice(parts, 2, F.greatest(F.size(parts) - 2, F.lit(0)))


def chapter_code(path: Column) -> Column:
    """``CH1``, ``S3`` or ``WS2`` from the first folder that names a chapter, session or workshop."""

    def code(seg: Column) -> Column:
        ch = F.regexp_extract(seg, r"(?iu)\bchap(?:ter|itre)?\s*[-:]?\s*(\d+)", 1)
        s = F.regexp_extract(seg, r"^S(\d+)\b", 1)
        ws = F.regexp_extract(seg, r"(?i)\bworkshop\s*(\d+)", 1)
        return (F.when(ch != "", F.concat(F.lit("CH"), ch)).when(s != "", F.concat(F.lit("S"), s))
                .when(ws != "", F.concat(F.lit("WS"), ws)))

    found = F.filter(F.transform(inner_folders(path), code), lambda c: c.isNotNull())
    return F.try_element_at(found, F.lit(1))


def folder_trail(path: Column) -> Column:
    return F.array_join(inner_folders(path), " › ")


def call_number(course: Column, path: Column, mime: Column, page: Column, label: Column,
                known_code: Column | None = None) -> Column:
    """Module code, chapter code and locator, joined by a middle dot; plain notes carry no locator."""
    paged = (mime.isin(MIME_BY_EXTENSION["pdf"], MIME_BY_EXTENSION["pptx"])
             | ((mime == MIME_BY_EXTENSION["docx"]) & (label != "")))
    return F.concat_ws(" · ", module_code(course, known_code), chapter_code(path),
                       F.when(paged, locator(mime, page, label)))


def parts_count(mime: Column, n: Column) -> Column:
    """``12 pages``, ``1 slide``, ``4 sections``; NULL for single-part notes."""
    unit = (F.when(mime == MIME_BY_EXTENSION["pdf"], "page").when(mime == MIME_BY_EXTENSION["pptx"], "slide")
            .when(mime == MIME_BY_EXTENSION["docx"], "section"))
    return F.concat(n.cast("string"), F.lit(" "), unit, F.when(n == 1, "").otherwise("s"))


def safe_segment(col: Column, limit: int = 80) -> Column:
    """A title usable as one path segment on any file system."""
    s = F.regexp_replace(F.trim(F.regexp_replace(col, r'[<>:"/\\|?*\x00-\x1f]', "-")), r"[. ]+$", "")
    s = F.regexp_replace(F.substring(s, 1, limit), r"[. ]+$", "")
    return F.when(s == "", "untitled").otherwise(s)


def _accent_map() -> tuple[str, str]:
    """All letters of the basic plane that decompose to one letter and marks, and that letter, in lower case."""
    pairs = {}
    for code in (*range(0xC0, 0xAC00), *range(0xD7A4, 0xD800), *range(0xF900, 0x10000)):
        base, *marks = unicodedata.normalize("NFD", chr(code))
        if (marks and all(map(unicodedata.combining, marks)) or code < 0x250) and base.isalpha():
            base = base.lower()
            if base != chr(code) and len(base) == 1 and ord(base) < 0x10000:
                pairs[chr(code)] = base
    return "".join(pairs), "".join(pairs.values())


def fold_accents(col: Column) -> Column:
    """Lower case without accents, one character for one, so positions match the original."""
    return F.lower(F.translate(col, *_accent_map()))
