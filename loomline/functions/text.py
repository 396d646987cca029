"""Text functions as Spark columns: cleaning, predicates, words, topics."""

from __future__ import annotations

import unicodedata
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Query words that carry no meaning.
STOP_WORDS = (
    "is what the a an and or in on at for with about to of how why where when who whom whose which are do does did can could should would you your my our their"
).split()
# Named entities and what they stand for, in the order in which they are replaced.
ENTITIES = {"&amp;": "&", "&lt;": "<", "&gt;": ">", "&quot;": '"', "&apos;": "'", "&nbsp;": " ", "&ensp;": " ", "&emsp;": " ", "&ndash;": "-", "&mdash;": "--"}
# Elements that hold no prose.
BLOCKS = ("script", "style", "svg", "nav", "footer", "header")
# Words, or years, that an index holds.
WORD = r"[a-zA-Z][a-zA-Z0-9_\-]+|\b(?:19|20)\d{2}\b"
# Left parts that keep the hyphen of a compound.
KEPT_HYPHENS = ("fine", "general", "open", "state", "self", "multi", "pre", "post")
# Markup and damage that a cleaned text must not hold, lower-case markup first.
MARKUP = ("<script", "<style", "<svg", "<!--", "img.shields.io")
DAMAGE = ("Â", "Ã", "Å", "Ä", "â", "�")


def strip(c: Column) -> Column:
    """Without white space at either end."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def unescape(c: Column) -> Column:
    """Named entities replaced one after the other, all others dropped."""
    named = reduce(lambda x, e: F.replace(x, F.lit(e[0]), F.lit(e[1])), ENTITIES.items(), c)
    return F.regexp_replace(named, r"&(?:#\d+|#x[0-9a-fA-F]+|[a-zA-Z]+);", "")


# Badge images, as a whole line and within one.
BADGES = (r"(?m)^\[?!\[[^\]]*\]\([^)]*img\.shields\.io[^)]*\)[^\n]*$", r"\[?!\[[^\]]*\]\([^)]*img\.shields\.io[^)]*\)\]?(?:\([^)]*\))?")
# Punctuation of UTF-8 read as Windows-1252, and what stands for it.
KNOWN_MOJIBAKE = {"\u00e2\u20ac\u201d": "--", "\u00e2\u20ac\u201c": "-", "\u00e2\u20ac\u2122": "'", "\u00e2\u20ac\u02dc": "'", "\u00e2\u20ac\u0153": '"', "\u00e2\u20ac\u009d": '"', "\u00e2\u02c6\u2014": "*"}
# Environments and marks of mathematics, which is kept as it is.
MATH_ENVIRONMENTS = "equation align gather multline eqnarray math displaymath alignat flalign".split()
MATH = rf"(?s)\$\$.*?\$\$|\\\[.*?\\\]|\\\(.*?\\\)|\\begin\{{(?:{'|'.join(MATH_ENVIRONMENTS)})\*?\}}.*?\\end\{{(?:{'|'.join(MATH_ENVIRONMENTS)})\*?\}}"
# LaTeX commands that leave their content, and all others.
LATEX_KEPT = (r"\\(?:textbf|textit|emph|texttt)\{([^}]*)\}", r"\\(?:cite|ref|label|eqref)\{([^}]*)\}")
LATEX_DROPPED = r"\\[a-zA-Z]+\{[^}]*\}|\\[a-zA-Z]+"
# Ligatures of PDF texts.
LIGATURES = {"\ufb00": "ff", "\ufb01": "fi", "\ufb02": "fl", "\ufb03": "ffi", "\ufb04": "ffl"}
# Kinds of source that are cleaned as papers.
PAPERS = ("paper", "survey")


def _replaced(c: Column, pairs: dict[str, str]) -> Column:
    return reduce(lambda x, p: F.replace(x, F.lit(p[0]), F.lit(p[1])), pairs.items(), c)


def drop_markup(c: Column) -> Column:
    """Entities, elements without prose, tags, comments and badges removed."""
    c = unescape(c)
    for name in BLOCKS:
        c = F.regexp_replace(c, rf"(?is)<\s*{name}\b[^>]*>.*?</\s*{name}\s*>", "")
    c = F.regexp_replace(c, r"</?[a-zA-Z][a-zA-Z0-9]*\b[^>]*?/?>", "")
    c = F.regexp_replace(c, r"(?s)<!--.*?-->", "")
    for badge in BADGES:
        c = F.regexp_replace(c, badge, "")
    return c


def mend_known(c: Column) -> Column:
    """Punctuation that is known to come from a wrong encoding, restored."""
    return _replaced(c, KNOWN_MOJIBAKE)


def drop_latex(c: Column) -> Column:
    """LaTeX commands removed outside mathematics, ligatures parted everywhere. Null stays null."""

    def plain(prose: Column) -> Column:
        for kept in LATEX_KEPT:
            prose = F.regexp_replace(prose, kept, "$1")
        return F.regexp_replace(prose, LATEX_DROPPED, "")

    prose = F.transform(F.split(c, MATH, -1), plain)
    both = F.zip_with(prose, F.regexp_extract_all(c, F.lit(MATH), 0), lambda p, m: F.concat(p, F.coalesce(m, F.lit(""))))
    return _replaced(F.array_join(both, ""), LIGATURES)


def ascii_fold(c: Column) -> Column:
    """Latin letters without their accents, in lower case; the table holds those that Unicode parts into letter and accent."""
    letters = [chr(i) for i in (*range(0xC0, 0x250), *range(0x1E00, 0x1F00))]
    parted = {x: unicodedata.normalize("NFD", x)[0] for x in letters if unicodedata.normalize("NFD", x)[0].isascii()}
    return F.lower(F.translate(F.regexp_replace(c, r"\p{Mn}", ""), "".join(parted), "".join(parted.values())))


def for_matching(c: Column) -> Column:
    """A text's key for comparisons: letters and digits folded, one space for anything else; null gives an empty key."""
    return F.trim(F.regexp_replace(ascii_fold(F.coalesce(c, F.lit(""))), r"[^\p{L}\p{N}]+", " "))


def squeeze(c: Column) -> Column:
    """No control characters, single spaces, no space before a line end, at most one blank line, nothing at the ends."""
    c = F.regexp_replace(c, r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]", "")
    c = F.regexp_replace(F.regexp_replace(c, r"[ \t]+", " "), r" +\n", "\n")
    return F.regexp_replace(F.regexp_replace(c, r"\n{3,}", "\n\n"), r"^\s+|\s+$", "")


def clean_text(c: Column, source_type: Column | None = None) -> Column:
    """A text without markup and noise; null gives an empty text. Papers and surveys also lose their LaTeX commands."""
    bare = drop_markup(F.coalesce(c, F.lit("")))
    if source_type is not None:
        bare = F.when(F.lower(strip(source_type)).isin(*PAPERS), drop_latex(bare)).otherwise(bare)
    return squeeze(mend_known(bare))


def mend_hyphens(c: Column) -> Column:
    """Words that a line end parted are glued; compounds with a usual left part keep the hyphen."""
    kept = F.regexp_replace(c, rf"(?i)\b({'|'.join(KEPT_HYPHENS)})-\s+(\w{{2,}})", "$1-$2")
    return F.regexp_replace(kept, r"(\w{2,})-\s+(\w{2,})", "$1$2")


def words(c: Column) -> Column:
    """Index terms of a text in order: lower-case words and years, no stop words, no single characters."""
    found = F.transform(F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(WORD), 0), F.lower)
    return F.filter(found, lambda w: (F.length(w) > 1) & ~w.isin(STOP_WORDS))


def topic_key(c: Column) -> Column:
    """A topic's key: lower case, ``_`` for ``-`` and space, known topics by what they contain."""
    key = F.translate(F.lower(strip(F.coalesce(c, F.lit("")))), "- ", "__")
    return F.when(key.contains("distill"), "knowledge_distillation").when(key.contains("agent"), "ai_agent").when(key.contains("rag"), "rag").otherwise(key)


def word_count(c: Column) -> Column:
    """Words between white space; null has none."""
    return F.size(F.filter(F.split(F.coalesce(c, F.lit("")), r"(?U)\s+"), lambda w: w != "")).cast("bigint")


def noise_markers(c: Column) -> Column:
    """Markers of MARKUP (in any case) and DAMAGE that the text holds."""
    low = [F.when(F.lower(c).contains(m), F.lit(m)) for m in MARKUP]
    return F.filter(F.array(*low, *(F.when(c.contains(m), F.lit(m)) for m in DAMAGE)), lambda m: m.isNotNull())


def letter_share(c: Column) -> Column:
    """Letters among the characters that are not white space; 0 if there are none."""
    seen = F.length(F.regexp_replace(c, r"\s", ""))
    return F.coalesce(F.length(F.regexp_replace(c, r"[^\p{L}]", "")) / F.nullif(seen, F.lit(0)), F.lit(0.0))


def is_prose(c: Column) -> Column:
    """A sentence of 15 characters or more that starts with no lower-case letter and is mostly letters."""
    first = F.regexp_extract(c, "[a-zA-Z]", 0)
    return (F.length(c) >= 15) & (first == F.upper(first)) & (letter_share(c) >= 0.6) & ~F.lower(c).rlike(r"https?:|```|def |import |\|")


def round6(c: Column) -> Column:
    """Rounded half up to six digits, the same in every engine."""
    return F.floor(c * 1e6 + 0.5) / 1e6


# English months.
MONTHS = "January February March April May June July August September October November December".split()
_YEAR = r"(?:19|20)\d{2}"


def date_struct(c: Column, year: Column) -> Column:
    """(date_text, normalized_date, extracted_year, confidence, source) of a sentence.

    The first kind of date found counts, wherever it stands: ISO date, month and year, year after a preposition, any year,
    and last the document's own year.
    """
    c = F.coalesce(c, F.lit(""))
    iso, month = rf"\b({_YEAR})-\d{{2}}-\d{{2}}\b", rf"(?i)\b({'|'.join(MONTHS)})\s+({_YEAR})\b"
    after, plain = rf"(?i)\b(?:in|around|circa|since|after|before|by|during)\s+({_YEAR})\b", rf"\b({_YEAR})\b"
    number = F.create_map(*(F.lit(x) for i, m in enumerate(MONTHS, 1) for x in (m.lower(), f"{i:02d}")))
    y = F.regexp_extract
    made = lambda text, norm, own, p, s: F.struct(text.alias("date_text"), norm.alias("normalized_date"), own.cast("int").alias("extracted_year"), F.lit(p).alias("confidence"), F.lit(s).alias("source"))
    month_key = F.concat(y(c, month, 2), F.lit("-"), number[F.lower(y(c, month, 1))])
    none = F.lit(None).cast("string")
    return (
        F.when(c.rlike(iso), made(y(c, iso, 0), y(c, iso, 0), y(c, iso, 1), 1.0, "sentence_full_date"))
        .when(c.rlike(month), made(y(c, month, 0), month_key, y(c, month, 2), 0.9, "sentence_month_year"))
        .when(c.rlike(after), made(y(c, after, 0), y(c, after, 1), y(c, after, 1), 0.85, "sentence_context_year"))
        .when(c.rlike(plain), made(y(c, plain, 0), y(c, plain, 0), y(c, plain, 0), 0.7, "sentence_plain_year"))
        .when(year.isNotNull(), made(year.cast("string"), year.cast("string"), year, 0.4, "document_year"))
        .otherwise(made(none, none, none, 0.0, None))
    )
