"""Line, heading, token and name functions as Column expressions."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---- fixed values
SPACE = r"[\s\x85\p{Z}\x1c-\x1f]"
#: The characters of SPACE.
BLANKS = "".join(c for c in map(chr, range(0x10000)) if c in "\t\n\x0b\f\r\x85\x1c\x1d\x1e\x1f" or unicodedata.category(c)[0] == "Z")
WORD = r"\p{L}\p{N}_"
CHAPTER = r"(?iu)^\s*(?:chapter|part|section|book|appendix|prologue|epilogue|introduction|preface|conclusion|الفصل|الباب|مقدمة|خاتمة|المقدمة|تمهيد|القسم)(?![\p{L}\p{N}_])"
PAGE_NUMBER = r"^[\s\p{Nd}ivxlcIVXLC.\-–—|]+$"
SENTENCE_END = "[.!?:;؟۔،؛\"'’”»)\\]]\\s*$"
PAGE_END = r"[.!?؟۔:،]\s*$"
LEAD = r"^[\s>›\p{Nd}.,\-–—)\]]{1,8}\s+"
TRAIL = r"\s+[\s>›\p{Nd}.,\-–—(\[]{1,8}$"
HEADING_EDGE = " .,-–—>›،"
HYPHENATED = r"([A-Za-zÀ-ɏ]{2,})[-‐‑]\n"
TOKEN = r"[\p{L}\p{N}_؀-ۿ]+"
# ----


def strip(text: Column) -> Column:
    """Without white space at either end, Unicode's included."""
    return F.btrim(text, F.lit(BLANKS))


def repeat_key(line: Column) -> Column:
    """What running heads have in common from page to page: numbers as #, stripped, lower case."""
    return F.lower(strip(F.regexp_replace(line, r"\p{Nd}+", "#")))


def is_page_number(line: Column) -> Column:
    """Only digits, Roman numerals' letters, dots, dashes and bars; so "I" and "civic" are page numbers too."""
    t = strip(line)
    return (F.length(t) > 0) & (F.length(t) <= 12) & t.rlike(PAGE_NUMBER)


def is_chapter(line: Column) -> Column:
    return line.rlike(CHAPTER)


def normalised(text: Column) -> Column:
    return F.lower(strip(F.regexp_replace(text, rf"[^{WORD}؀-ۿ]+", " ")))


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(r"[^\s\x85\p{Z}\x1c-\x1f]+"))


def clean_heading(text: Column) -> Column:
    """Without numbers and bullets that stand at either end, unless nothing would be left."""
    t = F.btrim(F.regexp_replace(F.regexp_replace(text, LEAD, ""), TRAIL, ""), F.lit(HEADING_EDGE))
    return F.when(F.length(t) > 0, t).otherwise(text)


def join_lines(lines: Column, rtl: bool) -> Column:
    """An array of lines as one paragraph; split words are mended in left-to-right text."""
    kept = F.filter(F.transform(lines, strip), lambda x: F.length(x) > 0)
    text = F.array_join(kept, "\n")
    if not rtl:
        text = F.regexp_replace(text, HYPHENATED, "$1")
    return strip(F.regexp_replace(F.translate(text, "\n", " "), r"\s{2,}", " "))


def is_open(text: Column) -> Column:
    """The sentence goes on: no closing punctuation at the end."""
    return ~strip(text).rlike(SENTENCE_END)


def starts_lower(text: Column) -> Column:
    return strip(text).rlike(r"^\p{Ll}")


def starts_upper(text: Column) -> Column:
    return strip(text).rlike(r"^\p{Lu}")


def is_upper(text: Column) -> Column:
    return (text == F.upper(text)) & (text != F.lower(text))


def classify_line(text: Column, size: Column, bold: Column, y1: Column, body: Column, page_h: Column, mode: str = "text") -> Column:
    """skip, heading, footnote or para. mode: text, ocr (sizes are noisy) or conservative (chapter words only)."""
    t = strip(text)
    ratio = F.when(body > 0, size / body).otherwise(F.lit(1.0))
    words, length = word_count(t), F.length(t)
    rest = F.when((ratio <= 0.82) & (y1 > page_h * 0.72), "footnote").otherwise("para")
    short = (length <= 80) & (words <= 12)
    kind = F.when(length == 0, "skip").when(is_chapter(t) & short, "heading")
    if mode == "ocr":
        kind = kind.when((ratio >= 1.5) & (words <= 8) & (length <= 50) & ~t.rlike(r"[.,;:،؛]$"), "heading")
    elif mode == "text":
        kind = kind.when((ratio >= 1.45) & short & ~t.endswith(","), "heading").when((ratio >= 1.18) & short & (bold | is_upper(t)), "heading")
    return kind.otherwise(rest)


def heading_level(size: Column, body: Column) -> Column:
    return F.when(size >= body * 1.6, 1).otherwise(2)


def tokens(text: Column) -> Column:
    """Lower-cased words, Arabic presentation forms folded."""
    from quire.functions.arabic import fold_presentation_forms

    return F.regexp_extract_all(F.lower(fold_presentation_forms(text)), F.lit(TOKEN), F.lit(0))


def safe_name(text: Column) -> Column:
    """A name for files: word characters, spaces as _, 60 characters, Book if nothing is left."""
    t = strip(F.regexp_replace(text, rf"[^{WORD}؀-ۿ \-]+", ""))
    t = F.regexp_replace(t, r"\s+", "_")
    return F.substring(F.when(F.length(t) > 0, t).otherwise(F.lit("Book")), 1, 60)


def folder_name(text: Column, fallback: str = "Book") -> Column:
    """A folder's name on any system: reserved characters as spaces, 80 characters, no dots or spaces at the end."""
    t = F.regexp_replace(text, r'[<>:"/\\|?*\x00-\x1f]', " ")
    t = F.regexp_replace(F.substring(F.trim(F.regexp_replace(t, r"\s+", " ")), 1, 80), r"[. ]+$", "")
    return F.when((F.length(t) == 0) | t.rlike(r"(?i)^(?:con|prn|aux|nul|com[1-9]|lpt[1-9])$"), F.lit(fallback)).otherwise(t)


def escape_html(text: Column) -> Column:
    for raw, ref in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        text = F.replace(text, F.lit(raw), F.lit(ref))
    return text


def format_bytes(n: Column) -> Column:
    """Bytes as B, KB or MB. A count that lies just between two steps takes the even one, as C's printf does and Java's doesn't."""
    kb, mb = F.bround(n / 1024.0, 0), F.bround(n / (1024.0 * 1024.0), 1)
    return F.when(n < 1024, F.format_string("%d B", n)).when(n < 1024 * 1024, F.format_string("%.0f KB", kb)).when(n.isNotNull(), F.format_string("%.1f MB", mb))


def format_duration(seconds: Column) -> Column:
    s = F.round(seconds).cast("int")
    return F.when(s < 60, F.format_string("%ds", s)).when(s.isNotNull(), F.format_string("%dm %ds", F.floor(s / 60).cast("int"), s % 60))


def edge_line(lines: Column, page_h: Column, last: bool = False) -> Column:
    """The text of the first or last of an array of struct(y0, y1, text), if it lies in the 9 % at the page's edge; else ''."""
    by_place = F.array_sort(F.transform(F.filter(lines, lambda x: F.length(strip(x["text"])) > 0), lambda x: F.struct(x["y0"].alias("y"), strip(x["text"]).alias("text"))))
    found = F.try_element_at(by_place, F.lit(-1 if last else 1))
    inside = found["y"] > page_h * 0.91 if last else found["y"] < page_h * 0.09
    return F.when(inside, found["text"]).otherwise(F.lit(""))


def sample_sections(text: Column, width: int = 420) -> Column:
    """Pieces from the start, the middle and the end."""
    t = F.regexp_replace(strip(text), r"\n{3,}", "\n\n")
    n = F.length(t)
    starts = [F.lit(0), F.greatest(F.lit(0), F.floor(n / 2).cast("int") - width // 2), F.greatest(F.lit(0), n - width)]
    return F.when(n > 0, F.array(*[strip(F.substr(t, s + 1, F.lit(width))) for s in starts])).otherwise(F.array().cast("array<string>"))
