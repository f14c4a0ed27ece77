"""Arabic text as Column expressions: ratios, presentation forms, reading direction, line repair, shaping checks.

Character classes are written out because Java's ``\\w``, ``\\d`` and ``\\s`` are ASCII.
"""

from __future__ import annotations

import unicodedata
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---- fixed values
BLOCKS = r"؀-ۿݐ-ݿࢠ-ࣿﭐ-﷿ﹰ-﻿"
PRESENTATION = r"ﭐ-﷿ﹰ-﻿"
#: Presentation code points that are legitimate characters of their own.
LEGITIMATE = r"﴾﴿﷽ﷲﷺﷻ﷼"
#: Vowel and Quranic marks.
MARKS = r"ً-ٰ٘ۖ-ۜ۟-۪ۤۧۨ-ۭ"
BIDI = "‪‫‬‭‮⁦⁧⁨⁩‎‏؜"
TATWEEL = "ـ"
COMMON_WORDS = ["في", "من", "على", "إلى", "الذي", "التي", "عن", "أن", "إن", "لا", "ما", "قد", "كان", "هذا", "ذلك", "الله", "بعد", "قبل", "بين", "العربية"]
# ----


def count(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern))


def _let(x: Column, body) -> Column:
    """body(x), with x computed once."""
    return F.get(F.transform(F.array(x), body), F.lit(0))


def _without(text: Column, pattern: str) -> Column:
    return F.regexp_replace(text, pattern, "")


def letter_ratios(text: Column) -> Column:
    """struct(arabic, latin): the shares of letters that are Arabic, and a-z in either case; 0 without letters.

    The text is read once; what is counted is the length of what is left of its letters.
    """

    def shares(x: Column) -> Column:
        ar, la = (F.when(x["n"] > 0, (x["n"] - F.length(_without(x["l"], c))) / x["n"]).otherwise(F.lit(0.0)) for c in (f"[{BLOCKS}]+", "[A-Za-z]+"))
        return F.struct(ar.alias("arabic"), la.alias("latin"))

    return _let(_without(text, r"\P{L}+"), lambda t: _let(F.struct(t.alias("l"), F.length(t).alias("n")), shares))


def arabic_ratio(text: Column) -> Column:
    """Share of letters that are Arabic; 0 without letters."""
    return letter_ratios(text)["arabic"]


def latin_ratio(text: Column) -> Column:
    """Share of letters that are a-z in either case; 0 without letters."""
    return letter_ratios(text)["latin"]


def rtl_by(ratios: Column) -> Column:
    return ratios["arabic"] >= 0.4


def is_rtl(text: Column) -> Column:
    return rtl_by(letter_ratios(text))


def language_by(ratios: Column) -> Column:
    """ar, en or bilingual by letter_ratios; a tie is en."""
    ar, la = ratios["arabic"], ratios["latin"]
    return F.when(ar >= 0.85, "ar").when(la >= 0.85, "en").when((ar >= 0.15) & (la >= 0.15), "bilingual").when(ar > la, "ar").otherwise("en")


def classify_language(text: Column) -> Column:
    """ar, en or bilingual; a tie is en."""
    return _let(letter_ratios(text), language_by)


def has_presentation_forms(text: Column) -> Column:
    """Any presentation form that isn't legitimate; U+FEFF counts, as it lies in the block."""
    return text.rlike(rf"[{PRESENTATION}&&[^{LEGITIMATE}]]")


@lru_cache(maxsize=1)
def compatibility_forms() -> dict[str, str]:
    """Presentation form -> its NFKC image, by rule, for those that change and aren't legitimate."""
    legitimate = {0xFD3E, 0xFD3F, 0xFDFD, 0xFDF2, 0xFDFA, 0xFDFB, 0xFDFC}
    points = [*range(0xFB50, 0xFE00), *range(0xFE70, 0xFF00)]
    images = {chr(p): unicodedata.normalize("NFKC", chr(p)) for p in points if p not in legitimate}
    return {c: i for c, i in images.items() if c != i}


def _class_of(points: list[int]) -> str:
    """The inside of a character class, as runs of code points."""
    runs: list[list[int]] = []
    for p in sorted(points):
        if runs and p == runs[-1][1] + 1:
            runs[-1][1] = p
        else:
            runs.append([p, p])
    return "".join(rf"\x{{{a:X}}}-\x{{{b:X}}}" for a, b in runs)


def fold_presentation_forms(text: Column) -> Column:
    """Presentation forms as base letters. One-to-one images are translated, longer ones looked up in a text's pieces.

    Texts without presentation forms skip both.
    """
    forms = compatibility_forms()
    one_to_one = {c: i for c, i in forms.items() if len(i) == 1}
    longer = F.create_map(*[F.lit(x) for c, i in forms.items() if len(i) != 1 for x in (c, i)])
    some = _class_of([ord(c) for c, i in forms.items() if len(i) != 1])

    def spread(folded: Column) -> Column:
        pieces = F.regexp_extract_all(folded, F.lit(f"[{some}]|[^{some}]+"), F.lit(0))
        return F.array_join(F.transform(pieces, lambda x: F.when(F.length(x) == 1, F.coalesce(F.try_element_at(longer, x), x)).otherwise(x)), "")

    def folded(t: Column) -> Column:
        single = F.translate(t, "".join(one_to_one), "".join(one_to_one.values()))
        return F.when(has_presentation_forms(t), _let(single, lambda f: F.when(f.rlike(f"[{some}]"), spread(f)).otherwise(f))).otherwise(t)

    return _let(text, folded)


def mark_count(text: Column) -> Column:
    return count(text, f"[{MARKS}]")


def strip_bidi(text: Column) -> Column:
    return F.translate(text, BIDI, "")


def direction_score(text: Column) -> Column:
    """Higher the more the text reads like Arabic in logical order."""
    common = sum(((F.length(text) - F.length(F.replace(text, F.lit(w), F.lit("")))) / len(w) for w in COMMON_WORDS), F.lit(0.0))
    words = F.regexp_extract_all(text, F.lit(r"[؀-ۿ]+"), F.lit(0))

    def weight(w: Column) -> Column:
        return (
            F.when(w.startswith("ال"), 1.5).otherwise(0.0) - F.when(w.endswith("لا"), 1.5).otherwise(0.0) + F.when(w.endswith("ة"), 1.0).otherwise(0.0)
            + F.when(w.endswith("ى"), 0.7).otherwise(0.0) - F.when(w.startswith("ة"), 1.0).otherwise(0.0)
        )

    return 3 * common + F.aggregate(words, F.lit(0.0), lambda s, w: s + weight(w))


@lru_cache(maxsize=1)
def _combining() -> str:
    """A class of the characters that stay with the one before: combining class not 0, and MARKS."""
    return MARKS + _class_of([p for p in range(0x300, 0x1E95F) if unicodedata.combining(chr(p))])


def reverse_clusters(text: Column) -> Column:
    """The text backwards, by characters with their combining marks."""
    marks = rf"[\p{{M}}&&[{_combining()}]]"
    clusters = F.regexp_extract_all(text, F.lit(rf"(?s)^{marks}+|.{marks}*"), F.lit(0))
    return F.when(text.rlike(r"\p{M}"), F.array_join(F.reverse(clusters), "")).otherwise(F.reverse(text))


def fix_visual_order(text: Column, least: float = 0.2) -> Column:
    """struct(text, reversed): Arabic stored in visual order is turned round, Latin and number runs in it kept.

    Texts whose share of Arabic letters is under ``least`` stay; 0 judges all.
    """
    run = r"[A-Za-z0-9][A-Za-z0-9 .,:/@\-_]*[A-Za-z0-9]"

    def kept_runs(turned: Column) -> Column:
        runs = F.transform(F.regexp_extract_all(turned, F.lit(run), F.lit(0)), F.reverse)
        return F.array_join(F.flatten(F.zip_with(F.split(turned, run), runs, lambda a, b: F.array(F.coalesce(a, F.lit("")), F.coalesce(b, F.lit(""))))), "")

    def judged(x: Column) -> Column:
        scores = F.struct(direction_score(x["t"]).alias("f"), direction_score(x["r"]).alias("b"))
        turn = _let(scores, lambda s: s["b"] > F.greatest(s["f"] * 1.4, s["f"] + 6.0))
        return F.struct(F.when(turn, kept_runs(x["r"])).otherwise(x["t"]).alias("text"), turn.alias("reversed"))

    plain = _let(text, lambda t: F.struct(t.alias("text"), F.lit(False).alias("reversed")))
    turned = _let(text, lambda t: _let(F.struct(t.alias("t"), reverse_clusters(t).alias("r")), judged))
    return F.when(arabic_ratio(text) >= least, turned).otherwise(plain) if least > 0 else turned


def clean_line(text: Column, allow_reversal: bool = True) -> Column:
    """struct(text, presentation_forms, reversed, diacritics, tatweel_removed)."""
    return _let(strip_bidi(text), lambda bare: _let(fold_presentation_forms(bare), lambda folded: _cleaned(bare, folded, allow_reversal)))


def _cleaned(bare: Column, folded: Column, allow_reversal: bool) -> Column:
    if not allow_reversal:
        return _finished(bare, F.struct(folded.alias("text"), F.lit(False).alias("reversed")))
    return _let(fix_visual_order(folded), lambda order: _finished(bare, order))


def _finished(bare: Column, order: Column) -> Column:
    plain = F.translate(order["text"], TATWEEL, "")
    done = F.regexp_replace(F.regexp_replace(plain, r"[ \t]{2,}", " "), r"^[\s\x85\p{Z}\x1c-\x1f]+|[\s\x85\p{Z}\x1c-\x1f]+$", "")
    return F.struct(done.alias("text"), has_presentation_forms(bare).alias("presentation_forms"), order["reversed"].alias("reversed"), mark_count(plain).alias("diacritics"), count(order["text"], TATWEEL).alias("tatweel_removed"))


def validate_shaping(text: Column, preshaped: bool = False) -> Column:
    """struct(words, logical_score, issues, ok)."""
    words = F.regexp_extract_all(text, F.lit(rf"[؀-ۿ{PRESENTATION}]+"), F.lit(0))
    if preshaped:
        forms, base = count(text, rf"[{PRESENTATION}&&[^{LEGITIMATE}]]"), count(text, r"[ء-ي]")
        found = [F.when((forms == 0) & (base > 50), "expected_preshaped_text_but_found_none").when((forms > 0) & (base > forms * 0.6), "many_unshaped_letters")]
    else:
        single = F.size(F.filter(words, lambda w: F.length(w) == 1))
        found = [F.when(has_presentation_forms(text), "residual_presentation_forms"), F.when(F.size(words) > 0, F.when(single / F.nullif(F.size(words), F.lit(0)) > 0.45, "disconnected_letters"))]
    found += [F.when(text.contains(TATWEEL), "tatweel_present"), F.when(text.rlike(f"[{BIDI}]"), "bidi_control_chars")]
    issues = F.filter(F.array(*found), lambda x: x.isNotNull())
    return F.struct(F.size(words).alias("words"), F.round(direction_score(text), 1).alias("logical_score"), issues.alias("issues"), (F.size(issues) == 0).alias("ok"))


#: The Latin letters of lower-cased text as Arabic ones, for tables that hold no Arabic.
ARABISE = ("abcdefghijklmnopqrstuvwxyz", "ابتثجحخدذرزسشصضطظعغفقكلمنه")


def arabised(text: Column) -> Column:
    return F.translate(F.lower(text), *ARABISE)
