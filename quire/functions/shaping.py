"""Arabic letters in their joined forms, and texts adapted to a font.

The tables follow by rule from Unicode's compatibility decompositions of the presentation forms.
"""

from __future__ import annotations

import unicodedata
from functools import lru_cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions.arabic import MARKS, TATWEEL, _let

POSITIONS = ("isolated", "final", "initial", "medial")


def decomposed(code: int) -> tuple[str, str] | None:
    """(position, base letters) of a joined form; None for all else."""
    tag, _, rest = unicodedata.decomposition(chr(code)).partition("> ")
    if tag.lstrip("<") not in POSITIONS:
        return None
    return tag.lstrip("<"), "".join(chr(int(x, 16)) for x in rest.split())


@lru_cache(maxsize=1)
def joined_forms() -> dict[str, dict[str, str]]:
    """base letters -> position -> form, from the second block of forms, which has every letter of the alphabet."""
    found: dict[str, dict[str, str]] = {}
    for code in range(0xFE80, 0xFEFD):
        if d := decomposed(code):
            found.setdefault(d[1], {}).setdefault(d[0], chr(code))
    return found


def ligature_fallback() -> dict[str, str]:
    """Lam-alef forms -> their two letters."""
    return {form: base for base, forms in joined_forms().items() if len(base) == 2 for form in forms.values()}


def _map(pairs: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for kv in pairs.items() for x in kv])


def preshaped(text: Column, keep_marks: bool = False) -> Column:
    """Base letters as joined forms; texts without Arabic stay. Marks are dropped unless kept (then they join through)."""
    forms = {b: f for b, f in joined_forms().items() if len(b) == 1}
    ligatures = {b: f for b, f in joined_forms().items() if len(b) == 2}
    both = "".join(b for b, f in forms.items() if "initial" in f) + TATWEEL  # letters that join to the next one
    any_ = "".join(forms) + TATWEEL  # letters that join to the one before
    plain = text if keep_marks else F.regexp_replace(text, f"[{MARKS}]", "")
    # a unit is a lam-alef, or any other character with the marks that follow
    units = F.regexp_extract_all(plain, F.lit(rf"(?s)ل[آأإا][{MARKS}]*|.[{MARKS}]*"), F.lit(0))
    tables = {p: _map({b: f[p] for b, f in {**forms, **ligatures}.items() if p in f}) for p in POSITIONS}

    def shape(u: Column) -> Column:
        def one(x: Column, i: Column) -> Column:
            base = F.regexp_replace(x, f"[{MARKS}]", "")
            marks = F.regexp_replace(x, f"[^{MARKS}]", "")
            before = F.coalesce(F.regexp_replace(F.get(u, i - 1), f"[{MARKS}]", "").rlike(f"^[{both}]$"), F.lit(False))
            after = F.coalesce(F.regexp_replace(F.get(u, i + 1), f"[{MARKS}]", "").rlike(f"^(?:[{any_}]|ل[آأإا])"), F.lit(False)) & base.rlike(f"^[{both}]$")
            joins = before & base.rlike(f"^(?:[{any_}]|ل[آأإا])$") & (base != "ء")
            form = F.when(joins & after, F.try_element_at(tables["medial"], base)).when(joins, F.try_element_at(tables["final"], base)).when(after, F.try_element_at(tables["initial"], base)).otherwise(F.try_element_at(tables["isolated"], base))
            return F.concat(F.coalesce(form, base), marks)

        return F.array_join(F.transform(u, one), "")

    return F.when(text.rlike(r"[؀-ۿ]"), _let(units, shape)).otherwise(text)


def adapted(text: Column, covered: Column) -> Column:
    """struct(text, ligatures, missing): lam-alef forms that a font (an array of its characters) lacks, as two letters.

    A form is only taken apart if the font has both letters. missing holds up to ten other characters that it lacks.
    """
    fallback = ligature_fallback()

    def done(t: Column) -> Column:
        able = {c: ~F.array_contains(covered, c) & F.forall(F.array(*map(F.lit, two)), lambda x: F.array_contains(covered, x)) for c, two in fallback.items()}
        out = t
        for c, two in fallback.items():
            out = F.replace(out, F.when(able[c], c).otherwise(""), F.lit(two))
        return _let(F.struct(t.alias("t"), out.alias("o")), ended)

    def ended(x: Column) -> Column:
        # a form is one character and takes two letters, so the text grows by one for each
        rest = F.regexp_replace(F.call_function("translate", x["o"], F.array_join(covered, ""), F.lit("")), r"\s+", "")
        left = F.filter(F.array_distinct(F.split(rest, "")), lambda c: c != "")
        return F.struct(x["o"].alias("text"), (F.length(x["o"]) - F.length(x["t"])).alias("ligatures"), F.slice(F.array_sort(left), 1, 10).alias("missing"))

    return _let(text, done)


def flattened(cmap: DataFrame, substitutions: DataFrame, ligatures: DataFrame) -> DataFrame:
    """(code, glyph, how) for the joined forms that a font's cmap lacks: by substitution or ligature, else missing.

    cmap: (code, glyph); substitutions: (feature, glyph, to) with init, medi, fina, isol; ligatures: (glyphs, to), the
    parts' glyphs joined by a space, shaped for their position or plain.
    """
    spark = cmap.sparkSession
    short = {"initial": "init", "medial": "medi", "final": "fina", "isolated": "isol"}
    rows = [(c, short[d[0]], [ord(x) for x in d[1]]) for c in [*range(0xFB50, 0xFE00), *range(0xFE70, 0xFEFD)] if (d := decomposed(c))]
    want = spark.createDataFrame(rows, "code int, feature string, bases array<int>").join(cmap.select("code"), "code", "left_anti")
    glyph = cmap.select(F.col("code").alias("base"), F.col("glyph").alias("base_glyph"))
    parts = want.select("code", "feature", F.size("bases").alias("n"), F.posexplode("bases").alias("i", "base")).join(glyph, "base", "left")
    side = F.when(F.col("n") == 1, F.col("feature")).when((F.col("i") == 0) & F.col("feature").isin("init", "isol"), F.lit("init")).when(F.col("i") == 0, F.lit("medi")).otherwise(F.lit("fina"))
    parts = parts.withColumn("f", side).join(substitutions.select(F.col("feature").alias("f"), F.col("glyph").alias("base_glyph"), "to"), ["f", "base_glyph"], "left")
    held = parts.groupBy("code", "feature", "n").agg(F.array_sort(F.collect_list(F.struct("i", "base_glyph", "to"))).alias("p"), F.count("base_glyph").alias("known"))
    single = F.coalesce(F.get("p", F.lit(0))["to"], F.when(F.col("feature") == "isol", F.get("p", F.lit(0))["base_glyph"]))
    keys = F.array(*[F.array_join(F.transform("p", f), " ") for f in (lambda x: F.coalesce(x["to"], x["base_glyph"]), lambda x: x["base_glyph"], lambda x: F.coalesce(F.when(x["i"] == 0, x["to"]), x["base_glyph"]))])
    multi = held.where("n > 1 and known = n").select("code", F.posexplode(keys).alias("k", "glyphs")).join(ligatures.select("glyphs", F.col("to").alias("lig")), "glyphs").groupBy("code").agg(F.min_by("lig", "k").alias("lig"))
    out = held.join(multi, "code", "left").withColumn("glyph", F.when(F.col("n") == 1, single).otherwise(F.col("lig")))
    how = F.when(F.col("glyph").isNull(), "missing").when(F.col("n") > 1, "ligature").otherwise("added")
    return out.select("code", "glyph", how.alias("how"))
