"""Verdicts, gates and scores over recognised and converted books."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def threshold(lang: Column) -> Column:
    return F.when(lang.startswith("ara"), 78.0).otherwise(70.0)


def confidence_verdict(conf: Column, lang: Column) -> Column:
    t = threshold(lang)
    return F.when(conf >= t, "good").when(conf >= t - 12, "marginal").otherwise("poor")


def low_confidence(words: Column, conf: Column, lang: Column, cloud: Column) -> Column:
    return (words > 5) & (conf < F.when(cloud, 0.0).otherwise(threshold(lang)))


def demoted(route: Column, verdict: Column, lang: Column) -> Column:
    return F.when((route == "ocr") & ((verdict == "poor") | (verdict == "marginal") & lang.startswith("ara")), "fixed").otherwise(route)


def engine(requested: Column, available: Column, ok: Column) -> Column:
    return F.when(requested.isin("azure", "auto", "cloud") & available & ok, "cloud").otherwise("local")


def skip_local(engine_: Column, cloud_mean: Column) -> Column:
    return (engine_ == "cloud") & (cloud_mean >= 90.0)


def keep_layer(doc_type: Column, chars: Column, columns: Column, winner: Column, score: Column, other: Column) -> Column:
    return (doc_type == "text_over_scan") & (chars > 500) & (columns == 1) & (winner == "existing") & (score >= other + 8)


def quality_gate(recall: Column, token_ratio: Column, arabic_ok: Column, subset: Column) -> Column:
    """PASS, WARN or FAIL. A token ratio of 0 or null counts as 1; a null recall, Arabic check or font check passes."""
    ratio = F.coalesce(F.nullif(token_ratio, F.lit(0.0)), F.lit(1.0))
    failed = F.coalesce((recall < 0.70) | (recall.isNotNull() & (ratio < 0.60)), F.lit(False)) | ~F.coalesce(arabic_ok, F.lit(True)) | F.coalesce(subset, F.lit(False))
    return F.when(failed, "FAIL").when(F.coalesce(recall < 0.85, F.lit(False)), "WARN").otherwise("PASS")


def quality_score(gate: Column, conf: Column, recall: Column, arabic_ok: Column, subset: Column, review: Column, pages: Column) -> Column:
    """0 to 100."""
    base = F.when(gate == "FAIL", 55).when(gate == "WARN", 78).otherwise(90)
    by_conf = F.when(F.coalesce(conf, F.lit(0.0)) >= 93, 6).when(F.coalesce(conf, F.lit(0.0)) >= 85, 3).otherwise(0)
    by_recall = F.when(recall.isNull(), 0).when(recall >= 0.97, 4).when(recall >= 0.90, 2).otherwise(-4)
    by_checks = F.when(F.coalesce(arabic_ok, F.lit(True)), 0).otherwise(-15) + F.when(F.coalesce(subset, F.lit(False)), -20).otherwise(0)
    by_review = F.least(F.lit(8), (review / F.coalesce(F.nullif(pages, F.lit(0)), F.lit(1)) * 40).cast("int"))
    return F.greatest(F.lit(0), F.least(F.lit(100), base + by_conf + by_recall + by_checks - by_review))


def badge(gate: Column, review: Column, score: Column) -> Column:
    return F.when(gate == "FAIL", "Page-exact only").when((review > 0) | (gate == "WARN"), "Review").when(score >= 90, "Excellent").otherwise("Good")


def output_ok(opens: Column, format_ok: Column, subset: Column) -> Column:
    return opens & F.coalesce(format_ok, F.lit(True)) & ~F.coalesce(subset, F.lit(False))


#: Signatures of file formats: extension -> (offset, bytes in hex), either of several (fixed values).
MAGIC = {"azw3": [(60, "424F4F4B4D4F4249")], "mobi": [(60, "424F4F4B4D4F4249")], "epub": [(0, "504B")], "pdf": [(0, "25504446")], "kfx": [(0, "434F4E54"), (0, "EA44524D494F4E")]}


def magic_ok(name: Column, head: Column) -> Column:
    """Does a file's head (binary) have its extension's signature; null for other extensions."""
    ext = F.lower(F.substring_index(name, ".", -1))
    out = F.lit(None).cast("boolean")
    for e, options in MAGIC.items():
        hit = F.lit(False)
        for at, sign in options:
            hit = hit | (F.hex(F.substr(head, F.lit(at + 1), F.lit(len(sign) // 2))) == sign)
        out = F.when(ext == e, hit).otherwise(out)
    return out


def font_check(sizes: Column) -> Column:
    """struct(embedded, subset_suspected) from the sizes of embedded fonts."""
    return F.struct((F.size(sizes) > 0).alias("embedded"), F.coalesce(F.array_min(sizes) < 200_000, F.lit(False)).alias("subset_suspected"))


def wants_pdf(mode: Column, route: Column, doc_type: Column) -> Column:
    return (mode == "always") | (mode == "auto") & ((route == "fixed") | (doc_type != "text"))


def font_mode(mode: Column, rtl: Column) -> Column:
    return F.when(mode == "auto", F.when(rtl, "preshape").otherwise("native")).otherwise(mode)


def heading_mode(toc_entries: Column) -> Column:
    return F.when(toc_entries >= 5, "conservative").otherwise("ocr")


def endpoint(url: Column) -> Column:
    """A service address: https:// put before it, http refused (null), scheme in lower case, host required."""
    t = F.trim(url)
    full = F.when(t.rlike(r"(?i)^https://"), F.concat(F.lit("https://"), F.substr(t, F.lit(9)))).when(t.rlike("(?i)^[a-z][a-z0-9+.-]*://"), F.lit(None)).otherwise(F.concat(F.lit("https://"), t))
    return F.when(full.rlike(r"^https://[^/\s:]+"), full)


def backoff(attempt: Column) -> Column:
    return F.least(4 * F.power(F.lit(2.0), attempt), F.lit(45.0))


def connection_hint(message: Column) -> Column:
    low = F.lower(message)
    return (
        F.when(low.contains("401") | low.contains("access denied") | low.contains("invalid subscription"), "check the key")
        .when(low.contains("404") | low.contains("not found"), "check the address")
        .when(low.contains("getaddrinfo") | low.contains("name or service"), "the host name is not known")
        .when(low.contains("timed out") | low.contains("timeout"), "the service does not answer")
        .when(low.contains("429") | low.contains("quota"), "too many requests")
        .otherwise("see the message")
    )


def recommended(gate: Column, has_fixed: Column, has_kfx: Column) -> Column:
    return F.when((gate == "FAIL") & has_fixed, "azw3_fixed").when(has_kfx, "kfx").otherwise("azw3")


def actions(a: dict[str, Column]) -> Column:
    """What was done to a book, a sentence each; a default if nothing was."""
    rows = F.filter(
        F.array(F.when(a["skew_max"] > 0.15, F.lit("straightened pages")), *[F.when(a[k] > 0, F.format_string(f"%d {k.replace('_', ' ')}", a[k])) for k in ("blank_pages_removed", "duplicate_pages_removed", "noisy_pages_cleaned", "running_heads_removed", "page_numbers_removed", "cross_page_merges")]),
        lambda x: x.isNotNull(),
    )
    return F.when(F.size(rows) > 0, rows).otherwise(F.array(F.lit("nothing needed mending")))
