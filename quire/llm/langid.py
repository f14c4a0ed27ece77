"""Language identification by Bayesian fusion of evidence.

For each row: log P(text | language), from a model of letter trigrams, plus log P(declared markup language |
language), plus the log prior of its host. Priors are smoothed down a hierarchy, host -> domain -> address suffix ->
all rows: each level's counts are mixed with SMOOTH times its parent's distribution, and the row's own count is left
out. Suffixes of one country start from their language. All counts (languages of hosts, domains and suffixes, and how
often a declared language goes with a language of the text) come from grouped aggregations over all rows, by the
language that the text alone suggests. A background class, "und", stands for text of no known language.

The trigram model is fitted on labelled texts: for each label about FIT_ROWS of its distinct texts at most, chosen by a
hash of the text, and all texts of a label that has fewer; its trigrams are the MODEL_GRAMS most frequent of each
label. So the model grows with the number of labels. Everything else covers all rows and whole texts.

Defined results: a null text, or one without letters, is "und" with confidence 0; null or unknown declarations and
hosts are no evidence; labels and declarations such as en-US count for en, and case and blanks around
them don't matter; repeated rows give repeated rows; of languages that are equally probable the first by name
is taken; an empty table gives an empty result; without any labelled row every row is "und"; other columns are ignored by
identify() and stay as they are, whatever their names, in keep_identified(). The languages known are those of all labels,
but for blank ones and "und".
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.llm.common import as_rows, field, fields, settle, text_digest
from quire.session import ship

FIT_ROWS = 3000
MODEL_GRAMS = 40_000
SMOOTH = 20.0
EFFECTIVE = 60
UND = "und"
UND_PRIOR = 0.01
MIN_POSTERIOR = 0.5
BROADCAST_HOSTS = 100_000
BROADCAST_KEYS = 200_000
#: Suffixes that stand for one language (fixed values).
SUFFIX_LANGUAGE = {"de": "de", "at": "de", "fr": "fr", "es": "es", "mx": "es", "ar": "es", "uk": "en", "us": "en", "au": "en", "ie": "en", "it": "it", "pt": "pt", "br": "pt", "nl": "nl", "pl": "pl", "ru": "ru", "jp": "ja", "cn": "zh", "se": "sv"}
#: Scripts that part no words by spaces: their runs of letters count beside digits too (ranges of code points).
_UNSPACED = "\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u9fff\uf900-\ufaff"
_WORDS = re.compile(rf"(?<!\w)[^\W\d_]++(?!\w)|[{_UNSPACED}]+")  # numbers and keys hold no words
PIECE = 40
#: Trigrams at a time, so that a long text takes a bounded amount of memory beside its own.
CHUNK = 1 << 17
#: Words stand between < and >, which are no letters; what a number of three ASCII characters has no bit of.
_END, _BEYOND_ASCII = ord(">"), (1 << 63) - 1 ^ (0x7F << 42 | 0x7F << 21 | 0x7F)


def _packed(numbers: np.ndarray) -> np.ndarray:
    return numbers >> 28 & 0x1FC000 | numbers >> 14 & 0x3F80 | numbers & 0x7F


def pieces(word: str) -> list[str]:
    """A word with marks at its ends, in pieces that share no trigram and together hold all."""
    w = f"<{word}>"
    return [w] if len(w) <= PIECE + 2 else [w[i : i + PIECE] for i in range(0, len(w) - 2, PIECE - 2)]


def grams(piece: str) -> list[str]:
    """The plain form of trigrams(), for a piece of one word."""
    return [piece[i : i + 3] for i in range(len(piece) - 2)]


def trigrams(words: list[str]) -> Iterator[np.ndarray]:
    """The trigrams of words with marks at their ends, CHUNK at a time, each as its three code points in one number."""
    points = np.frombuffer(f"<{'><'.join(words)}>".encode("utf-32-le"), "<u4")
    for at in range(0, len(points) - 2, CHUNK):
        p = points[at : at + CHUNK + 2].astype(np.int64)
        first, second, third = p[:-2], p[1:-1], p[2:]
        yield (first << 42 | second << 21 | third)[(first != _END) & (second != _END)]  # the rest go beyond a word's end


def gram_of(number: int) -> str:
    return "".join(chr(number >> at & 0x1FFFFF) for at in (42, 21, 0))


class TextModel:
    """log P(trigram | language) for each language, and for the background as the last column.

    A text's evidence is the mean log likelihood of a trigram times their number, EFFECTIVE at most.
    """

    def __init__(self, languages: list[str], counts: dict[str, list[float]]):
        self.languages = languages
        size = len(counts) + 1
        c = np.array(list(counts.values()), dtype=np.float64).reshape(len(counts), len(languages))
        numbers = np.array([ord(g[0]) << 42 | ord(g[1]) << 21 | ord(g[2]) for g in counts], dtype=np.int64)
        order = np.argsort(numbers)
        self.numbers, c = numbers[order], c[order]
        # mixed with the background: a rare or new trigram speaks a little against a language, a common one much for it
        logs = np.log((1 - math.exp(-1)) * c / np.maximum(c.sum(axis=0), 1) + math.exp(-1) / size)
        rare = np.append(np.full(len(languages), -math.log(size) - 1.0), -math.log(size))
        self.logs = np.vstack([np.hstack([logs, np.full((len(c), 1), -math.log(size))]), rare])  # the last row is for the rest
        self.ascii: np.ndarray | None = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"ascii": None}

    def _rows(self, numbers: np.ndarray) -> np.ndarray:
        """The row of each trigram in logs: by a table where all three characters are ASCII, else by search."""
        if self.ascii is None:
            self.ascii = np.full(1 << 21, len(self.numbers), dtype=np.int32)
            plain = np.flatnonzero(self.numbers & _BEYOND_ASCII == 0)
            self.ascii[_packed(self.numbers[plain])] = plain
        rows = self.ascii[_packed(numbers)]
        other = np.flatnonzero(numbers & _BEYOND_ASCII)
        if len(other):
            asked = numbers[other]
            at = np.searchsorted(self.numbers, asked)
            found = self.numbers.take(at, mode="clip") == asked if len(self.numbers) else np.zeros(len(asked), dtype=bool)
            rows[other] = np.where(found, at, len(self.numbers))
        return rows

    def score(self, texts: list[str | None]) -> list[tuple[int, np.ndarray]]:
        """(words, evidence) of each text."""
        out = []
        for text in texts:
            words = _WORDS.findall((text or "").lower())
            total, n = np.zeros(self.logs.shape[1]), 0
            for numbers in trigrams(words) if words else ():
                total += self.logs[self._rows(numbers)].sum(axis=0)
                n += len(numbers)
            out.append((len(words), total / n * min(n, EFFECTIVE) if n else total))
        return out


def primary(tag: Column) -> Column:
    """The language of a tag such as en-US."""
    return F.regexp_extract(F.lower(F.trim(tag)), "^[^_-]*", 0)


def fit(labelled: DataFrame, text_col: str, label_col: str, fit_rows: int = FIT_ROWS) -> TextModel:
    ship(labelled.sparkSession)
    label = primary(F.col(label_col).cast("string"))
    rows = labelled.where((F.length(text_col) > 0) & (label != "") & (label != UND)).select(label.alias("label"), F.col(text_col).alias("text"))
    # the draw is of distinct texts, so its rate is by their number, whatever copies there are
    n = settle(rows.select("label", text_digest(F.col("text")).alias("d")).distinct().groupBy("label").count(), "labels")
    rates = n.select("label", F.least(F.lit(1.0), fit_rows / F.col("count")).alias("rate"))
    rows = rows.join(F.broadcast(rates), "label").where(F.pmod(F.xxhash64(F.lit("fit"), "text"), F.lit(1 << 30)) < F.col("rate") * (1 << 30)).select("label", "text").dropDuplicates(["label", "text"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            labels, grams, counts = [], [], []
            texts: dict[str, list[str]] = {}
            for label, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                texts.setdefault(label, []).append(text)
            for label, own in texts.items():
                labels.append(label), grams.append(""), counts.append(len(own))
                for text in own:
                    words = _WORDS.findall(text.lower())
                    for part in trigrams(words) if words else ():
                        numbers, n = np.unique(part, return_counts=True)
                        labels += [label] * len(n)
                        grams += map(gram_of, numbers.tolist())
                        counts += n.tolist()
            yield pa.RecordBatch.from_arrays([pa.array(labels, pa.string()), pa.array(grams, pa.string()), pa.array(counts, pa.int64())], names=["label", "gram", "n"])

    counted = settle(rows.mapInArrow(run, "label string, gram string, n bigint").groupBy("label", "gram").agg(F.sum("n").alias("n")), "grams")
    grams_of = counted.where("gram != ''")
    rank = F.row_number().over(Window.partitionBy("label").orderBy(F.col("n").desc(), "gram"))
    kept = grams_of.withColumn("rank", rank).where(F.col("rank") <= MODEL_GRAMS).select("gram").distinct()
    cells = grams_of.join(kept, "gram").select("gram", "label", "n").collect()
    languages = sorted(r["label"] for r in counted.where("gram = ''").select("label").collect())
    at, found = {k: i for i, k in enumerate(languages)}, {}
    for g, label, n in sorted(map(tuple, cells)):
        found.setdefault(g, np.zeros(len(languages)))[at[label]] = n
    return TextModel(languages, found)


def host_of(url: Column) -> tuple[Column, Column, Column]:
    """(host, domain, suffix) of a web address; null where there is none."""
    host = F.lower(F.nullif(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]+)", 1), F.lit("")))
    return host, F.coalesce(F.nullif(F.regexp_extract(host, r"([^.]+\.[^.]+)$", 1), F.lit("")), host), F.nullif(F.regexp_extract(host, r"\.([^.]+)$", 1), F.lit(""))


def markup_language(html: Column) -> Column:
    """The primary subtag of the lang attribute of <html>; null where there is none."""
    return F.lower(F.nullif(F.regexp_extract(html, r"(?i)<html\b[^>]*?\blang\s*=\s*[\"']?([A-Za-z]{2,3})", 1), F.lit("")))


def identify(rows: DataFrame, model: TextModel, id_col: str, text: Column, declared: Column, host: Column, domain: Column | None = None, suffix: Column | None = None) -> DataFrame:
    """(id_col, digest, n_words, language, confidence, text_language, declared) for each row; digest is the text's."""
    ship(rows.sparkSession)
    languages = [*model.languages, UND]
    size = len(languages)
    kind = rows.schema[id_col].dataType.simpleString()
    none = F.lit(None).cast("string")
    picked = rows.select(F.col(id_col).alias("id"), text.alias("text"), primary(declared).alias("declared"), host.alias("host"), (domain if domain is not None else none).alias("domain"), (suffix if suffix is not None else none).alias("suffix"))
    picked = picked.withColumn("digest", text_digest(F.col("text")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            scored = [x for at in range(0, b.num_rows, 128) for x in model.score(b.column(1).slice(at, 128).to_pylist())]
            cols = [b.column(i) for i in (0, 2, 3, 4, 5)] + [b.column(6).field(0), b.column(6).field(1)]
            cols += [pa.array([n for n, _ in scored], pa.int64()), pa.array([e for _, e in scored], pa.list_(pa.float64()))]
            yield pa.RecordBatch.from_arrays(cols, names=["id", "declared", "host", "domain", "suffix", "da", "db", "n_words", "evidence"])

    schema = f"id {kind}, declared string, host string, domain string, suffix string, da bigint, db bigint, n_words bigint, evidence array<double>"
    base = picked.mapInArrow(run, schema)
    # by the text alone, with even priors
    best = F.array_position("evidence", F.array_max("evidence")).cast("int")
    base = base.withColumn("guess", F.when(F.col("n_words") > 0, best).otherwise(F.lit(size)))
    for c in ("host", "domain", "suffix"):
        base = base.withColumn(c, F.coalesce(c, F.lit("")))
    base = settle(base, "language-evidence")

    counts = [F.sum(F.when(F.col("guess") == i + 1, 1.0).otherwise(0.0)) for i in range(size)]
    cube = settle(base.groupBy("suffix", "domain", "host").agg(F.array(*counts).alias("c")), "language-counts")

    def level(by: list[str]) -> DataFrame:
        if by == ["suffix", "domain", "host"]:
            return cube
        return cube.groupBy(*by).agg(F.array(*[F.sum(F.get("c", F.lit(i))) for i in range(size)]).alias("c"))

    known = base.where("n_words > 0").groupBy().agg(*[F.sum(F.when(F.col("guess") == i + 1, 1.0).otherwise(0.0)).alias(f"c{i}") for i in range(size)]).first()
    total = [float(x or 0.0) for x in known] if known else [0.0] * size
    everyone = [(x + 1.0) / (sum(total) + size) for x in total]
    everyone[-1] = UND_PRIOR
    everyone = [x / sum(everyone) for x in everyone]

    def mixed(c: Column, parent: Column) -> Column:
        n = F.aggregate(c, F.lit(0.0), lambda s, x: s + x)
        return F.zip_with(c, parent, lambda x, p: (x + F.lit(SMOOTH) * p) / (n + F.lit(SMOOTH)))

    start = F.array(*map(F.lit, everyone))
    for end, lang in SUFFIX_LANGUAGE.items():
        if lang in model.languages:
            own = [0.5 * x + (0.5 if k == lang else 0.0) for x, k in zip(everyone, languages)]
            start = F.when(F.col("suffix") == end, F.array(*map(F.lit, own))).otherwise(start)
    by_suffix = level(["suffix"]).select("suffix", F.when(F.col("suffix") == "", start).otherwise(mixed(F.col("c"), start)).alias("p_suffix"))
    by_domain = level(["suffix", "domain"]).join(by_suffix, "suffix").select("suffix", "domain", F.when(F.col("domain") == "", F.col("p_suffix")).otherwise(mixed(F.col("c"), F.col("p_suffix"))).alias("p_domain"))
    by_host = level(["suffix", "domain", "host"]).join(by_domain, ["suffix", "domain"]).select("suffix", "domain", "host", "c", "p_domain")
    by_host = settle(by_host, "language-priors")
    if by_host.count() <= BROADCAST_HOSTS:
        by_host = F.broadcast(by_host)

    # P(declared | language), for the declarations that are a known language; others say nothing
    pairs = base.where(F.col("declared").isin(model.languages) & (F.col("n_words") > 0)).groupBy("declared", "guess").count().collect() if model.languages else []
    seen = {(r["declared"], r["guess"]): float(r["count"]) for r in pairs}
    told = F.array(*[F.lit(0.0)] * size)
    for lang in model.languages:
        row = []
        for i in range(size):
            of = sum(seen.get((k, i + 1), 0.0) for k in model.languages)
            row.append(math.log((seen.get((lang, i + 1), 0.0) + 1.0) / (of + len(model.languages))))
        told = F.when(F.col("declared") == lang, F.array(*map(F.lit, row))).otherwise(told)

    fused = base.join(by_host, ["suffix", "domain", "host"])
    own = F.transform(F.col("c"), lambda x, i: F.greatest(F.lit(0.0), x - F.when(i + 1 == F.col("guess"), 1.0).otherwise(0.0)))
    prior = F.when(F.col("host") == "", F.col("p_domain")).otherwise(mixed(own, F.col("p_domain")))
    fused = fused.withColumn("prior", prior).withColumn("said", told)
    logs = F.zip_with(F.zip_with(F.col("evidence"), F.col("said"), lambda a, b: a + b), F.col("prior"), lambda a, p: a + F.log(F.greatest(p, F.lit(1e-12))))
    fused = fused.withColumn("logs", logs).withColumn("top", F.array_max("logs"))
    weight = F.aggregate(F.col("logs"), F.lit(0.0), lambda s, x: s + F.exp(x - F.col("top")))
    name = F.array(*map(F.lit, languages))
    found = F.element_at(name, F.array_position("logs", F.col("top")).cast("int"))
    has = F.col("n_words") > 0
    sure = F.when(has, 1 / weight).otherwise(0.0)
    return fused.select(
        F.col("id").alias(id_col), F.struct(F.col("da").alias("a"), F.col("db").alias("b")).alias("digest"), "n_words",
        F.when(has & (sure >= MIN_POSTERIOR), found).otherwise(F.lit(UND)).alias("language"), F.round(sure, 6).alias("confidence"),
        F.when(has, F.element_at(name, F.col("guess"))).otherwise(F.lit(UND)).alias("text_language"), "declared",
    )


def documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", declared_col: str = "lang", host_col: str = "source") -> DataFrame:
    """identify() for rows that carry a declared language and a source, which stands for the host."""
    model = fit(docs, text_col, declared_col)
    return identify(docs, model, id_col, F.col(text_col), F.col(declared_col), F.col(host_col))


def keep_identified(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", declared_col: str = "lang", host_col: str = "source") -> DataFrame:
    """docs without the rows of no known language; all columns stay."""
    lost = documents(docs, id_col, text_col, declared_col, host_col).where(F.col("language") == UND)
    lost = settle(lost.select(F.col(id_col).alias("id"), F.col("digest").alias("d")).distinct(), "unidentified")
    if lost.count() <= BROADCAST_KEYS:
        lost = F.broadcast(lost)
    marked = as_rows(docs).withColumn("digest", text_digest(field(text_col)))
    return marked.join(lost, field(id_col).eqNullSafe(lost["id"]) & (marked["digest"] == lost["d"]), "left_anti").select(*fields(docs))
