"""License scans with a positional index of rare tokens.

The library holds templates: the words of a license's notice, its label, and the mandatory key phrase that stands in it.
A scan splits each file into words once and keeps, for every place, a code of the word if it is one of the library's.
One grouped aggregation over these codes counts how many files hold each word. The RARE words of the highest IDF of a
template, of those that some file holds, are posted in the index with their positions: word -> (template, position).

A file's rare words are looked up in the index. A posting moved back by its position votes for a start of its template in
the file, so votes of different words for one start are words that stand at the template's own relative positions. The
votes are intersected by start: at least two in five of a template's postings must agree on it, as notices are cut short (all words of a base phrase
must). Where they do, the mandatory key phrase is verified word by word, and the score is the share of the template's
words that stand in their place, the best over all places.

So a key phrase alone gives no label of a notice, and rare words without the key phrase give none either. The base phrases
are templates of their own whose words are all mandatory, so their places are counted exactly.

Runs inside one projection on each file: no file's words are shuffled, and a long file costs in proportion to its
length and its votes. Defined results: a null text is empty (0 words, no labels, score 0); repeated rows give repeated
rows; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm.common import as_rows, ascii_lower, field, pieces, settle

#: What parts words: all ASCII but digits and letters. All else is part of a word.
APART = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Words of the highest IDF by which a notice is posted in the index.
RARE = 8
BASE_RARE = 2
#: Starts may lie before the file, where a notice is cut short.
BEFORE = 1 << 20

#: Phrases and their labels (fixed values).
BASE = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
#: label, mandatory key phrase, words of the notice; notices are public texts (fixed values).
NOTICES = [
    ("mit", "permission is hereby granted free of charge", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction"),
    ("mit", "the software is provided as is without warranty of any kind", "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement"),
    ("isc", "with or without fee is hereby granted", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"),
    ("bsd", "redistribution and use in source and binary forms", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("bsd", "endorse or promote products derived from this software", "may be used to endorse or promote products derived from this software without specific prior written permission"),
    ("apache", "licensed under the apache license", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license"),
    ("apache", "http www apache org licenses", "you may obtain a copy of the license at http www apache org licenses license 2 0"),
    ("gpl", "under the terms of the gnu general public license", "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    ("lgpl", "gnu lesser general public license", "you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation"),
    ("lgpl", "gnu library general public license", "you can redistribute it and or modify it under the terms of the gnu library general public license as published by the free software foundation"),
    ("agpl", "gnu affero general public license", "you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation"),
    ("gfdl", "gnu free documentation license", "permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license"),
    ("mpl", "terms of the mozilla public license", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("epl", "terms of the eclipse public license", "this program and the accompanying materials are made available under the terms of the eclipse public license"),
    ("cddl", "common development and distribution license", "the contents of this file are subject to the terms of the common development and distribution license"),
    ("eupl", "european union public licence", "licensed under the eupl the european union public licence"),
    ("artistic", "the artistic license", "you may distribute under the terms of either the gnu general public license or the artistic license"),
    ("unlicense", "released into the public domain", "this is free and unencumbered software released into the public domain"),
    ("boost", "boost software license", "distributed under the boost software license version 1 0"),
    ("zlib", "in no event will the authors be held liable", "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages"),
    ("wtfpl", "do what the fuck you want to", "everyone is permitted to copy and distribute verbatim or modified copies of this license document do what the fuck you want to public license"),
    ("cc0", "cc0 1 0", "licensed under cc0 1 0 universal"),
    ("ofl", "sil open font license", "this font software is licensed under the sil open font license version 1 1"),
    ("ms-pl", "microsoft public license", "this license governs use of the accompanying software microsoft public license"),
    ("postgresql", "without a written agreement is hereby granted", "permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement is hereby granted"),
    ("python", "python software foundation license", "python software foundation license version 2"),
    ("openssl", "for use in the openssl toolkit", "this product includes software developed by the openssl project for use in the openssl toolkit"),
    ("odbl", "open database license", "made available under the open database license"),
    ("all-rights-reserved", "all rights reserved", "all rights reserved"),
]
#: Names of licenses after "licensed under the" or "released under the", and their labels (fixed values).
NAMED = {
    "mit license": "mit", "x11 license": "x11", "isc license": "isc", "bsd license": "bsd", "bsd 2 clause license": "bsd", "bsd 3 clause license": "bsd", "apache license": "apache", "apache software license": "apache", "gnu general public license": "gpl", "gnu gpl": "gpl", "gnu lgpl": "lgpl",
    "gnu lesser general public license": "lgpl", "gnu affero general public license": "agpl", "mozilla public license": "mpl", "eclipse public license": "epl", "zlib license": "zlib", "boost software license": "boost", "artistic license": "artistic", "academic free license": "afl", "open software license": "osl",
    "microsoft public license": "ms-pl", "sil open font license": "ofl", "european union public licence": "eupl", "open database license": "odbl", "python software foundation license": "python",
}
#: Identifiers after "SPDX-License-Identifier:", and their labels (fixed values).
SPDX = {
    "MIT": "mit", "MIT-0": "mit", "X11": "x11", "ISC": "isc", "0BSD": "bsd", "BSD-2-Clause": "bsd", "BSD-3-Clause": "bsd", "BSD-4-Clause": "bsd", "Apache-1.1": "apache", "Apache-2.0": "apache", "GPL-1.0": "gpl", "GPL-2.0": "gpl", "GPL-3.0": "gpl", "LGPL-2.0": "lgpl", "LGPL-2.1": "lgpl", "LGPL-3.0": "lgpl",
    "AGPL-3.0": "agpl", "GFDL-1.3": "gfdl", "MPL-1.1": "mpl", "MPL-2.0": "mpl", "EPL-1.0": "epl", "EPL-2.0": "epl", "CDDL-1.0": "cddl", "EUPL-1.2": "eupl", "Artistic-2.0": "artistic", "Unlicense": "unlicense", "BSL-1.0": "boost", "Zlib": "zlib", "WTFPL": "wtfpl", "CC0-1.0": "cc0", "OFL-1.1": "ofl", "MS-PL": "ms-pl", "PostgreSQL": "postgresql",
    "PSF-2.0": "python", "OpenSSL": "openssl", "ODbL-1.0": "odbl", "AFL-3.0": "afl", "OSL-3.0": "osl", "NCSA": "ncsa", "Ruby": "ruby", "PHP-3.01": "php", "curl": "curl",
}
#: Creative Commons: the letters, the words and the label of each kind (fixed values).
CREATIVE = [
    ("by", "attribution", "cc-by"), ("by sa", "attribution sharealike", "cc-by-sa"), ("by nc", "attribution noncommercial", "cc-by-nc"), ("by nd", "attribution noderivatives", "cc-by-nd"),
    ("by nc sa", "attribution noncommercial sharealike", "cc-by-nc-sa"), ("by nc nd", "attribution noncommercial noderivatives", "cc-by-nc-nd"),
]


@dataclass(frozen=True)
class Template:
    label: str
    key: tuple[str, ...]
    words: tuple[str, ...]
    base: bool

    @property
    def key_at(self) -> int:
        n = len(self.key)
        return next(i for i in range(len(self.words) - n + 1) if self.words[i : i + n] == self.key)


def library() -> list[Template]:
    """The base phrases, the notices, and what the names and identifiers give by rule."""
    rows = [(label, k, t) for label, k, t in NOTICES]
    for name, label in NAMED.items():
        rows += [(label, f"under the {name}", f"{verb} under the {name}") for verb in ("licensed", "released", "distributed")]
    for name, label in SPDX.items():
        words = "".join(c if c.isalnum() else " " for c in name.lower())
        rows.append((label, f"identifier {words}", f"spdx license identifier {words}"))
    for letters, words, label in CREATIVE:
        if letters != "by":
            rows.append((label, f"cc {letters}", f"licensed under cc {letters}"))
        rows.append((label, f"creative commons {words}", f"licensed under a creative commons {words}"))
        rows += [(label, f"org licenses {letters} {v}", f"http creativecommons org licenses {letters} {v}") for v in ("1 0", "2 0", "2 5", "3 0", "4 0")]
    base = [Template(label, tuple(p.split()), tuple(p.split()), True) for p, label in BASE.items()]
    return base + [Template(label, tuple(k.split()), tuple(t.split()), False) for label, k, t in rows]


def needed(n_postings: int, base: bool) -> int:
    """How many postings of a template must agree on a start."""
    return n_postings if base else max(1, -(-2 * n_postings // 5))


def words_of(text: Column) -> Column:
    return pieces(ascii_lower(F.coalesce(text, F.lit(""))), APART)


def _codes(docs: DataFrame, vocab: list[str]) -> dict[str, int]:
    """A number for each word of the library, as Spark hashes it; an error if two words share one."""
    found = {r["w"]: r["h"] for r in docs.sparkSession.createDataFrame([(w,) for w in vocab], "w string").select("w", F.hash("w").alias("h")).collect()}
    if len(set(found.values())) < len(found) or 0 in found.values():
        raise ValueError("two words of the library have one code")
    return found


def _literal(value: object, kind: str) -> Column:
    return F.from_json(F.lit(json.dumps(value)), kind)


def rare_words(coded: DataFrame, codes: dict[str, int], templates: list[Template]) -> list[list[tuple[str, int]]]:
    """For each template its postings (word, position): its words of the highest IDF over all files, wherever they stand in it.

    What is collected is a row for each word of the library.
    """
    held = F.filter(F.array_distinct("codes"), lambda c: c != 0)
    files = {r["c"]: r["n"] for r in coded.select(F.explode(held).alias("c")).groupBy("c").agg(F.count("*").alias("n")).collect()}
    out = []
    for t in templates:
        # the highest IDF is the least number of files; a word of no file finds nothing, and a key phrase with one nowhere stands
        known = {w for w in t.words if codes[w] in files} if all(codes[w] in files for w in t.key) else set()
        rare = set(sorted(known, key=lambda w: (files[codes[w]], w))[: BASE_RARE if t.base else RARE])
        out.append([(w, i) for i, w in enumerate(t.words) if w in rare])
    return out


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: list[Template] | None = None) -> DataFrame:
    """docs' rows as (id_col, n_words, matches); a match has start (word from 0), label, base, n_words and score.

    start is that of the key phrase, n_words its length.
    """
    templates = templates or library()
    codes = _codes(docs, sorted({w for t in templates for w in t.words}))
    known = F.transform(words_of(field(text_col)), lambda w: F.when(w.isin(list(codes)), F.hash(w)).otherwise(0))
    coded = settle(as_rows(docs).select(field(id_col).alias("id"), known.alias("codes")), "license-words")
    postings = rare_words(coded, codes, templates)

    index: dict[int, list[dict]] = {}
    for t, posted in enumerate(postings):
        for w, at in posted:
            index.setdefault(codes[w], []).append({"t": t, "at": at})
    posts = F.map_from_entries(_literal([{"c": c, "p": p} for c, p in index.items()], "array<struct<c:int,p:array<struct<t:int,at:int>>>>"))
    need = _literal([needed(len(p), t.base) for t, p in zip(templates, postings)], "array<int>")
    facts = _literal([{"key": [codes[w] for w in t.key], "key_at": t.key_at, "words": [codes[w] for w in t.words], "label": t.label, "base": t.base} for t in templates], "array<struct<key:array<int>,key_at:int,words:array<int>,label:string,base:boolean>>")

    places = F.array_compact(F.transform("codes", lambda c, i: F.when(c.isin(list(index)), F.struct(c.alias("c"), i.alias("i")))))
    # a vote is the template and the start in one number, so that equal votes stand together once sorted
    none = F.array().cast("array<bigint>")
    votes = F.flatten(F.transform(places, lambda x: F.transform(F.element_at(posts, x["c"]), lambda p: p["t"].cast("long") * (1 << 40) + (x["i"] - p["at"] + BEFORE))))
    rows = coded.select("id", "codes", F.when(F.size(places) > 0, F.sort_array(votes)).otherwise(none).alias("votes"))

    def agreed(v: Column, i: Column) -> Column:
        t = F.shiftright(v, 40).cast("int")
        first = (i == 0) | (F.get("votes", i - 1) != v)
        return F.when(first & F.coalesce(F.get("votes", i + F.get(need, t) - 1) == v, F.lit(False)), F.struct(t.alias("t"), (v.bitwiseAND((1 << 40) - 1) - BEFORE).cast("int").alias("start")))

    def here(start: Column, words: Column) -> Column:
        """How many of the words stand in their place from start on."""
        return F.aggregate(F.zip_with(F.sequence(F.lit(0), F.size(words) - 1), words, lambda k, w: F.when(F.coalesce(F.get("codes", F.when(start + k >= 0, start + k).otherwise(F.lit(-1))) == w, F.lit(False)), 1).otherwise(0)), F.lit(0), lambda s, x: s + x)

    def verified(x: Column) -> Column:
        return here(x["start"] + F.get(facts, x["t"])["key_at"], F.get(facts, x["t"])["key"]) == F.size(F.get(facts, x["t"])["key"])

    def match(x: Column) -> Column:
        f = F.get(facts, x["t"])
        score = here(x["start"], f["words"]) / F.size(f["words"]).cast("double")
        return F.struct((x["start"] + f["key_at"]).cast("long").alias("start"), f["label"].alias("label"), f["base"].alias("base"), F.size(f["key"]).alias("n_words"), score.alias("score"))

    starts = F.array_compact(F.transform("votes", agreed))
    return rows.select(F.col("id").alias(id_col), F.size("codes").cast("long").alias("n_words"), F.transform(F.filter(starts, verified), match).alias("matches"))


def summary(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, n_words, n_base, first_word, last_word, base_labels, labels, score) for each row of docs."""
    m = F.col("matches")
    base = F.filter(m, lambda x: x["base"])

    def joined(x: Column) -> Column:
        return F.array_join(F.array_sort(F.array_distinct(F.transform(x, lambda y: y["label"]))), ",")

    return scan(docs, id_col, text_col).select(
        id_col,
        "n_words",
        F.size(base).cast("long").alias("n_base"),
        F.array_min(F.transform(base, lambda x: x["start"])).alias("first_word"),
        F.array_max(F.transform(base, lambda x: x["start"])).alias("last_word"),
        joined(base).alias("base_labels"),
        joined(m).alias("labels"),
        F.round(F.coalesce(F.array_max(F.transform(m, lambda x: x["score"])), F.lit(0.0)), 6).alias("score"),
    )
