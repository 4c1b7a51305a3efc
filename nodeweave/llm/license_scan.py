"""License scans by diagonal voting, in DataFrame functions alone.

Hashes of all rolling word k-grams of the texts are joined to the k-grams of templates. Each hit votes for a diagonal,
the text position less the template position. Hits of one passage share a diagonal, but for words put in or left out, so
diagonals no further apart than GAP are merged into spans; what counts in a span are hits verified on the words themselves.

Phrases are templates matched whole (k = 2, every k-gram on one diagonal). Notices are longer templates (k = 5) of which
a part of at least COVER must be found. The texts are read once: positions whose k-gram no template has are left out
while a text is still one array, and the few others are written, with their words, to a table that the rest works on. Of
templates there may be MOST_GRAMS k-grams, so their table can be broadcast.

Null text is empty text: no words. A text's hits are its own row only, also of repeated rows and rows without an id. A
text of any length is one row; its spans come in no order, and equal ones once. An empty table gives no rows. Other columns,
of whatever name, are not read.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from nodeweave.llm.common import prepare, stored, table

PHRASE_K, NOTICE_K, GAP, COVER = 2, 5, 3, 0.5
#: K-grams of all templates, each a row of some hundred bytes.
MOST_GRAMS = 50_000
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

PHRASES = {"mit": "mit license", "apache": "apache license", "gpl": "general public license"}
#: Names of other licenses, matched whole as well.
NAMES = {
    "lgpl": "lesser general public license", "agpl": "affero general public license", "mpl": "mozilla public license", "epl": "eclipse public license", "bsd": "bsd license", "isc": "isc license", "zlib": "zlib license",
    "boost": "boost software license", "artistic": "artistic license", "unlicense": "the unlicense", "cc0": "creative commons zero", "cc-by": "cc by", "cc-by-sa": "cc by sa", "cc-by-nc": "cc by nc", "cc-by-nd": "cc by nd",
    "cc": "creative commons attribution", "public-domain": "public domain dedication",
}
#: Texts and notices of public licenses, by label.
NOTICES = {
    "mit-text": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "as-is": "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "apache-notice": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0. Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    "gpl-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    "lgpl-notice": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    "agpl-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "mpl-notice": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "bsd-text": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "isc-text": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "zlib-text": "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: The origin of this software must not be misrepresented; you must not claim that you wrote the original software.",
    "unlicense-text": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    "cc-notice": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "cc-by-sa-notice": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "cc-by-nc-notice": "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
}


def lowered(text: Column) -> Column:
    """Lower case that makes an ASCII letter of no other character: the Kelvin sign would become a k."""
    return F.lower(F.replace(text, F.lit("K"), F.lit("é")))


def words_of(text: Column) -> Column:
    return F.filter(F.split(lowered(text), SEPARATORS), lambda w: w != "")


def template_words(text: str) -> list[str]:
    return [w for w in re.split(SEPARATORS, text.lower()) if w]


def gram(hashes: Column | str, i: Column, k: int) -> Column:
    """Hash of the k-gram at i, from the hashes of the words."""
    return F.xxhash64(F.lit(k), *(F.get(hashes, i + j) for j in range(k)))


def templates(spark: SparkSession, phrases: dict[str, str], names: dict[str, str], notices: dict[str, str]) -> DataFrame:
    """(template, label, base, k, length, t, own, gram): one row per k-gram of a template, with its words."""
    rows = [(label, True, PHRASE_K, template_words(x)) for label, x in phrases.items()] + [(label, False, PHRASE_K, template_words(x)) for label, x in names.items()] + [(label, False, NOTICE_K, template_words(x)) for label, x in notices.items()]
    for label, _, k, words in rows:
        if len(words) < k:
            raise ValueError(f"template {label} has fewer than {k} words")
    if sum(len(words) for *_, words in rows) > MOST_GRAMS:
        raise ValueError(f"templates have more than {MOST_GRAMS} words")
    one = [F.struct(F.lit(i).alias("template"), F.lit(label).alias("label"), F.lit(base).alias("base"), F.lit(k).alias("k"), F.array(*map(F.lit, words)).alias("words")) for i, (label, base, k, words) in enumerate(rows)]
    if not one:
        raise ValueError("there are no templates")
    known = spark.range(1).select(F.inline(F.array(*one))).withColumn("h", F.transform("words", lambda w: F.xxhash64(w)))
    known = known.withColumn("t", F.explode(F.sequence(F.lit(0), F.size("words") - F.col("k"))))
    hashed = F.when(F.col("k") == PHRASE_K, gram("h", F.col("t"), PHRASE_K)).otherwise(gram("h", F.col("t"), NOTICE_K))
    own = F.slice("words", F.col("t") + 1, F.col("k")).alias("own")
    return known.select("template", "label", "base", "k", F.size("words").alias("length"), "t", own, hashed.alias("gram"), F.get("h", "t").alias("first"))


def hits(docs: DataFrame, known: DataFrame) -> DataFrame:
    """(row, doc_id, n_words, at) of every row, written: at holds (pos, own), the words from a position on whose k-gram a
    template may have."""
    every = known.select("k", "gram", "first").collect()  # at most MOST_GRAMS
    among = lambda k: sorted({r["gram"] for r in every if r["k"] == k})
    firsts = sorted({r["first"] for r in every})
    read = docs.select("doc_id", words_of(F.col("body")).alias("words")).withColumn("h", F.transform("words", lambda w: F.xxhash64(w)))
    # The sets are literals, so this is one look-up for most words; the rest of the row is never copied.
    here = lambda i: F.get("h", i).isin(firsts) & (gram("h", i, PHRASE_K).isin(among(PHRASE_K)) | gram("h", i, NOTICE_K).isin(among(NOTICE_K)))
    places = F.when(F.size("h") >= PHRASE_K, F.filter(F.sequence(F.lit(0), F.size("h") - PHRASE_K), here)).otherwise(F.array().cast("array<int>"))
    at = F.transform(places, lambda i: F.struct(i.alias("pos"), F.slice("words", i + 1, NOTICE_K).alias("own")))
    return stored(read.select(F.monotonically_increasing_id().alias("row"), "doc_id", F.size("words").cast("bigint").alias("n_words"), at.alias("at")), "license-hits")


def spans(found: DataFrame, known: DataFrame) -> DataFrame:
    """(row, label, base, start, end, score) of the spans, in words of the text."""
    both = lambda x, k: F.struct(F.lit(k).alias("k"), gram(F.transform(x, lambda w: F.xxhash64(w)), F.lit(0), k).alias("gram"))
    rolled = found.select("row", F.inline("at")).select("row", "pos", F.col("own").alias("words"), F.inline(F.array(both(F.col("own"), PHRASE_K), both(F.col("own"), NOTICE_K))))
    met = rolled.join(F.broadcast(known), ["k", "gram"]).filter(F.slice("words", F.lit(1), F.col("k")) == F.col("own"))
    key = ["row", "template", "label", "base", "k", "length"]
    votes = met.select(*key, "pos", "t", (F.col("pos") - F.col("t")).alias("diagonal"))
    whole = votes.filter(F.col("k") == PHRASE_K).groupBy(*key, "diagonal").agg(F.count(F.lit(1)).alias("votes")).filter(F.col("votes") == F.col("length") - PHRASE_K + 1)
    whole = whole.select("row", "label", "base", F.col("diagonal").alias("start"), (F.col("diagonal") + F.col("length")).alias("end"), F.lit(1.0).alias("score"))
    covered = F.collect_set(F.sequence("t", F.col("t") + NOTICE_K - 1)).alias("covered")  # as many as the template has k-grams at most
    lines = votes.filter(F.col("k") == NOTICE_K).groupBy(*key, "diagonal").agg(covered, F.min("pos").alias("low"), F.max("pos").alias("high"))
    along = Window.partitionBy(*key).orderBy("diagonal")
    fresh = (F.col("diagonal") - F.lag("diagonal", 1, -(10**9)).over(along) > GAP).cast("int")
    run = lines.withColumn("fresh", fresh).withColumn("run", F.sum("fresh").over(along.rowsBetween(Window.unboundedPreceding, 0)))
    merged = run.groupBy(*key, "run").agg(F.flatten(F.collect_list("covered")).alias("covered"), F.min("low").alias("start"), (F.max("high") + NOTICE_K).alias("end"))
    merged = merged.withColumn("score", F.size(F.array_distinct(F.flatten("covered"))) / F.col("length")).filter(F.col("score") >= COVER)
    return whole.union(merged.select("row", "label", "base", "start", "end", "score"))


def scan(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", phrases: dict[str, str] | None = None, names: dict[str, str] | None = None, notices: dict[str, str] | None = None) -> DataFrame:
    """Per row: doc_id, n_words, and `found`, an array of (label, base, start, end, score) in words of the text.

    base: whether the label is one of `phrases`. A phrase's or name's score is 1, a notice's the share of its words that
    verified k-grams of the span cover.
    """
    spark = docs.sparkSession
    prepare(spark)
    known = templates(spark, PHRASES if phrases is None else phrases, NAMES if names is None else names, NOTICES if notices is None else notices)
    read = hits(docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("body")), known)
    none = F.array().cast("array<struct<label:string,base:boolean,start:int,end:int,score:double>>")
    likely = read.filter(F.size("at") > 0)
    got = spans(likely, known.drop("first")).groupBy("row").agg(F.collect_list(F.struct("label", "base", "start", "end", "score")).alias("found"))
    with_hits = likely.select("row", "doc_id", "n_words").join(got, "row", "left").select("doc_id", "n_words", F.coalesce("found", none).alias("found"))
    return read.filter(F.size("at") == 0).select("doc_id", "n_words", none.alias("found")).union(with_hits)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(table(spark, sf_dir, "documents"))
    base = F.filter("found", lambda s: s["base"])
    starts = F.transform(base, lambda s: s["start"].cast("bigint"))
    labels = lambda x: F.concat_ws(",", F.array_sort(F.array_distinct(F.transform(x, lambda s: s["label"]))))
    return found.select(
        "doc_id", "n_words", F.size(base).cast("bigint").alias("n_base"), F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"),
        labels(base).alias("base_labels"), labels(F.col("found")).alias("labels"), F.coalesce(F.array_max(F.transform("found", lambda s: s["score"])), F.lit(0.0)).alias("score"),
    )
