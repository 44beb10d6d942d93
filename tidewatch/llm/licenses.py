"""License scan: an exact set-similarity join of text blocks with license templates.

A block is a window of words, twice as long as the templates of its width class and starting at every multiple of the
width, so every run of that many words lies whole in one block. Template words are ordered by their count in the whole
corpus. A block meets a template when it holds at least `threshold` of the template's distinct words. Blocks without a
word of a template's prefix (its rarest words) cannot meet it and are never made; of the others, the join keeps those
whose own prefix shares a token and whose length and positions still allow the overlap, and then counts it exactly. Of
licenses with much the same words, the words that tell them apart must be there, or must not.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.llm.store import literal_table
from tidewatch.llm.text import LETTER_WORDS, map_batches, values, word_columns, words_of

#: The phrases whose consecutive places are counted, with their labels.
PHRASES = [("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved")]
#: License texts and notices: the words, what they are called here, words of which a block must hold all, and words of
#: which it may hold none, since they name another license. The words of the public texts.
NOTICES = [
    ("released under the mit license", "mit", "mit", ""),
    ("permission is hereby granted free of charge to any person obtaining a copy of this software", "mit", "permission software granted", "font organization"),
    ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files "
     "the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish "
     "distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject "
     "to the following conditions the above copyright notice and this permission notice shall be included in all copies or substantial "
     "portions of the software the software is provided as is without warranty of any kind express or implied including but not limited "
     "to the warranties of merchantability fitness for a particular purpose and noninfringement in no event shall the authors or copyright "
     "holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of "
     "or in connection with the software or the use or other dealings in the software", "mit", "sublicense noninfringement", ""),
    ("licensed under the apache license version 2 0", "apache-2.0", "apache 2 0", ""),
    ("licensed under the apache license version 2 0 you may not use this file except in compliance with the license you may obtain a copy "
     "of the license at unless required by applicable law or agreed to in writing software distributed under the license is distributed "
     "on an as is basis without warranties or conditions of any kind either express or implied see the license for the specific language "
     "governing permissions and limitations under the license", "apache-2.0", "apache 2 0 compliance", ""),
    ("this work is licensed under the gnu general public license version 3", "gpl", "gnu general public", "lesser library affero"),
    ("this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published "
     "by the free software foundation either version 3 of the license or at your option any later version", "gpl", "gnu general public", "lesser library affero"),
    ("licensed under the gnu lesser general public license version 3", "lgpl", "gnu lesser general public", ""),
    ("this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as "
     "published by the free software foundation either version 2 1 of the license or at your option any later version", "lgpl", "lesser general public", ""),
    ("licensed under the gnu affero general public license version 3", "agpl", "affero general public", ""),
    ("redistribution and use in source and binary forms with or without modification are permitted", "bsd", "redistribution binary permitted", ""),
    ("redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions "
     "are met redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer "
     "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the "
     "documentation and or other materials provided with the distribution", "bsd", "redistributions disclaimer binary", ""),
    ("licensed under the bsd 3 clause license", "bsd", "bsd", ""),
    ("subject to the terms of the mozilla public license v 2 0", "mpl-2.0", "mozilla 2 0", ""),
    ("this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this "
     "file you can obtain one at", "mpl-2.0", "mozilla 2 0", ""),
    ("permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that "
     "the above copyright notice and this permission notice appear in all copies", "isc", "fee granted appear", ""),
    ("licensed under the eclipse public license version 2 0", "epl-2.0", "eclipse 2 0", ""),
    ("this is free and unencumbered software released into the public domain", "unlicense", "unencumbered domain", ""),
    ("to the extent possible under law the author has waived all copyright and related or neighboring rights to this work", "cc0", "waived neighboring", ""),
    ("licensed under cc by nc 4 0", "cc-by-nc", "cc by nc", "sa nd"),
    ("licensed under cc by sa 4 0", "cc-by-sa", "cc by sa", "nc nd"),
    ("licensed under cc by nd 4 0", "cc-by-nd", "cc by nd", "nc sa"),
    ("licensed under cc by nc sa 4 0", "cc-by-nc-sa", "cc by nc sa", ""),
    ("licensed under cc by nc nd 4 0", "cc-by-nc-nd", "cc by nc nd", ""),
    ("licensed under a creative commons attribution 4 0 international license", "cc-by", "creative commons attribution",
     "noncommercial sharealike noderivatives noderivs commercial share derivatives"),
    ("licensed under a creative commons attribution noncommercial 4 0 international license", "cc-by-nc",
     "creative commons attribution noncommercial", "sharealike noderivatives noderivs share derivatives"),
    ("licensed under a creative commons attribution sharealike 4 0 international license", "cc-by-sa",
     "creative commons attribution sharealike", "noncommercial noderivatives noderivs commercial derivatives"),
    ("licensed under a creative commons attribution noderivatives 4 0 international license", "cc-by-nd",
     "creative commons attribution noderivatives", "noncommercial sharealike commercial share"),
    ("licensed under a creative commons attribution noncommercial sharealike 4 0 international license", "cc-by-nc-sa",
     "creative commons attribution noncommercial sharealike", ""),
    ("licensed under a creative commons attribution noncommercial noderivatives 4 0 international license", "cc-by-nc-nd",
     "creative commons attribution noncommercial noderivatives", ""),
    ("no part of this publication may be reproduced without the prior written permission of the publisher", "reserved", "reproduced permission", ""),
]
THRESHOLD = 0.8
WIDTHS = (8, 16, 32, 64, 128, 256)


def _templates(phrases: list, notices: list, threshold: float) -> list[dict]:
    """A dict for each phrase, which must stand whole, and each notice; notices without more words take any block."""
    out = []
    for text, label, must, mustnt in [*[(*p, "", "") for p in phrases], *[(*n, "", "")[:4] for n in notices]]:
        base, words = len(out) < len(phrases), text.split()
        size = len(set(words))
        out.append({"template": len(out), "label": label, "base": base, "words": words, "size": size,
                    "must": must.split(), "mustnt": mustnt.split(),
                    "need": size if base else max(1, int(np.ceil(threshold * size - 1e-9))),
                    "width": next(w for w in WIDTHS if w >= len(words))})
    return out


def _vocabulary(templates: list[dict]) -> tuple[list[str], np.ndarray]:
    """The words of all templates, and their ids in ascending order, by which they are found."""
    words = sorted({w for t in templates for w in (*t["words"], *t["must"], *t["mustnt"])}, key=lambda w: int(words_of(w, LETTER_WORDS)[0]))
    return words, np.array([words_of(w, LETTER_WORDS)[0] for w in words], np.uint64)


def _known(ids: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Place of every word in the vocabulary, or -1."""
    at = np.minimum(np.searchsorted(known, ids), len(known) - 1)
    return np.where(known[at] == ids, at, -1)


def _counts(docs: DataFrame, known: np.ndarray) -> np.ndarray:
    """How often every template word stands in the whole corpus."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        total = np.zeros(len(known) + 1, np.int64)
        for batch in batches:
            for _, ids, _ in word_columns(batch.column(0), LETTER_WORDS):
                total += np.bincount(_known(ids, known) + 1, minlength=len(total))
        yield {"word": np.arange(len(known)), "count": total[1:]}

    rows = map_batches(docs.select("text"), count, "word int, count long").groupBy("word").agg(F.sum("count").alias("count"))
    out = np.zeros(len(known), np.int64)
    for row in rows.collect():                          # one row for each template word
        out[row.word] = row["count"]
    return out


def scan_licenses(docs: DataFrame, phrases: list = PHRASES, notices: list = NOTICES, threshold: float = THRESHOLD) -> DataFrame:
    """One row for every row of `docs` (doc_id, text): n_words, n_base, first_word, last_word, base_labels, labels, score.

    Words are runs of ASCII digits, letters (A-Z lowered) and all signs beyond ASCII. A base phrase counts at every
    place where its words stand consecutively; first_word and last_word are the least and greatest such place, null if
    there is none. labels are those of base phrases and of notices that some block meets: it holds `threshold` of the
    notice's distinct words, all the words that name the license and none that name another; score is the greatest share of
    a template's words found in a meeting block, 0 without. A null or empty text has no words. Repeated rows and null
    ids keep their rows, other columns are ignored, an empty table gives an empty one. Texts are read whole, in slices.
    """
    spark = docs.sparkSession
    templates = _templates(phrases, notices, threshold)
    words, known = _vocabulary(templates)
    counts = _counts(docs, known)
    order = sorted(range(len(words)), key=lambda k: (counts[k], words[k]))
    rank = np.empty(len(words) + 1, np.int64)
    rank[order] = np.arange(len(words))
    rank[-1] = -1                                       # no template word
    ranks = {w: int(rank[k]) for k, w in enumerate(words)}
    widths = sorted({t["width"] for t in templates})
    rare = {w: np.zeros(len(words) + 1, bool) for w in widths}
    rows = []
    for t in templates:
        tokens = sorted({ranks[w] for w in t["words"]})
        for place, token in enumerate(tokens[:t["size"] - t["need"] + 1]):
            rare[t["width"]][token] = True
            rows.append({"template": t["template"], "label": t["label"], "base": t["base"], "t_width": t["width"], "t_size": t["size"],
                         "need": t["need"], "t_token": token, "t_place": place, "t_tokens": tokens,
                         "phrase": [ranks[w] for w in t["words"]] if t["base"] else None,
                         "must": [ranks[w] for w in t["must"]], "mustnt": [ranks[w] for w in t["mustnt"]]})

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            count, found = [], []
            for _, ids, bounds in word_columns(batch.column(2), LETTER_WORDS):
                order_of = rank[_known(ids, known)]
                count.extend(np.diff(bounds).tolist())
                made: list[list] = [[] for _ in range(len(bounds) - 1)]
                for width in widths:
                    hits = np.flatnonzero(rare[width][order_of])
                    doc = np.searchsorted(bounds, hits, "right") - 1
                    own = (hits - bounds[doc]) // width
                    for d, b in np.unique(np.concatenate([np.stack([doc, own], 1), np.stack([doc, own - 1], 1)]), axis=0).tolist():
                        if b >= 0:
                            start = bounds[d] + b * width
                            made[d].append({"width": width, "start": b * width, "ranks": order_of[start:min(bounds[d + 1], start + 2 * width)]})
                found.extend(made)
            yield {"row": batch.column(0), "doc_id": batch.column(1), "n_words": count, "blocks": found}

    scanned = map_batches(docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long"), "text"), blocks,
                          "row long, doc_id long, n_words long, blocks array<struct<width:int,start:int,ranks:array<int>>>")
    wanted = literal_table(spark, rows, "template int; label string; base boolean; t_width int; t_size int; need int; "
                                        "t_token int; t_place int; t_tokens array<int>; phrase array<int>; must array<int>; mustnt array<int>")
    block = scanned.select("row", "doc_id", "n_words", F.explode_outer("blocks").alias("b")).select(
        "row", "doc_id", "n_words", "b.*", F.array_sort(F.array_distinct(F.filter("b.ranks", lambda r: r >= 0))).alias("tokens"))
    token = block.select("*", F.posexplode_outer("tokens").alias("place", "token"))
    # prefix, length and position filters; a pair is taken at its first common token, so once
    met = token.join(wanted, (F.col("token") == F.col("t_token")) & (F.col("width") == F.col("t_width"))
                     & (F.size("tokens") >= F.col("need"))
                     & (F.least(F.size("tokens") - F.col("place"), F.col("t_size") - F.col("t_place")) >= F.col("need")), "left")
    both = F.array_intersect("tokens", "t_tokens")
    named_here = (F.size(F.array_except("must", "tokens")) == 0) & ~F.arrays_overlap("mustnt", "tokens")
    met = met.withColumn("both", both).withColumn("share", F.when(
        (F.col("both")[0] == F.col("token")) & (F.size("both") >= F.col("need")) & named_here, F.size("both") / F.col("t_size")))
    places = F.expr("transform(filter(sequence(0, width - 1), i -> slice(ranks, i + 1, size(phrase)) = phrase), i -> start + i)")
    met = met.withColumn("places", F.when(F.col("base") & F.col("share").isNotNull(), places)).withColumn(
        "holds", F.when(F.col("base"), F.size("places") > 0).otherwise(F.col("share").isNotNull()))
    named = F.when(F.col("holds"), F.col("label"))
    out = met.groupBy("row", "doc_id", "n_words").agg(
        F.coalesce(F.sum(F.when(F.col("base") & F.col("holds"), F.size("places"))), F.lit(0)).cast("long").alias("n_base"),
        F.min(F.array_min("places")).cast("long").alias("first_word"), F.max(F.array_max("places")).cast("long").alias("last_word"),
        F.array_join(F.array_sort(F.collect_set(F.when(F.col("base"), named))), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.collect_set(named)), ",").alias("labels"),
        F.coalesce(F.max(F.when(F.col("holds"), F.col("share"))), F.lit(0.0)).alias("score"))
    return out.drop("row")
