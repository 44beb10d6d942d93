import random
import re

from tidewatch.llm import licenses

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lowered(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def brute(text):
    words = WORD.findall(lowered(text))
    places, base, labels, score = [], set(), set(), 0.0
    for phrase, label in licenses.PHRASES:
        p = phrase.split()
        at = [i for i in range(len(words)) if words[i:i + len(p)] == p]
        places += at
        if at:
            base.add(label)
            labels.add(label)
            score = 1.0
    for notice, label, must, mustnt in licenses.NOTICES:
        p = set(notice.split())
        width = next(w for w in licenses.WIDTHS if w >= len(notice.split()))
        for start in range(0, len(words), width):
            block = set(words[start:start + 2 * width])
            share = len(p & block) / len(p)
            if share >= licenses.THRESHOLD - 1e-9 and block >= set(must.split()) and not block & set(mustnt.split()):
                labels.add(label)
                score = max(score, share)
    return (len(words), len(places), min(places, default=None), max(places, default=None),
            ",".join(sorted(base)), ",".join(sorted(labels)), round(score, 9))


def test_matches_brute_force(spark):
    rng = random.Random(4)
    texts = [None, "", "CC BY", "cc-by cc by", "All rights\nreserved. all RIGHTS", "é cc by é", "cc by " * 5000, "x " * 9 + "general public license",
             "Licensed under the Apache License, Version 2.0.", "Released under the MIT License."]
    pool = [w for t, *_ in licenses.PHRASES + licenses.NOTICES for w in t.split()] + ["zz", "yy", "xx"]
    for _ in range(250):
        words = [rng.choice(["zz", "yy"]) for _ in range(rng.randrange(40))]
        for _ in range(rng.randrange(3)):
            notice = rng.choice(licenses.PHRASES + licenses.NOTICES)[0].split()
            for _ in range(rng.randrange(4)):
                notice[rng.randrange(len(notice))] = rng.choice(pool)
            at = rng.randrange(len(words) + 1)
            words[at:at] = notice
        texts.append(rng.choice([" ", ", "]).join(words))
    rows = [(k, t) for k, t in enumerate(texts)] + [(3, texts[3]), (None, "cc by")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS row", "2 AS label", "'x' AS words").repartition(4)
    got = sorted((r.doc_id, *r[1:7], round(r.score, 9)) for r in licenses.scan_licenses(df).collect() if r.doc_id is not None)
    assert got == sorted((k, *brute(t)) for k, t in rows if k is not None)
    assert licenses.scan_licenses(df.limit(0)).collect() == []


HEADERS = [
    ("Released under the MIT License.", "mit"), ("This project is licensed under the MIT license", "mit"),
    ("Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files", "mit"),
    (licenses.NOTICES[2][0], "mit"), ("released under the Apache license", ""), ("Released under the ISC license", ""),
    ("Licensed under the Apache License, Version 2.0 (the \"License\");", "apache-2.0"), ("Licensed under the Apache License, Version 1.1", ""),
    ("licensed under the License, version 2.0", ""), ("GNU license version 2.0", ""),
    ("This work is licensed under the GNU General Public License, version 3.", "gpl"),
    ("This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by "
     "the Free Software Foundation, either version 3 of the License, or (at your option) any later version.", "gpl"),
    ("This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published "
     "by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.", "agpl,gpl"),
    ("This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published "
     "by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.", "gpl,lgpl"),
    ("Licensed under the GNU Lesser General Public License, version 3", "gpl,lgpl"), ("Licensed under the GNU Affero General Public License version 3", "agpl,gpl"),
    ("Redistribution and use in source and binary forms, with or without modification, are permitted provided that", "bsd"),
    ("Redistribution of this book in source form is not permitted", ""), ("Licensed under the BSD 3-Clause License", "bsd"),
    ("Subject to the terms of the Mozilla Public License, v. 2.0.", "mpl-2.0"), ("Licensed under the Eclipse Public License v. 2.0", "epl-2.0"),
    ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above "
     "copyright notice and this permission notice appear in all copies.", "isc"),
    ("This is free and unencumbered software released into the public domain.", "unlicense"), ("This is free software released to the public", ""),
    ("To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.", "cc0"),
    ("Licensed under CC BY 4.0", "cc-by"), ("Licensed under CC BY-NC 4.0", "cc-by,cc-by-nc"), ("Licensed under CC BY-SA 4.0", "cc-by,cc-by-sa"),
    ("Licensed under CC BY-NC-ND 4.0", "cc-by,cc-by-nc-nd"), ("Licensed under a Creative Commons Attribution 4.0 International License", "cc-by"),
    ("Licensed under a Creative Commons Attribution-NonCommercial 4.0 International License", "cc-by-nc"),
    ("Licensed under a Creative Commons Attribution-ShareAlike 4.0 International License", "cc-by-sa"),
    ("Licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License", "cc-by-nc-nd"),
    ("No part of this publication may be reproduced without the prior written permission of the publisher", "reserved"),
    ("No part of this town may be entered without the permission of the mayor", ""), ("All rights reserved", "reserved"),
]


def test_real_headers(spark):
    """Labels of known headers; labels that follow from a contract phrase ("cc by", "general public license") stay."""
    df = spark.createDataFrame([(k, t) for k, (t, _) in enumerate(HEADERS)], "doc_id long, text string")
    got = {r.doc_id: r.labels for r in licenses.scan_licenses(df).collect()}
    assert {HEADERS[k][0]: v for k, v in got.items()} == {t: want for t, want in HEADERS}
