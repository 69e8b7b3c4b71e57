import re

from pyspark.sql import functions as F

from upshot.llm import license_scan as S

from .conftest import prose, tricky_rows

TEXTS = [None, "", "CC BY", "cc by cc by", "all rights Reserved. ALL RIGHTS RESERVED", "General Public License general public",
         "x " * 40 + "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files" + " y" * 30,
         "free of charge to any person obtaining a copy of this software", "Licensed under CC BY-NC 4.0.", "license version apache the under 2.0 licensed",
         prose(1, 200) + " Released under the MIT License. " + prose(2, 200), "Éall rights reserved", "allé rights reserved", "cc by \u212aelvin", "\u212a \u0130n all rights reserved"]


def brute(text):
    w = re.findall(S.WORD, (text or "").translate(str.maketrans(S.UPPER, S.LOWER)))
    starts = {label: [i for i in range(len(w)) if w[i:i + len(p.split())] == p.split()] for p, label in S.PHRASES}
    every = sum(starts.values(), [])
    labels, best = {k for k, v in starts.items() if v}, 0.0
    base = ",".join(sorted(labels))
    for s in range(0, len(w), S.STRIDE):
        here = w[s:s + S.BLOCK]
        met = []
        for t in S.TEMPLATES:
            n = len(set(t.words) & set(here))
            inside = t.phrase is None or any(here[i:i + len(t.phrase.split())] == t.phrase.split() for i in range(len(here)))
            if n >= t.need and set(t.must) <= set(here) and inside:
                met.append((t, n))
        for t, n in met:
            if n == max(m for u, m in met if u.family == t.family):
                labels.add(t.label)
                best = max(best, n / len(t.words))
    return len(w), len(every), min(every, default=None), max(every, default=None), base, ",".join(sorted(labels)), best


COLS = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]


def test_against_brute_force(spark):
    rows = S.scan(spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")).collect()
    got = {r["doc_id"]: tuple(r[c] for c in COLS) for r in rows}
    assert got == {i: brute(t) for i, t in enumerate(TEXTS)}
    assert "mit" in got[6][5] and "mit" in got[10][5] and got[9][5] == ""


def test_edge_rows(spark, tricky, no_rows):
    rows = S.scan(tricky).collect()
    assert sorted((tuple(r[c] for c in ["doc_id", *COLS]) for r in rows), key=str) == sorted(((i, *brute(t)) for i, t, _ in tricky_rows()), key=str)
    assert S.scan(no_rows).count() == 0


def test_block_holds_every_template():
    assert max(len(t.phrase.split()) if t.phrase else len(t.words) for t in S.TEMPLATES) <= S.BLOCK - S.STRIDE + 1


OWN = [("Licensed under the GNU General Public License, version 3.", "gpl,gpl-3.0"), ("Licensed under the GNU Lesser General Public License, version 3.", "gpl,lgpl-3.0"),
       ("GNU Affero General Public License version 3", "agpl-3.0,gpl"), ("GNU General Public License, version 2", "gpl,gpl-2.0"),
       ("Released under the Apache License, Version 2.0.", "apache-2.0"), ("Released under the MIT License.", "mit"),
       ("The film was released under the terms of a new license in May.", ""), ("A license under the terms of MIT, released for all.", ""),
       ("Licensed under CC BY-NC 4.0", "cc-by,cc-by-nc-4.0"), ("Licensed under CC BY-SA 4.0", "cc-by,cc-by-sa-4.0"), ("Licensed under CC BY 4.0", "cc-by,cc-by-4.0"),
       ("This work is licensed under a Creative Commons Attribution 4.0 International License.", "cc-by-4.0"),
       ("This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.", "cc-by-nc-4.0"),
       ("This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", "cc-by-sa-4.0"),
       ("you can redistribute it and/or modify it under the terms of the GNU General Public License", "gpl,gpl-3.0"),
       ("you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License", "gpl,lgpl-3.0"),
       ("you can redistribute it and/or modify it under the terms of the GNU Affero General Public License", "agpl-3.0,gpl"),
       ("Permission is granted to copy, distribute and/or modify this document under the terms of the GNU Free Documentation License", "gfdl-1.3"),
       ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted", "isc"),
       ("Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files", "mit")]


def test_siblings_get_their_own_label_alone(spark):
    rows = S.scan(spark.createDataFrame([(None, t) for t, _ in OWN], "doc_id long, text string").withColumn("k", F.col("text"))).collect()
    got = sorted((r["n_words"], r["labels"]) for r in rows)
    assert got == sorted((len(re.findall(r"[a-z0-9]+", t.lower())), want) for t, want in OWN)
    for t, want in OWN:
        assert brute(t)[5] == want
