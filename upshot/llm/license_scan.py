"""License scan: an exact set-similarity join of text blocks with templates.

Words are the runs of ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]`` after lower-casing
A-Z. Blocks are ``BLOCK`` words, every ``STRIDE`` words, so that any passage of
``BLOCK - STRIDE + 1`` words lies whole in one. A sentence of a license labels a block
that holds at least ``THRESHOLD`` of its different words, among them those that tell it from its
like; of a family of such sentences, those the block has most words of. A short notice needs all its
words, one after the other.

Method. Only words of templates can be in common, so sets are restricted to them
and ordered by their frequency in all documents, rarest first, ties by the word.
With least overlap a for a template of size t, an overlap of a needs a common word
among the first t - a + 1 words of the template and the first b - a + 1 of a block
of b such words (prefix filter); blocks with b < a can't match (length filter);
and c common prefix words, the last at places i and j, allow at most c plus the
smaller of what follows i and j (positional filter). Candidates that pass are
verified on the whole sets, then for their telling words and their order.

Everything is DataFrame functions. Templates are a fixed list, so the word order
and the prefix index are bounded by it; documents without any prefix word are
dropped before blocks are made. No block meets another block, only templates.

Defined cases: a null text is empty and has no words; empty and repeated rows,
and rows with a null id, are rows of the result like others, each with the labels of its
own text; an empty table gives an empty result; other columns
are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import ceil

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import documents, materialise

BLOCK = 64
STRIDE = 32
THRESHOLD = 0.8
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
PHRASES = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))
#: Short notices by label: all their words, one after the other.
NOTICES = (
    ("agpl-3.0", "affero general public license version 3"),
    ("apache-2.0", "apache license version 2.0"),
    ("boost-1.0", "boost software license version 1.0"),
    ("cc-by-4.0", "cc by 4.0"),
    ("cc-by-nc-4.0", "cc by nc 4.0"),
    ("cc-by-sa-4.0", "cc by sa 4.0"),
    ("epl-2.0", "eclipse public license 2.0"),
    ("gfdl-1.3", "gnu free documentation license version 1.3"),
    ("gpl-2.0", "gnu general public license version 2"),
    ("gpl-3.0", "gnu general public license version 3"),
    ("lgpl-3.0", "lesser general public license version 3"),
    ("mit", "mit license"),
    ("mpl-2.0", "mozilla public license version 2.0"),
)
#: Sentences of licenses by label, the words that tell them from their like, and their family: of a
#: family, a block is labelled by the sentences it has most words of.
SENTENCES = (
    ("agpl-3.0", "you can redistribute it and or modify it under the terms of the gnu affero general public license", ("affero",), "gnu"),
    ("apache-2.0", "you may not use this file except in compliance with the license you may obtain a copy of the license at", ("compliance", "obtain"), None),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
     ("redistribution", "binary"), None),
    ("cc-by-4.0", "this work is licensed under a creative commons attribution 4.0 international license", ("creative", "commons", "attribution"), "cc"),
    ("cc-by-nc-4.0", "this work is licensed under a creative commons attribution noncommercial 4.0 international license",
     ("creative", "commons", "noncommercial"), "cc"),
    ("cc-by-sa-4.0", "this work is licensed under a creative commons attribution sharealike 4.0 international license",
     ("creative", "commons", "sharealike"), "cc"),
    ("cc0-1.0", "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work",
     ("waived", "neighboring"), None),
    ("gfdl-1.3", "permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license",
     ("documentation",), "gnu"),
    ("gpl-3.0", "you can redistribute it and or modify it under the terms of the gnu general public license", ("gnu", "general"), "gnu"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", ("fee",), None),
    ("lgpl-3.0", "you can redistribute it and or modify it under the terms of the gnu lesser general public license", ("lesser",), "gnu"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files",
     ("charge", "obtaining"), None),
    ("unlicense", "this is free and unencumbered software released into the public domain", ("unencumbered",), None),
    ("zlib", "this software is provided as is without any express or implied warranty", ("software", "express", "implied"), None),
)


@dataclass(frozen=True)
class Template:
    label: str
    words: tuple[str, ...]   # different ones, sorted
    need: int                # least overlap
    phrase: str | None       # of a notice: its words between blanks
    must: tuple[str, ...]
    family: str


def _words(text: str) -> list[str]:
    return "".join(c if c.isalnum() else " " for c in text.lower()).split()


def least_overlap(size: int) -> int:
    return ceil(THRESHOLD * size - 1e-9)


def notice(label: str, text: str) -> Template:
    w = tuple(sorted(set(_words(text))))
    return Template(label, w, len(w), f" {' '.join(_words(text))} ", (), f"notice {label}")


def sentence(label: str, text: str, must: tuple[str, ...] = (), family: str | None = None) -> Template:
    w = tuple(sorted(set(_words(text))))
    return Template(label, w, least_overlap(len(w)), None, tuple(must), family or f"sentence {label}")


TEMPLATES = (*(notice(*n) for n in NOTICES), *(sentence(*t) for t in SENTENCES))


def words_of(text: Column) -> Column:
    """The words, lower-cased, in order. Lower-casing other letters than A-Z moves no
    word bound and makes no ASCII word, but for the Kelvin sign, which would become
    a k and so gives way to another letter sign first."""
    lower = F.lower(F.replace(F.coalesce(text, F.lit("")), F.lit("\u212a"), F.lit("\u212b")))
    return F.array_remove(F.split(lower, GAP), "")


def _starts(words: Column, phrase: str) -> Column:
    """Places where the phrase's words stand consecutively; looked up only where its first word occurs."""
    parts = phrase.split()
    here = F.sequence(F.lit(0), F.size(words) - len(parts))

    def fits(i: Column) -> Column:
        out = F.get(words, i) == parts[0]
        for k, w in enumerate(parts[1:], 1):
            out = out & (F.get(words, i + k) == w)
        return out

    return (F.when((F.size(words) >= len(parts)) & F.array_contains(words, parts[-1]) & F.array_contains(words, parts[0]),
                   F.filter(here, fits)).otherwise(F.array().cast("array<int>")))


def base_columns(docs: DataFrame, words: str = "words") -> DataFrame:
    out = docs.withColumn("_starts", F.array(*[_starts(F.col(words), p) for p, _ in PHRASES]))
    every = F.flatten("_starts")
    labels = F.filter(F.array(*[F.when(F.size(F.get("_starts", F.lit(k))) > 0, F.lit(label)) for k, (_, label) in enumerate(PHRASES)]),
                      lambda x: x.isNotNull())
    return (out.withColumn("n_words", F.size(words).cast("long")).withColumn("n_base", F.size(every).cast("long"))
            .withColumn("first_word", F.array_min(every).cast("long")).withColumn("last_word", F.array_max(every).cast("long"))
            .withColumn("base", labels).drop("_starts"))


def vocabulary(templates=TEMPLATES) -> list[str]:
    return sorted(set().union(*(t.words for t in templates)))


def held_words(words: Column, templates=TEMPLATES) -> Column:
    """The template words among the words, once each."""
    return F.array_intersect(words, F.array(*map(F.lit, vocabulary(templates))))


def word_order(docs: DataFrame, held: str, templates=TEMPLATES) -> list[str]:
    """The template words by the number of documents that hold them, then by the
    word. At most one row per template word reaches the driver."""
    counts = docs.select(F.explode(held).alias("w")).groupBy("w").agg(F.count(F.lit(1)).alias("n")).collect()
    n = {r["w"]: r["n"] for r in counts}
    return sorted(vocabulary(templates), key=lambda w: (n.get(w, 0), w))


def template_matches(docs: DataFrame, key: str, words: str, order: list[str], templates=TEMPLATES) -> DataFrame:
    """Rows (key, block, template, overlap, size) of all blocks and templates that
    match; ``order`` is the global order of :func:`word_order`."""
    spark = docs.sparkSession
    rank = {w: k for k, w in enumerate(order, 1)}
    rows, heads = [], set()
    for tid, t in enumerate(templates):
        ranks = sorted(rank[w] for w in t.words)
        for i, r in enumerate(ranks[:len(ranks) - t.need + 1]):
            rows.append((r, tid, i, len(ranks), t.need, ranks, t.phrase, sorted(rank[w] for w in t.must), t.family))
            heads.add(order[r - 1])
    index = spark.createDataFrame(rows, "rank int, template int, i int, size int, need int, ranks array<int>, phrase string, must array<int>, "
                                        "family string")  # bounded by the templates
    ordered = F.array(*map(F.lit, order))
    head_words = F.array(*map(F.lit, sorted(heads)))
    least = min(t.need for t in templates)
    blocks = (docs.where(F.arrays_overlap(F.col(words), head_words))
              .select(F.col(key).alias("key"), F.col(words).alias("_w"),
                      F.explode(F.sequence(F.lit(0), F.greatest(F.size(words) - 1, F.lit(0)), F.lit(STRIDE))).alias("block"))
              .select("key", "block", F.slice("_w", F.col("block") + 1, BLOCK).alias("here"))
              .select("key", "block", "here", F.array_intersect("here", ordered).alias("held"))
              .where((F.size("held") >= least) & F.arrays_overlap("held", head_words))
              .select("key", "block", F.concat(F.lit(" "), F.array_join("here", " "), F.lit(" ")).alias("here"),
                      F.sort_array(F.transform("held", lambda w: F.array_position(ordered, w).cast("int"))).alias("held")))
    probes = blocks.select("key", "block", "here", "held", F.posexplode("held").alias("j", "rank"))
    met = (probes.join(F.broadcast(index), "rank")
           .where((F.size("held") >= F.col("need")) & (F.col("j") <= F.size("held") - F.col("need"))))
    candidates = (met.where(F.col("phrase").isNull() | F.contains("here", "phrase"))
                  .groupBy("key", "block", "template", "size", "need", "held", "ranks", "must", "family")
                  .agg(F.count(F.lit(1)).alias("c"), F.max("i").alias("i"), F.max("j").alias("j"))
                  .where(F.col("c") + F.least(F.col("size") - F.col("i") - 1, F.size("held") - F.col("j") - 1) >= F.col("need")))
    met = (candidates.withColumn("overlap", F.size(F.array_intersect("held", "ranks")))
           .where((F.col("overlap") >= F.col("need")) & (F.size(F.array_except("must", "held")) == 0)))
    most = F.max("overlap").over(Window.partitionBy("key", "block", "family"))  # a row per template at most
    return met.withColumn("most", most).where("overlap = most").select("key", "block", "template", "overlap", "size")


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates=TEMPLATES) -> DataFrame:
    """A row per document: the base columns, ``labels`` with the templates' labels,
    ``score``, the largest share of a template's words found together, and
    ``blocks``, first words of the matching blocks."""
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    worded = docs.select(F.col(f"`{id_col}`").alias("id"), F.struct(F.xxhash64(F.lit(1), text).alias("a"), F.xxhash64(F.lit(2), text).alias("b")).alias("key"),
                         words_of(text).alias("words"))
    base, _ = materialise(base_columns(worded).withColumn("held", held_words(F.col("words"), templates)).drop("words"), "base")
    order = word_order(base, "held", templates)
    names = F.array(*[F.lit(t.label) for t in templates])
    found = (template_matches(worded, "key", "words", order, templates)
             .groupBy(F.col("key").alias("_key"))
             .agg(F.max(F.col("overlap") / F.col("size")).alias("best"), F.collect_set(F.get(names, F.col("template"))).alias("own"),
                  F.sort_array(F.collect_set("block")).alias("blocks")))
    return (base.join(found, F.col("key") == F.col("_key"), "left")
            .select(F.col("id").alias(id_col), "n_words", "n_base", "first_word", "last_word",
                    F.concat_ws(",", F.sort_array("base")).alias("base_labels"),
                    F.concat_ws(",", F.sort_array(F.array_union("base", F.coalesce("own", F.array().cast("array<string>"))))).alias("labels"),
                    F.coalesce("best", F.lit(0.0)).alias("score"), "blocks"))


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License labels of all documents."""
    return scan(documents(spark, sf_dir)).drop("blocks")


def _sql() -> str:
    rows = ", ".join(f"({k}, '{t.label}', {list(t.words)!r}, {t.need}, {'NULL' if t.phrase is None else repr(t.phrase)}, "
                     f"{list(t.must)!r}::VARCHAR[], '{t.family}')" for k, t in enumerate(TEMPLATES))

    def places(phrase: str) -> str:
        parts = phrase.split()
        fits = " AND ".join(f"words[i + {k + 1}] = '{w}'" for k, w in enumerate(parts))
        return f"list_filter(range(0, len(words) - {len(parts) - 1}), lambda i: {fits})"

    found = ", ".join(f"{places(p)} AS p{k}" for k, (p, _) in enumerate(PHRASES))
    base = "list_filter([" + ", ".join(f"CASE WHEN len(p{k}) > 0 THEN '{label}' END" for k, (_, label) in enumerate(PHRASES)) + "], lambda x: x IS NOT NULL)"
    every = "flatten([" + ", ".join(f"p{k}" for k in range(len(PHRASES))) + "])"
    return f"""
WITH t(template, label, ts, need, phrase, must, family) AS (VALUES {rows}),
w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{WORD}') AS words FROM documents),
p AS (SELECT *, {found} FROM w),
b AS (SELECT doc_id, words, {every} AS every, {base} AS base FROM p),
u AS (SELECT DISTINCT words FROM w),
blocks AS (SELECT words, s, list_distinct(words[s + 1:s + {BLOCK}]) AS held, ' ' || array_to_string(words[s + 1:s + {BLOCK}], ' ') || ' ' AS here
  FROM (SELECT words, unnest(range(0, len(words), {STRIDE})) AS s FROM u)),
m AS (SELECT words, s, label, family, len(list_intersect(held, ts)) AS n, len(ts) AS size FROM blocks, t WHERE len(list_intersect(held, ts)) >= need
  AND list_has_all(held, must) AND (phrase IS NULL OR contains(here, phrase))),
f AS (SELECT *, max(n) OVER (PARTITION BY words, s, family) AS most FROM m),
g AS (SELECT words, max(n / size) AS best, list(DISTINCT label) AS own FROM f WHERE n = most GROUP BY words)
SELECT b.doc_id, CAST(len(b.words) AS BIGINT) AS n_words, CAST(len(every) AS BIGINT) AS n_base,
       CAST(list_min(every) AS BIGINT) AS first_word, CAST(list_max(every) AS BIGINT) AS last_word,
       coalesce(array_to_string(list_sort(base), ','), '') AS base_labels,
       coalesce(array_to_string(list_sort(list_distinct(list_concat(base, coalesce(own, [])))), ','), '') AS labels,
       coalesce(best, 0.0) AS score
FROM b LEFT JOIN g ON b.words = g.words
"""


SQL = _sql()
