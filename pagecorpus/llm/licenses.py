"""Operator 7, license scans by diagonal voting.

Every rolling hash of ``K`` words of every text is joined by Spark to the positions of the same
hash in the license templates.  A hit votes for its diagonal (word position in the text less
position in the template); votes are counted per text, template and diagonal before the shuffle,
neighbouring diagonals are merged (words inserted or left out), and the spans with enough votes
are verified word by word in the text.

Base phrases are templates that must stand whole and consecutive.  The other templates are
wordings of notices, found when at least ``SHARE`` of their words stand in the span in order.

Defined results: null text has no words; a phrase that repeats counts at every place; equal
rows give equal rows; texts without a place have null first_word and last_word, empty labels
and score 0.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pagecorpus.llm import common as C
from pagecorpus.session import materialize

K = 3
SHARE = 0.8
NEAR = 3
#: Candidate rows up to which they are broadcast to the texts (about 100 bytes each).
BROADCAST_ROWS = 100_000
#: Phrases and labels of the base scan.
BASE = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
#: Wordings of license notices.
NOTICES = [
    ("gpl-3", "licensed under the gnu general public license version 3"),
    ("gpl-3", "either version 3 of the license or at your option any later version"),
    ("gpl-2", "licensed under the gnu general public license version 2"),
    ("gpl-2", "either version 2 of the license or at your option any later version"),
    ("lgpl", "under the terms of the gnu lesser general public license"),
    ("agpl-3", "under the terms of the gnu affero general public license"),
    ("mpl-2", "subject to the terms of the mozilla public license v 2 0"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("apache-2", "you may not use this file except in compliance with the license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
    ("cc-by-sa", "cc by sa"),
    ("cc-by", "creative commons attribution 4 0 international license"),
]
_OTHER = bytes(b if b >= 0x80 or chr(b) in "0123456789abcdefghijklmnopqrstuvwxyz" else 0x20 for b in range(256))


def license_words(text) -> list[bytes]:
    """Words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of the lower-case text."""
    return C.text_bytes(text).translate(_OTHER).split()


def templates() -> list[tuple[bool, str, list[bytes]]]:
    """(whether a base phrase, label, words)."""
    return [(True, v, license_words(k)) for k, v in BASE.items()] + [(False, v, license_words(k)) for v, k in NOTICES]


def _rolling(words: list[bytes]) -> np.ndarray:
    if len(words) < K:
        return np.empty(0, np.int64)
    return C.shingle_hashes(C.word_hashes(words), K).view(np.int64)


def template_positions(spark) -> DataFrame:
    rows = [(int(h), i, q) for i, (_, _, w) in enumerate(templates()) for q, h in enumerate(_rolling(w))]
    return spark.createDataFrame(rows, "h long, template int, q int")


def spans(docs: DataFrame) -> DataFrame:
    """(doc_id, key, template, d0, d1, votes): merged diagonals with enough votes; ``key`` is a
    hash of the text."""
    spark = docs.sparkSession

    def run(batches):
        for pdf in batches:
            for doc_id, key, text in zip(pdf["doc_id"], pdf["key"], pdf["text"], strict=True):
                h = _rolling(license_words(text))
                if len(h):
                    yield pd.DataFrame({"doc_id": pd.Series([doc_id] * len(h), dtype="Int64") if pd.isna(doc_id) else np.full(len(h), int(doc_id)),
                                        "key": np.full(len(h), key), "p": np.arange(len(h), dtype=np.int32), "h": h})
    grams = docs.select("doc_id", F.xxhash64("text").alias("key"), "text").mapInPandas(run, "doc_id long, key long, p int, h long")
    hits = grams.join(F.broadcast(template_positions(spark)), "h")  # a few hundred rows, fixed in this module
    votes = (hits.groupBy("doc_id", "key", "template", (F.col("p") - F.col("q")).alias("diagonal"))
             .agg(F.countDistinct("p").alias("votes")))
    near = Window.partitionBy("doc_id", "key", "template").orderBy("diagonal")
    base = [i for i, t in enumerate(templates()) if t[0]]
    apart = F.col("template").isin(base) | (F.col("diagonal") - F.lag("diagonal").over(near) > NEAR)
    merged = (votes.withColumn("run", F.sum(F.coalesce(apart, F.lit(True)).cast("int")).over(near))
              .groupBy("doc_id", "key", "template", "run")
              .agg(F.min("diagonal").alias("d0"), F.max("diagonal").alias("d1"), F.sum("votes").alias("votes")))
    need = F.create_map(*[F.lit(x) for i, (is_base, _, w) in enumerate(templates())
                          for x in (i, len(w) - K + 1 if is_base else max(1, (len(w) - K + 1) // 2))])
    return merged.where(F.col("votes") >= need[F.col("template")]).drop("run")


def _share(words: list[bytes], template: list[bytes], d0: int, d1: int) -> float:
    """Share of the template's words that stand in the span, in order (longest common
    subsequence over the span, which is little longer than the template)."""
    lo, hi = max(0, d0), min(len(words), d1 + len(template))
    part = words[lo:hi]
    row = [0] * (len(template) + 1)
    for w in part:
        old = 0
        for j, t in enumerate(template, 1):
            old, row[j] = row[j], max(row[j], row[j - 1], old + (w == t))
    return row[-1] / len(template)


def scan(docs: DataFrame) -> DataFrame:
    """One row for each row of ``docs`` (doc_id, text): n_words, the base phrases' places, labels
    and score (the best verified share of a template)."""
    found = materialize(spans(docs), "license_spans")
    per = found.groupBy(F.col("doc_id").alias("id2"), F.col("key").alias("key2")).agg(F.collect_list(F.struct("template", "d0", "d1")).alias("spans"))
    if found.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        per = F.broadcast(per)
    kinds = templates()

    def run(batches):
        for pdf in batches:
            out = []
            for doc_id, text, some in zip(pdf["doc_id"], pdf["text"], pdf["spans"], strict=True):
                w = license_words(text)
                places, base, fits = [], set(), []
                for s in some if some is not None else ():
                    is_base, label, t = kinds[s["template"]]
                    if is_base:
                        if w[s["d0"]:s["d0"] + len(t)] == t:
                            places.append(int(s["d0"]))
                            base.add(label)
                    elif (share := _share(w, t, int(s["d0"]), int(s["d1"]))) >= SHARE:
                        fits.append((-share, int(s["d0"]), int(s["d1"]) + len(t), label))
                labels, taken = set(base), []
                for _, lo, hi, label in sorted(fits):  # of wordings at one place the best fits
                    if all(hi <= x or lo >= y or label == z for x, y, z in taken):
                        taken.append((lo, hi, label))
                        labels.add(label)
                score = 1.0 if base else max((-f[0] for f in fits), default=0.0)
                out.append((doc_id, len(w), len(places), min(places, default=None), max(places, default=None),
                            ",".join(sorted(base)), ",".join(sorted(labels)), score))
            made = pd.DataFrame(out, columns=["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"])
            yield made.astype({"doc_id": "Int64", "first_word": "Int64", "last_word": "Int64"})
    d = docs.select("doc_id", "text", F.xxhash64("text").alias("key"))
    met = d.join(per, F.col("doc_id").eqNullSafe(F.col("id2")) & (F.col("key") == F.col("key2")), "left").select("doc_id", "text", "spans")
    return met.mapInPandas(run, "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double")
