"""Licence scans: sparse word n-gram logistic regression over paragraphs, calibrated, confirmed against templates.

Words and word pairs are hashed to BUCKETS; a paragraph's logits are sums of rows of a weight matrix, taken over
whole texts at once. The classes are the licence families and "unknown". A temperature fitted on samples the weights
did not see calibrates the probabilities; below `confident` a paragraph is unknown. A prediction counts only if the
paragraph covers enough of one of its family's templates.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import buffer_of, lowered, mixed, prefix_sums, ranges_hashed, shipped, slices, words_in

#: The unknown class is fitted on lines of SAMPLE_DOCS documents, at most SAMPLE_LINES of at most SAMPLE_BYTES each.
BUCKETS, EPOCHS, RATE, DECAY, CONFIDENT, COVER, SAMPLE_DOCS, SAMPLE_LINES, SAMPLE_BYTES, SEED = 1 << 15, 60, 0.5, 1e-5, 0.7, 0.6, 500, 50_000, 4096, 11
#: A sampled line with one of these is no sample of the unknown class, as it may be a notice.
DOUBTFUL = "licen[sc]e|copyright|public domain|warranty|permission|rights reserved"
#: Notices and sentences of each family.
TEMPLATES = {
    "mit": ["released under the mit license", "licensed under the mit license", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "the software is provided as is without warranty of any kind express or implied"],
    "apache-2.0": ["licensed under the apache license version 2.0", "you may not use this file except in compliance with the license", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis"],
    "gpl": ["this work is licensed under the gnu general public license version 3", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation", "you should have received a copy of the gnu general public license along with this program"],
    "lgpl": ["licensed under the gnu lesser general public license version 2.1", "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license"],
    "bsd": ["licensed under the bsd 3 clause license", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "redistributions of source code must retain the above copyright notice"],
    "mpl-2.0": ["this source code form is subject to the terms of the mozilla public license v 2.0", "licensed under the mozilla public license version 2.0"],
    "cc-by": ["this work is licensed under a creative commons attribution 4.0 international license", "licensed under cc by 4.0"],
    "cc-by-sa": ["this work is licensed under a creative commons attribution sharealike 4.0 international license", "licensed under cc by sa 4.0"],
    "cc-by-nc": ["licensed under cc by nc 4.0", "this work is licensed under a creative commons attribution noncommercial 4.0 international license"],
    "cc0": ["to the extent possible under law the author has waived all copyright and related or neighboring rights to this work", "released under cc0 1.0 universal public domain dedication"],
    "isc": ["permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "licensed under the isc license"],
    "unlicense": ["this is free and unencumbered software released into the public domain", "released under the unlicense"],
    "proprietary": ["all rights reserved", "no part of this publication may be reproduced without prior written permission", "this software is confidential and proprietary information"],
}
FAMILIES = [*TEMPLATES, "unknown"]
#: Words that stand around notices, and sentences near to licences that name none.
AROUND = "copyright (c) 2019 2021 2024 the authors contributors project see file for details software code this is".split()
NEAR = ["you need a driving license to rent a car", "the general public was invited", "the license plate was found", "released in version 2.0 of the program", "free of charge for any person", "he was granted permission to leave", "the author has reserved a table", "software released under pressure", "version 3 of the text", "under the law all rights are equal", "terms and conditions of sale", "the apache helicopter landed", "common attribution errors in surveys", "the public domain of mathematics"]


def paragraphs(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Edges of the lines of each text; a line never crosses texts."""
    return np.unique(np.concatenate([offsets, np.flatnonzero(raw == 10) + 1]))


def grams(raw: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, ...]:
    """(bucket of each word, bucket of each pair or -1, paragraph, hash, start and end of each word), trimmed of marks."""
    low = lowered(raw).copy()
    mark = np.zeros(256, bool)
    mark[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = True
    inner = np.zeros(len(low), bool)
    inner[1:-1] = (low[1:-1] == 46) & (low[:-2] >= 48) & (low[:-2] <= 57) & (low[2:] >= 48) & (low[2:] <= 57) if len(low) > 2 else False
    low[mark[low] & ~inner] = 32
    start, end, row = words_in(low, edges)
    h = ranges_hashed(prefix_sums(low), start, end)
    pair = np.full(len(h), -1, np.int64)
    if len(h) > 1:
        both = row[1:] == row[:-1]
        with np.errstate(over="ignore"):
            pair[1:] = np.where(both, (mixed(h[:-1] * np.uint64(3) + h[1:]) % np.uint64(BUCKETS)).astype(np.int64), -1)
    return (h % np.uint64(BUCKETS)).astype(np.int64), pair, row, h, start, end


def logits(raw: np.ndarray, edges: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, ...]:
    """(logits by paragraph, words by paragraph, hash, paragraph, start and end of each word). Sums are scaled by 1/sqrt(words)."""
    one, two, row, h, start, end = grams(raw, edges)
    total = np.zeros((len(edges) - 1, weights.shape[1]))
    n = np.bincount(row, minlength=len(edges) - 1)
    if len(row):
        each = weights[one] + np.where(two[:, None] >= 0, weights[two], 0)
        first = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
        total[row[first]] = np.add.reduceat(each, first, axis=0)
    total /= np.sqrt(np.maximum(n, 1))[:, None]
    return total + weights[-1], n, h, row, start, end


def _softmax(x: np.ndarray) -> np.ndarray:
    x = np.exp(x - x.max(axis=1, keepdims=True))
    return x / x.sum(axis=1, keepdims=True)


def training_set(negatives: list[str]) -> tuple[list[str], np.ndarray]:
    """Paragraphs and their classes: templates whole, cut, with a word less, and set among other words; others as unknown.

    Half of the other words are made up, each time anew, so that the samples kept aside for the temperature have words
    that the weights have never seen, as texts have.
    """
    rng = np.random.default_rng(SEED)
    texts, classes = [], []
    other = lambda n: [str(rng.choice(AROUND)) if rng.random() < 0.5 else "".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), rng.integers(2, 9))) for _ in range(n)]
    for k, family in enumerate(TEMPLATES):
        for template in TEMPLATES[family]:
            words = template.split()
            for i in range(40):
                keep = words if i % 4 else words[: max(4, len(words) * 3 // 4)]
                if i % 3 == 1 and len(keep) > 9:
                    gone = int(rng.integers(len(keep)))
                    keep = [*keep[:gone], *keep[gone + 1 :]]
                texts.append(" ".join([*other(rng.integers(0, 5)), *keep, *other(rng.integers(0, 5))]))
                classes.append(k)
    unknown = [*NEAR * 12, *negatives]
    for i in range(200):
        unknown.append(" ".join(rng.choice(AROUND, rng.integers(1, 8)) if i % 2 else other(rng.integers(1, 30))))
    return [*texts, *unknown], np.array([*classes, *[len(FAMILIES) - 1] * len(unknown)])


def trained(negatives: list[str]) -> np.ndarray:
    """Weights (BUCKETS + 1 rows, the last one biases), divided by the temperature that fits samples kept aside."""
    texts, y = training_set(negatives)
    order = np.random.default_rng(SEED).permutation(len(texts))
    data = [t.replace("\n", " ").encode() for t in texts]
    edges = np.r_[0, np.cumsum([len(d) + 1 for d in data])]
    raw = np.frombuffer(b"\n".join(data) + b"\n", np.uint8)
    one, two, row, *_ = grams(raw, edges)
    rows = np.concatenate([row, row[two >= 0]])
    cols = np.concatenate([one, two[two >= 0]])
    used, at = np.unique(cols, return_inverse=True)
    n = np.bincount(row, minlength=len(texts))
    scale = 1 / np.sqrt(np.maximum(n, 1))
    aside = np.zeros(len(texts), bool)
    aside[order[: len(texts) // 5]] = True
    w, bias = np.zeros((len(used), len(FAMILIES))), np.zeros(len(FAMILIES))
    target = np.eye(len(FAMILIES))[y]
    balance = 1 / np.maximum(np.bincount(y, minlength=len(FAMILIES)), 1)
    each = balance[y] * ~aside
    each /= each.sum()
    by_col = np.argsort(at, kind="stable")
    firsts = np.searchsorted(at[by_col], np.arange(len(used)))
    by_row = np.argsort(rows, kind="stable")
    present, row_first = np.unique(rows[by_row], return_index=True)

    def out():
        z = np.zeros((len(texts), len(FAMILIES)))
        z[present] = np.add.reduceat(w[at[by_row]], row_first, axis=0)
        return z * scale[:, None] + bias

    speed, bias_speed = np.zeros_like(w), np.zeros_like(bias)
    for _ in range(EPOCHS):
        error = (_softmax(out()) - target) * each[:, None]
        g = np.add.reduceat((error * scale[:, None])[rows[by_col]], firsts, axis=0) + DECAY * w
        speed = 0.9 * speed - RATE * 100 * g
        bias_speed = 0.9 * bias_speed - RATE * error.sum(0)
        w += speed
        bias += bias_speed
    z = out()[aside]
    temps = np.geomspace(0.25, 8, 41)
    loss = [-np.log(_softmax(z / t)[np.arange(len(z)), y[aside]] + 1e-12).mean() for t in temps]
    full = np.zeros((BUCKETS + 1, len(FAMILIES)), np.float32)
    full[used], full[-1] = w, bias
    return full / temps[int(np.argmin(loss))]


def _template_words() -> list[list[set[int]]]:
    """Hashes of the word triples of each template, by family."""
    out = []
    for family in TEMPLATES:
        sets = []
        for t in TEMPLATES[family]:
            raw = np.frombuffer(t.encode(), np.uint8)
            sets.append(triples(grams(raw, np.array([0, len(raw)]))[3]))
        out.append(sets)
    return out


def triples(h: np.ndarray) -> set[int]:
    if len(h) < 3:
        return set(h.tolist())
    with np.errstate(over="ignore"):
        return set(mixed(h[:-2] * np.uint64(9) + h[1:-1] * np.uint64(3) + h[2:]).tolist())


def _ordered(h: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mixed(h[:-2] * np.uint64(9) + h[1:-1] * np.uint64(3) + h[2:])


def _windows(hits: list[tuple[int, int]], size: int, cover: float) -> list[tuple[int, int, float]]:
    """(first word, end, share) of stretches whose distinct triples cover enough of a template of `size` triples.

    hits: (word, triple) in order. A stretch spans at most twice the template's words and eight.
    """
    out, now = [], []

    def full():
        if len(now) < cover * size:
            return False
        out.append((now[0][0], now[-1][0] + 3, len(now) / size))
        now.clear()
        return True

    for at, k in hits:
        again = next((j for j, (_, x) in enumerate(now) if x == k), None)
        if again is not None and not full():
            del now[: again + 1]
        while now and at + 3 - now[0][0] > 2 * (size + 2) + 8 and not full():
            del now[0]
        now.append((at, k))
    full()
    return out


def noticed(h: np.ndarray, text: np.ndarray, templates: list[list[set[int]]], cover: float) -> list[tuple[int, int, int, float]]:
    """(first word, end, family, share) of stretches of words, over any line ends, that cover a template.

    Of two stretches that overlap in over half of the shorter one, the one that covers more of its template stays.
    """
    if len(h) < 3:
        return []
    every = _ordered(h)
    known = np.array(sorted(set().union(*(t for own in templates for t in own))), np.uint64)
    at = np.flatnonzero((known[np.minimum(np.searchsorted(known, every), len(known) - 1)] == every) & (text[:-2] == text[2:]))
    by: dict[int, list[tuple[int, int]]] = {}
    for i, k in zip(at.tolist(), every[at].tolist()):
        by.setdefault(int(text[i]), []).append((i, k))
    out = []
    for hits in by.values():
        seen = {k for _, k in hits}
        found = []
        for f, own in enumerate(templates):
            for t in own:
                if len(seen & t) >= cover * len(t):
                    found += [(share, s, e, f) for s, e, share in _windows([x for x in hits if x[1] in t], len(t), cover)]
        kept: list[tuple[int, int, int, float]] = []
        for share, s, e, f in sorted(found, key=lambda x: (-x[0], x[1] - x[2], x[1], x[3])):
            if all(2 * (min(e, b) - max(s, a)) <= min(e - s, b - a) for a, b, *_ in kept):
                kept.append((s, e, f, share))
        out += sorted(kept)
    return out


def _scanned(batches, shared, confident, cover):
    weights, templates = shared.value, _template_words()
    unknown = len(FAMILIES) - 1
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("family", pa.string()), ("probability", pa.float64()), ("confirmed", pa.bool_()), ("cover", pa.float64())]))
    for batch in batches:
        raw_all, offsets_all = buffer_of(batch.column(1))
        counts, found = [], []
        for a, b in slices(offsets_all, 1 << 20):
            raw, offsets = raw_all[offsets_all[a] : offsets_all[b]], offsets_all[a : b + 1] - offsets_all[a]
            edges = paragraphs(raw, offsets)
            z, n, h, row, start, end = logits(raw, edges, weights)
            p = _softmax(z)
            best = p.argmax(axis=1)
            probability = p[np.arange(len(p)), best]
            doc = np.searchsorted(offsets, edges[:-1], side="right") - 1
            held: list[list[tuple]] = [[] for _ in range(b - a)]
            for i in np.flatnonzero((best != unknown) & (probability >= confident) & (n > 0)).tolist():
                own = triples(h[np.searchsorted(row, i) : np.searchsorted(row, i, side="right")])
                share = max(len(own & t) / len(t) for t in templates[best[i]])
                held[doc[i]].append((int(edges[i]), int(edges[i + 1]), int(best[i]), float(probability[i]), share >= cover, float(share)))
            for first, last, f, share in noticed(h, doc[row], templates, cover):
                s, e, own = int(start[first]), int(end[last - 1]), held[doc[row[first]]]
                lines = [x for x in own if x[2] == f and x[0] < e and s < x[1]]
                if any(x[4] for x in lines):
                    continue  # reported as a line
                chance = float(_softmax(logits(raw[s:e], np.array([0, e - s]), weights)[0])[0, f])
                if chance >= confident:
                    # lines of a wrapped notice are part of it
                    own[:] = [x for x in own if x not in lines] + [(s, e, f, chance, True, share)]
            for d, own in enumerate(held):
                points = lambda x: int(((raw[offsets[d] : x] & 0xC0) != 0x80).sum())  # noqa: B023, E731
                found.append([{"start": points(s), "end": points(e), "family": FAMILIES[f], "probability": q, "confirmed": sure, "cover": share} for s, e, f, q, sure, share in sorted(own)])
            counts += np.bincount(doc[n > 0], minlength=b - a).tolist()
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(found, kind)], names=["doc_id", "n_paragraphs", "found"])


def scanned(docs: DataFrame, sample_docs: int = SAMPLE_DOCS, confident: float = CONFIDENT, cover: float = COVER) -> DataFrame:
    """One row per row of docs: doc_id, n_paragraphs, families, n_confirmed, n_unconfirmed, found.

    A paragraph is a line with a word. families: those confirmed, sorted, comma-joined, "" if none. found: code-point
    spans with family, probability, share of the template covered: lines, and stretches of words over line ends or
    within a line that cover a template and are judged by themselves. The weights are fitted on the templates and, for
    the unknown class, on lines of sample_docs documents, those with the least hash of doc_id: lines without a DOUBTFUL
    word and of SAMPLE_BYTES bytes at most, of which SAMPLE_LINES with the least hash are taken, whatever rows share a
    doc_id. A null or empty text has none.
    """
    ids = docs.select("doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_docs)
    few = docs.select("doc_id", "text").where("text is not null").join(F.broadcast(ids.distinct()), "doc_id", "left_semi")  # sample_docs ids at most
    line = few.select(F.explode(F.split("text", "\n")).alias("line")).where(~F.rlike(F.lower("line"), F.lit(DOUBTFUL)) & (F.octet_length("line") <= SAMPLE_BYTES))
    negatives = sorted(r[0] for r in line.orderBy(F.xxhash64("line"), "line").limit(SAMPLE_LINES).collect())
    shared = docs.sparkSession.sparkContext.broadcast(trained(negatives))
    kind = dict(docs.dtypes)["doc_id"]
    rows = docs.select("doc_id", "text").mapInArrow(shipped(__name__, "_scanned", shared, confident, cover), f"doc_id {kind}, n_paragraphs long, found array<struct<start:long,end:long,family:string,probability:double,confirmed:boolean,cover:double>>")
    sure = F.filter("found", lambda s: s["confirmed"])
    return rows.select("doc_id", "n_paragraphs", F.array_join(F.array_sort(F.array_distinct(F.transform(sure, lambda s: s["family"]))), ",").alias("families"), F.size(sure).cast("long").alias("n_confirmed"), (F.size("found") - F.size(sure)).cast("long").alias("n_unconfirmed"), "found")


def op4_licenses(spark, sf_dir) -> DataFrame:
    """Query: licence families named in every document."""
    rows = scanned(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return rows.select("doc_id", "n_paragraphs", "families", "n_confirmed", "n_unconfirmed", F.array_join(F.transform("found", lambda s: F.concat_ws(":", s["family"], s["start"].cast("string"), s["end"].cast("string"))), ",").alias("spans"))
