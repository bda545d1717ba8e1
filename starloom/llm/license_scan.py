"""Licence scan: MinHash bands over overlapping windows retrieve templates, exact shingle containment verifies them.

Words are runs of letters and digits in lower case; shingles are five words (a shorter template is one shingle). Templates
are put into classes of size c, the next power of two of their shingles. A text's windows for a class are max(4, 2c) shingles
long and start every max(1, c/2), so a passage of up to 1.5c shingles lies whole in one of them. A template of which 0.8 is
in a window has Jaccard similarity of over 0.22 with it; with one row a band and 64 bands, it's retrieved with probability
1 - 0.78**64 or more, over 0.9999998.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from starloom.llm.common import table, without
from starloom.llm.licence_texts import WHOLE

SHINGLE, CONTAINMENT, BANDS, SEED = 5, 0.8, 64, 42
#: Shingles that are hashed at a time.
SPAN = 8192
# Notices of well-known licences.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0",
    "Apache-2.0 notice": "you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    "Apache-2.0 warranty": 'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.',
    "MIT": "Released under the MIT License",
    "MIT licensed": "Licensed under the MIT License",
    "MIT permission": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software',
    "GPL-3.0": "licensed under the GNU General Public License, version 3",
    "GPL notice": "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
    "LGPL notice": "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation",
    "BSD": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0",
    "CC-BY-4.0": "Licensed under CC BY 4.0",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0",
    "CC notice": "This work is licensed under a Creative Commons Attribution",
    "CC0-1.0": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work",
    "Unlicense": "This is free and unencumbered software released into the public domain",
    "All rights reserved": "All rights reserved",
} | WHOLE
_WORD = re.compile(r"[^\W_]+")


def words_of(text: str | None) -> list[str]:
    return _WORD.findall((text or "").lower())


def shingles(words: list[str], k: int) -> set[tuple[str, ...]]:
    return set(zip(*(words[i:] for i in range(k))))


class Scanner:
    """Templates by shingle width and class, with their MinHash signatures."""

    def __init__(self, templates: dict[str, str], shingle: int = SHINGLE, containment: float = CONTAINMENT, bands: int = BANDS, seed: int = SEED):
        rng = np.random.Generator(np.random.PCG64(seed))
        self.containment = containment
        self.a = rng.integers(0, 1 << 32, (bands, 1), dtype=np.uint32) | np.uint32(1)
        self.b = rng.integers(0, 1 << 32, (bands, 1), dtype=np.uint32)
        self.hashes: dict[str, int] = {}
        self.classes: dict[int, dict[int, list]] = {}
        self.bands: dict[tuple[int, int], tuple[dict[tuple[int, int], list[int]], np.ndarray]] = {}
        for name, text in templates.items():
            words = words_of(text)
            if not words:
                continue
            k = min(shingle, len(words))
            own = shingles(words, k)
            c = 1 << (len(words) - k).bit_length()
            signature = (self.shingle_hashes(words, k) * self.a + self.b).min(axis=1)
            self.classes.setdefault(k, {}).setdefault(c, []).append((name, own, signature))
        for k, classes in self.classes.items():
            for c, found in classes.items():
                table, sieve = {}, np.zeros(1 << 18, bool)
                for number, (_, _, signature) in enumerate(found):
                    sieve[self._slots(signature)] = True
                    for band, least in enumerate(signature.tolist()):
                        table.setdefault((band, least), []).append(number)
                self.bands[k, c] = table, sieve

    @staticmethod
    def _slots(minima: np.ndarray) -> np.ndarray:
        return minima * np.uint32(0x9E3779B1) >> np.uint32(14)

    def shingle_hashes(self, words: list[str], k: int) -> np.ndarray:
        known = self.hashes
        for w in set(words).difference(known):
            if len(known) > 1 << 18:
                known.clear()
            known[w] = xxhash.xxh64_intdigest(w)
        codes = np.fromiter((known[w] if w in known else xxhash.xxh64_intdigest(w) for w in words), np.uint64, len(words))
        n = len(words) - k + 1
        total = np.zeros(n, np.uint64)
        for i in range(k):
            total = total * np.uint64(0x9E3779B97F4A7C15) + codes[i : i + n]
        return (total >> np.uint64(32)).astype(np.uint32)

    def windows(self, hashes: np.ndarray, sizes):
        """(c, first window, minima by band and window) of each class size, a span of the text at a time."""
        largest = max(sizes)
        for base in range(0, len(hashes), SPAN):
            part = hashes[base : base + SPAN + 2 * largest + 4]
            low = np.full((len(self.a), min(SPAN, -(-(len(hashes) - base) // largest) * largest) + 2 * largest + 4), 0xFFFFFFFF, np.uint32)
            np.multiply(part, self.a, out=low[:, : len(part)])
            low[:, : len(part)] += self.b
            last = min(SPAN, len(hashes) - base)
            low = np.minimum(low[:, :-1], low[:, 1:])
            low, c, step = np.minimum(low[:, :-2], low[:, 2:]), 1, 1  # windows of 4, from each shingle
            if 1 in sizes:
                yield 1, base, low[:, :last]
            for c in (1 << i for i in range(1, largest.bit_length())):
                if c > 2:  # 2c shingles are two windows of c, c shingles apart; they start every c / 2
                    low = self._double(low, c // step)
                    step = c // 2
                if c in sizes:
                    yield c, base // step, low[:, : -(-last // step)]

    @staticmethod
    def _double(low: np.ndarray, apart: int) -> np.ndarray:
        return np.minimum(low[:, :-apart], low[:, apart:])[:, ::2]

    def candidates(self, k: int, c: int, low: np.ndarray) -> set[tuple[int, int]]:
        """(template, window) that agree in a band: the windows' minima are looked up in the bands' tables."""
        table, sieve = self.bands[k, c]
        bands, windows = divmod(np.flatnonzero(sieve.take(self._slots(low), mode="wrap")), low.shape[1])  # few others get past the sieve
        found: set[tuple[int, int]] = set()
        for band, w, least in zip(bands.tolist(), windows.tolist(), low[bands, windows].tolist()):
            found.update((number, w) for number in table.get((band, least), ()))
        return found

    def find(self, text: str | None) -> list[tuple[str, int, float]]:
        """(template, first word of the window, containment) of the best window of each template found, the first of equals."""
        words = words_of(text)
        best: dict[str, tuple[float, int]] = {}
        for k, classes in self.classes.items():
            if len(words) < k:
                continue
            hashes = self.shingle_hashes(words, k)
            for c, first, low in self.windows(hashes, classes):
                step = max(1, c // 2)
                for number, w in sorted(self.candidates(k, c, low)):
                    name, own, _ = classes[c][number]
                    at = (first + w) * step
                    share = len(own & shingles(words[at : at + max(4, 2 * c) + k - 1], k)) / len(own)
                    if share >= self.containment and share > best.get(name, (0.0, 0))[0]:
                        best[name] = share, at
        return [(name, at, share) for name, (share, at) in sorted(best.items())]


_scanners: dict[str, Scanner] = {}


def scan_documents(docs: DataFrame, text_col: str = "text", templates: dict[str, str] | None = None, containment: float = CONTAINMENT) -> DataFrame:
    """A row of docs for each template found in its text, with columns template, first_word and containment added.

    Whole texts are scanned row by row, without a shuffle. Null texts, empty ones and texts with fewer words than a shingle
    match nothing; repeated rows have rows of their own; columns of docs that bear a result's name are replaced. An empty
    table, or no template, gives no rows. The templates are a parameter of the program, not a table that grows.
    """
    templates = TEMPLATES if templates is None else templates
    names = ["template", "first_word", "containment"]
    rest = without(docs, names)

    def of(texts: pd.Series) -> pd.Series:
        key = repr((templates, containment))
        if key not in _scanners:
            _scanners[key] = Scanner(templates, containment=containment)
        scanner = _scanners[key]
        return pd.Series([[{"template": n, "first_word": at, "containment": s} for n, at, s in scanner.find(t)] for t in texts])

    of.__annotations__ = {"texts": pd.Series, "return": pd.Series}
    # not deterministic, so that the filter on the result doesn't run it a second time
    found = F.pandas_udf(of, "array<struct<template string, first_word int, containment double>>").asNondeterministic()(F.col(text_col))
    return rest.withColumn("__found", found).where(F.size("__found") > 0).select(*rest.columns, F.explode("__found").alias("__one")).select(*rest.columns, *[F.col(f"__one.{n}").alias(n) for n in names])


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_documents(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "template", "first_word", "containment")
