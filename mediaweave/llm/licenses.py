"""License scans: MinHash bands over overlapping text windows find templates, shingle containment verifies them.

Every template is covered by windows of ``WINDOW`` words at steps of half a window; a shorter template is one
window.  Texts are covered by windows of the same lengths, one beginning at every word.  Windows whose
minhashes agree in a band name a candidate; a candidate counts if the text window holds at least
``PERCENT`` of the distinct ``SHINGLE``-word shingles of the template window.  The bands are as many as it takes for
two windows at the wanted containment to collide with a chance of 1 - ``MISS``.  Stretches of text without any
shingle of a template cannot collide and are passed over.

The templates are a parameter, a list of (license, text); their number of words is bounded by ``MAX_WORDS``
per pass, and longer lists are taken in several passes over the texts.

Defined results: null and empty texts match nothing; an empty list of templates matches nothing; repeated rows and
repeated ids are scanned row by row; a null id stays null; equal templates under several names all match.  Other
columns are ignored.
"""

from __future__ import annotations

import math
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mediaweave.llm import notices

WINDOW = 24
SHINGLE = 3
PERCENT = 80
MISS = 1e-6
MAX_WORDS = 200_000

# Short public notices that name a license; fixed values.
TEMPLATES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0'),
    ("MIT", "Released under the MIT License."),
    ("MIT", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction'),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-2.0-or-later", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("GPL-3.0-or-later", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("LGPL-2.1", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("All-rights-reserved", "All rights reserved."),
]


def n_bands(percent: int = PERCENT, miss: float = MISS) -> int:
    """Bands of one minhash that leave a window at the wanted containment unfound with a chance of ``miss`` only.

    Windows of equal length with ``percent`` of the template's shingles have at least this Jaccard similarity."""
    c = percent / 100
    similarity = c / (2 - c)
    return math.ceil(math.log(miss) / math.log(1 - similarity)) if similarity < 1 else 1


def _passes(templates: list[tuple[str, str]], max_words: int):
    """Templates in passes of a bounded number of words."""
    held, size = [], 0
    for i, (name, text) in enumerate(templates):
        words = notices.matching.normal_words(text.encode())
        if held and size + len(words) > max_words:
            yield held
            held, size = [], 0
        held.append((i, name, words))
        size += len(words)
    if held:
        yield held


def license_matches(
    docs: DataFrame,
    templates: list[tuple[str, str]] = TEMPLATES,
    percent: int = PERCENT,
    window: int = WINDOW,
    max_words: int = MAX_WORDS,
) -> DataFrame:
    """Templates found: doc_id, license, template (its number), windows_found, containment (of the best window),
    first_word and past_word, a row for every occurrence.  An occurrence counts if half of the template's windows or
    more are found in it; a text shorter than a window is compared as one."""
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id"), F.col("text").cast("string").alias("text"))
    kind = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, license string, template long, windows_found long, containment double, first_word long, past_word long"

    def scan(part):
        made = notices.Templates([(name, words) for _, name, words in part], window, SHINGLE, n_bands(percent))
        numbers = [i for i, _, _ in part]
        shared = spark.sparkContext.broadcast(made)

        def run(batches):
            for batch in batches:
                at, found = [], []
                for i, text in enumerate(batch.column(1).cast(pa.binary())):
                    for match in shared.value.find(text.as_py(), percent):
                        at.append(i)
                        found.append(match)
                columns = [
                    batch.column(0).take(pa.array(at, pa.int64())),
                    pa.array([shared.value.names[f[0]] for f in found], pa.string()),
                    pa.array([numbers[f[0]] for f in found], pa.int64()),
                    *(pa.array([f[j] for f in found], t) for j, t in ((1, pa.int64()), (2, pa.float64()), (3, pa.int64()), (4, pa.int64()))),
                ]
                names = ["doc_id", "license", "template", "windows_found", "containment", "first_word", "past_word"]
                yield pa.RecordBatch.from_arrays(columns, names=names)

        return rows.mapInArrow(run, kind)

    parts = [scan(part) for part in _passes(templates, max_words)]
    return reduce(DataFrame.unionByName, parts) if parts else spark.createDataFrame([], kind)
