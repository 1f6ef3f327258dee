"""License scans: an exact set-similarity join of text blocks with license templates, beside fixed phrases.

A window is a run of words twice as long as a template, or what is left of it at the end of a text, and windows start at
every word. A window matches when it holds at least ``containment`` of the template's distinct tokens, all the words
that tell its license from others, and none that belong to another. Template tokens
are ordered by their number of documents in the whole corpus, rarest first; a match must hold one of the first
|T| - o + 1 (prefix filter, o the overlap needed), so only windows around those are looked at, and a text must have o
distinct tokens of the template (length filter). From one window to the next the counts of the template's tokens
change by a word at each end. The filters lose no match. Blocks are the windows at multiples of the template's length.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Phrases and their labels.
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}

#: Label, wording, words that a match must all hold, words of which it may hold none. Notices, not whole licenses: texts quote those.
TEMPLATES = [
    ("gpl", "this work is licensed under the gnu general public license version 3", "gnu general public", "lesser affero"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version", "gnu general public", "lesser affero library"),
    ("gpl", "free software you can redistribute it and or modify it under the terms of the gnu general public license", "gnu general public", "lesser affero"),
    ("lgpl", "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 2 1 of the license or at your option any later version", "gnu lesser general public", ""),
    ("agpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version", "gnu affero general public", ""),
    ("apache", "licensed under the apache license version 2 0", "apache license", ""),
    ("apache", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0", "apache license", ""),
    ("apache", "you may not use this file except in compliance with the license", "not use file except compliance license", ""),
    ("cc-by", "licensed under cc by 4 0", "cc by", "sa nc nd"),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license", "creative commons attribution", "sharealike noncommercial noderivatives noderivs"),
    ("cc-by-sa", "this work is licensed under a creative commons attribution sharealike 4 0 international license", "creative commons attribution sharealike", "noncommercial"),
    ("cc-by-nc", "this work is licensed under a creative commons attribution noncommercial 4 0 international license", "creative commons attribution noncommercial", ""),
    ("mit", "released under the mit license", "mit license", ""),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "permission granted person obtaining copy software", ""),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions", "permission granted merge sublicense sell copies", ""),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted", "redistribution source binary forms", ""),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer", "redistribution binary forms disclaimer", ""),
    ("bsd", "released under the bsd license", "bsd license", ""),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies", "permission granted purpose fee", ""),
    ("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at http mozilla org mpl 2 0", "mozilla public license", ""),
    ("epl", "this program and the accompanying materials are made available under the terms of the eclipse public license v 2 0", "eclipse public license", ""),
    ("unlicense", "this is free and unencumbered software released into the public domain", "unencumbered public domain", ""),
]

_GAPS = bytes(b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))


def words_of(text: str | None) -> list[bytes]:
    """Runs of digits, letters a-z and characters beyond ASCII, with A-Z lowered."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_GAPS).split()


class Templates:
    def __init__(self, templates: list[tuple[str, ...]], containment: float, frequency: dict[bytes, int]):
        """``templates``: label and wording, and optionally the words that a match must and may not hold."""
        self.rows = []
        for label, wording, *more in templates:
            words = words_of(wording)
            tokens = sorted(set(words), key=lambda w: (frequency.get(w, 0), w))
            need = max(1, math.ceil(containment * len(tokens) - 1e-9))
            must, never = (frozenset(words_of(x)) for x in [*more, "", ""][:2])
            self.rows.append((label, len(words), tokens, need, frozenset(tokens[: len(tokens) - need + 1]), must, never))
        self.rare = frozenset().union(*[r[4] for r in self.rows])

    def matches(self, words: list[bytes]) -> list[tuple[str, int, int, int, float]]:
        """(label, template length, first start, last start, containment) of runs of windows that match and hold equally much."""
        there = self.rare.intersection(words)
        found = []
        if not there:
            return found
        places: dict[bytes, list[int]] = {w: [] for w in there}
        for i, w in enumerate(words):
            if w in places:
                places[w].append(i)
        distinct = set(words)
        for label, m, tokens, need, prefix, must, never in self.rows:
            if not prefix & there or not must <= distinct or sum(w in distinct for w in tokens) < need:
                continue
            near: list[list[int]] = []
            for i in sorted(i for w in prefix & there for i in places[w]):
                if near and i - 2 * m <= near[-1][1]:
                    near[-1][1] = i
                else:
                    near.append([max(0, i - 2 * m + 1), i])
            owned = {w: ((w in tokens) * 1, (w in must) * 1, (w in never) * 1) for w in {*tokens, *must, *never}}
            for low, high in near:
                held, both, musts, nevers, end = dict.fromkeys(owned, 0), 0, 0, 0, low
                run, since = 0, low
                for s in range(low, high + 1):
                    for w in words[end : s + 2 * m]:
                        if w in held:
                            if not held[w]:
                                x, y, z = owned[w]
                                both, musts, nevers = both + x, musts + y, nevers + z
                            held[w] += 1
                    end = s + 2 * m
                    now = both if musts == len(must) and not nevers else 0
                    if now != run:
                        if run >= need:
                            found.append((label, m, since, s - 1, run / len(tokens)))
                        run, since = now, s
                    if words[s] in held:
                        held[words[s]] -= 1
                        if not held[words[s]]:
                            x, y, z = owned[words[s]]
                            both, musts, nevers = both - x, musts - y, nevers - z
                if run >= need:
                    found.append((label, m, since, high, run / len(tokens)))
        return found


def blocks_in(runs: list[tuple[str, int, int, int, float]]) -> list[tuple[str, int, float]]:
    """(label, first word, containment) of the windows of ``runs`` that start at multiples of the template's length."""
    return [(label, s, c) for label, m, first, last, c in runs for s in range(-(-first // m) * m, last + 1, m)]


def phrase_places(words: list[bytes], phrases: list[tuple[list[bytes], str]]) -> list[tuple[int, str]]:
    """(first word, label) of each place where a phrase's words stand one after another."""
    found = []
    for phrase, label in phrases:
        head, n, i = phrase[0], len(phrase), -1
        try:
            while True:
                i = words.index(head, i + 1)
                if words[i : i + n] == phrase:
                    found.append((i, label))
        except ValueError:
            pass
    return sorted(found)


def _frequencies(vocabulary: frozenset[bytes]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n: Counter = Counter()
        for batch in batches:
            for text in batch.column(0):
                n.update(vocabulary.intersection(words_of(text.as_py())))
        yield pa.RecordBatch.from_arrays([pa.array(list(n.keys()), pa.binary()), pa.array(list(n.values()), pa.int64())], ["word", "n"])

    return run


def _scan(templates: Templates, phrases: list[tuple[list[bytes], str]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "blocks", "windows"]
        kinds = [pa.int64()] * 5 + [pa.string(), pa.string(), pa.float64(), pa.list_(pa.struct([("label", pa.string()), ("first_word", pa.int64()), ("containment", pa.float64())])), pa.list_(pa.struct([("label", pa.string()), ("first_start", pa.int64()), ("last_start", pa.int64()), ("containment", pa.float64())]))]
        for batch in batches:
            rows = []
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                words = words_of(text.as_py())
                base, runs = phrase_places(words, phrases), templates.matches(words)
                own = sorted({x for _, x in base})
                score = 1.0 if base else max((x[4] for x in runs), default=0.0)
                labels = ",".join(sorted({*own, *(x[0] for x in runs)}))
                rows.append((i, len(words), len(base), base[0][0] if base else None, base[-1][0] if base else None, ",".join(own), labels, score, [dict(zip(("label", "first_word", "containment"), x)) for x in blocks_in(runs)], [{"label": x[0], "first_start": x[2], "last_start": x[3], "containment": x[4]} for x in runs]))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], names)

    return run


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: list[tuple[str, ...]] | None = None, phrases: dict[str, str] | None = None, containment: float = 0.8) -> DataFrame:
    """One row per row of ``docs``: id, n_words, n_base, first_word, last_word, base_labels, labels, score, blocks, windows.

    score is 1 where a phrase stands, else the largest containment of a matching window, else 0; windows lists the
    matching windows as runs of starts with equal containment, and blocks those at multiples of the template's length.
    Null and empty texts have no words and no labels. Repeated rows and null ids each get their row; other columns are
    ignored, whatever their names. No rows give no rows.
    """
    templates = TEMPLATES if templates is None else templates
    split = [(words_of(k), v) for k, v in (PHRASES if phrases is None else phrases).items()]
    vocabulary = frozenset(w for t in templates for w in words_of(t[1]))
    text = F.col(text_col).cast("string")
    # A row a template token at most.
    counts = docs.select(text.alias("t")).mapInArrow(_frequencies(vocabulary), "word binary, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()
    ready = Templates(templates, containment, {bytes(r["word"]): r["n"] for r in counts})
    out = docs.select(F.col(id_col).cast("long").alias("id"), text.alias("t")).mapInArrow(_scan(ready, split), "id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, blocks array<struct<label:string,first_word:long,containment:double>>, windows array<struct<label:string,first_start:long,last_start:long,containment:double>>")
    return out.withColumnRenamed("id", id_col)
