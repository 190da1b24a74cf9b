"""Sentence-rule licence recognition.

Texts are split at line ends, and at . ! ? ; : before white space; the pieces are normalised (lower case, every run of
other than letters and digits one space). A known sentence is one piece or several in a row, so it may be wrapped and
may hold such marks itself; from left to right the longest counts. Known sentences become identifiers. A licence is
recognised where its rule, an ordered sequence of identifiers, occurs in the sequence of a text's known sentences;
unknown sentences between them are passed over, as headers and comment marks are.

Defined cases: null and empty texts give no rows; a licence found twice in a text is one row with its count; rules of
which one contains another all count, and ``is_longest`` marks those whose sequence no other found rule of the text
contains; rows that repeat a doc_id are scanned each by itself and give rows each, as do those with a null doc_id;
a sentence counts once, in the longest known one that begins there, so of two with the same beginning the longer wins;
a very long text is one pass over its pieces; an empty table gives no rows; other columns, whatever their names, are
ignored.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame

from fleetweave.llm._spark import Batches, tidy

#: identifier: normalised sentence. Identifiers are two letters or more and digits, so that a sequence is a plain string.
SENTENCES = {
    "mit01": "released under the mit license",
    "mit02": "this project is licensed under the mit license",
    "mit03": "licensed under the mit license",
    "mit04": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions",
    "mit05": "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
    "asis1": "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement",
    "apa01": "licensed under the apache license version 2 0",
    "apa02": "licensed under the apache license version 2 0 the license",
    "apa03": "you may not use this file except in compliance with the license",
    "apa04": "you may obtain a copy of the license at",
    "gpl01": "this work is licensed under the gnu general public license version 3",
    "gpl02": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "gpl03": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version",
    "gpl04": "this work is licensed under the gnu general public license version 2",
    "nowar": "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose",
    "lgpl1": "this work is licensed under the gnu lesser general public license version 3",
    "agpl1": "this work is licensed under the gnu affero general public license version 3",
    "ccn01": "licensed under cc by nc 4 0",
    "ccb01": "licensed under cc by 4 0",
    "ccs01": "licensed under cc by sa 4 0",
    "cc001": "licensed under cc0 1 0",
    "bsd01": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "bsd02": "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
    "bsd03": "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
    "bsd04": "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    "mpl01": "this source code form is subject to the terms of the mozilla public license v 2 0",
    "isc01": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
    "unl01": "this is free and unencumbered software released into the public domain",
    "arr01": "all rights reserved",
}

#: licence: ordered rules, each a sequence of identifiers
RULES = {
    "MIT": (("mit01",), ("mit02",), ("mit03",), ("mit04", "mit05", "asis1"), ("mit04", "mit05")),
    "Apache-2.0": (("apa01",), ("apa02", "apa03", "apa04"), ("apa02", "apa03")),
    "GPL-3.0": (("gpl01",), ("gpl02", "nowar"), ("gpl02",)),
    "GPL-2.0": (("gpl04",), ("gpl03", "nowar"), ("gpl03",)),
    "LGPL-3.0": (("lgpl1",),),
    "AGPL-3.0": (("agpl1",),),
    "CC-BY-NC-4.0": (("ccn01",),),
    "CC-BY-4.0": (("ccb01",),),
    "CC-BY-SA-4.0": (("ccs01",),),
    "CC0-1.0": (("cc001",),),
    "BSD-3-Clause": (("bsd01", "bsd02", "bsd03", "bsd04"),),
    "BSD-2-Clause": (("bsd01", "bsd02", "bsd03"),),
    "MPL-2.0": (("mpl01",),),
    "ISC": (("isc01",),),
    "Unlicense": (("unl01",),),
    "Proprietary": (("arr01",),),
}

_SPLIT, _OTHER = re.compile(r"[\n\r]+|[.!?;:]+(?=[ \t\n\x0b\f\r]|$)"), re.compile(r"[\W_]+")


def rule_rows(rules=None) -> list[tuple[str, int, str]]:
    """(licence, rule number, sequence) with the sequence as ",id,id,"."""
    return [(name, k, "," + ",".join(r) + ",") for name, seqs in (RULES if rules is None else rules).items() for k, r in enumerate(seqs)]


def normal(text: str) -> str:
    return _OTHER.sub(" ", text.lower()).strip()


def said_in(text: str, known: dict[str, str], begins: set[str]) -> list[tuple[int, str]]:
    """(number of its first piece, identifier) of each known sentence; ``begins`` holds their first words, of any number."""
    pieces = [(k, s) for k, p in enumerate(_SPLIT.split(text)) if (s := normal(p))]
    out, i = [], 0
    while i < len(pieces):
        s, j, end = pieces[i][1], i + 1, 0
        while s in begins:
            if s in known:
                sid, end = known[s], j
            if j == len(pieces):
                break
            s, j = f"{s} {pieces[j][1]}", j + 1
        if end:
            out.append((pieces[i][0], sid))
        i = end or i + 1
    return out


def beginnings(known: dict[str, str]) -> set[str]:
    """The known sentences' first words, of any number."""
    return {" ".join(w[:n]) for w in map(str.split, known) for n in range(1, len(w) + 1)}


def rules_in(said: list[str], rules: list[tuple[str, int, str]]) -> list[tuple[str, int, int, bool]]:
    """(licence, rule, number of places, whether no other rule found contains it) of a text's sentence identifiers."""
    # each identifier has its own commas, so that occurrences side by side don't share one
    twin = lambda ids: "".join(f",{x}," for x in ids)
    whole = twin(said)
    hits = [(name, k, n, own) for name, k, seq in rules if (n := whole.count(own := twin(seq.strip(",").split(","))))]
    return [(name, k, n, not any(own in o and own != o for *_, o in hits)) for name, k, n, own in hits]


SCHEMA = "doc_id long, license string, rule int, n_found long, is_longest boolean"


def recognise(docs: DataFrame, sentences=None, rules=None) -> DataFrame:
    """(doc_id, license, rule, n_found, is_longest) for each rule found in a row's text: one narrow pass, no exchange.

    Sentences and rules are catalogues given as parameters, not data; both go to all tasks.
    """
    known = {normal(v): k for k, v in (SENTENCES if sentences is None else sentences).items()}
    begins, rows = beginnings(known), rule_rows(rules)

    def run(batches: Batches) -> Batches:
        for b in batches:
            out = []
            for d, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if t and (said := [sid for _, sid in said_in(t, known, begins)]):
                    out += [(d, *x) for x in rules_in(said, rows)]
            cols = list(zip(*out)) or [()] * 5
            kinds = (pa.int64(), pa.string(), pa.int32(), pa.int64(), pa.bool_())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], ["doc_id", "license", "rule", "n_found", "is_longest"])

    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(tidy(run), SCHEMA)
