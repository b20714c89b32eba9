"""Licence scan by sentences: normalised sentences become identifiers, ordered rules read the sequence of identifiers."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from wardbook.llm.support import table

# Sentences of licences and of their usual notices, normalised (``normalised``).
SENTENCES = {
    "apache-terms": "licensed under the apache license version 2 0 the license",
    "not-except": "you may not use this file except in compliance with the license",
    "apache-copy": "you may obtain a copy of the license at",
    "apache-asis": "unless required by applicable law or agreed to in writing software distributed under the license is"
    " distributed on an as is basis without warranties or conditions of any kind either express or implied",
    "apache-see": "see the license for the specific language governing permissions and limitations under the license",
    "mit-title": "the mit license mit",
    "mit-title-the": "the mit license",
    "mit-title-short": "mit license",
    "mit-grant": "permission is hereby granted free of charge to any person obtaining a copy of this software and"
    " associated documentation files the software to deal in the software without restriction including without"
    " limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software"
    " and to permit persons to whom the software is furnished to do so subject to the following conditions",
    "mit-keep": "the above copyright notice and this permission notice shall be included in all copies or substantial"
    " portions of the software",
    "mit-asis": "the software is provided as is without warranty of any kind express or implied including but not"
    " limited to the warranties of merchantability fitness for a particular purpose and noninfringement",
    "mit-event": "in no event shall the authors or copyright holders be liable for any claim damages or other liability"
    " whether in an action of contract tort or otherwise arising from out of or in connection with the software or the"
    " use or other dealings in the software",
    "gnu-program": "this program is free software",
    "gnu-library": "this library is free software",
    "gpl-redistribute": "you can redistribute it and or modify it under the terms of the gnu general public license as"
    " published by the free software foundation",
    "lgpl-redistribute": "you can redistribute it and or modify it under the terms of the gnu lesser general public license"
    " as published by the free software foundation",
    "agpl-redistribute": "you can redistribute it and or modify it under the terms of the gnu affero general public license"
    " as published by the free software foundation",
    "gpl-2-redistribute": "you can redistribute it and or modify it under the terms of the gnu general public license"
    " version 2 as published by the free software foundation",
    "version-2-later": "either version 2 of the license or at your option any later version",
    "version-2-1-later": "either version 2 1 of the license or at your option any later version",
    "version-3-later": "either version 3 of the license or at your option any later version",
    "gpl-hope": "this program is distributed in the hope that it will be useful but without any warranty",
    "lgpl-hope": "this library is distributed in the hope that it will be useful but without any warranty",
    "gnu-implied": "without even the implied warranty of merchantability or fitness for a particular purpose",
    "gpl-see": "see the gnu general public license for more details",
    "lgpl-see": "see the gnu lesser general public license for more details",
    "agpl-see": "see the gnu affero general public license for more details",
    "bsd-grant": "redistribution and use in source and binary forms with or without modification are permitted provided"
    " that the following conditions are met",
    "bsd-source": "redistributions of source code must retain the above copyright notice this list of conditions and the"
    " following disclaimer",
    "bsd-binary": "redistributions in binary form must reproduce the above copyright notice this list of conditions and"
    " the following disclaimer in the documentation and or other materials provided with the distribution",
    "bsd-names": "neither the name of the copyright holder nor the names of its contributors may be used to endorse or"
    " promote products derived from this software without specific prior written permission",
    "mpl-subject": "this source code form is subject to the terms of the mozilla public license v",
    "mpl-copy": "if a copy of the mpl was not distributed with this file you can obtain one at",
    "epl-terms": "this program and the accompanying materials are made available under the terms of the eclipse public"
    " license v",
    "epl-terms-2": "this program and the accompanying materials are made available under the terms of the eclipse public"
    " license 2 0 which is available at",
    "cddl-subject": "the contents of this file are subject to the terms of the common development and distribution"
    " license the license",
    "boost-see": "see accompanying file license 1 0 txt or copy at",
    "zlib-asis": "this software is provided as is without any express or implied warranty",
    "zlib-grant": "permission is granted to anyone to use this software for any purpose including commercial"
    " applications and to alter it and redistribute it freely subject to the following restrictions",
    "isc-grant": "permission to use copy modify and or distribute this software for any purpose with or without fee is"
    " hereby granted provided that the above copyright notice and this permission notice appear in all copies",
    "isc-grant-and": "permission to use copy modify and distribute this software for any purpose with or without fee is"
    " hereby granted provided that the above copyright notice and this permission notice appear in all copies",
    "unlicense": "this is free and unencumbered software released into the public domain",
}

# Families of the GNU licences and their versions.
GNU = {"GPL": ("general", ["2", "3"]), "LGPL": ("lesser general", ["2 1", "3"]), "AGPL": ("affero general", ["3"])}

# Names of licences in notices, normalised, without a last "license".
NAMES = {
    "MIT": ["mit", "expat", "mit expat"],
    "Apache-2.0": ["apache license version 2 0", "apache license 2 0", "apache 2 0", "apache license v2 0", "apache version 2 0"],
    "BSD-2-Clause": ["bsd 2 clause", "2 clause bsd", "simplified bsd", "freebsd"],
    "BSD-3-Clause": ["bsd 3 clause", "3 clause bsd", "new bsd", "modified bsd", "revised bsd"],
    "MPL-2.0": ["mozilla public license 2 0", "mozilla public license version 2 0", "mozilla public license v2 0", "mpl 2 0"],
    "EPL-2.0": ["eclipse public license 2 0", "eclipse public license version 2 0", "eclipse public license v2 0", "epl 2 0"],
    "CDDL-1.0": [
        "common development and distribution license 1 0", "common development and distribution license version 1 0", "cddl 1 0",
    ],
    "BSL-1.0": ["boost software license version 1 0", "boost software license 1 0", "bsl 1 0"],
    "Zlib": ["zlib", "zlib libpng"],
    "ISC": ["isc"],
    "Unlicense": ["unlicense"],
    "CC0-1.0": ["cc0 1 0", "cc0 1 0 universal", "creative commons zero 1 0", "creative commons cc0 1 0 universal"],
}
for _code, (_family, _versions) in GNU.items():
    for _version in _versions:
        _number = _version if " " in _version else f"{_version} 0"
        _spdx = f"{_code}-{_number.replace(' ', '.')}"
        _named = [
            *(f"gnu {_family} public license {v}" for v in (f"version {_version}", f"version {_number}", f"v{_version}", _number)),
            *(f"gnu {_code.lower()} {v}" for v in (f"version {_version}", f"v{_version}", _number)),
            *(f"{_code.lower()} {v}" for v in (f"version {_version}", f"v{_version}", _version, _number)),
            f"{_code.lower()}v{_version}", f"gnu {_code.lower()}v{_version}",
        ]
        NAMES[f"{_spdx}-only"] = [*dict.fromkeys([*_named, *(f"{n} only" for n in _named)])]
        NAMES[f"{_spdx}-or-later"] = [*dict.fromkeys(f"{n}{end}" for n in _named for end in (" or later", " or any later version"))]

# Parts of the names of Creative Commons licences, and what their versions are called.
CC_PARTS = {"by": "attribution", "nc": "noncommercial", "nd": "noderivatives", "sa": "sharealike"}
CC_KINDS = ["by", "by-sa", "by-nc", "by-nc-sa", "by-nd", "by-nc-nd"]
CC_VERSIONS = {"4.0": "international", "3.0": "unported"}
ADDRESSES = {
    "Apache-2.0": ["www apache org licenses license 2 0"],
    "EPL-2.0": ["www eclipse org legal epl 2 0"],
    "BSL-1.0": ["www boost org license 1 0 txt"],
    "MPL-2.0": ["mozilla org mpl 2 0", "www mozilla org mpl 2 0"],
    "CC0-1.0": ["creativecommons org publicdomain zero 1 0"],
    "Unlicense": ["unlicense org"],
}
for _kind in CC_KINDS:
    for _version, _called in CC_VERSIONS.items():
        _number, _words = _version.replace(".", " "), " ".join(CC_PARTS[p] for p in _kind.split("-"))
        _short = _kind.replace("-", " ")
        NAMES[f"CC-{_kind.upper()}-{_version}"] = [
            f"cc {_short} {_number}", f"creative commons {_short} {_number}", f"creative commons {_words} {_number}",
            f"creative commons {_words} {_number} {_called}", f"creative commons {_words} license {_number}",
        ]
        ADDRESSES[f"CC-{_kind.upper()}-{_version}"] = [f"creativecommons org licenses {_short} {_number}"]

# What a notice calls the work, and what is done with it.
SUBJECTS = (
    "this work|this software|this project|this program|this file|this code|this library|this document|this package|this page|"
    "this text|this article|this material|this content|the code|the software|the source code|the text|content|source code"
)
DONE = "licensed|released|distributed|available|made available|provided|published|covered|licenced"

RULES = [
    ("Apache-2.0", ["apache-terms", "not-except", "apache-copy", "at Apache-2.0", "apache-asis", "apache-see"]),
    ("Apache-2.0", ["not-except", "apache-copy", "at Apache-2.0", "apache-asis", "apache-see"]),
    ("Apache-2.0", ["apache-copy", "at Apache-2.0", "apache-asis", "apache-see"]),
    ("Apache-2.0", ["apache-terms", "not-except"]),
    ("BSD-3-Clause", ["bsd-grant", "bsd-source", "bsd-binary", "bsd-names"]),
    ("BSD-2-Clause", ["bsd-grant", "bsd-source", "bsd-binary"]),
    *(
        ("MIT", [*title, "mit-grant", "mit-keep", *end])
        for title in (["mit-title"], ["mit-title-the"], ["mit-title-short"], [])
        for end in (["mit-asis", "mit-event"], ["mit-asis"], [])
    ),
    *(
        (licence, [*work, *terms, *hope, *see])
        for licence, terms, said in (
            ("GPL-2.0-or-later", ["gpl-redistribute", "version-2-later"], "gpl-see"),
            ("GPL-3.0-or-later", ["gpl-redistribute", "version-3-later"], "gpl-see"),
            ("LGPL-2.1-or-later", ["lgpl-redistribute", "version-2-1-later"], "lgpl-see"),
            ("LGPL-3.0-or-later", ["lgpl-redistribute", "version-3-later"], "lgpl-see"),
            ("AGPL-3.0-or-later", ["agpl-redistribute", "version-3-later"], "agpl-see"),
            ("GPL-2.0-only", ["gpl-2-redistribute"], "gpl-see"),
        )
        for work in (["gnu-program"], ["gnu-library"], [])
        for hope, see in (
            (["gpl-hope", "gnu-implied"], [said]),
            (["lgpl-hope", "gnu-implied"], [said]),
            ([], []),
        )
    ),
    ("EPL-2.0", ["epl-terms-2", "at EPL-2.0"]),
    ("EPL-2.0", ["epl-terms", "at EPL-2.0"]),
    ("MPL-2.0", ["mpl-subject", "mpl-copy", "at MPL-2.0"]),
    ("CDDL-1.0", ["cddl-subject", "not-except"]),
    ("BSL-1.0", ["is BSL-1.0", "boost-see", "at BSL-1.0"]),
    ("Zlib", ["zlib-asis", "zlib-grant"]),
    ("Apache-2.0", ["apache-terms"]),
    ("MIT", ["mit-grant"]),
    ("MIT", ["mit-title"]),
    ("MPL-2.0", ["mpl-subject"]),
    ("CDDL-1.0", ["cddl-subject"]),
    ("Zlib", ["zlib-grant"]),
    ("ISC", ["isc-grant"]),
    ("ISC", ["isc-grant-and"]),
    ("Unlicense", ["unlicense"]),
    *((licence, [f"is {licence}"]) for licence in NAMES),
    *((licence, [f"at {licence}"]) for licence in ADDRESSES),
]
"""Licences and their sequences of identifiers, in the order in which they are tried."""

MARK = r"(^|\n)[ \t]*(?:/\*+|\*+/|\*+|//+|#+|--+|%+|<!--|-->|;+|(?:rem|dnl|\.\.)[ \t])"
"""What comments begin their lines with."""
PARAGRAPH = r"\n[ \t\r]*\n[ \t\r\n]*"
STOP = r"[.!?;]+(?:[ \t\r\n]+|$)|:[ \t\r]*\n"
HOLDER = " of(?s:.){1,120}?nor the names of (?:its|any|the) contributors".join(["neither the name", ""]).replace(" ", r"[ \t\r\n]+")
"""The clause that names a copyright holder, who may be anybody."""
NAMELESS = "neither the name of the copyright holder nor the names of its contributors"
NOTICE = (
    rf"^(?:spdx license identifier|(?:(?:{SUBJECTS}) (?:is |are )?)?(?:{DONE}) under (?:the terms of )?(?:the |an |a )?)"
    r" ?(.+?)(?: licen[sc]e)?$"
)
"""A notice and, as its group, the name of its licence."""
TRIGGERS = (
    "licen", "permission", "software", "redistribut", "warrant", "copyright", "creativecommons", "mozilla", "neither", "spdx",
    "under", "distributed", "eclipse",
)
"""Each known sentence and notice holds one of these, so texts without any are not looked at."""

OPENING = 5
"""Words that a known sentence is told by where no stop stands before it; it has two more at least."""
OPENINGS = " (" + "|".join(
    sorted({" ".join(t.split()[:OPENING]) for t in SENTENCES.values() if t.count(" ") > OPENING and "licensed" not in t} | {"http"})
) + r")\b"

_MARK, _PARAGRAPH, _STOP, _HOLDER = (re.compile(p.replace("$", r"\Z")) for p in (MARK, PARAGRAPH, STOP, HOLDER))
_NOTICE, _OPENINGS, _NOISE, _LATIN = (re.compile(p) for p in (NOTICE, OPENINGS, "[^a-z0-9]+", "[a-z0-9]"))
_BY_NAME = {name: licence for licence, names in NAMES.items() for name in names}
_BY_NAME |= {licence.lower().replace("-", " ").replace(".", " "): licence for licence in NAMES}
_BY_ADDRESS = {f"http {address}": licence for licence, some in ADDRESSES.items() for address in some}


def normalised(sentence: str) -> str:
    """Letters and digits in lower case with one space between words, and a scheme as ``http``."""
    return _NOISE.sub(" ", sentence.replace("https://", "http://")).strip()


def pieces(sentence: str) -> list[str]:
    """A normalised sentence, cut where a known sentence or an address opens within it."""
    return _OPENINGS.sub(r"|\1", sentence).split("|")


_BY_TEXT: dict[str, str] = {}
_PIECES: dict[str, list[str]] = {}
for _name, _text in SENTENCES.items():
    # What a known sentence is cut into, as any other is: its first piece has its name, others names of their own.
    _PIECES[_name] = [
        _BY_TEXT.setdefault(piece, _name if n == 0 and _name not in _BY_TEXT.values() else f"{_name}-{n + 1}")
        for n, piece in enumerate(pieces(_text))
    ]
# A list of conditions may begin on the same line, with its number.
_BY_TEXT |= {f"{t} 1": name for t, name in _BY_TEXT.items() if t.split()[-1] in {"met", "conditions", "restrictions"}}


def identifier(piece: str) -> str | None:
    """The identifier of a known piece of a sentence, notice or address."""
    known = _BY_TEXT.get(piece)
    if known is None and piece in _BY_ADDRESS:
        return f"at {_BY_ADDRESS[piece]}"
    if known is None and (found := _NOTICE.match(piece)):
        licence = _BY_NAME.get(found[1])
        return f"is {licence}" if licence else None
    return known


def identifiers(text: str) -> tuple[int, list[str]]:
    """Sentences of a text, and the identifiers of its known ones in order.

    Paragraphs are read twice: by sentences, however they are wrapped, and by lines. The reading that
    knows more counts, the first of the two where they know as many.
    """
    text = _HOLDER.sub(NAMELESS, _MARK.sub(r"\1", text.encode().lower().decode()))
    asked = any(t in text for t in TRIGGERS)
    count, out = 0, []
    for paragraph in _PARAGRAPH.split(text):
        sentences = _STOP.split(paragraph)
        count += sum(_LATIN.search(s) is not None for s in sentences)
        if asked and any(t in paragraph for t in TRIGGERS):
            prose, lines = (
                [i for s in some for piece in pieces(normalised(s)) if (i := identifier(piece)) is not None]
                for some in (sentences, paragraph.split("\n"))
            )
            out += lines if len(lines) > len(prose) else prose
    return count, out


def marks(ids: list[str]) -> str:
    return "".join(f"<{i}>" for i in ids)


_STEPS = [(licence, marks([p for i in ids for p in _PIECES.get(i, [i])])) for licence, ids in RULES]


def ruled(ids: list[str]) -> tuple[str, str]:
    """Licences whose rules match a sequence of identifiers, sorted, and the identifiers that no rule took."""
    rest, names = marks(ids), set()
    for licence, sequence in _STEPS if ids else []:
        if sequence in rest:
            names.add(licence)
            rest = rest.replace(sequence, "|")
    return ",".join(sorted(names)), rest.replace("|", "")


def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        found = [identifiers(text or "") for text in batch["text"]]
        rules = [ruled(ids) for _, ids in found]
        yield pd.DataFrame(
            {
                "doc_id": batch["doc_id"].astype("Int64"),
                "n_sentences": [n for n, _ in found],
                "sentence_ids": [marks(ids) for _, ids in found],
                "licences": [names for names, _ in rules],
                "unruled": [rest for _, rest in rules],
            }
        )


def licences(docs: DataFrame) -> DataFrame:
    """``doc_id, n_sentences, sentence_ids, licences, unruled`` for every row.

    Comment marks at the start of lines go. Blank lines part paragraphs; stops and semicolons before white space and colons at a
    line's end part sentences (``n_sentences`` counts those with a Latin letter or digit). Where the opening words of a known
    sentence or an address stand within a sentence, it is cut before them. A piece is known if, normalised, it is in
    ``SENTENCES``, is a notice ("this work is licensed under ...", an SPDX line) with a licence
    of ``NAMES``, or an address of ``ADDRESSES``; a line is known in the same way, see ``identifiers``. ``sentence_ids`` are
    the known ones in order, as ``<id>``. Rules are tried in their order; what a rule matches, in consecutive known
    sentences and wherever it occurs, is taken out before the next one. ``licences`` lists the licences of the rules that
    matched, sorted, each once; ``unruled`` are known sentences that no rule took. A null or empty text has none; rows
    are independent of each other, and other columns are not read. Texts are read whole, in time in proportion to
    their length.
    """
    schema = "doc_id long, n_sentences long, sentence_ids string, licences string, unruled string"
    return docs.select("doc_id", "text").mapInPandas(scan, schema)


def op6_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences(table(spark, sf_dir, "documents"))


def _values(pairs: list[tuple[str, str]]) -> str:
    return ", ".join(f"('{a}', '{b}')" for a, b in pairs)


def _sql() -> str:
    """The same in DuckDB's SQL; the chain of rules is one common table expression for each step."""
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    known = [(text, name) for text, name in _BY_TEXT.items()]
    named = [(name, f"is {licence}") for name, licence in _BY_NAME.items()]
    found = [(address, f"at {licence}") for address, licence in _BY_ADDRESS.items()]
    steps, last = [], "marked"
    for n, (licence, sequence) in enumerate(_STEPS):
        steps.append(
            f"s{n} as materialized (select doc_id, n_sentences, sentence_ids, replace(rest, '{sequence}', '|') as rest, "
            f"case when contains(rest, '{sequence}') then list_append(names, '{licence}') else names end as names from {last})"
        )
        last = f"s{n}"
    return f"""
with known(sentence, id) as (values {_values(known + found)}),
named(name, id) as (values {_values(named)}),
texts as (
    select row_number() over () as row, doc_id,
           regexp_replace(regexp_replace(translate(coalesce(text, ''), '{letters}', '{letters.lower()}'), '{MARK}', '\\1', 'g'),
                          '{HOLDER}', '{NAMELESS}', 'g') as text
    from documents
), paragraphs as (
    select row, p, parts[p] as paragraph
    from (select row, parts, unnest(range(1, len(parts) + 1)) as p
          from (select row, regexp_split_to_array(text, '{PARAGRAPH}') as parts from texts))
), readings as (
    select row, p, 1 as reading, regexp_split_to_array(paragraph, '{STOP}') as parts from paragraphs
    union all select row, p, 2, string_split(paragraph, chr(10)) from paragraphs
), sentences as (
    select row, p, reading, k,
           trim(regexp_replace(replace(parts[k], 'https://', 'http://'), '[^a-z0-9]+', ' ', 'g')) as sentence
    from (select row, p, reading, parts, unnest(range(1, len(parts) + 1)) as k from readings)
), pieces as (
    select row, p, reading, k, n, cuts[n] as piece
    from (select row, p, reading, k, cuts, unnest(range(1, len(cuts) + 1)) as n
          from (select row, p, reading, k, string_split(regexp_replace(sentence, '{OPENINGS}', '|\\1', 'g'), '|') as cuts
                from sentences))
), looked as (
    select s.row, s.p, s.reading, s.k, s.n, coalesce(a.id, b.id) as id
    from pieces s
    left join known a on a.sentence = s.piece
    left join named b on b.name = regexp_extract(s.piece, '{NOTICE}', 1)
), counted as (
    select row, p, reading, count(id) as hits from looked group by all
), chosen as (
    select row, p, case when max(hits) filter (reading = 2) > max(hits) filter (reading = 1) then 2 else 1 end as reading
    from counted group by row, p
), sequences as (
    select l.row, string_agg('<' || l.id || '>', '' order by l.p, l.k, l.n) as ids
    from looked l join chosen c on c.row = l.row and c.p = l.p and c.reading = l.reading
    where l.id is not null group by l.row
), sizes as (
    select row, count(*) as n_sentences from sentences where reading = 1 and sentence <> '' group by row
), marked as (
    select t.doc_id, coalesce(z.n_sentences, 0)::bigint as n_sentences, coalesce(q.ids, '') as sentence_ids,
           coalesce(q.ids, '') as rest, []::varchar[] as names
    from texts t left join sequences q on q.row = t.row left join sizes z on z.row = t.row
), {", ".join(steps)}
select doc_id, n_sentences, sentence_ids,
       coalesce(list_aggregate(list_sort(list_distinct(names)), 'string_agg', ','), '') as licences,
       replace(rest, '|', '') as unruled
from {last}
"""


SQL = _sql()
