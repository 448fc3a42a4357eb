"""License scans by conditional compression.

A block of text that follows a template compresses far better when the template is the compressor's raw
dictionary. All of a text is gone through in blocks: each is compressed with zstandard plainly and with all bodies
(templates of ``_BODY`` words and more) as one dictionary, and where that saves enough, with each body; those that
save what their own wording is worth are candidates, by size of the saving, and are confirmed, or not, by their
exact wording differences from the block. No word of the text decides this.

Short notices save too little in any block to be told by it. They are looked for, all of them, in the lines with
license wording and the notices that these run on into.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from difflib import SequenceMatcher
from functools import lru_cache

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.shipping import ship

#: Public wordings of license notices.
TEMPLATES = {
    "MIT": [
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        "This project is licensed under the terms of the MIT license.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
    ],
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    ],
    "GPL-3.0": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ],
    "GPL-2.0": ["This work is licensed under the GNU General Public License, version 2."],
    "BSD-3-Clause": [
        "Licensed under the BSD 3-Clause License.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    ],
    "CC-BY-4.0": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "all-rights-reserved": ["All rights reserved."],
    "ISC": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."],
    "0BSD": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS."],
    "BSD-2-Clause": ["Licensed under the BSD 2-Clause License."],
    "Zlib": ["This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:"],
    "Unlicense": ["This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."],
    "BSL-1.0": ["Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:"],
    "WTFPL": ["Everyone is permitted to copy and distribute verbatim or modified copies of this license document, and changing it is allowed as long as the name is changed."],
    "LGPL-3.0": ["This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."],
    "LGPL-2.1": ["This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."],
    "AGPL-3.0": ["This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."],
    "EPL-2.0": ["This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/"],
    "CC0-1.0": ["To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."],
    "PostgreSQL": ["Permission to use, copy, modify, and distribute this software and its documentation for any purpose, without fee, and without a written agreement is hereby granted, provided that the above copyright notice and this paragraph and the following two paragraphs appear in all copies."],
}

#: A line with one of these may begin or hold a notice.
HINT = r"(?i)licen[sc]|copyright|rights reserved|creative commons|\bCC BY|free of charge|redistribut|public domain|free software|SPDX"
_HINT = re.compile(HINT)
_WORD = re.compile(r"[\w.+-]*\w")
#: Words that make a template a body, told by compression alone, and the part of a body's own compressed size that
#: its dictionary must save to make it a candidate.
_BODY, _WORTH = 20, 0.3
#: Blocks are cut where they are longer; neighbouring ones overlap by the longest template.
_BLOCK, _OVERLAP = 4000, 1000


@dataclass(frozen=True)
class Found:
    license: str
    start: int
    end: int
    saved: float
    differences: int


def _compressor(raw: str = "") -> zstandard.ZstdCompressor:
    d = zstandard.ZstdCompressionDict(raw.lower().encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT) if raw else None
    return zstandard.ZstdCompressor(level=3, dict_data=d, write_checksum=False, write_content_size=False)


@lru_cache(maxsize=1)
def _templates():
    """(templates, the plain compressor): (name, text, words, compressor, worth) each, worth in bytes."""
    out, plain = [], _compressor()
    for name, texts in TEMPLATES.items():
        for t in texts:
            out.append((name, t, [w.lower() for w in _WORD.findall(t)], _compressor(t), _WORTH * len(plain.compress(t.lower().encode()))))
    return out, plain


@lru_cache(maxsize=1)
def _bodies():
    """(numbers of the bodies, the compressor with all of them, the least worth)."""
    templates = _templates()[0]
    numbers = [i for i, t in enumerate(templates) if len(t[2]) >= _BODY]
    return numbers, _compressor("\n".join(templates[i][1] for i in numbers)), min(templates[i][4] for i in numbers)


def candidates(block: str) -> list[int]:
    """Bodies whose dictionary saves their worth on the block, the largest saving first."""
    (templates, plain), (numbers, joint, least) = _templates(), _bodies()
    raw = block.lower().encode()
    size = len(plain.compress(raw))
    if size - len(joint.compress(raw)) < least:
        return []
    saved = [(size - len(templates[i][3].compress(raw)), i) for i in numbers]
    return [i for n, i in sorted(saved, key=lambda x: (-x[0], x[1])) if n >= templates[i][4]]


def blocks(text: str) -> list[tuple[int, str]]:
    """(start, block): each run of lines that begins at a line with license wording and goes on over lines
    with wording, or over the next lines of a notice wrapped over several; long ones in overlapping parts."""
    out, at, open_, since = [], 0, None, 0
    for line in text.split("\n"):
        hint, end = bool(_HINT.search(line)), at + len(line)
        if hint:
            open_, since = (at if open_ is None else open_), 0
            last = end
        elif open_ is not None:
            since += 1
            if since > 8 or not line.strip():
                out.append((open_, text[open_:last]))
                open_ = None
            elif len(line) <= 100:
                last = end
        at = end + 1
    if open_ is not None:
        out.append((open_, text[open_:last]))
    parts = []
    for start, b in out:
        for i in range(0, max(1, len(b) - _OVERLAP), _BLOCK - _OVERLAP):
            parts.append((start + i, b[i : i + _BLOCK]))
    return parts


def ranked(block: str, numbers: list[int]) -> list[tuple[float, int]]:
    """(part of the block's bytes saved, template number), best first."""
    templates, plain = _templates()
    raw = block.lower().encode()
    size = len(plain.compress(raw))
    saved = [((size - len(templates[i][3].compress(raw))) / size, i) for i in numbers]
    return sorted(saved, key=lambda x: (-x[0], x[1]))


def confirm(block: str, template: int, tolerance: float = 0.1) -> list[tuple[int, int, int]]:
    """(start, end, differences) of the places where the block holds the template's words, with at most the
    part ``tolerance`` of them inserted, deleted or replaced; numbers and license names must agree."""
    words = _templates()[0][template][2]
    tokens = [(m.start(), m.end(), m[0].lower()) for m in _WORD.finditer(block)]
    n, out, i = len(words), [], 0
    allowed = int(tolerance * n)
    all_, opening = set(words), set(words[: allowed + 1])
    firm = {w for w in words if any(c.isdigit() for c in w) or w in _NAMES}
    while i + n - allowed <= len(tokens):
        if tokens[i][2] not in opening:
            i += 1
            continue
        best = None
        for size in range(max(1, n - allowed), n + allowed + 1):
            part = [t[2] for t in tokens[i : i + size]]
            if len(part) < size:
                break
            if part == words:
                d = 0
            elif allowed == 0 or not firm <= (held := set(part)) or len(all_ - held) > allowed:
                continue  # each word that isn't there at all is a difference
            else:
                d = sum(max(b - a, y - x) for op, a, b, x, y in SequenceMatcher(None, words, part, autojunk=False).get_opcodes() if op != "equal")
            if d <= allowed and (best is None or d < best[0]):
                best = (d, size)
        if best:
            out.append((tokens[i][0], tokens[i + best[1] - 1][1], best[0]))
            i += best[1]
        else:
            i += 1
    return out


_NAMES = {"lesser", "affero", "mozilla", "eclipse", "mit", "apache", "gnu", "bsd", "cc", "by", "by-nc", "by-sa", "attribution", "attribution-sharealike", "attribution-noncommercial"}


def scan(text: str, tolerance: float = 0.1) -> tuple[int, list[Found]]:
    """(blocks with license wording or a candidate, confirmed licenses by place)."""
    found, templates = {}, _templates()[0]
    short = [i for i, t in enumerate(templates) if len(t[2]) < _BODY]

    def hold(at: int, piece: str, numbers: list[int]) -> None:
        for saved, i in ranked(piece, numbers):
            for a, b, d in confirm(piece, i, tolerance):
                f = Found(templates[i][0], at + a, at + b, round(saved, 6), d)
                old = found.get((f.start, f.license))
                if old is None or (-f.end, f.differences) < (-old.end, old.differences):
                    found[f.start, f.license] = f

    n = 0
    for at in range(0, max(1, len(text) - _OVERLAP), _BLOCK - _OVERLAP):
        piece = text[at : at + _BLOCK]
        if numbers := candidates(piece):
            n += 1
            hold(at, piece, numbers)
    parts = blocks(text)
    for start, block in parts:
        hold(start, block, short)
    n += len(parts)
    # Of overlapping finds the longer stays, then the one with fewer differences.
    kept = []
    for f in sorted(found.values(), key=lambda f: (f.differences - 2 * (f.end - f.start), f.start, f.license)):
        if all(f.end <= g.start or g.end <= f.start for g in kept):
            kept.append(f)
    return n, sorted(kept, key=lambda f: f.start)


def scan_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tolerance: float = 0.1) -> DataFrame:
    """(id_col, n_blocks, licenses, finds) per row of docs: the distinct licenses in code-point order,
    comma-joined ('' if none), and array<struct<license, start, end, saved, differences>> by place.

    Null text counts as empty: no blocks. Texts are read whole, whatever their length. Rows
    repeat as they do in docs; other columns are not read; an empty table gives an empty result.
    """
    find = pa.struct([("license", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("saved", pa.float64()), ("differences", pa.int64())])

    def run(batches):
        for b in batches:
            n, names, finds = [], [], []
            for t in b.column(1).to_pylist():
                k, found = scan(t, tolerance) if t else (0, [])
                n.append(k)
                names.append(",".join(sorted({f.license for f in found})))
                finds.append([f.__dict__ for f in found])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(names, pa.string()), pa.array(finds, pa.list_(find))], names=["id", "n_blocks", "licenses", "finds"])

    ship(docs.sparkSession)
    text = F.col(text_col).cast("string")
    picked = docs.select(F.col(id_col).alias("id"), text.alias("text"))
    kind = picked.schema["id"].dataType.simpleString()
    out = picked.mapInArrow(run, f"id {kind}, n_blocks long, licenses string, finds array<struct<license:string,start:bigint,end:bigint,saved:double,differences:bigint>>")
    return out.withColumnRenamed("id", id_col)
