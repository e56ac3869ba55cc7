"""Operator 6: license scan by diagonal voting.

Hashes of all rolling word 3-grams of the documents are joined with the places
of the same 3-grams in license templates. A match votes for its diagonal, the
difference of the two places: a verbatim template is one diagonal with many
votes, an edit shifts to a neighbouring one. Votes are counted by (document,
template, diagonal), and each place of a document keeps its vote for the diagonal
with most votes (then the least). In the order of the text these votes are merged
to a span while the diagonal shifts by at most ``shift`` and the gap is at most
``gap`` words, both in proportion to the template: a seventh of its words and a
quarter, at least 3 and 12. A span is verified if the template words that its
3-grams cover are at least ``LEAST`` of the template.

Nulls: rows without an id or text take no part. Empty texts have no spans; very
long ones are scanned whole. Rows of one doc_id count as one document: repeated
rows give one set of spans. A template that occurs twice is two spans. Ties:
diagonals of equal votes go to the least. Empty tables give an empty result.
Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import INT, LONG, schema, texts
from .kernel import Chunk, chunks, ngrams

GRAM, LEAST = 3, 0.6

TEMPLATES = {
    "MIT-notice": "Released under the MIT License.",
    "MIT": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "Apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-header": """you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.""",
    "GPL-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-header": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.""",
    "CC-BY-NC-4.0-notice": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA-4.0-notice": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "CC-BY-4.0-notice": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "BSD-3-Clause": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.""",
    "ISC": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.""",
    "MPL-2.0-header": """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.""",
    "Unlicense": """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.""",
}


TEMPLATES |= {
    "LGPL-header": """This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version. This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details.""",
    "AGPL-header": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Affero General Public License for more details.""",
    "BSD-disclaimer": """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.""",
    "Zlib": """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution.""",
    "BSL-1.0": """Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following""",
    "CC0-notice": """To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.""",
    "WTFPL": """Everyone is permitted to copy and distribute verbatim or modified copies of this license document, and changing it is allowed as long as the name is changed.""",
}


def _chunk(text: str) -> Chunk:
    data = np.frombuffer(text.encode(), np.uint8)
    return Chunk(data, np.array([0, len(data)]), np.zeros(1))


def template_grams(templates: dict[str, str]) -> list[tuple[str, int, int, int]]:
    """(template, words, place, hash of the 3-gram there)."""
    out = []
    for name, text in templates.items():
        c = _chunk(text)
        out += [(name, len(c.h), i, int(x)) for i, x in enumerate(ngrams(c.h, GRAM).view(np.int64))]
    return out


def _grams(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in it:
        for c in chunks(b):
            g, at = c.grams(GRAM)
            doc = c.doc[at]
            yield pa.RecordBatch.from_arrays([pa.array(c.ids[doc], pa.int64()), pa.array((at - c.first[doc]).astype(np.int32)), pa.array(g.view(np.int64))], ["doc_id", "pos", "h"])


def scan(docs: DataFrame, templates: dict[str, str] | None = None) -> DataFrame:
    """(doc_id, license, start_word, end_word, votes, coverage) of each verified span."""
    rows = template_grams(TEMPLATES if templates is None else templates)
    small = docs.sparkSession.createDataFrame(rows, "license string, words int, place int, h long")
    small = F.broadcast(small) if len(rows) <= 1_000_000 else small  # a larger library joins by shuffle
    hits = texts(docs).mapInArrow(_grams, schema(doc_id=LONG, pos=INT, h=LONG)).join(small, "h").select("doc_id", "license", "words", "pos", "place", (F.col("pos") - F.col("place")).alias("diagonal")).distinct()
    votes = hits.groupBy("doc_id", "license", "diagonal").agg(F.count("*").alias("votes"))
    best = hits.join(votes, ["doc_id", "license", "diagonal"]).groupBy("doc_id", "license", "words", "pos").agg(F.max(F.struct("votes", -F.col("diagonal"))).alias("best"))
    best = best.select("doc_id", "license", "words", "pos", (-F.col("best.col2")).alias("diagonal"))
    w = Window.partitionBy("doc_id", "license").orderBy("pos")
    apart = (F.abs(F.col("diagonal") - F.lag("diagonal").over(w)) > F.greatest(F.lit(3), F.floor(F.col("words") / 7))) | (F.col("pos") - F.lag("pos").over(w) > F.greatest(F.lit(12), F.floor(F.col("words") / 4)))
    isle = F.sum(F.when(F.coalesce(apart, F.lit(True)), 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0))
    spans = best.withColumn("isle", isle).groupBy("doc_id", "license", "words", "isle")
    found = spans.agg(F.min("pos").alias("start_word"), (F.max("pos") + GRAM).alias("end_word"), F.collect_set(F.col("pos") - F.col("diagonal")).alias("places"))  # at most the template's
    cover = F.size(F.array_distinct(F.flatten(F.transform("places", lambda p: F.sequence(p, p + GRAM - 1)))))
    out = found.withColumn("coverage", F.round(cover / F.col("words"), 6)).where(F.col("coverage") >= LEAST)
    return out.select("doc_id", "license", "start_word", "end_word", F.size("places").alias("votes"), "coverage")


def query(spark, sf_dir: str) -> DataFrame:
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def sql() -> str:
    values = ", ".join("('" + name + "', " + str(len(w)) + ", " + str(i) + ", '" + " ".join(w[i : i + GRAM]) + "')" for name, text in TEMPLATES.items() for c in [_chunk(text)] for w in [[bytes(c.data[a:b]).decode().lower() for a, b in zip(c.ws, c.we, strict=True)]] for i in range(len(w) - GRAM + 1))
    return f"""WITH t(license, words, place, s) AS (VALUES {values}),
docs AS (SELECT doc_id, list_transform(regexp_extract_all(text, '[0-9A-Za-z_\\x{{80}}-\\x{{10FFFF}}]+'), lambda w: translate(w, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS w FROM documents WHERE text IS NOT NULL),
grams AS (SELECT doc_id, i - 1 AS pos, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM docs)),
hits AS (SELECT DISTINCT doc_id, license, words, pos, pos - place AS diagonal FROM grams JOIN t USING (s)),
counted AS (SELECT *, count(*) OVER (PARTITION BY doc_id, license, diagonal) AS n FROM hits),
best AS (SELECT * FROM counted QUALIFY row_number() OVER (PARTITION BY doc_id, license, pos ORDER BY n DESC, diagonal) = 1),
marked AS (SELECT *, CASE WHEN abs(diagonal - lag(diagonal) OVER w) <= greatest(3, words // 7) AND pos - lag(pos) OVER w <= greatest(12, words // 4) THEN 0 ELSE 1 END AS new FROM best WINDOW w AS (PARTITION BY doc_id, license ORDER BY pos)),
isles AS (SELECT *, sum(new) OVER (PARTITION BY doc_id, license ORDER BY pos) AS isle FROM marked),
spans AS (SELECT doc_id, license, words, isle, min(pos) AS start_word, max(pos) + {GRAM} AS end_word, list(DISTINCT pos - diagonal) AS places FROM isles GROUP BY ALL)
SELECT doc_id, license, start_word::INT AS start_word, end_word::INT AS end_word, len(places)::INT AS votes, coverage FROM (
  SELECT *, round(len(list_distinct(flatten(list_transform(places, lambda p: range(p, p + {GRAM}))))) / words, 6) AS coverage FROM spans) WHERE coverage >= {LEAST}"""
