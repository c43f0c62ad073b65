"""License notices in documents, by diagonal voting.

All rolling word k-grams of every document are hashed where the documents lie;
those that some template has (a small sorted array) are kept, with the words of
the few documents that have any. A Spark join brings each kept hash together
with its places in the templates. A hit votes for the diagonal (place in the
document less place in the template); diagonals at most ``SLACK`` apart that
touch are merged, since a word more or less moves the rest of a notice to the
next one; and each merged span is verified by aligning its words with the
template's.

Defined results: null and empty texts hold no notice. A null doc_id is carried
along; repeated rows give repeated results. Templates of fewer than ``K`` words
are refused. Of spans of templates that overlap in a document, those with the
greater share, then more words, then the first by name stay. Empty tables give
empty results. Further columns don't matter.
"""

from __future__ import annotations

from difflib import SequenceMatcher

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corvane.llm.shared import id_type, map_text, stage
from corvane.llm.words import U, gram_starts, grams, words

K, SLACK, LEAST_SHARE, LEAST_WORDS = 3, 4, 0.8, 40

#: Notices and whole licenses by SPDX name. Of long texts ``LEAST_WORDS`` aligned words are enough.
TEMPLATES: list[tuple[str, str]] = [
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0-or-later", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("BSD-2-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."),
    ("Zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution."),
    ("BSL-1.0", "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following: The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor."),
    ("Unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law."),
    ("WTFPL", "DO WHAT THE FUCK YOU WANT TO PUBLIC LICENSE TERMS AND CONDITIONS FOR COPYING, DISTRIBUTION AND MODIFICATION 0. You just DO WHAT THE FUCK YOU WANT TO."),
    ("GPL-2.0-or-later", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."),
    ("LGPL-2.1-or-later", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    ("AGPL-3.0-or-later", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("BSD-3-Clause", "SPDX-License-Identifier: BSD-3-Clause"),
]


def _template_words(templates: list[tuple[str, str]]) -> list[np.ndarray]:
    w = words(pa.array([t for _, t in templates], pa.string()))
    out = [w.hash[a:b] for a, b in zip(w.offsets, w.offsets[1:])]
    if any(len(x) < K for x in out):
        raise ValueError(f"a template needs at least {K} words")
    return out


def template_places(spark: SparkSession, parts: list[np.ndarray]) -> DataFrame:
    """(h, template, place) of all k-grams of the templates."""
    rows = [(int(h), t, i) for t, x in enumerate(parts) for i, h in enumerate(grams(x, K).view(np.int64))]
    return spark.createDataFrame(rows, "h long, template long, place long")


def matched(span: list[int], template: list[int]) -> int:
    """How many words of the template the span has in order, by its longest matching blocks."""
    return sum(b.size for b in SequenceMatcher(None, span, template, autojunk=False).get_matching_blocks())


def scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", templates: list[tuple[str, str]] = TEMPLATES) -> DataFrame:
    """(doc_id, license, start, n_words, share): each verified span, in words; ``share`` of the template's words."""
    spark = docs.sparkSession
    parts = _template_words(templates)
    places = template_places(spark, parts)
    sent = spark.sparkContext.broadcast((np.unique(np.concatenate([grams(x, K) for x in parts])), [x.tolist() for x in parts], [n for n, _ in templates]))
    kind = id_type(docs, doc_id)
    long = T.LongType()

    def hits(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        known = sent.value[0]
        w = words(batch.column(1))
        g = grams(w.hash, K)
        ok = np.flatnonzero(gram_starts(w.offsets, K)[: len(g)])
        at = np.minimum(np.searchsorted(known, g[ok]), len(known) - 1)
        ok = ok[known[at] == g[ok]]
        if not len(ok):
            return None
        row = np.searchsorted(w.offsets, ok, "right") - 1
        rows, first, n = np.unique(row, return_index=True, return_counts=True)
        ends = pa.array(np.r_[first, len(ok)].astype(np.int32))
        lists = [pa.ListArray.from_arrays(ends, pa.array(x)) for x in (g[ok].view(np.int64), ok - w.offsets[row])]
        texts = [w.hash[w.offsets[r] : w.offsets[r + 1]].tobytes() for r in rows]
        return pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows)), *lists, pa.array(texts, pa.binary())], ["doc_id", "hashes", "places", "words"])

    schema = T.StructType([T.StructField("doc_id", kind), T.StructField("hashes", T.ArrayType(long)), T.StructField("places", T.ArrayType(long)), T.StructField("words", T.BinaryType())])
    some = map_text(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), "text", schema, hits)
    # Keys are written with the rows, so that a task run anew can't give other ones.
    some = stage(some.withColumn("row", F.expr("uuid()")), "license_hits")
    votes = some.select("row", F.explode(F.arrays_zip("hashes", "places")).alias("x")).select("row", F.col("x.hashes").alias("h"), F.col("x.places").alias("p"))
    lines = votes.join(F.broadcast(places), "h").groupBy("row", "template", (F.col("p") - F.col("place")).alias("diagonal")).agg(F.min("p").alias("lo"), F.max("p").alias("hi"), F.count(F.lit(1)).alias("votes"))
    order = Window.partitionBy("row", "template").orderBy("diagonal", "lo")
    far = (F.col("diagonal") - F.lag("diagonal").over(order) > SLACK) | (F.col("lo") - F.max("hi").over(order.rowsBetween(Window.unboundedPreceding, -1)) > K + SLACK)
    groups = lines.withColumn("group", F.sum(F.coalesce(far, F.lit(True)).cast("int")).over(order))
    spans = groups.groupBy("row", "template", "group").agg(F.min("lo").alias("lo"), (F.max("hi") + K).alias("hi"), F.sum("votes").alias("votes"))
    # A notice whose words are in place has all its votes; one that passes the verification has at least one in every few words.
    likely = spans.groupBy("row").agg(F.collect_list(F.struct("template", "lo", "hi", "votes")).alias("spans")).join(some.select("row", "doc_id", "words"), "row")
    out = T.StructType([T.StructField("doc_id", kind), T.StructField("license", T.StringType()), T.StructField("start", long), T.StructField("n_words", long), T.StructField("share", T.DoubleType())])

    def verify(batch: pa.RecordBatch) -> pa.RecordBatch:
        _, tw, names = sent.value
        rows, found = [], []
        for i, (spans, raw) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())):
            best = []
            w = np.frombuffer(raw, U)
            for s in spans:
                t = tw[s["template"]]
                n = matched(w[s["lo"] : s["hi"]].tolist(), t)
                share = n / len(t)
                if share >= LEAST_SHARE or n >= LEAST_WORDS:
                    best.append((-share, s["lo"] - s["hi"], names[s["template"]], s["lo"], s["hi"]))
            kept: list[tuple] = []
            for x in sorted(best):
                if all(x[4] <= y[3] or y[4] <= x[3] for y in kept):
                    kept.append(x)
            rows += [i] * len(kept)
            found += [(name, lo, hi - lo, -share) for share, _, name, lo, hi in sorted(kept, key=lambda x: x[3])]
        name, lo, n, share = zip(*found) if found else [()] * 4
        return pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), pa.array(name, pa.string()), pa.array(lo, pa.int64()), pa.array(n, pa.int64()), pa.array(share, pa.float64())], out.names)

    def run(batches):
        for b in batches:
            if b.num_rows and (x := verify(b)).num_rows:
                yield x

    return likely.select("doc_id", "spans", "words").mapInArrow(run, out)
