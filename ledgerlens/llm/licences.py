"""Licences of files: TF-IDF cosine of their parts to templates, then inheritance from the nearest directory.

The parts of a whole text are its lines, its paragraphs of several lines, its leading comment block and the text itself.
A part is a bag of words (runs of ASCII letters and digits, lower-cased; comment marks are none), less the notice of a
copyright holder and year at the start of a line. Lines are compared with statements (``TEMPLATES``); longer parts also
with texts of whole licences, each word then counting 1 + ln(times). The cosine uses
idf = ln((1 + lines) / (1 + lines with the word)) + 1 over the lines of all files, for every word of the part. Counts of
the templates' words and of the ``KNOWN_WORDS`` most frequent words go to every task; they decide most parts exactly and
bound the others, and only parts that may still be a file's best are joined with the counts of their rarer words.

A file's own licence is what an ``SPDX-License-Identifier`` declares, else the template with the best cosine of its
parts, at ``THRESHOLD`` or more; ties go to the first template, and "All rights reserved" counts only where no other
licence reaches the threshold. A file named ``LICENSE`` rules its directory and all below; a file without licence of its
own takes that of the nearest directory above it that has one (joins on paths; among several licence files of a directory
the smallest doc_id rules).

Null and empty texts have no licence of their own. A null path has no directory, so nothing is inherited. Repeated
rows are judged alike. An empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.frames import BATCH_BYTES, map_batches, materialize
from ledgerlens.llm.licence_texts import TEXTS

# Licence names and statements.
TEMPLATES = (
    ("MIT", "Released under the MIT License."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted."),
    ("CC-BY-4.0", "Licensed under the Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("proprietary", "All rights reserved."),
    *((name, form.format(title)) for name, title in (
        ("MIT", "the MIT License"), ("Apache-2.0", "the Apache License, Version 2.0"), ("BSD-3-Clause", "the BSD 3-Clause License"),
        ("BSD-2-Clause", "the BSD 2-Clause License"), ("ISC", "the ISC License"), ("MPL-2.0", "the Mozilla Public License, Version 2.0"),
        ("GPL-3.0", "the GNU General Public License, version 3"), ("GPL-2.0", "the GNU General Public License, version 2"),
        ("LGPL-3.0", "the GNU Lesser General Public License, version 3"), ("LGPL-2.1", "the GNU Lesser General Public License, version 2.1"),
        ("AGPL-3.0", "the GNU Affero General Public License, version 3"), ("CC0-1.0", "the Creative Commons CC0 1.0 Universal"),
        ("CC-BY-4.0", "the Creative Commons Attribution 4.0 International License"),
        ("CC-BY-SA-4.0", "the Creative Commons Attribution-ShareAlike 4.0 International License"),
        ("CC-BY-NC-4.0", "the Creative Commons Attribution-NonCommercial 4.0 International License"))
      for form in ("Licensed under {}.", "This file is released under {}.", "Released under {}, see LICENSE for details.",
                   "This work is licensed under {}.")),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. "
                   "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in "
                   "writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, "
                   "either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with "
                "this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("MIT", "Use of this source code is governed by an MIT-style license that can be found in the LICENSE file."),
    *((name, f"This program is free software: you can redistribute it and/or modify it under the terms of the GNU {kind}General Public License as "
             f"published by the Free Software Foundation, either version {version} of the License, or (at your option) any later version. This program is "
             f"distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS "
             f"FOR A PARTICULAR PURPOSE. See the GNU {kind}General Public License for more details. You should have received a copy of the GNU {kind}General "
             f"Public License along with this program. If not, see <https://www.gnu.org/licenses/>.")
      for name, kind, version in (("GPL-3.0", "", "3"), ("GPL-2.0", "", "2"), ("LGPL-3.0", "Lesser ", "3"), ("LGPL-2.1", "Lesser ", "2.1"), ("AGPL-3.0", "Affero ", "3"))),
)
THRESHOLD = 0.75
KNOWN_WORDS = 100_000  # about 10 MB of a worker process
_HELD_WORDS = 200_000  # of a counting task, before it hands them on
_WORD = re.compile(r"[a-z0-9]+").findall
NAMES = [name for name, _ in (*TEMPLATES, *TEXTS)]
_BAGS = [Counter(_WORD(text.lower())) for _, text in (*TEMPLATES, *TEXTS)]
_STATED = frozenset().union(*_BAGS[:len(TEMPLATES)])
VOCABULARY = frozenset().union(*_BAGS)
_WEAK = NAMES.index("proprietary")
_NOTICE = re.compile(r"^\W*(?:copyright\b|\(c\)|\u00a9)[^\n]*?(?:\(c\)|\u00a9|\b[0-9]{4}\b)[^\n]*?(?=all rights reserved|$)").sub
_SPDX = re.compile(r"SPDX-License-Identifier:[ \t]*\(?([A-Za-z0-9.+-]+(?:[ \t]+(?:OR|AND|WITH)[ \t]+[A-Za-z0-9.+-]+)*)", re.IGNORECASE).search
_OPENERS = {"/*": "*/", "<!--": "-->", '"""': '"""', "'''": "'''"}
Part = tuple[int, float, float, dict[str, float], bool]


def declared(text: str) -> str | None:
    """Licence of the first SPDX line; known names in this module's spelling, others as they stand."""
    found = _SPDX(text)
    if not found:
        return None
    stem = re.sub(r"-(only|or-later)$|\+$", "", found[1].lower())
    return next((name for name in NAMES if name.lower() == stem), " ".join(found[1].split()))


def header_lines(lines: list[str]) -> int:
    """How many of the first lines are a comment block."""
    closer = ""
    for k, line in enumerate(lines):
        line = line.strip()
        if closer:
            closer = "" if closer in line else closer
            continue
        opener = next((o for o in _OPENERS if line.startswith(o)), "")
        if opener:
            closer = "" if _OPENERS[opener] in line[len(opener):] else _OPENERS[opener]
        elif line and not line.startswith(("#", "//", ";", "--", "%", "*")):
            return k
    return len(lines)


def idf(lines: int, holding: int) -> float:
    """Weight of a word that ``holding`` of ``lines`` lines have."""
    return math.log((1 + lines) / (1 + holding)) + 1


def document_counts(files: DataFrame) -> DataFrame:
    """(word, n): how many lines of all files hold each word, written once; the empty word counts the lines."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()

        def part() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], ["word", "n"])

        for batch in batches:
            for text in batch.column(0).to_pylist():
                lines = (text or "").lower().split("\n")
                held[""] += len(lines)
                for line in lines:
                    held.update(set(_WORD(line)))
                if len(held) > _HELD_WORDS:
                    yield part()
                    held.clear()
        yield part()

    files.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    parts = files.select(F.col("text").cast("string")).mapInArrow(count, "word string, n long")
    return materialize(parts.groupBy("word").agg(F.sum("n").alias("n")))


class Scorer:
    """Cosines of lines to the templates under given counts.

    Words without a count are in ``rarest`` lines at most and in one at least.
    """

    def __init__(self, lines: int, held: dict[str, int], rarest: int = 1):
        self.weight = {w: idf(lines, n) for w, n in held.items()} | {w: idf(lines, held.get(w, int(w not in _STATED))) for w in VOCABULARY}
        self.most, self.least = idf(lines, 1), idf(lines, rarest)
        # word -> (template, its share of the template's length), for lines and for longer parts
        self.listed: tuple[dict[str, list[tuple[int, float]]], ...] = ({}, {})
        for long, listed in enumerate(self.listed):
            for k, bag in enumerate(_BAGS if long else _BAGS[:len(TEMPLATES)]):
                parts = {w: (1 + math.log(n) if long else n) * self.weight[w] for w, n in bag.items()}
                norm = math.sqrt(sum(x * x for x in parts.values()))
                for w, x in parts.items():
                    listed.setdefault(w, []).append((k, x / norm))

    @classmethod
    def of(cls, counts: DataFrame) -> Scorer:
        """From written counts: those of template words and of the most frequent words come to the driver."""
        common = counts.where("word <> ''").orderBy(F.desc("n"), "word").limit(KNOWN_WORDS).collect()
        own = counts.where(F.col("word").isin("", *VOCABULARY)).collect()
        held = {r["word"]: r["n"] for r in [*common, *own]}
        lines = held.pop("", 0)
        return cls(lines, held, common[-1]["n"] if len(common) == KNOWN_WORDS else 1)

    def part(self, bag: dict[str, int], long: bool, edge: bool, tops: list[float]) -> Part | None:
        """(template, dot product with it, squared length by known words, words without a count, edge); the best template
        does not depend on a part's other words. None where it cannot matter; ``tops`` are the best so far."""
        near, size, rare, listed = 0.0, 0.0, {}, self.listed[long]
        for w, n in bag.items():
            n = 1 + math.log(n) if long else n
            x = self.weight.get(w)
            if x is None:
                rare[w] = n
            else:
                size += n * n * x * x
                if w in listed:
                    near += n * n * x * x
        others = sum(n * n for n in rare.values())
        most = math.sqrt(near / (size + others * self.least ** 2)) + 1e-9 if near else 0.0
        if not near or (most < tops[0] and (most < tops[1] or _BAGS[_WEAK].keys().isdisjoint(bag)) and not (edge and most >= THRESHOLD)):
            return None
        dots = [0.0] * len(NAMES)
        for w, n in bag.items():
            if w in listed:
                n = (1 + math.log(n) if long else n) * self.weight[w]
                for k, x in listed[w]:
                    dots[k] += n * x
        dot = max(dots)
        k = next(k for k, x in enumerate(dots) if x >= dot - 1e-12)
        tops[k == _WEAK] = max(tops[k == _WEAK], dot / math.sqrt(size + others * self.most ** 2))
        return k, dot, size, rare, edge

    def units(self, text: str | None) -> list[Part]:
        """Parts that may have the best cosine of the text, and those at its edges (first and last line, whole text) that may
        reach the threshold."""
        found, tops = [], [0.0, 0.0]
        lines = (text or "").lower().split("\n")
        bags = [Counter(_WORD(_NOTICE("", line))) for line in lines]
        used = [k for k, bag in enumerate(bags) if bag]
        seen = set()
        for k in [*used[:1], *used[-1:], *used]:
            if lines[k] not in seen:
                seen.add(lines[k])
                if not _STATED.isdisjoint(bags[k]):
                    found.append(self.part(bags[k], False, k in (used[0], used[-1]), tops))
        longer = {(0, header_lines(lines)), (0, len(lines))}
        start = 0
        for k in range(len(lines) + 1):
            if k == len(lines) or not bags[k]:
                longer.add((start, k))
                start = k + 1
        for a, b in sorted(longer, key=lambda p: (p[0] - p[1], p)):
            if sum(map(bool, bags[a:b])) > 1:
                whole: Counter = Counter()
                for bag in bags[a:b]:
                    whole.update(bag)
                found.append(self.part(whole, True, (a, b) == (0, len(lines)), tops))
        out = []
        for unit in found:
            if unit:
                most = unit[1] / math.sqrt(unit[2] + sum(n * n for n in unit[3].values()) * self.least ** 2) + 1e-9
                if most >= tops[unit[0] == _WEAK] or unit[4] and most >= THRESHOLD:
                    out.append(unit)
        return out

    def tops(self, units: list[Part]) -> tuple[int, float, float, bool]:
        """(template, cosine) of the best part, cosine of the reserved rights, and whether an edge states a licence; words
        without a count are in one line each."""
        strong, weak, states = (0.0, 0), 0.0, False
        for k, dot, size, rare, edge in units:
            cosine = round(dot / math.sqrt(size + sum(n * n for n in rare.values()) * self.most ** 2), 12)
            states |= edge and cosine >= THRESHOLD
            if k == _WEAK:
                weak = max(weak, cosine)
            else:
                strong = max(strong, (cosine, -k))
        return -strong[1], strong[0], weak, states

    def best(self, text: str | None) -> tuple[str | None, float]:
        """(licence, cosine) of the text's best part; None below the threshold."""
        spdx = declared(text or "")
        if spdx:
            return spdx, 1.0
        k, strong, weak, _ = self.tops(self.units(text))
        if strong >= THRESHOLD:
            return NAMES[k], strong
        return (NAMES[_WEAK], weak) if weak >= THRESHOLD else (None, max(strong, weak))


def own_licences(files: DataFrame) -> DataFrame:
    """(doc_id, path, licence, score, states) of every file by its own parts; it states a licence if its first or last line,
    or the whole text, reaches the threshold or declares one."""
    counts = document_counts(files)
    scorer = Scorer.of(counts)
    lines = counts.where("word = ''").select(F.max("n")).first()[0] or 0
    names = ("doc_id", "path", "row_id", "spdx", "k", "strong", "weak", "states", "open")
    open_type = pa.list_(pa.struct([("k", pa.int32()), ("dot", pa.float64()), ("size", pa.float64()), ("edge", pa.bool_()), ("words", pa.list_(pa.string())), ("times", pa.list_(pa.float64()))]))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = []
        for text in batch.column(2).to_pylist():
            units = scorer.units(text)
            spdx = declared(text or "")
            k, strong, weak, states = scorer.tops([u for u in units if not u[3]])
            left = [{"k": k, "dot": dot, "size": size, "edge": edge, "words": list(rare), "times": [float(n) for n in rare.values()]} for k, dot, size, rare, edge in units if rare]
            first, *_, last = [line for line in (text or "").split("\n") if line.strip()] * 2 or ("", "")
            rows.append((spdx, k, strong, weak, states or bool(spdx and (_SPDX(first) or _SPDX(last))), left))
        kinds = (pa.string(), pa.int32(), pa.float64(), pa.float64(), pa.bool_(), open_type)
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(3), *[pa.array(list(c), kind) for c, kind in zip(zip(*rows), kinds)]], names)

    columns = files.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("path").cast("string").alias("path"), F.col("text").cast("string").alias("text"),
                           F.monotonically_increasing_id().alias("row_id"))
    judged = materialize(map_batches(columns, run, "doc_id long, path string, row_id long, spdx string, k int, strong double, weak double, states boolean, "
                                     "open array<struct<k: int, dot: double, size: double, edge: boolean, words: array<string>, times: array<double>>>"))
    # parts with rarer words: their lengths need the counts of those words; no such word is in many lines. Only the words
    # themselves travel, what else is known of a part waits in its row
    words = (judged.where("size(open) > 0").select("row_id", F.posexplode("open").alias("unit", "o"))
             .select("row_id", "unit", F.explode(F.arrays_zip("o.words", "o.times")).alias("w"))
             .select("row_id", "unit", F.col("w.words").alias("word"), F.col("w.times").alias("times")))
    weight = F.log((1.0 + lines) / (1.0 + F.col("n"))) + 1
    lengths = words.join(counts, "word").groupBy("row_id", "unit").agg(F.sum(F.pow(F.col("times") * weight, F.lit(2))).alias("rest"))
    solved = lengths.groupBy("row_id").agg(F.map_from_entries(F.collect_list(F.struct("unit", "rest"))).alias("rest"))  # the parts of a text
    parts = F.transform(F.arrays_zip("open.k", "open.dot", "open.size", "open.edge"), lambda o, i: F.struct(
        o["k"].alias("k"), o["edge"].alias("edge"), F.round(o["dot"] / F.sqrt(o["size"] + F.col("rest")[i]), 12).alias("score")))
    late = judged.where("size(open) > 0").join(solved, "row_id").withColumn("parts", parts)
    late = late.withColumns({
        "found": F.greatest(F.struct(F.col("strong").alias("score"), (-F.col("k")).alias("k")), F.array_max(F.transform(
            F.filter("parts", lambda o: o["k"] != _WEAK), lambda o: F.struct(o["score"].alias("score"), (-o["k"]).alias("k"))))),
        "reserved": F.array_max(F.transform(F.filter("parts", lambda o: o["k"] == _WEAK), lambda o: o["score"])),
        "stated": F.exists("parts", lambda o: o["edge"] & (o["score"] >= THRESHOLD))})
    rows = judged.where("size(open) = 0").select("doc_id", "path", "spdx", "k", "strong", "weak", "states").unionByName(
        late.select("doc_id", "path", "spdx", (-F.col("found.k")).alias("k"), F.col("found.score").alias("strong"), F.greatest("weak", "reserved").alias("weak"),
                    (F.col("states") | F.col("stated")).alias("states")))
    strong, weak = F.col("strong") >= THRESHOLD, F.col("weak") >= THRESHOLD
    licence = (F.when(F.col("spdx").isNotNull(), F.col("spdx")).when(strong, F.element_at(F.array(*[F.lit(name) for name in NAMES]), F.col("k") + 1))
               .when(weak, F.lit(NAMES[_WEAK])))
    score = F.when(F.col("spdx").isNotNull(), 1.0).when(strong, F.col("strong")).when(weak, F.col("weak")).otherwise(F.greatest("strong", "weak"))
    return rows.select("doc_id", "path", licence.alias("licence"), score.alias("score"), "states")


def scan(files: DataFrame) -> DataFrame:
    """doc_id, path, licence, score, origin (own, inherited or none), licence_dir for every row of ``files``
    (doc_id, path, text)."""
    return inherit(own_licences(files))


def scan_documents(docs: DataFrame) -> DataFrame:
    """``scan`` of documents as files; one that states a licence is the LICENSE of source/language/thousand."""
    own = own_licences(as_files(docs))
    upper = F.when(F.col("doc_id").isNull(), F.regexp_replace("path", "/[^/]*$", "")).otherwise(F.regexp_replace("path", "/[^/]*/[^/]*$", ""))
    return inherit(own.withColumn("path", F.when(F.col("states"), F.concat(upper, F.lit("/LICENSE"))).otherwise(F.col("path"))))


def inherit(own: DataFrame) -> DataFrame:
    """Rows of ``own_licences`` with the licence of the nearest directory where they have none."""
    own = materialize(own)
    directory = F.regexp_replace("path", r"/[^/]*$", "")
    rulers = (own.where(F.col("licence").isNotNull() & F.col("path").rlike(r"(^|/)LICENSE$"))
              .groupBy(F.when(F.col("path") == "LICENSE", "").otherwise(directory).alias("dir"))
              .agg(F.min_by("licence", F.struct("doc_id", "licence")).alias("given")))
    # every directory of a file without licence, once, with all directories above it
    need = own.where("licence IS NULL AND path IS NOT NULL").select(F.when(F.instr("path", "/") > 0, directory).otherwise("").alias("own_dir")).distinct()
    parts = F.split("own_dir", "/")
    above = need.select("own_dir", F.explode(F.sequence(F.lit(0), F.size(parts))).alias("depth")).select(
        "own_dir", "depth", F.concat_ws("/", F.slice(F.split("own_dir", "/"), 1, F.col("depth"))).alias("dir"))
    nearest = (above.join(rulers, "dir").groupBy("own_dir").agg(F.max_by(F.struct("given", "dir"), "depth").alias("nearest")))
    own_dir = F.when(F.col("licence").isNull() & F.col("path").isNotNull(), F.when(F.instr("path", "/") > 0, directory).otherwise(""))
    rows = own.withColumn("wanted", own_dir).join(nearest, F.col("wanted") == F.col("own_dir"), "left")
    origin = F.when(F.col("licence").isNotNull(), "own").when(F.col("nearest").isNotNull(), "inherited").otherwise("none")
    return rows.select("doc_id", "path", F.coalesce("licence", "nearest.given").alias("licence"), F.round("score", 6).alias("score"),
                       origin.alias("origin"), F.col("nearest.dir").alias("licence_dir"))


def as_files(docs: DataFrame) -> DataFrame:
    """Documents as files: source/language/thousand/hundred/id.txt."""
    upper = F.concat_ws("/", F.coalesce("source", F.lit("unknown")), F.coalesce("lang", F.lit("unknown")), F.floor(F.col("doc_id") / 1000).cast("string"))
    file = F.concat_ws("/", upper, F.floor(F.col("doc_id") / 100).cast("string"), F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("unnamed")), F.lit(".txt")))
    return docs.select("doc_id", file.alias("path"), "text")
