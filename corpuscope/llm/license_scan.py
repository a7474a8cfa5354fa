"""Licence scan: a trained classifier of paragraphs, DataFrame and Spark ML only.

Paragraphs (lines) are classified by multinomial logistic regression on word unigrams and bigrams, with an L1 penalty
that keeps few of them. It learns from the templates below, cut and thinned, against a bounded sample of corpus lines.
Which words mark a licence is counted on all lines. The class "unknown" is calibrated: a family is predicted only above
the probability that almost no corpus line reaches, of all lines that the fit did not see. A prediction is confirmed by comparing the paragraph with the family's templates, both ways.
"""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import CountVectorizer, CountVectorizerModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuscope.llm.common import Stages

UNKNOWN = "unknown"
SAMPLE_LINES = 20_000  # corpus lines to learn "unknown" from, expected at most
COMMON = 0.002  # words of more corpus lines than this do not mark a licence
CONFIRM = 0.6  # least part of a paragraph's words that a template has
FALSE_RATE = 0.0005  # of the corpus lines outside the fit that may reach the threshold
RUN = 5  # consecutive words of a template that make a line no evidence of "unknown"

# Usual notices of licence families, short forms and full paragraphs: fixed values. Of families that share a sentence the first listed has it
TEMPLATES = [
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction"),
    ("MIT", "Licensed under the MIT License. Released under the MIT license. This project is licensed under the terms of the MIT license"),
    ("MIT", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0. You may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("Apache-2.0", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND"),
    ("BSD", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("BSD", "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer"),
    ("BSD", "Use of this source code is governed by a BSD-style license. Licensed under the BSD 3-Clause License"),
    ("GPL", "This work is licensed under the GNU General Public License, version 3. Licensed under the GPL"),
    ("GPL", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or any later version"),
    ("LGPL", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"),
    ("AGPL", "Licensed under the GNU Affero General Public License as published by the Free Software Foundation, version 3"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one"),
    ("CC-BY", "This work is licensed under a Creative Commons Attribution 4.0 International License. Licensed under CC BY 4.0"),
    ("CC-BY-SA", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License. Licensed under CC BY-SA 4.0. Shared under CC BY-SA 4.0"),
    ("CC-BY-NC", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License. Licensed under CC BY-NC 4.0"),
    ("Public-Domain", "This work is dedicated to the public domain under CC0 1.0 Universal. This is free and unencumbered software released into the public domain"),
    ("Proprietary", "All rights reserved. No part of this publication may be reproduced, distributed or transmitted in any form without the prior written permission of the publisher"),
    ("Proprietary", "Confidential and proprietary. Unauthorized copying of this file, via any medium, is strictly prohibited. Copyright, all rights reserved"),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"),
    ("MIT", "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("Apache-2.0", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("Apache-2.0", "Licensed to the Apache Software Foundation (ASF) under one or more contributor license agreements. See the NOTICE file distributed with this work for additional information regarding copyright ownership. The ASF licenses this file to You under the Apache License, Version 2.0"),
    ("BSD", "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."),
    ("BSD", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("BSD", "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."),
    ("BSD", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("GPL", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 2 of the License, or (at your option) any later version."),
    ("GPL", "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."),
    ("GPL", "You should have received a copy of the GNU General Public License along with this program. If not, see https://www.gnu.org/licenses/. If not, write to the Free Software Foundation, Inc., 51 Franklin Street, Fifth Floor, Boston, MA 02110-1301 USA."),
    ("LGPL", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    ("LGPL", "This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details."),
    ("LGPL", "You should have received a copy of the GNU Lesser General Public License along with this library; if not, see https://www.gnu.org/licenses/"),
    ("AGPL", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("AGPL", "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Affero General Public License for more details."),
    ("AGPL", "You should have received a copy of the GNU Affero General Public License along with this program. If not, see https://www.gnu.org/licenses/"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("CC-BY", "This work is licensed under the Creative Commons Attribution 4.0 International License. To view a copy of this license, visit http://creativecommons.org/licenses/by/4.0/ or send a letter to Creative Commons, PO Box 1866, Mountain View, CA 94042, USA."),
    ("CC-BY-SA", "This work is licensed under the Creative Commons Attribution-ShareAlike 4.0 International License. To view a copy of this license, visit http://creativecommons.org/licenses/by-sa/4.0/ or send a letter to Creative Commons, PO Box 1866, Mountain View, CA 94042, USA."),
    ("CC-BY-NC", "This work is licensed under the Creative Commons Attribution-NonCommercial 4.0 International License. To view a copy of this license, visit http://creativecommons.org/licenses/by-nc/4.0/ or send a letter to Creative Commons, PO Box 1866, Mountain View, CA 94042, USA."),
    ("Public-Domain", "To the extent possible under law, the author has dedicated all copyright and related and neighboring rights to this work to the public domain worldwide. This work is distributed without any warranty."),
    ("Public-Domain", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
    ("Proprietary", "All rights reserved. No part of this publication may be reproduced, distributed, or transmitted in any form or by any means, including photocopying, recording, or other electronic or mechanical methods, without the prior written permission of the publisher, except in the case of brief quotations embodied in critical reviews and certain other noncommercial uses permitted by copyright law."),
    ("Proprietary", "Unauthorized copying of this file, via any medium, is strictly prohibited. Proprietary and confidential. All rights reserved."),
]


def words_of(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), "[^a-z0-9]+"), lambda w: w != "")


def pairs_of(words: Column) -> Column:
    return F.filter(F.transform(words, lambda w, i: F.concat(w, F.lit(" "), F.get(words, i + 1))), lambda g: g.isNotNull())


def grams_of(words: Column) -> Column:
    """Unigrams and bigrams."""
    return F.concat(words, pairs_of(words))


def training_paragraphs(templates: DataFrame) -> DataFrame:
    """``family, words``: sentences and clauses of the templates and stretches of them, and thinned copies (each word of a
    copy is left out by a seeded hash, one in eight)."""
    whole = templates.select("family", F.monotonically_increasing_id().alias("at"), F.explode(F.concat(F.array("text"), F.split("text", r"\. "), F.split("text", r"[.,;:] "))).alias("text"))
    w = whole.select("family", "at", words_of(F.col("text")).alias("words")).where(F.size("words") >= 3)
    # stretches of eight words, from every fourth word on
    starts = F.sequence(F.lit(1), F.greatest(F.size("words") - 7, F.lit(1)), F.lit(4))
    cut = w.select("family", "at", "words", F.explode(starts).alias("a")).select("family", "at", F.slice("words", F.col("a"), F.lit(8)).alias("words"))
    w = w.union(cut).groupBy("words").agg(F.min_by("family", "at").alias("family")).select("family", "words")
    thin = w.select("family", "words", F.explode(F.array(*[F.lit(i) for i in range(6)])).alias("copy"))
    kept = F.filter("words", lambda x, i: (F.col("copy") == 0) | (F.pmod(F.xxhash64(x, i, F.col("copy")), F.lit(8)) != 0))
    return thin.select("family", kept.alias("words")).where(F.size("words") >= 2)


def corpus_lines(docs: DataFrame) -> DataFrame:
    """``doc_id, line, words``: the non-empty lines of the documents. The words come out of a generator, so that filters
    on them do not split the text anew."""
    lines = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("line", "text")).where(F.length(F.trim("text")) > 0)
    return lines.select("doc_id", "line", F.explode(F.array(words_of(F.col("text")))).alias("words"))


def is_notice(words: Column, notices: list[list[str]]) -> Column:
    """Whether one template covers the words and word pairs to ``CONFIRM``, or the words hold a run of ``RUN`` words of a
    template. Either needs enough words of the templates, which is asked first."""
    every = sorted({w for n in notices for w in n})
    row = F.aggregate(words, F.lit(0), lambda n, w: F.when((n >= RUN), n).when(w.isin(every), n + 1).otherwise(0)) >= RUN
    runs = sorted({" ".join(n[i : i + RUN]) for n in notices for i in range(len(n) - RUN + 1)})
    holds = F.exists(F.transform(words, lambda w, i: F.concat_ws(" ", F.slice(words, i + 1, RUN))), lambda r: r.isin(runs)) if runs else F.lit(False)
    own = F.array_distinct(words)
    near = F.size(F.filter(own, lambda w: w.isin(every))) >= CONFIRM * F.size(own)
    grams = F.array_distinct(grams_of(words))
    whole = F.array(*[F.array(*[F.lit(g) for g in sorted({*n, *map(" ".join, zip(n, n[1:]))})]) for n in notices])
    return (row & holds) | (near & F.exists(whole, lambda t: F.size(F.array_intersect(grams, t)) >= CONFIRM * F.size(grams)))


class LicenseModel:
    """What ``train`` fits: vocabulary, regression and threshold."""

    def __init__(self, vocabulary: CountVectorizerModel, regression: LogisticRegressionModel, families: list[str], threshold: float):
        self.vocabulary, self.regression, self.families, self.threshold = vocabulary, regression, families, threshold

    def probabilities(self, paragraphs: DataFrame) -> DataFrame:
        """``paragraphs`` (with ``words``) plus ``family`` and ``probability`` of the best family."""
        rows = self.regression.transform(self.vocabulary.transform(paragraphs.withColumn("grams", grams_of(F.col("words")))))
        p = vector_to_array("p")
        best = F.array_max(F.transform(p, lambda x, i: F.struct(F.when(F.get(F.lit(self.families), i) == UNKNOWN, -1.0).otherwise(x).alias("p"), (-i).alias("i"))))
        rows = rows.withColumn("best", best)
        return rows.withColumn("family", F.get(F.lit(self.families), -F.col("best.i"))).withColumn("probability", F.col("best.p")).drop("grams", "features", "raw", "p", "best", "prediction")


def line_counts(lines: DataFrame, notice: Column, terms: list[str]) -> tuple[int, dict[str, int]]:
    """Lines that are no notices, and how many of them hold each term: all lines count, added up by task."""
    held = F.filter(F.array_distinct("words"), lambda w: w.isin(terms))
    rows = lines.where(~notice).select(F.explode(F.concat(F.array(F.lit("")), held)).alias("w")).groupBy("w").agg(F.count(F.lit(1)).alias("n"))
    counts = {r.w: r.n for r in rows.collect()}  # a row for each term
    return counts.pop("", 0), counts


def threshold_of(scored: DataFrame, total: int) -> float:
    """Least threshold from 0.5 to 0.9, in steps of 0.0001, that at most ``FALSE_RATE`` of the ``total`` held-out lines reach;
    ``scored`` has those of them with a probability of 0.5 or more."""
    step = F.floor(F.least("probability", F.lit(0.9)) * 10_000).alias("step")
    steps = scored.where(F.col("probability") >= 0.5).groupBy(step).agg(F.count(F.lit(1)).alias("n"))
    above = 0
    for r in sorted(steps.collect(), key=lambda r: -r.step):  # a row for each of 4,001 steps at most
        above += r.n
        if above > FALSE_RATE * total:
            return min((r.step + 1) / 10_000, 0.9)
    return 0.5


def train(docs: DataFrame, templates: DataFrame, stages: Stages, sample_lines: int = SAMPLE_LINES) -> tuple[LicenseModel, DataFrame]:
    """The model, and all lines of which a family has a probability of 0.5 or more. Only the regression is fitted on a sample
    (``drawn``); word frequencies and threshold are of all lines, the threshold of those that the fit did not see."""
    lines = corpus_lines(docs)
    known = stages.save(training_paragraphs(templates), "known")
    notices = [r.words for r in templates.select(words_of(F.col("text")).alias("words")).collect() if r.words]
    notice = is_notice(F.col("words"), notices)  # notices are no evidence of "unknown", nor of what is common
    terms = [r.w for r in known.select(F.explode("words").alias("w")).distinct().where(F.length("w") > 1).orderBy("w").collect()]  # words of the templates
    lines = lines.where(F.size("words") > 0)
    total, counts = line_counts(lines, notice, terms)
    terms = [t for t in terms if counts.get(t, 0) <= COMMON * max(total, 1)]
    marks = F.array(*[F.lit(t) for t in terms])
    pairs = known.select(F.explode(grams_of(F.col("words"))).alias("g")).distinct().where(F.exists(F.split("g", " "), lambda x: F.array_contains(marks, x)))
    vocabulary = CountVectorizerModel.from_vocabulary([r.g for r in pairs.orderBy("g").collect()], inputCol="grams", outputCol="features")
    vocabulary.setBinary(True)
    families = [UNKNOWN] + [r.family for r in templates.select("family").distinct().orderBy("family").collect()]
    label = F.array_position(F.lit(families), F.col("family")).cast("double") - 1
    draw = F.pmod(F.xxhash64("doc_id", "line", F.lit("licence")), F.lit(1 << 20)) < int(min(1.0, sample_lines / max(total, 1)) * (1 << 20))
    drawn = draw & (F.pmod(F.xxhash64("words"), F.lit(4)) != 0)
    other = stages.save(lines.where(drawn).where(~notice).select("words"), "plain")
    rows = known.union(other.select(F.lit(UNKNOWN).alias("family"), "words")).withColumn("label", label).withColumn("grams", grams_of(F.col("words")))
    weight = F.when(F.col("label") == 0, F.lit(1.0)).otherwise(F.lit(4.0))
    regression = LogisticRegression(
        featuresCol="features", labelCol="label", weightCol="weight", probabilityCol="p", rawPredictionCol="raw", family="multinomial", regParam=2e-4, elasticNetParam=0.5, maxIter=50
    ).fit(vocabulary.transform(rows.withColumn("weight", weight)).coalesce(2))  # a bounded sample
    model = LicenseModel(vocabulary, regression, families, 0.5)
    # lines without a mark have no feature, which makes them unknown: the regression does not meet them
    marked = stages.save(lines.where(F.exists("words", lambda w: w.isin(terms))).withColumn("drawn", drawn), "marked")
    scored = stages.save(model.probabilities(marked).where(F.col("probability") >= 0.5), "scored")
    model.threshold = threshold_of(scored.where(~F.col("drawn") & ~notice), total - other.count())
    return model, scored.drop("drawn")


def license_scan(docs: DataFrame, stages: Stages | None = None, templates: DataFrame | None = None) -> DataFrame:
    """Paragraphs that are licence notices: ``doc_id, line, family, probability, similarity, confirmed``.

    ``similarity`` compares both ways: the largest part of the paragraph's distinct words that a template of the family has,
    or of a template's distinct word pairs that the paragraph has; ``confirmed`` if it is at least ``CONFIRM``. Paragraphs of the class "unknown" give no row. Every line of every text is classified; lines without a
    word that marks licences have no feature, which makes them unknown.

    Defined cases: null and empty texts have no paragraphs; ties between families go to the first by name; rows that repeat a
    doc_id are scanned each; a null doc_id is kept; an empty table gives no rows; other columns are not read.
    """
    spark = docs.sparkSession
    st = stages or Stages(spark, "licences")
    templates = templates if templates is not None else spark.createDataFrame(TEMPLATES, "family string, text string")
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    model, scored = train(plain, templates, st)
    found = scored.where(F.col("probability") >= model.threshold)
    of = words_of(F.col("text"))
    known = templates.select("family", F.struct(F.array_distinct(of).alias("words"), F.array_distinct(pairs_of(of)).alias("pairs")).alias("of")).groupBy("family").agg(F.collect_list("of").alias("templates"))
    own, pairs = F.array_distinct("words"), F.array_distinct(pairs_of(F.col("words")))
    covered = lambda t: F.size(F.array_intersect(own, t["words"])) / F.size(own)
    held = lambda t: F.coalesce(F.try_divide(F.size(F.array_intersect(pairs, t["pairs"])), F.size(t["pairs"])), F.lit(0.0))
    best = F.array_max(F.transform("templates", lambda t: F.greatest(covered(t), held(t))))
    out = found.join(F.broadcast(known), "family").withColumn("similarity", best)  # one row for each family
    return out.select("doc_id", "line", "family", "probability", "similarity", (F.col("similarity") >= CONFIRM).alias("confirmed"))
