"""Licence scan with DataFrame functions only.

Header lines are compared with licence templates by the cosine of sparse TF-IDF vectors.
Inverse document frequencies of template words come from all documents; a word that no
template has weighs as a word no document has, which only lowers a cosine. Lines without
any anchor word cannot reach the threshold and are not expanded: anchors are the heaviest
words of each template, taken until the rest of it is too light. A file without a licence
of its own inherits that of the nearest directory above it that holds a licence file.
"""

from __future__ import annotations

import math
import re
from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from towerlens.llm import common

#: Short licence notices by SPDX name.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "MIT": "Released under the MIT License.",
    "proprietary": "All rights reserved.",
}
THRESHOLD = 0.8
_FILE = r"(?i)^(licen[cs]e|copying|notice)(\.[a-z]+)?$"
_SPLIT = r"[^\p{L}\p{N}]+"


def _terms(text: str) -> dict[str, int]:
    counts: dict[str, int] = {}
    for w in re.findall(r"[^\W_]+", text.lower()):
        counts[w] = counts.get(w, 0) + 1
    return counts


def _words(text):
    return F.filter(F.split(F.lower(text), _SPLIT), lambda w: w != "")


def anchors(templates: Mapping[str, str], weight: Mapping[str, float], threshold: float) -> set[str]:
    """Words of which a line must have one to reach the threshold with any template."""
    found: set[str] = set()
    for text in templates.values():
        squares = {w: (n * weight[w]) ** 2 for w, n in _terms(text).items()}
        rest = total = sum(squares.values())
        for w in sorted(squares, key=lambda w: (-squares[w], w)):
            if rest < threshold**2 * total - 1e-9:
                break
            found.add(w)
            rest -= squares[w]
    return found


def scan(files: DataFrame, templates: Mapping[str, str] = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """(path, license, cosine, origin, from_dir) per row of ``files`` (path, text).

    ``origin`` is own, inherited or none. A licence file is named so, or at least half of
    its words are its matching header. Ties go to the higher cosine, then the name. Null
    paths lie in no directory and inherit nothing; null texts match nothing; rows equal in
    path and text get equal results; an empty table stays empty; other columns are not read.
    """
    spark = files.sparkSession
    own = files.select(F.col("path").cast("string").alias("path"), F.col("text").cast("string").alias("text"))
    vocabulary = sorted({w for t in templates.values() for w in _terms(t)})
    listed = F.array(*map(F.lit, vocabulary))
    # corpus statistics of the template words: one pass over all texts
    seen = own.select(F.explode(F.array_intersect(_words(F.col("text")), listed)).alias("w")).groupBy("w").agg(F.count(F.lit(1)).alias("n"))
    documents = own.count()
    frequency = {r.w: r.n for r in seen.collect()}  # at most the vocabulary of the templates
    weight = {w: math.log((1 + documents) / (1 + frequency.get(w, 0))) + 1 for w in vocabulary}
    unseen = math.log(1 + documents) + 1
    needed = sorted(anchors(templates, weight, threshold))
    norms = {name: math.sqrt(sum((n * weight[w]) ** 2 for w, n in _terms(t).items())) for name, t in templates.items()}
    rows = [(name, w, n * weight[w] ** 2 / norms[name]) for name, t in templates.items() for w, n in sorted(_terms(t).items())]
    # the templates are a parameter, so this table is bounded by it
    dots = F.broadcast(spark.createDataFrame(rows, "license string, w string, part double"))
    idf = F.broadcast(spark.createDataFrame([(w, weight[w]) for w in vocabulary], "w string, idf double"))

    anchored = rf"(?i)(^|[^\p{{L}}\p{{N}}])({'|'.join(map(re.escape, needed))})([^\p{{L}}\p{{N}}]|$)"
    keyed = own.withColumn("key", common.row_key("path", "text"))
    lines = keyed.filter(F.col("text").rlike(anchored)).select("key", "path", F.size(_words(F.col("text"))).alias("file_words"), F.posexplode(F.split("text", "\n", -1)).alias("line_no", "line"))
    lines = lines.filter(F.col("line").rlike(anchored)).dropDuplicates(["key", "line_no"]).withColumn("words", _words(F.col("line")))
    terms = lines.select("key", "path", "file_words", "line_no", F.size("words").alias("line_words"), F.explode("words").alias("w"))
    terms = terms.groupBy("key", "path", "file_words", "line_no", "line_words", "w").agg(F.count(F.lit(1)).alias("n"))
    terms = terms.join(idf, "w", "left")
    length = F.sqrt(F.sum(F.pow(F.col("n") * F.coalesce("idf", F.lit(unseen)), 2)))
    line = ["key", "path", "file_words", "line_no", "line_words"]
    length = terms.groupBy(*line).agg(length.alias("length"))
    products = terms.join(dots, "w").groupBy("key", "line_no", "license").agg(F.sum(F.col("n") * F.col("part")).alias("dot"))
    scored = length.join(products, ["key", "line_no"]).withColumn("cosine", F.round(F.col("dot") / F.col("length"), 9)).filter(F.col("cosine") >= threshold)
    best = scored.groupBy("key", "path").agg(F.min(F.struct((-F.col("cosine")).alias("low"), "license", (F.col("line_words") * 2 >= F.col("file_words")).alias("whole"))).alias("best"))
    best = common.stage(best.select("key", "path", F.col("best.license").alias("license"), (-F.col("best.low")).alias("cosine"), F.col("best.whole").alias("whole")), "licenses")

    parent = F.when(F.col("path").contains("/"), F.regexp_replace("path", r"/[^/]*$", "")).when(F.col("path").isNotNull(), "")
    holders = best.filter(F.col("whole") | F.element_at(F.split("path", "/"), -1).rlike(_FILE)).filter("path is not null")
    holders = holders.withColumn("dir", parent).groupBy("dir").agg(F.min(F.struct((-F.col("cosine")).alias("low"), "license")).alias("first"))
    holders = holders.select(F.col("dir").alias("above"), F.col("first.license").alias("dir_license"), (-F.col("first.low")).alias("dir_cosine"))
    # nearest ancestor per directory, not per file
    dirs = own.filter("path is not null").select(parent.alias("dir")).distinct()
    steps = F.split("dir", "/")
    above = F.concat(F.array(F.lit("")), F.transform(F.sequence(F.lit(1), F.size(steps)), lambda i: F.concat_ws("/", F.slice(steps, F.lit(1), i))))
    reached = dirs.select("dir", F.explode(F.array_distinct(above)).alias("above")).join(holders, "above")
    nearest = reached.groupBy("dir").agg(F.max_by(F.struct("above", "dir_license", "dir_cosine"), F.length("above")).alias("near"))
    nearest = common.stage(nearest.select("dir", F.col("near.above").alias("from_dir"), F.col("near.dir_license").alias("dir_license"), F.col("near.dir_cosine").alias("dir_cosine")), "inherited")
    result = keyed.select("path", "key", parent.alias("dir")).join(best.select("key", "license", "cosine"), "key", "left").join(nearest, "dir", "left")
    has = F.col("license").isNotNull()
    origin = F.when(has, "own").when(F.col("dir_license").isNotNull(), "inherited").otherwise("none")
    return result.select("path", F.coalesce("license", "dir_license").alias("license"), F.coalesce("cosine", "dir_cosine").alias("cosine"), origin.alias("origin"), F.when(~has, F.col("from_dir")).alias("from_dir"))


def query(spark, sf_dir: str) -> DataFrame:
    """Documents as files <source>/<lang>/<doc_id div 50>/<doc_id>.txt."""
    docs = common.table(spark, sf_dir, "documents")
    path = F.concat_ws("/", F.col("source"), F.col("lang"), F.expr("doc_id div 50").cast("string"), F.concat(F.col("doc_id").cast("string"), F.lit(".txt")))
    found = scan(docs.select(path.alias("path"), "text"))
    return found.select(F.regexp_extract("path", r"([0-9]+)\.txt$", 1).cast("long").alias("doc_id"), "path", "license", F.round("cosine", 6).alias("cosine"), "origin", "from_dir")
