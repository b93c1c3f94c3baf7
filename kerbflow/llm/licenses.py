"""Licences of files: TF-IDF cosine of statements to templates, then inheritance from the nearest directory.

Only DataFrame functions. Document frequencies of the templates' terms are counted over all whole texts. A text is
cut into lines and sentences; those that hold a marker word become sparse vectors, are joined to the templates' terms
and summed to cosines. Terms outside the templates enter a vector's length as terms of the largest weight. A file in
which statements make up half of the words, or with a usual name, is a licence file: it gives its licence to its
directory, and files without a statement of their own take that of the nearest directory above them.

Defined cases: null and empty texts have no statement, but inherit; a null path is a file without directories;
ties go to the alphabetically first licence; repeated rows get equal results each; an empty table gives no rows;
other columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kerbflow.llm.license_templates import templates
from kerbflow.session import materialise

MARKERS = ("licen", "copyright", "public domain", "copies", "permission", "cc by", "cc0")
FILE_NAMES = r"(?i)^(licen[cs]e|copying|unlicense)(\.[a-z]+)?$"
LEAST = 0.75
_CUT = r"\n|(?<=[.!?])\s"


def terms(text: Column) -> Column:
    """Lower-case words of letters, digits and inner dots."""
    words = F.transform(F.split(F.lower(text), "[^a-z0-9.]+"), lambda w: F.btrim(w, F.lit(".")))
    return F.filter(words, lambda w: w != "")


def plain_terms(text: str) -> list[str]:
    """The same for the templates' ASCII texts."""
    words = "".join(c if c in "abcdefghijklmnopqrstuvwxyz0123456789." else " " for c in text.lower()).split()
    return [w.strip(".") for w in words if w.strip(".")]


def vocabulary() -> list[str]:
    return sorted({w for _, text in templates() for w in plain_terms(text)})


def document_frequencies(texts: DataFrame) -> tuple[int, dict[str, int]]:
    """Number of texts, and of texts with each template term (one small row a term)."""
    words = F.array(*[F.lit(w) for w in vocabulary()])
    held = texts.select(F.array_intersect(terms(F.coalesce("text", F.lit(""))), words).alias("held"))
    rows = held.select(F.explode(F.concat("held", F.array(F.lit("")))).alias("term")).groupBy("term").count().collect()
    found = {r.term: r["count"] for r in rows}
    return found.pop("", 0), found


def weights(total: int, frequencies: dict[str, int]) -> tuple[list[tuple[str, int, str, float]], dict[str, float], float]:
    """(term, template, licence, weight in the template's unit vector), the terms' IDF, and the largest IDF."""
    idf = {w: math.log((1 + total) / (1 + frequencies.get(w, 0))) + 1 for w in vocabulary()}
    rows = []
    for number, (spdx, text) in enumerate(templates()):
        counts = Counter(plain_terms(text))
        length = math.sqrt(sum((n * idf[w]) ** 2 for w, n in counts.items()))
        rows += [(w, number, spdx, n * idf[w] / length) for w, n in sorted(counts.items())]
    return rows, idf, math.log(1 + total) + 1


def _values(df: DataFrame, rows: list[tuple], names: str) -> DataFrame:
    text = lambda v: f"'{v}'" if isinstance(v, str) else f"{v!r}D" if isinstance(v, float) else str(v)
    return df.sparkSession.sql(f"SELECT * FROM VALUES {', '.join('(' + ', '.join(map(text, r)) + ')' for r in rows)} AS t({names})")


def statements(files: DataFrame) -> DataFrame:
    """(path, text_key, n_terms, segment) of every segment with a marker word."""
    lowered = F.lower("text")
    marked = lambda c: F.greatest(*[F.contains(c, F.lit(m)) for m in MARKERS])
    rows = files.where(marked(lowered)).select("path", F.xxhash64("text").alias("text_key"), F.size(terms(F.col("text"))).alias("n_terms"), F.explode(F.split(lowered, _CUT)).alias("segment"))
    return rows.where(marked(F.col("segment"))).distinct()


def match_segments(segments: DataFrame, total: int, frequencies: dict[str, int], least: float = LEAST) -> DataFrame:
    """(segment, license, score, matched) of distinct segments whose best cosine reaches ``least``; matched counts its words."""
    rows, idf, most = weights(total, frequencies)
    table = F.broadcast(_values(segments, rows, "term, template, license, weight"))
    known = F.broadcast(_values(segments, sorted(idf.items()), "term, idf"))
    counted = segments.select("segment").distinct().select("segment", F.explode(terms(F.col("segment"))).alias("term")).groupBy("segment", "term").agg(F.count(F.lit(1)).alias("tf"))
    counted = counted.join(known, "term", "left").withColumn("value", F.col("tf") * F.coalesce("idf", F.lit(most)))
    lengths = counted.groupBy("segment").agg(F.sqrt(F.sum(F.col("value") * F.col("value"))).alias("length"), F.sum("tf").alias("matched"))
    dots = counted.join(table, "term").groupBy("segment", "template", "license").agg(F.sum(F.col("value") * F.col("weight")).alias("dot"))
    cosines = dots.join(lengths, "segment").select("segment", "license", F.round(F.col("dot") / F.col("length"), 9).alias("score"), "matched").where(F.col("score") >= least)
    best = cosines.groupBy("segment").agg(F.min(F.struct((-F.col("score")).alias("s"), F.col("license"))).alias("b"), F.first("matched").alias("matched"))
    return best.select("segment", F.col("b.license").alias("license"), (-F.col("b.s")).alias("score"), "matched")


def directory(path: Column) -> Column:
    """All before the last slash; null without one."""
    return F.when(F.contains(path, F.lit("/")), F.regexp_replace(path, "/[^/]*$", ""))


def ancestors(folder: Column) -> Column:
    """The directory and all above it, the root (empty text) included, with their depth."""
    parts = F.split(folder, "/")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.struct(F.array_join(F.slice(parts, F.lit(1), n), "/").alias("folder"), n.alias("depth")))


def scan(files: DataFrame, least: float = LEAST) -> DataFrame:
    """(path, license, score, found, folder) for every row of files (path, text).

    ``found`` is ``statement`` (with the cosine), ``inherited`` (with the directory) or null.
    """
    files = files.select("path", "text")
    total, frequencies = document_frequencies(files)
    candidates = materialise(statements(files), "license-segments")
    matched = materialise(match_segments(candidates, total, frequencies, least), "license-matches")
    hits = candidates.join(matched, "segment")
    own = hits.groupBy("path", "text_key").agg(F.min(F.struct((-F.col("score")).alias("s"), F.col("license"))).alias("b"), F.sum("matched").alias("matched"), F.first("n_terms").alias("n_terms"))
    name = F.regexp_replace("path", "^.*/", "")
    own = own.select("path", "text_key", F.col("b.license").alias("license"), (-F.col("b.s")).alias("score"), ((2 * F.col("matched") >= F.col("n_terms")) | F.coalesce(F.regexp_like(name, F.lit(FILE_NAMES)), F.lit(False))).alias("is_file"))
    own = materialise(own, "license-own")
    folders = own.where("is_file").select(directory(F.col("path")).alias("folder"), "path", "license", "score").where("folder IS NOT NULL")
    folders = folders.groupBy("folder").agg(F.min(F.struct((-F.col("score")).alias("s"), F.col("license"), F.col("path"))).alias("b")).select("folder", F.col("b.license").alias("license"))
    rows = files.select("path", F.xxhash64("text").alias("text_key"), directory(F.col("path")).alias("home"))
    above = rows.select("home").where("home IS NOT NULL").distinct().select("home", F.explode(ancestors(F.col("home"))).alias("a")).select("home", F.col("a.folder").alias("folder"), F.col("a.depth").alias("depth"))
    given = above.join(folders, "folder").groupBy("home").agg(F.max_by(F.struct("license", "folder"), "depth").alias("given"))
    marked = own.select(F.col("path").alias("p"), F.col("text_key").alias("k"), "license", "score")
    joined = rows.join(marked, F.col("path").eqNullSafe(F.col("p")) & (F.col("text_key") == F.col("k")), "left").join(given, "home", "left")
    stated = F.col("license").isNotNull()
    return joined.select("path", F.coalesce("license", "given.license").alias("license"), "score", F.when(stated, "statement").when(F.col("given").isNotNull(), "inherited").alias("found"), F.when(~stated, F.col("given.folder")).alias("folder"))
