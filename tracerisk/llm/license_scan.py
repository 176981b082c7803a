"""License scans: TF-IDF cosine of headers and licence files, then inheritance by directory."""

from collections import Counter
from collections.abc import Iterator, Sequence
from math import log, sqrt
from pathlib import Path

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracerisk.llm.common import blocks, with_columns
from tracerisk.llm.near_dedup import small
from tracerisk.sources import materialize

# Templates: licence and the words of its notices (fixed values).
TEMPLATES = (
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("GPL-3.0", "GNU General Public License as published by the Free Software Foundation, either version 3"),
    ("GPL-2.0", "GNU General Public License as published by the Free Software Foundation, either version 2"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Apache License Version 2.0, January 2004"),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("BSD", "Redistribution and use in source and binary forms, with or without modification"),
    ("proprietary", "All rights reserved."),
)
WORDS = regex.compile(r"[\p{L}\p{N}]+(?:[.-]\p{N}+)*").findall
# Words of a header at most, and by how many the next one in a long line starts later.
HEADER_WORDS, STEP = 32, 16
LEAST_COSINE = 0.75
# Least cosine with a whole licence text, or of a section with one of its sections.
TEXT_COSINE = 0.8
# Share of a text's words that its licence text has in a licence file.
FILE_SHARE = 0.5
# Names that make a file with licence text a licence file (fixed values).
FILE_NAMES = "(?i)^(licen[cs]e|copying|unlicense)([.-][a-z0-9.-]+)?$"
# Words rarer than this share of the documents weigh as if they had it, and words outside the templates
# weigh WORD_WEIGHT: so weights, hence verdicts, depend on shares only, not on the size of the corpus.
LEAST_SHARE, WORD_WEIGHT = 1e-3, 3.0
FOUND = "license string, cosine double, is_file boolean"


def words_of(text: str) -> list[str]:
    return WORDS(text.lower())


def headers(words: list[str], lines: list[int]) -> Iterator[tuple[int, list[str]]]:
    """Place and words of every line, the lines given by their first word's place; long ones in overlapping windows."""
    for start, end in zip(lines, [*lines[1:], len(words)], strict=True):
        for i in range(start, max(start + 1, end - STEP), STEP):
            if start < end:
                yield i, words[i : min(i + HEADER_WORDS, end)]


def license_texts() -> list[tuple[str, str]]:
    """Name and whole text of every licence in `license_texts` beside this module; read by the driver."""
    files = sorted((Path(__file__).parent / "license_texts").glob("*.txt"))
    return [(f.stem, f.read_text("utf-8")) for f in files]


def sections(text: str) -> list[list[str]]:
    """Words of each run of lines that hold words; marks of a comment are no words."""
    runs: list[list[str]] = [[]]
    for line in text.split("\n"):
        words = words_of(line)
        if words:
            runs[-1].extend(words)
        elif runs[-1]:
            runs.append([])
    return [run for run in runs if run]


class Vectors:
    """Sparse TF-IDF vectors of some templates; words outside them have a fixed weight."""

    def __init__(self, templates: Sequence[Sequence[str]], seen: dict[str, int], n: int):
        counts = [Counter(words) for words in templates]
        share = {w: min(seen.get(w, 0), n) / n if n else 0.0 for w in set().union(*counts)}
        self.idf = {w: 1 - log(max(s, LEAST_SHARE)) for w, s in share.items()}
        self.lengths = [len(words) for words in templates]
        self.units: list[dict[str, float]] = []
        self.rows: dict[str, list[tuple[int, float]]] = {}
        for i, words in enumerate(counts):
            vector = {w: k * self.idf[w] for w, k in words.items()}
            norm = sqrt(sum(x * x for x in vector.values()))
            self.units.append({w: x / norm for w, x in vector.items()})
            for w, x in self.units[-1].items():
                self.rows.setdefault(w, []).append((i, x))

    def cosine(self, words: Sequence[str], i: int) -> float:
        """Cosine of some words and template `i`."""
        square = dot = 0.0
        for w, k in Counter(words).items():
            x = k * self.idf.get(w, WORD_WEIGHT)
            square += x * x
            dot += x * self.units[i].get(w, 0.0)
        return dot / sqrt(square) if square else 0.0

    def best(self, words: Sequence[str]) -> tuple[float, int]:
        """Cosine and number of the nearest template; ties go to the earlier one."""
        if self.idf.keys().isdisjoint(words):
            return 0.0, -1
        square, dots = 0.0, {}
        for w, k in Counter(words).items():
            x = k * self.idf.get(w, WORD_WEIGHT)
            square += x * x
            for i, y in self.rows.get(w, ()):
                dots[i] = dots.get(i, 0.0) + x * y
        i = min(dots, key=lambda t: (-dots[t], t))
        return dots[i] / sqrt(square), i

    def covers(self, words: set[str], i: int, least: float) -> bool:
        """Whether the words make a cosine of `least` with template `i` possible (Cauchy and Schwarz)."""
        return sum(y * y for w, y in self.units[i].items() if w in words) >= least * least - 1e-9

    def anchors(self, least: float) -> dict[str, list[int]]:
        """Words, rarest first, one of which a text must share with a template to reach the cosine."""
        found: dict[str, list[int]] = {}
        for i, unit in enumerate(self.units):
            rest = 1.0
            for w in sorted(unit, key=lambda w: (-self.idf[w], -unit[w], w)):
                if rest < least * least - 1e-9:
                    break
                found.setdefault(w, []).append(i)
                rest -= unit[w] ** 2
        return found


class Matcher:
    """Nearest notice of a text's lines and word windows, and nearest licence text of its whole and sections."""

    def __init__(
        self,
        templates: Sequence[tuple[str, str]],
        seen: dict[str, int],
        n: int,
        texts: Sequence[tuple[str, str]] = (),
        least: float = LEAST_COSINE,
        least_text: float = TEXT_COSINE,
    ):
        self.least, self.least_text = least, least_text
        self.names = [name for name, _ in templates]
        self.notices = Vectors([words_of(t) for _, t in templates], seen, n)
        self.anchors = self.notices.anchors(least)
        self.titles = [name for name, _ in texts]
        self.wholes = Vectors([words_of(t) for _, t in texts], seen, n)
        self.keys = self.wholes.anchors(least_text)
        parts = [(i, part) for i, (_, t) in enumerate(texts) for part in sections(t)]
        self.owner = [i for i, _ in parts]
        self.parts = Vectors([part for _, part in parts], seen, n)
        self.part_keys = self.parts.anchors(least_text)

    def windows(self, words: list[str]) -> Iterator[tuple[float, int, int]]:
        """Cosine, notice and start of every window of a notice's own length that reaches `least`."""
        starts: dict[int, set[int]] = {}
        for at, w in enumerate(words):
            for i in self.anchors.get(w, ()):
                size = self.notices.lengths[i]
                starts.setdefault(i, set()).update(range(max(0, at - size + 1), min(at, len(words) - size) + 1))
        for i in sorted(starts):
            size = self.notices.lengths[i]
            for start in sorted(starts[i]):
                cosine = self.notices.cosine(words[start : start + size], i)
                if cosine >= self.least:
                    yield cosine, i, start

    def matches(self, run: list[str], licence: int) -> bool:
        """Whether a section is like one of a licence's sections."""
        near = {k for w in self.part_keys.keys() & set(run) for k in self.part_keys[w] if self.owner[k] == licence}
        return any(self.parts.cosine(run, k) >= self.least_text for k in near)

    def licence_text(self, text: str, words: list[str]) -> tuple[str | None, float, bool]:
        """Licence whose text this is or holds, its cosine, and whether it makes up most of the words.

        The whole text is compared first, then its sections that match one of the licence,
        joined. The licence that takes up most words counts (one of three clauses holds one of
        two), then the larger cosine, then the earlier licence.
        """
        found: tuple[str | None, float, bool] = (None, 0.0, False)
        most = (0, 0.0)
        held = set(words)
        runs: list[list[str]] | None = None
        for i in sorted({i for w in self.keys.keys() & held for i in self.keys[w]}):
            if not self.wholes.covers(held, i, self.least_text):
                continue
            cosine, size = self.wholes.cosine(words, i), len(words)
            if cosine < self.least_text:
                runs = sections(text) if runs is None else runs
                own = [run for run in runs if self.matches(run, i)]
                joined = [w for run in own for w in run]
                cosine, size = self.wholes.cosine(joined, i), len(joined)
            if cosine >= self.least_text and (size, cosine) > most:
                most = size, cosine
                found = self.titles[i], cosine, size >= FILE_SHARE * len(words)
        return found

    def __call__(self, text: str) -> tuple[str | None, float, bool]:
        """Licence of the text, the cosine that tells it, and whether licence text makes up most of it."""
        words: list[str] = []
        lines = []
        for line in text.split("\n"):
            lines.append(len(words))
            words.extend(words_of(line))
        name, cosine, is_file = self.licence_text(text, words)
        if name is not None:
            return name, cosine, is_file
        top, nearest, own = 0.0, -1, bytearray(len(words))
        for start, header in headers(words, lines):
            cosine, i = self.notices.best(header)
            if cosine >= self.least:
                own[start : start + len(header)] = b"\1" * len(header)
            if cosine > top:
                top, nearest = cosine, i
        for cosine, i, start in self.windows(words):
            size = self.notices.lengths[i]
            own[start : start + size] = b"\1" * size
            if (-cosine, i) < (-top, nearest):
                top, nearest = cosine, i
        if top < self.least:
            return None, top, False
        return self.names[nearest], top, sum(own) >= FILE_SHARE * len(words)


def _seen(docs: DataFrame, templates: Sequence[tuple[str, str]]) -> tuple[dict[str, int], int]:
    """Documents that hold each word of the templates, over all documents: a bounded vocabulary."""
    vocabulary = set().union(*(words_of(t) for _, t in templates))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[str] = Counter()
        for batch in batches:
            for _, texts in blocks(batch.column(0)):
                for text in texts:
                    counts.update(vocabulary.intersection(words_of(text)))
                    counts[""] += 1
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())],
            names=["word", "n"],
        )

    counted = docs.mapInArrow(run, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))
    seen = {r["word"]: r["n"] for r in counted.collect()}
    return seen, seen.pop("", 0)


def parent(path: Column) -> Column:
    """Directory of a path, empty for one at the root."""
    return F.regexp_extract(path, "^(.*)/[^/]*$", 1)


def scan_licenses(
    docs: DataFrame,
    path: Column,
    text: str = "text",
    doc_id: str = "doc_id",
    templates: Sequence[tuple[str, str]] = TEMPLATES,
    least: float = LEAST_COSINE,
    texts: Sequence[tuple[str, str]] | None = None,
    least_text: float = TEXT_COSINE,
) -> DataFrame:
    """doc_id, path, license, cosine and origin of every document.

    All vectors are TF-IDF vectors whose document frequencies come from all documents. A whole
    text is compared with the whole licence texts (those beside this module, unless `texts`
    gives others), then those of its sections that are like one of a licence's sections, joined.
    Where no licence text is found, the notices of `templates` are compared with every line and with
    every window of a notice's own length, wherever it lies. `cosine` is that of the licence
    text found, else of the nearest notice; below `least` it is that of the nearest line.
    A licence text goes before a notice, a larger cosine before a smaller one, then the earlier template.

    `origin` is `file` where licence text or notices make up half of the words or the file is
    named as licence files are, `header` for other texts
    with a licence, `inherited` for texts without one that have a licence file in
    their directory or the nearest directory above, and `none`.
    Of several files in a directory the one with the largest cosine counts, then the smallest path
    and the smallest id. Directories are joined as distinct paths with their
    ancestors; files and results by directory are broadcast up to a checked size.

    One row per row that goes in. Null and empty texts have no header; a null path
    has no directory to inherit from. Without templates and texts no text has a licence.
    """
    rows = docs.select(
        F.col(doc_id).alias("doc_id"), path.cast("string").alias("path"), F.col(text).alias("text")
    )
    bodies = license_texts() if texts is None else list(texts)
    seen, n = _seen(rows.select("text"), [*templates, *bodies])
    made: list[Matcher] = []

    def run(block):
        if not made:
            made.append(Matcher(templates, seen, n, bodies, least, least_text))
        found = [made[0](t) for t in block]
        return [list(x) for x in zip(*found, strict=True)]

    scanned = with_columns(rows, "text", FOUND, run, keep=["doc_id", "path"])
    name = F.regexp_extract("path", "[^/]*$", 0)
    called = F.coalesce(F.regexp_like(name, F.lit(FILE_NAMES)), F.lit(False))
    scanned = scanned.withColumn("is_file", F.col("license").isNotNull() & (F.col("is_file") | called))
    scanned = materialize(scanned.withColumn("dir", parent(F.col("path"))))
    order = F.struct((-F.col("cosine")).alias("c"), "path", "doc_id", "license")
    files = (
        scanned.filter(F.col("is_file") & F.col("path").isNotNull())
        .groupBy("dir")
        .agg(F.min(order)["license"].alias("inherited"))
    )
    files = materialize(files.withColumnRenamed("dir", "above"))
    wanting = scanned.filter(F.col("license").isNull() & F.col("dir").isNotNull())
    parts = F.split("dir", "/")
    above = F.transform(
        F.sequence(F.lit(0), F.size(parts)), lambda k: F.array_join(F.slice(parts, 1, k), "/")
    )
    ancestors = wanting.select("dir").distinct().select("dir", F.explode(above).alias("above"))
    nearest = (
        ancestors.distinct()
        .join(small(files), "above")
        .groupBy("dir")
        .agg(F.max_by("inherited", F.length("above")).alias("inherited"))
    )
    found = scanned.join(small(materialize(nearest)), "dir", "left")
    own = F.col("license").isNotNull()
    origin = (
        F.when(own & F.col("is_file"), "file")
        .when(own, "header")
        .when(F.col("inherited").isNotNull(), "inherited")
        .otherwise("none")
    )
    return found.select(
        "doc_id", "path", F.coalesce("license", "inherited").alias("license"), "cosine", origin.alias("origin")
    )
