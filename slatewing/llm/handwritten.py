"""Generated, minified, vendored or data-holding source files (problem 3), by a linear classifier.

Rows are labelled weakly, by giveaways (headers of generators and licences, folders and names that
only tools and package managers make, texts that are mostly literals or have hardly any lines). A linear support-vector classifier learns from hashed
character n-grams and path components with those giveaways masked, so that it recognises the files
that carry none. Projects are held out for validation. Every row is scored; a file is judged by all
its rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slatewing.session import durable

#: Rows of each label that the classifier is fitted on, at most (chosen by a hash of their id).
SAMPLE_ROWS = 3000
#: Hashed dimensions, n-gram length, passes of the solver, regularisation, held-out share of projects.
DIMENSIONS, GRAM, PASSES, COST, HELD_OUT = 1 << 15, 4, 12, 1.0, 5

#: Phrases of headers that tools and licences write.
_HEADER = (
    r"auto-?\s?generated|<auto-generated|generated (?:by|from|with|using) [\w./-]+|@generated|do not (?:edit|modify|change)|code generated"
    r"|manual changes will be lost|hand edits (?:get|are|will be) (?:overwritten|lost)|overwritten (?:by|on|at) (?:each|every|the next)|rebuilt on each|edit the grammar instead|source: \S+\.(?:proto|thrift|avsc|xsd|wsdl|g4|fbs)"
    r"|automatisch (?:erzeugt|generiert)|nicht bearbeiten|est produit par|ne pas modifier|généré automatiquement|generado automáticamente|no editar"
    r"|自动生成|请勿手工?修改|自動生成|licen[cs]e at |permission is (?:hereby )?g(?:iven|ranted)|\(c\) the [\w.-]+ contributors|spdx-license|licensed under|all rights reserved"
)
_GENERATED_ANNOTATION = r"@(?:javax\.annotation\.(?:processing\.)?|jakarta\.annotation\.)?Generated\s*\("
#: Folders and name parts that only tools and package managers make.
_PLACES = r"(?:^|/)(?:node_modules|bower_components|third[_-]party|generated|generated-sources|generated-src|__generated__|build/gen|target/gen)/|\.(?:min|bundle|generated)\.\w+$|\.pb\.\w+$"
#: What may stand before the first declaration: comments, package and import lines, annotations.
_COMMENT = r"/\*[\s\S]*?\*/|//[^\n]*+|<!--[\s\S]*?-->"
_HEAD = rf"\A(?:\s++|{_COMMENT}|(?:package|import)\b[^\n]*+|@(?!interface\b)[^\n]*+)*+"
_HEAD_RE, _COMMENT_RE = re.compile(_HEAD), re.compile(_COMMENT)
_PACKAGE = re.compile(r"^\s*(?:package|import(?:\s+static)?)\s+([\w.]+)", re.M)
_MASKED = re.compile(rf"{_GENERATED_ANNOTATION}[^)]*\)|//# ?sourceMappingURL=\S+|/\*!.*", re.I)
_FOLDED = re.compile(r"\d+")


def file_key(path: Column) -> Column:
    """One spelling for a path: slashes, no empty or dot steps."""
    p = F.regexp_replace(F.trim(path), r"\\", "/")
    p = F.regexp_replace(p, r"/+", "/")
    p = F.regexp_replace(p, r"(?:^|(?<=/))(?:\./)+", "")
    return F.regexp_replace(p, r"^/", "")


def weak_label(key: Column, content: Column) -> Column:
    """1 for rows with a giveaway, else 0."""
    # possessive repetitions: no backtracking, whatever the text
    head = F.regexp_extract(content, _HEAD, 0)
    size = F.length(content)
    # numbers and strings without blanks: a long query or message is no data
    plain = F.length(F.regexp_replace(content, r"\"[^\"\s]*+\"|'[^'\s]*+'|\(byte\)\s?|0x[0-9a-fA-F]++|[0-9.]++", ""))
    inserts = (size - F.length(F.replace(content, F.lit("INSERT INTO"), F.lit("")))) / 11
    code = key.rlike(r"\.(?:java|js|ts|py|kt|go|c|h|cpp|cs|sql)$")
    data = code & (size > 600) & ((plain < 0.5 * size) | ((inserts >= 10) & (inserts * 110 > size)))
    lines = size - F.length(F.replace(content, F.lit("\n"), F.lit(""))) + 1
    packed = key.rlike(r"\.(?:js|mjs|css)$") & (size > 600) & (size > 200 * lines)
    given = head.rlike(f"(?i){_HEADER}") | head.rlike(_GENERATED_ANNOTATION) | key.rlike(f"(?i){_PLACES}") | data | packed
    return F.when(given, 1).otherwise(0)


def _hash(text: str) -> int:
    h = 2166136261
    for b in text.encode():
        h = ((h ^ b) * 16777619) & 0xFFFFFFFF
    return h % DIMENSIONS


def _path_features(path: str, content: str) -> list[str]:
    parts = _FOLDED.sub("0", path).split("/")
    name = parts[-1]
    out = [f"dir:{p.lower()}" for p in parts[:-1] if not re.search(_PLACES, f"{p}/", re.I)]
    for word in re.findall(r"[A-Z][a-z]+|[a-z]+|[A-Z]+", name.split(".")[0])[-1:]:
        out.append(f"last:{word.lower()}")
    out += [f"ext:{e}" for e in name.split(".")[-1:]]
    out += [f"pair:{a}/{b}" for a, b in zip(parts[-3:-1], parts[-2:-1])]
    if m := re.search(r"^\s*package\s+([\w.]+)\s*;", content, re.M):
        out.append("home" if f"/{m.group(1).replace('.', '/')}/" in f"/{path}" else "moved")
    if library(path, content):
        out.append("named after its root")
    return out


def library(path: str, content: str) -> str | None:
    """The package root (three parts) that names a Java file's type: its own package, or one that it
    imports, whose last part the type's name begins with."""
    name = path.rsplit("/", 1)[-1]
    if not name.endswith(".java"):
        return None
    for m in _PACKAGE.finditer(_HEAD_RE.match(content).group()):
        root = m.group(1).split(".")[:3]
        if len(root) == 3 and len(root[2]) > 4 and name.lower().startswith(root[2].lower()):
            return ".".join(root)
    return None


def features(path: str, content: str) -> tuple[np.ndarray, np.ndarray]:
    """Sparse vector of unit length: logs of hashed n-gram counts of the masked text, and the path."""
    head = _HEAD_RE.match(content).group()
    text = _FOLDED.sub("0", _MASKED.sub("", _COMMENT_RE.sub("", head) + content[len(head) :]))
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    if len(codes) >= GRAM:
        n = len(codes) - GRAM + 1
        h = np.zeros(n, np.uint32)
        for k in range(GRAM):
            h = h * np.uint32(16777619) + codes[k : k + n]
        h ^= h >> np.uint32(15)
        counts = np.bincount(h % np.uint32(DIMENSIONS), minlength=DIMENSIONS)
        index = np.flatnonzero(counts)
        value = np.log1p(counts[index])
        value /= np.sqrt(value @ value)
        longest = max(map(len, text.split("\n")))
    else:
        index, value, longest = np.zeros(0, np.int64), np.zeros(0), len(codes)
    extra = [*_path_features(path, content), f"long:{min(longest, 40_000).bit_length()}"]
    own = np.array([_hash(f) for f in extra], np.int64)
    return np.concatenate((index, own)), np.concatenate((value, np.full(len(own), 0.25)))


@dataclass
class Classifier:
    weights: np.ndarray
    bias: float
    held_out_rows: int
    held_out_agreement: float

    def score(self, path: str, content: str) -> float:
        index, value = features(path, content)
        return float(self.weights[index] @ value + self.bias)


def _solve(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray) -> tuple[np.ndarray, float]:
    """Dual coordinate descent for the squared hinge loss; the bias is a constant feature."""
    weights, bias = np.zeros(DIMENSIONS), 0.0
    alpha = np.zeros(len(rows))
    share = {s: len(rows) / (2 * max(1, int((labels == s).sum()))) for s in (-1, 1)}
    diagonal = np.array([0.5 / (COST * share[y]) for y in labels])
    norms = np.array([v @ v + 1 for _, v in rows]) + diagonal
    order = np.random.default_rng(7)
    for _ in range(PASSES):
        for i in order.permutation(len(rows)):
            index, value = rows[i]
            y = labels[i]
            gradient = y * (weights[index] @ value + bias) - 1 + diagonal[i] * alpha[i]
            new = max(0.0, alpha[i] - gradient / norms[i])
            if new != alpha[i]:
                step = (new - alpha[i]) * y
                np.add.at(weights, index, step * value)
                bias += step
                alpha[i] = new
    return weights, bias


def _projects(tasks: DataFrame) -> DataFrame:
    return tasks.where("id is not null").groupBy(F.col("id").alias("task_id")).agg(F.min("project_id").alias("project_id"))


def fit(chunks: DataFrame, tasks: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Classifier:
    """Fit on at most ``sample_rows`` rows of each weak label.

    Unlabelled rows are taken as hand-written at first; those that the first fit puts clearly on the
    other side are left out of the second. One in ``HELD_OUT`` projects is kept for validation.
    """
    projects = _projects(tasks)
    key = file_key(F.col("file_path"))
    rows = chunks.where("id is not null and file_path is not null and length(content) > 0").select("id", "task_id", key.alias("path"), "content")
    # the choice is made on ids alone; only the chosen rows' texts are read again
    rank = F.xxhash64("id", F.lit("sample"))
    # one pass over the texts for both labels: ids, labels and ranks go to the checkpoint folder
    ranked = durable(rows.select("id", weak_label(F.col("path"), F.col("content")).alias("label"), rank.alias("rank")))
    chosen = [r for s in (0, 1) for r in ranked.where(F.col("label") == s).orderBy("rank", "id").limit(sample_rows).collect()]
    session = chunks.sparkSession
    picked = session.createDataFrame([(r.id, r.label) for r in chosen], "id long, label int").distinct()
    sample = rows.join(F.broadcast(picked), "id").join(projects, "task_id", "left").repartition(session.sparkContext.defaultParallelism)

    def extract(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            made = [features(p, c) for p, c in zip(frame["path"], frame["content"])]
            yield pd.DataFrame({
                "label": frame["label"], "project": frame["project_id"],
                "index": [i.astype(np.int32).tobytes() for i, _ in made], "value": [v.astype(np.float32).tobytes() for _, v in made],
            })

    data = sample.mapInPandas(extract, "label int, project string, index binary, value binary").collect()
    if not len(data):
        return Classifier(np.zeros(DIMENSIONS), -1.0, 0, 0.0)
    data.sort(key=lambda r: (r["label"], bytes(r["index"]), bytes(r["value"])))  # rows arrive in any order
    made = [(np.frombuffer(r["index"], np.int32).astype(np.int64), np.frombuffer(r["value"], np.float32).astype(np.float64)) for r in data]
    labels = np.array([1 if r.label == 1 else -1 for r in data])
    held = np.array([_hash(str(r.project)) % HELD_OUT == 0 for r in data])
    use = np.flatnonzero(~held)
    weights, bias = _solve([made[i] for i in use], labels[use])
    margins = np.array([weights[i] @ v + bias for i, v in made])
    use = np.flatnonzero(~held & ~((labels == -1) & (margins > -0.2)))
    weights, bias = _solve([made[i] for i in use], labels[use])
    margins = np.array([weights[i] @ v + bias for i, v in made])
    agree = float((np.sign(margins[held]) == labels[held]).mean()) if held.any() else 0.0
    return Classifier(weights, bias, int(held.sum()), agree)


def file_scores(chunks: DataFrame, model: Classifier) -> DataFrame:
    """``(task_id, path, score, characters, spellings)`` for each file of each task.

    A file's score is the mean of its rows' scores by length.
    """
    weights, bias = model.weights.astype(np.float32), model.bias
    shared = chunks.sparkSession.sparkContext.broadcast(weights)  # DIMENSIONS numbers, whatever the input

    def score(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        w = shared.value
        for frame in frames:
            rows = []
            for path, content in zip(frame["path"], frame["content"]):
                index, value = features(path, content)
                rows.append((float(w[index] @ value + bias), len(content)))
            made = pd.DataFrame(rows, columns=["score", "size"])
            yield pd.concat([frame[["task_id", "file_path", "path"]].reset_index(drop=True), made], axis=1)

    rows = chunks.where("task_id is not null and file_path is not null and length(content) > 0").select(
        "task_id", "file_path", file_key(F.col("file_path")).alias("path"), "content"
    )
    scored = rows.mapInPandas(score, "task_id string, file_path string, path string, score double, size long")
    return scored.groupBy("task_id", "path").agg(
        (F.sum(F.col("score") * F.col("size")) / F.sum("size")).alias("score"),
        F.sum("size").alias("characters"),
        F.collect_set("file_path").alias("spellings"),
    )


def files_not_handwritten(chunks: DataFrame, tasks: DataFrame, sample_rows: int = SAMPLE_ROWS, threshold: float = -0.1) -> DataFrame:
    """``(task_id, file_path)``, with each spelling that occurs, of the files that were not written by
    hand for the project.

    Rows with null task_id, file_path or content, and empty contents, take no part. A row delivered
    twice counts once or twice alike.
    """
    model = fit(chunks, tasks, sample_rows)
    files = file_scores(chunks, model).where(F.col("score") > threshold)
    return files.select("task_id", F.explode("spellings").alias("file_path")).distinct()
