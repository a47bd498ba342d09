"""Subject areas of documents (problem 8), by a distributed latent Dirichlet topic model.

The model is the variant of latent Dirichlet allocation for texts of short units (sentence LDA with a background,
Jo and Oh 2011, Zhao et al. 2011): a document has Dirichlet-distributed proportions of topics, each of its sentences is
about one topic or about none, and each word of a sentence comes from its topic or from the language at large.

1. Texts become sentences of word hashes once, in a table in the checkpoint folder. Words of enough documents are kept.
2. One topic an area is started from the words that rated documents of the area hold more often than the others and
   from those of its description; these words also stay the topic's prior (guided topics). Nothing else is
   told to the model, and unrated documents are fitted like rated ones.
3. Expectation maximisation over all documents: the topics go out as one small table, each partition weighs its
   sentences and sends back one table of counts.
4. Topics are mapped to areas by their top terms; a topic whose top terms speak for no area stays without one.
5. A document is about the areas whose topics hold enough of its proportions, over all its sentences. Sentences made
   of the words of quoted evaluation passages do not count.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slatewing.session import durable

#: Rounds of the fit (from three on the areas hardly change any more); passes over a document's sentences within one.
ROUNDS, PASSES = 4, 2
#: A word takes part if it stands in so many documents and in this share of them (which bounds the vocabulary by
#: the words of one document / LEAST_SHARE, however many documents there are).
LEAST_DOCUMENTS, LEAST_SHARE = 3, 1e-4
#: Share of words that come from the language at large; of sentences that are about an area, before they are read.
BACKGROUND, ON_TOPIC = 0.85, 0.85
#: Dirichlet parameters: of a document's topics, of a topic's words; documents that a starting word counts like,
#: as a multiple of an area's rated documents.
ALPHA, BETA, GUIDANCE = 0.3, 0.001, 20.0
#: A word starts a topic if the area has this share of its rates in rated documents; rate of a word of the description.
SEED_SHARE, DESCRIBED = 0.35, 0.05
#: A sentence counts for a topic in the fit from this probability on.
LEAST_PROBABILITY = 0.3
#: A word speaks for a topic if it adds so much to its score.
SPEAKS = 0.5
TOP_TERMS = 20
#: Share of a document's sentences that makes it one about an area.
ABOUT_SHARE = 0.25
#: Share of a sentence's words that must come from quoted passages for it to be left out.
QUOTED_SHARE = 0.8

_ENTITY = re.compile(r"&#?\w{1,10};")
_TAG = re.compile(r"<[^<>]{1,60}>")
_BREAK = re.compile(r"[.!?。]\s+|\n+")
_BLOCK_ENDS = ("</p>", "</li>", "<br>", "<br/>", "<br />")
_CASE = re.compile(r"([a-zß-ÿ])([A-Z])")
_WORD = re.compile(r"[^\W\d_]{3,}")


def sentences(text: str) -> list[list[str]]:
    """Words of three letters or more of each sentence, line or list item that has two of them."""
    out = []
    if "&" in text:
        text = _ENTITY.sub(" ", text)
    if "<" in text:
        for mark in _BLOCK_ENDS:
            text = text.replace(mark, "\n")
    for part in _BREAK.split(_CASE.sub(r"\1 \2", text).lower()):
        if part:
            words = _WORD.findall(_TAG.sub(" ", part) if "<" in part else part)
            if len(words) > 1:
                out.append(words)
    return out


def _hash(word: str) -> int:
    return zlib.crc32(word.encode("utf-8", "surrogatepass"))


class _Hashes(dict):
    def __missing__(self, word: str) -> int:
        if len(self) > 1_000_000:
            self.clear()
        made = self[word] = _hash(word)
        return made


@dataclass
class AreaModel:
    areas: list[str]
    hashes: np.ndarray  # of the vocabulary, ascending
    topics: np.ndarray  # vocabulary x topics: what each word adds to each topic's score
    mapped: list[int]  # topic -> number of its area, or -1
    words: list[str]  # words that speak for one area, as far as rated documents and descriptions show them
    topic_terms: list[tuple[int, str, list[str]]]  # topic, area, top terms: for inspection


def _tokenised(documents: DataFrame, quoted: set[str]) -> DataFrame:
    """``(doc_id, words binary, sizes binary, counted)``: word hashes (uint32) of all sentences, the sentences' lengths
    (uint32), and their number without the quoted ones, which are left out."""

    def encode(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes = _Hashes()
        for frame in frames:
            words, sizes, counted = [], [], []
            for text in frame["text"]:
                own = sentences(text)
                if quoted:
                    own = [ws for ws in own if len(ws) <= 2 or sum(map(quoted.__contains__, ws)) < QUOTED_SHARE * len(ws)]
                words.append(np.array([hashes[w] for ws in own for w in ws], np.uint32).tobytes())
                sizes.append(np.array([len(ws) for ws in own], np.uint32).tobytes())
                counted.append(len(own))
            yield pd.DataFrame({"doc_id": frame["doc_id"], "words": words, "sizes": sizes, "counted": counted})

    rows = documents.where("doc_id is not null and length(trim(text)) > 0").select("doc_id", "text")
    return rows.mapInPandas(encode, "doc_id long, words binary, sizes binary, counted int")


def _known(frame: pd.DataFrame, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(word numbers, first word of each sentence, document of each sentence)``, without unknown words."""
    found = np.frombuffer(b"".join(frame["words"]), np.uint32)
    sizes = np.frombuffer(b"".join(frame["sizes"]), np.uint32).astype(np.int64)
    if not len(found) or not len(hashes):
        return (np.zeros(0, np.int64),) * 3
    number = np.minimum(np.searchsorted(hashes, found), len(hashes) - 1)
    known = hashes[number] == found
    docs = np.repeat(np.arange(len(frame)), [len(s) // 4 for s in frame["sizes"]])
    left = np.add.reduceat(known, np.concatenate(([0], np.cumsum(sizes)[:-1])), dtype=np.int64)
    docs, left = docs[left > 0], left[left > 0]
    return number[known], np.concatenate(([0], np.cumsum(left)[:-1])).astype(np.int64), docs


def _frequencies(tokenised: DataFrame) -> DataFrame:
    """``(hash, documents)`` of every word."""

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            words = np.frombuffer(b"".join(frame["words"]), np.uint32).astype(np.int64)
            docs = np.repeat(np.arange(len(frame)), [len(w) // 4 for w in frame["words"]])
            held = np.unique((docs << 32) | words) & 0xFFFFFFFF
            hashes, n = np.unique(held, return_counts=True)
            yield pd.DataFrame({"hash": hashes, "n": n})

    return tokenised.select("words").mapInPandas(count, "hash long, n long").groupBy("hash").agg(F.sum("n").alias("documents"))


def _rated(tokenised: DataFrame, documents: DataFrame, labels: DataFrame, areas: list[str], hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, dict[int, str]]:
    """Vocabulary x areas: rated documents of each area that hold the word; rated documents of each area; the words of
    rated documents by their hashes."""
    rated = labels.where(F.col("doc_id").isNotNull() & F.col("area_code").isin(areas)).select("doc_id", "area_code").distinct()
    known, count = hashes, len(areas)
    at = {a: i for i, a in enumerate(areas)}

    def hold(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((len(known) + 1) * count, np.int64)  # the last row counts documents
        for frame in frames:
            area = frame["area_code"].map(at).to_numpy()
            words, starts, docs = _known(frame, known)
            sizes = np.diff(np.append(starts, len(words)))
            held = np.unique(np.repeat(docs, sizes) * (len(known) + 1) + words)
            total += np.bincount(held % (len(known) + 1) * count + area[held // (len(known) + 1)], minlength=len(total))
            total += np.bincount(len(known) * count + area, minlength=len(total))
        cells = np.flatnonzero(total)
        yield pd.DataFrame({"cell": cells, "n": total[cells]})

    def spell(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            words = sorted({w for text in frame["text"] for ws in sentences(text) for w in ws})
            own = [_hash(w) for w in words]
            kept = np.isin(own, known)
            yield pd.DataFrame({"hash": np.array(own, np.int64)[kept], "word": np.array(words, object)[kept]})

    out = np.zeros((len(hashes) + 1) * count)
    joined = tokenised.join(rated, "doc_id").select("area_code", "words", "sizes")
    for r in joined.mapInPandas(hold, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect():  # at most vocabulary x areas
        out[r.cell] = r.n
    out = out.reshape(-1, count)
    texts = documents.where("doc_id is not null and length(trim(text)) > 0").join(rated.select("doc_id").distinct(), "doc_id").select("text")
    spelt = texts.mapInPandas(spell, "hash long, word string").groupBy("hash").agg(F.min("word").alias("word")).collect()  # at most the vocabulary
    return out[:-1], out[-1], {r.hash: r.word for r in spelt}


def _scores(topics: np.ndarray, background: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What each word adds to each topic's score, and the probability that it comes from the topic in such a sentence."""
    share = (1 - BACKGROUND) * topics / background[:, None]
    return np.log(BACKGROUND + share).astype(np.float32), (share / (BACKGROUND + share)).astype(np.float32)


def _probabilities(scores: np.ndarray, words: np.ndarray, starts: np.ndarray, docs: np.ndarray) -> np.ndarray:
    """Sentences x (topics, none): by its words and by the proportions that the document's other sentences give."""
    k = scores.shape[1]
    read = np.zeros((len(starts), k + 1), np.float32)
    read[:, :k] = np.add.reduceat(scores[words], starts, axis=0)
    first = np.flatnonzero(np.diff(docs, prepend=-1))
    sizes = np.diff(np.append(first, len(docs)))
    none = np.log(1 - ON_TOPIC, dtype=np.float32)

    def normal(logs: np.ndarray) -> np.ndarray:
        logs -= logs.max(1, keepdims=True)
        np.exp(logs, out=logs)
        logs /= logs.sum(1, keepdims=True)
        return logs

    prior = np.full(k + 1, np.log(ON_TOPIC / k), np.float32)
    prior[k] = none
    p = normal(read + prior)
    for _ in range(PASSES):
        others = np.repeat(np.add.reduceat(p[:, :k], first, axis=0), sizes, axis=0) - p[:, :k] + ALPHA
        logs = read.copy()
        logs[:, :k] += np.log(others * (ON_TOPIC / others.sum(1, keepdims=True)))
        logs[:, k] += none
        p = normal(logs)
    return p


def _round(tokenised: DataFrame, hashes: np.ndarray, topics: np.ndarray, background: np.ndarray) -> np.ndarray:
    """Vocabulary x topics: how many words each topic is expected to have given, over all documents."""
    size, k = topics.shape
    shared = tokenised.sparkSession.sparkContext.broadcast((hashes, *_scores(topics, background)))  # vocabulary x topics

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes, scores, switch = shared.value
        total = np.zeros(size * k)
        for frame in frames:
            words, starts, docs = _known(frame, hashes)
            if not len(words):
                continue
            p = _probabilities(scores, words, starts, docs)[:, :k]
            sentence, topic = np.nonzero(p > LEAST_PROBABILITY)  # hardly more than one topic a sentence
            sizes = np.diff(np.append(starts, len(words)))
            many = sizes[sentence]
            at = np.repeat(starts[sentence] - np.concatenate(([0], np.cumsum(many)[:-1])), many) + np.arange(many.sum())
            cell = words[at] * k + np.repeat(topic, many)
            total += np.bincount(cell, np.repeat(p[sentence, topic], many) * switch.ravel()[cell], minlength=size * k)
        cells = np.flatnonzero(total)
        yield pd.DataFrame({"cell": cells, "n": total[cells]})

    out = np.zeros(size * k)
    summed = tokenised.select("words", "sizes").mapInPandas(count, "cell long, n double").groupBy("cell").agg(F.sum("n").alias("n"))
    for r in summed.toLocalIterator():  # at most vocabulary x topics numbers
        out[r.cell] = r.n
    shared.unpersist()
    return out.reshape(size, k)


def _mapped(topics: np.ndarray, seeds: np.ndarray) -> list[int]:
    """The area of each topic: the one whose own words its top terms are, most of all; -1 where they are nobody's."""
    out = []
    for t in range(topics.shape[1]):
        top = np.argsort(-topics[:, t], kind="stable")[:TOP_TERMS]
        speaks = (topics[top, t, None] * (seeds[top] > 0)).sum(0)
        out.append(int(speaks.argmax()) if speaks.max() > 0 else -1)
    return out


def fit_areas(documents: DataFrame, labels: DataFrame, subjects: DataFrame, quoted: set[str]) -> tuple[AreaModel, DataFrame]:
    """The model, and the tokenised documents (in the checkpoint folder)."""
    rows = subjects.where("area_code is not null").select("area_code", "area_name", "description").dropDuplicates(["area_code"]).collect()  # a closed list
    names = {r.area_code: set(_WORD.findall(f"{r.area_name} {r.description}".lower())) for r in rows}
    names = {a: w | {x[:-1] for x in w if x.endswith("s")} for a, w in names.items()}
    areas = sorted(names)
    tokenised = durable(_tokenised(documents, quoted))
    least = max(LEAST_DOCUMENTS, LEAST_SHARE * tokenised.count())
    frequent = _frequencies(tokenised).where(F.col("documents") >= least).orderBy("hash").collect()
    hashes = np.array([r.hash for r in frequent], np.uint32)
    if not len(hashes):
        return AreaModel(areas, hashes, np.zeros((0, len(areas)), np.float32), [-1] * len(areas), [], []), tokenised
    held, sizes, spelling = _rated(tokenised, documents, labels, areas, hashes)
    rates = held / np.maximum(sizes, 1)
    rest = (held.sum(1, keepdims=True) - held) / np.maximum(sizes.sum() - sizes, 1)
    seeds = np.where(rates > SEED_SHARE * (rates.sum(1, keepdims=True) + 0.0005 * len(areas)), np.maximum(rates - rest, 0), 0)
    at = {int(h): i for i, h in enumerate(hashes)}
    for a, area in enumerate(areas):
        for w in names[area]:
            spelling.setdefault(_hash(w), w)
            if _hash(w) in at and sum(w in own for own in names.values()) == 1:
                seeds[at[_hash(w)], a] += DESCRIBED
    documents_of = np.array([r.documents for r in frequent], float)
    background = documents_of / documents_of.sum()
    guidance = GUIDANCE * max(sizes.mean(), 1.0) * seeds
    smooth = BETA * len(hashes) * background[:, None]
    started = seeds.sum(0) > 0  # an area of which no word is known has an empty topic
    topics = seeds / np.where(started, seeds.sum(0), 1.0)
    for _ in range(ROUNDS):
        counts = _round(tokenised, hashes, topics, background)
        own = np.where(started, counts + guidance + smooth, 0)
        topics = own / np.where(started, own.sum(0), 1.0)
        background = np.maximum(documents_of - counts.sum(1), 0.5)
        background /= background.sum()
    scores, _ = _scores(topics, background)
    mapped = _mapped(topics, seeds)
    spoken = [spelling.get(int(h), f"#{h}") for h in hashes]
    terms = [(t, areas[a] if a >= 0 else "", [spoken[i] for i in np.argsort(-topics[:, t], kind="stable")[:TOP_TERMS]]) for t, a in enumerate(mapped)]
    speaks = (scores.max(1) > SPEAKS) & (topics.max(1) > SEED_SHARE * topics.sum(1))
    return AreaModel(areas, hashes, scores, mapped, [w for w, s in zip(spoken, speaks) if s], terms), tokenised


def area_shares(tokenised: DataFrame, model: AreaModel) -> DataFrame:
    """``(doc_id, area_code, sentences, of_sentences, share)`` for each area that has a sentence: the document's topic
    proportions, each sentence counted for its most likely topic."""
    areas, k = model.areas, model.topics.shape[1]
    shared = tokenised.sparkSession.sparkContext.broadcast((model.hashes, model.topics, np.array([*model.mapped, -1])))

    def share(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes, scores, mapped = shared.value
        for frame in frames:
            words, starts, docs = _known(frame, hashes)
            if not len(words):
                continue
            topic = _probabilities(scores, words, starts, docs).argmax(1)
            # remarks that fit any document follow its proportions; they count for a topic only if one of their words speaks for it
            most = np.maximum.reduceat(np.pad(scores, ((0, 0), (0, 1)))[words, np.repeat(topic, np.diff(np.append(starts, len(words))))], starts)
            area = np.where(most > SPEAKS, mapped[topic], -1)
            cells = np.bincount(docs[area >= 0] * len(areas) + area[area >= 0], minlength=len(frame) * len(areas))
            at = np.flatnonzero(cells)
            doc = at // len(areas)
            of = frame["counted"].to_numpy()[doc]
            yield pd.DataFrame({
                "doc_id": frame["doc_id"].to_numpy()[doc], "area_code": [areas[a] for a in at % len(areas)],
                "sentences": cells[at], "of_sentences": of, "share": cells[at] / np.maximum(of, 1),
            })

    schema = "doc_id long, area_code string, sentences int, of_sentences int, share double"
    return tokenised.mapInPandas(share, schema) if k and len(model.hashes) else tokenised.sparkSession.createDataFrame([], schema)


def _quoted_words(items: DataFrame | None, most: int = 1_000_000) -> set[str]:
    """Words of the evaluation items (a fixed, small table; more than ``most`` are refused)."""
    if items is None:
        return set()
    out: set[str] = set()
    for r in items.where("length(text) > 0").select("text").toLocalIterator():
        out.update(_WORD.findall(_CASE.sub(r"\1 \2", r.text).lower()))
        if len(out) > most:
            raise ValueError("the evaluation items have too many words to be left out by their words")
    return out


def document_areas(documents: DataFrame, labels: DataFrame, subjects: DataFrame, items: DataFrame | None = None, about: float = ABOUT_SHARE) -> DataFrame:
    """``(doc_id, area_code, share)``: the areas that each document is about.

    Null, blank and wordless documents have no area. A doc_id delivered twice with the same text gives
    its rows once. No documents give an empty result.
    """
    if documents.where("doc_id is not null and length(trim(text)) > 0").isEmpty():
        return documents.sparkSession.createDataFrame([], "doc_id long, area_code string, share double")
    model, tokenised = fit_areas(documents, labels, subjects, _quoted_words(items))
    shares = area_shares(tokenised, model).where(F.col("share") >= about)
    return shares.groupBy("doc_id", "area_code").agg(F.max("share").alias("share"))


def corpus_makeup(documents: DataFrame, labels: DataFrame, subjects: DataFrame, items: DataFrame | None = None) -> DataFrame:
    """``(area_code, documents, share)``: documents about each area, as a share of all with an area; every
    area of the list has a row."""
    areas = durable(document_areas(documents, labels, subjects, items))
    total = areas.select(F.countDistinct("doc_id")).first()[0]
    per = areas.groupBy("area_code").agg(F.count("*").alias("documents"))
    known = subjects.where("area_code is not null").select("area_code").distinct().join(per, "area_code", "left")
    n = F.coalesce("documents", F.lit(0))
    return known.select("area_code", n.alias("documents"), F.round(n / max(total, 1), 6).alias("share"))
