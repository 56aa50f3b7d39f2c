"""Subject areas of documents: one-versus-rest linear classifiers on hashed word n-grams.

A document's sections (its lines and sentences) carry weak labels: each may be the one for which
the document was given its subjects. A section's score for a subject is linear in its hashed word
n-grams; a document's score is that of its best section, so one line of goods is enough and a long
letter about nothing adds nothing. The classifiers start from the sections' log odds and are
trained on the best section of each document; a threshold for each subject is then calibrated for
the best F1 on documents held out.

Training takes a bounded sample of the labelled documents (MOST_LABELLED, by a hash of the id);
every other document is scored where it is read, with the weights - of fixed size - broadcast.
"""

from __future__ import annotations

import html
import re
import unicodedata
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Labelled documents that training reads at most, a documented bound; and features.
MOST_LABELLED = 12_000
BITS = 18
ROUNDS = 6
NONE = "none"

_WORD = re.compile(r"[^\W_]+(?:-[^\W\d_]+)*")
_SECTION = re.compile(r"\n+|(?<=[.!?;])\s+|\s{3,}")
_TAG = re.compile(r"</?[a-zA-Z][^<>]{0,80}>")
_DIGIT_IN_WORD = str.maketrans("0135689", "oiesbbg")
_known: dict[str, int] = {}


def plain(text: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFD", text.casefold()) if not unicodedata.combining(c))


def _code(word: str) -> int:
    code = _known.get(word)
    if code is None:
        if len(_known) > 500_000:
            _known.clear()
        w = word
        if any(c.isdigit() for c in w):
            w = "0" if sum(c.isdigit() for c in w) * 2 >= len(w) else w.translate(_DIGIT_IN_WORD)
        code = _known[word] = zlib.crc32(w.encode())
    return code


def _mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    x = (a * np.uint64(0x9E3779B97F4A7C15) + b) & np.uint64(0xFFFFFFFFFFFFFFFF)
    return (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)


def sections(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Hashed features of a text, section after section, and where each section starts."""
    codes: list[int] = []
    sizes: list[int] = []
    for part in _SECTION.split(plain(html.unescape(_TAG.sub("\n", text or "")))):
        words = _WORD.findall(part)
        if words:
            codes += map(_code, words)
            sizes.append(len(words))
    if not sizes:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    one = np.array(codes, np.uint64)
    section = np.repeat(np.arange(len(sizes), dtype=np.uint64), sizes)
    two = _mix(one[:-1], one[1:])
    grams = [(_mix(one, np.uint64(1)), section), ((two + np.uint64(2))[k := section[:-1] == section[1:]], section[1:][k])]
    if len(one) > 2:
        grams.append(((_mix(two[:-1], one[2:]) + np.uint64(3))[k := section[:-2] == section[2:]], section[2:][k]))
    whole = np.unique(np.concatenate([at << np.uint64(BITS) | code >> np.uint64(64 - BITS) for code, at in grams]))
    owner = whole >> np.uint64(BITS)
    return (whole & np.uint64((1 << BITS) - 1)).astype(np.int64), np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])


def section_scores(weights: np.ndarray, bias: np.ndarray, features: np.ndarray, starts: np.ndarray) -> np.ndarray:
    sizes = np.diff(np.r_[starts, len(features)])
    return np.add.reduceat(weights[features], starts, axis=0) / np.sqrt(sizes)[:, None] + bias


def document_scores(model: dict, text: str | None) -> np.ndarray:
    features, starts = sections(text)
    if not len(starts):
        return np.full(len(model["subjects"]), -np.inf, np.float32)
    return section_scores(model["weights"], model["bias"], features, starts).max(axis=0)


def train(texts: list[str], labels: list[set[str]], subjects: list[str], seed: int = 5) -> dict:
    """Weights, biases and calibrated thresholds from labelled documents."""
    rng = np.random.default_rng(seed)
    read = [sections(t) for t in texts]
    y = np.array([[s in own for s in subjects] for own in labels], dtype=np.float32).reshape(len(texts), len(subjects))
    order = rng.permutation(len(texts))
    held = order[: len(order) // 5]
    fit = order[len(order) // 5 :]
    size, k = 1 << BITS, len(subjects)
    # Log odds of a feature in documents of a subject against the others, shrunk where it is seldom.
    with_, without = np.zeros((size, k), np.float32), np.zeros(size, np.float32)
    for i in fit:
        own = np.unique(read[i][0])
        without[own] += 1
        with_[own] += y[i]
    n_c = y[fit].sum(axis=0)
    n = len(fit)
    p1 = (with_ + 0.3) / (n_c + 0.6)
    p0 = (without[:, None] - with_ + 0.3) / (n - n_c + 0.6)
    weights = (np.log(p1 / p0) * (without > 0)[:, None] * np.minimum(1, without / 4)[:, None]).astype(np.float32) * 0.5
    del with_, p1, p0
    bias = np.full(k, -2.0, np.float32)
    squares = np.full((size, k), 0.1, np.float32)
    bias_squares = np.full(k, 1.0, np.float32)
    rate = 0.3
    for _ in range(ROUNDS):
        for i in rng.permutation(fit):
            features, starts = read[i]
            if not len(starts):
                continue
            scores = section_scores(weights, bias, features, starts)
            best = scores.argmax(axis=0)
            top = scores[best, np.arange(k)]
            error = 1 / (1 + np.exp(-np.clip(top, -30, 30))) - y[i]
            ends = np.r_[starts[1:], len(features)]
            for c in np.flatnonzero(np.abs(error) > 0.02):
                own = features[starts[best[c]] : ends[best[c]]]
                step = error[c] / np.sqrt(len(own))
                squares[own, c] += step * step
                weights[own, c] -= rate * step / np.sqrt(squares[own, c])
                bias_squares[c] += error[c] * error[c]
                bias[c] -= 0.3 * error[c] / np.sqrt(bias_squares[c])
    model = {"subjects": subjects, "weights": weights, "bias": bias, "thresholds": np.zeros(k, np.float32)}
    if len(held):
        scores = np.array([section_scores(weights, bias, *read[i]).max(axis=0) if len(read[i][1]) else np.full(k, -30.0) for i in held])
        model["thresholds"] = np.array([calibrated(scores[:, c], y[held, c]) for c in range(k)], np.float32)
    return model


def calibrated(scores: np.ndarray, truth: np.ndarray) -> float:
    """The threshold with the best F1 on documents held out, between the scores where it lies; 0 without a case."""
    if not truth.sum():
        return 0.0
    order = np.argsort(-scores, kind="stable")
    hits = np.cumsum(truth[order])
    f1 = 2 * hits / (np.arange(1, len(hits) + 1) + truth.sum())
    best = np.flatnonzero(f1 >= f1.max() - 1e-9)
    k = best[len(best) // 2]
    below = scores[order[k + 1]] if k + 1 < len(order) else scores[order[k]] - 1
    return float((scores[order[k]] + below) / 2)


def assign(documents: DataFrame, examples: DataFrame, subjects: DataFrame) -> DataFrame:
    """`doc_id, subject`: the subjects of each document without a row in `examples`.

    `documents` has doc_id and text; `examples` doc_id and subject, the row `none` for a document
    of no subject; `subjects` lists them (a dozen). A null or empty text has no subject; without
    examples no document has one. Rows without doc_id are left out.
    """
    spark = documents.sparkSession
    names = sorted(r["subject"] for r in subjects.where("subject is not null").select("subject").distinct().collect())
    known = examples.where("doc_id is not null").groupBy("doc_id").agg(F.collect_set("subject").alias("own"))
    documents = documents.where("doc_id is not null").select("doc_id", "text")
    # The sample's ids are settled before any text is read; no more of them than the bound meet the texts.
    sampled = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(MOST_LABELLED)
    sample = documents.join(F.broadcast(sampled), "doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").toPandas()
    if not len(sample) or not names:
        return documents.select("doc_id", F.lit(None).cast("string").alias("subject")).where("false")
    model = train(list(sample["text"]), [set(s) for s in sample["own"]], names)
    model["weights"] = model["weights"].astype(np.float32)
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = shared.value
        for batch in batches:
            ids, found = [], []
            for doc_id, text in zip(batch["doc_id"], batch["text"], strict=True):
                for c in np.flatnonzero(document_scores(m, text) > m["thresholds"]):
                    ids.append(doc_id)
                    found.append(m["subjects"][c])
            yield pd.DataFrame({"doc_id": pd.Series(ids, dtype="int64"), "subject": pd.Series(found, dtype="object")})

    # Texts are scored where they are read; known documents are left out of what is found, so no text is ever shuffled.
    return documents.mapInPandas(run, "doc_id bigint, subject string").join(known.select("doc_id"), "doc_id", "left_anti")
