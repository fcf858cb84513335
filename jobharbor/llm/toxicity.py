"""Toxicity by multiple-instance learning: sentences are the instances, a document's label the bag's.

A sentence scores p = sigmoid(b + w·x); a document is toxic unless all its sentences are clean: P = 1 - prod(1 - p), the noisy-or.
Weights are fitted to document labels alone, yet say which sentences offend. With s = softplus(b + w·x),
1 - p = exp(-s), so P = 1 - exp(-sum of s): the sum adds up over sentences and the fit needs no products.

Features of a sentence are its different words and their first letters, lower-cased, so that inflected forms count too. The fit uses a bounded
sample of labelled rows (``SAMPLE`` of each label, chosen by the hash of the id and weighted back to their true numbers); scoring covers every text in whole.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jobharbor.llm.common import fresh, per_text, stored

#: Labelled rows of each label that the fit reads at most, and features it keeps.
SAMPLE, FEATURES = 4000, 4096
PREFIXES = (4, 5, 6)
STEPS, RATE, PENALTY = 1000, 0.1, 1e-6
#: How far above chance a feature must speak, in units of log-likelihood.
MARGIN = 1.0
#: A document is toxic from this score on, a sentence offends from that one on.
REJECT, OFFENDS = 0.7, 0.5
REMEMBERED = 150_000
SENTENCE = re.compile(r"[^.!?\n]+[.!?]*")
WORD = re.compile(r"\w+")


@dataclass
class Model:
    bias: float
    weights: dict[str, float]


def features(word: str) -> list[str]:
    return [word, *("^" + word[:n] for n in PREFIXES if len(word) >= n)]


def held_out(id, parts: int, rest: int):
    """Whether crc32 of the id as text leaves this remainder; a null id is not held out."""
    return F.coalesce(F.crc32(F.col(id).cast("string")) % parts == rest, F.lit(False))


def labelled_sample(rows: DataFrame, labels: DataFrame, id: str, text: str, label: str, sample: int) -> DataFrame:
    """text, y, weight. Labels other than 0 and 1 are left out; of repeated labels of an id the largest counts."""
    known = labels.where(F.col(label).isin(0, 1) & F.col(id).isNotNull()).groupBy(id).agg(F.max(label).alias("y"))
    sizes = {r["y"]: r["n"] for r in known.groupBy("y").agg(F.count("*").alias("n")).collect()}  # two rows
    chosen = None
    for y, n in sizes.items():
        some = known.where(F.col("y") == y).orderBy(F.xxhash64(id), id).limit(sample).withColumn("weight", F.lit(n / min(n, sample)))
        chosen = some if chosen is None else chosen.unionByName(some)
    texts = rows.select(F.col(id).alias("_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    if chosen is None:
        return texts.limit(0).select("text", F.lit(0).alias("y"), F.lit(1.0).alias("weight"))
    # at most two samples of ids and labels
    return texts.join(F.broadcast(chosen.select(F.col(id).alias("_id"), F.col("y").cast("int").alias("y"), "weight")), "_id").select("text", "y", "weight")


def fit(rows: DataFrame, labels: DataFrame, id: str = "doc_id", text: str = "text", label: str = "toxic", sample: int = SAMPLE) -> Model:
    """Fit to the labelled rows; without rows of both labels every text scores the share of toxic rows."""
    texts = stored(labelled_sample(rows, labels, id, text, label, sample), "toxicity-sample")
    totals = {r["y"]: (r["n"], r["seen"]) for r in texts.groupBy("y").agg(F.sum("weight").alias("n"), F.count("*").alias("seen")).collect()}
    (clean, n_clean), (toxic, n_toxic) = totals.get(0, (0.0, 0)), totals.get(1, (0.0, 0))
    if not clean or not toxic:
        return Model(math.log(math.expm1(-math.log(1 - min(max(toxic / (clean + toxic or 1), 1e-6), 1 - 1e-6)))), {})
    vocabulary = _telling_features(texts, n_clean, n_toxic)
    bags = texts.mapInPandas(lambda frames: _bags(frames, vocabulary), "y int, weight double, n_empty bigint, lengths array<int>, features array<int>")
    return _fit([tuple(r) for r in bags.collect()], vocabulary)  # bounded by the sample and the features


def _telling_features(texts: DataFrame, clean: int, toxic: int) -> dict[str, int]:
    """The features that speak most for toxic documents, by the likelihood ratio of their document counts."""

    def count(frames):
        import pandas as pd

        tally: Counter = Counter()
        for frame in frames:
            for text, y in zip(frame["text"], frame["y"], strict=True):
                words = set(WORD.findall(text.lower()))
                for feature in {f for w in words for f in features(w)}:
                    tally[feature, y] += 1
                if len(tally) > REMEMBERED:
                    yield pd.DataFrame([(f, y, n) for (f, y), n in tally.items()], columns=["feature", "y", "n"])
                    tally.clear()
        if tally:
            yield pd.DataFrame([(f, y, n) for (f, y), n in tally.items()], columns=["feature", "y", "n"])

    counts = texts.mapInPandas(count, "feature string, y int, n bigint").groupBy("feature").agg(
        F.sum(F.when(F.col("y") == 1, F.col("n")).otherwise(0)).alias("t"), F.sum(F.when(F.col("y") == 0, F.col("n")).otherwise(0)).alias("c")
    )
    counts = stored(counts, "toxicity-features")
    part = (F.col("t") + F.col("c")) / (clean + toxic)
    term = lambda seen, expected: F.when(seen > 0, seen * F.log(seen / expected)).otherwise(0.0)
    gain = term(F.col("t"), part * toxic) + term(F.col("c"), part * clean)
    gain = gain + term(toxic - F.col("t"), (1 - part) * toxic) + term(clean - F.col("c"), (1 - part) * clean)
    chance = math.log(max(counts.count(), 1)) + MARGIN  # the best of so many features reaches about the logarithm by chance
    speaks = counts.withColumn("gain", gain).where((F.col("t") / toxic > F.col("c") / clean) & (F.col("gain") > chance))
    best = speaks.orderBy(F.col("gain").desc(), "feature").limit(FEATURES)
    return {r["feature"]: i for i, r in enumerate(best.select("feature").collect())}


def _bags(frames, vocabulary: dict[str, int]):
    import pandas as pd

    for frame in frames:
        made = []
        for text, y, weight in zip(frame["text"], frame["y"], frame["weight"], strict=True):
            n_empty, lengths, found = 0, [], []
            for sentence in SENTENCE.findall(text) or [""]:
                hits = [vocabulary[f] for w in sorted(set(WORD.findall(sentence.lower()))) for f in features(w) if f in vocabulary]
                if hits:
                    lengths.append(len(hits))
                    found += hits
                else:
                    n_empty += 1
            made.append((y, weight, n_empty, lengths, found))
        yield pd.DataFrame(made, columns=["y", "weight", "n_empty", "lengths", "features"])


def _fit(bags: list[tuple], vocabulary: dict[str, int]) -> Model:
    """Adam on the weighted log-likelihood of the noisy-or."""
    y = np.array([b[0] for b in bags], dtype=float)
    share = np.array([b[1] for b in bags])
    share /= share.sum()
    empty = np.array([b[2] for b in bags], dtype=float)
    bag_of = np.repeat(np.arange(len(bags)), [len(b[3]) for b in bags])
    lengths = np.array([n for b in bags for n in b[3]], dtype=np.int64)
    sentence_of = np.repeat(np.arange(len(lengths)), lengths)
    feature = np.array([f for b in bags for f in b[4]], dtype=np.int64)
    k = len(vocabulary)
    values = np.zeros(k + 1)  # the last is the bias
    values[k] = -6.0
    mean, spread = np.zeros(k + 1), np.zeros(k + 1)
    for step in range(1, STEPS + 1):
        z = values[k] + np.bincount(sentence_of, values[feature], minlength=len(lengths))
        total = empty * np.logaddexp(0, values[k]) + np.bincount(bag_of, np.logaddexp(0, z), minlength=len(bags))
        slope = share * np.where(y == 1, 1 / np.expm1(np.clip(total, 1e-12, 50)), -1.0)
        of_z = slope[bag_of] / (1 + np.exp(-z))
        gradient = np.bincount(feature, of_z[sentence_of], minlength=k + 1).astype(float)
        gradient[k] = of_z.sum() + (slope * empty).sum() / (1 + math.exp(-values[k]))
        gradient[:k] -= PENALTY * values[:k]
        mean = 0.9 * mean + 0.1 * gradient
        spread = 0.99 * spread + 0.01 * gradient**2
        values += RATE * (mean / (1 - 0.9**step)) / (np.sqrt(spread / (1 - 0.99**step)) + 1e-8)
    return Model(float(values[k]), {f: float(values[i]) for f, i in vocabulary.items()})


class _Words(dict):
    """What a word adds to its sentence."""

    def __init__(self, weights: dict[str, float]):
        self.weights = weights

    def __missing__(self, word: str) -> float:
        if len(self) >= REMEMBERED:
            self.clear()
        value = self[word] = sum(self.weights.get(f, 0.0) for f in features(word))
        return value


def score_toxicity(rows: DataFrame, model: Model, text: str = "text", drop_text: bool = True, names: tuple[str, str] = ("score", "offending")) -> DataFrame:
    """Add the score (0 to 1) and the offending sentences, array<struct<start, end, score>>, places in characters.

    Null and empty texts count as one empty sentence. Other columns pass through; new names that are taken get a trailing underscore.
    """
    taken = [c for c in rows.columns if not (drop_text and c == text)]
    score, offending = (fresh(n, taken) for n in names)
    bias, weights = model.bias, model.weights
    plain = math.log1p(math.exp(bias)) if bias < 30 else bias

    def maker():
        words = _Words(weights)

        def one(body: str):
            total, found = 0.0, []
            for m in SENTENCE.finditer(body):
                added = sum(map(words.__getitem__, set(WORD.findall(m[0].lower()))))
                if not added:
                    total += plain
                    continue
                z = bias + added
                total += math.log1p(math.exp(z)) if z < 30 else z
                if z > 0 and (p := 1 / (1 + math.exp(-z))) >= OFFENDS:
                    found.append({"start": m.start(), "end": m.end(), "score": p})
            return -math.expm1(-(total or plain)), found

        def run(texts):
            made = [one(t) for t in texts]
            return {score: [s for s, _ in made], offending: [f for _, f in made]}

        return run

    return per_text(rows, text, f"`{score}` double, `{offending}` array<struct<start: int, end: int, score: double>>", maker, drop_text)


def keep_clean(rows: DataFrame, model: Model, text: str = "text", reject: float = REJECT) -> DataFrame:
    """The rows that score less than ``reject``, with the same columns."""
    scored = score_toxicity(rows, model, text, drop_text=False)
    return scored.where(F.col(scored.columns[-2]) < reject).select(*rows.columns)
