"""Toxicity by weak supervision: many voters, a generative label model, a linear classifier.

Features of a text are its distinct lower-case words and the beginnings of 4 to 7
letters of longer ones. On a bounded sample of training rows Spark counts in how many
texts of either label each feature stands, and the ones that tell most are kept.

Voters: the kept features that speak most for toxicity (a lexicon found in the
language at hand, so no language needs a list of its own), hand-written lexicons and
patterns, votes of few or no such words for the other side, and the label of the row
itself as one voter among them, which may err. Each votes toxic, clean or abstains.
The label model estimates each voter's rates of either vote in either class by
expectation maximisation, and the correlations of voters given the class; voters that
say the same get less weight, so that a word and its beginning don't count twice. The
labels are where it starts from; after that the annotator is a voter like the others.

The posteriors are soft labels for a logistic regression on the kept features and
their number. It alone scores a document: labels, language, source and id are no
inputs.

Defined results: a null text is the empty text, which has the score of a text without
features; rows of null label or null id are not learned from; of an id with several
labels the highest counts; without any training row every score is 0; each row gives
one row, repeated rows included.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.cluster import ship
from lodestone.llm.common import cut, give_back, map_batches, one_text, small_table

WORD = re.compile(r"\w+")
STEMS = range(4, 8)

#: Hand-written lexicons, a voter each.
LEXICONS = {
    "insult_en": "asshole bastard bitch clown cretin crap damn dumb dumbass fool freak garbage idiot idiotic imbecile jerk loser moron moronic pathetic pig psycho scum scumbag shit stupid sucker trash ugly useless vermin worthless",
    "insult_de": "abschaum arsch arschloch blöd depp drecksack dumm dummkopf idiot kotzbrocken mistkerl schwachkopf schwein trottel versager vollidiot wertlos widerlich",
    "insult_fr": "abruti bouffon connard connasse con crétin débile idiot imbécile merde minable nul ordure pourriture salaud salope stupide",
    "insult_es": "basura cabrón estúpido gilipollas idiota imbécil inútil mierda miserable patético payaso pendejo perdedor tonto",
    "contempt": "despicable disgusting filthy gross hate hateful horrible loathsome nasty repulsive revolting sick vile",
    "threat": "beat burn choke destroy die hang hurt kill punch rape shoot slap stab strangle",
}
#: Patterns over the whole text, a voter each.
PATTERNS = {
    "you_are": r"(?i)\byou(?:'re| are)(?: such)?(?: an?)? (?:\w+ ){0,2}(?:idiot|moron|loser|clown|fool|joke|disgrace|trash)",
    "shut_up": r"(?i)\b(?:shut up|get lost|go to hell|drop dead|nobody likes you|kill yourself)\b",
    "bent_letters": r"(?i)\b(?:id[1!]ot|m0r0n|l0ser|st[u*]p[1!]d|sh[1!*]t|f[u*@]ck\w*|b[1!*]tch)\b",
    "stretched": r"(?i)\b(?:stuu+pid|idioo+t|looo+ser|haa+te)\b",
    "starred": r"\b\w\*{2,}\w?\b",
}
_PATTERNS = {name: re.compile(p) for name, p in PATTERNS.items()}
_LEXICONS = {name: frozenset(words.split()) for name, words in LEXICONS.items()}
HAND = [*_LEXICONS, *_PATTERNS]


def words_of(text: str) -> set[str]:
    return set(WORD.findall(text.lower()))


def features_of(word: str) -> list[str]:
    """The word, and its beginnings marked by an asterisk."""
    return [word, *(word[:k] + "*" for k in STEMS if len(word) > k)]


def hand_votes(text: str, words: set[str]) -> list[int]:
    return [int(not words.isdisjoint(x)) for x in _LEXICONS.values()] + [int(bool(p.search(text))) for p in _PATTERNS.values()]


@dataclass
class LabelModel:
    """Votes are 1, 0 or -1 (abstains). Rates [voters, 2 classes, 3 votes], log odds of toxic before any vote, and weights for correlated voters."""

    rates: np.ndarray
    bias: float
    weights: np.ndarray
    correlations: np.ndarray = field(repr=False)

    def evidence(self, votes: np.ndarray) -> np.ndarray:
        ratio = np.log(self.rates[:, 1]) - np.log(self.rates[:, 0])  # [voters, 3]
        ratio[:, 0] = 0.0  # who abstains says nothing: most voters know one language only
        return np.take_along_axis(ratio[None], (votes + 1)[:, :, None], axis=2)[:, :, 0] @ self.weights

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        return _sigmoid(self.evidence(votes) + self.bias)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def _bias_for(evidence: np.ndarray, share: float) -> float:
    """The log odds that make the mean posterior `share`, by bisection."""
    low, high = -60.0, 60.0
    for _ in range(60):
        middle = (low + high) / 2
        low, high = (middle, high) if _sigmoid(evidence + middle).mean() < share else (low, middle)
    return (low + high) / 2


def fit_label_model(votes: np.ndarray, start: np.ndarray, share: float, rounds: int = 25) -> LabelModel:
    """Expectation maximisation over votes [rows, voters]; the last voter is the annotator.

    `start` is the first guess of the classes and nothing else: from then on the rates of
    all voters, the annotator's too, come from the posteriors alone. The share of toxic
    rows is held at `share`: voters that can only speak for one class would otherwise
    carry all rows over to it.
    """
    seen = np.stack([votes == v for v in (-1, 0, 1)]).astype(np.float64)  # [3, n, voters]
    share = float(np.clip(share, 1e-3, 1 - 1e-3))
    q = np.clip(start, 0.05, 0.95)
    model = None
    for _ in range(rounds):
        rates = np.einsum("cn,vnk->kcv", np.stack([1 - q, q]), seen) + 0.5
        rates /= rates.sum(axis=2, keepdims=True)
        # correlation of "voted 1" given the class: what is left after each class's mean
        left = seen[2] - q[:, None] * rates[None, :, 1, 2] - (1 - q)[:, None] * rates[None, :, 0, 2]
        scale = np.sqrt((left * left).sum(axis=0)) + 1e-9
        correlations = (left.T @ left) / np.outer(scale, scale)
        np.fill_diagonal(correlations, 1.0)
        weights = 1 / np.where(correlations > 0.3, correlations, 0.0).sum(axis=1)
        weights[-1] = 1.0  # the annotator saw the text and is no copy of a word
        model = LabelModel(rates, 0.0, weights, correlations)
        model.bias = _bias_for(model.evidence(votes), share)
        new = model.posterior(votes)
        done = np.abs(new - q).max() < 1e-4
        q = new
        if done:
            break
    return model


@dataclass
class Classifier:
    features: dict[str, int]
    weights: np.ndarray
    strong: np.ndarray  # 1 for a feature that speaks for toxicity
    on_count: float
    on_any: float
    bias: float
    label_model: LabelModel | None = None

    def __post_init__(self) -> None:
        self.memo: dict[str, tuple[int, ...]] = {}

    def found(self, words: set[str]) -> list[int]:
        """Numbers of the kept features of a set of words."""
        memo, out = self.memo, set()
        for word in words:
            hit = memo.get(word)
            if hit is None:
                hit = tuple(self.features[f] for f in features_of(word) if f in self.features)
                if len(memo) >= 100_000:
                    memo.clear()
                memo[word] = hit
            if hit:
                out.update(hit)
        return sorted(out)

    def score(self, found: list[int]) -> float:
        n = float(self.strong[found].sum()) if found else 0.0
        z = self.bias + (float(self.weights[found].sum()) if found else 0.0) + self.on_count * np.log1p(n) + self.on_any * (n > 0)
        return float(1 / (1 + np.exp(-min(40.0, max(-40.0, z)))))


def fit_classifier(
    rows: list[list[int]], target: np.ndarray, names: list[str], strong: np.ndarray, l2: float = 1.0, steps: int = 400
) -> Classifier:
    """Logistic regression on presence of features, their number and whether there is any, with soft labels (Adam)."""
    n, k = len(rows), len(names)
    row = np.repeat(np.arange(n), [len(r) for r in rows])
    column = np.fromiter((c for r in rows for c in r), dtype=np.int64, count=len(row))
    count = np.bincount(row, weights=strong[column], minlength=n)
    extra = np.stack([np.log1p(count), (count > 0).astype(float), np.ones(n)], axis=1)
    w, v = np.zeros(k), np.array([0.0, 0.0, np.log((target.mean() + 1e-3) / (1 - target.mean() + 1e-3))])
    both = np.concatenate([w, v])
    first, second = np.zeros_like(both), np.zeros_like(both)
    for t in range(1, steps + 1):
        z = np.bincount(row, weights=both[column], minlength=n) + extra @ both[k:]
        error = 1 / (1 + np.exp(-np.clip(z, -40, 40))) - target
        slope = np.concatenate([np.bincount(column, weights=error[row], minlength=k) + l2 * both[:k], extra.T @ error]) / n
        slope[k : k + 2] += 0.1 * both[k : k + 2] / n
        first = 0.9 * first + 0.1 * slope
        second = 0.999 * second + 0.001 * slope * slope
        both = both - 0.05 * (first / (1 - 0.9**t)) / (np.sqrt(second / (1 - 0.999**t)) + 1e-9)
    return Classifier({f: i for i, f in enumerate(names)}, both[:k], strong, *map(float, both[k:]))


def _sample(
    labels: DataFrame, usable: Column, key: str, label: str, positives: int, negatives: int
) -> tuple[list[tuple[object, int]], dict[int, int]]:
    """At most `positives` + `negatives` training ids with their labels, the smallest by a hash of the id, and how many there are of each label."""
    one = labels.filter(usable & F.col(key).isNotNull() & F.col(label).isNotNull()).groupBy(key).agg(F.max(label).cast("int").alias("_y"))
    order = [F.xxhash64(key), F.col(key)]
    out = []
    for value, most in ((1, positives), (0, negatives)):
        chosen = one.filter(F.col("_y") == value).orderBy(*order).limit(most).collect()
        out.extend((r[0], r[1]) for r in chosen)
    return out, {r[0]: r[1] for r in one.groupBy("_y").count().collect() if r[0] in (0, 1)}


def fit(
    df: DataFrame,
    labels: DataFrame,
    usable: Column,
    key: str = "doc_id",
    text: str = "text",
    label: str = "toxic",
    positives: int = 2_500,
    negatives: int = 5_000,
    kept_features: int = 1_500,
    lexicon_voters: int = 200,
) -> Classifier | None:
    """A classifier from the labels of rows where `usable`, a condition on the id, holds.

    None where there is nothing to tell apart: no labelled row has a text in `df`, or all
    that have one are of one class. Every document then scores 0 and stays.
    """
    spark = df.sparkSession
    sample, everywhere = _sample(labels, usable, key, label, positives, negatives)
    if not sample:
        return None
    wanted = F.broadcast(small_table(spark, sample, f"_k {df.schema[key].dataType.simpleString()}, _y int"))
    texts = one_text(df.select(F.col(key).alias("_k"), F.col(text).alias("_t")).join(wanted, "_k"), ["_k", "_y"])

    def read(batch: pa.RecordBatch) -> dict[str, object]:
        columns = {name: batch.column(i) for i, name in enumerate(batch.schema.names)}
        given = [t or "" for t in columns["_t"].to_pylist()]
        sets = [words_of(t) for t in given]
        hand = [hand_votes(t, w) for t, w in zip(given, sets, strict=True)]
        features = [sorted({f for word in words for f in features_of(word)}) for words in sets]
        return {
            "_y": columns["_y"],
            "features": pa.array(features, type=pa.list_(pa.string())),
            "hand": pa.array(hand, type=pa.list_(pa.int32())),
        }

    read_rows = cut(map_batches(texts, "_y int, features array<string>, hand array<int>", read))
    size = {r._y: r.n for r in read_rows.groupBy("_y").agg(F.count("*").alias("n")).collect()}
    n1, n0 = size.get(1, 0), size.get(0, 0)
    if not n1 or not n0:
        return None

    spoken = read_rows.select("_y", F.explode("features").alias("f"))
    counts = spoken.groupBy("f").agg(F.sum("_y").alias("pos"), F.sum(1 - F.col("_y")).alias("neg"))
    p1, p0 = (F.col("pos") + 0.1) / (n1 + 0.2), (F.col("neg") + 0.1) / (n0 + 0.2)
    z = (p1 - p0) / F.sqrt(p1 * (1 - p1) / (n1 + 1) + p0 * (1 - p0) / (n0 + 1))
    told = counts.filter("pos + neg >= 3").select("f", "pos", "neg", z.alias("z"), F.log(p1 / p0).alias("odds"))
    toxic = told.filter("z > 2.5 AND odds > 2.5").orderBy(F.desc("z"), "f").limit(kept_features * 2 // 3).collect()
    weak = told.filter("z < -4 OR (z > 4 AND odds <= 2.5)").orderBy(F.desc(F.abs("z")), "f").limit(kept_features // 3).collect()
    names = [r.f for r in [*toxic, *weak]]
    strong = np.array([1.0] * len(toxic) + [0.0] * len(weak))
    numbers = {f: i for i, f in enumerate(names)}

    def number(batch: pa.RecordBatch) -> dict[str, object]:
        found = [sorted(numbers[f] for f in features if f in numbers) for features in batch.column(1).to_pylist()]
        return {"_y": batch.column(0), "found": pa.array(found, type=pa.list_(pa.int32())), "hand": batch.column(2)}

    rows = map_batches(read_rows.select("_y", "features", "hand"), "_y int, found array<int>, hand array<int>", number).collect()  # at most one row for each sampled id
    rows.sort(key=lambda r: (r._y, r.found))
    found, y = [list(r.found) for r in rows], np.array([r._y for r in rows], dtype=np.float64)
    lexicon = {i: j for j, i in enumerate(range(min(lexicon_voters, len(toxic))))}
    votes = np.full((len(rows), len(lexicon) + len(HAND) + 3), -1, dtype=np.int64)
    for i, r in enumerate(rows):
        for c in found[i]:
            if c in lexicon:
                votes[i, lexicon[c]] = 1
        for j, v in enumerate(r.hand):
            if v:
                votes[i, len(lexicon) + j] = 1
        n = strong[found[i]].sum() if found[i] else 0.0
        votes[i, -3] = 0 if n == 0 else 1 if n >= 4 else -1
        votes[i, -2] = 1 if any(r.hand) else -1
        votes[i, -1] = int(y[i])
    model = fit_label_model(votes, y, float(y.mean()))
    trained = fit_classifier(found, model.posterior(votes), names, strong)
    if min(everywhere.get(0, 0), everywhere.get(1, 0), n0, n1) > 0:
        # the sample holds more toxic rows than the labels do; the bias goes back to their share
        trained.bias += float(np.log(everywhere[1] / everywhere[0]) - np.log(n1 / n0))
    trained.label_model = model
    return trained


def score(df: DataFrame, classifier: Classifier | None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, score double) of every whole text."""
    shared = df.sparkSession.sparkContext.broadcast(classifier)  # at most `kept_features` words and weights

    def rows(batch: pa.RecordBatch) -> dict[str, object]:
        c = shared.value
        texts = batch.column(1).to_pylist()
        scores = [0.0] * len(texts) if c is None else [c.score(c.found(words_of(t or ""))) for t in texts]
        return {key: batch.column(0), "score": pa.array(scores, type=pa.float64())}

    return map_batches(df.select(key, text), f"{key} {df.schema[key].dataType.simpleString()}, score double", rows)


def keep_clean(df: DataFrame, classifier: Classifier | None, text: str = "text", threshold: float = 0.5) -> DataFrame:
    """The rows of `df` that score below `threshold`, all columns as they are; nothing is shuffled."""
    ship(df.sparkSession)
    shared = df.sparkSession.sparkContext.broadcast(classifier)
    place = df.columns.index(text)

    def run(batches):
        c = shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                clean = [c is None or c.score(c.found(words_of(t or ""))) < threshold for t in part.column(place).to_pylist()]
                yield part.filter(pa.array(clean, type=pa.bool_()))
        if c is not None:
            c.memo.clear()
        give_back()

    return df.mapInArrow(run, df.schema)
