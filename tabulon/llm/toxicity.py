"""Operator 7: toxicity by Levenshtein automata intersected with a lexicon trie.

The lexicon is learned: words and word beginnings that toxic documents have far more often than others. A trie of the
lexicon and the automata of all its entries run together, as one automaton whose states are made when first needed, so
a word costs one step per letter. Hits are weighed by the words around them: quoted or reported ones count less, those
next to an address more. A logistic model of the hit sums gives the score.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabulon.llm.common import cut_lineage, fresh, slices
from tabulon.llm.quality import find

#: Labelled training documents that the lexicon and the model are learned from, at most; chosen by hash of the key.
LABELLED_ROWS = 20_000
#: Toxic documents that must have an entry, and how many times oftener it must be in toxic ones.
LEAST_DOCUMENTS, LEAST_RATIO = 3, 6.0
#: Letters of a word beginning; and of an entry that may be misspelled by one letter.
LEAST_BEGINNING, LEAST_FUZZY = 5, 5
#: Words around a hit that decide its context.
WINDOW = 6
#: Entries that a task counts before it passes the counts on.
COUNTED_ENTRIES = 500_000
STATES = 100_000
CACHE_WORDS = 200_000
BATCH_CHARS = 1 << 20

#: Words that report what others say, and words that address somebody, of the four languages.
REPORTING = frozenset(
    "said says say wrote writes quoted quote quotes called reported tweeted sagte sagt schrieb zitiert zitat dit disait écrit cité citation dijo dice escribió citó cita".split()
)
ADDRESS = frozenset("you your you're u du dich dir dein deine ihr euch tu te toi ton ta vous votre tú ti tus usted ustedes vosotros".split())
QUOTES = "\"“”„«»‹›"
TOKEN = re.compile(rf"[^\W_]+(?:[@$*!'’][^\W_]+)*|[{QUOTES}]|\n")
QUOTED_WEIGHT, ADDRESSED_WEIGHT = 0.25, 1.25
FEATURES = ("most", "sum", "log_sum", "density", "kinds", "length")


class LexiconAutomaton:
    """Entries with at most one edit, found by running trie and Levenshtein automata together.

    Full entries match a whole word; beginnings match words that start with them, without edits. A state is a set of
    (trie node, edits); words that share letters share states.
    """

    def __init__(self, entries: list[tuple[str, bool]]):
        self.children: list[dict[str, int]] = [{}]
        self.full: dict[int, int] = {}
        self.start_of: dict[int, int] = {}
        self.fuzzy = [not beginning and len(text) >= LEAST_FUZZY for text, beginning in entries]
        self.reach = [False]  # whether an entry that may be misspelled lies below
        for number, (text, beginning) in enumerate(entries):
            node = 0
            path = [0]
            for c in text:
                if c not in self.children[node]:
                    self.children[node][c] = len(self.children)
                    self.children.append({})
                    self.reach.append(False)
                node = self.children[node][c]
                path.append(node)
            if beginning:
                self.start_of[node] = number
            else:
                self.full[node] = number
                if self.fuzzy[number]:
                    for n in path:
                        self.reach[n] = True
        self.clear()

    def clear(self) -> None:
        self.names: dict[tuple, int] = {}
        self.sets: list[tuple[frozenset, int]] = []
        self.steps: dict[tuple[int, str], int] = {}
        self.dead = self.name(frozenset(), -1)
        self.first = self.name(self.closed({(0, 0)}), -1)

    def name(self, nodes: frozenset, seen: int) -> int:
        key = (nodes, seen)
        if key not in self.names:
            self.names[key] = len(self.sets)
            self.sets.append(key)
        return self.names[key]

    def closed(self, nodes: set[tuple[int, int]]) -> frozenset:
        """With the nodes reached by leaving out a letter of the entry."""
        for node, edits in list(nodes):
            if edits == 0:
                nodes.update((child, 1) for child in self.children[node].values() if self.reach[child])
        return frozenset(nodes)

    def step(self, state: int, c: str) -> int:
        nodes, seen = self.sets[state]
        out = set()
        for node, edits in nodes:
            child = self.children[node].get(c)
            if child is not None and (edits == 0 or self.reach[child]):
                out.add((child, edits))
                if edits == 0 and child in self.start_of:
                    seen = self.start_of[child]
            if edits == 0 and self.reach[node]:
                out.add((node, 1))  # a letter too many
                out.update((other, 1) for other in self.children[node].values() if self.reach[other])  # a wrong letter
        return self.name(self.closed(out), seen)

    def match(self, word: str) -> tuple[int, int]:
        """(entry, edits) of the best match, (-1, 0) if none: exact ones first, then beginnings, then misspelled ones."""
        if len(self.sets) > STATES:
            self.clear()
        state = self.first
        for c in word:
            after = self.steps.get((state, c))
            if after is None:
                after = self.steps[state, c] = self.step(state, c)
            state = after
            if state == self.dead:
                return -1, 0
        nodes, seen = self.sets[state]
        best = (-1, 0)
        for node, edits in nodes:
            number = self.full.get(node)
            if number is None:
                continue
            if edits == 0:
                return number, 0
            if self.fuzzy[number] and (best[0] < 0 or number < best[0]):
                best = number, 1
        return (seen, 0) if seen >= 0 else best


@dataclass
class Model:
    """The lexicon with a weight for exact and misspelled hits of each entry, and the logistic model of hit sums."""

    entries: list[tuple[str, bool]] = field(default_factory=list)
    exact: list[float] = field(default_factory=list)
    misspelled: list[float] = field(default_factory=list)
    means: np.ndarray = field(default_factory=lambda: np.zeros(len(FEATURES)))
    scales: np.ndarray = field(default_factory=lambda: np.ones(len(FEATURES)))
    coefficients: np.ndarray = field(default_factory=lambda: np.zeros(len(FEATURES) + 1))

    def score(self, features: np.ndarray) -> np.ndarray:
        z = (features - self.means) / self.scales @ self.coefficients[1:] + self.coefficients[0]
        return 1.0 / (1.0 + np.exp(-np.clip(z, -500, 500)))


class Finder:
    """Hits of a lexicon in texts."""

    def __init__(self, entries: list[tuple[str, bool]]):
        self.automaton = LexiconAutomaton(entries)
        self.known: dict[str, tuple[int, int]] = {}

    def hits(self, text: str) -> Iterator[tuple[int, int, float]]:
        """(entry, edits, context weight) of each hit and at last (-1, number of tokens, 0)."""
        total = 0
        for tokens in windows(text):
            total += len(tokens)
            new = set(tokens).difference(self.known)
            if new:
                if len(self.known) > CACHE_WORDS:
                    self.known = {}
                    new = set(tokens)
                for w in new:
                    self.known[w] = self.automaton.match(w)
            known = self.known
            for i in [i for i, w in enumerate(tokens) if known[w][0] >= 0]:
                yield (*known[tokens[i]], context(tokens, i))
        yield -1, total, 0.0

    def features(self, text: str, model: Model) -> list[float]:
        sums: Counter = Counter()
        n = 0
        for entry, edits, weight in self.hits(text):
            if entry < 0:
                n = edits
                break
            sums[entry] += weight * (model.misspelled[entry] if edits else model.exact[entry])
        total = sum(sums.values())
        return [max(sums.values(), default=0.0), min(total, 100.0), np.log1p(total), 100.0 * total / (n + 50), np.log1p(len(sums)), np.log1p(n) * (total > 0)]


def windows(text: str) -> Iterator[list[str]]:
    """Lower-case tokens of the text, in stretches cut at white space, so that a very long text isn't held at once."""
    start = 0
    while start < len(text):
        end = start + BATCH_CHARS
        if end < len(text):
            gap = re.compile(r"\s").search(text, end)
            end = gap.start() if gap else len(text)
        yield TOKEN.findall(text[start:end].lower())
        start = end


def context(tokens: list[str], i: int) -> float:
    """Less than 1 if the token stands between quotation marks or near a reporting verb, more next to an address."""
    before, after = tokens[max(0, i - WINDOW) : i], tokens[i + 1 : i + 1 + WINDOW]
    if "\n" in before:
        before = before[len(before) - before[::-1].index("\n") :]
    if "\n" in after:
        after = after[: after.index("\n")]
    opened = any(t in QUOTES for t in before) and any(t in QUOTES for t in after)
    if opened or not REPORTING.isdisjoint(before[-4:]):
        return QUOTED_WEIGHT
    return 1.0 if ADDRESS.isdisjoint(before[-3:]) and ADDRESS.isdisjoint(after[:2]) else ADDRESSED_WEIGHT


@lru_cache(maxsize=2)
def finder(entries: tuple[tuple[str, bool], ...]) -> Finder:
    return Finder(list(entries))


def held_out(key):
    """Whether a row is kept from training: crc32 of the key as text leaves 1 when divided by 3."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def training(df: DataFrame, labels: DataFrame, key: str, text: str, label: str, most: int) -> DataFrame:
    """text and label of at most ``most`` labelled documents outside the held-out third, kept in the shared folder."""
    rows = labels.where(F.col(key).isNotNull() & F.col(label).isNotNull() & ~held_out(F.col(key)))
    few = rows.select(F.col(key).cast("long").alias("k"), F.col(label).cast("int").alias("v")).groupBy("k").agg(F.max("v").alias("v"))
    sample = few.orderBy(F.xxhash64("k"), "k").limit(most).toPandas().sort_values("k")
    keys, values = sample["k"].to_numpy(np.int64), sample["v"].to_numpy(np.int64)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = find(keys, batch.column(0))
            mine = at >= 0
            yield pa.RecordBatch.from_arrays([batch.column(1).filter(pa.array(mine)), pa.array(values[at[mine]], pa.int64())], ["text", "label"])

    docs = df.select(df[key].cast("long").alias("doc_id"), df[text].cast("string").alias("text"))
    return cut_lineage(docs.mapInArrow(run, "text string, label long"))


def entry_counts(sample: DataFrame) -> DataFrame:
    """entry, toxic, clean: in how many documents each word ('w' before it) or beginning ('b') is."""

    def listed(counts: tuple[Counter, Counter]) -> Iterator[pa.RecordBatch]:
        names = list(counts[0].keys() | counts[1].keys())
        for at in range(0, len(names), 10_000):
            part = names[at : at + 10_000]
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.string()), pa.array([counts[1][x] for x in part], pa.int64()), pa.array([counts[0][x] for x in part], pa.int64())], ["entry", "toxic", "clean"])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = (Counter(), Counter())
        for batch in batches:
            for text, label in zip(batch.column(0), batch.column(1), strict=True):
                own = {w for tokens in windows(text.as_py() or "") for w in tokens if len(w) >= 3 and w[0].isalpha()}
                counts[label.as_py() == 1].update({"w" + w for w in own} | {"b" + w[:n] for w in own for n in range(LEAST_BEGINNING, len(w))})
                if len(counts[0]) + len(counts[1]) > COUNTED_ENTRIES:
                    yield from listed(counts)
                    counts = (Counter(), Counter())
        yield from listed(counts)

    rows = sample.mapInArrow(run, "entry string, toxic long, clean long")
    return rows.groupBy("entry").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def without_repeats(counted: pd.DataFrame) -> pd.DataFrame:
    """Entries but for beginnings that one letter less is in just the same documents: it matches all their words.

    A beginning's documents are among those of one letter less, so equal counts mean the same documents.
    """
    known = {e: (t, c) for e, t, c in zip(counted.entry, counted.toxic, counted.clean, strict=True) if e[0] == "b"}
    return counted[[known.get(e) is None or known.get(e[:-1]) != known[e] for e in counted.entry]].copy()


def fit(df: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", most: int = LABELLED_ROWS) -> Model:
    """Learns lexicon, weights and logistic model from labelled documents outside the held-out third."""
    sample = training(df, labels, key, text, label, most)
    sizes = {row["label"]: row["count"] for row in sample.groupBy("label").count().collect()}
    toxic, clean = sizes.get(1, 0), sum(n for v, n in sizes.items() if v != 1)
    if not toxic or not clean:
        model = Model()
        model.coefficients[0] = 20.0 if toxic else -20.0
        return model
    ratio = ((F.col("toxic") + 0.5) / (toxic + 1)) / ((F.col("clean") + 0.5) / (clean + 1))
    frequent = entry_counts(sample).where(F.col("toxic") >= LEAST_DOCUMENTS).withColumn("ratio", ratio)
    chosen = without_repeats(frequent.where(F.col("ratio") >= LEAST_RATIO).toPandas())
    chosen["strength"] = np.log(chosen.ratio) * np.sqrt(chosen.toxic)
    chosen = chosen.sort_values(["strength", "entry"], ascending=[False, True])
    entries = [(e[1:], e[0] == "b") for e in chosen.entry]
    # the prior of misspelled hits is a part of the exact weight; those that clean documents have too lose it
    model = Model(entries, np.log(chosen.ratio).tolist(), [0.0] * len(entries))
    tuples = tuple(entries)

    def misses(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, counts = finder(tuples), (Counter(), Counter())
        for batch in batches:
            for t, v in zip(batch.column(0), batch.column(1), strict=True):
                counts[v.as_py() == 1].update({e for e, edits, _ in own.hits(t.as_py() or "") if e >= 0 and edits})
        both = list(counts[0].keys() | counts[1].keys())
        yield pa.RecordBatch.from_arrays([pa.array(both, pa.int64()), pa.array([counts[1][x] for x in both], pa.int64()), pa.array([counts[0][x] for x in both], pa.int64())], ["entry", "toxic", "clean"])

    found = sample.mapInArrow(misses, "entry long, toxic long, clean long").groupBy("entry").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean")).toPandas()
    seen = {int(e): (t, c) for e, t, c in found.itertuples(index=False)}
    for i, weight in enumerate(model.exact):
        t, c = seen.get(i, (0, 0))
        prior = 2.0 * np.exp(0.7 * weight) * toxic / (toxic + clean)
        ratio = ((t + prior) / (toxic + 1)) / ((c + 2.0 * clean / (toxic + clean)) / (clean + 1))
        model.misspelled[i] = float(min(max(np.log(ratio), 0.0), 0.7 * weight)) if model_fuzzy(entries[i]) else 0.0
    found = featured(sample, model, "text").select("label", "features").toPandas()
    x, y = np.array(found["features"].tolist()), (found["label"] == 1).to_numpy(float)
    model.means, model.scales = x.mean(0), np.maximum(x.std(0), 1e-9)
    model.coefficients = logistic((x - model.means) / model.scales, y)
    return model


def model_fuzzy(entry: tuple[str, bool]) -> bool:
    return not entry[1] and len(entry[0]) >= LEAST_FUZZY


def logistic(x: np.ndarray, y: np.ndarray, penalty: float = 1.0, rounds: int = 50) -> np.ndarray:
    """Coefficients of a logistic regression with a quadratic penalty, intercept first, by Newton steps.

    Rows of the rarer label count by the root of the ratio of both labels, half way to balance.
    """
    x = np.column_stack([np.ones(len(x)), x])
    rows = np.where(y == 1, np.sqrt(max((1 - y).sum(), 1) / max(y.sum(), 1)), 1.0)
    w = np.zeros(x.shape[1])
    ridge = penalty * np.eye(len(w))
    ridge[0, 0] = 1e-6
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (rows * p * (1 - p))[:, None]).T @ x + ridge, x.T @ (rows * (y - p)) - ridge @ w)
        w += step * min(1.0, 5.0 / max(np.abs(step).max(), 1e-9))
        if np.abs(step).max() < 1e-6:
            break
    return w


def featured(df: DataFrame, model: Model, text: str) -> DataFrame:
    """All columns of ``df`` and the features of its texts."""
    (name,) = fresh(df, "features")
    at, entries = df.columns.index(text), tuple(model.entries)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = finder(entries)
        for batch in batches:
            rows = [own.features(t.as_py() or "", model) for t in batch.column(at)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(rows, pa.list_(pa.float64()))], [*batch.schema.names, name])

    return df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField(name, T.ArrayType(T.DoubleType()))]))


def toxicity(df: DataFrame, model: Model, key: str = "doc_id", text: str = "text", at_least: float = 0.7) -> DataFrame:
    """key, held_out, score (0 to 1), predicted (1 if score >= ``at_least``) of each row.

    Null and empty texts have no hit and get the model's score of that. Null keys are not held out; repeated rows stay.
    With labels of one kind only, all scores lean to that kind. An empty table gives no rows. Whole texts are read.
    """
    entries = tuple(model.entries)
    named = df.select(df[key].alias("doc_id"), df[text].cast("string").alias("text"))
    kind = named.schema["doc_id"]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = finder(entries)
        for batch in batches:
            for a, b in slices(batch.column(1)):
                rows = np.array([own.features(t.as_py() or "", model) for t in batch.column(1).slice(a, b - a)]).reshape(b - a, len(FEATURES))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(model.score(rows))], ["doc_id", "score"])

    scored = named.mapInArrow(run, T.StructType([kind, T.StructField("score", T.DoubleType())]))
    return scored.select(F.col("doc_id").alias(key), held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= at_least).cast("int").alias("predicted"))
