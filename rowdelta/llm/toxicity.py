"""Toxicity by weak supervision.

Many voters vote toxic, clean or abstain: fixed lists of insults by sort, patterns of address, punctuation and case, and
words and stems learned from labelled rows and dealt into groups. A generative label model, fitted by expectation maximisation
without labels, estimates how each voter votes in either class and which voters correlate beyond the class: votes form a
tree below the class (Chow and Liu), in which each voter also depends on one other, so that voters that say the same are not counted
twice. Its posteriors are the soft labels of a logistic regression over lexicon terms, which scores all rows.

Fitting sees at most TRAIN_ROWS labelled rows (those of least hash of their id), so what reaches the driver is bounded
by this parameter whatever the size of the corpus; scoring covers every row and whole texts.

Cases: a null or empty text has no terms and gets the score of the bias; null ids are scored; repeated rows are scored
alike and count once while terms are learned; repeated labels of an id count as their highest, null labels as none; with few labelled rows
fewer terms are learned, down to none, and the fixed lists and patterns are the voters; without any labelled row every score is that of a
bias of -2; an empty table gives no rows; other columns pass through `scored`.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowdelta.llm import arrow, cache

TRAIN_ROWS = 20_000
#: Of the labelled texts with a learned term, at least so large a share is toxic, and at least half even at so many standard
#: errors less (Wilson's bound), which no term reaches by chance among millions. What is in fewer than this share of the toxic
#: texts marks the near copies of one text.
SHARE, ERRORS, SUPPORT = 0.95, 2.6, 0.02
STEMS = (4, 5)
#: Insults by sort.
INSULTS = {
    "of wit": frozenset("clown cretin dumb dumbass fool idiot idiotic imbecile moron moronic stupid".split()),
    "of worth": frozenset("garbage loser lowlife pathetic scum trash vermin worthless".split()),
    "of nature": frozenset("bastard bitch coward creep freak jerk pig".split()),
    "of disgust": frozenset("asshole crap damn disgusting shit ugly".split()),
}
EVERY_INSULT = frozenset().union(*INSULTS.values())
_WORD = re.compile(r"[^\W\d_]+")


def terms(text: str) -> set[str]:
    """Lower-case words, and their stems with a `*`."""
    words = set(_WORD.findall(text.lower()))
    return words | {f"{w[:n]}*" for n in STEMS for w in words if len(w) > n}


@dataclass
class Model:
    weights: dict[str, float]
    bias: float
    #: Estimated rate of right votes of each voter, and the number of labelled rows behind the fit.
    accuracy: dict[str, float] = field(default_factory=dict)
    rows: int = 0
    #: Voters that depend on another one.
    depends: dict[str, str] = field(default_factory=dict)

    def score(self, text: str) -> float:
        words, total, get = set(_WORD.findall(text.lower())), self.bias, self.weights.get
        seen = set()
        for w in words:
            if w in self.weights:
                total += self.weights[w]
            for n in STEMS:
                if len(w) > n and (stem := f"{w[:n]}*") in self.weights and stem not in seen:
                    seen.add(stem)
                    total += get(stem)
        return float(1 / (1 + np.exp(-np.clip(total, -30, 30))))


def held_out(id_col: Column) -> Column:
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def _lexicon(train: DataFrame) -> dict[str, float]:
    """The terms that mark toxic rows most surely, with the bound of their toxic share."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache.released()
        for part, texts in arrow.slices(batches, most=6 << 20):
            counts = (Counter(), Counter())
            for t, y in zip(texts, part.column(part.schema.get_field_index("toxic")).to_pylist()):
                counts[y].update(terms(t.decode()))
            both = list(counts[0].keys() | counts[1].keys())
            yield pa.RecordBatch.from_arrays([pa.array(both, pa.string()), pa.array([1] * len(both), pa.int64()), *(pa.array([c[t] for t in both], pa.int64()) for c in counts)], ["term", "parts", "clean", "toxic"])

    train = train.groupBy(F.xxhash64("text").alias("same"), "toxic").agg(F.first("text").alias("text"))
    toxic = train.where("toxic = 1").count()
    counts = train.select("text", "toxic").mapInArrow(run, "term string, parts long, clean long, toxic long").groupBy("term").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    n = F.col("toxic") + F.col("clean")
    share, z = F.col("toxic") / n, ERRORS
    least = (share + z * z / (2 * n) - z * F.sqrt(share * (1 - share) / n + z * z / (4 * n * n))) / (1 + z * z / n)
    top = counts.where(F.col("toxic") >= SUPPORT * toxic).where(share >= SHARE).withColumn("least", least).where("least >= 0.5")
    return {r["term"]: r["least"] for r in top.collect()}


_ADDRESSED = re.compile(r"\b(?:you|your|u|du|dein|tu|vous|ton|tú|usted|su)\b[^.!?]{0,40}\b(?:" + "|".join(sorted(EVERY_INSULT)) + r")\b", re.I)
_HOSTILE = re.compile(r"\b(?:shut up|go to hell|drop dead|hate you|kill you(?:rself)?|halt die klappe|ferme[- ]la|cállate)\b", re.I)
_MASKED = re.compile(r"\b[a-z]+\*{2,}[a-z]+\b", re.I)


def _voters(lexicon: dict[str, float]) -> list[tuple[str, Callable[[set[str], str], int]]]:
    words = sorted(t for t in lexicon if not t.endswith("*"))
    stems = sorted(t for t in lexicon if t.endswith("*"))
    votes = lambda group: (lambda ts, _: 1 if ts & group else 0)
    lacks = lambda group: (lambda ts, _: 0 if ts & group else -1)
    seen = lambda pattern: (lambda _, s: 1 if pattern.search(s) else 0)
    out = [(f"insults {k}", votes(v)) for k, v in INSULTS.items()]
    out += [("several insults", lambda ts, _: 1 if len(ts & EVERY_INSULT) >= 2 else 0), ("addressed", seen(_ADDRESSED)), ("hostile", seen(_HOSTILE)), ("masked words", seen(_MASKED))]
    out += [(f"words {k}", votes(frozenset(words[k::6]))) for k in range(6) if words[k::6]]
    out += [(f"stems {k}", votes(frozenset(stems[k::4]))) for k in range(4) if stems[k::4]]
    every = EVERY_INSULT | frozenset(lexicon)
    out += [("several terms", lambda ts, _: 1 if len(ts & every) >= 2 else 0), ("no terms", lacks(every))]
    letters = lambda s: sum(c.isalpha() for c in s) + 1
    capitals = lambda s: len(s) > 20 and sum(c.isupper() for c in s) > 0.5 * letters(s)
    out.append(("agitated", lambda _, s: 1 if capitals(s) or (s.count("!") > 3 and s.count("!") > 0.02 * len(s)) else 0))
    return out


#: Worth of the majority vote beside the rows, in the label model.
ANCHOR = 2.0
#: Information, in nats beyond the class, from which one voter is made to depend on another.
LINK = 0.002


def _tree(joint: np.ndarray, prior: np.ndarray) -> list[int]:
    """Each voter's parent (-1: the class alone), by the largest conditional information. joint: class x voter x vote x voter x vote."""
    m = joint.shape[1]
    info = np.zeros((m, m))
    for y in (0, 1):
        own = np.einsum("iaia->ia", joint[y])
        apart = own[:, :, None, None] * own[None, None]
        some = joint[y] > 0
        info += prior[y] * (joint[y] * np.log(np.where(some, joint[y], 1) / np.where(some, apart, 1))).sum((1, 3))
    parent, best, via, done = [-1] * m, info[0].copy(), np.zeros(m, int), np.zeros(m, bool)
    done[0] = True
    for _ in range(m - 1):  # Prim's method; a weak link leaves a voter to the class alone
        i = int(np.argmax(np.where(done, -1, best)))
        parent[i] = int(via[i]) if best[i] >= LINK else -1
        done[i] = True
        closer = info[i] > best
        best, via = np.where(closer, info[i], best), np.where(closer, i, via)
    return parent


def _label_model(votes: np.ndarray, share: float, rounds: int = 40, settled: int = 8, weight: float = 0.5, anchor: float = ANCHOR) -> tuple[np.ndarray, np.ndarray, list[int]]:
    """Posterior of the toxic class for each row, each voter's estimated accuracy and parent. votes: rows x voters in -1, 0, 1.

    share is that of toxic rows, which the votes alone can't tell. The majority of a row's votes is a prior, worth
    `anchor` times the rows, which keeps the classes what the voters mean by them. The tree is found anew in the first `settled` rounds; `weight` is that of a table's prior.
    """
    n, m = votes.shape
    score = votes.sum(1)
    p = np.where(score > 0, 0.99, np.where(score < 0, 0.01, share))
    hot = np.stack([votes == v for v in (-1, 0, 1)], 2).astype(float)
    prior = np.clip(np.array([1 - share, share]), 0.01, 0.99)
    flat, at, parent = hot.reshape(n, -1), votes.astype(int) + 1, [-1] * m
    tables = lambda p: np.stack([(flat.T @ (flat * q[:, None])).reshape(m, 3, m, 3) for q in (1 - p, p)])
    first = tables(p)
    for k in range(rounds):
        counts = tables(p) + anchor * first
        mass = np.einsum("yaa->y", counts[:, 0, :, 0])
        if k < settled:
            parent = _tree(counts / np.maximum(mass, 1e-9)[:, None, None, None, None], prior)
        own = np.einsum("yiaia->yia", counts)
        rates = (own + weight / 3) / (own.sum(2, keepdims=True) + weight)
        logit = np.full(n, np.log(prior[1] / prior[0]))
        for i, j in enumerate(parent):
            if j < 0:
                table = rates[:, i]  # class x vote
                logit += np.log(table[1] / table[0])[at[:, i]]
            else:
                pair = counts[:, i, :, j]  # class x vote x parent's vote
                table = (pair + weight * rates[:, i][:, :, None]) / (pair.sum(1, keepdims=True) + weight)
                logit += np.log(table[1] / table[0])[at[:, i], at[:, j]]
        p = 1 / (1 + np.exp(-np.clip(logit, -30, 30)))
    right = np.where(votes == 1, p[:, None], np.where(votes == -1, 1 - p[:, None], 0)).sum(0)
    return p, (right + 0.5) / ((votes != 0).sum(0) + 1), parent


def _regression(rows: list[list[int]], soft: np.ndarray, size: int, decay: float = 1e-5, rounds: int = 1500) -> tuple[np.ndarray, float]:
    """Logistic regression on soft labels over presence features, by Adam on the whole sample."""
    at, col = np.repeat(np.arange(len(rows)), [len(r) for r in rows]), np.array([c for r in rows for c in r], np.int64)
    x = np.zeros(size + 1)
    x[size] = -2.0
    m, v = np.zeros(size + 1), np.zeros(size + 1)
    for k in range(1, rounds + 1):
        z = x[size] + np.bincount(at, x[col], len(rows))
        gap = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - soft) / len(rows)
        g = np.append(np.bincount(col, gap[at], size) + decay * x[:size], gap.sum())
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        x -= 0.1 * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.99**k)) + 1e-9)
    return x[:size], float(x[size])


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", train_rows: int = TRAIN_ROWS) -> Model:
    """From the labelled rows that held_out() leaves."""
    arrow.bounded(docs.sparkSession)
    marked = labels.where("doc_id IS NOT NULL AND toxic IN (0, 1)").groupBy(F.col("doc_id").alias("doc")).agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    few = marked.where(~held_out(F.col("doc"))).orderBy(F.xxhash64("doc"), "doc").limit(train_rows)  # at most train_rows narrow rows are broadcast
    train = docs.select(F.col(id_col).alias("doc"), F.col(text_col).alias("text")).join(F.broadcast(few), "doc")
    lexicon = _lexicon(train.select("text", "toxic"))
    names = sorted(set(lexicon) | EVERY_INSULT)
    number, voters = {t: i for i, t in enumerate(names)}, _voters(lexicon)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache.released()
        for part, texts in arrow.slices(batches):
            rows, votes = [], []
            for t in texts:
                s = t.decode()
                ts = terms(s)
                rows.append(sorted(number[x] for x in ts if x in number))
                votes.append([f(ts, s) for _, f in voters])
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(rows, pa.list_(pa.int32())), pa.array(votes, pa.list_(pa.int8()))], ["doc", "toxic", "terms", "votes"])

    sample = train.select("doc", "text", "toxic").mapInArrow(run, f"doc {dict(train.dtypes)['doc']}, toxic int, terms array<int>, votes array<tinyint>")
    got = sample.orderBy("doc").limit(train_rows).collect()  # bounded; in one order, so that a fit is repeatable
    if not got:
        return Model({}, -2.0)
    of = [v for v, _ in voters]
    soft, accuracy, parent = _label_model(np.array([r["votes"] for r in got], np.int8), sum(r["toxic"] for r in got) / len(got))
    weights, bias = _regression([r["terms"] for r in got], soft, len(names))
    return Model({t: float(w) for t, w in zip(names, weights) if w}, bias, dict(zip(of, accuracy.tolist())), len(got), {of[i]: of[j] for i, j in enumerate(parent) if j >= 0})


def scored(docs: DataFrame, model: Model, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """docs with a score from 0 to 1; a column that score_col names already is replaced."""
    arrow.bounded(docs.sparkSession)
    schema = docs.drop(score_col).schema
    names = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache.released()
        for part, texts in arrow.slices(batches, text_col):
            scores = pa.array([model.score(t.decode()) for t in texts], pa.float64())
            yield pa.RecordBatch.from_arrays([*part.columns, scores], [*names, score_col])

    from pyspark.sql.types import DoubleType, StructType

    return docs.drop(score_col).mapInArrow(run, StructType(list(schema.fields)).add(score_col, DoubleType()))
