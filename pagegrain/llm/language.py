"""Language identification, words first.

A word seen in training adds its log frequency in each language; an unseen word
falls back to its character n-grams, the longest length of which any is known,
and those add their mean. The prediction is the language of the largest sum
together with the log share of the language in training; the score is its
posterior, so it lies between 0 and 1.

The classifier is fitted on about ``SAMPLE`` labelled texts a language, chosen by
a hash of the key, and holds of each language its ``ENTRIES`` most frequent words
and as many n-grams, so that a large language takes no place of a small one; both
bounds are parameters, and bound what is collected and sent to the tasks.
Prediction reads every whole text.

A null text, or one without letters, is ``und`` with score 0, as is every text
where nothing was learned. Ties go to the language whose name sorts first. Equal
rows each give a row. Columns of the input stay; the prediction is one struct
column of a chosen name.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import reduce
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_128_digest

from pagegrain.llm.common import cut, in_slices, trim

UNKNOWN = "und"
SAMPLE = 8_000
ENTRIES = 120_000
LONGEST = 4
_WORD = re.compile(r"[^\W\d_]+")


class Model(NamedTuple):
    """langs in order; rows of log frequencies, one column a language; words and n-grams with their row."""

    langs: list[str]
    prior: np.ndarray
    rows: np.ndarray
    words: dict[str, int]
    grams: dict[str, int]


def grams(word: str, n: int) -> list[str]:
    """n-grams of a word with its ends marked; a shorter word is one gram."""
    w = f"<{word}>"
    return [w[i:i + n] for i in range(max(1, len(w) - n + 1))]


def letters(text: str) -> list[str]:
    """Lower-cased words; empty where no character is a letter."""
    ws = _WORD.findall(text.lower())
    return ws if any(c.isalpha() for w in ws for c in w) else []


def fit(docs: DataFrame, train: Column, key: str = "doc_id", text: str = "text", lang: str = "lang", sample: int = SAMPLE, entries: int = ENTRIES) -> Model:
    """Learn from the rows where ``train`` holds and text and lang are not null."""
    rows = docs.where(train & F.col(text).isNotNull() & F.col(lang).isNotNull()).select(F.col(key).cast("string").alias("key"), F.col(lang).alias("lang"), F.col(text).alias("text"))
    sizes = {r.lang: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    langs = sorted(sizes)
    if not langs:
        return Model([], np.zeros(0), np.zeros((0, 0)), {}, {})
    share = F.create_map(*[F.lit(x) for name in langs for x in (name, min(1.0, sample / sizes[name]))])
    chosen = rows.where(F.abs(F.xxhash64("key", F.lit(1))) <= share[F.col("lang")] * float(2**63 - 1))

    def count(batches):
        """Words of a task summed by language, and the n-grams of the distinct words by how often each occurs; those of one language and size at a time."""
        tally: dict[str, Counter] = {name: Counter() for name in langs}

        def batch(name: str, size: int, items: dict[str, int]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([name] * len(items), pa.string()), pa.array([size] * len(items), pa.int32()), pa.array(list(items), pa.string()),
                                               pa.array(list(items.values()), pa.int64())], ["lang", "size", "item", "n"])

        def out():
            for name, ws in tally.items():
                yield batch(name, 0, ws)
                for size in range(1, LONGEST + 1):
                    items: dict[str, int] = defaultdict(int)
                    for w, n in ws.items():
                        for g in grams(w, size):
                            items[g] += n
                    yield batch(name, size, items)
                ws.clear()

        for names, texts in in_slices(batches):
            for name, t in zip(names, texts):
                tally[name].update(letters(t))
            if sum(map(len, tally.values())) > 100_000:
                yield from out()
        yield from out()
        del tally
        trim()

    counts = chosen.select("lang", "text").mapInArrow(count, "lang string, size int, item string, n long")
    columns = [f"n{i}" for i in range(len(langs))]
    each = cut(counts.groupBy("size", "item").pivot("lang", langs).agg(F.sum("n")).na.fill(0).toDF("size", "item", *columns), "language-counts")
    total = sum(map(F.col, columns), F.lit(0))
    parts = []
    for here in (F.col("size") == 0, F.col("size") > 0):
        known_ = each.where(here & (total >= 2))
        if known_.count() > entries:
            top = [known_.where(F.col(c) > 0).orderBy(F.desc(c), total.desc(), "size", "item").limit(entries) for c in columns]
            known_ = reduce(DataFrame.unionAll, top).distinct()
        parts.append(known_.orderBy("size", "item").toArrow())
    kept = pa.concat_tables(parts)
    table = np.stack([kept.column(c).to_numpy() for c in columns], 1).astype(float)
    size, items = kept.column("size").to_numpy(), kept.column("item").to_pylist()
    logs = np.zeros_like(table)
    for s in set(size.tolist()):
        of = size == s
        logs[of] = np.log((table[of] + 0.5) / (table[of].sum(0) + 0.5 * of.sum()))
    prior = np.log(np.array([sizes[name] for name in langs]) / sum(sizes.values()))
    words = int((size == 0).sum())
    return Model(langs, prior, logs, dict(zip(items[:words], range(words))), dict(zip(items[words:], range(words, len(items)))))


class Index(NamedTuple):
    """Words and their rows by 128-bit hash, as three sorted columns: a tenth of what a dict of strings takes in a worker."""

    high: np.ndarray
    low: np.ndarray
    row: np.ndarray

    @classmethod
    def of(cls, words: dict[str, int]) -> Index:
        high, low = cls.hashes(list(words))
        order = np.argsort(high, kind="stable")
        return cls(high[order], low[order], np.fromiter(words.values(), np.int32, len(words))[order])

    @staticmethod
    def hashes(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        both = np.frombuffer(b"".join([xxh3_128_digest(w) for w in words]), np.uint64).reshape(-1, 2)
        return both[:, 0], both[:, 1]

    def find(self, words: list[str]) -> np.ndarray:
        """Rows of the words, -1 for others."""
        if not len(self.row):
            return np.full(len(words), -1)
        high, low = self.hashes(words)
        at = np.minimum(np.searchsorted(self.high, high), len(self.row) - 1)
        return np.where((self.high[at] == high) & (self.low[at] == low), self.row[at], -1)


class Rows(dict):
    """word -> its row in the model, or for an unseen word one of ``spare`` behind those, worked out once; at most ``bound`` words are kept.

    The model's words are an ``Index``, so that only words of the texts at hand are strings.
    """

    def __init__(self, model: Model, bound: int = 100_000):
        super().__init__()
        self.model, self.bound = model, bound
        self.index = model.words if isinstance(model.words, Index) else Index.of(model.words)
        self.first = self.used = len(model.rows)
        self.spare = np.zeros((bound, len(model.langs)))

    def learn(self, words: list[str]) -> None:
        m = self.model
        for word, row in zip(words, self.index.find(words).tolist()):
            if row < 0:
                row, vector = self.used, 0.0
                for n in range(LONGEST, 0, -1):
                    if known := [i for g in grams(word, n) if (i := m.grams.get(g)) is not None]:
                        vector = m.rows[known].mean(0)
                        break
                self.spare[row - self.first] = vector
                self.used += 1
            self[word] = row

    def of(self, words: list[str]) -> np.ndarray:
        """Summed rows. When the room for words runs out, they are forgotten; a text of more words than there is room for is read in halves."""
        new = [w for w in dict.fromkeys(words) if w not in self]
        if len(self) + len(new) > self.bound:
            self.clear()
            self.used = self.first
            new = list(dict.fromkeys(words))
            if len(new) > self.bound:
                half = len(words) // 2
                return self.of(words[:half]) + self.of(words[half:])
        if new:
            self.learn(new)
        at = np.fromiter(map(self.__getitem__, words), np.int64, len(words))
        new = at >= self.first
        rows = self.model.rows.take(np.where(new, 0, at), axis=0) if self.first else np.zeros((len(at), len(self.model.langs)))
        rows[new] = self.spare[at[new] - self.first]
        return rows.sum(0)


def predict(docs: DataFrame, model: Model, out: str, text: str = "text") -> DataFrame:
    """``docs`` with the struct ``out``: lang_pred, score."""
    shared = docs.sparkSession.sparkContext.broadcast(tuple(model._replace(words=tuple(Index.of(model.words)))))
    kind = pa.struct([("lang_pred", pa.string()), ("score", pa.float64())])

    @F.arrow_udf("struct<lang_pred: string, score: double>")
    def judge(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        m = Model(*shared.value)
        rows = Rows(m._replace(words=Index(*m.words)))
        for batch in batches:
            langs, scores = [], []
            # A few texts at a time are Python objects.
            for t in (t for i in range(0, len(batch), 64) for t in batch.slice(i, 64).to_pylist()):
                ws = letters(t) if t and m.langs else []
                if ws:
                    x = rows.of(ws) + m.prior
                    best = int(x.argmax())
                    langs.append(m.langs[best])
                    scores.append(float(1 / np.exp(x - x[best]).sum()))
                else:
                    langs.append(UNKNOWN)
                    scores.append(0.0)
            yield pa.StructArray.from_arrays([pa.array(langs, pa.string()), pa.array(scores, pa.float64())], fields=list(kind))
        trim()

    return docs.withColumn(out, judge(F.col(text)))


def remainder(key: str, n: int) -> Column:
    """crc32 of the key's text modulo n; a null key counts as an empty text."""
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")) % n


def known(docs: DataFrame, model: Model, min_score: float = 0.5) -> DataFrame:
    """The documents in a learned language, with their columns; ``und`` and scores below ``min_score`` go."""
    flag = "__lang"
    while flag in docs.columns:
        flag += "_"
    return predict(docs, model, flag).where((F.col(flag)["lang_pred"] != UNKNOWN) & (F.col(flag)["score"] >= min_score)).drop(flag)
