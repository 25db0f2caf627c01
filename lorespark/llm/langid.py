"""Language identification of mixed-language text.

Learning. A bounded sample of the distinct texts of each language, about
``SAMPLE_PER_LANG`` in the order of a hash of the text, is counted in tasks: for
each language the character n-grams (lengths ``NGRAMS``) of its words, each word
taken between two edge marks, and how its letters spread over scripts. A
threshold on the hash, from the number of distinct texts, leaves a few rows per
language before they are ranked, so no language's rows meet in a task. Per
language the ``FEATURES`` most frequent n-grams and their add-one smoothed log
probabilities are the model; all languages are learned, with fewer features each
where the table would exceed ``MODEL_BYTES``.

Prediction. A word's letters tell its script by code point range; languages in
which fewer than ``SCRIPT_SHARE`` of letters are of that script are no
candidates for it. The word's score for each candidate is the mean log
probability of its n-grams, times the square root of its length. A Viterbi
search over the words with a penalty for each switch of language then labels
every word; neighbouring words of one label are a span. The document's language
is the label with the most letters, its score that label's share of letters.

Documents of a batch are decoded side by side, step by step, so that the search
is a few array operations per word position rather than per word.

Defined results: ``und`` with score 0.0 if the text is null or has no letter,
or nothing was learned; ties go to the language that sorts first; rows that
repeat a doc_id are each returned; other columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lorespark.llm.common import ROW, _small, lean, materialize, row_key

#: Documents learned from and n-grams kept per language; bytes of the table of all languages, which is broadcast.
SAMPLE_PER_LANG, FEATURES, MODEL_BYTES = 400, 20_000, 256 << 20
NGRAMS, SCRIPT_SHARE, SWITCH = (1, 2, 3, 4), 0.001, 6.0
MAX_WORD = 48  # longer words are scored by their pieces of this length
CACHE_WORDS, SCORED_AT_ONCE = 300_000, 20_000
UNKNOWN = "und"

#: Scripts by ranges of code points; all other letters are one script more.
SCRIPTS = {
    "latin": [(0x41, 0x24F), (0x1E00, 0x1EFF), (0x2C60, 0x2C7F), (0xA720, 0xA7FF), (0xFF21, 0xFF5A)],
    "greek": [(0x370, 0x3FF), (0x1F00, 0x1FFF)],
    "cyrillic": [(0x400, 0x52F), (0x1C80, 0x1C8F), (0x2DE0, 0x2DFF), (0xA640, 0xA69F)],
    "armenian": [(0x530, 0x58F)],
    "hebrew": [(0x590, 0x5FF)],
    "arabic": [(0x600, 0x6FF), (0x750, 0x77F), (0x8A0, 0x8FF), (0xFB50, 0xFDFF), (0xFE70, 0xFEFF)],
    "devanagari": [(0x900, 0x97F)],
    "bengali": [(0x980, 0x9FF)],
    "tamil": [(0xB80, 0xBFF)],
    "thai": [(0xE00, 0xE7F)],
    "georgian": [(0x10A0, 0x10FF)],
    "kana": [(0x3040, 0x30FF), (0x31F0, 0x31FF)],
    "hangul": [(0x1100, 0x11FF), (0x3130, 0x318F), (0xAC00, 0xD7AF)],
    "han": [(0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF), (0x20000, 0x2FA1F)],
}
NAMES = [*SCRIPTS, "other"]
#: Word characters that are numerals and no letters: fractions, superscripts, Roman and circled numbers.
NUMERALS = frozenset(c for c in map(chr, range(0x110000)) if c.isnumeric() and not c.isalpha() and not c.isdecimal())
_LETTERS = re.compile(r"[^\W\d_]+")


def script_of(char: str) -> int:
    point = ord(char)
    for i, ranges in enumerate(SCRIPTS.values()):
        if any(a <= point <= b for a, b in ranges):
            return i
    return len(SCRIPTS)


_script = lru_cache(maxsize=65536)(script_of)


def lettered(text: str | None) -> str:
    """The text in lower case, with a mark for each numeral; a pattern would go through the ranges of them all at every character."""
    lower = (text or "").lower()
    if not lower.isascii():
        for numeral in NUMERALS.intersection(lower):
            lower = lower.replace(numeral, "_")
    return lower


def words_of(text: str | None) -> list[str]:
    """Runs of letters, lower-cased."""
    return _LETTERS.findall(lettered(text))


def grams(word: str) -> list[str]:
    marked = f" {word[:MAX_WORD]} "
    out = [marked[i : i + n] for n in NGRAMS for i in range(len(marked) - n + 1)]
    return out if len(word) <= MAX_WORD else out + grams(word[MAX_WORD:])


class Model:
    """Log probabilities per n-gram (one row each, one column per language) and the scripts each language uses."""

    def __init__(self, langs: list[str], ngrams: dict[str, Counter], scripts: dict[str, Counter]):
        self.langs = langs
        known = sorted({g for lang in langs for g in ngrams[lang]})
        self.row = {g: i for i, g in enumerate(known)}
        self.logp = np.zeros((len(known) + 1, len(langs)), np.float32)  # the last row is for unseen n-grams
        self.allowed = np.zeros((len(NAMES), len(langs)), bool)
        for k, lang in enumerate(langs):
            total = sum(ngrams[lang].values()) + len(known) + 1
            self.logp[:-1, k] = np.log((np.array([ngrams[lang][g] for g in known], np.float64) + 1) / total) if known else 0
            self.logp[-1, k] = np.log(1 / total)
            letters = sum(scripts[lang].values())
            for s in range(len(NAMES)):
                self.allowed[s, k] = letters and scripts[lang][s] / letters >= SCRIPT_SHARE
        self.allowed[~self.allowed.any(axis=1)] = True  # a script nobody was seen to use narrows nothing

    def scores(self, words: list[str]) -> np.ndarray:
        """One row per word, one column per language."""
        get, unseen = self.row.get, len(self.logp) - 1
        found = [[get(g, unseen) for g in grams(w)] for w in words]
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        rows = self.logp[np.fromiter(chain.from_iterable(found), np.int64, int(sizes.sum()))]
        total = np.add.reduceat(rows, np.concatenate([[0], np.cumsum(sizes)[:-1]]), axis=0)
        length = np.fromiter(map(len, words), np.float32, len(words))
        script = np.fromiter((_script(w[0]) for w in words), np.int64, len(words))
        return np.where(self.allowed[script], total * (np.sqrt(length) / sizes.astype(np.float32))[:, None], np.float32(-1e4))


class WordScores:
    """Scores of the words met so far; forgotten when there are many. New words are scored together."""

    def __init__(self, model: Model):
        self.model = model
        self.forget()

    def forget(self) -> None:
        self.index: dict[str, int] = {}
        self.table = np.zeros((1024, len(self.model.langs)), np.float32)

    def emit(self, words: list[str]) -> np.ndarray:
        """The score rows of ``words``."""
        if len(self.index) > CACHE_WORDS:
            self.forget()
        new = sorted(set(words).difference(self.index))
        for lo in range(0, len(new), SCORED_AT_ONCE):
            part = new[lo : lo + SCORED_AT_ONCE]
            n = len(self.index)
            while n + len(part) > len(self.table):
                self.table = np.concatenate([self.table, np.zeros_like(self.table)])
            self.table[n : n + len(part)] = self.model.scores(part)
            self.index.update(zip(part, range(n, n + len(part))))
        return self.table[np.fromiter(map(self.index.__getitem__, words), np.int64, len(words))]


_latest: list[WordScores] = []


def word_scores(model: Model) -> WordScores:
    """This worker's scores for ``model``, kept while it is the same object."""
    if not _latest or _latest[0].model is not model:
        _latest[:] = [WordScores(model)]
    return _latest[0]


def viterbi(emit: np.ndarray, lengths: np.ndarray, switch: float = SWITCH) -> np.ndarray:
    """The best label of every row of ``emit``, which holds the documents' words one document after the other."""
    offsets = np.concatenate([[0], np.cumsum(lengths)[:-1]]).astype(np.int64)
    order = np.argsort(-lengths, kind="stable")
    lengths, offsets = lengths[order], offsets[order]
    labels = np.zeros(len(emit), np.int16)
    if not len(emit):
        return labels
    stay = np.zeros(emit.shape, bool)
    best_before = np.zeros(len(emit), np.int16)
    active = np.searchsorted(-lengths, -np.arange(lengths[0]), side="left")  # documents longer than t
    value = emit[offsets[: active[0]]].copy()
    ended: list[tuple[int, int, np.ndarray]] = []
    for t in range(1, int(lengths[0])):
        n = active[t]
        if n < len(value):
            ended.append((n, len(value), value[n:].argmax(axis=1)))
            value = value[:n]
        at = offsets[:n] + t
        before = value.argmax(axis=1)
        moved = value[np.arange(n), before][:, None] - switch
        keeps = value >= moved
        stay[at] = keeps
        best_before[at] = before
        value = np.where(keeps, value, moved) + emit[at]
    ended.append((0, len(value), value.argmax(axis=1)))
    last = np.zeros(int(active[0]), np.int64)
    for a, b, found in ended:
        last[a:b] = found
    for t in range(int(lengths[0]) - 1, -1, -1):
        n = active[t]
        at = offsets[:n] + t
        labels[at] = last[:n]
        if t:
            kept = stay[at, last[:n]]
            last[:n] = np.where(kept, last[:n], best_before[at])
    return labels


def label_words(texts: list[str | None], scores: WordScores) -> tuple[list[list[str]], np.ndarray, np.ndarray]:
    """Words per text, their number, and the label of each word, one text after the other."""
    words = [words_of(t) for t in texts]
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    return words, lengths, viterbi(scores.emit(list(chain.from_iterable(words))), lengths)


def spans(text: str | None, model: Model) -> list[tuple[int, int, str]]:
    """(start, end, language) of the spans of one text, in code points from first to last letter."""
    _, _, labels = label_words([text], WordScores(model))
    out: list[tuple[int, int, str]] = []
    for m, k in zip(_LETTERS.finditer(lettered(text)), labels.tolist()):
        if out and out[-1][2] == model.langs[k]:
            out[-1] = (out[-1][0], m.end(), out[-1][2])
        else:
            out.append((m.start(), m.end(), model.langs[k]))
    return out


def sample(labelled: DataFrame) -> DataFrame:
    """lang and text of at most ``SAMPLE_PER_LANG`` distinct texts of each language, those with the smallest hashes."""
    rows = labelled.filter("lang is not null").select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"), *row_key()[1:])
    key = ROW[1:]
    many = rows.groupBy("lang").agg(F.approx_count_distinct(ROW[1], 0.02).alias("n"))
    # twice the sample on average, so that in effect the sample is always reached
    share = F.least(F.lit(1.0), F.lit(2.0 * SAMPLE_PER_LANG) / F.col("n"))
    most = materialize(many.select(F.col("lang").alias("of"), (F.lit(float(1 << 63)) * (2 * share - 1)).alias("most")))
    few = rows.join(_small(most), F.col("lang") == F.col("of")).filter(F.col(ROW[1]).cast("double") <= F.col("most"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(*key))
    chosen = materialize(few.select("lang", *key).distinct().withColumn("rank", rank).filter(F.col("rank") <= SAMPLE_PER_LANG).select(F.col("lang").alias("of"), *[F.col(c).alias(f"{c}_of") for c in key]))
    texts = rows.join(_small(chosen), (F.col("lang") == F.col("of")) & (F.col(ROW[1]) == F.col(f"{ROW[1]}_of")) & (F.col(ROW[2]) == F.col(f"{ROW[2]}_of")), "left_semi")
    return texts.dropDuplicates(["lang", *key]).select("lang", "text")


def train(labelled: DataFrame) -> Model:
    """A model of the rows' ``lang`` (null: not used) and ``text``; see the module's text."""

    def counted(batches):
        total: Counter = Counter()
        for batch in batches:
            for lang, text in zip(*(batch.column(i).to_pylist() for i in range(2))):
                for word, n in Counter(words_of(text)).items():
                    total[lang, None, script_of(word[0])] += n * len(word)
                    for g in grams(word):
                        total[lang, g, -1] += n
        keys = list(total)
        for i in range(0, len(keys), 50_000):
            part = keys[i : i + 50_000]
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in part]), pa.array([k[1] for k in part], pa.string()), pa.array([k[2] for k in part], pa.int32()), pa.array([total[k] for k in part], pa.int64())], ["lang", "gram", "script", "n"])

    counts = materialize(sample(labelled).mapInArrow(lean(counted), "lang string, gram string, script int, n long").groupBy("lang", "gram", "script").agg(F.sum("n").alias("n")))
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))
    langs = sorted(r.lang for r in counts.select("lang").distinct().collect())
    features = max(1, min(FEATURES, MODEL_BYTES // (4 * max(1, len(langs)) ** 2)))
    ngrams: dict[str, Counter] = {lang: Counter() for lang in langs}
    scripts: dict[str, Counter] = {lang: Counter() for lang in langs}
    for r in counts.filter("gram is not null").withColumn("place", place).filter(F.col("place") <= features).select("lang", "gram", "n").toLocalIterator():
        ngrams[r.lang][r.gram] = r.n
    for r in counts.filter("gram is null").collect():
        scripts[r.lang][r.script] = r.n
    return Model(langs, ngrams, scripts)


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred, score and n_spans (runs of words of one language) of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def predicted(batches):
        scores = word_scores(shared.value)
        langs = shared.value.langs
        for batch in batches:
            for lo in range(0, batch.num_rows, 1024):
                part = batch.slice(lo, 1024)
                texts = part.column(1).to_pylist() if langs else [None] * part.num_rows
                words, lengths, labels = label_words(texts, scores)
                sizes = np.fromiter(map(len, chain.from_iterable(words)), np.int64)
                doc = np.repeat(np.arange(len(texts)), lengths)
                share = np.zeros((len(texts), max(1, len(langs))))
                np.add.at(share, (doc, labels), sizes)
                total = share.sum(axis=1)
                best = share.argmax(axis=1)
                runs = np.bincount(doc[1:][(labels[1:] != labels[:-1]) & (doc[1:] == doc[:-1])], minlength=len(texts)) + (lengths > 0)
                names = [langs[b] if t else UNKNOWN for b, t in zip(best.tolist(), total.tolist())]
                score = np.divide(share[np.arange(len(texts)), best], total, out=np.zeros(len(texts)), where=total > 0)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(names), pa.array(score), pa.array(runs, pa.int64())], ["doc_id", "lang_pred", "score", "n_spans"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(lean(predicted), "doc_id long, lang_pred string, score double, n_spans long")


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("long").cast("string")) % 3 == 1, F.lit(False))


def evaluate(docs: DataFrame) -> DataFrame:
    """Learns from the documents that are not held out and predicts all."""
    model = train(docs.filter(~held_out(F.col("doc_id"))))
    out = predict(docs, model)
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "n_spans")
