"""Language identification by script ranges and a Viterbi pass over words (operator 8).

A word is a run of letters.  The script of its first letter narrows the
languages it may belong to; among those its score is the sum of the log
probabilities of its letter trigrams (with word boundaries) and of the word
itself, hashed, under each language.  Over a text's words the best labelling
pays ``SWITCH`` for every change of language, so spans of another language are
found while single odd words are not.  The text's language is the label with
the most letters.

A text whose words nowhere gather more than half of ``SWITCH`` against one
language has that language throughout; this is tested for all texts of a slice
at once, and the word-by-word pass is left for the others.

Learning counts trigrams and words of all given texts per language; Spark sums
the counts by bucket, so a model has a fixed size per language.

Semantics: null texts and texts without a letter are ``und`` with score 0 and
no spans; letters of a script that no language uses count for none, and a text
with only such letters gets the language of the most training letters; equal
letter counts go to the language that sorts first; repeated rows are labelled
one by one.  Without training rows every text is ``und``.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .batches import mix, row_sums, rows_of, span_hashes, text_slices
from .pieces import LETTER, character_classes, code_points

TRIGRAMS, WORDS = 1 << 15, 1 << 16
#: Log-probability lost at every change of language.
SWITCH = 25.0
SMOOTHING = 0.5
#: A language uses a script if so many of its letters are in it.
LEAST_SCRIPT_SHARE = 0.01
#: Score of a word in a language that does not use its script.
FOREIGN = -200.0
UNKNOWN = "und"

# First code points of blocks of one script (0: none in particular).
SCRIPT_RANGES = [
    (0x0000, 1), (0x0370, 2), (0x0400, 3), (0x0530, 4), (0x0590, 5), (0x0600, 6), (0x0700, 0), (0x0750, 6), (0x0780, 0),
    (0x08A0, 6), (0x0900, 7), (0x0980, 8), (0x0A00, 9), (0x0A80, 10), (0x0B00, 11), (0x0B80, 12), (0x0C00, 13), (0x0C80, 14),
    (0x0D00, 15), (0x0D80, 16), (0x0E00, 17), (0x0E80, 18), (0x0F00, 19), (0x1000, 20), (0x10A0, 21), (0x1100, 22), (0x1200, 23),
    (0x13A0, 0), (0x1780, 24), (0x1800, 0), (0x1E00, 1), (0x1F00, 2), (0x2000, 0), (0x2C60, 1), (0x2C80, 0), (0x2DE0, 3), (0x2E00, 0),
    (0x3040, 25), (0x30A0, 26), (0x3100, 0), (0x3130, 22), (0x3190, 0), (0x31F0, 26), (0x3200, 0), (0x3400, 27), (0x4DC0, 0), (0x4E00, 27), (0xA000, 0),
    (0xA640, 3), (0xA6A0, 0), (0xA720, 1), (0xA800, 0), (0xAC00, 22), (0xD7B0, 0), (0xF900, 27), (0xFB00, 1), (0xFB13, 4), (0xFB1D, 5), (0xFB50, 6),
    (0xFE00, 0), (0xFE70, 6), (0xFF00, 1), (0xFF66, 26), (0xFFA0, 22), (0xFFE0, 0), (0x20000, 27), (0x30000, 0),
]
_SCRIPT_FIRST = np.array([a for a, _ in SCRIPT_RANGES])
_SCRIPT = np.array([s for _, s in SCRIPT_RANGES])
SCRIPTS = int(_SCRIPT.max()) + 1


class LetterRuns:
    """Words of a slice: characters, row bounds, scripts, and the distinct words among them."""

    def __init__(self, data: np.ndarray, off: np.ndarray):
        at, points = code_points(data)
        self.row_first = np.searchsorted(at, off)  # first character of each row
        n = len(at)
        inside = np.zeros(n + 2, bool)
        inside[1:-1] = character_classes()[points] == LETTER
        cut = np.zeros(n + 1, bool)
        cut[self.row_first] = True
        word = inside[1:-1]
        self.starts = np.flatnonzero(word & (~inside[:-2] | cut[:-1]))
        self.ends = np.flatnonzero(word & (~inside[2:] | cut[1:])) + 1
        self.letters = self.ends - self.starts
        self.bounds = np.searchsorted(self.starts, self.row_first)
        scripts = _SCRIPT[np.searchsorted(_SCRIPT_FIRST, points[self.starts], "right") - 1] if n else np.zeros(0, np.int64)
        byte = np.append(at, len(data))
        hashes = span_hashes(data, byte[self.starts], byte[self.ends])
        _, example, self.inverse = np.unique(hashes, return_index=True, return_inverse=True)
        self.script = scripts[example]
        self.text = [data[a:b].tobytes().decode().lower() for a, b in zip(byte[self.starts[example]], byte[self.ends[example]], strict=True)]

    def features(self) -> tuple[np.ndarray, np.ndarray]:
        """Bucket of every trigram and every word among the distinct words, and that word's number."""
        if not self.text:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        c = np.frombuffer(("\0" + "\0".join(self.text) + "\0").encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        word = np.cumsum(c == 0)[1:-1] - 1
        real = c[1:-1] != 0
        trigrams = mix((c[:-2] << np.uint64(42) | c[1:-1] << np.uint64(21) | c[2:])[real]) % np.uint64(TRIGRAMS)
        data = "".join(self.text).encode("utf-8", "surrogatepass")
        size = np.fromiter((len(t.encode("utf-8", "surrogatepass")) for t in self.text), np.int64, len(self.text))
        ends = np.cumsum(size)
        words = span_hashes(np.frombuffer(data, np.uint8), ends - size, ends) % np.uint64(WORDS)
        return (np.concatenate((trigrams.astype(np.int64), TRIGRAMS + words.astype(np.int64))),
                np.concatenate((word[real], np.arange(len(self.text)))))


@dataclass
class LanguageModel:
    """Languages in order, log probabilities per bucket (buckets x languages), scripts used, and the fallback language."""

    languages: list[str]
    log_p: np.ndarray
    uses: np.ndarray
    most_letters: int
    switch: float = field(default=SWITCH)

    def scores(self, runs: LetterRuns) -> np.ndarray:
        """Score of each distinct word in each language."""
        buckets, word = runs.features()
        k = len(self.languages)
        out = np.empty((len(runs.text), k))
        for lang in range(k):
            out[:, lang] = np.bincount(word, weights=self.log_p[buckets, lang], minlength=len(runs.text))
        allowed = self.uses[:, runs.script].T
        out[~allowed] += FOREIGN
        out[~allowed.any(1)] = 0.0
        return out

    def label(self, runs: LetterRuns) -> tuple[np.ndarray, np.ndarray]:
        """Language number of every word of the slice by the best labelling of its row, and the words' scores."""
        score = self.scores(runs)[runs.inverse]
        rows, row = len(runs.bounds) - 1, rows_of(runs.bounds)
        totals = np.column_stack([row_sums(score[:, k], runs.bounds) for k in range(score.shape[1])]) if len(score) else np.zeros((rows, len(self.languages)))
        best = totals.argmax(1)
        labels = best[row]
        # Largest sum over consecutive words by which another language beats the best one.
        against = np.zeros(rows)
        if len(score):
            own = np.take_along_axis(score, labels[:, None], 1)[:, 0]
            full = np.flatnonzero(np.diff(runs.bounds))
            for k in range(score.shape[1]):
                gain = score[:, k] - own
                running = np.cumsum(gain)
                drop = (np.abs(gain).sum() + 1) * 2
                before = np.minimum.accumulate(running - gain - row * drop)
                against[full] = np.maximum(against[full], np.maximum.reduceat(running - row * drop - before, runs.bounds[full]))
        for r in np.flatnonzero(against > self.switch / 2):
            lo, hi = runs.bounds[r], runs.bounds[r + 1]
            labels[lo:hi] = viterbi(score[lo:hi], self.switch)
        return labels, score


def viterbi(score: np.ndarray, switch: float) -> np.ndarray:
    """Labels of the words that maximise their scores less ``switch`` for every change."""
    n, k = score.shape
    value, come = score[0].tolist(), []
    for own in score[1:].tolist():
        top = max(range(k), key=value.__getitem__)
        jump = value[top] - switch
        come.append([j if value[j] >= jump else top for j in range(k)])
        value = [own[j] + (value[j] if value[j] >= jump else jump) for j in range(k)]
    label = max(range(k), key=value.__getitem__)
    out = [label]
    for back in reversed(come):
        label = back[label]
        out.append(label)
    return np.array(out[::-1])


def _counter(languages: list[str], text_col: str, lang_col: str):
    number = {lang: i for i, lang in enumerate(languages)}

    def run(batches):
        k = len(languages)
        counts, scripts = np.zeros((k, TRIGRAMS + WORDS)), np.zeros((k, SCRIPTS))
        for rows, data, off in text_slices(batches, text_col):
            runs = LetterRuns(data, off)
            lang = np.array([number[x] for x in rows.column(rows.schema.get_field_index(lang_col)).to_pylist()])
            buckets, word = runs.features()
            of_word = lang[rows_of(runs.bounds)]
            for i in np.unique(lang):
                here = of_word == i
                times = np.bincount(runs.inverse[here], minlength=len(runs.text))
                counts[i] += np.bincount(buckets, weights=times[word], minlength=TRIGRAMS + WORDS)
                scripts[i] += np.bincount(runs.script[runs.inverse[here]], weights=runs.letters[here], minlength=SCRIPTS)
        for i in range(k):
            everything = np.concatenate((counts[i], scripts[i]))
            found = np.flatnonzero(everything)
            yield pa.record_batch([pa.array(np.full(len(found), i), pa.int32()), pa.array(found, pa.int32()), pa.array(everything[found].astype(np.int64), pa.int64())],
                                  names=["k", "bucket", "n"])
    return run


def fit(df: DataFrame, text_col: str = "text", lang_col: str = "lang", switch: float = SWITCH) -> LanguageModel | None:
    """Learn from all rows of ``df`` with a text and a language."""
    rows = df.select(F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang")).where("text IS NOT NULL AND lang IS NOT NULL")
    languages = sorted(r.lang for r in rows.select("lang").distinct().collect())  # as many rows as languages
    if not languages:
        return None
    counted = rows.mapInArrow(_counter(languages, "text", "lang"), "k int, bucket int, n bigint").groupBy("k", "bucket").agg(F.sum("n").alias("n"))
    counts, scripts = np.zeros((TRIGRAMS + WORDS, len(languages))), np.zeros((len(languages), SCRIPTS))
    for r in counted.toLocalIterator():  # at most (TRIGRAMS + WORDS + SCRIPTS) rows per language
        if r.bucket < TRIGRAMS + WORDS:
            counts[r.bucket, r.k] = r.n
        else:
            scripts[r.k, r.bucket - TRIGRAMS - WORDS] = r.n
    log_p = np.log(counts + SMOOTHING)
    for part in (slice(0, TRIGRAMS), slice(TRIGRAMS, None)):
        log_p[part] -= np.log((counts[part] + SMOOTHING).sum(0))
    letters = scripts.sum(1)
    uses = (scripts >= LEAST_SCRIPT_SHARE * np.maximum(letters, 1)[:, None]) & (scripts > 0)
    return LanguageModel(languages, log_p.astype(np.float32), uses, int(letters.argmax()), switch)


_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("lang", pa.string())]))


def identify(df: DataFrame, model: LanguageModel | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, lang_pred, score, spans) of every row; a span is (start, end, lang) in characters.

    The score is the share of letters with the text's language, times the
    probability of that language against the others over its own words.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    shared = df.sparkSession.sparkContext.broadcast(model)  # a fixed size per language
    schema = pa.schema([(id_col, to_arrow_type(df.schema[id_col].dataType)), ("lang_pred", pa.string()), ("score", pa.float64()), ("spans", _SPANS)])

    def run(batches):
        model = shared.value
        names = np.array([*(model.languages if model else []), UNKNOWN], object)
        for rows, data, off in text_slices(batches, text_col):
            ids, n = rows.column(rows.schema.get_field_index(id_col)), len(rows)
            if model is None:
                yield pa.record_batch([ids, pa.array([UNKNOWN] * n), pa.array(np.zeros(n)), pa.array([[]] * n, _SPANS)], schema=schema)
                continue
            runs = LetterRuns(data, off)
            k, row = len(model.languages), rows_of(runs.bounds)
            labels, score = model.label(runs)
            known = model.uses[:, runs.script].any(0)[runs.inverse]
            letters = np.bincount(row * k + labels, weights=runs.letters * known, minlength=n * k).reshape(n, k)
            has = np.diff(runs.bounds) > 0
            only_unknown = has & (letters.sum(1) == 0)
            letters[only_unknown, model.most_letters] = 1
            pred = letters.argmax(1)
            mine = labels == pred[row]
            lead = np.column_stack([row_sums(np.where(mine, score[:, j], 0.0), runs.bounds) for j in range(k)]) if len(score) else np.zeros((n, k))
            lead -= np.take_along_axis(lead, pred[:, None], 1)
            sure = 1 / np.exp(np.clip(lead, -700, 700)).sum(1)
            share = np.take_along_axis(letters, pred[:, None], 1)[:, 0] / np.maximum(letters.sum(1), 1)
            value = np.where(has, np.clip(share * sure, 0, 1), 0.0)
            # Spans: where the row or the label changes.
            new = np.ones(len(labels), bool)
            new[1:] = (labels[1:] != labels[:-1]) | (row[1:] != row[:-1])
            first = np.flatnonzero(new)
            last = (np.append(first[1:], len(labels)) - 1)[:len(first)]
            base = runs.row_first[row[first]] if len(first) else first
            spans = pa.StructArray.from_arrays([pa.array(runs.starts[first] - base, pa.int64()), pa.array(runs.ends[last] - base, pa.int64()),
                                                pa.array(names[labels[first]], pa.string())], names=["start", "end", "lang"])
            spans = pa.ListArray.from_arrays(pa.array(np.searchsorted(first, runs.bounds), pa.int32()), spans)
            yield pa.record_batch([ids, pa.array(np.where(has, names[pred], UNKNOWN), pa.string()), pa.array(value), spans.cast(_SPANS)], schema=schema)

    return df.select(id_col, text_col).mapInArrow(run, f"{id_col} {df.schema[id_col].dataType.simpleString()}, lang_pred string, score double, "
                                                       "spans array<struct<start: bigint, end: bigint, lang: string>>")
