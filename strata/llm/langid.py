"""Language identification of mixed-language text.

Each word is scored per language by its character n-grams (1 to 3, with word
ends). The scripts of Unicode ranges narrow the candidates of a word to the
languages that were seen to use its script; Viterbi over the words with a
switching penalty then labels spans. A document's language is the one whose
spans hold most letters; its score is that language's share of the letters.

The model is fitted on a bounded sample of labelled rows
(``max_docs_per_lang``); prediction reads every whole text.
"""

from __future__ import annotations

import math
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strata.llm.common import cut_lineage, rows_of, ships_by_value, task_slices

#: Labelled documents used per language, at most.
MAX_DOCS_PER_LANG = 1000
#: Languages that a model can hold.
MAX_LANGS = 1000
#: Nats that a change of language costs.
SWITCH_PENALTY = 12.0
#: A language is a candidate for a script that holds so much of its letters.
SCRIPT_SHARE = 0.01
#: What a word in a script that a language does not use costs it.
WRONG_SCRIPT = 40.0
#: Least and most that one word can tell for or against a language, in nats.
WORD_CLIP = 15.0
#: Characters of text that a task labels at once (a longer text by itself).
TASK_CHARS = 1_000_000
#: Documents of a slice that are labelled one by one rather than in step.
FEW = 4
#: Distinct words whose scores a task remembers.
MEMO_WORDS = 300_000
#: A document is kept by the filter if one language holds so much of its letters.
MIN_SCORE = 1 / 3
UNDETERMINED = "und"

#: First code points of ranges and the script that starts there.
SCRIPT_STARTS = [
    (0x0000, "Latin"), (0x0370, "Greek"), (0x0400, "Cyrillic"), (0x0530, "Armenian"), (0x0590, "Hebrew"),
    (0x0600, "Arabic"), (0x0700, "Other"), (0x0900, "Devanagari"), (0x0980, "Bengali"), (0x0A00, "Indic"),
    (0x0E00, "Thai"), (0x0E80, "Other"), (0x10A0, "Georgian"), (0x1100, "Hangul"), (0x1200, "Other"),
    (0x1C80, "Cyrillic"), (0x1C90, "Other"), (0x1D00, "Latin"), (0x1F00, "Greek"), (0x2000, "Latin"),
    (0x2DE0, "Cyrillic"), (0x2E00, "Other"), (0x3040, "Kana"), (0x3100, "Han"), (0x3130, "Hangul"),
    (0x31A0, "Han"), (0xA000, "Other"), (0xA640, "Cyrillic"), (0xA6A0, "Other"), (0xA720, "Latin"),
    (0xA800, "Other"), (0xAC00, "Hangul"), (0xD7B0, "Other"), (0xF900, "Han"), (0xFB00, "Latin"),
    (0xFB1D, "Hebrew"), (0xFB50, "Arabic"), (0xFF00, "Latin"), (0xFF66, "Kana"), (0xFFA0, "Hangul"),
    (0x10000, "Other"), (0x20000, "Han"),
]
_STARTS = [a for a, _ in SCRIPT_STARTS]
#: A letter and what follows it of letters and of marks on them; numerals are none.
_WORD = regex.compile(r"\p{L}[\p{L}\p{M}]*")


def script_of(ch: str) -> str:
    return SCRIPT_STARTS[bisect_right(_STARTS, ord(ch)) - 1][1]


def words_of(text: str | None) -> list[str]:
    """Runs of letters, lower-cased."""
    return _WORD.findall(text.lower()) if text else []


def grams(word: str) -> list[str]:
    w = f"<{word}>"
    return [*word, *(w[k:k + 2] for k in range(len(w) - 1)), *(w[k:k + 3] for k in range(len(w) - 2))]


@dataclass
class Model:
    langs: list[str]
    index: dict[str, int]
    logp: np.ndarray  # (n-grams + 1, languages), centred; the last row is an unknown n-gram
    scripts: dict[str, np.ndarray]  # script -> the languages that are candidates for it


def training_sample(docs: DataFrame, chosen: Column, max_docs_per_lang: int = MAX_DOCS_PER_LANG,
                    id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """At most ``max_docs_per_lang`` labelled rows per language, by hash of the id.

    A share per language taken from one count narrows the rows first, so the
    ranking sees little more than the bound of any language.
    """
    named = docs.where(chosen & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(
        F.col(lang_col).alias("lang"), F.col(text_col).alias("text"), F.pmod(F.xxhash64(id_col, F.lit("langid")), F.lit(1 << 30)).alias("u"))
    shares = cut_lineage(docs.where(chosen & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).groupBy(F.col(lang_col).alias("lang")).count().withColumn(
        "cut", F.lit(1.5 * max_docs_per_lang * (1 << 30)) / F.col("count")).select("lang", "cut"))
    if shares.count() > MAX_LANGS:
        raise ValueError(f"more than {MAX_LANGS} languages")
    shares = F.broadcast(shares)  # a row per language
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("u", "text"))
    return named.join(shares, "lang").where("u < cut").withColumn("r", rank).where(F.col("r") <= max_docs_per_lang).select("lang", "text")


def fit(sample: DataFrame) -> Model:
    """Smoothed n-gram log-probabilities and script shares from (lang, text) rows.

    The driver receives one row per language and n-gram (or script) of the
    bounded sample. An empty sample gives a model without languages.
    """
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter = Counter()
        for lang, text in rows_of(batches, "lang", "text"):
            for w, n in Counter(words_of(text)).items():
                found[lang, "s", script_of(w[0])] += n * len(w)
                for g, m in Counter(grams(w)).items():
                    found[lang, "g", g] += n * m
        yield pa.RecordBatch.from_arrays(
            [pa.array([k[c] for k in found], pa.string()) for c in range(3)] + [pa.array(list(found.values()), pa.int64())],
            names=["lang", "kind", "what", "n"])

    rows = sample.mapInArrow(count, "lang string, kind string, what string, n long").groupBy("lang", "kind", "what").agg(F.sum("n").alias("n")).collect()
    langs = sorted({r["lang"] for r in rows})
    of = {lang: k for k, lang in enumerate(langs)}
    index: dict[str, int] = {}
    for g in sorted({r["what"] for r in rows if r["kind"] == "g"}):
        index[g] = len(index)
    counts = np.zeros((len(index) + 1, max(1, len(langs))))
    shares: dict[str, np.ndarray] = {}
    for r in rows:
        if r["kind"] == "g":
            counts[index[r["what"]], of[r["lang"]]] = r["n"]
        else:
            shares.setdefault(r["what"], np.zeros(len(langs)))[of[r["lang"]]] = r["n"]
    # per length of n-gram, so that every length is a distribution of its own
    length = np.array([len(g) for g in index] + [0])
    logp = np.zeros_like(counts)
    for n in (1, 2, 3):
        rows_n = length == n
        logp[rows_n] = np.log(counts[rows_n] + 0.5) - np.log(counts[rows_n].sum(0) + 0.5 * max(1, rows_n.sum()))
    logp -= logp.mean(1, keepdims=True)
    total = sum(shares.values()) if shares else np.zeros(len(langs))
    scripts = {}
    for s, n in shares.items():
        used = n >= SCRIPT_SHARE * np.maximum(total, 1)
        scripts[s] = np.flatnonzero(used if used.any() else n > 0)
    return Model(langs, index, logp.astype(np.float32), scripts)


class Scorer:
    """Scores per word and language, remembered per distinct word."""

    def __init__(self, model: Model):
        self.m = model
        self.at: dict[str, int] = {}
        self.table = np.zeros((0, len(model.langs)), np.float32)
        #: Whether the model has seen the word's script at all.
        self.seen = np.zeros(0, bool)
        self._logp: dict[tuple, np.ndarray] = {}

    def _of(self, candidates: np.ndarray) -> np.ndarray:
        """The n-grams' scores for the candidates alone."""
        key = tuple(candidates.tolist())
        if key not in self._logp:
            self._logp[key] = np.ascontiguousarray(self.m.logp[:, candidates])
        return self._logp[key]

    def rows(self, words: list[str]) -> np.ndarray:
        """Index into ``table`` of every word. The word's script narrows the
        languages: only its candidates are scored, the others stand at a floor. A
        word in a script that the model has not seen tells nothing."""
        new = set(words).difference(self.at)
        if new and len(self.at) + len(new) > MEMO_WORDS:
            self.at, self.table, self.seen = {}, self.table[:0], self.seen[:0]
            new = set(words)
        if new:
            by_script: dict[str, list[str]] = {}
            for w in sorted(new):
                by_script.setdefault(script_of(w[0]), []).append(w)
            unknown = len(self.m.index)
            tables, seen = [self.table], [self.seen]
            for s, group in by_script.items():
                candidates = self.m.scripts.get(s)
                score = np.zeros((len(group), len(self.m.langs)), np.float32)
                if candidates is not None:
                    flat, starts = [], []
                    for w in group:
                        starts.append(len(flat))
                        flat.extend(self.m.index.get(g, unknown) for g in grams(w))
                    own = np.add.reduceat(self._of(candidates)[flat], starts, axis=0) / 2
                    score[:] = -(WORD_CLIP + WRONG_SCRIPT)
                    score[:, candidates] = np.clip(own - own.max(1, keepdims=True), -WORD_CLIP, 0)
                for w in group:
                    self.at[w] = len(self.at)
                tables.append(score)
                seen.append(np.full(len(group), candidates is not None))
            self.table, self.seen = np.concatenate(tables), np.concatenate(seen)
        return np.fromiter(map(self.at.__getitem__, words), np.int64, len(words))


def _alone(best: list[float], rows: list[list[float]], penalty: float) -> tuple[list[float], list[list[int]]]:
    """The same steps for one document, where few are left to go in step."""
    own = range(len(best))
    came = []
    for row in rows:
        top = max(best)
        moved, j = top - penalty, best.index(top)
        came.append([j if moved > best[k] else k for k in own])
        best = [(moved if moved > best[k] else best[k]) + row[k] for k in own]
    return best, came


def viterbi(scores: list[np.ndarray], penalty: float) -> list[np.ndarray]:
    """Best label per word of each document, all documents in step.

    ``best[t, k] = score[t, k] + max(best[t-1, k], max_j best[t-1, j] - penalty)``;
    ties keep the language, then take the first.
    """
    order = sorted(range(len(scores)), key=lambda d: -len(scores[d]))
    n = np.array([len(scores[d]) for d in order])
    offset = np.concatenate([[0], np.cumsum(n)])
    flat = np.concatenate([scores[d] for d in order])
    width = flat.shape[1]
    came = np.zeros(flat.shape, np.uint8 if width < 256 else np.int32)
    own = np.arange(width)
    best = np.zeros((len(order), width), np.float64)
    live = np.searchsorted(-n, -np.arange(n[0]), side="left") if len(n) else []
    # the longest documents go on alone once few are left
    split = next((t for t, k in enumerate(live) if t and k <= FEW), len(live)) if width <= 32 else len(live)
    for t, k in enumerate(live[:split]):
        at = offset[:k] + t
        if t:
            b = best[:k]
            top = b.argmax(1)
            moved = b[np.arange(k), top] - penalty
            switch = moved[:, None] > b
            came[at] = np.where(switch, top[:, None], own)
            best[:k] = np.where(switch, moved[:, None], b) + flat[at]
        else:
            best[:k] = flat[at]
    label = np.zeros(len(flat), came.dtype)
    now = best.argmax(1)
    for r in range(live[split] if split < len(live) else 0):
        end, steps = _alone(best[r].tolist(), flat[offset[r] + split:offset[r + 1]].tolist(), penalty)
        k, back = end.index(max(end)), []
        for step in reversed(steps):
            back.append(k)
            k = step[k]
        label[offset[r] + split:offset[r + 1]] = back[::-1]
        now[r] = k
    for t in range(split - 1, -1, -1):
        k = live[t]
        at = offset[:k] + t
        label[at] = now[:k]
        now[:k] = came[at, now[:k]]
    out = [None] * len(order)
    for r, d in enumerate(order):
        out[d] = label[offset[r]:offset[r + 1]]
    return out


def _labelled(rows: list[tuple], scorer: Scorer, penalty: float):
    """``(row, words, labels, letters per language, letters)``; no labels without
    letters or a model. Words in a script the model has not seen count for no language."""
    words = [words_of(r[1]) for r in rows]
    busy = [k for k, w in enumerate(words) if w] if scorer.m.langs else []
    out = [(r, words[k], None, None, sum(map(len, words[k]))) for k, r in enumerate(rows)]
    if busy:
        at = scorer.rows([w for k in busy for w in words[k]])
        cuts = np.cumsum([len(words[k]) for k in busy])[:-1]
        places = np.split(at, cuts)
        for k, place, label in zip(busy, places, viterbi([scorer.table[a] for a in places], penalty)):
            letters = np.fromiter(map(len, words[k]), np.int64, len(words[k]))
            per = np.bincount(label, weights=letters * scorer.seen[place], minlength=len(scorer.m.langs))
            out[k] = (rows[k], words[k], label, per, int(letters.sum()))
    return out


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", penalty: float = SWITCH_PENALTY) -> DataFrame:
    """``(doc_id, lang_pred, score)`` of every row, from its whole text alone.

    ``und`` with score 0 where the text is null or has no letter (or the model
    knows no language). The score is the language's share of all letters, of which
    those in scripts that the model has not seen belong to none (a text of nothing
    else scores 0). Equal shares go to the first language by name. Repeated
    rows give repeated results; other columns are not read, whatever their names.
    """
    sent = docs.sparkSession.sparkContext.broadcast((model.langs, model.index, model.logp, model.scripts))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(Model(*sent.value))
        for rows in task_slices(batches, ("doc_id", "text"), lambda r: len(r[1] or "") + 64, TASK_CHARS):
            langs, scores = [], []
            for _, _, label, per, letters in _labelled(rows, scorer, penalty):
                langs.append(UNDETERMINED if label is None else scorer.m.langs[int(per.argmax())])
                scores.append(0.0 if label is None else float(per.max() / letters))
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array(langs, pa.string()), pa.array(scores, pa.float64())],
                                             names=["doc_id", "lang_pred", "score"])

    return docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text")).mapInArrow(run, "doc_id long, lang_pred string, score double")


def filter_identified(docs: DataFrame, model: Model, min_score: float = MIN_SCORE, id_col: str = "doc_id", text_col: str = "text",
                      penalty: float = SWITCH_PENALTY) -> DataFrame:
    """The rows whose text has letters and a language that holds ``min_score`` of
    them, all columns as they were; judged in the scan, without a shuffle. A model
    without languages judges nothing: all rows stay."""
    if not model.langs:
        return docs
    sent = docs.sparkSession.sparkContext.broadcast((model.langs, model.index, model.logp, model.scripts))
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(Model(*sent.value))
        for batch in batches:
            text = batch.column(at)
            rows, first, weight = [], 0, 0
            for k in range(batch.num_rows):
                t = text[k].as_py()
                rows.append((k, t))
                weight += len(t or "") + 64
                if weight >= TASK_CHARS or k == batch.num_rows - 1:
                    keep = []
                    for _, _, label, per, letters in _labelled(rows, scorer, penalty):
                        keep.append(label is not None and bool(per.max() >= min_score * letters))
                    yield batch.slice(first, len(rows)).filter(pa.array(keep, pa.bool_()))
                    rows, first, weight = [], k + 1, 0

    return docs.mapInArrow(run, docs.schema)


def spans(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", penalty: float = SWITCH_PENALTY) -> DataFrame:
    """``(doc_id, first_word, n_words, lang)``: maximal runs of words of one
    language, in order; none for a text without letters."""
    sent = docs.sparkSession.sparkContext.broadcast((model.langs, model.index, model.logp, model.scripts))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(Model(*sent.value))
        for rows in task_slices(batches, ("doc_id", "text"), lambda r: len(r[1] or "") + 64, TASK_CHARS):
            out = []
            for (i, _), _, label, _, _ in _labelled(rows, scorer, penalty):
                if label is not None:
                    first = np.concatenate([[0], np.flatnonzero(np.diff(label.astype(np.int64))) + 1])
                    n = np.diff(np.concatenate([first, [len(label)]]))
                    out += [(i, int(a), int(b), scorer.m.langs[label[a]]) for a, b in zip(first, n)]
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], kinds[k]) for k in range(4)], names=["doc_id", "first_word", "n_words", "lang"])

    return docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text")).mapInArrow(
        run, "doc_id long, first_word long, n_words long, lang string")


def held_out(id_col: str = "doc_id") -> Column:
    """Rows kept out of training: crc32 of the id as text, modulo 4, is 2."""
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


ships_by_value(__name__)
