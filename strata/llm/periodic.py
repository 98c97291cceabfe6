"""Periodic runs of words: block convolution at dyadic scales.

A run is a stretch of words with smallest period ``q`` that is at least
``max(MIN_LENGTH, MIN_POWER * q)`` words long and that no neighbouring word
extends. Texts of a slice lie one behind the other in one array of word numbers,
kept apart by a number that is no word's.

For each scale ``k`` = 1, 2, 4, ... the periods ``k <= q < 2k`` are searched. Every
``2k`` words a block of ``k`` words is taken; a run of such a period holds a block
together with the block's next occurrence, ``q`` words on. The squared differences
between a block and all windows of the words that follow are summed exactly: their
products come from number-theoretic transforms, squares from running sums, all
modulo primes whose product exceeds any such sum. Where the sum is zero the block
occurs, and the distance seeds an extension in both directions, word by word.
A distance that is a multiple of the period of a run already found around the block
is not extended again, and one whose stretch has a smaller period is left to that
period's scale, so each run is found once.

Transforms are products with small matrices of residues around zero: every sum
stays below 2^53, so double precision is exact. A block is at most ``BLOCK`` words;
at larger scales it meets the following words piece by piece, so memory does not
grow with the period.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from strata.llm.common import ships_by_value, task_slices

#: Shortest run, in words and in periods.
MIN_LENGTH, MIN_POWER = 6, 4
#: Words of the longest block that goes through a transform, and the matrix size.
BLOCK, RADIX = 2048, 64
#: Primes k * 2^20 + 1 and k * 2^21 + 1; RADIX * (p / 2)^2 < 2^53.
PRIMES = (23068673, 13631489, 7340033)
#: Numbers transformed at once, and characters of the texts handled together.
POINTS, SLICE = 1 << 16, 1 << 20


class Transform:
    """Number-theoretic transform of ``n`` points along the first axis, modulo
    ``p``, with residues in [-p/2, p/2]. The order of the points between
    ``forward`` and ``inverse`` is the transform's own."""

    def __init__(self, p: int, n: int):
        self.p, self.n = p, n
        self.a = a = min(n, RADIX)
        self.b = b = n // a
        g = next(g for g in range(2, p) if pow(g, (p - 1) // 2, p) == p - 1)
        w, at = pow(g, (p - 1) // n, p), [1]
        for _ in range(n - 1):
            at.append(at[-1] * w % p)
        table = np.array(at, np.float64)
        table[table > p // 2] -= p
        power = lambda rows, cols, step: np.outer(np.arange(rows), np.arange(cols)) * step % n
        self.fa, self.fb, self.fw = table[power(a, a, b)], table[power(b, b, a)], table[power(a, b, 1)][:, :, None]
        self.ia, self.ib, self.iw = table[-power(a, a, b) % n], table[-power(b, b, a) % n], table[-power(a, b, 1) % n][:, :, None]
        self.ia = self.reduce(self.ia * float(pow(n, p - 2, p) if pow(n, p - 2, p) <= p // 2 else pow(n, p - 2, p) - p))

    def reduce(self, x: np.ndarray) -> np.ndarray:
        q = x * (1.0 / self.p)
        np.rint(q, out=q)
        q *= self.p
        x -= q
        return x

    def forward(self, x: np.ndarray) -> np.ndarray:
        """``x``: (points, columns); points that are not given are zero."""
        rows, cols = x.shape
        used = rows // self.b if rows >= self.b else 0
        if used * self.b != rows:
            x = np.concatenate([x, np.zeros((self.n - rows, cols))])
            used = self.a
        y = self.reduce(self.fa[:, :used] @ x.reshape(used, -1))
        if self.b > 1:
            y = y.reshape(self.a, self.b, cols)
            y *= self.fw
            y = self.reduce(np.matmul(self.fb, self.reduce(y)))
        return y.reshape(self.n, cols)

    def inverse(self, y: np.ndarray) -> np.ndarray:
        cols = y.shape[1]
        if self.b > 1:
            y = self.reduce(np.matmul(self.ib, y.reshape(self.a, self.b, cols)))
            y *= self.iw
            y = self.reduce(y)
        return self.reduce(self.ia @ y.reshape(self.a, -1)).reshape(self.n, cols)


@lru_cache(maxsize=64)
def transform(p: int, n: int) -> Transform:
    return Transform(p, n)


class Words:
    """Word numbers of a slice, with the running sums of squares by prime."""

    def __init__(self, texts: list[list[bytes]]):
        parts, starts, at, top = [], [], 1, 0
        for words in texts:
            number: dict[bytes, int] = {}
            parts.append(np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words)))
            top = max(top, len(number))
            starts.append(at)
            at += len(words) + 1
        #: Stands between texts; larger than every word number.
        self.gap = top
        self.at = np.full(at + 2 * BLOCK, top, np.int64)
        for s, x in zip(starts, parts):
            self.at[s:s + len(x)] = x
        self.starts = np.array(starts, np.int64)
        self.ends = self.starts + [len(x) for x in parts]
        self._by_prime: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def residues(self, p: int) -> tuple[np.ndarray, np.ndarray]:
        if p not in self._by_prime:
            t = transform(p, 2)
            w = t.reduce(self.at.astype(np.float64))
            self._by_prime[p] = w, np.concatenate([[0.0], np.cumsum(t.reduce(w * w))])
        return self._by_prime[p]

    def zeros(self, starts: np.ndarray, k: int, off: int, p: int) -> np.ndarray:
        """Whether the sum of squared differences between the ``k`` words from each
        start and the ``k`` words ``off + s`` further on is 0 modulo ``p``:
        (s, block)."""
        w, squares = self.residues(p)
        t = transform(p, 2 * k)
        block = t.forward(w[starts + np.arange(k - 1, -1, -1)[:, None]])
        block *= t.forward(w[starts + off + np.arange(2 * k)[:, None]])
        product = t.inverse(t.reduce(block))[k - 1:2 * k - 1]
        window = starts + off + np.arange(k)[:, None]
        total = squares[window + k] - squares[window] + (squares[starts + k] - squares[starts])
        total -= 2 * product
        return t.reduce(total) == 0

    def occurrences(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(block start, distance) of all occurrences of the scale's blocks at
        distances ``k`` to ``2k - 1``, by distance and start."""
        step, block = 2 * k, min(k, BLOCK)
        long = self.ends - self.starts >= max(MIN_LENGTH, MIN_POWER * k)  # no other text has room for such a run
        first = -(-self.starts[long] // step) * step
        n = np.maximum((self.ends[long] - block - k - first) // step + 1, 0)
        starts = np.repeat(first, n) + step * (np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n))
        bound, primes = block * self.gap ** 2, []
        for p in PRIMES:
            primes.append(p)
            bound //= p
            if not bound:
                break
        else:
            raise ValueError(f"a text of {self.gap} distinct words is beyond the exact range")
        found_at, found_d = [], []
        width = max(1, POINTS // (2 * block))
        for c in range(0, len(starts), width):
            part = starts[c:c + width]
            for off in range(k, 2 * k, block):
                inside = part[part + off + block < len(self.at) - 2 * BLOCK]
                s, col = np.nonzero(self.zeros(inside, block, off, primes[0]))
                for p in primes[1:]:  # the other primes decide where the first finds zero
                    if len(s):
                        cols, col = np.unique(col, return_inverse=True)
                        inside = inside[cols]
                        zero = self.zeros(inside, block, off, p)[s, col]
                        s, col = s[zero], col[zero]
                found_at.append(inside[col])
                found_d.append(off + s)
        at, d = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (found_at, found_d))
        order = np.lexsort((at, d))
        return at[order], d[order]

    def stretch(self, i: int, d: int) -> tuple[int, int]:
        """The words around ``i`` that equal the ones ``d`` on, and those: (from, to)."""
        w, lo, hi, step = self.at, i, i, 64
        while True:
            n = min(step, len(w) - d - hi)
            differ = np.flatnonzero(w[hi:hi + n] != w[hi + d:hi + d + n])
            if len(differ):
                hi += int(differ[0])
                break
            hi, step = hi + n, 2 * step
        step = 64
        while True:
            n = min(step, lo)
            differ = np.flatnonzero(w[lo - n:lo] != w[lo - n + d:lo + d])
            if len(differ):
                lo += int(differ[-1]) + 1 - n
                break
            lo, step = lo - n, 2 * step
        return lo, hi + d

    def runs(self) -> list[list[tuple[int, int, int]]]:
        """``(start, length, period)`` of each text's runs, by start and period."""
        out: list[list[tuple[int, int, int]]] = [[] for _ in self.starts]
        around = np.full(len(self.at), -1, np.int64)  # the found run that reaches furthest from a word
        to, period = np.zeros(0, np.int64), np.zeros(0, np.int64)
        longest = int((self.ends - self.starts).max(initial=0))
        k = 1
        while max(MIN_LENGTH, MIN_POWER * k) <= longest:
            at, d = self.occurrences(k)
            if len(at) and len(to):
                r = around[at]
                new = (r < 0) | (at + d + min(k, BLOCK) > to[r]) | (d % period[r] != 0)
                at, d = at[new], d[new]
            found, done, done_d = [], -1, 0
            for i, q in zip(at.tolist(), d.tolist()):
                if q == done_d and i < done:
                    continue
                lo, hi = self.stretch(i, q)
                done, done_d = hi - q, q
                if hi - lo >= max(MIN_LENGTH, MIN_POWER * q) and not self._shorter(lo, q):
                    found.append((lo, hi, q))
            for lo, hi, q in found:
                out[int(np.searchsorted(self.starts, lo, "right")) - 1].append((lo, hi - lo, q))
                to, period = np.append(to, hi), np.append(period, q)
                old = around[lo:hi]
                old[(old < 0) | (to[old] < hi)] = len(to) - 1
            k *= 2
        return [sorted((s - int(first), n, q) for s, n, q in runs) for first, runs in zip(self.starts, out)]

    def _shorter(self, lo: int, q: int) -> bool:
        """Whether a stretch of period ``q`` has a smaller period; as it is at least
        twice as long as ``q``, that one divides ``q``."""
        rest, f = q, 2
        while rest > 1:
            if f * f > rest:
                f = rest
            if rest % f == 0:
                if np.array_equal(self.at[lo:lo + q], self.at[lo + q // f:lo + q // f + q]):
                    return True
                while rest % f == 0:
                    rest //= f
            f += 1
        return False


def words_of(text: str | None) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+``: just what ``bytes.split`` cuts at."""
    return (text or "").encode().split()


def kept(n: int, runs: list[tuple[int, int, int]]) -> np.ndarray:
    """Which of ``n`` words stay when each run is cut to its first period."""
    keep = np.ones(n, bool)
    for s, length, q in runs:
        keep[s + q:s + length] = False
    return keep


def greatest(runs: list[tuple[int, int, int]]) -> tuple[int, int, int] | None:
    """The run of most periods (exactly compared; ties: start, then period)."""
    best = None
    for r in runs:  # ordered by start and period
        if best is None or r[1] * best[2] > best[1] * r[2]:
            best = r
    return best


def planted(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """The contract's rewriting of a tenth of the texts: from some word on, the text
    repeats itself. A row without an id keeps its text."""
    if doc_id is None or not words:
        return words
    h = zlib.crc32(str(doc_id).encode())
    if h % 10:
        return words
    g, n = h // 10, len(words)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + (words[a:a + p] * ((n - a) // p + 1))[:n - a]


def _slices(batches, rewrite) -> Iterator[tuple[list, list[list[bytes]], list]]:
    for rows in task_slices(batches, ("doc_id", "text"), lambda r: 64 + len(r[1] or ""), SLICE):
        texts = [rewrite(i, words_of(text)) if rewrite else words_of(text) for i, text in rows]
        yield [i for i, _ in rows], texts, Words(texts).runs()


def _input(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text"))


def find_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, start, length, period)``, one row per run of every text. Null and
    empty texts have none; repeated rows give repeated runs; other columns are not
    read, whatever their names."""
    def run(batches):
        for ids, _, runs in _slices(batches, None):
            flat = [(i, *r) for i, found in zip(ids, runs) for r in found]
            yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in flat], pa.int64()) for c in range(4)], names=["doc_id", "start", "length", "period"])

    return _input(docs, id_col, text_col).mapInArrow(run, "doc_id long, start long, length long, period long")


def collapse(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, text)``: each run cut to its first period, the words that stay
    joined by a space. A text without runs stays as it is, null included."""
    def run(batches):
        for rows in task_slices(batches, ("doc_id", "text"), lambda r: 64 + len(r[1] or ""), SLICE):
            texts = [words_of(text) for _, text in rows]
            out = [b" ".join(compress(w, kept(len(w), r))).decode() if r else text for (_, text), w, r in zip(rows, texts, Words(texts).runs())]
            yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in rows], pa.int64()), pa.array(out, pa.string())], names=["doc_id", "text"])

    return _input(docs, id_col, text_col).mapInArrow(run, "doc_id long, text string")


_REPORT = pa.schema([("doc_id", pa.int64()), ("n_runs", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64()),
                     ("exponent_milli", pa.int64()), ("runs_sha256", pa.string()), ("collapsed_sha256", pa.string())])


def report(docs: DataFrame, rewrite: Callable | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: the number of runs, the one of most periods
    (four nulls if there is none), and digests of all runs and of the collapsed
    words. ``rewrite(doc_id, words)`` may change the words first. Null and empty
    texts have no words and no run; texts are never cut, whatever their length."""
    schema = _REPORT

    def run(batches):
        for ids, texts, found in _slices(batches, rewrite):
            out = []
            for i, words, runs in zip(ids, texts, found):
                best = greatest(runs)
                left = compress(words, kept(len(words), runs)) if runs else words
                out.append((i, len(runs), *(best or (None, None, None)), 1000 * best[1] // best[2] if best else None,
                            hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in runs).encode()).hexdigest(), hashlib.sha256(b" ".join(left)).hexdigest()))
            yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in out], schema.field(c).type) for c in range(len(schema))], schema=schema)

    return _input(docs, id_col, text_col).mapInArrow(run, "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string")


ships_by_value(__name__)
