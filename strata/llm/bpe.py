"""Byte-level BPE as a bounded-lookahead streaming transducer, and its decoder.

Encoding. The text is cut into pre-tokens by the vocabulary's public pattern;
each is a run of bytes. A transducer reads a run byte by byte and keeps, for the
last ``horizon`` positions only, the last token of the encoding of the run *up
to* that position. (Encodings are closed under dropping the last token, and a
token may follow another exactly when the two encode their joint bytes
unchanged, so one back-pointer per position holds the whole encoding.) The
sufficient lookahead follows from the merge list: no token is longer than
``horizon`` bytes, so whatever comes later continues from one of the last
``horizon`` positions. Tokens before the point where the back-pointer chains of
those positions meet can no longer change and are emitted. State is a window of
``horizon`` positions plus the tokens not yet stable.

Every run goes through the transducer, whatever its length. Its first
``MEMO_DEPTH`` transitions are memoised by (state, byte), a state standing for what
was read since the run began, and the output of whole short runs by (start, run);
both tables are of bounded size and only save work. Ranks of merges only
serve for the relation between two neighbouring tokens.

Decoding concatenates the tokens' bytes piecewise and feeds them to an
incremental UTF-8 state machine, which holds at most one unfinished character
and turns malformed bytes into U+FFFD.

The special strings of the vocabulary found in a text become their ids.
"""

from __future__ import annotations

import codecs
import hashlib
import json
import re
from array import array
from collections.abc import Iterable, Iterator
from itertools import chain, islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from strata.llm.common import rows_of, ships_by_value

#: Fixed value: the public pre-token pattern of this family of vocabularies.
PRETOKEN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Distinct runs, states and pairs of tokens remembered by a task, and the bytes of
#: a run up to which its states (and its output) are remembered.
MEMO_RUNS, MEMO_STATES, MEMO_PAIRS, MEMO_DEPTH = 500_000, 600_000, 600_000, 48
#: Characters of a text that are cut into pre-tokens at once.
SEGMENT = 1 << 16
#: A vocabulary file larger than this is refused; it is sent to every task.
MAX_VOCAB_BYTES = 64 << 20


def byte_chars() -> dict[int, str]:
    """Printable stand-in of every byte in byte-level vocabulary files."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(rest)}


class Bpe:
    """Vocabulary, merges and the transducer. ``spec`` is a tokenizer JSON."""

    def __init__(self, spec: bytes):
        j = json.loads(spec)
        to_byte = {c: b for b, c in byte_chars().items()}
        vocab = j["model"]["vocab"]
        added = {t["content"]: t["id"] for t in j.get("added_tokens", [])}
        self.token_bytes = [b""] * (1 + max([*vocab.values(), *added.values()]))
        for s, i in vocab.items():
            self.token_bytes[i] = bytes(to_byte[c] for c in s)
        for s, i in added.items():
            self.token_bytes[i] = s.encode()
        self.byte_id = [-1] * 256
        for i in vocab.values():
            if len(self.token_bytes[i]) == 1:
                self.byte_id[self.token_bytes[i][0]] = i
        self.rank, self.made = {}, []
        for k, m in enumerate(j["model"]["merges"]):
            x, y = m if isinstance(m, list) else m.split(" ")
            self.rank[vocab[x] << 20 | vocab[y]] = k
            self.made.append(vocab[x + y])
        reachable = {*self.made, *(i for i in self.byte_id if i >= 0)}
        self.by_bytes = {self.token_bytes[i]: i for i in reachable}
        #: Sufficient lookahead of the merge list, in bytes.
        self.horizon = max(map(len, self.by_bytes))
        ends: dict[bytes, set[int]] = {}
        for t in self.by_bytes:
            if len(t) > 2:
                ends.setdefault(t[-3:], set()).add(len(t))
        #: Last three bytes -> lengths of longer tokens that end so, longest first.
        self.lengths_ending = {b: sorted(ls, reverse=True) for b, ls in ends.items()}
        self._follows: dict[int, bool] = {}
        self._parts: dict[int, tuple[int, int, int] | None] = {}
        #: (state, byte) -> state, and the last token of each state; state 0 is the start.
        self._next: dict[int, int] = {}
        self._last = [-1]
        self._memo = _Memo(self)
        self._special = added
        self._split = re.compile("(" + "|".join(map(re.escape, sorted(added, key=len, reverse=True))) + ")") if added else None
        self._pretoken = regex.compile(PRETOKEN)

    # -- the relation between neighbouring tokens that the merges define

    def parts(self, token: int) -> tuple[int, int, int] | None:
        """(rank, left, right) of the merge that ends the encoding of the token's own
        bytes; rank -1 for a byte, None if its bytes encode to something else."""
        if token not in self._parts:
            ids = [self.byte_id[b] for b in self.token_bytes[token]]
            last = (-1, token, token)
            while len(ids) > 1:
                best = min((self.rank.get(a << 20 | b, len(self.made)), k) for k, (a, b) in enumerate(zip(ids, ids[1:])))
                if best[0] == len(self.made):
                    break
                k = best[1]
                last = (best[0], ids[k], ids[k + 1])
                ids[k:k + 2] = [self.made[best[0]]]
            self._parts[token] = last if ids == [token] else None
        return self._parts[token]

    def follows(self, a: int, b: int) -> bool:
        """Whether token ``b`` can come right after ``a`` (-1: at the start), that is,
        whether no merge crosses their border: going back in time, the last formed of
        the two tokens at the border gives way to its part there, and a merge of the
        two must not come before either of the next ones up (of equal merges the left
        one comes first)."""
        key = (a + 1) << 20 | b
        ok = self._follows.get(key)
        if ok is None:
            if len(self._follows) >= MEMO_PAIRS:
                self._follows.clear()
            ok = self._follows[key] = self.parts(b) is not None and (a < 0 or self._apart(a, b))
        return ok

    def _apart(self, a: int, b: int) -> bool:
        ra, _, a_right = self.parts(a)
        rb, b_left, _ = self.parts(b)
        a_up = b_up = len(self.made)
        while True:
            r = self.rank.get(a << 20 | b)
            if r is not None and r > ra and r > rb and r < a_up and r <= b_up:
                return False
            if ra > rb:
                a_up, a = ra, a_right
                ra, _, a_right = self.parts(a)
            elif rb >= 0:
                b_up, b = rb, b_left
                rb, b_left, _ = self.parts(b)
            else:
                return True

    # -- the transducer

    def step(self, read: bytes, last, i: int) -> int:
        """The last token of the encoding up to position ``i``, where the bytes
        ``read`` end, from the last tokens up to earlier positions."""
        size, by_bytes, known = len(read), self.by_bytes, self._follows.get
        for n in self.lengths_ending.get(read[-3:], ()):
            if n <= size:
                t = by_bytes.get(read[size - n:])
                if t is not None:
                    a = last[i - n]
                    ok = known((a + 1) << 20 | t)
                    if self.follows(a, t) if ok is None else ok:
                        return t
        t = by_bytes.get(read[-2:]) if size > 1 else None
        return t if t is not None and self.follows(last[i - 2], t) else by_bytes[read[-1:]]

    def stream(self, run: Iterable[int]) -> Iterator[int]:
        """Token ids of a run of bytes of any length, each as soon as it is stable."""
        run = iter(run)
        head = bytes(islice(run, MEMO_DEPTH))
        following, tokens = self._next, self._last
        if len(tokens) + MEMO_DEPTH > MEMO_STATES:
            self._next, self._last = following, tokens = {}, [-1]
        first, state, i = [-1], 0, 0
        for byte in head:
            i += 1
            to = following.get(state << 8 | byte)
            if to is None:
                to = following[state << 8 | byte] = len(tokens)
                tokens.append(self.step(head[:i], first, i))
            first.append(tokens[to])
            state = to
        done = base = 0
        last = dict(enumerate(first)) if i == MEMO_DEPTH else first  # position -> last token of the encoding up to it
        window = bytearray(head)  # bytes base .. i
        for byte in run:
            window.append(byte)
            i += 1
            last[i] = self.step(bytes(window[-self.horizon:]), last, i)
            if i % self.horizon == 0 and i > 2 * self.horizon:
                meet = self._meet(last, i)
                if meet > done:
                    yield from self._back(last, meet, done)
                    done = meet
                low = min(done, i - self.horizon)
                last = {p: t for p, t in last.items() if p >= low}
                del window[: low - base]
                base = low
        yield from self._back(last, i, done)

    def _meet(self, last: dict[int, int], i: int) -> int:
        """Where the chains of the last ``horizon`` positions meet."""
        heads = set(range(i - self.horizon + 1, i + 1))
        while len(heads) > 1:
            top = max(heads)
            heads.remove(top)
            heads.add(top - len(self.token_bytes[last[top]]))
        return heads.pop()

    def _back(self, last, end: int, start: int) -> list[int]:
        out = []
        while end > start:
            out.append(last[end])
            end -= len(self.token_bytes[last[end]])
        return out[::-1]

    # -- texts

    def encode(self, text: str) -> Iterator[list[int]]:
        """Ids of a text, piece by piece."""
        for k, part in enumerate(self._split.split(text) if self._split else [text]):
            if k % 2:
                yield [self._special[part]]
                continue
            for words in self._words(part):
                yield list(chain.from_iterable(map(self._memo.__getitem__, words)))

    def _words(self, text: str) -> Iterator[list[str]]:
        """Pre-tokens, cut where white space follows anything else: no pre-token
        reaches over such a place, nor looks past it."""
        start, n = 0, len(text)
        while start < n:
            end = n
            if n - start > SEGMENT:
                cut = _CUT.search(text, start + SEGMENT)
                end = cut.start() if cut else n
            yield self._pretoken.findall(text, start, end) if end == n else self._pretoken.findall(text[start:end])
            start = end

    def decode(self, pieces: Iterable[list[int]]) -> Iterator[str]:
        """Text of ids, piece by piece."""
        machine = codecs.getincrementaldecoder("utf-8")("replace")
        byte = self.token_bytes.__getitem__
        for ids in pieces:
            yield machine.decode(b"".join(map(byte, ids)))
        yield machine.decode(b"", True)


_CUT = re.compile(r"(?<=\S)(?=\s)")


class _Memo(dict):
    """Output of short runs; when half full, it becomes the older half, from which
    runs that are met again move over."""

    def __init__(self, bpe: Bpe):
        self.bpe, self.older = bpe, {}

    def __missing__(self, word: str):
        out = self.older.get(word)
        if out is None:
            run = word.encode()
            if len(run) > MEMO_DEPTH:
                return self.bpe.stream(run)
            out = tuple(self.bpe.stream(run))
        if len(self) >= MEMO_RUNS // 2:
            self.older = dict(self)
            self.clear()
        self[word] = out
        return out


def transducer(box: dict) -> Bpe:
    """The transducer of a broadcast vocabulary; a Python worker that runs several
    tasks keeps it, and what it remembers, with the broadcast."""
    if "bpe" not in box:
        box["bpe"] = Bpe(box["spec"])
    return box["bpe"]


def load_vocab(path: str) -> bytes:
    """The vocabulary file, read once on the driver and sent to the tasks."""
    with open(path, "rb") as f:
        spec = f.read(MAX_VOCAB_BYTES + 1)
    if len(spec) > MAX_VOCAB_BYTES:
        raise ValueError(f"{path} is larger than {MAX_VOCAB_BYTES} bytes")
    return spec


def encode_documents(docs: DataFrame, vocab_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, token_ids array<int>)`` of every row; a null text has no tokens.

    Repeated rows are encoded each; other columns are not read, whatever their names.
    """
    spec = docs.sparkSession.sparkContext.broadcast({"spec": load_vocab(vocab_path)})

    def run(batches):
        bpe, out, held = transducer(spec.value), [], 0
        schema = pa.schema([("doc_id", pa.int64()), ("token_ids", pa.list_(pa.int32()))])
        for i, text in rows_of(batches, "doc_id", "text"):
            ids = list(chain.from_iterable(bpe.encode(text or "")))
            out.append((i, ids))
            held += len(ids)
            if held > 1 << 20:
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], schema.field(k).type) for k in (0, 1)], schema=schema)
                out, held = [], 0
        if out:
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], schema.field(k).type) for k in (0, 1)], schema=schema)

    return docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text")).mapInArrow(run, "doc_id long, token_ids array<int>")


def decode_documents(encoded: DataFrame, vocab_path: str, id_col: str = "doc_id", ids_col: str = "token_ids") -> DataFrame:
    """``(doc_id, text)`` from token ids; null ids give an empty text."""
    spec = encoded.sparkSession.sparkContext.broadcast({"spec": load_vocab(vocab_path)})

    def run(batches):
        bpe = transducer(spec.value)
        for i, ids in rows_of(batches, "doc_id", "token_ids"):
            text = "".join(bpe.decode([ids or []]))
            yield pa.RecordBatch.from_arrays([pa.array([i], pa.int64()), pa.array([text], pa.string())], names=["doc_id", "text"])

    return encoded.select(encoded[id_col].cast("long").alias("doc_id"), encoded[ids_col].alias("token_ids")).mapInArrow(run, "doc_id long, text string")


def round_trip(docs: DataFrame, vocab_path: str, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = False) -> DataFrame:
    """Encode every text, decode the ids again, and return digests of both:
    ``doc_id, n_tokens, ids_sha256, decoded_sha256``, with ``keep_ids`` also
    ``token_ids array<int>`` (then a document's ids are held, 4 bytes each).

    Ids flow from the encoder into the decoder piece by piece; neither the ids
    nor the decoded text of a document are held whole. A null or empty text has
    0 tokens and the digests of nothing; repeated rows give repeated results.
    """
    spec = docs.sparkSession.sparkContext.broadcast({"spec": load_vocab(vocab_path)})
    kinds = [("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())] + ([("token_ids", pa.list_(pa.int32()))] if keep_ids else [])

    def run(batches):
        bpe = transducer(spec.value)
        number = [str(i) for i in range(len(bpe.token_bytes))].__getitem__
        schema = pa.schema(kinds)
        out, held = [], 0
        for i, text in rows_of(batches, "doc_id", "text"):
            ids_sha, text_sha, n, kept = hashlib.sha256(), hashlib.sha256(), 0, array("i")

            def pieces():
                nonlocal n
                for ids in bpe.encode(text or ""):
                    if ids:
                        ids_sha.update(((("," if n else "") + ",".join(map(number, ids)))).encode())
                        n += len(ids)
                        if keep_ids:
                            kept.extend(ids)
                        yield ids

            for piece in bpe.decode(pieces()):
                text_sha.update(piece.encode())
            out.append((i, n, ids_sha.hexdigest(), text_sha.hexdigest(), kept))
            held += len(kept)
            if len(out) == 4096 or held > 1 << 20:
                yield _round_trips(out, schema)
                out, held = [], 0
        if out:
            yield _round_trips(out, schema)

    sql = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + (", token_ids array<int>" if keep_ids else "")
    return docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text")).mapInArrow(run, sql)


def _round_trips(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    cols = [pa.array([r[k] for r in rows], schema.field(k).type) for k in range(4)]
    if len(schema) == 5:
        ends = np.cumsum([0, *(len(r[4]) for r in rows)])
        ids = np.concatenate([np.frombuffer(r[4], np.int32) for r in rows])
        cols.append(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids, pa.int32())))
    return pa.RecordBatch.from_arrays(cols, schema=schema)


ships_by_value(__name__)
