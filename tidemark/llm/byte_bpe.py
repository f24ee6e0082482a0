"""Byte-level BPE encoding by a lazily determinised transducer, and streaming decoding.

The merges are never run over a text. A sequence of tokens is the encoding of its bytes exactly when every two
neighbours are, so the last token of every prefix is unique: the one suffix token that stands next to the last token
of the prefix before it. A state is the last settled token and the bytes after it; reading a byte finds the new last
token, and tokens are settled as soon as every continuation passes the same boundary. How far that looks ahead is
bounded by the longest token. An arrow and its state are made when a second piece takes it, states are kept by key,
and all are forgotten when ``STATES`` of them exist. Encodings of words are kept too, the lately used of them (``PIECES``), so a worker's
memory is bounded whatever the text. The vocabulary file is a parameter, read by each worker.

Decoding puts token bytes one after another; text is given out by a small UTF-8 state machine that holds back the
unfinished character at a chunk's end.

Defined results: a null or empty text has no tokens. Rows are encoded one by one, repeated or not. A file of ranks
must hold all 256 single bytes. Whole texts are encoded, of any length.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from tidemark.llm import words

STATES = 20_000
PIECES = 500_000
PAIRS = 200_000
#: Fixed value: the public pattern that goes with the rank files; other patterns work, without the shortcut at spaces.
SPACED_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


class State:
    """What is known after some bytes of a piece.

    ``rest`` are the bytes since the last settled token; ``last`` has that token (-1: none) and then the last token of
    each prefix of the rest, ``path`` the boundaries of each as bits. ``live`` are the places where a longer token may
    have begun, with the place in the tree of tokens. A prefix whose last token began before the settled boundary has
    no path, and no continuation uses it.
    """

    __slots__ = ("rest", "last", "path", "live", "arrows", "ending")

    def __init__(self, rest: bytes, last: tuple[int, ...], path: tuple[int, ...], live: tuple[tuple[int, int], ...]):
        self.rest, self.last, self.path, self.live = rest, last, path, live
        self.arrows: dict[int, tuple[State, tuple[int, ...]] | None] = {}
        self.ending: tuple[int, ...] | None = None


def _tokens(last: tuple[int, ...], path: int) -> tuple[int, ...]:
    """The tokens that end at the boundaries of ``path``."""
    return tuple([last[k] for k in range(1, path.bit_length()) if path >> k & 1])


class Transducer:
    """Encodes one piece of text at a time."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.tokens = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.tokens[rank] = token
        self.made: dict[bytes, tuple[bytes, ...]] = {}
        self.edges: dict[tuple[int, int], list[tuple[bytes, int, float]] | None] = {}
        self.pairs = words.Recent(self.neighbours, PAIRS)
        # the tree of tokens: child of (place << 8 | byte), token at a place, and whether longer ones follow
        self.children: dict[int, int] = {}
        self.token_at, self.inner = [-1], [True]
        for token, rank in ranks.items():
            place = 0
            for byte in token:
                below = self.children.get(place << 8 | byte)
                if below is None:
                    below = self.children[place << 8 | byte] = len(self.token_at)
                    self.token_at.append(-1)
                    self.inner.append(False)
                    self.inner[place] = True
                place = below
            self.token_at[place] = rank
        if any(byte not in self.children for byte in range(256)):
            raise ValueError("The ranks do not hold every single byte.")
        self._forget()

    def _forget(self) -> None:
        self.states: dict[tuple[int, bytes], State] = {}
        self.start = State(b"", (-1,), (1,), ())

    def halves(self, token: bytes) -> tuple[bytes, ...]:
        """What the token's last merge joins; empty if the merges don't give it whole."""
        known = self.made.get(token)
        if known is None:
            whole, before = self.merged(token)
            known = self.made[token] = tuple(before) if len(whole) == 1 else ()
        return known

    def merged(self, piece: bytes) -> tuple[list[bytes], list[bytes]]:
        """The merges themselves, lowest rank and leftmost first, and the parts before the last one.

        Only used once on every single token, to see what it is made of.
        """
        parts = [piece[k:k + 1] for k in range(len(piece))]
        before, ranks = parts, self.ranks
        while len(parts) > 1:
            best, at = None, -1
            for k in range(len(parts) - 1):
                rank = ranks.get(parts[k] + parts[k + 1])
                if rank is not None and (best is None or rank < best):
                    best, at = rank, k
            if best is None:
                break
            before = parts
            parts = [*parts[:at], parts[at] + parts[at + 1], *parts[at + 2:]]
        return parts, before

    def edge(self, token: int, side: int) -> list[tuple[bytes, int, float]] | None:
        """The parts of a token that touch its first (0) or last (-1) end, from whole to single byte.

        Each with the rank that makes it (-1 for a byte) and the rank of the merge that takes it in. None: the
        merges never give this token whole.
        """
        known = self.edges.get((token, side), ())
        if known == ():
            piece, taken, known = self.tokens[token], float("inf"), []
            while True:
                parts = self.halves(piece)
                if not parts:
                    known = None
                    break
                made = self.ranks[piece] if len(piece) > 1 else -1
                known.append((piece, made, taken))
                if len(piece) == 1:
                    break
                piece, taken = parts[side], made
            self.edges[token, side] = known
        return known

    def neighbours(self, pair: int) -> bool:
        """Do two tokens side by side stay apart? After none (-1): does the token come out whole?

        They do unless some part at the end of the left one and some part at the beginning of the right one, which
        exist at the same time, merge: before the left part is taken in, and not after the right part is (of two
        merges of one rank the left one comes first).
        """
        left, right = (pair >> 32) - 1, pair & 0xFFFFFFFF
        starts = self.edge(right, 0)
        ends = self.edge(left, -1) if left >= 0 else []
        if starts is None or ends is None:
            return False
        get = self.ranks.get
        for a, made_a, taken_a in ends:
            for b, made_b, taken_b in starts:
                rank = get(a + b)
                if rank is not None:
                    when = max(rank, made_a, made_b)
                    if when < taken_a and when <= taken_b:
                        return False
        return True

    def _step(self, last: Sequence[int], live: Sequence[tuple[int, int]], byte: int) -> tuple[int, int, list]:
        """The last token once ``byte`` is read, where it begins, and the places that stay live."""
        token, begun, still = -1, 0, []
        children, pairs, token_at, inner = self.children, self.pairs, self.token_at, self.inner
        for begin, place in live:  # the longest token first
            below = children.get(place << 8 | byte)
            if below is not None:
                if token < 0:
                    here = token_at[below]
                    if here >= 0 and pairs[last[begin] + 1 << 32 | here]:
                        token, begun = here, begin
                if inner[below]:
                    still.append((begin, below))
        below, begin = children[byte], len(last) - 1
        if token < 0:
            token, begun = token_at[below], begin
        if inner[below]:
            still.append((begin, below))
        return token, begun, still

    def _arrow(self, state: State, byte: int) -> tuple[State, tuple[int, ...]]:
        token, begun, live = self._step(state.last, state.live, byte)
        end = len(state.last)
        common = own = state.path[begun] | 1 << end
        for begin, _ in live:
            common &= state.path[begin]
        rest, last, path = state.rest + bytes((byte,)), (*state.last, token), (*state.path, own)
        settled, given = common.bit_length() - 1, ()
        if settled:  # every continuation passes this boundary
            given = _tokens(last, path[settled])
            rest, last = rest[settled:], last[settled:]
            path = tuple([x >> settled if x >> settled & 1 else 0 for x in path[settled:]])
            live = [(begin - settled, place) for begin, place in live]
        key = (last[0], rest)
        to = self.states.get(key)
        if to is None:
            if len(self.states) >= STATES:
                self._forget()
            to = self.states[key] = State(rest, last, path, tuple(live))
        return to, given

    def _beginnings(self, text: bytes, at: int) -> list[int]:
        """Tokens that begin at a place, the longest last."""
        found, place = [], 0
        children, token_at = self.children, self.token_at
        for k in range(at, len(text)):
            place = children.get(place << 8 | text[k])
            if place is None:
                break
            if token_at[place] >= 0:
                found.append(token_at[place])
        return found

    def _finish(self, state: State, tail: bytes) -> list[int]:
        """Reads a tail that no piece had before without making states for it.

        A sequence whose neighbours all stay apart is the encoding, so the first one found is: the longest token
        first, and back where none fits. What led nowhere is not tried again.
        """
        text, left, tokens, pairs = state.rest + tail, state.last[0], self.tokens, self.pairs
        out, ends, choices, dead = [], [0], [self._beginnings(text, 0)], set()
        while True:
            end, before = ends[-1], out[-1] if out else left
            while choices[-1]:
                token = choices[-1].pop()
                if pairs[before + 1 << 32 | token] and (end, token) not in dead:
                    break
            else:
                choices.pop(), ends.pop()
                dead.add((ends[-1], out.pop()))
                continue
            out.append(token)
            end += len(tokens[token])
            if end == len(text):
                return out
            ends.append(end)
            choices.append(self._beginnings(text, end))

    def encode(self, piece: bytes) -> list[int]:
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        state, out = self.start, []
        for k, byte in enumerate(piece):
            found = state.arrows.get(byte)
            if found is None:
                if byte not in state.arrows:  # an arrow is made when it is asked for again
                    state.arrows[byte] = None
                    out.extend(self._finish(state, piece[k:]))
                    return out
                found = state.arrows[byte] = self._arrow(state, byte)
            state, given = found
            if given:
                out.extend(given)
        if state.ending is None:
            state.ending = _tokens(state.last, state.path[-1])
        out.extend(state.ending)
        return out


class _Together(Exception):
    """A part can't be encoded without its neighbours."""


class Codec:
    """A vocabulary and the pattern that cuts text into pieces."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, kept: int | None = None):
        kept = kept or PIECES
        self.transducer = Transducer(ranks)
        self.cut = regex.compile(pattern).findall
        self.spaced = pattern == SPACED_PATTERN
        self.pieces = words.Recent(self._piece, kept // 4)
        self.parts = words.Recent(self._part, kept)

    def _piece(self, piece: str) -> bytes:
        ids = self.transducer.encode(piece.encode())
        return struct.pack(f"<{len(ids)}I", *ids)

    def _whole(self, text: str) -> bytes:
        return b"".join(map(self.pieces.__getitem__, self.cut(text)))

    def _part(self, part: str) -> bytes:
        if not part or part[0].isspace() or part[-1].isspace():
            raise _Together
        return self._whole(" " + part)

    def encode(self, text: str) -> bytes:
        """Token ids as little-endian 32-bit integers, side by side.

        Under ``SPACED_PATTERN`` a piece begins at every single space between two other characters, so such parts
        are encoded by themselves; a text with other white space beside a space is cut as a whole.
        """
        if self.spaced:
            first, *rest = text.split(" ")
            if rest and first and not first[-1].isspace():
                try:
                    return self._whole(first) + b"".join(map(self.parts.__getitem__, rest))
                except _Together:
                    pass
        return self._whole(text)

    def decode(self, ids: np.ndarray) -> bytes:
        tokens = self.transducer.tokens
        return b"".join(map(tokens.__getitem__, ids.tolist()))


_CODECS: dict[tuple[str, str, int | None], Codec] = {}


def codec(path: str, pattern: str, kept: int | None = None) -> Codec:
    """The codec of a rank file (base64 token and rank a line), one per worker; ``kept`` words stay encoded."""
    if (path, pattern, kept) not in _CODECS:
        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in lines if x.strip())}
        _CODECS.clear()
        _CODECS[path, pattern, kept] = Codec(ranks, pattern, kept)
    return _CODECS[path, pattern, kept]


class Utf8Stream:
    """Text from chunks of bytes cut anywhere; what can't be UTF-8 comes out as U+FFFD."""

    def __init__(self) -> None:
        self.held = b""

    @staticmethod
    def _open(data: bytes) -> int:
        """Bytes at the end that may begin a character: back to its lead byte, if more is to come."""
        for back in range(1, min(3, len(data)) + 1):
            byte = data[-back]
            if byte < 0x80:
                return 0
            if byte >= 0xC0:
                size = 2 if byte < 0xE0 else 3 if byte < 0xF0 else 4 if byte < 0xF5 else 1
                return back if size > back else 0
        return 0

    def feed(self, chunk: bytes) -> str:
        data = self.held + chunk
        cut = len(data) - self._open(data)
        self.held = data[cut:]
        return data[:cut].decode("utf-8", "replace")

    def close(self) -> str:
        rest, self.held = self.held, b""
        return rest.decode("utf-8", "replace")


def _encode(batches: Iterator[pa.RecordBatch], path: str, pattern: str, kept: int | None = None) -> Iterator[pa.RecordBatch]:
    """Adds ``n_tokens`` and ``ids``; the last column of a batch is the text, and is left out."""
    own = codec(path, pattern, kept)
    for batch in batches:
        texts = batch.column(batch.num_columns - 1)
        offsets, raw = words.buffers(texts)
        lo = 0
        while lo < batch.num_rows:
            hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + words.CHUNK_BYTES, side="right")) - 1)
            made = [own.encode(raw[a:b].tobytes().decode("utf-8", "replace"))
                    for a, b in zip(offsets[lo:hi].tolist(), offsets[lo + 1:hi + 1].tolist(), strict=True)]
            n = np.array([len(x) // 4 for x in made], dtype=np.int64)
            ends = np.concatenate([[0], np.cumsum(n)]).astype(np.int32)
            ids = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(made), dtype="<i4")))
            yield pa.RecordBatch.from_arrays(
                [*(c.slice(lo, hi - lo) for c in batch.columns[:-1]), pa.array(n), ids],
                [*batch.schema.names[:-1], "n_tokens", "ids"])
            lo = hi
        words.release()


def _with_text_last(docs: DataFrame) -> tuple[DataFrame, str]:
    """The frame with its text at the end, and the columns before it as DDL."""
    others = [f for f in docs.schema.fields if f.name not in ("text", "n_tokens", "ids")]
    ordered = docs.select(*[f"`{f.name}`" for f in others], docs["text"].cast("string").alias("text"))
    return ordered, "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in others)


def encoded(docs: DataFrame, path: str, pattern: str, kept: int | None = None) -> DataFrame:
    """The columns of ``docs`` but ``text``, then n_tokens and ids (array<int>), in place of any of these names.

    ``kept`` bounds the words whose encodings a worker keeps (``PIECES`` if not given): fewer take less memory and
    more time, and change nothing else.
    """
    ordered, ddl = _with_text_last(docs)
    return ordered.mapInArrow(lambda batches: _encode(batches, path, pattern, kept), ddl + "n_tokens bigint, ids array<int>")


def decoded(tokens: DataFrame, path: str, pattern: str) -> DataFrame:
    """The columns of ``tokens`` but ``ids``, then the decoded ``text``, in place of any; ids may be null."""
    others = [f for f in tokens.schema.fields if f.name not in ("ids", "text")]
    ordered = tokens.select(*[f"`{f.name}`" for f in others], tokens["ids"].cast("array<int>").alias("ids"))
    ddl = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in others)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path, pattern)
        for batch in batches:
            texts = []
            for row in batch.column(batch.num_columns - 1):
                stream, ids = Utf8Stream(), np.array(row.as_py() or [], dtype=np.int64)
                parts = [stream.feed(own.decode(ids[k:k + 4096])) for k in range(0, len(ids), 4096)]
                texts.append("".join(parts) + stream.close())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(texts, pa.string())],
                                             [*batch.schema.names[:-1], "text"])

    return ordered.mapInArrow(run, ddl + "text string")


def digests(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """Per row: doc_id, n_tokens, ids_sha256 and decoded_sha256 of a round trip, in one pass over the texts."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path, pattern)
        for batch in _encode(batches, path, pattern):
            lists = batch.column(2)
            at, flat = lists.offsets.to_numpy(), lists.values.to_numpy()
            of_ids, of_bytes = [], []
            for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
                of_ids.append(hashlib.sha256(flat[a:b].tobytes()).hexdigest())
                digest = hashlib.sha256()
                for k in range(a, b, 65536):
                    digest.update(own.decode(flat[k:min(k + 65536, b)]))
                of_bytes.append(digest.hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(of_ids, pa.string()), pa.array(of_bytes, pa.string())],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    made = docs.select("doc_id", docs["text"].cast("string").alias("text"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    return made.mapInArrow(run, f"doc_id {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string")
