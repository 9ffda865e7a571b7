"""Byte-level BPE encoding by a lazily determinised finite-state transducer.

A token may follow another in an encoding exactly when the two, merged by rank,
stay as they are; an encoding is right exactly when all its neighbours are such,
and then it is the only one. So the last token of every prefix's encoding follows
from the prefixes before it. A state holds the last token emitted and the bytes
behind it whose tokens are not settled, with the last token of each of their
prefixes; reading a byte extends it, and what all positions at which a coming
token could still begin have in common is emitted. Positions are live only while
the bytes behind them begin some token, so the lookahead is bounded by the longest
token. States and moves are made when first reached and thrown away when there are
too many.

Decoding is streamed token by token through a table-driven UTF-8 automaton, whose moves
over whole tokens are tables too: a character that tokens cut is held until it is
complete, and bytes that belong to none become U+FFFD, one for each longest beginning
of a character. The decoded bytes are those of the tokens, whatever they hold.

Defined cases: null counts as empty and has no tokens; texts are read whole;
repeated rows each give their row; a null doc_id stays null; an empty table gives an
empty result; other columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import arrow_map, as_texts, holds_memory, table, tokenizer_file, without_gc

VOCABULARY = "byte_bpe_50k.tiktoken"
MAX_STATES = 400_000
MAX_PIECES = 700_000
DECODE_STEP = 4_096


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, filter(None, map(bytes.strip, f)))}


def merge_by_rank(ranks: dict[bytes, int], piece: bytes, before: int | None = None) -> list[int]:
    """Plain BPE: again and again the leftmost pair of lowest rank (below ``before``) is merged."""
    parts = [piece[i : i + 1] for i in range(len(piece))]
    never = 2 * len(ranks)
    while len(parts) > 1:
        best, at = min((ranks.get(a + b, never), i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)))
        if best >= (never if before is None else before):
            break
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return [ranks[p] for p in parts]


class Transducer:
    """Bytes of one pre-token in, token ids out."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.bytes_of = {v: k for k, v in ranks.items()}
        self.byte = [bytes([i]) for i in range(256)]
        self.openings = {t[:n] for t in ranks for n in range(1, len(t))}
        self.pairs: dict[tuple[int, int], bool] = {}
        self.made_of: dict[int, tuple[int, int] | None] = {}
        self._clear()

    def _clear(self) -> None:
        self.ids: dict[tuple[int, bytes], int] = {}
        #: token before, pending bytes, last and first token of each of their prefixes, live positions
        self.states: list[tuple[int, bytes, tuple[int, ...], tuple[int, ...], tuple[int, ...]]] = []
        self.moves: dict[int, int] = {}  # state and byte -> twice the next state, and one more if tokens are emitted
        self.emitted: dict[int, tuple[int, ...]] = {}
        self.rests: dict[int, list[int]] = {}
        self.start = self._state(-1, b"", (), (), (0,))

    def _state(self, before: int, pending: bytes, last: tuple[int, ...], first: tuple[int, ...], live: tuple[int, ...]) -> int:
        key = (before if live[0] == 0 else -1, pending)  # no coming token stands next to the one before, unless it begins where that ends
        if (found := self.ids.get(key)) is None:
            found = self.ids[key] = len(self.states)
            self.states.append((*key, last, first, live))
        return found

    def _halves(self, token: int) -> tuple[int, int] | None:
        """The two tokens whose merge makes this one; None for a byte, or a token that merging does not reach."""
        if token not in self.made_of:
            whole = self.bytes_of[token]
            parts = merge_by_rank(self.ranks, whole, token) if len(whole) > 1 else []
            self.made_of[token] = (parts[0], parts[1]) if len(parts) == 2 else None
        return self.made_of[token]

    def _edge(self, token: int, side: int) -> list[int]:
        """The tokens that stand at one end of this one while it is merged, from a byte to itself."""
        out = [token]
        while (halves := self._halves(out[-1])) is not None:
            out.append(halves[side])
        return out[::-1]

    def _stays(self, a: int, b: int) -> bool:
        """Whether a before b is an encoding: at no time does what stands on both sides of their border merge."""
        if (found := self.pairs.get((a, b))) is None:
            if len(self.pairs) > 2 * MAX_STATES:
                self.pairs.clear()
            found = self.pairs[a, b] = self._border_holds(self._edge(a, 1), self._edge(b, 0))
        return found

    def _border_holds(self, left: list[int], right: list[int]) -> bool:
        if len(self.bytes_of[left[0]]) > 1 or len(self.bytes_of[right[0]]) > 1:
            return merge_by_rank(self.ranks, self.bytes_of[left[-1]] + self.bytes_of[right[-1]]) == [left[-1], right[-1]]
        i = j = 0
        never = len(self.ranks) * 2
        while True:
            next_left = left[i + 1] if i + 1 < len(left) else never
            next_right = right[j + 1] if j + 1 < len(right) else never
            merged = self.ranks.get(self.bytes_of[left[i]] + self.bytes_of[right[j]], never)
            if merged < next_left and merged <= next_right and merged < never:
                return False  # of equal ranks the leftmost pair goes first
            if next_left == next_right == never:
                return True
            if next_left <= next_right:
                i += 1
            if next_right <= next_left:
                j += 1

    def _chain(self, last: tuple[int, ...], end: int) -> list[int]:
        """Tokens of the pending bytes up to ``end``."""
        out = []
        while end:
            out.append(last[end - 1])
            end -= len(self.bytes_of[out[-1]])
        return out[::-1]

    def _firsts(self, last: tuple[int, ...]) -> tuple[int, ...]:
        """The first pending token of each prefix; -1 where its tokens do not begin with the pending bytes."""
        out: list[int] = []
        for end, token in enumerate(last, 1):
            start = end - len(self.bytes_of[token])
            out.append(token if start == 0 else out[start - 1] if start > 0 else -1)
        return tuple(out)

    def _move(self, state: int, byte: int) -> int:
        before, pending, last, first, live = self.states[state]
        pending += self.byte[byte]
        found = lead = -1
        still = []
        for start in live:  # ascending, so that the longest token comes first
            tail = pending[start:]
            if found < 0 and (token := self.ranks.get(tail)) is not None:
                left = last[start - 1] if start else before
                if left < 0 or self._stays(left, token):
                    found, lead = token, first[start - 1] if start else token
            if tail in self.openings:
                still.append(start)
        last, first = (*last, found), (*first, lead)
        still.append(len(pending))
        emitted = []
        while still[0] > 0 and all(first[i - 1] == lead for i in still):
            emitted.append(lead)
            before, cut = lead, len(self.bytes_of[lead])
            pending, last, still = pending[cut:], last[cut:], [i - cut for i in still]
            first = self._firsts(last)
            lead = first[-1] if first else -1
        key = state << 8 | byte
        if emitted:
            self.emitted[key] = tuple(emitted)
        self.moves[key] = out = 2 * self._state(before, pending, last, first, tuple(still)) + bool(emitted)
        return out

    def encode(self, piece: bytes) -> list[int]:
        if (whole := self.ranks.get(piece)) is not None:
            return [whole]
        if len(self.states) > MAX_STATES:
            self._clear()
        state, out = self.start, []
        for byte in piece:
            move = self.moves.get(state << 8 | byte)
            if move is None:
                move = self._move(state, byte)
            if move & 1:
                out += self.emitted[state << 8 | byte]
            state = move >> 1
            if len(self.states) > 4 * MAX_STATES:  # within one very long piece
                kept = self.states[state]
                self._clear()
                state = self._state(*kept)
        if (rest := self.rests.get(state)) is None:
            _, pending, last, *_ = self.states[state]
            rest = self.rests[state] = self._chain(last, len(pending))
        out += rest
        return out


def packed_ids(ids: list[int]) -> bytes:
    """Little-endian unsigned 32-bit integers."""
    return struct.pack(f"<{len(ids)}I", *ids)


class _Pieces(dict):
    """Pre-token -> its ids packed as little-endian 32-bit integers; when full, what was not used of late goes."""

    def __init__(self, transducer: Transducer):
        super().__init__()
        self.transducer = transducer
        self.older: dict[str, bytes] = {}

    def __missing__(self, piece: str) -> bytes:
        if (found := self.older.get(piece)) is None:
            found = packed_ids(self.transducer.encode(piece.encode("utf-8", "surrogatepass")))
        if len(piece) <= 64:
            if len(self) >= MAX_PIECES // 2:
                self.older = dict(self)
                self.clear()
            self[piece] = found
        return found


#: States of the UTF-8 automaton: between characters, bytes to come, after the bytes that narrow the next one, none.
START, ONE, TWO, THREE, AFTER_E0, AFTER_ED, AFTER_F0, AFTER_F4, REJECT = range(9)


@cache
def utf8_table() -> np.ndarray:
    """(state, byte) -> state, of well-formed UTF-8."""
    table = np.full((9, 256), REJECT, np.uint8)
    moves = [
        (START, 0x00, 0x7F, START), (START, 0xC2, 0xDF, ONE), (START, 0xE0, 0xE0, AFTER_E0), (START, 0xE1, 0xEC, TWO), (START, 0xED, 0xED, AFTER_ED), (START, 0xEE, 0xEF, TWO),
        (START, 0xF0, 0xF0, AFTER_F0), (START, 0xF1, 0xF3, THREE), (START, 0xF4, 0xF4, AFTER_F4), (ONE, 0x80, 0xBF, START), (TWO, 0x80, 0xBF, ONE), (THREE, 0x80, 0xBF, TWO),
        (AFTER_E0, 0xA0, 0xBF, ONE), (AFTER_ED, 0x80, 0x9F, ONE), (AFTER_F0, 0x90, 0xBF, TWO), (AFTER_F4, 0x80, 0x8F, TWO),
    ]
    for state, low, high, to in moves:
        table[state, low : high + 1] = to
    return table


def token_moves(bytes_of: dict[int, bytes]) -> np.ndarray:
    """(state, token) -> state behind the token's bytes; REJECT stays."""
    table, size = utf8_table(), max(bytes_of, default=-1) + 1
    lengths = np.zeros(size, np.int64)
    for i, data in bytes_of.items():
        lengths[i] = len(data)
    starts = np.concatenate([[0], np.cumsum(lengths)])
    flat = np.frombuffer(b"".join(bytes_of.get(i, b"") for i in range(size)), np.uint8)
    moves = np.repeat(np.arange(9, dtype=np.uint8)[:, None], size, axis=1)
    for at in range(int(lengths.max(initial=0))):
        some = np.flatnonzero(lengths > at)
        moves[:, some] = table[moves[:, some], flat[starts[some] + at]]
    return moves


class Utf8Stream:
    """Incremental UTF-8: bytes or tokens in, the text they complete out; a character that is open waits for more."""

    def __init__(self, bytes_of: dict[int, bytes] | None = None, moves: np.ndarray | None = None) -> None:
        self.bytes_of, self.moves = bytes_of, moves
        self.table = utf8_table().tolist()
        self.state, self.open = START, b""

    def feed(self, data: bytes) -> str:
        """Byte by byte."""
        out, held = [], bytearray(self.open)
        for byte in data:
            to = self.table[self.state][byte]
            if to == REJECT:
                if self.state != START:  # the open character ends here, and the byte may begin another
                    out.append("\ufffd")
                    held.clear()
                    to = self.table[START][byte]
                if to == REJECT:
                    out.append("\ufffd")
                    self.state = START
                    continue
            held.append(byte)
            self.state = to
            if to == START:
                out.append(held.decode())
                held.clear()
        self.open = bytes(held)
        return "".join(out)

    def feed_tokens(self, ids: np.ndarray) -> str:
        """Token by token; where no token rejects, their bytes are text as they stand."""
        data = b"".join(map(self.bytes_of.__getitem__, ids.tolist()))
        after = self.moves[START, ids]
        if self.state == START and not after.any():
            return data.decode()
        state = self.state
        for i, from_start in zip(ids.tolist(), after.tolist(), strict=True):
            state = from_start if state == START else int(self.moves[state, i])
        if state == REJECT:
            return self.feed(data)
        data = self.open + data
        cut = len(data) - (next(n for n in (1, 2, 3) if data[-n] & 0xC0 != 0x80) if state != START else 0)
        self.state, self.open = state, data[cut:]
        return data[:cut].decode()

    def close(self) -> str:
        rest, self.open, self.state = self.open, b"", START
        return "\ufffd" if rest else ""


class Codec:
    """Whole texts to packed ids and back."""

    def __init__(self, path: str, pattern: str | None = None):
        if pattern is None:
            import public_tokenizers

            pattern = public_tokenizers.PATTERN
        self.find = regex.compile(pattern).findall
        transducer = Transducer(read_ranks(path))
        self.bytes_of, self.moves = transducer.bytes_of, token_moves(transducer.bytes_of)
        self.pieces = _Pieces(transducer)

    def encode(self, text: str) -> bytes:
        return b"".join(map(self.pieces.__getitem__, self.find(text)))

    def decode(self, packed: bytes) -> Iterator[tuple[bytes, str]]:
        """The tokens' bytes, a bounded run of tokens at a time, and the text that they complete."""
        ids, stream = np.frombuffer(packed, "<u4"), Utf8Stream(self.bytes_of, self.moves)
        for i in range(0, len(ids), DECODE_STEP):
            run = ids[i : i + DECODE_STEP]
            yield b"".join(map(self.bytes_of.__getitem__, run.tolist())), stream.feed_tokens(run)
        yield b"", stream.close()


@cache
def codec(path: str) -> Codec:
    return Codec(path)


holds_memory(__name__, codec.cache_clear)


def encode_documents(docs: DataFrame, path: str | None = None) -> DataFrame:
    """One row per document: token count, digests of its ids and of the bytes they decode to, and the characters of the text those are."""
    where = path or tokenizer_file(VOCABULARY)

    @without_gc
    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        tool, counts, ids, back, chars = codec(where), [], [], [], []
        for text in as_texts(batch.column(1)):
            packed = tool.encode(text)
            digest, length = hashlib.sha256(), 0
            for data, part in tool.decode(packed):
                digest.update(data)
                length += len(part)
            chars.append(length)
            counts.append(len(packed) // 4)
            ids.append(hashlib.sha256(packed).hexdigest())
            back.append(digest.hexdigest())
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(ids, pa.string()), pa.array(back, pa.string()), pa.array(chars, pa.int64())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "decoded_chars"])

    return arrow_map(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, decoded_chars long")


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_documents(table(spark, sf_dir, "documents"))
