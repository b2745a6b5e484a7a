"""Byte-level BPE: encoding by a lazily determinised transducer, decoding by a UTF-8 state machine.

A sequence of tokens is what the merges give for its bytes if and only if each two neighbours are what
the merges give for theirs. So the prefixes of a piece form a chain of (token, previous token) choices,
and the machine that guesses where the open token began is a finite transducer. Its subset construction
is done lazily: a state is the set of live guesses (bytes of the open token, last token, tokens not yet
written), made when first met and kept. A token is written as soon as all live guesses share it, at most
the longest token's length later. The table of states is bounded; when it is full, a piece that needs a
state it lacks is run on the guesses themselves, with the same result.

Runs of whole pieces from the start state are kept too (they are one long transition), in a bounded table.

Defined results: null text counts as empty and gives no ids; texts of any length are encoded whole, in
pieces; every match of the pattern is encoded by itself; no special tokens; repeated rows and rows with a
null doc_id give their own results; an empty table gives an empty result; other columns are ignored. Bytes that
aren't UTF-8 decode to U+FFFD, one for each longest prefix of a character.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import re
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import documents, rows_of

#: White space as Unicode's property has it; Python's \s also has the separators 1C to 1F.
SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"

#: Bounds of the tables that a worker keeps: states, pieces' ids, neighbours that were tested.
STATES, PIECES, PAIRS = 25_000, 700_000, 500_000


def pattern_of(public: str) -> regex.Pattern:
    r"""The splitting pattern with \s and \S spelled out."""
    inside = public.replace(r"[^\s", rf"[^{SPACE}").replace(r"(?!\S)", rf"(?![^{SPACE}])").replace(r"\s", rf"[{SPACE}]")
    return regex.compile(inside)


#: The pattern whose fast form follows. Fixed value.
KNOWN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
LATIN = "A-Za-z\xc0-\xd6\xd8-\xf6\xf8-\xff"


def splitter_of(public: str) -> Callable[[str], list[str]]:
    """A function from text to the pattern's matches. Texts of ASCII and Latin-1 letters alone, where classes can be spelled out, take a faster path."""
    full = pattern_of(public).findall
    if public != KNOWN:
        return full
    fast = re.compile(rf" ?[{LATIN}]+| ?[0-9]+|'(?:[stmd]|re|ve|ll)| ?[^\t-\r 0-9{LATIN}]+|[\t-\r ]+(?![^\t-\r ])|[\t-\r ]+").findall
    other = re.compile(rf"[^\x00-\x7f{LATIN}]").search
    return lambda text: full(text) if other(text) else fast(text)


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as file:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, filter(None, map(bytes.strip, file)))}


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[bytes]:
    """Merge the neighbours of least rank, leftmost first, until none can be merged."""
    parts = [piece[i : i + 1] for i in range(len(piece))]
    while len(parts) > 1:
        best, at = None, -1
        for i in range(len(parts) - 1):
            rank = ranks.get(parts[i] + parts[i + 1])
            if rank is not None and (best is None or rank < best):
                best, at = rank, i
        if best is None:
            break
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return parts


class Transducer:
    """Bytes in, token ids out."""

    START = ((b"", -1, ()),)

    def __init__(self, ranks: dict[bytes, int], states: int = STATES):
        self.ranks, self.limit = ranks, states
        self.tokens = {i: t for t, i in ranks.items()}
        self.open = {t[:k] for t in ranks for k in range(1, len(t))}
        self.lookahead = max(map(len, ranks))
        self.fits_: dict[int, bool] = {}  # by both ids in one number
        # states by number: their guesses, their known steps, and what the end of a piece writes
        self.numbers: dict[tuple, int] = {}
        self.states: list[tuple] = []
        self.steps: list[dict[int, tuple[int, tuple]]] = []
        self.last: list[tuple] = []
        self._number(self.START)

    def _number(self, state: tuple) -> int:
        found = self.numbers.get(state)
        if found is None:
            found = self.numbers[state] = len(self.states)
            self.states.append(state)
            self.steps.append({})
            self.last.append(next(w for p, _, w in state if not p))
        return found

    def fits(self, last: int, token: int) -> bool:
        key = (last + 1) << 32 | token
        found = self.fits_.get(key)
        if found is None:
            if len(self.fits_) >= PAIRS:
                self.fits_.clear()
            a, b = self.tokens.get(last, b""), self.tokens[token]
            found = self.fits_[key] = merge(a + b, self.ranks) == ([a, b] if a else [b])
        return found

    def _determine(self, state: tuple, byte: bytes) -> tuple[tuple, tuple]:
        """The next state and what is written: the lazy part of the subset construction."""
        ranks, live, done = self.ranks, [], None
        for part, last, waiting in state:
            grown = part + byte
            if grown in self.open:
                live.append((grown, last, waiting))
            token = ranks.get(grown)
            if done is None and token is not None and self.fits(last, token):
                done = (b"", token, (*waiting, token))
        if done is None:
            raise ValueError(f"no token ends here: the vocabulary lacks the byte {byte!r}")
        live.append(done)
        k, least = 0, min(len(x[2]) for x in live)
        while k < least and all(x[2][k] == done[2][k] for x in live):
            k += 1
        return tuple((p, t, w[k:]) for p, t, w in live), done[2][:k]

    def _step(self, number: int, byte: int) -> tuple[int, tuple] | None:
        """Determinise one more step, while the table of states has room."""
        if len(self.states) >= self.limit:
            return None
        state, written = self._determine(self.states[number], bytes((byte,)))
        found = self.steps[number][byte] = (self._number(state), written)
        return found

    def _simulate(self, piece: bytes) -> list[int]:
        """The same machine without determinisation: for each place, the one token that ends there."""
        ranks, fits, known, most = self.ranks, self.fits, self.fits_.get, self.lookahead
        ends = [(-1, 0)]
        for end in range(1, len(piece) + 1):
            for start in range(max(0, end - most), end):
                token = ranks.get(piece[start:end])
                if token is not None:
                    last = ends[start][0]
                    good = known((last + 1) << 32 | token)
                    if good or good is None and fits(last, token):
                        ends.append((token, start))
                        break
            else:
                raise ValueError(f"no token ends here: the vocabulary lacks the byte {piece[end - 1 : end]!r}")
        out, at = [], len(piece)
        while at:
            token, at = ends[at]
            out.append(token)
        return out[::-1]

    def run(self, piece: bytes) -> list[int]:
        number, out, steps = 0, [], self.steps
        for byte in piece:
            found = steps[number].get(byte) or self._step(number, byte)
            if found is None:
                return self._simulate(piece)
            number, written = found
            if written:
                out += written
        out += self.last[number]
        return out

    def encode(self, piece: bytes) -> list[int]:
        whole = self.ranks.get(piece)
        return self.run(piece) if whole is None else [whole]


#: First bytes of UTF-8 characters, by range, with the continuation bytes that are to come and the range of the first of them. Fixed values.
LEADS = [(0xC2, 0xDF, 1, 0x80, 0xBF), (0xE0, 0xE0, 2, 0xA0, 0xBF), (0xE1, 0xEC, 2, 0x80, 0xBF), (0xED, 0xED, 2, 0x80, 0x9F), (0xEE, 0xEF, 2, 0x80, 0xBF), (0xF0, 0xF0, 3, 0x90, 0xBF), (0xF1, 0xF3, 3, 0x80, 0xBF), (0xF4, 0xF4, 3, 0x80, 0x8F)]


def utf8_steps() -> list[list[int]]:
    """The machine's table, state by byte: state 0 is between characters, -1 no step. A state is what may come next."""
    states = {(0, 0, 0): 0}
    steps = [[0] * 0x80 + [-1] * 0x80]

    def number(state: tuple[int, int, int]) -> int:
        if state not in states:
            states[state] = len(steps)
            steps.append([-1] * 256)
            missing, low, high = state
            steps[states[state]][low : high + 1] = [number((missing - 1, 0x80, 0xBF)) if missing > 1 else 0] * (high + 1 - low)
        return states[state]

    for first, last, *state in LEADS:
        steps[0][first : last + 1] = [number(tuple(state))] * (last + 1 - first)
    return steps


class Utf8:
    """Incremental UTF-8 decoding: a machine steps over every byte; in state 0 it stays over ASCII, which is taken in runs."""

    STEPS = utf8_steps()
    BEYOND = re.compile(rb"[\x80-\xff]")

    def __init__(self):
        self.state, self.held = 0, b""

    def feed(self, chunk: bytes) -> str:
        """Text that is complete; an unfinished character is held. A byte that can't follow ends the character, which gives U+FFFD, and begins anew."""
        steps, beyond, state = self.STEPS, self.BEYOND.search, self.state
        data = self.held + chunk if self.held else chunk
        # done: what is given out already; begin: where the open character begins
        out, done, begin, at, n = [], 0, 0, len(self.held), len(data)
        while at < n:
            if not state:
                found = beyond(data, at)
                if found is None:
                    at = n
                    break
                begin = at = found.start()
            after = steps[state][data[at]]
            if after >= 0:
                state, at = after, at + 1
                continue
            out += data[done:begin].decode(), "\ufffd"
            at += not state
            done, begin, state = at, at, 0
        end = begin if state else n
        self.state, self.held = state, data[end:]
        out.append(data[done:end].decode())
        return "".join(out)

    def close(self) -> str:
        held, self.state, self.held = self.held, 0, b""
        return "\ufffd" if held else ""


class Codec:
    """Texts to ids and back for one rank file and splitting pattern."""

    def __init__(self, path: str, public_pattern: str):
        self.machine = Transducer(load_ranks(path))
        self.split = splitter_of(public_pattern)
        self.pieces: dict[str, str] = {}

    def _joined(self, piece: str) -> str:
        out = ",".join(map(str, self.machine.encode(piece.encode())))
        if len(self.pieces) < PIECES and len(piece) < 64:  # frequent pieces come early; later ones are run each time
            self.pieces[piece] = out
        return out

    def encode_joined(self, text: str) -> str:
        """Decimal ids joined by commas."""
        known, joined = self.pieces, self._joined
        return ",".join([known.get(p) or joined(p) for p in self.split(text)])

    def encode(self, text: str) -> list[int]:
        return [int(x) for x in self.encode_joined(text).split(",")] if text else []

    def decode_bytes(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.machine.tokens.__getitem__, ids))

    def decode_stream(self, ids: Iterable[int], chunk: int = 4096) -> Iterator[str]:
        """Text as the ids come: each piece given out is whole characters."""
        machine, waiting = Utf8(), []
        for i in ids:
            waiting.append(i)
            if len(waiting) >= chunk:
                yield machine.feed(self.decode_bytes(waiting))
                waiting = []
        yield machine.feed(self.decode_bytes(waiting)) + machine.close()


@functools.lru_cache(maxsize=1)
def codec_of(path: str, public_pattern: str) -> Codec:
    """The codec of a Python worker, which outlives single tasks."""
    return Codec(path, public_pattern)


def codec_rows(docs: DataFrame, path: str, public_pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 and n_chars (code points of the streamed decoding) of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = codec_of(path, public_pattern)
        tokens = {str(i): t for i, t in codec.machine.tokens.items()}
        for batch in batches:
            out: list[list] = [[], [], [], [], []]
            for doc_id, text in rows_of(batch):
                joined = codec.encode_joined(text or "")
                ids = joined.split(",") if joined else []
                digest, decoder, chars = hashlib.sha256(), Utf8(), 0
                for at in range(0, len(ids), 65536):
                    part = b"".join(map(tokens.__getitem__, ids[at : at + 65536]))
                    digest.update(part)
                    chars += len(decoder.feed(part))
                chars += len(decoder.close())
                for column, value in zip(out, (doc_id, len(ids), hashlib.sha256(joined.encode()).hexdigest(), digest.hexdigest(), chars)):
                    column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.string()), pa.array(out[3], pa.string()), pa.array(out[4], pa.int64())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "n_chars"])

    return documents(docs).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, n_chars long")
