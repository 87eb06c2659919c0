"""Problem 7: encoding with a public byte-level BPE vocabulary, and streaming decode.

The merges are compiled into a finite-state transducer that is determinised as it is used. A state is what
has been read of a piece and isn't settled yet: the last token put out and the bytes after it. A token is
put out as soon as every way on shares it, so the bytes held back are never more than the longest token.
Which tokens may follow each other is a property of pairs: a row of tokens is the encoding of its bytes if
and only if each neighbouring pair is the encoding of its own bytes, which the merge ranks decide once per
pair. Transitions are kept, so a common word costs a few lookups, and whole pieces are kept above them.

The vocabulary file stays where it is; its path is a parameter. Executors that don't have it there get it from the driver.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from specloom.session import ship_file, shipped

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value. How the vocabulary's texts are cut into pieces before merging.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Entries kept before a store is emptied; bounds a worker's memory.
KEPT_PIECES, KEPT_STATES = 200_000, 300_000


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class Transducer:
    """Encodes pieces byte by byte. States are numbered as they are met."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.ranks = ranks
        self.prefixes = {t[:i] for t in ranks for i in range(1, len(t))}
        self.longest = max(map(len, ranks), default=1)
        self.pairs: dict[tuple[bytes, bytes], bool] = {}
        self.forget()

    def forget(self) -> None:
        """Back to the start state alone."""
        self.states: dict[tuple[bytes | None, bytes], int] = {}
        self.held: list[tuple[bytes | None, bytes]] = []
        self.moves: list[dict[int, tuple[int, tuple[int, ...]]]] = []
        self.ends: list[tuple[int, ...] | None] = []
        self.start = self.state(None, b"")

    def state(self, last: bytes | None, held: bytes) -> int:
        key = (last, held)
        if (n := self.states.get(key)) is None:
            n = self.states[key] = len(self.held)
            self.held.append(key)
            self.moves.append({})
            self.ends.append(None)
        return n

    def merged(self, data: bytes) -> list[bytes]:
        """The encoding by its definition: the pair of lowest rank is merged until none is left."""
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > 1:
            best, at = min(((self.ranks.get(parts[i] + parts[i + 1], 1 << 60), i) for i in range(len(parts) - 1)))
            if best == 1 << 60:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def fits(self, a: bytes, b: bytes) -> bool:
        """Whether token b may follow token a."""
        if (ok := self.pairs.get((a, b))) is None:
            if len(self.pairs) > KEPT_STATES:
                self.pairs.clear()
            ok = self.pairs[a, b] = self.merged(a + b) == [a, b]
        return ok

    def paths(self, last: bytes | None, held: bytes) -> list[tuple[bytes, ...] | None]:
        """For each end within held: the tokens that encode held up to there; they are unique, for encoding is a function."""
        ways: list[tuple[bytes, ...] | None] = [()]
        for end in range(1, len(held) + 1):
            found = None
            for start in range(max(0, end - self.longest), end):
                token = held[start:end]
                way = ways[start]
                if way is not None and token in self.ranks and (not way and last is None or self.fits(way[-1] if way else last, token)):  # type: ignore[arg-type]
                    found = (*way, token)
                    break
            ways.append(found)
        return ways

    def step(self, n: int, byte: int) -> tuple[int, tuple[int, ...]]:
        """The move from a state by a byte: the next state and the tokens that are settled by it."""
        last, held = self.held[n]
        if len(self.held) > KEPT_STATES:
            self.forget()
            n = self.state(last, held)
        held += bytes((byte,))
        ways = self.paths(last, held)
        alive = [w for end, w in enumerate(ways) if w is not None and (end == len(held) or held[end:] in self.prefixes)]
        shared = 0
        while all(len(w) > shared for w in alive) and len({w[shared] for w in alive}) == 1:
            shared += 1
        settled = alive[0][:shared]
        gone = sum(map(len, settled))
        move = (self.state(settled[-1] if settled else last, held[gone:]), tuple(self.ranks[t] for t in settled))
        self.moves[n][byte] = move
        return move

    def finish(self, n: int) -> tuple[int, ...]:
        """The tokens of what a state still holds."""
        if (out := self.ends[n]) is None:
            last, held = self.held[n]
            way = self.paths(last, held)[-1]
            if way is None:
                raise ValueError(f"bytes {held!r} can't be encoded by this vocabulary")
            out = self.ends[n] = tuple(self.ranks[t] for t in way)
        return out

    def encode(self, piece: bytes) -> list[int]:
        n, out = self.start, []
        for byte in piece:
            n, tokens = self.moves[n].get(byte) or self.step(n, byte)
            if tokens:
                out.extend(tokens)
        out.extend(self.finish(n))
        return out


class Encoder:
    """Texts to ids; special tokens' strings are ordinary text."""

    def __init__(self, path: str = VOCABULARY) -> None:
        self.ranks = read_ranks(path)
        self.transducer = Transducer(self.ranks)
        self.pattern = regex.compile(PATTERN)
        self.pieces: dict[str, list[int]] = {}

    def encode(self, text: str | None) -> list[int]:
        """The ids of a text; the empty list for null and ''. Lone surrogates count as the replacement sign."""
        if not text:
            return []
        out: list[int] = []
        pieces = self.pieces
        for piece in self.pattern.findall(text):
            ids = pieces.get(piece)
            if ids is None:
                ids = self.transducer.encode(piece.encode("utf-8", "replace"))
                if len(pieces) > KEPT_PIECES:
                    pieces.clear()
                if len(piece) <= 64:
                    pieces[piece] = ids
            out += ids
        return out


#: Continuation bytes due after a lead byte, and the range of the first of them.
def _lead(byte: int) -> tuple[int, int, int] | None:
    if byte < 0x80:
        return 0, 0, 0
    if 0xC2 <= byte <= 0xDF:
        return 1, 0x80, 0xBF
    if 0xE0 <= byte <= 0xEF:
        return 2, 0xA0 if byte == 0xE0 else 0x80, 0x9F if byte == 0xED else 0xBF
    if 0xF0 <= byte <= 0xF4:
        return 3, 0x90 if byte == 0xF0 else 0x80, 0x8F if byte == 0xF4 else 0xBF
    return None


class Decoder:
    """Ids to text, piece by piece: a character split over tokens is held until it is whole."""

    def __init__(self, tokens: dict[int, bytes]) -> None:
        self.tokens = tokens
        self.reset()

    def reset(self) -> None:
        self.pending, self.due, self.low, self.high = b"", 0, 0x80, 0xBF

    def push(self, token: int) -> str:
        """The text that a further token settles; U+FFFD for bytes that are no text."""
        out = []
        for byte in self.tokens[token]:
            if self.due:
                if self.low <= byte <= self.high:
                    self.pending += bytes((byte,))
                    self.due, self.low, self.high = self.due - 1, 0x80, 0xBF
                    if not self.due:
                        out.append(self.pending.decode("utf-8"))
                        self.pending = b""
                    continue
                out.append("�")
                self.reset()
            lead = _lead(byte)
            if lead is None:
                out.append("�")
            elif lead[0] == 0:
                out.append(chr(byte))
            else:
                self.pending = bytes((byte,))
                self.due, self.low, self.high = lead
        return "".join(out)

    def end(self) -> str:
        rest = "�" if self.pending else ""
        self.reset()
        return rest

    def decode(self, ids: list[int]) -> str:
        return "".join(map(self.push, ids)) + self.end()


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str = VOCABULARY) -> Encoder:
    """One encoder per worker and vocabulary; its states and pieces serve all tasks of the worker."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(shipped(path))
    return _ENCODERS[path]


def encode_texts(documents: DataFrame, key: str = "doc_id", text: str = "text", path: str = VOCABULARY) -> DataFrame:
    """key, ids: the ids of every row's whole text. A null or empty text has the empty list; repeated rows stay repeated.

    A map without shuffle: only key and text are read. Very long texts are encoded whole, as one row.
    """

    ship_file(documents.sparkSession, path)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for b in batches:
            ids = pa.array([enc.encode(t) for t in b.column(1).to_pylist()], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([b.column(0), ids], names=[key, "ids"])

    return documents.select(key, text).mapInArrow(encode, f"{key} {dict(documents.dtypes)[key]}, ids array<int>")


def decode_ids(encoded: DataFrame, key: str = "doc_id", ids: str = "ids", path: str = VOCABULARY) -> DataFrame:
    """key, text: the texts of rows of ids; the empty text for an empty or null list."""

    ship_file(encoded.sparkSession, path)

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = Decoder({i: t for t, i in encoder(path).ranks.items()})
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([decoder.decode(x or []) for x in b.column(1).to_pylist()], pa.string())], names=[key, "text"])

    return encoded.select(key, ids).mapInArrow(decode, f"{key} {dict(encoded.dtypes)[key]}, text string")
