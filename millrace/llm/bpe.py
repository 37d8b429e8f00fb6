"""Byte-level BPE by a lazily determinised finite-state transducer.

A sequence of tokens is the BPE encoding of its bytes exactly if every two neighbours are what
BPE makes of their joined bytes. So each prefix of a piece has one encoding, and a nondeterministic
transducer that guesses where tokens end holds, for each possible start of the token in progress,
the last token before it and a node of the vocabulary's trie. Determinising by subsets, on demand,
gives states that are sets of such guesses; transitions are kept once computed. Every ``HELD``
bytes the tokens on which all guesses agree are emitted, and with a piece's end the rest. Guesses
start within one token's length of the byte read, so the lookahead is bounded. Pieces of any length
take this one path.

Decoding is an incremental UTF-8 state machine over bytes, determinised on demand over tokens: a
transition gives the text that a token completes and the bytes still awaited, so text is released
while ids still arrive, even where a character's bytes lie in different tokens.

Defined cases: null and empty texts have no ids; malformed bytes decode to U+FFFD; repeated rows
are treated alike; columns besides id and text are not read.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.common import arrow_map, read
from millrace.llm.words import KEPT_BYTES, Kept, joined, parts_of, slices


def load_ranks(path: str) -> dict[bytes, int]:
    """Token bytes and ids from a rank file (a base64 token and an id on each line)."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines) if token}


class Transducer:
    """Bytes of one pre-token in, token ids out."""

    #: Bytes after which settled tokens are emitted.
    HELD = 64

    def __init__(self, ranks: dict[bytes, int], max_states: int = 500_000, max_pairs: int = 500_000):
        self.ranks = ranks
        self.longest = max(map(len, ranks), default=0)
        self.bytes_of = {i: t for t, i in ranks.items()}
        self.size_of = {i: len(t) for t, i in ranks.items()}
        self.max_states, self.max_pairs = max_states, max_pairs
        self.child: dict[int, int] = {}
        token_at, inner = [-1], [True]
        for token, rank in ranks.items():
            node = 0
            for b in token:
                key = node << 8 | b
                after = self.child.get(key)
                if after is None:
                    after = self.child[key] = len(token_at)
                    token_at.append(-1)
                    inner.append(False)
                inner[node] = True
                node = after
            token_at[node] = rank
        self.token_at, self.inner = token_at, inner
        self.nodes = len(token_at)  # a guess is last token * nodes + node
        self.fits: dict[int, bool] = {}
        self.halves: dict[int, tuple[int, int] | None] = {}
        self.reset()

    def reset(self) -> None:
        """Forget all states; only between pre-tokens."""
        start = (-self.nodes,)
        self.states, self.last, self.number = [start], [-1], {start: 0}
        self.delta: dict[int, int] = {}
        self.piece, self.path = b"", []

    def merged(self, data: bytes, parts_left: int = 1) -> list[bytes]:
        """BPE by the definition: join the neighbours of least rank, leftmost first."""
        ranks = self.ranks
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > parts_left:
            best, at = None, -1
            for i in range(len(parts) - 1):
                rank = ranks.get(parts[i] + parts[i + 1])
                if rank is not None and (best is None or rank < best):
                    best, at = rank, i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def split(self, token: int) -> tuple[int, int] | None:
        """The two tokens that BPE joins last to make this one; None for a single byte."""
        if token not in self.halves:
            parts = self.merged(self.bytes_of[token], 2)
            self.halves[token] = (self.ranks[parts[0]], self.ranks[parts[1]]) if len(parts) == 2 else None
        return self.halves[token]

    def stays(self, left: int, right: int) -> bool:
        """Whether no join across the border of two tokens comes before a join within them. Joins
        are undone from the last to the first; at each step the pair that then meets at the border
        must not join earlier than what was undone."""
        limit = 1 << 62
        while True:
            rank = self.ranks.get(self.bytes_of[left] + self.bytes_of[right])
            if rank is not None and rank < limit:
                return False
            # The younger of the two joins is undone; on equal ranks the right one, which is made
            # after the left one.
            a, b = self.split(left), self.split(right)
            if a is None and b is None:
                return True
            if b is None or a is not None and left > right:
                limit, left = left, a[1]
            else:
                limit, right = right + 1, b[0]

    def follows(self, left: int, right: int) -> bool:
        """Whether BPE keeps the two tokens as they are (left is -1 at the start)."""
        key = (left + 1) << 32 | right
        known = self.fits.get(key)
        if known is None:
            if len(self.fits) >= self.max_pairs:
                self.fits.clear()
            known = self.merged(self.bytes_of[right]) == [self.bytes_of[right]] if left < 0 else self.stays(left, right)
            self.fits[key] = known
        return known

    def move(self, state: int, byte: int) -> int:
        """Compute, keep and return a transition."""
        child, inner, token_at = self.child, self.inner, self.token_at
        alive, ended, nodes = [], -1, self.nodes
        for guess in self.states[state]:  # the oldest start first
            last, node = divmod(guess, nodes)
            after = child.get(node << 8 | byte)
            if after is None:
                continue
            if inner[after]:
                alive.append(last * nodes + after)
            token = token_at[after]
            if ended < 0 and token >= 0 and self.follows(last, token):
                ended = token
        alive.append(ended * nodes)
        guesses = tuple(alive)
        found = self.number.get(guesses)
        if found is None:
            found = self.number[guesses] = len(self.states)
            self.states.append(guesses)
            self.last.append(ended)
        self.delta[state << 8 | byte] = found
        return found

    def encode(self, piece: bytes) -> list[int]:
        """Ids of one pre-token. As in the public library, a piece that is an entry is that id."""
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        if len(self.states) > self.max_states:
            self.reset()
        # Words often come in order: go on from what they share with the piece before.
        before = self.piece
        for shared in (10, 8, 6, 4, 2, 0):
            if piece[:shared] == before[:shared] and len(piece) >= shared <= len(before):
                break
        path = self.path[:shared]
        out, begun = [], 0
        # Every HELD bytes, tokens on which all guesses agree leave; the last ones with the end.
        for at in range(shared, len(piece), self.HELD):
            if at - begun >= self.HELD:
                path = self.settle(path, out)
                begun = at - len(path)
                if begun and len(self.states) > self.max_states:
                    # All guesses go through the last border: go on from there in a fresh table.
                    self.reset()
                    path = self.walk([], piece[begun:at], self.after(out[-1]))
            path = self.walk(path, piece[at : at + self.HELD])
        self.piece, self.path = (piece, path) if not begun else (b"", [])
        self.read(path, len(path), out)
        return out

    def after(self, token: int) -> int:
        """The state in which this token has ended and nothing else can be."""
        guesses = (token * self.nodes,)
        found = self.number.get(guesses)
        if found is None:
            found = self.number[guesses] = len(self.states)
            self.states.append(guesses)
            self.last.append(token)
        return found

    def walk(self, path: list[int], data: bytes, state: int = 0) -> list[int]:
        """``path`` (states after each byte read and not settled) with further bytes."""
        state, get = path[-1] if path else state, self.delta.get
        for byte in data:
            after = get(state << 8 | byte)
            state = self.move(state, byte) if after is None else after
            path.append(state)
        return path

    def read(self, path: list[int], end: int, out: list[int]) -> None:
        """Append the encoding of the bytes of ``path`` up to ``end``, read backwards."""
        first, at, last, size_of = len(out), end, self.last, self.size_of
        while at > 0:
            token = last[path[at - 1]]
            out.append(token)
            at -= size_of[token]
        out[first:] = out[:first - 1 if first else None : -1]

    def settle(self, path: list[int], out: list[int]) -> list[int]:
        """Emit the tokens on which all guesses agree; what is left of ``path``."""
        state, agreed = path[-1], None
        for guess in self.states[state]:
            at = len(path) - self.depth(guess % self.nodes)
            borders = {at}
            while at > 0:
                at -= self.size_of[self.last[path[at - 1]]]
                borders.add(at)
            agreed = borders if agreed is None else agreed & borders
        settled = max(agreed)
        self.read(path, settled, out)
        return path[settled:]

    def stream(self, blocks: Iterable[bytes]) -> Iterator[int]:
        """As ``encode`` of the joined blocks, with ids leaving as soon as they are settled. What is
        held back at the start is no longer than the longest entry, which may be the whole piece."""
        head, path, state, begun = b"", [], 0, False
        for block in blocks:
            if not begun:
                head += block
                if len(head) <= self.longest:
                    continue
                block, begun = head, True
            for at in range(0, len(block), self.HELD):
                path = self.walk(path, block[at : at + self.HELD], state)
                out: list[int] = []
                path = self.settle(path, out)
                state = self.after(out[-1]) if out else state
                yield from out
        out = []
        if begun:
            self.read(path, len(path), out)
        elif head:
            out = self.encode(head)
        yield from out

    def depth(self, node: int) -> int:
        """Bytes from the trie's root to a node."""
        if not hasattr(self, "depths"):
            self.depths = [0] * len(self.token_at)
            for key, after in self.child.items():  # parents come before their children
                self.depths[after] = self.depths[key >> 8] + 1
        return self.depths[node]


#: The state of the UTF-8 machine between characters: bytes still needed, bounds of the next
#: byte, and the value so far.
READY = (0, 0x80, 0xBF, 0)
LOST = "\ufffd"


def utf8_step(state: tuple[int, int, int, int], b: int) -> tuple[str, tuple[int, int, int, int]]:
    """One byte: the text that it completes and the state after it. Ill-formed parts become
    U+FFFD, one for each maximal part."""
    need, low, high, value = state
    if need and low <= b <= high:
        value = value << 6 | b & 0x3F
        return (chr(value), READY) if need == 1 else ("", (need - 1, 0x80, 0xBF, value))
    lost = LOST if need else ""  # the started character ends here
    if b < 0x80:
        return lost + chr(b), READY
    if 0xC2 <= b <= 0xDF:
        return lost, (1, 0x80, 0xBF, b & 0x1F)
    if 0xE0 <= b <= 0xEF:
        return lost, (2, 0xA0 if b == 0xE0 else 0x80, 0x9F if b == 0xED else 0xBF, b & 0x0F)
    if 0xF0 <= b <= 0xF4:
        return lost, (3, 0x90 if b == 0xF0 else 0x80, 0x8F if b == 0xF4 else 0xBF, b & 0x07)
    return lost + LOST, READY


class Utf8Stream:
    """Incremental UTF-8 decoding; state is what a started character still needs."""

    def __init__(self, state: tuple[int, int, int, int] = READY):
        self.state = state

    def feed(self, data: bytes) -> str:
        """Text completed by ``data``."""
        out, state = [], self.state
        for b in data:
            text, state = utf8_step(state, b)
            if text:
                out.append(text)
        self.state = state
        return "".join(out)

    def close(self) -> str:
        """What an unfinished character at the end becomes."""
        unfinished, self.state = self.state[0], READY
        return LOST if unfinished else ""


class TokenDecoder:
    """The UTF-8 machine over tokens; transitions are computed on demand and kept (bounded)."""

    def __init__(self, bytes_of: dict[int, bytes], most: int = 200_000):
        self.bytes_of, self.most = bytes_of, most
        self.states, self.number = [READY], {READY: 0}
        self.width = max(bytes_of, default=0) + 1
        self.delta: dict[int, tuple[str, int]] = {}

    def move(self, state: int, token: int) -> tuple[str, int]:
        found = self.delta.get(state * self.width + token)
        if found is None:
            machine = Utf8Stream(self.states[state])
            text = machine.feed(self.bytes_of[token])
            after = self.number.get(machine.state)
            if after is None:
                after = self.number[machine.state] = len(self.states)
                self.states.append(machine.state)
            if len(self.delta) >= self.most:
                self.delta.clear()
            found = self.delta[state * self.width + token] = (text, after)
        return found

    def stream(self, ids: Iterable[int]) -> Iterator[str]:
        """Text, released as soon as its bytes are complete."""
        state = 0
        for i in ids:
            text, state = self.move(state, i)
            if text:
                yield text
        if state:
            yield LOST


def added(a: tuple, b: tuple) -> tuple[bytes, int, bytes]:
    return a[0] + b[0], a[1] + b[1], a[2] + b[2]


class Codec:
    """Texts to ids and back, with results of space-led words kept (bounded)."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import regex

        self.transducer = Transducer(ranks)
        self.pieces = regex.compile(pattern).findall
        self.decoder = TokenDecoder(self.transducer.bytes_of)
        self.csv_of = {i: b"%d," % i for i in self.transducer.bytes_of}
        self.words = Kept(self.word, 3 * KEPT_BYTES, lambda x: 160 + len(x[0]) + len(x[2]))

    def encode(self, text: str) -> list[int]:
        out: list[int] = []
        for piece in self.pieces(text):
            out += self.transducer.encode(piece.encode("utf-8", "surrogatepass"))
        return out

    def decode_stream(self, ids: Iterable[int]) -> Iterable[str]:
        """Text, released as soon as its bytes are complete."""
        return self.decoder.stream(ids)

    def decode(self, ids: Iterable[int]) -> str:
        return "".join(self.decoder.stream(ids))

    def described(self, ids: list[int]) -> tuple[bytes, int, bytes]:
        """Decimal ids with a comma after each, their number, and the bytes they decode to."""
        delta, width, state, out = self.decoder.delta, self.decoder.width, 0, []
        for i in ids:
            text, state = delta.get(state * width + i) or self.decoder.move(state, i)
            out.append(text)
        if state:
            out.append(LOST)
        return b"".join(map(self.csv_of.__getitem__, ids)), len(ids), "".join(out).encode()

    def both(self, text: str) -> tuple[bytes, int, bytes]:
        """``described`` ids of a text."""
        return self.described(self.encode(text))

    def word(self, part: str) -> tuple[bytes, int, bytes]:
        """A part led by its space. Letters are one piece, a final mark another, and so is a line
        end between letters."""
        if part.isalpha():
            return self.described(self.transducer.encode(b" " + part.encode()))
        if part[-1] in ".," and part[:-1].isalpha():
            return added(self.words[part[:-1]], self.both(part[-1]))
        left, line, right = part.partition("\n")
        if line and left[:-1].isalpha() and right.isalpha():
            return added(added(self.words[left], self.both(line)), self.described(self.transducer.encode(right.encode())))
        return self.both(" " + part)

    def documents(self, texts: pa.Array) -> Iterator[tuple[memoryview, int, memoryview]]:
        """As ``both``, for a column of whole texts."""
        for start, n in slices(texts):
            results, number, starts = parts_of(texts.slice(start, n), self.words, self.both)
            (csv, a), (data, b) = (joined([r and r[k] for r in results], number, starts) for k in (0, 2))
            counts = np.concatenate([[0], np.cumsum(np.array([r[1] if r else 0 for r in results])[number])])[starts]
            for i in range(n):
                yield csv[a[i] : a[i + 1]], int(counts[i + 1] - counts[i]), data[b[i] : b[i + 1]]

    def document(self, text: str | None) -> tuple[bytes, int, bytes]:
        csv, n, data = next(self.documents(pa.array([text], pa.string())))
        return bytes(csv), n, bytes(data)


@lru_cache(1)
def shared_codec(path: str, pattern: str) -> Codec:
    """One codec a process, whatever the number of its tasks."""
    return Codec(load_ranks(path), pattern)


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def default_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def encode_documents(docs: DataFrame, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """doc_id, ids (array of int) and decoded (the text that the ids decode to), for every row.

    ``path`` is a rank file that each executor can open (installed with the tokenizers)."""

    def setup():
        codec = shared_codec(path or default_path(), pattern or default_pattern())

        def kernel(ids, texts):
            found = [codec.encode(t) if t else [] for t in texts]
            return ids, found, [codec.decode(x) for x in found]

        return kernel

    return arrow_map(docs, [F.col("doc_id").cast("bigint").alias("doc_id"), "text"], "doc_id long, ids array<int>, decoded string", setup)


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Number and digest of the ids of every document, and the digest of what they decode to."""

    def setup():
        codec = shared_codec(default_path(), default_pattern())

        def kernel(ids, texts):
            out: tuple[list, ...] = ([], [], [])
            for csv, n, data in codec.documents(texts):
                for column, value in zip(out, (n, hashlib.sha256(csv[:-1]).hexdigest(), hashlib.sha256(data).hexdigest())):
                    column.append(value)
            return [ids, *out]

        return kernel

    docs = read(spark, sf_dir, "documents")
    return arrow_map(docs, [F.col("doc_id").cast("bigint").alias("doc_id"), "text"], "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string", setup, arrow_in=True)
