"""Byte-level BPE by a lazily determinised transducer; streaming decoding by a UTF-8 state machine.

A merge never crosses a boundary of the final tokens, so a sequence of tokens is the encoding of its
bytes exactly if each adjacent pair encodes to itself. That makes encoding a walk over bytes:

1. ``Transducer`` compiles the ranks into a trie of token bytes. After a prefix of the input, a state
   holds every way on: the tokens of a shorter prefix that are not emitted yet, and how far the bytes
   since then stand within a next token. A byte moves all of them; a token that ends there opens a new
   way if it may follow the last token. Tokens that all ways share are emitted at once, so output
   lags by the few bytes in which the ways still differ. Sets of ways become states the first time
   they are met, and their transitions are kept in one table of bounded size.
2. ``Splitter`` cuts a text by the pattern of the rank file. Classes of characters that Python's tables
   do not know yet are fixed values below.
3. ``encode`` cuts whole texts in workers, sends each new piece through the transducer and keeps lately
   seen pieces with their ids. Every document's ids are decoded again, piece of output by piece, by
   ``Utf8Stream``, which holds back the bytes of a character until it is complete.

Defined cases: a null text is empty and gives no ids and the digests of nothing; repeated rows and
repeated or null ids give a row each; an empty table gives no rows; further columns are ignored, so
their names cannot clash. Pieces of any length are encoded whole, in time linear in their length.
Special tokens inside texts are ordinary text.
"""

from __future__ import annotations

import base64
import hashlib
import unicodedata
from array import array

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession, functions as F

from .registry import query
from .support import table, worker_cache
from .words import slices

#: Transitions and states kept; beyond it the tables start anew. A size for memory only.
MOST_STATES = 300_000
#: Pieces a worker keeps with their ids in each of two generations, and the longest piece kept.
STORE_PIECES, STORE_BYTES = 250_000, 64
#: Ids decoded at a time.
DECODE_IDS = 1 << 16

# Letters and digits of Unicode 16.0 that Python's tables (15.1) do not list, first to last.
NEW_LETTERS = (
    (0x1C89, 0x1C8A), (0xA7CB, 0xA7CD), (0xA7DA, 0xA7DC), (0x105C0, 0x105F3), (0x10D4A, 0x10D65), (0x10D6F, 0x10D85),
    (0x10EC2, 0x10EC4), (0x11380, 0x11389), (0x1138B, 0x1138B), (0x1138E, 0x1138E), (0x11390, 0x113B5), (0x113B7, 0x113B7),
    (0x113D1, 0x113D1), (0x113D3, 0x113D3), (0x11BC0, 0x11BE0), (0x13460, 0x143FA), (0x16100, 0x1611D), (0x16D40, 0x16D6C),
    (0x18CFF, 0x18CFF), (0x1E5D0, 0x1E5ED), (0x1E5F0, 0x1E5F0),
)
NEW_DIGITS = (
    (0x10D40, 0x10D49), (0x116D0, 0x116E3), (0x11BF0, 0x11BF9), (0x16130, 0x16139), (0x16D70, 0x16D79), (0x1CCF0, 0x1CCF9),
    (0x1E5F1, 0x1E5FA),
)
#: The white space of Unicode.
WHITE = ((0x9, 0xD), (0x20, 0x20), (0x85, 0x85), (0xA0, 0xA0), (0x1680, 0x1680), (0x2000, 0x200A), (0x2028, 0x2029),
         (0x202F, 0x202F), (0x205F, 0x205F), (0x3000, 0x3000))


def _ranges(kind: str) -> list[tuple[int, int]]:
    """Ranges of all code points whose category starts with a letter."""
    found, begin = [], None
    for code in range(0x110001):
        inside = code < 0x110000 and unicodedata.category(chr(code))[0] == kind
        if inside and begin is None:
            begin = code
        elif not inside and begin is not None:
            found.append((begin, code - 1))
            begin = None
    return found


class Splitter:
    """Cuts texts by a pattern with ``\\p{L}``, ``\\p{N}`` and ``\\s``.

    The fast engine and Python's tables differ only in characters unassigned in the latter, so a text
    that holds one of those is cut with the classes written out.
    """

    def __init__(self, pattern: str):
        import regex

        self.pattern, self.fast, self.exact, self.known = pattern, regex.compile(pattern).findall, None, set()

    def written_out(self):
        import re

        if self.exact is None:
            text = {
                name: "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in ranges)
                for name, ranges in (("L", [*_ranges("L"), *NEW_LETTERS]), ("N", [*_ranges("N"), *NEW_DIGITS]), ("S", WHITE))
            }
            out, depth, at = [], 0, 0
            while at < len(self.pattern):
                piece = self.pattern[at : at + (5 if self.pattern.startswith("\\p", at) else 2 if self.pattern[at] == "\\" else 1)]
                at += len(piece)
                depth += (piece == "[") - (piece == "]")
                chars = {"\\p{L}": text["L"], "\\p{N}": text["N"], "\\s": text["S"]}.get(piece)
                if piece == "\\S":
                    out.append("[^" + text["S"] + "]")
                else:
                    out.append(piece if chars is None else chars if depth else f"[{chars}]")
            self.exact = re.compile("".join(out)).findall
        return self.exact

    def __call__(self, text: str) -> list[str]:
        if not text.isascii():
            new = set(text) - self.known
            if new:
                if any(unicodedata.category(c) == "Cn" for c in new):
                    return self.written_out()(text)
                self.known |= new
        return self.fast(text)


class Transducer:
    """Bytes to ids for ranks that hold all 256 single bytes; ``encode`` walks one piece."""

    def __init__(self, ranks: dict[bytes, int], most_states: int = MOST_STATES):
        if any(bytes([b]) not in ranks for b in range(256)):
            raise ValueError("the ranks must hold every single byte")
        self.ranks, self.most, self.none = ranks, most_states, 1 + max(ranks.values())
        self.raw = {i: t for t, i in ranks.items()}
        self.child, self.ends, self.inner = {}, [-1], [False]
        self.follows: dict[int, bool] = {}
        self.built: dict[int, list] = {}
        for token, rank in ranks.items():
            node = 0
            for byte in token:
                there = self.child.get(node << 8 | byte)
                if there is None:
                    there = self.child[node << 8 | byte] = len(self.ends)
                    self.ends.append(-1), self.inner.append(False)
                    self.inner[node] = True
                node = there
            parts, steps = self.history(token)
            if len(parts) == 1:  # a token that its own bytes do not merge to never occurs within a longer piece
                self.ends[node], self.built[rank] = rank, steps
        self.moves: dict[int, tuple[int, tuple]] = {}
        self.states: list[tuple] = []
        self.number: dict[tuple, int] = {}
        self.start()

    def history(self, data: bytes) -> tuple[list[bytes], list[tuple[int, bytes, bytes]]]:
        """Plain merging, always the lowest rank, the leftmost of equals: the parts left, and after each merge
        its rank, the first and the last part."""
        ranks, parts, steps = self.ranks, [data[i : i + 1] for i in range(len(data))], []
        none = self.none
        pairs = [ranks.get(a + b, none) for a, b in zip(parts, parts[1:])]
        while pairs:
            best = min(pairs)
            if best == none:
                break
            i = pairs.index(best)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del pairs[i]
            if i:
                pairs[i - 1] = ranks.get(parts[i - 1] + parts[i], none)
            if i < len(pairs):
                pairs[i] = ranks.get(parts[i] + parts[i + 1], none)
            steps.append((best, parts[0], parts[-1]))
        return parts, steps

    def may_follow(self, left: int, right: int) -> bool:
        """Whether no merge crosses from one token into the next while each is built from its bytes."""
        known = self.follows.get(left << 32 | right)
        if known is None:
            if len(self.follows) > 4 * self.most:
                self.follows.clear()
            known = self.follows[left << 32 | right] = self._stay_apart(left, right)
        return known

    def _stay_apart(self, left: int, right: int) -> bool:
        ranks, a, b = self.ranks, self.built[left], self.built[right]
        end, begin = self.raw[left][-1:], self.raw[right][:1]
        i = j = 0
        across = ranks.get(end + begin)
        while True:
            next_left = a[i][0] if i < len(a) else None
            next_right = b[j][0] if j < len(b) else None
            if next_left is None and next_right is None:
                return across is None
            # of equal ranks the leftmost merges first: inside the left token, across, inside the right one
            if next_left is not None and (next_right is None or next_left <= next_right):
                if across is not None and across < next_left:
                    return False
                if a[i][2] != end:
                    end = a[i][2]
                    across = ranks.get(end + begin)
                i += 1
            else:
                if across is not None and across <= next_right:
                    return False
                if b[j][1] != begin:
                    begin = b[j][1]
                    across = ranks.get(end + begin)
                j += 1

    def start(self) -> None:
        """Empty tables with the start state, number 0: nothing read, nothing emitted."""
        self.moves.clear(), self.states.clear(), self.number.clear()
        self.state((-1, (((), 0),)))

    def state(self, content: tuple) -> int:
        found = self.number.get(content)
        if found is None:
            found = self.number[content] = len(self.states)
            self.states.append(content)
        return found

    def move(self, state: int, byte: int) -> tuple[int, tuple]:
        """The state after one more byte and the tokens emitted on the way; determinised when first asked for."""
        last, ways = self.states[state]
        child, ends, inner, on, whole = self.child, self.ends, self.inner, [], None
        for pending, node in ways:
            node = child.get(node << 8 | byte)
            if node is None:
                continue
            if inner[node]:
                on.append((pending, node))
            token = ends[node]
            if token >= 0 and whole is None:
                before = pending[-1] if pending else last
                if before < 0 or self.may_follow(before, token):
                    whole = (*pending, token)
        on.append((whole, 0))  # exactly one way ends here, as every prefix has one encoding
        emitted = on[0][0]
        for other, _ in on:
            while emitted != other[: len(emitted)]:
                emitted = emitted[:-1]
        if emitted:
            on = [(pending[len(emitted) :], node) for pending, node in on]
            last = emitted[-1]
        if all([pending for pending, _ in on]):
            last = -2  # no way asks for it any more
        if len(self.states) >= self.most:
            self.start()
            return self.state((last, tuple(on))), emitted
        out = self.moves[state << 8 | byte] = (self.state((last, tuple(on))), emitted)
        return out

    def finish(self, state: int) -> tuple:
        """The tokens still held back when the input ends."""
        return self.states[state][1][-1][0]

    def encode(self, piece: bytes) -> list[int]:
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        out, state, known, move = [], 0, self.moves.get, self.move
        for byte in piece:
            found = known(state << 8 | byte)
            state, emitted = found if found is not None else move(state, byte)
            if emitted:
                out += emitted
        out += self.finish(state)
        return out


class Utf8Stream:
    """Bytes in parts of any size to text: characters come out when they are complete.

    The machine counts the bytes a character still needs and the range of the next one; ill-formed
    bytes become U+FFFD, one for each longest part that could have begun a character.
    """

    # Fixed values of well-formed UTF-8: first bytes, number of further bytes, range of the second byte.
    STARTS = (
        (0xC2, 0xDF, 1, 0x80, 0xBF), (0xE0, 0xE0, 2, 0xA0, 0xBF), (0xE1, 0xEC, 2, 0x80, 0xBF), (0xED, 0xED, 2, 0x80, 0x9F),
        (0xEE, 0xEF, 2, 0x80, 0xBF), (0xF0, 0xF0, 3, 0x90, 0xBF), (0xF1, 0xF3, 3, 0x80, 0xBF), (0xF4, 0xF4, 3, 0x80, 0x8F),
    )
    OPENING = {b: (need, low, high) for first, last, need, low, high in STARTS for b in range(first, last + 1)}

    def __init__(self):
        self.held, self.need, self.low, self.high = bytearray(), 0, 0x80, 0xBF

    def step(self, byte: int) -> str:
        out = ""
        if self.need:
            if self.low <= byte <= self.high:
                self.held.append(byte)
                self.need, self.low, self.high = self.need - 1, 0x80, 0xBF
                if self.need:
                    return out
                out, self.held = self.held.decode(), bytearray()
                return out
            out, self.held, self.need = "�", bytearray(), 0
        if byte < 0x80:
            return out + chr(byte)
        opened = self.OPENING.get(byte)
        if opened is None:
            return out + "�"
        self.need, self.low, self.high = opened
        self.held.append(byte)
        return out

    def feed(self, data: bytes) -> str:
        """Text of all characters completed by these bytes. Only the ends of a well-formed part need the machine."""
        begin, parts = 0, []
        while self.need and begin < len(data):
            parts.append(self.step(data[begin]))
            begin += 1
        end = len(data)
        while end > begin and end > len(data) - 4 and 0x80 <= data[end - 1] < 0xC0:
            end -= 1
        if end > begin and data[end - 1] >= 0xC0:
            end -= 1
        else:
            end = len(data)
        try:
            parts.append(data[begin:end].decode())
        except UnicodeDecodeError:
            end = begin
        parts.extend(map(self.step, data[end:]))
        return "".join(parts)

    def close(self) -> str:
        out = "�" if self.need else ""
        self.held, self.need = bytearray(), 0
        return out


def read_ranks(lines) -> dict[bytes, int]:
    """Ranks of a file of lines ``base64 rank``."""
    return {base64.b64decode(a): int(b) for a, b in (x.split() for x in lines if x.strip())}


class Pieces:
    """A worker's transducer, splitter and lately seen pieces with their packed ids."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.split, self.machine = Splitter(pattern), Transducer(ranks)
        self.now: dict[str, bytes] = {}
        self.before: dict[str, bytes] = {}
        top = max(ranks.values()) + 1
        self.raw = [self.machine.raw.get(i, b"") for i in range(top)]

    def ids(self, texts: list[str]) -> list[bytes]:
        """Packed ids of each text."""
        cut = [self.split(t) for t in texts]
        wanted = set().union(*cut)
        if len(self.now) > STORE_PIECES:
            self.now, self.before = {}, self.now
        now, before, encode, long_ones = self.now, self.before, self.machine.encode, []
        for piece in wanted.difference(now):
            packed = before.get(piece)
            if packed is None:
                raw = piece.encode()
                packed = array("I", encode(raw)).tobytes()
                if len(raw) > STORE_BYTES:
                    long_ones.append(piece)
            now[piece] = packed
        out = [b"".join(map(now.__getitem__, pieces)) for pieces in cut]
        for piece in long_ones:
            del now[piece]
        return out

    def text(self, ids: memoryview):
        """Decoded text, part by part."""
        stream, raw = Utf8Stream(), self.raw
        for at in range(0, len(ids), DECODE_IDS):
            yield stream.feed(b"".join(map(raw.__getitem__, ids[at : at + DECODE_IDS])))
        yield stream.close()


def _pieces(name: str, pattern: str) -> Pieces:
    def make():
        with open(SparkFiles.get(name), "rb") as f:
            return Pieces(read_ranks(f), pattern)

    return worker_cache("byte pieces", (name, pattern), make)


def _ship(spark: SparkSession, path: str) -> str:
    spark.sparkContext.addFile(path)
    return path.rstrip("/").rpartition("/")[2]


ENCODED = "doc_id long, n_tokens long, ids array<int>, ids_sha256 string, decoded_sha256 string"


def encode(docs: DataFrame, ranks_path: str, pattern: str, keep_ids: bool = True) -> DataFrame:
    """Ids of every text, their digest, and the digest of the bytes decoded from them."""
    name = _ship(docs.sparkSession, ranks_path)

    def batches(source):
        pieces = _pieces(name, pattern)
        for whole in source:
            for part in slices(whole, "text"):
                packed = pieces.ids([t or "" for t in part.column("text").to_pylist()])
                digests = []
                for ids in packed:
                    digest = hashlib.sha256()
                    for text in pieces.text(memoryview(ids).cast("I")):
                        digest.update(text.encode())
                    digests.append(digest.hexdigest())
                yield pa.record_batch([
                    part.column("doc_id"), pa.array([len(x) // 4 for x in packed], pa.int64()),
                    pa.array([np.frombuffer(x, np.int32) if keep_ids else None for x in packed], pa.list_(pa.int32())),
                    pa.array([hashlib.sha256(x).hexdigest() for x in packed], pa.string()), pa.array(digests, pa.string()),
                ], names=["doc_id", "n_tokens", "ids", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(batches, ENCODED)


def decode(encoded: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """The text of the ids in column ``ids``, beside ``doc_id``; null ids give an empty text, unknown ids nothing."""
    name = _ship(encoded.sparkSession, ranks_path)

    def batches(source):
        pieces = _pieces(name, pattern)
        top = len(pieces.raw)
        for part in source:
            lists = ([i for i in x or [] if i is not None and 0 <= i < top] for x in part.column("ids").to_pylist())
            texts = ["".join(pieces.text(memoryview(np.array(x, np.uint32)))) for x in lists]
            yield pa.record_batch([part.column("doc_id"), pa.array(texts, pa.string())], names=["doc_id", "decoded"])

    return encoded.select(F.col("doc_id").cast("long"), "ids").mapInArrow(batches, "doc_id long, decoded string")


@query("op12_byte_transducer")
def op12_byte_transducer(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return encode(table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN, keep_ids=False).drop("ids")
