"""Byte-level BPE encoding and decoding by prefix dynamic programming.

For each prefix of a piece's bytes there is exactly one token that its encoding can end in: the token t for
which the encoding of the prefix before t, followed by t, is still what the merges would give. It is enough to
look at the last token before t, because a pair of neighbours is possible only if merging their joint bytes
gives the two back. The table of last tokens is therefore filled left to right, an append only adds entries,
and an edit keeps the entries before it.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F

from .common import slices, text_of

RESULT = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
#: Words, pieces and pairs that a worker remembers at most. Bounds its memory, never changes a result.
REMEMBERED, REMEMBERED_PIECES = 500_000, 250_000


def parse_ranks(content: bytes) -> dict[bytes, int]:
    """Token bytes to ids, from lines of base64 token and rank."""
    return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in content.splitlines() if line)}


class PrefixCoder:
    """Encodes and decodes pieces of bytes by a table of ranks."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.tokens = {i: token for token, i in ranks.items()}
        self.longest = max(map(len, ranks), default=0)
        self.lengths = {i: len(token) for token, i in ranks.items()}
        self.matches = ahocorasick.Automaton()
        for token, i in ranks.items():
            self.matches.add_word(token.decode("latin-1"), i)
        self.matches.make_automaton()
        self.shift = max(self.tokens, default=0) + 1
        self.possible: dict[int, bool] = {}
        self.split: dict[int, tuple[int, int] | None] = {}

    def merged(self, data: bytes, stop: int = 1) -> list[int]:
        """Encoding by the definition: the pair of lowest rank, leftmost first, is merged until `stop` are left."""
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > stop:
            ranked = [self.ranks.get(a + b) for a, b in zip(parts, parts[1:])]
            found = [r for r in ranked if r is not None]
            if not found:
                break
            at = ranked.index(min(found))
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [self.ranks[p] for p in parts]

    def halves(self, token: int) -> tuple[int, int] | None:
        """The two tokens whose merge gives this one; None for a byte, and for a token that merges do not give."""
        if token not in self.split:
            data, parts = self.tokens[token], []
            if len(data) > 1:
                parts = self.merged(data, stop=2)
            self.split[token] = tuple(parts) if len(parts) == 2 and self.merged(data) == [token] else None
        return self.split[token]

    def fits(self, left: int, right: int) -> bool:
        """Whether the merges leave these two tokens as they are when they stand side by side.

        Goes back in time from the finished tokens: the younger of the two at the seam is taken apart, and at
        each moment a merge over the seam must not come before the merges that really follow.
        """
        join, tokens, never = self.ranks.get, self.tokens, len(self.ranks) + 1
        next_left = next_right = never
        while True:
            over = join(tokens[left] + tokens[right])
            if over is not None and over < next_left and over <= next_right:
                return False
            parts_l, parts_r = self.halves(left), self.halves(right)
            if parts_l is None and parts_r is None:
                return True
            if parts_r is None or (parts_l is not None and left > right):
                next_left, left = left, parts_l[1]
            else:
                next_right, right = right, parts_r[0]

    def extend(self, data: bytes, last: list[int], upto: int) -> None:
        """Fills last[upto:], where last[i] is the last token of data[:i]."""
        del last[upto:]
        possible, shift, lengths = self.possible, self.shift, self.lengths
        skip = max(0, upto - self.longest)
        last += [-1] * (len(data) + 1 - upto)
        # Every token that ends at a position, position by position, from one run over the bytes.
        for end, token in self.matches.iter(data[skip:].decode("latin-1")):
            end += skip + 1
            if end < upto or last[end] >= 0 or (start := end - lengths[token]) < skip:
                continue
            pair = (last[start] + 1) * shift + token
            fits = possible.get(pair)
            if fits is None:
                if len(possible) >= REMEMBERED:
                    possible.clear()
                # A token that its own merges do not give can only be a whole piece, which encode() looks up first.
                made = lengths[token] == 1 or self.halves(token) is not None
                fits = possible[pair] = made and (start == 0 or self.fits(last[start], token))
            if fits:
                last[end] = token
        if -1 in last[1:]:
            raise ValueError("the ranks do not hold every byte")

    def walk(self, data: bytes, last: list[int]) -> list[int]:
        ids, end = [], len(data)
        while end:
            ids.append(last[end])
            end -= len(self.tokens[last[end]])
        return ids[::-1]

    def encode(self, data: bytes) -> list[int]:
        """Token ids of one piece; a piece that is a token itself is that token."""
        if (whole := self.ranks.get(data)) is not None:
            return [whole]
        last = [-1]
        self.extend(data, last, 1)
        return self.walk(data, last)

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


class EncodedText:
    """A text with the last-token tables of its pieces; appends and edits redo only what they can change."""

    def __init__(self, coder: PrefixCoder, pattern: str, text: str = ""):
        self.coder, self.split, self.text = coder, regex.compile(pattern), ""
        self.pieces: list[tuple[int, int, bytes, list[int]]] = []
        self.replace(0, 0, text)

    def append(self, text: str) -> None:
        self.replace(len(self.text), len(self.text), text)

    def replace(self, start: int, end: int, text: str) -> None:
        """text[start:end] becomes `text`. A match sees at most two characters beyond what it takes."""
        grown = len(text) - (end - start)
        whole = self.text[:start] + text + self.text[end:]
        first = next((k for k, p in enumerate(self.pieces) if p[1] + 2 > start or p[0] + 3 > start), len(self.pieces))
        at = self.pieces[first][0] if first < len(self.pieces) else (self.pieces[-1][1] if self.pieces else 0)
        later = {p[0] + grown: k for k, p in enumerate(self.pieces) if p[0] >= end}
        old = self.pieces[first][2:] if first < len(self.pieces) else (b"", [-1])
        made, rest = [], []
        for match in self.split.finditer(whole, at):
            if match.start() in later and match.start() >= start + len(text):
                rest = [(a + grown, b + grown, d, t) for a, b, d, t in self.pieces[later[match.start()] :]]
                break
            data = match.group().encode()
            same = next((i for i, (a, b) in enumerate(zip(data, old[0])) if a != b), min(len(data), len(old[0])))
            last = old[1][: same + 1]
            self.coder.extend(data, last, len(last))
            made.append((match.start(), match.end(), data, last))
            old = (b"", [-1])
        self.text, self.pieces = whole, self.pieces[:first] + made + rest

    def ids(self) -> list[int]:
        out: list[int] = []
        for _, _, data, last in self.pieces:
            whole = self.coder.ranks.get(data)
            out += [whole] if whole is not None else self.coder.walk(data, last)
        return out


class Recent:
    """A dictionary that keeps about the last `bound` keys used, as two halves that replace each other."""

    def __init__(self, bound: int):
        self.half, self.new, self.old = bound // 2, {}, {}

    def get(self, key):
        found = self.new.get(key)
        if found is None and (found := self.old.get(key)) is not None:
            self.put(key, found)
        return found

    def put(self, key, value) -> None:
        if len(self.new) >= self.half:
            self.old, self.new = self.new, {}
        self.new[key] = value


class TextCoder:
    """Encodes whole texts and remembers the words it has seen.

    A match of the pattern never runs on from a character that is no white space into one that is. A text in
    which single spaces stand between other characters is therefore encoded word by word, each word with the
    space before it; any other text is split by the pattern as a whole.
    """

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.coder, self.split = PrefixCoder(ranks), regex.compile(pattern)
        self.pieces, self.words = Recent(REMEMBERED_PIECES), Recent(REMEMBERED)
        self.names = {i: str(i) for i in self.coder.tokens}

    def part(self, text: str) -> tuple[int, ...]:
        """Ids of a text, piece by piece."""
        ids = []
        for piece in self.split.findall(text):
            found = self.pieces.get(piece)
            if found is None:
                found = tuple(self.coder.encode(piece.encode()))
                self.pieces.put(piece, found)
            ids += found
        return tuple(ids)

    def encode(self, text: str) -> list[int]:
        """Ids of a whole text."""
        first, *rest = text.split(" ")
        if not rest or "" in rest or first[-1:].isspace():
            return list(self.part(text))
        ids = list(self.part(first)) if first else []
        words = self.words
        recent = words.new.get
        for word in rest:
            found = recent(word)
            if found is None:
                if (found := words.get(word)) is None:
                    if word[0].isspace() or word[-1].isspace():
                        return list(self.part(text))
                    found = self.part(" " + word)
                    words.put(word, found)
                recent = words.new.get
            ids += found
        return ids

    def named(self, ids: list[int]) -> str:
        """Ids as decimal numbers joined by spaces."""
        return " ".join(map(self.names.__getitem__, ids))


_CODERS: dict[tuple[bytes, str], TextCoder] = {}


def worker_coder(content: bytes, pattern: str) -> TextCoder:
    """The coder of this Python worker: tasks that follow one another in it share what is remembered."""
    key = (hashlib.sha256(content).digest(), pattern)
    if key not in _CODERS:
        _CODERS.clear()
        _CODERS[key] = TextCoder(parse_ranks(content), pattern)
    return _CODERS[key]


def read_ranks(path: str) -> bytes:
    """The rank file's content, read once by the driver: a vocabulary is of fixed size, whatever the corpus."""
    with open(path, "rb") as f:
        return f.read()


def encode_texts(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """Every document's token ids: doc_id, ids array<int>. Null text is empty, and empty text has no ids.

    Rows are encoded where they are, without a shuffle; repeated rows give repeated results, an empty table
    an empty one, and columns other than doc_id and text are ignored.
    """
    content = docs.sparkSession.sparkContext.broadcast(read_ranks(ranks_path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = worker_coder(content.value, pattern)
        for part in slices(batches):
            ids = [coder.encode(t) for t in part.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text")).mapInArrow(run, "doc_id long, ids array<int>")


def decode_ids(encoded: DataFrame, ranks_path: str) -> DataFrame:
    """Back from (doc_id, ids) to (doc_id, text); null ids are no ids. Bytes that are no UTF-8 become U+FFFD."""
    content = encoded.sparkSession.sparkContext.broadcast(read_ranks(ranks_path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = PrefixCoder(parse_ranks(content.value))
        for part in slices(batches):
            texts = [coder.decode(ids or []).decode("utf-8", "replace") for ids in part.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def token_digests(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """For every row of docs: doc_id, n_tokens, SHA-256 of the ids and of the bytes they decode to.

    One pass without a shuffle: ids are made and decoded in the same task, so that they need not be written.
    Null and empty texts have no tokens, and digests of the empty string; a text of any length is encoded whole.
    A null doc_id stays null, repeated rows repeat their result, an empty table gives an empty one, and columns
    other than doc_id and text are ignored.
    """
    content = docs.sparkSession.sparkContext.broadcast(read_ranks(ranks_path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = worker_coder(content.value, pattern)
        hexed = lambda data: hashlib.sha256(data).hexdigest()
        for part in slices(batches):
            counts, ids_sha, decoded_sha = [], [], []
            for text in part.column(1).to_pylist():
                ids = coder.encode(text)
                counts.append(len(ids))
                ids_sha.append(hexed(coder.named(ids).encode()))
                decoded_sha.append(hexed(coder.coder.decode(ids)))
            columns = [part.column(0), pa.array(counts, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(decoded_sha, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text")).mapInArrow(run, RESULT)
