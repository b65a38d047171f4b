"""Secret scans: fixed patterns, and strings that stay incompressible next to what stands around them.

A candidate is a run of credential characters. Its novelty is what it adds to the zstandard-compressed size of
the text around it, with a dictionary of common identifiers given to the compressor beforehand: a word, a path
or an identifier that occurs nearby adds little, a random key adds nearly its own entropy. Candidates near a
word that tells of credentials are reported when each of their characters adds enough. Letters of one case alone add
less, and so do words that are strung together; of those as many different letters are asked for as a random string
has. Spans of the fixed patterns are measured too, and stay whatever comes of it.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, functions as F

from .common import slices, text_of

#: The kinds in the order in which spans of one start are listed.
KINDS = ("assign", "access", "hex", "novel")
#: group 2 is the value.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
#: A run that may be a credential: 20 characters or more.
CANDIDATE = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}={0,2}")
#: Letters of one case alone; bytes that each adds at least, and their different letters, as a share of those that a random string has.
LETTERS = re.compile(r"[a-z]+|[A-Z]+")
LETTERS_RATE, DIFFERENT = 0.3, 0.86
#: Kinds of characters of a candidate, and how many there are of each.
KINDS_OF_SIGNS = [(26, re.compile("[a-z]")), (26, re.compile("[A-Z]")), (10, re.compile("[0-9]")), (5, re.compile("[+/_=-]"))]
#: Words that make a context sensitive.
SENSITIVE = re.compile(r"passw|secret|token|api[_-]?key|auth|credential|private|bearer|access|signature|login|session", re.IGNORECASE)
#: Identifiers and phrases that code and configuration share: fixed values.
IDENTIFIERS = """
access_key access_token account api_key api_secret application argument array assert async attribute auth_token
authorization await base64 bearer boolean branch buffer bytes callback catch certificate char class client
client_id client_secret config connection const container content context continue cookie count create
credential current data database debug decode default define delete description directory document domain
else email enable encode encrypt endpoint entry environment error event example except exception execute
export expire extends false field file filter final float format from function generate global group handler
hash header hidden host http https identifier image import include index info init input instance int integer
interface item iterator json key label lambda length level library license line list load local location log
login long main map match memory message method model module name namespace network node none null number
object offset open operator option order output package page param parameter parent parse passwd password path
pattern payload permission pointer port prefix print private process project property protected protocol
provider proxy public query queue random read record redirect reference region register release remote remove
render replace request require resource response result return role root route sample schema scope script
search secret secret_key section security select self send sequence server service session setting shared
signature size source static status storage stream string struct style submit switch system table target task
template test text thread throw time timeout timestamp title token trace transaction true try type union
unique update upload url user username utf-8 value variable vector version view void while window write yield
0123456789 abcdefghijklmnopqrstuvwxyz ABCDEFGHIJKLMNOPQRSTUVWXYZ
""".encode()
RESULT = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, added string"
FOUND = "doc_id long, kind string, start int, end int, value string, added int"


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the fixed patterns; of each kind leftmost matches that do not overlap."""
    spans = [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    if "AKIA" in text:
        spans += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= 18]
    return spans + [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]


def merged(spans: list[tuple[int, int, str]]) -> list[tuple[int, int]]:
    """The stretches of text that spans cover, in order and apart."""
    out: list[tuple[int, int]] = []
    for a, b, _ in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


class Novelty:
    """Marginal compressed bytes of a string after a context."""

    def __init__(self, dictionary: bytes = IDENTIFIERS, level: int = 3):
        primed = zstandard.ZstdCompressionDict(dictionary, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        self.compressor = zstandard.ZstdCompressor(level=level, dict_data=primed, write_content_size=False, write_checksum=False)

    def added(self, context: bytes, candidate: bytes) -> int:
        size = lambda data: len(self.compressor.compress(data))
        return size(context + b" " + candidate) - size(context + b" ")


def is_novel(candidate: str, added: int, rate: float) -> bool:
    """Whether what a candidate adds is what a random string would: `rate` bytes a character, fewer where it uses few kinds of characters."""
    n = len(candidate)
    if not LETTERS.fullmatch(candidate):
        signs = sum(size for size, kind in KINDS_OF_SIGNS if kind.search(candidate))
        return added >= rate * min(1.0, math.log2(signs) / 6) * n
    return added >= min(rate, LETTERS_RATE) * n and len(set(candidate)) >= DIFFERENT * 26 * (1 - (25 / 26) ** n)


def measured(text: str, a: int, b: int, novelty: Novelty, window: int = 240) -> int:
    """Bytes that text[a:b] adds to what stands around it."""
    context = (text[max(0, a - window) : a] + text[b : b + window]).encode("utf-8", "replace")
    return novelty.added(context, text[a:b].encode("utf-8", "replace"))


def novel_spans(text: str, novelty: Novelty, base: list[tuple[int, int, str]], window: int = 240, near: int = 48, rate: float = 0.6) -> dict[tuple[int, int, str], int]:
    """Candidates outside base spans that are novel, with a sensitive word within `near` characters on either side, and the bytes that each adds; see is_novel."""
    spans, at = {}, 0
    taken = merged(base)
    for m in CANDIDATE.finditer(text):
        a, b = m.span()
        # Candidates and taken stretches both come in order: one pass over each, whatever their number.
        while at < len(taken) and taken[at][1] <= a:
            at += 1
        if at < len(taken) and taken[at][0] < b:
            continue
        if not (SENSITIVE.search(text, max(0, a - near), a) or SENSITIVE.search(text, b, b + near)):
            continue
        added = measured(text, a, b, novelty, window)
        if is_novel(m.group(), added, rate):
            spans[a, b, "novel"] = added
    return spans


def in_order(spans: Iterable[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """Spans by start, then kind."""
    return sorted(spans, key=lambda s: (s[0], KINDS.index(s[2]), s[1]))


def joined(spans: Iterable[tuple[int, int, str]]) -> str:
    """kind:start:end by start, then kind; comma-joined."""
    return ",".join(f"{kind}:{a}:{b}" for a, b, kind in in_order(spans))


def _scanned(batches: Iterator[pa.RecordBatch], rate: float) -> Iterator[tuple]:
    novelty = Novelty()
    for part in slices(batches):
        for doc_id, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
            base = base_spans(text)
            more = novel_spans(text, novelty, base, rate=rate)
            yield doc_id, text, base, {s: measured(text, *s[:2], novelty) for s in base} | more


def find_secrets(docs: DataFrame, rate: float = 0.6) -> DataFrame:
    """One row for each secret: doc_id, kind, start, end (code points, end exclusive), value, added (bytes that it adds to what is around it).

    Null and empty texts give none, repeated rows repeat theirs. A pass over each row, without a shuffle; other
    columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = []
        for doc_id, text, _, every in _scanned(batches, rate):
            rows += [(doc_id, kind, a, b, text[a:b], every[a, b, kind]) for a, b, kind in in_order(every)]
            if len(rows) >= 1000:
                yield _batch(rows, FOUND_ARROW)
                rows = []
        if rows:
            yield _batch(rows, FOUND_ARROW)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text")).mapInArrow(run, FOUND)


FOUND_ARROW = pa.schema([("doc_id", pa.int64()), ("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("value", pa.string()), ("added", pa.int32())])
DIGEST_ARROW = pa.schema([("doc_id", pa.int64()), ("n_assign", pa.int64()), ("n_access", pa.int64()), ("n_hex", pa.int64()), ("base_sha256", pa.string()), ("spans", pa.string()), ("added", pa.string())])


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows), schema)], schema=schema)


def secret_digests(docs: DataFrame, rate: float = 0.6) -> DataFrame:
    """One row for each row of docs: counts by kind, SHA-256 of the base spans, all spans as text, and the bytes that each adds, in the same order.

    Null and empty texts have no spans: counts of 0, the digest of the empty text, an empty list. A text of any
    length is read once, in time that grows with its length. Repeated rows repeat their result, a null doc_id stays
    null, spans of one start come in the order of KINDS, an empty table gives an empty result, and other columns
    are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = []
        for doc_id, _, base, every in _scanned(batches, rate):
            kinds = [k for _, _, k in base]
            sha = hashlib.sha256(joined(base).encode()).hexdigest()
            rows.append((doc_id, kinds.count("assign"), kinds.count("access"), kinds.count("hex"), sha, joined(every), ",".join(str(every[s]) for s in in_order(every))))
            if len(rows) == 1000:
                yield _batch(rows, DIGEST_ARROW)
                rows = []
        if rows:
            yield _batch(rows, DIGEST_ARROW)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text")).mapInArrow(run, RESULT)
