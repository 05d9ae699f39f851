"""Secret scans: fixed patterns, and novelty under a primed zstandard compressor.

Patterns find assignments, access keys and long hex runs. Beyond them, every long
string near a sensitive word of its line, before it or behind, is a candidate: its
novelty is the number of bytes that it adds to the compressed form of the code around
it, under a dictionary of common identifiers. Strings that hardly compress are reported
as well, whole. Whole texts are scanned.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession

from .common import slices, table

ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
#: Kinds in the order in which equal starts are listed.
KINDS = ("assign", "access", "hex", "novel")
#: One of these stands in every assignment.
ASSIGN_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")

#: Words near which a string may be a secret.
SENSITIVE = ("password", "passwd", "pwd", "secret", "token", "apikey", "api_key", "api-key", "private_key", "access_key",
             "auth_key", "authorization", "bearer", "credential", "client_id", "signing_key", "session_id", "license_key")
_SENSITIVE = re.compile("|".join(SENSITIVE))
#: Parts joined by dots, with padding behind, but not the host of a mail address; least length.
CANDIDATE, LEAST = re.compile(r"(?<![@A-Za-z0-9+/_.-])[A-Za-z0-9+/_-]+(?:\.[A-Za-z0-9+/_-]+)*={0,2}"), 16
#: Characters on either side of a candidate that the compressor sees with it, and in which a sensitive word counts.
CONTEXT = 256
#: Added bytes for each byte of the candidate from which it is reported.
NOVELTY = 0.7
#: What identifiers and code commonly consist of; it primes the compressor.
IDENTIFIERS = (
    "abstract access account action address admin alias allow append application array assert async attribute auth "
    "authorization await backend base64 bearer boolean bucket buffer build cache callback certificate class client client_id "
    "client_secret close cluster code collection column command commit component config configuration connection const "
    "container content context control cookie copy count create credential current database dataset date debug decode default "
    "define delete deploy description dictionary directory document domain double element email enable encode endpoint engine "
    "entry environment error event example exception execute export extends factory false field file filter final float folder "
    "format function generate getenv global group handler hash header hostname http https identifier implements import include "
    "index init input instance integer interface internal iterator json key label language length library license license_key "
    "list listener local localhost location logger login logout manager master message method model module name namespace node "
    "null number object offset open operation option organization os.environ output package parameter parent parse password path "
    "pattern payload permission pipeline port prefix print private private_key process production profile project property "
    "protected protocol provider proxy public query queue random read record redirect reference region register release remote "
    "remove render repository request require resource response result return role route schema scope script search secret "
    "secret_key select self sequence server service session session_id setting sign signature signing_key source specification "
    "staging static status storage stream string struct suffix switch system table target template test thread timeout "
    "timestamp title token transaction transform true type undefined unique update upload url user user_id username utf-8 "
    "validate value variable vector version view void volume webhook window worker write yaml "
    "012345678901234567890123456789 abcdefghijklmnopqrstuvwxyz ABCDEFGHIJKLMNOPQRSTUVWXYZ"
)


class Novelty:
    """Marginal compressed bytes of a string in its context, for each of its own."""

    def __init__(self, identifiers: str = IDENTIFIERS, level: int = 3):
        primed = zstandard.ZstdCompressionDict(identifiers.encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        self.compressor = zstandard.ZstdCompressor(
            level=level, dict_data=primed, write_checksum=False, write_content_size=False, write_dict_id=False)

    def __call__(self, before: str, candidate: str, behind: str = "") -> float:
        first, own, last = (s.encode("utf-8", "surrogatepass") for s in (before, candidate, behind))
        added = len(self.compressor.compress(first + own + last)) - len(self.compressor.compress(first + last))
        return added / len(own)


def base_spans(text: str, low: str) -> list[tuple[int, int, str]]:
    """(start, kind's place, end) of what the fixed patterns find."""
    found = []
    if any(w in low for w in ASSIGN_WORDS):
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def novel_spans(text: str, low: str, base: list, novelty: Novelty, least: float = NOVELTY) -> list[tuple[int, int, str]]:
    """Candidates near a sensitive word of their line that hardly compress and don't lie in a base span."""
    found, done = [], 0
    for word in _SENSITIVE.finditer(low):
        begin, until = text.rfind("\n", 0, word.start()) + 1, text.find("\n", word.end())
        until = len(text) if until < 0 else until
        # A candidate begins in reach of the word or, where it stands before, ends there; its own length has no bound.
        for m in CANDIDATE.finditer(text, max(begin, done), until):
            start, end = m.span()
            if start > word.end() + CONTEXT:
                break
            if end < word.start() - CONTEXT:
                continue
            done = end
            if end - start < LEAST or any(s <= start and end <= e for s, _, e in base):
                continue
            if novelty(text[max(0, start - CONTEXT):start], m.group(), text[end:end + CONTEXT]) >= least:
                found.append((start, 3, end))
    return found


def _lowered(text: str) -> str:
    low = text.lower()
    return low if len(low) == len(text) else re.sub("[A-Z]+", lambda m: m.group().lower(), text)


def scan(text: str | None, novelty: Novelty) -> tuple[list, list]:
    """Spans of the fixed patterns and of all methods, each sorted by start and kind."""
    text = text or ""
    low = _lowered(text)
    base = base_spans(text, low)
    return base, sorted(base + novel_spans(text, low, base, novelty))


def joined(spans: list) -> str:
    return ",".join(f"{KINDS[k]}:{start}:{end}" for start, k, end in spans)


_SCHEMA = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_novel long"


def secret_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_novel for every row.

    A null text counts as empty; an empty text has no spans and the digest of an
    empty string. Ids may be null or repeat: each row has its own result. An empty
    table gives no rows; further columns are not read.
    """

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        novelty = Novelty()
        for batch in slices(batches, 1):
            out = []
            for text in batch.column(1).to_pylist():
                base, spans = scan(text, novelty)
                n = [sum(k == kind for _, k, _ in spans) for kind in range(4)]
                out.append((n[0], n[1], n[2], hashlib.sha256(joined(base).encode()).hexdigest(), joined(spans), n[3]))
            cols = list(zip(*out, strict=True)) or [()] * 6
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))],
                names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_novel"])

    rows = docs.selectExpr(f"cast(`{id_col}` as long) doc_id", f"cast(`{text_col}` as string) text")
    return rows.mapInArrow(of, _SCHEMA)


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan(table(spark, sf_dir, "documents"))
