"""Secret scans: three plain patterns, and zstandard novelty of strings in a sensitive context.

A candidate is a run of at least 16 key characters that holds a digit and a letter, or both cases, with a
sensitive word in the 48 characters before it, or before the candidates of the same block: those with only a dot or
a line break between them (lines of a private key, parts of a web token). It is compressed with a dictionary
of common identifiers and the text around it (1,024 characters on each side). The candidate is cut out there, and
so are its copies behind it and those in a sensitive context before it: a key that stands twice does not hide
itself, but what plain text has named before is no secret. What repeats a name, a neighbour or an
identifier costs few bytes; a key costs nearly its length, or what its alphabet allows. Strings whose marginal bytes
reach 0.75 of their length, or above ``SHORT`` characters the entropy of their distinct symbols if that is
less, are reported as ``novel``, with all other copies in the text, and the short last line before the end mark of a key.

Cases: a null text is an empty one; repeated rows each get a row; spans of different kinds may overlap
(all are reported; redaction merges them); an empty table gives an empty result; extra columns are
ignored by the scan and kept by the redaction.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

from flowloom.llm.inputs import bound_batches, in_slices, texts, tidied
from flowloom.session import ship_package

KINDS = ["assign", "access", "hex", "novel"]
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ASSIGN_WORDS = ("passw", "secret", "token", "api")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
# Runs that are too short are left out by the pattern: a run has no shorter start that could match instead.
HEX = re.compile(r"[0-9a-f]{24,}")
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{16,}")
SENSITIVE = ("key", "secret", "token", "passw", "pwd", "auth", "bearer", "credential", "private", "access", "login", "cookie", "session", "signature")
CONTEXT = 48
AROUND = 1_024
NOVELTY = 0.75
# Up to so many characters, or with fewer distinct ones, the fixed share alone decides.
SHORT, LEAST_SYMBOLS = 40, 10
# What stands between parts of one block (the n of an escaped line break is a key character), and the last line of a key.
JOINT = re.compile(r"\.|[ \t]*\r?\n[ \t]*|(?:\\r)?\\(?:n[ \t]+)?")
LAST_LINE = re.compile(r"[ \t]*(?:\r?\n|(?:\\r)?\\n)[ \t]*([A-Za-z0-9+/]{1,15}={0,2})(?=[ \t]*(?:\r?\n|(?:\\r)?\\n)[ \t]*-----END)")
# Words that code and configuration name things by; prose is covered by the text around.
IDENTIFIERS = " ".join(
    """password passwd secret token api_key apikey access_key secret_key private_key public_key client_id client_secret
    authorization bearer session cookie signature credential username user_name login account default example sample
    configuration environment variable function return import export const static public private class string integer
    boolean request response header content_type application json https http localhost database connection hostname
    timestamp identifier description parameter argument attribute property element document window message service
    ABCDEFGHIJKLMNOPQRSTUVWXYZ abcdefghijklmnopqrstuvwxyz 0123456789 1234567890 0000000000000000 xxxxxxxxxxxxxxxx""".split()
).encode()


def marginal_bytes(candidate: str, before: str, after: str) -> int:
    """Compressed bytes that ``candidate`` adds to what identifiers and the text around it tell."""
    primed = zstandard.ZstdCompressionDict(IDENTIFIERS + after.encode() + before.encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    squeeze = zstandard.ZstdCompressor(level=19, dict_data=primed, write_content_size=False, write_checksum=False, write_dict_id=False)
    return len(squeeze.compress(candidate.encode())) - len(squeeze.compress(b""))


def _mixed(candidate: str) -> bool:
    has_digit, has_letter = any(c.isdigit() for c in candidate), any(c.isalpha() for c in candidate)
    return has_letter and (has_digit or not (candidate.islower() or candidate.isupper() or candidate.istitle()))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, number of the kind, end) of the plain patterns; a kind's spans do not overlap."""
    lower, found = text.lower(), []
    if any(w in lower for w in ASSIGN_WORDS):
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if len(m[0]) >= 20]
    return found + [(m.start(), 2, m.end()) for m in HEX.finditer(text)]


def least_bytes(candidate: str, threshold: float = NOVELTY) -> float:
    """Marginal bytes from which a candidate is novel: a share of its length, or what a random string of its symbols costs."""
    share, symbols = threshold, len(set(candidate))
    if len(candidate) > SHORT and symbols >= LEAST_SYMBOLS:
        share = min(share, math.log2(symbols) / 8)
    return share * len(candidate)


def _without(text: str, begin: int, end: int, gone: list[tuple[int, int]]) -> str:
    """``text[begin:end]`` less the spans in ``gone``."""
    parts, at = [], begin
    for a, b in gone:
        if b > at and a < end:
            parts.append(text[at : max(at, a)])
            at = b
    return "".join(parts) + text[at:end]


def novel_spans(text: str, threshold: float = NOVELTY) -> list[tuple[int, int, int]]:
    """Incompressible candidates behind a sensitive word."""
    lower = text.lower()
    if not any(w in lower for w in SENSITIVE):
        return []
    spots, sensitive, last = defaultdict(list), {}, None
    for m in CANDIDATE.finditer(text):
        begin, end = m.span()
        context = text[max(0, begin - CONTEXT) : begin].lower()
        # The context runs on through the parts of a block.
        goes_on = last is not None and sensitive[last] and begin - last[1] <= CONTEXT and JOINT.fullmatch(text, last[1], begin)
        last = (begin, end)
        sensitive[last] = bool(goes_on) or any(w in context for w in SENSITIVE)
        spots[m[0]].append(last)
    found = []
    for candidate, copies in spots.items():
        if not _mixed(candidate) or not any(sensitive[c] for c in copies):
            continue
        for begin, end in copies:
            if not sensitive[begin, end]:
                continue
            gone = [c for c in copies if c[0] > begin or sensitive[c]]
            before, after = _without(text, max(0, begin - AROUND), begin, gone), _without(text, end, end + AROUND, gone)
            if marginal_bytes(candidate, before, after) >= least_bytes(candidate, threshold):
                found += [(a, 3, b) for a, b in copies]
                break
    for _, _, end in found[:]:
        if m := LAST_LINE.match(text, end):
            found.append((m.start(1), 3, m.end(1)))
    return sorted(found)


def all_spans(text: str) -> list[tuple[int, int, int]]:
    return sorted(base_spans(text) + novel_spans(text))


def _written(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for start, kind, end in spans)


def scan(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counts and spans (code points, end exclusive) of each document, ordered by start, then kind."""
    names = ["doc_id", "n_assign", "n_access", "n_hex", "n_novel", "base_sha256", "spans"]

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_slices(batches, "text"):
            rows = []
            for text in batch.column("text").to_pylist():
                spans = all_spans(text)
                counts = [sum(s[1] == kind for s in spans) for kind in range(4)]
                base = _written([s for s in spans if s[1] < 3])
                rows.append((*counts, hashlib.sha256(base.encode()).hexdigest(), _written(spans)))
            parts = [pa.array(list(c), kind) for c, kind in zip(zip(*rows), [pa.int64()] * 4 + [pa.string()] * 2)]
            if rows:
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *parts], names)

    narrow = texts(docs, id_col, text_col)
    kind = narrow.schema["doc_id"].dataType.simpleString()
    return narrow.mapInArrow(each, f"doc_id {kind}, n_assign long, n_access long, n_hex long, n_novel long, base_sha256 string, spans string")


def redacted(text: str, mask: str) -> str:
    """``text`` with each span, or run of overlapping ones, replaced by ``mask``."""
    parts, at = [], 0
    for start, _, end in all_spans(text):
        if start >= at:
            parts += [text[at:start], mask]
        at = max(at, end)
    return "".join(parts) + text[at:]


def redact(docs: DataFrame, *, text_col: str = "text", mask: str = "[secret]") -> DataFrame:
    """All rows and columns of ``docs``, secrets masked in the text; null texts stay null."""
    ship_package(docs.sparkSession)
    bound_batches(docs.sparkSession)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_slices(batches, text_col):
            at = batch.schema.get_field_index(text_col)
            masked = [t if t is None else redacted(t, mask) for t in batch.column(at).to_pylist()]
            yield batch.set_column(at, batch.schema.field(at), pa.array(masked, batch.schema.field(at).type))

    return docs.select("*").mapInArrow(tidied(each), docs.schema)
