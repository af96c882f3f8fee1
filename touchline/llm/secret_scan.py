"""Secret scans: an Aho-Corasick keyword prefilter, regular expressions anchored at its hits, and
validation of the checksums that some tokens carry.

Base kinds are ``assign`` (a credential's name, a separator and a value), ``access`` (cloud
access-key ids) and ``hex`` (long lower-case hexadecimal runs).  The method adds ``github`` and
``npm``: prefixed tokens whose last six characters are the base-62 CRC-32 of the thirty before
them; a token whose checksum fails is no hit.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The kinds in their order of listing, base kinds first.
BASE_KINDS = ("assign", "access", "hex")
KINDS = (*BASE_KINDS, "github", "npm")

_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
_ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
_DIGITS = frozenset("0123456789abcdef")
_RUN = re.compile(r"[0-9a-f]+")
#: A hexadecimal run has no keyword, but so many of its characters stand at places that ``STEP`` divides;
#: only such places are searched, and the expression is anchored at what is found there.
HEX_LEAST, STEP = 24, 8
_PROBE = re.compile(rf"[0-9a-f]{{{HEX_LEAST // STEP},}}")
_TOKEN = {"github": re.compile(r"gh[pousr]_([A-Za-z0-9]{36})(?![A-Za-z0-9])"), "npm": re.compile(r"npm_([A-Za-z0-9]{36})(?![A-Za-z0-9])")}
_BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"

#: Lower-cased keyword -> kind whose expression is tried where the keyword starts.
KEYWORDS = {
    "password": "assign",
    "passwd": "assign",
    "secret": "assign",
    "token": "assign",
    "apikey": "assign",
    "api_key": "assign",
    "akia": "access",
    "ghp_": "github",
    "gho_": "github",
    "ghu_": "github",
    "ghs_": "github",
    "ghr_": "github",
    "npm_": "npm",
}


def token_checksum(body: str) -> str:
    """The six base-62 digits of the CRC-32 of a token's body."""
    value, digits = zlib.crc32(body.encode()), ""
    while value:
        value, rest = divmod(value, 62)
        digits = _BASE62[rest] + digits
    return digits.rjust(6, "0")


def automaton() -> ahocorasick.Automaton:
    machine = ahocorasick.Automaton()
    for word, kind in KEYWORDS.items():
        machine.add_word(word, (kind, len(word)))
    machine.make_automaton()
    return machine


def hex_runs(text: str) -> Iterator[tuple[int, int]]:
    """(start, end) of the hexadecimal runs of ``HEX_LEAST`` characters or more."""
    over = 0
    for probe in _PROBE.finditer(text[::STEP]):
        for at in range(probe.start() * STEP, probe.end() * STEP, STEP):
            if at < over:
                continue
            start, end = at, _RUN.match(text, at).end()
            while start > over and text[start - 1] in _DIGITS:
                start -= 1
            over = end
            if end - start >= HEX_LEAST:
                yield start, end


def find_spans(text: str, machine: ahocorasick.Automaton) -> list[tuple[int, int, str]]:
    """(start, end, kind) in code points, ordered by start, then by kind as listed."""
    starts: dict[str, set[int]] = {}
    for end, (kind, size) in machine.iter(text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")):
        starts.setdefault(kind, set()).add(end - size + 1)
    found = []
    over = 0
    for at in sorted(starts.get("assign", ())):
        if at >= over and (m := _ASSIGN.match(text, at)):
            over = m.end()  # a value that is too short still uses up its text
            if m.end(2) - m.start(2) >= 6:
                found.append((at, over, "assign"))
    over = 0
    for at in sorted(starts.get("access", ())):
        if at >= over and (m := _ACCESS.match(text, at)):
            over = m.end()
            found.append((at, over, "access"))
    found += [(start, end, "hex") for start, end in hex_runs(text)]
    for kind, shape in _TOKEN.items():
        for at in sorted(starts.get(kind, ())):
            if (m := shape.match(text, at)) and token_checksum(m[1][:30]) == m[1][30:]:
                found.append((at, m.end(), kind))
    return sorted(found, key=lambda x: (x[0], KINDS.index(x[2])))


def _spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    machine = automaton()
    for batch in batches:
        out: list[list] = [[] for _ in range(4)]
        for text in batch.column(1):
            spans = find_spans(text.as_py() or "", machine)
            for column, values in zip(out, ([x[0] for x in spans], [x[1] for x in spans], [x[2] for x in spans]), strict=False):
                column.append(values)
        kinds = pa.list_(pa.int64())
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out[0], kinds), pa.array(out[1], kinds), pa.array(out[2], pa.list_(pa.string()))], names=["doc_id", "starts", "ends", "kinds"])


def secret_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, spans array<struct<start, end, kind>> (code points, end exclusive).

    Null text counts as empty and has no spans; repeated rows are scanned each; other columns are
    ignored.  Narrow: no shuffle, one batch in memory at a time.
    """
    flat = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(
        _spans, "doc_id long, starts array<long>, ends array<long>, kinds array<string>"
    )
    zipped = F.transform(F.arrays_zip("starts", "ends", "kinds"), lambda x: F.struct(x["starts"].alias("start"), x["ends"].alias("end"), x["kinds"].alias("kind")))
    return flat.select("doc_id", zipped.alias("spans"))


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", mark: str = "[secret]") -> DataFrame:
    """``docs`` with every span replaced by ``mark``; overlapping spans become one mark, null stays null."""

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = automaton()
        for batch in batches:
            at = batch.schema.get_field_index(text_col)
            texts = []
            for value in batch.column(at):
                text, pieces, over = value.as_py(), [], 0
                if text is None:
                    texts.append(None)
                    continue
                for start, end, _ in find_spans(text, machine):
                    if start >= over:
                        pieces += [text[over:start], mark]
                    over = max(over, end)
                texts.append("".join(pieces) + text[over:])
            yield batch.set_column(at, batch.schema.field(at), pa.array(texts, batch.schema.field(at).type))

    return docs.mapInArrow(clean, docs.schema)


def digest(spans: DataFrame) -> DataFrame:
    """Counts and hashes of base spans, and all spans as text."""

    def joined(column):
        return F.array_join(F.transform(column, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    def count(kind: str):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    base = F.filter("spans", lambda s: s["kind"].isin(*BASE_KINDS))
    return spans.select("doc_id", *[count(k) for k in BASE_KINDS], F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))
