"""Secret scans: a keyword automaton finds where a secret could start, anchored patterns are tried only there, and
kinds that carry a checksum are kept only if it holds.

Input: any table with an id and a text column; other columns are ignored or, with ``keep``, go along; ``spans_name`` is
another name for the result where one of them has it. Null and empty texts give no spans, an empty table an empty result.
Null ids stay null. Repeated rows give repeated results. Spans that start together are listed by kind. Each text is scanned
whole, in one task, by code point, in time that grows with its length alone; a task holds about ten bytes a character of
one text. Nothing is shuffled.
"""

from __future__ import annotations

import base64
import binascii
import json
import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame

from factledger.llm.common import column, quoted, slices, texts_of

# Kinds in the order in which spans that start together are listed, with the literal that every match
# starts with (compared without regard to A-Z case where the pattern allows both).
KINDS = ("assign", "access", "hex", "github", "npm", "slack", "stripe", "google", "jwt", "pem")
KEYWORDS = {
    "password": "assign", "passwd": "assign", "secret": "assign", "token": "assign", "apikey": "assign", "api_key": "assign",
    "akia": "access", "ghp_": "github", "gho_": "github", "ghu_": "github", "ghs_": "github", "ghr_": "github", "npm_": "npm",
    "xoxb-": "slack", "xoxp-": "slack", "sk_live_": "stripe", "rk_live_": "stripe", "aiza": "google", "eyj": "jwt",
    "-----begin ": "pem",
}
PATTERNS = {
    "assign": re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A),
    "access": re.compile(r"AKIA[A-Z0-9]+"),
    "github": re.compile(r"gh[pousr]_[A-Za-z0-9]{36}(?![A-Za-z0-9])"),
    "npm": re.compile(r"npm_[A-Za-z0-9]{36}(?![A-Za-z0-9])"),
    "slack": re.compile(r"xox[bp]-[0-9]{8,14}-[0-9A-Za-z-]{16,}"),
    "stripe": re.compile(r"[sr]k_live_[0-9A-Za-z]{24,}"),
    "google": re.compile(r"AIza[0-9A-Za-z_-]{35}(?![0-9A-Za-z_-])"),
    "jwt": re.compile(r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+"),
    "pem": re.compile(r"-----BEGIN (?:[A-Z]+ )?PRIVATE KEY-----[A-Za-z0-9+/=\s]+?-----END (?:[A-Z]+ )?PRIVATE KEY-----"),
}
JWT_RUN = re.compile(r"[A-Za-z0-9_-]*")
HEX_RUN, ASSIGN_LEAST, ACCESS_LEAST = 16, 12, 18
_BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"

_HEX_BYTES = bytes(104 if c in b"0123456789abcdef" else 46 for c in range(256))
_HEX_KEYWORD = b"h" * HEX_RUN


def crc_base62(body: str) -> str:
    """The six base-62 digits of the CRC-32 that end a token of this family."""
    value, digits = binascii.crc32(body.encode()), ""
    for _ in range(6):
        value, digit = divmod(value, 62)
        digits = _BASE62[digit] + digits
    return digits


def _jwt_header(text: str) -> bool:
    head = text.split(".", 1)[0]
    try:
        return "alg" in json.loads(base64.urlsafe_b64decode(head + "=" * (-len(head) % 4)))
    except (ValueError, TypeError):
        return False


def valid(kind: str, match: re.Match) -> bool:
    """The length rule or the embedded checksum of a kind."""
    whole = match[0]
    if kind == "assign":
        return len(match[2]) >= ASSIGN_LEAST
    if kind == "access":
        return len(whole) >= ACCESS_LEAST
    if kind in ("github", "npm"):
        body = whole.split("_", 1)[1]
        return crc_base62(body[:-6]) == body[-6:]
    return kind != "jwt" or _jwt_header(whole)


def automaton() -> ahocorasick.Automaton:
    out = ahocorasick.Automaton()
    for word, kind in KEYWORDS.items():
        out.add_word(word, (kind, len(word)))
    out.make_automaton()
    return out


_FOLD = {c: c + 32 for c in range(65, 91)}


def fold(text: str) -> str:
    """A-Z in lower case, every position kept."""
    low = text.lower()
    return low if len(low) == len(text) else text.translate(_FOLD)


def hex_runs(text: str) -> list[tuple[int, int]]:
    """Maximal runs of 0-9a-f, sixteen at least. Bytes of a character beyond ASCII are never of the class."""
    raw = text.encode("utf-8", "surrogatepass")
    classes = raw.translate(_HEX_BYTES)
    out, at, ascii_only = [], classes.find(_HEX_KEYWORD), len(raw) == len(text)
    while at >= 0:
        end = at + HEX_RUN
        while end < len(classes) and classes[end] == 104:
            end += 1
        start = at if ascii_only else len(raw[:at].decode("utf-8", "surrogatepass"))
        out.append((start, start + end - at))
        at = classes.find(_HEX_KEYWORD, end)
    return out


def scan(text: str, words: ahocorasick.Automaton) -> list[tuple[int, int, str]]:
    """Spans (start, end, kind) of one text, leftmost and non-overlapping within a kind, by start and then kind."""
    found = [(start, end, "hex") for start, end in hex_runs(text)]
    near: dict[str, list[int]] = {}
    for end, (kind, size) in words.iter(fold(text)):
        near.setdefault(kind, []).append(end - size + 1)
    for kind, starts in near.items():
        free, pattern = 0, PATTERNS[kind]
        for start in sorted(starts):
            if start < free:
                continue
            if match := pattern.match(text, start):
                free = match.end()
                if valid(kind, match):
                    found.append((start, free, kind))
            elif kind == "jwt":
                # Any other start in this run fails alike: what follows the run is what was missing.
                free = JWT_RUN.match(text, start).end()
    return sorted(found, key=lambda x: (x[0], KINDS.index(x[2])))


def redact(text: str, spans: list[tuple[int, int, str]]) -> str:
    """The text with each stretch covered by spans replaced by the kind of the span that opens it."""
    out, at = [], 0
    for start, end, kind in spans:
        if start >= at:
            out += [text[at:start], f"<{kind}>"]
        at = max(at, end)
    return "".join([*out, text[at:]])


_SPAN = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string())])
SPAN_DDL = "array<struct<start:bigint,end:bigint,kind:string>>"


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", replace: bool = False, keep: list[str] | None = None, spans_name: str = "spans") -> DataFrame:
    """Id and the array of its spans; with ``replace`` also the text with the spans replaced (null stays null). ``keep``
    names other columns that go along."""
    keep = keep or []
    source = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"), *[x.alias(f"keep_{k}") for k, x in enumerate(quoted(keep))])
    types = dict(docs.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = automaton()
        for batch in slices(batches):
            spans = [scan(x, words) if x else [] for x in texts_of(batch)]
            out = [column(batch, "id"), *[column(batch, f"keep_{k}") for k in range(len(keep))], pa.array([[{"start": a, "end": b, "kind": k} for a, b, k in x] for x in spans], pa.list_(_SPAN))]
            names = [id_col, *keep, spans_name]
            if replace:
                raw = column(batch, "text").to_pylist()
                out.append(pa.array([redact(t, s) if s else t for t, s in zip(raw, spans, strict=True)], pa.string()))
                names.append(text_col)
            yield pa.RecordBatch.from_arrays(out, names)

    kept = "".join(f", `{x}` {types[x]}" for x in keep)
    schema = f"`{id_col}` {types[id_col]}{kept}, `{spans_name}` {SPAN_DDL}" + (f", `{text_col}` string" if replace else "")
    return source.mapInArrow(run, schema)

