"""Token ids of whole texts by a public tokenizer file, with the ids of repeated pieces kept.

The tokenizers library spends most of its time on words that it has met before and on tracking offsets. Here a text of
ASCII and Latin-1 letters, digits, marks, single spaces and single line feeds is split the way the pre-tokenizer splits it,
and the ids of each run are looked up; a new run is given to the library's BPE model. Any other text is cut at single
spaces, where both kinds of pre-tokenizer always cut too, and each piece that is plain in this sense is treated so; other
pieces, and any text with two spaces in a row, are encoded by the library as a whole. The ids are those of
``encode(text, add_special_tokens=False)``. ``Encoder.many`` does many byte-level texts together: plain ones are cut into runs by
vectorised work, and each distinct run of a slice is looked up once.
"""

from __future__ import annotations

import re
from array import array

import numpy as np
import pyarrow as pa
from tokenizers import Tokenizer

from factledger.llm.common import kept

KEPT = 350_000  # pieces that a worker remembers; it then starts afresh
_LETTERS = "A-Za-zÀ-ÖØ-öø-ÿ"
_MARKS = r"!-&(-/:-@\[-`{-~"  # ASCII marks but the apostrophe, which begins contractions
_PLAIN = re.compile(rf"[0-9{_LETTERS}{_MARKS}]+")
_SPLIT = {"byte": re.compile(rf" ?[{_LETTERS}]+| ?[0-9]+| ?[{_MARKS}]+"), "word": re.compile(rf"[{_LETTERS}]+|[0-9]|[{_MARKS}]+")}


def _byte_letters() -> dict[int, str]:
    """The letter that stands for each byte: itself if it prints, else the next code point from 256 on."""
    prints = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return {b: chr(b) if b in prints else chr(next(spare)) for b in range(256)}


_BYTE = _byte_letters()


class Pieces(dict):
    """Piece to the bytes of its ids (unsigned 32-bit, little-endian). ``before`` is what stands before each piece;
    ``bare`` are the pieces that nothing stands before."""

    def __init__(self, tokenizer: Tokenizer, kind: str, before: str, bare: Pieces | None = None):
        super().__init__()
        self.tokenizer, self.kind, self.before, self.bare = tokenizer, kind, before, bare if bare is not None else self
        self.bpe, self.split = tokenizer.model.tokenize, _SPLIT[kind].findall

    def __missing__(self, piece: str) -> bytes:
        if len(self) >= KEPT:
            self.clear()
        whole = self.before + piece
        lines = piece.split("\n")
        if len(lines) > 1 and all(_PLAIN.fullmatch(x) and "<|" not in x for x in lines):
            # One line feed between plain pieces is a pre-token of its own, or dropped with all white space.
            feed = self.bare["\n"] if self.kind == "byte" else b""
            found = feed.join([self[lines[0]], *[self.bare[x] for x in lines[1:]]])
        elif _PLAIN.fullmatch(piece) and "<|" not in piece:
            runs = self.split(whole.lower() if self.kind == "word" else whole)
            if len(runs) > 1:  # a word and the marks after it: each is likely to be known
                found = self[runs[0][len(self.before) :]] + b"".join([self.bare[x] for x in runs[1:]])
            else:
                found = array("I", [t.id for t in self.bpe(runs[0].encode().decode("latin-1").translate(_BYTE))]).tobytes()
        else:
            found = array("I", self.tokenizer.encode(whole, add_special_tokens=False).ids).tobytes()
        self[piece] = found
        return found


_RUNS = {"byte": re.compile(rf" ?[{_LETTERS}]+| ?[0-9]+| ?[{_MARKS}]+|\n"), "word": re.compile(rf"[{_LETTERS}]+|[0-9]|[{_MARKS}]+")}


class Runs(dict):
    """Run of letters, digits or marks (with the space before it, where the kind has it so) to the bytes of its ids."""

    def __init__(self, tokenizer: Tokenizer):
        super().__init__()
        self.bpe = tokenizer.model.tokenize

    def __missing__(self, run: str) -> bytes:
        if len(self) >= KEPT:
            self.clear()
        # Printing ASCII stands for itself.
        stands = run if run.isascii() and run.isalnum() else run.encode().decode("latin-1").translate(_BYTE)
        found = self[run] = array("I", [t.id for t in self.bpe(stands)]).tobytes()
        return found


class ByteRuns(dict):
    """Like ``Runs`` of the byte-level kind, by the run's UTF-8 bytes. ``end`` are the ids of the mark between texts. When
    half of ``KEPT`` runs are new, those before them go, but for the ones that came again."""

    def __init__(self, tokenizer: Tokenizer, end: bytes):
        super().__init__()
        self.bpe, self.end, self.before = tokenizer.model.tokenize, end, {}

    def __missing__(self, run: bytes) -> bytes:
        if run == b"\0":
            return self.end
        found = self.before.get(run)
        if found is None:
            # Printing ASCII stands for itself.
            stands = run.decode().replace(" ", _BYTE[32]) if run.isascii() and run != b"\n" else run.decode("latin-1").translate(_BYTE)
            found = array("I", [t.id for t in self.bpe(stands)]).tobytes()
        if len(self) >= KEPT // 2:
            self.before = dict(self)
            self.clear()
        self[run] = found
        return found


#: Texts whose runs leave nothing out: single spaces, each before a run, and single line feeds.
_PLAIN_TEXT = re.compile(rf"\n?(?: ?[0-9{_LETTERS}{_MARKS}]++\n?)*+")
_SPACE, _END = 3, 5


def _classes() -> np.ndarray:
    """The class of each byte of a plain text: letters (with both bytes of those of Latin-1), digits, marks, space, line
    feed, and the mark between texts."""
    out = np.zeros(256, np.uint8)
    out[48:58] = 1
    out[[c for c in range(33, 127) if not chr(c).isalnum()]] = 2
    out[32], out[10], out[0] = _SPACE, 4, _END
    return out


_CLASS = _classes()


class Encoder:
    """``kind`` "byte": byte-level BPE whose pre-tokens begin with their space; "word": BPE with word ends, lower case and
    white space dropped."""

    def __init__(self, path: str, kind: str):
        self.tokenizer = Tokenizer.from_file(path)
        self.kind = kind
        self.first = Pieces(self.tokenizer, kind, "")
        self.later = Pieces(self.tokenizer, kind, " ", self.first) if kind == "byte" else self.first
        self.runs, self.split = Runs(self.tokenizer), _RUNS[kind].findall
        self.byte_runs: ByteRuns | None = None

    def ids(self, text: str) -> bytes:
        if "  " in text:
            return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()
        if "<|" not in text and "\n\n" not in text:
            low = text if self.kind == "byte" else text.lower()
            runs = self.split(low)
            # Runs that leave nothing out but white space that is dropped anyway: the text is plain.
            left = len(low) - sum(map(len, runs))
            if left == (0 if self.kind == "byte" else low.count(" ") + low.count("\n")):
                return b"".join(map(self.runs.__getitem__, runs))
        pieces = text.split(" ")
        return self.first[pieces[0]] + b"".join(map(self.later.__getitem__, pieces[1:]))

    def many(self, texts: list[str], end: bytes = b"") -> list[bytes]:
        """The ids of each text, and ``end`` after them."""
        plain = [self.kind == "byte" and "<|" not in x and _PLAIN_TEXT.fullmatch(x) is not None for x in texts]
        found = iter(self._plain([x for x, p in zip(texts, plain, strict=True) if p], end))
        return [next(found) if p else self.ids(x) + end for x, p in zip(texts, plain, strict=True)]

    def _plain(self, texts: list[str], end: bytes) -> list[bytes]:
        if not texts:
            return []
        if self.byte_runs is None or self.byte_runs.end != end:
            self.byte_runs = ByteRuns(self.tokenizer, end)
        raw = "\0".join([*texts, ""]).encode()
        kind = _CLASS[np.frombuffer(raw, np.uint8)]
        # A run begins where the class changes, with the space before it.
        begins = kind == _END
        begins[0] = True
        begins[1:] |= (kind[1:] != kind[:-1]) & (kind[:-1] != _SPACE)
        edge = np.flatnonzero(begins)
        bounds = np.append(edge, len(raw)).astype(np.int64)
        runs = pa.Array.from_buffers(pa.large_binary(), len(edge), [None, pa.py_buffer(bounds), pa.py_buffer(raw)]).dictionary_encode()
        # Cut from one buffer: faster than a Python value made for each by Arrow.
        _, bounds, content = runs.dictionary.buffers()
        cut, stop = content.to_pybytes(), np.frombuffer(bounds, np.int64, len(runs.dictionary) + 1).tolist()
        ids = pa.array([self.byte_runs[cut[a:b]] for a, b in zip(stop, stop[1:])], pa.large_binary()).take(runs.indices)
        _, bounds, content = ids.buffers()
        stop = np.frombuffer(bounds, np.int64, len(ids) + 1)[np.flatnonzero(kind[edge] == _END) + 1].tolist()
        whole = memoryview(content) if content is not None else b""
        return [bytes(whole[a:b]) for a, b in zip([0, *stop], stop)]


def encoder(path: str, kind: str) -> Encoder:
    """The worker's encoder of a file, kept from task to task."""
    return kept(f"encoder {kind} {path}", lambda: Encoder(path, kind))
