"""SentencePiece merge-type (BPE) encoding by backtracking, and decoding.

Encoding never runs the merge loop over a text.  For each start position an
Aho-Corasick automaton (over the reversed pieces, run over the reversed text)
lists the pieces that start there, longest first.  A left-to-right search takes
the longest piece that is compatible with the piece before it, and steps back
where none is; a bitfield holds the positions from which no way goes on.  Two
adjacent pieces are compatible when merging their characters anew yields just
these two pieces.  For strictly ordered merges the encoding of every prefix is
unique, so a position that failed once need never be tried again.

Pieces of equal score are only met in runs of spaces, and score below all others
(checked when the model is loaded).  So the word after a run is encoded first,
with one space, by the search; only what is left of the run, spaces and nothing
else, is merged from the left in O(n log n), as equal scores have it.  There is
no other way past the search: chunks of any length go through it whole.

Defined results: a null text counts as empty; an empty text has only the begin
and end ids; a character outside the vocabulary becomes its UTF-8 byte pieces;
repeated rows give repeated results; very long texts are encoded whole; other
columns of the input are ignored, whatever their names; an empty table gives an
empty result.
"""

from __future__ import annotations

import hashlib
import heapq
import re
import struct
from array import array
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tidemark.llm.common import file_bytes, kept, map_batches, texts_of

SPACE = "▁"
#: Kinds of piece in a model file (fixed values of the public format).
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6


def _varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        byte = data[at]
        at += 1
        value |= (byte & 127) << shift
        if byte < 128:
            return value, at
        shift += 7


def _fields(data: bytes) -> Iterator[tuple[int, object]]:
    """Field number and value of a serialised protocol-buffer message."""
    at = 0
    while at < len(data):
        key, at = _varint(data, at)
        kind = key & 7
        if kind == 0:
            value, at = _varint(data, at)
        elif kind == 2:
            n, at = _varint(data, at)
            value, at = data[at : at + n], at + n
        elif kind == 5:
            value, at = struct.unpack_from("<f", data, at)[0], at + 4
        elif kind == 1:
            value, at = struct.unpack_from("<d", data, at)[0], at + 8
        else:
            raise ValueError(f"wire type {kind} in a model file")
        yield key >> 3, value


class PieceModel:
    """A merge-type model with identity normalisation, as read from its file."""

    def __init__(self, data: bytes):
        self.pieces: list[str] = []
        self.kinds: list[int] = []
        scores: list[float] = []
        trainer, normal = {}, {}
        for field, value in _fields(data):
            if field == 1:
                piece = dict(_fields(value))
                self.pieces.append(piece[1].decode("utf-8"))
                scores.append(piece.get(2, 0.0))
                self.kinds.append(piece.get(3, NORMAL))
            elif field == 2:
                trainer = dict(_fields(value))
            elif field == 3:
                normal = dict(_fields(value))
        if trainer.get(3, 1) != 2:
            raise ValueError("not a merge-type (BPE) model")
        if normal.get(2, b"") or normal.get(4, 1) or not normal.get(5, 1) or trainer.get(24, 0):
            raise ValueError("only identity normalisation that keeps white space, and spaces before words, are supported")
        self.dummy_prefix = bool(normal.get(3, 1))
        self.unk, self.bos, self.eos = (trainer.get(k, d) for k, d in ((40, 0), (41, 1), (42, 2)))
        if any(k in (USER_DEFINED, UNUSED) for k in self.kinds):
            raise ValueError("user-defined and unused pieces are not supported")
        self.score = {p: s for p, s, k in zip(self.pieces, scores, self.kinds, strict=True) if k == NORMAL}
        self.ids = {p: i for i, (p, k) in enumerate(zip(self.pieces, self.kinds, strict=True)) if k == NORMAL}
        self.bytes = {int(p[3:5], 16): i for i, (p, k) in enumerate(zip(self.pieces, self.kinds, strict=True)) if k == BYTE}
        seen: dict[float, str] = {}
        for p, s in self.score.items():
            if s in seen and len(p) > 1 and (set(p) != {SPACE} or set(seen[s]) != {SPACE}):
                raise ValueError(f"pieces {seen[s]!r} and {p!r} have one score; merges must be strictly ordered")
            if len(p) > 1:
                seen[s] = p
        if any(SPACE in p.lstrip(SPACE) or p.startswith(SPACE * 2) and p.strip(SPACE) for p in self.score):
            raise ValueError("a piece holds a space after another character, or several before one")
        if any(s <= self.score.get(SPACE * 2, -np.inf) for p, s in self.score.items() if len(p) > 1 and p.strip(SPACE)):
            raise ValueError("spaces are merged before other characters")
        held = {c for p in self.score if len(p) > 1 for c in p}
        #: Line ends are in no piece of several characters, so chunks end there too.
        self.line_apart = "\n" not in held
        self._chunk = re.compile(f"{SPACE}+[^{SPACE}\n]*|[^{SPACE}\n]+|\n" if self.line_apart else f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+")
        self.automaton = ahocorasick.Automaton()
        for p, i in self.ids.items():
            if self.merge(p) == [p]:
                self.automaton.add_word(p[::-1], i)
        self.automaton.make_automaton()
        #: Of each piece its length and the longest shorter piece that it begins with.
        self._sizes = [len(p) for p in self.pieces]
        self._shorter = [-1] * len(self.pieces)
        for p, i in self.ids.items():
            self._shorter[i] = next((self.ids[p[:k]] for k in range(len(p) - 1, 0, -1) if p[:k] in self.ids and self.automaton.exists(p[:k][::-1])), -1)
        self._space = self.ids.get(SPACE, len(self.pieces) + ord(SPACE))
        #: Neighbouring characters of some piece; between any others a text falls apart.
        self._joined = {p[k : k + 2] for p in self.score for k in range(len(p) - 1)}
        self._pairs: dict[int, bool] = {}
        self._cache: dict[str, bytes] = {}
        raw = {i: bytes([b]) for b, i in self.bytes.items()}
        self._out = [raw[i] if k == BYTE else b"" if k == CONTROL else b" \xe2\x81\x87 " if k == UNKNOWN else p.replace(SPACE, " ").encode() for i, (p, k) in enumerate(zip(self.pieces, self.kinds, strict=True))]

    # -- merging ---------------------------------------------------------

    def merge(self, text: str) -> list[str]:
        """The pieces of ``text`` by the merge loop: best score first, the leftmost of equals."""
        score, n = self.score, len(text)
        if n < 2:
            return [text] if n else []
        if n <= 24:
            part = list(text)
            while len(part) > 1:
                best, where = None, -1
                for k in range(len(part) - 1):
                    s = score.get(part[k] + part[k + 1])
                    if s is not None and (best is None or s > best):
                        best, where = s, k
                if where < 0:
                    break
                part[where : where + 2] = [part[where] + part[where + 1]]
            return part
        part, after, before = list(text), [*range(1, n), -1], [-1, *range(n - 1)]
        heap = [(-s, k, text[k : k + 2]) for k in range(n - 1) if (s := score.get(text[k : k + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, k, whole = heapq.heappop(heap)
            j = after[k] if part[k] else -1
            if j < 0 or part[k] + part[j] != whole:
                continue
            part[k], part[j] = whole, ""
            after[k] = m = after[j]
            if m >= 0:
                before[m] = k
                if (s := score.get(whole + part[m])) is not None:
                    heapq.heappush(heap, (-s, k, whole + part[m]))
            if (h := before[k]) >= 0 and (s := score.get(part[h] + whole)) is not None:
                heapq.heappush(heap, (-s, h, part[h] + whole))
        return [p for p in part if p]

    def _piece(self, token: int) -> str:
        return self.pieces[token] if token < len(self.pieces) else chr(token - len(self.pieces))

    def compatible(self, left: int, right: int) -> bool:
        """Whether merging the characters of both pieces anew yields just these two."""
        a, b = self._piece(left), self._piece(right)
        return self.merge(a + b) == [a, b]

    # -- encoding --------------------------------------------------------

    def _search(self, chunk: str) -> list[int]:
        """Tokens of one chunk without runs of spaces; characters outside the vocabulary are numbers past it."""
        n, base, sizes, shorter = len(chunk), len(self.pieces), self._sizes, self._shorter
        longest = array("i", [-1]) * n
        for end, token in self.automaton.iter(chunk[::-1]):
            if longest[n - 1 - end] < 0:  # of the pieces that start at one place the longest comes first
                longest[n - 1 - end] = token
        pairs, failed = self._pairs, bytearray(n // 8 + 1)
        tokens: list[int] = []
        at, token = 0, longest[0] if longest[0] >= 0 else base + ord(chunk[0])
        while at < n:
            while token >= 0:
                end = at + (sizes[token] if token < base else 1)
                if not failed[end >> 3] >> (end & 7) & 1:
                    if not tokens:
                        break
                    key = tokens[-1] << 32 | token
                    fits = pairs.get(key)
                    if fits is None:
                        if len(pairs) > 1_000_000:
                            pairs.clear()
                        fits = pairs[key] = self.compatible(tokens[-1], token)
                    if fits:
                        break
                token = self._next(token, chunk[at])
            if token >= 0:
                tokens.append(token)
                at = end
                if at < n:
                    token = longest[at] if longest[at] >= 0 else base + ord(chunk[at])
            else:
                failed[at >> 3] |= 1 << (at & 7)
                last = tokens.pop()
                at -= sizes[last] if last < base else 1
                token = self._next(last, chunk[at])
        return tokens

    def _next(self, token: int, first: str) -> int:
        """The next shorter piece that starts where ``token`` does, at last the character alone, then -1."""
        if token >= len(self.pieces):
            return -1
        found = self._shorter[token]
        return len(self.pieces) + ord(first) if found < 0 and self._sizes[token] > 1 else found

    def _bytes_of(self, char: str) -> list[int]:
        return [self.bytes[b] for b in char.encode("utf-8")] if self.bytes else [self.unk]

    def encode_chunk(self, chunk: str) -> list[int]:
        word = chunk.lstrip(SPACE)
        run = len(chunk) - len(word)
        if run > 1:
            # Every other merge comes before those of spaces, so the word takes what it can of the last space first.
            found = self._search(SPACE + word) if word else []
            whole = run if not found or found[0] == self._space else run - 1
            found = self._spaces(whole) + (found[1:] if whole == run else found)
        else:
            found = self._search(chunk)
        out: list[int] = []
        for i in found:
            out.extend((i,) if i < len(self.pieces) else self._bytes_of(self._piece(i)))
        return out

    def _spaces(self, n: int) -> list[int]:
        """Tokens of a run of spaces: its merges all score alike and are done from the left."""
        return [self.ids[p] if p in self.ids else ord(p) + len(self.pieces) for p in self.merge(SPACE * n)]

    def encode(self, text: str) -> bytes:
        """Ids of a whole text with begin and end, as little-endian unsigned 32-bit integers."""
        cache = self._cache
        text = text.replace(" ", SPACE)
        if text and self.dummy_prefix:
            text = SPACE + text
        parts = [struct.pack("<I", self.bos)]
        for chunk in self._chunk.findall(text):
            got = cache.get(chunk)
            if got is None:
                # A last character that stands in no piece with the one before it (mostly a full stop) comes off.
                if chunk[-2:] not in self._joined and len(chunk) > 1:
                    got = self._kept(chunk[:-1]) + self._kept(chunk[-1])
                else:
                    got = self._kept(chunk)
            parts.append(got)
        parts.append(struct.pack("<I", self.eos))
        return b"".join(parts)

    def _kept(self, chunk: str) -> bytes:
        """Ids of a chunk, kept for its next occurrence within a bound."""
        got = self._cache.get(chunk)
        if got is None:
            ids = self.encode_chunk(chunk)
            got = struct.pack(f"<{len(ids)}I", *ids)
            if len(chunk) <= 48:
                if len(self._cache) >= 400_000:
                    self._cache.clear()
                self._cache[chunk] = got
        return got

    # -- decoding --------------------------------------------------------

    def decode_bytes(self, ids: bytes) -> bytes:
        """UTF-8 of the text that ids stand for; the space put before the text is taken off."""
        numbers = np.frombuffer(ids, dtype="<u4").tolist()
        out = b"".join(map(self._out.__getitem__, numbers))
        first = next((i for i in numbers if self.kinds[i] != CONTROL), None)
        if first is not None and self.dummy_prefix and self.pieces[first].startswith(SPACE):
            out = out[1:]
        try:
            out.decode("utf-8")
        except UnicodeDecodeError:
            out = self._with_marks(numbers)
        return out

    def _with_marks(self, numbers: list[int]) -> bytes:
        """Decoding where byte pieces form no valid character: each such byte becomes U+FFFD."""
        out: list[bytes] = []
        run = b""

        def close() -> None:
            nonlocal run
            at = 0
            while at < len(run):
                for n in (1, 2, 3, 4):
                    try:
                        out.append(run[at : at + n].decode("utf-8").encode())
                        at += n
                        break
                    except UnicodeDecodeError:
                        continue
                else:
                    out.append("�".encode())
                    at += 1
            run = b""

        began = False
        for i in numbers:
            if self.kinds[i] == BYTE:
                run += self._out[i]
                began = True
                continue
            close()
            part = self._out[i]
            if not began and self.kinds[i] != CONTROL:
                part = part[1:] if self.dummy_prefix and self.pieces[i].startswith(SPACE) else part
                began = True
            out.append(part)
        close()
        return b"".join(out)

    def decode(self, ids: list[int]) -> str:
        return self.decode_bytes(struct.pack(f"<{len(ids)}I", *ids)).decode("utf-8")


def encode_decode(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: doc_id, ids (binary, little-endian unsigned 32-bit), decoded (UTF-8 binary)."""
    return _run(docs, model_path, id_col, text_col, "doc_id long, ids binary, decoded binary", lambda ids, out: (ids, out), (pa.binary(), pa.binary()))


def encode_digests(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """As ``encode_decode``, with digests in place of ids and text, taken where both are at hand."""
    return _run(
        docs, model_path, id_col, text_col, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string",
        lambda ids, out: (len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(out).hexdigest()), (pa.int64(), pa.string(), pa.string()),
    )


def _run(docs: DataFrame, model_path: str, id_col: str, text_col: str, schema: str, result, kinds) -> DataFrame:
    sent = docs.sparkSession.sparkContext.broadcast(file_bytes(model_path))

    def per_batch(batch: pa.RecordBatch) -> pa.RecordBatch:
        model = kept(("piece model", model_path), lambda: PieceModel(sent.value))
        rows = []
        for text in batch.column(1).to_pylist():
            ids = model.encode(text)
            rows.append(result(ids, model.decode_bytes(ids)))
        columns = [pa.array(values, kind) for values, kind in zip(zip(*rows, strict=True), kinds, strict=True)]
        return pa.RecordBatch.from_arrays([batch.column(0), *columns], names=[part.split()[0] for part in schema.split(", ")])

    return map_batches(texts_of(docs, id_col, text_col), per_batch, schema)
