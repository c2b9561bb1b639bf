"""Secret scanning: patterns, and a token-efficiency test for random strings.

The base patterns are assignments to telling names, access key ids and long
runs of hexadecimal digits.  The method adds candidates (long runs of the
characters that keys are made of) whose characters per token under a byte-level
BPE vocabulary are few: a vocabulary that covers prose needs many tokens for
random strings.  Left out first are known digests (hexadecimal digits of a usual
length that the text before calls a digest), UUIDs, numbers (no letter at all) and
what a base span covers; identifiers made of words pass the test itself, as the
vocabulary has their words.  The fewer characters a string has, the lower its ratio
must be; fewer than ``LEAST_RUN`` have too few tokens to tell.  Where a whole run is
not random, or a base span covers some of it, its parts between separators are
tested: neighbours that are no words are taken together, as keys may hold
separators, and then each part alone.

Defined results: null and empty texts have no spans; very long texts are read
whole; repeated rows give repeated results; an empty table gives an empty column;
no column but the text is read.  Offsets are code points, the end exclusive.
"""

from __future__ import annotations

import base64
import hashlib
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import file_bytes, kept

#: Names, patterns and least lengths of the base kinds, in order (fixed values).
ASSIGN = re.compile(r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{32,}")
KINDS = ("assign", "access", "hex", "random")
LEAST_ASSIGN, LEAST_ACCESS = 8, 16

LEAST_RUN = 12
CANDIDATE = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{%d,}" % LEAST_RUN)
#: Lengths of MD5, SHA-1, SHA-224, SHA-256, SHA-384 and SHA-512 in hexadecimal digits.
DIGESTS = (32, 40, 56, 64, 96, 128)
UUID = re.compile(r"[0-9A-Fa-f]{8}(?:-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}")
#: What stands before a digest: its name and a sign or two.
NAMED_DIGEST = re.compile(r"(?ai:(?<![a-z])(?:md5|sha-?[0-9]{1,3}|digest|checksum|commit|revision|etag|integrity|hash)(?:sum)?)[\"'\x20:=@(/_-]{0,4}\Z")
#: The parts of a run; a UUID is one of them.
PART = re.compile(r"(?<![A-Za-z0-9])" + UUID.pattern + r"(?![A-Za-z0-9])|[A-Za-z0-9]+")
#: A string with fewer characters for each token counts as random, from so many characters on.
LIMITS = ((20, 1.9), (16, 1.7), (LEAST_RUN, 1.4))
LEAST_RATIO = LIMITS[0][1]

#: From this length a part of many characters per token is a word, and ends what may be one key.
LEAST_WORD = 4


def is_known(text: str, before: str = "") -> bool:
    """A UUID, or a digest of a usual length that the text ``before`` it calls one."""
    if UUID.fullmatch(text):
        return True
    return bool(len(text) in DIGESTS and re.fullmatch(r"[0-9a-f]+|[0-9A-F]+", text) and NAMED_DIGEST.search(before))


def uncovered(part: tuple[int, int], covered: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """What sorted ``covered`` spans leave of a part."""
    out, at = [], part[0]
    for s, e in covered:
        if s >= part[1]:
            break
        if s > at:
            out.append((at, s))
        at = max(at, e)
    return [*out, (at, part[1])] if at < part[1] else out


class Scanner:
    def __init__(self, ranks: bytes, pattern: str):
        import tiktoken

        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}
        self.encoding = tiktoken.Encoding("secrets", pat_str=pattern, mergeable_ranks=table, special_tokens={})

    def is_dense(self, text: str, limit: float = LEAST_RATIO) -> bool:
        """Few characters per token, as in random strings."""
        return len(text) < limit * len(self.encoding.encode_ordinary(text))

    def is_random(self, text: str, before: str = "") -> bool:
        """Few characters per token for its length, and neither a known digest (by what stands ``before``) nor an identifier nor a number."""
        limit = next((x for n, x in LIMITS if len(text) >= n), 0.0)
        return bool(limit) and any(c.isalpha() for c in text) and not is_known(text, before) and self.is_dense(text, limit)

    def random_parts(self, run: str, covered: list[tuple[int, int]], before: str = "") -> list[tuple[int, int]]:
        """What of a run is random, but for what is covered; ``before`` is the text in front of it."""
        parts = [(m, is_known(m.group(), before + run[: m.start()])) for m in PART.finditer(run)]
        if not covered and not any(known for _, known in parts) and self.is_random(run, before):
            return [(0, len(run))]
        groups: list[list[tuple[int, int]]] = [[]]
        for m, known in parts:
            a, b = m.span()
            if known or any(s <= a and b <= e for s, e in covered) or b - a >= LEAST_WORD and not self.is_dense(m.group()):
                groups.append([])
            else:
                groups[-1].append((a, b))
        out: list[tuple[int, int]] = []
        for group in groups:
            # Words too short to end a group ("key", "in") may stand inside a key, but do not begin or end one.
            while group and not self.is_dense(run[slice(*group[0])]):
                group = group[1:]
            while group and not self.is_dense(run[slice(*group[-1])]):
                group = group[:-1]
            if not group:
                continue
            whole = (group[0][0], group[-1][1])
            found = [whole] if self.is_random(run[slice(*whole)]) else [p for p in group if self.is_random(run[slice(*p)])]
            out += [piece for p in found for piece in uncovered(p, covered)]
        return out

    def spans(self, text: str) -> list[tuple[int, int, str]]:
        """(start, end, kind) by start, then kind as listed."""
        out = []
        low = text.lower()
        if any(name in low for name in ("passw", "secret", "token", "apikey", "api_key")):
            out += [(m.start(), m.end(), 0) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= LEAST_ASSIGN]
        if "AKIA" in text:
            out += [(m.start(), m.end(), 1) for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST_ACCESS]
        out += [(m.start(), m.end(), 2) for m in HEX.finditer(text)]
        base = sorted(out)
        for m in CANDIDATE.finditer(text):
            a, b = m.span()
            covered = [(max(s, a) - a, min(e, b) - a) for s, e, _ in base if s < b and a < e]
            out += [(a + s, a + e, 3) for s, e in self.random_parts(m.group(), covered, text[max(0, a - 24) : a])]
        return [(s, e, KINDS[k]) for s, e, k in sorted(out, key=lambda x: (x[0], x[2]))]


def joined(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for s, e, k in spans)


def _scanner(sent, path: str, pattern: str) -> Scanner:
    return kept(("scanner", path), lambda: Scanner(sent.value, pattern))


def scan(docs: DataFrame, text: Column, ranks_path: str, pattern: str) -> Column:
    """Struct of n_assign, n_access, n_hex, n_random, base (spans joined) and spans (all, joined)."""
    sent = docs.sparkSession.sparkContext.broadcast(file_bytes(ranks_path))

    @F.pandas_udf("n_assign long, n_access long, n_hex long, n_random long, base_sha256 string, spans string")
    def found(texts: pd.Series) -> pd.DataFrame:
        one, rows = _scanner(sent, ranks_path, pattern), []
        for x in texts:
            spans = one.spans(x)
            counts = [sum(k == kind for _, _, k in spans) for kind in KINDS]
            rows.append((*counts, hashlib.sha256(joined([s for s in spans if s[2] != "random"]).encode()).hexdigest(), joined(spans)))
        return pd.DataFrame(rows, columns=["n_assign", "n_access", "n_hex", "n_random", "base_sha256", "spans"])

    return found(F.coalesce(text.cast("string"), F.lit("")))


def redact_text(text: str, spans: list[tuple[int, int, str]], mark: str) -> str:
    """The text with every span (overlapping ones as one) replaced."""
    out, at, stop = [], 0, -1
    for s, e, _ in spans:
        if s >= stop:
            out += [text[at:s], mark]
        stop = at = max(stop, e)
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, text: Column, ranks_path: str, pattern: str, mark: str = "[secret]") -> Column:
    """The text with secrets replaced by ``mark``."""
    sent = docs.sparkSession.sparkContext.broadcast(file_bytes(ranks_path))

    @F.pandas_udf("string")
    def clean(texts: pd.Series) -> pd.Series:
        one = _scanner(sent, ranks_path, pattern)
        return pd.Series([None if x is None else redact_text(x, found, mark) if (found := one.spans(x)) else x for x in texts], dtype="object")

    return clean(text)
