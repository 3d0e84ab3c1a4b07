"""Secret scans: fixed patterns, and a token-efficiency test for random strings.

Base spans come from three patterns. The method adds spans of kind ``random``: runs of
20 characters or more of a key's alphabet whose characters per token under a byte-level
vocabulary are as few as in random strings, for words and identifiers compress well and
random strings don't. How few that is depends on a run's letters, digits and length, so
the limit is calibrated: for each of seven alphabets and each length it is the value that
``COVERAGE`` of planted random strings (a fixed seed, no documents) stay within.

Left out are known digests (hex of a common digest length, UUIDs, digests after an
algorithm's name), identifiers (words of four letters or more joined by separators, case
changes or numbers, which compress as no random letters do, whatever the numbers among
them), plain numbers, and runs that touch a base span.

Offsets are code points, ends exclusive. Defined cases: a null or empty text has
no spans; an empty table gives none; whole texts are scanned, whatever their length;
equal rows and rows with a null or repeated doc_id stay rows of their own; of spans that
start together the kinds' order decides; other columns of the documents are left aside by
find_secrets and pass through redact_secrets as they were, whatever their names.
"""

from __future__ import annotations

import base64
import hashlib
import random
import re
import string
from bisect import bisect_left
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame

from tarnfield.llm.common import slices, strings

KINDS = ("assign", "access", "hex", "random")
#: Share of planted random strings that the limit lets through, how many are planted, and the length from which the limit stays the same.
COVERAGE, PLANTED, LONGEST_PLANTED = 0.94, 1000, 64
#: '=' is padding at a run's end only: a run may start right after it, as in name=value.
RUN = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}+={0,2}+(?!=)")
DIGEST_LENGTHS = (32, 40, 56, 64, 96, 128)
DIGEST = re.compile(r"[0-9A-Fa-f]+|(?:md5|sha1|sha224|sha256|sha384|sha512)-[A-Za-z0-9+/]+={0,2}|[0-9A-Fa-f]{8}(?:-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}")
#: Words joined by separators, capitals or numbers. No part can match in two ways, so a failure costs no retries.
IDENTIFIER = re.compile(r"(?:[A-Z]{4,}+|[A-Z]?+[a-z]{4,}+|[0-9/_+=-]++)++")
WORD = re.compile(r"[A-Z]{4,}|[A-Z]?[a-z]{4,}")
HEXADECIMAL = {"0123456789abcdef": re.compile(r"[0-9a-f]+"), "0123456789ABCDEF": re.compile(r"[0-9A-F]+")}


def either_case(word: str) -> str:
    """A pattern for ASCII letters in either case, without Unicode's case folding."""
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


ASSIGN = re.compile("(" + "|".join(map(either_case, ("password", "passwd", "secret", "token", "api_?key"))) + ")" + r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
#: Runs of at least the least length are those of the plain pattern that pass: a run's match starts where the run does.
HEX = re.compile(r"[0-9a-f]{24,}")


def default_ranks() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


@cache
def encoding(ranks_path: str | None):
    """The byte-level vocabulary, once for each worker process."""
    import public_tokenizers
    import tiktoken

    with open(ranks_path or default_ranks(), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def base_spans(text: str) -> list[tuple[str, int, int]]:
    found = [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    found += [("access", m.start(), m.end()) for m in ACCESS.finditer(text)]
    return found + [("hex", m.start(), m.end()) for m in HEX.finditer(text)]


def alphabet_of(run: str) -> str:
    """The characters that a random string like ``run`` is drawn from; separators aside; empty for a plain number."""
    lower, upper, digit = (any(c in chars for c in run) for chars in (string.ascii_lowercase, string.ascii_uppercase, string.digits))
    if not lower and not upper:
        return ""
    if digit:
        for chars, pattern in HEXADECIMAL.items():
            if pattern.fullmatch(run):
                return chars
    return string.ascii_lowercase * lower + string.ascii_uppercase * upper + string.digits * digit


@cache
def most_per_token(alphabet: str, length: int, ranks_path: str | None, coverage: float) -> float:
    """Characters per token that ``coverage`` of random strings of this alphabet and length don't exceed."""
    rng, encode = random.Random(f"{alphabet} {length}"), encoding(ranks_path).encode_ordinary
    ratios = sorted(length / len(encode("".join(rng.choices(alphabet, k=length)))) for _ in range(PLANTED))
    return ratios[min(PLANTED - 1, int(coverage * PLANTED))]


def _compresses_badly(alphabet: str, parts: tuple[str, ...] | list[str], ranks_path: str | None, coverage: float) -> bool:
    """Whether the parts have no more characters per token than random strings of their alphabet and length."""
    encode, length = encoding(ranks_path).encode_ordinary, sum(map(len, parts))
    return length <= most_per_token(alphabet, min(length, LONGEST_PLANTED), ranks_path, coverage) * sum(len(encode(p)) for p in parts)


def random_spans(text: str, base: list[tuple[str, int, int]], ranks_path: str | None = None, coverage: float = COVERAGE) -> list[tuple[str, int, int]]:
    out, starts, reach = [], sorted(a for _, a, _ in base), 0
    ends = []  # the furthest end of the base spans up to each start
    for _, _, b in sorted(base, key=lambda s: s[1]):
        ends.append(reach := max(reach, b))
    for m in RUN.finditer(text):
        run, before = m[0], bisect_left(starts, m.end())
        if before and ends[before - 1] > m.start() or not (alphabet := alphabet_of(run)):
            continue
        if DIGEST.fullmatch(run) and (not re.fullmatch("[0-9A-Fa-f]+", run) or len(run) in DIGEST_LENGTHS):
            continue
        words = WORD.findall(run) if IDENTIFIER.fullmatch(run) else ()
        if words and not _compresses_badly(alphabet_of("".join(words)), words, ranks_path, coverage):
            continue
        if _compresses_badly(alphabet, (run,), ranks_path, coverage):
            out.append(("random", m.start(), m.end()))
    return out


def spans_of(text: str, ranks_path: str | None = None, coverage: float = COVERAGE) -> list[tuple[str, int, int]]:
    """All spans by start, then kind as listed."""
    base = base_spans(text)
    return sorted(base + random_spans(text, base, ranks_path, coverage), key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def find_secrets(docs: DataFrame, ranks_path: str | None = None, coverage: float = COVERAGE) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, n_random, base_sha256, spans for each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = [spans_of(t, ranks_path, coverage) for t in strings(batch.column("text"))]
            base = [[s for s in spans if s[0] != "random"] for spans in found]
            counts = {f"n_{k}": pa.array([sum(s[0] == k for s in spans) for spans in found], pa.int64()) for k in KINDS}
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id")} | counts | {"base_sha256": pa.array([hashlib.sha256(joined(b).encode()).hexdigest() for b in base], pa.string()), "spans": pa.array([joined(s) for s in found], pa.string())})

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_assign long, n_access long, n_hex long, n_random long, base_sha256 string, spans string")


def redact_secrets(docs: DataFrame, ranks_path: str | None = None, coverage: float = COVERAGE, mark: str = "<SECRET>") -> DataFrame:
    """The documents with every span replaced; spans that overlap are replaced as one."""
    columns = docs.schema

    def masked(text: str) -> str:
        out, at = [], 0
        for _, a, b in spans_of(text, ranks_path, coverage):
            if a >= at:
                out += [text[at:a], mark]
            at = max(at, b)
        return "".join([*out, text[at:]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            at = batch.schema.get_field_index("text")
            texts = [None if t is None else masked(t) for t in batch.column(at).to_pylist()]
            yield batch.set_column(at, batch.schema.field(at), pa.array(texts, batch.schema.field(at).type))

    return docs.mapInArrow(run, columns)
