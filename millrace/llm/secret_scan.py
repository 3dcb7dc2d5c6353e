"""Secrets: fixed patterns, and strings that a tokenizer's vocabulary spells badly."""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_right
from collections.abc import Callable, Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.vocabulary import encoding
from millrace.llm.work import tidy
from millrace.session import ready

# Patterns of the base kinds, with the least length of a match or of its value.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
LEAST_ASSIGN, LEAST_ACCESS = 6, 20

#: Strings that the method looks at: runs of this class of this length and more.
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
#: A random string of letters and digits takes about two characters a token; words and names take three and more.
FEWEST_CHARS_A_TOKEN = 2.3
#: The same for strings of capitals or of small letters alone, as long made-up words take few characters a token too.
FEWEST_UNMIXED = 2.0
#: Digests and identifiers that are no secrets: hexadecimal digests of usual lengths, UUIDs, plain numbers and dates.
KNOWN = re.compile(
    r"(?:[0-9a-fA-F]{32}|[0-9a-fA-F]{40}|[0-9a-fA-F]{56}|[0-9a-fA-F]{64}|[0-9a-fA-F]{96}|[0-9a-fA-F]{128}"
    r"|[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}"
    r"|[0-9+/_=-]+|(?:[A-Za-z]+[/_-])+[A-Za-z]+|(.)\1*)\Z"
)

#: Parts of such a string, digests and identifiers that stand between other parts, and what a random part mixes (a first capital is no mix).
PART = re.compile(r"[A-Za-z0-9]+")
INSIDE = re.compile(
    r"(?<![A-Za-z0-9])(?:[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}"
    r"|[0-9a-fA-F]{32}|[0-9a-fA-F]{40}|[0-9a-fA-F]{56}|[0-9a-fA-F]{64}|[0-9a-fA-F]{96}|[0-9a-fA-F]{128})(?![A-Za-z0-9])"
)
PLAIN = re.compile(r"(?:[0-9]+|[A-Z]?[a-z]+|[A-Z]+)\Z")
LEAST_RANDOM = 20

Span = tuple[str, int, int]


def base_spans(text: str) -> list[Span]:
    """Matches of the fixed patterns, by start and then kind."""
    found = [("assign", *m.span()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= LEAST_ASSIGN]
    found += [("access", *m.span()) for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST_ACCESS] if "AKIA" in text else []
    found += [("hex", *m.span()) for m in HEX.finditer(text)]
    return in_order(found)


_RANK = {"assign": 0, "access": 1, "hex": 2, "random": 3}


def in_order(spans: list[Span]) -> list[Span]:
    return sorted(spans, key=lambda s: (s[1], _RANK[s[0]], s[2]))


def _mixed(own: str) -> bool:
    return bool(re.search("[0-9]", own)) + bool(re.search("[a-z]", own)) + bool(re.search("[A-Z]", own)) > 1


def _looks_random(own: str, least: float, tokens: int) -> bool:
    """A low ratio of characters to tokens, for a string that mixes digits with letters or both cases throughout."""
    return not KNOWN.match(own) and _mixed(own) and len(own) < least * tokens


def _looks_random_unmixed(own: str, least: float, tokens: int) -> bool:
    """The same for a string of one letter case."""
    return own.isalpha() and not KNOWN.match(own) and not _mixed(own) and len(own) < min(least, FEWEST_UNMIXED) * tokens


def _random_parts(own: str, least: float, ends: list[int]) -> list[tuple[int, int]]:
    """Where parts of a string look random that as a whole does not; ``ends`` are those of its tokens.

    Looked at are each part of LEAST_RANDOM characters and more, and the shortest row of
    parts of that length from each part on and up to each part.  Of a row, half the
    characters must lie in mixed parts, so that names and numbers are none.  A part
    also counts as a whole if a row of its tokens of that length looks random.
    """
    inside = [m.span() for m in INSIDE.finditer(own)]
    parts, group = [], []
    for m in PART.finditer(own):
        k = bisect_right(inside, (m.start(), len(own)))
        if k and m.start() < inside[k - 1][1]:
            continue
        parts.append(m.span())
        group.append(k)
    plain = [bool(PLAIN.match(own[a:b])) for a, b in parts]
    mixed = [0, *accumulate(0 if p else b - a for p, (a, b) in zip(plain, parts, strict=True))]
    chars = [0, *accumulate(b - a for a, b in parts)]
    rows = {(k, k) for k, (a, b) in enumerate(parts) if b - a >= LEAST_RANDOM}
    i = 0
    for j in range(len(parts)):  # up to each part
        while i < j and parts[j][1] - parts[i + 1][0] >= LEAST_RANDOM:
            i += 1
        if parts[j][1] - parts[i][0] >= LEAST_RANDOM:
            rows.add((i, j))
    j = 0
    for i in range(len(parts)):  # from each part on
        while j < len(parts) and parts[j][1] - parts[i][0] < LEAST_RANDOM:
            j += 1
        if j == len(parts):
            break
        rows.add((i, j))
    found = []
    for i, j in sorted(rows):
        a, b = parts[i][0], parts[j][1]
        if group[i] != group[j] or (i < j and 2 * (mixed[j + 1] - mixed[i]) < chars[j + 1] - chars[i]):
            continue
        first, last = bisect_right(ends, a), bisect_right(ends, b)
        part = own[a:b]
        if _looks_random(part, least, last - first) or (i == j and not KNOWN.match(part) and (_looks_random_unmixed(part, least, last - first) or _worst_row(own, least, ends, a, first, last))):
            if found and a <= found[-1][1]:
                found[-1] = (found[-1][0], max(b, found[-1][1]))
            else:
                found.append((a, b))
    return found


def _worst_row(own: str, least: float, ends: list[int], a: int, first: int, last: int) -> bool:
    """If some row of tokens ``first`` to ``last`` of LEAST_RANDOM characters looks random; the first begins at ``a``."""
    starts = [a, *ends[first : last - 1]]
    j = first
    for i in range(first, last):
        while j < last and ends[j] - starts[i - first] < LEAST_RANDOM:
            j += 1
        if j == last:
            break
        if _looks_random(own[starts[i - first] : ends[j]], least, j + 1 - i):
            return True
    return False


def random_spans(text: str, least: float = FEWEST_CHARS_A_TOKEN) -> list[Span]:
    """Strings of few characters a token, other than known digests and identifiers, and such parts of other strings."""
    found = []
    for m in CANDIDATE.finditer(text):
        tokens = encoding().encode_ordinary(m[0])
        if _looks_random(m[0], least, len(tokens)) or _looks_random_unmixed(m[0], least, len(tokens)):
            found.append(("random", *m.span()))
        elif not m[0].isalpha() or _mixed(m[0]):
            ends = list(accumulate(map(len, encoding().decode_tokens_bytes(tokens))))
            found += [("random", m.start() + a, m.start() + b) for a, b in _random_parts(m[0], least, ends)]
    return found


def joined(spans: list[Span]) -> str:
    return ",".join(f"{kind}:{a}:{b}" for kind, a, b in spans)


def _scan(least: float) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts: list[list[int]] = [[], [], []]
            digests, every = [], []
            for text in batch.column("text").to_pylist():
                base = base_spans(text or "")
                kinds = [kind for kind, _, _ in base]
                for k, kind in enumerate(("assign", "access", "hex")):
                    counts[k].append(kinds.count(kind))
                digests.append(hashlib.sha256(joined(base).encode()).hexdigest())
                every.append(joined(in_order(base + random_spans(text or "", least))))
            columns = [batch.column("doc_id"), *[pa.array(c, pa.int64()) for c in counts], pa.array(digests, pa.string()), pa.array(every, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    return run


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = FEWEST_CHARS_A_TOKEN) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans) for every row of ``docs``, without a shuffle.

    ``spans`` lists kind:start:end in code points, by start and then kind; a span of
    kind ``random`` is added where the vocabulary needs many tokens for the length, of a
    whole string or of a part between its separators.  Strings of one letter case must
    need more tokens than others.

    Null text counts as empty and has no spans.  Very long texts are scanned whole.  Null ids and repeated rows are
    reported like any other; an empty table gives an empty result; other columns
    are ignored.
    """
    ready(docs.sparkSession)
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return source.mapInArrow(tidy(_scan(least)), "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")


def redacted(text: str, mark: str = "[secret]", least: float = FEWEST_CHARS_A_TOKEN) -> str:
    """``text`` with every span replaced; overlapping spans are replaced as one."""
    out, at = [], 0
    for _, a, b in in_order(base_spans(text) + random_spans(text, least)):
        if a >= at:
            out += [text[at:a], mark]
        at = max(at, b)
    return "".join([*out, text[at:]]) if out else text


def redact(docs: DataFrame, text_col: str = "text", size_col: str = "n_chars") -> DataFrame:
    """``docs`` with secrets replaced by a mark, and ``size_col``, where there is one, counted anew for texts that changed.

    Null and empty texts stay as they are.  Null ids, repeated rows and very long texts are treated like any other; an
    empty table gives an empty one; columns keep their names, whatever they are.
    """
    ready(docs.sparkSession)
    schema, names = docs.schema, docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(text_col).to_pylist()
            clean = [None if t is None else redacted(t) for t in texts]
            columns = list(batch.columns)
            columns[names.index(text_col)] = pa.array(clean, batch.column(text_col).type)
            if size_col in names:
                k = names.index(size_col)
                sizes = [n if a == b else len(b) for n, a, b in zip(columns[k].to_pylist(), texts, clean, strict=True)]
                columns[k] = pa.array(sizes, columns[k].type)
            yield pa.RecordBatch.from_arrays(columns, names)

    return docs.select(*[F.col(f"`{c}`") for c in names]).mapInArrow(tidy(run), schema)
