"""Vocabularies of public tokenizers, opened once in each process."""

from __future__ import annotations

import base64
import json
from functools import lru_cache

import public_tokenizers
import regex
import tiktoken

RANKS, TOKENIZER = "byte_bpe_50k.tiktoken", "byte_bpe_50k.json"


@lru_cache(maxsize=4)
def ranks(name: str = RANKS) -> dict[bytes, int]:
    with open(public_tokenizers.path(name), "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


@lru_cache(maxsize=4)
def encoding(name: str = RANKS) -> tiktoken.Encoding:
    return tiktoken.Encoding("millrace", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks(name), special_tokens={})


#: White space in one run from which texts are matched otherwise: tiktoken's matcher keeps a state for each character of a run and fails at a million.
LONG_RUN = 500_000

_PATTERN, _SPACE = regex.compile(public_tokenizers.PATTERN), regex.compile(r"\s+")


@lru_cache(maxsize=4)
def added(name: str = TOKENIZER) -> tuple[regex.Pattern, dict[str, int]]:
    """Added tokens of a tokenizers file, which stand for themselves in any text, and their ids."""
    with open(public_tokenizers.path(name), "rb") as lines:
        tokens = json.load(lines)["added_tokens"]
    if any(t["single_word"] or t["lstrip"] or t["rstrip"] for t in tokens):
        raise ValueError(f"{name}: added tokens that depend on what stands beside them")
    ids = {t["content"]: t["id"] for t in tokens}
    return regex.compile("|".join(map(regex.escape, sorted(ids, key=len, reverse=True))) or r"(?!)"), ids


def ids_of(text: str, name: str = RANKS, added_name: str = TOKENIZER) -> list[int]:
    """Ids of a whole text of any kind, those of the ``tokenizers`` file: added tokens are cut out first, the rest is encoded."""
    pattern, own = added(added_name)
    out, at = [], 0
    for m in pattern.finditer(text):
        out += [*_ids_between(text[at : m.start()], name), own[m[0]]]
        at = m.end()
    return out + _ids_between(text[at:], name) if at else _ids_between(text, name)


def _ids_between(text: str, name: str) -> list[int]:
    """Those of ``encode_ordinary`` wherever that does not fail."""
    own = encoding(name)
    if len(text) < LONG_RUN or all(m.end() - m.start() < LONG_RUN for m in _SPACE.finditer(text)):
        return own.encode_ordinary(text)
    return [token for m in _PATTERN.finditer(text) for token in own._encode_single_piece(m[0].encode())]


@lru_cache(maxsize=4)
def tokenizer(name: str = TOKENIZER):
    from tokenizers import Tokenizer

    made = Tokenizer.from_file(public_tokenizers.path(name))
    made.encode_special_tokens = True
    return made
