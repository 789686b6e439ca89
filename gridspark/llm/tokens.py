"""Byte-level BPE token ids in bulk, with the ids of the `tokenizers` library.

A byte-level BPE file whose ids follow its merge order is loaded into `tiktoken`,
which gives the same ids several times faster; any other file, and any text that holds
the string of an added token ("<|endoftext|>", which the library gives the token's own
id), is run by the `tokenizers` library itself.  `tests/llm` compares both on whole texts.
"""

from __future__ import annotations

import functools
import json
import os
from array import array

PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def default_path(name: str = "byte_bpe_50k.json") -> str:
    """Place of a vocabulary file; a parameter everywhere, this is only its default."""
    import public_tokenizers

    return public_tokenizers.path(name)


def _byte_of() -> dict[str, int]:
    """The printable stand-in of each byte in a byte-level vocabulary, inverted."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


def _ranks(spec: dict) -> dict[bytes, int] | None:
    model = spec.get("model", {})
    kind = (spec.get("pre_tokenizer") or {}).get("type")
    if model.get("type", "BPE") != "BPE" or kind != "ByteLevel" or spec["pre_tokenizer"].get("add_prefix_space") or spec.get("normalizer"):
        return None
    vocab, byte = model["vocab"], _byte_of()
    special = set(_added(spec))
    for i, m in enumerate(model["merges"]):
        if vocab.get("".join(m.split(" ") if isinstance(m, str) else m)) != 256 + i:
            return None
    return {bytes(byte[c] for c in t): i for t, i in vocab.items() if t not in special}


def _added(spec: dict) -> list[str]:
    return [t["content"] for t in spec.get("added_tokens") or []]


def _library(path: str):
    from tokenizers import Tokenizer

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    tok = Tokenizer.from_file(path)
    return lambda text: tok.encode(text, add_special_tokens=False).ids


_open: dict[str, object] = {}


def encoder(path: str):
    """A function text -> bytes of little-endian unsigned 32-bit ids."""
    key = os.fspath(path)
    if key not in _open:
        with open(key, encoding="utf-8") as f:
            spec = json.load(f)
        ranks, added = _ranks(spec), _added(spec)
        if ranks:
            import tiktoken

            plain = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
            library = functools.cache(lambda: _library(key))  # loaded only where a text needs it
            _open[key] = lambda text: library()(text) if any(t in text for t in added) else plain(text)
        else:
            _open[key] = _library(key)
    ids = _open[key]

    def encode(text: str | None) -> bytes:
        return array("I", ids(text)).tobytes() if text else b""

    return encode
