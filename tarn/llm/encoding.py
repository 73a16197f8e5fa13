"""Exact, fast encoding with the tokenizers library.

A tokenizer spends its time on words that come again and again.  For the two kinds of tokenizer below, a
text of common characters (Latin letters, digits, the usual punctuation) is cut into the tokenizer's own
pre-tokens here, each different pre-token is merged once by the library's model, and its ids are
remembered up to a bound.  Texts with other characters, and tokenizers of other kinds, go to the library
whole.  The ids are the same either way; tests compare them.
"""

from __future__ import annotations

import gc
import json
import os
import re

import numpy as np

from .common import FORGET

_LETTERS = "A-Za-zÀ-ÖØ-öø-įı-ſ"
_SIGNS = "¡-©«¬®-±´¶-¸»¿×÷‐-‧‰-⁞€"
_OTHER = re.compile(rf"[^\t\n\r\x20-\x7E{_LETTERS}{_SIGNS}]")
_ENDINGS = "'s|'t|'re|'ve|'m|'ll|'d"
_CUTS = {
    "byte": re.compile(rf"{_ENDINGS}| ?[{_LETTERS}]+| ?[0-9]+| ?[^\s0-9{_LETTERS}]+|\s+(?!\S)|\s+"),
    "word": re.compile(rf"{_ENDINGS}|[{_LETTERS}]+|[0-9]|[^\s0-9{_LETTERS}]+"),
}


def default_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def rule_of(path: str) -> str:
    """'byte', 'word' or 'whole': where texts may be cut without changing the ids."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    pre, norm = spec.get("pre_tokenizer") or {}, spec.get("normalizer")
    if spec.get("truncation") or spec.get("padding") or spec["model"].get("type") != "BPE" or any(a["lstrip"] or a["rstrip"] or " " in a["content"] or a.get("normalized") for a in spec.get("added_tokens", [])):
        return "whole"
    if pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space") and norm is None:
        return "byte"
    steps = pre.get("pretokenizers", [])
    if pre.get("type") == "Sequence" and [s.get("type") for s in steps] == ["Split", "ByteLevel"] and not steps[1].get("use_regex") and not steps[1].get("add_prefix_space") and steps[0].get("invert") and steps[0].get("behavior") == "Removed" and "[^\\s\\p{L}\\p{N}]+" in steps[0]["pattern"].get("Regex", "") and norm and [n.get("type") for n in norm.get("normalizers", [])] == ["NFC", "Replace", "Lowercase"]:
        return "word"
    return "whole"


def _byte_letters() -> dict[int, str]:
    """Byte -> the character that stands for it in byte-level vocabularies: itself if printable, else from 256 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


class _Known(dict):
    """Pre-token -> its ids as bytes."""

    def __init__(self, model, bound: int):
        super().__init__()
        self.tokenize, self.bound = model.tokenize, bound
        self.letters = _byte_letters()
        self.space = self.letters[0x20]
        self.packed = [i.to_bytes(4, "little") for i in range(1 << 16)]

    def __missing__(self, piece: str) -> bytes:
        if piece.isascii() and piece.isprintable():
            mapped = piece.replace(" ", self.space)
        else:
            mapped = piece.encode().decode("latin-1").translate(self.letters)
        try:
            out = b"".join([self.packed[t.id] for t in self.tokenize(mapped)])
        except IndexError:
            out = np.array([t.id for t in self.tokenize(mapped)], "<u4").tobytes()
        if len(piece) < 64:
            if len(self) >= self.bound:
                self.clear()
            self[piece] = out
        return out


class Encoder:
    """``ids(texts)`` gives the ids of each text as little-endian unsigned 32-bit bytes."""

    def __init__(self, path: str, bound: int = 800_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.rule = Tokenizer.from_file(path), rule_of(path)
        added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.start = os.path.commonprefix(added)
        self.special = re.compile("|".join(map(re.escape, added)) or r"(?!)")
        self.known = _Known(self.tokenizer.model, bound)

    def ids(self, texts: list[str]) -> list[bytes]:
        cut, get, word = _CUTS.get(self.rule), self.known.__getitem__, self.rule == "word"
        out = []
        collects = gc.isenabled()
        gc.disable()  # millions of small objects without cycles
        try:
            for t in texts:
                if cut is None or self.start in t and self.special.search(t) or _OTHER.search(t):
                    out.append(np.array(self.tokenizer.encode(t, add_special_tokens=False).ids, "<u4").tobytes())
                else:
                    out.append(b"".join(map(get, cut.findall(t.lower() if word else t))))
        finally:
            if collects:
                gc.enable()
        return out


_ENCODERS: dict[str, Encoder] = {}
FORGET["encoder"] = [_ENCODERS.clear]


def encoder(path: str) -> Encoder:
    """One per worker process: the last file's."""
    if path not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]
