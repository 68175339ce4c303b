"""Exact BPE ids with each distinct pre-token encoded once per Python worker.

BPE merges never cross pre-tokens, so a text's ids are the ids of its pre-tokens in a row. Texts are split here by the
pattern that the tokenizer file names; texts with characters for which that split isn't plain, or with a special
token's opening, go to the tokenizers library whole.
"""

from __future__ import annotations

import json
import os
import re
from array import array
from functools import cached_property

import numpy as np

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

_L = "A-Za-zÀ-ÖØ-öø-ſ"
#: Any character outside printable ASCII, ASCII white space and Latin letters up to U+017F.
_UNSURE = re.compile(f"[^\t-\r -~{_L}]")
_BYTE = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{_L}]+| ?[0-9]+| ?[^\s{_L}0-9]+|\s+(?!\S)|\s+")
_WORD = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{_L}]+|[0-9]|[^\s{_L}0-9]+")
_LOADED: dict[str, Encoder] = {}
#: Byte-level BPE writes each byte as a printable character: itself, or the next one from U+0100 on.
_PRINTED = [*range(33, 127), *range(161, 173), *range(174, 256)]
_MAPPED = dict(zip([b for b in range(256) if b not in _PRINTED], range(256, 512), strict=False))


class _Ranked(dict):
    """Ids by pre-token for a vocabulary whose ids are the order of its merges: the same merges in tiktoken's core."""

    #: Distinct pre-tokens kept in a worker before it starts afresh (some 80 MB).
    most = 400_000

    def __init__(self, ranks: dict[bytes, int]) -> None:
        import tiktoken

        super().__init__()
        self.merge = tiktoken.Encoding("ranked", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    def __missing__(self, w: str) -> bytes:
        self[w] = ids = array("I", self.merge(w)).tobytes()
        return ids


class _Known(dict):
    """Ids by pre-token; a new one goes through the model's own merges, without the pipeline around them."""

    most = 400_000

    def __init__(self, model) -> None:
        super().__init__()
        self.merge = model.tokenize

    def __missing__(self, w: str) -> bytes:
        rest = w[1:] if w[0] == " " else w
        plain = w.isascii() and " " not in rest and rest.isprintable()
        printed = ("Ġ" + rest if rest is not w else w) if plain else w.encode().decode("latin-1").translate(_MAPPED)
        self[w] = ids = array("I", [t.id for t in self.merge(printed)]).tobytes()
        return ids


def _ranks(spec: dict) -> dict[bytes, int] | None:
    """The vocabulary as ranked bytes, if each id but the first 256, those of bytes, is its merge's place."""
    model = spec["model"]
    merges = ["".join(m) if isinstance(m, list) else m.replace(" ", "") for m in model["merges"]]
    vocab = {t: i for t, i in model["vocab"].items() if t not in {a["content"] for a in spec["added_tokens"]}}
    if model["end_of_word_suffix"] or model["continuing_subword_prefix"] or len(vocab) != 256 + len(merges) or any(vocab.get(m) != 256 + i for i, m in enumerate(merges)):
        return None
    byte_of = {c: b for b, c in _MAPPED.items()} | {b: b for b in _PRINTED}
    return {bytes(byte_of[ord(c)] for c in t): i for t, i in vocab.items()}


class Encoder:
    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.path = path
        ranks = _ranks(spec)
        self.known = _Ranked(ranks) if ranks else _Known(self.tokenizer.model)
        self.specials = [t["content"] for t in spec["added_tokens"]]
        pre = spec["pre_tokenizer"]
        self.lower = spec["normalizer"] is not None
        self.split = None
        if pre["type"] == "ByteLevel" and pre["use_regex"] and not pre["add_prefix_space"] and not self.lower:
            self.split = _BYTE
        elif pre["type"] == "Sequence" and [n["type"] for n in (spec["normalizer"] or {}).get("normalizers", [])] == ["NFC", "Replace", "Lowercase"]:
            self.split = _WORD

    @cached_property
    def tokenizer(self):
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.path)

    @classmethod
    def of(cls, path: str) -> Encoder:
        if path not in _LOADED:
            _LOADED[path] = cls(path)
        return _LOADED[path]

    def _plain(self, text: str) -> bool:
        return self.split is not None and not _UNSURE.search(text) and not any(s in text for s in self.specials)

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers."""
        if len(self.known) > self.known.most:
            self.known.clear()
        known = self.known.__getitem__
        return [b"".join(map(known, self.split.findall(t.lower() if self.lower else t))) if self._plain(t) else np.array(self.tokenizer.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]


def small_batches(sizes, most: int = 4_000_000):
    """Slices of at most ``most`` units of size, or one row, so that memory doesn't follow the batch's rows."""
    start = total = 0
    for i, n in enumerate(sizes):
        if total and total + n > most:
            yield slice(start, i)
            start, total = i, 0
        total += n
    if start < len(sizes):
        yield slice(start, len(sizes))
