"""What a tokenizers file says about itself: where texts may be parted, which piece an id stands for.

Texts are encoded word by word, so the rules of a file must be such that words don't touch each other. Two families
are known: word ends (composition, white space and case are evened out, the split drops white space) and byte level
(the usual split, which keeps a word's white space in front of it). Any other file raises ValueError.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: White space as regular expressions of both libraries take it, and the split of the word-end family.
WHITE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
WORD_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
BYTE_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

_WORDS, _UNITS = re.compile(f"[^{WHITE}]+"), re.compile(f"[{WHITE}]*[^{WHITE}]+|[{WHITE}]+")
_PLAIN = re.compile("[\x1c-\x1f]")  # Python parts words here, the files don't
_EDGE = re.compile(f"(?<=[^{WHITE}])(?=[{WHITE}])")

#: Characters of a text that are parted at a time.
BLOCK = 1 << 20


def visible_bytes() -> dict[str, int]:
    """The characters that stand for bytes in byte-level vocabularies: printable ones for themselves, others from 256 up."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


def blocks(text: str) -> Iterator[str]:
    """A text in parts of about ``BLOCK`` characters, cut where a word has ended and white space begins."""
    first = 0
    while len(text) - first > BLOCK and (edge := _EDGE.search(text, first + BLOCK)):
        yield text[first : edge.start()]
        first = edge.start()
    yield text[first:] if first else text


class Rules:
    """Rules and vocabulary of one tokenizers file."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            said = json.load(f)
        model, before, even = said["model"], said.get("pre_tokenizer") or {}, said.get("normalizer")
        steps = before.get("pretokenizers", [before])
        kinds = [s.get("type") for s in steps]
        last, decoder = steps[-1], (said.get("decoder") or {}).get("type")
        evens = [even] if even and even["type"] != "Sequence" else (even or {}).get("normalizers", [])
        known = {"NFC": {}, "Lowercase": {}, "Replace": {"pattern": {"Regex": r"\s+"}, "content": " "}}
        self.byte_level = kinds == ["ByteLevel"] and bool(last.get("use_regex", True)) and not evens and decoder == "ByteLevel"
        word_ends = (
            kinds == ["Split", "ByteLevel"] and steps[0]["pattern"] == {"Regex": WORD_SPLIT} and steps[0]["behavior"] == "Removed"
            and bool(steps[0]["invert"]) and not last.get("use_regex", True) and decoder is None
            and all(e["type"] in known and {k: v for k, v in e.items() if k != "type"} == known[e["type"]] for e in evens)
            and "Replace" in [e["type"] for e in evens]
        )
        plain = model["type"] == "BPE" and not model.get("dropout") and not model.get("byte_fallback") and not last.get("add_prefix_space")
        added = said.get("added_tokens", [])
        if not plain or not (self.byte_level or word_ends) or any(
            t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"] or re.search(f"[{WHITE}]", t["content"]) for t in added
        ):
            raise ValueError(f"{path}: the rules of this vocabulary are not among those that part texts into words")
        self.path, self.vocabulary, self.merges = path, model["vocab"], model["merges"]
        self.added = {t["content"]: t["id"] for t in added}
        self.size = 1 + max([*self.vocabulary.values(), *self.added.values()])
        self._tokenizer = None

    def split(self, text: str) -> list[str]:
        """The words of a text: encoded one by one, their ids make up the text's."""
        if self.byte_level:
            return _UNITS.findall(text)
        return _WORDS.findall(text) if not text.isascii() or _PLAIN.search(text) else text.split()

    def encode(self, words: list[str]) -> list[list[int]]:
        """The ids of each word, by the whole tokenizer."""
        if self._tokenizer is None:
            os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
            from tokenizers import Tokenizer

            self._tokenizer = Tokenizer.from_file(self.path)
            self._tokenizer.no_truncation()
            self._tokenizer.no_padding()
        return [e.ids for e in self._tokenizer.encode_batch_fast(words, add_special_tokens=False)]

    def pieces(self) -> pa.Array:
        """The bytes that each id decodes to, in the order of ids; null for an id that is not in use."""
        out: list[bytes | None] = [None] * self.size
        back = visible_bytes()
        for piece, i in (self.vocabulary | self.added).items():
            whole = not self.byte_level or any(c not in back for c in piece)
            out[i] = piece.encode() if whole else bytes(back[c] for c in piece)
        return pa.array(out, pa.large_binary())

    @property
    def joint(self) -> bytes:
        """What stands between decoded pieces."""
        return b"" if self.byte_level else b" "

    def ranks(self) -> dict[bytes, int]:
        """A byte-level vocabulary as bytes and ranks; raises ValueError unless ids follow the order of merges."""
        made = [self.vocabulary["".join(m if isinstance(m, list) else m.split(" "))] for m in self.merges]
        if not self.byte_level or any(a >= b for a, b in zip(made, made[1:], strict=False)):
            raise ValueError(f"{self.path}: not a byte-level vocabulary whose ids follow its merges")
        back = visible_bytes()
        return {bytes(back[c] for c in t): i for t, i in self.vocabulary.items()}


_RULES: dict[str, Rules] = {}


def rules(path: str) -> Rules:
    """The rules of a file, read once in each process."""
    if path not in _RULES:
        _RULES[path] = Rules(path)
    return _RULES[path]


def to_varints(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers below 2**28 as one to four bytes of seven bits each, low ones first; where each number's bytes end."""
    v = values.astype(np.uint32)
    size = 1 + (v >= 1 << 7).astype(np.int64) + (v >= 1 << 14) + (v >= 1 << 21)
    ends = np.cumsum(size)
    out = np.empty(int(ends[-1]) if len(ends) else 0, np.uint8)
    for k in range(4):
        has = np.flatnonzero(size > k)
        more = (size[has] > k + 1).astype(np.uint8) << np.uint8(7)
        out[ends[has] - size[has] + k] = ((v[has] >> np.uint32(7 * k)) & np.uint32(127)).astype(np.uint8) | more
    return out, ends


def from_varints(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The numbers that ``to_varints`` wrote, and where their bytes end."""
    ends = np.flatnonzero(data < 128) + 1
    begins = np.concatenate([[0], ends[:-1]]).astype(np.int64) if len(ends) else ends
    out = np.zeros(len(ends), np.uint32)
    for k in range(4):
        has = np.flatnonzero(ends - begins > k)
        out[has] |= (data[begins[has] + k] & np.uint8(127)).astype(np.uint32) << np.uint32(7 * k)
    return out, ends


def ragged(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The places of the spans [start, start + size), one after the other."""
    total = int(sizes.sum())
    return np.repeat(starts - (np.cumsum(sizes) - sizes), sizes) + np.arange(total)
