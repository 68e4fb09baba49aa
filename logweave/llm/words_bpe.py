"""Token ids of a word-level BPE with word ends, through a bounded memory of pieces.

The vocabulary's split rule drops white space and cuts a lower-cased text into
pieces before any merge, so ids of a text are those of its pieces in order. Texts of
printable Latin-1 are cut here, and a piece goes through a rank table once (its
last byte is followed by 0xFF, which UTF-8 never holds, and the first merges
join it to that byte). Words with other characters go through the tokenizer itself.
"""

from __future__ import annotations

import json
import re

import numpy as np
import tiktoken
from tokenizers import Tokenizer

#: The vocabulary's own split rule (fixed values), with its letters and numbers as far as lower-case Latin-1 has them.
_PIECES = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zªµºß-öø-ÿ]+|[0-9²³¹¼-¾]|[^\sa-zªµºß-öø-ÿ0-9²³¹¼-¾]+")
_PLAIN = re.compile(r"[\t-\r !-~¡-¬®-ÿ]*")
_END = b"\xff"


def _unicode_of_bytes() -> dict[str, int]:
    """The byte-level alphabet: printable bytes stand for themselves, the others follow from U+0100."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    table = {chr(b): b for b in shown}
    for k, b in enumerate(b for b in range(256) if b not in table.values()):
        table[chr(256 + k)] = b
    return table


class _Index(dict):
    """piece -> its number; a new piece gets the next one and waits in `fresh`."""

    def __init__(self):
        super().__init__()
        self.fresh: list[str] = []

    def __missing__(self, unit: str) -> int:
        number = self[unit] = len(self)
        self.fresh.append(unit)
        return number


class WordIds:
    """ids() of texts; `limit` distinct pieces are remembered."""

    def __init__(self, path: str, limit: int = 700_000):
        self.whole = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as file:
            model = json.load(file)
        added = [x["content"] for x in model["added_tokens"]]
        vocab, merges, suffix = model["model"]["vocab"], model["model"]["merges"], model["model"]["end_of_word_suffix"]
        alphabet = _unicode_of_bytes()

        def raw(token: str) -> bytes:
            end = token.endswith(suffix)
            return bytes(alphabet[c] for c in (token[: -len(suffix)] if end else token)) + _END * end

        ranks = {bytes([b]): b for b in range(256)}
        for b in range(255):
            ranks[bytes([b]) + _END] = 256 + b
        self.to_id: list[int | None] = [None] * (512 + len(merges))
        for k, pair in enumerate(merges):
            left, right = pair.split(" ") if isinstance(pair, str) else pair
            ranks.setdefault(raw(left) + raw(right), 512 + k)
        for token, number in vocab.items():
            if token not in added and (rank := ranks.get(raw(token))) is not None:
                self.to_id[rank] = number
        self.pieces = tiktoken.Encoding("words", pat_str=r"\S+", mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_single_piece
        self.added, self.limit = tuple(added), limit
        self._clear()

    def _clear(self) -> None:
        self.index, self.full = _Index(), False
        self.flat, self.used = np.empty(1 << 16, np.uint32), 0
        self.start = np.empty(1 << 15, np.int64)
        self.length = np.empty(1 << 15, np.int64)

    def _units(self, text: str) -> list[str]:
        """The pieces of a plain text; else its words, those that aren't plain marked by a space."""
        if _PLAIN.fullmatch(text) and not any(x in text for x in self.added):
            return _PIECES.findall(text.lower())
        out: list[str] = []
        for word in text.encode("utf-8", "replace").split():
            shown = word.decode("utf-8", "replace")
            if _PLAIN.fullmatch(shown) and not any(x in shown for x in self.added):
                out += _PIECES.findall(shown.lower())
            else:
                out.append(" " + shown)
        return out

    def _encode(self, unit: str) -> list[int]:
        if unit[0] == " ":
            return self.whole.encode(unit[1:], add_special_tokens=False).ids
        out = [self.to_id[k] for k in self.pieces(unit.encode() + _END)]
        return out if None not in out else self.whole.encode(unit, add_special_tokens=False).ids

    def _encode_all(self, units: list[str]) -> list[list[int]]:
        return list(map(self._encode, units))

    def _learn(self) -> None:
        """Encode the pieces that the index has just numbered."""
        units, self.index.fresh = self.index.fresh, []
        fresh = self._encode_all(units)
        n, more = len(self.index) - len(units), sum(map(len, fresh))
        if self.used + more > len(self.flat):
            self.flat = np.concatenate([self.flat[: self.used], np.empty(max(len(self.flat), 2 * more), np.uint32)])
        if n + len(units) > len(self.start):
            grow = np.empty(max(len(self.start), 2 * len(units)), np.int64)
            self.start, self.length = np.concatenate([self.start[:n], grow]), np.concatenate([self.length[:n], grow])
        size = np.fromiter(map(len, fresh), np.int64, len(fresh))
        self.start[n : n + len(units)] = self.used + np.cumsum(size) - size
        self.length[n : n + len(units)] = size
        self.flat[self.used : self.used + more] = [x for ids in fresh for x in ids]
        self.used += more

    def ids(self, text: bytes | None, *, end: int | None = None) -> np.ndarray:
        """uint32 ids of a whole text, followed by `end`; a null text is empty."""
        if self.full:
            self._clear()
        units = self._units(text.decode("utf-8", "replace")) if text else []
        at = list(map(self.index.__getitem__, units))
        if self.index.fresh:
            self._learn()
            if len(self.index) > self.limit:
                self.full = True
        at = np.array(at, np.int64)
        size = self.length[at]
        total = int(size.sum())
        out = np.empty(total + (end is not None), np.uint32)
        if total:
            ends = np.cumsum(size)
            out[:total] = self.flat[np.arange(total) + np.repeat(self.start[at] - (ends - size), size)]
        if end is not None:
            out[-1] = end
        return out
