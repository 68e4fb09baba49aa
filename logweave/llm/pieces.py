"""Encoding and decoding with a SentencePiece vocabulary, over words in a shared-prefix order.

A text is marked (a space becomes the mark, one is put in front) and cut before
each run of marks and around characters the vocabulary lacks: no piece crosses these
cuts. New distinct words are sorted, which lays them out as a trie in
depth-first order, and traversed with one stack of forward states, of which a
word reuses those of the prefix it shares with the one before.

For a unigram vocabulary the state of a prefix is its Viterbi score and last
piece. For a merge vocabulary, scores are merge ranks and the path of the
largest sum is not the merge result; there the state of a prefix is the last
piece of its merge result, the one piece whose predecessor state it can
follow, that is, which merging the two together leaves as they are. A pair is tried
once and remembered.
"""

from __future__ import annotations

import heapq
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logweave.llm.common import rows_for, table
from logweave.llm.words_bpe import WordIds

MARK = "▁"


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class Vocabulary:
    """scores: piece -> score; ids: piece -> id; bytes: id of each byte; kind: unigram or merge."""

    def __init__(self, pieces: list[tuple[str, float]], byte_ids: list[int] | None, unknown: int, kind: str, ids: list[int] | None = None):
        self.scores = dict(pieces)
        self.ids = dict(zip((p for p, _ in pieces), ids if ids is not None else range(len(pieces)), strict=True))
        self.byte_ids, self.unknown, self.kind = byte_ids, unknown, kind
        self.longest = max(map(len, self.scores), default=1)
        self.alphabet = {c for p in self.scores for c in p}
        self.follow: dict[tuple[str, str], bool] = {}
        ends: dict[str, set[int]] = {}  # lengths of the pieces that end alike: by their last three characters, or all of a shorter one
        for p in self.scores:
            ends.setdefault(p[-3:], set()).add(len(p))
        self.ends = {k: sorted(v, reverse=True) for k, v in ends.items()}

    @staticmethod
    def load(path: str) -> Vocabulary:
        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        plain = [i for i in range(sp.get_piece_size()) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]
        pieces = [(sp.id_to_piece(i), sp.get_score(i)) for i in plain]
        of_byte = [sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        merges = all(s == int(s) for _, s in pieces)
        return Vocabulary(pieces, of_byte if sp.is_byte(of_byte[0]) else None, sp.unk_id(), "merge" if merges else "unigram", plain)

    def merged(self, word: str) -> list[str]:
        """The merge result: the adjacent pair of the best joint piece is joined, the leftmost of equals, until none is a piece."""
        parts = list(word)
        if len(parts) > 48:
            return self._merged_long(parts)
        while len(parts) > 1:
            best, at = None, -1
            for k in range(len(parts) - 1):
                s = self.scores.get(parts[k] + parts[k + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, k
            if best is None:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def _merged_long(self, parts: list[str]) -> list[str]:
        """The same by a queue of pairs, for runs of any length: a pair's entry is void once either side has changed."""
        n = len(parts)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        queue: list[tuple[float, int, str, str]] = []

        def offer(k: int) -> None:
            if k >= 0 and after[k] < n:
                s = self.scores.get(parts[k] + parts[after[k]])
                if s is not None:
                    heapq.heappush(queue, (-s, k, parts[k], parts[after[k]]))

        for k in range(n - 1):
            offer(k)
        while queue:
            _, k, one, two = heapq.heappop(queue)
            j = after[k]
            if parts[k] != one or j >= n or parts[j] != two:
                continue
            parts[k], parts[j], after[k] = one + two, "", after[j]
            if after[j] < n:
                before[after[j]] = k
            offer(before[k])
            offer(k)
        return [p for p in parts if p]

    def follows(self, a: str, b: str) -> bool:
        known = self.follow.get((a, b))
        if known is None:
            if len(self.follow) > 1_000_000:
                self.follow.clear()
            known = self.follow[a, b] = self.merged(a + b) == ([a, b] if a else [b])
        return known

    def segment(self, words: list[str]) -> list[list[str]]:
        """Pieces of each word, for sorted distinct words of known characters."""
        scores, longest, merge, follow = self.scores, self.longest, self.kind == "merge", self.follow
        ends, none, one = self.ends.get, [], [1]
        best, start = [0.0], [0]  # by prefix length: forward score, where its last piece begins
        last: list[str] = [""]
        out, before = [], ""
        for word in words:
            n, common = len(word), 0
            top = min(n, len(before))
            while common < top and word[common] == before[common]:
                common += 1
            del best[common + 1 :], start[common + 1 :], last[common + 1 :]
            for end in range(common + 1, n + 1):
                low = end - longest if end > longest else 0
                if merge:
                    tails = ends(word[end - 3 : end], none) + ends(word[end - 2 : end], none) if end > 2 else ends(word[:end], none) if end == 2 else none
                    for n_ in tails + one:
                        i = end - n_
                        piece = word[i:end] if i >= 0 else ""
                        if piece in scores:
                            if i:
                                ok = follow.get((last[i], piece))
                                if not (self.follows(last[i], piece) if ok is None else ok):
                                    continue
                            elif len(piece) > 1 and not self.follows("", piece):
                                continue
                            start.append(i)
                            last.append(piece)
                            break
                    else:
                        raise ValueError(f"no piece ends {word[:end]!r}")
                    best.append(0.0)
                else:
                    found, where = None, end - 1
                    for i in range(low, end):
                        s = scores.get(word[i:end])
                        if s is not None and (found is None or best[i] + s > found):
                            found, where = best[i] + s, i
                    best.append(found if found is not None else best[end - 1] - 1e9)
                    start.append(where)
                    last.append(word[where:end])
            parts, end = [], n
            while end:
                parts.append(word[start[end] : end])
                end = start[end]
            out.append(parts[::-1])
            before = word
        return out


class PieceIds(WordIds):
    """ids() of texts through a bounded memory of words."""

    def __init__(self, vocabulary: Vocabulary, limit: int = 700_000):
        self.vocabulary, self.limit = vocabulary, limit
        known = "".join(sorted(re.escape(c) for c in vocabulary.alphabet if c != MARK))
        self.cut = re.compile(f"{MARK}*[{known}]+|{MARK}+|.", re.DOTALL)
        self.bytes_of = {k: bytes([b]) for b, k in enumerate(vocabulary.byte_ids or [])} | {i: p.encode() for p, i in vocabulary.ids.items()}
        self.bytes_of[vocabulary.unknown] = " ⁇ ".encode()
        self._clear()

    def _units(self, text: str) -> list[str]:
        return self.cut.findall(MARK + text.replace(" ", MARK))

    def _encode_all(self, units: list[str]) -> list[list[int]]:
        v = self.vocabulary
        plain = sorted(u for u in units if not u.startswith(MARK * 2) and v.alphabet.issuperset(u))
        found = dict(zip(plain, v.segment(plain), strict=True))
        out = []
        for unit in units:
            parts = found.get(unit)
            if parts is None:
                if v.alphabet.issuperset(unit):  # several marks in a row: pieces of equal rank
                    parts = v.merged(unit) if v.kind == "merge" else v.segment([unit])[0]
                else:
                    parts = [unit]
            ids: list[int] = []
            for p in parts:
                k = v.ids.get(p)
                if k is not None:
                    ids.append(k)
                elif v.byte_ids:
                    ids += [v.byte_ids[b] for b in p.encode()]
                else:
                    ids.append(v.unknown)
            out.append(ids)
        return out

    def all_ids(self, texts: list[bytes | None]) -> list[np.ndarray]:
        """ids of many texts: their new words are sorted together, so that they share most prefixes."""
        if self.full:
            self._clear()
        number = self.index.__getitem__
        at = [np.array(list(map(number, self._units(t.decode("utf-8", "replace")))) if t else [], np.int64) for t in texts]
        if self.index.fresh:
            self._learn()
            self.full = len(self.index) > self.limit
        out = []
        for k in at:
            size = self.length[k]
            ends = np.cumsum(size)
            out.append(self.flat[np.arange(int(size.sum())) + np.repeat(self.start[k] - (ends - size), size)])
        return out

    def each(self, texts: list[bytes | None], together: int = 1000) -> Iterator[np.ndarray]:
        for k in range(0, len(texts), together):
            yield from self.all_ids(texts[k : k + together])

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids: bytes joined where they stand, marks as spaces, the one put in front taken off."""
        text = b"".join(map(self.bytes_of.__getitem__, ids.tolist())).decode("utf-8", "replace").replace(MARK, " ")
        return text[1:] if text.startswith(" ") else text


_memory: dict[str, PieceIds] = {}


def _ids_for(model: str) -> PieceIds:
    return _memory.get(model) or _memory.setdefault(model, PieceIds(Vocabulary.load(model)))


def encode(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids) for every row; a null or empty text has no ids. Other columns are left out; repeated rows are encoded each.

    Very long texts and runs of spaces take time in proportion, but for a logarithm. An empty table gives no rows.
    """
    rows = rows_for(docs, id=id_col, text=text_col).withColumn("text", F.col("text").cast("binary"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _ids_for(model)
        for batch in batches:
            ids = [x.astype(np.int32) for x in words.each(batch.column("text").to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(ids, pa.list_(pa.int32()))], ["id", "ids"])

    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, ids array<int>").withColumnRenamed("id", id_col)


def decode(rows: DataFrame, model: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id, text) for every row of ids; null ids give an empty text, an empty table no rows.

    Decoding gives the encoded text back, but for the mark character itself, which comes back as a space,
    and for bytes that were no UTF-8 or characters that the vocabulary lacks where it has no byte pieces.
    """
    rows = rows_for(rows, id=id_col, ids=ids_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _ids_for(model)
        for batch in batches:
            texts = [words.decode(np.array(x or [], np.int64)) for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(texts, pa.string())], ["id", "text"])

    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, text string").withColumnRenamed("id", id_col)


def digests(docs: DataFrame, model: str) -> DataFrame:
    """doc_id, n_ids, ids_crc32 (little-endian 32-bit ids), round_trip (decoding gives the text back; null: empty)."""
    rows = rows_for(docs, id="doc_id", text="text").withColumn("text", F.col("text").cast("binary"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _ids_for(model)
        for batch in batches:
            n, crc, same = [], [], []
            texts = batch.column("text").to_pylist()
            for text, ids in zip(texts, words.each(texts), strict=True):
                n.append(len(ids))
                crc.append(zlib.crc32(ids.astype("<u4").tobytes()))
                same.append(words.decode(ids).encode() == (text or b""))
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(n, pa.int64()), pa.array(crc, pa.int64()), pa.array(same)], ["id", "n_ids", "ids_crc32", "round_trip"])

    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"id {kind}, n_ids bigint, ids_crc32 bigint, round_trip boolean").withColumnRenamed("id", "doc_id")


def query(spark, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"), default_model())
