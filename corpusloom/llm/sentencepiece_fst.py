"""SentencePiece encoding and decoding as a weighted finite-state transducer.

Three machines are compiled from the model file and composed with each input:

- the normaliser: a rewriting machine of the model's character map (the longest entry at a place is written as its
  replacement), then space to the word mark and one mark before the text;
- the pieces: states are beginnings of pieces, arcs are letters, a final state writes the piece's id and weighs minus its score;
- the byte fallback, which gives a letter that no piece covers one arc for each of its UTF-8 bytes.

The composition's states are the positions of the input. An arc leads from where a piece begins to where it ends, and the
encoding is the shortest path in the tropical semiring: positions are relaxed from left to right. In a unigram model
an arc's weight is that of its final state. In a merge (BPE) model the order of merges decides, not a sum of scores, so the
piece machine is composed with one more acceptor whose states are pieces: the arc from piece a to piece b
weighs 0 if the merges, applied to the letters of a and b alone, end in exactly a and b, and is absent
(weight infinity) otherwise. A sequence of pieces is what the merges make of a text exactly if all its
neighbours are such pairs, so that the only path of finite weight is the library's own encoding; a position that is reached
needs no further arcs.

No piece spans two adjacent letters that no piece holds side by side; inputs are cut there, and encoded
parts are kept in a bounded table of each worker. Models with user-defined pieces, or that mark words at their end, are refused.

Defined results: a null or empty text has no pieces and comes back empty; repeated rows are all
returned; an empty table gives an empty result; further columns are kept by encode() and ignored by
round_trip(). A text that holds the word mark itself comes back with spaces (the library does the same).
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import ready_workers, released

MARK = "▁"
KEPT_PARTS, KEPT_BESIDE = 600_000, 200_000
#: Kinds of pieces in a model file (fixed values of its format).
NORMAL, UNKNOWN, CONTROL, USER, BYTE, UNUSED = 1, 2, 3, 4, 6, 5
UNIGRAM, BPE = 1, 2

_machines: dict[str, "Transducer"] = {}


def character_map(blob: bytes) -> dict[str, str]:
    """The entries of a model's character map: a double-array trie of UTF-8 keys (fixed format of public model files:
    size of the trie, its units, then the replacements, each ended by a zero)."""
    if not blob:
        return {}
    size = int.from_bytes(blob[:4], "little")
    units, texts = np.frombuffer(blob, "<u4", size // 4, 4).astype(np.int64), blob[4 + size :]
    letters, found = np.arange(1, 256), {}
    offset = lambda u: (u >> 10) << ((u & 512) >> 6)
    open_ = [(b"", int(offset(units[0])))]
    while open_:
        key, base = open_.pop()
        at = base ^ letters
        at, label = at[at < len(units)], letters[at < len(units)]
        fits = (units[at] & 0x800000FF) == label
        for place, letter in zip(at[fits].tolist(), label[fits].tolist()):
            unit, longer = int(units[place]), key + bytes([letter])
            below = place ^ offset(unit)
            if unit >> 8 & 1:
                start = int(units[below]) & 0x7FFFFFFF
                found[longer.decode("utf-8", "replace")] = texts[start : texts.index(0, start)].decode("utf-8", "replace")
            open_.append((longer, below))
    return found


def trie(words) -> dict:
    """States and arcs of a machine that reads words: a state is a table of arcs; under the empty letter it names the word."""
    root: dict = {}
    for word in words:
        state = root
        for letter in word:
            state = state.setdefault(letter, {})
        state[""] = word
    return root


class Normaliser:
    """What a model does to a text before it looks for pieces."""

    def __init__(self, spec):
        self.map = character_map(spec.precompiled_charsmap)
        self.start, self.firsts = trie(self.map), {k[0] for k in self.map}
        self.prefix, self.trims = spec.add_dummy_prefix, spec.remove_extra_whitespaces

    def rewritten(self, text: str) -> str:
        if not self.map or self.firsts.isdisjoint(text):
            return text
        out, at, n = [], 0, len(text)
        while at < n:
            state, k, longest = self.start, at, None
            while k < n and (state := state.get(text[k])) is not None:
                k += 1
                if "" in state:
                    longest = state[""]
            out.append(text[at] if longest is None else self.map[longest])
            at += 1 if longest is None else len(longest)
        return "".join(out)

    def __call__(self, text: str) -> str:
        text = self.rewritten(text)
        if self.trims:
            text = " ".join(x for x in text.split(" ") if x)
        return (MARK if self.prefix and text else "") + text.replace(" ", MARK)


class Transducer:
    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2

        model = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        if model.trainer_spec.treat_whitespace_as_suffix or not model.normalizer_spec.escape_whitespaces or any(p.type == USER for p in model.pieces):
            raise ValueError("only models that mark words at their start and have no user-defined pieces")
        self.normalised, self.kind = Normaliser(model.normalizer_spec), model.trainer_spec.model_type
        if self.kind not in (UNIGRAM, BPE):
            raise ValueError("only unigram and BPE models")
        self.prefix = model.normalizer_spec.add_dummy_prefix
        self.plain = self.prefix and not self.normalised.trims and not self.normalised.map
        self.ids = {p.piece: i for i, p in enumerate(model.pieces) if p.type == NORMAL}
        self.score = {p.piece: p.score for p in model.pieces if p.type == NORMAL}
        self.bytes = {int(p.piece[3:-1], 16): i for i, p in enumerate(model.pieces) if p.type == BYTE}
        self.unknown = next((i for i, p in enumerate(model.pieces) if p.type == UNKNOWN), 0)
        self.start = trie(self.ids)
        self.unknown_weight = 10.0 - min(self.score.values(), default=0.0)
        self.together = {p[k : k + 2] for p in self.ids for k in range(len(p) - 1)}
        self.pairs: dict[tuple[str, str], bool] = {}
        self.parts: dict[str, bytes] = {}
        self.words: dict[str, bytes] = {}
        self.output = [b""] * len(model.pieces)
        for i, p in enumerate(model.pieces):
            if p.type == NORMAL:
                self.output[i] = p.piece.replace(MARK, " ").encode()
            elif p.type == BYTE:
                self.output[i] = bytes([int(p.piece[3:-1], 16)])
            elif p.type == UNKNOWN:
                self.output[i] = " ⁇ ".encode()

    # the acceptor of neighbours

    def merged(self, letters: str) -> list[str]:
        """What merging in order of score, then from the left, makes of a few letters."""
        parts, none = list(letters), float("-inf")
        score = self.score.get
        gains = [score(a + b, none) for a, b in zip(parts, parts[1:])]
        while gains and (best := max(gains)) > none:
            k = gains.index(best)
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
            del gains[k]
            if k:
                gains[k - 1] = score(parts[k - 1] + parts[k], none)
            if k < len(gains):
                gains[k] = score(parts[k] + parts[k + 1], none)
        return parts

    def joined(self, a: str, b: str) -> float:
        """Weight of the arc from piece a to piece b; a is empty at the start."""
        pair = (a, b)
        if (fits := self.pairs.get(pair)) is None:
            if len(self.pairs) > 500_000:
                self.pairs.clear()
            fits = self.pairs[pair] = a + b not in self.score and self.merged(a + b) == [a, b] if a else self.merged(b) == [b]
        return fits

    # shortest paths

    def path(self, part: str) -> list[str]:
        """Labels of the shortest path through a part of an input: pieces, and letters that go to the fallback."""
        n, start, infinite = len(part), self.start, float("inf")
        weight, back = [0.0] + [infinite] * n, [""] * (n + 1)
        if self.kind == BPE:
            pairs, joined = self.pairs, self.joined
            for begin in range(n):
                if weight[begin] == infinite:  # no pair of pieces leads here: the letter by itself
                    weight[begin], back[begin] = weight[begin - 1], part[begin - 1]
                state, last = start, back[begin]
                for end in range(begin, n):
                    state = state.get(part[end])
                    if state is None:
                        break
                    if "" in state and weight[end + 1] == infinite:
                        pair = (last, state[""])
                        if pairs[pair] if pair in pairs else joined(*pair):
                            weight[end + 1], back[end + 1] = weight[begin], pair[1]
            if weight[n] == infinite:
                back[n] = part[n - 1]
        else:
            score, unknown = self.score, self.unknown_weight
            for begin in range(n):
                state, here = start, weight[begin]
                for end in range(begin, n):
                    state = state.get(part[end])
                    if state is None:
                        break
                    if "" in state and (w := here - score[state[""]]) < weight[end + 1]:
                        weight[end + 1], back[end + 1] = w, state[""]
                if part[begin] not in score and here + unknown < weight[begin + 1]:
                    weight[begin + 1], back[begin + 1] = here + unknown, part[begin]
        out, at = [], n
        while at:
            out.append(back[at])
            at -= len(back[at])
        return out[::-1]

    def fallback(self, letter: str) -> list[int]:
        return [self.bytes[b] for b in letter.encode("utf-8", "surrogatepass")] if self.bytes else [self.unknown]

    def part_ids(self, part: str) -> bytes:
        if (found := self.parts.get(part)) is None:
            ids: list[int] = []
            for piece in self.path(part):
                i = self.ids.get(piece)
                ids.extend(self.fallback(piece) if i is None else [i])
            found = np.array(ids, "<u4").tobytes()
            if len(part) <= 64:
                if len(self.parts) > self.kept:
                    self.parts.clear()
                self.parts[part] = found
        return found

    def segment(self, text: str) -> bytes:
        """Ids of a normalised input. Without a byte fallback unknown letters side by side are one unknown piece."""
        ids = self.cut(text)
        if self.bytes:
            return ids
        numbers = np.frombuffer(ids, "<u4")
        unknown = numbers == self.unknown
        return numbers[~(unknown & np.concatenate([[False], unknown[:-1]]))].tobytes() if unknown.any() else ids

    def cut(self, text: str) -> bytes:
        """A normalised input cut where no piece can lie, part by part."""
        together, cuts = self.together, [0]
        for k in range(1, len(text)):
            if text[k - 1 : k + 1] not in together:
                cuts.append(k)
        if len(cuts) == 1:
            return self.part_ids(text)
        cuts.append(len(text))
        return b"".join([self.part_ids(text[a:b]) for a, b in zip(cuts, cuts[1:])])

    def encode(self, text: str) -> bytes:
        """Ids as little-endian 32-bit integers."""
        if not text:
            return b""
        if "  " in text or MARK in text or not self.plain or self.kind != BPE or not self.bytes or text[0] == " " or text[-1] == " ":
            return self.segment(self.normalised(text))
        words, out = self.words, []
        for word in text.split(" "):
            if (ids := words.get(word)) is None:
                ids = self.segment(MARK + word)
                if len(word) <= 64:
                    if len(words) > self.kept:
                        words.clear()
                    words[word] = ids
            out.append(ids)
        return b"".join(out)

    def decode(self, ids: bytes) -> str:
        """The inverse machine."""
        data = b"".join(map(self.output.__getitem__, np.frombuffer(ids, "<u4").tolist()))
        text = data.decode("utf-8", "replace")
        return text[1:] if self.prefix and text[:1] == " " else text


    kept = KEPT_PARTS

    def forget(self) -> None:
        """Parts and words that are kept go: a worker has other stages to run."""
        self.parts.clear()
        self.words.clear()
        released()


def machine(path: str) -> Transducer:
    """Compiled once for each worker process."""
    if path not in _machines:
        _machines[path] = Transducer(path)
    return _machines[path]


def encode(docs: DataFrame, model: str, text: str = "text", to: str = "piece_ids") -> DataFrame:
    """docs with one more column, the ids of each text (array of int)."""
    ready_workers(docs.sparkSession)

    @F.pandas_udf("array<int>")
    def ids(texts):
        m = machine(model)
        return texts.map(lambda t: np.frombuffer(m.encode(t or ""), "<u4").astype(np.int32))

    return docs.withColumn(to, ids(F.col(text)))


def decode(rows: DataFrame, model: str, ids: str = "piece_ids", to: str = "text") -> DataFrame:
    """rows with one more column, the text of each array of ids."""
    ready_workers(rows.sparkSession)

    @F.pandas_udf("string")
    def texts(arrays):
        m = machine(model)
        return arrays.map(lambda a: "" if a is None else m.decode(np.asarray(a, "<u4").tobytes()))

    return rows.withColumn(to, texts(F.col(ids)))


def encoded(docs: DataFrame, model: str) -> DataFrame:
    """doc_id, source, n_pieces, piece_ids and decoded_same (whether decoding gives the text back) of each row."""
    ready_workers(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = machine(model)
        m.kept = KEPT_BESIDE
        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            ids = [m.encode(t) for t in texts]
            same = [m.decode(i) == t for i, t in zip(ids, texts)]
            n = np.array([len(i) // 4 for i in ids], np.int64)
            ends = pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32))
            numbers = pa.array(np.frombuffer(b"".join(ids), "<i4"))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("source"), pa.array(n), pa.ListArray.from_arrays(ends, numbers), pa.array(same, pa.bool_())],
                names=["doc_id", "source", "n_pieces", "piece_ids", "decoded_same"],
            )
        m.forget()
        m.kept = KEPT_PARTS

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "source", "text")
    return rows.mapInArrow(run, "doc_id long, source string, n_pieces long, piece_ids array<int>, decoded_same boolean")


_SCHEMA = "doc_id long, n_pieces long, n_byte_pieces long, ids_crc32 long, decoded_crc32 long, decoded_same boolean"


def round_trip(docs: DataFrame, model: str) -> DataFrame:
    """Encode every whole text and decode it again: doc_id, n_pieces, n_byte_pieces, crc32 of the ids (as
    little-endian unsigned 32-bit integers) and of the decoded text's UTF-8, and whether that equals the text."""
    ready_workers(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = machine(model)
        low, high = (min(m.bytes.values()), max(m.bytes.values())) if m.bytes else (1, 0)
        for batch in batches:
            cols: list[list] = [[], [], [], [], []]
            for text in batch.column("text").to_pylist():
                text = text or ""
                ids = m.encode(text)
                numbers = np.frombuffer(ids, "<u4")
                decoded = m.decode(ids)
                row = len(numbers), int(np.count_nonzero((numbers >= low) & (numbers <= high))), zlib.crc32(ids), zlib.crc32(decoded.encode()), decoded == text
                for c, x in zip(cols, row):
                    c.append(x)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *(pa.array(c, pa.int64()) for c in cols[:4]), pa.array(cols[4], pa.bool_())],
                names=["doc_id", "n_pieces", "n_byte_pieces", "ids_crc32", "decoded_crc32", "decoded_same"],
            )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, _SCHEMA)
