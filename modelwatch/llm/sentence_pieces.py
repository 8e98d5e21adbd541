"""SentencePiece encoding by sampling from the piece lattice, and lossless decoding.

Each word (a run of spaces and the characters that follow it) has a lattice: nodes are the places between its
characters, edges the vocabulary's pieces. Forward filtering sums the weights of all paths up to each node; backward
sampling then draws a path from the end, each edge in proportion to its share. Pieces never hold a space after another
character, so the lattice of a text is the chain of its words' lattices, and a word's sums are computed once per batch.
All words of a batch draw together, step by step. The draws are hashes of the row's key, so a row always gets the same
segmentation, on any executor and at any retry.
"""

from __future__ import annotations

import hashlib
import re
from collections import defaultdict
from collections.abc import Sequence
from itertools import count
from pathlib import Path

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from modelwatch.llm.common import mix64, packed, unpacked

DEFAULT_MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
WORD = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")
#: Stands for a literal U+2581 inside a lattice; it occurs in no valid text.
LITERAL = "\ud800"
#: Texts are taken together up to about so many characters; it bounds memory and changes no result.
CHARS_PER_ROUND = 1_200_000


class Vocabulary:
    """Pieces of a model with their weights (natural logarithms), as a trie in sorted arrays, and the byte pieces."""

    def __init__(self, model: str = DEFAULT_MODEL) -> None:
        """Read the model where the driver can see it; tasks get the pieces with their code.

        Merge-ranked models have no probabilities: a piece then weighs -log(rank + 2), the shape that frequencies have.
        """
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_proto=Path(model).read_bytes())
        n = sp.get_piece_size()
        pieces = [sp.id_to_piece(i) for i in range(n)]
        byte_ids = [i for i in range(n) if sp.is_byte(i)]
        normal = [
            i for i in range(n)
            if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))
            and SPACE not in pieces[i].lstrip(SPACE)
        ]
        scores = np.array([sp.get_score(i) for i in normal])
        if np.all(scores == np.round(scores)):
            ranks = np.empty(len(normal))
            ranks[np.lexsort((normal, -scores))] = np.arange(len(normal))
            scores = -np.log(ranks + 2)
        self.size, self.byte_first = n, byte_ids[0]
        self.weight = np.zeros(n)
        self.weight[normal] = scores
        self.spelling: list[bytes] = [b""] * n
        for i in normal:
            self.spelling[i] = pieces[i].replace(SPACE, " ").encode()
        for b, i in enumerate(byte_ids):
            self.spelling[i] = bytes([b])
        self.rare = float(scores.min() - np.log(n))
        self.chars = np.zeros(n)
        self.chars[normal] = [len(pieces[i]) for i in normal]
        self.longest = int(self.chars.max())
        self._trie({pieces[i]: i for i in normal})

    def _trie(self, ids: dict[str, int]) -> None:
        states: dict[str, int] = {"": 0}
        moves: dict[int, int] = {}
        ends = [-1]
        for piece, i in ids.items():
            for depth in range(1, len(piece) + 1):
                prefix = piece[:depth]
                if prefix not in states:
                    states[prefix] = len(ends)
                    moves[(states[prefix[:-1]] << 21) | ord(prefix[-1])] = len(ends)
                    ends.append(-1)
            ends[states[piece]] = i
        #: The first step goes by a table over all code points, later ones by a hash table of (state, character) keys.
        self.root = np.full(0x110000, -1, np.int32)
        for key in [k for k in moves if k >> 21 == 0]:
            self.root[key] = moves.pop(key)
        self.slot_bits = len(moves).bit_length() + 2
        self.move_keys = np.full(2**self.slot_bits, -1, np.int64)
        self.move_to = np.full(2**self.slot_bits, -1, np.int64)
        keys = np.array(list(moves), np.int64)
        for key, slot in zip(keys.tolist(), self._slot(keys).tolist(), strict=True):
            while self.move_keys[slot] >= 0:
                slot = (slot + 1) % len(self.move_keys)
            self.move_keys[slot], self.move_to[slot] = key, moves[key]
        self.piece_of = np.array(ends, np.int64)

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.slot_bits)).astype(np.int64)

    def step(self, state: np.ndarray, char: np.ndarray) -> np.ndarray:
        """Next trie state, or -1."""
        key = (state << 21) | char
        slot = self._slot(key)
        there = self.move_keys[slot]
        out = np.where(there == key, self.move_to[slot], -1)
        left = np.flatnonzero((there != key) & (there >= 0))
        while len(left):
            slot[left] = (slot[left] + 1) % len(self.move_keys)
            there = self.move_keys[slot[left]]
            same = there == key[left]
            out[left[same]] = self.move_to[slot[left[same]]]
            left = left[~same & (there >= 0)]
        return out

    def scaled(self, alpha: float) -> tuple[np.ndarray, float]:
        """Linear weights of the pieces and of a spelled character. Each is multiplied by the same factor per character,
        which changes no share, since all segmentations of a word have as many; it keeps the sums in range."""
        per_char = alpha * 2.0
        return np.exp(alpha * self.weight + per_char * self.chars), float(np.exp(alpha * self.rare + per_char))


class Lattices:
    """The lattices of a list of distinct words, filtered forwards.

    ``alpha`` scales the weights: at 0 all segmentations are alike, large values come close to the best one.
    """

    def __init__(self, vocabulary: Vocabulary, words: Sequence[str], alpha: float) -> None:
        v = vocabulary
        weight, rare = v.scaled(alpha)
        # Words by falling length, nodes by level: the words that reach a level are its first nodes, in the same order.
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        order = np.argsort(-lengths, kind="stable")
        self.rank = np.empty(len(words), np.int64)
        self.rank[order] = np.arange(len(words))
        self.length = lengths
        flat = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        starts = (np.cumsum(lengths) - lengths)[order]
        lengths = lengths[order]
        longest = int(lengths.max(initial=0))
        reach = np.searchsorted(-lengths, -np.arange(longest + 1), side="right")  # words with at least so many characters
        self.base = np.concatenate([[0], np.cumsum(reach)])  # first node of each level
        level = np.repeat(np.arange(longest + 1), reach)
        row = np.arange(len(level)) - self.base[level]
        before = lengths[row] > level  # nodes with a character behind them
        chars = np.zeros(len(level), np.int64)
        chars[before] = flat[starts[row[before]] + level[before]]

        sources, targets, emits, weights = [], [], [], []
        at = np.flatnonzero(before)
        n_starts, state, depth = len(at), v.root[chars[at]].astype(np.int64), 0
        while True:
            on = np.flatnonzero(state >= 0)
            first, state = at[on], state[on]
            piece = v.piece_of[state]
            full = np.flatnonzero(piece >= 0)
            node, piece = first[full], piece[full]
            sources.append(node)
            targets.append(self.base[level[node] + depth + 1] + row[node])
            emits.append(piece)
            weights.append(weight[piece])
            if depth == 0:  # characters that are no piece are spelled in bytes
                alone = before.copy()
                alone[node] = False
                odd = np.flatnonzero(alone)
                sources.append(odd)
                targets.append(self.base[level[odd] + 1] + row[odd])
                emits.append(-1 - chars[odd])
                weights.append(np.full(len(odd), rare))
            depth += 1
            on = np.flatnonzero(lengths[row[first]] > level[first] + depth)
            if not len(on):
                break
            at, state = first[on], state[on]
            state = v.step(state, chars[self.base[level[at] + depth] + row[at]])
        # By target, longest piece first: sorted runs, one per depth, that a stable sort merges.
        source, target, emit, w = (np.concatenate(x[::-1]) for x in (sources, targets, emits, weights))
        by_target = np.argsort(target, kind="stable")
        self.source, target, self.emits, w = source[by_target], target[by_target], emit[by_target], w[by_target]
        self.first_edge = np.searchsorted(target, np.arange(len(level) + 1))

        sums = np.ones(len(level))
        #: Per edge: the share of its node's edges up to this one.
        self.cumulative = np.empty(len(target))
        for k in range(1, longest + 1):
            low, high = self.base[k], self.base[k + 1]
            edges = slice(self.first_edge[low], self.first_edge[high])
            own = sums[self.source[edges]] * w[edges]
            at = self.first_edge[low:high] - self.first_edge[low]
            total = np.add.reduceat(own, at)
            sums[low:high] = total
            run = np.cumsum(own / np.repeat(total, np.diff(np.append(at, len(own)))))
            self.cumulative[edges] = run - np.repeat(np.append(0.0, run)[at], np.diff(np.append(at, len(own))))
            self.cumulative[self.first_edge[low + 1 : high + 1] - 1] = 1.0
            if k % 16 == 0:  # only ratios count: keep the sums that later levels use near 1
                for j in range(max(0, k - v.longest), k + 1):
                    rows = slice(self.base[j], self.base[j] + high - low)
                    sums[rows] = sums[rows] / total

    def draw(self, words: np.ndarray, seeds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Backward sampling for each of ``words``: pieces per word, and all pieces in reading order."""
        at, who = self.base[self.length[words]] + self.rank[words], np.arange(len(words))
        n_pieces = np.zeros(len(words), np.int64)
        drawn = []
        while len(at):
            u = (mix64(seeds[who] + mix64(np.full(1, len(drawn) + 1, np.uint64))) >> np.uint64(11)) * 2.0**-53
            edge = self.first_edge[at]
            left = np.flatnonzero(self.cumulative[edge] <= u)
            while len(left):
                edge[left] += 1
                left = left[self.cumulative[edge[left]] <= u[left]]
            drawn.append((who, self.emits[edge]))
            n_pieces[who] += 1
            at = self.source[edge]
            inner = at >= self.base[1]
            at, who = at[inner], who[inner]
        ends = np.cumsum(n_pieces)
        out = np.zeros(int(ends[-1]) if len(ends) else 0, np.int64)
        for back, (who, what) in enumerate(drawn):
            out[ends[who] - 1 - back] = what
        return n_pieces, out


def sample_pieces(
    vocabulary: Vocabulary, texts: Sequence[str], keys: Sequence[int], alpha: float = 1.0
) -> tuple[np.ndarray, np.ndarray]:
    """Pieces per text, and all ids one after the other. Equal (text, key) give equal ids, whatever else is in the batch."""
    words: list[str] = []
    sizes = np.zeros(len(texts), np.int64)
    for i, text in enumerate(texts):
        if text:  # the first word gets a leading space, as the model expects
            own = WORD.findall(SPACE + text.replace(SPACE, LITERAL).replace(" ", SPACE))
            words += own
            sizes[i] = len(own)
    if not sizes.sum():
        return np.zeros(len(texts), np.int64), np.zeros(0, np.int32)
    place = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    seeds = mix64(np.repeat(mix64(np.array(keys, np.uint64)), sizes) + place.astype(np.uint64))
    numbers: dict[str, int] = defaultdict(count().__next__)
    codes = np.fromiter(map(numbers.__getitem__, words), np.int64, len(words))
    n_pieces, ids = Lattices(vocabulary, list(numbers), alpha).draw(codes, seeds)
    per_text = np.add.reduceat(np.append(n_pieces, 0), np.minimum(np.cumsum(sizes) - sizes, len(n_pieces)))
    per_text[sizes == 0] = 0
    odd = np.flatnonzero(ids < 0)
    if len(odd):
        spelled = [SPACE.encode() if c == LITERAL else c.encode() for c in (chr(-1 - x) for x in ids[odd].tolist())]
        lengths = np.ones(len(ids), np.int64)
        lengths[odd] = [len(s) for s in spelled]
        text_of = np.repeat(np.arange(len(texts)), per_text)
        per_text = np.bincount(text_of, lengths, len(texts)).astype(np.int64)
        is_odd = np.repeat(ids < 0, lengths)
        ids = np.repeat(ids, lengths)
        ids[is_odd] = vocabulary.byte_first + np.frombuffer(b"".join(spelled), np.uint8).astype(np.int64)
    return per_text, ids.astype(np.int32)


def decode_pieces(vocabulary: Vocabulary, ids: Sequence[int]) -> bytes:
    """The text of a list of piece ids, in UTF-8; it undoes ``sample_pieces`` exactly."""
    out = b"".join(map(vocabulary.spelling.__getitem__, ids))
    return out[1:] if out[:1] == b" " else out


def encode_documents(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: str = DEFAULT_MODEL, alpha: float = 1.0, seed: int = 0
) -> DataFrame:
    """Columns of ``docs`` plus ``piece_ids`` (one sampled segmentation), ``n_pieces``, ``ids_sha256`` (of the ids as
    little-endian 32-bit integers) and ``lossless`` (decoding gives the text back, checked on every row).

    A row's draws depend on its id, text and ``seed`` alone, so repeated rows get equal pieces. Null and empty texts have no
    pieces and are lossless. Columns of those four names in ``docs`` are replaced.
    """
    made = ["piece_ids", "n_pieces", "ids_sha256", "lossless"]
    body = F.col(f"`{text_col}`").cast("binary")
    source = packed(docs, body=body, key=F.xxhash64(F.lit(seed), F.col(f"`{id_col}`").cast("string")))
    schema = T.StructType([source.schema["row"], T.StructField("piece_ids", T.ArrayType(T.IntegerType()))])
    schema = schema.add("n_pieces", "long").add("ids_sha256", "string").add("lossless", "boolean")
    vocabulary = Vocabulary(model)

    def run(batches):
        for batch in batches:
            raws, keys = batch.column(1).to_pylist(), batch.column(2).to_pylist()
            low = 0
            while low < len(raws):
                high, chars = low, 0
                while high < len(raws) and (high == low or chars < CHARS_PER_ROUND):
                    chars += len(raws[high] or b"")
                    high += 1
                yield encoded(batch.slice(low, high - low), raws[low:high], keys[low:high])
                low = high

    def encoded(part, raws, keys):
        texts = [(r or b"").decode("utf-8", "replace") for r in raws]
        seeds = [xxhash.xxh3_64_intdigest(r or b"", k & (2**64 - 1)) for r, k in zip(raws, keys, strict=True)]
        sizes, ids = sample_pieces(vocabulary, texts, seeds, alpha)
        ends = np.cumsum(sizes)
        digests, fine = [], []
        listed, spelling = ids.tolist(), vocabulary.spelling.__getitem__
        for raw, n, end in zip(raws, sizes.tolist(), ends.tolist(), strict=True):
            digests.append(hashlib.sha256(ids[end - n : end].tobytes()).hexdigest())
            fine.append(b"".join(map(spelling, listed[end - n : end])) == (b" " + raw if raw else b""))
        arrays = [
            pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), pa.array(ids, pa.int32())),
            pa.array(sizes, pa.int64()), pa.array(digests), pa.array(fine),
        ]
        return pa.RecordBatch.from_arrays([part.column(0), *arrays], names=schema.names)

    encoded_rows = source.mapInArrow(run, schema)
    return encoded_rows.select(*unpacked("row", [c for c in docs.columns if c not in made]), *made)


def decode_documents(encoded: DataFrame, text_col: str = "text", ids_col: str = "piece_ids", model: str = DEFAULT_MODEL) -> DataFrame:
    """``encoded`` with ``text_col`` decoded from its piece ids; null ids give null."""
    vocabulary = Vocabulary(model)
    source = packed(encoded, ids=F.col(f"`{ids_col}`"))
    schema = T.StructType([source.schema["row"], T.StructField("body", T.StringType())])

    def run(batches):
        for batch in batches:
            texts = [None if ids is None else decode_pieces(vocabulary, ids).decode() for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["row", "body"])

    names = [c for c in encoded.columns if c != text_col]
    return source.mapInArrow(run, schema).select(*unpacked("row", names), F.col("body").alias(text_col))
