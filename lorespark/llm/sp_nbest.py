"""SentencePiece encoding, N-best segmentation and decoding over a piece lattice.

A text is normalised as its model says (here: a space before it, spaces written
as U+2581). The lattice has an edge for every piece that matches; a character
without a piece has one edge that stands for its UTF-8 bytes' pieces. Forward
Viterbi scores give each position the best score from the start; searching
backward from the end, that score is exactly what the rest of a partial path
can still reach, so A* expands only partial paths of the N best.

Scores are log probabilities of pieces. A unigram model brings its own; those
of a byte-pair model are only the ranks of its merges, whose sums mean nothing,
so its pieces get the Zipf-Mandelbrot probabilities of their ranks: the merge
list is ordered by frequency, and nothing is trained. The library's own
encoding (its merges, for such a model) is computed beside the N best.

No piece holds two neighbouring characters that are a pair in no piece, so the
lattice falls apart at such pairs, and its N best paths are the N best sums of
the parts' paths. Parts are cut at spaces and line ends (the model is asked
whether it allows that). A worker numbers the distinct parts it meets and keeps
what it knows of them in arrays: a text is then a list of numbers, and its best
score, length and round trip are sums over them. The gap between the two best
paths of every part says which parts can take part in a text's N best at all,
and only those are searched for N.

Defined results: null and empty texts have no pieces, score 0.0 and the empty
segmentation alone; paths of one score come in a fixed order; rows that repeat
a doc_id are each returned; other columns are ignored.
"""

from __future__ import annotations

import heapq
import math
import re
import zlib
from array import array

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorespark.llm.common import lean, tokenizer_file

MODEL, NBEST = "piece_bpe_32k.model", 4
SPACE = "▁"
UNKNOWN_PENALTY = 10.0
#: Zipf-Mandelbrot: the probability of rank r is in proportion to (r + ZIPF_SHIFT) ** -ZIPF_POWER. Pieces of a merged
#: text are spread more evenly than words, hence the power below 1.
ZIPF_SHIFT, ZIPF_POWER = 2.7, 0.5
#: A worker forgets its parts beyond so many, or so many characters in all.
CACHE_PARTS, CACHE_CHARS = 600_000, 12_000_000
NEVER = float("-inf")


class Lattice:
    """The pieces of a SentencePiece model and their search."""

    def __init__(self, model: str = MODEL):
        import sentencepiece as spm

        self.sp = sp = spm.SentencePieceProcessor(model_file=tokenizer_file(model))
        n = sp.get_piece_size()
        special = lambda i: sp.is_unknown(i) or sp.is_control(i) or sp.is_unused(i) or sp.is_byte(i)
        ids = [i for i in range(n) if not special(i)]
        scores = self._scores([sp.get_score(i) for i in ids])
        self.pieces = {sp.id_to_piece(i): (i, s) for i, s in zip(ids, scores)}
        self.bytes = {int(sp.id_to_piece(i)[3:5], 16): i for i in range(n) if sp.is_byte(i)}
        self.unknown = sp.unk_id()
        self.missing = min(scores) - UNKNOWN_PENALTY
        self.matches = ahocorasick.Automaton()
        for p, (i, s) in self.pieces.items():
            self.matches.add_word(p, (len(p), s, (i,)))
        self.matches.make_automaton()
        self.single = frozenset(p for p in self.pieces if len(p) == 1)
        self.spelled = [b""] * n
        for p, (i, _) in self.pieces.items():
            self.spelled[i] = p.replace(SPACE, " ").encode()
        for b, i in self.bytes.items():
            self.spelled[i] = bytes([b])
        pairs = {p[k : k + 2] for p in self.pieces for k in range(len(p) - 1)}
        split_space = not any(x[1] == SPACE and x[0] != SPACE for x in pairs)
        split_line = not any("\n" in x for x in pairs)
        inner = "[^" + SPACE * split_space + "\n" * split_line + "]*"
        self.parts = re.compile(("\n|" if split_line else "") + (f"{SPACE}+{inner}|{inner[:-1]}+" if split_space else f"{inner[:-1]}+")).findall
        #: How many ids a line end in front takes, when the library encodes a part that begins without a space.
        self.lead = len(sp.encode("\n"))

    @staticmethod
    def _scores(given: list[float]) -> list[float]:
        """A unigram model's log probabilities as they are; ranks of merges as Zipf-Mandelbrot log probabilities."""
        if any(s != int(s) for s in given):
            return given
        order = sorted(range(len(given)), key=lambda k: (-given[k], k))
        total = math.log(sum((r + ZIPF_SHIFT) ** -ZIPF_POWER for r in range(1, len(given) + 1)))
        out = [0.0] * len(given)
        for rank, k in enumerate(order, 1):
            out[k] = -ZIPF_POWER * math.log(rank + ZIPF_SHIFT) - total
        return out

    def normalize(self, text: str) -> str:
        return (SPACE + text.replace(" ", SPACE)) if text else ""

    def edges(self, part: str):
        """(last position, (length, score, ids)) of every edge; positions ascend."""
        found = self.matches.iter(part)
        if self.single.issuperset(part):
            return found
        lone = []
        for k, c in enumerate(part):
            if c not in self.single:
                spelled = c.encode("utf-8", "surrogatepass")
                lone.append((k, (1, self.missing, tuple(self.bytes.get(b, self.unknown) for b in spelled) if self.bytes else (self.unknown,))))
        return heapq.merge(found, lone, key=lambda x: x[0])

    def best_two(self, part: str) -> tuple[float, bytes, float, bool]:
        """Best score of a part, its ids, by how much the second best path is worse, and whether the ids spell the part."""
        n = len(part)
        first, second = [0.0] + [NEVER] * n, [NEVER] * (n + 1)
        via: list = [None] * (n + 1)
        for last, edge in self.edges(part):
            length, gain, _ = edge
            b = last + 1
            a = b - length
            s, top = first[a] + gain, first[b]
            if s > top:
                under = second[a] + gain
                if under > top:
                    top = under
                if top > second[b]:
                    second[b] = top
                first[b], via[b] = s, edge
            elif s > second[b]:
                second[b] = s
        pieces, b = [], n
        while b:
            pieces.append(via[b][2])
            b -= via[b][0]
        ids = [i for piece in reversed(pieces) for i in piece]
        spells = b"".join([self.spelled[i] for i in ids]) == part.replace(SPACE, " ").encode("utf-8", "surrogatepass")
        return first[n], array("I", ids).tobytes(), first[n] - second[n], spells

    def nbest(self, part: str, n: int) -> list[tuple[float, bytes]]:
        """The ``n`` best (score, ids) of one part, best first."""
        end = len(part)
        into: list[list] = [[] for _ in range(end + 1)]
        forward = [0.0] + [NEVER] * end
        for last, edge in self.edges(part):
            into[last + 1].append(edge)
            forward[last + 1] = max(forward[last + 1], forward[last + 1 - edge[0]] + edge[1])
        count, out = 0, []
        heap: list[tuple] = [(-forward[end], end, 0, 0.0, None)]  # (-(best total), position, order, score behind it, path)
        while heap and len(out) < n:
            _, b, _, behind, path = heapq.heappop(heap)
            if b == 0:
                ids: list[int] = []
                while path is not None:
                    ids += path[0]
                    path = path[1]
                out.append((behind, array("I", ids).tobytes()))
                continue
            for length, s, ids_ in into[b]:
                count += 1
                heapq.heappush(heap, (-(forward[b - length] + s + behind), b - length, count, s + behind, (ids_, path)))
        return out

    def library(self, parts: list[str]) -> list[bytes]:
        """The library's own encoding of each part."""
        spaced = [p[0] == SPACE for p in parts]
        given = [p[1:].replace(SPACE, " ") if s else "\n" + p.replace(SPACE, " ") for p, s in zip(parts, spaced)]
        found = self.sp.encode(given, num_threads=1)
        alone = [array("I", ids if s else ids[self.lead :]).tobytes() for ids, s in zip(found, spaced)]
        if SPACE in self.pieces:  # alone it is the space before an empty text, for which the library gives nothing
            lone = array("I", [self.pieces[SPACE][0]]).tobytes()
            alone = [lone if p == SPACE else ids for p, ids in zip(parts, alone)]
        return alone

    def decode(self, ids: bytes) -> str:
        """The text of a segmentation: pieces joined, the added space taken off."""
        data = b"".join(map(self.spelled.__getitem__, np.frombuffer(ids, "<u4").tolist()))
        return (data[1:] if data[:1] == b" " else data).decode("utf-8", "surrogatepass")


class Parts(dict):
    """Numbers of the parts a worker has met, and what is known of each, in arrays; made anew when there are many."""

    def __init__(self, lattice: Lattice):
        super().__init__()
        self.lattice = lattice
        self.forget()

    def forget(self) -> None:
        self.clear()
        self.chars, self.many = 0, {}
        self.names: list[str] = []
        self.ids: list[bytes] = []
        self.own: list[bytes] = []  # the library's
        self.fresh: list[tuple[float, float, int, bool]] = []
        self.score, self.worse, self.size, self.same = np.zeros(0), np.zeros(0), np.zeros(0, np.int64), np.zeros(0, bool)

    def __missing__(self, part: str) -> int:
        score, ids, worse, spells = self.lattice.best_two(part)
        k = self[part] = len(self.names)
        self.names.append(part)
        self.ids.append(ids)
        self.fresh.append((score, worse, len(ids) // 4, spells))
        self.chars += len(part)
        return k

    def numbers(self, texts: list[str | None]) -> list[list[int]]:
        """The parts of each text, and room for them in the arrays."""
        if len(self.names) > CACHE_PARTS or self.chars > CACHE_CHARS:
            self.forget()
        split, normalize, number = self.lattice.parts, self.lattice.normalize, self.__getitem__
        found = [list(map(number, split(normalize(t or "")))) for t in texts]
        if self.fresh:
            score, worse, size, same = zip(*self.fresh)
            self.score, self.worse = np.append(self.score, score), np.append(self.worse, worse)
            self.size, self.same = np.append(self.size, size), np.append(self.same, same)
            self.own += self.lattice.library(self.names[len(self.own) :])
            self.fresh = []
        return found

    def nbest(self, k: int, n: int) -> list[tuple[float, bytes]]:
        found = self.many.get((k, n))
        if found is None:
            found = self.many[k, n] = self.lattice.nbest(self.names[k], n)
        return found

    def segment(self, numbers: list[int], n: int = NBEST) -> list[tuple[float, bytes]]:
        """The ``n`` best (score, ids as little-endian unsigned 32-bit numbers) of the text of these parts, best first."""
        if not numbers:
            return [(0.0, b"")]
        at = np.array(numbers)
        total, best = float(self.score[at].sum()), b"".join(map(self.ids.__getitem__, numbers))
        out: list[tuple[float, tuple]] = [(0.0, ())]
        if n > 1:
            worse = self.worse[at]
            near = np.flatnonzero(worse <= np.partition(worse, n - 2)[n - 2]) if len(worse) > n - 1 else np.arange(len(worse))
            for i in near[np.argsort(worse[near], kind="stable")][: n - 1].tolist():
                ways = self.nbest(numbers[i], n)
                first = self.ids[numbers[i]]
                ways = sorted(ways, key=lambda w: (-w[0], w[1] != first))
                sums = [(loss + ways[0][0] - score, (*chosen, (i, ids)) if ids != first else chosen) for loss, chosen in out for score, ids in ways]
                out = sorted(sums, key=lambda x: x[0])[:n]
        ends = np.cumsum(self.size[at]) * 4 if len(out) > 1 else None
        result = []
        for loss, chosen in out:
            pieces, last = [], 0
            for i, ids in sorted(chosen):
                stop = int(ends[i])
                pieces += [best[last : stop - len(self.ids[numbers[i]])], ids]
                last = stop
            result.append((total - loss, b"".join([*pieces, best[last:]])))
        return result


_parts: dict[str, Parts] = {}


def parts_of(model: str = MODEL) -> Parts:
    """This worker's parts for ``model``."""
    if model not in _parts:
        _parts[model] = Parts(Lattice(model))
    return _parts[model]


def segment(text: str | None, n: int = NBEST, model: str = MODEL) -> list[tuple[float, bytes]]:
    """The ``n`` best (score, ids) of one text."""
    parts = parts_of(model)
    return parts.segment(parts.numbers([text])[0], n)


def segmentations(docs: DataFrame, model: str = MODEL, n: int = NBEST, with_ids: bool = False) -> DataFrame:
    """Of every row: doc_id, n_pieces, score and ids_crc32 of the best path, whether decoding it gives the text, the N
    best, and number and ids_crc32 of the pieces of the library's own encoding.

    ``with_ids`` adds the best path's piece ids as ``ids``.
    """

    best = pa.list_(pa.struct([("score", pa.float64()), ("n_pieces", pa.int64()), ("ids_crc32", pa.int64())]))
    names = ["doc_id", "n_pieces", "score", "ids_crc32", "decodes", "nbest", "library_n_pieces", "library_crc32"] + ["ids"] * with_ids

    def segmented(batches):
        parts = parts_of(model)
        for batch in batches:
            for lo in range(0, batch.num_rows, 64):
                part = batch.slice(lo, 64)
                numbers = parts.numbers(part.column(1).to_pylist())
                ways, same, own, ids = [], [], [], []
                for of_text in numbers:
                    found = parts.segment(of_text, n)
                    same.append(bool(parts.same[of_text].all()))
                    ways.append([{"score": s, "n_pieces": len(x) // 4, "ids_crc32": zlib.crc32(x)} for s, x in found])
                    own.append(b"".join(map(parts.own.__getitem__, of_text)))
                    if with_ids:
                        ids.append(np.frombuffer(found[0][1], "<i4"))
                first = lambda key: [w[0][key] for w in ways]  # noqa: E731, B023
                columns = [
                    part.column(0), pa.array(first("n_pieces"), pa.int64()), pa.array(first("score"), pa.float64()), pa.array(first("ids_crc32"), pa.int64()), pa.array(same), pa.array(ways, best),
                    pa.array([len(x) // 4 for x in own], pa.int64()), pa.array(list(map(zlib.crc32, own)), pa.int64()),
                ]
                yield pa.RecordBatch.from_arrays(columns + [pa.array(ids, pa.list_(pa.int32()))] * with_ids, names)

    schema = "doc_id long, n_pieces long, score double, ids_crc32 long, decodes boolean, nbest array<struct<score: double, n_pieces: long, ids_crc32: long>>, library_n_pieces long, library_crc32 long"
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return text.mapInArrow(lean(segmented), schema + ", ids array<int>" * with_ids)
