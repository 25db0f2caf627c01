"""Cross-tokenizer alignment: which ids of one vocabulary stand for which of another.

Every text is encoded by a byte-level tokenizer (side A, with a space put
before the text) and by a SentencePiece model (side B, which puts one itself).
Both spell the same bytes, so tokens link where their byte ranges overlap, and
byte offsets where tokens of both sides end cut a text into groups.

Neither vocabulary joins text across the end of a word, so a text is the row of
its words' encodings: each distinct word is encoded and aligned once per worker
and kept. A block of documents leaves one written row for each stripe of A ids
(``id % STRIPES``), with the links of its documents there. Counting deals the
rows by stripe and adds them into that stripe's dense matrix of documents per
(A id, B id) with ``np.add.at``; row maxima give each A id's best. Scoring deals
the links the same way and meets them with the finished stripes.

Memory is bounded by one dense stripe (``STRIPES`` of them hold both
vocabularies) and one block. Stripes of many blocks are dealt over ``SPAN``
blocks at a time and merged in a second step, so none is one task's work at any
size. All exchanges are sorted streams; no group is gathered.

Defined results: null, empty and unspellable texts (those that hold U+2581)
have no tokens: zeros and an empty digest; a repeated row is a document of its
own; a null doc_id stays null; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import itertools
import json
import re
import uuid
from array import array

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorespark.llm.common import lean, shared_dir, shuffle_partitions, single_thread, tokenizer_file
from lorespark.llm.word_encoder import PLAIN, byte_letters

TOKENIZER_A = "byte_bpe_50k.json"
TOKENIZER_B = "piece_bpe_32k.model"
#: Stripes of A ids; a stripe's dense matrix has |A| / STRIPES rows of |B| counts.
STRIPES = 256
#: Stripes are scored in so many lanes; a lane adds its stripes' scores up before they leave the task.
LANES = 16
#: Blocks whose rows of a stripe meet in one step.
SPAN = 512
#: A block closes when it holds so many bytes of text.
BLOCK_BYTES = 2 << 20
#: A block holds fewer texts than two to this power.
TEXT_BITS = 20
#: Links that are spread out at a time.
SLICE = 1 << 20
#: Words are kept until they and their links take about so many bytes.
CACHE_BYTES = 128 << 20

#: The pattern of byte-level vocabularies, as public tokenizers state it. Fixed value.
BYTE_LEVEL = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Where a word ends for both sides: something that is no white space, then a space or a line's end.
BOUND = re.compile(r"(?<=\S)(?=[ \n])")
UNEVEN = re.compile(r"\s[ \n]")

WRITTEN = pa.schema(
    [("kind", pa.int32()), ("block", pa.int64()), ("ix", pa.int64()), ("doc_id", pa.int64()), *[(c, pa.int64()) for c in ("n_a", "n_b", "n_groups", "n_links")], ("groups_sha256", pa.string()), ("stripe", pa.int32()), ("links", pa.binary()), ("counts", pa.binary())]
)
DOC, LINKS = 0, 1
_WRITTEN_SQL = "kind int, block long, ix long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, stripe int, links binary, counts binary"


# --- one worker's encoders ----------------------------------------------------


class _SideA:
    """``ids(word)`` by a byte-level file; plain Latin-1 words by a core built from its vocabulary, others by the library."""

    def __init__(self, name: str):
        import tiktoken
        from tokenizers import Tokenizer

        path = tokenizer_file(name)
        self._tok = Tokenizer.from_file(path)
        self._tok.encode_special_tokens = True
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        letters, self.size = byte_letters(), self._tok.get_vocab_size(with_added_tokens=True)
        self.bytes = [b""] * self.size
        for token, i in model["vocab"].items():
            if all(c in letters for c in token):
                self.bytes[i] = bytes(letters[c] for c in token)
        made = [model["vocab"]["".join(m.split(" ") if isinstance(m, str) else m)] for m in model["merges"]]
        ranked = made == sorted(made) and len(set(made)) == len(made) and sum(len(b) == 1 for b in self.bytes) == 256
        self._core = ranked and tiktoken.Encoding("a", pat_str=BYTE_LEVEL, mergeable_ranks={b: i for i, b in enumerate(self.bytes) if b}, special_tokens={})

    def ids(self, word: str) -> list[int]:
        return self._tok.encode(word, add_special_tokens=False).ids

    def plain(self, words: list[str]) -> np.ndarray | None:
        """The ids of ``words`` in a row, each plain characters after one space or line's end; None without a core."""
        return np.array(self._core.encode_ordinary("".join(words)), np.int64) if self._core else None


class _SideB:
    """``all_ids(words)`` by a SentencePiece model; every word begins with a space or a line's end."""

    def __init__(self, name: str):
        import sentencepiece

        self._sp = sentencepiece.SentencePieceProcessor(model_file=tokenizer_file(name))
        self.size = self._sp.get_piece_size()
        pieces = [self._sp.id_to_piece(i) for i in range(self.size)]
        self.bytes = [bytes([int(p[3:5], 16)]) if self._sp.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self._space = self._sp.piece_to_id("▁")
        #: No piece crosses the end of a word.
        self.by_word = not any("▁" in p.lstrip("▁") or "\n" in p for p in pieces) and self._sp.encode("\n")[0] == self._space

    def all_ids(self, words: list[str]) -> list[list[int]]:
        found = self._sp.encode([w[1:] if w[0] == " " else w for w in words], num_threads=1)
        return [([self._space] if w == " " else ids) if w[0] == " " else ids[1:] for w, ids in zip(words, found)]


def overlaps(ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Links (a place on either side) of two ways to cut the same bytes, and whether both tokens of a link end together.

    Each end of a token, of either side, closes one stretch that one token of A and one of B share.
    """
    ends = np.union1d(ends_a, ends_b)
    left, right = np.searchsorted(ends_a, ends), np.searchsorted(ends_b, ends)
    return left, right, ends_a[left] == ends_b[right]


class Aligner:
    """Encodes and aligns texts word by word, and keeps the words."""

    def __init__(self, a: str = TOKENIZER_A, b: str = TOKENIZER_B):
        single_thread()
        self.a, self.b = _SideA(a), _SideB(b)
        self.rows = -(-self.a.size // STRIPES)
        self.bits = (self.rows * self.b.size).bit_length()
        self._lengths = tuple(np.array([len(x) for x in side.bytes]) for side in (self.a, self.b))
        # how each token is written in a group, by what follows it
        written = [f"{i}{end}".encode() for side, ends in ((self.a, ",|"), (self.b, ",;")) for end in ends for i in range(side.size)]
        self._written = np.array(written, object)
        self._written_lengths = np.array([len(x) for x in written])
        self.clear()

    def clear(self) -> None:
        self.index: dict[str, int] = {}
        self.groups: list[bytes] = []
        self.n = array("q")  # tokens of A and B, groups, links of each word; -1 where it cannot be spelt
        self.start = array("q", [0])
        self.codes = array("q")  # links, as ``code``
        self.held = 0

    def code(self, a: int, b: int) -> int:
        """A link: its stripe, then its place in the stripe's matrix. ``block`` puts the document's number between them."""
        return (a % STRIPES) << self.bits | (a // STRIPES * self.b.size + b)

    def words(self, text: str) -> list[str]:
        """The keys of a text's words: a word after a space is written without it; keys that begin with white space are as they are."""
        if not self.b.by_word:
            return [f" {text}" if text[:1] in " \n" else text]
        spaced = f" {text}"
        if not UNEVEN.search(spaced):
            keys = text.replace("\n", " \n").split(" ")
            if not keys[-1]:
                keys[-1] = " "
            return keys
        return [w[1:] if w[0] == " " and w[1:2] not in (" ", "\n", "") else w for w in BOUND.split(spaced)]

    def add(self, keys: list[str]) -> None:
        """Encodes and aligns new words; plain ones in one go, the others one by one."""
        words = {k: k if k[0] in " \n" else f" {k}" for k in keys}
        plain = {k: w for k, w in words.items() if PLAIN.fullmatch(w, 1)}
        a = self.a.plain(list(plain.values())) if plain else None
        if a is not None:
            b = self.b.all_ids(list(plain.values()))
            b_sizes, b = np.array([len(x) for x in b]), np.fromiter(itertools.chain.from_iterable(b), np.int64)
            raw = "".join(plain.values()).encode()
            if raw == b"".join(map(self.a.bytes.__getitem__, a.tolist())) == b"".join(map(self.b.bytes.__getitem__, b.tolist())):
                ends = np.cumsum([len(w.encode()) for w in plain.values()])
                self._keep(list(plain), ends, a, b, b_sizes)
            else:
                plain = {}
        else:
            plain = {}
        others = {k: w for k, w in words.items() if k not in plain}
        for (key, word), b in zip(others.items(), self.b.all_ids(list(others.values()))):
            a, raw = self.a.ids(word), word.encode()
            if b"".join(map(self.a.bytes.__getitem__, a)) == raw == b"".join(map(self.b.bytes.__getitem__, b)):
                self._keep([key], np.array([len(raw)]), np.array(a), np.array(b), np.array([len(b)]))
            else:
                self.index[key] = len(self.groups)
                self.groups.append(b"")
                self.n.extend((-1, -1, -1, -1))
                self.start.append(len(self.codes))
                self.held += 250 + len(key)

    def _keep(self, keys: list[str], words: np.ndarray, a: np.ndarray, b: np.ndarray, b_sizes: np.ndarray) -> None:
        """Aligns words in a row: ``words`` are their ends in bytes, ``a`` and ``b`` the ids of both sides."""
        ends_a, ends_b = np.cumsum(self._lengths[0][a]), np.cumsum(self._lengths[1][b])
        left, right, closed = overlaps(ends_a, ends_b)
        a_to, b_to = np.searchsorted(ends_a, words) + 1, np.cumsum(b_sizes)  # tokens through each word
        group_a, group_b = left[closed] + 1, right[closed] + 1  # tokens through each group
        groups = np.searchsorted(group_a, a_to) + 1
        links = np.searchsorted(left, a_to)
        # written in a row: a group's A tokens, then its B tokens
        of_a, of_b = np.searchsorted(group_a, np.arange(len(a)), side="right"), np.searchsorted(group_b, np.arange(len(b)), side="right")
        shown = np.empty(len(a) + len(b), np.int64)
        shown[np.arange(len(a)) + np.concatenate([[0], group_b])[of_a]] = a + self.a.size * np.isin(np.arange(1, len(a) + 1), group_a)
        shown[np.arange(len(b)) + group_a[of_b]] = b + 2 * self.a.size + self.b.size * np.isin(np.arange(1, len(b) + 1), group_b)
        line = b"".join(self._written[shown].tolist())
        at = np.cumsum(self._written_lengths[shown])[a_to + b_to - 1].tolist()
        first = len(self.groups)
        self.index.update(zip(keys, range(first, first + len(keys))))
        self.groups += [line[lo : hi - 1] for lo, hi in zip([0, *at], at)]
        each = [np.diff(x, prepend=0) for x in (a_to, b_to, groups, links)]
        self.n.frombytes(np.stack(each, axis=1).astype(np.int64).tobytes())
        self.start.frombytes((links + len(self.codes)).astype(np.int64).tobytes())
        self.codes.frombytes(self.code(a[left], b[right]).tobytes())
        self.held += 230 * len(keys) + sum(map(len, keys)) + len(line) + 8 * len(left)

    def prepare(self, texts: list[str | None]) -> list[list[str]]:
        """The keys of each text's words, all of them known afterwards."""
        keyed = [self.words(t) if t else [] for t in texts]
        missing = set().union(*keyed).difference(self.index)
        if missing:
            self.add(list(missing))
        return keyed

    def block(self, keyed: list[list[str]]) -> tuple[np.ndarray, list[str], np.ndarray, np.ndarray]:
        """Of texts whose words are known: n_a, n_b, n_groups and n_links of each, the digests of their groups, then all
        links of all texts: distinct codes (stripe, text, place), ascending, and how often each occurs."""
        sizes = np.array([len(k) for k in keyed], np.int64)
        ids = np.fromiter(map(self.index.__getitem__, itertools.chain.from_iterable(keyed)), np.int64, int(sizes.sum()))
        n = np.frombuffer(self.n, np.int64).reshape(-1, 4)[ids] if len(ids) else np.empty((0, 4), np.int64)
        ends = np.cumsum(sizes)
        unspelt = np.zeros(len(keyed), bool)
        unspelt[np.searchsorted(ends, np.flatnonzero(n[:, 0] < 0), side="right")] = True
        sums = np.diff(np.concatenate([np.zeros((1, 4), np.int64), np.cumsum(n, axis=0)])[np.concatenate([[0], ends])], axis=0)
        sums[unspelt] = 0
        shown = list(map(self.groups.__getitem__, ids.tolist()))
        digests = ["" if lo == hi or skip else hashlib.sha256(b";".join(shown[lo:hi])).hexdigest() for lo, hi, skip in zip((ends - sizes).tolist(), ends.tolist(), unspelt.tolist())]
        text = np.repeat(np.arange(len(keyed)), np.where(unspelt, 0, sizes))
        kept = ids[np.repeat(~unspelt, sizes)]
        pairs, times = np.unique(text << 32 | kept, return_counts=True)
        return sums, digests, *self._spread(pairs >> 32, pairs & 0xFFFFFFFF, times)

    def _spread(self, text: np.ndarray, ids: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The links of words, some words at a time."""
        if not len(ids):
            return np.empty(0, np.int64), np.empty(0, np.int64)
        start, flat = np.frombuffer(self.start, np.int64), np.frombuffer(self.codes, np.int64)
        lengths = start[ids + 1] - start[ids]
        cuts = [0, *(np.flatnonzero(np.diff(np.cumsum(lengths) // SLICE)) + 1).tolist(), len(ids)]
        found: list[tuple[np.ndarray, np.ndarray]] = []
        for lo, hi in zip(cuts, cuts[1:]):
            many = lengths[lo:hi]
            ends = np.cumsum(many)
            code = flat[np.arange(ends[-1]) + np.repeat(start[ids[lo:hi]] - ends + many, many)]
            place = code & ((1 << self.bits) - 1)
            found.append(_summed((code - place) << TEXT_BITS | np.repeat(text[lo:hi], many) << self.bits | place, np.repeat(times[lo:hi], many)))
        return found[0] if len(found) == 1 else _summed(*(np.concatenate(x) for x in zip(*found)))


def _summed(codes: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct codes, ascending, and the sum of their times."""
    order = np.argsort(codes, kind="stable")
    codes, times = codes[order], times[order]
    first = np.flatnonzero(np.diff(codes, prepend=-1))
    return codes[first], np.add.reduceat(times, first)


_aligners: dict[tuple[str, str], Aligner] = {}


def aligner(a: str, b: str) -> Aligner:
    """This worker's aligner of two vocabularies."""
    if (a, b) not in _aligners:
        _aligners[a, b] = Aligner(a, b)
    return _aligners[a, b]


# --- packed rows --------------------------------------------------------------


def _thin(x: np.ndarray) -> bytes:
    """Unsigned numbers in the fewest bytes that hold the largest; the width comes first."""
    width = next(w for w in (1, 2, 4, 8) if w == 8 or not len(x) or int(x.max()) < 1 << 8 * w)
    return bytes([width]) + x.astype(f"<u{width}").tobytes()


def _pack(*columns: np.ndarray) -> bytes:
    thin = [_thin(x) for x in columns]
    return np.array([len(t) for t in thin], "<u4").tobytes() + b"".join(thin)


def _unpack(packed: bytes, n: int) -> list[np.ndarray]:
    at, out = 4 * n, []
    for size in np.frombuffer(packed, "<u4", n).tolist():
        out.append(np.frombuffer(packed, f"<u{packed[at]}", (size - 1) // packed[at], at + 1).astype(np.int64))
        at += size
    return out


def _block_rows(own: Aligner, block: int, ids: list, texts: list) -> list[pa.RecordBatch]:
    """The rows of a block: one of each document, one of each stripe that has links."""
    n, shas, code, many = own.block(own.prepare(texts))
    bits, width, count = own.bits, own.b.size, len(ids)
    none = lambda kind, size: pa.nulls(size, kind)
    whole = pa.RecordBatch.from_arrays(
        [pa.array(np.full(count, DOC, np.int32)), pa.array(np.full(count, block)), pa.array(np.arange(count)), pa.array(ids, pa.int64()), *[pa.array(n[:, k]) for k in range(4)], pa.array(shas, pa.string()), none(pa.int32(), count), none(pa.binary(), count), none(pa.binary(), count)],
        schema=WRITTEN,
    )
    stripe, doc, place = code >> bits + TEXT_BITS, code >> bits & (1 << TEXT_BITS) - 1, code & (1 << bits) - 1
    first = np.flatnonzero(np.diff(stripe, prepend=-1))
    rows = []
    for lo, hi in zip(first, [*first[1:], len(stripe)]):
        own, places = doc[lo:hi], place[lo:hi]
        begins = np.flatnonzero(np.diff(own, prepend=-1))
        held, with_it = np.unique(places, return_counts=True)
        rows.append((int(stripe[lo]), _pack(own[begins], np.diff(begins, append=hi - lo), places // width, places % width, many[lo:hi] - 1), _pack(held // width, held % width, with_it)))
    size = len(rows)
    if not size:
        return [whole]
    stripes, links, counts = zip(*rows)
    longs = [none(pa.int64(), size) for _ in range(4)]
    return [whole, pa.RecordBatch.from_arrays([pa.array(np.full(size, LINKS, np.int32)), pa.array(np.full(size, block)), none(pa.int64(), size), none(pa.int64(), size), *longs, none(pa.string(), size), pa.array(stripes, pa.int32()), pa.array(links, pa.binary()), pa.array(counts, pa.binary())], schema=WRITTEN)]


def write_links(docs: DataFrame, where: str, a: str = TOKENIZER_A, b: str = TOKENIZER_B) -> DataFrame:
    """Encodes every text once; the table in the folder ``where`` has rows of documents and rows of links by block and stripe."""

    def encoded(batches):
        own, block, ids, texts, size = aligner(a, b), TaskContext.get().partitionId() << 32, [], [], 0

        def rows():
            out = _block_rows(own, block, ids, texts)
            if own.held > CACHE_BYTES:
                own.clear()
            return out

        for batch in batches:
            for doc_id, text in zip(batch.column(0), batch.column(1)):
                ids.append(doc_id.as_py())
                texts.append(text.as_py())
                size += len(texts[-1] or "") + 64
                if size >= BLOCK_BYTES or len(ids) >> TEXT_BITS:
                    yield from rows()
                    block, ids, texts, size = block + 1, [], [], 0
        if ids:
            yield from rows()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(lean(encoded), _WRITTEN_SQL)
    rows.write.option("compression", "zstd").parquet(where)
    return docs.sparkSession.read.schema(_WRITTEN_SQL).parquet(where)


# --- counting -----------------------------------------------------------------


def _counted(rows: int, width: int, final: bool):
    """Adds the sorted rows (span, stripe, counts) of each key into one dense matrix; what is not zero leaves it.

    ``final``: the stripe is whole, and links that reach their row's maximum are marked.
    """

    def task(batches):
        matrix, now = np.zeros((rows, width), np.int64), None

        def out():
            left, right = np.nonzero(matrix)
            count = matrix[left, right]
            best = count == matrix.max(axis=1)[left]
            matrix[left, right] = 0
            packed = _pack(left, right, count, best) if final else _pack(left, right, count)
            return pa.RecordBatch.from_arrays([pa.array([now[0]], pa.int64()), pa.array([now[1]], pa.int32()), pa.array([packed], pa.binary())], ["span", "stripe", "counts"])

        for batch in batches:
            for span, stripe, counts in zip(*(batch.column(i) for i in range(3))):
                key = (span.as_py(), stripe.as_py())
                if key != now and now is not None:
                    yield out()
                now = key
                left, right, count = _unpack(counts.as_py(), 3)
                np.add.at(matrix, (left, right), count)
        if now is not None:
            yield out()

    return lean(task)


def _dealt(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    return df.repartition(shuffle_partitions(df.sparkSession), *keys).sortWithinPartitions(*order)


def _sizes(a: str, b: str) -> tuple[int, int]:
    """Rows of a stripe, and the width of B."""
    import sentencepiece
    from tokenizers import Tokenizer

    size = Tokenizer.from_file(tokenizer_file(a)).get_vocab_size(with_added_tokens=True)
    return -(-size // STRIPES), sentencepiece.SentencePieceProcessor(model_file=tokenizer_file(b)).get_piece_size()


def count_pairs(written: DataFrame, a: str = TOKENIZER_A, b: str = TOKENIZER_B, spans: int | None = None) -> DataFrame:
    """(stripe, counts): for each stripe its links' places, documents that hold them, and whether they are their A id's best."""
    rows, width = _sizes(a, b)
    spans = spans or span_count(written)
    schema = "span long, stripe int, counts binary"
    parts = written.filter(F.col("kind") == LINKS).select(F.pmod(F.xxhash64("block"), F.lit(spans)).alias("span"), "stripe", "counts")
    some = _dealt(parts, ["span", "stripe"], ["span", "stripe"]).mapInArrow(_counted(rows, width, final=False), schema)
    whole = _dealt(some.select(F.lit(0).cast("long").alias("span"), "stripe", "counts"), ["stripe"], ["stripe"])
    return whole.mapInArrow(_counted(rows, width, final=True), schema).select("stripe", "counts")


def span_count(written: DataFrame) -> int:
    """Spans follow the number of blocks."""
    return 1 + written.filter(F.col("kind") == LINKS).select("block").distinct().count() // SPAN


def best_pairs(counts: DataFrame, b: str = TOKENIZER_B) -> DataFrame:
    """(a_id, b_id, n_docs) of every best link: the map from one vocabulary to the other."""

    def task(batches):
        for batch in batches:
            for stripe, packed in zip(batch.column(0), batch.column(1)):
                left, right, count, best = _unpack(packed.as_py(), 4)
                keep = best > 0
                yield pa.RecordBatch.from_arrays([pa.array(left[keep] * STRIPES + stripe.as_py()), pa.array(right[keep]), pa.array(count[keep])], ["a_id", "b_id", "n_docs"])

    return counts.mapInArrow(lean(task), "a_id long, b_id long, n_docs long")


# --- scoring ------------------------------------------------------------------


def _scored(rows: int, width: int):
    """Sorted rows (span, lane, stripe, block or null, payload): a stripe's counts come first, then the links of its blocks."""

    def task(batches):
        counts, best = np.zeros((rows, width), np.int64), np.zeros((rows, width), bool)
        now, filled, sums = None, None, {}

        def out():
            blocks = list(sums)
            packed = [_pack(np.flatnonzero(s[1]), s[0][s[1] > 0], s[1][s[1] > 0]) for s in sums.values()]
            sums.clear()
            return pa.RecordBatch.from_arrays([pa.array(blocks, pa.int64()), pa.array(packed, pa.binary())], ["block", "score"])

        for batch in batches:
            for span, lane, block, payload in zip(*(batch.column(i) for i in (0, 1, 3, 4))):
                key, payload = (span.as_py(), lane.as_py()), payload.as_py()
                if key != now and sums:
                    yield out()
                now = key
                if not block.is_valid:
                    if filled is not None:
                        counts[filled] = 0
                        best[filled] = False
                    left, right, count, top = _unpack(payload, 4)
                    filled = (left, right)
                    counts[filled] = count
                    best[filled] = top > 0
                    continue
                docs, lengths, left, right, times = _unpack(payload, 5)
                begins, times = np.cumsum(lengths) - lengths, times + 1
                hit = np.add.reduceat(np.where(best[left, right], times, 0), begins)
                total = np.add.reduceat(counts[left, right] * times, begins)
                held = sums.get(block.as_py())
                many = int(docs[-1]) + 1
                if held is None or held.shape[1] < many:
                    grown = np.zeros((2, many), np.int64)
                    if held is not None:
                        grown[:, : held.shape[1]] = held
                    sums[block.as_py()] = held = grown
                held[0, docs] += hit
                held[1, docs] += total
        if sums:
            yield out()

    return lean(task)


def _assembled(batches):
    """Sorted rows: a block's scores, then its documents in order."""
    sums, now = None, None
    names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    for batch in batches:
        rows = []
        for block, kind, ix, score, *rest in zip(*(batch.column(i).to_pylist() for i in range(batch.num_columns))):
            if block != now:
                sums, now = np.zeros((2, 0), np.int64), block
            if kind == LINKS:
                docs, hit, total = _unpack(score, 3)
                if len(docs) and docs[-1] >= sums.shape[1]:
                    grown = np.zeros((2, int(docs[-1]) + 1), np.int64)
                    grown[:, : sums.shape[1]] = sums
                    sums = grown
                sums[0, docs] += hit
                sums[1, docs] += total
            else:
                own = sums[:, ix].tolist() if ix < sums.shape[1] else [0, 0]
                rows.append((*rest[:5], *own, rest[5]))
        columns = list(zip(*rows)) or [[] for _ in names]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.string() if n == "groups_sha256" else pa.int64()) for n, c in zip(names, columns)], names)


def score_documents(written: DataFrame, counts: DataFrame, a: str = TOKENIZER_A, b: str = TOKENIZER_B, spans: int | None = None) -> DataFrame:
    """One row per document: its tokens, groups and links, links that are best, and the sum of its links' counts."""
    rows, width = _sizes(a, b)
    spans = spans or span_count(written)
    lane = F.pmod("stripe", F.lit(LANES)).alias("lane")
    links = written.filter(F.col("kind") == LINKS).select(F.pmod(F.xxhash64("block"), F.lit(spans)).alias("span"), lane, "stripe", "block", F.col("links").alias("payload"))
    each = counts.select(F.explode(F.sequence(F.lit(0).cast("long"), F.lit(spans - 1).cast("long"))).alias("span"), lane, "stripe", F.lit(None).cast("long").alias("block"), F.col("counts").alias("payload"))
    met = _dealt(each.unionByName(links), ["span", "lane"], ["span", "lane", "stripe", "block"])  # null blocks sort first
    scores = met.mapInArrow(_scored(rows, width), "block long, score binary")
    plain = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"]
    own = written.filter(F.col("kind") == DOC).select("block", F.lit(LINKS + 1).alias("kind"), "ix", F.lit(None).cast("binary").alias("score"), *plain)
    parts = scores.select("block", F.lit(LINKS).alias("kind"), F.lit(None).cast("long").alias("ix"), "score", *[F.lit(None).cast("string" if c == "groups_sha256" else "long").alias(c) for c in plain])
    return _dealt(parts.unionByName(own), ["block"], ["block", "kind", "ix"]).mapInArrow(lean(_assembled), "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string")


def align(docs: DataFrame, a: str = TOKENIZER_A, b: str = TOKENIZER_B) -> DataFrame:
    """Encodes, counts and scores ``docs``; see the module's text. Links stay in a folder of the shared one."""
    written = write_links(docs, f"{shared_dir(docs.sparkSession)}/align-{uuid.uuid4().hex}", a, b)
    spans = span_count(written)
    return score_documents(written, count_pairs(written, a, b, spans), a, b, spans)
