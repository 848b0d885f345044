"""Best-fit packing of token sequences by linear grouping.

A plan needs only how many pieces there are of each length, and lengths are at most the capacity, so the histogram
has at most ``capacity`` entries whatever the corpus.  Large lengths are split into groups of equal cardinality and
rounded up to the largest of their group; the few sizes that remain are packed by configurations (multisets that fit
into one sequence), each as often as the linear program of the fewest sequences says.  Then real lengths take the places
of the rounded ones, largest first; what rounding leaves over and the small pieces go by best fit into the room that is
left.  The plan is a list of
slots: ``count`` pieces of one length take one offset in ``count`` consecutive sequences.  Pieces find their slot by
their rank within their length, which is counted per partition and summed over partitions.
"""

from __future__ import annotations

import bisect
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from boardsift.llm.common import arrow_batches, frugal, staged, text_slices
from boardsift.llm.ragged import gather, offsets
from boardsift.llm.text import split_words

CAPACITY = 4096
#: Id that ends every document.
END = 1
#: Groups of large lengths, over a quarter of the capacity: three of them share a sequence at most.
GROUPS = 192
#: Slots of a plan that are sent to the executors at most (the plan's size depends on the capacity, not on the corpus).
MAX_SLOTS = 2_000_000
#: Bytes of pieces and their ids that a worker keeps.
CACHE_BYTES = 12 << 20

#: White space that does not part chunks; they are left to the library.
_SPACE = r"[\x1C-\x1F\x{85}\x{A0}\x{1680}\x{180E}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"

#: Words that are cut without the library, after its normaliser: lower-case letters of Latin, Greek and Cyrillic, which
#: are letters to every version of Unicode, and ASCII punctuation without the apostrophe.
_WORD = r"^(?P<letters>[a-z\x{DF}-\x{F6}\x{F8}-\x{24F}\x{3B1}-\x{3C9}\x{430}-\x{45F}]+)(?P<marks>[!-&(-/:-@\[-`{-~]*)$"


def _replaced(strings: pa.Array, at: np.ndarray, others: pa.Array) -> pa.Array:
    mask = np.zeros(len(strings), bool)
    mask[at] = True
    return pc.replace_with_mask(strings, pa.array(mask), others)


def _merged_rows(special: np.ndarray, whole: list[list[int]], plain: np.ndarray, ids: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids and their numbers of the rows ``special``, in lists, and ``plain``, flat, in the order of the rows."""
    held, begin = np.empty(len(special) + len(plain), np.int64), np.empty(len(special) + len(plain), np.int64)
    held[plain], held[special] = count, [len(x) for x in whole]
    begin[plain], begin[special] = offsets(count)[:-1], len(ids) + offsets(held[special])[:-1]
    return gather(np.concatenate([ids, np.array([i for x in whole for i in x], ids.dtype)]), begin, held), held


class WordTokenizer:
    """Ids of the library's tokenizer, every distinct white-space chunk of a batch cut once and every piece merged once."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer, pre_tokenizers

        self.whole = Tokenizer.from_file(path)
        # merges pieces that are cut already, joined by blanks; only a piece's last id ends a word
        self.merger = Tokenizer.from_file(path)
        self.merger.normalizer, self.merger.pre_tokenizer = None, pre_tokenizers.CharDelimiterSplit(" ")
        vocab = self.whole.get_vocab()
        self.last = np.zeros(max(vocab.values()) + 1, bool)
        self.last[[i for x, i in vocab.items() if x.endswith("</w>")]] = True
        # how the library's byte level shows each byte: printable Latin-1 as itself, the rest from U+0100 on
        shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
        hidden = [b for b in range(256) if b not in set(shown)]
        self.byte_level = {b: b for b in shown} | {b: 256 + i for i, b in enumerate(hidden)}
        # pieces merged before, their numbers of ids, and their ids one after another
        self.known, self.size, self.ids = pa.array([], pa.large_string()), np.empty(0, np.int64), np.empty(0, np.int32)
        self.edge = regex.compile(r"(\p{L}+)([!-&(-/:-@\[-`{-~]*)")

    def _merged(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of pieces (not empty, without blanks, as the byte level shows them), one after another, and their numbers."""
        if not len(pieces):
            return np.empty(0, np.int32), np.empty(0, np.int64)
        ids = np.array(self.merger.encode_batch_fast([" ".join(pieces.to_pylist())], add_special_tokens=False)[0].ids, np.int32)
        end = np.flatnonzero(self.last[ids]) + 1
        if len(end) != len(pieces) or end[-1] != len(ids):  # a vocabulary without some last characters
            found = [[t.id for t in self.whole.model.tokenize(x)] for x in pieces.to_pylist()]
            return np.array([i for x in found for i in x], np.int32), np.array([len(x) for x in found], np.int64)
        return ids, np.diff(end, prepend=0)

    def _look_up(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The ids' flat array, and where the ids of each of the distinct pieces start in it and how many they are."""
        found = pc.index_in(pieces, value_set=self.known)
        at = pc.fill_null(found, -1).to_numpy(zero_copy_only=False).astype(np.int64)
        fresh = pieces.filter(pc.is_null(found))
        at[at < 0] = np.arange(len(self.known), len(self.known) + len(fresh))
        ids, count = self._merged(fresh)
        flat, size = np.concatenate([self.ids, ids]), np.concatenate([self.size, count])
        start, count = offsets(size)[at], size[at]
        if self.known.nbytes + fresh.nbytes + flat.nbytes + size.nbytes <= CACHE_BYTES:
            self.known, self.ids, self.size = pa.concat_arrays([self.known, fresh]), flat, size
        else:  # the next batch begins with pieces of this one
            taken = np.cumsum(pc.binary_length(pieces).to_numpy(zero_copy_only=False) + 4 * count + 16)
            n = int(np.searchsorted(taken, CACHE_BYTES // 2))
            self.known, self.size = pieces.take(pa.array(np.arange(n))), count[:n].copy()
            self.ids = gather(flat, start[:n], self.size)
        return flat, start, count

    def _shown(self, letters: pa.Array) -> pa.Array:
        """Pieces of letters as the byte level shows them, all at once."""
        if not len(letters):
            return letters
        return pa.array("\n".join(letters.to_pylist()).encode().decode("latin-1").translate(self.byte_level | {10: 10}).split("\n"), letters.type)

    def _pieces(self, word: str) -> list[str]:
        """The pieces of a normalised word."""
        cut = self.edge.fullmatch(word)
        if cut:
            return [cut[1].encode().decode("latin-1").translate(self.byte_level), *([cut[2]] if cut[2] else [])]
        return [piece for piece, _ in self.whole.pre_tokenizer.pre_tokenize_str(word)]

    def _normalised(self, chunks: pa.Array) -> pa.Array:
        """Chunks without any white space as the library's normaliser leaves them.  Of ASCII it only changes the case."""
        words = pc.ascii_lower(chunks)
        foreign = np.flatnonzero(~pc.string_is_ascii(chunks).to_numpy(zero_copy_only=False))
        if not len(foreign):
            return words
        found = chunks.take(pa.array(foreign)).to_pylist()
        plain = self.whole.normalizer.normalize_str("\n".join(found)).split(" ")
        if len(plain) != len(found):
            plain = [self.whole.normalizer.normalize_str(x) for x in found]
        return _replaced(words, foreign, pa.array(plain, words.type))

    def encode_chunks(self, chunks: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Chunks are normalised together; a word of common letters with or without punctuation after it is cut here, all
        such words at once, any other chunk by the library's own splitter, and the library's model merges the pieces."""
        odd = pc.match_substring_regex(chunks, _SPACE).to_numpy(zero_copy_only=False)
        if odd.any():
            ids, count = self.encode_chunks(chunks.filter(pa.array(~odd)))
            whole = [self.whole.encode(x, add_special_tokens=False).ids for x in chunks.filter(pa.array(odd)).to_pylist()]
            return _merged_rows(np.flatnonzero(odd), whole, np.flatnonzero(~odd), ids, count)
        words = self._normalised(chunks)
        cut = pc.extract_regex(words, _WORD)
        known = pc.is_valid(cut).to_numpy(zero_copy_only=False)
        letters, marks = (pc.fill_null(pc.struct_field(cut, x), "").filter(pa.array(known)) for x in ("letters", "marks"))
        others = [self._pieces(x) for x in words.filter(pa.array(~known)).to_pylist()]
        marked = pc.not_equal(marks, "").to_numpy(zero_copy_only=False)
        # a word's first piece, a known word's second one, and the further pieces of others; equal pieces are merged once
        foreign = np.flatnonzero(~pc.string_is_ascii(letters).to_numpy(zero_copy_only=False))
        if len(foreign):
            one = letters.take(pa.array(foreign)).dictionary_encode()
            letters = _replaced(letters, foreign, self._shown(one.dictionary).take(one.indices))
        every = pa.concat_arrays([letters, marks.filter(pa.array(marked)), pa.array([x for word in others for x in word], pa.large_string())]).dictionary_encode()
        flat, begins, sizes = self._look_up(every.dictionary)
        at = every.indices.to_numpy()
        # pieces in the order of their words
        held = np.zeros(len(words), np.int64)
        held[known] = 1 + marked
        held[~known] = [len(x) for x in others]
        first = offsets(held)[:-1]
        piece = np.empty(len(at), np.int64)
        begin = first[known]
        piece[begin] = at[: len(begin)]
        second = begin[marked] + 1
        piece[second] = at[len(begin) : len(begin) + len(second)]
        piece[gather(np.arange(len(at)), first[~known], held[~known])] = at[len(begin) + len(second) :]
        start, count = begins[piece], sizes[piece]
        return gather(flat, start, count), np.diff(offsets(count)[offsets(held)])

    def encode_column(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of a text column and their number per row; null counts as empty.  A text that may hold one of the
        tokenizer's special tokens, which the library knows by their strings, is left to the library."""
        special = np.flatnonzero(pc.fill_null(pc.match_substring(column, "<|"), False).to_numpy(zero_copy_only=False))
        if not len(special):
            return self._encode_plain(column)
        plain = np.setdiff1d(np.arange(len(column)), special)
        ids, count = self._encode_plain(column.take(pa.array(plain)))
        whole = [self.whole.encode(x, add_special_tokens=False).ids for x in column.take(pa.array(special)).to_pylist()]
        return _merged_rows(special, whole, plain, ids, count)

    def _encode_plain(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        words = split_words(column)
        used = np.bincount(words.code, minlength=len(words.vocab)) > 0
        size = np.zeros(len(used), np.int64)
        flat, size[used] = self.encode_chunks(words.vocab.filter(pa.array(used)))
        count = size[words.code]
        return gather(flat, offsets(size)[words.code], count), np.diff(offsets(count)[words.offset])


@lru_cache(maxsize=2)
def load(path: str) -> WordTokenizer:
    return WordTokenizer(path)


_PIECES = pa.schema([(x, pa.int64()) for x in ("part", "doc_id", "piece", "start", "length", "ids_crc32", "place")])
_PIECES_DDL = "part long, doc_id long, piece long, start long, length long, ids_crc32 long, place long"


def _cut(path: str, capacity: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer, part = load(path), TaskContext.get().partitionId()
        seen = np.zeros(capacity + 1, np.int64)  # pieces of each length so far in this partition
        for batch in text_slices(batches, limit=1 << 22):
            ids, count = tokenizer.encode_column(batch.column("text"))
            edge = offsets(count)
            ended = np.full(len(ids) + len(count), END, np.uint32)
            keep = np.ones(len(ended), bool)
            keep[edge[1:] + np.arange(len(count))] = False
            ended[keep] = ids
            total = count + 1
            pieces = -(-total // capacity)
            doc = np.repeat(np.arange(len(total)), pieces)
            number = np.arange(len(doc)) - offsets(pieces)[:-1][doc]
            start = number * capacity
            length = np.minimum(total[doc] - start, capacity)
            begin = (edge[:-1] + np.arange(len(count)))[doc] + start
            raw = ended.astype("<u4").tobytes()
            crc = [zlib.crc32(raw[4 * a : 4 * (a + n)]) for a, n in zip(begin.tolist(), length.tolist(), strict=True)]
            order = np.argsort(length, kind="stable")
            same = np.searchsorted(length[order], length[order])
            place = np.empty(len(doc), np.int64)
            place[order] = np.arange(len(doc)) - same
            place += seen[length]
            seen += np.bincount(length, minlength=capacity + 1)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(doc), part)), batch.column("doc_id").take(pa.array(doc)), pa.array(number), pa.array(start), pa.array(length), pa.array(crc, pa.int64()), pa.array(place)], schema=_PIECES)

    return frugal(work)


def token_pieces(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """Tokenize every whole text, end it with id 1 and cut it into pieces of at most ``capacity`` ids."""
    path = path or public_tokenizers.path("word_bpe_49k.json")
    plain = arrow_batches(docs).select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"))
    return plain.mapInArrow(_cut(path, capacity), _PIECES_DDL)


def optimised(sizes: list[int], demand: list[int], capacity: int, most: int = 5000) -> list[tuple[tuple[int, ...], int]]:
    """Configurations (at most three group numbers) and how often to take each: the linear program of the fewest
    sequences over all configurations, by the revised simplex method with columns made when they are needed, rounded down.

    It starts from one size a sequence; the column that enters is the configuration worth most at the sizes' dual
    prices, and an optimum is reached when none is worth more than a sequence (or after ``most`` steps)."""
    basis: list[tuple[int, ...]] = [(g,) for g in range(len(sizes))]
    inverse, times, size = np.eye(len(sizes)), np.array(demand, float), np.array(sizes)
    room = capacity - size[:, None] - size[None, :]  # beside two groups, for a third one
    fits = room >= 0
    room = np.maximum(room, 0)
    for _ in range(most):
        price = inverse.sum(0)
        # the group worth most in every room, -1 for none
        third, worth = np.full(capacity + 1, -1), np.zeros(capacity + 1)
        for g in np.argsort(price, kind="stable").tolist():
            if price[g] > 0:
                third[size[g] :], worth[size[g] :] = g, price[g]
        pair = np.where(fits, price[:, None] + price[None, :] + worth[room], 0)
        a, b = np.unravel_index(pair.argmax(), pair.shape)
        enter = (int(price.argmax()),) if pair[a, b] <= price.max() else tuple(sorted(int(g) for g in (a, b, third[room[a, b]]) if g >= 0))
        column = np.bincount(enter, minlength=len(sizes))
        if price @ column <= 1 + 1e-6:
            break
        change = inverse @ column
        able = np.flatnonzero(change > 1e-9)
        leave = int(able[(times[able] / change[able]).argmin()])
        step = max(0.0, times[leave] / change[leave])
        times -= step * change
        times[leave] = step
        row = inverse[leave] / change[leave]
        inverse -= np.outer(change, row)
        inverse[leave] = row
        basis[leave] = enter
    return [(config, int(n + 1e-6)) for config, n in zip(basis, times.tolist(), strict=True) if n + 1e-6 >= 1]


def plan(histogram: dict[int, int], capacity: int = CAPACITY, groups: int = GROUPS) -> list[tuple[int, int, int, int]]:
    """Slots (length, count, first sequence, offset) that place all pieces of a histogram {length: number}: the plan
    with the fewest sequences over two numbers of groups."""
    plans = [_plan(histogram, capacity, max(1, n)) for n in (groups // 4, groups)]
    return min(plans, key=lambda slots: max((first + count for _, count, first, _ in slots), default=0))


def _plan(histogram: dict[int, int], capacity: int, groups: int) -> list[tuple[int, int, int, int]]:
    slots: list[tuple[int, int, int, int]] = []
    sequence = 0
    room: dict[int, list[tuple[int, int]]] = {}  # room left -> [(first sequence, number of sequences)]
    small = capacity // 4  # longer pieces are large
    large = [(n, histogram[n]) for n in sorted(histogram, reverse=True) if n > small and histogram[n]]
    loose = {n: count for n, count in histogram.items() if n <= small}  # what goes by best fit
    total = sum(n for _, n in large)
    if total:
        # groups of equal cardinality; a length may be split between two
        queues: list[list[list[int]]] = [[]]
        quota, left = -(-total // groups), -(-total // groups)
        for length, count in large:
            while count:
                if not left:
                    queues.append([])
                    left = quota
                take = min(left, count)
                queues[-1].append([length, take])
                count, left = count - take, left - take
        sizes = [q[0][0] for q in queues]
        demand = [sum(n for _, n in q) for q in queues]

        def substitute(group: int, count: int) -> list[tuple[int, int]]:
            """The next ``count`` real lengths of a group, largest first, as runs."""
            out = []
            while count:
                head = queues[group][0]
                take = min(head[1], count)
                out.append((head[0], take))
                head[1] -= take
                count -= take
                if not head[1]:
                    queues[group].pop(0)
            return out

        for config, most in sorted(optimised(sizes, demand, capacity)):
            need = Counter(config)
            times = min(most, *(demand[g] // n for g, n in need.items()))
            if not times:
                continue
            runs = []
            for group in config:
                demand[group] -= times
                runs.append(substitute(group, times))
            # cut the sequences of this configuration where a real length changes
            cuts = sorted({0, *(int(x) for run in runs for x in np.cumsum([n for _, n in run]))})
            at = [0] * len(runs)
            done = [0] * len(runs)
            for a, b in zip(cuts, cuts[1:], strict=False):
                used = 0
                for i, run in enumerate(runs):
                    while done[i] + run[at[i]][1] <= a:
                        done[i] += run[at[i]][1]
                        at[i] += 1
                    slots.append((run[at[i]][0], b - a, sequence + a, used))
                    used += run[at[i]][0]
                room.setdefault(capacity - used, []).append((sequence + a, b - a))
            sequence += times
        for queue in queues:
            for length, count in queue:
                loose[length] = loose.get(length, 0) + count
    # best fit: the sequence with the least room that still holds the piece
    rooms = sorted(room)

    def add(size: int, first: int, n: int) -> None:
        if n and size:
            if not room.setdefault(size, []):
                at = bisect.bisect_left(rooms, size)
                if at == len(rooms) or rooms[at] != size:
                    rooms.insert(at, size)
            room[size].append((first, n))

    for length in sorted(loose, reverse=True):
        count = loose[length]
        while count:
            i = bisect.bisect_left(rooms, length)
            if i == len(rooms):
                each = capacity // length
                add(capacity, sequence, -(-count // each))
                sequence += -(-count // each)
                continue
            size = rooms[i]
            if not room[size]:
                rooms.pop(i)
                continue
            first, n = room[size].pop()
            each = size // length
            full = min(n, count // each)
            for k in range(each if full else 0):
                slots.append((length, full, first, capacity - size + k * length))
            count -= full * each
            add(size - each * length, first, full)
            if full < n:
                rest = min(count, each - 1) if count < each else 0
                for k in range(rest):
                    slots.append((length, 1, first + full, capacity - size + k * length))
                count -= rest
                if rest:
                    add(size - rest * length, first + full, 1)
                add(size, first + full + bool(rest), n - full - bool(rest))
    return slots


def _placed(slots: list[tuple[int, int, int, int]], capacity: int):
    """Rank within a length -> sequence and offset, for Arrow batches."""
    table = np.array(slots, np.int64).reshape(-1, 4)
    table = table[np.argsort(table[:, 0], kind="stable")]
    begin = offsets(table[:, 1])[:-1]
    first_of_length = np.searchsorted(table[:, 0], table[:, 0])
    rank0 = begin - begin[first_of_length] if len(table) else begin
    key = (table[:, 0] << 44) | rank0

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            at = np.searchsorted(key, (length << 44) | rank, side="right") - 1
            yield pa.RecordBatch.from_arrays([batch.column(x) for x in ("doc_id", "piece", "start", "length", "ids_crc32")] + [pa.array(table[at, 2] + rank - rank0[at]), pa.array(table[at, 3])], names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return work


def pack(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, groups: int = GROUPS) -> DataFrame:
    """Pack all documents (doc_id, text, ...) into sequences of at most ``capacity`` tokens.

    Returns one row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.  A null or empty text is
    one piece that holds only the end id.  Texts are taken whole, however long.  Repeated rows are packed as often as they
    occur; doc_id may be null; other columns are ignored; an empty table gives an empty result.
    """
    pieces = staged(token_pieces(docs, path, capacity), "pieces")
    counts = pieces.groupBy("part", "length").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = staged(counts.withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0))), "ranks")
    # at most ``capacity`` rows, however large the corpus
    histogram = {r["length"]: r["n"] for r in base.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    slots = plan(histogram, capacity, groups)
    if len(slots) > MAX_SLOTS:
        raise ValueError(f"a plan of {len(slots)} slots; use fewer groups")
    # joined by merging, as both sides grow with the corpus
    ranked = pieces.join(base.select("part", "length", "base").hint("merge"), ["part", "length"]).withColumn("rank", F.col("base") + F.col("place"))
    columns = ["doc_id", "piece", "start", "length", "ids_crc32", "rank"]
    placed = ranked.select(*columns).mapInArrow(_placed(slots, capacity), "doc_id long, piece long, start long, length long, ids_crc32 long, sequence_id long, offset long")
    return placed.withColumn("piece", F.col("piece").cast("int"))
