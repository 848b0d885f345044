"""Near duplicates by improved consistent weighted sampling over TF-IDF shingles.

A text's shingles are runs of five words; a shingle weighs its count in the text times the mean inverse document
frequency of its words, counted over all documents in a hashed table of fixed size.  Each of ``BANDS * ROWS`` samples
of a text is the shingle and quantised weight that consistent weighted sampling draws, so two texts agree on a sample
with the probability of their weighted Jaccard similarity.  Texts that share a whole band are candidates, and a
candidate pair counts once its exact weighted Jaccard similarity is at least 0.8.

Texts of equal words are one node.  A band's bucket is led by the node that shares most buckets with most others, which
is the source of a group of copies where the group has one.  Every node goes home to the leader it shares most buckets
with; homes are cut into blocks of bounded size, and in a block pairs are compared exactly until each pair is either
compared or of one class.  Then the nodes of all buckets of a leader meet, where they still are of several classes and
were not all in one block at home: all nodes outside the largest class meet all others, again in blocks of bounded size,
and pairs that share a bucket, agree on enough samples and were not together at home are compared exactly.  So a group
of copies costs about its members, not their pairs, and no round follows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from boardsift.llm.common import arrow_batches, drop_staged, frugal, numbered, staged, text_slices, without_rows
from boardsift.llm.ragged import offsets
from boardsift.llm.text import bare_words
from boardsift.llm.treesum import partial_rows, tree_sum

SHINGLE = 5
SIMILARITY = 0.8
BANDS, ROWS = 15, 4
#: Buckets of the table of document frequencies.
BUCKETS = 1 << 20
#: Pairs of different homes that agree on a smaller share of all samples are not compared exactly: 0.8 less four and a
#: half standard deviations, by which one pair in 100,000 of similarity 0.8 is overlooked; bands alone miss 4 in 10,000.
#: With 0 every pair that shares a band is compared.
AGREE = 0.56
#: Bytes of shingles of a block, and of one shingle: 32 bits of its hash, and its weight.  Two texts of a thousand
#: shingles have one of them in common by chance about once in 4,000 times, which moves their similarity by a thousandth.
BLOCK_BYTES, EACH = 16 << 20, 8
#: Bits of the map that thins out texts nobody compares, for each text that is compared, and at most.
BITS_EACH, MOST_BITS = 64, 1 << 27
#: Shingles sampled at once, which stay in a core's cache.
CHUNK = 1 << 15
_TABLE = 16
_BLOCKS = 64
_TEXT = "text"


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(BUCKETS, np.int64)
    for batch in text_slices(batches, limit=2 << 20):
        words, hashed = bare_words(batch.column(_TEXT))
        if len(words.code):
            bucket = (hashed % np.uint64(BUCKETS)).astype(np.int64)[words.code]
            np.add.at(total, np.unique(words.doc * BUCKETS + bucket) % BUCKETS, 1)  # once a document, in whatever case
    yield partial_rows(total, _BLOCKS)


def inverse_frequencies(docs: DataFrame) -> np.ndarray:
    """Smoothed inverse document frequency by word bucket, over all documents; its size is the same for any corpus."""
    rows = arrow_batches(docs).select(docs[_TEXT].cast("string").alias(_TEXT))
    count = tree_sum(rows, _frequencies, BUCKETS, _BLOCKS, "int64", "frequencies")
    total = docs.count()
    return (1 + np.log((1 + total) / (1 + count))).astype(np.float32)


@lru_cache(maxsize=1)
def _draws() -> tuple[np.ndarray, ...]:
    """Fixed random draws of the sampling: r and ln c from Gamma(2, 1), beta uniform, and odd multipliers."""
    random = np.random.default_rng(80_11)
    n = 1 << _TABLE
    r = random.gamma(2, 1, n).astype(np.float32)
    return r, (1 / r).astype(np.float32), np.log(random.gamma(2, 1, n)).astype(np.float32), random.random(n, np.float32), random.integers(0, 1 << 63, BANDS * ROWS, np.uint64) * np.uint64(2) + np.uint64(1)


def shingles(column: pa.Array, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles (hash, weight) of every text, sorted by text and hash, where each text's start, and a 128-bit
    hash of each text's words in order.  A text of fewer than five words is one shingle; one without words has none."""
    words, hashed = bare_words(column)
    n = len(words.offset) - 1
    word = hashed[words.code] if len(hashed) else np.empty(0, np.uint64)
    value = idf[(word % np.uint64(BUCKETS)).astype(np.int64)]
    count = np.diff(words.offset)
    width = np.minimum(count, SHINGLE)
    number = np.where(count > 0, np.maximum(count - SHINGLE + 1, 1), 0)
    doc = np.repeat(np.arange(n, dtype=np.int32), number)
    first = np.arange(len(doc)) - np.repeat(offsets(number)[:-1] - words.offset[:-1], number)
    key, weight = np.zeros(len(doc), np.uint64), np.zeros(len(doc), np.float32)
    for i in range(SHINGLE if len(word) else 0):
        there = i < width[doc]
        at = np.minimum(first + i, len(word) - 1)
        key = np.where(there, (key ^ word[at]) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(i + 1), key)
        weight += np.where(there, value[at], 0)
    key ^= key >> np.uint64(29)
    if len(doc):
        weight /= width[doc]
    # the order of a text's words matters for the hash that finds equal texts
    total = np.zeros((n, 2), np.uint64)
    if len(word):
        position = (np.arange(len(word)) - np.repeat(words.offset[:-1], count)).astype(np.uint64)
        full = np.flatnonzero(count)
        for i, (a, b, c) in enumerate(((0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB), (0x8EBC6AF09C88C6E3, 0x589965CC75374CC3, 0x1D8E4E27C47D124F))):
            mixed = (word ^ (position * np.uint64(a))) * np.uint64(b)
            mixed ^= mixed >> np.uint64(32)
            total[full, i] = np.add.reduceat(mixed * np.uint64(c), words.offset[:-1][full]) ^ count[full].astype(np.uint64)
    order = np.lexsort((key, doc))
    key, doc, weight = key[order], doc[order], weight[order]
    new = np.ones(len(key), bool)
    new[1:] = (key[1:] != key[:-1]) | (doc[1:] != doc[:-1])
    begin = np.flatnonzero(new)
    times = np.diff(np.append(begin, len(key)))
    start = np.searchsorted(doc[begin], np.arange(n + 1))
    return key[begin], weight[begin] * times.astype(np.float32), start, total


def signatures(key: np.ndarray, weight: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Samples of every text that has shingles (rows) by improved consistent weighted sampling, in 16 bits each."""
    full = np.flatnonzero(np.diff(start))
    out = np.zeros((len(full), BANDS * ROWS), np.uint16)
    begin, end = start[:-1][full], start[1:][full]
    a = 0
    while a < len(full):
        z = max(a + 1, int(np.searchsorted(end, begin[a] + CHUNK, side="right")))
        part = slice(begin[a], end[z - 1])
        _sample(key[part], weight[part], begin[a:z] - begin[a], end[a:z] - begin[a:z], out[a:z])
        a = z
    return out


def _sample(key: np.ndarray, weight: np.ndarray, begin: np.ndarray, size: np.ndarray, out: np.ndarray) -> None:
    r, inverse, log_c, beta, odd = _draws()
    log_weight = np.log(weight)
    for j in range(len(odd)):
        mixed = key * odd[j]
        slot = (mixed >> np.uint64(64 - _TABLE)).view(np.int64)
        shift = beta[slot]
        t = np.floor(log_weight * inverse[slot] + shift)
        a = t - shift
        a += 1
        a *= r[slot]
        np.subtract(log_c[slot], a, out=a)
        least = np.minimum.reduceat(a, begin)
        at = np.flatnonzero(a == np.repeat(least, size))
        owner = np.searchsorted(begin, at, side="right") - 1
        at = at[np.concatenate([[True], owner[1:] != owner[:-1]])]  # of equal draws that of the smallest shingle
        sample = (mixed[at] ^ (t[at].astype(np.int64).view(np.uint64) * np.uint64(0xD6E8FEB86659FD93))) * np.uint64(0x9E3779B97F4A7C15)
        out[:, j] = (sample >> np.uint64(48)).astype(np.uint16)


def _lists(rows: np.ndarray, there: np.ndarray) -> pa.Array:
    """A list of numbers per row of ``there``: null, or the next row of ``rows``."""
    edge = offsets(np.where(there, rows.shape[1], 0)).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(edge), pa.array(rows.ravel()), mask=pa.array(~there))


def _sign(idf):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, limit=1 << 20):
            key, weight, start, total = shingles(batch.column(_TEXT), idf.value)
            there = np.diff(start) > 0
            # texts without words are equal where they are the same text
            for i in np.flatnonzero(~there).tolist():
                same = xxhash.xxh3_128_intdigest(batch.column(_TEXT)[i].as_py() or "")
                total[i] = same >> 64, same & ((1 << 64) - 1)
            bands = signatures(key, weight, start).view(np.uint64).view(np.int64)  # the samples of a band are one number
            hashed = [pa.array(np.ascontiguousarray(total[:, i]).view(np.int64)) for i in range(2)]
            yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("doc_id"), *hashed, _lists(bands, there)], names=["row", "doc_id", "same", "also", "bands"])

    return frugal(work)


def _marked(batches: Iterator[pa.RecordBatch], bit_map) -> Iterator[pa.RecordBatch]:
    """The rows whose slots are in a bit map."""
    for batch in batches:
        at = batch.column("slot").to_numpy()
        yield batch.filter(pa.array(((bit_map.value[at >> 6] >> (at & 63)) & 1).astype(bool)))


def _only_marked(bit_map):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _marked(batches, bit_map):
            yield batch.select(["node", "shingles"])

    return frugal(work)


def _shingled(idf, bit_map):
    """node, size, shingles (their hashes, then their weights) of the texts in a bit map of row numbers."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _marked(batches, bit_map):
            for part in text_slices([batch], limit=1 << 20):
                key, weight, start, _ = shingles(part.column(_TEXT), idf.value)
                edge = start.tolist()
                short = (key >> np.uint64(32)).astype(np.uint32)
                found = [short[a:z].tobytes() + weight[a:z].tobytes() for a, z in zip(edge, edge[1:], strict=False)]
                yield pa.RecordBatch.from_arrays([part.column("row"), pa.array(np.diff(start) * EACH), pa.array(found, pa.large_binary()).cast(pa.binary())], names=["node", "size", "shingles"])

    return frugal(work)


def weighted_jaccard(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    _, x, y = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    least = np.minimum(a[1][x], b[1][y]).sum(dtype=np.float64)
    most = a[1].sum(dtype=np.float64) + b[1].sum(dtype=np.float64) - least
    return float(least / most) if most else 1.0


def links_of(vectors: list[bytes], label: np.ndarray, side: np.ndarray, similarity: float, first: int | None = None) -> list[tuple[int, int]]:
    """Links among the members of a block that join all its classes of similar texts: every pair of members of
    different sides (of any, where there is one side only) is compared or belongs to one class already.

    A member is compared with all others at once, the first one first.  Members of the largest class are never asked
    for, as every other member asks for them."""
    size = np.array([len(v) // EACH for v in vectors])
    start = offsets(size)
    key = np.concatenate([np.frombuffer(v, np.uint32, n) for v, n in zip(vectors, size.tolist(), strict=True)])
    weight = np.concatenate([np.frombuffer(v, np.float32, n, 4 * n) for v, n in zip(vectors, size.tolist(), strict=True)])
    unique, code = np.unique(key, return_inverse=True)
    code = code.astype(np.int32)
    total = np.add.reduceat(weight.astype(np.float64), start[:-1])
    dense = np.zeros(len(unique), np.float32)
    group = np.unique(label, return_inverse=True)[1]
    done = np.zeros(len(vectors), bool)
    crossing = side.min() != side.max()
    links = []
    while True:
        if first is None:
            waiting = np.flatnonzero(~done & (group != np.bincount(group).argmax()))
            if not len(waiting):
                return links
            first = int(waiting[0])
        one, first = first, None
        done[one] = True
        # the similarity is at most the ratio of the total weights
        other = (group != group[one]) & ~done & (np.minimum(total, total[one]) >= similarity * np.maximum(total, total[one]) * (1 - 1e-9))
        if crossing:
            other &= side != side[one]
        at = np.flatnonzero(other)
        if not len(at):
            continue
        own = slice(start[one], start[one + 1])
        dense[code[own]] = weight[own]
        edge = offsets(size[at])
        index = np.repeat(start[at] - edge[:-1], size[at]) + np.arange(edge[-1])
        least = np.add.reduceat(np.minimum(dense[code[index]], weight[index]).astype(np.float64), edge[:-1])
        dense[code[own]] = 0
        hit = at[least >= similarity * (total[one] + total[at] - least)]
        links += [(one, i) for i in hit.tolist()]
        group[np.isin(group, group[hit])] = group[one]


_LINKS = "left long, right long"


def _link_table(node: np.ndarray, links: list[tuple[int, int]]) -> pa.Table:
    pair = node[np.array(links, np.int64).reshape(-1, 2)]
    return pa.table({"left": pa.array(pair[:, 0], pa.int64()), "right": pa.array(pair[:, 1], pa.int64())})


def _home_links(similarity: float):
    def work(key, table):
        node = table.column("node").to_numpy()
        leader = int(np.flatnonzero(table.column("leads").to_numpy())[0])
        side = np.zeros(len(node), np.int64)
        return _link_table(node, links_of(table.column("shingles").to_pylist(), node, side, similarity, leader))

    return work


def _meeting_links(similarity: float):
    def work(key, table):
        node = table.column("node").to_numpy()
        return _link_table(node, links_of(table.column("shingles").to_pylist(), table.column("label").to_numpy(), table.column("side").to_numpy(), similarity))

    return work


_MEETING = "leader long, kind int, one int, two int, node long, label long, side int"


def _in_doubt(samples: np.ndarray, label: np.ndarray, side: np.ndarray, node: np.ndarray, home: np.ndarray, spot: np.ndarray) -> np.ndarray:
    """Which members of a block have a partner of another class that shares a band with them, agrees with them on
    enough samples and was not with them in a block (spot) at home, where the leader is in all blocks."""
    doubt = np.zeros(len(label), bool)
    crossing = side.min() != side.max()
    whole = np.asfortranarray(np.ascontiguousarray(samples).view(np.uint64).reshape(len(samples), BANDS))
    main = np.unique(label, return_inverse=True)[1]
    main = main == np.bincount(main).argmax()
    for i in np.flatnonzero(~main).tolist():
        shares = whole[:, 0] == whole[i, 0]
        for band in range(1, BANDS):
            shares |= whole[:, band] == whole[i, band]
        shares &= label != label[i]
        shares &= ~(((home == home[i]) & (spot == spot[i])) | (home == node[i]) | (node == home[i]))
        if crossing:
            shares &= side != side[i]
        at = np.flatnonzero(shares)
        at = at[np.count_nonzero(samples[at] == samples[i], axis=1) >= AGREE * BANDS * ROWS]
        if len(at):
            doubt[i] = True
            doubt[at] = True
    return doubt


def _doubtful(key, table):
    samples = table.column("bands").combine_chunks().flatten().to_numpy().view(np.uint16).reshape(table.num_rows, BANDS * ROWS)
    keep = _in_doubt(samples, *(table.column(x).to_numpy() for x in ("label", "side", "node", "home", "spot")))
    return table.select([x.split()[0] for x in _MEETING.split(", ")]).filter(pa.array(keep))


def components(edges: DataFrame) -> DataFrame:
    """node and label (the smallest node) of the connected components of edges (left, right).

    Every node takes the smallest label beside it, then the label of its label, until nothing changes.  Each round is
    written to the shared folder.
    """
    both = staged(edges.select(F.col("left").alias("node"), F.col("right").alias("other")).unionByName(edges.select(F.col("right").alias("node"), F.col("left").alias("other"))).distinct(), "edges")
    labels = staged(both.groupBy("node").agg(F.least(F.min("other"), F.col("node")).alias("label")), "labels")
    while True:
        beside = both.join(labels.withColumnRenamed("node", "other").withColumnRenamed("label", "near"), "other").groupBy("node").agg(F.min("near").alias("near"))
        nearer = labels.join(beside, "node").select("node", F.col("label").alias("was"), F.least("label", "near").alias("label"))
        jump = labels.select(F.col("node").alias("label"), F.col("label").alias("jump"))
        moved = staged(nearer.join(jump, "label", "left").select("node", "was", F.least("label", "jump").alias("label")), "labels")
        changed = not moved.where("label <> was").isEmpty()
        drop_staged(labels)
        labels = moved.drop("was")
        if not changed:
            drop_staged(both)
            return labels


def _bit_map(wanted: DataFrame, slot, bits: int) -> np.ndarray:
    """Bits of the slots of ``wanted``."""
    words = wanted.select(slot.alias("slot")).distinct().groupBy((F.col("slot") / 64).cast("long").alias("word")).agg(F.expr("bit_or(shiftleft(1L, cast(slot % 64 as int)))").alias("mask"))
    found = words.toArrow()  # bits / 64 rows at most
    table = np.zeros(bits // 64, np.int64)
    table[found.column("word").to_numpy()] = found.column("mask").to_numpy()
    return table


def _marks(wanted: DataFrame):
    """A broadcast bit map of the wanted nodes, its bits, and how many are wanted."""
    asked = wanted.count()
    bits = min(MOST_BITS, max(1 << 16, 1 << int(BITS_EACH * asked).bit_length()))
    return wanted.sparkSession.sparkContext.broadcast(_bit_map(wanted, F.pmod(F.xxhash64("node"), F.lit(bits)), bits)), bits, asked


def _vectors(source: DataFrame, idf, wanted: DataFrame) -> DataFrame:
    """node, size and shingles of the wanted rows (node), and perhaps of a few others.  Rows are thinned out by a bit
    map, so that texts nobody asks for are neither cut into shingles nor moved.  Where more are wanted than the largest
    map can tell apart, a join drops the others."""
    bit_map, bits, asked = _marks(wanted)
    slotted = arrow_batches(source).select("row", _TEXT, F.pmod(F.xxhash64("row"), F.lit(bits)).alias("slot"))
    found = slotted.mapInArrow(_shingled(idf, bit_map), "node long, size long, shingles binary")
    return staged(found if BITS_EACH * asked <= MOST_BITS else found.join(wanted, "node", "left_semi"), "vectors")


def _thinned(vectors: DataFrame, wanted: DataFrame) -> DataFrame:
    """node and shingles of the wanted nodes, and perhaps of a few others: what a join with them needs to move."""
    bit_map, bits, _ = _marks(wanted)
    slotted = arrow_batches(vectors).select("node", "shingles", F.pmod(F.xxhash64("node"), F.lit(bits)).alias("slot"))
    return slotted.mapInArrow(_only_marked(bit_map), "node long, shingles binary")


def _meetings(mixed: DataFrame) -> DataFrame:
    """Rows (leader, node, label, home, spot, size) of leaders of several classes, dealt to blocks: all nodes outside a
    leader's largest class meet those of that class (kind 0) and each other (kind 1)."""
    by_class = mixed.groupBy("leader", "label").agg(F.count("*").alias("n"), F.sum("size").alias("size"))
    largest = by_class.groupBy("leader").agg(F.max(F.struct("n", F.col("label").alias("main"), F.col("size").alias("inside"))).alias("top"), F.sum("size").alias("size"), F.count("*").alias("classes"))
    blocks = lambda size: F.greatest(F.lit(1), F.ceil(size / BLOCK_BYTES)).cast("int")
    largest = largest.where("classes > 1").select("leader", F.col("top.main").alias("main"), blocks(F.col("top.inside")).alias("inside"), blocks(F.col("size") - F.col("top.inside")).alias("outside"))
    dealt = mixed.join(largest, "leader").withColumn("in_main", F.col("label") == F.col("main"))
    dealt = dealt.withColumn("block", F.pmod(F.xxhash64("node"), F.when(F.col("in_main"), F.col("inside")).otherwise(F.col("outside"))).cast("int"))
    # a node of the largest class meets every block outside, one outside every block of the class and every other block outside
    place = lambda kind, one, two, side: F.struct(F.lit(kind).alias("kind"), one.alias("one"), two.alias("two"), F.lit(side).alias("side"))
    block, zero = F.col("block"), F.lit(0)
    meets = F.transform(F.sequence(zero, F.col("outside") - 1), lambda j: place(0, block, j, 0))
    asks = F.transform(F.sequence(zero, F.col("inside") - 1), lambda i: place(0, i, block, 1))
    as_left = F.transform(F.sequence(block, F.col("outside") - 1), lambda j: place(1, block, j, 0))
    as_right = F.transform(F.filter(F.sequence(zero, block), lambda i: i < block), lambda i: place(1, i, block, 1))
    own = ["node", "label", "home", "spot"]
    return dealt.select("leader", *own, F.explode(F.when(F.col("in_main"), meets).otherwise(F.concat(asks, as_left, as_right))).alias("p")).select("leader", "p.kind", "p.one", "p.two", *own, "p.side")


def near_duplicates(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """Classes of near duplicates among ``docs`` (doc_id, text, ...).

    Returns one row per input row: row (a row number), doc_id, class_row and class_id (the smallest row of
    the class by doc_id, null last, then row; and its doc_id), class_size, first (whether the row is that one).
    Texts of equal words belong together; a text without words, null included, only with the very same text.  Texts of
    fewer than five words are one shingle.  Repeated rows are copies; other columns are ignored; an empty table gives
    an empty result.
    """
    source, _ = numbered(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias(_TEXT)))
    return _classes(source, similarity)


def _links(source: DataFrame, idf, nodes: DataFrame, similarity: float) -> DataFrame:
    """Pairs of nodes (node, bands) that join all similar ones."""
    bucket = ["band", "value"]
    members = nodes.where("bands IS NOT NULL").select("node", F.posexplode("bands").alias("band", "value"))
    # counted in place, as the rows of a bucket have to meet anyway
    bands = staged(members.withColumn("n", F.count("*").over(Window.partitionBy(*bucket))).where("n > 1"), "bands")
    rank = bands.groupBy("node").agg(F.sum("n").alias("degree"))
    leaders = bands.join(rank, "node").groupBy(*bucket).agg(F.max(F.struct("degree", (-F.col("node")).alias("minus"))).alias("top")).select(*bucket, (-F.col("top.minus")).alias("leader"), F.col("top.degree").alias("degree"))
    shares = staged(bands.join(leaders, bucket).groupBy("node", "leader").agg(F.count("*").alias("shared"), F.first("degree").alias("degree")), "shares")
    home = shares.where("node <> leader").groupBy("node").agg(F.max(F.struct("shared", "degree", (-F.col("leader")).alias("minus"))).alias("top"))
    home = staged(home.select("node", (-F.col("top.minus")).alias("leader")), "home")
    vectors = _vectors(source, idf, bands.select("node").distinct())
    blocks = staged(home.join(vectors.select("node", "size"), "node").groupBy("leader").agg(F.ceil(F.sum("size") / BLOCK_BYTES).cast("int").alias("blocks")), "blocks")
    at = home.join(blocks, "leader").select("leader", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int").alias("block"), "node")
    led = at.withColumn("leads", F.lit(0))
    leading = blocks.select("leader", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.col("leader").alias("node"), F.lit(1).alias("leads"))
    at_home = led.unionByName(leading).join(vectors.select("node", "shingles"), "node")
    found = staged(at_home.groupBy("leader", "block").applyInArrow(_home_links(similarity), _LINKS), "links")
    labels = components(found)
    labelled = shares.select("leader", "node").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    # pairs that were in one block at home are settled, which are all pairs of a leader of one block without guests
    placed = labelled.join(at.select("node", F.col("leader").alias("home"), F.col("block").alias("spot")), "node", "left").withColumns({"home": F.coalesce("home", "node"), "spot": F.coalesce("spot", F.lit(-1))})
    follows = F.col("node") != F.col("leader")
    settled = F.coalesce(F.min(F.when(follows, F.col("home") == F.col("leader"))) & (F.min(F.when(follows, F.col("spot"))) == F.max(F.when(follows, F.col("spot")))), F.lit(True))
    several = placed.groupBy("leader").agg((F.min("label") != F.max("label")).alias("mixed"), settled.alias("settled")).where("mixed AND NOT settled").select("leader")
    mixed = staged(placed.join(several, "leader").join(vectors.select("node", "size"), "node"), "mixed")
    meeting = _meetings(mixed).join(nodes.select("node", "bands"), "node")
    group = ["leader", "kind", "one", "two"]
    doubtful = staged(meeting.groupBy(*group).applyInArrow(_doubtful, _MEETING), "doubtful")
    more = doubtful.join(_thinned(vectors, doubtful.select("node").distinct()), "node").groupBy(*group).applyInArrow(_meeting_links(similarity), _LINKS)
    out = staged(found.unionByName(more), "links")
    for table in (bands, shares, home, vectors, blocks, found, mixed, doubtful, labels):
        drop_staged(table)
    return out


def _classes(source: DataFrame, similarity: float) -> DataFrame:
    """What :func:`near_duplicates` returns, of rows (row, doc_id, text) whose numbers are written."""
    idf = source.sparkSession.sparkContext.broadcast(inverse_frequencies(source))
    signed = staged(arrow_batches(source).mapInArrow(_sign(idf), "row long, doc_id long, same long, also long, bands array<long>"), "signatures")
    # texts of equal words are one node, named by its first row; their samples are the same
    nodes = staged(signed.groupBy("same", "also").agg(F.min("row").alias("node"), F.first("bands").alias("bands")), "nodes")
    labels = components(_links(source, idf, nodes, similarity))
    placed = signed.select("row", "doc_id", "same", "also").join(nodes.select("same", "also", "node"), ["same", "also"]).join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    placed = staged(placed.select("row", "doc_id", "label"), "classes")
    for table in (signed, nodes, labels):
        drop_staged(table)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row"))
    classes = placed.groupBy("label").agg(first.alias("first"), F.count("*").alias("class_size"))
    many = staged(classes.where("class_size > 1").select("label", F.col("first.doc_id").alias("class_id"), F.col("first.row").alias("class_row"), "class_size"), "many")
    out = placed.join(many, "label", "left")
    alone = F.col("class_size").isNull()
    return out.select("row", "doc_id", F.coalesce("class_row", "row").alias("class_row"), F.when(alone, F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"), F.coalesce("class_size", F.lit(1)).cast("long").alias("class_size"), (alone | (F.col("class_row") == F.col("row"))).alias("first"))


def keep_one_of_each(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """``docs`` with one document of each class: the first by doc_id, null last; all columns stay, whatever their
    names.  Null texts, short texts, repeated rows and empty tables are handled as by :func:`near_duplicates`."""
    docs, name = numbered(docs)
    source = docs.select(F.col(name).alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias(_TEXT))
    return without_rows(docs, name, staged(_classes(source, similarity).where(~F.col("first")).select("row"), "lost"))
