"""The pipeline's operators against brute force, round trips and held-out accuracy, on small tables with nulls, ties,
empty and long texts, repeated rows, extra columns and no rows at all."""

import base64
import bisect
import gzip
import hashlib
import io
import random
import re
import time
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
import xxhash
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, GreaterThan, In
from tokenizers import Tokenizer

from boardsift.llm.text import EDGE_CHARACTERS
from boardsift.llm import byte_bpe, chat, exact_dedup, hamming, licenses, minhash, packing, quality, queries, toxicity, warc

SF, LARGER = "/root/testdata/sf0.001", "/root/testdata/sf0.1"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, row long, score double"


def words(n, seed):
    r = random.Random(seed)
    return " ".join("".join(r.choice("abcdeo") for _ in range(r.randint(2, 7))) for _ in range(n))


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, "en", None, None if t is None else len(t), 1, 0.5) for i, t in rows], DOCS)


@pytest.fixture(scope="module")
def odd(spark):
    base = words(200, 1)
    near = base.split()
    near[50] = "changed"
    rows = [(5, base), (3, base), (3, base), (None, base), (7, " ".join(near)), (8, "  " + base.replace(" ", "\n") + " "), (9, None), (10, ""), (11, "é中 \U0001f600 it's"), (12, "a"), (13, words(30000, 2)), (14, words(100, 3))]
    return docs_of(spark, rows)


def test_exact_duplicates(spark, odd):
    found = exact_dedup.exact_duplicates(odd).collect()
    assert len(found) == 12
    groups = defaultdict(list)
    for r in found:
        groups[r["text_sha256"]].append(r)
    big = max(groups.values(), key=len)
    assert {r["keep_id"] for r in big} == {8} and {r["group_size"] for r in big} == {5}
    assert all(sum(r["kept"] for r in g) == 1 for g in groups.values())
    kept = exact_dedup.drop_exact_duplicates(odd)
    assert kept.columns == odd.columns and kept.count() == len(groups)
    assert exact_dedup.exact_duplicates(odd.limit(0)).count() == 0


def test_exact_duplicates_of_many_runs(spark):
    rows = docs_of(spark, [(i, f"text {i % 37}") for i in range(600)]).repartition(40)
    found = exact_dedup.exact_duplicates(rows).collect()
    assert all(r["keep_id"] == min(i for i in range(600) if i % 37 == r["doc_id"] % 37) for r in found)


def test_runs_merge_like_one_sort():
    """Any number of runs, in any order of partners, against the rule applied to all rows; texts that share a digest
    but not the fingerprint are two groups."""
    r = random.Random(8)
    for turn in range(20):
        keys = [bytes([r.randrange(3)]) * 31 + bytes([r.randrange(4) * 64, r.randrange(2)]) + bytes(exact_dedup.KEY - 33) for _ in range(6)]
        rows = [(r.choice(keys), r.randrange(3), *r.choice([(0, 5), (0, 7), (1, 0)]), i) for i in range(80)]
        runs = {}
        for k in r.sample(range(16), r.randint(1, 16)):
            runs[k] = []
        for x in rows:
            runs[r.choice(list(runs))].append(x)
        leaf = lambda part: exact_dedup.leaf_run([x[0] for x in part], *(np.array([x[i] for x in part], np.int64) for i in range(1, 5)))
        found = exact_dedup.merge_runs({k: exact_dedup.Run.unpacked(leaf(part).packed()) for k, part in runs.items() if part})
        want = defaultdict(list)
        for x in rows:
            want[x[0]].append(x)
        got = {k.ljust(exact_dedup.KEY, b"\0"): (c, no, i, row, n) for k, c, no, i, row, n in zip(*(x.tolist() for x in found))}
        best = {k: min(part, key=lambda x: (-x[1], x[2], x[3], x[4])) for k, part in want.items()}
        assert got == {k: (*best[k][1:], len(part)) for k, part in want.items()}
        assert sorted(want) == [k.ljust(exact_dedup.KEY, b"\0") for k in found.key.tolist()]


def test_near_duplicates(spark, odd):
    found = {(r["doc_id"], r["row"]): r for r in minhash.near_duplicates(odd).collect()}
    classes = {k[0]: r["class_id"] for k, r in found.items()}
    assert classes[5] == classes[3] == classes[7] == classes[8] == classes[None] == 3
    assert classes[9] == classes[10] == 9 and classes[12] == 12 and classes[14] == 14
    kept = minhash.keep_one_of_each(odd)
    assert kept.columns == odd.columns and kept.count() == 6
    assert minhash.near_duplicates(odd.limit(0)).count() == 0


def brute_force_classes(rows):
    """Smallest id of each class of texts (id, text): all pairs by their definition, without the operator's code."""
    split = {i: [w for w in (x.lower().strip(EDGE_CHARACTERS) for x in re.split(r"[ \t\n\v\f\r]+", t or "")) if w] for i, t in rows}
    bucket = lambda w: xxhash.xxh3_64_intdigest(w) % minhash.BUCKETS
    seen = Counter(b for words in split.values() for b in {w: bucket(w) for w in set(words)}.values())
    idf = lambda w: float(np.float32(1 + np.log((1 + len(rows)) / (1 + seen[bucket(w)]))))
    weights = {}
    for i, words in split.items():
        width = min(5, len(words))
        runs = Counter(tuple(words[k : k + width]) for k in range(max(1, len(words) - 4) if words else 0))
        weights[i] = {run: n * sum(map(idf, run)) / width for run, n in runs.items()}
    text, label = dict(rows), {i: i for i in weights}
    for a in weights:
        for b in (x for x in weights if x < a):
            if weights[a] and weights[b]:
                least = sum(min(w, weights[b][run]) for run, w in weights[a].items() if run in weights[b])
                similar = least / (sum(weights[a].values()) + sum(weights[b].values()) - least) >= 0.8
            else:
                similar = not weights[a] and not weights[b] and (text[a] or "") == (text[b] or "")
            if similar and label[a] != label[b]:
                old, new = max(label[a], label[b]), min(label[a], label[b])
                label = {i: new if x == old else x for i, x in label.items()}
    return label


def test_near_duplicates_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    classes = {r["doc_id"]: r["class_id"] for r in minhash.near_duplicates(docs).collect()}
    want = brute_force_classes([(r["doc_id"], r["text"]) for r in docs.collect()])
    assert classes == want and len(set(want.values())) < len(want)


@pytest.mark.parametrize("changes", [1, 2])
def test_large_near_group_in_blocks(spark, monkeypatch, changes):
    """A group whose members differ from each other more than from their source, in buckets of several blocks; with
    two changes most members are similar to few others."""
    base = words(120, 9).split()
    rows = []
    for i in range(150):
        own, r = list(base), random.Random(i)
        for k in range(changes):
            own[r.randrange(120)] = f"w{i}.{k}"
        rows.append((i, " ".join(own)))
    monkeypatch.setattr(minhash, "BLOCK_BYTES", 16 * minhash.EACH * 116)
    found = {r["doc_id"]: r["class_id"] for r in minhash.near_duplicates(docs_of(spark, rows)).collect()}
    assert found == brute_force_classes(rows)
    if changes == 1:
        assert set(found.values()) == {0}


def rows_written(monkeypatch):
    """Rows of the tables that near_duplicates writes from here on, by name."""
    found, write = {}, minhash.staged

    def counted(df, tag):
        out = write(df, tag)
        found[tag] = out.count()
        return out

    monkeypatch.setattr(minhash, "staged", counted)
    return found


def changed(base, every, name):
    return " ".join(f"{name}.{k}" if k % every == 3 else w for k, w in enumerate(base.split()))


def test_pairs_of_one_home_do_not_meet_again(spark, monkeypatch):
    """Texts that share buckets, but are too different, are compared once: their shingles are not moved again."""
    rows = [(i, base) for i in range(0, 80, 2) for base in [words(150, i)]] + [(i + 1, changed(words(150, i), 37, f"w{i}")) for i in range(0, 80, 2)]
    written = rows_written(monkeypatch)
    found = {r["doc_id"]: r["class_id"] for r in minhash.near_duplicates(docs_of(spark, rows)).collect()}
    assert found == brute_force_classes(rows)
    assert written["home"] > 20 and len(set(found.values())) > 60
    assert written["mixed"] == 0 and written["doubtful"] == 0


def test_guests_of_a_leader_meet(spark, monkeypatch):
    """Texts that drift apart word by word are similar to some at other homes, in classes that only meetings join."""
    rows, r = [], random.Random(4)
    for family in range(12):
        own = words(200, 100 + family).split()
        for i in range(25):
            rows.append((family * 25 + i, " ".join(own)))
            for k in range(r.choice([2, 3, 4, 5])):
                own[r.randrange(200)] = f"w{family}.{i}.{k}"
    written = rows_written(monkeypatch)
    found = {r["doc_id"]: r["class_id"] for r in minhash.near_duplicates(docs_of(spark, rows)).collect()}
    assert found == brute_force_classes(rows)
    assert written["doubtful"] > 0 and 12 < len(set(found.values())) < 300


def test_doubt_is_of_pairs_apart_at_home():
    """Every pair of other classes that agrees stays in doubt, unless both were in one block or one led the other."""
    r = np.random.default_rng(5)
    for turn in range(40):
        n = 14
        node, label, side = r.permutation(50)[:n], r.integers(0, 9, n), r.integers(0, 2, n) if turn % 2 else np.zeros(n, int)
        home, spot = np.where(r.random(n) < 0.8, r.choice(node, n), node), r.integers(0, 2, n)
        samples = np.where(r.random((n, minhash.BANDS * minhash.ROWS)) < 0.15, r.integers(1, 9, (n, 1)), 0).astype(np.uint16)
        together = lambda a, b: (home[a] == home[b] and spot[a] == spot[b]) or home[a] == node[b] or home[b] == node[a]
        bands = samples.reshape(n, minhash.BANDS, minhash.ROWS)
        agree = lambda a, b: (bands[a] == bands[b]).all(axis=1).any() and (samples[a] == samples[b]).mean() >= minhash.AGREE
        crossing = len(set(side.tolist())) > 1
        pairs = [(a, b) for a in range(n) for b in range(a) if label[a] != label[b] and (not crossing or side[a] != side[b]) and agree(a, b) and not together(a, b)]
        assert set(np.flatnonzero(minhash._in_doubt(samples, label, side, node, home, spot)).tolist()) == {x for pair in pairs for x in pair}


def test_links_of_a_block_against_all_pairs():
    """Every class that all pairs would join is joined, whatever sides and classes the members start with."""
    r = np.random.default_rng(2)
    for turn in range(30):
        n = 25
        texts = [" ".join(f"w{x}" for x in np.where(r.random(30) < 0.06, r.integers(100, 10**6, 30), np.arange(30))) for _ in range(n)]
        idf = np.ones(minhash.BUCKETS, np.float32)
        key, weight, start, _ = minhash.shingles(pa.array(texts), idf)
        part = [(key[a:z], weight[a:z]) for a, z in zip(start, start[1:])]
        label, side = r.integers(0, 20, n), r.integers(0, 2, n) if turn % 2 else np.zeros(n, int)
        pairs = [(a, b) for a in range(n) for b in range(a) if minhash.weighted_jaccard(part[a], part[b]) >= 0.8 and (not turn % 2 or side[a] != side[b])]
        found = minhash.links_of([(k >> np.uint64(32)).astype(np.uint32).tobytes() + w.tobytes() for k, w in part], label, side, 0.8, 3 if turn % 3 else None)
        assert {tuple(sorted(x)) for x in found} <= {tuple(sorted(x)) for x in pairs}

        def classes(edges):
            own = label.copy()
            for a, b in [*edges, *edges, *edges] * n:
                own[own == max(own[a], own[b])] = min(own[a], own[b])
                if len(edges) == 0:
                    break
            return own.tolist()

        assert classes(found) == classes(pairs)


def test_byte_bpe_equals_tiktoken(spark, odd):
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb"))}
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    bpe = byte_bpe.load(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    r = random.Random(3)
    texts = ["", None, " ", "  a  b ", "a\n \nb", "it's 's", "aaaa" * 300, "ab" * 400] + ["".join(r.choice(" \n\t\r  ab'sé漢 1２!?\x1c") for _ in range(r.randint(1, 50))) for _ in range(2000)]
    ids, count = bpe.encode_column(pa.array(texts))
    edge = np.concatenate([[0], np.cumsum(count)])
    assert all(ids[edge[i] : edge[i + 1]].tolist() == own.encode_ordinary(t or "") for i, t in enumerate(texts))
    encoded = byte_bpe.encode(odd)
    back = {(x["doc_id"], bytes(x["bytes"]).decode()) for x in byte_bpe.decode(encoded).collect()}
    assert back == {(x["doc_id"], x["text"] or "") for x in odd.collect()}
    assert byte_bpe.round_trip_digests(odd.limit(0)).count() == 0


def test_packing(spark, odd):
    odd = odd.unionByName(docs_of(spark, [(20, "a <|endoftext|> b"), (20, "<|STARTOFTEXT|>x"), (21, "<| no <|endoftext| "), (22, "<|endoftext|>" * 3)]))
    found = packing.pack(odd).collect()
    own = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = defaultdict(int)
    for r in odd.collect():
        ids = own.encode(r["text"] or "", add_special_tokens=False).ids + [1]
        for k in range(0, len(ids), 4096):
            want[r["doc_id"], k // 4096, k, len(ids[k : k + 4096]), zlib.crc32(np.array(ids[k : k + 4096], "<u4").tobytes())] += 1
    got = defaultdict(int)
    for r in found:
        got[r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]] += 1
    assert got == want
    sequences = defaultdict(list)
    for r in found:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in sequences.values():
        parts.sort()
        assert parts[0][0] == 0 and sum(n for _, n in parts) <= 4096
        assert all(a + n == b for (a, n), (b, _) in zip(parts, parts[1:]))
    assert packing.pack(odd.limit(0)).count() == 0


def test_plan_is_near_the_bound():
    r = np.random.default_rng(0)
    lengths = np.clip(np.exp(r.normal(6.4, 1.1, 20000)).astype(int) + 1, 1, 4096)
    histogram = {int(k): int(v) for k, v in zip(*np.unique(lengths, return_counts=True))}
    slots = packing.plan(histogram)
    assert max(f + n for _, n, f, _ in slots) <= 1.005 * lengths.sum() / 4096 + 1
    assert packing.plan({}) == []


def best_fit_decreasing(lengths, capacity):
    rooms, count = [], 0
    for n in sorted(lengths, reverse=True):
        at = bisect.bisect_left(rooms, n)
        room = rooms.pop(at) if at < len(rooms) else capacity
        count += room == capacity
        bisect.insort(rooms, room - n)
    return count


@pytest.mark.parametrize("kind", range(6))
def test_plans_against_best_fit_decreasing(kind):
    """Plans place every piece once, without overlap, in hardly more sequences than best fit; where one length is a
    third of all and small pieces are few as well."""
    r = np.random.default_rng(kind)
    lengths = np.concatenate([np.full(1500 if kind % 2 else 0, 1500), r.integers(1000, 4097, 3000), r.integers(1, 900, (30, 3000, 0)[kind % 3])])
    histogram = {int(k): int(v) for k, v in zip(*np.unique(lengths, return_counts=True))}
    slots = packing.plan(histogram)
    sequences, placed = defaultdict(list), Counter()
    for n, count, first, offset in slots:
        placed[n] += count
        for k in range(count):
            sequences[first + k].append((offset, n))
    assert placed == histogram and sorted(sequences) == list(range(len(sequences)))
    for parts in sequences.values():
        parts.sort()
        assert parts[0][0] == 0 and sum(parts[-1]) <= 4096 and all(a + n == b for (a, n), (b, _) in zip(parts, parts[1:]))
    assert len(sequences) <= 1.01 * best_fit_decreasing(lengths.tolist(), 4096) + 1


def test_configurations_are_optimised():
    """Sizes of which the fullest sequences first are not the fewest: the linear program finds the optimum."""
    found = packing.optimised([50, 30, 20], [100, 100, 100], 100)
    assert sum(n for _, n in found) == 100 and all(sum((50, 30, 20)[g] for g in c) == 100 for c, _ in found)


def test_warc(spark, tmp_path):
    rows = [(1, "http://a/\r\nX: y", "<p>same</p>"), (4, None, "<p>same</p>"), (2, "u%20", None), (3, "v", ""), (None, "n", "only é\r\n\r\nWARC/1.1")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    path = "file://" + str(tmp_path / "warc")
    warc.write_archives(pages, path)
    got = {r["page_id"]: r for r in warc.read_archives(spark, path, verify=True).collect() if r["record_type"] != "warcinfo"}
    assert got[1]["record_type"] == "revisit" and got[1]["refers_to"] == 4 and got[1]["payload_bytes"] == 11 and got[1]["payload"] is None
    assert got[1]["target_uri"] == "http://a/\r\nX: y" and got[4]["record_type"] == "response" and got[4]["target_uri"] is None
    assert got[2]["refers_to"] == 3 and got[2]["target_uri"] == "u%20" and bytes(got[None]["payload"]).decode() == rows[4][2]
    assert got[4]["payload_digest"] == base64.b32encode(hashlib.sha1(b"<p>same</p>").digest()).decode()
    some = warc.read_archives(spark, path).where("record_type = 'response' AND page_id IN (3, 4)")
    assert some.count() == 2
    assert warc.archive_round_trip(pages.limit(0)).count() == 0


def test_warc_plain_archives_skip_by_seeking(spark, tmp_path):
    pages = spark.createDataFrame([(i, "u", f"page {i}" * 50) for i in range(30)], "page_id long, url string, html string")
    warc.register(spark)
    warc.with_revisits(pages).write.format("warc").mode("append").option("compression", "none").save(str(tmp_path / "w"))
    found = warc.read_archives(spark, str(tmp_path / "w")).where("page_id = 17").collect()
    assert [bytes(r["payload"]).decode() for r in found] == ["page 17" * 50]


FOREIGN = (
    b"WARC/1.0\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <urn:uuid:1>\r\nContent-Type: application/warc-fields\r\nContent-Length: 9\r\n\r\na: b\r\nc: \r\n\r\n"
    b"WARC/1.0\r\nwarc-type: response\r\nWARC-Record-ID: <urn:uuid:2>\r\nWARC-Target-URI: http://x/%20%zz\r\nContent-Type: application/http;\r\n msgtype=response\r\nWARC-Payload-Digest: sha256:00\r\nContent-Length: 25\r\n\r\nHTTP/1.0 200 OK\r\n\r\nbody\r\n\r\n\r\n"
    b"WARC/1.0\r\nWARC-Type: revisit\r\nWARC-Record-ID: <urn:uuid:3>\r\nWARC-Refers-To: <urn:uuid:2>\r\nContent-Type: application/http\r\nContent-Length: 19\r\n\r\nHTTP/1.0 200 OK\r\n\r\n\r\n\r\n"
    b"WARC/1.0\r\nWARC-Type: resource\r\nWARC-Target-URI: caf\xe9\r\nContent-Type: text/plain\r\nContent-Length: 5\r\n\r\nplain\r\n\r\n"
    b"WARC/1.0\r\nWARC-Type: conversion\r\nContent-Length: 0\r\n\r\n\r\n\r\n"
)


@pytest.mark.parametrize("suffix", [".warc", ".warc.gz"])
def test_foreign_archives(spark, tmp_path, suffix):
    """Archives of other writers: any Refers-To, payloads of every type, other digests and encodings, folded headers."""
    pack = lambda data: data if suffix == ".warc" else b"".join(gzip.compress(b"WARC/" + x) for x in data.split(b"WARC/")[1:])
    (tmp_path / f"a{suffix}").write_bytes(pack(FOREIGN))
    got = {r["record_type"]: r for r in warc.read_archives(spark, str(tmp_path), verify=True).collect()}
    assert bytes(got["response"]["payload"]) == b"body\r\n" and got["response"]["target_uri"] == "http://x/%20%zz" and got["response"]["payload_digest"] == "sha256:00"
    assert got["revisit"]["payload"] is None and got["revisit"]["refers_to"] is None and got["revisit"]["refers_to_record"] == "<urn:uuid:2>"
    assert bytes(got["resource"]["payload"]) == b"plain" and got["resource"]["target_uri"] == "caf\xe9" and got["resource"]["payload_bytes"] == 5
    assert bytes(got["warcinfo"]["payload"]) == b"a: b\r\nc: " [:9] and bytes(got["conversion"]["payload"]) == b""
    # an archive that ends early, inside a header or a block, is an error whatever is asked of it
    whole = pack(FOREIGN)
    for cut in (len(whole) - 30, len(whole) // 2, 40):
        with open(tmp_path / f"a{suffix}", "wb") as out:
            out.write(whole[:cut])
        with pytest.raises(Exception, match="ends inside"):
            warc.read_archives(spark, str(tmp_path), payload=False).collect()


def test_inflation_is_bounded():
    """A member that inflates a thousandfold is read piece by piece."""
    zeros = 64 << 20
    data = gzip.compress(b"WARC/1.0\r\nWARC-Type: resource\r\nContent-Length: %d\r\n\r\n" % zeros + bytes(zeros) + b"\r\n\r\n")
    stream = warc._Bytes(io.BytesIO(data), True)
    assert stream.until(b"\r\n\r\n").startswith(b"WARC/1.0")
    stream.skip(zeros // 2)
    assert len(stream.buffer) <= warc.INFLATED
    stream.skip(zeros // 2 + 4)
    assert stream.until(b"x") is None


def test_pushed_predicates(spark, tmp_path, monkeypatch):
    reader = warc.WarcReader({"path": str(tmp_path)})
    left = list(reader.pushFilters([EqualTo(("record_type",), "response"), In(("page_id",), (1, 2)), GreaterThan(("payload_bytes",), 3)]))
    assert left == [GreaterThan(("payload_bytes",), 3)] and reader.wanted == {"record_type": {"response"}, "page_id": {1, 2}}
    pages = spark.createDataFrame([(i, "u", f"page {i % 7}" * 50) for i in range(30)], "page_id long, url string, html string")
    warc.write_archives(pages, str(tmp_path / "w"))
    some = warc.read_archives(spark, str(tmp_path / "w"), verify=True).where("record_type = 'response' AND page_id IN (25, 3)")
    plan = some._jdf.queryExecution().executedPlan().toString()
    assert "response" not in plan.split("BatchScan")[0]  # the reader filters, and Spark doesn't again
    assert [r["page_id"] for r in some.collect()] == [25]
    found = warc.read_archives(spark, str(tmp_path / "w")).where("record_type = 'revisit'").collect()
    responses = {r["record_id"]: r["page_id"] for r in warc.read_archives(spark, str(tmp_path / "w")).where("record_type = 'response'").collect()}
    assert len(found) == 23 and all(responses[r["refers_to_record"]] == r["refers_to"] for r in found)


def test_warc_of_odd_pages(spark):
    """Repeated rows, a column of a clashing name, and a payload of several megabytes."""
    long = words(1_000_000, 4)
    pages = spark.createDataFrame([(1, "a", "x", 5), (1, "a", "x", 6), (2, None, long, 7), (3, None, long, 7)], "page_id long, url string, html string, row int")
    got = sorted(warc.archive_round_trip(pages).collect(), key=str)
    assert [(r["page_id"], r["record_type"], r["refers_to"]) for r in got] == [(1, "response", None), (1, "revisit", 1), (2, "revisit", 3), (3, "response", None)]
    assert {r["payload_bytes"] for r in got} == {1, len(long)}


def test_chat(spark):
    said = ["\\### Assistant: </turn> ok", "\\\\h\\t", None, "", "####</turn></turn", "plain é"]
    rows = [(1, i, ("user", "assistant", "tool: x\n###")[i % 3], t) for i, t in enumerate(said)] + [(2, None, None, "x"), (None, 1, "assistant", "y"), (2, 1, "user", "z"), (2, 1, "user", "z")]
    found = {r["conv_id"]: r for r in chat.read_back(chat.format_turns(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))).collect()}
    text = "".join(f"{('user', 'assistant', 'tool: x' + chr(10) + '###')[i % 3]}\n{t or ''}\n" for i, t in enumerate(said))
    assert found[1]["turns_sha256"] == hashlib.sha256(text.encode()).hexdigest()
    loss = "".join(t or "" for i, t in enumerate(said) if i % 3 == 1)
    assert found[1]["loss_chars"] == len(loss) and found[1]["loss_sha256"] == hashlib.sha256(loss.encode()).hexdigest()
    assert found[2]["n_turns"] == 3 and found[None]["n_turns"] == 1
    assert all(chat.unescape(chat.escape(t)) == t and "###" not in chat.escape(t) and "</turn>" not in chat.escape(t) for t in said if t)
    assert chat.read_back(chat.format_turns(spark.createDataFrame([], "conv_id long, turn long, role string, text string"))).count() == 0


def test_licenses(spark):
    texts = [None, "", "MIT License mit-license", "x apache License, general public license", licenses.TEMPLATES["isc"][1].upper(), "mité license", "permission is hereby granted free of charge"]
    got = {r["doc_id"]: r for r in licenses.license_scan(docs_of(spark, list(enumerate(texts)))).collect()}
    for i, t in enumerate(texts):
        w = re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if c.isascii() else c for c in t or "").encode())
        places = sorted(p for phrase in licenses.BASE for p in range(len(w)) if w[p : p + len(phrase.split())] == [x.encode() for x in phrase.split()])
        assert (got[i]["n_words"], got[i]["n_base"], got[i]["starts"]) == (len(w), len(places), places)
    assert got[2]["base_labels"] == "mit" and got[3]["labels"] == "apache,gpl" and "isc" in got[4]["labels"] and got[6]["labels"] == ""
    assert licenses.license_scan(docs_of(spark, [])).count() == 0


def test_license_starts_against_every_start():
    """Texts made of licence words alone, whatever their frequencies: all places, labels and shares by trying every
    start of every template."""
    r = random.Random(6)
    vocabulary = licenses._vocabulary(licenses.BASE, licenses.TEMPLATES)
    index = licenses.PositionalIndex(licenses.BASE, licenses.TEMPLATES, {w: r.randrange(9) for w in vocabulary})
    phrases = list(licenses.BASE) + [x for pair in licenses.TEMPLATES.values() for x in pair]
    for turn in range(300):
        words = []
        for _ in range(r.randint(0, 6)):
            part = licenses.words_of(r.choice(phrases))
            cut = r.randrange(len(part))
            words += (part, part[cut:], part[:cut], [r.choice(vocabulary)] * 3, part[:cut] + [b"odd"] + part[cut + 1 :])[r.randrange(5)]
        places, labels, score = [], set(), 0.0
        for template, at, size, label, is_base in index.entries:
            for start in range(-len(template), len(words)):
                if start + at >= 0 and words[start + at : start + at + size] == template[at : at + size]:
                    share = sum(start + i >= 0 and words[start + i : start + i + 1] == [w] for i, w in enumerate(template)) / len(template)
                    places += [(start, label)] * is_base
                    labels |= {label} if is_base or share >= licenses.TEMPLATE_SHARE else set()
                    score = max(score, 1.0 if is_base else share)
        found = index.scan(words)
        assert (sorted(found[0]), *found[1:]) == (sorted(places), labels, score)


def test_hamming_against_brute_force(spark):
    r = np.random.default_rng(5)
    vectors = r.normal(size=(120, 64))
    vectors[40:80] = vectors[0]  # a third shares one code
    rows = [(i, v.tolist()) for i, v in enumerate(vectors)] + [(200, None), (None, [1.0]), (3, vectors[3].tolist())]
    codes = hamming.sign_codes(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    got = defaultdict(list)
    for x in hamming.top_k(codes, codes.where("vec_id % 10 = 0"), 5).orderBy("vec_id", "rank").collect():
        got[x["vec_id"]].append((x["distance"], x["neighbor_id"]))
    bits = vectors > 0
    for q in range(0, 120, 10):
        assert got[q] == sorted(((bits[q] != bits[i]).sum(), i) for i in range(120) if i != q)[:5]
    few = codes.where("vec_id < 3")
    assert hamming.top_k(few, few, 5).count() == 6
    assert hamming.top_k(codes.limit(0), codes.limit(0), 5).count() == 0


def test_gradients_of_the_recurrent_network():
    net = toxicity.Network()
    for k in net.p:
        net.p[k] = net.p[k].astype(np.float64)
    vocab = ["one", "two", "three", "x"]
    lex = toxicity.lexicon(vocab, np.arange(4, dtype=np.uint64) * np.uint64(77))
    index, target = np.random.default_rng(0).integers(0, 5, (4, toxicity.WINDOW)), np.array([1, 0, 1, 0])
    loss = lambda: np.logaddexp(0, -(2 * target - 1) * net.forward(net.features(lex).astype(np.float64), index)).mean()
    grad = net.gradients(lex, index, target)
    for k, w in net.p.items():
        at = tuple(np.unravel_index(np.abs(grad[k]).argmax(), w.shape))
        was, step = w[at], 1e-2
        w[at] = was + step
        up = loss()
        w[at] = was - step
        down = loss()
        w[at] = was
        assert abs((up - down) / (2 * step) - grad[k][at]) < 1e-4 + 0.01 * abs(grad[k][at])


def test_odd_rows_of_searches_scans_and_tokens(spark, odd):
    """Extra columns of clashing names, repeated rows, nulls and a text of many thousand words."""
    vectors = spark.createDataFrame([(i, [1.0 if i >> k & 1 else -1.0 for k in range(6)], 3, "x") for i in (*range(40), 7, 7)], "vec_id long, embedding array<double>, place int, code string")
    codes = hamming.sign_codes(vectors)
    wide = codes.withColumn("place", F.lit(1)).withColumn("n", F.lit(2)).withColumn("query", F.lit(3))
    assert sorted(hamming.top_k(wide, wide.where("vec_id = 7"), 3).collect()) == [(7, 1, 3, 1), (7, 2, 5, 1), (7, 3, 6, 1)]
    scanned = licenses.license_scan(odd.unionByName(docs_of(spark, [(40, "mit license " + words(60000, 7) + " MIT License")] * 2))).collect()
    assert len(scanned) == 14 and [r["n_base"] for r in scanned if r["doc_id"] == 40] == [2, 2] and {r["last_word"] for r in scanned if r["doc_id"] == 40} == {60002}
    digests = byte_bpe.round_trip_digests(odd.withColumn("ids", F.lit(1))).collect()
    text = {r["doc_id"]: r["text"] or "" for r in odd.collect()}
    assert len(digests) == 12 and all(r["decoded_sha256"] == hashlib.sha256(text[r["doc_id"]].encode()).hexdigest() for r in digests)
    assert {r["n_tokens"] for r in digests if r["doc_id"] in (9, 10)} == {0}
    long = words(50000, 8) + " </turn>"
    turns = spark.createDataFrame([(1, 0, "user", long, 5), (1, 1, "assistant", long, 6), (1, 1, "assistant", long, 7)], "conv_id long, turn long, role string, text string, start int")
    (found,) = chat.read_back(chat.format_turns(turns)).collect()
    assert found["n_turns"] == 3 and found["loss_chars"] == 2 * len(long) and found["loss_sha256"] == hashlib.sha256((long * 2).encode()).hexdigest()


CLASSIFIERS = [(quality.score_quality, quality.drop_low_quality, "quality"), (toxicity.score_toxicity, toxicity.drop_toxic, "toxic")]


@pytest.mark.parametrize(("score", "drop", "label"), CLASSIFIERS)
def test_held_out_accuracy(spark, score, drop, label):
    """Recall of either label on rows that no model has learned from; about one toxic label in twenty is on a text
    without any toxic word."""
    docs, labels = (spark.read.parquet(f"{LARGER}/{x}.parquet") for x in ("documents", "labels"))
    scored = score(docs, labels).join(labels, "doc_id").collect()
    assert all(0 <= r["score"] <= 1 and r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in scored)
    held = [r for r in scored if r["held_out"]]
    share = lambda value: np.mean([r["predicted"] == value for r in held if r[label] == value])
    assert len(held) > 700 and share(0) >= 0.98 and share(1) >= (0.9 if label == "toxic" else 0.98)


@pytest.mark.parametrize(("score", "drop", "label"), CLASSIFIERS)
def test_classifiers_on_odd_rows(spark, odd, score, drop, label):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    more = docs_of(spark, [(1000, None), (1001, ""), (1002, " ... \n"), (1003, None), (None, "text without an id"), (0, "a second row of an id"), (1004, words(20000, 5))])
    named = docs.select("doc_id", "text", "lang", "source", "n_chars", F.lit(1).alias("row"), F.lit(0.5).alias("score")).unionByName(more)
    scored = {(r["doc_id"], round(r["score"], 9)): r for r in score(named, labels).collect()}
    wordless = {r["score"] for (i, _), r in scored.items() if i in (1000, 1001, 1003)}
    assert len(wordless) == 1 and sum(i in (None, 1000, 1001, 1002, 1003, 1004) for i, _ in scored) == 6
    kept = drop(named, labels)
    assert kept.columns == named.columns
    rows = kept.collect()
    rejected = {i for (i, _), r in scored.items() if i and r["predicted"] == (label == "toxic")}
    assert rejected and {r["doc_id"] for r in rows if r["doc_id"]} == {i for i, _ in scored if i} - rejected
    # nothing is known from no labels, or from labels of one kind
    for few in (labels.limit(0), labels.withColumn(label, F.lit(int(label == "toxic")))):
        assert drop(odd, few).collect() == odd.collect() and score(odd, few).count() == 12
    assert score(odd.limit(0), labels).count() == 0 and drop(odd.limit(0), labels).count() == 0


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_oracles(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "conversations", "embeddings"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = con.sql(queries.ORACLES[name])
    columns = sorted(want.columns)
    plain = lambda x: None if x is None else round(float(x), 9) if isinstance(x, float) else x
    theirs = sorted((str([plain(x) for x in row]) for row in want.select(", ".join(f'"{c}"' for c in columns)).fetchall()))
    ours = sorted(str([plain(x) for x in row]) for row in queries.QUERIES[name](spark, SF).select(*columns).collect())
    assert ours == theirs


@pytest.mark.parametrize(("module", "label", "rare"), [(quality, "quality", 0), (toxicity, "toxic", 1)])
def test_capped_fit_agrees_with_whole_fit(spark, module, label, rare):
    """Nine in ten rows of the rare label and three in ten others read alike, so the labels' shares decide about them."""
    r = random.Random(4)
    rows = [(i, rare if i % 10 == 0 else 1 - rare) for i in range(2000)]
    marked = [r.random() < (0.9 if y == rare else 0.3) for _, y in rows]
    texts = [" ".join(r.choice(("bee", "bat", "bug") if m else ("ant", "ape", "auk")) for _ in range(20)) for m in marked]
    docs, labels = docs_of(spark, [(i, t) for (i, _), t in zip(rows, texts, strict=True)]), spark.createDataFrame(rows, f"doc_id long, {label} int")

    def predicted(max_rows):
        if module is toxicity:
            score = toxicity.fit(docs, labels, max_rows).probability(pa.array(texts))
        else:
            vectors, network, shift = quality.fit(docs, labels, max_rows)
            score = network.probability(quality.pooled(pa.array(texts), vectors.value), shift)
        return score >= module.THRESHOLD

    whole, capped = predicted(10**6), predicted(150)
    assert (whole == (1 - rare)).mean() > 0.99 and (whole == capped).mean() > 0.95


def test_row_numbers_survive_another_cut_of_the_files(spark, tmp_path, monkeypatch):
    """Every table written changes how many partitions the next scan of the same files has, as lost executors do."""
    base = [words(60, i) for i in range(12)]
    rows = [(i, base[i % 12] + (" extra" if i >= 12 else "")) for i in range(48)]
    docs_of(spark, rows).repartition(8).write.parquet(str(tmp_path / "docs"))
    pages = spark.createDataFrame([(i, "u", base[i % 12]) for i in range(48)], "page_id long, url string, html string")
    pages.repartition(8).write.parquet(str(tmp_path / "pages"))
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    turn = iter(range(1000))
    for module in (minhash, exact_dedup, warc):

        def cut(df, tag, before=module.staged):
            found = before(df, tag)
            spark.conf.set("spark.sql.files.minPartitionNum", (1, 16)[next(turn) % 2])
            return found

        monkeypatch.setattr(module, "staged", cut)
    try:
        read = lambda name: spark.read.parquet(str(tmp_path / name))
        near = {r["doc_id"]: r["class_id"] for r in minhash.near_duplicates(read("docs")).collect()}
        near_kept = sorted(r["doc_id"] for r in minhash.keep_one_of_each(read("docs")).collect())
        exact_kept = sorted(r["doc_id"] for r in exact_dedup.drop_exact_duplicates(read("docs")).collect())
        revisits = {r["page_id"]: r["refers_to"] for r in warc.with_revisits(read("pages")).collect()}
    finally:
        spark.conf.unset("spark.sql.files.minPartitionNum")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert near == {i: i % 12 for i in range(48)} and near_kept == list(range(12))
    assert exact_kept == list(range(24))
    assert revisits == {i: None if i >= 36 else 36 + i % 12 for i in range(48)}


def _cased_words(n, letters="abcdefghijklmnoprstuvwxyzéüñ"):
    r = np.random.default_rng(5)
    stems = ["".join(r.choice(list(letters), r.integers(3, 10))) for _ in range(2000)]
    marks = ["", "", ",", ".", ";", "!?", "'s", "-", ")", "...", "’", "1", " x"]
    change = [str, str.upper, str.title]
    return [change[r.integers(3)](stems[r.integers(2000)]) + marks[r.integers(len(marks))] for _ in range(n)]


def test_packing_ids_of_marked_words_are_the_librarys():
    tokenizer = packing.WordTokenizer(public_tokenizers.path("word_bpe_49k.json"))
    words = _cased_words(4000)
    odd = ["", None, " \n\t ", "\x1cA\x1dB", "été ́x", "İI ıſ ΑΣ ς", "<|endoftext|> <| x", "\x00 a\x00b", "don't we'LL", "ﬁn 東京abc ไทย١٢", "a" * 5000, "　a b\u0085c", "X﻿Y ​", "Ǆ ǅ ß ẞ ꞵ"]
    texts = [" ".join(words[i : i + 100]) for i in range(0, 4000, 100)] + odd
    want = [tokenizer.whole.encode(x or "", add_special_tokens=False).ids for x in texts]
    for kept in (12 << 20, 2000):  # also with a cache that is emptied in every batch
        with pytest.MonkeyPatch.context() as patch:
            patch.setattr(packing, "CACHE_BYTES", kept, raising=False)
            for batch in (range(len(texts)), range(0, len(texts), 2), range(40, len(texts)), range(40, 43)):
                ids, count = tokenizer.encode_column(pa.array([texts[i] for i in batch], pa.string()))
                assert ids.tolist() == [x for i in batch for x in want[i]] and count.tolist() == [len(want[i]) for i in batch]


def test_packing_cuts_words_all_at_once():
    """Distinct words with marks and capitals, each of which went through Python, take less than the library's time."""
    path = public_tokenizers.path("word_bpe_49k.json")
    text = " ".join(sorted(set(" ".join(_cased_words(60_000, "abcdefghilmnoprstu")).split())))

    def spent(tokenizer, encode):
        start = time.process_time()
        encode(tokenizer)
        return time.process_time() - start

    library = min(spent(Tokenizer.from_file(path), lambda t: t.encode(text, add_special_tokens=False)) for _ in range(3))
    ours = min(spent(packing.WordTokenizer(path), lambda t: t.encode_column(pa.array([text]))) for _ in range(3))
    assert ours < 0.7 * library
