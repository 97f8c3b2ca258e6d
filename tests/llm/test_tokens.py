import base64
import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest

tiktoken = pytest.importorskip("tiktoken")
P = pytest.importorskip("public_tokenizers")

from sparkmatch.llm import bpe, queries, token_counts, training_order  # noqa: E402

RANKS, PIECES = P.path("byte_bpe_50k.tiktoken"), P.path("piece_bpe_32k.model")
ALPHABET = ["a", "b", " ", "  ", "\n", "'", "s", "1", "²", "Ⅷ", "é", "́", "\x1c", "\x85", "\xa0", "漢", "😀", "_", "-", "▁", "▁▁", "ab", "the", "ing", "<s>", "<0x0A>", "\t", "\x00", "\r"]
EDGES = ["", " ", "\n\n", "a" * 20_000, "ab" * 5_000, "." * 3_000, " " * 2_000, "<|endoftext|>", "  lead", "trail  "]


def fuzz(seed, n=800):
    r = random.Random(seed)
    return EDGES + ["".join(r.choice(ALPHABET) for _ in range(r.randint(0, 40))) for _ in range(n)]


@pytest.fixture(scope="module")
def tik():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bpe_equals_the_library_and_decodes(tik):
    table, texts = bpe.load(RANKS, P.PATTERN), fuzz(1)
    for text, ids in zip(texts, table.encode_texts(texts), strict=True):
        assert ids.tolist() == tik.encode_ordinary(text)
        assert table.decode(ids.tolist()) == text.encode()


def test_long_runs_are_merged_in_packed_lists_alike(tik, monkeypatch):
    monkeypatch.setattr(bpe, "LISTED", 100)
    table, r = bpe.ByteBPE(bpe.load(RANKS, P.PATTERN).ranks, P.PATTERN), random.Random(4)
    for text in ["a" * 5000, "".join(r.choice("abcdeing") for _ in range(20_000)), "".join(r.choice("th ein the漢é") for _ in range(9000))]:
        assert table.encode_texts([text])[0].tolist() == tik.encode_ordinary(text)


def test_rank_queue_pops_in_order():
    q, r = bpe.RankQueue(60_000), random.Random(3)
    want = sorted({r.randrange(60_000) for _ in range(500)})
    for rank in r.sample(want, len(want)):
        q.push(rank, rank)
    assert [q.pop()[0] for _ in want] == want and q.pop() is None


def test_a_merge_that_makes_a_lower_rank_goes_back():
    ranks = {bytes([i]): i + 10 for i in range(256)} | {b"bc": 300, b"abc": 1}
    table = bpe.ByteBPE(ranks, P.PATTERN)
    assert [x.tolist() for x in table.encode_many([b"abc", b"bcbc", b""])] == [[1], [300, 300], []]


def test_piece_counts_equal_the_library():
    counter, table, ids = token_counts.load(PIECES), token_counts.counts(PIECES), token_counts.WordTable(token_counts.load(PIECES), as_ids=True)
    texts = fuzz(2) + ["plain words only here", "a\nb c", "xqzj 漢漢 \x00y", "the the the"]
    want = [counter.lib.encode(text) for text in texts]
    for _ in range(2):  # the second time from the table
        for block in (texts, [t for t in texts if "  " not in t], texts[-4:], []):
            own = [want[texts.index(t)] for t in block]
            assert table.totals(pa.array(block, pa.string())).tolist() == [len(x) for x in own]
            flat, n = ids.ids(pa.array(block, pa.string()))
            assert flat.tolist() == [i for x in own for i in x] and n.tolist() == [len(x) for x in own]
    assert counter.n_whole > 30_000


def test_queries_on_whole_tables(spark, sf, tik):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for r in queries.op1_byte_bpe(spark, sf).collect():
        ids = tik.encode_ordinary(docs[r.doc_id])
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(docs[r.doc_id].encode()).hexdigest()
    lib = token_counts.load(PIECES).lib
    for r in queries.op8_token_counts(spark, sf).collect():
        n = len(lib.encode(docs[r.doc_id]))
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(docs[r.doc_id].encode()), n, n > 4096)


def test_nulls_clashing_names_and_empty_tables(spark):
    df = spark.createDataFrame([(1, None, 5), (1, None, 5), (2, "", 6), (None, "a b", 7)], "doc_id long, text string, N_TOKENS int")
    got = sorted((r.n_tokens, r.text or "") for r in bpe.digest(df, RANKS, P.PATTERN).collect())
    assert got == [(0, ""), (0, ""), (0, ""), (2, "a b")]
    assert bpe.digest(df.limit(0), RANKS, P.PATTERN).count() == 0
    both = bpe.decode(bpe.encode(df, RANKS, P.PATTERN), RANKS, P.PATTERN)
    assert {bytes(r.decoded) for r in both.collect()} == {b"", b"a b"}
    assert sorted(r.n_tokens for r in token_counts.count_tokens(df, PIECES).collect()) == [0, 0, 0, 2]


def test_feistel_is_a_permutation_that_the_key_decides():
    for m in (1, 2, 3, 17, 1000):
        assert sorted(training_order.feistel(np.arange(m), m)) == list(range(m))
    assert (training_order.feistel(np.arange(1000), 1000, 1) != training_order.feistel(np.arange(1000), 1000, 2)).any()


def test_training_order_round_trip_and_resume(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    base = f"file://{tmp_path}/order"
    rows = training_order.write(docs, PIECES, base, length=64).collect()
    assert sorted(r.slot for r in rows) == list(range(len(rows)))
    slots = list(training_order.read(base))
    by = {}
    for r in sorted(rows, key=lambda r: (r.doc_id, r.part)):
        by.setdefault(r.doc_id, []).extend(slots[r.slot][: r.n_tokens].tolist())
    lib = token_counts.load(PIECES).lib
    assert by == {r.doc_id: lib.encode(r.text) + [lib.eos_id()] for r in docs.collect() if r.text}
    assert all((a == b).all() for a, b in zip(training_order.read(base, 100, 140), slots[100:140], strict=True))
    empty = spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string")
    assert training_order.write(empty, PIECES, f"file://{tmp_path}/none").count() == 0


def test_training_order_of_any_input_and_of_many_shards(spark, tmp_path):
    rows = [(i % 7 or None, f"text {i} " * (i % 40), i) for i in range(90)] + [(5, None, 0), (5, "  two   spaces ", 1), (5, "  two   spaces ", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, slot int").repartition(5).orderBy("slot")  # no file scan
    base = f"file://{tmp_path}/order"
    got = training_order.write(docs, PIECES, base, length=16, shard_slots=8).collect()
    lib = token_counts.load(PIECES).lib
    want = sorted(x for _, t, _ in rows if t for ids in [[*lib.encode(t), lib.eos_id()]] for x in [ids[i : i + 16] for i in range(0, len(ids), 16)])
    slots = list(training_order.read(base))
    assert sorted(slots[r.slot][: r.n_tokens].tolist() for r in got) == want and len(slots) == len(want)
    assert sorted(r.slot for r in got) == list(range(len(want))) and len({r.shard for r in got}) > 4
    ordered = sorted(got, key=lambda r: r.slot)
    assert all((b.shard, b.byte_offset) == (a.shard, a.byte_offset + 32) or (b.shard > a.shard and b.byte_offset == 0) for a, b in zip(ordered, ordered[1:], strict=False))
    again = training_order.write(docs, PIECES, f"file://{tmp_path}/again", length=16, key=9, shard_slots=8).collect()
    assert sorted(r.crc32 for r in again) == sorted(r.crc32 for r in got) and [r.crc32 for r in sorted(again, key=lambda r: r.slot)] != [r.crc32 for r in ordered]
