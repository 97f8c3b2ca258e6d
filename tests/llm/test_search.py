import random

import numpy as np
import pytest

pytest.importorskip("public_tokenizers")

from sparkmatch.llm import decontam, near_dup, queries, shingles, topk  # noqa: E402


def brute_top(rows, k):
    out = []
    for own, q in rows:
        if own % 100:
            continue
        scored = sorted((-sum(a * b for a, b in zip(q, v, strict=False)), i) for i, v in rows if i != own)[:k]
        out += [(own, r, i, -s) for r, (s, i) in enumerate(scored, 1)]
    return sorted(out)


def test_top_k_equals_brute_force_with_ties_and_bad_rows(spark, monkeypatch):
    r = random.Random(5)
    vectors = [(i, [float(r.randint(-3, 3)) / 4 for _ in range(6)]) for i in range(600)]
    bad = [(601, None), (602, [1.0, None, 0.0]), (603, [float("nan")] * 6), (604, [float("inf")] * 6), (None, [1.0] * 6)]
    df = spark.createDataFrame(vectors + bad, "vec_id long, embedding array<float>")
    monkeypatch.setattr(topk, "BLOCK_ROWS", 200)
    got = topk.search(df, df.where("vec_id % 100 = 0"), k=10).collect()
    want = brute_top([(i, [int(np.floor(1024 * x)) for x in v]) for i, v in vectors], 10)
    assert sorted((x.query_id, x.rank, x.vec_id, x.score) for x in got) == want
    assert topk.search(df.limit(0), df.limit(0)).count() == 0
    few = spark.createDataFrame(vectors[:4], "vec_id long, embedding array<float>")
    assert topk.search(few, few.where("vec_id = 0")).count() == 3


def test_top_k_equals_its_sql(spark):
    import duckdb

    con = duckdb.connect()
    con.execute("create view embeddings as select * from '/root/testdata/sf0.1/embeddings.parquet'")
    want = sorted(con.execute(queries.ORACLE_SQL["op2_top_k"]).fetchall())
    got = queries.op2_top_k(spark, "/root/testdata/sf0.1")
    assert got.columns == ["query_id", "rank", "vec_id", "score"] and sorted(map(tuple, got.collect())) == want and len(want) >= 200


def test_impact_index_proves_its_answers():
    r = np.random.default_rng(2)
    rows = r.integers(-300, 300, (3000, 16))
    index, ids = topk.ImpactIndex(np.arange(3000), rows), np.arange(3000)
    for q in range(0, 3000, 300):
        at, scores = index.search(rows[q], q, 10)
        exact = rows @ rows[q]
        exact[q] = -(2**60)
        want = np.lexsort((ids, -exact))[:10]
        assert at.tolist() == want.tolist() and scores.tolist() == exact[want].tolist()


def test_shingles_are_those_of_the_definition():
    import re

    texts = ["", "a", "one two three four", "A b c d e f", "É à.b c d e f 😀 𝔘x", "x " * 3000, "..."]
    seen = {}
    for start, _, _, own, counts in shingles.blocks(texts):
        ends = np.cumsum(counts)
        for i, n in enumerate(counts.tolist()):
            words = [w for w in re.split(r"[\W_]+", texts[start + i].lower()) if w]
            want = [tuple(words[j : j + 5]) for j in range(max(1, len(words) - 4))] if words else []
            mine = own[ends[i] - n : ends[i]].tolist()
            assert len(mine) == len(want)
            assert all(seen.setdefault(a, b) == b for a, b in zip(want, mine, strict=True))
    assert len(set(seen.values())) == len(seen)


def brute_classes(rows):
    """Classes by comparing every two texts, under the operator's own weights."""
    from collections import Counter

    own = [shingles.shingles(t or "") for _, t in rows]
    count = Counter(b for s in own for b in np.unique(near_dup._bucket(np.unique(s))).tolist())
    weights = near_dup.Weights(len(rows), {b: n for b, n in count.items() if n >= len(rows) / near_dup.CAP})
    parts = [near_dup._elements(s) for s in own]
    common = near_dup.common_weights([e for e, _ in parts], [weights.of(s) for _, s in parts])
    total = np.array([int(weights.of(s).sum(dtype=int)) for _, s in parts])
    group = list(range(len(rows)))

    def find(c):
        while group[c] != c:
            c = group[c]
        return c

    for a in range(len(rows)):
        for b in range(a):
            if len(own[a]) and len(own[b]) and near_dup.linked(int(common[a, b]), int(total[a]), int(total[b])):
                group[max(find(a), find(b))] = min(find(a), find(b))
    least = {}
    for i, (d, _) in enumerate(rows):
        least[find(i)] = min(d, least.get(find(i), d))
    return sorted((d, least[find(i)]) for i, (d, _) in enumerate(rows))


def copies(seed=1):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(5))
    base = [word() for _ in range(120)]
    rows = []
    for i in range(160):  # one large group of near copies
        words = list(base)
        for _ in range(r.randint(0, 6)):
            words[r.randrange(len(words))] = word()
        rows.append((i, " ".join(words)))
    rows += [(200 + i, " ".join(base[:30] + [word() for _ in range(60)])) for i in range(30)]
    rows += [(300, None), (301, ""), (302, "..."), (303, "one two"), (304, "One, two!"), (305, "x " * 5000), (306, rows[5][1])]
    return rows


def test_near_duplicates_equal_brute_force_and_tiles_lose_nothing(spark, monkeypatch):
    rows = copies()
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute_classes(rows)
    monkeypatch.setattr(near_dup, "TILE", 16)
    got = sorted((r.doc_id, r.class_id) for r in near_dup.classes(df).collect())
    assert got == want
    one = near_dup.keep_one(df.unionAll(df.limit(1)))
    assert sorted(r.doc_id for r in one.collect()) == sorted({c for _, c in want})


def test_one_row_of_each_class_stays_and_no_other_text_goes(spark):
    r = random.Random(9)
    text = {k: " ".join("".join(r.choice("abcdefgh") for _ in range(5)) for _ in range(n)) for k, n in (("A", 60), ("B", 60), ("D", 60), ("more", 40))}
    rows = [(5, "A"), (5, "B"), (3, "B"), (7, "D"), (7, "A more"), (7, "D"), (None, "D"), (None, "F"), (None, "F"), (8, ""), (8, ""), (9, None)]
    text |= {"A more": text["A"] + " " + text["more"], "F": "one two", "": "..."}
    df = spark.createDataFrame([(i, text.get(k), k, 1) for i, k in rows], "doc_id long, text string, `a.b` string, vid int")
    got = near_dup.keep_one(df)
    assert got.columns == df.columns
    want = [(3, "B"), (5, "A"), (7, "A more"), (7, "D"), (8, ""), (8, ""), (9, None), (None, "F")]
    assert sorted(((x.doc_id or 99, x["a.b"]) for x in got.collect()), key=str) == sorted(((i or 99, k) for i, k in want), key=str)
    assert near_dup.keep_one(df.limit(0)).count() == 0
    assert sorted((x.doc_id or 99, x.class_id or 99) for x in near_dup.classes(df).collect()) == [(3, 3), (5, 3), (5, 5), (7, 7), (7, 7), (7, 7), (8, 8), (8, 8), (9, 9), (99, 7), (99, 99), (99, 99)]


def weighted_classes(rows):
    """Classes by comparing every two texts under ln(1 + N / df), by words alone: nothing of the operator is used."""
    from collections import Counter

    own = [Counter(tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))) for w in (t.split() for _, t in rows)]
    df = Counter(s for c in own for s in c)
    weight = {s: np.log(1 + len(rows) / n) for s, n in df.items()}
    group = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            if not own[a].keys().isdisjoint(own[b].keys()):
                common = sum(n * weight[s] for s, n in (own[a] & own[b]).items())
                if common >= 0.8 * sum(n * weight[s] for s, n in (own[a] | own[b]).items()):
                    low, high = sorted((group[a], group[b]))
                    group = [low if g == high else g for g in group]
    return sorted((rows[i][0], min(rows[j][0] for j in range(len(rows)) if group[j] == group[i])) for i in range(len(rows)))


def test_near_duplicates_weigh_rare_and_common_shingles_apart(spark):
    r = random.Random(3)
    words = lambda n: [f"w{r.randrange(10**9)}" for _ in range(n)]
    passage, boiler, body = words(86), [words(14), words(14)], words(104)
    texts = [passage + words(9) for _ in range(10)]  # alike in a common passage only: 0.82 by count, less by weight
    texts += [body + boiler[0], body + boiler[1]]  # apart in common lines only: 0.78 by count, more by weight
    texts += [words(12) + line + words(12) for line in boiler for _ in range(14)]
    texts += [words(40)] * 3 + [words(8) for _ in range(1000 - len(texts) - 3)]
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)]
    want = weighted_classes(rows)
    assert [c for _, c in want[:12]] == [*range(10), 10, 10] and want[40:43] == [(40, 40), (41, 40), (42, 40)]
    got = near_dup.classes(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted((x.doc_id, x.class_id) for x in got.collect()) == want


def test_near_duplicates_of_nothing(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert near_dup.classes(df).count() == 0


def test_sampling_agrees_as_often_as_the_similarity():
    r = np.random.default_rng(1)
    weights, rates = near_dup.Weights(1000, {}), []
    for _ in range(40):
        a = r.integers(0, 2**63, 200).astype(np.uint64)
        b = np.concatenate([a[:160], r.integers(0, 2**63, 40).astype(np.uint64)])
        keys = []
        for x in (a, b):
            e, s = near_dup._elements(x)
            keys.append(weights.bands(e, weights.of(s), np.array([0])))
        rates.append((keys[0] == keys[1]).mean())
    assert abs(np.mean(rates) - (160 / 240) ** near_dup.ROWS) < 0.03


def test_decontamination_equals_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    items = spark.read.parquet(f"{sf}/benchmark.parquet").collect()
    held = {d.doc_id: set(shingles.shingles(d.text).tolist()) for d in docs}
    want = set()
    for i in items:
        s = set(shingles.shingles(i.text).tolist())
        want |= {(d, i.item_id) for d, h in held.items() if len(s & h) >= 0.8 * len(s)}
    assert want and {(r.doc_id, r.item_id) for r in queries.op6_decontamination(spark, sf).collect()} == want


def test_decontamination_edges_and_groups(spark, monkeypatch):
    items = spark.createDataFrame([(1, "a b c d e f g h"), (2, None), (3, ""), (None, "x y z"), (4, "q w")], "item_id long, text string")
    docs = spark.createDataFrame([(1, "z " * 9000 + "A, b c d e f g h!"), (1, None), (2, ""), (3, "q w"), (None, "a b c d e f g h")], "doc_id long, text string")
    for most in (20_000, 1):
        monkeypatch.setattr(decontam, "BROADCAST_ITEMS", most)
        got = sorted(((r.doc_id or -1), r.item_id) for r in decontam.leaks(docs, items).collect())
        assert got == [(-1, 1), (1, 1), (3, 4)]
    assert sorted(r.n_items for r in decontam.flag(docs, items).collect()) == [0, 0, 1, 1, 1]


def test_decontamination_finds_short_items_in_long_documents():
    r = random.Random(11)
    words = lambda n: [f"w{r.randrange(10**6)}" for _ in range(n)]
    items = [(i, words(5 + i % 10)) for i in range(60)]
    items += [(60, items[0][1]), (61, items[1][1][:5]), (62, ["a"])]  # a repeated one, a part of one, a single word
    docs = [words(484) for _ in range(600)]
    for i, doc in enumerate(docs):
        for own in (items[i % 60][1], items[(7 * i + 3) % 60][1]):
            at = r.randrange(len(doc)) if i % 2 else r.randrange(16)
            doc[at:at] = own
    sets = lambda w: {tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))}
    want = set()
    for d, doc in enumerate(docs):
        held = sets(doc)
        want |= {(d, i) for i, w in items if len(sets(w) & held) >= 0.8 * len(sets(w))}
    index = decontam.Index.build([(i, " ".join(w)) for i, w in items])
    got = index.search([" ".join(d) for d in docs], 0.8)
    assert len(want) > 1000 and {(d, i) for d, i, *_ in got} == want and len(got) == len(want)
    short = decontam.Index.build([(i, " ".join(w)) for i, w in items if len(w) <= 12])
    assert {(d, i) for d, i, *_ in short.search([" ".join(d) for d in docs], 0.8)} == {(d, i) for d, i in want if len(items[i][1]) <= 12}
