"""Copies, mixing, packing, search and chats: against brute force, round trips and SQL, and with odd rows."""

import hashlib
import math
import random
import re
import subprocess
import sys
import zlib
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lexmill.llm import chat, common, exact_dedup, graph, mixing, near_dedup, packing, queries, topk
from lexmill.llm.common import shared_dir, staged, table
from tests.compare import duck, rows_of

SPACE, WORD = re.compile("[\x20\x09-\x0d]+"), re.compile("[^\x20\x09-\x0d]+")
#: Further columns with names that the operators use themselves.
SCHEMA = "doc_id long, text string, source string, size long, sha string, gone long, doc long, id long, `rows` long, `odd.name` int"


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, s, 1, "x", 2, 3, 4, 5, 6) for i, t, s in rows], SCHEMA)


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_sql(spark, sf_dir, name):
    got, want = queries.queries()[name](spark, sf_dir).toPandas(), duck(queries.oracle_sql()[name], sf_dir)
    assert sorted(got.columns) == sorted(want.columns) and rows_of(got) == rows_of(want)


def test_staged_tables_are_in_the_shared_folder(spark):
    df = staged(spark.range(3), "t")
    assert sorted(r.id for r in df.collect()) == [0, 1, 2] and shared_dir(spark).split("/")[-1] in df.inputFiles()[0]


# Exact copies


def test_cuckoo_index_against_a_dict():
    r, index, want = random.Random(2), exact_dedup.CuckooIndex(4), {}
    keys = [hashlib.sha256(str(k).encode()).digest() for k in range(3000)]
    for step in range(20000):
        key = r.choice(keys)
        if r.random() < 0.65:
            assert index.add(key, step) == (key not in want)
            low, n = want.get(key, (step, 0))
            want[key] = (low, n + 1)
        else:
            assert index.discard(key) == (key in want)
            if key in want:
                low, n = want.pop(key)
                if n > 1:
                    want[key] = (low, n - 1)
    assert {k: (low, n) for _, k, low, n in index.live()} == want and index.resized > 1 and len(index) == len(want)


def test_full_indexes_hand_on_rare_keys_and_keep_the_others(monkeypatch):
    monkeypatch.setattr(exact_dedup, "HELD_KEYS", 50)
    r, want = random.Random(5), defaultdict(list)
    keys = [hashlib.sha256(str(k).encode()).digest() for k in range(400)]
    rows = [(keys[min(399, int(r.expovariate(0.02)))], k) for k in range(3000)]
    for key, k in rows:
        want[key].append(k)
    parts = pd.concat(exact_dedup._partial([pd.DataFrame(rows, columns=["digest", "doc_id"])]))
    assert len(want) < len(parts) < len(rows)
    again = parts.groupby("digest").agg(keep=("keep_id", "min"), n=("group_size", "sum"))
    assert {k: (x.keep, x.n) for k, x in again.iterrows()} == {k: (min(v), len(v)) for k, v in want.items()}


COPIES = [(5, "a  b"), (3, "a\tb"), (9, "a b"), (4, ""), (2, None), (7, " "), (1, "c"), (1, "c"), (None, "a b"), (None, "z"), (None, None), (8, "A b"), (6, "x " * 100000), (10, "x\n" * 100000), (11, "a\x0b\x0cb\r\n"), (12, "a\xa0b")]


def exact_truth(rows):
    norm = lambda t: SPACE.sub(" ", t or "")
    groups = defaultdict(list)
    for i, t in rows:
        if i is not None:
            groups[norm(t)].append(i)
    out = []
    for i, t in rows:
        own = groups[norm(t)] if i is not None else [None]
        low = min(own) if i is not None else None
        out.append((i, low, len(own), i == low, hashlib.sha256(norm(t).encode()).hexdigest()))
    return sorted(out, key=str)


def test_exact_dedup_against_brute_force(spark):
    docs = docs_of(spark, [(i, t, "s") for i, t in COPIES]).repartition(3)
    assert sorted(map(tuple, exact_dedup.exact_dedup(docs).collect()), key=str) == exact_truth(COPIES)
    kept = exact_dedup.keep_first(docs)
    assert kept.columns == docs.columns
    assert Counter(r.doc_id for r in kept.collect()) == Counter({3: 1, 2: 1, 7: 1, 1: 1, 8: 1, 6: 1, 11: 1, 12: 1, None: 3})
    assert exact_dedup.exact_dedup(docs.limit(0)).count() == exact_dedup.keep_first(docs.limit(0)).count() == 0


# Near copies


def near_truth(rows, words=3, percent=85):
    sets = []
    for _, t in rows:
        w = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
        n = min(words, len(w))
        sets.append({tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if w else set())
    parent = list(range(len(rows)))

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                parent[root(a)] = root(b)
    low = defaultdict(list)
    for k, (i, _) in enumerate(rows):
        low[root(k)].append(i)
    return sorted((i, len(sets[k]), min(low[root(k)]), i == min(low[root(k)])) for k, (i, _) in enumerate(rows))


def near_rows(n=260, seed=1):
    """Texts with chains of edits around the threshold, copies, and odd ones."""
    r = random.Random(seed)
    word = lambda: r.choice("on th er in ou re st and of a".split()) + r.choice(["", "ly", "ing", "ed", "s"])
    out, texts = [], []
    for k in range(n):
        if texts and r.random() < 0.7:
            w = r.choice(texts).split(" ")
            for _ in range(r.randint(0, max(1, len(w) // 25))):
                w[r.randrange(len(w))] = word()
            t = " ".join(w)
        else:
            t = " ".join(word() for _ in range(r.choice([1, 2, 3, 30, 80, 200])))
        texts.append(t)
        out.append((1000 - 3 * k, r.choice([t, t.upper(), t.replace(" ", "\n\t")])))
    big = " ".join(word() for _ in range(30000))
    return [*out, (5000, None), (5001, ""), (5002, " \n"), (5003, big), (5004, big + " more"), (5005, "É é"), (5006, "é é")]


def test_near_dedup_against_brute_force(spark):
    rows = near_rows()
    docs = docs_of(spark, [(i, t, "s") for i, t in rows]).repartition(3)
    want = near_truth(rows)
    assert sorted(map(tuple, near_dedup.near_dedup(docs).collect())) == want and sum(not x[3] for x in want) > 50
    five = {i for i, _, _, kept in near_truth(rows, 5, 80) if kept}
    kept = near_dedup.without_near_copies(docs)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == five


def test_near_dedup_of_small_cells(spark, monkeypatch):
    """Groups that are cut into many cells have the same components."""
    monkeypatch.setattr(near_dedup, "TILE", 4)
    monkeypatch.setattr(near_dedup, "BUCKET_TILE", 3)
    monkeypatch.setattr(near_dedup, "BROADCAST_NODES", 1)
    rows = near_rows(120, 7)
    docs = docs_of(spark, [(i, t, "s") for i, t in rows])
    assert sorted(map(tuple, near_dedup.near_dedup(docs).collect())) == near_truth(rows)


def test_near_dedup_of_rows_without_ids_that_link_others(spark):
    """A row without an id may be the first of its copies, or the only link of two documents."""
    own = [f"w{k}" for k in range(200)]
    changed = lambda words, *at: " ".join("x" if k in at else w for k, w in enumerate(words))
    first, near = " ".join(own), changed(own, 20)
    other = [f"v{k}" for k in range(200)]
    # The outer two differ from the middle one by 12 of 198 shingles each, and too much from each other.
    left, middle, right = changed(other, 20, 40, 60, 80), " ".join(other), changed(other, 100, 120, 140, 160)
    docs = spark.createDataFrame([(None, first), (5, first), (9, near), (None, middle), (None, middle), (21, left), (22, right)], "doc_id long, text string").coalesce(1)
    got = near_dedup.near_dedup(docs).collect()
    assert len(got) == 7
    rows = {r.doc_id: (r.component_id, r.kept) for r in got if r.doc_id is not None}
    assert rows == {5: (5, True), 9: (5, False), 21: (21, True), 22: (21, False)}
    nameless = [(r.component_id, r.kept) for r in got if r.doc_id is None]
    assert sorted(nameless) == [(5, True), (21, True), (21, True)]
    alone = near_dedup.near_dedup(docs.where("doc_id is null or doc_id <> 5")).collect()
    assert {r.doc_id: (r.component_id, r.kept) for r in alone if r.doc_id == 9} == {9: (9, True)}


def test_near_dedup_of_repeated_and_null_rows(spark):
    text = "one two three four five six"
    rows = {(r.doc_id, r.component_id, r.kept) for r in near_dedup.near_dedup(docs_of(spark, [(2, text, "s"), (2, text, "s"), (3, text, "s"), (None, text, "s")])).collect()}
    assert {(2, 2, True), (3, 2, False)} <= rows and all(kept for i, _, kept in rows if i is None)
    assert near_dedup.near_dedup(docs_of(spark, [])).count() == 0


def test_pairs_within_the_radius_share_a_key():
    """By pigeonhole: signatures that differ in up to 2 * chunks - 1 symbols always meet in some key."""
    r = np.random.default_rng(5)
    assert [near_dedup.chunks_for(p) for p in (95, 85, 80, 70)] == [7, 12, 15, 19]
    for percent in (95, 85, 80, 70):
        chunks = near_dedup.chunks_for(percent)
        for _ in range(200):
            a = r.integers(0, 1 << 16, near_dedup.SYMBOLS, dtype=np.uint16)
            b = a.copy()
            b[r.permutation(near_dedup.SYMBOLS)[: 2 * chunks - 1]] ^= 1
            keys = near_dedup.chunk_keys(np.stack([a, b]), chunks)
            assert set(keys[0]) & set(keys[1])
    with pytest.raises(ValueError, match="too low"):
        near_dedup.chunks_for(50)


@pytest.mark.parametrize("percent", [65, 70, 80, 85, 90, 95, 99])
def test_pairs_at_the_threshold_share_a_key(percent):
    """Recall of pairs of just the similarity, of sets of random shingles."""
    r, chunks, found = np.random.default_rng(percent), near_dedup.chunks_for(percent), 0
    for _ in range(3000):
        # Two sets of n that share c have the similarity c / (2 n - c).
        n, share = 300, percent / 100
        c = -int(-2 * n * share // (1 + share))
        pool = r.integers(0, 1 << 63, 2 * n - c, dtype=np.uint64)
        symbols = near_dedup.signatures(np.concatenate([pool[:n], pool[n - c :]]), np.array([0, n]))
        keys = near_dedup.chunk_keys(symbols, chunks)
        found += bool(set(keys[0].tolist()) & set(keys[1].tolist()))
    assert found >= 2999


def test_near_dedup_of_other_similarities(spark):
    rows = near_rows(100, 9)
    docs = docs_of(spark, [(i, t, "s") for i, t in rows])
    assert sorted(map(tuple, near_dedup.near_dedup(docs, words=2, percent=70).collect())) == near_truth(rows, 2, 70)


def test_tree_edges_join_what_the_graph_joins():
    r = np.random.default_rng(8)
    for n in (0, 1, 2, 30, 60):
        graph_of = np.triu(r.random((n, n)) < 1.2 / max(1, n), 1)
        graph_of |= graph_of.T
        labels = r.integers(0, max(1, n // 2), n)
        for own in (None, labels):
            parent = list(range(n))

            def root(k, parent=parent):
                while parent[k] != k:
                    k = parent[k]
                return k

            got = near_dedup.tree_edges(n, lambda at, others: others[graph_of[at, others]], own)
            known = [] if own is None else [(a, b) for a in range(n) for b in range(a) if own[a] == own[b]]
            parts = []
            for edges in (got, list(zip(*np.nonzero(graph_of), strict=True))):
                parent[:] = range(n)
                for a, b in [*known, *edges]:
                    parent[root(a)] = root(b)
                parts.append({frozenset(k for k in range(n) if root(k) == root(x)) for x in range(n)})
            assert parts[0] == parts[1] and all(graph_of[a, b] for a, b in got)


def test_components(spark):
    edges = [(k, k + 1) for k in range(40)] + [(100, 101), (101, 102), (102, 100), (200, 200)]
    df = spark.createDataFrame(random.Random(1).sample(edges, len(edges)), "a long, b long")
    got = {r.node: r.root for r in graph.components(df, "a", "b").collect()}
    assert got == {k: 0 for k in range(41)} | {100: 100, 101: 100, 102: 100}
    assert graph.components(df.limit(0), "a", "b").count() == 0


# Mixing


def targets_truth(sizes):
    """Targets by source, by taking out the full ones in turn."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight, full, total = {s: k % 3 + 1 for k, s in enumerate(names)}, set(), sum(sizes.values())
    while True:
        rest, w = total - sum(3 * sizes[s] for s in full), sum(weight[s] for s in names if s not in full)
        level = rest / w if w else 0
        over = {s for s in names if s not in full and level * weight[s] > 3 * sizes[s] + 1e-9}
        if not over:
            return {s: 3 * sizes[s] if s in full else level * weight[s] for s in names}
        full |= over


@pytest.mark.parametrize("uneven", [False, True])
def test_mixing_meets_its_targets(spark, uneven):
    r = random.Random(6)
    rows = []
    for k in range(4000):
        s = r.choice([None, "a", "b", "B", "é", ""]) if not uneven else r.choice(["a"] * 30 + ["b", "c", None])
        rows.append((k, r.choice([None, "", " "]) if r.random() < 0.05 else " w" * r.randint(1, 80), s))
    docs = docs_of(spark, rows)
    got = mixing.mix(docs).collect()
    size = {i: len(WORD.findall(t or "")) for i, t, _ in rows}
    source = {i: s for i, _, s in rows}
    sizes = Counter()
    for i, s in source.items():
        sizes[s] += size[i]
    want = targets_truth(sizes)
    taken = Counter()
    for x in got:
        assert x["size"] == size[x.doc_id] and 0 <= x.taken <= 3 * x["size"] and x.source_size == sizes[source[x.doc_id]]
        assert x.target == pytest.approx(want[source[x.doc_id]])
        taken[source[x.doc_id]] += x.taken
    assert len(got) == len(rows) and sum(want.values()) == pytest.approx(sum(sizes.values()))
    assert all(abs(taken[s] - want[s]) <= mixing.BLOCK + 0.001 * want[s] for s in sizes)
    if uneven:
        assert any(want[s] == 3 * sizes[s] for s in sizes)
    again = mixing.mix(docs.repartition(5)).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, again))


def test_sainte_lague_against_plain_quotients(spark):
    r = random.Random(8)
    for seats in (0, 1, 7, 100, 1001):
        votes = {f"p{k}": r.randint(0, 1000) for k in range(9)}
        won = Counter()
        for _ in range(seats):
            won[max(votes, key=lambda p: (votes[p] / (2 * won[p] + 1), [-ord(c) for c in p]))] += 1
        df = spark.createDataFrame([(p, v, seats) for p, v in votes.items()], "p string, v long, n long")
        got = {x.p: x.won for x in mixing.sainte_lague(df, "n", "v", ["p"], []).collect()}
        assert got == {p: won[p] for p in votes}


def test_mixing_of_odd_tables(spark):
    assert mixing.mix(docs_of(spark, [])).count() == 0
    assert {(r.target, r.taken) for r in mixing.mix(docs_of(spark, [(1, None, None), (2, "", "a")])).collect()} == {(0.0, 0)}
    rows = [(1, "a b c", "s"), (1, "a b c", "s"), (None, "d e", "s"), (3, "", "s")]
    out = mixing.mixed_documents(docs_of(spark, rows))
    assert out.columns == SCHEMA.replace("`", "").replace("odd.name", "odd§").replace(" long", "").replace(" string", "").replace(" int", "").replace("§", ".name").split(", ")
    assert sorted((r.doc_id or 0, r.text) for r in out.collect()) == [(0, "d e"), (1, "a b c"), (1, "a b c")]
    assert [r.text for r in mixing.mixed_documents(docs_of(spark, [(1, "a b c", "s")])).collect()] == ["a b c"]
    same_id = [(1, "a b c", "s"), (1, "d e f g", "s"), (2, "h", "s"), (None, "i j", "s"), (None, "k", "s")]
    assert sorted(r.text for r in mixing.mixed_documents(docs_of(spark, same_id)).collect()) == sorted(t for _, t, _ in same_id)


def test_small_sources_reach_their_targets(spark):
    """Sources of few words beside a large one."""
    rows = [(1, "a b c", "s"), (2, "d e f g", "t"), *[(k, "w " * 80, "u") for k in range(3, 13)]]
    taken = {r.doc_id: (r.taken, r.target) for r in mixing.mix(docs_of(spark, rows)).collect()}
    assert taken[1] == (9, 9.0) and taken[2] == (12, 12.0) and sum(t for t, _ in taken.values()) == 807


# Packing


def pieces_hold(rows, ids, capacity=packing.CAPACITY):
    """Every id is in one piece; sequences are gapless and full, but for powers of two. The padding's share."""
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append(r)
    assert by_doc.keys() == ids.keys()
    for i, own in by_doc.items():
        at = 0
        for r in sorted(own, key=lambda r: r.start):
            part = np.array(ids[i][r.start : r.start + r.length], dtype="<u4").tobytes()
            assert r.start == at and r.length > 0 and r.ids_crc32 == zlib.crc32(part) and r.doc_tokens == len(ids[i])
            at += r.length
        assert at == len(ids[i])
    room = 0
    for own in by_sequence.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= capacity
        room += at if at & (at - 1) == 0 else capacity
    return 1 - sum(map(len, ids.values())) / room if room else 0.0


def library_ids(texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(packing.public_vocabulary()())
    return {i: [*t.encode(x or "", add_special_tokens=False).ids, 1] for i, x in texts.items()}


def test_packing_of_documents(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    texts = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
    assert pieces_hold(packing.pack(docs).collect(), library_ids(texts)) < 0.05


ODD = ["a.,b. c,\nd_, e.. f. 'g, don't, x'll. ", "É, é. ß.\nÀ×, ÷. ", "x\x1cy, z. 12, 34.5, 6.", "¼, ², ª. µ, º, Ω. Ωσς, 漢字. ", "AB\xa0C,\xa0d. \x85 e,", None, "", " ", ".", ",, . .. ", "á ́, ñ.", "<|startoftext|> <|endoftext|>", "hello<|endoftext|>world", "<|endoftext|>s don't'<|startoftext|>s <|", "A<|ENDOFTEXT|>b <|endoftext|<|endoftext|>\u00e9<|endoftext|>", "w" * 3000, "İstanbul ǅ", "one two " * 20000]


def test_packing_of_odd_texts(spark):
    texts = dict(enumerate(ODD))
    rows = packing.pack(docs_of(spark, [(i, t, "s") for i, t in texts.items()]), with_ids=True).collect()
    ids = library_ids(texts)
    pieces_hold(rows, ids)
    assert all(list(r.ids) == ids[r.doc_id][r.start : r.start + r.length] for r in rows)
    assert packing.pack(docs_of(spark, [])).count() == 0
    twice = packing.pack(docs_of(spark, [(1, "a", "s"), (1, "a", "s"), (None, "b", "s")])).collect()
    assert sorted((r.doc_id or 0, r.doc_tokens) for r in twice) == [(0, 2), (1, 2), (1, 2)]


def test_encoder_equals_the_library_on_random_texts():
    from tokenizers import Tokenizer

    path = packing.public_vocabulary()()
    library, encoder, r = Tokenizer.from_file(path), packing.ChunkEncoder(path, 50), random.Random(3)
    bits = ["<|endoftext|>", "<|startoftext|>", "<|", "|>", "a", "Ab", " ", "\n", "'s", "12", ",", ". ", "\u00e9", "\u0301", "\u6f22", "\xa0", "\x1c", "endoftext", "<|endoftext"]
    texts = ["".join(r.choices(bits, k=r.randint(1, 12))) for _ in range(6000)]
    for t, got in zip(texts, encoder.encode(texts), strict=True):
        assert np.frombuffer(got, dtype="<u4").tolist() == library.encode(t, add_special_tokens=False).ids, t


def test_bins_hold_a_fixed_number_of_their_class():
    r = random.Random(9)
    packer = packing.HarmonicPacker()
    lengths = [r.randint(1, 5000) for _ in range(3000)]
    done = [s for k, n in enumerate(lengths) for s in packer.put(k, n)]
    for sequence in done:
        classes = {packing.CAPACITY // n for _, _, n in sequence}
        assert sum(n for _, _, n in sequence) <= packing.CAPACITY and len(classes) == 1 and len(sequence) == min(classes)
    every = done + list(packer.close())
    assert sum(n for s in every for _, _, n in s) == sum(lengths)


# Search


def nearest_truth(rows, is_query, k):
    live = [(i, [math.floor(64 * x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q, a in live:
        if is_query(q):
            scored = sorted((-sum(x * y for x, y in zip(a, b, strict=False)), i) for i, b in live if i != q)[:k]
            out += [(q, n, i, -s) for n, (s, i) in enumerate(scored, 1)]
    return sorted(out)


@pytest.mark.parametrize("shard_rows, pack", [(30, 3), (4096, 512)])
def test_top_k_against_brute_force(spark, monkeypatch, shard_rows, pack):
    monkeypatch.setattr(topk, "LEAF", 8)
    monkeypatch.setattr(topk, "PACK", pack)
    monkeypatch.setattr(topk, "LANE", 2)
    r = random.Random(10)
    rows = [(i, [r.choice([-1.0, 0.25, 0.5, r.gauss(0, 1)]) for _ in range(6)]) for i in range(300)]
    rows += [(i, [c + r.gauss(0, 0.1) for c in r.choice([(9, 0, 0, 0, 0, 0), (0, 0, -9, 0, 9, 0)])]) for i in range(300, 400)]
    rows += [(400 + k, [0.5] * 6) for k in range(90)]  # one vector of many rows
    rows[3] = rows[43] = (43, rows[4][1])
    rows += [(1000, None), (1020, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (1040, [math.nan] * 6), (1060, [math.inf] + [0.0] * 5), (None, [1.0] * 6), (1080, []), (1100, [0.5] * 9)]
    df = spark.createDataFrame([(i, v, 1, 2) for i, v in rows], "vec_id long, embedding array<float>, row long, shard long")
    rows = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, v in rows]
    got = topk.top_k(df, F.col("vec_id") % 20 == 0, 5, shard_rows=shard_rows)
    assert sorted(map(tuple, got.collect())) == nearest_truth(rows, lambda q: q % 20 == 0, 5)
    if shard_rows == 30:
        few = topk.top_k(df.where("vec_id in (0, 1, 2)"), F.col("vec_id") % 20 == 0, 5)
        assert few.count() == 2 and topk.top_k(df.limit(0), F.col("vec_id") % 20 == 0).count() == 0


def test_top_k_of_huge_components(spark):
    """Scores beyond 2**53 are exact; those beyond 64 bits count as the outermost number of them."""
    r = random.Random(2)
    rows = [(i, [r.choice([1e8, -1e8, 3.0e7 + i, 1e300, -1e300, 2.0**40, 0.5]) if k else 1.0 for k in range(3)]) for i in range(60)]
    rows += [(60, [3.1e7 + 1 / 64, 3e7, 0.0]), (61, [3.1e7, 3e7, 1 / 64]), (62, [1.7e308, 0.0, 0.0]), (80, [2.0**26, 2.0**26 + 1, 1.0])]
    got = topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 20 == 0, 7, shard_rows=16)
    most, out = 2**63 - 1, []
    live = [(i, [int(math.floor(64 * x)) for x in v]) for i, v in rows if i != 62]
    for q, a in live:
        if q % 20 == 0:
            scored = sorted((-max(-most, min(most, sum(x * y for x, y in zip(a, b, strict=True)))), i) for i, b in live if i != q)[:7]
            out += [(q, n, i, -s) for n, (s, i) in enumerate(scored, 1)]
    assert sorted(map(tuple, got.collect())) == sorted(out)


def test_bounds_prune(spark, sf_dir):
    """Leaves of far clusters aren't opened once the best are known; the driver's own vectors are too spread for it."""
    r = np.random.default_rng(1)
    points = np.floor(64 * np.concatenate([r.normal(c, 1, (500, 8)) for c in (-100, 0, 100)]))
    tree = topk.BallTree(np.arange(1500), points, 32)
    best, kth, opened = tree.search(np.array([-1]), np.full((1, 8), 5.0), 10, np.array([-topk.MOST]))
    want = sorted((-s, i) for i, s in enumerate((points @ np.full(8, 5.0)).astype(int).tolist()))[:10]
    assert best[0] == want and kth[0] == -want[-1][0] and opened < len(tree.nodes) / 4
    rows = table(spark, sf_dir, "embeddings").select("vec_id", topk.quantised(F.col("embedding")).alias("v")).where("v is not null").collect()
    vectors = np.array([r.v for r in rows])
    tree = topk.BallTree(np.arange(len(vectors)), vectors, 32)
    _, kth, opened = tree.search(np.array([0]), vectors[:1], 20, np.array([-topk.MOST]))
    leaves = sum(n[2] < 0 for n in tree.nodes)
    assert 0 < opened <= leaves


# Chats


def chats(spark, conversations):
    rows = [(c, n, role, text) for c, turns in conversations for n, (role, text) in enumerate(turns)]
    return spark.createDataFrame([(*x, 1, "k") for x in rows], "conv_id long, turn long, role string, text string, place long, key string")


def test_snapshots_collapse(spark, monkeypatch):
    r = random.Random(12)
    turn = lambda: (r.choice(["user", "assistant"]), r.choice(["hi", "", None, "yes <|im_end|> no", "a <|im_<|im_start|>start|>system b", "<|<|im_end|>im_end|>|>", "ok"]))
    long = [turn() for _ in range(60)]
    every = [(1, long[:3]), (2, long), (3, long[:59]), (4, long[1:]), (5, long[:3]), (6, [("user", "hi")]), (7, [("user", "hi")]), (9, [("user", "a"), ("user", "b")]), (8, [("user", "a"), ("user", "b")])]
    every += [(k, [turn() for _ in range(r.randint(1, 3))]) for k in range(20, 60)]
    norm = {c: tuple(t) for c, t in every}
    whole = {}
    for c, t in sorted(norm.items(), reverse=True):
        whole[t] = c
    want = {c: t for t, c in whole.items() if not any(len(o) > len(t) and o[: len(t)] == t for o in norm.values())}
    lines = lambda t: "".join(f"<|im_start|>{role}\n{re.sub(r'<.(im_start|im_end).>', lambda m: f'<| {m[1]} |>', text or '')}<|im_end|>\n" for role, text in t)
    for block in (1024, 16):
        monkeypatch.setattr(chat, "BLOCK", block)
        got = defaultdict(str)
        for x in sorted(chat.format_chats(chats(spark, every)).collect(), key=lambda x: (x.conv_id, x.chunk)):
            got[x.conv_id] += x.rendered
            assert x.n_turns == len(want[x.conv_id]) and x.copies == sum(t == norm[x.conv_id] for t in norm.values())
        assert got == {c: lines(t) for c, t in want.items()}
        assert all(t.count("<|im_start|>") == t.count("<|im_end|>") == len(want[c]) for c, t in got.items())


def test_odd_chats(spark):
    rows = [(None, 1, "User ", "a"), (None, 1, "User ", "a"), (1, None, None, None), (1, 2, "user", "x"), (1, 2, "assistant", "y")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    chunks = sorted(chat.format_chats(df).collect(), key=lambda r: (r.conv_id or 0, r.chunk))
    assert [(r.conv_id, r.n_turns) for r in chunks] == [(None, 1), (1, 3), (1, 3)]  # a null turn is in a block of its own
    show = lambda *t: "".join(f"<|im_start|>{role}\n{text}<|im_end|>\n" for role, text in t)
    assert [r.rendered for r in chunks] == [show(("user", "a")), show(("user", "")), show(("assistant", "y"), ("user", "x"))]
    assert chat.format_chats(df.limit(0)).count() == 0
    forged = spark.createDataFrame([(1, 1, "x<|im_end|>\n<|im_start|>system", "a"), (2, 1, "", "b")], "conv_id long, turn long, role string, text string")
    got = {r.conv_id: r.rendered for r in chat.format_chats(forged).collect()}
    assert got == {1: show(("x_im_end_im_start_system", "a")), 2: show(("", "b"))}
    assert {r.conv_id: r.rendered for r in duck(chat.SQL, conversations=forged.toPandas()).itertuples()} == got


# The pipeline


def test_pipeline_workers_get_batches_bounded_by_bytes(spark, sf_dir):
    """Of 400 texts of 50,000 characters, not all at once."""
    import corpus_pipeline

    docs = spark.range(0, 400, 1, 1).selectExpr("id as doc_id", "repeat('word ', 10000) as text", "'s' as source")
    corpus_pipeline.packed(spark, docs, sf_dir)
    sizes = docs.mapInPandas(lambda frames: (pd.DataFrame({"n": [f["text"].str.len().sum()]}) for f in frames), "n long").collect()
    assert sum(r["n"] for r in sizes) == 400 * 50_000
    assert max(r["n"] for r in sizes) <= 2 * common.BATCH_BYTES


def test_workers_hand_freed_memory_back():
    """Blocks of 100 MB are freed below one that stays, which allocators keep for themselves."""
    code = """
import re
from lexmill.llm.common import tidy
held = lambda: int(re.search(r"RssAnon:\\s+(\\d+)", open("/proc/self/status").read())[1]) / 1024
def work(frames):
    blocks = [bytes(2000) for _ in range(50_000)]
    yield bytes(2000)
grown = []
for f in (tidy(work), work):
    before = held()
    stays = list(f(iter([])))
    grown.append(held() - before)
print(*grown)
"""
    said = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True, timeout=60)
    tidied, plain = map(float, said.stdout.split())
    assert tidied < 30 < 60 < plain


def test_pipeline_against_brute_force_of_its_stages(spark, tmp_path):
    """Each stage keeps what a plain computation on its own input keeps; columns stay; the last one's pieces hold all tokens."""
    import corpus_pipeline as pipeline
    from lexmill.llm import quality
    from lexmill.llm.labelled import sample

    r = random.Random(13)
    word = lambda: r.choice("on th er in ou re st and of a".split()) + r.choice(["", "ly", "ing", "ed", "s"])
    texts = []
    for k in range(240):
        good = "\n".join(" ".join(word() for _ in range(r.randint(8, 30))).capitalize() + "." for _ in range(4))
        texts.append(r.choice(texts) if k > 40 and k % 9 == 0 else " ".join(word().upper() + "!!" for _ in range(50)) if k % 4 == 0 else good)
    for k in range(10, 240, 30):
        texts[k] = texts[k - 1] + " " + word()
    rows = [(k, t, f"s{k % 5}", "en", len(t)) for k, t in enumerate(texts)] + [(240, None, None, None, None), (241, "", None, "en", 0)]
    spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(k, int(not t.isupper()), 0) for k, t in enumerate(texts)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs, kept = table(spark, str(tmp_path), "documents"), []
    columns = docs.columns
    for _, stage in pipeline.STAGES:
        docs = staged(stage(spark, docs, str(tmp_path)), "t")
        kept.append(docs.collect())
    assert len(pipeline.STAGES) == 5 and all(list(x[0].asDict()) == columns for x in kept[:-1])
    ids = lambda n: [x.doc_id for x in kept[n]]
    everything = {x[0]: x[1] for x in rows}
    learn = sample(table(spark, str(tmp_path), "documents"), table(spark, str(tmp_path), "labels"), "quality", F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 != 1, quality.PER_CLASS, quality.MOST_CHARS)
    scores = quality.learned(learn).scores(list(everything.values()))
    assert sorted(ids(0)) == [i for i, s in zip(everything, scores, strict=True) if s >= 0.5]
    assert not any((everything[i] or "").isupper() for i in ids(0)) and sum(not (t or "X").isupper() for t in everything.values()) - len(ids(0)) <= 5
    assert sorted(ids(1)) == sorted(i for i, low, _, k, _ in exact_truth([(i, everything[i]) for i in ids(0)]) if k)
    assert sorted(ids(2)) == sorted(i for i, _, _, k in near_truth([(i, everything[i]) for i in ids(1)], 5, 80) if k)
    assert len(ids(2)) < len(ids(1)) < len(ids(0))
    times = Counter(ids(3))
    picks = {x.doc_id: x.whole for x in mixing.mix(spark.createDataFrame(kept[2])).collect() if x.whole}
    assert times == picks and max(times.values()) <= mixing.MAX_REPEATS
    tokens = library_ids({i: everything[i] for i in times})
    assert sum(x.length for x in kept[4]) == sum(n * len(tokens[i]) for i, n in times.items())
    assert all(list(x.ids) == tokens[x.doc_id][x.start : x.start + x.length] for x in kept[4])
    assert len(pd.DataFrame(kept[4])) == pipeline.run(spark, str(tmp_path)).count()
