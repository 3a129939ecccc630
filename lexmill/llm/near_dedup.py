"""MinHash near-deduplication by a multi-index Hamming join.

A document's set is its distinct 3-word shingles, as 64-bit hashes. Its signature is `SYMBOLS` minima of b bits each (b = 16),
and two sets of Jaccard similarity s differ in a symbol with probability 1 - s. Signatures are cut into chunks; by pigeonhole,
two signatures that differ in at most 2 * chunks - 1 symbols (the radius) have a chunk with at most one error. Each chunk
therefore gives one key for each of its symbols left out, and all pairs within the radius share a key. The number of chunks
follows from the wanted similarity (`chunks_for`): a pair of exactly that similarity lies outside the radius with a
probability of `LOSS` at most, and it falls steeply above. Similarities that need chunks too short to tell texts apart are refused.

1. Sets of equal content are one node (size and two 64-bit sums of the set), so exact copies never meet as pairs. It stands for
   a row that has an id, by which its text is read again; where none has one, the text is found by a digest.
2. Keys of two or more nodes are buckets; buckets of equal content are one. Signature distances link their nodes.
3. Components of these links are clusters. Exact intersections of the sets of a cluster confirm links.
4. Components of the confirmed links are the result. No step makes a row for each pair, and none caps what it compares.

Steps 2 and 3 search groups of any size alike (`linked_groups`): a group is cut by a hash into tiles, bounded in rows and in bytes,
and two pivots go with each tile. A breadth-first search in each cell gives one row a node at most. Where tiles don't become
one component by it, the nodes outside the group's largest component meet all others in pairs of tiles; the largest
component's own pairs, which are most in groups of near copies, are never compared.

Hot groups: copies are pre-aggregated; a bucket or cluster of any size is cut into cells of bounded size; the joins that
bring results back to the copies are on keys that adaptive execution may split.

Defined results: null texts and texts without words have an empty set, size 0, and are linked with nothing; with one or two
words the whole sequence is the only shingle; repeated rows have equal sets and so one component; a row without an id links
others as any row, is never the smallest of its component and is kept; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from math import comb

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmill.llm.common import dropped, staged, without_ids
from lexmill.llm.graph import components

SYMBOLS = 64
#: The most that may be lost of pairs at exactly the wanted similarity.
LOSS = 1e-5
#: Symbols of a chunk, at least: with fewer, keys would tell too few texts apart.
LEAST_CHUNK = 3
WORDS = 3
PERCENT = 85
#: Nodes, and bytes of their sets, of a tile of a cluster. A cell holds two tiles, or one and two pivots.
TILE, TILE_BYTES = 512, 8 << 20
#: Nodes of a tile of a bucket, which is searched by signatures only.
BUCKET_TILE = 2048
#: Node ids that may be broadcast as a filter of the second scan (16 bytes each); beyond it, the scan is joined by shuffle.
BROADCAST_NODES = 500_000
#: Distinct words whose hashes a worker keeps.
CACHE = 100_000
_M = np.random.default_rng(20240229)
_SEED = _M.integers(1, 2**32, SYMBOLS, dtype=np.uint32)
_FACTOR = _M.integers(1, 2**32, SYMBOLS, dtype=np.uint32) | np.uint32(1)
_PLACE = _M.integers(1, 2**63, WORDS, dtype=np.uint64) | np.uint64(1)
_KEY = _M.integers(1, 2**63, SYMBOLS, dtype=np.uint64) | np.uint64(1)
_SALT = _M.integers(1, 2**63, SYMBOLS, dtype=np.uint64)
_MIX = np.uint64(0x9E3779B97F4A7C15)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _MIX
    return x ^ (x >> np.uint64(29))


class WordHashes(dict):
    """64-bit hashes of words, computed once while they are kept."""

    def __missing__(self, word: bytes) -> int:
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


class Shingler:
    """Sorted arrays of the distinct shingle hashes of texts."""

    def __init__(self, words: int = WORDS):
        self.words, self.hashes = words, WordHashes()

    def __call__(self, text: str | None) -> np.ndarray:
        words = text.encode().lower().split() if text else []
        if not words:
            return np.empty(0, dtype=np.uint64)
        if len(self.hashes) > CACHE:
            self.hashes.clear()
        h = np.fromiter(map(self.hashes.__getitem__, words), dtype=np.uint64, count=len(words))
        n = min(self.words, len(h))
        total = np.full(len(h) - n + 1, n, dtype=np.uint64)
        for k in range(n):
            total += _mixed(h[k : len(h) - n + 1 + k] ^ _PLACE[k % WORDS] * np.uint64(k // WORDS + 1))
            total *= _MIX
        return np.unique(_mixed(total))


def signatures(flat: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """A row of 16-bit symbols for each non-empty set; sets lie one after another in `flat`."""
    out = np.empty((len(starts), SYMBOLS), dtype=np.uint16)
    low = (flat >> np.uint64(32)).astype(np.uint32)
    x = np.empty_like(low)
    for k in range(SYMBOLS):
        np.bitwise_xor(low, _SEED[k], out=x)
        np.multiply(x, _FACTOR[k], out=x)
        np.bitwise_xor(x, x >> np.uint32(15), out=x)
        np.multiply(x, _FACTOR[-1 - k], out=x)
        least = np.minimum.reduceat(x, starts)
        out[:, k] = (least * np.uint32(0x85EBCA6B)) >> np.uint32(16)
    return out


def chunks_for(percent: int) -> int:
    """The fewest chunks whose radius loses at most `LOSS` of the pairs of this similarity. ValueError if they are too short."""
    differ = 1 - percent / 100
    for chunks in range(1, SYMBOLS // LEAST_CHUNK + 1):
        if sum(comb(SYMBOLS, k) * differ**k * (1 - differ) ** (SYMBOLS - k) for k in range(2 * chunks, SYMBOLS + 1)) <= LOSS:
            return chunks
    raise ValueError(f"a similarity of {percent} % is too low for signatures of {SYMBOLS} symbols")


def chunk_bounds(chunks: int) -> list[tuple[int, int]]:
    edges = [round(SYMBOLS * k / chunks) for k in range(chunks + 1)]
    return list(zip(edges, edges[1:], strict=False))


def chunk_keys(symbols: np.ndarray, chunks: int) -> np.ndarray:
    """For each signature one key per symbol: its chunk with that symbol left out."""
    weighed = symbols.astype(np.uint64) * _KEY
    keys = np.empty(weighed.shape, dtype=np.uint64)
    for low, high in chunk_bounds(chunks):
        keys[:, low:high] = weighed[:, low:high].sum(1, dtype=np.uint64)[:, None] - weighed[:, low:high]
    return _mixed(keys + _SALT).view(np.int64)


_SIGNED = "doc_id long, digest long, n long, f1 long, f2 long, keys array<long>, sig binary"


def _sign(words: int, chunks: int) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    def flush(ids: list, digests: list, sets: list[np.ndarray]) -> pd.DataFrame:
        sizes = np.array([len(s) for s in sets], dtype=np.int64)
        some = np.flatnonzero(sizes)
        f1, f2 = np.zeros(len(sets), dtype=np.uint64), np.zeros(len(sets), dtype=np.uint64)
        keys: list = [[]] * len(sets)
        sig = [b""] * len(sets)
        if len(some):
            flat = np.concatenate([sets[k] for k in some])
            starts = np.concatenate([[0], np.cumsum(sizes[some])[:-1]])
            f1[some], f2[some] = np.add.reduceat(flat, starts), np.add.reduceat(_mixed(flat * _PLACE[0]), starts)
            symbols = signatures(flat, starts)
            for k, row, own in zip(some.tolist(), symbols, chunk_keys(symbols, chunks), strict=True):
                keys[k], sig[k] = own, row.tobytes()
        return pd.DataFrame({"doc_id": pd.array(ids, dtype="Int64"), "digest": pd.array(digests, dtype="Int64"), "n": sizes, "f1": f1.view(np.int64), "f2": f2.view(np.int64), "keys": keys, "sig": sig})

    def sign(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shingle = Shingler(words)
        ids, digests, sets, held = [], [], [], 0
        for frame in frames:
            for doc_id, digest, text in zip(frame["doc_id"], frame["digest"], frame["text"], strict=True):
                ids.append(None if pd.isna(doc_id) else int(doc_id))
                digests.append(None if digest == "" else int(digest))
                sets.append(shingle(text))
                held += len(sets[-1])
                if held > 1 << 18 or len(ids) >= 4096:
                    yield flush(ids, digests, sets)
                    ids, digests, sets, held = [], [], [], 0
        if ids:
            yield flush(ids, digests, sets)

    return sign


def runs(frames: Iterator[pd.DataFrame], by: list[str]) -> Iterator[pd.DataFrame]:
    """The frames of a sorted partition cut anew, so that each ends where a group of `by` ends."""
    kept: list[pd.DataFrame] = []
    for frame in frames:
        if not len(frame):
            continue
        last = np.ones(len(frame), dtype=bool)
        for c in by:
            last &= (frame[c] == frame[c].iloc[-1]).to_numpy()
        cut = len(frame) - (len(last) if last.all() else int(last[::-1].argmin()))
        if kept and not all(kept[-1][c].iloc[-1] == frame[c].iloc[0] for c in by):
            yield pd.concat(kept)
            kept = []
        if cut:
            yield pd.concat([*kept, frame[:cut]])
            kept = []
        if cut < len(frame):
            kept.append(frame[cut:])
    if kept:
        yield pd.concat(kept)


def _groups(frame: pd.DataFrame, by: list[str]) -> Iterator[tuple[int, int]]:
    new = np.zeros(len(frame), dtype=bool)
    for c in by:
        v = frame[c].to_numpy()
        new[1:] |= v[1:] != v[:-1]
    edges = [0, *np.flatnonzero(new).tolist(), len(frame)]
    return zip(edges, edges[1:], strict=False)


def tree_edges(n: int, near: Callable[[int, np.ndarray], np.ndarray], labels: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Edges that join what a graph of n nodes joins, by breadth-first search; near(at, others): those of `others` that `at` has an edge to.

    Nodes of one label are joined already, and aren't compared. Small labels come first, as each node of a label is compared
    with all nodes that are left.
    """
    labels = np.arange(n) if labels is None else np.unique(labels, return_inverse=True)[1]
    unseen = np.argsort(np.bincount(labels)[labels], kind="stable") if n else np.arange(0)
    edges = []
    while len(unseen):
        own = labels[unseen] == labels[unseen[0]]
        queue, unseen = unseen[own].tolist(), unseen[~own]
        while queue and len(unseen):
            at = queue.pop()
            found = near(at, unseen)
            if len(found):
                edges += [(at, x) for x in found.tolist()]
                joined = np.isin(labels[unseen], labels[found])
                queue += unseen[joined].tolist()
                unseen = unseen[~joined]
    return edges


def within_radius(symbols: np.ndarray, radius: int, labels: np.ndarray | None = None) -> list[tuple[int, int]]:
    """`tree_edges` of the graph of signatures at most `radius` apart."""
    return tree_edges(len(symbols), lambda at, others: others[(symbols[others] != symbols[at]).sum(1) <= radius], labels)


def linked(sizes: np.ndarray, flat: np.ndarray, percent: int, labels: np.ndarray | None = None) -> list[tuple[int, int]]:
    """`tree_edges` of the graph of sets of similarity >= percent / 100; the sets lie one after another in `flat`."""
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype(np.int64)
    _, local = np.unique(flat, return_inverse=True)
    marks = np.zeros(int(local.max(initial=0)) + 1, dtype=np.int32)

    def near(at: int, others: np.ndarray) -> np.ndarray:
        # Sets of too different a size can't be similar; only the rest are counted.
        able = others[100 * np.minimum(sizes[others], sizes[at]) >= percent * np.maximum(sizes[others], sizes[at])]
        if not len(able):
            return able
        own = local[starts[at] : starts[at] + sizes[at]]
        marks[own] = 1
        if len(able) * 2 > len(sizes):
            common = np.add.reduceat(marks[local], starts)[able]
        else:
            common = np.array([marks[local[starts[x] : starts[x] + sizes[x]]].sum() for x in able.tolist()])
        marks[own] = 0
        return able[100 * common >= percent * (sizes[able] + sizes[at] - common)]

    return tree_edges(len(sizes), near, labels)


Link = Callable[[list[bytes], np.ndarray], list[tuple[int, int]]]


def by_signature(radius: int) -> Link:
    return lambda payload, labels: within_radius(np.frombuffer(b"".join(payload), dtype=np.uint16).reshape(-1, SYMBOLS), radius, labels)


def by_content(percent: int) -> Link:
    return lambda payload, labels: linked(np.array([len(s) // 8 for s in payload], dtype=np.int64), np.frombuffer(b"".join(payload), dtype=np.uint64), percent, labels)


def _search(link: Link) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    by = ["group", "i", "j"]

    def search(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in runs(frames, by):
            nodes, labels, payload = frame["node"].to_numpy(), frame["label"].to_numpy(), frame["payload"].tolist()
            pairs = {(int(nodes[a + x]), int(nodes[a + y])) for a, b in _groups(frame, by) for x, y in link(payload[a:b], labels[a:b])}
            yield pd.DataFrame(list(pairs), columns=["a", "b"], dtype="int64")

    return search


def linked_groups(members: DataFrame, payloads: DataFrame, link: Link, tile: int, tile_bytes: int) -> DataFrame:
    """node and root of all nodes that `link` joins within any group, over all groups; a staged table.

    members: group, node, bytes, and of the group: rows, all_bytes, lo, hi (two of its nodes, the pivots). payloads: node, payload.
    """
    tiles = lambda rows, size: F.greatest(F.ceil(rows / tile), F.ceil(size / tile_bytes), F.lit(1)).cast("int")
    members = staged(members.withColumn("tiles", tiles(F.col("rows"), F.col("all_bytes"))), "members")

    def edges(cells: DataFrame) -> DataFrame:
        dealt = cells.join(payloads, "node").repartition("group", "i", "j").sortWithinPartitions("group", "i", "j", "node")
        return dealt.mapInPandas(_search(link), "a long, b long")

    own = lambda n: F.pmod(F.xxhash64("node"), n).cast("int")
    upto = lambda n: F.sequence(F.lit(0), n - 1)
    pivot = (F.col("node") == F.col("lo")) | (F.col("node") == F.col("hi"))
    first = members.withColumn("i", F.explode(F.when(pivot, upto(F.col("tiles"))).otherwise(F.array(own(F.col("tiles"))))))
    roots = staged(components(edges(first.select("group", "i", F.lit(-1).alias("j"), "node", F.col("node").alias("label"))), "a", "b"), "roots")
    cut = members.where("tiles > 1")
    if not cut.limit(1).count():
        return roots

    rooted = cut.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    parts = rooted.groupBy("group", "root").agg(F.count(F.lit(1)).alias("n"), F.sum("bytes").alias("size"))
    largest = F.max(F.struct("n", "size", "root"))
    per = parts.groupBy("group").agg(F.count(F.lit(1)).alias("parts"), F.sum("n").alias("n"), F.sum("size").alias("size"), largest.alias("top")).where("parts > 1")
    per = per.select("group", F.col("top.root").alias("top"), tiles(F.col("top.n"), F.col("top.size")).alias("tops"), tiles(F.col("n") - F.col("top.n"), F.col("size") - F.col("top.size")).alias("others"))
    left = staged(rooted.select("group", "node", "root").join(per, "group"), "left")
    if not left.limit(1).count():
        return roots
    # Cells (i, j) of two tiles of others, i <= j, and (i, -1 - j) of one of others with one of the largest component.
    among = F.transform(upto(F.col("others")), lambda k: F.struct(F.least(k, own(F.col("others"))).alias("i"), F.greatest(k, own(F.col("others"))).alias("j")))
    toward = F.transform(upto(F.col("tops")), lambda k: F.struct(own(F.col("others")).alias("i"), (-1 - k).alias("j")))
    asked = F.transform(upto(F.col("others")), lambda k: F.struct(k.alias("i"), (-1 - own(F.col("tops"))).alias("j")))
    second = left.withColumn("cell", F.explode(F.when(F.col("root") == F.col("top"), asked).otherwise(F.concat(among, toward))))
    more = staged(edges(second.select("group", "cell.i", "cell.j", "node", F.col("root").alias("label"))), "more")
    if not more.limit(1).count():
        return roots
    joined = staged(components(roots.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(more), "a", "b"), "roots")
    dropped(left, roots)
    return joined


def _sets(words: int) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    def sets(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shingle = Shingler(words)
        for frame in frames:
            own = [shingle(t) for t in frame["text"]]
            out = frame.drop(columns="text")
            f1 = np.array([s.sum(dtype=np.uint64) for s in own], dtype=np.uint64).view(np.int64)
            out["payload"] = [s.tobytes() for s in own]
            # Rows that repeat an id with another text aren't the node's.
            yield out[(f1 == out["f1"].to_numpy()) & (np.array([len(s) for s in own]) == out["n"].to_numpy())].drop(columns=["f1", "n"])

    return sets


def near_dedup(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """One row per row of `docs`: doc_id, n_shingles, component_id, kept."""
    chunks = chunks_for(percent)
    clean = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    # As text, as pandas would read a column with nulls as floats.
    digest = F.when(F.col("doc_id").isNull(), F.xxhash64("text").cast("string")).otherwise("")
    signed = staged(clean.withColumn("digest", digest).mapInPandas(_sign(words, chunks), _SIGNED).withColumn("row", F.monotonically_increasing_id()), "signed")
    content = ["n", "f1", "f2"]
    groups = staged(signed.where("n > 0").groupBy(*content).agg(F.coalesce(F.min(F.when(F.col("doc_id").isNotNull(), F.col("row"))), F.min("row")).alias("node"), F.min("doc_id").alias("rep_id")), "groups")
    nodes = staged(signed.join(groups.select(F.col("node").alias("row")), "row", "left_semi").select(F.col("row").alias("node"), "doc_id", "digest", *content, "keys", "sig"), "nodes")

    pivots = [F.count(F.lit(1)).alias("rows"), F.min("node").alias("lo"), F.max("node").alias("hi")]
    keyed = nodes.select(F.explode("keys").alias("group"), "node")
    counted = keyed.groupBy("group").agg(*pivots, F.bit_xor(F.xxhash64("node")).alias("x1"), F.bit_xor(F.xxhash64(F.lit(1), "node")).alias("x2")).where("rows > 1")
    buckets = counted.groupBy("rows", "lo", "hi", "x1", "x2").agg(F.min("group").alias("group")).select("group", "rows", "lo", "hi", (F.col("rows") * 2 * SYMBOLS).alias("all_bytes"))
    members = keyed.join(buckets, "group").withColumn("bytes", F.lit(2 * SYMBOLS).cast("long"))
    clusters = linked_groups(members, nodes.select("node", F.col("sig").alias("payload")), by_signature(2 * chunks - 1), BUCKET_TILE, TILE_BYTES)

    wanted = staged(clusters.join(nodes.select("node", "doc_id", "digest", "n", "f1"), "node").withColumn("bytes", 8 * F.col("n")), "wanted")
    total, known = wanted.agg(F.count(F.lit(1)), F.count("doc_id")).first()

    def read_again(rows: DataFrame, own: DataFrame, by: str) -> DataFrame:
        picked = rows.join(F.broadcast(own) if total <= BROADCAST_NODES else own, by).select("node", "n", "f1", "text")
        return picked.mapInPandas(_sets(words), "node long, payload binary")

    sets = read_again(clean, wanted.select("doc_id", "node", "n", "f1"), "doc_id")
    if known < total:
        nameless = clean.where("doc_id is null").select(F.xxhash64("text").alias("digest"), "text")
        # Copies of a text all have its digest; one is enough.
        again = read_again(nameless, wanted.where("doc_id is null").select("digest", "node", "n", "f1"), "digest")
        sets = sets.unionByName(again.groupBy("node").agg(F.first("payload").alias("payload")))
    sets = staged(sets, "sets")
    sizes = wanted.groupBy("root").agg(*pivots, F.sum("bytes").alias("all_bytes"))
    clustered = wanted.select("root", "node", "bytes").join(sizes, "root").withColumnRenamed("root", "group")
    parts = linked_groups(clustered, sets, by_content(percent), TILE, TILE_BYTES)

    smallest = parts.join(groups.select("node", "rep_id"), "node").groupBy("root").agg(F.min("rep_id").alias("component_id"))
    joined = parts.join(smallest, "root").select("node", "component_id")
    named = groups.join(joined, "node", "left").select(*content, F.coalesce("component_id", "rep_id").alias("component_id"))
    dropped(nodes, clusters, wanted, sets)
    component = F.coalesce("component_id", "doc_id")
    return signed.select("doc_id", *content).join(named, content, "left").select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"))


def without_near_copies(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """The rows of `docs` whose document stays, with all their columns: of each component, the smallest doc_id."""
    return without_ids(docs, near_dedup(docs, words=words, percent=percent).where("not kept").select("doc_id"))


SQL = r"""
with recursive d as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents),
s as (select distinct doc_id, array_to_string(w[k:k + 2], ' ') as g from d, unnest(generate_series(1, greatest(1, len(w) - 2))) as u(k) where len(w) > 0),
n as (select doc_id, count(*) as n from s group by doc_id),
p as (select a.doc_id as a, b.doc_id as b, count(*) as c from s a join s b on a.g = b.g and a.doc_id < b.doc_id group by all),
l as (select a, b from p join n x on x.doc_id = a join n y on y.doc_id = b where 100 * c >= 85 * (x.n + y.n - c)),
e as (select a, b from l union all select b, a from l),
r as (select doc_id, doc_id as other from d union select r.doc_id, e.b from r join e on e.a = r.other)
select r.doc_id, coalesce(max(n.n), 0)::bigint as n_shingles, min(other) as component_id, r.doc_id = min(other) as kept from r left join n using (doc_id) group by r.doc_id
"""
