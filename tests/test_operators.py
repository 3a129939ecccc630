"""Operators on small inputs, with results known beforehand, and against a brute-force model."""

import math
import random
from collections import Counter, defaultdict

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lexmill.config import BLOCKLIST, STOPWORDS, Settings
from lexmill.functions import text as T
from lexmill.operators import exchange, ngrams, scoring, statistics, tokens
from lexmill.plans import lexicon as plan


def toks(spark, *lines):
    return [r.tok for r in tokens.tokens(spark.createDataFrame([(x,) for x in lines], "text string")).collect()]


def test_tokens(spark):
    assert toks(spark, "Hello 你好世界！这是一个测试。") == ["世界", "测试"]
    assert toks(spark, "", "Hello world 123!", "哈", None) == []
    assert toks(spark, "𠀀天下㐀太平") == ["天下", "太平"]
    df = spark.createDataFrame([("你好，天下 太平",), (None,), ("",)], "text string")
    assert [(r.tok, r.start, r.end) for r in tokens.token_offsets(df).collect()] == [("天下", 3, 5), ("太平", 6, 8)]
    assert spark.createDataFrame([("a，的b",)], "text string").select(T.clean(F.col("text"))).first()[0] == "a  b"


def test_runs_take_no_look_at_each_stopword_for_every_character(spark, capsys):
    """Results for stopwords at all places, and for signs that mean something in a pattern; the pattern holds no stopword."""
    df = spark.createDataFrame([("的天下的太平的 世界了么安宁",), ("天]下地-玄^黄宇",)], "text string")
    got = lambda stop: [r.tok for r in tokens.tokens(df, stopwords=stop).collect()]
    assert got(STOPWORDS) == ["天下", "太平", "世界", "安宁", "下地", "黄宇"]
    assert got("") == ["的天下的太平的", "世界了么安宁", "下地", "黄宇"] and got("]-^下") == ["的天", "的太平的", "世界了么安宁", "黄宇"]
    assert [(r.tok, r.start, r.end) for r in tokens.token_offsets(df).limit(4).collect()] == [("天下", 1, 3), ("太平", 4, 6), ("世界", 8, 10), ("安宁", 12, 14)]
    tokens.tokens(df).explain()
    assert "&&" not in capsys.readouterr().out


def test_predicates(spark):
    df = spark.createDataFrame([("世",), ("a",), ("你好世界",), ("hello世界",), ("",), ("世\n",)], "w string")
    got = {r.w: (r.a, r.b) for r in df.select("w", T.is_han(F.col("w")).alias("a"), T.all_han(F.col("w")).alias("b")).collect()}
    assert got == {"世": (True, True), "a": (False, False), "你好世界": (False, True), "hello世界": (False, False), "": (False, True), "世\n": (False, False)}


def grams(spark, tok, max_len):
    return ngrams.ngrams(spark.createDataFrame([(tok, 1)], "tok string, c long"), max_len)


def test_ngrams(spark):
    got = Counter((r.word, r.l, r.r) for r in grams(spark, "你好世界", 3).collect())
    want = ["$你好", "$你好世", "$你好世界", "你好世", "你好世界", "你好世界$", "好世界", "好世界$", "世界$"]
    assert got == Counter([(w[1:-1], w[0], w[-1]) for w in want])
    assert len(grams(spark, "天" * 10, 4).collect()) == 4 * 7 + 3 + 2 + 1


def test_very_long_token(spark):
    """A run of many stretches gives what one cut gives."""
    r = random.Random(3)
    tok = "".join(r.choice("天地玄黄宇宙") for _ in range(1300))
    want = Counter()
    for i in range(len(tok)):
        for j in range(1, min(5, len(tok) - i) + 1):
            want[(tok[i : i + j], tok[i - 1] if i else "$", tok[i + j] if i + j < len(tok) else "$")] += 1
    got = Counter({(x.word, x.l, x.r): x.c for x in grams(spark, tok, 5).groupBy("word", "l", "r").agg(F.sum("c").alias("c")).collect()})
    assert got == want


def test_entropy(spark):
    rows = [("你", "好", 2), ("你", "们", 1), ("你好", "世", 1), ("你好", "界", 1), ("词", "A", 3)]
    df = spark.createDataFrame(rows, "word string, ctx string, c long")
    got = {r.word: (r.freq, r.entropy) for r in statistics.side_entropy(df).collect()}
    assert got == {"你": (3, 0.918296), "你好": (2, 1.0), "词": (3, 0.0)}
    assert math.copysign(1, got["词"][1]) == 1
    assert {r.word for r in statistics.side_entropy(df, min_freq=3).collect()} == {"你", "词"}
    assert {r.word for r in statistics.side_entropy(df, min_entropy=0.95).collect()} == {"你好"}


def test_merge(spark):
    make = lambda rows: spark.createDataFrame(rows, "word string, freq long, entropy double")
    merged = lambda a, b, least=-1.0: {tuple(r) for r in statistics.merged_entropy(make(a), make(b), least).collect()}
    assert merged([("天下", 100, 3.0), ("天地", 80, 2.5)], [("天下", 100, 4.0), ("天地", 80, 2.0)]) == {("天下", 100, 3.0), ("天地", 80, 2.0)}
    assert merged([("天", 100, 3.0), ("地", 60, 1.0)], [("天", 100, 4.0), ("地", 60, 0.8)], 2.0) == {("天", 100, 3.0)}
    assert merged([("天下", 1, 1.0)], [("天地", 1, 1.0)]) == merged([], []) == set()


STATS = [("你好", 10, 1.0), ("世界", 8, 1.0), ("你", 5, 1.0), ("好", 3, 1.0)]


@pytest.fixture(scope="module")
def stats(spark):
    return spark.createDataFrame(STATS, "word string, freq long, entropy double").cache()


def test_index_and_pmi(spark, stats):
    indexed = statistics.index(stats, 2)
    assert statistics.single_total(indexed).first().total == 8
    got = {r.word: r.pmi for r in scoring.with_pmi(stats, indexed).collect()}
    assert got["你好"] == pytest.approx(math.log2(80 / 15)) and got["世界"] == got["你"] == got["好"] == 0.0
    empty = statistics.index(stats, 1000)
    assert statistics.single_total(empty).first().total == 0
    assert {r.pmi for r in scoring.with_pmi(stats, empty).collect()} == {0.0}


def test_extract_words(spark, stats):
    indexed = statistics.index(stats, 2)
    table = spark.createDataFrame([("你", 0.1, 0.2, 0.3), ("好", 0.3, 0.2, 0.1)], "ch string, p_s double, p_m double, p_e double")
    words = lambda *a: [r.word for r in scoring.ordered(scoring.extract_words(stats, indexed, *a)).collect()]
    assert words(None, 0.0, 0.1) == ["你好", "世界"]
    assert words(table.limit(0), 0.0, 0.1) == ["你好", "世界"]
    assert words(table, 0.0, 0.2) == [] and words(table, 0.0, 0.05) == ["你好"] and words(table, 0.0, 0.0) == ["你好", "世界"]
    more = stats.unionByName(spark.createDataFrame([(b + "程", 9, 1.0) for b in BLOCKLIST], stats.schema))
    assert [r.word for r in scoring.ordered(scoring.extract_words(more, indexed, None, 0.0)).collect()] == ["你好", "世界"]


def test_ties_are_in_the_order_of_code_points(spark):
    rows = spark.createDataFrame([(w, 5) for w in ("玄黄", "天地", "宇宙")] + [("日月", 6)], "word string, freq long")
    assert [r.word for r in scoring.ordered(rows).collect()] == ["日月", *sorted(["玄黄", "天地", "宇宙"])]


def test_tags(spark, stats):
    tags = spark.createDataFrame([("你好", "l"), ("你好", "l")], "word string, tag string")
    assert {r.word: r.pos for r in scoring.with_tags(stats, tags).collect()} == {"你好": "l", "世界": "x", "你": "x", "好": "x"}
    assert {r.pos for r in scoring.with_tags(stats, None).collect()} == {"x"}


def test_exchange(spark, stats):
    assert exchange.bucket_count(0) == 1 and exchange.bucket_count(9 << 30) == 3 and exchange.bucket_count(1 << 50, most=64) == 64
    dealt = exchange.sorted_buckets(stats, 3)
    parts = [list(p) for p in dealt.rdd.glom().collect()]
    assert sum(map(len, parts)) == 4 and all([(r.bucket, r.word) for r in p] == sorted((r.bucket, r.word) for r in p) for p in parts)
    flat = [r.word for p in exchange.sorted_ranges(stats, 2).rdd.glom().collect() for r in p]
    assert flat == sorted(w for w, _, _ in STATS)
    assert exchange.concatenated(stats, stats, stats).count() == 12
    assert exchange.sharded(stats, 2).rdd.getNumPartitions() == 2
    assert exchange.spread(stats, 0) is stats
    line = spark.createDataFrame([("天地\t玄",), ("\t天",), ("天地",)], "v string").select(T.bucket_hash(F.col("v")).alias("h")).collect()
    assert line[0].h == line[2].h != line[1].h


def brute(lines, s: Settings):
    """The lexicon by plain loops: word -> (freq, pmi, entropy)."""
    sides = {"l": defaultdict(Counter), "r": defaultdict(Counter)}
    for line in lines:
        run = ""
        for c in (line or "") + " ":
            if "一" <= c <= "龥" and c not in s.stopwords:
                run += c
                continue
            if len(run) > 1:
                for i in range(len(run)):
                    for j in range(i + 1, min(i + s.max_len, len(run)) + 1):
                        sides["l"][run[i:j]][run[i - 1] if i else "$"] += 1
                        sides["r"][run[i:j]][run[j] if j < len(run) else "$"] += 1
            run = ""
    bits = lambda c: -sum(v / c.total() * math.log2(v / c.total()) for v in c.values())
    freq = {w: c.total() for w, c in sides["r"].items() if c.total() >= s.min_freq}
    single = sum(v for w, v in freq.items() if len(w) == 1)
    out = {}
    for w, f in freq.items():
        h = round(min(bits(sides["l"][w]), bits(sides["r"][w])), 6)
        if len(w) > 1 and h >= s.entropy and not any(b in w for b in s.blocklist):
            pmi = math.log2(f * single / max(freq[w[:k]] * freq[w[k:]] for k in range(1, len(w))))
            if pmi >= s.pmi:
                out[w] = (f, pmi, h)
    return out


def check(spark, lines, s, prune=False):
    df = spark.createDataFrame([(x,) for x in lines], "text string")
    got = {r.word: (r.freq, r.pmi, r.entropy) for r in plan.lexicon(df, settings=s, prune=prune).collect()}
    want = brute(lines, s)
    assert got.keys() == want.keys()
    for w, (f, pmi, h) in want.items():
        assert got[w][0] == f and got[w][1] == pytest.approx(pmi, abs=1e-9) and got[w][2] == pytest.approx(h, abs=2e-6)


@pytest.mark.parametrize("prune", [False, True])
def test_lexicon_against_brute_force(spark, prune):
    r = random.Random(11)
    lines = ["".join(r.choice("天地玄黄宇宙洪荒的a。") for _ in range(60)) for _ in range(60)] + [None, "", "天" * 50]
    check(spark, lines, Settings(max_len=4, min_freq=2, pmi=-1.0, entropy=0.5), prune)


@settings(max_examples=6, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.text(alphabet="天地玄黄的锟斤拷 a", max_size=25), max_size=12))
def test_lexicon_of_any_lines(spark, lines):
    check(spark, lines, Settings(max_len=3, min_freq=1, pmi=-20.0, entropy=0.0))


def test_keys_and_partitions_do_not_change_a_lexicon(spark):
    r = random.Random(5)
    lines = [(k % 2, "".join(r.choice("天地玄黄宇 ") for _ in range(50))) for k in range(40)]
    df, s = spark.createDataFrame(lines, "part long, text string"), Settings(max_len=3, min_freq=3, pmi=-2.0, entropy=0.1)
    both = {(x.part, x.word, x.freq, round(x.pmi, 9), x.entropy) for x in plan.lexicon(df, settings=s, keys=("part",)).collect()}
    alone = set()
    for part in (0, 1):
        own = df.where(F.col("part") == part).repartition(7)
        alone |= {(part, x.word, x.freq, round(x.pmi, 9), x.entropy) for x in plan.lexicon(own, settings=s).collect()}
    assert both == alone and both


def test_settings_are_checked():
    with pytest.raises(ValueError, match="max_len"):
        Settings(max_len=1)
    with pytest.raises(ValueError, match="min_freq"):
        Settings(min_freq=0)
    assert len(set(STOPWORDS)) == 29
