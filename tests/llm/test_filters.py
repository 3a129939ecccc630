"""Secrets, pseudonyms, toxicity, quality: against brute force and held-out labels, and with odd rows."""

import hashlib
import random
import re
import time
import zlib
from datetime import date

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexmill.llm import pii, quality, queries, secrets, toxicity
from lexmill.llm.common import table

DOCS = "doc_id long, text string, lang string, source string, n_chars long, row long, text_sha256 string"


def docs_of(spark, texts):
    rows = [(k, t, None, None, None, k % 2, "x") for k, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


def base_spans(text):
    text = text or ""
    kinds = [("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6), ("access", r"AKIA[A-Z0-9]+", 0, 20), ("hex", r"[0-9a-f]+", 0, 24)]
    found = [(m.start(), n, m.end(), kind) for n, (kind, p, g, least) in enumerate(kinds) for m in re.finditer(p, text) if len(m.group(g)) >= least]
    return [f"{kind}:{s}:{e}" for s, _, e, kind in sorted(found)]


ODD = [
    None, "", " ", "token=abc", "token=abcdef", "Password: 'hunter2hunter' 𝄞 secret = x1y2z3 and API_KEY=" + "q" * 40, "AKIA" + "A" * 15 + " AKIA" + "B" * 16 + "é",
    "x" + "0123456789abcdef" * 2 + "g" + "ab" * 11, "é𝄞token:123456token=1234567", "user: bob login=alice99 password=abc123 https://h.example/x 10.0.0.1:80",
    "Zk3" * 9 + " far", "client_id=ab12cd " + "w " * 10 + "Zk3" * 9, "client_id=ab12cd " + "w " * 200 + "Zk3" * 9, ("lorem ipsum " * 20000) + "secret=zzzzzz1",
]


def test_secrets_against_brute_force(spark, sf_dir):
    for docs in (docs_of(spark, ODD), table(spark, sf_dir, "documents")):
        texts = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
        rows = secrets.report(secrets.scan(docs)).collect()
        assert len(rows) == len(texts)
        for r in rows:
            want = base_spans(texts[r.doc_id])
            assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(x.startswith(k) for x in want) for k in ("assign", "access", "hex"))
            assert r.base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest()
            assert set(want) <= set(r.spans.split(",")) or not want


def all_spans(text):
    """Base spans, and weak ones that a complementary part stands near to, by comparing all pairs."""
    text = text or ""
    base = [(int(x.split(":")[1]), secrets.KINDS.index(x.split(":")[0]), int(x.split(":")[2])) for x in base_spans(text)]
    weak = []
    for kind, pattern, group in (("identifier", secrets.IDENTIFIER, 2), ("bare", secrets.BARE, 0), ("endpoint", secrets.ENDPOINT, 0)):
        for m in re.finditer(pattern, text, re.ASCII):
            if kind == "endpoint" or (kind == "identifier" and len(m.group(group)) >= 3) or (kind == "bare" and all(re.search(p, m.group()) for p in secrets.MIXED)):
                weak.append((m.start(), secrets.KINDS.index(kind), m.end()))
    linked = []
    for s, n, e in weak:
        near = [(x, z) for x, m, z in base + weak if secrets.KINDS[m] in secrets.COMPLEMENTS[secrets.KINDS[n]] and (x >= e or s >= z)]
        if any(x - e <= secrets.SCOPE and s - z <= secrets.SCOPE for x, z in near):
            linked.append((s, n, e))
    return ",".join(f"{secrets.KINDS[n]}:{s}:{e}" for s, n, e in sorted(base + linked))


def test_linked_spans_against_all_pairs(spark, sf_dir):
    r = random.Random(3)
    bits = ["token=abcdef1", "user: bob", "login=alice9", "https://h.example/x", "10.0.0.1:80", "AKIA" + "B" * 16, "0a" * 13, "Zk3" * 9, "client_id=ab12cd", "\u00e9\U0001d11e", " ", "\n"]
    mixed = ["".join(r.choice(bits) + r.choice([" ", " ", "w " * r.randint(1, 90)]) for _ in range(r.randint(1, 25))) for _ in range(150)]
    for docs in (docs_of(spark, ODD + mixed), table(spark, sf_dir, "documents")):
        texts = {x.doc_id: x.text for x in docs.select("doc_id", "text").collect()}
        got = {x.doc_id: x.spans for x in secrets.report(secrets.scan(docs)).collect()}
        assert got == {i: all_spans(t) for i, t in texts.items()}


def test_a_text_of_very_many_secrets(spark):
    text = " ".join(f"token=abcdef{k} user=u{k}x" for k in range(40_000))
    began = time.time()
    row = secrets.report(secrets.scan(docs_of(spark, [text]))).collect()[0]
    assert (row.n_assign, row.n_linked) == (40_000, 40_000) and time.time() - began < 60
    want = base_spans(text)
    assert row.base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest()


def test_weak_parts_are_reported_only_together(spark):
    got = {r.doc_id: r.spans for r in secrets.report(secrets.scan(docs_of(spark, ODD))).collect()}
    assert {"identifier", "assign", "endpoint"} <= {x.split(":")[0] for x in got[9].split(",")}
    assert got[10] == ""  # a bare token alone
    assert {x.split(":")[0] for x in got[11].split(",")} == {"identifier", "bare"}
    assert got[12] == ""  # complementary, but too far apart
    out = {r.doc_id: r.text for r in secrets.redacted(docs_of(spark, ["a token=abcdef b", "plain", None])).collect()}
    assert out == {0: "a [SECRET] b", 1: "plain", 2: ""}


def test_bare_tokens_that_are_mixed_far_from_their_beginning(spark):
    tokens = ["a" * 80 + "9A", "a" * 81 + "9A", "A" * 300 + "b" * 300 + "7", "a" * 300 + "9", "A" * 300 + "9", "aA" * 150]
    got = {r.doc_id: r.spans for r in secrets.report(secrets.scan(docs_of(spark, [f"client_id=ab12cd {t} x" for t in tokens]))).collect()}
    for k, t in enumerate(tokens):
        assert (f"bare:17:{17 + len(t)}" in got[k].split(",")) == (k < 3), t


def test_secrets_of_an_empty_table(spark):
    assert secrets.report(secrets.scan(docs_of(spark, []))).count() == 0


def luhn(digits):
    return sum(d if k % 2 == 0 else d * 2 - 9 * (d > 4) for k, d in enumerate(map(int, reversed(digits)))) % 10 == 0


KEY = "k"


def pseudonymised(docs):
    return pii.pseudonymised(docs, key=KEY)


def number(*parts):
    return int(hashlib.sha256("|".join(parts).encode()).hexdigest()[:12], 16)


def plain_permuted(left, right, a, b, name):
    for i in range(pii.ROUNDS):
        if i % 2 == 0:
            left = (left + number(f"{KEY}|{name}", str(i), str(right))) % a
        else:
            right = (right + number(f"{KEY}|{name}", str(i), str(left))) % b
    return left, right


def plain_chars(value, name):
    def shifted(chars, other, i):
        salt = f"{KEY}|{name}|{i}|{len(chars)}|{other.lower()}"
        stream, out = hashlib.sha256(salt.encode()).hexdigest() + hashlib.sha256((salt + "+").encode()).hexdigest(), ""
        for j, c in enumerate(chars):
            by = int(stream[(j % 32) * 4 :][:4], 16)
            first, n = (48, 10) if c.isdigit() else (97, 26) if c.islower() else (65, 26)
            out += chr(first + (ord(c) - first + by) % n)
        return out

    left, right = value[: len(value) // 2], value[len(value) // 2 :]
    for i in range(pii.ROUNDS):
        if i % 2 == 0:
            left = shifted(left, right, i)
        else:
            right = shifted(right, left, i)
    return left + right


def plain_day(day, accepted, name):
    zero = date(1800, 1, 1).toordinal()
    n = day.toordinal() - zero
    while True:
        left, right = plain_permuted(n % 189, n // 189, 189, 773, name)
        n = right * 189 + left
        if accepted(found := date.fromordinal(zero + n)):
            return found


def refill(shape, chars):
    left = iter(chars)
    return "".join(next(left) if c.isalnum() else c for c in shape)


def day_or_none(y, m, d):
    try:
        return date(int(y), int(m), int(d))
    except ValueError:
        return None


def plain_pseudonym(v):
    """The same maps, one value at a time, in plain integers and strings."""
    digits = re.sub(r"\D", "", v)
    if "@" in v:
        local, _, host = v.partition("@")
        return refill(local, plain_chars(re.sub("[^A-Za-z0-9]", "", local), "email")) + "@" + host
    if re.fullmatch(r"\d+(\.\d+){3}", v):
        n = int.from_bytes(bytes(map(int, v.split("."))), "big")
        blocks = [(int.from_bytes(bytes(map(int, ip.split("."))), "big"), bits) for ip, bits in pii.BLOCKS]
        own = lambda n: next(((f, b) for f, b in blocks if f <= n < f + 2**b), None)
        home = own(n)
        first, bits = home or (0, 32)
        a, b = 2 ** (bits // 2), 2 ** (bits - bits // 2)
        while True:
            left, right = plain_permuted((n - first) // b, (n - first) % b, a, b, f"ip|{first}")
            n = first + left * b + right
            if home or own(n) is None:
                return ".".join(map(str, n.to_bytes(4, "big")))
    if re.fullmatch(r"\d{4}-\d\d-\d\d", v):
        day = day_or_none(*v.split("-"))
        return plain_day(day, lambda d: True, "iso").isoformat() if day else v
    if re.fullmatch(r"\d\d?([./])\d\d?\1\d{4}", v):
        sign = "/" if "/" in v else "."
        a, b, y = v.split(sign)
        fits = lambda part, n: len(part) == 2 or n <= 9
        if day := day_or_none(y, b, a):
            to = plain_day(day, lambda d: fits(a, d.day) and fits(b, d.month), f"day{sign}{len(a)}{len(b)}")
            x, z = to.day, to.month
        elif day := day_or_none(y, a, b):
            to = plain_day(day, lambda d: fits(a, d.month) and d.day > 12, f"month{sign}{len(a)}{len(b)}")
            x, z = to.month, to.day
        else:
            return v
        return f"{x:0{len(a)}}{sign}{z:0{len(b)}}{sign}{to.year}"
    if re.fullmatch(r"\d{3}-\d\d-\d{4}", v):
        area, group, serial = map(int, v.split("-"))
        areas = [x for x in range(1, 900) if x != 666]
        if area not in areas or not group or not serial:
            return v
        left, right = plain_permuted(areas.index(area) * 99 + group - 1, serial - 1, 898 * 99, 9999, "ssn")
        return f"{areas[left // 99]:03}-{left % 99 + 1:02}-{right + 1:04}"
    if 13 <= len(digits) <= 19 and v[0].isdigit():
        if not luhn(digits):
            return v
        body = digits[:6] + plain_chars(digits[6:-1], "card")
        return refill(v, body + next(c for c in "0123456789" if luhn(body + c)))
    code = re.sub(r"\D", "", m.group()) if (m := re.match(pii.COUNTRY, v)) else ""
    own = digits[len(code) :]
    if code in ("", "1") and re.fullmatch("[2-9][0-9]{2}[2-9][0-9]{6}", own):
        left, right = plain_permuted(int(own[:3]) - 200, int(own[3:]) - 2000000, 800, 8000000, "phone")
        return refill(v, f"{code}{left + 200}{right + 2000000}")
    return refill(v, code + own[0] + plain_chars(own[1:], "phone"))


VALUES = [
    "anna.b-7@mail.example.com", "Q@x.de", "192.168.0.77", "10.1.2.3", "172.31.255.1", "8.8.8.8", "127.0.0.1", "203.0.113.9", "8.252.9.145", "255.255.255.255", "2023-02-28", "2024-02-29", "28.02.2023", "02/28/2023", "12/25/2020", "1/2/2020",
    "31.1.1999", "1.12.2001", "3/31/2020", "05/3/2020", "123-45-6789", "665-01-0001", "899-99-9999", "4111 1111 1111 1111", "4111-1111-1111-1111", "3782 822463 10005", "+1 (456) 555-2186", "555-223-4567", "555-123-4567", "+44 20 7946 0958",
    "+49 555 223 4567", "+353 1 234 5678",
]


def test_pseudonyms_against_a_plain_network(spark):
    """Every value of a text, by another implementation; formats stay, and what isn't valid stays whole."""
    kept = ["2023-02-30", "4111 1111 1111 1112", "000-12-3456", "666-12-3456", "900-12-3456", "123-00-6789", "123-45-0000", "31/31/2020", "v1.2", "nothing"]
    rows = {r.doc_id: r for r in pseudonymised(docs_of(spark, [f"<{v}> and <{v}>" for v in VALUES + kept] + [None, "", "long " * 30000 + VALUES[0]])).collect()}
    for k, v in enumerate(VALUES):
        new = plain_pseudonym(v)
        assert rows[k].text == f"<{new}> and <{new}>" and rows[k].n_found == 2 * (new != v), (v, new)
        shape = lambda x: re.sub("[A-Z]", "A", re.sub("[a-z]", "a", re.sub("[0-9]", "0", x)))
        assert shape(new) == shape(v) or v.count(".") == 3, (v, new)
        assert new != v, v
    for k, v in enumerate(kept, len(VALUES)):
        assert rows[k].n_found == 0 and rows[k].text == f"<{v}> and <{v}>", v
    n = len(VALUES) + len(kept)
    assert (rows[n].text, rows[n].n_found) == (None, 0) and (rows[n + 1].text, rows[n + 1].n_found) == ("", 0)
    assert rows[n + 2].text.endswith(plain_pseudonym(VALUES[0]))
    new = dict(zip(VALUES, map(plain_pseudonym, VALUES), strict=True))
    assert new["192.168.0.77"].startswith("192.168.") and new["10.1.2.3"].startswith("10.") and new["172.31.255.1"].startswith("172.")
    assert luhn(re.sub(r"\D", "", new["4111 1111 1111 1111"])) and new["4111-1111-1111-1111"].replace("-", " ") == new["4111 1111 1111 1111"]
    assert new["+49 555 223 4567"].startswith("+49 ") and new["+353 1 234 5678"].startswith("+353 ")


def test_pseudonyms_of_documents_against_a_plain_network(spark, sf_dir):
    """Whole texts of the table: the values that the pattern gives, each mapped by the other implementation."""
    docs = table(spark, sf_dir, "documents")
    texts = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
    found = 0
    for r in pseudonymised(docs).collect():
        text = texts[r.doc_id]
        pieces = re.split(f"({'|'.join(x.replace('%s', '') for x in (pii.EMAIL, pii.IPV4, pii.ISO_DATE))})", text) if text else []
        # Kinds whose search doesn't depend on the others are looked for again here.
        own = [p for p in pieces[1::2] if p and plain_pseudonym(p) != p]
        assert all(plain_pseudonym(p) in r.pseudonyms for p in own)
        found += len(own)
        new = list(r.pseudonyms)
        assert len(new) == r.n_found and (text is None) == (r.text is None)
        if not new:
            assert r.text == text
    assert found > 5


def test_pseudonyms_of_values_beside_other_digits(spark):
    """Values that stand beside others or beside plain numbers are found, each with the pseudonym that it has alone."""
    card, plain_card, amex, phone, odd = "4111-1111-1111-1111", "4111111111111111", "3782 822463 10005", "555-123-4567", "41111 11111 11111 1"
    spaced, far = "4111 1111 1111 1111", "+44 20 7946 0958"
    cases = [
        ("call {} {}", [phone, "555-987-6543"]), ("{} {} {}", [phone, "555-987-6543", "555-222-3333"]), ("qty 2 {}", [card]), ("id 12 {}", [plain_card]), ("{} {}", [phone, spaced]),
        ("{} {}", [spaced, phone]), ("{} 7 {} 12", [spaced, amex]), ("2023 {} 2024", [spaced]), ("{} {}", [spaced, "28.02.2023"]), ("{} {}", [spaced, "123-45-6789"]),
        ("{} {} {}", [card, spaced, plain_card]), ("{} {}", [far, spaced]), ("1234567890123 {}", [phone]), ("<{}>", [odd]), ("1 22 333 4444 1 22 333 4444", []),
        ("17 {}", ["1234-5678-9012-3452"]), ("{}, {}", ["4111111111111111@mail.example.com", card]),
    ]
    texts = [c.format(*v) for c, v in cases]
    rows = {r.doc_id: r for r in pseudonymised(docs_of(spark, texts)).collect()}
    for k, (c, values) in enumerate(cases):
        assert rows[k].text == c.format(*map(plain_pseudonym, values)), texts[k]
        assert all(plain_pseudonym(v) != v for v in values) and rows[k].n_found == len(values), texts[k]


def test_pseudonyms_are_one_to_one(spark):
    """All days of four years, in each form, and all values of small domains, map to different ones."""
    day = F.date_add(F.lit("2019-01-01").cast("date"), F.col("id").cast("int"))
    forms = ["yyyy-MM-dd", "dd/MM/yyyy", "d/M/yyyy", "M/d/yyyy", "dd.MM.yyyy", "MM.dd.yyyy"]
    values = spark.range(1461).select(F.explode(F.array(*[F.date_format(day, f) for f in forms])).alias("v")).distinct()
    rows = values.select("v", pii.pseudonym(F.col("v"), KEY).alias("p")).collect()
    assert len({r.p for r in rows}) == len(rows) > 5000
    assert all(re.sub("[0-9]", "0", r.p) == re.sub("[0-9]", "0", r.v) for r in rows)
    some = random.Random(1).sample(rows, 300)
    assert [r.p for r in some] == [plain_pseudonym(r.v) for r in some]
    ssn = spark.range(3000).select(F.format_string("123-45-%04d", "id").alias("v"))
    other = ssn.select("v", pii.pseudonym(F.col("v"), KEY).alias("a"), pii.pseudonym(F.col("v"), "another").alias("b")).collect()
    assert len({r.a for r in other}) == 3000 and sum(r.a == r.b for r in other) < 30
    local = spark.range(3000).select(F.format_string("172.16.%d.%d", F.floor(F.col("id") / 256).cast("int"), (F.col("id") % 256).cast("int")).alias("v"))
    moved = [r[0] for r in local.select(pii.pseudonym(F.col("v"), KEY)).collect()]
    assert len(set(moved)) == 3000 and all(16 <= int(x.split(".")[1]) < 32 for x in moved)


def labelled(spark, n, bad, good, column):
    """Documents of two kinds, labelled, with odd rows among them."""
    r = random.Random(4)
    word = lambda: "".join(r.choice(["on", "th", "er", "in", "ou", "re", "st"]) for _ in range(r.randint(1, 4)))
    texts = [(bad if k % 3 == 0 else good)(word, r) for k in range(n)]
    docs = spark.createDataFrame([(k, t, "en", "s", 1, "x") for k, t in enumerate(texts)] + [(n, None, None, None, None, None), (n + 1, "", None, None, None, None), (n + 2, "word " * 60000, "a", "b", 3, "x"), (0, texts[0], "en", "s", 1, "x")], "doc_id long, text string, lang string, source string, score long, label string")
    labels = spark.createDataFrame([(k, int((k % 3 == 0) == (column == "toxic"))) for k in range(n)] + [(None, 1), (1, None)], f"doc_id long, {column} int")
    return docs, labels


def plain(word, r):
    return "\n".join(" ".join(word() for _ in range(r.randint(5, 25))).capitalize() + "." for _ in range(r.randint(1, 6)))


def scores_of(rows, n, high):
    assert len(rows) == n + 4 and all(0 <= x.score <= 1 and x.predicted == int(x.score >= 0.5) for x in rows)
    held = [x for x in rows if x.held_out and x.doc_id < n]
    return np.mean([x.predicted == int((x.doc_id % 3 == 0) == high) for x in held]), held


def test_toxicity_on_the_held_out_fold(spark):
    # Of 240 labelled rows, too few for such a network, it learns less (0.88 was measured); of 640 this much:
    docs, labels = labelled(spark, 800, lambda w, r: plain(w, r) + " you stupid idiot " + plain(w, r), plain, "toxic")
    rows = toxicity.toxicity(docs, labels).collect()
    accuracy, held = scores_of(rows, 800, True)
    assert accuracy > 0.9
    assert all(x.held_out == (zlib.crc32(str(x.doc_id).encode()) % 5 == 0) for x in rows)
    assert {x.doc_id for x in held} == {k for k in range(800) if zlib.crc32(str(k).encode()) % 5 == 0}
    again = {(x.doc_id, x.score) for x in toxicity.toxicity(docs, labels).collect()}
    assert again == {(x.doc_id, x.score) for x in rows}


def test_every_window_is_scored():
    """One word far inside a long text sets the score, wherever it stands."""
    r = random.Random(1)
    make = lambda n: " ".join(r.choice("anon therer inou reston shand".split()) for _ in range(n))
    rows = [(make(60) + (" scum idiot " if k % 2 else " ") + make(60), k % 2) for k in range(200)]
    score = toxicity.Scorer(toxicity.trained(rows))
    clean, at = make(3000), (0, 1500, 2999)
    dirty = [" ".join(w[:k] + ["scum", "idiot"] + w[k:]) for k in at for w in [clean.split()]]
    low, *high = score([clean, *dirty])
    assert low < 0.5 < min(high)
    n = len(clean.split())
    windows = toxicity.window_rows(np.arange(1, n + 1))
    assert set(windows.ravel()) - {0} == set(range(1, n + 1))


def plain_score(net, text):
    """A document's score word by word: every window by itself, each direction a loop over plain vectors."""
    p = {k: v.astype(np.float64) for k, v in net.p.items()}
    words, width, stride, n = toxicity.words_of(text), toxicity.WIDTH, toxicity.STRIDE, toxicity.STATE
    squash = lambda x: 1 / (1 + np.exp(-x))

    def vector(word):
        grams, _ = toxicity.grams_of([word])
        return p["words"][net.vocabulary.get(word, 0)] + p["grams"][grams].mean(0)

    def read(vectors, side):
        h, out = np.zeros(n), []
        for v in vectors:
            gates, own = v @ p["input"][side] + p["bias"][side, 0], h @ p["state"][side]
            z, r = squash(gates[:n] + own[:n]), squash(gates[n : 2 * n] + own[n : 2 * n])
            h = z * h + (1 - z) * np.tanh(gates[2 * n :] + r * own[2 * n :])
            out.append(h)
        return out

    best, at = -np.inf, 0
    while True:
        vectors = [vector(w) for w in words[at : at + width]]
        both = [np.concatenate(x) for x in zip(read(vectors, 0), read(vectors[::-1], 1)[::-1], strict=True)]
        weights = np.exp([np.tanh(b @ p["attend"]) @ p["query"] for b in both])
        pooled = sum((w * b for w, b in zip(weights / weights.sum(), both, strict=True)), np.zeros(2 * n)) if both else np.zeros(2 * n)
        best = max(best, pooled @ p["out"] + p["out_bias"][0])
        if at + width >= len(words):
            return squash(best)
        at += stride


def test_toxicity_of_documents_against_single_windows(spark, sf_dir):
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    odd = spark.createDataFrame([(None, None), (-1, ""), (-2, "1 2 3"), (-3, "Idiot"), (-4, "\u00e9 " * 16), (-5, "b " * 17), (-6, "x" * 500)], "doc_id long, text string")
    docs = docs.select("doc_id", "text").unionByName(odd)
    net = toxicity.trained(toxicity.sample(docs, labels, "toxic", toxicity.doc_fold(F.col("doc_id"), 5) != 0, toxicity.PER_CLASS, toxicity.MOST_CHARS))
    texts = {r.doc_id: r.text for r in docs.collect()}
    rows = toxicity.toxicity(docs, labels).collect()
    assert {r.doc_id for r in rows} == set(texts) and len(rows) == len(texts)
    assert max(abs(r.score - plain_score(net, texts[r.doc_id])) for r in rows) < 1e-4
    assert all(r.predicted == int(r.score >= 0.5) for r in rows)


def test_gradients_of_the_network():
    rows = np.array([[1, 2, 3, 0], [2, 2, 1, 3]])
    net = toxicity.Network({"aa": 1}, 3)
    for k, v in net.p.items():
        net.p[k] = v.astype(np.float64)
    words, y = ["aa", "bb", "cc"], np.array([1.0, 0.0])

    def loss():
        z = net.forward(net.projected(net.vectors(words)[0]), rows)[0]
        return (np.logaddexp(0, z) - y * z).sum()

    z, kept = net.forward(net.projected(net.vectors(words)[0]), rows, keep=True)
    g, d = net.backward(rows, kept, 1 / (1 + np.exp(-z)) - y, 3)
    g["input"], g["bias"] = net.vectors(words)[0].T[None] @ d, d.sum(1, keepdims=True)
    for name, grad in g.items():
        at = np.unravel_index(np.abs(grad).argmax(), grad.shape)
        keep, step = net.p[name][at], 1e-3
        net.p[name][at] = keep + step
        up = loss()
        net.p[name][at] = keep - step
        down = loss()
        net.p[name][at] = keep
        assert (up - down) / (2 * step) == pytest.approx(grad[at], rel=2e-2, abs=2e-4), name


def junk(word, r):
    kind = r.randint(0, 2)
    if kind == 0:
        return " ".join(w.upper() + "!!" for w in (word() for _ in range(60)))
    if kind == 1:
        return " ".join(" ".join([word()] * 14) for _ in range(8))
    return " ".join(word() + r.choice(["&&&", "***", "%%%"]) for _ in range(60))


def test_quality_on_the_held_out_fold(spark):
    docs, labels = labelled(spark, 300, junk, plain, "quality")
    rows = quality.quality(docs, labels).collect()
    accuracy, _ = scores_of(rows, 300, False)
    assert accuracy > 0.95
    assert all(x.held_out == (zlib.crc32(str(x.doc_id).encode()) % 3 == 1) for x in rows)
    kept = quality.good_documents(docs, labels)
    assert kept.schema == docs.schema
    good = {x.doc_id for x in rows if x.predicted}
    assert sorted(r.doc_id for r in kept.collect()) == sorted(x.doc_id for x in rows if x.doc_id in good)


def test_forward_backward_against_all_labelings():
    """Marginals equal sums over all label sequences."""
    import itertools

    r = np.random.default_rng(3)
    sizes = np.array([4, 1, 3])
    evidence, stay = r.normal(size=8), np.array([0.7, 1.3])
    ahead, behind = quality.Chains(sizes).forward_backward(evidence, stay)
    got, at = 1 / (1 + np.exp(-(ahead + behind))), 0
    for n in sizes:
        own, total, bad = evidence[at : at + n], 0.0, np.zeros(n)
        for y in itertools.product((0, 1), repeat=int(n)):
            w = np.exp(sum(e for e, v in zip(own, y, strict=True) if v) + sum(stay[a] for a, b in zip(y, y[1:], strict=False) if a == b))
            total, bad = total + w, bad + w * np.array(y)
        assert got[at : at + n] == pytest.approx(bad / total)
        at += n


@pytest.mark.parametrize("operator", [toxicity.toxicity, quality.quality])
def test_classifiers_without_rows_or_labels(spark, operator):
    docs = docs_of(spark, ["a b c", None])
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert operator(docs.limit(0), labels).count() == 0
    assert {r.score for r in operator(docs, labels).collect()} == {1.0 if operator is quality.quality else 0.0}
    assert quality.good_documents(docs, labels).count() == 2


def test_registered(spark):
    numbers = sorted(int(n[2:].split("_")[0]) for n in queries.queries())
    assert numbers == list(range(1, 11)) and set(queries.oracle_sql()) <= set(queries.queries())
