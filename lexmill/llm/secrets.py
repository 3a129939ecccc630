"""Secret scans with multipart credential linking.

Strong finds (assignments to secret-like names, access key ids, long hexadecimal runs) are reported wherever they are.
Weak candidates are parts that mean little alone: identifiers (user names, client ids), bare mixed tokens, and endpoints
(URLs with a scheme, IPv4 hosts). They are reported only when complementary parts stand in one scope, that is, when the gap
between them is at most `SCOPE` code points: an identifier or an endpoint beside a secret, a bare token beside an
identifier or an endpoint. Strong finds count as parts too.

The linking is an interval join: parts are keyed by their text and by the stretch of `SCOPE` code points they lie in, and
meet the parts of the same and the adjacent stretches by a semi-join, so no pair is ever a row. As a part starts in one
stretch only, the parts of a key are bounded by the stretch's length.

Everything is DataFrame functions. Whole texts are scanned once; what is staged and joined is places only, and only texts
with weak candidates are joined at all.

Defined results: null and empty texts have no spans, and their base_sha256 is that of the empty string; overlapping spans of
different kinds are all reported; repeated rows are scanned each for itself; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexmill.llm.common import staged, text_or_empty
from lexmill.llm.spans import matches, rendered

ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
BASE = ("assign", "access", "hex")

IDENTIFIER = r"""(?i:\b(user(?:name|_?id)?|login|account(?:_?id)?|client[_-]?id|tenant(?:_?id)?|key[_-]?id))["']?\x20*[:=]\x20*["']?([A-Za-z0-9@._+-]+)"""
BARE = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_-]{20,}"
#: What a bare token has of each, wherever in it.
MIXED = ("[0-9]", "[A-Z]", "[a-z]")
ENDPOINT = r"""\b(?:https?|ftps?|ssh|jdbc:[a-z]+|postgres(?:ql)?|mysql|mongodb|redis|amqps?)://[^\s"'<>]+|(?<![0-9.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?::[0-9]{1,5})?(?![0-9.])"""
WEAK = ("identifier", "bare", "endpoint")
KINDS = (*BASE, *WEAK)
SCOPE = 160
#: Which kinds complete a weak kind.
COMPLEMENTS = {"identifier": ("assign", "hex", "bare"), "bare": ("access", "identifier", "endpoint"), "endpoint": ("assign", "hex", "bare")}


def _by_place(spans: Column) -> Column:
    order = F.array(*map(F.lit, KINDS))
    keyed = F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.array_position(order, s["kind"]).alias("nth"), s["end"].alias("end"), s["kind"].alias("kind")))
    return F.transform(F.array_sort(keyed), lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))


def parts(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Per row: doc_id, row (its number), base and weak spans, before any linking."""
    clean = docs.select(F.col(doc_id).cast("long").alias("doc_id"), text_or_empty(text).alias("text"))
    t = F.col("text")
    base = F.concat(matches(t, ASSIGN, "assign", 2, 6), matches(t, ACCESS, "access"), matches(t, HEX, "hex"))
    weak = F.concat(matches(t, IDENTIFIER, "identifier", 2, 3), matches(t, BARE, "bare", holds=MIXED), matches(t, ENDPOINT, "endpoint"))
    return clean.select("doc_id", F.monotonically_increasing_id().alias("row"), base.alias("base"), weak.alias("weak"))


def linked(found: DataFrame, scope: int = SCOPE) -> DataFrame:
    """row and spans: the weak spans that a complementary part completes."""
    some = found.where(F.size("weak") > 0)
    weak = some.select("row", F.explode("weak").alias("w")).select("row", F.col("w.*"))
    every = some.select("row", F.explode(F.concat("base", "weak")).alias("p")).select(F.col("row").alias("p_row"), F.col("p.kind").alias("p_kind"), F.col("p.start").alias("p_start"), F.col("p.end").alias("p_end"))
    # A part may be longer than a stretch; it lies in each that it touches.
    stretch = lambda c: F.floor(c / F.lit(scope)).cast("int")
    weak = weak.withColumn("at", F.explode(F.sequence(stretch(F.col("start")) - 1, stretch(F.col("end")) + 1)))
    every = every.withColumn("p_at", F.explode(F.sequence(stretch(F.col("p_start")), stretch(F.col("p_end")))))
    completes = F.lit(False)
    for kind, others in COMPLEMENTS.items():
        completes = completes | ((F.col("kind") == kind) & F.col("p_kind").isin(*others))
    near = (F.col("p_start") - F.col("end") <= scope) & (F.col("start") - F.col("p_end") <= scope)
    apart = (F.col("p_start") >= F.col("end")) | (F.col("start") >= F.col("p_end"))
    hits = weak.join(every, (F.col("row") == F.col("p_row")) & (F.col("at") == F.col("p_at")) & completes & near & apart, "left_semi")
    return hits.groupBy("row").agg(F.collect_set(F.struct("kind", "start", "end")).alias("more"))


def scan(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", scope: int = SCOPE) -> DataFrame:
    """One row per row of `docs`: doc_id and `found`, its spans by start and kind, strong and linked."""
    found = staged(parts(docs, text, doc_id), "secret-parts")
    plain = found.where(F.size("weak") == 0).select("doc_id", "base", _by_place(F.col("base")).alias("found"))
    joined = found.where(F.size("weak") > 0).join(linked(found, scope), "row", "left")
    more = F.coalesce("more", F.array().cast("array<struct<kind:string,start:int,end:int>>"))
    return plain.unionByName(joined.select("doc_id", "base", _by_place(F.concat("base", more)).alias("found")))


def report(scanned: DataFrame) -> DataFrame:
    """The digest columns of a scan."""
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")
    return scanned.select(
        "doc_id",
        *[count(kind).alias(f"n_{kind}") for kind in BASE],
        F.sha2(rendered(_by_place(F.col("base"))), 256).alias("base_sha256"),
        rendered(F.col("found")).alias("spans"),
        (F.size("found") - F.size("base")).cast("long").alias("n_linked"),
    )


def redacted(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", mark: str = "[SECRET]") -> DataFrame:
    """doc_id and the text with each stretch of overlapping spans replaced by `mark`; meant for ids that are unique."""
    spans = scan(docs, text, doc_id).select("doc_id", "found")
    cut = F.aggregate(
        "found",
        F.struct(F.lit(0).alias("at"), F.lit("").alias("out")),
        lambda acc, s: F.struct(
            F.greatest(acc["at"], s["end"]).alias("at"),
            F.when(s["start"] >= acc["at"], F.concat(acc["out"], F.substring(F.col("t"), acc["at"] + 1, s["start"] - acc["at"]), F.lit(mark))).otherwise(acc["out"]).alias("out"),
        ),
        lambda acc: F.concat(acc["out"], F.substring(F.col("t"), acc["at"] + 1, F.length("t"))),
    )
    texts = docs.select(F.col(doc_id).cast("long").alias("doc_id"), text_or_empty(text).alias("t"))
    return texts.join(spans, "doc_id").select("doc_id", cut.alias("text"))
