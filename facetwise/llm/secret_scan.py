"""Secret scans with multipart credential linking.

Base kinds, leftmost without overlap within a kind, over the whole text (spans in code
points, end exclusive): ``assign`` (a keyword set to a value of 8 or more characters),
``access`` (AKIA identifiers of 16 or more) and ``hex`` (32 or more hex digits).

Weak candidates are reported only when their complementary parts stand near: a weak
``secret`` (16 or more characters of a key alphabet with digits and letters of both cases,
or 24 with digits and letters, at least 3 bits a character) needs an access identifier or
a weak ``ident`` (an account keyword set to a value); a weak ``ident`` needs a secret
(assign, hex or weak); an ``endpoint`` (URL or host with port) needs both. Near means: in
the same scope, a paragraph, with at most ``LINK_CHARS`` code points between the two.
Weak candidates that overlap a base span are left out.

The parts of all texts are rows; linking is an interval join of candidates with
complements on (text, scope, bin), bins being ``LINK_CHARS`` wide, so a bin holds a
bounded number of parts however long a text is.

Defined results: null is the empty text and has no span. Texts are read whole, however
long, in time that is linear in their length. Spans of one start come in the order of the
kinds. Each input row has its own result; copies have equal ones. An empty table gives an
empty result. Extra columns are ignored.
"""
from __future__ import annotations

import math
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from facetwise.llm import textkit as K
from facetwise.llm.tables import with_row_id, written

LINK_CHARS = 160
#: Order of kinds at one start.
KINDS = ("assign", "access", "hex", "ident", "secret", "endpoint")

ASSIGN = re.compile(r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
IDENT = re.compile(r"""(?i:access_?key_?id|client_?id|account|user(?:name)?|login)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.@-]{3,}""", re.ASCII)
SECRET = re.compile(r"[A-Za-z0-9+/_-]{16,}")
#: A URL, or a run of host characters before a port, which no match may start within.
ENDPOINT = re.compile(r"""https?://[^\s"'<>]+|(?<![\w.-])[a-z0-9.-]++(?=:[0-9]{2,5}\b):[0-9]+""", re.ASCII)
HOST = re.compile(r"[a-z0-9-]+(?:\.[a-z0-9-]+)+:[0-9]+")
PARAGRAPH = re.compile(r"\n[\x20\t\r]*\n")

_PARTS = "doc_id bigint, base array<struct<start:int,kind:int,stop:int>>, parts array<struct<start:int,kind:int,stop:int,scope:int>>"
_SPAN = pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("stop", pa.int32())])
_PART = pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("stop", pa.int32()), ("scope", pa.int32())])


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of the base kinds, in order."""
    out = []
    for m in ASSIGN.finditer(text):
        if m.end() - m.start(1) >= 8:
            out.append((m.start(), 0, m.end()))
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


def weak_spans(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Weak candidates that overlap no base span."""
    out = [(m.start(), 3, m.end()) for m in IDENT.finditer(text)]
    out += [(m.start(), 4, m.end()) for m in SECRET.finditer(text) if _key_like(m.group())]
    if "://" in text or ":" in text:
        out += [(s, 5, m.end()) for m in ENDPOINT.finditer(text) if (s := _endpoint_start(m)) is not None]
    if not base:
        return sorted(out)
    covered, reach = [], 0
    for s, _, e in base:  # merged base intervals
        if covered and s <= reach:
            covered[-1][1] = reach = max(reach, e)
        else:
            covered.append([s, e])
            reach = e
    kept, k = [], 0
    for span in sorted(out):
        while k < len(covered) and covered[k][1] <= span[0]:
            k += 1
        if k == len(covered) or covered[k][0] >= span[2]:
            kept.append(span)
    return kept


def _endpoint_start(match: re.Match) -> int | None:
    """Where a URL or a host with port starts: behind empty labels and leading hyphens."""
    found = match.group()
    if "://" in found:
        return match.start()
    host = found[found.rfind("..") + 2 if ".." in found else 0:].lstrip(".-")
    return match.end() - len(host) if HOST.fullmatch(host) else None


def _key_like(word: str) -> bool:
    digit, small, large = any(c.isdigit() for c in word), any(c.islower() for c in word), any(c.isupper() for c in word)
    if not digit or not (small and large or (small or large) and len(word) >= 24):
        return False
    n = len(word)
    return sum(-c / n * math.log2(c / n) for c in Counter(word).values()) >= 3.0


def _scan(batches):
    for rows, texts in K.slices(batches):
        base, parts = [], []
        for text in texts.to_pylist():
            own = base_spans(text)
            weak = weak_spans(text, own)
            base.append([{"start": s, "kind": k, "stop": e} for s, k, e in own])
            found = []
            if weak:  # base spans only matter as complements of weak ones
                breaks, scope = [m.end() for m in PARAGRAPH.finditer(text)], 0
                for s, k, e in sorted(own + weak):
                    while scope < len(breaks) and breaks[scope] <= s:
                        scope += 1
                    found.append({"start": s, "kind": k, "stop": e, "scope": scope})
            parts.append(found)
        columns = {n: rows.column(i) for i, n in enumerate(rows.schema.names) if n != "text"}
        columns |= {"base": pa.array(base, pa.list_(_SPAN)), "parts": pa.array(parts, pa.list_(_PART))}
        yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))


def _near(parts: DataFrame, kinds: tuple[int, ...], others: tuple[int, ...], reach: int) -> DataFrame:
    """Parts of some kinds that have a part of other kinds near."""
    own = parts.where(F.col("kind").isin(*kinds)).withColumn("bin", F.explode(F.sequence(F.floor((F.col("start") - reach) / reach), F.floor((F.col("stop") + reach) / reach))))
    other = (parts.where(F.col("kind").isin(*others)).withColumn("bin", F.explode(F.sequence(F.floor(F.col("start") / reach), F.floor(F.col("stop") / reach))))
             .select("row_id", "scope", "bin", F.col("start").alias("s"), F.col("stop").alias("e")))
    near = own.join(other, ["row_id", "scope", "bin"]).where((F.col("s") <= F.col("stop") + reach) & (F.col("e") + reach >= F.col("start")) & ~((F.col("s") < F.col("stop")) & (F.col("e") > F.col("start"))))
    return near.select("row_id", "scope", "start", "kind", "stop").distinct()


def secret_scan(spark: SparkSession, docs: DataFrame, link_chars: int = LINK_CHARS) -> DataFrame:
    """One row per input row: doc_id, base and linked (arrays of start, kind number, stop)."""
    tagged = with_row_id(spark, docs, "row_id")
    source = tagged.select("row_id", tagged["doc_id"].cast("long").alias("doc_id"), tagged["text"].cast("string").alias("text"))
    schema = f"row_id struct<f:bigint,i:bigint>, {_PARTS}"
    rows = written(spark, source.mapInArrow(_scan, schema), "secret-parts")
    parts = rows.where("size(parts) > 0").select("row_id", F.explode("parts").alias("p")).select("row_id", "p.*")
    secret = _near(parts, (4,), (1, 3), link_chars)
    ident = _near(parts, (3,), (0, 2, 4), link_chars)
    key = ["row_id", "scope", "start", "kind", "stop"]
    endpoint = _near(parts, (5,), (1, 3), link_chars).join(_near(parts, (5,), (0, 2, 4), link_chars), key, "left_semi")
    linked = secret.unionByName(ident).unionByName(endpoint).groupBy("row_id").agg(F.array_sort(F.collect_list(F.struct("start", "kind", "stop"))).alias("linked"))
    none = F.array().cast("array<struct<start:int,kind:int,stop:int>>")
    return rows.join(linked, "row_id", "left").select("doc_id", "base", F.coalesce("linked", none).alias("linked"))


def digest(found: DataFrame) -> DataFrame:
    """The report columns of ``secret_scan``'s rows."""
    names = F.array(*[F.lit(k) for k in KINDS])
    told = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["stop"].cast("string"))), ",")
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")
    return found.select("doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"), F.sha2(told(F.col("base")), 256).alias("base_sha256"),
                        told(F.array_sort(F.concat("base", "linked"))).alias("spans"))
