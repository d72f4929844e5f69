"""Secret scans with corpus-wide ownership frequency."""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import from_arrow_type

from ringloom.llm.common import lean_batches, settle

#: Kinds in the order in which spans with one start are listed; the last is the method's own.
KINDS = ("assign", "access", "hex", "owned")
ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
#: A run of hex digits that is long enough; shorter runs would be dropped.
HEX = re.compile(r"[0-9a-f]{24,}")
#: Any other long token may be a credential if it looks random and one owner alone has it.
LONG = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
LEAST_VALUE, LEAST_ACCESS = 6, 20
LEAST_ENTROPY = 3.0
#: What so many owners have is a copied example; what one owner alone has is its own, however many of its repositories hold it.
EXAMPLE_OWNERS = 2



def base_spans(text: str) -> list[tuple[int, int, int, str]]:
    """(kind, start, end, secret) of the three fixed patterns: leftmost matches that don't overlap within their kind."""
    found = []
    if ":" in text or "=" in text:
        low = text.lower()
        if any(k in low for k in ("passw", "secret", "token", "apikey", "api_key")):
            found += [(0, m.start(), m.end(), m[2]) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST_VALUE]
    if "AKIA" in text:
        found += [(1, m.start(), m.end(), m[0]) for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST_ACCESS]
    found += [(2, m.start(), m.end(), m[0]) for m in HEX.finditer(text)]
    return found


def looks_random(token: str) -> bool:
    if not (any(c.isdigit() for c in token) and any(c.isalpha() for c in token)):
        return False
    n = len(token)
    return -sum(c / n * math.log2(c / n) for c in Counter(token).values()) >= LEAST_ENTROPY


def all_spans(text: str) -> list[tuple[int, int, int, str]]:
    """The base spans and, of kind 3, random-looking long tokens that overlap none of them; by start, then kind."""
    found = base_spans(text)
    taken = sorted((s, e) for _, s, e, _ in found)
    for m in LONG.finditer(text):
        if looks_random(m[0]) and not any(s < m.end() and m.start() < e for s, e in taken):
            found.append((3, m.start(), m.end(), m[0]))
    return sorted(found, key=lambda x: (x[1], x[0]))


SPANS = pa.list_(pa.struct([("kind", pa.int32()), ("start", pa.int32()), ("end", pa.int32()), ("hash", pa.binary())]))


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [
            [{"kind": k, "start": s, "end": e, "hash": hashlib.sha256(v.encode("utf-8", "replace")).digest()[:16]} for k, s, e, v in all_spans(t or "")]
            for t in batch.column("text").to_pylist()
        ]
        yield batch.drop_columns(["text"]).append_column("found", pa.array(found, SPANS))


def candidates(docs: DataFrame, columns=("doc_id", "source")) -> DataFrame:
    """For each row of `docs`, `given`, a struct of its `columns`, its `owner` (source), `row`, a number of its own, `copy`, a hash of its text, and `found`, its candidates; written once, so numbers stay as they are."""
    lean_batches(docs.sparkSession)
    held = docs.select(
        F.struct(*[docs[c] for c in columns]).alias("given"), docs["source"].alias("owner"), F.monotonically_increasing_id().alias("row"), F.xxhash64(docs["text"]).alias("copy"), docs["text"]
    )
    kind = from_arrow_type(SPANS)
    return settle(held.mapInArrow(_scan, T.StructType(held.drop("text").schema.fields).add("found", kind)), "secrets")


def ownership(found: DataFrame) -> DataFrame:
    """For each candidate's hash, its distinct repositories (texts; copies of one text are one) and owners (source), and whether it is a copied example: hash, repositories, owners, example. Spread over owners decides; repositories are told.

    Counts go up in steps, (hash, owner, text), (hash, owner) and (hash, text), (hash), each summed in part before its shuffle, so a string that a third of the corpus copies is not gathered anywhere.
    """
    each = found.select("copy", "owner", F.explode("found").alias("s")).select("copy", "owner", "s.hash").distinct()
    owners = each.select("hash", "owner").distinct().groupBy("hash").agg(F.count(F.lit(1)).alias("owners"))
    repositories = each.select("hash", "copy").distinct().groupBy("hash").agg(F.count(F.lit(1)).alias("repositories"))
    return repositories.join(owners, "hash").withColumn("example", F.col("owners") >= EXAMPLE_OWNERS)


def scan(docs: DataFrame, columns=("doc_id", "source")) -> DataFrame:
    """`columns` of each row of `docs` and its `spans`: array of (kind, start, end, hash, owners, repositories, example), by start, then kind.

    Base spans are always kept and told apart: a secret that several owners have is a widely copied example, that of one owner alone looks live. A random-looking long token becomes a span of kind `owned` only if it isn't an example. Positions are code points, ends exclusive. A null text counts as an empty one and has no spans; null owners count as one; rows that repeat have the same spans; null and large ids stay what they are; an empty table gives no rows. `docs` must have text and source, and `columns` may not hold `spans`; other columns may have any names. Sets the session's Arrow batches to 8 MB.
    """
    return _labelled(candidates(docs, columns)).select("given.*", "spans")


def _labelled(found: DataFrame) -> DataFrame:
    """`given` and `spans` of each row."""
    each = found.select("row", F.explode("found").alias("s"))
    told = each.join(ownership(found), each["s.hash"] == F.col("hash")).filter("s.kind < 3 OR NOT example")
    parts = [F.col("s.start"), F.col("s.kind").alias("kind_no"), *[F.col(c) for c in ("s.end", "s.hash", "owners", "repositories", "example")]]
    spans = told.groupBy("row").agg(F.sort_array(F.collect_list(F.struct(*parts))).alias("spans"))
    kind = lambda s: F.element_at(F.array(*[F.lit(k) for k in KINDS]), s["kind_no"] + 1).alias("kind")
    named = F.transform("spans", lambda s: F.struct(kind(s), *[s[c].alias(c) for c in ("start", "end", "hash", "owners", "repositories", "example")]))
    return found.select("given", "row").join(spans.select("row", named.alias("spans")), "row", "left").select("given", F.coalesce("spans", F.array()).alias("spans"))


def without(text: str, spans: list[tuple[int, int]]) -> str:
    """`text` with a placeholder for each of its spans, (start, end) by start; spans that overlap become one."""
    parts, at = [], 0
    for s, e in spans:
        if s >= at:
            parts += [text[at:s], PLACEHOLDER]
        at = max(at, e)
    return "".join([*parts, text[at:]])


def _redact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        given, spans = batch.column("given"), batch.column("spans")
        fields = dict(zip([f.name for f in given.type], given.flatten(), strict=True))
        has = pc.greater(pc.list_value_length(spans), 0)
        rows = zip(fields["text"].filter(has).to_pylist(), spans.filter(has).to_pylist(), strict=True)
        clean = pa.array([without(t, [(s["start"], s["end"]) for s in found]) for t, found in rows], fields["text"].type)
        fields["text"] = pc.replace_with_mask(fields["text"], has, clean)
        yield pa.RecordBatch.from_arrays(list(fields.values()), list(fields))


PLACEHOLDER = "[secret]"


def redacted(docs: DataFrame) -> DataFrame:
    """`docs` with each span of its texts, of any kind, replaced by a placeholder; spans that overlap become one. The columns stay, whatever their names, and n_chars, where there is one, tells the new length. Nulls, repeats and empty tables as for scan()."""
    spans = F.transform("spans", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end")))
    out = _labelled(candidates(docs, docs.columns)).select("given", spans.alias("spans")).mapInArrow(_redact, docs.schema)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out


def op9_secrets(spark, sf_dir: str) -> DataFrame:
    """The contract's columns, then: n_owned; how many spans are widely copied examples, and how many look live; `ownership`, kind:start:end:owners:repositories:example of all spans."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    base = F.filter("spans", lambda s: s["kind"] != KINDS[3])
    told = lambda spans, *more: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"], *[s[k] for k in more])), ",")
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return scan(docs).select(
        "doc_id", *[count(k) for k in KINDS[:3]], F.sha2(told(base), 256).alias("base_sha256"), told(F.col("spans")).alias("spans"), count(KINDS[3]),
        F.size(F.filter("spans", lambda s: s["example"])).cast("long").alias("n_example"), F.size(F.filter("spans", lambda s: ~s["example"])).cast("long").alias("n_live"),
        told(F.col("spans"), "owners", "repositories", "example").alias("ownership"),
    )
