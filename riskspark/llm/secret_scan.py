"""Secret scans over an incremental ledger of content-addressed blobs."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import exists, only, stored, tidied

#: The base rules in their order. A match is dropped unless its group has at least so many characters.
BASE = (
    ("assign", r"""(?ia:(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([a-z0-9+/_.=-]+))""", 2, 6),
    ("access", r"AKIA[A-Z0-9]+", 0, 20),
    ("hex", r"[0-9a-f]{24,}", 0, 24),
)
#: What follows a key's first line where no END line does: header lines, then lines of base64 alone.
_BODY = r"(?:\s*\n(?:Proc-Type|DEK-Info):[^\n]*)*(?:\s*\n[A-Za-z0-9+/=]+(?=\s*(?:\n|\Z)))*"
#: Rules beyond the base ones; they only add spans.
MORE = (
    ("pem", rf"-----BEGIN ([A-Z ]*)PRIVATE KEY-----(?:(?:(?!-----BEGIN )[\s\S])*?-----END \1PRIVATE KEY-----|{_BODY})", 0, 1),
    ("github", r"gh[pousr]_[A-Za-z0-9]{36,}", 0, 40),
)
KINDS = [k for k, *_ in (*BASE, *MORE)]
RULE_VERSION = hashlib.sha256(repr((BASE, MORE)).encode()).hexdigest()[:16]
#: A few characters that every match of a rule holds, so that most texts skip the rule's own search.
HINTS = {"access": "AKIA", "pem": "-----BEGIN ", "github": "gh"}
LEDGER = "blob_id string, rule_version string, findings array<struct<kind:string,begin:long,end:long>>, cuts array<struct<begin:long,end:long>>"
_RULES = [(k, re.compile(p), g, n) for k, p, g, n in (*BASE, *MORE)]


def find_secrets(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) in code points, by start and then by rule; leftmost and without overlap within a kind."""
    found = []
    for order, (kind, rule, group, least) in enumerate(_RULES):
        if kind in HINTS and HINTS[kind] not in text:
            continue
        for m in rule.finditer(text):
            a, b = m.span(group)
            if b - a >= least:
                found.append((m.start(), order, m.end()))
    return [(KINDS[k], a, b) for a, k, b in sorted(found)]


def _merged(found: list[tuple[str, int, int]]) -> list[dict]:
    out: list[dict] = []
    for _, a, b in found:
        if out and a <= out[-1]["end"]:
            out[-1]["end"] = max(b, out[-1]["end"])
        else:
            out.append({"begin": a, "end": b})
    return out


def _first_copies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Drops blobs that this task has sent already, so that a text with many copies is not moved with each of them."""
    sent: set[str] = set()
    for batch in batches:
        keep = []
        for i, blob in enumerate(batch.column(0).to_pylist()):
            if blob not in sent:
                if len(sent) >= 500_000:
                    sent.clear()
                sent.add(blob)
                keep.append(i)
        yield batch.take(pa.array(keep, pa.int32()))


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All copies of a blob meet in one task, which scans the first."""
    seen: set[bytes] = set()
    span = pa.struct([("begin", pa.int64()), ("end", pa.int64())])
    kind = pa.struct([("kind", pa.string()), ("begin", pa.int64()), ("end", pa.int64())])
    for batch in batches:
        ids, found, cuts = [], [], []
        for blob, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            key = bytes.fromhex(blob)
            if key in seen:
                continue
            seen.add(key)
            spans = find_secrets(text.as_py())
            ids.append(blob)
            found.append([{"kind": k, "begin": a, "end": b} for k, a, b in spans])
            cuts.append(_merged(spans))
        yield pa.RecordBatch.from_arrays(
            [pa.array(ids, pa.string()), pa.array([RULE_VERSION] * len(ids), pa.string()), pa.array(found, pa.list_(kind)), pa.array(cuts, pa.list_(span))],
            ["blob_id", "rule_version", "findings", "cuts"],
        )


def blob_id(text: Column) -> Column:
    return F.sha2(F.coalesce(text.cast("string"), F.lit("")), 256)


def scan_new(versions: DataFrame, ledger: DataFrame | None = None) -> DataFrame:
    """Ledger rows of the blobs in versions (text) that the ledger has not under the present rules; one a blob."""
    blobs = versions.select(blob_id(F.col("text")).alias("blob_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    blobs = blobs.mapInArrow(tidied(_first_copies), "blob_id string, text string")
    if ledger is not None:
        blobs = blobs.join(ledger.where(F.col("rule_version") == RULE_VERSION).select("blob_id"), "blob_id", "left_anti")
    return blobs.repartition("blob_id").mapInArrow(tidied(_scan), LEDGER)


def scan(versions: DataFrame, ledger: DataFrame | None = None) -> DataFrame:
    """versions with `findings` (kind, begin, end) and `cuts` (the merged spans) of each row's text.

    A version is any row with a text (null: empty); its text's SHA-256 is its blob. A blob is scanned once for each rule
    version, whatever the number of rows, paths or times it comes; findings then go back to every row. Repeated rows
    each return; all other columns stay, but for earlier ones of the two names.
    """
    new = stored(scan_new(versions, ledger), "ledger")
    if ledger is not None:
        new = new.unionByName(ledger.where(F.col("rule_version") == RULE_VERSION).select(*new.columns)).dropDuplicates(["blob_id"])
    return _joined(versions, new)


def _joined(versions: DataFrame, entries: DataFrame) -> DataFrame:
    rows = versions.withColumn("__blob", blob_id(F.col("text")))
    sent = entries.select(F.col("blob_id").alias("__blob"), F.col("findings").alias("__findings"), F.col("cuts").alias("__cuts"))
    kept = [F.col(f"`{c}`") for c in versions.columns if c not in ("findings", "cuts")]
    return rows.join(sent, "__blob").select(*kept, F.col("__findings").alias("findings"), F.col("__cuts").alias("cuts"))


def update_ledger(versions: DataFrame, path: str) -> DataFrame:
    """The ledger at path (a Parquet folder, made if there is none) after the blobs that it lacks were scanned and added.

    Only unseen (blob, rule version) pairs are scanned. A blob that two runs add at once, or a run that is repeated,
    leaves equal entries, of which one is read.
    """
    spark = versions.sparkSession
    old = spark.read.schema(LEDGER).parquet(path) if exists(spark, path) else None
    scan_new(versions, old).write.mode("append").option("compression", "zstd").parquet(path)
    return spark.read.schema(LEDGER).parquet(path).dropDuplicates(["blob_id", "rule_version"])


def scan_with_ledger(versions: DataFrame, path: str) -> DataFrame:
    """As scan(), by way of the persistent ledger at path, which gains what it lacked."""
    return _joined(versions, update_ledger(versions, path).where(F.col("rule_version") == RULE_VERSION))


def findings_by_path(versions: DataFrame, path: str, of: str = "path") -> DataFrame:
    """(of, blob_id, kind, begin, end): every finding of the ledger at path, joined back to every path that holds its blob."""
    rows = versions.select(F.col(f"`{of}`"), blob_id(F.col("text")).alias("blob_id")).distinct()
    known = update_ledger(versions, path).where(F.col("rule_version") == RULE_VERSION).select("blob_id", F.explode("findings").alias("f"))
    return rows.join(known, "blob_id").select(of, "blob_id", "f.kind", "f.begin", "f.end")


def redact(docs: DataFrame, mark: str = "[SECRET]") -> DataFrame:
    """docs with every found span replaced by a mark and n_chars brought up to date; columns and other texts stay."""
    free = docs.columns
    own = {c: f"__own_{c}" for c in ("findings", "cuts") if c in free}  # columns of the user's under these names
    found = scan(docs.withColumnsRenamed(own))
    begin = F.expr("transform(sequence(0, size(cuts)), i -> if(i = 0, 0L, cuts[i - 1].end))")
    parts = F.transform(begin, lambda a, i: F.substring(F.col("text"), (a + 1).cast("int"), F.coalesce(F.get("cuts", i)["begin"] - a, F.length("text")).cast("int")))
    text = F.when(F.size("cuts") > 0, F.array_join(parts, mark)).otherwise(F.col("text"))
    out = found.withColumn("text", text)
    if "n_chars" in free:
        out = out.withColumn("n_chars", F.when(F.size("cuts") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return out.select(*[F.col(f"`{own.get(c, c)}`").alias(c) for c in free])


def digest(docs: DataFrame) -> DataFrame:
    """The contract's columns for docs (doc_id, text)."""
    found = scan(only(docs, "doc_id", "text")).drop("text", "cuts")
    base = F.filter("findings", lambda x: x["kind"].isin([k for k, *_ in BASE]))
    joined = lambda spans: F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["begin"].cast("string"), x["end"].cast("string"))), ",")
    count = lambda kind: F.size(F.filter("findings", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *[count(k) for k, *_ in BASE], F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("findings")).alias("spans"))
