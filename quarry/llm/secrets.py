"""Secret scans with an incremental ledger of blobs (operator 6)."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import materialize, pieces, utf8

RULE_VERSION = "2"

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
#: What every match of ASSIGN holds, in lower case.
ASSIGN_HINTS = ("passw", "secret", "token", "api")
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")  # the matches of AKIA[A-Z0-9]+ of 20 or more characters: both take whole runs
HEX = re.compile(r"[0-9a-f]{24,}")
#: Kinds that the ledger's rules add: name, what every match holds, pattern.
ADDED = (
    ("private_key", "PRIVATE KEY-----", re.compile(r"-----BEGIN (?:[A-Z]+ ){0,2}PRIVATE KEY-----")),
    ("hosting_token", "gh", re.compile(r"gh[pousr]_[A-Za-z0-9]{36,}")),
    ("web_token", "eyJ", re.compile(r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}")),
)
KINDS = ["assign", "access", "hex", *(a[0] for a in ADDED)]


def find(text: str) -> list[tuple[int, int, int]]:
    """(start, kind's number, end) of all spans, in code points, ordered by start and then kind."""
    found = []
    low = text.encode("utf-8", "surrogatepass").lower()
    if any(h.encode() in low for h in ASSIGN_HINTS):
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    for i, (_, hint, pattern) in enumerate(ADDED, 3):
        if hint in text:
            found += [(m.start(), i, m.end()) for m in pattern.finditer(text)]
    return sorted(found)


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def scan(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for part in pieces(frames, "text"):
        rows = []
        for blob, text in zip(part["blob"], part["text"], strict=True):
            spans = find(text or "")
            base = joined([s for s in spans if s[1] < 3])
            rows.append((blob, *(sum(s[1] == k for s in spans) for k in range(3)), hashlib.sha256(base.encode()).hexdigest(), joined(spans)))
        yield pd.DataFrame(rows, columns=["blob", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])


def update_ledger(versions: DataFrame, ledger: DataFrame | None = None, rule_version: str = RULE_VERSION) -> DataFrame:
    """Scan the blobs of `versions` that the ledger doesn't hold under this rule version; returns the new ledger rows.

    A blob is the SHA-256 of a text's UTF-8 bytes (null text: empty). Each new blob is scanned once, from the version
    with the smallest doc_id. Ledger rows: blob, rule_version, n_assign, n_access, n_hex, base_sha256, spans.
    """
    slim = versions.select(F.col("doc_id").cast("long").alias("doc_id"), F.unhex(F.sha2(utf8(F.col("text")), 256)).alias("blob"))
    first = slim.groupBy("blob").agg(F.min("doc_id").alias("_first"))
    if ledger is not None:
        first = first.join(ledger.filter(F.col("rule_version") == rule_version).select("blob"), "blob", "left_anti")
    texts = versions.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.unhex(F.sha2(utf8(F.col("text")), 256)).alias("_blob"))
    new = texts.join(first, (F.col("_blob") == F.col("blob")) & F.col("doc_id").eqNullSafe(F.col("_first"))).select("blob", "text")
    found = new.mapInPandas(scan, "blob binary, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")
    return materialize(found.dropDuplicates(["blob"]).withColumn("rule_version", F.lit(rule_version)), "ledger")


def scan_secrets(versions: DataFrame, ledger: DataFrame | None = None, rule_version: str = RULE_VERSION) -> DataFrame:
    """Findings of every version (row of doc_id, text) through the ledger: unseen blobs are scanned, findings joined back.

    Returns doc_id, n_assign, n_access, n_hex, base_sha256, spans for each input row. Null text: as empty, no findings.
    Null ids are kept. Repeated rows share a blob and get a row each. Very long texts are scanned whole. Empty input:
    no rows. Further columns aren't read. A group of copies costs one scan; adaptive execution splits its join.
    """
    new = update_ledger(versions, ledger, rule_version)
    all_rows = new if ledger is None else new.unionByName(ledger.filter(F.col("rule_version") == rule_version))
    paths = versions.select(F.col("doc_id").cast("long").alias("doc_id"), F.unhex(F.sha2(utf8(F.col("text")), 256)).alias("blob"))
    return paths.join(all_rows, "blob").select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans")
