"""Secret scans with an incremental ledger of content-addressed blobs.

Every version of a document is a blob, named by the SHA-256 of its text. The ledger holds, for each blob and rule version
that has been scanned, its findings. A scan hashes all versions (narrow), finds the blobs that the ledger lacks under the
present rule version, scans one copy of each, adds the results to the ledger, and joins the findings back to every path.

Without a ledger every blob is unseen and is scanned where it lies. With one, only texts of unseen blobs reach the scanner:
their ids are the build side of a hash join, which Spark broadcasts when few are new and otherwise shuffles texts by, once in a
blob's lifetime; if none is new, no text is read for scanning. Null text counts as the empty blob. Repeated rows keep a
row each. Spans that begin at one place are in the order of their kinds. Very long texts are scanned whole. An empty table gives an empty result and ledger; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import with_text, written

#: Base kinds in their order: pattern, group measured, least length of it.
BASE = {
    "assign": (r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    "access": (r"AKIA[A-Z0-9]+", 0, 16),
    "hex": (r"[0-9a-f]+", 0, 32),
}
#: Kinds that this scanner adds.
MORE = {
    "pem": (r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 0),
    "jwt": (r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 0, 0),
    "github": (r"gh[oprsu]_[A-Za-z0-9]{36,}", 0, 0),
    "slack": (r"xox[abprs]-[A-Za-z0-9-]{10,}", 0, 0),
    "url_auth": (r"[a-z][a-z0-9+.-]{1,20}://[^\s/@:]+:[^\s/@]+@", 0, 0),
}
#: A substring without which a kind can't match; None where there is none.
NEEDED = {"access": "AKIA", "pem": "-----BEGIN", "jwt": "eyJ", "slack": "xox", "url_auth": "://"}
KINDS = {**BASE, **MORE}
#: Changes with the rules, so that blobs are scanned again.
VERSION = hashlib.sha256(repr(sorted(KINDS.items())).encode()).hexdigest()[:16]
LEDGER = "blob binary, version string, n_assign long, n_access long, n_hex long, base string, spans string"
_COMPILED = {k: (re.compile(p.replace("[0-9a-f]+", "[0-9a-f]{32,}") if k == "hex" else p, re.A | (re.I if k == "assign" else 0)), g, n) for k, (p, g, n) in KINDS.items()}


def find(text: str) -> list[tuple[int, int, str, int]]:
    """(start, order of the kind, kind, end) of every span, by start, then kind; a kind's matches don't overlap."""
    out = []
    for order, (kind, (pattern, group, least)) in enumerate(_COMPILED.items()):
        if kind in NEEDED and NEEDED[kind] not in text:
            continue
        for m in pattern.finditer(text):
            if m.end(group) - m.start(group) >= least:
                out.append((m.start(), order, kind, m.end()))
    return sorted(out)


def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A ledger row for every blob of a batch; copies within it are scanned once."""
    for batch in batches:
        rows = []
        blobs = {}
        for text in pc.fill_null(batch.column("text"), ""):
            raw = text.as_buffer().to_pybytes()
            blobs[hashlib.sha256(raw).digest()] = raw
        for blob, raw in blobs.items():
            found = find(raw.decode())
            n = [sum(f[2] == k for f in found) for k in BASE]
            joined = [",".join(f"{k}:{a}:{b}" for a, _, k, b in found if k in of) for of in (BASE, KINDS)]
            rows.append((blob, VERSION, *n, *joined))
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [()] * 7, (pa.binary(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()), strict=True)],
            names=[x.split()[0] for x in LEDGER.split(", ")],
        )


def scan_secrets(docs: DataFrame, ledger: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Findings of every row (doc_id, counts, base, spans), and the ledger's new rows, to be appended to it.

    ``ledger``: what earlier scans returned, of any rule version.
    """
    narrow = with_text(docs)
    blobs = written(narrow.select("doc_id", F.unhex(F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256)).alias("blob")))
    if ledger is None:  # everything is unseen: texts are scanned where they lie
        new = written(narrow.select("text").mapInArrow(scan, LEDGER).dropDuplicates(["blob"]))
    else:
        one = blobs.groupBy("blob").agg(F.min("doc_id").alias("of"))
        unseen = written(one.join(ledger.filter(F.col("version") == VERSION), "blob", "left_anti"))
        if unseen.isEmpty():
            texts = narrow.select("text").limit(0)
        else:
            texts = narrow.join(unseen.hint("shuffle_hash"), F.col("doc_id").eqNullSafe(F.col("of")), "left_semi").select("text")
        # a doc_id with several texts brings them all along; each of its blobs is entered once, and only if it was unseen
        new = written(texts.mapInArrow(scan, LEDGER).join(unseen, "blob", "left_semi").dropDuplicates(["blob"]))
    known = new if ledger is None else new.unionByName(ledger.filter(F.col("version") == VERSION))
    found = written(known.filter("spans <> ''").drop("version"))
    rows = blobs.join(found, "blob", "left").select(
        "doc_id",
        *(F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("n_assign", "n_access", "n_hex")),
        *(F.coalesce(c, F.lit("")).alias(c) for c in ("base", "spans")),
    )
    return rows, new
