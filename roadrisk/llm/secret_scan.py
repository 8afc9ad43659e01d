"""Secret scan with an incremental blob ledger (DataFrame functions only).

Every version of every path is content-addressed by the SHA-256 of its text.
The ledger is a Parquet table of (blob_id, rule_version, findings). A scan
takes the blobs whose (blob, rule version) pair the ledger doesn't hold yet,
reads the text of one version of each, appends its findings, and joins the
ledger back to all paths: a copy, a move or a revert is never scanned again.

Spans come from native regular expressions: `regexp_extract_all` gives the
matches and `split` what lies between them, so running sums of their lengths
are the positions, in code points.

Edge cases: null text is the empty text; a text without secrets has empty
findings; repeated versions share one blob; a null path is a path; texts of
any length are searched whole; an empty table or ledger gives an empty
result; other columns don't matter.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpoint, shared_path, text_or_empty

# Fixed values: (kind, Java pattern, group tested, least length of that group).
RULES = [
    ("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    ("access", r"AKIA[A-Z0-9]+", 0, 20),
    # a shorter run never counts, and a run can't be entered later: same matches as [0-9a-f]+ of 24 or more
    ("hex", r"[0-9a-f]{24,}+", 0, 24),
]
# Token forms beyond the base rules; kinds are reported after the base kinds.
MORE_RULES = [
    ("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 1),
    ("github", r"gh[pousr]_[A-Za-z0-9]{36,}+", 0, 40),
    ("jwt", r"eyJ[A-Za-z0-9_-]{10,}+\.eyJ[A-Za-z0-9_-]{10,}+\.[A-Za-z0-9_-]{10,}+", 0, 30),
]


def rule_version(rules) -> str:
    return hashlib.sha256(repr(rules).encode()).hexdigest()[:16]


def _spans(text: Column, pattern: str, group: int, least: int, order: int, kind: str) -> Column:
    """Array of structs (start, order, kind, end) of the matches that count."""
    p = F.lit(pattern)
    whole = F.regexp_extract_all(text, p, F.lit(0))
    tested = whole if group == 0 else F.regexp_extract_all(text, p, F.lit(group))
    cells = F.arrays_zip(
        F.transform(F.slice(F.split(text, pattern, -1), F.lit(1), F.size(whole)), F.char_length).alias("gap"),
        F.transform(whole, F.char_length).alias("len"), F.transform(tested, F.char_length).alias("tested"))
    empty = F.array().cast("array<struct<start:int,ord:int,kind:string,end:int>>")

    def step(acc, c):
        start = acc["at"] + c["gap"]
        end = start + c["len"]
        one = F.struct(start.alias("start"), F.lit(order).alias("ord"), F.lit(kind).alias("kind"), end.alias("end"))
        return F.struct(end.alias("at"), F.when(c["tested"] >= least, F.concat(acc["out"], F.array(one)))
                        .otherwise(acc["out"]).alias("out"))

    found = F.aggregate(cells, F.struct(F.lit(0).alias("at"), empty.alias("out")), step, lambda acc: acc["out"])
    return F.when(F.regexp_like(text, p), found).otherwise(empty)


def scan_blobs(blobs: DataFrame, rules=tuple(RULES + MORE_RULES)) -> DataFrame:
    """(blob_id, findings array<struct<start, ord, kind, end>>) of (blob_id, text) rows."""
    found = F.concat(*[_spans(F.col("text"), p, g, n, i, k) for i, (k, p, g, n) in enumerate(rules)])
    return blobs.select("blob_id", F.array_sort(found).alias("findings"))


def update_ledger(versions: DataFrame, ledger_path: str, rules=tuple(RULES + MORE_RULES)) -> tuple[DataFrame, DataFrame]:
    """Scan what the ledger lacks, append it, and return (the versions' (path,
    blob_id), the ledger's findings under these rules).

    ``versions``: (path, text) rows, all versions of all paths. A scan that is
    cut short leaves the ledger as it was; the append is one Parquet commit."""
    spark = versions.sparkSession
    version = rule_version(rules)
    schema = "blob_id string, rule_version string, findings array<struct<start:int,ord:int,kind:string,end:int>>"
    seen = checkpoint(versions.select("path", F.sha2(text_or_empty(), 256).alias("blob_id")))
    # one version of each blob stands for it: that of its smallest path, a null one if it has no other
    new = seen.groupBy("blob_id").agg(F.min("path").alias("path"))
    try:
        new = new.join(spark.read.schema(schema).parquet(ledger_path).filter(F.col("rule_version") == version), "blob_id", "left_anti")
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
    texts = versions.select("path", text_or_empty().alias("text")).withColumn("blob_id", F.sha2("text", 256))
    # the path alone picks the row (paths with several versions also need the blob)
    new = new.select(F.col("blob_id").alias("__blob"), F.col("path").alias("__path"))
    texts = texts.join(new, (F.col("blob_id") == F.col("__blob")) & F.col("path").eqNullSafe(F.col("__path")), "left_semi")
    scan_blobs(texts, rules).withColumn("rule_version", F.lit(version)).select("blob_id", "rule_version", "findings") \
        .write.mode("append").parquet(ledger_path)
    ledger = spark.read.schema(schema).parquet(ledger_path).filter(F.col("rule_version") == version)
    return seen, ledger.dropDuplicates(["blob_id"]).select("blob_id", "findings")


def secret_findings(versions: DataFrame, ledger_path: str, rules=tuple(RULES + MORE_RULES)) -> DataFrame:
    """(path, blob_id, findings) for every version of every path."""
    seen, ledger = update_ledger(versions, ledger_path, rules)
    # blobs without findings have no row on the right; a blob with very many paths is split by AQE
    hit = checkpoint(ledger.filter(F.size("findings") > 0))
    return seen.join(hit, "blob_id", "left")


def secret_scan(docs: DataFrame, ledger_path: str | None = None) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans) with documents as paths."""
    versions = docs.select(F.col("doc_id").cast("long").alias("path"), "text")
    f = secret_findings(versions, ledger_path or shared_path(docs.sparkSession, "blob-ledger"))
    every = F.coalesce("findings", F.array().cast("array<struct<start:int,ord:int,kind:string,end:int>>"))
    base = F.filter(every, lambda x: x["ord"] < len(RULES))
    joined = lambda a: F.array_join(F.transform(a, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")
    count = lambda kind: F.size(F.filter(every, lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return f.select(
        F.col("path").alias("doc_id"), *[count(k) for k, *_ in RULES],
        F.sha2(joined(base), 256).alias("base_sha256"), joined(every).alias("spans"))
