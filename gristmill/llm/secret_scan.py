"""Secret scans with an incremental ledger of blobs.

A blob is one text under its SHA-256. The ledger has one row per blob and rule version with what was
found. A scan addresses every version of every path, takes the blobs that the ledger lacks under
the current rule version, scans each once, and joins findings back to all paths that hold them.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator, Sequence
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gristmill.functions.expressions import col, require_columns

from .common import join_without_hot_keys, small_batches, written


class SecretRule(NamedTuple):
    """A pattern; matches whose group is shorter than `least` characters are dropped."""

    kind: str
    pattern: str
    group: int
    least: int
    ignore_case: bool = False


# The base kinds, in the order in which they are listed.
BASE_RULES = (
    SecretRule(
        "assign",
        r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        2,
        8,
        ignore_case=True,
    ),
    SecretRule("access", r"AKIA[A-Z0-9]+", 0, 16),
    SecretRule("hex", r"[0-9a-f]{32,}", 0, 32),
)

# What stands between the lines of a key: white space, written escapes, marks of quotes, comments and patches.
_GAP = r"""(?:[\s"'>#*|,;]|-(?!-)|\\{1,4}[nrt])*+"""
_BASE64 = r"(?:[A-Za-z0-9+/=]|\\/)"
# From BEGIN to the END after it; without one, header lines and the run of base64, whose last line may be short.
# No part reads over the next five dashes by more than a bounded number of characters, so all scans are linear.
_PRIVATE_KEY = (
    r"-----BEGIN [A-Z0-9 ]*PRIVATE KEY(?: BLOCK)?-----"
    r"(?:[^-]*+(?:-(?!----)[^-]*+)*+-----+END [A-Z0-9 ]*PRIVATE KEY(?: BLOCK)?-----"
    rf"|(?:{_GAP}[A-Za-z][A-Za-z-]{{2,20}}:(?:[^\n\r\\]{{0,200}}+(?=[\n\r\\])|\x20?[^\s\\]{{1,80}}+)){{0,8}}(?:{_GAP}{_BASE64}{{16,}}+)++"
    rf"""(?:{_GAP}={_BASE64}{{4}}|{_GAP}{_BASE64}{{1,15}}+(?:(?<==)|(?=[\t\x20"',]{{0,8}}(?:[\n\r]|\\{{1,4}}[nr]|\Z))))?)?"""
)

# Further kinds, by the public forms of their tokens.
MORE_RULES = (
    SecretRule("private_key", _PRIVATE_KEY, 0, 1),
    SecretRule("web_token", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 0, 30),
    SecretRule("hosting_token", r"gh[pousr]_[A-Za-z0-9]+", 0, 40),
    SecretRule("chat_token", r"xox[abprs]-[A-Za-z0-9-]+", 0, 20),
    SecretRule("url_login", r"[a-z][a-z0-9+.-]{1,20}://[^\s:/@]++:[^\s:/@]++@", 0, 10),
)
ALL_RULES = BASE_RULES + MORE_RULES

LEDGER_SCHEMA = (
    "blob string, rule_version string, n_assign long, n_access long, n_hex long, base_sha256 string, spans string"
)


def rule_version(rules: Sequence[SecretRule] = ALL_RULES) -> str:
    """A name for the rules that changes with any of them."""
    return hashlib.sha256(repr(tuple(tuple(r) for r in rules)).encode()).hexdigest()[:16]


def spans(text: str, rules: Sequence[SecretRule] = ALL_RULES) -> list[tuple[int, str, int]]:
    """(start, kind, end) in code points, by start and then in the order of the rules."""
    found = []
    for order, rule in enumerate(rules):
        for match in _compiled(rule).finditer(text):
            a, b = match.span(rule.group)
            if b - a >= rule.least:
                found.append((match.start(), order, rule.kind, match.end()))
    return [(start, kind, end) for start, _, kind, end in sorted(found)]


def blob_of(text: str) -> Column:
    """SHA-256 of the UTF-8 text, missing as empty."""
    return F.sha2(F.coalesce(col(text).cast("string"), F.lit("")).cast("binary"), 256)


def address(versions: DataFrame, path: str = "doc_id", text: str = "text") -> DataFrame:
    """Path and blob (SHA-256 of the UTF-8 text, missing as empty) of every version."""
    require_columns(versions, path, text)
    return versions.select(col(path).alias("path"), blob_of(text).alias("blob"))


def scan_unseen(
    versions: DataFrame,
    ledger: DataFrame,
    rules: Sequence[SecretRule] = ALL_RULES,
    path: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """New ledger rows: one per blob of `versions` that the ledger lacks under these rules."""
    version = rule_version(rules)
    known = ledger.where(F.col("rule_version") == version).select("blob")
    # The row with the least path stands for its blob, so copies never meet in one task.
    unseen = address(versions, path, text).groupBy("blob").agg(F.min("path").alias("path")).join(known, "blob", "left_anti")
    content = F.coalesce(col(text).cast("string"), F.lit(""))
    texts = versions.select(col(path).alias("own_path"), content.alias("text"), blob_of(text).alias("own_blob"))
    to_scan = texts.join(
        unseen, (F.col("own_path").eqNullSafe(F.col("path"))) & (F.col("own_blob") == F.col("blob"))
    ).select("blob", "text")
    # The same row given twice is scanned twice but entered once.
    return to_scan.mapInArrow(_scanner(tuple(rules), version), LEDGER_SCHEMA).dropDuplicates(["blob", "rule_version"])


def scan(
    versions: DataFrame,
    ledger: DataFrame | None = None,
    rules: Sequence[SecretRule] = ALL_RULES,
    path: str = "doc_id",
    text: str = "text",
) -> tuple[DataFrame, DataFrame]:
    """Findings per version, and the new ledger rows, to be appended to the ledger by the caller.

    The first table has one row per input row: the path under its own name, n_assign, n_access, n_hex,
    base_sha256 and spans (see `spans`; joined as kind:start:end with commas). A missing text counts as
    empty. Repeated rows come back as often as they are given; other columns are left out.
    """
    session = versions.sparkSession
    ledger = ledger if ledger is not None else session.createDataFrame([], LEDGER_SCHEMA)
    fresh = written(scan_unseen(versions, ledger, rules, path, text), "secret-ledger")
    entries = ledger.where(F.col("rule_version") == rule_version(rules)).unionByName(fresh).drop("rule_version")
    # Most blobs hold nothing. Only those with findings are joined back; the rest get the empty entry.
    found = entries.where(F.col("spans") != "")
    joined = join_without_hot_keys(address(versions, path, text), found, "blob")
    empty = hashlib.sha256(b"").hexdigest()
    return (
        joined.select(
            F.col("path").alias(path),
            *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n_assign", "n_access", "n_hex")],
            F.coalesce("base_sha256", F.lit(empty)).alias("base_sha256"),
            F.coalesce("spans", F.lit("")).alias("spans"),
        ),
        fresh,
    )


def _compiled(rule: SecretRule) -> re.Pattern:
    return re.compile(rule.pattern, re.ASCII | (re.IGNORECASE if rule.ignore_case else 0))


def _scanner(rules: tuple[SecretRule, ...], version: str):
    base = [r.kind for r in BASE_RULES]

    def scan_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            rows = []
            for blob, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                found = spans(text, rules)
                joined = [f"{kind}:{a}:{b}" for a, kind, b in found]
                based = ",".join(s for s, (_, kind, _) in zip(joined, found) if kind in base)
                counts = [sum(kind == k for _, kind, _ in found) for k in base]
                rows.append((blob, version, *counts, hashlib.sha256(based.encode()).hexdigest(), ",".join(joined)))
            if rows:
                names = ["blob", "rule_version", "n_assign", "n_access", "n_hex", "base_sha256", "spans"]
                yield pa.record_batch([pa.array(c) for c in zip(*rows)], names=names)

    return scan_batches


def masked(text: str, found: str, mask: str = "[SECRET]") -> str:
    """The text with every span of a joined list replaced; spans that overlap are replaced as one."""
    out, at = [], 0
    for a, b in sorted(tuple(map(int, s.split(":")[1:])) for s in found.split(",") if s):
        if a >= at:
            out += [text[at:a], mask]
        at = max(at, b)
    return "".join([*out, text[at:]])
