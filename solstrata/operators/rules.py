"""The rule catalogue, and queries over it."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SEVERITIES = ("info", "low", "medium", "high", "critical")
CONFIDENCES = ("low", "medium", "high")

# Rule, name, severity, confidence, detector, enabled.
RULES: tuple[tuple[str, str, str, str, str, bool], ...] = (
    ("REENTRANCY-001", "state written after an external call", "critical", "high", "reentrancy", True),
    ("REENTRANCY-002", "cross-function reentrancy", "high", "medium", "reentrancy", True),
    ("REENTRANCY-003", "read-only reentrancy", "medium", "medium", "reentrancy", True),
    ("REENTRANCY-004", "cross-contract reentrancy", "high", "medium", "reentrancy", True),
    ("AUTH-001", "tx.origin used to authorise", "high", "high", "tx-origin", True),
    ("AUTH-002", "tx.origin used to tell accounts from contracts", "info", "medium", "tx-origin", True),
    ("ACCESS-001", "missing access control", "critical", "high", "access-control", True),
    ("ACCESS-002", "weak access control", "high", "medium", "access-control", True),
    ("ACCESS-003", "unprotected write of privileged state", "high", "medium", "access-control", True),
    ("ACCESS-004", "centralization", "medium", "medium", "access-control", True),
    ("INIT-001", "initializer can run again", "high", "high", "reinitializable-init", True),
    ("INIT-002", "constructor in upgradeable contract", "high", "high", "constructor-in-upgradeable", True),
    ("INIT-003", "missing storage gap", "low", "low", "storage-gap-missing", True),
    ("INIT-004", "uninitialized ownable", "high", "high", "uninitialized-ownable", True),
    ("INIT-005", "override drops a restriction", "high", "high", "override-removes-restriction", False),
    ("DEFI-001", "unguarded flash-loan provider", "critical", "high", "flash-loan", True),
    ("DEFI-002", "unverified flash-loan callback", "high", "high", "flash-loan", True),
    ("DEFI-003", "signature replay", "high", "high", "signature-replay", True),
    ("DEFI-004", "vault share inflation", "critical", "high", "erc4626-inflation", True),
    ("DEFI-005", "oracle manipulation", "critical", "high", "oracle-manipulation", True),
    ("DEFI-006", "dangerous approval", "critical", "high", "dangerous-approve", True),
    ("ARITHMETIC-001", "overflow before 0.8", "high", "medium", "integer-overflow", True),
    ("ARITHMETIC-002", "arithmetic in an unchecked block", "medium", "medium", "integer-overflow", True),
    ("ARITHMETIC-003", "unsafe downcast", "medium", "medium", "integer-overflow", True),
    ("CALL-001", "unchecked low-level call", "high", "high", "unchecked-call", True),
    ("CALL-002", "unchecked send", "medium", "high", "unchecked-call", True),
    ("CALL-003", "unprotected delegatecall", "critical", "high", "delegatecall", True),
    ("CALL-004", "delegatecall to a caller's choice", "critical", "high", "delegatecall", True),
    ("CALL-005", "delegatecall in a proxy fallback", "medium", "medium", "delegatecall", True),
    ("UPGRADE-001", "unprotected upgrade", "critical", "high", "upgradeability", True),
    ("UPGRADE-002", "proxy bypass", "high", "high", "upgradeability", True),
    ("UPGRADE-003", "storage collision", "high", "high", "upgradeability", True),
    ("ONCHAIN-001", "unverified contract", "high", "high", "unverified-contract", True),
    ("ONCHAIN-002", "bytecode mismatch", "critical", "high", "bytecode-mismatch", True),
    ("ONCHAIN-003", "SELFDESTRUCT in bytecode", "critical", "high", "onchain-bytecode-pattern", True),
    ("ONCHAIN-004", "DELEGATECALL in bytecode", "high", "high", "onchain-bytecode-pattern", True),
    ("ONCHAIN-005", "ORIGIN in bytecode", "high", "high", "onchain-bytecode-pattern", True),
    ("ONCHAIN-006", "known exploited contract", "critical", "high", "known-exploited-contract", True),
    ("INTERCONTRACT-001", "cycle between contracts", "critical", "high", "intercontract", True),
    ("INTERCONTRACT-002", "unprotected call between contracts", "high", "medium", "intercontract", True),
    ("INTERCONTRACT-003", "price from another contract", "high", "medium", "intercontract", True),
    ("INTERCONTRACT-004", "taint between contracts", "medium", "medium", "intercontract", True),
    ("SHADOW-001", "state variable shadowed by a local", "low", "high", "shadowing", True),
    ("SHADOW-002", "state variable shadowed by a parameter", "high", "high", "shadowing", True),
)
_SCHEMA = "rule_id string, name string, severity string, confidence string, detector string, enabled boolean"
# Fixed values.
_CVSS = {"info": 0.0, "low": 3.0, "medium": 5.5, "high": 7.5, "critical": 9.5}
_SARIF_LEVEL = {"info": "note", "low": "note", "medium": "warning", "high": "error", "critical": "error"}


def level_map(names: Iterable[str]):
    return F.create_map(*[x for i, n in enumerate(names) for x in (F.lit(n), F.lit(i))])


def severity_rank(column):
    return level_map(SEVERITIES)[F.lower(column)]


def catalogue(spark: SparkSession) -> DataFrame:
    """All rules with category, rank, score and report level."""
    df = spark.createDataFrame([r for r in RULES], _SCHEMA)
    score = F.create_map(*[x for k, v in _CVSS.items() for x in (F.lit(k), F.lit(v))])
    level = F.create_map(*[x for k, v in _SARIF_LEVEL.items() for x in (F.lit(k), F.lit(v))])
    return df.select("*", F.split_part("rule_id", F.lit("-"), F.lit(1)).alias("category"), severity_rank(F.col("severity")).alias("severity_rank"), score[F.col("severity")].alias("score"), level[F.col("severity")].alias("report_level"))


def search(rules: DataFrame, category: str | None = None, severities: Iterable[str] = (), text: str | None = None, enabled: bool | None = None) -> DataFrame:
    """Rules by category, severities, text in id or name, and whether they are enabled; sorted by id."""
    out = rules
    if category:
        out = out.where(F.upper("category") == category.upper())
    if wanted := [s.lower() for s in severities]:
        out = out.where(F.col("severity").isin(wanted))
    if text:
        out = out.where(F.contains(F.lower(F.concat_ws(" ", "rule_id", "name")), F.lit(text.lower())))
    if enabled is not None:
        out = out.where(F.col("enabled") == enabled)
    return out.orderBy("rule_id")
