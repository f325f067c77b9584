"""Deployed bytecode as hexadecimal text: comparison, metadata, opcodes, selectors, patterns, proxies, known addresses.

Comparison and patterns are column expressions; walking opcodes needs the length of pushed data, a fold, and is done in Arrow
batches. Null code counts as no code.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# What metadata begins with, and the prefix of minimal proxies.
METADATA_MARKS = ("a2646970667358221220", "a165627a7a72305820", "a265627a7a72305820")
MINIMAL_PROXY = "363d3d373d3d3d363d73"
# Opcodes worth a finding: byte, name, rule, severity.
NOTED_OPCODES = (("ff", "SELFDESTRUCT", "ONCHAIN-003", "critical"), ("f4", "DELEGATECALL", "ONCHAIN-004", "high"), ("32", "ORIGIN", "ONCHAIN-005", "high"))
# Known addresses, day, loss in USD, kind.
KNOWN_EXPLOITS = (("0xbf05279f9bf1ce69bbfed670813b7e431142afa4", "2022-11-02", 2100000.0, "reentrancy"), ("0xa0b86991c6218b36c1d19d4a2e9eb0ce3606eb48", "2023-03-11", 0.0, "proxy"))
# Opcodes by number; PUSH, DUP, SWAP and LOG come from their rule.
_NAMED = {
    0x00: "STOP ADD MUL SUB DIV SDIV MOD SMOD ADDMOD MULMOD EXP SIGNEXTEND", 0x10: "LT GT SLT SGT EQ ISZERO AND OR XOR NOT BYTE SHL SHR SAR", 0x20: "KECCAK256",
    0x30: "ADDRESS BALANCE ORIGIN CALLER CALLVALUE CALLDATALOAD CALLDATASIZE CALLDATACOPY CODESIZE CODECOPY GASPRICE EXTCODESIZE EXTCODECOPY RETURNDATASIZE RETURNDATACOPY EXTCODEHASH",
    0x40: "BLOCKHASH COINBASE TIMESTAMP NUMBER PREVRANDAO GASLIMIT CHAINID SELFBALANCE BASEFEE", 0x50: "POP MLOAD MSTORE MSTORE8 SLOAD SSTORE JUMP JUMPI PC MSIZE GAS JUMPDEST", 0x5F: "PUSH0",
    0xF0: "CREATE CALL CALLCODE RETURN DELEGATECALL CREATE2", 0xFA: "STATICCALL", 0xFD: "REVERT INVALID SELFDESTRUCT",
}


def opcode_names() -> dict[int, str]:
    out = {start + i: name for start, names in _NAMED.items() for i, name in enumerate(names.split())}
    out |= {0x60 + i: f"PUSH{i + 1}" for i in range(32)} | {0x80 + i: f"DUP{i + 1}" for i in range(16)}
    return out | {0x90 + i: f"SWAP{i + 1}" for i in range(16)} | {0xA0 + i: f"LOG{i}" for i in range(5)}


def normal(code: Column) -> Column:
    return F.regexp_replace(F.lower(F.trim(code)), "^0x", "")


def strip_metadata(code: Column) -> Column:
    """Code up to the last place where metadata begins."""
    return F.regexp_replace(code, f"(?:{'|'.join(METADATA_MARKS)})(?!.*(?:{'|'.join(METADATA_MARKS)})).*$", "")


def metadata_hash(code: Column) -> Column:
    """The 64 hex digits after the mark; null if there is none."""
    return F.nullif(F.regexp_extract(code, f"(?:{'|'.join(METADATA_MARKS)})([0-9a-f]{{64}})", 1), F.lit(""))


def compare(pairs: DataFrame, deployed: str = "deployed", local: str = "local") -> DataFrame:
    """pairs with match (exact, partial, mismatch, no_source, unverified) and the sha256 of both normal forms."""
    a, b = normal(F.col(deployed)), normal(F.col(local))
    kind = F.when(F.coalesce(a, F.lit("")) == "", "unverified").when(F.coalesce(b, F.lit("")) == "", "no_source").when(a == b, "exact").when(strip_metadata(a) == strip_metadata(b), "partial").otherwise("mismatch")
    return pairs.withColumn("match", kind).withColumn("deployed_hash", F.sha2(a, 256)).withColumn("local_hash", F.sha2(b, 256))


def differences(pairs: DataFrame, key: str, deployed: str = "deployed", local: str = "local") -> DataFrame:
    """(key, offset, deployed, local): runs of differing bytes; what one side has beyond the other is the last run.

    Gaps and islands within one array per row, so no pair of codes is shuffled byte by byte.
    """
    a, b = normal(F.col(deployed)), normal(F.col(local))
    rows = pairs.select(key, F.coalesce(a, F.lit("")).alias("a"), F.coalesce(b, F.lit("")).alias("b"))
    size = "greatest(length(a), length(b)) div 2"
    differ = f"filter(if({size} > 0, sequence(0, cast({size} as int) - 1), cast(array() as array<int>)), i -> substr(a, i * 2 + 1, 2) <> substr(b, i * 2 + 1, 2))"
    runs = """aggregate(d, cast(array() as array<struct<s:int,e:int>>), (acc, i) -> if(size(acc) > 0 and element_at(acc, -1).e = i - 1,
      concat(slice(acc, 1, size(acc) - 1), array(named_struct('s', element_at(acc, -1).s, 'e', i))), concat(acc, array(named_struct('s', i, 'e', i)))))"""
    out = rows.withColumn("d", F.expr(differ)).withColumn("run", F.explode(F.expr(runs)))
    cut = lambda side: F.expr(f"substr({side}, run.s * 2 + 1, (run.e - run.s + 1) * 2)")
    return out.select(key, F.col("run.s").alias("offset"), cut("a").alias("deployed"), cut("b").alias("local"))


def disassemble(codes: DataFrame, key: str, code: str = "code") -> DataFrame:
    """(key, pc, opcode, name, push_data): one row per instruction; pushed bytes are no instructions, unknown bytes are UNKNOWN_xx."""
    names = opcode_names()
    kind = codes.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, pcs, ops, labels, data = [], [], [], [], []
            for ident, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                text = (text or "").strip().lower().removeprefix("0x")
                body = bytes.fromhex(text[: len(text) // 2 * 2]) if all(c in "0123456789abcdef" for c in text) else b""
                pc = 0
                while pc < len(body):
                    op = body[pc]
                    n = op - 0x5F if 0x60 <= op <= 0x7F else 0
                    ids.append(ident)
                    pcs.append(pc)
                    ops.append(op)
                    labels.append(names.get(op, f"UNKNOWN_{op:02x}"))
                    data.append(body[pc + 1 : pc + 1 + n].hex() if n else None)
                    pc += 1 + n
            yield pa.RecordBatch.from_arrays([pa.array(ids, batch.schema.field(0).type), pa.array(pcs, pa.int32()), pa.array(ops, pa.int32()), pa.array(labels, pa.string()), pa.array(data, pa.string())], [key, "pc", "opcode", "name", "push_data"])

    return codes.select(key, code).mapInArrow(run, f"`{key}` {kind}, pc int, opcode int, name string, push_data string")


def noted_opcodes(instructions: DataFrame, key: str) -> DataFrame:
    """(key, name, rule_id, severity, pc): the first place of each noted opcode, by instruction."""
    spark: SparkSession = instructions.sparkSession
    noted = spark.createDataFrame([(n, r, s) for _, n, r, s in NOTED_OPCODES], "name string, rule_id string, severity string")
    return instructions.join(F.broadcast(noted), "name").groupBy(key, "name", "rule_id", "severity").agg(F.min("pc").alias("pc"))


def byte_patterns(codes: DataFrame, key: str, code: str = "code") -> DataFrame:
    """(key, name, pc): the same by plain text search, blind to push data and alignment; the first occurrence."""
    rows = codes.select(key, normal(F.col(code)).alias("code"))
    found = F.array(*[F.struct(F.lit(n).alias("name"), F.instr("code", h).alias("at")) for h, n, _, _ in NOTED_OPCODES])
    return rows.select(key, F.explode(found).alias("x")).where("x.at > 0").select(key, "x.name", F.floor((F.col("x.at") - 1) / 2).cast("int").alias("pc"))


def function_selectors(instructions: DataFrame, key: str) -> DataFrame:
    """(key, selector): four pushed bytes that are compared next."""
    from pyspark.sql import Window

    w = Window.partitionBy(key).orderBy("pc")
    out = instructions.withColumn("next", F.lead("name").over(w)).where("name = 'PUSH4' and next in ('DUP1', 'EQ', 'GT', 'LT')")
    return out.select(key, F.col("push_data").alias("selector")).distinct()


def proxies(contracts: DataFrame, source: str = "source", code: str = "code") -> DataFrame:
    """contracts with proxy_kind and, for minimal proxies, the implementation's address."""
    c, s = normal(F.col(code)), F.coalesce(F.col(source), F.lit(""))
    target = F.nullif(F.regexp_extract(c, MINIMAL_PROXY + "([0-9a-f]{40})", 1), F.lit(""))
    kind = (F.when(s.rlike(r"\bUUPSUpgradeable\b|proxiableUUID"), "uups").when(s.rlike(r"TransparentUpgradeableProxy|ifAdmin"), "transparent").when(s.rlike(r"\bBeaconProxy\b|UpgradeableBeacon"), "beacon")
            .when(s.rlike(r"facetAddress|IDiamondCut|LibDiamond"), "diamond").when(target.isNotNull(), "minimal").when(F.contains(s, F.lit("delegatecall")), "custom"))
    return contracts.withColumn("proxy_kind", kind).withColumn("implementation", F.concat(F.lit("0x"), target))


def known_exploits(contracts: DataFrame, address: str = "address") -> DataFrame:
    """(address, day, loss_usd, kind) of contracts in the table of known addresses."""
    spark = contracts.sparkSession
    known = spark.createDataFrame(list(KNOWN_EXPLOITS), "known string, day string, loss_usd double, exploit_kind string")
    out = contracts.join(F.broadcast(known), F.lower(contracts[address]) == known["known"])
    return out.select(F.lower(address).alias("address"), F.to_date("day").alias("day"), "loss_usd", "exploit_kind").distinct()
