"""Detectors: queries from the tables of a corpus to findings.

Each is a projection of blocks or lines by named predicates; all have the columns of FINDING. Patterns are read on code
whose comments and strings are blanked, so words in prose trigger nothing.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from solstrata.operators.structure import Corpus, rx, versions

FINDING = ("path", "line", "rule_id", "detector", "severity", "confidence", "title", "snippet", "contract", "function")

# Word lists and patterns the results depend on.
TX_ORIGIN_AUTH = (r"require\s*\(\s*tx\.origin\s*==", r"require\s*\([^)]*==\s*tx\.origin", r"if\s*\(\s*tx\.origin\s*==", r"tx\.origin\s*!=", r"tx\.origin\s*==\s*\w+")
TX_ORIGIN_SAFE = (r"tx\.origin\s*==\s*msg\.sender", r"msg\.sender\s*==\s*tx\.origin", r"tx\.origin\s*!=\s*msg\.sender")
ACCESS_GUARDS = (
    r"\bonly[A-Z]\w*\b", r"\brequiresAuth\b", r"\bauth\b", r"\brestricted\b", r"\bifAdmin\b", r"\badminOnly\b", r"require\s*\(\s*msg\.sender\s*==\s*\w+", r"require\s*\(\s*\w+\s*==\s*msg\.sender",
    r"require\s*\(\s*hasRole\s*\(", r"require\s*\(\s*isOwner\s*\(", r"_checkOwner\s*\(", r"_checkRole\s*\(", r"if\s*\(\s*msg\.sender\s*!=\s*\w+", r"require\s*\(.*msg\.sender.*&&.*msg\.sender\s*==",
)
CRITICAL_FUNCTIONS = (
    r"^mint$", r"^burn$", r"^(set|update|change)(Owner|Admin|Minter|Pauser)$", r"^transferOwnership$", r"^(add|remove)(Admin|Minter|Role)$", r"^upgrade(To|Implementation)\w*$", r"^setImplementation$",
    r"^(withdrawAll|sweep|rescue|recover)(ETH|Ether|Token|Funds|Assets)?$", r"^emergencyWithdraw$", r"^(pause|unpause)$", r"^set(Fee|Rate|Price|Limit|Cap)$",
)
WEAK_CHECKS = (r"require\s*\(\s*msg\.sender\s*!=\s*address\s*\(\s*0\s*\)", r"require\s*\(\s*true\s*\)")
PRIVILEGED_WRITES = (r"(?m)^\s*_?(owner|admin|implementation|minter|pauser)\s*=[^=]",)
INIT_GUARDS = (
    r"\b(re)?initializer\b", r"\bonlyInitializing\b", r"\bonly(Owner|Admin|Role)\b", r"\bwhenNotInitialized\b", r"require\s*\(\s*!\s*_?(is)?[iI]nitialized\b", r"require\s*\(\s*_?initialized\s*==\s*false\b",
    r"if\s*\(\s*_?initialized\b.*\)\s*(?:revert|return|\{)", r"_disableInitializers\s*\(", r"_?implementation(\(\))?\s*==\s*address\s*\(\s*0\s*\)", r"require\s*\([^)]*==\s*(?:0|address\s*\(\s*0\s*\))",
)
REENTRANCY_GUARDS = (r"\b(nonReentrant|nonreentrant|noReentrant|lock|locked|mutex)\b",)
LOW_LEVEL_CALL = r"\.\s*(call|send|transfer)\s*[\({]"
STATE_WRITE = r"(?m)^\s*[A-Za-z_]\w*(?:\s*\[[^\]]+\])*(?:\.\w+)*\s*(?:[-+*/|&^]?=[^=]|\+\+|--)"
UPGRADEABLE = (r"\bInitializable\b", r"\w+Upgrad(e)?able\b", r"\b__gap\b", r"__\w+_init\s*\(", r"function\s+initialize\s*\(")
DISABLES_INIT = r"_?disableInitializers\s*\(\s*\)"
PROXY_SHELLS = r"^(TransparentUpgradeableProxy|ERC1967Proxy|BeaconProxy|UpgradeableBeacon|ProxyAdmin)$"
CONSTRUCTOR_CRITICAL = (
    r"\b_?(owner|admin|governance|controller|token|treasury|oracle|implementation|vault|pool|router|weth|factory)\s*=[^=]", r"_?transferOwnership\s*\(", r"__(Ownable|AccessControl)_init\s*\(",
    r"_?grantRole\s*\(", r"_setupRole\s*\(", r"\b_(safe)?[mM]int\s*\(",
)
FLASH_PROVIDER = r"(?i)flash(loan|mint|borrow|swap)?$|^flash"
FLASH_CALLBACK_LINE = (r"\breceiver\b.*\.(onFlashLoan|executeOperation)\s*\(", r"IFlash\w*\s*\(\s*\w+\s*\)\s*\.\s*on\w+\s*\(", r"\bborrower\b.*\.\s*(?:onFlashLoan|execute\w*)\s*\(", r"\b\w+\s*\.\s*(?:onFlashLoan|executeOperation|flashCallback)\s*\(")
FLASH_MINT_SIGNS = (r"IERC3156FlashBorrower\s*\(", r"\.onFlashLoan\s*\(", r"RETURN_VALUE", r"\bflashFee\s*\(", r"\bmaxFlashLoan\s*\(", r"_mint\s*\(", r"_burn\s*\(", r"_spendAllowance\s*\(")
FLASH_RECEIVER = r"^(onFlashLoan|executeOperation|flashCallback|uniswapV2Call|uniswapV3FlashCallback|pancakeCall|receiveFlashLoan)$"
CALLER_CHECKS = (r"require\s*\(\s*msg\.sender\s*==\s*\w", r"if\s*\(\s*msg\.sender\s*!=\s*\w+.*\)\s*\{?\s*(?:revert|return)", r"_(?:allowed|trusted|valid)\w*\[\s*msg\.sender\s*\]")
RECEIVER_ACTS = (r"\.(safe)?[tT]ransfer(From)?\s*\(", r"\.(safe)?[aA]pprove\s*\(", r"\.(mint|burn)\s*\(", r"\.call\s*[\({]", STATE_WRITE)
AUTHORISES = (
    r"require\s*\(.*(?:signer|recovered|account|owner|user|from).*==", r"if\s*\(.*(?:signer|recovered|account|owner|user|from).*!?=", r"\b(?:owner|admin|operator|authorized|approved)\s*=",
    r"\b(?:transfer|transferFrom|safeTransferFrom|approve|permit|mint|burn)\s*\(", r"\b(?:_transfer|_approve|_mint|_burn|_grantRole|grantRole)\s*\(",
)
HASH_HELPERS = (r"_hashTypedDataV4\s*\(", r"\bDOMAIN_SEPARATOR\b", r"_domainSeparatorV4\s*\(\s*\)", r"\bdomainSeparator\s*\(\s*\)")
NONCES = (r"\bnonces\s*\[", r"_useNonce\s*\(", r"\bnonce\b", r"_nonces\s*\[", r"\w*[Nn]once\w*\s*(?:\+\+|\+=|\[)")
CHAIN_IDS = (r"\bblock\.chain[iI]d\b", r"\bchainI[dD]\b", r"assembly.*chainid")
DEADLINES = (r"\bdeadline\b", r"\bexpiry\b", r"\bexpiration\b", r"block\.timestamp\s*[<>]=?\s*\w", r"require.*(?:deadline|expir)")
VAULT_BASES = r"(?i)ERC4626|IERC4626"
VAULT_PROTECTION = (r"_decimalsOffset\s*\(", r"\bvirtual(Shares|Assets)\b", r"\+\s*1\s*[,)]", r"\b(DEAD|BURN)_?(ADDRESS|SHARES)?\b", r"MINIMUM_(LIQUIDITY|SHARES|DEPOSIT)", r"\bminDeposit\b|\bminShares\b", r"0x000000000000000000000000000000000000dEaD")
SPOT_PRICE = (r"\.getReserves\s*\(", r"\.slot0\s*\(", r"\.getSpotPrice\s*\(", r"\.get_virtual_price\s*\(", r"\.balanceOf\s*\(\s*address\s*\(\s*(pair|pool)")
TWAP = (r"\.observe\s*\(", r"OracleLibrary\s*\.\s*consult\s*\(", r"price[01]CumulativeLast", r"\bTWAP\b|\btwap\b", r"[cC]umulativePrice", r"timeWeighted|time_weighted")
STALENESS = (r"\bupdatedAt\b.*[<>]|[<>].*\bupdatedAt\b", r"block\.timestamp\s*-\s*\w*[uU]pdated\w*", r"\bheartbeat\b|\bstale\w*|maxDelay|MAX_DELAY|STALENESS")
ANSWER_VALID = (r"require\s*\(\s*\w*(answer|price)\w*\s*>\s*0", r"if\s*\(\s*\w*(answer|price)\w*\s*<=\s*0", r"\w*(answer|price)\w*\s*(>|<=|<)\s*0")
SEQUENCER = (r"(?i)sequencer|uptime|grace\s*period|gracePeriod", r"(?i)isUpAndGracePeriodPassed", r"\banswer\s*(?:==|!=)\s*[01]\b")
UNLIMITED = (r"type\s*\(\s*uint256\s*\)\s*\.\s*max", r"2\s*\*\*\s*256\s*-\s*1", r"(?i)0xf{64}", r"\b(?:MAX_UINT(?:256)?|UINT256_MAX|MAX_INT256|MAX_ALLOWANCE|UNLIMITED)\b", r"uint(256)?\s*\(\s*-\s*1\s*\)")
NARROW_CAST = r"\b(u?int(?:8|16|32|64|128))\s*\(\s*([A-Za-z_]\w*)"
CAST_SAFE = (r"SafeCast\.to\w+\(", r"(?:u?int)\d+\s*\(\s*[A-Z]\w*(?:\s*\.\s*\w+)+\s*\)", r"uint8\s*\(\s*(?:bytes1|bytes2)\s*\(", r"\b(?:u?int)\d+\s*\(\s*Math\.(max|min)\s*\(", r"(?:u?int)\d+\s*\(\s*type\s*\(", r"uint\d+\s*\(\s*block\s*\.\s*(timestamp|number)")
COMPOUND = r"\b\w+(?:\s*\[[^\]]+\])*\s*[-+*]="
CONSTANT_STRIDE = r"\b\w+\s*\+=\s*(?:0x[0-9a-fA-F]+|\d+)\s*;?"


def _finding(df: DataFrame, line: Column | str, rule: str, detector: str, severity: Column | str, confidence: str, title: Column, snippet: Column) -> DataFrame:
    as_text = lambda x: F.lit(x) if isinstance(x, str) else x
    at = F.col(line) if isinstance(line, str) else line
    return df.select("path", at.cast("int").alias("line"), F.lit(rule).alias("rule_id"), F.lit(detector).alias("detector"), as_text(severity).alias("severity"), F.lit(confidence).alias("confidence"),
                     title.alias("title"), F.trim(F.regexp_replace(snippet, r"\s+", " ")).alias("snippet"), F.col("contract"), F.col("name").alias("function"))


def _code_lines(blocks: DataFrame, before: int = 8, after: int = 10) -> DataFrame:
    """A row per line of the code of each block, with its number `at`, the lines `before` and `after` it, joined by line ends.

    The windows are cut before the lines are spread, and no row carries the whole code.
    """
    parts = F.split("code", "\n", -1)
    wide = F.transform(F.sequence(F.lit(1), F.size("parts")), lambda i: F.struct(
        F.element_at("parts", i).alias("text"), F.array_join(F.slice("parts", F.greatest(i - before, F.lit(1)), F.least(i - 1, F.lit(before))), "\n").alias("before"),
        F.array_join(F.slice("parts", i + 1, F.lit(after)), "\n").alias("after")))
    rows = blocks.withColumn("parts", parts).withColumn("wide", F.explode(F.arrays_zip(wide.alias("x"), F.sequence(F.lit(0), F.size("parts") - 1).alias("k"))))
    kept = [c for c in blocks.columns if c not in ("code", "body")]
    return rows.select(*kept, F.col("wide.k").alias("k"), F.col("wide.x.text").alias("text"), F.col("wide.x.before").alias("before"), F.col("wide.x.after").alias("after"), (F.col("body_line") + F.col("wide.k")).alias("at"))


def _title(what: str) -> Column:
    return F.concat(F.lit(what + " in '"), F.concat_ws(".", F.nullif("contract", F.lit("")), "name"), F.lit("'"))


def _head(body_lines: int) -> Column:
    """Signature and the first lines of the code."""
    return F.concat_ws("\n", "signature", F.array_join(F.slice(F.split("code", "\n"), 1, body_lines + 1), "\n"))


def _whole() -> Column:
    return F.concat_ws("\n", "signature", "code")


def _is_open() -> Column:
    return F.col("visibility").isin("public", "external") & F.col("has_body") & (F.col("contract_kind") == "contract")


def _writes() -> Column:
    return ~F.col("mutability").isin("view", "pure", "constant")


def _first_line(pattern: str) -> Column:
    flags = F.transform(F.split("code", "\n", -1), lambda x: F.coalesce(x.rlike("(?d)" + pattern), F.lit(False)))
    return F.col("body_line") + F.greatest(F.array_position(flags, True) - 1, F.lit(0))


def _line_text(pattern: str) -> Column:
    return F.coalesce(F.element_at(F.filter(F.split("code", "\n", -1), lambda x: x.rlike("(?d)" + pattern)), 1), F.col("signature"))


def tx_origin(c: Corpus) -> DataFrame:
    """Lines that authorise by tx.origin, once per line; what follows // doesn't count."""
    cut = c.lines.withColumn("text", F.split_part("line", F.lit("//"), F.lit(1)))
    hit = cut.where(F.contains("text", F.lit("tx.origin")) & rx("text", *TX_ORIGIN_AUTH) & ~rx("text", *TX_ORIGIN_SAFE))
    hit = hit.withColumn("contract", F.lit("")).withColumn("name", F.lit(""))
    return _finding(hit, "line_no", "AUTH-001", "tx-origin", "high", "high", F.lit("tx.origin used to authorise"), F.col("text"))


def delegatecall(c: Corpus) -> DataFrame:
    guarded = rx(_whole(), *ACCESS_GUARDS) | (F.col("name").eqNullSafe("initialize") & rx(_whole(), *INIT_GUARDS))
    rows = _code_lines(c.callables.where(F.contains("code", F.lit("delegatecall"))).withColumn("guarded", guarded)).where(rx("text", r"\.\s*delegatecall\s*\("))
    target = F.regexp_extract("text", r"(\w+)\s*\.\s*delegatecall\s*\(", 1)
    proxy = (F.col("kind") == "fallback") & rx("text", r"delegatecall\s*\(\s*msg\.data")
    chosen = F.exists("params", lambda p: p["name"] == F.col("target")) & (F.col("target") != "")
    rows = rows.withColumn("target", target).withColumn("proxy", proxy).withColumn("chosen", chosen)
    opened = ~F.col("guarded") & ~F.col("visibility").isin("internal", "private") & ~F.col("proxy")
    return (
        _finding(rows.where("proxy"), "at", "CALL-005", "delegatecall", "high", "medium", _title("Delegatecall in a fallback"), F.col("text"))
        .unionByName(_finding(rows.where(opened), "at", "CALL-003", "delegatecall", "critical", "high", _title("Unprotected delegatecall"), F.col("text")))
        .unionByName(_finding(rows.where("chosen and not guarded and not proxy"), "at", "CALL-004", "delegatecall", "critical", "high", _title("Delegatecall target chosen by the caller"), F.col("text")))
    )


def unprotected_upgrade(c: Corpus) -> DataFrame:
    """Assignments to an implementation in open functions of files that delegate calls."""
    uses = c.files.where(F.contains("source", F.lit("delegatecall"))).select("path").distinct()
    write = r"\b_?(implementation|impl|logic|delegate)\s*=[^=]"
    rows = c.functions.where(_is_open() & _writes() & rx("code", write) & ~rx(_whole(), *ACCESS_GUARDS) & ~((F.col("name") == "initialize") & rx(_whole(), *INIT_GUARDS)))
    return _finding(rows.join(uses, "path", "left_semi"), _first_line(write), "UPGRADE-001", "delegatecall", "critical", "high", _title("Unprotected implementation upgrade"), _line_text(write))


def unchecked_call(c: Corpus) -> DataFrame:
    """Low-level calls whose result is dropped or not tested within ten lines."""
    call = r"\.\s*(?:call|send|delegatecall|staticcall)\s*[\({]"
    rows = _code_lines(c.callables.where(rx("code", call))).where(rx("text", call))
    inline = rx("text", r"\b(require|assert|if|while)\s*\(.*" + call, r"^\s*return\b", r"&&|\|\|")
    joined = F.concat_ws(" ", F.replace(F.substring_index("before", "\n", -3), F.lit("\n"), F.lit(" ")), "text")
    variable = F.regexp_extract(joined, r"\bbool\s+(\w+)\b[^;]*" + call + r"[^;]*;?\s*$", 1)
    variable = F.when(variable != "", variable).otherwise(F.regexp_extract("text", r"\(?\s*(\w+)\s*,?[^=]*\)?\s*=[^=].*" + call, 1))
    v = F.concat(F.lit(r"\b"), F.col("variable"), F.lit(r"\b"))
    tests = F.concat(F.lit(r"(?d)(require|assert|if|while)\s*\([^;]*"), v, F.lit(r"|!\s*"), v, F.lit("|"), v, F.lit(r"\s*[!=]=|return\b[^;]*"), v, F.lit(r"|(?i:verify|check|handle)\w*\([^;]*"), v, F.lit(r"|iszero\s*\(\s*"), v)
    rows = rows.withColumn("variable", variable).withColumn("tested", (F.col("variable") != "") & F.coalesce(F.rlike(F.concat_ws("\n", "text", "after"), tests), F.lit(False)))
    bad = rows.where(~inline & ~F.col("tested"))
    send = rx("text", r"\.\s*send\s*\(")
    one = _finding(bad.where(~send), "at", "CALL-001", "unchecked-call", "high", "high", _title("Result of a low-level call not checked"), F.col("text"))
    return one.unionByName(_finding(bad.where(send), "at", "CALL-002", "unchecked-call", "medium", "high", _title("Result of send not checked"), F.col("text")))


def access_control(c: Corpus) -> DataFrame:
    rows = c.functions.where(_is_open() & _writes() & ~F.col("name").startswith("_") & ~rx(F.lower("path"), r"(^|/)(mocks?|tests?)/"))
    guarded = rx(_whole(), *ACCESS_GUARDS) | (F.size("modifiers") > 0) & rx(F.array_join("modifiers", " "), r"\b(only\w*|auth|initializer|restricted|requiresAuth|protected)\b") | rx("code", *INIT_GUARDS)
    own = (F.col("name") == "burn") & rx("code", r"msg\.sender|_msgSender\(\)")
    self_mint = (F.col("name") == "mint") & (~rx("signature", r"\(\s*address\b") | (rx("code", r"maxMint\w*") & rx("code", r"previewMint\w*") & rx("code", r"_?deposit\w*")))
    rows = rows.withColumn("critical", rx("name", *CRITICAL_FUNCTIONS) & ~own & ~self_mint).withColumn("weak", rx("code", *WEAK_CHECKS)).where(~guarded)
    worst = rx("name", r"(?i)mint|burn|owner|upgrade|implementation|withdraw|sweep|rescue|recover")
    missing = _finding(rows.where("critical and not weak"), "start_line", "ACCESS-001", "access-control", F.when(worst, "critical").otherwise("high"), "high", _title("Missing access control"), F.col("signature"))
    weak = _finding(rows.where("critical and weak"), _first_line("|".join(WEAK_CHECKS)), "ACCESS-002", "access-control", "high", "medium", _title("Weak access control"), _line_text("|".join(WEAK_CHECKS)))
    writes = rows.where(~F.col("critical") & rx("code", *PRIVILEGED_WRITES))
    return missing.unionByName(weak).unionByName(_finding(writes, _first_line(PRIVILEGED_WRITES[0]), "ACCESS-003", "access-control", "high", "medium", _title("Unprotected write of privileged state"), _line_text(PRIVILEGED_WRITES[0])))


def integer_overflow(c: Corpus) -> DataFrame:
    old = versions(c.files).where("below_08").select("path")
    safe_math = c.files.where(F.contains("source", F.lit("SafeMath"))).select("path")
    body = c.callables.unionByName(c.blocks.where(F.col("kind").isin("constructor", "modifier")))
    early = _code_lines(body.join(old, "path", "left_semi").join(safe_math, "path", "left_anti")).where(rx("text", COMPOUND) & ~rx("text", CONSTANT_STRIDE, r"\bfor\s*\("))
    one = _finding(early, "at", "ARITHMETIC-001", "integer-overflow", "high", "medium", _title("Arithmetic without overflow check"), F.col("text"))
    inner = _code_lines(c.blocks.where("kind = 'unchecked'").join(old, "path", "left_anti"))
    bounded = rx("text", CONSTANT_STRIDE, r"\b(?:len|length|size|count)\s*=\s*\w+\s*-\s*\w+", r"return\s+\w+\s*[-+]\s*\w+\s*;", r"_balances\s*\[[^\]]+\]\s*(?:\+=|-=)\s*1\s*;?$")
    left, right = F.regexp_extract("text", r"\b(\w+)(?:\s*\[[^\]]+\])*\s*[-+]=\s*(\w+)", 1), F.regexp_extract("text", r"\b(\w+)(?:\s*\[[^\]]+\])*\s*[-+]=\s*(\w+)", 2)
    near = F.concat(F.lit(r"(?d)(>=|<=|<|>)[^;]*\b"), right, F.lit(r"\b|\b"), right, F.lit(r"\b[^;]*(>=|<=|<|>)"))
    checked = (left != "") & F.coalesce(F.rlike("before", near), F.lit(False))
    two = _finding(inner.where(rx("text", COMPOUND) & ~bounded & ~checked), "at", "ARITHMETIC-002", "integer-overflow", "medium", "medium", _title("Arithmetic in an unchecked block"), F.col("text"))
    cast = _code_lines(body.where(rx("code", NARROW_CAST))).where(rx("text", NARROW_CAST) & ~rx("text", *CAST_SAFE))
    variable = F.regexp_extract("text", "(?d)" + NARROW_CAST, 2)
    tested = F.concat(F.lit(r"(?d)(require|if|assert)\s*\([^;]*\b"), variable, F.lit(r"\b[^;]*(<=|<|>|>=)|(?i:max)[^;]*\b"), variable, F.lit(r"\b"))
    cast = cast.where((variable != "") & ~F.coalesce(F.rlike("before", tested), F.lit(False)))
    quiet = rx("text", r"^\s*emit\s+\w+\s*\(")
    three = _finding(cast, "at", "ARITHMETIC-003", "integer-overflow", F.when(quiet, "low").otherwise("medium"), "medium", _title("Downcast without bound"), F.col("text"))
    return one.unionByName(two).unionByName(three)


def reinitializable_init(c: Corpus) -> DataFrame:
    rows = c.functions.where(_is_open() & rx("name", r"^initialize\w*$") & ~rx(_head(8), *INIT_GUARDS))
    worst = rx("code", r"\b_?(owner|admin|governance|guardian|operator|pauser|token|treasury|oracle|implementation|impl)\b\s*=[^=]", r"\b(?:_?mint|_?grantRole|_?setupRole)\s*\(", r"_?transferOwnership\s*\(")
    severity = F.when(worst, "critical").when(rx("code", STATE_WRITE), "high").otherwise("medium")
    return _finding(rows, "start_line", "INIT-001", "reinitializable-init", severity, "high", _title("Initializer can run again"), F.col("signature"))


def constructor_in_upgradeable(c: Corpus) -> DataFrame:
    up = c.contracts.where((F.col("kind") == "contract") & (rx(_whole(), *UPGRADEABLE) | F.exists("bases", lambda b: b.rlike(r"Upgrad(e)?able$|^Initializable$"))) & ~rx("name", PROXY_SHELLS)).select("path", "contract")
    rows = c.blocks.where("kind = 'constructor'").join(up, ["path", "contract"], "left_semi")
    rest = F.trim(F.regexp_replace("code", DISABLES_INIT + r"\s*;?", ""))
    severity = F.when(rx("code", *CONSTRUCTOR_CRITICAL), "critical").otherwise("high")
    return _finding(rows.where((rest != "") & rx("code", *CONSTRUCTOR_CRITICAL, STATE_WRITE)), "start_line", "INIT-002", "constructor-in-upgradeable", severity, "high", _title("Constructor sets state of an upgradeable contract"), F.col("signature"))


def uninitialized_ownable(c: Corpus) -> DataFrame:
    rows = c.contracts.where((F.col("kind") == "contract") & F.exists("bases", lambda b: b.rlike(r"^Ownable\w*Upgradeable$")) & ~rx("code", r"\b__Ownable_init(_unchained)?\s*\(", r"\b_?transferOwnership\s*\("))
    return _finding(rows, "start_line", "INIT-004", "uninitialized-ownable", "high", "high", _title("Owner is never set"), F.col("signature"))


def flash_loan(c: Corpus) -> DataFrame:
    joined = "|".join(FLASH_CALLBACK_LINE)
    signs = sum((rx("code", s).cast("int") for s in FLASH_MINT_SIGNS), F.lit(0))
    repaid = rx("code", r"_spendAllowance\s*\(", r"\.transferFrom\s*\(", r"_burn\s*\(", r"require\s*\(.*(?:amount|fee|repay|repayment)")
    lend = c.functions.where(_is_open() & rx("name", FLASH_PROVIDER) & rx("code", joined) & ~((signs >= 4) & repaid) & ~rx("signature", *REENTRANCY_GUARDS) & ~rx("code", r"(?m)^\s*_?(locked|mutex|unlocked|status)\s*=[^=]"))
    severity = F.when(rx("code", STATE_WRITE), "critical").otherwise("high")
    one = _finding(lend, _first_line(joined), "DEFI-001", "flash-loan", severity, "high", _title("Flash loan without guard"), _line_text(joined))
    take = c.functions.where(_is_open() & rx("name", FLASH_RECEIVER) & ~rx(_head(8), *CALLER_CHECKS, r"\bonly\w+\b") & rx("code", *RECEIVER_ACTS))
    return one.unionByName(_finding(take, "start_line", "DEFI-002", "flash-loan", "high", "high", _title("Flash-loan callback trusts any caller"), F.col("signature")))


def signature_replay(c: Corpus) -> DataFrame:
    call = r"\becrecover\s*\("
    flags = c.functions.where(F.col("has_body") & (F.col("contract_kind") == "contract") & rx("code", call) & rx("code", *AUTHORISES))
    helper = rx(_whole(), *HASH_HELPERS)
    nonce, chain, deadline = rx(_whole(), *NONCES), rx(_whole(), *CHAIN_IDS) | helper, rx(_whole(), *DEADLINES)
    severity = F.when(~nonce & ~chain, "critical").when(~nonce, "high").when(~chain, "medium").when(~deadline, "low")
    flags = flags.withColumn("level", severity).where("level is not null")
    return _finding(flags, _first_line(call), "DEFI-003", "signature-replay", F.col("level"), "high", _title("Signature can be replayed"), _line_text(call))


def erc4626_inflation(c: Corpus) -> DataFrame:
    base = F.exists("bases", lambda b: b.rlike(VAULT_BASES))
    three = rx("code", r"\bconvertToShares\s*\(") & rx("code", r"\btotalAssets\s*\(") & rx("code", r"\bfunction\s+deposit\s*\(")
    rows = c.contracts.where((F.col("kind") == "contract") & ~F.col("is_abstract") & (base | three) & ~rx("code", *VAULT_PROTECTION))
    return _finding(rows, "start_line", "DEFI-004", "erc4626-inflation", F.when(base, "critical").otherwise("high"), "high", _title("Shares can be inflated by a donation"), F.col("signature"))


def oracle_manipulation(c: Corpus) -> DataFrame:
    guards = c.contracts.groupBy("path").agg(F.bool_or(rx("code", *TWAP)).alias("twap"), F.bool_or(rx("code", *STALENESS)).alias("fresh"))
    rows = c.functions.where("has_body and contract_kind <> 'interface'").join(guards, "path")
    spot, feed, old = "|".join(SPOT_PRICE), r"\.latestRoundData\s*\(", r"\.latestAnswer\s*\("
    feeds = rows.where(rx("code", feed) & ~rx(_whole(), *SEQUENCER))
    parts = [
        _finding(rows.where(rx("code", spot) & ~F.col("twap")), _first_line(spot), "DEFI-005", "oracle-manipulation", "critical", "high", _title("Spot price used"), _line_text(spot)),
        _finding(feeds.where(~F.col("fresh")), _first_line(feed), "DEFI-005", "oracle-manipulation", "high", "high", _title("Age of the answer not checked"), _line_text(feed)),
        _finding(feeds.where(~rx("code", *ANSWER_VALID)), _first_line(feed), "DEFI-005", "oracle-manipulation", "medium", "high", _title("Sign of the answer not checked"), _line_text(feed)),
        _finding(rows.where(rx("code", old)), _first_line(old), "DEFI-005", "oracle-manipulation", "high", "high", _title("Deprecated answer used"), _line_text(old)),
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


def dangerous_approve(c: Corpus) -> DataFrame:
    """A spender the caller chooses is critical, an unlimited amount high; else the deprecated form and the race are told."""
    call = r"\b(?:safeA|a)pprove\s*\("
    zero = r"\.\s*(?:safeA|a)pprove\s*\(\s*\w+\s*,\s*0\s*\)"
    marked = c.functions.where(_is_open() & rx("code", call)).withColumn("opened", ~rx(_whole(), *ACCESS_GUARDS)).withColumn("zeroed", rx("code", zero))
    rows = _code_lines(marked).where(rx("text", r"\.\s*" + call))
    addresses = F.transform(F.filter("params", lambda p: p["type"] == "address"), lambda p: p["name"])
    spender = F.regexp_extract("text", r"\b(?:safeA|a)pprove\s*\(\s*(?:address\s*\(\s*)?(\w+)", 1)
    open_ = F.col("opened")
    chosen = F.array_contains(addresses, spender) & open_ & rx("text", r"\.\s*approve\s*\(")
    level = F.when(chosen, "critical").when(rx("text", *UNLIMITED) & open_, "high")
    rows = rows.withColumn("level", level)
    hard = _finding(rows.where("level is not null"), "at", "DEFI-006", "dangerous-approve", F.col("level"), "high", _title("Dangerous approval"), F.col("text"))
    soft = rows.where("level is null")
    dep = _finding(soft.where(rx("text", r"\.\s*safeApprove\s*\(")), "at", "DEFI-006", "dangerous-approve", "medium", "high", _title("Deprecated safeApprove"), F.col("text"))
    fixed = rx("text", r"approve\s*\(\s*(?:address\s*\(\s*(?:this|0)\s*\)|[A-Z][A-Za-z_0-9]+\s*[,)])")
    race = soft.where(rx("text", r"\.\s*approve\s*\(") & ~F.col("zeroed") & ~fixed)
    return hard.unionByName(dep).unionByName(_finding(race, "at", "DEFI-006", "dangerous-approve", "low", "high", _title("Approval can be raced"), F.col("text")))


def storage_gap_missing(c: Corpus) -> DataFrame:
    inherited = c.contracts.select("path", F.explode("bases").alias("contract")).distinct().withColumn("used", F.lit(True))
    slots = c.variables.where("not is_constant and not is_immutable").groupBy("path", "contract").agg(F.count("*").alias("n"), F.min("line").alias("first"))
    rows = c.contracts.where((F.col("kind") == "contract") & (rx(_whole(), *UPGRADEABLE[:3], *UPGRADEABLE[3:]) | F.exists("bases", lambda b: b.rlike(r"Upgrad(e)?able$|^Initializable$"))) & ~rx("code", r"\b__gap\b"))
    rows = rows.join(slots, ["path", "contract"]).join(inherited, ["path", "contract"], "left")
    basis = F.col("is_abstract") | F.col("used").isNotNull() | rx("code", r"\bvirtual\b") | rx("name", r"Base|Abstract|Storage|State|Core|Common|Logic|Impl")
    what = F.when(basis, _title("No storage gap in a base")).otherwise(_title("No storage gap"))
    return _finding(rows, "start_line", "INIT-003", "storage-gap-missing", "low", "low", what, F.col("signature"))


def override_removes_restriction(c: Corpus) -> DataFrame:
    """Overrides without a restriction that the nearest ancestor's function of that name and parameter count has."""
    guard = rx(_head(8), *ACCESS_GUARDS) | rx(F.array_join("modifiers", " "), r"\b(only\w*|auth|restricted|requiresAuth|protected|ifAdmin)\b")
    f = c.functions.withColumn("guarded", guard).withColumn("n_params", F.size("params"))
    child = f.where(F.col("is_override") & F.col("has_body") & ~F.col("guarded") & _writes())
    parent = f.select(F.col("path").alias("parent_path"), F.col("contract").alias("ancestor"), "name", "n_params", F.col("guarded").alias("parent_guarded"))
    key = ["path", "contract", "name", "n_params", "start_line"]
    near = child.select(*key).join(c.lineage.select("path", "contract", F.col("ancestor_path").alias("parent_path"), "ancestor", "depth"), ["path", "contract"]).join(parent, ["parent_path", "ancestor", "name", "n_params"])
    near = near.groupBy(*key).agg(F.max_by("parent_guarded", F.struct(-F.col("depth"), "ancestor")).alias("was")).where("was")
    return _finding(child.join(near, key, "left_semi"), "start_line", "INIT-005", "override-removes-restriction", F.when(rx("code", STATE_WRITE), "critical").otherwise("high"), "high", _title("Override drops a restriction"), F.col("signature"))


def reentrancy(c: Corpus) -> DataFrame:
    """Functions that write state after a call out of the contract, by the ordered operations of each function."""
    from solstrata.operators.state_ops import cei_violations, helper_calls, state_ops

    rows = c.functions.where(F.col("has_body") & ~F.col("visibility").isin("internal", "private") & ~F.col("name").startswith("_") & _writes() & ~rx("signature", *REENTRANCY_GUARDS) & ~rx("code", r"(?m)^\s*_?(locked|mutex|entered|_status)\s*=[^=]"))
    ops = state_ops(rows, c.blocks, c.variables, c.lineage)
    helped = helper_calls(rows, c.functions, c.lineage)
    bad = cei_violations(ops.unionByName(helped))
    first = bad.groupBy("path", "contract", "function", "start_line").agg(F.min(F.struct("call_line", "write_line", "call_text", "variable")).alias("v"))
    by_helper = helped.select("path", "contract", "function", F.col("line").alias("call_line")).distinct().withColumn("helper", F.lit(True))
    rows = first.select("path", "contract", "function", "v.*").join(by_helper, ["path", "contract", "function", "call_line"], "left").withColumnRenamed("function", "name")
    title = F.concat(_title("Call before the write of a state variable"), F.lit(": "), "variable")
    direct = _finding(rows.where("helper is null"), "call_line", "REENTRANCY-001", "reentrancy", "critical", "high", title, F.col("call_text"))
    return direct.unionByName(_finding(rows.where("helper"), "call_line", "REENTRANCY-002", "reentrancy", "high", "medium", title, F.col("call_text")))


def variable_shadowing(c: Corpus) -> DataFrame:
    state = c.variables.select("path", "contract", F.col("name").alias("variable"))
    params = c.functions.select("path", "contract", "name", "start_line", F.explode("params").alias("p")).select("path", "contract", "name", F.col("start_line").alias("at"), F.col("p.name").alias("variable"), F.lit("SHADOW-002").alias("rule"))
    declared = r"^\s*(?:u?int\d*|address(?:\s+payable)?|bool|string|bytes\d*|[A-Z]\w*)(?:\s*\[[^\]]*\])*\s+(?:memory\s+|storage\s+|calldata\s+)?(\w+)\s*(?:=|;)"
    local = _code_lines(c.functions).select("path", "contract", "name", "at", F.regexp_extract("text", declared, 1).alias("variable"), F.lit("SHADOW-001").alias("rule"))
    hits = params.unionByName(local).where("variable <> ''").join(state, ["path", "contract", "variable"])
    severity = F.when(F.col("rule") == "SHADOW-001", "low").otherwise("high")
    out = _finding(hits, "at", "SHADOW-001", "shadowing", severity, "high", F.concat(_title("State variable shadowed"), F.lit(": "), "variable"), F.col("variable"))
    return out.withColumn("rule_id", F.when(F.col("severity") == "low", "SHADOW-001").otherwise("SHADOW-002")).select(*FINDING)


def vyper_reentrancy(c: Corpus) -> DataFrame:
    """Vyper functions that write through self after a raw call, a send or a call of another contract, and have no lock."""
    out = r"\b(raw_call|send)\s*\(|\b(extcall|staticcall)\b|\b[A-Z]\w*\s*\([^()]*\)\s*\.\s*\w+\s*\("
    write = r"^\s*self\.\w+(?:\[[^\]]*\])*\s*[-+*/%|&^]?=[^=]"
    rows = c.functions.where(F.lower("path").endswith(".vy") & ~F.array_contains("modifiers", "nonreentrant") & (F.col("visibility") == "external") & rx("code", out))
    flags = lambda p: F.transform(F.split("code", "\n", -1), lambda x: F.coalesce(x.rlike("(?d)" + p), F.lit(False)))
    call, writes = F.array_position(flags(out), True), flags(write)
    late = F.exists(F.slice(writes, F.col("call").cast("int") + 1, F.size(writes)), lambda x: x)
    rows = rows.withColumn("call", call).where((F.col("call") > 0)).where(late)
    return _finding(rows, _first_line(out), "REENTRANCY-001", "vyper-reentrancy", "critical", "high", _title("Call before the write of a state variable"), _line_text(out))


Detector = Callable[[Corpus], DataFrame]
DETECTORS: dict[str, Detector] = {
    "reentrancy": reentrancy, "tx-origin": tx_origin, "delegatecall": delegatecall, "upgradeability": unprotected_upgrade, "unchecked-call": unchecked_call, "access-control": access_control,
    "integer-overflow": integer_overflow, "reinitializable-init": reinitializable_init, "constructor-in-upgradeable": constructor_in_upgradeable, "uninitialized-ownable": uninitialized_ownable,
    "flash-loan": flash_loan, "signature-replay": signature_replay, "erc4626-inflation": erc4626_inflation, "oracle-manipulation": oracle_manipulation, "dangerous-approve": dangerous_approve,
}
EXPERIMENTAL: dict[str, Detector] = {"storage-gap-missing": storage_gap_missing, "override-removes-restriction": override_removes_restriction, "shadowing": variable_shadowing, "vyper-reentrancy": vyper_reentrancy}


def register(name: str, detector: Detector) -> None:
    """Add a detector of one's own; it runs with the default ones from then on."""
    DETECTORS[name] = detector


def scan(c: Corpus, names: list[str] | None = None) -> DataFrame:
    """Findings of the named detectors, or of all default ones."""
    known = DETECTORS | EXPERIMENTAL
    unknown = [n for n in names or () if n not in known]
    if unknown:
        raise ValueError(f"no such detector: {', '.join(unknown)}")
    out = None
    for name in names or DETECTORS:
        part = known[name](c).select(*FINDING)
        out = part if out is None else out.unionByName(part)
    return out
