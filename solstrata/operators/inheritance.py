"""Inheritance between contracts: edges, ancestors, effective functions, override chains, selectors, modifiers."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from solstrata.operators.closure import closure
from solstrata.operators.structure import rx

_NUL = "\u0000"
# What well-known modifiers do, by name.
MODIFIER_KINDS = {
    "access control": "onlyOwner onlyRole onlyAdmin onlyMinter onlyPauser onlyBridge onlyPool onlyPoolAdmin onlyEmergencyAdmin onlyEmergencyOrPoolAdmin onlyAssetListingOrPoolAdmins "
    "onlyRiskOrPoolAdmins onlyPoolConfigurator ifAdmin onlyProxyAdmin adminOnly requiresAuth restricted protected auth",
    "reentrancy guard": "nonReentrant nonreentrant lock",
    "pause check": "whenNotPaused whenPaused",
    "initializer": "initializer reinitializer onlyInitializing",
    "other": "noDelegateCall",
}
#: What a line of a modifier checks, in the order in which kinds decide.
MODIFIER_CHECKS = (
    ("access control", r"msg\.sender\s*[!=]=|[!=]=\s*msg\.sender|hasRole\s*\(|_check(Owner|Role)\s*\(|isOwner\s*\(|\[\s*msg\.sender\s*\]"),
    ("reentrancy guard", r"_?(status|locked|entered|unlocked|mutex)\s*[!=]?=|_nonReentrant(Before|After)\s*\("),
    ("initializer", r"_?initializ(ed|ing)\b|_disableInitializers"),
    ("pause check", r"_?paused\b|_requireNotPaused|_requirePaused"),
    ("time", r"block\.(timestamp|number)"),
    ("value", r"msg\.value"),
    ("balance", r"\bbalance\b|balanceOf\s*\("),
    ("delegate", r"delegatecall|address\s*\(\s*this\s*\)"),
    ("condition", r"\brequire\s*\(|\brevert\b|\bassert\s*\("),
)


def inherits(blocks: DataFrame) -> DataFrame:
    """(path, child, parent, ord): bases as written, the last part of dotted names."""
    holders = blocks.where(F.col("kind").isin("contract", "interface", "library"))
    out = holders.select("path", F.col("name").alias("child"), F.posexplode("bases").alias("ord", "parent"))
    return out.select("path", "child", F.element_at(F.split("parent", r"\."), -1).alias("parent"), "ord")


def project_of(path: str = "path") -> Column:
    """The repository a path begins with (its first two parts), '' for shorter and absolute paths."""
    parts = F.split(path, "/")
    return F.when(~F.startswith(F.col(path), F.lit("/")) & (F.size(parts) >= 3), F.concat_ws("/", F.element_at(parts, 1), F.element_at(parts, 2))).otherwise("")


def resolve_parents(blocks: DataFrame, imported: DataFrame | None = None) -> DataFrame:
    """(path, child, parent, parent_path, ord): where each base is declared: same file, an imported file, else a file of the project.

    Each of the three is a join of its own with at most one partner, so a name that many files declare does not multiply.
    """
    edges = inherits(blocks)
    found = blocks.where(F.col("kind").isin("contract", "interface", "library")).select("path", F.col("name").alias("parent")).distinct()
    out = edges.withColumn("project", project_of()).join(found.withColumn("here", F.lit(True)), ["path", "parent"], "left")
    if imported is not None:
        near = imported.select("path", F.col("resolved").alias("parent_path")).where("path <> parent_path").distinct().join(found.withColumnRenamed("path", "parent_path"), "parent_path")
        out = out.join(near.groupBy("path", "parent").agg(F.min("parent_path").alias("near")), ["path", "parent"], "left")
    else:
        out = out.withColumn("near", F.lit(None).cast("string"))
    far = found.groupBy(project_of().alias("project"), "parent").agg(F.min("path").alias("far"))
    out = out.join(far, ["project", "parent"], "left")
    return out.select("path", "child", "parent", F.when(F.col("here"), F.col("path")).otherwise(F.coalesce("near", "far")).alias("parent_path"), "ord")


def lineage(blocks: DataFrame, imported: DataFrame | None = None) -> DataFrame:
    """(path, contract, ancestor_path, ancestor, depth) across files; ancestor_path is '' for bases that are declared nowhere."""
    node = lambda p, c: F.concat(F.coalesce(F.col(p), F.lit("")), F.lit(_NUL), F.col(c))
    edges = resolve_parents(blocks, imported).select(node("path", "child").alias("child"), node("parent_path", "parent").alias("parent"))
    part = lambda c, k: F.split_part(F.col(c), F.lit(_NUL), F.lit(k))
    return closure(edges, "child", "parent").select(part("child", 1).alias("path"), part("child", 2).alias("contract"), part("parent", 1).alias("ancestor_path"), part("parent", 2).alias("ancestor"), "depth")


def _declared(blocks: DataFrame, lines: DataFrame | None) -> DataFrame:
    """lineage with the names declared_path and declared_in for where something may be declared."""
    lines = lineage(blocks) if lines is None else lines
    return lines.select("path", "contract", F.col("ancestor_path").alias("declared_path"), F.col("ancestor").alias("declared_in"), "depth")


def ancestors(edges: DataFrame) -> DataFrame:
    """(path, child, ancestor, depth) within each file."""
    return closure(edges, "child", "parent", ["path"]).withColumnRenamed("parent", "ancestor")


def descendants(edges: DataFrame) -> DataFrame:
    return ancestors(edges).select("path", F.col("ancestor").alias("contract"), F.col("child").alias("descendant"), "depth")


def base_contracts(edges: DataFrame) -> DataFrame:
    """(path, contract): contracts some other contract of the file inherits from."""
    return edges.select("path", F.col("parent").alias("contract")).distinct()


def _signed(name: pd.Series, types: pd.Series) -> pd.DataFrame:
    from solstrata.functions.keccak import canonical_signature, selector

    texts = [canonical_signature(n, list(t)) for n, t in zip(name, types)]
    made = {t: selector(t).hex() for t in set(texts)}
    return pd.DataFrame({"canonical": texts, "selector": [made[t] for t in texts]})


def signatures(blocks: DataFrame) -> DataFrame:
    """(path, contract, function, start_line, canonical, selector) of named functions; selector is 8 hex digits."""
    signed = F.pandas_udf(_signed, "canonical string, selector string")
    rows = blocks.where("kind = 'function' and name <> ''").withColumn("s", signed("name", F.transform("params", lambda p: p["type"])))
    return rows.select("path", "contract", F.col("name").alias("function"), "start_line", "s.canonical", "s.selector")


def selector_collisions(signed: DataFrame) -> DataFrame:
    """(selector, forms): selectors that stand for different signatures."""
    out = signed.groupBy("selector").agg(F.array_sort(F.collect_set("canonical")).alias("forms"))
    return out.where(F.size("forms") > 1)


def effective_functions(blocks: DataFrame, lines: DataFrame | None = None) -> DataFrame:
    """(path, contract, function, n_params, declared_in, depth): what a contract offers; the nearest definition wins."""
    own = blocks.where("kind = 'function' and name <> ''").select(F.col("path").alias("declared_path"), F.col("contract").alias("declared_in"), F.col("name").alias("function"), F.size("params").alias("n_params"))
    selves = blocks.where(F.col("kind").isin("contract", "interface", "library")).select("path", F.col("name").alias("contract"), F.col("path").alias("declared_path"), F.col("name").alias("declared_in"), F.lit(0).alias("depth"))
    every = _declared(blocks, lines).unionByName(selves).join(own.distinct(), ["declared_path", "declared_in"])
    out = every.groupBy("path", "contract", "function", "n_params").agg(F.min(F.struct("depth", "declared_in", "declared_path")).alias("m"))
    return out.select("path", "contract", "function", "n_params", "m.declared_in", "m.depth")


def modifier_kind(name: Column) -> Column:
    """Kind of a modifier by its name: the list first, then prefixes."""
    known = F.create_map(*[x for kind, names in MODIFIER_KINDS.items() for n in names.split() for x in (F.lit(n), F.lit(kind))])
    return F.coalesce(known[name], F.when(name.rlike(r"^(only|auth|requires|check|restrict)"), "access control").when(name.rlike(r"(?i)reentran|^lock"), "reentrancy guard").when(name.rlike(r"(?i)pause"), "pause check").when(name.rlike(r"(?i)^init"), "initializer"), F.lit("other"))


def modifier_kinds(blocks: DataFrame) -> DataFrame:
    """(path, contract, modifier, kind, checks): modifiers by what their lines check; the first kind in order decides."""
    mods = blocks.where("kind = 'modifier'")
    checks = F.array_compact(F.array(*[F.when(rx("code", p), F.lit(k)) for k, p in MODIFIER_CHECKS]))
    out = mods.select("path", "contract", F.col("name").alias("modifier"), checks.alias("checks"))
    return out.select("path", "contract", "modifier", F.coalesce(F.when(F.size("checks") > 0, F.element_at("checks", 1)), modifier_kind(F.col("modifier"))).alias("kind"), "checks")


def function_guards(blocks: DataFrame, lines: DataFrame | None = None) -> DataFrame:
    """(path, contract, function, modifier, kind): modifiers of functions, resolved in the contract, then ancestors, then by name."""
    used = blocks.where("kind = 'function'").select("path", "contract", F.col("name").alias("function"), F.explode("modifiers").alias("modifier"))
    defined = modifier_kinds(blocks).select(F.col("path").alias("declared_path"), F.col("contract").alias("declared_in"), "modifier", "kind")
    own = used.select("path", "contract", F.col("path").alias("declared_path"), F.col("contract").alias("declared_in"), F.lit(0).alias("depth")).distinct()
    reach = _declared(blocks, lines).unionByName(own).join(defined, ["declared_path", "declared_in"]).groupBy("path", "contract", "modifier").agg(F.min_by("kind", F.struct("depth", "declared_in")).alias("kind"))
    out = used.join(reach, ["path", "contract", "modifier"], "left")
    return out.select("path", "contract", "function", "modifier", F.coalesce("kind", modifier_kind(F.col("modifier"))).alias("kind"))


def override_links(blocks: DataFrame, lines: DataFrame | None = None) -> DataFrame:
    """(path, contract, function, n_params, pos, declared_in, modifiers, dropped, gained, dropped_access): links of each override chain.

    A chain begins at the contract (pos 0) and goes up; dropped and gained compare a link with the next one up.
    """
    on = ["declared_path", "declared_in"]
    own = blocks.where("kind = 'function' and name <> ''").groupBy(F.col("path").alias("declared_path"), F.col("contract").alias("declared_in"), F.col("name").alias("function"), F.size("params").alias("n_params")).agg(
        F.max("modifiers").alias("modifiers"))
    tips = own.select(F.col("declared_path").alias("path"), F.col("declared_in").alias("contract"), *on, "function", "n_params", F.lit(0).alias("depth"), "modifiers")
    ups = _declared(blocks, lines).join(own, on).join(tips.select("path", "contract", "function", "n_params"), ["path", "contract", "function", "n_params"], "left_semi")
    every = tips.unionByName(ups.select(*tips.columns))
    w = Window.partitionBy("path", "contract", "function", "n_params").orderBy("depth", "declared_in", "declared_path")
    out = every.withColumn("pos", F.row_number().over(w) - 1).withColumn("up", F.lead("modifiers").over(w)).withColumn("chain", F.count("*").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    out = out.where("chain > 1").withColumn("dropped", F.array_except("up", "modifiers")).withColumn("gained", F.array_except("modifiers", "up"))
    access = lambda names: F.exists(F.coalesce(names, F.array().cast("array<string>")), lambda m: modifier_kind(m) == "access control")
    return out.select("path", "contract", "function", "n_params", "pos", "declared_in", "modifiers", "dropped", "gained", (access(F.col("dropped")) & ~access(F.col("modifiers"))).alias("dropped_access"))


def regressions(links: DataFrame) -> DataFrame:
    """Links that lost access control without gaining another, once per contract and function."""
    return links.where("dropped_access").groupBy("path", "contract", "function", "n_params").agg(F.min(F.struct("pos", "declared_in", "dropped")).alias("first")).select("path", "contract", "function", "n_params", "first.*")
