"""How much a call moves, and the ordered policy that decides on it."""

from __future__ import annotations

import fnmatch
from dataclasses import dataclass, replace

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import rules as R

MONEY_NAME = r"(?i)^(?:amount|value|total|price|cost|sum|quantity|qty|size|notional|budget|fee|balance|funds|deposit|withdrawal|payment|amount_.*|.*_amount|.*_value|total_.*|.*_total|o_totalprice)$"
_NUMERIC = r"^[ \t\r\n]*-?[0-9]+(?:\.[0-9]+)?[ \t\r\n]*$"


def as_number(value: Column) -> Column:
    """A variant as an amount: numbers and decimal strings, never booleans, never NaN."""
    kind = F.schema_of_variant(value)
    text = F.try_variant_get(value, "$", "string")
    number = F.when(kind.isin("BIGINT", "DOUBLE", "FLOAT") | kind.startswith("DECIMAL"), F.try_variant_get(value, "$", "double")).when(
        (kind == "STRING") & text.rlike(_NUMERIC), F.trim(text).try_cast("double")
    )
    return F.when(~F.isnan(number), number)


def declared(payload: Column, fields: list[str]) -> Column:
    """The largest declared field as (value, source); ties go to the first declared."""
    options = [F.struct(as_number(F.try_variant_get(payload, f"$['{f}']", "variant")).alias("value"), F.lit(f"declared field '{f}'").alias("source")) for f in fields]
    return _largest(F.array(*options)) if options else F.lit(None).cast("struct<value:double,source:string>")


def _largest(options: Column) -> Column:
    def better(acc: Column, x: Column) -> Column:
        return F.when(x["value"].isNotNull() & (acc["value"].isNull() | (x["value"] > acc["value"])), x).otherwise(acc)

    start = F.struct(F.lit(None).cast("double").alias("value"), F.lit("").alias("source"))
    return F.aggregate(options, start, better)


#: Levels of nesting in which amounts are looked for: the payload itself and six below.
DEPTH = 7


def guessed(payload: Column, depth: int = DEPTH) -> Column:
    """The largest scalar whose key is a word for money, in nested objects and objects in lists, keys in sorted order.

    The walk is unrolled to ``depth`` levels, which keeps it in the JVM.
    """
    return _largest(_options(payload, F.lit(""), depth))


def _options(value: Column, prefix: Column, depth: int) -> Column:
    """(value, source) of every key that is a word for money. Values stay VARIANT, so a text is never taken for a number."""
    none = F.expr("cast(array() as array<struct<key:string,value:variant>>)")
    members = F.coalesce(F.map_entries(F.from_json(F.to_json(value), "map<string,variant>")), none)
    scalars = lambda own: F.transform(
        F.filter(own, lambda m: m["key"].rlike(MONEY_NAME)),
        lambda m: F.struct(as_number(m["value"]).alias("value"), F.concat(F.lit("field name '"), prefix, m["key"], F.lit("'")).alias("source")),
    )
    if depth <= 1:
        return scalars(members)
    is_object = lambda v: F.coalesce(F.schema_of_variant(v).startswith("OBJECT"), F.lit(False))
    leaf = F.expr("cast(array() as array<struct<p:string,v:variant>>)")

    def below(m: Column) -> Column:
        """The objects in a member: itself, or those of its list."""
        items = F.transform(F.try_variant_get(m["value"], "$", "array<variant>"), lambda x, i: F.struct(F.concat(prefix, m["key"], F.lit("["), i.cast("string"), F.lit("].")).alias("p"), x.alias("v")))
        listed = F.when(F.coalesce(F.schema_of_variant(m["value"]).startswith("ARRAY"), F.lit(False)), F.filter(items, lambda x: is_object(x["v"]))).otherwise(leaf)
        return F.when(is_object(m["value"]), F.array(F.struct(F.concat(prefix, m["key"], F.lit(".")).alias("p"), m["value"].alias("v")))).otherwise(listed)

    def walk(own: Column) -> Column:
        inner = F.flatten(F.transform(own, below))
        return F.concat(scalars(own), F.flatten(F.transform(inner, lambda c: _options(c["v"], c["p"], depth - 1))))

    return F.transform(F.array(members), walk)[0]


def magnitude(payload: Column, fields: list[str] | None = None, depth: int = DEPTH) -> Column:
    """(value, source) of what a payload moves: declared fields first, else by name; null and '' if unknown."""
    if not fields:
        return guessed(payload, depth)
    known = declared(payload, fields)
    return F.when(known["value"].isNotNull(), known).otherwise(guessed(payload, depth))


@dataclass(frozen=True)
class Policy:
    deny_scan_at: int = R.CRITICAL
    approve_scan_at: int = R.HIGH
    approval_over: float | None = None
    deny_over: float | None = None
    always_approve: tuple[str, ...] = ()
    always_deny: tuple[str, ...] = ()
    unknown_action: str = "require_approval"
    unmeasurable_irreversible: str = "require_approval"
    deny_on_validation_error: bool = True

    @staticmethod
    def permissive() -> Policy:
        return Policy(approve_scan_at=R.CRITICAL, unknown_action="allow", unmeasurable_irreversible="allow")

    @staticmethod
    def strict(over: float = 0.0) -> Policy:
        return replace(Policy(), deny_scan_at=R.HIGH, approve_scan_at=R.MEDIUM, unknown_action="deny", approval_over=over)


def matches(action: Column, globs: tuple[str, ...]) -> Column:
    """Whether any glob matches the whole name, case-sensitively."""
    found = F.lit(False)
    for g in globs:
        found = found | action.rlike("(?s)\\A" + fnmatch.translate(g).removeprefix("(?s:").removesuffix(r")\Z").removesuffix(r")\z") + "\\z")
    return found


def decide(
    policy: Policy, action: Column, known: Column, irreversible: Column, amount: Column, scan_severity: Column, scan_message: Column, n_violations: Column, violation_text: Column
) -> Column:
    """(decision, reason) by one ordered chain; the first case that holds decides."""

    def verdict(decision: str, why: Column | str) -> Column:
        return F.struct(F.lit(decision).alias("decision"), (why if isinstance(why, Column) else F.lit(why)).alias("reason"))

    severity = F.coalesce(scan_severity, F.lit(-1))
    chain = F.when(matches(action, policy.always_deny), verdict("deny", "the action is always denied"))
    if policy.deny_on_validation_error:
        chain = chain.when(n_violations > 0, verdict("deny", F.concat(F.lit("invalid payload: "), violation_text)))
    chain = chain.when(severity >= policy.deny_scan_at, verdict("deny", F.concat(F.lit("scan: "), F.coalesce(scan_message, F.lit("")))))
    if policy.deny_over is not None:
        chain = chain.when(amount > policy.deny_over, verdict("deny", "moves more than the limit"))
    if policy.unknown_action in ("deny", "require_approval"):
        chain = chain.when(~known, verdict(policy.unknown_action, "the action is not registered"))
    chain = chain.when(matches(action, policy.always_approve), verdict("require_approval", "the action always needs approval"))
    chain = chain.when(severity >= policy.approve_scan_at, verdict("require_approval", F.concat(F.lit("scan: "), F.coalesce(scan_message, F.lit("")))))
    if policy.unmeasurable_irreversible in ("deny", "require_approval"):
        chain = chain.when(irreversible & amount.isNull(), verdict(policy.unmeasurable_irreversible, "irreversible, and what it moves is unknown"))
    if policy.approval_over is not None:
        chain = chain.when(irreversible & (amount > policy.approval_over), verdict("require_approval", "irreversible, and over the approval limit"))
        chain = chain.when(amount > policy.approval_over, verdict("require_approval", "over the approval limit"))
    return chain.otherwise(verdict("allow", "within policy"))
