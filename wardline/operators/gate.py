"""The gate: registry, remembered scans, checks of calls, approvals, audit. Holds tables, runs no handlers."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import rules as R
from . import combine, contract, ledger, policy, scan


@dataclass
class Registration:
    action: str
    contract: contract.Contract | None = None
    irreversible: bool = False
    note: str = ""


@dataclass
class Gate:
    spark: SparkSession
    policy: policy.Policy = field(default_factory=policy.Policy.strict)
    registry: dict[str, Registration] = field(default_factory=dict)

    def register(self, action: str, contract: contract.Contract | None = None, irreversible: bool = False, note: str = "") -> None:
        """Adds an action, or replaces it."""
        self.registry[action] = Registration(action, contract, irreversible, note)

    def registered(self) -> list[str]:
        return sorted(self.registry)

    def describe(self, action: str) -> dict:
        found = self.registry[action]
        if found.contract is None:
            raise KeyError(f"{action} has no contract")
        return found.contract.payload_description()

    def registry_table(self) -> DataFrame:
        rows = [(r.action, r.irreversible) for r in self.registry.values()]
        return self.spark.createDataFrame(rows, "action string, irreversible boolean")

    def inspect(self, tools: DataFrame) -> DataFrame:
        """toolkit, action, max_severity, message (the first finding at that level), n: one row per action with findings."""
        first = F.struct((-F.col("severity")).alias("s"), "place", "rule", "detector", "excerpt")
        rows = scan.scan_tools(tools).groupBy("toolkit", "action").agg(
            F.max("severity").alias("_max"), F.min(first).alias("_f"), F.count(F.lit(1)).alias("_n"), F.bit_or(combine.category_bit(F.col("detector"))).alias("_mask")
        )
        # Findings are aggregated once; the composite, which would come first, is read off their categories.
        rows = rows.withColumn("_why", combine.reason(F.col("_mask")))
        damning = F.col("_why").isNotNull()
        return rows.select(
            "toolkit", "action",
            F.when(damning, R.CRITICAL).otherwise(F.col("_max")).alias("max_severity"),
            F.when(damning, F.concat(F.lit("composite: "), "_why")).otherwise(F.concat("_f.detector", F.lit(": "), "_f.excerpt")).alias("message"),
            (F.col("_n") + damning.cast("int")).alias("n"),
        )

    def usable(self, tools: DataFrame) -> DataFrame:
        """The tools whose own scan, all fields together, stays below the policy's deny level."""
        bad = self.inspect(tools).filter(F.col("max_severity") >= self.policy.deny_scan_at).select("toolkit", F.col("action").alias("_name"))
        named = tools.withColumn("_name", scan.name_of())
        return named.join(bad, ["toolkit", "_name"], "left_anti").select(*tools.columns)

    def violations(self, action: Column, payload: Column) -> Column:
        """Violations by the contract of the action; actions without one have none."""
        cases = None
        for r in self.registry.values():
            if r.contract is not None:
                found = contract.violations(payload, r.contract)
                cases = F.when(action == r.action, found) if cases is None else cases.when(action == r.action, found)
        none = F.expr(f"cast(array() as array<{contract.VIOLATION}>)")
        return none if cases is None else cases.otherwise(none)

    def amounts(self, action: Column, payload: Column) -> Column:
        cases = None
        for r in self.registry.values():
            if r.contract is not None and r.contract.monetary():
                found = policy.magnitude(payload, r.contract.monetary())
                cases = F.when(action == r.action, found) if cases is None else cases.when(action == r.action, found)
        rest = policy.guessed(payload)
        return rest if cases is None else cases.otherwise(rest)

    def redacted(self, action: Column, payload: Column) -> Column:
        """The canonical text of a payload (JSON text) that a record may hold: fields in the order of their names, those
        that the action's contract calls sensitive replaced."""
        cases = None
        for r in self.registry.values():
            if r.contract is not None:
                found = contract.redacted(payload, r.contract)
                cases = F.when(action == r.action, found) if cases is None else cases.when(action == r.action, found)
        whole = F.from_json(payload, "map<string,string>")
        fields = whole if cases is None else cases.otherwise(whole)
        return F.coalesce(F.to_json(F.map_from_entries(F.array_sort(F.map_entries(fields)))), payload)

    def payload_scans(self, calls: DataFrame) -> DataFrame:
        """call_id, severity and message of the gravest finding in the texts of a call's payload."""
        fields = calls.select("call_id", F.explode(F.from_json("payload", "map<string,string>")).alias("field", "text"))
        found = scan.scan_texts(fields, ["call_id", "field"])
        first = F.struct((-F.col("severity")).alias("s"), "field", "detector", "rule", "excerpt")
        rows = found.groupBy("call_id").agg(F.min(first).alias("f"))
        return rows.select("call_id", (-F.col("f.s")).alias("severity"), F.concat(F.lit("payload."), "f.field", F.lit(": "), "f.detector").alias("message"))

    def check(self, calls: DataFrame, scans: DataFrame | None = None, scan_payloads: bool = False, asof: str | None = None) -> DataFrame:
        """calls (call_id, action, payload as JSON text) with decision, reason, magnitude, source, n_violations, and
        payload_digest, that of the redacted payload.

        ``scans`` (action, inspected_at, max_severity, message) are remembered inspections: the latest taints a call, or
        of those up to the call's time ``asof`` the latest. With ``scan_payloads`` the texts of a payload count as well.
        """
        known = self.registry_table().withColumn("known", F.lit(True))
        # The registry is held by the driver; it is broadcast only while it is small.
        rows = calls.join(F.broadcast(known) if len(self.registry) <= 10_000 else known, "action", "left")
        rows = rows.withColumns({"known": F.coalesce("known", F.lit(False)), "irreversible": F.coalesce("irreversible", F.lit(False)), "_v": F.try_parse_json("payload")})
        none = F.lit(None).cast("struct<max_severity:int,message:string>")
        if scans is None:
            rows = rows.withColumn("_scan", none)
        elif asof is None:
            last = scans.groupBy("action").agg(F.max_by(F.struct("max_severity", "message"), "inspected_at").alias("_scan"))
            rows = rows.join(last, "action", "left")
        else:
            # An action's inspections are few; each call takes the last one before it.
            past = scans.groupBy("action").agg(F.array_sort(F.collect_list(F.struct("inspected_at", "max_severity", "message"))).alias("_past"))
            seen = F.filter("_past", lambda x: x["inspected_at"] <= F.col(asof))
            last = F.try_element_at(seen, F.lit(-1))
            rows = rows.join(past, "action", "left").withColumn("_scan", F.when(last.isNotNull(), F.struct(last["max_severity"].alias("max_severity"), last["message"].alias("message"))))
        if scan_payloads:
            rows = rows.join(self.payload_scans(calls).select("call_id", F.struct(F.col("severity").alias("max_severity"), "message").alias("_own")), "call_id", "left")
            graver = F.coalesce(F.col("_own.max_severity") > F.coalesce(F.col("_scan.max_severity"), F.lit(-1)), F.lit(False))
            rows = rows.withColumn("_scan", F.when(graver, F.col("_own")).otherwise(F.col("_scan")))
        rows = rows.withColumns({"_bad": self.violations(F.col("action"), F.col("_v")), "_sum": self.amounts(F.col("action"), F.col("_v"))})
        said = F.array_join(F.transform(F.slice("_bad", F.lit(1), F.lit(3)), lambda x: F.concat(x["path"], F.lit(" "), x["message"])), "; ")
        verdict = policy.decide(
            self.policy, F.col("action"), F.col("known"), F.col("irreversible"), F.col("_sum.value"), F.col("_scan.max_severity"), F.col("_scan.message"), F.size("_bad"), said
        )
        return rows.withColumn("_verdict", verdict).select(
            *calls.columns, F.col("_verdict.decision").alias("decision"), F.col("_verdict.reason").alias("reason"), F.col("_sum.value").alias("magnitude"), F.col("_sum.source").alias("magnitude_source"), F.size("_bad").alias("n_violations"),
            F.sha2(self.redacted(F.col("action"), F.col("payload")), 256).alias("payload_digest"),
        )

    # Entries for a ledger: (ts, kind, action, decision, reason, payload_digest), to be sealed or appended.

    def registrations(self, ts: str) -> DataFrame:
        """An entry for each registered action."""
        rows = [(ts, "register", r.action, "registered", r.note, "") for r in sorted(self.registry.values(), key=lambda r: r.action)]
        return self.spark.createDataFrame(rows, "ts string, kind string, action string, decision string, reason string, payload_digest string")

    def flags(self, inspections: DataFrame, ts: Column) -> DataFrame:
        """An entry for each action that ``inspect`` has findings of."""
        return inspections.select(ts.alias("ts"), F.lit("inspect").alias("kind"), "action", F.lit("flagged").alias("decision"), F.concat(F.col("n").cast("string"), F.lit(" findings, first "), "message").alias("reason"), F.lit("").alias("payload_digest"))

    def records(self, verdicts: DataFrame, ts: Column) -> DataFrame:
        """An entry for each checked call; of the payload only the digest of its redacted form."""
        return verdicts.select("call_id", ts.alias("ts"), F.lit("check").alias("kind"), "action", "decision", "reason", F.coalesce("payload_digest", F.lit("")).alias("payload_digest"))

    def executable(self, verdicts: DataFrame, approvals: DataFrame) -> DataFrame:
        """The calls that may run: allowed ones, and those with an approval (call_id, approved). No approval is a refusal."""
        asked = verdicts.join(approvals, "call_id", "left")
        return asked.filter((F.col("decision") == "allow") | ((F.col("decision") == "require_approval") & F.coalesce("approved", F.lit(False)))).select(*verdicts.columns)

    def audit(self, sealed: DataFrame, chain: str, line: str, heads: DataFrame | None = None) -> DataFrame:
        """One row: chains, entries, broken chains, and what that does not show."""
        first = ledger.verify(sealed, chain, line, heads).select(F.col(chain).alias("_chain"), F.lit(0).cast("long").alias("n"), F.lit(1).alias("bad"))
        every = sealed.groupBy(F.col(chain).alias("_chain")).agg(F.count(F.lit(1)).alias("n")).withColumn("bad", F.lit(0)).unionByName(first)
        caveat = "" if heads is not None else "without known heads a chain whose end was cut off looks whole"
        return every.agg(
            F.count_if((F.col("bad") == 0)).alias("chains"), F.coalesce(F.sum("n"), F.lit(0)).alias("entries"), F.coalesce(F.sum("bad"), F.lit(0)).cast("long").alias("broken"), F.lit(caveat).alias("caveat")
        )
