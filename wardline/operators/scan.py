"""Scanning: from tables of texts, tools or toolkits to findings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import rules as R
from ..functions import text as T
from . import combine, decode, detect


def canonical(df: DataFrame, text: str = "text", full: bool = False) -> DataFrame:
    """Adds ``canon`` and ``low``, each computed once per row. ``full`` adds compatibility normalisation (Arrow)."""
    df = T.with_canonical(df, text) if full else df.withColumn("canon", T.fold(F.col(text)))
    return df.withColumn("low", F.lower("canon"))


def pieces(texts: DataFrame, keys: list[str], text: str = "text", full: bool = False, readings: bool = True) -> DataFrame:
    """Every text and what it hides as rows of their own: keys, _kind (text, markup, escape, reading), _label, _piece (what
    the detectors read), _shown; the raw text beside itself, the canonical text beside its readings."""
    rows = canonical(texts.select(*keys, F.coalesce(F.col(text), F.lit("")).alias("_text")), "_text", full)
    raw = F.col("_text")
    every = [F.array(detect.piece("text", "", F.col("canon"), F.lit(""))), detect.escape_run(raw), detect.hidden_markup(raw)]
    if readings:
        every.append(decode.folded(decode.views(raw)))
    held = rows.select(*keys, raw, "canon", raw.rlike("(?:%[0-9a-fA-F]{2}){4}").alias("_packed"), F.explode_outer(F.concat(*every)).alias("_p"))
    kind = F.col("_p.kind")
    return held.select(
        *keys, kind.alias("_kind"), F.col("_p.label").alias("_label"), F.col("_p.text").alias("_piece"), F.col("_p.shown").alias("_shown"), "_packed",
        F.when(kind == "text", raw).alias("_raw"), F.when(kind == "reading", F.col("canon")).alias("_canon"),
    )


def signals(rows: DataFrame) -> DataFrame:
    """``pieces`` with _signals. Each detector stands in the plan once, for texts, readings, and hidden pieces alike."""
    aimed = F.when((F.col("_kind") == "reading") & F.col("_label").isin(*decode.REORDERED), F.lit("")).otherwise(F.col("_piece"))
    rows = detect.destinations(rows.withColumn("_read", aimed), "_read", "_aims", width=1 << 30)
    rows = rows.withColumn("_low", F.lower("_piece"))
    rows = rows.withColumn("_hits", detect.noted(F.col("_piece")))
    said = detect.phrases(F.col("_piece"), F.col("_low"), F.col("_hits"))
    squashed = F.when(F.col("_kind") == "text", F.expr(detect.NONE)).otherwise(detect.squashed(F.col("_piece")))
    rows = rows.withColumn("_said", F.concat(said, squashed))
    raw, kind, both = F.col("_raw"), F.col("_kind"), F.concat("_said", "_aims")
    strong = F.exists(both, lambda s: s["severity"] >= R.HIGH)
    aims = F.transform("_aims", lambda s: s.withField("excerpt", T.clip(s["excerpt"])))
    whole = F.concat(detect.characters(raw), detect.disguised(raw), "_said", aims, decode.base64_runs(raw), detect.layout(raw))
    markup = F.array(detect.signal("hidden_markup", F.when(strong, R.CRITICAL).otherwise(R.MEDIUM), F.col("_label"), F.col("_shown")))
    escape = F.array(detect.signal("escape_run", F.when(F.size(both) > 0, R.CRITICAL).otherwise(R.HIGH), F.col("_label"), F.col("_shown")))
    found = F.when(kind == "text", whole).when(kind == "markup", markup).when(kind == "escape", escape).otherwise(decode.revealing(F.col("_said"), F.col("_aims")))
    return rows.withColumn("_signals", found)


def scan_texts(texts: DataFrame, keys: list[str], text: str = "text", full: bool = False, readings: bool = True) -> DataFrame:
    """All findings of a table of texts: keys, detector, severity, rule, excerpt. One pass and no shuffle; ``full`` reads
    texts in their compatibility form."""
    return T.expand(signals(pieces(texts, keys, text, full, readings)), [*keys], F.col("_signals"))


def revealed(texts: DataFrame, keys: list[str], text: str = "text", full: bool = False) -> DataFrame:
    """keys, label, detector, severity, rule, excerpt: what readings show that the texts themselves do not."""
    return T.expand(signals(pieces(texts, keys, text, full).filter("_kind = 'reading'")), [*keys, F.col("_label").alias("label")], F.col("_signals"))


def scan(texts: DataFrame, keys: list[str], text: str = "text", **options) -> DataFrame:
    """Findings with a composite per damning text."""
    return combine.combine_texts(scan_texts(texts, keys, text, **options), keys)


def name_of(action: str = "action", name: str = "name") -> Column:
    return F.coalesce(F.nullif(F.col(action), F.lit("")), F.nullif(F.col(name), F.lit("")), F.lit("<unnamed>"))


DESCRIPTIONS = ("description", "actionDescription", "action_description")


def tool_records(records: DataFrame, record: str = "record") -> DataFrame:
    """toolkit, action, name, the descriptions, and payload, from JSON records of actions (toolkit and ``record``).

    Of the two names a payload description goes by, payloadDescription counts if the record has it at all, null included.
    """
    v = F.try_parse_json(record)
    text = lambda k: F.when(F.schema_of_variant(F.try_variant_get(v, f"$.{k}", "variant")) == "STRING", F.try_variant_get(v, f"$.{k}", "string"))
    keys = F.coalesce(F.json_object_keys(record), F.array().cast("array<string>"))
    value = lambda k: F.to_json(F.try_variant_get(v, f"$.{k}", "variant"))
    payload = F.when(F.array_contains(keys, "payloadDescription"), value("payloadDescription")).otherwise(value("payload_description"))
    return records.select("toolkit", text("action").alias("action"), text("name").alias("name"), *(text(c).alias(c) for c in DESCRIPTIONS), F.nullif(payload, F.lit("null")).alias("payload"))


def toolkit_tools(toolkits: DataFrame, record: str = "record") -> DataFrame:
    """The tools of JSON records of toolkits, as ``tool_records`` gives them. Actions are a list, or an object whose keys
    are their names."""
    actions = F.get_json_object(record, "$.actions")
    listed = F.from_json(actions, "array<string>")
    named = F.transform(F.map_entries(F.from_json(actions, "map<string,string>")), lambda e: F.concat(F.lit('{"action":'), F.to_json(F.struct(e["key"].alias("k"))).substr(F.lit(6), F.length(F.to_json(F.struct(e["key"].alias("k")))) - 6), F.when(e["value"].rlike(r"\A\{\s*\}\z"), F.lit("}")).otherwise(F.concat(F.lit(","), F.regexp_replace(e["value"], r"\A\{", "")))))
    every = F.when(actions.startswith("{"), named).otherwise(F.coalesce(listed, F.array().cast("array<string>")))
    kit = F.coalesce(F.get_json_object(record, "$.name"), F.lit("<unnamed toolkit>"))
    return tool_records(toolkits.select(kit.alias("toolkit"), F.explode(every).alias("record")))


def toolkit_texts(toolkits: DataFrame, record: str = "record") -> DataFrame:
    """toolkit, action (null), place, kind, attribute, text of the toolkits' own descriptions."""
    kit = F.coalesce(F.get_json_object(record, "$.name"), F.lit("<unnamed toolkit>"))
    told = [F.struct(F.lit(c).alias("place"), F.lit("description").alias("kind"), F.lit("").alias("attribute"), F.get_json_object(record, f"$.{c}").alias("text")) for c in ("description", "toolkitDescription")]
    rows = T.expand(toolkits, [kit.alias("toolkit"), F.lit(None).cast("string").alias("action")], F.array(*told))
    return rows.filter(F.coalesce(F.col("text"), F.lit("")) != "")


def flatten_tools(tools: DataFrame) -> DataFrame:
    """toolkit, action, place, kind, attribute, text: one row per text of a tool, its name among them.

    ``tools`` has toolkit, action, name, any of the three description columns, and payload, a JSON string: a text, or an
    object of fields whose values are texts or objects of attributes. Texts nested deeper than an attribute are scanned
    too. Each description that is there counts; a payload that is no JSON is a text of its own.
    """
    base = tools.withColumn("_action", name_of()).withColumn("_v", F.try_parse_json("payload"))
    told = [F.struct(F.lit(c).alias("place"), F.lit("description").alias("kind"), F.lit("").alias("attribute"), F.col(c).alias("text")) for c in DESCRIPTIONS if c in tools.columns]
    told.append(F.struct(F.lit("action").alias("place"), F.lit("name").alias("kind"), F.lit("").alias("attribute"), F.col("_action").alias("text")))
    described = T.expand(base, ["toolkit", F.col("_action").alias("action")], F.array(*told))
    plain = base.filter(F.col("payload").isNotNull() & (F.col("_v").isNull() | (F.schema_of_variant("_v") == "STRING")))
    whole = plain.select("toolkit", F.col("_action").alias("action"), F.lit("payload").alias("place"), F.lit("payload").alias("kind"), F.lit("").alias("attribute"), F.coalesce(F.try_variant_get("_v", "$", "string"), F.col("payload")).alias("text"))
    view = "variant_explode(_v)"
    fields = base.filter(F.schema_of_variant("_v").startswith("OBJECT")).select("toolkit", F.col("_action").alias("action"), F.col("_v"))
    fields = fields.lateralJoin(fields.sparkSession.tvf.variant_explode(F.col("_v").outer())).select("toolkit", "action", F.col("key").alias("field"), F.col("value").alias("fv")) if hasattr(fields, "lateralJoin") else fields.selectExpr("toolkit", "action", view)
    fields = fields.withColumn("_at", F.concat(F.lit("payload."), F.col("field")))
    names = fields.select("toolkit", "action", "_at", F.lit("field_name").alias("kind"), F.lit("").alias("attribute"), F.col("field").alias("text"))
    value = F.schema_of_variant("fv")
    flat = fields.filter(value == "STRING").select("toolkit", "action", "_at", F.lit("field").alias("kind"), F.lit("").alias("attribute"), F.try_variant_get("fv", "$", "string").alias("text"))
    objects = fields.filter(value.startswith("OBJECT")).select("toolkit", "action", "_at", "fv")
    inner = objects.lateralJoin(objects.sparkSession.tvf.variant_explode(F.col("fv").outer())).select("toolkit", "action", "_at", F.col("key").alias("attribute"), F.col("value").alias("av"))
    one = inner.filter(F.schema_of_variant("av") == "STRING").select("toolkit", "action", F.concat("_at", F.lit("."), "attribute").alias("_at"), F.lit("attribute").alias("kind"), "attribute", F.try_variant_get("av", "$", "string").alias("text"))
    lists = inner.filter(F.schema_of_variant("av").startswith("ARRAY")).select("toolkit", "action", F.concat("_at", F.lit("."), "attribute").alias("_at"), F.lit("attribute").alias("kind"), "attribute", F.explode(F.from_json(F.to_json("av"), "array<string>")).alias("text"))
    # Deeper objects: whatever strings their JSON holds, as one text.
    deep = inner.filter(F.schema_of_variant("av").startswith("OBJECT")).select("toolkit", "action", F.concat("_at", F.lit("."), "attribute").alias("_at"), F.lit("nested").alias("kind"), "attribute", F.array_join(F.regexp_extract_all(F.to_json("av"), F.lit(r'"((?:[^"\\]|\\.)*)"'), F.lit(1)), " ").alias("text"))
    rest = names.unionByName(flat).unionByName(one).unionByName(lists).unionByName(deep).withColumnRenamed("_at", "place")
    return described.unionByName(whole).unionByName(rest).filter(F.coalesce(F.col("text"), F.lit("")) != "")


#: What an action's name may be found guilty of.
NAME_DETECTORS = tuple(d for d, c in R.CATEGORY_OF.items() if c == "structure") + ("action_like_name",)


def scan_toolkits(toolkits: DataFrame, record: str = "record") -> DataFrame:
    """``scan_tools`` of all tools of JSON records of toolkits, and of the toolkits' own descriptions (action null)."""
    return scan_tools(toolkit_tools(toolkits, record), toolkit_texts(toolkits, record))


def scan_tools(tools: DataFrame, more: DataFrame | None = None) -> DataFrame:
    """toolkit, action, place, detector, severity, rule, excerpt of every text of every tool, and of ``more`` texts.

    An action's name is only held against a narrow list; a destination in a prefilled value is HIGH at least; a field
    whose name asks for silence is a finding by itself.
    """
    keys = ["toolkit", "action", "place", "kind", "attribute"]
    # Payloads fan out unevenly, so texts are dealt anew; behind the exchange the detectors stand in the plan once, not in
    # every branch that texts come from, and both uses below read the same exchange.
    texts = flatten_tools(tools)
    texts = (texts if more is None else texts.unionByName(more)).hint("rebalance")
    found = scan_texts(texts, keys)
    kept = found.filter((F.col("kind") != "name") | F.col("detector").isin(*NAME_DETECTORS))
    destination = F.col("detector").isin(*(d for d, c in R.CATEGORY_OF.items() if c == "destination"))
    lifted = F.when(destination & F.col("attribute").isin(*R.PREFILLED), F.greatest("severity", F.lit(R.HIGH))).otherwise(F.col("severity"))
    silent = texts.filter((F.col("kind") == "field_name") & F.col("text").rlike(R.SILENCING)).select(
        *keys, F.lit("silencing_field").alias("detector"), F.lit(R.MEDIUM).alias("severity"), F.lit("silencing").alias("rule"), F.col("text").alias("excerpt")
    )
    return kept.withColumn("severity", lifted).unionByName(silent).drop("kind", "attribute")


def combined_tools(findings: DataFrame) -> DataFrame:
    """Composites of actions and of toolkits, the latter over all their actions: signals split over fields still meet."""
    return combine.levels(findings, ["place"], ["action"], ["toolkit"])
