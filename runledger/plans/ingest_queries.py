"""Validation, ingest and redaction queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from runledger.operators import ingest as I
from runledger.operators import redact as X
from runledger.operators.validate import PAYLOAD_RULES, validate_events
from runledger.plans.registry import on_events, query
from runledger.plans.testbed import events_table

# ---- redaction ------------------------------------------------------------------------

HITS_SQL = """hits AS (SELECT run_id, id, 'content' AS field_path, 'builtin-email-value' AS rule_id, 'mask' AS action FROM ev WHERE type='prompt.input' AND k%2=0
  UNION ALL SELECT run_id, id, 'documentIds[1]', 'builtin-ssn-value', 'mask' FROM ev WHERE type='context.retrieved'
  UNION ALL SELECT run_id, id, 'content', 'builtin-bearer-token-value', 'mask' FROM ev WHERE type='context.injected'
  UNION ALL SELECT run_id, id, 'inputParameters.api_key', 'builtin-api-key-field-2', 'mask' FROM ev WHERE type='tool.call.start'
  UNION ALL SELECT run_id, id, 'inputParameters.items[0].token', 'builtin-token-field', 'mask' FROM ev WHERE type='tool.call.start')"""


@on_events("flatten_payload", """SELECT run_id, ev.id, substr(t.fullkey, 3) AS path,
   CASE t.type WHEN 'OBJECT' THEN 'object' WHEN 'ARRAY' THEN 'array' WHEN 'VARCHAR' THEN 'string' WHEN 'BOOLEAN' THEN 'boolean' WHEN 'NULL' THEN 'null' ELSE 'number' END AS kind,
   CASE WHEN t.type='VARCHAR' THEN json_extract_string(t.atom, '$') WHEN t.type NOT IN ('OBJECT','ARRAY','NULL') THEN CAST(t.atom AS VARCHAR) END AS text
   FROM ev, json_tree(ev.payload) t WHERE t.fullkey<>'$'""")
def _(ev):
    return X.flatten_payload(ev).select("run_id", "id", "path", "kind", "text")


@on_events("match_path_rules", f"WITH {HITS_SQL} SELECT run_id, id, field_path, rule_id FROM hits WHERE rule_id LIKE '%field%'")
def _(ev):
    rules = X.load_rules()
    ids = F.array(*[F.lit(r["id"]) for r in rules])
    return X.match_path_rules(X.flatten_payload(ev), rules).where("path_hit IS NOT NULL").select(
        "run_id", "id", F.col("path").alias("field_path"), F.element_at(ids, F.col("path_hit") + 1).alias("rule_id"))


@on_events("match_value_rules", f"WITH {HITS_SQL} SELECT run_id, id, field_path, rule_id, action FROM hits WHERE rule_id LIKE '%value'")
def _(ev):
    rules = X.load_rules()
    of = lambda name: F.element_at(F.array(*[F.lit(r[name]) for r in rules]), F.col("value_hit") + 1).alias({"id": "rule_id"}.get(name, name))
    nodes = X.match_value_rules(X.match_path_rules(X.flatten_payload(ev), rules), rules)
    return nodes.where("value_hit IS NOT NULL").select("run_id", "id", F.col("path").alias("field_path"), of("id"), of("action"))


_OTHER_RULES = [X.path_rule("gone", "inputParameters.items"), X.value_rule("hashed", "^plan step", "hash"),
                X.path_rule("any-doc", "*.documentIds"), X.path_rule("keep-out", "documentIds", "remove")]


@on_events("redact_events", """SELECT id, CASE type
   WHEN 'prompt.input' THEN replace(payload, json_extract_string(payload,'$.content'), CASE WHEN k%2=0 THEN '[REDACTED]' ELSE 'sha256:' || sha256(json_extract_string(payload,'$.content')) END)
   WHEN 'context.retrieved' THEN regexp_replace(payload, ',"documentIds":\\[[^\\]]*\\]', '')
   WHEN 'context.injected' THEN replace(payload, json_extract_string(payload,'$.content'), '[REDACTED]')
   WHEN 'tool.call.start' THEN replace(replace(payload, '"api_key":"key"', '"api_key":"[REDACTED]"'), '[{"token":"t"},{"note":"plain"}]', '"[REDACTED]"') ELSE payload END AS payload,
   CASE type WHEN 'context.injected' THEN 'content/builtin-bearer-token-value/mask' WHEN 'prompt.input' THEN CASE WHEN k%2=0 THEN 'content/builtin-email-value/mask' ELSE 'content/hashed/hash' END
   WHEN 'context.retrieved' THEN 'documentIds/keep-out/remove' WHEN 'tool.call.start' THEN 'inputParameters.api_key/builtin-api-key-field-2/mask,inputParameters.items/gone/mask' ELSE '' END AS fields
   FROM ev""")
def _(ev):
    fields = F.transform("redacted_fields", lambda r: F.concat_ws("/", r["field_path"], r["rule_id"], r["action"]))
    return X.redact_events(ev, X.load_rules(_OTHER_RULES)).select("id", "payload", F.array_join(fields, ",").alias("fields"))


@query("redact_text", r"""WITH r AS (SELECT doc_id, text, CASE WHEN regexp_matches(text, '[a-zA-Z0-9._%+\-]+@[a-zA-Z0-9.\-]+\.[a-zA-Z]{2,}') THEN 'builtin-email-value'
    WHEN regexp_matches(text, 'Bearer\s+[A-Za-z0-9\-._~+/]+=*') THEN 'builtin-bearer-token-value' WHEN regexp_matches(text, 'AKIA[0-9A-Z]{16}') THEN 'builtin-aws-key-value'
    WHEN regexp_matches(text, '\b\d{3}-\d{2}-\d{4}\b') THEN 'builtin-ssn-value' END AS rule_id FROM documents)
  SELECT doc_id, rule_id, CASE WHEN rule_id IS NULL THEN text ELSE '[REDACTED]' END AS text FROM r""", raw=True)
def _(spark, sf_dir):
    return X.redact_text(events_table(spark, sf_dir, "documents").select("doc_id", "text"), "text")


@on_events("redaction_audit", f"WITH {HITS_SQL} SELECT run_id, count(*) AS total_redacted_fields, count(DISTINCT id) AS events_redacted FROM hits GROUP BY run_id")
def _(ev):
    return X.redaction_audit(ev)[0]


@on_events("redaction_audit_events", f"WITH {HITS_SQL} SELECT run_id, id, count(*) AS field_count, string_agg(field_path || '=' || rule_id, ',' ORDER BY field_path) AS fields FROM hits GROUP BY run_id, id")
def _(ev):
    entries = F.transform("redacted_fields", lambda r: F.concat_ws("=", r["field_path"], r["rule_id"]))
    return X.redaction_audit(ev)[1].select("run_id", "id", "field_count", F.array_join(F.array_sort(entries), ",").alias("fields"))


_RULES_SQL = ", ".join(f"({n}, '{r['id']}', '{r['action']}')" for n, r in enumerate([*X.BUILT_IN_RULES, *_OTHER_RULES]))


@on_events("load_rules", f"""WITH rules AS (SELECT * FROM (VALUES {_RULES_SQL}) t(rule_order, id, action)), {HITS_SQL}
  SELECT r.rule_order, r.id, r.action, (SELECT count(*) FROM hits h WHERE h.rule_id=r.id) AS hit_count FROM rules r WHERE r.id LIKE 'builtin%'""")
def _(ev):
    """The built-in rules with the number of fields each of them hits."""
    hits = X.redaction_hits(ev).groupBy(F.col("rule_id").alias("id")).agg(F.count("*").alias("hit_count"))
    rules = X.rules_table(ev.sparkSession, X.load_rules()).select("rule_order", "id", "action")
    return rules.join(hits, "id", "left").withColumn("hit_count", F.coalesce("hit_count", F.lit(0).cast("bigint")))


# ---- validation -----------------------------------------------------------------------

# Every field the rules name is broken in some rows: by remainder of k.
_UUID = "'00000000-0000-4000-8000-' || lpad(CAST(eid AS {str}), 12, '0')"
BROKEN = {
    "id": "CASE WHEN k%12=2 THEN 'x' ELSE uid END",
    "runId": "CASE WHEN k%12=7 THEN NULL ELSE uid END",
    "type": "CASE WHEN k%12=1 THEN 'bogus' ELSE type END",
    "timestamp": "CASE WHEN k%12=6 THEN 'yesterday' ELSE '2024-01-01T10:00:00.000Z' END",
    "sequence": "CASE k%12 WHEN 3 THEN '-1' WHEN 8 THEN '1.5' ELSE '7' END",
    "tenantId": "CASE WHEN k%12=9 THEN NULL ELSE tenant_id END",
    "sourceAgent": "CASE WHEN k%12=4 THEN '' ELSE source_agent END",
    "payload": "CASE k%12 WHEN 0 THEN '{}' WHEN 5 THEN 'not json' WHEN 10 THEN '{\"toolName\":1,\"status\":\"odd\",\"tokenCount\":-1,\"fatal\":true,\"documentIds\":[1]}' ELSE payload END",
}


def _wire(ev):
    eid = "CAST(substr(id, 2) AS BIGINT)"
    rows = ev.withColumn("eid", F.expr(eid)).withColumn("k", F.expr("eid * 31 % 101")).withColumn("uid", F.expr(_UUID.format(str="STRING")))
    return rows.selectExpr(
        "eid", *[f"{e} AS {n}" for n, e in BROKEN.items()],
        "uid AS parentEventId", "source_framework AS sourceFramework", "CAST(NULL AS STRING) AS rawMeta", "tags",
        "schema_version AS schemaVersion")


WIRE_SQL = "wi AS (SELECT * EXCLUDE (k), eid*31%101 AS k, " + _UUID.format(str="VARCHAR") + " AS uid FROM ev)"


def _required(event_type: str) -> list[tuple[str, str]]:
    parts = [p.split(" ") for p in PAYLOAD_RULES[event_type].split(", ")]
    return [(n.rstrip("!"), k) for n, k in parts if n.endswith("!")]


def _odd_issues(event_type: str) -> str:
    """Issues of the odd payload of remainder 10."""
    out = []
    for part in PAYLOAD_RULES[event_type].split(", "):
        name, kind = part.split(" ")
        plain = name.rstrip("!")
        code = {"toolName": "invalid_type", "status": "invalid_enum_value", "tokenCount": "too_small",
                "fatal": None, "documentIds": "invalid_type"}.get(plain, "invalid_type" if name.endswith("!") else None)
        if code:
            out.append(f"payload.{plain}:{code}")
    return ",".join(sorted(out))


def _by_type(text_of) -> str:
    return "CASE type " + " ".join(f"WHEN '{t}' THEN '{text_of(t)}'" for t in PAYLOAD_RULES) + " END"


ISSUES_SQL = f"""CASE k%12 WHEN 1 THEN 'type:invalid_union_discriminator' WHEN 2 THEN 'id:invalid_string' WHEN 3 THEN 'sequence:too_small' WHEN 4 THEN 'sourceAgent:too_small'
  WHEN 5 THEN 'payload:invalid_type' WHEN 6 THEN 'timestamp:invalid_string' WHEN 7 THEN 'runId:invalid_type' WHEN 8 THEN 'sequence:invalid_type' WHEN 9 THEN 'tenantId:invalid_type'
  WHEN 0 THEN {_by_type(lambda t: ','.join(sorted(f'payload.{n}:invalid_type' for n, _ in _required(t))))} WHEN 10 THEN {_by_type(_odd_issues)} ELSE '' END"""


def _issue_text():
    return F.array_join(F.array_sort(F.transform("issues", lambda i: F.concat_ws(":", i["path"], i["code"]))), ",")


@on_events("validate_events", f"WITH {WIRE_SQL} SELECT eid, {ISSUES_SQL}='' AS is_valid, {ISSUES_SQL} AS issues FROM wi")
def _(ev):
    return validate_events(_wire(ev)).select("eid", "is_valid", _issue_text().alias("issues"))


# Batches of one event, of four and of 200, each kind with numbers of its own; those of one are accepted if the event is valid.
_SIZE = "CASE WHEN eid%2000<500 THEN 1 WHEN eid%2000<1000 THEN 4 ELSE 200 END"
_SHIFT = "CASE WHEN eid%2000<500 THEN 2000000000 WHEN eid%2000<1000 THEN 0 ELSE 1000000000 END"
_BATCHES = f"""{WIRE_SQL}, ba AS (SELECT *, eid//{_SIZE} + {_SHIFT} AS batch_id, {ISSUES_SQL} AS issues FROM wi),
  ve AS (SELECT batch_id, count(*) AS n, count(*) FILTER (WHERE issues<>'') AS bad FROM ba GROUP BY batch_id)"""


def _batched(ev):
    return _wire(ev).withColumn("batch_id", F.expr(f"eid div ({_SIZE}) + {_SHIFT}")).withColumn("batch_index", F.col("eid"))


@on_events("split_batch_accepted", f"WITH {_BATCHES} SELECT eid, batch_id FROM ba JOIN ve USING (batch_id) WHERE n<=100 AND bad=0")
def _(ev):
    return I.split_batch(_batched(ev))[0].select("eid", "batch_id")


@on_events("split_batch_refused", f"""WITH {_BATCHES} SELECT batch_id, eid AS batch_index, CASE WHEN n>100 THEN 'BATCH_TOO_LARGE' ELSE 'INVALID_BATCH_EVENTS' END AS code, bad AS failed_count, issues
  FROM ba JOIN ve USING (batch_id) WHERE n>100 OR bad>0""")
def _(ev):
    return I.split_batch(_batched(ev))[1].select("batch_id", "batch_index", "code", "failed_count", _issue_text().alias("issues"))


# ---- ingest ----------------------------------------------------------------------------

@on_events("events_to_rows", """SELECT id, run_id, type, sequence, parent_event_id, tenant_id, source_agent, source_framework, payload, schema_version, "timestamp",
   array_to_string(tags, ',') AS tags FROM ev""")
def _(ev):
    return I.events_to_rows(I.rows_to_events(ev)).drop("received_at", "raw_meta").withColumn("tags", F.array_join("tags", ","))


@on_events("assign_ingestion_order", "SELECT id, row_number() OVER (ORDER BY received_at, id) + 500 AS ingestion_order FROM ev")
def _(ev):
    return I.assign_ingestion_order(ev.drop("ingestion_order", "slice"), start=500).select("id", "ingestion_order")


@on_events("dedupe_events", """WITH nw AS (SELECT id, ingestion_order FROM ev UNION ALL SELECT id, ingestion_order+1 FROM ev WHERE type='run.error' UNION ALL SELECT 'e0', ingestion_order+2 FROM ev WHERE type='custom'),
   ft AS (SELECT id, min(ingestion_order) AS f FROM nw GROUP BY id)
  SELECT id, ingestion_order, CASE WHEN ingestion_order=f AND id NOT IN (SELECT id FROM ev WHERE type='annotation') THEN 'created' ELSE 'duplicate' END AS status FROM nw JOIN ft USING (id)""")
def _(ev):
    rows = ev.select("id", "ingestion_order")
    again = ev.where("type = 'run.error'").select("id", F.col("ingestion_order") + 1)
    hot = ev.where("type = 'custom'").select(F.lit("e0"), F.col("ingestion_order") + 2)
    return I.dedupe_events(rows.union(again).union(hot), ev.where("type = 'annotation'"))
