"""Texts of findings and errors, for operators and for the SQL they are compared with. `{name}` is a column."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

TEXTS = {
    # gaps in a timeline
    "missing_run_start": "The run has no run.start event.",
    "missing_run_end": "The run has no run.end event so far.",
    "unclosed_tool_call": "Nothing closes the call of tool {tool_key}.",
    "orphan_tool_end": "An end of tool {tool_key} comes without a start before it.",
    "unclosed_approval": "No decision follows the approval request.",
    # issues of a lineage graph
    "dangling_edge_source": "{edge_id}: there is no node {source} for its source",
    "dangling_edge_target": "{edge_id}: there is no node {target} for its target",
    "self_loop": "{edge_id}: leads from {source} to itself",
    "duplicate_edge": "{edge_type}: more than one edge leads from {source} to {target}",
    "missing_run_node": "{node_id}: its run {run_id} is not among the nodes",
    "orphan_node": "{node_id}: no edge begins or ends here",
    "cycle_detected": "{cycle_id}: causes go round in a circle",
    # bundles that cannot be made
    "run_unknown": "No such run: {run_id}",
    "run_of_other_tenant": "Tenant {tenant_id} has no run {run_id}",
    "run_unfinished": "Run {run_id} had not ended when the bundle was made at {made_at}",
    # raw events that cannot be normalized
    "type_missing": "{title}: an event without a type",
    "type_unknown": "{title}: no event type {x_kind}",
    "name_missing": "Span without a name",
    "adapter_missing": 'No format fits data of vendor "{vendor}"',
    "event_invalid": "Not a valid event: {problems}",
    "span_failed": "Span status is ERROR",
    "tool_span_failed": "Status of the tool span is ERROR",
}


def _parts(key: str, values: dict) -> list[str]:
    """Fixed texts at even places, names of columns at odd ones; names in `values` are filled in."""
    text = re.sub(r"\{(\w+)\}", lambda m: values.get(m[1], m[0]), TEXTS[key])
    return re.split(r"\{(\w+)\}", text)


def text(key: str, **values: str) -> Column:
    """The text as a column, of the columns it names and the given values."""
    parts = [F.col(p) if k % 2 else F.lit(p) for k, p in enumerate(_parts(key, values)) if p]
    return parts[0] if len(parts) == 1 else F.concat(*parts)


def sql(key: str, **values: str) -> str:
    """The same as SQL."""
    return " || ".join(p if k % 2 else f"'{p}'" for k, p in enumerate(_parts(key, values)) if p)
