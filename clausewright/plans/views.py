"""Input views in SQL that Spark and DuckDB both run: requirements, components and chunks made from the driver's tables."""

from __future__ import annotations

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

SUBJECTS = ("Account records", "The customer documents", "This transaction log", "It", "Deposit balance data", "A beneficial owner means the person who", "The term ownership category", "Vendor system API")
VERBS = ("must ensure", "shall verify", "should maintain", "must not change", "will review", "validates", "is managing", "confirmed", "cannot check")
OBJECTS = (
    "accuracy of at least #%", "completeness within # days", "appropriate controls", "documentation and audit logs for KYC and CIP compliance",
    "quarterly sampling of tax id and SSN values", "ownership of joint accounts above # percent", "system availability and uptime",
)
TYPES = (
    "data_quality_threshold", "enumeration_constraint", "referential_integrity", "ownership_category", "beneficial_ownership_threshold",
    "documentation_requirement", "update_requirement", "update_timeline", "control_requirement", "risk_statement",
)


def _pick(index: str, values: tuple[str, ...]) -> str:
    return f"CASE {index} " + " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(values)) + " END"


#: (condition, JSON text of one attribute)
_ATTRIBUTES = (
    ("k % 3 <> 0 AND k % 5 = 0", "'\"applies_to\":\"accounts accounts\"'"),
    ("k % 3 <> 0 AND k % 5 <> 0", "'\"applies_to\":\"records\"'"),
    ("k % 2 = 0 AND k % 11 <> 0", "'\"threshold_value\":' || n"),
    ("k % 11 = 0", "'\"threshold_value\":\"' || n || '%\"'"),
    ("k % 4 = 0", "'\"threshold_unit\":\"percent\"'"),
    ("k % 4 = 1", "'\"threshold_unit\":\"days\"'"),
    ("k % 4 = 2", "'\"threshold_unit\":5'"),
    ("k % 5 < 2", "'\"metric\":\"accuracy_rate\"'"),
    ("k % 5 = 2", "'\"metric\":null'"),
    ("k % 7 < 4", "'\"threshold_direction\":\"gte\"'"),
    ("k % 6 = 0", "'\"metric_type\":\"Accuracy\"'"),
    ("k % 6 = 1", "'\"metric_type\":\"speed\"'"),
    ("k % 3 = 0", "'\"field_name\":\"status\"'"),
    ("k % 4 < 2", "'\"permitted_values\":[\"a\",\"b\"]'"),
    ("k % 2 = 1", "'\"source_field\":\"id\"'"),
    ("k % 3 = 1", "'\"target_file\":\"master\"'"),
    ("k % 2 = 0", "'\"ownership_type\":\"joint\"'"),
    ("k % 3 = 0", "'\"required_data_elements\":[]'"),
    ("k % 4 = 0", "'\"requirement\":\"keep\"'"),
    ("k % 5 = 1", "'\"applies_when\":\"on_change\"'"),
    ("k % 3 = 2", "'\"control_type\":\"Preventive / Automated\"'"),
    ("k % 5 = 3", "'\"control_mechanism\":\"audit_trail\"'"),
    ("k % 6 = 2", "'\"timeline\":\"24 hours\"'"),
    ("k % 6 = 3", "'\"timeline_value\":30'"),
    ("k % 6 = 3", "'\"trigger\":\"close\"'"),
    ("k % 4 = 1", "'\"document_type\":\"form\"'"),
    ("k % 4 = 2", "'\"update_frequency\":\"monthly\"'"),
    ("k % 4 = 2", "'\"responsible_party\":\"VP\"'"),
    ("k % 9 = 0", "'\"consequence\":\"fine\"'"),
    ("k % 10 = 0", "'\"data_source\":\"ledger\"'"),
)

REQUIREMENTS = f"""
SELECT k, req_no, doc_id, rule_type, rule_description, attributes, extraction_iteration, source_chunk_id,
  CASE k % 4 WHEN 0 THEN rule_description || ' under FDIC Part 370 recordkeeping' WHEN 1 THEN object || ' required'
    WHEN 2 THEN 'Each bank always keeps ' || (n + 1) || ' records of ' || subject ELSE '' END AS grounded_in
FROM (
  SELECT k, k AS req_no, n, subject, object, 'doc-' || (k % 40) AS doc_id, {_pick("CAST(k % 10 AS INT)", TYPES)} AS rule_type, subject || ' ' || verb || ' ' || object AS rule_description,
    1 + k % 2 AS extraction_iteration, 'c-' || (k % 997) AS source_chunk_id,
    '{{"k":' || k || {" || ".join(f"CASE WHEN {c} THEN ',' || {j} ELSE '' END" for c, j in _ATTRIBUTES)} || '}}' AS attributes
  FROM (
    SELECT k, n, {_pick("CAST(k % 8 AS INT)", SUBJECTS)} AS subject, {_pick("CAST(floor(k / 8) AS INT) % 9", VERBS)} AS verb,
      replace({_pick("CAST(floor(k / 3) AS INT) % 7", OBJECTS)}, '#', CAST(n AS STRING)) AS object
    FROM (SELECT o_orderkey AS k, 1 + o_orderkey % 99 AS n FROM orders) q0
  ) q1
) q2
"""

#: Scored rows without text scoring: confidence and class are simple functions of the key.
SCORED = f"""
SELECT r.*, CAST(50 + (k * 7) % 50 AS DOUBLE) / 100 AS confidence, CAST((k * 3) % 36 AS DOUBLE) / 100 AS grounding_match,
  CASE k % 5 WHEN 0 THEN 'INFERENCE' WHEN 1 THEN 'PARAPHRASE' ELSE 'EXACT' END AS grounding_classification,
  CASE k % 7 WHEN 0 THEN 'rejected' WHEN 1 THEN 'repaired' ELSE 'valid' END AS schema_status,
  CASE WHEN k % 3 = 0 THEN 'core' ELSE '' END AS data_source, k % 13 = 0 AS fragment_warning
FROM ({REQUIREMENTS}) r
"""

PAIRS = """
SELECT conv_id, turn, text AS rule_description, before AS grounded_in
FROM (SELECT conv_id, turn, role, text, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS before, lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS who FROM conversations) t
WHERE role = 'assistant' AND who = 'user'
"""

CHUNKS = """
SELECT source AS doc_id, doc_id AS position, CASE lang WHEN 'en' THEN 'policy' WHEN 'de' THEN 'risk' WHEN 'fr' THEN 'control' END AS record_type,
  CASE WHEN doc_id % 5 <> 0 THEN 'P-' || (doc_id % 30) END AS record_id, CASE doc_id % 3 WHEN 0 THEN 'table' WHEN 1 THEN 'prose' ELSE 'list' END AS chunk_type,
  doc_id % 7 = 0 AS incomplete_record, n_chars AS char_count
FROM documents
"""

#: Components with comma-separated references, some to ids that do not exist.
COMPONENTS = """
SELECT 'P-' || n_nationkey AS component_id, 'policy' AS component_type, 'C-' || (n_nationkey * 3) || ', C-' || (n_nationkey + 2000) AS related_controls,
  'R-' || (n_nationkey % 7) || ';R-900' AS related_risks, CAST(NULL AS STRING) AS related_policies, CAST(NULL AS STRING) AS mitigation_controls, n_nationkey AS ord, 'c-' || (n_nationkey % 9) AS source_chunk_id FROM nation
UNION ALL
SELECT 'R-' || s_suppkey, 'risk', ' C-' || s_suppkey || ',', CAST(NULL AS STRING), 'P-' || (s_suppkey % 40), 'C-' || s_suppkey || ',C-5', s_suppkey, 'c-' || (s_suppkey % 9) FROM supplier
UNION ALL
SELECT 'C-' || p_partkey, 'control', CAST(NULL AS STRING), 'R-' || (p_partkey % 150), 'P-' || (p_partkey % 30) || ';;P-' || (p_partkey % 30), CAST(NULL AS STRING), p_partkey, 'c-' || (p_partkey % 9) FROM part
"""
