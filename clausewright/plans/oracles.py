"""DuckDB SQL that says the same as the queries, written from the fixed tables and not from the Spark code."""

from __future__ import annotations

from .. import dims
from . import views

REQ = f"WITH r AS ({views.REQUIREMENTS}) "
SCORED = f"WITH r AS ({views.SCORED}) "
PAIRS = f"WITH p AS ({views.PAIRS}) "
CHUNKS = f"c AS ({views.CHUNKS}) "


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def lst(words) -> str:
    return "[" + ", ".join(q(w) for w in words) + "]::VARCHAR[]"


def any_in(col: str, words) -> str:
    return "(" + " OR ".join(f"contains({col}, {q(w)})" for w in words) + ")"


def starts(col: str, words) -> str:
    return "(" + " OR ".join(f"starts_with({col}, {q(w)})" for w in words) + ")"


def count_in(col: str, words) -> str:
    return "(" + " + ".join(f"contains({col}, {q(w)})::INT" for w in words) + ")"


def first(col: str, table) -> str:
    whens = " ".join(f"WHEN {any_in(col, w)} THEN {q(v)}" for w, v in table if w)
    return f"CASE {whens} ELSE {q(table[-1][1])} END"


def by(col: str, table, default: str = "NULL", make=q) -> str:
    return f"CASE {col} " + " ".join(f"WHEN {q(k)} THEN {make(v)}" for k, v in table.items()) + f" ELSE {default} END"


def dec(x: str, n: int) -> str:
    return f"round(CAST({x} AS DECIMAL(20,10)), {n})"


def half_up(x: str, n: int) -> str:
    return f"{dec(x, n)}::DOUBLE"


def fixed(x: str, n: int) -> str:
    return f"CAST({dec(x, n)} AS DECIMAL(20,{n}))::VARCHAR"


def some(*tests: str) -> str:
    return f"list_filter([{', '.join(tests)}], lambda x: x IS NOT NULL)"


# -- attributes


def jt(f: str, a: str = "attributes") -> str:
    return f"json_type({a}, '$.{f}')"


def js(f: str, a: str = "attributes") -> str:
    return f"json_extract_string({a}, '$.{f}')"


def has(f: str) -> str:
    return f"coalesce({jt(f)} <> 'NULL', FALSE)"


NUMERIC = "('BIGINT', 'UBIGINT', 'DOUBLE', 'HUGEINT')"


def truthy(f: str) -> str:
    return f"({has(f)} AND CASE WHEN {jt(f)} = 'VARCHAR' THEN {js(f)} <> '' WHEN {jt(f)} IN {NUMERIC} THEN try_cast({js(f)} AS DOUBLE) <> 0 ELSE {js(f)} NOT IN ('false', '[]', '{{}}') END)"


def right(f: str, code: str) -> str:
    kinds = {"s": "('VARCHAR')", "n": NUMERIC[:-1] + ", 'BOOLEAN')", "l": "('ARRAY')", "b": "('BOOLEAN')"}[code]
    return f"coalesce({jt(f)} IN {kinds}, FALSE)"


def missing() -> str:
    out = "CASE rule_type "
    for name, (required, _) in dims.ATTRIBUTES.items():
        tests = [f"CASE WHEN {jt(f)} IS NULL THEN {q(f)} WHEN NOT {right(f, c)} THEN {q(f + ' (wrong type)')} END" for f, c in required.items()]
        out += f"WHEN {q(name)} THEN {some(*tests)} "
    return out + "ELSE ['Unknown rule_type: ' || rule_type] END"


def canonical_there(f: str) -> str:
    older = "FALSE"
    for x in reversed(dims.LEGACY.get(f, ())):
        older = f"CASE WHEN {jt(x)} IS NOT NULL THEN {has(x)} ELSE {older} END"
    return f"CASE WHEN {has(f)} THEN TRUE ELSE {older} END"


def canonical_text(f: str) -> str:
    older = "NULL"
    for x in reversed(dims.LEGACY.get(f, ())):
        older = f"CASE WHEN {jt(x)} IS NOT NULL THEN CASE WHEN {jt(x)} = 'VARCHAR' THEN {js(x)} END ELSE {older} END"
    return f"(CASE WHEN {has(f)} THEN CASE WHEN {jt(f)} = 'VARCHAR' THEN {js(f)} END ELSE {older} END)"


def canonical_errors() -> str:
    return "CASE rule_type " + " ".join(f"WHEN {q(n)} THEN {some(*[f'CASE WHEN NOT ({canonical_there(f)}) THEN {q(f)} END' for f in req])}" for n, (req, _) in dims.CANONICAL.items()) + " END"


def canonical_warnings() -> str:
    out = "CASE rule_type "
    for name, lists in dims.ENUMS.items():
        tests = [f"CASE WHEN NOT list_contains({lst(allowed)}, lower({canonical_text(f)})) THEN {q(f + ': ')} || '''' || {canonical_text(f)} || ''' not in enum' END" for f, allowed in lists.items()]
        out += f"WHEN {q(name)} THEN {some(*tests)} "
    return out + "ELSE []::VARCHAR[] END"


def completeness(weight: str) -> str:
    out = "CASE rule_type "
    for name, (required, _) in dims.ATTRIBUTES.items():
        n = " + ".join(f"{right(f, c)}::INT" for f, c in required.items())
        out += f"WHEN {q(name)} THEN {half_up(f'{weight} * ({n}) / {len(required)}', 3)} "
    return out + "ELSE 0.0 END"


def compliance(full: float, part: float) -> str:
    return f"CASE len({canonical_errors()}) WHEN 0 THEN {full} WHEN 1 THEN {part} ELSE 0.0 END"


NUMBER = r"\d+\.?\d*\s*%?"
QUANT = (
    f"(CASE WHEN {right('threshold_value', 'n')} OR {right('threshold', 'n')} OR regexp_matches(lower(rule_description), '{NUMBER}') THEN 10 ELSE 0 END"
    f" + CASE WHEN {truthy('threshold_unit')} OR {truthy('unit')} OR {truthy('threshold_direction')} OR {any_in('lower(rule_description)', dims.UNIT_KEYWORDS)} THEN 5 ELSE 0 END"
    f" + CASE WHEN {truthy('exception_threshold')} OR {truthy('consequence')} OR {truthy('escalation')} THEN 5 ELSE 0 END) / 100.0::DOUBLE"
)


def coherence() -> str:
    d, g = "lower(rule_description)", "lower(grounded_in)"
    clash = " OR ".join(f"(contains({x}, {q(no)}) AND contains({y}, {q(yes)}) AND NOT contains({y}, {q(no)}))" for no, yes in dims.NEGATIONS for x, y in ((d, g), (g, d)))
    nd, ng = (f"regexp_extract_all({x}, '{NUMBER}')" for x in (d, g))
    return f"CASE WHEN {clash} THEN 0.0 WHEN len({nd}) > 0 AND len({ng}) > 0 AND NOT list_has_any({nd}, {ng}) THEN 0.05 ELSE 0.1 END::DOUBLE"


def domain(full: float, part: float) -> str:
    n = count_in("lower(rule_description || ' ' || grounded_in)", dims.DOMAIN_KEYWORDS)
    return f"CASE WHEN {n} >= 3 THEN {full} WHEN {n} >= 1 THEN {part} ELSE 0.0 END::DOUBLE"


def tokens(x: str) -> str:
    return rf"list_distinct(list_filter(regexp_extract_all(lower({x}), '[\p{{L}}\p{{M}}\p{{N}}_]+'), lambda w: regexp_full_match(w, '[a-z0-9]+')))"


def content(x: str) -> str:
    return rf"list_filter(list_distinct(regexp_extract_all(lower({x}), '[\p{{L}}\p{{M}}\p{{N}}_]+')), lambda w: NOT list_contains({lst(dims.STOP_WORDS)}, w))"


BLANK = "list_distinct(list_filter(regexp_split_to_array(lower(rule_description), '\\s+'), lambda w: w <> ''))"


def evidence(source: str, keys: str) -> str:
    """CTEs tk (token sets), ph (maximal phrases) and ev (all evidence) over table ``source``."""
    return f"""
tk AS (SELECT {source}.*, {tokens('rule_description')} AS dt, {tokens('grounded_in')} AS gt FROM {source}),
wd AS (SELECT {keys}, lower(rule_description) AS low, list_filter(regexp_split_to_array(lower(grounded_in), '\\s+'), lambda w: w <> '') AS ws FROM {source}),
st AS (SELECT {keys}, low, ws, unnest(range(1, len(ws) + 1)) AS i FROM wd),
cd AS (SELECT {keys}, low, array_to_string(ws[i:i + n - 1], ' ') AS p FROM st, (SELECT unnest(range(3, 8)) AS n) WHERE i + n - 1 <= len(ws)),
fd AS (SELECT DISTINCT {keys}, p FROM cd WHERE contains(low, p)),
mx AS (SELECT a.* FROM fd a WHERE NOT EXISTS (SELECT 1 FROM fd b WHERE {' AND '.join(f'a.{k.strip()} = b.{k.strip()}' for k in keys.split(','))} AND a.p <> b.p AND contains(b.p, a.p))),
ph AS (SELECT {keys}, count(*)::INT AS n, string_agg(p, '|' ORDER BY p) AS ps FROM mx GROUP BY ALL),
e0 AS (SELECT tk.*, len(dt) = 0 OR len(gt) = 0 AS e, coalesce(ph.n, 0) AS pn, ps, len(list_intersect(dt, gt)) AS inter FROM tk LEFT JOIN ph USING ({keys})),
ev AS (SELECT *, CASE WHEN e THEN 0 ELSE pn END AS phrase_count, CASE WHEN e THEN '' ELSE coalesce(ps, '') END AS phrases,
  CASE WHEN e THEN 0 ELSE CAST(inter::DOUBLE / (len(dt) + len(gt) - inter) AS DECIMAL(20,10)) END::DECIMAL(20,10) AS j FROM e0)
"""


J = "round(j, 3)::DOUBLE"


def match(jaccard: str, stretch: str, first_: str, each: str, most: str) -> str:
    return f"(CASE WHEN e THEN 0.0 ELSE {half_up(f'{jaccard} * least(1::DECIMAL(20,10), CAST(j * {stretch} AS DECIMAL(20,10))) + CASE WHEN phrase_count > 0 THEN least({most}, {first_} + {each} * phrase_count) ELSE 0 END', 3)} END)"


LIVE = match("0.22", "1.5", "0.065", "0.0325", "0.13")
OLDER = match("0.15", "1", "0", "0.05", "0.15")


def klass(m: str, j: str, n: str) -> str:
    return f"CASE WHEN {m} >= 0.15 OR {j} >= 0.25 OR {n} >= 2 THEN 'EXACT' WHEN {m} >= 0.08 OR {j} >= 0.15 OR {n} >= 1 THEN 'PARAPHRASE' ELSE 'INFERENCE' END"


RATIONALE = f"""
CASE WHEN m >= 0.25 THEN 'Strong grounding (' || {fixed('jr * 100', 0)} || '% word overlap, ' || phrase_count || ' phrase matches)'
  WHEN m >= 0.15 THEN 'Moderate grounding (' || {fixed('jr * 100', 0)} || '% word overlap)' ELSE 'Weak grounding (' || {fixed('jr * 100', 0)} || '% word overlap)' END
|| CASE WHEN f1 >= 0.18 THEN '; attributes complete' WHEN f1 >= 0.10 THEN '; some attributes missing' ELSE '; many attributes missing' END
|| CASE WHEN f2 >= 0.15 THEN '; well-quantified' WHEN f2 >= 0.10 THEN '; partially quantified' WHEN f2 > 0 THEN '; minimal quantification' ELSE '' END
|| CASE WHEN f3 >= 0.15 THEN '; schema-compliant' ELSE '; schema violations' END || CASE WHEN f4 < 0.10 THEN '; potential contradictions' ELSE '' END
|| CASE WHEN f5 >= 0.05 THEN '; regulatory keywords present' ELSE '' END || '.' || CASE WHEN review THEN ' MANUAL REVIEW REQUIRED: INFERENCE with jaccard < 0.30.' ELSE '' END
"""
SCORE = f"""
{REQ}, {evidence('r', 'k')},
f0 AS (SELECT *, {LIVE} AS m, {J} AS jr, {completeness('0.25')} AS f1, {QUANT} AS f2, {compliance(0.12, 0.06)} AS f3, {coherence()} AS f4, {domain(0.03, 0.02)} AS f5 FROM ev),
f1 AS (SELECT *, (m::DECIMAL(10,3) + f1::DECIMAL(10,3) + f2::DECIMAL(10,3) + f3::DECIMAL(10,3) + f4::DECIMAL(10,3) + f5::DECIMAL(10,3))::DOUBLE AS raw, {klass('m', 'jr', 'phrase_count')} AS c FROM f0),
f2 AS (SELECT *, c = 'INFERENCE' AND jr < 0.20 AS review FROM f1)
SELECT k, m AS grounding_match, raw AS raw_total, {half_up('least(0.99, greatest(0.5, raw))', 2)} AS confidence, c AS grounding_classification, review AS requires_review, {RATIONALE} AS rationale FROM f2
"""

# -- repair
_low = "lower(rule_description)"
REPAIRS = {
    "applies_to": dims.APPLIES_TO, "threshold_direction": dims.DIRECTION, "threshold_unit": dims.UNIT, "metric": dims.METRIC,
    "ownership_type": dims.OWNERSHIP, "applies_when": dims.APPLIES_WHEN, "control_mechanism": dims.MECHANISM, "control_type": dims.CONTROL_TYPE,
}


def first_number(x: str) -> str:
    return f"regexp_replace(nullif(regexp_extract(coalesce({x}, ''), '\\d+\\.?\\d*'), ''), '\\.$', '.0')"


def source() -> str:
    known = ", ".join(f"CASE WHEN contains({_low}, {q(p)}) THEN {q(s)} END" for p, s in dims.SOURCE_PATTERNS.items())
    return f"coalesce({known}, {by('rule_type', dims.TYPE_SOURCE)})"


def ordered_distinct(x: str) -> str:
    return f"list_filter({x}, lambda v, i: list_position({x}, v) = i)"


FIELDS = ordered_distinct(some(*[f"CASE WHEN contains({_low}, {q(p)}) THEN {q(f)} END" for p, f in dims.FIELD_PATTERNS.items()]))


def repaired(f: str) -> str:
    fix = first(_low, REPAIRS[f]) if f in REPAIRS else {"requirement": "rule_description", "threshold_value": f"coalesce({first_number(js('timeline'))}, {first_number(_low)})"}[f]
    return f"CASE WHEN list_contains(miss, {q(f)}) THEN {fix} ELSE {js(f)} END"


def still() -> str:
    """What stays missing: wrong types, and fields without a rule."""
    known = [*REPAIRS, "requirement", "required_data_elements"]
    number = f"coalesce({first_number(js('timeline'))}, {first_number(_low)}) IS NULL"
    return f"list_filter(miss, lambda f: NOT list_contains({lst(known)}, f) AND (f <> 'threshold_value' OR {number}))"


_names = ("applies_to", "threshold_direction", "threshold_unit", "metric", "requirement", "ownership_type", "applies_when", "control_type", "threshold_value")
REPAIR = f"""
{REQ}, v AS (SELECT *, {missing()} AS miss FROM r), w AS (SELECT *, {still()} AS left_ FROM v)
SELECT k, CASE WHEN len(miss) = 0 THEN 'valid' WHEN len(left_) = 0 THEN 'repaired' ELSE 'rejected' END AS schema_status, array_to_string(left_, ', ') AS missing,
  {', '.join(f'{repaired(f)} AS {f}' for f in _names)}, CASE WHEN len(miss) > 0 AND NOT {has('data_source')} THEN coalesce({source()}, {js('data_source')}) ELSE {js('data_source')} END AS data_source
FROM w
"""

# -- verbs and control metadata
_desc = "lower(rule_description)"
_ctx = " UNION ALL ".join(f"SELECT {i} AS i, {q(n)} AS name, {lst(w)} AS words" for i, (n, w) in enumerate(dims.VERB_CONTEXTS.items()))
CONTEXT = f"""
{REQ}, x AS ({_ctx}), s AS (SELECT k, i, name, len(list_filter(words, lambda w: contains({_desc}, w))) AS n FROM r, x)
SELECT k, CASE WHEN max(n) = 0 THEN 'default' ELSE arg_max(name, n * 100 - i) END AS context FROM s GROUP BY k
"""
_first_word = lambda words, default: "coalesce(" + ", ".join(f"CASE WHEN contains({_desc}, {q(w)}) THEN {q(w)} END" for w in words) + f", {q(default)})"
_share = r"regexp_extract(rule_description, '(\d+\.?\d*)\s*%', 1)"
APPLIES = f"CASE WHEN {jt('applies_to')} IS NOT NULL THEN coalesce({js('applies_to')}, 'None') ELSE 'relevant records' END"
_doubled = r"accounts accounts"  # the only doubled words of the view
CONTROL = "CASE " + " ".join(f"WHEN {any_in(_desc, w)} THEN {q(n)}" for w, n in dims.CONTROL_WORDS) + f" ELSE {by('rule_type', dims.TYPE_CONTROL, q('general'))} END"
MEASURE = f"CASE WHEN {truthy('threshold_value')} OR {truthy('metric')} THEN 'quantitative' WHEN {truthy('timeline_value')} THEN 'timeline' WHEN rule_type IN ('documentation_requirement', 'ownership_category') THEN 'qualitative' ELSE 'quantitative' END"


def one_of(*names: str) -> str:
    out = "''"
    for f in reversed(names):
        out = f"CASE WHEN {jt(f)} IS NOT NULL THEN coalesce({js(f)}, 'None') ELSE {out} END"
    return out


_exact = " ".join(f"WHEN ct = {q(c)} AND mt = {q(m)} THEN {q(t)}" for (c, m), t in dims.TEST_PROCEDURES.items())
_close = " ".join(f"WHEN ct = {q(c)} THEN {q(next(t for (x, _), t in dims.TEST_PROCEDURES.items() if x == c))}" for c in dict.fromkeys(c for c, _ in dims.TEST_PROCEDURES))
PROCEDURES = f"""
{REQ}, x AS (SELECT *, {CONTROL} AS ct, {MEASURE} AS mt FROM r)
SELECT k, sha256(replace(replace(replace(CASE {_exact} {_close} ELSE {q(dims.DEFAULT_PROCEDURE)} END, '{{applies_to}}', {APPLIES}), '{{threshold}}', {one_of('threshold_value', 'timeline_value')}), '{{unit}}', {one_of('threshold_unit', 'timeline_unit')})) AS sha FROM x
"""
_risk = f"list_concat({by('rule_type', dims.RISKS, lst([dims.REGULATORY]), lst)}, {some(f'CASE WHEN {any_in(_desc, dims.AVAILABILITY_WORDS)} THEN {q(dims.AVAILABILITY)} END', f'CASE WHEN {any_in(_desc, dims.VENDOR_WORDS)} THEN {q(dims.VENDOR)} END')})"
_auto, _manual = count_in(_desc, dims.AUTO_WORDS), count_in(_desc, dims.MANUAL_WORDS)
AUTOMATION = f"CASE WHEN {_auto} > {_manual} THEN 'automated' WHEN {_manual} > {_auto} THEN 'manual' ELSE 'hybrid' END"
_hit = {s: "coalesce(" + ", ".join(f"CASE WHEN contains({_desc}, {q(w)}) THEN {q(w)} END" for w in words) + ", NULL)" for s, words in dims.SYSTEMS.items()}
_sys = some(*[f"CASE WHEN {h} IS NOT NULL THEN {q(s)} END" for s, h in _hit.items()])
_words = some(*_hit.values())
_num = lambda f, d: f"coalesce(CASE WHEN {jt(f)} IN {NUMERIC} THEN {js(f)}::DOUBLE WHEN {jt(f)} = 'VARCHAR' THEN try_cast(trim(replace({js(f)}, '%', '')) AS DOUBLE) END, {d})"
_unit = f"CASE WHEN {jt('threshold_unit')} IS NOT NULL THEN {js('threshold_unit')} ELSE 'percent' END"
_tier = lambda c: "replace(replace(replace(" + q(c) + ", '{a}', (t - 1)::VARCHAR), '{b}', (t - 0.5)::VARCHAR), '{c}', t::VARCHAR)"
TIERS = f"""
{REQ}, x AS (SELECT k, rule_type, {_num('threshold_value', 99.0)} AS t, {_unit} AS u, floor({_num('timeline_value', 30.0)})::BIGINT AS n FROM r)
{' UNION ALL '.join(f"SELECT k, {q(n)} AS tier, {_tier(c)} AS condition, {q(s)} AS sla_remediation FROM x WHERE rule_type = 'data_quality_threshold' AND u IN ('percent', '%')" for n, c, _, s in dims.TIERS)}
UNION ALL SELECT k, 'breach', 'Update not completed within ' || n || ' ' || u, (n // 2) || ' ' || u FROM x WHERE rule_type = 'update_timeline'
"""

# -- evaluation
TESTABILITY = some(
    f"CASE WHEN rule_type = 'data_quality_threshold' AND NOT ({truthy('threshold_value')} OR {truthy('metric_type')} OR {truthy('metric')}) THEN 'missing metric definition' END",
    f"CASE WHEN rule_type = 'data_quality_threshold' AND NOT {truthy('threshold_value')} THEN 'missing threshold_value (cannot test)' END",
    f"CASE WHEN rule_type = 'documentation_requirement' AND NOT ({truthy('document_type')} OR {truthy('documentation_type')}) THEN 'missing documentation_type' END",
    f"CASE WHEN rule_type = 'documentation_requirement' AND NOT ({truthy('required_by')} OR {truthy('applies_when')}) THEN 'missing trigger condition (applies_when)' END",
    f"CASE WHEN rule_type = 'update_timeline' AND NOT ({truthy('timeline_value')} OR {truthy('threshold_value')}) THEN 'missing timeline value' END",
    f"CASE WHEN rule_type = 'update_requirement' AND NOT ({truthy('update_frequency')} OR {truthy('applies_when')}) THEN 'missing update frequency' END",
    f"CASE WHEN rule_type = 'beneficial_ownership_threshold' AND NOT {truthy('threshold_value')} THEN 'missing ownership threshold value' END",
    f"CASE WHEN starts_with({_desc}, 'a ') AND contains({_desc}, ' means ') THEN 'appears to be a definition, not an obligation' END",
    f"CASE WHEN starts_with({_desc}, 'the term ') THEN 'appears to be a definition, not an obligation' END",
    f"CASE WHEN {any_in(_desc, dims.VAGUE_WORDS)} AND NOT regexp_matches({_desc}, '\\d') THEN 'vague language without quantification' END",
)
_c2, _m2 = fixed("confidence", 2), fixed("grounding_match", 2)
GROUNDING = some(
    "CASE WHEN trim(grounded_in) = '' THEN 'missing grounded_in citation' END",
    "CASE WHEN grounding_classification = 'INFERENCE' THEN 'grounding classified as INFERENCE (weak source match)' END",
    f"CASE WHEN grounding_match < 0.10 THEN 'very low grounding match (' || {_m2} || ')' END",
    f"CASE WHEN extraction_iteration = 1 AND confidence < 0.70 THEN 'low confidence (' || {_c2} || ') on first iteration' END",
    f"CASE WHEN extraction_iteration >= 2 AND confidence < 0.75 THEN 'low confidence (' || {_c2} || ') on retry iteration ' || extraction_iteration END",
)
_tiers = {1: (0.60, 0.70, 0.80), 2: (0.70, 0.75, 0.85)}
_RISK = "CASE " + " ".join(f"WHEN extraction_iteration = {i} AND confidence < {c} THEN {q(n)}" for i, cs in _tiers.items() for c, n in zip(cs, ("critical", "high", "medium"))) + " ELSE 'low' END"
_FLAG = f"""CASE WHEN extraction_iteration = 1 AND confidence < 0.60 THEN 'Confidence ' || {_c2} || ' critically low on first pass'
 WHEN extraction_iteration = 1 AND confidence < 0.70 THEN 'Confidence ' || {_c2} || ' below safe threshold on first pass'
 WHEN extraction_iteration = 1 AND confidence < 0.80 THEN 'Moderate inference (' || {_c2} || '); recommend human review'
 WHEN extraction_iteration = 2 AND confidence < 0.70 THEN 'Retry pass: confidence ' || {_c2} || ' critically low'
 WHEN extraction_iteration = 2 AND confidence < 0.75 THEN 'Retry pass: confidence ' || {_c2} || ' still below retry threshold (0.75)'
 WHEN extraction_iteration = 2 AND confidence < 0.85 THEN 'Retry pass: moderate inference (' || {_c2} || '); borderline' END"""
FLAGS = f"""h0 AS (SELECT *, {some(_FLAG, "CASE WHEN grounding_classification = 'INFERENCE' THEN 'Grounding classified as INFERENCE (potential fabrication)' END")} AS fl, {_RISK} AS r0 FROM r),
h AS (SELECT *, CASE WHEN r0 = 'low' AND grounding_classification = 'INFERENCE' THEN 'medium' ELSE r0 END AS risk FROM h0 WHERE len(fl) > 0)"""
BUCKET = "CASE " + " ".join(f"WHEN confidence >= {x} THEN {q(n)}" if x is not None else f"ELSE {q(n)}" for n, x in dims.CONFIDENCE_BUCKETS) + " END"
COUNTS = """
WITH c AS (SELECT c_custkey, (c_custkey % 101) / 100.0::DOUBLE AS cov, c_custkey % 8 AS te, c_custkey % 6 AS gr, c_custkey % 9 AS sc, c_custkey % 5 AS sh, (c_custkey % 37) / 36.0::DOUBLE AS de,
  c_custkey % 10 AS hf, CASE WHEN c_custkey % 4 = 0 THEN c_custkey % 3 ELSE 0 END AS hc, c_custkey % 6 AS hh, c_custkey % 2 + 1 AS it, (50 + c_custkey % 50) / 100.0::DOUBLE AS av, c_custkey % 21 AS n FROM customer)
"""
CLASSES = f"""
{COUNTS}, a AS (SELECT *, cov < 0.60 AS a1, te > 5 AS a2, gr > 3 AS a3, sh > 3 AS a4, de < 0.70 AS a5, hc > 0 OR hh > 3 AS a6 FROM c),
b AS (SELECT *, a1::INT + a2::INT + a3::INT + a4::INT + a5::INT + a6::INT AS k FROM a)
SELECT c_custkey, CASE WHEN k = 0 THEN 'none' WHEN k > 1 THEN 'multi' WHEN a1 THEN 'coverage' WHEN a2 THEN 'testability' WHEN a3 THEN 'grounding' WHEN a4 THEN 'schema' WHEN a5 THEN 'dedup' ELSE 'hallucination' END AS failure_type,
  CASE WHEN hc > 0 THEN 'critical' WHEN a1 OR a2 OR hh > 3 OR k > 1 THEN 'high' WHEN a3 OR a4 OR a5 THEN 'medium' ELSE 'low' END AS failure_severity,
  CASE WHEN a6 THEN FALSE WHEN a5 THEN it < 2 WHEN a2 THEN FALSE WHEN a1 THEN it < 2 ELSE FALSE END AS is_retryable FROM b
"""
QUALITY = f"""
{COUNTS} SELECT c_custkey, CASE WHEN n = 0 THEN 0.0 ELSE round(greatest(0.0, least(1.0, 0.25::DOUBLE * cov + 0.25::DOUBLE * av + 0.15::DOUBLE * de + 0.15::DOUBLE * (1 - least(1.0, te / n)) + 0.10::DOUBLE * (1 - least(1.0, gr / n)) + 0.10::DOUBLE * (1 - least(1.0, sc / n)) - least(0.3, hf * 0.05))), 6) END::DOUBLE AS score FROM c
"""
SUGGESTIONS = f"""
{COUNTS} SELECT c_custkey, coalesce(nullif(array_to_string({some(
    f"CASE WHEN cov < 0.60 THEN 'Coverage ratio ' || {fixed('cov * 100', 1)} || '% too low. Retry with broader rule extraction (relax confidence threshold or expand rule_type scope).' WHEN cov < 0.80 THEN 'Coverage ratio ' || {fixed('cov * 100', 1)} || '% below target. Review chunks with zero extractions.' END",
    "CASE WHEN te > 0 THEN 'Testability issues found (' || te || '). Review rule descriptions; ensure each has measurable pass/fail condition. Require threshold_value for data_quality rules.' END",
    "CASE WHEN gr > 0 THEN 'Grounding issues (' || gr || '). Verify grounded_in cites source text; ensure confidence scores reflect actual inference level.' END",
    "CASE WHEN sc > 0 AND c_custkey % 2 = 0 THEN 'Schema compliance issues (' || sc || '). Missing fields: applies_to, scope. Update prompt to require these fields.' END",
    f"CASE WHEN de < 0.70 THEN 'Deduplication ratio ' || {fixed('de * 100', 1)} || '% suggests content repetition. Review potential duplicates; merge or remove lower-confidence variants.' END",
    "CASE WHEN hc > 0 THEN 'CRITICAL: ' || hc || ' requirements flagged for potential hallucination. Manual review required before proceeding.' WHEN hf > 0 THEN 'Hallucination risk detected (' || hf || ' flags). Review low-confidence requirements; consider stricter extraction.' END",
)}, ' / '), ''), 'All checks passed. Requirements ready for downstream processing.') AS suggestions FROM c
"""
TOTALS = f"""{SCORED}, c AS (SELECT doc_id, count(*) AS total, count(*) FILTER (schema_status = 'valid') AS valid, count(*) FILTER (grounding_classification = 'EXACT') AS exact, count(*) FILTER (data_source <> '') AS sourced,
  count(*) FILTER (schema_status IN ('rejected', 'repaired')) AS issues, count(*) FILTER (fragment_warning) AS fragments, count(*) FILTER (confidence >= 0.85) AS high, count(*) FILTER (confidence >= 0.65 AND confidence < 0.85) AS medium,
  count(*) FILTER (confidence < 0.65) AS low, round(avg(confidence), 3) AS average_confidence FROM r GROUP BY 1) """
_p = lambda x: f"({x} * 100 / total)"
RISKS = " UNION ALL ".join(
    f"SELECT doc_id, {sev} AS severity, {q(issue)} AS issue, {detail} AS detail, {n} AS n FROM c WHERE {test}"
    for test, sev, issue, detail, n in (
        (f"{_p('sourced')} < 80", "'medium'", "Data source coverage below 80%", f"{fixed('100 - ' + _p('sourced'), 1)} || '% of requirements lack data_source mapping'", "total - sourced"),
        ("issues > 0", "CASE WHEN issues < total * 0.1 THEN 'low' ELSE 'medium' END", "Schema compliance issues detected", "issues || ' requirements have missing or invalid fields'", "issues"),
        ("fragments > 0", "'low'", "Fragment context warnings", "fragments || ' requirements start with demonstrative pronouns (missing context)'", "fragments"),
        ("low > 0", "'low'", "Low confidence requirements", "low || ' requirements below 0.65 confidence threshold'", "low"),
    )
)
RECOMMEND = some(
    f"CASE WHEN {_p('sourced')} < 80 THEN 'Improve data source mapping: ' || {fixed('100 - ' + _p('sourced'), 0)} || '% of requirements need asset linkage. Review chunking strategy to capture table headers and section context.' END",
    "CASE WHEN low > 0 THEN 'Manual review recommended for ' || low || ' low-confidence requirements. These may benefit from additional context or prompt refinement.' END",
    "CASE WHEN issues > total * 0.1 THEN 'Address schema compliance: ' || issues || ' requirements have issues. Review schema_repair logic or prompt guidance for missing fields.' END",
    "CASE WHEN fragments > 0 THEN 'Validate ' || fragments || ' fragment warnings. These requirements may have incomplete context due to chunking boundaries.' END",
)
_dup = f"""t AS (SELECT k, doc_id, rule_type, {BLANK} AS w FROM r),
d AS (SELECT a.doc_id, a.k AS a, b.k AS b, len(list_intersect(a.w, b.w)) AS s, len(a.w) + len(b.w) - len(list_intersect(a.w, b.w)) AS u FROM t a JOIN t b ON a.doc_id = b.doc_id AND a.rule_type = b.rule_type AND a.k < b.k WHERE len(a.w) > 0 AND len(b.w) > 0),
pr AS (SELECT doc_id, a, b, {half_up('s / u', 3)} AS similarity FROM d WHERE s >= 0.75 * u)"""
LEADERS = f"""WITH RECURSIVE r AS ({views.SCORED}), t AS (SELECT k, doc_id, rule_type, confidence, {content('rule_description')} AS w FROM r),
pr AS (SELECT a.k AS a, b.k AS b FROM t a JOIN t b ON a.doc_id = b.doc_id AND a.rule_type = b.rule_type AND a.k < b.k
 WHERE len(a.w) > 0 AND len(b.w) > 0 AND len(list_intersect(a.w, b.w)) >= {dims.DUPLICATE_SIMILARITY} * (len(a.w) + len(b.w) - len(list_intersect(a.w, b.w)))),
e AS (SELECT b AS k, list(a) AS early FROM pr GROUP BY 1),
o AS (SELECT t.*, coalesce(early, []::BIGINT[]) AS early, row_number() OVER (PARTITION BY doc_id, rule_type ORDER BY k) AS i FROM t LEFT JOIN e USING (k)),
f(doc_id, rule_type, i, ls) AS (SELECT DISTINCT doc_id, rule_type, 0::BIGINT, []::BIGINT[] FROM o UNION ALL
 SELECT f.doc_id, f.rule_type, o.i, CASE WHEN list_has_any(ls, early) THEN ls ELSE list_append(ls, o.k) END FROM f JOIN o ON o.doc_id = f.doc_id AND o.rule_type = f.rule_type AND o.i = f.i + 1),
z AS (SELECT doc_id, rule_type, arg_max(ls, i) AS ls FROM f GROUP BY 1, 2),
l AS (SELECT k, confidence, CASE WHEN list_contains(ls, k) THEN k ELSE list_min(list_intersect(ls, early)) END AS leader FROM o JOIN z USING (doc_id, rule_type))
SELECT k AS key, leader, k = first_value(k) OVER (PARTITION BY leader ORDER BY confidence DESC, k) AS kept FROM l"""
_refs = f"comp AS ({views.COMPONENTS}), " + """
rel AS (
  SELECT component_id AS src, component_type, 'related_controls' AS relation, 'control' AS target, related_controls AS x FROM comp WHERE component_type IN ('policy', 'risk')
  UNION ALL SELECT component_id, component_type, 'related_risks', 'risk', related_risks FROM comp WHERE component_type IN ('policy', 'control')
  UNION ALL SELECT component_id, component_type, 'mitigation_controls', 'control', mitigation_controls FROM comp WHERE component_type = 'risk'
  UNION ALL SELECT component_id, component_type, 'related_policies', 'policy', related_policies FROM comp WHERE component_type IN ('risk', 'control')),
ed AS (SELECT src, component_type, relation, target, trim(dst) AS dst FROM (SELECT src, component_type, relation, target, unnest(regexp_split_to_array(x, '[,;\n]')) AS dst FROM rel WHERE x IS NOT NULL) WHERE trim(dst) <> '')
"""
_index = "ix AS (SELECT source_chunk_id, arg_max(component_id, CASE component_type WHEN 'policy' THEN 0 WHEN 'risk' THEN 1000000 ELSE 2000000 END + ord) AS component_id FROM comp GROUP BY 1)"
GATE_IN = """g AS (SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN 'grc_export' WHEN 1 THEN 'regulatory_docx' WHEN 2 THEN 'data_dictionary' ELSE 'docx' END AS f, CASE WHEN c_custkey % 50 <> 0 THEN (c_custkey % 100) / 100.0::DOUBLE END AS avg FROM customer),
t AS (SELECT *, CASE f """ + " ".join(f"WHEN {q(k)} THEN {v[0]}" for k, v in dims.GATES.items() if k != "default") + f" ELSE {dims.GATES['default'][0]} END::DOUBLE AS aa, CASE f " + " ".join(f"WHEN {q(k)} THEN {v[1]}" for k, v in dims.GATES.items() if k != "default") + f" ELSE {dims.GATES['default'][1]} END::DOUBLE AS hr FROM g)"
_avg = f"'avg_confidence=' || {fixed('avg', 3)} || ' < '"
LINES = "ln AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS t, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM documents)"



def canonical_value(f: str) -> str:
    older = "NULL"
    for x in reversed(dims.LEGACY.get(f, ())):
        older = f"CASE WHEN {jt(x)} IS NOT NULL THEN {js(x)} ELSE {older} END"
    return f"(CASE WHEN {has(f)} THEN {js(f)} ELSE {older} END)"


_n_canonical = "CASE rule_type " + " ".join(f"WHEN {q(n)} THEN " + " + ".join([*(f"({canonical_value(f)} IS NOT NULL)::INT" for f in req), *(f"({js(f)} IS NOT NULL)::INT" for f in opt)]) for n, (req, opt) in dims.CANONICAL.items()) + " ELSE -1 END"
_metric = canonical_value("metric_type")

SQL: dict[str, str] = {
    "extractable_chunks": f"WITH {CHUNKS} SELECT doc_id, record_type, count(*) AS n FROM c WHERE chunk_type = 'table' AND record_type IS NOT NULL GROUP BY ALL",
    "schema_hashes": "SELECT p_partkey, 'schema-' || substr(sha256(concat_ws('|', p_name, p_brand, p_type)), 1, 12) AS schema_version FROM part",
    "reconciled_coverage": "SELECT c_custkey, round(CASE WHEN c_custkey % 11 > c_custkey % 7 AND c_custkey % 13 > 0 THEN 1 - (c_custkey % 11) / (c_custkey % 13) ELSE (c_custkey % 101) / 100 END, 6) AS coverage_ratio FROM customer",
    "canonical_normalized": f"{REQ} SELECT k, CASE WHEN rule_type = 'data_quality_threshold' THEN CASE WHEN list_contains({lst(dims.ENUMS['data_quality_threshold']['metric_type'])}, lower({_metric})) THEN lower({_metric}) ELSE {_metric} END END AS metric_type, CASE WHEN rule_type = 'update_timeline' THEN {canonical_value('timeline_value')} END AS timeline_value, CASE WHEN rule_type = 'ownership_category' THEN {canonical_value('scope')} END AS scope, {_n_canonical} AS n FROM r",
    "metadata_complete": f"{REQ} SELECT rule_type, count(*) AS complete, count(*) AS n FROM r GROUP BY 1",
    "skip_records": f"{REQ} SELECT CASE k % 4 WHEN 1 THEN 'parse_error' WHEN 2 THEN 'no_extractable_content' ELSE 'llm_error' END AS skip_reason, count(*) AS n, count(DISTINCT source_chunk_id) AS chunks FROM r WHERE k % 4 > 0 GROUP BY 1",
    "error_classes": "SELECT CASE event_id % 6 WHEN 0 THEN 'API_OVERLOADED' WHEN 1 THEN 'RATE_LIMIT' WHEN 2 THEN 'AUTH_FAILED' WHEN 3 THEN 'INVALID_RESPONSE' ELSE 'OTHER' END AS error_type, event_id % 6 NOT IN (2, 5) AS is_retryable, count(*) AS n FROM events GROUP BY ALL",
    "manifest_entries": "SELECT o_orderkey, 'Part ' || o_orderkey || ' - ' || strftime(o_orderdate, '%Y-%m-%d %H:%M') AS label, strftime(o_orderdate, '%Y-%m-%dT%H:%M:00') AS timestamp FROM orders WHERE o_orderkey % 3 <> 0 UNION ALL SELECT o_orderkey, 'requirements_Part_' || o_orderkey, NULL FROM orders WHERE o_orderkey % 3 = 0",
    "upsert_latest": "WITH n AS (SELECT (c_custkey + 100)::VARCHAR AS requirement_id, 'new' AS v FROM customer) SELECT * FROM n UNION ALL SELECT c_custkey::VARCHAR, c_mktsegment FROM customer WHERE c_custkey::VARCHAR NOT IN (SELECT requirement_id FROM n)",
    "event_windows": "SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, round(avg(value), 6) AS mean FROM events GROUP BY ALL",
    "normalize_text": r"""WITH n AS (SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '\r\n?', chr(10), 'g'), '[ \t]+(\n|$)', '\1', 'g'), '\n{3,}', chr(10) || chr(10), 'g'), '^\n+|\n+$', '', 'g') AS x FROM documents)
SELECT doc_id, length(x)::INT AS n, sha256(x) AS sha FROM n""",
    "page_counters": "SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE 'Pages ' || o_orderkey || ' of 900' END AS line FROM orders",
    "chunk_ids": "SELECT doc_id, 'chunk-' || substr(sha256(concat_ws(':', source, doc_id::VARCHAR, substr(text, 1, 200))), 1, 12) AS chunk_id FROM documents",
    "requirement_ids": f"{REQ} SELECT k, 'R-' || {by('rule_type', dims.RULE_CODES, q('UNK'))} || '-' || substr(sha256(rule_description || '|' || grounded_in), 1, 6) AS requirement_id FROM r",
    "heading_entities": "SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'policy' WHEN 1 THEN 'risk' WHEN 2 THEN 'control' END AS record_type, CASE p_partkey % 4 WHEN 0 THEN 'P-' WHEN 1 THEN 'R-' WHEN 2 THEN 'C-' END || substr(lpad(p_partkey::VARCHAR, greatest(3, length(p_partkey::VARCHAR))::INT, '0'), 1, 3) AS record_id FROM part",
    "chunk_prose": f"""WITH RECURSIVE {LINES}, f(doc_id, i, size, pos) AS (
 SELECT doc_id, i, length(t), 1 FROM ln WHERE i = 1 UNION ALL
 SELECT f.doc_id, ln.i, CASE WHEN f.size + 2 + length(ln.t) > 1000 THEN length(ln.t) ELSE f.size + 2 + length(ln.t) END, f.pos + CASE WHEN f.size + 2 + length(ln.t) > 1000 THEN 1 ELSE 0 END FROM f JOIN ln ON ln.doc_id = f.doc_id AND ln.i = f.i + 1)
SELECT doc_id, pos AS position, length(string_agg(t, chr(10) || chr(10) ORDER BY i))::INT AS n, sha256(string_agg(t, chr(10) || chr(10) ORDER BY i)) AS sha FROM f JOIN ln USING (doc_id, i) GROUP BY ALL""",
    "build_batches": f"""WITH RECURSIVE {CHUNKS}, o AS (SELECT doc_id, position AS pos, char_count AS n, row_number() OVER (PARTITION BY doc_id ORDER BY record_type IS NULL, coalesce(record_type, ''), position) AS i FROM c),
s(doc_id, i, closed, cur, lastn, size) AS (
 SELECT DISTINCT doc_id, 0::BIGINT, []::BIGINT[][], []::BIGINT[], 0::BIGINT, 0::BIGINT FROM o UNION ALL
 SELECT s.doc_id, o.i,
  CASE WHEN o.n > 12000 THEN list_concat(CASE WHEN len(cur) > 0 THEN list_append(closed, cur) ELSE closed END, [[o.pos]]) WHEN size + o.n > 12000 AND len(cur) > 0 THEN list_append(closed, cur) ELSE closed END,
  CASE WHEN o.n > 12000 THEN []::BIGINT[] WHEN size + o.n > 12000 THEN CASE WHEN len(cur) > 0 THEN [cur[-1], o.pos] ELSE [o.pos] END ELSE list_append(cur, o.pos) END,
  CASE WHEN o.n > 12000 THEN 0 ELSE o.n END, CASE WHEN o.n > 12000 THEN 0 WHEN size + o.n > 12000 THEN CASE WHEN len(cur) > 0 THEN lastn ELSE 0 END + o.n ELSE size + o.n END
 FROM s JOIN o ON o.doc_id = s.doc_id AND o.i = s.i + 1),
e AS (SELECT doc_id, CASE WHEN len(arg_max(cur, i)) > 0 THEN list_append(arg_max(closed, i), arg_max(cur, i)) ELSE arg_max(closed, i) END AS b FROM s GROUP BY 1),
u AS (SELECT doc_id, unnest(b) AS m, unnest(range(0, len(b))) AS batch_id FROM e)
SELECT doc_id, batch_id::INT AS batch_id, unnest(range(0, len(m)))::INT AS ord, unnest(m) AS pos FROM u""",
    "split_tables": """WITH RECURSIVE x AS (SELECT l_suppkey, length(l_linenumber::VARCHAR || ' ' || l_partkey || ' ' || l_returnflag) AS n, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey::VARCHAR, l_returnflag) AS i FROM lineitem),
f(l_suppkey, i, size, part) AS (SELECT l_suppkey, i, 14 + 1 + n, 0 FROM x WHERE i = 1 UNION ALL
 SELECT f.l_suppkey, x.i, CASE WHEN f.size + 1 + x.n > 400 THEN 15 + x.n ELSE f.size + 1 + x.n END, f.part + CASE WHEN f.size + 1 + x.n > 400 THEN 1 ELSE 0 END FROM f JOIN x ON x.l_suppkey = f.l_suppkey AND x.i = f.i + 1)
SELECT l_suppkey, part, min(i)::INT AS first_row, max(i)::INT AS last_row, max(size)::INT AS n FROM f GROUP BY ALL""",
    "document_stats": f"""WITH RECURSIVE l0 AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS t, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i0 FROM documents),
l1 AS (SELECT doc_id, i0, regexp_replace(t, '[ \\t]+$', '') AS t FROM l0), ln AS (SELECT doc_id, t, row_number() OVER (PARTITION BY doc_id ORDER BY i0) AS i FROM l1 WHERE t <> ''),
f(doc_id, i, size, pos) AS (SELECT doc_id, i, length(t), 1 FROM ln WHERE i = 1 UNION ALL
 SELECT f.doc_id, ln.i, CASE WHEN f.size + 2 + length(ln.t) > 20 THEN length(ln.t) ELSE f.size + 2 + length(ln.t) END, f.pos + CASE WHEN f.size + 2 + length(ln.t) > 20 THEN 1 ELSE 0 END FROM f JOIN ln ON ln.doc_id = f.doc_id AND ln.i = f.i + 1),
g AS (SELECT doc_id, pos, max(size) AS n FROM f GROUP BY ALL)
SELECT doc_id::VARCHAR AS doc_id, 0::BIGINT AS table_count, count(*) FILTER (n >= 15) AS prose_sections, 0::BIGINT AS heading_count, 0::BIGINT AS list_sections, coalesce(sum(n) FILTER (n >= 15), 0)::BIGINT AS total_chars, count(*) FILTER (n < 15) AS empty_chunks_skipped FROM g GROUP BY 1""",
    "stratified_sample": f"""WITH {CHUNKS}, s AS (SELECT *, CASE WHEN record_type IS NOT NULL THEN CASE WHEN incomplete_record THEN 2 WHEN chunk_type = 'table' THEN 0 WHEN chunk_type = 'prose' THEN 1 END WHEN chunk_type = 'table' THEN 3 WHEN chunk_type = 'prose' THEN 4 END AS stratum FROM c),
n AS (SELECT *, row_number() OVER (PARTITION BY doc_id, record_type, stratum ORDER BY position) AS i, row_number() OVER (PARTITION BY doc_id, record_type ORDER BY stratum, position) AS k, count(*) FILTER (stratum < 2) OVER (PARTITION BY doc_id, record_type) AS fulls FROM s WHERE stratum IS NOT NULL),
t AS (SELECT doc_id, position, stratum FROM n WHERE (stratum < 2 AND k <= 3) OR (stratum = 2 AND i = 1 AND fulls < 3)),
u AS (SELECT n.*, greatest(15 - coalesce(z.c, 0), 0) AS slots FROM n LEFT JOIN (SELECT doc_id, count(*) AS c FROM t GROUP BY 1) z USING (doc_id) WHERE stratum > 2),
v AS (SELECT *, least(count(*) FILTER (stratum = 3) OVER (PARTITION BY doc_id), 2, slots) AS tabs FROM u)
SELECT * FROM t UNION ALL SELECT doc_id, position, stratum FROM v WHERE (stratum = 3 AND i <= tabs) OR (stratum = 4 AND i <= slots - tabs)""",
    "entity_stats": f"WITH {CHUNKS} SELECT doc_id, record_type, count(*) AS total_chunks, count(DISTINCT record_id) AS unique_records, count(*) FILTER (NOT incomplete_record) AS full_records, count(*) FILTER (incomplete_record) AS stub_records, coalesce(string_agg(DISTINCT record_id, ',' ORDER BY record_id), '') AS record_ids FROM c WHERE record_type IS NOT NULL GROUP BY ALL",
    "field_labels": """WITH x AS (
 SELECT s_suppkey AS p, (s_nationkey % 5)::VARCHAR AS doc_id, CASE WHEN s_suppkey % 4 <> 0 THEN 'risk' ELSE 'unknown' END AS record_type, 0 AS i, CASE WHEN s_suppkey % 2 = 0 THEN 'Risk ID' ELSE 'Name' END AS raw_label, s_name AS v, s_suppkey % 2 = 0 AS kv FROM supplier
 UNION ALL SELECT s_suppkey, (s_nationkey % 5)::VARCHAR, CASE WHEN s_suppkey % 4 <> 0 THEN 'risk' ELSE 'unknown' END, 1, 'Owner ' || (s_suppkey % 3), 'x', TRUE FROM supplier WHERE s_suppkey % 2 = 0
 UNION ALL SELECT s_suppkey, (s_nationkey % 5)::VARCHAR, CASE WHEN s_suppkey % 4 <> 0 THEN 'risk' ELSE 'unknown' END, 2, 'Nation', s_nationkey::VARCHAR, FALSE FROM supplier WHERE s_suppkey % 2 = 1)
SELECT doc_id, record_type, raw_label, arg_min(v, p * 10 + i) AS example_value, CASE WHEN arg_min(kv, p * 10 + i) THEN 'table_kv' ELSE 'table_horizontal' END AS source FROM x GROUP BY ALL""",
    "schema_avg_confidence": f"{SCORED} SELECT doc_id AS entity, round(avg(confidence), 6) AS avg_confidence FROM r GROUP BY 1",
    "gate_decisions": f"""WITH {GATE_IN} SELECT c_custkey, CASE WHEN avg IS NULL OR avg < hr THEN 'reject' WHEN avg >= aa THEN 'accept' ELSE 'human_review' END AS decision,
 CASE WHEN avg IS NULL THEN 'no_schema_map' WHEN avg < hr THEN {_avg} || hr::VARCHAR ELSE '' END AS failing, CASE WHEN avg >= hr AND avg < aa THEN 1 ELSE 0 END AS flags,
 CASE WHEN avg IS NULL THEN 'No schema map available for evaluation.' WHEN avg < hr THEN 'Failed checks: ' || {_avg} || hr::VARCHAR WHEN avg >= aa THEN 'All thresholds met. Confidence=' || {fixed('avg', 3)} ELSE 'Needs review: ' || {_avg} || aa::VARCHAR END AS rationale FROM t""",
    "gate_after_evaluation": f"""WITH {GATE_IN}, m AS (SELECT *, 1 - (c_custkey % 5) / greatest(c_custkey % 9, 1) AS sr, (c_custkey % 11) / 10 AS cov FROM t),
z AS (SELECT *, CASE WHEN avg IS NULL THEN ['no_schema_map'] ELSE {some(f"CASE WHEN avg < hr THEN {_avg} || hr::VARCHAR END", f"CASE WHEN sr < 0.5 THEN 'schema_compliance=' || {fixed('sr * 100', 1)} || '% < 50.0%' END", f"CASE WHEN cov < 0.6 THEN 'coverage=' || {fixed('cov * 100', 1)} || '% < 60.0%' END")} END AS failing,
 {some(f"CASE WHEN avg >= hr AND avg < aa THEN {_avg} || aa::VARCHAR END", "CASE WHEN c_custkey % 2 > 0 THEN 'testability_issues=' || c_custkey % 2 END", "CASE WHEN c_custkey % 3 > 0 THEN 'hallucination_flags=' || c_custkey % 3 END")} AS flags FROM m)
SELECT c_custkey, CASE WHEN len(failing) > 0 THEN 'reject' WHEN avg >= aa AND len(flags) = 0 THEN 'accept' ELSE 'human_review' END AS decision, array_to_string(failing, '; ') AS failing, array_to_string(flags, '; ') AS flags FROM z""",
    "component_edges": f"WITH {_refs} SELECT src, relation, dst FROM ed",
    "missing_references": f"WITH {_refs} SELECT src, relation, dst, upper(component_type[1]) || component_type[2:] || ' ' || src || ' references missing ' || target || ' ' || dst AS message FROM ed WHERE dst NOT IN (SELECT component_id FROM comp)",
    "reference_index": f"WITH {_refs} SELECT src AS component_id, string_agg(DISTINCT dst, ',' ORDER BY dst) AS refs FROM ed GROUP BY 1",
    "component_chunk_index": f"WITH comp AS ({views.COMPONENTS}), {_index} SELECT * FROM ix",
    "component_summary": f"WITH comp AS ({views.COMPONENTS}) SELECT count(*) FILTER (component_type = 'policy') AS policies, count(*) FILTER (component_type = 'risk') AS risks, count(*) FILTER (component_type = 'control') AS controls, count(*) AS total FROM comp",
    "control_type_parts": "WITH x AS (SELECT p_partkey, replace(p_type, ' ', ' / ') AS t FROM part) SELECT p_partkey, CASE WHEN NOT contains(t, '/') THEN t END AS raw, CASE WHEN contains(t, '/') THEN trim(split_part(t, '/', 1)) END AS nature, CASE WHEN contains(t, '/') THEN trim(split_part(t, '/', 2)) END AS automation FROM x",
    "parent_link": f"{REQ}, comp AS ({views.COMPONENTS}), {_index} SELECT k, component_id AS parent_component_id FROM r LEFT JOIN ix USING (source_chunk_id)",
    "response_items": f"{REQ}, n AS (SELECT k, rule_type, CASE k % 5 WHEN 2 THEN 0 WHEN 0 THEN 1 WHEN 1 THEN 1 ELSE 2 END AS n FROM r) SELECT k AS batch_id, unnest(range(0, n))::INT AS item_ord, rule_type, 0.9::DOUBLE AS confidence FROM n",
    "response_status": f"{REQ} SELECT k AS batch_id, CASE k % 3 WHEN 2 THEN 2 ELSE 0 END AS n_items, k % 3 = 1 AS parse_error FROM r",
    "validate_attributes": f"{REQ} SELECT k, array_to_string({missing()}, ', ') AS missing, len({missing()}) = 0 AS valid FROM r",
    "repair_attributes": REPAIR,
    "applicable_fields": f"{REQ} SELECT k, nullif(array_to_string({FIELDS}, ','), '') AS fields FROM r",
    "data_sources": f"{REQ} SELECT k, {source()} AS data_source FROM r",
    "fragment_flags": f"{REQ} SELECT k, {starts(_desc, dims.REQUIREMENT_PRONOUNS)} AS requirement_fragment, {starts('lower(trim(split_part(rule_description, chr(46), 1)))', dims.CHUNK_PRONOUNS)} AS chunk_fragment FROM r",
    "extraction_metadata": f"{SCORED}, a AS (SELECT doc_id, count(*) AS n, round(avg(confidence), 6) AS avg_confidence FROM r WHERE grounding_classification <> 'INFERENCE' AND confidence >= CASE extraction_iteration WHEN 2 THEN 0.70 ELSE 0.60 END GROUP BY 1) SELECT a.*, coalesce(b.rejected, 0) AS rejected FROM a LEFT JOIN (SELECT doc_id, count(*) AS rejected FROM r WHERE grounding_classification = 'INFERENCE' GROUP BY 1) b USING (doc_id)",
    "dedup_leaders": LEADERS,
    "duplicate_pairs": f"{REQ}, {_dup} SELECT a, b, similarity FROM pr",
    "dedup_ratios": f"{REQ}, {_dup}, c AS (SELECT doc_id, count(*) AS pairs FROM pr GROUP BY 1) SELECT doc_id, n, coalesce(pairs, 0) AS pairs, round((n - coalesce(pairs, 0)) / n, 6) AS dedup_ratio FROM (SELECT doc_id, count(*) AS n FROM r GROUP BY 1) LEFT JOIN c USING (doc_id)",
    "token_jaccard": f"{PAIRS}, {evidence('p', 'conv_id, turn')} SELECT conv_id, turn, len(dt)::INT AS d, len(gt)::INT AS g, {J} AS jaccard FROM ev",
    "phrase_matches": f"{PAIRS}, {evidence('p', 'conv_id, turn')} SELECT conv_id, turn, phrase_count, phrases FROM ev",
    "grounding_class": f"{PAIRS}, {evidence('p', 'conv_id, turn')}, z AS (SELECT *, {LIVE} AS m, {J} AS jr FROM ev) SELECT conv_id, turn, jr AS jaccard_score, phrase_count, m AS grounding_match, {klass('m', 'jr', 'phrase_count')} AS grounding_class FROM z",
    "grounding_older_profile": f"{PAIRS}, {evidence('p', 'conv_id, turn')}, z AS (SELECT *, {OLDER} AS m FROM ev) SELECT conv_id, turn, m AS grounding_match, CASE WHEN m >= 0.25 THEN 'EXACT' WHEN m >= 0.15 THEN 'PARAPHRASE' ELSE 'INFERENCE' END AS grounding_class FROM z",
    "completeness": f"{REQ} SELECT k, {completeness('0.25')} AS completeness, {completeness('0.20')} AS older FROM r",
    "quantification": f"{REQ} SELECT k, {QUANT} AS quantification FROM r",
    "canonical_validation": f"{REQ} SELECT k, array_to_string({canonical_errors()}, ', ') AS errors, array_to_string({canonical_warnings()}, ', ') AS warnings, {compliance(0.12, 0.06)}::DOUBLE AS compliance FROM r",
    "coherence": f"{REQ} SELECT k, {coherence()} AS coherence FROM r",
    "domain_signals": f"{REQ} SELECT k, {domain(0.03, 0.02)} AS domain_signals, {domain(0.05, 0.03)} AS older FROM r",
    "confidence_score": SCORE,
    "verb_context": CONTEXT,
    "vague_verbs": f"{REQ}, x AS (SELECT k, len(regexp_extract_all({_desc}, '\\b(' || '{'|'.join(dims.VERBS)}' || ')\\b'))::INT AS n FROM r) SELECT k, n, n > 0 AS vague FROM x",
    "verb_templates": f"{REQ} SELECT k, '100' AS n, {_first_word(dims.FREQUENCIES, 'quarterly')} AS frequency, CASE WHEN {_share} <> '' THEN {_share} || '%' ELSE '' END AS threshold, {_first_word(dims.METRICS, '')} AS metric FROM r",
    "control_objectives": f"{REQ} SELECT k, replace(replace({by('rule_type', dims.OBJECTIVES, q(dims.DEFAULT_OBJECTIVE))}, '{{applies_to}}', {APPLIES}), '{_doubled}', 'accounts') AS objective FROM r",
    "control_risks": f"{REQ}, x AS (SELECT k, {_risk} AS l FROM r) SELECT k, array_to_string(l[1:3], ',') AS risks FROM x",
    "control_types": f"{REQ} SELECT k, {CONTROL} AS control_type, {MEASURE} AS measurement_type FROM r",
    "test_procedures": PROCEDURES,
    "control_owners": f"{REQ} SELECT k, CASE WHEN {truthy('responsible_party')} THEN {js('responsible_party')} ELSE {by('rule_type', dims.OWNERS, q(dims.DEFAULT_OWNER))} END AS owner, {AUTOMATION} AS automation FROM r",
    "evidence_types": f"{REQ} SELECT k, {by('rule_type', {k: ';'.join(v) for k, v in dims.EVIDENCE.items()}, q(dims.DEFAULT_EVIDENCE[0]))} AS evidence FROM r",
    "system_mapping": f"{REQ}, x AS (SELECT k, {_sys} AS s, {_words} AS w FROM r) SELECT k, CASE WHEN len(s) = 0 THEN {q(dims.DEFAULT_SYSTEM)} ELSE array_to_string(s[1:3], ',') END AS systems, CASE WHEN len(s) = 0 THEN 'default_template' ELSE 'keyword_inferred' END AS source, array_to_string(w, ',') AS keywords FROM x",
    "exception_tiers": TIERS,
    "automation_breakdown": f"{REQ}, x AS (SELECT doc_id, {AUTOMATION} AS m FROM r), y AS (SELECT doc_id, count(*) FILTER (m = 'automated') AS automated, count(*) FILTER (m = 'manual') AS manual, count(*) FILTER (m = 'hybrid') AS hybrid, count(*) AS total FROM x GROUP BY 1) SELECT *, CASE WHEN automated * 100 / total >= 80 THEN 'Highly Automatable' WHEN automated * 100 / total >= 60 THEN 'Mostly Automatable' WHEN automated * 100 / total >= 40 THEN 'Mixed Automation' ELSE 'Requires Manual Effort' END AS automation_tier FROM y",
    "coverage": f"{REQ} SELECT (SELECT count(*) FROM documents) AS total_chunks, count(DISTINCT source_chunk_id) AS chunks_processed, round(count(DISTINCT source_chunk_id) / (SELECT count(*) FROM documents), 6) AS coverage_ratio FROM r",
    "zero_chunks": f"{REQ} SELECT 'c-' || doc_id AS chunk_id FROM documents WHERE 'c-' || doc_id NOT IN (SELECT source_chunk_id FROM r)",
    "unlabelled_documents": "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)",
    "evaluation_report": f"""{SCORED}, {FLAGS}, {_dup},
b AS (SELECT doc_id, count(*) AS n, count(DISTINCT source_chunk_id) AS chunks, max(extraction_iteration) AS pass FROM r GROUP BY 1),
te AS (SELECT doc_id, count(*) AS n FROM (SELECT doc_id, {TESTABILITY} AS l FROM r) WHERE len(l) > 0 GROUP BY 1),
gr AS (SELECT doc_id, count(*) AS n FROM (SELECT doc_id, {GROUNDING} AS l FROM r) WHERE len(l) > 0 GROUP BY 1),
sc AS (SELECT doc_id, count(*) AS n, count(*) FILTER (len(l) >= 2) AS high FROM (SELECT doc_id, {canonical_errors()} AS l FROM r) WHERE len(l) > 0 GROUP BY 1),
ha AS (SELECT doc_id, count(*) AS n, count(*) FILTER (risk = 'critical') AS critical, count(*) FILTER (risk = 'high') AS high FROM h GROUP BY 1),
du AS (SELECT doc_id, count(*) AS n FROM pr GROUP BY 1),
c AS (SELECT doc_id, b.chunks, b.n, b.pass, coalesce(te.n, 0) AS te, coalesce(gr.n, 0) AS gr, coalesce(sc.n, 0) AS sc, coalesce(sc.high, 0) AS sh, coalesce(ha.n, 0) AS ha, coalesce(ha.critical, 0) AS hc, coalesce(ha.high, 0) AS hh, coalesce(du.n, 0) AS du
  FROM b LEFT JOIN te USING (doc_id) LEFT JOIN gr USING (doc_id) LEFT JOIN sc USING (doc_id) LEFT JOIN ha USING (doc_id) LEFT JOIN du USING (doc_id)),
f AS (SELECT *, list_filter(['testability', 'grounding', 'schema', 'dedup', 'hallucination'], lambda x, i: [te > 5, gr > 3, sh > 3, (n - du) / n < 0.70, hc > 0 OR hh > 3][i]) AS found FROM c)
SELECT doc_id, chunks AS total_chunks, chunks AS chunks_processed, n AS total_requirements, te AS testability_issues, gr AS grounding_issues, sc AS schema_issues, ha AS hallucination_flags, du AS duplicate_pairs,
  CASE len(found) WHEN 0 THEN 'none' WHEN 1 THEN found[1] ELSE 'multi' END AS failure_type,
  CASE WHEN hc > 0 THEN 'critical' WHEN te > 5 OR hh > 3 OR len(found) > 1 THEN 'high' WHEN len(found) = 1 THEN 'medium' ELSE 'low' END AS failure_severity,
  NOT (hc > 0 OR hh > 3) AND (n - du) / n < 0.70 AND pass < 2 AS is_retryable FROM f""",
    "testability_issues": f"{REQ}, x AS (SELECT k, {TESTABILITY} AS l FROM r) SELECT k, array_to_string(l, '; ') AS issues, CASE WHEN len(l) > 1 THEN 'high' ELSE 'medium' END AS severity FROM x WHERE len(l) > 0",
    "grounding_issues": f"{SCORED}, x AS (SELECT k, confidence, grounded_in, {GROUNDING} AS l FROM r) SELECT k, array_to_string(l, '; ') AS issues, CASE WHEN trim(grounded_in) = '' OR confidence < 0.60 THEN 'high' ELSE 'medium' END AS severity FROM x WHERE len(l) > 0",
    "hallucination_flags": f"{SCORED}, {FLAGS} SELECT k, array_to_string(fl, '; ') AS flags, risk FROM h",
    "schema_compliance_issues": f"{REQ}, x AS (SELECT k, {canonical_errors()} AS l, len({canonical_warnings()})::INT AS invalid FROM r) SELECT k, array_to_string(l, ', ') AS missing, invalid, CASE WHEN len(l) >= 2 THEN 'high' ELSE 'medium' END AS severity FROM x WHERE len(l) > 0",
    "enrichment_issues": f"{SCORED}, x AS (SELECT k, confidence, confidence + (k % 4) / 50 AS raw FROM r), y AS (SELECT *, least(0.99, greatest(0.5, raw)) AS e FROM x) SELECT k, 'confidence_integrity' AS issue_type, 'Declared ' || {fixed('confidence', 2)} || ' vs expected ' || {fixed('e', 2)} || ' (raw=' || {fixed('raw', 3)} || ')' AS detail FROM y WHERE abs(confidence - e) > 0.05",
    "confidence_histogram": f"{SCORED}, b AS (SELECT doc_id, {BUCKET} AS bucket, count(*) AS n FROM r GROUP BY ALL), a AS (SELECT DISTINCT doc_id, unnest({lst(n for n, _ in dims.CONFIDENCE_BUCKETS)}) AS bucket FROM r) SELECT doc_id, bucket, coalesce(n, 0) AS n FROM a LEFT JOIN b USING (doc_id, bucket)",
    "requirements_by_type": f"{REQ} SELECT doc_id, rule_type, count(*) AS n FROM r GROUP BY ALL",
    "schema_coverage": f"{REQ} SELECT doc_id, entity, count(*) FILTER (contains(lower(attributes || ' ' || rule_description), lower(entity))) AS n FROM r, (SELECT unnest(['ACCOUNT', 'Vendor', 'percent', 'nothing']) AS entity) GROUP BY ALL",
    "failure_classes": CLASSES,
    "quality_scores": QUALITY,
    "suggestions": SUGGESTIONS,
    "insights_quality": f"{TOTALS} SELECT doc_id, {half_up(_p('valid'), 1)} AS schema_completeness_pct, {half_up(_p('exact'), 1)} AS grounding_quality_pct, {half_up(_p('sourced'), 1)} AS data_source_coverage_pct, CASE WHEN ({_p('valid')} + {_p('exact')} + {_p('sourced')}) / 3 >= 90 THEN 'Excellent' WHEN ({_p('valid')} + {_p('exact')} + {_p('sourced')}) / 3 >= 75 THEN 'Good' WHEN ({_p('valid')} + {_p('exact')} + {_p('sourced')}) / 3 >= 60 THEN 'Fair' ELSE 'Needs Review' END AS overall_quality_tier FROM c",
    "insights_risk_flags": f"{TOTALS} {RISKS}",
    "rule_type_shares": f"{REQ}, x AS (SELECT doc_id, rule_type, count(*) AS n FROM r GROUP BY ALL) SELECT *, {half_up('n * 100 / sum(n) OVER (PARTITION BY doc_id)', 1)} AS percentage FROM x",
    "confidence_tiers": f"{TOTALS} SELECT doc_id, high, medium, low, {half_up(_p('high'), 1)} AS high_pct, {half_up(_p('medium'), 1)} AS medium_pct, {half_up(_p('low'), 1)} AS low_pct, average_confidence FROM c",
    "hallucination_risk": f"{SCORED}, {FLAGS}, n AS (SELECT doc_id, count(*) AS total FROM r GROUP BY 1), z AS (SELECT n.doc_id, total, count(h.k) AS hallucination_count, count(*) FILTER (risk = 'critical') AS critical_count, count(*) FILTER (risk = 'high') AS high_count FROM n LEFT JOIN h ON h.doc_id = n.doc_id GROUP BY ALL) SELECT doc_id, hallucination_count, critical_count, high_count, {half_up('hallucination_count * 100 / total', 1)} AS hallucination_pct FROM z",
    "recommendations": f"{TOTALS} SELECT doc_id, array_to_string({RECOMMEND}, ' / ') AS recommendations FROM c",
    "dashboard_filter": f"{SCORED} SELECT k, rule_type, confidence FROM r WHERE confidence >= 0.65 AND confidence < 0.85 AND contains({_desc}, 'deposit')",
    "dashboard_page": f"{SCORED} SELECT k, confidence FROM r ORDER BY confidence DESC, k LIMIT 20 OFFSET 40",
    "attribute_column": f"{REQ}, x AS (SELECT *, {FIELDS} AS l FROM r) SELECT k, coalesce(CASE WHEN len(l) > 0 THEN array_to_string(l[1:3], ', ') || CASE WHEN len(l) > 3 THEN '...' ELSE '' END END, nullif({js('data_source')}, ''), nullif({js('control_type')}, ''), 'N/A') AS attribute FROM x",
    "export_rows": f"{SCORED} SELECT k::VARCHAR AS requirement_id, rule_type, rule_description AS description, {fixed('confidence', 2)} AS confidence, grounded_in AS grounding, array_to_string({FIELDS}, '; ') AS applicable_fields, data_source, coalesce({js('control_type')}, '') AS control_type FROM r",
}
