"""Functions against values worked out by hand."""

import hashlib
import random
import re
import time

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import Column
from pyspark.sql import functions as F

from clausewright import dims
from clausewright.functions import attributes as at
from clausewright.functions import control, grounding, ids, repair, score, text, verbs


def one(spark, column, **values):
    types = {str: "string", float: "double", int: "int", bool: "boolean"}
    schema = ", ".join(f"{k} {types.get(type(v), 'string')}" for k, v in values.items())
    return spark.createDataFrame([tuple(values.values())], schema).select(column.alias("x")).first()["x"]


def test_normalize_text(spark):
    assert one(spark, text.normalize_text(F.col("t")), t="\n\na  \r\n\n\n\nb\t\n\n") == "a\n\nb"
    assert one(spark, text.clean_paragraph(F.col("t")), t=" Page 3 of 12 ") == ""
    assert one(spark, text.clean_paragraph(F.col("t")), t="Pages 3 of 12") == "Pages 3 of 12"


def test_ids(spark):
    content = "é" * 300
    want = "chunk-" + hashlib.sha256(f"a.docx:4:{content[:200]}".encode()).hexdigest()[:12]
    assert one(spark, ids.chunk_id(F.lit("a.docx"), F.lit(4), F.col("t")), t=content) == want
    want = "R-TL-" + hashlib.sha256(b"d|g").hexdigest()[:6]
    assert one(spark, ids.requirement_id(F.lit("update_timeline"), F.lit("d"), F.col("t")), t="g") == want
    assert one(spark, ids.rule_code(F.col("t")), t="else") == "UNK"


def test_tokens(spark):
    assert sorted(one(spark, text.score_tokens(F.col("t")), t="The über1 ok, OK 7")) == ["7", "ok", "the"]
    assert one(spark, text.content_tokens(F.col("t")), t="The hold must be aggregated") == ["hold", "aggregated"]


@pytest.mark.parametrize(
    ("source", "target", "want"),
    [
        ("records must be kept for five years", "all records must be kept", ["records must be kept"]),
        ("a b", "a b", []),
        ("one two three four five six seven eight", "one two three four five six seven eight", ["one two three four five six seven", "two three four five six seven eight"]),
    ],
)
def test_phrases(spark, source, target, want):
    assert one(spark, grounding.phrases(F.col("s"), F.col("t")), s=source, t=target) == want


def phrases_by_hand(source, target, least=3, most=7):
    words, kept = [w for w in re.split(r"[ \t\n\x0b\f\r]+", source.lower()) if w], []
    for i in range(len(words)):
        for n in range(least, most + 1):
            p = " ".join(words[i : i + n])
            if i + n <= len(words) and p in target.lower() and not any(p in k for k in kept):
                kept = [*(k for k in kept if k not in p), p]
    return kept


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.text("ab \n", max_size=30), st.text("ab \n", max_size=40)), min_size=1, max_size=20))
def test_phrases_of_any_texts(spark, pairs):
    df = spark.createDataFrame([(i, s, t) for i, (s, t) in enumerate(pairs)], "i int, s string, t string")
    got = dict(df.select("i", grounding.phrases(F.col("s"), F.col("t")).alias("p")).collect())
    assert got == {i: phrases_by_hand(s, t) for i, (s, t) in enumerate(pairs)}


def test_phrases_of_long_texts(spark):
    """Two texts of 20,000 words that share 50 passages and most of their words."""
    rng = random.Random(4)
    words = [f"w{rng.randint(0, 3000)}" for _ in range(20_000)]
    other = [f"w{rng.randint(0, 3000)}" for _ in range(20_000)]
    shared = [[f"p{i}x{j}" for j in range(5)] for i in range(50)]
    for i, passage in enumerate(shared):
        words[400 * i : 400 * i + 5] = passage
        other[390 * i + 7 : 390 * i + 12] = passage
    began = time.monotonic()
    got = one(spark, grounding.phrases(F.col("s"), F.col("t")), s=" ".join(words), t=" ".join(other))
    assert {" ".join(p) for p in shared} <= set(got) and time.monotonic() - began < 60


def test_decoded_once(spark):
    """The decoded fields say what the variant says."""
    j = '{"a": 0, "b": "x", "c": null, "d": [1, null], "e": {"f": 1}, "g": 0.50, "h": true, "i": 1e30, "j": "7.5"}'
    names = [*"abcdefghijk"]
    both = F.struct(
        F.array(*[F.coalesce(at.kind_of(F.col("a"), n), F.lit("-")) for n in names]).alias("k"), at.once(F.col("a"), lambda m: F.array(*[F.coalesce(at.kind_of(m, n), F.lit("-")) for n in names])).alias("dk"),
        F.array(*[at.field(F.col("a"), n) for n in names]).alias("t"), at.once(F.col("a"), lambda m: F.array(*[at.field(m, n) for n in names])).alias("dt"),
    )
    got = attributes(spark, j, both)
    assert got["k"] == got["dk"] and got["t"] == got["dt"] and got["k"][10] == "-"
    assert attributes(spark, "[1]", at.missing_fields(F.col("a"), F.lit("control_requirement"))) == ["control_type"]
    assert attributes(spark, '{"threshold_value": 0.0}', at.truthy(F.col("a"), "threshold_value")) is False


def test_match_score_and_class(spark):
    similarity = F.lit("0.4").cast("decimal(20,10)")
    assert one(spark, grounding.match_score(similarity, F.lit(1)), t="") == 0.23  # 0.2295, half up
    assert one(spark, grounding.match_score(similarity, F.lit(0)), t="") == 0.132
    classes = [one(spark, grounding.classify(F.lit(m), F.lit(j), F.lit(p)), t="") for m, j, p in ((0.15, 0.0, 0), (0.0, 0.25, 0), (0.08, 0.0, 0), (0.0, 0.0, 1), (0.07, 0.14, 0))]
    assert classes == ["EXACT", "EXACT", "PARAPHRASE", "PARAPHRASE", "INFERENCE"]


@pytest.mark.parametrize(("d", "g", "want"), [("must not change", "must change", 0.0), ("keep 5", "keep 6", 0.05), ("keep 5", "keep 5", 0.1), ("x", "y", 0.1), ("cannot", "can", 0.0)])
def test_coherence(spark, d, g, want):
    assert one(spark, grounding.coherence(F.col("d"), F.col("g")), d=d, g=g) == want


def attributes(spark, text_, column):
    return spark.createDataFrame([(text_,)], "t string").withColumn("a", F.parse_json("t")).select(column.alias("x")).first()["x"]


def test_missing_fields(spark):
    f = lambda j, t: attributes(spark, j, at.missing_fields(F.col("a"), F.lit(t)))
    assert f('{"metric": "m", "threshold_direction": "gte"}', "data_quality_threshold") == []
    assert f('{"metric": 5}', "data_quality_threshold") == ["metric (wrong type)", "threshold_direction"]
    assert f('{"metric": null, "threshold_direction": "x"}', "data_quality_threshold") == ["metric (wrong type)"]
    assert f('{"threshold_value": true, "threshold_unit": "%"}', "beneficial_ownership_threshold") == []
    assert f("{}", "risk_statement") == ["Unknown rule_type: risk_statement"]


def test_canonical(spark):
    f = lambda j, t: attributes(spark, j, at.canonical_errors(F.col("a"), F.lit(t)))
    assert f('{"metric": "accuracy", "threshold_value": 9, "threshold_unit": "percent", "applies_to": "x"}', "data_quality_threshold") == []
    assert f('{"applies_to": "x", "ownership_type": null}', "ownership_category") == ["ownership_type"]
    assert f("{}", "risk_statement") is None
    assert attributes(spark, '{"metric_type": "Speed", "threshold_unit": "percent"}', at.canonical_warnings(F.col("a"), F.lit("data_quality_threshold"))) == ["metric_type: 'Speed' not in enum"]


def test_truthy(spark):
    got = attributes(spark, '{"a": 0, "b": "", "c": "0", "d": [], "e": [1], "f": false, "g": 0.5, "h": null}', F.array(*[at.truthy(F.col("a"), x) for x in "abcdefghi"]))
    assert got == [False, False, True, False, True, False, True, False, False]


def test_repair(spark):
    rows = [
        (1, "update_timeline", "Accounts change within 24 hours", "{}"),
        (2, "data_quality_threshold", "accuracy at least 9", '{"metric": 5}'),
        (3, "beneficial_ownership_threshold", "nothing here", "{}"),
        (4, "control_requirement", "x", '{"control_type": "y"}'),
    ]
    df = spark.createDataFrame(rows, "k int, rule_type string, rule_description string, j string").withColumn("a", F.parse_json("j"))
    got = {r["k"]: r for r in repair.with_repair(df).withColumn("j", F.to_json("a")).drop("a").collect()}
    assert got[1]["schema_status"] == "repaired"
    assert '"applies_to":"accounts"' in got[1]["j"] and '"threshold_unit":"hours"' in got[1]["j"] and '"data_source":"core_banking_system.accounts"' in got[1]["j"]
    assert got[2]["schema_status"] == "rejected" and got[2]["missing_fields"] == ["metric (wrong type)"] and got[2]["repaired_fields"] == ["threshold_direction"]
    assert got[3]["schema_status"] == "rejected" and got[3]["missing_fields"] == ["threshold_value"]
    assert got[4]["schema_status"] == "valid" and got[4]["j"] == '{"control_type":"y"}'


def test_confidence(spark):
    rows = [("control_requirement", "Systems must monitor compliance", "Systems must monitor compliance daily", '{"control_type": "Preventive", "control_mechanism": "audit"}')]
    df = spark.createDataFrame(rows, "rule_type string, rule_description string, grounded_in string, j string").withColumn("a", F.parse_json("j"))
    r = score.with_confidence(df).drop("a").first()
    assert (r["jaccard_score"], r["phrase_count"], r["grounding_match"]) == (0.8, 1, 0.318)
    assert (r["completeness"], r["quantification"], r["schema_compliance"], r["coherence"], r["domain_signals"]) == (0.25, 0.0, 0.12, 0.1, 0.02)
    assert (r["raw_total"], r["confidence"], r["grounding_classification"]) == (0.808, 0.81, "EXACT")
    assert r["rationale"] == "Strong grounding (80% word overlap, 1 phrase matches); attributes complete; schema violations."


def test_clamp(spark):
    assert [one(spark, score.clamp(F.lit(x)), t="") for x in (0.1, 0.745, 1.05)] == [0.5, 0.75, 0.99]


def test_verbs(spark):
    f = lambda t: one(spark, verbs.replace_vague(F.col("t")), t=t)
    r = f("ensure it")
    assert r["replaced"] == "monitor and sample and compare it"
    assert [x["original_verb"] for x in r["replacements"]] == ["ensure", "verify"]
    assert f("nothing to do")["has_vague_verbs"] is False
    assert one(spark, verbs.context(F.col("t")), t="data record value of a system") == "data"
    assert one(spark, verbs.context(F.col("t")), t="zzz") == "default"
    assert one(spark, verbs.base_verb_count(F.col("t")), t="Ensure, ensured and check") == 2


def test_control_metadata(spark):
    f = lambda j, t, d: attributes(spark, j, F.to_json(control.metadata(F.col("a"), F.lit(t), F.lit(d))))
    import json

    m = json.loads(f('{"threshold_value": "98%", "threshold_unit": "%", "applies_to": "data data"}', "data_quality_threshold", "External vendor system uptime"))
    assert m["control_objective"].startswith("Ensure data meets quality")
    assert m["risk_addressed"] == ["R001_data_integrity", "R002_regulatory_compliance", "R004_system_availability"]
    assert m["exception_threshold"]["tier_2_high"]["condition"] == "97.0% - 97.5%"
    assert "against 98%% SLA" in m["test_procedure"]
    assert (m["control_owner"], m["automated"]) == ("Manager, Data Governance", "automated")
    m = json.loads(f('{"timeline_value": 45, "timeline_unit": "days"}', "update_timeline", "x"))
    assert m["exception_threshold"]["breach"] == {"condition": "Update not completed within 45 percent", "action": "Escalate to control owner; initiate remediation", "sla_remediation": "22 percent"}
    assert m["system_mapping"] == ["core_banking_platform"] and m["system_mapping_source"] == "default_template"


def replaced_by_hand(text: str, scalars: dict[str, str], found: str, values: dict[str, str]) -> tuple[str, list[dict]]:
    """Replaces verb after verb; a later verb sees what an earlier one put in."""
    values = {**values, **scalars}
    done = []
    for verb, choices in dims.VERBS.items():
        pattern = re.compile(rf"\b({verb}s?|{verb}ing|{verb}ed)\b", re.IGNORECASE)
        hits = pattern.findall(text)
        if not hits:
            continue
        template = choices.get(found, choices["default"])
        new = re.sub(r"\{(\w+)\}", lambda m: values[m[1]], template)
        for hit in hits:
            cased = new.capitalize() if hit[0].isupper() else new
            text = pattern.sub(lambda _, c=cased: c, text, count=1)
            done.append({"original_verb": hit, "replacement": cased, "context": found})
    return text, done


def test_verbs_against_a_fold_by_hand(spark):
    """Generated texts of verb forms, cases, scripts and blanks, with and without attribute texts, nulls and empty texts included."""
    rng = random.Random(8)
    forms = [f(v + e) for v in dims.VERBS for e in ("", "s", "ing", "ed") for f in (str, str.capitalize, str.upper)]
    others = ["data", "accuracy 95%", "quarterly", "\n", "checklist", "x_check", "\u00e9check", "check\u00e9", "chec\u212a", "en\u017fure", "$1", "a\\b", "sample", "policy", "risk", "-", "."]
    rows = [(None, {}), ("", {}), ("nothing here", {"metric": "m"})]
    for _ in range(150):
        t = rng.choice([" ", " ", ", "]).join(rng.choices(forms, k=rng.randint(0, 6)) + rng.choices(others, k=rng.randint(0, 6)))
        words = t.split(" ")
        rng.shuffle(words)
        rows.append((" ".join(words), rng.choice([{}, {"metric": "check Rate $2 \\"}, {"threshold": "97%", "n": None}])))
    df = spark.createDataFrame(rows, "t string, s map<string,string>")
    text = F.col("t")
    cols = [text, "s", verbs.context(text).alias("c"), F.struct(*[c.alias(k) for k, c in verbs.template_values(text).items()]).alias("v"), verbs.replace_vague(text, F.col("s")).alias("got")]
    out = df.select(*cols)
    assert "Python" not in out._jdf.queryExecution().executedPlan().toString()
    n = 0
    for r in out.collect():
        new, done = replaced_by_hand(r["t"], {k: x for k, x in r["s"].items() if x is not None}, r["c"], r["v"].asDict()) if r["t"] is not None else (None, [])
        assert (r["got"]["replaced"], [x.asDict() for x in r["got"]["replacements"]], r["got"]["has_vague_verbs"]) == (new, done, bool(done))
        n += len(done)
    assert n > 300


def _plan(spark, of):
    """The optimized plan of a column, or frame, over requirements."""
    df = spark.sql("SELECT id, concat('t', id) rule_type, concat('d', id) rule_description, concat('g', id) grounded_in, parse_json(concat('{\"a\":', id, '}')) a FROM range(3)")
    out = of(df)
    return (df.select(out.alias("x")) if isinstance(out, Column) else out)._jdf.queryExecution().optimizedPlan().toString()


def test_control_metadata_lowers_once_per_part(spark):
    """Risks, control type, automation and each of the three system fields lower the description once; no part decodes the whole object."""
    plan = _plan(spark, lambda df: control.metadata(F.col("a"), F.col("rule_type"), F.col("rule_description")))
    assert plan.count("lower(") <= 6 and "transform_values" not in plan


def test_repair_lowers_once_per_part(spark):
    plan = _plan(spark, repair.with_repair)
    assert plan.count("lower(") <= 3 and "transform_values" not in plan


def test_verb_context_lowers_once(spark):
    assert _plan(spark, lambda df: verbs.context(F.col("rule_description"))).count("lower(") == 1


def test_confidence_reads_fields_not_objects(spark):
    assert "transform_values" not in _plan(spark, score.with_confidence)


def test_score_tokens_in_one_pass(spark):
    """Only runs that are ASCII throughout, in order of first place."""
    df = spark.createDataFrame([("Ab a\u00e9b cd_e 12 ab \u00e912 9\u0301 x-y",), ("",), (None,)], "t string")
    assert [r[0] for r in df.select(text.score_tokens(F.col("t"))).collect()] == [["ab", "12", "x", "y"], [], None]
    assert "filter(" not in _plan(spark, lambda df: text.score_tokens(F.col("rule_description")))
