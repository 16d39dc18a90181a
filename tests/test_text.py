import hashlib

import pytest
from pyspark.sql import functions as F

from redactflow.config import Settings
from redactflow.operators.entities import PATTERNS, all_linear, any_pattern
from redactflow.operators.text import anonymize_text, detect_entities, mask_entities, residual_count
from tests.helpers import by

FILLER = "Plain prose that says nothing about anyone and goes on for a while so that most of it is kept. " * 3
SAMPLES = {
    1: "Reach me at jane.doe@example.org or +1 (555) 010-2288.",
    2: "SSN 123-45-6789, card 4111111111111111, host 10.0.0.12.",
    3: "PLATE 7XKD221 and acct #0098-2231 near 123 Elm St, Apt 4B today.",
    4: "api_key = sk-123 password:hunter2@example.org end",
    5: "Nothing here.",
    6: None,
    7: "",
    8: "twice a@b.co a@b.co and xa@b.co",
}
EXPECTED = {
    1: {("EMAIL", "jane.doe@example.org"), ("PHONE", "+1 (555) 010-2288")},
    2: {("SSN", "123-45-6789"), ("CARD", "4111111111111111"), ("IPV4", "10.0.0.12")},
    3: {("PLATE", "PLATE 7XKD221"), ("ACCOUNT", "acct #0098-2231"), ("ADDRESS", "123 Elm St, Apt 4B")},
    4: {("SECRET", "api_key = sk-123"), ("SECRET", "password:hunter2@example.org")},
    8: {("EMAIL", "a@b.co"), ("EMAIL", "xa@b.co")},
}


@pytest.fixture(scope="module")
def samples(spark):
    return spark.createDataFrame(list(SAMPLES.items()), "id int, text string")


def test_detects_every_kind_once(samples):
    got = {}
    for r in detect_entities(samples, "text", "id").collect():
        got.setdefault(r["id"], set()).add((r["kind"], r["match"]))
    assert got == EXPECTED


def test_ordinals_count_per_kind(samples):
    rows = detect_entities(samples, "text", "id").filter("id = 8").orderBy("ordinal").collect()
    assert [(r["ordinal"], r["match"]) for r in rows] == [(0, "a@b.co"), (1, "a@b.co"), (2, "xa@b.co")]


def test_mask_tokens_and_counts(samples):
    got = by(mask_entities(samples, "text").collect(), "id")
    assert got[1]["masked"] == "Reach me at [EMAIL] or [PHONE]."
    assert got[2]["masked"] == "SSN [SSN], card [CARD], host [IPV4]."
    assert got[3]["masked"] == "[PLATE] and [ACCOUNT] near [ADDRESS] today."
    assert got[4]["masked"] == "[SECRET] [SECRET] end" and got[4]["n_secret"] == 2 and got[4]["n_email"] == 0
    assert got[5]["masked"] == SAMPLES[5] and got[5]["entity_count"] == 0
    assert got[6]["masked"] is None and got[7]["masked"] == ""
    assert got[8]["masked_chars"] == 6 + 6 + 7


def test_pseudonyms_are_stable_and_exact(samples):
    got = by(mask_entities(samples, "text", salt="s").collect(), "id")

    def token(text):
        return f"[EMAIL:{hashlib.sha256(('s' + text).encode()).hexdigest()[:12]}]"

    # one match being part of another must not confuse the replacement
    assert got[8]["masked"] == f"twice {token('a@b.co')} {token('a@b.co')} and {token('xa@b.co')}"
    assert got[5]["masked"] == SAMPLES[5]


def test_rescan_of_masked_text_is_empty(samples):
    masked = mask_entities(samples, "text")
    assert {r["n"] for r in masked.select(residual_count(F.col("masked")).alias("n")).collect()} == {0}
    assert detect_entities(masked.select("id", "masked"), "masked", "id").count() == 0


def test_anonymize_routes_by_retained_share(spark):
    rows = [(1, FILLER + "mail a@b.co", 0), (2, "a@b.co", 0), (3, "a@b.co", 2), (4, FILLER, 1)]
    got = by(anonymize_text(spark.createDataFrame(rows, "id int, text string, retry_count int"), "text").collect(), "id")
    assert got[1]["route"] == "final_clean" and got[1]["failure_reason"] is None
    assert (got[2]["route"], got[2]["retry_count"]) == ("quarantine", 1)
    assert (got[3]["route"], got[3]["retry_count"]) == ("manual_review", 3)
    assert got[4]["source_sha256"] == got[4]["output_sha256"] == hashlib.sha256(FILLER.encode()).hexdigest()
    assert all("text" not in r.asDict() for r in got.values())


def test_residual_text_fails(spark):
    # a caller's replacement table that misses a kind: re-scan with all kinds finds it
    few = {"EMAIL": PATTERNS["EMAIL"]}
    frame = spark.createDataFrame([(1, FILLER + "10.1.1.1 a@b.co")], "id int, text string")
    masked = mask_entities(frame, "text", few)
    assert masked.select(residual_count(F.col("masked")).alias("n")).first()["n"] == 1


def test_extra_rule_and_settings(spark):
    frame = spark.createDataFrame([(1, "a@b.co only", 0)], "id int, text string, retry_count int")
    loose = Settings(retained_ratio_min=0.1)
    assert anonymize_text(frame, "text", loose).first()["route"] == "final_clean"
    ruled = anonymize_text(frame, "text", loose, qa_rules={"any_entity": F.col("entity_count") > 0}).first()
    assert ruled["route"] == "quarantine" and ruled["failure_reason"] == "rule:any_entity"


def test_no_python_and_no_shuffle_in_plan(samples):
    plan = anonymize_text(samples, "text")._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Exchange" not in plan


def test_long_text_is_scanned_to_the_end(spark):
    text = "word " * 40_000 + "end@example.org"
    got = mask_entities(spark.createDataFrame([(1, text)], "id int, text string"), "text").first()
    assert got["entity_count"] == 1 and got["masked"].endswith("[EMAIL]")


def test_filter_on_the_result_does_not_repeat_the_patterns(samples):
    audit = anonymize_text(samples, "text")
    plan = audit.filter("final_decision = 'pass' and entity_count > 0").select("id", "masked")
    text = plan._jdf.queryExecution().optimizedPlan().toString()
    assert text.count("regexp_extract_all(text#") == 1 and text.count("split(text#") == 1


# Runs that go on beyond what their kind allows, and what is left of the text.
WHOLE = {
    "plate ABC1234567X9 here": "[PLATE] here",
    "at 123456789 Main Street": "at [ADDRESS]",
    "at 12 Oak Ave, Apt 12345BC.": "at [ADDRESS].",
    "host 10.20.30.4567 up": "host [IPV4] up",
    "host 10.20.30.40.50 up": "host [IPV4] up",
    "no 123-45-67890.": "no [SSN].",
    "no 1123-45-6789-0 x": "no [SSN] x",
    "account: 12-34-56-78": "[ACCOUNT]",
    "acct #123456789012345-9": "[ACCOUNT]",
    "(555) 123-45678": "[PHONE]",
    "+1 (5555) 123-4567-89 x": "[PHONE] x",
    "call 555-123-4567": "call [PHONE]",
    "4111 1111 1111 1111": "[CARD]",
    "4111-1111-1111-1111 ok": "[CARD] ok",
    "3782 822463 10005": "[CARD]",
    "4111 1111 1111 1111 2222 3": "[CARD]",
    "94111 1111 1111 1111 1111": "[CARD]",
    "years 2019 2020 2021 2022": "years 2019 2020 2021 2022",
    '{"password": "hunter2"}': "{[SECRET]}",
    "{'api_key': 'a b c', 'n': 1}": "{[SECRET], 'n': 1}",
    '{"token": "say \\"hi\\" now", "n": 1}': '{[SECRET], "n": 1}',
    '{\\"secret\\": \\"x\\"} y': "{[SECRET] y",
    "a@b.co1 and x@y.example.org-9": "[EMAIL] and [EMAIL]",
    "root@10.0.0.1": "[EMAIL]",
    "mail j.d@sub.host.example.museum.": "mail [EMAIL].",
    "2024-10-23 12:00": "2024-10-23 12:00",
    "v1.2.3": "v1.2.3",
}


def test_a_run_is_an_entity_or_nothing_of_it_is(spark):
    frame = spark.createDataFrame(list(enumerate(WHOLE)), "id int, text string")
    got = {r["text"]: r["masked"] for r in mask_entities(frame, "text").collect()}
    assert got == WHOLE
    left = mask_entities(frame, "text").select(residual_count(F.col("masked")).alias("n"))
    assert left.agg(F.sum("n")).first()[0] == 0


def test_scores_tell_sure_from_over_long(spark):
    rows = [(1, "10.0.0.1"), (2, "10.0.0.999"), (3, "4111111111111111"), (4, "4111111111111112"), (5, "123-45-6789"), (6, "123-45-67890")]
    got = {r["id"]: r["score"] for r in detect_entities(spark.createDataFrame(rows, "id int, text string"), "text", "id").collect()}
    assert got == {1: 1.0, 2: 0.9, 3: 1.0, 4: 0.9, 5: 1.0, 6: 0.9}


def test_rescan_sees_a_mask_inside_a_longer_word(spark):
    rows = [("x[SSN] y", 1), ("[SSN]7", 1), ("[SSN] 7", 0), ("[EMAIL:0123456789ab]7", 1), ("([SSN])", 0)]
    frame = spark.createDataFrame(rows, "t string, want int")
    assert all(r["n"] == r["want"] for r in frame.select("want", residual_count(F.col("t")).alias("n")).collect())
    torn = anonymize_text(spark.createDataFrame([(1, FILLER + "ref A123-45-6789")], "id int, text string"), "text").first()
    assert torn["route"] == "quarantine"


@pytest.mark.parametrize("run", ["1111 ", "1-", "1.", "a", "a@", '"password": "' + "\\\\n", "acct: 12-", "(", "plate A"])
def test_long_runs_are_linear_and_do_not_overflow(spark, run):
    text = run * 40_000
    row = mask_entities(spark.createDataFrame([(1, text)], "id int, text string"), "text").first()
    assert row["masked"] is not None


def test_java_and_common_forms_find_the_same(spark):
    texts = [*WHOLE, *(s for s in SAMPLES.values() if s), "x" * 50 + "@a.b", "a@b", "1.2.3.4.", '"token":"' + "\\\\x" * 50]
    frame = spark.createDataFrame([(t,) for t in texts], "t string")
    both = frame.select(*[F.regexp_extract_all("t", F.lit(p), F.lit(0)) for p in (any_pattern(), any_pattern(all_linear(PATTERNS)))])
    assert all(a == b for a, b in both.collect())


def test_masks_of_texts_that_hold_the_mark(spark):
    """A text is searched once, with marks around its runs; one that holds the mark already comes out the same around it."""
    from redactflow.operators.text import MARK, mask_entities

    body = "{0}a@b.co {0}10.0.0.1{0} token: x1 and 4111 1111 1111 1111, 4111 1111 1111 1112 end{0}"
    rows = [(0, body.format("")), (1, body.format(MARK)), (2, None), (3, ""), (4, "no run here"), (5, "a@b.co")]
    out = mask_entities(spark.createDataFrame(rows, "id int, text string"), "text")
    assert "regexp_replace" in out._jdf.queryExecution().optimizedPlan().toString()
    got = {r["id"]: (r["masked"], r["entity_count"]) for r in out.collect()}
    want = "{0}[EMAIL] {0}[IPV4]{0} [SECRET] and [CARD], 4111 1111 1111 1112 end{0}"
    assert got[0] == (want.format(""), 4) and got[1] == (want.format(MARK), 4)
    assert [got[i] for i in (2, 3, 4, 5)] == [(None, 0), ("", 0), ("no run here", 0), ("[EMAIL]", 1)]
