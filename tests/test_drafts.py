"""Profiles split by a model: golden cases."""

import json
from collections import Counter

import pytest

from loomrank.operators import drafts as D
from loomrank.operators import profile as R
from loomrank.operators import providers
from loomrank.plans import drafts as plans

TEXT = """Sam Example
sam@example.org

Education
Northern University   Sep 2021 - Apr 2026

Work Experience
Software Intern, Example Corp   May 2025 - Aug 2025
- Built an ingestion service
Research Helper, Northern University
- Kept notes

Skills
Python, SQL
"""
ITEM = {"block_id": "b3", "anchor": "Built  an ingestion\nservice", "kind": "work", "title": "Intern", "organization": "Example Corp", "months": 24, "technologies": ["Python"]}


def split(spark, answers, text=TEXT):
    rows = list(enumerate(answers))
    p = spark.createDataFrame([(i, text) for i, _ in rows], "rid long, text string")
    a = spark.createDataFrame([(i, x if isinstance(x, str) else json.dumps(x)) for i, x in rows if x is not None], "rid long, answer string")
    whole, experiences = D.assembled(p, R.blocks_of(p), a, 2026, 3)
    return {r.rid: r for r in whole.collect()}, experiences, p


def test_answers_hold_only_where_they_quote(spark):
    odd = [
        {"experiences": [ITEM]},
        {"experiences": [ITEM | {"block_id": "b99"}]},
        {"experiences": [ITEM, ITEM | {"anchor": "Led a team of forty engineers"}]},
        {"experiences": [ITEM | {"anchor": " "}]},
        {"experiences": [ITEM | {"anchor": None}]},
        {"experiences": [ITEM | {"block_id": "b4"}]},
        {"experiences": [ITEM | {"kind": "hobby"}]},
        {"experiences": [ITEM | {"months": 601}]},
        {"experiences": [ITEM] * 31},
        "[1, 2",
        None,
        {"experiences": None, "headline": None, "domains": None, "education": None, "availability": None},
    ]
    got, _, _ = split(spark, odd)
    wrong = "experience 1"
    assert [got[i].problem for i in range(12)] == [None, wrong, "experience 2", wrong, wrong, wrong, "misshapen", "misshapen", "misshapen", "misshapen", "no answer", None]
    assert got[11].source == "model" and got[11].warning == "no experiences" and got[11].headline == "" and got[11].n_experiences == 0
    rules = got[1]
    assert rules.source == "rules" and rules.headline == "Sam Example" and rules.n_experiences == 2 and rules.work_months == 4
    assert [(e.institution, e.graduation_year) for e in rules.education] == [("Northern University Sep 2021 - Apr 2026", "2026")]


def test_stated_dates_beat_the_model(spark):
    undated = {"block_id": "b4", "anchor": "Kept notes", "kind": "research", "months": 9}
    got, experiences, p = split(spark, [{"headline": "Second year", "experiences": [undated, ITEM], "availability": {"months": [4]}}])
    rows = experiences.orderBy("place").collect()
    assert [(r.kind, r.months, r.months_ago, r.block) for r in rows] == [("work", 4, 7, 3), ("research", 9, None, 4)]
    assert (got[0].total_months, got[0].work_months, got[0].months, got[0].headline) == (13, 4, [4], "Second year")
    claims = {r.skill: (r.tier, r.blocks) for r in D.placed_claims(p, R.blocks_of(p), experiences).collect()}
    assert claims["Python"] == (2, [3, 5]) and claims["SQL"] == (1, [5])


def test_long_texts_are_refused_not_cut(spark):
    texts = [(1, "x " * 30_000), (2, TEXT), (3, None), (4, "")]
    p = spark.createDataFrame(texts, "rid long, text string")
    blocks = R.blocks_of(p)
    requests = D.model_requests(p, blocks)
    got = {r.rid: r for r in requests.collect()}
    assert got[1].refused and got[1].payload is None and not got[2].refused and json.loads(got[3].payload) == json.loads(got[4].payload) == {"blocks": []}
    sent = json.loads(got[2].payload)["blocks"]
    assert [b["id"] for b in sent] == ["b1", "b2", "b3", "b4", "b5"] and sent[2]["kind"] == "experience" and "ingestion" in sent[2]["text"]
    whole, _ = D.assembled(p, blocks, spark.createDataFrame([(1, json.dumps({"experiences": []}))], "rid long, answer string"), 2026, 3)
    assert {r.rid: (r.problem, r.warning) for r in whole.collect()} == {1: ("refused", "no work"), 2: ("no answer", ""), 3: ("no answer", "no work"), 4: ("no answer", "no work")}


def test_a_model_is_told_what_was_wrong(spark):
    def call(payload, feedback):
        item = ITEM if feedback else ITEM | {"anchor": "invented"}
        return json.dumps({"experiences": [item]})

    p = spark.createDataFrame([(1, TEXT)], "rid long, text string")
    blocks = R.blocks_of(p)
    requests = D.model_requests(p, blocks)
    memo = spark.createDataFrame([], "key string, value string")
    out, _ = providers.answered(requests.selectExpr("rid as key", "payload"), memo, call, D.anchors_hold)
    whole, _ = D.assembled(p, blocks, out.selectExpr("cast(key as long) as rid", "value as answer"), 2026, 3)
    assert [(r.source, r.n_experiences) for r in whole.collect()] == [("model", 1)]


def test_empty_tables(spark):
    p = spark.createDataFrame([], "rid long, text string")
    whole, experiences = D.assembled(p, R.blocks_of(p), spark.createDataFrame([], "rid long, answer string"), 2026, 3)
    assert whole.count() == experiences.count() == D.placed_claims(p, R.blocks_of(p), experiences).count() == 0


@pytest.mark.parametrize("payload", [{"blocks": [{"id": "b1", "text": "a  b\nc"}]}])
def test_anchors_hold(payload):
    ask = lambda *items: D.anchors_hold(json.dumps(payload), json.dumps({"experiences": list(items)}))
    assert ask() == "" and ask({"block_id": "b1", "anchor": "b c"}) == ""
    assert "experience 2" in ask({"block_id": "b1", "anchor": "a b"}, {"block_id": "b2", "anchor": "a b"}) and ask({"block_id": "b1", "anchor": None})


def test_built_answers_meet_every_rule(spark):
    seen = Counter(r.problem for r in plans.model_profiles(spark, "/root/testdata/sf0.001").collect())
    assert set(seen) == {"", "refused", "no answer", "misshapen", "experience 1", "experience 2"}
