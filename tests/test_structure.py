"""Small cases of profiles, pages, judgements, memo tables, documents and merges."""

import io
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from loomrank.functions import skills
from loomrank.operators import board, criteria, eligibility, profile, providers
from loomrank.plans import crawl, profiles
from loomrank.sources import board_pages, documents
from tests.test_queries import SF

TEXT = "Kim Example\n\nEDUCATION\nHill College 2019 - 2023\n\nExperience\nBaker, Old Mill   Jan 2020 - Mar 2020\n- Ran the ovens with Python\n- Sold bread\nRider, Post Office\n* Rode in c++\nlower case goes on\nSkills\nGo, R\nExcel"


def blocks(spark, text):
    return [r.asDict() for r in profile.blocks_of(spark.createDataFrame([(1, text)], "rid long, text string")).orderBy("block").collect()]


def test_blocks(spark):
    got = blocks(spark, TEXT)
    assert [(b["kind"], b["text"].split("\n")[0]) for b in got] == [("header", "Kim Example"), ("education", "Hill College 2019 - 2023"), ("experience", "Baker, Old Mill   Jan 2020 - Mar 2020"), ("experience", "Rider, Post Office"), ("skills", "Go, R")]
    assert got[2]["bullets"] == ["Ran the ovens with Python", "Sold bread"]
    assert all(TEXT[b["start"] : b["stop"]].startswith(b["text"].split("\n")[0]) for b in got)


def test_inline_labels_only_without_headings(spark):
    assert [b["kind"] for b in blocks(spark, "Ann\nSkills: sql\nTools: git")] == ["header", "skills", "skills"]
    assert [b["kind"] for b in blocks(spark, "Ann\nSkills\nsql\nResearch: git")] == ["header", "skills"]


@pytest.mark.parametrize(("line", "title", "organization"), [("Cook, Blue Inn", "Cook", "Blue Inn"), ("Blue Inn, Rome — Software Engineer", "Software Engineer", "Blue Inn, Rome"), ("Blue Inn - Rome", "Blue Inn", "Rome"), ("Tutor", "Tutor", "")])
def test_headlines(spark, line, title, organization):
    got = spark.range(1).select(profile.headline_parts(F.lit(line)).alias("h")).first().h
    assert (got.title, got.organization) == (title, organization)


@pytest.mark.parametrize(("text", "want"), [("Oct 2021 – Jan 2022", 4), ("03/2020 - 05/2020", 3), ("2020 to 2021", 13), ("Summer 2024 - Present", None), ("May 2021 - Apr 2021", None), ("no date", None)])
def test_months(spark, text, want):
    assert spark.range(1).select(profile.date_range(F.lit(text))["months"]).first()[0] == want


def test_skills(spark):
    one = lambda t: spark.range(1).select(skills.skills_of(F.lit(t))).first()[0]
    assert one("C/C++ and node js; we go on") == ["C", "C++", "Node.js"]
    assert one("Languages: R, Go\nrust") == ["Go", "R", "Rust"]
    assert one("javascript gitlab") == ["JavaScript"] and one(None) == []


def test_chunks_end_with_listed_skills(spark):
    got = profiles.profile_chunks(spark, SF).where("rid = 1").orderBy("ord").collect()
    assert [r.ord for r in got] == list(range(1, len(got) + 1)) and got[-1].weight == 0.3 and got[0].chunk.startswith("Data Engineer")


def test_scores_of_criteria(spark):
    rows = [(1, "technical", "must", "direct", None), (2, "technical", "must", "direct", None), (2, "eligibility", "must", "conflict", None), (3, "technical", "must", "direct", 1.0), (3, "domain", "preferred", "missing", None)]
    df = spark.createDataFrame(rows, "job long, category string, importance string, status string, recency double")
    jobs = spark.createDataFrame([(1, None), (2, 0.0), (3, 1.0), (4, None)], "job long, preference double")
    got = {r.job: r for r in criteria.score_jobs(df, jobs).collect()}
    assert (got[1].score, got[1].eligibility, got[1].must_have_coverage) == (100.0, "needs_review", 1.0)
    assert got[2].score == 20.0 and got[2].eligibility == "conflict" and got[2].breakdown["qualification_cap"] == -70.0
    assert got[3].score == pytest.approx(80 * 35 / 60 + 20, abs=0.01) and set(got[3].breakdown) == {"technical", "domain", "recency", "preferences"}
    assert got[4].score == 0.0 and got[4].must_have_coverage is None
    assert all(r.score == pytest.approx(sum(r.breakdown.values()), abs=0.011) for r in got.values())


def test_near_ties(spark):
    scores = [90.0, 89.0, 80.0, 79.5, 79.0, 50.0, 49.0, 0.0, 0.0]
    top = spark.createDataFrame([(i + 1, s, "conflict" if i == 5 else "") for i, s in enumerate(scores)], "rank long, score double, eligibility string")
    assert criteria.near_ties(top, 4, 6) == [(3, 4), (0, 1)]
    got = {r.rank: r.score for r in criteria.swapped(top, [(0, 1)], lambda a, b: "A" if a.score < b.score else "B").collect()}
    assert got[1] == 89.0 and got[2] == 90.0
    assert criteria.swapped(top, [(0, 1)], lambda a, b: "A").where("rank = 1").first().score == 90.0
    assert crawl.near_tie_order(spark, SF).count() == 102


def test_merge_keeps_details(spark):
    rows = [("a", 1, "t", None, {"k": "1", "detail_status": "complete", "detail_collected_at": "s1"}), ("a", 2, "", True, {"k": "", "m": "2", "detail_status": "pending", "detail_collected_at": "s2"}), ("b", 1, "", None, {"detail_status": "failed"}), ("b", 2, "x", False, {}), ("c", 1, "y", None, None)]
    df = spark.createDataFrame(rows, "id string, seq long, title string, is_open boolean, metadata map<string,string>")
    df = df.select("*", *[F.lit("").alias(c) for c in board.FIELDS if c != "title"])
    got = {r.id: r for r in board.merge_board(df).collect()}
    assert (got["a"].title, got["a"].is_open, got["a"].metadata, got["a"].detail_status, got["a"].detail_collected_at) == ("t", True, {"k": "1", "m": "2"}, "complete", "s1")
    assert (got["b"].title, got["b"].is_open, got["b"].detail_status) == ("x", False, "failed") and got["c"].detail_status == "pending"


def test_incomplete_crawls_retire_nothing(spark):
    rows = spark.createDataFrame([("a", True), ("b", True)], "id string, on_board boolean")
    pages = spark.createDataFrame([("a",)], "id string")
    good = spark.createDataFrame([("complete", "")], "detail_status string, warning string")
    assert board.is_complete(pages, good, 1) and not board.is_complete(pages, good, 2)
    assert not board.is_complete(pages, good.unionByName(spark.createDataFrame([("complete", "w")], good.schema)), 1)
    assert {r.id: r.on_board for r in board.retired(rows, pages, True).collect()} == {"a": True, "b": False}
    assert board.retired(rows, pages, False).where("on_board").count() == 2


def test_duplicates_merge(spark):
    rows = [(1, "k", "short", True), (2, "k", "longer text", False), (3, "k", "longer tex2", False), (4, None, "x", False)]
    df = spark.createDataFrame(rows, "pos long, key string, text string, closed boolean")
    got = {r.key: r for r in eligibility.merged_duplicates(df).collect()}
    assert (got["k"].pos, got["k"].first_pos, got["k"].closed, got["k"].copies) == (2, 1, True, 3)


def test_answers_are_checked_and_remembered(spark):
    rows = spark.createDataFrame([("a", "first text of all"), ("b", "second text"), ("c", "third text")], "key string, payload string")
    memo = spark.createDataFrame([("a", json.dumps({"requirements": [{"quote": "first  text"}]})), ("b", json.dumps({"requirements": [{"quote": "not in there"}]}))], "key string, value string")

    def call(payload, feedback):
        return json.dumps({"requirements": [{"quote": payload if feedback or "third" not in payload else "made up words"}]})

    out, known = providers.answered(rows, memo, call, providers.quotes_hold)
    got = {r.key: r for r in out.collect()}
    assert got["a"].cached and not got["b"].cached and not got["c"].cached and "third text" in got["c"].value
    assert {r.key for r in known.collect()} == {"a", "b", "c"} and "second text" in known.where("key = 'b'").first().value
    assert providers.judged_once(json.dumps({"requirements": [1, 2]}), json.dumps({"judgements": [{"index": 1, "status": "direct"}]}))
    assert not providers.judged_once(json.dumps({"requirements": [1]}), json.dumps({"judgements": [{"index": 1, "status": "direct"}]}))


def test_models_that_fail_cost_nothing(spark):
    df = spark.createDataFrame([("a", "x y"), ("b", None)], "id string, text string")
    got = {r.id: r.vector for r in providers.embedded(df, "id", "text", lambda ts: [[3.0, 4.0] for _ in ts]).collect()}
    assert got == {"a": [0.6, 0.8], "b": [0.6, 0.8]}
    assert all(r.vector is None for r in providers.embedded(df, "id", "text", None).collect())
    assert {r.logit for r in providers.reranked(df, "id", "text", "q", lambda q, ts: [float(len(t)) for t in ts]).collect()} == {3.0, 0.0}
    assert all(r.logit is None for r in providers.reranked(df, "id", "text", "q", lambda q, ts: 1 / 0).collect())


def docx(body, **parts):
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main" xmlns:mc="http://schemas.openxmlformats.org/markup-compatibility/2006"'
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f"<w:document {w}><w:body>{body}</w:body></w:document>")
        for name, text in parts.items():
            z.writestr(name.replace("__", "/").replace("_X", "."), text)
    return out.getvalue()


def test_documents(spark, tmp_path):
    run = lambda t, p="": f"<w:r><w:rPr>{p}</w:rPr><w:t>{t}</w:t></w:r>"
    body = f"<w:p>{run('Shown ')}{run('unseen', '<w:vanish/>')}<w:del>{run('gone')}</w:del>{run('end')}</w:p><w:p><mc:AlternateContent><mc:Choice>{run('one')}</mc:Choice><mc:Fallback>{run('two')}</mc:Fallback></mc:AlternateContent></w:p>"
    assert documents.docx_text(docx(body)) == "Shown end\none"
    for bad in (docx(body, word__vbaProject_Xbin="x"), docx("<w:p>" * 120 + "</w:p>" * 120)):
        with pytest.raises(documents.BadDocument):
            documents.docx_text(bad)
    (tmp_path / "a.md").write_text("# Me\n" + "word " * 50)
    (tmp_path / "b.docx").write_bytes(docx(body))
    (tmp_path / "c.bin").write_bytes(b"\x00\x01")
    got = {r.path.rsplit("/", 1)[1]: r for r in documents.read_documents(spark, f"file://{tmp_path}").collect()}
    assert got["a.md"].text.startswith("# Me") and got["a.md"].warnings == []
    assert got["b.docx"].text == "Shown end\none" and got["b.docx"].warnings == ["very little text"]
    assert got["c.bin"].text is None and got["c.bin"].error


def test_pages_of_the_board():
    row = '<tr><td><input name="dataViewerSelection" value="77"><a href="#">Pick</a></td><td>Org</td></tr>'
    got = board_pages.listing(f"<table><tr><th>Position</th><th>Employer</th></tr>{row}{row}</table><a rel=next disabled>Next</a> 1 results")
    assert [(r["id"], r["title"], r["company"]) for r in got["rows"]] == [("77", "Pick", "Org")] and got["total"] == 1 and got["at_end"] and not got["has_next"]
    assert board_pages.listing("<p>No results found")["empty"] and board_pages.listing("")["rows"] == []
    assert board_pages.detail("<div id=jobPosting>12 <h3>Requirements</h3><p>x", "1") is None
    got = board_pages.detail("<div id=jobPosting>12 <h3>Requirements</h3><p>x</p><p>y</p><h3>City</h3><p>Rome</p><p>more</p>", "12")
    assert got["requirements"] == "x\ny" and got["location"] == "Rome"


def test_a_model_is_asked_once_a_row(spark, tmp_path):
    """However often result and memo are read."""
    rows = spark.createDataFrame([("a", "first text of all"), ("b", "second text of all")], "key string, payload string")
    memo = spark.createDataFrame([], "key string, value string")
    log = tmp_path / "calls"

    def call(payload, feedback):
        with open(log, "a") as f:
            f.write(payload + "\n")
        return json.dumps({"requirements": [{"quote": payload}]})

    out, known = providers.answered(rows, memo, call, providers.quotes_hold)
    for _ in range(2):
        assert out.count() == known.count() == 2
    assert sorted(log.read_text().splitlines()) == ["first text of all", "second text of all"]


def test_a_block_is_the_slice_of_its_text(spark):
    from loomrank.operators import profile

    text = "Sam\n\nExperience\nEngineer, Acme   May 2024 - August 2024\n- one\n\n  \n- two\n\nSkills\nPython"
    got = profile.blocks_of(spark.createDataFrame([(1, text)], "rid long, text string")).collect()
    assert any(r.text.endswith("- one\n\n  \n- two") and r.bullets == ["one", "two"] for r in got)
    assert all(text[r.start : r.stop] == r.text for r in got)
