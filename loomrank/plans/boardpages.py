"""Queries over pages built from postings: what is read off a page is what was put on it."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomrank.functions.postings import BOARD
from loomrank.plans import inputs
from loomrank.sources import board_pages as G

HEAD = "<table><thead><tr><th>Job Title <i aria-hidden=\"true\">sort</i></th><th>Organization</th><th>City</th><th>App Deadline</th><th>Status</th></tr></thead>"
CELLS = "'</td><td>' || company || '</td><td> <b>' || location || '</b> </td><td>' || deadline || '</td><td>Open &amp; new</td></tr>'"
LISTING = f"""select pos as page, '<html><body><p>Showing 1 - 2 of 1,2' || cast(pos % 10 as string) || '0</p>' || case pos % 3 when 1 then '<div class="doc-viewer__card" data-job-id="' || cast(pos + 1000 as string) || '"><a href="jobs.htm?action=display&amp;jobId=' || cast(pos + 1000 as string) || '#x">Card ' || company || '</a><dl><dt>Employer:</dt><dd>' || company || '</dd><dt>City</dt><dd>' || location || '<dt>Deadline<dd>' || deadline || '</dl></div>'
 else '{HEAD}<tr style="display: none"><td><a class="overflow--ellipsis" href="jobs.htm?jobId=9">Unseen</a></td></tr><tr><td><a class="overflow--ellipsis" ' || case pos % 3 when 0 then 'href="/myAccount/jobs.htm?postingId=' || cast(pos + 1000 as string) || '"' else 'href="#" onclick="getPostingOverview(' || cast(pos + 1000 as string) || ')"' end || '>Row ' || company || {CELLS}
 || '<tr><td><a href="jobs.htm?jobId=' || cast(pos + 1000 as string) || '">Again</a>' || {CELLS} || '</table>' end || '<div class="pagination"><a href="#">1</a>' || case when pos % 2 = 0 then '<a href="#">Next</a>' else '<a class="disabled">Next</a>' end || '</div></body></html>' as html from p"""
DETAIL = """select pos as page, cast(pos + 1000 as string) as expected, '<div hidden>stale 1</div><div id="postingDiv"><h2>Posting ' || cast(case when pos % 7 = 0 then 5 else pos + 1000 end as string) || '</h2><table><tr><td>Job Title:</td><td>T ' || company || '</td></tr><tr><td>Job Location</td><td>' || location || '</td></tr></table>' || case when pos % 5 = 1 then '' else '<strong>Job Summary:</strong><p>Sum of ' || company || '</p><p>more</p>' end || '<div><b>Work Term:</b><div>2027 - Winter</div></div></div>' as html from p"""
LOGIN = f"""select pos as page, case pos % 4 when 0 then '{BOARD}' when 1 then 'https://elsewhere.example/x' when 2 then 'https://{G.HOST}/sso/' else 'https://{G.HOST}/home.htm' end as url, case pos % 3 when 0 then '<p>Your session has expired</p>' when 1 then '<p>Welcome</p>' else '<a>Sign in</a>' end as html from p"""
LINKS = f"""select pos as id, case pos % 8 when 0 then 'jobs.htm?jobId=' || cast(pos as string) || '#frag' when 1 then 'jobs.htm?jobId=x' when 2 then 'http://{G.HOST}/myAccount/jobs.htm' when 3 then 'https://{G.HOST}:443/myAccount/jobs.htm?action=View&page=2' when 4 then 'javascript:void(0)' when 5 then 'https://user@{G.HOST}/myAccount/jobs.htm' when 6 then 'jobs.htm?action=delete' else '/myAccount/jobs.htm?token=1' end as href from p"""


def pages(spark, sf_dir, sql):
    p = inputs.postings(spark, sf_dir)
    return spark.sql(sql.replace("from p", "from {p}"), p=p)


def listing_rows(spark, sf_dir):
    df = G.listing_rows(pages(spark, sf_dir, LISTING))
    return df.select("page", "id", "title", "company", "location", "deadline", "url", F.try_element_at("metadata", F.lit("posting_status")).alias("status"), "total", "has_next")


def detail_rows(spark, sf_dir):
    df = G.detail_rows(pages(spark, sf_dir, DETAIL))
    return df.select("page", "title", "description", F.try_element_at("metadata", F.lit("Work Term")).alias("term"))


def login_pages(spark, sf_dir):
    return G.page_states(pages(spark, sf_dir, LOGIN))


def safe_links(spark, sf_dir):
    return G.safe_urls(pages(spark, sf_dir, LINKS))


QUERIES = {f.__name__: f for f in (listing_rows, detail_rows, login_pages, safe_links)}
P = f"with p as ({inputs.POSTINGS_SQL})"
WS = lambda x: f"trim(regexp_replace({x}, '\\s+', ' ', 'g'))"
ORACLE_SQL = {
    "listing_rows": f"""{P} select pos as page, (pos + 1000)::varchar as id, trim(case pos % 3 when 1 then 'Card ' else 'Row ' end || company) as title, company, location, {WS('deadline')} as deadline,
 case pos % 3 when 0 then 'https://{G.HOST}/myAccount/jobs.htm?postingId=' || (pos + 1000) when 1 then 'https://{G.HOST}/myAccount/co-op/full/jobs.htm?action=display&jobId=' || (pos + 1000) else '{BOARD}#job-' || (pos + 1000) end as url, case when pos % 3 <> 1 then 'Open & new' end as status, 1200 + (pos % 10) * 10 as total, pos % 2 = 0 as has_next from p""",
    "detail_rows": f"{P} select pos as page, 'T ' || company as title, 'Sum of ' || company || chr(10) || 'more' as description, '2027 - Winter' as term from p where pos % 7 <> 0 and pos % 5 <> 1",
    "login_pages": f"{P} select pos as page, pos % 4 in (1, 2) or pos % 3 = 0 or (pos % 4 = 3 and pos % 3 = 2) as login from p",
    "safe_links": f"{P} select pos as id, case pos % 8 when 0 then 'https://{G.HOST}/myAccount/co-op/full/jobs.htm?jobId=' || pos when 3 then 'https://{G.HOST}/myAccount/jobs.htm?action=View&page=2' end as url from p",
}
