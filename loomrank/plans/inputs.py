"""Postings and profile texts built from the driver's tables, by one SQL text that both engines run.

Every document is a posting and every customer a profile; the phrases that rules look for are dealt by id, so that each
rule meets rows on both sides of it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: The moment that rules are asked about: local time of the zone, and the same in UTC.
NOW, NOW_UTC, ZONE = "2026-03-10 09:30:00", "2026-03-10 13:30:00", "America/Toronto"

POSTINGS = """select doc_id as pos,
 case when doc_id % 5 = 0 then '' else 'Job-' || cast(doc_id - doc_id % 3 as string) end as id,
 case doc_id % 6 when 0 then 'Firmware Developer' when 1 then 'Data Analyst (Winter)' when 2 then '' when 3 then 'Marketing assistant, 6-month term' else 'Role at ' || source end as title,
 source as company, coalesce(lang, '') as location,
 coalesce(text, '') || case doc_id % 17 when 0 then chr(10) || 'Skills: Python, C, SQL' when 1 then ' We use React.js, C++ and Docker.' when 2 then chr(10) || 'Tools: R; Go; git' when 3 then ' Some scrum, some GraphQL and node js.' else '' end as description,
 case doc_id % 19 when 0 then 'Applicants must hold Canadian citizenship.' when 1 then 'Citizenship is not required here.' when 2 then 'Funded by SWPP this year.' when 3 then 'Only consider students who are permanent residents; apply soon.'
  when 4 then 'Must be a Canadian citizen or hold a work permit.' when 5 then 'A twelve-month term is required.' when 6 then 'Four-month or 8 month terms, either is fine. Bring a laptop' when 7 then 'PR status preferred, citizens only encouraged' when 8 then 'See https://x.example/citizens-only for more' else '' end as requirements,
 case doc_id % 26 when 0 then '2026-03-10' when 1 then '2026-03-09' when 2 then 'Mar 10, 2026 9:15 AM' when 3 then 'March 10, 2026 at 9:45 AM (EST)' when 4 then 'soon' when 5 then '' when 6 then 'Apr 3rd, 2026' when 7 then '2026/02/11' when 8 then '10-Mar-2026' when 9 then '2026-03-10T13:00:00Z' when 10 then '2026-03-10T09:45:00-04:00'
  when 14 then '2026-03-09 09:15:00' when 15 then '2026-03-10T09:45' when 16 then '20260309' when 17 then '20260310T093100' when 18 then '2026-03-09T09:15:00.5+00:00' when 19 then '2026-03-10 09:45:00-04:00' when 20 then '2026-03-10T15:29+0200' when 21 then '2026-03-10T13:30:00.25Z' when 22 then '2026-02-30T09:00:00' when 23 then '20260310' when 24 then '2026-03-10T09' else '2027-01-05' end as deadline,
 case doc_id % 7 when 0 then 'HTTPS://Jobs.Example.com/A?id=' || cast(doc_id - doc_id % 2 as string) || '#top' when 1 then 'https://jobs.example.com/A?id=' || cast(doc_id - doc_id % 2 as string) else '' end as url,
 case doc_id % 23 when 0 then ' Closed ' when 1 then 'Posting  closed' when 2 then 'closing' else 'open' end as status,
 case when doc_id % 29 = 0 then false when doc_id % 3 = 0 then true end as is_open,
 case doc_id % 31 when 0 then 'FILLED' else '' end as m_status,
 case doc_id % 10 when 0 then '4 month work term' when 1 then 'Eight month placement' else '' end as m_term,
 case when doc_id % 8 = 0 then 'Overview' || chr(10) || 'Work Term Duration:' || chr(10) || '12 months' || chr(10) || 'More' else '' end as m_detail,
 cast(doc_id % 4 as int) as m_seats
 from {documents}"""

PROFILES = """select c_custkey as rid, 'Sam Example ' || cast(c_custkey as string) || chr(10) || 'sam@example.org'
 || case when c_custkey % 5 = 4 then chr(10) || 'Seeking a six-month position, Winter 2027. Experience: Built a data service in Python and Docker for the payments group of a bank. Skills: SQL, Linux, Rust and some Go programming' else
 chr(10) || chr(10) || '## EDUCATION' || chr(10) || 'Northern University, Physics   Sep 2021 - Apr 2026' || chr(10) || 'Research: optics' || chr(10)
 || case c_custkey % 3 when 0 then '**Work Experience**' when 1 then 'Experience:' else 'Internships' end || chr(10)
 || case c_custkey % 4 when 0 then 'Data Engineer, Acme Ltd   May 2024 - August 2024' when 1 then 'Acme Ltd, Toronto - Data Engineer (09/2023 - 12/2023)' when 2 then 'Acme Ltd — Analyst   Summer 2025 to Present' else 'Volunteer, Shelter, 2019-2020' end || chr(10)
 || '- Wrote pipelines in Python and SQL' || chr(10) || case when c_custkey % 6 < 2 then chr(10) || '  ' || chr(10) else '' end || '• Moved ' || cast(c_custkey % 50 as string) || ' services to Docker' || chr(10) || '  and kept them there' || chr(10)
 || 'Lab Assistant, Northern University   Winter 2023 – Fall 2023' || chr(10) || '1. Ran the linux cluster' || chr(10)
 || case when c_custkey % 2 = 0 then 'Projects' || chr(10) || 'Ray tracer' || chr(10) || '* Written in Rust' || chr(10) || 'Chess engine' || chr(10) || '* Search in C++' || chr(10) || 'wrapped line of text' || chr(10) else '' end
 || 'Technical Skills' || chr(10) || 'Python, SQL, Go, R' || chr(10) || 'Tools: git, Figma, GraphQL' || case when c_custkey % 7 = 0 then chr(10) || 'Available for an eight-month or 4 month term from 2026 Fall' else '' end end as text
 from {customer}"""


def postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(POSTINGS, documents=spark.read.parquet(f"{sf_dir}/documents.parquet"))


def profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Profiles, dealt out by id before their texts are built.

    The table of customers is a few bytes a row, so that hundreds of thousands lie in one split, and the patterns that
    follow would all run in its one task. Windows and groups by ``rid`` keep this dealing.
    """
    customer = spark.read.parquet(f"{sf_dir}/customer.parquet")
    return spark.sql(PROFILES, customer=customer.select("c_custkey").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "c_custkey"))


POSTINGS_SQL, PROFILES_SQL = POSTINGS.format(documents="documents"), PROFILES.format(customer="customer")
