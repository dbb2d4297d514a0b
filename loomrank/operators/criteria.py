"""Rules over a model's judgements, and the score that follows from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomrank.functions import postings as P
from loomrank.functions import scores as S
from loomrank.functions.text import collapse

SUPPORTS = ["direct", "transferable"]


def checked_judgements(judged: DataFrame, spans: DataFrame) -> DataFrame:
    """``judged(job, idx, category, importance, status, quote)`` after the rules, with ``recency``.

    ``spans(job, block, evidence, recency, body)`` are the profile's blocks, collapsed. In this order: a quote that no block
    has makes a claim unknown; so does one outside evidence, but for eligibility and conflicts; a conflict stands only for a
    mandatory eligibility requirement; what is missing or unknown keeps neither quote nor recency. Each quote meets the
    blocks of its own job only, and takes the first that has it.
    """
    needle = collapse(F.col("quote"))
    claims = judged.withColumn("quote", needle)
    asked = claims.where(F.col("status").isin(*SUPPORTS, "conflict") & (F.length("quote") >= 8)).select("job", "idx", "quote")
    found = asked.join(spans, "job").where(F.instr("body", F.col("quote")) > 0)
    first = found.groupBy("job", "idx").agg(F.min(F.struct("block", "evidence", "recency")).alias("at"))
    df = claims.join(first, ["job", "idx"], "left")
    needs = F.col("status").isin(*SUPPORTS, "conflict")
    missing = needs & F.col("at").isNull()
    unproven = needs & F.col("at").isNotNull() & ~F.col("at.evidence") & (F.col("category") != "eligibility") & (F.col("status") != "conflict")
    status = F.when(missing | unproven, "unknown").otherwise(F.col("status"))
    mild = (status == "conflict") & ~((F.col("category") == "eligibility") & (F.col("importance") == "must"))
    status = F.when(mild, "unknown").otherwise(status)
    void = status.isin("missing", "unknown")
    warning = F.when(missing, "unverifiable").when(unproven, "unproven").when(mild, "mild").otherwise("")
    return df.select("job", "idx", "category", "importance", status.alias("status"), F.when(void, "").otherwise(F.col("quote")).alias("quote"), F.when(needs & ~void, F.col("at.recency")).alias("recency"), warning.alias("warning"))


def unmatched(required: DataFrame, judged: DataFrame) -> DataFrame:
    """``job, idx, problem``: requirements without a judgement, judgements without one, and repeated ones; none if each has one."""
    a = required.groupBy("job", "idx").agg(F.count("*").alias("asked"))
    b = judged.groupBy("job", "idx").agg(F.count("*").alias("given"))
    both = a.join(b, ["job", "idx"], "full_outer")
    problem = F.when(F.col("given").isNull(), "not judged").when(F.col("asked").isNull(), "not asked").when(F.col("given") > 1, "judged twice")
    return both.select("job", "idx", problem.alias("problem")).where("problem is not null")


def score_jobs(criteria: DataFrame, jobs: DataFrame) -> DataFrame:
    """One row a job of ``jobs(job, preference)``: its score with all that explains it.

    The evidence's budget is 100 less what preferences and recency can earn where they exist; categories share it by weight
    among those present. Each part is rounded before the sum, a conflict caps the sum by a negative part, and without an
    eligibility criterion the state is to be reviewed whatever else was found.
    """
    w, c = S.lookup(F.col("importance"), S.IMPORTANCE, 1.0), S.lookup(F.col("status"), S.CREDIT)
    supported, core = F.col("status").isin(SUPPORTS), F.col("category").isin(list(S.CATEGORY_WEIGHTS))
    must, dated = core & (F.col("importance") == "must"), F.col("status").isin(SUPPORTS) & F.col("recency").isNotNull()
    ratio = lambda when, value: F.sum(F.when(when, w * value)) / F.sum(F.when(when, w))
    aggs = [ratio(F.col("category") == n, c).alias(f"c_{n}") for n in S.CATEGORY_WEIGHTS]
    aggs += [ratio(must, c).alias("must_cover"), ratio(dated, F.col("recency")).alias("rec")]
    aggs += [F.count_if(F.col("importance") == "must").alias("must_have_count"), F.count_if(supported).alias("n_supported"), F.count_if(F.col("status") == "missing").alias("n_missing"), F.count("*").alias("n")]
    aggs += [F.max((F.col("status") == "conflict").cast("int")).alias("conflict"), F.max((F.col("category") == "eligibility").cast("int")).alias("has_eligibility"), F.max(((F.col("category") == "eligibility") & (F.col("status") == "unknown")).cast("int")).alias("open_eligibility")]
    df = jobs.join(criteria.groupBy("job").agg(*aggs), "job", "left")
    edge = lambda x, d: F.round(x + 1e-9, d)  # exact halves part engines
    present = sum((F.when(F.col(f"c_{n}").isNotNull(), F.lit(p)).otherwise(0) for n, p in S.CATEGORY_WEIGHTS.items()), F.lit(0))
    budget = 100 - F.when(F.col("preference").isNotNull(), S.PREFERENCE_POINTS).otherwise(0) - F.when(F.col("rec").isNotNull(), S.RECENCY_POINTS).otherwise(0)
    parts = {n: F.when(F.col(f"c_{n}").isNotNull(), edge(budget * p / present * F.col(f"c_{n}"), 2)) for n, p in S.CATEGORY_WEIGHTS.items()}
    parts |= {"recency": edge(S.RECENCY_POINTS * F.col("rec"), 2), "preferences": edge(S.PREFERENCE_POINTS * F.col("preference"), 2)}
    df = df.withColumns({f"p_{k}": v for k, v in parts.items()})
    total = F.round(sum((F.coalesce(F.col(f"p_{k}"), F.lit(0.0)) for k in parts), F.lit(0.0)), 2)
    df = df.withColumn("total", total).withColumn("capped", F.coalesce(F.col("conflict") == 1, F.lit(False)) & (F.col("total") > S.CONFLICT_CAP))
    score = F.when(F.col("capped"), F.lit(float(S.CONFLICT_CAP))).otherwise(F.col("total"))
    cap = F.when(F.col("capped"), F.round(S.CONFLICT_CAP - F.col("total"), 2))
    state = F.when(F.coalesce(F.col("has_eligibility"), F.lit(0)) == 0, "needs_review").when(F.col("conflict") == 1, "conflict").when(F.col("open_eligibility") == 1, "needs_review").otherwise("no_known_conflict")
    return df.select("job", score.alias("score"), P.present(**{k: F.col(f"p_{k}") for k in parts}, qualification_cap=cap).alias("breakdown"), state.alias("eligibility"), edge(F.col("must_cover"), 3).alias("must_have_coverage"), F.coalesce("must_have_count", F.lit(0)).alias("must_have_count"), F.coalesce(edge(F.col("n_supported") / F.col("n"), 3), F.lit(0.0)).alias("evidence_coverage"), edge(F.col("rec"), 4).alias("recency_alignment"))


def near_ties(top: DataFrame, limit: int, budget: int) -> list[tuple[int, int]]:
    """Places (from 0) of neighbours that are compared, of ``top(rank, score, eligibility)`` with at most a few hundred rows.

    Asked around the cut first, then from the top: pairs within the near-tie gap, neither of score 0 nor in conflict, and
    no row twice. Which pairs are free depends on those before, so the bounded rows are walked on the driver.
    """
    rows = top.select("score", "eligibility").orderBy("rank").limit(limit + 2).collect()
    used: set[int] = set()
    pairs: list[tuple[int, int]] = []
    for i in [limit - 1, limit - 2, limit, *range(min(12, len(rows) - 1))]:
        if len(pairs) >= budget:
            break
        if i < 0 or i + 1 >= len(rows) or used & {i, i + 1}:
            continue
        a, b = rows[i], rows[i + 1]
        if abs(a.score - b.score) <= S.NEAR_TIE and min(a.score, b.score) != 0 and "conflict" not in (a.eligibility, b.eligibility):
            used |= {i, i + 1}
            pairs.append((i, i + 1))
    return pairs


def swapped(top: DataFrame, pairs: list[tuple[int, int]], prefer) -> DataFrame:
    """``top(rank, ...)`` with neighbours changed where ``prefer(first, second)`` names the second in either order; scores stay."""
    rows = {r["rank"] - 1: r for r in top.where(F.col("rank").isin([i + 1 for p in pairs for i in p])).collect()}
    moved = {}
    for i, j in pairs:
        a, b = rows[i], rows[j]
        if prefer(a, b) == "B" and prefer(b, a) == "A":
            moved |= {i + 1: j + 1, j + 1: i + 1}
    if not moved:
        return top
    mapping = F.create_map(*[F.lit(x) for kv in moved.items() for x in kv])
    return top.withColumn("rank", F.coalesce(F.try_element_at(mapping, F.col("rank").cast("int")), F.col("rank").cast("int")).cast("long"))
