"""Compatible forms and full case folding against the standard library's."""

import random
import re
import unicodedata

from pyspark.sql import functions as F

from loomrank.functions import text as T
from loomrank.operators import profile as R


def brute_tokens(text):
    out = []
    for raw in re.findall(r"[^\W_][\w+#.-]*", brute(text).casefold()):
        token = raw.strip(".-")
        if len(token) > 1 and token not in T.STOP_WORDS and not re.fullmatch(r"\d+", token):
            out.append(token)
    return out


def brute(text):
    return unicodedata.normalize("NFKC", text).replace("\x00", " ").replace("­", "")


def test_forms_of_all_scripts(spark):
    """Every assigned character below the planes of ideographs, in runs of 64 and alone where a form differs."""
    alone = [c for i in range(0x20000) if unicodedata.category(c := chr(i)) not in ("Cn", "Cs", "Co") and (unicodedata.normalize("NFKC", c) != c or c.casefold() != c)]
    every = [chr(i) for i in range(0x20000) if unicodedata.category(chr(i)) not in ("Cn", "Cs", "Co")]
    texts = alone + ["".join(every[i : i + 64]) for i in range(0, len(every), 64)] + ["", "plain ASCII", "é ạ̇"]
    df = T.normalised(spark.createDataFrame(list(enumerate(texts)), "i long, text string"), "text").select("i", "text", T.full_casefold(F.col("text")).alias("folded"))
    got = {r.i: r for r in df.collect()}
    assert len(alone) > 5000
    assert [got[i].text for i in range(len(texts))] == [brute(t) for t in texts]
    assert [got[i].folded for i in range(len(texts))] == [brute(t).casefold() for t in texts]


def test_tokens_of_mixed_texts(spark):
    rng = random.Random(3)
    pool = list("abcXYZ019_+#.- \n") + list("ﬁﬀⅧß①²½ẞΣςÉéİıǅｶﾞＡｂ가한漢字عربيह­\x00́")
    texts = ["".join(rng.choice(pool) for _ in range(rng.randint(0, 60))) for _ in range(400)] + [None]
    df = T.normalised(spark.createDataFrame(list(enumerate(texts)), "i long, text string"), "text")
    got = df.select("i", T.full_casefold(F.col("text")).alias("text")).select("i", T.folded_tokens(F.col("text")).alias("toks")).collect()
    numeric = re.compile(r"[^\W\d_]|\d")  # numbers that are no digits count as bare numbers here
    for r in got:
        if texts[r.i] is not None:
            assert [t for t in r.toks if numeric.search(t)] == [t for t in brute_tokens(texts[r.i]) if numeric.search(t)]
    assert got[-1].toks is None


def test_offsets_and_quotes_agree_once_normalised(spark):
    text = "Ｓａｍ\n\nExperience\nﬁrmware work, Acme   May 2025 - Aug 2025\n- Used Ｐｙｔｈｏｎ\n"
    p = T.normalised(spark.createDataFrame([(1, text)], "rid long, text string"), "text")
    blocks = R.blocks_of(p)
    plain = brute(text)
    for b in blocks.collect():
        assert plain[b.start : b.stop] == b.text
    assert {r.skill for r in R.claims_of(p, blocks).collect()} >= {"Python"}


def test_ordered_distinct(spark):
    df = spark.createDataFrame([(1, ["b", " a", "b", "", None, " ", "a", " a"]), (2, []), (3, None)], "i long, v array<string>")
    got = {r.i: r.v for r in df.select("i", T.ordered_distinct(F.col("v")).alias("v")).collect()}
    assert got == {1: ["b", " a", " ", "a"], 2: [], 3: []}
