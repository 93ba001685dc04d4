import random
import re
from collections import Counter

from pyspark.sql import functions as F

from strandloom.llm import quality_rules as Q
from strandloom.llm.queries import op9_quality_rules
from tests.llm.cases import collected, documents, prose

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    w = WORD.findall(text)
    grams = [tuple(w[k : k + 8]) for k in range(len(w) - 7)]
    often = Counter(grams)
    covered = {k + j for k, g in enumerate(grams) if often[g] > 1 for j in range(8)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    n_dup = len(lines) - len(set(lines))
    failed = len(w) < 20 or 100 * len(covered) > 30 * len(w)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), n_dup, len(covered), failed


def test_against_brute_force(spark, tmp_path):
    rng = random.Random(9)
    rows = [r.asDict() for r in documents(spark).collect()]
    for k in range(20):
        base = prose(rng, 40)
        rows[k]["text"] = f"{base}\n{prose(rng, rng.randrange(60))}\n{base[: rng.randrange(len(base))]}\n{base} \x0b#a|b\x1c\u00a0c"
    rows[20]["text"] = "a b " * 30
    rows[21]["text"] = "z " * 8 + "y " * 9
    spark.createDataFrame([tuple(r.values()) for r in rows], documents(spark).schema).write.parquet(f"{tmp_path}/documents.parquet")
    got = collected(op9_quality_rules(spark, str(tmp_path)))
    for r in rows:
        out = got[r["doc_id"]]
        assert (out.n_words, out.word_chars, out.n_symbols, out.n_dup_lines, out.n_repeat_words, out.base_failed) == brute(r["text"]), r["doc_id"]
        assert not (out.base_failed and out.kept)


def test_verdict_is_the_same_in_any_order_and_way(spark):
    docs = documents(spark)
    stats = Q.statistics(docs)
    rules = [*Q.base_rules(), *Q.method_rules()]
    order = Q.plan_cascade(docs, rules)
    assert sorted(r.name for r in order) == sorted(r.name for r in rules)
    counts = Q.Counts(F.coalesce("text", F.lit("")), F.col("_words"), 8, Q.HELD)
    verdict = lambda rs: {r[0]: r[1] for r in stats.select("doc_id", Q.cascade(rs, counts).isNull()).collect()}
    assert verdict(order) == verdict(rules) == verdict(rules[::-1])
    kept = sorted(r.doc_id for r in Q.judge_quality(docs).filter("kept").collect())
    assert kept == sorted(r.doc_id for r in Q.drop_rejected(docs).collect()) == sorted(k for k, v in verdict(rules).items() if v)
    assert Q.drop_rejected(docs).columns == docs.columns and Q.drop_rejected(docs.limit(0)).count() == 0


def test_order_is_by_rejections_per_cost():
    names = ["a", "b", "c", "d"]
    assert Q.rated(names, [0.1, 0.1, 0.4, 0.0], [0.001, 0.2, 0.1, 0.0]) == ["a", "c", "b", "d"]
    # the noise of a timing does not count, and of equals the first given is first
    assert Q.rated(names, [0.1] * 4, [0.002, 0.001, 0.005, 0.0]) == names


def test_two_plans_of_clear_differences_are_one(spark):
    """A cheap rule that rejects much, a cheap one and a dear one that reject nothing."""
    rng = random.Random(6)
    docs = spark.createDataFrame([(k, prose(rng, 900) if k % 3 else "few words") for k in range(900)], "doc_id long, text string")
    dear = Q.Rule("dear", lambda c: (Q.repeat_words(c.words, 8) + Q.repeat_words(c.words, 4) + Q.stutter(c.words)) > 10**6)
    never = Q.Rule("never", lambda c: c.n_words < 0)
    rules = [dear, never, Q.base_rules()[0]]
    orders = [[r.name for r in Q.plan_cascade(docs, rules)] for _ in range(2)]
    assert orders == [["few_words", "never", "dear"]] * 2


def test_rules_after_a_rejection_are_not_computed(spark):
    fails = Q.Rule("fails", lambda c: F.raise_error(F.lit("computed")).cast("boolean"))
    docs = spark.createDataFrame([(1, "few words"), (2, None)], "doc_id long, text string")
    both = Q._of_text(F.col("text"), Q.QualityParams(), lambda c: Q.cascade([Q.base_rules()[0], fails], c))
    assert [r[0] for r in docs.select(both).collect()] == ["few_words"] * 2


def test_junk_goes_and_prose_stays(spark):
    rng = random.Random(2)
    good = " ".join("".join(rng.choice(["ther", "on", "ea", "in"]) for _ in range(3)) for _ in range(120))
    texts = [good, " ".join(w + "###" for w in good.split()), good.upper(), "same same " * 60, None, "", " | ".join(good.split())]
    out = collected(Q.judge_quality(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")))
    assert [out[k].kept for k in range(len(texts))] == [True, False, False, False, False, False, False]


def test_empty_table_and_clashing_names(spark):
    docs = documents(spark).withColumnsRenamed({"source": "kept", "lang": "_words"})
    assert Q.judge_quality(docs.limit(0)).count() == 0
    out = Q.judge_quality(docs)
    assert out.count() == docs.count() and dict(out.dtypes)["kept"] == "boolean"
