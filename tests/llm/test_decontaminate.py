import hashlib
import random
import re
from pathlib import Path

from pyspark.sql import functions as F

from strandloom.llm import decontaminate as D
from strandloom.llm.queries import op4_decontaminate
from strandloom.scratch import shared_folder
from tests.llm.cases import collected, documents, prose

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(text, items):
    w = words(text)
    hit, found = set(), set()
    for item, t in items:
        own = words(t)
        size = min(10, len(own))
        grams = {tuple(own[k : k + size]) for k in range(len(own) - size + 1)} if own else set()
        for k in range(len(w) - size + 1) if own else ():
            if tuple(w[k : k + size]) in grams:
                hit.update(range(k, k + size))
                found.add(str(item))
    return len(w), len(hit), sorted(found)


def tables(spark):
    docs = documents(spark)
    rng = random.Random(3)
    rows = [r.asDict() for r in docs.collect()]
    items = [(k, prose(rng, rng.randrange(1, 40))) for k in range(12)] + [(12, None), (13, ""), (14, "one"), (15, "TWO, words!"), (None, "one")]
    items += [(20, " ".join(rows[5]["text"].split()[:14])), (21, items[0][1])]
    for k in range(10, 30):
        i = rng.randrange(12)
        cut = rng.randrange(0, 4)
        rows[k]["text"] += " " + " ".join(items[i][1].split()[cut:]).upper() + ". " + rows[k]["text"][:50]
    schema = docs.schema
    return spark.createDataFrame([tuple(r.values()) for r in rows], schema), items, spark.createDataFrame(items, "item_id long, text string")


def test_against_brute_force(spark, tmp_path):
    docs, items, bench = tables(spark)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    bench.write.parquet(f"{tmp_path}/benchmark.parquet")
    got = collected(op4_decontaminate(spark, str(tmp_path)))
    rows = docs.collect()
    assert len(got) == len(rows)
    for r in rows:
        n, hit, found = brute(r.text, items)
        out = got[r.doc_id]
        assert (out.n_words, out.n_hit, out.n_items, out.contaminated) == (n, hit, len(found), hit > 0)
        assert out.items_sha256 == hashlib.sha256(",".join(found).encode()).hexdigest()
    assert sum(r.contaminated for r in got.values()) > 15


def test_blocks_agree_and_spans_go(spark):
    docs, items, bench = tables(spark)
    whole = collected(D.find_contamination(docs, bench))
    folder = Path(shared_folder(spark).removeprefix("file://"))
    before = set(folder.glob("*/scanned-*"))
    # about 200 bytes of items a block: items of more are cut, blocks are many, and one table is left
    parts = collected(D.find_contamination(docs, bench, broadcast_bytes=200 * D.INDEX_BYTES))
    assert len(set(folder.glob("*/scanned-*")) - before) == 1
    assert {k: (r.n_words, r.hits, r.items) for k, r in whole.items()} == {k: (r.n_words, r.hits, r.items) for k, r in parts.items()}
    clean = collected(D.find_contamination(docs, bench, remove_spans=True))
    for k, r in clean.items():
        assert len(words(r.text)) == whole[k].n_words - sum(e - s for s, e in whole[k].hits)
        if not whole[k].contaminated:
            assert r.text == whole[k].text or (r.text or "") == (whole[k].text or "")


def test_index_holds_each_window_once_within_its_bound():
    rng = random.Random(5)
    texts = [prose(rng, rng.randrange(5, 60)) for _ in range(40)]
    items = [(k, t) for k, t in enumerate([*texts, *texts[:10], "a b c d e f g h i j k " * 30])]
    index = D.build_windows(items)
    want = {}
    for k, t in items:
        w = words(t)
        n = min(10, len(w))
        for i in range(len(w) - n + 1):
            want.setdefault("".join(f"{x} " for x in w[i : i + n]).encode(), set()).add(str(k))
    assert {index.text(k): {*index.items_of(k)} for k in range(len(index.hashes))} == want
    assert all(index.find(index.hashes[k], index.text(k)) == k for k in range(len(index.hashes))) and index.find(index.hashes[0], b"no ") == -1
    assert index.n_bytes - index.bitmap.nbytes <= D.INDEX_BYTES * sum(len(t.encode()) + 16 for _, t in items)


def test_empty_tables_and_clashing_names(spark):
    docs, _, bench = tables(spark)
    assert D.find_contamination(docs.limit(0), bench).count() == 0
    out = D.find_contamination(docs.withColumn("hits", F.lit(1)).withColumn("_text", F.lit("x")), bench.limit(0)).collect()
    assert len(out) == docs.count() and not any(r.contaminated for r in out) and out[0]["_text"] == "x"
