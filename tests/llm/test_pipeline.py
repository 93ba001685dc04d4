import random
import re
from collections import defaultdict

import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline as C

PARTS = ["ther", "on", "ea", "in", "ing", "nd", "st", "re", "ha", "tion"]


def prose(rng, n):
    return ["".join(rng.choice(PARTS) for _ in range(rng.randrange(1, 4))) for _ in range(n)]


def tables(spark, folder):
    rng = random.Random(11)
    items = [prose(rng, 40) for _ in range(4)]
    passage = prose(rng, 70)
    texts, kinds = [], []

    def add(kind, words):
        texts.append(" ".join(words))
        kinds.append(kind)

    for _ in range(30):
        add("clean", prose(rng, rng.randrange(60, 160)))
    for k in range(10):
        add("copy", texts[k].split(" "))
    for k in range(10, 14):
        words = prose(rng, 900)
        add("base", words)
        words = [*words]
        words[400] = "edited"
        add("near", words)
    for _ in range(6):
        add("passage", [*prose(rng, 40), *passage, *prose(rng, 40)])
    for k in range(6):
        add("leak", [*prose(rng, 60), *items[k % 4], *prose(rng, 60)])
    add("junk", [w + "###" for w in prose(rng, 60)])
    add("junk", ["same"] * 80)
    add("junk", prose(rng, 6))
    rows = [(k, t, "en", f"src{k % 3}", len(t)) for k, t in enumerate(texts)] + [(len(texts), None, None, None, None), (len(texts) + 1, "", "en", "s", 0)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(k, " ".join(w)) for k, w in enumerate(items)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return texts, kinds, passage, items


def test_stages_against_what_was_planted(spark, tmp_path):
    folder = str(tmp_path)
    texts, kinds, passage, items = tables(spark, folder)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    schema = [(f.name, f.dataType) for f in docs.schema]
    kept = {}
    for k, (name, stage) in enumerate(C.STAGES):
        docs = stage(spark, docs, folder)
        if k < len(C.STAGES) - 1:
            assert [(f.name, f.dataType) for f in docs.schema] == schema, name
            docs.write.parquet(f"{folder}/stage{k}")
            docs = spark.read.parquet(f"{folder}/stage{k}")
            kept[name] = {r.doc_id: r.text for r in docs.collect()}
            assert all(r.n_chars == len(r.text) for r in docs.collect())
    by_kind = defaultdict(list)
    for k, kind in enumerate(kinds):
        by_kind[kind].append(k)
    first, second, third, last = kept.values()
    assert set(range(len(texts))) - set(first) == set(by_kind["junk"])
    assert set(first) - set(second) == set(by_kind["copy"] + by_kind["near"])
    whole = " ".join(passage)
    assert [k for k in third if whole in third[k]] == by_kind["passage"][:1]
    for k in by_kind["clean"]:
        assert last[k] == texts[k]
    grams = {tuple(w[i : i + 10]) for w in items for i in range(31)}
    for text in last.values():
        words = re.findall("[a-z]+", text)
        assert not any(tuple(words[i : i + 10]) in grams for i in range(len(words)))
    for k in by_kind["leak"]:
        assert len(last[k].split()) == 120
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    total = defaultdict(int)
    for r in docs.collect():
        total[r.doc_id] += r.length
    assert total == {k: len(tokenizer.encode(t, add_special_tokens=False).ids) + 1 for k, t in last.items()}


def test_run_equals_its_stages(spark, tmp_path):
    folder = str(tmp_path)
    tables(spark, folder)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for k, (_, stage) in enumerate(C.STAGES):
        docs = stage(spark, docs, folder)
        docs.write.parquet(f"{folder}/s{k}")
        docs = spark.read.parquet(f"{folder}/s{k}")
    columns = ["doc_id", "piece", "start", "length", "ids_crc32"]
    assert sorted(C.run(spark, folder).select(columns).collect()) == sorted(docs.select(columns).collect())


@pytest.mark.parametrize("stage", range(5))
def test_empty_tables(spark, tmp_path, stage):
    folder = str(tmp_path)
    tables(spark, folder)
    assert C.STAGES[stage][1](spark, spark.read.parquet(f"{folder}/documents.parquet").limit(0), folder).count() == 0


def test_rows_without_an_id_pass_every_stage_whole(spark, tmp_path):
    folder = str(tmp_path)
    texts, *_ = tables(spark, folder)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    rng = random.Random(3)
    first, second = (" ".join(prose(rng, 120)) for _ in range(2))
    rows = [(None, first, "en", "a", len(first)), (None, first, "de", "b", len(first)), (None, second, None, None, len(second))]
    docs = docs.unionByName(spark.createDataFrame(rows, docs.schema))
    for k, (name, stage) in enumerate(C.STAGES[:-1]):
        docs = stage(spark, docs, folder)
        docs.write.parquet(f"{folder}/n{k}")
        docs = spark.read.parquet(f"{folder}/n{k}")
        got = [(r.text, r.lang, r.source, r.n_chars) for r in docs.filter("doc_id is null").collect()]
        want = [(t, lang, source, len(t)) for _, t, lang, source, _ in rows]
        assert sorted(got, key=str) == sorted(want, key=str), name


def test_repeated_ids_keep_their_own_columns(spark, tmp_path):
    folder = str(tmp_path)
    tables(spark, folder)
    rng = random.Random(5)
    rows = [(7000, " ".join(prose(rng, 120)), lang, source, None) for lang, source in (("en", "a"), ("de", "b"), (None, None))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for k, (name, stage) in enumerate(C.STAGES[:-1]):
        docs = stage(spark, docs, folder)
        docs.write.parquet(f"{folder}/r{k}")
        docs = spark.read.parquet(f"{folder}/r{k}")
        assert sorted(((r.text, r.lang, r.source) for r in docs.collect()), key=str) == sorted(((t, lang, s) for _, t, lang, s, _ in rows), key=str), name
