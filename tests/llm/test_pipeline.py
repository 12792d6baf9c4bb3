"""The pipeline against its parts, by brute force on a small corpus."""

import random
from collections import defaultdict

import pytest

import corpus_pipeline
from edge_cases import EDGES
from quirespark.llm import bpe, queries, simhash_dedup
from test_classifiers import INSULTS, SYLLABLES, words
from test_dedup import sha_of

SF_COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(11)
    rows, labels = [], []
    for i in range(400):
        lang = rng.choice(list(SYLLABLES))
        text = words(rng, lang, rng.randint(20, 80))
        toxic = rng.random() < 0.2
        if toxic:
            parts = text.split()
            parts.insert(rng.randrange(len(parts)), rng.choice(INSULTS))
            text = " ".join(parts)
        rows.append((i, text, lang, "s", len(text)))
        labels.append((i, 1, int(toxic)))
    clean = [r for r, (_, _, t) in zip(rows, labels, strict=True) if not t]
    for k, r in enumerate(clean[:20]):
        rows.append((1000 + k, r[1].replace(" ", "\n", 1), r[2], "s", r[4]))  # equal but for white space
    long_ = words(rng, "xa", 600)
    rows += [(2000 + k, long_ + f" {w}", "xa", "s", 1) for k, w in enumerate(("ka", "lo", "mi"))]  # near copies
    rows += [(3000, None, "xa", "s", 0), (3001, "123 456", None, "s", 7), (3002, "", "yo", None, None)]
    path = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame(rows, SF_COLUMNS).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path, {r[0]: r[1] for r in rows}, {i for i, _, t in labels if t}


def test_stages_one_by_one(spark, folder):
    path, texts, toxic = folder
    docs = spark.read.parquet(f"{path}/documents.parquet")
    columns, before = docs.columns, set(texts)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.materialize(stage(spark, docs, path), "stage")
        assert docs.columns == columns
        left = {r.doc_id for r in docs.select("doc_id").collect()}
        gone = before - left
        assert left <= before
        if name == "language ID":
            assert gone == {3000, 3001, 3002}
        elif name == "toxicity":
            assert len(gone & toxic) >= 0.95 * len(toxic) and len(gone - toxic) <= 0.03 * len(before)
        elif name == "exact dedup":
            first = {}
            for i in sorted(before):
                first.setdefault(sha_of(texts[i]), i)
            assert left == set(first.values())
        else:
            groups = defaultdict(set)
            prints = {i: simhash_dedup.fingerprint(texts[i]) for i in before}
            parent = {i: i for i in before}

            def find(x, parent=parent):
                while parent[x] != x:
                    x = parent[x]
                return x

            for i in before:
                for j in before:
                    if i < j and (prints[i] ^ prints[j]).bit_count() <= 4:
                        a, b = sorted((find(i), find(j)))
                        parent[b] = a
            for i in before:
                groups[find(i)].add(i)
            assert left == {min(g) for g in groups.values()}
        before = left
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, path).collect()
    lengths = defaultdict(int)
    for r in packed:
        lengths[r.doc_id] += r.length
    library = bpe.library_tokenizer(bpe.vocabulary_path())
    assert lengths == {i: len(library.encode(texts[i], add_special_tokens=False).ids) + 1 for i in before}


def test_run_gives_the_last_stage(spark, folder):
    path, texts, _ = folder
    ids = {r.doc_id for r in corpus_pipeline.run(spark, path).collect()}
    assert ids and ids < set(texts)


def test_stage_names_and_queries():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language ID", "toxicity", "exact dedup", "near dedup", "packing"]
    assert {n.split("_")[0] for n in queries.queries()} == {f"op{k}" for k in range(1, 14)}
    assert set(queries.oracle_sql()) <= set(queries.queries())


def test_edges_pass_through_all_stages(spark, edges, tmp_path):
    docs = edges.select("doc_id", "text", "lang", "source")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, 1, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() >= 0
    empty = f"{tmp_path}/empty"
    docs.where("false").write.parquet(f"{empty}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{empty}/labels.parquet")
    assert corpus_pipeline.run(spark, empty).count() == 0
    assert len(EDGES) == docs.count()
