import random

import public_tokenizers
from test_decontam import brute as overlaps
from test_jaccard import brute as classes
from test_substring import WORD, brute as windows

import corpus_pipeline
from colloquy.llm import tokens, toxicity


def passages(docs):
    """Texts after the removal of windows that smaller ids hold."""
    starts, out = {}, []
    for d, t in docs:
        w = WORD.findall(t)
        for i in range(len(w) - 49):
            starts[tuple(w[i : i + 50])] = min(starts.get(tuple(w[i : i + 50]), d), d)
    for d, t in docs:
        w, gone = WORD.findall(t), set()
        for i in range(len(w) - 49):
            if starts[tuple(w[i : i + 50])] < d:
                gone |= set(range(i, i + 50))
        if not gone:
            out.append((d, t))
        elif len(gone) < len(w):
            out.append((d, " ".join(x for i, x in enumerate(w) if i not in gone)))
    return out


def test_run_against_brute_force(spark, tmp_path):
    rng = random.Random(8)
    words = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 9))) for _ in range(900)]
    bench = [(i, " ".join(rng.choice(words) for _ in range(20))) for i in range(10)]
    passage = [rng.choice(words) for _ in range(70)]
    docs, labels = [], []
    for i in range(300):
        body = [rng.choice(words) for _ in range(rng.randint(60, 160))]
        toxic = i % 4 == 0
        if toxic:
            body.insert(rng.randrange(len(body)), "zorglen.")
        elif i % 7 == 1:
            body[10:10] = passage
        elif i % 11 == 1:
            body[5:5] = bench[i % 10][1].split()
        docs.append((i, " ".join(body), "en", "s", 0))
        labels.append((i, 1, int(toxic)))
    docs += [(1000 + i, docs[i][1] + (" more" if i % 2 else ""), "en", "s", 0) for i in range(1, 40, 2)] + [(2000, "", "en", "s", 0), (2001, None, None, None, None), docs[2]]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")

    all_docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    model = toxicity.train(all_docs, spark.read.parquet(f"{tmp_path}/labels.parquet"))
    bad = {r.doc_id for r in toxicity.score(all_docs, model).filter("predicted = 1").collect()}
    assert bad == set(range(0, 300, 4))
    left = [(d, t) for d, t, *_ in docs if d not in bad]
    label = {d: c for d, _, c in classes(left, 0.8)}
    left = list({(d, t): None for d, t in left if label[d] in (d, None) or not t})
    left = passages([(d, t or "") for d, t in left])
    left = [(d, t) for d, t in left if not overlaps(t, bench)]
    enc = tokens.encoder(public_tokenizers.path("byte_bpe_50k.json")).tokenizer
    want = {d: len(enc.encode(t, add_special_tokens=False).ids) + 1 for d, t in left}
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id: r.doc_tokens for r in got} == want
    assert sum(r.length for r in got) == sum(want.values())
    assert len(windows(left, 50)) == len(left)


def write_tables(spark, path, docs, schema, labels=(), bench=()):
    spark.createDataFrame(docs, schema).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(list(labels), "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame(list(bench), "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")


def test_stages_keep_columns_of_any_name_and_edge_rows(spark, tmp_path):
    """Nulls, an empty and a very long text, repeated rows, and columns named like those that operators make."""
    rng = random.Random(9)
    words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 8))) for _ in range(3000)]
    passage = [f"p{i}" for i in range(60)]
    texts = [" ".join([f"u{i}"] * 3 + [rng.choice(words) for _ in range(80)]) for i in range(20)]
    texts[7] = " ".join([texts[7], *passage])
    texts[8] = " ".join([*passage, texts[8]])
    long = " ".join(rng.choice(words) for _ in range(30_000))
    base = [(i, t) for i, t in enumerate(texts)] + [(30, long), (31, None), (31, None), (32, ""), (None, "no id at all"), (None, None), (33, "-- \n --"), (3, texts[3])]
    extra = "_rank int, _null string, n_chars string, rest int, facts string, hits int, rank int, node int, h long, tk string, `key` int, low int, `a.b` string, d int, t int, score double"
    docs = [(i, t, 1, None, "many", 2, "f", 3, 4, 5, 6, "tk", 7, 8, "dot", 9, 10, 0.5) for i, t in base]
    write_tables(spark, tmp_path, docs, f"doc_id long, text string, {extra}", [(0, 1, 0), (1, 0, 0)], [(1, "not there at all")])
    out = spark.read.parquet(f"{tmp_path}/documents.parquet")
    schema = out.schema
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = corpus_pipeline.cluster.written(stage(spark, out, str(tmp_path)), name)
        assert out.schema == schema, name
    got = sorted(map(tuple, out.collect()), key=str)
    want = {(i, t) for i, t in base}
    want = want - {(8, texts[8])} | {(8, texts[8].removeprefix(" ".join(passage) + " "))}
    kept = sorted([(i, t, *docs[0][2:]) for i, t in want] + [(31, None, *docs[0][2:])], key=str)
    assert got == kept
    packed = corpus_pipeline.run(spark, str(tmp_path))
    assert packed.select("doc_id").distinct().count() == len({i for i, _ in want}) and packed.filter("doc_id = 30").count() > 10


def test_empty_tables(spark, tmp_path):
    write_tables(spark, tmp_path, [], "doc_id long, text string, lang string, n_chars long")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_a_changed_text_has_its_length(spark, tmp_path):
    passage = " ".join(f"p{i}" for i in range(60))
    write_tables(spark, tmp_path, [(1, passage + " one", 7), (2, passage + " two", 8)], "doc_id long, text string, n_chars int")
    got = corpus_pipeline.drop_repeated_passages(spark, spark.read.parquet(f"{tmp_path}/documents.parquet"), str(tmp_path)).collect()
    assert sorted(map(tuple, got)) == [(1, passage + " one", 7), (2, "two", 3)]
