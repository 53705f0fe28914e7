"""The pipeline on a small set with planted cases."""

import random

import corpus_pipeline


def sentence(rng, n, vocab=4_000):
    return " ".join(f"w{rng.randrange(vocab)}" for _ in range(n))


def test_pipeline_catches_planted_cases(spark, tmp_path):
    rng = random.Random(11)
    texts, labels = {}, []
    for i in range(400):
        bad = i % 5 == 2
        w = sentence(rng, rng.randint(30, 90)).split()
        if bad:
            w.insert(rng.randrange(len(w)), rng.choice(["vile", "nasty"]))
        texts[i] = " ".join(w)
        labels.append((i, int(bad)))
    copy, near = texts[0], texts[1].split()
    near[-1] = "changed"
    passage, item = sentence(rng, 60), sentence(rng, 30)
    texts |= {500: copy, 501: " ".join(near), 502: f"{sentence(rng, 40)} {passage} {sentence(rng, 40)}", 503: f"{sentence(rng, 40)} {passage} {sentence(rng, 40)}"}
    texts |= {504: f"{sentence(rng, 20)} {item.upper()} {sentence(rng, 20)}", 505: sentence(rng, 50) + " vile nasty", 506: None, 507: ""}
    rows = [(i, t, "en", f"s{i % 3}", len(t or "")) for i, t in texts.items()]
    d = str(tmp_path)
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    docs = spark.read.parquet(f"{d}/documents.parquet")
    columns, kept = docs.columns, {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, d).write.parquet(f"{d}/out{k}")
        docs = spark.read.parquet(f"{d}/out{k}")
        kept[name] = {r.doc_id: r for r in docs.collect()}
        if k < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == columns
    tox, dup, sub, dec, mix = kept.values()
    assert 505 not in tox and sum(i in tox for i, y in labels if y) <= 8 and sum(i not in tox for i, y in labels if not y) <= 8
    assert {0, 1, 502, 503, 506, 507} <= set(dup) and not {500, 501} & set(dup) and len(dup) >= len(tox) - 2
    assert passage in sub[502].text and passage not in sub[503].text and sub[503].n_chars == len(sub[503].text) and len(sub) == len(dup)
    assert 504 not in dec and len(dec) == len(sub) - 1
    total = sum(len((r.text or "").split()) for r in dec.values())
    assert set(mix) <= set(dec) and abs(sum(r.taken for r in mix.values()) - 1.5 * total) < 400
