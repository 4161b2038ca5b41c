"""The whole pipeline against plain loops over its documents."""

import math

import regex
from test_text_operators import fused, reference_encoding, similarity, weighted, words

import corpus_pipeline
from webquarry.llm import icws_dedup, language_fusion


def identified(spark, sf_dir):
    """Ids that the language stage keeps; the text model's evidence is the operator's, the fusion isn't."""
    rows = language_fusion.from_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    langs, model = language_fusion.fit(rows)
    return {i for i, _, _, kept in fused((language_fusion.text_evidence(rows, langs, model).collect(), langs)) if kept}


def first_of_classes(spark, docs):
    """The least id of each class of near duplicates, by all pairs."""
    idf = icws_dedup.idf_table(spark.createDataFrame(list(docs.items()), "doc_id long, text string"))
    sets = {i: weighted(t, idf) for i, t in docs.items()}
    label = {i: i for i in docs}
    for i in docs:
        for j in docs:
            if j < i and label[i] != label[j] and similarity(sets[i], sets[j]) >= 0.8:
                a, b = sorted((label[i], label[j]))
                label = {k: a if v == b else v for k, v in label.items()}
    return {i: docs[i] for i in docs if label[i] == i}


def without_windows(docs, n=13):
    """Texts without the windows that start in a document of a smaller id; texts of which nothing stays go."""
    first = {}
    split = {i: words(t) for i, t in docs.items()}
    for i in sorted(docs):
        for k in range(len(split[i]) - n + 1):
            first.setdefault(tuple(split[i][k : k + n]), i)
    out = {}
    for i, w in split.items():
        gone = {k + j for k in range(len(w) - n + 1) if first[tuple(w[k : k + n])] < i for j in range(n)}
        if not gone:
            out[i] = docs[i]
        elif len(gone) < len(w):
            out[i] = " ".join(x for k, x in enumerate(w) if k not in gone)
    return out


def shingles(text):
    w = regex.sub(r"[^\p{L}\p{N}]+", " ", (text or "").lower()).strip().split(" ")
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)}


def test_pipeline_is_that_of_a_replay(spark, sf_dir):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    items = [s for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect() if (s := shingles(r.text))]
    kept = identified(spark, sf_dir)
    docs = {i: t for i, t in docs.items() if i in kept}
    sizes = [len(docs)]
    docs = first_of_classes(spark, docs)
    sizes.append(len(docs))
    before = docs
    docs = without_windows(docs)
    sizes.append(sum(docs[i] != before[i] for i in docs))
    own = {i: shingles(t) for i, t in docs.items()}
    docs = {i: t for i, t in docs.items() if not any(len(s & own[i]) >= math.ceil(0.8 * len(s) - 1e-9) for s in items)}
    sizes.append(len(docs))
    library = reference_encoding()
    want = {i: library.encode_ordinary(t or "") for i, t in docs.items()}
    got = {r.doc_id: list(r.ids) for r in corpus_pipeline.run(spark, sf_dir).collect()}
    assert got == want
    # Every stage has something to do.
    assert sizes[0] > sizes[1] > sizes[3] and sizes[2] > 0
