import hashlib
import struct

import corpus_pipeline as P
import public_tokenizers
from test_decontaminate import brute as contaminated
from test_simhash_index import brute_components, brute_print
from tokenizers import Tokenizer

from tessera.llm import toxicity


def plain(spark, docs, sf):
    """The stages once more without the operators' methods; the classifier's score is taken as given."""
    model = toxicity.fit(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    scorer = toxicity.Scorer(model.features, model.weights, model.bias)
    rows = sorted((r.doc_id, r.text) for r in docs.collect())
    rows = [r for r in rows if scorer.score(r[1]) < 0.5]
    groups = brute_components([i for i, _ in rows], [brute_print(t) for _, t in rows])
    rows = [r for r, g in zip(rows, groups, strict=True) if r[0] == g]
    items = [tuple(r) for r in spark.read.parquet(f"{sf}/benchmark.parquet").select("item_id", "text").collect()]
    dirty = {r[0] for r in contaminated(rows, items) if r[5]}
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    out = []
    for i, t in rows:
        if i not in dirty:
            ids = library.encode(t or "", add_special_tokens=False).ids
            sha = lambda b: hashlib.sha256(b).hexdigest()
            out.append((i, len(ids), sha(struct.pack(f"<{len(ids)}I", *ids)), sha(library.decode(ids, skip_special_tokens=False).encode())))
    return sorted(out)


def test_run_equals_plain_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    want = plain(spark, docs, sf)
    assert sorted(tuple(r) for r in P.run(spark, sf).collect()) == want
    assert 0 < len(want) < docs.count()


def test_stages_keep_columns_and_survive_odd_rows(spark, sf):
    rows = [(1, None, "en", "s", 0), (2, "", None, "s", 0), (None, "some words of no kind", "en", None, None), (3, "x y z " * 30000, "de", "s", 5), (3, "x y z " * 30000, "de", "s", 5)]
    docs = spark.createDataFrame([(*r, "extra") for r in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint, score string")
    for table in (docs, docs.limit(0)):
        now = table
        for _, stage in P.STAGES[:-1]:
            now = stage(spark, now, sf)
            assert now.columns == docs.columns
        kept = sorted((r.doc_id for r in P.STAGES[-1][1](spark, now, sf).collect()), key=str)
        # 1 and 2 share the empty fingerprint, the repeated row is one document
        assert kept == ([1, 3, None] if table is docs else [])
