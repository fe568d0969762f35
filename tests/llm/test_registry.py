"""The registered queries: names, result columns, and DuckDB's answer where SQL can state it."""

import hashlib

import duckdb
import pytest
from test_sketches import brute_next, edited, jaccard

from tessera.llm import registry
from tessera.plans.registry import TABLES

SF = "/root/testdata/sf0.001"
COLUMNS = {
    "op1_fingerprints": "doc_id n_chars edited_sha256 fingerprint edited_fingerprint near_edited near_next",
    "op2_bpe_transducer": "doc_id n_tokens ids_sha256 decoded_sha256",
    "op3_token_counts": "doc_id n_bytes n_tokens over_limit",
    "op4_decontaminate": "doc_id n_words n_hit n_items items_sha256 contaminated",
    "op5_warc": "page_id payload_bytes payload_digest record_type refers_to",
    "op6_simhash_index": "doc_id fingerprint component_id",
    "op7_url_filter": "page_id url fetched_on matches verdict rule list",
    "op8_quotation": "conv_id turn role parent_turn root_turn depth reply_index",
    "op9_toxicity": "doc_id held_out score predicted",
    "op10_gated_lm": "doc_id held_out n_tokens n_known train_tokens base_score score",
    "op11_topk_scan": "query_id rank vec_id score",
    "op12_word_runs": "doc_id n_runs start length period exponent_milli runs_sha256 collapsed_sha256",
    "op13_prefix_trie": "conv_id depth parent_conv_id n_convs n_children n_leaves saved_tokens ends_sha256",
}


def test_one_query_per_operator():
    assert set(registry.QUERIES) == set(COLUMNS) and set(registry.ORACLE) <= set(COLUMNS)
    assert sorted(int(k[2:].split("_")[0]) for k in COLUMNS) == list(range(1, 14))


@pytest.mark.parametrize("key", sorted(COLUMNS))
def test_columns_and_rows(spark, key):
    df = registry.QUERIES[key](spark, SF)
    want = COLUMNS[key].split()
    assert df.columns[: len(want)] == want
    rows = [tuple(r) for r in df.collect()]
    table = {"page_id": "pages", "conv_id": "conversations", "doc_id": "documents"}.get(want[0])
    if table and key != "op13_prefix_trie":  # one row per node there
        assert len(rows) == spark.read.parquet(f"{SF}/{table}.parquet").count()
    if key not in registry.ORACLE:
        return
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    cur = con.execute(registry.ORACLE[key])
    names = [d[0] for d in cur.description]
    assert sorted(names) == sorted(df.columns)
    at = [names.index(c) for c in df.columns]
    assert sorted(map(str, rows)) == sorted(str(tuple(r[i] for i in at)) for r in cur.fetchall())


def test_fingerprints_of_the_given_documents(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = {r.doc_id: r for r in registry.QUERIES["op1_fingerprints"](spark, SF).collect()}
    off = []
    for i, text, following in brute_next(docs):
        e = edited(text, following)
        assert got[i].edited_sha256 == hashlib.sha256(e.encode()).hexdigest() and got[i].n_chars == len(text)
        off += [abs(got[i].near_edited - jaccard(text, e)), abs(got[i].near_next - jaccard(text, following))]
    assert sum(off) / len(off) < 0.03 and max(off) < 0.2
