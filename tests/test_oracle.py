"""Registered queries against their DuckDB oracle on the smallest fixture."""

import os

import duckdb
import pytest

from tests.conftest import SF_SMALL
from tools.compare import canon
from voxframe.plans import load_all
from voxframe.views import TABLES

QUERIES, ORACLE = load_all()
CURATED = [
    "split_by_speaker", "split_holdout", "cap_hours", "cap_words", "bal_language_batches", "bal_batch_report", "w_length",
    "smp_weighted", "smp_lang_uniform", "bat_perfect", "bat_bucket", "bat_shard", "seg_prompt", "seg_chunks",
    "asm_extra_keys", "asm_pair_features", "asm_label_time_join", "asm_safe_filename",
    "cln_by_language", "cln_french", "nrm_separators", "nrm_numbers_lex", "pnc_split", "pnc_restore", "snt_split",
    "voc_build_chars", "tok_encode_chars", "tok_decode", "bpe_pair_counts", "lex_load", "lex_lookup", "lex_greedy",
    "emb_cos_matrix", "emb_softmax_loss", "emb_accuracy", "emb_codebook",
    "aln_sentences", "aln_durations", "aln_avg_over_dur", "aln_fill_gaps", "aln_redact",
    "sig_resample", "sig_reverb", "frm_stft_mag", "frm_mel", "frm_interpolate", "vad_cut", "sil_endpoint", "sil_trim",
    "anl_describe_by", "anl_summary", "anl_percentiles_long", "anl_parse_generated", "anl_params",
    "qua_stft", "inf_report", "flt_infer_rows", "str_sessions", "str_hours",
    "src_cml_tts", "src_mailabs", "src_nancy", "src_ljspeech_test", "src_vctk", "src_asr_segments", "snk_feature_cache",
]
KEYS = sorted(ORACLE) if os.environ.get("VOXFRAME_FULL") else CURATED


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    return c


def test_every_oracle_has_a_query():
    assert set(ORACLE) <= set(QUERIES)


@pytest.mark.parametrize("key", KEYS)
def test_query_matches_oracle(spark, con, key):
    df = QUERIES[key](spark, SF_SMALL)
    rows = [tuple(r) for r in df.collect()]
    cur = con.execute(ORACLE[key])
    ocols = [d[0] for d in cur.description]
    orows = cur.fetchall()
    assert sorted(df.columns) == sorted(ocols)
    assert len(rows) == len(orows)
    assert canon(df.columns, rows) == canon(ocols, orows)
