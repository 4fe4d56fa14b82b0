"""A query of each kind against its SQL; the driver compares all of them."""

import pytest

from palimpsest import queries

PICKED = "s6_span_score s6_own_scorers c6_extractive_summary g5_own_index_writer d4_switch_functions x3_significant_words x11_preview w1_client_written_ranges w10_message_range_check g2_safe_cuts g3_cut_point g4_group_exchanges g5_index_line s4_lexical_relevance f4_fact_batches f3_validate_model_facts f5_file_facts f5_fold_facts f9_active_facts p6_fold_oldest p7_plan_summary r5_render_recap d4_decide_switch l1_chain_hashes l7_record_turns t1_settle_requests t3_request_kind t6_subagent_turn t8_conversation_parts a1_traffic_totals a8_collection_cost a9_cache_state i2_block_text i7_uncached_prefix_tokens i10_reply_outline i11_assemble_stream_replies h12_quiet_runs h17_credential_refusal e2_grade_answers e3_split_answers q1_stream_collections q2_stream_cache_state q2_stream_cold_caches q3_stream_idle_close q5_stream_settle q7_stream_health q7_stream_passes q9_late_facts_stream l1_chain_hashes_of_blocks l2_match_conversations".split()


@pytest.mark.parametrize("name", PICKED)
def test_query(name, same):
    assert same(queries.queries()[name], queries.oracle_sql()[name]) > 0


def test_registered():
    assert set(queries.oracle_sql()) <= set(queries.queries())


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
