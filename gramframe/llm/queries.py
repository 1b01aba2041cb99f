"""The operators' queries over whole tables, and SQL where it can express one."""

from gramframe.llm import decontam, html_text, line_dedup, near_dup, packing, quality, resampling, toxicity, url_filter, warc

QUERIES = {
    "op1_line_dedup": line_dedup.query,
    "op2_best_fit_packing": packing.query,
    "op3_url_filters": url_filter.query,
    "op4_warc": warc.query,
    "op5_decontamination": decontam.query,
    "op6_importance_resampling": resampling.query,
    "op7_html_extraction": html_text.query,
    "op8_quality_rules": quality.query,
    "op9_toxicity": toxicity.query,
    "op10_near_dedup": near_dup.query,
}
ORACLE_SQL = {"op3_url_filters": url_filter.ORACLE_SQL}
